"""Blocks of asking rows, each with the stream of all that it may meet: a row sees what is before it and less than the retention older, and no pair leaves a task.

A group's time is cut into slices, ``SLICES`` to a retention, and the asking rows of a slice by a hash into blocks of about ``BLOCK`` rows.  Answers go to the blocks of
their slice and of the next ones that a retention connects.  A task holds the asks of one block at a time, streams through its answers, and keeps for each ask what
is best so far, or how many senders; memory is bounded by the block whatever the number of answers, and what leaves the task grows with the asks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, TILE, SLICES = 4096, 1024, 4
BY = ["_g", "_slice", "_part"]


class Work(Protocol):
    """What is done with the asks of a block: answers come in batches, and results may come with any of them and at the end."""

    def add(self, answers: pa.Table) -> pa.Table | None: ...

    def end(self) -> pa.Table | None: ...


def slice_of(window: int | None):
    return F.lit(0).cast("long") if window is None else F.floor(F.col("_at") / max(window // SLICES, 1))


def slices_after(window: int | None):
    """The slices whose asks may see an answer of _slice."""
    return F.array("_slice") if window is None else F.sequence(F.col("_slice"), F.col("_slice") + -(-window // max(window // SLICES, 1)))


def dealt(rows: DataFrame, *, window: int | None, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(asks, answers) of ``rows`` (_g, _at, _id, _now, ...), dealt by ``BY``."""
    rows = rows.withColumn("_slice", slice_of(window))
    asks = rows.filter("_now")
    parts = asks.groupBy("_g", "_slice").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    same = F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_slice") == F.col("_os"))
    own = parts.select(F.col("_g").alias("_og"), F.col("_slice").alias("_os"), "_n")
    asks = asks.join(own.hint("merge"), same).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")).drop("_og", "_os", "_n")
    seen = F.sequence(F.col("_slice") - (F.size(slices_after(window)) - 1), F.col("_slice"))
    targets = parts.select("_g", F.struct("_slice", "_n").alias("to"), F.explode(seen).alias("_os")).groupBy(F.col("_g").alias("_og"), "_os").agg(F.collect_list("to").alias("_to"))
    met = rows.join(targets.hint("merge"), same).withColumn("_to", F.explode("_to")).withColumns({"_slice": F.col("_to._slice"), "_part": F.explode(F.sequence(F.lit(0), F.col("_to._n") - 1))})
    return asks, met.drop("_og", "_os", "_to")


def _runs(batch: pa.RecordBatch, by: list[str]) -> list[int]:
    """Where runs of equal keys begin in a batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in by:
        codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(new).tolist(), batch.num_rows]


def swept(asks: DataFrame, answers: DataFrame, work: Callable[[pa.Table], Work], schema: str, *, by: list[str] = BY, order: list[str]) -> DataFrame:
    """The results (``schema``) of the work on every block; answers come in ``order``."""
    answers = answers.select(*asks.columns)
    both = asks.withColumn("_answers", F.lit(False)).unionByName(answers.withColumn("_answers", F.lit(True)))
    both = both.repartition(*by).sortWithinPartitions(*by, "_answers", *order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, going = None, [], None
        out = lambda table: table.combine_chunks().to_batches() if table is not None and table.num_rows else []
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = _runs(batch, by)
            for lo, hi in zip(edges, edges[1:]):
                own = tuple(batch.column(c)[lo].as_py() for c in by)
                if own != key:
                    if going is not None:
                        yield from out(going.end())
                    key, held, going = own, [], None
                piece = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                answering = piece.column("_answers").to_numpy()
                n = int(np.searchsorted(answering, True))
                if n:
                    held.append(piece.slice(0, n))
                if n < len(answering) and held:
                    going = going or work(pa.concat_tables(held).combine_chunks())
                    yield from out(going.add(piece.slice(n).combine_chunks()))
        if going is not None:
            yield from out(going.end())

    return both.mapInArrow(each, schema)


def before(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], window: int | None, inclusive: bool) -> np.ndarray:
    """Whether rows of a (their times and ids) see rows of b."""
    (x, i), (y, j) = a, b
    seen = y[None] < x[:, None]
    same = y[None] == x[:, None]
    if same.any():
        seen |= same & ((j[None] <= i[:, None]) if inclusive else (j[None] < i[:, None]))
    if window is not None:
        seen &= y[None] > x[:, None] - window
    return seen


def times(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("_at").to_numpy(), table.column("_id").to_numpy()
