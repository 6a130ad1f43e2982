"""Matches of vectors from a threshold on, with far apart cells left out: exactly those of all pairs, by fewer comparisons.

Of some rows, drawn by a hash, those farthest from each other are pivots; every row belongs to the cell of its nearest pivot, and a cell's radius is the largest angle between its pivot and its rows.
Angles obey the triangle inequality, so a row can only reach the threshold with rows of a cell whose pivot is no farther from it than the threshold's angle and the
cell's radius together.  Asks of neighbouring cells make a block (operators.sweep), and a block is sent the answers of the cells that any of its asks reaches; there, an ask
meets those of its own cells.  So no row is sent to a cell, and where all cells reach all, a row goes to as many places as there are blocks.  Vectors of other lengths than
the pivots' have a cell of their own by length.  The threshold must be above 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrace.operators.similar import _cells_that_meet, _matrix, _Vectors, _vectors, _window, counted, nearest
from echotrace.operators.sweep import BLOCK, slice_of, slices_after, swept
from echotrace.shared import saved

PIVOTS, ROWS_A_PIVOT, DRAWN, SLACK = 1024, 64, 8, 1e-6


def _units(column: pa.ChunkedArray) -> np.ndarray:
    x = _matrix(column)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def _with_columns(rows: DataFrame, make: Callable[[pa.Table], dict], added: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                for name, column in make(table).items():
                    table = table.append_column(name, column)
                yield from table.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(each, f"{kinds}, {added}")


def _far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points, each the farthest from those before it."""
    chosen, nearest = [0], points @ points[0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


def _angles(table: pa.Table, pivots: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Angles between rows (those that are of the pivots' length) and pivots."""
    return np.arccos(np.clip(_units(table.column("_vector").take(pa.array(same))) @ pivots.T, -1, 1))


def _in_line(points: np.ndarray) -> np.ndarray:
    """The points, each followed by the nearest of those left."""
    left, line = np.ones(len(points), bool), [0] if len(points) else []
    while len(line) < len(points):
        left[line[-1]] = False
        line.append(int(np.where(left, points @ points[line[-1]], -np.inf).argmax()))
    return points[line]


def in_cells(rows: DataFrame, least: float, *, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(asks, answers): all rows with _cell, and asking ones with _cells too, a bitmap of those where they may find a cosine of ``least``; cells below 0 are of other lengths, and
    rows there only find their own.  Cells with numbers near to each other are near.  rows: (_g, _at, _id, _vector, _size, _now, ...)."""
    rows = rows.filter("_size > 0")
    n = rows.count()
    wanted = max(1, min(pivots, -(-n // ROWS_A_PIVOT)))
    drawn = rows.orderBy(F.xxhash64("_id", "_vector")).limit(DRAWN * wanted).select("_vector", "_size").toArrow()  # bounded by the pivots
    sizes = drawn.column("_size").to_numpy()
    size = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    points = _in_line(_far_apart(_units(drawn.column("_vector").filter(pa.array(sizes == size))), wanted)) if len(sizes) else np.zeros((0, 0))

    def place(table: pa.Table) -> dict:
        own = table.column("_size").to_numpy()
        cell, off, same = -own.astype(np.int64), np.zeros(len(own)), np.flatnonzero(own == size)
        if len(same):
            angles = _angles(table, points, same)
            cell[same] = angles.argmin(1)
            off[same] = angles.min(1)
        return {"_cell": pa.array(cell), "_off": pa.array(off)}

    placed = saved(_with_columns(rows, place, "_cell long, _off double"), "cells")
    radius = np.full(len(points), -np.inf)  # of cells without rows
    for r in placed.filter("_cell >= 0").groupBy("_cell").agg(F.max("_off").alias("r")).collect():  # a row a pivot
        radius[r["_cell"]] = r["r"]
    reach = float(np.arccos(np.clip(least - SLACK, -1, 1))) + SLACK

    def ask(table: pa.Table) -> dict:
        own = table.column("_size").to_numpy()
        cells, same = np.zeros((len(own), len(points)), bool), np.flatnonzero(own == size)
        if len(same):
            cells[same] = _angles(table, points, same) <= reach + radius
        return {"_cells": pa.array([c.tobytes() for c in np.packbits(cells, axis=1, bitorder="little")], pa.binary())}

    return _with_columns(placed.filter("_now"), ask, "_cells binary"), placed


def meeting(asks: DataFrame, answers: DataFrame, *, window: int | None, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both, dealt by (_g, _slice, _part): blocks of asks of cells that are near to each other, and all answers of the cells that any ask of a block reaches."""
    asks, answers = asks.withColumn("_slice", slice_of(window)), answers.withColumn("_slice", slice_of(window))
    line = Window.partitionBy("_g", "_slice").orderBy("_cell")
    sizes = asks.groupBy("_g", "_slice", "_cell").agg(F.count("*").alias("_n")).withColumn("_from", F.sum("_n").over(line) - F.col("_n"))
    same = F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_slice") == F.col("_os")) & (F.col("_cell") == F.col("_oc"))
    other = lambda rows, *more: rows.select(F.col("_g").alias("_og"), F.col("_slice").alias("_os"), F.col("_cell").alias("_oc"), *more)
    place = F.col("_from") + F.pmod(F.xxhash64("_id"), F.col("_n"))
    # merge joins: sizes of rows with vectors are told by files, and those may be far smaller than the rows
    asks = asks.join(other(sizes, "_n", "_from").hint("merge"), same).withColumn("_part", F.floor(place / size).cast("int")).drop("_og", "_os", "_oc", "_n", "_from")

    @F.pandas_udf("array<bigint>")
    def reached(cell: pd.Series, cells: pd.Series) -> list:
        bits = 0
        for c in cells:
            bits |= int.from_bytes(c, "little")
        marks = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
        return [*np.unique(cell[cell < 0]).tolist(), *np.flatnonzero(np.unpackbits(marks, bitorder="little")).tolist()]

    blocks = asks.groupBy("_g", "_slice", "_part").agg(reached("_cell", "_cells").alias("_cells"))
    seen = F.sequence(F.col("_slice") - (F.size(slices_after(window)) - 1), F.col("_slice"))
    targets = blocks.withColumn("_os", F.explode(seen)).select(F.col("_g").alias("_og"), "_os", F.explode("_cells").alias("_oc"), F.struct("_slice", "_part").alias("to"))
    targets = targets.groupBy("_og", "_os", "_oc").agg(F.collect_list("to").alias("_to"))
    met = answers.join(targets.hint("merge"), same).withColumn("_to", F.explode("_to")).withColumns({"_slice": F.col("_to._slice"), "_part": F.col("_to._part")})
    return asks, met.drop("_og", "_os", "_oc", "_to").withColumn("_cells", F.lit(None).cast("binary"))


class _Compared:
    """How many pairs of rows are compared."""

    def __init__(self, asks: pa.Table) -> None:
        self.asks, self.n = _Vectors(asks, True), 0

    def add(self, answers: pa.Table) -> None:
        self.n += sum(len(i) * len(j) for i, j in _cells_that_meet(self.asks, _Vectors(answers.drop_columns("_cells"), True)))

    def end(self) -> pa.Table:
        return pa.table({"n": [self.n]})


def comparisons(left: DataFrame, right: DataFrame) -> int:
    """How many pairs of rows are compared."""
    return swept(left, right, _Compared, "n long", order=["_at", "_id"]).agg(F.sum("n")).first()[0] or 0


def matches_by_cosine(messages: DataFrame, history: DataFrame | None = None, *, order: str, vector: str, group: str | None = None, threshold: float, digits: int = 9, size: int = BLOCK, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, matched_id, similarity) of the messages with a match: the rows of similar.best_cosine() that are at the threshold or above it."""
    window = _window(ts, retention_s)
    left, right = meeting(*in_cells(_vectors(messages, history, group, order, ts, vector), threshold), window=window, size=size)
    kind = messages.schema[order].dataType
    found = nearest(left, right, window, digits, float(np.nextafter(threshold, -np.inf)), cells=True)
    return found.select(F.col("id").cast(kind).alias(order), F.col("m").cast(kind).alias("matched_id"), F.col("s").alias("similarity"))


def senders_by_cosine(messages: DataFrame, history: DataFrame | None = None, *, order: str, vector: str, sender: str, group: str | None = None, threshold: float, digits: int = 9, size: int = BLOCK, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, unique_senders) as similar.senders_by_cosine() has them."""
    window = _window(ts, retention_s)
    left, right = meeting(*in_cells(_vectors(messages, history, group, order, ts, vector, sender), threshold), window=window, size=size)
    return counted(left, right, window, digits, threshold, messages, order, cells=True)
