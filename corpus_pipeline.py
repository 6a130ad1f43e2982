"""From raw documents to token files: language, near copies, test leaks, mixing, tokens.

Every stage works on all that the one before kept and, but for the last, returns the columns of ``documents``.  Stages are written as
Parquet to the shared folder and read again, so a lost executor costs no more than the stage at hand.

1. language: documents whose language the models reject (null or letterless texts, or far from every language's own texts) go; where no document has a
   language, there are no models and only letterless texts go.
2. near_copies: one document stays of every component of documents that share 0.8 of their 5-word shingles; documents without words stay.
3. leaks: documents that contain a test item go.
4. mixing: sources are mixed to their target weights; a document comes once for each round that takes words of it, cut after the last one, in
   order of the schedule.
5. tokens: token ids are written to seekable shards, in the order of the mix; the rows are what is read back from them.

An empty table passes through all stages.  Columns other than doc_id, text, lang and source pass as they are, whatever their names; n_chars
follows the text where it is cut.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from echotrace.llm import decontaminate, language, mixing, shingle_join, token_files
from echotrace.llm.common import packed, read_table, save, unpacked
from echotrace.shipping import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    judged = language.identify(packed(docs, "doc_id", "text"), language.fit(docs))
    return judged.filter("not rejected").select(*unpacked(docs.columns, "doc_id", "text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return shingle_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    needed = [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    mixed, _ = mixing.mix_sources(mixing.with_sizes(packed(docs, *needed)))
    return mixing.take_mix(mixed, [*needed, "_rest"]).select(*unpacked(docs.columns, *needed))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return token_files.read_tokens(token_files.write_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")), in_file_order=True))


STAGES = [("language", identify_language), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("mixing", mix), ("tokens", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        gc.collect()  # what the stage held in the driver
    return docs


#: SQL has neither the language models nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None
