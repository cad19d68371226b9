"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes every stage's result to the shared folder as Parquet and
rereads it as the next one's input, so a lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm import linededup, mixing, packing, simhash, toxicity
from factweave.llm.common import WORD, stash, table, text_of
from factweave.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Copies of one row that a task writes together.
COPIES = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; all columns unchanged.

    A null text scores as an empty one. Every row is judged by its own whole text, so rows that repeat a
    text share its fate and rows that repeat an id, or have none, are judged apart; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", 4, 2)
    score = toxicity.scorer(spark, model)
    return docs.select(*COLUMNS, score("text").alias("_score")).filter("_score < 0.3").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later ones without the blocks that earlier ones hold; ``n_chars`` follows the text.

    No row is dropped. Null and empty texts stay as they are; rows that repeat id and text are treated
    alike, and a later copy under another id may end up empty. An empty table stays empty.
    """
    cleared = linededup.dedup_lines(docs.select(*COLUMNS, F.length("text").alias("_before")))
    chars = F.when(F.length("text") != F.col("_before"), F.length("text")).otherwise(F.col("n_chars"))
    return cleared.withColumn("n_chars", chars.cast("long")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, a digest of all columns: rows that share it are alike in every column."""
    return docs.select(*COLUMNS).withColumn("_key", F.xxhash64(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, one without an id if there is no other.

    Rows are judged by their own texts, so unlike texts under one id or without an id all stay; of
    rows that repeat both id and text one stays, the first in order of the other columns.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = simhash.near_duplicates(docs, id_col="_row").select("_row", "component_id").distinct()
    named = docs.groupBy("_row", F.col("doc_id").isNull().alias("_none"), "doc_id").agg(F.count("*").alias("_n"))
    of_group = groups.join(named, "_row").groupBy("component_id").agg(F.min(F.struct("_none", "doc_id", "_row", "_n")).alias("_least"))
    least = of_group.select("_least._row", "_least._n").groupBy("_row").agg(F.max("_n").alias("_n"))
    rows = stash(docs.join(least.hint("merge"), "_row"))
    rest = F.struct("lang", "source", "n_chars")
    repeated = rows.filter("_n > 1").groupBy("doc_id", "text").agg(F.min(rest).alias("_rest")).select("doc_id", "text", "_rest.*")
    return rows.filter("_n = 1").select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows that are alike in every column share their copies out.

    Repeated rows are counted before they meet, and their copies are made by many tasks. Unlike rows under one digest
    share its copies by their numbers, so that none is lost.
    """
    docs = keyed(docs)
    taken = mixing.mix(docs, id_col="_key").groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n"))
    rows = stash(docs.join(taken.filter("_copies > 0").hint("merge"), "_key"))
    repeated = rows.filter("_n > 1").groupBy("_key", *COLUMNS).agg(F.count("*").alias("_alike"), F.first("_copies").alias("_copies"), F.first("_n").alias("_n"))
    upto = F.sum("_alike").over(Window.partitionBy("_key").orderBy(*COLUMNS))
    share = lambda n: F.when(n == F.col("_n"), F.col("_copies")).otherwise(F.floor(F.col("_copies") / F.col("_n") * n))
    repeated = repeated.withColumn("_upto", upto).withColumn("_copies", share(F.col("_upto")) - share(F.col("_upto") - F.col("_alike"))).filter("_copies > 0")
    repeated = repeated.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES)))).repartition("_key", "_part")
    repeated = repeated.withColumn("_copies", F.least(F.lit(COPIES).cast("long"), F.col("_copies") - F.col("_part") * COPIES))
    rows = rows.filter("_n = 1").select(*COLUMNS, "_copies").unionByName(repeated.select(*COLUMNS, "_copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: The stages can't be said in SQL (fitted model, hash family, tokenizer); tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
