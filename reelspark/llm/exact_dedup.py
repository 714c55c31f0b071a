"""Exact dedup: groups by a 128-bit content hash, bytes compared inside the groups, one row of each group stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import WHITE, read, saved, text_or_empty, without


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def _hashed(docs: DataFrame, content_hash: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    whole = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", F.length("text").cast("long").alias("n"), normalised(F.col("text")).alias("norm"))
    return whole.withColumn("h", content_hash(F.col("norm")))


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; a null text counts as empty. Of equal texts the
    one with the most code points stays, then the one with the smallest id; a null id loses to any other. Rows
    that repeat an id are rows of their own: all rows with the id that stays are kept. An empty table gives an
    empty result. Other columns of docs are ignored.

    The digest columns are computed once and written. Text is shuffled once, as part of a grouping key, so that
    Spark compares its bytes and copies collapse before the shuffle; only digests are joined back. Texts that
    share a content hash and differ are grouped by the text itself.
    """
    whole = _hashed(docs, content_hash, id_col, text_col)
    light = saved(whole.select("doc_id", "n", "h", F.sha2("norm", 256).alias("text_sha256")), "exact")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    texts = whole.groupBy("h", "norm").agg(F.count("*").alias("rows")).groupBy("h").agg(F.count("*").alias("texts"))
    collided = saved(texts.filter("texts > 1").select("h"), "collided")
    groups = light.groupBy("h").agg(best.alias("best"), F.count("*").alias("group_size"))
    out = light.join(groups, "h")
    columns = ["doc_id", F.col("best.id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"), "text_sha256"]
    if collided.isEmpty():
        return out.select(*columns)
    mixed = whole.join(collided, "h", "left_semi")
    by_text = mixed.groupBy("h", "norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    parted = mixed.join(by_text, ["h", "norm"]).withColumn("text_sha256", F.sha2("norm", 256)).select(*columns)
    return out.join(collided, "h", "left_anti").select(*columns).unionByName(parted)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that exact_dedup keeps, with the columns they came with; nulls, ties, repeated rows and empty
    tables as there. Of the texts only those that may be dropped are shuffled once more."""
    gone = saved(exact_dedup(docs).filter("NOT kept").select("doc_id", "text_sha256"), "gone")
    digest = F.sha2(normalised(text_or_empty("text")), 256)
    return without(docs, [F.col("doc_id"), digest], gone, [F.col("doc_id"), F.col("text_sha256")])


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE = {
    "op5_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
}
