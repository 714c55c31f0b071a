"""Helpers shared by the operators: table reading, written intermediate tables, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space throughout: space, tab, newline, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode, where the session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="reelspark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, and a lost executor
    costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Rows of a filter's table of bits at most, 64 bits each: bounds what is broadcast.
FILTER_WORDS = 1 << 20


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def flagged(df: DataFrame, key: list[Column], ids: DataFrame, id_key: list[Column], name: str, words: int = FILTER_WORDS) -> DataFrame:
    """df with a boolean column `name`: false only where the key is surely not among the ids' keys (a Bloom filter of one hash).

    The bits are a table of at most `words` rows whatever the input, and are broadcast; nothing of df is shuffled. Where the ids
    are more than the bits, the filter lets more through and only saves less. Keys of both sides must have the same types."""
    word, bit = fresh(df, "_word"), fresh(df, "_bit")
    at = lambda cols: (F.pmod(F.xxhash64(*cols), F.lit(words)).alias(word), F.pmod(F.shiftrightunsigned(F.xxhash64(*cols), 32), F.lit(64)).cast("int").alias(bit))
    bits = ids.select(*at(id_key)).groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))).alias(f"{bit}s"))
    out = df.select("*", *at(key)).join(F.broadcast(bits), word, "left")
    return out.withColumn(name, F.coalesce(F.getbit(f"{bit}s", bit) == 1, F.lit(False))).drop(word, bit, f"{bit}s")


def without(df: DataFrame, key: list[Column], gone: DataFrame, gone_key: list[Column]) -> DataFrame:
    """Rows of df whose key is not among those of gone, with df's columns; nulls in keys match nulls. Only rows that the filter
    lets through are shuffled for the exact test, the others pass as they are read."""
    mark = fresh(df, "_maybe")
    marked = flagged(df, key, gone, gone_key, mark)
    names = [fresh(df, f"_gone{k}") for k in range(len(key))]
    right = gone.select(*[k.alias(n) for k, n in zip(gone_key, names)]).distinct()
    same = [k.eqNullSafe(F.col(n)) for k, n in zip(key, names)]
    left = marked.filter(mark).drop(mark).join(right, same, "left_anti")
    return marked.filter(~F.col(mark)).drop(mark).unionByName(left)
