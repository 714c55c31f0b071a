"""Wire files of frames read by ranges: where a frame begins is guessed in each range, then the ranges' guesses are chained."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.sources.records import files_of, open_file
from reelspark.sources.tables import written

#: A frame's head: track, time, key flag, duration and length of its data.
HEAD = "<BqBQI"
HEAD_SIZE = struct.calcsize(HEAD)
SIZE_AT = HEAD_SIZE - 4
NO_DURATION = (1 << 64) - 1
#: Frames that must follow one another for a guess, and the bytes of a range in which a guess is looked for.
FOLLOW, LOOK = 4, 1 << 20
#: Bytes of frames handed on at once, and bytes of files, and ranges, for which ranges are dealt to one task.
HELD, TASK, TASK_RANGES = 16 << 20, 64 << 20, 4096
RANGES = "file string, size long, k long, lo long, hi long"
#: A range with the place where a frame begins (null: none does), the frames from there on, and where the first frame of a later range begins.
CHAINED = f"{RANGES}, entry long, frames long, exit long"
#: Where a range should begin, and it and the ranges behind it, as many as one task follows on its way.
BEHIND = 256
WRONG = "file string, size long, k long, want long, behind array<struct<k:long,lo:long,hi:long,entry:long>>"


def _guess(data: np.ndarray, lo: int, size: int, most: int) -> int | None:
    """The first place in the bytes from lo on (a file of `size` bytes) from which frames of a possible length, with a key flag of 0 or 1, follow one another."""
    n = len(data) - HEAD_SIZE
    if n < 0:
        return None
    at = np.arange(n + 1)
    length = sum(data[SIZE_AT + k : SIZE_AT + k + n + 1].astype(np.int64) << (8 * k) for k in range(4))
    nxt = at + HEAD_SIZE + length
    good = (data[9 : 9 + n + 1] <= 1) & (length <= most) & (lo + nxt <= size)
    reach, ok = nxt, good
    for _ in range(FOLLOW - 1):
        inside = reach <= n
        here = np.where(inside, reach, 0)
        ok = ok & (~inside | good[here])
        reach = np.where(inside & ok, nxt[here], reach)
    hit = np.flatnonzero(ok)
    return lo + int(hit[0]) if len(hit) else None


def _chain(f, entry: int, hi: int, size: int, most: int) -> tuple[int, int]:
    """Frames that begin from entry on and before hi, and where the next one begins; a frame that is too long or cut is the file's last row."""
    at, n = entry, 0
    block, start = b"", 0
    while at < hi:
        if at + HEAD_SIZE > size:
            return n + 1, size
        if not start <= at <= start + len(block) - HEAD_SIZE:
            f.seek(at)
            block, start = f.read(LOOK), at
        length = int.from_bytes(block[at - start + SIZE_AT : at - start + HEAD_SIZE], "little")
        n += 1
        at += HEAD_SIZE + length
        if length > most or at > size:
            return n, size
    return n, at


def _guessed(most: int):
    """Each range's entry guessed, and its chain followed from there."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, size, k, lo, hi in batch[_names(RANGES)].itertuples(index=False):
                with open_file(file) as f:
                    f.seek(lo)
                    entry = 0 if k == 0 else _guess(np.frombuffer(f.read(min(LOOK, size - lo)), np.uint8), lo, size, most)
                    out.append((file, size, k, lo, hi, *_range(f, entry, hi, size, most)))
            yield _frame(out, CHAINED)

    return go


def _range(f, entry: int | None, hi: int, size: int, most: int) -> tuple:
    """Entry, frames and exit of a range."""
    if entry is None or entry >= hi:
        return None, 0, None
    return entry, *_chain(f, entry, hi, size, most)


def _mended(most: int):
    """Ranges that guessed wrong followed from where they should begin, and on through the ranges behind them until one guessed what is found."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, size, k, want, behind in batch.itertuples(index=False):
                at = int(want)
                with open_file(file) as f:
                    for r in behind:
                        entry = at if at < r["hi"] else None
                        if r["k"] > k and entry == r["entry"]:
                            break
                        entry, n, end = _range(f, entry, r["hi"], size, most)
                        at = at if end is None else end
                        out.append((file, size, r["k"], r["lo"], r["hi"], entry, n, end, k))
            yield _frame(out, f"{CHAINED}, source long")

    return go


def _wrong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrong ranges of files whose ranges come in order, file after file; the ranges of one file are held at a time."""
    name, size, held = None, 0, []
    for batch in batches:
        out = []
        for file, length, *r in zip(*(batch[c] for c in ("file", "size", "k", "lo", "hi", "entry", "exit"))):
            if file != name:
                out += _wrong_of(name, size, held)
                name, size, held = file, length, []
            held.append(r)
        yield pd.DataFrame(out, columns=_names(WRONG))
    yield pd.DataFrame(_wrong_of(name, size, held), columns=_names(WRONG))


def _wrong_of(file: str, size: int, rows: list) -> list[tuple]:
    """Ranges of a file whose entry is not where the ranges before lead, with where that is and the ranges from there on. Where a wrong range leads is not
    known yet, so the next one's guess stands until the next pass."""
    at, out = 0, []
    held = [{"k": int(k), "lo": int(lo), "hi": int(hi), "entry": None if pd.isna(e) else int(e)} for k, lo, hi, e, _ in rows]
    for i, (r, (*_, end)) in enumerate(zip(held, rows)):
        known = at is not None
        want = r["entry"] if not known else at if at < r["hi"] else None
        if known and want != r["entry"]:
            out.append((file, int(size), r["k"], at, held[i : i + BEHIND]))
            at = None
        elif r["entry"] is not None:
            at = int(end)
    return out


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_names(schema)).astype({"entry": "Int64", "exit": "Int64"})


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def wire_ranges(spark: SparkSession, path: str, most: int, range_bytes: int) -> DataFrame:
    """The ranges of wire files with the frames that begin in each. A range's entry is guessed from its own bytes, so all ranges are followed at once; what
    a range's predecessors lead to tells whether the guess was right. From a wrong one frames are followed again, through the ranges behind it until one had guessed right;
    this is repeated until all are right. The first range's entry is certain and each pass makes at least one more of a file certain, two passes nearly always all. Only a row
    a range is gathered by file."""
    found = [f for f in files_of(path) if f[1]]
    ranges, size = sum(-(-size // range_bytes) for _, size in found), sum(size for _, size in found)
    tasks = max(1, min(ranges, max(spark.sparkContext.defaultParallelism, size // TASK, ranges // TASK_RANGES)))
    plan = spark.createDataFrame(found, "file string, size long").select("file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("k", "lo"))
    plan = plan.select("file", "size", F.col("k").cast("long").alias("k"), "lo", F.least("size", F.col("lo") + range_bytes).alias("hi"))
    made = written(plan.repartition(tasks, "file", "k").mapInPandas(_guessed(most), CHAINED), "wire-ranges")
    while True:
        wrong = written(made.select("file", "size", "k", "lo", "hi", "entry", "exit").repartition("file").sortWithinPartitions("file", "k").mapInPandas(_wrong, WRONG), "wire-wrong")
        if wrong.isEmpty():
            return made
        again = wrong.repartition(tasks, "file", "k").mapInPandas(_mended(most), f"{CHAINED}, source long")
        every = again.unionByName(made.withColumn("source", F.lit((1 << 62)).cast("long")))
        # of several accounts of a range the one from the earliest wrong range counts, of none its own
        best = every.groupBy("file", "k").agg(F.min_by(F.struct(*[c for c in _names(CHAINED) if c not in ("file", "k")]), "source").alias("r"))
        made = written(best.select("file", "k", "r.*").select(*_names(CHAINED)), "wire-ranges")


FRAME = "file string, idx long, track int, pts long, keyframe boolean, duration_ns long, data binary, error string"


def read_wire(spark: SparkSession, path: str, most: int, range_bytes: int) -> DataFrame:
    """file, idx, track, pts, keyframe, duration_ns, data and error of the frames of wire files: a file that ends inside a frame, or has one of over `most` bytes, ends with
    an error row. A task reads the frames that begin in its range, some of which end in the next; it holds a block of bytes and some frames."""
    before = W.partitionBy("file").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    ranges = wire_ranges(spark, path, most, range_bytes).filter("frames > 0").withColumn("first", F.coalesce(F.sum("frames").over(before), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # frames of small ranges are handed on together
        rows, held = [], 0
        for batch in batches:
            for file, size, entry, hi, first in batch.itertuples(index=False):
                at, error = int(entry), None
                with open_file(file) as f:
                    f.seek(at)
                    while at < hi and error is None:
                        head = f.read(HEAD_SIZE)
                        track = pts = key = duration = data = None
                        if len(head) < HEAD_SIZE:
                            error = "truncated header"
                        else:
                            track, pts, key, duration, length = struct.unpack(HEAD, head)
                            if length > most:
                                error = "too long"
                            elif at + HEAD_SIZE + length > size:
                                error = "truncated data"
                            else:
                                data = f.read(length)
                                at += HEAD_SIZE + length
                        if error:
                            rows.append((file, first, None, None, None, None, None, error))
                        else:
                            rows.append((file, first, track, pts, bool(key), None if duration == NO_DURATION else duration, data, None))
                            held += length
                        first += 1
                        if held >= HELD or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=_names(FRAME), dtype=object)
                            rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_names(FRAME), dtype=object)

    return ranges.select("file", "size", "entry", "hi", "first").repartition("file", "entry").mapInPandas(read, FRAME)
