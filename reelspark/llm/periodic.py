"""Periodic runs of words: catchers over completed power-of-two blocks, advanced as words are appended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import WHITE_CLASS, read, text_or_empty

#: A run has at least that many words and that many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: log2 of the words of the smallest blocks, whose catchers watch all periods below twice their size. A run of LEAST_WORDS holds such a
#: block and its repetition for every period up to 8; from there on LEAST_PERIODS does.
FIRST = 3
#: Words appended at once at most: bounds what a long text needs besides its words.
PIECE = 1 << 16
#: Characters of texts worked on before rows are handed back.
SLICE = 4_000_000


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class SquareCatchers:
    """Repetitions in a growing sequence of whole numbers (words).

    When a block of 2**k words is complete its catcher starts; it watches the words that follow until 2**(k+1) after the block's start,
    and catches every place where the last 2**k words equal the block, by fingerprints: a suffix that repeats at a distance q from 2**k to
    2**(k+1)-1 (from 1 at the smallest level). A catch is checked on the words themselves and grows both ways into a stretch in which words q apart
    are equal; a stretch at the end of what was appended stays open and goes on with the next words. Catches of one stretch merge, and one inside
    a stretch of a period of at most 2**k is a repetition of that one. State: the words, the stretches, a catcher a block, 2**k fingerprints a level."""

    def __init__(self) -> None:
        self.words, self.n = np.zeros(64, np.int64), 0
        self.tails: list[np.ndarray] = []
        self.catchers: list[np.ndarray] = []
        self.open: list[list[int]] = []  # start, end and period of stretches that end where the words end
        self.latest: dict[int, list[int]] = {}  # the last stretch of each period
        self.stretches: list[list[int]] = []

    def append(self, words: np.ndarray) -> None:
        for k in range(0, len(words), PIECE):
            self._append(words[k : k + PIECE])

    def _append(self, words: np.ndarray) -> None:
        old, n = self.n, self.n + len(words)
        if n > len(self.words):
            grown = max(n, 2 * len(self.words))
            self.words = np.concatenate([self.words[:old], np.zeros(grown - old, np.int64)])
        self.words[old:n], self.n = words, n
        going, self.open = self.open, []
        for stretch in going:
            self._onward(stretch)
        at, prints = old, _mixed(words.astype(np.uint64), np.uint64(1))
        k = 0
        while len(prints):
            if k >= FIRST:
                self._catch(k, at, prints)
            if k == len(self.tails):
                self.tails.append(prints[:0])
            whole = np.concatenate([self.tails[k], prints]) if len(self.tails[k]) else prints
            self.tails[k] = whole[-(1 << k) :].copy()
            start, size = at - (len(whole) - len(prints)), 1 << k
            at = max(0, old - 2 * size + 1)
            count = n - 2 * size + 1 - at
            if count <= 0:
                break
            lo = at - start
            prints, k = _mixed(whole[lo : lo + count], whole[lo + size : lo + size + count]), k + 1

    def _catch(self, k: int, at: int, prints: np.ndarray) -> None:
        """Compares the suffixes that start at `at` and after with the blocks whose catchers watch them."""
        level, size = k - FIRST, 1 << k
        if level == len(self.catchers):
            self.catchers.append(prints[:0])
        blocks = self.catchers[level] = np.concatenate([self.catchers[level], prints[-at % size :: size]])
        starts = np.arange(at, at + len(prints))
        caught = []
        for back in (1, 0) if k == FIRST else (1,):
            block = (starts >> k) - back
            seen = int(np.searchsorted(block, 0))
            hit = np.flatnonzero(prints[seen:] == blocks[block[seen:]]) + seen
            caught.append(np.stack([block[hit] << k, starts[hit]]))
        b, s = np.concatenate(caught, axis=1)
        if len(b):
            free = self._free(b, s + size, self._cover(size))
            b, s = b[free], s[free]
        if not len(b):
            return
        order = np.lexsort((b, s - b))
        b, q = b[order], (s - b)[order]
        cuts = np.searchsorted(q, np.unique(q[q > 0]))
        known, cover = -1, None
        for lo, hi in zip(cuts, [*cuts[1:], len(q)]):
            if known != len(self.stretches):
                known, cover = len(self.stretches), self._cover(size)
            self._caught(b[lo:hi], int(q[lo]), size, cover)

    def _cover(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the stretches of a period of at most `most`, and how far those that start there or before go."""
        held = np.array([x[:2] for x in self.stretches if x[2] <= most], np.int64).reshape(-1, 2)
        held = held[held[:, 0].argsort()]
        return held[:, 0], np.maximum.accumulate(held[:, 1]) if len(held) else held[:, 1]

    @staticmethod
    def _free(lo: np.ndarray, hi: np.ndarray, cover: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which of the spans from lo to hi are in no stretch of the cover."""
        starts, ends = cover
        if not len(starts):
            return np.ones(len(lo), bool)
        before = np.searchsorted(starts, lo, "right") - 1
        return (before < 0) | (ends[before] < hi)

    def _caught(self, blocks: np.ndarray, q: int, size: int, cover: tuple[np.ndarray, np.ndarray]) -> None:
        """Grows the catches of one period, but those inside a stretch of a smaller one or of this one."""
        blocks, i = blocks[self._free(blocks, blocks + q + size, cover)], 0
        while i < len(blocks):
            b, held = int(blocks[i]), self.latest.get(q)
            if not (held and held[0] <= b and b + q + size <= held[1]):
                held = self._grown(b, q, size)
            i = max(i + 1, int(np.searchsorted(blocks, held[1] - q - size, "right"))) if held else i + 1

    def _grown(self, b: int, q: int, size: int) -> list[int] | None:
        words = self.words
        if not np.array_equal(words[b : b + size], words[b + q : b + q + size]):
            return None
        start, step = b, 32
        while start:
            lo = max(0, start - step)
            differs = np.flatnonzero(words[lo:start] != words[lo + q : start + q])
            if len(differs):
                start = lo + int(differs[-1]) + 1
                break
            start, step = lo, step * 4
        held = [start, b + size + q, q]
        self.stretches.append(held)
        self._onward(held)
        return held

    def _onward(self, stretch: list[int]) -> None:
        """Goes on with a stretch as far as the words do; there it stays open, else it is done."""
        start, end, q = stretch
        words, step = self.words, 32
        while end < self.n:
            hi = min(self.n, end + step)
            differs = words[end:hi] != words[end - q : hi - q]
            first = int(differs.argmax())
            if differs[first]:
                end += first
                break
            end, step = hi, step * 4
        stretch[1] = end
        self.latest[q] = stretch
        if end == self.n:
            self.open.append(stretch)

    def runs(self) -> list[tuple[int, int, int]]:
        """Start, length and smallest period of every run, by start and period."""
        best: dict[tuple[int, int], int] = {}
        for start, end, q in self.stretches:
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                best[start, end] = min(q, best.get((start, end), q))
        return sorted((s, e - s, q) for (s, e), q in best.items())


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Runs of a list of words."""
    if len(words) < LEAST_WORDS:
        return []
    ids = dict(zip(dict.fromkeys(words), range(len(words))))
    catchers = SquareCatchers()
    catchers.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that repeat: in a run only the first period stays."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, q in runs:
        gone[start + q : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone)])


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, smallest period; in words, by start and period) and the text with each run cut to its first period,
    its words joined by one space, of every row of docs (doc_id, text).

    Words are what ASCII white space separates. A run is a stretch of at least 24 words and three periods that no neighbour extends. Null texts are empty:
    no words, no runs. Rows with a null or repeated id are worked on each; an empty table gives none; further columns are not read. Rows stay in their tasks,
    and a text needs memory in proportion to its words."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = text.encode("utf-8", "replace").split()
                runs = runs_of(words)
                out.append((None if pd.isna(doc_id) else int(doc_id), len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed(words, runs).decode()))
                held += len(text)
                if held >= SLICE:
                    yield _frame(out)
                    out, held = [], 0
            if out:
                yield _frame(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInPandas(scan, RUNS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"]).astype({"doc_id": "Int64"})


def _bound(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which every tenth document, by the crc32 of its id, repeats from some word on: word i >= a becomes word a+(i-a)%p. What decides
    and a, p: see the query's contract. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, _bound(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))).otherwise("")

    words = F.filter(F.split("text", f"{WHITE_CLASS}+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, _bound(words, repeated)).otherwise(F.col("text")).alias("text"))


def best_run(runs: Column) -> Column:
    """The run of the greatest exact length/period, ties by the smallest start, then period; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    found = periodic_runs(with_planted_runs(docs)).withColumn("_best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE: dict[str, str] = {}
