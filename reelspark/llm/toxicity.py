"""Toxicity: a linear-chain conditional random field tags toxic words; marginals give document scores and offending offsets."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import read, saved, text_or_empty

WORD = re.compile(r"\w+")
#: Labelled rows that are learned from at most, those with the smallest hash of their id; a quarter of them fits the document score, the rest the tagger.
SAMPLE, QUARTERS = 8000, 4
#: Words and beginnings of words taken for marks of toxic text at most: those that tell best.
CUES = 4096
#: A mark occurs in as many toxic texts at least, so much oftener than by chance (in deviations), and mostly there.
CUE_TEXTS, CUE_DEVIATIONS, CUE_SHARE = 4, 5.0, 0.5
#: Words of a training window, and windows of a text at most: around its marks, and elsewhere.
WINDOW, AT_CUES, ELSEWHERE = 24, 12, 6
PREFIXES, SUFFIX, DIMENSIONS = (3, 4, 5, 6, 7), 3, 1 << 17
#: Words of a block of the forward and backward passes; characters worked on at once; words remembered with their scores.
BLOCK, SLICE, REMEMBERED = 64, 1_000_000, 500_000
SUMMARY = 5


def stems(word: str) -> list[str]:
    """The word in lower case and its beginnings, by which marks are counted."""
    low = word.lower()
    return [low, *[f"{low[:k]}*" for k in PREFIXES if len(low) > k]]


def word_features(word: str) -> list[str]:
    """What the tagger sees of a word: itself, its beginnings and end, its length and whether it is in capitals or of letters only."""
    low = word.lower()
    shape = f"h{'A' if word.isupper() else 'a'}{'' if word.isalpha() else '0'}{min(len(word), 12)}"
    return ["b", f"w{low}", *[f"p{low[:k]}*" for k in PREFIXES if len(low) > k], f"s{low[-SUFFIX:]}", shape]


def _slots(names: list[str]) -> list[int]:
    crc = zlib.crc32
    return [crc(n.encode("utf-8", "replace")) % DIMENSIONS for n in names]


def own_slots(word: str) -> list[int]:
    return _slots(word_features(word))


def beside_slots(word: str, side: str) -> list[int]:
    """Features that a word gives to the one after it ("<") or before it (">")."""
    return _slots([f"{side}{word.lower()}"])


def chain_marginals(e: np.ndarray, first: np.ndarray, m: dict[str, np.ndarray], block: int = BLOCK) -> np.ndarray:
    """Probability that each word is toxic, for many texts in one chain: e holds the words' scores (toxic over clean), first marks where a text starts.

    Forward and backward odds each follow a map x -> (a + b x) / (c + d x) a word. Maps are multiplied inside blocks of words, all blocks
    at once; then the blocks' maps are applied one after the other, and the blocks are gone through again from where each starts."""
    n = len(e)
    if not n:
        return np.zeros(0)
    g = np.exp(np.clip(e, -30, 30))
    a00, a01, a10, a11 = np.exp(m["T"]).ravel()
    s0, s1 = np.exp(m["S"])
    one = np.ones(n)
    # forward: odds[t] = g[t] * (a01 + a11 * x) / (a00 + a10 * x) of the odds x before, or g[t] * s1 / s0 at a start
    ahead = _odds(np.where(first, g * s1, g * a01), np.where(first, 0.0, g * a11), np.where(first, s0, a00) * one, np.where(first, 0.0, a10), block)
    # backward: odds[t] = (a10 + a11 * y) / (a00 + a01 * y), y = g[t+1] * odds[t+1], or 1 at an end
    last, nxt = np.append(first[1:], True), np.append(g[1:], 1.0)
    back = _odds(*[np.where(last, end, value)[::-1] for end, value in ((1.0, a10), (0.0, a11 * nxt), (1.0, a00), (0.0, a01 * nxt))], block)[::-1]
    odds = ahead * back
    return odds / (1 + odds)


def _odds(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, block: int) -> np.ndarray:
    """x[t] = (a[t] + b[t] x[t-1]) / (c[t] + d[t] x[t-1]) from any x[-1]; the first map is constant."""
    n = len(a)
    rows = -(-n // block)
    lay = lambda v, fill: np.concatenate([v, np.full(rows * block - n, fill)]).reshape(rows, block).T.copy()
    a, b, c, d = lay(a, 0.0), lay(b, 1.0), lay(c, 1.0), lay(d, 0.0)
    p, q, r, s = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
    for t in range(1, block):
        p, q, r, s = a[t] * r + b[t] * p, a[t] * s + b[t] * q, c[t] * r + d[t] * p, c[t] * s + d[t] * q
        scale = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    entry, x = np.empty(rows), 1.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        entry[k] = x
        x = (pk + qk * x) / (rk + sk * x)
    out, x = np.empty((block, rows)), entry
    for t in range(block):
        x = (a[t] + b[t] * x) / (c[t] + d[t] * x)
        out[t] = x
    return out.T.ravel()[:n]


#: Windows that are gone through at once while training.
AT_ONCE = 8192


def train_tagger(windows: list[tuple[str, str]], epochs: int = 60, rate: float = 0.15, decay: float = 3e-4) -> dict[str, np.ndarray]:
    """Weights W of features, T of neighbouring tags and S of the first, by the likelihood of the windows' tags (Adam, all windows a step).
    A window: its words, parted by blanks, and as many tags, 1 where a word is toxic. Features are looked up a distinct word, so scores and slopes of the many words of windows are
    gathered from, and summed to, the words they are."""
    n, size = len(windows), max((len(y) for _, y in windows), default=1)
    known: dict[str, int] = {}
    ids, tag, inside = np.zeros((size, n), np.int32), np.zeros((size, n), bool), np.zeros((size, n), bool)
    for i, (words, y) in enumerate(windows):
        k = len(y)
        ids[:k, i] = [known.setdefault(w, len(known)) for w in words.split(" ")]
        tag[:k, i], inside[:k, i] = [c == "1" for c in y], True
    # a word's features, filled up with one beyond all that weighs nothing
    own = np.full((len(known), len(word_features("a")) + len(PREFIXES)), DIMENSIONS, np.int32)
    for word, k in known.items():
        slots = own_slots(word)
        own[k, : len(slots)] = slots
    after, before = (np.array([beside_slots(w, side)[0] for w in known], np.int32) for side in "<>")
    m = {"W": np.zeros(DIMENSIONS + 1), "T": np.zeros((2, 2)), "S": np.zeros(2)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    total, v = max(1, int(inside.sum())), len(known)
    joint = inside[1:]
    seen = np.array([[(joint & (tag[:-1] == i) & (tag[1:] == j)).sum() for j in (False, True)] for i in (False, True)], float)
    firsts = np.array([(~tag[0]).sum(), tag[0].sum()], float)
    for step in range(1, epochs + 1):
        w = m["W"]
        score, add_after, add_before = w[own].sum(1), w[after], w[before]
        slopes, pair, begin = np.zeros((3, v)), np.zeros((2, 2)), 0.0
        for lo in range(0, n, AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            words, there, both = ids[:, part], inside[:, part], inside[1:, part]
            e = score[words]
            e[1:] += add_after[words[:-1]]
            e[:-1] += np.where(both, add_before[words[1:]], 0)
            single, pairs = _windows(e, there, m)
            wrong = single - tag[:, part]
            slopes[0] += np.bincount(words[there], wrong[there], v)
            slopes[1] += np.bincount(words[:-1][both], wrong[1:][both], v)
            slopes[2] += np.bincount(words[1:][both], wrong[:-1][both], v)
            pair, begin = pair + pairs, begin + single[0].sum()
        by_slot = np.bincount(own.ravel(), np.repeat(slopes[0], own.shape[1]), DIMENSIONS + 1) + np.bincount(after, slopes[1], DIMENSIONS + 1) + np.bincount(before, slopes[2], DIMENSIONS + 1)
        by_slot[DIMENSIONS] = 0
        for k, g in {"W": by_slot, "T": pair - seen, "S": np.array([n - begin, begin]) - firsts}.items():
            slope = g / total + decay * m[k] / 100
            one, two = moments[k]
            one += 0.1 * (slope - one)
            two += 0.01 * (slope * slope - two)
            m[k] = m[k] - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-7)
    return {"W": m["W"][:DIMENSIONS], "T": m["T"], "S": m["S"]}


def _windows(e: np.ndarray, inside: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word and expected pairs of tags of windows laid side by side (word, window), by forward and backward passes."""
    size, n = e.shape
    emit = np.stack([np.zeros_like(e), e], 2)
    ahead, back = np.zeros((size, n, 2)), np.zeros((size, n, 2))
    ahead[0] = m["S"] + emit[0]
    for t in range(1, size):
        step = np.logaddexp(ahead[t - 1, :, 0, None] + m["T"][0], ahead[t - 1, :, 1, None] + m["T"][1]) + emit[t]
        ahead[t] = np.where(inside[t][:, None], step, ahead[t - 1])
    for t in range(size - 2, -1, -1):
        y = emit[t + 1] + back[t + 1]
        step = np.logaddexp(m["T"][:, 0] + y[:, 0, None], m["T"][:, 1] + y[:, 1, None])
        back[t] = np.where(inside[t + 1][:, None], step, back[t + 1])
    log_z = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    single = np.where(inside, np.exp(np.minimum(ahead[:, :, 1] + back[:, :, 1] - log_z, 0)), 0)
    pair = np.zeros((2, 2))
    for t in range(1, size):
        for i in (0, 1):
            for j in (0, 1):
                pair[i, j] += np.exp(np.minimum(ahead[t - 1, :, i] + m["T"][i, j] + emit[t, :, j] + back[t, :, j] - log_z, 0))[inside[t]].sum()
    return single, pair


class Tagger:
    """Scores of words by a model's weights, remembered word by word, and marginals of whole texts."""

    def __init__(self, m: dict[str, np.ndarray]) -> None:
        self.m, self.weights = m, m["W"].tolist()
        self.at: dict[str, int] = {}
        self.scores = array("d")

    def _learn(self, words: set[str]) -> None:
        """Scores of new words: their own, and what they add to the word after and the word before."""
        w = self.weights
        for word in words:
            self.at[word] = len(self.scores) // 3
            (after,), (before,) = beside_slots(word, "<"), beside_slots(word, ">")
            self.scores.extend((sum([w[k] for k in own_slots(word)]), w[after], w[before]))

    def marginals(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[str]]]:
        """For each text the marginals of its words, and the words."""
        if len(self.at) > REMEMBERED:
            self.at, self.scores = {}, array("d")
        words = [WORD.findall(t) for t in texts]
        self._learn({w for ws in words for w in set(ws)} - self.at.keys())
        counts = np.array([len(w) for w in words])
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if not len(ids):
            return [np.zeros(0) for _ in texts], words
        table = np.array(self.scores).reshape(-1, 3)
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        e = table[ids, 0]
        e[1:] += np.where(first[1:], 0, table[ids[:-1], 1])
        e[:-1] += np.where(first[1:], 0, table[ids[1:], 2])
        return np.split(chain_marginals(e, first, self.m), np.cumsum(counts)[:-1]), words


def summary(p: np.ndarray) -> list[float]:
    """What the document score sees of a text's marginals: a constant, the chance of any toxic word, their expected number, the largest
    marginal and the expected share of the words."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    q = np.minimum(p, 1 - 1e-9)
    return [1.0, float(1 - np.exp(np.log1p(-q).sum())), float(np.log1p(p.sum())), float(p.max()), float(np.sqrt(p.mean()))]


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets of the words whose marginal is a half or more, neighbours as one span."""
    if not len(p) or p.max() < 0.5:
        return []
    out, after = [], False
    for q, w in zip(p, WORD.finditer(text)):
        if q >= 0.5:
            if after:
                out[-1] = (out[-1][0], w.end())
            else:
                out.append(w.span())
        after = q >= 0.5
    return out


def _slices(texts: list[str]) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > SLICE:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _cues(rows: DataFrame, toxic: int, clean: int) -> set[str]:
    """Words and beginnings that occur mostly in toxic texts of rows (toxic, text), counted once a text by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (Counter(), Counter())
            for y, text in zip(batch["toxic"], batch["text"]):
                found[y].update({s for w in set(WORD.findall(text)) for s in stems(w)})
            names = list(found[0].keys() | found[1].keys())
            yield pd.DataFrame({"stem": names, "clean": [found[0][x] for x in names], "toxic": [found[1][x] for x in names]})

    base = toxic / (toxic + clean)
    c = rows.mapInPandas(count, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = F.col("clean") + F.col("toxic")
    z = (F.col("toxic") - n * base) / F.sqrt(n * base * (1 - base))
    c = c.filter((F.col("toxic") >= CUE_TEXTS) & (z >= CUE_DEVIATIONS) & (F.col("toxic") >= CUE_SHARE * n))
    return {r["stem"] for r in c.orderBy(z.desc(), "stem").limit(CUES).collect()}


def _training_windows(rows: DataFrame, cues: set[str]) -> list[tuple[str, str]]:
    """Windows of words with their tags: a word is toxic if the text is and the word is a mark. Around marks (in clean texts too) and at places that the text's
    hash picks; a bounded number a text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, text in zip(batch["toxic"], batch["text"]):
                words = WORD.findall(text)
                hit = [any(s in cues for s in stems(w)) for w in words]
                rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
                marks = np.flatnonzero(hit)
                near = rng.permutation(marks)[:AT_CUES] - rng.integers(0, WINDOW, min(len(marks), AT_CUES))
                far = rng.integers(0, max(1, len(words) - WINDOW + 1), ELSEWHERE)
                for at in sorted({max(0, int(x)) // WINDOW * WINDOW if len(words) > 4 * WINDOW else 0 for x in (*near, *far)}):
                    part = slice(at, at + WINDOW)
                    if words[part]:
                        out.append((" ".join(w[:64] for w in words[part]), "".join("1" if y and h else "0" for h in hit[part])))
            yield pd.DataFrame(out, columns=["words", "tags"])

    got = rows.mapInPandas(cut, "words string, tags string").toArrow()
    return sorted(zip(got["words"].to_pylist(), got["tags"].to_pylist()))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic score by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + decay * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (p - y) + decay * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> dict[str, np.ndarray] | None:
    """A model from at most `sample` labelled rows, fold 0 (crc32 of the id as text) left out; None where they hold fewer than two
    classes. Only texts are learned from. An id labelled twice counts once, as toxic if any of its labels says so; of texts with the same id each counts.

    Marks of toxic texts are counted first; words of toxic texts that are marks are the labelled words on which the tagger is trained, in
    three quarters of the rows; the document score is fit on the marginals of the last quarter. To the driver come the marks, a bounded number of windows a row, and
    a few numbers a row."""
    learn = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    chosen = learn.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = saved(rows.select("toxic", "text", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(QUARTERS)) == 0).alias("second")), "toxicity-sample")
    of = {(r["second"], r["toxic"]): r["n"] for r in rows.groupBy("second", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = of.get((False, 1), 0), of.get((False, 0), 0)
    if not toxic or not clean:
        return None
    tagged, scored = rows.filter("NOT second"), rows.filter("second")
    cues = _cues(tagged, toxic, clean)
    m = train_tagger(_training_windows(tagged, cues))
    if not of.get((True, 1)) or not of.get((True, 0)):
        scored = rows

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(m)
        for batch in batches:
            texts, y = batch["text"].tolist(), batch["toxic"].tolist()
            for part in _slices(texts):
                yield pd.DataFrame({"toxic": y[part], "x": [summary(p) for p in tagger.marginals(texts[part])[0]]})

    got = sorted((r["toxic"], list(r["x"])) for r in scored.mapInPandas(summed, "toxic int, x array<double>").collect())
    x, y = np.array([r[1] for r in got]), np.array([r[0] for r in got], float)
    return m | {"doc": fit_logistic(x, y)}


TAGGED = "doc_id long, score double, n_words long, spans array<struct<start:long,end:long>>"


def tag_toxic(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, score (0 to 1: how likely the text is toxic), n_words and spans (code points, end exclusive) of the words tagged as toxic, of every row of docs
    (doc_id, text). Whole texts are tagged; null counts as empty, which has no words and the score of a text without toxic ones. Rows with a
    null or repeated id are scored each, further columns are not read, an empty table gives none. Without a model every score is 0.5."""

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model) if model else None
        for batch in batches:
            texts = batch["text"].tolist()
            ids = batch["doc_id"].astype("Int64")
            for part in _slices(texts):
                if tagger is None:
                    yield pd.DataFrame({"doc_id": ids[part], "score": 0.5, "n_words": [len(WORD.findall(t)) for t in texts[part]], "spans": [[] for _ in texts[part]]})
                    continue
                p = tagger.marginals(texts[part])[0]
                score = 1 / (1 + np.exp(-np.clip(np.array([summary(x) for x in p]) @ model["doc"], -30, 30)))
                spans = [[{"start": a, "end": b} for a, b in spans_of(t, x)] for t, x in zip(texts[part], p)]
                yield pd.DataFrame({"doc_id": ids[part], "score": score, "n_words": [len(x) for x in p], "spans": spans})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInPandas(tag, TAGGED)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = tag_toxic(docs, fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLE: dict[str, str] = {}
