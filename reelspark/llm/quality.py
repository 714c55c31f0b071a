"""Quality classifier: gated attention over passages (multiple-instance learning), trained on a bounded sample of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import fresh, read, text_or_empty

#: Bytes of a passage; a text's last passage may be shorter.
PASSAGE = 1024
#: Labelled rows that a model is fit on at most, those with the smallest hash of their id.
SAMPLE = 4000
#: Bytes of texts and passages worked on at once inside a task.
SLICE, PASSAGES = 1_000_000, 512
BIGRAMS, TRIGRAMS, HIDDEN = 96, 2048, 24


def _classes() -> np.ndarray:
    """Class of each byte: letters, capitals, digits, space, newline, further bytes, and each ASCII mark by itself."""
    out, marks = np.zeros(256, np.int64), 7
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 0
        elif c.islower():
            out[b] = 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c == " ":
            out[b] = 4
        elif c == "\n":
            out[b] = 5
        elif b < 32 or b == 127:
            out[b] = 6
        else:
            out[b], marks = marks, marks + 1
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES + BIGRAMS + 6


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text (one at least). Passages are worked on some
    hundred at a time, however many or long the texts are."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    held = [t[k : k + PASSAGE] for t in texts for k in range(0, max(len(t), 1), PASSAGE)]
    made = [_features(held[k : k + PASSAGES]) for k in range(0, len(held), PASSAGES)]
    return np.vstack(made) if made else np.zeros((0, N_FEATURES), np.float32), counts


def _features(passages: list[bytes]) -> np.ndarray:
    n = len(passages)
    sizes = np.array([len(p) for p in passages], np.int64)
    data = np.frombuffer(b"".join(passages), np.uint8)
    passage = np.repeat(np.arange(n), sizes)
    length = sizes.astype(np.float64)
    safe = np.maximum(length, 1)[:, None]
    kinds = CLASSES[data]
    share = np.bincount(passage * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / safe
    codes = data.astype(np.int64)
    inside = passage[1:] == passage[:-1]
    pairs = ((codes[:-1] * 131 + codes[1:]) * 2654435761 >> 12) % BIGRAMS
    bi = np.bincount((passage[:-1] * BIGRAMS + pairs)[inside], minlength=n * BIGRAMS).reshape(n, BIGRAMS) / safe
    inside3 = passage[2:] == passage[:-2]
    three = ((codes[:-2] * 16777619 + codes[1:-1] * 65599 + codes[2:] * 131) * 2654435761 >> 11) % TRIGRAMS
    tri = np.bincount((passage[:-2] * TRIGRAMS + three)[inside3], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    total = np.maximum(tri.sum(1), 1)
    distinct = (tri > 0).sum(1) / np.minimum(total, TRIGRAMS)
    peak = np.sqrt((tri.astype(np.float64) ** 2).sum(1)) / total
    words = share[:, 4] + share[:, 5]
    extra = np.stack([distinct, peak, tri.max(1, initial=0) / total, words, np.log1p(length) / 8, share[:, 7:].sum(1)], 1)
    return np.hstack([np.sqrt(share), np.sqrt(bi), extra]).astype(np.float32)


def _slices(sizes: list[int], limit: int = SLICE) -> Iterator[slice]:
    start, held = 0, 0
    for i, s in enumerate(sizes):
        if i > start and held + s > limit:
            yield slice(start, i)
            start, held = i, 0
        held += s
    if start < len(sizes):
        yield slice(start, len(sizes))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple:
    """x: standardised passages; at: the first passage of each text."""
    v, u = np.tanh(x @ m["V"] + m["bv"]), 1 / (1 + np.exp(-(x @ m["U"] + m["bu"])))
    e = (v * u) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
    a = e / np.repeat(np.add.reduceat(e, at), counts)
    z = np.add.reduceat(x * a[:, None], at, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30)))
    return v, u, a, z, p


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = 120, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Gated-attention weights and a linear score of the weighted passage, fit together by Adam on all texts at once."""
    rng = np.random.default_rng(seed)
    mean, std = features.mean(0), features.std(0) + 1e-3
    x = np.clip((features - mean) / std, -6, 6).astype(np.float32)
    d = x.shape[1]
    m = {
        "V": rng.normal(0, 0.1, (d, HIDDEN)), "bv": np.zeros(HIDDEN), "U": rng.normal(0, 0.1, (d, HIDDEN)), "bu": np.zeros(HIDDEN),
        "w": rng.normal(0, 0.1, HIDDEN), "c": np.zeros(d), "b": np.array(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    at, n = np.cumsum(counts) - counts, len(counts)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    for step in range(1, epochs + 1):
        v, u, a, z, p = _forward(m, x, at, counts)
        d_out = ((p - labels) / n).astype(np.float32)
        d_z = d_out[:, None] * m["c"]
        d_a = (x * np.repeat(d_z, counts, axis=0)).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, at), counts))
        d_v, d_u = d_e[:, None] * (m["w"] * u) * (1 - v * v), d_e[:, None] * (m["w"] * v) * u * (1 - u)
        g = {"V": x.T @ d_v, "bv": d_v.sum(0), "U": x.T @ d_u, "bu": d_u.sum(0), "w": (v * u).T @ d_e, "c": z.T @ d_out, "b": d_out.sum()}
        for k in m:
            slope = g[k] + decay * m[k] * (m[k].ndim > 0 and k in ("V", "U", "c", "w"))
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope * slope
            m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m | {"mean": mean, "std": std}


def score_texts(m: dict[str, np.ndarray], texts: list[str]) -> np.ndarray:
    out = []
    for part in _slices([len(t) for t in texts]):
        f, counts = passage_features([t.encode("utf-8", "replace") for t in texts[part]])
        x = np.clip((f - m["mean"]) / m["std"], -6, 6).astype(np.float32)
        out.append(_forward(m, x, np.cumsum(counts) - counts, counts)[-1])
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> dict[str, np.ndarray] | None:
    """A model from at most `sample` labelled rows, fold 0 (crc32 of the id as text) left out; None where the labels
    hold fewer than two classes. Only the sample's ids are broadcast, and only its features reach the driver."""
    learn = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    chosen = learn.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode("utf-8", "replace") for t in batch["text"]]
            for part in _slices([len(t) for t in texts]):
                f, counts = passage_features(texts[part])
                cuts = np.split(f, np.cumsum(counts)[:-1])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part], "quality": batch["quality"].iloc[part], "passages": [c.tobytes() for c in cuts]})

    got = rows.mapInPandas(encode, "doc_id long, quality int, passages binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["quality"], bytes(r["passages"])))
    y = np.array([r["quality"] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(r["passages"], np.float32).reshape(-1, N_FEATURES) for r in got]
    return train(np.vstack(parts), np.array([len(p) for p in parts]), y)


def with_score(docs: DataFrame, model: dict[str, np.ndarray] | None, name: str) -> DataFrame:
    """docs with a column `name`, 0 to 1: how likely the text is of label 1. Only the text is an input;
    null counts as empty, which has one empty passage; repeated rows are scored each. Without a model every score is 0.5."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(score_texts(model, batch.tolist()))

    return docs.withColumn(name, score(text_or_empty("text")))


def score_quality(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id and score of every row, see with_score."""
    return with_score(docs.select("doc_id", "text"), model, "score").select("doc_id", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; all columns stay. Null and empty texts are scored as any
    other, repeated rows stay or go together, an empty table stays empty."""
    name = fresh(docs, "_score")
    return with_score(docs, fit(docs, read(spark, sf_dir, "labels")), name).filter(F.col(name) >= 0.3).drop(name)


QUERIES = {"op10_quality": op10_quality}
ORACLE: dict[str, str] = {}
