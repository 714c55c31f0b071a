"""LM scoring by cross-entropy difference: bigram models of a target and of all documents over the words of all."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import flagged, read, saved, text_or_empty

#: Words of a chunk of texts: bounds the memory of a task.
CHUNK = 1_000_000
#: Weight of a context against its backoff, as so many further occurrences.
PRIOR = 20.0
START = 0


TEXTS = "chunk long, ids binary, known binary, hashes array<long>, sizes binary, goal binary, words binary"
COUNTS = "bucket int, chunk long, word_keys binary, pair_keys binary, words binary, ends binary, pairs binary, goal_words binary, goal_ends binary, goal_pairs binary"
TOTALS = "chunk long, bucket int, words binary, goal_words binary, ends binary, goal_ends binary, pairs binary, goal_pairs binary"
SCORES = "doc_id long, n_words long, score double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, of which the high ones are mostly 0."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpacked(x: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zlib.decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, and the last one's end, lies in sorted keys: buckets are equal ranges of a key's upper 24 bits."""
    bucket = ((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


class Chunk:
    """Words and bigrams of some texts, each distinct one with a key of 64 bits, both in the order of their keys.

    words: local ids of all words in order, START (0) is none of them; hashes: 64 bits of each local id. A text's first word
    follows START; how often a word is a context is how often it occurs less how often it ends a text."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, hashes: np.ndarray):
        n = len(hashes)
        codes = np.empty(len(words), np.int64)
        codes[1:] = words[:-1]
        codes[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
        codes *= n
        codes += words
        ends = words[(np.cumsum(sizes) - 1)[sizes > 0]]
        codes, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
        self.at, counts = at.astype(np.int32), counts.astype(np.uint32)
        self.first, self.second = (codes // n).astype(np.int32), (codes % n).astype(np.int32)
        del codes, at
        pairs = _mixed(_mixed(hashes[self.first]) + hashes[self.second])
        self.word_order, self.pair_order = np.argsort(hashes[1:]).astype(np.int32), np.argsort(pairs).astype(np.int32)
        self.word_keys, self.pair_keys = hashes[1:][self.word_order], pairs[self.pair_order]
        self.words, self.ends, self.pairs = self.counted(words), self.counted(ends), counts[self.pair_order]

    def counted(self, words: np.ndarray) -> np.ndarray:
        return np.bincount(words, minlength=len(self.word_keys) + 1)[1:][self.word_order].astype(np.uint32)

    def aimed(self, sizes: np.ndarray, words: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words, ends and bigrams in the texts of the goal (a mask), in the keys' order."""
        held, last = np.repeat(goal, sizes), (np.cumsum(sizes) - 1)[(sizes > 0) & goal]
        pairs = np.bincount(self.at[held], minlength=len(self.pair_keys))[self.pair_order].astype(np.uint32)
        return self.counted(words[held]), self.counted(words[last]), pairs

    def spread(self, words: np.ndarray, ends: np.ndarray, pairs: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals in the keys' order, told apart: of each bigram's second word, first word as a context, and of the bigram."""
        word, context, pair = np.empty(len(words) + 1), np.empty(len(words) + 1), np.empty(len(pairs))
        word[0], context[0] = 0, texts
        word[1:][self.word_order], context[1:][self.word_order] = words, words - ends
        pair[self.pair_order] = pairs
        return word[self.second], context[self.first], pair


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def chunk_texts(docs: DataFrame, limit: int = CHUNK) -> DataFrame:
    """Chunks of texts of about `limit` words, see TEXTS: doc_id, words and target of each text, local ids of all words in
    order, hashes of the local ids. docs: doc_id, text, target (boolean)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[str, int] = {"": START}
        held: list[tuple] = []
        total = 0

        def made() -> pd.DataFrame:
            docs_held, words, goal = zip(*held)
            hashes = np.fromiter(map(_hash, ids), np.uint64, len(ids)).view(np.int64)
            sizes = np.array([len(w) for w in words], np.int64)
            row = (uuid.uuid4().int >> 65, _packed(np.array([d or 0 for d in docs_held], np.int64)), _packed(np.array([d is not None for d in docs_held])), hashes, _packed(sizes), _packed(np.array(goal, bool)), _packed(np.concatenate(words)))
            held.clear()
            ids.clear()
            ids[""] = START
            return pd.DataFrame([row], columns=_names(TEXTS))

        for batch in batches:
            for doc, text, target in zip(batch["doc_id"], batch["text"], batch["target"]):
                parts = text.split()
                for w in parts:
                    if w not in ids:
                        ids[w] = len(ids)
                held.append((None if doc == "" else int(doc), np.fromiter(map(ids.__getitem__, parts), np.uint32, len(parts)), bool(target)))
                total += len(parts)
                if total >= limit or len(held) >= limit:
                    yield made()
                    total = 0
        if held:
            yield made()

    return docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc_id"), "text", "target").mapInPandas(work, TEXTS)


def _chunk(row) -> Chunk:
    return Chunk(_unpacked(row["sizes"], np.int64), _unpacked(row["words"], np.uint32), np.asarray(row["hashes"], np.int64).view(np.uint64))


def chunk_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket the keys that fall to it and their counts, in all texts and in those of the target, see COUNTS."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                c = _chunk(row)
                aim = c.aimed(_unpacked(row["sizes"], np.int64), _unpacked(row["words"], np.uint32), _unpacked(row["goal"], bool))
                w, p = _cuts(c.word_keys, buckets), _cuts(c.pair_keys, buckets)
                rows = []
                for b, (wl, wh, pl, ph) in enumerate(zip(w, w[1:], p, p[1:])):
                    if wh > wl or ph > pl:
                        held = [(c.words, wl, wh), (c.ends, wl, wh), (c.pairs, pl, ph), (aim[0], wl, wh), (aim[1], wl, wh), (aim[2], pl, ph)]
                        rows.append((b, row["chunk"], _packed_keys(c.word_keys[wl:wh]), _packed_keys(c.pair_keys[pl:ph]), *[_packed(x[lo:hi]) for x, lo, hi in held]))
                yield pd.DataFrame(rows, columns=_names(COUNTS))

    return chunks.mapInPandas(work, COUNTS)


def total_counts(counts: DataFrame) -> DataFrame:
    """For each chunk and bucket, in the order of its keys there, the counts summed over all chunks, see TOTALS."""

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["chunk", "bucket"]].copy()
        for keys, names in (("word_keys", ("words", "ends", "goal_words", "goal_ends")), ("pair_keys", ("pairs", "goal_pairs"))):
            parts = [_unpacked_keys(x) for x in rows[keys]]
            cuts = np.cumsum([len(p) for p in parts])[:-1]
            at = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int32)
            for name in names:
                found = np.concatenate([_unpacked(x, np.uint32) for x in rows[name]])
                sums = np.bincount(at, weights=found).astype(np.int64)[at]
                out[name] = [_packed(x) for x in np.split(sums, cuts)]
        return out[_names(TOTALS)]

    return counts.groupBy("bucket").applyInPandas(total, TOTALS)


def _lengths(chunks: DataFrame) -> list[tuple[int, int]]:
    """Words and texts that have any, of all texts and of those of the target."""

    @F.pandas_udf("struct<words:long,texts:long,goal_words:long,goal_texts:long>")
    def length(sizes: pd.Series, goal: pd.Series) -> pd.DataFrame:
        held = [(_unpacked(n, np.int64), _unpacked(g, bool)) for n, g in zip(sizes, goal)]
        rows = [(n.sum(), (n > 0).sum(), n[g].sum(), (n[g] > 0).sum()) for n, g in held]
        return pd.DataFrame(rows, columns=["words", "texts", "goal_words", "goal_texts"])

    sums = [F.sum(f"n.{c}").alias(c) for c in ("words", "texts", "goal_words", "goal_texts")]
    n = [x or 0 for x in chunks.select(length("sizes", "goal").alias("n")).agg(*sums).first()]
    return [(n[0], n[1]), (n[2], n[3])]


def score_chunks(chunks: DataFrame, totals: DataFrame, size: int, lengths: list[tuple[int, int]], prior: float = PRIOR) -> DataFrame:
    """doc_id, n_words, score: mean over a text's words of target loss less background loss, in nats; lower is nearer the
    target. Both models have the same vocabulary of `size` words and smoothing: a bigram's probability leans on the word's, that on the
    uniform one. A text without words has the score 0."""

    def score(key, texts: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        texts, sums = texts.iloc[0], sums.sort_values("bucket")
        chunk, sizes, losses = _chunk(texts), _unpacked(texts["sizes"], np.int64), []
        for prefix, (total, count) in zip(("", "goal_"), lengths):
            held = [np.concatenate([np.zeros(0, np.int64), *(_unpacked(x, np.int64) for x in sums[prefix + k])]) for k in ("words", "ends", "pairs")]
            word, context, pair = chunk.spread(*held, count)
            losses.append(np.log((pair + prior * (word + 1) / (total + size)) / (context + prior)))
        by_word = (losses[0] - losses[1])[chunk.at]
        means = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=by_word, minlength=len(sizes)) / np.maximum(sizes, 1)
        ids = pd.arrays.IntegerArray(_unpacked(texts["ids"], np.int64).copy(), ~_unpacked(texts["known"], bool))
        return pd.DataFrame({"doc_id": ids, "n_words": sizes, "score": means})

    return chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(score, SCORES)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Scores of all documents against a target: the documents whose doc_id is in targets. Null texts count as empty; repeated
    rows are counted and scored each; ids of targets may repeat; without any target the models agree and every score
    comes from smoothing alone; an empty table gives an empty result.

    Every distinct word and bigram of all documents has counts of its own, under a key of 64 bits. Texts are held
    in chunks of bounded size; a chunk sends each of its keys once to the key's bucket, where counts are summed, and
    gets the sums back, so a frequent bigram is one row of a chunk. Texts that are surely not in the target are taken as they are read; only those that may be are
    shuffled, to be told for sure. The driver gets five numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    marked = targets.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, min(4 * parts, 1024))
    maybe = flagged(rows, [F.col("doc_id")], marked, [F.col("doc_id")], "maybe")
    surely_not = maybe.filter("NOT maybe").select("doc_id", "text", F.lit(False).alias("target"))
    told = maybe.filter("maybe").join(marked.withColumn("target", F.lit(True)), "doc_id", "left")
    chunks = saved(chunk_texts(surely_not.unionByName(told.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))), chunk), "chunks")
    size = max(chunks.select(F.explode("hashes").alias("h")).distinct().count() - 1, 0)  # START is no word
    return score_chunks(chunks, total_counts(chunk_counts(chunks, buckets)), size, _lengths(chunks))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents labelled of good quality and not toxic, but for the held-out fifth."""
    good = read(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return cross_entropy_difference(read(spark, sf_dir, "documents"), good)


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE: dict[str, str] = {}
