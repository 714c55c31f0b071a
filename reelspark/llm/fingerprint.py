"""Document fingerprints: randomised edit embedding, bit-sampled, with banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import read, saved, text_or_empty
from reelspark.llm.near_dedup import components

#: Sampled steps of each octave of a walk; shorter octaves are taken whole.
PER_OCTAVE = 64
OCTAVES = 40
#: Code points worked on at once inside a task.
SLICE = 4_000_000
BLOCK = 64


def _random(seed: int) -> np.random.Generator:
    return np.random.default_rng(seed)


#: Shared by all texts: whether a walk moves on, by step (with a period) and character class.
MOVES = _random(20240229).integers(0, 2, (4096, 256), dtype=np.int64)


def sampled_steps(octaves: int = OCTAVES) -> np.ndarray:
    """Steps whose characters a fingerprint holds, ascending: step 0, then each octave's."""
    rng, out = _random(7), [np.array([0])]
    for o in range(octaves):
        size = 1 << o
        if size <= PER_OCTAVE:
            out.append(np.arange(size, 2 * size))
        else:
            out.append(size + ((np.arange(PER_OCTAVE) + rng.random(PER_OCTAVE)) * (size / PER_OCTAVE)).astype(np.int64))
    return np.concatenate(out)


STEPS = sampled_steps()
#: The octave of each slot; step 0 counts with the first.
SLOT_OCTAVE = np.maximum(0, np.floor(np.log2(np.maximum(STEPS, 1)))).astype(np.int64)


def _walk(texts: list[np.ndarray]) -> np.ndarray:
    """Slots of each text: four bits of the character that its walk reads at the sampled steps, 16 past its end.

    At each step the walk reads its character and moves to the next or stays, as the shared moves say; so an edit
    of few characters leaves most of what is read later in step. All texts walk at once."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + BLOCK)])[:-1]
    points = np.zeros(int((sizes + BLOCK).sum()), np.uint32)
    for t, s in zip(texts, starts):
        points[s : s + len(t)] = t
    mixed = points * np.uint32(2654435761)
    kind, bits = (mixed >> np.uint32(24)).astype(np.int64), (mixed >> np.uint32(20)).astype(np.uint8) & 15
    del points, mixed
    used = int(np.searchsorted(STEPS, 3 * (int(sizes.max(initial=0)) + BLOCK)))
    slots = np.full((n, used), 16, np.uint8)
    live = np.flatnonzero(sizes > 0)
    at, end = starts[live].copy(), (starts + sizes)[live]
    step, slot = 0, 0
    while len(live):
        for j in range(step, step + BLOCK):
            if slot < used and STEPS[slot] == j:
                inside = at < end
                slots[live[inside], slot] = bits[at[inside]]
                slot += 1
            at += MOVES[j & 4095][kind[at]]
        step += BLOCK
        left = at < end
        if not left.all():
            live, at, end = live[left], at[left], end[left]
    return slots


def fingerprints(texts: list[str]) -> list[str]:
    """Of each text: its number of code points in hex, a colon, a hex digit for each slot within its walk."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    out = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(points[i]))
    digits = np.frombuffer(b"0123456789abcdef.", np.uint8)
    while order:
        part, held = [], 0
        while order and (not part or held + len(points[order[-1]]) <= SLICE):
            part.append(order.pop())
            held += len(points[part[-1]])
        for i, row in zip(part, _walk([points[i] for i in part])):
            out[i] = f"{len(points[i]):x}:" + digits[row[: int((row < 16).sum())]].tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    """Estimated share of steps at which two walks read the same, of the longer walk; 1 for equal texts, also empty ones."""
    (n, x), (m, y) = a.split(":"), b.split(":")
    if a == b:
        return 1.0
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    u, v = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    k, most = min(len(u), len(v)), max(len(u), len(v))
    same = np.zeros(most)
    same[:k] = u[:k] == v[:k]
    octave = SLOT_OCTAVE[:most]
    held = np.bincount(octave)
    agreed = np.bincount(octave, weights=same)
    span = np.minimum(2.0 ** np.arange(1, len(held) + 1), 2.0 * max(n, m)) - np.where(np.arange(len(held)) == 0, 0, 2.0 ** np.arange(len(held)))
    span = np.maximum(span, 0)
    return float((span * agreed / np.maximum(held, 1)).sum() / max(span.sum(), 1e-9))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(docs: DataFrame, parts: int) -> tuple[list[int], dict[int, int]]:
    """Bounds that deal the ids to about `parts` ranges; for each range that has rows, the id that follows it (the first
    id of all, after the last)."""
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"))
    cuts = ids.select(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(cuts or []))
    firsts = {r["part"]: r["first"] for r in ids.groupBy(_part(F.col("id"), bounds).alias("part")).agg(F.min("id").alias("first")).collect()}
    order = sorted(firsts)
    return bounds, {p: firsts[order[(k + 1) % len(order)]] for k, p in enumerate(order)}


def _part(id_col, bounds: list[int]):
    """How many bounds lie below the id."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(held, lambda b: b < id_col))


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document, see SCHEMA. Its edited text has the last floor(n / 2) code points replaced by the first as
    many (or all) of the next document by ascending doc_id, then text; the first document follows the last.

    Null text counts as empty; a null doc_id sorts first; rows that repeat an id follow each other, sorted by text.
    An empty text's fingerprint is `0:`; an empty table gives an empty result. Text is shuffled once, into ranges of ids sorted in place; each range
    also gets the row that follows it, so no row needs a neighbour from elsewhere.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    bounds, following = _ranges(rows, parts)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    own = F.array(F.struct(_part(key, bounds).alias("part"), F.lit(False).alias("tail")))
    by_first: dict[int, list[int]] = {}
    for part, first in following.items():
        by_first.setdefault(first, []).append(part)
    places = own
    for first, to in by_first.items():
        places = F.when(key == first, F.concat(own, F.array(*[F.struct(F.lit(p).alias("part"), F.lit(True).alias("tail")) for p in to]))).otherwise(places)
    dealt = rows.withColumn("place", F.explode(places)).select("place.part", "place.tail", "doc_id", "text")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "text")

    def rows_of(batch: pd.DataFrame) -> list[tuple]:
        return [(p, t, None if pd.isna(d) else int(d), s) for p, t, d, s in zip(batch["part"], batch["tail"], batch["doc_id"], batch["text"])]

    def digest(pairs: list[tuple]) -> pd.DataFrame:
        edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
        chain = [a[3] for a, _ in pairs] + [pairs[-1][1][3]]
        breaks = [i for i in range(len(pairs) - 1) if pairs[i][1] is not pairs[i + 1][0]]
        extra = [pairs[i][1][3] for i in breaks]
        made = fingerprints(chain + extra + edited)
        prints, after, changed = made[: len(chain)], dict(zip(breaks, made[len(chain) :])), made[len(chain) + len(extra) :]
        out = []
        for i, ((a, _), e) in enumerate(zip(pairs, edited)):
            nxt = after.get(i, prints[i + 1])
            out.append((a[2], len(a[3]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), prints[i], changed[i], likeness(prints[i], changed[i]), likeness(prints[i], nxt)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pairs, held = None, [], 0
        for batch in batches:
            for row in rows_of(batch):
                if last is not None and not last[1] and last[0] == row[0]:
                    pairs.append((last, row))
                    held += len(last[3])
                    if held > SLICE:
                        yield digest(pairs)
                        pairs, held = [], 0
                last = row
        if pairs:
            yield digest(pairs)

    return dealt.mapInPandas(work, SCHEMA)


def _bands(prints: pd.Series, bands: int, width: int, seed: int) -> pd.Series:
    """Band keys of fingerprints: `width` slots of a text's last whole octaves, chosen at random but alike for all texts."""
    out = []
    for fp in prints:
        slots = fp.split(":")[1]
        found = []
        for top in {len(slots).bit_length(), len(slots).bit_length() - 1} if slots else ():
            size = min(len(slots), 1 << max(0, top - 1))
            draw = _random(seed + size)
            for b in range(bands):
                at = sorted(draw.integers(0, size, width))
                found.append(f"{size}:{b}:" + "".join(slots[k] for k in at))
        out.append(sorted(set(found)))
    return pd.Series(out)


def _linked(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between rows (cls, fingerprint, side, lo, hi) as alike as the threshold, but those between rows that others of these links join already."""
    rows = rows.drop_duplicates("cls").sort_values("cls")
    names, prints, side = rows["cls"].tolist(), rows["fingerprint"].tolist(), rows["side"].tolist()
    within = bool(rows["lo"].iloc[0] == rows["hi"].iloc[0])
    parent, out = list(range(len(names))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if (within or side[i] != side[j]) and root(i) != root(j) and likeness(prints[i], prints[j]) >= threshold:
                parent[root(i)] = root(j)
                out.append((names[j], names[i]))
    return pd.DataFrame(out, columns=["a", "b"])


def near_classes(prints: DataFrame, threshold: float = 0.6, bands: int = 64, width: int = 6, block: int = 256, seed: int = 11) -> DataFrame:
    """Banding and verification: doc_id and class_id of every row of prints (doc_id, n_chars, fingerprint): the smallest doc_id that can be reached by links between fingerprints that
    share a band and are as alike as the threshold.

    Equal fingerprints are one item, so copies are not compared. Every two items of a bucket are: a bucket of more than `block` items is dealt into blocks by hash, and each pair
    of blocks is a task's group of a bounded size, however large the bucket. Links that a group's other links imply are not told. Two texts of likeness s share one of the bands with
    1 - (1 - s^width)^bands: 0.95 at 0.6, 0.999 at 0.7. Empty texts are in classes of their own; rows with a null or repeated id get their fingerprint's class; an empty table gives none."""
    cls = F.md5(F.col("fingerprint"))
    items = prints.filter(F.col("n_chars") > 0).groupBy(cls.alias("cls")).agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"))
    items = saved(items, "prints")
    keys = F.pandas_udf(lambda column: _bands(column, bands, width, seed), "array<string>")
    banded = items.select("cls", F.explode(keys("fingerprint")).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = banded.join(shared, "band").withColumn("side", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("band", "cls", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    groups = members.join(items.select("cls", "fingerprint"), "cls").groupBy("band", "lo", "hi")
    links = saved(groups.applyInPandas(lambda rows: _linked(rows, threshold), "a string, b string").distinct(), "print-links")
    labels = components(links, items.select("cls", "doc_id"))
    told = items.select("cls", "doc_id").join(labels.select("cls", "label.doc_id").withColumnRenamed("doc_id", "joined"), "cls", "left")
    told = told.select(F.col("cls").alias("_cls"), F.coalesce("joined", "doc_id").alias("class_id"))
    out = prints.select("doc_id", F.when(F.col("n_chars") > 0, cls).alias("_own")).join(told, F.col("_own") == F.col("_cls"), "left")
    return out.select("doc_id", F.when(F.col("_own").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLE: dict[str, str] = {}
