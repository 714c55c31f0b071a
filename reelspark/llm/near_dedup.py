"""MinHash near-dedup by chosen-path trees: documents branch on selected minwise tokens until their nodes are small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import flagged, read, saved, text_or_empty, without

WORDS = 5
#: Minwise tokens of a document; trees; levels of a tree; size up to which a node is compared exhaustively.
TOKENS, TREES, LEVELS, NODE = 64, 12, 6, 2048
#: Standard deviations by which an estimate may lie below the threshold and still be confirmed on full sets.
MARGIN = 4.0
#: Documents and shingles of a block on average; a task holds two blocks of a node at once.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21

_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_rng = np.random.default_rng(20240301)
_MULTIPLIERS = (_rng.integers(1, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)[:, None]
_STRETCH = 2048


#: Hashing of words: a number for each byte (a capital has its small letter's), times a power by its place. White space has none.
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20


class _Powers:
    """Powers of the base and of its inverse, modulo 2 ** 64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            run = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
            self.up, self.down = run(_BASE), run(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """data cut at white space, so that a piece is about _PIECE bytes, and longer only where a word is."""
    start = 0
    while len(data) - start > _PIECE:
        cut = start + _PIECE
        while cut < len(data):
            gap = np.flatnonzero(_SPACES[data[cut : cut + _PIECE]])
            if len(gap):
                cut += int(gap[0])
                break
            cut += _PIECE
        yield data[start:cut]
        start = cut
    if start < len(data):
        yield data[start:]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, the same for A-Z and a-z. Words are parted by ASCII white space only."""
    out = [np.zeros(0, np.uint64)]
    for b in _pieces(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)):
        space = _SPACES[b]
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers.of(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * up[:-1], out=sums[1:])
        out.append((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return out[-1] if len(out) == 2 else np.concatenate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; of the whole sequence where there are fewer; none
    without words. A-Z are lower-cased, words are parted by ASCII white space only."""
    h = _mixed(word_hashes(text))
    if not len(h):
        return h
    n = len(h)
    if n < words:
        return _mixed((h * _POWERS[:n]).sum(keepdims=True) + np.uint64(n))
    out = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        out += h[k : n - words + 1 + k] * _POWERS[k]
    out = np.sort(_mixed(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def minwise(found: np.ndarray) -> np.ndarray:
    """The minwise token of each permutation of the shingles' upper halves, as 32 bits."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(x), _STRETCH):
        y = x[None, start : start + _STRETCH] * _MULTIPLIERS
        y += _SHIFTS
        np.minimum(least, y.min(1), out=least)
    return least


def set_hash(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


SIGNATURE = "doc_id long, n_shingles long, set_hash binary, tokens binary"


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))


def signatures(base: DataFrame) -> DataFrame:
    """Of each row (doc_id, text): the size of its set, a 128-bit hash of the set and its minwise tokens, 32 bits each. Hash
    and tokens are null for a text without words; repeated rows and null ids stay."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = shingles(text)
                held = (set_hash(found), minwise(found).tobytes()) if len(found) else (None, None)
                rows.append((doc, len(found), *held))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_hash", "tokens"]).astype({"doc_id": "Int64"})

    return base.mapInPandas(sign, SIGNATURE)


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - MARGIN * (s * (1 - s) / TOKENS) ** 0.5


def _token(tokens: Column, at: Column) -> Column:
    return F.substring(tokens, at * 4 + 1, F.lit(4))


def _children(node: Column, tokens: Column, percent: int) -> Column:
    """Node keys below a node: one token chosen by the node, and with the probability 1 / similarity - 1 a second."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TOKENS)).cast("int")
    key = lambda at: F.xxhash64(node, at, _token(tokens, at))
    twice = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(10_000)) < int(10_000 * (100 / percent - 1))
    return F.when(twice & (first != second), F.array(key(first), key(second))).otherwise(F.array(key(first)))


# comparing the documents of nodes


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, from rows sorted by keys."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        k = batch[keys].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            if last is not None and tuple(k[lo]) != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            last = tuple(k[lo])
            held.append(batch.iloc[lo:hi])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


GROUP = ["node", "i", "j"]


def _by_group(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """work on all rows of each node and pair of blocks, in one task that streams through the groups dealt to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for group in _groups(batches, GROUP):
            made = work(group)
            if made is not None and len(made):
                out.append(made)
                held += len(made)
            if held >= 10_000:
                yield pd.concat(out, ignore_index=True)
                out, held = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(run, schema)


def _candidates(rows: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places x, y of pairs whose estimate reaches `least`, the most alike first. Left out are pairs of one label,
    pairs inside a block of a group of two, and pairs that meet in the root of an earlier tree which is compared whole."""
    t = np.frombuffer(b"".join(rows["tokens"]), np.uint32).reshape(len(rows), TOKENS)
    small = t.astype(np.uint8)
    label, block = rows["label"].to_numpy(), rows["block"].to_numpy()
    tree, pivot = int(rows["tree"].iloc[0]), int(rows["pivot"].iloc[0])
    whole = ((rows["at"].to_numpy()[:, None] >> np.arange(tree)) & 1).astype(bool)
    two = rows["i"].iloc[0] != rows["j"].iloc[0]
    held = np.flatnonzero(rows["cls"].to_numpy() == pivot)[:1] if pivot >= 0 else range(len(rows) - 1)
    found = [np.zeros((3, 0), np.int32)]
    for k in held:
        lo = 0 if pivot >= 0 else k + 1
        same = (small[lo:] == small[k]).sum(1, dtype=np.int32)
        hit = np.flatnonzero((same >= least * TOKENS) & (label[lo:] != label[k])) + lo
        if two and pivot < 0:
            hit = hit[block[hit] != block[k]]
        if len(hit):
            hit = hit[~((t[hit, :tree] == t[k, :tree]) & whole[hit]).any(1)]
            found.append(np.stack([np.full(len(hit), k, np.int32), hit.astype(np.int32), same[hit - lo]]))
    x, y, same = np.concatenate(found, axis=1)
    order = np.argsort(-same, kind="stable")
    return x[order], y[order]


#: pivot: the class that all others of the group are compared to, or -1; at: trees whose root holds the class and is compared whole, as bits.
MEMBER = "node long, i int, j int, block int, tree int, pivot long, cls long, label long, at long, tokens binary"


def _involved(groups: DataFrame, percent: int) -> DataFrame:
    """Those members that some candidate pair of their group needs."""
    least = least_estimate(percent)

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        x, y = _candidates(rows, least)
        return rows.iloc[np.union1d(x, y)] if len(x) else None

    return _by_group(groups, work, MEMBER)


def _confirmed(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes whose full sets have 100 * intersection >= percent * union, of each group as many as join what is linked in it.
    groups: MEMBER and shingles."""
    least = least_estimate(percent)

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        x, y = _candidates(rows, least)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        root = list(range(len(rows)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        kept = []
        for p, q in zip(map(int, x), map(int, y)):
            a, b = find(p), find(q)
            n, m = len(sets[p]), len(sets[q])
            if a != b and 100 * min(n, m) >= percent * max(n, m):
                common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * common >= percent * (n + m - common):
                    root[a] = b
                    kept.append((p, q))
        if not kept:
            return None
        cls = rows["cls"].to_numpy()
        p, q = np.array(kept).T
        return pd.DataFrame({"a": cls[p], "b": cls[q]})

    return _by_group(groups, work, "a long, b long")


def _full_sets(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_hash and shingles of the wanted sets (doc_id, set_hash), from texts: of the corpus only rows whose id may be wanted leave
    the scan, and only their sets are shuffled."""
    mark = "maybe"
    some = flagged(base, [F.col("doc_id")], wanted, [F.col("doc_id")], mark).filter(mark).select("text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame([(set_hash(f), f.tobytes()) for f in found if len(f)], columns=["set_hash", "shingles"])

    encoded = some.mapInPandas(encode, "set_hash binary, shingles binary")
    named = flagged(encoded, [F.col("set_hash")], wanted, [F.col("set_hash")], mark).filter(mark).drop(mark)
    return named.groupBy("set_hash").agg(F.first("shingles").alias("shingles"))


def components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """cls and label of every end of a written table of links (a, b): label is the id and class of the smallest doc_id reachable, a
    struct. ids: cls, doc_id. Labels spread along links and jump along labels until none changes; each round is written."""
    ends = links.select("a", "b").union(links.select("b", "a"))
    mine = ends.select(F.col("a").alias("cls")).distinct().join(ids, "cls").select("cls", F.struct("doc_id", "cls").alias("label"))
    labels = saved(mine, "labels")
    while True:
        heard = ends.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "cls").select("cls", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = spread.select(F.col("cls").alias("_to"), F.col("label").alias("further"))
        new = spread.join(jump, F.col("label.cls") == F.col("_to"), "left").select("cls", "old", F.coalesce(F.least("label", "further"), "label").alias("label"))
        new = saved(new, "labels")
        labels = new.select("cls", "label")
        if new.filter("label != old").isEmpty():
            return labels


def _blocks(members: DataFrame) -> DataFrame:
    """members (node, tree, cls, n, total and more) dealt to pairs of blocks of their node: rows of each pair (i, j), i <= j."""
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    m = members.withColumn("_count", count).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("_count")).cast("int"))
    m = m.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    return m.withColumn("i", F.least("block", "_k")).withColumn("j", F.greatest("block", "_k")).withColumn("pivot", F.lit(-1).cast("long"))


def _stars(members: DataFrame) -> DataFrame:
    """members (node, tree, cls, n, total, first) dealt to groups of a block's size, the node's first class in each."""
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("cls"), count).cast("int")
    places = F.when(F.col("cls") == F.col("first"), F.sequence(F.lit(0), count - 1)).otherwise(F.array(own))
    m = members.withColumn("i", F.explode(places)).withColumn("j", F.col("i"))
    return m.withColumn("block", F.col("i")).withColumn("pivot", F.col("first"))


def find_links(base: DataFrame, classes: DataFrame, percent: int, trees: int = TREES, levels: int = LEVELS, node: int = NODE) -> DataFrame:
    """Links (a, b) between classes (cls, doc_id, n_shingles, set_hash, tokens; a written table), enough that what is linked is joined.

    Each of the trees has a root for each value of one token. A node of up to `node` classes is compared exhaustively: pairs by their minwise
    tokens, and those that may reach the threshold on full sets, inside the task that holds the node or two blocks of it. Of a larger node all are compared to
    its first class, then it branches; nodes whose classes are all joined by then end. Those still large at the last level are compared in
    blocks, whatever their size."""
    if trees > TOKENS:
        raise ValueError("a tree needs a token of its own")
    roots = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(f"tree {t}"), F.substring("tokens", 4 * t + 1, 4)).alias("node")) for t in range(trees)])
    members = classes.select("cls", "n_shingles", F.explode(roots).alias("r")).select("cls", "n_shingles", "r.tree", "r.node")
    ids = classes.select("cls", "doc_id")
    links = labels = at_roots = None

    def confirm(groups: DataFrame) -> DataFrame:
        rows = saved(_involved(groups.select(*[c.split()[0] for c in MEMBER.split(", ")]), percent), "involved")
        wanted = rows.select("cls").distinct().join(classes.select("cls", "doc_id", "set_hash"), "cls")
        wanted = saved(wanted, "wanted")
        sets = wanted.join(_full_sets(base, wanted), "set_hash").select("cls", "shingles")
        return saved(_confirmed(rows.join(sets, "cls"), percent), "links")

    for level in range(levels):
        sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min("cls").alias("first")).filter("n > 1")
        at = saved(members.join(sizes, "node"), f"level{level}")
        if at_roots is None:
            bit = F.when(F.col("n") <= node, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tree"))).otherwise(F.lit(0).cast("long"))
            at_roots = saved(at.groupBy("cls").agg(F.bit_or(bit).alias("at")), "roots")
        some = flagged(classes.select("cls", "tokens"), [F.col("cls")], at_roots, [F.col("cls")], "maybe").filter("maybe").drop("maybe")
        known = some.join(at_roots, "cls")
        tagged = at.join(known, "cls")
        tagged = tagged.join(labels.select("cls", F.col("label.cls").alias("label")), "cls", "left") if labels is not None else tagged.withColumn("label", F.col("cls"))
        tagged = tagged.withColumn("label", F.coalesce("label", "cls"))
        many = F.col("n") > node
        groups = _blocks(tagged.filter(~many))
        large = not at.filter(many).isEmpty()
        if large:
            groups = groups.unionByName(_stars(tagged.filter(many)), allowMissingColumns=True)
        new = confirm(groups)
        links = new if links is None else saved(links.union(new), "links")
        if not large:
            return links
        labels = components(links, ids)
        held = at.filter(many).join(labels.select("cls", F.col("label.cls").alias("label")), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        mixed = held.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("node")
        rest = saved(held.join(mixed, "node"), "rest")
        if rest.isEmpty():
            return links
        deeper = rest.join(classes.select("cls", "tokens"), "cls")
        members = deeper.select("cls", "n_shingles", F.lit(trees).alias("tree"), F.explode(_children(F.col("node"), F.col("tokens"), percent)).alias("node"))
    return saved(links.union(confirm(_blocks(rest.join(classes.select("cls", "tokens"), "cls").join(at_roots, "cls")))), "links")


def near_dedup(docs: DataFrame, percent: int = 85, trees: int = TREES, levels: int = LEVELS, node: int = NODE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Sets are the distinct runs of five words; two documents are linked when 100 * intersection >= percent * union,
    confirmed on full sets. component_id is the smallest doc_id reachable over links; kept says that it is the row's own.
    Null and blank texts have an empty set and are linked with nothing, so each is kept; documents of fewer than five words
    are linked to those of the same words only. Documents of equal sets form a class that acts as one. Rows that repeat a
    doc_id are one document per distinct set. A null doc_id has a null component and is kept. An empty table gives an empty result.

    Texts are not shuffled; sets are, of those documents that have a candidate.
    """
    base = _base(docs)
    signed = saved(signatures(base), "signatures")
    known = signed.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    by_set = known.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    classes = saved(by_set.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links = find_links(base, classes, percent, trees, levels, node)
    labels = components(links, classes.select("cls", "doc_id"))
    of_class = labels.select("cls", F.col("label.doc_id").alias("component")).filter(F.col("component").isNotNull())
    grown = classes.select("cls", "set_hash", "doc_id").join(of_class, "cls", "left").select("set_hash", F.coalesce("component", "doc_id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(grown, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays, at a similarity of 0.8. Nulls, empty and repeated
    texts as in near_dedup; of rows that repeat a doc_id all stay if one of them does. An empty table stays empty, all columns stay."""
    found = saved(near_dedup(docs, percent=80), "near")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id")
    return without(docs, [F.col("doc_id").cast("long")], gone, [F.col("doc_id")])


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE: dict[str, str] = {}
