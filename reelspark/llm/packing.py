"""Best-fit packing: a grouping genetic algorithm on islands of pieces, with elite bins migrating between islands."""

from __future__ import annotations

import base64
import json
import math
import random
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import read, saved, text_or_empty

CAPACITY = 2048
#: Pieces of an island: bounds the memory and time of one packing task.
ISLAND = 4096
#: Elite bins that an island sends on.
MIGRANTS = 128


# tokens


WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space that does not part words one by one: runs, kinds other than space and newline, white space at the end.
_RUNS = re.compile(r"[ \n][ \n]|[\x09\x0b-\x0d\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n]\Z")


@lru_cache
def word_pattern() -> re.Pattern:
    """The split before the merges, with the letter, number and white space classes spelt out: the same matches as
    the Unicode classes of public_tokenizers.PATTERN, several times as fast."""
    def ranges(first: str) -> str:
        held = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == first]
        out, start = [], None
        for a, b in zip(held, [*held[1:], -2]):
            start = a if start is None else start
            if b != a + 1:
                out.append(f"\\U{start:08x}-\\U{a:08x}")
                start = None
        return "".join(out)

    letter, number = ranges("L"), ranges("N")
    white = WHITE
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


class _Memo(dict):
    """Token ids as little-endian unsigned 32-bit integers, of at most `limit` texts: when half of them are new, those that
    were not asked for since the last time go."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        self[text] = out
        return out


class TextIds:
    """Token ids of texts by a rank file. Words are parted by the pattern and encoded once each as long as they are
    kept. In a text whose white space is single spaces and newlines, a space starts the next word and a
    newline stands alone, so such a text is cut there and whole stretches between are looked up."""

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        split = word_pattern().findall

        def ids(word: str) -> bytes:
            found = array("I", piece(word.encode("utf-8", "surrogatepass")))
            if sys.byteorder == "big":
                found.byteswap()
            return found.tobytes()

        self.words = words = _Memo(ids, 150_000)
        self.split = split
        self.plain = _Memo(lambda text: b"".join([words[w] for w in split(text)]), 100_000)
        self.spaced = _Memo(lambda text: b"".join([words[w] for w in split(" " + text)]), 400_000)

    def __call__(self, text: str) -> bytes:
        if _RUNS.search(text):
            return b"".join([self.words[w] for w in self.split(text)])
        out, newline = [], self.words["\n"]
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out += (newline, self.plain[head])
            out.extend(map(self.spaced.__getitem__, rest))
        return b"".join(out[1:])


_texts: dict[str, TextIds] = {}


def text_ids(ranks_path: str) -> TextIds:
    """One per Python worker, for all tasks that it runs."""
    if ranks_path not in _texts:
        _texts[ranks_path] = TextIds(ranks_path)
    return _texts[ranks_path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """Id of each token that the vocabulary's JSON adds beside the merges; texts are split at them before all else."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    odd = [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"tokens that take in or need what stands around them: {odd}")
    return {t["content"]: t["id"] for t in found}


def encoder(ranks_path: str, added: dict[str, int]):
    """Text to ids; added tokens in it have their own ids, what stands between them is encoded part by part."""
    plain = text_ids(ranks_path)
    if not added:
        return plain
    held = {t: k.to_bytes(4, "little") for t, k in added.items()}
    split = re.compile("(" + "|".join(re.escape(t) for t in sorted(held, key=len, reverse=True)) + ")").split

    def encode(text: str) -> bytes:
        parts = split(text)
        return plain(text) if len(parts) == 1 else b"".join([held[p] if k % 2 else plain(p) for k, p in enumerate(parts)])

    return encode


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """Token pieces of each document: its ids and then end_id; longer ones are cut into pieces of the capacity, the first
    piece taking the rest. Texts are read whole; null counts as empty, whose only token is end_id. A null doc_id
    stays null; repeated rows have pieces of their own. Without `added`, the text of an added token is encoded as any other."""
    ranks = ranks_path or default_ranks()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks, added or {})
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                blob = encode(text) + end_id.to_bytes(4, "little")
                n = len(blob) // 4
                first = n - capacity * ((n - 1) // capacity)
                start, length = 0, first
                for k in range((n - 1) // capacity + 1):
                    rows.append((doc, k, start, length, zlib.crc32(blob[4 * start : 4 * (start + length)])))
                    start, length = start + length, capacity
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInPandas(cut, PIECE_SCHEMA)


# the genetic algorithm of one island; a solution is a list of bins, a bin a list of item numbers


def best_fit(sizes: list[int], bins: list[list[int]], items: list[int], capacity: int) -> list[list[int]]:
    """bins with items added in the given order, each to the fullest bin that takes it, else to a new one."""
    bins = [list(b) for b in bins]
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r left
    for k, b in enumerate(bins):
        room = capacity - sum(sizes[i] for i in b)
        by_room.setdefault(room, []).append(k)
        rooms |= 1 << room
    for i in items:
        fits = rooms >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            held = by_room[room]
            k = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        room -= sizes[i]
        by_room.setdefault(room, []).append(k)
        rooms |= 1 << room
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(sizes: list[int], giver: list[list[int]], taker: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of the giver are injected; the taker's bins that share items with them go, and the items
    so displaced are put back by best fit, largest first."""
    fill = sorted(giver, key=lambda b: -sum(sizes[i] for i in b))
    injected = [b for b in fill[: max(1, len(fill) * 3 // 4)] if rng.random() < 0.6]
    held = {i for b in injected for i in b}
    stay, displaced = [], []
    for b in taker:
        if held.isdisjoint(b):
            stay.append(b)
        else:
            displaced += [i for i in b if i not in held]
    return best_fit(sizes, injected + stay, sorted(displaced, key=lambda i: -sizes[i]), capacity)


def mutate(sizes: list[int], bins: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bin and some others are emptied and their items put back by best fit."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[:1]) | set(rng.sample(order, min(len(order), 1 + len(order) // 20)))
    return best_fit(sizes, [b for k, b in enumerate(bins) if k not in gone], sorted((i for k in gone for i in bins[k]), key=lambda i: -sizes[i]), capacity)


def with_migrants(sizes: list[int], patterns: list[list[int]], capacity: int) -> list[list[int]]:
    """A solution that has each migrant bin's sizes where unused items of these sizes exist, and best fit for the rest."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    bins = []
    for pattern in patterns:
        taken = []
        for s in pattern:
            if not by_size.get(s):
                break
            taken.append(by_size[s].pop())
        if len(taken) == len(pattern):
            bins.append(taken)
        else:
            for i in taken:
                by_size[sizes[i]].append(i)
    rest = [i for s in sorted(by_size, reverse=True) for i in by_size[s]]
    return best_fit(sizes, bins, rest, capacity)


def evolve(sizes: list[int], starts: list[list[list[int]]], capacity: int, seed: int, population: int = 6, generations: int = 14) -> list[list[int]]:
    """The best solution found; it stops at the bound that no packing can pass."""
    rng = random.Random(seed)
    least = math.ceil(sum(sizes) / capacity)
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    found = [*starts, best_fit(sizes, [], down, capacity)]
    score = lambda b: fitness(sizes, b, capacity)
    if len(max(found, key=score)) > least:
        while len(found) < population:
            shaken = sorted(down, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0))
            found.append(best_fit(sizes, [], shaken, capacity))
        for _ in range(generations):
            found.sort(key=score, reverse=True)
            found = found[:population]
            if len(found[0]) == least:
                break
            a, b = rng.sample(found[: max(2, population // 2)], 2)
            found += [crossover(sizes, a, b, capacity, rng), mutate(sizes, found[0], capacity, rng)]
    return max(found, key=score)


ITEM_SCHEMA = PIECE_SCHEMA + ", island long, bin long"


def _assigned(rows: pd.DataFrame, bins: list[list[int]]) -> pd.DataFrame:
    at = {i: k for k, b in enumerate(bins) for i in b}
    return rows.assign(bin=[at[i] for i in range(len(rows))])


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)


def _dealt(items: DataFrame, island: int) -> DataFrame:
    """Deals the items of a written table to islands of about the given number of items."""
    n = max(1, math.ceil(items.count() / island))
    return items.withColumn("island", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """pieces (a written table) with sequence_id and offset: as few sequences of at most the capacity as are found.

    A piece of the whole capacity is a sequence by itself. The others are dealt to islands of bounded size; each evolves
    solutions, sends its fullest bins as patterns of sizes to the next island, evolves again with what it was sent,
    and gives up its emptiest bins, whose pieces are packed once more on new islands. Every round is written, so that
    no round runs twice."""
    def first(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(rows)
        return _assigned(rows, evolve(rows["length"].tolist(), [], capacity, int(key[0]), generations=6))

    def second(key, rows: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows
        rows = _ordered(rows)
        sizes = rows["length"].tolist()
        own: dict[int, list[int]] = {}
        for i, b in enumerate(rows["bin"]):
            own.setdefault(b, []).append(i)
        starts = [list(own.values())]
        if len(sent):
            starts.append(with_migrants(sizes, sorted([list(map(int, p)) for p in sent["pattern"]], key=lambda p: (-sum(p), p)), capacity))
        bins = evolve(sizes, starts, capacity, int(key[0]) + 1)
        return _assigned(rows, bins)

    def rounds(items: DataFrame, name: str) -> DataFrame:
        dealt = _dealt(items, island)
        one = saved(dealt.withColumn("bin", F.lit(0).cast("long")).groupBy("island").applyInPandas(first, ITEM_SCHEMA), f"{name}-one")
        bins = one.groupBy("island", "bin").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list("length"), asc=False).alias("pattern"))
        elite = bins.filter(F.col("fill") >= capacity - capacity // 256).withColumn("place", F.row_number().over(W.partitionBy("island").orderBy(F.desc("fill"), "pattern", "bin")))
        count = one.agg(F.max("island")).first()[0]
        sent = elite.filter(F.col("place") <= MIGRANTS).select(F.pmod(F.col("island") + 1, F.lit((count or 0) + 1)).alias("island"), "pattern")
        return saved(one.groupBy("island").cogroup(sent.groupBy("island")).applyInPandas(second, ITEM_SCHEMA), f"{name}-two")

    items = pieces.filter(F.col("length") < capacity)
    packed = rounds(items, "pack")
    fills = packed.groupBy("island", "bin").agg(F.sum("length").alias("fill"))
    rank = F.percent_rank().over(W.partitionBy("island").orderBy("fill", "bin"))
    poor = fills.filter(F.col("fill") < capacity).withColumn("rank", rank).filter(F.col("rank") <= 0.02).select("island", "bin")
    again = saved(packed.join(poor, ["island", "bin"], "left_semi").drop("island", "bin"), "pack-again")
    again = rounds(again, "repack")
    stay = packed.join(poor, ["island", "bin"], "left_anti")
    wide = 1 << 20
    numbered = stay.withColumn("sequence_id", F.col("island") * wide + F.col("bin")).unionByName(again.withColumn("sequence_id", F.lit(1 << 60) + F.col("island") * wide + F.col("bin")))
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    shared = numbered.select(*columns, F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return shared.unionByName(whole.select(*columns, F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, island: int = ISLAND, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty table gives an
    empty result; see cut_pieces for nulls, empty texts and repeated rows."""
    return pack_pieces(saved(cut_pieces(docs, capacity, ranks_path, added=added), "pieces"), capacity, island)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), added=added_tokens())


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents and their places in sequences."""
    return pack_documents(docs, added=added_tokens())


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
