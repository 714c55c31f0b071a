"""Byte-level BPE by higher-order functions: ranked merges folded over the bytes of words with a literal rank map."""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import read, saved, text_or_empty

#: Distinct words at most whose ids are looked up, and words of a hash slot; all other words are folded where they stand.
COMMON, WAYS = 1 << 20, 4
#: Buckets of the table of pairs.
BUCKETS = 1 << 15
#: While words are folded an id is the character of that code point; these sort as the ids do. Code points from here on are none.
LAST = 0xD800
#: What a bucket and each of its entries begin with, and what parts a word from its ids there; they sort after all ids.
MARK, PART = chr(0x10FFFE), chr(0x10FFFD)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    """The splitting pattern with possessive runs, which match the same, under Unicode classes for white space."""
    import public_tokenizers

    return "(?U)" + public_tokenizers.PATTERN.replace(r"\p{L}+", r"\p{L}++").replace(r"\p{N}+", r"\p{N}++").replace(r"[^\s\p{L}\p{N}]+", r"[^\s\p{L}\p{N}]++")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankMap:
    """Literals of one vocabulary: the character of each byte's id; the pairs that merge, each as the two characters and that of the
    id they merge to, between MARKs in hash buckets of one string each; the bytes of each id, as Latin-1 text. Their size is that of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        char = {piece: chr(rank) for piece, rank in ranks.items()}
        buckets = [MARK] * BUCKETS
        for piece in ranks:
            for k in range(1, len(piece)):
                if piece[:k] in char and piece[k:] in char:
                    pair = char[piece[:k]] + char[piece[k:]]
                    buckets[zlib.crc32(pair.encode()) % BUCKETS] += pair + char[piece] + MARK
        top = max(ranks.values(), default=-1) + 1
        if top > LAST:
            raise ValueError(f"ids of {LAST} and more")
        by_id = [""] * top
        for piece, rank in ranks.items():
            by_id[rank] = piece.decode("latin-1")
        literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
        self.single = "".join(char[bytes([k])] for k in range(256))
        self.pairs = literal(buckets, "array<string>")
        self.pieces = literal(by_id, "array<string>")

    def fold(self, words: Column) -> Column:
        """Ids of each word of an array, as a string of characters."""
        return let(self.pairs, lambda pairs: F.transform(words, lambda word: _fold(word, self.single, pairs)))


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(word: Column, single: str, pairs: Column) -> Column:
    """Ids of one word as characters: while two neighbours merge, the leftmost pair of the lowest id becomes that id."""

    def merged(pair: Column) -> Column:
        """What two neighbours merge to, or MARK: what follows the pair in its bucket, else the bucket's first character."""
        held = F.get(pairs, (F.crc32(pair.cast("binary")) % BUCKETS).cast("int"))
        return F.substring(F.call_function("substring_index", held, F.concat(F.lit(MARK), pair), F.lit(-1)), 1, 1)

    def merge(acc: Column, least: Column) -> Column:
        parts, ranks = acc["parts"], acc["ranks"]

        def at(p: Column) -> Column:
            n = F.length(parts)
            left = F.when(p > 1, merged(F.concat(F.substring(parts, p - 1, F.lit(1)), least))).otherwise("")
            right = F.when(p < n - 1, merged(F.concat(least, F.substring(parts, p + 2, F.lit(1))))).otherwise("")
            return F.struct(
                F.concat(F.substring(parts, F.lit(1), p - 1), least, F.substring(parts, p + 2, n)).alias("parts"),
                F.concat(F.substring(ranks, F.lit(1), p - 2), left, right, F.substring(ranks, p + 2, n)).alias("ranks"),
            )

        return let(F.instr(ranks, least), at)

    def step(acc: Column, _: Column) -> Column:
        return let(F.array_min(F.split(acc["ranks"], "")), lambda least: F.when(least == MARK, acc).otherwise(merge(acc, least)))

    def folded(parts: Column) -> Column:
        n = F.length(parts)
        pairs_of = F.transform(F.sequence(F.lit(1), n - 1), lambda i: merged(F.substring(parts, i, F.lit(2))))
        start = F.struct(parts.alias("parts"), F.array_join(pairs_of, "").alias("ranks"))
        return F.when(n < 2, parts).otherwise(F.aggregate(F.sequence(F.lit(2), n), start, step, lambda acc: acc["parts"]))

    latin = "".join(map(chr, range(256)))
    # translate takes a character 0 for none and drops what it stands for, so the byte of id 0 goes by PART
    chars = F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), latin, single.replace("\0", PART))
    return let(F.replace(chars, F.lit(PART), F.lit("\0")) if "\0" in single else chars, folded)


def _each(chars: Column) -> Column:
    return F.slice(F.split(chars, ""), 1, F.length(chars))


def ids_of(chars: Column) -> Column:
    """Array of int of ids given as characters."""
    return F.transform(_each(chars), F.ascii)


def packed_ids(chars: Column) -> Column:
    """Ids given as characters, as little-endian unsigned 32-bit integers: the code points of the text turned round, and their bytes turned round."""
    big = F.decode(F.encode(F.reverse(chars), "UTF-32"), "ISO-8859-1")
    return F.encode(F.reverse(big), "ISO-8859-1")


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def common_words(docs: DataFrame, rank_map: RankMap, pattern: str, size: int) -> tuple[Column, int]:
    """The ids of the words that most documents hold, `size` words at most, and the number of their hash slots: a struct of three arrays by slot, `word` and `ids` of the slot's
    first word and `more`, the next ones, each as word, PART and ids, between MARKs in one string. The words of a slot are ranked and folded where the shuffle puts
    the slot, and written once; only the finished table, whose size is fixed, is handed to the tasks, as a scalar subquery. Words of over 64 bytes or with one of these marks stay out."""
    n = 1 << max(0, (size // WAYS).bit_length() - 1)
    counted = docs.select(F.explode(F.array_distinct(words_of(text_or_empty("text"), pattern))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    plain = counted.filter((F.octet_length("word") <= 64) & ~F.contains("word", F.lit(MARK)) & ~F.contains("word", F.lit(PART)))
    by_slot = W.partitionBy("slot").orderBy(F.desc("n"), "word")
    top = plain.withColumn("slot", _slot(F.col("word"), n)).withColumn("rank", F.row_number().over(by_slot)).filter(F.col("rank") <= WAYS)
    folded = top.select("slot", "rank", "word", F.get(rank_map.fold(F.array("word")), F.lit(0)).alias("ids"))
    held = folded.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "ids"))).alias("held"))
    first, more = F.get("held", F.lit(0)), F.transform(F.slice("held", 2, WAYS), lambda e: F.concat(e["word"], F.lit(PART), e["ids"], F.lit(MARK)))
    table = saved(held.select("slot", first["word"].alias("word"), first["ids"].alias("ids"), F.concat(F.lit(MARK), F.array_join(more, "")).alias("more")), "common-words")
    none = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("slot"))
    every = none.join(table, "slot", "left").select(F.struct("slot", *[F.coalesce(c, F.lit("")).alias(c) for c in ("word", "ids", "more")]).alias("s"))
    rows = every.agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(F.struct(*[F.col("s")[c].alias(c) for c in ("word", "ids", "more")])).scalar(), n


def _slot(word: Column, n: int) -> Column:
    return F.hash(word).bitwiseAND(F.lit(n - 1))


def encode_chars(docs: DataFrame, rank_map: RankMap, pattern: str | None = None, common: int = COMMON) -> DataFrame:
    """doc_id and chars of every text: its ids as characters, see encode."""
    pattern = pattern or default_pattern()
    words = words_of(text_or_empty("text"), pattern)
    if common < WAYS:
        return docs.select("doc_id", F.array_join(rank_map.fold(words), "").alias("chars"))
    known, n = common_words(docs, rank_map, pattern, common)

    def found(w: Column, held: Column, pairs: Column) -> Column:
        after = F.call_function("substring_index", held, F.concat(F.lit(MARK), w, F.lit(PART)), F.lit(-1))
        # the ids up to the next entry; nothing where the word is not held, as a slot's string begins with MARK
        return let(F.substring_index(after, MARK, 1), lambda ids: F.when(ids != "", ids).otherwise(_fold(w, rank_map.single, pairs)))

    def ids(word: Column, first: Column, more: Column, pairs: Column) -> Column:
        of = lambda w, at: F.when(F.get(word, at) == w, F.get(first, at)).otherwise(found(w, F.get(more, at), pairs))
        return let(words, lambda ws: F.zip_with(ws, F.transform(ws, lambda w: _slot(w, n)), of))

    parts = lambda t, pairs: let(t["word"], lambda word: let(t["ids"], lambda first: let(t["more"], lambda more: ids(word, first, more, pairs))))
    whole = let(F.col("_known"), lambda t: let(rank_map.pairs, lambda pairs: parts(t, pairs)))
    # a subquery may not stand in a lambda's call, so it is a column first, which Spark's optimizer takes in where it is named, once
    return docs.select("doc_id", "text", known.alias("_known")).select("doc_id", F.array_join(whole, "").alias("chars"))


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, common: int = COMMON) -> DataFrame:
    """doc_id and ids (array of int) of every text, as a byte-level BPE encoder without special tokens gives them;
    null counts as empty, an empty text has no ids, repeated rows are encoded each, an empty table gives an empty result. Documents are not
    shuffled: only words are, to count the distinct ones; those in most documents are folded once and looked up, others folded in place."""
    rank_map = RankMap(read_ranks(ranks_path or default_ranks()))
    return encode_chars(docs, rank_map, pattern, common).select("doc_id", ids_of(F.col("chars")).alias("ids"))


def decode(chars: Column, rank_map: RankMap) -> Column:
    """The bytes of ids given as characters: their pieces, concatenated."""
    return F.encode(F.array_join(let(rank_map.pieces, lambda pieces: F.transform(_each(chars), lambda c: F.get(pieces, F.ascii(c)))), ""), "ISO-8859-1")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_map = RankMap(read_ranks(default_ranks()))
    encoded = encode_chars(read(spark, sf_dir, "documents"), rank_map)
    chars = F.col("chars")
    return encoded.select("doc_id", F.length(chars).cast("long").alias("n_tokens"), F.sha2(packed_ids(chars), 256).alias("ids_sha256"), F.sha2(decode(chars, rank_map), 256).alias("decoded_sha256"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE: dict[str, str] = {}
