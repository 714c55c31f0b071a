"""Conversation repair: the cheapest edits that make roles alternate, by Viterbi over chunks that start from speculative costs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import WHITE, read, saved

#: What edits cost, and an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Where a conversation can stand: at its start, after the system row, after a user, after an assistant. It may end at the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an insertion or a new role has there, and where it leads.
GIVEN = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Kinds of rows by what may be kept where: the first letter of the role, or none of the three.
KINDS = "sua"
#: Rows of a chunk at most.
CHUNK = 256
FAR = 1 << 30


def _kept(place: int, kind: int) -> int | None:
    """Where keeping a row of a kind leads from a place; None where its role may not stand."""
    if kind == 0:
        return SYSTEM if place == START else None
    if kind == 1:
        return USER if place != USER else None
    return ASSISTANT if kind == 2 and place == USER else None


KEPT = [[_kept(p, k) for k in range(4)] for p in range(4)]


def code_of(kind: int, deleted: bool, truncated: bool) -> int:
    """A row as a number: its kind (0 to 2 for s, u, a, 3 for others), whether it must go, whether it is truncated."""
    return kind + 4 * deleted + 8 * truncated


def _with_insertions(cost: list[int]) -> list[int]:
    """Costs from each place where rows may be inserted first; two are enough to come round."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[GIVEN[p][1]]) for p, c in enumerate(cost)]
    return cost


ENDING = _with_insertions([0, FAR, FAR, 0])


def _before(code: int, after: list[int]) -> list[int]:
    """Costs from each place in front of a row, of those after it (insertions before the row included)."""
    kind, deleted, truncated = code & 3, code & 4, TRUNCATED if code & 8 else 0
    if deleted:
        return _with_insertions([DELETE + c for c in after])
    out = []
    for p in range(4):
        best = min(DELETE + after[p], REROLE + truncated + after[GIVEN[p][1]])
        kept = KEPT[p][kind]
        out.append(best if kept is None else min(best, truncated + after[kept]))
    return _with_insertions(out)


def backward(codes: bytes, after: list[int]) -> list[int]:
    """Costs from each place in front of a chunk, of those after it."""
    for code in reversed(codes):
        after = _before(code, after)
    return after


def trace(codes: bytes, after: list[int], place: int, end: bool) -> tuple[list[tuple[str, int]], int]:
    """The edits of a chunk from a place on, the least letters first among the cheapest: (letter, place it leads to), and the last place. An
    insertion that follows the chunk's last row belongs to the next chunk, or here if it is the conversation's end."""
    costs = [after]
    for code in reversed(codes):
        costs.append(_before(code, costs[-1]))
    edits = []
    for i, code in enumerate(codes):
        here, nxt = costs[len(codes) - i], costs[len(codes) - i - 1]
        kind, deleted, truncated = code & 3, code & 4, TRUNCATED if code & 8 else 0
        while True:
            left, given = here[place], GIVEN[place][1]
            kept = None if deleted else KEPT[place][kind]
            if DELETE + nxt[place] == left:
                edits.append(("D", place))
                break
            if INSERT + here[given] == left:
                edits.append(("I", given))
                place = given
            elif kept is not None and truncated + nxt[kept] == left:
                edits.append(("K", kept))
                place = kept
                break
            else:
                edits.append(("R", given))
                place = given
                break
    while end and after[place] and INSERT + after[GIVEN[place][1]] == after[place]:
        place = GIVEN[place][1]
        edits.append(("I", place))
    return edits, place


def _text(name: str) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of rows (nulls in role and text: one space) damaged by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties the
    text, 2 removes its end marks, 3 repeats it, 4 makes it the user's. A null in the key counts as one space, too."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.filter("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


#: The order of a conversation's rows.
ORDER = ["known", "at", "role", "digest"]
#: A row and what comes of it.
ROW = "key string, known boolean, at long, role string, digest string"


def faulted(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with equal ones as one: the conversation as text (key), its place (known: whether it has a turn, at: the turn or 0,
    role, digest of the text), text, copies and the fault of the first copy: blank, duplicate, truncated or none. Further copies are blank or duplicates.

    A conversation's order is by turn, nulls first, then role and digest. What was seen earlier is told by a minimum for each conversation, role
    and text; sums and minima are made in part before they are shuffled, so many copies travel as one row."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    r = rows.select(key.alias("key"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"), "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text", "copies")
    r = saved(r.groupBy("key", *ORDER).agg(F.sum("copies").alias("copies"), F.first("text").alias("text")), "repair-rows")
    again = r.groupBy("key", "role", "digest").agg(F.min(F.struct("known", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    r = r.join(again, ["key", "role", "digest"], "left")
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    later = F.coalesce(F.struct("known", "at") > F.col("first"), F.lit(False))
    fault = F.when(last == "", "blank").when(later, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    return r.select("key", *ORDER, "text", "copies", fault.alias("fault"))


def _codes(role: str, fault: str, copies: int) -> bytes:
    first = code_of(KINDS.find(role[0]) % 4 if role else 3, fault in ("blank", "duplicate"), fault == "truncated")
    return bytes([first]) + bytes([code_of(first & 3, True, False)]) * (copies - 1)


def chunks_of(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """Chunks of `most` rows or more (a row and its copies stay together) of each conversation, in order: key, the place of the first row, codes, idx from
    0 and whether it is the last. Rows are dealt out by ranges of conversation and place, so a long conversation is in many tasks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, codes = None, bytearray()
        for batch in batches:
            out = []
            for key, known, at, role, digest, copies, fault in batch.itertuples(index=False):
                if held and (held[0] != key or len(codes) >= most):
                    out.append((*held, bytes(codes)))
                    held, codes = None, bytearray()
                held = held or (key, known, at, role, digest)
                codes += _codes(role, fault, copies)
            yield pd.DataFrame(out, columns=["key", *ORDER, "codes"])
        if held:
            yield pd.DataFrame([(*held, bytes(codes))], columns=["key", *ORDER, "codes"])

    narrow = rows.select("key", *ORDER, "copies", "fault")
    made = saved(narrow.repartitionByRange("key", *ORDER).sortWithinPartitions("key", *ORDER).mapInPandas(cut, f"{ROW}, codes binary"), "repair-chunks")
    w = W.partitionBy("key").orderBy(*ORDER)
    # only places are numbered, the codes come back by a join
    numbered = made.select("key", *ORDER, (F.row_number().over(w) - 1).alias("idx"), F.lead("at").over(w).isNull().alias("last"))
    return made.join(numbered, ["key", *ORDER])


def _parallel(a: Column, b: Column) -> Column:
    """Whether two cost vectors differ by the same in all places."""
    gaps = F.zip_with(a, b, lambda x, y: x - y)
    return F.array_max(gaps) == F.array_min(gaps)


COSTS = f"{ROW}, idx int, last boolean, codes binary, after array<long>, before array<long>"


def _gone_through(chunks: DataFrame) -> DataFrame:
    """Costs before each chunk that has none yet, from those after it."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["before"] = [backward(c, [int(x) for x in a]) if b is None else b for c, a, b in zip(batch["codes"], batch["after"], batch["before"])]
            yield batch

    return chunks.select(*[c.split()[0] for c in COSTS.split(", ")]).mapInPandas(go, COSTS)


def costed(chunks: DataFrame) -> DataFrame:
    """Chunks with costs after and before them, each up to a constant, and for a conversation's first chunk the whole cost.

    The last chunk of a conversation starts from the true costs of its end, every other from a guess, all at once. A chunk whose guess is not parallel to what the next
    one came to is gone through again from that, until all are parallel: the constants' sum and the first chunk's costs are the whole cost. At most as many passes as the
    longest conversation has chunks; two or three where paths meet inside a chunk, as they do unless nearly every row must go."""
    array = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    none = F.lit(None).cast("array<bigint>")
    c = saved(_gone_through(chunks.withColumn("after", F.when(F.col("last"), array(ENDING)).otherwise(array([0] * 4))).withColumn("before", none)), "repair-costs")
    while True:
        later = c.filter("idx > 0").select("key", (F.col("idx") - 1).alias("idx"), F.col("before").alias("next"))
        c = c.join(later, ["key", "idx"], "left").withColumn("stale", F.col("next").isNotNull() & ~_parallel(F.col("after"), F.col("next")))
        if c.filter("stale").isEmpty():
            break
        again = c.withColumn("after", F.when(F.col("stale"), F.col("next")).otherwise(F.col("after"))).withColumn("before", F.when(~F.col("stale"), F.col("before")))
        c = saved(_gone_through(again), "repair-costs")
    shift = c.groupBy("key").agg(F.sum(F.coalesce(F.get("next", F.lit(0)) - F.get("after", F.lit(0)), F.lit(0))).alias("shift"))
    c = c.join(shift, "key").withColumn("cost", F.when(F.col("idx") == 0, F.get("before", F.lit(START)) + F.col("shift")))
    return c.select("key", *ORDER, "codes", "after", "last", "cost")


class _Repair:
    """One conversation so far: where it stands, the edits, the digest of what it becomes, counts of faults, pairs and turns."""

    def __init__(self) -> None:
        self.place, self.cost, self.audit, self.edits, self.taken = START, 0, [], [], 0
        self.sha, self.lines = hashlib.sha256(), 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.turns = 0

    def chunk(self, codes: bytes, after: list[int], last: bool, cost: int | None) -> None:
        self.cost = self.cost if cost is None else cost
        self.edits, self.place = trace(codes, after, self.place, last)
        self.taken = 0
        self.audit.append("".join(e for e, _ in self.edits))

    def row(self, known: bool, at: int, role: str, text: str, copies: int, fault: str) -> None:
        initial = role[:1]
        self.illegal += copies - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        if fault in self.faults:
            self.faults[fault] += 1
        self.faults["blank" if fault == "blank" else "duplicate"] += copies - 1
        if known:
            if self.high is None or at != self.high:
                self.turns += 1
            self.low, self.high = at if self.low is None else self.low, at
        while copies:
            letter, to = self.edits[self.taken]
            self.taken += 1
            copies -= letter != "I"
            if letter != "D":
                self.line(role if letter == "K" else GIVEN_ROLE[to], "" if letter == "I" else text)

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1

    def done(self) -> tuple:
        for _, to in self.edits[self.taken :]:
            self.line(GIVEN_ROLE[to], "")
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


GIVEN_ROLE = {USER: "user", ASSISTANT: "assistant"}
REPAIRED = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text, copies): gaps in its turns, rows of each fault, illegal neighbours, the cheapest
    edits and what they cost, and the digest of the repaired conversation.

    A digest runs through a conversation from end to end, so its rows stream through one task in order, a batch and a chunk's edits held; all costs are known by
    then. See the query's contract for faults and edits; null and repeated rows, see faulted. Without rows there is no row."""
    f = saved(faulted(rows), "repair-faults")
    c = costed(chunks_of(f, most))
    none = {"text": "string", "copies": "long", "fault": "string"}
    heads = c.select("key", *ORDER, F.lit(0).alias("what"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()], "codes", F.col("after").cast("array<long>").alias("after"), "last", "cost")
    body = f.select("key", *ORDER, F.lit(1).alias("what"), *none, F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<long>").alias("after"), F.lit(None).cast("boolean").alias("last"), F.lit(None).cast("long").alias("cost"))
    names = [c.split()[0] for c in REPAIRED.split(", ")]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, known, at, role, what, text, copies, fault, codes, after, last, cost in zip(*(batch[n].tolist() for n in ("key", "known", "at", "role", "what", "text", "copies", "fault", "codes", "after", "last", "cost"))):
                if k != key:
                    if state is not None:
                        out.append((key, *state.done()))
                    key, state = k, _Repair()
                if what:
                    state.row(known, at, role, text, int(copies), fault)
                else:
                    state.chunk(codes, [int(x) for x in after], bool(last), None if pd.isna(cost) else int(cost))
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([(key, *state.done())], columns=names)

    return heads.unionByName(body).repartition("key").sortWithinPartitions("key", *ORDER, "what").mapInPandas(follow, REPAIRED)


def repair_conversations(conversations: DataFrame, rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """repaired() of rows, with one row for every conv_id of conversations (null too): zeros, no edits and the empty text's digest where it has none. An empty
    table gives none; further columns are not read."""
    every = conversations.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    got = every.join(repaired(rows, most), "key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return got.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair_conversations(conversations, damage(conversations))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE: dict[str, str] = {}
