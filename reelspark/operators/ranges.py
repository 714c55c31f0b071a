"""Algebra of byte and sector ranges: merge, overlay, subtract, intersect, statistics, interval joins.

Ranges are rows of a key (a disc, a title), pos, size and often status: `?` not tried, `*` not trimmed, `/` not scraped,
`-` unreadable, `+` good. Nothing is collected; every window is partitioned by the key.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.sources.tables import written

RETRYABLE = ("*", "/")
PENDING = ("?", "*", "/")
LOST = ("*", "/", "-")
SECTOR = 2048
#: Narrowest bins of interval joins, in the unit of the positions; each further width is that many times wider.
BIN, WIDER, WIDTHS = 1 << 20, 64, 4


def coalesce_ranges(ranges: DataFrame, key: str = "disc_id") -> DataFrame:
    """Joins ranges that touch (end = next pos) and have the same status."""
    w = W.partitionBy(key).orderBy("pos")
    touches = (F.lag(F.col("pos") + F.col("size")).over(w) == F.col("pos")) & (F.lag("status").over(w) == F.col("status"))
    island = F.sum(F.when(touches, 0).otherwise(1)).over(w)
    return ranges.withColumn("_island", island).groupBy(key, "_island").agg(F.min("pos").alias("pos"), F.sum("size").alias("size"), F.first("status").alias("status")).drop("_island")


def merge_ranges(extents: DataFrame, key: str = "title_id", slack: int = 1) -> DataFrame:
    """Merges extents that overlap or start at most `slack` after the end so far (a one-sector hole is bridged)."""
    w = W.partitionBy(key).orderBy("start_lba", "sector_count")
    end = F.max(F.col("start_lba") + F.col("sector_count")).over(w.rowsBetween(W.unboundedPreceding, -1))
    e = extents.withColumn("_island_start", F.when(F.col("start_lba") <= end + slack, 0).otherwise(1)).withColumn("_island", F.sum("_island_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = e.groupBy(key, "_island").agg(F.min("start_lba").alias("start_lba"), F.max(F.col("start_lba") + F.col("sector_count")).alias("_end"))
    return merged.select(key, "start_lba", (F.col("_end") - F.col("start_lba")).alias("sector_count"))


def extent_offsets(extents: DataFrame, key: str = "title_id") -> DataFrame:
    """Bytes of the title before each extent."""
    before = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return extents.withColumn("byte_offset", F.coalesce(F.sum("sector_count").over(before), F.lit(0)) * SECTOR)


def _level(start: str, end: str, width: int) -> Column:
    """The narrowest of the widths that an interval fits."""
    size, level = F.col(end) - F.col(start), F.lit(WIDTHS - 1)
    for k in range(WIDTHS - 2, -1, -1):
        level = F.when(size <= width * WIDER**k, k).otherwise(level)
    return level


def _levels(side: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """Of each key the widths that a side's intervals fit, as bits: one small row a key, summed up in part before it is shuffled."""
    bit = F.call_function("shiftleft", F.lit(1), _level(start, end, width))
    return side.filter(F.col(end) > F.col(start)).groupBy(key).agg(F.bit_or(bit).alias("_mask"))


#: Roles of a placed row: met by intervals of the same width, a left one met by narrower right ones, a right one met by narrower left ones.
ROLES = {"both": 0, "left": 1, "right": 2}


def _placed(side: DataFrame, key: str, start: str, end: str, width: int, others: DataFrame, own: tuple[str, ...], low: str) -> DataFrame:
    """Rows of a side by the bins that they touch: at the width that the interval fits, in the roles `own`, and at wider ones that the other side has intervals of (others), in
    the role `low`. A row whose key the other side has not is dropped. A place is one number, 16 * bin + 4 * number of the width + role, made by built-in functions without
    lambdas, so that rows are placed by compiled code."""
    at = lambda x, k: F.floor(x / (width * WIDER**k)).cast("long")
    placed = side.filter(F.col(end) > F.col(start)).join(others, key).withColumn("_level", _level(start, end, width))
    has = lambda k: F.getbit("_mask", F.lit(k)) == 1
    none = F.array().cast("array<bigint>")

    def places(when: Column, k: int, role: str) -> Column:
        code = lambda x: at(x, k) * 16 + (4 * k + ROLES[role])
        return F.when(when, F.sequence(code(F.col(start)), code(F.col(end) - 1), F.lit(16).cast("long"))).otherwise(none)

    every = []
    for k in range(WIDTHS):
        # at its own width a row meets those that fit it (both) and narrower ones (own role); it is there only if the other side has any
        fits = F.col("_level") == k
        every.append(places(fits & has(k), k, own[0]))
        if k:
            every.append(places(fits & (F.col("_mask") % (1 << k) != 0), k, own[1]))
            every.append(places((F.col("_level") < k) & has(k), k, low))
    return placed.select("*", F.explode(F.concat(*every)).alias("_place")).drop("_level", "_mask")


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Pairs of rows of one key whose [l_start, l_end) and [r_start, r_end) overlap, with l_ and r_ columns as given.

    Bins have several widths, and an interval lies in a bin or two of the narrowest that holds it, so a whole disc is one row and not one
    a bin. Two intervals meet at the wider one's width: both fitting it, or one fitting it and the other narrower, told apart by the role, so that
    narrow ones never meet in wide bins. Which widths a key's other side has is summed up first, a few bytes a key, and rows go to those only: where all is narrow, a row
    or two an interval. A pair is kept in the bin of its later start. The join is an equi-join on the key and the place: bin, width and role."""
    a = _placed(left, key, "l_start", "l_end", width, _levels(right, key, "r_start", "r_end", width), ("both", "left"), "right")
    b = _placed(right, key, "r_start", "r_end", width, _levels(left, key, "l_start", "l_end", width), ("both", "right"), "left")
    both = a.join(b, [key, "_place"]).filter((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    later, level = F.greatest("l_start", "r_start"), F.shiftright(F.col("_place"), 2).bitwiseAND(F.lit(3))
    wide = F.lit(width)
    for k in range(1, WIDTHS):
        wide = F.when(level == k, width * WIDER**k).otherwise(wide)
    return both.filter(F.floor(later / wide).cast("long") == F.shiftright(F.col("_place"), 4)).drop("_place")


class _Overlay:
    """The records open at a position, the latest first, and the range that is being made."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, str, int]] = []
        self.at = 0
        self.run: list | None = None
        self.out: list[tuple[int, int, str]] = []

    def forward(self, to: int | None) -> None:
        while self.open and (to is None or self.at < to):
            _, _, status, end = self.open[0]
            if end <= self.at:
                heapq.heappop(self.open)
                continue
            stop = end if to is None else min(end, to)
            if self.run and self.run[1] == self.at and self.run[2] == status:
                self.run[1] = stop
            else:
                self.close()
                self.run = [self.at, stop, status]
            self.at = stop

    def add(self, seq: int, end: int, status: str, whole_end: int | None = None) -> None:
        """A record open up to end; of the same seq the one whose own end, before it was cut, is the smaller wins."""
        heapq.heappush(self.open, (-seq, end if whole_end is None else whole_end, status, end))

    def close(self) -> None:
        if self.run:
            self.out.append((self.run[0], self.run[1] - self.run[0], self.run[2]))
        self.run = None


#: Records of a cell of a disc, and cells of a disc at most.
CELL, CELLS = 1 << 20, 1024


#: Records that are laid over one another at once.
LAID = 1 << 17


def _on_top(group: np.ndarray, pos: np.ndarray, end: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records [pos, end) of groups the one on top at every place that any covers, `best` being all records from the lowest to the top one: begin and end of each stretch
    between two ends of the group's records, and the record. A record's stretches are two overlapping runs of a power of two of them, so each power is one pass over all."""
    low, span = pos.min(), int(end.max() - pos.min()) + 1
    if group[-1] and (int(group[-1]) + 1) * span >= 1 << 62:
        half = int(np.searchsorted(group, (int(group[-1]) + 1) // 2))
        rank = np.empty(len(best), np.int64)
        rank[best] = np.arange(len(best))
        parts = [_on_top(group[k] - group[k.start or 0], pos[k], end[k], np.argsort(rank[k])) for k in (slice(0, half), slice(half, None))]
        return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]]), np.concatenate([parts[0][2], parts[1][2] + half])
    base = group * span - low
    first, last = pos + base, end + base
    edges = np.unique(np.concatenate([first, last]))
    a, b = np.searchsorted(edges, first), np.searchsorted(edges, last)
    rank = np.empty(len(best), np.int32)
    rank[best] = np.arange(len(best), dtype=np.int32)
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    by_power = np.argsort(power, kind="stable")
    starts = np.searchsorted(power[by_power], np.arange(power.max() + 2))
    top = np.full(len(edges), -1, np.int32)
    for k in range(int(power.max()), -1, -1):
        held = by_power[starts[k] : starts[k + 1]]
        np.maximum.at(top, a[held], rank[held])
        np.maximum.at(top, b[held] - (1 << k), rank[held])
        if k:
            h = 1 << (k - 1)
            below = top.copy()
            np.maximum(below[h:], top[:-h], out=below[h:])
            top = below
    at = np.flatnonzero(top >= 0)
    record = best[top[at]]
    return edges[at] - base[record], edges[at + 1] - base[record], record


class _Laid:
    """Records that come in the order of group and pos, laid over one another some at a time: whole groups, or of a longer group what ends before the last position so far."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.rows, self.most, self.run = names, None, LAID, None

    def add(self, rows: pa.Table) -> Iterator[pa.Table]:
        self.rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        if len(self.rows) >= self.most:
            yield from self._take(False)
            self.most = max(LAID, 2 * len(self.rows))

    def finish(self) -> Iterator[pa.Table]:
        if self.rows is not None:
            yield from self._take(True)

    def _take(self, every: bool) -> Iterator[pa.Table]:
        t = self.rows.combine_chunks()
        group = self._groups(t)
        cut = len(t) if every else int(np.searchsorted(group, group[-1]))
        if cut:
            yield self._laid(t.slice(0, cut), group[:cut], None)
            self.rows = t.slice(cut)
        else:
            pos, end, best = self._order(t)
            to = int(pos[-1])
            yield self._laid(t, group, to)
            # what goes on from there, but not what lies under a better one as far as it goes
            kept = best[::-1][end[best[::-1]] > to]
            kept = kept[end[kept] > np.concatenate([[to], np.maximum.accumulate(end[kept])[:-1]])]
            rest = t.take(pa.array(np.sort(kept)))
            self.rows = rest.set_column(rest.schema.get_field_index("pos"), "pos", pa.array(np.maximum(rest["pos"].to_numpy(), to)))

    def _groups(self, t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), np.int64)
        for name in self.names:
            code = t[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    @staticmethod
    def _order(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pos, end and the records from the lowest to the top one: by seq; of one seq the smaller whole end, then status, is on top."""
        status = pc.rank(t["status"].combine_chunks(), tiebreaker="dense").to_numpy()
        return t["pos"].to_numpy(), t["end"].to_numpy(), np.lexsort((-status.astype(np.int64), -t["whole_end"].to_numpy(), t["seq"].to_numpy()))

    def _laid(self, t: pa.Table, group: np.ndarray, to: int | None) -> pa.Table:
        """The joined ranges of the rows, up to `to`; one that ends there, or at the end of the rows, waits for what comes."""
        pos, end, best = self._order(t)
        lo, hi, record = _on_top(group, pos, end, best)
        if to is not None:
            lo, hi, record = (x[lo < to] for x in (lo, hi, record))
            hi = np.minimum(hi, to)
        status = t["status"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[record]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] != hi[:-1]) | (status[1:] != status[:-1]) | (group[record][1:] != group[record][:-1])
        at = np.flatnonzero(new)
        out = t.take(pa.array(record[at])).drop_columns(["pos", "end", "seq", "whole_end"])
        out = out.append_column("pos", pa.array(lo[at])).append_column("finish", pa.array(hi[np.append(at[1:], len(lo))[: len(at)] - 1]))
        if self.run is not None:
            out = self._joined(out)
        self.run = out.slice(len(out) - 1) if to is not None and len(out) else None
        return out.slice(0, len(out) - 1) if self.run is not None else out

    def _joined(self, out: pa.Table) -> pa.Table:
        """out after the range that waited, as one range if they meet in one group with one status."""
        was = self.run.to_pylist()[0]
        now = out.slice(0, 1).to_pylist()
        if now and now[0]["pos"] == was["finish"] and all(now[0][c] == was[c] for c in (*self.names, "status")):
            self.run = self.run.set_column(self.run.schema.get_field_index("finish"), "finish", pa.array([now[0]["finish"]]))
            out = out.slice(1)
        return pa.concat_tables([self.run, out])


def _large(log: DataFrame, key: str, cell: int) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > cell)


def _cuts(log: DataFrame, key: str, cell: int) -> DataFrame:
    """Positions at which discs of more than `cell` records are cut, about `cell` records apart; a cut for each `cell` records of the log at most, so the table is a millionth of it."""
    steps = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    held = log.join(F.broadcast(_large(log, key, cell).select(key)), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx("pos", steps, F.lit(10_000)).alias("q"))
    every = F.ceil(F.lit(CELLS) * cell / F.col("n")).cast("int")
    picked = F.filter("q", lambda x, i: (i + 1) % every == 0)
    return held.select(F.col(key).alias("_key"), F.array_sort(F.array_distinct(picked)).alias("_cuts"))


def _swept(rows: DataFrame, names: list[str], held: list[str], kind: str, edges: bool) -> DataFrame:
    """Ranges that the records of each group of columns come to."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laid = _Laid(names)
        tables = (t for batch in batches if batch.num_rows for t in laid.add(pa.Table.from_batches([batch])))
        for t in itertools.chain(tables, laid.finish()):
            size = pc.subtract(t["finish"], t["pos"])
            out = {names[0]: t[names[0]], "pos": t["pos"], "size": size, "status": t["status"]}
            if edges:
                out["edge"] = pc.or_(pc.equal(t["pos"], t["lo"]), pc.equal(t["finish"], t["hi"]))
            yield from pa.table(out).to_batches()

    out = f"{names[0]} {kind}, pos long, size long, status string" + (", edge boolean" if edges else "")
    return rows.select(*names, *held, "pos", "end", "seq", "whole_end", "status").repartition(*names).sortWithinPartitions(*names, "pos").mapInArrow(sweep, out)


def overlay_ranges(log: DataFrame, key: str = "disc_id", cell: int = CELL) -> DataFrame:
    """Replays a log of (pos, size, status) in the order of seq: the latest record wins wherever records overlap; then W1.

    Each disc's records are laid over one another by position, many discs at once in array passes: of the records that cover a place the latest gives its status. Ties of seq go to
    the smaller end, then status. The discs' records are counted first, without a shuffle of the log; where none has more than `cell`, that is all. A disc of more
    is cut at quantiles of position into cells that are swept apart: records are cut with it, of those that
    cover a cell from end to end the latest stays (picked before the shuffle), and ranges that meet at a cut are joined again, two rows a cell. So one disc that holds all
    records runs in as many tasks as it has cells."""
    rows = log.filter("size > 0 AND pos IS NOT NULL").select(key, F.col("pos").cast("long").alias("pos"), (F.col("pos") + F.col("size")).cast("long").alias("end"), "seq", "status")
    kind = log.schema[key].dataType.simpleString()
    if _large(rows, key, cell).isEmpty():
        return _swept(rows.withColumn("whole_end", F.col("end")), [key], [], kind, False)
    cut = rows.join(F.broadcast(_cuts(rows, key, cell)), F.col(key) == F.col("_key"), "left").drop("_key")
    first, last = F.size(F.filter("_cuts", lambda c: c <= F.col("pos"))), F.size(F.filter("_cuts", lambda c: c < F.col("end")))
    bound = lambda i, other: F.coalesce(F.get("_cuts", i), F.lit(other))
    far = (1 << 63) - 1
    piece = lambda i: F.struct(i.alias("cell"), F.greatest("pos", bound(i - 1, -1)).alias("pos"), F.least("end", bound(i, far)).alias("end"), bound(i - 1, -1).alias("lo"), bound(i, far).alias("hi"))
    whole = F.array(F.struct(F.lit(0).alias("cell"), "pos", "end", F.lit(-1).cast("long").alias("lo"), F.lit(far).alias("hi")))
    cut = cut.withColumn("_p", F.explode(F.when(F.col("_cuts").isNull(), whole).otherwise(F.transform(F.sequence(first, last), piece))))
    cut = cut.select(key, "_p.*", "seq", "status", F.col("end").alias("whole_end"))
    covers = "pos = lo AND end = hi"
    over = cut.filter(covers).groupBy(key, "cell").agg(F.min(F.struct((-F.col("seq")).alias("late"), "whole_end", "status", "pos", "end")).alias("m"))
    late = over.select(key, "cell", "m.pos", "m.end", F.col("m.pos").alias("lo"), F.col("m.end").alias("hi"), (-F.col("m.late")).cast(log.schema["seq"].dataType).alias("seq"), "m.status", "m.whole_end")
    made = _swept(cut.filter(f"NOT ({covers})").unionByName(late), [key, "cell"], ["lo", "hi"], kind, True)
    # only ranges that begin or end at a cut can go on beyond it
    joined = coalesce_ranges(made.filter("edge").select(key, "pos", "size", "status"), key)
    return made.filter("NOT edge").drop("edge").unionByName(joined.select(key, "pos", "size", "status"))


def subtract_ranges(bad: DataFrame, recovered: DataFrame, key: str = "disc_id") -> DataFrame:
    """R2: what of bad no recovered range covers, split and trimmed; overlapping input counts once."""
    edges = lambda df, sign, name: df.select(key, F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(sign).alias(name)), F.struct((F.col("pos") + F.col("size")).alias("at"), F.lit(-sign).alias(name)))).alias("e")).select(key, "e.at", f"e.{name}")
    both = edges(bad, 1, "a").withColumn("b", F.lit(0)).unionByName(edges(recovered, 1, "b").withColumn("a", F.lit(0)))
    at = both.groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = W.partitionBy(key).orderBy("at")
    swept = at.select(key, "at", F.lead("at").over(w).alias("to"), F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    left = swept.filter("a > 0 AND b = 0 AND to > at").select(key, F.col("at").alias("pos"), (F.col("to") - F.col("at")).alias("size"), F.lit("-").alias("status"))
    return coalesce_ranges(left, key).select(key, "pos", "size")


def intersect_ranges(a: DataFrame, b: DataFrame, key: str = "disc_id", width: int = BIN) -> DataFrame:
    """The part that each pair of ranges has in common."""
    left = a.select(key, F.col("pos").alias("l_start"), (F.col("pos") + F.col("size")).alias("l_end"))
    right = b.select(key, F.col("pos").alias("r_start"), (F.col("pos") + F.col("size")).alias("r_end"))
    start, end = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    return overlap_join(left, right, key, width).select(key, start.alias("pos"), (end - start).alias("size"))


def range_stats(ranges: DataFrame, key: str = "disc_id") -> DataFrame:
    """A1: bytes by state, and the number of unreadable ranges."""
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("size"))), F.lit(0))
    return ranges.groupBy(key).agg(
        of("+").alias("bytes_good"), of("-").alias("bytes_unreadable"), of(*PENDING).alias("bytes_pending"), of("?").alias("bytes_nontried"),
        of(*RETRYABLE).alias("bytes_retryable"), F.sum("size").alias("bytes_total"), F.sum((F.col("status") == "-").cast("long")).alias("num_bad_ranges"),
    )


def ranges_with(ranges: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Ranges of the given states."""
    return ranges.filter(F.col("status").isin(*statuses))


def next_with(ranges: DataFrame, start: Column, status: str, key: str = "disc_id") -> DataFrame:
    """Per key the first range of the status that ends after start, clipped to start."""
    hit = ranges.filter((F.col("status") == status) & (F.col("pos") + F.col("size") > start)).withColumn("_pos", F.greatest("pos", start))
    hit = hit.withColumn("_size", F.col("pos") + F.col("size") - F.col("_pos"))
    return hit.groupBy(key).agg(F.min_by(F.struct("_pos", "_size"), "pos").alias("r")).select(key, F.col("r._pos").alias("pos"), F.col("r._size").alias("size"))


def coverage_mismatch(ranges: DataFrame, discs: DataFrame, key: str = "disc_id") -> DataFrame:
    """Discs whose map does not end where the disc does, so that resuming is unsafe."""
    ends = ranges.groupBy(key).agg(F.max(F.col("pos") + F.col("size")).alias("map_bytes"))
    joined = ends.join(discs.select(key, (F.col("capacity_sectors") * SECTOR).alias("disc_bytes")), key)
    return joined.withColumn("coverage", F.when(F.col("map_bytes") > F.col("disc_bytes"), "over").when(F.col("map_bytes") < F.col("disc_bytes"), "under").otherwise("exact"))


def normalise_range_map(ranges: DataFrame, key: str = "disc_id") -> DataFrame:
    """Gaps before and between ranges filled with `?`; overlap says whether a range begins before its predecessor's end."""
    w = W.partitionBy(key).orderBy("pos", "size")
    r = ranges.withColumn("_end", F.coalesce(F.max(F.col("pos") + F.col("size")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = r.select(key, "pos", "size", "status", (F.col("pos") < F.col("_end")).alias("overlap"))
    gaps = r.filter("pos > _end").select(key, F.col("_end").alias("pos"), (F.col("pos") - F.col("_end")).alias("size"), F.lit("?").alias("status"), F.lit(False).alias("overlap"))
    return own.unionByName(gaps)


def new_range_map(discs: DataFrame, key: str = "disc_id") -> DataFrame:
    """One range per disc, not tried."""
    return discs.select(key, F.lit(0).cast("long").alias("pos"), (F.col("capacity_sectors") * SECTOR).alias("size"), F.lit("?").alias("status"))


def bytes_bad_in_title(extents: DataFrame, bad: DataFrame, key: str = "disc_id", width: int = BIN) -> DataFrame:
    """For every title with loss, the bytes over all pairs of its extents and bad ranges that overlap.

    No pair is made: what the ranges have before an extent's end, less what they have before its begin, is the sum over its pairs, and how much they have before a position
    is a running sum over the edges of both sides. Both are cut into cells of width * WIDER**2 (4 GiB) first, so that a key runs in as many tasks as it has cells."""
    cell = width * WIDER**2

    def edges(side: DataFrame, *held: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("_start") / cell).cast("long"), F.floor((F.col("_end") - 1) / cell).cast("long"))
        cut = side.filter("_end > _start").select(*held, "_start", "_end", F.explode(cells).alias("_cell"))
        return cut.select(*held, "_cell", F.posexplode(F.array(F.greatest("_start", F.col("_cell") * cell), F.least("_end", (F.col("_cell") + 1) * cell))).alias("_closes", "_at"))

    left = edges(extents.select(key, "title_id", (F.col("start_lba") * SECTOR).cast("long").alias("_start"), ((F.col("start_lba") + F.col("sector_count")) * SECTOR).cast("long").alias("_end")), key, "title_id")
    right = edges(bad.select(key, F.col("pos").cast("long").alias("_start"), (F.col("pos") + F.col("size")).cast("long").alias("_end")), key)
    both = left.withColumn("_open", F.lit(0)).withColumn("_asks", F.lit(True)).unionByName(right.withColumn("_open", 1 - 2 * F.col("_closes")).withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # edges at one position may come in any order: one there adds nothing to what lies before it
    w = W.partitionBy(key, "_cell").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    before = F.sum("_open").over(w) * F.col("_at") - F.sum(F.col("_open") * F.col("_at")).over(w)
    asked = both.withColumn("_before", before).filter(F.col("_asks") & (F.col("_before") != 0))
    return asked.groupBy(key, "title_id").agg(F.sum((2 * F.col("_closes") - 1) * F.col("_before")).alias("bytes_bad")).filter("bytes_bad > 0")


def locate_lba(points: DataFrame, extents: DataFrame, key: str = "disc_id", width: int = BIN // SECTOR) -> DataFrame:
    """Points (key, lba) with the first extent of each title that holds them: its byte offset in the title."""
    spans = extent_offsets(extents).select(key, "title_id", "ord", "byte_offset", F.col("start_lba").alias("r_start"), (F.col("start_lba") + F.col("sector_count")).alias("r_end"))
    at = points.select(key, "lba", F.col("lba").alias("l_start"), (F.col("lba") + 1).alias("l_end")).distinct()
    hit = overlap_join(at, spans, key, width).withColumn("offset", F.col("byte_offset") + (F.col("lba") - F.col("r_start")) * SECTOR)
    return hit.groupBy(key, "title_id", "lba").agg(F.min_by("offset", "ord").alias("offset"))


def damage_severity(bad_sectors: Column, lost_ms: Column) -> Column:
    """clean, cosmetic, moderate or serious, by bad sectors and lost time."""
    return F.when(bad_sectors == 0, "clean").when((bad_sectors >= 500) | (lost_ms >= 30_000), "serious").when((bad_sectors >= 51) | (lost_ms >= 1000), "moderate").otherwise("cosmetic")


def largest_ranges(ranges: DataFrame, k: int = 50, key: str = "disc_id") -> DataFrame:
    """The k largest ranges of each key, with the number of all and whether some were left out."""
    w = W.partitionBy(key).orderBy(F.desc("size"), "pos")
    n = F.count("*").over(W.partitionBy(key))
    return ranges.withColumn("rank", F.row_number().over(w)).withColumn("num_ranges", n).filter(F.col("rank") <= k).withColumn("truncated", F.col("num_ranges") > k)


def patch_order(ranges: DataFrame, key: str = "disc_id") -> DataFrame:
    """T4: ranges still to be read, highest first, with their place."""
    w = W.partitionBy(key).orderBy(F.desc("pos"))
    return ranges_with(ranges, LOST).withColumn("place", F.row_number().over(w))


def disc_damage(log: DataFrame, extents: DataFrame, titles: DataFrame) -> DataFrame:
    """How bad is each disc, and how many of its titles are hit: R1, A1, J5 and F22 on the discs' logs. lost_ms is the play time of
    what is lost of the main title, the disc's largest. The overlaid ranges are written once, as statistics and join both read them."""
    ranges = written(overlay_ranges(log), "overlay")
    bad = ranges_with(ranges, LOST)
    hits = bytes_bad_in_title(extents, bad)
    main = titles.groupBy("disc_id").agg(F.max_by(F.struct("title_id", "size_bytes", "duration_secs"), F.struct("size_bytes", "duration_secs", (-F.col("title_id")).alias("low"))).alias("m"))
    lost = hits.join(main, "disc_id").withColumn("_ms", F.when((F.col("title_id") == F.col("m.title_id")) & (F.col("m.size_bytes") > 0), F.col("bytes_bad") * F.col("m.duration_secs") * 1000 / F.col("m.size_bytes")))
    hit = lost.groupBy("disc_id").agg(F.count("*").alias("titles_hit"), F.sum("bytes_bad").alias("title_bytes_bad"), F.max("_ms").alias("lost_ms"))
    stats = range_stats(ranges).withColumn("bad_sectors", ((F.col("bytes_unreadable") + F.col("bytes_retryable")) / SECTOR).cast("long"))
    out = stats.join(hit, "disc_id", "left").fillna(0, ["titles_hit", "title_bytes_bad", "lost_ms"])
    return out.withColumn("severity", damage_severity(F.col("bad_sectors"), F.col("lost_ms")))
