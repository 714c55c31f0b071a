"""Ordered analytics over frames, packets and read logs: gates, display order, timelines, rates, damage windows.

Windows are partitioned by title, track, file or disc, and read narrow columns only. Sequential rules are written as
running sums and maxima wherever such a form exists; the two that have none stream through a sorted shuffle of narrow columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.operators.ordered import in_order

VIDEO = 0
#: Sense keys of a wedged drive, by family.
HARDWARE, ILLEGAL_REQUEST = 4, 5
SECOND = 1_000_000_000


def _track() -> W:
    return W.partitionBy("title_id", "track").orderBy("idx")


def _sofar(w):
    return w.rowsBetween(W.unboundedPreceding, 0)


def picture_type(frames: DataFrame) -> DataFrame:
    """A frame's own type, else I for a key frame and P for others; whether it is a random access point."""
    kind = F.coalesce(F.when(F.col("ctype").isin("I", "P", "B"), F.col("ctype")), F.when(F.col("keyframe"), "I").otherwise("P"))
    return frames.select("title_id", "track", "idx", kind.alias("picture_type"), F.col("keyframe").alias("random_access"))


def keyframe_start_gate(frames: DataFrame, video: Column) -> DataFrame:
    """P10: drops a video track's frames before its first key frame."""
    seen = F.max(F.col("keyframe").cast("int")).over(_sofar(_track()))
    return frames.withColumn("_seen", seen).filter(~video | (F.col("_seen") == 1)).drop("_seen")


def resync_gate(frames: DataFrame, video: Column) -> DataFrame:
    """From a discontinuity on, video frames go until the next key frame."""
    w = _sofar(_track())
    key, cut = F.max(F.when(F.col("keyframe"), F.col("idx"))).over(w), F.max(F.when(F.col("discontinuity"), F.col("idx"))).over(w)
    f = frames.withColumn("_key", key).withColumn("_cut", cut)
    return f.filter(~video | F.col("_cut").isNull() | F.coalesce(F.col("_key") >= F.col("_cut"), F.lit(False))).drop("_key", "_cut")


#: Frames and bytes of a group that no key frame ends.
GROUP_FRAMES, GROUP_BYTES = 600, 64 << 20


class _Parts:
    """The open part of a group: its number, frames and bytes."""

    def __init__(self) -> None:
        self.part = self.frames = self.bytes = 0

    def place(self, size: int, most: int, most_bytes: int) -> int:
        if self.frames >= most or self.bytes >= most_bytes:
            self.part, self.frames, self.bytes = self.part + 1, 0, 0
        self.frames, self.bytes = self.frames + 1, self.bytes + size
        return self.part


def gop_groups(frames: DataFrame, most: int = GROUP_FRAMES, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """Groups that start at key frames; inside one a new part starts once the last has `most` frames or `most_bytes` bytes (column size; without it, or where it is
    null, frames count only).

    Sums over each group tell which ones stay below both; they are of one part. Only the others, which a sound stream has none of, stream through a task each group, three columns
    and a few numbers held, since where a part starts depends on the one before."""
    keys = ["title_id", "track", "_run"]
    f = frames.withColumn("_run", F.sum(F.col("keyframe").cast("int")).over(_sofar(_track())))
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long") if "size" in frames.columns else F.lit(0).cast("long")
    whole = W.partitionBy(*keys)
    f = f.withColumn("_cut", (F.count("*").over(whole) > most) | (F.sum(size).over(whole) >= most_bytes))

    def step(state: _Parts, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"title_id": rows["title_id"].to_numpy(), "track": rows["track"].to_numpy(), "idx": rows["idx"].to_numpy(), "part": [state.place(x, most, most_bytes) for x in rows["_size"].tolist()]})

    narrow = f.filter("_cut").select(*keys, "idx", size.alias("_size"))
    parts = in_order(narrow, keys, ["idx"], "title_id long, track long, idx long, part long", _Parts, step)
    long = f.filter("_cut").join(parts.withColumn("track", F.col("track").cast(frames.schema["track"].dataType)), ["title_id", "track", "idx"])
    both = f.filter("NOT _cut").withColumn("part", F.lit(0).cast("long")).unionByName(long)
    return both.withColumn("gop", F.col("_run")).drop("_run", "_cut")


def display_index(frames: DataFrame) -> DataFrame:
    """Display positions inside a GOP: an anchor goes after the B frames that follow it before the next anchor."""
    f = gop_groups(frames)
    keys = ["title_id", "track", "gop", "part"]
    w = W.partitionBy(*keys).orderBy("idx")
    f = f.withColumn("_b", (F.col("ctype") == "B").cast("int"))
    before_b = F.sum("_b").over(_sofar(w)) - F.col("_b")
    before_a = F.sum(1 - F.col("_b")).over(_sofar(w)) - (1 - F.col("_b"))
    f = f.withColumn("_bb", before_b).withColumn("_ab", before_a)
    # of anchors: B frames before the next anchor, or in the whole GOP after the last
    next_b = F.coalesce(F.min(F.when(F.col("_b") == 0, F.col("_bb"))).over(w.rowsBetween(1, W.unboundedFollowing)), F.sum("_b").over(W.partitionBy(*keys)))
    index = F.when(F.col("_b") == 0, F.col("_ab") + next_b).otherwise(F.col("_bb") + F.greatest(F.col("_ab") - 1, F.lit(0)))
    return f.withColumn("display", index.cast("long")).select("title_id", "track", "idx", "gop", "display")


def monotonic_ts(frames: DataFrame, video: Column) -> DataFrame:
    """Strictly rising time stamps for tracks other than video: each at least the last plus one."""
    w = _track()
    place = F.row_number().over(w)
    f = frames.withColumn("_place", place).withColumn("_lead", F.col("pts_ns") - F.col("_place"))
    return f.withColumn("ts", F.when(video, F.col("pts_ns")).otherwise(F.col("_place") + F.max("_lead").over(_sofar(w)))).drop("_place", "_lead")


BACK, STEP = 3 * SECOND, 1_000_000
CLUSTER, REACH = 20_000, 32_767


class Timeline:
    """Offset, the offset before it, the frontier of the primary track and the epoch."""

    def __init__(self, offset: int = 0, previous: int | None = None, high: int | None = None, epoch: int = 0) -> None:
        self.offset, self.previous, self.high, self.epoch = offset, previous, high, epoch

    def place(self, pts: int, primary: bool) -> tuple[int, int]:
        """Time and epoch of the next frame."""
        at, high = pts + self.offset, self.high
        if primary:
            if high is not None and at < high - BACK:
                self.previous, self.offset, self.epoch = self.offset, high + STEP - pts, self.epoch + 1
                at = high + STEP
            self.high = at if high is None else max(high, at)
        elif high is not None and self.previous is not None and at > high + BACK and high - BACK <= pts + self.previous <= high:
            at = pts + self.previous
        return at, self.epoch


def timeline_continuity(frames: DataFrame, primary: Column) -> DataFrame:
    """The primary track drives; where it falls more than 3 s back a new epoch follows 1 ms after the last. Other tracks
    ride along; a straggler of the old epoch is placed with the old offset. Titles stream through their tasks, a few numbers held."""

    def step(state: Timeline, rows: pd.DataFrame) -> pd.DataFrame:
        placed = [state.place(p, k) for p, k in zip(rows["pts_ns"].tolist(), rows["primary"].tolist())]
        return pd.DataFrame({"title_id": rows["title_id"].to_numpy(), "idx": rows["idx"].to_numpy(), "ts": [t for t, _ in placed], "epoch": [e for _, e in placed]})

    narrow = frames.select("title_id", "idx", "pts_ns", primary.alias("primary"))
    return in_order(narrow, ["title_id"], ["idx"], "title_id long, idx long, ts long, epoch int", Timeline, step)


#: Length of a frame at 24,000 / 1,001 a second, for groups that nothing else times.
FILM_FRAME = 1_001_000_000 // 24


def rebuild_pts(frames: DataFrame, explicit: Column) -> DataFrame:
    """Time and duration of each frame where only some have an explicit time (null elsewhere), by its display position.

    A GOP's anchor is its first frame in coded order that has a time. The first two neighbouring GOPs with anchors in rising order give the
    duration, the time between by the first one's frames, from that GOP on; before it film's. A GOP starts where its anchor says, else where the last one ends."""
    keys = ["title_id", "track"]
    f = gop_groups(frames.withColumn("_explicit", explicit)).join(display_index(frames).select(*keys, "idx", "display"), [*keys, "idx"])
    g = f.groupBy(*keys, "gop", "part").agg(F.count("*").alias("n"), F.min_by(F.struct("_explicit", "display"), F.when(F.col("_explicit").isNotNull(), F.col("idx"))).alias("a"))
    w = W.partitionBy(*keys).orderBy("gop", "part")
    g = g.withColumn("_k", F.row_number().over(w)).withColumn("_span", F.lead("a._explicit").over(w) - F.col("a._explicit"))
    first = F.min(F.when(F.col("_span") > 0, F.struct("_k", F.greatest(_div(F.col("_span"), F.col("n")), F.lit(1)).alias("dur")))).over(W.partitionBy(*keys))
    g = g.withColumn("_first", first)
    g = g.withColumn("dur", F.when(F.col("_k") >= F.col("_first._k"), F.col("_first.dur")).otherwise(FILM_FRAME))
    length = F.coalesce(F.sum(F.col("n") * F.col("dur")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("_before", length)
    lead = F.when(F.col("a._explicit").isNotNull(), F.col("a._explicit") - F.col("a.display") * F.col("dur") - F.col("_before"))
    g = g.withColumn("origin", F.coalesce(F.last(lead, ignorenulls=True).over(_sofar(w)), F.lit(0)) + F.col("_before"))
    out = f.join(g.select(*keys, "gop", "part", "origin", "dur"), [*keys, "gop", "part"])
    return out.select(*keys, "idx", (F.col("origin") + F.col("display") * F.col("dur")).alias("pts_ns"), F.col("dur").alias("duration_ns"))


def display_durations(sets: DataFrame) -> DataFrame:
    """Time to the next set, never negative; a clear set only closes; no duration without a time, or for the last."""
    w = _track()
    nxt = F.lead("pts_ns").over(w)
    s = sets.withColumn("duration_ns", F.when(F.col("pts_ns").isNotNull() & nxt.isNotNull(), F.greatest(nxt - F.col("pts_ns"), F.lit(0))))
    return s.filter(~F.col("is_clear"))


def _div(a: Column, b: Column | int) -> Column:
    """Whole quotient, cut towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _ticks(ns: Column, timescale: Column | int) -> Column:
    """Nanoseconds in ticks, cut towards zero, without leaving 64 bits on the way."""
    return _div(ns, SECOND) * timescale + _div((ns % SECOND) * timescale, SECOND)


def sample_durations(frames: DataFrame, timescale: int = 90_000) -> DataFrame:
    """Ticks to the next frame, none negative; the last repeats, a lone frame lasts a thirtieth of a second."""
    w = _track()
    f = frames.withColumn("_tick", _ticks(F.col("pts_ns"), timescale))
    f = f.withColumn("_delta", F.greatest(F.lead("_tick").over(w) - F.col("_tick"), F.when(F.lead("_tick").over(w).isNotNull(), 0)))
    return f.withColumn("sample_duration", F.coalesce("_delta", F.lag("_delta").over(w), F.lit(timescale // 30))).drop("_delta", "_tick")


def run_length(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Neighbours of equal value as one row: first place, value, count."""
    w = W.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    r = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return r.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.first(value).alias("value"), F.count("*").alias("count")).drop("_run")


def composition_offsets(frames: DataFrame) -> DataFrame:
    """Presentation tick less decode tick, decode ticks a sample apart in coded order, at the track's detected rate."""
    low = F.min("pts_ns").over(W.partitionBy("title_id", "track"))
    f = frames.withColumn("_place", F.row_number().over(_track()) - 1).withColumn("_from", F.col("pts_ns") - low).join(detect_rate(frames), ["title_id", "track"])
    return f.withColumn("offset", _ticks(F.col("_from"), F.col("num")) - F.col("_place") * F.col("den")).drop("_place", "_from", "num", "den")


class _Clusters:
    """The first key frame's tick, the open cluster's and its number, the last tick of each track."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.start = self.cluster = 0
        self.last: dict[int, int] = {}

    def place(self, track: int, tick: int, key: bool, video: bool) -> tuple[int, int] | None:
        """Cluster and tick of the next frame; key: a key frame of the primary video; none before the first of these."""
        first = self.base is None
        if first:
            if not key:
                return None
            self.base = tick
        tick = max(tick - self.base, 0)
        if not video and track in self.last:
            tick = max(tick, self.last[track] + 1)
        if not first and ((key and tick - self.start >= CLUSTER) or not -REACH - 1 <= tick - self.start <= REACH):
            self.cluster, self.start = self.cluster + 1, tick
        elif first:
            self.start = tick
        self.last[track] = tick
        return self.cluster, tick


def cluster_frames(frames: DataFrame, primary: Column, video: Column | None = None, tick_ns: int = 100_000) -> DataFrame:
    """Clusters from the first primary key frame on: a new one at a key frame 20,000 ticks or more after its start,
    or where a frame's tick would leave 16 bits. Ticks count from that first frame, none below 0, and rise in tracks other than video (all but the
    primary one, unless told). A cluster's first row is its cue. Titles stream through their tasks, a few numbers held."""

    def step(state: _Clusters, rows: pd.DataFrame) -> pd.DataFrame:
        placed = [state.place(*x) for x in zip(*(rows[c].tolist() for c in ("track", "tick", "key", "video")))]
        kept = [i for i, p in enumerate(placed) if p]
        out = rows.iloc[kept]
        return pd.DataFrame({"title_id": out["title_id"].to_numpy(), "idx": out["idx"].to_numpy(), "cluster": [placed[i][0] for i in kept], "tick": [placed[i][1] for i in kept]}).astype({"cluster": "int32", "tick": "int64"})

    narrow = frames.select("title_id", "idx", "track", _div(F.col("pts_ns"), tick_ns).alias("tick"), (F.col("keyframe") & primary).alias("key"), (primary if video is None else video).alias("video"))
    return in_order(narrow, ["title_id"], ["idx"], "title_id long, idx long, cluster int, tick long", _Clusters, step)


def audio_delays(frames: DataFrame, audio: Column, video: Column) -> DataFrame:
    """First audio time less first video time of the title, in ms, ties away from zero."""
    first = frames.filter(audio).groupBy("title_id", "track").agg(F.min_by("pts_ns", "idx").alias("a"))
    ref = frames.filter(video).groupBy("title_id").agg(F.min_by("pts_ns", "idx").alias("v"))
    gap = F.col("a") - F.col("v")
    ms = F.signum(gap) * F.floor((F.abs(gap) + 500_000) / 1_000_000)
    return first.join(ref, "title_id").select("title_id", "track", ms.cast("long").alias("delay_ms"))


def rebase_to_first_video(frames: DataFrame, video: Column) -> DataFrame:
    """All tracks' times from the first video frame's."""
    origin = frames.filter(video).groupBy("title_id").agg(F.min_by("pts_ns", "idx").alias("_origin"))
    return frames.join(origin, "title_id").withColumn("ts", F.col("pts_ns") - F.col("_origin")).drop("_origin")


def track_bitrate(frames: DataFrame, titles: DataFrame, primary: Column, tick_ns: int = 100_000) -> DataFrame:
    """A4: bits a second of each track's frames from the title's first primary key frame on. The time is the one that the title declares
    (titles: title_id, duration_secs), else the end of its last frame; null without time or bytes. Frames may have a duration_ns."""
    start = frames.filter(F.col("keyframe") & primary).groupBy("title_id").agg(F.min(F.struct("idx", _div(F.col("pts_ns"), tick_ns).alias("tick"))).alias("_s"))
    f = frames.join(start, "title_id").filter(F.col("idx") >= F.col("_s.idx"))
    lasts = F.coalesce(F.greatest(_div(F.col("duration_ns"), tick_ns), F.lit(1)), F.lit(0)) if "duration_ns" in frames.columns else F.lit(0)
    f = f.withColumn("_end", F.greatest(_div(F.col("pts_ns"), tick_ns) - F.col("_s.tick"), F.lit(0)) + lasts)
    g = f.groupBy("title_id", "track").agg(F.sum("size").alias("bytes"), F.max("_end").alias("_end"))
    g = g.withColumn("_end", F.max("_end").over(W.partitionBy("title_id"))).join(titles.select("title_id", "duration_secs"), "title_id", "left")
    seconds = F.when(F.col("duration_secs") > 0, F.col("duration_secs")).otherwise(F.col("_end") * tick_ns / SECOND)
    g = g.withColumn("_secs", seconds)
    return g.select("title_id", "track", "bytes", F.when((F.col("_secs") > 0) & (F.col("bytes") > 0), F.round(F.col("bytes") * 8.0 / F.col("_secs")).cast("long")).alias("bitrate"))


#: The standard rates, as numerator, denominator and the number that they are known by.
RATES = ((24000, 1001, 23.976), (24, 1, 24.0), (25, 1, 25.0), (30000, 1001, 29.97), (30, 1, 30.0), (50, 1, 50.0), (60000, 1001, 59.94), (60, 1, 60.0))


def detect_rate(frames: DataFrame) -> DataFrame:
    """The upper median of positive gaps between sorted times, as the first standard rate within half a frame a second, else in 90 kHz, one tick at least."""
    w = W.partitionBy("title_id", "track").orderBy("pts_ns", "idx")
    d = frames.withColumn("_gap", F.col("pts_ns") - F.lag("pts_ns").over(w))
    every = frames.groupBy("title_id", "track").agg(F.count("*").alias("frames"))
    d = d.filter("_gap > 0").withColumn("_place", F.row_number().over(W.partitionBy("title_id", "track").orderBy("_gap", "idx")) - 1).withColumn("_n", F.count("*").over(W.partitionBy("title_id", "track")))
    mid = d.filter(F.col("_place") == F.floor(F.col("_n") / 2)).select("title_id", "track", F.col("_gap").alias("gap"))
    fps = F.lit(float(SECOND)) / F.col("gap")
    pair = lambda n, d: F.struct((n if isinstance(n, Column) else F.lit(n)).cast("long").alias("num"), (d if isinstance(d, Column) else F.lit(d)).cast("long").alias("den"))
    own = pair(90_000, F.greatest(_ticks(F.col("gap"), 90_000), F.lit(1)))
    snapped = F.coalesce(*[F.when(F.abs(fps - known) < 0.5, pair(n, d)) for n, d, known in RATES], F.when(F.col("gap").isNotNull(), own), pair(90_000, 3003))
    return every.join(mid, ["title_id", "track"], "left").withColumn("_r", snapped).select("title_id", "track", F.col("_r.num").alias("num"), F.col("_r.den").alias("den"))


def drop_tally(units: DataFrame) -> DataFrame:
    """Kept, dropped and verified units, and the time of dropped ones, a negative time as none."""
    n = lambda c: F.sum(c.cast("long"))
    return units.groupBy("title_id", "track").agg(n(~F.col("dropped")).alias("kept"), n(F.col("dropped")).alias("dropped"), n(F.col("dropped") & F.col("verified")).alias("verified"), F.sum(F.when(F.col("dropped"), F.greatest("duration_ns", F.lit(0))).otherwise(0)).alias("dropped_ns"))


def poison_point(units: DataFrame, least: int = 200) -> DataFrame:
    """The first unit at which `least` units or more were seen and most of them are verified drops."""
    w = _sofar(_track())
    hit = F.col("dropped") & F.col("verified")
    u = units.withColumn("_seen", F.count("*").over(w)).withColumn("_bad", F.sum(hit.cast("long")).over(w))
    return u.filter(hit & (F.col("_seen") >= least) & (F.col("_bad") * 2 > F.col("_seen"))).groupBy("title_id", "track").agg(F.min("idx").alias("poison_idx"))


def seek_picture(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """For each request (title_id, t_ns) the last key picture at or before it, with its byte."""
    keys = frames.filter("keyframe").select("title_id", F.col("pts_ns").alias("t"), F.lit(0).alias("kind"), F.col("idx").alias("key_idx"), F.col("src_byte").alias("byte"))
    asked = requests.select("title_id", F.col("t_ns").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("key_idx"), F.lit(None).cast("long").alias("byte"))
    w = W.partitionBy("title_id").orderBy("t", "kind", "key_idx").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("key_idx", "byte")), ignorenulls=True).over(w)
    return keys.unionByName(asked).withColumn("_hit", last).filter("kind = 1").select("title_id", F.col("t").alias("t_ns"), "_hit.key_idx", "_hit.byte")


def display_order(frames: DataFrame) -> DataFrame:
    """A frame's place by time and by coded order."""
    return frames.withColumn("display_place", F.row_number().over(W.partitionBy("title_id", "track").orderBy("pts_ns", "idx"))).withColumn("coded_place", F.row_number().over(_track()))


# packets


def continuity_gaps(packets: DataFrame) -> DataFrame:
    """Packets whose counter neither repeats nor follows the last of their pid, or that are flagged."""
    w = W.partitionBy("file_id", "pid").orderBy("rec_no")
    last = F.lag("cc").over(w)
    gap = F.col("discontinuity_flag") | F.coalesce((F.col("cc") != F.pmod(last + 1, F.lit(16))) & (F.col("cc") != last), F.lit(False))
    return packets.withColumn("gap", gap)


def unit_ids(packets: DataFrame) -> DataFrame:
    """W6 without payload: the unit of each packet; a gap inside a unit breaks it until the next start, which is flagged."""
    w = W.partitionBy("file_id", "pid").orderBy("rec_no").rowsBetween(W.unboundedPreceding, 0)
    p = continuity_gaps(packets).withColumn("unit", F.sum(F.col("pusi").cast("long")).over(w))
    return p.groupBy("file_id", "pid", "unit").agg(
        F.count("*").alias("packets"), F.max(F.col("gap") & ~F.col("pusi")).alias("broken"), F.max(F.col("gap") & F.col("pusi")).alias("gap_at_start"), F.min("rec_no").alias("first_rec"),
    ).filter("unit > 0").withColumn("discontinuity", F.col("gap_at_start") | F.coalesce(F.lag("broken").over(W.partitionBy("file_id", "pid").orderBy("unit")), F.lit(False)))


def resolve_ep_map(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Entry points from coarse rows (clip_no, i, ref, pts, spn) and fine rows (clip_no, n, pts, spn): fine n belongs to
    the coarse row of the largest ref at most n."""
    spans = coarse.withColumn("to", F.coalesce(F.lead("ref").over(W.partitionBy("clip_no").orderBy("i")), F.lit(1 << 62)))
    c = spans.filter("to > ref").select("clip_no", F.col("ref").alias("n"), F.lit(0).alias("kind"), F.struct("pts", "spn").alias("c"), F.lit(None).cast("struct<pts:bigint,spn:bigint>").alias("f"))
    f = fine.select("clip_no", "n", F.lit(1).alias("kind"), F.lit(None).cast("struct<pts:bigint,spn:bigint>").alias("c"), F.struct(F.col("pts").cast("long").alias("pts"), F.col("spn").cast("long").alias("spn")).alias("f"))
    w = W.partitionBy("clip_no").orderBy("n", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = c.withColumn("c", F.col("c").cast("struct<pts:bigint,spn:bigint>")).unionByName(f).withColumn("at", F.last("c", ignorenulls=True).over(w)).filter("kind = 1 AND at IS NOT NULL")
    pts = F.shiftleft(F.col("at.pts"), 19) + F.shiftleft(F.col("f.pts"), 8)
    return both.select("clip_no", "n", pts.alias("pts"), F.col("at.spn").bitwiseAND(F.lit(0xFFFE0000)).bitwiseOR(F.col("f.spn")).alias("spn"))


def clip_time_extents(clips: DataFrame, ep_map: DataFrame) -> DataFrame:
    """Sectors of each clip (clip_no, ord, in_pts, out_pts): from the last entry point at or before in, else the first, to the first at
    or after out, else one past the last. One shuffle: entry points and both ends meet in one window by clip."""
    none = F.lit(None).cast("long")
    ep = ep_map.select("clip_no", F.col("pts").alias("t"), F.lit(1).alias("kind"), none.alias("ord"), "spn")
    ends = clips.select("clip_no", F.explode(F.array(F.struct(F.col("in_pts").alias("t"), F.lit(2).alias("kind")), F.struct(F.col("out_pts").alias("t"), F.lit(0).alias("kind")))).alias("e"), "ord")
    both = ep.unionByName(ends.select("clip_no", "e.t", "e.kind", "ord", none.alias("spn")))
    w = W.partitionBy("clip_no").orderBy("t", "kind", "spn")
    whole = W.partitionBy("clip_no")
    both = both.withColumn("floor", F.last("spn", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("ceil", F.first("spn", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    both = both.withColumn("low", F.min_by("spn", F.when(F.col("kind") == 1, F.col("t"))).over(whole)).withColumn("high", F.max_by("spn", F.when(F.col("kind") == 1, F.col("t"))).over(whole))
    spn = F.when(F.col("kind") == 2, F.coalesce("floor", "low")).otherwise(F.coalesce("ceil", F.col("high") + 1))
    e = both.filter("kind <> 1").withColumn("at", spn).groupBy("clip_no", "ord").agg(F.max(F.when(F.col("kind") == 2, F.col("at"))).alias("a"), F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("b"))
    start, end = F.floor(F.col("a") * 192 / 2048), F.ceil(F.col("b") * 192 / 2048)
    return e.filter("b > a").select("clip_no", "ord", start.alias("start_sector"), (end - start).alias("sectors"))


# read logs


def sense_family(key: Column) -> Column:
    """family of a sense key."""
    return F.when(key == 2, "NotReady").when(key == 3, "Medium").when(key == HARDWARE, "Hardware").when(key == ILLEGAL_REQUEST, "IllegalRequest").when(key.isNotNull(), "Other")


#: How often a failing bridge and a drive that is not ready are tried again, and the wedge that is given up.
BRIDGE_TRIES, READY_TRIES, WEDGE_LIMIT = 5, 3, 16


def read_action(status: Column, key: Column, bridge_tries: Column, ready_tries: Column, wedges: Column, batch: Column, bisecting: Column, may_bisect: Column) -> Column:
    """what follows a failed read, as far as the read itself and the counts before it tell: abort, retry, jump, bisect or skip. Whether a skip
    grows to a jump is for the damage window (W13) to say."""
    sense = F.coalesce(key, F.lit(0))
    return (
        F.when(status == 0xFF, "abort").when(~status.isin(0, 2) & (bridge_tries < BRIDGE_TRIES), "retry").when((sense == 2) & (ready_tries < READY_TRIES), "retry")
        .when(sense.isin(HARDWARE, ILLEGAL_REQUEST), F.when(wedges + 1 >= WEDGE_LIMIT, "abort").otherwise("jump")).when(sense == 1, "skip")
        .when(sense.isin(3, 11) & (batch > 1) & ~bisecting & may_bisect, "bisect").otherwise("skip")
    )


def is_wedge(key: Column) -> Column:
    return F.coalesce(key.isin(HARDWARE, ILLEGAL_REQUEST), F.lit(False))


def _disc():
    return W.partitionBy("disc_id").orderBy("seq")


#: Sectors of a jump by a batch's sector, the most that jumps in one zone grow by, and sectors jumped after a wedge in a sweep and in a patch.
JUMP_SECTORS, JUMP_GROWTH, WEDGE_SWEEP, WEDGE_PATCH = 1024, 64, 524_288, 64
#: Reads of the damage window, and the share of bad ones, in percent, from which a sweep and a patch jump.
WINDOW, SWEEP_PERCENT, PATCH_PERCENT = 16, 12, 6
#: Seconds of rest after a bridge's failure, a drive that is not ready, a wedge, any other failure, the first of a zone, and besides after a jump.
REST_BRIDGE, REST_READY, REST_WEDGE, REST, REST_ZONE, REST_JUMP = 15, 3, 30, 5, 30, 2


def read_decisions(log: DataFrame, patch: bool = False, n: int = WINDOW, percent: int | None = None) -> DataFrame:
    """F21 over a whole pass: what follows each read of a log (disc_id, seq, ok, sense_key, sectors; status, 2 if none, and bisecting, false if none), with all counters
    that earlier reads leave behind. A sweep jumps at every failed batch that counts; a patch bisects batches first, and jumps by its damage window only.

    Adds action (null after a good read, else abort, retry, jump, bisect or skip), jump_sectors, rest_secs, in_window (whether the read is one of the damage window),
    window_reads and bad_percent of the window after it, triggered, opens_zone, and recovered. Retries, wedges, recovered reads, batches to be bisected and failures inside a
    bisection stay out of the window; good reads are always in it.

    The counters are running sums in islands: since the last good read (bridge, wedges), since the last other failure (not ready), since the last n good reads in a row
    (zones, and how far jumps have grown). Reads after an abort are taken as a log has them."""
    optional = {"status": F.lit(2), "bisecting": F.lit(False)}
    l = log.select("*", *[v.alias(c) for c, v in optional.items() if c not in log.columns])
    w, yes = _sofar(_disc()), lambda c: c.cast("long")
    failed, key, bisecting = ~F.col("ok"), F.coalesce("sense_key", F.lit(0)), F.coalesce("bisecting", F.lit(False))
    status = F.coalesce("status", F.lit(2))
    within = lambda *names: _sofar(W.partitionBy("disc_id", *names).orderBy("seq"))
    l = l.withColumn("_good", F.sum(yes(F.col("ok"))).over(w)).withColumn("_failed", F.sum(yes(failed)).over(w))
    transport, bridge = failed & (status == 0xFF), failed & ~status.isin(0, 2, 0xFF)
    l = l.withColumn("_bridge", bridge & (F.sum(yes(bridge)).over(within("_good")) <= BRIDGE_TRIES))
    l = l.withColumn("_reach", failed & ~transport & ~F.col("_bridge"))
    l = l.withColumn("_else", F.sum(yes(F.col("_reach") & (key != 2))).over(within("_good")))
    waits, wedge = F.col("_reach") & (key == 2), F.col("_reach") & key.isin(HARDWARE, ILLEGAL_REQUEST)
    l = l.withColumn("_ready", waits & (F.sum(yes(waits)).over(within("_good", "_else")) <= READY_TRIES))
    l = l.withColumn("_wedges", F.sum(yes(wedge)).over(within("_good"))).withColumn("recovered", F.col("_reach") & (key == 1))
    bisect = F.col("_reach") & key.isin(3, 11) & (F.col("sectors") > 1) & ~bisecting & F.lit(patch)
    l = l.withColumn("_counts", F.col("_reach") & ~F.col("_ready") & ~wedge & ~F.col("recovered") & ~bisect)
    l = l.withColumn("in_window", F.col("ok") | (F.col("_counts") & ~bisecting))
    l = l.withColumn("_place", F.sum(yes(F.col("in_window"))).over(w))
    bad = F.sum(yes(F.col("in_window") & failed)).over(W.partitionBy("disc_id").orderBy("_place").rangeBetween(-(n - 1), 0))
    l = l.withColumn("window_reads", F.least("_place", F.lit(n))).withColumn("bad_percent", F.when(F.col("window_reads") > 0, F.floor(bad * 100 / F.col("window_reads"))).otherwise(0))
    l = l.withColumn("triggered", (F.col("window_reads") == n) & (F.col("bad_percent") >= (percent if percent is not None else PATCH_PERCENT if patch else SWEEP_PERCENT)))
    l = l.withColumn("_jump", F.col("_counts") & (F.col("triggered") if patch else F.col("triggered") | ~bisecting))
    # an epoch ends with the n-th good read in a row; its first failure outside a bisection opens its zone
    clean = F.col("ok") & (F.sum(yes(F.col("ok"))).over(within("_failed")) == n)
    l = l.withColumn("_clean", clean).withColumn("_epoch", F.sum(yes(F.col("_clean"))).over(w) - yes(F.col("_clean")))
    outer = failed & ~bisecting
    l = l.withColumn("opens_zone", outer & (F.sum(yes(outer)).over(within("_epoch")) == 1))
    ends = F.col("_clean") & F.max("opens_zone").over(W.partitionBy("disc_id", "_epoch"))
    l = l.withColumn("_ends", yes(ends)).withColumn("_grown", F.sum("_ends").over(w))
    l = l.withColumn("_grown", F.sum(yes(F.col("_jump"))).over(within("_grown")) - 1)
    far = F.lit(JUMP_SECTORS) * F.col("sectors") * F.least(F.pow(F.lit(2), F.least("_grown", F.lit(62))), F.lit(JUMP_GROWTH)).cast("long")
    given_up = wedge & (F.col("_wedges") >= WEDGE_LIMIT)
    action = (
        F.when(transport | given_up, "abort").when(F.col("_bridge") | F.col("_ready"), "retry").when(wedge | F.col("_jump"), "jump").when(bisect, "bisect").when(failed, "skip")
    )
    entry = F.col("opens_zone") & F.lit(not patch)
    rest = F.when(F.col("_bridge"), REST_BRIDGE).when(F.col("_ready"), REST_READY).when(wedge & ~given_up, REST_WEDGE).when(F.col("recovered"), REST).when(F.col("_counts"), F.when(entry, REST_ZONE).otherwise(REST) + F.when(F.col("_jump"), REST_JUMP).otherwise(0))
    jump = F.when(wedge & ~given_up, WEDGE_PATCH if patch else WEDGE_SWEEP).when(F.col("_jump"), far)
    l = l.withColumn("action", action).withColumn("jump_sectors", jump.cast("long")).withColumn("rest_secs", rest)
    return l.select(*log.columns, "action", "jump_sectors", "rest_secs", "in_window", "window_reads", "bad_percent", "triggered", "opens_zone", "recovered")


def damage_window(log: DataFrame, n: int = WINDOW, percent: int = SWEEP_PERCENT, patch: bool = False) -> DataFrame:
    """Share of bad reads among the last n of the damage window, in whole percent, at each read that is one of it (see read_decisions); only a full window triggers."""
    return read_decisions(log, patch, n, percent).filter("in_window").drop("action", "jump_sectors", "rest_secs", "in_window", "opens_zone", "recovered")


def damage_zones(log: DataFrame, good: int = 16) -> DataFrame:
    """Errors with the zone they fall in; a zone opens at an error with `good` reads or more since the last error, or the first."""
    numbered = log.withColumn("_i", F.row_number().over(_disc())).filter(~F.col("ok"))
    opens = F.when(F.lag("_i").over(_disc()).isNull() | (F.col("_i") - F.lag("_i").over(_disc()) - 1 >= good), 1).otherwise(0)
    return numbered.withColumn("opens", opens).withColumn("zone", F.sum("opens").over(_sofar(_disc()))).drop("_i")


def zone_extents(log: DataFrame) -> DataFrame:
    return damage_zones(log).groupBy("disc_id", "zone").agg(F.count("*").alias("errors"), F.min("lba").alias("first_lba"), F.max(F.col("lba") + F.col("sectors")).alias("end_lba"))


def wedge_transitions(log: DataFrame) -> DataFrame:
    """Errors of a zone that turn from another family to a wedge."""
    w = W.partitionBy("disc_id", "zone").orderBy("seq")
    z = damage_zones(log).withColumn("_wedge", is_wedge(F.col("sense_key")))
    return z.withColumn("transition", F.col("_wedge") & F.coalesce(~F.lag("_wedge").over(w), F.lit(False))).filter("transition").select("disc_id", "seq", "zone", "sense_key")


def wedge_streaks(log: DataFrame, abort: int = 16) -> DataFrame:
    """Wedge errors since the last good read, and whether they reach the point to give up."""
    run = F.sum(F.col("ok").cast("long")).over(_sofar(_disc()))
    s = log.withColumn("_run", run).withColumn("_wedge", (~F.col("ok") & is_wedge(F.col("sense_key"))).cast("long"))
    streak = F.sum("_wedge").over(_sofar(W.partitionBy("disc_id", "_run").orderBy("seq")))
    return s.withColumn("streak", streak).filter(~F.col("ok")).select("disc_id", "seq", "streak", (F.col("streak") >= abort).alias("abort"))


def pass_summary(log: DataFrame, patch: bool = False) -> DataFrame:
    """Good reads, errors, zones entered, jumps taken and recovered (marginal) reads of each disc's pass."""
    n = lambda c: F.sum(c.cast("long"))
    return read_decisions(log, patch).groupBy("disc_id").agg(
        n(F.col("ok")).alias("reads_ok"), n(~F.col("ok")).alias("errors"), n(F.col("opens_zone")).alias("zones_entered"),
        n(F.coalesce(F.col("action") == "jump", F.lit(False))).alias("jumps_taken"), n(F.col("recovered")).alias("marginal_recovered"),
    )


def ewma_scores(attempts: DataFrame) -> DataFrame:
    """Score of each handler: half the attempt's bytes a second and half the score so far, seeded by the first timed attempt;
    0 where none is timed. Written as the sum of the attempts' rates by their weights, so no handler's attempts are gathered."""
    w = W.partitionBy("disc_id", "handler")
    timed = attempts.filter("elapsed_secs > 0").withColumn("_i", F.row_number().over(w.orderBy("seq"))).withColumn("_n", F.count("*").over(w))
    weight = F.pow(F.lit(0.5), F.col("_n") - F.col("_i") + F.when(F.col("_i") == 1, 0).otherwise(1))
    score = timed.groupBy("disc_id", "handler").agg(F.sum(F.col("recovered_bytes") / F.col("elapsed_secs") * weight).alias("score"))
    every = attempts.select("disc_id", "handler").distinct()
    return every.join(score, ["disc_id", "handler"], "left").fillna(0.0, ["score"])


def handler_totals(attempts: DataFrame) -> DataFrame:
    """Recovered bytes, time and attempts of each handler."""
    return attempts.groupBy("disc_id", "handler").agg(F.sum("recovered_bytes").alias("recovered"), F.sum("elapsed_secs").alias("seconds"), F.count("*").alias("attempts"))
