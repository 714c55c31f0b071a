"""Streaming forms of the operators: windowed counts, and rules with a small state per disc, title or track.

The stateful ones take rows in the order of their sequence number; with `late` rows may come in any order that the watermark allows (ordered.keyed). Each key's
state is a few numbers, kept in the state store of the query's checkpoint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators.frames import Timeline
from reelspark.streaming.ordered import Late, keyed


def stream_event_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(window, "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def stream_progress_samples(events: DataFrame, every: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """G2 without state: the last sample of each phase in windows; two samples may be closer than the width across an edge."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy("disc_id", "phase", F.window("ts", every)).agg(F.max_by("bytes_done", "ts").alias("bytes_done")).select("disc_id", "phase", F.col("window.start").alias("start"), "bytes_done")


def stream_forced(sets: DataFrame) -> DataFrame:
    """Forced where there was a display set and all were forced; for complete or update mode."""
    return sets.groupBy("title_id", "track").agg(F.bool_and("forced").alias("forced"), F.count("*").alias("sets"))


def stream_progress_beats(samples: DataFrame, gap_us: int = 5_000_000, late: Late | None = None) -> DataFrame:
    """Samples (disc_id, phase, at_us, bytes_done) at least the gap after the last that was let through."""

    def beat(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        last = held[0] if held else None
        out = []
        for at, done in zip(rows["at_us"], rows["bytes_done"]):
            if last is None or at - last >= gap_us:
                out.append((*key, at, done))
                last = at
        return out, (last,)

    return keyed(samples, ["disc_id", "phase"], "at_us", beat, "disc_id long, phase string, at_us long, bytes_done long", "last long", "append", late)


def stream_damage_zones(log: DataFrame, good: int = 16, late: Late | None = None) -> DataFrame:
    """Errors of a read log (disc_id, seq, ok, sense_key) with their zone; the state is the reads since the last error and the zone."""

    def zones(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        since, zone = held or (-1, 0)
        out = []
        for seq, ok in zip(rows["seq"], rows["ok"]):
            if ok:
                since = since + 1 if since >= 0 else since
                continue
            opens = since < 0 or since >= good
            zone, since = zone + opens, 0
            out.append((key[0], seq, zone, opens))
        return out, (since, zone)

    return keyed(log, ["disc_id"], "seq", zones, "disc_id long, seq long, zone long, opens boolean", "since long, zone long", "append", late)


def stream_resync(frames: DataFrame, video_track: int = 0, late: Late | None = None) -> DataFrame:
    """Frames let through: from a discontinuity on, video waits for a key frame. The state is whether it waits."""

    def gate(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        waits = bool(held[0]) if held else False
        out = []
        for idx, cut, is_key in zip(rows["idx"], rows["discontinuity"], rows["keyframe"]):
            waits = bool((waits or cut) and not is_key)
            if key[1] != video_track or not waits:
                out.append((*key, idx))
        return out, (waits,)

    return keyed(frames, ["title_id", "track"], "idx", gate, "title_id long, track long, idx long", "waits boolean", "append", late)


def stream_timeline(frames: DataFrame, primary: Column, late: Late | None = None) -> DataFrame:
    """The rule of timeline_continuity with its offsets and frontier as state."""

    def follow(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        line = Timeline(*held) if held else Timeline()
        out = []
        for idx, pts, drives in zip(rows["idx"], rows["pts_ns"], rows["primary"]):
            out.append((key[0], idx, *line.place(pts, drives)))
        return out, (line.offset, line.previous, line.high, line.epoch)

    narrow = frames.select("title_id", "idx", "pts_ns", primary.alias("primary"), *([late.event_time] if late else []))
    return keyed(narrow, ["title_id"], "idx", follow, "title_id long, idx long, ts long, epoch int", "offset long, previous long, high long, epoch int", "append", late)


def stream_scores(attempts: DataFrame, late: Late | None = None) -> DataFrame:
    """Each handler's score after every micro-batch, by the rule of ewma_scores."""

    def score(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        at = held[0] if held else None
        for seconds, got in zip(rows["elapsed_secs"], rows["recovered_bytes"]):
            if seconds > 0:
                at = got / seconds if at is None else 0.5 * at + 0.5 * got / seconds
        return [(*key, at or 0.0)], (at,)

    return keyed(attempts, ["disc_id", "handler"], "seq", score, "disc_id long, handler string, score double", "score double", "update", late)


def stream_drop_tally(units: DataFrame, least: int = 200, late: Late | None = None) -> DataFrame:
    """Kept, dropped and verified units so far, and whether the track is poisoned, which stays so."""

    def tally(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        kept, dropped, verified, poisoned = held or (0, 0, 0, False)
        for gone, sure in zip(rows["dropped"], rows["verified"]):
            kept, dropped, verified = kept + (not gone), dropped + gone, verified + (gone and sure)
            poisoned = poisoned or (gone and sure and kept + dropped >= least and verified * 2 > kept + dropped)
        new = (int(kept), int(dropped), int(verified), bool(poisoned))
        return [(*key, *new)], new

    return keyed(units, ["title_id", "track"], "idx", tally, "title_id long, track long, kept long, dropped long, verified long, poisoned boolean", "kept long, dropped long, verified long, poisoned boolean", "update", late)


#: Bytes of a bin of a map's state.
MAP_BIN = 1 << 26


def laid_over(held: list[tuple[int, int, str]], new: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Ranges (pos, end, status) after new ones, in their order, lie over those held."""
    from reelspark.operators.ranges import _Overlay

    over = _Overlay()
    for pos, k, end, status in sorted([(p, -1, e, s) for p, e, s in held] + [(p, k, e, s) for k, (p, e, s) in enumerate(new)]):
        over.forward(pos)
        over.at = max(over.at, pos)
        over.add(k, end, status)
    over.forward(None)
    over.close()
    return [(p, p + n, s) for p, n, s in over.out]


def packed(ranges: list[tuple[int, int, str]]) -> tuple[bytes, list[str]]:
    """Ranges (pos, end, status) for a state: gaps and sizes in turn, small numbers that compress well, and the states of the ranges."""
    edges = np.array([x for r in ranges for x in r[:2]], np.int64)
    return np.diff(edges, prepend=0).tobytes(), [r[2] for r in ranges]


def unpacked(state: tuple[bytes, list[str]]) -> list[tuple[int, int, str]]:
    edges = np.cumsum(np.frombuffer(state[0], np.int64)).tolist()
    return list(zip(edges[::2], edges[1::2], state[1]))


def stream_range_map(log: DataFrame, width: int = MAP_BIN) -> DataFrame:
    """G1: changes of each disc's map by micro-batch: for every bin of positions that new records (disc_id, seq, pos, size, status) touch, its number, the bin's version and the ranges in it as
    arrays, cut at the bin's ends. The latest of each bin, joined by coalesce_ranges, is the map (latest_map). New records lie over the map in the order of seq; each bin of a disc is
    a key of its own, so a disc's records are dealt over all tasks; a batch reads and writes the buckets of bins (ordered.keyed) that it touches."""
    last = F.floor((F.col("pos") + F.col("size") - 1) / width).cast("long")
    bins = F.explode(F.sequence(F.floor(F.col("pos") / width).cast("long"), last)).alias("bin")
    cut = log.filter("size > 0").select("disc_id", "seq", "pos", (F.col("pos") + F.col("size")).alias("finish"), "status", bins)
    low, high = F.col("bin") * width, (F.col("bin") + 1) * width
    cut = cut.select("disc_id", "bin", "seq", F.greatest("pos", low).alias("pos"), F.least("finish", high).alias("finish"), "status")

    def lay(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        version, ranges = (held[0], unpacked(held[1:])) if held else (0, [])
        ranges = laid_over(ranges, list(zip(rows["pos"], rows["finish"], rows["status"])))
        pos, end, status = (list(c) for c in zip(*ranges))
        return [(key[0], version + 1, key[1], pos, [e - p for p, e in zip(pos, end)], status)], (version + 1, *packed(ranges))

    out = "disc_id long, version long, bin long, pos array<long>, size array<long>, status array<string>"
    return keyed(cut, ["disc_id", "bin"], "seq", lay, out, "", "append")


def latest_map(changes: DataFrame) -> DataFrame:
    """The map that stream_range_map's rows come to: disc_id, pos, size, status."""
    from reelspark.operators.ranges import coalesce_ranges

    last = changes.groupBy("disc_id", "bin").agg(F.max_by(F.struct("pos", "size", "status"), "version").alias("m"))
    r = last.select("disc_id", F.explode(F.arrays_zip("m.pos", "m.size", "m.status")).alias("r")).select("disc_id", "r.*")
    return coalesce_ranges(r).select("disc_id", "pos", "size", "status")


def stream_video_index(frames: DataFrame, late: Late | None = None) -> DataFrame:
    """N and record of each frame of the primary video (title_id, idx and what video_index_lines reads), in the order of idx; the state is each title's counter."""

    def number(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple]:
        start = held[0] if held else 0
        records = rows["record"]
        return [(key[0], n, r) for n, r in enumerate(records, start)], (start + len(records),)

    from reelspark.sources.files import picture_record

    narrow = frames.select("title_id", "idx", picture_record(frames).alias("record"), *([late.event_time] if late else []))
    out = keyed(narrow, ["title_id"], "idx", number, "title_id long, n long, record string", "n long", "append", late)
    return out.select("title_id", "n", F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit(","), F.col("record")).alias("line"))


def on_progress(samples: DataFrame, callback, checkpoint: str):
    """A query that calls callback(rows, batch number) with each micro-batch of samples."""
    return samples.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
