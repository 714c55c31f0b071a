"""Queries that drain streams over the views, and files that are written and read back; their DuckDB SQL is mostly that of the batch operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.jobs import disc_queries, file_queries, frame_queries, range_queries
from reelspark.operators import catalog as C
from reelspark.operators import dvd as D
from reelspark.operators import packets as K
from reelspark.sources import files as X
from reelspark.sources.records import write_keyed
from reelspark.sources.tables import few_listing_tasks, shared_folder, written
from reelspark.sources.views import spark_view as view
from reelspark.sources.views import with_views
from reelspark.streaming import stateful as G


def drained(rows: DataFrame, order: str, make, schema: str, mode: str = "append", parts: int = 3) -> DataFrame:
    """What a stream has given once all rows went through it, with the number of the micro-batch. The rows come in `parts` by `order`: each is added to the source's folder, then
    the query is started anew on its checkpoint and runs until nothing is left, so state goes on from run to run. The rows are written once, as they are read for the cuts and for each part."""
    spark = rows.sparkSession
    rows = written(rows, "stream-rows")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    cuts = rows.select(F.percentile_approx(order, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(1000))).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c < F.col(order))) if cuts else F.lit(0)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{folder}/out")

    for k in range(parts):
        rows.filter(part == k).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        make(source).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/out")


def latest(out: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that are given anew when they change the last of each key."""
    names = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r")).select(*keys, "r.*")


def g1(s, d):
    kind = "disc_id long, version long, bin long, pos array<long>, size array<long>, status array<string>"
    return G.latest_map(drained(view(s, d, "range_log"), "seq", lambda r: G.stream_range_map(r, 1 << 23), kind))


def samples(s, d):
    e = view(s, d, "events")
    return e.select(F.col("user_id").alias("disc_id"), F.col("event_type").alias("phase"), (F.col("event_id") * 700_000).alias("at_us"), F.col("event_id").alias("bytes_done"))


def g2(s, d):
    return drained(samples(s, d), "at_us", G.stream_progress_beats, "disc_id long, phase string, at_us long, bytes_done long").drop("batch")


def g3(s, d):
    e = view(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    out = drained(e, "event_id", lambda r: G.stream_event_counts(r, "1 hour", "365 days"), "start timestamp, kind string, n long", "update")
    return latest(out, ["start", "kind"]).select(F.unix_micros("start").alias("start_us"), "kind", "n")


def g4(s, d):
    return drained(view(s, d, "read_log").drop("ts"), "seq", G.stream_damage_zones, "disc_id long, seq long, zone long, opens boolean").select("disc_id", "seq", "zone")


def g5(s, d):
    """Packets in the order of their records, then one that ends each pid."""
    p = disc_queries.packets(s, d).withColumn("marker", F.lit(False)).withColumn("cc", F.col("cc").cast("int"))
    ends = p.select("file_id", "pid").distinct().select("file_id", "pid", F.lit((1 << 63) - 1).alias("rec_no"), F.lit(False).alias("pusi"), F.lit(0).alias("cc"), F.lit(False).alias("discontinuity_flag"), F.lit(b"").alias("payload"), F.lit(False).alias("marker"))
    rows = p.unionByName(ends)
    return drained(rows, "rec_no", K.stream_demux, K.UNIT).select("file_id", "pid", "first_rec", "discontinuity", F.hex("data").alias("data"))


def frames(s, d):
    return view(s, d, "frames")


def g8(s, d):
    out = drained(frame_queries.units(s, d), "idx", lambda r: G.stream_drop_tally(r, 5), "title_id long, track long, kept long, dropped long, verified long, poisoned boolean", "update")
    return latest(out, ["title_id", "track"])


def g9(s, d):
    sets = frames(s, d).select("title_id", "track", "idx", F.when(F.col("ctype") != "P", F.col("ctype") == "B").alias("forced")).filter("forced IS NOT NULL")
    return latest(drained(sets, "idx", G.stream_forced, "title_id long, track long, forced boolean, sets long", "update"), ["title_id", "track"])


def g10(s, d):
    out = drained(view(s, d, "attempts"), "seq", G.stream_scores, "disc_id long, handler string, score double", "update")
    return latest(out, ["disc_id", "handler"])


def u3(s, d):
    """Bytes of the samples that each callback got, by phase."""
    rows = samples(s, d)
    return drained(rows, "at_us", lambda r: r, "disc_id long, phase string, at_us long, bytes_done long").groupBy("phase").agg(F.count("*").alias("samples"), F.sum("bytes_done").alias("bytes"), F.max("at_us").alias("last_us"))


def u1(s, d):
    """Two registered sources, audio and subtitle labels; the best of each disc."""
    for kind in ("audio", "subtitle"):
        C.register_label_source(f"query_{kind}", lambda spark, where, kind=kind: view(spark, where, "labels_src").filter(F.col("stream_type") == kind).drop("source_name"))
    own = C.registered_labels(s, d).filter(F.col("source_name").isin("query_audio", "query_subtitle"))
    return C.select_label_source(own).select("disc_id", "source_name", "doc_id")


def u2(s, d):
    """A parser that counts a unit's bytes and takes its first."""

    def parse(batches):
        for b in batches:
            data = b.column("data").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("pid"), b.column("first_rec"), pa.array([len(x) for x in data], pa.int64()), pa.array([x[0] if x else None for x in data], pa.int64())], names=["file_id", "pid", "first_rec", "bytes", "lead"])

    return D.with_frame_parser(K.assemble_pes(disc_queries.packets(s, d)), parse, "file_id long, pid long, first_rec long, bytes long, lead long")


def _folder(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _of(name: str, kind: str = "long"):
    return F.regexp_extract("file", rf"{name}=([^/]*)", 1).cast(kind).alias(name)


def s3(s, d):
    """Maps written, a file a disc, and read again."""
    path = _folder(s, "maps")
    X.write_range_map(range_queries.overlaid(s, d), path)
    ranges, _ = X.read_range_map(s, path)
    return ranges.select(_of("disc_id"), "pos", "size", "status")


def s1(s, d):
    """Maps with comments, a current-position line and wrong lines: what is read, and what is told as wrong."""
    path = _folder(s, "maps")
    log = view(s, d, "range_log")
    wrong = F.when(F.col("seq") % 9 == 1, "0x10 + 1\n").when(F.col("seq") % 9 == 2, "# key\n").when(F.col("seq") % 9 == 3, "zz 10 +\n").when(F.col("seq") % 9 == 4, "0x1 0x0 -\n").when(F.col("seq") % 9 == 5, "10 20 !\n").otherwise("")
    line = F.concat(F.format_string("0x%x %X %s\n", "pos", "size", "status"), wrong)
    write_keyed(log.select("disc_id", "seq", line.alias("line")), path, "disc_id", ["seq"], "line", "map.txt")
    # a file is a disc: its number is taken from the path once a group and not once a line
    groups = X.range_map_lines(s, path).groupBy("file", "status", "error").agg(F.count("*").alias("lines"), F.sum("pos").alias("pos"), F.sum("size").alias("size"))
    return groups.select(_of("disc_id"), "status", "error", "lines", "pos", "size")


def index(s, d):
    """Indexes, a file a title: a header, then the pictures of the primary track, some without a number of their own, and after those of one kind a second section."""
    path = _folder(s, "index")
    lines = X.video_index_lines(frames(s, d), F.col("track") == 0)
    head = lines.filter("n = 0").select("title_id", F.lit(-1).cast("long").alias("n"), F.lit('{"format":"fvi"}').alias("line"))
    second = lines.filter("n = 3").select("title_id", F.lit(2).cast("long").alias("n"), F.lit('{"format":"more"}').alias("line"))
    rows = lines.select("title_id", F.col("n").cast("long").alias("n"), "line").unionByName(head).withColumn("k", F.lit(1)).unionByName(second.withColumn("k", F.lit(2)))
    write_keyed(rows.withColumn("line", F.concat("line", F.lit("\n"))), path, "title_id", ["n", "k"], "line", "index.jsonl")
    return X.read_video_index(s, path)


def s5(s, d):
    return index(s, d)[1].select(_of("title_id"), "section", "line_no", "n", "pts", "type", "key", "size", F.col("src.sector").alias("sector"), F.col("src.byte").alias("byte"))


def w29(s, d):
    """Sections that do not begin at 0 are told at each of their pictures."""
    return X.validate_video_index(index(s, d)[1]).select(_of("title_id"), "section", "line_no", "error")


def s7(s, d):
    """The packets of each file as 192-byte records, the last cut short in every file, read back from the folder."""
    path = _folder(s, "packets")
    p = view(s, d, "ts_packets")
    last = F.max("rec_no").over(frames_of())
    body = F.unhex(F.concat(F.lpad(F.hex("rec_no"), 8, "0"), F.lit("47"), F.lpad(F.hex("pid"), 4, "0"), F.lit("AB" * 185)))
    rows = p.select("file_id", "rec_no", F.when(F.col("rec_no") == last, F.substring(body, 1, 100)).otherwise(body).alias("data"))
    write_keyed(rows, path, "file_id", ["rec_no"], "data", "p.m2ts")
    got = X.read_source_packets(s, path, range_bytes=192 * 40)
    return got.select(_of("file_id"), F.col("rec_no").alias("place"), F.conv(F.hex(F.substring("bytes", 1, 4)), 16, 10).cast("long").alias("rec_no"), F.conv(F.hex(F.substring("bytes", 6, 2)), 16, 10).cast("long").alias("pid"), F.length("bytes").cast("long").alias("bytes"), "error")


def frames_of():
    from pyspark.sql import Window

    return Window.partitionBy("file_id")


def s8(s, d):
    """Each title's frames as a wire file, read back by ranges."""
    path = _folder(s, "wire")
    w = X.frame_wire(file_queries.wire_frames(s, d)).filter("error IS NULL")
    write_keyed(w, path, "title_id", ["idx"], "wire", "f.wire")
    got = X.read_frame_wire(s, path, range_bytes=1000)
    return got.select(_of("title_id"), "idx", F.col("track").cast("long").alias("track"), "pts", "keyframe", "duration_ns", F.col("data").cast("string").alias("data"), "error")


def s17(s, d):
    """Video tracks written, a folder each, and read again."""
    path = _folder(s, "tracks")
    kind = F.when(F.col("track") == 0, "video").otherwise("audio")
    X.write_tracks(frames(s, d).withColumn("kind", kind), path, kind="video")
    with few_listing_tasks(s):
        tracks = s.read.parquet(path)
    return tracks.select(F.col("title_id").cast("long").alias("title_id"), F.col("track").cast("long").alias("track"), "idx", "pts_ns", "kind")


def s18(s, d):
    n, size = X.count_sink(frames(s, d))
    return s.createDataFrame([(n, size)], "frames long, bytes long")


QUERIES = {
    "g1_stream_range_map": g1,
    "g2_stream_progress_beats": g2,
    "g3_stream_event_counts": g3,
    "g4_stream_damage_zones": g4,
    "g5_stream_demux": g5,
    "g6_stream_resync": lambda s, d: drained(frames(s, d), "idx", G.stream_resync, "title_id long, track long, idx long").drop("batch"),
    "g7_stream_timeline": lambda s, d: drained(frames(s, d), "idx", lambda r: G.stream_timeline(r, F.col("track") == 0), "title_id long, idx long, ts long, epoch int").drop("batch"),
    "g8_stream_drop_tally": g8,
    "g9_stream_forced": g9,
    "g10_stream_scores": g10,
    "g11_stream_video_index": lambda s, d: drained(frames(s, d).filter("track = 0"), "idx", G.stream_video_index, "title_id long, n long, line string").drop("batch"),
    "u1_label_sources": u1,
    "u2_frame_parser": u2,
    "u3_progress_callback": u3,
    "s1_read_range_map": s1,
    "s3_write_range_map": s3,
    "s5_read_video_index": s5,
    "w29_validate_video_index": w29,
    "s7_read_source_packets": s7,
    "s8_read_wire_ranges": s8,
    "s17_write_tracks": s17,
    "s18_count_sink": s18,
}

_B = frame_queries.ORACLE
_FR = with_views("frames")
_INDEX = _FR + """, v AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY idx) - 1 AS n, count(*) OVER (PARTITION BY title_id) AS c FROM frames WHERE track = 0),
x AS (SELECT title_id, CASE WHEN n >= 3 THEN 2 ELSE 1 END AS section, n + CASE WHEN n >= 3 THEN 2 ELSE 1 END AS line_no, n, pts_ns AS pts, ctype AS type, keyframe AS key, size, src_byte // 2048 AS sector, src_byte % 2048 AS byte FROM v)"""
_SRC = with_views("labels_src")
ORACLE = {
    "g1_stream_range_map": range_queries.LOG + range_queries.OVERLAY + "SELECT disc_id, pos, size, status FROM ranges",
    "g2_stream_progress_beats": """WITH RECURSIVE e AS (SELECT user_id AS disc_id, event_type AS phase, event_id * 700000 AS at_us, event_id AS bytes_done FROM events),
r AS (SELECT disc_id, phase, min(at_us) AS at_us FROM e GROUP BY ALL UNION ALL SELECT disc_id, phase, nxt FROM (SELECT r.disc_id, r.phase, (SELECT min(e.at_us) FROM e WHERE e.disc_id = r.disc_id AND e.phase = r.phase AND e.at_us >= r.at_us + 5000000) AS nxt FROM r) WHERE nxt IS NOT NULL)
SELECT disc_id, phase, at_us, bytes_done FROM r JOIN e USING (disc_id, phase, at_us)""",
    "g3_stream_event_counts": "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "g4_stream_damage_zones": frame_queries.LG + frame_queries._ERR + "SELECT disc_id, seq, zone FROM z",
    "g5_stream_demux": disc_queries.ORACLE["w6_assemble_pes"],
    "g6_stream_resync": _B["w7_resync_gate"],
    "g7_stream_timeline": _B["w12_timeline_continuity"],
    "g8_stream_drop_tally": frame_queries.FR + frame_queries._UNITS + """, v AS (SELECT *, count(*) OVER w AS seen, count(*) FILTER (dropped AND verified) OVER w AS bad FROM u WINDOW w AS (PARTITION BY title_id, track ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT title_id, track, count(*) FILTER (NOT dropped) AS kept, count(*) FILTER (dropped) AS dropped, count(*) FILTER (dropped AND verified) AS verified, bool_or(dropped AND verified AND seen >= 5 AND bad * 2 > seen) AS poisoned FROM v GROUP BY ALL""",
    "g9_stream_forced": _FR + "SELECT title_id, track, bool_and(ctype = 'B') AS forced, count(*) AS sets FROM frames WHERE ctype <> 'P' GROUP BY ALL",
    "g10_stream_scores": _B["w25_ewma_scores"],
    "g11_stream_video_index": _FR + """, f AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY idx) - 1 AS n FROM frames WHERE track = 0)
SELECT title_id, n, '{"n":' || n || ',"src":{"sector":' || src_byte // 2048 || ',"byte":' || src_byte % 2048 || '},"pts":' || pts_ns || ',"type":"' || ctype || '","key":' || keyframe || ',"size":' || size || '}' AS line FROM f""",
    "u1_label_sources": _SRC + """, l AS (SELECT disc_id, doc_id, confidence, 'query_' || stream_type AS source_name, CASE stream_type WHEN 'audio' THEN 0 ELSE 1 END AS o FROM labels_src),
b AS (SELECT disc_id, arg_max(source_name, confidence * 2 - o) AS source_name FROM l GROUP BY disc_id) SELECT disc_id, source_name, doc_id FROM l JOIN b USING (disc_id, source_name)""",
    "u2_frame_parser": disc_queries.ORACLE["w6_assemble_pes"].join(("WITH w6 AS (", ") SELECT file_id, pid, first_rec, CAST(length(data) // 2 AS BIGINT) AS bytes, CAST(('0x' || substr(data, 1, 2)) AS BIGINT) AS lead FROM w6 WHERE data <> ''")),
    "u3_progress_callback": "SELECT event_type AS phase, count(*) AS samples, CAST(sum(event_id) AS BIGINT) AS bytes, max(event_id * 700000) AS last_us FROM events GROUP BY ALL",
    "s1_read_range_map": with_views("range_log") + """, g AS (SELECT disc_id, pos, size, status, CAST(NULL AS VARCHAR) AS error FROM range_log UNION ALL SELECT disc_id, NULL, NULL, NULL, CASE seq % 9 WHEN 3 THEN 'number' WHEN 4 THEN 'size' ELSE 'status' END FROM range_log WHERE seq % 9 IN (3, 4, 5))
SELECT disc_id, status, error, count(*) AS lines, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(size) AS BIGINT) AS size FROM g GROUP BY ALL""",
    "s3_write_range_map": range_queries.LOG + range_queries.OVERLAY + "SELECT disc_id, pos, size, status FROM ranges",
    "s5_read_video_index": _INDEX + "SELECT title_id, CAST(section AS BIGINT) AS section, line_no, n, pts, type, key, size, sector, byte FROM x",
    "w29_validate_video_index": _INDEX + "SELECT title_id, CAST(section AS BIGINT) AS section, line_no, 'n' AS error FROM x WHERE section = 2",
    "s7_read_source_packets": with_views("ts_packets") + """, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rec_no) - 1 AS place, max(rec_no) OVER (PARTITION BY file_id) = rec_no AS cut FROM ts_packets)
SELECT file_id, place, rec_no, pid, CAST(CASE WHEN cut THEN 100 ELSE 192 END AS BIGINT) AS bytes, CASE WHEN cut THEN 'part' END AS error FROM n""",
    "s8_read_wire_ranges": file_queries.ORACLE["s8_read_frame_wire"],
    "s17_write_tracks": _FR + "SELECT title_id, track, idx, pts_ns, 'video' AS kind FROM frames WHERE track = 0",
    "s18_count_sink": _FR + "SELECT count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes FROM frames",
}
