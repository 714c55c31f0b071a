"""Queries of the damage operators over the views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.jobs.catalog_queries import _CH, _PG, chapters, pages
from reelspark.jobs.range_queries import _HIT, _STATS, BAD, OVERLAY, overlaid
from reelspark.operators import damage as D
from reelspark.operators import ranges as R
from reelspark.sources.views import spark_view as view
from reelspark.sources.views import with_views


def j8(s, d):
    return D.locate_ranges(R.ranges_with(overlaid(s, d), R.LOST), view(s, d, "extents"), view(s, d, "titles"), chapters(s, d), 2)


def a14(s, d):
    """Snapshots of discs with their main title, the largest; ranges located as text."""
    t = view(s, d, "titles")
    best = F.max_by(F.struct(*t.columns), F.struct("size_bytes", "duration_secs", -F.col("title_id")))
    main = t.groupBy(F.col("disc_id").alias("_d")).agg(best.alias("t")).select("t.*")
    discs = view(s, d, "discs").select("disc_id", (F.col("capacity_sectors") * R.SECTOR).alias("total_bytes"))
    snap = D.progress_snapshot(overlaid(s, d), discs, main, view(s, d, "extents"), chapters(s, d), 2)
    place = F.array_join(F.transform("located", lambda x: F.concat_ws(":", x["lba"].cast("string"), x["count"].cast("string"), F.coalesce(x["chapter"].cast("string"), F.lit("-")))), ",")
    return snap.withColumn("located", place).drop("largest_gap_ms", "main_title_duration_secs")


def j13(s, d):
    bad = view(s, d, "range_log").filter("status = '-'").select(F.col("disc_id").alias("title_id"), "pos", "size")
    return D.flag_recovered(view(s, d, "frames"), bad)


def r7(s, d):
    files = pages(s, d).select("disc_id", F.concat_ws("/", F.when(F.col("page_id") % 3 == 0, F.lit("BDMV/STREAM")), "path", F.col("page_id").cast("string")).alias("path"), "size", "page_id")
    return D.small_file_ranges(files.drop("page_id"), files.select("disc_id", "path", (F.col("page_id") % 60 * 3).alias("abs_lba"), F.col("size").alias("byte_len")), 6000)


def errors(s, d):
    log = view(s, d, "read_log").withColumn("status", F.element_at(F.array(*map(F.lit, (0, 2, 255, 8, 2))), (F.col("seq") % 5 + 1).cast("int")))
    return log.select("disc_id", "seq", *[v.alias(k) for k, v in D.error_predicates(F.col("status"), F.coalesce("sense_key", F.lit(3))).items()])


def video_rows(s, d):
    v = view(s, d, "stn_streams").withColumn("space", F.element_at(F.array(*map(F.lit, ("bt2020", "bt709", "bt470bg", "smpte170m", "unknown"))), (F.col("pid") % 5 + 1).cast("int")))
    v = v.withColumn("hdr", F.element_at(F.array(*map(F.lit, ("SDR", "HDR10", "HLG"))), (F.col("ord") % 3 + 1).cast("int")))
    measured = F.when(F.col("pid") % 7 == 0, F.struct(F.lit(9).alias("matrix"), F.lit(14).alias("transfer"), F.lit(9).alias("primaries"), F.lit(0).alias("range")))
    return v.select("title_id", "ord", D.cicp(measured, F.col("space"), F.col("hdr")).alias("c")).select("title_id", "ord", "c.*")


QUERIES = {
    "j8_locate_ranges": j8,
    "j13_flag_recovered": j13,
    "a14_progress_snapshot": a14,
    "a17_skip_totals": lambda s, d: D.skip_totals(view(s, d, "frames").filter("discontinuity").select("title_id", F.col("size").alias("bytes"))),
    "a5_forced_track": lambda s, d: D.forced_track(view(s, d, "frames").select("title_id", "track", F.when(F.col("ctype") != "P", F.col("ctype") == "B").alias("forced"))),
    "r7_small_file_ranges": r7,
    "p13_select_pids": lambda s, d: D.select_pids(view(s, d, "ts_packets").withColumn("sync", F.col("rec_no") % 50 != 0).withColumn("afc", F.col("rec_no") % 4), s.range(1).select((F.col("id") + 4113).alias("pid"))).select("file_id", "pid", "rec_no", "has_payload"),
    "p7_error_predicates": lambda s, d: errors(s, d),
    "f6_cicp": lambda s, d: video_rows(s, d),
}
_ALL = with_views("range_log", "extents", "titles", "marks")
ORACLE = {
    "j8_locate_ranges": _ALL + _CH + OVERLAY + BAD + f""", c AS (SELECT *, max(time_secs) OVER (PARTITION BY title_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS f FROM ch), hit AS ({_HIT}),
o AS (SELECT *, coalesce(sum(sector_count) OVER (PARTITION BY title_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2048 AS before FROM extents),
k AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY size DESC, pos) AS bs, row_number() OVER (PARTITION BY disc_id ORDER BY pos) AS bp, count(*) OVER (PARTITION BY disc_id) AS num_ranges FROM bad),
t AS (SELECT title_id, t.disc_id, size_bytes, duration_secs, CASE WHEN duration_secs > 0 THEN size_bytes / duration_secs ELSE 0.0 END AS rate, pos, size, bs, bp, num_ranges FROM titles t JOIN k ON k.disc_id = t.disc_id AND (bs <= 2 OR bp <= 2)),
r AS (SELECT *, CASE WHEN rate > 0 THEN bs ELSE bp END AS rank, pos // 2048 AS lba FROM t),
p AS (SELECT r.*, (SELECT arg_min(o.before + (r.lba - o.start_lba) * 2048, o.ord) FROM o WHERE o.title_id = r.title_id AND r.lba >= o.start_lba AND r.lba < o.start_lba + o.sector_count) AS place FROM r WHERE rank <= 2),
q AS (SELECT *, CASE WHEN rate > 0 THEN size / rate * 1000 ELSE 0.0 END AS duration_ms, CASE WHEN size_bytes > 0 AND EXISTS (SELECT 1 FROM c WHERE c.title_id = p.title_id) THEN place / size_bytes * duration_secs END AS secs FROM p)
SELECT q.title_id, CAST(rank AS INT) AS rank, lba, size // 2048 AS count, CAST(duration_ms AS DOUBLE) AS duration_ms, CAST(CASE WHEN secs IS NOT NULL THEN coalesce((SELECT max(n) FROM c WHERE c.title_id = q.title_id AND c.f <= q.secs), 1) END AS BIGINT) AS chapter,
 CAST(secs AS DOUBLE) AS time_offset_secs, num_ranges, greatest(num_ranges - 2, 0) AS truncated, CAST(max(duration_ms) OVER (PARTITION BY q.title_id) AS DOUBLE) AS largest_gap_ms, CAST(CASE WHEN rate > 0 THEN coalesce(bytes_bad, 0) * 1000.0 / rate ELSE 0.0 END AS DOUBLE) AS main_at_risk_ms
FROM q LEFT JOIN hit ON hit.title_id = q.title_id""",
    "j13_flag_recovered": with_views("frames", "range_log") + "SELECT title_id, track, idx, EXISTS (SELECT 1 FROM range_log r WHERE r.disc_id = f.title_id AND r.status = '-' AND r.pos < f.src_byte + f.size AND f.src_byte < r.pos + r.size AND f.size > 0) AS recovered FROM frames f",
    "a17_skip_totals": with_views("frames") + "SELECT title_id, count(*) AS skips, CAST(sum(size) AS BIGINT) AS bytes_lost FROM frames WHERE discontinuity GROUP BY ALL",
    "a5_forced_track": with_views("frames") + "SELECT title_id, track, bool_and(ctype = 'B') FILTER (ctype <> 'P') AS forced, count(*) FILTER (ctype <> 'P') AS sets FROM frames GROUP BY ALL",
    "r7_small_file_ranges": "WITH " + _PG + """, e AS (SELECT disc_id, page_id % 60 * 3 AS a, page_id % 60 * 3 + (size + 2047) // 2048 AS b, (size + 2047) // 2048 AS n FROM pg WHERE size <= 6000 AND page_id % 3 <> 0),
m AS (SELECT *, max(b) OVER (PARTITION BY disc_id ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e), i AS (SELECT *, sum(CASE WHEN a <= seen + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY disc_id ORDER BY a, n, seen NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT disc_id, min(a) AS start_lba, max(b) - min(a) AS sector_count FROM i GROUP BY disc_id, g""",
    "p13_select_pids": with_views("ts_packets") + "SELECT file_id, pid, rec_no, rec_no % 4 <> 2 AS has_payload FROM ts_packets WHERE pid = 4113 AND rec_no % 50 <> 0 AND rec_no % 4 <> 0",
    "p7_error_predicates": with_views("read_log") + """, x AS (SELECT *, CASE seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 255 WHEN 3 THEN 8 ELSE 2 END AS status FROM read_log)
SELECT disc_id, seq, status = 255 AS transport, status NOT IN (0, 2, 255) AS bridge, status = 2 AND coalesce(sense_key, 3) IN (0, 1, 2, 3, 11) AS marginal FROM x""",
    "f6_cicp": with_views("stn_streams") + """, x AS (SELECT title_id, ord, pid % 7 = 0 AS m, CASE pid % 5 WHEN 0 THEN 9 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 6 ELSE 2 END AS matrix,
 CASE ord % 3 WHEN 1 THEN 16 WHEN 2 THEN 18 ELSE CASE pid % 5 WHEN 0 THEN 16 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 6 ELSE 2 END END AS transfer FROM stn_streams)
SELECT title_id, ord, CAST(CASE WHEN m THEN 9 ELSE matrix END AS INT) AS matrix, CAST(CASE WHEN m THEN 14 ELSE transfer END AS INT) AS transfer, CAST(CASE WHEN m THEN 9 ELSE matrix END AS INT) AS primaries, CAST(CASE WHEN m THEN 0 ELSE 1 END AS INT) AS "range" FROM x""",
}
_MAIN = ORACLE["j8_locate_ranges"].replace("FROM titles t JOIN k", "FROM mt t JOIN k").replace(", c AS (SELECT *, max(time_secs)", ", mt AS (SELECT * FROM titles QUALIFY row_number() OVER (PARTITION BY disc_id ORDER BY size_bytes DESC, duration_secs DESC, title_id) = 1), c AS (SELECT *, max(time_secs)", 1)
_HEAD, _TAIL = _MAIN.split("SELECT q.title_id, CAST(rank AS INT)")
ORACLE["a14_progress_snapshot"] = _HEAD.rstrip() + f""", lo AS (SELECT q.title_id, CAST(rank AS INT){_TAIL}),
la AS (SELECT title_id, string_agg(lba || ':' || count || ':' || coalesce(CAST(chapter AS VARCHAR), '-'), ',' ORDER BY rank) AS located, any_value(num_ranges) AS num_ranges, any_value(truncated) AS truncated, any_value(main_at_risk_ms) AS risk FROM lo GROUP BY title_id),
stats AS ({_STATS}) SELECT stats.*, (SELECT capacity_sectors * 2048 FROM (SELECT s_suppkey AS disc_id, 1000000 + s_suppkey * 500000 AS capacity_sectors FROM supplier) dd WHERE dd.disc_id = stats.disc_id) AS bytes_total_disc, mt.size_bytes AS main_title_size_bytes, coalesce(hit.bytes_bad, 0) AS bytes_bad_in_main_title,
 coalesce(num_ranges, 0) AS num_ranges, coalesce(truncated, 0) AS truncated, coalesce(risk, 0.0) AS main_at_risk_ms, coalesce(located, '') AS located
FROM stats LEFT JOIN mt ON mt.disc_id = stats.disc_id LEFT JOIN la ON la.title_id = mt.title_id LEFT JOIN hit ON hit.title_id = mt.title_id"""
