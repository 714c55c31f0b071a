"""Queries of the range operators over the views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import ranges as R
from reelspark.sources.views import spark_view as view
from reelspark.sources.views import with_views

LOG = with_views("range_log")
#: Overlay of the log in SQL: the ends cut each disc, the last record over a segment gives its status, equal neighbours join.
OVERLAY = """,
points AS (SELECT disc_id, pos AS edge FROM range_log UNION SELECT disc_id, pos + size FROM range_log),
segments AS (SELECT * FROM (SELECT disc_id, edge AS a, lead(edge) OVER (PARTITION BY disc_id ORDER BY edge) AS b FROM points) WHERE b IS NOT NULL),
lasts AS (SELECT s.disc_id, s.a, s.b, arg_max(r.status, r.seq) AS status FROM segments s JOIN range_log r
          ON r.disc_id = s.disc_id AND r.pos <= s.a AND r.pos + r.size >= s.b GROUP BY ALL),
flags AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(status) OVER w = status THEN 0 ELSE 1 END AS new FROM lasts WINDOW w AS (PARTITION BY disc_id ORDER BY a)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY disc_id ORDER BY a) AS i FROM flags),
ranges AS (SELECT disc_id, min(a) AS pos, CAST(sum(b - a) AS BIGINT) AS size, any_value(status) AS status FROM islands GROUP BY disc_id, i)
"""
BAD = ", bad AS (SELECT * FROM ranges WHERE status IN ('*', '/', '-'))"


def overlaid(spark, d):
    return R.overlay_ranges(view(spark, d, "range_log"))


def slice_disc_damage(spark, d):
    return R.disc_damage(view(spark, d, "range_log"), view(spark, d, "extents"), view(spark, d, "titles"))


def w2_merge_ranges(spark, d):
    return R.merge_ranges(view(spark, d, "extents"))


def r2_subtract_ranges(spark, d):
    log = view(spark, d, "range_log")
    return R.subtract_ranges(log.filter("status = '-'"), log.filter("status = '+'"))


def r3_intersect_ranges(spark, d):
    log = view(spark, d, "range_log")
    return R.intersect_ranges(log.filter("status = '-'"), log.filter("status = '+'"))


def p14_coverage(spark, d):
    return R.coverage_mismatch(overlaid(spark, d), view(spark, d, "discs"))


def j6_locate_lba(spark, d):
    log = view(spark, d, "range_log").filter("status = '-'")
    return R.locate_lba(log.select("disc_id", (F.col("pos") / R.SECTOR).cast("long").alias("lba")), view(spark, d, "extents"))


def f22_severity(spark, d):
    stats = R.range_stats(overlaid(spark, d))
    sectors, ms = (F.col("bytes_unreadable") / 2048).cast("long"), (F.col("bytes_retryable") / 100_000).cast("long")
    return stats.select("disc_id", R.damage_severity(sectors, ms).alias("severity"))


def t2_largest_ranges(spark, d):
    bad = R.ranges_with(overlaid(spark, d), R.LOST)
    return R.largest_ranges(bad, 5)


QUERIES = {
    "slice_disc_damage": slice_disc_damage,
    "r1_overlay_ranges": overlaid,
    "w1_coalesce_ranges": lambda s, d: R.coalesce_ranges(view(s, d, "range_log").select("disc_id", (F.col("seq") * 2048).alias("pos"), F.lit(2048).cast("long").alias("size"), "status")),
    "w2_merge_ranges": w2_merge_ranges,
    "w3_extent_offsets": lambda s, d: R.extent_offsets(view(s, d, "extents")),
    "r2_subtract_ranges": r2_subtract_ranges,
    "r3_intersect_ranges": r3_intersect_ranges,
    "a1_range_stats": lambda s, d: R.range_stats(overlaid(s, d)),
    "p2_ranges_with": lambda s, d: R.ranges_with(overlaid(s, d), ("*", "-")),
    "p3_next_with": lambda s, d: R.next_with(overlaid(s, d), F.lit(4_000_000), "-"),
    "p14_coverage_mismatch": p14_coverage,
    "s2_normalise_range_map": lambda s, d: R.normalise_range_map(overlaid(s, d)),
    "s4_new_range_map": lambda s, d: R.new_range_map(view(s, d, "discs")),
    "j5_bytes_bad_in_title": lambda s, d: R.bytes_bad_in_title(view(s, d, "extents"), R.ranges_with(overlaid(s, d), R.LOST)),
    "j6_locate_lba": j6_locate_lba,
    "f22_damage_severity": f22_severity,
    "t2_largest_ranges": t2_largest_ranges,
    "t4_patch_order": lambda s, d: R.patch_order(overlaid(s, d)),
}

_STATS = """SELECT disc_id, CAST(coalesce(sum(size) FILTER (status = '+'), 0) AS BIGINT) AS bytes_good, CAST(coalesce(sum(size) FILTER (status = '-'), 0) AS BIGINT) AS bytes_unreadable,
 CAST(coalesce(sum(size) FILTER (status IN ('?', '*', '/')), 0) AS BIGINT) AS bytes_pending, CAST(coalesce(sum(size) FILTER (status = '?'), 0) AS BIGINT) AS bytes_nontried,
 CAST(coalesce(sum(size) FILTER (status IN ('*', '/')), 0) AS BIGINT) AS bytes_retryable, CAST(sum(size) AS BIGINT) AS bytes_total, count(*) FILTER (status = '-') AS num_bad_ranges FROM ranges GROUP BY disc_id"""
_HIT = """SELECT e.disc_id, e.title_id, CAST(sum(least((e.start_lba + e.sector_count) * 2048, b.pos + b.size) - greatest(e.start_lba * 2048, b.pos)) AS BIGINT) AS bytes_bad
 FROM extents e JOIN bad b ON b.disc_id = e.disc_id AND e.start_lba * 2048 < b.pos + b.size AND b.pos < (e.start_lba + e.sector_count) * 2048 GROUP BY ALL"""
_BOTH = with_views("range_log", "extents", "discs")
ORACLE = {
    "slice_disc_damage": with_views("range_log", "titles") + OVERLAY + BAD + f""", stats AS ({_STATS}), hit AS ({_HIT}),
big AS (SELECT disc_id, title_id, size_bytes, duration_secs FROM titles QUALIFY row_number() OVER (PARTITION BY disc_id ORDER BY size_bytes DESC, duration_secs DESC, title_id) = 1),
ms AS (SELECT h.disc_id, bytes_bad * duration_secs * 1000 / size_bytes AS ms FROM hit h JOIN big ON big.disc_id = h.disc_id AND big.title_id = h.title_id AND size_bytes > 0),
per AS (SELECT disc_id, count(*) AS titles_hit, CAST(sum(bytes_bad) AS BIGINT) AS title_bytes_bad FROM hit GROUP BY disc_id),
al AS (SELECT stats.*, CAST((bytes_unreadable + bytes_retryable) // 2048 AS BIGINT) AS bad_sectors, coalesce(titles_hit, 0) AS titles_hit, coalesce(title_bytes_bad, 0) AS title_bytes_bad, CAST(coalesce(ms, 0) AS DOUBLE) AS lost_ms
 FROM stats LEFT JOIN per USING (disc_id) LEFT JOIN ms USING (disc_id))
SELECT *, CASE WHEN bad_sectors = 0 THEN 'clean' WHEN bad_sectors >= 500 OR lost_ms >= 30000 THEN 'serious' WHEN bad_sectors >= 51 OR lost_ms >= 1000 THEN 'moderate' ELSE 'cosmetic' END AS severity FROM al""",
    "r1_overlay_ranges": LOG + OVERLAY + "SELECT disc_id, pos, size, status FROM ranges",
    "w1_coalesce_ranges": LOG + """, f AS (SELECT *, seq - row_number() OVER (PARTITION BY disc_id, status ORDER BY seq) AS g FROM range_log)
SELECT disc_id, min(seq) * 2048 AS pos, CAST(count(*) * 2048 AS BIGINT) AS size, status FROM f GROUP BY disc_id, status, g""",
    "w2_merge_ranges": with_views("extents") + """, e AS (SELECT *, start_lba + sector_count AS fin FROM extents),
m AS (SELECT *, max(fin) OVER (PARTITION BY title_id ORDER BY start_lba, sector_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e),
i AS (SELECT *, sum(CASE WHEN start_lba <= seen + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY title_id ORDER BY start_lba, sector_count ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT title_id, min(start_lba) AS start_lba, max(fin) - min(start_lba) AS sector_count FROM i GROUP BY title_id, g""",
    "w3_extent_offsets": with_views("extents") + "SELECT *, CAST(coalesce(sum(sector_count) OVER (PARTITION BY title_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2048 AS BIGINT) AS byte_offset FROM extents",
    "r2_subtract_ranges": LOG + """, p AS (SELECT disc_id, pos AS edge FROM range_log WHERE status IN ('-', '+') UNION SELECT disc_id, pos + size FROM range_log WHERE status IN ('-', '+')),
s AS (SELECT * FROM (SELECT disc_id, edge AS a, lead(edge) OVER (PARTITION BY disc_id ORDER BY edge) AS b FROM p) WHERE b IS NOT NULL),
k AS (SELECT s.disc_id, s.a, s.b, count(*) FILTER (r.status = '-') AS bad, count(*) FILTER (r.status = '+') AS good FROM s JOIN range_log r ON r.disc_id = s.disc_id AND r.pos <= s.a AND r.pos + r.size >= s.b GROUP BY ALL),
l AS (SELECT * FROM k WHERE bad > 0 AND good = 0), f AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY disc_id ORDER BY a) = a THEN 0 ELSE 1 END AS new FROM l),
i AS (SELECT *, sum(new) OVER (PARTITION BY disc_id ORDER BY a) AS g FROM f)
SELECT disc_id, min(a) AS pos, CAST(sum(b - a) AS BIGINT) AS size FROM i GROUP BY disc_id, g""",
    "r3_intersect_ranges": LOG + """SELECT x.disc_id, greatest(x.pos, y.pos) AS pos, least(x.pos + x.size, y.pos + y.size) - greatest(x.pos, y.pos) AS size
FROM range_log x JOIN range_log y ON x.disc_id = y.disc_id AND x.status = '-' AND y.status = '+' AND x.pos < y.pos + y.size AND y.pos < x.pos + x.size""",
    "a1_range_stats": LOG + OVERLAY + _STATS,
    "p2_ranges_with": LOG + OVERLAY + "SELECT disc_id, pos, size, status FROM ranges WHERE status IN ('*', '-')",
    "p3_next_with": LOG + OVERLAY + """SELECT disc_id, greatest(pos, 4000000) AS pos, pos + size - greatest(pos, 4000000) AS size FROM ranges
WHERE status = '-' AND pos + size > 4000000 QUALIFY row_number() OVER (PARTITION BY disc_id ORDER BY pos) = 1""",
    "p14_coverage_mismatch": _BOTH + OVERLAY + """SELECT disc_id, max(pos + size) AS map_bytes, any_value(capacity_sectors) * 2048 AS disc_bytes,
 CASE WHEN max(pos + size) > any_value(capacity_sectors) * 2048 THEN 'over' WHEN max(pos + size) < any_value(capacity_sectors) * 2048 THEN 'under' ELSE 'exact' END AS coverage FROM ranges JOIN discs USING (disc_id) GROUP BY disc_id""",
    "s2_normalise_range_map": LOG + OVERLAY + """, e AS (SELECT *, coalesce(lag(pos + size) OVER (PARTITION BY disc_id ORDER BY pos), 0) AS fin FROM ranges)
SELECT disc_id, pos, size, status, false AS overlap FROM e UNION ALL SELECT disc_id, fin, pos - fin, '?', false FROM e WHERE pos > fin""",
    "s4_new_range_map": with_views("discs") + "SELECT disc_id, CAST(0 AS BIGINT) AS pos, capacity_sectors * 2048 AS size, '?' AS status FROM discs",
    "j5_bytes_bad_in_title": _BOTH + OVERLAY + BAD + _HIT,
    "j6_locate_lba": _BOTH + """, o AS (SELECT *, coalesce(sum(sector_count) OVER (PARTITION BY title_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2048 AS before FROM extents),
p AS (SELECT DISTINCT disc_id, pos // 2048 AS lba FROM range_log WHERE status = '-')
SELECT p.disc_id, o.title_id, p.lba, CAST(arg_min(o.before + (p.lba - o.start_lba) * 2048, o.ord) AS BIGINT) AS "offset" FROM p JOIN o ON o.disc_id = p.disc_id AND p.lba >= o.start_lba AND p.lba < o.start_lba + o.sector_count GROUP BY ALL""",
    "f22_damage_severity": LOG + OVERLAY + f""", stats AS ({_STATS}), x AS (SELECT disc_id, bytes_unreadable // 2048 AS s, bytes_retryable // 100000 AS ms FROM stats)
SELECT disc_id, CASE WHEN s = 0 THEN 'clean' WHEN s >= 500 OR ms >= 30000 THEN 'serious' WHEN s >= 51 OR ms >= 1000 THEN 'moderate' ELSE 'cosmetic' END AS severity FROM x""",
    "t2_largest_ranges": LOG + OVERLAY + BAD + """SELECT disc_id, pos, size, status, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY size DESC, pos) AS INT) AS rank, count(*) OVER (PARTITION BY disc_id) AS num_ranges, count(*) OVER (PARTITION BY disc_id) > 5 AS truncated FROM bad
QUALIFY row_number() OVER (PARTITION BY disc_id ORDER BY size DESC, pos) <= 5""",
    "t4_patch_order": LOG + OVERLAY + BAD + "SELECT disc_id, pos, size, status, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY pos DESC) AS INT) AS place FROM bad",
}
