"""Queries of the catalogue, label and scalar operators over the views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import scalars as S
from reelspark.operators import catalog as C
from reelspark.operators import ranges as R
from reelspark.sources.views import spark_view as view
from reelspark.sources.views import with_views


def streams(s, d):
    return C.stream_rows(view(s, d, "stn_streams"))


def title_labels(s, d):
    """Labels of English and French streams; streams of other languages are orphans."""
    return C.dedup_stn_labels(streams(s, d)).filter(F.col("language").isin("eng", "fra")).select("title_id", "kind", "language", "codec", "number")


def chapters(s, d):
    return C.chapters_from_marks(view(s, d, "marks"), view(s, d, "play_items"))


def t1(s, d):
    return C.canonical_title_order(view(s, d, "titles"), C.audio_richness(streams(s, d)), F.lit(400_000))


def p12(s, d):
    disc = F.col("disc_id")
    trees = F.when(disc % 10 == 7, F.array(F.lit("HVDVD_TS"))).when(disc % 10 == 8, F.array(F.lit("VIDEO_TS"))).when(disc % 10 == 9, F.array().cast("array<string>")).otherwise(F.array(F.lit("BDMV"), F.lit("VIDEO_TS")))
    discs = view(s, d, "discs").select("disc_id", trees.alias("trees"), F.when(disc % 10 < 3, F.element_at(F.array(F.lit(21), F.lit(20), F.lit(10)), (disc % 10 + 1).cast("int"))).alias("generation"))
    return C.detect_disc_format(discs, streams(s, d), view(s, d, "titles"))


def j12(s, d):
    """Labels by title and place, of which some disagree with the stream that they meet."""
    st = streams(s, d).withColumn("channels", S.channels(F.col("audio_format")))
    number, at = F.row_number().over(C.W.partitionBy("title_id", "kind").orderBy("ord")).cast("long"), F.col("video_rate")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (at % len(x) + 1).cast("int"))
    told = st.withColumn("number", number).filter(at != 8).select(
        "title_id", "kind", "number", F.lit(1).alias("label_no"), F.concat(F.lit("Track "), F.col("pid").cast("string")).alias("name"), pick("Normal", "Commentary", "Descriptive").alias("purpose"),
        pick("None", "Sdh", "Forced", "None").alias("qualifier"), pick("", "Dolby Atmos", "AC-3 2.0", "DTS:X", "dts-hd master audio", "Commentary", "TrueHD 7.1").alias("codec_hint"), pick("", "", "Canadian", "", "European").alias("variant"),
    )
    return C.apply_labels(st.select("title_id", "ord", "kind", "codec", "channels"), told)


def labels(s, d):
    src = view(s, d, "labels_src")
    return src.withColumn("source_order", F.regexp_extract("source_name", "[0-9]+", 0).cast("int"))


def pages(s, d):
    p = view(s, d, "pages")
    return p.select((F.col("page_id") % 20).alias("disc_id"), F.regexp_replace("url", "^https?://", "").alias("path"), (F.length("html")).cast("long").alias("size"), "page_id")


def variants(s, d):
    """Every path as it is, with a dot at its end, inside a device's folder, and with a mark that no host takes."""
    ways = F.array("path", F.concat("path", F.lit(".")), F.concat(F.lit("con.x/"), "path"), F.concat(F.lit("_con.x/"), "path"), F.concat("path", F.lit(":")), F.concat(F.lit("../"), "path"))
    return pages(s, d).select("disc_id", F.explode(ways).alias("path"))


def j14(s, d):
    files = pages(s, d).select("disc_id", F.concat_ws("/", "path", F.col("page_id").cast("string")).alias("path"), "size", "page_id")
    extents = files.select("disc_id", "path", (F.col("page_id") * 40).alias("abs_lba"), F.col("size").alias("byte_len"))
    bad = view(s, d, "range_log").filter("status = '-'").select("disc_id", "pos", "size")
    return C.extraction_report(files.drop("page_id"), extents, bad)


def j7(s, d):
    t = view(s, d, "titles")
    points = t.withColumn("k", F.explode(F.array(F.lit(1), F.lit(5)))).select("title_id", F.floor(F.col("size_bytes") * F.col("k") / 8).alias("offset"))
    return C.chapter_at(points, t, chapters(s, d))


def drives(s, d):
    n = view(s, d, "supplier").join(view(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select("s_suppkey", F.concat(F.lit(" "), "n_name").alias("vendor"), F.col("s_nationkey").cast("string").alias("product"), F.lit("1.0 ").alias("revision"), F.lit("x").alias("vendor_specific"))


def j15(s, d):
    profiles = view(s, d, "nation").filter("n_regionkey < 3").select(F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string"), F.lit("1.0"), F.lit("x")).alias("match_key"), F.col("n_regionkey").alias("profile"))
    return C.match_drive(drives(s, d), profiles).select("s_suppkey", "match_key", "profile")


def scalars_streams(s, d):
    v = view(s, d, "stn_streams")
    r = S.resolution(F.col("video_format"))
    return v.select("title_id", "ord", S.codec(F.col("coding_type")).alias("codec"), S.codec_kind(S.codec(F.col("coding_type"))).alias("kind"), r.alias("resolution"), S.pixels(r)["width"].alias("width"), S.is_uhd(r).alias("uhd"), S.is_interlaced(r).alias("interlaced"), S.frame_rate(F.col("video_rate"))["num"].alias("rate_num"), S.channels(F.col("audio_format")).alias("channels"), S.channel_count(F.col("audio_format")).alias("channel_count"))


def scalars_labels(s, d):
    t = view(s, d, "label_text")
    return t.select("doc_id", S.language(F.col("text"))["code"].alias("code"), S.language(F.col("text"))["variant"].alias("variant"), S.purpose(F.col("text")).alias("purpose"), S.qualifier(F.col("text")).alias("qualifier"))


def scalars_parts(s, d):
    p = view(s, d, "part")
    size = F.col("p_size").cast("int")
    return p.select("p_partkey", S.bcd_to_secs(size % 3, size, size, F.lit(64)).alias("bcd"), S.pts_to_ns(F.col("p_partkey") * 3003).alias("ns"), S.error_category(F.col("p_partkey") * 7).alias("category"), S.source_position(F.col("p_partkey") * 777)["byte"].alias("byte"), S.layers(F.col("p_partkey") * 30_000).alias("layers"), S.mask_string(F.col("p_name")).alias("masked"), S.chapter_time(F.col("p_partkey") * 1.5, 3).alias("at"), S.is_secondary_cell(size % 4).alias("secondary"))


QUERIES = {
    "j1_build_titles": lambda s, d: C.build_titles(view(s, d, "play_items"), view(s, d, "clip_info"), view(s, d, "clip_extents")),
    "p1_min_duration": lambda s, d: C.min_duration(view(s, d, "play_items"), 120),
    "p4_valid_extents": lambda s, d: C.valid_extents(view(s, d, "extents").withColumn("start_lba", F.col("start_lba") % 64)),
    "p5_stream_rows": streams,
    "p8_container_fit": lambda s, d: C.container_fit(streams(s, d).withColumn("dependent", F.col("pid") % 5 == 0)),
    "p9_feature_cells": lambda s, d: C.feature_cells(view(s, d, "cells")),
    "j18_cell_extents": lambda s, d: C.cell_extents(view(s, d, "cells")),
    "w4_chapters_from_marks": chapters,
    "w27_shift_chapters": lambda s, d: C.shift_chapters(chapters(s, d), view(s, d, "cells")),
    "a10_chapter_summary": lambda s, d: C.chapter_summary(view(s, d, "marks"), view(s, d, "play_items")),
    "j7_chapter_at": j7,
    "a2_title_totals": lambda s, d: C.title_totals(view(s, d, "extents"), view(s, d, "titles")),
    "a3_audio_richness": lambda s, d: C.audio_richness(streams(s, d)),
    "t1_title_order": t1,
    "w24_default_tracks": lambda s, d: C.default_tracks(streams(s, d)).select("title_id", "ord", "kind", "is_default"),
    "p12_disc_format": p12,
    "j9_audit_streams": lambda s, d: C.audit_streams(view(s, d, "clip_streams"), view(s, d, "stn_streams")),
    "a9_audit_counts": lambda s, d: C.audit_counts(C.audit_streams(view(s, d, "clip_streams"), view(s, d, "stn_streams"))),
    "r4_union_pids": lambda s, d: C.union_pids(view(s, d, "clip_streams"), view(s, d, "stn_streams")),
    "w26_select_label_source": lambda s, d: C.select_label_source(labels(s, d)).select("disc_id", "source_name", "doc_id"),
    "j10_fill_label_gaps": lambda s, d: C.fill_label_gaps(C.select_label_source(labels(s, d)), labels(s, d).filter("source_name = 'src0'")),
    "j11_append_orphans": lambda s, d: C.append_orphans(title_labels(s, d), streams(s, d)),
    "j12_apply_labels": j12,
    "a16_dedup_stn_labels": lambda s, d: C.dedup_stn_labels(streams(s, d)),
    "a13_labels_by_language": lambda s, d: C.labels_by_language(view(s, d, "labels_src")),
    "j15_match_drive": j15,
    "j14_extraction_report": j14,
    "a15_extraction_rollup": lambda s, d: C.extraction_rollup(j14(s, d)),
    "r5_name_collisions": lambda s, d: C.name_collisions(variants(s, d)),
    "r6_strip_top_level": lambda s, d: C.strip_top_level(pages(s, d).select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("AACS/"), "path")).otherwise(F.concat(F.lit("/BDMV/AACS/"), "path")).alias("path"))),
    "f1_f5_stream_codes": scalars_streams,
    "f15_f16_label_text": scalars_labels,
    "f7_f33_part_values": scalars_parts,
}


def _case(value: str, table: dict, default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{v}'" if isinstance(v, str) else f"WHEN {k} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


_CODEC = _case("coding_type", S.CODECS, "'Unknown'")
_ST = f""", sr AS (SELECT title_id, ord, pid, CASE WHEN stream_type IN (1, 6, 7) THEN 'video' WHEN stream_type IN (2, 5) THEN CASE WHEN coding_type = 144 THEN 'subtitle' ELSE 'audio' END WHEN stream_type = 3 THEN 'subtitle' END AS kind,
 {_CODEC} AS codec, stream_type IN (5, 7) AS secondary, language, video_format, video_rate, audio_format FROM stn_streams WHERE coding_type <> 0), st AS (SELECT * FROM sr WHERE kind IS NOT NULL)"""
STN = with_views("stn_streams") + _ST
_CH = """, pi AS (SELECT *, coalesce(sum(greatest(out_time - in_time, 0)) OVER (PARTITION BY title_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM play_items),
ch AS (SELECT m.title_id, CAST(row_number() OVER (PARTITION BY m.title_id ORDER BY mark_no) AS INT) AS n, CAST(greatest(before + timestamp_45k - in_time, 0) / 45000 AS DOUBLE) AS time_secs FROM marks m JOIN pi ON pi.title_id = m.title_id AND pi.item_no = m.play_item_ref WHERE mark_type = 1)"""
_FC = ", fc AS (SELECT * FROM cells c WHERE ord >= coalesce((SELECT min(ord) FROM cells k WHERE k.title_id = c.title_id AND NOT block_mode IN (2, 3)), 0))"
_RICH = """, rich AS (SELECT title_id, bool_or(codec IN ('TrueHD', 'DTS-HD MA', 'DTS-HD HR', 'LPCM', 'FLAC')) AS lossless, CAST(max(CASE audio_format WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 6 WHEN 12 THEN 8 ELSE 0 END) AS INT) AS max_channels, count(*) AS tracks FROM st WHERE kind = 'audio' GROUP BY title_id)"""
_AUD = """, a AS (SELECT title_id, pid, arg_min(coding_type, ord) AS t, arg_min(language, ord) AS l FROM clip_streams WHERE pid <> 0 GROUP BY ALL), b AS (SELECT title_id, pid, arg_min(coding_type, ord) AS t, arg_min(language, ord) AS l FROM stn_streams WHERE pid <> 0 GROUP BY ALL),
au AS (SELECT coalesce(a.title_id, b.title_id) AS title_id, coalesce(a.pid, b.pid) AS pid, CASE WHEN b.t IS NULL THEN 'clip_only' WHEN a.t IS NULL THEN 'playlist_only' WHEN a.t = b.t AND a.l = b.l THEN 'match' ELSE 'divergent' END AS class FROM a FULL JOIN b ON a.title_id = b.title_id AND a.pid = b.pid)"""
_A16 = """, d16 AS (SELECT title_id, kind, language, codec, pid, min(ord) AS first FROM st WHERE kind IN ('audio', 'subtitle') GROUP BY ALL), n16 AS (SELECT *, row_number() OVER (PARTITION BY title_id, kind ORDER BY first) AS number FROM d16), lab AS (SELECT title_id, kind, language, codec, number FROM n16 WHERE language IN ('eng', 'fra'))"""
_LS = with_views("labels_src") + """, ls AS (SELECT *, CAST(regexp_extract(source_name, '[0-9]+') AS INT) AS so FROM labels_src), best AS (SELECT disc_id, arg_max(source_name, (confidence, -so)) AS source_name FROM ls GROUP BY disc_id), chosen AS (SELECT ls.* FROM ls JOIN best USING (disc_id, source_name))"""
_PG = "pg AS (SELECT page_id % 20 AS disc_id, regexp_replace(url, '^https?://', '') AS path, length(html) AS size, page_id FROM pages)"
_J14 = with_views("range_log") + ", " + _PG + """, f AS (SELECT disc_id, path || '/' || page_id AS path, size, page_id * 40 * 2048 AS a, page_id * 40 * 2048 + size AS b FROM pg),
lost AS (SELECT f.disc_id, f.path, sum(least(f.b, r.pos + r.size) - greatest(f.a, r.pos)) AS n FROM f JOIN range_log r ON r.disc_id = f.disc_id AND r.status = '-' AND r.pos < f.b AND f.a < r.pos + r.size GROUP BY ALL),
rep AS (SELECT f.disc_id, f.path, CAST(f.size - least(coalesce(n, 0), f.size) AS BIGINT) AS bytes_good, CAST(least(coalesce(n, 0), f.size) AS BIGINT) AS bytes_unreadable, coalesce(n, 0) = 0 AS complete FROM f LEFT JOIN lost USING (disc_id, path))"""
_LOW = "lower(text)"
_WORD = lambda w: f"regexp_matches({_LOW}, '(^|[^\\p{{L}}\\p{{N}}]){w}($|[^\\p{{L}}\\p{{N}}])')"
ORACLE = {
    "j1_build_titles": with_views("play_items", "clip_extents") + """, f AS (SELECT p.*, source_packets, row_number() OVER (PARTITION BY title_id, clip_id ORDER BY item_no) = 1 AND source_packets IS NOT NULL AS counts FROM play_items p LEFT JOIN clip_info USING (clip_id)),
x AS (SELECT clip_id, sum(sector_count) AS s, count(*) AS e FROM clip_extents GROUP BY ALL)
SELECT title_id, CAST(sum(out_time - in_time) / 45000 AS DOUBLE) AS duration_secs, count(*) AS clips, CAST(coalesce(sum(s * 2048) FILTER (counts), 0) AS BIGINT) AS size_bytes, CAST(coalesce(sum(e) FILTER (counts), 0) AS BIGINT) AS extents FROM f LEFT JOIN x USING (clip_id) GROUP BY title_id""",
    "p1_min_duration": with_views("play_items") + "SELECT title_id, CAST(sum(out_time - in_time) / 45000 AS DOUBLE) AS duration_secs FROM play_items GROUP BY title_id HAVING sum(out_time - in_time) / 45000 >= 120",
    "p4_valid_extents": with_views("extents") + "SELECT title_id, disc_id, ord, start_lba % 64 AS start_lba, sector_count FROM extents WHERE start_lba % 64 <> 0 AND sector_count <> 0",
    "p5_stream_rows": STN + "SELECT * FROM st",
    "p8_container_fit": STN + """, x AS (SELECT *, kind = 'video' AND pid % 5 <> 0 AND codec IN ('HEVC', 'H.264') AS fits FROM st), y AS (SELECT *, row_number() OVER (PARTITION BY title_id, fits ORDER BY ord) AS p FROM x)
SELECT title_id, ord, kind, codec, CASE WHEN kind = 'subtitle' THEN 'BitmapSubtitle' WHEN kind = 'audio' AND codec NOT IN ('AC-3', 'EAC-3', 'DTS', 'DTS-HD MA', 'DTS-HD HR') THEN 'UnmappableAudio' WHEN kind = 'video' AND NOT (fits AND p = 1) THEN 'SecondaryVideo' END AS reason FROM y""",
    "p9_feature_cells": with_views("cells") + _FC + "SELECT * FROM fc",
    "j18_cell_extents": with_views("cells") + _FC + "SELECT title_id, ord, first_sector AS start_lba, greatest(last_sector - first_sector + 1, 0) AS sector_count, CAST(sum(greatest(last_sector - first_sector + 1, 0)) OVER (PARTITION BY title_id) * 2048 AS BIGINT) AS size_bytes FROM fc",
    "w4_chapters_from_marks": with_views("marks") + _CH + "SELECT title_id, n, time_secs, CAST(n AS VARCHAR) AS name FROM ch",
    "w27_shift_chapters": with_views("marks", "cells") + _CH + _FC + ", gone AS (SELECT title_id, sum(duration_secs) AS g FROM cells c WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.title_id = c.title_id AND fc.ord = c.ord) GROUP BY ALL) SELECT ch.title_id, n, greatest(time_secs - coalesce(g, 0), 0.0) AS time_secs, CAST(n AS VARCHAR) AS name FROM ch LEFT JOIN gone USING (title_id)",
    "a10_chapter_summary": with_views("marks") + ", m AS (SELECT title_id, count(*) AS chapters FROM marks WHERE mark_type <= 1 GROUP BY ALL), d AS (SELECT title_id, CAST(sum(out_time - in_time) / 45000 AS DOUBLE) AS duration_secs FROM play_items GROUP BY ALL) SELECT * FROM m JOIN d USING (title_id)",
    "j7_chapter_at": with_views("marks", "titles") + _CH + """, c AS (SELECT *, max(time_secs) OVER (PARTITION BY title_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS f FROM ch),
p AS (SELECT title_id, CAST(floor(size_bytes * k / 8) AS BIGINT) AS o, duration_secs, size_bytes FROM titles, (VALUES (1), (5)) t(k) WHERE size_bytes > 0)
SELECT p.title_id, p.o AS "offset", CAST(p.o / p.size_bytes * p.duration_secs AS DOUBLE) AS time_secs, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.title_id = p.title_id) THEN CAST(coalesce((SELECT max(n) FROM c WHERE c.title_id = p.title_id AND c.f <= p.o / p.size_bytes * p.duration_secs), 1) AS BIGINT) END AS chapter FROM p""",
    "a2_title_totals": with_views("titles") + ", s AS (SELECT title_id, CAST(sum(sector_count) AS BIGINT) AS total_sectors FROM extents GROUP BY ALL) SELECT title_id, total_sectors, total_sectors * 2048 AS bytes, total_sectors * 2048 / 1073741824 AS size_gb, format('{}h {:02d}m', CAST(floor(duration_secs / 3600) AS BIGINT), CAST(floor(duration_secs / 60) AS BIGINT) % 60) AS duration FROM titles JOIN s USING (title_id)",
    "a3_audio_richness": STN + _RICH + "SELECT * FROM rich",
    "t1_title_order": with_views("stn_streams", "titles") + _ST + _RICH + "SELECT disc_id, title_id, CAST(row_number() OVER (PARTITION BY disc_id ORDER BY size_bytes > 400000, size_bytes DESC, duration_secs DESC, coalesce(lossless, false) DESC, coalesce(max_channels, 0) DESC, coalesce(tracks, 0) DESC, playlist, title_id) AS INT) AS place FROM titles LEFT JOIN rich USING (title_id)",
    "w24_default_tracks": STN + "SELECT title_id, ord, kind, kind IN ('video', 'audio') AND NOT secondary AND row_number() OVER (PARTITION BY title_id, kind, secondary ORDER BY ord) = 1 AS is_default FROM st",
    "p12_disc_format": with_views("stn_streams", "titles", "discs") + _ST + """, f AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY playlist, title_id) AS p FROM titles),
u AS (SELECT disc_id, arg_min(video_format = 8, (p, ord)) AS uhd FROM f JOIN st ON st.title_id = f.title_id AND st.kind = 'video' WHERE p <= 3 AND video_format BETWEEN 1 AND 8 GROUP BY disc_id)
SELECT discs.disc_id, CASE discs.disc_id % 10 WHEN 0 THEN 'FMTS' WHEN 1 THEN 'UHD' WHEN 2 THEN 'BD' WHEN 7 THEN 'HD DVD' WHEN 8 THEN 'DVD' WHEN 9 THEN 'Unknown' ELSE CASE WHEN coalesce(uhd, false) THEN 'UHD' ELSE 'BD' END END AS format FROM discs LEFT JOIN u USING (disc_id)""",
    "j9_audit_streams": with_views("clip_streams") + _AUD + "SELECT * FROM au",
    "a9_audit_counts": with_views("clip_streams") + _AUD + "SELECT title_id, count(*) FILTER (class = 'clip_only') AS clip_only, count(*) FILTER (class = 'playlist_only') AS playlist_only, count(*) FILTER (class = 'match') AS match, count(*) FILTER (class = 'divergent') AS divergent FROM au GROUP BY title_id",
    "r4_union_pids": with_views("clip_streams") + "SELECT title_id, pid FROM clip_streams UNION SELECT title_id, pid FROM stn_streams",
    "w26_select_label_source": _LS + "SELECT disc_id, source_name, doc_id FROM chosen",
    "j10_fill_label_gaps": _LS + "SELECT disc_id, stream_type, stream_number, language FROM chosen UNION ALL SELECT disc_id, stream_type, stream_number, language FROM ls WHERE source_name = 'src0' AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.disc_id = ls.disc_id AND c.stream_type = ls.stream_type AND c.stream_number = ls.stream_number)",
    "j11_append_orphans": STN + _A16 + """, f AS (SELECT * FROM st WHERE kind IN ('audio', 'subtitle') QUALIFY row_number() OVER (PARTITION BY title_id, pid ORDER BY ord) = 1),
o AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.title_id = f.title_id AND lab.kind = f.kind AND lab.language = f.language AND lab.codec = f.codec)), t AS (SELECT title_id, kind, max(number) AS top FROM lab GROUP BY ALL)
SELECT * FROM lab UNION ALL SELECT o.title_id, o.kind, o.language, o.codec, coalesce(top, 0) + row_number() OVER (PARTITION BY o.title_id, o.kind ORDER BY o.ord) FROM o LEFT JOIN t USING (title_id, kind)""",
    "j12_apply_labels": STN + """, s AS (SELECT *, row_number() OVER (PARTITION BY title_id, kind ORDER BY ord) AS number, video_rate AS v, CASE audio_format WHEN 1 THEN 'mono' WHEN 3 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 12 THEN '7.1' ELSE 'unknown' END AS channels FROM st),
l AS (SELECT *, v <> 8 AS has, CASE v % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Commentary' ELSE 'Descriptive' END AS lp, CASE v % 4 WHEN 1 THEN 'Sdh' WHEN 2 THEN 'Forced' ELSE 'None' END AS lq,
 CASE v % 7 WHEN 0 THEN '' WHEN 1 THEN 'Dolby Atmos' WHEN 2 THEN 'AC-3 2.0' WHEN 3 THEN 'DTS:X' WHEN 4 THEN 'dts-hd master audio' WHEN 5 THEN 'Commentary' ELSE 'TrueHD 7.1' END AS hint, CASE v % 5 WHEN 2 THEN '(Canadian)' WHEN 4 THEN '(European)' ELSE '' END AS var,
 CASE codec WHEN 'TrueHD' THEN 'Dolby TrueHD' WHEN 'AC-3' THEN 'Dolby Digital' WHEN 'EAC-3' THEN 'Dolby Digital Plus' WHEN 'DTS-HD MA' THEN 'DTS-HD Master Audio' WHEN 'DTS-HD HR' THEN 'DTS-HD High Resolution' WHEN 'DTS' THEN 'DTS' WHEN 'LPCM' THEN 'LPCM' END AS brand,
 CASE channels WHEN 'mono' THEN ' 1.0' WHEN 'stereo' THEN ' 2.0' WHEN '5.1' THEN ' 5.1' WHEN '7.1' THEN ' 7.1' ELSE '' END AS lay FROM s),
m AS (SELECT *, CASE WHEN hint = '' THEN '' WHEN hint = 'Dolby Atmos' AND codec IN ('TrueHD', 'EAC-3') THEN hint WHEN hint = 'DTS:X' AND codec NOT IN ('TrueHD', 'EAC-3', 'AC-3', 'LPCM') THEN hint ELSE coalesce(brand || lay, '') END AS descr FROM l),
n AS (SELECT *, trim(var || ' ' || descr) AS lab FROM m)
SELECT title_id, ord, kind, codec, channels, number, CASE WHEN kind = 'audio' AND has THEN lp ELSE 'Normal' END AS purpose, CASE WHEN kind = 'subtitle' AND has THEN lq ELSE 'None' END AS qualifier, kind = 'subtitle' AND has AND lq = 'Forced' AS forced,
 CASE WHEN kind = 'audio' AND has THEN CASE WHEN lab <> '' THEN lab WHEN lp = 'Normal' THEN 'Track ' || pid ELSE '' END ELSE '' END AS label FROM n""",
    "a16_dedup_stn_labels": STN + _A16 + "SELECT * FROM n16",
    "a13_labels_by_language": with_views("labels_src") + ", g AS (SELECT disc_id, language, min(doc_id) AS first FROM labels_src GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY first) AS number FROM g",
    "j15_match_drive": "SELECT s_suppkey, n_name || '|' || s_nationkey || '|1.0|x' AS match_key, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS profile FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "j14_extraction_report": _J14 + "SELECT * FROM rep",
    "a15_extraction_rollup": _J14 + "SELECT disc_id, CAST(sum(bytes_good) AS BIGINT) AS bytes_good, CAST(sum(bytes_unreadable) AS BIGINT) AS bytes_unreadable, bool_and(complete) AS complete FROM rep GROUP BY ROLLUP (disc_id)",
    "r5_name_collisions": "WITH " + _PG + """, ok AS (SELECT DISTINCT disc_id, path FROM pg WHERE NOT regexp_matches(path, '[<>:"|?*\\\\]|(^|/)[. ]*(/|$)')), q AS (SELECT disc_id, path, path AS way FROM ok UNION ALL SELECT disc_id, path, path || '.' FROM ok
 UNION ALL SELECT disc_id, '_con.x/' || path, 'con.x/' || path FROM ok UNION ALL SELECT disc_id, '_con.x/' || path, '_con.x/' || path FROM ok),
h AS (SELECT DISTINCT disc_id, array_to_string(list_transform(string_split(path, '/'), lambda p: regexp_replace(p, '[. ]+$', '')), '/') AS host, way FROM q)
SELECT disc_id, host, count(*) AS paths FROM h GROUP BY ALL HAVING count(*) > 1""",
    "r6_strip_top_level": "WITH " + _PG + "SELECT page_id, '/BDMV/AACS/' || path AS path FROM pg WHERE page_id % 4 <> 0",
    "f1_f5_stream_codes": with_views("stn_streams") + f", x AS (SELECT *, {_CODEC} AS codec, {_case('video_format', S.RESOLUTIONS, chr(39) + 'unknown' + chr(39))} AS resolution FROM stn_streams) SELECT title_id, ord, codec, CASE WHEN codec IN ('HEVC', 'H.264', 'VC-1', 'MPEG-2') THEN 'video' WHEN codec = 'PGS' THEN 'subtitle' WHEN codec = 'Unknown' THEN 'unknown' ELSE 'audio' END AS kind, resolution,"
    + " CAST(CASE WHEN resolution IN ('480i', '480p', '576i', '576p') THEN 720 WHEN resolution = '720p' THEN 1280 WHEN resolution = '2160p' THEN 3840 ELSE 1920 END AS INT) AS width, resolution = '2160p' AS uhd, resolution IN ('480i', '576i', '1080i') AS interlaced, "
    + _case("video_rate", {k: v[1] for k, v in S.FRAME_RATES.items()}, "0") + " AS rate_num, " + _case("audio_format", {k: v[0] for k, v in S.CHANNELS.items()}, "'unknown'") + " AS channels, " + _case("audio_format", {k: v[1] for k, v in S.CHANNELS.items()}, "6") + " AS channel_count FROM x",
    "f15_f16_label_text": with_views("label_text") + f"SELECT doc_id, CASE WHEN contains({_LOW}, 'brazilian portuguese') THEN 'por' WHEN {_WORD('english')} THEN 'eng' WHEN {_WORD('french')} THEN 'fra' END AS code, CASE WHEN contains({_LOW}, 'brazilian portuguese') THEN 'Brazilian' WHEN {_WORD('english')} OR {_WORD('french')} THEN '' END AS variant,"
    + f" CASE WHEN contains({_LOW}, 'audio description') THEN 'Descriptive' WHEN contains({_LOW}, 'music only') THEN 'Score' WHEN {_WORD('commentary')} THEN 'Commentary' ELSE 'Normal' END AS purpose, CASE WHEN {_WORD('sdh')} OR {_WORD('captions')} THEN 'Sdh' WHEN {_WORD('forced')} THEN 'Forced' ELSE 'None' END AS qualifier FROM label_text",
    "f7_f33_part_values": """WITH x AS (SELECT *, CAST(p_size AS BIGINT) AS z FROM part), b AS (SELECT *, CASE WHEN z // 16 > 9 OR z % 16 > 9 THEN 0 ELSE z // 16 * 10 + z % 16 END AS v FROM x)
SELECT p_partkey, CAST((z % 3) * 3600 + v * 60 + v AS DOUBLE) AS bcd, CAST((p_partkey * 3003 * 100000 + 4) // 9 AS BIGINT) AS ns, p_partkey * 7 // 1000 AS category, p_partkey * 777 % 2048 AS byte, CASE WHEN p_partkey * 30000 > 24000000 THEN 2 ELSE 1 END AS layers,
 regexp_replace(regexp_replace(p_name, '[A-Za-z]', 'A', 'g'), '[0-9]', '0', 'g') AS masked, format('{:02d}:{:02d}:{:02d}.{:03d}', p_partkey * 3 // 2 // 3600, p_partkey * 3 // 2 // 60 % 60, p_partkey * 3 // 2 % 60, p_partkey * 1500 % 1000) AS at, z % 4 IN (2, 3) AS secondary FROM b""",
}
