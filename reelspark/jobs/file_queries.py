"""Queries of single functions and of readers over tables packed as files, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import scalars as S
from reelspark.jobs.catalog_queries import _CH, STN, chapters, streams
from reelspark.jobs.range_queries import _STATS, LOG, OVERLAY, overlaid
from reelspark.operators import ranges as R
from reelspark.sources import files as X
from reelspark.sources import playlists as P
from reelspark.sources.views import spark_view as view
from reelspark.sources.views import with_views


def events(s, d):
    return view(s, d, "events")


def hexed(value, digits):
    """The lowest digits of a whole number in hex."""
    return F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(digits))


def packed_playlists(s, d):
    """Each title's play items and marks as the bytes of a playlist file."""
    items = view(s, d, "play_items")
    item = F.concat(F.lit("0014"), F.hex(F.col("clip_id").cast("binary")), F.hex(F.lit("M2TS").cast("binary")), F.lit("010000"), hexed(F.col("in_time"), 8), hexed(F.col("out_time"), 8))
    i = items.groupBy("title_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", item.alias("h")))), lambda x: x["h"]), "").alias("items"), F.count("*").alias("n"))
    mark = F.concat(F.lit("00"), hexed(F.col("mark_type"), 2), hexed(F.col("play_item_ref"), 4), hexed(F.col("timestamp_45k"), 8), F.lit("FFFF00000000"))
    m = view(s, d, "marks").groupBy("title_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mark_no", mark.alias("h")))), lambda x: x["h"]), "").alias("marks"), F.count("*").alias("k"))
    body = F.concat(F.lit("000000000000"), hexed(F.col("n"), 4), F.lit("0000"), "items")
    place = 40 + F.length(body) / 2
    head = F.concat(F.hex(F.lit("MPLS0200").cast("binary")), hexed(F.lit(40), 8), hexed(place, 8), F.lit("00" * 24))
    tail = F.concat(F.lit("00000000"), hexed(F.col("k"), 4), "marks")
    return i.join(m, "title_id").select(F.col("title_id").cast("string").alias("path"), F.unhex(F.concat(head, body, tail)).alias("content"))


def s13(s, d):
    parsed = P.parse_playlists(packed_playlists(s, d))
    return P.rows_of(parsed, "play_items").select(F.col("path").cast("long").alias("title_id"), "item_no", "clip_id", "in_time", "out_time")


def s13_marks(s, d):
    parsed = P.parse_playlists(packed_playlists(s, d))
    return P.rows_of(parsed, "marks").select(F.col("path").cast("long").alias("title_id"), "mark_no", "mark_type", "play_item_ref", "timestamp_45k")


def s14(s, d):
    """Entry points of each user's events, packed as clip info and read back."""
    e = events(s, d)
    fine = e.select(F.col("user_id").alias("c"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("n"), (F.col("event_id") % 2048 * (1 << 17) + F.col("event_id") % 131072).alias("w"))
    f = fine.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", hexed(F.col("w"), 8).alias("h")))), lambda x: x["h"]), "").alias("f"), F.count("*").alias("n"))
    nc = F.ceil(F.col("n") / 8).cast("int")
    coarse = F.array_join(F.transform(F.sequence(F.lit(0), nc - 1), lambda i: F.concat(hexed(i * 8 * (1 << 14) + i + 1, 8), hexed(i * 200000, 8))), "")
    # 14 bits of kind, 16 of coarse rows, 18 of fine rows, 32 of the place
    counts = F.concat(hexed(nc.cast("long") * (1 << 18) + F.col("n"), 12))
    ep = F.concat(F.lit("00011011"), counts, hexed(F.lit(14), 8), hexed(4 + 8 * nc, 8), coarse, "f")
    cpi = F.concat(hexed(F.length(ep) / 2 + 2, 8), F.lit("0001"), ep)
    head = F.concat(F.hex(F.lit("HDMV0200").cast("binary")), F.lit("00" * 4), F.lit("00" * 4), hexed(F.lit(60), 8), F.lit("00" * 36), hexed(F.col("n") * 32, 8))
    packed = f.select(F.col("c").cast("string").alias("path"), F.unhex(F.concat(head, cpi)).alias("content"))
    parsed = P.parse_clip_infos(packed)
    rows = P.rows_of(parsed, "fine").join(parsed.select("path", "source_packets", F.size("coarse").cast("long").alias("coarse")), "path")
    return rows.select(F.col("path").cast("long").alias("clip_no"), "n", "pts", "spn", "source_packets", "coarse")


def wire_frames(s, d):
    f = view(s, d, "frames")
    data = F.col("ctype").cast("binary")
    return f.select("title_id", "idx", (F.col("track") + F.when(F.col("idx") % 40 == 39, 256).otherwise(0)).alias("track"), (F.col("pts_ns") - 10**12).alias("pts"), "keyframe", F.when(F.col("size") % 3 != 0, F.col("size")).alias("duration_ns"), data.alias("data"))


def s9(s, d):
    w = X.frame_wire(wire_frames(s, d))
    return w.select("title_id", "idx", F.lower(F.hex("wire")).alias("wire"), "error")


def s8(s, d):
    """Each title's frames as a wire file, read back."""
    w = X.frame_wire(wire_frames(s, d)).filter("error IS NULL").groupBy("title_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.hex("wire").alias("h")))).alias("l"))
    files = w.select(F.col("title_id").cast("string").alias("path"), F.unhex(F.array_join(F.transform("l", lambda x: x["h"]), "")).alias("content"))
    return X.parse_frame_wire(files).select(F.col("file").cast("long").alias("title_id"), "idx", F.col("track").cast("long").alias("track"), "pts", "keyframe", "duration_ns", F.col("data").cast("string").alias("data"), "error")


def s10(s, d):
    st = streams(s, d).groupBy("title_id").agg(F.to_json(F.struct(F.lit(1).alias("v"), F.concat(F.lit("T"), F.col("title_id").cast("string")).alias("title"), F.array_sort(F.collect_list(F.struct("ord", F.col("kind").alias("type"), "pid", "codec", "language"))).alias("streams"))).alias("j"))
    k = F.col("title_id") % 5
    head = F.when(k == 1, F.lit("464D4B5600020000")).when(k == 2, F.lit("4749463839610000")).when(k == 3, F.lit("464D4B")).otherwise(F.lit("464D4B5600010000"))
    size = F.octet_length("j") + F.when(k == 4, 1).otherwise(0)
    body = F.when(k == 3, "").otherwise(F.concat(hexed(size, 8), F.hex(F.col("j").cast("binary"))))
    files = st.select(F.col("title_id").cast("string").alias("path"), F.unhex(F.concat(head, body)).alias("content"))
    return X.parse_media_header(files).select(F.col("path").cast("long").alias("title_id"), "header.title", F.size(F.coalesce("header.streams", F.array())).cast("long").alias("streams"), "error")


def s12(s, d):
    c = chapters(s, d).withColumn("name", F.when(F.col("n") == 2, "").otherwise(F.concat(F.lit("a<b> & "), "name")))
    return X.export_chapters(c, "xml").withColumnRenamed("text", "xml").join(X.export_chapters(c, "vtt").withColumnRenamed("text", "vtt"), "title_id").join(X.export_chapters(c, "ogm").withColumnRenamed("text", "ogm"), "title_id")


def f9(s, d):
    p = view(s, d, "play_items")
    t = F.col("in_time") % 36000
    long = F.format_string("%02d:%02d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60, t % 30)
    short = F.format_string("%02d:%02d:%02d", F.floor(t / 60) % 60, t % 60, t % 30)
    text = F.when(F.col("item_no") % 3 == 0, short).when(F.col("item_no") % 3 == 1, long).otherwise("bad")
    return p.select("title_id", "item_no", S.parse_timecode(text, 30).alias("seconds"))


def packet_hex(s, d):
    """A header's six bytes of each event: sync or not, pid, start, adaptation code, counter, adaptation length and flags."""
    e, v = events(s, d), F.col("event_id")
    two = F.when(v % 3 == 0, 0x4000).otherwise(0) + v % 8192
    third = v % 4 * 16 + v % 16
    return e.select("event_id", F.concat(F.when(v % 11 == 0, "00").otherwise("47"), hexed(two, 4), hexed(third, 2), hexed(v % 200, 2), hexed(F.when(v % 2 == 0, 128).otherwise(0), 2)).alias("h"))


def pes_hex(s, d):
    e, v = events(s, d), F.col("event_id")
    pts = (v * 7_000_003) % (1 << 33)
    stamp = lambda x, mark: F.concat(hexed(F.shiftright(x, 30) * 2 + 1, 2), hexed(F.shiftright(x, 22) % 256, 2), hexed(F.shiftright(x, 15) % 128 * 2 + 1, 2), hexed(F.shiftright(x, 7) % 256, 2), hexed(x % 128 * 2 + mark, 2))
    stream = F.when(v % 5 == 0, "BF").otherwise("E0")
    flags = F.when(v % 4 == 0, "00").when(v % 4 == 1, "80").otherwise("C0")
    start = F.when(v % 13 == 0, "000002").otherwise("000001")
    return e.select("event_id", F.concat(start, stream, F.lit("000080"), flags, F.lit("0A"), stamp(pts, F.when(v % 7 == 0, 0).otherwise(1)), stamp(F.greatest(pts - 3003, F.lit(0)), F.lit(1))).alias("h"))


def f27(s, d):
    z = F.col("p_size")
    bit = lambda k: F.shiftright(z, k) % 2 == 1
    p = view(s, d, "part")
    return p.select("p_partkey", S.field_order(bit(0), bit(1), bit(2), bit(3)).alias("field_order"), S.nb_fields(bit(0), bit(1), bit(2), bit(3), bit(4)).alias("nb_fields"))


def f28(s, d):
    v = F.col("event_id")
    h = F.concat(F.when(v % 3 == 0, "15").otherwise("16"), F.lit("00" * 12), hexed(v % 2, 2), F.lit("00" * 3), F.when(v % 5 == 0, "40").otherwise("80"))
    return events(s, d).select("event_id", S.display_set_is_forced(F.when(v % 7 == 0, F.substring(h, 1, 20)).otherwise(h)).alias("forced"))


def f34(s, d):
    st = streams(s, d)
    return st.select("title_id", "ord", S.track_file(F.lit("A: b"), F.col("ord"), F.col("language"), F.col("codec"), (F.col("pid") % 3 - 1) * 40).alias("file"))


def f31(s, d):
    v = F.col("event_id")
    name = F.concat(F.when(v % 4 == 0, "vts_").when(v % 4 == 1, "VTS_").otherwise("VIDEO_TS_"), F.lpad((v % 100).cast("string"), 2, "0"), F.lit("_"), (v % 12).cast("string"), F.when(v % 5 == 0, ".IFO").otherwise(".vob"))
    return events(s, d).select("event_id", S.vts_group(name).alias("grp"), S.is_title_vob(name).alias("vob"), S.playlist_number(F.concat(F.lpad((v % 1000).cast("string"), 5, "0"), F.when(v % 3 == 0, ".txt").otherwise(".mpls"))).alias("number"))


def f23(s, d):
    st = R.range_stats(overlaid(s, d))
    return st.select("disc_id", S.progress_percent(F.col("bytes_good"), F.col("bytes_total"), 100.0).alias("good"), S.progress_percent(F.col("bytes_pending"), F.when(F.col("disc_id") % 3 == 0, 0).otherwise(F.col("bytes_total")), 0.0).alias("pending"))


def f35(s, d):
    st = R.range_stats(overlaid(s, d))
    none = F.when(F.col("disc_id") % 4 == 0, 0)
    return st.select("disc_id", S.next_action(F.when(F.col("disc_id") % 4 == 1, 1).otherwise(F.col("bytes_nontried")), F.coalesce(none, F.col("bytes_retryable")) + F.coalesce(none, F.col("bytes_unreadable")), F.when(F.col("disc_id") % 5 != 0, F.col("bytes_total"))).alias("action"))


QUERIES = {
    "s8_read_frame_wire": s8,
    "s9_write_frame_wire": s9,
    "s10_read_media_header": s10,
    "s12_export_chapters": s12,
    "s13_read_playlists": s13,
    "s13_playlist_marks": s13_marks,
    "s14_read_clip_infos": s14,
    "f5_sample_rate": lambda s, d: view(s, d, "stn_streams").select("title_id", "ord", S.sample_rate_hz(F.col("pid") % 16).alias("hz")),
    "f9_parse_timecode": f9,
    "f12_ts_header": lambda s, d: packet_hex(s, d).select("event_id", S.ts_header(F.col("h")).alias("t")).select("event_id", "t.*"),
    "f13_pes_header": lambda s, d: pes_hex(s, d).select("event_id", S.pes_header(F.col("h")).alias("t")).select("event_id", "t.*"),
    "f17_codec_and_language": lambda s, d: streams(s, d).select("title_id", "ord", S.codec_alias(F.element_at(F.array(*map(F.lit, ("mlp", "AC3", "ddl", "DTS", "Atmos"))), (F.col("pid") % 5 + 1).cast("int"))).alias("alias"), S.language_name(F.col("language")).alias("name"), S.normalized_language(F.concat(F.lit(" "), F.upper("language"))).alias("code")),
    "f19_video_label": lambda s, d: view(s, d, "stn_streams").select("title_id", "ord", S.resolution(F.col("video_format")).alias("r"), (F.col("pid") % 4 == 0).alias("second"), F.element_at(F.array(*map(F.lit, ("SDR", "HDR10", "Dolby Vision"))), (F.col("ord") % 3 + 1).cast("int")).alias("hdr")).select("title_id", "ord", S.video_label(F.lit("HEVC"), F.when(F.col("r") == "unknown", 0).otherwise(S.pixels(F.col("r"))["width"]), F.when(F.col("r") == "unknown", 0).otherwise(S.pixels(F.col("r"))["height"]), S.is_interlaced(F.col("r")), F.col("hdr"), F.col("second")).alias("label")),
    "f23_progress_percent": f23,
    "f24_ecc_sectors": lambda s, d: view(s, d, "discs").select("disc_id", S.ecc_sectors(F.when(F.col("disc_id") % 3 == 0, "DVD").otherwise("BD")).alias("sectors")),
    "f27_fields": f27,
    "f28_forced_display_set": f28,
    "f31_file_names": f31,
    "f32_sub_stream_pids": lambda s, d: view(s, d, "part").select("p_partkey", S.dvd_audio_pid(F.col("p_partkey") % 256).alias("audio"), S.dvd_subtitle_pid(F.col("p_partkey") % 256).alias("subtitle"), S.dvd_audio_sub_id(F.when(F.col("p_size") % 3 == 0, "DTS").otherwise("LPCM"), F.col("p_size") % 10).alias("sub_id")),
    "f34_track_file": f34,
    "f35_next_action": f35,
}

_WIRE = with_views("frames") + """, wf AS (SELECT title_id, idx, track + CASE WHEN idx % 40 = 39 THEN 256 ELSE 0 END AS track, pts_ns - 1000000000000 AS pts, keyframe, CASE WHEN size % 3 <> 0 THEN size END AS duration_ns, ctype AS data FROM frames)"""
_LE = lambda v, n: " || ".join(f"printf('%02x', (({v}) >> {8 * k}) & 255)" for k in range(n))
_AT = lambda t, n: f"printf('%02d:%02d:%02d.%0{n}d', CAST(round({t} * 1e{n}) AS BIGINT) // {10**n} // 3600, CAST(round({t} * 1e{n}) AS BIGINT) // {10**n} // 60 % 60, CAST(round({t} * 1e{n}) AS BIGINT) // {10**n} % 60, CAST(round({t} * 1e{n}) AS BIGINT) % {10**n})"
_NAME = "replace(replace(replace(CASE WHEN name = '' THEN CAST(n AS VARCHAR) ELSE name END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE = {
    "s8_read_frame_wire": _WIRE + "SELECT title_id, CAST(row_number() OVER (PARTITION BY title_id ORDER BY idx) - 1 AS BIGINT) AS idx, track, pts, keyframe, duration_ns, data, CAST(NULL AS VARCHAR) AS error FROM wf WHERE track <= 255",
    "s9_write_frame_wire": _WIRE + f"""SELECT title_id, idx, CASE WHEN track <= 255 THEN {_LE("track", 1)} || {_LE("pts", 8)} || CASE WHEN keyframe THEN '01' ELSE '00' END || CASE WHEN duration_ns IS NULL THEN 'ffffffffffffffff' ELSE {_LE("duration_ns", 8)} END || '01000000' || lower(hex(data)) END AS wire, CASE WHEN track > 255 THEN 'track' END AS error FROM wf""",
    "s10_read_media_header": STN + """, g AS (SELECT title_id, count(*) AS n, title_id % 5 AS k FROM st GROUP BY title_id) SELECT title_id, CASE WHEN k = 0 THEN 'T' || title_id END AS title, CASE WHEN k = 0 THEN n ELSE 0 END AS streams,
 CASE k WHEN 1 THEN 'version' WHEN 3 THEN 'truncated' WHEN 4 THEN 'truncated' END AS error FROM g""",
    "s12_export_chapters": with_views("marks") + _CH + f""", c AS (SELECT title_id, n, time_secs AS t, CASE WHEN n = 2 THEN '' ELSE 'a<b> & ' || n END AS name, coalesce(lead(time_secs) OVER (PARTITION BY title_id ORDER BY n), time_secs) AS e FROM ch)
SELECT title_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE Chapters SYSTEM "matroskachapters.dtd">' || chr(10) || '<Chapters>' || chr(10) || '  <EditionEntry>' || chr(10) || string_agg('    <ChapterAtom>' || chr(10) || '      <ChapterTimeStart>' || {_AT("t", 9)} || '</ChapterTimeStart>' || chr(10)
 || '      <ChapterDisplay>' || chr(10) || '        <ChapterString>' || {_NAME} || '</ChapterString>' || chr(10) || '        <ChapterLanguage>und</ChapterLanguage>' || chr(10) || '      </ChapterDisplay>' || chr(10) || '    </ChapterAtom>' || chr(10), '' ORDER BY n) || '  </EditionEntry>' || chr(10) || '</Chapters>' || chr(10) AS xml,
 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {_AT("t", 3)} || ' --> ' || {_AT("e", 3)} || chr(10) || 'Chapter ' || name || chr(10) || chr(10), '' ORDER BY n) AS vtt,
 string_agg(printf('CHAPTER%02d=', n) || {_AT("t", 3)} || chr(10) || printf('CHAPTER%02dNAME=', n) || CASE WHEN name = '' THEN CAST(n AS VARCHAR) ELSE name END || chr(10), '' ORDER BY n) AS ogm FROM c GROUP BY title_id""",
    "s13_read_playlists": with_views("play_items") + "SELECT title_id, item_no, clip_id, in_time, out_time FROM play_items",
    "s13_playlist_marks": with_views("marks") + "SELECT title_id, mark_no, CAST(mark_type AS INT) AS mark_type, CAST(play_item_ref AS INT) AS play_item_ref, timestamp_45k FROM marks",
    "s14_read_clip_infos": """WITH f AS (SELECT user_id AS clip_no, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n, event_id % 2048 AS pts, event_id % 131072 AS spn, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT clip_no, n, pts, spn, c * 32 AS source_packets, (c + 7) // 8 AS coarse FROM f""",
    "f5_sample_rate": with_views("stn_streams") + "SELECT title_id, ord, CAST(CASE pid % 16 WHEN 4 THEN 96000 WHEN 5 THEN 192000 ELSE 48000 END AS INT) AS hz FROM stn_streams",
    "f9_parse_timecode": with_views("play_items") + "SELECT title_id, item_no, CAST(CASE item_no % 3 WHEN 0 THEN t // 60 % 60 * 60 + t % 60 + t % 30 / 30.0 WHEN 1 THEN t // 3600 * 3600 + t // 60 % 60 * 60 + t % 60 + t % 30 / 30.0 END AS DOUBLE) AS seconds FROM (SELECT *, in_time % 36000 AS t FROM play_items)",
    "f12_ts_header": """SELECT event_id, event_id % 11 <> 0 AS sync, CAST(event_id % 8192 AS INT) AS pid, event_id % 3 = 0 AS pusi, CAST(event_id % 4 AS INT) AS afc, CAST(event_id % 16 AS INT) AS cc,
 CAST(CASE event_id % 4 WHEN 1 THEN 4 WHEN 3 THEN CASE WHEN event_id % 200 < 183 THEN 5 + event_id % 200 END END AS INT) AS payload_offset, event_id % 4 = 3 AND event_id % 200 > 0 AND event_id % 2 = 0 AS discontinuity FROM events""",
    "f13_pes_header": """WITH e AS (SELECT event_id AS v, event_id * 7000003 % 8589934592 AS p FROM events) SELECT v AS event_id, CASE WHEN v % 13 <> 0 AND v % 5 <> 0 AND v % 4 <> 0 AND v % 7 <> 0 THEN p END AS pts,
 CASE WHEN v % 13 <> 0 AND v % 5 <> 0 AND v % 4 >= 2 THEN greatest(p - 3003, 0) END AS dts, CAST(CASE WHEN v % 13 = 0 THEN 0 WHEN v % 5 = 0 THEN 6 ELSE 19 END AS INT) AS header_len FROM e""",
    "f17_codec_and_language": STN + "SELECT title_id, ord, CASE pid % 5 WHEN 0 THEN 'TrueHD' WHEN 1 THEN 'Dolby Digital' WHEN 2 THEN 'Dolby Digital Plus' WHEN 3 THEN 'DTS' ELSE 'Dolby Atmos' END AS alias, CASE language WHEN 'eng' THEN 'English' WHEN 'fra' THEN 'French' WHEN 'deu' THEN 'German' ELSE '' END AS name, language AS code FROM st",
    "f19_video_label": with_views("stn_streams") + """, x AS (SELECT title_id, ord, pid % 4 = 0 AS second, CASE ord % 3 WHEN 0 THEN 'SDR' WHEN 1 THEN 'HDR10' ELSE 'Dolby Vision' END AS hdr, CASE video_format WHEN 1 THEN ' 480i' WHEN 2 THEN ' 576i' WHEN 3 THEN ' 480p' WHEN 4 THEN ' 1080i' WHEN 5 THEN ' 720p' WHEN 6 THEN ' 1080p' WHEN 7 THEN ' 576p' WHEN 8 THEN ' 4K' ELSE '' END AS r FROM stn_streams)
SELECT title_id, ord, CASE WHEN second THEN CASE WHEN hdr = 'Dolby Vision' THEN 'Dolby Vision EL' ELSE '' END ELSE 'HEVC' || r || CASE WHEN hdr = 'SDR' THEN '' ELSE ' ' || hdr END END AS label FROM x""",
    "f23_progress_percent": LOG + OVERLAY + f", stats AS ({_STATS}) SELECT disc_id, CAST(CASE WHEN bytes_total = 0 THEN 100.0 ELSE bytes_good * 100.0 / bytes_total END AS DOUBLE) AS good, CAST(CASE WHEN disc_id % 3 = 0 THEN 0.0 ELSE bytes_pending * 100.0 / bytes_total END AS DOUBLE) AS pending FROM stats",
    "f24_ecc_sectors": with_views("discs") + "SELECT disc_id, CAST(CASE WHEN disc_id % 3 = 0 THEN 16 ELSE 32 END AS INT) AS sectors FROM discs",
    "f27_fields": """WITH x AS (SELECT p_partkey, p_size % 2 = 1 AS f, p_size // 2 % 2 = 1 AS s, p_size // 4 % 2 = 1 AS p, p_size // 8 % 2 = 1 AS t, p_size // 16 % 2 = 1 AS r FROM part)
SELECT p_partkey, CASE WHEN f AND (s OR p) THEN 'progressive' WHEN t THEN 'tff' ELSE 'bff' END AS field_order, CAST(CASE WHEN NOT f THEN 1 WHEN NOT r THEN 2 WHEN s THEN CASE WHEN t THEN 6 ELSE 4 END WHEN p THEN 3 ELSE 2 END AS INT) AS nb_fields FROM x""",
    "f28_forced_display_set": "SELECT event_id, event_id % 7 <> 0 AND event_id % 3 <> 0 AND event_id % 2 = 1 AND event_id % 5 = 0 AS forced FROM events",
    "f31_file_names": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'VTS_' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') END AS grp, event_id % 5 <> 0 AND event_id % 12 BETWEEN 1 AND 9 AS vob, CAST(event_id % 1000 AS INT) AS number FROM events""",
    "f32_sub_stream_pids": """WITH x AS (SELECT *, p_partkey % 256 AS k FROM part) SELECT p_partkey, CASE WHEN k BETWEEN 128 AND 143 OR k BETWEEN 160 AND 167 OR k BETWEEN 192 AND 199 THEN 48384 + k END AS audio, CASE WHEN k BETWEEN 32 AND 63 THEN k END AS subtitle,
 CASE WHEN p_size % 3 = 0 THEN 136 ELSE 160 END + least(p_size % 10, 7) AS sub_id FROM x""",
    "f34_track_file": STN + """SELECT title_id, ord, 'A_ b t' || printf('%02d', ord) || CASE WHEN language <> '' THEN ' ' || language ELSE '' END || ' ' || codec || CASE pid % 3 WHEN 0 THEN ' DELAY -40ms' WHEN 2 THEN ' DELAY 40ms' ELSE '' END || '.' ||
 CASE codec WHEN 'HEVC' THEN 'hevc' WHEN 'H.264' THEN 'h264' WHEN 'TrueHD' THEN 'thd' WHEN 'DTS-HD MA' THEN 'dtshd' WHEN 'AC-3' THEN 'ac3' WHEN 'EAC-3' THEN 'eac3' WHEN 'PGS' THEN 'sup' ELSE 'bin' END AS file FROM st""",
    "f35_next_action": LOG + OVERLAY + f", stats AS ({_STATS}) SELECT disc_id, CASE WHEN disc_id % 5 = 0 THEN 'sweep' WHEN disc_id % 4 = 1 THEN 'resume_sweep' WHEN disc_id % 4 = 0 THEN 'done' WHEN bytes_nontried > 0 THEN 'resume_sweep' WHEN bytes_retryable + bytes_unreadable > 0 THEN 'patch' ELSE 'done' END AS action FROM stats",
}
