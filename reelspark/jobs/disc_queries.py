"""Queries of packet assembly, DVD audio, XML titles, disc titles and paths, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import dvd as D
from reelspark.operators import packets as K
from reelspark.sources import files as X
from reelspark.sources.views import spark_view as view
from reelspark.sources.views import with_views


def packets(s, d):
    """The packet view with counters that mostly run on and a payload: after a start nine bytes of header, then the record's number."""
    p = view(s, d, "ts_packets")
    head = F.when(F.col("pusi"), "000001E00000800000").otherwise("")
    payload = F.unhex(F.concat(head, F.lpad(F.hex(F.col("rec_no").cast("long")), 8, "0")))
    return p.withColumn("cc", F.when(F.col("rec_no") % 6 == 0, (F.col("rec_no") * 7) % 16).otherwise(0)).withColumn("payload", payload)


def w6(s, d):
    u = K.assemble_pes(packets(s, d))
    return u.select("file_id", "pid", "first_rec", "discontinuity", F.hex("data").alias("data"))


def dvd_frames(s, d):
    e = view(s, d, "events")
    return e.select(F.col("user_id").alias("title_id"), (0x7E + F.col("event_id") % 12).alias("sub_id"), (1 + F.col("event_id") * 7 % 6).alias("channels"))


def j16(s, d):
    """Three AC-3 streams a title, remapped by what its frames were probed with."""
    p = D.substream_channels(dvd_frames(s, d))
    streams = view(s, d, "events").select(F.col("user_id").alias("title_id")).distinct().withColumn("ord", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    return D.remap_audio(streams.withColumn("pid", F.lit(0xBD80) + F.col("ord").cast("int")).withColumn("channels", (1 + (F.col("title_id") + F.col("ord")) % 6).cast("int")), p)


def clip_files(s, d):
    p = view(s, d, "part")
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "FEATURE_").when(F.col("p_partkey") % 3 == 1, "Feature").otherwise("menu"), F.col("p_partkey").cast("string"), F.lit(".EVO"))
    return p.select((F.col("p_partkey") % 20).alias("disc_id"), "p_partkey", name.alias("name"), F.col("p_size").cast("long").alias("size"))


def p11(s, d):
    c = clip_files(s, d)
    order = c.select("disc_id", F.col("p_partkey").alias("ord"), F.lower("name").alias("name"))
    return D.feature_clips(order, c.filter("size > 10"))


def j2(s, d):
    c = clip_files(s, d)
    clips = c.select("disc_id", (F.col("p_partkey") % 7).alias("number"), F.col("p_partkey").alias("ord"), F.lower("name").alias("file"), (F.col("size") * 1.0 - 5).alias("begin_secs"), (F.col("size") * 2000.0).alias("end_secs"))
    titles = clips.select("disc_id", "number").distinct().select("disc_id", "number", F.when(F.col("number") % 2 == 0, "").otherwise(F.concat(F.lit("t"), F.col("number").cast("string"))).alias("name"), F.lit(60.0).alias("duration_secs"))
    t = D.compose_xml_titles(titles, clips, c.filter("size > 10"))
    return t.select("disc_id", "number", "playlist", "size_bytes", F.size("clips").cast("long").alias("clips"), F.col("clips")[0]["clip_id"].alias("first"), F.aggregate("clips", F.lit(0).cast("long"), lambda a, x: a + x["out_time"] - x["in_time"]).alias("ticks"))


def s15(s, d):
    """Each disc's clips as an XML playlist of seven titles, read back."""
    c = clip_files(s, d).withColumn("number", F.col("p_partkey") % 7)
    one = F.concat(F.lit('<x:PrimaryAudioVideoClip src="file:///dvddisc/HVDVD_TS/'), F.regexp_replace("name", "EVO$", "MAP"), F.lit('" titleTimeBegin="00:00:01:30" titleTimeEnd="00:'), F.lpad(F.col("size").cast("string"), 2, "0"), F.lit(':00:00"/>'))
    t = c.groupBy("disc_id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("x")))), lambda v: v["x"]), "").alias("clips"))
    body = F.concat(F.lit('<x:Title titleNumber="'), F.col("number").cast("string"), F.lit('" id="n'), F.col("number").cast("string"), F.lit('" titleDuration="00:10:00:00">'), F.when(F.col("number") == 3, "").otherwise(F.col("clips")), F.lit('<x:ChapterList><x:Chapter titleTimeBegin="00:00:05:00"/><x:Chapter titleTimeBegin="bad"/></x:ChapterList></x:Title>'))
    doc = t.groupBy("disc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", body.alias("b")))), lambda v: v["b"]), "").alias("b"))
    files = doc.select(F.col("disc_id").cast("string").alias("path"), F.concat(F.lit('<x:Playlist xmlns:x="u"><x:TitleSet tickBase="30fps">'), "b", F.lit("</x:TitleSet></x:Playlist>")).alias("content"))
    r = D.read_xml_titles(files)
    return r.select(F.col("path").cast("long").alias("disc_id"), F.col("number").cast("long").alias("number"), "name", "duration_secs", F.size("clips").cast("long").alias("clips"), F.col("clips")[0]["file"].alias("file"), F.col("clips")[0]["begin_secs"].alias("begin_secs"), F.col("clips")[0]["end_secs"].alias("end_secs"), F.array_join(F.col("chapters").cast("array<string>"), ",").alias("chapters"))


def metadata(s, d):
    c = view(s, d, "customer")
    k = F.col("c_custkey")
    title = F.when(k % 4 == 0, "Blu-ray").when(k % 4 == 1, " ").otherwise(F.concat(F.lit("Disc "), "c_name", F.lit(" ")))
    return c.select((k % 30).alias("disc_id"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("folder"), F.concat(F.lit("bdmt_"), F.when(k % 3 == 0, "ENG").when(k % 3 == 1, "fra").otherwise("deu"), F.lit("_"), k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".xml")).alias("file"), title.alias("title"))


def s16(s, d):
    m = metadata(s, d).filter("file LIKE '%.xml'")
    body = F.concat(F.lit('<d:disclib xmlns:d="u" xmlns:i="v"><i:discinfo><i:title><i:name>'), "title", F.lit("</i:name></i:title><i:description>about "), "folder", F.lit("</i:description><i:numSets>3</i:numSets><i:setNumber>2</i:setNumber></i:discinfo></d:disclib>"))
    files = m.select(F.concat_ws("/", F.col("disc_id").cast("string"), "folder", F.regexp_replace("file", r"bdmt_(...)_(\d+)\.xml", "$2/bdmt_$1.xml")).alias("path"), body.alias("content"))
    # a file's rows are small and its parse is not, so they are dealt over all tasks first
    return X.disc_metadata(files.repartition(2 * s.sparkContext.defaultParallelism))


def tree(s, d):
    """Regions, their nations and their suppliers as folders and files of one disc."""
    r = view(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir"))
    n = view(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("name"), F.lit(True).alias("is_dir"))
    f = view(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent_id"), F.col("s_name").alias("name"), F.lit(False).alias("is_dir"))
    return r.unionByName(n).unionByName(f).withColumn("disc_id", F.lit(1))


def find(s, d):
    paths = D.resolve_paths(tree(s, d))
    asked = paths.select("disc_id", F.concat(F.upper("path"), F.lit("/")).alias("query"))
    return D.find_path(paths, asked).select("query", "id", "path")


def models(s, d):
    """Streams with the whole model of each, and some members left out."""
    from reelspark.functions import scalars as S
    from reelspark.jobs.catalog_queries import streams

    v, name = F.col("pid"), S.resolution(F.col("video_format"))
    rate, yes = S.frame_rate(F.col("video_rate")), lambda c, x: F.when(c, x)
    return streams(s, d).select(
        "title_id", "ord", "kind", "codec", "pid", "language", "secondary", name.alias("resolution"), S.pixels(name)["width"].alias("width"), S.pixels(name)["height"].alias("height"), S.is_interlaced(name).alias("interlaced"),
        rate["name"].alias("frame_rate"), rate["num"].alias("frame_rate_num"), rate["den"].alias("frame_rate_den"), F.when(v % 3 == 0, "hdr10").otherwise("sdr").alias("hdr"), F.lit("bt709").alias("color_space"), (v % 5 == 0).alias("mvc_dependent"),
        S.channels(F.col("audio_format")).alias("channels"), S.channel_count(F.col("audio_format")).alias("channel_count"), F.lit("48kHz").alias("sample_rate"), S.sample_rate_hz(v % 16).alias("sample_rate_hz"), F.when(v % 7 == 0, "commentary").otherwise("normal").alias("purpose"),
        (v % 2 == 0).alias("forced"), F.when(v % 6 == 0, "sdh").otherwise("none").alias("qualifier"), F.when(v % 4 == 0, "Main \"x\"").otherwise("").alias("label"),
        yes(v % 4 == 1, F.struct(F.lit(16).alias("num"), F.lit(9).alias("den"))).alias("display_aspect"), yes(v % 8 == 1, F.struct(F.lit(9).alias("matrix"), F.lit(16).alias("transfer"), F.lit(9).alias("primaries"), F.lit(0).alias("range"))).alias("measured_cicp"),
    )


def s11(s, d):
    from reelspark.jobs.catalog_queries import chapters

    t = view(s, d, "titles").select("title_id", "playlist", F.substring("playlist", 1, 5).cast("int").alias("playlist_id"), F.floor("duration_secs").cast("long").alias("duration_secs"), "size_bytes", F.when(F.col("title_id") % 2 == 0, "BdTs").otherwise("MpegPs").alias("content_format"))
    clips = view(s, d, "play_items").join(view(s, d, "clip_info"), "clip_id", "left").select("title_id", F.col("item_no").alias("ord"), "clip_id", F.floor((F.col("out_time") - F.col("in_time")) / 45000).alias("duration_secs"), F.coalesce("source_packets", F.lit(0)).alias("source_packets"))
    c = chapters(s, d).select("title_id", "n", F.floor("time_secs").cast("long").alias("time_secs"), F.col("n").cast("string").alias("name"))
    return X.title_json(t, clips, models(s, d), c)


def s6_headers(s, d):
    t = view(s, d, "titles")
    v = F.col("title_id")
    pair = lambda a, b: F.struct(F.lit(a).alias("num"), F.lit(b).alias("den"))
    colour = F.struct(F.lit(1).alias("primaries"), F.lit(1).alias("transfer"), F.lit(1).alias("matrix"), F.when(v % 2 == 0, "full").otherwise("limited").alias("range"))
    h = t.select("title_id", F.lit("hevc").alias("codec"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), pair(16, 9).alias("dar"), pair(24000, 1001).alias("frame_rate"), F.lit("progressive").alias("scan"), colour.alias("colour"), F.lit("bd").alias("medium"), F.concat(F.lit("/d/"), F.col("disc_id").cast("string")).alias("path"),
                 (v % 9).alias("title"), F.when(v % 3 == 0, "").otherwise(F.col("playlist")).alias("playlist"), F.when(v % 5 == 0, "VOL").alias("volume_id"), F.when(v % 4 == 0, v).alias("picture_count"))
    return X.video_index_headers(h)


def s6(s, d):
    f = view(s, d, "frames").withColumn("src_byte", F.when(F.col("size") % 7 != 0, F.col("src_byte"))).withColumn("nb_fields", F.when(F.col("size") % 2 == 0, F.col("size") % 3))
    return X.video_index_lines(f, F.col("track") == 0).select("title_id", F.col("n").cast("long").alias("n"), "line")


QUERIES = {
    "w6_assemble_pes": w6,
    "a6_substream_channels": lambda s, d: D.substream_channels(dvd_frames(s, d)),
    "j16_remap_audio": j16,
    "p11_feature_clips": p11,
    "j2_compose_xml_titles": j2,
    "s15_read_xml_playlists": s15,
    "s16_read_disc_metadata": s16,
    "w28_disc_title": lambda s, d: D.normalise_disc_title(metadata(s, d)),
    "j19_resolve_paths": lambda s, d: D.resolve_paths(tree(s, d)).select("id", "path"),
    "j19_find_path": find,
    "s11_title_json": s11,
    "s6_write_video_index": s6,
    "s6_video_index_headers": s6_headers,
}
_PK = with_views("ts_packets") + """, pk AS (SELECT file_id, pid, rec_no, pusi, discontinuity_flag, CASE WHEN rec_no % 6 = 0 THEN rec_no * 7 % 16 ELSE 0 END AS cc FROM ts_packets),
c AS (SELECT *, discontinuity_flag OR coalesce(cc <> (lag(cc) OVER w + 1) % 16 AND cc <> lag(cc) OVER w, false) AS gap FROM pk WINDOW w AS (PARTITION BY file_id, pid ORDER BY rec_no)),
u AS (SELECT *, sum(CAST(pusi AS INT)) OVER (PARTITION BY file_id, pid ORDER BY rec_no ROWS UNBOUNDED PRECEDING) AS unit FROM c),
g AS (SELECT file_id, pid, unit, min(rec_no) AS first_rec, bool_or(gap AND NOT pusi) AS broken, bool_or(gap AND pusi) AS at_start, bool_or(gap) AS lost, upper(string_agg(printf('%08x', rec_no), '' ORDER BY rec_no)) AS data FROM u GROUP BY ALL),
k AS (SELECT *, sum(CASE WHEN unit > 0 AND NOT broken THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, pid ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM g)"""
_CF = "cf AS (SELECT p_partkey % 20 AS disc_id, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'FEATURE_' WHEN 1 THEN 'Feature' ELSE 'menu' END || p_partkey || '.EVO' AS name, CAST(p_size AS BIGINT) AS size FROM part)"
_MD = """md AS (SELECT c_custkey % 30 AS disc_id, 'f' || c_custkey % 5 AS folder, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'ENG' WHEN 1 THEN 'fra' ELSE 'deu' END AS lang, 'bdmt_' || CASE c_custkey % 3 WHEN 0 THEN 'ENG' WHEN 1 THEN 'fra' ELSE 'deu' END || '_' || c_custkey || CASE WHEN c_custkey % 11 = 0 THEN '.txt' ELSE '.xml' END AS file,
 CASE c_custkey % 4 WHEN 0 THEN 'Blu-ray' WHEN 1 THEN '' ELSE 'Disc ' || c_name END AS title FROM customer)"""
_TREE = """r AS (SELECT 'r' || r_regionkey AS id, '/' || r_name AS path FROM region), n AS (SELECT 'n' || n_nationkey AS id, r.path || '/' || n_name AS path FROM nation JOIN r ON r.id = 'r' || n_regionkey),
f AS (SELECT 's' || s_suppkey AS id, n.path || '/' || s_name AS path FROM supplier JOIN n ON n.id = 'n' || s_nationkey), t AS (SELECT * FROM r UNION ALL SELECT * FROM n UNION ALL SELECT * FROM f)"""
ORACLE = {
    "w6_assemble_pes": _PK + """, m AS (SELECT *, row_number() OVER (PARTITION BY file_id, pid, done ORDER BY unit) AS i FROM k)
SELECT file_id, pid, first_rec, at_start OR EXISTS (SELECT 1 FROM k b WHERE b.file_id = k.file_id AND b.pid = k.pid AND b.unit < k.unit AND b.lost AND coalesce(b.done, 0) = coalesce(k.done, 0) AND (b.unit = 0 OR b.broken)) AS discontinuity, data FROM k WHERE unit > 0 AND NOT broken""",
    "a6_substream_channels": "SELECT user_id AS title_id, 126 + event_id % 12 AS sub_id, max(1 + event_id * 7 % 6) AS channels FROM events WHERE event_id % 12 BETWEEN 2 AND 9 GROUP BY ALL",
    "p11_feature_clips": "WITH " + _CF + "SELECT disc_id, p_partkey AS ord, lower(name) AS name FROM cf WHERE size > 10 AND p_partkey % 3 < 2",
    "j2_compose_xml_titles": "WITH " + _CF + """SELECT disc_id, p_partkey % 7 AS number, CASE WHEN p_partkey % 7 % 2 = 0 THEN 'TITLE_' || p_partkey % 7 ELSE 't' || p_partkey % 7 END AS playlist, CAST(sum(size) AS BIGINT) AS size_bytes, count(*) AS clips, arg_min(replace(name, '.EVO', ''), p_partkey) AS first,
 CAST(sum(least(size * 2000 * 45000, 4294967295) - greatest((size - 5) * 45000, 0)) AS BIGINT) AS ticks FROM cf WHERE size > 10 GROUP BY ALL""",
    "s15_read_xml_playlists": "WITH " + _CF + """SELECT disc_id, p_partkey % 7 AS number, 'n' || p_partkey % 7 AS name, CAST(600 AS DOUBLE) AS duration_secs, count(*) AS clips, arg_min(lower(name), p_partkey) AS file, CAST(2 AS DOUBLE) AS begin_secs, CAST(arg_min(size, p_partkey) * 60 AS DOUBLE) AS end_secs, '5.0' AS chapters FROM cf WHERE p_partkey % 7 <> 3 GROUP BY ALL""",
    "s16_read_disc_metadata": "WITH " + _MD + """SELECT disc_id || '/' || folder || '/' || k || '/bdmt_' || lang || '.xml' AS path, lower(lang) AS lang, CASE WHEN title <> '' THEN title END AS title, 'about ' || folder AS description, CAST(2 AS INT) AS disc_no, CAST(3 AS INT) AS discs FROM md WHERE file LIKE '%.xml'""",
    "w28_disc_title": "WITH " + _MD + """, b AS (SELECT * FROM md WHERE file LIKE '%.xml' QUALIFY row_number() OVER (PARTITION BY disc_id, folder ORDER BY lang = 'ENG' DESC, file) = 1) SELECT disc_id, arg_min(title, folder) AS title FROM b WHERE title NOT IN ('', 'Blu-ray') GROUP BY disc_id""",
    "j19_resolve_paths": "WITH " + _TREE + "SELECT id, path FROM t",
    "j19_find_path": "WITH " + _TREE + "SELECT upper(path) || '/' AS query, CASE WHEN id LIKE 's%' THEN id END AS id, CASE WHEN id LIKE 's%' THEN path END AS path FROM t",
    "s6_write_video_index": with_views("frames") + """, f AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY idx) - 1 AS n FROM frames WHERE track = 0)
SELECT title_id, n, '{"n":' || n || ',"src":' || CASE WHEN size % 7 <> 0 THEN '{"sector":' || src_byte // 2048 || ',"byte":' || src_byte % 2048 || '}' ELSE 'null' END || ',"pts":' || pts_ns || ',"type":"' || ctype || '","key":' || keyframe || ',"size":' || size || CASE WHEN size % 2 = 0 THEN ',"nb_fields":' || size % 3 ELSE '' END || '}' AS line FROM f""",
    "s6_video_index_headers": with_views("titles") + """ SELECT title_id, CAST(-1 AS INT) AS n, '{"format":"fvi","fvi_version":1,"generator":"reelspark","stream":{"codec":"hevc","width":1920,"height":1080,"dar":[16,9],"frame_rate":[24000,1001],"scan":"progressive","colour":{"primaries":1,"transfer":1,"matrix":1,"range":"'
 || CASE WHEN title_id % 2 = 0 THEN 'full' ELSE 'limited' END || '"}},"source":{"medium":"bd","path":"/d/' || disc_id || '","title":' || title_id % 9 || ',"sector_size":2048' || CASE WHEN title_id % 3 = 0 THEN '' ELSE ',"playlist":"' || playlist || '"' END || CASE WHEN title_id % 5 = 0 THEN ',"volume_id":"VOL"' ELSE '' END
 || '},"timescale":1000000000' || CASE WHEN title_id % 4 = 0 THEN ',"picture_count":' || title_id ELSE '' END || '}' AS line FROM titles""",
}


#: Streams of a title in order, each taking what no earlier one claimed.
ORACLE["j16_remap_audio"] = """WITH RECURSIVE p AS (SELECT user_id AS title_id, 126 + event_id % 12 AS sub, max(1 + event_id * 7 % 6) AS ch FROM events WHERE event_id % 12 BETWEEN 2 AND 9 GROUP BY ALL),
s AS (SELECT DISTINCT user_id AS title_id, k AS ord, 48512 + k AS pid, 1 + (user_id + k) % 6 AS ch FROM events, (VALUES (0), (1), (2)) t(k)),
r AS (SELECT DISTINCT title_id, CAST(-1 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS pid, CAST(0 AS BIGINT) AS new_pid, CAST([] AS BIGINT[]) AS claimed FROM s
UNION ALL SELECT title_id, ord, pid, new_pid, list_append(claimed, new_pid) FROM (SELECT s.title_id, CAST(s.ord AS BIGINT) AS ord, CAST(s.pid AS BIGINT) AS pid, r.claimed, CAST(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.title_id = s.title_id AND p.sub = s.pid % 256 AND p.ch = s.ch) THEN s.pid
 ELSE coalesce((SELECT min(48384 + p.sub) FROM p WHERE p.title_id = s.title_id AND p.ch = s.ch AND NOT list_contains(r.claimed, 48384 + p.sub)), s.pid) END AS BIGINT) AS new_pid FROM r JOIN s ON s.title_id = r.title_id AND s.ord = r.ord + 1))
SELECT title_id, ord, CAST(pid AS INT) AS pid, CAST(new_pid AS INT) AS new_pid FROM r WHERE ord >= 0"""


def _s11() -> str:
    from reelspark.functions import scalars as S
    from reelspark.jobs.catalog_queries import _CH, _ST

    case = lambda v, table, other: "CASE " + v + "".join(f" WHEN {k} THEN {x}" for k, x in table.items()) + f" ELSE {other} END"
    text = lambda table: {k: f"'{v}'" for k, v in table.items()}
    res = case("video_format", text(S.RESOLUTIONS), "'unknown'")
    wide, high = (case("res", {f"'{k}'": v[i] for k, v in S.PIXELS.items()}, d) for i, d in ((0, 1920), (1, 1080)))
    rate = [case("video_rate", {k: f"'{v[i]}'" if i == 0 else v[i] for k, v in S.FRAME_RATES.items()}, d) for i, d in ((0, "'unknown'"), (1, 0), (2, 1))]
    ch, cc, hz = case("audio_format", {k: f"'{v[0]}'" for k, v in S.CHANNELS.items()}, "'unknown'"), case("audio_format", {k: v[1] for k, v in S.CHANNELS.items()}, 6), case("pid % 16", S.SAMPLE_RATES, 48000)
    label = """CASE WHEN pid % 4 = 0 THEN ',"label":"Main \\"x\\""' ELSE '' END"""
    return with_views("titles", "stn_streams", "marks", "play_items", "clip_info") + _ST + _CH + f""", sm AS (SELECT *, {res} AS res FROM st), sj AS (SELECT title_id, ord, '{{"kind":"' || kind || '","codec":"' || codec || '","pid":' || pid || CASE kind
 WHEN 'video' THEN ',"resolution":"' || res || '","width":' || {wide} || ',"height":' || {high} || ',"interlaced":' || (res IN ('480i', '576i', '1080i')) || ',"frame_rate":"' || {rate[0]} || '","frame_rate_num":' || {rate[1]} || ',"frame_rate_den":' || {rate[2]} || ',"hdr":"' || CASE WHEN pid % 3 = 0 THEN 'hdr10' ELSE 'sdr' END
  || '","color_space":"bt709","secondary":' || secondary || ',"mvc_dependent":' || (pid % 5 = 0) || CASE WHEN pid % 4 = 1 THEN ',"display_aspect":"16:9"' ELSE '' END || CASE WHEN pid % 8 = 1 THEN ',"measured_cicp":{{"matrix":9,"transfer":16,"primaries":9,"range":0}}' ELSE '' END || {label}
 WHEN 'audio' THEN ',"language":"' || language || '","channels":"' || {ch} || '","channel_count":' || {cc} || ',"sample_rate":"48kHz","sample_rate_hz":' || {hz} || ',"secondary":' || secondary || ',"purpose":"' || CASE WHEN pid % 7 = 0 THEN 'commentary' ELSE 'normal' END || '"' || {label}
 ELSE ',"language":"' || language || '","forced":' || (pid % 2 = 0) || ',"qualifier":"' || CASE WHEN pid % 6 = 0 THEN 'sdh' ELSE 'none' END || '"' END || '}}' AS j FROM sm),
sl AS (SELECT title_id, string_agg(j, ',' ORDER BY ord) AS l FROM sj GROUP BY title_id), cj AS (SELECT title_id, item_no, '{{"clip_id":"' || p.clip_id || '","duration_secs":' || (out_time - in_time) // 45000 || ',"source_packets":' || coalesce(source_packets, 0) || '}}' AS j FROM play_items p LEFT JOIN clip_info i ON i.clip_id = p.clip_id),
cl AS (SELECT title_id, string_agg(j, ',' ORDER BY item_no, j) AS l FROM cj GROUP BY title_id),
hl AS (SELECT title_id, string_agg('{{"n":' || n || ',"start_secs":' || CAST(floor(time_secs) AS BIGINT) || ',"name":"' || n || '"}}', ',' ORDER BY n) AS l FROM ch GROUP BY title_id)
SELECT t.title_id, '{{"playlist":"' || playlist || '","playlist_id":' || CAST(substr(playlist, 1, 5) AS INT) || ',"duration_secs":' || CAST(floor(duration_secs) AS BIGINT) || ',"size_bytes":' || size_bytes || ',"format":"' || CASE WHEN t.title_id % 2 = 0 THEN 'BdTs' ELSE 'MpegPs' END
 || '","clips":[' || coalesce(cl.l, '') || '],"streams":[' || coalesce(sl.l, '') || '],"chapters":[' || coalesce(hl.l, '') || ']}}' AS document FROM titles t LEFT JOIN cl USING (title_id) LEFT JOIN sl USING (title_id) LEFT JOIN hl USING (title_id)"""


ORACLE["s11_title_json"] = _s11()
