"""Audio of DVD titles, XML playlists, disc titles and directory paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import scalars as S
from reelspark.sources.tables import written

CLOCK, MOST_TIME = 45_000, (1 << 32) - 1


def substream_channels(frames: DataFrame) -> DataFrame:
    """Most channels of each AC-3 sub-stream, 0x80 to 0x87, over all its frames (title_id, sub_id, channels)."""
    return frames.filter(F.col("sub_id").between(0x80, 0x87) & F.col("channels").isNotNull()).groupBy("title_id", "sub_id").agg(F.max("channels").alias("channels"))


def remap_audio(streams: DataFrame, probed: DataFrame) -> DataFrame:
    """AC-3 streams (title_id, ord, pid, channels) with new_pid: kept where their sub-stream (the pid's low byte) was probed with the channels that they
    declare, else the lowest probed sub-stream with these that no earlier stream claimed, else kept; each claims what it gets. Without a probe all stay.

    A title's few streams (eight sub-streams at most are probed) are folded in one row."""
    s = streams.groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct("ord", "pid", "channels"))).alias("s"))
    p = probed.groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct(F.col("sub_id").cast("int").alias("sub"), F.col("channels").cast("int").alias("ch")))).alias("p"))
    none = F.array().cast("array<struct<ord:bigint,pid:int,new_pid:int>>")
    t = s.join(p, "title_id", "left")

    def step(acc: Column, x: Column) -> Column:
        own, ch = x["pid"].cast("int").bitwiseAND(F.lit(0xFF)), x["channels"].cast("int")
        fits = F.exists("p", lambda q: (q["sub"] == own) & (q["ch"] == ch))
        free = F.get(F.filter("p", lambda q: (q["ch"] == ch) & ~F.array_contains(acc["claimed"], q["sub"])), F.lit(0))["sub"]
        sub = F.when(fits, own).otherwise(F.coalesce(free, own))
        new = F.when(fits | free.isNull(), x["pid"].cast("int")).otherwise(F.lit(0xBD00) + free)
        row = F.struct(x["ord"].cast("long").alias("ord"), x["pid"].cast("int").alias("pid"), new.alias("new_pid"))
        return F.struct(F.array_append(acc["claimed"], sub).alias("claimed"), F.array_append(acc["out"], row).alias("out"))

    same = F.transform("s", lambda x: F.struct(x["ord"].cast("long").alias("ord"), x["pid"].cast("int").alias("pid"), x["pid"].cast("int").alias("new_pid")))
    folded = F.aggregate("s", F.struct(F.array().cast("array<int>").alias("claimed"), none.alias("out")), step, lambda acc: acc["out"])
    return t.select("title_id", F.explode(F.when(F.col("p").isNull(), same).otherwise(folded)).alias("r")).select("title_id", "r.*")


def is_feature_clip(name: Column) -> Column:
    """Whether a clip's file is one of the feature's."""
    return F.lower(F.regexp_extract(name, r"([^/]*)$", 1)).startswith("feature")


def feature_clips(order: DataFrame, files: DataFrame) -> DataFrame:
    """Feature clips (disc_id, ord, name) in their authored order that are files with extents, whatever the case of their letters."""
    known = files.select("disc_id", F.lower("name").alias("_low")).distinct()
    return order.filter(is_feature_clip(F.col("name"))).withColumn("_low", F.lower("name")).join(known, ["disc_id", "_low"], "left_semi").drop("_low")


#: What is read of an XML playlist; attributes begin with `_`, names are without their prefixes.
XML_PLAYLIST = (
    "TitleSet struct<_tickBase:string,Title:array<struct<_titleNumber:string,_displayName:string,_id:string,_titleDuration:string,"
    "PrimaryAudioVideoClip:array<struct<_src:string,_titleTimeBegin:string,_titleTimeEnd:string>>,ChapterList:struct<Chapter:array<struct<_titleTimeBegin:string>>>>>>"
)


def read_xml_titles(files: DataFrame) -> DataFrame:
    """S15 on a table of path and content (text): path, title_no, number, name, duration_secs, clips (file, begin_secs, end_secs) and chapters
    (seconds) of XML playlists, elements told by their local names. The tick base is 60 where none is given; a clip without an end ends where it begins; titles without a
    clip go, and so does what is no XML."""
    doc = F.from_xml("content", XML_PLAYLIST, {"ignoreNamespace": "true", "attributePrefix": "_", "mode": "PERMISSIVE"})
    f = files.select("path", doc["TitleSet"].alias("s"))
    base = F.coalesce(F.regexp_extract("s._tickBase", r"^([0-9]+)", 1).try_cast("int"), F.lit(60))
    f = f.select("path", F.greatest(base, F.lit(1)).alias("base"), F.posexplode("s.Title").alias("title_no", "t"))
    seconds = lambda x: S.parse_timecode(x, F.col("base"))

    def clip(c: Column) -> Column:
        begin = F.coalesce(seconds(c["_titleTimeBegin"]), F.lit(0.0))
        file = F.lower(F.regexp_extract(F.regexp_replace(c["_src"], r"\.[mM][aA][pP]$", ".EVO"), r"([^/]+)$", 1))
        return F.struct(file.alias("file"), begin.alias("begin_secs"), F.coalesce(seconds(c["_titleTimeEnd"]), begin).alias("end_secs"))

    clips = F.transform(F.filter("t.PrimaryAudioVideoClip", lambda c: c["_src"].isNotNull()), clip)
    chapters = F.filter(F.transform("t.ChapterList.Chapter", lambda c: seconds(c["_titleTimeBegin"])), lambda x: x.isNotNull())
    out = f.select(
        "path", "title_no", F.coalesce(F.trim("t._titleNumber").try_cast("int"), F.lit(0)).alias("number"), F.coalesce("t._displayName", "t._id", F.lit("")).alias("name"),
        F.coalesce(seconds(F.col("t._titleDuration")), F.lit(0.0)).alias("duration_secs"), clips.alias("clips"), F.coalesce(chapters, F.array().cast("array<double>")).alias("chapters"),
    )
    return out.filter(F.size("clips") > 0)


def compose_xml_titles(titles: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    """Titles (disc_id, number, name, duration_secs) with the play items (disc_id, number, ord, file, begin_secs, end_secs) whose file (disc_id, name, size) has extents, matched
    without regard to case: clips of name without extension, times in 45 kHz cut to 32 bits; titles without any go."""
    known = files.select("disc_id", F.lower("name").alias("file"), F.col("name").alias("_name"), "size")
    ticks = lambda c: F.least(F.greatest(F.col(c) * CLOCK, F.lit(0.0)), F.lit(float(MOST_TIME))).cast("long")
    j = clips.withColumn("file", F.lower("file")).join(known, ["disc_id", "file"])
    clip = F.struct("ord", F.regexp_replace("_name", r"\.[^.]*$", "").alias("clip_id"), ticks("begin_secs").alias("in_time"), ticks("end_secs").alias("out_time"))
    g = j.groupBy("disc_id", "number").agg(F.array_sort(F.collect_list(clip)).alias("clips"), F.sum("size").alias("size_bytes"))
    name = F.when(F.col("name") == "", F.concat(F.lit("TITLE_"), F.col("number").cast("string"))).otherwise(F.col("name"))
    return titles.join(g, ["disc_id", "number"]).select("disc_id", "number", name.alias("playlist"), "duration_secs", "size_bytes", "clips")


def normalise_disc_title(metadata: DataFrame) -> DataFrame:
    """Title of each disc from its metadata files (disc_id, folder, file, title): of each folder the first English file, else the first; the first folder whose
    title is neither empty nor the literal Blu-ray."""
    english = F.lower("file").contains("eng")
    w = W.partitionBy("disc_id", "folder").orderBy(english.desc(), "file")
    best = metadata.filter(F.lower("file").endswith(".xml")).withColumn("_p", F.row_number().over(w)).filter("_p = 1").withColumn("title", F.trim("title"))
    return best.filter((F.col("title") != "") & (F.col("title") != "Blu-ray")).groupBy("disc_id").agg(F.min_by("title", "folder").alias("title"))


def _doubled(rows: DataFrame, carry: Callable[[Column, Column], Column] | None, rounds: int | None = None) -> DataFrame:
    """Rows (disc_id, id, up, path) with `up` taken to their uppermost ancestor's null, two steps then four and so on: a join and a written table a round, so a tree's depth
    is met in its logarithm of rounds. Stops after `rounds`, or once no row has an ancestor left."""
    done = 0
    while (rounds is None or done < rounds) and not rows.filter("up IS NOT NULL").isEmpty():
        above = rows.select("disc_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        path = carry(F.col("_path"), F.col("path")) if carry else F.col("path")
        waiting = rows.filter("up IS NOT NULL").join(above, ["disc_id", "up"]).select("disc_id", "id", F.col("_up").alias("up"), path.alias("path"))
        rows = written(rows.filter("up IS NULL").unionByName(waiting), "paths")
        done += 1
    return rows


def resolve_paths(entries: DataFrame, lost: bool = False) -> DataFrame:
    """disc_id, id, is_dir and path of directory entries (disc_id, id, parent_id, name, is_dir), those of the root without a parent, at any depth. With `lost` instead
    disc_id, id and why of the entries that hang on no root: orphan (an ancestor is missing or no directory), cycle.

    Ancestors are followed by pointer doubling. Without their paths first, so that cycles, which outlast the logarithm of the number of entries, are told and do not grow."""
    dirs = entries.filter("is_dir").select("disc_id", F.col("id").alias("up"))
    e = entries.select("disc_id", "id", F.col("parent_id").alias("up"), F.lit("").alias("path"))
    held = e.filter("up IS NULL").unionByName(e.join(dirs, ["disc_id", "up"]).select(*e.columns))
    most = held.groupBy("disc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    ends = _doubled(held, None, most.bit_length() + 1)
    if lost:
        on = ["disc_id", "id"]
        left = entries.select(*on).join(ends.filter("up IS NULL").select(*on), on, "left_anti")
        return left.join(ends.filter("up IS NOT NULL").select(*on, F.lit("cycle").alias("why")), on, "left").select(*on, F.coalesce("why", F.lit("orphan")).alias("why"))
    rooted = entries.join(ends.filter("up IS NULL").select("disc_id", "id"), ["disc_id", "id"])
    paths = _doubled(rooted.select("disc_id", "id", F.col("parent_id").alias("up"), F.concat(F.lit("/"), "name").alias("path")), lambda above, own: F.concat(above, own))
    return paths.join(entries.select("disc_id", "id", "is_dir"), ["disc_id", "id"]).select("disc_id", "id", "is_dir", "path")


def find_path(paths: DataFrame, queries: DataFrame) -> DataFrame:
    """The file of each queried path (disc_id, query), whatever the case of its letters and the slashes around it."""
    low = lambda c: F.lower(F.trim(c, F.lit("/")))
    files = paths.filter("NOT is_dir").withColumn("_low", low(F.col("path")))
    return queries.withColumn("_low", low(F.col("query"))).join(files, ["disc_id", "_low"], "left").drop("_low", "is_dir")


def with_frame_parser(units: DataFrame, parse: Callable, schema: str) -> DataFrame:
    """Frames that a parser of the user makes of PES units; it maps Arrow batches to Arrow batches."""
    return units.mapInArrow(parse, schema)
