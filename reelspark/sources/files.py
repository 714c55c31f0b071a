"""Readers and writers of range maps, video indexes, chapters, title documents and source packets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.sources.records import read_records, write_folders, write_keyed
from reelspark.sources.tables import few_listing_tasks
from reelspark.sources.wire import FRAME, HEAD, HEAD_SIZE, NO_DURATION, read_wire

HEX = r"^(0x)?[0-9a-fA-F]{1,16}$"
LARGEST = (1 << 63) - 1
STATES = ("?", "*", "/", "+", "-")


#: The part of a file that a reading task has, and a line's place in it.
SPLIT = ["file", "split"]


def _lines(spark: SparkSession, path: str, count: Column | None = None) -> DataFrame:
    """file, n, line of text files of any size, n from 0; with `count` (of a line, 0 or 1) also `counted`, its sum up to the line.

    Files are read by splits. A line's number is its place in its split and the lines of the file's splits before; so is the sum. Ids of a split's lines follow on, so a line's place is
    what its id is above the split's least; sums are made inside a split, which is of a task's size at most; of whole files only a row a split is sorted. Where neither number nor sum
    is asked for, lines are not shuffled: the join is an outer one on unique keys, which Spark leaves out then."""
    with few_listing_tasks(spark):
        text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"), F.when(F.endswith("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("line")
    )
    rows = rows.withColumn("_count", (F.lit(0) if count is None else count).cast("long"))
    sums = rows.groupBy(*SPLIT).agg(F.count("*").alias("_lines"), F.sum("_count").alias("_counts"), F.min("_id").alias("_least"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*SPLIT, "_least", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_lines", "_counts")])
    # one row a file and split as it is, said so that Spark knows
    sums = sums.groupBy(*SPLIT).agg(*[F.max(c).alias(c) for c in ("_least", "_lines", "_counts")])
    if count is not None:
        rows = rows.withColumn("_sum", F.sum("_count").over(W.partitionBy(*SPLIT).orderBy("_id").rowsBetween(W.unboundedPreceding, 0)))
    whole = rows.join(sums, SPLIT, "left")
    found = [F.col("file"), (F.col("_lines") + F.col("_id") - F.col("_least")).alias("n"), F.col("line")]
    return whole.select(*found, *([] if count is None else [(F.col("_counts") + F.col("_sum")).alias("counted")]))


def range_map_lines(spark: SparkSession, path: str) -> DataFrame:
    """File, n, line, pos, size, status and error of the lines of text maps that are ranges or wrong; of the latter pos, size and status are null.

    Comment lines are dropped unread, a line whose second field is a single state is the current-position line, lines of fewer than three fields are skipped. Wrong
    hex, an unknown state, a size of 0 and an end beyond 2**63 - 1 are errors.

    Lines are chosen by an array of one, or null, that is unfolded, not by a filter: Spark moves filters below what they read, and would split and convert a line again for each condition."""
    rows = _lines(spark, path).withColumn("f", F.split(F.trim("line"), r"\s+"))
    field = lambda k: F.get("f", F.lit(k))
    kept = ~F.ltrim("line").startswith("#") & (F.size("f") >= 3) & ~field(1).isin(*STATES)
    rows = rows.select("file", "n", "line", kept.alias("kept"), *[field(k).alias(f"f{k}") for k in range(3)])
    rows = rows.withColumn("good", F.col("kept") & F.col("f0").rlike(HEX) & F.col("f1").rlike(HEX))
    # a number beyond 2**63 - 1 is null
    number = lambda c: F.when(F.col("good"), F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).try_cast("long"))
    rows = rows.withColumn("a", number("f0")).withColumn("b", number("f1"))
    beyond = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") > LARGEST - F.col("b"))
    error = F.when(~F.col("good"), "number").when(~F.col("f2").isin(*STATES), "status").when(F.col("b") == 0, "size").when(beyond, "overflow")
    rows = rows.withColumn("wrong", error)
    right = lambda c, name: F.when(F.col("wrong").isNull(), F.col(c)).alias(name)
    one = F.struct(right("a", "pos"), right("b", "size"), right("f2", "status"), F.col("wrong").alias("error"))
    return rows.select("file", "n", "line", F.inline(F.when(F.col("kept"), F.array(one))))


def read_range_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ranges (file, n, pos, size, status) and errors (file, n, line, error) of text maps, see range_map_lines."""
    rows = range_map_lines(spark, path)
    return rows.filter("error IS NULL").select("file", "n", "pos", "size", "status"), rows.filter("error IS NOT NULL").select("file", "n", "line", "error")


def write_range_map(ranges: DataFrame, path: str, key: str = "disc_id") -> None:
    """S3: one file per disc with its map as text, `<key>=<disc>/map.txt`: headers, then `pos size status` by position. Lines stream to their file."""
    line = F.format_string("0x%09x  0x%09x    %s\n", "pos", "size", "status")
    write_keyed(ranges.select(key, "pos", line.alias("line")), path, key, ["pos"], "line", "map.txt", "# Rescue map\n# pos  size  status\n")


PICTURE = "n long, pts long, dts long, type string, key boolean, size long, recovered boolean, src struct<sector:long,byte:long>"


def read_video_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers and pictures of JSON Lines indexes; a header line starts a new section of its file; unknown members are ignored; blank lines are skipped."""
    header = (F.trim("line") != "") & F.get_json_object("line", "$.n").isNull()
    rows = _lines(spark, path, header).withColumnRenamed("counted", "section").filter("trim(line) <> ''")
    is_header = F.get_json_object("line", "$.n").isNull()
    pictures = rows.filter(~is_header).select("file", "section", F.col("n").alias("line_no"), F.from_json("line", PICTURE).alias("p"))
    return rows.filter(is_header).select("file", "section", F.col("line").alias("header")), pictures.select("file", "section", "line_no", "p.*")


def picture_record(frames: DataFrame) -> Column:
    """The JSON record of a picture but for its number: src is null where it is not known; members that were not measured (dts_ns, field_order, progressive,
    nb_fields; columns that frames may have) are left out."""
    held = set(frames.columns)
    optional = lambda c, name: [F.col(c).alias(name)] if c in held else []
    src = F.when(F.col("src_byte").isNotNull(), F.format_string('{"sector":%d,"byte":%d}', F.floor(F.col("src_byte") / 2048), F.col("src_byte") % 2048)).otherwise("null")
    rest = F.to_json(F.struct(F.col("pts_ns").alias("pts"), *optional("dts_ns", "dts"), F.col("ctype").alias("type"), F.col("keyframe").alias("key"), "size", *optional("field_order", "field_order"), *optional("progressive", "progressive"), *optional("nb_fields", "nb_fields")), {"ignoreNullFields": "true"})
    return F.concat(F.lit('"src":'), src, F.lit(","), F.substring(rest, 2, 1 << 30))


def video_index_lines(frames: DataFrame, primary: Column) -> DataFrame:
    """title_id, n, line: a JSON record for each frame of the primary video, numbered from 0 in coded order."""
    n = F.row_number().over(W.partitionBy("title_id").orderBy("idx")) - 1
    f = frames.filter(primary).withColumn("n", n)
    return f.select("title_id", "n", F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit(","), picture_record(frames)).alias("line"))


def video_index_headers(titles: DataFrame) -> DataFrame:
    """title_id, n (-1, before all pictures) and line: the header of each title: codec, width, height, dar and frame_rate (struct of num, den), scan, colour (struct
    of primaries, transfer, matrix, range), medium, path, title; playlist, volume_id and picture_count, left out where null or empty."""
    pair = lambda c: F.array(F.col(f"{c}.num"), F.col(f"{c}.den")).alias(c)
    told = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    stream = F.struct("codec", "width", "height", pair("dar"), pair("frame_rate"), "scan", "colour")
    source = F.struct("medium", "path", "title", F.lit(2048).alias("sector_size"), told("playlist"), told("volume_id"))
    doc = F.struct(F.lit("fvi").alias("format"), F.lit(1).alias("fvi_version"), F.lit("reelspark").alias("generator"), stream.alias("stream"), source.alias("source"), F.lit(1_000_000_000).alias("timescale"), "picture_count")
    return titles.select("title_id", F.lit(-1).alias("n"), F.to_json(doc, {"ignoreNullFields": "true"}).alias("line"))


def write_video_index(lines: DataFrame, path: str) -> None:
    """One file per title, `title_id=<title>/index.jsonl`, its records in coded order, each line streamed to its file."""
    write_keyed(lines.withColumn("line", F.concat("line", F.lit("\n"))), path, "title_id", ["n"], "line", "index.jsonl")


def validate_video_index(pictures: DataFrame) -> DataFrame:
    """File, section, line_no, error for records whose n does not follow on from 0, that lack a member, or whose dts falls."""
    w = W.partitionBy("file", "section").orderBy("line_no")
    missing = F.col("n").isNull() | F.col("pts").isNull() | F.col("type").isNull()
    error = F.when(missing, "member").when(F.col("n") != F.row_number().over(w) - 1, "n").when(F.col("dts") < F.lag("dts").over(w), "dts")
    return pictures.withColumn("error", error).filter("error IS NOT NULL").select("file", "section", "line_no", "error")


def export_chapters(chapters: DataFrame, fmt: str) -> DataFrame:
    """title_id and text of its chapters, as `xml`, `ogm` or `vtt`; in VTT a chapter ends where the next begins, the last at its
    own start. In XML and OGM a chapter without a name has its number; times below 0 count as 0."""
    from reelspark.functions.scalars import chapter_time

    w = W.partitionBy("title_id").orderBy("n")
    at = chapter_time(F.greatest(F.col("time_secs"), F.lit(0.0)), 9 if fmt == "xml" else 3)
    c = chapters.withColumn("at", at).withColumn("end", F.coalesce(F.lead("at").over(w), F.col("at"))).withColumn("place", F.row_number().over(w))
    given = F.coalesce("name", F.lit(""))
    name = F.when(given == "", F.col("place").cast("string")).otherwise(given)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        name = F.replace(name, F.lit(mark), F.lit(entity)) if fmt == "xml" else name
    lines = {
        "xml": ("    <ChapterAtom>\n      <ChapterTimeStart>", "at", "</ChapterTimeStart>\n      <ChapterDisplay>\n        <ChapterString>", name, "</ChapterString>\n        <ChapterLanguage>und</ChapterLanguage>\n      </ChapterDisplay>\n    </ChapterAtom>\n"),
        "ogm": (F.format_string("CHAPTER%02d=", "place"), "at", F.format_string("\nCHAPTER%02dNAME=", "place"), name, "\n"),
        "vtt": (F.col("place").cast("string"), "\n", "at", " --> ", "end", "\nChapter ", given, "\n\n"),
    }[fmt]
    head, tail = {
        "xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE Chapters SYSTEM "matroskachapters.dtd">\n<Chapters>\n  <EditionEntry>\n', "  </EditionEntry>\n</Chapters>\n"),
        "ogm": ("", ""), "vtt": ("WEBVTT\n\n", ""),
    }[fmt]
    part = F.concat(*[(F.col(x) if x in ("at", "end") else F.lit(x)) if isinstance(x, str) else x for x in lines])
    g = c.withColumn("part", part).groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("l"))
    return g.select("title_id", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["part"]), ""), F.lit(tail)).alias("text"))


#: Members of a stream in a title's document, by kind, in order; those of the last are left out where they are empty or not known.
MODEL = {
    "video": ("resolution", "width", "height", "interlaced", "frame_rate", "frame_rate_num", "frame_rate_den", "hdr", "color_space", "secondary", "mvc_dependent"),
    "audio": ("language", "channels", "channel_count", "sample_rate", "sample_rate_hz", "secondary", "purpose"),
    "subtitle": ("language", "forced", "qualifier"),
}
EXTRA = {"video": ("display_aspect", "measured_cicp", "label"), "audio": ("label",), "subtitle": ()}


def stream_json(streams: DataFrame) -> Column:
    """One stream's whole model as JSON: kind, codec, pid and the members of its kind. Columns that streams lack count as unknown: null, but display_aspect (struct of
    num, den), measured_cicp (struct of matrix, transfer, primaries, range) and label, which are left out."""
    held = {c.lower() for c in streams.columns}

    def member(name: str) -> Column:
        if name not in held:
            return F.lit(None).cast("string").alias(name)
        if name == "display_aspect":
            return F.when(F.col(name).isNotNull(), F.format_string("%d:%d", F.col(f"{name}.num"), F.col(f"{name}.den"))).alias(name)
        return F.when(F.col(name) != "", F.col(name)).alias(name) if name == "label" else F.col(name).alias(name)

    def of(kind: str) -> Column:
        own = F.to_json(F.struct("kind", "codec", "pid", *map(member, MODEL[kind])), {"ignoreNullFields": "false"})
        more = [F.to_json(F.struct(member(m)), {"ignoreNullFields": "true"}) for m in EXTRA[kind]]
        # objects of the members that are known, joined into one
        tails = [F.when(F.length(m) > 2, F.concat(F.lit(","), F.substring(m, 2, 1 << 30), F.lit(""))).otherwise("}") for m in more]
        out = F.substring(own, F.lit(1), F.length(own) - 1)
        for t in tails:
            out = F.concat(out, F.substring(t, F.lit(1), F.length(t) - 1))
        return F.concat(out, F.lit("}"))

    return F.coalesce(*[F.when(F.col("kind") == k, of(k)) for k in MODEL])


def title_json(titles: DataFrame, clips: DataFrame, streams: DataFrame, chapters: DataFrame) -> DataFrame:
    """title_id and the whole document of each title (title_id, playlist, playlist_id, duration_secs, size_bytes, content_format): identity, duration and size, its clips (ord, clip_id,
    duration_secs, source_packets), the models of its streams (ord and what stream_json reads), its chapters (n, time_secs, name), each in order; empty lists where it has none."""
    listed = lambda df, order, json, name: df.select("title_id", F.col(order).alias("_o"), json.alias("_j")).groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct("_o", "_j"))).alias("l")).select("title_id", F.array_join(F.transform("l", lambda x: x["_j"]), ",").alias(name))
    plain = lambda *members: F.to_json(F.struct(*members), {"ignoreNullFields": "false"})
    c = listed(clips, "ord", plain("clip_id", "duration_secs", "source_packets"), "_clips")
    s = listed(streams, "ord", stream_json(streams), "_streams")
    h = listed(chapters, "n", plain("n", F.col("time_secs").alias("start_secs"), "name"), "_chapters")
    t = titles.join(c, "title_id", "left").join(s, "title_id", "left").join(h, "title_id", "left")
    head = plain("playlist", "playlist_id", "duration_secs", "size_bytes", F.col("content_format").alias("format"))
    lists = [F.concat(F.lit(f',"{name}":['), F.coalesce(f"_{name}", F.lit("")), F.lit("]")) for name in ("clips", "streams", "chapters")]
    return t.select("title_id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), *lists, F.lit("}")).alias("document"))


def read_source_packets(spark: SparkSession, path: str, length: int = 192, range_bytes: int = 64 << 20) -> DataFrame:
    """File, rec_no, bytes and error of the fixed-length records of a file, or of every file of a folder, of any size: see records.FixedRecords. A part of a
    record at a file's end is a row with the error `part`."""
    return read_records(spark, path, length, range_bytes)


MOST = 256 << 20


def _little(value: Column, size: int) -> Column:
    """The lowest `size` bytes of a whole number, the least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def frame_wire(frames: DataFrame, most: int = MOST) -> DataFrame:
    """title_id, idx, wire and error of frames (title_id, idx, track, pts, keyframe, duration_ns, data): track, time, key flag, duration (all
    ones: none), length and data, little-endian. A track above 255 or data of over `most` bytes is an error without a wire."""
    error = F.when(F.col("track") > 255, "track").when(F.length("data") > most, "too long")
    duration = F.when(F.col("duration_ns").isNull(), F.unhex(F.lit("F" * 16))).otherwise(_little(F.col("duration_ns"), 8))
    wire = F.concat(_little(F.col("track"), 1), _little(F.col("pts"), 8), _little(F.col("keyframe").cast("int"), 1), duration, _little(F.length("data"), 4), F.col("data"))
    return frames.select("title_id", "idx", F.when(error.isNull(), wire).alias("wire"), error.alias("error"))


def parse_frame_wire(files: DataFrame, most: int = MOST) -> DataFrame:
    """S8 on a table of path and content. A file that ends inside a record, or a record over `most` bytes, ends with an error row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows, at, error = [], 0, None
                while at < len(content) and error is None:
                    if at + HEAD_SIZE > len(content):
                        error = "truncated header"
                        break
                    track, pts, key, duration, size = struct.unpack_from(HEAD, content, at)
                    at += HEAD_SIZE
                    if size > most:
                        error = "too long"
                    elif at + size > len(content):
                        error = "truncated data"
                    else:
                        rows.append((file, len(rows), track, pts, bool(key), None if duration == NO_DURATION else duration, content[at : at + size], None))
                        at += size
                if error:
                    rows.append((file, len(rows), None, None, None, None, None, error))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in FRAME.split(", ")], dtype=object)
                yield out

    return files.select("path", "content").mapInPandas(parse, FRAME)


def read_frame_wire(spark: SparkSession, path: str, most: int = MOST, range_bytes: int = 64 << 20) -> DataFrame:
    """Frames of a wire file or of a folder's, of any size; rows as parse_frame_wire's. Ranges of a file are read by different tasks, see wire.read_wire."""
    return read_wire(spark, path, most, range_bytes)


MEDIA_STREAM = "type string, pid int, codec string, resolution string, frame_rate string, hdr string, color_space string, channels string, language string, sample_rate string, label string, secondary boolean, forced boolean, codec_private string"
MEDIA_HEADER = "v int, title string, duration double, streams array<struct<" + ", ".join(f.replace(" ", ":", 1) for f in MEDIA_STREAM.split(", ")) + ">>"


def parse_media_header(files: DataFrame, most: int = 10 << 20) -> DataFrame:
    """S10 on a table of path and content: path, header and error. A file of another kind has neither; a cut mark, a newer version, JSON of
    over `most` bytes or cut, and what is no such JSON are errors. Members that are left out have their defaults."""
    whole = lambda start, size: F.conv(F.hex(F.substring(F.col("content"), start, size)), 16, 10).cast("long")
    size = F.length("content")
    f = files.select("path", "content", (F.substring("content", 1, 4) == F.lit(b"FMKV")).alias("ours"), whole(6, 1).alias("version"), whole(9, 4).alias("n"))
    error = F.when(size < 8, "truncated").when(F.col("ours"), F.when(F.col("version") > 1, "version").when(size < 12, "truncated").when(F.col("n") > most, "too long").when(size < 12 + F.col("n"), "truncated"))
    f = f.withColumn("error", error).withColumn("json", F.when(F.col("ours") & F.col("error").isNull(), F.substring("content", F.lit(13), F.col("n").cast("int")).cast("string")))
    f = f.withColumn("h", F.from_json("json", MEDIA_HEADER))
    empty = lambda s, c: F.coalesce(s[c], F.lit("")).alias(c)
    text = ("resolution", "frame_rate", "hdr", "color_space", "channels", "language", "sample_rate", "label")
    streams = F.transform("h.streams", lambda s: F.struct(s["type"].alias("type"), s["pid"].alias("pid"), s["codec"].alias("codec"), *[empty(s, c) for c in text], *[F.coalesce(s[c], F.lit(False)).alias(c) for c in ("secondary", "forced")], s["codec_private"].alias("codec_private")))
    header = F.struct(F.col("h.v").alias("v"), F.coalesce("h.title", F.lit("")).alias("title"), F.coalesce("h.duration", F.lit(0.0)).alias("duration"), streams.alias("streams"))
    wrong = F.col("json").isNotNull() & (F.col("h.v").isNull() | F.col("h.streams").isNull())
    return f.select("path", F.when(F.col("json").isNotNull() & ~wrong, header).alias("header"), F.when(wrong, "json").otherwise(F.col("error")).alias("error"))


def read_media_header(spark: SparkSession, path: str, most: int = 10 << 20) -> DataFrame:
    return parse_media_header(spark.read.format("binaryFile").load(path), most)


#: A code point that no XML document can hold.
NO_TEXT = "\uffff"


def disc_metadata(files: DataFrame) -> DataFrame:
    """S16 on a table of path and content (text) of metadata files `bdmt_<lang>.xml`: path, lang, title, description, disc_no, discs. The title is that of
    name, else title, else the table of contents; a description that looks like markup is dropped."""
    lang = F.regexp_extract(F.lower("path"), r"bdmt_([a-z]{3})\.xml$", 1)
    local = lambda *names: "//" + "/".join(f"*[local-name()='{n}']" for n in names) + "/text()"
    paths = [local("description"), local("title", "name"), local("name"), local("title"), local("tableOfContents", "titleName"), local("setNumber"), local("numSets")]
    # one path that joins the first node of each, so that a document is parsed once
    whole = F.xpath_string("content", F.lit(f"concat({f", '{NO_TEXT}', ".join(paths)})"))
    files = files.filter(lang != "").withColumn("_nodes", F.split(whole, NO_TEXT))
    node = lambda k: F.trim(F.get("_nodes", F.lit(k)))
    first = lambda *places: F.coalesce(*[F.when(node(k) != "", node(k)) for k in places])
    about = first(0)
    title = first(1, 2, 3, 4)
    return files.select("path", lang.alias("lang"), title.alias("title"), F.when(~about.startswith("<"), about).alias("description"), first(5).try_cast("int").alias("disc_no"), first(6).try_cast("int").alias("discs"))


def write_tracks(frames: DataFrame, path: str, kind: str | None = None, selection: list[int] | None = None) -> None:
    """One folder for each title and track, its frames in order; of one kind or of selected tracks only. Tasks put their files in place themselves, as one process
    that moves the folders of all titles would take longer than the tasks; the folder is whole once it has its `_SUCCESS`."""
    f = frames.filter(F.col("kind") == kind) if kind else frames
    f = f.filter(F.col("track").isin(selection)) if selection is not None else f
    write_folders(f, path, ["title_id", "track"], ["idx"])


def count_sink(frames: DataFrame) -> tuple[int, int]:
    """Frames and bytes that pass a sink which keeps nothing."""
    from pyspark.sql import Observation

    seen = Observation("count_sink")
    frames.observe(seen, F.count("*").alias("frames"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).write.format("noop").mode("overwrite").save()
    return seen.get["frames"], seen.get["bytes"]
