"""The disc catalogue: titles built from playlists, clips, streams and chapters; ranking, audits and label resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import scalars as S
from reelspark.operators.ranges import SECTOR

CLOCK = 45_000


def build_titles(play_items: DataFrame, clip_info: DataFrame, clip_extents: DataFrame) -> DataFrame:
    """Of each title the play time of all items, and bytes and extents of each distinct clip that has clip info, once.

    Items are summed up by title and clip before anything is joined, and what is known of clips is one row a clip, so items meet it once; a clip with several infos counts
    its items once for each, as a join would."""
    items = play_items.groupBy("title_id", "clip_id").agg(F.sum(F.col("out_time") - F.col("in_time")).alias("_time"), F.count("*").alias("_items"))
    infos = clip_info.groupBy("clip_id").agg(F.count("*").alias("_infos"), (F.count("source_packets") > 0).alias("_known"))
    per_clip = clip_extents.groupBy("clip_id").agg(F.sum("sector_count").alias("_sectors"), F.count("*").alias("_extents"))
    items = items.join(infos.join(per_clip, "clip_id", "left"), "clip_id", "left")
    times = lambda c: F.sum(F.col(c) * F.coalesce("_infos", F.lit(1)))
    once = lambda c: F.coalesce(F.sum(F.when(F.col("_known"), c)), F.lit(0))
    return items.groupBy("title_id").agg((times("_time") / CLOCK).alias("duration_secs"), times("_items").alias("clips"), once(F.col("_sectors") * SECTOR).alias("size_bytes"), once(F.col("_extents")).alias("extents"))


def min_duration(play_items: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Titles that play for the seconds or more."""
    return play_items.groupBy("title_id").agg((F.sum(F.col("out_time") - F.col("in_time")) / CLOCK).alias("duration_secs")).filter(F.col("duration_secs") >= seconds)


def valid_extents(extents: DataFrame) -> DataFrame:
    """Extents that have a place and sectors."""
    return extents.filter((F.col("start_lba") != 0) & (F.col("sector_count") != 0))


def stream_rows(stn: DataFrame) -> DataFrame:
    """P5: catalogue streams of a stream table: kind by stream type, a subtitle codec in an audio slot counts as subtitle."""
    t = F.col("stream_type")
    codec = S.codec(F.col("coding_type"))
    kind = F.when(t.isin(1, 6, 7), "video").when(t.isin(2, 5), F.when(codec == "PGS", "subtitle").otherwise("audio")).when(t == 3, "subtitle")
    return stn.filter("coding_type <> 0").select("title_id", "ord", "pid", kind.alias("kind"), codec.alias("codec"), (t.isin(5, 7)).alias("secondary"), "language", "video_format", "video_rate", "audio_format").filter("kind IS NOT NULL")


def feature_cells(cells: DataFrame) -> DataFrame:
    """Cells but for the leading run of secondary angle-block cells; all where all are secondary."""
    first = F.coalesce(F.min(F.when(~S.is_secondary_cell(F.col("block_mode")), F.col("ord"))).over(W.partitionBy("title_id")), F.lit(0))
    return cells.withColumn("_first", first).filter(F.col("ord") >= F.col("_first")).drop("_first")


def cell_extents(cells: DataFrame) -> DataFrame:
    """Extents of the feature cells, with the title's bytes."""
    count = F.greatest(F.col("last_sector") - F.col("first_sector") + 1, F.lit(0))
    return feature_cells(cells).select("title_id", "ord", F.col("first_sector").alias("start_lba"), count.alias("sector_count"), (F.sum(count).over(W.partitionBy("title_id")) * SECTOR).alias("size_bytes"))


def shift_chapters(chapters: DataFrame, cells: DataFrame) -> DataFrame:
    """Chapter times less the time of the leading cells that were dropped, never negative."""
    kept = feature_cells(cells).select("title_id", "ord")
    gone = cells.join(kept, ["title_id", "ord"], "left_anti").groupBy("title_id").agg(F.sum("duration_secs").alias("_gone"))
    return chapters.join(gone, "title_id", "left").withColumn("time_secs", F.greatest(F.col("time_secs") - F.coalesce("_gone", F.lit(0)), F.lit(0.0))).drop("_gone")


def chapters_from_marks(marks: DataFrame, play_items: DataFrame) -> DataFrame:
    """Chapters of entry marks (type 1): play time of earlier items, none below 0, and the offset in their own; the sum is never negative."""
    before = W.partitionBy("title_id").orderBy("item_no").rowsBetween(W.unboundedPreceding, -1)
    plays = F.greatest(F.col("out_time") - F.col("in_time"), F.lit(0))
    items = play_items.withColumn("_before", F.coalesce(F.sum(plays).over(before), F.lit(0))).select("title_id", F.col("item_no").alias("play_item_ref"), "_before", "in_time")
    at = marks.filter("mark_type = 1").join(items, ["title_id", "play_item_ref"])
    time = F.greatest(F.col("_before") + F.col("timestamp_45k") - F.col("in_time"), F.lit(0)) / CLOCK
    n = F.row_number().over(W.partitionBy("title_id").orderBy("mark_no"))
    return at.select("title_id", n.alias("n"), time.alias("time_secs"), n.cast("string").alias("name"))


def chapter_summary(marks: DataFrame, play_items: DataFrame) -> DataFrame:
    """A10: marks of types up to 1, and the duration, of titles that have any."""
    m = marks.filter("mark_type <= 1").groupBy("title_id").agg(F.count("*").alias("chapters"))
    d = play_items.groupBy("title_id").agg((F.sum(F.col("out_time") - F.col("in_time")) / CLOCK).alias("duration_secs"))
    return m.join(d, "title_id")


def chapter_at(points: DataFrame, titles: DataFrame, chapters: DataFrame) -> DataFrame:
    """Points (title_id, offset in bytes) with their time and chapter: the last of the leading run of chapters that start by then, 1 before the
    first, null where the title has none or no size."""
    t = points.join(titles.select("title_id", "duration_secs", "size_bytes"), "title_id").filter("size_bytes > 0")
    asked = t.select("title_id", "offset", (F.col("offset") / F.col("size_bytes") * F.col("duration_secs")).alias("time_secs"))
    later = W.partitionBy("title_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    # a chapter counts from the time at which all before it have started
    c = chapters.withColumn("from", F.max("time_secs").over(later))
    rows = c.select("title_id", F.col("from").alias("t"), F.lit(0).alias("kind"), F.col("n").cast("long").alias("n"), F.lit(None).cast("long").alias("offset"))
    rows = rows.unionByName(asked.select("title_id", F.col("time_secs").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("n"), "offset"))
    w = W.partitionBy("title_id").orderBy("t", "kind", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_hit", F.max("n").over(w)).withColumn("_any", F.max("n").over(W.partitionBy("title_id")))
    return rows.filter("kind = 1").select("title_id", "offset", F.col("t").alias("time_secs"), F.when(F.col("_any").isNotNull(), F.coalesce("_hit", F.lit(1))).alias("chapter"))


def canonical_title_order(titles: DataFrame, richness: DataFrame, capacity: Column) -> DataFrame:
    """Place of each title on its disc: those larger than the disc last, then by size, duration and audio, then the playlist."""
    t = titles.join(richness, "title_id", "left")
    w = W.partitionBy("disc_id").orderBy((F.col("size_bytes") > capacity).asc(), F.desc("size_bytes"), F.desc("duration_secs"), F.desc(F.coalesce("lossless", F.lit(False))), F.desc(F.coalesce("max_channels", F.lit(0))), F.desc(F.coalesce("tracks", F.lit(0))), "playlist", "title_id")
    return t.select("disc_id", "title_id", F.row_number().over(w).alias("place"))


def audio_richness(streams: DataFrame) -> DataFrame:
    """A3: any lossless track, most channels (an unknown number as 0), number of tracks."""
    channels = F.when(F.col("audio_format").isin(1, 3, 6, 12), S.channel_count(F.col("audio_format"))).otherwise(0)
    return streams.filter("kind = 'audio'").groupBy("title_id").agg(F.max(F.col("codec").isin("TrueHD", "DTS-HD MA", "DTS-HD HR", "LPCM", "FLAC")).alias("lossless"), F.max(channels).alias("max_channels"), F.count("*").alias("tracks"))


def title_totals(extents: DataFrame, titles: DataFrame) -> DataFrame:
    """A2: sectors, bytes, GB and duration of each title."""
    s = extents.groupBy("title_id").agg(F.sum("sector_count").alias("total_sectors"))
    return titles.join(s, "title_id").select("title_id", "total_sectors", (F.col("total_sectors") * SECTOR).alias("bytes"), (F.col("total_sectors") * SECTOR / 2**30).alias("size_gb"), S.duration_display(F.col("duration_secs")).alias("duration"))


def default_tracks(streams: DataFrame) -> DataFrame:
    """The first video and the first audio that are not secondary."""
    w = W.partitionBy("title_id", "kind", "secondary").orderBy("ord")
    return streams.withColumn("is_default", F.col("kind").isin("video", "audio") & ~F.col("secondary") & (F.row_number().over(w) == 1))


def container_fit(streams: DataFrame) -> DataFrame:
    """Which streams an MP4 keeps, and why others go: the first HEVC or H.264 video that does not depend on another view
    (column `dependent`, if there is one), and AC-3 and DTS audio of all kinds."""
    dependent = F.col("dependent") if "dependent" in streams.columns else F.lit(False)
    fits = (F.col("kind") == "video") & ~dependent & F.col("codec").isin("HEVC", "H.264")
    first = F.row_number().over(W.partitionBy("title_id", fits).orderBy("ord")) == 1
    sound = F.col("codec").isin("AC-3", "EAC-3", "DTS", "DTS-HD MA", "DTS-HD HR")
    reason = F.when(F.col("kind") == "subtitle", "BitmapSubtitle").when((F.col("kind") == "audio") & ~sound, "UnmappableAudio").when((F.col("kind") == "video") & ~(fits & first), "SecondaryVideo")
    return streams.select("title_id", "ord", "kind", "codec", reason.alias("reason"))


def detect_disc_format(discs: DataFrame, streams: DataFrame, titles: DataFrame) -> DataFrame:
    """Format of each disc (disc_id, trees: names of its root folders, generation or null): of a BDMV tree by the generation, 21 FMTS, 20 UHD, 10 BD; where
    that is unknown, UHD if the first video of known size in its first three titles is one, else BD. Then HVDVD_TS and VIDEO_TS."""
    resolution = S.resolution(F.col("video_format"))
    first = titles.withColumn("_p", F.row_number().over(W.partitionBy("disc_id").orderBy("playlist", "title_id"))).filter("_p <= 3").select("disc_id", "title_id", "_p")
    sized = first.join(streams.filter("kind = 'video'"), "title_id").filter(resolution != "unknown")
    uhd = sized.groupBy("disc_id").agg(F.min_by(S.is_uhd(resolution), F.struct("_p", "ord")).alias("_uhd"))
    tree = lambda name: F.array_contains("trees", name)
    by_size = F.when(F.coalesce("_uhd", F.lit(False)), "UHD").otherwise("BD")
    bd = F.when(F.col("generation") == 21, "FMTS").when(F.col("generation") == 20, "UHD").when(F.col("generation") == 10, "BD").otherwise(by_size)
    return discs.join(uhd, "disc_id", "left").select("disc_id", F.when(tree("BDMV"), bd).when(tree("HVDVD_TS"), "HD DVD").when(tree("VIDEO_TS"), "DVD").otherwise("Unknown").alias("format"))


def audit_streams(clip_streams: DataFrame, stn: DataFrame) -> DataFrame:
    """Streams of clip info against the stream table by pid: on one side only, alike, or divergent in codec or language."""
    first = lambda df: df.filter("pid <> 0").withColumn("_p", F.row_number().over(W.partitionBy("title_id", "pid").orderBy("ord"))).filter("_p = 1")
    a = first(clip_streams).select("title_id", "pid", F.col("coding_type").alias("a_type"), F.col("language").alias("a_lang"))
    b = first(stn).select("title_id", "pid", F.col("coding_type").alias("b_type"), F.col("language").alias("b_lang"))
    kind = F.when(F.col("b_type").isNull(), "clip_only").when(F.col("a_type").isNull(), "playlist_only").when((F.col("a_type") == F.col("b_type")) & (F.col("a_lang") == F.col("b_lang")), "match").otherwise("divergent")
    return a.join(b, ["title_id", "pid"], "full_outer").select("title_id", "pid", kind.alias("class"))


def audit_counts(audit: DataFrame) -> DataFrame:
    """Rows of each class."""
    n = lambda c: F.sum((F.col("class") == c).cast("long")).alias(c)
    return audit.groupBy("title_id").agg(n("clip_only"), n("playlist_only"), n("match"), n("divergent"))


def union_pids(clip_streams: DataFrame, stn: DataFrame) -> DataFrame:
    """Pids of either side."""
    return clip_streams.select("title_id", "pid").union(stn.select("title_id", "pid")).distinct()


# labels

_sources: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_label_source(name: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    """A source of labels; the order of registration breaks ties of confidence."""
    _sources[name] = read


def registered_labels(spark: SparkSession, where: str) -> DataFrame:
    out = None
    for order, (name, read) in enumerate(_sources.items()):
        part = read(spark, where).withColumn("source_name", F.lit(name)).withColumn("source_order", F.lit(order))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no label source is registered")
    return out


def select_label_source(labels: DataFrame) -> DataFrame:
    """All labels of each disc's best source: the highest confidence, then the earliest source."""
    best = labels.groupBy("disc_id").agg(F.max_by("source_name", F.struct("confidence", (-F.col("source_order")).alias("o"))).alias("source_name"))
    return labels.join(best, ["disc_id", "source_name"], "left_semi")


def fill_label_gaps(chosen: DataFrame, floor: DataFrame) -> DataFrame:
    """The chosen labels, and those of the floor whose disc, type and number have none."""
    keys = ["disc_id", "stream_type", "stream_number"]
    return chosen.select(*keys, "language").unionByName(floor.join(chosen, keys, "left_anti").select(*keys, "language"))


def append_orphans(labels: DataFrame, streams: DataFrame) -> DataFrame:
    """Labels for streams (title_id, kind, ord, pid, language, codec) that no label of the title matches in type, language and codec; numbers go on after the title's largest."""
    first = streams.filter(F.col("kind").isin("audio", "subtitle")).withColumn("_p", F.row_number().over(W.partitionBy("title_id", "pid").orderBy("ord"))).filter("_p = 1")
    left = first.join(labels, ["title_id", "kind", "language", "codec"], "left_anti")
    top = labels.groupBy("title_id", "kind").agg(F.max("number").alias("_top"))
    n = F.row_number().over(W.partitionBy("title_id", "kind").orderBy("ord"))
    new = left.join(top, ["title_id", "kind"], "left").select("title_id", "kind", "language", "codec", (F.coalesce("_top", F.lit(0)) + n).alias("number"))
    return labels.select("title_id", "kind", "language", "codec", "number").unionByName(new)


def apply_labels(streams: DataFrame, labels: DataFrame) -> DataFrame:
    """Streams (title_id, ord, kind, codec, channels) with the first label (title_id, kind, number, language, name, purpose, qualifier,
    codec_hint, variant, label_no) of their type and place in the title, 1-based by type.

    Audio takes the purpose, and as label the variant in brackets and a descriptor: none for an empty hint, the hint itself where it agrees with
    the stream's codec and says more than codecs can, else what codec and channels give. Without either, the name of a label of Normal
    purpose. Subtitles take the qualifier; Forced sets forced. What has no label keeps purpose Normal, qualifier None and an empty label."""
    s = streams.withColumn("number", F.row_number().over(W.partitionBy("title_id", "kind").orderBy("ord")).cast("long"))
    told = F.struct("name", "purpose", "qualifier", "codec_hint", "variant")
    best = labels.groupBy("title_id", "kind", "number").agg(F.min_by(told, "label_no").alias("l"))
    j = s.join(best, ["title_id", "kind", "number"], "left")
    has, sound = F.col("l").isNotNull(), F.col("kind") == "audio"
    text = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit(""))
    own = S.audio_label(F.col("codec"), F.col("channels"))
    keeps = S.codec_hint_consistent(text("codec_hint"), F.col("codec")) & S.codec_hint_adds_detail(text("codec_hint"))
    descriptor = F.when(text("codec_hint") == "", "").when(keeps, text("codec_hint")).otherwise(own)
    variant = F.when(text("variant") != "", F.concat(F.lit("("), text("variant"), F.lit(")"))).otherwise("")
    label = F.array_join(F.filter(F.array(variant, descriptor), lambda x: x != ""), " ")
    named = F.when(label != "", label).when(text("purpose") == "Normal", text("name")).otherwise("")
    return j.select(
        *streams.columns, "number",
        F.when(sound & has, text("purpose")).otherwise("Normal").alias("purpose"),
        F.when((F.col("kind") == "subtitle") & has, text("qualifier")).otherwise("None").alias("qualifier"),
        ((F.col("kind") == "subtitle") & has & (text("qualifier") == "Forced")).alias("forced"),
        F.when(sound & has, named).otherwise("").alias("label"),
    )


def dedup_stn_labels(streams: DataFrame) -> DataFrame:
    """Distinct type, language, codec and pid of each title, numbered by type in the order first seen."""
    d = streams.filter(F.col("kind").isin("audio", "subtitle")).groupBy("title_id", "kind", "language", "codec", "pid").agg(F.min("ord").alias("first"))
    return d.withColumn("number", F.row_number().over(W.partitionBy("title_id", "kind").orderBy("first")).cast("long"))


def labels_by_language(labels: DataFrame) -> DataFrame:
    """Languages of each disc, numbered in the order first seen."""
    g = labels.groupBy("disc_id", "language").agg(F.min("doc_id").alias("first"))
    return g.withColumn("number", F.row_number().over(W.partitionBy("disc_id").orderBy("first")).cast("long"))


def match_drive(drives: DataFrame, profiles: DataFrame) -> DataFrame:
    """Drives with the profile of the same trimmed vendor, product, revision and vendor field."""
    key = F.concat_ws("|", *[F.trim(F.col(c)) for c in ("vendor", "product", "revision", "vendor_specific")])
    return drives.withColumn("match_key", key).join(profiles, "match_key", "left")


def extraction_report(files: DataFrame, file_extents: DataFrame, bad: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Bytes of each file, those lost to bad ranges (never more than the file), and whether it is whole."""
    from reelspark.operators.ranges import overlap_join

    left = file_extents.select("disc_id", "path", (F.col("abs_lba") * SECTOR).alias("l_start"), (F.col("abs_lba") * SECTOR + F.col("byte_len")).alias("l_end"))
    right = bad.select("disc_id", F.col("pos").alias("r_start"), (F.col("pos") + F.col("size")).alias("r_end"))
    lost = overlap_join(left, right, "disc_id", width).groupBy("disc_id", "path").agg(F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("_lost"))
    unreadable = F.least(F.coalesce("_lost", F.lit(0)), F.col("size"))
    return files.join(lost, ["disc_id", "path"], "left").select("disc_id", "path", (F.col("size") - unreadable).alias("bytes_good"), unreadable.alias("bytes_unreadable"), (unreadable == 0).alias("complete"))


def extraction_rollup(report: DataFrame) -> DataFrame:
    """Totals by disc and of all discs (a null disc)."""
    return report.rollup("disc_id").agg(F.sum("bytes_good").alias("bytes_good"), F.sum("bytes_unreadable").alias("bytes_unreadable"), F.bool_and("complete").alias("complete"))


def name_collisions(files: DataFrame) -> DataFrame:
    """Host paths that two or more disc paths are written to; a path with a component that no host takes is written nowhere."""
    f = files.withColumn("_parts", F.transform(F.split("path", "/"), S.sanitized_component)).filter(~F.exists("_parts", lambda p: p.isNull()))
    f = f.withColumn("host", F.array_join("_parts", "/"))
    return f.groupBy("disc_id", "host").agg(F.countDistinct("path").alias("paths")).filter("paths > 1")


def strip_top_level(files: DataFrame) -> DataFrame:
    """Files but those under AACS or CERTIFICATE at the root."""
    return files.filter(~F.upper(F.element_at(F.split(F.ltrim(F.col("path"), F.lit("/")), "/"), 1)).isin("AACS", "CERTIFICATE"))
