"""Damage located on titles and pictures, progress of discs, and the small rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.operators import catalog as C
from reelspark.operators import ranges as R
from reelspark.sources.tables import written


def locate_ranges(bad: DataFrame, extents: DataFrame, titles: DataFrame, chapters: DataFrame, k: int = 50, width: int = R.BIN, risk: DataFrame | None = None) -> DataFrame:
    """For each title the k bad ranges of its disc that last longest at its rate, whole and wherever they lie: first sector and
    sectors, play time in ms, chapter and time where the first sector is in the title (null outside, or without chapters or bytes). Besides, of the
    title: all ranges of the disc, how many are left out, the longest's play time, and the time at risk, that of the bytes of its extents in bad ranges.

    Ranges last as their sizes, at whatever rate, so the k largest of a disc are picked once, not for each title. Ranges, titles, the picked ranges and their places are each
    read more than once, and so written first. risk (title_id, bytes_bad) is J5's result, if it is known already."""
    if risk is None:
        bad = written(bad, "bad-ranges")
    titles = written(titles.select("disc_id", "title_id", "size_bytes", "duration_secs"), "titles")
    by_size = W.partitionBy("disc_id").orderBy(F.desc("size"), "pos")
    by_pos = W.partitionBy("disc_id").orderBy("pos", F.desc("size"))
    ranked = bad.select("disc_id", "pos", "size", F.row_number().over(by_size).alias("_by_size"), F.row_number().over(by_pos).alias("_by_pos"), F.count("*").over(W.partitionBy("disc_id")).alias("num_ranges"))
    top = written(ranked.filter((F.col("_by_size") <= k) | (F.col("_by_pos") <= k)), "top-ranges")
    lba = F.floor(F.col("pos") / R.SECTOR)
    rate = F.when(F.col("duration_secs") > 0, F.col("size_bytes") / F.col("duration_secs")).otherwise(0.0)
    t = titles.select("disc_id", "title_id", rate.alias("_rate")).join(top, "disc_id")
    t = t.withColumn("rank", F.when(F.col("_rate") > 0, F.col("_by_size")).otherwise(F.col("_by_pos"))).filter(F.col("rank") <= k)
    ms = lambda n: F.when(F.col("_rate") > 0, n / F.col("_rate") * 1000).otherwise(0.0)
    t = t.withColumn("lba", lba).withColumn("count", F.floor(F.col("size") / R.SECTOR)).withColumn("duration_ms", ms(F.col("size")))
    place = written(R.locate_lba(top.select("disc_id", lba.alias("lba")), extents, width=max(1, width // R.SECTOR)).select("title_id", "lba", "offset"), "places")
    # only titles that hold a picked range need their chapters
    told = chapters.join(place.select("title_id").distinct(), "title_id", "left_semi")
    timed = C.chapter_at(place.select("title_id", "offset").distinct(), titles, told).filter("chapter IS NOT NULL")
    found = place.join(timed, ["title_id", "offset"]).select("title_id", "lba", "chapter", F.col("time_secs").alias("time_offset_secs"))
    risk = R.bytes_bad_in_title(extents, bad, width=width).select("title_id", "bytes_bad") if risk is None else risk
    out = t.join(found, ["title_id", "lba"], "left").join(risk, "title_id", "left")
    at_risk = F.when(F.col("_rate") > 0, F.coalesce("bytes_bad", F.lit(0)) * 1000.0 / F.col("_rate")).otherwise(0.0)
    largest = F.max("duration_ms").over(W.partitionBy("title_id"))
    return out.select(
        "title_id", "rank", "lba", "count", "duration_ms", "chapter", "time_offset_secs", "num_ranges", F.greatest(F.col("num_ranges") - k, F.lit(0)).alias("truncated"),
        largest.alias("largest_gap_ms"), at_risk.alias("main_at_risk_ms"),
    )


def flag_recovered(pictures: DataFrame, bad: DataFrame, key: str = "title_id", width: int = R.BIN) -> DataFrame:
    """Pictures (key, track, idx, src_byte, size) with whether their bytes touch a bad range."""
    left = pictures.select(key, "track", "idx", F.col("src_byte").alias("l_start"), (F.col("src_byte") + F.col("size")).alias("l_end"))
    hit = R.overlap_join(left, bad.select(key, F.col("pos").alias("r_start"), (F.col("pos") + F.col("size")).alias("r_end")), key, width).select(key, "track", "idx").distinct().withColumn("_hit", F.lit(True))
    return pictures.select(key, "track", "idx").join(hit, [key, "track", "idx"], "left").select(key, "track", "idx", F.coalesce("_hit", F.lit(False)).alias("recovered"))


def progress_snapshot(ranges: DataFrame, discs: DataFrame, titles: DataFrame, extents: DataFrame, chapters: DataFrame, k: int = 50) -> DataFrame:
    """What is known of each disc (disc_id, total_bytes) between passes: bytes by state, and of its title (titles: one a disc, the main one) duration, size, bytes in ranges that
    are not good (not tried ones left out), and those ranges located (J8): `located` (lba, count, duration_ms, chapter, time_offset_secs; the k longest), how many there are and are left
    out, the longest's play time and the time at risk. A disc without a title, or without such ranges, has none."""
    ranges = written(ranges, "overlay")
    bad = R.ranges_with(ranges, R.LOST)
    titles = written(titles.select("disc_id", "title_id", "size_bytes", "duration_secs"), "main-titles")
    of = written(extents.join(titles.select("title_id"), "title_id", "left_semi"), "main-extents")
    risk = written(R.bytes_bad_in_title(of, bad).select("title_id", "bytes_bad"), "bytes-bad")
    places = locate_ranges(bad, of, titles, chapters, k, risk=risk)
    one = F.struct("rank", "lba", "count", "duration_ms", "chapter", "time_offset_secs")
    located = places.groupBy("title_id").agg(F.array_sort(F.collect_list(one)).alias("_l"), *[F.first(c).alias(c) for c in ("num_ranges", "truncated", "largest_gap_ms", "main_at_risk_ms")])
    risk = risk.withColumnRenamed("bytes_bad", "bytes_bad_in_main_title")
    t = titles.select("disc_id", "title_id", F.col("duration_secs").alias("main_title_duration_secs"), F.col("size_bytes").alias("main_title_size_bytes")).join(located, "title_id", "left").join(risk, "title_id", "left")
    none = F.array().cast("array<struct<lba:bigint,count:bigint,duration_ms:double,chapter:int,time_offset_secs:double>>")
    plain = F.transform("_l", lambda x: F.struct(x["lba"].alias("lba"), x["count"].alias("count"), x["duration_ms"].alias("duration_ms"), x["chapter"].cast("int").alias("chapter"), x["time_offset_secs"].alias("time_offset_secs")))
    s = R.range_stats(ranges).join(discs.select("disc_id", F.col("total_bytes").alias("bytes_total_disc")), "disc_id", "left").join(t, "disc_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes_bad_in_main_title", "num_ranges", "truncated", "largest_gap_ms", "main_at_risk_ms")]
    return s.select(*R.range_stats(ranges).columns, "bytes_total_disc", "main_title_duration_secs", "main_title_size_bytes", *counts, F.coalesce(plain, none).alias("located"))


def skip_totals(events: DataFrame) -> DataFrame:
    """Skips and the bytes they lost, kept apart, as a skip may cover several sectors."""
    return events.groupBy("title_id").agg(F.count("*").alias("skips"), F.sum("bytes").alias("bytes_lost"))


def forced_track(sets: DataFrame) -> DataFrame:
    """A5: forced where there was a display set and all were forced; null where none was."""
    return sets.groupBy("title_id", "track").agg(F.bool_and("forced").alias("forced"), F.count("forced").alias("sets"))


def small_file_ranges(files: DataFrame, file_extents: DataFrame, most: int = 50_000_000) -> DataFrame:
    """Merged sector ranges of files outside STREAM folders and of `most` bytes at most."""
    small = files.filter((F.col("size") <= most) & ~F.upper("path").rlike("(^|/)STREAM(/|$)")).select("disc_id", "path")
    e = file_extents.join(small, ["disc_id", "path"], "left_semi").select("disc_id", F.col("abs_lba").alias("start_lba"), F.ceil(F.col("byte_len") / R.SECTOR).alias("sector_count"))
    return R.merge_ranges(e, "disc_id")


def select_pids(packets: DataFrame, pids: DataFrame) -> DataFrame:
    """Packets of the selected pids; where the table tells them, a packet without the sync byte or of the reserved adaptation code 0 goes, and one of
    adaptation alone carries no payload."""
    kept = packets.join(pids.select("pid").distinct(), "pid", "left_semi")
    if "sync" in packets.columns:
        kept = kept.filter("sync")
    return kept.filter("afc <> 0").withColumn("has_payload", F.col("afc") != 2) if "afc" in packets.columns else kept


def error_predicates(status: Column, key: Column) -> dict[str, Column]:
    """Failure of the transport, a failing bridge, a marginal sector."""
    return {"transport": status == 0xFF, "bridge": ~status.isin(0, 2, 0xFF), "marginal": (status == 2) & key.isin(0, 1, 2, 3, 11)}


#: Code points of matrix, transfer and primaries by colour space; a limited range is 1.
CICP = {"bt2020": (9, 16, 9), "bt709": (1, 1, 1), "bt470bg": (5, 5, 5), "smpte170m": (6, 6, 6)}


def cicp(measured: Column, color_space: Column, hdr: Column) -> Column:
    """matrix, transfer, primaries and range: what was measured (a struct), else by the colour space, 2 where it is unknown, with the
    transfer of the HDR format, 16 for PQ and 18 for HLG."""
    def by_space(k: int) -> Column:
        out = F.lit(2)
        for name, codes in CICP.items():
            out = F.when(color_space == name, codes[k]).otherwise(out)
        return out

    transfer = F.when(hdr.isin("HDR10", "HDR10+", "DolbyVision"), 16).when(hdr == "HLG", 18).otherwise(by_space(1))
    fallback = F.struct(by_space(0).alias("matrix"), transfer.alias("transfer"), by_space(2).alias("primaries"), F.lit(1).alias("range"))
    return F.when(measured.isNotNull(), measured.cast("struct<matrix:int,transfer:int,primaries:int,range:int>")).otherwise(fallback)
