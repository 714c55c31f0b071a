"""Window forms against sequential replays, literal cases, and every query with SQL against DuckDB on the smallest tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelspark.functions import scalars as S
from reelspark.operators import catalog as C
from reelspark.operators import damage as D
from reelspark.operators import dvd as V
from reelspark.operators import frames as O
from reelspark.operators import ranges as R
from reelspark.sources.views import spark_view as view

DATA = "/root/testdata/sf0.001"
def video():
    return F.col("track") == 0


def ranges(spark, rows):
    return spark.createDataFrame(rows, "disc_id long, seq long, pos long, size long, status string")


def tuples(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def replay(rows):
    """Bytes of each disc after all records, as joined ranges."""
    discs = {}
    for disc, _, pos, size, status in sorted(rows, key=lambda r: r[1]):
        for b in range(pos, pos + size):
            discs.setdefault(disc, {})[b] = status
    out = []
    for disc, held in discs.items():
        run = None
        for b in sorted(held):
            if run and run[1] + run[2] == b and run[3] == held[b]:
                run[2] += 1
            else:
                run = [disc, b, 1, held[b]]
                out.append(run)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", [7, 8])
def test_overlay_equals_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(d, i, rng.randrange(90), rng.randrange(0, 25), rng.choice("+-*/?")) for d in range(3) for i in range(40)]
    assert tuples(R.overlay_ranges(ranges(spark, rows)), "disc_id", "pos", "size", "status") == replay(rows)


def test_whole_disc_ranges_and_many_passes(spark):
    """Each disc begins with one range over all of it, then ten passes; intervals of all sizes meet once, and rows stay linear."""
    size, rng = 50_000_000_000, random.Random(3)
    rows = [(d, 0, 0, size, "?") for d in range(3)]
    rows += [(d, 1 + k * 1000 + i, rng.randrange(size // 2048) * 2048, 2048 * rng.choice([1, 50, 40_000, 9_000_000]), rng.choice("+-*/")) for d in range(3) for k in range(10) for i in range(20)]
    made = R.overlay_ranges(ranges(spark, rows)).collect()
    assert len(made) <= 2 * len(rows)
    for d in range(3):
        own = sorted((r["pos"], r["size"], r["status"]) for r in made if r["disc_id"] == d)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] != b[2] for a, b in zip(own, own[1:]))
        for pos, n, status in own:
            at = pos + n // 2
            assert status == max((r for r in rows if r[0] == d and r[2] <= at < r[2] + r[3]), key=lambda r: r[1])[4]
    left = spark.createDataFrame([(d, p, p + n, i) for i, (d, _, p, n, _) in enumerate(rows)], "disc_id long, l_start long, l_end long, i long")
    right = left.select("disc_id", F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end"), F.col("i").alias("j"))
    placed = lambda df, other: R._placed(df, "disc_id", "l_start", "l_end", R.BIN, R._levels(other, "disc_id", "l_start", "l_end", R.BIN), ("both", "left"), "right").count()
    narrow = left.filter("l_end - l_start <= 102400")
    assert placed(left, left) <= 10 * len(rows) and placed(narrow, narrow) <= 1.2 * narrow.count() and placed(narrow, left) > 3 * narrow.count()
    got = sorted((r["i"], r["j"]) for r in R.overlap_join(left, right, "disc_id").collect())
    assert got == [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and a[2] < b[2] + b[3] and b[2] < a[2] + a[3]]


def test_overlay_cases(spark):
    rows = [(1, 1, 0, 100, "?"), (1, 2, 20, 20, "+"), (1, 3, 30, 40, "-"), (2, 1, 0, 50, "-"), (2, 2, 0, 50, "+"), (3, 1, 0, 10, "+"), (3, 2, 10, 10, "+"), (3, 3, 5, 0, "-")]
    got = tuples(R.overlay_ranges(ranges(spark, rows)), "disc_id", "pos", "size", "status")
    assert got == [(1, 0, 20, "?"), (1, 20, 10, "+"), (1, 30, 40, "-"), (1, 70, 30, "?"), (2, 0, 50, "+"), (3, 0, 20, "+")]


def test_subtract_and_intersect(spark):
    rng = random.Random(4)
    make = lambda: [(d, 0, rng.randrange(60), rng.randrange(1, 15), "-") for d in range(2) for _ in range(6)]
    a, b = make(), make()
    cover = lambda rows, d: {x for r in rows if r[0] == d for x in range(r[2], r[2] + r[3])}
    left = R.subtract_ranges(ranges(spark, a), ranges(spark, b)).collect()
    both = R.intersect_ranges(ranges(spark, a), ranges(spark, b), width=5).collect()
    for d in range(2):
        assert {x for r in left if r["disc_id"] == d for x in range(r["pos"], r["pos"] + r["size"])} == cover(a, d) - cover(b, d)
        assert {x for r in both if r["disc_id"] == d for x in range(r["pos"], r["pos"] + r["size"])} == cover(a, d) & cover(b, d)


def test_merge_bridges_one_sector(spark):
    e = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 5), (1, 2, 18, 2), (1, 3, 4, 3)], "title_id long, ord long, start_lba long, sector_count long")
    assert tuples(R.merge_ranges(e), "title_id", "start_lba", "sector_count") == [(1, 0, 16), (1, 18, 2)]


def test_bad_range_between_extents_counts_nothing(spark):
    e = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 1, 1, 20, 10)], "disc_id long, title_id long, ord long, start_lba long, sector_count long")
    bad = spark.createDataFrame([(1, 12 * 2048, 4 * 2048)], "disc_id long, pos long, size long")
    assert R.bytes_bad_in_title(e, bad).count() == 0
    over = spark.createDataFrame([(1, 8 * 2048, 14 * 2048)], "disc_id long, pos long, size long")
    assert R.bytes_bad_in_title(e, over, width=4096).first()["bytes_bad"] == 4 * 2048


def test_bytes_bad_in_title_makes_no_pairs(spark):
    """Extents and ranges that lie over each other, of many cells (width 1), equal all pairs; no join, and 400 million pairs are not made."""
    rng = random.Random(5)
    e = [(d, t, rng.randrange(-4, 40), rng.choice([0, 1, 3, 20])) for d in range(4) for t in range(5) for _ in range(8)]
    b = [(d, rng.randrange(-9000, 80_000), rng.choice([0, 1, 700, 5000, 60_000])) for d in range(1, 5) for _ in range(12)]
    want: dict[tuple[int, int], int] = {}
    for d, t, lba, n in e:
        for x, pos, size in b:
            common = min((lba + n) * 2048, pos + size) - max(lba * 2048, pos)
            if x == d and n and size and common > 0:
                want[d, t] = want.get((d, t), 0) + common
    extents = spark.createDataFrame(e, "disc_id long, title_id long, start_lba long, sector_count long")
    bad = spark.createDataFrame(b, "disc_id long, pos long, size long")
    for width in (1, R.BIN):
        got = R.bytes_bad_in_title(extents, bad, width=width)
        assert tuples(got, "disc_id", "title_id", "bytes_bad") == sorted((*k, v) for k, v in want.items())
    assert "Join" not in got._jdf.queryExecution().toString()
    many = spark.range(20_000).select(F.lit(1).alias("disc_id"), F.lit(7).alias("title_id"), F.lit(0).alias("start_lba"), F.lit(1000).alias("sector_count"))
    all_bad = spark.range(20_000).select(F.lit(1).alias("disc_id"), F.col("id").alias("pos"), F.lit(10).alias("size"))
    assert R.bytes_bad_in_title(many, all_bad).first()["bytes_bad"] == 20_000 * 20_000 * 10


def test_locate_ranges_reads_extents_once_for_risk(spark, tmp_path):
    """Places are written before they are joined: what is left reads extents for the bytes at risk only."""
    spark.createDataFrame([(1, 7, 1, 10, 4), (1, 7, 2, 30, 6)], "disc_id long, title_id long, ord long, start_lba long, sector_count long").write.parquet(f"{tmp_path}/its-extents")
    extents = spark.read.parquet(f"{tmp_path}/its-extents")
    bad = spark.createDataFrame([(1, 32 * 2048, 4096), (1, 0, 2048)], "disc_id long, pos long, size long")
    titles = spark.createDataFrame([(1, 7, 20_480, 10.0)], "disc_id long, title_id long, size_bytes long, duration_secs double")
    chapters = spark.createDataFrame([(7, 1, 0.0), (7, 2, 5.0)], "title_id long, n int, time_secs double")
    made = D.locate_ranges(bad, extents, titles, chapters, 2)
    assert tuples(made, "rank", "lba", "count", "chapter", "time_offset_secs", "main_at_risk_ms") == [(1, 32, 2, 2, 6.0, 2000.0), (2, 0, 1, None, None, 2000.0)]
    assert made._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|").count("start_lba") == 1


def test_progress_snapshot_sums_losses_once(spark, tmp_path):
    """Main titles, their extents and their losses are written once; what is left reads none of the extents given."""
    spark.createDataFrame([(1, 7, 1, 10, 4), (1, 7, 2, 30, 6), (1, 8, 1, 0, 9)], "disc_id long, title_id long, ord long, start_lba long, sector_count long").write.parquet(f"{tmp_path}/its-extents")
    extents = spark.read.parquet(f"{tmp_path}/its-extents")
    made = spark.createDataFrame([(1, 32 * 2048, 4096, "-"), (1, 0, 2048, "*"), (1, 2048, 2048, "+")], "disc_id long, pos long, size long, status string")
    discs = spark.createDataFrame([(1, 99 * 2048)], "disc_id long, total_bytes long")
    main = spark.createDataFrame([(1, 7, 20_480, 10.0)], "disc_id long, title_id long, size_bytes long, duration_secs double")
    chapters = spark.createDataFrame([(7, 1, 0.0), (7, 2, 5.0)], "title_id long, n int, time_secs double")
    snap = D.progress_snapshot(made, discs, main, extents, chapters, 1)
    r = snap.first()
    assert (r["bytes_good"], r["bytes_bad_in_main_title"], r["num_ranges"], r["truncated"], r["main_at_risk_ms"]) == (2048, 4096, 2, 1, 2000.0)
    assert [tuple(x) for x in r["located"]] == [(32, 2, 2000.0, 2, 6.0)]
    assert "start_lba" not in snap._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|")


def test_severity(spark):
    rows = [(0, 0), (0, 40_000), (1, 5), (50, 999), (51, 0), (500, 0), (10, 1000), (10, 30_000)]
    got = spark.createDataFrame(rows, "b long, ms long").select(R.damage_severity(F.col("b"), F.col("ms")).alias("s"))
    assert [r["s"] for r in got.collect()] == ["clean", "clean", "cosmetic", "cosmetic", "moderate", "serious", "moderate", "serious"]


def frames(spark, rows):
    return spark.createDataFrame(rows, "title_id long, track long, idx long, pts_ns long, keyframe boolean, discontinuity boolean, ctype string, size long, src_byte long")


def of_types(spark, types, gap=40_000_000):
    return frames(spark, [(1, 0, i, i * gap, t == "I", False, t, 10, i * 2048) for i, t in enumerate(types)])


def test_display_index(spark):
    got = O.display_index(of_types(spark, "IPBPB")).orderBy("idx").collect()
    assert [r["display"] for r in got] == [0, 2, 1, 4, 3]


def test_monotonic_and_resync(spark):
    rng = random.Random(2)
    rows = [(1, t, i, rng.randrange(50), rng.random() < 0.3, rng.random() < 0.2, "P", 1, 0) for i in range(60) for t in (0, 1)]
    got = {(r["track"], r["idx"]): r["ts"] for r in O.monotonic_ts(frames(spark, rows), video()).collect()}
    last, armed, kept = None, False, set()
    for _, track, idx, pts, key, cut, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        if track == 1:
            last = pts if last is None else max(pts, last + 1)
            assert got[1, idx] == last
            kept.add((1, idx))
        else:
            assert got[0, idx] == pts
            armed = (armed or cut) and not key
            if not armed:
                kept.add((0, idx))
    assert {(r["track"], r["idx"]) for r in O.resync_gate(frames(spark, rows), video()).collect()} == kept


def test_timeline(spark):
    s = O.SECOND
    rows = [(1, 0, 0, 0), (1, 0, 1, 10 * s), (1, 0, 2, 10 * s - 83_000_000), (1, 0, 3, 0), (1, 1, 4, 9 * s), (1, 0, 5, 5 * s), (1, 1, 6, 9 * s + s // 2)]
    f = frames(spark, [(t, k, i, p, False, False, "P", 1, 0) for t, k, i, p in rows])
    got = {r["idx"]: (r["ts"], r["epoch"]) for r in O.timeline_continuity(f, video()).collect()}
    assert got[2] == (10 * s - 83_000_000, 0)
    assert got[3] == (10 * s + 1_000_000, 1)
    assert got[4] == (9 * s, 1)  # a straggler of the first epoch keeps its place
    assert got[5] == (15 * s + 1_000_000, 1)


def test_clusters(spark):
    ms = 1_000_000
    rows = [(1, 0, 0, 5 * ms, False), (1, 0, 1, 100 * ms, True), (1, 0, 2, 1500 * ms, True), (1, 0, 3, 2100 * ms, True), (1, 1, 4, 6000 * ms, False)]
    f = frames(spark, [(t, k, i, p, key, False, "P", 1, 0) for t, k, i, p, key in rows])
    got = {r["idx"]: (r["cluster"], r["tick"]) for r in O.cluster_frames(f, video()).collect()}
    assert got == {1: (0, 0), 2: (0, 14_000), 3: (1, 20_000), 4: (2, 59_000)}


def test_poison_point(spark):
    rows = [(1, 0, i, True, True, 1) for i in range(200)] + [(2, 0, i, i == 399, i == 399, 1) for i in range(400)]
    u = spark.createDataFrame(rows, "title_id long, track long, idx long, dropped boolean, verified boolean, duration_ns long")
    assert tuples(O.poison_point(u), "title_id", "poison_idx") == [(1, 199)]


def test_ewma_and_zones(spark):
    a = spark.createDataFrame([(1, i, "h", float(t), b) for i, (t, b) in enumerate([(0, 9), (1, 4), (2, 4), (1, 8)])], "disc_id long, seq long, handler string, elapsed_secs double, recovered_bytes long")
    assert O.ewma_scores(a).first()["score"] == 5.5
    ok = [True] * 3 + [False] + [True] * 15 + [False] + [True] * 16 + [False]
    log = spark.createDataFrame([(1, i, k, None if k else 3, i * 32, 32) for i, k in enumerate(ok)], "disc_id long, seq long, ok boolean, sense_key int, lba long, sectors int")
    assert [r["zone"] for r in O.damage_zones(log).orderBy("seq").collect()] == [1, 1, 2]


def test_entry_points_without_exact_hits(spark):
    ep = spark.createDataFrame([(1, 100, 1000), (1, 200, 2000), (1, 300, 3000)], "clip_no long, pts long, spn long")
    clips = spark.createDataFrame([(1, 0, 150, 250), (1, 1, 50, 900), (1, 2, 300, 310), (1, 3, 310, 305)], "clip_no long, ord long, in_pts long, out_pts long")
    got = {r["ord"]: (r["start_sector"], r["sectors"]) for r in O.clip_time_extents(clips, ep).collect()}
    span = lambda a, b: (a * 192 // 2048, -(-b * 192 // 2048) - a * 192 // 2048)
    assert got == {0: span(1000, 3000), 1: span(1000, 3001), 2: span(3000, 3001), 3: span(3000, 3001)}


def test_titles_rank_oversize_last(spark):
    t = spark.createDataFrame([(1, 1, "a", 100.0, 900), (1, 2, "b", 90.0, 500), (1, 3, "c", 95.0, 500)], "disc_id long, title_id long, playlist string, duration_secs double, size_bytes long")
    rich = spark.createDataFrame([(2, True, 8, 1)], "title_id long, lossless boolean, max_channels int, tracks long")
    got = {r["title_id"]: r["place"] for r in C.canonical_title_order(t, rich, F.lit(800)).collect()}
    assert got == {3: 1, 2: 2, 1: 3}


def test_paths_that_no_host_takes(spark):
    names = ["..", ".", "a:b", "x\\y", "t\x01", "q?", " . ", "Clock$.cfg", "lpt9", "com0", "CONIN$", "ok. ", "a.b"]
    got = [r["s"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.sanitized_component(F.col("n")).alias("s")).collect()]
    assert got == [None] * 7 + ["_Clock$.cfg", "_lpt9", "com0", "_CONIN$", "ok", "a.b"]


def test_colour_codes(spark):
    rows = [(None, "bt2020", "SDR"), (None, "bt709", "HDR10"), (None, "bt709", "HLG"), (None, "x", "SDR"), (14, "bt2020", "HDR10"), (None, "bt470bg", "SDR"), (None, "smpte170m", "SDR")]
    m = F.when(F.col("t").isNotNull(), F.struct(F.lit(9).alias("matrix"), F.col("t").alias("transfer"), F.lit(9).alias("primaries"), F.lit(0).alias("range")))
    got = [tuple(r["c"]) for r in spark.createDataFrame(rows, "t int, space string, hdr string").select(D.cicp(m, F.col("space"), F.col("hdr")).alias("c")).collect()]
    assert got == [(9, 16, 9, 1), (1, 16, 1, 1), (1, 18, 1, 1), (2, 2, 2, 1), (9, 14, 9, 0), (5, 5, 5, 1), (6, 6, 6, 1)]


def test_chapter_before_its_item(spark):
    items = spark.createDataFrame([(1, 0, 0, 450_000), (1, 1, 90_000, 540_000), (1, 2, 900, 100)], "title_id long, item_no long, in_time long, out_time long")
    marks = spark.createDataFrame([(1, 0, 1, 1, 45_000), (1, 1, 1, 0, 0), (1, 2, 2, 0, 9), (1, 3, 1, 9, 9), (1, 4, 1, 2, 900)], "title_id long, mark_no long, mark_type long, play_item_ref long, timestamp_45k long")
    assert [(r["n"], r["time_secs"]) for r in C.chapters_from_marks(marks, items).orderBy("n").collect()] == [(1, 9.0), (2, 0.0), (3, 20.0)]


def test_labels_apply(spark):
    streams = spark.createDataFrame([(1, k, kind, codec, ch) for k, (kind, codec, ch) in enumerate([("audio", "TrueHD", "7.1"), ("audio", "AC-3", "stereo"), ("subtitle", "PGS", None), ("audio", "DTS-HD MA", "5.1"), ("audio", "EAC-3", "unknown"), ("audio", "DTS", "5.1")])], "title_id long, ord long, kind string, codec string, channels string")
    rows = [
        (1, "audio", 1, 1, "n", "Normal", "None", "Dolby Atmos", ""), (1, "audio", 1, 2, "later", "Normal", "None", "", ""), (1, "audio", 2, 1, "n", "Commentary", "None", "TrueHD 5.1", "Canadian"),
        (1, "subtitle", 1, 1, "n", "Normal", "Forced", "", ""), (1, "audio", 3, 1, "n", "Normal", "None", "DTS:X", ""), (1, "audio", 4, 1, "Main", "Normal", "None", "", ""), (1, "audio", 5, 1, "n", "Score", "None", "", ""),
    ]
    labels = spark.createDataFrame(rows, "title_id long, kind string, number long, label_no int, name string, purpose string, qualifier string, codec_hint string, variant string")
    got = [(r["label"], r["purpose"], r["qualifier"], r["forced"]) for r in C.apply_labels(streams, labels).orderBy("ord").collect()]
    assert got == [("Dolby Atmos", "Normal", "None", False), ("(Canadian) Dolby Digital 2.0", "Commentary", "None", False), ("", "Normal", "Forced", True), ("DTS:X", "Normal", "None", False), ("Main", "Normal", "None", False), ("", "Score", "None", False)]


def test_rebuilt_times(spark):
    types, times = "IPBPBIPBB", {0: 1000, 5: 6000}
    f = of_types(spark, types).withColumn("explicit", F.when(F.col("idx") == 0, 1000).when(F.col("idx") == 5, 6000))
    got = [(r["pts_ns"], r["duration_ns"]) for r in O.rebuild_pts(f, F.col("explicit")).orderBy("idx").collect()]
    assert times and got == [(1000 + k * 1000, 1000) for k in (0, 2, 1, 4, 3)] + [(6000 + k * 1000, 1000) for k in (0, 3, 1, 2)]
    one = [r["pts_ns"] for r in O.rebuild_pts(of_types(spark, "IP"), F.lit(None).cast("long")).orderBy("idx").collect()]
    assert one == [0, O.FILM_FRAME]


def test_label_source_registry(spark):
    for name, confidence in (("first", 1), ("second", 1), ("third", 0)):
        C.register_label_source(name, lambda s, _, n=name, c=confidence: s.createDataFrame([(1, c, n)], "disc_id long, confidence int, name string"))
    assert C.select_label_source(C.registered_labels(spark, "")).first()["name"] == "first"


def test_scalars(spark):
    row = spark.range(1).select(
        S.language(F.lit("Englishman")).alias("a"), S.language(F.lit("Français, english")).alias("b"), S.parse_timecode(F.lit("01:02:03:30")).alias("t"),
        S.chapter_time(F.lit(3661.5)).alias("c"), S.bcd_to_secs(F.lit(0x01), F.lit(0x59), F.lit(0x2F), F.lit(0x40 | 0x10)).alias("bcd"),
        S.sanitized_component(F.lit("con.txt")).alias("s"), S.sanitized_component(F.lit("a b. ")).alias("s2"), S.ts_header(F.lit("47500110")).alias("h"),
        S.qualifier(F.lit("cafésdh sdh")).alias("q"), S.duration_display(F.lit(7384.0)).alias("d"), S.playlist_number(F.lit("00042.mpls")).alias("p"),
    ).first()
    assert row["a"] is None and row["b"]["code"] == "eng" and row["t"] == 3723.5 and row["c"] == "01:01:01.500000000"
    assert row["bcd"] == 3600 + 59 * 60 + 10 / 25 and row["s"] == "_con.txt" and row["s2"] == "a b"
    assert (row["h"]["sync"], row["h"]["pid"], row["h"]["pusi"], row["h"]["cc"]) == (True, 0x1001, True, 0) and row["q"] == "Sdh" and row["d"] == "2h 03m" and row["p"] == 42


def _names():
    import __spark_entry__ as e
    from reelspark.jobs import registry

    return sorted(k for m in registry.MODULES for k in m.ORACLE) if e else []


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
def test_queries_match_duckdb(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    told = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    queries, wrong = e.queries(), []
    for name in _names():
        df, rel = queries[name](spark, DATA), con.sql(e.oracle_sql()[name])
        cols = sorted(df.columns)
        got = sorted(tuple(told(r[c]) for c in cols) for r in df.collect())
        want = sorted(tuple(told(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()) if cols == sorted(rel.columns) else None
        if got != want:
            wrong.append(name)
    assert not wrong


def pass_of(spark, reads, patch=False):
    """Decisions after reads: "." good, else a sense key, "T" transport, "B" bridge; a dash after it: inside a bisection."""
    rows, seq = [], 0
    for word in reads.split():
        bisecting, c = word.endswith("-"), word.rstrip("-")
        status = {"T": 255, "B": 8}.get(c, 2)
        rows.append((1, seq, c == ".", None if c in ".TB" else int(c), status, bisecting, 32))
        seq += 1
    log = spark.createDataFrame(rows, "disc_id long, seq long, ok boolean, sense_key int, status int, bisecting boolean, sectors int")
    return log, O.read_decisions(log, patch).orderBy("seq").collect()


def test_overlay_counts_before_it_cuts(spark):
    """Where no disc is large there are no quantiles and no second read of the log; records are laid over one another some at a time."""
    rng = random.Random(8)
    rows = [(d, k, rng.randrange(300), rng.randrange(1, 90), rng.choice("+-*/")) for d in range(7) for k in range(150)]
    log = ranges(spark, rows)
    plan = R.overlay_ranges(log)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Explode" not in plan.title()
    had, R.LAID = R.LAID, 16
    try:
        laid = R._Laid(["disc_id"])
        t = log.withColumn("end", F.col("pos") + F.col("size")).withColumn("whole_end", F.col("pos") + F.col("size")).orderBy("disc_id", "pos").drop("size").toArrow()
        got = [r for k in range(0, len(t), 10) for o in laid.add(t.slice(k, 10)) for r in o.to_pylist()] + [r for o in laid.finish() for r in o.to_pylist()]
    finally:
        R.LAID = had
    whole = tuples(R.overlay_ranges(log), "disc_id", "pos", "size", "status")
    assert whole == sorted((r["disc_id"], r["pos"], r["finish"] - r["pos"], r["status"]) for r in got)


def test_read_decisions_of_a_sweep(spark):
    told = lambda reads, *cols: [tuple(r[c] for c in cols) for r in pass_of(spark, reads)[1]]
    # each failure that counts jumps, ever farther in one zone; the first rests longer
    assert told("3 3 3", "action", "jump_sectors", "rest_secs") == [("jump", 32768, 32), ("jump", 65536, 7), ("jump", 131072, 7)]
    assert [r[0] for r in told(" ".join(["3"] * 9), "jump_sectors")][-3:] == [32768 * 64] * 3
    # sixteen good reads end the zone and the growth
    assert told("3 3 " + ". " * 16 + "3", "jump_sectors", "opens_zone")[-1] == (32768, True)
    assert told("3 3 " + ". " * 15 + "3", "jump_sectors", "opens_zone")[-1] == (131072, False)
    # a drive that is not ready is tried thrice, a bridge five times; then they count
    assert [r[0] for r in told("2 2 2 2 . 2", "action")] == ["retry"] * 3 + ["jump", None, "retry"]
    assert [r[0] for r in told("B B B B B B", "action")] == ["retry"] * 5 + ["jump"]
    assert [r[0] for r in told("2 2 3 2 2 2 2", "action")] == ["retry", "retry", "jump", "retry", "retry", "retry", "jump"]
    # wedges, recovered and retried reads stay out of the window, and a wedge without end is given up
    assert told("4 5 1 2 B T", "action", "window_reads", "jump_sectors") == [("jump", 0, 524288), ("jump", 0, 524288), ("skip", 0, None), ("retry", 0, None), ("retry", 0, None), ("abort", 0, None)]
    assert [r[0] for r in told(" ".join(["4"] * 16), "action")] == ["jump"] * 15 + ["abort"]
    assert told("3- 3- .", "action", "in_window", "window_reads", "opens_zone") == [("skip", False, 0, False), ("skip", False, 0, False), (None, True, 1, False)]


def test_read_decisions_of_a_patch(spark):
    log, got = pass_of(spark, "3 3- 3- . " + ". " * 14 + "3 7 1", patch=True)
    assert [(r["action"], r["rest_secs"]) for r in got[:3]] == [("bisect", None), ("skip", 5), ("skip", 5)]
    # a batch of another failure is not bisected; of sixteen reads one bad is enough
    assert [(r["action"], r["bad_percent"], r["window_reads"]) for r in got[-3:]] == [("bisect", 0, 15), ("jump", 6, 16), ("skip", 6, 16)]
    s = O.pass_summary(log, patch=True).first()
    assert (s["reads_ok"], s["errors"], s["zones_entered"], s["jumps_taken"], s["marginal_recovered"]) == (15, 6, 1, 1, 1)


def test_groups_are_cut_by_frames_and_by_bytes(spark):
    rng = random.Random(15)
    rows = [(t, k, i, rng.random() < 0.04, rng.choice([1, 5, 40, 900])) for t in range(3) for k in range(2) for i in range(300)]
    got = {(r["title_id"], r["track"], r["idx"]): (r["gop"], r["part"]) for r in O.gop_groups(spark.createDataFrame(rows, "title_id long, track int, idx long, keyframe boolean, size long"), 20, 3000).collect()}
    want, held = {}, {}
    for t, k, i, key, size in rows:
        gop, part, frames_held, bytes_held = held.get((t, k), (0, 0, 0, 0))
        if key:
            gop, part, frames_held, bytes_held = gop + 1, 0, 0, 0
        elif frames_held >= 20 or bytes_held >= 3000:
            part, frames_held, bytes_held = part + 1, 0, 0
        held[t, k] = (gop, part, frames_held + 1, bytes_held + size)
        want[t, k, i] = (gop, part)
    assert got == want and max(p for _, p in want.values()) > 3


def test_deep_paths_orphans_and_cycles(spark):
    deep = [(1, f"d{k}", f"d{k - 1}" if k else None, f"n{k}", True) for k in range(100)]
    wide = [(1, "f", "d99", "File.TXT", False), (1, "under_file", "f", "x", True), (1, "lost", "nobody", "y", True), (1, "below_lost", "lost", "z", False)]
    round_ = [(2, "root", None, "top", True), (2, "a", "c", "a", True), (2, "b", "a", "b", True), (2, "c", "b", "c", True), (2, "tail", "a", "t", False), (2, "self", "self", "s", True), (2, "d0", "root", "same id", True)]
    entries = spark.createDataFrame(deep + wide + round_, "disc_id long, id string, parent_id string, name string, is_dir boolean")
    paths = V.resolve_paths(entries)
    got = {(r["disc_id"], r["id"]): r["path"] for r in paths.collect()}
    whole = {f"d{k}": "".join(f"/n{j}" for j in range(k + 1)) for k in range(100)}
    assert got == {(1, k): v for k, v in whole.items()} | {(1, "f"): whole["d99"] + "/File.TXT", (2, "root"): "/top", (2, "d0"): "/top/same id"}
    lost = {(r["disc_id"], r["id"]): r["why"] for r in V.resolve_paths(entries, lost=True).collect()}
    assert lost == {(1, "under_file"): "orphan", (1, "lost"): "orphan", (1, "below_lost"): "orphan", **{(2, k): "cycle" for k in ("a", "b", "c", "tail", "self")}}
    asked = spark.createDataFrame([(1, whole["d99"].upper() + "/file.txt/")], "disc_id long, query string")
    assert V.find_path(paths, asked).first()["id"] == "f"
    assert V.resolve_paths(entries.filter("id = ''")).count() == 0


@pytest.mark.parametrize("cell", [30, 7])
def test_one_large_disc_is_swept_in_cells(spark, cell):
    rng = random.Random(cell)
    rows = [(d, i, rng.randrange(0, 4000), rng.choice([1, 5, 60, 900, 4000]), rng.choice("+-*/?")) for d, n in ((1, 400), (2, 5), (3, 60)) for i in range(n)]
    rows += [(1, 400 + k, 0, 9000, s) for k, s in enumerate("+-")] + [(1, 401, 0, 8000, "*"), (1, 402, 2000, 7000, "/")]
    log = ranges(spark, rows)
    key = lambda df: sorted((r["disc_id"], r["pos"], r["size"], r["status"]) for r in df.collect())
    assert R._cuts(log, "disc_id", cell).filter("_key <> 2 AND size(_cuts) >= 1").count() == 2
    assert key(R.overlay_ranges(log, cell=cell)) == key(R.overlay_ranges(log))


def differs(spark, folder, name):
    """Whether a query's rows and its SQL's differ on the tables of a folder, and the number of rows."""
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, rel = e.queries()[name](spark, str(folder)), con.sql(e.oracle_sql()[name])
    cols = [rel.columns.index(c) for c in df.columns]
    told = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(told(v) for v in r) for r in df.collect())
    return got != sorted(tuple(told(r[i]) for i in cols) for r in rel.fetchall()), len(got)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
def test_small_file_ranges_sql_with_ties(spark, tmp_path):
    import duckdb

    rows = "SELECT k AS page_id, 'https://a.b/' || k AS url, repeat('x', 300 + k % 97 * 30) AS html FROM range(2500) t(k)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    assert differs(spark, tmp_path, "r7_small_file_ranges") == (False, 40)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
def test_clips_of_more_than_100000_parts(spark, tmp_path):
    import duckdb

    shift = {"part": "p_partkey", "lineitem": "l_partkey"}
    for t in ("part", "lineitem", "orders", "supplier"):
        table = f"SELECT * REPLACE ({shift[t]} * 9 + i * 7650 AS {shift[t]}) FROM '{DATA}/{t}.parquet', (VALUES (0), (100)) v(i)" if t in shift else f"SELECT * FROM '{DATA}/{t}.parquet'"
        duckdb.sql(f"COPY ({table.replace('SELECT * REPLACE', 'SELECT * EXCLUDE (i) REPLACE')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for name in ("s11_title_json", "j1_build_titles", "s13_read_playlists"):
        assert not differs(spark, tmp_path, name)[0], name
    from reelspark.sources.views import spark_view

    parts = spark_view(spark, str(tmp_path), "clip_info")
    assert parts.select("clip_id").distinct().count() == parts.count() and parts.filter("length(clip_id) <> 5").count() == 0


def test_titles_sum_items_before_they_meet_clips(spark):
    """items are ranked in no window; a repeated clip counts its bytes once and its items each time, a clip of two infos once for each, one without info or extents none."""
    items = spark.createDataFrame([(1, 0, "a", 0, 45_000), (1, 1, "a", 0, 90_000), (1, 2, "b", 0, 45_000), (2, 0, "c", 0, 45_000), (3, 0, None, 0, 45_000), (4, 0, "d", 0, 45_000)], "title_id long, item_no long, clip_id string, in_time long, out_time long")
    info = spark.createDataFrame([("a", 7), ("b", None), ("c", 5), ("c", None)], "clip_id string, source_packets long")
    extents = spark.createDataFrame([("a", 3), ("a", 4), ("b", 9), ("c", 2), ("d", 1)], "clip_id string, sector_count long")
    out = C.build_titles(items, info, extents)
    assert {tuple(r) for r in out.collect()} == {(1, 4.0, 3, 7 * 2048, 2), (2, 2.0, 2, 2 * 2048, 1), (3, 1.0, 1, 0, 0), (4, 1.0, 1, 0, 0)}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_views_of_one_order_share_a_shuffle(spark):
    """Rows are dealt by the key of their order once, as plain columns: a view's groups need no second shuffle, and two views share the first."""
    items, streams = (view(spark, DATA, n) for n in ("play_items", "stn_streams"))
    both = items.groupBy("title_id").agg(F.max("item_no").alias("a"), F.max("out_time").alias("t")).join(streams.groupBy("title_id").agg(F.max("ord").alias("b"), F.max("pid").alias("p")), "title_id", "full")
    plan = items.groupBy("title_id").agg(F.max("item_no"), F.max("out_time"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert both.filter("a + 1 <> b").count() == 0 and both.count() > 0


def test_offsets_of_extents_need_one_shuffle(spark):
    """J8's offsets run over the title that extents are dealt by already."""
    offsets = R.extent_offsets(view(spark, DATA, "extents")).select("title_id", "ord", "byte_offset")
    assert offsets._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
