"""Readers of files in ranges and splits against plain readers of the whole, and writers of one file a key."""

import random
import struct
from unittest import mock

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reelspark.sources import files, records, tables, wire

HEAD = struct.Struct("<BqBQI")


def test_source_packets_of_a_folder(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "x" / "sub").mkdir(parents=True)
    sizes = {"a.bin": 192 * 1000 + 5, "sub/b.bin": 192 * 3, "c.bin": 0, "_hidden": 192, "d.bin": 7}
    for name, size in sizes.items():
        (tmp_path / "x" / name).write_bytes(rng.randbytes(size))
    got = {}
    for r in files.read_source_packets(spark, str(tmp_path / "x"), range_bytes=192 * 300).collect():
        got.setdefault(r["file"], []).append((r["rec_no"], bytes(r["bytes"]), r["error"]))
    assert set(got) == {str(tmp_path / "x" / n) for n in ("a.bin", "sub/b.bin", "d.bin")}
    for file, rows in got.items():
        data = open(file, "rb").read()
        assert sorted(rows) == [(k, data[k * 192 : k * 192 + 192], None if k * 192 + 192 <= len(data) else "part") for k in range(-(-len(data) // 192))]
    assert records.read_records(spark, f"file:{tmp_path}/x/a.bin", 192, 192 * 300).rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="nothing-here"):
        files.read_source_packets(spark, str(tmp_path / "nothing-here")).count()


def wire_bytes(rng, n, tail=b""):
    out = b""
    for _ in range(n):
        size = rng.choice([0, 1, 30, 400, 5000]) if rng.random() < 0.98 else 40_000
        # data that looks like heads of frames
        data = HEAD.pack(1, rng.randrange(99), 1, 5, rng.choice([0, 3, 50])) * (size // HEAD.size) + bytes(size % HEAD.size) if rng.random() < 0.3 else rng.randbytes(size)
        out += HEAD.pack(rng.randrange(256), rng.randrange(-(1 << 40), 1 << 40), rng.choice([0, 1, 1, 7]), rng.choice([(1 << 64) - 1, 40]), len(data)) + data
    return out + tail


@pytest.mark.parametrize("range_bytes", [1000, 20_000, 1 << 20])
def test_wire_in_ranges_equals_the_whole(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    tails = {"whole": b"", "head": b"\1\2\3", "data": HEAD.pack(1, 2, 1, 3, 50) + b"cut", "long": HEAD.pack(1, 2, 1, 3, 1 << 20) + bytes(5000), "none": None}
    for name, tail in tails.items():
        (tmp_path / f"{name}.wire").write_bytes(b"" if tail is None else wire_bytes(rng, 120, tail))
    rows = lambda df: sorted((r["file"].rsplit("/", 1)[-1], r["idx"], r["track"], r["pts"], r["keyframe"], r["duration_ns"], bytes(r["data"]) if r["data"] is not None else b"-", r["error"]) for r in df.collect())
    got = rows(files.read_frame_wire(spark, str(tmp_path), 1 << 19, range_bytes))
    table = spark.createDataFrame([(f"{n}.wire", bytearray((tmp_path / f"{n}.wire").read_bytes())) for n in tails], "path string, content binary")
    assert got == rows(files.parse_frame_wire(table, 1 << 19))
    assert {r[7] for r in got} == {None, "truncated header", "truncated data", "too long"}


def test_wrong_guesses_are_mended(spark, tmp_path):
    """A frame over many ranges whose data is itself a chain of frames, so that every range inside it guesses wrong."""
    inner = b"".join(HEAD.pack(1, 5, 1, 7, 20) + bytes(20) for _ in range(500))
    (tmp_path / "f.wire").write_bytes(HEAD.pack(2, 1, 0, 9, len(inner)) + inner + HEAD.pack(3, 2, 1, 9, 2) + b"ok")
    got = files.read_frame_wire(spark, str(tmp_path), 1 << 20, 900).orderBy("idx").collect()
    assert [(r["idx"], r["track"], len(r["data"]), r["error"]) for r in got] == [(0, 2, len(inner), None), (1, 3, 2, None)]
    assert wire.wire_ranges(spark, str(tmp_path), 1 << 20, 900).filter("frames > 0").count() == 2


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(4)
    texts = {}
    for name in ("a", "b", "c"):
        lines = [rng.choice(["", "x", "é" * 40, '{"n":1}', "# h", "long " * 60]) for _ in range(300)]
        texts[name] = "\n".join(lines) + rng.choice(["", "\n"])
        (tmp_path / f"{name}.txt").write_text(texts[name])
    counted = F.col("line").startswith("#")
    rows = files._lines(spark, str(tmp_path), counted)
    assert rows.select("file", F.lit(1)).rdd.getNumPartitions() > 1
    got = {}
    for r in rows.collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1][0], []).append((r["n"], r["line"], r["counted"]))
    for name, text in texts.items():
        want, seen = [], 0
        for n, line in enumerate(text.split("\n")[: -1 if text.endswith("\n") else None]):
            seen += line.startswith("#")
            want.append((n, line, seen))
        assert sorted(got[name]) == want


def test_index_sections_across_splits(spark, tmp_path, small_splits):
    lines = []
    for section in range(6):
        lines.append(f'{{"format":"x","section":{section}}}')
        lines += [f'{{"n":{k},"pts":{k * 10},"dts":{k},"type":"I","key":true,"size":{section}}}' for k in range(40)]
    (tmp_path / "i.jsonl").write_text("\r\n".join(lines) + "\r\n\r\n")
    headers, pictures = files.read_video_index(spark, str(tmp_path / "i.jsonl"))
    assert sorted(r["section"] for r in headers.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted((r["section"] - 1, r["n"], r["line_no"]) for r in pictures.collect()) == [(s, k, s * 41 + 1 + k) for s in range(6) for k in range(40)]
    assert {r["size"] + 1 for r in pictures.filter("section = 3").collect()} == {3}
    assert files.validate_video_index(pictures).count() == 0


def test_one_file_a_key_in_order(spark, tmp_path, small_splits):
    rng = random.Random(9)
    rows = [(d, p * 512, 512, rng.choice("+-*/?")) for d in range(5) for p in range(400)]
    rng.shuffle(rows)
    files.write_range_map(spark.createDataFrame(rows, "disc_id long, pos long, size long, status string"), str(tmp_path / "maps"))
    assert sorted(p.name for p in (tmp_path / "maps").iterdir()) == [f"disc_id={d}" for d in range(5)]
    text = (tmp_path / "maps" / "disc_id=3" / "map.txt").read_text().split("\n")
    assert text[:3] == ["# Rescue map", "# pos  size  status", "0x000000000  0x000000200    " + next(r[3] for r in rows if r[:2] == (3, 0))] and len(text) == 403
    ranges, errors = files.read_range_map(spark, str(tmp_path / "maps"))
    disc = F.regexp_extract("file", r"disc_id=(\d+)", 1).cast("long").alias("disc_id")
    assert sorted(map(tuple, ranges.select(disc, "pos", "size", "status").collect())) == sorted(rows) and errors.count() == 0
    records.write_keyed(spark.createDataFrame([], "k long, n long, line string"), str(tmp_path / "none"), "k", ["n"], "line", "f")


def test_many_small_ranges_share_a_task(spark, tmp_path):
    """Tasks are not as many as ranges or files; a file is cut where the next task's ranges begin."""
    for k in range(60):
        (tmp_path / f"{k:02d}.bin").write_bytes(bytes([k]) * (192 * k + k % 3))
    got = records.read_records(spark, str(tmp_path), 192, 192 * 2)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    want = sorted((f"{k:02d}.bin", n, 192 if n < k else k % 3, "part" if n == k else None) for k in range(60) for n in range(k + (k % 3 > 0)))
    rows = [(r["file"][-6:], r["rec_no"], len(r["bytes"]), r["error"]) for r in got.collect()]
    assert sorted(rows, key=lambda r: r[:2]) == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metadata_is_parsed_once_a_file(spark):
    text = '<d:a xmlns:d="u"><d:title> <d:name> </d:name></d:title><d:name>n1</d:name><d:title>t</d:title><d:description>&lt;p</d:description><d:setNumber> 2</d:setNumber><d:numSets>x</d:numSets></d:a>'
    rows = [("1/bdmt_eng.xml", text), ("2/bdmt_FRA.xml", "<a><tableOfContents><titleName>é</titleName></tableOfContents><description> d </description></a>"), ("3/other.xml", text)]
    got = files.disc_metadata(spark.createDataFrame(rows, "path string, content string"))
    assert sorted(map(tuple, got.collect())) == [("1/bdmt_eng.xml", "eng", None, None, 2, None), ("2/bdmt_FRA.xml", "fra", "é", "d", None, None)]
    assert plan_of(got).count("XPathStringEvaluator") == 1


def test_lines_without_numbers_are_not_shuffled(spark, tmp_path):
    (tmp_path / "m.map").write_text("0x1 0x2 +\nzz 1 -\n")
    for rows in files.read_range_map(spark, str(tmp_path)):
        assert "Join" in plan_of(rows) and "Join" not in plan_of(rows.drop("n"))


def test_files_are_dealt_to_tasks_by_number(spark, tmp_path):
    """Few bytes of many keys are written by as many tasks as there are partitions of a shuffle, not by one."""
    assert records.file_tasks(spark) == 4
    rows = spark.range(400).selectExpr("id AS title_id", "0 AS track", "id AS idx")
    files.write_tracks(rows, str(tmp_path / "t"))
    names = [p.name for p in (tmp_path / "t").rglob("*.parquet")]
    assert len(names) == 400 and len({n.split("-")[1] for n in names}) == 4


def test_lines_of_maps_are_split_once(spark, tmp_path):
    """Each line is split and converted once, whatever is asked of it; odd lines are told as before."""
    lines = ["0x1 0x2 +", "zz 1 -", "# c", "0x0 +", "1 0 *", "10 20 !", "7fffffffffffffff 1 -", "7ffffffffffffffe 1 -", "0 ffffffffffffffff ?", "\t1 2 3", "0x5 + 9", "0x5 9 /\r", "fffffffffffffffff 1 +", "ffffffffffffffff 0 +", ""]
    (tmp_path / "m.map").write_text("\n".join(lines))
    ranges, errors = files.read_range_map(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in ranges.collect()) == [(0, 1, 2, "+"), (7, (1 << 63) - 2, 1, "-"), (11, 5, 9, "/")]
    wrong = {1: "number", 4: "size", 5: "status", 6: "overflow", 8: "overflow", 9: "number", 12: "number", 13: "size"}
    assert sorted(tuple(r)[1:] for r in errors.collect()) == [(n, lines[n], e) for n, e in wrong.items()]
    for rows in (ranges, errors):
        assert plan_of(rows).count("split(") == 1 and plan_of(rows).count("conv(") == 2


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(90):
        (tmp_path / "m" / f"disc_id={k}").mkdir(parents=True)
        (tmp_path / "m" / f"disc_id={k}" / "map.txt").write_text("1 2 +\n")
    before = spark.conf.get(tables.LISTING)
    group = f"listing-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, "listing")
    try:
        files.read_range_map(spark, str(tmp_path / "m"))
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds]
        assert [k.numTasks for k in stages] == [4 * spark.sparkContext.defaultParallelism]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(tables.LISTING) == before


def test_folders_equal_those_of_spark(spark, tmp_path):
    """Keys that are null, empty or hold signs that no folder's name has; several row groups and tasks; rows in order; nothing else is left."""
    rows = [(key, k % 3, k, None if k % 7 == 0 else f"v{k}", k % 2 == 0, [k], bytes([k % 256])) for key in ("a", None, "", "x=1/y", "50%") for k in range(300)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, track int, idx long, v string, b boolean, l array<long>, d binary")
    records.write_folders(df, str(tmp_path / "ours"), ["key", "track"], ["idx"])
    df.write.partitionBy("key", "track").parquet(str(tmp_path / "theirs"))
    read = lambda name: sorted(map(str, spark.read.parquet(str(tmp_path / name)).select(df.columns).collect()))
    assert read("ours") == read("theirs") and len(read("ours")) == 1500
    names = lambda name: {p.relative_to(tmp_path / name).as_posix() for p in (tmp_path / name).rglob("*") if p.is_dir()}
    assert names("ours") == names("theirs") and (tmp_path / "ours" / "_SUCCESS").exists()
    one = spark.read.parquet(str(tmp_path / "ours" / "key=50%25" / "track=1"))
    assert [r["idx"] for r in one.collect()] == list(range(1, 300, 3))
    with pytest.raises(FileExistsError):
        records.write_folders(df, str(tmp_path / "ours"), ["key", "track"], ["idx"])


def test_long_folders_have_several_row_groups(spark, tmp_path):
    writer = records.FolderWriter({"path": str(tmp_path / "t"), "keys": "title_id"})
    batches = [pa.RecordBatch.from_arrays([pa.array(["1"] * 50 + ["2"] * 50), pa.array(range(k * 100, k * 100 + 100))], names=["_key0", "idx"]) for k in (0,)]
    batches += [pa.RecordBatch.from_arrays([pa.array(["2"] * 100), pa.array(range(k * 100, k * 100 + 100))], names=["_key0", "idx"]) for k in (1, 2)]
    before, records.GROUP_ROWS = records.GROUP_ROWS, 120
    try:
        context = mock.Mock(partitionId=lambda: 7)
        with mock.patch.object(records.TaskContext, "get", return_value=context):
            writer.commit([writer.write(iter(batches))])
    finally:
        records.GROUP_ROWS = before
    found = {p.parent.name: p for p in (tmp_path / "t").rglob("part-00007-*.parquet")}
    assert sorted(found) == ["title_id=1", "title_id=2"] and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["_SUCCESS", "title_id=1", "title_id=2"]
    long = pq.ParquetFile(found["title_id=2"])
    assert long.num_row_groups == 2 and long.read()["idx"].to_pylist() == list(range(50, 300))
