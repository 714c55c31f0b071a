"""Streams in small batches against the batch operators, and file round trips."""

import pickle
import random
import struct
import zlib

from pyspark.sql import functions as F

from reelspark.operators import dvd as D
from reelspark.operators import frames as O
from reelspark.operators import packets as K
from reelspark.operators import ranges as R
from reelspark.sources import files
from reelspark.sources import playlists as P
from reelspark.streaming import stateful as G

FRAME = "title_id long, track long, idx long, pts_ns long, keyframe boolean, discontinuity boolean"


def streamed(spark, tmp_path, rows, schema, order, make, mode="append", parts=3):
    """Rows of the query after its input came in `parts` files, one a micro-batch."""
    rows = sorted(rows, key=order)
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = make(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def frame_rows(seed):
    rng = random.Random(seed)
    return [(t, i % 2, i, rng.choice([i, i - 200]) * 40_000_000, rng.random() < 0.3, rng.random() < 0.2) for t in range(3) for i in range(60)]


def test_stream_resync_and_timeline(spark, tmp_path):
    rows = frame_rows(1)
    batch = spark.createDataFrame(rows, FRAME)
    got = streamed(spark, tmp_path / "a", rows, FRAME, lambda r: r[2], G.stream_resync)
    want = O.resync_gate(batch, F.col("track") == 0).select("title_id", "track", "idx").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = streamed(spark, tmp_path / "b", rows, FRAME, lambda r: r[2], lambda s: G.stream_timeline(s, F.col("track") == 0))
    want = O.timeline_continuity(batch, F.col("track") == 0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_zones_and_scores(spark, tmp_path):
    rng = random.Random(5)
    schema = "disc_id long, seq long, ok boolean, sense_key int, lba long, sectors int"
    rows = [(d, i, rng.random() < 0.93, 3, i * 32, 32) for d in range(2) for i in range(200)]
    got = streamed(spark, tmp_path / "a", rows, schema, lambda r: r[1], G.stream_damage_zones)
    want = O.damage_zones(spark.createDataFrame(rows, schema)).select("disc_id", "seq", "zone").collect()
    assert sorted((r["disc_id"], r["seq"], r["zone"]) for r in got) == sorted(map(tuple, want))
    schema = "disc_id long, seq long, handler string, elapsed_secs double, recovered_bytes long"
    rows = [(1, i, rng.choice("ab"), float(rng.randrange(3)), rng.randrange(99)) for i in range(40)]
    got = {r["handler"]: r["score"] for r in streamed(spark, tmp_path / "b", rows, schema, lambda r: r[1], G.stream_scores, "update")}
    want = {r["handler"]: r["score"] for r in O.ewma_scores(spark.createDataFrame(rows, schema)).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_stream_beats(spark, tmp_path):
    rows = [(1, "sweep", s * 1_000_000, s) for s in (0, 2, 4, 5, 9, 10, 11, 20)]
    got = streamed(spark, tmp_path, rows, "disc_id long, phase string, at_us long, bytes_done long", lambda r: r[2], G.stream_progress_beats)
    assert sorted(r["bytes_done"] for r in got) == [0, 5, 10, 20]


def test_range_map_round_trip(spark, tmp_path):
    text = "# Rescue map, made up\n# key: not to be read\n0x10 + 1\n0x00000000  0x1000  +\n1000 200 -\n\nshort line\n0x1200 0x0 -\nzz 10 +\n0x2000 0x10 !\n0x7fffffffffffffff 0x10 ?\n"
    (tmp_path / "m.map").write_text(text)
    ranges, errors = files.read_range_map(spark, str(tmp_path / "m.map"))
    assert [(r["pos"], r["size"], r["status"]) for r in ranges.orderBy("n").collect()] == [(0, 4096, "+"), (4096, 512, "-")]
    assert [r["error"] for r in errors.orderBy("n").collect()] == ["size", "number", "status", "overflow"]
    files.write_range_map(ranges.withColumn("disc_id", F.lit(7)), str(tmp_path / "out"))
    again, none = files.read_range_map(spark, str(tmp_path / "out" / "disc_id=7"))
    assert sorted((r["pos"], r["size"], r["status"]) for r in again.collect()) == [(0, 4096, "+"), (4096, 512, "-")] and none.count() == 0


def test_video_index_round_trip(spark, tmp_path):
    rows = [(t, 0, i, i * 10, i % 3 == 0, "I" if i % 3 == 0 else "P", 5, None if i == 1 else i * 3000) for t in range(2) for i in range(4)]
    f = spark.createDataFrame(rows, "title_id long, track long, idx long, pts_ns long, keyframe boolean, ctype string, size long, src_byte long")
    lines = files.video_index_lines(f, F.col("track") == 0)
    (tmp_path / "i.jsonl").write_text('{"format":"x"}\n' + "\n".join(r["line"] for r in lines.filter("title_id = 0").orderBy("n").collect()) + '\n{"format":"y","more":1}\n{"n":1,"pts":1,"type":"I","later":2}\n')
    headers, pictures = files.read_video_index(spark, str(tmp_path / "i.jsonl"))
    assert headers.count() == 2 and pictures.count() == 5
    first = pictures.filter("section = 1").orderBy("line_no").collect()
    assert [r["n"] for r in first] == [0, 1, 2, 3] and first[1]["src"] is None and first[2]["src"]["byte"] == 6000 % 2048
    assert [r["error"] for r in files.validate_video_index(pictures).collect()] == ["n"]
    files.write_video_index(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 8


def test_chapter_texts(spark):
    c = spark.createDataFrame([(1, 1, -1.0, "a & b"), (1, 2, 61.5, "")], "title_id long, n int, time_secs double, name string")
    assert files.export_chapters(c, "vtt").first()["text"] == "WEBVTT\n\n1\n00:00:00.000 --> 00:01:01.500\nChapter a & b\n\n2\n00:01:01.500 --> 00:01:01.500\nChapter \n\n"
    assert files.export_chapters(c, "ogm").first()["text"] == "CHAPTER01=00:00:00.000\nCHAPTER01NAME=a & b\nCHAPTER02=00:01:01.500\nCHAPTER02NAME=2\n"
    xml = files.export_chapters(c, "xml").first()["text"].split("\n")
    assert xml[:5] == ['<?xml version="1.0" encoding="UTF-8"?>', '<!DOCTYPE Chapters SYSTEM "matroskachapters.dtd">', "<Chapters>", "  <EditionEntry>", "    <ChapterAtom>"]
    assert "        <ChapterString>a &amp; b</ChapterString>" in xml and "        <ChapterString>2</ChapterString>" in xml and xml[-4:] == ["    </ChapterAtom>", "  </EditionEntry>", "</Chapters>", ""]


def test_packets_and_wire(spark, tmp_path):
    body = b"".join(bytes([k]) * 192 for k in range(200))
    (tmp_path / "p.bin").write_bytes(body)
    got = files.read_source_packets(spark, str(tmp_path / "p.bin"))
    assert {r["rec_no"]: bytes(r["bytes"]) for r in got.collect()} == {k: bytes([k]) * 192 for k in range(200)}
    head = struct.Struct("<BqBQI")
    (tmp_path / "f.bin").write_bytes(head.pack(1, -5, 1, (1 << 64) - 1, 2) + b"ab" + head.pack(2, 9, 0, 40, 0) + b"cut")
    got = files.read_frame_wire(spark, str(tmp_path / "f.bin")).orderBy("idx").collect()
    assert [(r["track"], r["pts"], r["duration_ns"], r["error"]) for r in got] == [(1, -5, None, None), (2, 9, 40, None), (None, None, None, "truncated header")]
    rows = [(1, 0, 1, -5, True, None, bytearray(b"ab")), (1, 1, 256, 0, False, 3, bytearray(b""))]
    w = files.frame_wire(spark.createDataFrame(rows, "title_id long, idx long, track int, pts long, keyframe boolean, duration_ns long, data binary")).orderBy("idx").collect()
    assert bytes(w[0]["wire"]) == head.pack(1, -5, 1, (1 << 64) - 1, 2) + b"ab" and (w[1]["wire"], w[1]["error"]) == (None, "track")


def entry(kind, pid, held):
    """A stream entry of a kind with its attributes."""
    body = bytes([kind]) + bytes({1: 0, 2: 2, 3: 1, 4: 1}[kind]) + struct.pack(">H", pid) + b"\0\0\0"
    return bytes([len(body)]) + body + bytes([len(held)]) + held


def test_playlist_bytes(spark):
    streams = [entry(1, 0x1011, b"\x24\x81\x12"), entry(1, 0x1100, b"\x83\x61eng"), entry(1, 0x1101, b"\x90fra"), entry(3, 0x1200, b"\x90deu"), entry(1, 0x1400, b"\x91jpn"), entry(2, 0x1A00, b"\xa1\x31spa") + b"\x01\0\x07\0", entry(1, 0x1B00, b"\x1b\x62") + b"\0\0" + b"\x02\0ab", entry(4, 0x1015, b"\x24\x81\x30")]
    counts = bytes([1, 2, 1, 1, 1, 1, 0, 1])
    times = lambda a, b: struct.pack(">II", a, b)
    first = b"00001M2TS" + b"\x01\0\0" + times(90, 45090) + bytes(12) + bytes(4) + counts + bytes(4) + b"".join(streams)
    second = b"00002M2TS" + b"\x05\0\0" + times(7, 8)
    item = lambda x: struct.pack(">H", len(x)) + x
    body = bytes(6) + struct.pack(">HH", 4, 0) + item(first) + item(b"short") + item(second)
    marks = bytes(4) + struct.pack(">H", 9) + struct.pack(">BBHIHI", 0, 1, 1, 55, 0xFFFF, 0) + b"cut"
    data = b"MPLS0200" + struct.pack(">II", 40, 40 + len(body)) + bytes(24) + body + marks
    got = P.parse_playlist(data)
    assert [(i["clip_id"], i["in_time"], i["out_time"], i["connection_condition"]) for i in got["play_items"]] == [("00001", 90, 45090, 1), ("00002", 7, 8, 5)]
    assert [(s["pid"], s["stream_type"], s["coding_type"], s["language"], s["secondary"]) for s in got["streams"]] == [
        (0x1011, 1, 0x24, "", False), (0x1100, 2, 0x83, "eng", False), (0x1101, 2, 0x90, "fra", False), (0x1200, 3, 0x90, "deu", False),
        (0x1A00, 5, 0xA1, "spa", True), (0x1B00, 6, 0x1B, "", True), (0x1015, 7, 0x24, "", True),
    ]
    assert (got["streams"][0]["video_format"], got["streams"][0]["dynamic_range"], got["streams"][0]["color_space"], got["streams"][1]["audio_format"]) == (8, 1, 2, 6)
    assert [(m["mark_type"], m["play_item_ref"], m["timestamp_45k"]) for m in got["marks"]] == [(1, 1, 55)]
    for n in range(0, len(data), 7):
        P.parse_playlist(data[:n])  # nothing that is cut short raises
    table = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"MPLX" + data[4:])), ("c", None), ("d", bytearray(data[:41]))], "path string, content binary")
    read = {r["path"]: (r["error"], len(r["streams"]), len(r["marks"])) for r in P.parse_playlists(table).collect()}
    assert read == {"a": (None, 7, 1), "b": ("no playlist", 0, 0), "c": ("no playlist", 0, 0), "d": ("cut short", 0, 0)}


def test_clip_info_bytes():
    program = bytes(5) + b"\1" + bytes(6) + b"\3\0" + struct.pack(">HB", 0x1011, 2) + b"\x1b\x62" + struct.pack(">HB", 0x1100, 5) + b"\x81\x61eng" + struct.pack(">HB", 0x1200, 4) + b"\x90fra"
    stream = struct.pack(">I", 4 + 16) + struct.pack(">II", 0 << 14 | 5, 1 << 17) + struct.pack(">II", 1 << 14 | 6, 2 << 17) + struct.pack(">III", 3 << 17 | 9, 4 << 17 | 8, 5 << 17 | 7)
    packed = (1 << 66 | 2 << 50 | 3 << 32 | 14).to_bytes(10, "big")
    cpi = b"\0\1" + b"\0\1" + struct.pack(">H", 0x1011) + packed + stream
    data = b"HDMV0200" + bytes(4) + struct.pack(">II", 60, 60 + len(program)) + bytes(36) + struct.pack(">I", 4242) + program + struct.pack(">I", len(cpi)) + cpi
    got = P.parse_clip_info(data)
    assert got["source_packets"] == 4242 and [(s["pid"], s["coding_type"], s["language"]) for s in got["streams"]] == [(0x1011, 0x1B, ""), (0x1100, 0x81, "eng"), (0x1200, 0x90, "fra")]
    assert [(c["ref"], c["pts"], c["spn"]) for c in got["coarse"]] == [(0, 5, 1 << 17), (1, 6, 2 << 17)] and [(f["pts"], f["spn"]) for f in got["fine"]] == [(3, 9), (4, 8), (5, 7)]
    assert P.parse_clip_info(b"HDMX" + data[4:])["error"] and all(P.parse_clip_info(data[:n]) for n in range(0, len(data), 5))


def packet_rows(seed):
    rng, rows, cc = random.Random(seed), [], {1: 0, 2: 0}
    for rec in range(120):
        pid = rng.choice([1, 2])
        cc[pid] = (cc[pid] + (1 if rng.random() < 0.9 else 3)) % 16
        start = rng.random() < 0.3
        body = bytes([rec]) * rng.randrange(1, 6)
        if start:
            body = rng.choice([b"\0\0\1\xe0\0\0\x80\0\0" + body, b"\0\0\1\xe0\0\0\x80\0\4ab", b"bad"])
        rows.append((1, pid, rec, start, cc[pid], rng.random() < 0.03, bytearray(body)))
    return rows


def test_units_in_batch_and_as_a_stream(spark, tmp_path):
    schema = "file_id long, pid long, rec_no long, pusi boolean, cc int, discontinuity_flag boolean, payload binary"
    rows = packet_rows(4)
    key = lambda r: (r["pid"], r["first_rec"], r["discontinuity"], bytes(r["data"]))
    want = sorted(map(key, K.assemble_pes(spark.createDataFrame(rows, schema)).collect()))
    ends = [(1, pid, (1 << 63) - 1, False, 0, False, None) for pid in (1, 2)]
    marked = [(*r, False) for r in rows] + [(*r, False) for r in ends]
    got = streamed(spark, tmp_path, marked, schema + ", marker boolean", lambda r: r[2], lambda s: K.stream_demux(s.withColumn("payload", F.coalesce("payload", F.lit(b"")))))
    # what ends a pid carries no payload and so is no packet of the unit
    assert len(want) > 10 and sorted(map(key, got)) == want
    split = [(1, 1, 0, True, 0, False, bytearray(b"\0\0\1\xe0\0\0\x80\0\4ab")), (1, 1, 1, False, 1, False, bytearray(b"cdXY")), (1, 8191, 2, False, 0, True, None), (1, 1, 3, False, 2, False, bytearray(b"lost")), (1, 1, 4, True, 3, False, bytearray(b"\0\0\1\xbf\0\0OK12"))]
    assert [(r["data"], r["discontinuity"]) for r in K.assemble_pes(spark.createDataFrame(split[:2], schema)).collect()] == [(bytearray(b"XY"), False)]
    assert [(r["data"], r["discontinuity"]) for r in K.assemble_pes(spark.createDataFrame(split, schema)).collect()] == [(bytearray(b"OK12"), True)]


def test_stream_maps_indexes_counts(spark, tmp_path):
    rng = random.Random(6)
    schema = "disc_id long, seq long, pos long, size long, status string"
    rows = [(d, i, rng.randrange(90), rng.randrange(0, 25), rng.choice("+-*/?")) for i in range(40) for d in range(2)]
    changes = streamed(spark, tmp_path / "a", rows, schema, lambda r: r[1], lambda s: G.stream_range_map(s, 20))
    kind = "disc_id long, version long, bin long, pos array<long>, size array<long>, status array<string>"
    want = R.overlay_ranges(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, G.latest_map(spark.createDataFrame(changes, kind)).collect())) == sorted((r["disc_id"], r["pos"], r["size"], r["status"]) for r in want)
    # a small record is a change of its own bins only
    few = streamed(spark, tmp_path / "a2", [(1, 0, 0, 1000, "?"), (1, 1, 30, 20, "+")], schema, lambda r: r[1], lambda s: G.stream_range_map(s, 20), parts=2)
    assert sorted((r["version"], r["bin"]) for r in few) == [(1, b) for b in range(50)] + [(2, 1), (2, 2)]
    frames = [(t, 0, i, i * 10, i % 3 == 0, "I" if i % 3 == 0 else "P", 5, None if i == 1 else i * 3000) for t in range(2) for i in range(7)]
    schema = "title_id long, track long, idx long, pts_ns long, keyframe boolean, ctype string, size long, src_byte long"
    got = streamed(spark, tmp_path / "b", frames, schema, lambda r: r[2], G.stream_video_index)
    want = files.video_index_lines(spark.createDataFrame(frames, schema), F.col("track") == 0).collect()
    assert sorted((r["title_id"], r["n"], r["line"]) for r in got) == sorted(map(tuple, want))
    units = [(1, 0, i, i % 2 == 0, i % 4 == 0, 1) for i in range(12)]
    got = streamed(spark, tmp_path / "c", units, "title_id long, track long, idx long, dropped boolean, verified boolean, duration_ns long", lambda r: r[2], lambda s: G.stream_drop_tally(s, 4), "update")
    assert max((r["kept"], r["dropped"], r["verified"]) for r in got) == (6, 6, 3)
    sets = [(1, 0, True), (1, 0, True), (2, 0, True), (2, 0, False)]
    got = streamed(spark, tmp_path / "d", sets, "title_id long, track long, forced boolean", lambda r: r[0], G.stream_forced, "complete", parts=1)
    assert {r["title_id"]: r["forced"] for r in got} == {1: True, 2: False}
    seen = []
    source = spark.readStream.schema("title_id long, track long, forced boolean").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/d/in")
    G.on_progress(source, lambda df, n: seen.append(df.count()), f"{tmp_path}/progress").awaitTermination(60)
    assert sum(seen) == 4


def test_tracks_count_and_header(spark, tmp_path):
    f = spark.createDataFrame([(1, k % 2, i, "video" if k % 2 == 0 else "audio", 10) for i, k in enumerate(range(6))], "title_id long, track int, idx long, kind string, size long")
    assert files.count_sink(f) == (6, 60)
    files.write_tracks(f, f"{tmp_path}/t", kind="video")
    assert [p.name for p in (tmp_path / "t" / "title_id=1").iterdir()] == ["track=0"]
    text = b'{"v":1,"streams":[{"type":"video","pid":1,"codec":"hevc","more":2}]}'
    cases = {"ok": b"FMKV\0\1\0\0" + struct.pack(">I", len(text)) + text, "new": b"FMKV\0\2\0\0", "cut": b"FMKV\0", "other": b"GIF89a\0\0\0", "short": b"FMKV\0\1\0\0" + struct.pack(">I", 99) + text, "big": b"FMKV\0\1\0\0" + struct.pack(">I", 11 << 20), "bad": b"FMKV\0\1\0\0" + struct.pack(">I", 2) + b"no"}
    got = {r["path"]: (r["header"] and r["header"]["streams"][0]["codec"], r["error"]) for r in files.parse_media_header(spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")).collect()}
    assert got == {"ok": ("hevc", None), "new": (None, "version"), "cut": (None, "truncated"), "other": (None, None), "short": (None, "truncated"), "big": (None, "too long"), "bad": (None, "json")}


def test_audio_remap(spark):
    s = spark.createDataFrame([(1, 0, 0xBD80, 2), (1, 1, 0xBD81, 6), (1, 2, 0xBD82, 2), (2, 0, 0xBD80, 6)], "title_id long, ord long, pid int, channels int")
    p = spark.createDataFrame([(1, 0x80, 6), (1, 0x81, 2), (1, 0x82, 2)], "title_id long, sub_id int, channels int")
    assert [(r["title_id"], r["new_pid"]) for r in D.remap_audio(s, p).orderBy("title_id", "ord").collect()] == [(1, 0xBD81), (1, 0xBD80), (1, 0xBD82), (2, 0xBD80)]


def test_units_match_the_rule_packet_by_packet(spark):
    """Random packets with gaps, markers, starts without header, headers over several packets and units that grow too long."""
    schema = "file_id long, pid long, rec_no long, pusi boolean, cc int, discontinuity_flag boolean, payload binary"
    rng, rows = random.Random(12), []
    for file in range(8):
        cc = {1: 0, 2: 5}
        for rec in range(200):
            pid = rng.choice([1, 1, 2, 2, 2, 8191])
            if pid == 8191:
                rows.append((file, pid, rec, False, 0, rng.random() < 0.05, None))
                continue
            cc[pid] = (cc[pid] + (rng.choice([0] + [1] * 20 + [4]))) % 16
            body = rng.randbytes(rng.randrange(0, 9))
            start = rng.random() < 0.25
            if start:
                body = rng.choice([b"\0\0\1\xe0\0\0\x80\0\0" + body, b"\0\0\1\xe0\0\0\x80\0\x09ab", b"bad", b"", b"\0\0\1\xbe\0\0" + body])
            rows.append((file, pid, rec, start, cc[pid], rng.random() < 0.03, None if rng.random() < 0.03 else bytearray(body)))
    packets = spark.createDataFrame(rows, schema)
    for most in (12, 1 << 20):
        want, held = [], {}
        order = ("marker", "pusi", "cc", "flagged", "payload", "pts", "dts", "header")
        for r in sorted(K._rows(packets).collect(), key=lambda r: (r["file_id"], r["pid"], r["rec_no"])):
            one = held.setdefault((r["file_id"], r["pid"]), K.Assembler(most=most))
            values = {c: r[c] for c in order} | {"payload": bytes(r["payload"] or b"")}
            done = one.take(r["rec_no"], *(values[c] for c in order))
            want += [(r["file_id"], r["pid"], *done)] if done else []
        want += [(*key, *done) for key, one in held.items() if (done := one.close())]
        got = [(*(r[c] for c in ("file_id", "pid", "first_rec", "pts", "dts", "discontinuity")), bytes(r["data"])) for r in K.assemble_pes(packets, most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 60
        assert {r[5] for r in want} == {True, False}


def test_late_rows_wait_for_the_watermark(spark, tmp_path):
    """Shuffled batches give what the rows in order give; a row beyond the watermark is dropped, and a key that has ended begins anew."""
    from datetime import datetime, timedelta, timezone

    rng = random.Random(3)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(t, i % 2, i, rng.choice([i, i - 200]) * 40_000_000, rng.random() < 0.3, rng.random() < 0.2, start + timedelta(seconds=i)) for t in range(2) for i in range(40)]
    schema = FRAME + ", ts timestamp"
    late = G.Late("ts", "30 seconds", 60_000)
    # rows come up to 20 s late; the last only moves the watermark on
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(20)) + [(9, 0, 0, 0, True, False, start + timedelta(seconds=500))]
    place = {r: k for k, r in enumerate(shuffled)}
    batch = spark.createDataFrame(rows, schema)
    got = [r for r in streamed(spark, tmp_path / "a", shuffled, schema, lambda r: place[r], lambda s: G.stream_resync(s, late=late), parts=5) if r["title_id"] < 9]
    want = O.resync_gate(batch, F.col("track") == 0).select("title_id", "track", "idx").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = [r for r in streamed(spark, tmp_path / "b", shuffled, schema, lambda r: place[r], lambda s: G.stream_timeline(s, F.col("track") == 0, late=late), parts=5) if r["title_id"] < 9]
    assert sorted(map(tuple, got)) == sorted(map(tuple, O.timeline_continuity(batch, F.col("track") == 0).collect()))
    # zones count on over batches until the state has ended
    log = "disc_id long, seq long, ok boolean, sense_key int, ts timestamp"
    at = lambda s: start + timedelta(seconds=s)
    reads = [(1, 0, False, 3, at(0)), (1, 20, False, 3, at(20)), (8, 0, True, 3, at(60)), (1, 30, False, 3, at(75)), (8, 1, True, 3, at(300)), (8, 2, True, 3, at(301)), (1, 50, False, 3, at(320)), (8, 3, True, 3, at(700)), (8, 4, True, 3, at(701))]
    order = {r: k for k, r in enumerate(reads)}
    got = streamed(spark, tmp_path / "c", reads, log, lambda r: order[r], lambda s: G.stream_damage_zones(s, late=late), parts=9)
    assert sorted((r["seq"], r["zone"], r["opens"]) for r in got) == [(0, 1, True), (20, 1, False), (30, 1, False), (50, 1, True)]


def test_stream_state_is_kept_by_buckets_of_keys(spark, tmp_path):
    """Many keys cost a call a bucket; every key keeps a state of its own over batches, null keys too."""
    from reelspark.streaming import ordered

    had, ordered.BUCKETS = ordered.BUCKETS, 3
    try:
        schema = "disc_id long, seq long, elapsed_secs double, recovered_bytes long, handler string"
        rows = [(d, i, 1.0, d * 100 + i, None if d == 3 else "h") for i in range(4) for d in range(40)]
        got = streamed(spark, tmp_path / "k", rows, schema, lambda r: r[1], G.stream_scores, mode="update")
    finally:
        ordered.BUCKETS = had
    last = {}
    for r in got:
        last.setdefault(r["disc_id"], []).append(r["score"])
    want = lambda d: ((d * 100 * 0.5 + (d * 100 + 1) * 0.5) * 0.5 + (d * 100 + 2) * 0.5) * 0.5 + (d * 100 + 3) * 0.5
    assert len(last) == 40 and all(max(v) == want(d) for d, v in last.items())


def test_stream_state_is_small_and_not_in_the_heap(spark, tmp_path):
    """States lie in the store on disk, with one memory of a fixed size an executor; ranges of a map take a few bytes each."""
    from reelspark.streaming import ordered

    schema = "disc_id long, seq long, pos long, size long, status string"
    rows = [(1, i, i * 4096, 2048, "+-"[i % 2]) for i in range(3000)]
    had, ordered.BUCKETS = ordered.BUCKETS, 1
    try:
        streamed(spark, tmp_path, rows, schema, lambda r: r[1], lambda s: G.stream_range_map(s, 1 << 16), parts=2)
    finally:
        ordered.BUCKETS = had
    assert spark.conf.get(ordered.STORE) == ordered.ROCKS and spark.conf.get(ordered.BOUNDED) == "true"
    # the store of a version is an archive and not a list of changes
    assert list((tmp_path / "check" / "state").rglob("*.zip")) and not list((tmp_path / "check" / "state").rglob("*.delta"))
    ranges = [(p, p + n, s) for _, _, p, n, s in rows]
    state = G.packed(ranges)
    assert G.unpacked(state) == ranges and G.unpacked(G.packed([])) == [] and len(zlib.compress(pickle.dumps(state), 1)) < 2 * len(rows)
