"""Readers of playlist and clip info files: each file is read in one task by bounds-checked field reads, its tables are columns.

A file that is no such file has an error and empty tables; a table that is cut short ends at its last whole row."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO, AUDIO, SUBTITLE, MENU = 1, 2, 3, 4
#: Where a stream entry has its pid, by the entry's kind.
PID_AT = {1: 2, 2: 4, 3: 3, 4: 3}
ITEM = "item_no long, clip_id string, in_time long, out_time long, connection_condition int"
STREAM = "ord long, pid int, stream_type int, coding_type int, language string, video_format int, video_rate int, audio_format int, audio_rate int, dynamic_range int, color_space int, secondary boolean"
MARK = "mark_no long, mark_type int, play_item_ref int, timestamp_45k long"
CLIP_STREAM = "ord long, pid int, coding_type int, language string, video_format int, video_rate int, audio_format int, audio_rate int"
COARSE = "i long, ref long, pts long, spn long"
FINE = "n long, pts long, spn long"


def _table(fields: str) -> str:
    return "array<struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">>"


PLAYLIST = f"path string, error string, version string, play_items {_table(ITEM)}, streams {_table(STREAM)}, marks {_table(MARK)}"
CLIP_INFO = f"path string, error string, version string, source_packets long, streams {_table(CLIP_STREAM)}, coarse {_table(COARSE)}, fine {_table(FINE)}"


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _halves(byte: int) -> tuple[int, int]:
    return byte >> 4, byte & 15


def _attributes(coding: int, kind: int, held: bytes) -> dict:
    """Formats, rates and language of a stream's attributes, which begin with its coding type."""
    out = dict(language="", video_format=0, video_rate=0, audio_format=0, audio_rate=0, dynamic_range=0, color_space=0)
    if kind == VIDEO:
        if len(held) >= 2:
            out["video_format"], out["video_rate"] = _halves(held[1])
        if coding == 0x24 and len(held) > 2:
            out["dynamic_range"], out["color_space"] = _halves(held[2])
    elif kind == SUBTITLE or kind == AUDIO and coding in (0x90, 0x91):
        out["language"] = _text(held[1:4]) if len(held) >= 4 else ""
    elif kind == AUDIO:
        if len(held) >= 2:
            out["audio_format"], out["audio_rate"] = _halves(held[1])
        out["language"] = _text(held[2:5]) if len(held) >= 5 else ""
    return out


def _stream_entry(item: bytes, at: int, kind: int) -> tuple[dict, int] | None:
    """The stream whose entry begins at `at` and where the next begins; none if the item ends before."""
    if at + 2 > len(item):
        return None
    end = at + 1 + item[at]
    if end + 2 > len(item):
        return None
    place = PID_AT.get(item[at + 1], 0)
    pid = struct.unpack_from(">H", item, at + place)[0] if place and at + place + 2 <= end else 0
    size = item[end]
    if size < 1 or end + 1 + size > len(item):
        return None
    held = item[end + 1 : end + 1 + size]
    return dict(pid=pid, stream_type=kind, coding_type=held[0], secondary=False, **_attributes(held[0], kind, held)), end + 1 + size


def _after_refs(item: bytes, at: int, lists: int) -> int:
    """Where the next entry begins after some lists of references, each a count, a pad and so many bytes made even."""
    for _ in range(lists):
        if at >= len(item):
            break
        at += 2 + item[at] + item[at] % 2
    return at


def _stream_table(item: bytes) -> list[dict]:
    out: list[dict] = []
    start = 32
    if len(item) <= start + 16:
        return out
    at = start + 16
    # kind, type told of a secondary stream, lists of references behind it
    groups = ((VIDEO, 0, 0), (AUDIO, 0, 0), (SUBTITLE, 0, 0), (MENU, 0, 0), (AUDIO, 5, 1), (VIDEO, 6, 2), (SUBTITLE, 3, 1), (VIDEO, 7, 0))
    for (kind, second, lists), count in zip(groups, item[start + 4 : start + 12]):
        for _ in range(count):
            found = _stream_entry(item, at, kind)
            if found is None:
                break
            entry, at = found
            at = _after_refs(item, at, lists)
            if second:
                entry |= dict(stream_type=second, secondary=True)
            if kind != MENU:
                out.append(entry | dict(ord=len(out)))
    return out


def parse_playlist(data: bytes) -> dict:
    bad = dict(error="no playlist", version=None, play_items=[], streams=[], marks=[])
    if len(data) < 40 or data[:4] != b"MPLS":
        return bad
    start, marks_at = struct.unpack_from(">II", data, 8)
    if start + 10 > len(data):
        return bad | dict(error="cut short")
    count, at = struct.unpack_from(">H", data, start + 6)[0], start + 10
    items: list[dict] = []
    streams: list[dict] = []
    for k in range(count):
        if at + 2 > len(data) or at + 2 + (size := struct.unpack_from(">H", data, at)[0]) > len(data):
            break
        item = data[at + 2 : at + 2 + size]
        at += 2 + size
        if size < 20:
            continue
        begin, end = struct.unpack_from(">II", item, 12)
        if k == 0:
            streams = _stream_table(item)
        items.append(dict(item_no=len(items), clip_id=_text(item[:5]), in_time=begin, out_time=end, connection_condition=item[9] & 15))
    marks: list[dict] = []
    if 0 < marks_at and marks_at + 6 <= len(data):
        n = min(struct.unpack_from(">H", data, marks_at + 4)[0], (len(data) - marks_at - 6) // 14)
        for k in range(n):
            kind, item, time = struct.unpack_from(">xBHI", data, marks_at + 6 + 14 * k)
            marks.append(dict(mark_no=k, mark_type=kind, play_item_ref=item, timestamp_45k=time))
    return dict(error=None, version=_text(data[4:8]), play_items=items, streams=streams, marks=marks)


#: Coding types of video, audio and graphics in clip info.
_VIDEO_CODES, _AUDIO_CODES, _GRAPHIC_CODES = {0x02, 0x1B, 0x24}, {*range(0x80, 0x87), 0xA1, 0xA2}, {0x90, 0x91}


def _program_streams(data: bytes) -> list[dict]:
    out: list[dict] = []
    at = 6
    for _ in range(data[5] if len(data) >= 6 else 0):
        if at + 8 > len(data):
            return out
        count, at = data[at + 6], at + 8
        for _ in range(count):
            if at + 3 > len(data):
                return out
            pid, size = struct.unpack_from(">HB", data, at)
            if size < 1 or at + 3 + size > len(data):
                return out
            held = data[at + 3 : at + 3 + size]
            kind = VIDEO if held[0] in _VIDEO_CODES else AUDIO if held[0] in _AUDIO_CODES else SUBTITLE if held[0] in _GRAPHIC_CODES else 0
            found = _attributes(held[0], kind, held)
            out.append(dict(ord=len(out), pid=pid, coding_type=held[0]) | {k: found[k] for k in ("language", "video_format", "video_rate", "audio_format", "audio_rate")})
            at += 3 + size
    return out


def _entry_points(data: bytes) -> tuple[list[dict], list[dict]]:
    """Coarse and fine rows of the first stream of a characteristic point table."""
    size = struct.unpack_from(">I", data, 0)[0]
    table = data[6 : min(size + 4, len(data))]
    if size < 4 or len(table) < 16 or table[1] == 0:
        return [], []
    # ten bytes: 14 bits of kind, 16 of coarse rows, 18 of fine rows, 32 of the place
    packed = int.from_bytes(table[4:14], "big")
    n_coarse, n_fine, place = packed >> 50 & 0xFFFF, packed >> 32 & 0x3FFFF, packed & 0xFFFFFFFF
    stream = table[place:]
    if len(stream) < 4:
        return [], []
    fine_at = struct.unpack_from(">I", stream, 0)[0]
    coarse, fine = [], []
    for k in range(min(n_coarse, (len(stream) - 4) // 8)):
        head, spn = struct.unpack_from(">II", stream, 4 + 8 * k)
        coarse.append(dict(i=k, ref=head >> 14, pts=head & 0x3FFF, spn=spn))
    for k in range(min(n_fine, max(0, len(stream) - fine_at) // 4)):
        word = struct.unpack_from(">I", stream, fine_at + 4 * k)[0]
        fine.append(dict(n=k, pts=word >> 17 & 0x7FF, spn=word & 0x1FFFF))
    return coarse, fine


def parse_clip_info(data: bytes) -> dict:
    if len(data) < 40 or data[:4] != b"HDMV":
        return dict(error="no clip info", version=None, source_packets=None, streams=[], coarse=[], fine=[])
    program, points = struct.unpack_from(">II", data, 12)
    coarse, fine = _entry_points(data[points:]) if 0 < points and points + 8 < len(data) else ([], [])
    return dict(
        error=None, version=_text(data[4:8]), source_packets=struct.unpack_from(">I", data, 56)[0] if len(data) >= 60 else 0,
        streams=_program_streams(data[program:]) if 0 < program and program + 6 < len(data) else [], coarse=coarse, fine=fine,
    )


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ") if " " in c]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [dict(path=p) | parse(bytes(c if c is not None else b"")) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=[n for n in names if n in rows[0]] if rows else ["path"])

    return files.select("path", "content").mapInPandas(work, schema)


def parse_playlists(files: DataFrame) -> DataFrame:
    """S13 on a table of path and content: path, error, version, play_items, streams (of the first item) and marks as arrays."""
    return _parsed(files, parse_playlist, PLAYLIST)


def parse_clip_infos(files: DataFrame) -> DataFrame:
    """S14 on a table of path and content: path, error, version, source_packets, streams and the coarse and fine entry points as arrays."""
    return _parsed(files, parse_clip_info, CLIP_INFO)


def rows_of(parsed: DataFrame, table: str) -> DataFrame:
    """The rows of one of the tables, with their file's path."""
    return parsed.select("path", F.explode(table).alias("_r")).select("path", "_r.*")


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    return parse_playlists(spark.read.format("binaryFile").load(path))


def read_clip_infos(spark: SparkSession, path: str) -> DataFrame:
    return parse_clip_infos(spark.read.format("binaryFile").load(path))
