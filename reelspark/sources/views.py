"""Views that give the driver's tables the shapes of disc data: range logs, titles, extents, streams, frames, read logs.

Each view is one SQL text for both engines; `{name}` names another view or table. Clip infos of fewer than 6,000 packets count as not parsed, and clip infos
do not list streams without a language, so that both sides of joins have rows that the other lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
#: Microseconds of events.ts, by engine.
MICROS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)"}

#: A whole number in base 36, by engine: the function and what follows its first argument.
BASE_36 = {"spark": ("conv", "10, 36"), "duckdb": ("to_base", "36")}


def _clip(part: str) -> str:
    """A clip's name of five characters: the number's digits, from 100,000 on a letter and base 36, which lasts for 43 million clips."""
    return f"CASE WHEN {part} < 100000 THEN lpad(CAST({part} AS VARCHAR(5)), 5, '0') ELSE {{TO36}}({part} + {10 * 36**4 - 100_000}, {{IN36}}) END"


_ORD = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT)"
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "range_log": (
        ("lineitem",),
        """SELECT l_suppkey AS disc_id,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS BIGINT) AS seq,
  l_partkey * 8192 AS pos, CAST(l_quantity AS BIGINT) * 2048 AS size,
  CASE WHEN l_returnflag = 'A' THEN '+' WHEN l_returnflag = 'R' THEN '-' WHEN l_linestatus = 'F' THEN '*' ELSE '/' END AS status
FROM {lineitem}""",
    ),
    "discs": (("supplier",), "SELECT s_suppkey AS disc_id, 1000000 + s_suppkey * 500000 AS capacity_sectors FROM {supplier}"),
    "extents": (
        ("lineitem", "supplier"),
        f"""SELECT l_orderkey AS title_id, l_orderkey % (SELECT count(*) FROM {{supplier}}) AS disc_id, {_ORD} AS ord,
  l_partkey * 4 AS start_lba, CAST(l_quantity AS BIGINT) AS sector_count FROM {{lineitem}}""",
    ),
    "titles": (
        ("orders", "supplier", "extents"),
        """SELECT o.o_orderkey AS title_id, o.o_orderkey % (SELECT count(*) FROM {supplier}) AS disc_id,
  concat(lpad(CAST(o.o_orderkey % 1000 AS VARCHAR(5)), 5, '0'), '.mpls') AS playlist,
  o.o_totalprice / 50.0 AS duration_secs, coalesce(x.sectors, 0) * 2048 AS size_bytes
FROM {orders} o LEFT JOIN (SELECT title_id, CAST(sum(sector_count) AS BIGINT) AS sectors FROM {extents} GROUP BY title_id) x ON x.title_id = o.o_orderkey""",
    ),
    "play_items": (
        ("lineitem",),
        f"""SELECT l_orderkey AS title_id, {_ORD} - 1 AS item_no, {_clip("l_partkey")} AS clip_id,
  l_suppkey * 45000 AS in_time, l_suppkey * 45000 + CAST(l_quantity AS BIGINT) * 90000 AS out_time FROM {{lineitem}}""",
    ),
    "marks": (
        ("play_items",),
        """SELECT title_id, item_no AS mark_no, item_no % 3 AS mark_type, item_no AS play_item_ref, in_time + 45000 * (item_no + 1) AS timestamp_45k FROM {play_items}""",
    ),
    "clip_info": (("part",), f"SELECT {_clip('p_partkey')} AS clip_id, CAST(p_size AS BIGINT) * 1000 AS source_packets, p_partkey AS part_no FROM {{part}} WHERE p_size >= 6"),
    "clip_extents": (("clip_info",), "SELECT clip_id, CAST(0 AS BIGINT) AS ord, part_no * 64 AS start_lba, source_packets * 192 // 2048 AS sector_count FROM {clip_info}"),
    "stn_streams": (
        ("lineitem",),
        f"""SELECT l_orderkey AS title_id, {_ORD} AS ord, 4096 + l_partkey % 64 AS pid, 1 + l_partkey % 7 AS stream_type,
  CASE l_partkey % 8 WHEN 0 THEN 36 WHEN 1 THEN 27 WHEN 2 THEN 131 WHEN 3 THEN 134 WHEN 4 THEN 129 WHEN 5 THEN 132 WHEN 6 THEN 144 ELSE 0 END AS coding_type,
  CASE l_suppkey % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'fra' WHEN 2 THEN 'deu' ELSE '' END AS language,
  1 + l_partkey % 8 AS video_format, 1 + l_suppkey % 8 AS video_rate,
  CASE l_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 12 ELSE 9 END AS audio_format FROM {{lineitem}}""",
    ),
    "clip_streams": (("stn_streams",), "SELECT title_id, ord, pid + ord % 2 AS pid, CASE WHEN ord % 5 = 0 THEN 129 ELSE coding_type END AS coding_type, language FROM {stn_streams} WHERE language <> ''"),
    "frames": (
        ("events",),
        """SELECT user_id AS title_id, event_id % 3 AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) - 1 AS idx,
  ({US} % 3600000000) * 1000 AS pts_ns, event_type = 'view' AS keyframe, event_type = 'error' AS discontinuity,
  CASE event_type WHEN 'view' THEN 'I' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'B' ELSE 'P' END AS ctype,
  CAST(floor(value * 100) AS BIGINT) AS size, event_id * 2048 + event_id % 2048 AS src_byte FROM {events}""",
    ),
    "read_log": (
        ("events",),
        """SELECT user_id AS disc_id, event_id AS seq, ts, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN event_id % 12 END AS sense_key,
  event_id * 32 AS lba, 32 AS sectors FROM {events}""",
    ),
    "ts_packets": (
        ("events",),
        """SELECT user_id AS file_id, 4113 + event_id % 2 AS pid, event_id AS rec_no, event_type IN ('view', 'signup') AS pusi,
  CAST(floor(value) AS BIGINT) % 16 AS cc, event_type = 'error' AS discontinuity_flag FROM {events}""",
    ),
    "ep_map": (("events",), "SELECT user_id AS clip_no, event_id * 9000 AS pts, event_id * 50 AS spn FROM {events}"),
    "label_text": (
        ("documents",),
        """SELECT doc_id, concat(CASE doc_id % 9 WHEN 0 THEN 'English SDH' WHEN 1 THEN 'Brazilian Portuguese 5.1' WHEN 2 THEN 'Director commentary'
  WHEN 3 THEN 'Audio Description' WHEN 4 THEN 'Forced Narrative' WHEN 5 THEN 'Music Only' WHEN 6 THEN 'Englishman' WHEN 7 THEN 'captions, French' ELSE 'Commenter Pro' END,
  ' (', source, ')') AS text FROM {documents}""",
    ),
    "labels_src": (
        ("documents",),
        """SELECT doc_id % 40 AS disc_id, source AS source_name, CAST(length(source) % 3 AS INT) AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'audio' ELSE 'subtitle' END AS stream_type,
  1 + doc_id % 8 AS stream_number, lang AS language, doc_id FROM {documents}""",
    ),
    "attempts": (
        ("events",),
        """SELECT user_id AS disc_id, event_id AS seq, event_type AS handler, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 + event_id % 5 END AS DOUBLE) AS elapsed_secs,
  (event_id % 11) * 2048 AS recovered_bytes FROM {events}""",
    ),
    "cells": (
        ("lineitem",),
        f"""SELECT l_orderkey AS title_id, {_ORD} AS ord, l_partkey * 4 AS first_sector, l_partkey * 4 + CAST(l_quantity AS BIGINT) AS last_sector,
  CAST(CASE WHEN l_linenumber <= 2 THEN l_suppkey % 3 ELSE 0 END AS BIGINT) AS block_mode, CAST(l_quantity AS BIGINT) AS duration_secs FROM {{lineitem}}""",
    ),
}


def _for(sql: str, engine: str) -> str:
    base = BASE_36[engine]
    return sql.replace("{US}", MICROS[engine]).replace("{TO36}", base[0]).replace("{IN36}", base[1])


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view. A row's place in its order is a column of lineitem before a view names and computes its own columns: Spark would compute them below the window and shuffle them too, and
    would not know that title_id is the key that rows are dealt by already. So a view's rows are shuffled once, as plain columns, and views of a query share that shuffle."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = VIEWS[name]
    inputs = {n: spark_view(spark, sf_dir, n) for n in needs}
    if _ORD in sql:
        sql = sql.replace(_ORD, "_ord")
        inputs["lineitem"] = spark.sql(f"SELECT *, {_ORD} AS _ord FROM {{lineitem}}", lineitem=inputs["lineitem"])
    return spark.sql(_for(sql, "spark").replace(" // ", " DIV "), **inputs)


def with_views(*names: str) -> str:
    """The WITH clause that defines the views, for DuckDB."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        for n in VIEWS[name][0]:
            add(n)
        done.append(name)

    for n in names:
        add(n)
    parts = []
    for n in done:
        sql = _for(VIEWS[n][1], "duckdb")
        for need in VIEWS[n][0]:
            sql = sql.replace("{" + need + "}", need)
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ",\n".join(parts)
