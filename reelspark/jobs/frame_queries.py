"""Queries of the frame, packet and read-log operators over the views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import frames as O
from reelspark.sources.views import spark_view as view
from reelspark.sources.views import with_views

FR, LG, PK = with_views("frames"), with_views("read_log"), with_views("ts_packets")


def video():
    return F.col("track") == O.VIDEO


def frames(s, d):
    return view(s, d, "frames")


def log(s, d):
    return view(s, d, "read_log")


def units(s, d):
    return frames(s, d).select("title_id", "track", "idx", (F.col("ctype") != "I").alias("dropped"), (F.col("size") % 4 != 0).alias("verified"), (F.col("size") - 500).alias("duration_ns"))


def display_sets(s, d):
    return frames(s, d).select("title_id", "track", "idx", F.when(F.col("size") % 5 != 0, F.col("pts_ns")).alias("pts_ns"), (F.col("ctype") == "P").alias("is_clear"))


def seek(s, d):
    f = frames(s, d)
    return O.seek_picture(f.filter(~F.col("keyframe")).select("title_id", (F.col("pts_ns") + 5).alias("t_ns")), f)


def j3(s, d):
    ep = view(s, d, "ep_map")
    g = ep.groupBy("clip_no").agg(F.min("pts").alias("lo"), F.max("pts").alias("hi"))
    clips = g.withColumn("ord", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).select("clip_no", "ord", (F.col("lo") + F.col("ord") * 1000 - 500).alias("in_pts"), (F.col("hi") - F.col("ord") * 90000 + 400).alias("out_pts"))
    return O.clip_time_extents(clips, ep)


def j4(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    w = O.W.partitionBy("user_id").orderBy("event_id")
    fine = e.select(F.col("user_id").alias("clip_no"), (F.row_number().over(w) - 1).cast("long").alias("n"), (F.col("event_id") % 2048).alias("pts"), (F.col("event_id") % 131072).alias("spn"))
    coarse = fine.filter("n % 8 = 0").select("clip_no", F.floor(F.col("n") / 8).alias("i"), F.col("n").alias("ref"), (F.floor(F.col("n") / 8) + 1).alias("pts"), (F.floor(F.col("n") / 8) * 200000).alias("spn"))
    return O.resolve_ep_map(coarse, fine)


def f21(s, d):
    v = F.col("seq")
    status = F.element_at(F.array(*map(F.lit, (2, 2, 255, 8, 2))), (v % 5 + 1).cast("int"))
    action = O.read_action(status, F.col("sense_key"), v % 7, v % 4, v % 18, v % 3, v % 2 == 0, v % 11 < 6)
    return log(s, d).filter("NOT ok").select("disc_id", "seq", action.alias("action"))


def pass_log(s, d):
    """The read log with the drive's status and reads inside bisections."""
    v = F.col("seq")
    return log(s, d).withColumn("status", F.when(v % 31 == 7, 255).when(v % 3 == 1, 8).otherwise(2)).withColumn("bisecting", v % 5 == 0)


def decisions(patch):
    return lambda s, d: O.read_decisions(pass_log(s, d), patch).select("disc_id", "seq", "action", "jump_sectors", F.col("rest_secs").cast("long").alias("rest_secs"), F.col("window_reads").cast("long").alias("window_reads"), F.col("bad_percent").cast("long").alias("bad_percent"), "opens_zone")


QUERIES = {
    "f21_read_action": f21,
    "f21_sweep_decisions": decisions(False),
    "f21_patch_decisions": decisions(True),
    "p6_picture_type": lambda s, d: O.picture_type(frames(s, d)),
    "p10_keyframe_start_gate": lambda s, d: O.keyframe_start_gate(frames(s, d), video()).select("title_id", "track", "idx"),
    "w7_resync_gate": lambda s, d: O.resync_gate(frames(s, d), video()).select("title_id", "track", "idx"),
    "w8_gop_groups": lambda s, d: O.gop_groups(frames(s, d), 4, 30_000).select("title_id", "track", "idx", "gop", "part"),
    "w9_display_index": lambda s, d: O.display_index(frames(s, d)),
    "w11_monotonic_ts": lambda s, d: O.monotonic_ts(frames(s, d), video()).select("title_id", "track", "idx", "ts"),
    "w12_timeline_continuity": lambda s, d: O.timeline_continuity(frames(s, d), video()),
    "w10_rebuild_pts": lambda s, d: O.rebuild_pts(frames(s, d), F.when(F.col("size") % 3 == 0, F.col("pts_ns"))),
    "w17_poison_point": lambda s, d: O.poison_point(units(s, d), 5),
    "w18_display_durations": lambda s, d: O.display_durations(display_sets(s, d)).select("title_id", "track", "idx", "duration_ns"),
    "w19_sample_durations": lambda s, d: O.sample_durations(frames(s, d)).select("title_id", "track", "idx", "sample_duration"),
    "w20_run_length": lambda s, d: O.run_length(frames(s, d), ["title_id", "track"], "idx", "ctype"),
    "w21_composition_offsets": lambda s, d: O.composition_offsets(frames(s, d)).select("title_id", "track", "idx", "offset"),
    "w22_cluster_frames": lambda s, d: O.cluster_frames(frames(s, d), video()),
    "w23_audio_delays": lambda s, d: O.audio_delays(frames(s, d), F.col("track") != 0, video()),
    "w30_rebase_to_first_video": lambda s, d: O.rebase_to_first_video(frames(s, d), video()).select("title_id", "track", "idx", "ts"),
    "a4_track_bitrate": lambda s, d: O.track_bitrate(frames(s, d), view(s, d, "titles").filter("duration_secs > 3000"), video()),
    "a7_drop_tally": lambda s, d: O.drop_tally(units(s, d)),
    "a11_detect_rate": lambda s, d: O.detect_rate(frames(s, d)),
    "j3_clip_time_extents": j3,
    "j4_resolve_ep_map": j4,
    "j17_seek_picture": seek,
    "t3_display_order": lambda s, d: O.display_order(frames(s, d)).select("title_id", "track", "idx", "display_place", "coded_place"),
    "w5_continuity_gaps": lambda s, d: O.continuity_gaps(view(s, d, "ts_packets")).select("file_id", "pid", "rec_no", "gap"),
    "w6_unit_ids": lambda s, d: O.unit_ids(view(s, d, "ts_packets")),
    "f20_sense_family": lambda s, d: log(s, d).select("disc_id", "seq", O.sense_family(F.col("sense_key")).alias("family"), O.is_wedge(F.col("sense_key")).alias("wedge")),
    "w13_damage_window": lambda s, d: O.damage_window(pass_log(s, d)).select("disc_id", "seq", F.col("bad_percent").cast("long").alias("bad_percent"), "triggered"),
    "w14_damage_zones": lambda s, d: O.zone_extents(log(s, d)),
    "w15_wedge_transitions": lambda s, d: O.wedge_transitions(log(s, d)),
    "w16_wedge_streaks": lambda s, d: O.wedge_streaks(log(s, d), 2),
    "a8_pass_summary": lambda s, d: O.pass_summary(pass_log(s, d)),
    "w25_ewma_scores": lambda s, d: O.ewma_scores(view(s, d, "attempts")),
    "a12_handler_totals": lambda s, d: O.handler_totals(view(s, d, "attempts")),
}

_T = "PARTITION BY title_id, track ORDER BY idx"
_GOP = f", g AS (SELECT *, sum(CAST(keyframe AS INT)) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS gop FROM frames), h AS (SELECT *, (row_number() OVER (PARTITION BY title_id, track, gop ORDER BY idx) - 1) AS place FROM g)"
_UNITS = ", u AS (SELECT title_id, track, idx, ctype <> 'I' AS dropped, size % 4 <> 0 AS verified, size - 500 AS duration_ns FROM frames)"
_ERR = """, n AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY seq) AS i FROM read_log), e AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL OR i - lag(i) OVER w - 1 >= 16 THEN 1 ELSE 0 END AS opens FROM n WHERE NOT ok WINDOW w AS (PARTITION BY disc_id ORDER BY seq)),
z AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY disc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS zone FROM e)"""
_EV = """, fine AS (SELECT user_id AS clip_no, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n, event_id % 2048 AS pts, event_id % 131072 AS spn FROM events)"""
_RATES = " ".join(f"WHEN abs(1e9 / gap - {k}) < 0.5 THEN {n}" for n, _, k in O.RATES)
_DENS = " ".join(f"WHEN abs(1e9 / gap - {k}) < 0.5 THEN {d}" for _, d, k in O.RATES)
#: The detected rate of each track; whole ticks of non-negative times.
_RATE = f""", sg AS (SELECT *, pts_ns - lag(pts_ns) OVER (PARTITION BY title_id, track ORDER BY pts_ns, idx) AS gap FROM frames), pg AS (SELECT *, row_number() OVER (PARTITION BY title_id, track ORDER BY gap, idx) - 1 AS i, count(*) OVER (PARTITION BY title_id, track) AS n FROM sg WHERE gap > 0),
mg AS (SELECT DISTINCT f.title_id, f.track, p.gap FROM frames f LEFT JOIN pg p ON p.title_id = f.title_id AND p.track = f.track AND p.i = p.n // 2),
rate AS (SELECT title_id, track, CAST(CASE {_RATES} ELSE 90000 END AS BIGINT) AS num, CAST(CASE {_DENS} WHEN gap IS NOT NULL THEN greatest(gap * 9 // 100000, 1) ELSE 3003 END AS BIGINT) AS den FROM mg)"""
_W6 = """, c AS (SELECT *, discontinuity_flag OR coalesce(cc <> (lag(cc) OVER w + 1) % 16 AND cc <> lag(cc) OVER w, false) AS gap FROM ts_packets WINDOW w AS (PARTITION BY file_id, pid ORDER BY rec_no))"""


def _replay(patch: bool) -> str:
    """A pass replayed read by read: r has a row for each read with the counters after it."""
    return "WITH RECURSIVE" + LG[4:] + f""", x AS (SELECT disc_id, seq, ok, coalesce(sense_key, 0) AS k, CASE WHEN seq % 31 = 7 THEN 255 WHEN seq % 3 = 1 THEN 8 ELSE 2 END AS status, seq % 5 = 0 AS bis, sectors, row_number() OVER (PARTITION BY disc_id ORDER BY seq) AS i FROM read_log),
r AS (SELECT DISTINCT disc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, false AS ok, CAST(0 AS BIGINT) AS cg, CAST(0 AS BIGINT) AS br, CAST(0 AS BIGINT) AS nr, CAST(0 AS BIGINT) AS wd, CAST([] AS BIGINT[]) AS win, CAST(1 AS BIGINT) AS mult, false AS inz, false AS opens, false AS rec, false AS pushed,
 CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS pct, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS jump_sectors, CAST(NULL AS BIGINT) AS rest_secs FROM x
UNION ALL SELECT disc_id, i, seq, ok, CASE WHEN ok THEN cg + 1 ELSE 0 END, CASE WHEN ok THEN 0 WHEN brr THEN br + 1 ELSE br END, CASE WHEN ok THEN 0 WHEN nrr THEN nr + 1 WHEN reach AND k <> 2 THEN 0 ELSE nr END, CASE WHEN ok THEN 0 WHEN wg THEN wd + 1 ELSE wd END,
 win2, CASE WHEN out THEN 1 WHEN jump THEN least(mult * 2, 64) ELSE mult END, CASE WHEN out THEN false WHEN opens2 THEN true ELSE inz END, opens2, rec2, pushed2, CAST(len(win2) AS BIGINT), pct2,
 CASE WHEN ok THEN NULL WHEN tr OR (wg AND wd >= 15) THEN 'abort' WHEN brr OR nrr THEN 'retry' WHEN wg OR jump THEN 'jump' WHEN bi THEN 'bisect' ELSE 'skip' END,
 CASE WHEN wg AND wd < 15 THEN {64 if patch else 524288} WHEN jump THEN 1024 * sectors * mult END,
 CASE WHEN brr THEN 15 WHEN nrr THEN 3 WHEN wg AND wd < 15 THEN 30 WHEN rec2 THEN 5 WHEN cnt THEN {"5" if patch else "CASE WHEN opens2 THEN 30 ELSE 5 END"} + CASE WHEN jump THEN 2 ELSE 0 END END
 FROM (SELECT *, cnt AND ((len(win2) = 16 AND pct2 >= {6 if patch else 12}) OR {"false" if patch else "NOT bis"}) AS jump
 FROM (SELECT *, CASE WHEN len(win2) = 0 THEN 0 ELSE CAST(list_sum(win2) AS BIGINT) * 100 // len(win2) END AS pct2
 FROM (SELECT *, CASE WHEN NOT pushed2 THEN win WHEN len(win) = 16 THEN list_append(win[2:], CAST(NOT ok AS BIGINT)) ELSE list_append(win, CAST(NOT ok AS BIGINT)) END AS win2
 FROM (SELECT *, ok OR (cnt AND NOT bis) AS pushed2, ok AND inz AND cg >= 15 AS out, NOT ok AND NOT inz AND NOT bis AS opens2
 FROM (SELECT *, reach AND NOT nrr AND NOT wg AND NOT rec2 AND NOT bi AS cnt
 FROM (SELECT *, reach AND k = 2 AND nr < 3 AS nrr, reach AND k IN (4, 5) AS wg, reach AND k = 1 AS rec2, reach AND k IN (3, 11) AND sectors > 1 AND NOT bis AND {"true" if patch else "false"} AS bi
 FROM (SELECT *, NOT ok AND NOT tr AND NOT brr AS reach
 FROM (SELECT r.disc_id, x.i, x.seq, x.ok, x.k, x.bis, x.sectors, r.cg, r.br, r.nr, r.wd, r.win, r.mult, r.inz, NOT x.ok AND x.status = 255 AS tr, NOT x.ok AND x.status NOT IN (0, 2, 255) AND r.br < 5 AS brr FROM r JOIN x ON x.disc_id = r.disc_id AND x.i = r.i + 1)))))))))
"""


_DECISIONS = "SELECT disc_id, seq, action, jump_sectors, rest_secs, held AS window_reads, pct AS bad_percent, opens AS opens_zone FROM r WHERE i > 0"
ORACLE = {
    "f21_read_action": LG + """, x AS (SELECT *, CASE seq % 5 WHEN 2 THEN 255 WHEN 3 THEN 8 ELSE 2 END AS status, coalesce(sense_key, 0) AS k FROM read_log WHERE NOT ok)
SELECT disc_id, seq, CASE WHEN status = 255 THEN 'abort' WHEN status = 8 AND seq % 7 < 5 THEN 'retry' WHEN k = 2 AND seq % 4 < 3 THEN 'retry' WHEN k IN (4, 5) AND seq % 18 + 1 >= 16 THEN 'abort' WHEN k IN (4, 5) THEN 'jump' WHEN k = 1 THEN 'skip'
 WHEN k IN (3, 11) AND seq % 3 > 1 AND seq % 2 <> 0 AND seq % 11 < 6 THEN 'bisect' ELSE 'skip' END AS action FROM x""",
    "p6_picture_type": FR + "SELECT title_id, track, idx, CASE WHEN ctype IN ('I', 'P', 'B') THEN ctype WHEN keyframe THEN 'I' ELSE 'P' END AS picture_type, keyframe AS random_access FROM frames",
    "p10_keyframe_start_gate": FR + "SELECT title_id, track, idx FROM frames f WHERE track <> 0 OR EXISTS (SELECT 1 FROM frames k WHERE k.title_id = f.title_id AND k.track = f.track AND k.idx <= f.idx AND k.keyframe)",
    "w7_resync_gate": FR + """, x AS (SELECT f.title_id, f.track, f.idx, (SELECT max(k.idx) FROM frames k WHERE k.title_id = f.title_id AND k.track = f.track AND k.idx <= f.idx AND k.keyframe) AS k,
 (SELECT max(k.idx) FROM frames k WHERE k.title_id = f.title_id AND k.track = f.track AND k.idx <= f.idx AND k.discontinuity) AS c FROM frames f) SELECT title_id, track, idx FROM x WHERE track <> 0 OR c IS NULL OR coalesce(k >= c, false)""",
    "w8_gop_groups": "WITH RECURSIVE" + FR[4:] + f""", g AS (SELECT *, sum(CAST(keyframe AS INT)) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS gop, row_number() OVER ({_T}) AS i FROM frames),
r AS (SELECT title_id, track, idx, i, gop, CAST(0 AS BIGINT) AS part, 1 AS held, size AS bytes FROM g WHERE i = 1
UNION ALL SELECT g.title_id, g.track, g.idx, g.i, g.gop, CASE WHEN g.gop <> r.gop THEN 0 WHEN r.held >= 4 OR r.bytes >= 30000 THEN r.part + 1 ELSE r.part END, CASE WHEN g.gop <> r.gop OR r.held >= 4 OR r.bytes >= 30000 THEN 1 ELSE r.held + 1 END,
 CASE WHEN g.gop <> r.gop OR r.held >= 4 OR r.bytes >= 30000 THEN g.size ELSE r.bytes + g.size END FROM r JOIN g ON g.title_id = r.title_id AND g.track = r.track AND g.i = r.i + 1)
SELECT title_id, track, idx, CAST(gop AS BIGINT) AS gop, part FROM r""",
    "w9_display_index": FR + _GOP + """, p AS (SELECT *, place // 600 AS part, CAST(ctype = 'B' AS INT) AS b FROM h),
q AS (SELECT *, sum(b) OVER w - b AS bb, sum(1 - b) OVER w - (1 - b) AS ab, sum(b) OVER (PARTITION BY title_id, track, gop, part) AS tb FROM p WINDOW w AS (PARTITION BY title_id, track, gop, part ORDER BY idx ROWS UNBOUNDED PRECEDING)),
a AS (SELECT title_id, track, idx, coalesce(lead(bb) OVER (PARTITION BY title_id, track, gop, part ORDER BY idx), tb) AS nb FROM q WHERE b = 0)
SELECT q.title_id, q.track, q.idx, CAST(gop AS BIGINT) AS gop, CAST(CASE WHEN b = 0 THEN ab + nb ELSE bb + greatest(ab - 1, 0) END AS BIGINT) AS display FROM q LEFT JOIN a USING (title_id, track, idx)""",
    "w11_monotonic_ts": FR + f", n AS (SELECT *, row_number() OVER ({_T}) AS p FROM frames) SELECT title_id, track, idx, CASE WHEN track = 0 THEN pts_ns ELSE p + max(pts_ns - p) OVER ({_T} ROWS UNBOUNDED PRECEDING) END AS ts FROM n",
    "w17_poison_point": FR + _UNITS + f", v AS (SELECT *, count(*) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS seen, count(*) FILTER (dropped AND verified) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS bad FROM u) SELECT title_id, track, min(idx) AS poison_idx FROM v WHERE dropped AND verified AND seen >= 5 AND bad * 2 > seen GROUP BY ALL",
    "w18_display_durations": FR + f", s AS (SELECT title_id, track, idx, CASE WHEN size % 5 <> 0 THEN pts_ns END AS pts_ns, ctype = 'P' AS is_clear FROM frames), x AS (SELECT *, lead(pts_ns) OVER ({_T}) AS n FROM s) SELECT title_id, track, idx, CASE WHEN n IS NOT NULL AND pts_ns IS NOT NULL THEN greatest(n - pts_ns, 0) END AS duration_ns FROM x WHERE NOT is_clear",
    "w10_rebuild_pts": FR + _GOP + """, p AS (SELECT *, place // 600 AS part, CAST(ctype = 'B' AS INT) AS b, CASE WHEN size % 3 = 0 THEN pts_ns END AS e FROM h),
q AS (SELECT *, sum(b) OVER w - b AS bb, sum(1 - b) OVER w - (1 - b) AS ab, sum(b) OVER (PARTITION BY title_id, track, gop, part) AS tb FROM p WINDOW w AS (PARTITION BY title_id, track, gop, part ORDER BY idx ROWS UNBOUNDED PRECEDING)),
a AS (SELECT title_id, track, idx, coalesce(lead(bb) OVER (PARTITION BY title_id, track, gop, part ORDER BY idx), tb) AS nb FROM q WHERE b = 0),
d AS (SELECT q.*, CASE WHEN b = 0 THEN ab + nb ELSE bb + greatest(ab - 1, 0) END AS di FROM q LEFT JOIN a USING (title_id, track, idx)),
n AS (SELECT title_id, track, gop, part, count(*) AS n, arg_min(e, idx) FILTER (e IS NOT NULL) AS e, arg_min(di, idx) FILTER (e IS NOT NULL) AS di FROM d GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS k, lead(e) OVER w - e AS span FROM n WINDOW w AS (PARTITION BY title_id, track ORDER BY gop, part)),
c AS (SELECT title_id, track, min(k) AS k1, arg_min(greatest(span // n, 1), k) AS dur1 FROM k WHERE span > 0 GROUP BY ALL),
t AS (SELECT k.*, CASE WHEN k.k >= c.k1 THEN dur1 ELSE 41708333 END AS dur FROM k LEFT JOIN c USING (title_id, track)),
u AS (SELECT *, coalesce(sum(n * dur) OVER (PARTITION BY title_id, track ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
l AS (SELECT *, (SELECT arg_max(v.e - v.di * v.dur - v.before, v.k) FROM u v WHERE v.title_id = u.title_id AND v.track = u.track AND v.k <= u.k AND v.e IS NOT NULL) AS lead FROM u)
SELECT d.title_id, d.track, d.idx, CAST(coalesce(l.lead, 0) + l.before + d.di * l.dur AS BIGINT) AS pts_ns, CAST(l.dur AS BIGINT) AS duration_ns FROM d JOIN l USING (title_id, track, gop, part)""",
    "w12_timeline_continuity": "WITH RECURSIVE" + FR[4:] + """, n AS (SELECT title_id, idx, pts_ns, track = 0 AS p, row_number() OVER (PARTITION BY title_id ORDER BY idx) AS i FROM frames),
r AS (SELECT title_id, idx, i, pts_ns AS ts, CAST(0 AS BIGINT) AS off, CAST(NULL AS BIGINT) AS prev, CASE WHEN p THEN pts_ns END AS high, 0 AS epoch FROM n WHERE i = 1
UNION ALL SELECT n.title_id, n.idx, n.i,
 CASE WHEN n.p AND n.pts_ns + r.off < r.high - 3000000000 THEN r.high + 1000000 WHEN NOT n.p AND r.prev IS NOT NULL AND n.pts_ns + r.off > r.high + 3000000000 AND n.pts_ns + r.prev BETWEEN r.high - 3000000000 AND r.high THEN n.pts_ns + r.prev ELSE n.pts_ns + r.off END,
 CASE WHEN n.p AND n.pts_ns + r.off < r.high - 3000000000 THEN r.high + 1000000 - n.pts_ns ELSE r.off END, CASE WHEN n.p AND n.pts_ns + r.off < r.high - 3000000000 THEN r.off ELSE r.prev END,
 CASE WHEN NOT n.p THEN r.high WHEN r.high IS NULL THEN n.pts_ns + r.off WHEN n.pts_ns + r.off < r.high - 3000000000 THEN r.high + 1000000 ELSE greatest(r.high, n.pts_ns + r.off) END,
 CASE WHEN n.p AND n.pts_ns + r.off < r.high - 3000000000 THEN r.epoch + 1 ELSE r.epoch END FROM r JOIN n ON n.title_id = r.title_id AND n.i = r.i + 1)
SELECT title_id, idx, ts, CAST(epoch AS INT) AS epoch FROM r""",
    "w19_sample_durations": FR + f", t AS (SELECT *, pts_ns * 90000 // 1000000000 AS t FROM frames), x AS (SELECT *, greatest(lead(t) OVER ({_T}) - t, 0) AS d, lead(idx) OVER ({_T}) AS more FROM t), y AS (SELECT *, CASE WHEN more IS NOT NULL THEN d END AS e FROM x) SELECT title_id, track, idx, CAST(coalesce(e, lag(e) OVER ({_T}), 3000) AS BIGINT) AS sample_duration FROM y",
    "w20_run_length": FR + ", x AS (SELECT *, row_number() OVER (PARTITION BY title_id, track ORDER BY idx) - row_number() OVER (PARTITION BY title_id, track, ctype ORDER BY idx) AS g FROM frames) SELECT title_id, track, min(idx) AS first, ctype AS value, count(*) AS count FROM x GROUP BY title_id, track, ctype, g",
    "w21_composition_offsets": FR + _RATE + f", x AS (SELECT *, pts_ns - min(pts_ns) OVER (PARTITION BY title_id, track) AS f, row_number() OVER ({_T}) - 1 AS i FROM frames) SELECT title_id, track, idx, CAST((f // 1000000000) * num + (f % 1000000000) * num // 1000000000 - i * den AS BIGINT) AS \"offset\" FROM x JOIN rate USING (title_id, track)",
    "w23_audio_delays": FR + """, a AS (SELECT title_id, track, arg_min(pts_ns, idx) AS a FROM frames WHERE track <> 0 GROUP BY ALL), v AS (SELECT title_id, arg_min(pts_ns, idx) AS v FROM frames WHERE track = 0 GROUP BY ALL)
SELECT title_id, track, CAST(sign(a - v) * ((abs(a - v) + 500000) // 1000000) AS BIGINT) AS delay_ms FROM a JOIN v USING (title_id)""",
    "w30_rebase_to_first_video": FR + ", v AS (SELECT title_id, arg_min(pts_ns, idx) AS v FROM frames WHERE track = 0 GROUP BY ALL) SELECT title_id, track, idx, pts_ns - v AS ts FROM frames JOIN v USING (title_id)",
    "a4_track_bitrate": with_views("frames", "titles") + """, s AS (SELECT title_id, min(idx) AS i, arg_min(pts_ns // 100000, idx) AS t FROM frames WHERE keyframe AND track = 0 GROUP BY ALL),
f AS (SELECT f.title_id, track, size, greatest(pts_ns // 100000 - t, 0) AS fin FROM frames f JOIN s ON s.title_id = f.title_id AND f.idx >= s.i), m AS (SELECT title_id, max(fin) AS fin FROM f GROUP BY ALL),
g AS (SELECT title_id, track, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ALL), d AS (SELECT title_id, duration_secs FROM titles WHERE duration_secs > 3000),
x AS (SELECT g.*, CASE WHEN duration_secs > 0 THEN duration_secs ELSE fin * 100000 / 1e9 END AS secs FROM g JOIN m USING (title_id) LEFT JOIN d USING (title_id))
SELECT title_id, track, bytes, CASE WHEN secs > 0 AND bytes > 0 THEN CAST(round(bytes * 8.0 / secs) AS BIGINT) END AS bitrate FROM x""",
    "a7_drop_tally": FR + _UNITS + "SELECT title_id, track, count(*) FILTER (NOT dropped) AS kept, count(*) FILTER (dropped) AS dropped, count(*) FILTER (dropped AND verified) AS verified, CAST(coalesce(sum(greatest(duration_ns, 0)) FILTER (dropped), 0) AS BIGINT) AS dropped_ns FROM u GROUP BY ALL",
    "a11_detect_rate": FR + _RATE + "SELECT * FROM rate",
    "w22_cluster_frames": "WITH RECURSIVE" + FR[4:] + """, b AS (SELECT title_id, min(idx) AS i0, arg_min(pts_ns // 100000, idx) AS base FROM frames WHERE track = 0 AND keyframe GROUP BY ALL),
n AS (SELECT f.title_id, idx, track, track = 0 AND keyframe AS k, greatest(pts_ns // 100000 - base, 0) AS t, row_number() OVER (PARTITION BY f.title_id ORDER BY idx) AS i FROM frames f JOIN b ON b.title_id = f.title_id AND idx >= i0),
w AS (SELECT *, row_number() OVER (PARTITION BY title_id, track ORDER BY idx) AS p FROM n), m AS (SELECT title_id, idx, i, k, CASE WHEN track = 0 THEN t ELSE p + max(t - p) OVER (PARTITION BY title_id, track ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS t FROM w),
r AS (SELECT title_id, idx, i, t, t AS start, 0 AS cluster FROM m WHERE i = 1
UNION ALL SELECT m.title_id, m.idx, m.i, m.t, CASE WHEN (m.k AND m.t - r.start >= 20000) OR m.t - r.start NOT BETWEEN -32768 AND 32767 THEN m.t ELSE r.start END, CASE WHEN (m.k AND m.t - r.start >= 20000) OR m.t - r.start NOT BETWEEN -32768 AND 32767 THEN r.cluster + 1 ELSE r.cluster END
FROM r JOIN m ON m.title_id = r.title_id AND m.i = r.i + 1)
SELECT title_id, idx, CAST(cluster AS INT) AS cluster, CAST(t AS BIGINT) AS tick FROM r""",
    "j3_clip_time_extents": with_views("ep_map") + """, g AS (SELECT clip_no, min(pts) AS lo, max(pts) AS hi FROM ep_map GROUP BY clip_no), c AS (SELECT clip_no, CAST(k AS BIGINT) AS ord, lo + k * 1000 - 500 AS i, hi - k * 90000 + 400 AS o FROM g, range(3) t(k)),
x AS (SELECT *, coalesce((SELECT arg_max(spn, pts) FROM ep_map e WHERE e.clip_no = c.clip_no AND pts <= i), (SELECT arg_min(spn, pts) FROM ep_map e WHERE e.clip_no = c.clip_no)) AS a,
 coalesce((SELECT arg_min(spn, pts) FROM ep_map e WHERE e.clip_no = c.clip_no AND pts >= o), (SELECT arg_max(spn, pts) + 1 FROM ep_map e WHERE e.clip_no = c.clip_no)) AS b FROM c)
SELECT clip_no, ord, a * 192 // 2048 AS start_sector, (b * 192 + 2047) // 2048 - a * 192 // 2048 AS sectors FROM x WHERE b > a""",
    "j4_resolve_ep_map": "WITH " + _EV[2:] + "SELECT clip_no, n, ((n // 8 + 1) << 19) + (pts << 8) AS pts, ((n // 8 * 200000) & 4294836224) | spn AS spn FROM fine",
    "j17_seek_picture": FR + """, r AS (SELECT title_id, pts_ns + 5 AS t_ns FROM frames WHERE NOT keyframe), k AS (SELECT title_id, pts_ns, idx, src_byte FROM frames WHERE keyframe)
SELECT r.title_id, r.t_ns, (SELECT arg_max(k.idx, (k.pts_ns, k.idx)) FROM k WHERE k.title_id = r.title_id AND k.pts_ns <= r.t_ns) AS key_idx, (SELECT arg_max(k.src_byte, (k.pts_ns, k.idx)) FROM k WHERE k.title_id = r.title_id AND k.pts_ns <= r.t_ns) AS byte FROM r""",
    "t3_display_order": FR + f"SELECT title_id, track, idx, CAST(row_number() OVER (PARTITION BY title_id, track ORDER BY pts_ns, idx) AS INT) AS display_place, CAST(row_number() OVER ({_T}) AS INT) AS coded_place FROM frames",
    "w5_continuity_gaps": PK + _W6 + "SELECT file_id, pid, rec_no, gap FROM c",
    "w6_unit_ids": PK + _W6 + """, u AS (SELECT *, sum(CAST(pusi AS INT)) OVER (PARTITION BY file_id, pid ORDER BY rec_no ROWS UNBOUNDED PRECEDING) AS unit FROM c),
g AS (SELECT file_id, pid, CAST(unit AS BIGINT) AS unit, count(*) AS packets, bool_or(gap AND NOT pusi) AS broken, bool_or(gap AND pusi) AS gap_at_start, min(rec_no) AS first_rec FROM u WHERE unit > 0 GROUP BY ALL)
SELECT *, gap_at_start OR coalesce(lag(broken) OVER (PARTITION BY file_id, pid ORDER BY unit), false) AS discontinuity FROM g""",
    "f20_sense_family": LG + "SELECT disc_id, seq, CASE sense_key WHEN 2 THEN 'NotReady' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Hardware' WHEN 5 THEN 'IllegalRequest' ELSE CASE WHEN sense_key IS NOT NULL THEN 'Other' END END AS family, coalesce(sense_key IN (4, 5), false) AS wedge FROM read_log",
    "f21_sweep_decisions": _replay(False) + _DECISIONS,
    "f21_patch_decisions": _replay(True) + _DECISIONS,
    "w13_damage_window": _replay(False) + "SELECT disc_id, seq, pct AS bad_percent, held = 16 AND pct >= 12 AS triggered FROM r WHERE i > 0 AND pushed",
    "w14_damage_zones": LG + _ERR + "SELECT disc_id, zone, count(*) AS errors, min(lba) AS first_lba, max(lba + sectors) AS end_lba FROM z GROUP BY ALL",
    "w15_wedge_transitions": LG + _ERR + ", x AS (SELECT *, lag(sense_key IN (4, 5)) OVER (PARTITION BY disc_id, zone ORDER BY seq) AS was FROM z) SELECT disc_id, seq, zone, sense_key FROM x WHERE sense_key IN (4, 5) AND was = false",
    "w16_wedge_streaks": LG + ", x AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY disc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM read_log), y AS (SELECT *, count(*) FILTER (NOT ok AND sense_key IN (4, 5)) OVER (PARTITION BY disc_id, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS streak FROM x) SELECT disc_id, seq, streak, streak >= 2 AS abort FROM y WHERE NOT ok",
    "a8_pass_summary": _replay(False) + """SELECT disc_id, count(*) FILTER (ok) AS reads_ok, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (opens) AS zones_entered, count(*) FILTER (action = 'jump') AS jumps_taken,
 count(*) FILTER (rec) AS marginal_recovered FROM r WHERE i > 0 GROUP BY disc_id""",
    "w25_ewma_scores": with_views("attempts") + """, t AS (SELECT disc_id, handler, recovered_bytes / elapsed_secs AS x, row_number() OVER (PARTITION BY disc_id, handler ORDER BY seq) AS i, count(*) OVER (PARTITION BY disc_id, handler) AS n FROM attempts WHERE elapsed_secs > 0),
s AS (SELECT disc_id, handler, sum(x * CASE WHEN i = 1 THEN power(0.5, n - 1) ELSE power(0.5, n - i + 1) END) AS score FROM t GROUP BY ALL)
SELECT a.disc_id, a.handler, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT disc_id, handler FROM attempts) a LEFT JOIN s USING (disc_id, handler)""",
    "a12_handler_totals": with_views("attempts") + "SELECT disc_id, handler, CAST(sum(recovered_bytes) AS BIGINT) AS recovered, CAST(sum(elapsed_secs) AS DOUBLE) AS seconds, count(*) AS attempts FROM attempts GROUP BY ALL",
}
