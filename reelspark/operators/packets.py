"""Packets to PES units with their payload: in batch by running sums, as a stream by the same rule packet by packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import scalars as S
from reelspark.streaming.ordered import keyed

#: Bytes of a unit at most.
MOST = 64 << 20
UNIT = "file_id long, pid long, first_rec long, pts long, dts long, discontinuity boolean, data binary"
FIELDS = ("last_cc", "active", "skip", "pending", "first_rec", "pts", "dts", "data")
#: Of a packet what the rule takes, in its order, and the number of the one that ends a pid.
TAKEN = ("rec_no", "marker", "pusi", "cc", "flagged", "payload", "pts", "dts", "header")
LAST = (1 << 63) - 1
STATE = "last_cc int, active boolean, skip int, pending boolean, first_rec long, pts long, dts long, data binary"


class Assembler:
    """The open unit of one pid: what it holds, the header bytes still to be skipped, the last counter, and whether the next unit that is
    completed follows a loss."""

    def __init__(self, last_cc=None, active=False, skip=0, pending=False, first_rec=None, pts=None, dts=None, data=b"", most: int = MOST) -> None:
        self.last_cc, self.active, self.skip, self.pending = last_cc, active, skip, pending
        self.first_rec, self.pts, self.dts, self.data, self.most = first_rec, pts, dts, bytearray(data), most

    def state(self) -> tuple:
        return tuple(bytes(self.data) if k == "data" else getattr(self, k) for k in FIELDS)

    def drop(self) -> None:
        self.data, self.active, self.skip, self.pending = bytearray(), False, 0, True

    def push(self, payload: bytes) -> None:
        if not self.active:
            return
        if len(self.data) + len(payload) > self.most:
            self.drop()
        else:
            self.data += payload

    def close(self) -> tuple | None:
        """The unit that is open, if it holds anything."""
        done = None
        if self.active and self.data:
            done = (self.first_rec, self.pts, self.dts, self.pending, bytes(self.data))
            self.pending = False
        self.data = bytearray()
        return done

    def take(self, rec: int, marker: bool, pusi: bool, cc: int, flagged: bool, payload: bytes, pts, dts, header: int) -> tuple | None:
        """The unit that the next packet completes. A marker is a loss of unknown pids: what is open goes."""
        if marker:
            self.drop()
            return None
        gap = flagged or (self.last_cc is not None and cc not in (self.last_cc, (self.last_cc + 1) % 16))
        self.last_cc, done = cc, None
        if pusi:
            done = self.close()
            self.active, self.first_rec, self.pts, self.dts = True, rec, pts, dts
            self.pending = self.pending or gap
            self.skip = max(0, header - len(payload)) if header else 0
            if header and header < len(payload):
                self.push(payload[header:])
        elif gap and self.active:
            self.drop()
        else:
            self.pending = self.pending or gap
            gone = min(self.skip, len(payload))
            self.skip -= gone
            if gone < len(payload):
                self.push(payload[gone:])
        return done


#: Of a file: packets without a payload that mark a loss on every pid.
NULL_PID = 0x1FFF


def _rows(packets: DataFrame) -> DataFrame:
    """Packets with their PES header read, and each marker once for every pid of its file."""
    marks = (F.col("pid") == NULL_PID) & F.col("discontinuity_flag")
    pids = packets.filter(F.col("pid") != NULL_PID).select("file_id", "pid").distinct()
    h = S.pes_header(F.hex(F.substring("payload", 1, 19)))
    own = packets.filter((F.col("pid") != NULL_PID) & F.col("payload").isNotNull()).withColumn("_h", h)
    columns = ("file_id", "pid", "rec_no", "marker", "pusi", "cc", "flagged", "payload", "pts", "dts", "header")
    own = own.select("file_id", "pid", "rec_no", F.lit(False).alias("marker"), "pusi", "cc", F.col("discontinuity_flag").alias("flagged"), "payload", "_h.pts", "_h.dts", F.col("_h.header_len").alias("header"))
    lost = packets.filter(marks).select("file_id", "rec_no").join(pids, "file_id")
    none = F.lit(None)
    lost = lost.select("file_id", "pid", "rec_no", F.lit(True).alias("marker"), F.lit(False).alias("pusi"), F.lit(0).cast(packets.schema["cc"].dataType).alias("cc"), F.lit(True).alias("flagged"), none.cast("binary").alias("payload"), none.cast("long").alias("pts"), none.cast("long").alias("dts"), F.lit(0).alias("header"))
    return own.unionByName(lost).select(*columns)


def assemble_pes(packets: DataFrame, most: int = MOST) -> DataFrame:
    """Units of packets (file_id, pid, rec_no, pusi, cc, discontinuity_flag, payload): a unit begins at each start packet, after its header, which may
    run into the next packets. A gap inside a unit drops it and flags the next one completed; a gap at a start flags the unit that starts. A start without a PES
    header opens an empty unit; one that outgrows `most` bytes is dropped like a gap. The last unit of each pid is completed at the end.

    All of it is running sums: starts so far number the units, bytes so far in a unit say what of a packet the header still takes and when the unit is too long, and losses so
    far, held against those up to the last unit that was completed, say whether one is flagged. Payloads move once, by file and pid, and are joined unit by unit; those of dropped
    units are left out before."""
    pid, unit = ["file_id", "pid"], ["file_id", "pid", "unit"]
    w = W.partitionBy(*pid).orderBy("rec_no")
    before, sofar = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    last_cc = F.last(F.when(~F.col("marker"), F.col("cc")), ignorenulls=True).over(before)
    gap = F.col("marker") | F.col("flagged") | F.coalesce((F.col("cc") != last_cc) & (F.col("cc") != (last_cc + 1) % 16), F.lit(False))
    p = _rows(packets).withColumn("loss", gap).withColumn("unit", F.sum(F.col("pusi").cast("long")).over(sofar))
    size = F.coalesce(F.length("payload"), F.lit(0)).cast("long")
    inside = W.partitionBy(*unit).orderBy("rec_no")
    p = p.withColumn("size", size).withColumn("head", F.first("header").over(inside))
    # a header's bytes come off the unit's first packets; without one all of the first packet goes
    seen = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    skipped = F.when(F.col("pusi") & (F.col("head") == 0), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("head") - seen)))
    p = p.withColumn("skip", skipped)
    p = p.withColumn("bytes", F.sum(F.col("size") - F.col("skip")).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy(*unit)
    p = p.withColumn("breaks", (F.col("loss") & ~F.col("pusi")) | ((F.col("unit") > 0) & (F.col("bytes") > most)))
    p = p.withColumn("done", (F.col("unit") > 0) & ~F.max("breaks").over(whole) & (F.max("bytes").over(whole) > 0))
    body = F.when(F.col("done"), F.expr("substring(payload, CAST(skip AS INT) + 1)"))
    start = lambda c: F.max(F.when(F.col("pusi"), F.col(c))).alias(c)
    u = p.withColumn("body", body).groupBy(*unit).agg(
        F.min("rec_no").alias("first_rec"), start("pts"), start("dts"), F.bool_or("done").alias("done"), F.expr("listagg(body) WITHIN GROUP (ORDER BY rec_no)").alias("data"),
        F.bool_or(F.col("loss") & F.col("pusi")).cast("int").alias("at_start"), F.bool_or("breaks").cast("int").alias("in_unit"),
    )
    by_unit = W.partitionBy(*pid).orderBy("unit")
    u = u.withColumn("losses", F.sum(F.col("at_start") + F.col("in_unit")).over(by_unit.rowsBetween(W.unboundedPreceding, 0)))
    settled = F.coalesce(F.last(F.when(F.col("done"), F.col("losses")), ignorenulls=True).over(by_unit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    u = u.withColumn("discontinuity", F.col("losses") > settled)
    return u.filter("done").select("file_id", "pid", "first_rec", "pts", "dts", "discontinuity", "data")


def stream_demux(packets: DataFrame, most: int = MOST) -> DataFrame:
    """The rule of assemble_pes with the open unit of each file and pid as state, kept in buckets of pids (ordered.keyed); a packet whose rec_no is the largest 64-bit number ends
    its pid and completes the last unit. Packets as assemble_pes reads them; markers must name the pid that they hit."""
    h = S.pes_header(F.hex(F.substring("payload", 1, 19)))
    rows = packets.withColumn("_h", h).select("file_id", "pid", "rec_no", F.coalesce("marker", F.lit(False)).alias("marker"), "pusi", "cc", F.col("discontinuity_flag").alias("flagged"), "payload", "_h.pts", "_h.dts", F.coalesce("_h.header_len", F.lit(0)).alias("header"))

    def follow(key, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple | None]:
        open_, out = Assembler(*held or (), most=most), []
        for rec, marker, pusi, cc, flagged, payload, pts, dts, header in zip(*(rows[c] for c in TAKEN)):
            if rec == LAST:
                done = open_.close()
                return out + ([(*key, *done)] if done else []), None
            done = open_.take(rec, marker, pusi, cc, flagged, payload or b"", *(None if x is None else int(x) for x in (pts, dts)), header)
            if done:
                out.append((*key, *done))
        return out, open_.state()

    return keyed(rows, ["file_id", "pid"], "rec_no", follow, UNIT, STATE)
