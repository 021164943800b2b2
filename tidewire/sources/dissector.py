"""Exports of an outside dissector as rows: JSON objects whose fields are lists, and retransmissions in one common form.

A packet is {"_source": {"layers": {"tcp.seq": ["77"], ...}}}: every field is a list of
texts, of which the first counts. A missing or unreadable one takes its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import ACK, FLOW, SYN, is_tcp
from ..operators import folds, tcp

LAYERS = "_source struct<layers: map<string, array<string>>>"
#: Fields of the export by column, with their types and defaults.
FIELDS = {
    "packet_num": ("frame.number", "bigint", 0), "src_ip": ("ip.src", "string", ""), "dst_ip": ("ip.dst", "string", ""), "src_port": ("tcp.srcport", "int", 0), "dst_port": ("tcp.dstport", "int", 0),
    "tcp_seq": ("tcp.seq", "bigint", 0), "tcp_payload_len": ("tcp.len", "int", 0), "tcp_ack": ("tcp.ack", "bigint", 0), "tcp_window": ("tcp.window_size", "int", 0),
}
#: Marks of the dissector.
FAST, SPURIOUS, RTO = "tcp.analysis.fast_retransmission", "tcp.analysis.spurious_retransmission", "tcp.analysis.rto"
#: The common form of retransmissions, whoever finds them.
COMMON = ("packet_num", *FLOW, "tcp_seq", "original_num", "delay_us", "kind", "unreachable")


def read_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """layers of each packet in JSON files: one array of packets a file (read in one task each), or one packet a line if the name ends in .jsonl."""
    lines = path.endswith(".jsonl") if isinstance(path, str) else all(p.endswith(".jsonl") for p in path)
    return spark.read.schema(LAYERS).json(path, multiLine=not lines).select("_source.layers").where("layers is not null")


def parse_export(texts: DataFrame, column: str = "value") -> DataFrame:
    """layers of each packet in a column of JSON objects; what isn't one is left out."""
    return texts.select(F.from_json(column, LAYERS).alias("j")).select("j._source.layers").where("layers is not null")


def _first(field: str) -> Column:
    return F.get(F.element_at("layers", F.lit(field)), F.lit(0))


def exported_packets(layers: DataFrame) -> DataFrame:
    """The columns of FIELDS, ts_us, tcp_flags (written 0x12 or 18), and the dissector's marks."""
    cols = [F.coalesce(_first(f).try_cast(t), F.lit(d).cast(t)).alias(c) for c, (f, t, d) in FIELDS.items()]
    flags = _first("tcp.flags")
    hexed = F.conv(F.when(flags.rlike("^0[xX][0-9a-fA-F]+$"), F.substr(flags, F.lit(3))), 16, 10).try_cast("int")
    # epochs carry nanoseconds: seconds and fraction are cast apart, so that none is lost to a double
    us = F.floor(_first("frame.time_epoch").try_cast("decimal(20,9)") * 1_000_000).cast("bigint")
    marks = [F.map_contains_key("layers", F.lit(m)).alias(n) for n, m in (("fast", FAST), ("spurious", SPURIOUS), ("rto", RTO))]
    return layers.select(*cols, F.coalesce(us, F.lit(0).cast("bigint")).alias("ts_us"), F.coalesce(hexed, flags.try_cast("int"), F.lit(0)).alias("tcp_flags"), *marks)


def first_sends(packets: DataFrame) -> DataFrame:
    """FLOW, tcp_seq, original_num, original_us: the first packet of each sequence number of a flow."""
    return packets.groupBy(*FLOW, "tcp_seq").agg(F.min_by(F.struct("packet_num", "ts_us"), "packet_num").alias("x")).select(
        *FLOW, "tcp_seq", F.col("x.packet_num").alias("original_num"), F.col("x.ts_us").alias("original_us")
    )


def exported_retransmissions(found: DataFrame, packets: DataFrame) -> DataFrame:
    """The packets that the dissector found (exported_packets, or adapters.retransmission_lines) in COMMON form.

    They meet the first packet of their sequence number among all TCP packets by equality; a
    packet that is its own first one has no original and no delay.
    """
    has = lambda c: F.col(c) if c in found.columns else F.lit(False)
    kind = F.when(has("fast"), "Fast Retransmission").when(has("rto"), "RTO").when(has("spurious"), "Spurious Retransmission").otherwise("Retransmission")
    flags = F.col("tcp_flags") if "tcp_flags" in found.columns else F.lit(0)
    r = found.withColumn("kind", kind).withColumn("unreachable", _side(flags)).join(first_sends(packets), [*FLOW, "tcp_seq"], "left")
    later = F.col("original_num") < F.col("packet_num")
    return r.select("packet_num", *FLOW, "tcp_seq", F.when(later, F.col("original_num")).alias("original_num"), F.when(later, F.col("ts_us") - F.col("original_us")).alias("delay_us"), "kind", "unreachable")


def _side(flags: Column) -> Column:
    syn, ack = flags.bitwiseAND(SYN) != 0, flags.bitwiseAND(ACK) != 0
    return F.when(syn, F.when(ack, "client_unreachable").otherwise("server_unreachable"))


def own_retransmissions(packets: DataFrame, whole_state: bool = True) -> DataFrame:
    """Retransmissions in COMMON form by our own analysis: the state machine of folds, or equal segments alone."""
    if whole_state:
        return folds.retransmissions(folds.segment_events(packets)).select(*COMMON)
    return tcp.exact_retransmissions(packets).withColumn("unreachable", _side(F.col("tcp_flags"))).select(*COMMON)


def retransmissions(packets: DataFrame, exported: DataFrame | None = None, backend: str = "auto") -> DataFrame:
    """Retransmissions in COMMON form. backend: `dissector` (needs exported rows), `builtin`, or `auto`, the dissector's where there are any."""
    if backend not in ("auto", "builtin", "dissector"):
        raise ValueError(f"unknown backend {backend!r}")
    if backend == "dissector" and exported is None:
        raise ValueError("backend 'dissector' needs exported rows")
    if backend == "builtin" or exported is None:
        return own_retransmissions(packets)
    return exported_retransmissions(exported, packets.where(is_tcp()))
