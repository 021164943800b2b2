"""Tables that are not captures, projected onto the packet schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Event type: destination, port, protocol.
DESTINATIONS = {
    "view": ("93.184.216.34", 443, "TCP"),
    "click": ("192.168.1.10", 22, "TCP"),
    "purchase": ("8.8.8.8", 53, "UDP"),
    "error": ("203.0.113.7", 3389, "TCP"),
    "signup": ("10.0.0.9", 445, "TCP"),
}
#: TCP flags by event_id modulo 7.
FLAGS = (2, 18, 16, 24, 17, 4, 16)


def events_to_packets(events: DataFrame) -> DataFrame:
    """The events table as packets: users are sources, event types are destinations."""
    kind = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in DESTINATIONS.items() for x in (k, v[i])]), F.col("event_type"))
    e = F.col("event_id")
    tcp = kind(2) == "TCP"
    only = lambda c: F.when(tcp, c)
    return events.select(
        (e + 1).alias("packet_num"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 200 + 1).cast("string")).alias("src_ip"),
        kind(0).alias("dst_ip"),
        F.lit(4).cast("tinyint").alias("ip_version"),
        F.lit(64).cast("smallint").alias("ttl"),
        (F.floor(F.col("value") * 10) + 26).cast("int").alias("total_length"),
        (F.floor(F.col("value") * 10) + 40).cast("int").alias("packet_length"),
        kind(2).alias("protocol"),
        (F.col("user_id") + 40000).cast("int").alias("src_port"),
        kind(1).alias("dst_port"),
        only(1000 + (e % 13) * 100).alias("tcp_seq"),
        only(1000 + (e % 11) * 100).alias("tcp_ack"),
        only(F.element_at(F.array(*[F.lit(x) for x in FLAGS]), (e % 7 + 1).cast("int"))).alias("tcp_flags"),
        only(F.when(e % 17 == 0, 0).otherwise(8192 + (e % 5) * 1000)).cast("int").alias("tcp_window"),
        F.when(e % 3 == 0, 0).otherwise(100).cast("int").alias("tcp_payload_len"),
        F.lit(None).cast("int").alias("udp_length"),
        F.lit(None).cast("smallint").alias("icmp_type"),
        F.lit(None).cast("smallint").alias("icmp_code"),
    )


def retransmission_lines(lines: DataFrame) -> DataFrame:
    """Rows of an exported dissector listing (frame|epoch|src|dst|sport|dport|seq in a column `value`)."""
    c = F.split("value", r"\|", -1)
    return lines.select(
        F.get(c, F.lit(0)).try_cast("bigint").alias("packet_num"),
        F.round(F.get(c, F.lit(1)).try_cast("double") * 1_000_000).cast("bigint").alias("ts_us"),
        F.get(c, F.lit(2)).alias("src_ip"),
        F.get(c, F.lit(3)).alias("dst_ip"),
        F.get(c, F.lit(4)).try_cast("int").alias("src_port"),
        F.get(c, F.lit(5)).try_cast("int").alias("dst_port"),
        F.get(c, F.lit(6)).try_cast("bigint").alias("tcp_seq"),
    ).where(F.col("packet_num").isNotNull())
