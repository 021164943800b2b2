"""Who talks to whom, how much, how fast and how evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import ENDS, FLOW, ip_num, is_tcp, with_ends

#: Names of ports in port counts, and services that classify a flow.
SERVICES = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 53: "DNS", 67: "DHCP-Server", 68: "DHCP-Client", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 161: "SNMP",
    443: "HTTPS", 465: "SMTPS", 587: "SMTP-Submission", 993: "IMAPS", 995: "POP3S", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis", 8080: "HTTP-Alt",
    8443: "HTTPS-Alt", 9200: "Elasticsearch", 27017: "MongoDB",
}
FLOW_SERVICES = {
    9092: "Kafka", 9093: "Kafka SSL", 5672: "RabbitMQ", 5671: "RabbitMQ SSL", 6379: "Redis", 27017: "MongoDB", 27018: "MongoDB Shard", 27019: "MongoDB Config", 3306: "MySQL",
    5432: "PostgreSQL", 9200: "Elasticsearch", 9300: "Elasticsearch Cluster", 80: "HTTP", 443: "HTTPS", 8080: "HTTP Alt", 8443: "HTTPS Alt", 53: "DNS", 22: "SSH", 23: "Telnet",
    20: "FTP Data", 21: "FTP Control", 25: "SMTP", 110: "POP3", 143: "IMAP", 993: "IMAPS", 995: "POP3S",
}


def service_of(port: Column, table: dict[int, str] = SERVICES) -> Column:
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(names, port), F.lit("Unknown"))


def top_talkers(p: DataFrame, k: int = 20) -> DataFrame:
    """Addresses by bytes sent plus received; both roles of a packet come from one scan."""
    roles = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("packet_length").alias("sent"), F.lit(0).alias("received")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("sent"), F.col("packet_length").alias("received")),
    )
    g = p.select(F.inline(roles)).groupBy("ip").agg(
        F.sum("sent").alias("bytes_sent"), F.sum("received").alias("bytes_received"), F.count("*").alias("packets")
    )
    return g.withColumn("total_bytes", F.col("bytes_sent") + F.col("bytes_received")).orderBy(F.desc("total_bytes"), "ip").limit(k)


def top_conversations(p: DataFrame, k: int = 20) -> DataFrame:
    """Address pairs by bytes; the last packet with a port gives protocol and ports."""
    g = p.groupBy("src_ip", "dst_ip").agg(
        F.count("*").alias("packets"),
        F.sum("packet_length").alias("bytes"),
        F.max_by("protocol", "packet_num").alias("protocol"),
        F.max_by("src_port", F.when(F.col("src_port") > 0, F.col("packet_num"))).alias("src_port"),
        F.max_by("dst_port", F.when(F.col("dst_port") > 0, F.col("packet_num"))).alias("dst_port"),
    )
    return g.orderBy(F.desc("bytes"), "src_ip", "dst_ip").limit(k)


def protocol_stats(p: DataFrame) -> DataFrame:
    return p.groupBy("protocol").agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"))


def throughput(p: DataFrame) -> DataFrame:
    """Conversations with duration (at least 1 ms) and megabits per second."""
    g = with_ends(p.where(F.col("protocol").isin("TCP", "UDP"))).groupBy(*ENDS).agg(
        F.count("*").alias("packets"),
        F.sum("packet_length").alias("bytes"),
        (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
    )
    us = F.when(F.col("span_us") <= 0, 1000).otherwise(F.col("span_us"))
    return g.withColumn("mbps", F.col("bytes") * 8 / us.cast("double"))


def top_throughput(p: DataFrame, k: int = 20) -> DataFrame:
    return throughput(p).orderBy(F.desc("mbps"), *ENDS).limit(k)


def slow_flows(p: DataFrame, min_us: int = 1_000_000, below_mbps: float = 1.0, min_bytes: int = 10_000, k: int = 10) -> DataFrame:
    slow = (F.col("span_us") > min_us) & (F.col("mbps") < below_mbps) & (F.col("bytes") > min_bytes)
    return throughput(p).where(slow).orderBy("mbps", *ENDS).limit(k)


def asymmetry(p: DataFrame, min_bytes: int = 10_000, min_packets: int = 10) -> DataFrame:
    """Conversations with bytes each way; byte_ratio is smaller / larger (1 when both are 0)."""
    forward = (F.col("src_ip") == F.col("ip_a")) & F.col("src_port").eqNullSafe(F.col("port_a"))
    g = with_ends(p).groupBy("protocol", *ENDS).agg(
        F.sum(F.when(forward, F.col("packet_length")).otherwise(0)).alias("forward_bytes"),
        F.sum(F.when(forward, 0).otherwise(F.col("packet_length"))).alias("reverse_bytes"),
        F.count("*").alias("packets"),
    )
    g = g.where((F.col("forward_bytes") + F.col("reverse_bytes") >= min_bytes) & (F.col("packets") >= min_packets))
    low, high = F.least("forward_bytes", "reverse_bytes"), F.greatest("forward_bytes", "reverse_bytes")
    g = g.withColumn("byte_ratio", F.when(high == 0, 1.0).otherwise(low / high.cast("double")))
    kind = F.when(F.col("byte_ratio") < 0.05, "unidirectional").when(F.col("byte_ratio") < 0.3, "asymmetric").when(F.col("byte_ratio") >= 0.8, "symmetric")
    return g.withColumn("kind", kind.otherwise("moderate"))


def asymmetric_flows(p: DataFrame, k: int = 50, below: float = 0.3, **limits: int) -> DataFrame:
    return asymmetry(p, **limits).where(F.col("byte_ratio") < below).orderBy("byte_ratio", F.desc("packets"), "protocol", *ENDS).limit(k)


def largest_flows(p: DataFrame, k: int = 20, **limits: int) -> DataFrame:
    """The k conversations with most bytes, with how they are shared between the directions."""
    volume = F.col("forward_bytes") + F.col("reverse_bytes")
    return asymmetry(p, **limits).withColumn("bytes", volume).orderBy(F.desc("bytes"), "protocol", *ENDS).limit(k)


def asymmetry_by_protocol(p: DataFrame, **limits: int) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return asymmetry(p, **limits).groupBy("protocol").agg(F.count("*").alias("flows"), *map(count, ("unidirectional", "asymmetric", "moderate", "symmetric")))


def protocol_distribution(p: DataFrame) -> DataFrame:
    """Packets per transport protocol and share of all; totals are taken over the grouped rows."""
    g = p.groupBy("protocol").agg(F.count("*").alias("packets"))
    total = g.agg(F.sum("packets").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("protocol", "packets", (F.col("packets") / F.col("total")).alias("share"))


def address_families(p: DataFrame) -> DataFrame:
    """Packets per IP version and share of all."""
    g = p.groupBy(F.concat(F.lit("IPv"), F.col("ip_version").cast("string")).alias("family")).agg(F.count("*").alias("packets"))
    total = g.agg(F.sum("packets").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("family", "packets", (F.col("packets") / F.col("total")).alias("share"))


def top_ports(p: DataFrame, k: int = 10) -> DataFrame:
    g = p.where(F.col("dst_port").isNotNull()).groupBy("protocol", "dst_port").agg(F.count("*").alias("packets"))
    return g.withColumn("service", service_of(F.col("dst_port"))).orderBy(F.desc("packets"), "protocol", "dst_port").limit(k)


def unique_flows(p: DataFrame) -> DataFrame:
    return p.groupBy("protocol").agg(F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FLOW]).alias("flows"))


def classify_services(p: DataFrame) -> DataFrame:
    """Directed flows with a service: by known port, else by the best of four behaviour scores.

    Scores are in tenths; of equal scores streaming, bulk, small datagrams and interactive win in this order.
    """
    g = p.groupBy("protocol", *FLOW).agg(
        F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"),
        F.sum(F.col("packet_length").cast("bigint") * F.col("packet_length")).alias("squares"),
        (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
    )
    n, size = F.col("packets"), F.col("bytes") / F.col("packets").cast("double")
    dur = F.col("span_us") / 1e6
    rate = F.when(F.col("span_us") > 0, F.col("bytes") / dur).otherwise(0.0)
    iat = F.when(n > 1, dur / (n - 1)).otherwise(0.0)
    spread = (F.col("squares") * n - F.col("bytes") * F.col("bytes")) / (n * F.greatest(n - 1, F.lit(1))).cast("double")
    pt = lambda c, x: F.when(c, x).otherwise(0)
    tcp, udp = is_tcp(), F.col("protocol") == "UDP"
    streaming = pt(size >= 1000, 4) + pt(rate >= 1e6, 3) + pt(dur >= 2, 2) + pt(n >= 50, 1)
    bulk = F.when(tcp, pt(size >= 1200, 4) + pt(dur >= 5, 3) + pt(n >= 100, 2) + pt(rate >= 5e5, 1)).otherwise(0)
    dns = F.when(udp, pt(size <= 512, 4) + pt(iat >= 0.5, 3) + pt(n < 50, 2) + pt((dur < 10) | (n < 10), 1)).otherwise(0)
    web = F.when(tcp, pt(size.between(200, 1200), 3) + pt(dur.between(0.1, 30), 2) + pt(n.between(5, 100), 3) + pt(spread > 50000, 2)).otherwise(0)
    g = g.withColumn("s", F.array(streaming, bulk, dns, web)).withColumn("best", F.array_max("s"))
    small = F.when(F.contains(F.coalesce(F.col("dst_port").cast("string"), F.lit("")), F.lit("53")), "DNS").otherwise("Control")
    behaviour = F.element_at(F.array(F.lit("Streaming"), F.lit("Bulk"), small, F.lit("Interactive")), F.array_position("s", F.col("best")).cast("int"))
    by_dst, by_src = service_of(F.col("dst_port"), FLOW_SERVICES), service_of(F.col("src_port"), FLOW_SERVICES)
    return g.select(
        "protocol", *FLOW, "packets", "bytes",
        F.when(by_dst != "Unknown", by_dst).when(by_src != "Unknown", by_src).when(F.col("best") > 0, behaviour).otherwise("Unknown").alias("service"),
        F.when(by_dst != "Unknown", 1.0).when(by_src != "Unknown", 0.9).otherwise(F.col("best") / 10.0).alias("confidence"),
    )


def service_summary(p: DataFrame) -> DataFrame:
    return classify_services(p).groupBy("service").agg(
        F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("confidence").alias("least_confidence")
    )


def label_ranges(p: DataFrame, ranges: DataFrame) -> DataFrame:
    """Packets and bytes per labelled address range (label, lo, hi as numbers); addresses in none are public, in several count for each.

    Destinations are counted before they meet the ranges, so those are distinct addresses.
    Both are laid out over blocks of 65,536 addresses and joined by block.
    """
    block = lambda c: F.shiftright(F.col(c), 16)
    g = p.groupBy("dst_ip").agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes")).withColumn("num", ip_num(F.col("dst_ip")))
    r = ranges.withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    within = (F.col("block") == block("num")) & F.col("num").between(F.col("lo"), F.col("hi"))
    j = g.join(r, within, "left")
    return j.groupBy(F.coalesce("label", F.lit("public")).alias("label")).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
