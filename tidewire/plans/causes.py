"""Root causes: what the troubled flows or lookups of a group have in common.

Each function returns one row per group with its size, the destination (or name, or
resolver) that most of it shares, how far it is shared, and the cause that follows. A
cause is a code; `cause_on` is what it is about.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cols import ACK, FLOW, SYN, ip_num
from ..operators.tcp import flow_kinds

#: Special address ranges with their names, the documents that define them, and whether traffic to them is itself a fault.
RANGES = (
    ("192.0.2.0/24", "TEST-NET-1 (Documentation/Testing)", "RFC 5737", True),
    ("198.51.100.0/24", "TEST-NET-2 (Documentation/Testing)", "RFC 5737", True),
    ("203.0.113.0/24", "TEST-NET-3 (Documentation/Testing)", "RFC 5737", True),
    ("0.0.0.0/8", "Current Network (invalid destination)", "RFC 1122", True),
    ("127.0.0.0/8", "Loopback", "RFC 1122", True),
    ("169.254.0.0/16", "Link-Local (APIPA)", "RFC 3927", True),
    ("10.0.0.0/8", "Private Network", "RFC 1918", False),
    ("172.16.0.0/12", "Private Network", "RFC 1918", False),
    ("192.168.0.0/16", "Private Network", "RFC 1918", False),
    ("224.0.0.0/4", "Multicast", "RFC 5771", True),
    ("240.0.0.0/4", "Reserved (Future Use)", "RFC 1112", True),
)
#: Services by port, as jitter reports name them.
JITTER_SERVICES = {
    9092: "Kafka", 9093: "Kafka SSL", 5672: "RabbitMQ", 5671: "RabbitMQ SSL", 6379: "Redis", 27017: "MongoDB", 9200: "Elasticsearch", 5432: "PostgreSQL", 3306: "MySQL",
    22: "SSH", 23: "Telnet", 3389: "RDP", 5900: "VNC", 80: "HTTP", 443: "HTTPS", 8080: "HTTP Alt", 8443: "HTTPS Alt", 53: "DNS",
    5353: "mDNS", 1900: "SSDP", 137: "NetBIOS", 138: "NetBIOS-DG",
}


def range_table(spark: SparkSession, ranges: Sequence[tuple] = RANGES) -> DataFrame:
    """prefix, range_name, rfc, faulty, bits, net (the address's first bits as a number)."""
    d = spark.createDataFrame(list(ranges), "prefix string, range_name string, rfc string, faulty boolean")
    bits = F.split_part("prefix", F.lit("/"), F.lit(2)).cast("int")
    return d.withColumn("bits", bits).withColumn("net", (ip_num(F.split_part("prefix", F.lit("/"), F.lit(1))) / F.pow(F.lit(2.0), 32 - bits)).cast("bigint"))


def with_range(df: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """df with range_name, rfc and faulty of the longest prefix in range_table that holds its address (nulls: none, or no IPv4).

    Each distinct address is masked to every length there may be and met by equality.
    """
    a = df.select(F.col(ip).alias("address")).where(F.col(ip).isNotNull()).distinct().withColumn("num", ip_num(F.col("address")))
    masked = a.select("address", F.explode(F.transform(F.sequence(F.lit(0), F.lit(32)), lambda b: F.struct(b.alias("bits"), (F.col("num") / F.pow(F.lit(2.0), 32 - b)).cast("bigint").alias("net")))).alias("m"))
    met = masked.select("address", "m.*").join(ranges, ["bits", "net"])
    best = met.groupBy("address").agg(F.max_by(F.struct("range_name", "rfc", "faulty"), "bits").alias("best"))
    return df.join(best.withColumnRenamed("address", ip), ip, "left").select(*df.columns, "best.range_name", "best.rfc", "best.faulty")


def most_frequent(df: DataFrame, by: Sequence[str], what: dict[str, Column | str]) -> DataFrame:
    """Per group: size (its rows), and for each name in `what` its most frequent value (ties: the smallest) and <name>_count; nulls don't compete.

    Values are counted before groups are formed, so a group is as many rows as it has values.
    """
    out = df.groupBy(*by).agg(F.count("*").alias("size"))
    for name, value in what.items():
        c = df.select(*by, (F.col(value) if isinstance(value, str) else value).alias(name)).where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count("*").alias("c"))
        top = c.groupBy(*by).agg(F.min(F.struct((-F.col("c")).alias("c"), name)).alias("x")).select(*by, F.col(f"x.{name}").alias(name), (-F.col("x.c")).alias(f"{name}_count"))
        out = out.join(top, list(by), "left")
    return out


def scope(count: str) -> Column:
    """all, dominant (half or more) or none."""
    return F.when(F.col(count) == F.col("size"), "all").when(F.col(count) * 2 >= F.col("size"), "dominant").otherwise("none")


def interval_spread(events: DataFrame, by: str, block_us: int = 3_600_000_000) -> DataFrame:
    """Per group of events (by, ts_us): n and cv, the coefficient of variation of the times between neighbours (null for fewer than two or all at once).

    Neighbours are found within blocks of time, and between blocks by their first and last events.
    """
    w = Window.partitionBy(by, "block").orderBy("ts_us")
    square = lambda c: c.cast("decimal(38,0)") * c
    e = events.select(by, "ts_us", F.floor(F.col("ts_us") / block_us).alias("block"))
    e = e.withColumn("q", square(F.col("ts_us") - F.lag("ts_us").over(w)))
    b = e.groupBy(by, "block").agg(F.count("*").alias("n"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.sum("q").alias("q"))
    gap = square(F.col("first") - F.lag("last").over(Window.partitionBy(by).orderBy("block")))
    b = b.withColumn("gap", gap)
    g = b.groupBy(by).agg(F.sum("n").alias("n"), (F.max("last") - F.min("first")).cast("double").alias("s"), (F.coalesce(F.sum("q"), F.lit(0)) + F.coalesce(F.sum("gap"), F.lit(0))).cast("double").alias("q"))
    mean = F.col("s") / (F.col("n") - 1).cast("double")
    cv = F.sqrt(F.greatest(F.col("q") / (F.col("n") - 1).cast("double") - mean * mean, F.lit(0.0))) / mean
    return g.select(by, "n", F.when((F.col("n") > 1) & (F.col("s") > 0), cv).alias("cv"))


def retransmission_causes(events: DataFrame, answered: DataFrame, bursts: DataFrame, ranges: DataFrame, hits: int = 5, peak: float = 5.0, least: int = 10, spread: float = 0.3) -> DataFrame:
    """Causes per kind of flow (syn, rto, fast, generic, mixed); events are retransmissions, answered the flows that heard from the other side.

    One destination for all flows: the end of a handshake that can't be reached (SYNs), or an
    address that shouldn't be talked to. Else, for RTOs, a burst that holds over `hits` of them
    and peaks at over `peak` times the mean rate, or even intervals (traffic shaping); for
    SYNs, no answer to any of them (silently dropped).
    """
    r = events.join(flow_kinds(events).select(*FLOW, F.col("kind").alias("group")), list(FLOW))
    flows = r.groupBy("group", *FLOW).agg(F.min(F.struct("packet_num", "tcp_flags")).alias("first"), F.min(F.col("tcp_flags").bitwiseAND(SYN) != 0).alias("syns"))
    flows = flows.join(answered.select(*FLOW, F.lit(True).alias("heard")), list(FLOW), "left")
    g = most_frequent(flows, ["group"], {"dst_ip": "dst_ip", "dst_port": "dst_port"})
    syn, acks = F.col("first.tcp_flags").bitwiseAND(SYN) != 0, F.col("first.tcp_flags").bitwiseAND(ACK) != 0
    side = flows.groupBy("group").agg((F.max("heard").isNull() & F.min("syns")).alias("silent"), F.min_by(syn & acks, "first.packet_num").alias("client_side"))
    block = 60_000_000
    at = lambda c: F.floor(F.col(c) / block).cast("bigint")
    b = bursts.where(F.col("peak_ratio") > peak).select("burst_id", "start_us", "end_us", F.explode(F.sequence(at("start_us"), at("end_us"))).alias("block"))
    inside = r.where("group = 'rto'").select("group", "ts_us", at("ts_us").alias("block")).join(b, "block").where(F.col("ts_us").between(F.col("start_us"), F.col("end_us")))
    burst = inside.groupBy("group", "burst_id").agg(F.count("*").alias("c")).where(F.col("c") > hits).groupBy("group").agg(F.max("c").alias("in_burst"))
    d = g.join(side, "group").join(interval_spread(r, "group").select("group", F.col("n").alias("retransmissions"), "cv"), "group").join(burst, "group", "left")
    d = with_range(d, "dst_ip", ranges).withColumn("scope", scope("dst_ip_count"))
    is_, whole = (lambda k: F.col("group") == k), F.col("scope") == "all"
    cause = (
        F.when(whole & is_("syn"), F.when(F.col("client_side"), "client_unreachable").otherwise("server_unreachable"))
        .when(whole & F.col("faulty"), "special_address")
        .when(is_("rto") & F.col("in_burst").isNotNull(), "micro_bursts")
        .when(is_("rto") & (F.col("retransmissions") >= least) & (F.col("cv") < spread), "traffic_shaping")
        .when(is_("syn") & F.col("silent"), "silently_dropped")
    )
    about = F.when(cause.isin("client_unreachable", "server_unreachable", "silently_dropped"), F.concat("dst_ip", F.lit(":"), F.col("dst_port").cast("string"))).when(cause == "special_address", F.col("range_name"))
    return d.select("group", F.col("size").alias("flows"), "retransmissions", "dst_ip", F.col("dst_ip_count").alias("to_it"), "scope", cause.alias("cause"), about.alias("cause_on"))


def window_causes(flows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Causes per group (kind) of flows that closed their window (listings.with_window_group), with a severity by runs times seconds closed."""
    g = most_frequent(flows, ["kind"], {"dst_ip": "dst_ip", "dst_port": "dst_port"})
    t = flows.groupBy("kind").agg(F.sum("zero_runs").alias("zero_runs"), F.sum("closed_us").alias("closed_us"))
    d = with_range(g.join(t, "kind"), "dst_ip", ranges).withColumn("scope", scope("dst_ip_count"))
    weight = F.col("zero_runs") * (F.col("closed_us") / 1e6)
    severity = F.when(weight > 100, "high").when(weight > 20, "medium").otherwise("low")
    cause = F.when(F.col("scope") == "all", F.when(F.coalesce("faulty", F.lit(False)), "special_address").otherwise("slow_receiver"))
    about = F.when(cause == "special_address", F.col("range_name")).when(cause == "slow_receiver", F.concat("dst_ip", F.lit(":"), F.col("dst_port").cast("string")))
    return d.select("kind", F.col("size").alias("flows"), "dst_ip", F.col("dst_ip_count").alias("to_it"), "scope", severity.alias("severity"), cause.alias("cause"), about.alias("cause_on"))


def jitter_causes(flows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Causes per severity of flows with jitter (FLOW, severity): their one destination, else the service that most of them use."""
    service = F.element_at(F.create_map(*[F.lit(x) for kv in JITTER_SERVICES.items() for x in kv]), F.col("dst_port"))
    named = F.when(F.col("dst_port").isNotNull(), F.coalesce(service, F.lit("Unknown")))
    g = most_frequent(flows, ["severity"], {"dst_ip": "dst_ip", "service": named})
    d = with_range(g, "dst_ip", ranges).withColumn("scope", scope("dst_ip_count"))
    one = F.when(F.col("range_name").isNotNull(), "special_address").otherwise("network_path")
    cause = F.when(F.col("scope") == "all", one).when(F.col("service") != "Unknown", "service")
    about = F.when(cause == "special_address", F.col("range_name")).when(cause == "network_path", F.col("dst_ip")).when(cause == "service", F.col("service"))
    return d.select("severity", F.col("size").alias("flows"), "dst_ip", F.col("dst_ip_count").alias("to_it"), "scope", cause.alias("cause"), about.alias("cause_on"))


def dns_causes(lookups: DataFrame) -> DataFrame:
    """Causes per issue (timeout, error, slow, kubernetes) of lookups (qname, server, status, rcode name).

    A name that half of them ask for; else a resolver that half of them ask; else the most frequent error.
    """
    expected = (F.col("status") == "error") & (F.col("rcode") == "NXDOMAIN") & F.col("qname").endswith(".cluster.local")
    bad = lookups.where(F.col("status").isin("timeout", "error", "slow")).withColumn("issue", F.when(expected, "kubernetes").otherwise(F.col("status")))
    name, code = F.when(F.col("qname") != "", F.col("qname")), F.when(F.col("rcode") != "NOERROR", F.col("rcode"))
    d = most_frequent(bad, ["issue"], {"qname": name, "server": "server", "code": code})
    half = lambda c: F.coalesce(F.col(f"{c}_count") * 2 >= F.col("size"), F.lit(False))
    inner = F.col("qname").contains(".cluster.local") | F.col("qname").contains(".svc.")
    cause = F.when(half("qname"), F.when(inner, "kubernetes_lookup").otherwise("repeated_name")).when(half("server"), "resolver").when(F.col("code").isNotNull(), "error_code")
    about = F.when(half("qname"), F.col("qname")).when(half("server"), F.col("server")).otherwise(F.col("code"))
    times = F.when(half("qname"), F.col("qname_count")).when(half("server"), F.col("server_count")).otherwise(F.col("code_count"))
    return d.select("issue", F.col("size").alias("lookups"), cause.alias("cause"), about.alias("cause_on"), times.alias("times"))
