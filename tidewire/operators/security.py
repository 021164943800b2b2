"""Scans, floods, exfiltration, lateral movement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import ACK, PSH, SYN, has, is_internal, is_localhost, is_private, is_tcp, ladder, syn_ack, syn_only

#: Administrative services by port, those of high risk, and ports that uploads seldom use.
ADMIN_PORTS = {135: "RPC", 139: "NetBIOS/SMB", 445: "SMB/CIFS", 593: "RPC over HTTP", 3389: "RDP", 5985: "WinRM HTTP", 5986: "WinRM HTTPS", 22: "SSH"}
HIGH_RISK_PORTS = (3389, 5985, 5986)
SUSPICIOUS_PORTS = (8080, 8443, 8888, 9000, 9001, 3128, 8123, 4444, 5555, 6666, 7777, 31337, 12345)


def _no_local() -> Column:
    return ~is_localhost(F.col("src_ip")) & ~is_localhost(F.col("dst_ip"))


def scan_events(p: DataFrame, ports: int = 10, targets: int = 10, few: int = 3, min_attempts: int = 5, fail: float = 0.7, rate: float = 5.0, skip_private: bool = False) -> DataFrame:
    """Sources that try many ports at few targets (horizontal), many targets at few ports (vertical), or both (distributed).

    Where bounds overlap, the first of these kinds that fits is taken.

    An answered attempt is the first SYN to (target, port) that a later SYN-ACK answers;
    further SYNs to it stay failed, so answers are counted per (source, target, port).
    """
    keep = _no_local() if not skip_private else _no_local() & ~(is_private(F.col("src_ip")) & is_private(F.col("dst_ip")))
    t = p.where(is_tcp() & keep)
    syn = t.where(syn_only()).groupBy("src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("n"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    back = t.where(syn_ack()).groupBy(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port")).agg(F.max("ts_us").alias("answer"))
    a = syn.join(back, ["src_ip", "dst_ip", "dst_port"], "left").withColumn("ok", F.coalesce(F.col("answer") > F.col("first"), F.lit(False)).cast("int"))
    g = a.groupBy("src_ip").agg(
        F.sum("n").alias("attempts"), F.sum("ok").alias("answered"), F.count_distinct("dst_ip").alias("targets"), F.count_distinct("dst_port").alias("ports"),
        F.min("first").alias("start_us"), (F.max("last") - F.min("first")).alias("span_us"),
    ).where((F.col("attempts") >= min_attempts) & (F.col("span_us") > 0))
    kind = F.when((F.col("ports") >= ports) & (F.col("targets") <= few), "horizontal").when((F.col("targets") >= targets) & (F.col("ports") <= few), "vertical").when((F.col("ports") >= ports) & (F.col("targets") >= targets), "distributed")
    g = g.withColumn("kind", kind).where("kind is not null")
    level = (
        F.when(F.col("kind") == "distributed", 2)
        .when(F.col("kind") == "horizontal", F.when(F.col("ports") > 50, 3).when(F.col("ports") > 25, 2).when(F.col("ports") > 15, 1).otherwise(0))
        .otherwise(F.when(F.col("targets") > 50, 3).when(F.col("targets") > 20, 2).when(F.col("targets") > 10, 1).otherwise(0))
    )
    failed = F.col("attempts") - F.col("answered")
    level = F.when((failed > fail * F.col("attempts")) & (level < 2), level + 1).otherwise(level)
    fast = F.col("attempts") * 1e6 / F.col("span_us") > rate
    level = F.when(fast, F.when(level < 2, 2).otherwise(3)).otherwise(level)
    severity = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), level.cast("int") + 1)
    return g.select("src_ip", "kind", "attempts", "answered", "targets", "ports", severity.alias("severity"), "start_us", "span_us")


def port_scans(p: DataFrame, **bounds: float) -> DataFrame:
    """scan_events without their times."""
    return scan_events(p, **bounds).drop("start_us", "span_us")


#: Packets a second of medium, high and critical floods.
FLOOD_LEVELS = {"syn_flood": (200.0, 500.0, 1000.0), "udp_flood": (1000.0, 2000.0, 5000.0), "icmp_flood": (100.0, 200.0, 500.0)}


def floods(
    p: DataFrame, syn_per_s: float = 100.0, udp_per_s: float = 500.0, icmp_per_s: float = 100.0, ratio: float = 0.1, window_us: int = 10_000_000, levels: dict[str, tuple] = FLOOD_LEVELS,
    attacks: Sequence[str] = tuple(FLOOD_LEVELS),
) -> DataFrame:
    """Floods per target: attack, dst_ip, dst_port (SYNs), severity, start_us, span_us, sources, packets, bytes, rate, top_sources.

    Opening SYNs, UDP and ICMP packets share windows per target; a window starts at its
    first packet. A flood lasts from the first of its windows to the end of the last one: a
    SYN flood's are all windows of the target, the others' those with a packet of their
    kind. Bytes, and for UDP and ICMP also sources, are those of all kinds in these windows.
    SYN floods need a rate of syn_per_s and at most `ratio` SYN-ACKs a SYN. Over 50 and 100
    sources raise the severity, and over 10,000 packets are critical. Only `attacks` are looked for.
    """
    kind = F.when(is_tcp() & syn_only(), "syn").when(F.col("protocol") == "UDP", "udp").when(F.col("protocol") == "ICMP", "icmp")
    t = p.where(_no_local()).withColumn("kind", kind).where("kind is not null").withColumn("slot", F.floor(F.col("ts_us") / window_us))
    count = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("syn", "udp", "icmp")}
    w = t.groupBy("dst_ip", "slot").agg(F.min("ts_us").alias("start"), F.sum("packet_length").alias("bytes"), *count.values())
    span = [F.min("start").alias("start_us"), (F.max("start") - F.min("start") + window_us).alias("span_us"), F.sum("bytes").alias("bytes")]
    syn = t.where("kind = 'syn'")
    back = p.where(_no_local() & is_tcp() & syn_ack()).groupBy(F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port")).agg(F.count("*").alias("answers"))
    s = syn.groupBy("dst_ip", "dst_port").agg(F.count("*").alias("packets"), F.count_distinct("src_ip").alias("sources")).join(w.groupBy("dst_ip").agg(*span), "dst_ip")
    s = s.join(back, ["dst_ip", "dst_port"], "left").where(F.coalesce("answers", F.lit(0)) <= ratio * F.col("packets")).drop("answers")
    events, froms, least = [], [], {"syn_flood": syn_per_s, "udp_flood": udp_per_s, "icmp_flood": icmp_per_s}
    if "syn_flood" in attacks:
        events.append(s.withColumn("attack", F.lit("syn_flood")))
        froms.append(syn.select(F.lit("syn_flood").alias("attack"), "dst_ip", "dst_port", "src_ip").distinct())
    met = t.select("dst_ip", "slot", "src_ip").distinct()
    for k in [k for k in ("udp", "icmp") if f"{k}_flood" in attacks]:
        own = w.where(F.col(k) > 0)
        of = met.join(own.select("dst_ip", "slot"), ["dst_ip", "slot"]).select("dst_ip", "src_ip").distinct()
        g = own.groupBy("dst_ip").agg(F.sum(k).alias("packets"), *span).join(of.groupBy("dst_ip").agg(F.count("*").alias("sources")), "dst_ip")
        events.append(g.withColumn("dst_port", F.lit(None).cast("int")).withColumn("attack", F.lit(f"{k}_flood")))
        froms.append(of.select(F.lit(f"{k}_flood").alias("attack"), "dst_ip", F.lit(None).cast("int").alias("dst_port"), "src_ip"))
    e = reduce(DataFrame.unionByName, events).withColumn("rate", F.col("packets") * 1e6 / F.col("span_us"))
    pick = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("attack"))
    e = e.where(F.col("rate") >= pick(least))
    over = lambda i: F.col("rate") > pick({k: v[i] for k, v in levels.items()})
    level = F.when(over(2), 3).when(over(1), 2).when(over(0), 1).otherwise(0)
    many = F.when(level < 2, 2).otherwise(3)
    level = F.when(F.col("packets") > 10_000, 3).when(F.col("sources") > 100, many).when((F.col("sources") > 50) & (level == 0), 1).otherwise(level)
    e = e.withColumn("severity", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), level + 1))
    key = ["attack", "dst_ip", "dst_port"]
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in key])
    x, y = reduce(DataFrame.unionByName, froms).alias("x"), e.select(*key).alias("y")
    ten = x.join(y, same(x, y), "left_semi").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("src_ip"))).where("r <= 10")
    ten = ten.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("src_ip")), ",").alias("top_sources")).alias("z")
    e = e.alias("y").join(ten, same(e.alias("y"), ten))
    return e.select(*[F.col(f"y.{c}") for c in (*key, "severity", "start_us", "span_us", "sources", "packets", "bytes", "rate")], "top_sources")


def _uploads(p: DataFrame) -> DataFrame:
    return p.where(is_internal(F.col("src_ip")) & ~is_internal(F.col("dst_ip")) & (F.col("ip_version") == 4))


def large_uploads(p: DataFrame, bytes_: int = 50_000_000, window_us: int = 300_000_000) -> DataFrame:
    """Per source the first window [t, t + window_us] whose upload reaches the threshold.

    Packets of one time are added up first. Windows are laid out over blocks of window_us,
    each row in its own block and the one before, so a busy source is spread over its blocks.
    """
    u = _uploads(p).groupBy("src_ip", "ts_us").agg(F.sum("packet_length").alias("bytes"), F.min("packet_num").alias("packet_num"))
    block = F.floor(F.col("ts_us") / window_us)
    u = u.withColumn("block", F.explode(F.array(block, block - 1)))
    w = Window.partitionBy("src_ip", "block").orderBy("ts_us").rangeBetween(0, window_us)
    u = u.withColumn("sum", F.sum("bytes").over(w)).where((F.col("sum") >= bytes_) & (block == F.col("block")))
    g = u.groupBy("src_ip").agg(F.min(F.struct("ts_us", "packet_num", "sum")).alias("x"))
    size = F.col("x.sum")
    severity = ladder(size, ((bytes_ * 10, "critical"), (bytes_ * 4, "high"), (bytes_ * 2, "medium")), "low")
    return g.select("src_ip", F.col("x.ts_us").alias("start_us"), size.alias("bytes"), severity.alias("severity"))


def upload_ratios(p: DataFrame, bytes_: int = 10_000_000, ratio: float = 5.0) -> DataFrame:
    """Sources that send far more out than they get back; nothing back counts as infinite."""
    up = _uploads(p).groupBy(F.col("src_ip").alias("ip")).agg(F.sum("packet_length").alias("up"))
    down = p.where(is_internal(F.col("dst_ip")) & ~is_internal(F.col("src_ip"))).groupBy(F.col("dst_ip").alias("ip")).agg(F.sum("packet_length").alias("down"))
    g = up.join(down, "ip", "left").withColumn("down", F.coalesce("down", F.lit(0)))
    g = g.withColumn("ratio", F.when(F.col("down") > 0, F.col("up") / F.col("down").cast("double"))).where((F.col("up") >= bytes_) & (F.col("ratio").isNull() | (F.col("ratio") >= ratio)))
    severity = F.when(F.col("ratio").isNull(), "critical").when(F.col("ratio") >= 20, "high").when(F.col("ratio") >= 10, "medium").otherwise("low")
    return g.select("ip", "up", "down", severity.alias("severity"))


def upload_ports(p: DataFrame, bytes_: int = 5_000_000) -> DataFrame:
    g = _uploads(p).where(F.col("dst_port").isin(*SUSPICIOUS_PORTS)).groupBy("src_ip", "dst_port").agg(F.sum("packet_length").alias("bytes"), F.count("*").alias("packets"))
    return g.where(F.col("bytes") >= bytes_)


def _admin(p: DataFrame) -> DataFrame:
    """Packets between two internal hosts to an administrative port."""
    inside = is_internal(F.col("src_ip")) & is_internal(F.col("dst_ip")) & (F.col("src_ip") != F.col("dst_ip"))
    return p.where(is_tcp() & inside & F.col("dst_port").isin(*ADMIN_PORTS))


def lateral_targets(p: DataFrame, least: int = 3) -> DataFrame:
    """Sources that reach `least` internal hosts at administrative ports, by any packet."""
    g = _admin(p).groupBy("src_ip").agg(
        F.count_distinct("dst_ip").alias("targets"), F.count_distinct("dst_port").alias("ports"), F.count_if(has(SYN)).alias("syns"),
        F.max(F.col("dst_port").isin(*HIGH_RISK_PORTS)).alias("risky"),
    ).where(F.col("targets") >= least)
    n = F.col("targets")
    severity = F.when(n >= 10, "critical").when(n >= 7, "high").when(n >= 5, "medium").when(F.col("risky"), "high").otherwise("medium")
    return g.withColumn("severity", severity).drop("risky")


def lateral_spread(p: DataFrame, least: int = 3, min_syns: int = 5) -> DataFrame:
    """Sources of min_syns administrative SYNs that open one protocol to `least` internal hosts."""
    syns = _admin(p).where(has(SYN))
    busy = syns.groupBy("src_ip").agg(F.count("*").alias("all")).where(F.col("all") >= min_syns).select("src_ip")
    g = syns.groupBy("src_ip", "dst_port").agg(F.count_distinct("dst_ip").alias("targets")).where(F.col("targets") >= least).join(busy, "src_ip")
    n = F.col("targets")
    risky = F.when(n >= 5, "critical").otherwise("high")
    severity = F.when(F.col("dst_port").isin(*HIGH_RISK_PORTS), risky).otherwise(F.when(n >= 10, "high").otherwise("medium"))
    names = F.create_map(*[F.lit(x) for kv in ADMIN_PORTS.items() for x in kv])
    return g.select("src_ip", F.element_at(names, F.col("dst_port")).alias("service"), "targets", severity.alias("severity"))


def admin_syns(p: DataFrame) -> DataFrame:
    """SYNs between internal hosts to administrative ports."""
    return _admin(p).where(has(SYN))


def apart(df: DataFrame, keys: Sequence[str], apart_us: int) -> DataFrame:
    """Rows of each key that come over apart_us after the last one taken, the first one included: keys, ts_us.

    A gap of over apart_us between neighbours starts anew whatever was taken before, so times
    are cut there by a window and only what lies between two such gaps is taken by a fold.
    """
    w = Window.partitionBy(*keys).orderBy("ts_us", "packet_num")
    start = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) > apart_us, F.lit(True)).cast("bigint")
    t = df.select(*keys, "ts_us", "packet_num", start.alias("start")).withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    times = F.array_sort(F.collect_list("ts_us"))
    taken = F.aggregate("times", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > apart_us), F.concat(acc, F.array(x))).otherwise(acc))
    alone = F.array(F.min("ts_us"))  # most runs: one row, or all of them within apart_us of the first
    g = t.groupBy(*keys, "run").agg(F.when(F.max("ts_us") - F.min("ts_us") > apart_us, times).otherwise(alone).alias("times"))
    return g.select(*keys, F.explode(taken).alias("ts_us"))


def lateral_rapid(p: DataFrame, least: int = 3, window_us: int = 300_000_000, apart_us: int = 5_000_000) -> DataFrame:
    """Per source the first window [t, t + window_us] with `least` targets; a SYN within apart_us of the last one taken for its target doesn't count.

    Windows are laid out over blocks of window_us, each row in its own block and the one
    before, so a busy source is spread over its blocks and a frame holds at most two.
    """
    d = apart(admin_syns(p), ("src_ip", "dst_ip"), apart_us)
    block = F.floor(F.col("ts_us") / window_us)
    d = d.withColumn("block", F.explode(F.array(block, block - 1)))
    w = Window.partitionBy("src_ip", "block").orderBy("ts_us").rangeBetween(0, window_us)
    d = d.withColumn("targets", F.size(F.collect_set("dst_ip").over(w))).where((F.col("targets") >= least) & (block == F.col("block")))
    g = d.groupBy("src_ip").agg(F.min(F.struct("ts_us", "targets")).alias("x"))
    return g.select("src_ip", F.col("x.ts_us").alias("start_us"), F.col("x.targets").cast("bigint").alias("targets"))


#: Services that ask for a password, by port, and the ports among them that matter most.
AUTH_PORTS = {
    21: "FTP", 22: "SSH", 23: "Telnet", 80: "HTTP", 443: "HTTPS", 445: "SMB", 1433: "MSSQL", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL",
    5900: "VNC", 6379: "Redis", 8080: "HTTP-Alt", 8443: "HTTPS-Alt", 27017: "MongoDB",
}
CRITICAL_PORTS = (22, 3389, 445)


def brute_force(p: DataFrame, least: int = 10, fail: float = 0.7, success: float = 0.9, private: bool = False) -> DataFrame:
    """Sources with many failed attempts at one login service.

    Of each source and service, the first PSH-ACK of a 4-tuple after a SYN establishes the
    last attempt before it. Localhost is left out, and unless `private` also what two
    private addresses exchange.
    """
    service = ["src_ip", "dst_ip", "dst_port"]
    keep = _no_local() if private else _no_local() & ~(is_private(F.col("src_ip")) & is_private(F.col("dst_ip")))
    t = p.where(is_tcp() & keep & F.col("dst_port").isin(*AUTH_PORTS) & F.col("tcp_flags").isNotNull())
    t = t.where(syn_only() | (has(PSH) & has(ACK))).select(*service, "src_port", "ts_us", "packet_num", syn_only().alias("syn"))
    order = [F.col(c).asc_nulls_last() for c in ("ts_us", "packet_num")]
    before = Window.partitionBy(*service).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("attempt", F.sum(F.col("syn").cast("bigint")).over(before))
    us = F.when(F.col("syn"), F.col("ts_us"))
    g = t.groupBy(*service, "src_port").agg(
        F.count_if("syn").alias("attempts"), F.min(us).alias("first_us"), F.max(us).alias("last_us"),
        F.min(F.when(~F.col("syn") & (F.col("attempt") > 0), F.col("attempt"))).alias("attempt"),
    )
    g = g.groupBy(*service).agg(
        F.sum("attempts").alias("attempts"), F.count_distinct("attempt").alias("established"),
        F.coalesce(F.min("first_us"), F.lit(0)).alias("first_us"), F.coalesce(F.max("last_us"), F.lit(0)).alias("last_us"),
    )
    n, failed = F.col("attempts"), F.col("attempts") - F.col("established")
    g = g.where((n >= least) & (failed > fail * n) & (F.col("established") <= success * n))
    level = F.when(n > 50, 3).when(n > 30, 2).when(n > 20, 1).otherwise(0)
    raised = lambda x, c: F.when(c, F.when(x < 2, 2).when(x == 2, 3).otherwise(x)).otherwise(x)
    level = raised(level, failed > 0.9 * n)
    level = raised(level, n * 1e6 > 2.0 * F.greatest(F.col("last_us") - F.col("first_us"), F.lit(1000)))
    level = F.when(F.col("dst_port").isin(*CRITICAL_PORTS) & (level < 2), level + 1).otherwise(level)
    return g.withColumn("severity", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), level + 1))


def event_breakdown(events: DataFrame) -> DataFrame:
    """Counts of detector events (kind, severity, src_ip) by kind, by severity, by both and over all."""
    return events.groupingSets([("kind", "severity"), ("kind",), ("severity",), ()], "kind", "severity").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("events")
    )


def all_events(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """kind, src_ip, severity of several detectors' rows, given as (kind, rows, address column)."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), F.col(c).alias("src_ip"), "severity") for k, d, c in parts])


def top_attackers(events: DataFrame, k: int = 10) -> DataFrame:
    """Sources of the k worst brute_force events: attacks, targets, services, attempts and the worst severity; the worst first."""
    order = F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("severity"))
    worst = events.withColumn("level", order).orderBy(F.desc("level"), "first_us", "src_ip", "dst_ip", "dst_port").limit(k)
    g = worst.groupBy("src_ip").agg(
        F.count("*").alias("attacks"), F.count_distinct("dst_ip").alias("targets"), F.array_join(F.array_sort(F.collect_set(_service())), ",").alias("services"), F.sum("attempts").alias("attempts"), F.max("level").alias("level"),
    )
    g = g.orderBy(F.desc("level"), F.desc("attacks"), "src_ip")
    return g.select("src_ip", "attacks", "targets", "services", "attempts", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("level").cast("int")).alias("severity"))


def _service() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in AUTH_PORTS.items() for x in kv]), F.col("dst_port"))
