"""Gaps, jitter, bursts, temporal patterns and beacons. Times are integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import FLOW, RST, FIN, exact_median, has, is_internal, ranked, syn_only, value_at
from ..thresholds import Thresholds

FIVE = ("protocol", *FLOW)


def gap_limit_us(t: Thresholds = Thresholds()) -> Column:
    """The gap above which a flow counts as silent, by protocol and port."""
    port = lambda *x: F.coalesce(F.col("dst_port").isin(*x) | F.col("src_port").isin(*x), F.lit(False))
    us = lambda s: F.lit(int(s * 1_000_000)).cast("bigint")
    return (
        F.when((F.col("protocol") == "TCP") & port(22, 23), us(t.gap_interactive_s))
        .when(F.col("protocol") == "TCP", us(t.gap_tcp_s))
        .when((F.col("protocol") == "UDP") & port(53), us(t.gap_dns_s))
        .when(F.col("protocol") == "ICMP", us(t.gap_icmp_s))
        .otherwise(us(t.gap_other_s))
    )


def with_gaps(p: DataFrame) -> DataFrame:
    """p plus prev_us and gap_us against the flow's previous packet.

    TCP and UDP flows are 4-tuples; DNS, and what is neither TCP nor UDP, goes by source.
    """
    udp = F.col("protocol") == "UDP"
    dns = udp & ((F.coalesce("src_port", F.lit(0)) == 53) | (F.coalesce("dst_port", F.lit(0)) == 53))
    flow = (F.col("protocol") == "TCP") | (udp & ~dns)
    key = [F.when(dns, "DNS").otherwise(F.col("protocol")), F.col("src_ip"), *[F.when(flow, F.col(c)) for c in ("src_port", "dst_ip", "dst_port")]]
    w = Window.partitionBy(*key).orderBy("ts_us", "packet_num")
    return p.withColumn("prev_us", F.lag("ts_us").over(w)).withColumn("gap_us", F.col("ts_us") - F.col("prev_us"))


def gaps(p: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return with_gaps(p).where(F.col("gap_us") > gap_limit_us(t)).select(
        "packet_num", (F.col("packet_num") - 1).alias("packet_before"), "protocol", "src_ip", "dst_ip", "gap_us"
    )


def gap_periodicity(p: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row: number of gaps, their mean, coefficient of variation and whether they are periodic."""
    g = gaps(p, t).agg(F.count("*").alias("n"), F.sum("gap_us").alias("s"), F.sum(F.col("gap_us").cast("decimal(38,0)") * F.col("gap_us")).alias("q"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n").cast("double"))
    var = F.when(F.col("n") > 1, (F.col("q").cast("double") - F.col("s") * mean) / (F.col("n") - 1))
    g = g.withColumn("mean_us", mean).withColumn("cv", F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("mean_us"))
    return g.select("n", "mean_us", (F.coalesce((F.col("n") >= 3) & (F.col("cv") < 0.1), F.lit(False))).alias("periodic"))


def marked_gaps(p: DataFrame, t: Thresholds = Thresholds(), near: float = 0.2) -> DataFrame:
    """gaps with whether each is abnormal: where they are periodic as a whole, those within `near` of their mean are not."""
    beat = F.broadcast(gap_periodicity(p, t).select("mean_us", "periodic"))  # one row
    off = F.abs(F.col("gap_us") - F.col("mean_us")) / F.col("mean_us")
    return gaps(p, t).crossJoin(beat).withColumn("abnormal", ~F.col("periodic") | (off > near)).drop("mean_us", "periodic")


def interval_statistics(p: DataFrame, block_us: int = 3_600_000_000) -> DataFrame:
    """One row over the times between neighbouring packets of the whole capture: number, least, most, mean, median, sample deviation, and packets a second.

    Neighbours are found within blocks of time, and between blocks by their first and last packets.
    """
    w = Window.partitionBy("block").orderBy("ts_us", "packet_num")
    t = p.select("ts_us", "packet_num", F.floor(F.col("ts_us") / block_us).alias("block"))
    inner = t.select((F.col("ts_us") - F.lag("ts_us").over(w)).alias("d"))
    b = t.groupBy("block").agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    d = inner.unionByName(b.select((F.col("first") - F.lag("last").over(Window.orderBy("block"))).alias("d"))).where("d is not null")
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    g = d.agg(F.count("*").alias("n"), F.min("d").alias("min_us"), F.max("d").alias("max_us"), F.sum("d").alias("s"), F.sum(F.col("d").cast("decimal(38,0)") * F.col("d")).cast("double").alias("q"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("q") * n - s * s) / (n * (n - 1)), F.lit(0.0))))
    g = g.crossJoin(F.broadcast(exact_median(d, "d", "median_us")))
    return g.select("n", "min_us", "max_us", (s / n).alias("mean_us"), "median_us", spread.alias("stdev_us"), F.when(F.col("s") > 0, (F.col("n") + 1) * 1e6 / s).otherwise(0.0).alias("packets_per_s"))


def sessions(p: DataFrame, gap_us: int = 60_000_000, syn_gap_us: int = 1_000_000, close_gap_us: int = 100_000) -> DataFrame:
    """p plus session: a flow's packets cut at long gaps, at a SYN after a pause and after a close."""
    w = Window.partitionBy(*FIVE).orderBy("ts_us", "packet_num")
    lag_us = F.col("ts_us") - F.lag("ts_us").over(w)
    closed = F.lag(has(RST) | has(FIN)).over(w)
    new = (lag_us > gap_us) | (syn_only() & (lag_us > syn_gap_us)) | (closed & (lag_us > close_gap_us))
    p = p.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int"))
    return p.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def jitter(p: DataFrame, **cuts: int) -> DataFrame:
    """Second-order differences of arrival times, per packet that has two predecessors in its session."""
    keys = [*FIVE, "session"]
    w = Window.partitionBy(*keys).orderBy("ts_us", "packet_num")
    d = sessions(p, **cuts).withColumn("delay", F.col("ts_us") - F.lag("ts_us").over(w))
    return d.withColumn("jitter_us", F.abs(F.col("delay") - F.lag("delay").over(w))).where("jitter_us is not null").select(*keys, "packet_num", "ts_us", "jitter_us", F.col("delay").alias("delay_us"))


def _stats(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    g = ranked(df, keys, "jitter_us").groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("jitter_us").alias("total_us"), F.min("jitter_us").alias("min_us"), F.max("jitter_us").alias("max_us"),
        value_at("jitter_us", 0.95).alias("p95_us"), value_at("jitter_us", 0.99).alias("p99_us"),
    )
    return g.withColumn("mean_us", F.col("total_us") / F.col("n").cast("double"))


def jitter_flow_stats(p: DataFrame, **cuts: int) -> DataFrame:
    return _stats(jitter(p, **cuts), FIVE)


def jitter_filtered_stats(p: DataFrame, longest_us: int = 60_000_000, **cuts: int) -> DataFrame:
    """jitter_flow_stats without the values that follow a delay of longest_us or more."""
    return _stats(jitter(p, **cuts).where(F.col("delay_us") < longest_us), FIVE)


def jitter_global(p: DataFrame, **cuts: int) -> DataFrame:
    """One row over all flows: number, least, most and mean of the values, from counts per value."""
    per = jitter(p, **cuts).groupBy("jitter_us").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("n"), F.min("jitter_us").alias("min_us"), F.max("jitter_us").alias("max_us"), (F.sum(F.col("jitter_us") * F.col("c")) / F.sum("c").cast("double")).alias("mean_us"))


def jitter_sessions(p: DataFrame, min_packets: int = 3, **cuts: int) -> DataFrame:
    g = sessions(p, **cuts).groupBy(*FIVE, "session").agg(F.count("*").alias("packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return g.where(F.col("packets") >= min_packets)


def jitter_trend(p: DataFrame, high_us: int = 50_000, factor: float = 1.5, **cuts: int) -> DataFrame:
    """Per flow the mean jitter of its first and last quarter (a quarter has max(1, n // 4) values) and a trend.

    degrading: the last quarter exceeds factor times the first, and high_us; high: the mean
    exceeds high_us; stable: all others, and flows of fewer than three values.
    """
    order = Window.partitionBy(*FIVE).orderBy("session", "packet_num")
    j = jitter(p, **cuts).withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*FIVE)))
    j = j.withColumn("q", F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("bigint"))
    mean = lambda c, n, name: (F.sum(F.when(c, F.col("jitter_us"))) / F.max(n).cast("double")).alias(name)
    g = j.groupBy(*FIVE).agg(
        F.max("n").alias("n"), mean(F.col("r") <= F.col("q"), "q", "first_us"), mean(F.col("r") > F.col("n") - F.col("q"), "q", "last_us"), mean(F.lit(True), "n", "mean_us"),
    )
    degrading = (F.col("last_us") > F.col("first_us") * factor) & (F.col("last_us") > high_us)
    return g.withColumn("trend", F.when(F.col("n") < 3, "stable").when(degrading, "degrading").when(F.col("mean_us") > high_us, "high").otherwise("stable"))


def jitter_severity(protocol: Column, p95_ms: Column) -> Column:
    udp = F.when(p95_ms < 20, "excellent").when(p95_ms < 30, "low").when(p95_ms < 50, "medium").otherwise("critical")
    tcp = F.when(p95_ms < 100, "low").when(p95_ms < 200, "medium").otherwise("critical")
    return F.when(protocol == "UDP", udp).otherwise(tcp)


def bursts(p: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Runs of busy intervals: at least burst_factor times the mean of intervals with traffic (and a floor).

    Rows are counted per interval first; windows run over the busy intervals alone.
    """
    width = t.burst_interval_us
    b = p.groupBy(F.floor(F.col("ts_us") / width).alias("b")).agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"))
    mean = b.agg((F.sum("packets") / F.count("*").cast("double")).alias("mean"))
    busy = b.crossJoin(F.broadcast(mean)).where(F.col("packets") >= F.greatest(F.col("mean") * t.burst_factor, F.lit(float(t.burst_min_packets))))
    w = Window.orderBy("b")
    new = F.coalesce((F.col("b") - F.lag("b").over(w)) * width > t.burst_merge_us, F.lit(True))
    runs = busy.withColumn("burst_id", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("burst_id").agg(
        (F.min("b") * width).alias("start_us"), ((F.max("b") + 1) * width).alias("end_us"), F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"), F.count("*").alias("intervals"), F.max("mean").alias("mean"),
    )
    return g.withColumn("peak_ratio", F.col("packets") / F.col("intervals").cast("double") / F.col("mean")).drop("mean")


def burst_top_sources(p: DataFrame, t: Thresholds = Thresholds(), k: int = 5) -> DataFrame:
    """The k busiest sources of each burst; bursts are laid out over their intervals, so they meet sources by an equi-join."""
    width = t.burst_interval_us
    at = lambda c: F.floor(F.col(c) / width).cast("bigint")
    b = bursts(p, t).select("burst_id", F.explode(F.sequence(at("start_us"), at("end_us") - 1)).alias("b"))
    per = p.groupBy("src_ip", at("ts_us").alias("b")).agg(F.count("*").alias("c"))
    g = per.join(b, "b").groupBy("burst_id", "src_ip").agg(F.sum("c").alias("packets"))
    w = Window.partitionBy("burst_id").orderBy(F.desc("packets"), "src_ip")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def slots(p: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return p.groupBy(F.floor(F.col("ts_us") / t.slot_us).alias("slot")).agg(
        F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"), F.count_distinct("src_ip").alias("sources"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp"), F.count_if(F.col("protocol") == "UDP").alias("udp"),
    )


def _against_mean(p: DataFrame, t: Thresholds) -> DataFrame:
    s = slots(p, t).select("slot", "packets")
    m = s.agg(F.count("*").alias("n"), F.sum("packets").alias("s"), F.sum(F.col("packets") * F.col("packets")).alias("q"))
    m = m.select((F.col("s") / F.col("n").cast("double")).alias("mean"), F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")).cast("double")).alias("sd"))
    return s.crossJoin(F.broadcast(m))


def peaks(p: DataFrame, t: Thresholds = Thresholds(), k: int = 20) -> DataFrame:
    d = _against_mean(p, t).where(F.col("packets") > F.col("mean") + 2 * F.col("sd"))
    return d.select("slot", "packets").orderBy(F.desc("packets"), "slot").limit(k)


def valleys(p: DataFrame, t: Thresholds = Thresholds(), k: int = 10, min_mean: float = 10.0, share: float = 0.3) -> DataFrame:
    low = (F.col("mean") > min_mean) & (F.col("packets") < F.col("mean") - 1.5 * F.col("sd")) & (F.col("packets") < F.col("mean") * share)
    return _against_mean(p, t).where(low).select("slot", "packets").orderBy("packets", "slot").limit(k)


def hourly(p: DataFrame) -> DataFrame:
    h = F.floor(F.col("ts_us") / 3_600_000_000) % 24
    return p.groupBy(h.cast("bigint").alias("hour")).agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"))


def periodic(p: DataFrame, low_us: int = 1_000_000, high_us: int = 300_000_000, unit_us: int = 1_000_000, top: int = 20, min_count: int = 5, share: float = 0.3) -> DataFrame:
    """Intervals (in units, half to even) that a busy source keeps to: at least min_count times and `share` of its intervals."""
    busy = p.groupBy("src_ip").agg(F.count("*").alias("n")).where("n >= 10").orderBy(F.desc("n"), "src_ip").limit(top).select("src_ip")
    w = Window.partitionBy("src_ip").orderBy("ts_us", "packet_num")
    d = p.join(F.broadcast(busy), "src_ip", "left_semi").withColumn("d", F.col("ts_us") - F.lag("ts_us").over(w))
    d = d.where(F.col("d").between(low_us, high_us))
    g = d.groupBy("src_ip", F.bround(F.col("d") / float(unit_us)).cast("bigint").alias("interval")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("src_ip"))
    g = g.withColumn("total", total).where((F.col("count") >= min_count) & (F.col("count") >= share * F.col("total")))
    r = F.row_number().over(Window.partitionBy("src_ip").orderBy(F.desc("count"), "interval"))
    return g.withColumn("rank", r).where("rank <= 3")


def timeline(p: DataFrame, t: Thresholds = Thresholds(), points: int = 100) -> DataFrame:
    """Every max(1, n // points)-th slot in time order; the window runs over slots, not packets."""
    s = slots(p, t).select("slot", "packets")
    n = s.agg(F.greatest(F.lit(1), F.floor(F.count("*") / points)).alias("step"))
    r = s.withColumn("r", F.row_number().over(Window.orderBy("slot"))).crossJoin(F.broadcast(n))
    return r.where((F.col("r") - 1) % F.col("step") == 0).select("slot", "packets")


def beacons(p: DataFrame, min_n: int = 10, max_cv: float = 0.3, size_cv: float = 0.2, min_interval_us: int = 2_000_000, known_s: tuple[int, ...] = (1, 2, 3, 5, 10, 15, 30, 60), monitoring: tuple[int, ...] = (161, 162, 123), least: int = 60) -> DataFrame:
    """Source, destination and port that speak at even intervals, scored 0 to 100.

    Spread comes from integer sums of intervals and sizes, so it does not depend on order.
    """
    keys = ("src_ip", "dst_ip", "dst_port")
    w = Window.partitionBy(*keys).orderBy("ts_us", "packet_num")
    d = p.where(F.col("protocol").isin("TCP", "UDP") & ~F.col("dst_port").isin(*monitoring))
    d = d.withColumn("ms", F.floor((F.col("ts_us") - F.lag("ts_us").over(w)) / 1000))
    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)") * F.col(c)).cast("decimal(38,0)")
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("ms").alias("ms"), big("ms").alias("ms2"), F.sum("packet_length").alias("len"), big("packet_length").alias("len2")
    ).where(F.col("n") >= min_n)

    def cv(s: str, q: str, n: Column) -> Column:
        total, squares, n = F.col(s).cast("decimal(20,0)"), F.col(q), n.cast("decimal(10,0)")
        var = (squares * n - total * total).cast("double") / (n * (n - 1)).cast("double")
        return F.sqrt(var) / (F.col(s) / n.cast("double"))

    g = g.withColumn("mean_ms", F.col("ms") / (F.col("n") - 1).cast("double")).withColumn("cv", cv("ms", "ms2", F.col("n") - 1)).withColumn("scv", cv("len", "len2", F.col("n")))
    near = [F.abs(F.col("mean_ms") - 1000.0 * s) <= 200.0 * s for s in known_s]
    usual = near[0]
    for x in near[1:]:
        usual = usual | x
    pt = lambda c, v: F.when(c, v).otherwise(0)
    score = pt(F.col("cv") <= max_cv, 40) + pt(F.col("scv") <= size_cv, 30) + pt(F.col("n") >= 20, 20) + pt(~is_internal(F.col("dst_ip")), 10)
    g = g.where((F.col("mean_ms") * 1000 >= min_interval_us) & ~usual).withColumn("score", score).where(F.col("score") >= least)
    severity = F.when(F.col("score") >= 90, "critical").when(F.col("score") >= 80, "high").when(F.col("score") >= 70, "medium").otherwise("low")
    return g.select(*keys, "n", "mean_ms", "score", severity.alias("severity"))
