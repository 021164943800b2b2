"""Ordered listings of detector events and flows, and the tables that are exported as CSV.

A listing is an order with a limit; its rows carry their place, so that they can be
stored and read in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import ACK, ENDS, FIN, FLOW, RST, SYN, has, is_tcp, with_ends
from ..operators.tcp import IN_ORDER, classified_resets, exact_retransmissions
from ..operators.timing import FIVE, jitter_severity

#: Severities from the worst on.
SEVERITIES = ("critical", "high", "medium", "low")


def first_rows(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of df in this order, with their place from 1 on; the window runs over those k rows alone."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def by_severity(events: DataFrame, *then: Column | str, k: int = 20) -> DataFrame:
    """The k worst events: by severity, then as given."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return first_rows(events, [rank, *then], k)


def slowest_retransmissions(p: DataFrame, k: int = 20) -> DataFrame:
    return first_rows(exact_retransmissions(p).drop("ts_us"), [F.desc("delay_us"), "packet_num"], k)


def worst_round_trips(stats: DataFrame, k: int = 10) -> DataFrame:
    return first_rows(stats, [F.desc("max_us"), *FLOW], k)


def slowest_attempts(delays: DataFrame, k: int = 10) -> DataFrame:
    return first_rows(delays, [F.desc("delay_us"), *FLOW, "first_us"], k)


def worst_burst(bursts: DataFrame) -> DataFrame:
    """The burst with the highest peak ratio (ties: the earliest)."""
    return bursts.orderBy(F.desc("peak_ratio"), "start_us").limit(1)


def earliest_bursts(bursts: DataFrame, k: int = 50) -> DataFrame:
    return first_rows(bursts, ["start_us", "burst_id"], k)


def earliest_resets(p: DataFrame, k: int = 20) -> DataFrame:
    """The first k RST packets with what their conversation had seen by then."""
    times = p.where(is_tcp() & has(RST)).select("packet_num", "ts_us")
    return first_rows(classified_resets(p).join(times, "packet_num"), ["ts_us", "packet_num"], k)


def strongest_patterns(patterns: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent of timing.periodic, with their share in percent of the source's intervals."""
    share = F.round(F.col("count") / F.col("total").cast("double") * 100.0, 1).alias("confidence")
    return first_rows(patterns.select("src_ip", "interval", "count", share), [F.desc("count"), "src_ip", "interval"], k)


def flood_targets(floods: DataFrame, k: int = 10) -> DataFrame:
    """The k targets of most floods."""
    return first_rows(floods.groupBy("dst_ip").agg(F.count("*").alias("floods")), [F.desc("floods"), "dst_ip"], k)


def tunnel_domains(tunnels: DataFrame, k: int = 10) -> DataFrame:
    """The k domains that most sources tunnel to."""
    return first_rows(tunnels.groupBy("domain").agg(F.count("*").alias("sources"), F.sum("queries").alias("queries")), [F.desc("sources"), "domain"], k)


def ranked_events(events: DataFrame) -> DataFrame:
    """All events (kind, src_ip, severity) with the rank of their severity from 1, the worst, on; order by it to list them."""
    return events.withColumn("rank", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int"))


def top_scanners(scans: DataFrame, k: int = 10) -> DataFrame:
    """Sources of the k worst scans (security.scan_events): scans, most targets and ports of one, attempts, and the worst severity."""
    worst = by_severity(scans, "start_us", "src_ip", k=k)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    g = worst.groupBy("src_ip").agg(F.count("*").alias("scans"), F.max("targets").alias("targets"), F.max("ports").alias("ports"), F.sum("attempts").alias("attempts"), F.min(rank).alias("rank"))
    g = g.withColumn("severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int")))
    return first_rows(g, ["rank", F.desc("scans"), "src_ip"], k).drop("rank")


def top_sacks(conversations: DataFrame, k: int = 20) -> DataFrame:
    return first_rows(conversations, [F.desc("sacks"), *ENDS], k)


def top_dsacks(conversations: DataFrame, k: int = 10) -> DataFrame:
    return first_rows(conversations.where("dsacks > 0").select(*ENDS, "dsacks", "sacks", "dsack_share"), [F.desc("dsacks"), *ENDS], k)


def severity_shares(rows: DataFrame) -> DataFrame:
    """severity, n, share in percent, of rows with a severity; the window for the total runs over the few severities."""
    g = rows.groupBy("severity").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double") * 100.0)


def confidence_overview(retransmissions: DataFrame) -> DataFrame:
    """One row over folds.retransmissions: how many are of high and medium confidence, and that of the whole (high above 60 % high, medium above half high or medium)."""
    g = retransmissions.agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"))
    whole = F.when(F.col("n") == 0, "none").when(F.col("high") > 0.6 * F.col("n"), "high").when(F.col("high") + F.col("medium") > 0.5 * F.col("n"), "medium").otherwise("low")
    return g.withColumn("confidence", whole)


def longest_idle(states: DataFrame, k: int = 10) -> DataFrame:
    """The k connections of each state that have been idle longest."""
    ends = [c for c in states.columns if c not in ("packets", "idle_us", "state")]
    w = Window.partitionBy("state").orderBy(F.desc("idle_us"), *ends)
    return states.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def jitter_offenders(stats: DataFrame, high_us: int = 30_000, k: int = 10) -> DataFrame:
    """Flows whose mean or 95th percentile exceeds high_us, by that percentile, with their severity."""
    d = stats.where((F.col("p95_us") > high_us) | (F.col("mean_us") > high_us))
    d = d.select(*FIVE, "n", "mean_us", "p95_us", "max_us", jitter_severity(F.col("protocol"), F.col("p95_us") / 1000.0).alias("severity"))
    return first_rows(d, [F.desc("p95_us"), *FIVE], k)


def retransmission_context(p: DataFrame, forward: int = 5, reverse: int = 5, most: int = 10) -> DataFrame:
    """The packets around each retransmission: packet_num, n_forward, n_reverse, context (numbers in order of time, joined by commas).

    The last `forward` packets of its direction, itself included, and of the other direction
    the last `reverse` ones before it that are no earlier than the first of these; merged by
    time (the own direction first where times are equal) and cut to the first `most`. Windows
    over the conversation number the packets, so the other direction's are looked up by
    place, for retransmissions only.
    """
    side = ("up", *ENDS)
    t = with_ends(p.where(is_tcp())).withColumn("up", (F.col("src_ip") == F.col("ip_a")) & F.col("src_port").eqNullSafe(F.col("port_a")))
    one = Window.partitionBy(*ENDS, "up").orderBy(*IN_ORDER)
    t = t.withColumn("all", F.row_number().over(Window.partitionBy(*ENDS).orderBy(*IN_ORDER))).withColumn("place", F.row_number().over(one))
    entry = F.struct("ts_us", F.lit(0).alias("other"), "place", "packet_num")
    t = t.withColumn("own", F.collect_list(entry).over(one.rowsBetween(1 - forward, 0)))
    sends = (F.col("tcp_payload_len") > 0) | has(SYN) | has(FIN)
    segment = Window.partitionBy(*ENDS, "up", sends, "tcp_seq", "tcp_payload_len").orderBy(*IN_ORDER)
    t = t.withColumn("again", sends & (F.row_number().over(segment) > 1)).withColumn("before", F.col("all") - F.col("place"))
    r = t.where("again").select(*side, "place", "packet_num", "own", "before")
    asked = r.where("before > 0").select(
        (~F.col("up")).alias("up"), *ENDS, F.col("place").alias("of"), F.get("own", F.lit(0))["ts_us"].alias("since"),
        F.explode(F.sequence(F.greatest(F.col("before") - reverse + 1, F.lit(1)), F.col("before"))).alias("place"),
    )
    there = t.select(*side, "place", F.struct("ts_us", F.lit(1).alias("other"), "place", "packet_num").alias("x"))
    met = asked.join(there, [*side, "place"]).where(F.col("x.ts_us") >= F.col("since"))
    met = met.groupBy((~F.col("up")).alias("up"), *ENDS, F.col("of").alias("place")).agg(F.collect_list("x").alias("theirs"))
    d = r.join(met, [*side, "place"], "left").withColumn("theirs", F.coalesce("theirs", F.array().cast(met.schema["theirs"].dataType)))
    merged = F.slice(F.array_sort(F.concat("own", "theirs")), F.lit(1), F.lit(most))
    return d.select("packet_num", F.size("own").cast("bigint").alias("n_forward"), F.size("theirs").cast("bigint").alias("n_reverse"), F.array_join(F.transform(merged, lambda x: x["packet_num"].cast("string")), ",").alias("context"))


def round_trip_summary(rtt: DataFrame, warning_us: int = 100_000, critical_us: int = 500_000) -> DataFrame:
    """One row over all round trips: number, least, most, mean, sample deviation, and how many are high or critical."""
    us, n = F.col("rtt_us"), F.col("n").cast("double")
    g = rtt.agg(
        F.count("*").alias("n"), F.min(us).alias("min_us"), F.max(us).alias("max_us"), F.sum(us).cast("double").alias("s"),
        F.sum(us.cast("decimal(38,0)") * us).cast("double").alias("q"), F.count_if(us > warning_us).alias("high"), F.count_if(us > critical_us).alias("critical"),
    )
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("q") * n - F.col("s") * F.col("s")) / (n * (n - 1)), F.lit(0.0))))
    return g.select("n", "min_us", "max_us", (F.col("s") / n).alias("mean_us"), spread.alias("stdev_us"), "high", "critical")


def shaped_flows(p: DataFrame, least: int = 10, spread: float = 0.3) -> DataFrame:
    """Flows whose retransmissions come at even intervals (coefficient of variation below `spread`), as behind a rate limit."""
    w = Window.partitionBy(*FLOW).orderBy(*IN_ORDER)
    d = exact_retransmissions(p).withColumn("d", F.col("ts_us") - F.lag("ts_us").over(w))
    g = d.groupBy(*FLOW).agg(F.count("*").alias("n"), F.sum("d").cast("double").alias("s"), F.sum(F.col("d").cast("decimal(38,0)") * F.col("d")).cast("double").alias("q"))
    m = (F.col("n") - 1).cast("double")
    g = g.where((F.col("n") >= least) & (F.col("s") > 0)).withColumn("mean_us", F.col("s") / m)
    g = g.withColumn("cv", F.sqrt(F.greatest(F.col("q") / m - F.col("mean_us") * F.col("mean_us"), F.lit(0.0))) / F.col("mean_us"))
    return g.where(F.col("cv") < spread).select(*FLOW, "n", "mean_us", "cv")


def answered_flows(p: DataFrame) -> DataFrame:
    """Flows whose other side sent an ACK or RST."""
    turned = dict(zip(FLOW, ("dst_ip", "dst_port", "src_ip", "src_port")))
    return p.where(is_tcp() & (has(ACK) | has(RST))).select(*[F.col(v).alias(k) for k, v in turned.items()]).distinct()


def silent_targets(p: DataFrame) -> DataFrame:
    """Flows whose SYNs were sent again though the other side never sent an ACK or RST, as behind a filter that drops them."""
    r = exact_retransmissions(p).where(F.col("tcp_flags").bitwiseAND(SYN) != 0).groupBy(*FLOW).agg(F.count("*").alias("retries"))
    return r.join(answered_flows(p), list(FLOW), "left_anti")


def with_window_group(stats: DataFrame, limit_us: int = 1_000_000) -> DataFrame:
    """Flows that closed their window with the group they are reported in, which short flows have, too: application, receiver or other."""
    app = (F.col("bottleneck") == "application") | (F.col("zero_runs") > 5) | (F.col("closed_us") > limit_us)
    return stats.where("zero_runs > 0").withColumn("kind", F.when(app, "application").when(F.col("bottleneck") == "receiver", "receiver").otherwise("other"))


def window_groups(stats: DataFrame, limit_us: int = 1_000_000) -> DataFrame:
    """The groups of with_window_group: flows, runs of zero windows, their time, and the largest product of both in a flow."""
    weight = F.col("zero_runs").cast("decimal(38,0)") * F.col("closed_us")
    return with_window_group(stats, limit_us).groupBy("kind").agg(
        F.count("*").alias("flows"), F.sum("zero_runs").alias("zero_runs"), F.sum("closed_us").alias("closed_us"), F.max(weight).cast("double").alias("worst"),
    )


def flow_details(df: DataFrame, **values: str | int) -> DataFrame:
    """The rows of a result whose columns have these values: src_ip, src_port, dst_ip, dst_port or any other; None asks for nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


# ---------------------------------------------------------------- tables for CSV, with their fixed headers and forms


def _flow_text() -> Column:
    side = lambda x: F.concat(F.col(f"{x}_ip"), F.lit(":"), F.coalesce(F.col(f"{x}_port").cast("string"), F.lit("None")))
    return F.concat(side("src"), F.lit(" -> "), side("dst"), F.lit(" ("), F.col("protocol"), F.lit(")")).alias("Flow")


def csv_protocols(shares: DataFrame) -> DataFrame:
    d = shares.orderBy(F.desc("packets"), "protocol")
    return d.select(F.col("protocol").alias("Protocol"), F.col("packets").alias("Count"), F.format_string("%.2f%%", F.col("share") * 100.0).alias("Percentage"))


def csv_services(services: DataFrame) -> DataFrame:
    """Services by flows; the window for the total runs over the few services alone."""
    total = F.sum("flows").over(Window.partitionBy())
    d = services.select("service", "flows", (F.col("flows") / total.cast("double") * 100.0).alias("share")).orderBy(F.desc("flows"), "service")
    return d.select(F.col("service").alias("Service Type"), F.col("flows").alias("Flow Count"), F.format_string("%.2f%%", "share").alias("Percentage"))


def csv_jitter(stats: DataFrame) -> DataFrame:
    """Flow, mean and largest jitter in ms (from whole microseconds, ties to even) and the number of jitter values."""
    ms = lambda c: F.format_string("%.3f", F.bround(F.col(c).cast("double"), 0) / 1000.0)
    return stats.select(_flow_text(), ms("mean_us").alias("Mean Jitter (ms)"), ms("max_us").alias("Max Jitter (ms)"), F.col("n").alias("Packet Count"))


def csv_flows(flows: DataFrame) -> DataFrame:
    size = F.col("bytes") / F.col("packets").cast("double")
    return flows.select(
        _flow_text(), F.col("service").alias("Service Type"), F.format_string("%.2f", "confidence").alias("Confidence"), F.col("packets").alias("Packets"),
        F.format_string("%.0f", F.bround(size, 0)).alias("Avg Packet Size"),
    )
