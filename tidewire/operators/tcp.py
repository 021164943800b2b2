"""TCP: windows, resets, connection states, round trips, handshakes and retransmissions, as windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import ACK, ENDS, FIN, FLOW, PSH, RST, SYN, ack_only, flag_names, has, is_tcp, ranked, syn_ack, syn_only, with_ends

IN_ORDER = ("ts_us", "packet_num")


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _windows(p: DataFrame) -> DataFrame:
    """TCP packets with their place r in their flow, whether their window is zero, starts a run of zero windows, and how long it then stays zero.

    A zero window lasts to the flow's next packet; after its last one, to the last TCP packet of the capture.
    """
    w = Window.partitionBy(*FLOW).orderBy(*IN_ORDER)
    t = p.where(is_tcp())
    end = F.broadcast(t.agg(F.max("ts_us").alias("end_us")))  # one row
    t = t.select(*FLOW, "ts_us", "tcp_window", F.coalesce(F.col("tcp_window") == 0, F.lit(False)).alias("zero"), F.row_number().over(w).alias("r"), F.lead("ts_us").over(w).alias("next_us"), "packet_num")
    t = t.withColumn("start", F.col("zero") & ~F.coalesce(F.lag("zero").over(w), F.lit(False)))
    return t.crossJoin(end).withColumn("closed_us", F.when(F.col("zero"), F.coalesce("next_us", "end_us") - F.col("ts_us")))


def window_stats(p: DataFrame, low: int = 8192, settle: int = 20) -> DataFrame:
    """Per directed flow: window minimum (once settled, if it lives that long), maximum and mean, packets with zero windows, runs of
    them with their time and first start, low windows (above zero), and these in percent of the settled packets."""
    win, settled = F.col("tcp_window"), F.col("r") > settle
    g = _windows(p).groupBy(*FLOW).agg(
        F.count("*").alias("packets"), F.min(win).alias("least"), F.max(win).alias("max_window"), (F.sum(win) / F.count("*").cast("double")).alias("mean_window"),
        F.count_if("zero").alias("zero_windows"), F.count_if("start").alias("zero_runs"), F.coalesce(F.sum("closed_us"), F.lit(0).cast("bigint")).alias("closed_us"),
        F.min(F.when(F.col("zero"), F.col("ts_us"))).alias("first_zero_us"), F.count_if((win > 0) & (win < low)).alias("low_windows"), F.count_if(settled).alias("settled"),
        F.min(F.when(settled, win)).alias("settled_min"),
    )
    share = F.when(F.col("settled") > 0, F.col("low_windows") / F.col("settled").cast("double") * 100.0).otherwise(0.0)
    return g.select(
        *FLOW, "packets", F.coalesce("settled_min", "least").alias("min_window"), "max_window", "mean_window", "zero_windows", "zero_runs", "closed_us", "first_zero_us", "low_windows", share.alias("low_share"),
    )


def zero_window_periods(p: DataFrame) -> DataFrame:
    """Runs of zero windows per directed flow; a run ends at the flow's next open window, open ones at the last TCP packet of the capture."""
    w = Window.partitionBy(*FLOW).orderBy(*IN_ORDER)
    t = _windows(p).where("zero").withColumn("run", F.sum(F.col("start").cast("int")).over(_so_far(w)))
    g = t.groupBy(*FLOW, "run").agg(F.min("ts_us").alias("start_us"), F.sum("closed_us").alias("duration_us"), F.count("*").alias("packets"))
    return g.select(*FLOW, "start_us", "duration_us", "packets")


def window_bottleneck(stats: DataFrame, limit_us: int = 1_000_000, least: int = 30) -> DataFrame:
    """Flows with the side that holds them back: application, receiver or none (also for flows of under `least` packets)."""
    app = (F.col("zero_runs") > 5) | (F.col("closed_us") > limit_us)
    receiver = (F.col("low_share") > 30) & (F.col("zero_runs") > 0)
    return stats.withColumn("bottleneck", F.when(F.col("packets") < least, "none").when(app, "application").when(receiver, "receiver").otherwise("none"))


def classified_resets(p: DataFrame) -> DataFrame:
    """RST packets with what their conversation had seen by then; premature means no data so far."""
    w = Window.partitionBy(*ENDS).orderBy(*IN_ORDER)
    t = with_ends(p.where(is_tcp()))
    t = t.withColumn("syn_seen", F.max(has(SYN)).over(_so_far(w))).withColumn("data_seen", F.max(has(PSH) | (F.col("tcp_payload_len") > 0)).over(_so_far(w)))
    return t.where(has(RST)).select("packet_num", *FLOW, "syn_seen", "data_seen", (~F.col("data_seen")).alias("premature"))


def reset_flows(p: DataFrame, k: int = 10) -> DataFrame:
    g = with_ends(p.where(is_tcp())).groupBy(*ENDS).agg(
        F.count_if(has(RST)).alias("resets"), (~F.max(has(PSH) | (F.col("tcp_payload_len") > 0))).alias("premature")
    )
    return g.where("resets > 0").orderBy(F.desc("resets"), *ENDS).limit(k)


def connection_states(p: DataFrame, idle_us: int = 30_000_000, zombie_us: int = 60_000_000) -> DataFrame:
    """One state per conversation; idle time runs to the last TCP packet of the capture."""
    t = with_ends(p.where(is_tcp()))
    end = t.agg(F.max("ts_us").alias("end_us"))
    at = lambda c: F.min(F.when(c, F.struct("ts_us", "packet_num")))
    g = t.groupBy(*ENDS).agg(
        F.max("ts_us").alias("last_us"), F.count("*").alias("packets"), at(syn_only()).alias("syn"), at(syn_ack()).alias("synack"),
        F.max(F.when(ack_only(), F.struct("ts_us", "packet_num"))).alias("last_ack"), F.max(has(FIN)).alias("fin"), F.max(has(RST)).alias("rst"),
        F.max(has(ACK) & ~has(SYN) & (F.col("tcp_payload_len") > 0)).alias("data"),
    )
    g = g.crossJoin(F.broadcast(end)).withColumn("idle_us", F.col("end_us") - F.col("last_us"))
    acked = F.coalesce(F.col("last_ack") > F.col("synack"), F.lit(False))
    idle = F.col("idle_us")
    state = (
        F.when(F.col("fin"), "closed")
        .when(F.col("rst"), "reset")
        .when(F.col("syn").isNotNull() & F.col("synack").isNull(), F.when(idle > idle_us, "syn_timeout").otherwise("syn_waiting"))
        .when(F.col("synack").isNotNull() & ~acked, "half_open")
        .when(acked & ~F.col("data"), F.when(idle > idle_us, "idle_no_data").otherwise("established_no_data"))
        .when(F.col("data"), F.when(idle > zombie_us, "zombie").when(idle > idle_us, "idle").otherwise("active"))
        .otherwise("unknown")
    )
    return g.select(*ENDS, "packets", "idle_us", state.alias("state"))


def rtt_flow_stats(trips: DataFrame, warning_us: int = 100_000, critical_us: int = 500_000) -> DataFrame:
    """Per flow of folds.round_trips: number, least, most, mean, median, sample deviation, spikes, and whether its round trips are long.

    Ranks come from a window, which spills, so no list of a flow's values is held.
    """
    us, n = F.col("rtt_us"), F.col("n").cast("double")
    at = lambda place: F.max(F.when(F.col("__r") == place, us))
    g = ranked(trips, FLOW, "rtt_us").groupBy(*FLOW).agg(
        F.count("*").alias("n"), F.min(us).alias("min_us"), F.max(us).alias("max_us"), F.sum(us).alias("s"), F.sum(us.cast("decimal(38,0)") * us).cast("double").alias("q"),
        at(F.floor((F.col("__n") + 1) / 2)).alias("lower"), at(F.floor(F.col("__n") / 2) + 1).alias("upper"), F.count_if(us > warning_us).alias("spikes"),
    )
    s = F.col("s").cast("double")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("q") * n - s * s) / (n * (n - 1)), F.lit(0.0))))
    g = g.withColumn("mean_us", F.col("s") / n)
    return g.select(
        *FLOW, "n", "min_us", "max_us", "mean_us", ((F.col("lower") + F.col("upper")) / 2.0).alias("median_us"), spread.alias("stdev_us"), "spikes",
        ((F.col("mean_us") > warning_us) | (F.col("max_us") > critical_us)).alias("high"),
    )


def exact_retransmissions(p: DataFrame) -> DataFrame:
    """Segments of a flow that repeat an earlier one's sequence number and length, with the first of them."""
    t = p.where(is_tcp() & ((F.col("tcp_payload_len") > 0) | has(SYN) | has(FIN)))
    w = Window.partitionBy(*FLOW, "tcp_seq", "tcp_payload_len").orderBy(*IN_ORDER)
    first = F.first(F.struct("packet_num", "ts_us")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("first", first).where(F.col("first.packet_num") != F.col("packet_num"))
    t = t.withColumn("delay_us", F.col("ts_us") - F.col("first.ts_us"))
    syn_kind = F.when(F.col("delay_us") >= 500_000, "RTO").otherwise("Retransmission")
    kind = F.when(F.col("delay_us") >= 200_000, "RTO").when(F.col("delay_us") <= 50_000, "Fast Retransmission").otherwise("Retransmission")
    return t.select("packet_num", "ts_us", *FLOW, "tcp_seq", "tcp_flags", F.col("first.packet_num").alias("original_num"), "delay_us", F.when(has(SYN), syn_kind).otherwise(kind).alias("kind"))


def retransmission_offenders(p: DataFrame, k: int = 10) -> DataFrame:
    """Flows by retransmissions, with their most frequent flags (ties: the lower flags)."""
    r = exact_retransmissions(p)
    by = r.groupBy(*FLOW, "tcp_flags").agg(F.count("*").alias("c"))
    g = by.groupBy(*FLOW).agg(F.sum("c").alias("retransmissions"), F.max_by("tcp_flags", F.struct("c", -F.col("tcp_flags"))).alias("flags"))
    return g.withColumn("flags", flag_names(F.col("flags"))).orderBy(F.desc("retransmissions"), *FLOW).limit(k)


def retransmission_groups(p: DataFrame, share: float = 0.8) -> DataFrame:
    return flow_kinds(exact_retransmissions(p), share)


def flow_kinds(r: DataFrame, share: float = 0.8) -> DataFrame:
    """Per flow of retransmissions (FLOW, tcp_flags, kind) the kind that makes up `share` of them, else mixed."""
    kind = F.when(F.col("tcp_flags").bitwiseAND(SYN) != 0, "syn").when(F.col("kind") == "RTO", "rto").when(F.col("kind") == "Fast Retransmission", "fast").otherwise("generic")
    g = r.groupBy(*FLOW).agg(F.count("*").alias("n"), *[F.count_if(kind == k).alias(k) for k in ("syn", "rto", "fast", "generic")])
    group = None
    for k in ("syn", "rto", "fast", "generic"):
        c = F.col(k) >= share * F.col("n")
        group = F.when(c, k) if group is None else group.when(c, k)
    return g.select(*FLOW, "n", group.otherwise("mixed").alias("kind"))


def syn_retries(p: DataFrame, within_us: int = 10_000_000) -> DataFrame:
    """SYNs that repeat the same initial number within a time of the attempt before, per 4-tuple and number."""
    w = Window.partitionBy(*FLOW, "tcp_seq").orderBy(*IN_ORDER)
    t = p.where(is_tcp() & syn_only()).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(w))
    g = t.groupBy(*FLOW, "tcp_seq").agg(F.count("*").alias("attempts"), F.count_if(F.col("gap") < within_us).alias("retries"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"))
    return g.where("retries > 0")


def syn_delays(p: DataFrame, slow_us: int = 2_000_000, within_us: int = 10_000_000) -> DataFrame:
    """Connection attempts that were sent again or answered late, with their delay and what it points to.

    An attempt is a run of SYNs of one initial number, up to the SYN-ACK, or a close of
    either side, that follows; another number, or a SYN after those, starts a new one. A
    repeated SYN counts while each comes within within_us of the one before. An attempt
    that a close ends before any answer is not reported.
    """
    t = p.where(is_tcp() & (has(SYN) | has(RST) | has(FIN)))
    back = dict(zip(FLOW, ("dst_ip", "dst_port", "src_ip", "src_port")))
    kind = F.when(syn_only(), "syn").when(syn_ack(), "answer").otherwise("close")
    ways = F.when(syn_only(), F.array(F.lit(True))).when(syn_ack(), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    t = t.withColumn("kind", kind).withColumn("forth", F.explode(ways))
    t = t.select(*[F.when(F.col("forth"), F.col(c)).otherwise(F.col(back[c])).alias(c) for c in FLOW], "kind", "ts_us", "packet_num", "tcp_seq")
    w = Window.partitionBy(*FLOW).orderBy(*IN_ORDER)
    is_syn = F.col("kind") == "syn"
    follows = (F.lag("kind").over(w) == "syn") & (F.lag("tcp_seq").over(w) == F.col("tcp_seq"))
    t = t.withColumn("new", (is_syn & ~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("attempt", F.sum("new").over(_so_far(w))).where("attempt > 0")
    s = Window.partitionBy(*FLOW, "attempt").orderBy(*IN_ORDER)
    t = t.withColumn("gap", F.when(is_syn & (F.col("new") == 0), F.col("ts_us") - F.lag("ts_us").over(s)))
    t = t.withColumn("late", F.max(F.coalesce(F.col("gap") >= within_us, F.lit(False))).over(_so_far(s))).withColumn("r", F.row_number().over(s))
    counted = is_syn & ~F.col("late")
    g = t.groupBy(*FLOW, "attempt").agg(
        F.min(F.when(is_syn, F.col("ts_us"))).alias("first_us"), F.max(F.when(counted, F.col("ts_us"))).alias("last_us"), (F.count_if(counted) - 1).alias("retries"),
        F.min(F.when(~is_syn, F.struct("ts_us", "packet_num", "kind"))).alias("end"),
        F.array_sort(F.collect_list(F.when(counted & F.col("gap").isNotNull(), F.struct("r", "gap")))).alias("gaps"),
    )
    g = g.withColumn("intervals_us", F.transform("gaps", lambda x: x["gap"]))
    answered = F.col("end.kind") == "answer"
    g = g.withColumn("answered", F.coalesce(answered, F.lit(False))).where(F.col("end").isNull() | F.col("answered"))
    g = g.withColumn("delay_us", F.when(F.col("answered"), F.col("end.ts_us")).otherwise(F.col("last_us")) - F.col("first_us"))
    g = g.where((F.col("retries") > 0) | (F.col("answered") & (F.col("delay_us") >= slow_us)))
    doubling = F.get("intervals_us", F.lit(0)).between(900_000, 1_100_000) & F.get("intervals_us", F.lit(1)).between(1_900_000, 2_100_000)
    late = F.col("delay_us") >= 3_000_000
    issue = F.when(~F.col("answered"), "no_synack_received").when(F.coalesce(doubling, F.lit(False)) & late, "server_delayed_response")
    issue = issue.when(late, "severe_network_delay").when(F.col("delay_us") >= 1_000_000, "moderate_network_delay").otherwise("normal")
    return g.select(*FLOW, "first_us", "retries", "answered", "delay_us", issue.alias("issue"), "intervals_us")


def bursts_with_retransmissions(p: DataFrame, bursts: DataFrame, min_hits: int = 5, min_ratio: float = 5.0) -> DataFrame:
    """Bursts in which more than min_hits retransmissions fall.

    Bursts are laid out over blocks of time, so they meet retransmissions by an equi-join.
    """
    block = 60_000_000
    at = lambda c: F.floor(F.col(c) / block).cast("bigint")
    r = exact_retransmissions(p).withColumn("block", at("ts_us"))
    b = bursts.select("burst_id", "start_us", "end_us", "peak_ratio", F.explode(F.sequence(at("start_us"), at("end_us"))).alias("block"))
    g = r.join(b, "block").where(F.col("ts_us").between(F.col("start_us"), F.col("end_us"))).groupBy("burst_id").agg(F.count("*").alias("hits"), F.max("peak_ratio").alias("peak_ratio"))
    return g.where((F.col("hits") > min_hits) & (F.col("peak_ratio") > min_ratio)).select("burst_id", "hits")


def syn_conformance(p: DataFrame, within_us: int = 10_000_000, slow_us: int = 2_000_000, unit_us: int = 1_000_000, tolerance: float = 0.1) -> DataFrame:
    """Attempts of syn_delays with how their SYNs were spaced: RFC 6298 asks for a first timeout of at least unit_us, then doubled each time.

    intervals_us are the times between the counted SYNs; expected_us the doubling ones;
    doubles says whether each is twice the one before, within the tolerance.
    """
    d = syn_delays(p, slow_us, within_us)
    x = F.col("intervals_us")
    ratios = F.zip_with(F.slice(x, F.lit(2), F.size(x)), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: F.when(a > 0, b / a.cast("double")).otherwise(0.0))
    low, high = 2 * (1 - tolerance), 2 * (1 + tolerance)
    doubles = F.forall(ratios, lambda r: (r >= low) & (r <= high))
    first = F.get(x, F.lit(0))
    expected = F.transform(F.slice(F.array(*[F.lit(unit_us << i).cast("bigint") for i in range(4)]), F.lit(1), F.least(F.size(x), F.lit(4))), lambda v: v)
    n = F.col("retries")
    severity = F.when(n == 0, "normal").when(~F.col("answered"), "critical").when(n >= 3, "high").when(n >= 2, "medium").otherwise("low")
    d = d.withColumn("first_timeout_us", first).withColumn("expected_us", expected).withColumn("doubles", doubles)
    d = d.withColumn("conforms", F.col("doubles") & F.coalesce(first >= unit_us, F.lit(True)))
    return d.withColumn("severity", severity)


def syn_conformance_summary(attempts: DataFrame) -> DataFrame:
    """One row over syn_conformance: attempts, those that conform and that double, their shares, the mean first timeout, and attempts by severity."""
    n = F.col("attempts").cast("double")
    levels = ("critical", "high", "medium", "low", "normal")
    g = attempts.agg(
        F.count("*").alias("attempts"), F.count_if("conforms").alias("conform"), F.count_if("doubles").alias("double"), (F.sum("first_timeout_us") / F.count("first_timeout_us").cast("double")).alias("mean_timeout_us"),
        *[F.count_if(F.col("severity") == x).alias(x) for x in levels],
    )
    share = lambda c: F.when(F.col("attempts") > 0, F.col(c) / n).otherwise(0.0)
    return g.select("attempts", "conform", "double", share("conform").alias("conform_share"), share("double").alias("double_share"), "mean_timeout_us", *levels)
