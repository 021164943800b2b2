"""Health score: six metrics of one report row, each a piecewise-linear penalty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import FLOW, exact_median, piecewise

#: Metric: weight, penalty lines (x0, y0, x1, y1), penalty beyond. Jumps between lines are meant.
METRICS = {
    "retransmission": (25, ((0, 0, 0.01, 16), (0.01, 16, 0.03, 34), (0.03, 34, 0.05, 60), (0.05, 60, 0.10, 92)), 100),
    "rtt": (20, ((0, 0, 0.05, 0), (0.05, 0, 0.15, 18), (0.15, 18, 0.4, 45), (0.4, 45, 0.8, 70), (0.8, 70, 2, 100)), 100),
    "loss": (20, ((0, 0, 0.005, 10), (0.005, 10, 0.02, 22), (0.02, 22, 0.05, 47), (0.05, 47, 0.10, 77)), 100),
    "dns": (15, ((0, 0, 0.01, 8), (0.01, 8, 0.05, 25), (0.05, 25, 0.15, 55), (0.15, 50, 0.30, 80)), None),
    "jitter": (10, ((0, 0, 0.01, 0), (0.01, 0, 0.02, 8), (0.02, 8, 0.05, 25), (0.05, 25, 0.1, 55), (0.1, 50, 0.2, 85)), 100),
    "anomaly": (10, ((0, 0, 10, 10), (10, 10, 50, 28), (50, 25, 150, 55), (150, 50, 500, 85)), 100),
}
CLASSES = ((95, 0, "excellent"), (85, 1, "good"), (65, 2, "fair"), (45, 3, "degraded"), (25, 4, "poor"))


def health_score(metrics: DataFrame) -> DataFrame:
    """metrics (a column per METRICS name, null where not measured) plus <name>_penalty, score and class.

    Penalties are rounded to two places before they are summed, the score to one after its class is set.
    """
    out, total = metrics, None
    for name, (weight, lines, beyond) in METRICS.items():
        x = F.coalesce(F.col(name), F.lit(0.0))
        past = F.least(F.lit(95.0), 80 + 50 * (x - 0.30)) if beyond is None else float(beyond)
        penalty = F.round(piecewise(x, lines, past) * (weight / 100.0), 2)
        out = out.withColumn(f"{name}_penalty", penalty)
        total = F.col(f"{name}_penalty") if total is None else total + F.col(f"{name}_penalty")
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - total)))
    grade = None
    for bound, i, _ in CLASSES:
        grade = F.when(F.col("score") >= bound, i) if grade is None else grade.when(F.col("score") >= bound, i)
    return out.withColumn("class", grade.otherwise(5)).withColumn("score", F.round("score", 1))


def metrics_of(p: DataFrame, rtt: DataFrame, retransmissions: DataFrame) -> DataFrame:
    """One row of METRICS from packets, round trips (rtt_us) and retransmissions (packet_num)."""
    n = p.agg(F.count("*").alias("n"), F.count_if(F.col("tcp_window") == 0).alias("zero"))
    r = retransmissions.agg(F.count("*").alias("r"))
    t = exact_median(rtt, "rtt_us", "median_us")
    nul = F.lit(None).cast("double")
    rows = n.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(t))
    return rows.select(
        (F.col("r") / F.col("n").cast("double")).alias("retransmission"), (F.col("median_us") / 1e6).alias("rtt"), nul.alias("loss"), nul.alias("dns"), nul.alias("jitter"),
        (F.col("zero") * 1000 / F.col("n").cast("double")).alias("anomaly"),
    )


def all_metrics_of(p: DataFrame, rtt: DataFrame, retransmissions: DataFrame, lookups: DataFrame, jitters: DataFrame) -> DataFrame:
    """metrics_of with the other three from retransmissions, lookups (status) and jitters (jitter_us).

    loss is estimated: distinct segments (flow, number) sent again, per packet. dns is the share of lookups
    that failed or timed out, jitter the mean in seconds; both null without rows.
    """
    lost = retransmissions.agg(F.count_distinct(F.struct(*FLOW, "tcp_seq")).alias("lost"))
    bad = F.count_if(F.col("status").isin("timeout", "error")) / F.count("*").cast("double")
    dns = lookups.agg(F.when(F.count("*") > 0, bad).alias("dns"))
    jitter = jitters.agg((F.sum("jitter_us") / F.count("jitter_us").cast("double") / 1e6).alias("jitter"))
    rows = metrics_of(p, rtt, retransmissions).drop("loss", "dns", "jitter").crossJoin(F.broadcast(p.agg(F.count("*").alias("n"))))
    rows = rows.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(dns)).crossJoin(F.broadcast(jitter))
    return rows.withColumn("loss", F.col("lost") / F.col("n").cast("double")).select(*METRICS)


def findings(
    p: DataFrame, retransmissions: DataFrame, jitter: DataFrame, gaps: DataFrame, attempts: DataFrame, lookups: DataFrame,
    rate: float = 2.0, many_gaps: int = 10_000, many_attempts: int = 10, failures: float = 5.0,
) -> DataFrame:
    """finding, value, detail: what an operator should look at first, from packets, retransmissions (FLOW), flows' jitter (severity), gaps (src_ip, dst_ip), SYN attempts (retries) and lookups (status).

    The detail names the flow with most retransmissions, or the pair of addresses with most gaps and its share in percent.
    """
    flow = F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port").cast("string"), F.lit(" -> "), F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string"))
    pair = F.concat(F.col("src_ip"), F.lit(" <-> "), F.col("dst_ip"))
    most = lambda df, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), "name")).alias("x"))
    one = lambda finding, value, detail: [F.lit(finding).alias("finding"), value.cast("double").alias("value"), detail.cast("string").alias("detail")]
    none, count = F.lit(None).cast("string"), F.col("n")
    packets = p.agg(F.count("*").alias("packets"))
    r = most(retransmissions, flow).crossJoin(F.broadcast(packets)).withColumn("rate", F.try_divide(count, F.col("packets").cast("double")) * 100.0).where(F.col("rate") >= rate)
    g = most(gaps, pair).where(count > many_gaps)
    share = F.round(-F.col("x.c") / count.cast("double") * 100.0, 0).cast("int").cast("string")
    j = jitter.where("severity = 'critical'").agg(F.count("*").alias("n")).where(count > 0)
    a = attempts.where("retries > 0").agg(F.count("*").alias("n")).where(count > many_attempts)
    d = lookups.agg(F.try_divide(F.count_if(F.col("status").isin("timeout", "error")), F.count("*").cast("double")).alias("n")).select((count * 100.0).alias("n")).where(count > failures)
    parts = (
        r.select(*one("retransmission rate", F.col("rate"), F.col("x.name"))), j.select(*one("critical jitter", count, none)),
        g.select(*one("gaps", count, F.concat("x.name", F.lit(" "), share, F.lit("%")))), a.select(*one("failed connections", count, none)), d.select(*one("dns failures", count, none)),
    )
    return reduce(DataFrame.unionByName, parts)
