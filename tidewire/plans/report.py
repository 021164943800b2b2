"""Report tables and their sinks: long-form summaries, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import FLOW


def summary(p: DataFrame) -> DataFrame:
    """metric, value (text) of one capture, one row per metric."""
    one = p.agg(
        F.count("*").cast("string").alias("packets"), F.sum("packet_length").cast("string").alias("bytes"), F.count_distinct("src_ip").cast("string").alias("sources"),
        F.count_distinct("dst_ip").cast("string").alias("destinations"), (F.max("ts_us") - F.min("ts_us")).cast("string").alias("span_us"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def capture_sanity(p: DataFrame, first: int = 100) -> DataFrame:
    """One row over the capture's first packets: count, duplicates, self loops, largest jump of time between neighbours, and the verdict."""
    h = p.orderBy("packet_num").limit(first)
    # the window runs over those few rows alone
    h = h.withColumn("jump", F.abs(F.col("ts_us") - F.lag("ts_us").over(Window.orderBy("packet_num"))))
    g = h.agg(
        F.count("*").alias("packets"), F.count_distinct("ts_us", "src_ip", "dst_ip", "packet_length").alias("distinct_packets"), F.count_if(F.col("src_ip") == F.col("dst_ip")).alias("self_loops"),
        F.max("jump").alias("jump_us"),
    )
    verdict = (
        F.when(F.col("packets") < 2, "too few packets").when(F.col("jump_us") > 31_536_000_000_000, "time jump")
        .when((F.col("packets") - F.col("distinct_packets")) * 2 > F.col("packets"), "duplicates").when(F.col("self_loops") * 10 > F.col("packets"), "self loops").otherwise("valid")
    )
    return g.withColumn("verdict", verdict)


def flow_quality(jitter: DataFrame, rtt: DataFrame, retransmissions: DataFrame) -> DataFrame:
    """Jitter per flow with its round-trip times and number of retransmissions; a flow without them has nulls and 0.

    All three are aggregates keyed by the 4-tuple, so equal keys meet once on either side.
    """
    j = jitter.select("protocol", *FLOW, F.col("mean_us").alias("jitter_mean_us"), F.col("max_us").alias("jitter_max_us"))
    r = rtt.select(*FLOW, F.col("mean_us").alias("rtt_mean_us"), F.col("max_us").alias("rtt_max_us"))
    x = retransmissions.groupBy(*FLOW).agg(F.count("*").alias("retransmissions"))
    return j.join(r, list(FLOW), "left").join(x, list(FLOW), "left").withColumn("retransmissions", F.coalesce("retransmissions", F.lit(0).cast("bigint")))


def graph_series(jitters: DataFrame, stats: DataFrame, trips: DataFrame, retransmissions: DataFrame, flows: int = 10) -> DataFrame:
    """Points of the `flows` worst flows by 95th percentile of jitter: protocol, FLOW, series, ts_us, value_ms.

    Series: jitter (timing.jitter) and rtt (trips: FLOW, ts_us, rtt_us), and a marker for each
    retransmission (FLOW, ts_us) at 1.2 times that percentile. level is critical above 50 ms, warning above 30.
    """
    p95 = F.col("p95_us") / 1000.0
    level = F.when(p95 > 50, "critical").when(p95 > 30, "warning").otherwise("ok")
    keys = ("protocol", *FLOW)
    worst = stats.orderBy(F.desc("p95_us"), *keys).limit(flows).select(*keys, level.alias("level"), (p95 * 1.2).alias("mark_ms"))
    own = lambda df, on, name, value: df.join(F.broadcast(worst), list(on)).select(*keys, "level", F.lit(name).alias("series"), "ts_us", value.alias("value_ms"))
    parts = (own(jitters, keys, "jitter", F.col("jitter_us") / 1000.0), own(trips, FLOW, "rtt", F.col("rtt_us") / 1000.0), own(retransmissions, FLOW, "retransmission", F.col("mark_ms")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_all(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per table."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
