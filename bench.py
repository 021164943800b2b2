"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidewire import queries as q

HEADLINE = (
    "top_talkers_ip", "top_conversations", "throughput_flows", "asymmetric_flows", "protocol_distribution_l4", "service_classification", "gap_detection",
    "jitter_flow_stats", "burst_events", "temporal_peaks", "periodic_patterns", "tcp_window_stats", "zero_window_periods", "tcp_reset_classified",
    "tcp_connection_states", "rtt_flow_stats", "retrans_exact", "retrans_flow_groups", "port_scan_events", "ddos_syn_flood", "exfil_large_upload",
    "beaconing", "lateral_rapid", "health_score", "handshake", "retransmission_full",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("top_talkers_ip")  # starts the JVM's compiler and the file cache
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - t, 3)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "all headline analyses", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir), "packets": n, "packets_per_sec": round(n / total)}))
    spark.stop()


if __name__ == "__main__":
    main()
