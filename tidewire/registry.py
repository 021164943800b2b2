"""Analyses by name: each is a function from packets and thresholds to named result tables.

    @analysis("my_check")
    def my_check(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]: ...

registers one more; run() then makes its tables with those of the others. An analysis that
fails is reported as a row and doesn't keep the others from being written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import class_name
from .operators import folds, names, security, tcp, timing, traffic
from .plans import causes, listings, report, score
from .sources import dissector
from .thresholds import Thresholds


class Analysis(Protocol):
    def __call__(self, p: DataFrame, t: Thresholds) -> dict[str, DataFrame]: ...


REGISTRY: dict[str, Analysis] = {}


def analysis(name: str) -> Callable[[Analysis], Analysis]:
    """Register a function under a name; a name can be taken once."""

    def add(f: Analysis) -> Analysis:
        if name in REGISTRY:
            raise ValueError(f"analysis {name!r} is registered already")
        REGISTRY[name] = f
        return f

    return add


def us(seconds: float) -> int:
    return round(seconds * 1_000_000)


@analysis("summary")
def summary(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"summary": report.summary(p), "sanity": report.capture_sanity(p)}


@analysis("protocols")
def protocols(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"protocol_distribution": listings.csv_protocols(traffic.protocol_distribution(p)), "ports": traffic.top_ports(p)}


@analysis("services")
def services(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    flows = traffic.classify_services(p)
    return {"service_classification": listings.csv_services(traffic.service_summary(p)), "classified_flows": listings.csv_flows(flows)}


@analysis("talkers")
def talkers(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"top_talkers": traffic.top_talkers(p), "top_conversations": traffic.top_conversations(p), "throughput": traffic.top_throughput(p), "asymmetric_flows": traffic.asymmetric_flows(p)}


@analysis("timing")
def times(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"gaps": timing.marked_gaps(p, t), "intervals": timing.interval_statistics(p), "bursts": timing.bursts(p, t)}


@analysis("jitter")
def jitter(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    stats = timing.jitter_flow_stats(p)
    return {"jitter_statistics": listings.csv_jitter(stats), "jitter_offenders": listings.jitter_offenders(stats)}


@analysis("handshakes")
def handshakes(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"handshakes": folds.handshakes(p, us(t.handshake_total_s), us(t.handshake_synack_s)), "syn_conformance": flat(tcp.syn_conformance(p))}


@analysis("retransmissions")
def retransmissions(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    e = folds.segment_events(p)
    flows = folds.flow_severity(p, e, t.retrans_low, t.retrans_critical)
    found = causes.retransmission_causes(folds.retransmissions(e), listings.answered_flows(p), timing.bursts(p, t), causes.range_table(p.sparkSession))
    return {"retransmissions": dissector.own_retransmissions(p), "retransmission_flows": flows, "retransmission_report": folds.segment_report(e, flows), "retransmission_causes": found}


@analysis("round_trips")
def round_trips(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"round_trips": tcp.rtt_flow_stats(folds.round_trips(p), us(t.rtt_warning_s), us(t.rtt_critical_s))}


@analysis("windows")
def windows(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    stats = tcp.window_bottleneck(tcp.window_stats(p, t.low_window))
    return {"windows": stats, "window_causes": causes.window_causes(listings.with_window_group(stats), causes.range_table(p.sparkSession))}


@analysis("connections")
def connections(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"connections": tcp.connection_states(p, us(t.idle_s), us(t.zombie_s)), "resets": tcp.reset_flows(p)}


@analysis("security")
def detectors(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    tries = security.brute_force(p)
    return {
        "port_scans": listings.by_severity(security.scan_events(p), "start_us", "src_ip"), "brute_force": listings.by_severity(tries, "first_us", "src_ip", "dst_ip", "dst_port"),
        "attackers": security.top_attackers(tries), "floods": listings.by_severity(security.floods(p), "start_us", "attack", "dst_ip", "dst_port"), "uploads": security.large_uploads(p),
        "lateral": security.lateral_targets(p), "lateral_rapid": security.lateral_rapid(p), "beacons": timing.beacons(p),
    }


@analysis("icmp")
def icmp(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    return {"icmp": names.icmp_summary(p), "unreachable": names.unreachable_targets(p), "path_mtu": names.path_mtu_issues(p)}


@analysis("health")
def health(p: DataFrame, t: Thresholds) -> dict[str, DataFrame]:
    m = score.metrics_of(p, folds.round_trips(p), dissector.own_retransmissions(p))
    return {"health": score.health_score(m).withColumn("class_name", class_name(F.col("class")))}


def flat(df: DataFrame) -> DataFrame:
    """df with its arrays as texts, so that any sink takes it."""
    return df.select([F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])


def run(p: DataFrame, only: Iterable[str] | None = None, thresholds: Thresholds = Thresholds(), write: Callable[[str, DataFrame], None] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by name, problems): the tables of the chosen analyses (default: all), handed to `write` one by one; problems has analysis, error."""
    chosen = list(REGISTRY) if only is None else list(only)
    unknown = [n for n in chosen if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown analyses: {', '.join(unknown)}")
    tables, problems = {}, []
    for name in chosen:
        try:
            made = REGISTRY[name](p, thresholds)
            for table, df in made.items():
                if write is not None:
                    write(table, df)
            tables |= made
        except Exception as e:  # whatever one analysis does, the others are still wanted
            problems.append((name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return tables, p.sparkSession.createDataFrame(problems, "analysis string, error string")
