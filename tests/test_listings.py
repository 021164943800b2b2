"""Listings, root causes, the suspected side of handshakes and filtered jitter on hand-made packets."""

from pyspark.sql import functions as F

from tidewire.operators import folds, security, tcp, timing
from tidewire.plans import listings, report

from .test_packets import at, back, packets  # noqa: F401  (packets is a fixture)


def test_suspected_side_and_latency_filter(packets):  # noqa: F811
    def shake(port, t, answer, ack):
        ends = {"src_port": port}
        return [
            at(t, tcp_flags=2, **ends), back(t + answer, tcp_flags=18, tcp_seq=2000, tcp_ack=1001) | {"dst_port": port}, at(t + answer + ack, tcp_ack=2001, **ends),
        ]

    cases = {1: (0.6, 0.01), 2: (0.2, 0.01), 3: (0.05, 0.15), 4: (0.05, 0.05), 5: (0.1, 0.1)}
    p = packets(*[x for port, (a, b) in cases.items() for x in shake(port, port * 10.0, a, b)], at(90, tcp_flags=2, src_port=6))
    side = {r.src_port: r.suspected for r in folds.handshakes(p).collect()}
    assert side == {1: "server", 2: "network", 3: "client", 4: "none", 5: "none", 6: "unknown"}
    assert {r.src_port for r in folds.handshakes(p, slow_us=150_000).where("suspected = 'network'").collect()} == {2, 5}
    assert {r.src_port for r in folds.handshakes(p, at_least_us=200_000).collect()} == {1, 2, 3, 5}


def test_by_severity(packets, spark):  # noqa: F811
    e = spark.createDataFrame([("low", 1), ("critical", 9), ("medium", 3), ("critical", 2), ("high", 5)], "severity string, start_us int")
    got = listings.by_severity(e, "start_us", k=4).orderBy("place").collect()
    assert [(r.severity, r.start_us, r.place) for r in got] == [("critical", 2, 1), ("critical", 9, 2), ("high", 5, 3), ("medium", 3, 4)]
    scan = packets(*[at(i, tcp_flags=2, dst_port=100 + i) for i in range(12)])
    assert security.scan_events(scan).select("start_us", "span_us").first() == (0, 11_000_000)


def test_shaping_and_silent_targets(packets):  # noqa: F811
    even = [at(0, tcp_payload_len=10), *[at(1 + i, tcp_payload_len=10) for i in range(10)]]
    uneven = [at(t, tcp_payload_len=10, src_port=7) for t in (0, 1, 1.1, 5, 5.1, 9, 9.1, 9.2, 20, 20.1, 31)]
    r = listings.shaped_flows(packets(*even, *uneven, *even[:5])).collect()
    assert [(x.src_port, x.n, x.mean_us) for x in listings.shaped_flows(packets(*even, *uneven)).collect()] == [(12345, 10, 1e6)] and not [x for x in r if x.src_port == 7]
    p = packets(at(0, tcp_flags=2), at(1, tcp_flags=2), at(0, tcp_flags=2, src_port=9), at(3, tcp_flags=2, src_port=9), back(4, tcp_flags=20) | {"dst_port": 9})
    assert [(x.src_port, x.retries) for x in listings.silent_targets(p).collect()] == [(12345, 1)]


def test_context_details_and_windows(packets):  # noqa: F811
    p = packets(*[at(i, tcp_seq=i) for i in range(12)], at(20, tcp_seq=500, tcp_payload_len=5), at(21, tcp_seq=500, tcp_payload_len=5))
    r = listings.retransmission_context(p).first()
    assert (r.packet_num, r.n_forward, r.n_reverse, r.context) == (14, 5, 0, "10,11,12,13,14")
    d = tcp.exact_retransmissions(p)
    assert listings.flow_details(d, src_ip="1.1.1.1", src_port=None).count() == 1 and listings.flow_details(d, src_port=1).count() == 0
    w = packets(at(0, tcp_window=0), at(3, tcp_window=9000), at(0, tcp_window=0, src_port=2), at(0.5, tcp_window=9000, src_port=2), at(1, src_port=3))
    got = listings.window_groups(tcp.window_bottleneck(tcp.window_stats(w, 100, 0))).collect()
    assert {x.kind: (x.flows, x.closed_us) for x in got} == {"application": (1, 3_000_000), "other": (1, 500_000)}


def test_filtered_jitter_and_csv(packets, tmp_path, spark):  # noqa: F811
    u = {"protocol": "UDP", "tcp_flags": None, "dst_port": 5000}
    p = packets(at(0, **u), at(0.1, **u), at(0.3, **u), at(50.3, **u))
    assert timing.jitter_flow_stats(p).first().n == 2
    stats = timing.jitter_filtered_stats(p, 10_000_000)
    assert (stats.first().n, stats.first().max_us) == (1, 100_000)
    assert [(r.severity, r.place) for r in listings.jitter_offenders(stats).collect()] == [("critical", 1)]
    table = listings.csv_jitter(stats)
    report.write_csv(table, str(tmp_path / "jitter"))
    back_ = spark.read.csv(str(tmp_path / "jitter"), header=True).first()
    assert tuple(back_) == ("1.1.1.1:12345 -> 2.2.2.2:5000 (UDP)", "100.000", "100.000", "1")
    assert listings.round_trip_summary(folds.round_trips(p)).select("n", F.col("stdev_us").isNull()).first() == (0, True)
