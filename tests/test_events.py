"""Floods and attackers, interval statistics, repeated lookups, SACK and fragment listings, findings and graph series on hand-made rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewire.functions import cols
from tidewire.operators import folds, names, security, tcp, timing
from tidewire.plans import report, score

from .test_packets import at, back, packets  # noqa: F401  (packets is a fixture)


def test_floods_share_windows(packets):  # noqa: F811
    udp = lambda s, i=0, **kw: at(s, protocol="UDP", tcp_flags=None, src_ip=f"9.0.0.{i}", **kw)
    rows = [udp(i / 100, i % 3) for i in range(1000)] + [at(5, tcp_flags=2, src_ip="8.8.8.8")] + [udp(25 + i / 100, 7) for i in range(200)]
    rows += [at(40, protocol="ICMP", tcp_flags=None, src_ip="7.7.7.7")]  # its window has no UDP
    limits = {"syn_per_s": 0.01, "udp_per_s": 10, "icmp_per_s": 0.01}
    got = {r.attack: r for r in security.floods(packets(*rows), **limits).collect()}
    u, s, i = got["udp_flood"], got["syn_flood"], got["icmp_flood"]
    # UDP: windows from 0 and from 25 on, to 35; the SYN's source and bytes lie in the first of them
    assert (u.packets, u.sources, u.start_us, u.span_us, u.bytes, u.rate) == (1200, 5, 0, 35_000_000, 1201 * 154, pytest.approx(1200 / 35))
    assert u.top_sources == "8.8.8.8,9.0.0.0,9.0.0.1,9.0.0.2,9.0.0.7" and u.severity == "low"
    # the SYN flood lasts over all windows of the target, the last one included
    assert (s.packets, s.sources, s.span_us, s.bytes, s.dst_port) == (1, 1, 50_000_000, 1202 * 154, 80) and (i.start_us, i.span_us) == (40_000_000, 10_000_000)
    assert security.floods(packets(*rows)).count() == 0


def test_flood_severity(packets):  # noqa: F811
    def level(n, sources, per_s, attack="icmp_flood"):
        kind = {"protocol": "ICMP", "tcp_flags": None} if attack == "icmp_flood" else {"tcp_flags": 2}
        rows = [at(i / per_s, src_ip=f"9.9.{i % sources // 250}.{i % sources % 250}", **kind) for i in range(n)]
        r = security.floods(packets(*rows), 1, 1, 1, window_us=1_000_000).where(F.col("attack") == attack).first()
        return r.severity

    assert [level(600, s, 300) for s in (3, 51, 101)] == ["high", "high", "critical"]
    assert [level(150, s, 60) for s in (50, 51, 101)] == ["low", "medium", "high"] and level(3000, 3, 900) == "critical"
    assert level(900, 101, 300) == "critical" and level(3000, 3, 600, "syn_flood") == "high"
    answered = packets(*[at(i / 300, tcp_flags=2) for i in range(600)], *[back(i / 300, tcp_flags=18) for i in range(61)])
    assert security.floods(answered).where("attack = 'syn_flood'").count() == 0


def test_attackers(packets):  # noqa: F811
    tries = lambda src, dst, port, n, gap=1.0: [at(i * gap, tcp_flags=2, src_ip=src, dst_ip=dst, dst_port=port, src_port=2000 + i) for i in range(n)]
    p = packets(*tries("4.4.4.4", "2.2.2.2", 22, 60), *tries("4.4.4.4", "2.2.2.3", 3389, 12), *tries("5.5.5.5", "2.2.2.2", 21, 12))
    got = [tuple(r) for r in security.top_attackers(security.brute_force(p)).collect()]
    assert got == [("4.4.4.4", 2, 2, "RDP,SSH", 72, "critical"), ("5.5.5.5", 1, 1, "FTP", 12, "high")]
    assert [r.src_ip for r in security.top_attackers(security.brute_force(p), 1).collect()] == ["4.4.4.4"]


def test_median_and_intervals(spark, packets):  # noqa: F811
    rng = random.Random(2)
    for values in ([], [7], [3, 9], [rng.randrange(10**12) for _ in range(501)], [5] * 9 + [2**40], [rng.choice((1, 2**20, 2**21 + 3)) for _ in range(100)]):
        got = cols.exact_median(spark.createDataFrame([(v,) for v in [*values, None]], "v bigint"), "v").first().median
        assert got == (statistics.median(values) if values else None)
    times = sorted(rng.randrange(10**7) / 1000 for _ in range(200))
    r = timing.interval_statistics(packets(*[at(t) for t in times]), 600_000_000).first()
    d = [round((b - a) * 1e6) for a, b in zip(times, times[1:])]
    assert (r.n, r.min_us, r.max_us, r.median_us) == (199, min(d), max(d), statistics.median(d))
    assert (r.mean_us, r.stdev_us, r.packets_per_s) == pytest.approx((statistics.mean(d), statistics.stdev(d), 200e6 / sum(d)))
    one = timing.interval_statistics(packets(at(3))).first()
    assert (one.n, one.mean_us, one.stdev_us, one.packets_per_s) == (0, None, None, 0.0)


def test_gaps_by_the_beat_are_no_fault(packets):  # noqa: F811
    marks = lambda *times: [r.abnormal for r in timing.marked_gaps(packets(*[at(t, dst_port=80) for t in times])).orderBy("packet_num").collect()]
    assert marks(0, 10, 20, 30.2, 40) == [False] * 4
    assert marks(*[10 * i for i in range(31)], 312.6) == [False] * 30 + [True]  # the whole keeps time, one beat is late
    assert marks(0, 10, 13, 30) == [True] * 3


def test_repeated_queries(spark):
    q = spark.createDataFrame([("a.", "A", s * 1_000_000) for s in (0, 1, 2, 5, 6)] + [("a.", "TXT", 1_500_000), ("b.", "A", 0), ("b.", "A", 2_000_000)], "qname string, qtype string, ts_us bigint")
    assert {(r.qname, r.qtype): (r.queries, r.repeated) for r in names.repeated_queries(q).collect()} == {("a.", "A"): (5, 3), ("a.", "TXT"): (1, 0), ("b.", "A"): (2, 0)}


def test_sacks(packets):  # noqa: F811
    block = lambda *edges: F.array(*[F.struct(F.lit(a).cast("bigint").alias("left"), F.lit(b).cast("bigint").alias("right")) for a, b in edges])
    p = packets(at(1, tcp_ack=500), back(4, tcp_ack=10), at(2, tcp_ack=50), at(3, src_port=9))
    n = F.col("packet_num")
    p = p.withColumn("sack", F.when(n == 1, block((100, 200))).when(n == 2, block((300, 400), (250, 450), (9, 9))).when(n == 3, block((100, 200))))
    c = names.sack_conversations(p)
    r = c.first()
    assert c.count() == 1 and (r.sacks, r.dsacks, r.sacked_bytes, r.distinct_blocks, r.first_us, r.last_us) == (3, 2, 500, 3, 1_000_000, 4_000_000)
    s = names.sack_summary(p, c).first()
    assert (s.tcp_packets, s.sacks, s.with_dsacks, s.sack_share, s.bytes_per_sack) == (4, 3, 1, 75.0, pytest.approx(500 / 3))
    assert names.sack_summary(p, c.limit(0)).first().sack_share == 0.0


def test_fragment_listings(spark):
    rows = [("a", "b", i, i, (1, False, i < 2, 1480 * i, 1480 - 80 * i, 17)) for i in range(3)] + [("a", "b", 9, 9, (2, False, True, 0, 800, 17)), ("a", "b", 10, 10, (3, True, False, 0, 60, 6)), ("c", "d", 1, 1, (1, True, False, 0, 60, 6))]
    p = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts_us bigint, packet_num bigint, frag struct<ip_id:int,df:boolean,mf:boolean,offset_bytes:int,payload_bytes:int,proto:int>")
    g = names.reassembly(p)
    assert [(r.ip_id, r.fragments) for r in names.incomplete_datagrams(g).collect()] == [(1, 3), (2, 1)]  # the second one of 1 is 80 bytes short
    r = names.fragment_flows(p, g).collect()
    assert len(r) == 1 and (r[0].packets, r[0].fragments, r[0].share, r[0].least, r[0].most, r[0].middle) == (5, 4, 80.0, 800, 1480, 1140.0)


def test_findings(packets, spark):  # noqa: F811
    p = packets(*[at(i, tcp_payload_len=9, src_port=5) for i in range(3)], *[at(i, tcp_payload_len=9, src_port=6) for i in range(2)])
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    jitter, gaps = df([("critical",), ("low",)], "severity string"), df([("a", "b")] * 3 + [("c", "d")], "src_ip string, dst_ip string")
    attempts, lookups = df([(1,), (2,), (0,)], "retries int"), df([("timeout",), ("success",)], "status string")
    args = p, tcp.exact_retransmissions(p), jitter, gaps, attempts, lookups
    got = {r.finding: (r.value, r.detail) for r in score.findings(*args, many_gaps=3, many_attempts=1).collect()}
    assert got == {
        "retransmission rate": (60.0, "1.1.1.1:5 -> 2.2.2.2:80"), "critical jitter": (1.0, None), "gaps": (4.0, "a <-> b 75%"), "failed connections": (2.0, None), "dns failures": (50.0, None),
    }
    assert {r.finding for r in score.findings(*args).collect()} == {"retransmission rate", "critical jitter", "dns failures"}
    none = score.findings(p, tcp.exact_retransmissions(p).limit(0), *[x.limit(0) for x in args[2:]])
    assert none.count() == 0


def test_graph_series(packets):  # noqa: F811
    p = packets(*[at(t, tcp_payload_len=9, tcp_seq=int(t * 1000)) for t in (0, 0.1, 0.3)], at(0.35, tcp_payload_len=9, tcp_seq=0), back(0.4, tcp_ack=10_000), *[at(t, src_port=7, tcp_seq=int(t * 1000)) for t in (0, 0.01, 0.02)])
    trips = folds.round_trips(p).join(p.select(F.col("packet_num").alias("ack_num"), "ts_us"), "ack_num")
    got = report.graph_series(timing.jitter(p), timing.jitter_flow_stats(p), trips, tcp.exact_retransmissions(p), 1).collect()
    assert {(r.series, r.ts_us, round(r.value_ms)) for r in got} == {("jitter", 300_000, 100), ("jitter", 350_000, 150), ("rtt", 400_000, 400), ("rtt", 400_000, 300), ("rtt", 400_000, 100), ("retransmission", 350_000, 180)}
    assert {(r.src_port, r.level) for r in got} == {(12345, "critical")}


def test_flow_keys(packets, spark):  # noqa: F811
    p = packets(at(0), back(1), at(2, src_ip="fe80::1", dst_ip="::1", src_port=None, dst_port=None))
    keys = [r.k for r in p.select("packet_num", cols.flow_key().alias("k")).orderBy("packet_num").collect()]
    assert keys == ["1.1.1.1:12345<->2.2.2.2:80"] * 2 + ["::1:0<->fe80::1:0"]
    one_way = [r.k for r in p.select("packet_num", cols.flow_key(False).alias("k")).orderBy("packet_num").collect()]
    assert one_way[1] == "2.2.2.2:80->1.1.1.1:12345"
    texts = [*one_way, keys[0], "a.b:0x1f90 → ::1:ff", "no flow", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(cols.parse_flow(F.col("t")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got] == [
        ("1.1.1.1", 12345, "2.2.2.2", 80), ("2.2.2.2", 80, "1.1.1.1", 12345), ("fe80::1", 0, "::1", 0), ("1.1.1.1", 12345, "2.2.2.2", 80), ("a.b", 8080, "::1", 255), None, None,
    ]
