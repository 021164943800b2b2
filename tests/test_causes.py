"""Root causes, conformance, contexts and the rules for windows, ICMP and fragments on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import names, tcp, traffic
from tidewire.plans import causes, listings, report, score

from .test_packets import at, back, packets  # noqa: F401  (packets is a fixture)


def syn(s, port=1, **kw):
    return at(s, tcp_flags=2, src_port=port, **kw)


def retransmission(p, bursts=None):
    spark = p.sparkSession
    empty = spark.createDataFrame([], "burst_id bigint, start_us bigint, end_us bigint, peak_ratio double")
    got = causes.retransmission_causes(tcp.exact_retransmissions(p), listings.answered_flows(p), bursts or empty, causes.range_table(spark))
    return {r.group: (r.flows, r.scope, r.cause, r.cause_on) for r in got.collect()}


def test_retransmission_causes(packets, spark):  # noqa: F811
    rto = lambda times, dst="2.2.2.2": packets(at(0, tcp_payload_len=9, dst_ip=dst), *[at(t, tcp_payload_len=9, dst_ip=dst) for t in times])
    assert retransmission(packets(syn(0), syn(1), syn(3, 2), syn(4, 2))) == {"syn": (2, "all", "server_unreachable", "2.2.2.2:80")}
    assert retransmission(packets(at(0, tcp_flags=18), at(1, tcp_flags=18))) == {"syn": (1, "all", "client_unreachable", "2.2.2.2:80")}
    assert retransmission(packets(syn(0), syn(1), syn(0, 2, dst_ip="3.3.3.3"), syn(1, 2, dst_ip="3.3.3.3"))) == {"syn": (2, "dominant", "silently_dropped", "2.2.2.2:80")}
    assert retransmission(packets(syn(0), syn(1), syn(0, 2, dst_ip="3.3.3.3"), syn(1, 2, dst_ip="3.3.3.3"), back(2, tcp_flags=4) | {"dst_port": 1})) == {"syn": (2, "dominant", None, None)}
    even = [1 + i * 0.5 for i in range(10)]
    assert retransmission(rto(even)) == {"rto": (1, "all", "traffic_shaping", None)}
    assert retransmission(rto(even[:9])) == {"rto": (1, "all", None, None)} and retransmission(rto([1.3**i for i in range(12)]))["rto"][2] is None
    assert retransmission(rto(even, "169.254.7.7")) == {"rto": (1, "all", "special_address", "Link-Local (APIPA)")}
    assert retransmission(rto(even, "10.1.1.1"))["rto"][2] == "traffic_shaping"
    burst = spark.createDataFrame([(1, 0, 4_000_000, 5.5)], "burst_id bigint, start_us bigint, end_us bigint, peak_ratio double")
    assert retransmission(rto(even), burst)["rto"][2] == "micro_bursts"
    assert retransmission(rto(even), burst.withColumn("end_us", F.lit(3_000_000).cast("bigint")))["rto"][2] == "traffic_shaping"


def test_interval_spread_equals_a_plain_pass(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(10**9)) for g in ("a", "b") for _ in range(200)] + [("c", 5), ("d", 7), ("d", 7)]
    got = {r.g: (r.n, r.cv) for r in causes.interval_spread(spark.createDataFrame(rows, "g string, ts_us bigint"), "g", 10_000_000).collect()}
    for g in ("a", "b"):
        t = sorted(x for k, x in rows if k == g)
        d = [y - x for x, y in zip(t, t[1:])]
        mean = sum(d) / len(d)
        assert got[g] == (200, pytest.approx((sum((x - mean) ** 2 for x in d) / len(d)) ** 0.5 / mean))
    assert got["c"] == (1, None) and got["d"] == (2, None)


def test_longest_prefix(spark):
    extra = (*causes.RANGES, ("10.9.0.0/16", "Inner", "-", True), ("0.0.0.0/0", "Any", "-", False), ("8.8.8.8/32", "One", "-", False))
    df = spark.createDataFrame([(i, a) for i, a in enumerate(["10.9.1.1", "10.8.1.1", "8.8.8.8", "8.8.8.9", "255.255.255.255", "::1", None, "172.31.255.255", "172.32.0.0"])], "i int, ip string")
    label = lambda ranges: [r.range_name for r in causes.with_range(df, "ip", causes.range_table(spark, ranges)).orderBy("i").collect()]
    assert label(extra) == ["Inner", "Private Network", "One", "Any", "Reserved (Future Use)", None, None, "Private Network", "Any"]
    assert label(causes.RANGES)[2:4] == [None, None]


def test_window_jitter_and_dns_causes(packets, spark):  # noqa: F811
    table = causes.range_table(spark)
    flow = lambda dst, port=80, runs=1, us=1_000_000, kind="other": ("1.1.1.1", 5, dst, port, runs, us, kind)
    ddl = "src_ip string, src_port int, dst_ip string, dst_port int, zero_runs bigint, closed_us bigint, kind string"
    one = lambda *rows: [(r.scope, r.severity, r.cause, r.cause_on) for r in causes.window_causes(spark.createDataFrame(list(rows), ddl), table).collect()]
    assert one(flow("2.2.2.2"), flow("2.2.2.2", 81)) == [("all", "low", "slow_receiver", "2.2.2.2:80")]
    assert one(flow("203.0.113.9", runs=5, us=5_000_000)) == [("all", "medium", "special_address", "TEST-NET-3 (Documentation/Testing)")]
    assert one(flow("2.2.2.2", runs=11, us=10_000_000), flow("3.3.3.3")) == [("dominant", "high", None, None)]
    j = lambda *rows: [(r.scope, r.cause, r.cause_on) for r in causes.jitter_causes(spark.createDataFrame([("critical", *r) for r in rows], "severity string, dst_ip string, dst_port int"), table).collect()]
    assert j(("10.0.0.1", 22)) == [("all", "special_address", "Private Network")] and j(("2.2.2.2", 22)) == [("all", "network_path", "2.2.2.2")]
    assert j(("2.2.2.2", 22), ("3.3.3.3", 22), ("4.4.4.4", 9)) == [("none", "service", "SSH")] and j(("2.2.2.2", 7), ("3.3.3.3", 22), ("4.4.4.4", 8)) == [("none", None, None)]
    d = lambda *rows: {r.issue: (r.lookups, r.cause, r.cause_on, r.times) for r in causes.dns_causes(spark.createDataFrame(list(rows), "qname string, server string, status string, rcode string")).collect()}
    assert d(("a.", "s", "timeout", None), ("a.", "s", "timeout", None), ("b.", "s", "timeout", None)) == {"timeout": (3, "repeated_name", "a.", 2)}
    assert d(*[(f"{i}.", "s" if i else "t", "slow", "NOERROR") for i in range(4)]) == {"slow": (4, "resolver", "s", 3)}
    assert d(*[(f"{i}.", f"s{i}", "error", "SERVFAIL" if i else "REFUSED") for i in range(4)]) == {"error": (4, "error_code", "SERVFAIL", 3)}
    assert d(("x.svc.cluster.local", "s", "error", "NXDOMAIN"), ("ok.", "s", "success", "NOERROR")) == {"kubernetes": (1, "kubernetes_lookup", "x.svc.cluster.local", 1)}


def test_syn_conformance(packets):  # noqa: F811
    answer = lambda s, port=1: back(s, tcp_flags=18) | {"dst_port": port}
    p = packets(
        syn(0), syn(1), syn(3), syn(7), answer(7.1),  # 1, 2, 4: as it should be
        syn(0, 2), syn(0.5, 2), answer(0.6, 2),  # too early
        syn(0, 3), syn(1, 3), syn(2, 3), answer(2.1, 3),  # not doubled
        syn(0, 4), syn(1, 4), syn(3.1, 4),  # within the tolerance, never answered
        syn(0, 5), answer(2.5, 5),
    )
    c = tcp.syn_conformance(p)
    got = {r.src_port: (r.intervals_us, r.expected_us, r.doubles, r.conforms, r.severity) for r in c.collect()}
    s = 1_000_000
    assert got == {
        1: ([s, 2 * s, 4 * s], [s, 2 * s, 4 * s], True, True, "high"), 2: ([s // 2], [s], True, False, "low"), 3: ([s, s], [s, 2 * s], False, False, "medium"),
        4: ([s, 2_100_000], [s, 2 * s], True, True, "critical"), 5: ([], [], True, True, "normal"),
    }
    r = tcp.syn_conformance_summary(c).first()
    assert (r.attempts, r.conform, r.double, r.conform_share, r.mean_timeout_us, r.critical, r.normal) == (5, 3, 4, 0.6, 875_000.0, 1, 1)


def test_context_of_both_directions(packets):  # noqa: F811
    rng, rows = random.Random(9), []
    for i in range(300):
        side = rng.choice((at, back))
        rows.append(side(rng.randrange(60), tcp_seq=rng.randrange(6) * 100, tcp_payload_len=rng.choice((0, 50))))
    p = packets(*rows)
    seen, flows, want = set(), {}, {}
    for r in sorted(p.collect(), key=lambda r: (r.ts_us, r.packet_num)):
        own, other = flows.setdefault(r.src_ip, []), flows.setdefault(r.dst_ip, [])
        own.append(r)
        key = (r.src_ip, r.tcp_seq, r.tcp_payload_len)
        if r.tcp_payload_len and key in seen:
            ahead = own[-10:][-5:]
            there = [x for x in other[-10:] if ahead[0].ts_us <= x.ts_us <= ahead[-1].ts_us][-5:]
            want[r.packet_num] = (len(ahead), len(there), ",".join(str(x.packet_num) for x in sorted(ahead + there, key=lambda x: x.ts_us)[:10]))
        seen.add(key) if r.tcp_payload_len else None
    got = {r.packet_num: (r.n_forward, r.n_reverse, r.context) for r in listings.retransmission_context(p).collect()}
    assert got == want and len(want) > 100


def test_window_runs(packets):  # noqa: F811
    win = lambda s, w, **kw: at(s, tcp_window=w, **kw)
    p = packets(win(0, 9000), win(1, 0), win(2, 0), win(4, 500), win(5, 0), at(9, src_port=9), at(30, protocol="UDP", src_port=3, tcp_flags=None))
    assert {(r.start_us, r.duration_us, r.packets) for r in tcp.zero_window_periods(p).collect()} == {(1_000_000, 3_000_000, 2), (5_000_000, 4_000_000, 1)}
    r = tcp.window_stats(p, settle=3).where("src_port = 12345").first()
    assert (r.zero_windows, r.zero_runs, r.closed_us, r.first_zero_us, r.low_windows, r.low_share, r.min_window) == (3, 2, 7_000_000, 1_000_000, 1, 50.0, 0)
    long = packets(*[win(i, 0 if i == 20 else 100) for i in range(40)])
    stats = tcp.window_bottleneck(tcp.window_stats(long))
    assert stats.first().bottleneck == "receiver" and listings.with_window_group(stats).first().kind == "receiver"
    stats = tcp.window_bottleneck(tcp.window_stats(packets(win(0, 0), win(0.5, 1))))
    assert stats.first().bottleneck == "none" and listings.with_window_group(stats).first().kind == "other"


def test_icmp_targets(packets, spark):  # noqa: F811
    icmp = {"protocol": "ICMP", "src_ip": "192.168.1.1", "dst_ip": "192.168.1.100"}
    p = packets(*[icmp | {"icmp_type": t, "icmp_code": c} for t, c in ((3, 3), (3, 4), (3, 4), (13, 0), (3, 9))])
    assert {r.name for r in names.icmp_summary(p).collect()} >= {"Type 13", "Destination Unreachable - Code 9"}
    assert [tuple(r) for r in names.unreachable_targets(p).collect()] == [("Unknown (from 192.168.1.1)", 4, "Destination Unreachable - Fragmentation Needed and DF Set")]
    n = F.col("packet_num")
    deep = p.withColumn("icmp", F.struct(F.when(n == 2, 1400).cast("int").alias("mtu"), F.lit(None).cast("string").alias("orig_src"), F.when(n < 3, "8.8.8.8").alias("orig_dst")))
    assert {tuple(r) for r in names.path_mtu_issues(deep).collect()} == {("8.8.8.8", 1, 1400), ("Unknown (from 192.168.1.1)", 1, 1500)}
    assert names.unreachable_targets(deep).first().target == "8.8.8.8"


def test_fragments_follow_each_other(spark):
    frag = lambda i, *parts: [("a", "b", 1000 * i + k, 100 * i + k, (i, False, mf, off, size, 17)) for k, (mf, off, size) in enumerate(parts)]
    rows = [
        *frag(1, (True, 0, 1480), (True, 1480, 1480), (False, 2960, 100)), *frag(2, (False, 2960, 100), (True, 1480, 1480), (True, 0, 1480)), *frag(3, (True, 0, 1480), (True, 0, 1480), (False, 1480, 9)),
        *frag(4, (True, 0, 1480), (True, 1472, 1480), (False, 2952, 9)), *frag(5, (True, 0, 1480), (True, 1480, 8)), *frag(6, (True, 8, 8), (False, 16, 8)), *frag(7, (True, 0, 8), (False, 8, 8), (False, 16, 8)), *frag(8, (False, 0, 50)),
    ]
    f = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts_us bigint, packet_num bigint, frag struct<ip_id:int,df:boolean,mf:boolean,offset_bytes:int,payload_bytes:int,proto:int>")
    got = {r.ip_id: (r.complete, r.total) for r in names.reassembly(f).collect()}
    assert got == {1: (True, 3060), 2: (True, 3060), 3: (False, 1489), 4: (False, 2961), 5: (False, None), 6: (False, 24), 7: (True, 24)}


def test_jump_between_neighbours_and_rounded_scores(packets, spark):  # noqa: F811
    year = 31_536_000
    assert report.capture_sanity(packets(at(0), at(year - 1, src_port=2), at(2 * year - 2, src_port=3))).first().verdict == "valid"
    r = report.capture_sanity(packets(at(0), at(year + 1, src_port=2), at(1, src_port=3))).first()
    assert (r.verdict, r.jump_us) == ("time jump", (year + 1) * 1_000_000)
    m = spark.createDataFrame([(0.0123, 0.06, 0.001, 0.001, 0.011, 1.0)], ", ".join(f"{x} double" for x in score.METRICS))
    got = score.health_score(m).first()
    parts = [got[f"{x}_penalty"] for x in score.METRICS]
    assert parts == pytest.approx([4.52, 0.36, 0.4, 0.12, 0.08, 0.1]) and got.score == 94.4 and got["class"] == 1


def test_ranges_by_blocks(packets, spark):  # noqa: F811
    p = packets(*[at(0, dst_ip=x) for x in ("10.0.0.1", "10.255.255.255", "11.0.0.0", "::1", "10.7.0.9")])
    ranges = spark.createDataFrame([("ten", 10 << 24, (11 << 24) - 1), ("nine", (10 << 24) + (7 << 16) + 9, (10 << 24) + (7 << 16) + 9)], "label string, lo bigint, hi bigint")
    assert {(r.label, r.packets) for r in traffic.label_ranges(p, ranges).collect()} == {("ten", 3), ("nine", 1), ("public", 2)}
