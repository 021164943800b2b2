"""Operators on hand-made packets, the capture reader on hand-made bytes, and streams."""

import struct

import pytest
from pyspark.sql import functions as F

from tidewire.functions import cols
from tidewire.operators import folds, names, security, steps, tcp, timing, traffic
from tidewire.plans import report, score
from tidewire.schema import PACKET_SCHEMA
from tidewire.sources import adapters, pcap
from tidewire.streaming import stream
from tidewire.thresholds import Thresholds

FIELDS = PACKET_SCHEMA.fieldNames()


@pytest.fixture
def packets(spark):
    def make(*rows):
        out = []
        for i, r in enumerate(rows, 1):
            d = {"packet_num": i, "ts_us": 0, "src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "ip_version": 4, "ttl": 64, "total_length": 140, "packet_length": 154, "protocol": "TCP",
                 "src_port": 12345, "dst_port": 80, "tcp_seq": 1000, "tcp_ack": 0, "tcp_flags": 0x10, "tcp_window": 8192, "tcp_payload_len": 0} | r
            out.append(tuple(d.get(f) for f in FIELDS))
        return spark.createDataFrame(out, PACKET_SCHEMA)

    return make


def at(s, **kw):
    return {"ts_us": round(s * 1_000_000)} | kw


def back(s, **kw):
    return at(s, src_ip="2.2.2.2", dst_ip="1.1.1.1", src_port=80, dst_port=12345, **kw)


def test_handshake(packets):
    p = packets(at(1.0, tcp_flags=2), back(1.05, tcp_flags=18, tcp_seq=2000, tcp_ack=1001), at(1.1, tcp_ack=2001), at(9, tcp_flags=2, src_port=1))
    r = {x.src_port: x for x in folds.handshakes(p).collect()}
    assert (r[12345].synack_us - r[12345].syn_us, r[12345].total_us, r[12345].slow) == (50_000, 100_000, False)
    assert r[1].ack_us is None


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([at(100, tcp_payload_len=100), at(100.2, tcp_payload_len=100)], [(2, 1, "RTO")]),
        ([at(1, tcp_payload_len=100), back(1.1, tcp_ack=1100), at(1.2, tcp_payload_len=100)], [(3, 1, "Spurious Retransmission")]),
        ([at(1, tcp_flags=2), at(1.1, tcp_seq=1001, tcp_payload_len=100), at(1.2, tcp_seq=1101, tcp_flags=17), at(2, tcp_seq=2000, tcp_flags=2), at(2.1, tcp_seq=2001, tcp_payload_len=100)], []),
        ([at(1, tcp_flags=2), at(1.05, tcp_seq=1001, tcp_payload_len=10), at(1.35, tcp_seq=1001, tcp_payload_len=10)], [(3, 2, "RTO")]),
        ([at(1, tcp_flags=2), at(1.1, tcp_seq=1001, tcp_payload_len=10), at(1.2, tcp_flags=4), at(2, tcp_flags=2, tcp_seq=5000), at(2.1, tcp_seq=1001, tcp_payload_len=10)], []),
        ([at(1, tcp_payload_len=10), *[back(1.1 + i / 100, tcp_ack=1000) for i in range(4)], at(1.3, tcp_payload_len=10)], [(6, 1, "Fast Retransmission")]),
    ],
)
def test_retransmissions(packets, rows, want):
    got = folds.retransmissions(folds.segment_events(packets(*rows))).orderBy("packet_num").collect()
    assert [(r.packet_num, r.original_num, r.kind) for r in got] == want


def test_jitter_gaps_and_syn_retries(packets):
    u = {"protocol": "UDP", "tcp_flags": None, "dst_port": 5000}
    assert timing.jitter(packets(at(0, **u), at(0.1, **u), at(0.3, **u))).first().jitter_us == 100_000
    assert timing.gaps(packets(at(0, dst_port=22), at(1.3, dst_port=22))).count() == 0
    d = {"protocol": "UDP", "tcp_flags": None, "dst_port": 53}
    assert timing.gaps(packets(at(0, **d), at(6.1, **d))).first().gap_us == 6_100_000
    s = packets(at(0, tcp_flags=2), at(1, tcp_flags=2), at(3, tcp_flags=2, tcp_seq=77))
    assert [(r.tcp_seq, r.retries) for r in tcp.syn_retries(s).collect()] == [(1000, 1)]


def test_no_connection_is_held_whole(packets, spark):
    """A long connection is read over many small batches; no plan groups packets into pandas frames."""
    import random

    rng, rows = random.Random(7), []
    for i in range(600):
        side, port = rng.choice((at, back)), rng.choice((22, 22, 22, 445))
        ends = {"dst_port" if side is at else "src_port": port, "tcp_flags": rng.choice((2, 18, 16, 24, 24, 17, 4)), "tcp_payload_len": rng.choice((0, 100))}
        rows.append(side(rng.randrange(90), tcp_seq=rng.randrange(4) * 100, tcp_ack=rng.randrange(4) * 100 + 1) | ends)
    p = packets(*rows)
    plain = sorted(p.select("src_ip", "src_port", "dst_ip", "dst_port", *folds.COLUMNS).collect(), key=lambda r: (r.ts_us, r.packet_num))
    groups, tries = {}, {}
    for r in plain:
        groups.setdefault(frozenset(((r.src_ip, r.src_port), (r.dst_ip, r.dst_port))), []).append(tuple(r[c] for c in folds.COLUMNS))
        if r.dst_port in (22, 445):
            tries.setdefault((r.src_ip, r.dst_ip, r.dst_port), []).append(r)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = folds.handshakes(p), folds.segment_events(p), security.brute_force(p, 1, -1.0)
        for df, make in zip(found, (steps.Handshakes, lambda: steps.Segments(steps.Timers()))):
            want = []
            for g in groups.values():
                step = make()
                want += [x for r in g for x in step.feed(r)] + list(step.close())
            got = [tuple(r)[: len(want[0])] for r in df.collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 20
        for r in found[2].collect():
            n, last, seen = 0, set(), set()
            for x in tries[r.src_ip, r.dst_ip, r.dst_port]:
                if x.tcp_flags == 2:
                    n += 1
                elif x.tcp_flags == 24 and x.src_port not in seen and n:
                    seen.add(x.src_port)
                    last.add(n)
            assert (r.attempts, r.established) == (n, len(last)) and n > 10
        for df in found:
            assert "InPandas" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_floods_scans_and_brute_force(packets):
    low = packets(*[at(i * 0.01, tcp_flags=2, src_ip=f"9.9.9.{i % 50}") for i in range(150)])
    assert security.floods(low).count() == 0
    high = packets(*[at(i * 0.001, tcp_flags=2, src_ip=f"9.9.9.{i % 50}") for i in range(3000)])
    assert security.floods(high).first().sources == 50
    scan = security.port_scans(packets(*[at(i * 0.1, tcp_flags=2, dst_port=i) for i in range(1, 31)])).first()
    assert (scan.kind, scan.attempts, scan.severity) == ("horizontal", 30, "critical")
    tries = packets(*[at(i, tcp_flags=2, dst_port=22, src_port=1000 + i) for i in range(20)])
    assert security.brute_force(tries).first().severity == "high"


def test_dns_matching(spark):
    q = [(0, 1, 7, 0, 0, "a."), (10_000, 2, 7, 1, 0, "a."), (20_000, 3, 8, 0, 0, "b."), (30_000, 4, 8, 1, 3, "b."), (40_000, 5, 9, 0, 0, "c."), (9_000_000, 6, 10, 0, 0, "d."), (10_500_000, 7, 10, 1, 0, "d.")]
    df = spark.createDataFrame([(*r, "10.0.0.1", 5000 + r[2], "8.8.8.8") for r in q], "ts_us bigint, packet_num bigint, id int, qr int, rcode int, qname string, client string, client_port int, server string")
    got = {r.qname: r.status for r in folds.dns_transactions(df).collect()}
    assert got == {"a.": "success", "b.": "error", "c.": "timeout", "d.": "slow"}



def test_dns_ids_used_again(spark):
    s = 1_000_000
    q = [
        (0, 1, 0, None, "a.", 5000, 7), (60 * s, 2, 0, None, "b.", 5001, 7), (60 * s + 9, 3, 1, 0, "b.", 5001, 7),  # another port's lookup was never answered
        (0, 4, 0, None, "c.", 5000, 8), (60 * s, 5, 0, None, "d.", 5000, 8), (60 * s + 9, 6, 1, 3, "d.", 5000, 8),  # nor the same port's
        (0, 7, 0, None, "e.", 5000, 9), (1, 8, 0, None, "f.", 5001, 9), (2, 9, 1, 0, "f.", 5001, 9), (3, 10, 1, 3, "e.", 5000, 9),  # two at once
        (0, 11, 0, None, "g.", 5000, 10), (2 * s, 12, 0, None, "g.", 5000, 10), (2 * s + 9, 13, 1, 0, "g.", 5000, 10),  # sent again
        (0, 14, 0, None, "h.", 5000, 11), (6 * s, 15, 1, 0, "h.", 5000, 11),  # late, the id not used again
    ]
    df = spark.createDataFrame([(*r, "10.0.0.1", "8.8.8.8") for r in q], "ts_us bigint, packet_num bigint, qr int, rcode int, qname string, client_port int, id int, client string, server string")
    got = {(r.qname, r.status, r.took_us) for r in folds.dns_transactions(df).collect()}
    assert got == {("a.", "timeout", None), ("b.", "success", 9), ("c.", "timeout", None), ("d.", "error", 9), ("e.", "error", 3), ("f.", "success", 1), ("g.", "success", 9), ("h.", "slow", 6 * s)}


def test_icmp_fragments_and_sack(spark, packets):
    p = packets(*[{"protocol": "ICMP", "icmp_type": 3, "icmp_code": c} for c in (4, 4, 1)], {"protocol": "ICMP", "icmp_type": 8, "icmp_code": 0})
    assert {(r.name, r.severity): r.packets for r in names.icmp_summary(p).collect()}["Destination Unreachable - Fragmentation Needed and DF Set", "error"] == 2
    assert names.unreachable_targets(p).first().reason == "Destination Unreachable - Fragmentation Needed and DF Set"
    f = spark.createDataFrame([("a", "b", o, o, (1, False, m, o, n, 17)) for m, o, n in ((True, 0, 1480), (True, 1480, 1480), (False, 2960, 100))] + [("a", "b", 0, 0, (2, False, True, 0, 8, 17))],
                              "src_ip string, dst_ip string, ts_us bigint, packet_num bigint, frag struct<ip_id:int,df:boolean,mf:boolean,offset_bytes:int,payload_bytes:int,proto:int>")
    assert {r.ip_id: r.complete for r in names.reassembly(f).collect()} == {1: True, 2: False}
    s = packets({"tcp_ack": 500}).withColumn("sack", F.expr("array(named_struct('left', 100L, 'right', 200L))"))
    assert names.sack_flows(s).first().dsacks == 1


def test_health_score(spark):
    rows = [(0.0, 0.05, 0.0, 0.0, 0.0, 0.0), (0.005, 0.08, 0.0, 0.0, 0.0, 0.0), (1.0, 5.0, 1.0, 1.0, 1.0, 900.0)]
    got = score.health_score(spark.createDataFrame(rows, "retransmission double, rtt double, loss double, dns double, jitter double, anomaly double")).collect()
    assert [r["class"] for r in got] == [0, 0, 5] and got[0].score == 100.0


def test_all_metrics(packets, spark):
    p = packets(at(0, tcp_payload_len=9), at(1, tcp_payload_len=9), at(2, tcp_payload_len=9), back(3))
    lookups = spark.createDataFrame([("success",), ("timeout",), ("error",), ("slow",)], "status string")
    args = p, spark.createDataFrame([(60_000,)], "rtt_us bigint"), tcp.exact_retransmissions(p)
    got = score.all_metrics_of(*args, lookups, spark.createDataFrame([(100_000,), (500_000,)], "jitter_us bigint"))
    r = score.health_score(got).first()
    assert [r[m] for m in score.METRICS] == pytest.approx([0.5, 0.06, 0.25, 0.5, 0.3, 0.0])
    assert (r.loss_penalty, r.dns_penalty, r.jitter_penalty) == pytest.approx((20.0, 13.5, 10.0))
    none = score.all_metrics_of(*args, lookups.limit(0), spark.createDataFrame([], "jitter_us bigint")).first()
    assert none.dns is None and none.jitter is None
    from tidewire import queries

    r = queries.QUERIES["health_score_full"](spark, "/root/testdata/sf0.001").first()
    assert all(r[m] is not None for m in score.METRICS) and r.dns > 0.3 and r.jitter > 0.2 and 0 <= r.score <= 55


def test_column_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(cols.flag_names(F.lit(0x12))) == "SYN,ACK" and one(cols.flag_names(F.lit(0))) == "NONE"
    assert one(cols.ip_num(F.lit("10.0.0.1"))) == 10 * 2**24 + 1 and one(cols.ip_num(F.lit("::1"))) is None
    assert one(cols.entropy(F.lit("aabb"))) == 1.0 and one(cols.entropy(F.lit(""))) == 0.0
    assert one(cols.is_internal(F.lit("172.16.0.1"))) and not one(cols.is_internal(F.lit("172.32.0.1")))
    assert one(cols.redact(F.lit("from 45.1.2.3 password=abc"))) == "from 45.1.XXX.XXX password=[REDACTED]"
    with pytest.raises(ValueError):
        Thresholds().override(idle_s=-1)


def test_report(packets, tmp_path, spark):
    p = packets(at(0), at(1), at(1))
    assert {r.metric: r.value for r in report.summary(p).collect()}["packets"] == "3"
    assert report.capture_sanity(p).first().verdict == "valid"
    report.export_all({"protocols": traffic.protocol_stats(p)}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/protocols"), header=True).first().packets == "3"
    lines = spark.createDataFrame([("5|1.5|1.1.1.1|2.2.2.2|10|20|77",), ("bad",)], "value string")
    assert adapters.retransmission_lines(lines).first().ts_us == 1_500_000


def ipv4(proto, body, src=b"\1\1\1\1", dst=b"\2\2\2\2", flags=0, ident=1):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), ident, flags, 64, proto, 0) + src + dst + body


def tcp_bytes(flags, payload=b"", options=b""):
    return struct.pack(">HHIIBBHHH", 1000, 80, 5, 9, (20 + len(options)) // 4 << 4, flags, 512, 0, 0) + options + payload


def pcap_bytes(frames, link=1, order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return out + b"".join(struct.pack(order + "4I", 10, i, len(f), len(f)) + f for i, f in enumerate(frames))


def test_capture_files(spark, tmp_path):
    eth = b"\0" * 12 + b"\x08\x00"
    dns = struct.pack(">6H", 77, 0x0100, 1, 0, 0, 0) + b"\3www\7example\0" + struct.pack(">2H", 1, 1)
    udp = struct.pack(">4H", 5353, 53, 8 + len(dns), 0) + dns
    sack = b"\1\1\5\x0a" + struct.pack(">2I", 100, 200)
    frames = [eth + ipv4(6, tcp_bytes(2)), b"\0" * 12 + b"\x08\x06" + b"arp" * 10, eth + ipv4(17, udp), eth + ipv4(6, tcp_bytes(24, b"hello", sack)), eth + ipv4(1, bytes([3, 4, 0, 0, 0, 0, 5, 0]) + ipv4(6, b"")), eth[:5]]
    (tmp_path / "a.pcap").write_bytes(pcap_bytes(frames))
    got = pcap.read_capture(spark, str(tmp_path / "a.pcap"), deep=True).orderBy("packet_num").collect()
    assert [r.packet_num for r in got] == [1, 3, 4, 5]
    assert (got[0].tcp_flags, got[0].src_ip, got[0].ts_us) == (2, "1.1.1.1", 10_000_000)
    assert (got[1].dns.qname, got[1].dns.id, got[1].udp_length) == ("www.example.", 77, 8 + len(dns))
    assert got[2].tcp_payload_len == 5 and got[2].sack[0].right == 200
    assert got[3].icmp.mtu == 1280 and got[3].icmp.orig_dst == "2.2.2.2"
    v6 = struct.pack(">IHBB", 6 << 28, 20, 6, 60) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + tcp_bytes(16)
    block = lambda kind, body: struct.pack("<2I", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    ng = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + b"\1\0\0\0" + b"\xff" * 8) + block(1, struct.pack("<HHI", 101, 0, 0))
    ng += block(6, struct.pack("<5I", 0, 0, 3_000_000, len(v6), len(v6)) + v6)
    (tmp_path / "b.pcapng").write_bytes(ng)
    (tmp_path / "c.pcap").write_bytes(pcap_bytes([b"\0" * 16 + ipv4(6, tcp_bytes(2))], link=113, order=">")[:-3])
    r = pcap.read_capture(spark, str(tmp_path / "b.pcapng")).first()
    assert (r.src_ip, r.ip_version, r.ts_us, r.total_length) == ("::1", 6, 3_000_000, 60)
    assert pcap.read_capture(spark, str(tmp_path / "c.pcap")).count() == 0


def test_streams(spark, packets, tmp_path):
    p = packets(at(1.0, tcp_flags=2), back(1.05, tcp_flags=18, tcp_seq=2000, tcp_ack=1001), at(1.1, tcp_ack=2001), at(2, tcp_flags=2, src_port=7))
    p.coalesce(1).write.parquet(str(tmp_path / "in/0"))
    packets(at(500, protocol="UDP", tcp_flags=None)).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    src = lambda: spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for name, df in (("t", stream.traffic_windows(src())), ("s", stream.flow_sessions(src())), ("h", stream.handshake_stream(src()))):
        q = df.writeStream.format("memory").queryName(f"mem_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.protocol, r.packets) for r in spark.table("mem_t").collect()} == {("TCP", 4)}
    assert spark.table("mem_s").count() == 3
    assert spark.table("mem_h").where("status = 'complete'").first().ack_us == 1_100_000


def test_jitter_trend(packets):
    times, t = [0.0], 0.0
    for d in (0.01, 0.02, 0.03, 0.23, 0.03):
        t += d
        times.append(t)
    rows = [at(x, protocol="UDP") for x in times] + [at(x, protocol="UDP", src_port=9) for x in (0, 0.1, 0.2)]
    got = {r.src_port: (r.n, r.trend) for r in timing.jitter_trend(packets(*rows)).collect()}
    assert got == {12345: (4, "degrading"), 9: (1, "stable")}


def test_flow_quality(packets):
    p = packets(*[at(x, tcp_payload_len=10) for x in (0, 0.1, 0.3)], *[at(x, protocol="UDP", src_port=9, tcp_seq=None) for x in (0, 0.1, 0.3)])
    got = report.flow_quality(timing.jitter_flow_stats(p), tcp.rtt_flow_stats(folds.round_trips(p)), tcp.exact_retransmissions(p)).collect()
    assert {(r.src_port, r.jitter_mean_us, r.rtt_mean_us, r.retransmissions) for r in got} == {(12345, 100000.0, None, 2), (9, 100000.0, None, 0)}


def test_syn_delays(packets):
    syn = lambda t, port, seq=1000: at(t, tcp_flags=2, src_port=port, tcp_seq=seq)
    answer = lambda t, port: at(t, tcp_flags=18, src_ip="2.2.2.2", dst_ip="1.1.1.1", src_port=80, dst_port=port)
    p = packets(
        syn(0, 1), syn(1, 1), syn(3, 1), answer(3.2, 1),  # sent again after 1 and 2 seconds, answered late
        syn(0, 2), syn(1, 2),  # never answered
        syn(0, 3), syn(1, 3, 77), answer(1.1, 3),  # another number: a new attempt, answered at once
        syn(0, 4), answer(2.5, 4),
        syn(0, 5), syn(1, 5), at(2, tcp_flags=4, src_port=5),  # given up
        syn(0, 6), syn(20, 6), syn(21, 6), answer(22, 6),  # 20 seconds are too long to be sent again
    )
    got = {r.src_port: (r.retries, r.answered, r.delay_us, r.issue) for r in tcp.syn_delays(p).collect()}
    assert got == {
        1: (2, True, 3_200_000, "server_delayed_response"), 2: (1, False, 1_000_000, "no_synack_received"),
        4: (0, True, 2_500_000, "moderate_network_delay"), 6: (0, True, 22_000_000, "severe_network_delay"),
    }


def test_brute_force_levels(packets):
    """Bounds are exceeded, not reached; failures, speed and the service raise the level."""
    def level(n, gap, port=21, answered=0, **kw):
        rows = [at(i * gap, tcp_flags=2, dst_port=port, src_port=1000 + i, **kw) for i in range(n)]
        rows += [at(i * gap + gap / 2, tcp_flags=24, dst_port=port, src_port=1000 + i, **kw) for i in range(answered)]
        r = security.brute_force(packets(*rows)).first()
        return r and r.severity

    assert level(20, 1, answered=4) == "low" and level(21, 1, answered=4) == "medium" and level(20, 1, 22, answered=4) == "medium"
    assert level(20, 1) == "high" and level(20, 0.1, answered=4) == "high" and level(31, 0.1, answered=6) == "critical"
    assert level(51, 1, answered=12) == "critical" and level(9, 1) is None and level(20, 1, answered=10) is None
    assert level(20, 1, src_ip="10.0.0.1", dst_ip="10.0.0.2") is None and level(20, 1, src_ip="127.0.0.1") is None


def test_scan_kinds_and_levels(packets):
    scan = lambda *pairs: security.port_scans(packets(*[at(i * 10, tcp_flags=2, dst_ip=f"3.3.3.{t}", dst_port=n) for i, (t, n) in enumerate(pairs)])).first()
    one = scan(*[(1, n) for n in range(25)])
    assert (one.kind, one.severity) == ("horizontal", "high")  # 25 ports are medium, all failed
    assert scan(*[(1, n) for n in range(15)]).severity == "medium" and scan(*[(t, 22) for t in range(10)]).kind == "vertical"
    assert scan(*[(n, n) for n in range(12)]).kind == "distributed"


def test_lateral_levels(packets):
    move = lambda n, port, kind=2: packets(*[at(i, tcp_flags=kind, src_ip="10.0.0.1", dst_ip=f"10.0.1.{i}", dst_port=port) for i in range(n)])
    got = [security.lateral_targets(move(n, port)).first().severity for n, port in ((3, 22), (3, 3389), (5, 3389), (7, 22), (10, 22))]
    assert got == ["medium", "high", "medium", "high", "critical"]
    assert security.lateral_targets(move(3, 139, 16)).count() == 1 and security.lateral_spread(move(4, 3389)).count() == 0
    assert [security.lateral_spread(move(n, port)).first().severity for n, port in ((5, 5986), (5, 445), (10, 445))] == ["critical", "medium", "high"]


def test_gap_keys(packets):
    u = {"protocol": "UDP", "tcp_flags": None}
    two = timing.with_gaps(packets(at(0, dst_port=5000, **u), at(9, dst_port=6000, **u), at(0, dst_port=53, dst_ip="8.8.8.8", **u), at(7, dst_port=53, dst_ip="9.9.9.9", **u)))
    assert [r.gap_us for r in two.orderBy("packet_num").collect()] == [None, None, None, 7_000_000]


def test_name_encodings(spark):
    digits = "0123456789abcdef" * 2
    subs = {"a" * 256: [0, 2], digits.upper(): [2], digits: [2], "abcdefghijklmnopqrstuvwxyz0123456789": [1], "abcdefghijklmnopqrstuvwxyz0123456789abcd": [1, 4], "12345678-1234-1234-1234-1234567890ab": [3], "www": []}
    df = spark.createDataFrame([(k,) for k in subs], "s string")
    s = F.col("s")
    got = df.select("s", F.array(*[F.coalesce(x, F.lit(False)) for x in names.encodings(s, cols.entropy(s))]).alias("e")).collect()
    assert {r.s: [i for i, x in enumerate(r.e) if x] for r in got} == subs
    q = spark.createDataFrame([("10.0.0.1", i * 1_000_000, f"{digits}{i}.{d}.", "TXT") for i in range(5) for d in ("svc.cluster.local", "evil.example")], "src_ip string, ts_us bigint, qname string, qtype string")
    assert [(r.domain, r.signs) for r in names.dns_tunnels(q).collect()] == [("evil.example", 3)]
