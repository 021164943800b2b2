"""Retransmissions, anomalies, round trips and rapid moves on hand-made packets, and the same over shuffled streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewire import queries
from tidewire.operators import folds, security, steps
from tidewire.schema import PACKET_SCHEMA
from tidewire.streaming import stream

from .test_packets import at, back, packets  # noqa: F401  (packets is a fixture)

SYN = {"tcp_flags": 2}


def data(s, seq, size=100, **kw):
    return at(s, tcp_seq=seq, tcp_payload_len=size, **kw)


def again(p, **kw):
    return [(r.packet_num, r.original_num, r.kind) for r in folds.retransmissions(folds.segment_events(p, **kw)).orderBy("packet_num").collect()]


def handshake(s, isn, peer=5000):
    return [at(s, tcp_seq=isn, **SYN), back(s + 0.01, tcp_seq=peer, tcp_ack=isn + 1, tcp_flags=18), at(s + 0.02, tcp_seq=isn + 1, tcp_ack=peer + 1)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        # the port is used again with another number
        ([at(1, **SYN), data(1.05, 1001), at(1.1, tcp_seq=1101, tcp_flags=17), at(1.15, tcp_seq=2000, **SYN), data(1.2, 2001)], []),
        ([at(1, **SYN), data(1.05, 1001), at(1.1, tcp_seq=1101, tcp_flags=17), at(1.15, tcp_seq=900, **SYN), data(1.2, 1001)], []),
        # two segments sent again in one connection
        ([at(1, **SYN), data(1.05, 1001), data(1.1, 1101), data(1.35, 1001), data(1.4, 1101)], [(4, 2, "RTO"), (5, 3, "RTO")]),
        # after a reset any packet starts anew, not only a SYN
        ([at(1, **SYN), data(1.05, 1001, 50), at(1.1, tcp_seq=1051, tcp_flags=4), data(1.3, 1001, 50)], []),
        # idle for 300 seconds
        ([data(1, 1001), data(301, 1001)], []),
        ([data(1, 1001), data(300.9, 1001)], [(2, 1, "RTO")]),
        # a FIN that isn't acknowledged for 30 seconds, then data under the same number
        ([*handshake(1, 1000), data(1.1, 1001), at(1.2, tcp_seq=1101, tcp_ack=5001, tcp_flags=17), data(31.3, 1001)], []),
        ([*handshake(1, 1000), data(1.1, 1001), at(1.2, tcp_seq=1101, tcp_ack=5001, tcp_flags=17), data(31.1, 1001)], [(6, 4, "RTO")]),
        # the SYN again after a second; a SYN soon after is no fast retransmission
        ([at(1, **SYN), at(2, **SYN)], [(2, 1, "RTO")]),
        ([at(1, **SYN), at(1.02, **SYN)], [(2, 1, "Retransmission")]),
        # a lost segment that was never seen before is asked for by duplicate ACKs; the highest one stands for it
        ([data(100, 1000), data(100.1, 1200), back(100.2, tcp_ack=1100), *[back(100.3 + i / 10, tcp_ack=1100) for i in range(3)], data(100.6, 1100)], [(7, 2, "Fast Retransmission")]),
        # the sender's own acknowledgements write the slot too: the count starts again
        ([data(100, 1000), back(100.2, tcp_ack=1100), *[back(100.3 + i / 10, tcp_ack=1100) for i in range(3)], at(100.55, tcp_ack=77), data(100.6, 1100)], []),
    ],
)
def test_state_machine(packets, rows, want):  # noqa: F811
    assert again(packets(*rows)) == want


def test_both_directions_restart(packets):  # noqa: F811
    first = [*handshake(1, 1000), data(1.03, 1001, tcp_ack=5001), back(1.04, tcp_seq=5001, tcp_ack=1101), back(1.05, tcp_seq=5001, tcp_ack=1101, tcp_payload_len=200), at(1.06, tcp_seq=1101, tcp_ack=5201)]
    second = [at(1.15, tcp_seq=2000, **SYN), back(1.16, tcp_seq=4000, tcp_ack=2001, tcp_flags=18), at(1.17, tcp_seq=2001, tcp_ack=4001), back(1.18, tcp_seq=4001, tcp_ack=2001, tcp_payload_len=200)]
    assert again(packets(*first, at(1.1, tcp_seq=1101, tcp_ack=5201, tcp_flags=17), *second)) == []
    rapid = [r for i in range(5) for r in [*handshake(1 + i / 10, 1000 + 500 * i, 9000 - 700 * i), data(1.03 + i / 10, 1001 + 500 * i, tcp_ack=9001 - 700 * i)]]
    assert again(packets(*rapid)) == []


def test_anomalies_severity_and_report(packets):  # noqa: F811
    rows = [data(1 + i / 100, 1000 + 100 * i, tcp_flags=8) for i in range(40)] + [data(2 + i, 1000 + 100 * i, tcp_flags=8) for i in range(10)]
    rows += [back(20 + i / 10, tcp_ack=77, tcp_window=0) for i in range(3)]
    p = packets(*rows)
    e = folds.segment_events(p)
    found = {k: n for k, n in e.groupBy("event").count().collect()}
    assert found == {"retransmission": 10, "out_of_order": 10, "dup_ack": 2, "zero_window": 3}
    s = {r.src_ip: r for r in folds.flow_severity(p, e).collect()}
    assert (s["1.1.1.1"].severity, s["1.1.1.1"].rate, s["2.2.2.2"].severity, s["2.2.2.2"].zero_windows) == ("critical", 20.0, "none", 3)
    assert folds.flow_severity(p, e, 11).where("severity <> 'none'").count() == 0
    assert folds.flow_severity(p, e, 10, 10, (30.0, 40.0, 50.0)).where("severity = 'low'").count() == 1
    r = folds.segment_report(e, folds.flow_severity(p, e)).first()
    assert (r.flows, r.flows_with_issues, r.retransmissions, r.rto, r.fast, r.other, r.distinct_segments, r.critical_flows) == (2, 1, 10, 10, 0, 0, 10, 1)


def test_round_trips(packets):  # noqa: F811
    trips = lambda *rows, **kw: [(r.packet_num, r.ack_num, r.rtt_us) for r in folds.round_trips(packets(*rows), **kw).orderBy("packet_num").collect()]
    ack = lambda s, n: back(s, tcp_ack=n)
    # a cumulative ACK takes both; a second one takes nothing; a duplicate that waits is passed over
    assert trips(data(0, 1000), data(0.1, 1100), data(0.2, 1000), ack(0.3, 1200), ack(0.4, 1200)) == [(1, 4, 300_000), (2, 4, 200_000)]
    # sent again after it was acknowledged: measured anew
    assert trips(data(0, 1000), ack(0.1, 1100), data(0.5, 1000), ack(0.7, 1100)) == [(1, 2, 100_000), (3, 4, 200_000)]
    # the number waits with its first length
    assert trips(data(0, 1000, 200), data(0.1, 1000, 50), ack(0.2, 1050), ack(0.3, 1200)) == [(1, 4, 300_000)]
    # forgotten after a while, and then free for another
    assert trips(data(0, 1000), data(50, 1000), data(61, 1000), ack(62, 1100)) == [(3, 4, 1_000_000)]
    assert trips(data(0, 1000), ack(0.3, 1100), data(1, 1100), ack(1.01, 1200), at_least_us=100_000) == [(1, 2, 300_000)]


def test_timelines(packets):  # noqa: F811
    rows = [*handshake(1, 1000), *[data(2 + i / 10, 1001 + 100 * i, tcp_ack=5001) for i in range(12)], back(4, tcp_seq=5001, tcp_ack=2201)]
    rows += [data(4.5, 2101, tcp_ack=5001), data(5, 1001, tcp_ack=5001), at(6, tcp_seq=2201, tcp_ack=5001, tcp_flags=17), back(6.1, tcp_seq=5001, tcp_ack=2202, tcp_flags=17)]
    got = {(r.src_ip, r.part): r.packets for r in folds.timelines(packets(*rows)).collect()}
    # 17 is the first sent again: its ten last packets are 7 to 15 and 17, the SYN before them; of the other side 2 and 16
    assert got == {("1.1.1.1", "opening"): "1,2,7,8,9,10,11,12,13,14", ("1.1.1.1", "end"): "10,11,12,13,14,15,16,17,18,19"}
    # only since the state started anew
    again_ = [at(10, tcp_seq=9000, **SYN), at(10.1, tcp_seq=1, tcp_flags=4), at(11, tcp_seq=8000, **SYN), at(12, tcp_seq=8000, **SYN)]
    assert [r.packets for r in folds.timelines(packets(*again_)).collect()] == ["3,4"]


def moves(*pairs):
    return [at(s, tcp_flags=2, src_ip="10.0.0.1", dst_ip=f"10.0.1.{d}", dst_port=22) for s, d in pairs]


def test_rapid_moves(packets):  # noqa: F811
    first = lambda *pairs, **kw: [(r.start_us, r.targets) for r in security.lateral_rapid(packets(*moves(*pairs)), **kw).collect()]
    assert first((0, 1), (100, 2), (299, 3)) == [(0, 3)]
    assert first((0, 1), (100, 2), (301, 3)) == []
    # 1 is taken at 0 and 6, not at 3 nor 5: the window from 6 on reaches 3
    assert first((0, 1), (3, 1), (5, 1), (6, 1), (100, 2), (305, 3)) == [(6_000_000, 3)]
    assert first((0, 1), (3, 1), (5, 1), (100, 2), (304, 3)) == []
    rng = random.Random(4)
    pairs = sorted((rng.randrange(4000) / 2, rng.randrange(5)) for _ in range(300))
    for apart, window in ((5, 20), (11, 9), (2, 40)):
        step = steps.RapidMoves(3, window * 1_000_000, apart * 1_000_000)
        want = [x for i, (s, d) in enumerate(pairs) for x in step.feed((i, round(s * 1e6), "10.0.0.1", d))] + list(step.close())
        assert first(*pairs, window_us=window * 1_000_000, apart_us=apart * 1_000_000) == [x[1:] for x in want]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run_stream(spark, df, folder, name):
    q = df.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(df.schema).parquet(str(folder / "out"))


def test_shuffled_streams_equal_batch(rocks, tmp_path):
    """Packets in random order over six files give what the sorted batch gives, once the watermark has passed them."""
    p = queries.both_ways(queries.packets(rocks, "/root/testdata/sf0.001"))
    later = p.agg(F.max("ts_us")).first()[0] + 400 * 24 * queries.HOUR
    p = p.where(F.col("src_port").isin(22, 445) | F.col("dst_port").isin(22, 445))
    shuffled = p.withColumn("file", F.pmod(F.xxhash64("packet_num"), F.lit(6)))
    for i in range(6):
        shuffled.where(F.col("file") == i).drop("file").orderBy(F.xxhash64("packet_num", F.lit(1))).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    flush = [{"packet_num": 10**9, "ts_us": later, "src_ip": "9.9.9.9", "dst_ip": "9.9.9.8", "ip_version": 4, "ttl": 1, "total_length": 1, "packet_length": 1, "protocol": "TCP", "src_port": 1, "dst_port": 2, "tcp_seq": 1, "tcp_ack": 1, "tcp_flags": 16, "tcp_window": 1, "tcp_payload_len": 0}]
    rocks.createDataFrame([tuple(r.get(f) for f in PACKET_SCHEMA.fieldNames()) for r in flush], PACKET_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/6"))
    src = rocks.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    cases = {
        "trips": (stream.round_trip_stream(src, 96 * queries.HOUR, "100 days"), folds.round_trips(p, 96 * queries.HOUR)),
        "segments": (stream.segment_stream(src, queries.TIMERS, "100 days"), folds.segment_events(p, queries.TIMERS)),
    }
    for name, (df, batch) in cases.items():
        got = run_stream(rocks, df, tmp_path / name, name)
        a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (got, batch))
        assert a == b and len(b) > 50


def test_rapid_move_stream_and_progress(rocks, tmp_path, packets):  # noqa: F811
    rows = [moves((10, 1), (13, 1), (15, 1)), moves((16, 1)), moves((315, 3), (110, 2)), moves((2000, 9)), moves((2001, 9)), moves((40, 4))]
    for i, r in enumerate(rows):
        packets(*r).withColumn("packet_num", F.col("packet_num") + 100 * i).to(PACKET_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        # files are read by time: each a second later than the one before
    import os

    for i in range(len(rows)):
        for f in (tmp_path / f"in/{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    listener = stream.Progress()
    rocks.streams.addListener(listener)
    try:
        src = rocks.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        got = run_stream(rocks, stream.rapid_move_stream(stream.observed(src, "seen"), late="400 seconds"), tmp_path / "m", "moves")
        assert [tuple(r) for r in got.collect()] == [("10.0.0.1", 16_000_000, 3)]
        run_stream(rocks, stream.traffic_windows(src, late="400 seconds"), tmp_path / "w", "windows")
        rocks._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        q, w = listener.queries["moves"], listener.queries["windows"]
        assert (q["input_rows"], q["packets"], q["ended"]) == (9, 9, True) and q["batches"] >= 6
        assert (w["input_rows"], w["late_rows"], w["packets"]) == (9, 1, 0)
    finally:
        rocks.streams.removeListener(listener)
    p, seen = stream.observed_once(packets(*rows[0]), "once")
    p.write.format("noop").mode("overwrite").save()
    assert seen.get["packets"] == 3
