"""Capture files by byte ranges, and exports of an outside dissector."""

import json
import struct

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewire import queries
from tidewire.operators import folds
from tidewire.sources import adapters, dissector, pcap, ranges

from .test_packets import at, back, ipv4, packets  # noqa: F401  (packets is a fixture)


def address(ip):
    return bytes(int(x) for x in ip.split("."))


def frame(r):
    """An event packet as an Ethernet frame; payloads hold what looks like headers."""
    junk = struct.pack("<4I", 1_704_100_000, 5, 60, 60) * 7
    if r.protocol == "TCP":
        body = struct.pack(">HHIIBBHHH", r.src_port, r.dst_port, r.tcp_seq, r.tcp_ack, 5 << 4, r.tcp_flags, r.tcp_window, 0, 0) + junk[: r.tcp_payload_len]
        body = ipv4(6, body, address(r.src_ip), address(r.dst_ip))
    else:
        body = ipv4(17, struct.pack(">4H", r.src_port, r.dst_port, 8 + r.tcp_payload_len, 0) + junk[: r.tcp_payload_len], address(r.src_ip), address(r.dst_ip))
    return b"\0" * 12 + b"\x08\x00" + body


@pytest.fixture(scope="module")
def event_rows(spark):
    return queries.packets(spark, "/root/testdata/sf0.001").orderBy("packet_num").collect()


def pcap_file(rows):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for r in rows:
        f = frame(r)
        out += struct.pack("<4I", r.ts_us // 1_000_000, r.ts_us % 1_000_000, len(f), len(f)) + f
    return out


def pcapng_file(rows):
    block = lambda kind, body: struct.pack("<2I", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + b"\1\0\0\0" + b"\xff" * 8) + block(1, struct.pack("<HHI", 1, 0, 0))
    for r in rows:
        f = frame(r)
        out += block(6, struct.pack("<5I", 0, r.ts_us >> 32, r.ts_us & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


SAME = ("packet_num", "ts_us", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window")


@pytest.mark.parametrize("make", [pcap_file, pcapng_file])
def test_ranges_read_what_was_written(spark, tmp_path, event_rows, make):
    data = make(event_rows)
    (tmp_path / "a.cap").write_bytes(data)
    (tmp_path / "b.cap").write_bytes(make(event_rows[:7]))
    want = [tuple(r[c] for c in SAME) for r in event_rows]
    for n in (1, 20):
        block = -(-len(data) // n)
        seen = Observation(f"read{n}{make.__name__}")
        got = ranges.read_ranges(spark, str(tmp_path), block, seen=seen).collect()
        assert sorted(tuple(r[c] for c in SAME) for r in got if r.file.endswith("a.cap")) == want
        assert sorted(tuple(r[c] for c in SAME) for r in got if r.file.endswith("b.cap")) == want[:7]
        assert seen.get["packets"] == len(want) + 7
        t = ranges.range_table(spark, str(tmp_path), block)
        assert t.where("NOT met").count() == 0 and ranges.capture_problems(t).count() == 0
        assert t.where(F.col("file").endswith("a.cap")).count() == len(range(0, len(data), block))
    whole = pcap.read_capture(spark, str(tmp_path / "a.cap"), deep=True).drop("file")
    by_range = ranges.read_ranges(spark, str(tmp_path / "a.cap"), 5000, deep=True).drop("file")
    assert whole.schema == by_range.schema and sorted(map(str, whole.collect())) == sorted(map(str, by_range.collect()))
    levels = lambda *bounds: {r.level for r in ranges.expansion(t, *bounds).collect()}
    assert (levels(), levels(0.1), levels(0.1, 0.2)) == ({"ok"}, {"warning"}, {"excessive"})
    assert [r.problem for r in ranges.capture_problems(t, len(data) - 1).collect()] == ["too large"]


def test_bad_files_are_rows(spark, tmp_path, event_rows):
    good = pcap_file(event_rows[:50])
    files = {"good": good, "cut": good[:-5], "empty": b"", "small": good[:10], "text": b"no capture at all, only words" * 9, "broken": good[:2000] + b"\xff" * 3000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for block in (700, 1 << 20):
        t = ranges.range_table(spark, str(tmp_path), block)
        got = {r.file.rsplit("/", 1)[1]: r.problem.split(" at byte")[0] for r in ranges.capture_problems(t).collect()}
        assert got.pop("broken") in ("broken record", "cut short", "ranges don't meet")
        assert got == {"cut": "cut short", "empty": "empty", "small": "too small", "text": "neither pcap nor pcapng"}
        n = {r.file.rsplit("/", 1)[1]: r["count"] for r in ranges.read_ranges(spark, str(tmp_path), block).groupBy("file").count().collect()}
        assert n["good"] == 50 and n["cut"] == 49 and 0 < n["broken"] < 50
    with pytest.raises(Exception, match="nowhere"):
        ranges.range_table(spark, str(tmp_path / "nowhere")).collect()


def test_a_task_holds_a_piece(tmp_path, event_rows, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE", 2000)
    held = []
    monkeypatch.setattr(ranges._Bytes, "need", lambda self, at, n, real=ranges._Bytes.need: (real(self, at, n), held.append(len(self.data)))[0])
    (tmp_path / "a").write_bytes(pcap_file(event_rows))
    reader = ranges.CaptureReader({"path": str(tmp_path / "a"), "block": "20000"}, list(SAME[1:]))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sum(r[3] == "packet" for r in rows) == len(event_rows)
    assert max(x for x in held if x < 1 << 16) <= 4000  # the head of a file is read once, whole


def test_dissector_exports(spark, packets, tmp_path):  # noqa: F811
    data = {"tcp_seq": 1001, "tcp_payload_len": 9, "tcp_flags": 8}
    rows = [at(1, tcp_flags=2), at(2.5, tcp_flags=2), back(3, tcp_flags=18, tcp_seq=500), back(4, tcp_flags=18, tcp_seq=500), at(5, **data), at(5.01, **data), at(5.5, **data)]
    p = packets(*rows)
    own = {r.packet_num: r for r in dissector.own_retransmissions(p).collect()}
    marks = {2: ["tcp.analysis.rto"], 4: ["tcp.analysis.rto"], 6: [dissector.FAST], 7: ["tcp.analysis.rto"]}
    objects = []
    for r in p.collect():
        if r.packet_num in marks:
            fields = {f: [str(r[c])] for c, (f, _, _) in dissector.FIELDS.items()} | {"tcp.flags": [f"0x{r.tcp_flags:04x}"], "frame.time_epoch": [f"{r.ts_us / 1e6:.9f}"]}
            objects.append({"_source": {"layers": fields | {m: ["1"] for m in marks[r.packet_num]}}})
    (tmp_path / "export.json").write_text(json.dumps(objects, indent=1))
    (tmp_path / "export.jsonl").write_text("\n".join(map(json.dumps, objects)))
    texts = spark.createDataFrame([(json.dumps(o),) for o in objects] + [("no json",), ('{"_source": {}}',), (None,)], "value string")
    pipe = spark.createDataFrame([("|".join(str(x) for x in (r.packet_num, r.ts_us / 1e6, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.tcp_seq)),) for r in p.collect() if r.packet_num in marks], "value string")
    cols = [c for c in dissector.COMMON if c not in ("kind", "unreachable")]
    for layers in (dissector.read_export(spark, str(tmp_path / "export.json")), dissector.read_export(spark, str(tmp_path / "export.jsonl")), dissector.parse_export(texts)):
        got = {r.packet_num: r for r in dissector.exported_retransmissions(dissector.exported_packets(layers), p).collect()}
        assert [tuple(got[k]) for k in sorted(got)] == [tuple(own[k]) for k in sorted(own)] and len(own) == 4
    lines = {r.packet_num: r for r in dissector.exported_retransmissions(adapters.retransmission_lines(pipe), p).collect()}
    assert {k: [r[c] for c in cols] for k, r in lines.items()} == {k: [r[c] for c in cols] for k, r in own.items()}
    odd = dissector.exported_packets(dissector.parse_export(spark.createDataFrame([('{"_source": {"layers": {"tcp.seq": ["x"], "tcp.srcport": [], "tcp.flags": ["24"], "ip.src": [null]}}}',)], "value string"))).first()
    assert (odd.tcp_seq, odd.src_port, odd.tcp_flags, odd.src_ip, odd.ts_us, odd.fast) == (0, 0, 24, "", 0, False)


def test_choice_of_backend(packets):  # noqa: F811
    p = packets(at(0, tcp_payload_len=5), at(1, tcp_payload_len=5))
    none = dissector.exported_packets(dissector.parse_export(p.sparkSession.createDataFrame([], "value string")))
    assert dissector.retransmissions(p).count() == dissector.retransmissions(p, none, "builtin").count() == 1
    assert dissector.retransmissions(p, none).count() == 0 == dissector.retransmissions(p, none, "dissector").count()
    for backend in ("dissector", "other"):
        with pytest.raises(ValueError):
            dissector.retransmissions(p, None, backend)
    assert folds.segment_events(p).where("event = 'retransmission'").count() == 1
