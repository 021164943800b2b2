"""Registry and command line on a capture written from events, and values as text."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire import __main__ as cli
from tidewire import queries, registry
from tidewire.functions import text
from tidewire.thresholds import Thresholds

from .test_capture_ranges import pcap_file


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    rows = queries.packets(spark, "/root/testdata/sf0.001").orderBy("packet_num").limit(300).collect()
    f = tmp_path_factory.mktemp("captures") / "a.pcap"
    f.write_bytes(pcap_file(rows))
    return f


def test_all_analyses_write_their_tables(spark, capture, tmp_path, capsys):
    assert cli.main(["analyze", str(capture), "--out", str(tmp_path), "--block", "9000"], spark) == 0
    written = capsys.readouterr().out.split()
    assert set(written) == {p.name for p in tmp_path.iterdir()} and len(written) == len(set(written)) > 30
    assert {r.metric: r.value for r in spark.read.csv(f"{tmp_path}/summary", header=True).collect()}["packets"] == "300"
    assert set(written) >= {"protocol_distribution", "service_classification", "jitter_statistics", "classified_flows", "summary"}


def test_choices(spark, capture, tmp_path, capsys):
    args = ["analyze", str(capture), "--out", str(tmp_path), "--only", "summary,round_trips", "--format", "json", "--src", "10.0.0.9", "--port", "445", "--latency", "0.2"]
    assert cli.main(args, spark) == 0
    n = queries.packets(spark, "/root/testdata/sf0.001").orderBy("packet_num").limit(300).where("dst_ip = '10.0.0.9' AND dst_port = 445").count()
    assert {r.metric: r.value for r in spark.read.json(f"{tmp_path}/summary").collect()}["packets"] == str(n) and n > 0
    assert {p.name for p in tmp_path.iterdir()} == {"summary", "sanity", "round_trips"}
    (capture.parent / "b.pcap").write_bytes(b"nothing of the kind, but long enough")
    assert cli.main(["analyze", str(capture.parent), "--out", str(tmp_path), "--only", "summary"], spark) == 0
    assert "neither pcap nor pcapng" in capsys.readouterr().err
    (capture.parent / "b.pcap").unlink()
    assert cli.main(["analyze", str(capture), "--out", str(tmp_path), "--only", "summary", "--max-bytes", "100", "--show", "3"], spark) == 0
    said = capsys.readouterr()
    assert "too large" in said.err and "|packets" in said.out and {r.metric: r.value for r in spark.read.csv(f"{tmp_path}/summary", header=True).collect()}["packets"] == "0"
    with pytest.raises(ValueError, match="unknown analyses: nothing"):
        cli.main([*args[:5], "nothing"], spark)


def test_config(tmp_path, capsys):
    (tmp_path / "c.json").write_text('{"idle_s": 9, "low_window": 100}')
    assert cli.main(["show-config", "--config", str(tmp_path / "c.json"), "--set", "idle_s=7.5"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert (shown["idle_s"], shown["low_window"], shown["zombie_s"]) == (7.5, 100, Thresholds().zombie_s)
    assert cli.main(["list"]) == 0 and "security" in capsys.readouterr().out.split()
    for bad in ("idle_s=-1", "no_such=1", 'idle_s="x"'):
        with pytest.raises(ValueError):
            cli.thresholds_of(None, [bad])


def test_own_analyses_and_failures(spark, capture):
    from tidewire.sources import ranges

    p = ranges.read_ranges(spark, str(capture))
    try:
        @registry.analysis("own")
        def own(p, t):
            return {"own": p.agg(F.count_if(F.col("tcp_window") < t.low_window).alias("n"))}

        @registry.analysis("broken")
        def broken(p, t):
            raise RuntimeError("no luck\nat all")

        with pytest.raises(ValueError):
            registry.analysis("own")(own)
        seen = []
        tables, problems = registry.run(p, ["broken", "own"], write=lambda name, df: seen.append((name, df.first().n)))
        assert [tuple(r) for r in problems.collect()] == [("broken", "RuntimeError: no luck")] and list(tables) == ["own"] and seen[0][1] > 0
    finally:
        registry.REGISTRY.pop("own"), registry.REGISTRY.pop("broken")


def test_values_as_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    d = lambda s: one(text.duration_text(F.lit(round(s * 1e6))))
    assert [d(s) for s in (0.0123, 4.561, 428.9, 12345)] == ["12.3ms", "4.56s", "7m 8.9s", "3h 25m"]
    i = lambda s: one(text.interval_text(F.lit(round(s * 1e6))))
    assert [i(s) for s in (0.25, 1, 5, 7, 60, 90, 300)] == ["250ms", "1 second (heartbeat?)", "5 seconds (fast polling?)", "7 seconds", "1 minute (cron?)", "1.5 minutes", "5 minutes (monitoring?)"]
    assert [one(text.class_name(F.lit(k))) for k in (0, 5, 9)] == ["excellent", "emergency", "unknown"]
    assert one(text.iso_time(F.lit(1_704_067_200_123_456))) == "2024-01-01 00:00:00.123"
    r = lambda s, level="production": one(text.redact_for(F.lit(s), level))
    assert r("from 2001:db8::1 to 2001:db8:1:2:3:4:5:6, fe80::1 and ::1") == "from 2001:db8::[REDACTED] to 2001:db8::[REDACTED], fe80::[REDACTED] and [IP_REDACTED]"
    assert r("at 12:30:45, 10.28.104.211:80 token=abc aa:bb:cc:dd:ee:ff") == "at 12:30:45, 10.28.XXX.XXX:80 token=[REDACTED] aa:bb:cc:XX:XX:XX"
    assert r("10.28.104.211 token=abc", "development") == "10.28.104.211 token=[REDACTED]" and r("10.1.1.1 token=abc", "debug") == "10.1.1.1 token=abc"
    with pytest.raises(ValueError):
        text.redact_for(F.lit("x"), "loud")
