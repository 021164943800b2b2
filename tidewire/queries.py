"""The driver's queries: operators over the events table as packets, and the DuckDB SQL each is held against.

Capture time runs over days here, so queries pass hour- and day-scale thresholds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cols import entropy, ip_num, redact
from .operators import folds, names, security, tcp, timing, traffic
from .plans import causes, listings, report, score
from .sources import dissector
from .sources.adapters import events_to_packets
from .thresholds import Thresholds

HOUR = 3_600_000_000
SLOW = Thresholds().override(gap_interactive_s=86400, gap_tcp_s=43200, gap_dns_s=43200, gap_icmp_s=86400, gap_other_s=86400)
BURST = Thresholds().override(burst_interval_us=600_000_000, burst_factor=2, burst_min_packets=3, burst_merge_us=1_200_000_000)
SLOTS = Thresholds().override(slot_us=HOUR)
CUTS = {"gap_us": 48 * HOUR, "syn_gap_us": 24 * HOUR, "close_gap_us": 12 * HOUR}
RANGES = [("lan", "10.0.0.0", "10.255.255.255"), ("office", "192.168.0.0", "192.168.255.255"), ("dns", "8.8.8.0", "8.8.8.255")]

PACKETS = """
WITH p AS (SELECT event_id + 1 AS packet_num, epoch_us(ts) AS ts_us, '10.0.0.' || (user_id % 200 + 1) AS src_ip,
  CASE event_type WHEN 'view' THEN '93.184.216.34' WHEN 'click' THEN '192.168.1.10' WHEN 'purchase' THEN '8.8.8.8' WHEN 'error' THEN '203.0.113.7' ELSE '10.0.0.9' END AS dst_ip,
  CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 22 WHEN 'purchase' THEN 53 WHEN 'error' THEN 3389 ELSE 445 END::INT AS dst_port,
  CASE event_type WHEN 'purchase' THEN 'UDP' ELSE 'TCP' END AS protocol, event_type <> 'purchase' AS tcp, (40000 + user_id)::INT AS src_port,
  (40 + floor(value * 10))::INT AS packet_length,
  CASE WHEN event_type <> 'purchase' THEN 1000 + (event_id % 13) * 100 END AS seq, CASE WHEN event_type <> 'purchase' THEN 1000 + (event_id % 11) * 100 END AS ack,
  CASE WHEN event_type <> 'purchase' THEN [2, 18, 16, 24, 17, 4, 16][event_id % 7 + 1] END AS flags,
  CASE WHEN event_type <> 'purchase' THEN CASE WHEN event_id % 17 = 0 THEN 0 ELSE 8192 + (event_id % 5) * 1000 END END AS win,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE 100 END AS payload FROM events),
f AS (SELECT *, (src_ip, src_port) <= (dst_ip, dst_port) AS fw, tcp AND (flags & 2) <> 0 AND (flags & 16) = 0 AS syn, tcp AND (flags & 2) <> 0 AND (flags & 16) <> 0 AS synack,
  tcp AND (flags & 2) = 0 AND (flags & 16) <> 0 AS ackonly, tcp AND (flags & 4) <> 0 AS rst, tcp AND (flags & 1) <> 0 AS fin, tcp AND (flags & 8) <> 0 AS psh FROM p),
e AS (SELECT *, CASE WHEN fw THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN fw THEN src_port ELSE dst_port END AS port_a, CASE WHEN fw THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN fw THEN dst_port ELSE src_port END AS port_b FROM f)
"""
#: Ports that the varied view deals out, by packet number modulo 9 (0 keeps the port), and ICMP types, modulo 8.
VARIED_PORTS = (8080, 4444, 31337, 139, 5986, 1433, 9999, 593)
VARIED_TYPES = (3, 3, 3, 11, 8, 13, 5, 12)
#: The same packets with many ports, UDP beyond DNS, and ICMP, so that the rules' other branches are reached.
VARIED = PACKETS.replace("WITH p AS", "WITH p0 AS").replace("f AS (", """p AS (SELECT * REPLACE (CASE WHEN packet_num % 10 = 3 THEN NULL WHEN packet_num % 9 = 0 THEN dst_port ELSE [8080, 4444, 31337, 139, 5986, 1433, 9999, 593][packet_num % 9] END AS dst_port,
  CASE WHEN packet_num % 10 <> 3 THEN src_port END AS src_port, CASE packet_num % 10 WHEN 3 THEN 'ICMP' WHEN 7 THEN 'UDP' ELSE protocol END AS protocol, tcp AND packet_num % 10 NOT IN (3, 7) AS tcp,
  CASE WHEN packet_num % 10 NOT IN (3, 7) THEN seq END AS seq, CASE WHEN packet_num % 10 NOT IN (3, 7) THEN ack END AS ack, CASE WHEN packet_num % 10 NOT IN (3, 7) THEN flags END AS flags),
  CASE WHEN packet_num % 10 = 3 THEN [3, 3, 3, 11, 8, 13, 5, 12][packet_num // 10 % 8 + 1] END AS icmp_type, CASE WHEN packet_num % 10 = 3 AND packet_num % 30 <> 3 THEN '172.20.0.' || packet_num // 10 % 7 END AS orig_dst, CASE WHEN packet_num % 10 = 3 AND packet_num % 50 <> 3 THEN 1200 + packet_num // 10 % 5 * 50 END AS mtu, CASE WHEN packet_num % 10 = 3 THEN packet_num // 80 % 15 END AS icmp_code FROM p0),
f AS (""", 1)
ENDS = "ip_a, port_a, ip_b, port_b"
FLOW = "src_ip, src_port, dst_ip, dst_port"
PORT_NAME = "CASE {0} WHEN 22 THEN 'SSH' WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 3389 THEN 'RDP' WHEN 8080 THEN 'HTTP-Alt' ELSE 'Unknown' END"
FLOW_SERVICE = "CASE {0} WHEN 22 THEN 'SSH' WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 8080 THEN 'HTTP Alt' END"
INTERNAL = r"({0} LIKE '10.%' OR {0} LIKE '192.168.%' OR regexp_matches({0}, '^172\.(1[6-9]|2[0-9]|3[01])\.'))"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_packets(spark.read.parquet(f"{sf_dir}/events.parquet"))


def over_packets(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Registers a query over the packet view; sql goes on after the common table expressions."""
    QUERIES[name] = lambda spark, sf_dir: run(packets(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = PACKETS + sql


def varied(p: DataFrame) -> DataFrame:
    """The packets of VARIED."""
    n = F.col("packet_num")
    icmp, bare = n % 10 == 3, (n % 10).isin(3, 7)
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int"))
    new = {
        "dst_port": F.when(~icmp, F.when(n % 9 == 0, F.col("dst_port")).otherwise(pick(VARIED_PORTS, F.greatest(n % 9, F.lit(1))))),
        "src_port": F.when(~icmp, F.col("src_port")), "protocol": F.when(icmp, "ICMP").when(bare, "UDP").otherwise(F.col("protocol")),
        **{c: F.when(~bare, F.col(c)) for c in ("tcp_seq", "tcp_ack", "tcp_flags", "tcp_window")},
        "icmp_type": F.when(icmp, pick(VARIED_TYPES, F.floor(n / 10) % 8 + 1)).cast("smallint"), "icmp_code": F.when(icmp, F.floor(n / 80) % 15).cast("smallint"),
    }
    quoted = F.when(icmp & (n % 30 != 3), F.concat(F.lit("172.20.0."), (F.floor(n / 10) % 7).cast("string")))
    detail = F.struct(F.when(icmp & (n % 50 != 3), 1200 + F.floor(n / 10) % 5 * 50).cast("int").alias("mtu"), F.lit(None).cast("string").alias("orig_src"), quoted.alias("orig_dst"))
    return p.select(*[new[c].alias(c) if c in new else F.col(c) for c in p.columns], detail.alias("icmp"))


def over_varied(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(varied(packets(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = VARIED + sql


def over_tables(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


# ---------------------------------------------------------------- traffic

over_packets("top_talkers_ip", traffic.top_talkers, """, r AS (SELECT src_ip AS ip, packet_length AS s, 0 AS r FROM p UNION ALL SELECT dst_ip, 0, packet_length FROM p)
SELECT ip, sum(s)::BIGINT AS bytes_sent, sum(r)::BIGINT AS bytes_received, count(*) AS packets, (sum(s) + sum(r))::BIGINT AS total_bytes FROM r GROUP BY ip ORDER BY total_bytes DESC, ip LIMIT 20""")  # fmt: skip
over_packets("top_conversations", traffic.top_conversations, """SELECT src_ip, dst_ip, count(*) AS packets, sum(packet_length)::BIGINT AS bytes, arg_max(protocol, packet_num) AS protocol,
arg_max(src_port, packet_num) AS src_port, arg_max(dst_port, packet_num) AS dst_port FROM p GROUP BY src_ip, dst_ip ORDER BY bytes DESC, src_ip, dst_ip LIMIT 20""")  # fmt: skip
over_packets("protocol_stats", traffic.protocol_stats, "SELECT protocol, count(*) AS packets, sum(packet_length)::BIGINT AS bytes FROM p GROUP BY protocol")
_T = f"""g AS (SELECT {ENDS}, count(*) AS packets, sum(packet_length)::BIGINT AS bytes, max(ts_us) - min(ts_us) AS span_us FROM e GROUP BY {ENDS}),
t AS (SELECT *, (bytes * 8) / (CASE WHEN span_us <= 0 THEN 1000 ELSE span_us END)::DOUBLE AS mbps FROM g)"""
over_packets("throughput_flows", traffic.top_throughput, f", {_T} SELECT * FROM t ORDER BY mbps DESC, {ENDS} LIMIT 20")
over_packets("slow_flows", lambda p: traffic.slow_flows(p, HOUR, 1.0, 1000), f", {_T} SELECT * FROM t WHERE span_us > {HOUR} AND mbps < 1.0 AND bytes > 1000 ORDER BY mbps, {ENDS} LIMIT 10")
_A = f"""a AS (SELECT protocol, {ENDS}, sum(CASE WHEN fw THEN packet_length ELSE 0 END)::BIGINT AS forward_bytes, sum(CASE WHEN fw THEN 0 ELSE packet_length END)::BIGINT AS reverse_bytes, count(*) AS packets
FROM e GROUP BY protocol, {ENDS}), b AS (SELECT *, CASE WHEN greatest(forward_bytes, reverse_bytes) = 0 THEN 1.0 ELSE least(forward_bytes, reverse_bytes) / greatest(forward_bytes, reverse_bytes)::DOUBLE END AS byte_ratio FROM a
WHERE forward_bytes + reverse_bytes >= 1000 AND packets >= 5), c AS (SELECT *, CASE WHEN byte_ratio < 0.05 THEN 'unidirectional' WHEN byte_ratio < 0.3 THEN 'asymmetric' WHEN byte_ratio >= 0.8 THEN 'symmetric' ELSE 'moderate' END AS kind FROM b)"""
_LIM = {"min_bytes": 1000, "min_packets": 5}
over_packets("asymmetric_flows", lambda p: traffic.asymmetric_flows(p, **_LIM), f", {_A} SELECT * FROM c WHERE byte_ratio < 0.3 ORDER BY byte_ratio, packets DESC, protocol, {ENDS} LIMIT 50")
over_packets("largest_flows", lambda p: traffic.largest_flows(both_ways(p), **_LIM), f", {_A.replace('FROM e GROUP BY', 'FROM (SELECT * REPLACE (CASE WHEN packet_num % 2 = 1 THEN NOT fw ELSE fw END AS fw) FROM e) GROUP BY')} SELECT *, forward_bytes + reverse_bytes AS bytes FROM c ORDER BY bytes DESC, protocol, {ENDS} LIMIT 20")
over_packets("asymmetry_protocols", lambda p: traffic.asymmetry_by_protocol(p, **_LIM), f""", {_A} SELECT protocol, count(*) AS flows, count(*) FILTER (kind = 'unidirectional') AS unidirectional,
count(*) FILTER (kind = 'asymmetric') AS asymmetric, count(*) FILTER (kind = 'moderate') AS moderate, count(*) FILTER (kind = 'symmetric') AS symmetric FROM c GROUP BY protocol""")  # fmt: skip
over_packets("protocol_distribution_l4", traffic.protocol_distribution, "SELECT protocol, count(*) AS packets, count(*) / (SELECT count(*) FROM p)::DOUBLE AS share FROM p GROUP BY protocol")
over_packets("port_top10", traffic.top_ports, f"SELECT protocol, dst_port, count(*) AS packets, {PORT_NAME.format('dst_port')} AS service FROM p GROUP BY protocol, dst_port ORDER BY packets DESC, protocol, dst_port LIMIT 10")
over_packets("unique_flows", traffic.unique_flows, f"SELECT protocol, count(*) AS flows FROM (SELECT DISTINCT protocol, {FLOW} FROM p) GROUP BY protocol")
_SERVICES = f"""g AS (SELECT protocol, {FLOW}, count(*) AS n, sum(packet_length) AS bytes, sum(packet_length * packet_length) AS q, max(ts_us) - min(ts_us) AS span FROM p GROUP BY protocol, {FLOW}),
h AS (SELECT *, bytes / n::DOUBLE AS size, span / 1e6 AS dur, CASE WHEN span > 0 THEN bytes / (span / 1e6) ELSE 0 END AS rate, CASE WHEN n > 1 THEN span / 1e6 / (n - 1) ELSE 0 END AS iat, (q * n - bytes * bytes) / (n * greatest(n - 1, 1))::DOUBLE AS spread FROM g),
k AS (SELECT *, (size >= 1000)::INT * 4 + (rate >= 1e6)::INT * 3 + (dur >= 2)::INT * 2 + (n >= 50)::INT AS s1,
  CASE WHEN protocol = 'TCP' THEN (size >= 1200)::INT * 4 + (dur >= 5)::INT * 3 + (n >= 100)::INT * 2 + (rate >= 5e5)::INT ELSE 0 END AS s2,
  CASE WHEN protocol = 'UDP' THEN (size <= 512)::INT * 4 + (iat >= 0.5)::INT * 3 + (n < 50)::INT * 2 + (dur < 10 OR n < 10)::INT ELSE 0 END AS s3,
  CASE WHEN protocol = 'TCP' THEN (size BETWEEN 200 AND 1200)::INT * 3 + (dur BETWEEN 0.1 AND 30)::INT * 2 + (n BETWEEN 5 AND 100)::INT * 3 + (spread > 50000)::INT * 2 ELSE 0 END AS s4 FROM h),
m AS (SELECT *, greatest(s1, s2, s3, s4) AS best FROM k),
o AS (SELECT n, bytes, coalesce({FLOW_SERVICE.format('dst_port')}, {FLOW_SERVICE.format('src_port')}, CASE WHEN best = 0 THEN 'Unknown' WHEN s1 = best THEN 'Streaming' WHEN s2 = best THEN 'Bulk' WHEN s3 = best THEN CASE WHEN coalesce(dst_port::VARCHAR, '') LIKE '%53%' THEN 'DNS' ELSE 'Control' END ELSE 'Interactive' END) AS service,
  CASE WHEN {FLOW_SERVICE.format('dst_port')} IS NOT NULL THEN 1.0::DOUBLE WHEN {FLOW_SERVICE.format('src_port')} IS NOT NULL THEN 0.9::DOUBLE ELSE best / 10.0::DOUBLE END AS c FROM m)
SELECT service, count(*) AS flows, sum(n)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes, min(c) AS least_confidence FROM o GROUP BY service"""
over_packets("service_classification", traffic.service_summary, f", {_SERVICES}")
over_varied("service_classification_varied", traffic.service_summary, f", {_SERVICES}")
over_varied("protocol_ports_varied", traffic.top_ports, f"SELECT protocol, dst_port, count(*) AS packets, {PORT_NAME.format('dst_port')} AS service FROM p WHERE dst_port IS NOT NULL GROUP BY protocol, dst_port ORDER BY packets DESC, protocol, dst_port LIMIT 10")
over_varied("protocol_distribution_l3", traffic.address_families, "SELECT 'IPv4' AS family, count(*) AS packets, 1.0::DOUBLE AS share FROM p")


def _ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "label string, a string, b string").select("label", ip_num(F.col("a")).alias("lo"), ip_num(F.col("b")).alias("hi"))


over_tables("cidr_label", lambda s, d: traffic.label_ranges(packets(s, d), _ranges(s)), PACKETS + """SELECT CASE WHEN dst_ip LIKE '10.%' THEN 'lan' WHEN dst_ip LIKE '192.168.%' THEN 'office' WHEN dst_ip LIKE '8.8.8.%' THEN 'dns' ELSE 'public' END AS label,
count(*) AS packets, sum(packet_length)::BIGINT AS bytes FROM p GROUP BY 1""")  # fmt: skip

# ---------------------------------------------------------------- timing

_G = f"""g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY kind, src_ip, CASE WHEN flow THEN src_port END, CASE WHEN flow THEN dst_ip END, CASE WHEN flow THEN dst_port END ORDER BY ts_us, packet_num) AS gap_us
FROM (SELECT *, CASE WHEN protocol = 'UDP' AND dst_port = 53 THEN 'DNS' ELSE protocol END AS kind, protocol = 'TCP' OR (protocol = 'UDP' AND dst_port <> 53) AS flow FROM p)),
h AS (SELECT * FROM g WHERE gap_us > CASE WHEN tcp AND dst_port NOT IN (22, 23) THEN {12 * HOUR} WHEN kind = 'DNS' THEN {12 * HOUR} ELSE {24 * HOUR} END)"""
over_packets("gap_detection", lambda p: timing.gaps(p, SLOW), f", {_G} SELECT packet_num, packet_num - 1 AS packet_before, protocol, src_ip, dst_ip, gap_us FROM h")
over_varied("gap_detection_varied", lambda p: timing.gaps(p, SLOW), f", {_G} SELECT packet_num, packet_num - 1 AS packet_before, protocol, src_ip, dst_ip, gap_us FROM h")
over_packets("gaps_marked", lambda p: timing.marked_gaps(p, SLOW), f""", {_G}, m AS (SELECT avg(gap_us) AS mean, count(*) >= 3 AND stddev_samp(gap_us) / avg(gap_us) < 0.1 AS periodic FROM h)
SELECT packet_num, packet_num - 1 AS packet_before, protocol, src_ip, dst_ip, gap_us, NOT periodic OR abs(gap_us - mean) / mean > 0.2 AS abnormal FROM h, m""")  # fmt: skip
over_packets("interval_statistics", timing.interval_statistics, """, d AS (SELECT ts_us - lag(ts_us) OVER (ORDER BY ts_us, packet_num) AS d FROM p), g AS (SELECT count(d) AS n, min(d) AS min_us, max(d) AS max_us, sum(d)::DOUBLE AS s, sum(d::HUGEINT * d)::DOUBLE AS q, quantile_cont(d, 0.5)::DOUBLE AS median_us FROM d)
SELECT n, min_us, max_us, s / n AS mean_us, median_us, sqrt(greatest((q * n - s * s) / (n * (n - 1)::DOUBLE), 0.0)) AS stdev_us, (n + 1) * 1e6 / s AS packets_per_s FROM g""")  # fmt: skip
over_packets("gap_periodicity", lambda p: timing.gap_periodicity(p, SLOW), f", {_G} SELECT count(*) AS n, sum(gap_us) / count(*)::DOUBLE AS mean_us, count(*) >= 3 AND stddev_samp(gap_us) / avg(gap_us) < 0.1 AS periodic FROM h")
_FIVE = f"protocol, {FLOW}"
_J = f"""s0 AS (SELECT *, ts_us - lag(ts_us) OVER w AS d, lag(rst OR fin) OVER w AS closed FROM e WINDOW w AS (PARTITION BY {_FIVE} ORDER BY ts_us, packet_num)),
s1 AS (SELECT *, sum(CASE WHEN d > {48 * HOUR} OR (syn AND d > {24 * HOUR}) OR (closed AND d > {12 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY {_FIVE} ORDER BY ts_us, packet_num ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s0),
s2 AS (SELECT *, ts_us - lag(ts_us) OVER w AS delay FROM s1 WINDOW w AS (PARTITION BY {_FIVE}, session ORDER BY ts_us, packet_num)),
j AS (SELECT * FROM (SELECT *, abs(delay - lag(delay) OVER (PARTITION BY {_FIVE}, session ORDER BY ts_us, packet_num)) AS jitter_us FROM s2) WHERE jitter_us IS NOT NULL)"""
over_packets("jitter_flow_stats", lambda p: timing.jitter_flow_stats(p, **CUTS), f""", {_J} SELECT {_FIVE}, count(*) AS n, sum(jitter_us)::BIGINT AS total_us, min(jitter_us) AS min_us, max(jitter_us) AS max_us, sum(jitter_us) / count(*)::DOUBLE AS mean_us,
list_sort(list(jitter_us))[1 + least(floor(count(*) * 0.95)::BIGINT, count(*) - 1)] AS p95_us, list_sort(list(jitter_us))[1 + least(floor(count(*) * 0.99)::BIGINT, count(*) - 1)] AS p99_us FROM j GROUP BY {_FIVE}""")  # fmt: skip
over_packets("jitter_global", lambda p: timing.jitter_global(p, **CUTS), f", {_J} SELECT count(*) AS n, min(jitter_us) AS min_us, max(jitter_us) AS max_us, sum(jitter_us) / count(*)::DOUBLE AS mean_us FROM j")
over_packets("jitter_sessions", lambda p: timing.jitter_sessions(p, **CUTS), f", {_J} SELECT {_FIVE}, session, count(*) AS packets, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s1 GROUP BY {_FIVE}, session HAVING count(*) >= 3")
over_packets("jitter_trend", lambda p: timing.jitter_trend(p, 12 * HOUR, **CUTS), f""", {_J}, k0 AS (SELECT {_FIVE}, jitter_us, row_number() OVER (PARTITION BY {_FIVE} ORDER BY session, packet_num) AS r, count(*) OVER (PARTITION BY {_FIVE}) AS n FROM j),
k AS (SELECT *, greatest(1, n // 4) AS q FROM k0),
g AS (SELECT {_FIVE}, max(n)::BIGINT AS n, sum(jitter_us) FILTER (r <= q) / max(q)::DOUBLE AS first_us, sum(jitter_us) FILTER (r > n - q) / max(q)::DOUBLE AS last_us, sum(jitter_us) / max(n)::DOUBLE AS mean_us FROM k GROUP BY {_FIVE})
SELECT *, CASE WHEN n < 3 THEN 'stable' WHEN last_us > first_us * 1.5 AND last_us > {12 * HOUR} THEN 'degrading' WHEN mean_us > {12 * HOUR} THEN 'high' ELSE 'stable' END AS trend FROM g""")  # fmt: skip
_W = BURST.burst_interval_us
_B = f"""b0 AS (SELECT ts_us // {_W} AS b, count(*) AS packets, sum(packet_length) AS bytes FROM p GROUP BY 1), m AS (SELECT sum(packets) / count(*)::DOUBLE AS mean FROM b0),
b1 AS (SELECT b0.*, mean, CASE WHEN (b - lag(b) OVER (ORDER BY b)) * {_W} <= {BURST.burst_merge_us} THEN 0 ELSE 1 END AS new FROM b0, m WHERE packets >= greatest(mean * 2, 3.0)),
b2 AS (SELECT *, sum(new) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING)::BIGINT AS burst_id FROM b1),
bursts AS (SELECT burst_id, min(b) * {_W} AS start_us, (max(b) + 1) * {_W} AS end_us, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes, count(*) AS intervals, sum(packets) / count(*)::DOUBLE / max(mean) AS peak_ratio FROM b2 GROUP BY burst_id)"""
over_packets("burst_events", lambda p: timing.bursts(p, BURST), f", {_B} SELECT * FROM bursts")
over_packets("burst_top_sources", lambda p: timing.burst_top_sources(p, BURST), f""", {_B} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY packets DESC, src_ip)::INT AS rank FROM
(SELECT burst_id, src_ip, count(*) AS packets FROM p JOIN bursts ON p.ts_us >= start_us AND p.ts_us < end_us GROUP BY burst_id, src_ip)) WHERE rank <= 5""")  # fmt: skip
_S = f"s AS (SELECT ts_us // {HOUR} AS slot, count(*) AS packets, sum(packet_length)::BIGINT AS bytes, count(DISTINCT src_ip) AS sources, count(*) FILTER (tcp) AS tcp, count(*) FILTER (NOT tcp) AS udp FROM p GROUP BY 1), sm AS (SELECT sum(packets) / count(*)::DOUBLE AS mean, sqrt((count(*) * sum(packets * packets) - sum(packets) * sum(packets)) / (count(*) * count(*))::DOUBLE) AS sd FROM s)"
over_packets("temporal_slots", lambda p: timing.slots(p, SLOTS), f", {_S} SELECT * FROM s")
over_packets("temporal_peaks", lambda p: timing.peaks(p, SLOTS), f", {_S} SELECT slot, packets FROM s, sm WHERE packets > mean + 2 * sd ORDER BY packets DESC, slot LIMIT 20")
over_packets("temporal_valleys", lambda p: timing.valleys(p, SLOTS, share=0.9), f", {_S} SELECT slot, packets FROM s, sm WHERE mean > 10 AND packets < mean - 1.5 * sd AND packets < mean * 0.9 ORDER BY packets, slot LIMIT 10")
over_packets("hourly_distribution", timing.hourly, f"SELECT (ts_us // {HOUR}) % 24 AS hour, count(*) AS packets, sum(packet_length)::BIGINT AS bytes FROM p GROUP BY 1")
over_packets("periodic_patterns", lambda p: timing.periodic(p, HOUR, 200 * HOUR, 12 * HOUR, 20, 5, 0.2), f""", t AS (SELECT src_ip FROM p GROUP BY src_ip HAVING count(*) >= 10 ORDER BY count(*) DESC, src_ip LIMIT 20),
d AS (SELECT src_ip, ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, packet_num) AS d FROM p WHERE src_ip IN (SELECT src_ip FROM t)),
g AS (SELECT src_ip, round_even(d / {12 * HOUR}::DOUBLE, 0)::BIGINT AS interval, count(*) AS count FROM d WHERE d BETWEEN {HOUR} AND {200 * HOUR} GROUP BY ALL),
h AS (SELECT *, sum(count) OVER (PARTITION BY src_ip)::BIGINT AS total FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY count DESC, interval)::INT AS rank FROM h WHERE count >= 5 AND count >= 0.2 * total) WHERE rank <= 3""")  # fmt: skip
over_packets("timeline_decimated", lambda p: timing.timeline(p, SLOTS), f", {_S} SELECT slot, packets FROM (SELECT slot, packets, row_number() OVER (ORDER BY slot) AS r FROM s) WHERE (r - 1) % greatest(1, (SELECT count(*) // 100 FROM s)) = 0")
over_packets("beaconing", lambda p: timing.beacons(p, 5, 0.9, 0.9), """, d AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, packet_num)) // 1000 AS ms FROM p),
g AS (SELECT src_ip, dst_ip, dst_port, count(*) AS n, sum(ms) / (count(*) - 1)::DOUBLE AS mean_ms,
  sqrt((sum(ms::HUGEINT * ms) * (count(*) - 1) - sum(ms)::HUGEINT * sum(ms))::DOUBLE / ((count(*) - 1) * (count(*) - 2))::DOUBLE) / (sum(ms) / (count(*) - 1)::DOUBLE) AS cv,
  sqrt((sum(packet_length::HUGEINT * packet_length) * count(*) - sum(packet_length)::HUGEINT * sum(packet_length))::DOUBLE / (count(*) * (count(*) - 1))::DOUBLE) / (sum(packet_length) / count(*)::DOUBLE) AS scv
  FROM d GROUP BY src_ip, dst_ip, dst_port HAVING count(*) >= 5),
h AS (SELECT *, ((CASE WHEN cv <= 0.9 THEN 40 ELSE 0 END) + (CASE WHEN scv <= 0.9 THEN 30 ELSE 0 END) + (CASE WHEN n >= 20 THEN 20 ELSE 0 END) + (CASE WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' THEN 0 ELSE 10 END))::INT AS score FROM g WHERE mean_ms >= 2000
  AND NOT list_bool_or([abs(mean_ms - 1000.0 * x) <= 200.0 * x FOR x IN [1, 2, 3, 5, 10, 15, 30, 60]]))
SELECT src_ip, dst_ip, dst_port, n, mean_ms, score, CASE WHEN score >= 90 THEN 'critical' WHEN score >= 80 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS severity FROM h WHERE score >= 60""")  # fmt: skip

# ---------------------------------------------------------------- TCP

_TW = f"tw AS (SELECT *, row_number() OVER (PARTITION BY {FLOW} ORDER BY ts_us, packet_num) AS r, lag(win) OVER (PARTITION BY {FLOW} ORDER BY ts_us, packet_num) AS prev, lead(ts_us) OVER (PARTITION BY {FLOW} ORDER BY ts_us, packet_num) AS nxt FROM e WHERE tcp)"
_TS = f"""tz AS (SELECT *, coalesce(win = 0, false) AS zero, CASE WHEN win = 0 THEN coalesce(nxt, (SELECT max(ts_us) FROM tw)) - ts_us END AS closed, coalesce(win = 0, false) AND NOT coalesce(prev = 0, false) AS start FROM tw),
tg AS (SELECT {FLOW}, count(*) AS packets, coalesce(min(win) FILTER (r > 5), min(win))::INT AS min_window, max(win)::INT AS max_window, sum(win) / count(*)::DOUBLE AS mean_window, count(*) FILTER (zero) AS zero_windows, count(*) FILTER (start) AS zero_runs,
coalesce(sum(closed), 0)::BIGINT AS closed_us, min(ts_us) FILTER (zero) AS first_zero_us, count(*) FILTER (win > 0 AND win < 9000) AS low_windows, count(*) FILTER (r > 5) AS settled FROM tz GROUP BY {FLOW}),
ts AS (SELECT * EXCLUDE (settled), CASE WHEN settled > 0 THEN low_windows / settled::DOUBLE * 100.0 ELSE 0.0 END AS low_share FROM tg),
tb AS (SELECT *, CASE WHEN packets < 10 THEN 'none' WHEN zero_runs > 5 OR closed_us > {96 * HOUR} THEN 'application' WHEN low_share > 30 AND zero_runs > 0 THEN 'receiver' ELSE 'none' END AS bottleneck FROM ts),
tk AS (SELECT *, CASE WHEN bottleneck = 'application' OR zero_runs > 5 OR closed_us > {96 * HOUR} THEN 'application' WHEN bottleneck = 'receiver' THEN 'receiver' ELSE 'other' END AS kind FROM tb WHERE zero_runs > 0)"""


def _bottlenecks(p: DataFrame) -> DataFrame:
    return tcp.window_bottleneck(tcp.window_stats(p, 9000, 5), 96 * HOUR, 10)


def _window_groups(p: DataFrame) -> DataFrame:
    return listings.with_window_group(_bottlenecks(p), 96 * HOUR)


over_packets("tcp_window_stats", lambda p: tcp.window_stats(p, 9000, 5), f", {_TW}, {_TS} SELECT * FROM ts")
over_packets("zero_window_periods", tcp.zero_window_periods, f""", {_TW}, {_TS}, z AS (SELECT *, sum(start::INT) OVER (PARTITION BY {FLOW} ORDER BY ts_us, packet_num ROWS UNBOUNDED PRECEDING) AS run FROM tz)
SELECT {FLOW}, min(ts_us) AS start_us, CASE WHEN bool_or(nxt IS NULL) THEN (SELECT max(ts_us) FROM tw) ELSE max(nxt) END - min(ts_us) AS duration_us, count(*) AS packets FROM z WHERE zero GROUP BY {FLOW}, run""")  # fmt: skip
over_packets("tcp_reset_classified", tcp.classified_resets, f""", r AS (SELECT *, bool_or((flags & 2) <> 0) OVER w AS syn_seen, bool_or(psh OR payload > 0) OVER w AS data_seen FROM e WHERE tcp WINDOW w AS (PARTITION BY {ENDS} ORDER BY ts_us, packet_num ROWS UNBOUNDED PRECEDING))
SELECT packet_num, {FLOW}, syn_seen, data_seen, NOT data_seen AS premature FROM r WHERE rst""")  # fmt: skip
over_packets("tcp_reset_flows", tcp.reset_flows, f"SELECT {ENDS}, count(*) FILTER (rst) AS resets, NOT bool_or(psh OR payload > 0) AS premature FROM e WHERE tcp GROUP BY {ENDS} HAVING count(*) FILTER (rst) > 0 ORDER BY resets DESC, {ENDS} LIMIT 10")
over_packets("tcp_connection_states", lambda p: tcp.connection_states(p, 24 * HOUR, 96 * HOUR), f""", g AS (SELECT {ENDS}, count(*) AS packets, (SELECT max(ts_us) FROM e WHERE tcp) - max(ts_us) AS idle_us, count(*) FILTER (syn) AS nsyn,
min((ts_us, packet_num)) FILTER (synack) AS sa, max((ts_us, packet_num)) FILTER (ackonly) AS la, bool_or(fin) AS fin, bool_or(rst) AS rst, bool_or(ackonly AND payload > 0) AS data FROM e WHERE tcp GROUP BY {ENDS})
SELECT {ENDS}, packets, idle_us, CASE WHEN fin THEN 'closed' WHEN rst THEN 'reset' WHEN nsyn > 0 AND sa IS NULL THEN CASE WHEN idle_us > {24 * HOUR} THEN 'syn_timeout' ELSE 'syn_waiting' END
WHEN sa IS NOT NULL AND NOT coalesce(la > sa, false) THEN 'half_open' WHEN coalesce(la > sa, false) AND NOT data THEN CASE WHEN idle_us > {24 * HOUR} THEN 'idle_no_data' ELSE 'established_no_data' END
WHEN data THEN CASE WHEN idle_us > {96 * HOUR} THEN 'zombie' WHEN idle_us > {24 * HOUR} THEN 'idle' ELSE 'active' END ELSE 'unknown' END AS state FROM g""")  # fmt: skip


def both_ways(p: DataFrame) -> DataFrame:
    """The packet view with every second packet turned round, so that acknowledgements meet data."""
    odd = F.col("packet_num") % 2 == 1
    swap = lambda a, b: F.when(odd, F.col(b)).otherwise(F.col(a)).alias(a)
    pairs = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_port": "dst_port", "dst_port": "src_port"}
    return p.select(*[swap(c, pairs[c]) if c in pairs else F.col(c) for c in p.columns])


_R = f"""t AS (SELECT packet_num, ts_us, seq, ack, flags, payload, CASE WHEN packet_num % 2 = 1 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN packet_num % 2 = 1 THEN dst_port ELSE src_port END AS src_port,
CASE WHEN packet_num % 2 = 1 THEN src_ip ELSE dst_ip END AS dst_ip, CASE WHEN packet_num % 2 = 1 THEN src_port ELSE dst_port END AS dst_port FROM e WHERE tcp),
sg AS (SELECT d.packet_num, d.src_ip, d.src_port, d.dst_ip, d.dst_port, d.ts_us, d.seq, min((a.ts_us, a.packet_num)) FILTER (a.packet_num IS NOT NULL) AS m FROM t d LEFT JOIN t a ON a.src_ip = d.dst_ip AND a.src_port = d.dst_port AND a.dst_ip = d.src_ip AND a.dst_port = d.src_port
AND a.ack >= d.seq + d.payload AND (a.ts_us, a.packet_num) > (d.ts_us, d.packet_num) AND a.ts_us - d.ts_us <= {96 * HOUR} AND (a.flags & 16) <> 0 AND a.ack > 0 WHERE d.payload > 0 GROUP BY ALL),
sf AS (SELECT *, coalesce(m, (ts_us + {96 * HOUR}, 9000000000000000000)) AS fin FROM sg),
rtt AS (WITH RECURSIVE c AS (SELECT * FROM sf QUALIFY row_number() OVER (PARTITION BY {FLOW}, seq ORDER BY ts_us, packet_num) = 1
UNION ALL SELECT sf.* FROM (SELECT min((s.ts_us, s.packet_num)) AS k FROM c JOIN sf s USING ({FLOW}, seq) WHERE (s.ts_us, s.packet_num) > c.fin GROUP BY {FLOW}, seq) n JOIN sf ON sf.packet_num = n.k[2])
SELECT packet_num, {FLOW}, m[2] AS ack_num, m[1] - ts_us AS rtt_us FROM c WHERE m IS NOT NULL)"""
_RF = f"""rg AS (SELECT {FLOW}, count(*) AS n, min(rtt_us) AS min_us, max(rtt_us) AS max_us, sum(rtt_us)::DOUBLE AS s, sum(rtt_us::HUGEINT * rtt_us)::DOUBLE AS q, quantile_cont(rtt_us, 0.5)::DOUBLE AS median_us, count(*) FILTER (rtt_us > {24 * HOUR}) AS spikes FROM rtt GROUP BY {FLOW}),
rf AS (SELECT {FLOW}, n, min_us, max_us, s / n AS mean_us, median_us, CASE WHEN n > 1 THEN sqrt(greatest((q * n - s * s) / (n * (n - 1)::DOUBLE), 0.0)) END AS stdev_us, spikes, s / n > {24 * HOUR} OR max_us > {72 * HOUR} AS high FROM rg)"""


def _trips(p: DataFrame, at_least_us: int | None = None) -> DataFrame:
    return folds.round_trips(both_ways(p), 96 * HOUR, at_least_us)


def _trip_stats(p: DataFrame) -> DataFrame:
    return tcp.rtt_flow_stats(_trips(p), 24 * HOUR, 72 * HOUR)


over_packets("rtt_measurements", _trips, f", {_R} SELECT * FROM rtt")
over_packets("rtt_long", lambda p: _trips(p, 48 * HOUR), f", {_R} SELECT * FROM rtt WHERE rtt_us >= {48 * HOUR}")
over_packets("rtt_flow_stats", _trip_stats, f", {_R}, {_RF} SELECT * FROM rf")
_X = f"""x0 AS (SELECT *, first_value(packet_num) OVER w AS original_num, ts_us - first_value(ts_us) OVER w AS delay_us FROM e WHERE tcp AND (payload > 0 OR (flags & 3) <> 0) WINDOW w AS (PARTITION BY {FLOW}, seq, payload ORDER BY ts_us, packet_num)),
x AS (SELECT packet_num, {FLOW}, seq AS tcp_seq, flags AS tcp_flags, original_num, delay_us, CASE WHEN (flags & 2) <> 0 THEN CASE WHEN delay_us >= 500000 THEN 'RTO' ELSE 'Retransmission' END WHEN delay_us >= 200000 THEN 'RTO' WHEN delay_us <= 50000 THEN 'Fast Retransmission' ELSE 'Retransmission' END AS kind
FROM x0 WHERE original_num <> packet_num)"""
over_packets("retrans_exact", lambda p: tcp.exact_retransmissions(p).drop("ts_us"), f", {_X} SELECT * FROM x")
over_packets("retrans_offenders", tcp.retransmission_offenders, f""", {_X}, k AS (SELECT {FLOW}, tcp_flags, count(*) AS c FROM x GROUP BY ALL), g AS (SELECT {FLOW}, sum(c)::BIGINT AS retransmissions, arg_max(tcp_flags, (c, -tcp_flags)) AS fl FROM k GROUP BY {FLOW})
SELECT {FLOW}, retransmissions, CASE WHEN fl & 31 = 0 THEN 'NONE' ELSE concat_ws(',', CASE WHEN fl & 2 <> 0 THEN 'SYN' END, CASE WHEN fl & 1 <> 0 THEN 'FIN' END, CASE WHEN fl & 4 <> 0 THEN 'RST' END, CASE WHEN fl & 8 <> 0 THEN 'PSH' END, CASE WHEN fl & 16 <> 0 THEN 'ACK' END) END AS flags
FROM g ORDER BY retransmissions DESC, {FLOW} LIMIT 10""")  # fmt: skip
over_packets("retrans_flow_groups", tcp.retransmission_groups, f""", {_X}, g AS (SELECT {FLOW}, count(*) AS n, count(*) FILTER ((tcp_flags & 2) <> 0) AS s, count(*) FILTER ((tcp_flags & 2) = 0 AND kind = 'RTO') AS r, count(*) FILTER ((tcp_flags & 2) = 0 AND kind = 'Fast Retransmission') AS f,
count(*) FILTER ((tcp_flags & 2) = 0 AND kind = 'Retransmission') AS o FROM x GROUP BY {FLOW}) SELECT {FLOW}, n, CASE WHEN s >= 0.8 * n THEN 'syn' WHEN r >= 0.8 * n THEN 'rto' WHEN f >= 0.8 * n THEN 'fast' WHEN o >= 0.8 * n THEN 'generic' ELSE 'mixed' END AS kind FROM g""")  # fmt: skip
over_packets("flow_quality", lambda p: report.flow_quality(timing.jitter_flow_stats(p, **CUTS), _trip_stats(p), tcp.exact_retransmissions(p)), f""", {_J}, {_R}, {_X},
jf AS (SELECT {_FIVE}, sum(jitter_us) / count(*)::DOUBLE AS jitter_mean_us, max(jitter_us) AS jitter_max_us FROM j GROUP BY {_FIVE}), rf AS (SELECT {FLOW}, sum(rtt_us) / count(*)::DOUBLE AS rtt_mean_us, max(rtt_us) AS rtt_max_us FROM rtt GROUP BY {FLOW}),
xf AS (SELECT {FLOW}, count(*) AS retransmissions FROM x GROUP BY {FLOW}) SELECT {_FIVE}, jitter_mean_us, jitter_max_us, rtt_mean_us, rtt_max_us, coalesce(retransmissions, 0) AS retransmissions FROM jf LEFT JOIN rf USING ({FLOW}) LEFT JOIN xf USING ({FLOW})""")  # fmt: skip
over_packets("syn_retries", lambda p: tcp.syn_retries(p, 480 * HOUR), f""", s AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {FLOW}, seq ORDER BY ts_us, packet_num) AS gap FROM e WHERE syn)
SELECT {FLOW}, seq AS tcp_seq, count(*) AS attempts, count(*) FILTER (gap < {480 * HOUR}) AS retries, max(ts_us) - min(ts_us) AS span_us FROM s GROUP BY {FLOW}, seq HAVING count(*) FILTER (gap < {480 * HOUR}) > 0""")  # fmt: skip
over_packets("burst_retrans_overlap", lambda p: tcp.bursts_with_retransmissions(p, timing.bursts(p, BURST), 0, 1.0), f""", {_B}, {_X} SELECT burst_id, count(*) AS hits FROM x JOIN p ON p.packet_num = x.packet_num JOIN bursts ON p.ts_us BETWEEN start_us AND end_us GROUP BY burst_id
HAVING count(*) > 0 AND max(peak_ratio) > 1.0""")  # fmt: skip
over_packets("handshake", lambda p: folds.handshakes(both_ways(p), 96 * HOUR, 24 * HOUR), f""", {_R.split("sg AS (")[0]} sy AS (SELECT *, (ts_us, packet_num) AS k FROM t WHERE (flags & 18) = 2),
ha AS (SELECT {FLOW.replace('src_ip', 'sy.src_ip').replace('src_port', 'sy.src_port').replace('dst_ip', 'sy.dst_ip').replace('dst_port', 'sy.dst_port')}, sy.k, min((b.ts_us, b.packet_num, b.seq)) FILTER (b.packet_num IS NOT NULL) AS sa FROM sy LEFT JOIN t b ON b.src_ip = sy.dst_ip AND b.src_port = sy.dst_port AND b.dst_ip = sy.src_ip AND b.dst_port = sy.src_port
AND (b.flags & 18) = 18 AND (b.ts_us, b.packet_num) > sy.k GROUP BY ALL),
hx AS (SELECT ha.k AS hk, min((c.ts_us, c.packet_num)) AS ak FROM ha JOIN t c USING ({FLOW}) WHERE (c.flags & 18) = 16 AND c.ack = sa[3] + 1 AND (c.ts_us, c.packet_num) > (sa[1], sa[2]) GROUP BY ha.k),
hb AS (SELECT ha.*, ak FROM ha LEFT JOIN hx ON hk = k),
hc AS (WITH RECURSIVE r AS (SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY {FLOW} ORDER BY k) = 1
UNION ALL SELECT hb.* FROM (SELECT min(n.k) AS k FROM r JOIN hb n USING ({FLOW}) WHERE r.ak IS NOT NULL AND n.k > r.ak GROUP BY {FLOW}) m JOIN hb ON hb.k = m.k) SELECT {FLOW}, k[1] AS syn_us, sa[1] AS synack_us, ak[1] AS ack_us FROM r)
SELECT *, ack_us - syn_us AS total_us, coalesce(ack_us - syn_us > {96 * HOUR}, false) AS slow, CASE WHEN synack_us IS NULL OR synack_us = syn_us THEN 'unknown' WHEN synack_us - syn_us > {24 * HOUR} THEN CASE WHEN synack_us - syn_us > 500000 THEN 'server' ELSE 'network' END
WHEN ack_us - synack_us > {24 * HOUR} THEN 'client' WHEN ack_us - syn_us > {96 * HOUR} THEN 'network' ELSE 'none' END AS suspected FROM hc""")  # fmt: skip
#: Connections of the events table last for weeks, so they end after days.
TIMERS = folds.Timers(time_wait=48 * HOUR, idle=240 * HOUR, fin=24 * HOUR)


def _segments(p: DataFrame) -> DataFrame:
    return folds.segment_events(both_ways(p), TIMERS)


def as_export(p: DataFrame) -> DataFrame:
    """Repeated segments written as an outside dissector exports them: JSON objects whose fields are lists."""
    r = tcp.exact_retransmissions(p).select("packet_num", "ts_us", *tcp.FLOW, "tcp_seq", "tcp_flags", "kind")
    epoch = F.format_string("%d.%06d000", F.floor(F.col("ts_us") / 1_000_000), F.col("ts_us") % 1_000_000)
    values = {dissector.FIELDS[c][0]: F.col(c).cast("string") for c in ("packet_num", *tcp.FLOW, "tcp_seq")} | {"frame.time_epoch": epoch, "tcp.flags": F.format_string("0x%04x", "tcp_flags")}
    marks = {dissector.RTO: "RTO", dissector.FAST: "Fast Retransmission"}
    layers = F.map_filter(
        F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(v))], *[x for m, k in marks.items() for x in (F.lit(m), F.when(F.col("kind") == k, F.array(F.lit("1"))))]), lambda k, v: v.isNotNull()
    )
    return r.select(F.to_json(F.struct(F.struct(layers.alias("layers")).alias("_source"))).alias("value"))


over_packets("dissector_retransmissions", lambda p: dissector.exported_retransmissions(dissector.exported_packets(dissector.parse_export(as_export(p))), p.where("protocol = 'TCP'")), f""", {_X},
fs AS (SELECT {FLOW}, seq AS tcp_seq, min(packet_num) AS original, arg_min(ts_us, packet_num) AS us FROM e WHERE tcp GROUP BY {FLOW}, seq)
SELECT x.packet_num, {FLOW}, tcp_seq, CASE WHEN original < x.packet_num THEN original END AS original_num, CASE WHEN original < x.packet_num THEN p.ts_us - us END AS delay_us, kind,
CASE WHEN (tcp_flags & 2) <> 0 THEN CASE WHEN (tcp_flags & 16) <> 0 THEN 'client_unreachable' ELSE 'server_unreachable' END END AS unreachable FROM x JOIN fs USING ({FLOW}, tcp_seq) JOIN (SELECT packet_num, ts_us FROM p) p USING (packet_num)""")  # fmt: skip
over_packets("retransmission_full", lambda p: folds.retransmissions(_segments(p)))
over_packets("tcp_anomalies", lambda p: _segments(p).where("event <> 'retransmission'").select("event", "packet_num", "ts_us", *tcp.FLOW, "tcp_seq", "dup_acks", "expected"))
over_packets("retrans_flow_severity", lambda p: folds.flow_severity(both_ways(p), _segments(p), 3, 100))
over_packets("retrans_timelines", lambda p: folds.timelines(both_ways(p), TIMERS))
over_packets("retrans_report", lambda p: folds.segment_report(_segments(p), folds.flow_severity(both_ways(p), _segments(p), 3, 100)))
over_packets("tcp_window_bottleneck", _bottlenecks, f", {_TW}, {_TS} SELECT * FROM tb")
_SD = f"""t AS (SELECT packet_num, ts_us, seq, flags, CASE WHEN packet_num % 2 = 1 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN packet_num % 2 = 1 THEN dst_port ELSE src_port END AS src_port,
CASE WHEN packet_num % 2 = 1 THEN src_ip ELSE dst_ip END AS dst_ip, CASE WHEN packet_num % 2 = 1 THEN src_port ELSE dst_port END AS dst_port FROM e WHERE tcp AND (flags & 7) <> 0),
k AS (SELECT *, CASE WHEN (flags & 18) = 2 THEN 'syn' WHEN (flags & 18) = 18 THEN 'answer' ELSE 'close' END AS kind FROM t),
ev AS (SELECT packet_num, ts_us, seq, kind, {FLOW} FROM k WHERE kind <> 'answer' UNION ALL SELECT packet_num, ts_us, seq, kind, dst_ip, dst_port, src_ip, src_port FROM k WHERE kind <> 'syn'),
n AS (SELECT *, kind = 'syn' AND NOT coalesce(lag(kind) OVER w = 'syn' AND lag(seq) OVER w = seq, false) AS new FROM ev WINDOW w AS (PARTITION BY {FLOW} ORDER BY ts_us, packet_num)),
att AS (SELECT *, sum(new::INT) OVER (PARTITION BY {FLOW} ORDER BY ts_us, packet_num ROWS UNBOUNDED PRECEDING) AS attempt FROM n),
gp AS (SELECT *, CASE WHEN kind = 'syn' AND NOT new THEN ts_us - lag(ts_us) OVER w END AS gap, row_number() OVER w AS r FROM att WHERE attempt > 0 WINDOW w AS (PARTITION BY {FLOW}, attempt ORDER BY ts_us, packet_num)),
lt AS (SELECT *, bool_or(coalesce(gap >= {480 * HOUR}, false)) OVER (PARTITION BY {FLOW}, attempt ORDER BY ts_us, packet_num ROWS UNBOUNDED PRECEDING) AS late FROM gp),
ag AS (SELECT {FLOW}, attempt, min(ts_us) FILTER (kind = 'syn') AS first_us, max(ts_us) FILTER (kind = 'syn' AND NOT late) AS last_us, count(*) FILTER (kind = 'syn' AND NOT late) - 1 AS retries, min((ts_us, packet_num, kind)) FILTER (kind <> 'syn') AS fin, list(gap ORDER BY r) FILTER (kind = 'syn' AND NOT late AND gap IS NOT NULL) AS intervals_us FROM lt GROUP BY {FLOW}, attempt),
dl AS (SELECT *, coalesce(fin[3] = 'answer', false) AS answered, CASE WHEN fin[3] = 'answer' THEN fin[1] ELSE last_us END - first_us AS delay_us FROM ag WHERE fin IS NULL OR fin[3] = 'answer'),
sd AS (SELECT {FLOW}, first_us, retries, answered, delay_us, CASE WHEN NOT answered THEN 'no_synack_received' WHEN delay_us >= 3000000 THEN 'severe_network_delay' WHEN delay_us >= 1000000 THEN 'moderate_network_delay' ELSE 'normal' END AS issue,
coalesce(intervals_us, []) AS intervals_us FROM dl WHERE retries > 0 OR (answered AND delay_us >= {24 * HOUR})),
sx AS (SELECT *, intervals_us[1] AS first_timeout_us, [{24 * HOUR}, {48 * HOUR}, {96 * HOUR}, {192 * HOUR}][1:len(intervals_us)]::BIGINT[] AS expected_us,
coalesce(list_bool_and(list_transform(range(1, len(intervals_us)), lambda i: coalesce(CASE WHEN intervals_us[i] > 0 THEN intervals_us[i + 1] / intervals_us[i]::DOUBLE ELSE 0.0 END BETWEEN 1.0 AND 3.0, false))), true) AS doubles FROM sd),
sc AS (SELECT *, doubles AND coalesce(first_timeout_us >= {24 * HOUR}, true) AS conforms, CASE WHEN retries = 0 THEN 'normal' WHEN NOT answered THEN 'critical' WHEN retries >= 3 THEN 'high' WHEN retries >= 2 THEN 'medium' ELSE 'low' END AS severity FROM sx)"""


def _syn_delays(p: DataFrame) -> DataFrame:
    return tcp.syn_delays(both_ways(p), 24 * HOUR, 480 * HOUR)


def _conformance(p: DataFrame) -> DataFrame:
    """The rules of syn_conformance, with days for seconds and a wide tolerance."""
    return tcp.syn_conformance(both_ways(p), 480 * HOUR, 24 * HOUR, 24 * HOUR, 0.5)


over_packets("syn_delays", lambda p: _syn_delays(p).drop("intervals_us"), f", {_SD} SELECT * EXCLUDE (intervals_us) FROM sd")
over_packets("syn_conformance", lambda p: _conformance(p).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("intervals_us", "expected_us")}), f""", {_SD}
SELECT * REPLACE (array_to_string(intervals_us, ',') AS intervals_us, array_to_string(expected_us, ',') AS expected_us) FROM sc""")  # fmt: skip
over_packets("syn_conformance_summary", lambda p: tcp.syn_conformance_summary(_conformance(p)), f""", {_SD}, g AS (SELECT count(*) AS attempts, count(*) FILTER (conforms) AS conform, count(*) FILTER (doubles) AS double, sum(first_timeout_us) / count(first_timeout_us)::DOUBLE AS mean_timeout_us,
count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'normal') AS normal FROM sc)
SELECT *, conform / attempts::DOUBLE AS conform_share, double / attempts::DOUBLE AS double_share FROM g""")  # fmt: skip

# ---------------------------------------------------------------- security

_SCAN = """, s AS (SELECT src_ip, dst_ip, dst_port, count(*) AS n, min(ts_us) AS first, max(ts_us) AS last FROM e WHERE syn GROUP BY ALL),
b AS (SELECT dst_ip AS src_ip, src_ip AS dst_ip, src_port AS dst_port, max(ts_us) AS answer FROM e WHERE synack GROUP BY ALL),
g AS (SELECT src_ip, sum(n)::BIGINT AS attempts, count(*) FILTER (answer > first)::BIGINT AS answered, count(DISTINCT dst_ip) AS targets, count(DISTINCT dst_port) AS ports, min(first) AS start_us, max(last) - min(first) AS span FROM s LEFT JOIN b USING (src_ip, dst_ip, dst_port) GROUP BY src_ip HAVING sum(n) >= 3 AND max(last) > min(first)),
k AS (SELECT *, CASE WHEN ports >= 3 AND targets <= {few} THEN 'horizontal' WHEN targets >= 3 AND ports <= {few} THEN 'vertical' WHEN ports >= 3 AND targets >= 3 THEN 'distributed' END AS kind FROM g),
l AS (SELECT *, CASE kind WHEN 'distributed' THEN 2 WHEN 'horizontal' THEN CASE WHEN ports > 50 THEN 3 WHEN ports > 25 THEN 2 WHEN ports > 15 THEN 1 ELSE 0 END ELSE CASE WHEN targets > 50 THEN 3 WHEN targets > 20 THEN 2 WHEN targets > 10 THEN 1 ELSE 0 END END AS level FROM k WHERE kind IS NOT NULL),
m AS (SELECT *, CASE WHEN attempts - answered > 0.7 * attempts AND level < 2 THEN level + 1 ELSE level END AS l2 FROM l),
o AS (SELECT *, CASE WHEN attempts * 1e6 / span > {rate} THEN CASE WHEN l2 < 2 THEN 2 ELSE 3 END ELSE l2 END AS l3 FROM m)
SELECT src_ip, kind, attempts, answered, targets, ports, ['low', 'medium', 'high', 'critical'][l3 + 1] AS severity FROM o"""
over_packets("port_scan_events", lambda p: security.port_scans(p, ports=3, targets=3, few=5, min_attempts=3), _SCAN.format(few=5, rate="5.0"))
over_varied("port_scan_varied", lambda p: security.port_scans(p, ports=3, targets=3, few=2, min_attempts=3, rate=2e-5), _SCAN.format(few=2, rate="2e-5"))
_NOT_PRIVATE = f"NOT ({INTERNAL.format('src_ip')} AND {INTERNAL.format('dst_ip')})"
over_varied("port_scan_public", lambda p: security.port_scans(p, ports=3, targets=3, few=2, min_attempts=3, rate=2e-5, skip_private=True), _SCAN.format(few=2, rate="2e-5").replace("FROM e WHERE syn", f"FROM e WHERE {_NOT_PRIVATE} AND syn"))
_BRUTE = f"""t AS (SELECT *, sum(syn::INT) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, packet_num ROWS UNBOUNDED PRECEDING) AS attempt FROM e WHERE tcp AND {_NOT_PRIVATE} AND (syn OR (psh AND (flags & 16) <> 0))
  AND dst_port IN (21, 22, 23, 80, 443, 445, 1433, 3306, 3389, 5432, 5900, 6379, 8080, 8443, 27017)),
g AS (SELECT src_ip, dst_ip, dst_port, src_port, count(*) FILTER (syn) AS attempts, min(ts_us) FILTER (syn) AS a, max(ts_us) FILTER (syn) AS b, min(attempt) FILTER (NOT syn AND attempt > 0) AS first FROM t GROUP BY ALL),
h AS (SELECT src_ip, dst_ip, dst_port, sum(attempts)::BIGINT AS attempts, count(DISTINCT first) AS established, coalesce(min(a), 0) AS first_us, coalesce(max(b), 0) AS last_us FROM g GROUP BY src_ip, dst_ip, dst_port),
i AS (SELECT *, CASE WHEN attempts > 50 THEN 3 WHEN attempts > 30 THEN 2 WHEN attempts > 20 THEN 1 ELSE 0 END AS l FROM h WHERE attempts >= {{least}} AND attempts - established > {{fail}} * attempts AND established <= 0.9 * attempts),
j AS (SELECT *, CASE WHEN attempts - established > 0.9 * attempts THEN CASE WHEN l < 2 THEN 2 ELSE 3 END ELSE l END AS l2 FROM i),
k AS (SELECT *, CASE WHEN attempts * 1e6 > 2.0 * greatest(last_us - first_us, 1000) THEN CASE WHEN l2 < 2 THEN 2 ELSE 3 END ELSE l2 END AS l3 FROM j)
SELECT src_ip, dst_ip, dst_port, attempts, established, first_us, last_us, ['low', 'medium', 'high', 'critical'][CASE WHEN dst_port IN (22, 445, 3389) AND l3 < 2 THEN l3 + 1 ELSE l3 END + 1] AS severity FROM k"""
over_packets("brute_force", lambda p: security.brute_force(p, 2, 0.2), ", " + _BRUTE.format(least=2, fail=0.2))
over_varied("brute_force_varied", lambda p: security.brute_force(p, 1, 0.0), ", " + _BRUTE.format(least=1, fail="0.0"))
#: Rates of the events table are some packets an hour.
LEVELS = {k: (2e-4, 5e-4, 1e-3) for k in security.FLOOD_LEVELS}
_FL = f"""ft AS (SELECT *, CASE WHEN syn THEN 'syn' WHEN protocol = 'UDP' THEN 'udp' WHEN protocol = 'ICMP' THEN 'icmp' END AS k, ts_us // {HOUR} AS slot FROM e WHERE syn OR protocol IN ('UDP', 'ICMP')),
fw AS (SELECT dst_ip, slot, min(ts_us) AS start, sum(packet_length)::BIGINT AS bytes, count(*) FILTER (k = 'syn') AS syn, count(*) FILTER (k = 'udp') AS udp, count(*) FILTER (k = 'icmp') AS icmp FROM ft GROUP BY dst_ip, slot),
fk AS (SELECT 'udp_flood' AS attack, *, udp AS c FROM fw WHERE udp > 0 UNION ALL SELECT 'icmp_flood', *, icmp FROM fw WHERE icmp > 0),
fs AS (SELECT DISTINCT attack, dst_ip, NULL::INT AS dst_port, src_ip FROM fk JOIN (SELECT DISTINCT dst_ip, slot, src_ip FROM ft) USING (dst_ip, slot) UNION SELECT 'syn_flood', dst_ip, dst_port, src_ip FROM ft WHERE k = 'syn'),
fa AS (SELECT attack, dst_ip, NULL::INT AS dst_port, min(start) AS start_us, max(start) - min(start) + {HOUR} AS span_us, sum(c)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM fk GROUP BY attack, dst_ip
UNION ALL SELECT 'syn_flood', dst_ip, dst_port, start_us, span_us, packets, bytes FROM (SELECT dst_ip, dst_port, count(*) AS packets FROM ft WHERE k = 'syn' GROUP BY ALL) JOIN (SELECT dst_ip, min(start) AS start_us, max(start) - min(start) + {HOUR} AS span_us, sum(bytes)::BIGINT AS bytes FROM fw GROUP BY dst_ip) USING (dst_ip)
LEFT JOIN (SELECT src_ip AS dst_ip, src_port AS dst_port, count(*) AS answers FROM e WHERE synack GROUP BY ALL) USING (dst_ip, dst_port) WHERE coalesce(answers, 0) <= 0.9 * packets),
fb AS (SELECT fa.*, packets * 1e6 / span_us AS rate, n AS sources, top AS top_sources FROM fa JOIN (SELECT attack, dst_ip, dst_port, count(*) AS n, array_to_string(list_sort(list(src_ip))[1:10], ',') AS top FROM fs GROUP BY ALL) x ON x.attack = fa.attack AND x.dst_ip = fa.dst_ip AND x.dst_port IS NOT DISTINCT FROM fa.dst_port),
fl AS (SELECT *, CASE WHEN rate > 1e-3 THEN 3 WHEN rate > 5e-4 THEN 2 WHEN rate > 2e-4 THEN 1 ELSE 0 END AS l FROM fb WHERE rate >= 1e-4),
floods AS (SELECT * EXCLUDE (l), ['low', 'medium', 'high', 'critical'][1 + CASE WHEN packets > 10000 THEN 3 WHEN sources > 100 THEN CASE WHEN l < 2 THEN 2 ELSE 3 END WHEN sources > 50 AND l = 0 THEN 1 ELSE l END] AS severity FROM fl)"""


def _floods(p: DataFrame, least: float = 1e-4, *attacks: str) -> DataFrame:
    return security.floods(p, least, least, least, 0.9, HOUR, LEVELS, attacks or tuple(LEVELS))


_FV = _FL.replace("rate >= 1e-4", "rate >= 1e-6")


over_packets("ddos_syn_flood", lambda p: _floods(p, 1e-4, "syn_flood"), f", {_FL} SELECT * FROM floods WHERE attack = 'syn_flood'")
over_packets("ddos_udp_flood", lambda p: _floods(p, 1e-4, "udp_flood"), f", {_FL} SELECT * FROM floods WHERE attack = 'udp_flood'")
over_varied("ddos_floods_varied", lambda p: _floods(p, 1e-6), f", {_FV} SELECT * FROM floods")
over_varied("ddos_worst", lambda p: listings.by_severity(_floods(p, 1e-6), "start_us", "attack", "dst_ip", "dst_port"), f""", {_FV}
SELECT *, row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), start_us, attack, dst_ip, dst_port NULLS FIRST)::INT AS place FROM floods ORDER BY place LIMIT 20""")  # fmt: skip
_UP = f"u AS (SELECT * FROM p WHERE {INTERNAL.format('src_ip')} AND NOT {INTERNAL.format('dst_ip')})"
over_packets("exfil_large_upload", lambda p: security.large_uploads(p, 3000, 24 * HOUR), f""", {_UP}, w AS (SELECT *, sum(packet_length) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {24 * HOUR} FOLLOWING)::BIGINT AS s FROM u),
g AS (SELECT src_ip, arg_min(ts_us, (ts_us, packet_num)) AS start_us, arg_min(s, (ts_us, packet_num)) AS bytes FROM w WHERE s >= 3000 GROUP BY src_ip) SELECT *, CASE WHEN bytes >= 30000 THEN 'critical' WHEN bytes >= 12000 THEN 'high' WHEN bytes >= 6000 THEN 'medium' ELSE 'low' END AS severity FROM g""")  # fmt: skip
over_packets("exfil_ratio", lambda p: security.upload_ratios(both_ways(p), 1000, 1.0), f""", t AS (SELECT packet_length, CASE WHEN packet_num % 2 = 1 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN packet_num % 2 = 1 THEN src_ip ELSE dst_ip END AS dst_ip FROM p),
up AS (SELECT src_ip AS ip, sum(packet_length)::BIGINT AS up FROM t WHERE {INTERNAL.format('src_ip')} AND NOT {INTERNAL.format('dst_ip')} GROUP BY 1), dn AS (SELECT dst_ip AS ip, sum(packet_length)::BIGINT AS down FROM t WHERE {INTERNAL.format('dst_ip')} AND NOT {INTERNAL.format('src_ip')} GROUP BY 1),
g AS (SELECT ip, up, coalesce(down, 0) AS down, CASE WHEN coalesce(down, 0) > 0 THEN up / down::DOUBLE END AS ratio FROM up LEFT JOIN dn USING (ip))
SELECT ip, up, down, CASE WHEN ratio IS NULL THEN 'critical' WHEN ratio >= 20 THEN 'high' WHEN ratio >= 10 THEN 'medium' ELSE 'low' END AS severity FROM g WHERE up >= 1000 AND (ratio IS NULL OR ratio >= 1.0)""")  # fmt: skip
over_varied("exfil_ports", lambda p: security.upload_ports(p, 500), f", {_UP} SELECT src_ip, dst_port, sum(packet_length)::BIGINT AS bytes, count(*) AS packets FROM u WHERE dst_port IN (8080, 8443, 8888, 9000, 9001, 3128, 8123, 4444, 5555, 6666, 7777, 31337, 12345) GROUP BY ALL HAVING sum(packet_length) >= 500")
_LA = f"la AS (SELECT * FROM e WHERE tcp AND {INTERNAL.format('src_ip')} AND {INTERNAL.format('dst_ip')} AND src_ip <> dst_ip AND dst_port IN (22, 135, 139, 445, 593, 3389, 5985, 5986))"
_LT = f"{_LA}, l AS (SELECT * FROM la WHERE syn OR synack)"
_LS = """lt AS (SELECT src_ip, count(DISTINCT dst_ip) AS targets, count(DISTINCT dst_port) AS ports, count(*) FILTER (syn OR synack) AS syns, bool_or(dst_port IN (3389, 5985, 5986)) AS risky FROM la GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 2),
ls AS (SELECT src_ip, targets, ports, syns, CASE WHEN targets >= 10 THEN 'critical' WHEN targets >= 7 THEN 'high' WHEN targets >= 5 THEN 'medium' WHEN risky THEN 'high' ELSE 'medium' END AS severity FROM lt)"""
over_packets("lateral_multi_target", lambda p: security.lateral_targets(p, 2), f", {_LA}, {_LS} SELECT * FROM ls")
over_varied("lateral_multi_target_varied", lambda p: security.lateral_targets(p, 2), f", {_LA}, {_LS} SELECT * FROM ls")
over_varied("lateral_spread", lambda p: security.lateral_spread(p, 2, 3), f""", {_LT}, b AS (SELECT src_ip FROM l GROUP BY src_ip HAVING count(*) >= 3), g AS (SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS targets FROM l GROUP BY ALL HAVING count(DISTINCT dst_ip) >= 2)
SELECT src_ip, CASE dst_port WHEN 22 THEN 'SSH' WHEN 139 THEN 'NetBIOS/SMB' WHEN 445 THEN 'SMB/CIFS' WHEN 593 THEN 'RPC over HTTP' WHEN 3389 THEN 'RDP' WHEN 5986 THEN 'WinRM HTTPS' END AS service, targets,
CASE WHEN dst_port IN (3389, 5985, 5986) THEN CASE WHEN targets >= 5 THEN 'critical' ELSE 'high' END WHEN targets >= 10 THEN 'high' ELSE 'medium' END AS severity FROM g JOIN b USING (src_ip)""")  # fmt: skip
over_packets("lateral_rapid", lambda p: security.lateral_rapid(p, 2, 48 * HOUR, 12 * HOUR), f""", {_LT}, lk AS (WITH RECURSIVE c AS (SELECT src_ip, dst_ip, min(ts_us) AS ts_us FROM l GROUP BY ALL
UNION ALL SELECT src_ip, dst_ip, min(l.ts_us) FROM c JOIN l USING (src_ip, dst_ip) WHERE l.ts_us - c.ts_us > {12 * HOUR} GROUP BY ALL) SELECT * FROM c),
w AS (SELECT a.src_ip, a.ts_us, count(DISTINCT b.dst_ip) AS targets FROM lk a JOIN lk b ON a.src_ip = b.src_ip AND b.ts_us BETWEEN a.ts_us AND a.ts_us + {48 * HOUR} GROUP BY ALL)
SELECT src_ip, min(ts_us) AS start_us, arg_min(targets, ts_us) AS targets FROM w WHERE targets >= 2 GROUP BY src_ip""")  # fmt: skip
over_packets("event_breakdown_grouping_sets", lambda p: security.event_breakdown(security.all_events(("upload", security.large_uploads(p, 3000, 24 * HOUR), "src_ip"), ("lateral", security.lateral_targets(p, 2), "src_ip"))), f""", {_UP}, {_LA}, {_LS},
w AS (SELECT *, sum(packet_length) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {24 * HOUR} FOLLOWING) AS s FROM u), g AS (SELECT src_ip, arg_min(s, (ts_us, packet_num)) AS b FROM w WHERE s >= 3000 GROUP BY src_ip),
ev AS (SELECT 'upload' AS kind, CASE WHEN b >= 30000 THEN 'critical' WHEN b >= 12000 THEN 'high' WHEN b >= 6000 THEN 'medium' ELSE 'low' END AS severity FROM g UNION ALL
SELECT 'lateral', severity FROM ls)
SELECT kind, severity, grouping(kind, severity)::BIGINT AS level, count(*) AS events FROM ev GROUP BY GROUPING SETS ((kind, severity), (kind), (severity), ())""")  # fmt: skip


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS queries made of the pages table: one per page, names of its address's letters or encoded ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n, code = F.col("page_id"), F.md5(F.col("url").cast("binary"))
    part = lambda a, size: F.substring(code, a, size)
    letters = F.lower(F.regexp_replace("url", r"^https?://|[^A-Za-z0-9.]", ""))
    name = F.when(n % 5 == 0, code).when(n % 5 == 1, F.concat(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), part(1, 6)))
    name = name.when(n % 5 == 2, F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))).otherwise(letters)
    return pages.select(
        F.concat(F.lit("10.0.0."), (n % 10).cast("string")).alias("src_ip"), (n * 1_000_000).alias("ts_us"),
        F.concat(name, F.lit(".t"), (n % 7).cast("string"), F.lit(".example.")).alias("qname"), F.when(n % 4 == 0, "TXT").otherwise("A").alias("qtype"),
    )


over_tables("dns_repeated_queries", lambda s, d: names.repeated_queries(lookups(s, d).withColumn("qname", F.regexp_extract("qname", r"t[0-9]\.example\.$", 0)), 10_000_000), r"""WITH q AS (SELECT 't' || page_id % 7 || '.example.' AS qname, CASE WHEN page_id % 4 = 0 THEN 'TXT' ELSE 'A' END AS qtype, page_id * 1000000 AS us FROM pages),
r AS (SELECT *, us - lag(us) OVER (PARTITION BY qname, qtype ORDER BY us) < 10000000 AS again FROM q) SELECT qname, qtype, count(*) AS queries, count(*) FILTER (again) AS repeated FROM r GROUP BY ALL""")  # fmt: skip
over_tables("dns_tunneling", lambda s, d: names.dns_tunnels(lookups(s, d), 45, 3.9, 1.0), r"""
WITH m AS (SELECT page_id AS n, md5(url) AS c, lower(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9.]', '', 'g')) AS u FROM pages),
q AS (SELECT '10.0.0.' || n % 10 AS src_ip, n * 1000000 AS us, CASE n % 5 WHEN 0 THEN c WHEN 1 THEN 'abcdefghijklmnopqrstuvwxyz0123456789' || c[1:6] WHEN 2 THEN c[1:8] || '-' || c[9:12] || '-' || c[13:16] || '-' || c[17:20] || '-' || c[21:32] ELSE u END AS sub,
  't' || n % 7 || '.example' AS domain, n % 4 = 0 AS txt, n FROM m),
ch AS (SELECT n, count(*) AS k FROM (SELECT n, unnest(string_split(sub, '')) AS x FROM q) GROUP BY n, x),
b AS (SELECT q.*, length(sub) + length(domain) + 2 AS chars, coalesce(e.bits, 0) AS bits, coalesce(e.kinds, 0) AS kinds FROM q LEFT JOIN (SELECT n, round(sum(-(k / t) * log2(k / t)), 6) AS bits, count(*) AS kinds FROM (SELECT n, k::DOUBLE AS k, (sum(k) OVER (PARTITION BY n))::DOUBLE AS t FROM ch) GROUP BY n) e USING (n)),
g AS (SELECT src_ip, domain, count(*) AS queries, sum(chars) / count(*)::DOUBLE AS len, coalesce(sum(bits::DECIMAL(18,6)) FILTER (bits > 0)::DOUBLE / count(*) FILTER (bits > 0), 0) AS bits, CASE WHEN max(us) - min(us) >= 1000000 THEN count(*) * 6e7 / (max(us) - min(us)) ELSE 0 END AS rate, count(*) FILTER (txt) AS txt,
  bool_or(length(sub) > 255)::INT + bool_or(length(sub) >= 32 AND regexp_matches(sub, '^[A-Za-z0-9+/=]+$') AND bits > 5)::INT + bool_or(length(sub) >= 32 AND regexp_matches(sub, '^[0-9a-fA-F]+$'))::INT
  + bool_or(regexp_matches(sub, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'))::INT + bool_or(length(sub) >= 40 AND regexp_matches(sub, '^[a-z0-9]+$') AND kinds > 0.6 * length(sub))::INT AS kinds FROM b GROUP BY src_ip, domain),
h AS (SELECT *, (len > 45)::INT + (bits > 3.9)::INT + (rate > 1)::INT + (kinds > 0)::INT + (txt > 0.3 * queries)::INT AS signs,
  (CASE WHEN len > 100 THEN 3 WHEN len > 75 THEN 2 WHEN len > 50 THEN 1 ELSE 0 END + CASE WHEN bits > 5 THEN 3 WHEN bits > 4.5 THEN 2 WHEN bits > 3.5 THEN 1 ELSE 0 END + CASE WHEN rate > 50 THEN 3 WHEN rate > 30 THEN 2 WHEN rate > 10 THEN 1 ELSE 0 END
  + CASE WHEN queries > 100 THEN 2 WHEN queries > 50 THEN 1 ELSE 0 END + least(kinds, 2))::INT AS score FROM g)
SELECT src_ip, domain, queries, signs, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS severity FROM h WHERE signs >= 2""")  # fmt: skip


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS messages made of the purchase events: every third one has no answer."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    common = [F.lit("10.0.0.1").alias("client"), F.lit("8.8.8.8").alias("server"), F.concat(F.lit("h"), (F.col("event_id") % 20).cast("string"), F.lit(".example")).alias("qname")]
    ids = [(F.col("event_id") % 65536).cast("int").alias("id"), (F.col("user_id") + 40000).cast("int").alias("client_port")]
    q = e.select(us.alias("ts_us"), (F.col("event_id") * 2).alias("packet_num"), *common, *ids, F.lit(0).alias("qr"), F.lit(0).alias("rcode"))
    r = e.where(F.col("event_id") % 3 != 0).select(
        (us + F.col("event_id") % 1500 * 1000).alias("ts_us"), (F.col("event_id") * 2 + 1).alias("packet_num"), *common, *ids, F.lit(1).alias("qr"), F.when(F.col("event_id") % 7 == 0, 3).otherwise(0).alias("rcode")
    )
    return q.unionByName(r)


_DNS = """WITH q AS (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), m AS (SELECT max(greatest(us, CASE WHEN event_id % 3 <> 0 THEN us + event_id % 1500 * 1000 END)) AS e FROM q),
tx AS (SELECT '10.0.0.1' AS client, '8.8.8.8' AS server, (event_id % 65536)::INT AS id, 'h' || event_id % 20 || '.example' AS qname, CASE WHEN event_id % 3 <> 0 THEN event_id % 1500 * 1000 END AS took_us, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END END::INT AS rcode,
CASE WHEN event_id % 3 = 0 THEN CASE WHEN e - us >= 5000000 THEN 'timeout' ELSE 'open' END WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 1500 * 1000 > 1000000 THEN 'slow' ELSE 'success' END AS status FROM q, m)"""
over_tables("dns_transactions", lambda s, d: folds.dns_transactions(transactions(s, d)), _DNS + " SELECT * FROM tx")


def named_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("rcode") == 3, "NXDOMAIN").when(F.col("rcode") == 0, "NOERROR").alias("rcode")
    return folds.dns_transactions(transactions(spark, sf_dir)).where("status <> 'open'").select("qname", "status", name)


over_tables("dns_problem_domains", lambda s, d: names.dns_problems(named_lookups(s, d)), _DNS + """, l AS (SELECT qname, CASE status WHEN 'timeout' THEN 'Timeout' WHEN 'slow' THEN 'Slow Response' ELSE 'NXDOMAIN' END AS problem, count(*) AS c FROM tx WHERE status IN ('timeout', 'slow', 'error') GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY c DESC, problem) AS r, sum(c) OVER (PARTITION BY qname)::BIGINT AS total FROM l) SELECT qname, total AS count, problem FROM o WHERE r = 1 ORDER BY total DESC, qname LIMIT 10""")  # fmt: skip

# ---------------------------------------------------------------- ICMP, fragments, selective acknowledgements

_I = """i AS (SELECT coalesce(orig_dst, 'Unknown (from ' || src_ip || ')') AS target, mtu, icmp_type AS t, icmp_code AS c,
CASE icmp_type WHEN 0 THEN 'Echo Reply' WHEN 3 THEN 'Destination Unreachable' WHEN 5 THEN 'Redirect' WHEN 8 THEN 'Echo Request' WHEN 11 THEN 'Time Exceeded' WHEN 12 THEN 'Parameter Problem' ELSE 'Type ' || icmp_type END AS kind,
CASE icmp_code WHEN 0 THEN 'Network Unreachable' WHEN 1 THEN 'Host Unreachable' WHEN 2 THEN 'Protocol Unreachable' WHEN 3 THEN 'Port Unreachable' WHEN 4 THEN 'Fragmentation Needed and DF Set' WHEN 5 THEN 'Source Route Failed' WHEN 6 THEN 'Network Unknown'
WHEN 7 THEN 'Host Unknown' WHEN 13 THEN 'Communication Administratively Prohibited' ELSE 'Code ' || icmp_code END AS why FROM p WHERE protocol = 'ICMP')"""
over_varied("icmp_summary", names.icmp_summary, f""", {_I} SELECT CASE WHEN t = 3 THEN kind || ' - ' || why ELSE kind END AS name, CASE WHEN t = 3 AND c IN (0, 1, 4, 6, 7, 13) THEN 'error' WHEN t IN (3, 4, 11, 12) THEN 'warning' ELSE 'info' END AS severity, count(*) AS packets FROM i GROUP BY ALL""")
over_varied("icmp_unreachable_targets", names.unreachable_targets, f""", {_I}, k AS (SELECT target, kind || ' - ' || why AS name, count(*) AS c FROM i WHERE t = 3 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY c DESC, name) AS r, sum(c) OVER (PARTITION BY target)::BIGINT AS m FROM k)
SELECT target, m AS messages, name AS reason FROM o WHERE r = 1 ORDER BY m DESC, target LIMIT 10""")  # fmt: skip
over_varied("icmp_path_mtu", names.path_mtu_issues, f", {_I} SELECT target, count(*) AS messages, coalesce(max(mtu) FILTER (mtu > 0), 1500)::INT AS suggested_mtu FROM i WHERE t = 3 AND c = 4 GROUP BY target")


def fragments(p: DataFrame) -> DataFrame:
    """The packet view as fragments: four numbers in a row are one datagram. Some are lost, some come twice, some overlap the one before, and some datagrams have two ends."""
    n = F.col("packet_num")
    i = n % 4
    frag = F.struct(
        (F.floor(n / 4) % 500).cast("int").alias("ip_id"), F.lit(False).alias("df"), ((i < 3) & (n % 37 != 2)).alias("mf"), (i * 1480 - F.when((n % 29 == 0) & (i > 0), 8).otherwise(0)).cast("int").alias("offset_bytes"),
        F.when(i < 3, 1480).otherwise(n % 100 + 1).cast("int").alias("payload_bytes"), F.lit(17).alias("proto"),
    )
    twice = F.explode(F.sequence(F.lit(0), F.when(n % 31 == 0, 1).otherwise(0))).alias("copy")
    f = p.where(n % 13 != 0).select(F.concat(F.lit("10.1."), F.floor(n / 2000).cast("string")).alias("src_ip"), F.lit("10.2.0.1").alias("dst_ip"), "ts_us", "packet_num", frag.alias("frag"), twice)
    return f.withColumn("packet_num", F.col("packet_num") * 2 + F.col("copy")).drop("copy")


over_packets("fragment_reassembly", lambda p: names.reassembly(fragments(p)), """, g0 AS (SELECT '10.1.' || packet_num // 2000 AS src_ip, '10.2.0.1' AS dst_ip, ts_us, packet_num * 2 + c AS k, (packet_num // 4 % 500)::INT AS ip_id, packet_num % 4 < 3 AND packet_num % 37 <> 2 AS mf,
packet_num % 4 * 1480 - CASE WHEN packet_num % 29 = 0 AND packet_num % 4 > 0 THEN 8 ELSE 0 END AS a, CASE WHEN packet_num % 4 < 3 THEN 1480 ELSE packet_num % 100 + 1 END AS size FROM (SELECT *, unnest(CASE WHEN packet_num % 31 = 0 THEN [0, 1] ELSE [0] END) AS c FROM p WHERE packet_num % 13 <> 0)),
g1 AS (SELECT *, lag(a + size, 1, 0) OVER w AS expected, row_number() OVER w AS r FROM g0 WHERE mf OR a > 0 WINDOW w AS (PARTITION BY src_ip, dst_ip, ip_id ORDER BY a, ts_us, k)),
g2 AS (SELECT src_ip, dst_ip, ip_id, count(*) AS fragments, (arg_max(a + size, (ts_us, k)) FILTER (NOT mf))::INT AS total, bool_and(a = expected) AS follows, arg_max(a + size, r) AS reached, max(size) AS largest FROM g1 GROUP BY src_ip, dst_ip, ip_id)
SELECT src_ip, dst_ip, ip_id, fragments, total, coalesce(follows AND reached = total, false) AS complete, (largest + 20)::INT AS path_mtu FROM g2""")  # fmt: skip


_FR = ORACLES["fragment_reassembly"].removeprefix(PACKETS).rsplit("\nSELECT", 1)
_FR = f"{_FR[0]}, fr AS (SELECT{_FR[1]})"
over_packets("fragments_incomplete", lambda p: names.incomplete_datagrams(names.reassembly(fragments(p))), f"{_FR} SELECT * FROM fr WHERE NOT complete ORDER BY src_ip, dst_ip, ip_id LIMIT 20")
over_packets("fragment_flows", lambda p: names.fragment_flows(fragments(p), names.reassembly(fragments(p))), f"""{_FR}, fa AS (SELECT src_ip, dst_ip, count(*) AS packets, count(*) FILTER (mf OR a > 0) AS fragments, min(size) FILTER (mf OR a > 0)::INT AS least, max(size) FILTER (mf OR a > 0)::INT AS most FROM g0 GROUP BY ALL),
fi AS (SELECT src_ip, dst_ip, count(*) FILTER (NOT complete) AS incomplete FROM fr GROUP BY ALL) SELECT src_ip, dst_ip, packets, fragments, fragments / packets::DOUBLE * 100.0 AS share, least, most, (least + most) / 2.0::DOUBLE AS middle, incomplete FROM fa JOIN fi USING (src_ip, dst_ip) WHERE fragments > 0 ORDER BY fragments DESC, src_ip, dst_ip LIMIT 10""")  # fmt: skip


def acked_blocks(p: DataFrame) -> DataFrame:
    """TCP packets of the view with up to two SACK blocks around their acknowledgement."""
    n, a = F.col("packet_num"), F.col("tcp_ack")
    block = lambda x, y: F.struct(x.cast("bigint").alias("left"), y.cast("bigint").alias("right"))
    one = block(a + n % 5 * 100 - 200, a + n % 5 * 100 - 100)
    blocks = F.when(n % 3 == 0, F.array(one)).when(n % 3 == 1, F.array(one, block(a + 100, a + 100 + n % 4 * 100))).otherwise(F.array().cast("array<struct<left:bigint,right:bigint>>"))
    return p.where("protocol = 'TCP'").withColumn("sack", blocks)


over_packets("sack_flows", lambda p: names.sack_flows(acked_blocks(p)), f""", b AS (SELECT {FLOW}, packet_num % 5 * 100 - 100 AS r, packet_num % 3 = 1 AND packet_num % 4 > 0 AS two, packet_num % 4 * 100 AS w FROM e WHERE tcp AND packet_num % 3 <> 2)
SELECT {FLOW}, count(*) AS packets, sum(1 + two::INT)::BIGINT AS blocks, count(*) FILTER (r <= 0 OR (two AND r - 100 >= 100 AND r <= 100 + w)) AS dsacks FROM b GROUP BY {FLOW}""")  # fmt: skip

_SK = f"""sk AS (SELECT {ENDS}, ts_us, ack + packet_num % 5 * 100 - 200 AS a, packet_num % 5 * 100 - 100 AS r, packet_num % 3 = 1 AND packet_num % 4 > 0 AS two, packet_num % 4 * 100 AS w, ack FROM e WHERE tcp AND packet_num % 3 <> 2),
sb AS (SELECT {ENDS}, a AS x, a + 100 AS y FROM sk UNION SELECT {ENDS}, ack + 100, ack + 100 + w FROM sk WHERE two),
sv AS (SELECT {ENDS}, count(*) AS sacks, count(*) FILTER (r <= 0 OR (two AND r - 100 >= 100 AND r <= 100 + w)) AS dsacks, sum(100 + CASE WHEN two THEN w ELSE 0 END)::BIGINT AS sacked_bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM sk GROUP BY {ENDS}),
sc AS (SELECT * FROM sv JOIN (SELECT {ENDS}, count(*) AS distinct_blocks FROM sb GROUP BY {ENDS}) USING ({ENDS}))"""
over_packets("sack_conversations", lambda p: names.sack_conversations(acked_blocks(p)), f", {_SK} SELECT *, dsacks / sacks::DOUBLE * 100.0 AS dsack_share FROM sc")
over_packets("sack_summary", lambda p: names.sack_summary(p, names.sack_conversations(acked_blocks(p))), f""", {_SK}, g AS (SELECT sum(sacks)::BIGINT AS sacks, sum(dsacks)::BIGINT AS dsacks, count(*) AS conversations, count(*) FILTER (dsacks > 0) AS with_dsacks, sum(sacked_bytes)::BIGINT AS sacked_bytes, (SELECT count(*) FROM e WHERE tcp) AS tcp_packets FROM sc)
SELECT *, sacks / tcp_packets::DOUBLE * 100.0 AS sack_share, dsacks / sacks::DOUBLE * 100.0 AS dsack_share, sacked_bytes / sacks::DOUBLE AS bytes_per_sack FROM g""")  # fmt: skip

# ---------------------------------------------------------------- scores, reports, text

over_packets("health_score", lambda p: score.health_score(score.metrics_of(p, _trips(p), tcp.exact_retransmissions(p))).select("retransmission", "anomaly", "class"), f""", {_X},
g AS (SELECT (SELECT count(*) FROM x) / count(*)::DOUBLE AS retransmission, count(*) FILTER (win = 0) * 1000 / count(*)::DOUBLE AS anomaly FROM p),
y AS (SELECT *, CASE WHEN retransmission <= 0.01 THEN retransmission * 1600 WHEN retransmission <= 0.03 THEN 16 + (retransmission - 0.01) * 900 WHEN retransmission <= 0.05 THEN 34 + (retransmission - 0.03) * 1300 WHEN retransmission <= 0.1 THEN 60 + (retransmission - 0.05) * 640 ELSE 100 END AS a,
CASE WHEN anomaly <= 10 THEN anomaly WHEN anomaly <= 50 THEN 10 + (anomaly - 10) * 0.45 WHEN anomaly <= 150 THEN 25 + (anomaly - 50) * 0.3 WHEN anomaly <= 500 THEN 50 + (anomaly - 150) * 0.1 ELSE 100 END AS b FROM g),
z AS (SELECT *, 100 - (round(a * 0.25, 2) + round(b * 0.1, 2) + 20) AS s FROM y) SELECT retransmission, anomaly, CASE WHEN s >= 95 THEN 0 WHEN s >= 85 THEN 1 WHEN s >= 65 THEN 2 WHEN s >= 45 THEN 3 WHEN s >= 25 THEN 4 ELSE 5 END::INT AS class FROM z""")  # fmt: skip


def health_score_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six metrics, the score and its class; health_score is the part that its SQL covers."""
    p = packets(spark, sf_dir)
    rtt, again = _trips(p), tcp.exact_retransmissions(p)
    m = score.all_metrics_of(p, rtt, again, folds.dns_transactions(transactions(spark, sf_dir)), timing.jitter(p, **CUTS))
    return score.health_score(m).select(*score.METRICS, "score", "class")


def _penalty(name: str) -> str:
    """A metric's penalty in SQL, from the same fixed lines."""
    weight, lines, beyond = score.METRICS[name]
    cases = " ".join(f"WHEN v <= {float(x1)!r} THEN {float(y0)!r} + (v - {float(x0)!r}) * {(y1 - y0) / (x1 - x0)!r}" for x0, y0, x1, y1 in lines)
    past = "least(95.0, 80 + 50 * (v - 0.30))" if beyond is None else repr(float(beyond))
    return f"round(CASE {cases.replace('v', f'coalesce({name}, 0.0)')} ELSE {past.replace('v', f'coalesce({name}, 0.0)')} END * {weight / 100.0!r}, 2)"


over_tables("health_score_full", health_score_full, PACKETS + f""", {_R}, {_X}, {_J}, {_DNS.removeprefix('WITH ')}, hm AS (SELECT (SELECT count(*) FROM x) / count(*)::DOUBLE AS retransmission, (SELECT quantile_cont(rtt_us, 0.5)::DOUBLE / 1e6 FROM rtt) AS rtt,
(SELECT count(*) FROM (SELECT DISTINCT {FLOW}, tcp_seq FROM x)) / count(*)::DOUBLE AS loss, (SELECT count(*) FILTER (status IN ('timeout', 'error')) / count(*)::DOUBLE FROM tx) AS dns, (SELECT sum(jitter_us) / count(*)::DOUBLE / 1e6 FROM j) AS jitter,
count(*) FILTER (win = 0) * 1000 / count(*)::DOUBLE AS anomaly FROM p), hs AS (SELECT *, greatest(0.0, least(100.0, 100.0 - ({' + '.join(map(_penalty, score.METRICS))}))) AS s FROM hm)
SELECT * EXCLUDE (s), round(s, 1) AS score, CASE WHEN s >= 95 THEN 0 WHEN s >= 85 THEN 1 WHEN s >= 65 THEN 2 WHEN s >= 45 THEN 3 WHEN s >= 25 THEN 4 ELSE 5 END::INT AS class FROM hs""")  # fmt: skip
over_packets("capture_sanity", report.capture_sanity, """, h AS (SELECT * FROM p ORDER BY packet_num LIMIT 100), g AS (SELECT count(*) AS packets, (SELECT count(*) FROM (SELECT DISTINCT ts_us, src_ip, dst_ip, packet_length FROM h)) AS distinct_packets, count(*) FILTER (src_ip = dst_ip) AS self_loops, (SELECT max(abs(d)) FROM (SELECT ts_us - lag(ts_us) OVER (ORDER BY packet_num) AS d FROM h)) AS jump_us FROM h)
SELECT *, CASE WHEN packets < 2 THEN 'too few packets' WHEN jump_us > 31536000000000 THEN 'time jump' WHEN (packets - distinct_packets) * 2 > packets THEN 'duplicates' WHEN self_loops * 10 > packets THEN 'self loops' ELSE 'valid' END AS verdict FROM g""")  # fmt: skip
over_packets("summary_unpivot", report.summary, """, g AS (SELECT count(*)::VARCHAR AS packets, sum(packet_length)::VARCHAR AS bytes, count(DISTINCT src_ip)::VARCHAR AS sources, count(DISTINCT dst_ip)::VARCHAR AS destinations, (max(ts_us) - min(ts_us))::VARCHAR AS span_us FROM p)
SELECT 'packets' AS metric, packets AS value FROM g UNION ALL SELECT 'bytes', bytes FROM g UNION ALL SELECT 'sources', sources FROM g UNION ALL SELECT 'destinations', destinations FROM g UNION ALL SELECT 'span_us', span_us FROM g""")  # fmt: skip
over_tables("pii_redaction", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(redact(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("redacted_sha256")), r"""SELECT doc_id, sha256(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\b([0-9]{1,3}\.[0-9]{1,3})\.[0-9]{1,3}\.[0-9]{1,3}\b', '\1.XXX.XXX', 'g'),
'\b([0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2})[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}\b', '\1:XX:XX:XX', 'g'), '/(home|Users)/[A-Za-z0-9._-]+', '/\1/[REDACTED]', 'g'),
'([Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)([ ]*[:=][ ]*)[^ \t\n]+', '\1\2[REDACTED]', 'g'), '[Bb]earer [A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '[Bb]asic [A-Za-z0-9+/]+=*', 'Basic [REDACTED]', 'g'),
'(postgres(ql)?|mysql|mongodb)://[^:/ \t\n]+:[^@ \t\n]+@', '\1://[REDACTED]@', 'g')) AS redacted_sha256 FROM documents""")  # fmt: skip
over_tables("user_entropy", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.round(entropy(F.col("c_name")), 6).alias("bits")), """
WITH c AS (SELECT c_custkey, length(c_name)::DOUBLE AS n, unnest(string_split(lower(c_name), '')) AS ch FROM customer), k AS (SELECT c_custkey, ch, count(*) / any_value(n) AS f FROM c GROUP BY c_custkey, ch)
SELECT c_custkey, round(sum(-f * log2(f)), 6) AS bits FROM k GROUP BY c_custkey""")  # fmt: skip

# ---------------------------------------------------------------- listings, root causes, CSV tables

_RANK = "list_position(['critical', 'high', 'medium', 'low'], severity)"
over_varied("port_scan_worst", lambda p: listings.by_severity(security.scan_events(p, ports=3, targets=3, few=2, min_attempts=3, rate=2e-5), "start_us", "src_ip"), _SCAN.format(few=2, rate="2e-5").replace(
    "SELECT src_ip, kind, attempts", ", v AS (SELECT src_ip, kind, attempts").replace(" AS severity FROM o", " AS severity, start_us, span AS span_us FROM o)") + f" SELECT *, row_number() OVER (ORDER BY {_RANK}, start_us, src_ip)::INT AS place FROM v ORDER BY place LIMIT 20")
over_varied("brute_force_worst", lambda p: listings.by_severity(security.brute_force(p, 1, 0.0), "first_us", "src_ip", "dst_ip", "dst_port"), ", " + _BRUTE.format(least=1, fail="0.0").replace(
    "SELECT src_ip, dst_ip, dst_port, attempts, established", ", v AS (SELECT src_ip, dst_ip, dst_port, attempts, established").replace(" AS severity FROM k", " AS severity FROM k)") + f" SELECT *, row_number() OVER (ORDER BY {_RANK}, first_us, src_ip, dst_ip, dst_port)::INT AS place FROM v ORDER BY place LIMIT 20")
over_packets("retrans_slowest", listings.slowest_retransmissions, f", {_X} SELECT *, row_number() OVER (ORDER BY delay_us DESC, packet_num)::INT AS place FROM x ORDER BY place LIMIT 20")
over_packets("rtt_worst_flows", lambda p: listings.worst_round_trips(_trip_stats(p)), f", {_R}, {_RF} SELECT *, row_number() OVER (ORDER BY max_us DESC, {FLOW})::INT AS place FROM rf ORDER BY place LIMIT 10")
over_packets("rtt_global", lambda p: listings.round_trip_summary(_trips(p), 24 * HOUR, 72 * HOUR), f""", {_R}, g AS (SELECT count(*) AS n, min(rtt_us) AS min_us, max(rtt_us) AS max_us, sum(rtt_us)::DOUBLE AS s, sum(rtt_us::HUGEINT * rtt_us)::DOUBLE AS q,
count(*) FILTER (rtt_us > {24 * HOUR}) AS high, count(*) FILTER (rtt_us > {72 * HOUR}) AS critical FROM rtt) SELECT n, min_us, max_us, s / n::DOUBLE AS mean_us, sqrt(greatest((q * n::DOUBLE - s * s) / (n::DOUBLE * (n::DOUBLE - 1)), 0.0)) AS stdev_us, high, critical FROM g""")  # fmt: skip
over_packets("rtt_of_a_flow", lambda p: listings.flow_details(_trips(p), dst_ip="93.184.216.34", dst_port=443), f", {_R} SELECT * FROM rtt WHERE dst_ip = '93.184.216.34' AND dst_port = 443")
over_packets("syn_delays_slowest", lambda p: listings.slowest_attempts(_syn_delays(p).drop("intervals_us")), f", {_SD} SELECT * EXCLUDE (intervals_us), row_number() OVER (ORDER BY delay_us DESC, {FLOW}, first_us)::INT AS place FROM sd ORDER BY place LIMIT 10")
_BF = _BRUTE.format(least=1, fail="0.0").rsplit("\nSELECT", 1)[0] + f", bf AS (SELECT{_BRUTE.format(least=1, fail='0.0').rsplit(chr(10) + 'SELECT', 1)[1]})"
over_varied("brute_force_attackers", lambda p: security.top_attackers(security.brute_force(p, 1, 0.0)), f""", {_BF}, bw AS (SELECT *, list_position(['low', 'medium', 'high', 'critical'], severity) AS level FROM bf ORDER BY level DESC, first_us, src_ip, dst_ip, dst_port LIMIT 10)
SELECT src_ip, count(*) AS attacks, count(DISTINCT dst_ip) AS targets, array_to_string(list_sort(list_distinct(list(CASE dst_port WHEN 22 THEN 'SSH' WHEN 443 THEN 'HTTPS' WHEN 445 THEN 'SMB' WHEN 1433 THEN 'MSSQL' WHEN 3389 THEN 'RDP' WHEN 8080 THEN 'HTTP-Alt' END))), ',') AS services,
sum(attempts)::BIGINT AS attempts, ['low', 'medium', 'high', 'critical'][max(level)] AS severity FROM bw GROUP BY src_ip""")  # fmt: skip
over_packets("bursts_in_order", lambda p: listings.earliest_bursts(timing.bursts(p, BURST)), f", {_B} SELECT *, row_number() OVER (ORDER BY start_us, burst_id)::INT AS place FROM bursts ORDER BY place LIMIT 50")
over_packets("tcp_reset_details", listings.earliest_resets, ORACLES["tcp_reset_classified"].removeprefix(PACKETS).rsplit("\nSELECT", 1)[0] + f" SELECT packet_num, {FLOW}, syn_seen, data_seen, NOT data_seen AS premature, ts_us, row_number() OVER (ORDER BY ts_us, packet_num)::INT AS place FROM r WHERE rst ORDER BY place LIMIT 20")
over_packets("periodic_strongest", lambda p: listings.strongest_patterns(timing.periodic(p, HOUR, 200 * HOUR, 12 * HOUR, 20, 5, 0.2)), ORACLES["periodic_patterns"].removeprefix(PACKETS).rsplit("\nSELECT", 1)[0] + """, k AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY count DESC, interval) AS rank FROM h WHERE count >= 5 AND count >= 0.2 * total)
SELECT src_ip, interval, count, round(count / total::DOUBLE * 100.0, 1) AS confidence, row_number() OVER (ORDER BY count DESC, src_ip, interval)::INT AS place FROM k WHERE rank <= 3 ORDER BY place LIMIT 15""")  # fmt: skip
over_varied("ddos_targets", lambda p: listings.flood_targets(_floods(p, 1e-6)), f", {_FV} SELECT dst_ip, count(*) AS floods, row_number() OVER (ORDER BY count(*) DESC, dst_ip)::INT AS place FROM floods GROUP BY dst_ip ORDER BY place LIMIT 10")
_DT = ORACLES["dns_tunneling"].rstrip().rstrip(";").rsplit("\nSELECT", 1)
_DT = f"{_DT[0]}, dt AS (SELECT{_DT[1]})"
over_tables("dns_tunneling_worst", lambda s, d: listings.by_severity(names.dns_tunnels(lookups(s, d), 45, 3.9, 1.0), F.desc("queries"), "src_ip", "domain"), _DT + " SELECT *, row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), queries DESC, src_ip, domain)::INT AS place FROM dt ORDER BY place LIMIT 20")
over_tables("dns_tunneling_domains", lambda s, d: listings.tunnel_domains(names.dns_tunnels(lookups(s, d), 45, 3.9, 1.0)), _DT + " SELECT domain, count(*) AS sources, sum(queries)::BIGINT AS queries, row_number() OVER (ORDER BY count(*) DESC, domain)::INT AS place FROM dt GROUP BY domain ORDER BY place LIMIT 10")
_SW = _SCAN.format(few=2, rate="2e-5").replace("SELECT src_ip, kind, attempts", ", v AS (SELECT src_ip, kind, attempts").replace(" AS severity FROM o", " AS severity, start_us, span AS span_us FROM o)")
over_varied("port_scan_scanners", lambda p: listings.top_scanners(security.scan_events(p, ports=3, targets=3, few=2, min_attempts=3, rate=2e-5)), f"""{_SW}, w AS (SELECT *, {_RANK} AS rk FROM v ORDER BY rk, start_us, src_ip LIMIT 10)
SELECT src_ip, count(*) AS scans, max(targets) AS targets, max(ports) AS ports, sum(attempts)::BIGINT AS attempts, ['critical', 'high', 'medium', 'low'][min(rk)] AS severity, row_number() OVER (ORDER BY min(rk), count(*) DESC, src_ip)::INT AS place FROM w GROUP BY src_ip""")  # fmt: skip
over_packets("retrans_confidence", lambda p: listings.confidence_overview(folds.retransmissions(_segments(p))))
over_packets("sack_top_flows", lambda p: listings.top_sacks(names.sack_conversations(acked_blocks(p))), f", {_SK} SELECT *, dsacks / sacks::DOUBLE * 100.0 AS dsack_share, row_number() OVER (ORDER BY sacks DESC, {ENDS})::INT AS place FROM sc ORDER BY place LIMIT 20")
over_packets("dsack_top_flows", lambda p: listings.top_dsacks(names.sack_conversations(acked_blocks(p))), f", {_SK} SELECT {ENDS}, dsacks, sacks, dsacks / sacks::DOUBLE * 100.0 AS dsack_share, row_number() OVER (ORDER BY dsacks DESC, {ENDS})::INT AS place FROM sc WHERE dsacks > 0 ORDER BY place LIMIT 10")
over_packets("security_events_ranked", lambda p: listings.ranked_events(security.all_events(("upload", security.large_uploads(p, 3000, 24 * HOUR), "src_ip"), ("lateral", security.lateral_targets(p, 2), "src_ip"))), ORACLES["event_breakdown_grouping_sets"].removeprefix(PACKETS).replace("SELECT 'upload' AS kind,", "SELECT src_ip, 'upload' AS kind,")
    .replace("SELECT 'lateral', severity FROM ls", "SELECT src_ip, 'lateral', severity FROM ls").rsplit("\nSELECT kind", 1)[0] + " SELECT kind, src_ip, severity, list_position(['critical', 'high', 'medium', 'low'], severity)::INT AS rank FROM ev")
over_packets("burst_worst", lambda p: listings.worst_burst(timing.bursts(p, BURST)), f", {_B} SELECT * FROM bursts ORDER BY peak_ratio DESC, start_us LIMIT 1")
over_packets("connections_longest_idle", lambda p: listings.longest_idle(tcp.connection_states(p, 24 * HOUR, 96 * HOUR)), ORACLES["tcp_connection_states"].removeprefix(PACKETS).replace(f"SELECT {ENDS}, packets, idle_us, CASE", f", st AS (SELECT {ENDS}, packets, idle_us, CASE")
    + f") SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY idle_us DESC, {ENDS})::INT AS place FROM st) WHERE place <= 10")
_JF = f"""jf AS (SELECT {_FIVE}, count(*) AS n, sum(jitter_us)::BIGINT AS total_us, min(jitter_us) AS min_us, max(jitter_us) AS max_us, sum(jitter_us) / count(*)::DOUBLE AS mean_us,
list_sort(list(jitter_us))[1 + least(floor(count(*) * 0.95)::BIGINT, count(*) - 1)] AS p95_us, list_sort(list(jitter_us))[1 + least(floor(count(*) * 0.99)::BIGINT, count(*) - 1)] AS p99_us FROM j WHERE delay < {24 * HOUR} GROUP BY {_FIVE})"""
over_packets("jitter_filtered_stats", lambda p: timing.jitter_filtered_stats(p, 24 * HOUR, **CUTS), f", {_J}, {_JF} SELECT * FROM jf")
over_packets("jitter_offenders", lambda p: listings.jitter_offenders(timing.jitter_filtered_stats(p, 24 * HOUR, **CUTS)), f""", {_J}, {_JF}, o AS (SELECT {_FIVE}, n, mean_us, p95_us, max_us, CASE WHEN protocol = 'UDP' THEN CASE WHEN p95_us < 20000 THEN 'excellent' WHEN p95_us < 30000 THEN 'low' WHEN p95_us < 50000 THEN 'medium' ELSE 'critical' END
WHEN p95_us < 100000 THEN 'low' WHEN p95_us < 200000 THEN 'medium' ELSE 'critical' END AS severity FROM jf WHERE p95_us > 30000 OR mean_us > 30000) SELECT *, row_number() OVER (ORDER BY p95_us DESC, {_FIVE})::INT AS place FROM o ORDER BY place LIMIT 10""")  # fmt: skip
over_packets("retransmission_context", lambda p: listings.retransmission_context(both_ways(p)), f""", {_R.split("sg AS (")[0]} c0 AS (SELECT *, payload > 0 OR (flags & 3) <> 0 AS sends, row_number() OVER (PARTITION BY {FLOW} ORDER BY ts_us, packet_num) AS i FROM t),
c1 AS (SELECT *, sends AND row_number() OVER (PARTITION BY {FLOW}, sends, seq, payload ORDER BY ts_us, packet_num) > 1 AS again FROM c0),
fw AS (SELECT a.packet_num AS n, b.ts_us, 0 AS d, b.i, b.packet_num AS m FROM c1 a JOIN c1 b USING ({FLOW}) WHERE a.again AND b.i BETWEEN a.i - 4 AND a.i),
fs AS (SELECT n, min_by(ts_us, i) AS since FROM fw GROUP BY n),
rv AS (SELECT a.packet_num AS n, b.ts_us, 1 AS d, b.i, b.packet_num AS m FROM c1 a JOIN fs ON fs.n = a.packet_num JOIN c1 b ON b.src_ip = a.dst_ip AND b.src_port = a.dst_port AND b.dst_ip = a.src_ip AND b.dst_port = a.src_port WHERE (b.ts_us, b.packet_num) < (a.ts_us, a.packet_num) AND b.ts_us >= since
QUALIFY row_number() OVER (PARTITION BY a.packet_num ORDER BY b.ts_us DESC, b.packet_num DESC) <= 5)
SELECT n AS packet_num, count(*) FILTER (d = 0) AS n_forward, count(*) FILTER (d = 1) AS n_reverse, array_to_string(list(m ORDER BY ts_us, d, i)[1:10], ',') AS context FROM (SELECT * FROM fw UNION ALL SELECT * FROM rv) GROUP BY n""")  # fmt: skip
_XT = _X.replace("FROM e WHERE tcp AND", "FROM t WHERE")
over_packets("silent_targets", lambda p: listings.silent_targets(both_ways(p)), f""", {_R}, {_XT}, b AS (SELECT DISTINCT dst_ip AS src_ip, dst_port AS src_port, src_ip AS dst_ip, src_port AS dst_port FROM t WHERE (flags & 20) <> 0)
SELECT {FLOW}, count(*) AS retries FROM x ANTI JOIN b USING ({FLOW}) WHERE (tcp_flags & 2) <> 0 GROUP BY {FLOW}""")  # fmt: skip
over_packets("tcp_window_groups", lambda p: listings.window_groups(_bottlenecks(p), 96 * HOUR), f""", {_TW}, {_TS} SELECT kind, count(*) AS flows, sum(zero_runs)::BIGINT AS zero_runs, sum(closed_us)::BIGINT AS closed_us,
max(zero_runs::HUGEINT * closed_us)::DOUBLE AS worst FROM tk GROUP BY kind""")  # fmt: skip
over_packets("jitter_severity_shares", lambda p: listings.severity_shares(timing.jitter_filtered_stats(p, 24 * HOUR, **CUTS).withColumn("severity", timing.jitter_severity(F.col("protocol"), F.col("p95_us") / 1000.0))), f""", {_J}, {_JF}, s AS (SELECT CASE WHEN protocol = 'UDP' THEN CASE WHEN p95_us < 20000 THEN 'excellent' WHEN p95_us < 30000 THEN 'low' WHEN p95_us < 50000 THEN 'medium' ELSE 'critical' END
WHEN p95_us < 100000 THEN 'low' WHEN p95_us < 200000 THEN 'medium' ELSE 'critical' END AS severity FROM jf) SELECT severity, count(*) AS n, count(*) / (SELECT count(*) FROM s)::DOUBLE * 100.0 AS share FROM s GROUP BY severity""")  # fmt: skip

# ---------------------------------------------------------------- root causes

_RANGE = "CASE WHEN dst_ip LIKE '203.0.113.%' THEN 'TEST-NET-3 (Documentation/Testing)' WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' THEN 'Private Network' END"
_SCOPE = "CASE WHEN to_it = size THEN 'all' WHEN to_it * 2 >= size THEN 'dominant' ELSE 'none' END"
_RC = f"""kg AS (SELECT {FLOW}, CASE WHEN s >= 0.8 * n THEN 'syn' WHEN r >= 0.8 * n THEN 'rto' WHEN f >= 0.8 * n THEN 'fast' WHEN o >= 0.8 * n THEN 'generic' ELSE 'mixed' END AS grp FROM (SELECT {FLOW}, count(*) AS n, count(*) FILTER ((tcp_flags & 2) <> 0) AS s,
count(*) FILTER ((tcp_flags & 2) = 0 AND kind = 'RTO') AS r, count(*) FILTER ((tcp_flags & 2) = 0 AND kind = 'Fast Retransmission') AS f, count(*) FILTER ((tcp_flags & 2) = 0 AND kind = 'Retransmission') AS o FROM x GROUP BY {FLOW})),
rr AS (SELECT x.*, p.ts_us, grp FROM x JOIN kg USING ({FLOW}) JOIN p USING (packet_num)),
fl AS (SELECT grp, {FLOW}, min(packet_num) AS fp, arg_min(tcp_flags, packet_num) AS ff, bool_and((tcp_flags & 2) <> 0) AS syns, bool_or(coalesce(heard, false)) AS heard FROM rr LEFT JOIN (SELECT DISTINCT dst_ip AS src_ip, dst_port AS src_port, src_ip AS dst_ip, src_port AS dst_port, true AS heard FROM t WHERE (flags & 20) <> 0) USING ({FLOW}) GROUP BY grp, {FLOW}),
sz AS (SELECT grp, count(*) AS size, NOT bool_or(heard) AND bool_and(syns) AS silent, (arg_min(ff, fp) & 18) = 18 AS client_side FROM fl GROUP BY grp),
ti AS (SELECT grp, dst_ip, count(*) AS to_it FROM fl GROUP BY grp, dst_ip QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, dst_ip) = 1), tp AS (SELECT grp, dst_port, count(*) AS c FROM fl GROUP BY grp, dst_port QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, dst_port) = 1),
cv AS (SELECT grp, count(*) AS n, (max(ts_us) - min(ts_us))::DOUBLE / (count(*) - 1) AS mean, sum(d::HUGEINT * d)::DOUBLE / (count(*) - 1) AS sq FROM (SELECT grp, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY grp ORDER BY ts_us) AS d FROM rr) GROUP BY grp),
ib AS (SELECT DISTINCT grp FROM rr JOIN bursts ON rr.ts_us BETWEEN start_us AND end_us WHERE peak_ratio > 3.0 AND grp = 'rto' GROUP BY grp, burst_id HAVING count(*) > 2),
ca AS (SELECT *, {_SCOPE} AS scope, {_RANGE} AS range_name, coalesce(ib.grp IS NOT NULL, false) AS burst FROM sz JOIN ti USING (grp) JOIN tp USING (grp) JOIN cv USING (grp) LEFT JOIN ib ON ib.grp = sz.grp),
cb AS (SELECT *, CASE WHEN scope = 'all' AND grp = 'syn' THEN CASE WHEN client_side THEN 'client_unreachable' ELSE 'server_unreachable' END WHEN scope = 'all' AND range_name LIKE 'TEST%' THEN 'special_address' WHEN burst THEN 'micro_bursts'
WHEN grp = 'rto' AND n >= 10 AND sqrt(greatest(sq - mean * mean, 0.0)) / mean < 0.3 THEN 'traffic_shaping' WHEN grp = 'syn' AND silent THEN 'silently_dropped' END AS cause FROM ca)
SELECT grp AS "group", size AS flows, n AS retransmissions, dst_ip, to_it, scope, cause, CASE WHEN cause IN ('client_unreachable', 'server_unreachable', 'silently_dropped') THEN dst_ip || ':' || dst_port WHEN cause = 'special_address' THEN range_name END AS cause_on FROM cb"""


def _retransmission_causes(p: DataFrame, all_packets: DataFrame) -> DataFrame:
    return causes.retransmission_causes(tcp.exact_retransmissions(p), listings.answered_flows(p), timing.bursts(all_packets, BURST), causes.range_table(p.sparkSession), 2, 3.0)


over_packets("retransmission_causes", lambda p: _retransmission_causes(both_ways(p), p), f", {_R}, {_XT}, {_B}, {_RC}")
over_packets("retransmission_causes_of_a_target", lambda p: _retransmission_causes(p.where("dst_ip = '203.0.113.7'"), p), f", t AS (SELECT * FROM e WHERE tcp AND dst_ip = '203.0.113.7'), {_XT}, {_B}, {_RC}")
_WC = f"""g AS (SELECT kind, count(*) AS size, sum(zero_runs) * (sum(closed_us)::BIGINT / 1e6) AS weight FROM tk GROUP BY kind), ti AS (SELECT kind, dst_ip, count(*) AS to_it FROM tk GROUP BY kind, dst_ip QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, dst_ip) = 1),
tp AS (SELECT kind, dst_port, count(*) AS c FROM tk GROUP BY kind, dst_port QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, dst_port) = 1),
ca AS (SELECT *, {_SCOPE} AS scope, {_RANGE} AS range_name FROM g JOIN ti USING (kind) JOIN tp USING (kind)),
cb AS (SELECT *, CASE WHEN scope = 'all' THEN CASE WHEN coalesce(range_name, '') LIKE 'TEST%' THEN 'special_address' ELSE 'slow_receiver' END END AS cause FROM ca)
SELECT kind, size AS flows, dst_ip, to_it, scope, CASE WHEN weight > 100 THEN 'high' WHEN weight > 20 THEN 'medium' ELSE 'low' END AS severity, cause, CASE cause WHEN 'special_address' THEN range_name WHEN 'slow_receiver' THEN dst_ip || ':' || dst_port END AS cause_on FROM cb"""
over_packets("window_causes", lambda p: causes.window_causes(_window_groups(p), causes.range_table(p.sparkSession)), f", {_TW}, {_TS}, {_WC}")
over_packets("window_causes_of_a_target", lambda p: causes.window_causes(_window_groups(p.where("dst_ip = '93.184.216.34'")), causes.range_table(p.sparkSession)), f", {_TW.replace('FROM e WHERE tcp', 'FROM e WHERE tcp AND dst_ip = $$93.184.216.34$$')}, {_TS}, {_WC}")
_JC = f"""js AS (SELECT *, CASE WHEN protocol = 'UDP' THEN CASE WHEN p95_us < 20000 THEN 'excellent' WHEN p95_us < 30000 THEN 'low' WHEN p95_us < 50000 THEN 'medium' ELSE 'critical' END WHEN p95_us < 100000 THEN 'low' WHEN p95_us < 200000 THEN 'medium' ELSE 'critical' END AS severity,
CASE dst_port WHEN 22 THEN 'SSH' WHEN 53 THEN 'DNS' WHEN 443 THEN 'HTTPS' WHEN 3389 THEN 'RDP' ELSE 'Unknown' END AS service FROM jf),
g AS (SELECT severity, count(*) AS size FROM js GROUP BY 1), ti AS (SELECT severity, dst_ip, count(*) AS to_it FROM js GROUP BY severity, dst_ip QUALIFY row_number() OVER (PARTITION BY severity ORDER BY count(*) DESC, dst_ip) = 1),
tv AS (SELECT severity, service, count(*) AS c FROM js GROUP BY severity, service QUALIFY row_number() OVER (PARTITION BY severity ORDER BY count(*) DESC, service) = 1),
ca AS (SELECT *, {_SCOPE} AS scope, {_RANGE} AS range_name FROM g JOIN ti USING (severity) JOIN tv USING (severity)),
cb AS (SELECT *, CASE WHEN scope = 'all' THEN CASE WHEN range_name IS NOT NULL THEN 'special_address' ELSE 'network_path' END WHEN service <> 'Unknown' THEN 'service' END AS cause FROM ca)
SELECT severity, size AS flows, dst_ip, to_it, scope, cause, CASE cause WHEN 'special_address' THEN range_name WHEN 'network_path' THEN dst_ip WHEN 'service' THEN service END AS cause_on FROM cb"""


def _jitter_causes(p: DataFrame) -> DataFrame:
    flows = timing.jitter_filtered_stats(p, 24 * HOUR, **CUTS)
    flows = flows.withColumn("severity", timing.jitter_severity(F.col("protocol"), F.col("p95_us") / 1000.0))
    return causes.jitter_causes(flows, causes.range_table(p.sparkSession))


over_packets("jitter_causes", _jitter_causes, f", {_J}, {_JF}, {_JC}")
over_packets("jitter_causes_of_a_target", lambda p: _jitter_causes(p.where("dst_ip = '192.168.1.10'")), f", {_J}, {_JF.replace('FROM j WHERE', 'FROM j WHERE dst_ip = $$192.168.1.10$$ AND')}, {_JC}")


def _dns_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("rcode") == 3, "NXDOMAIN").when(F.col("rcode") == 0, "NOERROR").alias("rcode")
    return causes.dns_causes(folds.dns_transactions(transactions(spark, sf_dir)).select("qname", "server", "status", name))


over_tables("dns_causes", _dns_causes, _DNS + """, b AS (SELECT qname, server, status AS issue, CASE rcode WHEN 3 THEN 'NXDOMAIN' END AS code FROM tx WHERE status IN ('timeout', 'error', 'slow')), g AS (SELECT issue, count(*) AS size FROM b GROUP BY 1),
tq AS (SELECT issue, qname, count(*) AS cq FROM b GROUP BY issue, qname QUALIFY row_number() OVER (PARTITION BY issue ORDER BY count(*) DESC, qname) = 1), ts AS (SELECT issue, server, count(*) AS cs FROM b GROUP BY issue, server QUALIFY row_number() OVER (PARTITION BY issue ORDER BY count(*) DESC, server) = 1)
SELECT issue, size AS lookups, CASE WHEN cq * 2 >= size THEN 'repeated_name' WHEN cs * 2 >= size THEN 'resolver' ELSE 'error_code' END AS cause, CASE WHEN cq * 2 >= size THEN qname WHEN cs * 2 >= size THEN server ELSE 'NXDOMAIN' END AS cause_on, CASE WHEN cq * 2 >= size THEN cq ELSE cs END AS times FROM g JOIN tq USING (issue) JOIN ts USING (issue)""")  # fmt: skip


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    jitter = timing.jitter_filtered_stats(p, 24 * HOUR, **CUTS)
    jitter = jitter.withColumn("severity", timing.jitter_severity(F.col("protocol"), F.col("p95_us") / 1000.0))
    return score.findings(p, tcp.exact_retransmissions(p), jitter, timing.gaps(p, SLOW), _syn_delays(p), folds.dns_transactions(transactions(spark, sf_dir)), many_gaps=100)


over_tables("findings", findings, PACKETS + f""", {_X}, {_J}, {_JF}, {_G.replace("g AS (", "gg AS (", 1).replace("FROM g WHERE", "FROM gg WHERE")}, {_SD}, {_DNS.removeprefix('WITH ')},
f1 AS (SELECT 'retransmission rate' AS finding, sum(c) / (SELECT count(*) FROM p)::DOUBLE * 100.0 AS value, arg_min(name, (-c, name)) AS detail FROM (SELECT src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port AS name, count(*) AS c FROM x GROUP BY 1)),
f2 AS (SELECT 'critical jitter' AS finding, count(*)::DOUBLE AS value, NULL AS detail FROM jf WHERE CASE WHEN protocol = 'UDP' THEN p95_us >= 50000 ELSE p95_us >= 200000 END),
f3 AS (SELECT 'gaps' AS finding, sum(c)::DOUBLE AS value, arg_min(name, (-c, name)) || ' ' || round(max(c) / sum(c)::DOUBLE * 100.0)::INT || '%' AS detail FROM (SELECT src_ip || ' <-> ' || dst_ip AS name, count(*) AS c FROM h GROUP BY 1)),
f4 AS (SELECT 'failed connections' AS finding, count(*)::DOUBLE AS value, NULL AS detail FROM sd WHERE retries > 0), f5 AS (SELECT 'dns failures' AS finding, count(*) FILTER (status IN ('timeout', 'error')) / count(*)::DOUBLE * 100.0 AS value, NULL AS detail FROM tx)
SELECT * FROM f1 WHERE value >= 2 UNION ALL SELECT * FROM f2 WHERE value > 0 UNION ALL SELECT * FROM f3 WHERE value > 100 UNION ALL SELECT * FROM f4 WHERE value > 10 UNION ALL SELECT * FROM f5 WHERE value > 5""")  # fmt: skip


def graph_series(p: DataFrame) -> DataFrame:
    trips = _trips(p).join(p.select(F.col("packet_num").alias("ack_num"), "ts_us"), "ack_num")
    return report.graph_series(timing.jitter(p, **CUTS), timing.jitter_flow_stats(p, **CUTS), trips, tcp.exact_retransmissions(p))


over_packets("graph_series", graph_series, f""", {_R}, {_X}, {_J}, js AS (SELECT {_FIVE}, list_sort(list(jitter_us))[1 + least(floor(count(*) * 0.95)::BIGINT, count(*) - 1)] AS p95 FROM j GROUP BY {_FIVE}),
gw AS (SELECT {_FIVE}, CASE WHEN p95 / 1000.0 > 50 THEN 'critical' WHEN p95 / 1000.0 > 30 THEN 'warning' ELSE 'ok' END AS level, p95 / 1000.0::DOUBLE * 1.2::DOUBLE AS mark FROM js ORDER BY p95 DESC, {_FIVE} LIMIT 10)
SELECT {_FIVE}, level, 'jitter' AS series, ts_us, jitter_us / 1000.0::DOUBLE AS value_ms FROM j JOIN gw USING ({_FIVE})
UNION ALL SELECT gw.protocol, {FLOW}, level, 'rtt', a.ts_us, rtt_us / 1000.0::DOUBLE FROM rtt JOIN gw USING ({FLOW}) JOIN (SELECT packet_num AS ack_num, ts_us FROM p) a USING (ack_num)
UNION ALL SELECT gw.protocol, {FLOW}, level, 'retransmission', b.ts_us, mark FROM x JOIN gw USING ({FLOW}) JOIN (SELECT packet_num, ts_us FROM p) b USING (packet_num)""")  # fmt: skip
_FLOW_TEXT = "concat(src_ip, ':', coalesce(src_port::VARCHAR, 'None'), ' -> ', dst_ip, ':', coalesce(dst_port::VARCHAR, 'None'), ' (', protocol, ')') AS \"Flow\""
_SERVICE_FLOWS = _SERVICES.rsplit("\nSELECT service", 1)[0].replace("o AS (SELECT n, bytes,", f"o AS (SELECT protocol, {FLOW}, n, bytes,")
over_varied("csv_protocol_distribution", lambda p: listings.csv_protocols(traffic.protocol_distribution(p)), """ SELECT protocol AS "Protocol", count(*) AS "Count", printf('%.2f%%', count(*) / (SELECT count(*) FROM p)::DOUBLE * 100.0) AS "Percentage" FROM p GROUP BY protocol""")
over_varied("csv_service_classification", lambda p: listings.csv_services(traffic.service_summary(p)), f""", {_SERVICE_FLOWS} SELECT service AS "Service Type", count(*) AS "Flow Count", printf('%.2f%%', count(*) / (SELECT count(*) FROM o)::DOUBLE * 100.0) AS "Percentage" FROM o GROUP BY service""")
over_packets("csv_jitter_statistics", lambda p: listings.csv_jitter(timing.jitter_flow_stats(p, **CUTS)), f""", {_J}, g AS (SELECT {_FIVE}, count(*) AS n, max(jitter_us) AS mx, sum(jitter_us) / count(*)::DOUBLE AS mean FROM j GROUP BY {_FIVE})
SELECT {_FLOW_TEXT}, printf('%.3f', round_even(mean, 0) / 1000.0::DOUBLE) AS "Mean Jitter (ms)", printf('%.3f', mx / 1000.0::DOUBLE) AS "Max Jitter (ms)", n AS "Packet Count" FROM g""")  # fmt: skip
over_varied("csv_classified_flows", lambda p: listings.csv_flows(traffic.classify_services(p)), f""", {_SERVICE_FLOWS} SELECT {_FLOW_TEXT}, service AS "Service Type", printf('%.2f', c) AS "Confidence", n AS "Packets", printf('%.0f', bytes / n::DOUBLE) AS "Avg Packet Size" FROM o""")
