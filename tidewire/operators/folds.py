"""Order-dependent analyses: one pass over each key's rows, in order.

What a row does to a key's state is said by the step objects of steps.py; here Spark deals
the rows by key, sorts them in their partitions and streams them through. What can be said
by windows and joins is in tcp.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import ENDS, FLOW, SYN, is_tcp, with_ends
from .steps import SEGMENT_EVENTS, TIMELINES, Handshakes, Lookups, RoundTrips, Segments, Timelines, Timers

COLUMNS = ("packet_num", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "tcp_payload_len")
#: Result rows that a task gathers before it hands them on.
CHUNK = 10_000
_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def ordered_fold(df: DataFrame, keys: Sequence[str], columns: Sequence[str], make: Callable, schema: str) -> DataFrame:
    """Rows that the step of each key (make()) finds in `columns` of its rows, by ts_us and packet_num.

    A key's rows lie sorted in one partition (the sort spills) and are read batch by batch,
    so a task holds a batch and one step's state, never all rows of a key.
    """
    fields = [x.split() for x in schema.split(", ")]
    out = pa.schema([(n, _KINDS[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]))

        def found() -> Iterator[tuple]:
            for _, group in groupby(rows, itemgetter(*range(len(keys)))):
                step = make()
                for r in group:
                    yield from step.feed(r[len(keys) :])
                yield from step.close()

        made = found()
        while part := list(islice(made, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), out.types)], schema=out)

    t = df.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], *columns)
    names = [f"key{i}" for i in range(len(keys))]
    return t.repartition(*names).sortWithinPartitions(*names, F.col("ts_us").asc_nulls_last(), F.col("packet_num").asc_nulls_last()).mapInArrow(run, schema)


def connections(p: DataFrame) -> DataFrame:
    """The TCP packets that steps read, with the ends of their connection."""
    return with_ends(p.where(is_tcp() & F.col("tcp_flags").isNotNull())).select(*ENDS, *COLUMNS)


def suspected_side(answer_us: Column, ack_us: Column, slow_us: int = 300_000, slow_answer_us: int = 100_000) -> Column:
    """Who slows a handshake, by the delays up to the SYN-ACK and from there to the ACK."""
    return (
        F.when(answer_us.isNull() | (answer_us == 0), "unknown")
        .when(answer_us > slow_answer_us, F.when(answer_us > 500_000, "server").otherwise("network"))
        .when(ack_us > slow_answer_us, "client")
        .when(answer_us + ack_us > slow_us, "network")
        .otherwise("none")
    )


def handshakes(p: DataFrame, slow_us: int = 300_000, slow_answer_us: int = 100_000, at_least_us: int | None = None) -> DataFrame:
    """Handshakes with their delays and the side suspected of slowness; incomplete ones have nulls.

    With at_least_us only handshakes stay of which one delay or the total reaches it.
    """
    schema = "src_ip string, src_port int, dst_ip string, dst_port int, syn_us bigint, synack_us bigint, ack_us bigint"
    h = ordered_fold(connections(p), ENDS, COLUMNS, Handshakes, schema)
    total = F.col("ack_us") - F.col("syn_us")
    answer, ack = F.col("synack_us") - F.col("syn_us"), F.col("ack_us") - F.col("synack_us")
    h = h.withColumn("total_us", total).withColumn("slow", F.coalesce(total > slow_us, F.lit(False)))
    h = h.withColumn("suspected", suspected_side(answer, ack, slow_us, slow_answer_us))
    return h if at_least_us is None else h.where(F.greatest(answer, ack, total) >= at_least_us)


#: Rows that RoundTrips finds.
ROUND_TRIPS = "packet_num bigint, src_ip string, src_port int, dst_ip string, dst_port int, ack_num bigint, rtt_us bigint"


def round_trips(p: DataFrame, within_us: int = 60_000_000, at_least_us: int | None = None) -> DataFrame:
    """Data segments with the ACK that covers them first, at most within_us later (see RoundTrips).

    With at_least_us only round trips of that length stay.
    """
    r = ordered_fold(connections(p), ENDS, COLUMNS, lambda: RoundTrips(within_us), ROUND_TRIPS)
    return r if at_least_us is None else r.where(F.col("rtt_us") >= at_least_us)


def segment_events(p: DataFrame, timers: Timers = Timers()) -> DataFrame:
    """Retransmissions and anomalies of every connection (rows of SEGMENT_EVENTS, see Segments)."""
    return ordered_fold(connections(p), ENDS, COLUMNS, lambda: Segments(timers), SEGMENT_EVENTS)


def retransmissions(events: DataFrame) -> DataFrame:
    """The retransmissions among segment_events, with what was acknowledged by then and which side of a handshake failed."""
    syn = F.col("tcp_flags").bitwiseAND(SYN) != 0
    side = F.when(syn, F.when(F.col("tcp_flags").bitwiseAND(16) != 0, "client_unreachable").otherwise("server_unreachable"))
    r = events.where("event = 'retransmission'").withColumnRenamed("expected", "expected_ack")
    return r.select("packet_num", "ts_us", *FLOW, "tcp_seq", "tcp_flags", "original_num", "delay_us", "kind", "spurious", "confidence", "dup_acks", "last_ack", "last_ack_num", "expected_ack", side.alias("unreachable"))


def timelines(p: DataFrame, timers: Timers = Timers(), most: int = 10) -> DataFrame:
    """How the flows with retransmissions began and ended (rows of TIMELINES, see Timelines)."""
    return ordered_fold(connections(p), ENDS, COLUMNS, lambda: Timelines(timers, most), TIMELINES)


def flow_severity(p: DataFrame, events: DataFrame, low: int = 10, critical: int = 100, rates: tuple[float, float, float] = (1.0, 3.0, 5.0)) -> DataFrame:
    """Per directed flow: packets, events of each kind, the rate of retransmissions in percent and its severity.

    A flow needs `low` retransmissions to have one; rates are the bounds of low, medium and
    critical; `critical` retransmissions are low whatever their rate.
    """
    count = lambda kind: F.count_if(F.col("event") == kind)
    kinds = {"retransmissions": "retransmission", "dup_acks": "dup_ack", "out_of_order": "out_of_order", "zero_windows": "zero_window"}
    e = events.groupBy(*FLOW).agg(*[count(k).alias(n) for n, k in kinds.items()])
    t = p.where(is_tcp() & F.col("tcp_flags").isNotNull()).groupBy(*FLOW).agg(F.count("*").alias("packets")).join(e, list(FLOW), "left")
    t = t.select(*FLOW, "packets", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in kinds])
    n, rate = F.col("retransmissions"), F.col("retransmissions") / F.col("packets").cast("double") * 100.0
    by_rate = F.when(rate >= rates[2], "critical").when(rate >= rates[1], "medium").when((rate >= rates[0]) | (n >= critical), "low")
    return t.withColumn("rate", rate).withColumn("severity", F.coalesce(F.when(n >= low, by_rate), F.lit("none")))


def segment_report(events: DataFrame, severity: DataFrame) -> DataFrame:
    """One row: flows, flows with a severity, retransmissions by kind (RTOs without SYNs), distinct segments sent again, anomalies by kind."""
    e, kind = F.col("event"), F.col("kind")
    again, syn = e == "retransmission", F.col("tcp_flags").bitwiseAND(SYN) != 0
    g = events.agg(
        F.count_if(again).alias("retransmissions"), F.count_if(again & (kind == "RTO") & ~syn).alias("rto"), F.count_if(again & (kind == "Fast Retransmission")).alias("fast"),
        F.count_distinct(F.when(again, F.struct(*FLOW, "tcp_seq"))).alias("distinct_segments"), F.count_if(again & F.col("spurious")).alias("spurious"),
        *[F.count_if(e == k).alias(n) for n, k in (("dup_acks", "dup_ack"), ("out_of_order", "out_of_order"), ("zero_windows", "zero_window"))],
    )
    s = severity.agg(F.count("*").alias("flows"), F.count_if(F.col("severity") != "none").alias("flows_with_issues"), *[F.count_if(F.col("severity") == x).alias(f"{x}_flows") for x in ("critical", "medium", "low")])
    return s.crossJoin(g.withColumn("other", F.col("retransmissions") - F.col("rto") - F.col("fast")))  # both are one row


def dns_transactions(q: DataFrame, timeout_us: int = 5_000_000, slow_us: int = 1_000_000) -> DataFrame:
    """DNS lookups (ts_us, packet_num, client, client_port, server, id, qr, rcode, qname): each response takes the open query
    of its id, server, client and port (see Lookups); open ones time out after timeout_us of DNS traffic."""
    end = q.agg(F.max("ts_us").alias("end_us"))
    schema = "client string, server string, id int, qname string, query_us bigint, response_us bigint, rcode int"
    columns = ("packet_num", "ts_us", "client", "server", "id", "qr", "rcode", "qname")
    t = ordered_fold(q, ("client", "client_port", "server", "id"), columns, lambda: Lookups(timeout_us), schema).crossJoin(F.broadcast(end))
    took = F.col("response_us") - F.col("query_us")
    status = (
        F.when(F.col("response_us").isNull(), F.when(F.col("end_us") - F.col("query_us") >= timeout_us, "timeout").otherwise("open"))
        .when(F.col("rcode") != 0, "error").when(took > slow_us, "slow").otherwise("success")
    )
    return t.select("client", "server", "id", "qname", took.alias("took_us"), "rcode", status.alias("status"))
