"""The same questions over packet streams (columns as in schema.py plus ts, a timestamp).

Windows carry a watermark, so state is dropped once it can't change; connection tracking
keeps one small state per connection with an event-time timer.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cols import ACK, ENDS, RST, SYN, has, syn_only, with_ends
from ..operators import folds, security, steps


def with_time(p: DataFrame) -> DataFrame:
    return p.withColumn("ts", F.timestamp_micros("ts_us"))


def traffic_windows(p: DataFrame, width: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Packets and bytes per protocol and tumbling window."""
    g = with_time(p).withWatermark("ts", late).groupBy(F.window("ts", width), "protocol")
    return g.agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes")).select("window.start", "protocol", "packets", "bytes")


def flow_sessions(p: DataFrame, gap: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Packets and bytes per flow and session, cut at gaps."""
    keys = ("protocol", "src_ip", "src_port", "dst_ip", "dst_port")
    g = with_time(p).withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys)
    return g.agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes")).select("session_window.start", "session_window.end", *keys, "packets", "bytes")


def syn_rates(p: DataFrame, per_window: int, width: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    """Targets that get more than per_window unanswered SYNs in a window."""
    t = with_time(p).where(F.col("protocol") == "TCP").withWatermark("ts", late)
    g = t.groupBy(F.window("ts", width), "dst_ip", "dst_port").agg(F.count_if(syn_only()).alias("syns"), F.approx_count_distinct("src_ip").alias("sources"))
    return g.where(F.col("syns") > per_window).select("window.start", "dst_ip", "dst_port", "syns", "sources")


HANDSHAKE = "ip_a string, port_a int, ip_b string, port_b int, syn_us bigint, synack_us bigint, ack_us bigint, status string"


def _track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: time of SYN, of SYN-ACK and the number that the ACK must carry."""
    names = [c.split()[0] for c in HANDSHAKE.split(", ")]
    if state.hasTimedOut:
        syn, synack, _ = state.get
        state.remove()
        yield pd.DataFrame([(*key, syn, synack or None, None, "timeout")], columns=names).astype({"synack_us": "Int64", "ack_us": "Int64"})
        return
    syn, synack, need = state.get if state.exists else (0, 0, 0)
    out = []
    rows = pd.concat(list(frames)).sort_values(["ts_us", "packet_num"])
    for us, flags, seq, ack in zip(rows["ts_us"], rows["tcp_flags"], rows["tcp_seq"], rows["tcp_ack"]):
        flags = int(flags)
        if flags & SYN and not flags & ACK:
            syn = syn or int(us)
        elif flags & SYN and syn and not synack:
            synack, need = int(us), int(seq) + 1
        elif flags & RST and syn:
            out.append((*key, syn, synack or None, None, "reset"))
            syn = synack = need = 0
        elif flags & ACK and synack and int(ack) == need:
            out.append((*key, syn, synack, int(us), "complete"))
            syn = synack = need = 0
    if syn:
        state.update((syn, synack, need))
        state.setTimeoutTimestamp(max(syn // 1000 + 60_000, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=names).astype({"synack_us": "Int64", "ack_us": "Int64"})


def handshake_stream(p: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Handshakes as they complete, are reset, or stay open for 60 seconds of event time."""
    t = with_ends(with_time(p).where((F.col("protocol") == "TCP") & (has(SYN) | has(ACK) | has(RST)))).withWatermark("ts", late)
    g = t.select("ts", "ts_us", "packet_num", "tcp_flags", "tcp_seq", "tcp_ack", "ip_a", "port_a", "ip_b", "port_b").groupBy("ip_a", "port_a", "ip_b", "port_b")
    return g.applyInPandasWithState(_track, HANDSHAKE, "syn bigint, synack bigint, need bigint", "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- the step objects of batch jobs, over streams

_DTYPES = {"string": "object", "int": "Int32", "bigint": "Int64", "boolean": "boolean"}


class OrderedFold(StatefulProcessor):
    """One step object (steps.py) per key, fed in order of event time.

    State of a key: its rows that the watermark has not passed yet (a map by time and packet
    number), and the step, pickled. Rows are fed once the watermark passes them, by an
    event-time timer; so however they are shuffled over micro-batches, the step sees the
    order a batch job sorts them into, as long as none is later than the watermark. A later
    one is fed in its place while the step hasn't passed that, and left out otherwise. A
    step that says from when on it is free is closed and dropped then; one that doesn't is
    kept for keep_us after its last row.
    """

    def __init__(self, columns: Sequence[str], row_ddl: str, make: Callable, out: str, keep_us: int):
        self.columns, self.row_ddl, self.make, self.keep = list(columns), row_ddl, make, keep_us
        self.out = {n: _DTYPES[t] for n, t in (x.split() for x in out.split(", "))}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "ts_us bigint, packet_num bigint", self.row_ddl)
        self.step = handle.getValueState("step", "step binary, last_us bigint")

    def _due(self, us: int) -> None:
        """Wake up once the watermark reaches us."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for r in frame[self.columns].astype(object).where(frame[self.columns].notna(), None).itertuples(index=False, name=None):
                self.rows.updateValue((int(r[1]), int(r[0])), r)
                first = int(r[1]) if first is None else min(first, int(r[1]))
        if first is not None:
            self._due(first)
        yield self._frame([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.rows.iterator(), key=lambda kv: tuple(kv[0]))
        kept = self.step.get() if self.step.exists() else None
        step, last = (pickle.loads(bytes(kept[0])), kept[1]) if kept else (self.make(), None)
        found = []
        for (us, num), r in waiting:
            if us > mark:
                self._due(us)
                break
            if last is None or us >= last:  # else it comes later than what the step has passed
                found += step.feed(tuple(r))
                last = us
            self.rows.removeKey((us, num))
        if last is None:
            yield self._frame(found)
            return
        found += step.passed(mark)
        if (wake := step.wake_at()) is not None:
            self._due(wake)
        free = step.free_at()
        free = last + self.keep if free is None else free
        if free <= mark and not self.rows.exists():
            found += step.close()
            self.step.clear()
        else:
            self.step.update((pickle.dumps(step), last))
            if free > mark:
                self._due(free)
        yield self._frame(found)

    def _frame(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=list(self.out)).astype(self.out)

    def close(self) -> None:
        pass


def folded(df: DataFrame, keys: Sequence[str], columns: Sequence[str], make: Callable, out: str, late: str = "60 seconds", keep_us: int = 3_600_000_000) -> DataFrame:
    """What folds.ordered_fold finds, over a stream; columns begin with packet_num and ts_us.

    Needs a state store with several states for each key (RocksDB).
    """
    t = with_time(df).withWatermark("ts", late).select("ts", *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], *columns)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)
    step = OrderedFold(columns, ddl, make, out, keep_us)
    return t.groupBy(*[f"key{i}" for i in range(len(keys))]).transformWithStateInPandas(step, out, "append", "eventTime")


def round_trip_stream(p: DataFrame, within_us: int = 60_000_000, late: str = "60 seconds") -> DataFrame:
    """folds.round_trips over a stream: a connection without waiting segments holds no state."""
    return folded(folds.connections(p), ENDS, folds.COLUMNS, lambda: steps.RoundTrips(within_us), folds.ROUND_TRIPS, late)


def segment_stream(p: DataFrame, timers: steps.Timers = steps.Timers(), late: str = "60 seconds") -> DataFrame:
    """folds.segment_events over a stream; a connection is dropped once both ends have been idle for timers.idle."""
    return folded(folds.connections(p), ENDS, folds.COLUMNS, lambda: steps.Segments(timers), steps.SEGMENT_EVENTS, late)


def rapid_move_stream(p: DataFrame, least: int = 3, window_us: int = 300_000_000, apart_us: int = 5_000_000, late: str = "60 seconds", keep_us: int = 86_400_000_000) -> DataFrame:
    """security.lateral_rapid over a stream: exact sliding windows; a source is reported once within keep_us of its last connection."""
    moves = security.admin_syns(p).select("packet_num", "ts_us", "src_ip", "dst_ip")
    out = "src_ip string, start_us bigint, targets bigint"
    return folded(moves, ("src_ip",), ("packet_num", "ts_us", "src_ip", "dst_ip"), lambda: steps.RapidMoves(least, window_us, apart_us), out, late, keep_us)


# ---------------------------------------------------------------- progress


def observed(p: DataFrame, name: str) -> DataFrame:
    """A stream of packets whose number, bytes and latest time each micro-batch reports under this name."""
    return p.observe(name, F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"), F.max("ts_us").alias("latest_us"))


def observed_once(p: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same for a batch job: the packets, and where the numbers stand once an action has run over them."""
    o = Observation(name)
    return p.observe(o, F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"), F.max("ts_us").alias("latest_us")), o


class Progress(StreamingQueryListener):
    """Per query (by name, else id): batches, input rows, rows later than the watermark, rows of state, and sums of what observed() counts."""

    def __init__(self) -> None:
        self.queries: dict[str, dict] = defaultdict(lambda: {"batches": 0, "input_rows": 0, "late_rows": 0, "state_rows": 0, "packets": 0, "bytes": 0, "watermark": None, "ended": False})
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event: object) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        q = self.queries[p.name or str(p.id)]
        q["batches"] += 1
        q["input_rows"] += max(0, p.numInputRows)
        q["late_rows"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        q["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)
        q["watermark"] = p.eventTime.get("watermark", q["watermark"])
        for row in p.observedMetrics.values():
            q["packets"] += row["packets"] or 0
            q["bytes"] += row["bytes"] or 0

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.queries[self.names.get(str(event.id), str(event.id))]["ended"] = True
