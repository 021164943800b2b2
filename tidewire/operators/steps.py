"""Step objects: what the rows of one key tell, fed to them one by one in order of time.

feed(row) hands back finished result rows, close() what is still open. Batch jobs feed a
step the sorted rows of its key (folds.py); streams keep it between micro-batches as state
(stream.py), so both give the same rows.

Rows of a connection are (packet_num, ts_us, src_ip, src_port, dst_ip, dst_port, tcp_seq,
tcp_ack, tcp_flags, tcp_window, tcp_payload_len), of both directions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

from ..functions.cols import ACK, FIN, RST, SYN


class Step:
    """What a step that isn't fed yet, or needs no more than rows, answers."""

    def feed(self, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> Iterator[tuple]:
        """Rows for what is still open when no more rows come."""
        return iter(())

    def passed(self, us: int) -> Iterator[tuple]:
        """Rows that are certain once event time has passed us without another row."""
        return iter(())

    def wake_at(self) -> int | None:
        """The event time at which passed() may have rows."""
        return None

    def free_at(self) -> int | None:
        """From which event time on the step can be forgotten if it gets no more rows (None: never)."""
        return None


class Handshakes(Step):
    """(src_ip, src_port, dst_ip, dst_port, syn_us, synack_us, ack_us) of SYN, SYN-ACK and the ACK that answers it.

    The first SYN of a pending handshake counts, and its first SYN-ACK; the ACK must
    acknowledge the SYN-ACK's number plus one. Then the next SYN starts anew.
    """

    def __init__(self) -> None:
        self.open: dict[tuple, list] = {}

    def feed(self, row: tuple) -> Iterator[tuple]:
        _, us, sip, sport, dip, dport, seq, ack, flags, _, _ = row
        key, back = (sip, sport, dip, dport), (dip, dport, sip, sport)
        if flags & SYN and not flags & ACK:
            self.open.setdefault(key, [us, None, None])
        elif flags & SYN:
            h = self.open.get(back)
            if h is not None and h[1] is None:
                h[1], h[2] = us, seq + 1
        elif flags & ACK:
            h = self.open.get(key)
            if h is not None and h[1] is not None and ack == h[2]:
                yield (*key, h[0], h[1], us)
                del self.open[key]

    def close(self) -> Iterator[tuple]:
        for key, h in self.open.items():
            yield (*key, h[0], h[1], None)

    def free_at(self) -> int | None:
        return None if self.open else 0


class RoundTrips(Step):
    """(packet_num, src_ip, src_port, dst_ip, dst_port, ack_num, rtt_us) of data segments and the ACK that covers each.

    A segment waits under its sequence number; while it does, another one with that number
    is passed over. An ACK of the other side takes all waiting segments that it covers, once.
    A segment that has waited longer than within_us is forgotten. The segments that wait are
    all that is held; each is pushed and popped once.
    """

    def __init__(self, within_us: int) -> None:
        self.within = within_us
        self.sides: dict[tuple, tuple[dict, list, deque]] = {}
        self.last = 0

    def _side(self, end: tuple) -> tuple[dict, list, deque]:
        return self.sides.setdefault(end, ({}, [], deque()))

    def feed(self, row: tuple) -> Iterator[tuple]:
        num, us, sip, sport, dip, dport, seq, ack, flags, _, size = row
        self.last = us
        if size > 0:
            waiting, by_need, by_age = self._side((sip, sport))
            while by_age and by_age[0][1] < us - self.within:
                old = by_age.popleft()
                if waiting.get(old[2]) is old:
                    del waiting[old[2]]
            if seq not in waiting:
                segment = (num, us, seq, seq + size)
                waiting[seq] = segment
                by_age.append(segment)
                heappush(by_need, (seq + size, num, segment))
        if flags & ACK and ack > 0:
            waiting, by_need, _ = self._side((dip, dport))
            while by_need and by_need[0][0] <= ack:
                segment = heappop(by_need)[2]
                if waiting.get(segment[2]) is segment:
                    del waiting[segment[2]]
                    if us - segment[1] <= self.within:
                        yield segment[0], dip, dport, sip, sport, num, us - segment[1]

    def free_at(self) -> int:
        return self.last + self.within + 1 if any(s[0] for s in self.sides.values()) else 0


@dataclass(frozen=True)
class Timers:
    """After how long a connection counts as over, in microseconds."""

    time_wait: int = 120_000_000
    idle: int = 300_000_000
    fin: int = 30_000_000


@dataclass(slots=True)
class _End:
    """One end's view of its connection, in the states of RFC 793."""

    state: str = "closed"
    isn: int | None = None
    own_fin: int | None = None
    fin_acked: bool = False
    peer_fin: bool = False
    over: bool = False
    last_us: int | None = None
    since_us: int = 0

    def enter(self, state: str, us: int) -> None:
        self.state, self.since_us = state, us

    def ended(self, us: int, timers: Timers) -> bool:
        """Reset, waited out, idle too long, or its FIN unanswered too long."""
        return (
            self.over
            or (self.state == "time_wait" and us - self.since_us >= timers.time_wait)
            or (self.last_us is not None and us - self.last_us >= timers.idle)
            or (self.own_fin is not None and not self.fin_acked and us - self.since_us >= timers.fin)
        )


def _advance(a: _End, b: _End, us: int, seq: int, ack: int, flags: int) -> None:
    """What a packet of end a (its peer: b) does to both ends' states."""
    syn, fin, acks = bool(flags & SYN), bool(flags & FIN), bool(flags & ACK)
    a.last_us = us
    if flags & RST:
        for end in (a, b):
            end.over = True
            end.enter("closed", us)
        return
    acked = acks and a.own_fin is not None and ack > a.own_fin
    match a.state:
        case "closed" if syn:
            a.isn = seq
            a.enter("syn_received" if acks else "syn_sent", us)
        case "syn_sent" if syn and acks:
            b.isn = seq
            b.enter("syn_received", us)
        case "syn_sent" | "syn_received" if acks and not syn:
            a.enter("established", us)
        case "established" if fin:
            a.own_fin = seq
            a.enter("fin_wait_1", us)
            b.peer_fin = True
            b.enter("close_wait", us)
        case "fin_wait_1":
            if acked:
                a.fin_acked = True
                a.enter("closing" if a.peer_fin else "fin_wait_2", us)
            if fin and not a.peer_fin:
                a.peer_fin = True
                a.enter("time_wait" if a.fin_acked else "closing", us)
        case "fin_wait_2" if fin:
            a.peer_fin = True
            a.enter("time_wait", us)
        case "closing" if acked:
            a.fin_acked = True
            a.enter("time_wait", us)


@dataclass(slots=True)
class _Slot:
    """The acknowledgement last seen for one direction, how often it came again, and where."""

    ack: int | None = None
    again: int = 0
    num: int = 0
    us: int = 0


@dataclass(slots=True)
class _Side:
    seen: dict = field(default_factory=dict)
    top: tuple | None = None
    expected: int | None = None
    max_ack: int | None = None
    slot: _Slot | None = None
    known: bool = False
    end: _End | None = None


SEGMENT_EVENTS = (
    "event string, packet_num bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, tcp_seq bigint, tcp_flags int, kind string, "
    "original_num bigint, delay_us bigint, spurious boolean, confidence string, dup_acks bigint, last_ack bigint, last_ack_num bigint, expected bigint"
)


class Segments(Step):
    """Retransmissions, duplicate ACKs, segments out of order and zero windows of one connection (rows of SEGMENT_EVENTS).

    A segment is a retransmission if the same (number, length) was sent before, if the
    other side has acknowledged all of it (spurious), or if it is what three duplicate ACKs
    ask for. Both directions write the slot that duplicate ACKs are counted in, so the last
    writer counts. Before a packet is looked at, the state of both directions starts anew if
    its sender's end is over by Timers or a reset, or if it is a SYN with another number.
    """

    def __init__(self, timers: Timers, rto_us: int = 200_000, fast_us: int = 50_000, syn_rto_us: int = 500_000) -> None:
        self.timers, self.rto, self.fast, self.syn_rto = timers, rto_us, fast_us, syn_rto_us
        self.sides: dict[tuple, _Side] = {}

    def _restart(self, a: _Side, b: _Side) -> None:
        for side in (a, b):
            side.seen, side.top, side.expected, side.max_ack, side.known, side.end = {}, None, None, None, False, None
        b.slot = None

    def _kind(self, syn: bool, delay: int) -> str:
        if syn:
            return "RTO" if delay >= self.syn_rto else "Retransmission"
        return "RTO" if delay >= self.rto else "Fast Retransmission" if delay <= self.fast else "Retransmission"

    def feed(self, row: tuple) -> Iterator[tuple]:
        num, us, sip, sport, dip, dport, seq, ack, flags, win, size = row
        syn, fin, acks = bool(flags & SYN), bool(flags & FIN), bool(flags & ACK)
        a, b = self.sides.setdefault((sip, sport), _Side()), self.sides.setdefault((dip, dport), _Side())
        for side in (a, b):
            if not side.known:
                side.slot, side.known = _Slot(), True
        if a.end is None or a.end.ended(us, self.timers) or (syn and a.end.isn not in (None, seq)):
            self._restart(a, b)
        a.end, b.end = a.end or _End(), b.end or _End()
        _advance(a.end, b.end, us, seq, ack if acks else 0, flags)
        if acks:
            a.max_ack = ack if a.max_ack is None else max(a.max_ack, ack)
            if ack != a.slot.ack:
                a.slot = _Slot(ack, 0, num, us)
            elif size == 0:
                a.slot.again, a.slot.num, a.slot.us = a.slot.again + 1, num, us
        length, packet = size + syn + fin, (num, us, sip, sport, dip, dport, seq, flags)
        if length:
            a.known = True
            first = a.seen.get((seq, size))
            dup = b.slot.again if b.slot else 0
            acked = b.max_ack is not None and seq + length <= b.max_ack
            if first or acked or (dup > 2 and seq == b.slot.ack):
                was = first or (a.top[1:] if a.top else (num, us))
                high, medium = acked, dup >= 3
                kind = "Spurious Retransmission" if high else "Fast Retransmission" if medium else self._kind(syn, us - was[1])
                slot = b.slot or _Slot()
                heard = (slot.ack, slot.num) if slot.ack is not None else (None, None)
                yield ("retransmission", *packet, kind, was[0], us - was[1], acked and not first, "high" if high else "medium" if medium else "low", dup, *heard, seq + length)
            a.seen.setdefault((seq, size), (num, us))
        if a.top is None or seq + length > a.top[0]:
            a.top = (seq + length, num, us)
        blank = (None, None, None, None, None)
        if acks:
            if b.slot is not None and ack == b.slot.ack:
                b.slot.again, b.slot.num, b.slot.us = b.slot.again + 1, num, us
                yield ("dup_ack", *packet, *blank, b.slot.again, ack, None, None)
            else:
                b.slot = _Slot(ack, 0, num, us)
        if length:
            if a.expected is not None and seq < a.expected:
                yield ("out_of_order", *packet, *blank, None, None, None, a.expected)
            else:
                a.expected = seq + length
        if win == 0:
            yield ("zero_window", *packet, *blank, None, None, None, None)

    def free_at(self) -> int:
        """Once both ends have been idle, the next packet starts anew (but for the count of duplicate ACKs its sender saw)."""
        last = [s.end.last_us for s in self.sides.values() if s.end is not None and s.end.last_us is not None]
        return max(last) + self.timers.idle if last else 0


TIMELINES = "src_ip string, src_port int, dst_ip string, dst_port int, part string, packets string"


class Timelines(Segments):
    """The packets that open and end troubled flows, as rows of TIMELINES; packets are numbers in order of time, joined by commas.

    Up to `most` packets of either direction are kept since its state started anew, and its
    first SYN. With a flow's first retransmission its opening is told: of each direction the
    SYN and what is kept, the first `most` of both together. With its first FIN or RST after
    that its end: the last `most` kept of both together.
    """

    def __init__(self, timers: Timers, most: int = 10) -> None:
        super().__init__(timers)
        self.most, self.kept, self.syn, self.troubled, self.ended, self.ends = most, {}, {}, set(), set(), ()

    def _restart(self, a: _Side, b: _Side) -> None:
        super()._restart(a, b)
        for end in self.ends:
            self.kept.pop(end, None)
            self.syn.pop(end, None)

    def _opening(self, end: tuple) -> list[tuple]:
        first = [self.syn[end]] if end in self.syn else []
        return sorted([*first, *(x for x in self.kept.get(end, ()) if x not in first)], key=lambda x: x[0])[: self.most]

    def feed(self, row: tuple) -> Iterator[tuple]:
        num, us, sip, sport, dip, dport, _, _, flags, _, _ = row
        own, other = self.ends = (sip, sport), (dip, dport)
        self.kept.setdefault(own, deque(maxlen=self.most)).append((us, num))
        again = any(e[0] == "retransmission" for e in super().feed(row))
        if flags & SYN:
            self.syn.setdefault(own, (us, num))
        flow = (sip, sport, dip, dport)
        told = lambda part, rows: (*flow, part, ",".join(str(n) for _, n in rows))
        if again and flow not in self.troubled:
            self.troubled.add(flow)
            yield told("opening", sorted(self._opening(own) + self._opening(other), key=lambda x: x[0])[: self.most])
        if flags & (FIN | RST) and flow in self.troubled and flow not in self.ended:
            self.ended.add(flow)
            yield told("end", sorted([*self.kept.get(own, ()), *self.kept.get(other, ())], key=lambda x: x[0])[-self.most :])


class Lookups(Step):
    """(client, server, id, qname, query_us, response_us, rcode) of the lookups of one client, client port, server and id.

    Rows are (packet_num, ts_us, client, server, id, qr, rcode, qname). A response takes the
    open query. A query that repeats it within timeout_us takes its place; a later one uses
    the id again, and the open one has no response.
    """

    def __init__(self, timeout_us: int) -> None:
        self.timeout = timeout_us
        self.open: tuple | None = None

    def feed(self, row: tuple) -> Iterator[tuple]:
        _, us, client, server, ident, qr, rcode, qname = row
        if qr == 0:
            if self.open and (us is None or us - self.open[-1] >= self.timeout):
                yield from self.close()
            self.open = (client, server, ident, qname, us)
        elif self.open:
            yield (*self.open, us, rcode)
            self.open = None

    def close(self) -> Iterator[tuple]:
        if self.open:
            yield (*self.open, None, None)

    def free_at(self) -> int | None:
        return None if self.open else 0


class RapidMoves(Step):
    """(src_ip, start_us, targets): the first window [t, t + window_us] of a source that holds `least` targets.

    Rows are (packet_num, ts_us, src_ip, dst_ip). A row within apart_us of the last one that
    counted for its target doesn't count. A window is judged once it has passed; the rows of
    one window are held, and after the report nothing.
    """

    def __init__(self, least: int, window_us: int, apart_us: int) -> None:
        self.least, self.window, self.apart = least, window_us, apart_us
        self.rows: deque = deque()
        self.counted: dict[str, int] = {}
        self.done = False

    def feed(self, row: tuple) -> Iterator[tuple]:
        _, us, src, dst = row
        if self.done:
            return
        yield from self._pass(src, us)
        while self.counted and us - self.counted[next(iter(self.counted))] > self.apart:  # oldest first
            del self.counted[next(iter(self.counted))]
        if not self.done and dst not in self.counted:
            self.counted[dst] = us
            self.rows.append((us, src, dst))

    def _pass(self, src: str, us: int | None) -> Iterator[tuple]:
        """Judge the windows that end before us (None: all)."""
        while self.rows and (us is None or self.rows[0][0] + self.window < us):
            start = self.rows[0][0]
            targets = {d for t, _, d in self.rows if t <= start + self.window}
            if len(targets) >= self.least:
                yield src, start, len(targets)
                self.done = True
                self.rows.clear()
                self.counted.clear()
                return
            self.rows.popleft()

    def close(self) -> Iterator[tuple]:
        if self.rows:
            yield from self._pass(self.rows[0][1], None)

    def passed(self, us: int) -> Iterator[tuple]:
        if self.rows:
            yield from self._pass(self.rows[0][1], us)

    def wake_at(self) -> int | None:
        return self.rows[0][0] + self.window + 1 if self.rows else None
