"""Capture files (pcap and pcapng) as packet rows.

Files are read by Spark's binaryFile source, so any file system that Spark knows will do,
and decoded in tasks, one file at a time. Frames are numbered from 1 within their file;
frames that are not IP keep their number and give no row.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import DEEP_DDL

COLUMNS = (
    "file string, packet_num bigint, ts_us bigint, src_ip string, dst_ip string, ip_version tinyint, ttl smallint, total_length int, packet_length int, protocol string, "
    "src_port int, dst_port int, tcp_seq bigint, tcp_ack bigint, tcp_flags int, tcp_window int, tcp_payload_len int, udp_length int, icmp_type smallint, icmp_code smallint"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Link types: bytes before the network header and where its EtherType stands (None: no EtherType).
ETHERNET, RAW, SLL, SLL2, NULL, IPV4, IPV6 = 1, (12, 101), 113, 276, 0, 228, 229
VLAN = (0x8100, 0x88A8)
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(time in microseconds, link type, frame bytes); ends quietly where the file is cut off."""
    if data[:4] in MAGICS:
        order, per_us = MAGICS[data[:4]]
        link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF if len(data) >= 24 else 0
        at = 24
        while at + 16 <= len(data):
            s, f, size, _ = struct.unpack_from(order + "4I", data, at)
            if at + 16 + size > len(data):
                return
            yield s * 1_000_000 + f // per_us, link, data[at + 16 : at + 16 + size]
            at += 16 + size
    elif data[:4] == b"\x0a\x0d\x0d\x0a":
        yield from _blocks(data)
    else:
        raise ValueError("neither a pcap nor a pcapng file")


def _blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    order, links, at = "<", [], 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, links = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "2I", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            links.append((struct.unpack_from(order + "H", body)[0], _ticks(order, body[8:])))
        elif kind == 6 and len(body) >= 20:
            i, high, low, n, _ = struct.unpack_from(order + "5I", body)
            if i < len(links):
                yield ((high << 32 | low) * 1_000_000) // links[i][1], links[i][0], body[20 : 20 + n]
        elif kind == 3 and links:
            yield 0, links[0][0], body[4 : 4 + struct.unpack_from(order + "I", body)[0]]
        at += size


def _ticks(order: str, options: bytes) -> int:
    """Ticks per second of an interface (option 9; microseconds if absent)."""
    at = 0
    while at + 4 <= len(options):
        code, n = struct.unpack_from(order + "2H", options, at)
        if code == 9 and n:
            r = options[at + 4]
            return 2 ** (r & 127) if r & 128 else 10**r
        if code == 0:
            break
        at += 4 + (n + 3) // 4 * 4
    return 1_000_000


def network(link: int, b: bytes) -> bytes:
    """The network layer of a frame; empty if it is not IP."""
    if link == ETHERNET:
        at = 12
        while b[at : at + 2] and int.from_bytes(b[at : at + 2], "big") in VLAN:
            at += 4
        return b[at + 2 :] if int.from_bytes(b[at : at + 2], "big") in (0x0800, 0x86DD) else b""
    if link == SLL:
        return b[16:]
    if link == SLL2:
        return b[20:]
    if link == NULL:
        return b[4:]
    if link in RAW or link in (IPV4, IPV6):
        return b
    return network(ETHERNET, b) or network(SLL, b)


def _name(msg: bytes, at: int) -> tuple[str, int]:
    """A DNS name and where it ends; compression pointers are followed a bounded number of times."""
    labels, end, hops = [], None, 0
    while at < len(msg) and hops < 20:
        n = msg[at]
        if n & 0xC0 == 0xC0 and at + 1 < len(msg):
            end = at + 2 if end is None else end
            at, hops = (n & 0x3F) << 8 | msg[at + 1], hops + 1
        elif n == 0:
            return ".".join(labels) + ".", at + 1 if end is None else end
        else:
            labels.append(msg[at + 1 : at + 1 + n].decode("latin-1"))
            at += n + 1
    return ".".join(labels) + ".", at if end is None else end


def dns_of(msg: bytes) -> dict | None:
    if len(msg) < 12:
        return None
    ident, flags, questions, answers = struct.unpack_from(">4H", msg)
    name, kind = None, None
    if questions:
        name, at = _name(msg, 12)
        kind = int.from_bytes(msg[at : at + 2], "big") if at + 2 <= len(msg) else None
    return {"id": ident, "qr": flags >> 15, "rcode": flags & 15, "qname": name, "qtype": kind, "n_answers": answers}


def sack_of(options: bytes) -> list[dict] | None:
    at = 0
    while at < len(options) and options[at] != 0:
        if options[at] == 1:
            at += 1
            continue
        if at + 1 >= len(options) or options[at + 1] < 2:
            return None
        kind, n = options[at], options[at + 1]
        if kind == 5:
            edges = [int.from_bytes(options[i : i + 4], "big") for i in range(at + 2, min(at + n, len(options) - 3), 4)]
            return [{"left": a, "right": b} for a, b in zip(edges[::2], edges[1::2])]
        at += n
    return None


def decode(link: int, frame: bytes) -> dict | None:
    """One frame's columns, or None if it is not IP or is cut short."""
    b = network(link, frame)
    if len(b) < 20:
        return None
    out: dict = dict.fromkeys(NAMES[3:]) | {"packet_length": len(frame), "tcp_payload_len": 0, "dns": None, "frag": None, "sack": None, "icmp": None}
    if b[0] >> 4 == 4:
        head, total = (b[0] & 15) * 4, int.from_bytes(b[2:4], "big")
        proto, offset = b[9], int.from_bytes(b[6:8], "big")
        out |= {"ip_version": 4, "ttl": b[8], "total_length": total, "src_ip": str(ipaddress.IPv4Address(b[12:16])), "dst_ip": str(ipaddress.IPv4Address(b[16:20]))}
        size = max(0, total - head) if total else len(b) - head
        out["frag"] = {"ip_id": int.from_bytes(b[4:6], "big"), "df": bool(offset & 0x4000), "mf": bool(offset & 0x2000), "offset_bytes": (offset & 0x1FFF) * 8, "payload_bytes": size, "proto": proto}
        if offset & 0x1FFF:  # a later fragment has no transport header
            return out | {"protocol": "Other"}
    elif b[0] >> 4 == 6 and len(b) >= 40:
        head, proto, size = 40, b[6], int.from_bytes(b[4:6], "big")
        out |= {"ip_version": 6, "ttl": b[7], "total_length": size + 40, "src_ip": str(ipaddress.IPv6Address(b[8:24])), "dst_ip": str(ipaddress.IPv6Address(b[24:40]))}
    else:
        return None
    t = b[head : head + size]
    out["protocol"] = "Other"
    if proto == 6 and len(t) >= 20:
        sp, dp, seq, ack, off, flags, win = struct.unpack_from(">HHIIBBH", t)
        start = (off >> 4) * 4
        out |= {"protocol": "TCP", "src_port": sp, "dst_port": dp, "tcp_seq": seq, "tcp_ack": ack, "tcp_flags": flags, "tcp_window": win, "tcp_payload_len": max(0, size - start), "sack": sack_of(t[20:start])}
    elif proto == 17 and len(t) >= 8:
        sp, dp, n = struct.unpack_from(">3H", t)
        out |= {"protocol": "UDP", "src_port": sp, "dst_port": dp, "udp_length": n, "tcp_payload_len": max(0, n - 8)}
        if 53 in (sp, dp):
            out["dns"] = dns_of(t[8:])
    elif proto == 1 and len(t) >= 4:
        out |= {"protocol": "ICMP", "icmp_type": t[0], "icmp_code": t[1]}
        inner = t[8:]
        if t[0] in (3, 4, 5, 11, 12) and len(inner) >= 20:
            out["icmp"] = {"mtu": int.from_bytes(t[6:8], "big") if (t[0], t[1]) == (3, 4) else None, "orig_src": str(ipaddress.IPv4Address(inner[12:16])), "orig_dst": str(ipaddress.IPv4Address(inner[16:20]))}
    return out


def _rows(files: Iterator[pd.DataFrame], deep: bool) -> Iterator[pd.DataFrame]:
    names = NAMES + (["dns", "frag", "sack", "icmp"] if deep else [])
    for pdf in files:
        for path, content in zip(pdf["path"], pdf["content"]):
            out = []
            for i, (us, link, frame) in enumerate(frames(bytes(content)), 1):
                row = decode(link, frame)
                if row is not None:
                    out.append([path, i, us, *[row[n] for n in names[3:]]])
                if len(out) == 20_000:
                    yield _frame(out, names)
                    out = []
            yield _frame(out, names)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("src_port", "dst_port", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "udp_length", "icmp_type", "icmp_code"):
        df[c] = df[c].astype("Int64")
    return df


def read_capture(spark: SparkSession, path: str | list[str], deep: bool = False) -> DataFrame:
    """Packets of one or more capture files or folders; deep adds DNS, fragment, SACK and ICMP structs."""
    schema = COLUMNS + (", " + DEEP_DDL if deep else "")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lambda it: _rows(it, deep), schema)
