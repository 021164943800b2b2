"""Capture files read by byte ranges: a Python data source that Spark plans and runs like any other.

A file is cut into ranges of `block` bytes; a record belongs to the range it starts in. A
task finds the first record of its range by the first place from which RUN plausible
record headers follow each other, reads on from there a piece at a time, and stops at the
first record that starts in the next range. Whether ranges meet is checked: each task says
where it began and where it ended, and `read_ranges` compares the ends with the beginnings.
Paths are opened through Arrow's file systems (local or mounted folders, HDFS, object stores).

Bad files don't end the job: an empty or too small file, one of unknown kind, or one cut
short gives a row in `capture_problems` and the packets before the fault.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import DEEP_DDL
from . import pcap

BLOCK = 64 << 20
#: Bytes that a task reads at a time; with one record more, all of a file that it holds.
PIECE = 4 << 20
#: Headers that must follow each other for a place to count as the start of a record.
RUN = 4
#: A pcap file's header, and the largest record that is believed.
HEADER, LARGEST = 24, 1 << 20
#: How far a record's time may lie from the first one's, in seconds, for its header to be plausible.
SPAN_S = 10 * 366 * 86400
NG = b"\x0a\x0d\x0d\x0a"
#: Block types of pcapng that may start a run.
NG_KINDS = (1, 2, 3, 4, 5, 6, 10, 0x0A0D0D0A)


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, name


def _files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of the files that paths name, folders opened up, by name."""
    out = []
    for path in paths:
        system, name = _open(path)
        prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
        info = system.get_file_info(name)
        found = system.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
        out += [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
    return sorted(out)


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class _Bytes:
    """A window over a file that is read forward, a piece at a time."""

    def __init__(self, path: str, at: int):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        self.base, self.data = at, b""
        self.file.seek(at)

    def need(self, at: int, n: int) -> bytes:
        """n bytes at file offset at (fewer at the end of the file); what lies before at is let go."""
        if at + n > self.base + len(self.data):
            keep = self.data[at - self.base :] if at - self.base <= len(self.data) else b""
            if not keep:
                self.file.seek(at)
            self.data, self.base = keep + self.file.read(max(PIECE, n - len(keep))), at
        return self.data[at - self.base : at - self.base + n]

    def close(self) -> None:
        self.file.close()


class _Pcap:
    """Records of a pcap file."""

    def __init__(self, head: bytes, first: bytes):
        self.order, self.per_us = pcap.MAGICS[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0] & 0xFFFF
        snap = struct.unpack_from(self.order + "I", head, 16)[0]
        self.most = min(max(snap, 65535), LARGEST)
        self.zero = struct.unpack_from(self.order + "I", first)[0] if len(first) >= 4 else 0
        self.begin, self.step = HEADER, 1

    def size(self, b: bytes) -> int | None:
        """Bytes of the record whose header starts b, if the header is plausible."""
        if len(b) < 16:
            return None
        s, f, n, whole = struct.unpack_from(self.order + "4I", b)
        fits = f < 1_000_000 * self.per_us and n <= self.most and n <= whole <= self.most * 4 and abs(s - self.zero) <= SPAN_S
        return 16 + n if fits else None

    head_bytes = 16

    def frame(self, b: bytes) -> tuple[int, int, bytes] | None:
        s, f = struct.unpack_from(self.order + "2I", b)
        return s * 1_000_000 + f // self.per_us, self.link, b[16:]


class _PcapNg:
    """Blocks of a pcapng file; interfaces are those described before the first packet."""

    def __init__(self, head: bytes):
        self.order, self.links = "<", []
        self.begin, self.step = 0, 4
        at = 0
        while at + 12 <= len(head):
            n = self.size(head[at : at + 12])
            kind = struct.unpack_from(self.order + "I", head, at)[0]
            if n is None or kind in (2, 3, 6) or at + n > len(head):
                break
            self._describe(head[at : at + n])
            at += n

    head_bytes = 12

    def _describe(self, b: bytes) -> None:
        if b[:4] == NG:
            self.order, self.links = ("<" if b[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        elif struct.unpack_from(self.order + "I", b)[0] == 1:
            self.links.append((struct.unpack_from(self.order + "H", b, 8)[0], pcap._ticks(self.order, b[16:-4])))

    def size(self, b: bytes) -> int | None:
        if len(b) < 12:
            return None
        order = ("<" if b[8:12] == b"\x4d\x3c\x2b\x1a" else ">") if b[:4] == NG else self.order
        kind, n = struct.unpack_from(order + "2I", b)
        return n if kind in NG_KINDS and n % 4 == 0 and 12 <= n <= LARGEST else None

    def ends(self, b: bytes) -> bool:
        """Whether a block's length stands at its end, too."""
        return b[4:8] == b[-4:]

    def frame(self, b: bytes) -> tuple[int, int, bytes] | None:
        kind = struct.unpack_from(self.order + "I", b)[0]
        if b[:4] == NG or kind == 1:
            self._describe(b)
        elif kind == 6 and len(b) >= 32:
            i, high, low, n, _ = struct.unpack_from(self.order + "5I", b, 8)
            if i >= len(self.links):
                raise ValueError(f"interface {i} isn't described before this range")
            link, ticks = self.links[i]
            return (high << 32 | low) * 1_000_000 // ticks, link, b[28 : 28 + n]
        elif kind == 3 and self.links:
            return 0, self.links[0][0], b[12 : 12 + struct.unpack_from(self.order + "I", b, 8)[0]]
        return None


def _format(path: str, size: int) -> _Pcap | _PcapNg | str:
    """How to read a file, or what is wrong with it."""
    if size < HEADER:
        return "too small" if size else "empty"
    f = _Bytes(path, 0)
    try:
        head = f.need(0, 1 << 16)
        if head[:4] in pcap.MAGICS:
            return _Pcap(head, head[HEADER : HEADER + 16])
        return _PcapNg(head) if head[:4] == NG else "neither pcap nor pcapng"
    finally:
        f.close()


def _starts_here(form: _Pcap | _PcapNg, f: _Bytes, at: int, size: int) -> bool:
    """Whether RUN records, or all up to the end of the file, follow each other from here; after a whole one, the last may be cut short."""
    for i in range(RUN):
        if at == size or (i > 1 and size - at < form.head_bytes):
            return True
        n = form.size(f.need(at, form.head_bytes))
        if i and n is not None and at + n > size:
            return True
        if n is None or at + n > size or (isinstance(form, _PcapNg) and not form.ends(f.need(at, n))):
            return False
        at += n
    return True


def first_record(form: _Pcap | _PcapNg, path: str, start: int, size: int) -> int:
    """The first record that starts at or after `start`; the size of the file if there is none."""
    at = max(start, form.begin)
    at += -at % form.step
    if at == form.begin:
        return at
    near, look = _Bytes(path, at), None
    try:
        while at < size:
            if form.size(near.need(at, form.head_bytes)) is not None:
                look = look or _Bytes(path, at)
                if _starts_here(form, look, at, size):
                    return at
                look = look.close()  # it has moved on; the next candidate lies before that
            at += form.step
        return size
    finally:
        near.close()
        if look:
            look.close()


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.block, self.bare = int(options.get("block", BLOCK)), options.get("decode", "true") == "false"
        self.columns = columns

    def partitions(self) -> list[Range]:
        return [Range(p, n, a, min(a + self.block, n)) for p, n in _files(self.paths) for a in range(0, max(n, 1), self.block)]

    def read(self, part: Range) -> Iterator[tuple]:
        """Records of the range, then a row of kind `range` (where it began and ended, what was wrong with it)."""
        k, problem, first, at, place = part.start // self.block, None, part.start, part.start, 0
        form = _format(part.path, part.size)
        blank = (None,) * len(self.columns)
        if isinstance(form, str):
            yield (part.path, k, 0, "range", part.start, part.end, form if part.start == 0 else None, 0, *blank)
            return
        first = at = first_record(form, part.path, part.start, part.size)
        f = _Bytes(part.path, at)
        stored = 0
        try:
            while at < part.end:
                n = form.size(f.need(at, form.head_bytes))
                if n is None or at + n > part.size:
                    problem, at = ("cut short" if n else "broken record") + f" at byte {at}", part.size
                    break
                b = f.need(at, n)
                try:
                    got = form.frame(b)
                except ValueError as e:
                    problem = problem or str(e)
                    got = None
                at += n
                if got is None:
                    continue
                place += 1
                stored += len(got[2])
                if self.bare:
                    continue
                row = pcap.decode(got[1], got[2])
                if row is not None:
                    row["ts_us"] = got[0]
                    yield (part.path, k, place, "packet", None, None, None, None, *[row[c] for c in self.columns])
        finally:
            f.close()
        yield (part.path, k, place, "range", first, at, problem, stored, *blank)


FIXED = "file string, range bigint, place bigint, kind string, first_byte bigint, next_byte bigint, problem string, stored bigint"
_PACKET = pcap.COLUMNS.split(", ")[2:]


class CaptureSource(DataSource):
    """Format `capture_ranges`; options: paths (one a line), block (bytes), deep, decode (false: only what each range holds)."""

    @classmethod
    def name(cls) -> str:
        return "capture_ranges"

    def schema(self) -> str:
        deep = f", {DEEP_DDL}" if self.options.get("deep", "false") == "true" else ""
        return f"{FIXED}, {', '.join(_PACKET)}{deep}"

    def reader(self, schema: object) -> CaptureReader:
        return CaptureReader(self.options, schema.fieldNames()[8:])


def _load(spark: SparkSession, paths: list[str], block: int, deep: bool, decode: bool) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    options = {"paths": "\n".join(paths), "block": str(block), "deep": str(deep).lower(), "decode": str(decode).lower()}
    return spark.read.format("capture_ranges").options(**options).load()


def range_table(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> DataFrame:
    """file, range, frames, first_byte, next_byte, problem, stored (bytes of its frames), met (the next range begins where it ended).

    Headers are read and no frame is decoded.
    """
    paths = [path] if isinstance(path, str) else list(path)
    r = _load(spark, paths, block, False, False).where("kind = 'range'")
    w = Window.partitionBy("file").orderBy("range")
    # a range without a record of its own begins and ends where the next one begins
    after, size = F.lead("first_byte").over(w), F.max("next_byte").over(Window.partitionBy("file"))
    # nothing was found up to the end of the file, though a record was to begin before it
    cut = F.when((after == size) & (F.col("next_byte") < size), F.concat(F.lit("cut short at byte "), F.col("next_byte").cast("string")))
    r = r.select("file", "range", F.col("place").alias("frames"), "first_byte", "next_byte", F.coalesce("problem", cut).alias("problem"), "stored", after.alias("after"))
    return r.withColumn("met", F.col("after").isNull() | (F.col("after") == F.col("next_byte")) | F.col("problem").isNotNull()).drop("after")


def capture_problems(ranges: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """file, problem of the files that are empty, of unknown kind, cut short, larger than most_bytes, or whose ranges don't meet (read those with one range)."""
    apart = F.when(~F.col("met"), F.concat(F.lit("ranges don't meet at byte "), F.col("next_byte").cast("string")))
    large = F.when(F.col("next_byte") > most_bytes, "too large") if most_bytes else F.lit(None).cast("string")
    p = F.coalesce("problem", apart, large)
    return ranges.where(p.isNotNull()).groupBy("file").agg(F.min_by(p, "range").alias("problem"))


def expansion(ranges: DataFrame, warn: float = 1000.0, most: float = 10_000.0) -> DataFrame:
    """file, stored (bytes of its frames), bytes (of the file), their ratio, and level: ok, warning or excessive (as in a crafted archive)."""
    g = ranges.groupBy("file").agg(F.sum("stored").alias("stored"), F.max("next_byte").alias("bytes"))
    ratio = F.when(F.col("bytes") > 0, F.col("stored") / F.col("bytes").cast("double")).otherwise(0.0)
    level = F.when(ratio >= most, "excessive").when(ratio >= warn, "warning").otherwise("ok")
    return g.select("file", "stored", "bytes", ratio.alias("ratio"), level.alias("level"))


def read_ranges(spark: SparkSession, path: str | list[str], block: int = BLOCK, deep: bool = False, seen: Observation | None = None) -> DataFrame:
    """Packets of capture files in the schema of pcap.read_capture, numbered from 1 within their file whatever the ranges.

    A first pass over the headers says how many frames each range holds; the second
    decodes. `seen` counts packets and their bytes as they pass.
    """
    paths = [path] if isinstance(path, str) else list(path)
    w = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = range_table(spark, paths, block).select("file", "range", F.coalesce(F.sum("frames").over(w), F.lit(0)).alias("before"))
    p = _load(spark, paths, block, deep, True).where("kind = 'packet'").join(base, ["file", "range"])
    names = [c.split()[0] for c in _PACKET] + (["dns", "frag", "sack", "icmp"] if deep else [])
    p = p.select("file", (F.col("before") + F.col("place")).alias("packet_num"), *names)
    return p if seen is None else p.observe(seen, F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"))
