"""Column functions over packets: flags, addresses, flow keys, entropy, piecewise lines, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK = 0x01, 0x02, 0x04, 0x08, 0x10
#: Order in which flag names are written.
FLAG_NAMES = (("SYN", SYN), ("FIN", FIN), ("RST", RST), ("PSH", PSH), ("ACK", ACK))


def has(flag: int) -> Column:
    return F.coalesce(F.col("tcp_flags").bitwiseAND(flag) != 0, F.lit(False))


def is_tcp() -> Column:
    return F.col("protocol") == "TCP"


def syn_only() -> Column:
    return has(SYN) & ~has(ACK)


def syn_ack() -> Column:
    return has(SYN) & has(ACK)


def ack_only() -> Column:
    return has(ACK) & ~has(SYN)


def flag_names(flags: Column) -> Column:
    named = F.concat_ws(",", *[F.when(flags.bitwiseAND(bit) != 0, name) for name, bit in FLAG_NAMES])
    return F.when(named == "", "NONE").otherwise(named)


def logical_length() -> Column:
    """Sequence numbers that a segment takes: payload, SYN and FIN."""
    return F.col("tcp_payload_len") + has(SYN).cast("int") + has(FIN).cast("int")


def is_localhost(ip: Column) -> Column:
    return ip.startswith("127.") | ip.isin("::1", "::ffff:127.0.0.1")


def is_internal(ip: Column) -> Column:
    return ip.startswith("10.") | ip.startswith("192.168.") | ip.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\.")


def is_private(ip: Column) -> Column:
    low = F.lower(ip)
    return is_internal(ip) | ip.startswith("127.") | low.rlike("^f[cd]") | low.startswith("fe80:")


def ip_num(ip: Column) -> Column:
    """A dotted quad as a number, null for anything else."""
    quad = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("bigint"))
    return F.when(
        ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.aggregate(quad, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    )


def end_a() -> Column:
    """The smaller end of a conversation, by address text and port."""
    return F.least(F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")))


def end_b() -> Column:
    return F.greatest(F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")))


def with_ends(df: DataFrame) -> DataFrame:
    """df plus ip_a, port_a, ip_b, port_b."""
    return df.withColumn("__a", end_a()).withColumn("__b", end_b()).select(
        *df.columns, F.col("__a.ip").alias("ip_a"), F.col("__a.port").alias("port_a"), F.col("__b.ip").alias("ip_b"), F.col("__b.port").alias("port_b")
    )


FLOW = ("src_ip", "src_port", "dst_ip", "dst_port")
ENDS = ("ip_a", "port_a", "ip_b", "port_b")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the lower-cased characters of text; 0 for an empty text."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    n = F.length(text).cast("double")
    term = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    each = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: -term(c) * F.log2(term(c)))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def piecewise(x: Column, segments: Sequence[tuple[float, float, float, float]], beyond: Column | float) -> Column:
    """Lines (x0, y0, x1, y1), each valid up to its x1; `beyond` after the last.

    Segments may start where the previous one does not end: jumps are kept.
    """
    out = None
    for x0, y0, x1, y1 in segments:
        y = F.lit(float(y0)) + (x - float(x0)) * ((y1 - y0) / (x1 - x0))
        out = F.when(x <= x1, y) if out is None else out.when(x <= x1, y)
    return out.otherwise(beyond if isinstance(beyond, Column) else F.lit(float(beyond)))


def ladder(x: Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """The label of the first bound that x reaches, in the order given."""
    out = None
    for bound, label in steps:
        out = F.when(x >= bound, label) if out is None else out.when(x >= bound, label)
    return out.otherwise(default)


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """df with __n (rows of the group) and __r (rank by value, from 1); ranks come from a window, which spills, and not from a collected list."""
    w = Window.partitionBy(*keys)
    return df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(value)))


def value_at(value: str, share: float) -> Column:
    """Over the rows of ranked(): the value at 0-based place int(n * share) of its group (the last if there is none)."""
    place = F.least(F.floor(F.col("__n") * share), F.col("__n") - 1) + 1
    return F.max(F.when(F.col("__r") == place, F.col(value)))


#: Fixed patterns and replacements, applied in this order.
REDACTIONS = (
    (r"\b([0-9]{1,3}\.[0-9]{1,3})\.[0-9]{1,3}\.[0-9]{1,3}\b", "$1.XXX.XXX"),
    (r"\b([0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2})[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}\b", "$1:XX:XX:XX"),
    (r"/(home|Users)/[A-Za-z0-9._-]+", "/$1/[REDACTED]"),
    (r"([Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)([ ]*[:=][ ]*)[^ \t\n]+", "$1$2[REDACTED]"),
    (r"[Bb]earer [A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"[Bb]asic [A-Za-z0-9+/]+=*", "Basic [REDACTED]"),
    (r"(postgres(ql)?|mysql|mongodb)://[^:/ \t\n]+:[^@ \t\n]+@", "$1://[REDACTED]@"),
)


def redact(text: Column) -> Column:
    """text without addresses, home folders and credentials."""
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def flow_key(both: bool = True) -> Column:
    """src_ip:src_port->dst_ip:dst_port, or with the smaller end first and <-> between them; a missing port is 0."""
    end = lambda x: F.struct(F.col(f"{x}_ip").alias("ip"), F.coalesce(F.col(f"{x}_port"), F.lit(0)).alias("port"))
    a, b = (F.least(end("src"), end("dst")), F.greatest(end("src"), end("dst"))) if both else (end("src"), end("dst"))
    text = lambda e: F.concat(e["ip"], F.lit(":"), e["port"].cast("string"))
    return F.concat(text(a), F.lit("<->" if both else "->"), text(b))


def parse_flow(text: Column) -> Column:
    """The struct (src_ip, src_port, dst_ip, dst_port) that a flow key of either form names; ports may be hexadecimal (0x1f90 or 1f90). Null for anything else.

    The last colon of an end stands before its port, so that IPv6 addresses keep theirs.
    """
    form = r"^(.+):(0[xX][0-9a-fA-F]+|[0-9a-fA-F]+)\s*(?:<->|->|\u2192)\s*(.+):(0[xX][0-9a-fA-F]+|[0-9a-fA-F]+)$"
    part = lambda i: F.regexp_extract(text, form, i)
    port = lambda s: F.coalesce(s.try_cast("int"), F.conv(F.regexp_replace(s, "^0[xX]", ""), 16, 10).try_cast("int"))
    fields = F.struct(part(1).alias("src_ip"), port(part(2)).alias("src_port"), part(3).alias("dst_ip"), port(part(4)).alias("dst_port"))
    return F.when(text.rlike(form), fields)


def exact_median(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One row: the exact median of a column of non-negative integers (null without rows).

    Values are counted, and the counts added up by their high bits; only values that share
    those with the middle are then ranked. So no task ranks more than 2^20 counts, however
    many rows. Both steps read the same counts, so df is read once.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("c"))
    high = F.shiftright("v", 20)
    w = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    c = d.groupBy(high.alias("h")).agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    has = lambda place: (F.col("upto") - F.col("c") < place) & (place <= F.col("upto"))
    c = c.where(has(lower) | has(upper)).select("h", (F.col("upto") - F.col("c")).alias("before"), lower.alias("lower"), upper.alias("upper"))  # at most two rows
    v = d.withColumn("h", high).join(F.broadcast(c), "h")
    v = v.withColumn("at", F.col("before") + F.sum("c").over(Window.partitionBy("h").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda place: F.min(F.when(F.col("at") >= F.col(place), F.col("v")))
    return v.agg(((pick("lower") + pick("upper")) / 2.0).alias(name))
