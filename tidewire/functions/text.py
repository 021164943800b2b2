"""Values as people read them: durations, intervals, severities, times, and text without personal data by level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cols import REDACTIONS, redact

#: What a QoS class is called.
CLASS_NAMES = ("excellent", "good", "warning", "poor", "critical", "emergency")
#: Intervals that say what may keep them, in seconds.
KNOWN_INTERVALS = {1: "1 second (heartbeat?)", 5: "5 seconds (fast polling?)", 10: "10 seconds", 30: "30 seconds (health check?)", 60: "1 minute (cron?)", 300: "5 minutes (monitoring?)"}


def duration_text(us: Column) -> Column:
    """12.3ms, 4.56s, 7m 8.9s or 3h 25m."""
    s = us / 1_000_000.0
    whole = lambda unit: F.floor(s / unit).cast("int")
    return (
        F.when(s < 1, F.format_string("%.1fms", s * 1000)).when(s < 60, F.format_string("%.2fs", s))
        .when(s < 3600, F.format_string("%dm %.1fs", whole(60), s % 60)).otherwise(F.format_string("%dh %dm", whole(3600), F.floor(s % 3600 / 60).cast("int")))
    )


def interval_text(us: Column) -> Column:
    """An interval in words, with what commonly keeps it."""
    s, out = us / 1_000_000.0, F.when(us < 1_000_000, F.format_string("%.0fms", us / 1000.0))
    for known, text in KNOWN_INTERVALS.items():
        out = out.when(us == known * 1_000_000, text)
    return out.when(s < 60, F.format_string("%.0f seconds", s)).otherwise(F.format_string("%.1f minutes", s / 60))


def class_name(qos: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CLASS_NAMES)), qos), F.lit("unknown"))


def iso_time(us: Column) -> Column:
    """2024-01-31 12:34:56.789 of microseconds, in the session's time zone."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSS")


#: Fixed patterns: what may stand before and after an IPv6 address, and its groups.
_G = "[0-9a-fA-F]{1,4}"
_AFTER = r"(?=\s|$|[^0-9a-fA-F:\[])"
_BEFORE = r"(?<![0-9a-fA-F:])"
#: An address is cut after its second group, or after its only one before the double colon; one without any goes whole.
_IPV6 = (
    (rf"{_BEFORE}({_G}:{_G})(?::{_G}){{6}}{_AFTER}", "$1::[REDACTED]"),
    (rf"{_BEFORE}({_G}:{_G})(?::{_G}){{0,5}}::(?:{_G}(?::{_G}){{0,5}})?{_AFTER}", "$1::[REDACTED]"),
    (rf"{_BEFORE}({_G})::(?:{_G}(?::{_G}){{0,5}})?{_AFTER}", "$1::[REDACTED]"),
    (rf"{_BEFORE}::(?:{_G}(?::{_G}){{0,6}})?{_AFTER}", "[IP_REDACTED]"),
)


def redact_ipv6(text: Column) -> Column:
    for pattern, to in _IPV6:
        text = F.regexp_replace(text, pattern, to)
    return text


def redact_for(text: Column, level: str = "production") -> Column:
    """text for a log: production leaves no address, MAC, home folder or credential; development leaves IP addresses; debug leaves all."""
    match level.lower():
        case "debug":
            return text
        case "development":
            for pattern, to in REDACTIONS[1:]:  # all but the first, which is for IPv4
                text = F.regexp_replace(text, pattern, to)
            return text
        case "production":
            return redact(redact_ipv6(text))
    raise ValueError(f"unknown level {level!r}")
