"""DNS, ICMP, fragments and selective acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import ENDS, FLOW, entropy, is_localhost, with_ends

#: ICMP type names, and code names of type 3.
ICMP_TYPES = {0: "Echo Reply", 3: "Destination Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo Request", 11: "Time Exceeded", 12: "Parameter Problem"}
UNREACHABLE = {
    0: "Network Unreachable", 1: "Host Unreachable", 2: "Protocol Unreachable", 3: "Port Unreachable", 4: "Fragmentation Needed and DF Set", 5: "Source Route Failed",
    6: "Network Unknown", 7: "Host Unknown", 13: "Communication Administratively Prohibited",
}
#: Domains whose names are no sign of a tunnel, with all below them.
WHITELIST = (
    "google.com", "googleapis.com", "gstatic.com", "microsoft.com", "windows.com", "office.com", "apple.com", "icloud.com", "amazon.com", "facebook.com",
    "mozilla.org", "firefox.com", "ubuntu.com", "debian.org", "fedoraproject.org", "cluster.local", "svc.cluster.local", "pod.cluster.local",
    "amazonaws.com", "cloudfront.net", "awsstatic.com", "azure.com", "azurewebsites.net", "cloudapp.net", "trafficmanager.net", "visualstudio.com",
    "azurefd.net", "azureedge.net", "office365.com", "sharepoint.com", "onmicrosoft.com", "microsoftonline.com", "googleusercontent.com", "appspot.com",
    "cloudflare.com", "cloudflare.net", "akamai.net", "akamaized.net", "akamaiedge.net", "fastly.net", "fastlylb.net", "edgecastcdn.net", "cdn77.org",
    "digitalocean.com", "linode.com", "vultr.com", "heroku.com", "herokuapp.com", "slack.com", "salesforce.com", "atlassian.net", "zendesk.com",
    "shopify.com", "stripe.com", "twilio.com", "sendgrid.net",
)


def _name(table: dict[int, str], c: Column, other: str) -> Column:
    """The number's name, else `other` with the number."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c.cast("int"))
    return F.coalesce(named, F.concat(F.lit(other), c.cast("string")))


def _icmp_detail(p: DataFrame, field: str, kind: str) -> Column:
    """A field of the deep ICMP column, null where a capture was read without it."""
    return F.col(f"icmp.{field}") if "icmp" in p.columns else F.lit(None).cast(kind)


def icmp_messages(p: DataFrame) -> DataFrame:
    """ICMP rows with a name and a severity."""
    t, c = F.col("icmp_type"), F.col("icmp_code")
    name = _name(ICMP_TYPES, t, "Type ")
    name = F.when(t == 3, F.concat(name, F.lit(" - "), _name(UNREACHABLE, c, "Code "))).otherwise(name)
    severity = (
        F.when((t == 3) & c.isin(0, 1, 4, 6, 7, 13), "error").when(t.isin(3, 4, 11, 12), "warning").otherwise("info")
    )
    return p.where((F.col("protocol") == "ICMP") & t.isNotNull()).withColumn("name", name).withColumn("severity", severity)


def icmp_summary(p: DataFrame) -> DataFrame:
    return icmp_messages(p).groupBy("name", "severity").agg(F.count("*").alias("packets"))


def _unreachable(p: DataFrame) -> DataFrame:
    """Unreachable messages with what couldn't be reached: the quoted packet's destination, else only who says so."""
    target = F.coalesce(_icmp_detail(p, "orig_dst", "string"), F.concat(F.lit("Unknown (from "), F.col("src_ip"), F.lit(")")))
    return icmp_messages(p).where("icmp_type = 3").withColumn("target", target)


def unreachable_targets(p: DataFrame, k: int = 10) -> DataFrame:
    """Targets by unreachable messages, with their most frequent reason (ties: by name)."""
    g = _unreachable(p).groupBy("target", "name").agg(F.count("*").alias("c"))
    g = g.groupBy("target").agg(F.sum("c").alias("messages"), F.min(F.struct((-F.col("c")).alias("c"), "name")).alias("x"))
    return g.orderBy(F.desc("messages"), "target").limit(k).select("target", "messages", F.col("x.name").alias("reason"))


def path_mtu_issues(p: DataFrame, usual: int = 1500) -> DataFrame:
    """Targets whose packets needed fragmentation but may not be: messages, and the largest MTU that any of them offers, else the usual one."""
    mtu = _icmp_detail(p, "mtu", "int")
    d = _unreachable(p).where("icmp_code = 4")
    g = d.groupBy("target").agg(F.count("*").alias("messages"), F.max(F.when(mtu > 0, mtu)).alias("mtu"))
    return g.select("target", "messages", F.coalesce("mtu", F.lit(usual)).alias("suggested_mtu"))


def base_domain(name: Column) -> Column:
    parts = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")


def subdomain(name: Column) -> Column:
    parts = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), ".")


def encodings(sub: Column, bits: Column) -> list[Column]:
    """Whether a subdomain looks abnormally long, base64, hex, a UUID, or random; longer ones are judged by their first 255 characters."""
    s, n = F.substr(sub, F.lit(1), F.lit(255)), F.least(F.length(sub), F.lit(255))
    kinds = F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")))
    return [
        F.length(sub) > 255,
        (n >= 32) & s.rlike("^[A-Za-z0-9+/=]+$") & (bits > 5),
        (n >= 32) & s.rlike("^[0-9a-fA-F]+$"),
        s.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        (n >= 40) & s.rlike("^[a-z0-9]+$") & (kinds > n * 0.6),
    ]


def dns_tunnels(q: DataFrame, length: int = 50, bits: float = 4.2, per_min: float = 10.0, least: int = 1) -> DataFrame:
    """Source and domain pairs of queries (src_ip, ts_us, qname, qtype) with two or more signs of a tunnel.

    Signs: long names, high entropy, a high rate (over a second at least), encoded labels,
    unusual record types. Severity adds up points for each of length, entropy, rate, number and encodings.
    """
    d = q.withColumn("domain", base_domain(F.col("qname"))).withColumn("sub", subdomain(F.col("qname")))
    listed = F.col("domain").rlike(r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in WHITELIST) + ")$")
    d = d.where(~listed & ~is_localhost(F.col("src_ip"))).withColumn("bits", F.round(entropy(F.col("sub")), 6))
    kinds = [F.max(k.cast("int")).alias(f"e{i}") for i, k in enumerate(encodings(F.col("sub"), F.col("bits")))]
    g = d.groupBy("src_ip", "domain").agg(
        F.count("*").alias("queries"), F.sum(F.length("qname")).alias("chars"), F.sum(F.col("bits").cast("decimal(18,6)")).alias("bits"),
        F.count_if(F.col("bits") > 0).alias("coded"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"), *kinds,
        F.count_if(F.col("qtype").isin("TXT", "NULL")).alias("unusual"),
    ).where(F.col("queries") >= least)
    n = F.col("queries")
    g = g.select(
        "src_ip", "domain", "queries", "unusual", (F.col("chars") / n.cast("double")).alias("chars"),
        F.when(F.col("coded") > 0, F.col("bits").cast("double") / F.col("coded")).otherwise(0.0).alias("bits"),
        F.when(F.col("span_us") >= 1_000_000, n * 6e7 / F.col("span_us")).otherwise(0.0).alias("rate"),
        sum((F.col(f"e{i}") for i in range(1, len(kinds))), F.col("e0")).alias("kinds"),
    )
    one = lambda c: c.cast("int")
    chars, high, rate = F.col("chars"), F.col("bits"), F.col("rate")
    signs = one(chars > length) + one(high > bits) + one(rate > per_min) + one(F.col("kinds") > 0) + one(F.col("unusual") > n * 0.3)
    points = lambda x, *steps: F.coalesce(*[F.when(x > b, k) for b, k in steps], F.lit(0))
    score = points(chars, (100, 3), (75, 2), (50, 1)) + points(high, (5.0, 3), (4.5, 2), (3.5, 1)) + points(rate, (50, 3), (30, 2), (10, 1))
    score = score + points(n, (100, 2), (50, 1)) + F.least(F.col("kinds"), F.lit(2))
    severity = F.when(score >= 9, "critical").when(score >= 6, "high").when(score >= 3, "medium").otherwise("low")
    return g.withColumn("signs", signs).where("signs >= 2").select("src_ip", "domain", "queries", "signs", score.alias("score"), severity.alias("severity"))


def repeated_queries(q: DataFrame, within_us: int = 2_000_000) -> DataFrame:
    """qname, qtype, queries, repeated: how often a name and type are asked for, and how often again within a time of the query before, by whomever."""
    w = Window.partitionBy("qname", "qtype").orderBy("ts_us")
    d = q.withColumn("again", F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) < within_us, F.lit(False)))
    return d.groupBy("qname", "qtype").agg(F.count("*").alias("queries"), F.count_if("again").alias("repeated"))


def dns_problems(tx: DataFrame, k: int = 10) -> DataFrame:
    """Domains of slow, failed and unanswered lookups with their most frequent problem.

    tx: qname, status (success, slow, timeout, error), rcode name. Missing names below cluster.local are expected.
    """
    expected = (F.col("status") == "error") & (F.col("rcode") == "NXDOMAIN") & F.col("qname").endswith(".cluster.local")
    label = F.when(F.col("status") == "timeout", "Timeout").when(F.col("status") == "slow", "Slow Response").otherwise(F.col("rcode"))
    g = tx.where((F.col("status") != "success") & ~expected).groupBy("qname", label.alias("problem")).agg(F.count("*").alias("c"))
    r = F.row_number().over(Window.partitionBy("qname").orderBy(F.desc("c"), "problem"))
    g = g.withColumn("r", r).withColumn("count", F.sum("c").over(Window.partitionBy("qname"))).where("r = 1")
    return g.orderBy(F.desc("count"), "qname").limit(k).select("qname", "count", "problem")


def reassembly(p: DataFrame) -> DataFrame:
    """Fragment groups (src, dst, id): fragments, total (the end that the last-seen final fragment sets, null without one), complete, path_mtu.

    Complete means that the fragments by offset follow each other exactly, from 0 to that
    end: a hole, an overlap or a fragment that comes twice is none.
    """
    f = p.where(F.col("frag.mf") | (F.col("frag.offset_bytes") > 0)).select("src_ip", "dst_ip", "ts_us", "packet_num", "frag.*")
    f = f.withColumn("end", F.col("offset_bytes") + F.col("payload_bytes"))
    w = Window.partitionBy("src_ip", "dst_ip", "ip_id").orderBy("offset_bytes", "ts_us", "packet_num")
    f = f.withColumn("follows", F.coalesce(F.lag("end").over(w), F.lit(0)) == F.col("offset_bytes")).withColumn("r", F.row_number().over(w))
    g = f.groupBy("src_ip", "dst_ip", "ip_id").agg(
        F.count("*").alias("fragments"), F.max_by(F.when(~F.col("mf"), F.col("end")), F.when(~F.col("mf"), F.struct("ts_us", "packet_num"))).alias("total"),
        F.min("follows").alias("follows"), F.max_by("end", "r").alias("reached"), F.max("payload_bytes").alias("largest"),
    )
    complete = F.coalesce(F.col("follows") & (F.col("reached") == F.col("total")), F.lit(False))
    return g.select("src_ip", "dst_ip", "ip_id", "fragments", "total", complete.alias("complete"), (F.col("largest") + 20).alias("path_mtu"))


def incomplete_datagrams(groups: DataFrame, k: int = 20) -> DataFrame:
    """The first k fragment groups (reassembly) that can't be put together."""
    return groups.where("NOT complete").orderBy("src_ip", "dst_ip", "ip_id").limit(k)


def fragment_flows(p: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """The k pairs of addresses with most fragments: packets, fragments, their share in percent, least, most and middle size, and datagrams that can't be put together."""
    is_fragment = F.coalesce(F.col("frag.mf") | (F.col("frag.offset_bytes") > 0), F.lit(False))
    size = F.when(is_fragment, F.col("frag.payload_bytes"))
    g = p.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("packets"), F.count_if(is_fragment).alias("fragments"), F.min(size).alias("least"), F.max(size).alias("most")).where("fragments > 0")
    bad = groups.groupBy("src_ip", "dst_ip").agg(F.count_if(~F.col("complete")).alias("incomplete"))
    g = g.join(bad, ["src_ip", "dst_ip"]).orderBy(F.desc("fragments"), "src_ip", "dst_ip").limit(k)
    return g.select("src_ip", "dst_ip", "packets", "fragments", (F.col("fragments") / F.col("packets").cast("double") * 100.0).alias("share"), "least", "most", ((F.col("least") + F.col("most")) / 2.0).alias("middle"), "incomplete")


def _sacks(p: DataFrame) -> DataFrame:
    """Packets with SACK blocks, their valid blocks b, and whether the first is a duplicate: already acknowledged, or inside the second."""
    d = p.withColumn("b", F.filter("sack", lambda b: b.left < b.right)).where(F.size("b") > 0)
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    dup = (first.right <= F.col("tcp_ack")) | F.coalesce((first.left >= second.left) & (first.right <= second.right), F.lit(False))
    return d.withColumn("dup", dup).withColumn("sacked", F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x.right - x.left))


def sack_flows(p: DataFrame) -> DataFrame:
    """Per directed flow: packets with SACK blocks, blocks, and D-SACKs (a first block already acknowledged, or inside the second)."""
    return _sacks(p).groupBy(*FLOW).agg(F.count("*").alias("packets"), F.sum(F.size("b")).alias("blocks"), F.count_if("dup").alias("dsacks"))


def sack_conversations(p: DataFrame) -> DataFrame:
    """Per conversation: SACK packets and D-SACKs among them, bytes selectively acknowledged, distinct blocks, first and last time, and D-SACKs in percent."""
    d = with_ends(_sacks(p))
    kinds = d.select(*ENDS, F.explode("b").alias("x")).distinct().groupBy(*ENDS).agg(F.count("*").alias("distinct_blocks"))
    g = d.groupBy(*ENDS).agg(F.count("*").alias("sacks"), F.count_if("dup").alias("dsacks"), F.sum("sacked").alias("sacked_bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return g.join(kinds, list(ENDS)).withColumn("dsack_share", F.col("dsacks") / F.col("sacks").cast("double") * 100.0)


def sack_summary(p: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row: TCP packets, SACK packets and their share in percent, D-SACKs and theirs, conversations with SACKs and with D-SACKs, bytes and bytes a SACK."""
    t = p.agg(F.count_if(F.col("protocol") == "TCP").alias("tcp_packets"))
    g = conversations.agg(
        F.coalesce(F.sum("sacks"), F.lit(0)).alias("sacks"), F.coalesce(F.sum("dsacks"), F.lit(0)).alias("dsacks"), F.count("*").alias("conversations"), F.count_if(F.col("dsacks") > 0).alias("with_dsacks"),
        F.coalesce(F.sum("sacked_bytes"), F.lit(0)).alias("sacked_bytes"),
    ).crossJoin(t)
    per = lambda a, b, k: F.when(F.col(b) > 0, F.col(a) / F.col(b).cast("double") * k).otherwise(0.0)
    return g.select("*", per("sacks", "tcp_packets", 100.0).alias("sack_share"), per("dsacks", "sacks", 100.0).alias("dsack_share"), per("sacked_bytes", "sacks", 1.0).alias("bytes_per_sack"))
