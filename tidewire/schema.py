"""The packet table that every operator reads, and its optional deep columns."""

from pyspark.sql import types as T

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("packet_num", T.LongType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("src_ip", T.StringType(), False),
        T.StructField("dst_ip", T.StringType(), False),
        T.StructField("ip_version", T.ByteType(), False),
        T.StructField("ttl", T.ShortType(), False),
        T.StructField("total_length", T.IntegerType(), False),
        T.StructField("packet_length", T.IntegerType(), False),
        T.StructField("protocol", T.StringType(), False),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_seq", T.LongType()),
        T.StructField("tcp_ack", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("tcp_payload_len", T.IntegerType(), False),
        T.StructField("udp_length", T.IntegerType()),
        T.StructField("icmp_type", T.ShortType()),
        T.StructField("icmp_code", T.ShortType()),
    ]
)
#: Deep columns, all nullable: DNS message, IP fragment fields, SACK blocks, ICMP details.
DEEP_DDL = (
    "dns struct<id:int,qr:tinyint,rcode:int,qname:string,qtype:int,n_answers:int>, "
    "frag struct<ip_id:int,df:boolean,mf:boolean,offset_bytes:int,payload_bytes:int,proto:int>, "
    "sack array<struct<left:bigint,right:bigint>>, icmp struct<mtu:int,orig_src:string,orig_dst:string>"
)
