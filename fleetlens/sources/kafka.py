"""Options for reading a Kafka-compatible event hub."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

BROKER_PORT = 9093  # fixed value: TLS port of the Kafka endpoint
LOGIN_MODULE = "org.apache.kafka.common.security.plain.PlainLoginModule"


def connection_parts(conn_str: str) -> tuple[str, str]:
    """Broker address and topic from ``Endpoint=sb://host/;...;EntityPath=topic``."""
    fields = dict(item.split("=", 1) for item in conn_str.split(";") if "=" in item)
    host = urlsplit(fields.get("Endpoint", "")).hostname
    topic = fields.get("EntityPath")
    if not host or not topic:
        raise ValueError("connection string needs Endpoint=<scheme>://<host>/ and EntityPath=<topic>")
    return f"{host}:{BROKER_PORT}", topic


def kafka_options(
    conn_str: str,
    starting: str = "latest",
    max_offsets: int | None = 50_000,
    group_id: str | None = None,
    login_module: str = LOGIN_MODULE,
) -> dict[str, str]:
    """Reader options; ``max_offsets=None`` lifts the per-batch limit."""
    if starting not in ("earliest", "latest"):
        raise ValueError("starting must be 'earliest' or 'latest'")
    servers, topic = connection_parts(conn_str)
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "kafka.security.protocol": "SASL_SSL",
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.sasl.jaas.config": (
            f'{login_module} required username="$ConnectionString" password="{conn_str}";'
        ),
    }
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    if group_id is not None:
        options["kafka.group.id"] = group_id
    return options


def read_kafka(spark: SparkSession, conn_str: str, **kwargs) -> DataFrame:
    """Streaming rows with ``value`` and ``timestamp`` (needs the Kafka connector jar)."""
    return spark.readStream.format("kafka").options(**kafka_options(conn_str, **kwargs)).load()
