import pytest
from pyspark.sql import functions as F

from fleetlens import fixture
from fleetlens.schemas import (
    BRONZE,
    BRONZE_MINIMAL,
    PAYLOAD,
    SILVER,
    align_schema,
    ensure_table,
    schema,
)
from fleetlens.sources.bronze import message_counters, parse_bronze, split_malformed
from fleetlens.sources.kafka import connection_parts, kafka_options
from fleetlens.sources.serial import derive_metrics, parse_serial_csv
from tests.conftest import as_set, at

CONN = "Endpoint=sb://hub.example.net/;SharedAccessKeyName=k;SharedAccessKey=a=b=;EntityPath=telemetry"


def raw(spark, *bodies):
    rows = [(b, at(i)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "value string, timestamp timestamp")


def test_kafka_options():
    options = kafka_options(CONN, "earliest", group_id="g")
    assert connection_parts(CONN) == ("hub.example.net:9093", "telemetry")
    assert options["subscribe"] == "telemetry"
    assert options["maxOffsetsPerTrigger"] == "50000"
    assert options["kafka.group.id"] == "g"
    assert CONN in options["kafka.sasl.jaas.config"]
    assert "maxOffsetsPerTrigger" not in kafka_options(CONN, max_offsets=None)


@pytest.mark.parametrize("bad", ["", "Endpoint=sb://h/", "EntityPath=t", "Endpoint=x;EntityPath=t"])
def test_kafka_needs_endpoint_and_topic(bad):
    with pytest.raises(ValueError):
        kafka_options(bad)


def test_parse_keeps_contract(spark):
    parsed = parse_bronze(raw(spark, '{"machine_id":"MC-0001","temp_c":7.5,"extra":1,"ts":"2024-01-01T00:00:00Z"}'))
    assert parsed.schema.names == BRONZE.names
    assert [f.dataType for f in parsed.schema] == [f.dataType for f in BRONZE]
    row = parsed.first()
    assert row["temp_c"] == 7.5 and row["ts"] == "2024-01-01T00:00:00Z"


def test_parse_edge_bodies(spark):
    bodies = [
        "not json",
        "",
        '{"temp_c": 1}',
        '{"machine_id":"MC-0002","temp_c":"hot","fault_code":"NONE"}',
        '{"machine_id":"MC-0003","fault_code":"OVERTEMP"}',
        '{"machine_id":"MC-0004","fault_code":""}',
    ]
    rows = {r["machine_id"]: r for r in parse_bronze(raw(spark, *bodies)).collect()}
    assert set(rows) == {"MC-0002", "MC-0003", "MC-0004"}
    assert rows["MC-0002"]["temp_c"] is None and rows["MC-0002"]["fault_code"] is None
    assert rows["MC-0003"]["fault_code"] == "OVERTEMP"
    assert rows["MC-0004"]["fault_code"] is None
    # Without a device time the broker's is used.
    assert rows["MC-0002"]["ts"] == "2024-01-01T00:00:03.000Z"


def test_split_malformed_loses_nothing(spark):
    source = raw(spark, "x", '{"machine_id":"MC-1"}', '{"a":', "[1]", None, "{}")
    good, bad = split_malformed(source)
    assert good.count() == 2 and bad.count() == 4
    counted = message_counters(source).first()
    assert (counted["received"], counted["parsed"], counted["malformed"]) == (6, 2, 4)
    assert counted["without_machine"] == 1


def test_serial_lines(spark):
    lines = [
        ("1.5,20,60,RUN,NONE",),
        (" 1.5 , 20 ,60, RUN ,VIBRATION,900,4.5,40,50,1,0.9,230",),
        ("1,2,3,RUN",),
        ("1,2,3,IDLE,",),
        ("x,2,3,RUN,",),
        ("1,2,3.5,RUN,",),
        ("1,2,-3,RUN,",),
        (None,),
    ]
    good, bad = parse_serial_csv(spark.createDataFrame(lines, "line string"))
    assert as_set(good) == {(1.5, 20.0, 60, "RUN", None), (1.5, 20.0, 60, "RUN", "VIBRATION")}
    reasons = [r["reject_reason"] for r in bad.collect()]
    assert sorted(reasons) == [
        "field count", "field count", "negative throughput", "number", "number", "state",
    ]


def test_derived_metrics_values(spark):
    df = spark.createDataFrame([(120, 80.0), (0, 10.0), (None, None)], "throughput_cpm int, temp_c double")
    full, idle, unknown = derive_metrics(df).collect()
    assert (full["rpm"], full["current_amps"], full["load_pct"]) == (3000, 13.0, 100.0)
    assert (full["humidity_pct"], full["pressure_bar"], full["flow_rate_lpm"]) == (65.0, 4.722, 154.0)
    assert full["power_kw"] == pytest.approx(230 * 13 * 0.92 * 3**0.5 / 1000, abs=5e-4)
    assert (idle["rpm"], idle["current_amps"], idle["humidity_pct"]) == (0, 2.0, 30.0)
    assert unknown["load_pct"] is None and unknown["power_kw"] is None


def test_payload_fields_are_all_in_the_messages(frames):
    parsed = parse_bronze(frames.raw)
    assert set(PAYLOAD.names) <= set(parsed.columns)


def test_message_path_equals_typed_path(frames):
    typed = frames.bronze_text
    parsed = parse_bronze(frames.raw, F.col("ingested"), ("event_id",)).select(*typed.columns)
    assert parsed.exceptAll(typed).count() == 0 and typed.exceptAll(parsed).count() == 0


def test_align_schema(spark):
    df = spark.createDataFrame([("a", 1)], "MACHINE_ID string, extra int")
    wanted = schema("machine_id string, temp_c double")
    assert align_schema(df, wanted).dtypes == [("machine_id", "string"), ("temp_c", "double")]
    assert align_schema(df, wanted, keep_extra=True).columns == ["machine_id", "temp_c", "extra"]
    assert align_schema(df, SILVER).columns == SILVER.names


def test_ensure_table_creates_then_adds(spark):
    spark.sql("drop table if exists landed")
    assert ensure_table(spark, "landed", BRONZE_MINIMAL) == []
    added = ensure_table(spark, "landed", BRONZE)
    assert set(added) == set(BRONZE.names) - set(BRONZE_MINIMAL.names)
    assert ensure_table(spark, "landed", BRONZE) == []
    spark.sql("drop table landed")


def test_fixture_counts(spark):
    fx = fixture.telemetry(fixture.read_events(spark, "/root/testdata/sf0.01"))
    found = fx.agg(
        F.count_if(F.col("machine_id").isNull()),
        F.count_if(F.col("device_ms").isNull()),
        F.count_if(F.col("throughput_cpm") < 0),
        F.count_if(F.col("state") == "UNKNOWN"),
        F.count_if(F.col("machine_id") == "LINE-X"),
        F.count_if(F.col("vibration_mm_s") >= 9.5),
        F.count_if(F.col("temp_c") >= 85),
        F.count_if(F.col("current_amps") >= 12),
    ).first()
    assert tuple(found) == (48, 910, 100, 104, 44, 2428, 2491, 958)
