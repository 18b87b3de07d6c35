from pyspark.sql import functions as F

from clicktide.functions.codec import decode_events, decode_rejects, encode_events
from helpers import at, message, plan

GOOD = [
    message("23:44:09.999"),
    message("23:44:10.000", user=5),
    message("23:44:11", clicked=False),
    message("23:44:12", clicked="yes"),
    message("23:44:13", user=None),
    '{"event_time":"2025-10-04T23:44:14Z","campaign_id":"cmp-002"}',
    message("23:44:15", extra="ignored"),
]
BAD = {
    "garbage": "not_an_event",
    "": "not_an_event",
    "{}": "not_an_event",
    message("23:44:16", event_time="some day"): "bad_event_time",
    message("23:44:16", event_time=...): "no_event_time",
    message("23:44:16", campaign=None): "no_campaign",
    message("23:44:16", campaign=...): "no_campaign",
}


def _raw(spark, lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, value string")


def test_good_messages_are_typed(spark):
    rows = decode_events(_raw(spark, GOOD), carry=["n"]).orderBy("n")
    rows = rows.withColumn("event_time", F.date_format("event_time", "HH:mm:ss.SSS")).collect()
    assert [r.event_time for r in rows] == [
        "23:44:09.999", "23:44:10.000", "23:44:11.000", "23:44:12.000", "23:44:13.000",
        "23:44:14.000", "23:44:15.000",
    ]
    assert rows[1].user_id == "5"
    assert rows[2].clicked is False
    assert rows[3].clicked is None and rows[3].user_id == "u-1"
    assert rows[4].user_id is None
    assert rows[5].campaign_id == "cmp-002" and rows[5].ad_id is None


def test_binary_values_are_read_as_text(spark):
    raw = _raw(spark, GOOD).withColumn("value", F.col("value").cast("binary"))
    assert decode_events(raw).count() == len(GOOD)


def test_bad_messages_get_a_reason(spark):
    raw = _raw(spark, list(BAD) + GOOD)
    rejects = decode_rejects(raw, carry=["n"]).orderBy("n").collect()
    assert [(r.value, r.reason) for r in rejects] == list(BAD.items())
    assert decode_events(raw).count() == len(GOOD)


def test_null_value_is_rejected(spark):
    raw = spark.createDataFrame([(None,)], "value string")
    assert [r.reason for r in decode_rejects(raw).collect()] == ["not_an_event"]
    assert decode_events(raw).count() == 0


def test_null_campaigns_can_be_kept(spark):
    raw = _raw(spark, list(BAD) + GOOD)
    assert decode_events(raw, keep_null_campaign=True).count() == len(GOOD) + 2
    assert decode_rejects(raw, keep_null_campaign=True).count() == len(BAD) - 2


def test_message_text(spark):
    event = spark.createDataFrame(
        [(at("23:44:00.123456"), "u-0a1b2c", "cmp-001", "ad-3d4e5f", True)],
        "event_time timestamp, user_id string, campaign_id string, ad_id string, clicked boolean",
    )
    assert encode_events(event).first().value == (
        '{"event_time":"2025-10-04T23:44:00.123Z","user_id":"u-0a1b2c",'
        '"campaign_id":"cmp-001","ad_id":"ad-3d4e5f","clicked":true}'
    )


def test_each_message_is_parsed_once(spark, tmp_path):
    _raw(spark, GOOD).select("value").write.text(str(tmp_path / "lines"))
    raw = spark.read.text(str(tmp_path / "lines"))
    for decoded in (decode_events(raw), decode_rejects(raw)):
        text = plan(decoded.groupBy("value" if "value" in decoded.columns else "user_id").count())
        assert text.count("from_json") == 1
        assert "Python" not in text
