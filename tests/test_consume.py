"""Event consumption: parse, quarantine, handler fan-out."""

from tidewater.operators import consume as CS

ENV = "event string, type string, severity string, cluster string, group_id string, topic string, " \
      "partition string, timestamp bigint"


def test_quarantine_reasons(spark):
    good = '{"id":"1","type":"lag_cleared","severity":"info","consumer_group":"g","partition":3,"current_lag":0}'
    rows = [(good, "t", "s", "c", "g", "t", "3", 1), (None, "t", "s", "c", "g", "t", "3", 1),
            ("{not json", "t", "s", "c", "g", "t", "3", 1),
            ('{"id":"2","type":"x","partition":"three"}', "t", "s", "c", "g", "t", "3", 1)]
    p = CS.parse(spark.createDataFrame(rows, ENV))
    assert CS.accepted(p).count() == 1
    reasons = sorted(r.reject_reason for r in CS.quarantine(p).collect())
    assert reasons == ["invalid payload", "invalid payload", "missing payload"]


def test_objects_without_a_type_are_accepted(spark):
    rows = [("{}", "t", "s", "c", "g", "t", "3", 1), ('{"id":"7"}', "t", "s", "c", "g", "t", "3", 1)]
    p = CS.parse(spark.createDataFrame(rows, ENV))
    assert CS.accepted(p).count() == 2 and CS.quarantine(p).count() == 0


def test_failing_handler_does_not_stop_others(spark, tmp_path):
    good = '{"id":"1","type":"lag_cleared","severity":"info","current_lag":0}'
    batch = spark.createDataFrame([(good, "t", "s", "c", "g", "t", "3", 1)], ENV)
    seen = []

    def bad(df, bid):
        raise RuntimeError("boom")

    def ok(df, bid):
        seen.append(df.count())

    errors = CS.fan_out([bad, ok], str(tmp_path / "q"))(batch, 0)
    assert seen == [1] and list(errors) == [0]
