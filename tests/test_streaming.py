import datetime as dt

from pyspark.sql import functions as F

from pagewatch.operators.skew import SkewPolicy
from pagewatch.sources import derived
from pagewatch.streaming.feeds import numeric_changes, start_numeric_feed

COLUMNS = ["key", "ordinal", "old_status", "old_length", "status_changed", "size_changed"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def run(spark, source, root, schema, **trigger):
    log = spark.readStream.schema(schema).parquet(str(source))
    paths = [str(root / name) for name in ("state", "out", "checkpoint")]
    query = start_numeric_feed(log, *paths, policy=SkewPolicy(min_rows=20, share=0.0), **trigger)
    query.awaitTermination()
    return spark.read.parquet(paths[1])


def test_feed_over_days_equals_one_batch(spark, sf_dir, tmp_path):
    log = derived.capture_log(spark, sf_dir)
    want = rows(numeric_changes(log))
    for first, last in ((1, 9), (10, 10), (11, 31)):
        day = F.dayofmonth("captured_at")
        log.where(day.between(first, last)).write.mode("append").parquet(str(tmp_path / "in"))
        out = run(spark, tmp_path / "in", tmp_path, log.schema, availableNow=True)
    assert rows(out) == want
    # Without new input a restart emits nothing more.
    assert rows(run(spark, tmp_path / "in", tmp_path, log.schema, availableNow=True)) == want


def test_late_rows_are_kept_and_compared_with_nothing(spark):
    schema = "key bigint, captured_at timestamp_ntz, ordinal bigint, status_code int, content_length bigint, etag string"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    last = spark.createDataFrame([(1, at(5), 5, 200, 10, "a")], schema)
    batch = spark.createDataFrame([(1, at(4), 9, 500, 0, "b"), (1, at(6), 6, 200, 1011, "a"), (2, at(1), 1, 200, 0, "c")], schema)
    for policy in (SkewPolicy(), SkewPolicy(min_rows=1, share=0.0)):
        found = numeric_changes(batch, last, policy=policy).collect()
        got = {r.ordinal: (r.old_length, r.is_first, r.size_changed, r.is_late) for r in found}
        assert got == {6: (10, False, True, False), 1: (None, True, False, False), 9: (None, False, False, True)}


def test_empty_key_history_has_no_change(spark):
    schema = "key bigint, captured_at timestamp_ntz, ordinal bigint, status_code int, content_length bigint, etag string"
    one = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, None, 10, None), (1, dt.datetime(2024, 1, 2), 2, None, 1010, None)], schema)
    got = numeric_changes(one).orderBy("ordinal").collect()
    assert [(r.is_first, r.status_changed, r.size_changed, r.etag_changed) for r in got] == [
        (True, False, False, False), (False, False, False, False)
    ]
