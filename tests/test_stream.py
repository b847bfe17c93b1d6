import datetime as dt

from pyspark.sql import functions as F

from conftest import by
from liftfield.streaming import ingest


def event(i, when, spend=1.0):
    return (i, dt.datetime.fromisoformat(when), "g", "tv", spend)


def run(spark, base):
    stream = ingest.read_event_stream(spark, f"{base}/in")
    ingest.ingest_daily(stream, f"{base}/raw", f"{base}/totals", f"{base}/state").awaitTermination()
    return {str(k): (v["spend"], v["n_events"]) for k, v in by(spark.read.parquet(f"{base}/totals"), "date").items()}


def land(spark, base, rows):
    spark.createDataFrame(rows, ingest.SPEND_EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_late_and_repeated_events(spark, tmp_path):
    base = str(tmp_path)
    land(spark, base, [event(1, "2024-01-01T10:00:00"), event(2, "2024-01-01T11:00:00"), event(1, "2024-01-01T10:00:00"), event(3, "2024-01-02T09:00:00")])
    assert run(spark, base) == {"2024-01-01": (2.0, 2), "2024-01-02": (1.0, 1)}
    assert run(spark, base) == {"2024-01-01": (2.0, 2), "2024-01-02": (1.0, 1)}
    land(spark, base, [event(4, "2024-01-01T23:00:00", 5.0), event(3, "2024-01-02T09:00:00"), event(5, "2024-01-03T01:00:00")])
    assert run(spark, base) == {"2024-01-01": (7.0, 3), "2024-01-02": (1.0, 1), "2024-01-03": (1.0, 1)}


def test_a_batch_opens_its_own_days_only(spark, tmp_path):
    base = str(tmp_path)
    land(spark, base, [event(1, "2024-01-01T10:00:00"), event(2, "2024-01-05T10:00:00")])
    run(spark, base)
    # what other days hold is never opened: a broken file there does no harm
    (tmp_path / "raw" / "date=2024-01-05" / "batch=0" / "part-broken.parquet").write_bytes(b"no parquet")
    land(spark, base, [event(3, "2024-01-01T12:00:00", 4.0), event(1, "2024-01-01T10:00:00"), event(9, "2024-01-07T10:00:00")])
    assert run(spark, base) == {"2024-01-01": (5.0, 2), "2024-01-05": (1.0, 1), "2024-01-07": (1.0, 1)}


def test_one_file_a_batch_and_a_batch_that_runs_again(spark, tmp_path):
    base = str(tmp_path)
    for k in range(3):
        land(spark, base, [event(k, "2024-01-01T10:00:00"), event(0, "2024-01-01T10:00:00")])
    stream = ingest.read_event_stream(spark, f"{base}/in", files=1)
    ingest.ingest_daily(stream, f"{base}/raw", f"{base}/totals", f"{base}/state").awaitTermination()
    want = {"2024-01-01": (3.0, 3)}
    got = lambda: {str(k): (v["spend"], v["n_events"]) for k, v in by(spark.read.parquet(f"{base}/totals"), "date").items()}
    assert got() == want and len(list((tmp_path / "raw" / "date=2024-01-01").glob("batch=*"))) == 3
    # the last commit is lost: the batch runs again over what it had written
    for f in (tmp_path / "state" / "commits").glob("*2*"):
        f.unlink()
    stream = ingest.read_event_stream(spark, f"{base}/in", files=1)
    ingest.ingest_daily(stream, f"{base}/raw", f"{base}/totals", f"{base}/state").awaitTermination()
    assert got() == want


def test_totals_match_a_batch_query(spark):
    rows = [event(i, f"2024-01-0{1 + i % 3}T10:00:00", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, ingest.SPEND_EVENTS)
    assert ingest.daily_totals(df).agg(F.sum("spend"), F.sum("n_events")).first() == (435.0, 30)
