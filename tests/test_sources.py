import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import by, one
from liftfield.operators import lookups, marts, staging
from liftfield.sources import attribution, commerce, landed, tables


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("orders")

    def row(i, at, total, status, items, zip_code):
        address = None if zip_code is None else {"zip": zip_code, "province_code": "NY", "city": "X"}
        return {"id": i, "created_at": at, "total_price": total, "subtotal_price": total, "financial_status": status,
                "line_items": [{"id": n} for n in range(items)], "shipping_address": address}

    lines = [
        row(1001, "2025-06-15T10:30:00-04:00", "79.99", "paid", 1, "10001"),
        row(1002, "2025-06-15T23:30:00-04:00", "149.50", "paid", 2, "90210-1234"),
        row(1003, "2025-06-16T09:15:00-04:00", "24.99", "paid", 1, "60601"),
        row(1004, "2025-06-16T11:00:00-04:00", "0.00", "refunded", 0, "10001"),
        row(1005, "2025-06-16T12:30:00-04:00", "55.00", "paid", 1, None),
    ]
    (folder / "a.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    return commerce.normalise_orders(landed.read_json(spark, str(folder), commerce.ORDER_JSON))


def test_orders_are_typed_and_local(orders):
    rows = by(orders, "order_id")
    assert len(rows) == 5
    assert rows["1002"]["date"] == dt.date(2025, 6, 15) and rows["1002"]["shipping_zip"] == "90210"
    assert rows["1005"]["shipping_zip"] == "" and rows["1005"]["shipping_city"] == ""
    assert rows["1004"]["line_items_count"] == 0 and rows["1002"]["line_items_count"] == 2


def test_daily_revenue_by_market(spark):
    o = spark.createDataFrame(
        [("1", 100.0, "paid", "10001"), ("2", 200.0, "paid", "10055"), ("3", 150.0, "paid", "90210"),
         ("4", 999.0, "refunded", "10001"), ("5", 50.0, "paid", "00000"), ("6", 70.0, "paid", "9")],
        "order_id string, revenue double, financial_status string, shipping_zip string").withColumn("date", F.lit(dt.date(2025, 6, 15)))
    zip3 = spark.createDataFrame([("100", "501"), ("902", "803")], "zip3 string, geo string")
    mapped = lookups.map_zip_to_geo(marts.paid_only(o), zip3).filter("geo IS NOT NULL")
    out = by(marts.geo_daily_revenue(mapped), "geo")
    assert (out["501"]["revenue"], out["501"]["orders"]) == (300.0, 2)
    assert (out["803"]["revenue"], out["803"]["orders"]) == (150.0, 1)
    assert set(out) == {"501", "803"}


def test_market_name_steps(spark):
    names = spark.createDataFrame([("New York, NY", "501"), ("Boston", "506")], "name string, geo string")
    raw = spark.createDataFrame([("New York, NY",), (" new york, ny ",), ("Boston, MA",), ("BOSTON , XX",), ("Nowhere",), (None,)], "name string")
    got = [r["geo"] for r in lookups.map_market_names(raw, names).collect()]
    assert sorted(x or "-" for x in got) == sorted(["501", "501", "506", "506", "-", "-"])


def test_absent_commission_differs_from_null(spark):
    rows = spark.createDataFrame([('{"date":"2024-01-01","gmv":"100"}',), ('{"date":"2024-01-02","gmv":"100","affiliate_commission":null}',)], "v string")
    raw = rows.select(F.from_json("v", "map<string,string>").alias("fields"))
    out = by(commerce.normalise_shop_sales(raw), "date")
    assert out[dt.date(2024, 1, 1)]["estimated_spend"] == 15.0
    assert out[dt.date(2024, 1, 2)]["estimated_spend"] == 0.0


def test_state_split_conserves_spend(spark):
    df = spark.createDataFrame([("2024-01-01", "Texas", 100.0), ("2024-01-01", "Elsewhere", 7.0), ("2024-01-01", "DC", 5.0)],
                               "d string, region string, spend double").select(F.to_date("d").alias("date"), "region", "spend")
    shares = spark.createDataFrame([("Texas", "a", 0.6), ("Texas", "b", 0.4), ("Maryland", "c", 1.0)], "state string, geo string, weight double")
    out = by(lookups.split_states_to_geos(df, shares, {"DC": "Maryland"}, ["spend"]), "geo")
    assert {k: v["spend"] for k, v in out.items()} == pytest.approx({"a": 60.0, "b": 40.0, "c": 5.0, "Unknown (Elsewhere)": 7.0})


def test_marketplace_filter_reads_the_raw_column(spark):
    rows = [(dt.date(2023, 1, 1), None, None, 5.0, None, 4.0, None, m) for m in ("US", "CA", None)]
    rows.append((dt.date(2021, 1, 1), None, None, 5.0, None, 4.0, None, "US"))
    raw = spark.createDataFrame(rows, "date date, item string, product_name string, gross_revenue double, returns double, net_revenue double, units bigint, marketplace string")
    out = one(staging.stage_marketplace(raw))
    assert out["item"] == "ALL" and out["units"] == 0


def test_event_rules(spark):
    base = ("meta_perf", "geo_holdout", dt.date(2025, 1, 6), dt.date(2025, 2, 2), 100000.0, 98000.0, 186000.0, 200000.0, 0.0, "shopify")
    bad = ("meta_perf", "nonsense", dt.date(2025, 1, 7), dt.date(2025, 1, 1), 1.0, 5.0, 4.0, 0.0, 0.99, "retail")
    schema = ("channel string, test_type string, test_start_date date, test_end_date date, lift_abs double, lift_lower_90 double, "
              "lift_upper_90 double, spend_in_period double, implied_roi double, outcome string")
    out = staging.validate_events(spark.createDataFrame([base, bad], schema)).orderBy("lift_abs").collect()
    assert out[0]["rejected_reason"] == ["test_type", "outcome", "dates", "interval", "spend"] and out[0]["implied_roi"] == 0.99
    assert out[1]["rejected_reason"] == [] and out[1]["implied_roi"] == 0.5 and out[1]["duration_days"] == 28


def test_attribution_window_is_checked():
    with pytest.raises(ValueError):
        attribution.check_window(29)


def test_append_sink_and_contract(spark, tmp_path):
    path = str(tmp_path / "spend")
    assert tables.read_table(spark, path, "daily_spend").count() == 0
    df = spark.createDataFrame([("2024-01-01", "tv", "501", 5.0)], "d string, channel string, geo string, spend double").select(
        F.to_date("d").alias("date"), "channel", "geo", "spend")
    tables.append_rows(df, path, "daily_spend")
    tables.append_rows(df, path, "daily_spend")
    back = tables.read_table(spark, path, "daily_spend")
    assert back.count() == 2 and back.filter("loaded_at IS NULL").count() == 0
    assert one(tables.load_summary(back, "spend"))["total_spend"] == 10.0
    breaches = by(tables.contract_breaches(back.withColumn("geo", F.lit(None).cast("string")), "daily_spend"), "column_name")
    assert breaches["geo"]["null_count"] == 2 and breaches["spend"]["null_count"] == 0


def test_cache_csv_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "geo string, revenue double")
    landed.write_cache(df, str(tmp_path), "store")
    assert landed.read_cache(spark, str(tmp_path), "store", "geo string, revenue double").count() == 2
    assert landed.read_cache(spark, str(tmp_path), "none", "geo string").count() == 0
    rows = tables.report_rows(df, "geo", ["revenue"])
    tables.write_report(rows, str(tmp_path / "report.csv"))
    assert landed.read_csv(spark, str(tmp_path / "report.csv"), "geo string, metric string, value string").count() == 2
    assert landed.daily_csv_path("x", "ad_spend") == "x/ad_spend.csv" and landed.daily_csv_path("x", "tv") == "x/tv_daily.csv"
    (tmp_path / "tv_daily.csv").write_text("date,geo,revenue\n2024-01-02,501,3.5\n")
    got = one(landed.read_csv(spark, landed.daily_csv_path(str(tmp_path), "tv"), "date date, geo string, revenue double"))
    assert got["date"] == dt.date(2024, 1, 2)


def test_calibration_store(spark, tmp_path):
    path = str(tmp_path / "cal")
    row = spark.createDataFrame([("tv", "geo_holdout", dt.date(2024, 1, 1), dt.date(2024, 1, 7), 1.0, 2.0, "shopify")],
                                "channel string, test_type string, test_start_date date, test_end_date date, lift_abs double, spend_in_period double, outcome string")
    tables.add_events(row, path)
    tables.add_events(row, path)
    assert tables.read_table(spark, path, "calibration_events").count() == 2
    tables.replace_events(row, path)
    assert tables.read_table(spark, path, "calibration_events").count() == 1
    tables.clear_events(spark, path)
    assert tables.read_table(spark, path, "calibration_events").count() == 0


def test_store_skips_corrupt_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"test_id":"a","name":"n","status":"running","saved_at":"2024-01-01T00:00:00"}\n{oops\n'
                                     '{"test_id":"a","name":"n","status":"completed","saved_at":"2024-02-01T00:00:00"}\n')
    store = tables.list_store(spark, str(tmp_path))
    assert store.count() == 2
    assert one(tables.latest_saved(store, ["test_id"], ["saved_at"]))["status"] == "completed"
    assert tables.with_status(store, "running").count() == 1


def test_adjacency_from_file_or_centroids(spark, tmp_path):
    (tmp_path / "adj.json").write_text('{"geo":"1","neighbours":["2","1"]}\n{"geo":"2","neighbours":["1"]}\n')
    points = spark.createDataFrame([("1", 40.0, -75.0), ("9", 40.5, -75.5), ("5", 10.0, 10.0)], "geo string, lat double, lon double")
    read = tables.read_adjacency(spark, str(tmp_path), points)
    assert {(r["src"], r["dst"]) for r in read.collect()} == {("1", "2"), ("2", "1")}
    far = tables.read_adjacency(spark, str(tmp_path), points, "centroids")
    assert {(r["src"], r["dst"]) for r in far.collect()} == {("1", "9"), ("9", "1")}
    assert [r["dst"] for r in tables.neighbours_of(far, "1").collect()] == ["9"]
