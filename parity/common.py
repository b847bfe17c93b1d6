"""The driver's tables seen as the domain's tables, once in Spark and once in SQL.

``SQL_VIEWS`` holds named CTEs; :func:`sql` adds those a query mentions, in dependency order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftfield.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {}
STORED: set[str] = set()

# Events carry 2024 dates; this shift puts them next to the order history (Monday to Monday).
EVENT_SHIFT_DAYS = 8218


def check(key: str, oracle: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def wrap(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = sql(oracle)
        return fn

    return wrap


def view(name: str, body: str, stored: bool = False) -> None:
    """A CTE; ``stored`` keeps one that is dear and used several times from being computed again."""
    assert name not in SQL_VIEWS, name
    SQL_VIEWS[name] = body.strip()
    if stored:
        STORED.add(name)


def _double_literals(text: str) -> str:
    """0.5 → 0.5e0 outside quotes: SQL reads the bare form as DECIMAL, Spark code means DOUBLE."""
    parts = text.split("'")
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", parts[i])
    return "'".join(parts)


def sql(body: str) -> str:
    return _double_literals(_with_views(body))


def _with_views(body: str) -> str:
    """Prefix ``body`` with every CTE it uses, directly or through another CTE; one that names itself is recursive."""
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bx_\w+", text):
            if name in SQL_VIEWS and name not in order and name not in open_:
                open_.add(name)
                visit(SQL_VIEWS[name])
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    start = "WITH RECURSIVE " if any(re.search(rf"\b{n}\b", SQL_VIEWS[n]) for n in order) else "WITH "
    return start + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({SQL_VIEWS[n]})" for n in order) + "\n" + body.strip()


def h(*parts: str) -> str:
    """SQL twin of ``hash32``."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def phi(x: str) -> str:
    """SQL twin of ``normal_cdf``."""
    t = f"(1.0/(1.0+0.2316419*abs({x})))"
    poly = f"{t}*(0.319381530+{t}*(-0.356563782+{t}*(1.781477937+{t}*(-1.821255978+{t}*1.330274429))))"
    tail = f"(0.3989422804014327*exp(-({x})*({x})/2.0)*({poly}))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1.0-{tail} ELSE {tail} END)"


def student_p(t: str, n: str) -> str:
    """SQL twin of ``student_t_two_sided_p``: the same series with its coefficients from the gamma function."""
    x, c2 = f"(abs({t}) / sqrt({n}))", f"(1 / (1 + pow({t}, 2) / {n}))"
    odd = f"list_sum([exp(0.5723649429247001 - 0.6931471805599453 + lgamma(k + 1) - lgamma(k + 1.5)) * pow({c2}, k) for k in range(CAST({n} // 2 AS BIGINT))])"
    even = f"list_sum([exp(lgamma(k + 0.5) - 0.5723649429247001 - lgamma(k + 1)) * pow({c2}, k) for k in range(CAST({n} // 2 AS BIGINT))])"
    return f"""(CASE WHEN {t} IS NULL OR {n} IS NULL THEN NULL WHEN {n} % 2 = 1 THEN greatest(1 - (atan({x}) + {x} * {c2} * coalesce({odd}, 0)) * 2 / pi(), 0)
    ELSE greatest(1 - {x} * sqrt({c2}) * {even}, 0) END)"""


def own_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, for queries that write files and read them back."""
    return f"{shared_folder(spark)}/liftfield/files-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(col, digits: int = 6):
    return F.round(col, digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, some to their own number of digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            c = F.round(c, special.get(f.name, digits)).alias(f.name)
        out.append(c)
    return df.select(*out)


# ---- store orders ---------------------------------------------------------------------------

view("x_store", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS date,
       CAST(c_nationkey AS VARCHAR) AS geo, o_totalprice AS revenue, o_orderstatus AS status,
       o_custkey AS custkey, o_orderpriority AS priority, o_orderkey AS okey
FROM orders JOIN customer ON o_custkey = c_custkey
""")
view("x_daily", """
SELECT date, geo, sum(revenue) AS revenue, count(DISTINCT order_id) AS orders
FROM x_store WHERE status IN ('F', 'O') GROUP BY date, geo
""")
view("x_weekly", """
SELECT CAST(date_trunc('week', date) AS DATE) AS date, geo, sum(revenue) AS revenue,
       CAST(sum(orders) AS BIGINT) AS orders
FROM x_daily GROUP BY 1, 2
""")


def store_orders(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("c_nationkey").cast("string").alias("geo"),
        F.col("o_totalprice").alias("revenue"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("okey"),
    )


def daily(spark, sf) -> DataFrame:
    from liftfield.operators.marts import geo_daily_revenue, paid_only

    return geo_daily_revenue(paid_only(store_orders(spark, sf), "status", ("F", "O")))


def weekly(spark, sf) -> DataFrame:
    return daily(spark, sf).groupBy(F.date_trunc("week", "date").cast("date").alias("date"), "geo").agg(
        F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )


# ---- marketplace lines ----------------------------------------------------------------------

view("x_market", """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey AS VARCHAR) AS geo,
       l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice AS gross, l_partkey AS item,
       CAST(l_quantity AS BIGINT) AS units, l_returnflag AS flag, l_linestatus AS linestatus,
       l_orderkey AS okey, l_linenumber AS line
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
""")
view("x_market_daily", """
SELECT date, geo, sum(revenue) AS revenue, count(DISTINCT okey) AS orders FROM x_market GROUP BY date, geo
""")


def market_lines(spark, sf) -> DataFrame:
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("s_nationkey").cast("string").alias("geo"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.col("l_extendedprice").alias("gross"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").cast("bigint").alias("units"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
    )


def market_daily(spark, sf) -> DataFrame:
    return market_lines(spark, sf).groupBy("date", "geo").agg(
        F.sum("revenue").alias("revenue"), F.countDistinct("okey").alias("orders")
    )


# ---- ad spend -------------------------------------------------------------------------------

view("x_events", f"""
SELECT CAST(CAST(ts AS DATE) - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) AS date,
       CAST(user_id % 25 AS VARCHAR) AS geo, event_type AS channel, value AS spend,
       event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events
""")
view("x_spend", """
SELECT date, geo, channel, sum(spend) AS spend, sum(k)::BIGINT AS impressions
FROM x_events GROUP BY date, geo, channel
""")


def spend_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.date_sub(F.col("ts").cast("date"), EVENT_SHIFT_DAYS).alias("date"),
        (F.col("user_id") % 25).cast("string").alias("geo"),
        F.col("event_type").alias("channel"),
        F.col("value").alias("spend"),
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def spend_daily(spark, sf) -> DataFrame:
    return spend_events(spark, sf).groupBy("date", "geo", "channel").agg(
        F.sum("spend").alias("spend"), F.sum("k").alias("impressions")
    )


# ---- markets --------------------------------------------------------------------------------

view("x_geos", """
SELECT CAST(n_nationkey AS VARCHAR) AS geo, n_name AS name, r_name AS region, n_nationkey AS num,
       -35.0 + n_nationkey * 0.9 AS lat, -100.0 + (n_nationkey * 7 % 25) * 1.1 AS lon
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
view("x_population", """
SELECT CAST(c_nationkey AS VARCHAR) AS geo, count(*) AS population FROM customer GROUP BY 1
""")


def geos(spark, sf) -> DataFrame:
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(g, n.n_regionkey == g.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("geo"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("region"),
        F.col("n_nationkey").alias("num"),
        (F.lit(-35.0) + F.col("n_nationkey") * 0.9).alias("lat"),
        (F.lit(-100.0) + (F.col("n_nationkey") * 7 % 25) * 1.1).alias("lon"),
    )


def population(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("geo")).agg(
        F.count("*").alias("population")
    )


# ---- tests and assignments ------------------------------------------------------------------

# (test_id, first post day, last post day, pre days)
TESTS = [
    ("t1", "1999-03-01", "1999-04-25", 182),
    ("t2", "2000-05-01", "2000-06-25", 182),
    ("t3", "2001-05-07", "2001-07-29", 364),
]
view("x_tests", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', DATE '{a}', DATE '{b}', {n})" for t, a, b, n in TESTS
) + ") AS v(test_id, start_date, end_date, lookback_days)")
N_HOLDOUT = 8
view("x_assign", f"""
SELECT test_id, geo, region, CASE WHEN rk <= {N_HOLDOUT} THEN 'holdout' ELSE 'treatment' END AS cell
FROM (SELECT test_id, geo, region,
             row_number() OVER (PARTITION BY test_id ORDER BY {h('test_id', 'geo')}, geo) AS rk
      FROM x_geos, x_tests)
""")
_PANEL_SQL = """
SELECT a.test_id, a.geo, a.cell, p.date, p.revenue, p.orders,
       CASE WHEN p.date < t.start_date THEN 'pre' ELSE 'post' END AS period
FROM {src} p JOIN x_assign a ON a.geo = p.geo JOIN x_tests t ON t.test_id = a.test_id
WHERE p.date BETWEEN t.start_date - CAST(t.lookback_days AS INTEGER) AND t.end_date
"""
view("x_panel", _PANEL_SQL.format(src="x_daily"))
view("x_wpanel", _PANEL_SQL.format(src="x_weekly"))


def tests_table(spark) -> DataFrame:
    return spark.createDataFrame(TESTS, "test_id string, s string, e string, lookback_days int").select(
        "test_id",
        F.to_date("s").alias("start_date"),
        F.to_date("e").alias("end_date"),
        "lookback_days",
    )


def assignment(spark, sf) -> DataFrame:
    from liftfield.operators.assign import hash_assignment

    return hash_assignment(per_test(spark, geos(spark, sf).select("geo", "region")), N_HOLDOUT)


def per_test(spark, df: DataFrame) -> DataFrame:
    """One copy of a market table for each test (the tests are parameters)."""
    ids = F.array(*[F.lit(t[0]) for t in TESTS])
    return df.select(F.explode(ids).alias("test_id"), *df.columns)


def panel(spark, sf, grain: str = "daily") -> DataFrame:
    from liftfield.operators.panel import test_panel

    source = daily(spark, sf) if grain == "daily" else weekly(spark, sf)
    return test_panel(source, tests_table(spark), assignment(spark, sf))
