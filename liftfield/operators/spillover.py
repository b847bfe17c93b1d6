"""Market adjacency, border pairs and geographic buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.scalars import haversine_miles

MILES_PER_DEGREE = 69.0


def centroid_edges(centroids: DataFrame, max_miles: float = 175.0) -> DataFrame:
    """Directed edges between markets at most ``max_miles`` apart.

    Markets are filed in cells: latitude bands as wide as the reach, each cut along the longitude into as many cells as its
    circle has room for. A market is looked up in its own and both neighbouring bands, in the cells that its reach in
    longitude touches, around the date line and the poles too: an equi-join whose cells hold what lies near.
    """
    height = max_miles * 1.01 / MILES_PER_DEGREE  # a hair wider, since a great-circle degree is slightly more than 69 miles
    band = F.floor((F.col("lat") + 90.0) / height)

    def cells(b):
        """Number of cells of a band: its widest circle in steps of the band's height."""
        low, high = b * height - 90.0, (b + 1) * height - 90.0
        widest = F.when((low < 0) & (high > 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(low), F.abs(high)))))
        return F.greatest(F.floor(360.0 * F.abs(widest) / height), F.lit(1))

    east = F.pmod(F.col("lon") + 180.0, F.lit(360.0))
    reach = F.radians(F.lit(height))
    room = F.sin(reach) / F.cos(F.radians("lat"))
    # beyond the circle that touches a pole, every longitude is within reach
    wide = F.when(F.abs("lat") + height >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(room, F.lit(1.0)))))
    left = centroids.select(F.col("geo").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), band.alias("b"), east.alias("east"), wide.alias("wide"))
    left = left.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).withColumn("n", cells(F.col("b")))
    step = 360.0 / F.col("n")
    first, last = F.floor((F.col("east") - F.col("wide")) / step), F.floor((F.col("east") + F.col("wide")) / step)
    near = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + F.col("n") - 1)), lambda c: F.pmod(c, F.col("n"))))
    left = left.select("src", "lat1", "lon1", "b", F.explode(near).alias("c"))
    right = centroids.select(F.col("geo").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), band.alias("b"), east.alias("east")).withColumn("n", cells(F.col("b")))
    right = right.select("dst", "lat2", "lon2", "b", F.least(F.floor(F.col("east") / (360.0 / F.col("n"))), F.col("n") - 1).alias("c"))
    miles = haversine_miles(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return left.join(right, ["b", "c"]).filter("src <> dst").withColumn("miles", miles).filter(F.col("miles") <= max_miles).select(
        "src", "dst", "miles")


def neighbour_stats(centroids: DataFrame, edges: DataFrame) -> DataFrame:
    """Average and largest neighbour count, isolated markets and undirected edges."""
    deg = edges.groupBy(F.col("src").alias("geo")).agg(F.count("*").alias("n"))
    rows = centroids.select("geo").join(deg, "geo", "left").fillna(0)
    return rows.agg(
        F.count("*").alias("n_geos"), F.avg("n").alias("avg_neighbours"), F.max("n").alias("max_neighbours"),
        F.count_if(F.col("n") == 0).alias("n_isolated"), F.floor(F.sum("n") / 2).alias("n_edges"))


def border_pairs(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Treatment markets that touch a holdout market: (test_id, treatment_geo, holdout_geo)."""
    t = assignment.filter("cell = 'treatment'").select("test_id", F.col("geo").alias("src"))
    h = assignment.filter("cell = 'holdout'").select("test_id", F.col("geo").alias("dst"))
    pairs = edges.select("src", "dst").distinct().join(t, "src").join(h, ["test_id", "dst"])
    return pairs.select("test_id", F.col("src").alias("treatment_geo"), F.col("dst").alias("holdout_geo"))


def spillover_risk(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Share of holdout markets that touch treatment, the clean share and a level."""
    size = assignment.groupBy("test_id").agg(F.count_if(F.col("cell") == "holdout").alias("n_holdout"))
    hit = border_pairs(edges, assignment).groupBy("test_id").agg(
        F.count("*").alias("n_border_pairs"), F.count_distinct("holdout_geo").alias("n_contaminated_holdout"),
        F.count_distinct("treatment_geo").alias("n_contaminated_treatment"))
    rows = size.join(hit, "test_id", "left").fillna(0)
    risk = F.when(F.col("n_holdout") > 0, F.col("n_contaminated_holdout") / F.col("n_holdout")).otherwise(0.0)
    level = F.when(risk > 0.3, "high").when(risk > 0.1, "moderate").when(F.col("n_contaminated_holdout") > 0, "low").otherwise("none")
    return rows.select(
        "test_id", "n_holdout", "n_border_pairs", "n_contaminated_holdout", "n_contaminated_treatment",
        risk.alias("risk_score"), (1.0 - risk).alias("clean_holdout_share"), level.alias("risk_level"))


def contact_counts(pairs: DataFrame) -> DataFrame:
    """Holdout markets by the number of treatment markets they touch, most first."""
    order = W.Window.partitionBy("test_id").orderBy(F.col("n_contacts").desc(), "holdout_geo")
    counts = pairs.groupBy("test_id", "holdout_geo").agg(F.count_distinct("treatment_geo").alias("n_contacts"))
    return counts.withColumn("rank", F.row_number().over(order))


def geographic_buffer(edges: DataFrame, assignment: DataFrame, min_holdout: int = 5) -> DataFrame:
    """Assignment with an ``in_buffer`` flag.

    Both sides of every border are buffered when enough holdout markets remain; otherwise only the
    most exposed holdout markets, as many as can be spared; otherwise none.
    """
    pairs = border_pairs(edges, assignment)
    risk = spillover_risk(edges, assignment)
    left = F.col("n_holdout") - F.col("n_contaminated_holdout")
    mode = F.when(F.col("n_contaminated_holdout") == 0, "none").when(left >= min_holdout, "full").when(
        F.col("n_holdout") - min_holdout > 0, "partial").otherwise("none")
    plan = risk.select("test_id", mode.alias("buffer_mode"), (F.col("n_holdout") - min_holdout).alias("can_drop"))
    touched_h = contact_counts(pairs).select("test_id", F.col("holdout_geo").alias("geo"), F.lit("holdout").alias("cell"), "rank")
    touched_t = pairs.select("test_id", F.col("treatment_geo").alias("geo")).distinct().select(
        "test_id", "geo", F.lit("treatment").alias("cell"), F.lit(0).alias("rank"))
    touched = touched_h.unionByName(touched_t)
    rows = assignment.join(touched, ["test_id", "geo", "cell"], "left").join(plan, "test_id")
    full = (F.col("buffer_mode") == "full") & F.col("rank").isNotNull()
    partial = (F.col("buffer_mode") == "partial") & (F.col("cell") == "holdout") & (F.col("rank") <= F.col("can_drop"))
    return rows.select(*assignment.columns, "buffer_mode", F.coalesce(full | partial, F.lit(False)).alias("in_buffer"))


def analysis_cells(buffered: DataFrame) -> DataFrame:
    return buffered.filter(~F.col("in_buffer")).drop("in_buffer", "buffer_mode")
