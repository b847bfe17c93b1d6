"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate r, how often its words are taken. Among all rates whose words add up to a source's target,
those of greatest entropy are tilted exponentially in the document's size, r = exp(l * size), stopped at the most that
a document may be repeated. The dual has one variable l per source and is convex; safeguarded Newton steps solve all
sources at once on a histogram of sizes, so the texts are read one time and an iteration moves one row per source and
task. Rates become whole copies and one copy cut to the rest of the words, by a draw that depends on the id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftfield.functions.hashing import hash32
from liftfield.llm.common import WORD
from liftfield.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
STEPS = 60
TOLERANCE = 1e-12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target``: weights repeat over the sources by code point, null last.

    The words to share are ``share`` times all sizes. A source is stopped at ``most`` times its size when its part of
    what is left, after the sources that are stopped earlier, is above that; so sorting by stop over weight finds them
    in one pass. One row per source meets in the windows, never a document.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w).withColumn("stop", most * F.col("source_size"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    marked = (per.withColumn("all_words", F.sum("source_size").over(everything) * share).withColumn("all_weight", F.sum("weight").over(everything))
              .withColumn("words_left", F.col("all_words") - F.coalesce(F.sum("stop").over(earlier), zero))
              .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), zero))
              .withColumn("stopped", F.col("stop") * F.col("weight_left") <= F.col("weight") * F.col("words_left")))
    level = ((F.col("all_words") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(everything), zero))
             / (F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("weight"))).over(everything), zero)))
    return marked.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("stopped"), F.col("stop")).otherwise(F.least("stop", F.col("weight") * F.col("level"))).alias("target"))


def rate(tilt: Column, size: Column, most: float = MOST) -> Column:
    return F.exp(F.least(tilt * size, F.log(F.lit(most))))


def solve_tilts(sizes: DataFrame, targets: DataFrame, most: float = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``source`` and ``tilt`` with sum(size * rate) = target in each source, to ``tolerance`` of the target.

    Newton steps on the logarithm of the sum; a step that leaves the bracket becomes a bisection, so ``steps`` rounds
    always end inside a bracket that has shrunk. A source at its stop takes every document at the most (an infinite
    tilt); one of target zero takes none.
    """
    hist = cut_lineage(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    small = hist.groupBy("source").agg(F.min("size").alias("smallest"))
    t = F.col("target")
    state = cut_lineage(
        targets.where("source_size > 0").join(small, targets["source"].eqNullSafe(small["source"])).select(
            targets["source"], "target",
            F.when(t >= most * F.col("source_size") * (1 - 1e-12), F.lit(float("inf"))).when(t <= 0, F.lit(float("-inf"))).alias("fixed"),
            F.least(F.lit(0.0), F.log(t / F.col("source_size")) / F.col("smallest")).alias("low"),
            F.when(t > F.col("source_size"), F.log(F.lit(most)) / F.col("smallest")).otherwise(0.0).alias("high"),
        ).withColumn("tilt", F.coalesce("fixed", F.lit(0.0))).withColumn("done", F.col("fixed").isNotNull()))
    for _ in range(steps):
        open_state = state.where("not done")
        words = F.col("n") * F.col("size") * rate(F.col("tilt"), F.col("size"), most)
        moving = F.when(F.col("tilt") * F.col("size") < F.log(F.lit(most)), words * F.col("size")).otherwise(0.0)
        sums = (hist.join(open_state.select(F.col("source").alias("s"), "tilt"), F.col("source").eqNullSafe(F.col("s")))
                .groupBy("s").agg(F.sum(words).alias("got"), F.sum(moving).alias("slope")))
        low, high = F.when(F.col("got") < t, F.col("tilt")).otherwise(F.col("low")), F.when(F.col("got") > t, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.log(F.col("got") / t) * F.col("got") / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton > F.col("new_low")) & (newton < F.col("new_high")), newton).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        good = F.abs(F.col("got") - t) <= tolerance * t
        moved = (state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("new_low", low).withColumn("new_high", high)
                 .withColumn("finished", F.col("done") | F.coalesce(good, F.lit(False)))
                 .select("source", "target", "fixed", F.when(F.col("finished"), F.col("low")).otherwise(F.col("new_low")).alias("low"),
                         F.when(F.col("finished"), F.col("high")).otherwise(F.col("new_high")).alias("high"),
                         F.when(F.col("finished"), F.col("tilt")).otherwise(step).alias("tilt"), F.col("finished").alias("done")))
        state = cut_lineage(moved)
        if state.where("not done").isEmpty():
            break
    return state.select("source", "tilt")


def mixed(docs: DataFrame, *more: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``copies`` and ``rate`` of each row, and the named columns.

    A null or blank text has size 0 and takes nothing; a null source is a source of its own; a null id draws like any
    other value. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    sizes = cut_lineage(rows)
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    tilts = solve_tilts(sizes, targets, most)
    plan = targets.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "tilt")
    plan = cut_lineage(plan)
    r = F.when(F.col("size") > 0, rate(F.col("tilt"), F.col("size"), most)).otherwise(0.0)
    draw = hash32(F.col("doc_id"), F.col("size")) / float(1 << 32)
    taken = F.least(F.floor(F.col("rate") * F.col("size") + draw), F.floor(F.lit(most) * F.col("size"))).cast("bigint")
    return (sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", r).withColumn("taken", taken)
            .withColumn("copies", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
            .select("doc_id", "size", "source_size", "target", "taken", "copies", "rate", *more))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy, with ``mix_copy`` (from 1); a last copy is cut to its words.

    Texts join the plan by the source, not by the id, so repeated and null ids keep their own size.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = cut_lineage(docs.select(F.col("source").cast("string").alias("source"), size.alias("size")))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    tilts = cut_lineage(solve_tilts(sizes, targets, most).select(F.col("source").alias("__s"), F.col("tilt").alias("__tilt")))
    draw = hash32(F.col("doc_id").cast("bigint"), F.col("__size")) / float(1 << 32)
    taken = F.least(F.floor(rate(F.col("__tilt"), F.col("__size"), most) * F.col("__size") + draw), F.floor(F.lit(most) * F.col("__size")))
    rows = (docs.withColumn("__size", size).where("__size > 0").join(tilts, F.col("source").cast("string").eqNullSafe(F.col("__s")))
            .withColumn("__taken", taken.cast("bigint")).where("__taken > 0"))
    copies = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))))
    left = (F.col("__taken") - (F.col("mix_copy") - 1) * F.col("__size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), left), " ")
    text = F.when(left >= F.col("__size"), F.col("text").cast("string")).otherwise(part)
    return copies.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix_copy"], "mix_copy")
