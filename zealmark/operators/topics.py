"""Scores per topic, and validation of generated topics against manual ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.functions.columns import ratio
from zealmark.functions.student import t_quantile
from zealmark.operators.scoring import TOPIC_CUTS, grade, range_score, zero_missing
from zealmark.schemas import METRICS, enforce_schema
from zealmark.sources.state import current_batch

GATE_METRICS = ("num_checkins", "num_bookmarks", "speakers_bookmarked", "speakers_viewed", "sessions_viewed")


# --- topic scores --------------------------------------------------------------------------


def semantic_actions(actions: DataFrame, tags: DataFrame, latest_only: bool = True) -> DataFrame:
    """One row per action and generated topic of its item, newest batch only."""
    actions = current_batch(actions) if latest_only else actions
    topics = tags.select(
        F.col("itemid").cast("string").alias("itemid"),
        F.lower("applicationid").alias("_app"),
        F.col("topic").alias("semantic_topic"),
    )
    return actions.withColumn("_app", F.lower("application_id")).join(topics, ["itemid", "_app"]).drop("_app")


def semantic_gate(tagged: DataFrame, min_total: int = 5) -> DataFrame:
    """Rows with more than ``min_total`` touches; time spent is no touch."""
    total = sum((F.col(m) for m in GATE_METRICS[1:]), F.col(GATE_METRICS[0]))
    gated = zero_missing(tagged).withColumn("tot", total).filter(F.col("tot") > min_total)
    return enforce_schema(gated, "actions_semantic")


def topic_scores(gated: DataFrame, zero_range: str = "reference") -> DataFrame:
    """Score and grade of every gated row. Hand over a stored frame."""
    scored = range_score(zero_missing(gated), METRICS, "V18", zero_range, undefined="null")
    return enforce_schema(grade(scored, "V18", TOPIC_CUTS), "scores_semantic")


# --- validation ----------------------------------------------------------------------------


def _marked(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """One row per item and topic of either source, saying which of the two has it.

    The sources are stacked and grouped rather than joined, so the pairs of an
    item's manual and generated topics never come into being.
    """

    def side(df: DataFrame, is_manual: bool) -> DataFrame:
        return df.select("itemid", F.lower("topic").alias("topic"), F.lit(is_manual).alias("is_manual"))

    return (
        side(manual, True)
        .unionByName(side(generated, False))
        .groupBy("itemid", "topic")
        .agg(F.bool_or("is_manual").alias("manual"), F.bool_or(~F.col("is_manual")).alias("generated"))
    )


def _per_item(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """Distinct topic counts of the items that both sources know."""
    named = F.col("topic").isNotNull()
    in_manual, in_generated = F.col("manual"), F.col("generated")
    return (
        _marked(manual, generated)
        .groupBy("itemid")
        .agg(
            F.count_if(in_manual & named).alias("num_manual"),
            F.count_if(in_generated & named).alias("num_generated"),
            F.count_if(in_manual & in_generated & named).alias("num_manual_matches"),
            F.count_if(in_manual & ~in_generated & named).alias("num_manual_notmatches"),
            F.bool_or(in_manual).alias("has_manual"),
            F.bool_or(in_generated).alias("has_generated"),
        )
        .filter(F.col("has_manual") & F.col("has_generated"))
        .drop("has_manual", "has_generated")
    )


def topic_sides(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """Item, topic, and whether the manual and the generated source have it; items of both sources only."""
    known = _per_item(manual, generated).select("itemid")
    return _marked(manual, generated).join(known, "itemid", "left_semi")


def topic_matches(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """Items with manual topics that were also generated, and how many."""
    hit = F.col("num_manual_matches")
    return _per_item(manual, generated).filter(hit > 0).select("itemid", hit)


def topic_misses(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """Items with manual topics that were not generated, and how many."""
    missed = F.col("num_manual_notmatches")
    return _per_item(manual, generated).filter(missed > 0).select("itemid", missed)


def topic_totals(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """Distinct manual and generated topics per item."""
    return _per_item(manual, generated).select("itemid", "num_manual", "num_generated")


def topic_validation(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """Precision and recall of the generated topics per item, from one pass over both sources."""
    counted = _per_item(manual, generated).withColumns(
        {
            "precision": ratio(F.col("num_manual_matches"), F.col("num_generated")),
            "recall": ratio(F.col("num_manual_matches"), F.col("num_manual")),
        }
    )
    return enforce_schema(counted, "topic_validation")


def correlation_label(df: DataFrame, x: str, y: str, digits: int = 2) -> DataFrame:
    """Text of the correlation, such as 'r =  0.53', with whole numbers shown without decimals."""
    rounded = F.bround(F.corr(x, y), digits).cast("string")
    return df.agg(F.concat(F.lit("r =  "), F.regexp_replace(rounded, r"\.0$", "")).alias("label"))


def histogram(df: DataFrame, columns: list[str], binwidth: float = 0.1) -> DataFrame:
    """Rows per bin of each column; bins are centred on multiples of the width and closed on the right."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in columns])))
    binned = F.ceil(F.round(F.col("col.v") / F.lit(binwidth) - 0.5, 9))
    return (
        long.filter(F.col("col.v").isNotNull())
        .groupBy(F.col("col.measure").alias("measure"), binned.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .withColumn("bin_centre", F.round(F.col("bin") * binwidth, 9))
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` with its standard errors, from mergeable sums."""
    pair = (F.col(y), F.col(x))
    sums = df.agg(
        F.regr_slope(*pair).alias("slope"),
        F.regr_intercept(*pair).alias("intercept"),
        F.regr_r2(*pair).alias("r2"),
        F.regr_count(*pair).alias("n"),
        F.regr_sxx(*pair).alias("sxx"),
        F.regr_syy(*pair).alias("syy"),
        F.regr_avgx(*pair).alias("x_mean"),
    )
    left_over = F.col("syy") * (1 - F.col("r2"))
    residual = F.sqrt(F.try_divide(left_over, F.nullif(F.col("n") - 2, F.lit(0))))
    return sums.withColumn("residual_se", residual).withColumn(
        "slope_se", F.try_divide(F.col("residual_se"), F.sqrt("sxx"))
    )


BAND_POINTS = 80


def fit_band(fit: DataFrame, low: float, high: float, level: float = 0.95, points: int = BAND_POINTS) -> DataFrame:
    """The fitted line at ``points`` equal steps from ``low`` to ``high``, with its standard error and the band of confidence ``level``.

    ``fit`` is the one row of ``linear_fit``. With fewer than three rows, or no range, there is no band: no rows.
    """
    row, spark = fit.first(), fit.sparkSession
    schema = "point int, x double, fitted double, fitted_se double, lower double, upper double"
    if row["residual_se"] is None or not row["sxx"]:
        return spark.createDataFrame([], schema)
    reach = t_quantile((1 + level) / 2, row["n"] - 2)
    x = F.lit(low) + F.lit(high - low) * F.col("point") / F.lit(points - 1)
    away = F.col("x") - F.lit(row["x_mean"])
    return (
        spark.range(points)
        .select(F.col("id").cast("int").alias("point"))
        .withColumn("x", x)
        .withColumn("fitted", F.lit(row["intercept"]) + F.lit(row["slope"]) * F.col("x"))
        .withColumn("fitted_se", F.lit(row["residual_se"]) * F.sqrt(1 / F.lit(float(row["n"])) + away * away / F.lit(row["sxx"])))
        .withColumn("lower", F.col("fitted") - F.lit(reach) * F.col("fitted_se"))
        .withColumn("upper", F.col("fitted") + F.lit(reach) * F.col("fitted_se"))
    )


def fit_with_band(df: DataFrame, x: str, y: str, level: float = 0.95, points: int = BAND_POINTS) -> DataFrame:
    """Line of ``y`` on ``x`` with its band over the range of ``x`` among the rows that have both. Hand over a stored frame."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    low, high = both.agg(F.min(x), F.max(x)).first()
    return fit_band(linear_fit(both, x, y), low, high, level, points)


def score_profile(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, spread and range of each score column, with the correlation of the first two."""
    per_column = F.explode(
        F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in columns])
    )
    value = F.col("col.v")
    profile = pairs.select(per_column).groupBy(F.col("col.measure").alias("measure")).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    together = pairs.agg(F.corr(columns[0], columns[1])).first()[0]
    return profile.withColumn("correlation", F.lit(together).cast("double"))
