"""Rate lookup: prioritised keys, validity periods, tiers and layers. Rates are parameters; none are built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import model_candidates
from ..schema import TOKEN_BUCKETS

RATES = TOKEN_BUCKETS


def overlay(layers: DataFrame) -> DataFrame:
    """Of each key the rows of its highest layer (its base, or its tiers). Periods are overlaid on their own: a key
    that the upper layer gives no periods keeps the lower layer's."""
    top = layers.groupBy("key").agg(F.max("layer").alias("layer"))
    return layers.join(top, ["key", "layer"])


def resolve(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """(provider, model, key) of distinct pairs: the listed key that fits best, null if none does.

    Curated keys go before others; among those provider/id before the bare id, then the order of the candidates. Runs
    on the distinct pairs before the facts are touched; pairs null in either name are looked up as ''.
    """
    named = pairs.select("provider", "model").distinct()
    asked = named.withColumns({"_p": F.lower(F.trim(F.coalesce("provider", F.lit("")))), "_c": model_candidates(F.coalesce("model", F.lit("")))})
    each = asked.select("provider", "model", "_p", F.posexplode("_c").alias("rank", "cand"))
    qualified = each.where((F.col("_p") != "") & ~F.col("cand").contains("/")).select("provider", "model", F.concat_ws("/", "_p", "cand").alias("key"), F.lit(0).alias("spec"), "rank")
    keys = qualified.unionByName(each.select("provider", "model", F.col("cand").alias("key"), F.lit(1).alias("spec"), "rank"))
    found = keys.join(rates.select("key", "curated"), "key")
    best = found.groupBy(F.col("provider").alias("_bp"), F.col("model").alias("_bm")).agg(F.min_by("key", F.struct((~F.col("curated")).alias("c"), "spec", "rank")).alias("key"))
    return named.join(best, F.col("provider").eqNullSafe(F.col("_bp")) & F.col("model").eqNullSafe(F.col("_bm")), "left").select("provider", "model", "key")


def period_rates(dated: DataFrame, periods: DataFrame) -> DataFrame:
    """dated (key, day) with the rates of the first period whose last day isn't before it; rates are null past the last.

    Periods (key, through) become disjoint intervals, so that a row meets at most one.
    """
    w = Window.partitionBy("key").orderBy("through")
    spans = periods.withColumn("_after", F.lag("through").over(w)).withColumnRenamed("key", "_key")
    inside = (F.col("key") == F.col("_key")) & (F.col("day") <= F.col("through")) & (F.col("_after").isNull() | (F.col("day") > F.col("_after")))
    return dated.join(spans, inside, "left").drop("_key", "_after")


def tier_of(rows: DataFrame, tiers: DataFrame, context: str) -> DataFrame:
    """rows (with key) and the highest threshold strictly below their context, null if none: one tier for all tokens."""
    w = Window.partitionBy("key").orderBy("threshold")
    spans = tiers.withColumn("_next", F.lead("threshold").over(w)).withColumnRenamed("key", "_key")
    inside = (F.col("key") == F.col("_key")) & (F.col(context) > F.col("threshold")) & (F.col("_next").isNull() | (F.col(context) <= F.col("_next")))
    return rows.join(spans, inside, "left").drop("_key", "_next")


def component(bucket: str, rate: Column) -> Column:
    """Cost of a bucket at a rate per million; none if it has no tokens, unknown if it has and there is no rate."""
    return F.when(F.col(bucket) == 0, F.lit(0.0)).otherwise(F.col(bucket) / 1e6 * rate)


def estimate(usage: DataFrame, rates: DataFrame, tiers: DataFrame, periods: DataFrame) -> DataFrame:
    """usage with key, est_cost and est_status (free, estimated, null).

    A period in force takes precedence over tiers; a tier stands for itself, so a bucket it has no rate for is unknown; reasoning without own rate costs as output; incomplete rows and rows
    with a bucket that has tokens and no rate stay without cost.
    """
    pairs = resolve(usage, rates).withColumnsRenamed({"provider": "_p", "model": "_m"})
    keyed = usage.join(pairs, F.col("provider").eqNullSafe(F.col("_p")) & F.col("model").eqNullSafe(F.col("_m")), "left").drop("_p", "_m")
    keyed = keyed.withColumns({"day": F.when(F.col("created") > 0, F.to_date(F.timestamp_seconds("created"))), "context": F.col("input") + F.col("cache_read")})
    ask = rates.select(F.col("key").alias("_k"), "free", *(F.col(f"r_{c}").alias(f"b_{c}") for c in RATES))
    based = keyed.join(ask, F.col("key") == F.col("_k"), "left").drop("_k")
    tiered = tier_of(based, tiers.select("key", "threshold", *(F.col(f"r_{c}").alias(f"t_{c}") for c in RATES)), "context")
    priced = period_rates(tiered, periods.select("key", "through", *(F.col(f"r_{c}").alias(f"p_{c}") for c in RATES)))
    rate = lambda c: F.when(F.col("through").isNotNull(), F.col(f"p_{c}")).when(F.col("threshold").isNotNull(), F.col(f"t_{c}")).otherwise(F.col(f"b_{c}"))
    cost = component("input", rate("input")) + component("output", rate("output")) + component("reasoning", F.coalesce(rate("reasoning"), rate("output"))) + component("cache_read", rate("cache_read")) + component("cache_write", rate("cache_write"))
    est = F.when(F.col("free"), F.lit(0.0)).when(~F.col("incomplete"), cost)
    out = priced.withColumn("est_cost", est)
    status = F.when(F.col("free"), "free").when(F.col("est_cost").isNotNull(), "estimated")
    return out.withColumn("est_status", status).select(*usage.columns, "key", "est_cost", "est_status")


def apply_estimates(estimated: DataFrame) -> DataFrame:
    """Decides what an estimate does to a row that has no known cost; rows of any other status stay as they are.

    On a plan it is a counterfactual and the row counts as quota; a hosted local model is quota; local and free rows
    stay; else it is the cost, and an unknown category becomes PAID.
    """
    none, open_ = F.col("cost").isNull(), F.col("cost_status") == "unavailable"
    plan, cloud, own = F.col("billing") == "subscription", F.col("category") == "CLOUD", F.col("category").isin("LOCAL", "FREE")
    used = open_ & ~plan & ~cloud & ~own & F.col("est_status").isNotNull()
    return estimated.withColumns({
        "api_equivalent_cost": F.when(open_ & plan & none & (F.col("est_status") == "estimated"), F.col("est_cost")).otherwise(F.col("api_equivalent_cost")),
        "cost": F.when(used, F.col("est_cost")).otherwise(F.col("cost")),
        "cost_status": F.when(open_ & none & (plan | cloud), "quota").when(used, F.col("est_status")).otherwise(F.col("cost_status")),
        "category": F.when(used & (F.col("est_status") == "estimated") & (F.col("category") == "UNKNOWN"), "PAID").otherwise(F.col("category")),
    }).drop("est_cost", "est_status")


def input_rate(models: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, rate): a model's input rate for ranking, whoever provides it; null for free and unlisted models."""
    pairs = resolve(models.select(F.lit("").alias("provider"), "model"), rates)
    listed = rates.select("key", F.when(~F.coalesce("free", F.lit(False)), F.col("r_input")).alias("rate"))
    return pairs.join(listed, "key", "left").select("model", "rate")
