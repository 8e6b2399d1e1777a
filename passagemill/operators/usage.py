"""Usage and evaluation (M1-M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import STEPS

CACHED_SHARE = 0.1
HITS_AT = (5, 15)


def usage_legs(legs: DataFrame, prices: DataFrame, default: str) -> DataFrame:
    """M1: legs(question_id, leg, model, input_tokens, cached_tokens, output_tokens) with their cost.

    prices(model, input_price, output_price) in USD a million tokens; an unknown model has the price of
    ``default``. Cached tokens are at least 0 and at most the input, at a tenth of its price.
    """
    usual = prices.where(F.col("model") == default).select(F.col("input_price").alias("__in"), F.col("output_price").alias("__out"))
    rows = legs.join(prices, "model", "left").crossJoin(F.broadcast(usual.limit(1)))
    tokens = F.coalesce("input_tokens", F.lit(0))
    cached = F.greatest(F.lit(0), F.least(F.coalesce("cached_tokens", F.lit(0)), tokens))
    price_in, price_out = F.coalesce("input_price", "__in"), F.coalesce("output_price", "__out")
    cost = ((tokens - cached) * price_in + cached * price_in * CACHED_SHARE + F.coalesce("output_tokens", F.lit(0)) * price_out) / 1e6
    return rows.select("question_id", "leg", "model", tokens.alias("input_tokens"), cached.alias("cached_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), cost.alias("cost_usd"))


def usage_totals(costed: DataFrame) -> DataFrame:
    """M2: the sums of each question over its legs, and the legs by name."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "cost_usd")]
    by_leg = costed.groupBy("question_id", "leg").agg(*sums)
    leg = F.struct("input_tokens", "cached_tokens", "output_tokens", "cost_usd")
    return by_leg.groupBy("question_id").agg(*sums, F.map_from_entries(F.collect_list(F.struct("leg", leg))).alias("legs"))


def step_fields(timings: DataFrame) -> DataFrame:
    """M3: timings(question_id, seq, step, ms) as a column for each known step: waits add up, others keep the first."""
    ms = F.greatest(F.lit(0), F.col("ms"))
    value = lambda step: F.sum(F.when(F.col("step") == step, ms)) if step.endswith("_wait") else F.min_by(ms, F.when(F.col("step") == step, F.col("seq")))
    return timings.where(F.col("step").isin(STEPS)).groupBy("question_id").agg(*(value(s).alias(f"{s}_ms") for s in STEPS))


def question_records(states: DataFrame, totals: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """M4: a record a question; failed wins over search_error, this over no_context."""
    outcome = F.when(F.col("failed"), "failed").when(F.coalesce("error", F.lit("")) != "", "search_error").when(F.coalesce("context_block", F.lit("")) == "", "no_context").otherwise("answered")
    rows = states.withColumn("outcome", outcome).drop("failed", "error", "context_block").join(totals, "question_id", "left")
    return rows if timings is None else rows.join(step_fields(timings), "question_id", "left")


def valid_measures(rows: DataFrame) -> DataFrame:
    """rows(fingerprint, question_id, rank) with reject_reason, null where valid."""
    reason = F.when(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)), "fingerprint")
    reason = reason.when(~F.coalesce(F.col("question_id").rlike("^[0-9]+$"), F.lit(False)), "question_id").when(F.col("rank") < 0, "rank")
    return rows.withColumn("reject_reason", reason)


def hits_at_k(measure: DataFrame) -> DataFrame:
    """M5: (k, hits): ranks below k."""
    rows = measure.select("rank", F.explode(F.array(*map(F.lit, HITS_AT))).alias("k"))
    return rows.groupBy("k").agg(F.sum(F.coalesce((F.col("rank") < F.col("k")).cast("int"), F.lit(0))).alias("hits"))


def compare_measures(current: DataFrame, reference: DataFrame, tolerance: int = 0) -> DataFrame:
    """(k, reference, current, delta, ok, lost, error) of two measures."""
    joined = current.select("question_id", F.col("rank").alias("now"), F.col("fingerprint").alias("f1"), F.lit(True).alias("a")).join(
        reference.select("question_id", F.col("rank").alias("then"), F.col("fingerprint").alias("f2"), F.lit(True).alias("b")), "question_id", "full_outer"
    )
    rows = joined.withColumn("k", F.explode(F.array(*map(F.lit, HITS_AT))))
    hit = lambda c: F.coalesce(F.col(c) < F.col("k"), F.lit(False))
    lost = F.collect_list(F.when(hit("then") & ~hit("now"), F.col("question_id").cast("long")))
    changed = F.max((F.col("a").isNull() | F.col("b").isNull()).cast("int")) == 1
    stale = F.coalesce(F.max("f1") != F.max("f2"), F.lit(False))
    out = rows.groupBy("k").agg(F.sum(hit("then").cast("int")).alias("reference"), F.sum(hit("now").cast("int")).alias("current"), F.array_join(F.array_sort(lost), ", ").alias("lost"), F.when(stale, "stale fingerprint").when(changed, "question set changed").alias("error"))
    delta = F.col("current") - F.col("reference")
    signed = F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))
    return out.withColumns({"delta": signed, "ok": F.col("error").isNull() & (delta >= -tolerance)})


