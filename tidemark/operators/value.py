"""RFM and commercial value; priority decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import cents, clip, flag, one_place, zero
from tidemark.functions.windows import pct_ranks_average, quintiles_first
from tidemark.sources.formats import checked_join

ID = "golden_customer_id"
# Action texts of the decision groups.
ACTIONS = {
    "Protect Now": "Prioritise immediate personalised retention action",
    "Proactive Retention": "Intervene before lapse; investigate declining engagement",
    "Re-engage": "Target with relevant re-engagement offer or communication",
    "Watch Closely": "Monitor behaviour and trigger action if deterioration continues",
    "Develop": "Encourage second or next purchase and deepen engagement",
    "Maintain": "Maintain relationship and protect current customer value",
    "Acquisition Opportunity": "Encourage first purchase and assess acquisition effectiveness",
    "Low Priority": "No immediate intervention; retain in standard lifecycle activity",
}


def rfm_base(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return tx.groupBy(ID).agg(
        F.datediff(F.lit(cfg.as_of), F.max("transaction_date")).alias("recency_days"),
        F.countDistinct("order_id").alias("frequency"),
        cents(F.sum("net_sales")).alias("monetary_sales"),
        cents(F.sum("gross_margin")).alias("monetary_margin"),
    )


def rfm_scores(base: DataFrame) -> DataFrame:
    """Quintiles: recency (fewer days is better), frequency and lifetime margin; ties follow the customer id; the sum reads unknown as 0."""
    fifths = quintiles_first(base, {"_r": "recency_days", "frequency_score": "frequency", "monetary_score": "monetary_margin"}, ID)
    out = base.join(fifths, ID, "left").withColumn("recency_score", 6 - F.col("_r")).drop("_r")
    return out.withColumn("rfm_score", sum((F.coalesce(f"{x}_score", F.lit(0)) for x in ("recency", "frequency", "monetary")), F.lit(0)))


def value_tier(orders: Column, pct: Column) -> Column:
    return F.when(F.coalesce(orders, F.lit(0)) == 0, "No Purchase").when(pct >= 0.9, "Very High").when(pct >= 0.7, "High").when(pct >= 0.4, "Medium").otherwise("Low")


def rfm_segment(orders: Column, r: Column, f: Column, m: Column) -> Column:
    champion = (r >= 4) & (f >= 4) & (m >= 4)
    return (
        F.when(F.coalesce(orders, F.lit(0)) == 0, "No Purchase")
        .when(flag(champion), "Champions")
        .when(flag((r >= 3) & (f >= 4) & (m >= 3)), "Loyal")
        .when(flag((m >= 4) & (r <= 2)), "Historically Valuable")
        .when(flag((m == 5) & ~champion), "High Value")
        .when(flag((r >= 4) & (f <= 3)), "Developing")
        .when(flag(f.isin(2, 3) & (r >= 2)), "Occasional")
        .when(flag((f <= 2) & (m <= 2)), "Low Engagement")
        .otherwise("Core")
    )


def add_value(df: DataFrame) -> DataFrame:
    """customer_value_tier and commercial_value_score from trailing margin and sales and the number of orders."""
    base = df.withColumns({"_m": cents(zero(F.col("trailing_12m_margin"))), "_s": cents(zero(F.col("trailing_12m_sales")))})
    out = base.join(pct_ranks_average(base, {"margin_pct": "_m", "sales_pct": "_s"}, ID), ID)
    score = one_place(100 * (0.65 * F.col("margin_pct") + 0.35 * F.col("sales_pct")))
    none = F.coalesce("orders", F.lit(0)) == 0
    return out.withColumns({"customer_value_tier": value_tier(F.col("orders"), F.col("margin_pct")), "commercial_value_score": F.when(none, 0.0).otherwise(score)}).drop("_m", "_s", "margin_pct", "sales_pct")


def customer_value(tx: DataFrame, features: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """RFM scores, segment, tier and commercial score of every customer."""
    scored = features.select(ID, "orders", "net_sales", "gross_margin", "trailing_12m_orders", "trailing_12m_sales", "trailing_12m_margin").join(rfm_scores(rfm_base(tx, cfg)), ID, "left")
    out = add_value(scored.withColumn("rfm_score", F.coalesce("rfm_score", F.lit(0))))
    return out.withColumn("rfm_segment", rfm_segment(F.col("orders"), F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")))


def lapse_score(ratio: Column, confidence: Column) -> Column:
    r = F.coalesce(ratio, F.lit(0.0))
    raw = F.when(r < 1, 40 * r).when(r < 1.5, 40 + (r - 1) / 0.5 * 20).when(r < 2, 60 + (r - 1.5) / 0.5 * 20).when(r < 3, 80 + (r - 2) * 20).otherwise(100.0)
    return F.when(confidence == "Low", 0.0).otherwise(one_place(clip(raw, 0, 100)))


def momentum_score(trend: Column) -> Column:
    return F.when(trend == "Strongly Deteriorating", 100.0).when(trend == "Deteriorating", 70.0).when(trend == "Stable / Mixed", 20.0).otherwise(0.0)


def priority_score(value: Column, lapse: Column, momentum: Column) -> Column:
    return one_place(clip(0.40 * value + 0.35 * lapse + 0.25 * momentum, 0, 100))


def priority_band(score: Column) -> Column:
    return F.when(score >= 75, "Critical").when(score >= 55, "High").when(score >= 35, "Medium").otherwise("Low")


def decision_group(tier: Column, lifecycle: Column, trend: Column, segment: Column, active: Column, orders: Column) -> Column:
    high, some = tier.isin("High", "Very High"), tier.isin("Medium", "High", "Very High")
    hard, early, healthy = lifecycle.isin("At Risk", "Highly Lapsed"), lifecycle == "Watch", lifecycle == "On Cadence"
    strong, worse, better = trend == "Strongly Deteriorating", trend.isin("Deteriorating", "Strongly Deteriorating"), trend == "Improving"
    return (
        F.when((tier == "No Purchase") | (orders == 0), "Acquisition Opportunity")
        .when(high & hard, "Protect Now")
        .when(high & healthy & worse, "Proactive Retention")
        .when(some & strong, "Proactive Retention")
        .when(some & hard, "Re-engage")
        .when(some & (early | worse), "Watch Closely")
        .when((segment == "Developing") & active, "Develop")
        .when(high & healthy & ~worse, "Maintain")
        .when(better & some, "Maintain")
        .otherwise("Low Priority")
    )


def recommended_action(group: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[group]


def customer_priority(value: DataFrame, features: DataFrame, momentum: DataFrame, trend: DataFrame) -> DataFrame:
    """Scores, decision group, action and band of every customer."""
    out = checked_join(value, features.select(ID, "lifecycle_status", "cadence_confidence", "adjusted_lapse_ratio", "active_customer", "days_since_last_purchase"), [ID])
    out = checked_join(out, momentum.select(ID, "momentum_status", "momentum_risk_signals", "order_change_pct", "sales_change_pct"), [ID])
    out = checked_join(out, trend.select(ID, "trend_gaps", "gap_trend_pct", "cadence_trend_status"), [ID])
    out = out.withColumns({"value_score": clip(zero(F.col("commercial_value_score")), 0, 100), "lapse_score": lapse_score(F.col("adjusted_lapse_ratio"), F.col("cadence_confidence")), "momentum_score": momentum_score(F.col("cadence_trend_status"))})
    out = out.withColumn("priority_score", priority_score(F.col("value_score"), F.col("lapse_score"), F.col("momentum_score")))
    group = decision_group(F.col("customer_value_tier"), F.col("lifecycle_status"), F.col("cadence_trend_status"), F.col("rfm_segment"), F.col("active_customer"), F.col("orders"))
    return out.withColumn("decision_group", group).withColumns({"recommended_action": recommended_action(F.col("decision_group")), "priority_band": priority_band(F.col("priority_score"))})
