"""Presentation queries, generic table operations and quality checks over the customer tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.quantiles import with_quantiles
from tidemark.functions.scalars import cents, safe_divide

ID = "golden_customer_id"
LIFECYCLE = ("On Cadence", "Watch", "At Risk", "Highly Lapsed", "Active / Limited History", "Inactive / Limited History", "Acquired / Never Purchased", "Unclassified")


def apply_filters(df: DataFrame, state: str = "All", segment: str = "All", tier: str = "All") -> DataFrame:
    """The dashboard's filter chain; All leaves a filter out."""
    for column, value in (("state", state), ("rfm_segment", segment), ("customer_value_tier", tier)):
        if value != "All":
            df = df.where(F.col(column) == value)
    return df


def distribution(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Customers by value over a fixed domain in its order, absent values with 0, and their share."""
    spark = df.sparkSession
    full = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"position long, {column} string")
    out = full.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").withColumn("customers", F.coalesce("n", F.lit(0)))
    return out.select("position", column, "customers", (F.col("customers") / F.sum("customers").over(Window.partitionBy())).alias("share"))  # a row for each domain value


def executive_kpis(priority: DataFrame) -> DataFrame:
    group = F.col("decision_group")
    return priority.agg(
        F.count("*").alias("customers"),
        F.count_if("active_customer").alias("active_customers"),
        F.avg(F.col("active_customer").cast("int")).alias("active_rate"),
        F.count_if(group == "Protect Now").alias("protect_now"),
        F.count_if(group == "Proactive Retention").alias("proactive_retention"),
        F.sum(F.when(F.col("priority_band").isin("Critical", "High"), F.col("trailing_12m_margin")).otherwise(0.0)).alias("priority_margin"),
        F.sum("trailing_12m_sales").alias("trailing_sales"),
        F.sum("trailing_12m_margin").alias("trailing_margin"),
    )


def exposure_by_group(priority: DataFrame) -> DataFrame:
    """Customers, margin, sales and mean priority of each decision group."""
    return priority.groupBy("decision_group").agg(F.count("*").alias("customers"), F.sum("trailing_12m_margin").alias("margin"), F.sum("trailing_12m_sales").alias("sales"), F.avg("priority_score").alias("avg_priority"))


def segment_summary(priority: DataFrame) -> DataFrame:
    """Medians, rates and share of customers of each RFM segment."""
    g = priority.groupBy("rfm_segment").agg(F.count("*").alias("customers"), F.avg(F.col("active_customer").cast("int")).alias("active_rate"), F.sum(F.when(F.col("customer_value_tier").isin("High", "Very High"), 1).otherwise(0)).alias("high_value"))
    g = g.withColumn("share", F.col("customers") / F.sum("customers").over(Window.partitionBy()))  # a row for each segment
    return with_quantiles(g, priority, ["rfm_segment"], {"median_orders": "orders", "median_recency": "recency_days"})


def value_mix(priority: DataFrame) -> DataFrame:
    """Share of each value tier inside its segment."""
    g = priority.groupBy("rfm_segment", "customer_value_tier").agg(F.count("*").alias("customers"))
    return g.withColumn("share", F.col("customers") / F.sum("customers").over(Window.partitionBy("rfm_segment")))


def decision_queue(priority: DataFrame, groups: Sequence[str], least: float, size: int) -> DataFrame:
    """The customers to act on first: highest priority, then margin, then id."""
    q = priority.where(F.col("decision_group").isin(*groups) & (F.col("priority_score") >= least))
    return q.orderBy(F.desc("priority_score"), F.desc(cents(F.col("trailing_12m_margin"))), ID).limit(size).select(ID, "decision_group", "priority_score", "priority_band", "customer_value_tier")


def watchlist(priority: DataFrame, size: int = 20) -> DataFrame:
    """High-value customers whose cadence worsens."""
    w = priority.where(F.col("customer_value_tier").isin("High", "Very High") & F.col("cadence_trend_status").isin("Deteriorating", "Strongly Deteriorating"))
    return w.orderBy(F.desc("priority_score"), F.desc(F.round("gap_trend_pct", 6)), ID).limit(size).select(ID, "priority_score", "cadence_trend_status")


def cross_tab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Row percentages of counts by two columns."""
    p = df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return p.select(rows, *[safe_divide(100 * F.col(f"`{v}`"), total).alias(v.lower().replace(" ", "_")) for v in values])


def monthly_history(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.trunc("transaction_date", "MM").alias("month")).agg(F.countDistinct("order_id").alias("orders"), F.countDistinct(ID).alias("customers"), F.sum("net_sales").alias("sales"))


def mix(tx: DataFrame, column: str) -> DataFrame:
    """Orders and share of sales by channel or category."""
    g = tx.groupBy(column).agg(F.count("*").alias("orders"), F.sum("net_sales").alias("sales"))
    return g.withColumn("sales_share", F.col("sales") / F.sum("sales").over(Window.partitionBy()))  # a row for each value


def last_transactions(tx: DataFrame, size: int = 20) -> DataFrame:
    """The latest orders of each customer."""
    nth = F.row_number().over(Window.partitionBy(ID).orderBy(F.desc("transaction_date"), F.desc("order_id")))
    return tx.withColumn("nth", nth).where(F.col("nth") <= size).select(ID, "nth", "order_id", "transaction_date", "net_sales")


def movement_long(growth: DataFrame) -> DataFrame:
    """Monthly movement in long form."""
    return growth.select("month", "new_customers", "reactivated_customers", "lapsed_customers").unpivot("month", ["new_customers", "reactivated_customers", "lapsed_customers"], "movement", "customers")


def retention_heatmap(retention: DataFrame, ages: int = 12) -> DataFrame:
    """One row a cohort, one column an age."""
    p = retention.where(F.col("age_months") < ages).groupBy("cohort_month").pivot("age_months", list(range(ages))).agg(F.first("retention_rate"))
    return p.select("cohort_month", *[F.col(str(i)).alias(f"m{i}") for i in range(ages)])


def stratified_sample(df: DataFrame, column: str, size: int, seed: int = 42) -> DataFrame:
    """About `size` rows in proportion to each value's share, one at least, chosen by a hash of the id.

    Each of 64 parts of a value offers its first rows, so no task ranks a whole value.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    quota = counts.withColumn("_q", F.greatest(F.lit(1), F.floor(size * F.col("_n") / F.sum("_n").over(Window.partitionBy()) + 0.5))).drop("_n")  # a row for each value
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(ID).cast("string")).cast("binary"))
    hashed = df.join(quota, column).withColumns({"_h": h, "_part": F.pmod(F.xxhash64(ID), F.lit(64))})
    for keys in ([column, "_part"], [column]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", ID))
        hashed = hashed.withColumn("_nth", nth).where(F.col("_nth") <= F.col("_q"))
    return hashed.drop("_q", "_nth", "_h", "_part")


def uniform_sample(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """`size` rows (all, if there are fewer) with the least hashes of the id."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(ID).cast("string")).cast("binary"))
    return df.orderBy(h, ID).limit(size)


def slugged(df: DataFrame) -> DataFrame:
    """Columns named in lower case, each run of other characters than letters and digits as one underscore; names that then meet get a number."""
    names: list[str] = []
    for c in df.columns:
        name = base = re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") or "column"
        nth = 2
        while name in names:
            name, nth = f"{base}_{nth}", nth + 1
        names.append(name)
    return df.toDF(*names)


def search_customers(master: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search over state and segment."""
    needle = F.lit(text.lower())
    return master.where(F.lower("state").contains(needle) | F.lower("market_segment").contains(needle))


def lapse_by_lifecycle(features: DataFrame) -> DataFrame:
    """Customers and median lapse ratio of each lifecycle status."""
    g = features.groupBy("lifecycle_status").agg(F.count("*").alias("customers"))
    return with_quantiles(g, features, ["lifecycle_status"], {"median_lapse_ratio": "adjusted_lapse_ratio"})


def commercial_summary(priority: DataFrame) -> DataFrame:
    """Sales, margin and risk counts of each segment."""
    group = F.col("decision_group")
    return priority.groupBy("rfm_segment").agg(
        F.count("*").alias("customers"),
        F.sum("trailing_12m_sales").alias("sales"),
        F.sum("trailing_12m_margin").alias("margin"),
        F.count_if(group == "Protect Now").alias("protect_now"),
        F.count_if(group == "Proactive Retention").alias("proactive_retention"),
        F.avg("priority_score").alias("avg_priority"),
    )


def identity_evidence(resolution: DataFrame) -> DataFrame:
    """Records, systems and confidence behind each golden customer."""
    g = resolution.groupBy(ID).agg(F.count("*").alias("records"), F.concat_ws(" | ", F.array_sort(F.collect_set("source_system"))).alias("systems"), F.max("match_confidence").alias("best_confidence"), F.min("match_confidence").alias("least_confidence"))
    return g


def queue_kpis(priority: DataFrame, groups: Sequence[str], least: float) -> DataFrame:
    """Size, exposure and mean priority of a decision queue, by band."""
    q = priority.where(F.col("decision_group").isin(*groups) & (F.col("priority_score") >= least))
    return q.groupBy("priority_band").agg(F.count("*").alias("customers"), F.sum("trailing_12m_margin").alias("margin"), F.avg("priority_score").alias("avg_priority"), F.count_if(F.col("customer_value_tier") == "Very High").alias("very_high_value"))


def growth_signals(growth: DataFrame, months: int = 12) -> DataFrame:
    """Movement of the last months against the months before them, in one row."""
    last = Window.orderBy(F.desc("month"))  # a row for each month
    g = growth.withColumn("_n", F.row_number().over(last))
    now, past = F.col("_n") <= months, F.col("_n").between(months + 1, 2 * months)
    part = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    out = g.agg(*[part(c, w).alias(f"{p}_{c}") for c in ("new_customers", "reactivated_customers", "lapsed_customers", "net_change") for p, w in (("recent", now), ("previous", past))], F.max(F.when(F.col("_n") == 1, F.col("closing_customers"))).alias("closing_customers"))
    signal = F.when(F.col("recent_net_change") < 0, "Shrinking").when(F.col("recent_net_change") < F.col("previous_net_change"), "Slowing").otherwise("Growing")
    return out.withColumn("growth_signal", signal)


def cohort_attention(cohorts: DataFrame, size: int = 10) -> DataFrame:
    """The cohorts whose six-month retention lies furthest below their benchmark."""
    return cohorts.where("m6_delta is not null").orderBy(F.round("m6_delta", 6), "cohort_month").limit(size).select("cohort_month", "customers", "m6_delta", "cohort_trend")


def action_queue(nba: DataFrame, actions: Sequence[str], least_confidence: float, size: int) -> DataFrame:
    """The best supported interventions of the chosen actions."""
    q = nba.where(F.col("recommended_action_nba").isin(*actions) & (F.col("action_confidence") >= least_confidence))
    return q.orderBy(F.desc("action_confidence"), F.desc("action_score"), ID).limit(size).select(ID, "recommended_action_nba", "action_confidence", "action_score")


def action_kpis(nba: DataFrame) -> DataFrame:
    """Customers with an intervention, its margin and how many pay, in one row."""
    acts = F.col("recommended_action_nba") != "Do Nothing"
    return nba.agg(F.count("*").alias("customers"), F.count_if(acts).alias("interventions"), F.sum(F.when(acts, F.col("action_margin")).otherwise(0.0)).alias("margin"), F.count_if("economically_positive").alias("economically_positive"))


def formatted_kpis(kpis: DataFrame) -> DataFrame:
    """Display texts of the executive figures."""
    return kpis.select(F.format_number("customers", 0).alias("customers"), F.concat(F.format_number(100 * F.col("active_rate"), 1), F.lit("%")).alias("active_rate"), F.concat(F.lit("$"), F.format_number("trailing_sales", 0)).alias("trailing_sales"))
