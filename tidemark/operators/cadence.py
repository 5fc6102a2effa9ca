"""Purchase cadence, lapse and lifecycle; momentum; long-run cadence trend."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import flag, pct_change, safe_divide, slope_p_value, zero
from tidemark.sources.formats import checked_join

ID = "golden_customer_id"


def customer_summary(tx: DataFrame, master: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """First and last purchase, orders, units, sales, margin, order value, recency and tenure; customers without orders are kept."""
    s = tx.groupBy(ID).agg(
        F.min("transaction_date").alias("first_purchase_date"),
        F.max("transaction_date").alias("last_purchase_date"),
        F.countDistinct("order_id").alias("orders"),
        F.sum("units").alias("units"),
        F.sum("net_sales").alias("net_sales"),
        F.sum("gross_margin").alias("gross_margin"),
    )
    joined = master.select(ID).join(s, ID, "left")
    return joined.withColumns({
        "orders": F.coalesce("orders", F.lit(0)),
        "units": F.coalesce("units", F.lit(0)),
        "net_sales": zero(F.col("net_sales")),
        "gross_margin": zero(F.col("gross_margin")),
        "avg_order_value": zero(safe_divide(F.col("net_sales"), F.col("orders"))),
        "days_since_last_purchase": F.datediff(F.lit(cfg.as_of), "last_purchase_date"),
        "purchase_tenure_days": F.datediff(F.lit(cfg.as_of), "first_purchase_date"),
    })


def purchase_gaps(tx: DataFrame) -> DataFrame:
    """Days between a customer's successive purchase days."""
    days = tx.select(ID, "transaction_date").distinct()
    past = F.lag("transaction_date").over(Window.partitionBy(ID).orderBy("transaction_date"))
    return days.withColumn("gap_days", F.datediff("transaction_date", past)).where("gap_days is not null")


def cadence_features(tx: DataFrame) -> DataFrame:
    """Count, median, mean, sample deviation and variation of gaps."""
    g = purchase_gaps(tx).groupBy(ID).agg(
        F.count("gap_days").alias("observed_purchase_gaps"),
        F.median("gap_days").alias("median_purchase_gap_days"),
        F.avg("gap_days").alias("mean_purchase_gap_days"),
        F.stddev_samp("gap_days").alias("std_purchase_gap_days"),
    )
    return g.withColumn("cadence_cv", safe_divide(F.col("std_purchase_gap_days"), F.col("mean_purchase_gap_days")))


def trailing_value(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Orders, sales and margin after as_of minus twelve months (exclusive)."""
    recent = tx.where(F.col("transaction_date") > F.add_months(F.lit(cfg.as_of), -cfg.trailing_months))
    return recent.groupBy(ID).agg(F.countDistinct("order_id").alias("trailing_12m_orders"), F.sum("net_sales").alias("trailing_12m_sales"), F.sum("gross_margin").alias("trailing_12m_margin"))


def cadence_confidence(gaps: Column) -> Column:
    n = F.coalesce(gaps, F.lit(0))
    return F.when(n >= 5, "High").when(n >= 2, "Medium").otherwise("Low")


def active_flag(days: Column, window: int = DEFAULT.active_window_days) -> Column:
    return flag(days <= window)


def lifecycle_status(orders: Column, confidence: Column, active: Column, ratio: Column) -> Column:
    """First matching rule; unknown ratios are unclassified."""
    return (
        F.when(orders == 0, "Acquired / Never Purchased")
        .when((confidence == "Low") & active, "Active / Limited History")
        .when((confidence == "Low") & ~active, "Inactive / Limited History")
        .when(ratio < 1, "On Cadence")
        .when(ratio < 1.5, "Watch")
        .when(ratio < 2, "At Risk")
        .when(ratio >= 2, "Highly Lapsed")
        .otherwise("Unclassified")
    )


def add_lapse(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Lapse ratios from days since the last purchase and the median gap, floored at seven days."""
    days, median = F.col("days_since_last_purchase"), F.col("median_purchase_gap_days")
    expected = F.when(median.isNotNull(), F.greatest(median, F.lit(float(cfg.min_expected_return_days))))
    return df.withColumns({"lapse_ratio": safe_divide(days, median), "expected_return_days": expected, "adjusted_lapse_ratio": safe_divide(days, expected)})


def customer_features(tx: DataFrame, master: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The feature table of every customer, one row each."""
    out = checked_join(checked_join(customer_summary(tx, master, cfg), cadence_features(tx), [ID], validate="one_to_one"), trailing_value(tx, cfg), [ID])
    out = out.withColumns({"observed_purchase_gaps": F.coalesce("observed_purchase_gaps", F.lit(0)), "trailing_12m_orders": F.coalesce("trailing_12m_orders", F.lit(0)), "trailing_12m_sales": zero(F.col("trailing_12m_sales")), "trailing_12m_margin": zero(F.col("trailing_12m_margin"))})
    out = add_lapse(out, cfg).withColumns({"cadence_confidence": cadence_confidence(F.col("observed_purchase_gaps")), "active_customer": active_flag(F.col("days_since_last_purchase"), cfg.active_window_days)})
    return out.withColumn("lifecycle_status", lifecycle_status(F.col("orders"), F.col("cadence_confidence"), F.col("active_customer"), F.col("adjusted_lapse_ratio")))


def momentum_windows(cfg: Config = DEFAULT) -> dict[str, tuple[dt.date, dt.date]]:
    """The recent window ends on as_of, the prior one on the day before it starts; both ends belong to them."""
    start = cfg.as_of - dt.timedelta(days=cfg.momentum_window_days - 1)
    return {"recent": (start, cfg.as_of), "prior": (start - dt.timedelta(days=cfg.momentum_window_days), start - dt.timedelta(days=1))}


def period_metrics(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Orders, sales, margin, units and order value of both windows in one pass."""
    aggs = [F.min("transaction_date").alias("first_purchase_date")]
    for name, (a, b) in momentum_windows(cfg).items():
        inside = F.col("transaction_date").between(F.lit(a), F.lit(b))
        aggs += [
            F.countDistinct(F.when(inside, F.col("order_id"))).alias(f"{name}_orders"),
            F.sum(F.when(inside, F.col("net_sales")).otherwise(0.0)).alias(f"{name}_sales"),
            F.sum(F.when(inside, F.col("gross_margin")).otherwise(0.0)).alias(f"{name}_margin"),
            F.sum(F.when(inside, F.col("units")).otherwise(0)).alias(f"{name}_units"),
        ]
    out = tx.groupBy(ID).agg(*aggs)
    return out.withColumns({f"{n}_aov": safe_divide(F.col(f"{n}_sales"), F.col(f"{n}_orders")) for n in ("recent", "prior")})


def period_cadence(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Median and number of gaps between purchase days of the same window."""
    label = None
    for name, (a, b) in momentum_windows(cfg).items():
        inside = F.col("transaction_date").between(F.lit(a), F.lit(b))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    days = tx.select(ID, "transaction_date").withColumn("period", label).where("period is not null").distinct()
    gap = F.datediff("transaction_date", F.lag("transaction_date").over(Window.partitionBy(ID, "period").orderBy("transaction_date")))
    g = days.withColumn("gap", gap).groupBy(ID)
    return g.agg(*[e for n in ("recent", "prior") for e in (F.median(F.when(F.col("period") == n, F.col("gap"))).alias(f"{n}_median_gap"), F.count(F.when(F.col("period") == n, F.col("gap"))).alias(f"{n}_gaps"))])


def momentum_status(comparable: Column, prior_orders: Column, recent_orders: Column, risk: Column, strong: Column, orders: Column, sales: Column) -> Column:
    return (
        F.when(~comparable | (prior_orders == 0), "Insufficient History")
        .when((prior_orders > 0) & (recent_orders == 0), "No Recent Purchase")
        .when(strong >= 2, "Strongly Deteriorating")
        .when(risk >= 2, "Deteriorating")
        .when(flag((orders >= 0.25) & (sales >= 0.25)), "Improving")
        .otherwise("Stable / Mixed")
    )


def customer_momentum(tx: DataFrame, master: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Changes between the two windows, risk signals and status of every customer."""
    m = master.select(ID).join(period_metrics(tx, cfg), ID, "left").join(period_cadence(tx, cfg), ID, "left")
    counts = [f"{n}_{x}" for n in ("recent", "prior") for x in ("orders", "sales", "margin", "units", "gaps")]
    m = m.fillna(0, subset=counts)
    prior_end = momentum_windows(cfg)["prior"][1]
    m = m.withColumns({
        "order_change_pct": pct_change(F.col("recent_orders"), F.col("prior_orders")),
        "sales_change_pct": pct_change(F.col("recent_sales"), F.col("prior_sales")),
        "margin_change_pct": pct_change(F.col("recent_margin"), F.col("prior_margin")),
        "aov_change_pct": pct_change(F.col("recent_aov"), F.col("prior_aov")),
        "cadence_change_pct": pct_change(F.col("recent_median_gap"), F.col("prior_median_gap")),
        "comparable_history": flag(F.col("first_purchase_date") <= F.lit(prior_end)),
    })
    m = m.withColumn("cadence_comparable", F.col("comparable_history") & (F.col("recent_gaps") >= 2) & (F.col("prior_gaps") >= 2))

    def signals(cut: float) -> Column:
        slower = flag(F.col("cadence_comparable") & (F.col("cadence_change_pct") >= cut))
        return slower.cast("int") + flag(F.col("order_change_pct") <= -cut).cast("int") + flag(F.col("sales_change_pct") <= -cut).cast("int")

    m = m.withColumns({"momentum_risk_signals": signals(0.25), "strong_momentum_risk_signals": signals(0.50)})
    return m.withColumn("momentum_status", momentum_status(*[F.col(c) for c in ("comparable_history", "prior_orders", "recent_orders", "momentum_risk_signals", "strong_momentum_risk_signals", "order_change_pct", "sales_change_pct")]))


def trend_status(n: Column, pct: Column, r2: Column, early: Column) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) < 5, "Insufficient History")
        .when(flag((pct >= 0.03) & (r2 >= 0.20) & (early >= 0.25)), "Strongly Deteriorating")
        .when(flag((pct >= 0.015) & (early >= 0.15)), "Deteriorating")
        .when(flag((pct <= -0.015) & (early <= -0.15)), "Improving")
        .otherwise("Stable / Mixed")
    )


def cadence_trend(tx: DataFrame, master: DataFrame) -> DataFrame:
    """Slope and fit of gaps over their sequence, and the later half's median against the earlier half's, from five gaps on."""
    by = Window.partitionBy(ID)
    g = purchase_gaps(tx).withColumns({"seq": F.row_number().over(by.orderBy("transaction_date")), "n": F.count("*").over(by)})
    early = F.col("seq") <= F.floor(F.col("n") / 2)
    t = g.groupBy(ID).agg(
        F.count("*").alias("trend_gaps"),
        F.regr_slope("gap_days", "seq").alias("slope"),
        F.when(F.var_pop("gap_days") == 0, 0.0).otherwise(F.regr_r2("gap_days", "seq")).alias("trend_r2"),
        F.median("gap_days").alias("med"),
        F.median(F.when(early, F.col("gap_days"))).alias("early"),
        F.median(F.when(~early, F.col("gap_days"))).alias("late"),
    )
    enough = F.col("trend_gaps") >= 5
    t = t.select(
        ID,
        "trend_gaps",
        F.when(enough, F.col("slope")).alias("trend_slope"),
        F.when(enough, F.col("trend_r2")).alias("trend_r2"),
        F.when(enough, slope_p_value(F.col("trend_r2"), F.col("trend_gaps"))).alias("trend_p_value"),
        F.when(enough & (F.col("med") > 0), F.col("slope") / F.col("med")).alias("gap_trend_pct"),
        F.when(enough & (F.col("early") > 0), (F.col("late") - F.col("early")) / F.col("early")).alias("recent_vs_early_pct"),
    )
    out = master.select(ID).join(t, ID, "left").withColumn("trend_gaps", F.coalesce("trend_gaps", F.lit(0)))
    return out.withColumn("cadence_trend_status", trend_status(F.col("trend_gaps"), F.col("gap_trend_pct"), F.col("trend_r2"), F.col("recent_vs_early_pct")))
