"""Cohorts, fixed-window lifetime value, monthly movement and the value funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import month_age, safe_divide

ID = "golden_customer_id"


def customer_ltv(tx: DataFrame, master: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Lifetime sums, days to the second order, and sales and margin of the first N months where the customer is old enough."""
    first = tx.groupBy(ID).agg(F.min("transaction_date").alias("first_purchase_date"))
    nth = F.row_number().over(Window.partitionBy(ID).orderBy("transaction_date", "order_id"))
    second = tx.select(ID, "transaction_date", "order_id").distinct().withColumn("nth", nth).where("nth = 2").select(ID, F.col("transaction_date").alias("second_purchase_date"))
    joined = tx.join(first, ID)
    aggs = [F.countDistinct("order_id").alias("lifetime_orders"), F.sum("net_sales").alias("lifetime_sales"), F.sum("gross_margin").alias("lifetime_margin")]
    for n in cfg.ltv_months:
        inside = F.col("transaction_date") < F.add_months("first_purchase_date", n)
        aggs += [F.sum(F.when(inside, F.col("net_sales")).otherwise(0.0)).alias(f"_s{n}"), F.sum(F.when(inside, F.col("gross_margin")).otherwise(0.0)).alias(f"_m{n}")]
    sums = joined.groupBy(ID, "first_purchase_date").agg(*aggs)
    out = master.select(ID).join(sums, ID, "left").join(second, ID, "left")
    out = out.withColumns({
        "cohort_month": F.trunc("first_purchase_date", "MM"),
        "tenure_days": F.datediff(F.lit(cfg.as_of), "first_purchase_date"),
        "days_to_second_purchase": F.datediff("second_purchase_date", "first_purchase_date"),
        "has_purchased": F.col("first_purchase_date").isNotNull(),
        "repeat_customer": F.coalesce(F.col("lifetime_orders") >= 2, F.lit(False)),
        "lifetime_margin_rate": safe_divide(F.col("lifetime_margin"), F.col("lifetime_sales")),
    })
    for n in cfg.ltv_months:
        mature = F.coalesce(F.add_months("first_purchase_date", n) <= F.lit(cfg.as_of), F.lit(False))
        out = out.withColumns({f"m{n}_mature": mature, f"m{n}_sales": F.when(mature, F.col(f"_s{n}")), f"m{n}_margin": F.when(mature, F.col(f"_m{n}"))})
    return out.drop(*[f"_{x}{n}" for x in "sm" for n in cfg.ltv_months])


def cohort_retention(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Active customers by cohort and age on a dense grid up to as_of."""
    first = tx.groupBy(ID).agg(F.trunc(F.min("transaction_date"), "MM").alias("cohort_month"))
    sizes = first.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
    active = tx.join(first, ID).withColumn("age_months", month_age(F.col("transaction_date"), F.col("cohort_month"))).groupBy("cohort_month", "age_months").agg(F.countDistinct(ID).alias("active"))
    grid = sizes.withColumn("age_months", F.explode(F.sequence(F.lit(0), month_age(F.lit(cfg.as_of), F.col("cohort_month")))))
    out = grid.join(active, ["cohort_month", "age_months"], "left").withColumn("active_customers", F.coalesce("active", F.lit(0))).drop("active")
    return out.withColumn("retention_rate", F.col("active_customers") / F.col("cohort_size"))


def movement_events(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """New, Lapsed and Reactivated events: with two earlier gaps, a gap above twice the median of the earlier ones (7 days at least) is a lapse."""
    days = tx.select(ID, "transaction_date").distinct()
    by = Window.partitionBy(ID).orderBy("transaction_date")
    past = F.lag("transaction_date").over(by)
    g = days.withColumns({"prev": past, "gap": F.datediff("transaction_date", past), "last": F.max("transaction_date").over(Window.partitionBy(ID))})
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumns({"n_prior": F.count("gap").over(earlier), "med_prior": F.percentile("gap", F.lit(0.5)).over(earlier)})
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"n_all": F.count("gap").over(upto), "med_all": F.percentile("gap", F.lit(0.5)).over(upto)})
    limit = lambda med: cfg.lapse_multiple * F.greatest(F.lit(float(cfg.min_expected_return_days)), med)
    event = lambda kind, day, change: F.struct(F.lit(kind).alias("event_type"), day.alias("event_date"), F.lit(change).alias("change"))
    lapsed_at = lambda day, med: F.date_add(day, F.ceil(limit(med)).cast("int"))
    broke = (F.col("n_prior") >= 2) & (F.col("gap") > limit(F.col("med_prior")))
    open_gap = F.datediff(F.lit(cfg.as_of), F.col("transaction_date"))
    ended = (F.col("transaction_date") == F.col("last")) & (F.col("n_all") >= 2) & (open_gap > limit(F.col("med_all")))
    events = F.array(
        F.when(F.col("prev").isNull(), event("New", F.col("transaction_date"), 1)),
        F.when(broke, event("Lapsed", lapsed_at(F.col("prev"), F.col("med_prior")), -1)),
        F.when(broke, event("Reactivated", F.col("transaction_date"), 1)),
        F.when(ended, event("Lapsed", lapsed_at(F.col("transaction_date"), F.col("med_all")), -1)),
    )
    out = g.select(ID, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(ID, "e.*")
    return out.where(F.col("event_date") <= F.lit(cfg.as_of))


def growth_monthly(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Distinct customers by month and event, net change, opening and closing customers."""
    kinds = ["New", "Reactivated", "Lapsed"]
    wide = movement_events(tx, cfg).withColumn("month", F.trunc("event_date", "MM")).groupBy("month").pivot("event_type", kinds).agg(F.countDistinct(ID))
    spine = tx.agg(F.trunc(F.min("transaction_date"), "MM").alias("a")).select(F.explode(F.sequence("a", F.trunc(F.lit(cfg.as_of), "MM"), F.expr("interval 1 month"))).alias("month"))
    out = spine.join(wide, "month", "left").fillna(0, subset=kinds).select("month", F.col("New").alias("new_customers"), F.col("Reactivated").alias("reactivated_customers"), F.col("Lapsed").alias("lapsed_customers"))
    out = out.withColumn("net_change", F.col("new_customers") + F.col("reactivated_customers") - F.col("lapsed_customers"))
    months = Window.orderBy("month")  # a row for each month
    out = out.withColumn("closing_customers", F.sum("net_change").over(months.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("opening_customers", F.coalesce(F.lag("closing_customers").over(months), F.lit(0)))


def cohort_summary(tx: DataFrame, ltv: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Cohort totals, mean windows of mature customers, retention by age, and the six-month trend against the six earlier mature cohorts."""
    per = ltv.where("has_purchased").groupBy("cohort_month").agg(
        F.count("*").alias("customers"),
        F.sum(F.col("repeat_customer").cast("int")).alias("repeat_customers"),
        F.sum("lifetime_orders").alias("orders"),
        F.sum("lifetime_sales").alias("sales"),
        F.sum("lifetime_margin").alias("margin"),
        *[F.avg(f"m{n}_margin").alias(f"_a{n}") for n in cfg.ltv_months],
    )
    kept = cohort_retention(tx, cfg)
    for n in cfg.ltv_months:
        mature = F.add_months(F.last_day("cohort_month"), n) <= F.lit(cfg.as_of)
        age = kept.where(F.col("age_months") == n).select("cohort_month", F.col("retention_rate").alias(f"_r{n}"))
        per = per.join(age, "cohort_month", "left").withColumns({f"avg_m{n}_margin": F.when(mature, F.col(f"_a{n}")), f"retention_m{n}": F.when(mature, F.col(f"_r{n}"))}).drop(f"_a{n}", f"_r{n}")
    per = per.withColumns({"repeat_rate": F.col("repeat_customers") / F.col("customers"), "sales_per_customer": F.col("sales") / F.col("customers"), "margin_per_customer": F.col("margin") / F.col("customers")})
    six = Window.partitionBy(F.col("retention_m6").isNull()).orderBy("cohort_month").rowsBetween(-6, -1)  # a row for each cohort
    bench = F.when(F.col("retention_m6").isNotNull() & (F.count("retention_m6").over(six) >= 3), F.avg("retention_m6").over(six))
    per = per.withColumn("m6_benchmark", bench).withColumn("m6_delta", F.col("retention_m6") - F.col("m6_benchmark"))
    trend = F.when(F.col("m6_delta").isNull(), "Insufficient History").when(F.col("m6_delta") <= -0.05, "Deteriorating").when(F.col("m6_delta") >= 0.05, "Improving").otherwise("Stable / Mixed")
    return per.withColumn("cohort_trend", trend)


def value_funnel(tx: DataFrame, value: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Nested stages of customers whose first order is a year old, with conversion from the stage before."""
    first = tx.groupBy(ID).agg(F.min("transaction_date").alias("first")).where(F.col("first") <= F.add_months(F.lit(cfg.as_of), -12))
    age = month_age(F.col("transaction_date"), F.col("first"))
    flags = tx.join(first, ID).groupBy(ID).agg((F.countDistinct(F.when(age.between(0, 11), F.col("order_id"))) >= 3).alias("a"), F.bool_or(age.between(6, 11)).alias("b"), F.bool_or(age >= 12).alias("c"))
    f = flags.join(value.select(ID, "customer_value_tier"), ID, "left").withColumn("d", F.coalesce(F.col("customer_value_tier").isin("High", "Very High"), F.lit(False)))
    nested: list[Column] = [F.lit(True), F.col("a"), F.col("a") & F.col("b"), F.col("a") & F.col("b") & F.col("c"), F.col("a") & F.col("b") & F.col("c") & F.col("d")]
    names = ["Acquired", "Engaged", "Retained M6+", "Retained M12+", "High Value"]
    counts = f.agg(*[F.count_if(c).alias(f"s{i}") for i, c in enumerate(nested)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(f"s{i}").alias("customers"), (F.lit(None).cast("long") if i == 0 else F.col(f"s{i - 1}")).alias("prior")) for i, n in enumerate(names)])).alias("x")).select("x.*")
    return rows.select("stage_no", "stage", "customers", safe_divide(F.col("customers"), F.col("prior")).alias("conversion_rate"))
