"""Category recommendation, promotion offers and the next best action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import cents, clip, flag, one_place, safe_divide, zero
from tidemark.functions.windows import first_by
from tidemark.sources.formats import checked_join

ID = "golden_customer_id"
# Fixed values by action: cost, base response, sales uplift, least score.
ECONOMICS = {
    "Protect": (18.0, 0.30, 0.18, 55),
    "Re-engage": (12.0, 0.24, 0.16, 50),
    "Develop": (8.0, 0.22, 0.14, 50),
    "Cross-sell": (6.0, 0.18, 0.12, 55),
    "Promote": (10.0, 0.20, 0.10, 55),
}
KEYS = {"Protect": "protect", "Re-engage": "reengage", "Develop": "develop", "Cross-sell": "cross_sell", "Promote": "promote"}
NOTHING = "Do Nothing"


def category_penetration(tx: DataFrame) -> DataFrame:
    """Share of purchasing customers that hold each category."""
    total = tx.agg(F.countDistinct(ID).alias("all_customers"))
    return tx.groupBy("category").agg(F.countDistinct(ID).alias("customers")).crossJoin(F.broadcast(total)).withColumn("penetration", F.col("customers") / F.col("all_customers"))  # one row


def min_max(value: str) -> Column:
    """Scaled to 0..1 over the table; null counts 0, a constant 0.5. For tables of a few categories."""
    every = Window.partitionBy()
    x = zero(F.col(value))
    lo, hi = F.min(x).over(every), F.max(x).over(every)
    return F.when(hi == lo, 0.5).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))


def category_margin(tx: DataFrame) -> DataFrame:
    m = tx.groupBy("category").agg(F.countDistinct("order_id").alias("orders"), cents(F.sum("net_sales")).alias("sales"), cents(F.sum("gross_margin")).alias("margin"))
    m = m.withColumns({"margin_per_order": safe_divide(F.col("margin"), F.col("orders")), "margin_rate": safe_divide(F.col("margin"), F.col("sales"))})
    return m.withColumn("margin_score", min_max("margin_per_order"))


def category_adjacency(tx: DataFrame) -> DataFrame:
    """P(customer has candidate | has source) for ordered pairs of categories."""
    owned = tx.select(ID, "category").distinct()
    sets = owned.groupBy(ID).agg(F.collect_set("category").alias("own"))
    pairs = sets.select(F.explode("own").alias("source_category"), "own").select("source_category", F.explode("own").alias("candidate_category")).where("source_category <> candidate_category")
    shared = pairs.groupBy("source_category", "candidate_category").agg(F.count("*").alias("shared_customers"))
    size = owned.groupBy(F.col("category").alias("source_category")).agg(F.count("*").alias("source_customers"))
    return shared.join(F.broadcast(size), "source_category").withColumn("adjacency", F.col("shared_customers") / F.col("source_customers"))


def score_categories(tx: DataFrame) -> DataFrame:
    """Affinity of each customer with every category not yet bought, with its rank."""
    sets = tx.groupBy(ID).agg(F.collect_set("category").alias("own"))
    every = tx.agg(F.array_sort(F.collect_set("category")).alias("every"))
    c = sets.crossJoin(F.broadcast(every)).select(ID, "own", F.explode(F.array_except("every", "own")).alias("category"))  # one row of category names
    adj = category_adjacency(tx).select("source_category", F.col("candidate_category").alias("category"), "adjacency")
    pairs = c.select(ID, "category", F.explode("own").alias("source_category")).join(F.broadcast(adj), ["source_category", "category"], "left")
    near = pairs.groupBy(ID, "category").agg(zero(F.avg("adjacency")).alias("mean_adjacency"), zero(F.max("adjacency")).alias("max_adjacency"))
    out = near.join(F.broadcast(category_penetration(tx).select("category", "penetration")), "category").join(F.broadcast(category_margin(tx).select("category", "margin_score", "margin_per_order")), "category")
    out = out.withColumn("category_affinity_score", 100 * (0.5 * F.col("mean_adjacency") + 0.25 * F.col("penetration") + 0.25 * F.col("margin_score")))
    order = Window.partitionBy(ID).orderBy(F.round("category_affinity_score", 6).desc(), F.round("mean_adjacency", 6).desc(), F.round("margin_per_order", 4).desc(), "category")
    return out.withColumn("category_rank", F.row_number().over(order))


def recommend_categories(tx: DataFrame) -> DataFrame:
    """Best three categories, the gap to the second and the confidence it gives."""
    at = lambda k, c: F.max(F.when(F.col("category_rank") == k, F.col(c)))
    s = "category_affinity_score"
    out = score_categories(tx).groupBy(ID).agg(at(1, "category").alias("recommended_category"), at(2, "category").alias("second_category"), at(3, "category").alias("third_category"), at(1, s).alias(s), (at(1, s) - F.coalesce(at(2, s), F.lit(0.0))).alias("affinity_gap"))
    gap = F.round("affinity_gap", 6)
    return out.withColumn("recommendation_confidence", F.when(gap >= 10, "High").when(gap >= 5, "Medium").otherwise("Low"))


def transaction_behaviour(tx: DataFrame) -> DataFrame:
    """Discount habits, margin rate, main category and channel of each customer."""
    base = tx.groupBy(ID).agg(
        F.countDistinct("order_id").alias("tx_orders"),
        cents(F.sum("net_sales")).alias("tx_sales"),
        cents(F.sum("gross_margin")).alias("tx_margin"),
        F.avg("net_sales").alias("tx_aov"),
        F.avg((F.col("discount_pct") > 0).cast("int")).alias("discounted_order_share"),
        F.avg("discount_pct").alias("avg_discount_pct"),
        F.countDistinct("category").alias("categories_used"),
        F.countDistinct("channel").alias("channels_used"),
    ).withColumn("tx_margin_rate", safe_divide(F.col("tx_margin"), F.col("tx_sales")))
    cat = tx.groupBy(ID, "category").agg(F.countDistinct("order_id").alias("n"), cents(F.sum("gross_margin")).alias("m"))
    cat = first_by(cat, [ID], [F.desc("n"), F.desc("m"), F.asc("category")]).select(ID, F.col("category").alias("dominant_category"), F.col("n").alias("_n"))
    ch = first_by(tx.groupBy(ID, "channel").agg(F.countDistinct("order_id").alias("n")), [ID], [F.desc("n"), F.asc("channel")]).select(ID, F.col("channel").alias("preferred_channel"))
    return base.join(cat, ID).join(ch, ID).withColumn("dominant_category_share", F.col("_n") / F.col("tx_orders")).drop("_n")


def nba_features(priority: DataFrame, behaviour: DataFrame, recommendations: DataFrame, *, ltv: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """What the action rules read; governed propensities are absent in rules mode.

    With `ltv`, observed lifetime sales and margin (0 where none is known); with `clusters`, each
    customer's cluster_name. Either may hold a customer once only.
    """
    out = priority
    if ltv is not None:
        out = checked_join(out, ltv.select(ID, F.col("lifetime_sales").alias("observed_ltv_sales"), F.col("lifetime_margin").alias("observed_ltv_margin")), [ID]).fillna(0.0, subset=["observed_ltv_sales", "observed_ltv_margin"])
    if clusters is not None:
        out = checked_join(out, clusters.select(ID, "cluster_name"), [ID]).fillna("Not Yet Clustered", subset=["cluster_name"])
    out = out.join(behaviour, ID, "left").join(recommendations.select(ID, F.col("recommended_category").alias("recommended_cross_sell_category")), ID, "left")
    trailing = safe_divide(F.col("trailing_12m_margin"), F.col("trailing_12m_sales"))
    promo = 0.7 * zero(F.col("discounted_order_share")) + 0.3 * clip(zero(F.col("avg_discount_pct")) / 0.25, 0, 1)
    return out.withColumns({
        "observed_margin_rate": clip(F.coalesce("tx_margin_rate", trailing, F.lit(0.30)), 0.1, 0.6),
        "dominant_category_share": F.coalesce("dominant_category_share", F.lit(1.0)),
        "promo_responsiveness_score": clip(promo, 0, 1),
        "risk_intensity": clip(0.6 * F.col("lapse_score") / 100 + 0.4 * F.col("momentum_score") / 100, 0, 1),
        "expected_baseline_sales": F.when(F.col("trailing_12m_sales") > 0, F.col("trailing_12m_sales")).otherwise(zero(F.col("tx_aov"))),
        "value_probability_proxy": clip(F.col("value_score") / 100, 0, 1),
    }).withColumn("category_headroom_score", clip(1 - F.col("dominant_category_share"), 0, 1))


def add_action_scores(df: DataFrame) -> DataFrame:
    """Eligibility and score (0..100, one place) of each action."""
    c = F.col
    high, some = c("customer_value_tier").isin("High", "Very High"), c("customer_value_tier").isin("Medium", "High", "Very High")
    hard, active, repeat = c("lifecycle_status").isin("At Risk", "Highly Lapsed"), flag(c("active_customer")), flag(c("orders") >= 2)
    strong, worse = c("cadence_trend_status") == "Strongly Deteriorating", c("cadence_trend_status").isin("Deteriorating", "Strongly Deteriorating")
    developing, risk, value = flag(c("rfm_segment") == "Developing"), c("risk_intensity"), c("value_probability_proxy")
    promo, head, none = c("promo_responsiveness_score"), c("category_headroom_score"), c("orders") == 0
    num = lambda x: x.cast("double")
    out = df.withColumn("eligible_protect", flag(high & (hard | strong | (worse & (risk >= 0.55)))))
    out = out.withColumns({
        "eligible_reengage": flag(some & repeat & (hard | (~active & (risk >= 0.45))) & ~c("eligible_protect")),
        "eligible_develop": flag(active & (risk < 0.60) & (developing | (c("customer_value_tier").isin("Low", "Medium") & repeat))),
        "eligible_cross_sell": flag(active & (risk < 0.45) & some & repeat & (head >= 0.35) & c("categories_used").between(2, 4)),
        "eligible_promote": flag(active & (risk < 0.45) & some & (promo >= 0.55)),
    })
    other = c("eligible_protect") | c("eligible_reengage") | c("eligible_develop") | c("eligible_cross_sell") | c("eligible_promote")
    scores = {
        "score_protect": 0.30 * value + 0.40 * risk + 0.20 * num(high) + 0.10 * num(worse),
        "score_reengage": 0.45 * risk + 0.20 * num(some) + 0.20 * num(~active) + 0.15 * num(repeat),
        "score_develop": 0.35 * num(developing) + 0.25 * num(active) + 0.20 * value + 0.20 * (1 - risk),
        "score_cross_sell": 0.20 * num(active) + 0.20 * num(some) + 0.30 * head + 0.15 * num(repeat) + 0.15 * (1 - c("dominant_category_share")),
        "score_promote": 0.50 * promo + 0.15 * num(active) + 0.15 * (1 - risk) + 0.20 * num(some),
        "score_do_nothing": 0.50 * (1 - risk) + 0.25 * (1 - value) + 0.15 * num(none) + 0.10 * num(~other),
    }
    return out.withColumns({k: one_place(clip(zero(100 * v), 0, 100)) for k, v in scores.items()})


def add_economics(df: DataFrame) -> DataFrame:
    """Response, incremental sales and margin of each action."""
    out: dict[str, Column] = {}
    for action, (cost, base, uplift, _) in ECONOMICS.items():
        key = KEYS[action]
        p = base * (0.6 + 0.8 * F.col(f"score_{key}") / 100)
        if action == "Promote":
            p = p * (0.7 + F.col("promo_responsiveness_score"))
        if action == "Cross-sell":
            p = p * (0.7 + F.col("category_headroom_score"))
        p = clip(p, 0, 0.80)
        sales = F.col("expected_baseline_sales") * uplift * p
        out |= {f"{key}_response": p, f"{key}_sales": sales, f"{key}_margin": sales * F.col("observed_margin_rate") - cost}
    return df.withColumns(out)


def select_action(df: DataFrame) -> DataFrame:
    """Protect, then Re-engage, then the best-scored of the others, else nothing; with the alternative and the confidence."""
    valid = {a: F.col(f"eligible_{KEYS[a]}") & (F.col(f"{KEYS[a]}_margin") > 0) & (F.col(f"score_{KEYS[a]}") >= ECONOMICS[a][3]) for a in ECONOMICS}
    score = {a: F.col(f"score_{KEYS[a]}") for a in ECONOMICS}
    best = lambda names: F.array_max(F.array(*[F.when(valid[a], F.struct(score[a].alias("s"), F.lit(-i).alias("i"), F.lit(a).alias("a"))) for i, a in enumerate(names)]))
    third = best(["Develop", "Cross-sell", "Promote"])
    out = df.withColumn("recommended_action_nba", F.when(valid["Protect"], "Protect").when(valid["Re-engage"], "Re-engage").otherwise(F.coalesce(third.a, F.lit(NOTHING))))
    chosen = F.col("recommended_action_nba")
    of = lambda suffix, nothing: F.coalesce(*[F.when(chosen == a, F.col(suffix.format(KEYS[a]))) for a in ECONOMICS], nothing)
    rest = F.array_max(F.array(*[F.when(valid[a] & (chosen != a), F.struct(score[a].alias("s"), F.lit(-i).alias("i"), F.lit(a).alias("a"))) for i, a in enumerate(ECONOMICS)]))
    out = out.withColumns({"action_score": of("score_{}", F.col("score_do_nothing")), "action_response": of("{}_response", F.lit(0.0)), "action_sales": of("{}_sales", F.lit(0.0)), "action_margin": of("{}_margin", F.lit(0.0)), "_alt": rest})
    evidence = F.when(F.col("cadence_confidence") == "High", 1.0).when(F.col("cadence_confidence") == "Medium", 0.7).otherwise(0.4)
    gap = F.greatest(F.lit(0.0), F.col("action_score") - F.coalesce(F.col("_alt.s"), F.when(chosen == NOTHING, F.lit(0.0)).otherwise(F.col("score_do_nothing"))))
    out = out.withColumns({"alternative_action": F.coalesce(F.col("_alt.a"), F.lit(NOTHING)), "action_confidence": one_place(100 * (0.45 * F.col("action_score") / 100 + 0.3 * gap / 100 + 0.25 * evidence))})
    drivers = [("Customer value", F.col("value_score")), ("Lapse risk", F.col("lapse_score")), ("Momentum risk", F.col("momentum_score")), ("Promotion responsiveness", F.col("promo_responsiveness_score") * 100), ("Category headroom", F.col("category_headroom_score") * 100)]
    top = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(drivers)])).n
    return out.withColumns({"primary_driver": top, "economically_positive": (chosen != NOTHING) & (F.col("action_margin") > 0)}).drop("_alt")


def rationale(cluster: Column | None = None) -> Column:
    """A sentence that explains the chosen action; it names the customer's cluster where one is given."""
    kind = F.concat(F.lit(" value "), cluster, F.lit(" customer with ")) if cluster is not None else F.lit(" value customer with ")
    chosen, cat, ch = F.col("recommended_action_nba"), F.coalesce("dominant_category", F.lit("relevant category")), F.coalesce("preferred_channel", F.lit("preferred channel"))
    return (
        F.when(chosen == "Protect", F.concat(F.col("customer_value_tier"), kind, F.lower("lifecycle_status"), F.lit(" behaviour and elevated lapse or momentum risk. Retain in person via "), ch, F.lit(".")))
        .when(chosen == "Re-engage", F.concat(F.lit("Customer of proven value has lapsed. Re-engage through "), ch, F.lit(" with "), cat, F.lit(" messages.")))
        .when(chosen == "Develop", F.lit("Active customer with room to grow. Encourage the next purchase before risk rises."))
        .when(chosen == "Cross-sell", F.concat(F.lit("Active customer centred on "), cat, F.lit("; offer "), F.coalesce("recommended_cross_sell_category", F.lit("a neighbouring category")), F.lit(".")))
        .when(chosen == "Promote", F.concat(F.lit("Customer answers promotions at a profit. Use a targeted offer via "), ch, F.lit(".")))
        .otherwise(F.lit("No action pays at present. Keep in standard lifecycle activity and watch for change."))
    )


def next_best_action(priority: DataFrame, tx: DataFrame, *, ltv: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """One explained action for each customer, with lifetime value and cluster where they are given."""
    features = nba_features(priority, transaction_behaviour(tx), recommend_categories(tx), ltv=ltv, clusters=clusters)
    return select_action(add_economics(add_action_scores(features))).withColumn("action_rationale", rationale(F.col("cluster_name") if clusters is not None else None))


def offer_candidates(priority: DataFrame, tx: DataFrame) -> DataFrame:
    """Active customers of medium value or more, times three channels and four discount depths (fixed twelve)."""
    cat = transaction_behaviour(tx).select(ID, "dominant_category", "tx_aov", "tx_margin_rate")
    who = priority.where(F.col("active_customer") & F.col("customer_value_tier").isin("Medium", "High", "Very High")).select(ID, "customer_value_tier", safe_divide(F.col("trailing_12m_margin"), F.col("trailing_12m_sales")).alias("recent_margin_rate")).join(cat, ID)
    channels = F.explode(F.array(*[F.lit(x) for x in ("Email", "SMS", "App")]))
    depths = F.explode(F.array(*[F.lit(x) for x in (0.10, 0.15, 0.20, 0.25)]))
    out = who.withColumn("campaign_channel", channels).withColumn("discount_depth", depths)
    return out.withColumn("margin_after_discount", F.greatest(F.coalesce("tx_margin_rate", "recent_margin_rate", F.lit(0.30)) - F.col("discount_depth"), F.lit(0.01)))
