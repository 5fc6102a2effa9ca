"""Putting models to use: checks of recommendations, operational promotion offers and governed next best actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import clip, one_place, zero
from tidemark.functions.windows import first_by
from tidemark.operators import decisions, propensity, snapshots
from tidemark.sources.storage import stored

ID = "golden_customer_id"


def validate_recommendations(tx: DataFrame, as_of: str, *, days: int = 180) -> DataFrame:
    """One row: customers that bought a new category within the days after as_of, and how many of those categories were in the first 1, 2 and 3 recommended from the history up to as_of."""
    day = F.lit(as_of).cast("date")
    history = tx.where(F.col("transaction_date") <= day)
    later = tx.where((F.col("transaction_date") > day) & (F.col("transaction_date") <= F.date_add(day, days)))
    before = history.groupBy(ID).agg(F.collect_set("category").alias("had"))
    new = later.groupBy(ID).agg(F.collect_set("category").alias("got")).join(before, ID).select(ID, F.array_except("got", "had").alias("new")).where(F.size("new") > 0)
    j = new.join(decisions.recommend_categories(history), ID)
    names = ["recommended_category", "second_category", "third_category"]
    hit = lambda k: F.avg(F.arrays_overlap("new", F.array_compact(F.array(*names[:k]))).cast("int"))
    return j.agg(F.count("*").alias("customers"), hit(1).alias("top1_rate"), hit(2).alias("top2_rate"), hit(3).alias("top3_rate"))


def offers_at(priority: DataFrame, tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Offer candidates with the promotion model's features on the reference date; the customer's main category is offered."""
    offers = decisions.offer_candidates(priority, tx).select(ID, "campaign_channel", "discount_depth", F.col("dominant_category").alias("offer_category"), "margin_after_discount", "tx_aov")
    unit = offers.select(ID, "offer_category").distinct().withColumns({"exposure_id": F.col(ID).cast("string"), "campaign_date": F.date_add(F.lit(cfg.as_of), 1)})
    features = snapshots.promotion_training(tx, unit).drop("exposure_id", "offer_category")
    return offers.join(features, ID)


def operational_scores(training: DataFrame, offers: DataFrame, gates: DataFrame | None, *, champion: str = "logistic", until: str = "2001-05-15", rounds: int | None = None) -> DataFrame:
    """The best offer of each customer: greatest expected contribution, then response, then the smaller discount.

    The champion is refitted on campaigns before `until` and calibrated on that one. Without a
    governance table that accepts the model no offer is made: the result is empty, with the same columns.
    """
    schema = f"{ID} long, campaign_channel string, offer_category string, discount_depth double, promotion_propensity double, expected_contribution double, propensity_band string"
    if not propensity.model_is_accepted(gates):
        return training.sparkSession.createDataFrame([], schema)
    train, names = propensity.one_hot(training.where("treatment_flag = 1"), propensity.PROMOTION_KINDS)
    target, _ = propensity.one_hot(offers, propensity.PROMOTION_KINDS)
    target = stored(target.select(ID, "campaign_channel", "offer_category", "discount_depth", "average_order_value", "margin_after_discount", *[c for c in [*propensity.PROMOTION, *names] if c not in ("discount_depth", "average_order_value")]), "offers")
    early, last = train.where(F.col("campaign_date") < F.lit(until)), train.where(F.col("campaign_date") == F.lit(until))
    z = propensity.standardised(early, {"last": last, "offers": target}, [*propensity.PROMOTION, *names])
    number, least = propensity.ROUNDS["promotion"]
    model = propensity.fit_boosted(z["train"], "responded", "exposure_id", rounds=rounds or number, least=least) if champion == "boosted" else propensity.fit_logistic(z["train"], "responded")
    turn = propensity.calibrate(propensity.with_probability(model, z["last"]), "responded")
    p = propensity.calibrated(F.col("raw_score"), turn)
    scored = propensity.with_probability(model, z["offers"]).withColumn("promotion_propensity", p)
    scored = scored.withColumn("expected_contribution", F.col("promotion_propensity") * F.col("average_order_value") * F.col("margin_after_discount"))
    best = first_by(scored, [ID], [F.desc(F.round("expected_contribution", 6)), F.desc(F.round("promotion_propensity", 9)), F.asc("discount_depth"), F.asc("campaign_channel")])
    level = propensity.probability_band(F.col("promotion_propensity"), "promotion")
    return best.select(ID, "campaign_channel", "offer_category", "discount_depth", "promotion_propensity", "expected_contribution", level.alias("propensity_band"))


def governed_actions(priority: DataFrame, tx: DataFrame, *, cross_sell: DataFrame | None = None, promotion: DataFrame | None = None) -> DataFrame:
    """Next best actions in which accepted models' probabilities (golden_customer_id, probability) weigh 0.6 of a score and replace the response rate.

    A model that is None is not accepted; its action keeps the rule's score. Customers without a probability keep it too.
    """
    features = decisions.nba_features(priority, decisions.transaction_behaviour(tx), decisions.recommend_categories(tx))
    scored = decisions.add_action_scores(features)
    given: dict[str, Column] = {}
    for key, table in (("cross_sell", cross_sell), ("promote", promotion)):
        if table is not None:
            scored = scored.join(table.select(ID, F.col("probability").alias(f"_p_{key}")), ID, "left")
            p = F.col(f"_p_{key}")
            given[key] = p
            mixed = one_place(clip(100 * (0.6 * p + 0.4 * F.col(f"score_{key}") / 100), 0, 100))
            scored = scored.withColumn(f"score_{key}", F.coalesce(mixed, F.col(f"score_{key}")))
    out = decisions.add_economics(scored)
    for key, p in given.items():
        uplift, cost = next((u, c) for a, (c, _, u, _) in decisions.ECONOMICS.items() if decisions.KEYS[a] == key)
        response = clip(p, 0, 0.80)
        sales = F.col("expected_baseline_sales") * uplift * response
        new = {f"{key}_response": response, f"{key}_sales": sales, f"{key}_margin": sales * F.col("observed_margin_rate") - cost}
        out = out.withColumns({c: F.coalesce(v, F.col(c)) for c, v in new.items()})
    out = decisions.select_action(out).withColumn("action_rationale", decisions.rationale())
    source = lambda key: F.when(F.col(f"_p_{key}").isNotNull(), "Governed model") if key in given else F.lit(None).cast("string")
    chosen = F.col("recommended_action_nba")
    how = F.coalesce(F.when(chosen == "Cross-sell", source("cross_sell")), F.when(chosen == "Promote", source("promote")), F.when(chosen == decisions.NOTHING, "No intervention"), F.lit("Business rules"))
    return out.withColumns({"decision_source": how, "action_sales": zero(F.col("action_sales"))}).drop(*[f"_p_{k}" for k in given])
