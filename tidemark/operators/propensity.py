"""Propensity models with calibration, out-of-time evaluation and governance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.quantiles import group_quantiles
from tidemark.functions.scalars import band, logit
from tidemark.functions.windows import positions, qcut_labels, running_sums
from tidemark.session import together
from tidemark.sources.formats import read_json, write_json
from tidemark.sources.storage import new_path, stored

ID, T = "golden_customer_id", "observation_date"
# The features of each model, and the columns that tell its outcome.
REENGAGEMENT = ["days_since_last_purchase", "purchase_tenure_days", "lifetime_orders", "lifetime_sales", "lifetime_margin", "lifetime_units", "avg_order_value", "avg_margin_per_order", "avg_discount_pct", "discounted_order_share", "channels_used", "categories_used", "margin_rate", "orders_prior_180d", "sales_prior_180d", "margin_prior_180d", "orders_prior_365d", "sales_prior_365d", "margin_prior_365d", "observed_purchase_gaps", "median_purchase_gap_days", "mean_purchase_gap_days", "std_purchase_gap_days", "cadence_cv", "adjusted_lapse_ratio", "order_change_pct", "sales_change_pct", "margin_change_pct", "dominant_category_share", "preferred_channel_share"]
CROSS_SELL = [*REENGAGEMENT[:13], "orders_prior_180d", "sales_prior_180d", "orders_prior_365d", "sales_prior_365d", "categories_prior_180d", "categories_prior_365d", "dominant_category_share", "dominant_category_sales_share", "category_concentration", "preferred_channel_share", "category_whitespace_count", "category_coverage_pct"]
PROMOTION = ["discount_depth", "days_since_last_purchase", "customer_tenure_days", "lifetime_orders", "lifetime_sales", "lifetime_margin", "average_order_value", "average_discount_pct", "discounted_order_share", "lifetime_categories", "lifetime_channels", "lifetime_margin_rate", "orders_prior_180d", "sales_prior_180d", "margin_prior_180d", "categories_prior_180d", "channels_prior_180d", "avg_discount_prior_180d", "discounted_order_share_prior_180d", "offer_category_prior_orders", "offer_category_prior_sales", "offer_category_order_share", "offer_category_seen_before", "recent_margin_rate", "orders_per_30d_tenure", "campaign_month_sin", "campaign_month_cos"]
PROMOTION_KINDS = {"campaign_channel": ("Email", "SMS", "App"), "offer_category": ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE")}
FORBIDDEN = ("treatment_flag", "purchased_next_90d", "future_orders_90d", "future_sales_90d", "future_margin_90d", "new_categories", "new_category_count", "cross_sell_next_180d", "responded", ID, T)
# Boosting rounds and leaves, least gains and bands of each model.
ROUNDS = {"reengagement": (220, 35), "cross_sell": (250, 40), "promotion": (250, 40)}  # boosting rounds, least rows of a leaf
DECILE_GAIN = {"cross_sell": 0.08, "promotion": 0.05}
BANDS = {"promotion": (0.5, 0.6, 0.7)}
# Least AUC, PR lift, top-decile and top-quintile lift; greatest calibration gap.
GATES = {"reengagement": (0.55, 1.10, 1.20, None, 0.05), "cross_sell": (0.60, 1.10, 1.20, 1.12, 0.05), "promotion": (0.60, 1.08, 1.15, 1.10, 0.05)}


def check_no_leakage(features: Sequence[str]) -> None:
    leaked = sorted(set(features) & set(FORBIDDEN))
    if leaked:
        raise ValueError(f"features that tell the outcome: {leaked}")


def split_by_time(df: DataFrame, train_from, validation, test) -> dict[str, DataFrame]:  # noqa: ANN001
    """train: from train_from to before validation; validation and test: those dates."""
    d = F.col(T)
    return {"train": df.where((d >= F.lit(train_from)) & (d < F.lit(validation))), "validation": df.where(d == F.lit(validation)), "test": df.where(d == F.lit(test))}


def standardised(train: DataFrame, others: dict[str, DataFrame], features: Sequence[str]) -> dict[str, DataFrame]:
    """Missing values take the training median, then training mean 0 and population deviation 1, as one vector column.

    Only features that are missing somewhere need a median; mean and deviation of the filled values
    follow from those of the values that are there. The tables are read several times: pass stored ones.
    """
    check_no_leakage(features)
    there = [F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in features]]
    stats = train.agg(*there, *[s for c in features for s in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).head()
    counts = [stats, *[df.agg(*there).head() for df in others.values()]]
    holes = [c for c in features if any(row[f"n_{c}"] < row["n"] for row in counts)]
    med = group_quantiles(train, [], {c: c for c in holes}).head() if holes else None
    fill = {c: (float(med[c]) if med and c in holes and med[c] is not None else 0.0) for c in features}
    scale = {}
    for c in features:
        n, here, mean, sd = stats["n"], stats[f"n_{c}"], float(stats[f"a_{c}"] or 0.0), float(stats[f"s_{c}"] or 0.0)
        all_mean = (here * mean + (n - here) * fill[c]) / max(1, n)
        scale[c] = (all_mean, ((here * (sd**2 + (mean - all_mean) ** 2) + (n - here) * (fill[c] - all_mean) ** 2) / max(1, n)) ** 0.5 if here < n else sd)

    def ready(df: DataFrame) -> DataFrame:
        z = df.select("*", *[((F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) - scale[c][0]) / (scale[c][1] or 1.0)).alias(f"_z_{c}") for c in features])
        return VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="vector").transform(z).drop(*[f"_z_{c}" for c in features])

    return {k: ready(df) for k, df in {"train": train, **others}.items()}


def few_parts(df: DataFrame, rows: int, each: int) -> DataFrame:
    """The rows joined to a partition for each `each` of them, and to as many as cores from 100,000 a core: a fit is many short jobs, each with a task for each partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(cores, rows // 100_000), rows // each))


def fit_logistic(train: DataFrame, label: str):  # noqa: ANN201
    n = max(1, train.count())
    rows = few_parts(train.select("vector", label), n, 250_000)
    return LogisticRegression(featuresCol="vector", labelCol=label, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=100).fit(rows)


def fit_boosted(train: DataFrame, label: str, key: str, *, rounds: int = 250, least: int = 40):  # noqa: ANN201
    """Trees of depth 4 (up to 16 leaves) with a step of 0.04, until `rounds` or until a tenth of the rows, held out by a hash of the key, is fitted no better."""
    held = F.pmod(F.xxhash64(key), F.lit(10)) == 0
    rows = few_parts(train.withColumn("_held", held).select("vector", F.col(label), "_held"), train.count(), 250_000)
    return GBTClassifier(featuresCol="vector", labelCol=label, stepSize=0.04, maxIter=rounds, maxDepth=4, minInstancesPerNode=least, validationIndicatorCol="_held", validationTol=0.001, maxMemoryInMB=512, seed=42).fit(rows)


def with_probability(model, df: DataFrame, out: str = "raw_score") -> DataFrame:  # noqa: ANN001
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def calibrate(validation: DataFrame, label: str, score: str = "raw_score") -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic fit on the score's log-odds."""
    x = VectorAssembler(inputCols=["_l"], outputCol="_v").transform(validation.withColumn("_l", logit(F.col(score))))
    m = LogisticRegression(featuresCol="_v", labelCol=label, regParam=1.0 / max(1, validation.count()), standardization=False).fit(few_parts(x, validation.count(), 250_000))
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(score: Column, fit: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(fit[0] * logit(score) + fit[1])))


def evaluate_predictions(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC from average ranks, average precision over score ties, log-loss, Brier, base rate, mean score and their gap; with `by`, of each group, all from one deal."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    d = df.select(*by, p.alias("p"), F.col(label).cast("double").alias("y"))
    v = running_sums(d.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n")), "p", ["pos", "n"], by)
    v = v.withColumns({"below": F.col("n_below"), "total": F.col("n_total"), "hits_at_least": F.col("pos_total") - F.col("pos_below")})
    auc = (F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)) - F.sum("pos") * (F.sum("pos") + 1) / 2) / (F.sum("pos") * (F.sum("n") - F.sum("pos")))
    # precision at a score counts all rows scored at least as high
    at_least, hits = F.col("total") - F.col("below"), F.col("hits_at_least")
    ap = F.sum(F.col("pos") * hits / at_least) / F.sum("pos")
    one = v.groupBy(*by).agg(auc.alias("roc_auc"), ap.alias("pr_auc"))
    rest = d.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg("y").alias("base_rate"), F.avg("p").alias("mean_probability"))
    both = rest.join(one, list(by)) if by else rest.crossJoin(one)  # one row each
    return both.withColumn("calibration_gap", F.abs(F.col("mean_probability") - F.col("base_rate")))


def ranked_by_score(df: DataFrame, score: str, key: str) -> DataFrame:
    """Adds _rank (1 is the highest score, ties by key) and _n, without a global sort or a tied score in one task."""
    return df.join(positions(df, [-F.col(score), F.col(key)], key), key)


def lift_table(df: DataFrame, score: str, label: str, key: str, *, quantiles: bool = False) -> DataFrame:
    """Deciles by score: size, actual rate, mean score and lift over all.

    With quantiles, as for re-engagement, deciles end at quantiles of the rank; else at tenths of the rows.
    """
    decile = qcut_labels(F.col("_rank"), F.col("_n"), 10) if quantiles else F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(10 * F.col("_rank") / F.col("_n"))))
    g = ranked_by_score(df, score, key).groupBy(decile.cast("int").alias("decile")).agg(F.count("*").alias("customers"), F.avg(F.col(label).cast("double")).alias("actual_rate"), F.avg(score).alias("mean_probability"))
    overall = df.agg(F.avg(F.col(label).cast("double")).alias("overall_rate"))
    return g.crossJoin(F.broadcast(overall)).withColumn("lift", F.try_divide("actual_rate", "overall_rate"))  # one row


def top_fraction_lift(df: DataFrame, score: str, label: str, key: str, fraction: float) -> DataFrame:
    """Rate among the top fraction (one row at least) over the overall rate; null where that is 0."""
    top = F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))
    y = F.col(label).cast("double")
    return ranked_by_score(df, score, key).agg(F.try_divide(F.avg(F.when(top, y)), F.avg(y)).alias("lift")).withColumn("fraction", F.lit(fraction))


def top_lifts(df: DataFrame, score: str, label: str, key: str, fractions: dict[str, float], by: Sequence[str]) -> DataFrame:
    """What top_fraction_lift gives, for each group of `by` and each name: fraction, from one deal of all rows."""
    ranked, y = positions(df, [-F.col(score), F.col(key)], key, by, [label]), F.col(label).cast("double")
    top = lambda f: F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * f))
    return ranked.groupBy(*by).agg(*[F.try_divide(F.avg(F.when(top(f), y)), F.avg(y)).alias(name) for name, f in fractions.items()])


def governance(metrics: DataFrame, decile_lift: DataFrame, quintile_lift: DataFrame, baseline_brier: DataFrame, model: str) -> DataFrame:
    """The acceptance gates as rows (gate, value, threshold, passed) and the status."""
    auc, pr, dec, qui, gap = GATES[model]
    one = metrics.crossJoin(decile_lift.select(F.col("lift").alias("_d"))).crossJoin(quintile_lift.select(F.col("lift").alias("_q"))).crossJoin(baseline_brier)  # one row each
    gates = [("roc_auc", F.col("roc_auc"), F.lit(auc), True), ("pr_auc_lift", F.try_divide("pr_auc", "base_rate"), F.lit(pr), True), ("top_decile_lift", F.col("_d"), F.lit(dec), True), ("calibration_gap", F.col("calibration_gap"), F.lit(gap), False), ("brier", F.col("brier"), F.col("baseline_brier"), False)]
    if qui is not None:
        gates.insert(3, ("top_quintile_lift", F.col("_q"), F.lit(qui), True))
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), v.cast("double").alias("value"), t.cast("double").alias("threshold"), F.coalesce(v >= t if up else v <= t, F.lit(False)).alias("passed")) for n, v, t, up in gates])
    out = one.select(F.explode(rows).alias("g")).select("g.*")
    return out.withColumn("model_status", F.when(F.every("passed").over(Window.partitionBy()), "ACCEPTED").otherwise("REJECTED"))  # six rows


def probability_band(p: Column, model: str = "") -> Column:
    low, middle, high = BANDS.get(model, (0.25, 0.50, 0.75))
    return band(p, [(low, "Low"), (middle, "Medium"), (high, "High")], "Very High")


def one_hot(df: DataFrame, kinds: dict[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """An indicator column for each known value; unknown values have none set."""
    columns = {f"{c}_is_{v.lower()}": (F.col(c) == v).cast("double") for c, values in kinds.items() for v in values}
    return df.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in columns.items()}), list(columns)


def baseline(validation: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Metrics on the test date of the constant score that is the validation date's rate."""
    rate = validation.agg(F.avg(F.col(label).cast("double")).alias("base_score"))
    return evaluate_predictions(test.crossJoin(F.broadcast(rate)), "base_score", label)  # one row


def coefficients(model, features: Sequence[str], spark) -> DataFrame:  # noqa: ANN001
    """Features of a logistic model by the size of their coefficient."""
    rows = [(f, float(c), abs(float(c)), "Increases" if c > 0 else "Decreases") for f, c in zip(features, model.coefficients, strict=True)]
    return spark.createDataFrame(sorted(rows, key=lambda r: (-r[2], r[0])), "feature string, coefficient double, strength double, direction string")


def model_is_accepted(gates: DataFrame | None) -> bool:
    """Whether a governance table says ACCEPTED, or all its gates passed; a missing or empty one does not."""
    if gates is None:
        return False
    rows = gates.take(100)  # a few gates
    if not rows:
        return False
    if "model_status" in gates.columns:
        return any(r.model_status == "ACCEPTED" for r in rows)
    return "passed" in gates.columns and all(str(r.passed).strip().lower() in ("true", "1", "yes", "pass") for r in rows)


def select_candidate(metrics: Sequence[Row], model: str) -> str:
    """The candidate with the best raw validation scores: AUC, then PR-AUC, then top-decile lift, then Brier.

    Boosted trees win only by 0.02 of AUC, or, where the model has such a rule, by its gain in top-decile lift.
    """
    rows = {r.candidate: r for r in metrics if r.split == "validation" and r.score == "raw_score"}
    order = lambda r: (-(r.roc_auc or 0), -(r.pr_auc or 0), -(r.top_decile_lift or 0) if model in DECILE_GAIN else 0, r.brier, r.candidate)
    best = min(rows.values(), key=order)
    if best.candidate != "boosted":
        return best.candidate
    gain = (best.roc_auc or 0) - (rows["logistic"].roc_auc or 0)
    lift = (best.top_decile_lift or 0) - (rows["logistic"].top_decile_lift or 0)
    return "boosted" if gain >= 0.02 or lift >= DECILE_GAIN.get(model, float("inf")) else "logistic"


@dataclass
class Governed:
    """A full out-of-time run: gates, metrics by candidate, split and score, the champion's test scores, coefficients, and what was written as metadata."""

    gates: DataFrame
    metrics: DataFrame
    scores: DataFrame
    coefficients: DataFrame
    about: dict


def governed_model(data: DataFrame, features: Sequence[str], label: str, dates: tuple, model: str, key: str, *, rounds: int | None = None) -> Governed:
    """Fit both candidates before the validation date, choose, calibrate on that date and judge on the test date.

    The metadata goes to a JSON document in the shared folder and is what its readers get back. Only
    tables of a few rows (metrics, gates) reach the driver.
    """
    spark = data.sparkSession
    rows = stored(data.where(F.col(T) >= F.lit(dates[0])).select(key, T, F.col(label).cast("double").alias(label), *features), f"{model}-rows")
    parts = split_by_time(rows, *dates)
    empty = [k for k, df in parts.items() if not df.take(1)]
    if empty:
        raise ValueError(f"no rows in {empty}")
    later = parts["validation"].withColumn("split", F.lit("validation")).unionByName(parts["test"].withColumn("split", F.lit("test")))
    z = standardised(parts["train"], {"later": later}, features)
    number, least = ROUNDS[model]
    train = z["train"].select(key, label, "vector")
    logistic, boosted = together(spark, lambda: fit_logistic(train, label), lambda: fit_boosted(train, label, key, rounds=rounds or number, least=least))
    fits = {"logistic": logistic, "boosted": boosted}
    tests = [with_probability(m, z["later"]).select(F.lit(name).alias("candidate"), "split", key, T, label, "raw_score") for name, m in fits.items()]
    scored = stored(tests[0].unionByName(tests[1]), f"{model}-raw")
    of = lambda name, split: scored.where((F.col("candidate") == name) & (F.col("split") == split))
    turns = dict(zip(fits, together(spark, *[partial(calibrate, of(name, "validation"), label) for name in fits]), strict=True))
    scored = scored.withColumn("calibrated", F.coalesce(*[F.when(F.col("candidate") == name, calibrated(F.col("raw_score"), turn)) for name, turn in turns.items()]))
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("score"), F.col(kind).alias("value")) for kind in ("raw_score", "calibrated")]))
    long, by = scored.select("candidate", "split", key, label, kinds.alias("_k")).select("candidate", "split", key, label, "_k.score", "_k.value"), ["candidate", "split", "score"]
    found = evaluate_predictions(long, "value", label, by).join(top_lifts(long, "value", label, key, {"top_decile_lift": 0.1, "top_quintile_lift": 0.2}, by), by)
    eight = found.collect()  # a row for each candidate, split and score
    metrics = spark.createDataFrame(eight, found.schema).coalesce(1)
    champion = select_candidate(eight, model)
    brier = baseline(of(champion, "validation"), of(champion, "test"), label).head().brier
    base = spark.createDataFrame([(brier,)], "baseline_brier double").coalesce(1)
    chosen = metrics.where((F.col("candidate") == champion) & (F.col("split") == "test") & (F.col("score") == "calibrated"))
    gates = governance(chosen, chosen.select(F.col("top_decile_lift").alias("lift")), chosen.select(F.col("top_quintile_lift").alias("lift")), base, model)
    gates = stored(gates, f"{model}-governance")
    accepted = model_is_accepted(gates)
    status = "ACCEPTED" if accepted else "REJECTED"
    p = F.col("calibrated")
    final = scored.where((F.col("candidate") == champion) & (F.col("split") == "test"))
    scores = final.select(key, T, F.col(label).alias("label"), "raw_score", p.alias("probability"), probability_band(p, model).alias("probability_band"), F.lit(champion).alias("champion"), F.lit(model).alias("model"), F.lit(status).alias("model_status"), F.lit(accepted).alias("eligible_for_activation"))
    about = {"model": model, "version": "1", "champion": champion, "status": status, "activation_allowed": accepted, "train_from": str(dates[0]), "validation": str(dates[1]), "test": str(dates[2]), "features": list(features), "metrics": chosen.drop("candidate", "split", "score").head().asDict()}
    path = new_path(spark, f"{model}-metadata")
    write_json(spark, about, path)
    return Governed(gates, metrics, scores, coefficients(fits["logistic"], features, spark), read_json(spark, path))
