"""Every query by name, with its SQL: QUERIES take (spark, sf_dir), ORACLES are DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DEFAULT
from tidemark.operators import activation, cadence, decisions, diagnostics, explorer, growth, identity, propensity, segments, snapshots, value, views
from tidemark.plans.sql import cents, r4, with_ctes
from tidemark.session import together
from tidemark.sources import canonical, formats
from tidemark.sources.storage import Scratch, new_path
from tidemark.streaming import movement

ID = "golden_customer_id"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded half up to four places: the form in which results are compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c * 10000 + 0.5 + 1e-6) / 10000
        out.append(c.alias(f.name))
    return df.select(*out)


@dataclass
class Tables:
    """The chain of customer tables of one data folder, each built when first asked for.

    Tables that feed many queries are persisted when first computed; partitions that are lost are
    built again from their lineage. release() gives their storage back.
    """

    spark: SparkSession
    sf_dir: str
    held: list[DataFrame] = field(default_factory=list)
    files: list[Scratch] = field(default_factory=list)

    def kept(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist())
        return self.held[-1]

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()
        while self.files:
            self.files.pop().drop()

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Like kept, in files of the shared folder: they are read by columns, in as few partitions as their size needs."""
        self.files.append(Scratch(self.spark, name))
        out = self.files[-1].stored(df, name)
        self.spark._jvm.System.gc()  # Spark deletes shuffle files when the driver collects the plans that made them
        return out

    @cached_property
    def tx_files(self) -> DataFrame:
        """The transactions, for chains that read few of their columns."""
        return self.written(canonical.transactions(self.spark, self.sf_dir), "transactions")

    @cached_property
    def tx(self) -> DataFrame:
        return self.kept(self.tx_files)

    @cached_property
    def master(self) -> DataFrame:
        return canonical.customers(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        return self.written(cadence.customer_features(self.tx, self.master), "features")

    @cached_property
    def momentum(self) -> DataFrame:
        return cadence.customer_momentum(self.tx, self.master)

    @cached_property
    def trend(self) -> DataFrame:
        return cadence.cadence_trend(self.tx, self.master)

    @cached_property
    def value(self) -> DataFrame:
        return self.written(value.customer_value(self.tx, self.features), "value")

    @cached_property
    def priority(self) -> DataFrame:
        return self.written(value.customer_priority(self.value, self.features, self.momentum, self.trend), "priority")

    @cached_property
    def ltv(self) -> DataFrame:
        return growth.customer_ltv(self.tx, self.master)

    @cached_property
    def exposures(self) -> DataFrame:
        return canonical.campaign_exposures(self.spark, self.sf_dir, tx=self.tx_files)

    @cached_property
    def promotion_rows(self) -> DataFrame:
        return self.written(snapshots.promotion_training(self.tx_files, self.exposures), "promotion")

    @cached_property
    def nba(self) -> DataFrame:
        return self.kept(decisions.next_best_action(self.priority, self.tx))

    @cached_property
    def records(self) -> DataFrame:
        return canonical.identity_records(self.spark, self.sf_dir)

    @cached_property
    def households(self) -> DataFrame:
        """Identity records in which pairs of people share an address."""
        return canonical.ambiguous_households(self.records)

    @cached_property
    def household_resolution(self) -> DataFrame:
        """Linking that saw no column of the truth, with the truth beside it."""
        hidden = ["true_person_id", "variant_type", "household_case_id"]
        return identity.resolve(self.households.drop(*hidden))[0].join(self.households.select("identity_record_id", *hidden), "identity_record_id")

    @cached_property
    def address_keys(self) -> DataFrame:
        return identity.address_key_resolution(self.households)

    @cached_property
    def explorer(self) -> explorer.Explorer:
        return explorer.Explorer.of(self.tx, self.features)

    @cached_property
    def busiest(self) -> int:
        return explorer.busiest(self.tx)

    @cached_property
    def clusterings(self) -> DataFrame:
        return segments.evaluate_clusters(segments.clustering_features(self.tx))

    @cached_property
    def resolution(self) -> tuple[DataFrame, DataFrame]:
        return identity.resolve(self.records)

    @cached_property
    def reengagement_model(self) -> propensity.Governed:
        return propensity.governed_model(snapshots.reengagement_training(self.tx_files), propensity.REENGAGEMENT, "purchased_next_90d", ("1999-10-31", "2001-01-31", "2001-04-30"), "reengagement", ID)

    @cached_property
    def cross_sell_model(self) -> propensity.Governed:
        return propensity.governed_model(snapshots.cross_sell_training(self.tx_files), propensity.CROSS_SELL, "cross_sell_next_180d", ("1999-07-31", "2000-10-31", "2001-01-31"), "cross_sell", ID)

    @cached_property
    def promotion_model(self) -> propensity.Governed:
        treated = self.promotion_rows.where("treatment_flag = 1").withColumn(propensity.T, F.col("campaign_date"))
        hot, names = propensity.one_hot(treated, propensity.PROMOTION_KINDS)
        return propensity.governed_model(hot, [*propensity.PROMOTION, *names], "responded", ("1999-08-15", "2001-02-15", "2001-05-15"), "promotion", "exposure_id")

    @property
    def models(self) -> tuple[propensity.Governed, propensity.Governed, propensity.Governed]:
        """The three models, fitted side by side."""
        self.tx_files  # noqa: B018 written once, before they share it
        together(self.spark, lambda: self.reengagement_model, lambda: self.cross_sell_model, lambda: self.promotion_model)
        return self.reengagement_model, self.cross_sell_model, self.promotion_model

    @cached_property
    def offers(self) -> DataFrame:
        """The best offer of each customer, none while the promotion model is not accepted."""
        model = self.promotion_model
        if not propensity.model_is_accepted(model.gates):  # no offer is made, so none is built
            return activation.operational_scores(self.promotion_rows, self.promotion_rows, None)
        return activation.operational_scores(self.promotion_rows, activation.offers_at(self.priority, self.tx), model.gates, champion=model.about["champion"])

    @cached_property
    def scored(self) -> DataFrame:
        """A fixed score and outcome for checking the evaluation queries."""
        return self.kept(self.priority.select(ID, F.when(F.col("commercial_value_score") > 0, F.col("commercial_value_score") / 100).otherwise(0.005).alias("score"), F.col("active_customer").cast("int").alias("label")))


_TABLES: dict[tuple[str, int, str], tuple[frozenset, Tables]] = {}


def input_state(spark: SparkSession, sf_dir: str) -> frozenset:
    """Names, sizes and times of what lies in a data folder, from one listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return frozenset((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder, shared by all queries of a session while the folder's files stay as they are.

    When they change, what was persisted is released and built anew.
    """
    key, state = (spark.sparkContext.applicationId, id(spark), sf_dir), input_state(spark, sf_dir)
    if key in _TABLES and _TABLES[key][0] != state:
        _TABLES.pop(key)[1].release()
    if key not in _TABLES:
        _TABLES[key] = state, Tables(spark, sf_dir)
    return _TABLES[key][1]


def forget(spark: SparkSession) -> None:
    """Drop all tables that queries shared, and their storage."""
    for _, held in _TABLES.values():
        held.release()
    _TABLES.clear()
    spark.catalog.clearCache()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(build(tables(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = with_ctes(sql)


def cols(longs: str = "", doubles: str = "", others: str = "") -> str:
    """A select list: others as they are, whole numbers as BIGINT, doubles rounded."""
    parts = [x.strip() for x in others.split(",") if x.strip()]
    parts += [f"CAST({x.strip()} AS BIGINT) AS {x.strip()}" for x in longs.split(",") if x.strip()]
    parts += [f"{r4(x.strip())} AS {x.strip()}" for x in doubles.split(",") if x.strip()]
    return ", ".join(parts)


def simple(name: str, build: Callable[[Tables], DataFrame], table: str, longs: str = "", doubles: str = "", others: str = "", tail: str = "") -> None:
    """A query whose result is a projection of a named SQL table; the DataFrame is projected to the same columns."""
    names = [x.strip() for part in (others, longs, doubles) for x in part.split(",") if x.strip()]
    add(name, lambda t: build(t).select(*names), f"SELECT {cols(longs, doubles, others)} FROM {table} {tail}")


# canonical tables
simple("transactions_canonical", lambda t: t.tx, "tx", "order_id, golden_customer_id, units", "gross_sales, discount_pct, net_sales, cost, gross_margin", "transaction_date, channel, category")
simple("customers_canonical", lambda t: t.master, "cust", "golden_customer_id", "", "state, market_segment")
simple("campaign_exposures", lambda t: t.exposures, "expo", "golden_customer_id, treatment_flag, responded", "discount_depth", "exposure_id, campaign_id, campaign_date, campaign_channel, offer_category")

# cadence, lapse, lifecycle
simple("customer_summary", lambda t: cadence.customer_summary(t.tx, t.master), "summ", "golden_customer_id, orders, units, days_since_last_purchase, purchase_tenure_days", "net_sales, gross_margin, avg_order_value", "first_purchase_date, last_purchase_date")
simple("purchase_gaps", lambda t: cadence.purchase_gaps(t.tx), "gaps", "golden_customer_id, gap_days", "", "transaction_date")
simple("cadence_features", lambda t: cadence.cadence_features(t.tx), "cad", "golden_customer_id, observed_purchase_gaps", "median_purchase_gap_days, mean_purchase_gap_days, std_purchase_gap_days, cadence_cv")
simple("trailing_value", lambda t: cadence.trailing_value(t.tx), "trail", "golden_customer_id, trailing_12m_orders", "trailing_12m_sales, trailing_12m_margin")
simple("customer_features", lambda t: t.features, "feat", "golden_customer_id, orders, observed_purchase_gaps, trailing_12m_orders", "lapse_ratio, expected_return_days, adjusted_lapse_ratio, trailing_12m_sales", "cadence_confidence, active_customer, lifecycle_status")
add("lifecycle_distribution", lambda t: views.distribution(t.features, "lifecycle_status", views.LIFECYCLE), "SELECT CAST(d.position AS BIGINT) AS position, d.lifecycle_status, CAST(count(f.golden_customer_id) AS BIGINT) AS customers, " + r4("count(f.golden_customer_id)/sum(count(f.golden_customer_id)) OVER ()::DOUBLE") + " AS share FROM (VALUES " + ", ".join(f"({i},'{v}')" for i, v in enumerate(views.LIFECYCLE)) + ") d(position, lifecycle_status) LEFT JOIN feat f ON f.lifecycle_status=d.lifecycle_status GROUP BY 1,2")

# momentum and trend
simple("period_metrics", lambda t: cadence.period_metrics(t.tx), "per", "golden_customer_id, recent_orders, prior_orders, recent_units, prior_units", "recent_sales, prior_sales, recent_margin, prior_margin", "first_purchase_date")
simple("period_cadence", lambda t: cadence.period_cadence(t.tx), "pcad", "golden_customer_id, recent_gaps, prior_gaps", "recent_median_gap, prior_median_gap")
simple("customer_momentum", lambda t: t.momentum, "mom", "golden_customer_id, recent_orders, prior_orders, momentum_risk_signals, strong_momentum_risk_signals", "order_change_pct, sales_change_pct, margin_change_pct, aov_change_pct, cadence_change_pct", "comparable_history, cadence_comparable, momentum_status")
simple("cadence_trend", lambda t: t.trend, "trend", "golden_customer_id, trend_gaps", "trend_slope, trend_r2, gap_trend_pct, recent_vs_early_pct", "cadence_trend_status")

# value and priority
simple("rfm_base", lambda t: value.rfm_base(t.tx), "rfm0", "golden_customer_id, recency_days, frequency", "monetary_sales, monetary_margin")
simple("rfm_scores", lambda t: value.rfm_scores(value.rfm_base(t.tx)), "rfm", "golden_customer_id, recency_score, frequency_score, monetary_score")
simple("customer_value", lambda t: t.value, "value", "golden_customer_id, orders, rfm_score", "commercial_value_score", "customer_value_tier, rfm_segment")
simple("customer_priority", lambda t: t.priority, "prio", "golden_customer_id", "value_score, lapse_score, momentum_score, priority_score", "decision_group, priority_band")
add("recommended_actions", lambda t: t.priority.groupBy("decision_group", "recommended_action").agg(F.count("*").alias("customers")), "SELECT decision_group, CASE decision_group " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in value.ACTIONS.items()) + " END AS recommended_action, CAST(count(*) AS BIGINT) AS customers FROM prio GROUP BY 1,2")

# growth
simple("customer_ltv", lambda t: t.ltv, "ltv", "golden_customer_id, lifetime_orders, tenure_days, days_to_second_purchase", "lifetime_margin_rate, m3_margin, m6_margin, m12_sales, m24_margin", "cohort_month, has_purchased, repeat_customer, m12_mature")
simple("cohort_retention", lambda t: growth.cohort_retention(t.tx), "ret", "age_months, cohort_size, active_customers", "retention_rate", "cohort_month")
simple("movement_events", lambda t: growth.movement_events(t.tx), "events_", "golden_customer_id, change", "", "event_type, event_date")
simple("growth_monthly", lambda t: growth.growth_monthly(t.tx), "gro", "new_customers, reactivated_customers, lapsed_customers, net_change, opening_customers, closing_customers", "", "month")
add("cohort_summary", lambda t: growth.cohort_summary(t.tx, t.ltv).select("cohort_month", "customers", "repeat_customers", "orders", "avg_m6_margin", "avg_m12_margin", "retention_m6", "m6_benchmark", "m6_delta", "cohort_trend"), "SELECT cohort_month, customers, repeat_customers, orders, " + ", ".join(f"{r4(x)} AS {x}" for x in ("avg_m6_margin", "avg_m12_margin", "retention_m6", "m6_benchmark")) + f", {r4('retention_m6-m6_benchmark')} AS m6_delta, CASE WHEN retention_m6-m6_benchmark IS NULL THEN 'Insufficient History' WHEN retention_m6-m6_benchmark<=-0.05 THEN 'Deteriorating' WHEN retention_m6-m6_benchmark>=0.05 THEN 'Improving' ELSE 'Stable / Mixed' END AS cohort_trend FROM cs2")
add("value_funnel", lambda t: growth.value_funnel(t.tx, t.value), " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS stage_no, '{n}' AS stage, CAST(s{i} AS BIGINT) AS customers, " + ("CAST(NULL AS DOUBLE)" if i == 0 else r4(f"s{i}/nullif(s{i - 1},0)::DOUBLE")) + " AS conversion_rate FROM fun" for i, n in enumerate(("Acquired", "Engaged", "Retained M6+", "Retained M12+", "High Value"))))
add("growth_filtered", lambda t: growth.growth_monthly(t.tx.join(t.master.where("market_segment = 'BUILDING'").select(ID), ID, "left_semi")).agg(F.sum("new_customers").alias("new_customers"), F.sum("lapsed_customers").alias("lapsed_customers")), "SELECT CAST(count(DISTINCT (CAST(date_trunc('month',event_date) AS DATE), golden_customer_id)) FILTER (event_type='New') AS BIGINT) AS new_customers, CAST(count(DISTINCT (CAST(date_trunc('month',event_date) AS DATE), golden_customer_id)) FILTER (event_type='Lapsed') AS BIGINT) AS lapsed_customers FROM events_ WHERE golden_customer_id IN (SELECT golden_customer_id FROM cust WHERE market_segment='BUILDING')")

# snapshots
simple("snapshot_history", lambda t: snapshots.history_features(t.tx, DEFAULT.reengagement_dates), "re_all", "golden_customer_id, lifetime_orders, orders_prior_180d, orders_prior_365d, observed_purchase_gaps, days_since_last_purchase", "avg_order_value, margin_rate, cadence_cv, adjusted_lapse_ratio, order_change_pct, dominant_category_share, preferred_channel_share", "observation_date")
simple("reengagement_training", lambda t: snapshots.reengagement_training(t.tx), "re_train", "golden_customer_id, lifetime_orders, future_orders_90d, purchased_next_90d", "adjusted_lapse_ratio, future_sales_90d", "observation_date")
simple("cross_sell_training", lambda t: snapshots.cross_sell_training(t.tx), "xs_train", "golden_customer_id, categories_used, category_whitespace_count, new_category_count, cross_sell_next_180d", "category_concentration, dominant_category_sales_share", "observation_date")
simple("promotion_training", lambda t: snapshots.promotion_training(t.tx, t.exposures), "ptr", "lifetime_orders, days_since_last_purchase, customer_tenure_days, orders_prior_180d, offer_category_prior_orders", "lifetime_sales, average_order_value", "exposure_id", "WHERE customer_tenure_days>=90 AND lifetime_orders>=2")

# recommendation and decisions
simple("category_penetration", lambda t: decisions.category_penetration(t.tx), "pen", "customers", "penetration", "category")
simple("category_margin", lambda t: decisions.category_margin(t.tx), "cmar", "orders", "sales, margin, margin_per_order, margin_rate, margin_score", "category")
simple("category_adjacency", lambda t: decisions.category_adjacency(t.tx), "adj", "shared_customers, source_customers", "adjacency", "source_category, candidate_category")
simple("category_scores", lambda t: decisions.score_categories(t.tx), "sco", "golden_customer_id, category_rank", "mean_adjacency, max_adjacency, category_affinity_score", "category")
simple("category_recommendations", lambda t: decisions.recommend_categories(t.tx), "rec", "golden_customer_id", "category_affinity_score, affinity_gap", "recommended_category, second_category, third_category")
simple("transaction_behaviour", lambda t: decisions.transaction_behaviour(t.tx), "beh", "golden_customer_id, tx_orders, categories_used, channels_used", "tx_aov, discounted_order_share, tx_margin_rate, dominant_category_share", "dominant_category, preferred_channel")
add("action_scores", lambda t: t.nba.select(ID, "eligible_protect", "eligible_reengage", "eligible_develop", "eligible_cross_sell", "eligible_promote", "score_protect", "score_reengage", "score_develop", "score_cross_sell", "score_promote", "score_do_nothing"), "SELECT golden_customer_id, e_protect AS eligible_protect, e_reengage AS eligible_reengage, e_develop AS eligible_develop, e_cross_sell AS eligible_cross_sell, e_promote AS eligible_promote, " + ", ".join(f"{r4('s_' + n)} AS score_{m}" for n, m in (("protect", "protect"), ("reengage", "reengage"), ("develop", "develop"), ("cross_sell", "cross_sell"), ("promote", "promote"), ("nothing", "do_nothing"))) + " FROM nb3")
add("next_best_action", lambda t: t.nba.select(ID, "recommended_action_nba", "action_score", "action_margin", "economically_positive"), f"SELECT golden_customer_id, act AS recommended_action_nba, {r4('action_score')} AS action_score, {r4('action_margin')} AS action_margin, act<>'Do Nothing' AND action_margin>0 AS economically_positive FROM nba")
add("nba_action_summary", lambda t: t.nba.groupBy("recommended_action_nba").agg(F.count("*").alias("customers"), F.sum("action_margin").alias("margin"), F.avg("action_score").alias("avg_score")), f"SELECT act AS recommended_action_nba, CAST(count(*) AS BIGINT) AS customers, {r4('sum(action_margin)')} AS margin, {r4('avg(action_score)')} AS avg_score FROM nba GROUP BY 1")
add("nba_explained", lambda t: t.nba.select(ID, "recommended_action_nba", "alternative_action", "action_confidence", "primary_driver", "action_rationale"), f"SELECT golden_customer_id, act AS recommended_action_nba, alternative_action, {r4('action_confidence')} AS action_confidence, primary_driver, action_rationale FROM nbx")
add("nba_lifetime_value", lambda t: decisions.next_best_action(t.priority, t.tx, ltv=t.ltv).select(ID, "recommended_action_nba", "observed_ltv_sales", "observed_ltv_margin", "action_rationale"), f"SELECT golden_customer_id, act AS recommended_action_nba, {r4('coalesce(l.lifetime_sales,0)')} AS observed_ltv_sales, {r4('coalesce(l.lifetime_margin,0)')} AS observed_ltv_margin, action_rationale FROM nbx LEFT JOIN ltv l USING (golden_customer_id)")
add("nba_by_cluster", lambda t: decisions.next_best_action(t.priority, t.tx, ltv=t.ltv, clusters=segments.customer_clusters(segments.clustering_features(t.tx))).select(ID, "recommended_action_nba", "cluster_name", "observed_ltv_margin", "action_rationale"))
add("offer_candidates", lambda t: decisions.offer_candidates(t.priority, t.tx).select(ID, "campaign_channel", "discount_depth", "margin_after_discount"), f"SELECT p.golden_customer_id, c AS campaign_channel, CAST(d AS DOUBLE) AS discount_depth, {r4('greatest(coalesce(tx_margin_rate,0.30)-d::DOUBLE,0.01::DOUBLE)')} AS margin_after_discount FROM prio p JOIN beh b ON p.golden_customer_id=b.golden_customer_id, (VALUES ('Email'),('SMS'),('App')) c(c), (VALUES (0.10),(0.15),(0.20),(0.25)) d(d) WHERE active_customer AND customer_value_tier IN ('Medium','High','Very High')")

# identity and golden layer
add("identity_records", lambda t: t.records.groupBy("source_system").agg(F.count("*").alias("records"), F.countDistinct("true_person_id").alias("people")), "SELECT ['POS','Ecommerce','Loyalty','Service','Marketing'][((k-1+person)%5)+1] AS source_system, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT person) AS BIGINT) AS people FROM idk GROUP BY 1")
add("identity_normalised", lambda t: identity.add_normalised_fields(t.records).select("identity_record_id", "norm_full_name", "norm_email", "norm_phone", "norm_address", "norm_postcode"), "SELECT identity_record_id, trim(norm_first_name||' '||norm_last_name) AS norm_full_name, norm_email, norm_phone, norm_address, norm_postcode FROM idn")
add("identity_candidates", lambda t: identity.candidate_pairs(identity.add_normalised_fields(t.records)), "SELECT DISTINCT x.identity_record_id AS a, y.identity_record_id AS b FROM idb x JOIN idb y ON x.key=y.key AND x.identity_record_id<y.identity_record_id JOIN idz z ON z.key=x.key AND n BETWEEN 2 AND 120")
add("identity_pair_verdicts", lambda t: (lambda n: identity.pair_verdict(identity.pair_components(identity.candidate_pairs(n), n)))(identity.add_normalised_fields(t.records)))
add("identity_resolution", lambda t: t.resolution[0].select("identity_record_id", ID, "records_linked", "match_method", "match_confidence", "identity_resolution_status"))
add("identity_edge_audit", lambda t: t.resolution[1])
add("identity_evaluation", lambda t: identity.evaluate(t.resolution[0]))
add("golden_master", lambda t: identity.golden_master(t.resolution[0]))
add("golden_reconciliation", lambda t: identity.reconciliation(t.tx, identity.golden_transactions(t.tx.withColumn("source_customer_id", F.format_string("SRC_%07d_01", ID)), t.records.where("source_role = 'Primary'").select("source_customer_id", F.col("true_person_id").alias(ID)))), " UNION ALL ".join(f"SELECT '{m}' AS metric, {x} AS before_value, {x} AS after_value, 0.0::DOUBLE AS difference FROM tx" for m, x in (("transactions", "CAST(count(*) AS DOUBLE)"), ("orders", "CAST(count(DISTINCT order_id) AS DOUBLE)"), ("units", "CAST(sum(units) AS DOUBLE)"), ("net_sales", cents("sum(net_sales)")), ("cost", cents("sum(cost)")), ("gross_margin", cents("sum(gross_margin)")))))

# segments
add("clustering_features", lambda t: segments.clustering_features(t.tx).select(ID, "orders", "avg_order_value", "units_per_order", "discounted_order_share", "store_share", "online_share", "category_concentration", "cadence_cv"), f"SELECT golden_customer_id, count(DISTINCT order_id) AS orders, {r4('avg(net_sales)')} AS avg_order_value, {r4('avg(units)')} AS units_per_order, {r4('avg(CASE WHEN discount_pct>0 THEN 1 ELSE 0 END)')} AS discounted_order_share, " + ", ".join(f"floor((avg(CASE WHEN channel='{c}' THEN 1 ELSE 0 END))*10000+0.5+1e-6)/10000 AS {n}" for c, n in (("Store", "store_share"), ("Online", "online_share"))) + ", any_value(category_concentration) AS category_concentration, any_value(cadence_cv) AS cadence_cv FROM tx LEFT JOIN (SELECT golden_customer_id, " + r4("sum(n*n)/(sum(n)*sum(n))::DOUBLE") + " AS category_concentration FROM (SELECT golden_customer_id, category, count(DISTINCT order_id) n FROM tx GROUP BY 1,2) GROUP BY 1) k USING (golden_customer_id) LEFT JOIN (SELECT golden_customer_id, " + r4("cadence_cv") + " AS cadence_cv FROM cad) c USING (golden_customer_id) GROUP BY 1")
add("clustering_prepared", lambda t: segments.prepared(segments.clustering_features(t.tx)).agg(*[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in segments.FEATURES], F.count("*").alias("customers")))
add("cluster_evaluation", lambda t: t.clusterings)
add("cluster_choice", lambda t: segments.choose_k(t.clusterings))
add("customer_clusters", lambda t: segments.customer_clusters(segments.clustering_features(t.tx)))

# model evaluation on a fixed score, and the fitted models
add("evaluate_predictions", lambda t: propensity.evaluate_predictions(t.scored, "score", "label").select("rows", "roc_auc", "brier", "log_loss", "base_rate", "mean_probability", "pr_auc", "calibration_gap"), "SELECT CAST(count(*) AS BIGINT) AS rows, " + ", ".join(f"{r4(x)} AS {n}" for n, x in (("roc_auc", "(sum(label*rk)-sum(label)*(sum(label)+1)/2.0::DOUBLE)/(sum(label)*(count(*)-sum(label)))"), ("brier", "avg((p-label)*(p-label))"), ("log_loss", "avg(-(label*ln(p)+(1-label)*ln(1-p)))"), ("base_rate", "avg(label)"), ("mean_probability", "avg(p)"), ("pr_auc", "sum(label*hits/ge::DOUBLE)/sum(label)"), ("calibration_gap", "abs(avg(p)-avg(label))"))) + " FROM (SELECT label, p, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE rk, sum(label) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) hits, count(*) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) ge FROM (SELECT label, least(greatest(score,1e-6),1-1e-6) p FROM sdet))")
add("lift_table", lambda t: propensity.lift_table(t.scored, "score", "label", ID).select("decile", "customers", "actual_rate", "mean_probability", "lift"), f"SELECT CAST(least(10,greatest(1,ceil(10.0::DOUBLE*rk/n))) AS BIGINT) AS decile, CAST(count(*) AS BIGINT) AS customers, {r4('avg(label)')} AS actual_rate, {r4('avg(score)')} AS mean_probability, {r4('avg(label)/any_value(o)')} AS lift FROM (SELECT *, row_number() OVER (ORDER BY score DESC, golden_customer_id) rk, count(*) OVER () n, avg(label) OVER () o FROM sdet) GROUP BY 1")
add("top_fraction_lift", lambda t: propensity.top_fraction_lift(t.scored, "score", "label", ID, 0.2), f"SELECT {r4('avg(label) FILTER (rk<=greatest(1,ceil(n*0.2::DOUBLE)))/avg(label)')} AS lift, CAST(0.2 AS DOUBLE) AS fraction FROM (SELECT *, row_number() OVER (ORDER BY score DESC, golden_customer_id) rk, count(*) OVER () n FROM sdet)")
add("reengagement_lift_table", lambda t: propensity.lift_table(t.scored, "score", "label", ID, quantiles=True).select("decile", "customers", "actual_rate", "mean_probability", "lift"), f"SELECT CAST(greatest(1,ceil(10.0::DOUBLE*(rk-1)/(n-1))) AS BIGINT) AS decile, CAST(count(*) AS BIGINT) AS customers, {r4('avg(label)')} AS actual_rate, {r4('avg(score)')} AS mean_probability, {r4('avg(label)/any_value(o)')} AS lift FROM (SELECT *, row_number() OVER (ORDER BY score DESC, golden_customer_id) rk, count(*) OVER () n, avg(label) OVER () o FROM sdet) GROUP BY 1")
add("governance", lambda t: t.reengagement_model.gates)
add("cross_sell_governance", lambda t: t.cross_sell_model.gates)
add("promotion_governance", lambda t: t.promotion_model.gates)
add("propensity_reengagement", lambda t: t.reengagement_model.scores)
add("propensity_cross_sell", lambda t: t.cross_sell_model.scores)
add("propensity_promotion", lambda t: t.promotion_model.scores)
add("model_coefficients", lambda t: t.cross_sell_model.coefficients)
add("model_metadata", lambda t: t.spark.createDataFrame([(str(k), str(v)) for m in t.models for k, v in {"model": m.about["model"], **m.about}.items()], "field string, value string"))

# presentation
add("executive_kpis", lambda t: views.executive_kpis(t.priority), f"SELECT CAST(count(*) AS BIGINT) AS customers, CAST(count(*) FILTER (active_customer) AS BIGINT) AS active_customers, {r4('avg(active_customer::INT)')} AS active_rate, CAST(count(*) FILTER (decision_group='Protect Now') AS BIGINT) AS protect_now, CAST(count(*) FILTER (decision_group='Proactive Retention') AS BIGINT) AS proactive_retention, " + r4("sum(CASE WHEN priority_band IN ('Critical','High') THEN trailing_12m_margin ELSE 0 END)") + f" AS priority_margin, {r4('sum(trailing_12m_sales)')} AS trailing_sales, {r4('sum(trailing_12m_margin)')} AS trailing_margin FROM prio")
add("decision_exposure", lambda t: views.exposure_by_group(t.priority), f"SELECT decision_group, CAST(count(*) AS BIGINT) AS customers, {r4('sum(trailing_12m_margin)')} AS margin, {r4('sum(trailing_12m_sales)')} AS sales, {r4('avg(priority_score)')} AS avg_priority FROM prio GROUP BY 1")
add("segment_summary", lambda t: views.segment_summary(t.priority), "SELECT rfm_segment, CAST(count(*) AS BIGINT) AS customers, " + f"{r4('median(orders)')} AS median_orders, {r4('median(recency_days)')} AS median_recency, {r4('avg(active_customer::INT)')} AS active_rate, CAST(count(*) FILTER (customer_value_tier IN ('High','Very High')) AS BIGINT) AS high_value, {r4('count(*)/sum(count(*)) OVER ()::DOUBLE')} AS share FROM prio GROUP BY 1")
add("value_mix", lambda t: views.value_mix(t.priority), f"SELECT rfm_segment, customer_value_tier, CAST(count(*) AS BIGINT) AS customers, {r4('count(*)/sum(count(*)) OVER (PARTITION BY rfm_segment)::DOUBLE')} AS share FROM prio GROUP BY 1,2")
add("decision_queue", lambda t: views.decision_queue(t.priority, ("Protect Now", "Proactive Retention", "Re-engage"), 30.0, 100), f"SELECT golden_customer_id, decision_group, {r4('priority_score')} AS priority_score, priority_band, customer_value_tier FROM (SELECT * FROM prio WHERE decision_group IN ('Protect Now','Proactive Retention','Re-engage') AND priority_score>=30 ORDER BY priority_score DESC, {cents('trailing_12m_margin')} DESC, golden_customer_id LIMIT 100)")
add("watchlist", lambda t: views.watchlist(t.priority), f"SELECT golden_customer_id, {r4('priority_score')} AS priority_score, cadence_trend_status FROM (SELECT * FROM prio WHERE customer_value_tier IN ('High','Very High') AND cadence_trend_status IN ('Deteriorating','Strongly Deteriorating') ORDER BY priority_score DESC, floor(gap_trend_pct*1e6+0.5) DESC, golden_customer_id LIMIT 20)")
add("lifecycle_by_tier", lambda t: views.cross_tab(t.priority, "lifecycle_status", "customer_value_tier", ("Very High", "High", "Medium", "Low")), "SELECT lifecycle_status, " + ", ".join("floor((100*count(*) FILTER (customer_value_tier='%s')/nullif(count(*) FILTER (customer_value_tier IN ('Very High','High','Medium','Low')),0)::DOUBLE)*10000+0.5+1e-6)/10000 AS %s" % (v, v.lower().replace(" ", "_")) for v in ("Very High", "High", "Medium", "Low")) + " FROM prio GROUP BY 1")
add("monthly_history", lambda t: views.monthly_history(t.tx), f"SELECT CAST(date_trunc('month',transaction_date) AS DATE) AS month, CAST(count(DISTINCT order_id) AS BIGINT) AS orders, CAST(count(DISTINCT golden_customer_id) AS BIGINT) AS customers, {r4('sum(net_sales)')} AS sales FROM tx GROUP BY 1")
for _c in ("channel", "category"):
    add(f"{_c}_mix", lambda t, c=_c: views.mix(t.tx, c), f"SELECT {_c}, CAST(count(*) AS BIGINT) AS orders, {r4('sum(net_sales)')} AS sales, {r4('sum(net_sales)/sum(sum(net_sales)) OVER ()')} AS sales_share FROM tx GROUP BY 1")
add("last_transactions", lambda t: views.last_transactions(t.tx), f"SELECT golden_customer_id, CAST(k AS BIGINT) AS nth, order_id, transaction_date, {r4('net_sales')} AS net_sales FROM (SELECT *, row_number() OVER (PARTITION BY golden_customer_id ORDER BY transaction_date DESC, order_id DESC) k FROM tx) WHERE k<=20")
add("movement_long", lambda t: views.movement_long(growth.growth_monthly(t.tx)), "UNPIVOT (SELECT month, CAST(new_customers AS BIGINT) AS new_customers, CAST(reactivated_customers AS BIGINT) AS reactivated_customers, CAST(lapsed_customers AS BIGINT) AS lapsed_customers FROM gro) ON new_customers, reactivated_customers, lapsed_customers INTO NAME movement VALUE customers")
add("retention_heatmap", lambda t: views.retention_heatmap(growth.cohort_retention(t.tx)), "SELECT cohort_month, " + ", ".join(f"floor((max(retention_rate) FILTER (age_months={i}))*10000+0.5+1e-6)/10000 AS m{i}" for i in range(12)) + " FROM ret GROUP BY 1")
add("stratified_sample", lambda t: views.stratified_sample(t.priority.select(ID, "decision_group"), "decision_group", 200), "SELECT golden_customer_id, decision_group FROM (SELECT golden_customer_id, decision_group, row_number() OVER (PARTITION BY decision_group ORDER BY md5('42-'||CAST(golden_customer_id AS VARCHAR)), golden_customer_id) k, count(*) OVER (PARTITION BY decision_group) n, count(*) OVER () total FROM prio) WHERE k <= greatest(1, floor(200*n/total::DOUBLE+0.5))")
add("customer_search", lambda t: views.search_customers(t.master, "AUTO"), "SELECT golden_customer_id, state, market_segment FROM cust WHERE lower(state) LIKE '%auto%' OR lower(market_segment) LIKE '%auto%'")
add("filtered_priority", lambda t: views.apply_filters(t.priority.join(t.master, ID), tier="High").groupBy("state").agg(F.count("*").alias("customers")), "SELECT state, CAST(count(*) AS BIGINT) AS customers FROM prio JOIN cust USING (golden_customer_id) WHERE customer_value_tier='High' GROUP BY 1")
add("duplicate_order_keys", lambda t: formats.duplicate_keys(t.tx, ["order_id"]), "SELECT order_id, CAST(count(*) AS BIGINT) AS rows FROM tx GROUP BY 1 HAVING count(*)>1")
add("customers_without_recent_orders", lambda t: t.master.join(t.tx.where("transaction_date > '2000-07-31'"), ID, "left_anti").select(ID), "SELECT golden_customer_id FROM cust WHERE golden_customer_id NOT IN (SELECT golden_customer_id FROM tx WHERE transaction_date > DATE '2000-07-31')")
add("customers_of_both_channels", lambda t: t.tx.where("channel = 'Store'").select(ID).intersect(t.tx.where("channel = 'Online'").select(ID)), "SELECT golden_customer_id FROM tx WHERE channel='Store' INTERSECT SELECT golden_customer_id FROM tx WHERE channel='Online'")
add("customers_of_store_only", lambda t: t.tx.where("channel = 'Store'").select(ID).subtract(t.tx.where("channel <> 'Store'").select(ID)), "SELECT golden_customer_id FROM tx WHERE channel='Store' EXCEPT SELECT golden_customer_id FROM tx WHERE channel<>'Store'")
add("campaign_control_benchmark", lambda t: t.exposures.groupBy("campaign_id", "treatment_flag").agg(F.count("*").alias("exposures"), F.avg("responded").alias("response_rate")), f"SELECT campaign_id, CAST(treatment_flag AS BIGINT) AS treatment_flag, CAST(count(*) AS BIGINT) AS exposures, {r4('avg(responded)')} AS response_rate FROM expo GROUP BY 1,2")

# more of the pages
add("lapse_by_lifecycle", lambda t: views.lapse_by_lifecycle(t.features), f"SELECT lifecycle_status, CAST(count(*) AS BIGINT) AS customers, {r4('median(adjusted_lapse_ratio)')} AS median_lapse_ratio FROM feat GROUP BY 1")
add("commercial_summary", lambda t: views.commercial_summary(t.priority), f"SELECT rfm_segment, CAST(count(*) AS BIGINT) AS customers, {r4('sum(trailing_12m_sales)')} AS sales, {r4('sum(trailing_12m_margin)')} AS margin, CAST(count(*) FILTER (decision_group='Protect Now') AS BIGINT) AS protect_now, CAST(count(*) FILTER (decision_group='Proactive Retention') AS BIGINT) AS proactive_retention, {r4('avg(priority_score)')} AS avg_priority FROM prio GROUP BY 1")
add("queue_kpis", lambda t: views.queue_kpis(t.priority, ("Protect Now", "Re-engage"), 30.0), f"SELECT priority_band, CAST(count(*) AS BIGINT) AS customers, {r4('sum(trailing_12m_margin)')} AS margin, {r4('avg(priority_score)')} AS avg_priority, CAST(count(*) FILTER (customer_value_tier='Very High') AS BIGINT) AS very_high_value FROM prio WHERE decision_group IN ('Protect Now','Re-engage') AND priority_score>=30 GROUP BY 1")
add("growth_signals", lambda t: views.growth_signals(growth.growth_monthly(t.tx)), "SELECT *, CASE WHEN recent_net_change<0 THEN 'Shrinking' WHEN recent_net_change<previous_net_change THEN 'Slowing' ELSE 'Growing' END AS growth_signal FROM (SELECT " + ", ".join(f"CAST(coalesce(sum({c}) FILTER ({w}),0) AS BIGINT) AS {p}_{c}" for c in ("new_customers", "reactivated_customers", "lapsed_customers", "net_change") for p, w in (("recent", "n<=12"), ("previous", "n BETWEEN 13 AND 24"))) + ", CAST(max(closing_customers) FILTER (n=1) AS BIGINT) AS closing_customers FROM (SELECT *, row_number() OVER (ORDER BY month DESC) n FROM gro))")
add("cohort_attention", lambda t: views.cohort_attention(growth.cohort_summary(t.tx, t.ltv)), f"SELECT cohort_month, customers, {r4('retention_m6-m6_benchmark')} AS m6_delta, CASE WHEN retention_m6-m6_benchmark<=-0.05 THEN 'Deteriorating' WHEN retention_m6-m6_benchmark>=0.05 THEN 'Improving' ELSE 'Stable / Mixed' END AS cohort_trend FROM cs2 WHERE retention_m6-m6_benchmark IS NOT NULL ORDER BY floor((retention_m6-m6_benchmark)*1e6+0.5), cohort_month LIMIT 10")
add("action_kpis", lambda t: views.action_kpis(t.nba), f"SELECT CAST(count(*) AS BIGINT) AS customers, CAST(count(*) FILTER (act<>'Do Nothing') AS BIGINT) AS interventions, {r4('sum(CASE WHEN act<>' + chr(39) + 'Do Nothing' + chr(39) + ' THEN action_margin ELSE 0 END)')} AS margin, CAST(count(*) FILTER (act<>'Do Nothing' AND action_margin>0) AS BIGINT) AS economically_positive FROM nba")
add("action_queue", lambda t: views.action_queue(t.nba, ("Protect", "Re-engage", "Cross-sell"), 30.0, 100), f"SELECT golden_customer_id, act AS recommended_action_nba, {r4('action_confidence')} AS action_confidence, {r4('action_score')} AS action_score FROM (SELECT * FROM nbx WHERE act IN ('Protect','Re-engage','Cross-sell') AND action_confidence>=30 ORDER BY action_confidence DESC, action_score DESC, golden_customer_id LIMIT 100)")
add("identity_evidence", lambda t: views.identity_evidence(t.resolution[0]))
add("segment_profile", lambda t: diagnostics.segment_profile(t.priority, "rfm_segment", ["orders", "recency_days", "priority_score"]), f"SELECT rfm_segment, CAST(count(*) AS BIGINT) AS customers, {r4('median(orders)')} AS median_orders, {r4('median(recency_days)')} AS median_recency_days, {r4('median(priority_score)')} AS median_priority_score FROM prio GROUP BY 1")

# quality reports; the market segment stands for the hidden group that is known in synthetic data only
add("lifecycle_by_market_segment", lambda t: diagnostics.row_shares(t.features.join(t.master, ID), "market_segment", "lifecycle_status").drop("row_pct"), "SELECT market_segment, lifecycle_status, CAST(count(*) AS BIGINT) AS customers FROM feat JOIN cust USING (golden_customer_id) GROUP BY 1,2")
add("segment_enrichment", lambda t: diagnostics.enrichment(t.priority.join(t.master, ID), "rfm_segment", "market_segment").select("rfm_segment", "market_segment", "customers", "share", "baseline_share", "enrichment"), f"SELECT rfm_segment, market_segment, n AS customers, {r4('share')} AS share, {r4('base')} AS baseline_share, {r4('share/base')} AS enrichment FROM (SELECT rfm_segment, market_segment, n, n/sum(n) OVER (PARTITION BY rfm_segment)::DOUBLE share, sum(n) OVER (PARTITION BY market_segment)/sum(n) OVER ()::DOUBLE base, row_number() OVER (PARTITION BY rfm_segment ORDER BY n DESC, market_segment) k FROM (SELECT rfm_segment, market_segment, count(*) n FROM prio JOIN cust USING (golden_customer_id) GROUP BY 1,2)) WHERE k=1")
add("detection_summary", lambda t: diagnostics.detection_summary(t.trend.join(t.master, ID), "market_segment", F.col("cadence_trend_status").isin("Deteriorating", "Strongly Deteriorating")), f"SELECT market_segment, CAST(count(*) AS BIGINT) AS customers, {r4('avg(CASE WHEN cadence_trend_status IN (' + chr(39) + 'Deteriorating' + chr(39) + ',' + chr(39) + 'Strongly Deteriorating' + chr(39) + ') THEN 1 ELSE 0 END)')} AS detected_rate FROM trend JOIN cust USING (golden_customer_id) GROUP BY 1")
add("identity_contamination", lambda t: diagnostics.cluster_contamination(t.resolution[0]))
add("identity_methods", lambda t: diagnostics.match_methods(t.resolution[0]))
add("identity_summary", lambda t: (lambda r: diagnostics.identity_summary(r[0], r[1], identity.evaluate(r[0])))(t.resolution))
add("table_expectations", lambda t: diagnostics.expectations(t.priority, "customer_priority", {"priority in 0..100": F.col("priority_score").between(0, 100), "known band": F.col("priority_band").isin("Critical", "High", "Medium", "Low"), "orders not negative": F.col("orders") >= 0}), "SELECT 'customer_priority' AS \"table\", e AS expectation, CAST(f AS BIGINT) AS failures FROM (SELECT count(*) FILTER (NOT priority_score BETWEEN 0 AND 100) a, count(*) FILTER (priority_band NOT IN ('Critical','High','Medium','Low')) b, count(*) FILTER (orders<0) c, count(*)-count(DISTINCT golden_customer_id) d FROM prio), LATERAL (VALUES ('priority in 0..100',a),('known band',b),('orders not negative',c),('unique golden_customer_id',d)) x(e,f)")

# promotion model and activation
add("promotion_features", lambda t: snapshots.promotion_training(t.tx, t.exposures).select("exposure_id", *propensity.PROMOTION), "SELECT exposure_id, " + cols("days_since_last_purchase, customer_tenure_days, lifetime_orders, lifetime_categories, lifetime_channels, orders_prior_180d, categories_prior_180d, channels_prior_180d, offer_category_prior_orders, offer_category_seen_before", "discount_depth, lifetime_sales, lifetime_margin, average_order_value, average_discount_pct, discounted_order_share, lifetime_margin_rate, sales_prior_180d, margin_prior_180d, avg_discount_prior_180d, discounted_order_share_prior_180d, offer_category_prior_sales, offer_category_order_share, recent_margin_rate, orders_per_30d_tenure, campaign_month_sin, campaign_month_cos") + " FROM ptf")
add("cross_sell_metrics", lambda t: t.cross_sell_model.metrics.select("candidate", "split", "score", "roc_auc", "pr_auc", "brier", "log_loss", "calibration_gap", "top_decile_lift", "top_quintile_lift"))
add("operational_offers", lambda t: t.offers)


def governed(t: Tables) -> DataFrame:
    """Actions in which each accepted model's probabilities count: cross-sell from the test date's scores, promotion from today's offers."""
    accepted = lambda m, scores, p: scores.select(ID, F.col(p).alias("probability")) if propensity.model_is_accepted(m.gates) else None
    t.tx  # noqa: B018 written once, before they share it
    together(t.spark, lambda: t.cross_sell_model, lambda: t.promotion_model, lambda: t.priority)
    return activation.governed_actions(t.priority, t.tx, cross_sell=accepted(t.cross_sell_model, t.cross_sell_model.scores, "probability"), promotion=accepted(t.promotion_model, t.offers, "promotion_propensity"))


add("governed_next_best_action", lambda t: governed(t).select(ID, "recommended_action_nba", "action_score", "action_margin", "decision_source"))
add("recommendation_validation", lambda t: activation.validate_recommendations(t.tx, "2001-01-31"), "SELECT CAST(count(*) AS BIGINT) AS customers, " + ", ".join(f"{r4(f'avg(CASE WHEN k<={n} THEN 1 ELSE 0 END)')} AS top{n}_rate" for n in (1, 2, 3)) + " FROM hits_")
add("reengagement_baseline", lambda t: (lambda p: propensity.baseline(p["validation"], p["test"], "purchased_next_90d"))(propensity.split_by_time(snapshots.reengagement_training(t.tx), "1999-10-31", "2001-01-31", "2001-04-30")).select("rows", "brier", "base_rate", "mean_probability"), f"SELECT CAST(count(*) AS BIGINT) AS rows, {r4('avg((p-y)*(p-y))')} AS brier, {r4('avg(y)')} AS base_rate, {r4('avg(p)')} AS mean_probability FROM (SELECT purchased_next_90d y, (SELECT avg(purchased_next_90d) FROM re_train WHERE observation_date=DATE '2001-01-31') p FROM re_train WHERE observation_date=DATE '2001-04-30')")


add("identity_dropped_blocks", lambda t: identity.dropped_blocks(identity.add_normalised_fields(t.records)), "SELECT left(key,2) AS rule, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(n) AS BIGINT) AS records FROM idz WHERE n>120 GROUP BY 1")


# streams: all that the stream of event files gives; windows that the watermark has closed
def events(t: Tables) -> DataFrame:
    return movement.event_stream(t.spark, t.sf_dir, pattern="events.parquet")


add("event_windows_stream", lambda t: movement.run_available(movement.windowed_counts(events(t)), "windows").withColumns({c: F.to_date(c) for c in ("window_start", "window_end")}), f"SELECT * FROM (SELECT CAST(ts AS DATE) AS window_start, CAST(ts AS DATE) + 1 AS window_end, event_type, CAST(count(*) AS BIGINT) AS events, {r4('sum(value)')} AS value FROM events GROUP BY ALL) WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
add("distinct_events_stream", lambda t: movement.run_available(movement.distinct_events(events(t)).select("event_id", "user_id", "event_type"), "distinct"), "SELECT DISTINCT event_id, user_id, event_type FROM events")
_MINUTE, _MICRO = "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS"
add("event_sliding_stream", lambda t: movement.run_available(movement.windowed_counts(events(t), "sliding", size="1 day", slide="6 hours"), "sliding").withColumns({c: F.date_format(c, _MINUTE) for c in ("window_start", "window_end")}), f"SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS window_end, event_type, CAST(count(*) AS BIGINT) AS events, {r4('sum(value)')} AS value FROM (SELECT event_type, value, time_bucket(INTERVAL 6 HOURS, ts) - i * INTERVAL 6 HOURS s FROM events, range(4) r(i)) WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY s, event_type")
add("event_sessions_stream", lambda t: movement.run_available(movement.windowed_counts(events(t), "session", gap="30 minutes"), "sessions").withColumns({c: F.date_format(c, _MICRO) for c in ("window_start", "window_end")}), f"SELECT strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS window_end, event_type, user_id, events, value FROM (SELECT event_type, user_id, min(ts) a, max(ts) + INTERVAL 30 MINUTES b, CAST(count(*) AS BIGINT) AS events, {r4('sum(value)')} AS value FROM (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) g FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 1 ELSE 0 END n FROM events)) GROUP BY event_type, user_id, g) WHERE b <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
simple("movement_stream", lambda t: movement.run_available(movement.movement_stream(purchase_days(t)), "movement"), "events_", "golden_customer_id, change", "", "event_type, event_date")


def purchase_days(t: Tables) -> DataFrame:
    """The days on which customers bought, as a stream of a written table, with a mark at the reference date."""
    path = new_path(t.spark, "purchase-days")
    mark = t.spark.createDataFrame([(movement.MARK, DEFAULT.as_of)], f"{ID} long, transaction_date date")
    t.tx.select(ID, "transaction_date").distinct().unionByName(mark).write.parquet(path)
    return t.spark.readStream.schema(f"{ID} long, transaction_date date").parquet(path)


# small operations of their own
add("uniform_sample", lambda t: views.uniform_sample(t.master, 100).select(ID, "state"), "SELECT golden_customer_id, state FROM cust ORDER BY md5('42-'||CAST(golden_customer_id AS VARCHAR)), golden_customer_id LIMIT 100")
add("slugged_columns", lambda t: views.slugged(t.tx.groupBy("channel").agg(F.count("*").alias("Orders & Lines"), F.round(F.sum("net_sales"), 2).alias("Net Sales ($)"))), f"SELECT channel, CAST(count(*) AS BIGINT) AS orders_lines, {r4('floor(sum(net_sales)*100+0.5)/100')} AS net_sales FROM tx GROUP BY 1")
add("formatted_kpis", lambda t: views.formatted_kpis(views.executive_kpis(t.priority)), "SELECT format('{:,}', count(*)) AS customers, printf('%.1f', 100*avg(active_customer::INT))||'%' AS active_rate, '$'||format('{:,}', CAST(round(sum(trailing_12m_sales)) AS BIGINT)) AS trailing_sales FROM prio")
add("truth_bridge", lambda t: diagnostics.truth_bridge(t.resolution[0]))


# households of two people: how linking, and the plain rule of one customer an address, stand them
add("identity_households", lambda t: t.households.where("household_case_id is not null").select("identity_record_id", "household_case_id", "variant_type", "address", "postcode"), "SELECT identity_record_id, household_case_id, variant_type, address, postcode FROM idhr WHERE household_case_id IS NOT NULL")
add("household_diagnostics", lambda t: diagnostics.household_summary(diagnostics.household_cases(t.household_resolution)))
add("household_variants", lambda t: diagnostics.variant_diagnostics(t.household_resolution))
add("household_false_pairs", lambda t: diagnostics.false_pairs(t.household_resolution))
add("household_evaluation", lambda t: identity.evaluate(t.household_resolution))
add("address_key_households", lambda t: diagnostics.household_summary(diagnostics.household_cases(t.address_keys)), f"SELECT CAST(sum(r) AS BIGINT) AS household_records, CAST(count(*) AS BIGINT) AS household_cases, CAST(count(*) FILTER (g<p) AS BIGINT) AS household_cases_merged, {r4('(count(*) FILTER (g<p))/count(*)::DOUBLE')} AS household_merge_rate FROM (SELECT count(*) r, count(DISTINCT person) p, count(DISTINCT golden) g FROM idhk WHERE household_case_id IS NOT NULL GROUP BY household_case_id)")
add("address_key_variants", lambda t: diagnostics.variant_diagnostics(t.address_keys), f"SELECT variant_type, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (people>1) AS BIGINT) AS contaminated_records, {r4('(count(*) FILTER (people>1))/count(*)::DOUBLE')} AS contamination_rate FROM idhk JOIN idhg USING (golden) GROUP BY 1")
add("address_key_false_pairs", lambda t: diagnostics.false_pairs(t.address_keys), "SELECT golden AS golden_customer_id, CAST(n AS BIGINT) AS records, CAST(people AS BIGINT) AS true_people, CAST(most AS BIGINT) AS largest_person_records, CAST(0.9 AS DOUBLE) AS mean_confidence, CAST(0.9 AS DOUBLE) AS least_confidence, 'Address Key' AS methods, CAST((n*(n-1)-own)/2 AS BIGINT) AS false_pairs FROM idhg WHERE people>1")
add("address_key_evaluation", lambda t: identity.evaluate(t.address_keys).select("tp", "predicted", "actual", "golden_customers", "true_customers", "precision", "recall", "false_merge_rate", "missed_link_rate", "f1"), "SELECT " + cols("golden_customers, true_customers") + ", " + ", ".join(f"{r4(x)} AS {n}" for n, x in (("tp", "tp"), ("predicted", "predicted"), ("actual", "actual"), ("precision", "tp/predicted"), ("recall", "tp/actual"), ("false_merge_rate", "1-tp/predicted"), ("missed_link_rate", "1-tp/actual"), ("f1", "2*tp/(predicted+actual)"))) + " FROM (SELECT (SELECT sum(own)/2.0::DOUBLE FROM idhg) tp, (SELECT sum(n*(n-1))/2.0::DOUBLE FROM idhg) predicted, (SELECT count(*) FROM idhg) golden_customers, (SELECT sum(c*(c-1))/2.0::DOUBLE FROM (SELECT count(*) c FROM idhk GROUP BY person)) actual, (SELECT count(DISTINCT person) FROM idhk) true_customers)")


# the explorer's lookups of the customer with the most orders, in tables bucketed by customer
_BUSIEST = "tx WHERE golden_customer_id = (SELECT golden_customer_id FROM tx GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
add("explorer_profile", lambda t: t.explorer.profile(t.busiest).select(ID, "orders", "lifecycle_status", "adjusted_lapse_ratio"), f"SELECT golden_customer_id, CAST(orders AS BIGINT) AS orders, lifecycle_status, {r4('adjusted_lapse_ratio')} AS adjusted_lapse_ratio FROM feat WHERE golden_customer_id = (SELECT golden_customer_id FROM tx GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
add("explorer_monthly_history", lambda t: t.explorer.monthly_history(t.busiest), f"SELECT CAST(date_trunc('month',transaction_date) AS DATE) AS month, CAST(count(DISTINCT order_id) AS BIGINT) AS orders, {r4('sum(net_sales)')} AS sales, {r4('sum(gross_margin)')} AS margin FROM {_BUSIEST} GROUP BY 1")
add("explorer_gap_series", lambda t: t.explorer.gap_series(t.busiest), f"SELECT * FROM (SELECT transaction_date, CAST(row_number() OVER (ORDER BY transaction_date) AS BIGINT) AS purchase, CAST(date_diff('day', lag(transaction_date) OVER (ORDER BY transaction_date), transaction_date) AS BIGINT) AS gap_days FROM (SELECT DISTINCT transaction_date FROM {_BUSIEST})) WHERE gap_days IS NOT NULL")
for _c in ("channel", "category"):
    add(f"explorer_{_c}_mix", lambda t, c=_c: t.explorer.mix(t.busiest, c), f"SELECT {_c}, CAST(count(*) AS BIGINT) AS orders, {r4('sum(net_sales)')} AS sales, {r4('sum(net_sales)/sum(sum(net_sales)) OVER ()')} AS sales_share FROM {_BUSIEST} GROUP BY 1")
add("explorer_latest", lambda t: t.explorer.latest(t.busiest), f"SELECT order_id, transaction_date, channel, category, {r4('net_sales')} AS net_sales FROM {_BUSIEST} ORDER BY transaction_date DESC, order_id DESC LIMIT 20")
