"""Quality reports: identity contamination, crosstabs against the truth, segment profiles, and checks of every built table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.quantiles import with_quantiles
from tidemark.functions.scalars import safe_divide
from tidemark.functions.windows import first_by

ID, TRUTH = "golden_customer_id", "true_person_id"


def truth_bridge(resolution: DataFrame) -> DataFrame:
    """Golden customers that hold exactly one true person, with that person."""
    g = resolution.groupBy(ID).agg(F.countDistinct(TRUTH).alias("n"), F.min(TRUTH).alias(TRUTH))
    return g.where("n = 1").select(ID, TRUTH)


def cluster_contamination(resolution: DataFrame) -> DataFrame:
    """Records, true people and falsely joined pairs of each golden customer: n(n-1)/2 less the pairs of one person."""
    pairs = lambda n: n * (n - 1) / 2
    per = resolution.groupBy(ID, TRUTH).agg(F.count("*").alias("c"))
    g = per.groupBy(ID).agg(F.sum("c").alias("records"), F.count("*").alias("true_people"), F.sum(pairs(F.col("c"))).alias("true_pairs"))
    return g.select(ID, "records", "true_people", (pairs(F.col("records")) - F.col("true_pairs")).alias("false_pairs"))


def false_pairs(resolution: DataFrame) -> DataFrame:
    """Golden customers that hold several true people: their false pairs from group sizes, and on what the links rest."""
    pairs = lambda n: n * (n - 1) / 2
    per = resolution.groupBy(ID, TRUTH).agg(F.count("*").alias("c"), F.sum("match_confidence").alias("s"), F.count("match_confidence").alias("k"), F.min("match_confidence").alias("least"), F.collect_set("match_method").alias("how"))
    g = per.groupBy(ID).agg(
        F.sum("c").alias("records"),
        F.count("*").alias("true_people"),
        F.sum(pairs(F.col("c"))).alias("true_pairs"),
        F.max("c").alias("largest_person_records"),
        F.try_divide(F.sum("s"), F.sum("k")).alias("mean_confidence"),
        F.min("least").alias("least_confidence"),
        F.concat_ws(" | ", F.array_sort(F.array_distinct(F.flatten(F.collect_set("how"))))).alias("methods"),  # sets of a few methods
    )
    return g.where("true_people > 1").withColumn("false_pairs", (pairs(F.col("records")) - F.col("true_pairs")).cast("long")).drop("true_pairs")


def variant_diagnostics(resolution: DataFrame) -> DataFrame:
    """Records of each kind of variant, and those whose golden customer holds several true people."""
    per = resolution.groupBy(ID, TRUTH, "variant_type").agg(F.count("*").alias("c"))
    mixed = per.groupBy(ID).agg((F.min(TRUTH) != F.max(TRUTH)).alias("contaminated"))
    g = per.join(mixed, ID).groupBy("variant_type").agg(F.sum("c").alias("records"), F.sum(F.when(F.col("contaminated"), F.col("c")).otherwise(0)).alias("contaminated_records"))
    return g.withColumn("contamination_rate", F.col("contaminated_records") / F.col("records"))


def household_cases(resolution: DataFrame) -> DataFrame:
    """For each household case its records, true people and golden customers; fewer of these than people is a wrong merge."""
    g = resolution.where("household_case_id is not null").groupBy("household_case_id").agg(F.count("*").alias("records"), F.countDistinct(TRUTH).alias("true_people"), F.countDistinct(ID).alias("golden_customers"))
    return g.withColumn("wrongly_merged", F.col("golden_customers") < F.col("true_people"))


def household_summary(cases: DataFrame) -> DataFrame:
    """Records and cases of households, and how many were wrongly merged, in one row; all 0 without cases."""
    one = cases.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("household_records"), F.count("*").alias("household_cases"), F.count_if("wrongly_merged").alias("household_cases_merged"))
    return one.withColumn("household_merge_rate", F.coalesce(F.try_divide("household_cases_merged", "household_cases"), F.lit(0.0)))


def match_methods(resolution: DataFrame) -> DataFrame:
    """Records, golden customers and mean confidence by how a record was matched."""
    return resolution.groupBy("match_method").agg(F.count("*").alias("records"), F.countDistinct(ID).alias("golden_customers"), F.avg("match_confidence").alias("mean_confidence"), F.min("match_confidence").alias("least_confidence"))


def identity_summary(resolution: DataFrame, audit: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(metric, value) rows of a resolution."""
    one = resolution.agg(F.count("*").alias("records"), F.countDistinct(ID).alias("golden_customers"), F.count_if(F.col("identity_resolution_status") == "Resolved").alias("resolved_records"), F.count_if("ambiguous_match_flag").alias("ambiguous_records"))
    links = audit.agg(F.count_if("accepted").alias("accepted_links"), F.count_if(~F.col("accepted")).alias("rejected_links"))
    names = [*one.columns, *links.columns, "tp", "predicted", "actual", "precision", "recall", "f1", "false_merge_rate", "missed_link_rate"]
    wide = one.crossJoin(links).crossJoin(evaluation.drop("golden_customers", "true_customers"))  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")


def row_shares(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Long crosstab: customers by two columns and the percentage of the row."""
    g = df.groupBy(rows, columns).agg(F.count("*").alias("customers"))
    return g.withColumn("row_pct", F.round(safe_divide(100 * F.col("customers"), F.sum("customers").over(Window.partitionBy(rows))), 1))


def enrichment(df: DataFrame, group: str, column: str) -> DataFrame:
    """The most common value in each group, its share there, and that over its share in all."""
    every = df.groupBy(column).agg(F.count("*").alias("_all")).withColumn("baseline_share", F.col("_all") / F.sum("_all").over(Window.partitionBy()))  # a row for each value
    inside = df.groupBy(group, column).agg(F.count("*").alias("customers")).withColumn("share", F.col("customers") / F.sum("customers").over(Window.partitionBy(group)))
    top = first_by(inside, [group], [F.desc("customers"), F.asc(column)])
    return top.join(every.select(column, "baseline_share"), column).withColumn("enrichment", safe_divide(F.col("share"), F.col("baseline_share")))


def segment_profile(df: DataFrame, segment: str, measures: Sequence[str]) -> DataFrame:
    """Customers and the median of each measure by segment."""
    return with_quantiles(df.groupBy(segment).agg(F.count("*").alias("customers")), df, [segment], {f"median_{m}": m for m in measures})


def detection_summary(df: DataFrame, truth: str, detected: Column) -> DataFrame:
    """Customers and the share that a status marks, by true group."""
    return df.groupBy(truth).agg(F.count("*").alias("customers"), F.avg(F.coalesce(detected, F.lit(False)).cast("int")).alias("detected_rate"))


def expectations(df: DataFrame, table: str, rules: Mapping[str, Column], key: Sequence[str] = (ID,)) -> DataFrame:
    """(table, expectation, failures): rows that break each rule, and keys that repeat. Unknown counts as broken."""
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    one = df.agg(F.count("*").alias("n"), *broken)
    rows = F.array(*[F.struct(F.lit(name).alias("expectation"), F.col(f"r{i}").alias("failures")) for i, name in enumerate(rules)])
    out = one.select(F.explode(rows).alias("x")).select(F.lit(table).alias("table"), "x.*") if rules else None
    repeated = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("failures")).select(F.lit(table).alias("table"), F.lit("unique " + ", ".join(key)).alias("expectation"), "failures")
    return repeated if out is None else out.unionByName(repeated)
