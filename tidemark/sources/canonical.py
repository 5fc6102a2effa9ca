"""Canonical transactions, customers, identity records and campaign exposures from the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import cents
from tidemark.functions.windows import positions

# Parts from which identity records and campaigns are made.
FIRST_NAMES = ("olivia", "noah", "amelia", "jack", "isla", "leo", "mia", "henry", "ava", "lucas", "grace", "ethan", "zoe", "liam", "ruby", "owen")
LAST_NAMES = ("nguyen", "smith", "patel", "williams", "brown", "jones", "garcia", "wilson", "taylor", "martin", "anderson", "thompson", "walker", "harris", "lewis", "young")
STREETS = ("High Street", "Station Road", "Park Avenue", "Church Street", "Victoria Drive", "King Street", "Mill Road", "Queen Court")
VARIANTS = ("Canonical", "First Initial", "Surname Typo", "Missing Email", "Email Case", "Email Alias", "Missing Phone", "Phone Format", "Address Abbreviation", "Exact Copy")
CHANNELS = ("Email", "SMS", "App")
DEPTHS = (0.10, 0.15, 0.20, 0.25)
CAMPAIGNS = tuple(f"{y}-{m}-15" for y in (1999, 2000, 2001) for m in ("02", "05", "08", "11") if (y, m) <= (2001, "05"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: Column, salt: str, size: int) -> Column:
    """A fixed pseudo-random number below size from the key's md5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), 1, 7), 16, 10).cast("int"), F.lit(size))


def choose(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def transactions(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """One row for each order with lines: the dominant line gives category and discount, money is summed and rounded to cents."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size").hint("shuffle_hash")
    lines = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey").withColumnRenamed("p_partkey", "l_partkey")
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "p_type", "p_size").repartition("l_orderkey")  # lines are dealt, not partial sums, which are wider and hardly fewer
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    main = F.max(F.struct("l_extendedprice", -F.col("l_partkey"), -F.col("l_suppkey"), -F.col("l_linenumber"), "l_discount", "p_type"))
    orders = lines.groupBy("l_orderkey").agg(
        main.alias("main"),
        F.sum("l_quantity").cast("long").alias("units"),
        cents(F.sum("l_extendedprice")).alias("gross_sales"),
        cents(F.sum(net)).alias("net_sales"),
        cents(F.sum(net * (0.12 + 0.43 * (F.col("p_size") - 1) / 49))).alias("gross_margin"),
    )
    kept = read(spark, sf_dir, "orders").withColumn("transaction_date", F.to_date("o_orderdate")).where(F.col("transaction_date") <= F.lit(cfg.as_of))
    status = F.col("o_orderstatus")
    return kept.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("golden_customer_id"),
        "transaction_date",
        F.when(status == "F", "Store").when(status == "O", "Online").otherwise("Click & Collect").alias("channel"),
        F.col("main.p_type").alias("category"),
        "units",
        "gross_sales",
        F.greatest(F.lit(0.0), cents(F.col("main.l_discount") - 0.05)).alias("discount_pct"),
        "net_sales",
        cents(F.col("net_sales") - F.col("gross_margin")).alias("cost"),
        "gross_margin",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """golden_customer_id, state, market_segment."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("golden_customer_id"), "state", F.col("c_mktsegment").alias("market_segment"))


def identity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 to 5 fragments a customer with md5-chosen noise; variant_type and true_person_id are for evaluation only."""
    person = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    draw = bucket(F.col("person"), "fragments", 100)
    count = F.when(draw < 64, 1).when(draw < 87, 2).when(draw < 96, 3).when(draw < 99, 4).otherwise(5)
    rows = person.withColumn("k", F.explode(F.sequence(F.lit(1), count)))
    unit = F.concat_ws("-", F.col("person").cast("string"), F.col("k").cast("string"))
    noise = F.when(F.col("k") == 1, 0).otherwise(bucket(unit, "noise", 10))
    first, last = choose(FIRST_NAMES, bucket(F.col("person"), "first", 16)), choose(LAST_NAMES, bucket(F.col("person"), "last", 16))
    number = F.lpad(F.col("person").cast("string"), 7, "0")
    email = F.concat(first, F.lit("."), last, F.col("person").cast("string"), F.lit("@example.com"))
    phone = F.concat(F.lit("04"), F.lpad(bucket(F.col("person"), "phone", 10), 1, "0"), number)
    street = F.concat((bucket(F.col("person"), "house", 300) + 1).cast("string"), F.lit(" "), choose(STREETS, bucket(F.col("person"), "street", 8)))
    system = choose(("POS", "Ecommerce", "Loyalty", "Service", "Marketing"), F.pmod(F.col("k") - 1 + F.col("person"), F.lit(5)).cast("int"))
    return rows.select(
        F.format_string("IDR_%07d_%02d", "person", "k").alias("identity_record_id"),
        F.format_string("SRC_%07d_%02d", "person", "k").alias("source_customer_id"),
        system.alias("source_system"),
        F.when(noise == 1, F.initcap(F.substring(first, 1, 1))).otherwise(F.initcap(first)).alias("first_name"),
        F.when(noise == 2, F.concat(F.initcap(last), F.lit("e"))).otherwise(F.initcap(last)).alias("last_name"),
        F.when(noise == 3, F.lit(None)).when(noise == 4, F.upper(email)).when(noise == 5, F.regexp_replace(email, "@", "+shop@")).otherwise(email).alias("email"),
        F.when(noise == 6, F.lit(None)).when(noise == 7, F.concat(F.lit("+61 "), F.substring(phone, F.lit(2), F.length(phone)))).otherwise(phone).alias("phone"),
        F.when(noise == 8, F.regexp_replace(street, "Street", "St")).otherwise(street).alias("address"),
        (2000 + bucket(F.col("person"), "postcode", 800)).cast("string").alias("postcode"),
        F.when(F.col("k") == 1, "Primary").otherwise("Fragment").alias("source_role"),
        (system.isin("POS", "Ecommerce", "Loyalty")).alias("transaction_eligible"),
        choose(VARIANTS, noise).alias("variant_type"),
        F.col("person").alias("true_person_id"),
    )


def ambiguous_households(records: DataFrame, per_thousand: int = 50, same_name: bool = False) -> DataFrame:
    """Records in which pairs of people live at one address, as household_case_id tells; null for all others.

    People drawn by their md5 are paired in the order of another md5; the second of a pair takes the
    address and postcode of the first, with same_name the family name too, and its variant_type says
    so. People without an address or postcode are never drawn, and of an odd number the last stays alone.
    """
    person = F.col("true_person_id")
    home = records.where("variant_type = 'Canonical' and address is not null and postcode is not null").where(bucket(person, "household", 1000) < per_thousand)
    home = home.groupBy("true_person_id").agg(F.min(F.struct("address", "postcode", "last_name")).alias("home"))
    order = F.md5(F.concat(F.lit("pair"), person.cast("string")).cast("binary"))
    ranked = positions(home, [order, person], "true_person_id").where("_rank < _n or _n % 2 = 0").select("true_person_id", F.expr("(_rank + 1) div 2").alias("case"), (F.col("_rank") % 2 == 0).alias("second"))
    first = ranked.where("not second").join(home, "true_person_id").select("case", "home")
    dealt = ranked.join(first, "case").select("true_person_id", "case", F.when(F.col("second"), F.col("home")).alias("home"))
    shared = F.col("home").isNotNull()
    taken = lambda c: F.when(shared, F.col(f"home.{c}")).otherwise(F.col(c)).alias(c)
    moved = ["address", "postcode", *(["last_name"] if same_name else [])]
    variant = F.when(shared, F.concat("variant_type", F.lit(" | Shared Household"))).otherwise(F.col("variant_type")).alias("variant_type")
    kept = [taken(c) if c in moved else variant if c == "variant_type" else F.col(c) for c in records.columns]
    return records.join(dealt, "true_person_id", "left").select(*kept, F.format_string("HH_%07d", "case").alias("_hh"), "case").select(*records.columns, F.when(F.col("case").isNotNull(), F.col("_hh")).alias("household_case_id"))


def campaign_exposures(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT, tx: DataFrame | None = None) -> DataFrame:
    """Customers with two earlier orders and 90 days of tenure, by campaign; audience, treatment and offer come from md5 buckets."""
    tx = transactions(spark, sf_dir, cfg) if tx is None else tx
    categories = ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE")
    dates = F.explode(F.array(*[F.lit(d).cast("date") for d in CAMPAIGNS]))
    unit = F.concat_ws("|", F.col("golden_customer_id").cast("string"), F.col("campaign_date").cast("string"))
    days = tx.select("golden_customer_id", "transaction_date", "category").repartition("golden_customer_id").groupBy("golden_customer_id", "transaction_date", "category").agg(F.count("*").alias("n"))
    # repeated for each campaign only inside the task that holds the customer
    history = days.withColumn("campaign_date", dates).where(F.col("transaction_date") <= F.date_add("campaign_date", 30))
    before, after = F.col("transaction_date") < F.col("campaign_date"), F.col("transaction_date") > F.col("campaign_date")
    offer = choose(categories, bucket(unit, "offer", 6))
    base = history.groupBy("golden_customer_id", "campaign_date").agg(F.max("campaign_date").alias("day"), F.sum(F.when(before, F.col("n"))).alias("prior"), F.min(F.when(before, F.col("transaction_date"))).alias("first"), F.count_if(after & (F.col("category") == offer)).alias("bought"))
    enough = (F.col("prior") >= 2) & (F.datediff("campaign_date", "first") >= 90)
    # the audience is drawn from `day`, not from the key it equals: as a filter on a key it would be moved below the sums and drawn for each row
    invited = bucket(F.concat_ws("|", F.col("golden_customer_id").cast("string"), F.col("day").cast("string")), "audience", 100) < 38
    out = base.where(enough & invited).select(
        F.concat(F.lit("EXP_"), F.md5(unit.cast("binary"))).alias("exposure_id"),
        F.date_format("campaign_date", "'CMP_'yyyyMM").alias("campaign_id"),
        "campaign_date",
        "golden_customer_id",
        (bucket(unit, "treat", 100) < 80).cast("int").alias("treatment_flag"),
        choose(CHANNELS, bucket(unit, "channel", 3)).alias("campaign_channel"),
        offer.alias("offer_category"),
        choose(DEPTHS, bucket(unit, "depth", 4)).alias("discount_depth"),
        F.lit(30).alias("response_window_days"),
        F.date_add("campaign_date", 30).alias("response_window_end"),
        "bought",
        bucket(unit, "respond", 1000).alias("draw"),
    )
    chance = F.when(F.col("treatment_flag") == 1, 60 + 600 * F.col("discount_depth")).otherwise(40)
    return out.withColumn("responded", ((F.col("bought") > 0) | (F.col("draw") < chance)).cast("int")).drop("bought", "draw")
