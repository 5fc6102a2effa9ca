"""Training snapshots: what was known of each customer on a date, and what followed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.functions.scalars import flag, month_cos, month_sin, safe_divide

ID, T = "golden_customer_id", "observation_date"


#: Sums kept by customer, day, category and channel; orders count rows, as an order is one row of the transactions.
SUMS = {"orders": "1", "sales": "net_sales", "margin": "gross_margin", "units": "units", "discount": "coalesce(discount_pct, 0.0D)", "discounted": "cast(coalesce(discount_pct, 0.0D) > 0 as int)"}
#: Windows in days before and after an observation date: after the first, up to the second. `ahead` stands for None.
WINDOWS = {"life": (None, 0), "180": (-180, 0), "365": (-365, 0), "before_180": (-360, -180), "next": (0, None)}


def histories(tx: DataFrame) -> DataFrame:
    """One row for each customer with `h`: its sums by day, category and channel, in the order of days.

    Transactions are dealt by customer once. A history holds at most a row for each day and kinds, however many transactions a customer has.
    """
    dealt = tx.select(ID, F.unix_date("transaction_date").alias("day"), "category", "channel", *[F.expr(x).alias(f"_{c}") for c, x in SUMS.items()]).repartition(ID)
    days = dealt.groupBy(ID, "day", "category", "channel").agg(*[F.sum(f"_{c}").cast("double").alias(c) for c in SUMS])
    return days.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct("day", "category", "channel", *SUMS))).alias("h"))


def _window_sums(values: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The sum of values[since:until] for each pair; exactly 0 where that is empty."""
    at = np.column_stack([since, until]).ravel()
    return np.where(since < until, np.add.reduceat(np.append(values, 0.0), at)[::2], 0.0)


class _Kinds:
    """Counts of the kinds (categories or channels) of the customers of a batch."""

    def __init__(self, column: pa.Array, who: np.ndarray, day: np.ndarray, orders: np.ndarray, sales: np.ndarray, n: int) -> None:
        known, coded = column.is_valid().to_numpy(zero_copy_only=False), column.drop_null().dictionary_encode()
        names = np.array(coded.dictionary.to_pylist(), object)
        order = np.argsort(names)
        self.names, code = names[order], np.argsort(order)[coded.indices.to_numpy()]
        pairs, self.of = np.unique(who[known] * max(1, len(self.names)) + code, return_inverse=True)
        self.who, self.code = pairs // max(1, len(self.names)), pairs % max(1, len(self.names))
        self.day, self.orders, self.sales, self.n = day[known], orders[known], sales[known], n

    def count(self, since: int | None, until: int, values: np.ndarray | None = None) -> np.ndarray:
        inside = (self.day <= until) & (True if since is None else self.day > since)
        return np.bincount(self.of[inside], (self.orders if values is None else values)[inside], len(self.who))

    def largest(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        np.maximum.at(out, self.who, values)
        return out

    def on(self, date: int, ahead: int) -> dict[str, np.ndarray | pa.Array]:
        """How many kinds were bought, ever and lately, how orders and sales spread over them, and which are first bought in the days ahead."""
        now, sales, total = self.count(None, date), self.count(None, date, self.sales), lambda x: np.bincount(self.who, x, self.n)
        new = (now == 0) & (self.count(date, date + ahead) > 0)
        ends = np.append(0, np.cumsum(total(new))).astype(np.int32)
        return {
            "used": total(now > 0), "used_180d": total(self.count(date - 180, date) > 0), "used_365d": total(self.count(date - 365, date) > 0),
            "largest": self.largest(now), "orders": total(now), "squares": total(now * now), "largest_sales": self.largest(sales), "sales": total(sales),
            "new": pa.ListArray.from_arrays(pa.array(ends), pa.array(self.names[self.code[new]], pa.string())),
        }


KIND_COLUMNS = ("used", "used_180d", "used_365d", "largest", "orders", "squares", "largest_sales", "sales")


def _known(batch: pa.RecordBatch, dates: Sequence[int], ahead: int, new_ahead: int) -> Iterator[pa.RecordBatch]:
    """What was known on each date of the customers whose history had begun: windows are found by binary search in all days of the batch."""
    ids, h, n = batch.column(0), batch.column(1), batch.num_rows
    rows, ends = h.flatten(), h.offsets.to_numpy().astype(np.int64)
    start, who = ends[:-1] - ends[0], np.repeat(np.arange(n), np.diff(ends))
    field = lambda c: rows.field(c).fill_null(0).to_numpy(zero_copy_only=False)
    day, sums = field("day").astype(np.int64), {c: field(c) for c in SUMS}
    far, every = 1 << 24, np.arange(n)  # more than any number of days
    at = lambda keys, date: np.searchsorted(keys, every * far + date, side="right")
    keys = who * far + day
    first = np.append(True, keys[1:] != keys[:-1])  # of a customer's day
    days, whose = day[first], who[first]
    day_keys, day_start = whose * far + days, np.searchsorted(whose, every)
    gap = np.append(0, np.diff(days)) * (np.arange(len(days)) != day_start[whose])
    by_size = np.lexsort((gap, whose))
    kinds = {c: _Kinds(rows.field(c), who, day, sums["orders"], sums["sales"], n) for c in ("category", "channel")}
    for date in dates:
        out: dict[str, np.ndarray | pa.Array] = {}
        for name, (since, until) in WINDOWS.items():
            lo = start if since is None else at(keys, date + since)
            hi = at(keys, date + (ahead if until is None else until))
            out |= {f"{name}_{c}": _window_sums(sums[c], lo, hi) for c in (SUMS if name == "life" else ("orders", "sales", "margin"))}
        last = at(day_keys, date)
        gaps = np.maximum(0, last - day_start - 1)
        begun = last > day_start
        out |= {"first_day": days[day_start], "last_day": days[np.maximum(last - 1, 0)], "gaps": gaps, "gap_squares": _window_sums(gap.astype(float) ** 2, np.minimum(day_start + 1, last), last)}
        counts = (by_size > day_start[whose[by_size]]) & (by_size < last[whose[by_size]])
        ordered, before = np.append(gap[by_size[counts]], 0), np.cumsum(gaps) - gaps
        out |= {"gap_low": ordered[np.where(gaps > 0, before + (gaps - 1) // 2, -1)], "gap_high": ordered[np.where(gaps > 0, before + gaps // 2, -1)]}
        for c, kind in kinds.items():
            out |= {f"{c}_{name}": x for name, x in kind.on(date, new_ahead).items()}
        out.pop("channel_new")
        arrays = [pa.array(np.full(n, date, np.int32)), ids, out.pop("category_new"), *[pa.array(np.asarray(x, np.float64)) for x in out.values()]]
        yield pa.RecordBatch.from_arrays(arrays, ["day", ID, "new_categories", *out]).filter(pa.array(begun))


def known(tx: DataFrame, dates: Sequence, *, ahead: int, new_ahead: int) -> DataFrame:
    """A row for each customer and date by which its history had begun: sums of WINDOWS, gaps between its days, and its kinds. The dates are a fixed short list."""
    numbers = [f"{w}_{c}" for w in WINDOWS for c in (SUMS if w == "life" else ("orders", "sales", "margin"))]
    numbers += ["first_day", "last_day", "gaps", "gap_squares", "gap_low", "gap_high", *[f"{c}_{k}" for c in ("category", "channel") for k in KIND_COLUMNS]]
    schema = ", ".join(["day int", f"{ID} long", "new_categories array<string>", *[f"{c} double" for c in numbers]])
    spark = tx.sparkSession
    on = [r.d for r in spark.range(1).select(F.explode(F.array(*[F.unix_date(F.lit(d).cast("date")) for d in dates])).alias("d")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _known(batch, on, ahead, new_ahead)

    return histories(tx).select(F.col(ID).cast("long").alias(ID), "h").mapInArrow(run, schema).withColumn(T, F.date_from_unix_date("day")).drop("day")


def history_features(tx: DataFrame, dates: Sequence, *, ahead: int = 90, new_ahead: int = 90) -> DataFrame:
    """Lifetime, 180-day, 365-day, gap and momentum features of each customer on each date, orders, sales and margin of the `ahead` days after it (future_*), and the categories first bought in the `new_ahead` days after it.

    Transactions are read and dealt by customer once and are not repeated for each date.
    """
    c, whole = F.col, lambda x: F.col(x).cast("long")
    three = lambda window, names: [whole(f"{window}_orders").alias(names[0]), c(f"{window}_sales").alias(names[1]), c(f"{window}_margin").alias(names[2])]
    n = whole("gaps")
    mean = (c("last_day") - c("first_day")) / F.nullif(n, F.lit(0))
    squares = c("gap_squares") - (c("last_day") - c("first_day")) * (c("last_day") - c("first_day")) / F.nullif(n, F.lit(0))
    today = F.unix_date(T)
    out = known(tx, dates, ahead=ahead, new_ahead=new_ahead).where("category_used > 0 and channel_used > 0").select(
        T, ID,
        whole("life_orders").alias("lifetime_orders"), c("life_sales").alias("lifetime_sales"), c("life_margin").alias("lifetime_margin"), whole("life_units").alias("lifetime_units"),
        *[(c(f"life_{x}") / c("life_orders")).alias(name) for x, name in (("sales", "avg_order_value"), ("margin", "avg_margin_per_order"), ("discount", "avg_discount_pct"), ("discounted", "discounted_order_share"))],
        (today - c("last_day")).cast("int").alias("days_since_last_purchase"), (today - c("first_day")).cast("int").alias("purchase_tenure_days"),
        *three("180", ("orders_prior_180d", "sales_prior_180d", "margin_prior_180d")), *three("365", ("orders_prior_365d", "sales_prior_365d", "margin_prior_365d")),
        *three("180", ("recent_orders", "recent_sales", "recent_margin")), *three("before_180", ("prior_orders", "prior_sales", "prior_margin")),
        *three("next", [f"future_{x}_{ahead}d" for x in ("orders", "sales", "margin")]),
        n.alias("observed_purchase_gaps"), F.when(n > 0, (c("gap_low") + c("gap_high")) / 2).alias("median_purchase_gap_days"), mean.alias("mean_purchase_gap_days"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares) / (n - 1))).alias("std_purchase_gap_days"),
        whole("category_used").alias("categories_used"), whole("category_used_180d").alias("categories_prior_180d"), whole("category_used_365d").alias("categories_prior_365d"),
        safe_divide(c("category_largest"), c("category_orders")).alias("dominant_category_share"), safe_divide(c("category_squares"), c("category_orders") * c("category_orders")).alias("category_concentration"),
        safe_divide(c("category_largest_sales"), c("category_sales")).alias("dominant_category_sales_share"), "new_categories",
        whole("channel_used").alias("channels_used"), safe_divide(c("channel_largest"), c("channel_orders")).alias("preferred_channel_share"),
    )
    out = out.withColumns({
        "margin_rate": safe_divide(c("lifetime_margin"), c("lifetime_sales")),
        "cadence_cv": safe_divide(c("std_purchase_gap_days"), c("mean_purchase_gap_days")),
        "expected_return_days": c("median_purchase_gap_days"),
        "adjusted_lapse_ratio": safe_divide(c("days_since_last_purchase"), c("median_purchase_gap_days")),
        "order_change_pct": safe_divide(c("recent_orders") - c("prior_orders"), c("prior_orders")),
        "sales_change_pct": safe_divide(c("recent_sales") - c("prior_sales"), c("prior_sales")),
        "margin_change_pct": safe_divide(c("recent_margin") - c("prior_margin"), c("prior_margin")),
    })
    enough = (c("lifetime_orders") >= 3) & (c("observed_purchase_gaps") >= 2) & (c("purchase_tenure_days") >= 180)
    return out.withColumn("eligible_reengagement", flag(enough & (c("days_since_last_purchase") >= 45) & (c("adjusted_lapse_ratio") >= 1.5)))


def reengagement_training(tx: DataFrame, cfg: Config = DEFAULT, *, eligible_only: bool = True) -> DataFrame:
    """Eligible customers at each quarter end with their outcome over 90 days."""
    out = history_features(tx, cfg.reengagement_dates).withColumn("purchased_next_90d", (F.col("future_orders_90d") > 0).cast("int"))
    return out.where("eligible_reengagement") if eligible_only else out


def cross_sell_training(tx: DataFrame, cfg: Config = DEFAULT, *, days: int = 180) -> DataFrame:
    """Customers with room for new categories at each quarter end, and the categories they add within 180 days."""
    total = tx.agg(F.countDistinct("category").alias("total_categories"))
    out = history_features(tx, cfg.cross_sell_dates, new_ahead=days).crossJoin(F.broadcast(total))  # one row
    out = out.withColumns({"category_whitespace_count": F.col("total_categories") - F.col("categories_used"), "category_coverage_pct": F.col("categories_used") / F.col("total_categories")})
    out = out.withColumns({"new_category_count": F.size("new_categories"), "cross_sell_next_180d": (F.size("new_categories") > 0).cast("int")})
    return out.where((F.col("lifetime_orders") >= 3) & (F.col("purchase_tenure_days") >= 180) & (F.col("categories_used") >= 1) & (F.col("category_whitespace_count") > 0))


def _sums(inside: Column, suffix: str) -> list[Column]:
    when = lambda c: F.when(inside, F.col(c))
    return [F.count_if(inside).alias(f"orders_{suffix}"), F.coalesce(F.sum(when("net_sales")), F.lit(0.0)).alias(f"sales_{suffix}"), F.coalesce(F.sum(when("gross_margin")), F.lit(0.0)).alias(f"margin_{suffix}")]


def promotion_training(tx: DataFrame, exposures: DataFrame) -> DataFrame:
    """History before each campaign date joined to its exposures; needs 90 days of tenure and two orders.

    Both sides are dealt by customer once, and an exposure's sums are made where they were joined.
    An order is one row of the transactions; kinds are collected as small sets, so that rows are not
    repeated for each distinct count.
    """
    day = F.col("campaign_date")
    others = [c for c in exposures.columns if c not in ("exposure_id", ID)]
    needed = tx.select(ID, "transaction_date", "category", "channel", "net_sales", "gross_margin", "discount_pct")
    h = exposures.join(needed, ID).where(F.col("transaction_date") < day)
    near = F.col("transaction_date") >= F.date_sub("campaign_date", 180)
    offer = F.col("category") == F.col("offer_category")
    kinds = lambda c: F.size(F.collect_set(c))
    f = h.groupBy(ID, "exposure_id").agg(
        F.first(F.struct(*others)).alias("_e"),
        F.count("*").alias("lifetime_orders"),
        F.sum("net_sales").alias("lifetime_sales"),
        F.sum("gross_margin").alias("lifetime_margin"),
        F.avg("net_sales").alias("average_order_value"),
        F.avg("discount_pct").alias("average_discount_pct"),
        F.avg((F.coalesce("discount_pct", F.lit(0.0)) > 0).cast("int")).alias("discounted_order_share"),
        kinds("category").alias("lifetime_categories"),
        kinds("channel").alias("lifetime_channels"),
        kinds(F.when(near, F.col("category"))).alias("categories_prior_180d"),
        kinds(F.when(near, F.col("channel"))).alias("channels_prior_180d"),
        F.avg(F.when(near, F.col("discount_pct"))).alias("avg_discount_prior_180d"),
        F.avg(F.when(near, (F.col("discount_pct") > 0).cast("int"))).alias("discounted_order_share_prior_180d"),
        F.datediff(F.first("campaign_date"), F.max("transaction_date")).alias("days_since_last_purchase"),
        F.datediff(F.first("campaign_date"), F.min("transaction_date")).alias("customer_tenure_days"),
        *_sums(near, "prior_180d"),
        F.count_if(offer).alias("offer_category_prior_orders"),
        F.coalesce(F.sum(F.when(offer, F.col("net_sales"))), F.lit(0.0)).alias("offer_category_prior_sales"),
    )
    out = f.select("exposure_id", ID, "_e.*", *[c for c in f.columns if c not in ("exposure_id", ID, "_e")]).where((F.col("customer_tenure_days") >= 90) & (F.col("lifetime_orders") >= 2))
    return out.withColumns({
        "offer_category_order_share": safe_divide(F.col("offer_category_prior_orders"), F.col("lifetime_orders")),
        "offer_category_seen_before": (F.col("offer_category_prior_orders") > 0).cast("int"),
        "lifetime_margin_rate": safe_divide(F.col("lifetime_margin"), F.col("lifetime_sales")),
        "recent_margin_rate": safe_divide(F.col("margin_prior_180d"), F.col("sales_prior_180d")),
        "campaign_month_sin": month_sin(F.col("campaign_date")),
        "campaign_month_cos": month_cos(F.col("campaign_date")),
        "orders_per_30d_tenure": F.col("lifetime_orders") / (F.greatest(F.col("customer_tenure_days"), F.lit(1)) / 30),
    })
