"""What the explorer shows of one customer, from tables that are laid out for lookups: each reading opens one bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import safe_divide
from tidemark.operators import views
from tidemark.sources.lookup import FILE_ROWS, publish

ID = "golden_customer_id"


@dataclass(frozen=True)
class Explorer:
    """Published tables of transactions, customers (a row each) and resolved identity records; a customer without rows has empty results."""

    spark: SparkSession
    transactions: str
    customers: str
    records: str | None = None

    @classmethod
    def of(cls, transactions: DataFrame, customers: DataFrame, records: DataFrame | None = None, *, file_rows: int = FILE_ROWS) -> Explorer:
        """Publish the tables once; every customer is looked up in them."""
        named = {"explorer_transactions": (transactions, ("transaction_date",)), "explorer_customers": (customers, ()), "explorer_records": (records, ())}
        tables = [None if df is None else publish(df, name, ID, then=then, file_rows=file_rows) for name, (df, then) in named.items()]
        return cls(transactions.sparkSession, *tables)

    def _of(self, table: str, customer: int | str) -> DataFrame:
        return self.spark.table(table).where(F.col(ID) == F.lit(customer))

    def profile(self, customer: int | str) -> DataFrame:
        """The customer's row."""
        return self._of(self.customers, customer)

    def monthly_history(self, customer: int | str) -> DataFrame:
        """Orders, sales and margin of each month in which the customer bought."""
        month = F.trunc("transaction_date", "MM").alias("month")
        return self._of(self.transactions, customer).groupBy(month).agg(F.countDistinct("order_id").alias("orders"), F.sum("net_sales").alias("sales"), F.sum("gross_margin").alias("margin"))

    def gap_series(self, customer: int | str) -> DataFrame:
        """Each day of purchase after the first with its place and the days since the one before."""
        days = self._of(self.transactions, customer).select("transaction_date").distinct()
        order = Window.orderBy("transaction_date")  # the days of one customer
        gaps = days.select("transaction_date", F.row_number().over(order).alias("purchase"), F.datediff("transaction_date", F.lag("transaction_date").over(order)).alias("gap_days"))
        return gaps.where("gap_days is not null")

    def mix(self, customer: int | str, column: str) -> DataFrame:
        """The customer's orders, sales and share of sales by channel or category."""
        g = self._of(self.transactions, customer).groupBy(column).agg(F.count("*").alias("orders"), F.sum("net_sales").alias("sales"))
        return g.withColumn("sales_share", safe_divide(F.col("sales"), F.sum("sales").over(Window.partitionBy())))  # a row for each value

    def latest(self, customer: int | str, size: int = 20) -> DataFrame:
        """The customer's latest orders."""
        rows = self._of(self.transactions, customer).orderBy(F.desc("transaction_date"), F.desc("order_id")).limit(size)
        return rows.select("order_id", "transaction_date", "channel", "category", "net_sales")

    def evidence(self, customer: int | str) -> DataFrame:
        """Records, systems and confidence behind the customer."""
        if self.records is None:
            raise ValueError("the explorer was made without identity records")
        return views.identity_evidence(self._of(self.records, customer))


def busiest(df: DataFrame, key: str = ID) -> int | str:
    """The key with the most rows (the smallest of several)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).head()[0]
