"""Ledger analytics: billing cycle, audit, subscriptions, forecast, statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklore.operators.spread import previous

# Fixed values.
SCHEMA = """transactions ARRAY<STRUCT<json: STRUCT<merchantName: STRING, actualPaymentAmount: DECIMAL(18,2), originalAmount: DECIMAL(18,2),
  purchaseDate: STRING, paymentDate: STRING, originalCurrency: STRING, categoryId: STRING>>>"""
KNOWN_SUBSCRIPTIONS = ["Netflix", "Spotify", "Apple", "Google", "Adobe"]
FIXED_COSTS = ["Netflix", "Rent", "Internet"]
CYCLE_DAY = 15
ACTIVE_DAYS = 31
HIGH_VALUE = 1000
BUDGET = 20000
SCENARIOS = {"conservative": 1.0, "optimistic": 0.8, "pessimistic": 1.2}
REGULAR_MONTHS = 3


def ledger(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transactions of the landed files; the paid amount, else the original one.

    A file a month is read whole by one task; files of one document per line
    (``multi_line=False``) are split.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)
    t = raw.select(F.explode("transactions").alias("t")).select("t.json.*")
    return t.select(
        F.col("merchantName").alias("merchant"),
        F.coalesce("actualPaymentAmount", "originalAmount").alias("amount"),
        F.try_to_timestamp("purchaseDate").alias("purchased_at"),
        F.try_to_timestamp("paymentDate").alias("paid_at"),
        F.col("originalCurrency").alias("currency"),
        F.col("categoryId").alias("category"),
    ).filter(F.col("amount").isNotNull())


def cycle_start(as_of: str, day: int = CYCLE_DAY) -> Column:
    """The given day of last month."""
    return F.date_add(F.add_months(F.trunc(F.to_date(F.lit(as_of)), "month"), -1), day - 1)


def in_cycle(as_of: str, day: int = CYCLE_DAY) -> Column:
    return F.col("paid_at").isNull() | (F.to_date("paid_at") > cycle_start(as_of, day))


def cycle(df: DataFrame, as_of: str, day: int = CYCLE_DAY) -> DataFrame:
    """Pending rows, and rows paid after the cycle day of last month."""
    return df.filter(in_cycle(as_of, day))


def _hours(a: Column, b: Column) -> Column:
    return (F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))) / 3600000


def duplicates(df: DataFrame) -> DataFrame:
    """Same merchant and amount within 24 hours of the charge before.

    Only the day itself and the day before can hold that charge: every row also
    stands, for looking back only, in the next day, and each day is windowed
    alone.
    """
    day = F.to_date("purchased_at")
    both = F.array(F.struct(day.alias("_day"), F.lit(True).alias("_own")), F.struct(F.date_add(day, 1).alias("_day"), F.lit(False).alias("_own")))
    rows = df.select("*", F.inline(both))
    w = Window.partitionBy("merchant", "amount", "_day").orderBy("purchased_at", "row_id")
    back = rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("purchased_at", "row_id")])
    near = _hours(F.col("purchased_at"), F.col("prev_purchased_at")) <= 24
    return back.filter(F.col("_own") & near).drop("_day", "_own")


def subscription_merchants(df: DataFrame) -> DataFrame:
    """Known services, and merchants charged in several months; months are
    made distinct before they are counted."""
    months = df.groupBy("merchant", F.date_trunc("month", "purchased_at").alias("_m")).agg(
        F.min("purchased_at").alias("first_at"), F.max(F.struct("purchased_at", "row_id", "amount")).alias("_last"), F.sum("amount").alias("_sum")
    )
    per = months.groupBy("merchant").agg(
        F.count(F.lit(1)).alias("months"), F.min("first_at").alias("first_at"), F.max("_last").alias("_l"), F.sum("_sum").alias("total")
    )
    regular = F.col("merchant").isin(KNOWN_SUBSCRIPTIONS) | (F.col("months") >= REGULAR_MONTHS)
    return per.filter(regular).select("merchant", "months", "first_at", F.col("_l.purchased_at").alias("last_at"), F.col("_l.amount").alias("last_amount"), "total")


def sub_changes(df: DataFrame, as_of: str) -> DataFrame:
    """In this cycle: a subscription not seen before, or dearer than its last charge."""
    subs = subscription_merchants(df).select("merchant", "first_at")
    rows = previous(df, ["merchant"], ["purchased_at", "row_id"], ["amount"]).join(subs, "merchant")
    now = rows.filter(in_cycle(as_of))
    what = F.when(F.to_date("first_at") > cycle_start(as_of), "New Subscription").when(F.col("amount") > F.col("prev_amount"), "Price Increase")
    return now.withColumn("finding", what).filter(F.col("finding").isNotNull())


def high_value(df: DataFrame, limit: float = HIGH_VALUE) -> DataFrame:
    return df.filter(F.col("amount") > limit)


def subscriptions(df: DataFrame, as_of: str) -> DataFrame:
    """Subscriptions with status and cost; stopped ones cost nothing."""
    active = F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_at")) <= ACTIVE_DAYS
    monthly = F.when(active, F.col("last_amount")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return subscription_merchants(df).select(
        "merchant", "months", "last_at", F.when(active, "active").otherwise("stopped").alias("status"), monthly.alias("monthly"), (monthly * 12).alias("yearly")
    )


def subscription_totals(subs: DataFrame) -> DataFrame:
    return subs.agg(F.count_if(F.col("status") == "active").alias("n_active"), F.sum("monthly").alias("monthly"), F.sum("yearly").alias("yearly"))


def forecast(df: DataFrame, as_of: str, end: str) -> DataFrame:
    """Spent so far, fixed costs still to come, and variable spending to the end
    of the cycle at today's rate, a fifth lower, a fifth higher."""
    fixed, now = F.col("merchant").isin(FIXED_COSTS), in_cycle(as_of)
    per = df.groupBy("merchant").agg(
        F.sum(F.when(now, F.col("amount"))).alias("_now"),
        F.max(F.when(~now, F.struct("purchased_at", "row_id", "amount"))).alias("_before"),
    )
    one = per.agg(
        F.coalesce(F.sum("_now"), F.lit(0)).cast("double").alias("spent"),
        F.coalesce(F.sum(F.when(fixed & F.col("_now").isNull(), F.col("_before.amount"))), F.lit(0)).cast("double").alias("fixed_left"),
        F.coalesce(F.sum(F.when(~fixed, F.col("_now"))), F.lit(0)).cast("double").alias("variable"),
    )
    gone = F.greatest(F.datediff(F.to_date(F.lit(as_of)), cycle_start(as_of)), F.lit(1))
    left = F.greatest(F.datediff(F.to_date(F.lit(end)), F.to_date(F.lit(as_of))), F.lit(0))
    rows = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("rate")) for k, v in SCENARIOS.items()])
    burn = (F.col("variable") / gone).alias("burn")
    return one.select("spent", "fixed_left", burn, F.inline(rows)).withColumn(
        "total", F.col("spent") + F.col("fixed_left") + F.col("burn") * F.col("rate") * left
    )


def statement(df: DataFrame) -> DataFrame:
    """Spending by category and its share, largest first."""
    total = df.agg(F.sum("amount")).scalar()
    per = df.groupBy("category").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("percent", F.round(F.col("total").cast("double") * 100 / total.cast("double"), 6)).orderBy(F.desc("total"), "category")


def summary(df: DataFrame, as_of: str, budget: float = BUDGET) -> DataFrame:
    """Spent, net against the budget, daily burn."""
    gone = F.greatest(F.datediff(F.to_date(F.lit(as_of)), cycle_start(as_of)), F.lit(1))
    spent = F.coalesce(F.sum("amount"), F.lit(0)).cast("double")
    return df.agg(spent.alias("spent")).select("spent", (F.lit(float(budget)) - F.col("spent")).alias("net"), (F.col("spent") / gone).alias("burn"))


def findings(df: DataFrame, as_of: str, limit: float = HIGH_VALUE) -> DataFrame:
    """All audit findings of the cycle with their severity."""
    one = lambda rows, what, level: rows.select("row_id", "merchant", "amount", what.alias("finding"), F.lit(level).alias("severity"))
    dup = one(duplicates(df).filter(in_cycle(as_of)), F.lit("Potential Duplicate"), "critical")
    sub = one(sub_changes(df, as_of), F.col("finding"), "warning")
    return dup.unionByName(sub).unionByName(one(high_value(cycle(df, as_of), limit), F.lit("High Value"), "warning"))
