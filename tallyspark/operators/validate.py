"""Validation of a loaded ledger: one-pass counters, balances, calendars, duplicates, dispersion, trial balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import base_amount, blank, melted, quantiles, zero
from .rules import REQUIRED


def schema_report(gl: DataFrame) -> DataFrame:
    """(check_name, failures): all failures of all rows, counted in one pass."""
    tests = {f"{c}_missing": blank(c) for c in REQUIRED} | {
        "period_out_of_range": ~F.col("fiscal_period").between(1, 16), "negative_debit": F.col("debit_amount") < 0, "negative_credit": F.col("credit_amount") < 0, "both_sides": (zero("debit_amount") > 0) & (zero("credit_amount") > 0),
        "account_format": ~F.col("gl_account").rlike(r"^[0-9]{6}\z"),
    }
    one = gl.agg(*(F.count(F.when(cond, 1)).alias(k) for k, cond in tests.items()))
    return one.unpivot([], list(tests), "check_name", "failures")


def balances(gl: DataFrame) -> DataFrame:
    """Per document: debit, credit and difference, where it is at least a cent."""
    g = gl.filter("document_id is not null").groupBy("document_id").agg(F.round(F.sum(zero("debit_amount")), 2).alias("debit"), F.round(F.sum(zero("credit_amount")), 2).alias("credit"))
    return g.withColumn("difference", F.round(F.col("debit") - F.col("credit"), 2)).filter(F.abs("difference") >= 0.01)


def gate(gl: DataFrame) -> DataFrame:
    """One row: the total difference and the share of unbalanced documents, and whether the load may go on (1 % and 10 %)."""
    per = gl.filter("document_id is not null").groupBy("document_id").agg(F.sum(zero("debit_amount")).alias("d"), F.sum(zero("credit_amount")).alias("c"))
    g = per.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.abs(F.col("d") - F.col("c")) >= 0.01, 1)).alias("unbalanced"), F.sum("d").alias("d"), F.sum("c").alias("c"))
    diff, share = F.abs(F.col("d") - F.col("c")) / F.greatest("d", "c", F.lit(1.0)), F.col("unbalanced") / F.greatest("documents", F.lit(1))
    return g.select("documents", "unbalanced", F.round(diff, 6).alias("difference_ratio"), ((diff <= 0.01) & (share <= 0.10)).alias("may_load"))


def missing_business_days(gl: DataFrame) -> DataFrame:
    """Weekdays between the first and the last posting without any."""
    d = gl.filter(F.col("posting_date").isNotNull()).select(F.col("posting_date").cast("date").alias("day")).distinct()
    all_ = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return all_.filter(F.weekday("day") < 5).join(d, "day", "left_anti")


def repeated_rows(df: DataFrame, but: list[str]) -> DataFrame:
    """How many rows are repetitions (beyond the first) of another in all columns but the named. Rows are compared by two independent 64-bit hashes."""
    cols = [c for c in df.columns if c not in but]
    g = df.select(F.xxhash64(*cols).alias("a"), F.xxhash64(*reversed(cols), F.lit(7)).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def volatility(gl: DataFrame) -> DataFrame:
    """Per month: lines, amount, change and z-score of the amount over the months, and its ratio to the mean month."""
    m = gl.filter(F.col("posting_date").isNotNull()).groupBy(F.date_format("posting_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(base_amount()), 2).alias("amount"))
    w, a = Window.orderBy("month"), Window.partitionBy()  # over months
    m = m.withColumn("change", F.col("amount") / F.lag("amount").over(w) - 1)
    return m.withColumns({"z": (F.col("amount") - F.avg("amount").over(a)) / F.stddev_samp("amount").over(a), "seasonality": F.col("amount") / F.avg("amount").over(a)})


def dispersion(gl: DataFrame) -> DataFrame:
    """Per company: lines, coefficient of variation, skewness and excess kurtosis of the amounts, bias-corrected as usual for samples, and the Herfindahl index of accounts."""
    x = gl.withColumn("v", base_amount()).filter("v > 0")
    g = x.groupBy("company_code").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("v") / F.avg("v")).alias("cv"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    n = F.col("n").cast("double")
    g = g.withColumns({"skew": F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)), "kurt": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))})
    a = x.groupBy("company_code", "gl_account").agg(F.sum("v").alias("a"))
    h = a.groupBy("company_code").agg((F.sum(F.col("a") * F.col("a")) / F.pow(F.sum("a"), 2)).alias("hhi"))
    return g.join(h, "company_code").select("company_code", "n", "cv", "skew", "kurt", "hhi")


def yearly_pivot(gl: DataFrame, years: list[int]) -> DataFrame:
    """Amounts per month, a column for each year."""
    x = gl.filter(F.col("posting_date").isNotNull()).withColumn("v", base_amount())
    p = x.groupBy(F.month("posting_date").alias("month")).pivot("fiscal_year", years).agg(F.round(F.sum("v"), 2))
    return p.select("month", *(F.col(str(y)).alias(f"y{y}") for y in years))


def trial_balance(gl: DataFrame) -> DataFrame:
    """Per company, account and period: debit, credit, net."""
    g = gl.filter(~blank("gl_account")).groupBy("company_code", "gl_account", "fiscal_year", "fiscal_period").agg(F.round(F.sum(zero("debit_amount")), 2).alias("debit"), F.round(F.sum(zero("credit_amount")), 2).alias("credit"))
    return g.withColumn("net", F.round(F.col("debit") - F.col("credit"), 2))


def reconcile(tb: DataFrame, gl: DataFrame, digits: int = 2) -> DataFrame:
    """Nets of a trial balance against the ledger's local amounts, by account prefix; either side may lack one."""
    a = tb.groupBy(F.substring("gl_account", 1, digits).alias("prefix")).agg(F.round(F.sum("net"), 2).alias("tb_net"))
    b = gl.filter(~blank("gl_account")).groupBy(F.substring("gl_account", 1, digits).alias("prefix")).agg(F.round(F.sum("local_amount"), 2).alias("gl_net"))
    return a.join(b, "prefix", "full").withColumn("difference", F.round(F.coalesce("tb_net", F.lit(0.0)) - F.coalesce("gl_net", F.lit(0.0)), 2))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, nulls, zeros, negatives, avg, sd, lo, hi, p25, p50, p75): one scan for the moments, one for the quantiles."""
    x, v = melted(df, columns, "double"), F.col("v")
    g = x.groupBy("column_name").agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.avg(v).alias("avg"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return g.join(quantiles(x, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column_name"]), "column_name", "left")


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column (ties: in order of the values), in one scan."""
    g = melted(df, columns, "string").filter("v is not null").groupBy("column_name", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")  # over distinct values, cut to k in each task first
    return g.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def datetime_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, nulls, first, last, days, weekend_share) of timestamps: counts per day in one scan, then over days."""
    x = melted(df, columns, "timestamp_ntz")
    d = x.groupBy("column_name", F.col("v").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    some = F.col("day").isNotNull()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    g = d.groupBy("column_name").agg(
        F.sum(F.when(some, F.col("c")).otherwise(0)).alias("n"), F.sum(F.when(some, 0).otherwise(F.col("c"))).alias("nulls"), text(F.min("lo")).alias("first"), text(F.max("hi")).alias("last"), F.count("day").alias("days"), F.sum(F.when(F.weekday("day") >= 5, F.col("c")).otherwise(0)).alias("_w"),
    )
    return g.withColumn("weekend_share", F.try_divide("_w", "n")).drop("_w")


def boolean_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, trues, falses, nulls)."""
    x, v = melted(df, columns, "boolean"), F.col("v")
    return x.groupBy("column_name").agg(F.count_if(v).alias("trues"), F.count_if(~v).alias("falses"), F.count_if(v.isNull()).alias("nulls"))


def temporal_patterns(gl: DataFrame) -> DataFrame:
    """(axis, key, lines, amount) by weekday (0 is Monday), hour, day of the month and month; one scan."""
    p = F.col("posting_date")
    each = F.array(*(F.struct(F.lit(a).alias("axis"), c.cast("int").alias("key")) for a, c in (("weekday", F.weekday(p)), ("hour", F.hour(p)), ("day", F.day(p)), ("month", F.month(p)))))
    x = gl.filter(p.isNotNull()).select(F.explode(each).alias("k"), base_amount().alias("v"))
    return x.groupBy("k.axis", "k.key").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("v"), 2).alias("amount"))


def validation_score(gl: DataFrame) -> DataFrame:
    """One row: total and valid lines and documents, and a score of 0..100: the shares of lines without a missing or ill-formed required field and of balanced documents, in equal parts."""
    bad = F.lit(False)
    for c in REQUIRED:
        bad = bad | blank(c)
    bad = bad | ~F.coalesce(F.col("fiscal_period").between(1, 16), F.lit(False))
    rows = gl.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~bad).alias("valid_rows"), F.min("posting_date").alias("first"), F.max("posting_date").alias("last"))
    g = gate(gl).select(F.col("documents").alias("total_documents"), (F.col("documents") - F.col("unbalanced")).alias("valid_documents"))
    score = 50 * F.coalesce(F.try_divide("valid_rows", "total_rows"), F.lit(0.0)) + 50 * F.coalesce(F.try_divide("valid_documents", "total_documents"), F.lit(0.0))
    x = rows.crossJoin(F.broadcast(g))  # one row each
    return x.select("total_rows", "valid_rows", "total_documents", "valid_documents", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), F.round(score, 4).alias("score"))


def statistical_summary(gl: DataFrame) -> DataFrame:
    """(measure, subject, value): of companies the spread and concentration of amounts, of months the change and seasonality, of the whole the number of missing business days."""
    d = melted_rows(dispersion(gl), "company_code", ["cv", "skew", "kurt", "hhi"])
    v = melted_rows(volatility(gl), "month", ["change", "seasonality"])
    m = missing_business_days(gl).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("missing_business_days").alias("measure"), F.lit("all").alias("subject"), "value")
    return d.unionByName(v).unionByName(m)


def melted_rows(df: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    return melted(df, columns, "double", [subject]).select(F.col("column_name").alias("measure"), F.col(subject).alias("subject"), F.col("v").alias("value")).filter("value is not null")
