"""Usage analytics over meter readings (ca_id, date, value, city)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import floor_minutes, iso_week, iso_weekday, iso_year, trunc
from wattloom.operators.ranks import average_rank, exact_quantiles, placed, same, with_quantiles

#: Periods by which usage is summed: the columns that name a period of a timestamp.
PERIODS = {
    "hour": lambda ts: {"period": trunc("hour", ts)},
    "week": lambda ts: {"year": iso_year(ts), "period": iso_week(ts)},
    "month": lambda ts: {"year": F.year(ts), "period": F.month(ts)},
    "year": lambda ts: {"year": F.year(ts)},
}


def _days(freq: str) -> Column:
    """Days of the period that a day is in."""
    return F.lit(7) if freq == "week" else F.dayofmonth(F.last_day("day"))


def daily_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date("date").alias("day")).agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("n_nonzero"))


def hourly_totals_stats(df: DataFrame) -> DataFrame:
    hours = df.groupBy(trunc("hour", "date").alias("hour")).agg(F.sum("value").alias("total"))
    return hours.agg(F.avg("total").alias("mean_total"), F.percentile("total", F.lit(0.5)).alias("median_total"), F.count("*").alias("n_hours"))


def extrapolate_period(df: DataFrame, freq: str, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of weeks or months, with missing days filled by the average present day; a year is the sum of its observed months."""
    if freq == "year":
        months = extrapolate_period(df, "month", keys)
        return months.groupBy(*keys, "year").agg(
            F.sum("observed").alias("observed"), F.sum("days_present").alias("days_present"), F.sum("days").alias("days"), F.sum("total").alias("total")
        ).withColumn("coverage", F.col("days_present") / F.col("days"))
    days = daily_totals(df, keys).select(*keys, "day", "total", *(v.alias(k) for k, v in PERIODS[freq]("day").items()), _days(freq).cast("long").alias("days"))
    out = days.groupBy(*keys, "year", "period").agg(F.sum("total").alias("observed"), F.count("*").alias("days_present"), F.first("days").alias("days"))
    return out.withColumns({"total": F.col("observed") / F.col("days_present") * F.col("days"), "coverage": F.col("days_present") / F.col("days")})


def period_stats(df: DataFrame, freq: str) -> DataFrame:
    """Mean and median total over periods, mean coverage; of weeks also the mean as a year of 52."""
    out = extrapolate_period(df, freq).agg(F.avg("total").alias("mean_total"), F.percentile("total", F.lit(0.5)).alias("median_total"), F.avg("coverage").alias("mean_coverage"), F.count("*").alias("n_periods"))
    return out.withColumn("annualised", F.col("mean_total") * 52) if freq == "week" else out


def customer_period_usage(df: DataFrame, freq: str) -> DataFrame:
    """Usage of each customer by period; from weeks on with missing days filled."""
    if freq == "hour":
        return df.groupBy("ca_id", trunc("hour", "date").alias("period")).agg(F.sum("value").alias("total"))
    return extrapolate_period(df, freq, ["ca_id"])


def customer_period_summary(df: DataFrame, freq: str) -> DataFrame:
    """Mean over customers for each period, then mean and median of those."""
    usage = customer_period_usage(df, freq)
    keys = [k for k in ("year", "period") if k in usage.columns]
    means = usage.groupBy(*keys).agg(F.avg("total").alias("m"))
    return means.agg(F.avg("m").alias("mean_usage"), F.percentile("m", F.lit(0.5)).alias("median_usage"), F.count("*").alias("n_periods"))


def zero_share(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("value") == 0).cast("double")).alias("zero_share"))


def weekend_profile(df: DataFrame, first_weekend_day: int = 6) -> DataFrame:
    """Mean over customers of their mean reading, by weekend and hour."""
    one = df.groupBy((iso_weekday("date") >= first_weekend_day).alias("weekend"), F.hour("date").alias("hour"), "ca_id").agg(F.avg("value").alias("m"))
    return one.groupBy("weekend", "hour").agg(F.avg("m").alias("mean_value"), F.count("*").alias("customers"))


def top_share(df: DataFrame, p: float = 0.1) -> DataFrame:
    """Share of all usage that the ceil(p n) largest customers have.

    The cut is found from counts of equal totals, so that no task sees all customers: totals above the cut count whole,
    and of those at the cut as many as are missing.
    """
    totals = df.groupBy("ca_id").agg(F.sum("value").alias("t"))
    levels = totals.groupBy("t").agg(F.count("*").alias("n"))
    size = totals.agg(F.ceil(F.count("*") * p).alias("k"), F.sum("t").alias("all"), F.count("*").alias("customers"))
    ranked = placed(levels, [], [F.desc("t")], "n")
    return (
        ranked.crossJoin(F.broadcast(size))
        .agg(F.sum(F.col("t") * F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("below")))).alias("top"), F.first("all").alias("all"), F.first("k").alias("k"))
        .select(F.col("k").alias("n_top"), (F.col("top") / F.col("all")).alias("top_share"))
    )


def peak_hour_distribution(df: DataFrame) -> DataFrame:
    """Customer-days by the hour of their largest usage (the earliest of equals)."""
    hours = df.groupBy("ca_id", F.to_date("date").alias("day"), F.hour("date").alias("hour")).agg(F.sum("value").alias("t"))
    peaks = hours.groupBy("ca_id", "day").agg(F.max_by("hour", F.struct("t", -F.col("hour"))).alias("peak_hour"))
    return peaks.groupBy("peak_hour").agg(F.count("*").alias("customer_days"))


def readings_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("ca_id").alias("customers"), F.countDistinct("city").alias("cities"), F.count("*").alias("n"), F.count_if(F.col("value") != 0).alias("n_nonzero"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


def file_stats(df: DataFrame, by: str = "city") -> DataFrame:
    """Customers, readings, date range, and mean and median readings of a customer, for each file or other group."""
    one = df.groupBy(by, "ca_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") != 0).alias("nz"), F.min("date").alias("a"), F.max("date").alias("b"), F.sum("value").alias("v"))
    return one.groupBy(by).agg(
        F.count("*").alias("customers"), F.sum("n").alias("n"), F.sum("nz").alias("n_nonzero"), F.min("a").alias("first"), F.max("b").alias("last"),
        F.avg("n").alias("mean_readings"), F.percentile("n", F.lit(0.5)).alias("median_readings"), (F.sum("v") / F.sum("n")).alias("mean_value"),
    )


def per_file_stats(df: DataFrame) -> DataFrame:
    return file_stats(df.withColumn("file", F.input_file_name()), "file")


def monthly_city_totals(df: DataFrame, year: int | None = None) -> DataFrame:
    """Totals by city and month with missing days filled."""
    out = extrapolate_period(df, "month", ["city"])
    return out if year is None else out.where(F.col("year") == year)


def coverage_halfhours(df: DataFrame) -> DataFrame:
    """Readings, and distinct half-hours, of each city and year against 48 for each day of the year."""
    half = (F.hour("date") * 2 + F.floor(F.minute("date") / 30)).alias("slot")
    halves = df.groupBy("city", F.year("date").alias("year"), F.to_date("date").alias("day"), half).agg(F.count("*").alias("n"))
    out = halves.groupBy("city", "year").agg(F.sum("n").alias("readings"), F.count("*").alias("halfhours"))
    expected = (F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))) * 48).cast("long")
    return out.withColumn("expected", expected).withColumns({"reading_ratio": F.col("readings") / F.col("expected"), "halfhour_ratio": F.col("halfhours") / F.col("expected")})


def household_floor(df: DataFrame, p: float = 0.1, ratio: float = 1.0, eps: float = 1e-3, use: str = "mean") -> DataFrame:
    """ca_id, hod, dow (1-7), floor_kwh: the largest of the mean (or least) usage, ratio times the nearest-rank
    p-quantile, and eps."""
    at = df.groupBy("ca_id", F.hour("date").alias("hod"), iso_weekday("date").alias("dow"))
    rank = F.floor((F.size("v") - 1) * p + 0.5).cast("int")
    out = at.agg(F.array_sort(F.collect_list("value")).alias("v"), (F.avg("value") if use == "mean" else F.min("value")).alias("m"))
    return out.select("ca_id", "hod", "dow", F.greatest(F.col("m"), F.element_at("v", rank + 1) * ratio, F.lit(eps)).alias("floor_kwh"))


def hourly_aggregate(df: DataFrame) -> DataFrame:
    return df.groupBy("ca_id", "city", trunc("hour", "date").alias("hour")).agg(F.sum("value").alias("total"), F.avg("value").alias("mean_value"))


def readings_share(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(key, "n", (F.col("n") / F.col("_all") * 100).alias("percent"))


def customer_lifetimes(df: DataFrame) -> DataFrame:
    out = df.groupBy("ca_id").agg(F.to_date(F.min("date")).alias("first_day"), F.to_date(F.max("date")).alias("last_day"))
    return out.withColumn("days", F.datediff("last_day", "first_day") + 1)


def new_customers_per_week(df: DataFrame) -> DataFrame:
    first = df.groupBy("ca_id").agg(F.min("date").alias("first"))
    return first.groupBy(iso_year("first").alias("iso_year"), iso_week("first").alias("iso_week")).agg(F.count("*").alias("new_customers"))


def weekday_hour_profile(df: DataFrame) -> DataFrame:
    """Mean of hourly sums by weekday and hour."""
    hours = df.groupBy(trunc("hour", "date").alias("h")).agg(F.sum("value").alias("t"))
    return hours.groupBy(iso_weekday("h").alias("weekday"), F.hour("h").alias("hour")).agg(F.avg("t").alias("mean_total"), F.count("*").alias("n_hours"))


def hour_profile(df: DataFrame, cols: Sequence[str], by: str = "hour", ts: str = "date") -> DataFrame:
    """Means by hour of day, by weekday and hour ('weekday_hour'), or by year and hour ('year_hour'); nulls count as 0."""
    keys = {"hour": [F.hour(ts).alias("hour")], "weekday_hour": [iso_weekday(ts).alias("weekday"), F.hour(ts).alias("hour")], "year_hour": [F.year(ts).alias("year"), F.hour(ts).alias("hour")]}
    return df.groupBy(*keys[by]).agg(*(F.avg(F.coalesce(x, F.lit(0.0))).alias(f"mean_{x}") for x in cols))


def rebin(df: DataFrame, cols: Sequence[str], minutes: int, how: str = "mean", ts: str = "date") -> DataFrame:
    df = df.select(floor_minutes(ts, minutes).alias("bin"), *cols)
    if how == "median":
        return with_quantiles(df.select("bin").distinct(), df, ["bin"], {x: (x, 0.5) for x in cols})
    return df.groupBy("bin").agg(*({"mean": F.avg, "sum": F.sum}[how](x).alias(x) for x in cols))


def box_stats(df: DataFrame, col: str, by: str = "month_hour", ts: str = "date") -> DataFrame:
    keys = {
        "month_hour": [F.month(ts).alias("month"), F.hour(ts).alias("hour")], "quarter_hour": [F.quarter(ts).alias("quarter"), F.hour(ts).alias("hour")], "year": [F.year(ts).alias("year")],
    }[by]
    at = df.select(*keys, F.col(col).alias("v"))
    by = at.columns[:-1]
    out = at.groupBy(*by).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n"))
    return with_quantiles(out, at, by, {"q1": ("v", 0.25), "median": ("v", 0.5), "q3": ("v", 0.75)}).select(*by, "least", "q1", "median", "q3", "most", "n")


def series_summary(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Mean, median, count, and the smallest of the most frequent rounded values."""
    modes = df.where(F.col(col).isNotNull()).groupBy(F.round(col, digits).alias("v")).agg(F.count("*").alias("n")).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))
    (median,) = exact_quantiles(df, col, [0.5])
    return df.agg(F.avg(col).alias("mean"), F.lit(median).cast("double").alias("median"), F.count(col).alias("n")).crossJoin(modes)


def scope_metrics(df: DataFrame, stats: Sequence[str] = ("week", "month")) -> DataFrame:
    """Tidy rows (city, freq, metric, stat, value, n_periods) of each city and of ALL, with missing days filled."""
    parts = []
    for freq in stats:
        days = df.groupBy("city", F.to_date("date").alias("day")).agg(F.sum("value").alias("t"))
        days = days.select("city", "day", "t", *(v.alias(k) for k, v in PERIODS[freq]("day").items()), _days(freq).alias("days"))
        both = days.unionByName(days.groupBy("day", "year", "period", "days").agg(F.sum("t").alias("t")).withColumn("city", F.lit("ALL")))
        totals = both.groupBy("city", "year", "period").agg((F.sum("t") / F.count("*") * F.first("days")).alias("total"), (F.count("*") / F.first("days")).alias("coverage"))
        wide = totals.groupBy("city").agg(F.avg("total").alias("total:mean"), F.percentile("total", F.lit(0.5)).alias("total:median"), F.avg("coverage").alias("coverage:mean"), F.count("*").alias("n_periods"))
        long = wide.unpivot(["city", "n_periods"], ["total:mean", "total:median", "coverage:mean"], "name", "value")
        parts.append(long.select("city", F.lit(freq).alias("freq"), F.split("name", ":")[0].alias("metric"), F.split("name", ":")[1].alias("stat"), "value", "n_periods"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def usage_emissions(df: DataFrame, factor: str, freq: str = "day", keys: Sequence[str] = ("ca_id",)) -> DataFrame:
    """kWh x mean factor by customer and day or week, in grams; of weeks also as a year of 52."""
    at = F.to_date("date") if freq == "day" else F.trunc("date", "week")
    out = df.groupBy(*keys, at.alias("period")).agg(F.sum("value").alias("kwh"), F.avg(factor).alias("factor")).withColumn("grams", F.col("kwh") * F.col("factor"))
    return out if freq == "day" else out.withColumn("annual_grams", F.col("grams") * 52)


def _customer_day_usage(df: DataFrame) -> DataFrame:
    """city, day, ca_id, kwh: readings are added up in the order of time, so that equal readings have equal sums, however
    the files are split (the optimizer keeps a sort below sums of doubles)."""
    keys = ["city", "day", "ca_id"]
    dealt = df.select("city", F.to_date("date").alias("day"), "ca_id", "date", "value").repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "date", "value").groupBy(*keys).agg(F.sum("value").alias("kwh"))


def rank_customers(df: DataFrame, percent: bool = False) -> DataFrame:
    """Average-tie rank / n of customers by daily usage within city and day: descending share, or ascending x 100."""
    t = _customer_day_usage(df)
    ranked = average_rank(t, "kwh", "_rank", ["city", "day"])
    sizes = ranked.groupBy("city", "day").agg(F.count("*").alias("_n"))
    share = (F.col("_rank") if percent else F.col("_n") + 1 - F.col("_rank")) / F.col("_n")
    return same(ranked, sizes, ["city", "day"]).select("city", "day", "ca_id", "kwh", (share * 100 if percent else share).alias("rank_share"))


def top_hours(df: DataFrame, n: int = 6) -> DataFrame:
    """Hours with the n largest mean usages of each weekday (dense rank)."""
    m = df.groupBy(iso_weekday("date").alias("weekday"), F.hour("date").alias("hour")).agg(F.avg("value").alias("mean_value"))
    return m.withColumn("place", F.dense_rank().over(Window.partitionBy("weekday").orderBy(F.desc("mean_value")))).where(F.col("place") <= n)


def customer_order(df: DataFrame) -> DataFrame:
    """For each city and day, the customers by descending usage, then id: a row for each, with its place from 1."""
    order = placed(_customer_day_usage(df).withColumn("_one", F.lit(1).cast("long")), ["city", "day"], [F.desc("kwh"), "ca_id"], "_one")
    return order.select("city", "day", (F.col("below") + 1).cast("int").alias("place"), "ca_id", "kwh")


def weekday_hour_pivot(df: DataFrame) -> DataFrame:
    """Mean reading: a row for each hour, a column for each weekday."""
    at = df.select("value", F.hour("date").alias("hour"), iso_weekday("date").alias("weekday"))
    return at.groupBy("hour").pivot("weekday", [1, 2, 3, 4, 5, 6, 7]).agg(F.avg("value"))
