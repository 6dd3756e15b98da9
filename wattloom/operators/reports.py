"""Reports over shifting results: moves (moves_table), metrics (shift_metrics), readings before and after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.columns import classify_move, iso_week, iso_weekday, iso_year
from wattloom.operators.ranks import with_quantiles

DELTA = "marginal_emissions_delta_grams_co2"
BEFORE = "marginal_emissions_before_shift_grams_co2"


def _share(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def _week() -> list[Column]:
    return [iso_year("day").alias("iso_year"), iso_week("day").alias("iso_week")]


def _quartiles(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """Mean, median, upper quartile and number of x in each group."""
    stats = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.count("*").alias("n"))
    return with_quantiles(stats, df, by, {"median": (x, 0.5), "p75": (x, 0.75)}).select(*by, "mean", "median", "p75", "n")


def per_move_savings(moves: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    return _quartiles(moves.select(*by, (-F.col(DELTA)).alias("_s")), "_s", by)


def household_week_savings(moves: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    weeks = moves.groupBy(*dict.fromkeys([*by, "city"]), "ca_id", *_week()).agg(F.sum(-F.col(DELTA)).alias("_s"))
    return _quartiles(weeks, "_s", by)


def moves_by_category(moves: DataFrame) -> DataFrame:
    """Moves, kWh and grams of savings, increases and neutral moves."""
    return moves.groupBy(classify_move(DELTA).alias("category")).agg(F.count("*").alias("moves"), F.sum("delta_kwh").alias("kwh"), F.sum(DELTA).alias("grams"))


def giveback(moves: DataFrame) -> DataFrame:
    """Grams saved, given back by moves that increase emissions, their ratio, and what of the savings is realised."""
    saved, back = F.sum(F.when(F.col(DELTA) < 0, -F.col(DELTA)).otherwise(0.0)), F.sum(F.when(F.col(DELTA) > 0, F.col(DELTA)).otherwise(0.0))
    out = moves.agg(saved.alias("saved"), back.alias("given_back"))
    return out.withColumns({"giveback_ratio": _share("given_back", "saved"), "realisation_rate": _share(F.col("saved") - F.col("given_back"), "saved")})


def overall_reduction(metrics: DataFrame, by: str = "city") -> DataFrame:
    """Base and shifted grams and the reduction, of each city, year or week and of TOTAL (one rollup)."""
    key = {"city": F.col("city"), "year": F.year("day").cast("string"), "week": F.concat(iso_year("day").cast("string"), F.lit("-W"), F.lpad(iso_week("day").cast("string"), 2, "0"))}[by]
    sums = [F.sum(f"{s}_E_{x}_g").alias(f"{s}_{x}_g") for x in ("avg", "marg") for s in ("baseline", "post")]
    out = metrics.withColumn("_k", key).rollup("_k").agg(*sums, F.sum("moved_kwh").alias("moved_kwh"), F.sum("baseline_kwh").alias("baseline_kwh"), F.grouping("_k").alias("_g"))
    out = out.withColumn(by, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("_k"))).drop("_g", "_k")
    return out.withColumns({f"reduction_{x}": _share(F.col(f"baseline_{x}_g") - F.col(f"post_{x}_g"), f"baseline_{x}_g") for x in ("avg", "marg")})


def weekly_move_coverage(metrics: DataFrame) -> DataFrame:
    """Of the customer-weeks of each city: how many have a move, their share, and mean moves' kWh."""
    weeks = metrics.groupBy("city", "ca_id", *_week()).agg(F.sum("moved_kwh").alias("kwh"), F.sum("baseline_kwh").alias("all"))
    return weeks.groupBy("city").agg(F.count("*").alias("customer_weeks"), F.count_if(F.col("kwh") > 0).alias("with_moves"), F.avg((F.col("kwh") > 0).cast("double")).alias("coverage"), F.avg("kwh").alias("mean_kwh"))


def customers_with_shift(metrics: DataFrame) -> DataFrame:
    one = metrics.groupBy("city", "ca_id").agg(F.max((F.col("moved_kwh") > 0).cast("int")).alias("f"))
    return one.groupBy("city").agg(F.count("*").alias("customers"), F.sum("f").alias("with_shift"), F.avg("f").alias("share"))


def origin_destination(moves: DataFrame, value: str = "delta_kwh") -> DataFrame:
    """Row for each origin hour, a column for each destination hour (0-23): summed kWh, 0 where none."""
    at = moves.select(F.hour("original_time").alias("origin"), F.hour("proposed_shift_time").alias("_d"), value)
    return at.groupBy("origin").pivot("_d", list(range(24))).agg(F.sum(value)).na.fill(0.0)


def moves_confidence_share(labelled: DataFrame, label: str = "confidence") -> DataFrame:
    """Moves, kWh and grams by confidence label, and their shares. labelled: moves_by_role()."""
    all_ = F.broadcast(labelled.agg(F.count("*").alias("_n"), F.sum("delta_kwh").alias("_k")))
    out = labelled.groupBy(F.coalesce(label, F.lit("unknown")).alias(label)).agg(F.count("*").alias("moves"), F.sum("delta_kwh").alias("kwh"), F.sum(DELTA).alias("grams"))
    return out.crossJoin(all_).withColumns({"moves_share": F.col("moves") / F.col("_n"), "kwh_share": _share("kwh", "_k")}).drop("_n", "_k")


def shift_size_distance(moves: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    sized = moves.select(*by, "delta_kwh", F.abs("delta_minutes").alias("_d"))
    stats = sized.groupBy(*by).agg(F.avg("delta_kwh").alias("mean_kwh"), (F.sum(F.col("delta_kwh") * F.col("_d")) / F.sum("delta_kwh")).alias("weighted_minutes"), F.avg("_d").alias("mean_minutes"))
    out = with_quantiles(stats, sized, by, {"median_kwh": ("delta_kwh", 0.5), "median_minutes": ("_d", 0.5)})
    return out.select(*by, "mean_kwh", "median_kwh", "weighted_minutes", "mean_minutes", "median_minutes")


def emissions_savings(metrics: DataFrame) -> DataFrame:
    """Tonnes saved by average and marginal factor of each city, and of ALL."""
    out = metrics.rollup("city").agg(F.grouping("city").alias("_g"), *((F.sum(-F.col(f"delta_E_{x}_g")) / 1e6).alias(f"saved_{x}_t") for x in ("avg", "marg")))
    return out.withColumn("city", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("city"))).drop("_g")


def time_histogram(moves: DataFrame, by: str = "hour", top: int | None = None) -> DataFrame:
    """Counts of origins and destinations by exact 'time', 'hour', or 'weekday_hour'; top: only the most frequent."""
    at = F.explode(F.array(F.struct(F.lit("origin").alias("role"), F.col("original_time").alias("t")), F.struct(F.lit("destination").alias("role"), F.col("proposed_shift_time").alias("t")))).alias("_r")
    x = moves.select(at).select("_r.*")
    keys = {"time": ["t"], "hour": [F.hour("t").alias("hour")], "weekday_hour": [iso_weekday("t").alias("weekday"), F.hour("t").alias("hour")]}[by]
    out = x.groupBy("role", *keys).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), *[F.col(c) for c in out.columns if c != "n"]).limit(top)


def customer_week_stats(metrics: DataFrame) -> DataFrame:
    weeks = metrics.groupBy("ca_id", "city", *_week()).agg(F.sum("moved_kwh").alias("kwh"), F.sum(-F.col("delta_E_marg_g")).alias("saved"))
    return weeks.groupBy("city", "iso_year", "iso_week").agg(F.count("*").alias("customers"), F.avg("kwh").alias("mean_kwh"), F.percentile("kwh", F.lit(0.5)).alias("median_kwh"), F.avg("saved").alias("mean_saved_g"))


def hour_pair_stats(moves: DataFrame) -> DataFrame:
    return moves.groupBy(F.hour("original_time").alias("origin"), F.hour("proposed_shift_time").alias("destination")).agg(F.count("*").alias("moves"), F.sum("delta_kwh").alias("kwh"), F.sum(DELTA).alias("grams"))


def weekday_hour_flow(moves: DataFrame) -> DataFrame:
    """Mean kWh and grams a day that leave and reach each hour of a weekday."""
    part = lambda role, t, g: F.struct(F.lit(role).alias("role"), F.col(t).alias("t"), F.col("delta_kwh").alias("kwh"), F.col(g).alias("g"))
    rows = F.array(part("out", "original_time", BEFORE), part("in", "proposed_shift_time", "marginal_emissions_after_shift_grams_co2"))
    x = moves.select(F.explode(rows).alias("r")).select("r.*")
    days = x.groupBy("role", F.to_date("t").alias("day"), F.hour("t").alias("hour")).agg(F.sum("kwh").alias("kwh"), F.sum("g").alias("g"))
    return days.groupBy("role", iso_weekday("day").alias("weekday"), "hour").agg(F.avg("kwh").alias("mean_kwh"), F.avg("g").alias("mean_grams"), F.count("*").alias("days"))


def pre_post_profile(before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Mean usage of each hour before and after. before: value, after: optimised_value, both by customer-day and slot;
    without after, before has both."""
    both = before if after is None else before.join(after, ["ca_id", "city", "day", "slot"], "full")
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return both.groupBy(F.floor(F.col("slot") / 2).cast("int").alias("hour")).agg(F.avg(z("value")).alias("mean_before"), F.avg(z("optimised_value")).alias("mean_after"), (F.sum(z("optimised_value")) - F.sum(z("value"))).alias("net_kwh"))


def direction_by_hour(moves: DataFrame) -> DataFrame:
    return moves.groupBy(F.hour("original_time").alias("hour")).agg(*(F.count_if(F.col("shift_direction") == x).alias(x) for x in ("backward", "forward", "stay")))


def quota_and_boundary(moves: DataFrame, moves_per_day: int, window: int) -> DataFrame:
    """Share of customer-days with moves that are at the daily cap, and of moves at the edge of the window."""
    days = moves.groupBy("ca_id", "city", "day").agg(F.count("*").alias("n"), F.count_if(F.abs("delta_minutes") == window * 30).alias("edge"))
    return days.groupBy("city").agg(F.avg((F.col("n") >= moves_per_day).cast("double")).alias("days_at_cap"), (F.sum("edge") / F.sum("n")).alias("moves_at_edge"))


def savings_disagreement(metrics: DataFrame) -> DataFrame:
    """Customer-days that save by marginal but not by average factors."""
    odd = (F.col("delta_E_marg_g") < 0) & (F.col("delta_E_avg_g") >= 0)
    return metrics.groupBy("city").agg(F.count_if(odd).alias("customer_days"), F.avg(odd.cast("double")).alias("share"), F.sum(F.when(odd, -F.col("delta_E_marg_g")).otherwise(0.0)).alias("marginal_g"))


def usage_hourly(df: DataFrame) -> DataFrame:
    from wattloom.functions.columns import trunc

    return df.groupBy("city", trunc("hour", "date").alias("hour")).agg(F.avg("value").alias("mean_value"))


def run_all(moves: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """All reports that need only moves and metrics."""
    return {
        "per_move_savings": per_move_savings(moves), "household_week_savings": household_week_savings(moves), "moves_by_category": moves_by_category(moves), "giveback": giveback(moves),
        "overall_reduction": overall_reduction(metrics), "weekly_move_coverage": weekly_move_coverage(metrics), "customers_with_shift": customers_with_shift(metrics),
        "origin_destination": origin_destination(moves), "shift_size_distance": shift_size_distance(moves), "emissions_savings": emissions_savings(metrics), "time_histogram": time_histogram(moves),
        "customer_week_stats": customer_week_stats(metrics), "hour_pair_stats": hour_pair_stats(moves), "weekday_hour_flow": weekday_hour_flow(moves), "direction_by_hour": direction_by_hour(moves),
        "savings_disagreement": savings_disagreement(metrics),
    }


def weekly_summary(metrics: DataFrame) -> DataFrame:
    return overall_reduction(metrics, "week").withColumnRenamed("week", "period")
