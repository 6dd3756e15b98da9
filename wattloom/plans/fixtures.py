"""Input frames of the queries, from the star-schema tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.columns import floor_minutes, once, slot


class Inputs:
    """Lazy frames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def readings(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("ca_id"), F.col("ts").alias("date"), "value", F.col("event_type").alias("city"))

    @property
    def readings_30min(self) -> DataFrame:
        return self.readings.groupBy("ca_id", "city", floor_minutes("date", 30).alias("date")).agg(F.sum("value").alias("value"))

    @property
    def _slot_lists(self) -> DataFrame:
        """Of each observed customer-day of 'city' ca_id mod 3 the slots in use, in order, with their usage. Readings are
        dealt once, by customer-day, for both sums: few slots have more than one reading to add up before. They are added up
        in the order of time, so that sums don't depend on how the files are split."""
        r = self.readings.select("ca_id", F.to_date("date").alias("day"), slot("date").alias("slot"), "date", "value").repartition("ca_id", "day")
        r = r.sortWithinPartitions("ca_id", "day", "date", "value")
        known = F.col("ca_id").isNotNull() & F.col("slot").isNotNull()
        sums = r.groupBy("ca_id", "day", "slot").agg(F.sum("value").alias("value"))
        days = sums.groupBy("ca_id", "day").agg(F.sort_array(F.collect_list(F.when(known, F.struct("slot", "value")))).alias("slots"))
        return days.withColumn("city", F.concat(F.lit("c"), F.pmod("ca_id", F.lit(3)).cast("string")))

    @property
    def _used_slots(self) -> DataFrame:
        """The same with the usage by slot as a map."""
        return self._slot_lists.select("ca_id", "day", F.map_from_entries("slots").alias("used"), "city")

    @staticmethod
    def _slot(used: Column, i: Column) -> dict[str, Column]:
        """Usage and made-up factors of slot i."""
        mef = F.lit(400.0) + 30 * F.pmod(i * 7 + F.dayofmonth("day"), F.lit(11))
        return {"value": F.coalesce(used[i], F.lit(0.0)), "mef": mef.cast("double"), "aef": (500 + 20 * F.pmod(i, F.lit(5))).cast("double")}

    @property
    def shift_days(self) -> DataFrame:
        """A row for each observed customer-day with its 48 slots. No join: Spark takes the size of exploded slots for that of
        the file, and would send them whole to all tasks."""
        entry = lambda used: lambda i: F.struct(i.alias("slot"), *(x.alias(n) for n, x in self._slot(used, i).items()))
        slots = once(F.col("used"), lambda used: F.transform(F.sequence(F.lit(0), F.lit(47)), entry(used)))
        return self._used_slots.select("ca_id", "city", "day", slots.alias("slots"))

    @property
    def shift_used(self) -> DataFrame:
        """The customer-days of shift_days with the slots in use only, and the factors of the 48 slots as arrays."""
        return self._slot_lists.select("ca_id", "city", "day", "slots", *self._factor_arrays())

    @staticmethod
    def _factor_arrays() -> list[Column]:
        """The factors of _slot of all slots; they depend on the day of the month only."""
        array = lambda v: "array(" + ", ".join(f"{x}D" for x in v) + ")"
        mef = F.expr("array(" + ", ".join(array(400.0 + 30 * ((i * 7 + d) % 11) for i in range(48)) for d in range(1, 32)) + ")")
        return [F.get(mef, F.dayofmonth("day") - 1).alias("mef"), F.expr(array(500.0 + 20 * (i % 5) for i in range(48))).alias("aef")]

    @property
    def shift_factors(self) -> DataFrame:
        """The factors of each city and day."""
        city = F.concat(F.lit("c"), F.pmod("ca_id", F.lit(3)).cast("string"))
        return self.readings.select(city.alias("city"), F.to_date("date").alias("day")).distinct().select("city", "day", *self._factor_arrays())

    @property
    def shift_input(self) -> DataFrame:
        """Dense 48 slots for each observed customer-day: the rows of shift_days."""
        dense = self._used_slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("slot"))
        return dense.withColumns(self._slot(F.col("used"), F.col("slot"))).select("ca_id", "day", "slot", "value", "city", "mef", "aef")

    @property
    def weather_hourly(self) -> DataFrame:
        """Dense hours x event types; temperature with holes, precipitation running within the day."""
        from pyspark.sql.window import Window

        from wattloom.functions.columns import trunc

        e = self.table("events")
        sums = e.groupBy(F.col("event_type").alias("location"), trunc("hour", "ts").alias("timestamp")).agg(F.sum("value").alias("v"))
        span = e.agg(trunc("hour", F.min("ts")).alias("a"), trunc("hour", F.max("ts")).alias("b"))
        hours = span.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("timestamp"))
        grid = hours.crossJoin(F.broadcast(e.select(F.col("event_type").alias("location")).distinct()))
        day = Window.partitionBy("location", F.to_date("timestamp")).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
        hole = (F.pmod(F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01', timestamp)"), F.lit(7)) == 0) | (F.hour("timestamp") == 0)
        out = grid.join(sums, ["location", "timestamp"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
        return out.select("timestamp", "location", F.when(~hole, F.col("v")).alias("temperature"), F.sum("v").over(day).alias("precipitation"))

    @property
    def weather_filler(self) -> DataFrame:
        from wattloom.functions.columns import trunc

        means = self.table("events").groupBy(trunc("hour", "ts").alias("timestamp")).agg(F.avg("value").alias("filler"))
        grid = self.weather_hourly.select("timestamp", "location")
        return grid.join(means, "timestamp", "left").withColumn("filler", F.coalesce("filler", F.lit(0.0)))

    @property
    def grid_5min(self) -> DataFrame:
        g = self.table("events").groupBy(floor_minutes("ts", 5).alias("timestamp")).agg(F.sum("value").alias("v"))
        thermal, gas, renewable = F.col("v") * 3, F.col("v"), F.col("v") / 2
        return g.select("timestamp", thermal.alias("thermal"), gas.alias("gas"), renewable.alias("renewable"), (thermal + gas + renewable).alias("total"), (F.col("v") * 0.25).alias("tons_co2"))

    @property
    def model_rows(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("x"), F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s"), F.col("l_shipdate").alias("t")
        )

    @property
    def locations(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(n.alias("location_id"), (70 + n * 0.37).alias("lon"), (17 + F.pmod(n * 7, F.lit(25)) * 0.41).alias("lat"))

    @property
    def customer_points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("ca_id"), (70 + F.pmod(k, F.lit(97)) * 0.1).alias("lon"), (17 + F.pmod(k, F.lit(89)) * 0.12).alias("lat"))

    @property
    def factors(self) -> DataFrame:
        return self.table("orders").groupBy(F.col("o_orderdate").alias("timestamp")).agg(F.avg("o_totalprice").alias("aef"), F.max("o_totalprice").alias("mef"))


_READINGS = "readings AS (SELECT user_id AS ca_id, ts AS date, value, event_type AS city FROM events)"
_HALF = "time_bucket(INTERVAL 30 MINUTE, date)"
#: name -> (what it needs before it, the expression)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": ((), _READINGS),
    "readings_30min": (("readings",), f"readings_30min AS (SELECT ca_id, city, {_HALF} AS date, sum(value) AS value FROM readings GROUP BY ALL)"),
    "shift_input": (
        ("readings",),
        """si_r AS (SELECT ca_id, date::DATE AS day, (hour(date) * 2 + minute(date) // 30)::INT AS slot, sum(value) AS value FROM readings GROUP BY ALL),
si_d AS (SELECT DISTINCT ca_id, day, unnest(range(48))::INT AS slot FROM si_r),
shift_input AS (SELECT ca_id, day, slot, coalesce(value, 0.0) AS value, 'c' || (ca_id % 3) AS city, (400 + 30 * ((slot * 7 + day(day)) % 11))::DOUBLE AS mef, (500 + 20 * (slot % 5))::DOUBLE AS aef
 FROM si_d LEFT JOIN si_r USING (ca_id, day, slot))""",
    ),
    "weather_hourly": (
        (),
        """wh_s AS (SELECT event_type AS location, date_trunc('hour', ts) AS timestamp, sum(value) AS v FROM events GROUP BY ALL),
wh_h AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS timestamp FROM events),
wh_v AS (SELECT timestamp, location, coalesce(v, 0.0) AS v FROM wh_h CROSS JOIN (SELECT DISTINCT event_type AS location FROM events) LEFT JOIN wh_s USING (timestamp, location)),
weather_hourly AS (SELECT timestamp, location, CASE WHEN (epoch(timestamp) / 3600)::BIGINT % 7 <> 0 AND hour(timestamp) <> 0 THEN v END AS temperature,
 sum(v) OVER (PARTITION BY location, timestamp::DATE ORDER BY timestamp) AS precipitation FROM wh_v)""",
    ),
    "weather_filler": (
        ("weather_hourly",),
        """wf_m AS (SELECT date_trunc('hour', ts) AS timestamp, avg(value) AS filler FROM events GROUP BY ALL),
weather_filler AS (SELECT timestamp, location, coalesce(filler, 0.0) AS filler FROM weather_hourly LEFT JOIN wf_m USING (timestamp))""",
    ),
    "grid_5min": (
        (),
        """g5 AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS timestamp, sum(value) AS v FROM events GROUP BY ALL),
grid_5min AS (SELECT timestamp, v * 3 AS thermal, v AS gas, v / 2 AS renewable, v * 3 + v + v / 2 AS total, v * 0.25::DOUBLE AS tons_co2 FROM g5)""",
    ),
    "model_rows": ((), "model_rows AS (SELECT l_quantity AS q, l_extendedprice AS y, l_discount AS x, l_returnflag AS g, l_linestatus AS s, l_shipdate AS t FROM lineitem)"),
    "locations": ((), "locations AS (SELECT n_nationkey AS location_id, 70 + n_nationkey * 0.37::DOUBLE AS lon, 17 + (n_nationkey * 7 % 25) * 0.41::DOUBLE AS lat FROM nation)"),
    "customer_points": ((), "customer_points AS (SELECT c_custkey AS ca_id, 70 + (c_custkey % 97) * 0.1::DOUBLE AS lon, 17 + (c_custkey % 89) * 0.12::DOUBLE AS lat FROM customer)"),
    "factors": ((), "factors AS (SELECT o_orderdate AS timestamp, avg(o_totalprice) AS aef, max(o_totalprice) AS mef FROM orders GROUP BY ALL)"),
}


def sql(text: str, *needs: str, recursive: bool = False) -> str:
    """text after the common table expressions it needs; a text that starts with a comma adds its own."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if CTES[name][1] not in done:
            done.append(CTES[name][1])

    for n in needs:
        add(n)
    if not done:
        return text
    head = f"WITH {'RECURSIVE ' * recursive}{',\n'.join(done)}"
    return head + text if text.startswith(",") else f"{head}\n{text}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as engines add them in different orders; no -0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
