"""Sources and sinks: Parquet, CSV and JDBC tables, partitioned writes, consolidated runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions.columns import quarter_label, sanitize_city, week_start

READINGS = T.StructType([T.StructField("ca_id", T.StringType()), T.StructField("date", T.TimestampNTZType()), T.StructField("value", T.DoubleType()), T.StructField("city", T.StringType())])
CUSTOMERS = T.StructType([T.StructField("id", T.StringType()), T.StructField("city", T.StringType()), T.StructField("location", T.StringType())])

#: Names of result files: policy, solver, kind, rank.
RESULT_NAME = r"([^/]*?)__([^/]*?)__([^/]*?)__r(\d+)"


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share. Where it is unset, a local
    session gets a temporary one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


_scopes: list[list[tuple]] = []


def kept(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """df as Parquet in the shared folder, read back: a lost executor costs no more than a read, and columns that nothing
    reads are pruned; by: integers with a folder for each value. The files go when the scratch() around them ends, else
    with the driver."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/wattloom-tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    if _scopes:
        _scopes[-1].append((out, files, path))
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables kept inside it, but for those given to the function that it yields, which a result
    still reads; these belong to the next outer scope."""
    results: list[DataFrame] = []
    _scopes.append([])

    def keep(t: DataFrame) -> DataFrame:
        results.append(t)
        return t

    try:
        yield keep
    finally:
        for entry in _scopes.pop():
            if any(entry[0] is t for t in results):
                if _scopes:
                    _scopes[-1].append(entry)
            else:
                entry[1].delete(entry[2], True)


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet with a declared schema, or the merged one of its files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_jdbc(spark: SparkSession, url: str, table: str, ts: str = "date", year: int | None = None, properties: dict | None = None) -> DataFrame:
    """A whole table; or one year of it, in twelve half-open months read side by side. Needs a driver on the class path."""
    if year is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, predicates=month_predicates(ts, year), properties=properties or {})


def month_predicates(ts: str, year: int) -> list[str]:
    edges = [f"{year}-{m:02d}-01 00:00:00" for m in range(1, 13)] + [f"{year + 1}-01-01 00:00:00"]
    return [f"{ts} >= '{a}' AND {ts} < '{b}'" for a, b in zip(edges, edges[1:], strict=False)]


def sampled_years(df: DataFrame, ts: str = "date", fraction: float = 0.001, seed: int = 42) -> DataFrame:
    return df.sample(fraction, seed).select(F.year(ts).alias("year")).distinct()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema, one is inferred from a sample of the rows."""
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", "true").option("samplingRatio", "0.1")).csv(path)


def standardise_readings(df: DataFrame, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Readings of the declared types from text; what can't be read is null."""
    ts = F.col("date") if dict(df.dtypes)["date"].startswith("timestamp") else F.try_to_timestamp("date", F.lit(pattern))
    return df.select(F.col("ca_id").cast("string").alias("ca_id"), ts.cast("timestamp_ntz").alias("date"), F.col("value").try_cast("double").alias("value"), F.col("city").cast("string").alias("city"))


def write_parquet(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report: few rows, in one file."""
    df.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def balanced(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df dealt by keys for a partitioned write: adaptive execution splits keys of many bytes over tasks and gathers those of
    few, both to spark.sql.adaptive.advisoryPartitionSizeInBytes, so files have about that size."""
    return df.hint("rebalance", *map(F.col, keys))


def partition_by_city(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each city, in one pass; a large city is several tasks and files."""
    out = df.withColumn("city_key", sanitize_city("city"))
    write_parquet(balanced(out, ["city_key"]), path, ["city_key"], mode)


def partition_by_quarter(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    out = df.withColumns({"year": F.year("date"), "quarter": quarter_label("date")})
    write_parquet(balanced(out, ["year", "quarter"]), path, ["year", "quarter"], mode)


def partition_by_city_week(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    out = df.withColumns({"city_key": sanitize_city("city"), "week_start": week_start("date")})
    write_parquet(balanced(out, ["city_key", "week_start"]), path, ["city_key", "week_start"], mode)


def consolidate_runs(df: DataFrame, run: str = "run_ts", by: Sequence[str] = ("case", "kind")) -> DataFrame:
    """The rows of the latest run of each case and kind."""
    latest = df.groupBy(*by).agg(F.max(run).alias(run))
    return df.join(latest, [*by, run], "left_semi")


def combine_groups(spark: SparkSession, path: str, pattern: str = RESULT_NAME, names: Sequence[str] = ("policy", "solver", "kind", "rank"), distinct: bool = False) -> DataFrame:
    """All result files under path as one table, with columns read from the files' names, and the name itself."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    if distinct:
        df = df.dropDuplicates()
    file = F.input_file_name()
    return df.withColumns({n: F.regexp_extract(file, pattern, i + 1) for i, n in enumerate(names)} | {"file": F.element_at(F.split(file, "/"), -1)})


def export_me(df: DataFrame, path: str, by_split: bool = True, mode: str = "errorifexists") -> None:
    """A marginal factor series, one folder for each split or one table."""
    write_parquet(df, path, ["split"] if by_split else [], mode)


def export_full(df: DataFrame, factors: Callable[[DataFrame], DataFrame], path: str, keep: Sequence[str], mode: str = "errorifexists") -> DataFrame:
    """Fits on the whole series and writes its marginal factor: factors gives df with ME, or with predictions; the
    columns keep of it are written as one table, which is returned."""
    write_parquet(factors(df).select(*keep), path, mode=mode)
    return read_table(df.sparkSession, path)


def align_for_concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name of tables whose columns differ in presence or type: types widen to the common one."""
    from functools import reduce

    wide: dict[str, T.DataType] = {}
    rank = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string"]
    for p in parts:
        for f in p.schema:
            a, b = wide.get(f.name, f.dataType).simpleString(), f.dataType.simpleString()
            if a != b and not (a in rank and b in rank):
                wide[f.name] = T.StringType()
            elif f.name not in wide or rank.index(b) > rank.index(a) if a in rank and b in rank else f.name not in wide:
                wide[f.name] = f.dataType
    cast = [p.select(*(F.col(f.name).cast(wide[f.name]).alias(f.name) for f in p.schema)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def top_k(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)
