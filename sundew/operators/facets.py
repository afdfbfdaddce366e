"""Facets and statistics over a filtered result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_facet(df: DataFrame, value: Column, mincount: int = 1, prefix: str | None = None, contains: str | None = None, ignore_case: bool = False, sort: str = "count", limit: int | None = None, offset: int = 0, missing: bool = False) -> DataFrame:
    """value, cnt. Counts below 1 are never shown, whatever ``mincount`` says: an empty bucket would tell of values that the
    user may not see. With ``missing`` rows without a value are a bucket of their own."""
    rows = df.select(value.alias("value"))
    if not missing:
        rows = rows.where("value is not null")
    if prefix:
        rows = rows.where(F.col("value").startswith(prefix))
    if contains:
        rows = rows.where((F.lower("value") if ignore_case else F.col("value")).contains(contains.lower() if ignore_case else contains))
    counted = rows.groupBy("value").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= max(1, mincount))
    if limit is not None or offset:
        counted = counted.orderBy(*((F.desc("cnt"), "value") if sort == "count" else ("value",))).offset(offset)
        counted = counted if limit is None else counted.limit(limit)
    return counted


def multi_field_facet(df: DataFrame, values: Column, **options) -> DataFrame:
    """A facet over a multi-valued field: a row counts once for each distinct value."""
    return field_facet(df.select(F.explode(F.array_distinct(values)).alias("__value")), F.col("__value"), **options)


def range_facet(df: DataFrame, value: Column, start: float, end: float, gap: float, other: bool = False, upper: bool = False, hardend: bool = False) -> DataFrame:
    """bucket (its lower bound), cnt: all buckets of [start, end), the empty ones too; with ``other`` also before, after and
    between as negative buckets -1, -2 and -3 below the start. ``upper``: buckets hold their upper bound instead of the lower. Unless ``hardend`` the last
    bucket keeps its full width."""
    n = -(-(end - start) // gap)
    last = end if hardend else start + n * gap
    place = (F.ceil((value - start) / gap) - 1) if upper else F.floor((value - start) / gap)
    inside = ((value > start) & (value <= last)) if upper else ((value >= start) & (value < last))
    counts = df.where(inside).groupBy(place.cast("long").alias("k")).agg(F.count("*").alias("cnt"))
    frame = df.sparkSession.range(int(n)).withColumnRenamed("id", "k")
    out = frame.join(counts, "k", "left").select((F.lit(float(start)) + F.col("k") * F.lit(float(gap))).alias("bucket"), F.coalesce("cnt", F.lit(0)).alias("cnt"))
    if other:
        ends = df.agg(F.count_if(value < start).alias("a"), F.count_if(value >= last).alias("b"), F.count_if(inside).alias("c"))
        out = out.unionAll(ends.select(F.inline(F.array(*[F.struct((F.lit(float(start)) + d).alias("bucket"), F.col(c).alias("cnt")) for d, c in ((-1.0, "a"), (-2.0, "b"), (-3.0, "c"))]))))
    return out


def date_facet(df: DataFrame, value: Column, unit: str) -> DataFrame:
    """bucket (start of the unit), cnt."""
    return df.where(value.isNotNull()).groupBy(F.date_trunc(unit, value).alias("bucket")).agg(F.count("*").alias("cnt"))


def interval_facet(df: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """name, cnt of named sets, which may overlap."""
    sums = df.agg(*[F.count_if(p).alias(n) for n, p in sets.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("cnt")) for n in sets])))


def query_facet(df: DataFrame, queries: dict[str, Column]) -> DataFrame:
    """name, cnt of arbitrary queries; zeros are left out."""
    return interval_facet(df, queries).where("cnt > 0")


def pivot_facet(df: DataFrame, *fields: str) -> DataFrame:
    """Counts of every level: of the first field, of the first two, and so on; level says which."""
    rolled = df.rollup(*fields).agg(F.count("*").alias("cnt"), F.grouping_id().alias("gid"))
    level = F.lit(len(fields)) - F.round(F.log2(F.col("gid") + 1)).cast("int")
    return rolled.withColumn("level", level).where("level > 0").drop("gid")


def grouped_facet(df: DataFrame, value: Column, groups: dict[str, str], ungrouped: bool = False) -> DataFrame:
    """Counts by group of values; values of no group stay as they are, and all do when the result is filtered by one."""
    if ungrouped or not groups:
        return field_facet(df, value)
    mapping = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return field_facet(df, F.coalesce(mapping[value], value))


def size_histogram(df: DataFrame, value: Column, buckets: int = 10) -> DataFrame:
    """bucket, low, high, cnt of equally filled buckets, as far as rows of one size, which share a bucket, allow: that of a
    size is the one where its first row falls when rows are dealt by size."""
    from pyspark.sql import Window

    counts = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))  # as many rows as distinct sizes
    before = F.sum("n").over(Window.orderBy("v")) - F.col("n")
    placed = counts.select("v", "n", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    bucket = F.expr(f"cast(before * {buckets} div total + 1 as int)")
    return placed.withColumn("bucket", bucket).groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("cnt"))


def stats(df: DataFrame, value: Column, by: list[str] | None = None, numeric: bool = True) -> DataFrame:
    """missing, countValues, min, max, and for numbers sum, sumOfSquares, mean, stddev; grouped by the facet fields."""
    parts = [F.count_if(value.isNull()).alias("missing"), F.count(value).alias("count_values"), F.min(value).alias("min"), F.max(value).alias("max")]
    if numeric:
        parts += [F.round(F.sum(value), 4).alias("sum"), F.round(F.sum(value * value), 2).alias("sum_of_squares"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stddev")]
    return (df.groupBy(*by) if by else df).agg(*parts)


def value_stats(df: DataFrame, value: Column, percentiles: list[float] | None = None) -> DataFrame:
    """count_distinct, distinct_values, and exact ``percentiles`` of a number."""
    parts = [F.count_distinct(value).alias("count_distinct")]
    if percentiles:
        return df.agg(*parts, *[F.percentile(value, p).alias(f"p{p * 100:g}".replace(".", "_")) for p in percentiles])
    return df.agg(*parts, F.array_sort(F.collect_set(value)).alias("distinct_values"))


def pivot_stats(df: DataFrame, value: Column, *fields: str) -> DataFrame:
    """A pivot whose buckets carry statistics of a number: cnt, min, max, mean for every level."""
    rolled = df.rollup(*fields).agg(F.count("*").alias("cnt"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"), F.grouping_id().alias("gid"))
    level = F.lit(len(fields)) - F.round(F.log2(F.col("gid") + 1)).cast("int")
    return rolled.withColumn("level", level).where("level > 0").drop("gid")


def pivot_ranges(df: DataFrame, value: Column, start: float, gap: float, *fields: str) -> DataFrame:
    """A pivot whose buckets carry a range facet: cnt for each combination of fields and each bucket that has rows."""
    bucket = F.lit(float(start)) + F.floor((value - start) / gap) * F.lit(float(gap))
    return df.where(value >= start).groupBy(*fields, bucket.alias("bucket")).agg(F.count("*").alias("cnt"))


def month_facet(df: DataFrame, value: Column, start: str, end: str, months: int = 1) -> DataFrame:
    """bucket, cnt of all calendar buckets of ``months`` months in [start, end), the empty ones too."""
    frame = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {months} MONTHS"))).alias("bucket")).where(F.col("bucket") < F.lit(end).cast("timestamp"))
    since = F.floor(F.months_between(F.date_trunc("month", value), F.lit(start).cast("timestamp")) / months) * months
    counts = df.where((value >= F.lit(start).cast("timestamp")) & (value < F.lit(end).cast("timestamp"))).groupBy(F.add_months(F.lit(start).cast("date"), since.cast("int")).cast("timestamp").alias("bucket")).agg(F.count("*").alias("n"))
    return frame.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("cnt"))


def moments(df: DataFrame, value: Column) -> DataFrame:
    """n, min, max, mean, variance (n - 1), and bias-corrected skewness and excess kurtosis, in one pass."""
    made = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("n").cast("double")
    return made.select("n", "min", "max", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round(F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"), 6).alias("skewness"), F.round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6), 6).alias("kurtosis"))


def term_statistics(nodes: DataFrame, key: str, held: Column) -> DataFrame:
    """term, df: documents that hold it."""
    return nodes.select(F.explode(F.array_distinct(held)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def df_histogram(terms: DataFrame) -> DataFrame:
    """slot (powers of two: the smallest 2**slot that is not below df), terms."""
    return terms.groupBy(F.ceil(F.log2("df")).cast("long").alias("slot")).agg(F.count("*").alias("terms"))
