"""What a table looks like: columns, missing and distinct values, duplicates, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallywise.fixed_values import (
    DATELIKE_SHARE,
    DUPLICATE_MAX_DEDUCTION,
    DUPLICATE_WEIGHT,
    MISSING_MAX_DEDUCTION,
    MISSING_NOTE_LIMIT_PCT,
    MISSING_WEIGHT,
    QUALITY_CLEAN_NOTE,
    QUALITY_DUPLICATE_NOTE,
    QUALITY_MISSING_NOTE,
)
from tallywise.functions.dates import parse_date
from tallywise.functions.numbers import mean, percent_or_zero, round_to, show
from tallywise.functions.sentences import sentence

# Values this long or longer are compared by their digest, which has this length.
_DIGEST_LENGTH = 64


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_measure(dtype: T.DataType) -> bool:
    """Numbers with a fractional part: something to add up, not to group by."""
    return isinstance(dtype, T.FractionalType) and not (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0
    )


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def present(df: DataFrame, name: str) -> Column:
    """A column with NaN turned into null: both count as missing."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def identity_text(df: DataFrame, name: str) -> Column:
    """Short text that is equal for equal values and different for different ones.

    Long values are replaced by a SHA-256 digest, so that counting distinct texts
    moves 64 bytes per value through the shuffle instead of the text.
    """
    c, dtype = present(df, name), df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (c + 0.0).cast("string")  # -0.0 equals 0.0
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(dtype, T.BinaryType):
        c = F.base64(c)
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        c = F.to_json(F.struct(c.alias("v")))
    text = c.cast("string")
    return F.when(F.length(text) >= _DIGEST_LENGTH, F.sha2(text, 256)).otherwise(text)


def _melted_counts(df: DataFrame) -> DataFrame:
    """Exact counts per column from one scan.

    Every value becomes (column, value); equal values are counted before and after
    one shuffle on both, so neither a wide table nor a value filling most of a column
    ends up in one task. Dates are parsed once per distinct value.
    """
    values = df.select(*[identity_text(df, c).alias(str(i)) for i, c in enumerate(df.columns)])
    melted = values.unpivot([], values.columns, "ordinal", "value")
    texts = [str(i) for i, c in enumerate(df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    parsed = F.when(F.col("ordinal").isin(*texts), parse_date("value")) if texts else F.lit(None)
    return (
        melted.groupBy("ordinal", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("ordinal")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.coalesce(F.sum(F.when(parsed.isNotNull(), F.col("n"))), F.lit(0)).alias("parsed"),
            F.count("value").alias("distinct"),
        )
        .withColumn("ordinal", F.col("ordinal").cast("int"))
    )


def _direct_counts(df: DataFrame, distinct: str | None) -> DataFrame:
    """Counts per column from one aggregation without a shuffle of values."""
    per_column = []
    for i, name in enumerate(df.columns):
        value = present(df, name)
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        parsed = F.count(parse_date(value)) if is_text else F.lit(0)
        how_many = F.approx_count_distinct(identity_text(df, name)) if distinct else F.lit(None)
        per_column.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(value.isNull()).alias("missing"),
                parsed.cast("bigint").alias("parsed"),
                how_many.cast("bigint").alias("distinct"),
            )
        )
    return df.agg(F.array(*per_column).alias("c")).select(F.inline("c"))


def column_profile(df: DataFrame, distinct: str | None = "exact") -> DataFrame:
    """One row per column: type, missing, distinct values, numeric?, date-like?

    ``distinct`` is ``"exact"``, ``"approx"`` (a fixed-size sketch per column) or
    None when the count is not needed. Text is date-like when at least 80 % of all
    its values can be read as dates.
    """
    counts = _melted_counts(df) if distinct == "exact" else _direct_counts(df, distinct)
    kinds = [df.schema[c].dataType for c in df.columns]

    def fact(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("ordinal") + 1)

    filled = F.col("rows") - F.col("missing")
    looks_like_date = F.coalesce(
        F.try_divide(F.col("parsed").cast("double"), filled.cast("double")) >= DATELIKE_SHARE,
        F.lit(False),
    )
    return counts.select(
        "ordinal",
        fact(df.columns).alias("column_name"),
        fact([k.simpleString() for k in kinds]).alias("data_type"),
        F.col("rows").alias("row_count"),
        F.col("missing").alias("missing_count"),
        round_to(percent_or_zero("missing", "rows")).alias("missing_pct"),
        F.col("distinct").alias("distinct_count"),
        fact([is_numeric(k) for k in kinds]).alias("is_numeric"),
        fact([is_measure(k) for k in kinds]).alias("is_measure"),
        (fact([is_date(k) for k in kinds]) | looks_like_date).alias("is_datelike"),
    ).orderBy("ordinal")


def datelike_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """The names of those text columns that read as dates; one row with an array."""
    checks = []
    for name in names:
        read = F.count(parse_date(f"`{name}`")).cast("double")
        share = F.try_divide(read, F.count(f"`{name}`").cast("double"))
        checks.append(F.when(share >= DATELIKE_SHARE, F.lit(name)))
    return df.agg(F.array_compact(F.array(*checks)).alias("datelike"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and exact duplicate rows (all but the first copy); one row.

    Rows are compared by one SHA-256 digest, 32 bytes however wide they are. Each value
    stands in it behind its length, so that neighbours cannot run into each other.
    """
    values = [identity_text(df, c) for c in df.columns]
    marked = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    row = F.unhex(F.sha2(F.concat(F.lit(""), *marked), 256))
    copies = df.select(row.alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def data_quality_score(df: DataFrame) -> DataFrame:
    """Score 0-100 from missing values and duplicate rows, with notes; one row."""
    missing = column_profile(df, distinct=None).agg(mean("missing_pct").alias("m")).scalar()
    rated = (
        dataset_profile(df)
        .withColumn("missing", F.coalesce(missing, F.lit(0.0)))
        .withColumn("duplicates", percent_or_zero("duplicate_rows", "row_count"))
    )
    deduction = F.least(F.col("missing") * MISSING_WEIGHT, F.lit(MISSING_MAX_DEDUCTION)) + F.least(
        F.col("duplicates") * DUPLICATE_WEIGHT, F.lit(DUPLICATE_MAX_DEDUCTION)
    )
    notes = F.array_compact(
        F.array(
            F.when(
                F.col("missing") > MISSING_NOTE_LIMIT_PCT,
                sentence(QUALITY_MISSING_NOTE, missing=show("missing", 1)),
            ),
            F.when(
                F.col("duplicates") > 0,
                sentence(QUALITY_DUPLICATE_NOTE, duplicates=show("duplicates", 1)),
            ),
        )
    )
    return rated.select(
        F.greatest(F.rint(F.lit(100.0) - deduction), F.lit(0.0)).cast("int").alias("score"),
        round_to("missing").alias("avg_missing_pct"),
        round_to("duplicates").alias("duplicate_pct"),
        F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(QUALITY_CLEAN_NOTE))).alias("notes"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
