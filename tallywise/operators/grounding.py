"""Do written statements only use numbers and names that the evidence supports?

Texts are rows (id, text). Evidence is any DataFrame with the same id and one record
per row; a record's fields may be numbers, flags, text, dates, arrays, maps or structs.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallywise.fixed_values import (
    ENTITY_FIELDS,
    GROUNDING_SHARE,
    GROUNDING_TOLERANCE,
    PERCENT_ANCHORS,
    SMALL_WHOLE_NUMBER,
)
from tallywise.functions.numbers import round_as_printed
from tallywise.functions.texts import numbers_in
from tallywise.operators.profile import is_date

_NUMBERS = "array<double>"

# Width of the buckets numbers are matched in: below _SEAM half a unit, above it half
# a percent. Both are at most the tolerance, so numbers sharing a bucket always agree.
_SEAM = 50.0
_STEP = 0.5
_GROWTH = 1.005
_LARGEST = sys.float_info.max  # only what is not finite lies beyond


def numbers_of(value: Column, dtype: T.DataType) -> Column:
    """All numbers of a value of any type, rounded to one place; field names excluded."""
    if isinstance(dtype, T.BooleanType):
        return F.array(value.cast("double"))
    if isinstance(dtype, T.NumericType):
        return F.array(round_as_printed(value.cast("double"), 1))
    if isinstance(dtype, T.StringType) or is_date(dtype):
        return F.coalesce(numbers_in(value.cast("string")), F.array().cast(_NUMBERS))
    if isinstance(dtype, T.ArrayType):
        inner = F.transform(value, lambda v: numbers_of(v, dtype.elementType))
        return F.coalesce(F.flatten(inner), F.array().cast(_NUMBERS))
    if isinstance(dtype, T.MapType):
        return numbers_of(F.map_values(value), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [numbers_of(value[f.name], f.dataType) for f in dtype.fields]
        return F.concat(*fields) if fields else F.array().cast(_NUMBERS)
    return F.array().cast(_NUMBERS)


def record_numbers(df: DataFrame, *leave_out: str) -> Column:
    """Every number in a record."""
    parts = [numbers_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if f.name not in leave_out]
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def record_measures(df: DataFrame, *leave_out: str) -> Column:
    """The numbers a record states directly in numeric fields."""
    parts = [
        round_as_printed(F.col(f"`{f.name}`").cast("double"), 1)
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in leave_out
    ]
    return F.array_compact(F.array(*parts)).cast(_NUMBERS)


def record_entity(df: DataFrame) -> Column:
    """The name a record is about: the first entity field that is text."""
    named = [
        F.col(name)
        for name in ENTITY_FIELDS
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType)
    ]
    return F.coalesce(*named) if named else F.lit(None).cast("string")


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting both sides. Spark cannot tell how many rows come out of a text, so it would take what is
    read from large texts for small, and send it whole through the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def text_numbers(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number) for every different number in a text."""
    return texts.select(F.col(id_col), F.explode(numbers_in(text_col)).alias("number"))


def _bucket(x: Column) -> Column:
    size = F.least(F.abs(x), F.lit(_LARGEST))
    fine = F.floor(size / _STEP)
    coarse = F.floor(F.ln(size / _SEAM) / F.ln(F.lit(_GROWTH))) + int(_SEAM / _STEP)
    place = F.when(size < _SEAM, fine).otherwise(coarse)
    return F.when(x >= 0, place).otherwise(-place - 1)


def _tolerance(evidence: Column) -> Column:
    return F.greatest(F.lit(GROUNDING_TOLERANCE), F.abs(evidence) * GROUNDING_SHARE)


def _agree(number: Column, evidence: Column) -> Column:
    return F.coalesce(F.abs(number - evidence) <= _tolerance(evidence), F.lit(False))


def numbers_grounded(
    texts: DataFrame, evidence: DataFrame, id_col: str, text_col: str = "text"
) -> DataFrame:
    """(id, numbers_grounded) for every text.

    A number agrees with an evidence number within 0.5 or 1 % of it. Small whole
    numbers and the anchors 0 and 100 need no evidence.

    No pairs are formed. Evidence numbers are filed under the buckets their tolerance
    reaches, and per (id, bucket) only three facts are kept: is there one in the bucket
    itself, the nearest one below it and the nearest one above it. Each text number
    then meets exactly one row. The key (id, bucket) also spreads one huge document.
    """
    number = F.col("number")
    exempt = ((F.abs(number) <= SMALL_WHOLE_NUMBER) & (number == F.rint(number))) | number.isin(
        *PERCENT_ANCHORS
    )
    to_check = (
        text_numbers(texts, id_col, text_col).filter(~exempt).withColumn("bucket", _bucket(number))
    )
    known = F.col("known")
    margin = _tolerance(known) + 0.1
    filed = (
        evidence.select(id_col, F.explode(record_numbers(evidence, id_col)).alias("known"))
        .filter(F.abs(known) <= _LARGEST)
        .select(
            id_col,
            "known",
            _bucket(known).alias("home"),
            F.explode(F.sequence(_bucket(known - margin), _bucket(known + margin))).alias("bucket"),
        )
        .groupBy(id_col, "bucket")
        .agg(
            F.max(F.col("home") == F.col("bucket")).alias("at"),
            F.max(F.when(F.col("home") < F.col("bucket"), known)).alias("below"),
            F.min(F.when(F.col("home") > F.col("bucket"), known)).alias("above"),
        )
    )
    supported = F.coalesce(
        (F.col("at") | _agree(number, F.col("below")) | _agree(number, F.col("above")))
        & (F.abs(number) <= _LARGEST),
        F.lit(False),
    )
    judged = (
        _merged(to_check, filed, [id_col, "bucket"], "left")
        .groupBy(id_col)
        .agg(F.min(supported).alias("supported"))
    )
    return _merged(texts.select(id_col), judged, id_col, "left").select(
        id_col, F.coalesce("supported", F.lit(True)).alias("numbers_grounded")
    )


def entities_grounded(
    texts: DataFrame, evidence: DataFrame, id_col: str, text_col: str = "text"
) -> DataFrame:
    """(id, entities_grounded) for every text.

    A text fails when it mentions a named entity together with a number that the
    evidence gives to another entity but not to this one. That is the case exactly
    when some number with an owner is owned by fewer entities than the text mentions,
    so it takes counts per (id, number) and no pairs of entities.

    A record meets its text once. Only the names and numbers that the text holds go on, dealt by
    (id, entity, number), so the records of one text can be split among tasks; the row without
    a number stands for the mention itself.
    """
    said = F.col(text_col)
    records = evidence.select(
        id_col,
        record_entity(evidence).alias("entity"),
        record_measures(evidence, id_col).alias("numbers"),
    ).filter(F.col("entity") != "")
    read = texts.select(id_col, said.alias("said"), numbers_in(said).alias("found")).where("said is not null")
    shared = F.array_intersect("numbers", "found")
    hit = F.contains("said", "entity")
    met = _merged(records, read, id_col).select(
        id_col, "entity", hit.alias("hit"), F.explode(F.concat(shared, F.array(F.lit(None).cast("double")))).alias("number")
    )
    kept = met.where(F.col("hit") | F.col("number").isNotNull()).repartition(id_col, "entity", "number").distinct()
    number = F.col("number")
    swapped = (
        kept.groupBy(id_col, "number")
        .agg(F.count_if("hit").alias("named"))
        .groupBy(id_col)
        .agg(
            F.min(F.when(number.isNotNull(), F.col("named"))).alias("owners"),
            F.max(F.when(number.isNull(), F.col("named"))).alias("mentions"),
        )
        .filter("owners < mentions")
        .select(id_col, F.lit(False).alias("sound"))
    )
    return _merged(texts.select(id_col), swapped, id_col, "left").select(
        id_col, F.coalesce("sound", F.lit(True)).alias("entities_grounded")
    )


def verified_text(
    candidates: DataFrame,
    evidence: DataFrame,
    id_col: str,
    candidate_col: str = "candidate",
    template_col: str = "template",
) -> DataFrame:
    """The candidate text where both checks pass, else the template; and which it was."""
    # checked under a key of id and text: repeated ids stay apart, and an unknown id has no evidence
    key, checked = "_checked", "_candidate"
    named = candidates.withColumn(key, F.struct(F.col(id_col).alias("id"), F.col(candidate_col).alias("text")))
    different = named.select(key, F.col(id_col), F.col(candidate_col).alias(checked)).distinct()
    facts = _merged(evidence, different.select(key, F.col(id_col)), id_col).drop(id_col)
    texts = different.select(key, checked)
    numbers = numbers_grounded(texts, facts, key, checked)
    names = entities_grounded(texts, facts, key, checked)
    failed = (
        numbers.filter(~F.col("numbers_grounded")).select(key)
        .union(names.filter(~F.col("entities_grounded")).select(key))
        .distinct()
        .select(F.col(key).alias("_failed"))
    )
    passes = F.col("_failed").isNull() & (F.length(F.coalesce(candidate_col, F.lit(""))) > 0)
    return (
        _merged(named, failed, F.col(key).eqNullSafe(F.col("_failed")), "left")
        .select(
            id_col,
            F.when(passes, F.col(candidate_col)).otherwise(F.col(template_col)).alias("text"),
            F.when(passes, F.lit("candidate")).otherwise(F.lit("template")).alias("text_source"),
        )
    )
