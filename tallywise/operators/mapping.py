"""From the columns of any table to business concepts.

Mapping works on column names and types, which are metadata: it is plain Python over
the profile rows, whose number is the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallywise.fixed_values import (
    ANALYSIS_REQUIREMENTS,
    CONCEPT_SYNONYMS,
    NUMERIC_CONCEPTS,
    RETURN_FLAG_MAX_DISTINCT,
)
from tallywise.functions.dates import parse_date
from tallywise.operators.profile import datelike_texts, is_date, is_numeric, present, union_all

Mapping = dict[str, str | None]


@dataclass(frozen=True)
class ColumnFacts:
    """What mapping needs to know about a column."""

    name: str
    is_numeric: bool
    is_datelike: bool


def column_facts(tables: dict[str, DataFrame]) -> dict[str, list[ColumnFacts]]:
    """Name, numeric? and date-like? of every column of every table.

    Types come from the schemas; only text columns are read, all tables in one job,
    and one row per table with text comes back.
    """
    checked = {
        name: [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        for name, df in tables.items()
    }
    reads = [
        datelike_texts(tables[name], texts).select(F.lit(name).alias("t"), "datelike")
        for name, texts in checked.items()
        if texts
    ]
    datelike = {row.t: set(row.datelike) for row in union_all(reads).collect()} if reads else {}
    return {
        name: [
            ColumnFacts(
                f.name, is_numeric(f.dataType), is_date(f.dataType) or f.name in datelike.get(name, ())
            )
            for f in df.schema
        ]
        for name, df in tables.items()
    }


def normalized(name: str) -> str:
    """Lower-case letters and digits only."""
    return "".join(filter(str.isalnum, name.lower()))


def suggest_mapping(columns: list[ColumnFacts]) -> Mapping:
    """Best column per concept, or None; a suggestion to be confirmed.

    A column named like a synonym beats one that merely contains a synonym; among
    equals the earlier synonym, respectively the earlier column, wins. The winner has
    to have the right type; if it has not, the concept stays open (the runner-up is
    not considered) and the column remains free for the concepts that follow.
    Columns whose normalized names collide count as one, the last of them.
    """
    by_name = {c.name: c for c in columns}
    mapping: Mapping = {}
    for concept, names in _preferences([c.name for c in columns]).items():
        best = next((by_name[n] for n in names if n not in mapping.values()), None)
        mapping[concept] = best.name if best and _fits(concept, best) else None
    return mapping


def _preferences(names: list[str]) -> dict[str, list[str]]:
    """For each concept the columns whose names would do, the best first."""
    by_name = {normalized(n): n for n in names}
    found = {}
    for concept, synonyms in CONCEPT_SYNONYMS.items():
        wanted = [normalized(s) for s in synonyms]
        ranked = []
        for position, (short, name) in enumerate(by_name.items()):
            if short in wanted:
                ranked.append((0, wanted.index(short), name))
            elif any(w in short for w in wanted):
                ranked.append((1, position, name))
        found[concept] = [name for *_, name in sorted(ranked)]
    return found


def suggested_mappings(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, concept, column_name) of ``suggest_mapping`` for every table, as a plan.

    Names and types are known when the plan is made; which texts read as dates is one aggregate per
    table, and the concepts choose their columns one after the other on its single row.
    """
    return union_all([_suggested(name, df) for name, df in tables.items()])


def _suggested(name: str, df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    kinds = {f.name: f.dataType for f in df.schema}
    row = datelike_texts(df, texts) if texts else df.agg(F.array().cast("array<string>").alias("datelike"))
    steps = []
    for concept, names in _preferences(df.columns).items():
        typed = [n for n in names if (is_numeric if concept in NUMERIC_CONCEPTS else is_date)(kinds[n])]
        fitting = typed if concept in NUMERIC_CONCEPTS or concept == "date" else names
        lists = [F.array(*map(F.lit, x)).cast("array<string>") for x in (names, fitting)]
        steps.append(F.struct(lists[0].alias("names"), lists[1].alias("fitting"), F.lit(concept == "date").alias("dated")))

    def choose(chosen: Column, step: Column) -> Column:
        free = F.filter(step["names"], lambda n: ~F.exists(chosen, lambda c: c.eqNullSafe(n)))
        fits = lambda n: F.array_contains(step["fitting"], n) | (step["dated"] & F.array_contains("datelike", n))
        return F.concat(chosen, F.transform(_first(free), lambda n: F.when(fits(n), n)))

    chosen = F.aggregate(F.array(*steps), F.array().cast("array<string>"), choose)
    named = F.arrays_zip(F.array(*map(F.lit, CONCEPT_SYNONYMS)).alias("concept"), chosen.alias("column_name"))
    return row.select(F.lit(name).alias("table_name"), F.inline(named).alias("concept", "column_name"))


def _first(names: Column) -> Column:
    """A list of one: the first name, or null."""
    return F.array(F.get(names, F.lit(0)))


def _fits(concept: str, column: ColumnFacts) -> bool:
    if concept in NUMERIC_CONCEPTS:
        return column.is_numeric
    return column.is_datelike if concept == "date" else True


def mapping_rows(spark: SparkSession, mapping: Mapping) -> DataFrame:
    """The mapping as (concept, column_name) rows."""
    return spark.createDataFrame(list(mapping.items()), "concept string, column_name string")


def candidate_columns(profile: DataFrame) -> DataFrame:
    """(concept, column_name) for every column that could stand for a concept.

    ``profile`` is the result of ``column_profile`` with distinct counts. Each profile
    row unfolds into the concepts it is good for; nothing is joined.
    """
    datelike, numeric = F.col("is_datelike"), F.col("is_numeric")

    def rule(concept: str):
        if concept == "date":
            return datelike
        if concept in NUMERIC_CONCEPTS:
            return numeric
        if concept == "return_flag":
            return (F.col("distinct_count") <= RETURN_FLAG_MAX_DISTINCT) & ~datelike
        return ~datelike & ~F.col("is_measure")

    fitting = F.array_compact(F.array(*[F.when(rule(c), F.lit(c)) for c in CONCEPT_SYNONYMS]))
    return profile.select(F.explode(fitting).alias("concept"), "column_name")


def canonical_frame(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Mapped columns under their concept names; values that do not convert become null.

    Profit is revenue minus cost when no profit column is mapped. Exact number types
    stay as they are, so sums of them stay exact.
    """
    chosen = []
    for concept in CONCEPT_SYNONYMS:
        name = mapping.get(concept)
        if name is None or name not in df.columns:
            continue
        dtype, value = df.schema[name].dataType, present(df, name)
        if concept == "date":
            value = value.cast("timestamp_ntz") if is_date(dtype) else parse_date(value.cast("string"))
        elif concept in NUMERIC_CONCEPTS:
            if isinstance(dtype, T.BooleanType):
                value = value.cast("int")
            elif not isinstance(dtype, T.NumericType):
                number = F.trim(value.cast("string")).try_cast("double")
                value = F.when(~F.isnan(number), number)
        chosen.append(value.alias(concept))
    frame = df.select(*chosen)
    if "profit" not in frame.columns and {"revenue", "cost"} <= set(frame.columns):
        frame = frame.withColumn("profit", F.col("revenue") - F.col("cost"))
    return frame


def missing_requirements(analysis: str, concepts: Iterable[str]) -> list[str]:
    """What an analysis still needs, alternatives joined by ``or``."""
    have = set(concepts)
    groups = ANALYSIS_REQUIREMENTS.get(analysis, [])
    return [" or ".join(group) for group in groups if not have.intersection(group)]


def capabilities(concepts: Iterable[str]) -> dict[str, bool]:
    """Analysis -> can it run with these canonical columns?"""
    have = set(concepts)
    return {name: not missing_requirements(name, have) for name in ANALYSIS_REQUIREMENTS}


def capability_matrix(spark: SparkSession, concepts: Iterable[str]) -> DataFrame:
    """(analysis, supported, missing) rows."""
    have = set(concepts)
    rows = [
        (position, name, supported, missing_requirements(name, have))
        for position, (name, supported) in enumerate(capabilities(have).items())
    ]
    schema = "position int, analysis string, supported boolean, missing array<string>"
    return spark.createDataFrame(rows, schema)

