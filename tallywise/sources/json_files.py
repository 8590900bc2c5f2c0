"""JSON files: lists of records, objects around a list, single objects, and an object per line.

The shape is decided for each file by itself, so a folder may hold files of several shapes. A file with
an object on most of its lines is read line by line, and tasks share it; any other file is put together
from its lines and parsed as one value. Every record is a VARIANT until all of them are known; then one
aggregation gives the common type. What cannot be read is kept with its reason, beside the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallywise import fixed_values as fixed
from tallywise.sources.errors import DatasetError
from tallywise.sources.retail import strip_names
from tallywise.sources.written import written


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as columns ``outer_inner`` at every depth; arrays stay arrays."""

    def leaves(name: str, value: Column, dtype: T.DataType) -> list[Column]:
        if isinstance(dtype, T.StructType) and dtype.fields:
            found = []
            for f in dtype.fields:
                found += leaves(f"{name}_{f.name}", value.getField(f.name), f.dataType)
            return found
        names.append(name)
        return [value.alias(name)]

    names: list[str] = []
    columns = []
    for f in df.schema.fields:
        columns += leaves(f.name, F.col(f"`{f.name}`"), f.dataType)
    repeated = {n for n in names if names.count(n) > 1}
    if repeated:
        raise DatasetError(f"Flattened names collide: {sorted(repeated)}")
    return df.select(*columns)


def _is_object(variant: Column) -> Column:
    """Told by the outermost names alone, without a look at the types below; not true of null."""
    return F.try_variant_get(variant, "$", "map<string,variant>").isNotNull()


def _lines(spark: SparkSession, path: str, recursive: bool, glob: str | None) -> DataFrame:
    """(file, place, value, record) of every line that is not blank; record is null unless it is a whole object."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    lines = lines.where(F.trim("value") != "")
    begins = F.startswith(F.ltrim("value"), F.lit("{"))
    return lines.withColumn("record", F.when(begins, F.try_parse_json("value")))


def _facts(lines: DataFrame) -> DataFrame:
    """One row per file, and one for all together: lines, whole objects among them, the objects' type. Written.

    by_line tells whether a file is read line by line.
    """
    counted = lines.rollup("file").agg(
        F.grouping("file").alias("all_files"),
        F.count(F.lit(1)).alias("lines"),
        F.count("record").alias("objects"),
        F.min_by(F.substring(F.ltrim("value"), 1, 1), "place").alias("first"),
        F.schema_of_variant_agg("record").alias("type"),
    )
    by_line = (F.col("lines") > 1) & (F.col("objects") * 2 > F.col("lines")) & (F.col("first") != "[")
    return written(counted.withColumn("by_line", by_line))


def _from_lines(lines: DataFrame) -> DataFrame:
    bad = F.col("record").isNull()
    return lines.select(
        "file",
        F.lit(None).cast("string").alias("key"),
        "record",
        F.when(bad, F.col("value")).alias("row"),
        F.when(bad, F.lit(fixed.MALFORMED_REASON)).alias("reason"),
    )


def _from_whole_files(lines: DataFrame, array_key: str | None) -> DataFrame:
    """Records of files that are one JSON value: the elements of a list, those of the chosen list, or the object.

    A text is parsed once. Its first character tells a list from an object, and no filter asks for what is
    parsed: Spark would move it below, and parse for the filter as well.
    """
    placed = F.array_sort(F.collect_list(F.struct("place", "value")))
    text = F.array_join(F.transform(placed, lambda x: x["value"]), "\n")
    whole = lines.groupBy("file").agg(text.alias("row")).withColumn("first", F.regexp_extract("row", r"\S", 0))
    is_object = F.col("first") == "{"
    whole = whole.withColumns(
        {
            "value": F.try_parse_json("row"),
            "fields": F.when(is_object, F.from_json("row", "map<string,variant>")),
            "keys": F.when(is_object, F.json_object_keys("row")),
        }
    )

    def holds_records(key: Column) -> Column:
        first = F.try_variant_get(F.col("fields")[key], "$[0]", "variant")
        return _is_object(first)

    names = F.col("keys") if array_key is None else F.filter("keys", lambda k: k == array_key)
    whole = whole.withColumn("list_key", F.get(F.filter(names, holds_records), F.lit(0)))
    held = F.when(F.col("first") == "[", F.col("value")).otherwise(F.col("fields")[F.col("list_key")])
    whole = whole.withColumn("held", held)
    alone = F.col("held").isNull() & is_object & F.col("value").isNotNull()
    unread = F.col("held").isNull() & ~alone
    why = F.when(F.col("value").isNull(), fixed.MALFORMED_REASON).otherwise(fixed.NOT_A_TABLE_DETAIL)
    # an element travels with these columns, so they are null beside it
    whole = whole.select(
        "file",
        "held",
        F.when(alone, F.lit("")).otherwise(F.col("list_key")).alias("list_key"),
        F.when(alone, F.col("value")).alias("alone"),
        F.when(unread, F.col("row")).alias("unread"),
        F.when(unread, why).alias("why"),
    )
    listed = whole.lateralJoin(lines.sparkSession.tvf.variant_explode_outer(F.col("held").outer()).alias("e"))
    element = F.col("e.value")
    good = _is_object(element)
    stray = element.isNotNull() & ~good
    return listed.where("e.value is not null or alone is not null or unread is not null").select(
        "file",
        F.col("list_key").alias("key"),
        F.when(good, element).otherwise(F.col("alone")).alias("record"),
        F.coalesce("unread", F.when(stray, F.to_json(element))).alias("row"),
        F.coalesce("why", F.when(stray, F.lit(fixed.NOT_AN_OBJECT_REASON))).alias("reason"),
    )


def json_records(
    spark: SparkSession, path: str, array_key: str | None = None, recursive: bool = False, glob: str | None = None
) -> DataFrame:
    """(file, key, record, row, reason): every record of the files as a VARIANT, or what could not be read, and why.

    key names the list that a record comes from; it is empty for an object that is one record itself,
    and null for elements of a list and lines. An object with a name twice counts as malformed.
    """
    lines = _lines(spark, path, recursive, glob)
    return _records(lines, _facts(lines), array_key)


def _records(lines: DataFrame, facts: DataFrame, array_key: str | None) -> DataFrame:
    shapes = facts.where("all_files = 0").select(F.col("file").alias("of"), "by_line")
    known = lines.join(shapes, F.col("file") == F.col("of")).drop("of")
    whole = _from_whole_files(known.where("not by_line").drop("by_line"), array_key)
    return _from_lines(known.where("by_line")).union(whole)


def _plain(dtype: T.DataType) -> T.DataType:
    """The type to read: fractions as doubles, whole numbers with all digits, what is always null as text."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain(dtype.elementType))
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType() if dtype.scale else T.DecimalType(38, 0)
    return T.StringType() if isinstance(dtype, (T.NullType, T.VariantType)) else dtype


def typed(records: DataFrame, type_of_all: str | None) -> DataFrame:
    """The objects of the VARIANT column `record` as columns, by what ``schema_of_variant_agg`` says of them."""
    schema = T.DataType.fromDDL((type_of_all or "VOID").replace("OBJECT<", "STRUCT<"))
    if not isinstance(schema, T.StructType) or not schema.fields:
        raise DatasetError(fixed.EMPTY_DATA_DETAIL)
    return records.select(F.col("record").cast(_plain(schema)).alias("r")).select("r.*")


def read_json(
    spark: SparkSession, path: str, array_key: str | None = None, bad: str = "raise", recursive: bool = False
) -> tuple[DataFrame, str]:
    """A table from a JSON file or folder, and a note on how it was found.

    A list of objects gives a row per object. An object gives the rows of its first list of objects (or of
    ``array_key``), else one row. One object on most lines gives a row per line; tasks share such a file.
    Files of a folder may differ in shape. Nested objects are flattened. What cannot be read is an
    error, or, with ``bad="leave_out"``, left to ``bad_json``.
    """
    lines = _lines(spark, path, recursive, None)
    facts = _facts(lines)
    alike = facts.where("all_files = 0 and not by_line").isEmpty()
    if array_key is None and alike:  # lines only: counted and typed on the pass that told the shapes
        seen = facts.where("all_files = 1").select(
            F.col("objects").alias("good"), "type", F.lit(None).alias("key"), F.lit(0).alias("single"),
            F.when(F.col("lines") > F.col("objects"), F.lit(fixed.MALFORMED_REASON)).alias("reason"),
        ).first()
        records = _from_lines(lines)
    else:
        records = _records(lines, facts, array_key)
        seen = records.agg(
            F.count("record").alias("good"),
            F.schema_of_variant_agg("record").alias("type"),
            F.min(F.when(F.col("key") != "", F.col("key"))).alias("key"),
            F.count_if(F.col("key") == "").alias("single"),
            F.min("reason").alias("reason"),
        ).first()
    if seen is None:
        raise DatasetError(fixed.EMPTY_DATA_DETAIL)
    if seen.reason is not None and (bad == "raise" or not seen.good):
        malformed = seen.reason == fixed.MALFORMED_REASON
        raise DatasetError(fixed.PARSE_ERROR_DETAIL.format(error=seen.reason) if malformed else fixed.NOT_A_TABLE_DETAIL)
    if not seen.good:
        raise DatasetError(fixed.EMPTY_DATA_DETAIL)
    df = strip_names(flatten(typed(records.where("record is not null"), seen.type)))
    if seen.key is not None:
        return df, fixed.ARRAY_KEY_DETAIL.format(key=seen.key)
    return df, fixed.SINGLE_OBJECT_DETAIL if seen.single else ""


def bad_json(spark: SparkSession, path: str, array_key: str | None = None) -> DataFrame:
    """(file, row, reason) of what ``read_json`` cannot read: a line, an element of a list, or a whole file."""
    return json_records(spark, path, array_key).where("reason is not null").select("file", "row", "reason")
