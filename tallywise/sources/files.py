"""Files of unknown content: what they are, and what can be read from them.

Tables (delimited files, JSON) become DataFrames to analyse. Documents (text) are
context to show, never figures to compute with. Everything else is declined with a
reason. A file that cannot be read is a row with an error, not an exception.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallywise import fixed_values as fixed
from tallywise.sources.errors import DatasetError
from tallywise.sources.json_files import json_records, read_json
from tallywise.sources.retail import cleared, delimited_reader, strip_names


# ---------------------------------------------------------------------------
# Delimited files
# ---------------------------------------------------------------------------


def infer_types(texts: DataFrame) -> DataFrame:
    """Typed columns from text columns, after clearing the texts that mean "no value".

    A column is whole numbers, numbers or true/false when all its values are; anything
    else stays text. Whole numbers too large for 64 bits are decimals of up to 38 digits,
    beyond that text: no digit is lost. One aggregation decides for all columns; one row
    comes back.
    """
    cleaned = cleared(texts)

    def all_like(c: Column, matches: Column) -> Column:
        return F.count(c) == F.count_if(matches)

    def whole(c: Column) -> Column:
        return (
            F.when(all_like(c, c.try_cast("bigint").isNotNull()), "bigint")
            .when(all_like(c, c.try_cast("decimal(38,0)").isNotNull()), "decimal(38,0)")
            .otherwise("string")
        )

    def kind(name: str) -> Column:
        c = F.col(f"`{name}`")
        return (
            F.when(F.count(c) == 0, "double")
            .when(all_like(c, c.rlike(fixed.WHOLE_NUMBER_SHAPE)), whole(c))
            .when(all_like(c, c.rlike(fixed.NUMBER_SHAPE)), "double")
            .when(all_like(c, F.lower(c).isin(*fixed.TRUTH_TEXTS)), "boolean")
            .otherwise("string")
        )

    kinds = cleaned.agg(F.array(*[kind(c) for c in cleaned.columns]).alias("k")).first().k
    return cleaned.select(
        *[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(cleaned.columns, kinds, strict=True)]
    )


def _has_open_lines(spark: SparkSession, path: str) -> bool:
    """Is there a line with an odd number of quotes, which a cell may go on after?"""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: T.StructType | str | None = None,
    max_rows: int | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A delimited file or folder with a header row.

    With a ``schema`` nothing is read until the table is used; without one the types are
    worked out from all values first. Quoted cells may hold separators, doubled quotes
    and line breaks. Unless ``multi_line`` says whether cells hold line breaks, the lines are looked
    through: if every line has an even number of quotes, no cell goes on in the next line, and tasks
    share a file; else a file is one task. With ``multi_line=False`` nothing is looked through, and a row
    that does not have the header's number of cells is an error, never a broken row. There is no
    row limit unless asked for.
    """
    if multi_line is None:
        multi_line = _has_open_lines(spark, path)
        reader = delimited_reader(spark, sep).option("multiLine", multi_line)
    else:
        reader = delimited_reader(spark, sep, multi_line)
    if schema is not None:
        df = strip_names(reader.schema(schema).csv(path))
    else:
        texts = strip_names(reader.csv(path))
        if not texts.columns:
            raise DatasetError(fixed.NO_COLUMNS_DETAIL)
        df = infer_types(texts)
    if df.isEmpty():
        raise DatasetError(fixed.NO_ROWS_DETAIL)
    if max_rows is not None:
        rows = df.count()
        if rows > max_rows:
            raise DatasetError(fixed.TOO_MANY_ROWS_DETAIL.format(rows=rows, limit=max_rows))
    return df


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


# ---------------------------------------------------------------------------
# Rows that cannot be read
# ---------------------------------------------------------------------------

_WHOLE_ROW = "_whole_row"


def _with_bad_rows(spark: SparkSession, path: str, sep: str, schema: T.StructType | str, multi_line: bool) -> DataFrame:
    """The columns of the schema, _file, _whole_row (null for a good row) and _cells: does the row have all its cells?

    Cells come as text first: so a row of another number of cells and a cell of another type are told apart.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = T.StructType([*[T.StructField(f.name, T.StringType()) for f in wanted], T.StructField(_WHOLE_ROW, T.StringType())])
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _WHOLE_ROW).schema(texts)
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    missing = {f.name: F.col(f"`{f.name}`").isin(*fixed.MISSING_TEXTS) for f in wanted}
    cells = {f.name: F.when(~missing[f.name], F.col(f"`{f.name}`")) for f in wanted}
    typed = [cells[f.name].try_cast(f.dataType).alias(f.name) for f in wanted]
    unfit = [cells[f.name].isNotNull() & cells[f.name].try_cast(f.dataType).isNull() for f in wanted]
    misfit = reduce(lambda a, b: a | b, unfit)
    shown = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in wanted]), {"ignoreNullFields": "false"})
    whole = F.coalesce(F.col(_WHOLE_ROW), F.when(misfit, shown)).alias(_WHOLE_ROW)
    return rows.select(*typed, "_file", whole, F.col(_WHOLE_ROW).isNull().alias("_cells"))


def read_good_rows(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """The rows of delimited files that have all cells of the schema, each of its type; see ``bad_rows`` for the others."""
    rows = _with_bad_rows(spark, path, sep, schema, multi_line)
    return rows.where(F.col(_WHOLE_ROW).isNull()).drop("_file", _WHOLE_ROW, "_cells")


def bad_rows(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """(file, row, reason) of the rows that ``read_good_rows`` leaves out.

    A row of the wrong number of cells is shown as it stands in the file, one with a cell of another type
    as JSON of its cells. Texts that mean "no value" fit every type.
    """
    rows = _with_bad_rows(spark, path, sep, schema, multi_line).where(F.col(_WHOLE_ROW).isNotNull())
    reason = F.when(F.col("_cells"), fixed.CELL_TYPE_REASON).otherwise(fixed.CELL_COUNT_REASON)
    return rows.select(F.col("_file").alias("file"), F.col(_WHOLE_ROW).alias("row"), reason.alias("reason"))


# ---------------------------------------------------------------------------
# Documents
# ---------------------------------------------------------------------------


def _name(path: Column) -> Column:
    """The file's name without its folders, decoded, from `_metadata`."""
    name = F.element_at(F.split(path, "/"), -1)  # encoded, but for plus signs
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_documents(
    spark: SparkSession, path: str | list[str], max_chars: int | None = None, recursive: bool = False, glob: str | None = None
) -> DataFrame:
    """(file, text) for text documents, one row per file, whole unless ``max_chars`` is given.

    Bytes that are no UTF-8 become the replacement character; a byte order mark is kept.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    return reader.load(path).select(_name(F.col("_metadata.file_path")).alias("file"), text.alias("text"))


# ---------------------------------------------------------------------------
# A folder of files
# ---------------------------------------------------------------------------

READABLE = (".csv", ".tsv", ".json", ".txt", ".md")


def _any_case(extension: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def _classified(files: DataFrame) -> DataFrame:
    """(path, file, extension, length, kind, status, detail) of (path, file, length): what a name says a file is."""
    known = (*fixed.STRUCTURED_EXTENSIONS, *fixed.DOCUMENT_EXTENSIONS)
    e = F.col("extension")
    image, video = e.isin(*fixed.IMAGE_EXTENSIONS), e.isin(*fixed.VIDEO_EXTENSIONS)
    unknown = F.replace(
        F.lit(fixed.UNKNOWN_FORMAT_DETAIL),
        F.lit("{extension}"),
        F.when(e == "", "no extension").otherwise(e),
    )
    no_reader = e.isin(*[x for x in known if x not in READABLE])
    unread = F.replace(F.lit(fixed.NO_READER_DETAIL), F.lit("{extension}"), F.upper(F.substr(e, F.lit(2))))
    kind = (
        F.when(no_reader, "unsupported")
        .when(e.isin(*fixed.STRUCTURED_EXTENSIONS), "data")
        .when(e.isin(*fixed.DOCUMENT_EXTENSIONS), "context")
        .otherwise("unsupported")
    )
    return (
        files.withColumn("extension", F.lower(F.regexp_extract("file", r"[^.](\.[^.]+)$", 1)))
        .withColumn("kind", kind)
        .select(
            "path",
            "file",
            "extension",
            "length",
            "kind",
            F.when(no_reader, "error")
            .when(F.col("kind") == "data", "ready")
            .when(F.col("kind") == "context", "extracted")
            .otherwise("declined")
            .alias("status"),
            F.when(no_reader, unread)
            .when(F.col("kind") != "unsupported", "")
            .when(image, fixed.IMAGE_DETAIL)
            .when(video, fixed.VIDEO_DETAIL)
            .otherwise(unknown)
            .alias("detail"),
        )
    )


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below a folder: what its name says it is. File contents are not read.

    Names and sizes are metadata columns of the scan, so the list of files is a table like any other.
    A scan skips files without a byte; ``ingest`` lists them.
    """
    scanned = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.col("_metadata.file_path")
    files = scanned.select(at.alias("path"), _name(at).alias("file"), F.col("_metadata.file_size").alias("length"))
    return _classified(files).orderBy("path")


def inventory_summary(spark: SparkSession, path: str) -> DataFrame:
    """File, Type, Role, Size, Status and Detail of every file below a folder, after reading them all; one plan.

    Rows of delimited files and of JSON are counted per file, characters of documents too, each kind by one
    scan over all its files. A file that holds nothing, or cannot be read, has the status Error.
    """
    listed = file_inventory(spark, path)

    def delimited(extension: str, sep: str) -> DataFrame:
        reader = delimited_reader(spark, sep).option("recursiveFileLookup", True).option("pathGlobFilter", _any_case(extension))
        rows = reader.option("enforceSchema", True).schema("cell string").csv(path)
        return rows.groupBy(F.col("_metadata.file_path").alias("of")).agg(F.count(F.lit(1)).alias("n"))

    records = json_records(spark, path, recursive=True, glob=_any_case(".json"))
    objects = records.groupBy(F.col("file").alias("of")).agg(
        F.count("record").alias("n"),
        F.min("reason").alias("reason"),
        F.max("key").alias("key"),
    )
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("_metadata.file_name", r"(\.[^.]+)$", 1))
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    texts = texts.where(suffix.isin(".txt", ".md")).select(
        F.col("_metadata.file_path").alias("of"), F.when(valid.rlike(r"\S"), F.length(valid)).otherwise(0).cast("bigint").alias("n")
    )
    counted = delimited(".csv", ",").union(delimited(".tsv", "\t")).union(texts)
    counted = counted.unionByName(objects, allowMissingColumns=True)
    number = F.format_number("n", 0)
    nothing = F.coalesce("n", F.lit(0)) == 0
    wrong = (F.col("kind") != "unsupported") & (nothing | F.col("reason").isNotNull())
    unread = F.col("reason").isNotNull() & (F.col("reason") != fixed.NOT_A_TABLE_DETAIL)
    key = F.col("key")
    found = F.when(key == "", fixed.SINGLE_OBJECT_DETAIL).when(
        key.isNotNull(), F.replace(F.lit(fixed.ARRAY_KEY_DETAIL), F.lit("{key}"), key)
    )
    empty = F.when(F.col("kind") == "data", fixed.EMPTY_DATA_DETAIL).otherwise("")
    fault = F.when(unread, F.replace(F.lit(fixed.PARSE_ERROR_DETAIL), F.lit("{error}"), F.col("reason")))
    fault = fault.otherwise(F.coalesce("reason", empty))
    role = F.create_map(*[F.lit(x) for pair in fixed.ROLE_NAMES.items() for x in pair])[
        F.when(wrong, "unsupported").otherwise(F.col("kind"))
    ]
    size = F.when(wrong | (F.col("kind") == "unsupported"), fixed.NO_SIZE)
    size = size.when(F.col("kind") == "data", F.concat(number, F.lit(" rows"))).otherwise(F.concat(number, F.lit(" chars")))
    return listed.join(counted, F.col("path") == F.col("of"), "left").orderBy("path").select(
        F.col("file").alias("File"),
        F.upper(F.substr("extension", F.lit(2))).alias("Type"),
        role.alias("Role"),
        size.alias("Size"),
        F.initcap(F.when(wrong, "error").otherwise(F.col("status"))).alias("Status"),
        F.when(wrong, fault).otherwise(F.coalesce(found, F.col("detail"))).alias("Detail"),
    )


def data_files(inventory: DataFrame) -> DataFrame:
    """The files of ``file_inventory`` that hold tables to analyse."""
    return inventory.where(F.col("kind") == "data")


def context_files(inventory: DataFrame) -> DataFrame:
    """The files of ``file_inventory`` that are documents to show."""
    return inventory.where(F.col("kind") == "context")


@dataclass
class IngestedFile:
    """One file: its kind and status, and the table or document read from it."""

    name: str
    extension: str
    kind: str
    status: str
    detail: str = ""
    frame: DataFrame | None = None
    document: DataFrame | None = None

    @property
    def text(self) -> str:
        """The text of a document, fetched when it is asked for."""
        return "" if self.document is None else self.document.first().text


@dataclass
class Ingested:
    """The files of a folder, in the order of their names."""

    spark: SparkSession
    files: list[IngestedFile] = field(default_factory=list)

    def data_files(self) -> list[IngestedFile]:
        return [f for f in self.files if f.kind == "data"]

    def context_files(self) -> list[IngestedFile]:
        return [f for f in self.files if f.kind == "context"]

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: f.frame for f in self.data_files()}

    def summary(self) -> DataFrame:
        """File, Type, Role, Size, Status and Detail per file; tables and texts are measured in one job."""
        rows = [
            (
                i,
                f.name,
                f.extension.lstrip(".").upper(),
                fixed.ROLE_NAMES[f.kind],
                fixed.NO_SIZE,
                f.status.capitalize(),
                f.detail,
            )
            for i, f in enumerate(self.files)
        ]
        schema = "i int, File string, Type string, Role string, Size string, Status string, Detail string"
        listed = self.spark.createDataFrame(rows, schema)
        counts = self.spark.createDataFrame([], "j int, counted string")
        for i, f in enumerate(self.files):
            if f.frame is not None:
                counted = F.concat(F.format_number(F.count(F.lit(1)), 0), F.lit(" rows"))
                counts = counts.union(f.frame.agg(counted).select(F.lit(i), "*"))
            if f.document is not None:
                length = F.format_number(F.coalesce(F.sum(F.length("text")), F.lit(0)), 0)
                counts = counts.union(f.document.agg(F.concat(length, F.lit(" chars"))).select(F.lit(i), "*"))
        return (
            listed.join(counts, F.col("i") == F.col("j"), "left")
            .withColumn("Size", F.coalesce("counted", "Size"))
            .orderBy("i")
            .drop("i", "j", "counted")
        )


def _read_table(spark: SparkSession, path: str, extension: str) -> tuple[DataFrame, str]:
    if extension == ".csv":
        return read_csv(spark, path), ""
    if extension == ".tsv":
        return read_tsv(spark, path), ""
    if extension == ".json":
        return read_json(spark, path)
    raise DatasetError(fixed.NO_READER_DETAIL.format(extension=extension.lstrip(".").upper()))


def _ingest_one(spark: SparkSession, row) -> IngestedFile:
    def unusable(detail: str) -> IngestedFile:
        return IngestedFile(row.file, row.extension, "unsupported", "error", detail)

    if row.kind == "unsupported":
        return IngestedFile(row.file, row.extension, row.kind, row.status, row.detail)
    path = unquote(row.path)
    try:
        if row.kind == "data":
            frame, detail = _read_table(spark, path, row.extension)
            return IngestedFile(row.file, row.extension, "data", "ready", detail, frame=frame)
        document = read_documents(spark, path)
        empty = document.filter(F.col("text").rlike(r"\S")).isEmpty()
    except DatasetError as e:
        return unusable(str(e))
    except (AnalysisException, PySparkException) as e:
        return unusable(fixed.PARSE_ERROR_DETAIL.format(error=str(e).splitlines()[0]))
    if empty:
        return unusable("")
    return IngestedFile(row.file, row.extension, "context", "extracted", document=document)


def ingest(spark: SparkSession, path: str) -> Ingested:
    """Every file of a folder of uploads, read where possible.

    Meant for what a person uploads: the driver goes through the list of files. The
    tables and documents stay lazy.
    """
    scanned = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = [(p, unquote(p.rsplit("/", 1)[-1])) for p in scanned.inputFiles()]  # files without a byte are among them
    files = spark.createDataFrame(names, "path string, file string").withColumn("length", F.lit(None).cast("bigint"))
    rows = _classified(files).orderBy("path").collect()
    return Ingested(spark, [_ingest_one(spark, row) for row in rows])


def records(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows as JSON objects, nulls included, all or the first few."""
    chosen = df if rows is None else df.limit(rows)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return chosen.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("record"))
