"""Every registered query: (spark, directory of the test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallywise.operators import (
    breakdown,
    checks,
    delivery,
    discover,
    enrich,
    generic,
    grounding,
    inventory,
    kpi,
    mapping,
    marketing,
    profile,
    returns,
    sketches,
    stats,
    targets,
)
from tallywise.functions.texts import shorten
from tallywise.plans import findings as finding_plans
from tallywise.plans import questions as question_plans
from tallywise.plans import user_tables
from tallywise.sources.files import (
    bad_rows,
    context_files,
    data_files,
    file_inventory,
    inventory_summary,
    read_csv,
    read_documents,
    read_tsv,
    records,
)
from tallywise.sources.footers import bounds
from tallywise.sources.json_files import bad_json, read_json
from tallywise.sources.retail import load_retail_tables
from tallywise.sources.written import written
from verification import views
from verification.scratch import as_delimited, scratch_folder

Query = Callable[[SparkSession, str], DataFrame]

WINDOW = ("2000-01-01", "2000-12-31")
TARGET_MONTH = "2001-07"
FILE_ROWS = 4_000  # keys that share a file
LONG_ID = 1_234_567_890_000_000_000
PROFILED = ("lineitem", "orders", "customer", "documents")
MAPPED = ("orders", "lineitem", "customer", "part", "events", "documents", "benchmark", "nation", "supplier")


SKETCH_ERROR = 0.04  # five standard deviations of the distinct counts


def _range_checks() -> dict[str, Column]:
    return {
        "quantity is positive": checks.positive("l_quantity"),
        "price is not negative": checks.not_negative("l_extendedprice"),
        "discount is a fraction": checks.within("l_discount", 0, 1),
        "discount at most 5 %": checks.within("l_discount", 0, 0.05),
        "discount at most tax": checks.at_most("l_discount", "l_tax"),
    }


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and timestamps as text: the same in every engine."""

    def shown(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(field.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def _retail(build: Callable) -> Query:
    return lambda spark, sf_dir: build(views.retail(spark, sf_dir))


def _user(build: Callable) -> Query:
    return lambda spark, sf_dir: build(views.user_frame(spark, sf_dir))


def _texts_with_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whose texts hold quotes, separators and line breaks, with ids of 19 digits."""
    return views.table(spark, sf_dir, "documents").withColumn("long_id", F.col("doc_id") + LONG_ID)


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and read back without a schema."""
    return read_csv(spark, as_delimited(_texts_with_long_ids(spark, sf_dir), ","))


def _tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as TSV and read back without a schema."""
    return read_tsv(spark, as_delimited(_texts_with_long_ids(spark, sf_dir), "\t"))


def _json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one JSON object per line and read back."""
    folder = scratch_folder(spark)
    views.table(spark, sf_dir, "conversations").write.json(folder)
    return read_json(spark, folder)[0]


def _in_files(df: DataFrame, bucket: Column, value: Column, folder: str) -> None:
    """One file for each bucket of rows, with the text that the aggregate `value` makes of them."""
    held = df.groupBy(bucket.alias("bucket")).agg(value.alias("value"))
    held.write.partitionBy("bucket").text(folder)


def _json_record_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines, as one top-level JSON list in each of many files, read back as rows."""
    lines = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("of")).agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"))).alias("lines")
    )
    orders = views.table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("of"), "left")
    record = F.struct("o_orderkey", F.struct(F.col("o_custkey").alias("key")).alias("customer"), "lines")
    folder = scratch_folder(spark)
    _in_files(orders, F.floor(F.col("o_orderkey") / FILE_ROWS), F.to_json(F.collect_list(record)), folder)
    read = read_json(spark, folder)[0]
    units = F.aggregate("lines", F.lit(0.0), lambda total, line: total + line["quantity"])
    return read.select(
        "o_orderkey", "customer_key", F.size(F.coalesce("lines", F.array().cast(read.schema["lines"].dataType))).alias("n_lines"),
        F.coalesce(units, F.lit(0.0)).alias("units"),
    )


def _json_mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in one folder of lists, objects around a list, and files of lines; every row comes back."""
    customers = views.table(spark, sf_dir, "customer")
    record = F.struct("c_custkey", "c_name", F.struct(F.col("c_nationkey").alias("key")).alias("nation"))
    listed = F.collect_list(record)
    bucket, shape, folder = F.floor(F.col("c_custkey") / FILE_ROWS), F.col("c_custkey") % 3, scratch_folder(spark)
    _in_files(customers.where(shape == 0), bucket, F.to_json(listed), f"{folder}/shape=list")
    around = F.to_json(F.struct(F.lit("all").alias("title"), listed.alias("rows")))
    _in_files(customers.where(shape == 1), bucket, around, f"{folder}/shape=object")
    customers.where(shape == 2).select(F.to_json(record)).write.text(f"{folder}/shape=lines")
    return read_json(spark, folder, recursive=True)[0]


def _bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV and as JSON lines, some of them spoiled: the rows that cannot be read, and why."""
    key, folder = F.col("o_orderkey"), scratch_folder(spark)
    orders = views.table(spark, sf_dir, "orders").select(key, F.col("o_custkey"))
    spoiled = F.when(key % 7 == 0, "none at all").otherwise(F.col("o_custkey").cast("string"))
    rows = orders.select(F.concat_ws(",", key, spoiled, F.when(key % 11 == 0, "extra")).alias("orderkey,custkey"))
    rows.write.option("header", True).option("sep", "\x01").csv(f"{folder}/csv")  # one column, so nothing is quoted
    broken = F.when(key % 5 == 0, F.concat(F.lit("{"), key)).otherwise(F.to_json(F.struct("o_orderkey", "o_custkey")))
    orders.select(broken).write.text(f"{folder}/json")
    schema = "orderkey bigint, custkey bigint"
    delimited = bad_rows(spark, f"{folder}/csv", schema).select(F.lit("csv").alias("source"), "row", "reason")
    return delimited.union(bad_json(spark, f"{folder}/json").select(F.lit("json"), "row", "reason"))


def _json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the orders as one nested JSON object, read back as one flat row."""
    orders = views.table(spark, sf_dir, "orders")
    customers = F.struct(F.count_distinct("o_custkey").alias("known"), F.max("o_custkey").alias("last"))
    folder = scratch_folder(spark)
    figures = F.struct(F.count("o_orderkey").alias("orders"), customers.alias("customers"))
    orders.agg(F.to_json(figures)).write.text(folder)
    return read_json(spark, folder)[0]


def _document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per benchmark item, some with bytes that are no UTF-8, read whole: a digest of each text."""
    broken = F.when(F.col("item_id") % 3 == 0, F.concat(F.unhex(F.lit("41FF42E28243")), F.encode("text", "UTF-8")))
    items = views.table(spark, sf_dir, "benchmark").where("text is not null").select(
        F.coalesce(broken, F.encode("text", "UTF-8")).cast("string").alias("value"), "item_id"
    )
    folder = scratch_folder(spark)
    items.write.partitionBy("item_id").text(folder)
    read = read_documents(spark, folder, recursive=True)
    return read.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").cast("bigint").alias("chars"))


def _mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of one CSV, one JSON, one text and one Parquet file per customers' nation; one text is blank."""
    customers, folder = views.table(spark, sf_dir, "customer"), scratch_folder(spark)
    nation = F.col("c_nationkey").alias("nation")
    rows = customers.select(nation, "c_custkey", "c_name").repartition("nation")
    rows.write.partitionBy("nation").option("header", True).csv(f"{folder}/tables")
    rows.write.partitionBy("nation").parquet(f"{folder}/others")
    rows.write.partitionBy("nation").json(f"{folder}/lists")
    mark = F.when(F.col("nation") == 1, " ").otherwise("x")
    notes = customers.groupBy(nation).agg(F.count(F.lit(1)).cast("int").alias("n"))
    notes.select("nation", F.repeat(mark, F.col("n") - 1).alias("value")).write.partitionBy("nation").text(f"{folder}/notes")
    return folder


def _file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four kinds by what their names say, with the two filters of kinds."""
    listed = file_inventory(spark, _mixed_files(spark, sf_dir))
    kinds = profile.union_all(
        [_tagged(name, df) for name, df in (("all", listed), ("data", data_files(listed)), ("context", context_files(listed)))]
    )
    return kinds.groupBy(F.col("table_name").alias("filter"), "extension", "kind", "status", "detail").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") > 0).alias("with_content")
    )


def _inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files after reading them: sizes and errors."""
    found = inventory_summary(spark, _mixed_files(spark, sf_dir))
    return found.groupBy("Type", "Role", "Size", "Status", "Detail").agg(F.count(F.lit(1)).alias("files"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as JSON records, every third toxic value unknown."""
    labels = views.table(spark, sf_dir, "labels")
    return records(labels.withColumn("toxic", F.when(F.col("doc_id") % 3 != 0, F.col("toxic"))))


def _digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, digest): the digest adds up the first 32 bits of the SHA-256 of every row."""

    def of(name: str, df: DataFrame) -> DataFrame:
        shown = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(df.columns)])
        first = F.conv(F.substring(F.sha2(shown, 256), 1, 8), 16, 10).cast("bigint")
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum(first).alias("digest"))

    return profile.union_all([of(name, df) for name, df in sorted(tables.items())])


def _retail_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve tables of the catalog written as CSV, with gaps, and loaded with their declared types."""
    folder = scratch_folder(spark)
    for name, df in (views.retail(spark, sf_dir).present() | {"hubs": views.hubs(spark, sf_dir)}).items():
        gaps = {c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in df.columns}
        df.select([gaps[c].alias(f" {c} ") for c in df.columns]).write.option("header", True).csv(f"{folder}/{name}.csv")
    return _digests(load_retail_tables(spark, folder, "csv").present())


def _profiles(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [(t, profile.column_profile(views.table(spark, sf_dir, t))) for t in PROFILED]


def _tagged(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), "*")


def _column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.union_all([_tagged(t, p.drop("ordinal", "is_measure")) for t, p in _profiles(spark, sf_dir)])


def _candidate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.union_all(
        [_tagged(t, mapping.candidate_columns(p)) for t, p in _profiles(spark, sf_dir)]
    )


def _dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*PROFILED, "events", "conversations")
    frames = {t: views.table(spark, sf_dir, t) for t in names}
    frames["order_statuses"] = frames["orders"].select("o_custkey", "o_orderstatus")
    return profile.union_all([_tagged(t, profile.dataset_profile(df)) for t, df in frames.items()])


def _merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of a table sketched apart and united: exact where it is exact, else near enough?"""
    found = []
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        df = views.table(spark, sf_dir, name)
        batches = [written(sketches.sketched(df.where(F.col(key) % 2 == part))) for part in (0, 1)]
        estimated = sketches.sketched_profile(sketches.merged(*batches))
        exact = profile.column_profile(df).select("column_name", F.col("distinct_count").alias("exact"))
        near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * SKETCH_ERROR
        ordered = F.coalesce(F.col("quantile_25") <= F.col("quantile_75"), F.lit(True))
        shown = estimated.join(exact, "column_name").select(
            "column_name", "data_type", "row_count", "missing_count", "is_numeric", "is_datelike", "smallest", "largest",
            near.alias("distinct_is_near"), ordered.alias("quantiles_in_order"),
        )
        found.append(_tagged(name, shown))
    return profile.union_all(found)


def _stored_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of the sales and of the orders' keys, from the footers of a stored table."""
    folder = scratch_folder(spark)
    views.retail(spark, sf_dir).sales.select("order_date", "order_id").write.parquet(folder)
    return spark.createDataFrame([bounds(spark, folder, "order_date", "order_id").first()])


def _observed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range checks counted while the line items are written by day of shipping."""
    lines, observation = checks.observed_checks(views.table(spark, sf_dir, "lineitem"), _range_checks(), "ranges")
    written(lines.groupBy("l_shipdate").agg(F.sum("l_quantity").alias("quantity")))
    return checks.observed_rows(spark, observation)


def _as_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date as text in several forms, good and bad."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    mixed = (
        F.when(key % 10 == 0, F.lit("unknown"))
        .when(key % 3 == 0, F.date_format(day, "MM/dd/yyyy"))
        .when(key % 3 == 1, F.date_format(day, "yyyy/MM/dd"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    spoiled = F.when(key % 4 == 0, F.lit("n.a.")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", day.alias("real_date"), mixed.alias("mostly_dates"), spoiled.alias("too_few_dates"),
        "o_orderpriority",
    )


def _datelike(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = profile.column_profile(_as_text_dates(spark, sf_dir), distinct=None)
    return facts.select("column_name", "is_datelike")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    gaps = orders.select(
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("customer"),
        "o_orderstatus",
        "o_orderpriority",
    )
    scored = [("orders", orders), ("customers_with_gaps", gaps)]
    return profile.union_all(
        [
            _tagged(
                name,
                profile.data_quality_score(df).withColumn("notes", F.array_join("notes", " ")),
            )
            for name, df in scored
        ]
    )


def _suggested_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.suggested_mappings({t: views.table(spark, sf_dir, t) for t in MAPPED})


def _canonical_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical frame from text columns: dates and numbers that do not all convert."""
    source = views.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("soon"))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
        .alias("day"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("amount"),
        F.col("o_custkey").alias("client"),
        F.col("o_orderpriority").alias("priority"),
    )
    chosen = {"date": "day", "revenue": "amount", "customer": "client", "category": "priority"}
    return mapping.canonical_frame(source, chosen)


def _join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.candidate_join_keys(
        views.test_tables(spark, sf_dir) | views.retail(spark, sf_dir).present()
    )


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.retail(spark, sf_dir)
    orders, lines = (views.table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    return checks.all_checks(
        [
            checks.has_parent(t.sales, "product_id", t.products, "product_id", name="sales product"),
            checks.has_parent(t.sales, "store_id", t.stores, "store_id", name="sales store"),
            checks.has_parent(t.sales, "customer_id", t.customers, "customer_id", name="sales customer"),
            checks.has_parent(t.returns, "order_id", t.sales, "order_id", name="return order"),
            checks.has_parent(t.deliveries, "order_id", t.sales, "order_id", name="delivery order"),
            checks.has_parent(orders, "o_orderkey", lines, "l_orderkey", name="orders without lines"),
        ]
    )


def _unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.retail(spark, sf_dir)
    lines = views.table(spark, sf_dir, "lineitem")
    return checks.all_checks(
        [
            checks.unique_key(t.sales, "order_id", name="sales order_id"),
            checks.unique_key(t.returns, "return_id", name="returns return_id"),
            checks.unique_key(t.deliveries, "order_id", name="deliveries order_id"),
            checks.unique_key(lines, "l_orderkey", "l_linenumber", name="lineitem key"),
        ]
    )


def _one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.retail(spark, sf_dir)
    return checks.all_checks(
        [
            checks.exactly_one_child(t.sales, "order_id", t.deliveries, "order_id", name="sale delivery"),
            checks.exactly_one_child(t.deliveries, "order_id", t.sales, "order_id", name="delivery sale"),
        ]
    )


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.value_checks(views.table(spark, sf_dir, "lineitem"), _range_checks())


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").withColumn(
        "returned", F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("False")
    )
    return checks.flag_consistency(lines, "returned", F.col("l_linestatus") == "F", name="returned")


def _retail_evidence(t) -> DataFrame:
    """One row for each number of a record; a record without numbers has one without."""
    rows = finding_plans.findings_evidence(t)
    return rows.select("finding_id", "section", "entity", F.explode_outer("numbers").alias("number"))


def _findings(t) -> DataFrame:
    return finding_plans.findings(t, month=TARGET_MONTH).withColumn(
        "possible_drivers", F.array_join("possible_drivers", " | ")
    )


def _grounded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return grounding.numbers_grounded(documents, documents.drop("text"), "doc_id")


def _document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return grounding.text_numbers(documents, "doc_id", "text")


def _texts_and_evidence(check: Callable) -> Query:
    return lambda spark, sf_dir: check(
        views.statements(spark, sf_dir), views.statement_evidence(spark, sf_dir), "id"
    )


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.verified_text(
        views.statements(spark, sf_dir), views.statement_evidence(spark, sf_dir), "id", "text"
    )


def _period_comparison(t) -> DataFrame:
    return kpi.period_comparison(t, 365)


_BUILDERS: dict[str, Query] = {
    # fixed retail schema
    "sales_enriched": _retail(enrich.sales_enriched),
    "kpi_window": _retail(lambda t: kpi.kpi_for_window(t, *WINDOW)),
    "dataset_dates": _retail(lambda t: kpi.date_range(t.sales)),
    "period_comparison": _retail(_period_comparison),
    "growth_gap": _retail(kpi.growth_gap),
    "monthly_trend": _retail(kpi.monthly_trend),
    "breakdown_category": _retail(lambda t: breakdown.breakdown_by(t, "category")),
    "breakdown_brand": _retail(lambda t: breakdown.breakdown_by(t, "brand")),
    "breakdown_store": _retail(lambda t: breakdown.breakdown_by(t, "store")),
    "breakdown_region": _retail(lambda t: breakdown.breakdown_by(t, "region")),
    "breakdown_channel": _retail(lambda t: breakdown.breakdown_by(t, "channel", *WINDOW)),
    "breakdown_segment": _retail(lambda t: breakdown.breakdown_by(t, "customer_segment")),
    "breakdown_product_top10": _retail(lambda t: breakdown.breakdown_by(t, "product", top_n=10)),
    "store_team_performance": _retail(breakdown.store_team_performance),
    "segment_value": _retail(breakdown.segment_value),
    "return_analysis": _retail(returns.return_analysis),
    "return_reasons": _retail(lambda t: returns.return_reasons(t, "ECONOMY")),
    "return_rate_outliers": _retail(
        lambda t: stats.zscore_outliers(returns.return_analysis(t), "return_rate_pct", 1.2, "category")
    ),
    "delivery_performance": _retail(delivery.delivery_performance),
    "delivery_trend": _retail(lambda t: delivery.delivery_trend(t, "1-URGENT")),
    "delay_outliers": _retail(
        lambda t: stats.zscore_outliers(
            delivery.delivery_performance(t), "delayed_rate_pct", 1.2, "delivery_partner_id"
        )
    ),
    "campaign_roi": _retail(marketing.campaign_roi),
    "campaign_best_worst": _retail(marketing.best_and_worst_campaign),
    "stockout_hotspots": _retail(inventory.stockout_hotspots),
    "excess_hotspots": _retail(inventory.excess_hotspots),
    "inventory_imbalance": _retail(inventory.inventory_imbalance),
    "target_vs_actual": _retail(lambda t: targets.target_vs_actual(t, TARGET_MONTH)),
    "target_vs_actual_latest": _retail(targets.target_vs_actual),
    "findings": _retail(_findings),
    "findings_evidence": _retail(_retail_evidence),
    # any table
    "csv_scan": _csv_scan,
    "tsv_scan": _tsv_scan,
    "json_records": _json_records,
    "json_record_array": _json_record_array,
    "json_object": _json_object,
    "json_mixed_folder": _json_mixed_folder,
    "bad_rows": _bad_rows,
    "document_scan": _document_scan,
    "file_inventory": _file_inventory,
    "inventory_summary": _inventory_summary,
    "records": _records,
    "retail_csv_catalog": _retail_csv,
    "candidate_join_keys": _join_keys,
    "primary_table": lambda spark, sf_dir: discover.primary_table(views.test_tables(spark, sf_dir)),
    "column_profile": _column_profile,
    "dataset_profile": _dataset_profile,
    "datelike_columns": _datelike,
    "merged_profile": _merged_profile,
    "stored_date_range": _stored_date_range,
    "suggested_mapping": _suggested_mapping,
    "candidate_columns": _candidate_columns,
    "canonical_frame": _canonical_sums,
    "data_quality_score": _quality,
    "date_window": _user(generic.date_window),
    "user_kpi_summary": _user(generic.kpi_summary),
    "user_revenue_trend": _user(generic.revenue_trend),
    "user_weekly_trend": _user(lambda f: generic.revenue_trend(f, "W")),
    "period_change": _user(lambda f: stats.period_change(generic.revenue_trend(f))),
    "margin_trend": _user(lambda f: stats.margin_trend(generic.revenue_trend(f))),
    "user_growth": _user(generic.growth_comparison),
    "user_breakdown": _user(
        lambda f: generic.breakdown(f, "product").withColumn("label", shorten("product", 2))
    ),
    "margin_trade_off": _user(generic.margin_trade_off),
    "user_returns": _user(generic.returns_summary),
    "composition": _user(generic.composition),
    "value_histogram": _user(lambda f: stats.histogram(f, "revenue")),
    "value_spread": _user(generic.value_spread),
    "user_findings": _user(user_tables.user_findings),
    # questions and statements
    "question_intents": lambda spark, sf_dir: question_plans.label_questions(
        views.questions(spark, sf_dir)
    ).drop("question"),
    "question_answers": lambda spark, sf_dir: question_plans.answer_questions(
        views.retail(spark, sf_dir), views.questions(spark, sf_dir)
    ).drop("question"),
    "user_question_intents": lambda spark, sf_dir: user_tables.label_user_questions(
        views.questions(spark, sf_dir), views.user_frame(spark, sf_dir).columns
    ).drop("question"),
    "user_question_answers": lambda spark, sf_dir: user_tables.answer_user_questions(
        views.user_frame(spark, sf_dir), views.questions(spark, sf_dir)
    ).drop("question"),
    "document_numbers": _document_numbers,
    "document_grounding": _grounded_documents,
    "numeric_grounding": _texts_and_evidence(grounding.numbers_grounded),
    "entity_grounding": _texts_and_evidence(grounding.entities_grounded),
    "verified_text": _verified,
    # checks
    "unique_key_check": _unique_keys,
    "referential_orphans": _orphans,
    "one_to_one_check": _one_to_one,
    "range_checks": _ranges,
    "observed_checks": _observed_checks,
    "flag_consistency": _flags,
}


def _registered(build: Query) -> Query:
    return lambda spark, sf_dir: plain(build(spark, sf_dir))


QUERIES: dict[str, Query] = {name: _registered(build) for name, build in _BUILDERS.items()}
