"""Inputs that must not lose or change a value on the way in."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark.sql import functions as F

from tallywise.functions.dates import parse_date
from tallywise.functions.numbers import round_as_printed
from tallywise.operators import discover, grounding, stats
from tallywise.sources import files
from tallywise.sources.retail import load_retail_tables


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_quoted_cells(spark, tmp_path, rows):
    text = 'id,note,amount\n1,"He said ""hi, there"" ok",5\n2,"C:\\dir\\",6\n3,"two\nlines",7\n'
    got = rows(files.read_csv(spark, written(tmp_path, "a.csv", text)))
    assert got == [
        {"id": 1, "note": 'He said "hi, there" ok', "amount": 5},
        {"id": 2, "note": "C:\\dir\\", "amount": 6},
        {"id": 3, "note": "two\nlines", "amount": 7},
    ]


def test_a_broken_row_of_a_shared_file_is_an_error(spark, tmp_path):
    path = written(tmp_path, "a.csv", 'id,note,amount\n3,"two\nlines",7\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, path, multi_line=False).collect()


def test_long_whole_numbers_keep_their_digits(spark, tmp_path):
    text = "a,b,c\n1234567890123456781,12345678901234567890,{0}\n1234567890123456782,2,{0}\n".format("9" * 40)
    df = files.read_csv(spark, written(tmp_path, "a.csv", text))
    assert dict(df.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "string"}
    assert [r.a for r in df.collect()] == [1234567890123456781, 1234567890123456782]


def test_json_lines_give_a_row_per_line(spark, tmp_path, rows):
    text = "\n".join(json.dumps({"a": i, "b": {"c": str(i)}}) for i in range(3)) + "\n"
    df, note = files.read_json(spark, written(tmp_path, "a.json", text))
    assert rows(df) == [{"a": i, "b_c": str(i)} for i in range(3)] and note == ""


def test_missing_texts_of_a_retail_table(spark, tmp_path, rows):
    header = "order_id,order_date,store_id,delivery_partner_id,promised_days,actual_days,delivery_status,delivery_rating"
    written(tmp_path, "deliveries.csv", f"{header}\n1,2026-01-01,S1,P1,5,NA,Delayed,nan\n")
    (got,) = rows(load_retail_tables(spark, str(tmp_path), "csv", only=("deliveries",)).deliveries)
    assert (got["promised_days"], got["actual_days"], got["delivery_rating"]) == (5, None, None)


def test_names_of_documents_are_decoded(spark, tmp_path):
    written(tmp_path, "my notes+1.md", "text")
    assert [r.file for r in files.read_documents(spark, str(tmp_path)).collect()] == ["my notes+1.md"]


def test_inventory_knows_what_cannot_be_read(spark, tmp_path):
    for name in ("a.pdf", "b.xlsx", "c.csv", "d.txt"):
        written(tmp_path, name, "x")
    got = {r.file: (r.kind, r.status) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {
        "a.pdf": ("unsupported", "error"),
        "b.xlsx": ("unsupported", "error"),
        "c.csv": ("data", "ready"),
        "d.txt": ("context", "extracted"),
    }


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("2026-01-01 10:00:00.123456 America/Argentina/Buenos_Aires", "2026-01-01"),
        ("12/31/2025 5:07 PM", "2025-12-31 17:07"),
        ("31/12/2025 5:07 am", "2025-12-31 05:07"),
        ("31.12.2025", "2025-12-31"),
        ("Wed, 31 Dec 2025", "2025-12-31"),
        ("Sunday 2026-02-01", "2026-02-01"),
        ("Monty 31 Dec 2025", None),
        ("31.13.2025", None),
    ],
)
def test_forms_of_dates(spark, text, shown):
    got = spark.createDataFrame([(text,)], "t string").select(parse_date("t").cast("string").alias("d")).first().d
    assert got is None if shown is None else got.startswith(shown)


def test_halves_of_large_numbers(spark):
    df = spark.createDataFrame([(4000000000000000.5,), (float(2**60),)], "x double")
    assert [r.r for r in df.select(round_as_printed("x", 0).alias("r")).collect()] == [4e15, float(2**60)]


def test_huge_numbers_are_grounded_in_themselves(spark):
    huge = 1.5 * 10**301
    texts = spark.createDataFrame([(1, f"{huge:.0f}"), (2, "7" * 290)], "id int, text string")
    evidence = spark.createDataFrame([(1, huge), (2, 1.0)], "id int, n double")
    got = {r.id: r.numbers_grounded for r in grounding.numbers_grounded(texts, evidence, "id").collect()}
    assert got == {1: True, 2: False}
    assert grounding._LARGEST == sys.float_info.max


def test_an_empty_name_is_not_mentioned(spark):
    texts = spark.createDataFrame([(1, "North sold 55.5")], "id int, text string")
    evidence = spark.createDataFrame([(1, "North", 55.5), (1, "", 77.5)], "id int, region string, n double")
    assert grounding.entities_grounded(texts, evidence, "id").first().entities_grounded


def test_repeated_and_unknown_ids_keep_their_rows(spark):
    rows = [(1, "has 55.5", "t1"), (1, "has 66.6", "t2"), (None, "has 55.5", "t3"), (None, "no number", "t4")]
    texts = spark.createDataFrame(rows, "id int, candidate string, template string")
    evidence = spark.createDataFrame([(1, 55.5)], "id int, n double")
    got = grounding.verified_text(texts, evidence, "id").collect()
    assert sorted((r.text, r.text_source) for r in got) == [
        ("has 55.5", "candidate"),
        ("no number", "candidate"),
        ("t2", "template"),
        ("t3", "template"),
    ]


def test_a_period_after_zero_stays(spark):
    trend = spark.createDataFrame([("2026-01", 5.0), ("2026-02", 0.0), ("2026-03", 4.0)], "period string, revenue double")
    got = [(r.period, r.change_pct) for r in stats.period_change(trend).collect()]
    assert got == [("2026-02", -100.0), ("2026-03", None)]


def test_nothing_to_discover(spark):
    assert discover.primary_table({}).collect() == []
    plain = spark.createDataFrame([(1,)], "a int").select(F.col("a"))
    assert discover.candidate_join_keys({"t": plain}).collect() == []
