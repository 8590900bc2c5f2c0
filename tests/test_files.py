"""Files: what is read, what is declined, and why."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallywise import fixed_values as fixed
from tallywise.operators.discover import candidate_join_keys, primary_table
from tallywise.sources import files, json_files

SALES = "order_id,customer_id,amount\n1,C1,100\n2,C2,250\n3,C1,75\n"
CUSTOMERS = "customer_id,name,segment\nC1,Ada,Retail\nC2,Bola,Wholesale\n"


def folder(tmp_path, **contents):
    for name, content in contents.items():
        stem, _, suffix = name.rpartition("_")
        data = content if isinstance(content, bytes) else content.encode()
        (tmp_path / f"{stem}.{suffix}").write_bytes(data)
    return str(tmp_path)


def by_name(spark, tmp_path, **contents):
    return {f.name: f for f in files.ingest(spark, folder(tmp_path, **contents)).files}


def test_delimited_json_and_documents_are_told_apart(spark, tmp_path):
    got = by_name(
        spark,
        tmp_path,
        sales_csv=SALES,
        data_tsv="a\tb\n1\t2\n3\t4\n",
        records_json=json.dumps([{"a": 1, "b": 2}, {"a": 3, "b": 4}]),
        notes_txt="Our revenue target is 10,000,000 this year.",
        brief_md="# Goals\n\nImprove margin.",
        chart_png=b"\x89PNG\r\n\x1a\n fake",
        demo_mp4=b"\x00\x00\x00 ftypmp42",
        thing_xyz="whatever",
        report_pdf=b"%PDF-1.4",
        empty_csv="a,b\n",
        blank_csv="",
        bad_json="{not valid json",
        blank_txt="  \n",
    )
    kinds = {name: (f.kind, f.status) for name, f in got.items()}
    assert kinds == {
        "sales.csv": ("data", "ready"),
        "data.tsv": ("data", "ready"),
        "records.json": ("data", "ready"),
        "notes.txt": ("context", "extracted"),
        "brief.md": ("context", "extracted"),
        "chart.png": ("unsupported", "declined"),
        "demo.mp4": ("unsupported", "declined"),
        "thing.xyz": ("unsupported", "declined"),
        "report.pdf": ("unsupported", "error"),
        "empty.csv": ("unsupported", "error"),
        "blank.csv": ("unsupported", "error"),
        "bad.json": ("unsupported", "error"),
        "blank.txt": ("unsupported", "error"),
    }
    assert "OCR" in got["chart.png"].detail
    assert "video" in got["demo.mp4"].detail.lower()
    assert got["notes.txt"].frame is None and "revenue target" in got["notes.txt"].text
    assert got["sales.csv"].frame.count() == 3
    assert got["data.tsv"].frame.columns == ["a", "b"]


def test_summary_counts_rows_and_characters(spark, tmp_path, rows):
    ingested = files.ingest(
        spark, folder(tmp_path, a_csv=SALES, b_txt="Context here.", c_png="x")
    )
    got = {r["File"]: (r["Type"], r["Role"], r["Size"], r["Status"]) for r in rows(ingested.summary())}
    assert got == {
        "a.csv": ("CSV", "Data", "3 rows", "Ready"),
        "b.txt": ("TXT", "Context", "13 chars", "Extracted"),
        "c.png": ("PNG", "—", "—", "Declined"),
    }
    assert [f.name for f in ingested.data_files()] == ["a.csv"]
    assert [f.name for f in ingested.context_files()] == ["b.txt"]


def test_types_missing_texts_and_blank_names(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(" n , x,flag ,code,when\n1,1.5,True,007a,2026-01-05\nNA,,false,b,n/a\n3,2e3,TRUE,c,x\n")
    df = files.read_csv(spark, str(path))
    assert df.dtypes == [
        ("n", "bigint"), ("x", "double"), ("flag", "boolean"), ("code", "string"), ("when", "string"),
    ]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "007a", "2026-01-05"), (None, None, False, "b", None), (3, 2000.0, True, "c", "x"),
    ]


def test_load_errors(spark, tmp_path):
    def write(name, content):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    with pytest.raises(files.DatasetError, match="no data rows"):
        files.read_csv(spark, write("header.csv", "col1,col2\n"))
    with pytest.raises(files.DatasetError, match="no columns"):
        files.read_csv(spark, write("nothing.csv", ""))
    with pytest.raises(files.DatasetError, match="3 rows"):
        files.read_csv(spark, write("long.csv", SALES), max_rows=2)
    assert files.read_csv(spark, write("fits.csv", SALES), max_rows=3).count() == 3


def test_json_shapes(spark, tmp_path, rows):
    def read(name, payload, **options):
        path = tmp_path / name
        path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
        df, detail = files.read_json(spark, str(path), **options)
        return rows(df), detail

    nested = [{"id": 1, "who": {"name": "Ada", "at": {"city": "Kano"}}, "tags": ["x"]}]
    assert read("list.json", nested) == (
        [{"id": 1, "tags": ["x"], "who_at_city": "Kano", "who_name": "Ada"}], "",
    )
    two = {"version": 1, "zeta": [{"z": 1}, {"z": 2}], "alpha": [{"a": 5}]}
    got, detail = read("object.json", two)
    assert got == [{"z": 1}, {"z": 2}] and "'zeta'" in detail
    got, detail = read("chosen.json", two, array_key="alpha")
    assert got == [{"a": 5}] and "'alpha'" in detail
    assert read("single.json", {"a": 1, "b": {"c": 2}})[0] == [{"a": 1, "b_c": 2}]
    with pytest.raises(files.DatasetError):
        read("number.json", "5")
    with pytest.raises(files.DatasetError):
        read("clash.json", [{"a_b": 1, "a": {"b": 2}}])


def test_documents_are_read_whole(spark, tmp_path):
    (tmp_path / "long.txt").write_text("é" * 30_000)
    whole = files.read_documents(spark, str(tmp_path)).first()
    assert whole.file == "long.txt" and len(whole.text) == 30_000
    assert len(files.read_documents(spark, str(tmp_path), max_chars=20_000).first().text) == 20_000


def test_shared_identifiers_are_candidates_only(spark, tmp_path, rows):
    ingested = files.ingest(
        spark, folder(tmp_path, sales_csv=SALES, customers_csv=CUSTOMERS, names_csv="name,paid\nx,1\n")
    )
    got = rows(candidate_join_keys(ingested.tables()))
    assert [(r["column_name"], r["tables"]) for r in got] == [("customer_id", "customers.csv, sales.csv")]
    assert "may be related" in got[0]["note"]


def test_primary_table_prefers_money_then_size(spark, tmp_path, rows):
    stock = "snapshot_date,store_id,opening_stock\n" + "2026-01-01,S1,10\n" * 200
    tables = files.ingest(spark, folder(tmp_path, inventory_csv=stock, sales_csv=SALES)).tables()
    assert rows(primary_table(tables))[0]["table_name"] == "sales.csv"
    equal = {
        "a": spark.createDataFrame([(1,), (2,)], "amount int"),
        "b": spark.range(30).select("id").withColumnRenamed("id", "amount"),
        "c": spark.range(30).withColumnRenamed("id", "amount"),
        "empty": spark.createDataFrame([], "amount int, day date"),
    }
    assert rows(primary_table(equal))[0]["table_name"] == "b"


def test_records(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert [json.loads(r["record"]) for r in rows(files.records(df))] == [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    assert files.records(df, 1).count() == 1


def test_json_files_of_several_shapes_in_one_folder(spark, tmp_path, rows):
    """The shape is told file by file; what cannot be read is kept aside, with its reason."""
    contents = dict(
        list_json=json.dumps([{"id": 1, "who": {"n": "x"}}, {"id": 2, "tags": ["q"]}], indent=1),
        around_json=json.dumps({"version": 1, "zeta": [{"id": 3}, {"id": 4}], "alpha": [{"a": 5}]}),
        lines_json='{"id":5,"v":1.5}\n\n{"id":6}\n{bad\n{"id":12345678901234567890123}',
        single_json='{"id": 7}',
        number_json="5",
        broken_json="{oops",
        mixed_json='[{"id":8}, 3]',
        twice_json='{"id": 1, "id": 2}',
        nothing_json=" \n",
    )
    path = folder(tmp_path, **contents)
    df, detail = files.read_json(spark, path, bad="leave_out")
    assert sorted(r["id"] for r in rows(df)) == [1, 2, 3, 4, 5, 6, 7, 8, 12345678901234567890123]
    assert dict(df.dtypes) == {"id": "decimal(38,0)", "tags": "array<string>", "v": "double", "who_n": "string"}
    assert "'zeta'" in detail
    bad = {(r["file"].rsplit("/", 1)[-1], r["row"], r["reason"]) for r in rows(json_files.bad_json(spark, path))}
    table = "JSON did not contain a table-like structure."
    assert bad == {
        ("lines.json", "{bad", "malformed JSON"), ("number.json", "5", table), ("broken.json", "{oops", "malformed JSON"),
        ("mixed.json", "3", "not an object"), ("twice.json", '{"id": 1, "id": 2}', "malformed JSON"),
    }
    with pytest.raises(files.DatasetError):
        files.read_json(spark, path)


def test_json_of_an_array_file_and_an_object_file(spark, tmp_path, rows):
    path = folder(tmp_path, a_json='[{"a": 1}, {"a": 2}]', b_json='{"a": 3}')
    assert sorted(r["a"] for r in rows(files.read_json(spark, path)[0])) == [1, 2, 3]


def test_json_lines_are_read_without_a_shuffle(spark, tmp_path):
    path = folder(tmp_path, a_json='{"a": 1}\n{"a": {"b": 2}}\n' * 50)
    df = files.read_json(spark, path)[0]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 100


def test_bad_rows_are_kept_beside_the_good_ones(spark, tmp_path, rows):
    text = 'n,t,d\n1,"a, ""b""\nc",2020-01-02\n2,x\nthree,y,2020-01-01\nNA,,n/a\n4,z,2020-01-01,5\n5,w,soon\n'
    path = folder(tmp_path, a_csv=text)
    schema = "n bigint, t string, d date"
    good = sorted(tuple(r.values()) for r in rows(files.read_good_rows(spark, path, schema).selectExpr("n", "t", "cast(d as string)")) if r["n"])
    assert good == [(1, 'a, "b"\nc', "2020-01-02")]
    assert files.read_good_rows(spark, path, schema).where("n is null").count() == 1
    bad = {(r["row"], r["reason"]) for r in rows(files.bad_rows(spark, path, schema))}
    assert bad == {
        ("2,x", "wrong number of cells"), ("4,z,2020-01-01,5", "wrong number of cells"),
        ('{"n":"three","t":"y","d":"2020-01-01"}', "a cell does not fit its type"),
        ('{"n":"5","t":"w","d":"soon"}', "a cell does not fit its type"),
    }


def test_documents_with_broken_bytes_and_odd_names(spark, tmp_path, rows):
    content = b"A\xffB\xe2\x82C \xc3\xa9\r\nend"
    (tmp_path / "a b+c%20.txt").write_bytes(content)
    (got,) = rows(files.read_documents(spark, str(tmp_path)))
    assert got == {"file": "a b+c%20.txt", "text": content.decode("utf-8", "replace")}


def test_inventory_in_one_plan(spark, tmp_path, rows):
    deep = tmp_path / "in" / "side"
    deep.mkdir(parents=True)
    for name, text in {
        "a.CSV": 'n,t\n1,"x\ny"\n2,z\n', "head.csv": "n,t\n", "b.tsv": "p\tq\n1\t2\n", "c.json": '{"k": [{"v": 1}, {"v": 2}]}',
        "bad.json": "{", "d.md": "# Été", "blank.txt": " \n", "e.png": "x", "f": "x", "g.pdf": "%PDF",
    }.items():
        (deep / name).write_text(text)
    (deep / "void.csv").write_bytes(b"")
    listed = files.file_inventory(spark, str(tmp_path))
    assert {r["file"] for r in rows(files.data_files(listed))} == {"a.CSV", "head.csv", "b.tsv", "c.json", "bad.json"}
    assert {r["file"] for r in rows(files.context_files(listed))} == {"d.md", "blank.txt"}
    got = {r["File"]: (r["Type"], r["Role"], r["Size"], r["Status"], r["Detail"]) for r in rows(files.inventory_summary(spark, str(tmp_path)))}
    assert got["a.CSV"] == ("CSV", "Data", "2 rows", "Ready", "")
    assert got["head.csv"] == ("CSV", "—", "—", "Error", "File contained no data rows.")
    assert got["b.tsv"] == ("TSV", "Data", "1 rows", "Ready", "")
    assert got["c.json"] == ("JSON", "Data", "2 rows", "Ready", "Used array under key 'k'.")
    assert got["bad.json"] == ("JSON", "—", "—", "Error", "Could not parse: malformed JSON")
    assert got["d.md"] == ("MD", "Context", "5 chars", "Extracted", "")
    assert got["blank.txt"] == ("TXT", "—", "—", "Error", "")
    assert got["e.png"][3] == "Declined" and got["f"][3] == "Declined" and got["g.pdf"][3] == "Error"
    ingested = {f.name for f in files.ingest(spark, str(tmp_path)).files}
    assert ingested == set(got) | {"void.csv"}


def test_files_without_open_lines_are_shared_by_tasks(spark, tmp_path, rows):
    plain = "n,t\n" + '1,"a, ""b"""\n2,c\n' * 50
    (tmp_path / "plain.csv").write_text(plain)
    (tmp_path / "broken.csv").write_text(plain + '3,"d\ne"\n')
    assert not files._has_open_lines(spark, str(tmp_path / "plain.csv"))
    assert files._has_open_lines(spark, str(tmp_path / "broken.csv"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        shared, alone = (files.read_csv(spark, str(tmp_path / n)) for n in ("plain.csv", "broken.csv"))
        assert shared.rdd.getNumPartitions() > 1 and alone.rdd.getNumPartitions() == 1
        assert shared.count() == 100 and {r["t"] for r in rows(shared)} == {'a, "b"', "c"}
        assert alone.count() == 101 and "d\ne" in {r["t"] for r in rows(alone)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n")
    assert [tuple(r.values()) for r in rows(files.read_csv(spark, str(tmp_path / "ragged.csv")))] == [(1, 2), (3, None)]


def test_a_whole_file_is_parsed_once_whatever_its_shape(spark, tmp_path):
    texts = {
        "list": '\n\t[{"a": 1}, 2, null, "{}", [{}], {"a": {"b": 3}}]', "empty": "[]", "broken list": '[{"a": 1}', "rows": '{"t": 0,\n"of": [{"a": 4}]}',
        "alone": ' {"a": 5}', "twice": '{"a": 1, "a": 2}', "broken": '{"a": ', "number": "7", "null": "null", "nothing": "{}",
        "no records": '{"of": [1, 2]}', "rows of empty": '{"of": []}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = json_files.json_records(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(row") == 1
    shown = found.select(F.regexp_replace("file", ".*/", ""), "key", F.to_json("record"), "row", "reason").collect()
    malformed, no_table, no_object = fixed.MALFORMED_REASON, fixed.NOT_A_TABLE_DETAIL, fixed.NOT_AN_OBJECT_REASON
    assert sorted(map(str, map(tuple, shown))) == sorted(map(str, [
        ("list", None, '{"a":1}', None, None), ("list", None, None, "2", no_object), ("list", None, None, "null", no_object),
        ("list", None, None, '"{}"', no_object), ("list", None, None, "[{}]", no_object), ("list", None, '{"a":{"b":3}}', None, None), ("broken%20list", None, None, texts["broken list"], malformed),
        ("rows", "of", '{"a":4}', None, None), ("alone", "", '{"a":5}', None, None), ("twice", None, None, texts["twice"], malformed),
        ("broken", None, None, texts["broken"], malformed), ("number", None, None, "7", no_table), ("null", None, None, "null", no_table),
        ("nothing", "", "{}", None, None), ("no%20records", "", '{"of":[1,2]}', None, None), ("rows%20of%20empty", "", '{"of":[]}', None, None),
    ]))
