"""Numbers and names in texts against evidence, also by brute force."""

from __future__ import annotations

import random
import re

import pytest

from tallywise.functions.numbers import round_as_printed, show
from tallywise.functions.texts import numbers_in
from tallywise.operators import grounding


def extracted(text):
    return {round(float(t.replace(",", "")), 1) for t in re.findall(r"(?<!\d)-?\d[\d,]*\.?\d*", text)}


def check_numbers(spark, evidence, text):
    texts = spark.createDataFrame([(1, text)], "id int, text string")
    return grounding.numbers_grounded(texts, evidence, "id").first().numbers_grounded


def test_numbers_in_text(spark):
    texts = ["2026-06 and -4.6%", "1,234,567.89x", "DP04", "5.", "a1b22,c", "", "-,5", "3.25 2.75 0.35 -0.04", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", numbers_in("t").alias("n")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
        else:
            assert set(got[i]) == extracted(t), t


def test_a_zero_is_one_number_whatever_its_sign(spark):
    df = spark.createDataFrame([(-0.03, False, "-0.04 of 0"), (2.0, False, "")], "z double, b boolean, t string")
    got = df.select(grounding.record_numbers(df).alias("all"), numbers_in("t").alias("said"), round_as_printed("z", 1).alias("z"))
    assert [(str(r["all"]), str(r.said)) for r in got.collect()] == [("[0.0]", "[0.0]"), ("[2.0, 0.0]", "[]")]
    assert str(got.first().z) == "0.0"


def test_printing_agrees_with_the_stored_value(spark):
    rng = random.Random(3)
    values = [rng.randint(-10**7, 10**7) / d for d in (40, 100, 1000) for _ in range(300)]
    values += [0.35, 2.65, 0.25, 34.05, 1.005, -0.04, 0.0, 1e14 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select(
        "x",
        round_as_printed("x", 1).alias("rounded"),
        show("x", 1, signed=True).alias("signed"),
        show("x", 2, grouped=True).alias("grouped"),
    ).collect():
        assert (r.rounded, r.signed, r.grouped) == (round(r.x, 1), f"{r.x:+.1f}", f"{r.x:,.2f}")


@pytest.mark.parametrize(
    ("text", "sound"),
    [
        ("Revenue grew 63.2% while gross profit grew 53.8%.", True),
        ("Revenue grew 72% while profit grew 53.8%, a margin move of -1.45pp.", False),
        ("It went from 63.7 to 54.", True),
        ("No figures here.", True),
        ("7 of 12 stores are at 100% of target, 0 lost.", True),
        ("-7 and -13", False),
        ("12.4 is not a whole number", False),
    ],
)
def test_numbers_against_rates(spark, text, sound):
    evidence = spark.createDataFrame(
        [(1, 63.2, 53.8, -1.45)], "id int, revenue_pct double, gross_profit_pct double, margin_pp double"
    )
    assert check_numbers(spark, evidence, text) is sound


def test_amounts_tolerate_one_percent(spark):
    evidence = spark.createDataFrame([(1, 38000, 255000.0)], "id int, spend int, revenue double")
    assert check_numbers(spark, evidence, "spent 38,000.00 to earn 252,450")
    assert not check_numbers(spark, evidence, "spent 38,000.00 to earn 252,400")
    assert not check_numbers(spark, evidence, "spent 38,000.00 to generate 400,000.00 in revenue.")


def test_evidence_of_any_type(spark):
    evidence = spark.sql(
        """SELECT 1 AS id, '2026-06 via DP44' AS label, true AS flag, date'2031-01-02' AS day,
        array(struct(777.7D AS a, array(888) AS b)) AS nested, map('k999', 666.6D) AS m, null AS empty"""
    )
    for supported in ("2026", "44", "2031", "777.7", "888", "666.6", "1"):
        assert check_numbers(spark, evidence, f"it is {supported}"), supported
    assert not check_numbers(spark, evidence, "field names do not count: 999")


def brute_numbers(text, evidence):
    def supported(n):
        near = any(abs(n - g) <= max(0.5, abs(g) * 0.01) for g in evidence)
        return near or (abs(n) <= 12 and n == int(n)) or n in (0.0, 100.0)

    return all(supported(n) for n in extracted(text))


def test_numbers_by_brute_force(spark):
    rng = random.Random(11)

    def value():
        kind = rng.random()
        size = 10 ** rng.uniform(0, 6) if kind < 0.7 else rng.uniform(0, 60)
        return round(size * rng.choice([1, 1, 1, -1]), rng.choice([0, 1, 2]))

    evidence = {i: [value() for _ in range(rng.randint(0, 12))] for i in range(400)}
    texts = {}
    for i, known in evidence.items():
        said = []
        for _ in range(rng.randint(0, 3)):
            if known and rng.random() < 0.9:
                g = rng.choice(known)
                shift = rng.choice([0, 0.4, 0.5, 0.6, abs(g) * 0.0099, abs(g) * 0.01, abs(g) * 0.0102])
                said.append(round(g + rng.choice([-1, 1]) * shift, 1))
            else:
                said.append(value())
        texts[i] = " then ".join(f"{n:,.1f}" for n in said)
    text_df = spark.createDataFrame(list(texts.items()), "id int, text string")
    rows = [(i, float(g)) for i, known in evidence.items() for g in known]
    evidence_df = spark.createDataFrame(rows, "id int, g double")
    got = {r.id: r.numbers_grounded for r in grounding.numbers_grounded(text_df, evidence_df, "id").collect()}
    want = {i: brute_numbers(t, [round(g, 1) for g in evidence[i]]) for i, t in texts.items()}
    assert got == want
    assert 50 < sum(want.values()) < 350


def brute_entities(text, records):
    numbers = {}
    for name, *values in records:
        numbers.setdefault(name, set()).update(round(v, 1) for v in values if v is not None)
    mentioned = [n for n in numbers if n in text]
    for name in mentioned:
        others = set().union(*[v for n, v in numbers.items() if n != name])
        if any(n in others and n not in numbers[name] for n in extracted(text)):
            return False
    return True


def test_swapped_names(spark):
    evidence = spark.createDataFrame(
        [(1, "Urban", 34.0), (1, "Swift", 6.87), (2, "Urban", 34.0)],
        "id int, partner_name string, delayed_rate_pct double",
    )

    def sound(id_, text):
        texts = spark.createDataFrame([(id_, text)], "id int, text string")
        return grounding.entities_grounded(texts, evidence, "id").first().entities_grounded

    assert not sound(1, "Swift has a 34.0% delayed-delivery rate, the worst in the network.")
    assert sound(1, "Urban has a 34.0% delayed-delivery rate, the worst in the network.")
    assert sound(1, "34.0% are late.") and sound(1, "Swift is fine.") and sound(3, "Swift 34.0")
    assert sound(2, "Swift has a 34.0% rate.")


def test_entities_by_brute_force(spark):
    rng = random.Random(5)
    names = ["Ada", "Bo", "Cy", "Bola"]
    records, texts = {}, {}
    for i in range(300):
        records[i] = [
            (rng.choice(names), float(rng.randint(1, 6)), rng.choice([None, rng.randint(10, 30) / 10]))
            for _ in range(rng.randint(0, 6))
        ]
        said = rng.sample(names, rng.randint(0, 3)) + [str(rng.randint(10, 60) // 2 / 5) for _ in range(rng.randint(0, 2))]
        texts[i] = " ".join(said)
    text_df = spark.createDataFrame(list(texts.items()), "id int, text string")
    flat = [(i, *r) for i, rs in records.items() for r in rs]
    evidence = spark.createDataFrame(flat, "id int, store_name string, a double, b double")
    got = {r.id: r.entities_grounded for r in grounding.entities_grounded(text_df, evidence, "id").collect()}
    want = {i: brute_entities(t, records[i]) for i, t in texts.items()}
    assert got == want
    assert 50 < sum(want.values()) < 290


def test_first_entity_field_names_a_record(spark):
    evidence = spark.createDataFrame(
        [(1, "North", "Urban", 5), (1, "South", None, 6)], "id int, region string, partner_name string, n int"
    )
    got = evidence.select(grounding.record_entity(evidence).alias("e")).collect()
    assert [r.e for r in got] == ["Urban", "South"]


def test_verified_text(spark):
    evidence = spark.createDataFrame([(1, "Urban", 34.0), (2, "Urban", 34.0)], "id int, partner_name string, rate double")
    texts = spark.createDataFrame(
        [(1, "Urban is late in 34% of cases", "T1"), (2, "Urban is late in 90% of cases", "T2"), (3, "", "T3"), (4, None, "T4")],
        "id int, candidate string, template string",
    )
    got = {r.id: (r.text, r.text_source) for r in grounding.verified_text(texts, evidence, "id").collect()}
    assert got == {
        1: ("Urban is late in 34% of cases", "candidate"),
        2: ("T2", "template"),
        3: ("T3", "template"),
        4: ("T4", "template"),
    }


def test_nothing_read_from_texts_is_sent_through_the_driver(spark):
    evidence = spark.sql("SELECT id, 'Urban' AS partner_name, id + 0.5D AS rate FROM range(9)")  # of a known, small size
    texts = spark.sql("SELECT id, concat('Urban is late in ', id) AS candidate, 'T1' AS template FROM range(9)")
    plans = [
        grounding.numbers_grounded(texts, evidence, "id", "candidate"),
        grounding.entities_grounded(texts, evidence, "id", "candidate"),
        grounding.verified_text(texts, evidence, "id"),
    ]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_names_of_one_text_and_zeros_of_either_sign(spark):
    evidence = spark.createDataFrame(
        [(1, f"Store {i}", float(i), -0.04) for i in range(300)] + [(1, "", 7.0, 0.0), (1, None, 8.0, 0.0)],
        "id int, store_name string, sold double, margin double",
    )
    said = ["Store 12 sold 12", "Store 12 sold 13", "Store 12 and Store 13", "the margin of Store 5 is 0.0", None]
    got = []
    for text in said:
        texts = spark.createDataFrame([(1, text)], "id int, text string")
        got.append(grounding.entities_grounded(texts, evidence, "id").first().entities_grounded)
    # "Store 1" is mentioned wherever "Store 12" is, and 12 is not its own number
    assert got == [brute_entities(t or "", [tuple(r)[1:] for r in evidence.collect() if r.store_name]) for t in said]
