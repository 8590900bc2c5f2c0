"""Collocations against a count of all phrases, and summaries too small for what they get."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from tallywise.llm import collocations as co
from tallywise.llm.oracles import ORACLE_SQL
from tallywise.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"

SCHEMA = "text string, lang string, g string, phrase string, n string"


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(co, "PARTS", 16)


def brute(rows, least=30, pct=80, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, g in rows:
        g = g or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[g, " ".join(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if " " in x[1] and a >= least}
    longer = collections.Counter()
    for (g, p), a in found.items():
        w = p.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = g, " ".join(w[i : i + k])
                longer[inner] = max(longer[inner], a)
    out = []
    for (g, p), a in found.items():
        if longer[g, p] and 100 * longer[g, p] >= pct * a:
            continue
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[g, " ".join(w[:k])], f[g, " ".join(w[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((g, -score, -a, p.encode(), left, right))
    rank, shown = collections.Counter(), []
    for g, score, a, p, left, right in sorted(out):
        rank[g] += 1
        if rank[g] <= top:
            shown.append((g, rank[g], p.decode(), -a, left, right, n[g], -score))
    return shown


def texts(seed=3):
    chance, rows = random.Random(seed), []
    words = ["Aa", "b", "ç", "d\x1ce", "f'", "NEW", "York", "the", "of", "x" * 300]
    for i in range(900):
        drawn = chance.choices(words, [9, 9, 2, 1, 1, 5, 5, 9, 9, 1], k=chance.randrange(60))
        text = "".join(w + chance.choice(["  ", " ", " ", " ", "\t", ". ", ",", "\r\n", "\x0b", "\x1f ", "  "]) for w in drawn)
        rows.append((text, ["en", "de", None, "und"][i % 4], "g", "p", "n"))
    rows += [(None, "en", "g", "p", "n"), ("", "fr", "g", "p", "n"), (" . ,", None, "g", "p", "n"), ("the of " * 40_000, "en", "g", "p", "n")]
    return rows + rows[:30]


def found(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


def test_equals_a_count_of_all_phrases(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted(brute([r[:2] for r in rows]))
    assert len(want) > 30 and found(df) == want
    assert found(df, least=3, contained_pct=60, top=20) == sorted(brute([r[:2] for r in rows], 3, 60, 20))
    assert co.collocations(df).columns == ["g", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(df.where("false")) == []


def test_small_summaries_and_filters_change_nothing(spark, monkeypatch):
    """Summaries that have to give up counters, and a bit set that lets everything through."""
    rows = texts(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = sorted(brute([r[:2] for r in rows]))
    monkeypatch.setattr(co, "PARTS", 1)
    monkeypatch.setattr(co, "SPARSE", 1)
    assert found(df, counters=300, most=15) == want
    monkeypatch.setattr(co, "HELD", 50)
    assert found(df, counters=2) == want


def test_a_summary_keeps_its_promise():
    chance = np.random.default_rng(1)
    for counters in (5, 20, 100):
        hashes = chance.zipf(1.3, 20_000) % 500
        summary, true = co.Summary(counters), collections.Counter(hashes.tolist())
        for part in np.array_split(hashes.astype(np.int64), 40):
            summary.add(*np.unique(part, return_counts=True))
        summary.fold()
        held = dict(zip(summary.hashes.tolist(), summary.counts.tolist()))
        assert len(held) <= counters and summary.lost * counters < len(hashes)
        assert all(held.get(h, 0) <= n <= held.get(h, 0) + summary.lost for h, n in true.items())
        assert {h for h, n in true.items() if n * counters >= len(hashes)} <= set(held)


def test_scores_beyond_64_bits(spark, monkeypatch):
    """2,000,000 times a count of 10^13 passes 64 bits."""
    words, longer = [("en", "a", 9 * 10**12), ("en", "b", 7 * 10**12)], [("en", "a b", 6 * 10**12)]
    held = [spark.createDataFrame(x, "g string, phrase string, n long") for x in (words, longer)]
    monkeypatch.setattr(co, "phrase_counts", lambda *_: held)
    (row,) = found(spark.createDataFrame([], SCHEMA))
    assert row == ("en", 1, "a b", 6 * 10**12, 9 * 10**12, 7 * 10**12, 16 * 10**12, 2_000_000 * 6 // 16)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(ORACLE_SQL["op13_collocations"])
    names = [d[0] for d in want.description]
    got = QUERIES["op13_collocations"](spark, DATA)
    rows = sorted(want.fetchall())
    assert rows and sorted(tuple(r[n] for n in names) for r in got.collect()) == rows
    assert sorted(got.columns) == sorted(names)


@pytest.mark.parametrize("text", ["", "a", "a.b", "\xff a", ". .", "a\tb C"])
def test_words_and_ends_of_pieces(text):
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["x"]), pa.array([text])], ["g", "text"])
    pieces = [re.findall("[^\x20\x09]+", p.lower()) for p in re.split("[.,;:!?\x0a-\x0d]", text)]
    got = [t for _, tokens in co.words_of(batch) for t in tokens if t != co.BOUND]
    assert got == [w.encode() for p in pieces for w in p]
