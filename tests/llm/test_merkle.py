"""The manifest against a tree built from sorted lists, and rank queries against counting."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import merkle
from tallywise.llm.oracles import ORACLE_SQL
from tallywise.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, pos string, part string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fan_out):
    """Levels from the nodes up to the one left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + fan_out])) for i in range(0, len(below), fan_out)])
    return levels


def way(levels, at, fan_out):
    for below in levels[:-1]:
        first = at // fan_out * fan_out
        yield at - first, below[first : first + fan_out]
        at //= fan_out


def brute(rows, fan_out=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row[:5]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[g]], fan_out))
    top = tree([t[-1][0] for t in trees], fan_out)
    out = []
    for at, g in enumerate(order):
        for pos, (doc_id, own, row) in enumerate(groups[g]):
            steps = [*way(trees[at], pos, fan_out), *way(top, at, fan_out)]
            folded = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                folded = leaf((*row[:3], None if row[3] is None else row[3] + 1, row[4]))
            for place, run in steps:
                folded = digest("".join([*run[:place], folded, *run[place + 1 :]]))
            proof = digest("".join(x for place, run in steps for i, x in enumerate(run) if i != place))
            root = top[-1][0]
            out.append((doc_id, own, trees[at][-1][0], root, proof, folded, folded == root))
    return sorted(map(repr, out))


def checked(df, fan_out=2):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.leaves(df, FIELDS, "doc_id", "lang", {"n_chars": F.col("n_chars") + 1}, chosen)
    found = merkle.manifest(rows, fan_out).checked()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(repr(tuple(r[n] for n in names)) for r in found.collect())


def rows_of_all_kinds():
    chance, rows = random.Random(5), []
    for i in range(400):
        far = chance.choice([i, i, -i * 70_000, i * 10**13, 2**63 - 1 - i, -(2**63) + i])
        rows.append((far, f"s{i % 3}", chance.choice(["en", "en", "é", "z/1", None]), chance.choice([i, None]), "t" * (i % 9), "g", "p", "x"))
    rows += [(None, None, "en", i % 5, None if i % 2 else "", "g", "p", "x") for i in range(40)]
    rows += [(7, "hot", "en", i % 30, "same id", "g", "p", "x") for i in range(90)]
    rows += [(1, "alone", "fr", 1, "é", "g", "p", "x"), (2, "a", "", None, None, "g", "p", "x")]
    return rows + rows[:20] + rows[:5]


@pytest.mark.parametrize("fan_out", [2, 3])
def test_equals_a_tree_of_sorted_lists(spark, monkeypatch, fan_out):
    """Blocks of few slots, so that several rounds are needed; null, repeated and far ids."""
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = rows_of_all_kinds()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert checked(df, fan_out) == brute(rows, fan_out)


def test_one_row_and_none(spark):
    rows = [(3, None, None, None, None, "g", "p", "x")]
    assert checked(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert checked(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError, match="nodes"):
        merkle.manifest(merkle.leaves(spark.createDataFrame([], SCHEMA), FIELDS, "doc_id", "lang"), 1)


def test_rank_queries_count_what_is_before():
    chance = np.random.default_rng(2)
    for size in (1, 50, 4095, 4096, 30_000, 65_536):
        low = np.sort(chance.choice(1 << 16, size, replace=False))
        n = np.where(chance.random(size) < 0.1, chance.integers(2, 10**12, size), 1)
        shuffled = chance.permutation(size)
        container = merkle.packed(low[shuffled], n[shuffled])
        assert container[0] == (size >= merkle.FEW)
        again = merkle.opened(*container)
        assert (again[0] == low).all() and (again[1] == n).all()
        assert (merkle.Directory(*container).rank(low) == np.cumsum(n) - n).all()


def test_ranks_over_far_keys(spark):
    chance = random.Random(1)
    keys = {("a", chance.randrange(-(2**63), 2**63)) for _ in range(300)} | {("b", k) for k in range(70_000, 0, -7)}
    keys |= {("a", k) for k in range(-5, 5)}
    rows = [(p, k, 1 + k % 3) for p, k in keys]
    df = spark.createDataFrame(rows, "part string, key long, n long")
    got = {(r.part, r.key): r.before for r in merkle.ranks(df, merkle.bitmap_index(df)).collect()}
    want, total = {}, {}
    for p, k, n in sorted(rows):
        want[p, k] = total.get(p, 0)
        total[p] = want[p, k] + n
    assert got == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(ORACLE_SQL["op11_merkle_manifest"])
    names = [d[0] for d in want.description]
    got = QUERIES["op11_merkle_manifest"](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(repr, want.fetchall()))
    assert rows and sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == rows
