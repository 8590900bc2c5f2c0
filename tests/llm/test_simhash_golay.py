"""SimHash near-duplicates against brute force over all pairs of small tables."""

from __future__ import annotations

import numpy as np
import xxhash

from tallywise.llm import simhash_golay as sg

SCHEMA = "doc_id long, text string, component_id string, key string"


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", lowered)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def documents():
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 300)) for _ in range(12)]
    rows = []
    for b in base:
        words = b.split()
        for _ in range(6):
            changed = list(words)
            for _ in range(rng.integers(0, 4)):
                changed[rng.integers(0, len(changed))] = "Changed"
            rows.append((len(rows), " ".join(changed)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (None, base[0]), (905, "É é"), (0, base[3])]
    rows += [(906, "a b c"), (906, "a b c"), (907, "x " * 20_000)]
    return rows


def test_equal_to_all_pairs(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = sorted(map(repr, [tuple(r) for r in sg.near_duplicates(df).drop("text_hash", "first_hash").collect()]))
    assert got == sorted(map(repr, brute_components(rows)))


def test_large_buckets_are_cut_into_blocks(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    got = sg.near_duplicates(df, bucket_limit=3).drop("text_hash", "first_hash").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_components(rows)))


def test_links_of_random_fingerprints_at_every_distance(spark):
    rng = np.random.default_rng(11)
    pairs = []
    for _ in range(400):
        a = int(rng.integers(0, 1 << 63))
        flips = rng.choice(64, 4, replace=False)
        pairs.append((a, a ^ sum(1 << int(b) for b in flips)))
    values = np.array([x for p in pairs for x in p], np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    links = {frozenset((r.a, r.b)) for r in sg.fingerprint_links(df).collect()}
    for a, b in zip(values[::2].tolist(), values[1::2].tolist()):
        assert frozenset((a, b)) in links


def test_codewords_of_near_words_meet():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000)
    for flips in ((0,), (4, 19), (22,), (7, 8)):
        other = words ^ sum(1 << b for b in flips)
        a, b = sg.codewords(words), sg.codewords(other)
        assert all((set(x) & set(y)) - {-1} for x, y in zip(a.tolist(), b.tolist()))
        if len(flips) == 1:
            assert all(y[0] in x for x, y in zip(a.tolist(), b.tolist()))


def test_one_row_of_each_group_stays(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    kept = sg.without_near_duplicates(df)
    assert kept.columns == df.columns
    components = brute_components(rows)
    assert kept.count() == len({c for _, _, c in components}) + 1  # two groups have a row of id 0
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in components}


def test_empty_table(spark):
    assert sg.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert sg.without_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
