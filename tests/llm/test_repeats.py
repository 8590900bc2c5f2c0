"""Removal of repeated passages against brute force over all windows."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

from tallywise.llm import repeats

SCHEMA = "doc_id long, text string, keys string, twice string"


def brute(rows, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def documents(seed=1):
    rng = np.random.default_rng(seed)

    def text(n, vocabulary=5000):
        return [f"w{x}" for x in rng.integers(0, vocabulary, n)]

    passage, long_passage, edge, short = text(60), text(700), text(35), text(34)
    rows = []
    for i in range(40):
        own = text(int(rng.integers(0, 300)), 6 if i % 7 == 0 else 5000)
        for p in (passage, long_passage, edge, short):
            if rng.random() < 0.3:
                at = int(rng.integers(0, len(own) + 1))
                own[at:at] = p
        if i % 5 == 0:
            own = [w for w in own for _ in range(int(rng.integers(1, 4)))]
        rows.append((i, " ".join(own)))
    near = long_passage[:]
    near[300], near[340], near[380] = "x", "y", "z"
    rows += [(100, " ".join(near)), (101, "a " * 200), (102, "a\tb\n" * 90), (103, None), (104, ""), (105, " \x0b\x0c ")]
    rows += [(106, rows[3][1]), (106, rows[3][1]), (None, rows[4][1]), (107, " ".join(text(50))), (108, " ".join(text(20000)))]
    once = text(80)
    rows += [(109, " ".join(once + ["mid"] + once)), (110, " ".join(edge)), (111, " ".join(short))]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(5)
    got = repeats.without_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted(map(repr, map(tuple, got)))


def test_equal_to_all_windows(spark):
    rows = documents()
    assert run(spark, rows) == sorted(map(repr, brute(rows)))


def test_small_tasks_give_the_same(spark, monkeypatch):
    rows = documents(2)
    monkeypatch.setattr(repeats, "CHARS_AT_ONCE", 400)
    assert run(spark, rows) == sorted(map(repr, brute(rows)))


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(9)
    for vocabulary in (2, 3, 40, 10_000):
        for _ in range(200):
            inner = rng.integers(0, vocabulary, 35)
            marks = []
            for _ in range(2):
                before, after = (rng.integers(0, vocabulary, rng.integers(0, 30)) for _ in range(2))
                words = repeats.mixed(np.concatenate((before, inner, after)).astype(np.uint64) + np.uint64(1))
                at = repeats.anchors(words) - len(before)
                marks.append(set(at[(at >= repeats.BEFORE) & (at <= 35 - repeats.AFTER)].tolist()))
            assert marks[0] & marks[1]


def test_empty_table(spark):
    assert run(spark, []) == []
