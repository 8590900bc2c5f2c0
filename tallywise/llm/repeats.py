"""Removal of word sequences that stand anywhere else, found by anchors (minimisers).

This is not recompression over several rounds: one local pass orders the places of a text, and the
place of the least name is an anchor. The pass names runs of two equal words and then pairs of
neighbours of which the first is in the left and the second in the right half of all symbols. A name
is a hash of what it stands for, so all tasks give equal runs and pairs the same name and no table of
names has to travel. Whether two neighbours are joined depends on them and their next neighbours
only. So two equal passages get equal symbols except for at most EDGE words at either end, and a
symbol covers at most EDGE words. A window of 35 words has room for one
round only, if the symbols in its middle are to be certain.

Among the symbols that begin in a stretch of STRETCH words, that of the least name is an anchor. Its
high-level symbol is a plain hash of the BEFORE + AFTER words around it. Every window of 35 words holds a
whole stretch with enough space on both sides, so if a window stands elsewhere, its anchor has the
same high-level symbol there. The steps are

1. every document: anchors and their symbols; symbols that occur twice anywhere are shared,
2. documents with shared symbols: the hashes (96 bits) of the 35-word windows around them,
3. windows that occur twice anywhere: their words are removed.

Symbols and windows that repeat within one task are recognised there and sent on once, so a very
common line or passage travels as one row for each task. Of documents with equal words only one
sends its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallywise.llm.common import (
    WORDS,
    chunks,
    covered,
    join_documents,
    mixed,
    plain_texts,
    stored,
    text_key,
    window_hashes,
)

WIDTH = 35
EDGE = 4  # words at the end of a window whose symbols may differ: 2 for runs and 2 for pairs of them
BEFORE, AFTER = 4, 10
STRETCH = WIDTH - BEFORE - AFTER + 1
NAME_PAIR, NAME_RUN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
GAP = np.uint64(0)  # follows the last symbol
CHARS_AT_ONCE = 4_000_000


def symbols(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of the symbols of a sequence of word hashes after a round of runs and pairs."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    same = np.concatenate(([False], words[1:] == words[:-1], [False]))  # same as the word before
    doubled = ~same[:-1] & same[1:]  # begins a run ...
    doubled[:-1] &= ~same[2:]  # ... of exactly two
    begins = np.concatenate(([True], ~doubled[:-1]))
    at = np.flatnonzero(begins)
    names = np.where(doubled, mixed(words ^ NAME_RUN), words)[at]
    left = (mixed(names) & np.uint64(1)).astype(bool)
    joined = np.concatenate((left[:-1] & ~left[1:], [False]))
    begins = np.concatenate(([True], ~joined[:-1]))
    following = np.concatenate((names[1:], [GAP]))
    names = np.where(joined, mixed(names * NAME_PAIR + following), names)
    return at[begins], names[begins]


def anchors(words: np.ndarray) -> np.ndarray:
    """First words of the symbols of least name among those that begin in each stretch of STRETCH words."""
    n = len(words)
    if n < WIDTH:
        return np.empty(0, np.int64)
    at, names = symbols(words)
    rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    rank[at] = mixed(names) >> np.uint64(1) | np.uint64(1)
    # the window that begins at s chooses among the symbols that begin at s + BEFORE ... s + BEFORE + STRETCH - 1
    least = _sliding(rank, np.minimum)[BEFORE : BEFORE + n - WIDTH + 1]
    margin = np.zeros(STRETCH - 1, np.uint64)
    highest = _sliding(np.concatenate((margin, least, margin)), np.maximum)
    return np.flatnonzero(highest == rank[BEFORE : BEFORE + len(highest)]) + BEFORE


def _sliding(values: np.ndarray, best) -> np.ndarray:
    """The least or greatest of every STRETCH neighbours."""
    width = 1
    while 2 * width <= STRETCH:
        values = best(values[:-width], values[width:])
        width *= 2
    return best(values[: -(STRETCH - width)], values[STRETCH - width :]) if width < STRETCH else values


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _local(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice here; is this its first place."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    leads = np.zeros(len(keys), bool)
    leads[first] = True
    return counts[inverse] > 1, leads


class Lists:
    """Arrow lists, one for each document, of values whose documents ascend."""

    def __init__(self, owner: np.ndarray, documents: int):
        self.owner, self.documents = owner.astype(np.int64), documents

    def of(self, rows: np.ndarray, values: np.ndarray) -> pa.ListArray:
        counts = np.bincount(self.owner[rows], minlength=self.documents)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[rows]))


def _survey(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its key, number of words, digests and symbols.

    `settled` are its symbols seen twice in this task, `keys` those about which other tasks are asked
    or told; `twice` says which of them were seen twice here.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHARS_AT_ONCE):
            n_words, same_words, joined, keys, owner = [], [], [], [], []
            for i, text in enumerate(plain_texts(part, "text")):
                words = words_of(text)
                line = b" ".join(words)
                n_words.append(len(words))
                same_words.append(hashlib.md5(line).digest())
                joined.append(hashlib.sha256(line).hexdigest())
                hashes = WORDS.of(words)
                at = anchors(hashes)
                own = window_hashes(hashes, BEFORE + AFTER)[at - BEFORE] if len(at) else np.empty(0, np.uint64)
                keys.append(own)
                owner.append(np.full(len(own), i))
            flat, whose = np.concatenate(keys), np.concatenate(owner)
            twice, leads = _local(flat)
            lists = Lists(whose, part.num_rows)
            sent = np.flatnonzero(leads)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array(n_words, pa.int64()),
                    pa.array(same_words, pa.binary()),
                    pa.array(joined),
                    lists.of(np.flatnonzero(twice), flat.view(np.int64)),
                    lists.of(sent, flat.view(np.int64)),
                    lists.of(sent, twice),
                ],
                ["doc_id", "text_hash", "n_words", "same_words", "all_sha256", "settled", "keys", "twice"],
            )

    rows = documents.select(*text_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    schema = (
        "doc_id long, text_hash long, n_words long, same_words binary, all_sha256 string, settled array<long>, "
        "keys array<long>, twice array<boolean>"
    )
    return rows.mapInArrow(run, schema)


def _window_marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each 35-word window: 64 and 32."""
    return window_hashes(hashes, WIDTH), window_hashes(mixed(hashes), WIDTH).astype(np.uint32).view(np.int32)


def _windows(candidates: DataFrame) -> DataFrame:
    """For each candidate its windows around shared symbols: those seen twice in the task, and those to ask about."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHARS_AT_ONCE):
            texts = plain_texts(part, "text")
            shared = part.column("shared").to_pylist()
            settled = part.column("settled").to_pylist()
            marks, checks, starts, owner = [], [], [], []
            for i, text in enumerate(texts):
                hashes = WORDS.of(words_of(text))
                at = anchors(hashes)
                if not len(at):
                    continue
                own = window_hashes(hashes, BEFORE + AFTER)[at - BEFORE]
                at = at[np.isin(own, np.array([*settled[i], *(shared[i] or [])], np.int64).view(np.uint64))]
                if not len(at):
                    continue
                last = len(hashes) - WIDTH
                begins = covered(
                    np.maximum(at + AFTER - WIDTH, 0), STRETCH, max(last + 1, int(at.max()) + STRETCH + 1)
                )[: last + 1]
                own = np.flatnonzero(begins)
                mark, check = _window_marks(hashes)
                marks.append(mark[own])
                checks.append(check[own])
                starts.append(own)
                owner.append(np.full(len(own), i))
            none = [np.empty(0, np.int64)]
            mark, whose = np.concatenate([*marks, np.empty(0, np.uint64)]), np.concatenate(owner or none).astype(int)
            check, start = np.concatenate([*checks, np.empty(0, np.int32)]), np.concatenate(starts or none).astype(int)
            twice, leads = _local(mark ^ (check.astype(np.int64).view(np.uint64) * NAME_PAIR))

            lists = Lists(whose, len(texts))
            known, asked = np.flatnonzero(twice), np.flatnonzero(leads)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    part.column("text"),
                    lists.of(known, start.astype(np.int32)),
                    lists.of(asked, mark.view(np.int64)),
                    lists.of(asked, check),
                    lists.of(asked, start.astype(np.int32)),
                    lists.of(asked, twice),
                ],
                ["doc_id", "text_hash", "text", "known", "marks", "checks", "starts", "twice"],
            )

    schema = (
        "doc_id long, text_hash long, text string, known array<int>, marks array<long>, checks array<int>, "
        "starts array<int>, twice array<boolean>"
    )
    return candidates.mapInArrow(run, schema)


def _kept(found: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHARS_AT_ONCE):
            known, asked = part.column("known").to_pylist(), part.column("found").to_pylist()
            removed, kept = [], []
            for text, a, b in zip(plain_texts(part, "text"), known, asked):
                words = words_of(text)
                gone = covered(np.unique(np.array([*(a or []), *(b or [])], np.int64)), WIDTH, len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "surrogatepass"))
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(removed, pa.int64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_removed", "kept"])

    return found.mapInArrow(run, "doc_id long, text_hash long, n_removed long, kept string")


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key occurs in another row too, or was seen twice in a task."""
    weight = F.sum(F.when(F.col("twice"), 2).otherwise(1)).over(Window.partitionBy(*key))
    return rows.withColumn("weight", weight).where("weight > 1").drop("weight")


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, text_hash, n_words, n_removed, kept, kept_sha256).

    Words are the parts between blanks, tabs and line breaks. A word is removed if it is in a window
    of 35 words that also begins anywhere else, in the same document or another. kept joins the words
    that stay by one blank; it is null where nothing is removed, and kept_sha256 always is its digest.
    A null text has no words. Repeated rows are documents like others, so all their windows go.
    """
    survey = stored(_survey(documents, id_col, text_col))
    copies = survey.where(F.col("n_words") >= WIDTH).groupBy("same_words")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    copies = copies.agg(F.count("*").alias("n"), first).where("n > 1")
    first_hash, first_id = F.col("first.text_hash").alias("first_hash"), F.col("first.doc_id").alias("first_id")
    copies = stored(copies.select("same_words", first_hash, first_id))
    is_first = (F.col("first_hash") == F.col("text_hash")) & F.col("first_id").eqNullSafe(F.col("doc_id"))
    rows = survey.join(copies, "same_words", "left").select(
        *("doc_id", "text_hash", "n_words", "all_sha256", "settled"),
        F.col("first_hash").isNotNull().alias("copied"),
        (F.col("first_hash").isNull() | is_first).alias("speaks"),
    )
    keys = survey.select("doc_id", "text_hash", F.explode(F.arrays_zip("keys", "twice")).alias("k"))
    keys = keys.select("doc_id", "text_hash", F.col("k.keys").alias("key"), F.col("k.twice").alias("twice"))
    shared = _shared(keys, "key").groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("shared"))
    told = rows.where("speaks").select("doc_id", "text_hash", "settled").distinct()
    told = join_documents(told, shared, "left").where("size(settled) > 0 or shared is not null")
    texts = documents.select(*text_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    windows = stored(_windows(join_documents(texts, told)))
    asked = windows.select("doc_id", "text_hash", F.explode(F.arrays_zip("marks", "checks", "starts", "twice")).alias("w"))
    asked = asked.select("doc_id", "text_hash", "w.marks", "w.checks", "w.starts", "w.twice")
    found = _shared(asked, "marks", "checks").groupBy("doc_id", "text_hash").agg(F.collect_set("starts").alias("found"))
    hits = windows.select("doc_id", "text_hash", "text", "known")
    hits = join_documents(hits, found, "left").where("size(known) > 0 or found is not null")
    kept = _kept(hits).dropDuplicates(["doc_id", "text_hash"])
    return join_documents(rows, kept, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), "").otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce(F.sha2(F.col("kept"), 256), "all_sha256"))
        .alias("kept_sha256"),
    )
