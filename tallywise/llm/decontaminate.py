"""Benchmark passages in documents, found by spaced seeds.

A mask of '1' and '0' is laid on every stretch of words; the words under a '1' are hashed, those
under a '0' are ignored. A document and a benchmark item that agree except for some words share the
hash of a mask whose ignored places meet the changed words. Shared hashes give places where the item
may stand; there the words of both are compared one by one.

The masks are chosen so that whatever words are changed, as many as the comparison allows, in a stretch
of 11 to 20 words, at least one place of one mask meets none of them: a search over all sets of
changed words has shown it, and a test repeats it.

The hashes of the items are sent to all tasks in slices of at most SLICE numbers, one pass over the
documents for each slice, so a task never holds more than one slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallywise.llm.common import WORDS, chunks, mixed, plain_texts, rows_by_key, stored, text_key

MASKS = ("1111011", "110010111", "1101000111", "111100011")
SPAN = 11  # words that an item needs to be found with changed words
SLICE = 1_000_000
COMPARED = 20  # words that are compared together; all words of a shorter item
AGREE = 0.8  # share of them that has to be equal
IN_A_ROW = 13  # equal words in a row that always count, and words that an item cut off at an edge must have
WORD = re.compile(r"\w+")
WEIGHTS = mixed(np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text in lower case, without punctuation."""
    return WORDS.of(WORD.findall(text.lower()))


def seeds(words: np.ndarray, lengths: Iterable[int] = ()) -> Iterator[tuple[np.ndarray, int]]:
    """(hash at every place, width) for each mask, and for plain runs of the given lengths."""
    masks = [*MASKS, *("1" * n for n in lengths)]
    for number, mask in enumerate(masks):
        count = len(words) - len(mask) + 1
        if count > 0:
            total = np.full(count, np.uint64(len(mask) * 64 + min(number, len(MASKS))), np.uint64)
            for i, bit in enumerate(mask):
                if bit == "1":
                    total += words[i : i + count] * WEIGHTS[i]
            yield mixed(total), len(mask)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, n, words, hashes, places): an item under SPAN words has one hash, of all its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = []
            for item, text in zip(part.column("item").to_pylist(), plain_texts(part, "text")):
                words = word_hashes(text)
                short = [len(words)] if 0 < len(words) < SPAN else []
                found = [(int(h), p) for hashes, _ in seeds(words, short) for p, h in enumerate(hashes.view(np.int64))]
                rows.append((item, len(words), words.view(np.int64).tolist(), [h for h, _ in found], [p for _, p in found]))
            schema = pa.schema(
                [
                    ("item", part.schema.field("item").type),
                    ("n", pa.int32()),
                    ("words", pa.list_(pa.int64())),
                    ("hashes", pa.list_(pa.int64())),
                    ("places", pa.list_(pa.int32())),
                ]
            )
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where(
        F.col("text").isNotNull()
    )
    kind = rows.schema["item"].dataType.simpleString()
    schema = f"item {kind}, n int, words array<long>, hashes array<long>, places array<int>"
    return rows.mapInArrow(run, schema)


def _places(documents: DataFrame, wanted, bits, lengths: list[int], margin: int) -> DataFrame:
    """Stretches of documents around wanted hashes: (doc_id, text_hash, first, words, hits, at)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = wanted.value, bits.value
        mask = np.uint64(len(seen) * 8 - 1)
        for part in chunks(batches, "text"):
            out = []
            ids, digests = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
            for doc_id, digest, text in zip(ids, digests, plain_texts(part, "text")):
                words = word_hashes(text)
                at, hits = [], []
                for hashes, _ in seeds(words, lengths):
                    slot = hashes & mask
                    likely = np.flatnonzero(seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    if len(likely):
                        own = hashes[likely].view(np.int64)
                        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        sure = known[place] == own
                        at.append(likely[sure])
                        hits.append(own[sure])
                if not at or not sum(map(len, at)):
                    continue
                where, what = np.concatenate(at), np.concatenate(hits)
                order = np.argsort(where, kind="stable")
                where, what = where[order], what[order]
                for group in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where) > 2 * margin) + 1):
                    first = max(0, int(where[group[0]]) - margin)
                    last = int(where[group[-1]]) + margin
                    out.append(
                        (
                            doc_id,
                            digest,
                            first,
                            words[first:last].view(np.int64).tolist(),
                            what[group].tolist(),
                            where[group].tolist(),
                        )
                    )
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["doc_id", "text_hash", "first", "words", "hits", "at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "doc_id long, text_hash long, first int, words array<long>, hits array<long>, at array<int>"
    return documents.mapInArrow(run, schema)


def agree(alike: np.ndarray, item_words: int) -> bool:
    """Do the words of an item that stand opposite words of a document agree with them?

    Enough of 20 words in a row are equal, or of all words of a shorter item; or 13 in a row are. Where a
    document begins or ends inside an item, enough of the words opposite are, if there are 13.
    """
    width = min(COMPARED, item_words)
    if len(alike) < width:
        width = len(alike)
        if width < IN_A_ROW:
            return False
    same = np.concatenate(([0], np.cumsum(alike)))
    if (same[width:] - same[:-width]).max() >= AGREE * width:
        return True
    run = min(IN_A_ROW, len(alike))
    return run == IN_A_ROW and bool(((same[run:] - same[:-run]) == run).any())


def _agreement(pairs: DataFrame) -> DataFrame:
    """Compares an item with the words of a document that stand where it may stand."""
    kind = pairs.schema["item"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, equal, compared, places = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("first", "words", "item_words", "shift")]
            for row, (first, words, item, shift) in enumerate(zip(*columns)):
                a, b = np.array(words, np.int64), np.array(item, np.int64)
                start = shift - first  # where word 0 of the item stands in the stretch
                low, high = max(0, -start), min(len(b), len(a) - start)
                if low >= high:
                    continue
                alike = a[start + low : start + high] == b[low:high]
                if agree(alike, len(b)):
                    kept.append(row)
                    equal.append(int(alike.sum()))
                    compared.append(high - low)
                    places.append(shift + low)
            taken = batch.select(["doc_id", "text_hash", "item", "n"]).take(pa.array(kept, pa.int64()))
            more = [pa.array(x, pa.int32()) for x in (equal, compared, places)]
            names = ["doc_id", "text_hash", "item", "item_words", "n_equal", "n_compared", "at"]
            yield pa.RecordBatch.from_arrays([*taken.columns, *more], names)

    return pairs.mapInArrow(
        run, f"doc_id long, text_hash long, item {kind}, item_words int, n_equal int, n_compared int, at int"
    )


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each different document and item that overlap: their keys and the best overlap.

    Columns (doc_id, text_hash, item, item_words, n_equal, n_compared, at): n_equal of the n_compared
    words that stand opposite each other are equal, from word `at` of the document on. Of 20 words in a
    row (all, of a shorter item) at least four in five are equal, or 13 in a row are; where a document
    begins or ends inside an item, four in five of the words opposite, 13 or more. Case and
    punctuation do not count. Texts that are null or have no word overlap with nothing; items with a
    null id keep it; items of fewer than 11 words have to stand there word by word.
    """
    items = stored(_items(benchmark, item_col, item_text_col))
    seeded = items.select("item", "n", F.col("words").alias("item_words"), F.explode(F.arrays_zip("hashes", "places")).alias("s"))
    hashes = seeded.select(F.col("s.hashes").alias("hash")).distinct()
    facts = items.agg(F.max("n"), F.sort_array(F.collect_set(F.when((F.col("n") > 0) & (F.col("n") < SPAN), F.col("n"))))).first()
    longest, lengths = facts[0] or 0, facts[1]
    slices = max(1, -(-hashes.count() // SLICE))
    rows = documents.select(*text_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    spark, found = documents.sparkSession, None
    for number in range(slices):
        part = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(slices)) == number)
        known = np.sort(part.toPandas()["hash"].to_numpy(np.int64)) if longest else np.empty(0, np.int64)
        if not len(known):
            known = np.array([np.iinfo(np.int64).min])
        size = 1 << max(16, (64 * len(known)).bit_length())
        slots = known.view(np.uint64) & np.uint64(size - 1)
        bits = np.zeros(size // 8, np.uint8)
        np.bitwise_or.at(bits, (slots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
        places = _places(rows, spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(bits), lengths, longest + SPAN)
        places = places.withColumn("slice", F.lit(number))  # every slice cuts stretches of its own
        found = places if found is None else found.union(places)
    found = stored(found)
    hits = found.select("doc_id", "text_hash", "first", "slice", F.explode(F.arrays_zip("hits", "at")).alias("h"))
    hits = hits.select("doc_id", "text_hash", "first", "slice", F.col("h.hits").alias("hash"), F.col("h.at").alias("at"))
    seeded = seeded.select("item", "n", "item_words", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    where = F.col("at") - F.col("place")
    shifts = hits.join(seeded, "hash").select("doc_id", "text_hash", "first", "slice", "item", "n", "item_words", where.alias("shift")).distinct()
    named = [F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("first").alias("f"), F.col("slice").alias("s")]
    stretches = found.select(*named, "words").dropDuplicates(["d", "t", "f", "s"])
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("first") == F.col("f")) & (F.col("slice") == F.col("s"))
    overlaps = _agreement(shifts.join(stretches, same).drop("d", "t", "f", "s"))
    best = Window.partitionBy("doc_id", "text_hash", "item").orderBy(F.desc("n_equal"), "n_compared", "at")
    return overlaps.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, that overlap with no benchmark item."""
    bad = contaminated(documents, benchmark, id_col, text_col)
    return rows_by_key(documents, bad, "left_anti", id_col, text_col).select("row.*")
