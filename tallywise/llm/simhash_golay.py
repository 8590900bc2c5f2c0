"""Near-duplicates by SimHash fingerprints, found through Golay-code keys.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. A segment is decoded to the
codewords of the binary Golay code (23, 12, 7) within distance 4: one codeword, or six when the
nearest is at distance 3. Two segments at distance 2 or less share one of these codewords (the
codeword nearest to a point between them); at distance 1 or less, the nearest codeword of one is
always among the codewords of the other. Of four differing bits over three segments

* either one segment is equal, and of the other two one differs in at most two bits: the key is
  (equal segment, a codeword of the other), filed by both sides;
* or two segments differ in exactly one bit each: one side files (nearest codeword, nearest
  codeword), the other looks up every pair of its codewords.

So no link at four bits or fewer is missed. Rows with the same key meet in a sorted partition, where
a search from fingerprint to fingerprint writes a spanning forest of the verified links, not all
pairs: a tight cluster of m fingerprints gives m - 1 links for each key. Buckets over `bucket_limit`
fingerprints are cut into blocks and every two blocks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tallywise.llm.common import chunks, plain_texts, rows_by_key, stored, text_key
from tallywise.llm.components import connected_components

MAX_BITS = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # (first bit, number of bits)
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SMALL_RUN = 8

# one byte lane for each bit of a byte
LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of the word shingles of a text; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(octets), 255):
        ones += LANES[octets[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Columns (doc_id, text_hash, fp) of each row; a null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            values = np.array([fingerprint(t, shingle) for t in plain_texts(part, "text")], dtype=np.uint64)
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    rows = documents.select(*text_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _syndrome_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word; for each syndrome the error patterns of weight 4 or less, -1 for none."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    by_byte = np.zeros((3, 256), np.int64)
    for part in range(3):
        for v in range(256):
            if v << (8 * part) < 1 << 23:
                by_byte[part, v] = remainder(v << (8 * part))
    unit = [remainder(1 << b) for b in range(23)]
    patterns = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            patterns[syndrome, filled[syndrome]] = sum(1 << b for b in bits)
            filled[syndrome] += 1
    return by_byte, patterns


BY_BYTE, PATTERNS = _syndrome_tables()


def codewords(segment: np.ndarray) -> np.ndarray:
    """Numbers (12 bits) of the codewords within distance 4 of 23-bit words, nearest first; -1 for none."""
    syndrome = BY_BYTE[0][segment & 255] ^ BY_BYTE[1][segment >> 8 & 255] ^ BY_BYTE[2][segment >> 16]
    patterns = PATTERNS[syndrome]
    return np.where(patterns >= 0, (segment[:, None] ^ patterns) >> 11, -1)


def filed_keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, fingerprint, is filed) for every key; the other side of a key may look up only."""
    unsigned = fps.view(np.uint64)
    parts = [((unsigned >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    words = [codewords(p) for p in parts]
    kind = 0
    for exact in range(3):
        for near in range(3):
            if exact != near:
                for k in range(6):
                    ok = words[near][:, k] >= 0
                    yield (kind << 40) | (parts[exact][ok] << 12) | words[near][ok, k], fps[ok], True
                kind += 1
    for a, b in ((0, 1), (0, 2), (1, 2)):
        for j in range(6):
            for k in range(6):
                ok = (words[a][:, j] >= 0) & (words[b][:, k] >= 0)
                yield (kind << 40) | (words[a][ok, j] << 12) | words[b][ok, k], fps[ok], j + k == 0
        kind += 1


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 20_000):
                for key, fp, filed in filed_keys(values[at : at + 20_000]):
                    flags = pa.array(np.full(len(key), filed))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), flags], ["key", "fp", "filed"])

    return fps.mapInArrow(run, "key long, fp long, filed boolean")


def _forest(fps: np.ndarray, filed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest over everything within reach of a filed fingerprint."""
    seeds, rest, found = np.unique(fps[filed]), np.unique(fps), []
    for seed in seeds:
        at = np.searchsorted(rest, seed)
        if at == len(rest) or rest[at] != seed:
            continue
        rest, queue = np.delete(rest, at), [seed]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                new = rest[near]
                found.append((np.full(len(new), x), new))
                queue.extend(new)
                rest = rest[~near]
    return found


def _links(key: np.ndarray, fp: np.ndarray, filed: np.ndarray, limit: int):
    """Verified links of complete buckets sorted by key, and the keys of buckets over the limit."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    run = np.repeat(np.arange(len(first)), size)
    small = size[run] <= SMALL_RUN
    found = []
    for gap in range(1, SMALL_RUN):
        ok = (key[gap:] == key[:-gap]) & small[gap:] & (filed[gap:] | filed[:-gap])
        left, right = fp[:-gap][ok], fp[gap:][ok]
        near = (np.bitwise_count(left ^ right) <= MAX_BITS) & (left != right)
        found.append((left[near], right[near]))
    large = np.flatnonzero((size > SMALL_RUN) & (size <= limit))
    for r in large[np.logical_or.reduceat(filed, first)[large]] if len(large) else ():
        part = slice(first[r], first[r] + size[r])
        found += _forest(fp[part], filed[part])
    a = np.concatenate([x for x, _ in found])
    b = np.concatenate([y for _, y in found])
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    return pairs, key[first[size > limit]]


def _met(keyed: DataFrame, limit: int) -> DataFrame:
    """Links of the rows that share a key; keys of more rows than the limit come back instead of their links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(key, fp, filed):
            pairs, hot = _links(key, fp.view(np.uint64), filed, limit)
            columns = {
                "a": pa.array(np.concatenate((pairs[:, 0].view(np.int64), np.zeros(len(hot), np.int64)))),
                "b": pa.array(np.concatenate((pairs[:, 1].view(np.int64), np.zeros(len(hot), np.int64)))),
                "hot_key": pa.array([None] * len(pairs) + hot.tolist(), pa.int64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "filed")]
            held.append(tuple(columns))
            key = np.concatenate([h[0] for h in held])
            fp = np.concatenate([h[1] for h in held])
            filed = np.concatenate([h[2] for h in held])
            cut = np.searchsorted(key, key[-1])  # the last bucket may go on in the next batch
            if cut:
                yield out(key[:cut], fp[:cut], filed[:cut])
            held = [(key[cut:], fp[cut:], filed[cut:])]
            if len(held[0][0]) > limit + 1:  # enough to know that it is over the limit
                held = [tuple(c[: limit + 1] for c in held[0])]
        if held:
            yield out(*held[0])

    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long, hot_key long")


def fingerprint_links(fps: DataFrame, bucket_limit: int = 50_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect everything within four bits."""
    keyed = _keyed(fps)
    met = stored(_met(keyed, bucket_limit))
    links = met.where("hot_key is null").select("a", "b")
    hot = met.where("hot_key is not null").select(F.col("hot_key").alias("key")).distinct()
    if hot.isEmpty():
        return links
    members = stored(keyed.join(hot, "key", "left_semi"))
    blocks = members.groupBy("key").count()
    n = F.ceil(F.col("count") * 2 / F.lit(bucket_limit)).cast("long")
    cut = members.join(blocks.select("key", n.alias("n")), "key")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), "n"))
    cut = cut.select("key", "fp", "filed", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    cut = cut.select(block.alias("key"), "fp", "filed")
    return links.union(_met(cut, 1 << 62).select("a", "b"))


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    bucket_limit: int = 50_000,
) -> DataFrame:
    """One row per input row: (doc_id, text_hash, fingerprint, component_id, first_hash).

    Fingerprints with four differing bits or fewer are linked; component_id is the smallest doc_id
    that can be reached, first_hash the smallest text_hash of the rows with that id. A null or
    wordless text has fingerprint zero and is linked like any other. Rows with a null id take part;
    component_id is null if no id in the component is known. Repeated rows come back as often as
    they came. An empty table gives an empty result; further columns are ignored.
    """
    rows = stored(fingerprints(documents, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    by_fp = rows.groupBy("fp").agg(first.alias("first"))
    by_fp = stored(by_fp)
    roots = connected_components(fingerprint_links(by_fp.select("fp"), bucket_limit), "a", "b")
    known = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    named = known.join(least, "root").select("fp", "least")
    return rows.join(named, "fp").select(
        "doc_id",
        "text_hash",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        F.col("least.text_hash").alias("first_hash"),
    )


def without_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, with one row of each component: that with the smallest id."""
    found = near_duplicates(documents, id_col, text_col)
    chosen = found.where(
        F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    )
    kept = rows_by_key(documents, chosen, "left_semi", id_col, text_col)
    return kept.dropDuplicates(["key_id", "key_hash"]).select("row.*")
