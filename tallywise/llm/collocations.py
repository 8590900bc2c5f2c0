"""Phrases of two to four words that occur together more than their parts would suggest.

A phrase that is frequent enough consists of words, and of pairs of neighbours, that are. So words are
counted first, then frequent pairs are found, then longer phrases of nothing but frequent pairs. Pairs
and longer phrases are found in two passes each. In the first every task adds up the hashes of the
phrases it sees and deals them to hash partitions; each partition folds what it gets into Misra-Gries
summaries. A summary of K counters over a mass of m loses less than m / K of any count, so with K over
m divided by the least count asked for, every phrase that reaches that count is in the summary at the
end. A task adds at most the least count to a phrase's mass: what reaches it in one task has reached
it, and a phrase that makes up a third of the corpus does not swell its partition. What a summary has
lost is checked at the end, and more partitions are taken if it was too much. The hashes that stay
become a bit set of bounded size.

The second pass counts, by their words, the phrases whose hashes are in the bit sets; one pass does so
for all lengths. Whatever the bit sets let through by chance is counted too and dropped for its count,
so they decide how much is shuffled and never what comes out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywise.llm.common import chunks, mixed, stored

LONGEST = 4
COUNTERS = 1 << 19  # of a summary
PARTS = 256  # hash partitions at least
HELD = 2_000_000  # phrases that a task adds up before it hands them on
LARGEST_FILTER = 28  # bits of a position in the bit set: 32 MB at most
SPARSE = 64  # bits for each hash, while the bit set has room
SALTS = 64
CHARS_AT_ONCE = 4_000_000

# separators of pieces become a byte that UTF-8 never has, A-Z small letters, tabs blanks
BOUND = b"\xff"
TABLE = bytes(
    0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256)
)
ROTATE = np.uint64(0xD6E8FEB86659FD93)


class Names(dict):
    """Numbers of words, in the order in which they are met; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({BOUND: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(group, words and ends of pieces) of all texts of each group of a batch."""
    held: dict[str, list[bytes]] = {}
    for group, text in zip(batch.column("g").to_pylist(), batch.column("text").to_pylist()):
        if text:
            held.setdefault(group, []).append(text.encode("utf-8", "surrogatepass").translate(TABLE))
    for group, texts in held.items():
        yield group, (BOUND + BOUND.join(texts) + BOUND).replace(BOUND, b" \xff ").split()


def _distinct(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, the first being the end of a piece, and the number of each token."""
    names = Names()
    numbers = np.fromiter(map(names.__getitem__, tokens), np.int64, len(tokens))
    return list(names), numbers


@dataclass
class Filter:
    """A bit set: the leading `width` bits of a hash are its position. `None` in its place lets all pass."""

    width: int
    bits: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.width)).astype(np.int64)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def word_hashes(words: list[bytes], group: str) -> np.ndarray:
    """What Spark's xxhash64(group, word) gives."""
    seed = xxhash.xxh64_intdigest(group.encode("utf-8", "surrogatepass"), 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def phrases(
    words: list[bytes], numbers: np.ndarray, group: str, filters: list[Filter]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, first positions, hashes) of the phrases of two words and more.

    `filters` are those of words, of pairs and of longer phrases, as far as they are known.
    """
    own = word_hashes(words, group)
    good = filters[0].passes(own)
    good[0] = False
    inside = good[numbers]
    starts = np.flatnonzero(inside)
    running = own[numbers[starts]]
    for length in range(2, LONGEST + 1):
        ahead = inside[starts + length - 1]  # the text ends with the end of a piece, so nothing lies beyond
        starts, running = starts[ahead], running[ahead]
        running = mixed(running * ROTATE + own[numbers[starts + length - 1]])
        if len(filters) > 1 and length == 2:
            ahead = filters[1].passes(running)
            starts, running = starts[ahead], running[ahead]
            inside = np.zeros(len(numbers), bool)  # from now on: where a pair that passes ends
            inside[starts + 1] = True
        elif len(filters) > 2:
            ahead = filters[2].passes(running)
            yield length, starts[ahead], running[ahead]
            continue
        yield length, starts, running


def added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes once, with the sum of their counts; sorted."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def word_counts(documents: DataFrame) -> DataFrame:
    """(g, phrase, n) of every single word of (g, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for group, counts in held.items():
                counts.pop(BOUND, None)
                words = [w.decode("utf-8", "surrogatepass") for w in counts]
                for at in range(0, len(words), 50_000):
                    n = list(counts.values())[at : at + 50_000]
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({"g": [group] * len(part), "phrase": part, "n": pa.array(n, pa.int64())})
            held.clear()

        for part in chunks(batches, "text", CHARS_AT_ONCE):
            for group, tokens in words_of(part):
                held.setdefault(group, Counter()).update(tokens)
            if sum(map(len, held.values())) > HELD // 4:
                yield from out()
        yield from out()

    counted = documents.mapInArrow(run, "g string, phrase string, n long")
    return counted.groupBy("g", "phrase").agg(F.sum("n").alias("n"))


def _local_counts(documents: DataFrame, least: int, lengths: set[int], filters: list[Filter]) -> DataFrame:
    """(seen): hash and count of what each task has seen of a phrase, `least` at most, handed on before it grows too large.

    The last bits of the hash, as many as `least` has, make room for the count.
    """
    spare = np.int64(least.bit_length())
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            hashes, counts = held[0]
            seen = hashes.view(np.int64) >> spare << spare | np.minimum(counts, least)
            return pa.RecordBatch.from_arrays([pa.array(seen)], ["seen"])

        def joined() -> list[tuple[np.ndarray, np.ndarray]]:
            return [added(np.concatenate([h for h, _ in held]), np.concatenate([n for _, n in held]))]

        for part in chunks(batches, "text", CHARS_AT_ONCE):
            for group, tokens in words_of(part):
                words, numbers = _distinct(tokens)
                found = [h for n, _, h in phrases(words, numbers, group, shared.value) if n in lengths]
                held.append(np.unique(np.concatenate(found), return_counts=True))
                size += len(held[-1][0])
            if size > HELD:
                held = joined()
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out()
                    held, size = [], 0
        if held:
            held = joined()
            yield out()

    return documents.mapInArrow(run, "seen long")


class Summary:
    """A Misra-Gries summary: at most `counters` hashes; a count is short by `lost` at most."""

    def __init__(self, counters: int):
        self.counters, self.lost, self.waiting = counters, 0, 0
        self.hashes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((hashes, counts))
        self.waiting += len(hashes)
        if self.waiting > self.counters:
            self.fold()

    def fold(self) -> None:
        """Take in what waits; beyond the capacity, the largest count that has no room is taken off all."""
        parts = [(self.hashes, self.counts), *self.new]
        hashes, counts = added(np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]))
        if len(hashes) > self.counters:
            off = np.partition(counts, len(counts) - self.counters - 1)[len(counts) - self.counters - 1]
            stays = counts > off
            hashes, counts, self.lost = hashes[stays], counts[stays] - off, self.lost + int(off)
        self.hashes, self.counts, self.new, self.waiting = hashes, counts, [], 0


def _survivors(local: DataFrame, parts: int, least: int, counters: int) -> DataFrame:
    """(hash, lost): what the summaries hold at the end, but for what cannot have come `least` times."""
    spare = least.bit_length()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Summary] = {}
        for batch in batches:
            seen = batch.column(0).to_numpy(zero_copy_only=False)
            part = (seen >> 16 & 0xFFFFFFFF) % parts
            for p in np.unique(part).tolist():
                mine = seen[part == p]
                own.setdefault(p, Summary(counters)).add(mine >> spare << spare, mine & ((1 << spare) - 1))
        for summary in own.values():
            summary.fold()
            hashes = summary.hashes[summary.counts + summary.lost >= least]
            # a row without a hash says what was lost
            lost = pa.array(np.full(len(hashes) + 1, summary.lost))
            yield pa.RecordBatch.from_arrays([pa.array([*hashes.tolist(), None], pa.int64()), lost], ["hash", "lost"])

    at_least = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright("seen", 16).bitwiseAND(F.lit(0xFFFFFFFF)) % parts
    return local.repartition(max(at_least, parts // 8), part).mapInArrow(run, "hash long, lost long")


def frequent_hashes(
    documents: DataFrame, least: int, mass: int, lengths: set[int], filters: list[Filter], counters: int = COUNTERS
) -> DataFrame:
    """(hash) with every phrase of (g, text) that occurs `least` times or more among them, and some others.

    `mass` is at least the number of phrases. It gives the number of hash partitions, which is raised
    if a summary has lost `least` or more of a count.
    """
    local = _local_counts(documents, least, lengths, filters)
    parts = PARTS + 2 * mass // (least * counters)
    while True:
        found = stored(_survivors(local, parts, least, counters))
        if (found.agg(F.max("lost")).first()[0] or 0) < least:
            return found.where("hash is not null").select("hash")
        parts *= 2


def bit_set(hashes: DataFrame, most: int = LARGEST_FILTER) -> Filter:
    """The bit set of a column of hashes, of 2^most bits at most."""
    width = min(most, max(15, (hashes.count() * SPARSE).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - width) + 1  # positions of Spark's bitmaps begin at 1, buckets too
    rows = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b"))
    bits = np.zeros(1 << (width - 3), np.uint8)
    for row in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        bits[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return Filter(width, bits)


def _exact_counts(documents: DataFrame, filters: list[Filter]) -> DataFrame:
    """(g, phrase, n) of the phrases that pass all filters, as each task counts them.

    Phrases are told apart by their words: two neighbours get a number of their own, then that
    number and the next word, and so on; hashes only choose what is counted.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for at in range(0, len(items), 50_000):
                rows = items[at : at + 50_000]
                shown = [p.decode("utf-8", "surrogatepass") for (_, p), _ in rows]
                columns = [pa.array([g for (g, _), _ in rows]), pa.array(shown), pa.array([n for _, n in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["g", "phrase", "n"])
            held.clear()

        for part in chunks(batches, "text", CHARS_AT_ONCE):
            for group, tokens in words_of(part):
                words, numbers = _distinct(tokens)
                names = numbers
                for length, starts, _ in phrases(words, numbers, group, shared.value):
                    # a phrase that is frequent enough begins with one that is
                    starts = starts[names[starts] >= 0]
                    pair = names[starts] << 32 | numbers[starts + length - 1]
                    _, first, inverse, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                    for start, count in zip(starts[first].tolist(), n.tolist()):
                        phrase = group, b" ".join(tokens[start : start + length])
                        held[phrase] = held.get(phrase, 0) + count
                    names = np.full(len(numbers), -1, np.int64)
                    names[starts] = inverse
            if len(held) > HELD // 4:
                yield from out()
        yield from out()

    return documents.mapInArrow(run, "g string, phrase string, n long")


def phrase_counts(
    documents: DataFrame, least: int, counters: int = COUNTERS, most: int = LARGEST_FILTER
) -> tuple[DataFrame, DataFrame]:
    """Exact counts: (g, phrase, n) of every single word, and of every longer phrase with n of `least` or more."""
    words = stored(word_counts(documents))
    frequent = words.where(F.col("n") >= least)
    mass = frequent.agg(F.sum("n")).first()[0] or 0
    filters = [bit_set(frequent.select(F.xxhash64("g", "phrase").alias("hash")), most)]
    filters.append(bit_set(frequent_hashes(documents, least, mass, {2}, filters, counters), most))
    longer = set(range(3, LONGEST + 1))
    filters.append(bit_set(frequent_hashes(documents, least, mass * len(longer), longer, filters, counters), most))
    total = _exact_counts(documents, filters).groupBy("g", "phrase").agg(F.sum("n").alias("n"))
    return words, stored(total.where(F.col("n") >= least))


def _part(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("w", first, length), " ")


def collocations(
    documents: DataFrame,
    group_col: str = "lang",
    text_col: str = "text",
    least: int = 30,
    contained_pct: int = 80,
    top: int | None = 2000,
    scale: int = 2_000_000,
    counters: int = COUNTERS,
    most: int = LARGEST_FILTER,
) -> DataFrame:
    """(g, rank, phrase, a, l, r, n, score), the `top` phrases of each group, all of them for None.

    a, l and r count a phrase and its two parts at the cut of the lowest score, floor(scale * a / (l + r)),
    n the words of the group. Phrases inside a longer one with at least `contained_pct` percent of their
    count are left out. A null group is `und`; a null or empty text has no words; repeated rows count as
    often as they come; an empty table gives an empty result. Further columns are ignored.
    """
    rows = documents.select(
        F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("g"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    words, longer = phrase_counts(rows, least, counters, most)
    sizes = words.groupBy("g").agg(F.sum("n").alias("total"))
    w = F.split("phrase", " ")
    found = longer.select("g", "phrase", F.size(w).alias("words"), F.col("n").alias("a"), w.alias("w"))

    # every part at every cut, looked up together
    cut = found.select("g", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("is_first"), _part(1, F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("is_first"), _part(F.col("k") + 1, F.size("w") - F.col("k")).alias("part")),
    )
    parts = cut.select("g", "phrase", "a", "k", F.inline(sides))
    known = words.where(F.col("n") >= least).union(longer).select(F.col("g").alias("of"), F.col("phrase").alias("known"), F.col("n").alias("f"))
    met = parts.join(known, (F.col("g") == F.col("of")) & (F.col("part") == F.col("known")))
    both = met.groupBy("g", "phrase", "a", "k").agg(
        F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r")
    )
    exact = f"cast({scale} as decimal(16,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    scored = both.withColumn("score", F.expr(exact).cast("long"))
    lowest = scored.groupBy("g", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x"))

    # what lies inside a longer phrase
    span = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k")
    inner = found.where("words > 2").select("g", "a", "w", "words", span)
    inner = inner.select("g", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("i"))
    inner = inner.groupBy("g", _part(F.col("i"), F.col("k")).alias("phrase")).agg(F.max("a").alias("longer"))
    inside = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * contained_pct
    left = lowest.join(inner, ["g", "phrase"], "left").where(~F.coalesce(inside, F.lit(False)))
    left = left.select("g", "phrase", "a", "x.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        some = Window.partitionBy("g", "salt").orderBy(*order)
        left = salted.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "g").select("g", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
