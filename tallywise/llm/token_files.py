"""Token ids of a corpus in compressed files.

A token file is a folder of Parquet tables: `blocks` with the coded ids, `code` with the length of
every id's code, `parts` with the number of ids before each part. The code is a canonical Huffman
code over the counts of all ids, limited to LIMIT bits by package-merge, so the lengths alone define
it. A block holds the ids of whole documents one after the other, at least BLOCK ids or a part's
rest; it is decoded without any other block. Its checkpoints are the bit offsets of every STRIDE-th
id, so a reader can begin at any of them, and decoding runs over all checkpoints of many blocks at
once with one table look-up for each id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallywise.llm.common import chunks, cut_pieces, gathered, looked_up, safe_marks, shared_folder, stored

LIMIT = 20  # bits of the longest code; enough for a million different ids
BLOCK = 1 << 16
STRIDE = 512
PART_TOKENS = 8_000_000
REMEMBERED = 800_000  # pieces that a worker process keeps from batch to batch
CHARS_AT_ONCE = 4_000_000

class Pieces:
    """The tokenizers library with a bounded memory of what it gave for pieces of text.

    A byte-level tokenizer never joins characters before and after a place where a visible character
    is followed by white space, so a text is cut there. New pieces go to the library in long strings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)
        self.known: dict[bytes, bytes] = {}
        splits, plain = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer is None
        self.marks = safe_marks(lambda t: [a for _, (a, _) in splits.pre_tokenize_str(t)]) if splits and plain else b""

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, np.int64) for c in coded]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        joinable, alone = [], []
        for p in new:  # with a blank in front and a visible end
            visible = 32 < p[-1] < 128 or not p.decode("utf-8", "surrogatepass")[-1].isspace()
            (joinable if p[0] in b" \n" and visible else alone).append(p)
        out = {}
        for at in range(0, len(joinable), 4_000):
            group = joinable[at : at + 4_000]
            (ids,) = self._ids([b"".join(group).decode("utf-8", "surrogatepass")])
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if len(ids) and cuts[-1] < len(ids) and (reached[cuts] == ends).all():
                bounds = [0, *((cuts + 1) * self.kind.itemsize).tolist()]
                octets = ids.astype(self.kind).tobytes()
                out.update(zip(group, [octets[a:b] for a, b in zip(bounds, bounds[1:])]))
            else:  # a token that does not stand for its own bytes: ask for each piece
                alone += group
        for at in range(0, len(alone), 4_000):
            group = alone[at : at + 4_000]
            coded = self._ids([p.decode("utf-8", "surrogatepass") for p in group])
            out.update((p, ids.astype(self.kind).tobytes()) for p, ids in zip(group, coded))
        return out

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each text's begin and end."""
        pieces, index, firsts = cut_pieces(texts, self.marks)
        values = [*looked_up(pieces, self.known, self._learn, REMEMBERED), np.array([end], self.kind).tobytes()]
        index = np.insert(index.astype(np.int64), firsts[1:], len(values) - 1)  # the end id is one more piece of each text
        octets, bounds = gathered(values, index, firsts + np.arange(len(firsts)))
        return octets.view(self.kind), bounds // self.kind.itemsize


@cache
def _tokenizer(path: str) -> Pieces:
    return Pieces(path)


def tokenized(documents: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, width, ids): the ids of each text with the end id, `width` bytes each, little-endian."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        width = own.kind.itemsize
        for part in chunks(batches, "text", CHARS_AT_ONCE):
            ids, bounds = own.texts(pc.fill_null(part.column("text"), ""), end_id)
            offsets = pa.py_buffer((bounds * width).astype(np.int32))
            columns = [
                part.column("doc_id"),
                pa.array(np.diff(bounds)),
                pa.array(np.full(len(bounds) - 1, width, np.int32)),
                pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(ids)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "width", "ids"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary")


def _numbers(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{width}")


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents; every task adds up its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            widths, coded = batch.column("width").to_pylist(), batch.column("ids").to_pylist()
            for width in set(widths):
                own = np.bincount(_numbers(b"".join([c for c, w in zip(coded, widths) if w == width]), width))
                if len(own) > len(total):
                    total = np.concatenate((total, np.zeros(len(own) - len(total), np.int64)))
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    return ids.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code without a length over the limit, by package-merge."""
    n = len(weights)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    merged, levels = np.empty(0), []
    for _ in range(limit):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code from the lengths of its ids: shorter codes first, equal lengths by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, sizes = ids[order], lengths[order]
        self.bits = int(sizes.max()) if len(sizes) else 1
        spans = np.left_shift(1, self.bits - sizes)
        firsts = np.cumsum(spans) - spans
        top = int(ids.max()) + 1 if len(ids) else 1
        self.length_of, self.code_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.length_of[self.ids] = sizes
        self.code_of[self.ids] = firsts >> (self.bits - sizes)
        self.entry = np.repeat(np.arange(len(sizes)), spans)  # of every number of `bits` bits
        self.entry_id, self.entry_size = self.ids[self.entry].astype(np.int32), sizes[self.entry]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit offset of every STRIDE-th id."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        sizes = self.length_of[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # a code that begins within 32 bits ends within 64; codes of the same 32 bits stand together
        word = starts >> 5
        placed = self.code_of[ids].astype(np.uint64) << (64 - sizes - (starts & 31)).astype(np.uint64)
        both = np.bitwise_or.reduceat(placed, np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1)))
        words = np.zeros(len(both) + 1, np.uint64)
        words[:-1] = both >> np.uint64(32)
        words[1:] |= both & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3], starts[::STRIDE]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of several blocks; all checkpoints advance together, one id at a time."""
        padding = b"\0" * 8
        octets = np.frombuffer(padding.join([*payloads, b""]), np.uint8).astype(np.int64)
        quads = octets[:-3] << 24 | octets[1:-2] << 16 | octets[2:-1] << 8 | octets[3:]
        bases = np.cumsum([0, *[len(p) + len(padding) for p in payloads[:-1]]]) * 8
        bit = np.concatenate([b + np.asarray(c, np.int64) for b, c in zip(bases, checkpoints)])
        rows = np.concatenate(
            [np.minimum(STRIDE, n - STRIDE * np.arange(len(c))) for c, n in zip(checkpoints, counts)]
        )
        out = np.zeros((STRIDE, len(bit)), np.int32)
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        for step in range(int(rows.max()) if len(rows) else 0):
            entry = quads[np.minimum(bit >> 3, len(quads) - 1)] >> (shift - (bit & 7)) & mask
            out[step] = self.entry_id[entry]
            bit += self.entry_size[entry]
        ids, first, decoded = out.T.reshape(-1), 0, []
        for c, n in zip(checkpoints, counts):
            decoded.append(ids[first : first + n])
            first += len(c) * STRIDE
        return decoded


BLOCK_SCHEMA = (
    "part int, block int, first long, doc_ids array<long>, doc_tokens array<long>, "
    "checkpoints array<long>, payload binary"
)


def _blocks(ids: DataFrame, ids_used: np.ndarray, lengths: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(ids_used, lengths), TaskContext.get().partitionId()
        number, first, size = 0, 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            payload, checkpoints = code.encode(np.concatenate(held).astype(np.int64))
            sizes = [len(h) for h in held]
            values = [[part], [number], [first], [docs], [sizes], [checkpoints.tolist()], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "width", "ids")]
            for doc_id, width, coded in zip(*columns):
                docs.append(doc_id)
                held.append(_numbers(coded, width))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    number, first, size, docs, held = number + 1, first + size, 0, [], []
        if held:
            yield block()

    return ids.mapInArrow(run, BLOCK_SCHEMA)


def write_token_file(
    documents: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Tokenize every text (null: empty), append the end id and write all ids in ascending order of doc_id.

    Rows with a null id come last; rows of equal id come in the order of their ids. Only the table of
    the counts, one row per id of the vocabulary, passes through the driver.
    """
    spark = documents.sparkSession
    ids = stored(tokenized(documents, path, end_id, id_col, text_col))
    counted = id_counts(ids).toPandas().sort_values("id")
    used, weights = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    lengths = code_lengths(weights) if len(used) else np.empty(0, np.int64)
    total = int(weights.sum())
    parts = max(1, -(-total // PART_TOKENS))
    order = [F.asc_nulls_last("doc_id"), F.asc("ids")]
    dealt = ids.select("doc_id", "width", "ids").repartitionByRange(parts, F.asc_nulls_last("doc_id"))
    blocks = _blocks(dealt.sortWithinPartitions(*order), used, lengths)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    code = [(int(a), int(b)) for a, b in zip(used, lengths)]
    spark.createDataFrame(code, "id long, length int").coalesce(1).write.parquet(f"{folder}/code")
    sizes = spark.read.parquet(f"{folder}/blocks").select("part", F.expr("aggregate(doc_tokens, 0L, (a, x) -> a + x)").alias("n"))
    sizes = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row per part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{folder}/parts")


def _placed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with `first` counted from the first id of the file."""
    parts = spark.read.parquet(f"{folder}/parts").withColumnRenamed("part", "of")
    blocks = spark.read.parquet(f"{folder}/blocks").join(parts, F.col("part") == F.col("of"))
    return blocks.withColumn("first", F.col("first") + F.col("start")).drop("of", "start")


def _code_of(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    table = spark.read.parquet(f"{folder}/code").toPandas()
    return table["id"].to_numpy(np.int64), table["length"].to_numpy(np.int64)


def read_ids(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(start, ids): the ids at places `first` to `last` - 1 of a token file, a row for each block they lie in.

    Of a block only what lies between the checkpoint before the first id asked for and the last is decoded.
    """
    ids, lengths = _code_of(spark, folder)
    n = F.expr("aggregate(doc_tokens, 0L, (a, x) -> a + x)")
    blocks = _placed_blocks(spark, folder).withColumn("n", n).where((F.col("first") < last) & (F.col("first") + F.col("n") > first))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(ids, lengths)
        for batch in batches:
            for row in batch.to_pylist():
                low, high = max(0, first - row["first"]), min(row["n"], last - row["first"])
                begin = low // STRIDE  # the checkpoint to begin at
                chosen = np.array(row["checkpoints"][begin : -(-high // STRIDE)])
                skipped = int(chosen[0]) // 8  # bytes before it
                payload = row["payload"][skipped:]
                (decoded,) = code.decode([payload], [chosen - 8 * skipped], [high - begin * STRIDE])
                shown = decoded[low - begin * STRIDE :].tolist()
                columns = [pa.array([row["first"] + low]), pa.array([shown], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["start", "ids"])

    return blocks.select("first", "n", "checkpoints", "payload").mapInArrow(run, "start long, ids array<int>")


def read_token_file(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token file; ids is array<int>.

    With `digest` the ids are replaced by ids_crc32, the unsigned CRC-32 of the ids as little-endian
    32-bit numbers.
    """
    ids, lengths = _code_of(spark, folder)
    blocks = _placed_blocks(spark, folder)
    last = "ids_crc32" if digest else "ids"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(ids, lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pydict()
                counts = [sum(n) for n in rows["doc_tokens"]]
                decoded = code.decode(rows["payload"], [np.array(c) for c in rows["checkpoints"]], counts)
                out = ([], [], [], [])
                for docs, sizes, first, own in zip(rows["doc_ids"], rows["doc_tokens"], rows["first"], decoded):
                    place = 0
                    for doc_id, n in zip(docs, sizes):
                        values = own[place : place + n]
                        shown = zlib.crc32(values.astype("<u4").tobytes()) if digest else values.tolist()
                        for column, value in zip(out, (doc_id, first + place, n, shown)):
                            column.append(value)
                        place += n
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32())]
                names = ["doc_id", "start", "n_tokens", last]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    chosen = blocks.select("first", "doc_ids", "doc_tokens", "checkpoints", "payload")
    return chosen.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'array<int>'}")


def round_trip(documents: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write a token file to the shared folder and read it back as digests."""
    folder = shared_folder(documents.sparkSession)
    write_token_file(documents, path, folder, end_id)
    return read_token_file(documents.sparkSession, folder, digest=True)
