"""Reading tables, shared folders and numpy helpers used by several text operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
CHUNK_CHARS = 1_500_000


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tallywise_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = f"{tempfile.mkdtemp(prefix='tallywise-')}/{top.name}-package.zip"  # the driver serves it from here
    with zipfile.ZipFile(target, "w") as archive:
        for module in sorted(top.rglob("*.py")):
            archive.write(module, module.relative_to(top.parent))
    context.addPyFile(target)
    context._tallywise_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "tallywise-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends here, no task repeats its work."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_key(id_col: str, text_col: str) -> list[Column]:
    """Columns (doc_id, text_hash) that name a row by its content; repeated rows share them."""
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_hash"),
    ]


def join_documents(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the key columns, null ids too; the key columns of the right side are left out."""
    right = right.withColumnsRenamed({"doc_id": "other_id", "text_hash": "other_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash"))
    return left.join(right, same, how).drop("other_id", "other_hash")


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts hold about `limit` bytes together; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        sizes = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def plain_texts(batch: pa.RecordBatch, text: str) -> list[str]:
    return ["" if v is None else v for v in batch.column(text).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words.

    A worker process serves one operator after another, and a corpus has far more rare words than common
    ones: when the memory is full, all are forgotten, and those that are common come back at once.
    """

    LIMIT = 100_000

    def __missing__(self, word: bytes | str) -> int:
        value = xxhash.xxh64_intdigest(word, seed=7)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, width: int, step: int = STEP) -> np.ndarray:
    """Hash of every run of `width` values, by prefix sums modulo 2^64."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    inverse = pow(step, -1, 1 << 64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * powers(n, inverse), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(n - width + 1, step))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window that begins at one of the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def keyed_rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, key_id, key_hash): all columns as one, so that no name clashes, and the content key."""
    key, digest = text_key(id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    return documents.select(row, key.alias("key_id"), digest.alias("key_hash"))


def rows_by_key(documents: DataFrame, keys: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """Keyed rows with (left_semi) or without (left_anti) a partner among keys (doc_id, text_hash)."""
    keys = keys.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash")).distinct()
    same = F.col("key_id").eqNullSafe(F.col("other_id")) & (F.col("key_hash") == F.col("other_hash"))
    return keyed_rows(documents, id_col, text_col).join(keys, same, how)


OTHER_SPACE = re.compile(r"[^\S \n]")
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x0A]] = True
# bytes that other white space has or begins with; most of them also begin other characters
DOUBTFUL = np.zeros(256, bool)
DOUBTFUL[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def safe_marks(starts_of) -> bytes:
    """Those of , . ; : ! ? that a pattern always parts from an A-Z letter in front, whatever follows.

    `starts_of` gives the places where the pattern begins a new piece of a text.
    """
    safe = b""
    for mark in ",.;:!?":
        cases = [(a, a + mark + b) for a in ("a", "Z", " ab", "'s", "1a", ".a") for b in ("", " ", "\n", mark, "a", "1", "'", ". ")]
        if all(len(a) in starts_of(text) for a, text in cases):
            safe += mark.encode()
    return safe


def cut_pieces(texts: pa.Array, marks: bytes = b"") -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces of some texts, the number of each piece of all texts, and where each text's pieces begin.

    A text is cut before each run of blanks and line breaks after a visible character, and before each of
    the `marks` after an A-Z letter. A text that has other white space is one piece, an empty one has
    none. A byte-level pattern never matches across such a place: before it ends a word, and white space
    looks ahead only.
    """
    column = texts.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    octets = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.empty(0, np.uint8)
    begins = np.unique(bounds[:-1][np.diff(bounds) > 0])
    blank = BLANK[octets]
    cut = np.zeros(len(octets), bool)
    cut[1:] = blank[1:] & ~blank[:-1]
    if marks:
        is_mark = np.zeros(256, bool)
        is_mark[list(marks)] = True
        cut[1:] |= is_mark[octets[1:]] & LETTER[octets[:-1]]
    cut[: bounds[0]] = False
    doubtful = np.flatnonzero(DOUBTFUL[octets])
    for i in np.unique(np.searchsorted(bounds, doubtful, "right") - 1).tolist():
        if i >= 0 and OTHER_SPACE.search(octets[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "surrogatepass")):
            cut[bounds[i] : bounds[i + 1]] = False
    cut[begins] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, bounds[-1])
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), data or pa.py_buffer(b"")])
    coded = pieces.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
    return distinct, coded.indices.to_numpy(), np.searchsorted(starts, bounds)


def gathered(values: list[bytes], index: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the values of its pieces one after the other: all bytes, and where each text's begin and end."""
    held = np.frombuffer(b"".join(values), np.uint8)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    at = np.cumsum(sizes) - sizes
    long = sizes[index]
    ends = np.concatenate(([0], np.cumsum(long)))
    source = np.repeat(at[index] - ends[:-1], long)
    source += np.arange(ends[-1])
    return held[source], ends[firsts]


def looked_up(pieces: list[bytes], known: dict, learn, limit: int) -> list:
    """What `known` has for distinct pieces; new ones go to `learn` together."""
    found = list(map(known.get, pieces))
    new = [p for p, v in zip(pieces, found) if v is None]
    if not new:
        return found
    fresh = learn(new)
    if len(known) + len(fresh) <= limit:
        known.update(fresh)
    return [fresh[p] if v is None else v for p, v in zip(pieces, found)]
