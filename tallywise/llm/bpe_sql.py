"""Byte-level BPE encoding and decoding as recursive SQL.

Each Spark task opens an in-memory database of its own with two tables: the tokens and the merges,
one row for every way to split a token into two tokens. Words that the task has not seen before are
laid out as rows (word, pos, tok), one for each byte. A recursive query joins neighbours with the
merge table and contracts, in every word, the leftmost pair of the lowest rank, until no word has a
pair left. Ordered aggregation puts the rows of a word back together, as ids and as decoded bytes.

A text is cut before every blank or line break that follows a visible character. The pattern of
the vocabulary never matches across such a place, so the pieces can be looked up one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from tallywise.llm.common import chunks, cut_pieces, gathered, looked_up, safe_marks

WORDS_AT_ONCE = 40_000  # distinct words in one recursive query
REMEMBERED = 400_000  # pieces that a worker process keeps from batch to batch
CHARS_AT_ONCE = 4_000_000
# A row's place is word << 32 | pos, so that one order serves all words. A round holds all rows of the
# words that are not finished; k joins rank and position, so its minimum is the leftmost lowest pair.
CONTRACT = """
WITH RECURSIVE step AS (
    SELECT 0 AS round, place, tok FROM letters
    UNION ALL
    (WITH pairs AS (
        SELECT place, tok, lead(tok) OVER w AS nxt, lead(place) OVER w AS nxt_place
        FROM step WINDOW w AS (ORDER BY place)
    ), best AS (
        SELECT place >> 32 AS word, min(rank) AS rank, arg_min(place, k) AS place, arg_min(nxt_place, k) AS gone
        FROM (SELECT place, nxt_place, rank, (rank::BIGINT << 32) | (place & 4294967295) AS k
              FROM pairs JOIN merges ON pair = (tok::BIGINT << 32) + nxt
              WHERE nxt_place >> 32 = place >> 32)
        GROUP BY place >> 32
    )
    SELECT s.round + 1, s.place, CASE WHEN s.place = b.place THEN b.rank ELSE s.tok END
    FROM step s JOIN best b ON s.place >> 32 = b.word WHERE s.place <> b.gone)
), ended AS (
    SELECT place >> 32 AS word, max(round) AS round FROM step GROUP BY 1
)
SELECT s.place, s.tok FROM step s JOIN ended e ON s.place >> 32 = e.word AND s.round = e.round
"""
GATHER = """
SELECT string_agg(t.shown, ' ' ORDER BY e.place)
FROM encoded e JOIN tokens t ON t.id = e.tok GROUP BY e.place >> 32 ORDER BY e.place >> 32
"""


class Codec:
    """The vocabulary as database tables, and a bounded memory of words and pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.marks = safe_marks(lambda t: [m.start() for m in self.pattern.finditer(t)])
        merges = [
            (ranks[t[:k]], ranks[t[k:]], rank)
            for t, rank in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        pair = pa.array([(a << 32) + b for a, b, _ in merges], pa.int64())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self._table("merges", pair=pair, rank=pa.array([m[2] for m in merges], pa.int32()))
        ids = pa.array(list(ranks.values()), pa.int32())
        self._table("tokens", id=ids, shown=pa.array([f"{r}:{t.hex()}" for t, r in ranks.items()]))
        self.pieces: dict[bytes, tuple[int, bytes, bytes]] = {}

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given").fetchall()
        self.db.unregister("given")

    def words(self, words: list[bytes]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids joined by blanks, decoded bytes) of each word, none of them empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        cut = np.flatnonzero(whole < 0)
        octets = np.frombuffer(b"".join(words[i] for i in cut), np.uint8)
        first = np.cumsum(sizes[cut]) - sizes[cut]
        inside = np.arange(len(octets)) - np.repeat(first, sizes[cut])
        self._table(
            "letters",
            place=pa.array((np.repeat(cut, sizes[cut]) << 32) + inside),
            tok=pa.array(self.byte_ids[octets]),
        )
        self.db.execute(f"CREATE OR REPLACE TABLE encoded AS {CONTRACT}").fetchall()
        known = np.flatnonzero(whole >= 0)
        self._table("known", place=pa.array(known << 32), tok=pa.array(whole[known].astype(np.int32)))
        self.db.execute("INSERT INTO encoded SELECT * FROM known").fetchall()
        out = []
        for (row,) in self.db.execute(GATHER).fetchall():
            shown = [x.split(":") for x in row.split(" ")]
            out.append((len(shown), " ".join([x[0] for x in shown]), bytes.fromhex("".join([x[1] for x in shown]))))
        return out

    def learn(self, new: list[bytes]) -> dict[bytes, tuple[int, bytes, bytes]]:
        """Every piece with its number of ids, its ids, each after a blank, and its decoded bytes."""
        split = {}
        for piece in new:
            text = piece.decode("utf-8", "surrogatepass")
            whole = text[1:].isalpha() and text[0] == " "
            split[piece] = [piece] if whole else [w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(text)]
        distinct = list({w for words in split.values() for w in words})
        coded: dict[bytes, tuple[int, str, bytes]] = {}
        at = 0
        while at < len(distinct):
            part = distinct[at : at + WORDS_AT_ONCE]
            coded.update(zip(part, self.words(part)))
            at += len(part)
        out = {}
        for piece, words in split.items():
            found = [coded[w] for w in words]
            ids = "".join([" " + f[1] for f in found]).encode()
            out[piece] = sum([f[0] for f in found]), ids, b"".join([f[2] for f in found])
        return out

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, ids joined by blanks, decoded bytes) of each text."""
        pieces, index, firsts = cut_pieces(texts, self.marks)
        found = looked_up(pieces, self.pieces, self.learn, REMEMBERED)
        sizes = np.array([f[0] for f in found], np.int64)
        before = np.concatenate(([0], np.cumsum(sizes[index])))[firsts].tolist()
        ids, id_bounds = gathered([f[1] for f in found], index, firsts)
        decoded, decoded_bounds = gathered([f[2] for f in found], index, firsts)
        for i in range(len(firsts) - 1):
            shown = ids[id_bounds[i] + 1 : id_bounds[i + 1]].tobytes().decode()
            yield before[i + 1] - before[i], shown, decoded[decoded_bounds[i] : decoded_bounds[i + 1]].tobytes()


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, used by its tasks one after the other."""
    return Codec(path, pattern)


OUTPUTS = {
    "ids": ("string", lambda ids, decoded: ids),
    "decoded": ("binary", lambda ids, decoded: decoded),
    "ids_sha256": ("string", lambda ids, decoded: hashlib.sha256(ids.encode()).hexdigest()),
    "decoded_sha256": ("string", lambda ids, decoded: hashlib.sha256(decoded).hexdigest()),
}


def encoded(
    documents: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """One row per input row: (doc_id, n_tokens, the outputs). A null text is empty: no ids, no bytes.

    ids are decimal numbers joined by blanks, decoded the bytes that they stand for, and the outputs
    ending in _sha256 their digests. Repeated rows and null ids are rows like others; further columns
    are ignored. `path` names a file that every executor has, like the tokenizer's own package data.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in chunks(batches, "text", CHARS_AT_ONCE):
            n, values = [], [[] for _ in outputs]
            for count, ids, decoded in own.texts(pc.fill_null(part.column("text"), "")):
                n.append(count)
                for name, column in zip(outputs, values):
                    column.append(OUTPUTS[name][1](ids, decoded))
            kinds = [pa.binary() if OUTPUTS[o][0] == "binary" else pa.string() for o in outputs]
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, values, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *outputs])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *[f"{o} {OUTPUTS[o][0]}" for o in outputs]]))
