"""Counts that describe the shape of a text, for quality rules and classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywise.llm.common import WORDS, chunks, covered, plain_texts, text_key, window_hashes

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_lines",
    "n_repeat_words",
    "n_distinct_words",
    "n_upper",
    "n_marks",
)


def counts(text: str) -> tuple[int, ...]:
    """The COUNTS of a text: words lie between blanks, tabs and line breaks; n_lines are lines with a word."""
    octets = text.encode()
    words = octets.split()
    lines = [line for line in octets.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) > REPEAT_WIDTH:
        _, inverse, times = np.unique(
            window_hashes(WORDS.of(words), REPEAT_WIDTH), return_inverse=True, return_counts=True
        )
        starts = np.flatnonzero(times[inverse] > 1)
        if len(starts):
            repeated = int(covered(starts, REPEAT_WIDTH, len(words)).sum())
    by_octet = np.bincount(np.frombuffer(octets, np.uint8), minlength=256)
    return (
        len(words),
        len(text) - int(sum(by_octet[ord(c)] for c in SPACES)),
        int(sum(by_octet[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated,
        len(set(words)),
        int(by_octet[65:91].sum()),
        int(by_octet[33] + by_octet[124]),
    )


def shapes(documents: DataFrame, *kept, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, the kept columns, COUNTS) of each row; a null text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = np.array([counts(t) for t in plain_texts(part, "text")], np.int64).reshape(-1, len(COUNTS))
            others = [c for c in part.schema.names if c != "text"]
            columns = [part.column(c) for c in others] + [pa.array(rows[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, [*others, *COUNTS])

    rows = documents.select(*text_key(id_col, text_col), *kept, F.col(text_col).cast("string").alias("text"))
    others = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{others}, {', '.join(f'{c} long' for c in COUNTS)}")
