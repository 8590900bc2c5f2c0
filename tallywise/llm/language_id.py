"""Language identification by nearest centroid.

A text is a vector of TF-IDF weights of the pairs and triples of its letters, hashed to a fixed number of
slots and brought to length one. Each language has several centroids, found by spherical k-means over
some of its texts. A text gets the language of the centroid of greatest cosine; if it is further from
that centroid than nearly all texts of the language were, it is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tallywise.llm.common import chunks, plain_texts, stored

SLOTS = 1 << 12
CENTROIDS = 4
FIT_ROWS = 400  # texts of each language that centroids are fitted to, at most about so many
AT_ONCE = 1 << 20  # characters whose pairs and triples are counted together
REJECTED = 0.005  # share of a language's own texts that lie beyond its distance
LETTER = regex.compile(r"\p{L}")
IS_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
UNKNOWN = "und"


def slot_counts(texts: list[str]) -> np.ndarray:
    """How often the pairs and triples of letters fall into each slot; all else counts as one blank."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for i, text in enumerate(texts):
        lowered = text.lower()
        for at in range(0, len(lowered), AT_ONCE):  # two characters overlap, so no triple is lost
            points = np.frombuffer(lowered[at : at + AT_ONCE + 2].encode("utf-32-le", "surrogatepass"), "<u4")
            points = np.where(IS_LETTER[points], points, np.uint32(32))
            points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
            pairs = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
            triples = points[:-2] * np.uint32(0xC2B2AE3D) + points[1:-1] * np.uint32(0x27D4EB2F)
            triples = (triples + points[2:] * np.uint32(0x165667B1)) * np.uint32(0x9E3779B1)
            for hashed in ((pairs * np.uint32(0x27D4EB2F)) >> np.uint32(20), triples >> np.uint32(20)):
                out[i] += np.bincount(hashed, minlength=SLOTS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def spherical_means(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means by cosine, begun with texts far from each other; empty clusters are left out."""
    mean = rows.mean(axis=0)
    centers = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centers) < min(k, len(rows)):
        centers.append(rows[np.argmin((rows @ np.array(centers).T).max(axis=1))])
    centroids = np.array(centers)
    for _ in range(12):
        nearest = np.argmax(rows @ centroids.T, axis=1)
        moved = np.array([rows[nearest == c].mean(axis=0) for c in range(len(centroids)) if (nearest == c).any()])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if moved.shape == centroids.shape and np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each slot occurs, and last the number of texts; SLOTS + 1 rows reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for part in chunks(batches, "text"):
            rows = plain_texts(part, "text")
            for at in range(0, len(rows), 256):
                total[:-1] += (slot_counts(rows[at : at + 256]) > 0).sum(axis=0)
            total[-1] += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(total)], ["slot", "n"])

    counted = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[counted["slot"]] = counted["n"]
    return out


class Model:
    """Centroids with their languages and least cosines, and the weights of the slots."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), 256):
            group = texts[at : at + 256]
            known = [bool(LETTER.search(t)) and len(self.langs) > 0 for t in group]
            if not any(known):
                out += [(UNKNOWN, 0.0, True)] * len(group)
                continue
            cosines = vectors(slot_counts(group), self.idf) @ self.centroids.T
            best = np.argmax(cosines, axis=1)
            top = np.clip(cosines[np.arange(len(group)), best], 0.0, 1.0)
            out += [
                (self.langs[b], float(t), bool(t < self.least[b])) if ok else (UNKNOWN, 0.0, True)
                for ok, b, t in zip(known, best.tolist(), top.tolist())
            ]
        return out


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """A model from rows (doc_id, text, lang); rows with a null lang, or a text without a letter, teach nothing.

    Slot weights are counted over all rows. Centroids are fitted to about `fit_rows` texts of each
    language, chosen by a hash of their content, whole texts in one task for each language.
    """
    rows = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    frequencies = document_frequencies(rows.select("text"))
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])).astype(np.float32) + np.float32(1)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("n"))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(stored(sizes.select("lang", share.alias("share"))), "lang").where(draw < F.col("share"))

    def means(part: pd.DataFrame) -> pd.DataFrame:
        own = vectors(slot_counts(part.sort_values(["doc_id", "text"])["text"].tolist()), idf)
        found = spherical_means(own, centroids)
        least = float(np.quantile((own @ found.T).max(axis=1), REJECTED)) * 0.9
        return pd.DataFrame({"lang": part["lang"].iloc[0], "least": least, "centroid": [c.tolist() for c in found]})

    fitted = chosen.select("lang", "doc_id", "text").groupBy("lang")
    table = fitted.applyInPandas(means, "lang string, least double, centroid array<float>").toPandas()
    if table.empty:
        return Model(idf, [], np.zeros((0, SLOTS), np.float32), np.zeros(0))
    table["order"] = table["centroid"].map(tuple)
    table = table.sort_values(["lang", "order"])
    return Model(idf, table["lang"].tolist(), np.array(table["centroid"].tolist(), np.float32), table["least"].to_numpy())


def predicted(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, lang_pred, score, rejected).

    score is the cosine with the nearest centroid, 0 to 1; of equal cosines the first language in
    order of names wins. A null text, or one without a letter, is `und` with score 0; so is every
    text if the model has no language. Repeated rows are predicted alike.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = shared.value.predict(plain_texts(part, "text"))
            langs, scores, rejected = (list(c) for c in zip(*rows))
            columns = [part.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
