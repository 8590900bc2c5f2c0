"""Document quality from the text and the site, by hierarchical empirical Bayes.

The shape of a text is described by ratios, each cut into bins. The share of good and bad labelled
documents in each bin gives the document's evidence, the sum of its log likelihood ratios. Sites are
judged by all their documents, labelled or not: the mean of the documents' own probabilities is a
host's estimate, which is drawn towards the global mean as if KAPPA further documents of average
quality were there; a path of the host is drawn towards the posterior of its host in the same way.
KAPPA is estimated from how much hosts differ beyond chance. The posterior of the path is the prior
of the document's evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.llm.common import rows_by_key, stored
from tallywise.llm.shape import shapes

# upper ends of the bins of each ratio; a value belongs to the first bin whose end it does not exceed
BINS: dict[str, tuple[float, ...]] = {
    "symbols": (0.0, 0.01, 0.03, 0.1, 0.2, 0.4),
    "marks": (0.0, 0.01, 0.03, 0.1, 0.2),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "repeated": (0.0, 0.05, 0.1, 0.2, 0.4, 0.7),
    "distinct": (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "dup_lines": (0.0, 0.05, 0.1, 0.2, 0.4),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
}
THRESHOLD = 0.1  # a clean document lost costs more than a poor one kept


def ratios() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "marks": F.col("n_marks") / chars,
        "upper": F.col("n_upper") / chars,
        "repeated": F.col("n_repeat_words") / words,
        "distinct": F.col("n_distinct_words") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "word_length": F.col("word_chars") / words,
    }


def _bin(value: Column, ends: tuple[float, ...]) -> Column:
    return sum((F.when(value > end, 1).otherwise(0) for end in ends), F.lit(0)).cast("int")


def labels_by_document(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, good): a document is good if all its labels are 1; rows with nulls are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good"))
    return known.dropna().groupBy("doc_id").agg(F.min("good").alias("good"))


def evidence(binned: DataFrame, labelled: DataFrame) -> tuple[dict[str, list[float]], float]:
    """Log likelihood ratios of every bin, and the log odds of a good document.

    One grouped aggregation; the result has as many rows as there are bins.
    """
    names = list(BINS)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names])).alias("p")
    rows = binned.join(labelled, "doc_id").select("good", pairs).groupBy("p.name", "p.bin")
    table = rows.agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect()
    ratio, odds = {}, 0.0
    for name in names:
        own = {r["bin"]: (r["good"], r["bad"]) for r in table if r["name"] == name}
        width = len(BINS[name]) + 1
        good, bad = (sum(v[i] for v in own.values()) for i in (0, 1))
        odds = math.log((good + 1) / (bad + 1))
        ratio[name] = [
            math.log((own.get(b, (0, 0))[0] + 0.5) / (good + 0.5 * width))
            - math.log((own.get(b, (0, 0))[1] + 0.5) / (bad + 0.5 * width))
            for b in range(width)
        ]
    return ratio, odds


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _strength(hosts: DataFrame, mean: float) -> float:
    """How many average documents a host's estimate is mixed with, by the method of moments."""
    rate = F.col("s") / F.col("n")
    row = hosts.agg(F.var_pop(rate), F.avg(1 / F.col("n"))).first()
    spread = (row[0] or 0.0) - mean * (1 - mean) * (row[1] or 0.0)
    return min(1e4, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e4


def site_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: (doc_id, text_hash, p_document, p_host, p_path, p_quality, kept).

    `kept` is false where p_quality is under the threshold. A host is the part of host_col before
    its first slash, a path the host with the rest of host_col and path_col; nulls are a host and a
    path of their own. Without any label every document has the same evidence and is kept. A null
    text has no words. Repeated rows count as documents of their own.
    """
    source = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    kept = [
        F.substring_index(source, "/", 1).alias("host"),
        F.concat_ws("/", source, F.coalesce(F.col(path_col).cast("string"), F.lit(""))).alias("path"),
    ]
    rows = shapes(documents, *kept, id_col=id_col, text_col=text_col)
    values = ratios()
    binned = rows.select("doc_id", "text_hash", "host", "path", *[_bin(values[n], BINS[n]).alias(n) for n in BINS])
    binned = stored(binned)
    ratio, odds = evidence(binned, labels_by_document(labels))
    total = F.lit(odds)
    for name in BINS:
        total = total + F.element_at(F.array(*[F.lit(x) for x in ratio[name]]), F.col(name) + 1)
    judged = binned.select("doc_id", "text_hash", "host", "path", (1 / (1 + F.exp(-total))).alias("p_document"))
    paths = stored(judged.groupBy("host", "path").agg(F.sum("p_document").alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = whole[0] / whole[1] if whole[1] else 0.5
    of_host, of_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select("host", ((F.col("s") + of_host * mean) / (F.col("n") + of_host)).alias("p_host"))
    drawn = (F.col("s") + of_path * F.col("p_host")) / (F.col("n") + of_path)
    sites = paths.join(hosts, "host").select("host", "path", "p_host", drawn.alias("p_path"))
    p = 1 / (1 + F.exp(-(_logit(F.col("p_document")) - odds + _logit(F.col("p_path")))))
    result = judged.join(sites, ["host", "path"]).withColumn("p_quality", p)
    return result.select(
        "doc_id", "text_hash", "p_document", "p_host", "p_path", "p_quality", (F.col("p_quality") >= threshold).alias("kept")
    )


def without_rejected(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, that the classifier keeps."""
    bad = site_quality(documents, labels, id_col, text_col).where("not kept")
    return rows_by_key(documents, bad, "left_anti", id_col, text_col).select("row.*")
