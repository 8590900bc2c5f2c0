"""Quality rules whose cutoffs are certified on labelled documents.

Every rule rejects documents whose value lies over a cutoff. Cutoffs come from fixed grids. For each
stratum (language) and rule the labelled good documents are a holdout: how many of them a cutoff
rejects is binomial, and the cutoff is certified if the exact (Clopper-Pearson) upper bound of its
false rejection rate is at most the rule's share of `risk`. Within a rule the grid is tested from the
most lenient cutoff on and ends at the first that fails, so its cutoffs need no correction among
themselves; over the rules and strata the error probability is divided (Bonferroni). So with
probability 1 - `error`, no stratum loses more than `risk` of its good documents to the rules. Of the
certified cutoffs that one is used which removes most bad documents, a good document lost counting
as much as LOSS bad ones; without a gain the rule is not used in the stratum.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywise.llm.common import stored
from tallywise.llm.shape import shapes
from tallywise.llm.site_quality import labels_by_document, ratios

RISK = 0.05
ERROR = 0.05
LOSS = 20
GRID = 40  # cutoffs of each rule
# rule: value over which nothing is cut, value under which no cutoff lies; the grid is even between
RULES: dict[str, tuple[float, float]] = {
    "symbols": (0.6, 0.02),
    "marks": (0.4, 0.01),
    "upper": (0.9, 0.1),
    "repeated": (0.3, 0.02),
    "dup_lines": (0.9, 0.1),
    "word_length": (20.0, 8.0),
}
MIN_WORDS, REPEATED_PERCENT = 20, 30  # fixed base rule


def cutoff(rule: str, step: int) -> float:
    lenient, strict = RULES[rule]
    return lenient + (strict - lenient) * step / (GRID - 1)


def upper_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X; the upper bound of a rate is at most p iff this is at most the error."""
    if n == 0:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def _strictest(rule: str) -> Column:
    """The number of the cutoffs of a rule that reject a document: all those under its value."""
    lenient, strict = RULES[rule]
    place = (F.col(rule) - lenient) / (strict - lenient) * (GRID - 1)
    # cutoff number s rejects if the value is over it, that is for s > place
    return F.greatest(F.lit(0), F.least(F.lit(GRID), GRID - 1 - F.floor(place))).cast("int")


def certified(counts: pd.DataFrame, tests: int, risk: float = RISK, error: float = ERROR) -> pd.DataFrame:
    """The cutoff of each rule of one stratum from (rule, rejected by so many cutoffs, good, bad)."""
    out = []
    for rule in RULES:
        own = counts[counts["rule"] == rule].set_index("strength")[["good", "bad"]].reindex(range(GRID + 1), fill_value=0)
        n = int(own["good"].sum())
        best, gain = None, 0
        for step in range(GRID):  # cutoff `step` rejects what at least GRID - step cutoffs reject
            lost = int(own["good"][GRID - step :].sum())
            if upper_tail(lost, n, risk / len(RULES)) > error / tests:
                break
            own_gain = int(own["bad"][GRID - step :].sum()) - LOSS * lost
            if own_gain > gain:
                best, gain = cutoff(rule, step), own_gain
        out.append((counts["stratum"].iloc[0], rule, best))
    return pd.DataFrame(out, columns=["stratum", "rule", "cutoff"])


def judged(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """One row per input row: (doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rules).

    The base rule fails texts of fewer than 20 words, or with more than 30 % of their words in
    8-word windows that occur twice in the text. Null texts have no words; a null stratum is one of
    its own; without enough labels a stratum has no cutoffs and only the base rule works. Repeated
    rows are judged alike; conflicting labels make a document bad.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")
    counted = shapes(documents, stratum, id_col=id_col, text_col=text_col)
    values = ratios()
    counted = stored(counted)
    rows = counted.select("*", *[values[r].alias(r) for r in RULES])
    strengths = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _strictest(r).alias("strength")) for r in RULES]))
    holdout = rows.join(labels_by_document(labels), "doc_id").select("stratum", "good", strengths.alias("s"))
    holdout = holdout.groupBy("stratum", "s.rule", "s.strength").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")
    )
    holdout = stored(holdout)
    tests = max(1, holdout.select("stratum").distinct().count()) * len(RULES)
    cutoffs = holdout.groupBy("stratum").applyInPandas(
        lambda part: certified(part, tests, risk, error), "stratum string, rule string, cutoff double"
    )
    table = stored(cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")))
    table = table.select(F.col("stratum").alias("of"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    joined = rows.join(table, F.col("stratum") == F.col("of"), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    broken = F.filter(
        F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull()
    )
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (F.size(broken) == 0)).alias("kept"),
        broken.alias("failed_rules"),
    )
