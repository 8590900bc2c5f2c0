"""Secrets in texts, found through a trigram index. Built-in Spark functions only.

From each rule's regular expression a Boolean query over trigrams is derived: a sequence needs the
trigrams of all its parts, an alternative those of one branch, and short sets of characters are
spelled out. The postings table has a row (trigram, document) for every trigram of a query that a
document holds; the postings of a document are intersected and united as the queries say, which
leaves the candidates of each rule. The expressions run on candidates only. A rule whose expression
has no mandatory trigram, like a run of hexadecimal digits, runs on all texts.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F
from re import _constants as op, _parser as parser

from tallywise.llm.common import join_documents, text_key

Query = frozenset  # of alternatives, each a frozenset of trigrams; the empty alternative is always true

# fixed patterns: kind, expression, either case, group whose length counts, least length. A run that is
# matched whole and dropped if short is written with its least length, which matches the same places.
BASE_RULES = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", False, 0, 18),
    ("hex", r"[0-9a-f]{16,}", False, 0, 16),
)
MORE_RULES = (
    ("github", r"gh[opsu]_[A-Za-z0-9]+", False, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 15),
    ("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 20),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 1),
)
RULES = (*BASE_RULES, *MORE_RULES)
SPELLED = 8  # sets of up to so many characters are spelled out
ALTERNATIVES = 64  # a query of more alternatives counts as none
BLOCK = 256  # matches of a text that are added up together, so that work grows in proportion to them

TRUE: Query = Query([frozenset()])


def _both(a: Query, b: Query) -> Query:
    joined = {x | y for x in a for y in b}
    return Query(x for x in joined if not any(y < x for y in joined))


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(item) -> list[str] | None:
    """What one element of an expression can match, if these are few short strings."""
    kind, value = item
    if kind is op.LITERAL:
        return [chr(value)]
    if kind is op.IN:
        out = []
        for what, x in value:
            if what is op.LITERAL:
                out.append(chr(x))
            elif what is op.RANGE and x[1] - x[0] < SPELLED:
                out += [chr(c) for c in range(x[0], x[1] + 1)]
            else:
                return None
        return out if len(out) <= SPELLED else None
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] == 1 and len(value[2]) == 1:
        inner = _strings(value[2][0])
        return None if inner is None else [*inner, *([""] if value[0] == 0 else [])]
    return None


def _query(items) -> Query:
    found, spelled = TRUE, [""]

    def closed() -> Query:
        return Query(_trigrams(s) for s in spelled)

    for item in items:
        kind, value = item
        strings = _strings(item)
        if strings is not None and len(spelled) * len(strings) <= ALTERNATIVES:
            spelled = [a + b for a, b in product(spelled, strings)]
            continue
        found, spelled = _both(found, closed()), [""]
        if kind is op.SUBPATTERN:
            found = _both(found, _query(value[3]))
        elif kind is op.BRANCH:
            found = _both(found, Query(x for branch in value[1] for x in _query(branch)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            found = _both(found, _query(value[2]))
    found = _both(found, closed())
    return found if len(found) <= ALTERNATIVES else TRUE


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams of which a text that matches holds one alternative whole.

    The index is in lower case, so it serves expressions of either case and of given case alike.
    """
    query = Query(frozenset(t.lower() for t in part) for part in _query(parser.parse(pattern)))
    return TRUE if frozenset() in query else query


def _holds(query: Query, found: Column) -> Column:
    out = F.lit(False)
    for part in sorted(map(sorted, query)):
        one = F.lit(True)
        for t in part:
            one = one & F.array_contains(found, t)
        out = out | one
    return out


def _spans(text: Column, rule) -> Column:
    """array<struct<start, at, kind, end>> of the matches that are long enough; code points, end exclusive."""
    kind, pattern, either_case, group, least = rule
    pattern = f"(?i){pattern}" if either_case else pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(whole, lambda x: F.length(x).cast("long"))
    matches = F.arrays_zip(
        F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), F.transform(counted, F.length).alias("counted")
    )
    number = [r[0] for r in RULES].index(kind)
    empty = F.array().cast("array<struct<start:long,at:int,kind:string,end:long>>")

    def step(state: Column, match: Column) -> Column:
        start = state["place"] + match["gap"]
        end = start + match["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("at"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.when(match["counted"] >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("place"), kept.alias("spans"))

    def add(state: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(state["place"].alias("place"), empty.alias("spans")),
            step,
            lambda own: F.struct(own["place"].alias("place"), F.concat(state["blocks"], F.array(own["spans"])).alias("blocks")),
        )

    def blocks(found: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor(F.size(found) / BLOCK).cast("int"))
        return F.transform(number, lambda i: F.slice(found, i * BLOCK + 1, F.lit(BLOCK)))

    none = F.array().cast("array<array<struct<start:long,at:int,kind:string,end:long>>>")
    start = F.struct(F.lit(0).cast("long").alias("place"), none.alias("blocks"))
    # an array of one binds the matches to a name, so the expression runs once
    whole = F.transform(
        F.array(matches), lambda found: F.aggregate(blocks(found), start, add, lambda state: F.flatten(state["blocks"]))
    )
    return whole[0]


def _shown(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, rules): the rules whose query a document's postings satisfy; none, no row."""
    queries = {r[0]: trigram_query(r[1]) for r in RULES}
    indexed = {k: q for k, q in queries.items() if q != TRUE}
    wanted = sorted({t for q in indexed.values() for part in q for t in part})
    held = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("lowered"), t))
    lowered = F.lower("text").alias("lowered")
    postings = rows.select("doc_id", "text_hash", lowered).select("doc_id", "text_hash", F.explode(held).alias("trigram"))
    found = postings.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("found"))
    rules = F.filter(
        F.array(*[F.when(_holds(q, F.col("found")), F.lit(k)) for k, q in indexed.items()]), lambda x: x.isNotNull()
    )
    return found.select("doc_id", "text_hash", rules.alias("rules")).where(F.size("rules") > 0)


def _matches(rows: DataFrame) -> DataFrame:
    """The rows without their text, and a column of_<kind> with the spans of each rule."""
    joined = join_documents(rows, candidates(rows), "left")
    none = F.array().cast("array<struct<start:long,at:int,kind:string,end:long>>")
    columns = []
    for rule in RULES:
        spans = _spans(F.col("text"), rule)
        if trigram_query(rule[1]) != TRUE:
            spans = F.when(F.array_contains("rules", rule[0]), spans).otherwise(none)
        columns.append(spans.alias(f"of_{rule[0]}"))
    return joined.select(*[c for c in rows.columns if c != "text"], *columns)


def scanned(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, text_hash, n_assign, n_access, n_hex, base_spans, spans).

    base_spans are those of the base rules, spans those of all rules: texts `kind:start:end` in code
    points, end exclusive, by start and then in the order of the rules, joined by commas. A null text
    is empty. Repeated rows and rows with a null id are scanned like others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _matches(documents.select(*text_key(id_col, text_col), text.alias("text")))
    base = F.array_sort(F.concat(*[F.col(f"of_{r[0]}") for r in BASE_RULES]))
    whole = F.array_sort(F.concat(*[F.col(f"of_{r[0]}") for r in RULES]))
    return found.select(
        "doc_id",
        "text_hash",
        *[F.size(f"of_{r[0]}").cast("long").alias(f"n_{r[0]}") for r in BASE_RULES],
        _shown(base).alias("base_spans"),
        _shown(whole).alias("spans"),
    )


def without_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, with every secret's characters replaced by `[kind]`.

    Overlapping spans become one replacement, named after the first. The index finds the candidates
    as in `scanned`. Texts without a secret stay as they are, nulls too.
    """
    names = documents.columns
    spans = F.col("whole")
    text = F.col("row").getField(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    searched = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _matches(documents.select(*text_key(id_col, text_col), searched.alias("text"), row))
    found = found.select("row", F.array_sort(F.concat(*[F.col(f"of_{r[0]}") for r in RULES])).alias("whole"))
    empty = F.struct(F.lit(0).cast("long").alias("place"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(s["start"], state["place"])
        gap = F.substring(text, (state["place"] + 1).cast("int"), (start - state["place"]).cast("int"))
        mark = F.when(s["start"] >= state["place"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["end"], state["place"]).alias("place"), F.concat(state["out"], gap, mark).alias("out"))

    clean = F.aggregate(
        spans,
        empty,
        step,
        lambda state: F.concat(state["out"], F.substring(text, (state["place"] + 1).cast("int"), F.length(text))),
    )
    clean = F.when(F.size(spans) == 0, text).otherwise(clean)
    return found.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names])
