"""Findings and answers for any table whose columns were mapped to concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise import fixed_values as fixed
from tallywise.functions.numbers import show, show_count
from tallywise.functions.sentences import sentence
from tallywise.functions.texts import mentions
from tallywise.operators.generic import breakdown, growth_comparison, kpi_summary, returns_summary
from tallywise.operators.mapping import capabilities, missing_requirements
from tallywise.operators.profile import union_all

_TOP_DIMENSIONS = {
    "product": "Product performance",
    "customer": "Customer analysis",
    "category": "Category breakdown",
}


def _finding(
    facts: DataFrame,
    ordinal: int,
    finding_id: str,
    title: str,
    category: str,
    severity: Column,
    summary: Column,
    advice: Column,
) -> DataFrame:
    return facts.select(
        F.lit(ordinal).alias("ordinal"),
        F.lit(finding_id).alias("finding_id"),
        F.lit(title).alias("title"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        summary.alias("summary"),
        advice.alias("recommendation"),
        F.lit("high").alias("confidence"),
    )


def _top_finding(frame: DataFrame, dimension: str, ordinal: int) -> DataFrame:
    top = breakdown(frame, dimension, top_n=1)
    name = F.col(dimension).cast("string")
    summary = sentence(fixed.USER_TOP_SUMMARY, top=name, revenue=show("revenue", 2, grouped=True))
    if "margin_pct" in top.columns:
        summary = F.concat(summary, sentence(fixed.USER_TOP_MARGIN, margin=show("margin_pct", 1)))
    return _finding(
        top,
        ordinal,
        f"user_top_{dimension}",
        f"Top {dimension.capitalize()} by Revenue",
        dimension,
        F.lit("info"),
        F.concat(summary, F.lit(".")),
        sentence(fixed.USER_TOP_ADVICE, top=name),
    )


def user_findings(frame: DataFrame) -> DataFrame | None:
    """What the mapped concepts allow to be found, in a fixed order; None if nothing."""
    able = capabilities(frame.columns)
    found = []
    if able["Revenue trend over time"] and able["Profitability"]:
        growth = growth_comparison(frame).filter(
            "revenue_pct_change is not null and profit_pct_change is not null"
        )
        pressed = F.col("growth_gap_pp") > fixed.GROWTH_GAP_LIMIT_PP
        found.append(
            _finding(
                growth,
                0,
                "user_growth_gap",
                "Revenue vs. Profit Growth",
                "profitability",
                F.when(pressed, "warning").otherwise("info"),
                sentence(
                    fixed.USER_GROWTH_SUMMARY,
                    rev_pct=show("revenue_pct_change", 1, signed=True),
                    profit_pct=show("profit_pct_change", 1, signed=True),
                    days=show_count("window_days"),
                ),
                F.when(pressed, fixed.USER_GROWTH_PRESSURE_ADVICE).otherwise(
                    fixed.USER_GROWTH_STEADY_ADVICE
                ),
            )
        )
    for ordinal, (dimension, analysis) in enumerate(_TOP_DIMENSIONS.items(), start=1):
        if able[analysis]:
            found.append(_top_finding(frame, dimension, ordinal))
    if able["Returns analysis"]:
        high = F.col("return_rate_pct") > fixed.HIGH_RETURN_RATE_PCT
        found.append(
            _finding(
                returns_summary(frame),
                4,
                "user_returns",
                "Return Rate",
                "returns",
                F.when(high, "warning").otherwise("info"),
                sentence(
                    fixed.USER_RETURNS_SUMMARY,
                    rate=show("return_rate_pct", 2),
                    records=show_count("total_records", grouped=True),
                ),
                F.when(high, fixed.USER_RETURNS_HIGH_ADVICE).otherwise(
                    fixed.USER_RETURNS_NORMAL_ADVICE
                ),
            )
        )
    return union_all(found).orderBy("ordinal") if found else None


def _routes(concepts: list[str]) -> list[tuple[list[str], str, str, bool]]:
    """(phrases, intent, analysis, supported) in the order the rules are tried."""
    able = capabilities(concepts)
    routes = [(fixed.USER_PROFIT_PHRASES, "profitability", "Profitability", able["Profitability"])]
    for dimension, analysis, phrases in fixed.USER_DIMENSION_PHRASES:
        supported = able[analysis] and dimension in concepts
        routes.append((phrases, f"breakdown_{dimension}", analysis, supported))
    routes.append((fixed.USER_RETURN_PHRASES, "returns", "Returns analysis", able["Returns analysis"]))
    routes.append(
        (fixed.USER_REVENUE_PHRASES, "kpi_overview", "Revenue trend over time", "revenue" in concepts)
    )
    return routes


def label_user_questions(
    questions: DataFrame, concepts: list[str], text_col: str = "question"
) -> DataFrame:
    """Every question with its intent, whether the data supports it, and the analysis."""
    q = F.lower(F.trim(F.col(text_col)))
    routes = _routes(concepts)
    route = F.when(mentions(q, fixed.USER_META_PHRASES), F.lit(-1))
    for position, (phrases, *_) in enumerate(routes):
        route = route.when(mentions(q, phrases), F.lit(position))
    route = route.otherwise(F.lit(len(routes)))
    intents = ["meta_capabilities"] + [
        intent if supported else "unsupported" for _, intent, _, supported in routes
    ]
    analyses = [None] + [analysis for _, _, analysis, _ in routes]
    supported = [True] + [ok for *_, ok in routes]

    def pick(values: list, last) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in [*values, last]]), F.col("_route") + 2)

    return (
        questions.withColumn("_route", route)
        .withColumn("intent", pick(intents, "fallback"))
        .withColumn("supported", pick(supported, False))
        .withColumn("analysis", pick(analyses, None).cast("string"))
        .drop("_route")
    )


def supported_questions(spark: SparkSession, concepts: list[str]) -> DataFrame:
    """Example questions for the analyses these concepts allow."""
    able = capabilities(concepts)
    rows = [
        (analysis, question)
        for analysis, questions in fixed.ANALYSIS_QUESTIONS.items()
        if able[analysis]
        for question in questions
    ]
    return spark.createDataFrame(rows, "analysis string, question string")


def _meta_answer(able: dict[str, bool]) -> str:
    supported = [name for name, ok in able.items() if ok]
    missing = [name for name, ok in able.items() if not ok]
    if not supported:
        return fixed.USER_META_NONE
    lines = [fixed.USER_META_HEAD]
    lines += [f"- {q}" for name in supported for q in fixed.ANALYSIS_QUESTIONS[name]]
    if missing:
        lines.append(fixed.USER_META_MISSING.format(missing=", ".join(missing)))
    return "\n".join(lines)


def _fallback_answer(able: dict[str, bool]) -> str:
    supported = [name for name, ok in able.items() if ok]
    tail = (
        fixed.USER_FALLBACK_SOME.format(supported=", ".join(supported))
        if supported
        else fixed.USER_FALLBACK_NONE
    )
    return fixed.USER_FALLBACK_HEAD + tail


def _computed_answer(frame: DataFrame, intent: str) -> DataFrame:
    if intent == "profitability":
        growth = growth_comparison(frame)
        if growth is None:
            return frame.sparkSession.createDataFrame([(fixed.USER_PROFIT_NO_DATES,)], "answer string")
        profit = show("profit_pct_change", 1, signed=True)
        return growth.select(
            sentence(
                fixed.USER_PROFIT_ANSWER,
                rev_pct=show("revenue_pct_change", 1, signed=True),
                profit_pct=profit,
                days=show_count("window_days"),
            ).alias("answer")
        )
    if intent == "returns":
        return returns_summary(frame).select(
            sentence(
                fixed.USER_RETURNS_SUMMARY,
                rate=show("return_rate_pct", 2),
                records=show_count("total_records", grouped=True),
            ).alias("answer")
        )
    if intent == "kpi_overview":
        kpi = kpi_summary(frame)
        text = sentence(
            fixed.USER_REVENUE_ANSWER,
            revenue=show("revenue", 2, grouped=True),
            records=show_count("records", grouped=True),
        )
        if "profit" in kpi.columns:
            text = F.concat(
                text,
                sentence(
                    fixed.USER_REVENUE_PROFIT,
                    profit=show("profit", 2, grouped=True),
                    margin=show("margin_pct", 1),
                ),
            )
        return kpi.select(text.alias("answer"))
    dimension = intent.removeprefix("breakdown_")
    return breakdown(frame, dimension, top_n=1).select(
        sentence(
            fixed.USER_TOP_ANSWER,
            top=F.col(dimension).cast("string"),
            revenue=show("revenue", 2, grouped=True),
        ).alias("answer")
    )


def user_answers(frame: DataFrame) -> DataFrame:
    """(intent, analysis, answer) for every intent a question can get on this frame."""
    spark, concepts = frame.sparkSession, list(frame.columns)
    able = capabilities(concepts)
    constant = [
        ("meta_capabilities", None, _meta_answer(able)),
        ("fallback", None, _fallback_answer(able)),
    ]
    parts = []
    for _, intent, analysis, supported in _routes(concepts):
        if supported:
            computed = _computed_answer(frame, intent)
            parts.append(computed.select(F.lit(intent).alias("intent"), F.lit(analysis).alias("analysis"), "answer"))
            continue
        needed = ", ".join(missing_requirements(analysis, concepts)) or "additional columns"
        text = fixed.USER_UNSUPPORTED.format(label=analysis, needed=needed)
        if ("unsupported", analysis, text) not in constant:
            constant.append(("unsupported", analysis, text))
    head = spark.createDataFrame(constant, "intent string, analysis string, answer string")
    return union_all([head, *parts])


def answer_user_questions(
    frame: DataFrame, questions: DataFrame, text_col: str = "question"
) -> DataFrame:
    """Every question with intent, support and answer.

    There is at most one answer row per intent and analysis (a fixed list), so the
    answers are broadcast and the questions are not moved.
    """
    labelled = label_user_questions(questions, list(frame.columns), text_col)
    answer = user_answers(frame).select(
        F.col("intent").alias("_intent"), F.col("analysis").alias("_analysis"), "answer"
    )
    matches = (F.col("intent") == F.col("_intent")) & F.col("analysis").eqNullSafe(F.col("_analysis"))
    undated = F.when(F.col("intent") == "profitability", fixed.USER_PROFIT_NO_DATES)
    return (
        labelled.join(F.broadcast(answer), matches, "left")
        .withColumn("answer", F.coalesce("answer", undated))
        .drop("_intent", "_analysis")
    )
