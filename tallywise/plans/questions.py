"""Business questions about the retail tables: which analysis answers them, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise import fixed_values as fixed
from tallywise.functions.numbers import show, show_count
from tallywise.functions.sentences import sentence
from tallywise.functions.texts import mentions
from tallywise.operators.lattice import Lattice, lattice
from tallywise.operators.profile import union_all
from tallywise.plans import headlines
from tallywise.plans.findings import inventory_slots
from tallywise.sources.retail import RetailTables


def question_intent(question: Column | str) -> Column:
    """The analysis that answers a question: the first rule that applies decides.

    Narrow topics come before broad ones; one expression labels a whole table.
    """
    q = F.lower(F.trim(F.col(question) if isinstance(question, str) else question))

    def has(phrases: list[str]) -> Column:
        return mentions(q, phrases)

    profit = has(fixed.PROFIT_PHRASES) | has(fixed.STRONG_PROFIT_PHRASES)
    companion = (
        has(fixed.PLAIN_PROFIT_PHRASES)
        | has(fixed.STRONG_PROFIT_PHRASES)
        | has(fixed.REVENUE_PHRASES)
        | has(fixed.COMPARISON_PHRASES)
    )
    ranking = has(fixed.RANKING_PHRASES) & has(fixed.REVENUE_PHRASES + fixed.PROFIT_PHRASES)
    returns = has(fixed.RETURN_PHRASES) & ~has(fixed.NOT_RETURN_PHRASES)
    return (
        F.when(has(fixed.META_PHRASES), "meta_capabilities")
        .when(has(fixed.NON_BUSINESS_PHRASES), "out_of_scope")
        .when(has(fixed.EMPLOYEE_PHRASES), "employee_store_performance")
        .when(has(fixed.SEGMENT_PHRASES), "customer_segment_value")
        .when(has(fixed.MARKETING_PHRASES), "marketing_roi")
        .when(has(fixed.DELIVERY_PHRASES), "delivery_partner_performance")
        .when(has(fixed.INVENTORY_PHRASES), "inventory_imbalance")
        .when(has(fixed.TARGET_PHRASES), "target_attainment")
        .when(returns, "returns_by_category")
        .when(ranking, "revenue_profit_leaders")
        .when(profit & companion, "growth_vs_profitability")
        .otherwise("fallback_unmatched")
    )


def leader_dimension(question: Column | str) -> Column:
    """What a ranking question ranks."""
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    return (
        F.when(F.contains(q, F.lit("region")), "region")
        .when(F.contains(q, F.lit("store")), "store")
        .otherwise("category")
    )


def label_questions(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """Every question with its intent, and the dimension where the intent ranks one."""
    intent = question_intent(text_col)
    return questions.withColumn("intent", intent).withColumn(
        "dimension",
        F.when(F.col("intent") == "revenue_profit_leaders", leader_dimension(text_col)),
    )


def menu(spark: SparkSession) -> DataFrame:
    """The questions that can be asked, by business area."""
    rows = [
        (position, group, question)
        for position, (group, question) in enumerate(
            (g, q) for g, questions in fixed.QUESTION_GROUPS.items() for q in questions
        )
    ]
    return spark.createDataFrame(rows, "position int, area string, question string")


def _meta_answer() -> str:
    lines = [fixed.META_ANSWER_HEAD]
    for group, questions in fixed.QUESTION_GROUPS.items():
        lines += [f"\n**{group}**", *[f"- {q}" for q in questions]]
    return "\n".join([*lines, fixed.META_ANSWER_TAIL])


def _answer(facts: DataFrame, intent: str, text: Column, dimension: str | None = None) -> DataFrame:
    return facts.select(
        F.lit(intent).alias("intent"),
        F.lit(dimension).cast("string").alias("dimension"),
        text.alias("answer"),
    )


def _growth_answer(tables: RetailTables) -> DataFrame:
    slots = dict(
        rev_pct=show("revenue_pct", 1),
        gp_pct=show("gross_profit_pct", 1),
        margin_pp=show("margin_pp", 2, signed=True),
        days=show_count("window_days"),
    )
    text = F.when(
        F.col("margin_pressure"), sentence(fixed.GROWTH_PRESSURE_ANSWER, **slots)
    ).otherwise(sentence(fixed.GROWTH_STEADY_ANSWER, **slots))
    return _answer(headlines.profitability(tables), "growth_vs_profitability", text)


def _leaders_answer(tables: RetailTables, dimension: str) -> DataFrame:
    text = sentence(
        fixed.LEADERS_ANSWER,
        dimension=dimension,
        leader=F.col("leader"),
        revenue=show("revenue", 2, grouped=True),
        profit=show("gross_profit", 2, grouped=True),
        margin=show("margin_pct", 2),
    )
    return _answer(headlines.leader(tables, dimension), "revenue_profit_leaders", text, dimension)


def _target_answer(tables: RetailTables) -> DataFrame:
    slots = dict(
        month=F.col("month"),
        below=show_count("below"),
        stores=show_count("stores"),
        store=F.col("store_name"),
        attainment=show("revenue_attainment_pct", 1),
    )
    text = F.when(F.col("below") > 0, sentence(fixed.TARGET_MISSED_ANSWER, **slots)).otherwise(
        sentence(fixed.TARGET_MET_ANSWER, **slots)
    )
    return _answer(headlines.targets(tables), "target_attainment", text)


def answers(tables: RetailTables, summed: Lattice | None = None) -> DataFrame:
    """(intent, dimension, answer): one row per intent that has data behind it.

    Sales and returns are summed once for all answers, unless ``summed`` has them already.
    """
    summed = summed or lattice(tables)
    spark = tables.sales.sparkSession
    fixed_answers = spark.createDataFrame(
        [
            ("meta_capabilities", None, _meta_answer()),
            ("out_of_scope", None, fixed.OUT_OF_SCOPE_ANSWER),
            ("fallback_unmatched", None, fixed.UNMATCHED_ANSWER),
        ],
        "intent string, dimension string, answer string",
    )
    staff = sentence(
        fixed.EMPLOYEE_ANSWER,
        store=F.col("store_name"),
        per_employee=show("revenue_per_employee", 2, grouped=True),
        headcount=show_count("headcount"),
        margin=show("margin_pct", 2),
    )
    segment = sentence(
        fixed.SEGMENT_ANSWER,
        segment=F.col("customer_segment"),
        revenue=show("revenue", 2, grouped=True),
        margin=show("margin_pct", 2),
        customers=show_count("customers"),
        per_customer=show("revenue_per_customer", 2, grouped=True),
    )
    marketing = sentence(
        fixed.MARKETING_ANSWER,
        campaign=F.col("best_campaign"),
        roi=show("best_roi", 2),
        spend=show("best_spend", 2, grouped=True),
        revenue=show("best_revenue", 2, grouped=True),
    )
    delivery = sentence(
        fixed.DELIVERY_ANSWER,
        partner=F.col("partner_name"),
        rate=show("delayed_rate_pct", 1),
        rating=show("avg_rating", 2),
    )
    returns = sentence(
        fixed.RETURNS_ANSWER,
        category=F.col("category"),
        rate=show("return_rate_pct", 2),
        units=show_count("returned_units"),
        refund=show("refund_value", 2, grouped=True),
    )
    return union_all(
        [
            fixed_answers,
            _answer(headlines.store_team(summed.by_order), "employee_store_performance", staff),
            _answer(headlines.segment(summed.by_order), "customer_segment_value", segment),
            _answer(headlines.marketing(tables), "marketing_roi", marketing),
            _answer(headlines.delivery(tables), "delivery_partner_performance", delivery),
            _answer(
                headlines.inventory(tables),
                "inventory_imbalance",
                sentence(fixed.INVENTORY_ANSWER, **inventory_slots()),
            ),
            _target_answer(summed.by_order),
            _answer(headlines.returns(summed.by_product), "returns_by_category", returns),
            *[_leaders_answer(summed.by_order, d) for d in ("region", "store")],
            _leaders_answer(summed.by_product, "category"),
            _growth_answer(summed.by_order),
        ]
    )


def answer_questions(
    tables: RetailTables, questions: DataFrame, text_col: str = "question", summed: Lattice | None = None
) -> DataFrame:
    """Every question with its intent and answer.

    The answers are at most one row per intent and dimension (fifteen), whatever the
    data size, so they are broadcast and the questions stay where they are.
    """
    labelled = label_questions(questions, text_col)
    answer = answers(tables, summed).select(
        F.col("intent").alias("_intent"), F.col("dimension").alias("_dimension"), "answer"
    )
    matches = (F.col("intent") == F.col("_intent")) & F.col("dimension").eqNullSafe(F.col("_dimension"))
    return labelled.join(F.broadcast(answer), matches, "left").drop("_intent", "_dimension")
