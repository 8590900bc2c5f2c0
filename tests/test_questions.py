"""Which analysis a question is routed to."""

from __future__ import annotations

import pytest

from tallywise.plans import questions

CASES = {
    "delivery_partner_performance": [
        "Which delivery partner has the highest delay rate?",
        "Is our delivery performance getting worse?",
        "Which delivery partners are associated with delays or poor customer ratings?",
        "Which delivery partner is underperforming?",
        "What should we investigate about our delivery partners?",
    ],
    "returns_by_category": [
        "Which category has the highest return rate?",
        "Are returns increasing?",
        "Which products have unusually high return rates?",
        "What should we do about high returns?",
    ],
    "marketing_roi": [
        "Which marketing campaign has the best ROI?",
        "Which marketing campaigns generate the best return on investment?",
        "Which campaign is underperforming on ROI?",
        "Should we invest more in marketing?",
    ],
    "customer_segment_value": [
        "What is the most valuable customer segment?",
        "Which customer segments are the most valuable?",
    ],
    "target_attainment": [
        "Which store misses its target the most?",
        "How many stores are missing their targets?",
        "Where is the business failing to meet its targets?",
        "What should management prioritize regarding targets?",
    ],
    "revenue_profit_leaders": [
        "Which category generates the most revenue?",
        "Which region generates the most profit?",
        "Which products, stores or regions generate the most revenue and profit?",
        "Which region generates the highest revenue?",
    ],
    "employee_store_performance": [
        "Which employees perform best?",
        "Which employees perform well based on both revenue and profitability?",
    ],
    "inventory_imbalance": [
        "Which products have stockout issues?",
        "Are we seeing more stockouts?",
        "Which stores are experiencing stockouts or excess inventory?",
        "Where should we focus to fix inventory problems?",
    ],
    "growth_vs_profitability": [
        "Is revenue growth leading to stronger profitability?",
        "Are we making more money?",
        "Is our profit keeping pace with revenue?",
        "Sales are up. Did profitability improve?",
        "Has our margin improved despite sales growth?",
        "Why did our margin decline?",
        "Is profitability improving alongside sales growth?",
        "Is there anything unusual about our margins?",
        "Sales dey go up, profit dey follow?",
        "Sales don go up, profit follow am?",
        "We dey gain abi we no dey gain?",
    ],
    "meta_capabilities": ["What can I ask?", "  WETIN I FIT ASK ", "What questions do you take about returns?"],
    "out_of_scope": ["What's the weather like today?", "Can you write a poem about profit margins?"],
    "fallback_unmatched": [
        "What is the meaning of life?",
        "What is our stock price?",
        "Can you fetch today's news headlines?",
        "",
    ],
}


def test_every_case(spark):
    asked = [(q, intent) for intent, qs in CASES.items() for q in qs]
    df = spark.createDataFrame(asked, "question string, expected string")
    wrong = questions.label_questions(df).filter("intent <> expected").collect()
    assert wrong == []


@pytest.mark.parametrize(
    ("question", "dimension"),
    [
        ("Which regions have the most revenue?", "region"),
        ("Which stores bring the most profit?", "store"),
        ("Which products, stores or regions generate the most revenue?", "region"),
        ("Which category generates the most revenue?", "category"),
    ],
)
def test_ranked_dimension(spark, question, dimension):
    df = questions.label_questions(spark.createDataFrame([(question,)], "question string"))
    row = df.first()
    assert (row.intent, row.dimension) == ("revenue_profit_leaders", dimension)


def test_every_menu_question_is_answerable(spark):
    labelled = questions.label_questions(questions.menu(spark)).collect()
    assert len(labelled) == 9
    assert not {r.intent for r in labelled} & set(questions.fixed.DECLINED_INTENTS)


def test_missing_question_text(spark):
    df = spark.createDataFrame([(None,)], "question string")
    assert questions.label_questions(df).first().intent == "fallback_unmatched"
