"""Ranked findings over the retail tables, and the evidence behind them.

A finding is a row. Its evidence is kept as rows of its own, one per record, so the
amount of evidence is not limited by what fits into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise import fixed_values as fixed
from tallywise.functions.numbers import show, show_count
from tallywise.functions.sentences import sentence
from tallywise.operators.delivery import delivery_performance
from tallywise.operators.grounding import record_entity, record_measures, record_numbers
from tallywise.operators.inventory import excess_hotspots, inventory_imbalance, stockout_hotspots
from tallywise.operators.kpi import growth_gap
from tallywise.operators.lattice import Lattice, lattice
from tallywise.operators.marketing import campaign_roi
from tallywise.operators.profile import union_all
from tallywise.operators.returns import return_analysis, return_reasons
from tallywise.operators.stats import zscore_outliers
from tallywise.operators.targets import target_vs_actual
from tallywise.plans import headlines
from tallywise.sources.retail import RetailTables


def severity_rank(severity: Column) -> Column:
    rank = F.lit(fixed.UNKNOWN_SEVERITY_RANK)
    for name, value in fixed.SEVERITY_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def _texts(*texts: Column | str | None) -> Column:
    items = [F.lit(t) if isinstance(t, str) else t for t in texts]
    return F.array(*items).cast("array<string>")


def _finding(
    facts: DataFrame, topic: str, severity: Column, summary: Column, advice: Column, drivers: Column
) -> DataFrame:
    finding_id, title = fixed.FINDING_HEADS[topic]
    return facts.select(
        F.lit(list(fixed.FINDING_HEADS).index(topic)).alias("ordinal"),
        F.lit(finding_id).alias("finding_id"),
        F.lit(title).alias("title"),
        F.lit(topic).alias("category"),
        severity.alias("severity"),
        summary.alias("summary"),
        advice.alias("recommendation"),
        drivers.alias("possible_drivers"),
        F.lit(fixed.FINDING_CONFIDENCE[topic]).alias("confidence"),
    )


def profitability_finding(tables: RetailTables, window_days: int = fixed.WINDOW_DAYS) -> DataFrame:
    slots = dict(
        rev_pct=show("revenue_pct", 1),
        gp_pct=show("gross_profit_pct", 1),
        margin_pp=show("margin_pp", 2, signed=True),
        days=str(window_days),
    )
    pressed = F.col("margin_pressure")
    return _finding(
        headlines.profitability(tables, window_days),
        "profitability",
        F.when(pressed, "warning").otherwise("info"),
        F.when(
            pressed,
            sentence(
                fixed.PROFIT_PRESSURE_SUMMARY,
                prev_margin=show("previous_margin_pct", 2),
                margin=show("latest_margin_pct", 2),
                **slots,
            ),
        ).otherwise(sentence(fixed.PROFIT_STEADY_SUMMARY, **slots)),
        F.when(pressed, fixed.PROFIT_PRESSURE_ADVICE).otherwise(fixed.PROFIT_STEADY_ADVICE),
        F.when(pressed, _texts(*fixed.PROFIT_PRESSURE_DRIVERS)).otherwise(_texts()),
    )


def returns_finding(tables: RetailTables) -> DataFrame:
    category, reason, high = F.col("category"), F.col("top_reason"), F.col("is_outlier")
    summary = sentence(
        fixed.RETURNS_SUMMARY,
        category=category,
        rate=show("return_rate_pct", 2),
        units=show_count("returned_units"),
        refund=show("refund_value", 2, grouped=True),
        zscore=show("zscore", 2),
        categories=show_count("rivals"),
    )
    named = F.when(reason.isNotNull(), sentence(fixed.RETURNS_REASON_SUMMARY, reason=reason))
    noted = F.when(reason.isNotNull(), sentence(fixed.RETURNS_REASON_NOTE, reason=reason))
    return _finding(
        headlines.returns(tables),
        "returns",
        F.when(high, "warning").otherwise("info"),
        F.concat(summary, F.coalesce(named, F.lit(""))),
        F.when(
            high,
            sentence(
                fixed.RETURNS_HIGH_ADVICE,
                category=category,
                reason=F.coalesce(reason, F.lit("None")),
            ),
        ).otherwise(fixed.RETURNS_NORMAL_ADVICE),
        F.when(
            high,
            _texts(
                sentence(fixed.RETURNS_QUALITY_DRIVER, category=category, reason_note=noted),
                fixed.RETURNS_LISTING_DRIVER,
            ),
        ).otherwise(_texts()),
    )


def delivery_finding(tables: RetailTables) -> DataFrame:
    partner, outlier = F.col("partner_name"), F.col("is_outlier")
    critical = outlier & (F.col("delayed_rate_pct") > fixed.CRITICAL_DELAY_RATE_PCT)
    return _finding(
        headlines.delivery(tables),
        "delivery",
        F.when(critical, "critical").when(outlier, "warning").otherwise("info"),
        sentence(
            fixed.DELIVERY_SUMMARY,
            partner=partner,
            partner_id=F.col("delivery_partner_id"),
            rate=show("delayed_rate_pct", 1),
            rating=show("avg_rating", 2),
            others=show("others_avg", 1),
            n_others=show_count(F.col("rivals") - 1),
        ),
        F.when(outlier, sentence(fixed.DELIVERY_GAP_ADVICE, partner=partner)).otherwise(
            fixed.DELIVERY_NORMAL_ADVICE
        ),
        F.when(outlier, _texts(sentence(fixed.DELIVERY_DRIVER, partner=partner))).otherwise(_texts()),
    )


def inventory_slots() -> dict[str, Column]:
    return dict(
        out_category=F.col("top_stockout_category"),
        out_days=show_count("top_stockout_category_days"),
        out_pairs=show_count("affected_store_product_pairs_stockout"),
        over_category=F.col("top_excess_category"),
        over_days=show_count("top_excess_category_days"),
        over_pairs=show_count("affected_store_product_pairs_excess"),
    )


def inventory_finding(tables: RetailTables) -> DataFrame:
    signal, slots = F.col("has_signal"), inventory_slots()
    return _finding(
        headlines.inventory(tables),
        "inventory",
        F.when(signal, "warning").otherwise("info"),
        F.when(signal, sentence(fixed.INVENTORY_SUMMARY, **slots)).otherwise(
            fixed.INVENTORY_NORMAL_SUMMARY
        ),
        F.when(signal, sentence(fixed.INVENTORY_ADVICE, **slots)).otherwise(
            fixed.INVENTORY_NORMAL_ADVICE
        ),
        F.when(signal, _texts(fixed.INVENTORY_DRIVER)).otherwise(_texts()),
    )


def marketing_finding(tables: RetailTables) -> DataFrame:
    best, worst = F.col("best_campaign"), F.col("worst_campaign")
    return _finding(
        headlines.marketing(tables),
        "marketing",
        F.lit("info"),
        sentence(
            fixed.MARKETING_SUMMARY,
            best=best,
            best_roi=show("best_roi", 2),
            best_spend=show("best_spend", 2, grouped=True),
            best_revenue=show("best_revenue", 2, grouped=True),
            worst=worst,
            worst_roi=show("worst_roi", 2),
        ),
        sentence(fixed.MARKETING_ADVICE, best=best, worst=worst),
        _texts(),
    )


def targets_finding(tables: RetailTables, month: str | None = None) -> DataFrame:
    missed, store = F.col("below") > 0, F.col("store_name")
    slots = dict(
        month=F.col("month"),
        below=show_count("below"),
        stores=show_count("stores"),
        store=store,
        attainment=show("revenue_attainment_pct", 1),
        target=show("revenue_target", 2, grouped=True),
    )
    return _finding(
        headlines.targets(tables, month),
        "targets",
        F.when(missed, "warning").otherwise("info"),
        F.when(missed, sentence(fixed.TARGET_MISSED_SUMMARY, **slots)).otherwise(
            sentence(fixed.TARGET_MET_SUMMARY, **slots)
        ),
        F.when(missed, sentence(fixed.TARGET_MISSED_ADVICE, store=store)).otherwise(
            fixed.TARGET_MET_ADVICE
        ),
        F.when(missed, _texts(sentence(fixed.TARGET_DRIVER, store=store))).otherwise(_texts()),
    )


def findings(
    tables: RetailTables,
    window_days: int = fixed.WINDOW_DAYS,
    month: str | None = None,
    summed: Lattice | None = None,
) -> DataFrame:
    """All six findings, most severe first, equal ones in the order of the topics.

    Sales and returns are summed once for all topics, unless ``summed`` has them already.
    """
    summed = summed or lattice(tables)
    collected = union_all(
        [
            profitability_finding(summed.by_order, window_days),
            returns_finding(summed.by_product),
            delivery_finding(tables),
            inventory_finding(tables),
            marketing_finding(tables),
            targets_finding(summed.by_order, month),
        ]
    )
    return collected.orderBy(severity_rank(F.col("severity")), "ordinal")


def _evidence(records: DataFrame, topic: str, section: str) -> DataFrame:
    return records.select(
        F.lit(fixed.FINDING_HEADS[topic][0]).alias("finding_id"),
        F.lit(section).alias("section"),
        F.to_json(F.struct(*records.columns)).alias("record"),
        record_entity(records).alias("entity"),
        record_measures(records).alias("measures"),
        record_numbers(records).alias("numbers"),
    )


def findings_evidence(
    tables: RetailTables,
    window_days: int = fixed.WINDOW_DAYS,
    month: str | None = None,
    summed: Lattice | None = None,
) -> DataFrame:
    """Every record a finding rests on, as JSON, with its name and its numbers. ``summed`` as for ``findings``."""
    summed = summed or lattice(tables)
    threshold = fixed.FINDING_OUTLIER_THRESHOLD
    rows = fixed.EVIDENCE_HOTSPOT_ROWS
    categories = zscore_outliers(return_analysis(summed.by_product), "return_rate_pct", threshold, "category")
    partners = zscore_outliers(
        delivery_performance(tables), "delayed_rate_pct", threshold, "delivery_partner_id"
    )
    worst = headlines.worst_category(summed.by_product).select("category").scalar()

    def size(records: DataFrame, name: str) -> DataFrame:
        return records.agg(F.count(F.lit(1)).alias(name))

    return union_all(
        [
            _evidence(growth_gap(summed.by_order, window_days), "profitability", "comparison"),
            _evidence(categories, "returns", "by_category"),
            _evidence(return_reasons(summed.by_product, worst), "returns", "top_category_reasons"),
            _evidence(size(categories, "sample_size_categories"), "returns", "sample_size"),
            _evidence(partners, "delivery", "by_partner"),
            _evidence(size(partners, "sample_size_partners"), "delivery", "sample_size"),
            _evidence(inventory_imbalance(tables), "inventory", "summary"),
            _evidence(stockout_hotspots(tables, rows), "inventory", "top_stockouts"),
            _evidence(excess_hotspots(tables, rows), "inventory", "top_excess"),
            _evidence(campaign_roi(tables), "marketing", "campaigns"),
            _evidence(target_vs_actual(summed.by_order, month), "targets", "stores"),
        ]
    )
