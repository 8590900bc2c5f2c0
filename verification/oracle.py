"""SQL twins of the registered queries, runnable over the test tables as views."""

from __future__ import annotations

import re

from tallywise import fixed_values as fixed
from verification.queries import LONG_ID, MAPPED, PROFILED, TARGET_MONTH, WINDOW
from verification.views import CATALOG_COLUMNS, QUESTION_FORMS, TEST_TABLES

# ---------------------------------------------------------------------------
# Small SQL pieces
# ---------------------------------------------------------------------------


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rounded(e: str, places: int = 2) -> str:
    scale = f"{10 ** places}.0::DOUBLE"
    return f"(round_even(({e})::DOUBLE * {scale}, 0) / {scale})"


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def percent(a: str, b: str) -> str:
    return f"({ratio(a, b)} * 100)"


def change(new: str, old: str) -> str:
    return f"((({new})::DOUBLE - ({old})::DOUBLE) / nullif(({old})::DOUBLE, 0) * 100)"


def total(e: str) -> str:
    return f"coalesce(sum({e}), 0)::DOUBLE"


def mean(e: str) -> str:
    return f"(sum(({e})::DECIMAL(18,4))::DOUBLE / nullif(count({e}), 0))"


def show(e: str, places: int, flags: str = "") -> str:
    return f"coalesce(format('{{:{flags}.{places}f}}', ({e})::DOUBLE), 'n/a')"


def count_text(e: str, flags: str = "") -> str:
    return f"coalesce(format('{{:{flags}}}', ({e})::BIGINT), 'n/a')"


def say(pattern: str, **slots: str) -> str:
    """A fixed sentence with SQL expressions in its slots."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", pattern)):
        if i % 2:
            parts.append(f"coalesce(({slots[piece]})::VARCHAR, '')")
        elif piece:
            parts.append(text(piece))
    return "(" + " || ".join(parts) + ")"


def has(phrases: list[str], q: str = "q") -> str:
    return "(" + " OR ".join(f"contains({q}, {text(p)})" for p in phrases) + ")"


def numbers(e: str) -> str:
    """Distinct numbers written in a text, printed with one place."""
    tokens = (
        rf"regexp_extract_all(regexp_replace({e}, '([0-9])-', '\1 ', 'g'), "
        r"'-?[0-9][0-9,]*\.?[0-9]*')"
    )
    one_place = "format('{:.1f}', replace(t, ',', '')::DOUBLE)::DOUBLE"
    return f"list_distinct(list_transform({tokens}, lambda t: {one_place}))"


def one_place(e: str) -> str:
    return f"format('{{:.1f}}', ({e})::DOUBLE)::DOUBLE"


def dec(e: str) -> str:
    return f"{e}::DECIMAL(12,2)"


# ---------------------------------------------------------------------------
# Views: the retail tables, the mapped table, questions and statements
# ---------------------------------------------------------------------------

_REVENUE = f"({dec('l_extendedprice')} * (1 - {dec('l_discount')}))::DECIMAL(18,4)"
_COST = f"({dec('l_extendedprice')} * 0.70)::DECIMAL(18,4)"

VIEWS: dict[str, str] = {
    "sale_lines": """SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey""",
    "products": """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
        p_brand AS brand FROM part""",
    "stores": """SELECT n_nationkey AS store_id, n_name AS store_name, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "customers": """SELECT c_custkey AS customer_id, c_mktsegment AS customer_segment,
        c_nationkey AS store_id FROM customer""",
    "sales": f"""SELECT o_orderkey AS order_id, o_orderdate::DATE AS order_date,
        o_custkey AS customer_id, l_partkey AS product_id, c_nationkey AS store_id,
        o_orderpriority AS channel, l_quantity::BIGINT AS quantity, {_REVENUE} AS revenue,
        {_COST} AS cost, ({_REVENUE} - {_COST})::DECIMAL(18,4) AS gross_profit FROM sale_lines""",
    "enriched": """SELECT s.*, product_name, category, brand, store_name, region, customer_segment
        FROM sales s LEFT JOIN products USING (product_id) LEFT JOIN stores USING (store_id)
        LEFT JOIN (SELECT customer_id, customer_segment FROM customers) USING (customer_id)""",
    "returns": f"""SELECT concat_ws('-', l_orderkey, l_linenumber) AS return_id,
        o_orderkey AS order_id, l_shipdate::DATE AS return_date, l_partkey AS product_id,
        c_nationkey AS store_id, l_quantity::BIGINT AS quantity,
        concat_ws('-', l_linestatus, o_orderstatus) AS return_reason, {_REVENUE} AS refund_amount
        FROM sale_lines WHERE l_returnflag = 'R'""",
    "deliveries": """SELECT o_orderkey AS order_id, o_orderdate::DATE AS order_date,
        c_nationkey AS store_id, o_orderpriority AS delivery_partner_id, 5 AS promised_days,
        2 + o_orderkey % 7 AS actual_days,
        CASE WHEN o_orderkey % 7 > 3 THEN 'Delayed' ELSE 'On Time' END AS delivery_status,
        (1 + o_orderkey % 5)::DOUBLE AS delivery_rating
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "delivery_partners": """SELECT DISTINCT o_orderpriority AS delivery_partner_id,
        o_orderpriority AS partner_name FROM orders""",
    "employees": """SELECT s_suppkey AS employee_id, s_nationkey AS store_id,
        CASE WHEN s_suppkey % 10 = 0 THEN 'Store Manager' ELSE 'Sales Associate' END AS role
        FROM supplier""",
    "inventory_daily": """SELECT ts::DATE AS snapshot_date, user_id % 25 AS store_id,
        event_id % 200 AS product_id, event_type = 'error' AS is_out, event_type = 'view' AS is_over
        FROM events""",
    "marketing": f"""SELECT event_type AS campaign_id, event_type AS campaign_name, spend,
        attributed_revenue, conversions,
        {rounded('(attributed_revenue - spend) / spend')} AS roi
        FROM (SELECT event_type, (count(*) * 10)::DOUBLE AS spend,
            sum({dec('value')})::DOUBLE AS attributed_revenue,
            count(DISTINCT user_id) AS conversions FROM events GROUP BY event_type)""",
    "targets": """SELECT month, n_nationkey AS store_id,
        (200000 + n_nationkey::BIGINT * 7919 % 400000)::DOUBLE AS revenue_target,
        (50000 + n_nationkey::BIGINT * 7919 % 100000)::DOUBLE AS gross_profit_target,
        60.0::DOUBLE AS on_time_delivery_target_pct, 6.0::DOUBLE AS return_rate_target_pct
        FROM nation CROSS JOIN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)""",
    "uploaded": f"""SELECT l_shipdate AS date, {dec('l_extendedprice')} AS revenue,
        ({dec('l_extendedprice')} * 0.70)::DECIMAL(18,4) AS cost, l_quantity AS quantity,
        l_partkey AS product, p_type AS category, l_suppkey AS store, l_returnflag = 'R' AS return_flag,
        {dec('l_extendedprice')} - ({dec('l_extendedprice')} * 0.70)::DECIMAL(18,4) AS profit
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "questions": f"""SELECT 'c' || c_custkey AS question_id,
        [{', '.join(text(f) for f in QUESTION_FORMS)}][(c_custkey % {len(QUESTION_FORMS)} + 1)::INT]
        || ' ' || c_name || '?' AS question FROM customer
        UNION ALL SELECT 't' || conv_id || '-' || turn, text FROM conversations""",
    "facts": f"""SELECT o_custkey AS id, o_orderpriority AS partner_name, count(*) AS orders,
        sum({dec('o_totalprice')})::DOUBLE AS spent FROM orders GROUP BY 1, 2""",
    "statements": """SELECT id,
        top || ' brought ' || format('{:,.2f}', CASE WHEN id % 3 = 1 THEN least_spent ELSE most END)
        || ' from ' || n || ' orders.' || CASE WHEN id % 4 = 2
            THEN ' The balance is ' || format('{:.2f}', c_acctbal) || '.' ELSE '' END AS said,
        top || ' brought the most.' AS template
        FROM (SELECT id, arg_min(partner_name, row(-spent, partner_name)) AS top, max(spent) AS most,
            min(spent) AS least_spent, sum(orders)::BIGINT AS n FROM facts GROUP BY id)
        JOIN customer ON id = c_custkey""",
    "fact_numbers": f"""SELECT id, partner_name, unnest([{one_place('orders')},
        {one_place('spent')}]) AS g FROM facts
        UNION ALL SELECT id, partner_name, unnest({numbers('partner_name')}) FROM facts""",
    "said_numbers": f"SELECT id, unnest({numbers('said')}) AS n FROM statements",
    "number_checks": """SELECT s.id, coalesce(bool_and(ok), true) AS numbers_grounded
        FROM statements s LEFT JOIN (SELECT t.id, (abs(n) <= 12 AND n = trunc(n)) OR n IN (0, 100)
            OR EXISTS (SELECT 1 FROM fact_numbers f WHERE f.id = t.id
                AND abs(t.n - f.g) <= greatest(0.5, abs(f.g) * 0.01)) AS ok
            FROM said_numbers t) c ON s.id = c.id GROUP BY s.id""",
    "own_numbers": f"""SELECT DISTINCT id, partner_name,
        unnest([{one_place('orders')}, {one_place('spent')}]) AS g FROM facts""",
    "entity_checks": """SELECT s.id, NOT EXISTS (
            SELECT 1 FROM facts m JOIN said_numbers t ON t.id = m.id
            WHERE m.id = s.id AND contains(s.said, m.partner_name)
            AND EXISTS (SELECT 1 FROM own_numbers o WHERE o.id = m.id
                AND o.partner_name <> m.partner_name AND o.g = t.n)
            AND NOT EXISTS (SELECT 1 FROM own_numbers o WHERE o.id = m.id
                AND o.partner_name = m.partner_name AND o.g = t.n)) AS entities_grounded
        FROM statements s""",
}


def query(sql: str) -> str:
    """The statement with the views it needs, and theirs, in front."""
    needed, todo = set(), [sql]
    while todo:
        piece = todo.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", piece):
                needed.add(name)
                todo.append(body)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    joined = sql[5:] if sql.startswith("WITH ") else None
    return f"WITH {views},\n{joined}" if joined else f"WITH {views}\n{sql}"


# ---------------------------------------------------------------------------
# Fixed retail schema
# ---------------------------------------------------------------------------


def kpi_window() -> str:
    inside = f"BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"
    return f"""WITH s AS (SELECT {total('revenue')} r, {total('gross_profit')} g,
        count(DISTINCT order_id) o, coalesce(sum(quantity), 0)::BIGINT u
        FROM sales WHERE order_date {inside}),
    b AS (SELECT {total('refund_amount')} v FROM returns WHERE return_date {inside})
    SELECT {rounded('r')} AS revenue, {rounded('g')} AS gross_profit,
        {rounded(f"coalesce({percent('g', 'r')}, 0)")} AS margin_pct, o AS orders, u AS units,
        {rounded(f"coalesce({ratio('r', 'o')}, 0)")} AS avg_order_value,
        {rounded('v')} AS return_value, {rounded('r - v')} AS net_revenue FROM s, b"""


def _comparison_ctes(days: int) -> str:
    def period(c: str) -> str:
        return f"CASE WHEN {c} >= m - {days - 1} THEN 'latest' ELSE 'previous' END"

    def inside(c: str) -> str:
        return f"{c} >= m - {2 * days - 1} AND {c} <= m"

    def pick(p: str, c: str) -> str:
        return f"coalesce(max(CASE WHEN p = '{p}' THEN {c} END), 0)"

    picked = ", ".join(
        f"{pick(p, c)} AS {p[0]}_{c}" for p in ("latest", "previous") for c in ("r", "g", "o", "u", "v")
    )
    return f"""a AS (SELECT max(order_date) m FROM sales),
    b AS (SELECT {period('order_date')} p, {total('revenue')} r, {total('gross_profit')} g,
            count(DISTINCT order_id) o, sum(quantity)::BIGINT u, NULL::DOUBLE v
            FROM sales, a WHERE {inside('order_date')} GROUP BY 1
        UNION ALL SELECT {period('return_date')}, NULL, NULL, NULL, NULL, {total('refund_amount')}
            FROM returns, a WHERE {inside('return_date')} GROUP BY 1),
    w AS (SELECT {picked} FROM b),
    x AS (SELECT *, coalesce({percent('l_g', 'l_r')}, 0) AS l_m,
            coalesce({percent('p_g', 'p_r')}, 0) AS p_m FROM w),
    gap AS (SELECT *, m AS latest_end, {change('l_r', 'p_r')} AS revenue_pct,
            {change('l_g', 'p_g')} AS gross_profit_pct, {rounded('l_m - p_m')} AS margin_pp,
            {change('l_o', 'p_o')} AS orders_pct,
            coalesce({change('l_r', 'p_r')}, 0) - coalesce({change('l_g', 'p_g')}, 0) AS raw_gap
            FROM x, a)"""


def _comparison_columns(days: int) -> str:
    def figures(p: str) -> str:
        k = p[0]
        return f"""{rounded(f'{k}_r')} AS {p}_revenue, {rounded(f'{k}_g')} AS {p}_gross_profit,
        {rounded(f'{k}_m')} AS {p}_margin_pct, {k}_o::BIGINT AS {p}_orders,
        {k}_u::BIGINT AS {p}_units,
        {rounded(f"coalesce({ratio(f'{k}_r', f'{k}_o')}, 0)")} AS {p}_avg_order_value,
        {rounded(f'{k}_v')} AS {p}_return_value, {rounded(f'{k}_r - {k}_v')} AS {p}_net_revenue"""

    return f"""{days} AS window_days, (m - {days - 1})::VARCHAR AS latest_start,
        m::VARCHAR AS latest_end, {figures('latest')},
        (m - {2 * days - 1})::VARCHAR AS previous_start, (m - {days})::VARCHAR AS previous_end,
        {figures('previous')}, revenue_pct, gross_profit_pct, margin_pp, orders_pct"""


def period_comparison(days: int) -> str:
    return f"WITH {_comparison_ctes(days)}\n    SELECT {_comparison_columns(days)} FROM gap"


_PRESSURE = f"(raw_gap > {fixed.GROWTH_GAP_LIMIT_PP} AND margin_pp < 0)"


def growth_gap(days: int = fixed.WINDOW_DAYS) -> str:
    return f"""WITH {_comparison_ctes(days)}
    SELECT {_comparison_columns(days)}, {rounded('raw_gap')} AS growth_gap_pp,
        {_PRESSURE} AS margin_pressure FROM gap"""


def _by(column: str, name: str, where: str = "true") -> str:
    return f"""SELECT {column} AS {name}, {total('revenue')} r, {total('gross_profit')} g,
        sum(quantity)::BIGINT AS units, count(DISTINCT order_id) AS orders
        FROM enriched WHERE {where} GROUP BY {column}"""


def breakdown(column: str, name: str, where: str = "true", limit: str = "") -> str:
    order = f"ORDER BY r DESC NULLS LAST, {name} NULLS LAST {limit}"
    return f"""SELECT {name}, {rounded('r')} AS revenue, {rounded('g')} AS gross_profit, units, orders,
        {rounded(f"CASE WHEN r > 0 THEN {percent('g', 'r')} ELSE 0 END")} AS margin_pct
        FROM ({_by(column, name, where)} {order}) {order}"""


MONTHLY = f"""SELECT date_trunc('month', order_date)::DATE::VARCHAR AS month, {rounded('sum(revenue)')} AS revenue,
    {rounded('sum(gross_profit)')} AS gross_profit, count(DISTINCT order_id) AS orders,
    {rounded(percent('sum(gross_profit)', 'sum(revenue)'))} AS margin_pct
    FROM sales GROUP BY 1 ORDER BY 1"""

STORE_TEAM = f"""SELECT store_id, store_name, region, {rounded('r')} AS revenue,
    {rounded('g')} AS gross_profit, orders, {rounded(percent('g', 'r'))} AS margin_pct,
    headcount, managers, {rounded(ratio('r', 'headcount'))} AS revenue_per_employee,
    {rounded(ratio('g', 'headcount'))} AS profit_per_employee
    FROM (SELECT store_id, store_name, region, {total('revenue')} r, {total('gross_profit')} g,
        count(DISTINCT order_id) AS orders FROM enriched GROUP BY ALL)
    LEFT JOIN (SELECT store_id, count(employee_id) AS headcount,
        count(*) FILTER (role = 'Store Manager') AS managers FROM employees GROUP BY 1)
        USING (store_id)
    ORDER BY revenue_per_employee DESC NULLS LAST, store_id"""

SEGMENTS = f"""SELECT customer_segment, {rounded('sum(revenue)')} AS revenue,
    {rounded('sum(gross_profit)')} AS gross_profit, count(DISTINCT order_id) AS orders,
    count(DISTINCT customer_id) AS customers,
    {rounded(percent('sum(gross_profit)', 'sum(revenue)'))} AS margin_pct,
    {rounded(ratio('sum(revenue)', 'count(DISTINCT customer_id)'))} AS revenue_per_customer
    FROM enriched GROUP BY 1 ORDER BY sum(revenue) DESC, customer_segment"""

RETURNS = f"""SELECT category, returned_units, {rounded('refund')} AS refund_value, return_events,
    units_sold, {rounded(percent('returned_units', 'units_sold'))} AS return_rate_pct
    FROM (SELECT category, sum(quantity)::BIGINT AS returned_units, sum(refund_amount) AS refund,
        count(return_id) AS return_events FROM returns LEFT JOIN products USING (product_id)
        GROUP BY 1) r
    LEFT JOIN (SELECT category, sum(quantity)::BIGINT AS units_sold FROM sales
        LEFT JOIN products USING (product_id) GROUP BY 1) s USING (category)"""


def reasons(where: str, keep: str = "") -> str:
    return f"""SELECT {keep} return_reason, count(return_id) AS events,
    sum(quantity)::BIGINT AS units, {rounded('sum(refund_amount)')} AS refund_value
    FROM returns JOIN products USING (product_id) WHERE {where} GROUP BY ALL"""


def outliers(sql: str, value: str, limit: float = fixed.FINDING_OUTLIER_THRESHOLD) -> str:
    score = rounded(f"({value} - avg({value}) OVER ()) / nullif(stddev_pop({value}) OVER (), 0)")
    return f"""SELECT *, coalesce({score}, 0) AS zscore,
        abs(coalesce({score}, 0)) >= {limit} AS is_outlier FROM ({sql})"""


DELIVERY = f"""SELECT * FROM (SELECT delivery_partner_id, count(order_id) AS total_deliveries,
    count(*) FILTER (delivery_status = 'Delayed') AS delayed,
    {rounded(mean('delivery_rating'))} AS avg_rating,
    {rounded(mean('promised_days'))} AS avg_promised_days,
    {rounded(mean('actual_days'))} AS avg_actual_days,
    {rounded(percent("count(*) FILTER (delivery_status = 'Delayed')", 'count(order_id)'))} AS delayed_rate_pct
    FROM deliveries GROUP BY 1) LEFT JOIN delivery_partners USING (delivery_partner_id)"""

DELIVERY_TREND = f"""SELECT date_trunc('week', order_date)::DATE::VARCHAR AS period,
    count(order_id) AS total, count(*) FILTER (delivery_status = 'Delayed') AS delayed,
    {rounded(mean('delivery_rating'))} AS avg_rating,
    {rounded(percent("count(*) FILTER (delivery_status = 'Delayed')", 'count(order_id)'))} AS delayed_rate_pct
    FROM deliveries WHERE delivery_partner_id = '1-URGENT' GROUP BY 1 ORDER BY 1"""

CAMPAIGNS = """SELECT campaign_id, campaign_name, spend, attributed_revenue, conversions, roi
    FROM marketing ORDER BY roi DESC NULLS LAST, campaign_id"""

BEST_WORST = """SELECT (SELECT count(*) FROM marketing) AS campaigns,
    b.campaign_name AS best_campaign, b.roi AS best_roi, b.spend AS best_spend,
    b.attributed_revenue AS best_revenue, w.campaign_name AS worst_campaign, w.roi AS worst_roi
    FROM (SELECT * FROM marketing ORDER BY roi DESC NULLS LAST, campaign_id LIMIT 1) b,
    (SELECT * FROM marketing ORDER BY roi, campaign_id DESC LIMIT 1) w"""


def hotspots(flag: str, days: str, rows: int) -> str:
    return f"""SELECT store_id, product_id, {days}, product_name, category, store_name, region
    FROM (SELECT store_id, product_id, count(*) AS {days} FROM inventory_daily WHERE {flag}
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT {rows})
    LEFT JOIN products USING (product_id) LEFT JOIN stores USING (store_id)"""


def _imbalance_ctes() -> str:
    def side(flag: str) -> str:
        return f"""(SELECT category, count(*) AS days FROM inventory_daily JOIN products
            USING (product_id) WHERE {flag} AND category IS NOT NULL GROUP BY 1
            ORDER BY 2 DESC, 1 LIMIT 1)"""

    def pairs(flag: str) -> str:
        return f"(SELECT count(DISTINCT (store_id, product_id)) FROM inventory_daily WHERE {flag})"

    return f"""imbalance AS (SELECT
        (SELECT category FROM {side('is_out')}) AS top_stockout_category,
        coalesce((SELECT days FROM {side('is_out')}), 0) AS top_stockout_category_days,
        (SELECT category FROM {side('is_over')}) AS top_excess_category,
        coalesce((SELECT days FROM {side('is_over')}), 0) AS top_excess_category_days,
        {pairs('is_out')} AS affected_store_product_pairs_stockout,
        {pairs('is_over')} AS affected_store_product_pairs_excess)"""


def target_vs_actual(month: str | None) -> str:
    wanted = text(month) if month else "(SELECT max(month) FROM targets)"

    def in_month(c: str) -> str:
        return f"strftime({c}, '%Y-%m') = {wanted}"

    return f"""SELECT t.month, t.store_id, store_name, region, revenue_target, gross_profit_target,
    on_time_delivery_target_pct, return_rate_target_pct, {rounded('coalesce(r, 0)')} AS actual_revenue,
    {rounded('coalesce(g, 0)')} AS actual_gross_profit, {rounded('on_time')} AS on_time_pct,
    {rounded(percent('refund', 'r'))} AS return_rate_pct,
    {rounded(percent('coalesce(r, 0)', 'revenue_target'))} AS revenue_attainment_pct,
    {rounded(percent('coalesce(g, 0)', 'gross_profit_target'))} AS profit_attainment_pct,
    {rounded('coalesce(on_time, 0) - on_time_delivery_target_pct')} AS on_time_gap_pp,
    {rounded(f"coalesce({percent('refund', 'r')}, 0) - return_rate_target_pct")} AS return_rate_gap_pp
    FROM (SELECT * FROM targets WHERE month = {wanted}) t
    LEFT JOIN (SELECT store_id, sum(revenue)::DOUBLE r, sum(gross_profit)::DOUBLE g FROM sales
        WHERE {in_month('order_date')} GROUP BY 1) USING (store_id)
    LEFT JOIN (SELECT store_id, {percent("count(*) FILTER (delivery_status = 'On Time')", 'count(*)')} on_time
        FROM deliveries WHERE {in_month('order_date')} GROUP BY 1) USING (store_id)
    LEFT JOIN (SELECT o.store_id, sum(refund_amount)::DOUBLE refund FROM returns
        JOIN (SELECT DISTINCT order_id, store_id FROM sales) o USING (order_id)
        WHERE {in_month('return_date')} GROUP BY 1) USING (store_id)
    LEFT JOIN stores USING (store_id)"""


# ---------------------------------------------------------------------------
# Findings and answers over the retail tables
# ---------------------------------------------------------------------------


def _headline_ctes(month: str | None) -> str:
    return f"""{_comparison_ctes(fixed.WINDOW_DAYS)},
    ret AS ({outliers(RETURNS, 'return_rate_pct')}),
    ret_top AS (SELECT *, (SELECT count(*) FROM ret) AS rivals FROM ret
        ORDER BY return_rate_pct DESC NULLS LAST, category LIMIT 1),
    reason AS ({reasons('return_reason IS NOT NULL', 'category,')}),
    ret_reason AS (SELECT t.*, (SELECT return_reason FROM reason r WHERE r.category = t.category
        ORDER BY events DESC, return_reason LIMIT 1) AS top_reason FROM ret_top t),
    del AS ({outliers(DELIVERY, 'delayed_rate_pct')}),
    del_top AS (SELECT * FROM del ORDER BY delayed_rate_pct DESC NULLS LAST, delivery_partner_id LIMIT 1),
    del_head AS (SELECT t.*, (SELECT count(*) FROM del) AS rivals,
        (SELECT avg(delayed_rate_pct) FROM del d WHERE d.delivery_partner_id <> t.delivery_partner_id)
        AS others FROM del_top t),
    {_imbalance_ctes()},
    ends AS ({BEST_WORST}),
    tgt AS ({target_vs_actual(month)}),
    tgt_head AS (SELECT *, (SELECT count(*) FROM tgt) AS n_stores,
        (SELECT count(*) FROM tgt WHERE revenue_attainment_pct < 100) AS below
        FROM tgt ORDER BY revenue_attainment_pct NULLS LAST, store_id LIMIT 1)"""


_GROWTH_SLOTS = dict(
    rev_pct=show("revenue_pct", 1),
    gp_pct=show("gross_profit_pct", 1),
    margin_pp=show("margin_pp", 2, "+"),
    days=str(fixed.WINDOW_DAYS),
    prev_margin=show(rounded("p_m"), 2),
    margin=show(rounded("l_m"), 2),
)
_STOCK_SLOTS = dict(
    out_category="top_stockout_category",
    out_days="top_stockout_category_days",
    out_pairs="affected_store_product_pairs_stockout",
    over_category="top_excess_category",
    over_days="top_excess_category_days",
    over_pairs="affected_store_product_pairs_excess",
)
_TARGET_SLOTS = dict(
    month="month",
    below="below",
    stores="n_stores",
    store="store_name",
    attainment=show("revenue_attainment_pct", 1),
    target=show("revenue_target", 2, ","),
)
_SIGNAL = "(top_stockout_category IS NOT NULL AND top_excess_category IS NOT NULL)"


def either(condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN {condition} THEN {yes} ELSE {no} END"


def _finding(topic: str, severity: str, summary: str, advice: str, drivers: str, source: str) -> str:
    finding_id, title = fixed.FINDING_HEADS[topic]
    return f"""SELECT {list(fixed.FINDING_HEADS).index(topic)} AS ordinal, {text(finding_id)} AS finding_id,
    {text(title)} AS title, {text(topic)} AS category, {severity} AS severity, {summary} AS summary,
    {advice} AS recommendation, {drivers} AS possible_drivers,
    {text(fixed.FINDING_CONFIDENCE[topic])} AS confidence FROM {source}"""


def findings(month: str | None) -> str:
    returns_summary = say(
        fixed.RETURNS_SUMMARY + fixed.RETURNS_REASON_SUMMARY,
        category="category",
        rate=show("return_rate_pct", 2),
        units="returned_units",
        refund=show("refund_value", 2, ","),
        zscore=show("zscore", 2),
        categories="rivals",
        reason="top_reason",
    )
    quality = say(
        fixed.RETURNS_QUALITY_DRIVER,
        category="category",
        reason_note=say(fixed.RETURNS_REASON_NOTE, reason="top_reason"),
    )
    delivery_summary = say(
        fixed.DELIVERY_SUMMARY,
        partner="partner_name",
        partner_id="delivery_partner_id",
        rate=show("delayed_rate_pct", 1),
        rating=show("avg_rating", 2),
        others=show("others", 1),
        n_others="rivals - 1",
    )
    marketing_summary = say(
        fixed.MARKETING_SUMMARY,
        best="best_campaign",
        best_roi=show("best_roi", 2),
        best_spend=show("best_spend", 2, ","),
        best_revenue=show("best_revenue", 2, ","),
        worst="worst_campaign",
        worst_roi=show("worst_roi", 2),
    )
    parts = [
        _finding(
            "profitability",
            either(_PRESSURE, "'warning'", "'info'"),
            either(
                _PRESSURE,
                say(fixed.PROFIT_PRESSURE_SUMMARY, **_GROWTH_SLOTS),
                say(fixed.PROFIT_STEADY_SUMMARY, **_GROWTH_SLOTS),
            ),
            either(_PRESSURE, text(fixed.PROFIT_PRESSURE_ADVICE), text(fixed.PROFIT_STEADY_ADVICE)),
            either(_PRESSURE, text(" | ".join(fixed.PROFIT_PRESSURE_DRIVERS)), "''"),
            "gap",
        ),
        _finding(
            "returns",
            either("is_outlier", "'warning'", "'info'"),
            returns_summary,
            either(
                "is_outlier",
                say(fixed.RETURNS_HIGH_ADVICE, category="category", reason="top_reason"),
                text(fixed.RETURNS_NORMAL_ADVICE),
            ),
            either("is_outlier", f"{quality} || ' | ' || {text(fixed.RETURNS_LISTING_DRIVER)}", "''"),
            "ret_reason",
        ),
        _finding(
            "delivery",
            f"""CASE WHEN is_outlier AND delayed_rate_pct > {fixed.CRITICAL_DELAY_RATE_PCT}
                THEN 'critical' WHEN is_outlier THEN 'warning' ELSE 'info' END""",
            delivery_summary,
            either(
                "is_outlier",
                say(fixed.DELIVERY_GAP_ADVICE, partner="partner_name"),
                text(fixed.DELIVERY_NORMAL_ADVICE),
            ),
            either("is_outlier", say(fixed.DELIVERY_DRIVER, partner="partner_name"), "''"),
            "del_head",
        ),
        _finding(
            "inventory",
            either(_SIGNAL, "'warning'", "'info'"),
            either(
                _SIGNAL, say(fixed.INVENTORY_SUMMARY, **_STOCK_SLOTS), text(fixed.INVENTORY_NORMAL_SUMMARY)
            ),
            either(
                _SIGNAL, say(fixed.INVENTORY_ADVICE, **_STOCK_SLOTS), text(fixed.INVENTORY_NORMAL_ADVICE)
            ),
            either(_SIGNAL, text(fixed.INVENTORY_DRIVER), "''"),
            "imbalance",
        ),
        _finding(
            "marketing",
            "'info'",
            marketing_summary,
            say(fixed.MARKETING_ADVICE, best="best_campaign", worst="worst_campaign"),
            "''",
            "ends",
        ),
        _finding(
            "targets",
            either("below > 0", "'warning'", "'info'"),
            either(
                "below > 0",
                say(fixed.TARGET_MISSED_SUMMARY, **_TARGET_SLOTS),
                say(fixed.TARGET_MET_SUMMARY, **_TARGET_SLOTS),
            ),
            either(
                "below > 0",
                say(fixed.TARGET_MISSED_ADVICE, store="store_name"),
                text(fixed.TARGET_MET_ADVICE),
            ),
            either("below > 0", say(fixed.TARGET_DRIVER, store="store_name"), "''"),
            "tgt_head",
        ),
    ]
    rank = " ".join(f"WHEN {text(s)} THEN {n}" for s, n in fixed.SEVERITY_RANK.items())
    return f"""WITH {_headline_ctes(month)}
    SELECT * FROM ({' UNION ALL '.join(parts)})
    ORDER BY CASE severity {rank} ELSE {fixed.UNKNOWN_SEVERITY_RANK} END, ordinal"""


def _evidence(topic: str, section: str, source: str, entity: str, measures: str, texts: str = "", flags: str = "") -> str:
    """The numbers of every record: its measures, its flags as 0 and 1, and those written in its texts."""
    found = [f"[{', '.join(one_place(c) for c in measures.split())}]"]
    found += [f"[({c})::INT::DOUBLE]" for c in flags.split()]
    found += [f"coalesce({numbers(c + '::VARCHAR')}, [])" for c in texts.split()]
    lists = found[0]
    for part in found[1:]:
        lists = f"list_concat({lists}, {part})"
    return f"""SELECT {text(fixed.FINDING_HEADS[topic][0])} AS finding_id, {text(section)} AS section,
        {entity} AS entity, unnest(CASE WHEN len(found) = 0 THEN [NULL] ELSE found END) AS number
        FROM (SELECT *, list_distinct({lists}) AS found FROM ({source}))"""


def findings_evidence() -> str:
    windows = [
        f"{p}_{c}"
        for p in ("latest", "previous")
        for c in "revenue gross_profit margin_pct orders units avg_order_value return_value net_revenue".split()
    ]
    compared = ["window_days", *windows, *"revenue_pct gross_profit_pct margin_pp orders_pct growth_gap_pp".split()]
    spots = "product_name category store_name region"
    rows = fixed.EVIDENCE_HOTSPOT_ROWS
    nobody = "NULL::VARCHAR"
    worst = "(SELECT category FROM ret_top)"
    parts = [
        _evidence(
            "profitability", "comparison",
            f"SELECT {_comparison_columns(fixed.WINDOW_DAYS)}, {rounded('raw_gap')} AS growth_gap_pp, "
            f"{_PRESSURE} AS margin_pressure FROM gap",
            nobody, " ".join(compared), "latest_start latest_end previous_start previous_end", "margin_pressure",
        ),
        _evidence(
            "returns", "by_category", "SELECT * FROM ret", "category",
            "returned_units refund_value return_events units_sold return_rate_pct zscore", "category", "is_outlier",
        ),
        _evidence(
            "returns", "top_category_reasons", reasons(f"return_reason IS NOT NULL AND category = {worst}"), nobody,
            "events units refund_value", "return_reason",
        ),
        _evidence("returns", "sample_size", "SELECT count(*) AS n FROM ret", nobody, "n"),
        _evidence(
            "delivery", "by_partner", "SELECT * FROM del", "partner_name",
            "total_deliveries delayed avg_rating avg_promised_days avg_actual_days delayed_rate_pct zscore",
            "delivery_partner_id partner_name", "is_outlier",
        ),
        _evidence("delivery", "sample_size", "SELECT count(*) AS n FROM del", nobody, "n"),
        _evidence(
            "inventory", "summary", "SELECT * FROM imbalance", nobody,
            "top_stockout_category_days top_excess_category_days affected_store_product_pairs_stockout "
            "affected_store_product_pairs_excess",
            "top_stockout_category top_excess_category",
        ),
        _evidence(
            "inventory", "top_stockouts", hotspots("is_out", "stockout_days", rows), "category",
            "store_id product_id stockout_days", spots,
        ),
        _evidence(
            "inventory", "top_excess", hotspots("is_over", "excess_days", rows), "category",
            "store_id product_id excess_days", spots,
        ),
        _evidence(
            "marketing", "campaigns", CAMPAIGNS, "campaign_name", "spend attributed_revenue conversions roi",
            "campaign_id campaign_name",
        ),
        _evidence(
            "targets", "stores", "SELECT * FROM tgt", "store_name",
            "store_id revenue_target gross_profit_target on_time_delivery_target_pct return_rate_target_pct "
            "actual_revenue actual_gross_profit on_time_pct return_rate_pct revenue_attainment_pct "
            "profit_attainment_pct on_time_gap_pp return_rate_gap_pp",
            "month store_name region",
        ),
    ]
    return f"WITH {_headline_ctes(None)}\n" + "\nUNION ALL ".join(parts)


def _intent_case() -> str:
    profit = f"({has(fixed.PROFIT_PHRASES)} OR {has(fixed.STRONG_PROFIT_PHRASES)})"
    companion = " OR ".join(
        has(p)
        for p in (
            fixed.PLAIN_PROFIT_PHRASES,
            fixed.STRONG_PROFIT_PHRASES,
            fixed.REVENUE_PHRASES,
            fixed.COMPARISON_PHRASES,
        )
    )
    rules = [
        (has(fixed.META_PHRASES), "meta_capabilities"),
        (has(fixed.NON_BUSINESS_PHRASES), "out_of_scope"),
        (has(fixed.EMPLOYEE_PHRASES), "employee_store_performance"),
        (has(fixed.SEGMENT_PHRASES), "customer_segment_value"),
        (has(fixed.MARKETING_PHRASES), "marketing_roi"),
        (has(fixed.DELIVERY_PHRASES), "delivery_partner_performance"),
        (has(fixed.INVENTORY_PHRASES), "inventory_imbalance"),
        (has(fixed.TARGET_PHRASES), "target_attainment"),
        (f"{has(fixed.RETURN_PHRASES)} AND NOT {has(fixed.NOT_RETURN_PHRASES)}", "returns_by_category"),
        (
            f"{has(fixed.RANKING_PHRASES)} AND {has(fixed.REVENUE_PHRASES + fixed.PROFIT_PHRASES)}",
            "revenue_profit_leaders",
        ),
        (f"{profit} AND ({companion})", "growth_vs_profitability"),
    ]
    cases = " ".join(f"WHEN {condition} THEN {text(intent)}" for condition, intent in rules)
    return f"CASE {cases} ELSE 'fallback_unmatched' END"


_LABELLED = f"""SELECT question_id, intent, CASE WHEN intent = 'revenue_profit_leaders' THEN
    CASE WHEN contains(q, 'region') THEN 'region' WHEN contains(q, 'store') THEN 'store'
    ELSE 'category' END END AS dimension
    FROM (SELECT *, {_intent_case()} AS intent FROM (SELECT question_id, lower(trim(question)) AS q
        FROM questions))"""


def question_answers() -> str:
    leaders = " UNION ALL ".join(
        f"""SELECT 'revenue_profit_leaders', {text(d)}, {say(
            fixed.LEADERS_ANSWER, dimension=text(d), leader=d, revenue=show('revenue', 2, ','),
            profit=show('gross_profit', 2, ','), margin=show('margin_pct', 2))}
        FROM ({breakdown(column, d, limit='LIMIT 1')})"""
        for d, column in (("region", "region"), ("store", "store_name"), ("category", "category"))
    )
    menu = [fixed.META_ANSWER_HEAD]
    for group, questions in fixed.QUESTION_GROUPS.items():
        menu += [f"\n**{group}**", *[f"- {q}" for q in questions]]
    menu.append(fixed.META_ANSWER_TAIL)
    rows = [
        f"SELECT 'meta_capabilities' AS i, NULL AS d, {text(chr(10).join(menu))} AS answer",
        f"SELECT 'out_of_scope', NULL, {text(fixed.OUT_OF_SCOPE_ANSWER)}",
        f"SELECT 'fallback_unmatched', NULL, {text(fixed.UNMATCHED_ANSWER)}",
        f"""SELECT 'employee_store_performance', NULL, {say(
            fixed.EMPLOYEE_ANSWER, store='store_name', per_employee=show('revenue_per_employee', 2, ','),
            headcount='headcount', margin=show('margin_pct', 2))} FROM ({STORE_TEAM} LIMIT 1)""",
        f"""SELECT 'customer_segment_value', NULL, {say(
            fixed.SEGMENT_ANSWER, segment='customer_segment', revenue=show('revenue', 2, ','),
            margin=show('margin_pct', 2), customers='customers',
            per_customer=show('revenue_per_customer', 2, ','))} FROM ({SEGMENTS} LIMIT 1)""",
        f"""SELECT 'marketing_roi', NULL, {say(
            fixed.MARKETING_ANSWER, campaign='best_campaign', roi=show('best_roi', 2),
            spend=show('best_spend', 2, ','), revenue=show('best_revenue', 2, ','))} FROM ends""",
        f"""SELECT 'delivery_partner_performance', NULL, {say(
            fixed.DELIVERY_ANSWER, partner='partner_name', rate=show('delayed_rate_pct', 1),
            rating=show('avg_rating', 2))} FROM del_head""",
        f"SELECT 'inventory_imbalance', NULL, {say(fixed.INVENTORY_ANSWER, **_STOCK_SLOTS)} FROM imbalance",
        f"""SELECT 'target_attainment', NULL, {either(
            'below > 0', say(fixed.TARGET_MISSED_ANSWER, **_TARGET_SLOTS),
            say(fixed.TARGET_MET_ANSWER, **_TARGET_SLOTS))} FROM tgt_head""",
        f"""SELECT 'returns_by_category', NULL, {say(
            fixed.RETURNS_ANSWER, category='category', rate=show('return_rate_pct', 2),
            units='returned_units', refund=show('refund_value', 2, ','))} FROM ret_top""",
        leaders,
        f"""SELECT 'growth_vs_profitability', NULL, {either(
            _PRESSURE, say(fixed.GROWTH_PRESSURE_ANSWER, **_GROWTH_SLOTS),
            say(fixed.GROWTH_STEADY_ANSWER, **_GROWTH_SLOTS))} FROM gap""",
    ]
    return f"""WITH {_headline_ctes(None)},
    replies AS ({' UNION ALL '.join(rows)})
    SELECT question_id, intent, dimension, answer FROM ({_LABELLED})
    LEFT JOIN replies ON intent = i AND dimension IS NOT DISTINCT FROM d"""


# ---------------------------------------------------------------------------
# Any table
# ---------------------------------------------------------------------------

# Columns of the profiled and mapped test tables: name and type.
COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}


def _column_stats(table: str, name: str, kind: str) -> str:
    numeric = kind in ("int", "bigint", "double")
    return f"""SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type,
    count(*) AS row_count, count(*) - count({name}) AS missing_count,
    {rounded(percent(f'count(*) - count({name})', 'count(*)'))} AS missing_pct,
    count(DISTINCT {name}) AS distinct_count, {str(numeric).lower()} AS is_numeric,
    {str(kind == 'timestamp_ntz').lower()} AS is_datelike FROM {table}"""


COLUMN_PROFILE = " UNION ALL ".join(
    _column_stats(t, name, kind) for t in PROFILED for name, kind in COLUMNS[t]
)


def merged_profile() -> str:
    """What merged sketches know exactly; the estimates have to be near."""

    def column(table: str, name: str, kind: str) -> str:
        numeric = kind in ("int", "bigint", "double")
        least, most = (f"{f}({name})::DOUBLE" if numeric else "NULL::DOUBLE" for f in ("min", "max"))
        return f"""SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type,
        count(*) AS row_count, count(*) - count({name}) AS missing_count, {str(numeric).lower()} AS is_numeric,
        {str(kind == 'timestamp_ntz').lower()} AS is_datelike, {least} AS smallest, {most} AS largest,
        true AS distinct_is_near, true AS quantiles_in_order FROM {table}"""

    return " UNION ALL ".join(column(t, name, kind) for t in ("orders", "customer") for name, kind in COLUMNS[t])


def candidate_columns() -> str:
    numeric = ", ".join(text(c) for c in fixed.NUMERIC_CONCEPTS)
    concepts = ", ".join(f"({text(c)})" for c in fixed.CONCEPT_SYNONYMS)
    return f"""SELECT table_name, concept, column_name FROM ({COLUMN_PROFILE})
    CROSS JOIN (VALUES {concepts}) c(concept) WHERE CASE WHEN concept = 'date' THEN is_datelike
    WHEN concept IN ({numeric}) THEN is_numeric
    WHEN concept = 'return_flag' THEN distinct_count <= {fixed.RETURN_FLAG_MAX_DISTINCT} AND NOT is_datelike
    ELSE NOT is_datelike AND data_type <> 'double' END"""


def dataset_profile() -> str:
    parts = [
        f"""SELECT '{t}' AS table_name, count(*) AS row_count, {len(COLUMNS[t])} AS column_count,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows FROM {t}"""
        for t in (*PROFILED, "events", "conversations")
    ]
    parts.append(
        """SELECT 'order_statuses', count(*), 2, count(*) - (SELECT count(*) FROM
        (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) FROM orders"""
    )
    return " UNION ALL ".join(parts)


def _reads_as_date(e: str) -> str:
    return f"coalesce(try_strptime({e}, ['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d']) IS NOT NULL, false)"


DATELIKE = f"""WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'unknown'
    WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed,
    CASE WHEN o_orderkey % 4 = 0 THEN 'n.a.' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS spoiled,
    o_orderpriority AS p FROM orders)
    SELECT 'o_orderkey' AS column_name, false AS is_datelike UNION ALL SELECT 'real_date', true
    UNION ALL SELECT 'mostly_dates', avg({_reads_as_date('mixed')}::INT) >= 0.8 FROM t
    UNION ALL SELECT 'too_few_dates', avg({_reads_as_date('spoiled')}::INT) >= 0.8 FROM t
    UNION ALL SELECT 'o_orderpriority', avg({_reads_as_date('p')}::INT) >= 0.8 FROM t"""


def _quality(name: str, source: str, columns: list[str]) -> str:
    missing = " + ".join(
        f"{rounded(percent(f'count(*) - count({c})', 'count(*)'))}::DECIMAL(18,4)" for c in columns
    )
    notes = f"""coalesce(nullif(concat_ws(' ',
        CASE WHEN m > {fixed.MISSING_NOTE_LIMIT_PCT} THEN {say(fixed.QUALITY_MISSING_NOTE, missing=show('m', 1))} END,
        CASE WHEN d > 0 THEN {say(fixed.QUALITY_DUPLICATE_NOTE, duplicates=show('d', 1))} END), ''),
        {text(fixed.QUALITY_CLEAN_NOTE)})"""
    return f"""SELECT '{name}' AS table_name, greatest(round_even(100 - (least(m * 1.5, 40)
    + least(d, 20)), 0), 0)::INT AS score, {rounded('m')} AS avg_missing_pct,
    {rounded('d')} AS duplicate_pct, {notes} AS notes
    FROM (SELECT ({missing})::DOUBLE / {len(columns)} AS m,
        {percent(f'count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))', 'count(*)')} AS d
        FROM {source})"""


QUALITY = f"""WITH gaps AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS customer_key,
    o_orderstatus, o_orderpriority FROM orders)
    {_quality('orders', 'orders', [c for c, _ in COLUMNS['orders']])} UNION ALL
    {_quality('customers_with_gaps', 'gaps', ['customer_key', 'o_orderstatus', 'o_orderpriority'])}"""

# What the naming rules give for the test tables, worked out by hand.
EXPECTED_MAPPINGS = {
    "orders": {"date": "o_orderdate", "revenue": "o_totalprice"},
    "lineitem": {"date": "l_shipdate", "quantity": "l_quantity", "return_flag": "l_returnflag"},
    "customer": {"category": "c_mktsegment"},
    "part": {"category": "p_type"},
    "events": {"category": "event_type"},
    "documents": {"campaign": "source"},
    "benchmark": {"product": "item_id"},
    "nation": {"region": "n_regionkey"},
    "supplier": {},
}


def suggested_mapping() -> str:
    """The rules over the names and types that the database itself reports, one concept after the other."""
    short = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
    concepts = ", ".join(
        f"({i}, {text(c)}, [{', '.join(short.format(text(w)) for w in words)}], {str(c in fixed.NUMERIC_CONCEPTS).lower()})"
        for i, (c, words) in enumerate(fixed.CONCEPT_SYNONYMS.items())
    )
    dated = " UNION ALL ".join(
        f"SELECT {text(t)} AS t, {text(c)} AS c, coalesce(avg({_reads_as_date(c)}::INT) >= {fixed.DATELIKE_SHARE}, false) AS d FROM {t}"
        for t in MAPPED for c, kind in COLUMNS[t] if kind == "string"
    )
    return f"""WITH RECURSIVE concepts AS (SELECT * FROM (VALUES {concepts}) v(i, concept, words, numeric)),
    dated AS ({dated}),
    columns AS (
        SELECT table_name AS t, column_name AS c, column_index AS place, {short.format('column_name')} AS short,
            regexp_matches(data_type, 'INT|DOUBLE|FLOAT|DECIMAL') AS is_number,
            coalesce(d, false) OR regexp_matches(data_type, 'DATE|TIMESTAMP') AS is_day
        FROM duckdb_columns() LEFT JOIN dated ON t = table_name AND c = column_name
        WHERE table_name IN ({', '.join(text(t) for t in MAPPED)})
    ),
    ranked AS (
        SELECT i, t, c, numeric, concept, is_number, is_day,
            CASE WHEN list_contains(words, short) THEN 0 ELSE 1 END AS how,
            CASE WHEN list_contains(words, short) THEN list_position(words, short) ELSE place END AS place
        FROM concepts JOIN columns ON len(list_filter(words, lambda w: contains(short, w))) > 0
    ),
    chosen AS (
        SELECT DISTINCT -1 AS i, t, [NULL]::VARCHAR[] AS taken, NULL::VARCHAR AS c FROM columns
        UNION ALL
        SELECT s.i + 1, s.t, list_append(s.taken, b.c), b.c
        FROM chosen s LEFT JOIN LATERAL (
            SELECT CASE WHEN r.numeric THEN CASE WHEN r.is_number THEN r.c END
                WHEN r.concept = 'date' THEN CASE WHEN r.is_day THEN r.c END ELSE r.c END AS c
            FROM ranked r WHERE r.i = s.i + 1 AND r.t = s.t AND NOT list_contains(s.taken, r.c)
            ORDER BY r.how, r.place LIMIT 1
        ) b ON true
        WHERE s.i + 1 < {len(fixed.CONCEPT_SYNONYMS)}
    )
    SELECT t AS table_name, concept, c AS column_name FROM chosen JOIN concepts USING (i)"""


def _concepts() -> dict[str, set[str]]:
    found = {t: set(EXPECTED_MAPPINGS[t]) for t in MAPPED if EXPECTED_MAPPINGS[t]}
    found["uploaded"] = {"date", "revenue", "cost", "profit", "quantity", "product", "category",
                         "store", "return_flag"}
    return found


CANONICAL = """SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END::VARCHAR AS date,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS revenue, o_custkey AS customer,
    o_orderpriority AS category FROM orders"""


def join_keys() -> str:
    """Names ending like identifiers: of the given tables as the database describes them, of the views as written."""
    tables = {
        "sales": ["order_id", "customer_id", "product_id", "store_id"],
        "products": ["product_id"],
        "stores": ["store_id"],
        "customers": ["customer_id", "store_id"],
        "employees": ["employee_id", "store_id"],
        "returns": ["return_id", "order_id", "product_id", "store_id"],
        "deliveries": ["order_id", "store_id", "delivery_partner_id"],
        "delivery_partners": ["delivery_partner_id"],
        "marketing": ["campaign_id"],
        "inventory_daily": ["store_id", "product_id"],
        "targets": ["store_id"],
    }
    base = {
        "sales": "lineitem", "products": "part", "stores": "nation", "customers": "customer",
        "employees": "supplier", "returns": "lineitem", "deliveries": "orders",
        "delivery_partners": "orders", "marketing": "events", "inventory_daily": "events",
        "targets": "orders",
    }
    ends = "|".join(fixed.IDENTIFIER_SUFFIXES)
    parts = [
        f"SELECT {i} AS o, {text(t)} AS t, lower(trim(column_name)) AS column_name FROM (DESCRIBE {t}) "
        f"WHERE regexp_matches(lower(trim(column_name)), '({ends})$') AND EXISTS (SELECT 1 FROM {t})"
        for i, t in enumerate(TEST_TABLES)
    ]
    parts += [
        f"SELECT {i} AS o, {text(t)} AS t, unnest([{', '.join(text(k) for k in keys)}]) AS column_name "
        f"WHERE EXISTS (SELECT 1 FROM {base[t]})"
        for i, (t, keys) in enumerate(tables.items(), len(TEST_TABLES))
    ]
    return f"""SELECT column_name, string_agg(t, ', ' ORDER BY o) AS tables,
    {text(fixed.SHARED_IDENTIFIER_NOTE)} AS note FROM ({' UNION ALL '.join(parts)})
    GROUP BY column_name HAVING count(*) > 1"""


def primary() -> str:
    """Columns and row counts as the database describes its tables."""
    described = " UNION ALL ".join(
        f"SELECT {i} AS o, {text(t)} AS t, (SELECT count(*) FROM {t}) AS n, lower(column_name) AS c, column_type AS k "
        f"FROM (DESCRIBE {t})"
        for i, t in enumerate(TEST_TABLES)
    )
    money, date = ("|".join(words) for words in (fixed.MONEY_NAME_WORDS, fixed.DATE_NAME_WORDS))
    numeric = r"(TINYINT|SMALLINT|INTEGER|BIGINT|HUGEINT|FLOAT|DOUBLE|DECIMAL\(.*\))"
    return f"""SELECT t AS table_name,
    bool_or(regexp_matches(c, '{money}') AND regexp_full_match(k, '{numeric}')) AS has_money,
    bool_or(regexp_matches(c, '{date}')) AS has_date, any_value(n) AS row_count
    FROM ({described}) WHERE n > 0 GROUP BY o, t
    ORDER BY has_money DESC, has_date DESC, row_count DESC, o LIMIT 1"""


# ---------------------------------------------------------------------------
# The mapped table
# ---------------------------------------------------------------------------

USER_KPI = f"""SELECT {rounded('sum(revenue)')} AS revenue, count(*) AS records,
    {rounded('sum(profit)')} AS profit, sum(quantity)::DOUBLE AS units,
    {rounded(percent('sum(profit)', 'sum(revenue)'))} AS margin_pct FROM uploaded"""


def user_trend(unit: str = "month") -> str:
    return f"""SELECT date_trunc('{unit}', date)::TIMESTAMP::VARCHAR AS period,
    {total('revenue')} AS revenue, {total('profit')} AS profit
    FROM uploaded WHERE date IS NOT NULL GROUP BY 1 ORDER BY 1"""


PERIOD_CHANGE = f"""SELECT * EXCLUDE n FROM (SELECT *, {rounded(change(
    'revenue', 'lag(revenue) OVER (ORDER BY period)'), 1)} AS change_pct,
    row_number() OVER (ORDER BY period) AS n FROM ({user_trend()})) WHERE n > 1"""

MARGIN_TREND = f"SELECT *, {rounded(percent('profit', 'revenue'))} AS margin_pct FROM ({user_trend()})"


def user_growth(days: int = fixed.WINDOW_DAYS) -> str:
    def summed(c: str, latest: bool) -> str:
        sign = ">=" if latest else "<"
        return rounded(total(f"CASE WHEN date::DATE {sign} m - {days - 1} THEN {c} END"))

    return f"""SELECT *, {rounded('revenue_pct_change - profit_pct_change')} AS growth_gap_pp FROM (
    SELECT {days} AS window_days, (m - {days - 1})::VARCHAR AS latest_start, m::VARCHAR AS latest_end,
    latest_revenue, latest_profit, (m - {2 * days - 1})::VARCHAR AS previous_start,
    (m - {days})::VARCHAR AS previous_end, previous_revenue, previous_profit,
    {rounded(change('latest_revenue', 'previous_revenue'))} AS revenue_pct_change,
    {rounded(change('latest_profit', 'previous_profit'))} AS profit_pct_change
    FROM (SELECT any_value(m) AS m, {summed('revenue', True)} AS latest_revenue,
        {summed('profit', True)} AS latest_profit, {summed('revenue', False)} AS previous_revenue,
        {summed('profit', False)} AS previous_profit
        FROM uploaded, (SELECT max(date)::DATE AS m FROM uploaded)
        WHERE date::DATE >= m - {2 * days - 1}))"""


def user_breakdown(dimension: str, rows: int) -> str:
    return f"""SELECT {dimension}, {rounded('r')} AS revenue, {rounded('p')} AS profit,
    {rounded('q')} AS quantity, CASE WHEN {rounded('r')} > 0
    THEN {rounded(percent(rounded('p'), rounded('r')))} ELSE 0 END AS margin_pct
    FROM (SELECT {dimension}, {total('revenue')} r, {total('profit')} p, {total('quantity')} q
        FROM uploaded GROUP BY 1 ORDER BY r DESC, {dimension} LIMIT {rows})"""


USER_RETURNS = f"""SELECT count(*) AS total_records, count(*) FILTER (return_flag) AS returned_records,
    {rounded(percent('count(*) FILTER (return_flag)', 'count(*)'))} AS return_rate_pct FROM uploaded"""

COMPOSITION = """SELECT category, product, false AS is_total, sum(revenue)::DOUBLE AS revenue
    FROM uploaded GROUP BY 1, 2 UNION ALL
    SELECT category, NULL, true, sum(revenue)::DOUBLE FROM uploaded GROUP BY 1"""

HISTOGRAM = f"""WITH b AS (SELECT min(revenue)::DOUBLE AS lo,
    (max(revenue)::DOUBLE - min(revenue)::DOUBLE) / {fixed.HISTOGRAM_BINS} AS w FROM uploaded),
    c AS (SELECT least(coalesce(floor((revenue::DOUBLE - lo) / nullif(w, 0)), 0),
        {fixed.HISTOGRAM_BINS - 1})::INT + 1 AS bin, count(*) AS records FROM uploaded, b GROUP BY 1)
    SELECT bin::INT AS bin, lo + (bin - 1) * w AS bin_start, lo + bin * w AS bin_end,
    coalesce(records, 0) AS records
    FROM (SELECT unnest(range(1, {fixed.HISTOGRAM_BINS + 1})) AS bin) CROSS JOIN b LEFT JOIN c USING (bin)"""

SPREAD = f"""SELECT product, count(*) AS records, min(revenue)::DOUBLE AS minimum,
    quantile_cont(revenue::DOUBLE, 0.25) AS q1, quantile_cont(revenue::DOUBLE, 0.5) AS median,
    quantile_cont(revenue::DOUBLE, 0.75) AS q3, max(revenue)::DOUBLE AS maximum
    FROM uploaded WHERE product IN (SELECT product FROM uploaded GROUP BY 1
        ORDER BY sum(revenue) DESC, product LIMIT {fixed.SPREAD_PRODUCTS}) GROUP BY 1"""


def _user_finding(ordinal: int, finding_id: str, title: str, category: str, severity: str,
                  summary: str, advice: str, source: str) -> str:
    return f"""SELECT {ordinal} AS ordinal, {text(finding_id)} AS finding_id, {text(title)} AS title,
    {text(category)} AS category, {severity} AS severity, {summary} AS summary,
    {advice} AS recommendation, 'high' AS confidence FROM ({source})"""


def user_findings() -> str:
    pressed = f"growth_gap_pp > {fixed.GROWTH_GAP_LIMIT_PP}"
    high = f"return_rate_pct > {fixed.HIGH_RETURN_RATE_PCT}"
    parts = [
        _user_finding(
            0, "user_growth_gap", "Revenue vs. Profit Growth", "profitability",
            either(pressed, "'warning'", "'info'"),
            say(
                fixed.USER_GROWTH_SUMMARY,
                rev_pct=show("revenue_pct_change", 1, "+"),
                profit_pct=show("profit_pct_change", 1, "+"),
                days="window_days",
            ),
            either(
                pressed, text(fixed.USER_GROWTH_PRESSURE_ADVICE), text(fixed.USER_GROWTH_STEADY_ADVICE)
            ),
            user_growth(),
        )
    ]
    for ordinal, d in ((1, "product"), (3, "category")):
        parts.append(
            _user_finding(
                ordinal, f"user_top_{d}", f"Top {d.capitalize()} by Revenue", d, "'info'",
                say(
                    fixed.USER_TOP_SUMMARY + fixed.USER_TOP_MARGIN + ".",
                    top=d,
                    revenue=show("revenue", 2, ","),
                    margin=show("margin_pct", 1),
                ),
                say(fixed.USER_TOP_ADVICE, top=d),
                user_breakdown(d, 1),
            )
        )
    parts.append(
        _user_finding(
            4, "user_returns", "Return Rate", "returns", either(high, "'warning'", "'info'"),
            say(
                fixed.USER_RETURNS_SUMMARY,
                rate=show("return_rate_pct", 2),
                records=count_text("total_records", ","),
            ),
            either(high, text(fixed.USER_RETURNS_HIGH_ADVICE), text(fixed.USER_RETURNS_NORMAL_ADVICE)),
            USER_RETURNS,
        )
    )
    return " UNION ALL ".join(parts)


def _user_routes() -> list[tuple[list[str], str, str, bool]]:
    able = {"profitability", "breakdown_product", "breakdown_category", "breakdown_store"}
    return [
        (fixed.USER_PROFIT_PHRASES, "profitability", "Profitability", True),
        *[
            (phrases, f"breakdown_{d}", analysis, f"breakdown_{d}" in able)
            for d, analysis, phrases in fixed.USER_DIMENSION_PHRASES
        ],
        (fixed.USER_RETURN_PHRASES, "returns", "Returns analysis", True),
        (fixed.USER_REVENUE_PHRASES, "kpi_overview", "Revenue trend over time", True),
    ]


def user_question_intents() -> str:
    routes = _user_routes()

    def case(value) -> str:
        cases = " ".join(f"WHEN {has(r[0])} THEN {value(r)}" for r in routes)
        return f"CASE WHEN {has(fixed.USER_META_PHRASES)} THEN {value(None)} {cases}"

    intent = case(lambda r: text("meta_capabilities" if r is None else r[1] if r[3] else "unsupported"))
    supported = case(lambda r: "true" if r is None or r[3] else "false")
    analysis = case(lambda r: "NULL" if r is None else text(r[2]))
    return f"""SELECT question_id, {intent} ELSE 'fallback' END AS intent,
    {supported} ELSE false END AS supported, {analysis} END AS analysis
    FROM (SELECT question_id, lower(trim(question)) AS q FROM questions)"""


def user_question_answers() -> str:
    have = _concepts()["uploaded"]
    able = {
        a: all(have & set(g) for g in groups) for a, groups in fixed.ANALYSIS_REQUIREMENTS.items()
    }
    supported, missing = ([a for a in able if able[a] is wanted] for wanted in (True, False))
    menu = [fixed.USER_META_HEAD]
    menu += [f"- {q}" for a in supported for q in fixed.ANALYSIS_QUESTIONS[a]]
    menu.append(fixed.USER_META_MISSING.format(missing=", ".join(missing)))
    fallback = fixed.USER_FALLBACK_HEAD + fixed.USER_FALLBACK_SOME.format(supported=", ".join(supported))
    rows = [
        f"SELECT 'meta_capabilities' AS i, NULL AS a, {text(chr(10).join(menu))} AS answer",
        f"SELECT 'fallback', NULL, {text(fallback)}",
        f"""SELECT 'profitability', 'Profitability', {say(
            fixed.USER_PROFIT_ANSWER, rev_pct=show('revenue_pct_change', 1, '+'),
            profit_pct=show('profit_pct_change', 1, '+'), days='window_days')} FROM ({user_growth()})""",
        f"""SELECT 'returns', 'Returns analysis', {say(
            fixed.USER_RETURNS_SUMMARY, rate=show('return_rate_pct', 2),
            records=count_text('total_records', ','))} FROM ({USER_RETURNS})""",
        f"""SELECT 'kpi_overview', 'Revenue trend over time', {say(
            fixed.USER_REVENUE_ANSWER + fixed.USER_REVENUE_PROFIT, revenue=show('revenue', 2, ','),
            records=count_text('records', ','), profit=show('profit', 2, ','),
            margin=show('margin_pct', 1))} FROM ({USER_KPI})""",
    ]
    refused = {}
    for _, intent, analysis, ok in _user_routes():
        if ok and intent.startswith("breakdown_"):
            d = intent.removeprefix("breakdown_")
            rows.append(
                f"""SELECT {text(intent)}, {text(analysis)}, {say(
                    fixed.USER_TOP_ANSWER, top=d, revenue=show('revenue', 2, ','))}
                FROM ({user_breakdown(d, 1)})"""
            )
        elif not ok:
            lacking = [" or ".join(g) for g in fixed.ANALYSIS_REQUIREMENTS[analysis] if not have & set(g)]
            needed = ", ".join(lacking) or "additional columns"
            refused[analysis] = fixed.USER_UNSUPPORTED.format(label=analysis, needed=needed)
    rows += [f"SELECT 'unsupported', {text(a)}, {text(t)}" for a, t in refused.items()]
    return f"""SELECT question_id, intent, supported, analysis, answer
    FROM ({user_question_intents()}) LEFT JOIN ({' UNION ALL '.join(rows)})
    ON intent = i AND analysis IS NOT DISTINCT FROM a"""


# ---------------------------------------------------------------------------
# Statements and checks
# ---------------------------------------------------------------------------

DOCUMENT_NUMBERS = f"SELECT doc_id, unnest({numbers('text')}) AS number FROM documents"

DOCUMENT_GROUNDING = f"""WITH t AS ({DOCUMENT_NUMBERS}),
    e AS (SELECT doc_id, {one_place('n_chars')} AS g FROM documents
        UNION ALL SELECT doc_id, unnest({numbers("lang || ' ' || source")}) FROM documents),
    c AS (SELECT doc_id, (abs(number) <= 12 AND number = trunc(number)) OR number IN (0, 100)
        OR EXISTS (SELECT 1 FROM e WHERE e.doc_id = t.doc_id
            AND abs(t.number - e.g) <= greatest(0.5, abs(e.g) * 0.01)) AS ok FROM t)
    SELECT doc_id, coalesce(bool_and(ok), true) AS numbers_grounded
    FROM documents LEFT JOIN c USING (doc_id) GROUP BY 1"""

VERIFIED = """SELECT id, CASE WHEN numbers_grounded AND entities_grounded THEN said ELSE template END AS text,
    CASE WHEN numbers_grounded AND entities_grounded THEN 'candidate' ELSE 'template' END AS text_source
    FROM statements JOIN number_checks USING (id) JOIN entity_checks USING (id)"""


def checks(rows: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {text(name)} AS check_name, ({sql})::BIGINT AS violations" for name, sql in rows.items()
    )


def _repeated(source: str, *keys: str) -> str:
    listed = ", ".join(keys)
    return f"SELECT (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {source}))"


def _orphans(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT count(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p
        WHERE p.{parent_key} = c.{key})"""


UNIQUE = checks(
    {
        "sales order_id": _repeated("sales", "order_id"),
        "returns return_id": _repeated("returns", "return_id"),
        "deliveries order_id": _repeated("deliveries", "order_id"),
        "lineitem key": _repeated("lineitem", "l_orderkey", "l_linenumber"),
    }
)
ORPHANS = checks(
    {
        "sales product": _orphans("sales", "product_id", "products", "product_id"),
        "sales store": _orphans("sales", "store_id", "stores", "store_id"),
        "sales customer": _orphans("sales", "customer_id", "customers", "customer_id"),
        "return order": _orphans("returns", "order_id", "sales", "order_id"),
        "delivery order": _orphans("deliveries", "order_id", "sales", "order_id"),
        "orders without lines": _orphans("orders", "o_orderkey", "lineitem", "l_orderkey"),
    }
)
ONE_TO_ONE = checks(
    {
        "sale delivery: missing": _orphans("sales", "order_id", "deliveries", "order_id"),
        "sale delivery: repeated": _repeated("deliveries", "order_id"),
        "delivery sale: missing": _orphans("deliveries", "order_id", "sales", "order_id"),
        "delivery sale: repeated": _repeated("sales", "order_id"),
    }
)


def _lines_where(condition: str) -> str:
    return f"SELECT count(*) FROM lineitem WHERE {condition}"


RANGES = checks(
    {
        "quantity is positive": _lines_where("l_quantity <= 0"),
        "price is not negative": _lines_where("l_extendedprice < 0"),
        "discount is a fraction": _lines_where("NOT l_discount BETWEEN 0 AND 1"),
        "discount at most 5 %": _lines_where("NOT l_discount BETWEEN 0 AND 0.05::DOUBLE"),
        "discount at most tax": _lines_where("l_discount > l_tax"),
    }
)
FLAGS = checks(
    {
        "returned: flagged without cause": _lines_where("l_returnflag = 'R' AND l_linestatus <> 'F'"),
        "returned: not flagged": _lines_where("l_returnflag <> 'R' AND l_linestatus = 'F'"),
    }
)

# ---------------------------------------------------------------------------
# Files
# ---------------------------------------------------------------------------

BAD_ROWS = f"""
SELECT 'csv' AS source, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey || ',' || custkey || ',extra'
        ELSE '{{"orderkey":"' || o_orderkey || '","custkey":"' || custkey || '"}}' END AS row,
    CASE WHEN o_orderkey % 11 = 0 THEN {text(fixed.CELL_COUNT_REASON)} ELSE {text(fixed.CELL_TYPE_REASON)} END AS reason
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none at all' ELSE o_custkey::VARCHAR END AS custkey FROM orders)
WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0
UNION ALL
SELECT 'json', '{{' || o_orderkey, {text(fixed.MALFORMED_REASON)} FROM orders WHERE o_orderkey % 5 = 0
"""

FILE_INVENTORY = f"""
WITH files AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer),
kinds AS (SELECT * FROM (VALUES ('.csv', 'data', 'ready', ''), ('.json', 'data', 'ready', ''),
    ('.txt', 'context', 'extracted', ''),
    ('.parquet', 'unsupported', 'declined', {text(fixed.UNKNOWN_FORMAT_DETAIL.format(extension='.parquet'))})
) AS k(extension, kind, status, detail))
SELECT f.filter, extension, kind, status, detail, n AS files, n AS with_content
FROM kinds, files, (VALUES ('all'), ('data'), ('context')) AS f(filter) WHERE f.filter IN ('all', kind)
"""

INVENTORY_SUMMARY = f"""
WITH nations AS (SELECT c_nationkey, format('{{:,}}', count(*)) AS n FROM customer GROUP BY 1),
found AS (
    SELECT 'CSV' AS "Type", 'Data' AS "Role", n || ' rows' AS "Size", 'Ready' AS "Status", '' AS "Detail" FROM nations
    UNION ALL SELECT 'JSON', 'Data', n || ' rows', 'Ready', '' FROM nations
    UNION ALL SELECT 'TXT', 'Context', n || ' chars', 'Extracted', '' FROM nations WHERE c_nationkey <> 1
    UNION ALL SELECT 'TXT', {text(fixed.ROLE_NAMES['unsupported'])}, {text(fixed.NO_SIZE)}, 'Error', '' FROM nations
        WHERE c_nationkey = 1
    UNION ALL SELECT 'PARQUET', {text(fixed.ROLE_NAMES['unsupported'])}, {text(fixed.NO_SIZE)}, 'Declined',
        {text(fixed.UNKNOWN_FORMAT_DETAIL.format(extension='.parquet'))} FROM nations
)
SELECT *, count(*) AS files FROM found GROUP BY ALL
"""


def retail_catalog() -> str:
    """A digest of each of the twelve tables: rows as text, columns in the order of their names."""
    plain = {
        "products": ("products", {}),
        "stores": ("stores", {}),
        "customers": ("customers", {"segment": "customer_segment"}),
        "employees": ("employees", {}),
        "sales": ("sales", {}),
        "returns": ("returns", {}),
        "deliveries": ("deliveries", {}),
        "delivery_partners": ("delivery_partners", {}),
        "inventory_daily": (
            "inventory_daily",
            {
                "stockout_flag": "CASE WHEN is_out THEN 'True' ELSE 'False' END",
                "excess_stock_flag": "CASE WHEN is_over THEN 'true' ELSE 'false' END",
            },
        ),
        "marketing": ("marketing", {"spend": "spend::DECIMAL(18,4)", "attributed_revenue": "attributed_revenue::DECIMAL(18,4)"}),
        "targets": (
            "targets",
            {c: f"{c}::DECIMAL(18,4)" for c in ("revenue_target", "gross_profit_target")},
        ),
        "hubs": ("(SELECT 'H' || r_regionkey AS hub_id, r_name AS hub_name, r_name AS region FROM region)", {}),
    }
    parts = []
    for name, (source, columns) in plain.items():
        shown = [columns.get(c, c) for c in sorted(CATALOG_COLUMNS[name])]
        row = " || '|' || ".join(f"coalesce(({e})::VARCHAR, '-')" for e in shown)
        first = f"('0x' || substr(sha256({row}), 1, 8))::BIGINT"
        parts.append(f"SELECT {text(name)} AS table_name, count(*) AS rows, sum({first})::BIGINT AS digest FROM {source}")
    return " UNION ALL ".join(parts)


_STATEMENTS: dict[str, str] = {
    "sales_enriched": """SELECT * EXCLUDE (order_date, revenue, cost, gross_profit),
        order_date::VARCHAR AS order_date, revenue::DOUBLE AS revenue, cost::DOUBLE AS cost,
        gross_profit::DOUBLE AS gross_profit FROM enriched""",
    "kpi_window": kpi_window(),
    "dataset_dates": """SELECT min(order_date)::VARCHAR AS start_date, max(order_date)::VARCHAR AS end_date
        FROM sales""",
    "period_comparison": period_comparison(365),
    "growth_gap": growth_gap(),
    "monthly_trend": MONTHLY,
    "breakdown_category": breakdown("category", "category"),
    "breakdown_brand": breakdown("brand", "brand"),
    "breakdown_store": breakdown("store_name", "store"),
    "breakdown_region": breakdown("region", "region"),
    "breakdown_channel": breakdown(
        "channel", "channel", f"order_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"
    ),
    "breakdown_segment": breakdown("customer_segment", "customer_segment"),
    "breakdown_product_top10": breakdown("product_name", "product", limit="LIMIT 10"),
    "store_team_performance": STORE_TEAM,
    "segment_value": SEGMENTS,
    "return_analysis": RETURNS,
    "return_reasons": reasons("category = 'ECONOMY' AND return_reason IS NOT NULL"),
    "return_rate_outliers": outliers(RETURNS, "return_rate_pct"),
    "delivery_performance": DELIVERY,
    "delivery_trend": DELIVERY_TREND,
    "delay_outliers": outliers(DELIVERY, "delayed_rate_pct"),
    "campaign_roi": CAMPAIGNS,
    "campaign_best_worst": BEST_WORST,
    "stockout_hotspots": hotspots("is_out", "stockout_days", fixed.HOTSPOT_ROWS),
    "excess_hotspots": hotspots("is_over", "excess_days", fixed.HOTSPOT_ROWS),
    "inventory_imbalance": f"WITH {_imbalance_ctes()} SELECT * FROM imbalance",
    "target_vs_actual": target_vs_actual(TARGET_MONTH),
    "target_vs_actual_latest": target_vs_actual(None),
    "findings": findings(TARGET_MONTH),
    "findings_evidence": findings_evidence(),
    "csv_scan": f"SELECT *, doc_id + {LONG_ID} AS long_id FROM documents",
    "tsv_scan": f"SELECT *, doc_id + {LONG_ID} AS long_id FROM documents",
    "json_records": "SELECT * FROM conversations",
    "json_record_array": """SELECT o_orderkey, o_custkey AS customer_key, count(l_orderkey) AS n_lines,
        coalesce(sum(l_quantity), 0)::DOUBLE AS units FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "json_mixed_folder": "SELECT c_custkey, c_name, c_nationkey AS nation_key FROM customer",
    "bad_rows": BAD_ROWS,
    "json_object": """SELECT count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers_known,
        max(o_custkey) AS customers_last FROM orders""",
    "document_scan": """SELECT sha256(t) AS digest, length(t)::BIGINT AS chars FROM (
        SELECT CASE WHEN item_id % 3 = 0 THEN 'A' || chr(65533) || 'B' || chr(65533) || 'C' ELSE '' END || text || chr(10) AS t
        FROM benchmark WHERE text IS NOT NULL)""",
    "file_inventory": FILE_INVENTORY,
    "inventory_summary": INVENTORY_SUMMARY,
    "records": """SELECT '{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":'
        || CASE WHEN doc_id % 3 <> 0 THEN toxic::VARCHAR ELSE 'null' END || '}' AS record FROM labels""",
    "retail_csv_catalog": retail_catalog(),
    "candidate_join_keys": join_keys(),
    "primary_table": primary(),
    "column_profile": COLUMN_PROFILE,
    "dataset_profile": dataset_profile(),
    "datelike_columns": DATELIKE,
    "merged_profile": merged_profile(),
    "stored_date_range": """SELECT min(order_date)::VARCHAR AS first_order_date, max(order_date)::VARCHAR AS last_order_date,
        min(order_id) AS first_order_id, max(order_id) AS last_order_id FROM sales""",
    "suggested_mapping": suggested_mapping(),
    "candidate_columns": candidate_columns(),
    "canonical_frame": CANONICAL,
    "data_quality_score": QUALITY,
    "date_window": "SELECT min(date)::VARCHAR AS start_date, max(date)::VARCHAR AS end_date FROM uploaded",
    "user_kpi_summary": USER_KPI,
    "user_revenue_trend": user_trend(),
    "user_weekly_trend": user_trend("week"),
    "period_change": PERIOD_CHANGE,
    "margin_trend": MARGIN_TREND,
    "user_growth": user_growth(),
    "user_breakdown": f"""SELECT *, CASE WHEN length(product::VARCHAR) > 2
        THEN left(product::VARCHAR, 2) || '…' ELSE product::VARCHAR END AS label
        FROM ({user_breakdown('product', fixed.USER_BREAKDOWN_ROWS)})""",
    "margin_trade_off": user_breakdown("product", fixed.TRADE_OFF_ROWS),
    "user_returns": USER_RETURNS,
    "composition": COMPOSITION,
    "value_histogram": HISTOGRAM,
    "value_spread": SPREAD,
    "user_findings": user_findings(),
    "question_intents": _LABELLED,
    "question_answers": question_answers(),
    "user_question_intents": user_question_intents(),
    "user_question_answers": user_question_answers(),
    "document_numbers": DOCUMENT_NUMBERS,
    "document_grounding": DOCUMENT_GROUNDING,
    "numeric_grounding": "SELECT id, numbers_grounded FROM number_checks",
    "entity_grounding": "SELECT id, entities_grounded FROM entity_checks",
    "verified_text": VERIFIED,
    "unique_key_check": UNIQUE,
    "referential_orphans": ORPHANS,
    "one_to_one_check": ONE_TO_ONE,
    "range_checks": RANGES,
    "observed_checks": RANGES,
    "flag_consistency": FLAGS,
}

ORACLE_SQL: dict[str, str] = {name: query(sql) for name, sql in _STATEMENTS.items()}
