"""The registered queries once more, as SQL for the check tool.

Each text is self-contained over the given tables: the CTEs it needs, then a
SELECT.  Money leaves as DOUBLE and dates as ISO text, as in ``queries()``.
Formulations differ from the Spark code on purpose where there is a choice.
"""

from __future__ import annotations

from cartledger.params import Params
from cartledger.sources.star_tables import PARAMS


def _titled(text: str) -> str:
    words = f"string_split(lower(trim({text})), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), ' ')"


def _half_up(cents: str, units: str) -> str:
    """cents / units rounded half up, as money; for amounts that are not negative."""
    return f"(2 * CAST({cents} AS HUGEINT) + {units}) // (2 * {units}) / 100.0"


def _cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS HUGEINT)"


def _pennyths(amount: str) -> str:
    """Hundredths of a cent, as finely as a unit price is kept."""
    return f"CAST({amount} * 10000 AS HUGEINT)"


def _ctes(p: Params) -> dict[str, tuple[list[str], str]]:
    """CTE name -> the CTEs it needs, and its text."""
    return {
        "base": (
            [],
            """
            SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'C' ELSE '' END
                       || CAST(l_orderkey AS VARCHAR) AS invoice_no,
                   CASE WHEN l_partkey % 211 = 0 AND l_linenumber = 1 THEN NULL
                        WHEN l_partkey % 223 = 0 AND l_linenumber = 2 THEN ' '
                        ELSE CAST(l_partkey AS VARCHAR) END AS stock_code,
                   CASE WHEN p_partkey % 50 = 0 THEN '  '
                        WHEN p_partkey % 40 = 1 AND l_linenumber = 1 THEN ' ' || upper(p_name) || ' b '
                        ELSE ' ' || upper(p_name) || ' ' END AS description,
                   CAST(CASE WHEN l_linenumber = 7 AND l_partkey % 29 = 0 THEN NULL
                             WHEN l_linenumber = 6 AND l_partkey % 31 = 0 THEN 0
                             WHEN l_returnflag = 'R' THEN -l_quantity
                             ELSE l_quantity END AS INTEGER) AS quantity,
                   o_orderdate AS order_date,
                   CAST(round(CAST(p_retailprice AS DECIMAL(10,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)
                        * CASE WHEN l_linenumber = 3 AND l_partkey % 37 = 0 THEN -1 ELSE 1 END
                        AS DECIMAL(10,2)) AS unit_price,
                   CAST(CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE o_custkey END AS INTEGER) AS customer_id,
                   CASE WHEN o_custkey % 30 = 1 AND o_orderkey % 2 = 0 THEN ' france '
                        ELSE ' ' || lower(n_name) || ' ' END AS country
            FROM lineitem
            JOIN orders ON o_orderkey = l_orderkey
            JOIN customer ON c_custkey = o_custkey
            JOIN nation ON n_nationkey = c_nationkey
            JOIN part ON p_partkey = l_partkey""",
        ),
        "lines": (["base"], "SELECT * FROM base UNION ALL SELECT * FROM base WHERE customer_id % 25 = 1"),
        "judged": (
            ["lines"],
            f"""
            SELECT invoice_no, customer_id, stock_code, order_date, quantity, unit_price,
                   coalesce(trim(invoice_no), '') <> '' AND coalesce(trim(stock_code), '') <> '' AS filled,
                   coalesce(CASE WHEN left(invoice_no, 1) = 'C' THEN quantity <> 0 ELSE quantity > 0 END, false) AS qty_ok,
                   coalesce(unit_price >= 0, false) AS price_ok,
                   coalesce(order_date BETWEEN TIMESTAMP '{p.window_start}' AND TIMESTAMP '{p.window_end}', false) AS date_ok
            FROM lines""",
        ),
        "numbered": (
            ["judged"],
            """
            SELECT *, row_number() OVER (
                       PARTITION BY invoice_no, stock_code, quantity, order_date
                       ORDER BY customer_id NULLS LAST, unit_price) AS copy_no
            FROM judged WHERE filled AND qty_ok AND price_ok AND date_ok""",
        ),
        "fact": (
            ["numbered"],
            """
            SELECT invoice_no AS order_id, customer_id, stock_code AS product_id, order_date, quantity, unit_price,
                   CAST(quantity * unit_price AS DECIMAL(12,2)) AS line_total,
                   CASE left(invoice_no, 1) WHEN 'C' THEN 'Cancelled' ELSE 'Completed' END AS order_status
            FROM numbered WHERE copy_no = 1""",
        ),
        "done": (["fact"], "SELECT * FROM fact WHERE order_status = 'Completed'"),
        "cust": (
            ["lines"],
            f"""
            SELECT DISTINCT ON (customer_id) customer_id, {_titled('country')} AS country
            FROM lines WHERE customer_id IS NOT NULL ORDER BY customer_id, {_titled('country')} DESC""",
        ),
        "spelled": (
            ["lines"],
            f"""
            SELECT stock_code,
                   CASE WHEN coalesce(trim(description), '') = '' THEN 'Unknown Product'
                        ELSE {_titled('description')} END AS description
            FROM (SELECT DISTINCT stock_code, description FROM lines WHERE stock_code IS NOT NULL)""",
        ),
        "prod": (
            ["spelled"],
            """
            SELECT DISTINCT ON (stock_code) stock_code AS product_id, description AS product_name
            FROM spelled ORDER BY stock_code, description DESC""",
        ),
        "tiles": (
            ["done"],
            """
            SELECT customer_id,
                   ntile(5) OVER (ORDER BY days_ago DESC, customer_id) AS r,
                   ntile(5) OVER (ORDER BY n_orders, customer_id) AS f,
                   ntile(5) OVER (ORDER BY spent, customer_id) AS m
            FROM (SELECT customer_id,
                         date_diff('day', CAST(max(order_date) AS DATE),
                                   (SELECT CAST(max(order_date) AS DATE) FROM done WHERE customer_id IS NOT NULL)) AS days_ago,
                         count(DISTINCT order_id) AS n_orders,
                         sum(quantity * unit_price) AS spent
                  FROM done WHERE customer_id IS NOT NULL GROUP BY customer_id)""",
        ),
        "seg": (
            ["tiles"],
            """
            SELECT customer_id,
                   CASE WHEN least(r, f, m) >= 4 THEN 'Champions'
                        WHEN least(f, m) >= 3 THEN 'Loyal'
                        WHEN r >= 4 AND f <= 2 THEN 'New'
                        WHEN r <= 2 AND f >= 3 THEN 'At Risk'
                        WHEN greatest(r, f) <= 2 THEN 'Lapsed'
                        ELSE 'Repeat' END AS customer_segment
            FROM tiles""",
        ),
        "dimc": (["cust", "seg"], "SELECT cust.*, customer_segment FROM cust LEFT JOIN seg USING (customer_id)"),
        "dimp": (
            ["prod", "done"],
            f"""
            SELECT product_id, product_name,
                   CAST(coalesce((SELECT {_half_up(_pennyths('sum(d.unit_price)'), '(100 * count(*))')}
                                  FROM done d WHERE d.product_id = prod.product_id HAVING count(*) > 0), 0)
                        AS DECIMAL(10,2)) AS avg_unit_price
            FROM prod""",
        ),
        "summ": (
            ["done", "cust"],
            f"""
            SELECT country, CAST(date_trunc('month', order_date) AS DATE) AS month,
                   sum(line_total) AS total_revenue, count(DISTINCT order_id) AS total_orders,
                   {_half_up(_cents('sum(line_total)'), 'count(DISTINCT order_id)')} AS average_order_value
            FROM done JOIN cust USING (customer_id) GROUP BY 1, 2""",
        ),
        "ret": (
            ["done"],
            f"""
            SELECT customer_id, total_orders, lifetime_spend, first_order_date, last_order_date,
                   CASE WHEN total_orders = 1 THEN 'New'
                        WHEN last_order_date < (SELECT CAST(max(order_date) AS DATE) FROM done)
                                               - INTERVAL {p.lapsed_after_days} DAY THEN 'Lapsed'
                        ELSE 'Repeat' END AS customer_status
            FROM (SELECT customer_id, count(DISTINCT order_id) AS total_orders, sum(line_total) AS lifetime_spend,
                         CAST(min(order_date) AS DATE) AS first_order_date,
                         CAST(max(order_date) AS DATE) AS last_order_date
                  FROM done WHERE customer_id IS NOT NULL GROUP BY customer_id)""",
        ),
        "perf": (
            ["done"],
            """
            SELECT product_id, month, units_sold, total_revenue,
                   dense_rank() OVER (PARTITION BY month ORDER BY total_revenue DESC) AS overall_rank
            FROM (SELECT product_id, CAST(date_trunc('month', order_date) AS DATE) AS month,
                         sum(quantity) AS units_sold, sum(line_total) AS total_revenue
                  FROM done GROUP BY 1, 2)""",
        ),
        "country_rev": (
            ["done", "cust"],
            "SELECT country, sum(line_total) AS rev FROM done JOIN cust USING (customer_id) GROUP BY 1",
        ),
        "prod_rev": (
            ["done", "prod"],
            """
            SELECT product_id, product_name, sum(line_total) AS rev
            FROM done JOIN prod USING (product_id) GROUP BY 1, 2""",
        ),
        "sold": (
            ["perf", "prod"],
            """
            SELECT product_id, product_name, sum(units_sold) AS units, sum(total_revenue) AS rev
            FROM perf JOIN prod USING (product_id) GROUP BY 1, 2""",
        ),
        "order_cents": (
            ["done"],
            f"""
            SELECT {_cents('sum(line_total)')} AS c FROM done GROUP BY order_id HAVING sum(line_total) > 0""",
        ),
        "segcount": (
            ["dimc"],
            """
            SELECT customer_segment, count(*) AS n FROM dimc WHERE customer_segment IS NOT NULL GROUP BY 1""",
        ),
        "kpi": (
            ["done", "cust", "ret"],
            """
            SELECT (SELECT sum(line_total) FROM done) AS rev,
                   (SELECT count(DISTINCT order_id) FROM done) AS n_orders,
                   (SELECT count(*) FROM cust) AS n_cust,
                   (SELECT count(*) FROM ret WHERE total_orders > 1) AS n_repeat,
                   (SELECT count(*) FROM ret) AS n_ret""",
        ),
    }


def _query(p: Params, needs: str, select: str, lines: str | None, where: str | None = None) -> str:
    """``lines`` replaces the lines that all else starts from; ``where`` leaves some out."""
    ctes = _ctes(p)
    if lines is not None:
        ctes["lines"] = ([], lines)
    if where is not None:
        ctes["lines"] = (ctes["lines"][0], f"SELECT * FROM ({ctes['lines'][1]}) WHERE {where}")
    order: list[str] = []

    def add(name: str) -> None:
        for parent in ctes[name][0]:
            add(parent)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    texts = ",\n     ".join(f"{name} AS ({ctes[name][1].strip()})" for name in order)
    return f"WITH {texts}\n{select.strip()}"


FLAGS = """filled AS is_valid_filled_invoice_no_stock_code, qty_ok AS is_valid_quantity,
           price_ok AS is_valid_unit_price, date_ok AS is_valid_date_window"""
ORDER = "invoice_no, customer_id, stock_code, order_date, quantity, CAST(unit_price AS DOUBLE) AS unit_price"
LINE = ORDER + ", description, country"


def _iso(date: str, name: str) -> str:
    return f"strftime({date}, '%Y-%m-%d') AS {name}"


def _dbl(amount: str, name: str) -> str:
    return f"CAST({amount} AS DOUBLE) AS {name}"


def _big(number: str, name: str) -> str:
    return f"CAST({number} AS BIGINT) AS {name}"


FACT = f"""order_id, customer_id, product_id, order_date, quantity, {_dbl('CAST(unit_price AS DECIMAL(10,2))', 'unit_price')},
           {_dbl('line_total', 'line_total')}, order_status"""


SUMMARY = f"""country, {_iso('month', 'month')}, {_dbl('total_revenue', 'total_revenue')}, CAST(total_orders AS INTEGER) AS total_orders,
           {_dbl('average_order_value', 'average_order_value')}"""
RETENTION = f"""customer_id, CAST(total_orders AS INTEGER) AS total_orders, {_dbl('lifetime_spend', 'lifetime_spend')},
           {_iso('first_order_date', 'first_order_date')}, {_iso('last_order_date', 'last_order_date')}, customer_status"""
PERFORMANCE = f"""product_id, {_iso('month', 'month')}, CAST(units_sold AS INTEGER) AS units_sold,
           {_dbl('total_revenue', 'total_revenue')}, CAST(overall_rank AS INTEGER) AS overall_rank"""


def _place(name: str, order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) AS {name}"


def _histogram(cap: str, bins: int) -> str:
    return f"""
        , v AS (SELECT c FROM order_cents WHERE c {cap} * 100),
          e AS (SELECT CASE WHEN min(c) = max(c) THEN min(c) - 50 ELSE min(c) END AS lo,
                       CASE WHEN min(c) = max(c) THEN max(c) + 50 ELSE max(c) END AS hi FROM v)
        SELECT {_big('b', 'bin')},
               {_dbl(f'CAST(lo * {bins} + b * (hi - lo) AS DECIMAL(20,0)) / {100 * bins}', 'bin_low')},
               {_dbl(f'CAST(lo * {bins} + (b + 1) * (hi - lo) AS DECIMAL(20,0)) / {100 * bins}', 'bin_high')},
               (SELECT count(*) FROM v
                WHERE (c - lo) * {bins} >= b * (hi - lo)
                  AND ((c - lo) * {bins} < (b + 1) * (hi - lo) OR b = {bins - 1})) AS orders
        FROM e, (SELECT unnest(range({bins})) AS b) WHERE lo IS NOT NULL"""


def _box(cap: int) -> str:
    def quartile(k: int) -> str:
        at = f"({k} * n / 4.0 - 0.5)"
        low = f"s[CAST(greatest(floor{at}, 0) AS INT) + 1]"
        high = f"s[CAST(least(floor{at} + 1, n - 1) AS INT) + 1]"
        return f"({low} + ({at} - floor{at}) * ({high} - {low}))"

    return f"""
        , v AS (SELECT c FROM order_cents WHERE c <= {cap} * 100),
          a AS (SELECT list_sort(list(CAST(c AS DOUBLE))) AS s, count(*) AS n FROM v HAVING count(*) > 0),
          q AS (SELECT n, s, {quartile(1)} AS q1, {quartile(2)} AS q2, {quartile(3)} AS q3 FROM a)
        SELECT {_big('n', 'orders')}, s[1] / 100 AS min_value, q1 / 100 AS q1, q2 / 100 AS median, q3 / 100 AS q3,
               s[-1] / 100 AS max_value,
               least(q1, list_min(list_filter(s, lambda x: x >= q1 - 1.5 * (q3 - q1)))) / 100 AS lower_fence,
               greatest(q3, list_max(list_filter(s, lambda x: x <= q3 + 1.5 * (q3 - q1)))) / 100 AS upper_fence
        FROM q"""


def _density(cap: int, points: int, bins: int) -> str:
    return f"""
        , v AS (SELECT c / 100.0::DOUBLE AS x FROM order_cents WHERE c < {cap} * 100),
          s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi,
                       stddev_samp(x) * pow(count(*), -0.2) AS width FROM v),
          g AS (SELECT CAST(p AS INTEGER) AS point, lo + (hi - lo) * p / {points - 1} AS pos, n, lo, hi, width
                FROM s, (SELECT unnest(range({points})) AS p) WHERE hi > lo),
          k AS (SELECT point, any_value(pos) AS pos, sum(exp(-0.5 * pow((pos - x) / width, 2)))
                       / any_value(n * width * sqrt(2 * pi())) AS d,
                       any_value(n * (hi - lo) / {bins}) AS scale
                FROM g, v GROUP BY point)
        SELECT point, round(pos, 6) AS order_value, round(d, 9) AS density, round(d * scale, 6) AS expected_orders
        FROM k"""


def _pivot(p: Params, monthly: str, ranking: str) -> str:
    cols = ",\n               ".join(
        f"""CAST(coalesce(sum(CASE WHEN strftime(month, '%Y-%m') = '{m}' THEN total_revenue END), 0) AS DOUBLE) AS "{m}\""""
        for m in p.months()
    )
    return f"""
        , best AS (SELECT country, CAST(row_number() OVER (ORDER BY rev DESC, country) AS INTEGER) AS country_rank
                   FROM ({ranking}) ORDER BY country_rank LIMIT 10)
        SELECT country, country_rank, {cols}
        FROM {monthly} JOIN best USING (country) GROUP BY country, country_rank"""


def _audit(p: Params) -> str:
    def null(table: str, cte: str, *columns: str) -> list[str]:
        return [
            f"SELECT '{table}' AS \"table\", 'not_null' AS \"check\", '{c}' AS \"column\","
            f" count(*) - count({c}) AS violations FROM {cte}"
            for c in columns
        ]

    def length(table: str, cte: str, column: str, most: int) -> str:
        return f"SELECT '{table}', 'length', '{column}', count(*) FROM {cte} WHERE length({column}) > {most}"

    def within(table: str, cte: str, type_: str, *columns: str) -> list[str]:
        return [
            f"SELECT '{table}', 'range', '{c}', count(*) FROM {cte} WHERE {c} IS NOT NULL AND try_cast({c} AS {type_}) IS NULL"
            for c in columns
        ]

    def key(table: str, cte: str, column: str) -> str:
        return f"SELECT '{table}', 'primary_key', '{column}', count({column}) - count(DISTINCT {column}) FROM {cte}"

    def parent(table: str, cte: str, column: str, target: str) -> str:
        return (
            f"SELECT '{table}', 'foreign_key', '{column}', count(*) FROM {cte} c WHERE c.{column} IS NOT NULL"
            f" AND NOT EXISTS (SELECT 1 FROM {target} t WHERE t.{column} = c.{column})"
        )

    parts = [
        *null("dim_customers", "dimc", "customer_id", "country"),
        *within("dim_customers", "dimc", "INTEGER", "customer_id"),
        length("dim_customers", "dimc", "country", 80),
        length("dim_customers", "dimc", "customer_segment", 40),
        key("dim_customers", "dimc", "customer_id"),
        *null("dim_products", "dimp", "product_id", "product_name", "avg_unit_price"),
        length("dim_products", "dimp", "product_id", 20),
        length("dim_products", "dimp", "product_name", 150),
        *within("dim_products", "dimp", "DECIMAL(10,2)", "avg_unit_price"),
        key("dim_products", "dimp", "product_id"),
        *null(
            "fact_orders", "fact", "order_id", "product_id", "order_date", "quantity", "unit_price", "line_total", "order_status"
        ),
        length("fact_orders", "fact", "order_id", 20),
        length("fact_orders", "fact", "product_id", 20),
        length("fact_orders", "fact", "order_status", 20),
        *within("fact_orders", "fact", "INTEGER", "customer_id", "quantity"),
        *within("fact_orders", "fact", "DECIMAL(10,2)", "unit_price"),
        *within("fact_orders", "fact", "DECIMAL(12,2)", "line_total"),
        parent("fact_orders", "fact", "customer_id", "dimc"),
        parent("fact_orders", "fact", "product_id", "dimp"),
        *null("revenue_summary", "summ", "country", "month", "total_revenue", "total_orders", "average_order_value"),
        length("revenue_summary", "summ", "country", 80),
        *within("revenue_summary", "summ", "INTEGER", "total_orders"),
        *within("revenue_summary", "summ", "DECIMAL(14,2)", "total_revenue"),
        *within("revenue_summary", "summ", "DECIMAL(10,2)", "average_order_value"),
        *null(
            "customer_retention", "ret", "customer_id", "total_orders", "lifetime_spend", "first_order_date",
            "last_order_date", "customer_status",
        ),
        *within("customer_retention", "ret", "INTEGER", "customer_id", "total_orders"),
        *within("customer_retention", "ret", "DECIMAL(14,2)", "lifetime_spend"),
        length("customer_retention", "ret", "customer_status", 30),
        parent("customer_retention", "ret", "customer_id", "dimc"),
        *null("product_performance", "perf", "product_id", "month", "units_sold", "total_revenue", "overall_rank"),
        length("product_performance", "perf", "product_id", 20),
        *within("product_performance", "perf", "INTEGER", "units_sold", "overall_rank"),
        *within("product_performance", "perf", "DECIMAL(14,2)", "total_revenue"),
        parent("product_performance", "perf", "product_id", "dimp"),
    ]
    return "\nUNION ALL ".join(parts)


TABLE_ROWS = [
    ("dim_customers", "Dimension - Customers", "dimc"),
    ("dim_products", "Dimension - Products", "dimp"),
    ("fact_orders", "Fact - Orders", "fact"),
    ("analytics.revenue_summary", "Reporting - Revenue Summary", "summ"),
    ("analytics.customer_retention", "Reporting - Customer Retention", "ret"),
    ("analytics.product_performance", "Reporting - Product Performance", "perf"),
]
ALL_TABLES = "dimc dimp fact summ ret perf"


def _figures() -> str:
    """Each table in a few rows, as the job hands them over."""
    parts = [
        ("fact_orders", "fact", "order_status || ' ' || strftime(order_date, '%Y-%m')", "sum(line_total)", "sum(quantity)"),
        ("revenue_summary", "summ", "strftime(month, '%Y-%m')", "sum(total_revenue)", "sum(total_orders)"),
        ("product_performance", "perf", "strftime(month, '%Y-%m')", "sum(total_revenue)", "sum(overall_rank)"),
        ("customer_retention", "ret", "customer_status", "sum(lifetime_spend)", "sum(total_orders)"),
        ("dim_customers", "dimc", "coalesce(customer_segment, 'none')", "0", "sum(customer_id)"),
        ("dim_products", "dimp", "'all'", "sum(avg_unit_price)", "0"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT '{key}' AS table_name, {part} AS part, count(*) AS row_count, {_dbl(amount, 'amount')}, {_big(number, 'number')} FROM {cte} GROUP BY 2"
        for key, cte, part, amount, number in parts
    )


def texts(p: Params = PARAMS, lines: str | None = None) -> dict[str, str]:
    """All texts; ``lines`` is SQL that replaces the lines derived from the order tables."""

    def q(needs: str, select: str) -> str:
        return _query(p, needs, select, lines)

    def counts(extra: str = "") -> str:
        return "\nUNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{label}' AS label, count(*) AS row_count FROM {cte}"
            for name, label, cte in TABLE_ROWS
        )

    all_good = "filled AND qty_ok AND price_ok AND date_ok"
    wide_cap = 5000
    return {
        # extracts, cleaning, validation, deduplication
        "raw_csv_ranges": q(
            "lines",
            f"""SELECT {LINE.replace('description', "replace(description, ' ', chr(10) || '\"') AS description")} FROM lines""",
        ),
        "raw_csv_scan": q("lines", f"SELECT {LINE} FROM lines"),
        "extract_customers": q("lines", "SELECT customer_id, country FROM lines WHERE customer_id IS NOT NULL GROUP BY ALL"),
        "extract_products": q("lines", "SELECT stock_code, description FROM lines WHERE stock_code IS NOT NULL GROUP BY ALL"),
        "extract_orders": q("lines", f"SELECT {ORDER} FROM lines"),
        "clean_customers": q(
            "lines",
            f"""SELECT customer_id, {_titled('country')} AS country
                FROM (SELECT DISTINCT customer_id, country FROM lines WHERE customer_id IS NOT NULL)""",
        ),
        "clean_products": q("spelled", "SELECT * FROM spelled"),
        "dq_flags": q("judged", f"SELECT {ORDER}, {FLAGS} FROM judged"),
        "valid_orders": q("judged", f"SELECT {ORDER} FROM judged WHERE {all_good}"),
        "rejected_orders": q("judged", f"SELECT {ORDER}, {FLAGS} FROM judged WHERE NOT ({all_good})"),
        "dq_summary": q(
            "judged",
            f"""SELECT count(*) AS input_rows,
                       count(*) FILTER ({all_good}) AS valid_rows,
                       count(*) FILTER (NOT ({all_good})) AS rejected_rows,
                       count(*) FILTER (NOT filled) AS failed_filled_invoice_no_stock_code,
                       count(*) FILTER (NOT qty_ok) AS failed_quantity,
                       count(*) FILTER (NOT price_ok) AS failed_unit_price,
                       count(*) FILTER (NOT date_ok) AS failed_date_window
                FROM judged""",
        ),
        "dedup_orders": q("numbered", f"SELECT {ORDER} FROM numbered WHERE copy_no = 1"),
        "duplicate_orders": q("numbered", f"SELECT {ORDER} FROM numbered WHERE copy_no > 1"),
        # star schema and marts
        "fact_orders": q("fact", f"SELECT {FACT} FROM fact"),
        "fact_orders_keyed": q(
            "fact",
            f"""SELECT row_number() OVER (ORDER BY order_id, customer_id NULLS LAST, product_id, order_date, quantity)
                       AS order_line_id, {FACT} FROM fact""",
        ),
        "revenue_summary_keyed": q("summ", f"SELECT {_place('summary_id', 'country, month')}, {SUMMARY} FROM summ"),
        "customer_retention_keyed": q("ret", f"SELECT {_place('retention_id', 'customer_id')}, {RETENTION} FROM ret"),
        "product_performance_keyed": q("perf", f"SELECT {_place('performance_id', 'product_id, month')}, {PERFORMANCE} FROM perf"),
        "table_preview_fact_orders": q(
            "fact", f"SELECT {FACT} FROM fact ORDER BY order_id, customer_id NULLS LAST, product_id, fact.order_date, quantity LIMIT 10"
        ),
        "table_preview_dim_products": q(
            "dimp", f"SELECT product_id, product_name, {_dbl('avg_unit_price', 'avg_unit_price')} FROM dimp ORDER BY product_id LIMIT 10"
        ),
        "table_preview_revenue_summary": q("summ", f"SELECT {SUMMARY} FROM summ ORDER BY country, summ.month LIMIT 10"),
        "table_preview_customer_retention": q("ret", f"SELECT {RETENTION} FROM ret ORDER BY customer_id LIMIT 10"),
        "table_preview_product_performance": q("perf", f"SELECT {PERFORMANCE} FROM perf ORDER BY product_id, perf.month LIMIT 10"),
        "dim_products": q("dimp", f"SELECT product_id, product_name, {_dbl('avg_unit_price', 'avg_unit_price')} FROM dimp"),
        "dim_customers": q("dimc", "SELECT * FROM dimc"),
        "rfm_segments": q("seg", "SELECT * FROM seg"),
        "revenue_summary": q(
            "summ",
            f"""SELECT country, {_iso('month', 'month')}, {_dbl('total_revenue', 'total_revenue')}, total_orders,
                       {_dbl('average_order_value', 'average_order_value')} FROM summ""",
        ),
        "customer_retention": q(
            "ret",
            f"""SELECT customer_id, total_orders, {_dbl('lifetime_spend', 'lifetime_spend')},
                       {_iso('first_order_date', 'first_order_date')}, {_iso('last_order_date', 'last_order_date')},
                       customer_status FROM ret""",
        ),
        "product_performance": q(
            "perf",
            f"""SELECT product_id, {_iso('month', 'month')}, {_big('units_sold', 'units_sold')},
                       {_dbl('total_revenue', 'total_revenue')}, CAST(overall_rank AS INTEGER) AS overall_rank FROM perf""",
        ),
        # reports
        "total_revenue": q("done", f"SELECT {_dbl('sum(line_total)', 'total_revenue')} FROM done"),
        "total_orders": q("done", "SELECT count(*) AS total_orders FROM (SELECT DISTINCT order_id FROM done)"),
        "kpi_metrics": q(
            "kpi",
            f"""SELECT {_dbl('rev', 'total_revenue')}, n_orders AS total_orders, n_cust AS total_customers,
                       n_repeat AS repeat_customers, n_ret AS total_retention_customers FROM kpi""",
        ),
        "avg_order_value_per_segment": q(
            "done dimc",
            f"""SELECT customer_segment,
                       {_dbl(_half_up(_cents('sum(line_total)'), 'count(DISTINCT order_id)'), 'average_order_value')}
                FROM done JOIN dimc USING (customer_id) GROUP BY customer_segment""",
        ),
        "consecutive_months_purchasers": q(
            "done",
            """, m AS (SELECT DISTINCT customer_id, date_trunc('month', order_date) AS month
                       FROM done WHERE customer_id IS NOT NULL)
               SELECT DISTINCT a.customer_id FROM m a JOIN m b
               ON a.customer_id = b.customer_id AND b.month = a.month + INTERVAL 1 MONTH""",
        ),
        "customer_segment_distribution": q("segcount", 'SELECT customer_segment, n AS "count" FROM segcount'),
        "top_10_customers": q(
            "done cust",
            f"""SELECT customer_id, country, {_dbl('sum(line_total)', 'lifetime_spend')}
                FROM done JOIN cust USING (customer_id) GROUP BY 1, 2
                ORDER BY sum(line_total) DESC, customer_id LIMIT 10""",
        ),
        "revenue_per_country": q("country_rev", f"SELECT country, {_dbl('rev', 'total_revenue')} FROM country_rev"),
        "heatmap_revenue": q("summ", f"SELECT country, {_iso('month', 'month')}, {_dbl('total_revenue', 'revenue')} FROM summ"),
        "monthly_revenue_trends": q(
            "done cust",
            f"""SELECT country, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
                       {_dbl('sum(line_total)', 'total_revenue')}
                FROM done JOIN cust USING (customer_id) GROUP BY 1, 2, 3""",
        ),
        "running_total_revenue": q(
            "done",
            f""", m AS (SELECT date_trunc('month', order_date) AS month, sum(line_total) AS rev FROM done GROUP BY 1)
                SELECT {_iso('a.month', 'revenue_month')}, {_dbl('any_value(a.rev)', 'monthly_revenue')},
                       {_dbl('sum(b.rev)', 'running_total')}
                FROM m a JOIN m b ON b.month <= a.month GROUP BY a.month""",
        ),
        "rolling_orders": q(
            "done cust",
            """, m AS (SELECT DISTINCT country, date_trunc('month', order_date) AS month, order_id FROM done JOIN cust USING (customer_id)),
                 ends AS (SELECT DISTINCT country, unnest([month, month + INTERVAL 1 MONTH, month + INTERVAL 2 MONTH]) AS until FROM m)
               SELECT country, strftime(until, '%Y-%m') AS year_month, count(DISTINCT order_id) AS total_orders
               FROM ends JOIN m USING (country) WHERE month BETWEEN until - INTERVAL 2 MONTH AND until
                 AND until <= (SELECT max(month) FROM m) GROUP BY 1, 2""",
        ),
        "order_status_distribution": q(
            "fact", "SELECT order_status, count(DISTINCT order_id) AS total_orders FROM fact GROUP BY 1"
        ),
        "order_value_distribution": q(
            "done",
            f"""SELECT order_id, {_dbl('sum(line_total)', 'order_value')} FROM done
                GROUP BY order_id HAVING sum(line_total) > 0""",
        ),
        "product_revenue_ranking": q(
            "prod_rev",
            f"""SELECT product_id, product_name, {_dbl('rev', 'total_revenue')},
                       CAST(dense_rank() OVER (ORDER BY rev DESC) AS INTEGER) AS revenue_rank FROM prod_rev""",
        ),
        "product_units_sold": q(
            "sold",
            f"SELECT product_id, product_name, {_big('units', 'total_units')}, {_dbl('rev', 'total_revenue')} FROM sold",
        ),
        "no_sales_last_60_days": q(
            "fact prod",
            f"""SELECT product_id, product_name FROM prod
                WHERE product_id NOT IN (
                    SELECT product_id FROM fact
                    WHERE order_date >= (SELECT max(order_date) FROM fact) - INTERVAL {p.quiet_days} DAY)""",
        ),
        "top_product_per_country": q(
            "done cust prod",
            f"""SELECT country, product_id, product_name, {_dbl('rev', 'total_revenue')}, 1 AS product_rank
                FROM (SELECT country, product_id, product_name, sum(line_total) AS rev
                      FROM done JOIN cust USING (customer_id) JOIN prod USING (product_id) GROUP BY ALL)
                QUALIFY rank() OVER (PARTITION BY country ORDER BY rev DESC) = 1""",
        ),
        # shapes
        "kpi_cards": q(
            "kpi",
            f"""SELECT {_dbl('coalesce(rev, 0)', 'total_revenue')}, n_orders AS total_orders, n_cust AS total_customers,
                       {_dbl(f"CASE n_orders WHEN 0 THEN 0 ELSE {_half_up(_cents('rev'), 'n_orders')} END", 'average_order_value')},
                       {_dbl(f"CASE n_ret WHEN 0 THEN 0 ELSE {_half_up('n_repeat * 10000', 'n_ret')} END", 'repeat_rate_pct')}
                FROM kpi""",
        ),
        "segment_share": q(
            "segcount",
            """SELECT customer_segment, n AS "count",
                      CAST((2 * 1000 * n + s) // (2 * s) / 10.0 AS DOUBLE) AS share_pct
               FROM segcount, (SELECT CAST(sum(n) AS BIGINT) AS s FROM segcount)""",
        ),
        "top_countries": q(
            "country_rev",
            f"SELECT country, {_dbl('rev', 'total_revenue')} FROM country_rev ORDER BY rev DESC, country LIMIT 10",
        ),
        "heatmap_pivot": q("summ", _pivot(p, "summ", "SELECT country, sum(total_revenue) AS rev FROM summ GROUP BY 1")),
        "heatmap_pivot_by_country_revenue": q("summ country_rev", _pivot(p, "summ", "SELECT * FROM country_rev")),
        "top_bottom_products": q(
            "sold",
            f""", t AS (SELECT *, row_number() OVER (ORDER BY units DESC, product_id) AS from_top,
                               row_number() OVER (ORDER BY units, product_id) AS from_bottom FROM sold)
                SELECT 'top' AS side, CAST(from_top AS INTEGER) AS place, product_id, product_name,
                       {_big('units', 'total_units')}, {_dbl('rev', 'total_revenue')} FROM t WHERE from_top <= 5
                UNION ALL
                SELECT 'bottom', CAST(from_bottom AS INTEGER), product_id, product_name, CAST(units AS BIGINT),
                       CAST(rev AS DOUBLE) FROM t WHERE from_bottom <= 5""",
        ),
        "product_ranking_top50": q(
            "prod_rev",
            f"""SELECT product_id, product_name, {_dbl('rev', 'total_revenue')},
                       CAST(dense_rank() OVER (ORDER BY rev DESC) AS INTEGER) AS revenue_rank
                FROM prod_rev ORDER BY revenue_rank, product_id LIMIT 50""",
        ),
        "order_value_histogram": q("order_cents", _histogram(f"<= {p.order_value_cap}", p.histogram_bins)),
        "order_value_histogram_below_cap": q("order_cents", _histogram(f"< {p.order_value_cap}", p.histogram_bins)),
        "order_value_histogram_widest": q("order_cents", _histogram(f"<= {wide_cap}", p.histogram_bins)),
        "order_value_box": q("order_cents", _box(p.order_value_cap)),
        "order_value_box_widest": q("order_cents", _box(wide_cap)),
        "order_value_density": q("order_cents", _density(p.order_value_cap, p.density_points, p.histogram_bins)),
        # tables and jobs
        "table_counts": q(ALL_TABLES, counts()),
        "table_preview": q("dimc", "SELECT * FROM dimc ORDER BY customer_id LIMIT 10"),
        "constraint_audit": q(ALL_TABLES, _audit(p)),
        "curated_write": q(
            "fact",
            f"""SELECT strftime(order_date, '%Y-%m') AS year_month, order_status, count(*) AS line_count,
                       {_big('sum(quantity)', 'units')}, {_dbl('sum(line_total)', 'revenue')}
                FROM fact GROUP BY 1, 2""",
        ),
        "clustered_lookups": q(
            "fact",
            "\nUNION ALL ".join(
                f"""SELECT '{c}' AS looked_up, CAST({c} AS VARCHAR) AS key, count(*) AS line_count,
                           {_big('sum(quantity)', 'units')}, {_dbl('sum(line_total)', 'revenue')}
                    FROM fact WHERE CASE WHEN regexp_full_match(CAST({c} AS VARCHAR), '[0-9]{{1,9}}') THEN CAST({c} AS INTEGER) % 97 = 1 END
                    GROUP BY 2"""
                for c in ("customer_id", "product_id")
            ),
        ),
        "curated_tables": q(ALL_TABLES, counts()),
        "incremental_tables": "\nUNION ALL ".join(
            f"SELECT CAST({v} AS INTEGER) AS version, * FROM ({_query(p, ALL_TABLES, _figures(), lines, where)})"
            for v, where in (
                (1, "coalesce(customer_id, 0) % 3 < 1"),
                (2, "coalesce(customer_id, 0) % 3 < 2"),
                (3, "true"),
            )
        ),
        "followed_files": q(ALL_TABLES, f"SELECT * FROM ({_figures()})"),
        "file_arrivals": q(
            "lines",
            f"""SELECT country, count(*) AS line_count, {_big('sum(quantity)', 'units')}, {_dbl('sum(quantity * unit_price)', 'amount')}
                FROM lines GROUP BY 1""",
        ),
        "ingest_available_now": q(
            "judged",
            f"""SELECT CASE WHEN {all_good} THEN 'valid' ELSE 'rejected' END AS verdict, count(*) AS line_count,
                       {_big('sum(quantity)', 'units')}, {_dbl('sum(quantity * unit_price)', 'amount')}
                FROM judged GROUP BY 1""",
        ),
    }
