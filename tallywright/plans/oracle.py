"""The registered queries in plain SQL, written from the rules and not from the operators."""

from __future__ import annotations

from tallywright.plans import registry as Q
from tallywright.plans import star as S
from tallywright.schemas import DEFAULT_BASE_INCOME, NO_DATA, SHARED_SOURCE, TOTAL_LABEL, UNCATEGORISED


def _sql(text: str) -> str:
    """Placeholders of the shared SQL texts as DuckDB names."""
    for table in (*S.RAW_TABLES, "products"):
        text = text.replace(f"{{{table}}}", table)
    return text.replace("{categories}", "cats").replace("{STR}", "VARCHAR")


def _numbered(column: str) -> str:
    return (
        f"SELECT row_number() OVER (ORDER BY substr(md5(name), 1, 2), name) AS id, name "
        f"FROM (SELECT DISTINCT {column} AS name FROM part) n"
    )


_CTES = {
    "sales": _sql(S.SALES),
    "intraday": _sql(S.SALES_INTRADAY),
    "contacts": _sql(S.CONTACTS),
    "products": _numbered("p_name"),
    "cats": _numbered("p_type"),
    "links": _sql(S.LINKS),
    "cur_orders": _sql(S.CURRENT_ORDERS),
    "in_orders": _sql(S.INCOMING_ORDERS),
    "rep_orders": _sql(S.REPEATED_ORDERS),
    "cur_contacts": _sql(S.CURRENT_CONTACTS),
    "in_contacts": _sql(S.INCOMING_CONTACTS),
    "before": _sql(S.SALES_BEFORE),
    "batch": _sql(S.SALES_BATCH),
    "after": """SELECT id, content, status, creation_date, utm_source, income FROM before WHERE id NOT IN (SELECT id FROM batch)
        UNION ALL SELECT id, content, status, creation_date, utm_source, income FROM batch""",
    "after_linked": """SELECT s.*, l.category_id, c.name AS category
        FROM after s JOIN products p ON s.content = p.name
        JOIN links l ON l.product_id = p.id JOIN cats c ON c.id = l.category_id""",
    "order_text": _sql(S.ORDER_UPLOAD_TEXT),
    "contact_text": _sql(S.CONTACT_UPLOAD_TEXT),
    "linked": """SELECT s.*, l.category_id, c.name AS category
        FROM sales s JOIN products p ON s.content = p.name
        JOIN links l ON l.product_id = p.id JOIN cats c ON c.id = l.category_id""",
}
_CATALOG = ("products", "cats", "links")
_LINKED = ("sales", *_CATALOG, "linked")
_AFTER = ("before", "batch", "after")
_AFTER_LINKED = (*_AFTER, *_CATALOG, "after_linked")


def _with(names, body: str) -> str:
    ctes = ",\n".join(f"{n} AS ({_CTES[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


def _days(start: str, end: str, ts: str = "creation_date") -> str:
    return f"{ts} >= TIMESTAMP '{start} 00:00:00' AND {ts} < TIMESTAMP '{end} 00:00:00' + INTERVAL 1 DAY"


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ids(values) -> str:
    return ", ".join(str(v) for v in values)


def _time(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def _num(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


def _r2(expr: str) -> str:
    return f"round_even({expr}, 2)"


_YEAR = _days(Q.START, Q.END)
_EVER = _days(Q.ALL_START, Q.ALL_END)
_EVENTS = _days(Q.EVENT_START, Q.EVENT_END)
_CHOSEN = (
    f"category_id IN ({_ids(Q.SOME_CATEGORIES + Q.BAD_CATEGORIES)}) "
    f"AND category_id NOT IN ({_ids(Q.BAD_CATEGORIES)}) AND content NOT IN ({_texts(Q.DROPPED)})"
)
_ONE = f"category_id = {Q.ONE_CATEGORY}"
_MONTH = "strftime(creation_date, '%Y-%m')"
_COUNTS = "count(*) AS total_orders, count(CASE WHEN income > 0 THEN 1 END) AS paid_orders"
_SUMMARY = f"""content AS product, {_COUNTS}, {_num('sum(income)', 'total_income')}"""
_CHECK = (
    "CAST(sum(CASE WHEN income > 0 THEN income END) AS DOUBLE)"
    " / count(CASE WHEN income > 0 THEN 1 END)"
)


def _monthly(source: str, where: str, *keys: str) -> str:
    """A monthly report with decimal amounts, for further use."""
    extra = "".join(f", {k}" for k in keys)
    return (
        f"SELECT {_MONTH} AS month{extra}, sum(income) AS total_sales, {_COUNTS} FROM {source} "
        f"WHERE income > 0 AND {where} GROUP BY {_MONTH}{''.join(', ' + k.split(' AS ')[0] for k in keys)}"
    )


def _as_double(report: str, column: str = "total_sales") -> str:
    return f"SELECT * REPLACE (CAST({column} AS DOUBLE) AS {column}) FROM ({report}) r"


def _monthly_total(report: str, key: str | None) -> str:
    label = f", '' AS {key}" if key else ""
    shown = f", {key}" if key else ""
    return (
        f"SELECT month{shown}, {_num('total_sales', 'total_sales')}, total_orders, paid_orders, "
        f"false AS is_total FROM ({report}) a UNION ALL "
        f"SELECT '{TOTAL_LABEL}' AS month{label}, {_num('sum(total_sales)', 'total_sales')}, "
        f"CAST(sum(total_orders) AS BIGINT), CAST(sum(paid_orders) AS BIGINT), true FROM ({report}) b"
    )


def _kpis(report: str) -> str:
    return (
        f"SELECT {_num('sum(total_sales)', 'total_sales')}, "
        f"CAST(sum(paid_orders) AS BIGINT) AS paid_orders, "
        f"CAST(sum(total_sales) AS DOUBLE) / sum(paid_orders) AS average_check, "
        f"CAST(sum(total_sales) AS DOUBLE) / count(DISTINCT month) AS average_monthly_income "
        f"FROM ({report}) r"
    )


def _money(column: str) -> str:
    return f"replace(format('{{:,.2f}}', CAST({column} AS DOUBLE)), ',', ' ') AS {column}"


def _partners(where: str) -> str:
    return (
        f"SELECT coalesce(c.full_name, '{SHARED_SOURCE}') AS partner, s.utm_source, "
        f"count(*) AS order_count, sum(s.income) AS total_income "
        f"FROM sales s LEFT JOIN contacts c ON s.utm_source = c.id WHERE {where} GROUP BY 1, 2"
    )


_PARTNER_YEAR = _days(Q.START, Q.END, "s.creation_date")
_PARTNER_EVER = _days(Q.ALL_START, Q.ALL_END, "s.creation_date")
_NAMED_ONLY = f"coalesce(c.full_name, '{SHARED_SOURCE}') <> '{SHARED_SOURCE}'"


def _cumulative(source: str, where: str) -> str:
    """Daily and running income with decimal amounts."""
    return f"""SELECT *, sum(daily_sales) OVER (ORDER BY date) AS cumulative_sales FROM (
        SELECT CAST(CAST(creation_date AS DATE) AS VARCHAR) AS date, sum(income) AS daily_sales, {_COUNTS}
        FROM {source} WHERE {where} GROUP BY 1) d"""


def _cumulative_double(source: str, where: str) -> str:
    return f"""SELECT * REPLACE (CAST(daily_sales AS DOUBLE) AS daily_sales,
        CAST(cumulative_sales AS DOUBLE) AS cumulative_sales) FROM ({_cumulative(source, where)}) c"""


_PICKED_EVER = f"content IN ({_texts(Q.PICKED)}) AND {_EVER}"
_ROUNDED_DAYS = f"""SELECT date, total_orders, paid_orders,
    {_num(_r2('daily_sales'), 'daily_sales')}, {_num(_r2('cumulative_sales'), 'cumulative_sales')}
    FROM ({_cumulative('sales', _PICKED_EVER)}) c"""


def _percent(column: str) -> str:
    return _r2(f"CAST({column} / {DEFAULT_BASE_INCOME} * 100.0 AS DECIMAL(30,10))")


def _fund(visible: bool) -> str:
    shown = "true" if visible else "false"
    total = f"(SELECT {_r2('sum(income)')} AS t, max(creation_date) AS m FROM linked WHERE {_ONE} AND {_YEAR})"
    figure = (lambda e: f"CAST({e} AS DOUBLE)") if visible else (lambda e: "CAST(NULL AS DOUBLE)")
    title = (
        f"concat('{Q.FUND_TITLE} на ', strftime(m AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Moscow', '%d.%m.%Y %H:%M'))"
        if visible else f"'{Q.FUND_TITLE}'"
    )
    return f"""SELECT {_num('t', 'total_income')}, {shown} AS visible, {title} AS title,
        {figure('t * 0.20')} AS fund_income, {figure('t * 0.20 * 0.94')} AS fund_after_tax,
        {figure('t * 0.20 * 0.94')} / 3 AS employee_income FROM {total} x"""


def _freshness(orders: str) -> str:
    def local(column: str) -> str:
        return (
            f"coalesce(strftime({column} AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Moscow', "
            f"'%d-%m-%Y %H:%M'), '{NO_DATA}')"
        )

    return f"""SELECT {_time('o', 'latest_order')}, {_time('c', 'latest_contact')},
        {local('o')} AS latest_order_text, {local('c')} AS latest_contact_text
        FROM (SELECT (SELECT max(creation_date) FROM {orders}) AS o,
                     (SELECT max(creation_date) FROM contacts) AS c) x"""


_MARKED = """SELECT r.id, count(*) AS copies, max(CASE WHEN c.id IS NULL THEN 0 ELSE 1 END) AS found
    FROM rep_orders r LEFT JOIN cur_orders c ON c.id = r.id GROUP BY r.id"""

_ORDER_TIME = """CASE WHEN o_orderkey % 10 = 9 THEN NULL
    WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 37230 SECOND
    WHEN o_orderkey % 4 = 3 THEN o_orderdate + INTERVAL 425 MINUTE ELSE o_orderdate END"""
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE)"
_ORDER_DATES = f"""{_time(_ORDER_TIME, 'creation_date')},
    {_time("CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END", 'payment_date')},
    CAST(NULL AS VARCHAR) AS gc_order_date"""
_ORDER_AMOUNTS = f"""CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN {_PRICE} END AS total_amount,
    CASE WHEN o_orderkey % 17 <> 0 THEN {_PRICE} END AS paid_amount,
    CAST(0 AS DOUBLE) AS discount_amount,
    CASE WHEN o_orderstatus = 'F' THEN {_PRICE} ELSE 0.0 END AS income,
    CAST(NULL AS DOUBLE) AS commission, CAST(12.5 AS DOUBLE) AS partner_commission"""
_KEPT_ORDER = "o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0"
_ORDER_NUMBER = "concat('N-', CAST(o_orderkey AS VARCHAR)) AS number"

_ASKED = """asked AS (SELECT DISTINCT p_brand AS name FROM part
    UNION ALL SELECT CASE WHEN p_size <> 50 THEN p_type END FROM part)"""


def oracle_queries() -> dict[str, str]:
    by_product_ever = f"SELECT content AS product, {_COUNTS}, {_num('sum(income)', 'income')} FROM linked WHERE {_EVER}"
    revenue = "SELECT category AS category_name, sum(income) AS total_revenue FROM linked WHERE income > 0"
    summary_ever = f"SELECT {_SUMMARY}, {_CHECK} AS average_check FROM sales WHERE {_EVER} GROUP BY content"
    check2 = _r2(f"CAST({_CHECK} AS DECIMAL(30,10))")
    paid_ever = f"SELECT content AS product, {_COUNTS}, sum(income) AS total_income FROM sales WHERE {_EVER} GROUP BY content HAVING sum(CASE WHEN income > 0 THEN 1 ELSE 0 END) > 0"
    month_ever = _monthly("sales", _EVER)
    product_year = _monthly("sales", _YEAR, "content AS product")
    product_ever = _monthly("sales", _EVER, "content AS product")
    category_ever = _monthly("linked", _EVER, "category")
    chosen = f"{_YEAR} AND {_CHOSEN}"
    return {
        # --- uploads
        "ingest_orders": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, {_ORDER_NUMBER},
            CASE WHEN o_custkey % 4 <> 0 THEN concat('Name ', CAST(o_custkey AS VARCHAR)) END AS contact_name,
            concat('Surname ', CAST(o_custkey AS VARCHAR)) AS contact_surname,
            concat('c', CAST(o_custkey AS VARCHAR), '@mail.test') AS contact_email,
            o_orderpriority AS responsible_person,
            concat('Product ', CAST(o_orderkey % 50 AS VARCHAR)) AS content, o_orderstatus AS status,
            {_ORDER_AMOUNTS}, {_ORDER_DATES}, 'RUB' AS currency, CAST(NULL AS VARCHAR) AS tags,
            CAST(o_custkey AS VARCHAR) AS partner_id, CAST(NULL AS VARCHAR) AS partner_email,
            '+7000' AS contact_phone, CAST(o_custkey AS VARCHAR) AS contact_id,
            'promo' AS utm_campaign, 'banner' AS utm_content, 'cpc' AS utm_medium,
            CAST(o_custkey AS VARCHAR) AS utm_source, 'v2.0' AS utm_term
            FROM orders WHERE {_KEPT_ORDER}""",
        "ingest_contacts": """SELECT CAST(c_custkey AS VARCHAR) AS id,
            CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS full_name, 'First' AS first_name,
            CAST(NULL AS VARCHAR) AS middle_name, 'Last' AS last_name,
            concat('c', CAST(c_custkey AS VARCHAR), '@mail.test') AS email,
            concat('c', CAST(c_custkey AS VARCHAR), '@mail.test, other@mail.test') AS emails,
            '+7000' AS phone, '+7000, +7001' AS phones, 'RU' AS country, n_name AS city,
            CAST(NULL AS VARCHAR) AS region, 'a, b' AS tags, c_mktsegment AS groups,
            CASE WHEN c_custkey % 3 <> 0 THEN '2020-02-29 12:00:00' END AS creation_date,
            '1990-02-01 00:00:00' AS birthday, CAST(NULL AS VARCHAR) AS last_online,
            '2021-03-04 00:00:00' AS last_activity,
            CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS total_paid,
            CASE WHEN c_custkey % 2 = 0 THEN CAST(10 AS DOUBLE) END AS gamification_score,
            CAST(NULL AS DOUBLE) AS bonus_balance, '7' AS partner_id, 'google' AS first_utm_source,
            CAST(c_custkey AS VARCHAR) AS last_utm_source, CAST(c_custkey AS VARCHAR) AS tg_id
            FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 19 <> 0""",
        "header_check": """SELECT kind, "column", (SELECT count(*) FROM orders) AS refused_rows
            FROM (VALUES ('missing', 'Валюта'), ('missing', 'UTM Term'), ('extra', 'Extra')) v(kind, "column")""",
        "rename_columns": _with(["contact_text"], "SELECT * FROM contact_text"),
        "parse_dates": f"SELECT {_ORDER_NUMBER}, {_ORDER_DATES} FROM orders",
        "null_normalize": _with(["order_text"], """SELECT number,
            CASE WHEN id NOT IN ('', 'NULL') THEN id END AS id,
            CASE WHEN contact_name <> 'N/A' THEN contact_name END AS contact_name,
            CAST(NULL AS VARCHAR) AS tags,
            CASE WHEN paid_amount <> 'NaN' THEN paid_amount END AS paid_amount,
            CAST(NULL AS VARCHAR) AS commission, CAST(NULL AS VARCHAR) AS partner_email,
            CAST(NULL AS VARCHAR) AS gc_order_date FROM order_text"""),
        "cast_money": f"SELECT {_ORDER_NUMBER}, {_ORDER_AMOUNTS} FROM orders",
        "drop_empty_keys": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id,
            CAST(o_custkey AS VARCHAR) AS contact_id, CAST(o_custkey AS VARCHAR) AS utm_source,
            'v2.0' AS utm_term FROM orders WHERE {_KEPT_ORDER}""",
        "project_to_model": _with(["order_text"], "SELECT * FROM order_text"),
        # --- keyed writes
        "upsert_orders": _with(["cur_orders", "in_orders"], f"""SELECT coalesce(i.id, c.id) AS id,
            CASE WHEN i.id IS NULL THEN c.status ELSE i.status END AS status,
            CASE WHEN i.id IS NULL THEN c.total_amount ELSE i.total_amount END AS total_amount,
            {_time('CASE WHEN i.id IS NULL THEN c.creation_date ELSE i.creation_date END', 'creation_date')},
            c.recipient_last_name FROM cur_orders c FULL JOIN in_orders i ON i.id = c.id"""),
        "upsert_contacts": _with(["cur_contacts", "in_contacts"], """SELECT coalesce(i.id, c.id) AS id,
            CASE WHEN i.id IS NULL THEN c.full_name ELSE i.full_name END AS full_name, c.groups,
            CASE WHEN i.id IS NULL THEN c.total_paid ELSE i.total_paid END AS total_paid
            FROM cur_contacts c FULL JOIN in_contacts i ON i.id = c.id"""),
        "upsert_counts": _with(["cur_orders", "rep_orders"], f"""SELECT
            CAST(sum(CASE WHEN found = 0 THEN copies ELSE 0 END) AS BIGINT) AS created,
            CAST(sum(CASE WHEN found = 1 THEN copies ELSE 0 END) AS BIGINT) AS updated
            FROM ({_MARKED}) m"""),
        "upsert_dedup": _with(["rep_orders"], f"""SELECT id, status, total_amount,
            {_time('creation_date', 'creation_date')}, copies FROM (SELECT *,
            count(*) OVER (PARTITION BY id) AS copies,
            row_number() OVER (PARTITION BY id ORDER BY __row DESC) AS rn FROM rep_orders) r
            WHERE rn = 1"""),
        "upsert_conflicts": _with(["cur_orders", "rep_orders"],
            f"SELECT id, copies FROM ({_MARKED}) m WHERE found = 0 AND copies > 1"),
        "export_rows": _with(["sales"], f"""SELECT id, number, coalesce(content, '') AS content, status,
            {_time('creation_date', 'creation_date')}, utm_source, {_num('income', 'income')} FROM sales"""),
        "export_roundtrip": _with(["sales", "contacts", *_CATALOG], f"""
            SELECT 'orders' AS name, concat_ws('|', id, number,
                coalesce('  ' || content || ' "q", ' || chr(10) || ' end ', ''), status,
                {_time('creation_date', 'x')[:-5]}, utm_source,
                coalesce(CAST(CAST(floor(income) AS DOUBLE) * 1e6 + 0.5 AS VARCHAR), '')) AS cells FROM sales
            UNION ALL SELECT 'contacts', concat_ws('|', id, coalesce(chr(9) || full_name || ' ', ''),
                coalesce({_time('creation_date', 'x')[:-5]}, '')) FROM contacts
            UNION ALL SELECT 'products', concat_ws('|', id, name) FROM products
            UNION ALL SELECT 'product_categories', concat_ws('|', id, name) FROM cats
            UNION ALL SELECT 'product_category_association', concat_ws('|', product_id, category_id) FROM links"""),
        "table_counts": _with(["sales", "contacts", *_CATALOG], """
            SELECT 'orders' AS name, count(*) AS rows FROM sales
            UNION ALL SELECT 'contacts', count(*) FROM contacts
            UNION ALL SELECT 'products', count(*) FROM products
            UNION ALL SELECT 'product_categories', count(*) FROM cats
            UNION ALL SELECT 'product_category_association', count(*) FROM links"""),
        "partner_export": _with(["sales", "contacts"], f"""SELECT partner AS "Партнер",
            utm_source AS "UTM Source", order_count AS "Количество регистраций",
            {_num(_r2('total_income'), '"Доход"')} FROM ({_partners(_PARTNER_YEAR)}) p"""),
        # --- filters
        "filter_period": _with(["intraday"],
            f"SELECT id, content, {_num('income', 'income')}, utm_source FROM intraday WHERE {_EVENTS}"),
        "category_revenue_all_time": _with(_LINKED,
            _as_double(f"{revenue} GROUP BY category", "total_revenue")),
        "filter_products_in": _with(["sales"],
            f"SELECT id, content, {_num('income', 'income')} FROM sales WHERE content IN ({_texts(Q.PICKED)})"),
        "filter_products_not_in": _with(["sales"],
            f"SELECT id, content, {_num('income', 'income')} FROM sales WHERE content NOT IN ({_texts(Q.DROPPED)})"),
        "filter_category_eq": _with(_LINKED, f"{by_product_ever} AND {_ONE} GROUP BY content"),
        "filter_categories_in": _with(_LINKED,
            f"{by_product_ever} AND category_id IN ({_ids(Q.SOME_CATEGORIES)}) GROUP BY content"),
        "filter_categories_not_in": _with(_LINKED,
            f"{by_product_ever} AND category_id NOT IN ({_ids(Q.BAD_CATEGORIES)}) GROUP BY content"),
        "filter_paid": _with(["intraday"],
            f"SELECT id, content, {_num('income', 'income')} FROM intraday WHERE income > 0"),
        "unique_products": _with(["sales"],
            "SELECT DISTINCT content AS product FROM sales WHERE content IS NOT NULL"),
        "unique_products_in_categories": _with(_LINKED,
            f"SELECT DISTINCT content AS product FROM linked WHERE category_id IN ({_ids(Q.SOME_CATEGORIES)})"),
        "partner_report_named": _with(["sales", "contacts"],
            _as_double(_partners(f"{_PARTNER_YEAR} AND {_NAMED_ONLY}"), "total_income")),
        "product_detail": _with(_CATALOG, f"""SELECT p.id, p.name,
            CAST(to_json(list_sort(coalesce(list(c.name) FILTER (WHERE c.name IS NOT NULL), []))) AS VARCHAR) AS categories
            FROM products p LEFT JOIN links l ON l.product_id = p.id LEFT JOIN cats c ON c.id = l.category_id
            WHERE p.id = {Q.PRODUCT_ID} GROUP BY p.id, p.name"""),
        "contact_detail": _with(["contacts"], f"SELECT id, full_name FROM contacts WHERE id = '{Q.SOURCE}'"),
        "orders_by_source": _with(["sales"], f"""SELECT id, number, status,
            {_time('creation_date', 'creation_date')}, content, {_num('income', 'income')}, utm_source
            FROM sales WHERE utm_source = '{Q.SOURCE}'"""),
        "product_search": _with(["products"],
            "SELECT id, name FROM products WHERE position('red' IN lower(name)) > 0"),
        "products_uncategorized": _with(_CATALOG,
            "SELECT id, name FROM products WHERE id NOT IN (SELECT product_id FROM links)"),
        "products_uncategorized_search": _with(_CATALOG, """SELECT id, name FROM products
            WHERE id NOT IN (SELECT product_id FROM links) AND position('ring' IN lower(name)) > 0"""),
        "refine_result": _with(["sales"],
            f"SELECT * FROM ({summary_ever}) s WHERE paid_orders > 10 AND product LIKE '%widget'"),
        # --- joins
        "join_category_bridge": _with(_LINKED, f"""SELECT id, content, {_num('income', 'income')}, category_id
            FROM linked WHERE {_YEAR} AND category_id IN ({_ids(Q.SOME_CATEGORIES)})"""),
        "join_category_bridge_spread": _with(_LINKED,
            f"SELECT id, content, {_num('income', 'income')}, category_id FROM linked WHERE {_EVER}"),
        "filter_typed": _with(["sales"], f"""SELECT * FROM ({summary_ever}) s WHERE position('widget' IN lower(product)) > 0
            AND paid_orders > 10 AND total_income >= 1000 AND total_orders >= 12"""),
        "filter_typed_dates": _with(["intraday"], """SELECT id, content, utm_source FROM intraday
            WHERE creation_date >= TIMESTAMP '2024-01-13 00:00:00' AND content <> 'view' AND income IS NULL"""),
        "products_with_categories": _with(_CATALOG, """SELECT p.id, p.name,
            CAST(to_json(list_sort(coalesce(list(c.name) FILTER (WHERE c.name IS NOT NULL), []))) AS VARCHAR) AS categories
            FROM products p LEFT JOIN links l ON l.product_id = p.id LEFT JOIN cats c ON c.id = l.category_id
            GROUP BY p.id, p.name"""),
        "product_category_text": _with(_CATALOG, f"""SELECT p.id, p.name,
            coalesce(string_agg(c.name, ', ' ORDER BY c.name), '{UNCATEGORISED}') AS category_text
            FROM products p LEFT JOIN links l ON l.product_id = p.id LEFT JOIN cats c ON c.id = l.category_id
            GROUP BY p.id, p.name"""),
        "sync_new_products": _with(["sales", "products"], """SELECT DISTINCT content AS name FROM sales
            WHERE content IS NOT NULL
            AND content NOT IN (SELECT name FROM products WHERE name NOT LIKE 'small%')"""),
        # --- reports
        "sales_by_day": _with(["sales"], f"""SELECT CAST(CAST(creation_date AS DATE) AS VARCHAR) AS date,
            {_num('sum(income)', 'total_sales')} FROM sales WHERE {_EVER} GROUP BY 1"""),
        "sales_by_day_category": _with(_LINKED, f"""SELECT CAST(CAST(creation_date AS DATE) AS VARCHAR) AS date,
            {_num('sum(income)', 'total_sales')} FROM linked WHERE {_YEAR} AND {_ONE} GROUP BY 1"""),
        "sales_by_day_intraday": _with(["intraday"], f"""SELECT CAST(CAST(creation_date AS DATE) AS VARCHAR) AS date,
            {_num('sum(income)', 'total_sales')} FROM intraday WHERE {_EVENTS} GROUP BY 1"""),
        "monthly_by_category": _with(_LINKED, _as_double(category_ever)),
        "monthly_by_category_filtered": _with(_LINKED, _as_double(_monthly("linked", chosen, "category"))),
        "monthly_by_product": _with(["sales"], _as_double(product_ever)),
        "monthly_by_product_filtered": _with(_LINKED, _as_double(_monthly("linked", chosen, "content AS product"))),
        "monthly_sales": _with(["sales"], _as_double(month_ever)),
        "monthly_sales_filtered": _with(_LINKED, _as_double(_monthly("linked", chosen))),
        "monthly_sales_shared": _with(_LINKED, f"""
            SELECT 'monthly' AS report, month, NULL AS product, NULL AS category,
                {_num('total_sales', 'total_sales')}, total_orders, paid_orders
            FROM ({_monthly('linked', chosen)}) a
            UNION ALL SELECT 'by_product', month, product, NULL, CAST(total_sales AS DOUBLE), total_orders, paid_orders
            FROM ({_monthly('linked', chosen, 'content AS product')}) b
            UNION ALL SELECT 'by_category', month, NULL, category, CAST(total_sales AS DOUBLE), total_orders, paid_orders
            FROM ({_monthly('linked', chosen, 'category')}) c"""),
        "category_revenue": _with(_LINKED, _as_double(
            f"{revenue} AND {_YEAR} AND category_id NOT IN ({_ids(Q.BAD_CATEGORIES)}) GROUP BY category",
            "total_revenue")),
        "product_summary": _with(["sales"], summary_ever),
        "product_summary_category": _with(_LINKED, f"""SELECT {_SUMMARY}, {_CHECK} AS average_check
            FROM linked WHERE {_YEAR} AND {_ONE} AND content IN ({_texts(Q.PICKED)}) GROUP BY content"""),
        "paid_products": _with(["sales"], _as_double(paid_ever, "total_income")),
        "paid_products_category": _with(_LINKED, f"""SELECT {_SUMMARY} FROM linked WHERE {_YEAR} AND {_ONE}
            GROUP BY content HAVING sum(CASE WHEN income > 0 THEN 1 ELSE 0 END) > 0"""),
        "product_daily": _with(["sales"], f"""SELECT CAST(CAST(creation_date AS DATE) AS VARCHAR) AS date,
            {_num('sum(income)', 'daily_sales')}, {_COUNTS} FROM sales WHERE {_PICKED_EVER} GROUP BY 1"""),
        "product_cumulative": _with(["sales"],
            _cumulative_double("sales", f"content IN ({_texts(Q.PICKED)}) AND {_YEAR}")),
        "product_cumulative_category": _with(_LINKED, _cumulative_double("linked", f"{_ONE} AND {_EVER}")),
        "max_creation_date": _with(["intraday"], f"""SELECT {_time('max(creation_date)', 'max_creation_date')}
            FROM intraday WHERE content = 'click' AND {_EVENTS}"""),
        "max_creation_date_category": _with(_LINKED,
            f"SELECT {_time('max(creation_date)', 'max_creation_date')} FROM linked WHERE {_ONE} AND {_YEAR}"),
        "partner_report": _with(["sales", "contacts"], _as_double(_partners(_PARTNER_EVER), "total_income")),
        "partner_by_registrations": _with(["sales", "contacts"],
            _as_double(_partners(_PARTNER_YEAR), "total_income")),
        "freshness": _with(["intraday", "contacts"], _freshness("intraday")),
        "freshness_of_tables": _with(["sales", "contacts"], _freshness("sales")),
        "order_count": _with(["sales"], "SELECT count(*) AS order_count FROM sales"),
        "category_share": _with(_LINKED, f"""SELECT category_name, {_num('total_revenue', 'total_revenue')},
            CAST(total_revenue AS DOUBLE) / CAST(sum(total_revenue) OVER () AS DOUBLE) AS share
            FROM ({revenue} AND {_YEAR} GROUP BY category) r"""),
        # --- what imports keep
        "upsert_by_index": _with(["before", "batch"], f"""SELECT id, content, status, {_time('creation_date', 'creation_date')},
            utm_source, {_num('income', 'income')} FROM before WHERE id NOT IN (SELECT id FROM batch)
            UNION ALL SELECT id, content, status, {_time('creation_date', 'creation_date')}, utm_source,
            {_num('income', 'income')} FROM batch"""),
        "orders_by_index": _with(_AFTER, f"""SELECT id, content, {_time('creation_date', 'creation_date')}
            FROM after WHERE split_part(id, '-', 2) = '2'"""),
        "orders_by_source_kept": _with(_AFTER, f"""SELECT id, {_time('creation_date', 'creation_date')}, content,
            {_num('income', 'income')} FROM after WHERE utm_source = '{Q.SOURCE}'"""),
        "sync_after_import": _with(_AFTER, """SELECT id, name FROM (
                SELECT row_number() OVER (ORDER BY substr(md5(name), 1, 2), name) AS id, name
                FROM (SELECT DISTINCT content AS name FROM before WHERE content IS NOT NULL) n) a
            UNION ALL SELECT (SELECT count(DISTINCT content) FROM before)
                + row_number() OVER (ORDER BY substr(md5(name), 1, 2), name), name
            FROM (SELECT DISTINCT content AS name FROM batch
                  WHERE content NOT IN (SELECT content FROM before WHERE content IS NOT NULL)) m"""),
        "sales_by_day_kept": _with(_AFTER, f"""SELECT CAST(CAST(creation_date AS DATE) AS VARCHAR) AS date,
            {_num('sum(income)', 'total_sales')} FROM after WHERE {_EVER} GROUP BY 1"""),
        "monthly_by_product_kept": _with(_AFTER, _as_double(_monthly("after", _EVER, "content AS product"))),
        "monthly_by_category_kept": _with(_AFTER_LINKED, _as_double(_monthly("after_linked", chosen, "category"))),
        "category_revenue_kept": _with(_AFTER_LINKED, _as_double(
            f"{revenue.replace('linked', 'after_linked')} AND {_YEAR} AND category_id NOT IN ({_ids(Q.BAD_CATEGORIES)}) GROUP BY category",
            "total_revenue")),
        "product_summary_kept": _with(_AFTER, f"""SELECT {_SUMMARY}, {_CHECK} AS average_check FROM after
            WHERE {_YEAR} GROUP BY content"""),
        "product_daily_kept": _with(_AFTER, f"""SELECT CAST(CAST(creation_date AS DATE) AS VARCHAR) AS date,
            {_num('sum(income)', 'daily_sales')}, {_COUNTS} FROM after WHERE {_PICKED_EVER} GROUP BY 1"""),
        "max_creation_date_kept": _with(_AFTER_LINKED,
            f"SELECT {_time('max(creation_date)', 'max_creation_date')} FROM after_linked WHERE {_ONE} AND {_YEAR}"),
        "partner_report_kept": _with([*_AFTER, "contacts"],
            _as_double(_partners(_PARTNER_YEAR).replace("FROM sales s", "FROM after s"), "total_income")),
        "order_count_kept": _with(_AFTER, "SELECT count(*) AS order_count FROM after"),
        # --- totals and summary lines
        "product_summary_totals": _with(["sales"], f"""
            SELECT content AS product, {_COUNTS}, {_num(_r2('sum(income)'), 'total_income')},
                CAST(coalesce({check2}, 0) AS DOUBLE) AS average_check, false AS is_total
            FROM sales WHERE {_EVER} GROUP BY content
            UNION ALL SELECT '{TOTAL_LABEL}', count(*), count(CASE WHEN income > 0 THEN 1 END),
                CAST({_r2('sum(income)')} AS DOUBLE),
                CAST({_r2("CAST(CAST(sum(income) AS DOUBLE) / count(CASE WHEN income > 0 THEN 1 END) AS DECIMAL(30,10))")} AS DOUBLE),
                true FROM sales WHERE {_EVER}"""),
        "paid_products_totals": _with(["sales"], f"""
            SELECT product, paid_orders, {_num(_r2('total_income'), 'total_income')}, false AS is_total
            FROM ({paid_ever}) a
            UNION ALL SELECT '{TOTAL_LABEL}', CAST(sum(paid_orders) AS BIGINT),
                CAST(sum({_r2('total_income')}) AS DOUBLE), true FROM ({paid_ever}) b"""),
        "category_revenue_totals": _with(_LINKED, f"""
            SELECT category_name, {_num(_r2('total_revenue'), 'total_revenue')}, false AS is_total
            FROM ({revenue} AND {_YEAR} GROUP BY category) a
            UNION ALL SELECT '{TOTAL_LABEL}', CAST({_r2('sum(total_revenue)')} AS DOUBLE), true
            FROM ({revenue} AND {_YEAR} GROUP BY category) b"""),
        "monthly_totals": _with(["sales"], _monthly_total(month_ever, None)),
        "monthly_by_product_totals": _with(["sales"], _monthly_total(product_year, "product")),
        "monthly_by_category_totals": _with(_LINKED, _monthly_total(category_ever, "category")),
        "monthly_kpis": _with(["sales"], _kpis(month_ever)),
        "monthly_by_product_kpis": _with(["sales"], _kpis(product_ever)),
        "monthly_by_category_kpis": _with(_LINKED, _kpis(category_ever)),
        # --- presentation
        "product_summary_rounded": _with(["sales"], f"""SELECT content AS product, {_COUNTS},
            {_num(_r2('sum(income)'), 'total_income')}, CAST(coalesce({check2}, 0) AS DOUBLE) AS average_check
            FROM sales WHERE {_EVER} GROUP BY content"""),
        "product_percent_of_base": _with(["sales"], f"""SELECT *,
            {_num(_percent('cumulative_sales'), 'cumulative_percent')},
            {_num(_percent('daily_sales'), 'daily_percent')},
            concat(CAST(CAST({_percent('cumulative_sales')} AS DECIMAL(30,2)) AS VARCHAR), '%') AS cumulative_percentage,
            coalesce(CAST(CAST({_percent('daily_sales')} AS DECIMAL(30,2)) AS VARCHAR) || '%', 'N/A') AS daily_percentage
            FROM ({_ROUNDED_DAYS}) d"""),
        "product_percent_na": _with(["sales"], f"""SELECT *, CAST(NULL AS DOUBLE) AS cumulative_percent,
            CAST(NULL AS DOUBLE) AS daily_percent, 'N/A' AS cumulative_percentage,
            'N/A' AS daily_percentage FROM ({_ROUNDED_DAYS}) d"""),
        "category_options": _with(["cats"], "SELECT name AS label, id AS value FROM cats"),
        "monthly_product_options": _with(_LINKED, f"""SELECT DISTINCT content AS label, content AS value
            FROM linked WHERE category_id IN ({_ids(Q.SOME_CATEGORIES + Q.BAD_CATEGORIES)})"""),
        "monthly_formatted": _with(["sales"], f"""SELECT month,
            replace(format('{{:,.2f}}', CAST({_r2('total_sales')} AS DOUBLE)), ',', ' ') AS total_sales, paid_orders
            FROM ({month_ever} UNION ALL SELECT '{TOTAL_LABEL}', sum(total_sales),
                CAST(sum(total_orders) AS BIGINT), CAST(sum(paid_orders) AS BIGINT) FROM ({month_ever}) b) a"""),
        "partner_display": _with(["sales", "contacts"], f"""SELECT partner AS "Партнер",
            utm_source AS "UTM Source", order_count AS "Количество регистраций"
            FROM ({_partners(f"{_PARTNER_YEAR} AND {_NAMED_ONLY}")}) p"""),
        "fund_allocation": _with(_LINKED, _fund(True)),
        "fund_allocation_hidden": _with(_LINKED, _fund(False)),
        "fund_texts": _with(_LINKED, f"""SELECT {_money('total_income')}, visible, title,
            {_money('fund_income')}, {_money('fund_after_tax')}, {_money('employee_income')}
            FROM ({_fund(True)}) f"""),
        "fund_of_nothing": _with(_LINKED, f"""SELECT 'none' AS orders, CAST(0 AS DOUBLE) AS total_income, false AS visible
            UNION ALL SELECT 'some', {_num(_r2('sum(income)'), 'total_income')}, false FROM linked WHERE {_ONE} AND {_YEAR}"""),
        "monthly_kpi_texts": _with(["sales"], f"""SELECT {_money('total_sales')}, paid_orders,
            {_money('average_check')}, {_money('average_monthly_income')} FROM ({_kpis(month_ever)}) k"""),
        "filter_products_listed": _with(_LINKED[:4], f"""SELECT id, content, {_num('income', 'income')} FROM sales
            WHERE content IN (SELECT name FROM products WHERE id IN (SELECT product_id FROM links))"""),
        # --- catalog maintenance
        "sync_products": _with(["sales", "products"], """SELECT id, name FROM products WHERE name NOT LIKE 'small%'
            UNION ALL SELECT (SELECT max(id) FROM products WHERE name NOT LIKE 'small%')
                + row_number() OVER (ORDER BY substr(md5(name), 1, 2), name), name
            FROM (SELECT DISTINCT content AS name FROM sales WHERE content LIKE 'small%') n"""),
        "create_categories": _with(["cats"], f"""SELECT id, name FROM cats
            UNION ALL SELECT (SELECT max(id) FROM cats)
                + row_number() OVER (ORDER BY substr(md5(name), 1, 2), name), name
            FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand IS NOT NULL
                  AND p_brand NOT IN (SELECT name FROM cats)) n"""),
        "category_conflicts": _with(["cats"], "").rstrip() + f""", {_ASKED}
            SELECT name, reason, requests FROM (SELECT a.name,
                CASE WHEN a.name IS NULL THEN 'missing'
                     WHEN a.name IN (SELECT name FROM cats) THEN 'exists'
                     WHEN count(*) > 1 THEN 'repeated' END AS reason, count(*) AS requests
                FROM asked a GROUP BY a.name) j WHERE reason IS NOT NULL""",
        "delete_categories": _with(["cats"], "SELECT id, name FROM cats WHERE id % 2 = 0"),
        "bridge_after_delete": _with(_CATALOG,
            "SELECT product_id, category_id FROM links WHERE category_id % 2 = 0"),
        "unknown_categories": _with(["cats"], """SELECT id + 100 AS id FROM cats
            WHERE id % 2 = 1 AND id + 100 NOT IN (SELECT id FROM cats)"""),
        "assign_categories": _with(_CATALOG, """SELECT product_id, category_id FROM links
            WHERE NOT (product_id % 2 = 0 AND product_id % 10 <> 0)
            UNION ALL SELECT DISTINCT p.id, c.id FROM products p JOIN cats c
                ON c.id IN (1, p.id % 6 + 1, p.id + 1000)
            WHERE p.id % 2 = 0 AND p.id % 10 <> 0 AND p.id % 3 <> 0"""),
    }
