"""The sales tables, derived from a folder of TPC-H-like tables.

The SQL below runs unchanged in Spark and in DuckDB ({STR} is the text type, and
{name} a source table), so that checks start from the same rows.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import append_ids
from tallywright.operators.catalog import Catalog
from tallywright.operators.filters import MONTH_SLOT, month_slot
from tallywright.session import stored

SALES = """
SELECT concat_ws('-', CAST(l_orderkey AS {STR}), CAST(l_linenumber AS {STR}),
                 CAST(l_partkey AS {STR}), CAST(l_suppkey AS {STR})) AS id,
       concat('N-', CAST(l_orderkey AS {STR})) AS number,
       CASE WHEN p_size = 50 THEN NULL ELSE p_name END AS content,
       o_orderstatus AS status,
       o_orderdate AS creation_date,
       CAST(o_custkey AS {STR}) AS utm_source,
       CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DECIMAL(18,4))
            WHEN l_returnflag = 'A' AND o_orderstatus = 'P' THEN NULL
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2))
                      * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) END AS income
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

SALES_INTRADAY = """
SELECT CAST(event_id AS {STR}) AS id, event_type AS content, ts AS creation_date,
       CAST(user_id AS {STR}) AS utm_source,
       CASE WHEN event_type = 'error' THEN NULL
            WHEN event_type = 'view' THEN CAST(0 AS DECIMAL(18,4))
            ELSE CAST(value AS DECIMAL(18,4)) END AS income
FROM {events}
"""

# A fifth of the sources are unknown and some names are null; a contact exists
# since its first order.
CONTACTS = """
SELECT CAST(c_custkey AS {STR}) AS id,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS full_name,
       first_order AS creation_date
FROM {customer} LEFT JOIN (
    SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey
) f ON c_custkey = o_custkey
WHERE c_custkey % 5 <> 0
"""

# 'blue...' products stay without a category.
LINKS = """
SELECT p.id AS product_id, c.id AS category_id
FROM (SELECT DISTINCT p_name, p_type FROM {part} WHERE p_name NOT LIKE 'blue%') x
JOIN {products} p ON p_name = p.name JOIN {categories} c ON p_type = c.name
"""

# Stored are keys not divisible by 3; a batch has the others and the even ones, so
# that every row of the source is on one side or on both.
CURRENT_ORDERS = """
SELECT CAST(o_orderkey AS {STR}) AS id, o_orderstatus AS status, o_totalprice AS total_amount,
       o_orderdate AS creation_date, 'keep' AS recipient_last_name
FROM {orders} WHERE o_orderkey % 3 <> 0
"""

INCOMING_ORDERS = """
SELECT CAST(o_orderkey AS {STR}) AS id, 'X' AS status,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice * 2 END AS total_amount,
       o_orderdate AS creation_date, o_orderkey AS __row
FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
"""

# The orders of INCOMING_ORDERS, those of keys divisible by 14 once more
# with another status and a later position.
REPEATED_ORDERS = """
SELECT id, status, total_amount, creation_date, __row FROM (""" + INCOMING_ORDERS + """) a
UNION ALL
SELECT CAST(o_orderkey AS {STR}) AS id, 'Y' AS status, o_totalprice AS total_amount,
       o_orderdate AS creation_date, o_orderkey + 1000000000000 AS __row
FROM {orders} WHERE o_orderkey % 14 = 0
"""

# Sales before and in a later upload, by the order's number: a part of them stays, others are
# updated (doubled or without income, some 40 days later and some under a new product
# text), and others are new. Lines that share an id are one.
_LINES = """
SELECT id, number, content, status, creation_date, utm_source, CAST(sum(income) AS DECIMAL(18,4)) AS income
FROM (""" + SALES + """) t GROUP BY id, number, content, status, creation_date, utm_source
"""

# The same for Spark, from lines joined with their parts. The order's key is grouped by too: the
# number tells it, so the groups are those, and the join with the orders has put them in place.
# What a line's amount needs of its order is only the status, so lines carry the amount and not what it is made of.
_AMOUNT = SALES[SALES.index("CAST(CAST(l_extendedprice"):SALES.index(" END AS income")]
_INCOME = SALES[SALES.index("CASE WHEN l_returnflag"):SALES.index(" AS income")]
_LINES_BY_ORDER = _LINES.replace(SALES, SALES.replace("SELECT", "SELECT l_orderkey,", 1)).replace("BY id", "BY l_orderkey, id") \
    .replace("{lineitem}", "{lines}").replace("JOIN {part} ON l_partkey = p_partkey", "") \
    .replace(_INCOME, "CASE WHEN returned AND o_orderstatus = 'P' THEN NULL ELSE amount END")
_LINES_OF_PARTS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'A' AS returned,
       CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DECIMAL(18,4)) ELSE {_AMOUNT} END AS amount,
       CASE WHEN p_size = 50 THEN NULL ELSE p_name END AS p_name, CAST(NULL AS INT) AS p_size
""" + """FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

SALES_BEFORE = "SELECT * FROM (" + _LINES + """) s WHERE CAST(substr(number, 3) AS BIGINT) % 3 <> 0
"""

SALES_BATCH = """
SELECT id, number,
       CASE WHEN k % 7 = 0 THEN 'new ' || content ELSE content END AS content,
       'X' AS status,
       CASE WHEN k % 4 = 0 THEN creation_date + INTERVAL '40' DAY ELSE creation_date END AS creation_date,
       utm_source,
       CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(income * 2 AS DECIMAL(18,4)) END AS income
FROM (SELECT *, CAST(substr(number, 3) AS BIGINT) AS k FROM (""" + _LINES + """) s) b
WHERE k % 2 = 0 OR k % 3 = 0
"""

CURRENT_CONTACTS = """
SELECT CAST(c_custkey AS {STR}) AS id, c_name AS full_name, c_mktsegment AS groups,
       c_acctbal AS total_paid
FROM {customer} WHERE c_custkey % 3 <> 0
"""

INCOMING_CONTACTS = """
SELECT CAST(c_custkey AS {STR}) AS id,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('New ', c_name) END AS full_name,
       CASE WHEN c_acctbal > 0 THEN c_acctbal END AS total_paid, c_custkey AS __row
FROM {customer} WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
"""

# An order upload with everything that goes wrong in spreadsheets: blank and
# zero keys, '.0' ids, missing markers, four date layouts, texts for numbers.
ORDER_UPLOAD_TEXT = """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'NULL'
            WHEN o_orderkey % 5 = 0 THEN concat(k, '.0') ELSE k END AS id,
       concat('N-', k) AS number,
       CASE WHEN o_custkey % 4 = 0 THEN 'N/A' ELSE concat('Name ', c) END AS contact_name,
       concat('Surname ', c) AS contact_surname,
       concat('c', c, '@mail.test') AS contact_email,
       o_orderpriority AS responsible_person,
       concat('Product ', CAST(o_orderkey % 50 AS {STR})) AS content,
       o_orderstatus AS status,
       CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 13 = 0 THEN ''
            ELSE a END AS total_amount,
       CASE WHEN o_orderkey % 17 = 0 THEN 'NaN' ELSE a END AS paid_amount,
       CASE WHEN o_orderkey % 10 = 9 THEN 'soon'
            WHEN o_orderkey % 4 = 0 THEN substr(d, 1, 10)
            WHEN o_orderkey % 4 = 1 THEN concat(substr(d, 1, 10), ' 10:20:30')
            WHEN o_orderkey % 4 = 2
                THEN concat(substr(d, 9, 2), '.', substr(d, 6, 2), '.', substr(d, 1, 4))
            ELSE concat(substr(d, 9, 2), '.', substr(d, 6, 2), '.', substr(d, 1, 4), ' 07:05')
            END AS creation_date,
       CASE WHEN o_orderstatus = 'O' THEN '' ELSE d END AS payment_date,
       'RUB' AS currency, '' AS tags, '0' AS discount_amount,
       CASE WHEN o_orderstatus = 'F' THEN a ELSE '0' END AS income,
       'n/a' AS commission, concat(c, '.0') AS partner_id, 'None' AS partner_email,
       '12.5' AS partner_commission, '+7000' AS contact_phone, concat(c, '.0') AS contact_id,
       'promo' AS utm_campaign, 'banner' AS utm_content, 'cpc' AS utm_medium,
       c AS utm_source, 'v2.0' AS utm_term, 'nan' AS gc_order_date
FROM (SELECT *, CAST(o_orderkey AS {STR}) AS k, CAST(o_custkey AS {STR}) AS c,
             CAST(o_orderdate AS {STR}) AS d,
             CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS {STR}) AS a
      FROM {orders}) x
"""

CONTACT_UPLOAD_TEXT = """
SELECT CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN concat(k, '.0')
            ELSE k END AS id,
       CASE WHEN c_custkey % 7 = 0 THEN '#N/A' ELSE c_name END AS full_name,
       'First' AS first_name, '' AS middle_name, 'Last' AS last_name,
       concat('c', k, '@mail.test') AS email,
       concat('c', k, '@mail.test, other@mail.test') AS emails,
       '+7000' AS phone, '+7000, +7001' AS phones,
       'RU' AS country, n_name AS city, 'NA' AS region, 'a, b' AS tags,
       c_mktsegment AS groups,
       CASE WHEN c_custkey % 3 = 0 THEN '2020-02-30' ELSE '2020-02-29 12:00:00' END AS creation_date,
       '01.02.1990' AS birthday, '' AS last_online, '2021-03-04' AS last_activity,
       CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS {STR}) AS total_paid,
       CASE WHEN c_custkey % 2 = 0 THEN '10' ELSE 'ten' END AS gamification_score,
       'null' AS bonus_balance, '7.0' AS partner_id, 'google' AS first_utm_source,
       k AS last_utm_source, concat(k, '.0') AS tg_id
FROM (SELECT *, CAST(c_custkey AS {STR}) AS k FROM {customer}) x
JOIN {nation} ON c_nationkey = n_nationkey
"""

RAW_TABLES = ("customer", "events", "lineitem", "nation", "orders", "part")


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """One of the SQL texts above as a DataFrame over the tables in ``sf_dir``."""
    used = {t: raw(spark, sf_dir, t) for t in RAW_TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql.replace("{STR}", "string"), **(used | more))


#: Bytes of the lines' files for each task that joins and groups them.
LINES_PER_TASK = 16 << 20


def sales_lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``SALES_BEFORE`` or ``SALES_BATCH`` with one shuffle by the order's key, while lines are narrow.

    The merge join leaves the lines of an order side by side, so that they also
    compress well in the next shuffle.
    """
    size = sum(length for _, length, _ in files_of(spark, f"{sf_dir}/lineitem.parquet"))
    lines = frame(spark, sf_dir, _LINES_OF_PARTS).repartition(max(8, size // LINES_PER_TASK), "l_orderkey")
    orders = raw(spark, sf_dir, "orders").hint("merge")
    return frame(spark, sf_dir, sql.replace(_LINES, _LINES_BY_ORDER), lines=lines, orders=orders)


class Star:
    """The sales tables of one source folder.

    Orders and contacts are views over the given tables: nothing is copied before
    a report, and its period, product and column choices reach the files. Products,
    categories and links get their ids here, so they are stored, once for each
    state of the table they come from; they grow with the names, not the orders.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stored: dict[str, tuple[tuple, str, DataFrame]] = {}
        self._lock = threading.RLock()

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, made anew if the source has changed or it is gone."""
        with self._lock:
            source = files_of(self.spark, f"{self.sf_dir}/part.parquet")
            known = self._stored.get(name)
            if known is None or known[0] != source or not files_of(self.spark, known[1]):
                table = stored(make(), f"star-{name}")
                self._stored[name] = (source, os.path.dirname(table.inputFiles()[0]), table)
            return self._stored[name][2]

    @property
    def orders(self) -> DataFrame:
        sales = frame(self.spark, self.sf_dir, SALES)
        return sales.withColumn("income", F.col("income").cast("double"))

    def stored_orders(self) -> DataFrame:
        """The orders written to the shared folder by month: an explicit step, for
        many reports over one state of large tables."""
        return stored(self.orders.withColumn(MONTH_SLOT, month_slot()), "star-orders", MONTH_SLOT)

    @property
    def contacts(self) -> DataFrame:
        return frame(self.spark, self.sf_dir, CONTACTS)

    @property
    def products(self) -> DataFrame:
        return self._table("products", lambda: named(self._part(), "p_name"))

    @property
    def categories(self) -> DataFrame:
        return self._table("product_categories", lambda: named(self._part(), "p_type"))

    @property
    def links(self) -> DataFrame:
        def make() -> DataFrame:
            return frame(
                self.spark, self.sf_dir, LINKS, products=self.products, categories=self.categories
            )

        return self._table("product_category_association", make)

    @property
    def catalog(self) -> Catalog:
        return Catalog(self.products, self.categories, self.links)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "orders": self.orders,
            "contacts": self.contacts,
            "products": self.products,
            "product_categories": self.categories,
            "product_category_association": self.links,
        }

    def _part(self) -> DataFrame:
        return raw(self.spark, self.sf_dir, "part")


def named(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with ids, as a dimension table."""
    return append_ids(names.select(F.col(column).alias("name")).distinct())


def files_of(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Paths, sizes and times of the files below a path; empty if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return ()
    found, files = [], system.listFiles(folder, True)
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(found))


_stars: dict[tuple[str, str], Star] = {}
_lock = threading.Lock()


def star(spark: SparkSession, sf_dir: str) -> Star:
    """The sales tables for ``sf_dir``, shared by all queries of the application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _lock:
        if key not in _stars:
            _stars[key] = Star(spark, sf_dir)
        return _stars[key]
