"""Every operator as a query over a folder of source tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import heavy_keys, time_text
from tallywright.operators import catalog as C
from tallywright.operators import filters as L
from tallywright.operators import partner as P
from tallywright.operators import present as V
from tallywright.operators import reports as R
from tallywright.operators import totals as X
from tallywright.operators import upsert as U
from tallywright.operators.filters import SalesFilter
from tallywright.operators.typed_filters import filtered
from tallywright.plans import kept as K
from tallywright.plans import star as S
from tallywright.plans.imports import merge_rows
from tallywright.schemas import CONTACT_UPLOAD, ORDER_UPLOAD, UploadSpec
from tallywright.session import shared_folder, stored
from tallywright.sources import exports as E
from tallywright.sources import uploads as I

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries; the oracle uses the same ones.
START, END = "1997-01-01", "1997-12-31"
ALL_START, ALL_END = "1995-01-01", "2001-12-31"
EVENT_START, EVENT_END = "2024-01-05", "2024-01-20"
PICKED = ("red plate", "small widget", "hot ring")
DROPPED = ("red plate", "large rod")
ONE_CATEGORY = 2
SOME_CATEGORIES = (1, 3)
BAD_CATEGORIES = (2, 5)
SOURCE = "11"
PRODUCT_ID = 7
FUND_MARKER, FUND_TITLE = "PROMO", "Фонд"
PERIOD = {"start": START, "end": END}
EVER = {"start": ALL_START, "end": ALL_END}

_QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    """Register a query under its function's name; amounts come out as doubles, days as text."""
    _QUERIES[make.__name__] = lambda spark, sf_dir: V.plain(make(spark, sf_dir))
    return make


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _star_query(make: Callable[[S.Star], DataFrame]) -> Callable[[S.Star], DataFrame]:
    _QUERIES[make.__name__] = lambda spark, sf_dir: V.plain(make(S.star(spark, sf_dir)))
    return make


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame(spark, sf_dir, S.SALES_INTRADAY)


# --- uploads ---------------------------------------------------------------


def _upload(spark: SparkSession, sf_dir: str, sql: str, spec: UploadSpec) -> DataFrame:
    """A text table under upload headers."""
    fields = {field: header for header, field in spec.headers.items()}
    return S.frame(spark, sf_dir, sql).withColumnsRenamed(fields)


def _order_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upload(spark, sf_dir, S.ORDER_UPLOAD_TEXT, ORDER_UPLOAD)


def _contact_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upload(spark, sf_dir, S.CONTACT_UPLOAD_TEXT, CONTACT_UPLOAD)


def _order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rename_columns(_order_upload(spark, sf_dir), ORDER_UPLOAD)


def _dates_as_text(rows: DataFrame, columns) -> DataFrame:
    return rows.withColumns({c: time_text(F.col(c)) for c in columns})


def _through_csv(upload: DataFrame) -> DataFrame:
    """The upload written as CSV files and read the way an import reads them."""
    spark = upload.sparkSession
    path = f"{shared_folder(spark)}/tallywright-csv-{uuid.uuid4().hex}"
    E.write_csv(upload, path)
    return I.read_upload(spark, path)


@query
def ingest_orders(spark, sf_dir):
    rows = I.clean_upload(_through_csv(_order_upload(spark, sf_dir)), ORDER_UPLOAD)
    return _dates_as_text(rows.drop(I.ROW_ORDER), ORDER_UPLOAD.dates)


@query
def ingest_contacts(spark, sf_dir):
    rows = I.clean_upload(_through_csv(_contact_upload(spark, sf_dir)), CONTACT_UPLOAD)
    return _dates_as_text(rows.drop(I.ROW_ORDER), CONTACT_UPLOAD.dates)


@query
def header_check(spark, sf_dir):
    wrong = _order_upload(spark, sf_dir).drop("UTM Term", "Валюта").withColumn("Extra", F.lit(1))
    return I.header_report(wrong, ORDER_UPLOAD)


@query
def rename_columns(spark, sf_dir):
    return I.rename_columns(_contact_upload(spark, sf_dir), CONTACT_UPLOAD)


@query
def parse_dates(spark, sf_dir):
    rows = I.parse_dates(_order_fields(spark, sf_dir), ORDER_UPLOAD.dates)
    return _dates_as_text(rows, ORDER_UPLOAD.dates).select("number", *ORDER_UPLOAD.dates)


@query
def null_normalize(spark, sf_dir):
    return I.null_normalize(_order_fields(spark, sf_dir)).select(
        "number", "id", "contact_name", "tags", "paid_amount", "commission", "partner_email",
        "gc_order_date",
    )


@query
def cast_money(spark, sf_dir):
    rows = I.null_normalize(_order_fields(spark, sf_dir))
    return I.cast_money(rows, ORDER_UPLOAD.money).select("number", *ORDER_UPLOAD.money)


@query
def drop_empty_keys(spark, sf_dir):
    rows = I.normalize_ids(I.null_normalize(_order_fields(spark, sf_dir)))
    return I.drop_empty_keys(rows).select("id", "contact_id", "utm_source", "utm_term")


@query
def project_to_model(spark, sf_dir):
    rows = _order_fields(spark, sf_dir).withColumn("not_in_model", F.lit(1))
    return I.project_to_model(rows, ORDER_UPLOAD)


# --- keyed writes ----------------------------------------------------------


def _marked(current: DataFrame, batch: DataFrame) -> DataFrame:
    """A batch as the import job sees it, before anything is stored."""
    last = U.last_rows(batch)
    return U.mark_stored(last, U.stored_keys(current, last))


def _marked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(S.frame(spark, sf_dir, S.CURRENT_ORDERS), S.frame(spark, sf_dir, S.REPEATED_ORDERS))


def _upserted(current: DataFrame, batch: DataFrame, name: str) -> DataFrame:
    """The import job's chain: reduce and store the batch, mark it, merge it."""
    last = stored(U.last_rows(batch), f"batch-{name}")
    marked = stored(U.mark_stored(last, U.stored_keys(current, last)), f"marked-{name}")
    return U.merged(current, marked)


@query
def upsert_orders(spark, sf_dir):
    current = S.frame(spark, sf_dir, S.CURRENT_ORDERS)
    rows = _upserted(current, S.frame(spark, sf_dir, S.INCOMING_ORDERS), "orders")
    return _dates_as_text(rows, ["creation_date"])


@query
def upsert_contacts(spark, sf_dir):
    current = S.frame(spark, sf_dir, S.CURRENT_CONTACTS)
    return _upserted(current, S.frame(spark, sf_dir, S.INCOMING_CONTACTS), "contacts")


@query
def upsert_counts(spark, sf_dir):
    return U.upsert_counts(_marked_orders(spark, sf_dir))


@query
def upsert_dedup(spark, sf_dir):
    last = U.last_rows(S.frame(spark, sf_dir, S.REPEATED_ORDERS))
    return _dates_as_text(last.withColumnRenamed(U.COPIES, "copies"), ["creation_date"])


@query
def upsert_conflicts(spark, sf_dir):
    return U.upsert_conflicts(_marked_orders(spark, sf_dir))


@_star_query
def export_rows(star):
    return E.export_image(star.orders)


@_star_query
def export_roundtrip(star):
    """All five tables exported and read back, with blanks around texts, quotes, line
    breaks and large amounts: ``name``, and the cells of a row as one text."""
    tables = star.tables()
    odd = F.concat(F.lit("  "), "content", F.lit(' "q", \n end '))
    large = F.floor("income") * F.lit(1e6) + 0.5
    tables["orders"] = tables["orders"].withColumns({"content": odd, "income": large})
    tables["contacts"] = tables["contacts"].withColumn("full_name", F.concat(F.lit("\t"), "full_name", F.lit(" ")))
    folder = f"{shared_folder(star.spark)}/tallywright-export-{uuid.uuid4().hex}"
    read = None
    for name, path in E.export_tables(tables, folder).items():
        rows = I.read_upload(star.spark, path, multiline=True).drop(I.ROW_ORDER)
        cells = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in rows.columns])
        rows = rows.select(F.lit(name).alias("name"), cells.alias("cells"))
        read = rows if read is None else read.unionByName(rows)
    return read


@_star_query
def table_counts(star):
    return E.table_counts(star.tables())


@_star_query
def partner_export(star):
    return E.partner_export(P.partner_report(star.orders, star.contacts, START, END))


# --- filters ---------------------------------------------------------------

_ROW = ("id", "content", "income")


@query
def filter_period(spark, sf_dir):
    rows = L.filter_period(_events(spark, sf_dir), EVENT_START, EVENT_END)
    return rows.select(*_ROW, "utm_source")


@_star_query
def category_revenue_all_time(star):
    return R.category_revenue(star.orders, star.catalog)


@_star_query
def filter_products_in(star):
    return L.filter_products(star.orders, include=PICKED).select(*_ROW)


@_star_query
def filter_products_not_in(star):
    return L.filter_products(star.orders, exclude=DROPPED).select(*_ROW)


def _by_product(star: S.Star, **choices) -> DataFrame:
    return R.totals(
        star.orders, SalesFilter(**EVER, **choices), star.catalog, {"product": F.col("content")},
        ["total_orders", "paid_orders", "income"],
    )


@_star_query
def filter_category_eq(star):
    return _by_product(star, categories=ONE_CATEGORY)


@_star_query
def filter_categories_in(star):
    return _by_product(star, categories=SOME_CATEGORIES)


@_star_query
def filter_categories_not_in(star):
    return _by_product(star, exclude_categories=BAD_CATEGORIES)


@query
def filter_paid(spark, sf_dir):
    return L.filter_paid(_events(spark, sf_dir)).select(*_ROW)


@_star_query
def unique_products(star):
    return C.unique_products(star.orders)


@_star_query
def unique_products_in_categories(star):
    return C.unique_products(star.orders, star.catalog, list(SOME_CATEGORIES))


@_star_query
def partner_report_named(star):
    return P.partner_report(star.orders, star.contacts, START, END, exclude_common=True)


def _lists_as_json(products: DataFrame) -> DataFrame:
    return products.withColumn("categories", F.to_json("categories"))


@_star_query
def product_detail(star):
    return _lists_as_json(C.product_detail(star.catalog, PRODUCT_ID))


@_star_query
def contact_detail(star):
    return C.by_id(star.contacts, SOURCE).select("id", "full_name")


@_star_query
def orders_by_source(star):
    rows = L.orders_by_source(star.orders, SOURCE)
    return _dates_as_text(rows, ["creation_date"])


@_star_query
def product_search(star):
    return C.search_products(star.products, "RED")


@_star_query
def products_uncategorized(star):
    return C.uncategorised_products(star.catalog)


@_star_query
def products_uncategorized_search(star):
    return C.uncategorised_products(star.catalog, "Ring")


@_star_query
def refine_result(star):
    summary = R.product_summary(star.orders, star.catalog, (), **EVER)
    return V.refine(
        summary, where="paid_orders > 10 AND product LIKE '%widget'",
        order_by=[F.desc("total_income")],
    )


# --- joins -----------------------------------------------------------------


@_star_query
def join_category_bridge(star):
    flt = SalesFilter(**PERIOD, categories=SOME_CATEGORIES)
    return R.linked_orders(star.orders, flt, star.catalog).select(
        "id", "content", "income", "category_id"
    )


@_star_query
def join_category_bridge_spread(star):
    """All orders with their links, products with many orders dealt over many tasks."""
    flt = SalesFilter(**EVER)
    heavy = heavy_keys(star.orders, "content", 0.005)
    return R.linked_orders(star.orders, flt, star.catalog, heavy).select("id", "content", "income", "category_id")


@_star_query
def filter_typed(star):
    """What is typed above the columns of the product summary, sorted by two of them."""
    summary = R.product_summary(star.orders, star.catalog, (), **EVER)
    cells = {"product": "icontains WIDGET", "paid_orders": "> 10", "total_income": ">= 1 000", "average_check": "", "total_orders": "ge 12"}
    return filtered(summary, cells, ["-paid_orders", "product"])


@query
def filter_typed_dates(spark, sf_dir):
    cells = {"creation_date": "> 2024-01-12", "content": "!= view", "income": "is nil"}
    return filtered(_events(spark, sf_dir), cells).select("id", "content", "utm_source")


@_star_query
def products_with_categories(star):
    return _lists_as_json(C.products_with_categories(star.catalog))


@_star_query
def product_category_text(star):
    return C.category_text(C.products_with_categories(star.catalog))


@_star_query
def sync_new_products(star):
    return C.new_product_names(star.orders, _known_products(star))


# --- reports ---------------------------------------------------------------


@_star_query
def sales_by_day(star):
    return R.sales_by_day(star.orders, star.catalog, **EVER)


@_star_query
def sales_by_day_category(star):
    return R.sales_by_day(star.orders, star.catalog, START, END, ONE_CATEGORY)


@query
def sales_by_day_intraday(spark, sf_dir):
    return R.sales_by_day(_events(spark, sf_dir), None, EVENT_START, EVENT_END)


@_star_query
def monthly_by_category(star):
    return R.monthly_by_category(star.orders, star.catalog, **EVER)


_CHOICES = {
    "categories": SOME_CATEGORIES + BAD_CATEGORIES, "exclude_categories": BAD_CATEGORIES,
    "exclude_products": DROPPED,
}


@_star_query
def monthly_by_category_filtered(star):
    return R.monthly_by_category(star.orders, star.catalog, **PERIOD, **_CHOICES)


@_star_query
def monthly_by_product(star):
    return R.monthly_by_product(star.orders, star.catalog, **EVER)


@_star_query
def monthly_by_product_filtered(star):
    return R.monthly_by_product(star.orders, star.catalog, **PERIOD, **_CHOICES)


@_star_query
def monthly_sales(star):
    return R.monthly_sales(star.orders, star.catalog, **EVER)


@_star_query
def monthly_sales_filtered(star):
    return R.monthly_sales(star.orders, star.catalog, **PERIOD, **_CHOICES)


@_star_query
def monthly_sales_shared(star):
    flt = R.monthly_filter(**PERIOD, **_CHOICES)
    pieces = stored(R.monthly_pieces(star.orders, flt), "monthly-pieces")
    parts = R.monthly_from_pieces(pieces, flt, star.catalog, ordered=False)
    empty = F.lit(None).cast("string")
    shape = ("report", "month", "product", "category", "total_sales", "total_orders", "paid_orders")
    both = [
        parts["monthly"].withColumns({"product": empty, "category": empty}),
        parts["by_product"].withColumn("category", empty),
        parts["by_category"].withColumn("product", empty),
    ]
    named = [f.withColumn("report", F.lit(n)).select(*shape) for n, f in zip(parts, both, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@_star_query
def category_revenue(star):
    return R.category_revenue(star.orders, star.catalog, START, END, BAD_CATEGORIES)


@_star_query
def product_summary(star):
    return R.product_summary(star.orders, star.catalog, (), **EVER)


@_star_query
def product_summary_category(star):
    return R.product_summary(star.orders, star.catalog, PICKED, START, END, ONE_CATEGORY)


@_star_query
def paid_products(star):
    return R.paid_products(star.orders, star.catalog, **EVER)


@_star_query
def paid_products_category(star):
    return R.paid_products(star.orders, star.catalog, START, END, ONE_CATEGORY)


@_star_query
def product_daily(star):
    return R.product_daily(star.orders, star.catalog, PICKED, **EVER)


@_star_query
def product_cumulative(star):
    return R.product_cumulative(star.orders, star.catalog, PICKED, START, END)


@_star_query
def product_cumulative_category(star):
    return R.product_cumulative(star.orders, star.catalog, (), **EVER, category=ONE_CATEGORY)


@query
def max_creation_date(spark, sf_dir):
    latest = R.max_creation_date(_events(spark, sf_dir), None, ["click"], EVENT_START, EVENT_END)
    return _dates_as_text(latest, ["max_creation_date"])


@_star_query
def max_creation_date_category(star):
    latest = R.max_creation_date(star.orders, star.catalog, (), START, END, ONE_CATEGORY)
    return _dates_as_text(latest, ["max_creation_date"])


@_star_query
def partner_report(star):
    return P.partner_report(star.orders, star.contacts, **EVER)


@_star_query
def partner_by_registrations(star):
    return P.by_registrations(P.partner_report(star.orders, star.contacts, START, END))


@query
def freshness(spark, sf_dir):
    latest = R.freshness(_events(spark, sf_dir), S.frame(spark, sf_dir, S.CONTACTS))
    return _dates_as_text(V.freshness_text(latest), ["latest_order", "latest_contact"])


@_star_query
def freshness_of_tables(star):
    return _dates_as_text(
        V.freshness_text(R.freshness(star.orders, star.contacts)), ["latest_order", "latest_contact"]
    )


@_star_query
def order_count(star):
    return R.order_count(star.orders)


@_star_query
def category_share(star):
    return R.category_share(
        R.category_revenue(star.orders, star.catalog, START, END, ordered=False)
    )


# --- what imports keep: the index of ids, sums by day, products in step ---------


@_star_query
def upsert_by_index(star):
    """The orders after two imports; the second finds its orders by their buckets."""
    space = K.empty_space(star)
    for sql in (S.SALES_BEFORE, S.SALES_BATCH):
        merge_rows(space.store, ORDER_UPLOAD, K.sales(star, sql))
    rows = space.orders.select("id", "content", "status", "creation_date", "utm_source", "income")
    return _dates_as_text(rows, ["creation_date"])


@_star_query
def orders_by_index(star):
    """Every order of one line, found by the index and read from the months that have them."""
    numbers = S.raw(star.spark, star.sf_dir, "lineitem").filter("l_linenumber = 2")
    asked = numbers.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id")).distinct()
    return _dates_as_text(K.kept(star).orders_by_ids(asked).select("id", "content", "creation_date"), ["creation_date"])


@_star_query
def orders_by_source_kept(star):
    return _dates_as_text(K.kept(star).orders_by_source(SOURCE).select("id", "creation_date", "content", "income"), ["creation_date"])


@_star_query
def sync_after_import(star):
    return K.kept(star).catalog.products


@_star_query
def sales_by_day_kept(star):
    return R.sales_by_day(K.kept(star).product_days, star.catalog, **EVER)


@_star_query
def monthly_by_product_kept(star):
    return R.monthly_by_product(K.kept(star).product_days, star.catalog, **EVER)


@_star_query
def monthly_by_category_kept(star):
    return R.monthly_by_category(K.kept(star).product_days, star.catalog, **PERIOD, **_CHOICES)


@_star_query
def category_revenue_kept(star):
    return R.category_revenue(K.kept(star).product_days, star.catalog, START, END, BAD_CATEGORIES)


@_star_query
def product_summary_kept(star):
    return R.product_summary(K.kept(star).product_days, star.catalog, (), START, END)


@_star_query
def product_daily_kept(star):
    return R.product_daily(K.kept(star).product_days, star.catalog, PICKED, **EVER)


@_star_query
def max_creation_date_kept(star):
    latest = R.max_creation_date(K.kept(star).product_days, star.catalog, (), START, END, ONE_CATEGORY)
    return _dates_as_text(latest, ["max_creation_date"])


@_star_query
def partner_report_kept(star):
    return P.partner_report(K.kept(star).source_days, star.contacts, START, END)


@_star_query
def order_count_kept(star):
    return K.kept(star).order_count()


# --- total rows and summary lines -------------------------------------------


@_star_query
def product_summary_totals(star):
    measures = R.product_measures(star.orders, star.catalog, (), **EVER)
    return X.product_summary_totals(measures)


@_star_query
def paid_products_totals(star):
    return X.paid_products_totals(
        R.paid_products(star.orders, star.catalog, **EVER, ordered=False)
    )


@_star_query
def category_revenue_totals(star):
    return X.category_revenue_totals(
        R.category_revenue(star.orders, star.catalog, **PERIOD, ordered=False)
    )


@_star_query
def monthly_totals(star):
    return X.monthly_totals(R.monthly_sales(star.orders, star.catalog, **EVER, ordered=False))


@_star_query
def monthly_by_product_totals(star):
    return X.monthly_totals(
        R.monthly_by_product(star.orders, star.catalog, **PERIOD, ordered=False), "product"
    )


@_star_query
def monthly_by_category_totals(star):
    return X.monthly_totals(
        R.monthly_by_category(star.orders, star.catalog, **EVER, ordered=False), "category"
    )


@_star_query
def monthly_kpis(star):
    return X.summary_line(R.monthly_sales(star.orders, star.catalog, **EVER))


@_star_query
def monthly_by_product_kpis(star):
    return X.summary_line(R.monthly_by_product(star.orders, star.catalog, **EVER))


@_star_query
def monthly_by_category_kpis(star):
    return X.summary_line(R.monthly_by_category(star.orders, star.catalog, **EVER))


# --- presentation ----------------------------------------------------------


@_star_query
def product_summary_rounded(star):
    return V.rounded_product_summary(R.product_summary(star.orders, star.catalog, (), **EVER))


def _daily(star: S.Star) -> DataFrame:
    return R.product_cumulative(star.orders, star.catalog, PICKED, **EVER)


@_star_query
def product_percent_of_base(star):
    return V.percent_of_base(_daily(star))


@_star_query
def product_percent_na(star):
    return V.percent_of_base(_daily(star), base=0)


@_star_query
def category_options(star):
    return C.category_options(star.categories)


@_star_query
def monthly_product_options(star):
    return C.product_options(star.orders, star.catalog, SOME_CATEGORIES, BAD_CATEGORIES)


@_star_query
def monthly_formatted(star):
    totals = X.monthly_totals(
        R.monthly_sales(star.orders, star.catalog, **EVER, ordered=False)
    )
    return V.money_columns(totals, ["total_sales"]).drop("total_orders", "is_total")


@_star_query
def partner_display(star):
    report = P.partner_report(star.orders, star.contacts, START, END, exclude_common=True)
    return E.partner_export(report, show_income=False)


def _fund(star: S.Star, category_name: str) -> DataFrame:
    pieces = R.product_pieces(star.orders, SalesFilter(**PERIOD, categories=ONE_CATEGORY), star.catalog)
    return V.fund_of_pieces(pieces, category_name, FUND_MARKER, FUND_TITLE, headcount=3)


@_star_query
def fund_allocation(star):
    return _fund(star, "Spring PROMO")


@_star_query
def fund_allocation_hidden(star):
    return _fund(star, "Spring")


@_star_query
def fund_texts(star):
    return V.fund_texts(_fund(star, "Spring PROMO"))


@_star_query
def fund_of_nothing(star):
    """The block of a report without orders (income 0) beside that of one with some."""
    pieces = R.product_pieces(star.orders, SalesFilter(**PERIOD, categories=ONE_CATEGORY), star.catalog)
    none = pieces.filter("total_orders < 0")
    both = [(k, V.fund_of_pieces(p, "Spring", FUND_MARKER, FUND_TITLE, headcount=3)) for k, p in (("none", none), ("some", pieces))]
    rows = [block.select(F.lit(k).alias("orders"), "total_income", "visible") for k, block in both]
    return rows[0].unionByName(rows[1])


@_star_query
def monthly_kpi_texts(star):
    return V.summary_texts(X.summary_line(R.monthly_sales(star.orders, star.catalog, **EVER)))


@_star_query
def filter_products_listed(star):
    """A long list of product texts as a frame: the products of one category."""
    names = C.products_with_categories(star.catalog).where(F.size("categories") > 0).select("name")
    return L.filter_products(star.orders, include=names).select(*_ROW)


# --- catalog maintenance -----------------------------------------------------


def _known_products(star: S.Star) -> DataFrame:
    """The products before a sync: those whose name does not start with 'small'."""
    return star.products.filter(~F.col("name").startswith("small"))


@_star_query
def sync_products(star):
    return C.sync_products(star.orders, _known_products(star))


def _requested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category names asked for: every brand, and every type once per part."""
    part = S.raw(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("name")).distinct()
    types = part.select(F.when(F.col("p_size") != 50, F.col("p_type")).alias("name"))
    return brands.unionByName(types)


@query
def create_categories(spark, sf_dir):
    return C.create_categories(S.star(spark, sf_dir).categories, _requested_names(spark, sf_dir))


@query
def category_conflicts(spark, sf_dir):
    return C.category_conflicts(S.star(spark, sf_dir).categories, _requested_names(spark, sf_dir))


def _doomed(star: S.Star) -> DataFrame:
    """Categories to delete, some of them unknown: the odd ids, and 100 more of each."""
    odd = star.categories.filter("id % 2 = 1").select("id")
    return odd.unionByName(odd.select((F.col("id") + 100).alias("id")))


@_star_query
def delete_categories(star):
    return C.delete_categories(star.catalog, _doomed(star)).categories


@_star_query
def bridge_after_delete(star):
    return C.delete_categories(star.catalog, _doomed(star)).links


@_star_query
def unknown_categories(star):
    return C.unknown_ids(star.categories, _doomed(star))


@_star_query
def assign_categories(star):
    ids = F.col("id")
    wanted = F.when(ids % 3 == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(F.lit(1).cast("bigint"), ids % 6 + 1, ids + 1000)
    )
    changes = star.products.filter("id % 2 = 0").select(
        F.when(ids % 10 == 0, ids + 5000).otherwise(ids).alias("product_id"),
        wanted.alias("category_ids"),
    )
    return C.assign_categories(star.catalog, changes)
