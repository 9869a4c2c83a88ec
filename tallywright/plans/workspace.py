"""A folder of sales tables with everything one can do to them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import append_ids, may_match
from tallywright.operators import catalog as C
from tallywright.operators import reports as R
from tallywright.operators.filters import MONTH_SLOT, NO_MONTH, orders_by_source
from tallywright.operators.present import freshness_text
from tallywright.plans import tabs
from tallywright.plans.derived import OrderKeys, refresh
from tallywright.plans.imports import ImportResult, import_upload
from tallywright.schemas import UPLOADS
from tallywright.session import scratch, stored
from tallywright.sources import exports
from tallywright.sources.tables import TableStore
from tallywright.sources.uploads import read_upload


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = TableStore(spark, root)

    # --- tables ----------------------------------------------------------

    @property
    def orders(self) -> DataFrame:
        return self.store.read("orders")

    @property
    def product_days(self) -> DataFrame:
        """The orders summed by day and product, up to date: what income reports start from."""
        return refresh(self.store, "product_days")

    @property
    def source_days(self) -> DataFrame:
        """The orders summed by day and UTM source, up to date."""
        return refresh(self.store, "source_days")

    @property
    def contacts(self) -> DataFrame:
        return self._table("contacts")

    def order(self, key: str) -> DataFrame:
        """One order by its id: a bucket of the index is read, and one month."""
        return C.by_id(self._orders_near(self.spark.createDataFrame([(key,)], "id string")), key)

    def orders_by_ids(self, asked: DataFrame) -> DataFrame:
        """The orders whose ids a frame lists, from the months that the index names."""
        asked = stored(asked.select("id").distinct(), "asked")
        near = self._orders_near(asked)
        # Asked ids are distinct, so this keeps rows as a semi join does, which Spark would push below the sieve.
        return may_match(near, asked, "id").join(asked, "id").select(*near.columns)

    def _orders_near(self, asked: DataFrame) -> DataFrame:
        return self.store.read("orders", OrderKeys(self.store).months(asked))

    def orders_by_source(self, utm_source: str) -> DataFrame:
        """The orders of one source, from the months that have some."""
        of_source = self.source_days.filter(F.col("utm_source") == utm_source)
        months = {r[0] for r in of_source.select(MONTH_SLOT).distinct().collect()}
        return orders_by_source(self.store.read("orders", months), utm_source)

    @property
    def catalog(self) -> C.Catalog:
        return C.Catalog(
            self._table("products"),
            self._table("product_categories"),
            self._table("product_category_association"),
        )

    def tables(self) -> dict[str, DataFrame]:
        return {name: self._table(name) for name in self.store.own}

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name).drop(self.store.tables[name].slot)

    # --- uploads and exports ---------------------------------------------

    def import_orders(self, path, fmt: str = "csv", **options) -> ImportResult:
        return self._import("orders", path, fmt, options)

    def import_contacts(self, path, fmt: str = "csv", **options) -> ImportResult:
        return self._import("contacts", path, fmt, options)

    def _import(self, kind: str, path, fmt: str, options: Mapping) -> ImportResult:
        upload = read_upload(self.spark, path, fmt, **options)
        return import_upload(self.store, UPLOADS[kind], upload)

    def export_all(self, folder: str) -> dict[str, str]:
        """Every table as CSV; returns the path of each."""
        return exports.export_tables(self.tables(), folder)

    def export_partners(self, path: str, start, end, exclude_common=True, show_income=True) -> None:
        tab = self.partner_tab(start, end, exclude_common, show_income)
        exports.write_csv(tab["table"], path)

    # --- catalog ---------------------------------------------------------

    def sync_products(self) -> int:
        """Add products that occur in orders only; returns how many.

        Only the months written since the last sync are read: names of all others are
        products already.
        """
        version, _ = self.store.state("orders")
        covers = self.store.covers("products")
        if version == (covers or 0):
            return 0
        with scratch(self.spark):
            products = self._table("products")
            fresh = self.store.read("orders", self.store.changed("orders", covers))
            names = stored(C.new_product_names(fresh, products), "new-names")
            added = names.count()
            if added:
                self.store.publish("products", products.unionByName(append_ids(names, products)), covers=version)
            else:
                self.store.cover("products", version)
            return added

    def create_categories(self, names: Sequence[str] | DataFrame) -> DataFrame:
        """Create all of the names, or raise if one is missing, known or repeated.

        ``names`` is a list, or a frame whose first column holds them.
        """
        categories = self._table("product_categories")
        asked = names.select(F.col(names.columns[0]).alias("name")) if isinstance(names, DataFrame) \
            else self.spark.createDataFrame([(n,) for n in names], "name string")
        conflicts = C.category_conflicts(categories, asked).take(5)
        if conflicts:
            raise ValueError(f"cannot create: {[(r['name'], r['reason']) for r in conflicts]}")
        with scratch(self.spark):
            self.store.publish("product_categories", stored(C.create_categories(categories, asked), "categories"))
        return self._table("product_categories").join(asked, "name", "left_semi").select("id", "name")

    def delete_categories(self, ids: Iterable[int]) -> None:
        """Delete categories with their links, or raise if one is unknown."""
        catalog = self.catalog
        doomed = self.spark.createDataFrame([(i,) for i in ids], "id long")
        self._require_known(catalog.categories, doomed, "category")
        after = C.delete_categories(catalog, doomed)
        # Links first: if the second write is lost, what remains is a category
        # without products and the call can be repeated.
        with scratch(self.spark):
            self.store.publish("product_category_association", stored(after.links, "links"))
            self.store.publish("product_categories", stored(after.categories, "categories"))

    def assign_categories(self, changes: Mapping[int, Sequence[int]] | DataFrame) -> None:
        """Replace the categories of each given product, or raise if one is unknown.

        ``changes`` maps a product id to category ids, or is a frame with
        ``product_id``, ``category_ids`` and, where a product may have several
        changes, ``position``: the last one counts.
        """
        rows = changes if isinstance(changes, DataFrame) else self.spark.createDataFrame(
            [(p, list(c or [])) for p, c in changes.items()],
            "product_id long, category_ids array<long>",
        )
        catalog = self.catalog
        self._require_known(catalog.products, rows, "product", "product_id")
        if "position" not in rows.columns:
            twice = rows.groupBy("product_id").count().filter("count > 1").take(5)
            if twice:
                raise ValueError(f"several changes without a position: {sorted(r.product_id for r in twice)}")
        links = C.assign_categories(catalog, rows)
        with scratch(self.spark):
            self.store.publish("product_category_association", stored(links, "links"))

    def _require_known(self, table, asked, what: str, column: str = "id") -> None:
        unknown = C.unknown_ids(table, asked, column).take(5)
        if unknown:
            raise KeyError(f"unknown {what}: {', '.join(str(r.id) for r in unknown)}")

    def products_with_categories(self) -> DataFrame:
        return C.products_with_categories(self.catalog)

    def category_options(self) -> DataFrame:
        return C.category_options(self._table("product_categories"))

    # --- reports ---------------------------------------------------------

    def freshness(self) -> DataFrame:
        """Of the sums by day only the newest month is opened; the store knows which it is."""
        refresh(self.store, "product_days")
        months = [m for m in self.store.state("product_days")[1] if m != NO_MONTH]
        newest = self.store.read("product_days", {max(months, default=NO_MONTH)})
        return freshness_text(R.freshness(newest, self.contacts))

    def order_count(self) -> DataFrame:
        return R.order_count(self.product_days)

    def unique_products(self, categories=None) -> DataFrame:
        return C.unique_products(self.product_days, self.catalog, categories)

    def general_tab(self, start, end, category=None):
        return tabs.general_tab(self.product_days, self.catalog, start, end, category)

    def product_tab(self, start, end, products=(), category=None, **options):
        return tabs.product_tab(self.product_days, self.catalog, start, end, products, category, **options)

    def period_tab(self, start, end, category=None):
        return tabs.period_tab(self.product_days, self.catalog, start, end, category)

    def category_tab(self, start=None, end=None, exclude=None, include=None):
        return tabs.category_tab(self.product_days, self.catalog, start, end, exclude, include)

    def partner_tab(self, start, end, exclude_common=True, show_income=False):
        return tabs.partner_tab(self.source_days, self.contacts, start, end, exclude_common, show_income)

    def monthly_tab(self, start, end, **choices):
        return tabs.monthly_tab(self.product_days, self.catalog, start, end, **choices)
