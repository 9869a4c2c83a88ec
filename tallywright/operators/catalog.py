"""Products, categories and the links between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import append_ids
from tallywright.operators.filters import as_ids, filter_links
from tallywright.schemas import UNCATEGORISED


@dataclass(frozen=True)
class Catalog:
    """The three dimension tables that reports and maintenance work on."""

    products: DataFrame  # id, name (unique)
    categories: DataFrame  # id, name (unique)
    links: DataFrame  # product_id, category_id


# --- reading ---------------------------------------------------------------


def products_with_categories(catalog: Catalog) -> DataFrame:
    """Every product with the sorted names of its categories, possibly none."""
    named = catalog.links.join(
        catalog.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")),
        "category_id",
    ).select(F.col("product_id").alias("id"), "category")
    # Links are folded before they meet the products, so that one row per
    # product is joined and products without a category keep a null list.
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list("category")).alias("categories"))
    return catalog.products.join(lists, "id", "left").select(
        "id",
        "name",
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )


def product_detail(catalog: Catalog, product_id: int) -> DataFrame:
    """One product with its categories; no row for an unknown id."""
    one = Catalog(
        catalog.products.filter(F.col("id") == product_id),
        catalog.categories,
        catalog.links.filter(F.col("product_id") == product_id),
    )
    return products_with_categories(one)


def by_id(table: DataFrame, key: int | str) -> DataFrame:
    """The row with this key, if there is one."""
    return table.filter(F.col("id") == key).limit(1)


def category_text(products: DataFrame, label: str = UNCATEGORISED) -> DataFrame:
    """Products with their categories as one text, or a label if there are none."""
    joined = F.array_join("categories", ", ")
    text = F.when(F.size("categories") == 0, F.lit(label)).otherwise(joined)
    return products.select("id", "name", text.alias("category_text"))


def search_products(products: DataFrame, text: str) -> DataFrame:
    """Products whose name contains ``text``, in any case; no pattern characters."""
    return products.filter(F.lower("name").contains(text.lower()))


def uncategorised_products(catalog: Catalog, text: str = "") -> DataFrame:
    """Products without any category, optionally searched by name."""
    linked = catalog.links.select(F.col("product_id").alias("id"))
    bare = catalog.products.join(linked, "id", "left_anti")
    return search_products(bare, text) if text else bare


def category_options(categories: DataFrame) -> DataFrame:
    """Pick list of categories: name as label, id as value."""
    return categories.select(F.col("name").alias("label"), F.col("id").alias("value")).orderBy("label")


def unique_products(orders: DataFrame, catalog: Catalog | None = None, categories=None) -> DataFrame:
    """Distinct product texts of the orders, optionally in any of some categories."""
    names = _order_names(orders)
    if wanted := as_ids(categories):
        if catalog is None:
            raise ValueError("a category choice needs the catalog")
        # Texts become distinct before the join, which then only has to test
        # each of them once; a semi join cannot duplicate them again.
        names = names.join(_names_in(catalog, wanted), "content", "left_semi")
    return names.select(F.col("content").alias("product")).orderBy("product")


def product_options(orders: DataFrame, catalog: Catalog, include=None, exclude=None) -> DataFrame:
    """Pick list of the products in any category that is included or excluded."""
    either = tuple(sorted(set(as_ids(include)) | set(as_ids(exclude))))
    names = unique_products(orders, catalog, either)
    return names.select(F.col("product").alias("label"), F.col("product").alias("value"))


def _order_names(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("content").isNotNull()).select("content").distinct()


def _names_in(catalog: Catalog, category_ids) -> DataFrame:
    wanted = filter_links(catalog.links, category_ids).select(F.col("product_id").alias("id"))
    return catalog.products.join(wanted, "id", "left_semi").select(F.col("name").alias("content"))


# --- maintenance: whole change sets, not single records ---------------------


def new_product_names(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Product texts in the orders that are not products yet."""
    known = products.select(F.col("name").alias("content"))
    return (
        _order_names(orders)
        .join(known, "content", "left_anti")
        .select(F.col("content").alias("name"))
    )


def sync_products(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Products including the new ones found in the orders."""
    added = append_ids(new_product_names(orders, products), products)
    return products.select("id", "name").unionByName(added)


def category_conflicts(categories: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested names that cannot be created, with the reason and how often asked."""
    asked = requests.groupBy("name").agg(F.count(F.lit(1)).alias("requests"))
    known = categories.select("name", F.lit(True).alias("known"))
    reason = (
        F.when(F.col("name").isNull(), "missing")
        .when(F.col("known"), "exists")
        .when(F.col("requests") > 1, "repeated")
    )
    judged = asked.join(known, "name", "left").select("name", reason.alias("reason"), "requests")
    return judged.filter(F.col("reason").isNotNull())


def create_categories(categories: DataFrame, requests: DataFrame) -> DataFrame:
    """Categories including the requested names; a repeated name is made once."""
    asked = requests.filter(F.col("name").isNotNull()).select("name").distinct()
    fresh = asked.join(categories.select("name"), "name", "left_anti")
    return categories.select("id", "name").unionByName(append_ids(fresh, categories))


def delete_categories(catalog: Catalog, doomed: DataFrame) -> Catalog:
    """The catalog without the categories ``doomed`` (column ``id``) and their links."""
    gone = doomed.select("id")
    return Catalog(
        catalog.products,
        catalog.categories.join(gone, "id", "left_anti"),
        catalog.links.join(gone.withColumnRenamed("id", "category_id"), "category_id", "left_anti")
        .select("product_id", "category_id"),
    )


def unknown_ids(table: DataFrame, asked: DataFrame, column: str = "id") -> DataFrame:
    """Ids in a change set that the table does not have."""
    ids = asked.select(F.col(column).alias("id")).distinct()
    return ids.join(table.select("id"), "id", "left_anti")


def assign_categories(catalog: Catalog, changes: DataFrame) -> DataFrame:
    """Links after replacing the category set of each changed product.

    ``changes`` has one row per product: ``product_id`` and ``category_ids``, an
    array. Unknown categories are ignored and an empty array clears the product;
    rows for unknown products are ignored too (``unknown_ids`` reports them). With a
    column ``position`` a product may have several changes, the last of which counts.
    """
    if "position" in changes.columns:
        changes = changes.groupBy("product_id").agg(F.max_by("category_ids", "position").alias("category_ids"))
    changed = changes.join(
        catalog.products.select(F.col("id").alias("product_id")), "product_id", "left_semi"
    )
    kept = catalog.links.join(changed.select("product_id"), "product_id", "left_anti")
    wanted = changed.select("product_id", F.explode("category_ids").alias("category_id")).join(
        catalog.categories.select(F.col("id").alias("category_id")), "category_id", "left_semi"
    )
    return kept.select("product_id", "category_id").unionByName(
        wanted.select("product_id", "category_id").distinct()
    )
