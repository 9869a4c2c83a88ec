import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tallywright.operators.catalog import Catalog  # noqa: E402
from tallywright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "tallywright-tests", "local[*]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__checkpoint__dir=shared,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_orders(spark):
    """Orders from (content, income, creation_date text[, utm_source])."""

    def make(*rows):
        full = [(str(i), *r, *([None] * (4 - len(r)))) for i, r in enumerate(rows, 1)]
        frame = spark.createDataFrame(
            full, "id string, content string, income double, at string, utm_source string"
        )
        return frame.withColumn("creation_date", frame["at"].cast("timestamp_ntz")).drop("at")

    return make


@pytest.fixture
def make_catalog(spark):
    """A catalog from product -> categories."""

    def make(products: dict[str, list[str]]):
        names = sorted({c for cs in products.values() for c in cs})
        ids = {n: i for i, n in enumerate(names, 1)}
        links = [(p, ids[c]) for p, cs in enumerate(products.values(), 1) for c in cs]
        return Catalog(
            spark.createDataFrame(list(enumerate(products, 1)), "id long, name string"),
            spark.createDataFrame([(i, n) for n, i in ids.items()], "id long, name string"),
            spark.createDataFrame(links, "product_id long, category_id long"),
        )

    return make
