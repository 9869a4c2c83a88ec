import csv
import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallywright.operators import upsert as U
from tallywright.schemas import CONTACT_UPLOAD, ORDER_HEADERS, ORDER_UPLOAD
from tallywright.sources import uploads as I

# A gap in the number column, missing dates, quotes and commas.
SAMPLE = {
    "id": ["1", "2", "3", "4"],
    "content": ["Teapot, blue", "Lamp", "Rug 2x3", "Vase"],
    "total_amount": ["199.9", "945.0", "77.25", "12"],
    "creation_date": ["2021-06-07", "2021-06-08", "2021-06-09", "2021-06-12"],
    "payment_date": ["2021-06-10", "", "2021-06-11", "2021-06-12"],
    "income": ["150", "900", "70", "0"],
    "tags": ["#new", "it\"s", "", "red, round"],
    "contact_id": ["9.0", "", "12.0", "15.0"],
    "utm_source": ["mail", "shop", "search", "mail"],
    "gc_order_date": ["", "2021-06-08", "2021-06-09", "2021-06-12"],
}


def write_orders(path, columns=SAMPLE, headers=ORDER_HEADERS):
    count = len(next(iter(columns.values())))
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(headers)
        for i in range(count):
            writer.writerow([columns.get(f, ["x"] * count)[i] for f in headers.values()])
    return str(path)


def test_sample_upload(spark, tmp_path):
    upload = I.read_upload(spark, write_orders(tmp_path / "orders.csv"))
    clean = I.clean_upload(upload, ORDER_UPLOAD)
    got = clean.orderBy("id").select(
        "id", "total_amount", "creation_date", "payment_date", "income", "tags", "contact_id", "gc_order_date"
    )
    day = [dt.datetime(2021, 6, d) for d in range(13)[1:]]
    assert rows(got) == [
        ("1", 199.9, day[6], day[9], 150.0, "#new", "9", None),
        ("2", 945.0, day[7], None, 900.0, 'it"s', None, day[7]),
        ("3", 77.25, day[8], day[10], 70.0, None, "12", day[8]),
        ("4", 12.0, day[11], day[11], 0.0, "red, round", "15", day[11]),
    ]
    assert set(clean.columns) == set(ORDER_HEADERS.values()) | {I.ROW_ORDER}


def test_header_order_does_not_matter(spark, tmp_path):
    turned = dict(reversed(ORDER_HEADERS.items()))
    upload = I.read_upload(spark, write_orders(tmp_path / "turned.csv", headers=turned))
    assert I.clean_upload(upload, ORDER_UPLOAD).count() == 4


def test_wrong_headers_are_listed_and_refused(spark, tmp_path):
    headers = {h: f for h, f in ORDER_HEADERS.items() if h != "Валюта"} | {"More": "more"}
    upload = I.read_upload(spark, write_orders(tmp_path / "wrong.csv", headers=headers))
    assert rows(I.header_report(upload, ORDER_UPLOAD)) == [("missing", "Валюта", 4), ("extra", "More", 4)]
    with pytest.raises(I.UploadRejected, match="missing: Валюта; extra: More"):
        I.clean_upload(upload, ORDER_UPLOAD)
    with pytest.raises(I.UploadRejected):
        I.clean_upload(upload, CONTACT_UPLOAD)


def test_right_headers_report_nothing(spark, tmp_path):
    upload = I.read_upload(spark, write_orders(tmp_path / "right.csv"))
    assert I.header_report(upload, ORDER_UPLOAD).count() == 0


def test_header_with_a_dot(spark):
    frame = spark.createDataFrame([tuple("x" * 25)], list(CONTACT_UPLOAD.headers))
    assert I.rename_columns(frame, CONTACT_UPLOAD).columns == list(CONTACT_UPLOAD.headers.values())


def test_rows_keep_their_file_order_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a\n" + "\n".join(str(i).zfill(9) for i in range(20000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = I.read_upload(spark, str(path))
        assert read.rdd.getNumPartitions() > 1
        got = [r.a for r in read.orderBy(I.ROW_ORDER).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(got)


def test_dates(spark):
    texts = ["2023-01-10", "2023-01-10 11:12:13", "2023-01-10T11:12:13", "10.01.2023", "10.01.2023 11:12",
             "2023-02-30", "soon", None, " 2023-01-10 "]
    frame = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [r.d for r in I.parse_dates(frame, ["d"]).collect()]
    day, time = dt.datetime(2023, 1, 10), dt.datetime(2023, 1, 10, 11, 12, 13)
    assert got == [day, time, time, day, time.replace(second=0), None, None, None, day]


def test_missing_cells(spark):
    frame = spark.createDataFrame([("NA", float("nan")), ("", 1.0), ("nan", None), ("ok", 2.0)], "s string, x double")
    assert rows(I.null_normalize(frame)) == [(None, None), (None, 1.0), (None, None), ("ok", 2.0)]


def test_typed_uploads(spark, tmp_path):
    text = I.read_upload(spark, write_orders(tmp_path / "orders.csv")).drop(I.ROW_ORDER)
    phone, key = "Телефон контакта", "Идентификатор"
    typed = text.withColumns({
        key: F.col(key).cast("double") * 10_000_000, phone: F.lit(79991112233.0),
        "Доход": F.lit(float("nan")), "Дата создания": F.col("Дата создания").cast("timestamp_ntz"),
    })
    typed.write.parquet(str(tmp_path / "typed"))
    clean = I.clean_upload(I.read_upload(spark, str(tmp_path / "typed"), "parquet"), ORDER_UPLOAD)
    got = clean.orderBy("id").select("id", "contact_phone", "income", "creation_date").first()
    assert tuple(got) == ("10000000", "79991112233", None, dt.datetime(2021, 6, 7))


def test_separator_and_byte_order_mark(spark, tmp_path):
    path = write_orders(tmp_path / "orders.csv")
    text = open(path, encoding="utf-8").read().replace('"a, b"', "ab").replace(",", ";")
    (tmp_path / "semicolon.csv").write_text("\ufeff" + text, encoding="utf-8")
    upload = I.read_upload(spark, str(tmp_path / "semicolon.csv"), sep=";")
    assert I.clean_upload(upload, ORDER_UPLOAD).count() == 4


def test_line_breaks_in_cells(spark, tmp_path):
    lines = dict(SAMPLE, tags=["one\ntwo", "", "", ""])
    upload = I.read_upload(spark, write_orders(tmp_path / "lines.csv", lines), multiline=True)
    assert I.clean_upload(upload, ORDER_UPLOAD).filter("id = '1'").first().tags == "one\ntwo"


def test_rows_without_key_are_dropped(spark):
    frame = spark.createDataFrame([(None,), ("",), ("0",), ("7.0",), ("v1.0",)], "id string")
    assert rows(I.drop_empty_keys(I.normalize_ids(frame))) == [("7",), ("v1.0",)]


@pytest.fixture
def current(spark):
    return spark.createDataFrame(
        [("1", 7.0, "keep"), ("2", 8.0, "keep")], "id string, total_amount double, recipient_last_name string"
    )


def batch(spark, *pairs):
    return spark.createDataFrame(
        [(k, v, i) for i, (k, v) in enumerate(pairs)], f"id string, total_amount double, {I.ROW_ORDER} long"
    )


def test_nulls_overwrite_and_other_fields_stay(spark, current):
    last = U.last_rows(batch(spark, ("1", None), ("3", 3.0)))
    out = U.merged(current, U.mark_stored(last, U.stored_keys(current, last)))
    assert sorted(rows(out)) == [("1", None, "keep"), ("2", 8.0, "keep"), ("3", 3.0, None)]


def test_copies(spark, current):
    last = U.last_rows(batch(spark, ("1", 1.0), ("9", 2.0), ("1", 3.0), ("9", 4.0), ("8", 5.0), ("1", None)))
    marked = U.mark_stored(last, U.stored_keys(current, last))
    assert rows(U.upsert_conflicts(marked)) == [("9", 2)]
    assert rows(U.upsert_counts(marked)) == [(3, 3)]
    only = marked.filter("id = '1'")
    assert rows(U.merged(current, only).filter("id = '1'")) == [("1", None, "keep")]


def test_one_key_with_a_third_of_all_rows(spark, current):
    rows_ = spark.range(30000).selectExpr(
        "IF(id % 3 = 0, '1', concat('n', id)) AS id", "CAST(id AS double) AS total_amount", f"id AS {I.ROW_ORDER}"
    ).repartition(7)
    last = U.last_rows(rows_)
    marked = U.mark_stored(last, U.stored_keys(current, last))
    assert rows(U.upsert_counts(marked)) == [(20000, 10000)]
    assert U.merged(current, marked).filter("id = '1'").first().total_amount == 29997


def test_empty_batch_changes_nothing(spark, current):
    last = U.last_rows(batch(spark, ("x", 1.0)).filter(F.lit(False)))
    marked = U.mark_stored(last, U.stored_keys(current, last))
    assert rows(U.upsert_counts(marked)) == [(0, 0)]
    assert sorted(rows(U.merged(current, marked))) == sorted(rows(current))


def test_each_file_has_its_own_header(spark, tmp_path):
    """Columns in another order in a second file are mapped by name; others refuse."""
    turned = dict(reversed(ORDER_HEADERS.items()))
    write_orders(tmp_path / "a file, 100%25.csv")
    write_orders(tmp_path / "b.csv", headers=turned)
    upload = I.clean_upload(I.read_upload(spark, str(tmp_path)), ORDER_UPLOAD)
    kept = upload.drop(I.ROW_ORDER)
    assert kept.count() == 8 and kept.distinct().count() == 4
    headers = {h: f for h, f in ORDER_HEADERS.items() if h != "Валюта"} | {"More": "more"}
    write_orders(tmp_path / "c.csv", headers=headers)
    with pytest.raises(I.UploadRejected, match="More"):
        I.read_upload(spark, str(tmp_path))


def test_line_breaks_in_cells_refuse_unless_asked_for(spark, tmp_path):
    broken = SAMPLE | {"tags": ["#new", "line one\nline two", "", ""]}
    path = write_orders(tmp_path / "broken.csv", broken)
    with pytest.raises(I.UploadRejected), I.refusing_malformed():
        I.clean_upload(I.read_upload(spark, path), ORDER_UPLOAD).collect()
    whole = I.clean_upload(I.read_upload(spark, path, multiline=True), ORDER_UPLOAD)
    assert sorted(r.tags or "" for r in whole.collect()) == ["", "", "#new", "line one\nline two"]


def test_cells_that_are_no_amounts(spark):
    frame = spark.createDataFrame([(t,) for t in ("inf", "NAN", "Infinity", "-Infinity", "x", "1e15", "0.00004")], "income string")
    assert [r.income for r in I.cast_money(frame, ["income"]).collect()] == [None] * 5 + [1e15, 0.00004]


def test_long_numeric_ids_are_digits(spark):
    frame = spark.createDataFrame([(1234567890123456.0,), (123456789012345.0,), (9007199254740992.0,), (7.0,), (1.5,)], "id double")
    assert [r.id for r in I.normalize_ids(frame).collect()] == [
        "1234567890123456", "123456789012345", "9007199254740992", "7", "1.5"]


def test_one_digit_days_and_months(spark):
    frame = spark.createDataFrame([("1.2.2023",), ("3/14/2023",), ("2023-02-01 10:00:00",), ("1.2.23",)], "d string")
    assert [r.d for r in I.parse_dates(frame, ["d"]).collect()] == [
        dt.datetime(2023, 2, 1), dt.datetime(2023, 3, 14), dt.datetime(2023, 2, 1, 10), None]


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    """120 files in three orders of their columns, under odd names: as many jobs as orders and one."""
    folder = tmp_path / "many %41 ü"
    folder.mkdir()
    names = ["id", "content", "income"]
    for i in range(120):
        turned = names[i % 3:] + names[:i % 3]
        cells = {"id": str(i), "content": f"c {i}", "income": str(i)}
        lead = "\n" if i % 40 == 7 else ""
        (folder / f"part {i}%20+.csv").write_text(f"{lead}{','.join(turned)}\n{','.join(cells[c] for c in turned)}\n", encoding="utf-8")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    upload = I.read_upload(spark, str(folder))
    assert len(sc.statusTracker().getJobIdsForGroup("headers")) <= 12  # stages and listings of the three orders
    sc.setJobGroup("other", "other")
    assert sorted(rows(upload.select("id", "content", "income"))) == sorted((str(i), f"c {i}", str(i)) for i in range(120))
    (folder / "odd.csv").write_text("id,content,price\n1,2,3\n", encoding="utf-8")
    with pytest.raises(I.UploadRejected, match="income.*price"):
        I.read_upload(spark, str(folder))
