"""Reading uploads: strict headers, lenient cells."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import finite
from tallywright.schemas import MISSING_MARKERS, UploadSpec

# Position of a row in its upload. Later rows win over earlier ones.
ROW_ORDER = "__row"

# Date layouts besides ISO, as a pattern and its ISO form. A time may follow.
DATE_LAYOUTS = (
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1"),  # 31.12.2023, day first
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),  # 12/31/2023, month first
)

# Fields that hold ids of this or another table.
ID_FIELDS = ("id", "contact_id", "partner_id", "utm_source", "tg_id")


class UploadRejected(ValueError):
    """The whole upload is refused; nothing of it was stored."""


def read_upload(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    multiline: bool = False,
    **options,
) -> DataFrame:
    """Read one upload, all CSV cells as text; ``options`` go to the reader (``sep=";"``).

    Every CSV file's own header names its columns; files may have them in
    different orders, but not different ones. One job reads the headers of all files. A row with more or fewer cells than
    its header makes any job that reads it fail (see ``refusing_malformed``), which
    a line break in a cell does too unless ``multiline`` is set: that allows line
    breaks inside quoted cells, at the price that a file can no longer be split
    between tasks.

    The row position is (file, block offset, order within the block): Spark may
    pack blocks into tasks in any order, so a plain increasing id would not do.
    """
    if fmt == "csv":
        rows = _read_csv(spark, path, multiline, options)
    else:
        rows = _positioned(spark.read.format(fmt).options(**options).load(path))
    return rows


def _read_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool, options: dict) -> DataFrame:
    def reader():
        return spark.read.options(header=True, inferSchema=False, escape='"', multiLine=multiline, **options)

    files = _headers(reader, spark, path, options)
    if not files:
        return _positioned(reader().csv(path))
    first, *others = files
    for header in others:
        if odd := set(first) ^ set(header):
            raise UploadRejected(f"files of one upload differ in their headers: {sorted(odd)}")
    parts = []
    for header, group in files.items():  # one for each order of the columns
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
        strict = reader().options(mode="FAILFAST", columnPruning=False, enforceSchema=False).schema(schema)
        parts.append(_positioned(strict.csv(group)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


#: Options of the reader that also say which files there are, and those under which the
#: first line of a file as text need not be its header.
_LISTING = ("pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter")
_UNLIKE_TEXT = frozenset(["encoding", "charset", "lineSep", "comment"])


def _headers(reader, spark: SparkSession, path, options: Mapping) -> dict[tuple[str, ...], list[str]]:
    """Files by the columns that their headers name.

    One job finds the first line of every file, however many there are. Files with the
    same line have the same header, so the reader opens one of them to split it.
    """
    lines = spark.read.options(**{k: v for k, v in options.items() if k in _LISTING}).text(path)
    files = sorted(map(unquote, lines.inputFiles()))  # given as encoded URLs
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    firsts = (
        lines.select(F.input_file_name().alias("file"), "value", place.alias("place")).filter(F.trim("value") != "")
        .groupBy("file").agg(F.min_by("value", "place").alias("line"))
        .groupBy("line").agg(F.collect_list("file").alias("files"))
    )
    alike = [] if _UNLIKE_TEXT & options.keys() else [sorted(map(unquote, r.files)) for r in firsts.collect()]
    known = {file for group in alike for file in group}
    if not known <= set(files):  # under names that cannot be matched
        alike, known = [], set()
    alike += [[file] for file in files if file not in known]
    found: dict[tuple[str, ...], list[str]] = {}
    for group in sorted(alike):
        found.setdefault(tuple(reader().csv(group[0]).columns), []).extend(group)
    return {header: sorted(group) for header, group in found.items()}


def _positioned(rows: DataFrame) -> DataFrame:
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("n"),
    )
    return rows.select("*", position.alias(ROW_ORDER))


@contextmanager
def refusing_malformed():
    """Turns the failure of a job over a malformed upload into a refusal."""
    try:
        yield
    except Exception as error:
        told = str(error)
        if any(name in told for name in ("MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD")):
            raise UploadRejected("a row of the upload does not have the cells of its header") from error
        raise


def header_problems(columns: Iterable[str], headers: Mapping[str, str]) -> list[tuple[str, str]]:
    """(``missing``|``extra``, header) for every deviation from the expected set."""
    given = [c for c in columns if c != ROW_ORDER]
    missing = [("missing", h) for h in headers if h not in given]
    return missing + [("extra", c) for c in given if c not in headers]


def header_report(upload: DataFrame, spec: UploadSpec) -> DataFrame:
    """The header problems of an upload and how many rows are refused for each."""
    problems = header_problems(upload.columns, spec.headers)
    found = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.lit(column).alias("column"))
          for kind, column in problems]
    ).cast("array<struct<kind:string,column:string>>")
    return (
        upload.agg(F.count(F.lit(1)).alias("refused_rows"))
        .select(F.explode(found).alias("problem"), "refused_rows")
        .select("problem.kind", "problem.column", "refused_rows")
    )


def check_headers(upload: DataFrame, spec: UploadSpec) -> DataFrame:
    """Pass the upload on if its headers are exactly the expected ones, in any order."""
    problems = header_problems(upload.columns, spec.headers)
    if problems:
        listed = "; ".join(
            f"{kind}: {', '.join(c for k, c in problems if k == kind)}"
            for kind in ("missing", "extra") if any(k == kind for k, _ in problems)
        )
        raise UploadRejected(f"headers of the {spec.table} upload do not match ({listed})")
    return upload


def rename_columns(upload: DataFrame, spec: UploadSpec) -> DataFrame:
    """Headers to field names."""
    return upload.withColumnsRenamed(dict(spec.headers))


def null_normalize(rows: DataFrame, markers: Sequence[str] = MISSING_MARKERS) -> DataFrame:
    """Cells that say "missing" become null: marker texts and NaN."""
    missing = [F.lit(m) for m in markers]
    fixed = {}
    for name, kind in rows.dtypes:
        if kind == "string":
            fixed[name] = F.when(~F.col(name).isin(missing), F.col(name))
        elif kind in ("double", "float"):
            fixed[name] = F.when(~F.isnan(name), F.col(name))
    return rows.withColumns(fixed) if fixed else rows


def parse_dates(
    rows: DataFrame, columns: Sequence[str], layouts: Sequence[tuple[str, str]] = DATE_LAYOUTS
) -> DataFrame:
    """Date texts to zone-less timestamps; what cannot be read becomes null.

    Other layouts are rewritten to ISO and parsed by a cast: unlike the pattern
    parser this does not pass through the session's time zone, and a text that
    is no date costs no exception.
    """
    kinds = dict(rows.dtypes)

    def parsed(name: str) -> Column:
        if kinds[name] != "string":
            return F.col(name).cast("timestamp_ntz")
        text = F.trim(F.col(name))
        other = text
        for pattern, iso in layouts:
            other = F.regexp_replace(other, pattern, iso)
        # ISO texts are most; they are spared the patterns
        iso_first = F.substring(text, 5, 1) == "-"
        return F.when(iso_first, text).otherwise(other).try_cast("timestamp_ntz")

    return rows.withColumns({c: parsed(c) for c in columns if c in kinds})


def cast_money(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Amount texts to doubles; what is not a finite number becomes null."""
    present = rows.columns
    return rows.withColumns({c: finite(F.col(c).try_cast("double")) for c in columns if c in present})


def normalize_ids(rows: DataFrame, columns: Sequence[str] = ID_FIELDS) -> DataFrame:
    """Whole-number ids without ``.0``.

    A spreadsheet column of numbers with gaps reads as ``123.0``; without the
    ``.0`` the same id is the same text in every upload, and UTM sources still
    match the contact ids they stand for.
    """
    kinds = dict(rows.dtypes)
    return rows.withColumns({
        c: F.regexp_replace(_text(c, kinds[c]), r"^(\d+)\.0$", "$1") for c in columns if c in kinds
    })


def _text(name: str, kind: str) -> Column:
    """A cell as text; whole doubles (ids, phones) without fraction and exponent."""
    col = F.col(name)
    if kind not in ("double", "float"):
        return col.cast("string")
    digits = F.when(col == F.rint(col), col.try_cast("decimal(38,0)").cast("string"))
    return F.coalesce(digits, col.cast("string"))


def drop_empty_keys(rows: DataFrame, key: str = "id") -> DataFrame:
    """Drop rows without a usable key: null, empty or zero."""
    return rows.filter(~F.col(key).isin("", "0"))


def project_to_model(rows: DataFrame, spec: UploadSpec) -> DataFrame:
    """Only the fields of the target table (and the row position), in its order."""
    present = rows.columns
    kept = [f for f in spec.schema.fieldNames() if f in present]
    return rows.select(*kept, *[c for c in present if c == ROW_ORDER])


def clean_upload(upload: DataFrame, spec: UploadSpec) -> DataFrame:
    """An upload as typed rows of its table; raises if the headers are wrong."""
    rows = rename_columns(check_headers(upload, spec), spec)
    rows = null_normalize(rows)
    rows = parse_dates(rows, spec.dates)
    rows = cast_money(rows, spec.money)
    rows = drop_empty_keys(normalize_ids(rows), spec.key)
    return project_to_model(_texts(rows, spec), spec)


def _texts(rows: DataFrame, spec: UploadSpec) -> DataFrame:
    """Text fields as text, also where a typed upload (Parquet) holds numbers."""
    kinds = dict(rows.dtypes)
    wanted = {
        f.name: _text(f.name, kinds[f.name]) for f in spec.schema.fields
        if f.dataType.simpleString() == "string" and kinds.get(f.name, "string") != "string"
    }
    return rows.withColumns(wanted) if wanted else rows
