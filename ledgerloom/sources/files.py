"""CSV files in, parquet and JSON out."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import LEGACY_TABLES, TABLES, TableSpec

CORRUPT = "_corrupt_record"
BAD_CELLS = "_bad_cells"

# Texts that stand for a missing value in uploaded files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class UnknownCategory(ValueError):
    """Not one of the nine table names."""


class MissingColumns(ValueError):
    """A file lacks required columns."""


class RejectedFile(ValueError):
    """A file holds values or lines that do not fit its table."""


def table_spec(category: str, legacy: bool = False) -> TableSpec:
    registry = LEGACY_TABLES if legacy else TABLES
    if category not in registry:
        raise UnknownCategory(f"unknown category {category!r}; expected one of {list(registry)}")
    return registry[category]


def _typed(text: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return text
    if isinstance(data_type, T.IntegerType):
        # Whole numbers are often written with a decimal point once a column has gaps.
        number = text.try_cast("decimal(30,6)")
        return F.when(number == F.floor(number), number).try_cast(data_type)
    return text.try_cast(data_type)


def read_text_columns(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with its header's columns as text; broken lines are kept in ``_corrupt_record``."""
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    header = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    return (
        reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)
    )


def read_csv(spark: SparkSession, path: str, category: str, multi_line: bool = False) -> DataFrame:
    """A file of a category with declared types; extra columns stay text.

    Values that do not fit their type become null and their column's name is
    listed in ``_bad_cells``. ``multi_line`` allows line breaks inside quotes,
    at the price that a file can no longer be read in parts.
    """
    types = {f.name: f.dataType for f in table_spec(category).schema}
    raw = read_text_columns(spark, path, multi_line)
    columns, bad = [], []
    for name in raw.columns:
        if name == CORRUPT:
            continue
        text = F.col(f"`{name}`")
        known = F.when(~F.trim(text).isin(*MISSING_TEXTS), text)
        value = _typed(known, types.get(name, T.StringType()))
        columns.append(value.alias(name))
        bad.append(F.when(known.isNotNull() & value.isNull(), F.lit(name)))
    return raw.select(*columns, F.array_compact(F.array(*bad)).alias(BAD_CELLS), CORRUPT)


def check_required(df: DataFrame, category: str) -> None:
    missing = [c for c in table_spec(category).required_columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{category}: missing required columns {missing}")


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, on whatever file system it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getContentSummary(target).getLength()


def validate_file(spark: SparkSession, path: str, category: str, legacy: bool = False) -> DataFrame:
    """One row: does the file have the required columns, and how large is it. ``legacy`` takes the older four layouts."""
    spec = table_spec(category, legacy)
    df = read_text_columns(spark, path).drop(CORRUPT)
    missing = [c for c in spec.required_columns if c not in df.columns]

    def names(values: list[str]) -> Column:
        return F.array(*(F.lit(v) for v in values)).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(not missing).alias("valid"),
        F.lit(category).alias("file_category"),
        names(df.columns).alias("columns_found"),
        names(spec.required_columns).alias("columns_required"),
        names(missing).alias("columns_missing"),
        "row_count",
        F.lit(file_size(spark, path)).cast("bigint").alias("file_size_bytes"),
    )


def bad_row() -> Column:
    """Whether a row of ``read_csv`` has a cell or line that does not fit."""
    return (F.size(BAD_CELLS) > 0) | F.col(CORRUPT).isNotNull()


def store_file(spark: SparkSession, path: str, category: str, folder: str, on_error: str = "fail") -> str:
    """Keeps a CSV file as parquet under a name with its category and the time; returns that path.

    ``on_error``: 'fail' writes nothing and raises if any cell or line does not fit, 'null' leaves those cells empty.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    df = read_csv(spark, path, category)
    if on_error == "fail" and (wrong := df.where(bad_row()).count()):
        raise RejectedFile(f"{category}: {wrong} rows do not fit the declared types")
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    target = f"{folder.rstrip('/')}/{category}_{stamp}.parquet"
    df.drop(BAD_CELLS, CORRUPT).write.parquet(target)
    return target


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
