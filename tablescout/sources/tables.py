"""Scans, time coercion and the result sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shapes of written dates and the layout each is read with.
DATE_LAYOUTS = (
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{4,9}-\d{4}$", "d-MMMM-yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
)
# ISO dates with or without a time, a fraction of a second and a zone.
ISO_TIME = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?) ?(Z|[+-]\d{2}(?::?\d{2})?)?$"
# Words that stand for a missing value in a CSV file.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)

TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Read CSV (header, inferred types unless a schema is given), parquet, ORC or JSON; NaN becomes null.

    CSV cells may be quoted, with doubled quotes and line breaks inside, and the usual words for missing values are
    null in every column. Only files whose cells hold line breaks cannot be split and are read by one task each; whether
    one does costs one pass over the lines, in as many tasks as the files have blocks, and ``multiLine`` saves it. Inferring
    types costs one pass over the cells, a schema saves it.
    """
    kind = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.format(kind)
    if kind == "csv":
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        quoting = {"header": True, "quote": '"', "escape": '"', "inferSchema": False} | options
        if "multiLine" not in quoting:
            quoting["multiLine"] = _breaks_in_cells(spark, path, quoting["quote"])
        if wanted is not None:
            # Cells are read as text and converted afterwards, as words for missing values may stand in any column.
            reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields]))
        cells = missing_to_null(reader.options(**quoting).load(path))
        return nan_to_null(typed(cells, wanted) if wanted is not None else infer_types(cells))
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.options(**options).load(path))


def _breaks_in_cells(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether some cell goes on in the next line: then a line has an odd number of quotes. A single quote inside an
    unquoted cell looks the same, and such files are read whole as well."""
    lines = spark.read.text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1
    return not lines.where(odd).isEmpty()


def parse_csv(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Rows of text in CSV form as columns, by the same quoting, missing words and types as files."""
    wanted = T._parse_datatype_string(schema)
    cells = ", ".join(f"`{f.name}` string" for f in wanted.fields)
    parsed = lines.select(F.from_csv(F.col(line), F.lit(cells), {"quote": '"', "escape": '"'}).alias("cells")).select("cells.*")
    return nan_to_null(typed(missing_to_null(parsed), wanted))


def missing_to_null(cells: DataFrame) -> DataFrame:
    """Text cells with the words for missing values as null."""
    return cells.select(*[F.when(~F.col(f"`{c}`").isin(*NA_WORDS), F.col(f"`{c}`")).alias(c) for c in cells.columns])


WHOLE, NUMBER, BOOLEAN = r"^\s*[+-]?\d{1,19}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^(True|TRUE|true|False|FALSE|false)$"


def converted(name: str, kind: str) -> Column:
    """A text cell as a number or boolean, null where it is none."""
    shape = {"bigint": WHOLE, "double": NUMBER, "boolean": BOOLEAN}[kind]
    cell = F.col(f"`{name}`")
    return F.when(cell.rlike(shape), F.trim(cell).try_cast(kind))


def infer_types(cells: DataFrame) -> DataFrame:
    """Columns whose cells are all whole numbers, numbers or booleans get that type; one pass over the cells."""
    kinds = ("bigint", "double", "boolean")
    tally = [F.count(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(cells.columns)]
    tally += [F.count(converted(c, k)).alias(f"_{k}{i}") for i, c in enumerate(cells.columns) for k in kinds]
    seen = cells.agg(*tally).first()
    kept = []
    for i, c in enumerate(cells.columns):
        kind = next((k for k in kinds if seen[f"_n{i}"] and seen[f"_{k}{i}"] == seen[f"_n{i}"]), None)
        kept.append((converted(c, kind) if kind else F.col(f"`{c}`")).alias(c))
    return cells.select(*kept)


def typed(cells: DataFrame, schema: T.StructType) -> DataFrame:
    """Text cells as the types of a schema; cells that do not fit are null."""
    return cells.select(*[F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_time(text: Column) -> Column:
    """Written dates as timestamps, those with a zone in UTC. Only text of a layout's shape is parsed, as failed parses
    are slow."""
    trimmed = F.trim(text)
    zone = F.regexp_replace(F.regexp_extract(trimmed, ISO_TIME, 2), ":", "")
    minutes = F.when(
        F.length(zone) >= 3,
        F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int")
        * (F.substring(zone, 2, 2).cast("int") * 60 + F.coalesce(F.substring(zone, 4, 2).try_cast("int"), F.lit(0))),
    )
    local = F.regexp_replace(F.regexp_extract(trimmed, ISO_TIME, 1), ",", ".").try_cast("timestamp_ntz")
    iso = F.when(trimmed.rlike(ISO_TIME), local - F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0))))
    tries = [F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(layout))) for shape, layout in DATE_LAYOUTS]
    return F.coalesce(iso, *[t.cast("timestamp_ntz") for t in tries])


def parse_time(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that fits no layout gives null."""
    field = df.schema[name].dataType
    if isinstance(field, T.TimestampNTZType):
        return F.col(name)
    if isinstance(field, (T.TimestampType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return read_time(F.col(name).cast("string"))


def time_micros(name: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session's time zone."""
    return F.expr(
        f"unix_date(cast(`{name}` as date)) * 86400000000L"
        f" + (hour(`{name}`) * 3600L + minute(`{name}`) * 60L) * 1000000L"
        f" + cast(extract(SECOND FROM `{name}`) * 1000000 as bigint)"
    )


def with_time(df: DataFrame, ts: str) -> DataFrame:
    """Coerce ``ts`` and drop the rows whose time cannot be read."""
    return df.withColumn(ts, parse_time(df, ts)).where(F.col(ts).isNotNull())


def write_results(results: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One parquet folder per operator, laid out as a partition directory."""
    for operator, frame in results.items():
        frame.write.mode(mode).parquet(f"{path.rstrip('/')}/operator={operator}")
