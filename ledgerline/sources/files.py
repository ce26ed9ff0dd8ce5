"""Landed input files: tracker CSV export, forecast batches, profile maps.

All readers use explicit schemas; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas

TRACKER_DATE_FORMAT = "M/d/yyyy"


#: Column of the text of a row that the CSV parser cannot place.
BROKEN_ROW = "_corrupt_record"
#: How the tracker's export is read, by batch jobs and streams alike: a quoted comment may hold line breaks
#: and doubled quotes; a row with too many or too few cells is kept as its text, its cells are not trusted.
TIME_ENTRY_CSV_READ = StructType(schemas.TIME_ENTRY_CSV.fields + [StructField(BROKEN_ROW, StringType())])
TIME_ENTRY_CSV_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "multiLine": "true", "escape": '"',
                          "columnNameOfCorruptRecord": BROKEN_ROW}


def read_time_entry_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tracker time-entry export (header row, ``M/d/yyyy`` dates): the entries,
    and the rows to quarantine.

    A file is one task, because only a reader from its start can tell a line
    break in a comment from the end of a row: land exports in files of up to
    some hundred megabytes."""
    raw = spark.read.schema(TIME_ENTRY_CSV_READ).options(**TIME_ENTRY_CSV_OPTIONS).csv(path)
    return parse_time_entries(raw), bad_time_entries(raw)


def entry_violations(raw: DataFrame) -> Column:
    """Comma-joined codes of a raw export row, ``''`` for a good one.

    A row must have the header's cells, a date must be there and parse; hours
    may be missing (they count as 0) but not be something else than a number."""
    hours = F.col("Hours").cast("string")
    whole = F.col(BROKEN_ROW).isNull() if BROKEN_ROW in raw.columns else F.lit(True)
    return F.when(~whole, "row_broken").otherwise(F.concat_ws(
        ",", F.when(F.try_to_date(F.col("Date"), TRACKER_DATE_FORMAT).isNull(), F.lit("date_invalid")),
        F.when((F.trim(hours) != "") & hours.try_cast("double").isNull(), F.lit("hours_invalid"))))


def parse_time_entries(raw: DataFrame) -> DataFrame:
    """Drop Activity / Issue / Comment, parse date and hours, rename to the
    model.  Rows that do not parse are left to :func:`bad_time_entries`."""
    return raw.filter(entry_violations(raw) == "").select(
        F.try_to_date(F.col("Date"), TRACKER_DATE_FORMAT).alias("date"),
        F.col("Project").alias("project"),
        F.col("User").alias("employee"),
        F.col("Hours").cast("string").try_cast("double").alias("hours"),
    )


def bad_time_entries(raw: DataFrame) -> DataFrame:
    """The rows that do not parse, as they came (a broken one as its text), with their ``violations``."""
    return raw.withColumn("violations", entry_violations(raw)).filter(F.col("violations") != "")


def tracker_date_text(date_col: Column) -> Column:
    """Inverse of the parser: the tracker's ``M/d/yyyy`` text."""
    return F.date_format(date_col, TRACKER_DATE_FORMAT)


def read_plan_batch(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Forecast batch with a ``seq`` column giving the file order."""
    reader = spark.read.schema(schemas.PLAN_BATCH)
    if fmt == "csv":
        reader = reader.option("header", True)
    return blank_text_to_empty(reader.format(fmt).load(path))


def read_cost_batch(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Cost batch with a ``seq`` column; numbers that do not parse become null
    and are rejected by the validation."""
    reader = spark.read.schema(schemas.COST_BATCH)
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = reader.format(fmt).load(path)
    number = lambda c: F.trim(F.col(c)).try_cast("int").alias(c)
    return blank_text_to_empty(raw).select("seq", "concept", "project", "remarks", number("month"), number("year"), number("cost"))


def blank_text_to_empty(batch: DataFrame) -> DataFrame:
    """Empty cells of text columns become ``''`` (numbers stay null)."""
    text_cols = [f.name for f in batch.schema.fields if f.dataType.simpleString() == "string"]
    return batch.fillna("", subset=text_cols)


def read_profile_map(spark: SparkSession, path: str) -> DataFrame:
    """(employee, profile) of JSON objects ``{"employee": "profile", ...}``: one
    or more whole objects per file, each on one line or indented with one entry
    per line.  Lines are parsed on their own, so a large map is read in parallel."""
    return parse_profile_json(spark.read.text(path))


def parse_profile_json(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Entries of lines of a profile map; a line that is neither an object, a
    brace nor entries of one fails the job rather than losing its entries."""
    line = F.regexp_replace(F.trim(F.regexp_replace(F.col(text_col), r"[\r\t]", " ")), r"^, *|,$", "")
    inner = F.trim(F.regexp_replace(F.regexp_replace(line, r"^\{", ""), r"\}$", ""))
    entries = F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), "map<string,string>")
    checked = F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(F.coalesce(
        entries, F.raise_error(F.concat(F.lit("not an entry of a profile map: "), F.col(text_col))).cast("map<string,string>")))
    return lines.select(checked.alias("m")).select(F.explode("m").alias("employee", "profile"))
