"""Records: readers, writers, and the adapter over the document table."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def source_of():
    """The source of a document's record."""
    n = F.substring("source", 4, 9).cast("int")
    return F.when(n < 7, "S1").when(n < 14, "S2").otherwise("S3")


def entity_of():
    """The id of a document's record."""
    return F.concat(source_of(), F.lit("-"), F.col("doc_id").cast("string"))


def from_documents(docs: DataFrame) -> DataFrame:
    """(entity_id, source, business_name, business_address, country, seq) of documents."""
    name = F.regexp_extract("text", r"^[^.\n]{1,80}", 0)
    rest = F.substr("text", F.length(name) + 1, F.lit(120))
    return docs.select(entity_of().alias("entity_id"), source_of().alias("source"), name.alias("business_name"), rest.alias("business_address"), F.col("lang").alias("country"), F.col("doc_id").alias("seq"))


def read_tsv(spark: SparkSession, path: str, country: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Raw tab-separated records with a header in any order: quotes are text, rows of fewer cells are dropped, cells are trimmed."""
    lines = spark.read.text(path)
    header = [x.strip() for x in (lines.first() or [""])[0].split("\t")]
    at = [header.index(name) for name in COLUMNS]
    cells = lines.select(F.split("value", "\t").alias("c")).where((F.size("c") >= len(header)) & (F.trim(F.get("c", F.lit(at[0]))) != COLUMNS[0]))
    out = cells.select(*[F.trim(F.get("c", F.lit(i))).alias(name) for i, name in zip(at, COLUMNS, strict=True)])
    out = out.where(F.lower("country") == country.lower()) if country else out
    return out.limit(max_rows) if max_rows is not None else out


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, matches): comma lists, trimmed, without blanks or repeats."""
    cells = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    s1, ids = cells.columns[:2]
    return cells.select(F.col(s1).alias("s1_id"), split_ids(F.col(ids)).alias("matches"))


def split_ids(c):
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.trim), lambda x: x != ""))


def slice_of(records: DataFrame, start: int, count: int) -> DataFrame:
    return records.where(F.col("seq").between(start, start + count - 1))


def only(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Semi-join scan by entity_id."""
    return records.join(ids.select("entity_id"), "entity_id", "left_semi")


def write_lists(lists: DataFrame, path: str, header: bool = True, by_country: bool = False) -> None:
    """(s1_id, ids array) as tab-separated lists, blank if empty."""
    out = lists.select("s1_id", F.concat_ws(",", "ids").alias("ids"), *(["country"] if by_country else []))
    writer = out.write.option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "")
    (writer.partitionBy("country") if by_country else writer).csv(path)


def write_submission(lists: DataFrame, path: str) -> None:
    """(s1_id, seq, ids) as tab-separated lists in input order, blank if empty: the files' names keep the order."""
    lines = lists.orderBy("seq", "s1_id").select(F.concat_ws("\t", "s1_id", F.concat_ws(",", "ids")).alias("value"))
    lines.write.text(path)


def empty_submission(records: DataFrame) -> DataFrame:
    """(s1_id, seq, ids): every S1 record without a match."""
    return records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "seq", F.array().cast("array<string>").alias("ids"))


def extract(records: DataFrame, ids: DataFrame, path: str) -> None:
    """Writes the records of some ids as tab-separated text with a header."""
    only(records, ids).select(*COLUMNS).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


VERDICTS = "source1_id string, candidate_id string, is_match boolean, confidence double, rationale string"


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, line, cand_id, is_match, confidence) of a JSON array, or of JSON lines, packed by gzip or not; line: the place in the file.

    What a verdict lacks is false and 0.5.
    """
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{VERDICTS.replace(' ', ':').replace(',:', ',')}>>")).alias("line", "v"))
    else:
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.from_json("value", VERDICTS).alias("v"))
    v = F.col("v")
    return rows.select(v["source1_id"].alias("s1_id"), F.col("line").cast("long").alias("line"), v["candidate_id"].alias("cand_id"), F.coalesce(v["is_match"], F.lit(False)).alias("is_match"), F.coalesce(v["confidence"], F.lit(0.5)).alias("confidence"))


def repack(spark: SparkSession, csv: str, out: str, required: list[str]) -> None:
    """CSV to Parquet; a missing column is an error."""
    spark.read.option("header", True).csv(csv).select(*required).write.option("compression", "snappy").parquet(out)


def write_zip(lists: dict[str, DataFrame], path: str) -> None:
    """Packs (s1_id, seq, ids) tables as tab-separated members of one ZIP file of the driver, in input order; a partition is held at a time."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in lists.items():
            lines = df.orderBy("seq", "s1_id").select(F.concat_ws("\t", "s1_id", F.concat_ws(",", "ids")).alias("line"))
            with z.open(name, "w", force_zip64=True) as out:
                for row in lines.toLocalIterator():
                    out.write(row.line.encode() + b"\n")
