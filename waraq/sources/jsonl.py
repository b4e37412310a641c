"""JSON Lines and JSON documents: reading, scanning, appending."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waraq.shared import children, publish, read_text, remove

PAGE = ("book_id int, url_page_id int, sub_idx int, page_id int, page_num int, paragraphs array<struct<type:string,lines:array<string>>>, text string")


def read_jsonl(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """Rows of a JSON Lines file or folder; blank lines are skipped, unreadable ones dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad IS NULL").drop("_bad")


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(max_page_id, n_lines): the greatest page number, and the lines that aren't blank, unreadable ones included."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", "url_page_id int, page_id int")
    return lines.agg(F.max(F.coalesce(row["url_page_id"], row["page_id"])).alias("max_page_id"), F.count("*").alias("n_lines"))


def read_json(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """One JSON document per file; ``default`` where no file or nothing readable is there.  Other failures are not hidden."""
    try:
        df = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if default is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default
    df = df.where("_bad IS NULL").drop("_bad")
    return df if default is None or df.take(1) else default


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON Lines part files; a failed write leaves none."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replace the JSON Lines of ``path``, to be read with ``read_current``: readers see the old rows or the new ones, whole, and a failed job changes nothing.

    Rows are written aside below ``path`` and become current with the creation of a commit file; the last two writes are kept, so that readers may end.
    """
    spark = df.sparkSession
    draft = uuid.uuid4().hex
    df.write.json(f"{path}/data/{draft}")
    number = _last(spark, path) + 1
    while not publish(spark, f"{path}/commits/{number}", draft):
        number += 1
    for n in range(number - 2, 0, -1):
        old = read_text(spark, f"{path}/commits/{n}")
        if old is None or not children(spark, f"{path}/data/{old}"):
            break
        remove(spark, f"{path}/data/{old}")


def _last(spark: SparkSession, path: str) -> int:
    return max((int(n) for n in children(spark, f"{path}/commits") if n.isdigit()), default=0)


def read_current(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """Rows of the last ``write_json`` to ``path``."""
    draft = read_text(spark, f"{path}/commits/{_last(spark, path)}")
    if draft is None:
        raise FileNotFoundError(path)
    return read_jsonl(spark, f"{path}/data/{draft}", schema)
