"""Reports, reviews and events as files."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.plans.lineage import written
from framehouse.sources import shared_files


def write_report(plan: DataFrame, path: str) -> None:
    """CSV of source, destination, hash and status, every field quoted, in the order of the plan."""
    rows = plan.orderBy("is_duplicate", "bucket", "ordinal").select(F.col("source").alias("Source"), F.col("dest").alias("Destination"), F.col("identity").alias("Hash"), F.lit("PENDING").alias("Status"))
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_report_file(plan: DataFrame, folder: str, name: str) -> int:
    """The same report as one file, which gets its name when it is whole; the number of rows.

    Rows come through the driver a partition at a time, already in order, and go on to the file: no more is held.
    """
    columns = [F.col("source").alias("Source"), F.col("dest").alias("Destination"), F.col("identity").alias("Hash"), F.lit("PENDING").alias("Status")]
    ordered = written(plan.orderBy("is_duplicate", "bucket", "ordinal").select(*columns, F.monotonically_increasing_id().alias("__n")), "report").orderBy("__n").drop("__n")

    def lines():
        yield ordered.columns
        yield from ordered.toLocalIterator()

    n = -1
    with shared_files.whole_file(folder, name) as out:
        for row in lines():
            text = io.StringIO()
            csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(["" if v is None else v for v in row])
            out.write(text.getvalue().encode())
            n += 1
    return n


def write_review(items: DataFrame, path: str) -> None:
    items.orderBy("ordinal").write.mode("overwrite").json(path)


def event_lines(events: DataFrame, version: int = 1) -> DataFrame:
    """value: one JSON object of each row, keys in order and without nulls, for any text sink."""
    columns = sorted([*events.columns, "event_version"])
    return events.withColumn("event_version", F.lit(version)).select(F.to_json(F.struct(*columns)).alias("value"))
