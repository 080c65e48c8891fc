"""Sinks: raw captures that are never overwritten, sorted JSON lines, and the two files of a blind sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns a labeller gets; those not in the sample are written empty.
BLIND = ["review_id_hash", "product_title", "review_title", "review_text", "human_label", "wearer_gender_mismatch", "calibration_stated"]


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write to a new path; an existing one is an error."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_json_lines(df: DataFrame, path: str, order: str) -> None:
    """JSON lines sorted by a column, over as many files as the sort makes."""
    df.orderBy(order).write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that readers.csv_by_key reads back as it was: quotes doubled, white space kept."""
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("errorifexists").options(**kept).csv(path)


def write_blind_sample(sample: DataFrame, path: str) -> None:
    """`path`_key with every column of the sample and `path`_blind with the labeller's columns, both in hashed order."""
    order = F.md5(F.col("review_id_hash"))
    blind = sample.select(*[F.col(c) if c in sample.columns else F.lit("").alias(c) for c in BLIND])
    for df, name in ((sample, "key"), (blind, "blind")):
        write_csv(df.orderBy(order, "review_id_hash"), f"{path}_{name}")


def write_clusters(sizes: DataFrame, path: str) -> None:
    """Cluster sizes (scenario, cluster_id, n) as JSON lines; an existing path is an error."""
    sizes.select("scenario", "cluster_id", "n").write.mode("errorifexists").json(path)
