"""Filing indexes: text tables with a row per filing, its fields between bars, below a heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def index_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """(issuer, company, form, day, path, accession) of the lines ``issuer|company|form|day|path``; headings and rules have no such fields and go."""
    part = F.split(line, r"\|")
    at = lambda i: F.trim(F.get(part, F.lit(i)))
    rows = lines.where((F.size(part) == 5) & F.trim(F.get(part, F.lit(0))).rlike("^[0-9]+$") & at(3).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return rows.select(F.ltrim(at(0), F.lit("0")).alias("issuer"), at(1).alias("company"), at(2).alias("form"), at(3).alias("day"), at(4).alias("path"), F.regexp_extract(at(4), r"(\d{10}-\d{2}-\d{6})", 1).alias("accession"))


def filings(rows: DataFrame, form: str, first: str, last: str) -> DataFrame:
    """Candidates of one form, amendments (a form with ``/A``) left out, with a day from ``first`` to ``last``."""
    kept = rows.where((F.col("form") == form) & F.col("day").between(first, last))
    identity: Column = F.concat(F.lit("sec:"), F.col("accession"))
    return kept.select(identity.alias("document_id"), identity.alias("event_id"), F.col("day").alias("candidate_date"), F.lit("sec").alias("source"), F.lit(form).alias("document_type"), "issuer", "company", "accession")


def read_index(spark: SparkSession, path: str, form: str, first: str, last: str) -> DataFrame:
    """``filings`` of index files, read as text."""
    return filings(index_rows(spark.read.text(path)), form, first, last)
