"""Collecting queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The filing records with src, kind, event, family and h (the body's hash), as SQL.
REC = r"""rec AS (SELECT *, CASE WHEN src = 'sec' THEN CASE kind WHEN '8-k' THEN '8k' WHEN '6-k' THEN '6k' WHEN 'corporate_release' THEN 'releases' ELSE 'other' END
  WHEN kind = 'news' THEN 'news' ELSE src END AS family
 FROM (SELECT *, coalesce(lower(trim(source)), 'sec') AS src, coalesce(lower(trim(document_type)), '8-k') AS kind, sha256(body) AS h,
  CASE WHEN contains(e, ':') AND e <> 'sec:unknown' THEN e END AS event
 FROM (SELECT *, lower(regexp_replace(event_id, '[\s-]+', '', 'g')) AS e FROM filing_records)))"""
#: The word runs of filing bodies that aren't blank: sh(record_id, s), n(record_id, k), and rep(record_id, rep) of equal sets.
SHINGLES = r"""tok AS (SELECT record_id, regexp_extract_all(replace(lower(body), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS t FROM filing_records WHERE regexp_matches(body, '[^\s\x{00a0}\x{2028}]')),
 runs AS (SELECT record_id, list_distinct(CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END) AS s FROM tok),
 rep AS (SELECT record_id, min(record_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), '|'))) AS rep FROM runs),
 sh AS (SELECT record_id, unnest(s) AS s FROM runs), n AS (SELECT record_id, len(s) AS k FROM runs)"""
