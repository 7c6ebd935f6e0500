"""Queries over records and documents: identity, admission, cohorts, groups, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import plain_text, url_parts, windows, words
from quillstone.operators import duplicates, ordering, selection
from quillstone.operators import records as R
from quillstone.plans.registry import REC, SHINGLES, Registry, table

corpus = Registry()
query = corpus.query


def records(spark: SparkSession, d: str) -> DataFrame:
    r = R.with_defaults(table(spark, d, "filing_records"))
    return r.withColumn("family", R.family(F.col("src"), F.col("kind")))


def members(spark: SparkSession, d: str) -> DataFrame:
    """record_id and cohort, once each."""
    return table(spark, d, "cohort_membership").select("record_id", "cohort").distinct()


_FIRST = f"WITH {REC}, one AS (SELECT h, min(record_id) AS record_id FROM rec GROUP BY h)"


@query(f"{_FIRST} SELECT src AS source, count(*) AS n, sum(length(body))::BIGINT AS characters FROM rec JOIN one USING (record_id) WHERE lower(lang) = 'en' AND length(body) >= 100 GROUP BY src")
def admitted_by_source(spark, d):
    one = R.first_wins(records(spark, d).select("record_id", "body_sha256", "src", "lang", F.length("body").alias("n")), "body_sha256", ["record_id"])
    return one.where("lower(lang) = 'en' and n >= 100").groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("characters"))


@query("SELECT record_id, sha256(body) AS body_sha256, length(body)::BIGINT AS characters FROM filing_records")
def body_hash(spark, d):
    return table(spark, d, "filing_records").select("record_id", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("characters"))


@query(f"{_FIRST} SELECT record_id, h AS body_sha256 FROM one")
def exact_dedupe_first(spark, d):
    return R.first_wins(records(spark, d).select("record_id", "body_sha256"), "body_sha256", ["record_id"])


@query("SELECT document_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY retrieved_at DESC, record_id DESC) AS rn FROM filing_records) WHERE rn = 1")
def dedupe_last_wins(spark, d):
    return R.first_wins(table(spark, d, "filing_records").select("document_id", "record_id", "retrieved_at"), "document_id", ["retrieved_at", "record_id"], last=True).select("document_id", "record_id")


def _reason(r: DataFrame) -> DataFrame:
    first = r.groupBy("body_sha256").agg(F.min("record_id").alias("first"))
    return r.join(first, r["body_sha256"].eqNullSafe(first["body_sha256"])).select("record_id", R.first_reason(
        ("blank", F.col("body").isNull() | ~F.col("body").rlike(r"[^\s\x{00a0}\x{2028}]")), ("short", F.length("body") < 100), ("duplicate", F.col("record_id") != F.col("first")),
        ("language", F.lower("lang") != "en"), ("undated", ~F.col("filing_date").rlike(r"^\d{4}-\d{2}-\d{2}$")),
    ).alias("reason"))


_REASON = rf"""{_FIRST}, reasons AS (SELECT r.record_id, CASE WHEN body IS NULL OR NOT regexp_matches(body, '[^\s\x{{00a0}}\x{{2028}}]') THEN 'blank' WHEN length(body) < 100 THEN 'short'
 WHEN r.record_id <> one.record_id THEN 'duplicate' WHEN lower(lang) <> 'en' THEN 'language' WHEN NOT regexp_matches(filing_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'undated' ELSE 'accepted' END AS reason
 FROM rec r JOIN one ON r.h IS NOT DISTINCT FROM one.h)"""


@query(f"{_REASON} SELECT * FROM reasons")
def admission_reasons(spark, d):
    return _reason(records(spark, d))


@query(f"{_REASON} SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def reason_counts(spark, d):
    return _reason(records(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_EFFECTIVE = """SELECT record_id, CASE WHEN human.label IS NOT NULL THEN human.label ELSE llm.label END AS label, CASE WHEN human.label IS NOT NULL THEN human.uncertainty ELSE llm.uncertainty END AS uncertainty,
 CASE WHEN human.label IS NOT NULL THEN 'human' WHEN llm.label IS NOT NULL THEN 'teacher' ELSE 'none' END AS basis FROM filing_records"""


def effective(spark, d) -> DataFrame:
    e = R.effective(F.col("human"), F.col("llm"))
    basis = F.when(F.col("human.label").isNotNull(), "human").when(F.col("llm.label").isNotNull(), "teacher").otherwise("none")
    return table(spark, d, "filing_records").select("record_id", e["label"].alias("label"), e["uncertainty"].alias("uncertainty"), basis.alias("basis"))


@query(_EFFECTIVE)
def effective_annotation(spark, d):
    return effective(spark, d)


@query(f"SELECT cohort, count(*) AS n, count(*) FILTER (WHERE label IS NULL) AS pending FROM (SELECT DISTINCT record_id, cohort FROM cohort_membership) JOIN ({_EFFECTIVE}) USING (record_id) GROUP BY cohort")
def pending_labels(spark, d):
    return members(spark, d).join(effective(spark, d), "record_id").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("pending"))


@query(f"""SELECT record_id, CASE WHEN label IN ('routine', 'review_worthy') THEN label END AS label, CASE WHEN label IN ('routine', 'review_worthy') THEN uncertainty END AS uncertainty,
 CASE WHEN label IN ('routine', 'review_worthy') THEN 'retained' WHEN label IS NOT NULL THEN 'redecide' ELSE 'new' END AS basis FROM ({_EFFECTIVE})""")
def binary_input(spark, d):
    definite = F.col("label").isin(*R.LABELS)
    basis = F.when(definite, "retained").when(F.col("label").isNotNull(), "redecide").otherwise("new")
    return effective(spark, d).select("record_id", F.when(definite, F.col("label")).alias("label"), F.when(definite, F.col("uncertainty")).alias("uncertainty"), basis.alias("basis"))


@query(f"WITH {REC} SELECT record_id, family FROM rec")
def family_projection(spark, d):
    return records(spark, d).select("record_id", "family")


_PERIOD = "CASE WHEN filing_date <= '2026-03-31' THEN 'train' WHEN filing_date <= '2026-06-30' THEN 'validation' WHEN filing_date <= '2026-09-30' THEN 'test' ELSE 'outside' END"


@query(f"SELECT record_id, {_PERIOD} AS period FROM filing_records")
def temporal_cohorts(spark, d):
    return table(spark, d, "filing_records").select("record_id", R.period(F.col("filing_date")).alias("period"))


@query(f"""WITH {REC} SELECT cohort, count(*) AS n, min(filing_date) AS first_day, max(filing_date) AS last_day, count(DISTINCT h) AS bodies, count(DISTINCT event) AS events, count(DISTINCT src) AS sources,
 count(*) FILTER (WHERE coalesce(human.label, llm.label) = 'review_worthy') AS review_worthy, sum(length(body))::BIGINT AS characters FROM rec JOIN (SELECT DISTINCT record_id, cohort FROM cohort_membership) USING (record_id) GROUP BY cohort""")
def cohort_census(spark, d):
    r = records(spark, d).withColumn("label", F.coalesce("human.label", "llm.label")).join(members(spark, d), "record_id")
    return r.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.min("filing_date").alias("first_day"), F.max("filing_date").alias("last_day"), F.count_distinct("body_sha256").alias("bodies"), F.count_distinct("event").alias("events"),
                                   F.count_distinct("src").alias("sources"), F.count_if(F.col("label") == "review_worthy").alias("review_worthy"), F.sum(F.length("body")).alias("characters"))


@query("SELECT family, cohort, count(*) AS n FROM (SELECT DISTINCT record_id, cohort, family FROM cohort_membership) GROUP BY family, cohort")
def family_counts(spark, d):
    return table(spark, d, "cohort_membership").select("record_id", "cohort", "family").distinct().groupBy("family", "cohort").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REC} SELECT event, count(DISTINCT p) AS spans, min(p) AS first_span, max(p) AS last_span, count(*) AS rows FROM (SELECT event, {_PERIOD} AS p FROM rec WHERE event IS NOT NULL) GROUP BY event HAVING count(DISTINCT p) > 1")
def event_cross_boundary(spark, d):
    return R.crossing(records(spark, d).select("event", R.period(F.col("filing_date")).alias("p")), "event", "p")


@query(f"WITH {REC} SELECT h AS body_sha256, count(DISTINCT cohort) AS spans, min(cohort) AS first_span, max(cohort) AS last_span, count(*) AS rows FROM rec JOIN (SELECT DISTINCT record_id, cohort FROM cohort_membership) USING (record_id) WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT cohort) > 1")
def pairwise_disjoint(spark, d):
    return R.crossing(records(spark, d).select("record_id", "body_sha256").join(members(spark, d), "record_id"), "body_sha256", "cohort")


@query(f"""WITH {REC}, c AS (SELECT rec.*, cohort FROM rec JOIN (SELECT DISTINCT record_id, cohort FROM cohort_membership) USING (record_id))
 SELECT record_id, cohort FROM c WHERE cohort <> 'train' AND NOT coalesce(h IN (SELECT h FROM c WHERE cohort = 'train' AND h IS NOT NULL), false) AND NOT coalesce(event IN (SELECT event FROM c WHERE cohort = 'train' AND event IS NOT NULL), false)""")
def block_by_body_or_event(spark, d):
    c = records(spark, d).select("record_id", "body_sha256", "event").join(members(spark, d), "record_id")
    return R.blocked_by(c.where("cohort <> 'train'"), c.where("cohort = 'train'"), ["body_sha256", "event"]).select("record_id", "cohort")


@query("SELECT DISTINCT document_id, candidate_date FROM candidates WHERE document_id IN (SELECT document_id FROM filing_records)")
def seen_semi(spark, d):
    return table(spark, d, "candidates").select("document_id", "candidate_date").distinct().join(table(spark, d, "filing_records").select("document_id"), "document_id", "left_semi")


@query("SELECT DISTINCT document_id FROM candidates WHERE document_id NOT IN (SELECT document_id FROM filing_records WHERE document_id IS NOT NULL)")
def missing_anti(spark, d):
    return table(spark, d, "candidates").select("document_id").distinct().join(table(spark, d, "filing_records").select("document_id"), "document_id", "left_anti")


@query("SELECT document_id, count(DISTINCT candidate_date) AS distinct_values, min(candidate_date) AS least, max(candidate_date) AS greatest FROM candidates GROUP BY document_id HAVING count(DISTINCT candidate_date) > 1")
def date_conflicts(spark, d):
    return R.conflicts(table(spark, d, "candidates"), "document_id", "candidate_date")


@query(f"WITH {REC}, l AS (SELECT event, min(record_id) AS root FROM rec WHERE event IS NOT NULL GROUP BY event) SELECT record_id AS a, root AS b FROM rec JOIN l USING (event) WHERE record_id <> root")
def event_edges(spark, d):
    return R.edges_to_first(records(spark, d), "event", "record_id")


_CLEAN = r"regexp_extract(regexp_replace(lower({}), '[\s\x{{00a0}}]+', '', 'g'), '([0-9a-f]{{64}})$', 1)"


def _aliases(spark, d) -> DataFrame:
    clean = lambda c: F.regexp_extract(F.regexp_replace(F.lower(c), r"[\s\x{00a0}]+", ""), "([0-9a-f]{64})$", 1)
    return table(spark, d, "audit_membership_correction").select(clean("removed_body_sha256").alias("a"), clean("replacement_body_sha256").alias("b")).where("a <> '' and b <> '' and a <> b").distinct()


@query(f"SELECT DISTINCT {_CLEAN.format('removed_body_sha256')} AS a, {_CLEAN.format('replacement_body_sha256')} AS b FROM audit_membership_correction WHERE a <> '' AND b <> '' AND a <> b")
def alias_edges(spark, d):
    return _aliases(spark, d)


@query(rf"""WITH tok AS (SELECT record_id, regexp_extract_all(replace(lower(coalesce(body, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+') AS t FROM filing_records)
 SELECT record_id, len(t)::BIGINT AS words, len(list_distinct(CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END))::BIGINT AS runs FROM tok""")
def shingle_sizes(spark, d):
    from quillstone.operators.similarity import prefixes

    f = table(spark, d, "filing_records").select(F.col("record_id").alias("id"), F.coalesce("body", F.lit("")).alias("text"))
    sizes = prefixes(f, 0.9).members.select(F.col("id").alias("record_id"), F.col("size").cast("long").alias("runs"))
    return f.select(F.col("id").alias("record_id"), F.size(words(F.col("text"))).cast("long").alias("words")).join(sizes, "record_id")


_PAIRS = f"""WITH {SHINGLES}, inter AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.record_id < b.record_id GROUP BY 1, 2),
 pairs AS (SELECT a, b, c / (x.k + y.k - c) AS sim FROM inter JOIN n x ON x.record_id = a JOIN n y ON y.record_id = b WHERE c / (x.k + y.k - c) >= 0.9)"""


def _nonblank(spark, d) -> DataFrame:
    return table(spark, d, "filing_records").where(F.col("body").rlike(r"[^\s\x{00a0}\x{2028}]")).select(F.col("record_id").alias("id"), F.col("body").alias("text"))


@query(f"{_PAIRS} SELECT a, b, round(sim, 6) AS similarity FROM pairs WHERE a IN (SELECT rep FROM rep) AND b IN (SELECT rep FROM rep)")
def near_pairs(spark, d):
    pairs, _ = duplicates.near_pairs(_nonblank(spark, d))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""{_PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), m AS (SELECT DISTINCT record_id, cohort FROM cohort_membership)
 SELECT a AS id, min(b) AS match FROM both_ways JOIN m x ON x.record_id = a AND x.cohort <> 'train' JOIN m y ON y.record_id = b AND y.cohort = 'train' GROUP BY a""")
def near_exclude_base(spark, d):
    docs = _nonblank(spark, d).join(members(spark, d).withColumnRenamed("record_id", "id"), "id")
    return duplicates.near_matches(docs.where("cohort <> 'train'"), docs.where("cohort = 'train'"))


_GROUPS = f"""{_PAIRS.replace("WITH ", "WITH RECURSIVE " + REC + ", ", 1)}, al AS (SELECT DISTINCT {_CLEAN.format('removed_body_sha256')} AS x, {_CLEAN.format('replacement_body_sha256')} AS y FROM audit_membership_correction),
 e0 AS (SELECT a, b FROM pairs UNION SELECT x.record_id, y.record_id FROM rec x JOIN rec y ON x.h = y.h AND x.record_id < y.record_id UNION SELECT x.record_id, y.record_id FROM rec x JOIN rec y ON x.event = y.event AND x.record_id < y.record_id
  UNION SELECT x.record_id, y.record_id FROM al JOIN rec x ON x.h = al.x JOIN rec y ON y.h = al.y WHERE x.record_id <> y.record_id),
 e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), walk(id, r) AS (SELECT record_id, record_id FROM rec UNION SELECT e.b, walk.r FROM walk JOIN e ON e.a = walk.id),
 roots AS (SELECT id, min(r) AS root FROM walk GROUP BY id)"""


def _groups(spark, d) -> DataFrame:
    r = records(spark, d).select(F.col("record_id").alias("id"), F.when(F.col("body").rlike(r"[^\s\x{00a0}\x{2028}]"), F.col("body")).alias("text"), "body_sha256", "event")
    return duplicates.record_groups(r, _aliases(spark, d))


@query(f"{_GROUPS} SELECT id, root FROM roots")
def components(spark, d):
    return _groups(spark, d)


@query(f"""{_GROUPS}, c AS (SELECT root, h, count(*) AS n, max(coalesce(m.train, 0)) AS seen FROM roots JOIN rec ON rec.record_id = roots.id LEFT JOIN (SELECT record_id, max(CASE WHEN cohort = 'train' THEN 1 ELSE 0 END) AS train FROM cohort_membership GROUP BY 1) m ON m.record_id = id WHERE h IS NOT NULL GROUP BY root, h), o AS (SELECT *, (row_number() OVER (PARTITION BY root ORDER BY h) - 1) // 4096 AS k FROM c),
 p AS (SELECT root, k, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS d, sum(n) AS n, max(seen) AS seen FROM o GROUP BY root, k) SELECT root, sha256(string_agg(d, chr(10) ORDER BY k)) AS group_id, sum(n)::BIGINT AS members, max(seen) = 1 AS seen FROM p GROUP BY root""")
def group_id_seen(spark, d):
    train = members(spark, d).where("cohort = 'train'").select(F.col("record_id").alias("id"), F.lit(True).alias("seen"))
    r = records(spark, d).where("body_sha256 is not null").select(F.col("record_id").alias("id"), "body_sha256").join(_groups(spark, d), "id").join(train, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return duplicates.group_identity(r)


_BUCKET = f"WITH {REC}, b AS (SELECT record_id, h, family || '|' || substr(filing_date, 1, 7) AS bucket FROM rec), o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, record_id) AS rn FROM b), t AS (SELECT *, row_number() OVER (ORDER BY rn, bucket) AS ordinal FROM o)"


def _robin(spark, d) -> DataFrame:
    b = records(spark, d).select("record_id", "body_sha256", F.concat("family", F.lit("|"), F.substring("filing_date", 1, 7)).alias("bucket"))
    return ordering.round_robin(b, "bucket", ["body_sha256", "record_id"])


@query(f"{_BUCKET} SELECT record_id, bucket, rn, ordinal FROM t")
def round_robin_order(spark, d):
    return _robin(spark, d).select("record_id", "bucket", "rn", "ordinal")


@query("""WITH c AS (SELECT DISTINCT document_id, candidate_date FROM candidates), b AS (SELECT *, CASE WHEN candidate_date = '' THEN '' ELSE sha256(substr(candidate_date, 1, 7)) END AS bucket, sha256(document_id || candidate_date) AS k FROM c),
 o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k) AS rn FROM b) SELECT document_id, candidate_date, row_number() OVER (ORDER BY CASE WHEN bucket = '' THEN 1 ELSE 0 END, rn, bucket) AS ordinal FROM o""")
def balanced_months(spark, d):
    c = table(spark, d, "candidates").select("document_id", "candidate_date").distinct()
    b = c.withColumns({"bucket": F.when(F.col("candidate_date") == "", "").otherwise(F.sha2(F.substring("candidate_date", 1, 7), 256)), "k": F.sha2(F.concat("document_id", "candidate_date"), 256)})
    return ordering.round_robin(b, "bucket", ["k"], [F.when(F.col("bucket") == "", 1).otherwise(0)]).select("document_id", "candidate_date", "ordinal")


def _ordered_groups(spark, d) -> DataFrame:
    r = records(spark, d).select(F.coalesce("event", "body_sha256").alias("group_id"), "family", F.col("filing_date").alias("day")).where("group_id is not null")
    return selection.group_order(r, ahead="ecb")


@query(f"""WITH {REC}, g AS (SELECT coalesce(event, h) AS group_id, min(family) AS family, min(substr(filing_date, 1, 7)) AS month, count(*) AS size FROM rec WHERE coalesce(event, h) IS NOT NULL GROUP BY 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY family, month ORDER BY group_id) AS rn FROM g) SELECT group_id, family, month, size, row_number() OVER (ORDER BY CASE WHEN family = 'ecb' THEN 0 ELSE 1 END, rn, family || '|' || month) AS ordinal FROM o""")
def group_order(spark, d):
    return _ordered_groups(spark, d)


#: The sizes of nested subsets; all rows are the last one, and none is above their count.
ALL_SIZES = (4000, 16000)
_SIZES = "(SELECT v.size FROM (VALUES (4000), (16000)) v(size) WHERE v.size < (SELECT count(*) FROM t) UNION ALL SELECT count(*) FROM t) s"


@query(f"{_BUCKET} SELECT record_id, size FROM t JOIN {_SIZES} ON ordinal <= size")
def nested_subsets(spark, d):
    rows = table(spark, d, "filing_records").count()
    sizes = spark.createDataFrame([(n,) for n in (*(n for n in ALL_SIZES if n < rows), rows)], "size long")
    return _robin(spark, d).join(F.broadcast(sizes), F.col("ordinal") <= F.col("size")).select("record_id", "size")


def _composition(subsets: DataFrame, spark, d) -> DataFrame:
    r = records(spark, d).select("record_id", "src", F.length("body").alias("n"), F.coalesce("human.label", "llm.label").alias("label"))
    return subsets.join(r, "record_id").groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("characters"), F.count_distinct("src").alias("sources"), F.count_if(F.col("label") == "review_worthy").alias("review_worthy"))


@query(f"{_BUCKET} SELECT size, count(*) AS n, sum(length(body))::BIGINT AS characters, count(DISTINCT src) AS sources, count(*) FILTER (WHERE coalesce(human.label, llm.label) = 'review_worthy') AS review_worthy FROM t JOIN {_SIZES} ON ordinal <= size JOIN rec USING (record_id) GROUP BY size")
def subset_composition(spark, d):
    return _composition(nested_subsets(spark, d), spark, d)


@query(f"{_BUCKET}, s AS (SELECT record_id, size FROM t JOIN {_SIZES} ON ordinal <= size), k AS (SELECT DISTINCT size FROM s) SELECT a.size AS smaller, min(b.size) AS larger, 0::BIGINT AS missing FROM k a JOIN k b ON a.size < b.size GROUP BY a.size")
def nested_prefix_check(spark, d):
    """Of each subset, how many rows the next larger one lacks."""
    s = nested_subsets(spark, d)
    k = s.select("size").distinct()
    following = k.select(F.col("size").alias("smaller")).join(F.broadcast(k), F.col("smaller") < F.col("size")).groupBy("smaller").agg(F.min("size").alias("larger"))
    left = s.join(F.broadcast(following), F.col("size") == F.col("smaller")).select("record_id", "smaller", "larger")
    lacking = left.join(s, (left["record_id"] == s["record_id"]) & (left["larger"] == s["size"]), "left_anti").groupBy("smaller").agg(F.count(F.lit(1)).alias("n"))
    return following.join(lacking, "smaller", "left").select("smaller", "larger", F.coalesce("n", F.lit(0)).alias("missing"))


@query(f"""WITH {REC}, m AS (SELECT DISTINCT record_id, cohort FROM cohort_membership), o AS (SELECT cohort, h || ':' || coalesce(human.label, llm.label, '') AS t, row_number() OVER (PARTITION BY cohort ORDER BY h, record_id) AS rn FROM rec JOIN m USING (record_id) WHERE h IS NOT NULL),
 c AS (SELECT cohort, (rn - 1) // 4096 AS c, sha256(string_agg(t, chr(10) ORDER BY rn)) AS d, count(*) AS n FROM o GROUP BY 1, 2) SELECT cohort, sha256(string_agg(d, chr(10) ORDER BY c)) AS digest, sum(n)::BIGINT AS rows FROM c GROUP BY cohort""")
def identity_hash(spark, d):
    r = records(spark, d).where("body_sha256 is not null").select("record_id", "body_sha256", F.coalesce("human.label", "llm.label", F.lit("")).alias("label")).join(members(spark, d), "record_id")
    return ordering.ordered_digest(ordering.rank_in_bucket(r, "cohort", ["body_sha256", "record_id"]), "cohort", "rn", F.concat("body_sha256", F.lit(":"), "label"))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents) SELECT (ordinal - 1) // 20 AS chunk, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM o GROUP BY 1")
def chunk_positions(spark, d):
    o = ordering.with_ordinal(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return o.groupBy(ordering.chunk_of(F.col("ordinal"), 20).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query()
def whole_group_select(spark, d):
    g = _ordered_groups(spark, d)
    return selection.whole_groups(g, g.agg(F.sum("size")).first()[0] // 5)


@query()
def sequential_topup(spark, d):
    g = _ordered_groups(spark, d)
    n = g.agg(F.sum("size")).first()[0]
    return selection.allocate(g, {"selection": n // 10, "calibration": n // 20})


@query()
def replace_groups(spark, d):
    base = records(spark, d).select(F.coalesce("event", "body_sha256").alias("group_id"), "record_id", "src").where("group_id is not null")
    additions = base.where("src = 'fed'").withColumn("record_id", -F.col("record_id")).withColumn("group_id", F.concat(F.lit("new:"), "group_id"))
    pure = base.groupBy("group_id").agg(F.bool_and(F.col("src") == "sec").alias("sec"), F.count(F.lit(1)).alias("size")).where("sec").select("group_id", "size")
    return selection.replace_groups(base, ordering.with_ordinal(pure, ["group_id"]), additions)


@query(f"""WITH {REC}, b AS (SELECT coalesce(event, h) AS g, src FROM rec WHERE coalesce(event, h) IS NOT NULL), n AS (SELECT count(*) AS n FROM b)
 SELECT 'whole' AS part, n // 5 AS rows, 0::BIGINT AS split FROM n UNION ALL SELECT 'selection', n // 10, 0 FROM n UNION ALL SELECT 'calibration', n // 20, 0 FROM n UNION ALL SELECT 'replaced', n, 0 FROM n""")
def group_selection_totals(spark, d):
    """How many rows each choice of whole groups has, and how many groups it holds in part."""
    base = records(spark, d).select(F.coalesce("event", "body_sha256").alias("group_id")).where("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("whole"))
    parts = sequential_topup(spark, d).select("part", "group_id", "size").unionByName(whole_group_select(spark, d).select(F.lit("whole").alias("part"), "group_id", "size"))
    replaced = replace_groups(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).select(F.lit("replaced").alias("part"), "group_id", "size")
    kept = parts.unionByName(replaced).join(base, "group_id", "left")
    return kept.groupBy("part").agg(F.sum("size").alias("rows"), F.count_if((F.col("size") != F.col("whole")) & ~F.col("group_id").startswith("new:")).alias("split"))


@query(f"WITH {REC}, g AS (SELECT coalesce(event, h) AS group_id, src FROM rec WHERE coalesce(event, h) IS NOT NULL) SELECT group_id, count(*) AS size FROM g GROUP BY group_id HAVING bool_and(src = 'sec')")
def homogeneous_groups(spark, d):
    g = records(spark, d).select(F.coalesce("event", "body_sha256").alias("group_id"), "src").where("group_id is not null")
    return g.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.bool_and(F.col("src") == "sec").alias("pure")).where("pure").drop("pure")


@query("SELECT document_id, source, document_type, url, NULL::VARCHAR AS title FROM filing_records UNION ALL SELECT document_id, source, document_type, url, title FROM candidates")
def union_by_name(spark, d):
    columns = ["document_id", "source", "document_type", "url"]
    return table(spark, d, "filing_records").select(*columns).unionByName(table(spark, d, "candidates").select(*columns, "title"), allowMissingColumns=True)


@query("SELECT count(*) FILTER (WHERE f IS NOT NULL AND c IS NOT NULL) AS shared, count(*) FILTER (WHERE c IS NULL) AS only_records, count(*) FILTER (WHERE f IS NULL) AS only_candidates FROM (SELECT DISTINCT document_id, 1 AS f FROM filing_records) f FULL JOIN (SELECT DISTINCT document_id, 1 AS c FROM candidates) c ON f.document_id = c.document_id")
def set_overlap(spark, d):
    f = table(spark, d, "filing_records").select("document_id").distinct().withColumn("f", F.lit(1))
    c = table(spark, d, "candidates").select("document_id").distinct().withColumn("c", F.lit(1))
    j = f.join(c, "document_id", "full")
    return j.agg(F.count_if(F.col("f").isNotNull() & F.col("c").isNotNull()).alias("shared"), F.count_if(F.col("c").isNull()).alias("only_records"), F.count_if(F.col("f").isNull()).alias("only_candidates"))


_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style|nav|header|footer)\b.*?</(script|style|nav|header|footer)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""


@query(f"SELECT doc_id, md5({_PLAIN}) AS digest, length({_PLAIN})::BIGINT AS characters FROM documents")
def html_text(spark, d):
    t = plain_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("characters"))


@query(r"""SELECT record_id, nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '') AS scheme, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host,
 nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '/([0-9]{4}/[0-9]{2})/', 1), '') AS month FROM filing_records""")
def url_split(spark, d):
    return table(spark, d, "filing_records").select("record_id", url_parts(F.col("url")).alias("u")).select("record_id", "u.*")


@query(r"SELECT record_id, filing_date, replace(nullif(regexp_extract(url, '/([0-9]{4}/[0-9]{2})/', 1), ''), '/', '-') AS url_month, replace(nullif(regexp_extract(url, '/([0-9]{4}/[0-9]{2})/', 1), ''), '/', '-') = substr(filing_date, 1, 7) AS agrees FROM filing_records WHERE url IS NOT NULL")
def publication_check(spark, d):
    month = F.replace(url_parts(F.col("url"))["month"], F.lit("/"), F.lit("-"))
    return table(spark, d, "filing_records").where("url is not null").select("record_id", "filing_date", month.alias("url_month"), (month == F.substring("filing_date", 1, 7)).alias("agrees"))


@query("SELECT record_id, year(x)::BIGINT AS y, month(x)::BIGINT AS m, quarter(x)::BIGINT AS q, CAST(last_day(x) AS VARCHAR) AS month_end, CAST(CAST(date_trunc('month', x) AS DATE) AS VARCHAR) AS month_start, date_diff('day', DATE '2026-03-31', x) AS past_cutoff FROM (SELECT record_id, CAST(filing_date AS DATE) AS x FROM filing_records)")
def date_functions(spark, d):
    x = F.to_date("filing_date")
    return table(spark, d, "filing_records").select("record_id", F.year(x).cast("long").alias("y"), F.month(x).cast("long").alias("m"), F.quarter(x).cast("long").alias("q"), F.last_day(x).cast("string").alias("month_end"),
                                                    F.trunc(x, "month").cast("string").alias("month_start"), F.datediff(x, F.lit("2026-03-31")).cast("long").alias("past_cutoff"))


@query("SELECT record_id, (epoch_us(retrieved_at) // 86400000000 - date_diff('day', DATE '1970-01-01', CAST(filing_date AS DATE)))::BIGINT AS days FROM filing_records WHERE epoch_us(retrieved_at) // 86400000000 > date_diff('day', DATE '1970-01-01', CAST(filing_date AS DATE))")
def revision_lag(spark, d):
    late = F.floor(F.unix_micros("retrieved_at") / F.lit(86_400_000_000)).cast("long") - F.unix_date(F.to_date("filing_date"))
    return table(spark, d, "filing_records").select("record_id", late.alias("days")).where("days > 0")


@query("SELECT k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events) GROUP BY k")
def json_props(spark, d):
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT record_id, coalesce(provenance['status'], 'none') AS status, coalesce(provenance['content_type'], 'text/plain') AS content_type, provenance['raw_sha256'] AS raw_sha256 FROM filing_records")
def map_merge_default(spark, d):
    p = F.col("provenance")
    merged = F.map_from_entries(F.array_union(F.map_entries(F.map_filter(F.create_map(F.lit("status"), F.lit("none"), F.lit("content_type"), F.lit("text/plain")), lambda k, v: ~F.coalesce(F.map_contains_key(p, k), F.lit(False)))), F.coalesce(F.map_entries(p), F.array().cast("array<struct<key:string,value:string>>"))))
    m = lambda k: F.try_element_at(merged, F.lit(k))
    return table(spark, d, "filing_records").select("record_id", m("status").alias("status"), m("content_type").alias("content_type"), m("raw_sha256").alias("raw_sha256"))


def _windowed(size: int, stride: int) -> str:
    return rf"""WITH tok AS (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+') AS t FROM documents),
 w AS (SELECT doc_id, t, unnest(range(0, greatest(0, CAST(ceil((len(t) - {size}) / {stride}.0) AS BIGINT)) + 1)) AS i FROM tok) SELECT doc_id, i AS window_no, len(t[i*{stride}+1:i*{stride}+{size}])::BIGINT AS words, md5(array_to_string(t[i*{stride}+1:i*{stride}+{size}], ' ')) AS digest FROM w"""


def _windows(spark, d, size: int, stride: int) -> DataFrame:
    held = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("t"))
    each = held.select("doc_id", F.posexplode_outer(windows(F.col("t"), size, stride)).alias("i", "w"))
    return each.select("doc_id", F.col("i").cast("long").alias("window_no"), F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(_windowed(64, 64))
def token_windows(spark, d):
    return _windows(spark, d, 64, 64)


@query(_windowed(64, 32))
def half_overlap_windows(spark, d):
    return _windows(spark, d, 64, 32)


@query("SELECT round(avg(CASE WHEN human.label = llm.label THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n, count(*) FILTER (WHERE human.label = 'routine' AND llm.label = 'routine') AS rr, count(*) FILTER (WHERE human.label = 'routine' AND llm.label = 'review_worthy') AS rw, count(*) FILTER (WHERE human.label = 'review_worthy' AND llm.label = 'routine') AS wr, count(*) FILTER (WHERE human.label = 'review_worthy' AND llm.label = 'review_worthy') AS ww FROM filing_records WHERE human.label IS NOT NULL AND llm.label IS NOT NULL")
def consistency_audit(spark, d):
    h, m = F.col("human.label"), F.col("llm.label")
    cell = lambda a, b: F.count_if((h == a) & (m == b))
    return table(spark, d, "filing_records").where(h.isNotNull() & m.isNotNull()).agg(F.round(F.avg((h == m).cast("double")), 6).alias("agreement"), F.count(F.lit(1)).alias("n"), cell("routine", "routine").alias("rr"), cell("routine", "review_worthy").alias("rw"), cell("review_worthy", "routine").alias("wr"), cell("review_worthy", "review_worthy").alias("ww"))


@query("SELECT (SELECT count(*) FROM (SELECT document_id FROM filing_records EXCEPT SELECT document_id FROM candidates)) AS missing, (SELECT count(*) FROM (SELECT document_id FROM candidates EXCEPT SELECT document_id FROM filing_records)) AS extra")
def set_equality(spark, d):
    f, c = (table(spark, d, t).select("document_id") for t in ("filing_records", "candidates"))
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return n(f.subtract(c), "missing").crossJoin(n(c.subtract(f), "extra"))


@query("SELECT record_id, row_number() OVER (ORDER BY sha256('42:' || record_id), record_id) AS ordinal FROM filing_records")
def hash_shuffle(spark, d):
    k = table(spark, d, "filing_records").select("record_id", F.sha2(F.concat(F.lit("42:"), F.col("record_id").cast("string")), 256).alias("k"))
    return ordering.with_ordinal(k, ["k", "record_id"]).drop("k")


@query(f"""WITH {REC}, m AS (SELECT record_id, body_sha256 AS stored FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY body_sha256 NULLS LAST) AS rn FROM cohort_membership) WHERE rn = 1)
 SELECT record_id, CASE WHEN stored IS NULL THEN 'absent' WHEN stored = h THEN 'equal' ELSE 'other' END AS identity FROM m JOIN rec USING (record_id) WHERE stored IS NULL OR stored <> h""")
def manifest_mismatch(spark, d):
    m = table(spark, d, "cohort_membership").groupBy("record_id").agg(F.min("body_sha256").alias("stored"))
    j = m.join(records(spark, d).select("record_id", "body_sha256"), "record_id")
    state = F.when(F.col("stored").isNull(), "absent").when(F.col("stored") == F.col("body_sha256"), "equal").otherwise("other")
    return j.select("record_id", state.alias("identity")).where("identity <> 'equal'")


@query(r"""SELECT record_id, CASE WHEN url IS NULL THEN 'absent' WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN NOT regexp_matches(url, '^https?://[^/]+\.[a-z]+/') THEN 'host'
 WHEN regexp_matches(url, '/archives/') AND NOT regexp_matches(url, '/archives/[0-9]+/[0-9]+/[^/]+$') THEN 'archive path' ELSE 'ok' END AS state FROM filing_records""")
def link_validation(spark, d):
    u = F.col("url")
    state = R.first_reason(("absent", u.isNull()), ("scheme", ~u.rlike("^https?://")), ("host", ~u.rlike(r"^https?://[^/]+\.[a-z]+/")), ("archive path", u.rlike("/archives/") & ~u.rlike("/archives/[0-9]+/[0-9]+/[^/]+$")), default="ok")
    return table(spark, d, "filing_records").select("record_id", state.alias("state"))


@query(f"""WITH {REC}, k AS (SELECT record_id, 0 AS p, document_id AS k FROM rec UNION ALL SELECT record_id, 1, url FROM rec UNION ALL SELECT record_id, 2, event_id FROM rec), c AS (SELECT DISTINCT 0 AS p, document_id AS k FROM candidates UNION ALL SELECT DISTINCT 1, url FROM candidates UNION ALL SELECT DISTINCT 2, event_id FROM candidates WHERE contains(event_id, ':'))
 SELECT record_id, min(p) AS method FROM k JOIN c USING (p, k) GROUP BY record_id""")
def fallback_match(spark, d):
    """The first of three identities under which a record is known among the candidates."""
    f, c = table(spark, d, "filing_records"), table(spark, d, "candidates")
    keys = ["document_id", "url", "event_id"]
    tagged = lambda t, *rest: t.select(*rest, F.posexplode(F.array(*keys)).alias("p", "k")).where("k is not null and (p < 2 or contains(k, ':'))")
    return tagged(f, "record_id").join(tagged(c).distinct(), ["p", "k"], "left_semi").groupBy("record_id").agg(F.min("p").alias("method"))


@query(f"WITH {REC} SELECT issuer_id, count(*) AS n, count(DISTINCT event) AS events, min(filing_date) AS first_day, max(filing_date) AS last_day FROM (SELECT *, ltrim(issuer, '0') AS issuer_id FROM rec WHERE issuer IS NOT NULL) GROUP BY issuer_id")
def issuer_census(spark, d):
    r = records(spark, d).where("issuer is not null").withColumn("issuer_id", F.ltrim("issuer", F.lit("0")))
    return r.groupBy("issuer_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event").alias("events"), F.min("filing_date").alias("first_day"), F.max("filing_date").alias("last_day"))


@query("SELECT coalesce(lower(trim(source)), 'sec') AS source, count(*) AS n, count(*) FILTER (WHERE n_chars IS NULL) AS unknown, count(*) FILTER (WHERE n_chars <> length(text)) AS stale, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank FROM documents GROUP BY 1")
def document_census(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("sec")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars").isNull()).alias("unknown"), F.count_if(F.col("n_chars") != F.length("text")).alias("stale"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"))


@query()
def stream_dedupe_ingest(spark, d):
    import uuid

    from quillstone.staging import staging_root
    from quillstone.streaming.ingest import ingest

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    ingest(spark, f"{root}/in", rows.schema, f"{root}/out", f"{root}/checkpoint", "event_id", "ts").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")
