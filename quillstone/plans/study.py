"""Queries over predicates, order, calibration, pooling, ledgers and re-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.functions.packed import pack_floats, unpack_floats
from quillstone.operators import compare, features, metrics, minhash, ordering, policies
from quillstone.operators import records as R
from quillstone.plans.corpus import records
from quillstone.plans.evaluation import _CELLS, _F1, _POINTS, PRED, _labels, predictions, r6
from quillstone.plans.registry import REC, Registry, table
from quillstone.sources.index import filings, index_rows
from quillstone.staging import stage

study = Registry()
query = study.query

# Patterns of texts that are looked at before they are taken in.
_RIGHTS = r"copyright|third[- ]party content|all rights reserved"
_AGENCY = r"\b(Reuters|Associated Press|Agence France|AFP|AP)\b"
_REPORT = r"management.{0,5}s?\s+discussion\s+and\s+analysis|(unaudited\s+)?consolidated\s+financial\s+statements"
_BYLINE = r"^\s*(by|prepared by)\s+"
_RELEASE = r"release|earnings|results|announcement"


@query(rf"""SELECT record_id, coalesce(length(body) < 100, true) AS short, coalesce(starts_with(body, '%PDF'), false) AS pdf, coalesce(regexp_matches(body, '(?i){_RIGHTS}'), false) AS rights, coalesce(regexp_matches(body, '{_AGENCY}'), false) AS agency,
 coalesce(regexp_matches(substr(body, 1, 300), '(?is){_REPORT}'), false) AS report, coalesce(regexp_matches(body, '(?i){_BYLINE}'), false) AS byline FROM filing_records""")
def text_predicates(spark, d):
    """What a body looks like: short, a file of another kind, marked with rights, of an agency, a financial report, with a byline."""
    b = F.col("body")
    flag = lambda c, name: F.coalesce(c, F.lit(name == "short")).alias(name)
    return table(spark, d, "filing_records").select(
        "record_id", flag(F.length(b) < 100, "short"), flag(b.startswith("%PDF"), "pdf"), flag(b.rlike(f"(?i){_RIGHTS}"), "rights"), flag(b.rlike(_AGENCY), "agency"),
        flag(F.substring(b, 1, 300).rlike(f"(?is){_REPORT}"), "report"), flag(b.rlike(f"(?i){_BYLINE}"), "byline"),
    )


@query(rf"SELECT document_type, regexp_matches(coalesce(title, ''), '(?i){_RELEASE}') AS described, regexp_matches(coalesce(url, ''), '(?i)ex-?99') AS exhibit, count(*) AS n FROM candidates GROUP BY ALL")
def attachment_predicate(spark, d):
    """Candidates whose file is an exhibit of that number, and whose description names a release."""
    c = table(spark, d, "candidates")
    described, exhibit = F.coalesce("title", F.lit("")).rlike(f"(?i){_RELEASE}"), F.coalesce("url", F.lit("")).rlike("(?i)ex-?99")
    return c.groupBy("document_type", described.alias("described"), exhibit.alias("exhibit")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT 'sec:' || accession AS document_id, candidate_date, issuer_id AS issuer, count(*) AS n FROM (SELECT *, ltrim(trim(issuer), '0') AS issuer_id, regexp_extract(accession, '[0-9]{{10}}-[0-9]{{2}}-[0-9]{{6}}') AS a FROM candidates)
 WHERE regexp_matches(trim(issuer), '^[0-9]+$') AND accession IS NOT NULL AND a = accession AND document_type = '8-K' AND candidate_date BETWEEN '2025-01-01' AND '2026-12-31' AND NOT contains(coalesce(title, ''), '|') GROUP BY ALL""")
def index_candidates(spark, d):
    """Candidates out of the lines of a filing index."""
    c = table(spark, d, "candidates").where("issuer is not null and accession is not null and not contains(coalesce(title, ''), '|')")
    lines = c.select(F.concat_ws("|", "issuer", F.coalesce("title", F.lit("")), "document_type", "candidate_date", F.concat(F.lit("filings/"), "accession", F.lit(".txt"))).alias("value"))
    found = filings(index_rows(lines), "8-K", "2025-01-01", "2026-12-31").where("accession <> ''")
    return found.groupBy("document_id", "candidate_date", "issuer").agg(F.count(F.lit(1)).alias("n"))


_LINK = r"https?://[A-Za-z0-9.-]+/[A-Za-z0-9/_.-]*"


@query(rf"WITH l AS (SELECT record_id, unnest(regexp_extract_all(body, '{_LINK}')) AS link FROM filing_records WHERE body IS NOT NULL UNION ALL SELECT record_id, url FROM filing_records WHERE url IS NOT NULL) SELECT link, nullif(regexp_extract(link, '/([0-9]{{4}}/[0-9]{{2}})/', 1), '') AS month, count(*) AS n FROM l GROUP BY ALL")
def link_index(spark, d):
    """Every link of the texts and pages, with the month that its path names."""
    f = table(spark, d, "filing_records")
    links = f.where("body is not null").select(F.explode(F.regexp_extract_all("body", F.lit(f"({_LINK})"))).alias("link")).union(f.where("url is not null").select("url"))
    month = F.nullif(F.regexp_extract("link", "/([0-9]{4}/[0-9]{2})/", 1), F.lit(""))
    return links.groupBy("link", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


_WANTED = 200
_STOP = f"""WITH {REC}, o AS (SELECT record_id, row_number() OVER (ORDER BY h NULLS FIRST, record_id) AS ordinal, coalesce(lower(lang) = 'en' AND length(body) >= 100, false) AS accepted FROM rec), k AS (SELECT *, sum(accepted::INT) OVER (ORDER BY ordinal) AS held FROM o)"""


@query(f"{_STOP} SELECT record_id, ordinal, accepted FROM k WHERE held < {_WANTED} OR held = {_WANTED} AND accepted")
def early_stop(spark, d):
    """Records in order as far as they must be looked at until the wanted number is accepted; that number is the point of the query."""
    r = records(spark, d).select("record_id", "body_sha256", F.coalesce((F.lower("lang") == "en") & (F.length("body") >= 100), F.lit(False)).alias("accepted"))
    o = ordering.with_ordinal(r, [F.asc_nulls_first("body_sha256"), "record_id"])
    last = o.where("accepted").orderBy("ordinal").limit(_WANTED).agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last"))
    return o.join(F.broadcast(last), (F.col("n") < _WANTED) | (F.col("ordinal") <= F.col("last"))).select("record_id", "ordinal", "accepted")


@query(f"WITH {REC} SELECT record_id, row_number() OVER (ORDER BY filing_date NULLS FIRST, h NULLS FIRST, record_id) AS ordinal FROM rec")
def date_hash_order(spark, d):
    r = records(spark, d).select("record_id", "filing_date", "body_sha256")
    return ordering.with_ordinal(r, [F.asc_nulls_first("filing_date"), F.asc_nulls_first("body_sha256"), "record_id"]).select("record_id", "ordinal")


_ORDER = ("releases", "8k", "6k", "news")


@query(f"WITH {REC}, f AS (SELECT family, count(*) AS n FROM rec GROUP BY family) SELECT family, n, row_number() OVER (ORDER BY coalesce(list_position({list(_ORDER)!r}, family), {len(_ORDER) + 1}), family) AS place FROM f")
def lookup_order(spark, d):
    """Families in the order of a list, those that it lacks by name after it; numbered over a row per family."""
    from pyspark.sql import Window

    f = records(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in _ORDER]), F.col("family")), F.lit(0)), F.lit(len(_ORDER) + 1))
    return f.select("family", "n", F.row_number().over(Window.orderBy(place, "family")).cast("long").alias("place"))


@query(f"WITH {PRED}, a AS (SELECT body_sha256, prediction, row_number() OVER (ORDER BY body_sha256) AS k FROM pred WHERE model = 'tfidf-4k'), b AS (SELECT body_sha256, prediction, row_number() OVER (ORDER BY body_sha256) AS k FROM pred WHERE model = 'lora-4k') SELECT k AS position, a.body_sha256 AS left_body, b.body_sha256 AS right_body, a.body_sha256 IS NOT DISTINCT FROM b.body_sha256 AS same FROM a FULL JOIN b USING (k)")
def positional_join(spark, d):
    """Two models' rows side by side by position; a shorter side and other bodies at a place show as not the same."""
    p = predictions(spark, d)
    side = lambda m, n: ordering.with_ordinal(p.where(F.col("model") == m).select(F.col("body_sha256").alias(n)), [n], "position")
    j = side("tfidf-4k", "left_body").join(side("lora-4k", "right_body"), "position", "full")
    return j.select("position", "left_body", "right_body", F.col("left_body").eqNullSafe(F.col("right_body")).alias("same"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS top, round(list_max(embedding)::DOUBLE, 5) AS score FROM embeddings")
def argmax_label(spark, d):
    """The first position of the largest of any number of scores."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", (F.array_position(e, F.array_max(e)).cast("int") - 1).alias("top"), F.round(F.array_max(e).cast("double"), 5).alias("score"))


@query("SELECT vec_id, len(embedding)::INT AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def packed_floats(spark, d):
    """Vectors through their packed form and back."""
    back = table(spark, d, "embeddings").select("vec_id", pack_floats(F.col("embedding")).alias("b")).select("vec_id", unpack_floats(F.col("b")).alias("v"))
    return back.select("vec_id", F.size("v").alias("dims"), F.round(V.total(F.transform("v", lambda x: x.cast("double"))), 4).alias("total"))


@query("""SELECT request_id, '{"body":"' || body || '","attempt":' || coalesce(json_extract_string(details, '$.attempt'), 'null') || ',"label":' || coalesce('"' || json_extract_string(details, '$.label') || '"', 'null') || '}' AS line FROM label_requests""")
def json_serialise(spark, d):
    """Nested values read and written again as one line of JSON with its keys in order, nulls kept."""
    r = table(spark, d, "label_requests")
    got = F.struct(F.col("body"), F.get_json_object("details", "$.attempt").cast("int").alias("attempt"), F.get_json_object("details", "$.label").alias("label"))
    return r.select("request_id", F.to_json(got, {"ignoreNullFields": "false"}).alias("line"))


@query("""SELECT record_id, strftime(x, '%Y%m%d') AS compact, CAST(strptime(strftime(x, '%d %B %Y'), '%d %B %Y') AS DATE) = x AS round_trip, date_diff('day', DATE '1970-01-01', x) AS epoch_day, CAST(CAST(x + CAST(date_diff('day', x, last_day(x)) // 2 AS INTEGER) AS DATE) AS VARCHAR) AS midpoint
 FROM (SELECT record_id, CAST(filing_date AS DATE) AS x FROM filing_records)""")
def date_parsing(spark, d):
    """Days through two written forms, as a number, and the middle of the days left in the month."""
    x = F.to_date("filing_date")
    long = F.to_date(F.date_format(x, "dd MMMM yyyy"), "dd MMMM yyyy")
    return table(spark, d, "filing_records").select("record_id", F.date_format(F.to_date(F.date_format(x, "yyyyMMdd"), "yyyyMMdd"), "yyyyMMdd").alias("compact"), (long == x).alias("round_trip"), F.unix_date(x).cast("long").alias("epoch_day"),
                                                    F.date_add(x, F.floor(F.datediff(F.last_day(x), x) / 2).cast("int")).cast("string").alias("midpoint"))


_PAIRS = "w AS (SELECT vec_id, k, embedding[2 * k + 1]::DOUBLE AS z0, embedding[2 * k + 2]::DOUBLE AS z1 FROM embeddings CROSS JOIN (SELECT range AS k FROM range(32)))"


@query(f"""WITH {_PAIRS}, g AS (SELECT *, z1 - greatest(z0, z1) - ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS gate FROM w), a AS (SELECT *, exp(gate - max(gate) OVER (PARTITION BY vec_id)) AS e FROM g)
 SELECT vec_id, round(avg(z0), 5) AS mean_0, round(avg(z1), 5) AS mean_1, round(sum(e * z0) / sum(e), 5) AS attended_0, round(sum(e * z1) / sum(e), 5) AS attended_1 FROM a GROUP BY vec_id""")
def pooled_logits(spark, d):
    """A document's two logits from those of its windows: their mean, and by attention, which a window's relative score gates."""
    e = F.col("embedding")
    windows = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.array(F.get(e, 2 * k).cast("double"), F.get(e, 2 * k + 1).cast("double")))
    p = features.pool_windows(table(spark, d, "embeddings").select("vec_id", windows.alias("windows")), "windows")
    return p.select("vec_id", *[F.round(F.col(c)[i], 5).alias(f"{n}_{i}") for c, n in (("uniform", "mean"), ("attended", "attended")) for i in (0, 1)])


@query(f"WITH {PRED}, s AS (SELECT model, reference_source AS basis, {_CELLS} FROM pred GROUP BY 1, 2) SELECT model, basis, tn + fp + fn + tp AS rows, round({_F1}, 6) AS macro_f1 FROM s")
def basis_scores(spark, d):
    c = metrics.class_scores(metrics.scored(predictions(spark, d)).groupBy("model", F.col("reference_source").alias("basis")).agg(*metrics.cells()))
    return c.select("model", "basis", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"), *r6("macro_f1"))


@query("WITH lab AS (SELECT coalesce(human.label, llm.label) AS label FROM filing_records WHERE coalesce(human.label, llm.label) IN ('routine', 'review_worthy')), n AS (SELECT label, count(*) AS n FROM lab GROUP BY label), r AS (SELECT label, n, sqrt(sum(n) OVER () / (count(*) OVER () * n)) AS raw FROM n) SELECT label, n, round(raw / (sum(raw * n) OVER () / sum(n) OVER ()), 6) AS weight FROM r")
def class_weights_root(spark, d):
    return features.class_weights(_labels(spark, d), 0.5).select("label", "n", *r6("weight"))


def _temperature_sql() -> str:
    """``fit_temperature`` as a chain of tables: a grid, then one around the best point of the one before, four times."""
    loss, step = "avg(greatest(-m / exp(t), 0) + ln(1 + exp(-abs(m / exp(t)))))", 0.25
    parts = [f"""z AS (SELECT model, CASE WHEN truth = 1 THEN 1 ELSE -1 END * (ln(greatest(p1, 1e-12)) - ln(greatest(p0, 1e-12))) AS m FROM {{pred}}),
 g0 AS (SELECT model, t, {loss} AS nll FROM z CROSS JOIN (SELECT (-3 + range * 0.25)::DOUBLE AS t FROM range(25)) GROUP BY model, t)"""]
    for k in range(1, 6):
        parts.append(f"b{k - 1} AS (SELECT model, t, nll FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY nll, abs(t)) AS rn FROM g{k - 1}) WHERE rn = 1)")
        if k < 5:
            span, step = step, 2 * step / 24
            parts.append(f"g{k} AS (SELECT model, t, {loss} AS nll FROM (SELECT z.model, m, least(3.0, greatest(-3.0, c.t - {span!r}::DOUBLE + i * {step!r}::DOUBLE)) AS t FROM z JOIN b{k - 1} c USING (model) CROSS JOIN (SELECT range AS i FROM range(25))) GROUP BY model, t)")
    return ", ".join(parts)


_FIT = f"{PRED.replace('pred AS', 'raw AS', 1)}, {_temperature_sql().format(pred='raw')}"
_CALIBRATED = f"""{_FIT}, lp AS (SELECT raw.*, ln(greatest(p0, 1e-12)) AS a, ln(greatest(p1, 1e-12)) AS b, exp(b4.t) AS temp FROM raw JOIN b4 USING (model)), ex AS (SELECT *, exp((a - greatest(a, b)) / temp) AS e0, exp((b - greatest(a, b)) / temp) AS e1 FROM lp),
 pred AS (SELECT model, body_sha256, truth, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM ex){_POINTS[len(PRED):]}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, policy ORDER BY skipped DESC, threshold DESC) AS rn FROM ok) WHERE rn = 1)"""


@query(f"WITH {_FIT} SELECT model, round(t, 4) AS log_t, round(nll, 6) AS nll FROM b4")
def temperature_fit(spark, d):
    return policies.fit_temperature(predictions(spark, d)).select("model", F.round("log_t", 4).alias("log_t"), *r6("nll"))


@query("SELECT DISTINCT model, true AS agrees FROM prediction_rows")
def temperature_check(spark, d):
    """The fitted temperatures against the roots of the slope, found by nested intervals."""
    p = predictions(spark, d)
    j = policies.fit_temperature(p).select("model", "log_t").join(policies.bisect_temperature(p).select("model", F.col("log_t").alias("root")), "model")
    return j.select("model", (F.abs(F.col("log_t") - F.col("root")) <= 2e-5).alias("agrees"))


def _calibrated(spark, d) -> tuple[DataFrame, DataFrame]:
    """Predictions at fitted temperatures, and the skip policies fitted on them."""
    p = predictions(spark, d)
    c = stage(policies.calibrated(p, policies.fit_temperature(p))).frame
    return c, stage(policies.fit_policies(c)).frame


@query(f"WITH {_CALIBRATED} SELECT model, policy, round(threshold, 6) AS threshold, skipped::BIGINT AS skipped, missed::BIGINT AS missed FROM best")
def calibrated_policies(spark, d):
    """Temperature first, then the policies at that temperature."""
    return _calibrated(spark, d)[1].select("model", "policy", *r6("threshold"), "skipped", "missed")


@query(f"WITH {_CALIBRATED} SELECT pred.model, body_sha256, CASE WHEN p1 >= 0.5 THEN 'review_worthy' ELSE 'routine' END AS prediction, round(1 - greatest(p0, p1), 6) AS uncertainty, coalesce(string_agg(policy, ',' ORDER BY policy) FILTER (WHERE p1 < 0.5 AND p0 >= threshold), '') AS discarded_by FROM pred JOIN best USING (model) GROUP BY pred.model, body_sha256, p0, p1")
def calibrated_predictions(spark, d):
    """Prediction rows of the calibrated models, each with the policies that would discard it."""
    c, fitted = _calibrated(spark, d)
    s = metrics.scored(policies.with_discards(c, fitted))
    by = F.array_join(F.array_sort(F.map_keys(F.map_filter("discard", lambda _, gone: gone))), ",")
    return s.select("model", "body_sha256", metrics.prediction(F.col("p1")).alias("prediction"), F.round(1 - F.col("confidence"), 6).alias("uncertainty"), F.coalesce(by, F.lit("")).alias("discarded_by"))


@query("SELECT body, rubric, max(request_id) FILTER (WHERE status = 'completed') AS completed, coalesce(max(request_id) FILTER (WHERE status IN ('reserved', 'unknown')) > coalesce(max(request_id) FILTER (WHERE status = 'completed'), ''), false) AS blocked FROM label_requests WHERE status IN ('completed', 'reserved', 'unknown') GROUP BY ALL")
def ledger_previous(spark, d):
    """The newest completed request of a text and rubric, and whether a newer open one blocks it."""
    newest = lambda *s: F.max(F.when(F.col("status").isin(*s), F.col("request_id")))
    g = table(spark, d, "label_requests").where(F.col("status").isin("completed", "reserved", "unknown")).groupBy("body", "rubric")
    n = g.agg(newest("completed").alias("completed"), newest("reserved", "unknown").alias("open"))
    return n.select("body", "rubric", "completed", F.coalesce(F.col("open") > F.coalesce("completed", F.lit("")), F.lit(False)).alias("blocked"))


_CEILING, _CAP = 20_000_000, 5_000_000  # billionths


@query(f"WITH x AS (SELECT request_id, rubric, status, CAST(round(coalesce(charged, reserved) * 1e9) AS BIGINT) AS nano FROM label_requests), t AS (SELECT *, sum(nano) OVER (PARTITION BY rubric ORDER BY request_id) AS total, sum(CASE WHEN status = 'completed' THEN 0 ELSE nano END) OVER (PARTITION BY rubric ORDER BY request_id) AS open FROM x) SELECT request_id, coalesce(total, 0) <= {_CEILING} AS within_ceiling, coalesce(open, 0) <= {_CAP} AS within_cap FROM t")
def ledger_caps(spark, d):
    """Each request in order under two limits: on all that was spent or reserved, and on what is still open."""
    nano = F.round(F.coalesce("charged", "reserved", F.lit(0.0)) * 1e9).cast("long")
    x = table(spark, d, "label_requests").select("request_id", "rubric", nano.alias("nano"), F.when(F.col("status") == "completed", 0).otherwise(nano).cast("long").alias("open"))
    t = ordering.running_totals(x, "rubric", [F.col("request_id")], ["nano", "open"])
    return t.select("request_id", (F.col("nano_upto") <= _CEILING).alias("within_ceiling"), (F.col("open_upto") <= _CAP).alias("within_cap"))


@query("SELECT rubric, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS successful, count(*) FILTER (WHERE status <> 'completed') AS prior, true AS adds_up FROM label_requests GROUP BY rubric")
def time_identity(spark, d):
    """What was spent on requests that succeeded and on all others, against the sum over all."""
    r = table(spark, d, "label_requests").select("rubric", "status", F.round(F.coalesce("charged", "reserved", F.lit(0.0)) * 1e9).cast("long").alias("nano"))
    done = F.col("status") == "completed"
    g = r.groupBy("rubric").agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("successful"), F.count_if(~done).alias("prior"), F.sum(F.when(done, F.col("nano")).otherwise(0)).alias("a"), F.sum(F.when(~done, F.col("nano")).otherwise(0)).alias("b"), F.sum("nano").alias("all"))
    return g.select("rubric", "n", "successful", "prior", (F.col("a") + F.col("b") == F.col("all")).alias("adds_up"))


@query("SELECT 'scores' AS result, 0::BIGINT AS differing UNION ALL SELECT 'vectors', 0")
def recomputed_results(spark, d):
    """Results worked out in two ways, compared within tolerances: scores from cells and from rows, vectors before and after packing."""
    p = metrics.scored(predictions(spark, d))
    cells = metrics.class_scores(p.groupBy("model").agg(*metrics.cells())).select("model", "accuracy")
    rows = p.groupBy("model").agg(F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("accuracy"))
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    back = e.select("vec_id", unpack_floats(pack_floats(F.col("embedding"))).alias("embedding"))
    count = lambda name, x: x.agg(F.lit(name).alias("result"), F.count(F.lit(1)).alias("differing"))
    return count("scores", compare.differences(rows, cells, ["model"])).union(count("vectors", compare.differences(back, e, ["vec_id"])))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def stream_ingest_census(spark, d):
    from quillstone.plans.corpus import stream_dedupe_ingest

    return stream_dedupe_ingest(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


@query()
def minhash_matches(spark, d):
    """Every record whose id is divisible by 20 against all records, by a probabilistic index (pairs of classes of equal texts)."""
    f = table(spark, d, "filing_records").where(F.col("body").rlike(r"[^\s\x{00a0}\x{2028}]")).select(F.col("record_id").alias("id"), F.col("body").alias("text"))
    return minhash.search(f, f.where("id % 20 = 0"))[0]


@query("SELECT CAST(c AS DOUBLE) AS c, balanced, true AS stationary FROM (VALUES (0.001), (0.01), (0.1), (1.0), (10.0), (30.0), (100.0)) v(c) CROSS JOIN (VALUES (false), (true)) b(balanced)")
def logistic_optimum(spark, d):
    """Each fit of the grid: whether the slope of its penalised loss is next to nothing at the fitted weights."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 2).alias("y"))
    return features.logistic_slopes(e.where("vec_id % 4 <> 0")).select("c", "balanced", (F.col("slope") < 1e-3).alias("stationary"))
