"""Queries over predictions, ledgers and vectors: scores, policies, intervals, features, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import bootstrap as B
from quillstone.operators import discovery, features, metrics, policies
from quillstone.operators import records as R
from quillstone.operators.ordering import rank_in_bucket, running_totals
from quillstone.plans.corpus import ALL_SIZES
from quillstone.plans.registry import REC, Registry, table
from quillstone.staging import stage

evaluation = Registry()
query = evaluation.query

#: One row per model and body: the last scored, and of rows scored together the one with the largest p1.
PRED = """pred AS (SELECT *, probabilities[1] AS p0, probabilities[2] AS p1, CASE WHEN reference = 'review_worthy' THEN 1 ELSE 0 END AS truth, CASE WHEN probabilities[2] >= 0.5 THEN 1 ELSE 0 END AS guess
 FROM (SELECT *, row_number() OVER (PARTITION BY model, body_sha256 ORDER BY scored_at DESC, probabilities[2] DESC, characters DESC) AS rn FROM prediction_rows) WHERE rn = 1)"""
_CELLS = "count(*) FILTER (WHERE truth = 0 AND guess = 0) AS tn, count(*) FILTER (WHERE truth = 0 AND guess = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND guess = 0) AS fn, count(*) FILTER (WHERE truth = 1 AND guess = 1) AS tp"
_F1 = "(coalesce(2 * tn / nullif(2.0 * tn + fp + fn, 0), 0) + coalesce(2 * tp / nullif(2.0 * tp + fp + fn, 0), 0)) / 2"
_BRIER = "avg((p0 - (1 - truth)) ** 2 + (p1 - truth) ** 2)"
_LOSS = "avg(-ln(greatest(CASE WHEN truth = 1 THEN p1 ELSE p0 END, 1e-12)))"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prediction_rows").drop("discard")
    p = p.withColumn("__p1", F.col("probabilities")[1])
    return R.latest(p, ["model", "body_sha256"], ["scored_at", "__p1", "characters"]).drop("__p1")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {PRED} SELECT model, body_sha256, CASE WHEN guess = 1 THEN 'review_worthy' ELSE 'routine' END AS prediction, round(1 - greatest(p0, p1), 6) AS uncertainty, p1 < 0.5 AND p0 >= 0.9 AS skipped, coalesce(group_id, body_sha256) AS group_id FROM pred")
def prediction_rows(spark, d):
    p = metrics.scored(predictions(spark, d))
    return p.select("model", "body_sha256", metrics.prediction(F.col("p1")).alias("prediction"), F.round(1 - F.col("confidence"), 6).alias("uncertainty"), policies.skip(F.col("p0"), F.col("p1"), F.lit(0.9)).alias("skipped"), F.coalesce("group_id", "body_sha256").alias("group_id"))


@query(f"WITH {PRED}, z AS (SELECT model, body_sha256, ln(greatest(p0, 1e-12)) / 1.25 AS a, ln(greatest(p1, 1e-12)) / 1.25 AS b FROM pred) SELECT model, body_sha256, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS q0, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS q1 FROM z")
def softmax_temperature(spark, d):
    q = V.softmax(V.log_probabilities(F.col("probabilities")), 1.25)
    return predictions(spark, d).select("model", "body_sha256", q.alias("q")).select("model", "body_sha256", F.round(F.col("q")[0], 6).alias("q0"), F.round(F.col("q")[1], 6).alias("q1"))


@query(f"WITH {PRED}, z AS (SELECT model, body_sha256, ln(greatest(p0, 1e-12)) / 1.236756223119131 AS a, ln(greatest(p1, 1e-12)) / 1.236756223119131 AS b FROM pred), q AS (SELECT model, body_sha256, 1 / (1 + exp(b - a)) AS q0 FROM z) SELECT model, CASE WHEN q0 > 0.5 THEN CASE WHEN q0 >= 0.8669 THEN 'skip' ELSE 'routine' END ELSE 'review' END AS action, count(*) AS n FROM q GROUP BY 1, 2")
def serving_action(spark, d):
    q = V.softmax(V.log_probabilities(F.col("probabilities")), 1.236756223119131)
    action = F.when(F.col("q0") > 0.5, F.when(F.col("q0") >= 0.8669, "skip").otherwise("routine")).otherwise("review")
    return predictions(spark, d).select("model", q[0].alias("q0")).groupBy("model", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRED} SELECT model, count(*) AS bad FROM pred WHERE len(probabilities) <> 2 OR p0 < 0 OR p1 < 0 OR abs(p0 + p1 - 1) > 1e-6 OR isnan(p0) OR isnan(p1) GROUP BY model")
def probability_violations(spark, d):
    p = F.col("probabilities")
    bad = (F.size(p) != 2) | F.exists(p, lambda x: (x < 0) | F.isnan(x)) | (F.abs(V.total(p) - 1) > 1e-6)
    return predictions(spark, d).where(bad).groupBy("model").agg(F.count(F.lit(1)).alias("bad"))


@query(f"WITH {PRED} SELECT model, {_CELLS} FROM pred GROUP BY model")
def confusion(spark, d):
    return metrics.scored(predictions(spark, d)).groupBy("model").agg(*metrics.cells())


@query(f"""WITH {PRED}, c AS (SELECT model, {_CELLS} FROM pred GROUP BY model) SELECT model, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS routine_precision, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS routine_recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS review_precision,
 round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS review_recall, round((tn + tp) / nullif(tn + fp + fn + tp, 0), 6) AS accuracy, round({_F1}, 6) AS macro_f1 FROM c""")
def class_scores(spark, d):
    s = metrics.class_scores(confusion(spark, d))
    return s.select("model", *r6("routine_precision", "routine_recall", "review_precision", "review_recall", "accuracy", "macro_f1"))


@query(f"WITH {PRED} SELECT model, round({_BRIER}, 6) AS brier, round({_LOSS}, 6) AS log_loss FROM pred GROUP BY model")
def brier_logloss(spark, d):
    return metrics.scored(predictions(spark, d)).groupBy("model").agg(F.round(metrics.brier(), 6).alias("brier"), F.round(metrics.log_loss(), 6).alias("log_loss"))


_BINS = f"""{PRED}, f AS (SELECT model, least(CAST(floor(greatest(p0, p1) * 10) AS INTEGER), 9) AS bin, count(*) AS rows, avg(greatest(p0, p1)) AS confidence, avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY 1, 2),
 t AS (SELECT model, b.bin, coalesce(rows, 0) AS rows, confidence, accuracy FROM (SELECT DISTINCT model FROM pred) CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b LEFT JOIN f USING (model, bin))"""


@query(f"WITH {_BINS} SELECT model, bin, rows, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM t")
def ece_bins(spark, d):
    return metrics.bins(predictions(spark, d)).select("model", "bin", "rows", *r6("confidence", "accuracy"))


@query(f"WITH {_BINS} SELECT model, round(sum(rows * abs(accuracy - confidence)) / sum(rows), 6) AS ece FROM t GROUP BY model")
def expected_calibration_error(spark, d):
    return metrics.calibration_error(metrics.bins(predictions(spark, d))).select("model", *r6("ece"))


@query(f"""WITH {PRED}, s AS (SELECT model, t::DOUBLE AS threshold, truth, p1 < 0.5 AND p0 >= t AS skipped FROM pred CROSS JOIN (VALUES (0.6), (0.9), (1.000001)) v(t)) SELECT model, round(threshold, 6) AS threshold, count(*) AS rows, count(*) FILTER (WHERE skipped) AS discarded,
 count(*) FILTER (WHERE skipped AND truth = 1) AS dangerous_misses, round(count(*) FILTER (WHERE skipped AND truth = 1) / nullif(sum(truth), 0), 6) AS dangerous_miss_rate, round(count(*) FILTER (WHERE skipped AND truth = 1) / nullif(count(*) FILTER (WHERE skipped), 0), 6) AS discard_contamination,
 round(count(*) FILTER (WHERE skipped) / count(*), 6) AS workload_reduction FROM s GROUP BY 1, 2""")
def policy_scores(spark, d):
    t = spark.createDataFrame([(0.6,), (0.9,), (1.000001,)], "threshold double")
    flags = metrics.scored(predictions(spark, d)).crossJoin(F.broadcast(t)).withColumn("skipped", policies.skip(F.col("p0"), F.col("p1"), F.col("threshold")))
    s = metrics.policy_scores(flags, ["model", "threshold"])
    return s.select("model", *r6("threshold"), "rows", "discarded", "dangerous_misses", *r6("dangerous_miss_rate", "discard_contamination", "workload_reduction"))


@query(f"""WITH {PRED}, g AS (SELECT model, CASE grouping(family, source, reference_source) WHEN 7 THEN 'overall' WHEN 3 THEN 'family' WHEN 5 THEN 'source' ELSE 'reference_source' END AS slice, coalesce(family, source, reference_source) AS slice_value, count(*) AS rows, {_CELLS}, {_BRIER} AS brier
 FROM pred GROUP BY GROUPING SETS ((model), (model, family), (model, source), (model, reference_source))) SELECT model, slice, slice_value, rows, round({_F1}, 6) AS macro_f1, round(brier, 6) AS brier FROM g""")
def breakdown_grouping_sets(spark, d):
    return metrics.breakdown(predictions(spark, d), ["family", "source", "reference_source"]).select("model", "slice", "slice_value", "rows", *r6("macro_f1", "brier"))


_QUART = "quart AS (SELECT quantile_cont(characters, 0.25) AS a, quantile_cont(characters, 0.5) AS b, quantile_cont(characters, 0.75) AS c FROM pred)"


@query(f"WITH {PRED}, {_QUART}, l AS (SELECT model, truth, guess, (characters >= a)::INT + (characters >= b)::INT + (characters >= c)::INT AS quartile FROM pred CROSS JOIN quart), x AS (SELECT model, quartile, count(*) AS rows, {_CELLS} FROM l GROUP BY 1, 2) SELECT model, quartile, rows, round({_F1}, 6) AS macro_f1 FROM x")
def length_quartile_scores(spark, d):
    p = metrics.scored(predictions(spark, d))
    q = p.agg(*[F.percentile("characters", F.lit(v)).alias(n) for n, v in (("a", 0.25), ("b", 0.5), ("c", 0.75))])
    at = sum((F.col("characters") >= F.col(c)).cast("int") for c in "abc")
    x = p.crossJoin(F.broadcast(q)).groupBy("model", at.alias("quartile")).agg(F.count(F.lit(1)).alias("rows"), *metrics.cells())
    return metrics.class_scores(x).select("model", "quartile", "rows", *r6("macro_f1"))


@query(f"WITH {PRED} SELECT coalesce(a.body_sha256, b.body_sha256) AS body_sha256, CASE WHEN b.body_sha256 IS NULL THEN 'tfidf only' WHEN a.body_sha256 IS NULL THEN 'lora only' ELSE 'both' END AS missed_by FROM (SELECT * FROM pred WHERE model = 'tfidf-4k' AND truth = 1 AND guess = 0) a FULL JOIN (SELECT * FROM pred WHERE model = 'lora-4k' AND truth = 1 AND guess = 0) b ON a.body_sha256 = b.body_sha256")
def miss_overlap(spark, d):
    p = metrics.scored(predictions(spark, d)).where("truth = 1 and guess = 0")
    side = lambda m, n: p.where(F.col("model") == m).select("body_sha256", F.lit(1).alias(n))
    j = side("tfidf-4k", "a").join(side("lora-4k", "b"), "body_sha256", "full")
    return j.select("body_sha256", F.when(F.col("b").isNull(), "tfidf only").when(F.col("a").isNull(), "lora only").otherwise("both").alias("missed_by"))


_POINTS = f"""{PRED}, tot AS (SELECT model, count(*) AS rows, sum(truth) AS support FROM pred GROUP BY model), st AS (SELECT model, p0 AS threshold, sum(count(*)) OVER (PARTITION BY model ORDER BY p0 DESC) AS skipped, sum(sum(truth)) OVER (PARTITION BY model ORDER BY p0 DESC) AS missed FROM pred WHERE p1 < 0.5 GROUP BY model, p0),
 pts AS (SELECT * FROM st UNION ALL SELECT model, 1.000001, 0, 0 FROM tot), rules AS (SELECT * FROM (VALUES ('0.01', 0.01, true), ('0.05', 0.05, true), ('skip_0.1', 0.1, false), ('skip_0.2', 0.2, false), ('skip_0.3', 0.3, false)) r(policy, bound, by_miss)),
 ok AS (SELECT model, policy, threshold, skipped, missed FROM pts JOIN tot USING (model) CROSS JOIN rules WHERE threshold = 1.000001 OR CASE WHEN by_miss THEN support > 0 AND missed <= bound * support ELSE skipped <= floor(bound * rows + 1e-9) END)"""


@query(f"WITH {_POINTS} SELECT model, policy, round(threshold, 6) AS threshold, skipped::BIGINT AS skipped, missed::BIGINT AS missed FROM (SELECT *, row_number() OVER (PARTITION BY model, policy ORDER BY skipped DESC, threshold DESC) AS rn FROM ok) WHERE rn = 1")
def fit_policies(spark, d):
    return policies.fit_policies(predictions(spark, d)).select("model", "policy", *r6("threshold"), "skipped", "missed")


@query(f"WITH {_POINTS} SELECT model, policy, max(skipped)::BIGINT AS skipped FROM ok GROUP BY model, policy")
def fit_policies_check(spark, d):
    """From the other end: what a cut-off leaves is added up from the lowest p0, and what it skips is the rest."""
    p = metrics.scored(predictions(spark, d)).select("model", "p0", "p1", "truth")
    tot = p.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.sum("truth").alias("support"), F.count_if(F.col("p1") < 0.5).alias("open"), F.count_if((F.col("p1") < 0.5) & (F.col("truth") == 1)).alias("risky"))
    steps = p.where("p1 < 0.5").groupBy("model", "p0").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("t"))
    upto = running_totals(steps, "model", [F.asc("p0")], ["n", "t"]).join(F.broadcast(tot), "model")
    hit = upto.withColumns({"s": F.col("open") - F.col("n_upto") + F.col("n"), "m": F.col("risky") - F.col("t_upto") + F.col("t")})
    rules = [(str(b), (F.col("support") > 0) & (F.col("m") <= b * F.col("support"))) for b in policies.MISS_RATES] + [(f"skip_{b}", F.col("s") <= F.floor(b * F.col("rows") + 1e-9)) for b in policies.SKIP_SHARES]
    best = tot.select("model").join(hit, "model", "left").groupBy("model").agg(*[F.coalesce(F.max(F.when(c, F.col("s"))), F.lit(0)).alias(n) for n, c in rules])
    return best.select("model", F.explode(F.create_map(*[x for n, _ in rules for x in (F.lit(n), F.col(f"`{n}`"))])).alias("policy", "skipped"))


_GRID = f"""{PRED}, z AS (SELECT model, CASE WHEN truth = 1 THEN 1 ELSE -1 END * (ln(greatest(p1, 1e-12)) - ln(greatest(p0, 1e-12))) AS m FROM pred),
 grid AS (SELECT model, t, avg(greatest(-m / exp(t), 0) + ln(1 + exp(-abs(m / exp(t))))) AS nll FROM z CROSS JOIN (SELECT (-3 + range * 0.25)::DOUBLE AS t FROM range(25)) GROUP BY model, t)"""


@query(f"WITH {_GRID} SELECT model, round(t, 6) AS log_t, round(nll, 6) AS nll FROM grid")
def temperature_grid(spark, d):
    return policies.grid_temperature(predictions(spark, d), [-3 + i * 0.25 for i in range(25)]).select("model", *r6("log_t", "nll"))


_U = "substr(sha256(g || ':' || (r // 8)), 1 + 8 * (r % 8)::INT, 8)"
_W = " + ".join(f"(u >= '{s}')::INT" for s in B.STEPS)
REPLICATES = 2000
_BOOT = f"""{PRED}, cells AS (SELECT model, coalesce(group_id, body_sha256) AS g, {_CELLS} FROM pred GROUP BY 1, 2), u AS (SELECT *, {_U} AS u FROM cells CROSS JOIN (SELECT range AS r FROM range({REPLICATES}))), w AS (SELECT *, {_W} AS w FROM u),
 reps AS (SELECT model, r, sum(tn * w) AS tn, sum(fp * w) AS fp, sum(fn * w) AS fn, sum(tp * w) AS tp FROM w WHERE w > 0 GROUP BY 1, 2), f1 AS (SELECT model, r, {_F1} AS m FROM reps)"""


def _intervals(spark, d, n: int) -> DataFrame:
    return B.intervals(B.replicates(B.group_cells(predictions(spark, d)), n)).select("model", *r6("low", "mean", "high"), "replicates")


def _contrasts(spark, d, n: int) -> DataFrame:
    return B.contrasts(B.replicates(B.group_cells(predictions(spark, d)), n), "tfidf-4k").select("model", *r6("low", "mean", "high"))


def _results(spark, d, n: int) -> DataFrame:
    p = predictions(spark, d)
    i = B.intervals(B.replicates(B.group_cells(p), n)).select("model", "low", "high")
    s = metrics.class_scores(metrics.scored(p).groupBy("model").agg(*metrics.cells())).join(i, "model")
    return s.select("model", F.format_string("%.3f", "macro_f1").alias("macro_f1"), F.format_string("[%.3f, %.3f]", "low", "high").alias("interval"), F.format_string("%d/%d", "fn", F.col("fn") + F.col("tp")).alias("misses"))


@query(f"WITH {PRED} SELECT model, coalesce(group_id, body_sha256) AS group_id, {_CELLS} FROM pred GROUP BY 1, 2")
def bootstrap_cells(spark, d):
    return B.group_cells(predictions(spark, d))


@query(f"WITH {_BOOT} SELECT model, round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM f1 GROUP BY model")
def bootstrap_intervals(spark, d):
    return _intervals(spark, d, REPLICATES)


@query(f"WITH {_BOOT} SELECT model, CAST(r AS INTEGER) AS replicate, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM reps")
def bootstrap_by_document(spark, d):
    return B.replicates_by_row(predictions(spark, d), REPLICATES).select("model", "replicate", "tn", "fp", "fn", "tp")


@query(f"WITH {_BOOT} SELECT a.model, round(quantile_cont(a.m - b.m, 0.025), 6) AS low, round(avg(a.m - b.m), 6) AS mean, round(quantile_cont(a.m - b.m, 0.975), 6) AS high FROM f1 a JOIN f1 b ON a.r = b.r AND b.model = 'tfidf-4k' WHERE a.model <> 'tfidf-4k' GROUP BY a.model")
def paired_contrasts(spark, d):
    return _contrasts(spark, d, REPLICATES)


@query(f"WITH {_BOOT}, s AS (SELECT model, {_CELLS} FROM pred GROUP BY model), i AS (SELECT model, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM f1 GROUP BY model) SELECT model, printf('%.3f', {_F1}) AS macro_f1, '[' || printf('%.3f', low) || ', ' || printf('%.3f', high) || ']' AS interval, CAST(fn AS VARCHAR) || '/' || CAST(fn + tp AS VARCHAR) AS misses FROM s JOIN i USING (model)")
def results_table(spark, d):
    return _results(spark, d, REPLICATES)


_NAMED = """macro_f1: {f1}; dangerous_miss_rate: fn / nullif(fn + tp, 0); review_precision: coalesce(tp / nullif(tp + fp, 0), 0); review_recall: coalesce(tp / nullif(tp + fn, 0), 0); review_workload: (fp + tp) / (tn + fp + fn + tp); skip_fraction: (tn + fn) / (tn + fp + fn + tp)""".format(f1=_F1)
POLICIES = ("0.01", "0.05", "skip_0.1", "skip_0.2", "skip_0.3")
_GONE = ", ".join(f"count(*) FILTER (WHERE coalesce(discard['{q}'], false)) AS gone_{i}, count(*) FILTER (WHERE coalesce(discard['{q}'], false) AND truth = 1) AS lost_{i}" for i, q in enumerate(POLICIES))
_ALL = [tuple(x.split(": ", 1)) for x in _NAMED.split("; ")] + [x for i, q in enumerate(POLICIES) for x in ((f"workload_{q}", f"gone_{i} / (tn + fp + fn + tp)"), (f"dangerous_miss_rate_{q}", f"lost_{i} / nullif(fn + tp, 0)"))]
_SUMS = ", ".join(f"sum({c} * w) AS {c}" for c in ("tn", "fp", "fn", "tp", *[f"{k}_{i}" for i in range(len(POLICIES)) for k in ("gone", "lost")]))
_STUDY = f"""{PRED}, cells AS (SELECT model, coalesce(group_id, body_sha256) AS g, {_CELLS}, {_GONE} FROM pred GROUP BY 1, 2), u AS (SELECT *, {_U} AS u FROM cells CROSS JOIN (SELECT range AS r FROM range({REPLICATES}))), w AS (SELECT *, {_W} AS w FROM u),
 reps AS (SELECT model, r, {_SUMS} FROM w WHERE w > 0 GROUP BY 1, 2), v AS ({" UNION ALL ".join(f"SELECT model, r, '{k}' AS metric, ({x})::DOUBLE AS value FROM reps" for k, x in _ALL)})"""


def _study(spark, d) -> DataFrame:
    p = table(spark, d, "prediction_rows").withColumns({"__p1": F.col("probabilities")[1], "__discard": F.map_entries("discard")}).drop("discard")
    p = R.latest(p, ["model", "body_sha256"], ["scored_at", "__p1", "characters"]).withColumn("discard", F.map_from_entries("__discard"))
    values = (*metrics.CELLS, *[f"{k}_{i}" for i in range(len(POLICIES)) for k in ("gone", "lost")])
    return stage(B.study_metrics(B.replicates(B.study_cells(p, POLICIES), REPLICATES, values=values), POLICIES)).frame


@query(f"WITH {_STUDY} SELECT model, metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(value) AS valid_replicates FROM v GROUP BY 1, 2")
def bootstrap_metrics(spark, d):
    """Intervals of every named metric; replicates in which one is undefined don't count for it."""
    return B.intervals_of(_study(spark, d)).select("model", "metric", *r6("low", "high"), "valid_replicates")


@query(f"WITH {_STUDY} SELECT a.model, a.metric, round(quantile_cont(a.value - b.value, 0.025), 6) AS low, round(quantile_cont(a.value - b.value, 0.975), 6) AS high, count(a.value - b.value) AS valid_replicates FROM v a JOIN v b ON a.r = b.r AND a.metric = b.metric AND b.model = 'tfidf-4k' GROUP BY 1, 2")
def paired_metrics(spark, d):
    """Every model against one, metric by metric, within replicates."""
    v = _study(spark, d)
    base = v.where("model = 'tfidf-4k'").select("replicate", "metric", F.col("value").alias("base"))
    deltas = v.join(base, ["replicate", "metric"]).select("model", "replicate", "metric", (F.col("value") - F.col("base")).alias("value"))
    return B.intervals_of(deltas).select("model", "metric", *r6("low", "high"), "valid_replicates")


@query("""WITH RECURSIVE g AS (SELECT status, rubric, coalesce(charged, reserved) AS x FROM label_requests) SELECT rubric, count(*) AS n, round(coalesce(sum(x), 0), 6) AS total FROM g GROUP BY rubric UNION ALL SELECT 'all', count(*), round(coalesce(sum(x), 0), 6) FROM g""")
def ledger_totals(spark, d):
    g = table(spark, d, "label_requests").withColumn("x", F.coalesce("charged", "reserved"))
    sums = [F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("x"), F.lit(0.0)), 6).alias("total")]
    return g.groupBy("rubric").agg(*sums).unionByName(g.agg(F.lit("all").alias("rubric"), *sums))


@query("SELECT body, rubric, request_id, status, json_extract_string(details, '$.label') AS label FROM (SELECT *, row_number() OVER (PARTITION BY body, rubric ORDER BY request_id DESC) AS rn FROM label_requests WHERE status IN ('completed', 'reserved', 'unknown')) WHERE rn = 1")
def ledger_latest(spark, d):
    open_or_done = table(spark, d, "label_requests").where(F.col("status").isin("completed", "reserved", "unknown"))
    return R.latest(open_or_done, ["body", "rubric"], ["request_id"]).select("body", "rubric", "request_id", "status", F.get_json_object("details", "$.label").alias("label"))


@query("SELECT body, string_agg(request_id, ',' ORDER BY request_id) AS requests FROM label_requests WHERE status = 'unknown_retry_permitted' GROUP BY body")
def ledger_retries(spark, d):
    r = table(spark, d, "label_requests").where("status = 'unknown_retry_permitted'")
    return r.groupBy("body").agg(F.array_join(F.array_sort(F.collect_list("request_id")), ",").alias("requests"))


@query("SELECT request_id, total <= 0.02 AS admitted FROM (SELECT request_id, sum(round(coalesce(charged, reserved) * 1e9)) OVER (PARTITION BY rubric ORDER BY request_id) / 1e9 AS total FROM label_requests)")
def ledger_admission(spark, d):
    x = table(spark, d, "label_requests").select("request_id", "rubric", F.round(F.coalesce("charged", "reserved", F.lit(0.0)) * 1e9).cast("long").alias("nano"))
    return running_totals(x, "rubric", [F.col("request_id")], ["nano"]).select("request_id", (F.col("nano_upto") / 1e9 <= 0.02).alias("admitted"))


@query("SELECT model, round(quantile_cont(uncertainty, 0.5), 6) AS p50, round(quantile_cont(uncertainty, 0.95), 6) AS p95, round(avg(uncertainty), 6) AS mean, max(uncertainty) AS highest FROM prediction_rows GROUP BY model")
def latency_summary(spark, d):
    return table(spark, d, "prediction_rows").groupBy("model").agg(F.round(F.percentile("uncertainty", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("uncertainty", F.lit(0.95)), 6).alias("p95"), F.round(F.avg("uncertainty"), 6).alias("mean"), F.max("uncertainty").alias("highest"))


@query("""WITH ph AS (SELECT * FROM (VALUES ('warm-up', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-05'), ('fit', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20'), ('score', TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-01')) p(phase, s, e))
 SELECT phase, count(*) AS samples, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(quantile_cont(value, 0.1), 4) AS p10, max(value) AS highest, round(avg(CASE WHEN value <= 5 THEN 1.0 ELSE 0.0 END), 6) AS idle FROM events JOIN ph ON ts >= s AND ts < e GROUP BY phase""")
def phase_telemetry(spark, d):
    ph = spark.createDataFrame([("warm-up", "2024-01-01", "2024-01-05"), ("fit", "2024-01-05", "2024-01-20"), ("score", "2024-01-20", "2024-02-01")], "phase string, s string, e string")
    ts = F.col("ts").cast("timestamp_ntz")
    j = table(spark, d, "events").join(F.broadcast(ph), (ts >= F.col("s").cast("timestamp_ntz")) & (ts < F.col("e").cast("timestamp_ntz")))
    return j.groupBy("phase").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"), F.round(F.percentile("value", F.lit(0.1)), 4).alias("p10"), F.max("value").alias("highest"), F.round(F.avg((F.col("value") <= 5).cast("double")), 6).alias("idle"))


@query("SELECT event_type, count(*) AS n, round(count(*) / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0) * 3.6e9, 6) AS per_hour FROM events GROUP BY event_type")
def throughput(spark, d):
    span = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(V.ratio(F.count(F.lit(1)), span) * 3.6e9, 6).alias("per_hour"))


@query("SELECT vec_id, round(sum((e / n) * (i + 1)), 5) AS checksum FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS i, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) GROUP BY vec_id")
def embedding_l2(spark, d):
    n = table(spark, d, "embeddings").select("vec_id", V.l2(F.col("embedding")).alias("v"))
    return n.select("vec_id", F.round(V.total(F.transform("v", lambda x, i: x * (i + 1))), 5).alias("checksum"))


@query("WITH x AS (SELECT label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS e FROM embeddings), m AS (SELECT label, dim, avg(e) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) SELECT label, dim, round(m / n, 6) AS value FROM m JOIN n USING (label)")
def embedding_mean_pool(spark, d):
    return features.mean_pool(table(spark, d, "embeddings"), "embedding", "label").select("label", "dim", *r6("value"))


@query("WITH x AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS e FROM embeddings), s AS (SELECT dim, avg(e) AS m, stddev_pop(e) AS s FROM x GROUP BY dim) SELECT vec_id, dim, round((e - m) / nullif(s, 0), 5) AS value FROM x JOIN s USING (dim)")
def standard_scale(spark, d):
    return features.standardized(table(spark, d, "embeddings"), "embedding", "vec_id").select("vec_id", "dim", F.round("value", 5).alias("value"))


_LAB = "lab AS (SELECT record_id, coalesce(human.label, llm.label) AS label FROM filing_records WHERE coalesce(human.label, llm.label) IN ('routine', 'review_worthy'))"


def _labels(spark, d) -> DataFrame:
    return table(spark, d, "filing_records").select("record_id", F.coalesce("human.label", "llm.label").alias("label")).where(F.col("label").isin(*R.LABELS))


@query(f"WITH {_LAB} SELECT label, count(*) AS n FROM lab GROUP BY label ORDER BY n DESC, label LIMIT 1")
def majority_baseline(spark, d):
    return _labels(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)


@query(f"WITH {_LAB} SELECT record_id, list_position(['routine', 'review_worthy'], label) - 1 AS code FROM lab")
def label_encode(spark, d):
    return _labels(spark, d).select("record_id", (F.array_position(F.array(*[F.lit(x) for x in R.LABELS]), F.col("label")).cast("int") - 1).alias("code"))


@query(f"WITH {_LAB}, n AS (SELECT label, count(*) AS n FROM lab GROUP BY label), r AS (SELECT label, n, sum(n) OVER () / (count(*) OVER () * n) AS raw FROM n) SELECT label, n, round(raw / (sum(raw * n) OVER () / sum(n) OVER ()), 6) AS weight FROM r")
def class_weights(spark, d):
    return features.class_weights(_labels(spark, d)).select("label", "n", *r6("weight"))


@query(f"WITH {PRED} SELECT model, body_sha256, round(ln(greatest(p0 / (p0 + p1), 1e-12)), 6) AS z0, round(ln(greatest(p1 / (p0 + p1), 1e-12)), 6) AS z1, -30.0::DOUBLE AS missing FROM pred WHERE p0 + p1 > 0")
def align_logits(spark, d):
    p = F.col("probabilities")
    q = V.log_probabilities(F.transform(p, lambda x: x / V.total(p)))
    return predictions(spark, d).where(V.total(p) > 0).select("model", "body_sha256", F.round(q[0], 6).alias("z0"), F.round(q[1], 6).alias("z1"), F.coalesce(F.get(q, 2), F.lit(-30.0)).alias("missing"))


_GRAMS = r"""tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS t FROM documents), g AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1]))) AS term FROM tok), tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2),
 voc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 100000), idf AS (SELECT *, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM voc)"""


@query(f"WITH {_GRAMS} SELECT term, df, total, round(idf, 6) AS idf FROM idf")
def tfidf_terms(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return features.vocabulary(features.ngrams(docs), docs.count()).select("term", "df", "total", *r6("idf"))


@query(f"WITH {_GRAMS}, x AS (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term)), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY id) SELECT id, count(*) AS terms, round(max(x / n), 6) AS heaviest, round(sum(x / n), 4) AS total FROM x JOIN n USING (id) GROUP BY id")
def tfidf_vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    grams = stage(features.ngrams(docs)).frame
    w = features.tfidf(grams, features.vocabulary(grams, docs.count()))
    return w.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum("weight"), 4).alias("total"))


def _trials(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 2).alias("y"))
    return features.logistic_grid(e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0"))


@query()
def logistic_grid(spark, d):
    return _trials(spark, d)


@query()
def best_converged(spark, d):
    return features.best_trial(_trials(spark, d))


_DAYS = "days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)"


def _range_sql(cap: str) -> str:
    return f"""WITH RECURSIVE {_DAYS}, cap AS (SELECT {cap} AS cap), r(a, b, n) AS (SELECT CAST(date_trunc('month', day) AS DATE), last_day(CAST(date_trunc('month', day) AS DATE)), sum(n)::BIGINT FROM days GROUP BY 1, 2 UNION ALL
 SELECT h.x, h.y, (SELECT coalesce(sum(n), 0)::BIGINT FROM days WHERE day BETWEEN h.x AND h.y) FROM (SELECT CASE half WHEN 0 THEN a ELSE CAST(a + CAST(date_diff('day', a, b) // 2 + 1 AS INTEGER) AS DATE) END AS x, CASE half WHEN 0 THEN CAST(a + CAST(date_diff('day', a, b) // 2 AS INTEGER) AS DATE) ELSE b END AS y
 FROM r CROSS JOIN (VALUES (0), (1)) v(half) WHERE n > (SELECT cap FROM cap) AND a < b) h) SELECT CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, n AS rows, n > (SELECT cap FROM cap) AS capped FROM r WHERE n > 0 AND (n <= (SELECT cap FROM cap) OR a = b)"""


@query(_range_sql("40"))
def range_subdivide(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    r = discovery.subdivide(days, 40)
    return r.withColumns({"first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string")})


@query("""WITH RECURSIVE l AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'world', 'r' || r_regionkey FROM region),
 w(node, depth) AS (SELECT 'world', 0 UNION ALL SELECT child, depth + 1 FROM w JOIN l ON parent = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bfs_depth2(spark, d):
    n, s, r = (table(spark, d, x) for x in ("nation", "supplier", "region"))
    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    links = n.select(c("r", "n_regionkey").alias("parent"), c("n", "n_nationkey").alias("child")).union(s.select(c("n", "s_nationkey"), c("s", "s_suppkey"))).union(r.select(F.lit("world"), c("r", "r_regionkey")))
    return discovery.crawl(links, spark.createDataFrame([("world",)], "node string"), 2).select("node", "depth")


@query("WITH f AS (SELECT vec_id, unnest(embedding[1:63]) AS v, unnest(range(63)) AS pos FROM embeddings) SELECT vec_id, CAST(pos // 7 AS INTEGER) AS record, max(CASE WHEN pos % 7 = 0 THEN v END) AS x, max(CASE WHEN pos % 7 = 6 THEN v END) AS z FROM f GROUP BY 1, 2")
def chunk_zip_records(spark, d):
    return discovery.rechunk(table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 63).alias("flat")), "vec_id", "flat", ["x", "b", "c", "e", "f", "g", "z"]).select("vec_id", "record", "x", "z")


@query("SELECT document_id, provider FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY provider DESC) AS rn FROM (SELECT DISTINCT document_id, 0 AS provider FROM filing_records UNION ALL SELECT DISTINCT document_id, 1 FROM candidates)) WHERE rn = 1")
def merge_providers(spark, d):
    f = table(spark, d, "filing_records").select("document_id", "url", "source").distinct()
    return discovery.merge_providers([f, table(spark, d, "candidates").select("document_id", "url", "title").distinct()], "document_id").select("document_id", "provider")


@query(f"WITH {REC} SELECT src AS source, substr(filing_date, 1, 7) AS month, count(*) AS n FROM rec WHERE filing_date BETWEEN '2025-07-01' AND '2026-06-30' GROUP BY 1, 2")
def discovery_window(spark, d):
    r = R.with_defaults(table(spark, d, "filing_records")).where(F.col("filing_date").between("2025-07-01", "2026-06-30"))
    return r.groupBy(F.col("src").alias("source"), F.substring("filing_date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


_INC = f"{PRED}, s AS (SELECT model, {_CELLS} FROM pred GROUP BY model), x AS (SELECT model, CASE model WHEN 'tfidf-4k' THEN 1 ELSE 2 END AS k, {_F1} AS m FROM s)"


@query(f"WITH {_INC} SELECT model AS smaller, lead(model) OVER (ORDER BY k) AS larger, round(lead(m) OVER (ORDER BY k) - m, 6) AS gain FROM x")
def sample_increments(spark, d):
    from pyspark.sql import Window

    s = metrics.class_scores(metrics.scored(predictions(spark, d)).groupBy("model").agg(*metrics.cells())).withColumn("k", F.when(F.col("model") == "tfidf-4k", 1).otherwise(2))
    w = Window.orderBy("k")  # over one row per model
    return s.select(F.col("model").alias("smaller"), F.lead("model").over(w).alias("larger"), F.round(F.lead("macro_f1").over(w) - F.col("macro_f1"), 6).alias("gain"))


@query(f"WITH {PRED} SELECT a.body_sha256, a.prediction AS tfidf, b.prediction AS lora, round(b.p1 - a.p1, 6) AS shift FROM pred a JOIN pred b ON a.body_sha256 = b.body_sha256 WHERE a.model = 'tfidf-4k' AND b.model = 'lora-4k' AND a.prediction <> b.prediction")
def model_disagreement(spark, d):
    p = metrics.scored(predictions(spark, d))
    side = lambda m, n: p.where(F.col("model") == m).select("body_sha256", F.col("prediction").alias(n), F.col("p1").alias(f"p_{n}"))
    j = side("tfidf-4k", "tfidf").join(side("lora-4k", "lora"), "body_sha256").where("tfidf <> lora")
    return j.select("body_sha256", "tfidf", "lora", F.round(F.col("p_lora") - F.col("p_tfidf"), 6).alias("shift"))


@query("SELECT model, family, document_type, task_id, body_sha256, first_value(task_id) OVER k AS control_task_id, first_value(body_sha256) OVER k AS control_body_sha256 FROM prediction_rows WINDOW k AS (PARTITION BY model, family, document_type ORDER BY scored_at NULLS LAST, task_id NULLS LAST, body_sha256 NULLS LAST)")
def matched_controls(spark, d):
    """Every row with the one control of its kind, the first scored."""
    p = table(spark, d, "prediction_rows").select("model", "family", "document_type", "task_id", "body_sha256", "scored_at")
    kind, order = ["model", "family", "document_type"], F.struct(*[x for c in ("scored_at", "task_id", "body_sha256") for x in (F.col(c).isNull(), F.col(c))])
    first = p.groupBy(*kind).agg(F.min_by(F.struct("task_id", "body_sha256"), order).alias("c")).select(*[F.col(k).alias(f"k_{k}") for k in kind], "c")
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in kind]
    return p.join(F.broadcast(first), same).select(*kind, "task_id", "body_sha256", F.col("c.task_id").alias("control_task_id"), F.col("c.body_sha256").alias("control_body_sha256"))


_OF = "(SELECT m.model, v.size FROM (SELECT model, count(*) AS n FROM pred GROUP BY model) m JOIN (VALUES (4000), (16000)) v(size) ON v.size < m.n UNION ALL SELECT model, count(*) FROM pred GROUP BY model) v"


@query(f"WITH {PRED}, n AS (SELECT model, body_sha256, truth, guess, row_number() OVER (PARTITION BY model ORDER BY body_sha256) AS k FROM pred), s AS (SELECT n.*, v.size FROM n JOIN {_OF} ON n.model = v.model AND k <= v.size), c AS (SELECT model, size, {_CELLS} FROM s GROUP BY 1, 2) SELECT model, size, round({_F1}, 6) AS macro_f1 FROM c")
def learning_curve(spark, d):
    """At 4,000, 16,000 and all of a model's rows."""
    p = metrics.scored(predictions(spark, d)).select("model", "body_sha256", "truth", "guess")
    n = rank_in_bucket(p, "model", ["body_sha256"], "k")
    known = F.array(*[F.lit(x).cast("long") for x in ALL_SIZES])
    sizes = p.groupBy("model").agg(F.count(F.lit(1)).alias("rows")).select("model", F.explode(F.concat(F.filter(known, lambda x: x < F.col("rows")), F.array("rows"))).alias("size"))
    c = n.join(F.broadcast(sizes), "model").where("k <= size").groupBy("model", "size").agg(*metrics.cells())
    return metrics.class_scores(c).select("model", "size", *r6("macro_f1"))


@query(f"WITH {PRED}, s AS (SELECT model, family, {_CELLS} FROM pred GROUP BY 1, 2) SELECT model, family, (2 * tp / nullif(2.0 * tp + fp + fn, 0)) IS NULL AS undefined, coalesce(printf('%.1f%%', 100.0 * (tn + tp) / nullif(tn + fp + fn + tp, 0)), '--') AS accuracy FROM s")
def formatted_scores(spark, d):
    s = metrics.scored(predictions(spark, d)).groupBy("model", "family").agg(*metrics.cells())
    share = 100.0 * V.ratio(F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return s.select("model", "family", (2 * F.col("tp") + F.col("fp") + F.col("fn") == 0).alias("undefined"), F.coalesce(F.format_string("%.1f%%", share), F.lit("--")).alias("accuracy"))
