"""Core operators against plain versions on small and awkward inputs."""

import collections
import gzip
import inspect
import itertools
import json
import math
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions.packed import pack_floats, unpack_floats
from quillstone.functions.shingling import distinct_sets, fingerprints, shingle_set
from quillstone.operators import bootstrap, compare, discovery, duplicates, features, metrics, minhash, ordering, policies, selection
from quillstone.operators import records as R
from quillstone.operators.graph import connected_components
from quillstone.operators.similarity import prefix_length, similar_pairs
from quillstone.operators.skew import skew_join
from quillstone.plans import catalogue
from quillstone.sources import index, paged
from quillstone.sources import records as files
from quillstone.streaming.ingest import ingest, windowed_counts


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abßÉ _1½-\n "), max_size=60), min_size=1, max_size=8))
def test_fingerprints_count_the_same_runs(texts):
    sizes = []
    for _, hashes, runs in fingerprints(texts):
        sizes += distinct_sets(hashes, runs)[2].tolist()
    assert sizes == [len(shingle_set(t)) for t in texts]


def test_prefix_is_long_enough():
    for n in range(1, 200):
        p = prefix_length(n, 0.8)
        assert n - p < math.ceil(0.8 * n - 1e-9) <= n - p + 1


def edited(rng, words, share):
    return [rng.choice("qrstuvwxyz") * 4 if rng.random() < share else w for w in words]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 90))]
        texts += [" ".join(edited(rng, base, s)) for s in (0, 0.005, 0.02, 0.05)]
    texts += ["", "one", "one", "A b C d e f", "a B c D E F!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, reps, p = similar_pairs(docs, 0.8)
    sets = [shingle_set(t or "") for t in texts]
    least = {r["id"] for r in reps.collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if i in least and j in least and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert p.members.count() == len(texts)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in components([p for p in pairs if p[0] != p[1]]).items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_skew_join_keeps_all_rows(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = skew_join(rows, keyed, "k", "n")
    assert out.count() == 40_000 and out.columns == ["k", "id", "n"]
    assert skew_join(rows.limit(0), keyed, "k", "n").count() == 0


def test_ordinals_and_round_robin(spark):
    rows = [("a", 3), ("a", 1), ("b", 9), ("c", 2), ("a", 2), (None, 5), ("b", 1)]
    df = spark.createDataFrame(rows, "bucket string, x int")
    assert [r["x"] for r in ordering.with_ordinal(df.where("bucket = 'a'"), ["x"]).orderBy("ordinal").collect()] == [1, 2, 3]
    got = [(r["bucket"], r["x"]) for r in ordering.round_robin(df, "bucket", ["x"]).orderBy("ordinal").collect()]
    queues = [sorted(r[1] for r in rows if r[0] == b) for b in (None, "a", "b", "c")]
    want = [(b, q[i]) for i in range(3) for b, q in zip((None, "a", "b", "c"), queues) if i < len(q)]
    assert got == want
    assert ordering.with_ordinal(df.limit(0), ["x"]).count() == 0


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "bucket string, k int, v long")
    got = {r["k"]: r["v_upto"] for r in ordering.running_totals(df, "bucket", [F.desc("k")], ["v"]).collect()}
    held, want = {}, {}
    for b, k, v in sorted(rows, key=lambda r: -r[1]):
        held[b] = want[k] = held.get(b, 0) + v
    assert got == want
    assert ordering.running_totals(df.limit(0), "bucket", [F.col("k")], ["v"]).count() == 0


def test_whole_groups_hit_the_count(spark):
    rng = random.Random(5)
    for most in (9, 9, 30, 30):
        sizes = [rng.randrange(1, most) for _ in range(14)]
        count = sum(rng.sample(sizes, 5))
        groups = spark.createDataFrame([(f"g{i}", s, i + 1) for i, s in enumerate(sizes)], "group_id string, size long, ordinal long")
        got = {r["group_id"]: r["size"] for r in selection.whole_groups(groups, count).collect()}
        assert sum(got.values()) == count and all(sizes[int(g[1:])] == n for g, n in got.items())
    singles = spark.createDataFrame([("big", 40, 1), *[(f"g{i}", 1, i + 2) for i in range(50)]], "group_id string, size long, ordinal long")
    assert {r["group_id"] for r in selection.whole_groups(singles, 30).collect()} == {f"g{i}" for i in range(30)}  # the first ones, but for what can't fit


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9), st.lists(st.booleans(), min_size=9, max_size=9), st.integers(1, 40))
def test_change_is_found_where_there_is_one(sizes, chosen, rest):
    inside, outside = collections.Counter(s for s, c in zip(sizes, chosen) if c), collections.Counter(s for s, c in zip(sizes, chosen) if not c)
    reachable = {0}
    for s, c in zip(sizes, chosen):
        reachable |= {t + (-s if c else s) for t in reachable}
    got = selection.exact_change(rest, dict(inside), dict(outside))
    assert (got is not None) == (rest in reachable)
    if got is not None:
        assert sum(s * k for s, k in got.items()) == rest and all(-inside[s] <= k <= outside[s] for s, k in got.items())


def test_whole_groups_of_nothing(spark):
    groups = spark.createDataFrame([("g", 4, 1)], "group_id string, size long, ordinal long")
    with pytest.raises(ValueError):
        selection.whole_groups(spark.createDataFrame([("g", 4, 1)], "group_id string, size long, ordinal long"), 3)
    assert selection.whole_groups(groups, 0).count() == 0


def test_first_wins_and_crossing_with_nulls(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), (None, 7), (None, 5), ("y", 3)], "k string, n int")
    assert {(r["k"], r["n"]) for r in R.first_wins(df, "k", ["n"]).collect()} == {("x", 1), (None, 5), ("y", 3)}
    assert {(r["k"], r["n"]) for r in R.first_wins(df, "k", ["n"], last=True).collect()} == {("x", 2), (None, 7), ("y", 3)}
    assert [r["k"] for r in R.crossing(df, "k", "n").collect()] == ["x"]
    base = spark.createDataFrame([("x", 0), (None, 1)], "k string, n int")
    assert {r["k"] for r in R.blocked_by(df, base, ["k"]).collect()} == {None, "y"}


def predictions(spark, rows):
    return spark.createDataFrame([("m", f"b{i}", None, [1 - p, p], "review_worthy" if y else "routine") for i, (p, y) in enumerate(rows)], "model string, body_sha256 string, group_id string, probabilities array<double>, reference string")


def test_ties_nulls_and_empty_inputs_of_metrics(spark):
    p = predictions(spark, [(0.5, 1), (0.5, 0), (0.4, 0), (0.0, 0)])
    c = metrics.scored(p).groupBy("model").agg(*metrics.cells()).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (2, 1, 0, 1)
    assert metrics.bins(p).count() == 10 and metrics.bins(p.limit(0)).count() == 0
    none = predictions(spark, [(0.1, 0)])
    s = metrics.policy_scores(metrics.scored(none).withColumn("skipped", F.lit(False)), ["model"]).first()
    assert s.dangerous_miss_rate is None and s.discard_contamination is None and s.workload_reduction == 0
    assert metrics.class_scores(metrics.scored(none).groupBy("model").agg(*metrics.cells())).first().review_f1 == 0


def test_policies_equal_all_cut_offs_tried(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(80)]
    got = {r["policy"]: r for r in policies.fit_policies(predictions(spark, rows)).collect()}
    support = sum(y for _, y in rows)
    for name, bound, by_miss in [("0.01", 0.01, True), ("0.05", 0.05, True), ("skip_0.1", 0.1, False), ("skip_0.3", 0.3, False)]:
        best = 0
        for t in {1 - p for p, _ in rows}:
            hit = [(p, y) for p, y in rows if p < 0.5 and 1 - p >= t]
            if (sum(y for _, y in hit) <= bound * support) if by_miss else len(hit) <= math.floor(bound * len(rows) + 1e-9):
                best = max(best, len(hit))
        assert got[name]["skipped"] == best
        if best == 0:
            assert got[name]["threshold"] == policies.NEVER


def test_temperature_is_near_a_fine_grid(spark):
    rng = random.Random(2)
    rows = [(1 / (1 + math.exp(-z)), int(rng.random() < 1 / (1 + math.exp(-z / 2)))) for z in (rng.gauss(0, 3) for _ in range(300))]
    fit = policies.fit_temperature(predictions(spark, rows)).first()

    def nll(t):
        return sum(math.log1p(math.exp(-(math.log(p / (1 - p)) / math.exp(t)) * (1 if y else -1))) for p, y in rows) / len(rows)

    assert fit.nll == pytest.approx(min(nll(-3 + i / 200) for i in range(1201)), abs=1e-5)


def test_bootstrap_plans_agree(spark):
    rng = random.Random(4)
    p = predictions(spark, [(rng.random(), rng.randrange(2)) for _ in range(50)]).withColumn("group_id", F.concat(F.lit("g"), F.length("body_sha256"), F.substring("body_sha256", 2, 1)))
    cells = [*metrics.CELLS]
    a = {tuple(r) for r in bootstrap.replicates(bootstrap.group_cells(p), 20).select("model", "replicate", *cells).collect()}
    b = {tuple(r) for r in bootstrap.replicates_by_row(p, 20).select("model", "replicate", *cells).collect()}
    assert a == b


def test_whole_intervals_rest_on_all_replicates(spark, sf_dir):
    got = catalogue.QUERIES["bootstrap_intervals"](spark, sf_dir).collect()
    assert got and all(r["replicates"] == 2000 for r in got)


def test_whole_subsets_hold_every_row(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/filing_records.parquet").count()
    got = {r["size"]: r["n"] for r in catalogue.QUERIES["subset_composition"](spark, sf_dir).collect()}
    assert got == {n: n for n in {min(4000, rows), min(16000, rows), rows}}
    scored = {r["model"]: r["n"] for r in catalogue.QUERIES["prediction_rows"](spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    curve = catalogue.QUERIES["learning_curve"](spark, sf_dir).groupBy("model").agg(F.max("size").alias("n")).collect()
    assert scored and {r["model"]: r["n"] for r in curve} == scored


def test_every_row_has_one_control_of_its_kind(spark, tmp_path):
    rows = [("m", "f", None, "t2", "b2", 1), ("m", "f", None, "t1", "b1", 1), ("m", "f", None, "t3", "b3", 2), ("m", "f", "d", "t4", "b4", 3), ("n", None, "d", "t5", "b5", None)]
    spark.createDataFrame(rows, "model string, family string, document_type string, task_id string, body_sha256 string, scored_at long").write.parquet(f"{tmp_path}/prediction_rows.parquet")
    got = {r["task_id"]: (r["control_task_id"], r["control_body_sha256"]) for r in catalogue.QUERIES["matched_controls"](spark, str(tmp_path)).collect()}
    assert got == {"t1": ("t1", "b1"), "t2": ("t1", "b1"), "t3": ("t1", "b1"), "t4": ("t4", "b4"), "t5": ("t5", "b5")}


def test_subdivision_covers_every_day_once(spark):
    rng = random.Random(6)
    days = [(f"2024-{m:02d}-{d:02d}", rng.randrange(1, 9)) for m in (1, 2) for d in range(1, 29)] + [("2024-02-29", 50)]
    df = spark.createDataFrame(days, "day string, n long").withColumn("day", F.to_date("day"))
    got = discovery.subdivide(df, 10).collect()
    assert sum(r["rows"] for r in got) == sum(n for _, n in days)
    assert all(r["rows"] <= 10 or r["capped"] and r["first_day"] == r["last_day"] for r in got)
    assert discovery.subdivide(df.limit(0), 10).count() == 0


def test_crawl_stops_at_depth_and_survives_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "a")], "parent string, child string")
    got = {r["node"]: r["depth"] for r in discovery.crawl(links, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_near_matches_keep_the_smallest_base(spark):
    text = " ".join(f"w{i}" for i in range(60))
    base = spark.createDataFrame([(5, text), (3, text), (9, "other words entirely here now")], "id long, text string")
    cand = spark.createDataFrame([(5, text + " tail"), (6, "nothing alike at all in this one"), (7, text), (8, None)], "id long, text string")
    got = {r["id"]: r["match"] for r in duplicates.near_matches(cand, base).collect()}
    assert got == {5: 3, 7: 3}


def test_record_groups_of_empty_table(spark):
    empty = spark.createDataFrame([], "id long, text string, body_sha256 string, event string")
    assert duplicates.record_groups(empty).count() == 0


def test_features_of_empty_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "ab cd ab"), (2, ""), (3, None), (4, "ab x")], "id long, text string")
    grams = features.ngrams(docs)
    assert {(r["id"], r["term"], r["tf"]) for r in grams.collect()} == {(1, "ab", 2), (1, "cd", 1), (1, "ab cd", 1), (1, "cd ab", 1), (4, "ab", 1)}
    assert [r["term"] for r in features.vocabulary(grams, 4).collect()] == ["ab"]


def test_grid_of_linear_models_is_whole(spark):
    rng = random.Random(8)
    rows = [([rng.gauss(y, 1), rng.gauss(0, 1)], y) for y in (0, 1, 0) for _ in range(20)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    got = features.logistic_grid(df, df).collect()
    assert [(r["c"], r["balanced"]) for r in got] == [(c, b) for c in (0.001, 0.01, 0.1, 1.0, 10.0, 30.0, 100.0) for b in (False, True)]
    assert inspect.signature(features.logistic_grid).parameters["max_iter"].default == 2000 and all(r["converged"] for r in got)


def test_json_lines_keep_their_separators(spark, tmp_path):
    rows = [{"document_id": "a", "body": "x y", "llm": {"label": "routine", "uncertainty": 0.1}}, {"document_id": "b", "body": "z", "llm": {"label": "routine"}}]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + '\n{"document_id": "c", "bo')
    got = files.read_records(spark, str(path), str(tmp_path / "absent.jsonl"))
    assert got.where("corrupt is null").count() == 2 and got.where("document_id = 'a'").first().body == "x y"
    assert files.read_records(spark, str(tmp_path / "absent.jsonl")).count() == 0
    with pytest.raises(ValueError):
        files.read_split(spark, str(path), "0" * 64, 2, R.LABELS)


def test_frozen_and_appended_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    files.write_frozen(df, str(tmp_path / "f"))
    files.write_frozen(df, str(tmp_path / "f"))
    with pytest.raises(FileExistsError):
        files.write_frozen(df.limit(1), str(tmp_path / "f"))
    assert files.append_new(df, str(tmp_path / "a"), "k") == 2
    assert files.append_new(df.union(spark.createDataFrame([("c", 3), ("c", 3)], "k string, n int")), str(tmp_path / "a"), "k") == 1


def test_archives_and_submissions(spark, tmp_path):
    raw = "CONFORMED SUBMISSION TYPE:\t8-K\nACCESSION NUMBER: 1-2\nFILED AS OF DATE: 20260102\n<TEXT>\nbody\n</TEXT>\n<TEXT>no</TEXT>"
    (tmp_path / "s.gz").write_bytes(gzip.compress(raw.encode()))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m1", raw)
        z.writestr("m2", "")
    got = files.read_archives(spark, str(tmp_path)).withColumn("raw", F.col("content").cast("string")).withColumn("s", files.submission_text())
    rows = {r["member"]: r["s"] for r in got.collect()}
    assert set(rows) == {"s", "m1", "m2"} and rows["m1"].text == "body" and rows["s"].filed == "2026-01-02" and rows["m2"].text == ""


def test_paged_source_and_retries(spark, tmp_path):
    for offset, size in [(0, 1), (0, 2), (2, 2), (4, 2)]:
        (tmp_path / f"p{offset}_{size}").write_text(json.dumps({"total": 5, "results": [{"n": i} for i in range(offset, min(5, offset + size))]}))
    paged.register(spark)
    got = spark.read.format("paged").option("url", f"file://{tmp_path}/p{{offset}}_{{size}}").option("pageSize", "2").load()
    assert sorted(json.loads(r["result"])["n"] for r in got.collect()) == [0, 1, 2, 3, 4]
    answers = iter([(503, b""), (429, b""), (200, b"ok")])
    assert paged.fetch(lambda u: next(answers), "u", pause=0) == b"ok"
    with pytest.raises(OSError):
        paged.fetch(lambda u: (404, b""), "u", pause=0)


def test_stream_ingest_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02")], "event_id long, d string").select("event_id", F.to_timestamp("d").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "event_id", "ts").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert windowed_counts(rows, "ts", "event_id", "1 day").count() == 2


def test_banded_index_finds_nine_of_ten(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(150)]
        for edits in (0, 1, 2, 3):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [texts[0], "", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, signature string")
    pairs, members = minhash.search(docs, docs.where("id % 4 = 0"))
    sets = [shingle_set(t or "") for t in texts]
    rep = {r["id"]: r["rep"] for r in members.collect()}
    assert rep[240] == 0 and rep[242] == 241
    want = {(rep[i], rep[j]) for i in range(0, 243, 4) for j in range(243) if rep[i] != rep[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want) > 50 and all(s >= 0.8 - 1e-9 for s in got.values())
    assert minhash.search(docs.limit(0), docs.limit(0))[0].count() == 0


def test_differences_within_tolerances(spark):
    schema = "k string, x double, v array<double>, s struct<a: double, b: string>, n int"
    left = spark.createDataFrame([("a", 1.0, [1.0, 2.0], (1.0, "p"), 1), (None, None, None, None, None), ("c", 1.0, [1.0], (0.5, "q"), 2), ("d", float("nan"), [], (0.0, None), 3)], schema)
    right = spark.createDataFrame([("a", 1.0 + 1e-10, [1.0, 2.0 - 1e-10], (1.0, "p"), 1), (None, None, None, None, None), ("c", 1.1, [1.0, 1.0], (0.5, "r"), 2), ("e", 0.0, [], None, 0), ("d", float("nan"), [], (0.0, None), 3)], schema)
    got = {r["k"]: (r["state"], sorted(r["columns"])) for r in compare.differences(left, right, ["k"]).collect()}
    assert got == {"c": ("differs", ["s", "v", "x"]), "e": ("missing", [])}
    assert compare.differences(left, left, ["k"]).count() == 0 and compare.differences(right, left.limit(0), ["k"]).where("state <> 'extra'").count() == 0


def test_index_files(spark, tmp_path):
    (tmp_path / "form.idx").write_text("Description: index\n\nCIK|Company|Form|Date|File\n-----\n0000320|A Co|8-K|2025-03-01|edgar/data/320/0000000320-25-000001.txt\n77|B|8-K/A|2025-03-02|x/0000000077-25-000002.txt\n78|C|8-K|2024-12-31|x/0000000078-24-000003.txt\n")
    got = index.read_index(spark, str(tmp_path), "8-K", "2025-01-01", "2025-12-31").collect()
    assert [(r["document_id"], r["issuer"], r["company"]) for r in got] == [("sec:0000000320-25-000001", "320", "A Co")]


def test_pooled_windows(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 0.0]]), (2, [[5.0, 6.0]]), (3, []), (4, None)], "id int, w array<array<double>>")
    got = {r["id"]: (r["uniform"], r["attended"]) for r in features.pool_windows(df, "w").collect()}
    assert got[1][0] == [2.0, 1.0] and got[2] == ([5.0, 6.0], [5.0, 6.0]) and got[3] == got[4] == (None, None)
    gate = [z1 - math.log(math.exp(z0) + math.exp(z1)) for z0, z1 in ((1.0, 2.0), (3.0, 0.0))]
    weight = [math.exp(g) / sum(map(math.exp, gate)) for g in gate]
    assert got[1][1] == pytest.approx([weight[0] + 3 * weight[1], 2 * weight[0]])
    moved = features.pool_windows(df.withColumn("w", F.transform("w", lambda z: F.transform(z, lambda x: x + 7))), "w").where("id = 1").first()
    assert moved["attended"] == pytest.approx([x + 7 for x in got[1][1]])


def test_packed_floats_come_back(spark):
    df = spark.createDataFrame([(1, [1.5, -2.25]), (2, []), (3, None)], "id int, v array<float>")
    back = df.select("id", unpack_floats(pack_floats(F.col("v"))).alias("v"))
    assert {r["id"]: r["v"] for r in back.collect()} == {1: [1.5, -2.25], 2: [], 3: None}


def test_calibration_reaches_the_root_of_the_slope(spark):
    rng = random.Random(6)
    p = predictions(spark, [(min(0.999, max(0.001, 0.5 + rng.gauss(0.2 if y else -0.2, 0.3))), y) for y in (0, 1) for _ in range(150)])
    fit, root = policies.fit_temperature(p).first()["log_t"], policies.bisect_temperature(p).first()["log_t"]
    assert abs(fit - root) < 2e-5 and -3 < fit < 3
    c = policies.calibrated(p, policies.fit_temperature(p))
    assert c.where("abs(probabilities[0] + probabilities[1] - 1) > 1e-9").isEmpty()
    rows = policies.with_discards(c, policies.fit_policies(c)).collect()
    assert all(set(r["discard"]) == {"0.01", "0.05", "skip_0.1", "skip_0.2", "skip_0.3"} for r in rows)
    assert sum(r["discard"]["skip_0.2"] for r in rows) <= 0.2 * len(rows)


def test_records_out_of_flat_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, []), (3, None)], "k int, v array<int>")
    assert [tuple(r) for r in discovery.rechunk(df, "k", "v", ["a", "b"]).collect()] == [(1, 0, 1, 2), (1, 1, 3, 4)]
    with pytest.raises(Exception, match="records of 3"):
        discovery.rechunk(df, "k", "v", ["a", "b", "c"]).collect()
