"""Features: n-gram weights, pooled and scaled vectors, linear models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.vectors import ratio0
from quillstone.session import spread


def ngrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf): words of two or more characters and pairs of them, counted per document."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    held = spread(docs).select("id", tokens.alias("t"))
    pairs = F.transform(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(F.col("t"), i + 1)))
    return held.select("id", F.explode_outer(F.concat("t", pairs)).alias("term")).where("term is not null").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(grams: DataFrame, documents: int, min_df: int = 2, most: int = 100_000) -> DataFrame:
    """(term, df, total, idf): terms in at least ``min_df`` documents, the ``most`` frequent, ties by name; idf smoothed, plus 1."""
    terms = grams.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    top = terms.orderBy(F.desc("total"), "term").limit(most)
    return top.withColumn("idf", F.ln((1 + F.lit(float(documents))) / (1 + F.col("df"))) + 1)


def tfidf(grams: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, weight): tf times idf at length 1 per document."""
    raw = grams.join(vocab.select("term", "idf"), "term").withColumn("x", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))  # a document's terms, and one shuffle
    return raw.select("id", "term", (F.col("x") / length).alias("weight"))


def standardized(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, dim, value) with mean 0 and population deviation 1 per dimension; constant dimensions are 0."""
    long = df.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(F.broadcast(stats), "dim").select(key, "dim", ratio0(F.col("x") - F.col("m"), F.col("s")).alias("value"))


def mean_pool(df: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, pooled): the mean vector of each group, at length 1."""
    long = df.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = long.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    return long.join(size, by).select(by, "dim", ratio0(F.col("m"), F.col("length")).alias("value"))


def class_weights(labels: DataFrame, power: float = 1.0) -> DataFrame:
    """(label, n, weight): (total / (classes * n)) ** power, scaled so that the mean over rows is 1."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    raw = n.join(F.broadcast(t)).withColumn("raw", F.pow(F.col("total") / (F.col("k") * F.col("n")), F.lit(power)))
    mean = raw.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("mean"))
    return raw.join(F.broadcast(mean)).select("label", "n", (F.col("raw") / F.col("mean")).alias("weight"))


def pool_windows(df: DataFrame, windows: str) -> DataFrame:
    """``df`` with ``uniform`` and ``attended``: a row of logits from the rows in the array column ``windows``.

    ``uniform`` is their mean. ``attended`` weighs them by a softmax over the windows of the last entry of each window's log softmax, so
    that an offset common to a window's logits changes nothing. No windows give null.
    """
    w = F.col(windows)
    gate = F.transform(w, lambda z: F.element_at(z, -1) - F.array_max(z) - F.ln(F.aggregate(F.transform(z, lambda x: F.exp(x - F.array_max(z))), F.lit(0.0), lambda a, x: a + x)))
    even = F.transform(w, lambda _: F.lit(1.0))
    weights = F.transform(F.col("__gate"), lambda g: F.exp(g - F.array_max("__gate")))

    def weighed(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        dims = F.sequence(F.lit(0), F.size(w[0]) - 1)
        return F.when(F.size(w) > 0, F.transform(dims, lambda i: F.aggregate(F.zip_with(w, v, lambda z, x: F.get(z, i) * x), F.lit(0.0), lambda a, x: a + x) / total))

    return df.withColumn("__gate", gate).withColumns({"uniform": weighed(even), "attended": weighed(weights)}).drop("__gate")


def logistic_slopes(train: DataFrame, grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 30.0, 100.0), balanced: tuple[bool, ...] = (False, True), max_iter: int = 2000) -> DataFrame:
    """(c, balanced, slope): the largest entry of the slope of the penalised mean loss where each fit of ``logistic_grid`` ends; a check of its optimum."""
    fit = train.select(array_to_vector("x").alias("features"), "x", F.col("y").cast("double").alias("label")).cache()
    n, counts = fit.count(), {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    rows = []
    for c in grid:
        for even in balanced:
            model, weight = _fit(fit, c, even, n, counts, max_iter)
            w = [float(x) for x in model.coefficients]
            z = F.aggregate(F.zip_with("x", F.array(*[F.lit(x) for x in w]), lambda a, b: a * b), F.lit(float(model.intercept)), lambda a, x: a + x)
            error = (1 / (1 + F.exp(-z)) - F.col("label")) * weight
            sums = fit.withColumn("__e", error).agg(F.sum("__e").alias("bias"), F.sum(weight).alias("weight"), *[F.sum(F.col("__e") * F.get("x", i)).alias(f"g{i}") for i in range(len(w))]).first()
            slopes = [sums["bias"] / sums["weight"], *[sums[f"g{i}"] / sums["weight"] + x / (c * n) for i, x in enumerate(w)]]
            rows.append((float(c), even, max(map(abs, slopes))))
    fit.unpersist()
    return train.sparkSession.createDataFrame(rows, "c double, balanced boolean, slope double")


def _fit(fit: DataFrame, c: float, even: bool, n: int, counts: dict, max_iter: int):
    """An L2 logistic fit, classes weighed alike if ``even``, and the weight of each row."""
    weight = F.when(F.col("label") == 1, n / (2.0 * counts.get(1.0, 1))).otherwise(n / (2.0 * counts.get(0.0, 1))) if even else F.lit(1.0)
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, weightCol="w").fit(fit.withColumn("w", weight)), weight


def logistic_grid(train: DataFrame, selection: DataFrame, grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 30.0, 100.0), balanced: tuple[bool, ...] = (False, True), max_iter: int = 2000) -> DataFrame:
    """(trial, c, balanced, iterations, converged, macro_f1) of L2 logistic fits on array column x and label y (0 or 1).

    Inverse strength c over n rows is MLlib's regParam 1 / (c n). The best trial is the converged one with the highest macro F1 on
    ``selection``, the first on ties: see ``best_trial``.
    """
    fit = train.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")).cache()
    held = selection.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")).cache()
    n, counts = fit.count(), {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    rows = []
    for trial, (c, even) in enumerate((c, b) for c in grid for b in balanced):
        model, _ = _fit(fit, c, even, n, counts, max_iter)
        done = model.summary.totalIterations
        guess = model.transform(held)
        x = guess.agg(*[F.count_if((F.col("label") == t) & (F.col("prediction") == g)).alias(k) for k, (t, g) in {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}.items()]).first()
        f1 = [2 * a / d if (d := 2 * a + x.fp + x.fn) else 0.0 for a in (x.tn, x.tp)]
        rows.append((trial, float(c), even, int(done), done < max_iter, sum(f1) / 2))
    fit.unpersist()
    held.unpersist()
    return train.sparkSession.createDataFrame(rows, "trial int, c double, balanced boolean, iterations int, converged boolean, macro_f1 double")


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.where("converged").orderBy(F.desc("macro_f1"), "trial").limit(1)
