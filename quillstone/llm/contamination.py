"""Records of evaluation splits that also occur, exactly or almost, in the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.similarity import prefixes, representatives, shared_needed, sizes_fit, verify
from quillstone.staging import stage


def linked_classes(docs: DataFrame, sides: DataFrame, t: float = 0.8, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Classes of equal records with similarity t or more, a of the training and b of the evaluation side, and the records (id, class_id, side) behind them.

    ``sides``: (id, side) with side ``train`` or ``eval``. Records are canonicalised (case, punctuation and
    white space) and hashed; evaluation hashes joined with training hashes give the equal ones. For the
    others the hashes of the canonicalised records' word runs are joined in the same way, those of the prefix
    only, and what reaches the exact bound is held against the texts. Null or wordless texts equal each
    other, so leave blank ones out before; ids without a side or text are ignored; repeated rows count once.
    """
    p = prefixes(docs, t, k)
    placed = stage(p.members.select("id", "class_id").join(sides.select("id", "side").distinct(), "id"))
    flags = stage(placed.frame.groupBy("class_id").agg(F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") == "eval").alias("eval")))
    equal = flags.frame.where("train and eval").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))

    held = p.written(p.postings().select("token", "class_id", "size", "hot").join(flags.frame, "class_id"))
    left = held.each(lambda rows: rows.where("train").select("token", F.col("class_id").alias("a"), F.col("size").alias("size_a")))
    right = held.each(lambda rows: rows.where("eval").select("token", F.col("class_id").alias("b"), F.col("size").alias("size_b")))
    met = left.join(right).where("a <> b").where(sizes_fit(F.col("size_a"), F.col("size_b"), t))
    near = met.groupBy("a", "b", "size_a", "size_b").count().where(F.col("count") >= shared_needed(F.col("size_a"), F.col("size_b"), t))

    reps = representatives(p.members).select("class_id", "id")
    named = near.join(reps.select(F.col("class_id").alias("a"), F.col("id").alias("ra")), "a").join(reps.select(F.col("class_id").alias("b"), F.col("id").alias("rb")), "b")
    found = stage(named.select(F.col("ra").alias("a"), F.col("rb").alias("b"), F.col("a").alias("class_a"), F.col("b").alias("class_b")))
    each = verify(found.frame.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, t, k).select("a", "b")
    sure = found.frame.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(each.select(F.col("a").alias("lo"), F.col("b").alias("hi")), ["lo", "hi"])
    classes = stage(sure.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).union(equal))
    return classes.frame, placed.frame


def cross_split_pairs(docs: DataFrame, sides: DataFrame, t: float = 0.8, k: int = 5) -> DataFrame:
    """(train_id, eval_id) of all records of ``docs`` (id, text) on different sides (id, side) with similarity t or more: the linked classes, expanded."""
    classes, placed = linked_classes(docs, sides, t, k)
    train = placed.where("side = 'train'").select(F.col("class_id").alias("a"), F.col("id").alias("train_id"))
    evaluation = placed.where("side = 'eval'").select(F.col("class_id").alias("b"), F.col("id").alias("eval_id"))
    return classes.join(train, "a").join(evaluation, "b").select("train_id", "eval_id")


def overlap_counts(docs: DataFrame, sides: DataFrame, facts: DataFrame, t: float = 0.8, k: int = 5) -> DataFrame:
    """Records of the evaluation side, those that overlap with training records, and the pairs, per cohort and source.

    ``sides``: (id, side, cohort); ``facts``: (id, source). Copies are counted per class before classes are joined, so no pair of records is ever made.
    """
    classes, placed = linked_classes(docs, sides.select("id", "side"), t, k)
    held = placed.where("side = 'train'").groupBy(F.col("class_id").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    partners = classes.join(held, "a").groupBy(F.col("b").alias("class_id")).agg(F.sum("n").alias("partners"))
    evaluated = sides.where("side = 'eval'").join(facts.select("id", "source"), "id")
    per_class = evaluated.join(placed.where("side = 'eval'").select("id", "class_id"), "id", "left").groupBy("class_id", "cohort", "source").agg(F.count(F.lit(1)).alias("records"))
    counted = per_class.join(partners, "class_id", "left")
    sums = [F.sum("records").alias("records"), F.coalesce(F.sum(F.when(F.col("partners").isNotNull(), F.col("records"))), F.lit(0)).alias("overlapping"), F.coalesce(F.sum(F.col("records") * F.col("partners")), F.lit(0)).alias("pairs")]
    return counted.groupBy("cohort", "source").agg(*sums)


def clean_digest(column: str):
    """A SHA-256 in any spelling: without blanks, prefix and case."""
    return F.regexp_extract(F.regexp_replace(F.lower(F.col(column)), r"[\s\xa0]+", ""), "([0-9a-f]{64})$", 1)


def split_sides(docs: DataFrame, membership: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, side, cohort) of the records with a cohort; those whose body hash is among ``removed`` have left train."""
    gone = removed.select(clean_digest("removed_body_sha256").alias("digest")).where("digest <> ''").distinct()
    one = membership.select(F.col("record_id").alias("id"), F.lower(F.trim("cohort")).alias("cohort")).where("id is not null").distinct()
    digests = docs.select("id", F.sha2("text", 256).alias("digest"))
    left = digests.join(gone, "digest", "left_semi").select("id")
    train = one.where("cohort = 'train'").join(left, "id", "left_anti").select("id", F.lit("train").alias("side"), "cohort")
    return train.union(one.where("cohort in ('validation', 'test')").select("id", F.lit("eval"), "cohort"))
