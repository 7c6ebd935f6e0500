"""The pN_ queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.boilerplate import boilerplate_lines, main_text
from quillstone.llm.common import SPACE_CHARS, blank, source_of, table
from quillstone.llm.contamination import cross_split_pairs, overlap_counts, split_sides
from quillstone.llm.lines import repeated_lines, without_repeated_lines
from quillstone.llm.mixing import mixture
from quillstone.llm.neardup import groups_of_two, near_duplicate_groups
from quillstone.llm.pii import personal_information, redact
from quillstone.llm.packing import containers, pack, packed_texts
from quillstone.llm.splits import assign_splits, related_groups
from quillstone.llm.splitting import plan_pieces, split_oversized
from quillstone.llm.tokens import token_totals, tokens_of
from quillstone.staging import stage


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank bodies of the filing records as (id, text)."""
    return table(spark, d, "filing_records").select(F.col("record_id").alias("id"), F.col("body").alias("text")).where(~blank("text"))


def _related(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, d, "filing_records")
    event = F.lower(F.regexp_replace("event_id", f"[{SPACE_CHARS}-]+", ""))
    event = F.when(event.contains(":") & (event != "sec:unknown"), event)
    kind, source = F.coalesce(F.lower(F.trim("document_type")), F.lit("8-k")), source_of()
    family = F.when(source == "sec", F.when(kind == "8-k", "8k").when(kind == "6-k", "6k").when(kind == "corporate_release", "releases").otherwise("other")).when(kind == "news", "news").otherwise(source)
    records = f.select(F.col("record_id").alias("id"), event.alias("event"), F.when(~blank("body"), F.sha2("body", 256)).alias("body"), family.alias("family"), F.col("filing_date").alias("day"))
    return records, related_groups(records, ["event", "body"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d)[1].where("members > 1").select(F.col("id").alias("record_id"), "group_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    records, groups = _related(spark, d)
    return assign_splits(records, groups).select(F.col("id").alias("record_id"), "group_id", "split")


def p1_split_balance(spark: SparkSession, d: str) -> DataFrame:
    records, groups = _related(spark, d)
    rows = assign_splits(records, groups).join(records.select("id", "family", F.substring("day", 1, 4).alias("year")), "id")
    n = F.count(F.lit(1))
    return rows.groupBy("family", "year").agg(n.alias("records"), *[F.round(F.count_if(F.col("split") == s) / n, 4).alias(f"{s}_share") for s in ("train", "validation", "test")])


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Records that got a split, groups that lie in more than one, and families of 300 records or more that miss the shares by over 2 points."""
    records, groups = _related(spark, d)
    split = assign_splits(records, groups).select("id", "group_id", "split")
    mixed = split.groupBy("group_id").agg(F.count_distinct("split").alias("n"), F.count(F.lit(1)).alias("records"))
    shares = split.join(records.select("id", "family"), "id").groupBy("family").agg(F.count(F.lit(1)).alias("n"), *[(F.avg((F.col("split") == s).cast("double")) - share).alias(s) for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1))])
    off = shares.agg(F.count_if((F.col("n") >= 300) & (F.greatest(F.abs("train"), F.abs("validation"), F.abs("test")) > 0.02)).alias("families_off"))
    return mixed.agg(F.sum("records").alias("records"), F.count_if(F.col("n") > 1).alias("mixed_groups")).crossJoin(off)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Every filing record's body as (id, source, text)."""
    return table(spark, d, "filing_records").select(F.col("record_id").alias("id"), source_of().alias("source"), F.col("body").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return plan_pieces(_texts(spark, d)).select(F.col("id").alias("record_id"), "boundary")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_texts(spark, d)).withColumnRenamed("id", "record_id")


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every body put together again from its pieces (as a digest), and whether all pieces and overlaps are within their limits."""
    p = p2_pieces(spark, d).where("text is not null")
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.substring(F.col("text"), F.col("overlap") + 1, F.length("text")).alias("t")))), lambda x: x["t"]), "")
    within = (F.length("text") <= 3000) & (F.col("overlap") <= 200) & ((F.col("piece") > 1) | (F.col("overlap") == 0))
    return p.groupBy("record_id").agg(F.sha2(own, 256).alias("digest"), F.bool_and(within).alias("within"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _bodies(spark, d)
    return docs, split_sides(docs, table(spark, d, "cohort_membership"), table(spark, d, "audit_membership_correction"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(*_sides(spark, d)).select(F.least("train_id", "eval_id").alias("record_a"), F.greatest("train_id", "eval_id").alias("record_b"))


def p3_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "filing_records").select(F.col("record_id").alias("id"), source_of().alias("source"))
    return overlap_counts(*_sides(spark, d), facts)


def p4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "filing_records")
    docs = f.select(source_of().alias("source"), F.lower(F.trim("lang")).alias("lang"), F.coalesce(F.lower(F.trim("document_type")), F.lit("8-k")).alias("document_type"), F.col("body").alias("text"))
    return token_totals(docs, ["source", "lang", "document_type"])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """What the totals rest on, per slice: documents, characters and white-space-led pieces, and whether each piece has a token at least."""
    t = p4_token_budget(spark, d)
    return t.select("source", "lang", "document_type", "documents", "characters", "pieces", (F.col("tokens") >= F.col("pieces")).alias("covered"))


def p4_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filing_records").select("record_id", tokens_of("body").alias("tokens"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(_texts(spark, d)).select(F.col("id").alias("record_id"), "line_no")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(_texts(spark, d)).withColumnsRenamed({"id": "record_id", "text": "body"})


def _pages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "filing_records").where((source_of() != "sec") & F.col("url").isNotNull())
    return f.select(F.col("record_id").alias("id"), source_of().alias("source"), F.col("body").alias("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate_lines(_pages(spark, d)).select(F.col("id").alias("record_id"), "line_no")


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    return main_text(_pages(spark, d)).withColumnsRenamed({"id": "record_id", "text": "body"})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return groups_of_two(near_duplicate_groups(_bodies(spark, d))).select(F.col("id").alias("record_id"), "group_id")


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_bodies(spark, d)).select(F.col("id").alias("record_id"), "class_id", "group_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), source_of().alias("source"), "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(pack(_documents(spark, d)))


def p8_packed_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return packed_texts(docs, pack(docs))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = containers(pack(_documents(spark, d)))
    return rows.groupBy("capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Texts that were placed, and how many faults there are: containers above their capacity, texts not placed whole and once, texts divided that fit a container."""
    docs = _documents(spark, d)
    rows = stage(pack(docs)).frame
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("tokens"), F.sum(F.col("end") - F.col("start")).alias("characters"), F.max("end").alias("end"), F.count_distinct("part").alias("different"))
    texts = docs.where(F.length("text") > 0).select(F.col("id").alias("doc_id"), F.length("text").alias("n"))
    placed = texts.join(per, "doc_id", "left")
    whole = (F.col("characters") == F.col("n")) & (F.col("end") == F.col("n")) & (F.col("parts") == F.col("different"))
    over = containers(rows).agg(F.count_if((F.col("unused") < 0) | (F.col("capacity") > 2048)).alias("overfull"))
    counts = placed.agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("incomplete"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= 2048)).alias("needlessly_divided"))
    return counts.crossJoin(over)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture(_documents(spark, d), table(spark, d, "mix_targets").withColumn("source", source_of()))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_targets_met(spark: SparkSession, d: str) -> DataFrame:
    """Per source: whether its tokens are those wanted but for one document and a 500th, and no document is used more often than permitted."""
    shares = _mixture(spark, d)[1]
    return shares.select("source", "target_share", (F.abs(F.col("used") - F.col("wanted")) <= F.col("largest") + F.col("wanted") / 500).alias("met"), (F.col("repeats") <= F.col("max_repeats")).alias("within_repeats"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(_documents(spark, d)).withColumnRenamed("id", "doc_id")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(_documents(spark, d)).withColumnRenamed("id", "doc_id")


QUERIES = {n: f for n, f in list(globals().items()) if n[0] == "p" and n[1].isdigit()}
