"""Near duplicates and record groups for cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import connected_components
from quillstone.operators.ordering import ordered_digest, rank_in_bucket
from quillstone.operators.records import edges_to_first
from quillstone.operators.similarity import prefixes, shared_needed, similar_pairs, sizes_fit, verify
from quillstone.staging import stage

NEAR = 0.9


def near_pairs(docs: DataFrame, t: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of representatives of equal word-run sets, and memberships (id, class_id, rep)."""
    pairs, reps, p = similar_pairs(docs, t)
    members = p.members.select("id", "class_id").join(reps.select("class_id", F.col("id").alias("rep")), "class_id")
    return pairs, members


def near_matches(candidates: DataFrame, base: DataFrame, t: float = NEAR) -> DataFrame:
    """(id, match) of every candidate (id, text) that is near to some of ``base``; the smallest such base id is kept."""
    both = stage(candidates.select("id", "text", F.lit(0).alias("side")).unionByName(base.select("id", "text", F.lit(1).alias("side")))).frame
    tagged = both.select((F.col("id") * 2 + F.col("side")).alias("id"), "text")
    p = prefixes(tagged, t)
    members = p.members.select("class_id", "id")
    sides = stage(members.groupBy("class_id").agg(F.min("id").alias("rep"), F.max((F.col("id") % 2 == 0)).alias("is_candidate"), F.min(F.when(F.col("id") % 2 == 1, F.col("id"))).alias("least_base"))).frame
    posts = p.written(p.postings().select("token", "class_id", "size", "hot").join(sides, "class_id").select("token", "class_id", "size", "hot", "is_candidate", "least_base"))
    left = posts.each(lambda rows: rows.where("is_candidate").select("token", F.col("class_id").alias("a"), F.col("size").alias("sa")))
    right = posts.each(lambda rows: rows.where("least_base is not null").select("token", F.col("class_id").alias("b"), F.col("size").alias("sb")))
    met = left.join(right).where("a <> b").where(sizes_fit(F.col("sa"), F.col("sb"), t)).groupBy("a", "b", "sa", "sb").count().where(F.col("count") >= shared_needed(F.col("sa"), F.col("sb"), t))
    rep = sides.select("class_id", "rep", "least_base")
    named = stage(met.join(rep.select(F.col("class_id").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("class_id").alias("b"), F.col("rep").alias("rb"), "least_base"), "b").select("a", F.col("ra"), "rb", "least_base")).frame
    sure = verify(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")), tagged, t).select(F.col("a").alias("ra"), F.col("b").alias("rb"))
    found = named.join(sure, ["ra", "rb"]).select(F.col("a").alias("class_id"), "least_base").unionByName(sides.where("is_candidate and least_base is not null").select("class_id", "least_base"))
    best = found.groupBy("class_id").agg(F.min("least_base").alias("m"))
    return members.where("id % 2 = 0").join(best, "class_id").select((F.col("id") / 2).cast("long").alias("id"), ((F.col("m") - 1) / 2).cast("long").alias("match"))


def record_groups(records: DataFrame, aliases: DataFrame | None = None, t: float = NEAR) -> DataFrame:
    """(id, root) of ``records`` (id, text, body_sha256, event): same hash, same event, near text or aliased hashes belong together.

    ``aliases``: (a, b) pairs of body hashes. Root is the smallest id. Null texts and events link nothing.
    """
    with_text = records.where(F.col("text").isNotNull())
    near, members = near_pairs(with_text.select("id", "text"), t)
    links = [near.select("a", "b"), members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), edges_to_first(records, "body_sha256", "id"), edges_to_first(records, "event", "id")]
    if aliases is not None:
        first = records.where("body_sha256 is not null").groupBy("body_sha256").agg(F.min("id").alias("id"))
        links.append(aliases.join(first.select(F.col("body_sha256").alias("a"), F.col("id").alias("ia")), "a").join(first.select(F.col("body_sha256").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    roots = connected_components(reduce(DataFrame.union, links))
    return records.select("id").join(roots, records["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"))


def group_identity(members: DataFrame) -> DataFrame:
    """(root, group_id, members, seen) of ``members`` (id, root, body_sha256, seen): the id is a hash of the sorted member hashes, copies kept.

    Each distinct hash goes in with its count, so a family of copies adds one entry; entries are digested in order by chunks, so
    no group is gathered. ``seen`` if any member was.
    """
    counted = stage(members.groupBy("root", "body_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("seen"))).frame
    digest = ordered_digest(rank_in_bucket(counted.drop("seen"), "root", ["body_sha256"]), "root", "rn", F.concat("body_sha256", F.lit(":"), F.col("n").cast("string")))
    totals = counted.groupBy("root").agg(F.sum("n").alias("members"), F.max("seen").alias("seen"))
    return totals.join(digest.select("root", F.col("digest").alias("group_id")), "root").select("root", "group_id", "members", "seen")
