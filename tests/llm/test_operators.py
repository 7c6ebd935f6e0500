"""The operators for training data against brute force, on awkward and hot inputs."""

import collections
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions.shingling import shingle_set
from quillstone.llm import boilerplate, contamination, lines, mixing, neardup, packing, pii, splits, splitting, tokens
from quillstone.operators import similarity
from quillstone.operators.similarity import shared_needed
from tests.llm.held_out_pages import LATER, PAGES, cases
from tests.llm.unseen_names import NAMES, NOBODY


def roots(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def alike(a, b, t=0.8):
    x, y = shingle_set(a or ""), shingle_set(b or "")
    return len(x & y) >= t * len(x | y) - 1e-12


# 1


def test_related_groups_equal_union_find(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "hot", *[f"e{k}" for k in range(60)]]), rng.choice([None, *[f"b{k}" for k in range(80)]])) for i in range(300)]
    rows += [(1000 + i, f"c{i}", f"d{i}") for i in range(25)] + [(2000 + i, f"c{i + 1}", f"d{i}") for i in range(25)]  # one long chain
    rows += [rows[0], (None, "hot", "b1")]
    df = spark.createDataFrame(rows, "id long, event string, body string").withColumns({"node": F.lit(1), "label": F.lit("x"), "n": F.lit(2), "group_id": F.lit(0)})
    got = {r["id"]: (r["group_id"], r["members"]) for r in splits.related_groups(df, ["event", "body"]).collect()}
    facts = [r for r in rows if r[0] is not None]
    keys = collections.defaultdict(list)
    for i, e, b in facts:
        for k in ((0, e), (1, b)):
            if k[1] is not None:
                keys[k].append(i)
    want = roots([(v[0], x) for v in keys.values() for x in v], {r[0] for r in facts})
    sizes = collections.Counter(want.values())
    assert got == {i: (g, sizes[g]) for i, g in want.items()}
    assert splits.related_groups(df.limit(0), ["event", "body"]).count() == 0


def test_splits_are_whole_and_near_their_shares(spark):
    rng = random.Random(2)
    rows = [(i, i if rng.random() < 0.8 else i - i % 5, rng.choice(["8k", "news"]), f"202{rng.randrange(3, 7)}-0{rng.randrange(1, 10)}-11") for i in range(3000)]
    groups = spark.createDataFrame([(i, g) for i, g, _, _ in rows], "id long, group_id long")
    records = spark.createDataFrame([(i, f, d) for i, _, f, d in rows] + [(9999, None, None)], "id long, family string, day string")
    ids = {g for _, g, _, _ in rows} - {i for i, *_ in rows}
    assert not ids
    out = splits.assign_splits(records, groups).collect()
    assert len(out) == 3000
    by = collections.defaultdict(set)
    for r in out:
        by[r["group_id"]].add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    family = {i: f for i, _, f, _ in rows}
    for f in ("8k", "news"):
        c = collections.Counter(r["split"] for r in out if family[r["id"]] == f)
        n = sum(c.values())
        assert abs(c["train"] / n - 0.8) < 0.04 and abs(c["validation"] / n - 0.1) < 0.03


# 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.! \n\t\xa0 é"), max_size=400), st.integers(5, 40))
def test_pieces_keep_limit_overlap_and_text(text, limit):
    overlap = limit // 4
    level, pieces = splitting.plan(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, back), (s2, e2, back2) in zip(pieces, pieces[1:]):
        assert e == s2 and 0 <= back2 <= overlap and s2 - back2 >= s - back
    assert all(e - s + back <= limit for s, e, back in pieces)
    if all(len(w) <= limit for w in text.split()):
        assert level != "hard"


def test_split_oversized_round_trip_and_edges(spark):
    texts = ["x" * 7000, "para one. " * 200 + "\n\n" + "para two! " * 250, None, "", "short", " " * 5000, ("w" * 2900 + "\r\n") * 3]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, piece long")
    got = collections.defaultdict(list)
    for r in splitting.split_oversized(docs).orderBy("id", "piece").collect():
        got[r["id"]].append(r)
        assert len(r["text"]) <= 3000
    for i, t in enumerate(texts):
        if t is not None:
            assert "".join(r["text"][r["overlap"] :] for r in got[i]) == (t.replace("\r\n", "\n") if len(t) > 3000 else t)
    assert 2 not in got
    assert {r["id"]: r["boundary"] for r in splitting.plan_pieces(docs).collect()} == {0: "hard", 1: "paragraph", 5: "paragraph", 6: "line"}
    assert splitting.split_oversized(docs.limit(0)).count() == 0


# 3 and 7


def corpus(rng, families, copies):
    texts = []
    for _ in range(families):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(30)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


def test_near_duplicate_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(7)
    texts = [*corpus(rng, 20, 5), *corpus(rng, 1, 120), "", None, "---", "One two.", "one TWO", "five words make one run"]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "id long, text string, family string, size int")
    got = {r["id"]: r for r in neardup.near_duplicate_groups(docs).collect()}
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(texts[i], texts[j])]
    assert {i: r["group_id"] for i, r in got.items()} == roots(pairs, range(len(texts)))
    assert all(texts[i] is None or shingle_set(texts[i]) == shingle_set(texts[r["class_id"]] or "") for i, r in got.items())
    assert neardup.near_duplicate_groups(docs.limit(0)).count() == 0


def test_hot_runs_lie_apart_and_lose_nothing(spark, monkeypatch):
    """A run in a fifth of all documents, and short documents that share little else."""
    monkeypatch.setattr(similarity, "HOT_RUN", 8)
    monkeypatch.setattr(similarity, "HOT_SHARE", 10**9)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(11)
    notice = "this notice stands in many texts of the house"
    texts = [*corpus(rng, 12, 6), *corpus(rng, 1, 60)]
    texts = [f"{notice} {t}" if i % 5 == 0 else t for i, t in enumerate(texts)] + [f"{notice} {w}" for w in "abcdefghijkl"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = similarity.prefixes(docs, 0.8)
    assert p.hot_at is not None and p.postings().where("hot").count() > 0
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(texts[i], texts[j])]
    assert {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(docs).collect()} == roots(pairs, range(len(texts)))
    sides = spark.createDataFrame([(i, "train" if i % 2 else "eval") for i in range(len(texts))], "id long, side string")
    assert {tuple(r) for r in contamination.cross_split_pairs(docs, sides).collect()} == {(a, b) if a % 2 else (b, a) for a, b in pairs if a % 2 != b % 2}


def test_families_of_leaders_are_bounded_by_all_their_sizes(spark):
    sizes = spark.range(20, 141, 3).select(F.col("id").alias("q"))
    spans = sizes.crossJoin(spark.range(16, 176, 5).select(F.col("id").alias("lo"))).crossJoin(spark.range(16, 176, 3).select(F.col("id").alias("hi"))).where("lo <= hi and lo >= 0.8 * q and 0.8 * hi <= q")
    every = F.array_min(F.transform(F.sequence("lo", "hi"), lambda m: shared_needed(m, F.col("q"), 0.8)))
    tried = spans.select(neardup.least_shared(F.col("lo"), F.col("hi"), F.col("q"), 0.8).alias("bound"), every.alias("least"))
    assert tried.count() > 1000 and tried.where("bound > least or bound < 1 or bound < least - 1").isEmpty()


def test_member_between_the_sizes_of_its_family_is_asked(spark):
    # 100 and 109 runs are similar from 93 on, with as few as 6 of them in both prefixes; 110 runs need 7.
    tied = [(100 + i, 10 + n, n, 5, 10) for i, n in enumerate((95, 109, 110))] + [(i, 119, 109, 5, 10) for i in range(6)]
    free = [(i, 1, 100, 6, None) for i in range(6)]
    cells = spark.createDataFrame(tied + free, "token long, class_id long, size int, family long, lead long")
    reps = spark.createDataFrame([(1, 1), (10, 10)], "class_id long, rep long")
    docs = spark.createDataFrame([(1, "one two three four five six"), (10, "ten words that are not at all like those")], "id long, text string")
    asked, adopted = neardup._adopt(cells, reps, docs, 0.8, 5)
    assert adopted.isEmpty()
    assert {(r.token, r.q, r.lead) for r in asked.all().collect()} == {(i, 1, 10) for i in range(6)}


def test_cross_split_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [*corpus(rng, 25, 4), "same Text here, today and now", "SAME text here today -- and now!", "a b", "A, b"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id long, text string, side string").drop("side")
    side = {i: rng.choice(["train", "eval", None]) for i in range(len(texts))}
    side[len(texts) - 1], side[len(texts) - 2] = "train", "eval"
    sides = spark.createDataFrame([(i, s) for i, s in side.items() if s] * 2 + [(10**6, "train")], "id long, side string")
    got = {(r["train_id"], r["eval_id"]) for r in contamination.cross_split_pairs(docs, sides).collect()}
    assert got == {(i, j) for i, j in itertools.product(range(len(texts)), repeat=2) if side[i] == "train" and side[j] == "eval" and alike(texts[i], texts[j])}
    assert contamination.cross_split_pairs(docs, sides.limit(0)).count() == 0


def test_removed_bodies_leave_train_in_any_spelling(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    h = docs.select(F.sha2("text", 256)).first()[0]
    member = spark.createDataFrame([(1, "train"), (1, "train"), (2, "Train "), (3, "test"), (None, "train")], "record_id long, cohort string")
    removed = spark.createDataFrame([(f" SHA256:{h.upper()}\xa0",), (None,), ("junk",)], "removed_body_sha256 string")
    assert {(r["id"], r["side"]) for r in contamination.split_sides(docs, member, removed).collect()} == {(2, "train"), (3, "eval")}


# 4


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1'ts .,\n\t\xa0 é漢🙂\x1c\x85"), max_size=80))
def test_pieces_tokenize_as_the_whole(text):
    enc = tokens.encoder()
    assert "".join(tokens.pieces(text)) == text
    assert tokens.count_tokens(text, enc, {}) == len(enc.encode_ordinary(text))


def test_token_totals_equal_whole_texts(spark):
    rows = [("a", "en", "Hello world,  again\n\n x"), ("a", "en", None), (None, "en", "Hello world"), ("b", None, ""), ("a", "en", "z" * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "source string, lang string, text string, tokens int")
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in tokens.token_totals(docs, ["source", "lang"]).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for s, l, t in rows:
        want[s, l][0] += 1
        want[s, l][1] += len(tokens.encoder().encode_ordinary(t or ""))
    assert got == {k: tuple(v) for k, v in want.items()}
    assert tokens.token_totals(docs.limit(0), ["source", "lang"]).count() == 0


# 5


def test_repeated_lines_equal_counting(spark):
    rng = random.Random(3)
    notices = ["Page 3 of 9", "  PAGE\xa012 of 4 ", "Follow us", "12/34", "", "unique"]
    rows = [(i, rng.choice(["s", "t", None]), "\n".join(rng.choice([*notices, f"own {rng.random()} text"]) for _ in range(6))) for i in range(120)] + [(200, "s", None), (201, "s", "")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "id long, source string, text string, nodes int")
    count, size = collections.Counter(), collections.Counter(r[1] for r in rows)
    key = lambda l: re.sub("[0-9]+", "0", " ".join(l.lower().split()))
    for i, s, t in rows:
        count.update({(s, key(l)) for l in (t or "").split("\n") if any(c.isalpha() for c in key(l))})
    often = {k for k, n in count.items() if n >= 10 and n >= 0.02 * size[k[0]]}
    want = {(i, n) for i, s, t in rows for n, l in enumerate((t or "").split("\n"), 1) if (s, key(l)) in often}
    assert want and {(r["id"], r["line_no"]) for r in lines.repeated_lines(docs).collect()} == want
    clean = {r["id"]: r["text"] for r in lines.without_repeated_lines(docs).collect()}
    assert clean == {i: None if t is None else "\n".join(l for n, l in enumerate(t.split("\n"), 1) if (i, n) not in want) for i, s, t in rows}
    assert lines.repeated_lines(docs.limit(0)).count() == 0


# 6

PAGE = """Home | About us | Contact | Search | Help
By Tallow Wire staff, 10:11 UTC

Changes to the reserve requirement in Northport

The board said on Monday, after a long debate, that it would raise the requirement.
Print this page · Follow us · via the app
The measure, which members backed, takes effect in May.

Subordinated loan, net\t12.1\t(3.4)
* first point of the list

Recommended for you on Tallow Wire
Results for another story altogether (3 May)
Costs of a third story in Southport
© 2024 Tallow Wire. All rights reserved."""


def test_boilerplate_around_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE, False), (2, None, True), (3, "", True), (4, "Just one sentence of text.", True)], "id long, text string, own boolean")
    assert {(r["id"], r["line_no"]) for r in boilerplate.boilerplate_lines(pages).collect()} == {(1, n) for n in (1, 2, 7, 13, 14, 15, 16)}
    kept = {r["id"]: r["text"] for r in boilerplate.main_text(pages).collect()}
    assert kept[2] is None and kept[3] == "" and kept[4] == "Just one sentence of text." and kept[1].count("\n") == PAGE.count("\n") - 7
    assert boilerplate.boilerplate_lines(pages.limit(0)).count() == 0


def test_poor_sibling_of_unlisted_links_goes_by_its_points():
    own = "The board said on Monday, after a long debate, that it would raise the requirement, and that members, banks and funds had been told, " * 3
    side = ["Harvest prospects for northern growers", "Roads closed around the old harbour", "Evening concerts in the town hall", "Walks along the restored canal"]
    page = ["Changes to the reserve requirement in Northport", "", own + "as planned.", "", *side, "", "Background to the decision of the board", "", "It takes effect in May."]
    assert [x for x, keep in zip(page, boilerplate.own_lines("\n".join(page))) if not keep] == side
    few = [*page[:4], *side[:2], *page[8:]]
    assert all(boilerplate.own_lines("\n".join(few)))  # headings
    assert all(boilerplate.own_lines("\n".join(["Changes to the reserve requirement in Northport", "", *side, "", "It takes effect in May."])))  # the container itself


def test_pages_in_other_wording():
    for pages in (PAGES, LATER):
        found = wrong = missed = 0
        for page, want in cases(pages):
            got = {i for i, own in enumerate(boilerplate.own_lines("\n".join(page))) if not own}
            found, wrong, missed = found + len(got & want), wrong + len(got - want), missed + len(want - got)
        assert wrong <= 0.05 * (found + wrong) and missed <= (0.05 if pages is PAGES else 0.15) * (found + missed)


def test_points_decide(monkeypatch):
    page, around = next(cases())
    signs = boilerplate._signs
    monkeypatch.setattr(boilerplate, "_signs", lambda x: (signs(x)[0], 0.0, signs(x)[2]))
    assert {i for i, own in enumerate(boilerplate.own_lines("\n".join(page))) if not own} != around


def test_lines_that_a_site_repeats_count_against_them_joined_or_broadcast(spark, monkeypatch):
    text = "Headline of item {0} in full\n\nThe first sentence of item {0} says, after some thought, what happened.\nQuarterly letter of the house"
    words = ["alder", "birch", "cedar", "elm", "fir", "gorse", "hazel", "ivy", "juniper", "larch", "maple", "oak", "pine", "rowan"]
    rows = [(i, "a" if i < 12 else None if i == 12 else "b", text.format(w)) for i, w in enumerate(words)]
    pages = spark.createDataFrame(rows, "id long, source string, text string")
    want = {(i, 4) for i in range(12)}
    assert {tuple(r) for r in boilerplate.boilerplate_lines(pages).collect()} >= want
    first = sorted(map(tuple, boilerplate.marked_lines(pages).collect()), key=str)
    monkeypatch.setattr(lines, "BROADCAST_TEMPLATES", 0)
    assert sorted(map(tuple, boilerplate.marked_lines(pages).collect()), key=str) == first


# 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_respects_capacities(sizes):
    place, capacity = packing.best_fit(sizes, (16, 32, 64))
    used = collections.Counter()
    for n, c in zip(sizes, place):
        used[c] += n
    assert all(used[c] <= cap for c, cap in enumerate(capacity)) and len(used) == len(capacity)
    assert all(cap == min(x for x in (16, 32, 64) if x >= used[c]) for c, cap in enumerate(capacity))


def test_lengths_compete():
    rng = random.Random(9)
    sizes = [min(2048, max(1, int(rng.lognormvariate(5.5, 0.9)))) for _ in range(3000)]
    outcome = {}
    for permitted in ((2048,), packing.CAPACITIES):
        _, opened = packing.best_fit(sizes, permitted)
        outcome[permitted] = sum(map(packing.cost, opened)), 1 - sum(sizes) / sum(opened), collections.Counter(opened)
    (plain, _, _), (joint, unused, opened) = outcome.values()
    assert joint < 0.97 * plain and unused < 0.005 and sum(n > 10 for n in opened.values()) >= 3
    _, long = packing.best_fit(sizes, packing.CAPACITIES, opening=500.0)
    assert sum(c == 2048 for c in long) > 0.9 * len(long)  # dear openings speak for the longest


def test_pack_divides_only_what_is_too_long(spark):
    texts = ["word " * n for n in (5, 3000, 900, 900, 200)] + ["x" * 9000, None, "", "\U0001f642" * 3000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(4, "again", 0)], "id long, text string, part int")
    rows = packing.pack(docs).collect()
    enc = tokens.encoder()
    for i, t in enumerate(texts):
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        if not t:
            assert not parts
        elif i != 4:
            assert "".join(t[r["start"] : r["end"]] for r in parts) == t
            assert all(len(enc.encode_ordinary(t[r["start"] : r["end"]])) <= 2048 for r in parts)
            assert (len(parts) == 1) == (tokens.count_tokens(t, enc, {}) <= 2048)
    filled = packing.containers(packing.pack(docs)).collect()
    assert all(0 <= r["unused"] < r["capacity"] for r in filled)
    assert packing.pack(docs.limit(0)).count() == 0


# 9


def test_mixture_meets_targets_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, "big" if i % 3 else "small", "tok " * rng.randrange(1, 60)) for i in range(1500)] + [(5000, None, "x"), (5001, "other", "x"), (5002, "big", None)]
    docs = spark.createDataFrame(rows, "id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 2), ("absent", 0.1, 2), (None, 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mixture(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"big", "small"}
    assert abs(got["big"]["share"] - 0.4) < 0.01 and abs(got["small"]["share"] - 0.6) < 0.01
    assert got["big"]["repeats"] <= 1 and got["small"]["repeats"] <= 2
    used = collections.Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    assert max(n for (_, s), n in used.items() if s == "small") <= 2
    again, _ = mixing.mixture(docs, targets)
    assert {tuple(r) for r in again.select("doc_id", "copy").collect()} == {tuple(r) for r in mixed.select("doc_id", "copy").collect()}
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0


# 10


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to mara.h@tallow.example or press AT oak DOT test.", [("email", "mara.h@tallow.example"), ("email", "press AT oak DOT test")]),
        ("Call Zoë-Ann O'Brömley on +44 (0)1632 960 158 ext. 7.", [("name", "Zoë-Ann O'Brömley"), ("phone", "+44 (0)1632 960 158")]),
        ("ID on file: QQ 12 34 56 C; holder KELMQVIST, OSKAR.", [("id_number", "QQ 12 34 56 C"), ("name", "KELMQVIST, OSKAR")]),
        ("He resides at Flat 3, 12 Heron Lane, Oakton.", [("address", "Flat 3, 12 Heron Lane")]),
        ("Siège : 31 bis, rue des Herons, 99031 Oakville.", [("address", "31 bis, rue des Herons")]),
        ("wohnhaft Am Beaconplatz 147, Oakstadt; Harbingerstr. 9", [("address", "Am Beaconplatz 147"), ("address", "Harbingerstr. 9")]),
        ("con domicilio en Plaza de Orchard, s/n, Robledo", [("address", "Plaza de Orchard, s/n")]),
        ("Order 555-1141-62, File no. 209-37-8893, CIK 0775146288, @oak_ir, version 2.3@rev5, Hugo & Sons plc", []),
    ],
)
def test_spans(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.find_spans(text)] == want


def test_checksums():
    assert pii.dni_letter("12345678Z") and not pii.dni_letter("12345678A")
    assert pii.nir_key("2 55 08 14 168 025 38") and not pii.nir_key("2 55 08 14 168 025 39")
    assert pii.luhn("4539 1488 0343 6467") and not pii.luhn("4539 1488 0343 6468")


def test_tax_numbers_stand_by_their_check():
    assert pii.tax_id("86 095 742 719") and not pii.tax_id("86 095 742 718") and not pii.tax_id("11 111 111 111")
    assert pii.find_spans("Angegeben war 86095742719, dazu 86095742718.") == [(14, 25, "id_number")]
    assert [s[3] for s in pii._proposals("Steuer-ID: 86 095 742 719") if s[2] == "id_number"] == [0.6, 0.95]
    assert [s[3] for s in pii._proposals("Steuer-ID: 86 095 742 718") if s[2] == "id_number"] == pytest.approx([0.2, 0.6])


@pytest.mark.parametrize("check, text, number", [
    ("dni_letter", "El titular, con documento {}.", "12345678Z"), ("dni_letter", "Entregado a {} ayer.", "12345678Z"), ("nir_key", "Le dossier {} est clos.", "255081416802538"), ("tax_id", "Die Zahl {} steht hier.", "86095742719"),
    ("given_out", "SSN {} is on file.", "123-45-6789"),
])
def test_checks_decide(monkeypatch, check, text, number):
    whole = text.format(number)
    found = [(whole[a:b], k) for a, b, k in pii.find_spans(whole)]
    assert found == [(number, "id_number")]
    monkeypatch.setattr(pii, check, lambda _: False)
    assert not [x for x in pii.find_spans(whole) if x[2] == "id_number"]


@pytest.mark.parametrize("check, text", [("luhn", "The card 4111 1111 1111 1111 expires, passport 378282246310005."), ("iban", "Paid from tax id DE89 3704 0044 0532 0130 00 today.")])
def test_accounts_and_cards_are_none(monkeypatch, check, text):
    assert not pii.find_spans(text)
    monkeypatch.setattr(pii, check, lambda _: False)
    assert pii.find_spans(text)


def test_numbers_with_failing_checks():
    for text in ("DNI 12345678A", "SSN 999-99-9999", "SSN 000-12-3456", "SSN 666-12-3456", "SSN 123-00-4567", "nir 255081416802539", "nif 86095742710"):
        assert not pii.find_spans(text), text
    assert pii.find_spans("numéro de sécurité sociale 255081416802539") and pii.find_spans("Steuer-ID 86 095 742 710")  # mistyped, but there's no doubt about the label


def test_names_that_no_list_holds():
    found = 0
    for line in NAMES.split("\n"):
        text, name = line.split("|")
        assert not any(name.split()[0] == g for g in pii._GIVEN)
        found += [text[a:b] for a, b, k in pii.find_spans(text) if k == "name"] == [name]
    assert found >= 0.9 * len(NAMES.split("\n"))
    assert not [x for line in NOBODY.split("\n") for x in pii.find_spans(line)]


def test_redaction_leaves_the_rest(spark):
    text = "Mail a@b.example now. Call Rosa Kelm on 01632 960158."
    docs = spark.createDataFrame([(1, text, None), (2, None, None), (3, "", None), (4, "nothing here", None)], "id long, text string, spans string")
    got = {r["id"]: (r["text"], r["replaced"]) for r in pii.redact(docs).collect()}
    assert got[1] == ("Mail [EMAIL] now. Call [NAME] on [PHONE].", 3) and got[3] == ("", 0) and got[4] == ("nothing here", 0) and got[2][0] is None
    assert pii.personal_information(docs.limit(0)).count() == 0
