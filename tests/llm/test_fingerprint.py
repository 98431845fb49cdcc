"""Fingerprints against sets of shingles in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from needlestack.llm import fingerprint as fp, queries
from conftest_llm import DOCS


def words_of(text):
    for blank in "\t\n\v\f\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def shingles(text):
    w = words_of(text or "")
    return {tuple(w)} if 0 < len(w) < fp.SHINGLE else {tuple(w[i:i + fp.SHINGLE]) for i in range(len(w) - fp.SHINGLE + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def random_text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def pairs(spark):
    """(left, right) texts: unrelated, equal, partly shared and very unequal in length, empty and short."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        a = random_text(rng, rng.choice((100, 200, 400)))
        share = rng.random()
        w = words_of(a)
        rows.append((i, a, " ".join(w[:int(len(w) * share)]) + " " + random_text(rng, rng.choice((50, 200)))))
    long = random_text(rng, 20_000)
    w = words_of(long)
    for i in range(60):
        at = rng.randrange(19_000)
        rows.append((200 + i, " ".join(w[at:at + rng.choice((0, 60, 120, 240))]) + " " + random_text(rng, 120), long))
    rows += [(300 + i, random_text(rng, 12), long) for i in range(100)]
    rows += [(900, "", ""), (901, None, "a b"), (902, "a b", ""), (903, "a b", "a b"), (904, "a b", "a c")]
    df = spark.createDataFrame(rows, "i int, l string, r string").repartition(8)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.select("i", "l", "r", fp.sketch(text("l")).alias("a"), fp.sketch(text("r")).alias("b"))
    return df.select("*", fp.likeness(F.col("a"), F.col("b")).alias("like"),
                     fp.containment(F.col("a"), F.col("b")).alias("inside")).collect()


def test_one_limit_for_every_size(pairs):
    """A sketch holds what lies below the limit, however long the text; only none at all leaves the least."""
    share = []
    for p in pairs:
        for text, kept in ((p.l, p.a), (p.r, p.b)):
            n = len(shingles(text))
            assert kept == sorted(set(kept)) and len(kept) <= n and bool(kept) == bool(n)
            assert all(h < fp.LIMIT for h in kept) or len(kept) == 1
            if n > 5_000:
                share.append(len(kept) / n)
    assert all(abs(s - 1 / fp.FRACTION) < 0.02 for s in share)


def test_likeness_and_containment(pairs):
    near, unequal, unrelated = [], [], []
    for p in pairs:
        a, b = shingles(p.l), shingles(p.r)
        assert 0 <= p.like <= 1 and (p.inside is None or 0 <= p.inside <= 1)
        if p.i < 200:
            near.append(abs(p.like - jaccard(a, b)))
        elif p.i < 300:
            unequal.append(abs(p.inside - len(a & b) / len(a)))
        elif p.i < 900:
            unrelated.append(p.inside)
    assert sum(near) / len(near) < 0.05 and max(near) < 0.25
    assert sum(unequal) / len(unequal) < 0.06 and max(unequal) < 0.3
    # Short documents against a long unrelated one: 0, or NULL where nothing is kept; never 1.
    assert set(unrelated) <= {0.0, None} and unrelated.count(0.0) > 70
    edge = {p.i: (p.like, p.inside) for p in pairs if p.i >= 900}
    assert edge[900] == (1.0, 1.0) and edge[901] == (0.0, 1.0) and edge[902] == (0.0, 0.0) and edge[903] == (1.0, 1.0)
    assert edge[904][0] == 0.0 and not edge[904][1]


def test_merge(spark):
    """Parts that overlap by a shingle less one word merge into the whole's sketch, in any order, again and again."""
    rng = random.Random(6)
    rows = []
    for i, n in enumerate((1, 4, 9, 10, 30, 300, 3000)):
        w = words_of(random_text(rng, n))
        cut = n // 2
        rows.append((i, " ".join(w), " ".join(w[:cut + fp.SHINGLE - 1]) if n > fp.SHINGLE else " ".join(w),
                     " ".join(w[cut:]) if n - cut >= fp.SHINGLE else ""))
    rows.append((99, "", "", ""))
    got = spark.createDataFrame(rows, "i int, whole string, one string, two string").select(
        "i", *[fp.sketch(F.col(c)).alias(c) for c in ("whole", "one", "two")]).select(
        "*", fp.merge(F.col("one"), F.col("two")).alias("m"), fp.merge(F.col("two"), F.col("one")).alias("n"),
        fp.merge(F.col("whole"), F.col("one")).alias("same")).collect()
    for r in got:
        assert r.m == r.n == r.same == r.whole


def test_query_edits_and_neighbours(spark, docs, tmp_path):
    """Every column that has one exact answer, and the error of the likenesses, on awkward rows."""
    rows = {r.doc_id: r for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    spark.createDataFrame(list(rows.values()), DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, str(tmp_path)).collect()}
    ids, errors = sorted(rows), []
    assert sorted(got) == ids
    for i, d in enumerate(ids):
        text, after = rows[d].text or "", rows[ids[(i + 1) % len(ids)]].text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(abs(got[d].near_edited - jaccard(shingles(text), shingles(edited))))
        errors.append(abs(got[d].near_next - jaccard(shingles(text), shingles(after))))
        for other in ids:
            if (rows[other].text or "") == text:
                assert got[other].fingerprint == got[d].fingerprint
    assert sum(errors) / len(errors) < 0.06


def test_search_among_cuts(spark):
    rng = random.Random(7)
    for n in (1, 2, 3, 10, 101):
        cuts = sorted(rng.sample(range(1000), n))
        values = spark.range(-1, 1001)
        for r in values.select("id", fp._place(F.col("id"), cuts).alias("p")).collect():
            assert r.p == sum(c <= r.id for c in cuts)
