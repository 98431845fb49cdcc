"""Language identification: n-grams and FTRL against plain loops, held-out quality, hard rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import DOCS, hard_rows
from needlestack.llm import language as L
from needlestack.llm.queries import op11_language_id

LETTERS = L._letters()
TEXTS = ["", " ", "12 34!", "a", "Ab, ab!", "größe ÉTÉ 漢字 x", "  two  words\n", "1" * 30 + " ab" * 9, "z" * 50]


def plain_grams(text):
    clean = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    clean = " " + " ".join(clean.split(" ")).strip() + " "
    clean = " ".join(clean.split())
    if not clean:
        return None
    clean = f" {clean} "
    return Counter(clean[i:i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1) if clean[i:i + n] != " ")


def coordinate(gram):
    """The coordinate an n-gram falls on, one step at a time."""
    mask = (1 << 32) - 1
    h = ord(gram[0]) * int(L.ODD[0]) & mask
    for n, char in enumerate(gram[1:], 1):
        h = ((h ^ h >> 15) * int(L.ODD[n]) + ord(char)) & mask
    h = (h ^ h >> 16) * 0x7FEB352D & mask
    h = (h ^ h >> 15) * 0x846CA68B & mask
    return h >> 32 - L.BITS


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_counts_equal_plain_n_grams_in_slices_of_any_size(monkeypatch, size):
    monkeypatch.setattr(L, "SLICE", size)
    for text in TEXTS:
        grams, got = plain_grams(text), L.counts_of(text, LETTERS)
        if grams is None:
            assert got is None
            continue
        want = Counter()
        for gram, n in grams.items():
            want[coordinate(gram)] += n
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_null_has_no_letter():
    assert L.counts_of(None, LETTERS) is None


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(4)
    size, classes = 6, 3
    fast = L.MultinomialFtrl(size, classes)
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weight(i, c):
        l1, l2 = (0, 0) if i == size else (fast.l1, fast.l2)
        if abs(z[i, c]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i, c]) - z[i, c]) / ((fast.beta + math.sqrt(n[i, c])) / fast.alpha + l2)
    for _ in range(200):
        at = np.append(np.sort(rng.choice(size, 3, replace=False)), size)
        values, label = np.append(rng.random(3), 1.0), int(rng.integers(classes))
        w = [[weight(i, c) for c in range(classes)] for i in at]
        logits = [sum(v * w[k][c] for k, v in enumerate(values)) for c in range(classes)]
        total = sum(math.exp(x) for x in logits)
        for k, i in enumerate(at):
            for c in range(classes):
                g = values[k] * (math.exp(logits[c]) / total - (c == label))
                z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / fast.alpha * w[k][c]
                n[i, c] += g * g
        fast.learn(at, values, label)
    assert np.allclose(fast.z, z, atol=1e-10) and np.allclose(fast.n, n, atol=1e-10)


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(1)
    logits = rng.standard_normal((4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in L.softmax(logits)])
    even = np.ones(len(labels))
    assert abs(L.temperature(logits, labels, even) - 1) < 0.1
    assert abs(L.temperature(logits * 5, labels, even) / L.temperature(logits, labels, even) - 5) < 1e-3
    assert L.temperature(np.empty((0, 3)), labels[:0], even[:0]) == 1.0


def test_document_frequencies_equal_a_plain_count(spark):
    rows = [(t,) for t in TEXTS + TEXTS[:4]] + [(None,)]
    df, n = L.document_frequencies(spark.createDataFrame(rows, "text string").repartition(3))
    want, texts = Counter(), 0
    for (text,) in rows:
        grams = plain_grams(text or "")
        if grams:
            texts += 1
            want.update({coordinate(g) for g in grams})
    assert n == texts and {int(i): int(df[i]) for i in np.flatnonzero(df)} == dict(want)


def test_held_out_quality_and_contract(spark, sf):
    got = op11_language_id(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(langs[r.doc_id] == r.lang_pred for r in held) > 0.95 * len(held)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op11_language_id(spark, sf).collect()))


def test_held_out_labels_are_never_read(spark, docs):
    learn = ~L.held_out()
    spoiled = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = L.train(docs, learn), L.train(spoiled, learn)
    assert a.languages == b.languages and (a.weights == b.weights).all() and (a.idf == b.idf).all()


def test_hard_rows(spark, docs):
    out = L.predict(docs, L.train(docs, F.lit(True))).collect()
    assert len(out) == len(hard_rows())
    by_id = {r.row.doc_id: r for r in out}
    for i in (200, 201, 202):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[203][1:] == by_id[204][1:]
    assert {r.lang_pred for r in out} <= {"en", "de", "fr", "und"}


def test_nothing_to_learn_and_one_language(spark, docs, empty):
    assert L.predict(empty, L.train(empty, F.lit(True))).count() == 0
    none = L.train(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in L.predict(docs, none).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, f"some text {i}", "en", "s", 1) for i in range(9)], DOCS)
    assert {(r.lang_pred, r.score) for r in L.predict(one, L.train(one, F.lit(True))).collect()} == {("en", 1.0)}


def test_a_hot_language_and_a_rare_one(spark):
    rows = [(i, f"the same old words {i % 7}", "en", "s", 1) for i in range(400)]
    rows += [(1000 + i, f"petits mots rares {i}", "fr", "s", 1) for i in range(10)]
    df = spark.createDataFrame(rows, DOCS)
    model = L.train(df, F.lit(True), sample=100, least=10, per_shard=40)
    wrong = [r for r in L.predict(df, model).collect() if r.row.lang != r.lang_pred]
    assert len(wrong) == 0


def test_clashing_names(spark, docs):
    wide = docs
    for name in ("row", "id", "h", "y", "at", "n", "count", "place", "nth", "apart", "logits", "lang_pred", "score", "a.b"):
        wide = wide.withColumn(name, F.lit(1))
    wide = wide.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = L.predict(wide, L.train(wide, F.lit(True)))
    assert out.count() == docs.count() and out.schema["row"].dataType.names == wide.columns
