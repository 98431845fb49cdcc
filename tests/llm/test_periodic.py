"""Runs against a plain search, and extensions on the grammar against plain comparison."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import hard_rows
from needlestack.llm.periodic import collapsed, find_runs, periodic_runs
from needlestack.llm.queries import op12_periodic_runs
from needlestack.llm.recompression import Grammar
from needlestack.llm.text import words_of


def plain_runs(words, repeats=4, shortest=6):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(shortest, repeats * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def drawn(rng):
    n, kinds = rng.choice([0, 1, 2, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 8, 50])
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_equal_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        texts = [drawn(rng) for _ in range(rng.randint(0, 6))]
        repeats, shortest = rng.choice([(4, 6), (2, 2), (3, 5)])
        got = find_runs(texts, repeats, shortest, chunk=rng.choice([8, 50, 400_000]))
        assert [[tuple(map(int, r)) for r in g] for g in got] == [plain_runs(t, repeats, shortest) for t in texts]


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 4):
        lengths = np.array([0, 1, 40, 300])
        words = rng.integers(0, kinds, lengths.sum())
        grammar = Grammar(words, lengths)
        a, b = rng.integers(0, len(grammar.text), (2, 2000))
        a, b = a[a != b], b[a != b]
        text = grammar.text

        def plain(i, j, step):
            n = 0
            while 0 <= i < len(text) and 0 <= j < len(text) and text[i] == text[j]:
                i, j, n = i + step, j + step, n + 1
            return n
        assert grammar.forward(a, b).tolist() == [plain(i, j, 1) for i, j in zip(a, b)]
        assert grammar.backward(a, b).tolist() == [plain(i, j, -1) for i, j in zip(a, b)]


def test_collapsed_keeps_one_period():
    words = b"x a b a b a b a b y".split()
    assert collapsed(words, find_runs([words])[0]) == b"x a b y"


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = edited(doc_id, words_of(text))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha(b"".join(b"%d,%d,%d\n" % r for r in runs)),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def same(rows, texts):
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, rows), key=order) == sorted((expected(i, t) for i, t in texts), key=order)


def test_query_equals_plain_search(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 20000")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    same(got.collect(), texts)


def test_hard_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(op12_periodic_runs(spark, str(tmp_path)).collect(), [r[:2] for r in hard_rows()])


def test_empty_table_and_clashing_names(spark, docs, empty):
    assert periodic_runs(empty).count() == 0
    wide = docs
    for name in ("row", "runs", "n_words", "collapsed", "words", "start", "a.b", "text_"):
        wide = wide.withColumn(name, F.lit(1))
    wide = wide.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = periodic_runs(wide)
    assert out.count() == docs.count()
    assert set(out.schema["row"].dataType.names) == set(wide.columns) - {"text"}
    with pytest.raises(ValueError):
        periodic_runs(docs, repeats=1)
