"""Columns of every kind and name, and rows that repeat, in the stages of the pipeline."""

from collections import Counter

from pyspark.sql import functions as F

from needlestack.llm import bpe, stages
from needlestack.llm.lines import LineIndex, drop_repeated
from needlestack.llm.mixing import mix, take
from needlestack.llm.substrings import drop_repeats

NAMES = ["copies", "a.b", "row", "k", "k1", "k2", "h", "id", "keys", "nth", "key", "first", "m", "n", "words", "order", "end",
         "component", "size", "target", "kept", "n_lines", "bucket", "unit", "part", "whole", "position", "no_source"]


def widened(docs):
    wide = docs
    for i, name in enumerate(NAMES):
        wide = wide.withColumn(name, F.lit(i))
    return wide.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("list", F.array("doc_id"))


def test_any_columns_pass_through(spark, docs):
    wide = widened(docs)
    assert drop_repeated(wide, LineIndex.build(wide)).count() == docs.count()
    assert drop_repeats(wide).count() == docs.count()
    mixed = take(wide, mix(wide))
    assert mixed.columns == wide.columns
    plain = take(docs, mix(docs))
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(mixed) == ids(plain)
    assert mixed.where("copies <> 0 OR `a.b` <> 1 OR tags['a'] <> doc_id").count() == 0
    kept = stages.ngram_jaccard(spark, wide, "")
    assert kept.columns == wide.columns
    assert ids(kept) == ids(stages.ngram_jaccard(spark, docs, ""))


def test_one_of_each_group_stays_and_wordless_rows_all_stay(spark, docs):
    kept = stages.ngram_jaccard(spark, docs, "").collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[0] == 1                                  # a row that is there three times
    assert all(ids[i] == 1 for i in (200, 201, 202))    # without words
    assert sum(ids[100 + i] for i in range(6)) == 1     # near copies
    assert ids[203] == 1 and ids[204] == 0              # the same text under two ids
    again = stages.ngram_jaccard(spark, docs.unionAll(docs), "").collect()
    twice = Counter(r.doc_id for r in again)
    assert all(twice[i] == 2 for i in (200, 201, 202)) and twice[0] == 1


def test_blocks_of_any_size_decode_alike():
    import public_tokenizers as tokenizers
    merges = bpe.Merges.from_file(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own, back = bpe.Encoder(merges, tokenizers.PATTERN), bpe.Decoder(merges)
    for text in ("", "plain", "größe 漢字 🙂 and é" * 40):
        packed = own.packed(text)
        for block in (1, 2, 3, 8192):
            assert "".join(back.blocks(packed, block)) == text
    assert "".join(back.blocks(own.packed("🙂")[:4])) == "�"


def test_ascii_texts_are_cut_alike():
    import random

    import public_tokenizers as tokenizers
    merges = bpe.Merges.from_file(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = bpe.Encoder(merges, tokenizers.PATTERN)
    assert own.cut_ascii != own.cut_any
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("abZ'stremvl d019 \t\n\r\v\f\x1c\x1f\x00\x7f.,!_-") for _ in range(rng.randint(0, 30)))
        assert own.cut_ascii(text) == own.cut_any(text), text
    assert bpe.ascii_pattern(r"\p{Lu}+") is None
