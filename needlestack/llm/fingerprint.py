"""Document fingerprints: every shingle hash below a fixed fraction, by DataFrame functions alone.

A fingerprint keeps the hashes of a document's distinct shingles that lie below one limit,
the same for all documents and sizes, so a longer document keeps more. What is kept depends
on the hash alone, so of a short and a very long document the same shingles are kept, a short
one's containment in a long one can be estimated, and fingerprints of parts merge into that of
the whole (`merge`). A document none of whose hashes is below the limit keeps its least hash,
which says whether two such documents begin alike; it takes no part in counts below the limit.

Written as text: the hashes in ascending order, 12 hexadecimal digits each.

Nulls and the rest: a null text is empty; an empty document has no shingle, is exactly like
another empty one and unlike any other; fewer words than a shingle make one shingle of all;
equal texts have equal fingerprints; of rows with one id the order is that of their texts; a
null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE = 5
BITS = 48
FRACTION = 4
ROWS_PER_RANGE = 2_000
MAX_RANGES = 4_096
BLANKS = "\t\n\x0b\x0c\r"
LIMIT = (1 << BITS) // FRACTION


def _once(value: Column, f) -> Column:
    """f(value), with the value evaluated once: transform over a one-element array."""
    return F.transform(F.array(value), f)[0]


def _below(hashes: Column) -> Column:
    return F.filter(hashes, lambda h: h < LIMIT)


def _kept(hashes: Column) -> Column:
    """Of distinct hashes those below the limit, in order; the least alone if there are none."""
    return _once(_below(hashes), lambda below: F.when(F.size(below) > 0, F.array_sort(below)).when(
        F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(below))


def sketch(text: Column, shingle: int = SHINGLE) -> Column:
    """The kept hashes of a text, in order."""
    words = F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")
    cut = lambda h: F.shiftrightunsigned(h, 64 - BITS)

    def hashes(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))),
                           lambda i: cut(F.xxhash64(*[F.get(w, i + k) for k in range(shingle)])))
        return F.array_distinct(F.when(n == 0, F.array().cast("array<bigint>")).when(
            n < shingle, F.array(cut(F.xxhash64(w)))).otherwise(many))
    return _once(_once(F.transform(words, lambda w: F.xxhash64(w)), hashes), _kept)


def merge(a: Column, b: Column) -> Column:
    """The sketch of a document from the sketches of two parts that together hold all its shingles."""
    return _once(F.array_union(a, b), _kept)


def printed(fingerprint: Column) -> Column:
    """Text form of a sketch."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents, from their sketches. Two empty documents: 1.

    Where neither has a hash below the limit: 1 if their least hashes are equal, else 0."""
    return _once(F.struct(a.alias("a"), b.alias("b"), F.array_intersect(_below(a), _below(b)).alias("same")), lambda p: _once(
        F.struct(F.size(p["same"]).alias("same"), F.size(_below(p["a"])).alias("n"), F.size(_below(p["b"])).alias("m")),
        lambda c: F.when(c["n"] + c["m"] > 0, c["same"] / (c["n"] + c["m"] - c["same"])).otherwise(
            F.when(p["a"] == p["b"], 1.0).otherwise(0.0)).cast("double")))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second one has. An empty first: 1.

    NULL where the first has shingles, but none below the limit: then nothing is known, unless both
    sketches are the same, which gives 1, or the second is empty, which gives 0."""
    return _once(_below(a), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, _below(b))) / F.size(x)).when(
        (F.size(a) == 0) | (a == b), 1.0).when(F.size(b) == 0, 0.0).cast("double"))


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the value: first among every k-th cut, then among k."""
    k = max(1, int(len(cuts) ** 0.5))
    at_most = lambda found: F.size(F.filter(found, lambda c: c <= value))
    array = lambda of: F.array(*map(F.lit, of))
    return _once(at_most(array(cuts[::k])), lambda coarse: F.when(coarse == 0, 0).otherwise(
        (coarse - 1) * k + at_most(F.slice(array(cuts), (coarse - 1) * k + 1, k))))


def with_next(rows: DataFrame, columns: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE,
              made: dict[str, Column] | None = None) -> DataFrame:
    """Adds next_<c>: each row's successor by `order` (the first follows the last), with one shuffle of the rows.

    order[0] is a number. Quantiles of it cut the rows into ranges; a range's first rows also go to the range
    before, so that the window inside a range sees the successor of its last row. Columns `made` from a row
    are added after the shuffle, so that it need not carry them.
    """
    key = F.coalesce(F.col(order[0]).cast("long"), F.lit(-(1 << 63)))
    rows = rows.withColumn("__o", key)
    n = rows.select("__o").count()
    ranges = max(1, min(MAX_RANGES, n // rows_per_range))
    cuts = rows.select(F.percentile_approx("__o", [i / ranges for i in range(ranges)], 10 * ranges + 1000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or [0]))
    # The sketch may miss the lowest row and round large numbers: take each range's first row as its start.
    nearest = _place(F.col("__o"), cuts)
    starts = sorted(r["s"] for r in rows.select("__o", nearest.alias("r")).groupBy("r").agg(F.min("__o").alias("s")).collect())
    own = (_place(F.col("__o"), starts or [0]) - 1).cast("int")
    count = max(1, len(starts))
    place = lambda r, lent: F.struct(r.cast("int").alias("range"), F.lit(lent).alias("lent"))
    is_start = F.get(F.array(*map(F.lit, starts or [0])), F.col("__r")) == F.col("__o")
    rows = rows.withColumn("__r", own).withColumn("__at", F.explode(
        F.when(is_start, F.array(place(F.col("__r"), False), place(F.pmod(F.col("__r") - 1, F.lit(count)), True)))
        .otherwise(F.array(place(F.col("__r"), False)))))
    rows = rows.withColumns({"__r": F.col("__at.range"), "__lent": F.col("__at.lent")}).drop("__at").repartition("__r")
    rows = rows.withColumns(made or {})
    inside = Window.partitionBy("__r").orderBy("__lent", "__o", *order[1:])
    rows = rows.withColumn("__n", F.lead(F.struct(*columns)).over(inside)).where("NOT __lent")
    return rows.select("*", *[F.col(f"__n.{c}").alias(f"next_{c}") for c in columns]).drop("__o", "__r", "__lent", "__n")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n_chars, text, sketch) of every whole text."""
    return measured(docs, id_col, text_col).select("*", sketch(F.col("text"), shingle).alias("sketch"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, text) with nulls as empty texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", F.length("text").cast("long").alias("n_chars"), "text")


def edited(text: Column, n: Column, other: Column) -> Column:
    """The text with its last half replaced by as many first code points of another one, or all it has."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n.cast("int") - half), F.substring(other, F.lit(1), half))
