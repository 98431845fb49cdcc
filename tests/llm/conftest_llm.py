"""Rows the tests share."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
LINE = "a line that stands in many documents"


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 997}" for i in range(n))


def hard_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, foreign scripts."""
    rows = [(i, prose(i, 40 + i) + "\n" + LINE.upper() + "  \n" + prose(i + 50, 30), "en", f"s{i % 4}", 0)
            for i in range(24)]
    rows += [(100 + i, prose(3, 60) + (" x%d" % i if i % 2 else ""), None, "s0", 0) for i in range(6)]
    rows += [(200, None, "en", "s1", None), (201, "", "de", None, 0), (202, " \t\n\v\f\r ", None, None, 0),
             (203, "a", "en", "s1", 1), (204, "a", "en", "s1", 1), (205, "a b c " * 3000, "en", "s2", 0),
             (206, "größe 漢字 🙂 mail me@host.example.org or +1 (988) 555-2485 at 10.0.0.256 and 1.2.3.4", "fr", "s3", 0),
             (207, "card 4041894974608795 <|endoftext|> it's   fine  x", "fr", "", 0), (None, "no id here", "en", "s1", 0)]
    return rows + [rows[0], rows[0]]

