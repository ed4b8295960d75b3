"""Rows and plain-Python counterparts shared by the tests of the training-data operators."""

import re

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket int, size int, rank int, _s string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def edge_rows():
    """Null, empty, blank, one-word, long, repeated and tied rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "One", "b"), (5, long, "b"), (6, base, "c"), (7, base.upper(), "c"),
             (8, base + " phi", "a"), (9, base, None), (9, base, None), (10, "é ü 漢字 \U0001F600 fin", "é"), (11, "x y  z  <|endoftext|> q", "a"),
             (None, base + " chi psi", "b"), (12, "line one\nline one\n\nline two", "Z"), (13, long + " end", "b"), (-5, "minus five words are here", "a")]
    return [(i, t, "en", s, 0, "n", 1, 2, 3, "s") for i, t, s in texts]


def local_frame(spark, rows, schema):
    struct = spark.createDataFrame([], schema).schema
    table = pa.Table.from_pylist([dict(zip(struct.names, r)) for r in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, struct)


def frame(spark, rows):
    """(doc_id, text, source) rows as a table of documents."""
    return local_frame(spark, [(i, t, "en", s, len(t or ""), "n", 1, 2, 3, "s") for i, t, s in rows], DOCS)
