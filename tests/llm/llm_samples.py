"""Sample documents for these tests."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: documents' columns, and two whose names clash with what operators make.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("size", "score", "g", "spans", "_id")]
)


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies, odd characters."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, base = prose(60), prose(120)
    near = base.split()
    near[50] = "changed"
    texts = [
        None, "", " \n\t ", "one", "one two three", "one two three four five", prose(30), base, base, base.upper(), " ".join(near), prose(40) + " " + shared + "\n" + prose(10), shared + " " + prose(50),
        prose(5000), "a " * 300, "abc" * 5000, "x" * 99, "y" * 100, "z" * 101, "line\nline\n\nline\nother line", "mail a.b@mail.example.com or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111",
        "日本語 テキスト　全角 \U0001f600 é", "token <|endoftext|> here", "you idiot and trash " + prose(20), prose(34), prose(35),
    ]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "a")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[7], (None, prose(50), "en", "a", 1), (10**12, base, None, None, None)]
    return [(*x, "s", "0.5", "g", "spans", "id") for x in out]
