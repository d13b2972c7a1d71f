"""Shared rows for the corpus tests: nulls, empty and long texts, ties, repeats, clashing columns."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: names that operators use themselves
CLASHES = "rk h sg w lo hi n c bands sketch component comp grp part chunk key want marks later first ids start length score kept rank row block low high need y z f dim bucket raw target trusted span_id kept_id".split()


def prose(n, seed=0, words=400):
    import random

    r = random.Random(seed)
    voc = ["".join(r.choice("aeiourstlnd") for _ in range(r.randint(2, 8))) for _ in range(words)]
    out, cap = [], True
    for _ in range(n):
        w = r.choice(voc)
        out.append(w.capitalize() if cap else w)
        cap = r.random() < 0.1
        if cap:
            out[-1] += "."
    return " ".join(out)


def cases():
    base, passage = prose(200, 1), prose(90, 2)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one"), (9, "One TWO"), (10, "one two"),
        (11, prose(120, 3) + "\n" + passage + "\n" + prose(60, 4)), (12, prose(80, 5) + " " + passage + " " + prose(70, 6)),
        (13, prose(9000, 7)), (14, "the&&& of%%% " * 60), (15, "line a b\nline a b\n\nline a b\n" + prose(60, 8)), (16, "é ß　ǅ  x\x00y\x1cz <|endoftext|> 日本 😀"),
        (None, base), (None, "no id here"), (17, prose(150, 9)), (17, prose(150, 9)), (18, passage), (19, "ab" * 900), (20, "spaces   in \n\n\n rows  "),
        (-5, prose(75, 10)), (2**40, prose(75, 10) + "!"),
    ]
    return [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]


def documents(spark, rows=None, clash=True):
    df = spark.createDataFrame(cases() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def split_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
