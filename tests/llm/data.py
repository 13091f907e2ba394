"""Small tables with the rows that operators must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ("size", "copies", "_k", "_h", "h", "fp", "root", "drop", "shard", "score", "_score", "_row", "g", "n", "salt", "line", "_k1", "rank")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


def rows(n=60, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(words(rng, rng.randint(1, 40)) + "." for _ in range(rng.randint(1, 5)))
        out.append([i, text, "en", f"src{rng.randint(0, 3)}"])
    boiler = "this boilerplate line is found in many of the documents of this table"
    for i in range(5, 15):
        out[i][1] += "\n" + boiler
    for i in range(20, 26):
        out[i][1] = out[20][1]
    out += [
        [100, None, None, None], [101, "", "en", "src0"], [102, "", "en", None], [103, "   \n \t ", "en", "src1"],
        [104, words(rng, 30_000), "en", "src1"], [105, "é" * 50 + " ß   x", "de", "src2"],
        [106, out[1][1], "en", "src2"], [106, out[1][1], "en", "src2"], [107, "one two", "en", "src0"],
        [None, "a row without an id", "en", "src0"], [None, None, None, None], [None, "a row without an id", "en", "src0"],
    ]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in out]


def docs(spark, n=60, seed=0):
    return spark.createDataFrame(rows(n, seed), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"x{c}") for c in CLASHING})


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
