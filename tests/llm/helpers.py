"""Small document tables for the operators' tests, and brute-force versions."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def passage(seed: int, n: int) -> str:
    """n pseudo-random words; different seeds share no long run."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 1024 % 10))
    return " ".join(out)


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) as documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = passage(1, 6000)
    rows = [
        (1, None, None, None, None), (None, "one two", "en", "a", 7), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)),
        (6, "same text here", "en", "b", 14), (6, "same text here", "en", "b", 14), (7, "é" * 50 + "\U0001f600 tail", "fr", "c", 56), (8, "x", None, "c", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """``df`` with columns named like those that operators add."""
    from pyspark.sql import functions as F

    extra = "score spans blob w n node t key regs raw ids decoded n_tokens epoch place mix_block mix_key n_lines n_dropped media n_bytes _n _id".split()
    return df.withColumns({c: F.lit("x") for c in extra})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
