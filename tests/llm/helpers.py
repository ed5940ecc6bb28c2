"""Small documents with awkward cases, and readers of results."""

import random

WORDS = "the of and to in that is was he for it with as his on be at by had not".split()


def awkward(extra: int = 60, seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source) rows: nulls, empty, long, copies, repeated rows, odd letters."""
    dice = random.Random(seed)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one", "en", "b"),
        (5, "Two Words", None, "b"), (6, "é É ñ 漢字 \U0001f600 x", "fr", None), (7, "12345 -- !!", "en", "c"),
        (None, "no id here at all", "en", "a"), (None, "no id here at all", "en", "a"), (8, "x" * 30000, "en", "a"),
        (9, " ".join(WORDS * 2000), "en", "a"), (10, "one", "en", "b"), (10, "one", "en", "b"), (11, "▁ a ▁▁b", "de", "d"),
    ]
    for n in range(extra):
        text = " ".join(dice.choices(WORDS, k=dice.randint(1, 60)))
        rows.append((100 + n, text, dice.choice(["en", "fr"]), dice.choice("abc")))
        if n % 5 == 0:
            rows.append((1000 + n, text, "en", "a"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def clashing(docs, names):
    """``docs`` with further columns called like outputs and helpers."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def plain(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
