"""Rows that operators must bear: nulls, blanks, ties, repeats, long texts, columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

WORDS = "the of and to in is that for was with alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k)) + "."
    rows = [(i, text(rng.randrange(1, 120)), rng.choice(["en", "de"])) for i in range(n)]
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, " \n\t ", "en"), (n + 3, "x", "de"), (n + 4, "...", "en")]
    rows += [(n + 5, rows[3][1].replace(" ", "  "), "en"), (n + 6, rows[3][1], "en"), rows[5], (n + 7, rows[7][1] + " omega", "en")]
    rows += [(n + 8, text(30_000), "en"), (n + 9, "z" * 20_000, "en"), (n + 10, "Ünïcödé ﬁ 中文 🙂 <|endoftext|> É", "de")]
    return rows


#: Columns that operators use inside or return, to clash with.
EXTRA = ("kept", "score", "_id", "_text", "fp", "component_id", "sequence_id", "ids", "labels", "rank", "h")


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in EXTRA}) if extra else df


def both(spark, rows):
    """The rows as they are, and with clashing columns."""
    return [frame(spark, rows), frame(spark, rows, True)]


def components(items: list, linked) -> dict:
    """The smallest item that each reaches, by brute force."""
    out = {x: x for x in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if out[a] != out[b] and linked(a, b):
                    out[a] = out[b] = min(out[a], out[b])
                    changed = True
    return out
