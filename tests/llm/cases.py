"""Small tables of awkward rows that every operator must survive."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "row string, rest string, h1 long, batch int, t1 long, member string, score double, leaks string, kept string, n_words int, n_lines int"

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa\n" * 3_000


def documents(spark, *more):
    """Nulls, empty, very long, repeated and tied rows."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "no id here, but text all the same", "en", None, 5),
        (3, LONG, "en", "a", len(LONG)),
        (4, LONG, "de", "b", len(LONG)),
        (5, "one two", "en", "a", 7),
        (5, "one two", "en", "a", 7),
        (6, " \t\n\x0b\x0c\r ", "en", "a", 6),
        (7, "été 世界 \U0001f600 café  x", "fr", "c", 9),
        *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """The same rows with extra columns named like the operators' own."""
    docs = documents(spark)
    for part in CLASHES.split(", "):
        name, kind = part.split()
        docs = docs.selectExpr("*", f"cast(null as {kind}) as {name}")
    return docs
