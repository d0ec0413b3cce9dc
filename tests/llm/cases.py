"""Awkward documents that every operator must take, and the whole sf0.001 table."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id string, items string, n_tokens int, task int"


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, extra columns of clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    sentence = " ".join(words)
    rows = [
        (1, sentence, "en", "a", len(sentence)), (2, sentence, "en", "a", len(sentence)), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4),
        (6, " ".join(f"{w}{i}" for i in range(4000) for w in words[:3]), "de", "b", 1), (7, sentence + " phi chi", "en", None, 3), (7, sentence + " phi chi", "en", None, 3),
        (8, "short", "fr", "c", 5), (8, "other text with the same id", "fr", "c", 5), (None, "a row without an id " + sentence, None, "c", None), (9, "Ünïcode ßtraße 日本語 текст 😀 <|endoftext|> a b", "xx", "c", 9), (10, "x" * 3000, "en", "a", 3000),
    ]
    return spark.createDataFrame([(*r, "d", "i", "z", 7, 8) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def data(table, sf="sf0.001"):
    import pyarrow.parquet as pq

    try:
        return pq.read_table(f"/root/testdata/{sf}/{table}.parquet").to_pylist()
    except FileNotFoundError:
        pytest.skip("no test data here")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
