"""Plain re-tellings of definitions, for comparison."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(lower_az(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat and looked at the other cat for a long while today", "en", "a", 1),
        (1, "the cat sat on the mat and looked at the other cat for a long while today", "en", "a", 1),
        (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id here at all but some words", "en", None, 3),
        (None, None, None, None, None), (4, " \t\n\x0b\x0c\r ", "de", "b", 2), (5, "word", None, "b", 4),
        (6, "x" * 30_000, "en", "c", 9), (7, "ab cd. " * 6_000, "en", "c", 9),
        (8, "Müßig gehen    é\tà la façon <|endoftext|> d\u0085u 你好 🙂🙂", "fr", "d", 5),
        (9, "a  b\n\n c   d \n", "es", "d", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ["size", "hash", "key", "f", "part", "ids", "node", "component", "row", "h", "c", "start", "kept",
             "slot", "n_words", "tie", "band", "copies"]
    cols = ["*"] + [f"cast(doc_id as string) as `{c}`" for c in extra]
    return df.selectExpr(*cols)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
