"""Small tables for edge cases."""

import regex

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORDS = regex.compile(rf"(?V1)[{_ALONE}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{_ALONE}]]+")


def docs(spark, rows):
    """Documents from (doc_id, text) pairs."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(seed, n=60):
    """Words that no other seed shares."""
    return " ".join(f"w{seed}x{(k * 7919 + seed) % 997}" for k in range(n))


def edge_rows():
    """Nulls, empties, blanks, a word, ties and a very long text."""
    long = " ".join(f"tok{i}" for i in range(60_000))
    return [(None, sentence(1)), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, sentence(2)), (6, sentence(2)), (7, long), (None, None), (8, "é 中文 \U0001f600 ñ")]


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("row", "key", "rep", "score", "words", "ids", "cuts", "k1", "half", "toxic", "findings", "bands", "__id", "rank", "tokens"):
        df = df.withColumn(name, F.lit(7))
    return df
