import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOC + ", host string, key string, n_lines long, n_removed long, kept string, ids string, rule string, entry string, leader long, score string, __gone string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randint(0, vocabulary)}q" for _ in range(n)]


def odd_rows():
    """Nulls in every column, empty, blank and punctuation-only texts, repeated rows, a very long text."""
    rng = random.Random(9)
    long_ = "\n".join(" ".join(words(rng, 30)) for _ in range(2000))
    return [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t\n", "en", "s", 4), (4, "?!... --", None, "s", 8), (5, long_, "en", None, len(long_)), (6, "Same text here.", "en", "s", 15), (6, "Same text here.", "en", "s", 15), (None, "No id at all.", "fr", "s", 13), (7, "漢字 und émigré 😀", "de", "s", 16)]


def odd(spark, clash=False):
    if not clash:
        return spark.createDataFrame(odd_rows(), DOC)
    return spark.createDataFrame([(*r, "h", "k", 1, 2, "x", "i", "r", "e", 3, "s", "g") for r in odd_rows()], CLASH)


def empty(spark):
    return spark.createDataFrame([], DOC)
