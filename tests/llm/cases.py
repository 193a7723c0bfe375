"""Small tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, columns whose names clash."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, node long, chunk long, host string, score double, x string, n long"
PAGES = "page_id long, url string, html string, host string, path string, blocks string, uid long"


def prose(seed, words=120, stock=400, prefix="w"):
    draw = random.Random(seed)
    return " ".join(f"{prefix}{draw.randrange(stock)}" for _ in range(words))


def odd_docs(spark):
    texts = [
        (1, prose(1), "en", "a"),
        (2, prose(1), "en", "a"),
        (2, prose(1), "en", "a"),
        (3, prose(1) + " tail", None, None),
        (4, None, "en", "a"),
        (5, "", "fr", None),
        (6, " \t\n\x0b ", "fr", "b"),
        (7, "one", "fr", "b"),
        (None, prose(7, prefix="q"), "fr", "b"),
        (None, None, None, None),
        (8, "x" * 50_000, "en", "b"),
        (9, prose(9, 20_000, 5000), "fr", "b"),
        (10, "Zürich été naïve \U0001f600 日本語 <|endoftext|> it's\n\n\nend ", "fr", "b"),
        (11, "same same same " * 40, "en", "b"),
        (12, "123 456 --- !!!", "en", "b"),
    ]
    return spark.createDataFrame([(*t, None, "w", 1, 2, "h", 0.5, "x", 3) for t in texts], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
