import pytest

TRICKY = [  # (doc_id, text, lang, source): NULLs, empty and long texts, ties and repeated rows
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "b"), (None, "some words of no one", "en", "a"), (4, "word " * 30000, "en", "a"),
    (5, "the same text stands here twice and more", "en", "b"), (5, "the same text stands here twice and more", "en", "b"), (6, "the same text stands here twice and more", "fr", "c"),
    (7, "\U0001f600 ünï çödé | 123 $$$", None, None), (8, "one", "fr", "c"), (9, "x" * 70000, "fr", "é"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    rows = [(*r, len(r[1] or ""), 1.5, "clash") for r in TRICKY]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _text string").repartition(3)


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.where("false")
