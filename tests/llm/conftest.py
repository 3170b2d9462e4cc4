import pytest

PROSE = "the quick brown fox jumps over the lazy dog and then runs away from every hunter in the dark old forest"
DOCS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE + " today"), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "One TWO"),
    (9, "a " * 30_000), (10, "x" * 50_000), (11, "idiot " + PROSE), (12, "you idiot " + PROSE[::-1]), (13, PROSE + " <|endoftext|> é😀 日本 'll 're"),
    (14, "### $$$ " * 40 + PROSE), (15, "*** " * 60), (16, "line of some words here\n" * 20), (None, "no id at all but some words"), (17, "\x00 nul \x0b vt"),
]


def write(spark, folder, docs, labels, bench, turns, pages):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "t", 2) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, `set` int, `train` string, n int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, "text") for x in labels], "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*x, 3) for x in bench], "item_id bigint, text string, doc_id bigint").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(*x, 0, "n") for x in turns], "conv_id bigint, turn bigint, role string, text string, tree int, node string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(*x, "v") for x in pages], "page_id bigint, url string, html string, verdict string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    labels = [(k, int(k not in (14, 15, 16)), int(k in (11, 12))) for k in range(1, 18)] + [(None, 1, 1), (3, None, None)]
    bench = [(0, "over the lazy dog and then runs away"), (1, None), (2, ""), (3, "One two")]
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> <\\|x"), (1, 1, "assistant", "a <|im_end|> <\\|x"), (2, 0, None, None), (3, 0, "sys%\ntem", ""), (None, 0, "assistant", "é"), (4, 5, "assistant", None)]
    pages = [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "http://A.Example.com/en/1", "h"), (5, "https://www.example.com/en/", "h"), (6, "http://x.net/es/", "h"), (7, "http://net/fr/?a=1#b", "h"), (8, "http://fooexample.com/en/", "h"), (9, "x://y.org", "h"), (9, "x://y.org", "h")]
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS, labels, bench, turns, pages)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])
