"""Queries over whole texts: nothing of a line is cut or left out."""

from collections import Counter

import pytest

from folioflow.functions import tokens as T
from folioflow.plans import registry

LINES = ["d-p and r-y " * 60, "Größe, ſchön — „Straße“", "", "x\u4e2dy", "naïve\tœuvre\u00e9"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(1, "\n".join(LINES)), (2, "é"), (3, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def lines(spark, name, d, column):
    return [r[column] for r in registry.queries()[name](spark, d).where("doc_id = 1").orderBy("line").collect()]


def test_every_character_gets_its_id(spark, texts):
    at = {c: i for i, c in enumerate(T.alphabet(T.UNICODE, T.CUSTOM))}
    want = [[1, *[at.get(c, 2) for c in x], 3] for x in LINES]
    assert [list(map(int, x.split())) for x in lines(spark, "tokenize", texts, "ids")] == want
    assert [list(map(int, x.split())) for x in lines(spark, "tokenize", texts, "model_ids")] == [x[:512] for x in want]
    assert len(want[0]) == 722 and 2 not in want[0]
    assert lines(spark, "detokenize", texts, "text") == ["".join(c for c in x if c in at) for x in LINES]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def read(g):
    return g.translate(str.maketrans("eis", "cl5")) if len(g) % 3 == 0 else g[:-1] if len(g) % 5 == 0 else g


def test_every_character_is_counted(spark, texts):
    got = {r.char: r.n for r in registry.queries()["vocabulary"](spark, texts).collect()}
    assert got == Counter("".join(LINES) + "é")


def test_texts_keep_their_letters(spark, texts):
    for name, want in {"attach_text": lambda i, g: ("again " + read(g) if i % 9 == 1 else read(g)).strip(" ") if i % 3 else None, "replace_text": lambda i, g: i % 3 and read(g) or g}.items():
        got = {r.line_id: r.text for r in registry.queries()[name](spark, texts).where("page = 1").collect()}
        assert got == {i: want(i, g) for i, g in enumerate(LINES)}


def test_error_rates_of_whole_lines(spark, texts):
    """Distances and lengths are in characters, not bytes."""
    every = [(1, i, g) for i, g in enumerate(LINES)] + [(2, 0, "é")]
    sums = lambda ls: (sum(distance(g, read(g)) for _, _, g in ls), sum(max(len(g), len(read(g))) for _, _, g in ls))
    run = lambda name: registry.queries()[name](spark, texts).collect()
    assert [(r.distance, r.length) for r in run("ocr_cer_corpus")] == [sums(every)]
    pages = {r.doc_id: (r.distance, r.length) for r in run("ocr_page_quality")}
    assert all(pages[d] == sums([x for x in every if x[0] == d]) for d in (1, 2))
    assert [(r.distance, r.length) for r in run("ocr_conf_filtered")] == [sums([x for x in every if x[1] % 10 >= 4])]


def test_every_page_comes_back(spark, tmp_path):
    urls = ["http://a.org/x/page.htm?q=1", "http://a.org/x/", "http://a.org/7", "http://ä.org/straße.htm", "abc.", "http://a.org/.htm"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: {r.page_id: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert {i: (r.stem, r.url) for i, r in run("path_stem").items()} == {i: (u.split("?")[0].split("/")[-1][:-4], u) for i, u in enumerate(urls)}
    assert {i: r.letters for i, r in run("vocabulary_extend").items()} == {i: "".join(dict.fromkeys("abc." + u)) for i, u in enumerate(urls)}
