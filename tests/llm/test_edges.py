"""Nulls, empty and repeated rows, empty tables and extra columns with clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from rillway.llm import exact, html_text, langid, mixing, ngram_join, pieces, pii, quality, suffixes, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, tokens string, n int, id int, component_id string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(3000))
TEXTS = [None, "", " \t\n", "one", LONG, LONG, LONG + " more", "x" * 3000, "a b c d e f g h i j k l m n"]
ROWS = [(None if i == 3 else i, t, None, None if i % 3 else "s", None, i, "d", "t", 1, 2, "c") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[4], ROWS[4], ROWS[1]]


@pytest.fixture(scope="module", params=["edges", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "edges" else [], SCHEMA)


OPERATORS = {
    "op1": lambda d: pii.span_digest(pii.personal_data(d, pii.Selector([(1.0, 1.0)], [0.0] * len(pii.GENERATORS)))),
    "op3": suffixes.repeat_digest, "op4": exact.exact_groups, "op6": quality.judge, "op8": ngram_join.ngram_join, "op10": mixing.mix,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_for_each_document(docs, name):
    assert OPERATORS[name](docs).count() == docs.count()


def test_passages(docs):
    assert windows.passage_table(docs).where("doc_id is null").count() == 0


def test_pages(spark, docs):
    pages = docs.selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html", "source as host", "lang as declared")
    model = langid.train(spark.createDataFrame([("the and of", "en"), ("der die das", "de")], "text string, lang string"))
    assert langid.identify(pages, model).count() == pages.count()
    assert html_text.extract_text(pages, 1.0).count() == pages.count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_returns_the_columns(spark, docs, stage):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert out.count() <= 2 * docs.count()


def test_last_stage(spark, docs):
    out = corpus_pipeline.token_ids(spark, docs, "")
    assert set(out.columns) == {*docs.columns, "round_trip"}
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()


def test_near_copies_of_five_words_and_80_percent(spark):
    text = " ".join(f"w{i}" for i in range(100))
    more = lambda n: " ".join(f"x{i}" for i in range(n))
    rows = [(1, text), (2, f"{text} {more(20)}"), (3, " ".join(f"v{i}" for i in range(100))), (4, " ".join(f"v{i}" for i in range(100)) + " " + more(30))]
    left = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in left.collect()} == {1, 3, 4}


def odd_rows():
    """Columns with a dot, of a map and of a clashing name, a repeated row and rows that differ in such columns only."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} v{i} " * 2 + f"u{i} x{i} y{i} z{i}", "s", "en", {"k": i}, i, i) for i in range(6)]
    other = " ".join(f"o{i}" for i in range(60))
    return [*rows, (7, other, "t", "en", {"k": 1}, 1, 1), (7, other, "t", "en", {"k": 2}, 2, 2), (7, other, "t", "en", {"k": 2}, 2, 2), (None, other, "t", "en", None, None, None)]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_columns_with_dots_and_maps(spark, stage):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, `a.b` map<string,int>, row int, `n.c` int")
    out = stage(spark, docs, "")
    got = [tuple(r[c] for c in docs.columns) for r in out.collect()]
    assert set(docs.columns) <= set(out.columns) and all(r in rows for r in got) and got
    again = [tuple(r[c] for c in docs.columns) for r in stage(spark, docs.repartition(5), "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_null_id_is_not_an_empty_one(spark):
    docs = spark.createDataFrame([(None, "same"), ("", "same")], "doc_id string, text string")
    assert [r.doc_id for r in exact.exact_dedup(docs).collect()] == [""]
