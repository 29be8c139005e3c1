"""Encoding over odd spaces and beside columns of any value, against units cut out by the regular expression."""

import numpy as np

from rillway.llm import pieces

TEXTS = [
    "one two three", " lead", "trail ", "two  spaces", "line\nbreak\tand tab", "▁mark in▁side", "  ", " ", "", None, "日本語 текст naïve", "\x00 odd \U0001f600", "one",
]


def test_every_way_to_cut_gives_the_same_tokens(spark):
    model = pieces.public_model()
    ids = [(1 << 53) + 1 + 2 * i for i in range(len(TEXTS))]  # no doubles
    docs = spark.createDataFrame([*zip(ids, TEXTS), (None, "no id")], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in pieces.encode(docs, model).collect()}
    assert set(found) == {*ids, None}
    for key, text in zip(ids, TEXTS):
        plain = [n for u in pieces.units_of(text) for n in pieces.merged_ids(u, model.ids, model.ranks, model.first_byte)]
        assert found[key].tokens == plain and found[key].text == text
        assert found[key].round_trip == (pieces.decoded(plain, model.texts) == (text or "").replace(pieces.MARK, " "))
        assert np.all([found[key].round_trip])


def test_counts_join_both_ways_to_cut(spark):
    docs = spark.createDataFrame([("a b a",), ("a  b",), (" a",), (None,)], "text string").coalesce(1)
    assert {r.unit: r.n for r in pieces.unit_counts(docs).collect()} == {"▁a": 3, "▁b": 1, "▁▁b": 1, "▁▁a": 1}


def test_a_token_that_decodes_to_something_else_fails_the_round_trip(spark):
    model = pieces.public_model()
    wrong = pieces.PieceModel(model.ids, model.ranks, model.first_byte, [t.replace(b"w", b"v") for t in model.texts])
    docs = spark.createDataFrame([("one",), ("one two",), ("two  one",)], "text string")
    assert {r.text: r.round_trip for r in pieces.encode(docs, wrong).collect()} == {"one": True, "one two": False, "two  one": False}
