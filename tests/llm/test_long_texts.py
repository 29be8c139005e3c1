"""Texts with very many spans or tags, languages with many copies, and hand-written pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rillway.llm import html_text, langid, pii


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


def spans_by_fold(spark, texts, pattern):
    import re

    return [[(m.start(), m.end()) for m in re.finditer(pattern, t)] for t in texts]


def test_spans_over_many_blocks(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(("a1", "é", "22", " ", "😀", "x")) for _ in range(n)) for n in (0, 1, 255, 256, 257, 2000, 9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pii.spans(F.col("text"), "[0-9]+").alias("s"))
    got = {r.i: [(s.start, s.end) for s in r.s] for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == spans_by_fold(spark, texts, "[0-9]+")


def test_cut_and_meeting(spark):
    draw = random.Random(4)
    text = "".join(draw.choice("aé😀 b") for _ in range(1500))
    rows = [(s, draw.randint(0, 32)) for s in [0, 1, 255, 256, 257, 511, 1499, 1500, *[draw.randrange(1500) for _ in range(50)]]]
    got = spark.createDataFrame(rows, "s int, n int").select("s", "n", pii.cut(pii.pieces_of(F.lit(text)), F.col("s"), F.col("n")).alias("x")).collect()
    assert all(r.x == text[r.s : r.s + r.n] for r in got)
    ends = sorted(draw.sample(range(300), 60))
    found = [(a, b) for a, b in zip(ends[::2], ends[1::2])]
    asked = [(a, a + draw.randint(1, 40)) for a in range(0, 310, 3)]
    array = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in found])
    got = spark.createDataFrame(asked, "start int, end int").select(F.struct("start", "end").alias("c")).select("c", pii.meeting(array, F.col("c")).alias("m")).collect()
    for r in got:
        assert [(s.start, s.end) for s in r.m] == [(a, b) for a, b in found if a < r.c.end and r.c.start < b]
    none = F.array().cast("array<struct<start:int,end:int>>")
    assert spark.range(1).select(pii.meeting(none, F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")))).first()[0] == []


def test_added_spans_are_the_best_of_those_that_overlap(spark):
    """Against a comparison of all spans with all."""
    draw = random.Random(6)
    words = ["call", "(415) 555-0198", "0301234567", "415 555 0198", "078-05-1120", "ana (at) mail.com", "ana.b@mail.org", "+49 30 1234567", "10.0.0.1", "x", "2024-01-02", "tel"]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (0, 1, 5, 40, 300) for _ in range(3)] + [None]
    selector = pii.Selector([(1.0, 1.0)], [0.0] * len(pii.GENERATORS))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [k for k, _, _ in pii.GENERATORS]
    proposed = {r.doc_id: r.c for r in docs.select("doc_id", pii.candidates(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    for r in pii.personal_data(docs, selector).collect():
        base = [(s.start, s.end) for k in pii.BASE for s in r[k]]
        good = [(c.start, -c.end, kinds[c.generator], c.generator) for c in proposed[r.doc_id] if not any(a < c.end and c.start < b for a, b in base)]
        best = [c for c in good if not any(o < c and o[0] < -c[1] and c[0] < -o[1] for o in good)]
        assert sorted((a.start, -a.end, a.kind, a.generator) for a in r.added) == sorted(best)


def test_time_in_proportion_to_spans(spark):
    selector = pii.train(spark)

    def seconds(n):
        text = " ".join(f"a{i}@mail.org or (0{i % 9}1) 55{i % 10} 0198," for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.time()
        row = pii.span_digest(pii.personal_data(df, selector)).first()
        assert row.n_email == n
        return time.time() - begin

    seconds(500)
    few, many = seconds(2_000), seconds(16_000)
    print(few, many)
    assert many < 16 * max(few, 1.0)


def test_redact(spark):
    selector = pii.Selector([(-1.0, -1.0)], [0.0] * len(pii.GENERATORS))
    rows = [(1, "écrire à a@b.org, ou +49 30 1234567."), (2, None), (3, "nothing"), (4, "10.0.0.1")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), selector).collect()}
    assert got == {1: "écrire à [email], ou [phone].", 2: "", 3: "nothing", 4: "[ip]"}


def test_open_tags_take_time_in_proportion():
    for page in ("<div>" * 100_000 + "</b>" * 100_000 + "x", "<b>" + "<div>" * 100_000 + "</b>" * 100_000 + "x", "<b>" * 100_000 + "</i>" * 100_000 + "x"):
        begin = time.time()
        assert [b[0] for b in html_text.blocks(page)] == ["x"]
        assert time.time() - begin < 20


@pytest.mark.parametrize("page, text", [
    ("<body><main><h1>A title</h1><p>Some words of the article that go on for a while.</p><p>See <a href='#'>this whole sentence is a link</a></p></main></body>",
     "A title\n\nSome words of the article that go on for a while.\n\nSee this whole sentence is a link"),
    ("<article><p><a href='#'>All of it is a link of a few words.</a></p><p>And a paragraph after it, with more words.</p></article>",
     "All of it is a link of a few words.\n\nAnd a paragraph after it, with more words."),
    ("<article><p>Before <![CDATA[the middle]]> and after, in one paragraph.</p><p>a]]>b stays as it is, here and there.</p></article>",
     "Before the middle and after, in one paragraph.\n\na]]>b stays as it is, here and there."),
    ("<article><p>x &amp; y are letters, and so is z.</p></article><footer><p>Made by someone in a place.</p></footer>", "x & y are letters, and so is z."),
    ("<nav><ul><li><a href='#'>Home</a></li><li><a href='#'>News</a></li></ul></nav>", ""),
    ("", ""), (None, ""),
])
def test_hand_written_pages(tree, page, text):
    assert html_text.main_text(page, tree) == text


def test_no_language_is_lost_to_copies(spark):
    for seed in range(5):
        rows = [(f"ganz viele gleiche worte {seed}", "de")] * 5000 + [("one english text", "en")] + [(f"texte numéro {chr(97 + i % 26)}{chr(97 + i // 26)}", "fr") for i in range(300)]
        model = langid.train(spark.createDataFrame(rows, "text string, lang string"), sample=20)
        assert model.languages == ["de", "en", "fr"]


def test_the_sample_is_bounded_by_distinct_texts(spark):
    rows = [("wort", "de")] * 1000 + [(f"t{chr(97 + i)}", "en") for i in range(26)] + [(None, "fr"), ("x", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), sample=5)
    en = [g for g in model.known if g.startswith(" t") and len(g) == 3]
    assert model.languages == ["de", "en"] and len(en) == 5
