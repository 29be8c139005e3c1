"""The operators against plain Python or SQL on small tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import connect, differences

from rillway.llm import html_text, langid, mixing, pieces, pii, quality, suffixes, windows
from rillway.llm.blocks import Block
from rillway.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    table = pq.read_table(f"{FOLDER}/documents.parquet")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER) == []


def luhn(digits):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, p, good in rules for m in re.finditer(p, text) if good(m))


def test_personal_data(spark, rows):
    draw = random.Random(3)
    for i in range(1500):
        letters = draw.choice(["ab.@-_ ", "0123. -", "+01 ().-9", "a@b.c🙂é\x01", "4 -0123456789", "a.@ 1-+(x)", "4111 1111 1111 1111 -"])
        rows = [*rows, (10_000 + i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 60))))]
    rows = [*rows, (90_000, "a" * 50_000 + "@b.c"), (90_001, "1 " * 50_000), (90_002, "x@y" + ".c" * 20_000), (90_003, "1." * 20_000)]
    selector = pii.train(spark)
    found = pii.span_digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), selector)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id][:80]
    held = pii.labelled_texts(200, seed=99)
    out = pii.personal_data(spark.createDataFrame([(i, t) for i, t, _ in held], "doc_id int, text string"), selector).selectExpr("doc_id", "size(added) > 0 as hit").collect()
    labels = {i: y for i, _, y in held}
    assert sum(bool(labels[r.doc_id]) == r.hit for r in out) / len(out) > 0.75


def test_main_text_of_held_out_pages(spark):
    tree = html_text.train(spark)
    right = total = 0
    for page in html_text.labelled_pages(100, seed=123):
        found = list(html_text.blocks(page))
        features = html_text.features_of([(t[2:], *x) for t, *x in found])
        right += sum((html_text.decide(tree, x) > 0.5) == t.startswith("+") for (t, *_), x in zip(found, features))
        total += len(found)
    assert right / total > 0.95


@pytest.mark.parametrize("tag", [
    "<video-js src='a'>x</video-js>", "<svg-icon></svg-icon>", "<button-group>", '<svg width="1" />', "<math/>", "<button>", "<iframe/>", "<select>", "<video src='a'>",
])
@pytest.mark.parametrize("later", ["", "<button>no</button><svg>no</svg><iframe>no</iframe><video>no</video><math>no</math><select>no</select>"])
def test_pages_with_elements_that_nobody_closes(tag, later):
    texts = [t for t, *_ in html_text.blocks(f"<body><p>before it</p>{tag}<p>rest of article</p>{later}<p>the end</p></body>")]
    assert {"before it", "rest of article", "the end"} <= set(texts) and "no" not in " ".join(texts).split()


@pytest.mark.parametrize("page", [
    "<svg>no<svg>no</svg>no</svg>", "<script>no <p>no</p>", "<style>no</style>", "<textarea>no", "<title>no</title >", "<BUTTON a=b>no</button>", "<template>no<svg/>no</template>", "<script>'<svg>'</script><svg>no</svg>",
    "<!-- <script> <svg> --><script>no</script><svg>no</svg>", "<script><!-- no </script><svg>no</svg>",
])
def test_content_of_skipped_elements(page):
    assert [t for t, *_ in html_text.blocks(f"<p>yes</p>{page}")] == ["yes"]


@pytest.mark.parametrize("length", [400, 60])
def test_repeated_substrings(spark, rows, length):
    data = [(d, (t or "").encode()) for d, t in [*rows, (-1, None), (-2, "ab" * 900)]]
    seen = collections.Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    want = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and (not i or not gone[i - 1]) for i in range(len(b)))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    docs = spark.createDataFrame([*rows, (-1, None), (-2, "ab" * 900)], "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in suffixes.repeat_digest(docs, length).collect()} == want


def test_quality_counts_and_shared_lines(spark, rows):
    words = lambda n, seed: " ".join(f"w{(seed * 131 + i * 17) % 9973}" for i in range(n))
    rows = [*rows, *[(50_000 + i, "terms of use of this very site apply here\n" * 4 + words(12, i)) for i in range(40)], (60_000, "a b c d e " * 9)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")).collect()}
    for d, t in rows:
        w = t.encode().split()
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[d]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(inside), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
    assert all(got[50_000 + i].n_removed_words > 0 and not got[50_000 + i].kept for i in range(40))


def test_boilerplate_pages_among_other_documents(spark):
    """Pages of a few own words and the same long line are distinct documents; copies of one document are not."""
    draw = random.Random(4)
    words = lambda n: " ".join(f"{draw.choice('bcdf')}{''.join(draw.choices('aeioulmnrst', k=6))}" for _ in range(n))
    line, copied = words(200), words(60)
    rows = [(i, "a", f"{words(3)}\n{line}") for i in range(60)] + [(i, "a", words(40)) for i in range(60, 600)]
    rows += [(i, "b", f"{words(3)}\n{line}") for i in range(600, 630)]
    rows += [(i, "c", copied.upper() if i % 2 else copied.replace(" ", "  ")) for i in range(700, 730)] + [(i, "c", words(40)) for i in range(730, 760)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {i for i, r in got.items() if r.depleted} == {*range(60), *range(600, 630)}
    assert all(r.n_removed_words == (200 if r.depleted else 0) for r in got.values())


def test_texts_without_frequent_lines(spark, rows):
    """Against a count of all lines in plain Python."""
    draw = random.Random(6)
    shared = ["Terms of  use 2024", "terms of use 1999", "Share this\tpage", "rare line", ""]
    docs = [(d, draw.choice(("a", "b", None)), "\n".join([*draw.sample(shared[:4], draw.choice((0, 0, 1, 2))), t, *draw.choices(shared, k=d % 2)])) for d, t in rows]
    docs += [(90_000, "a", None), (90_001, "a", ""), (90_002, "b", "\n\n"), *[(91_000 + i, "a", "a copied line\nand another") for i in range(30)]]
    norm = lambda line: " ".join(x.decode() for x in line.lower().encode().translate(quality.DIGITS).split())
    holds, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for _, source, text in docs:
        if key := b" ".join((text or "").lower().encode().split()):
            hosts[source].add(key)
            for line in filter(None, map(norm, text.split("\n"))):
                holds[source, line].add(key)
    above = {k for k, v in holds.items() if len(v) >= 10 and len(v) >= 0.05 * len(hosts[k[0]])}
    got = quality.without_frequent_lines(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    key = lambda x: (x[0], x[1] or "", x[2] or "")
    want = [(d, s, None if t is None else "\n".join(x for x in t.split("\n") if (s, norm(x)) not in above)) for d, s, t in docs]
    assert above and sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pieces_equal_the_library(spark, rows):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(1)
    rows = [*rows[:60], *[(i, "".join(draw.choice("ab  \n\tēé漢字🙂the=-_0▁") for _ in range(draw.randint(0, 50)))) for i in range(5000, 5600)], (1, "x" * 3000)]
    out = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), pieces.public_model(), most=3000)
    out = pieces.decode(out.withColumnRenamed("text", "given"), pieces.public_model()).collect()
    for r in out:
        assert list(r.tokens) == library.encode(r.given) and r.round_trip and r.text == r.given.replace("▁", " ")


def test_language_of_held_out_pages(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(documents.where("doc_id % 2 = 0"))
    pages = documents.where("doc_id % 2 = 1 and n_chars > 200").selectExpr("doc_id as page_id", "concat('http://', lang, '.example.org/') as url", "text as html", "lang")
    got = langid.identify(pages, model).join(pages.selectExpr("page_id", "lang as truth"), "page_id")
    assert got.where("lang = truth").count() >= 0.98 * pages.count()


def test_planted_passages(spark):
    draw = random.Random(2)
    words = lambda n: [f"w{draw.randint(0, 30000)}" for _ in range(n)]
    passages, rows, want = [words(60) for _ in range(3)], [], {}
    for i in range(90):
        body = words(draw.randint(20, 300))
        if i % 3 == 0:
            own = list(passages[i // 3 % 3])
            own[30] = "changed" if i % 2 else own[30]
            at = draw.randint(0, len(body))
            body, want[i] = [*body[:at], *own, *body[at:]], at
        rows.append((i, " ".join(body)))
    got = windows.passage_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == set(want)
    assert all(any(r.doc_id == i and r.start <= at + 12 and r.end >= at + 48 for r in got) for i, at in want.items())


@pytest.mark.parametrize(("words", "edits", "want"), [
    (60, range(27, 33), [(0, 55)]), (100, range(47, 53), [(0, 95)]), (60, (20, 25), [(0, 55)]), (50, (47,), [(0, 45)]), (60, range(20, 40), []),
])
def test_stretches_with_replaced_words(words, edits, want):
    hub = " ".join(f"w{i}" for i in range(words))
    own = " ".join(f"x{i}" if i in edits else f"w{i}" for i in range(words))
    known = windows.WordHashes()
    assert windows.stretches(windows.shingles(own.encode(), 5, known), windows.shingles(hub.encode(), 5, known), 46, 80) == want


def test_stretches_against_all_intervals():
    draw = random.Random(3)
    for _ in range(300):
        rate, n = draw.choice((0.5, 0.75, 0.85)), draw.randint(1, 40)
        hit = [draw.random() < rate for _ in range(n)]
        own, hub = np.array([i if h else 1000 + i for i, h in enumerate(hit)], np.uint64), np.arange(n, dtype=np.uint64)
        good = [(a, b) for a in range(n) for b in range(a + 7, n) if 100 * sum(hit[a : b + 1]) >= 80 * (b - a + 1)]
        got = windows.stretches(own, hub, 8, 80)
        assert set(got) <= set(good) and len(set(got)) == len(got)
        assert {k for a, b in good for k in range(a, b + 1) if hit[k]} == {k for a, b in got for k in range(a, b + 1) if hit[k]}


def test_votes_of_a_pair_are_counted_in_one_exchange(spark):
    """Against a count in plain Python, shifts of both signs; the cuts are moved once, to their pair."""
    draw = random.Random(12)
    cuts = [(draw.randrange(4), -draw.randrange(1, 3) << 40, draw.randrange(5) - 2, draw.randrange(-70, 70), draw.randrange(100), draw.randrange(150, 300)) for _ in range(400)]
    want = collections.defaultdict(list)
    for doc, hub, name, shift, low, high in cuts:
        for stripe in (shift // windows.STRIPE, shift // windows.STRIPE + 1):
            want[doc, hub, stripe].append((name, low, high, low - shift, high - shift))
    want = sorted((d, h, s, len({x[0] for x in v}), min(x[1] for x in v), max(x[2] for x in v), min(x[3] for x in v), max(x[4] for x in v)) for (d, h, s), v in want.items())
    table = spark.createDataFrame(cuts, "doc_id long, hub long, name long, shift int, low int, high int").repartition(3)
    got = windows.along_diagonals(table)
    assert sorted(tuple(r) for r in got.select("doc_id", "hub", "stripe", "n", "low", "high", "hub_low", "hub_high").collect()) == want
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert len(exchanges) == 1 and re.fullmatch(r"doc_id#\d+L?, hub#\d+L?, \d+", exchanges[0])


def test_passage_of_two_whose_lines_are_elsewhere(spark):
    """Each piece of the passage of 90 and 91 is also in a document of a lower id, so every name has a hub that is no partner."""
    draw = random.Random(5)
    words = lambda n: [f"v{draw.randint(0, 30000)}" for _ in range(n)]
    rows, pairs = [], 12
    for k in range(pairs):
        passage = words(60)
        rows += [(100 * k + i, " ".join([*words(80), *passage[15 * i : 15 * i + 19], *words(80)])) for i in range(4)]
        rows += [(100 * k + i, " ".join([*words(90), *passage, *words(90)])) for i in (90, 91)]
    got = windows.passage_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == {100 * k + i for k in range(pairs) for i in (90, 91)}
    assert all(any(r.doc_id == 100 * k + i and r.start <= 94 and r.end >= 146 for r in got) for k in range(pairs) for i in (90, 91))


def some_windows(draw, docs, names):
    rows = set()
    for _ in range(160):
        c = draw.randrange(60, 200)
        rows.add((draw.randrange(names), draw.choice(docs), c - draw.randrange(50), c, c + draw.randrange(50), draw.random() < 0.5))
    return sorted({r[:5]: r for r in rows}.values())


def test_windows_of_a_name_meet_as_in_a_plain_count(spark):
    """Every two windows of a name of which one is unsure, with the cuts given, counted in plain Python."""
    draw = random.Random(21)
    docs = [-5, 0, 3, 4, 1 << 40, 7, 8, 9]
    rows = some_windows(draw, docs, 12)
    cuts = []
    for _ in range(60):
        hub, doc = sorted(draw.sample(docs, 2))
        low = draw.randrange(100)
        cuts.append((doc, hub, draw.randrange(100, 130), draw.randrange(-40, 40), low, low + 50))
    passages = [(4, -5), (7, -5), (8, 0), (9, 0), (7, 0)]
    votes = collections.defaultdict(list)
    met = list(cuts)
    for x, y in itertools.combinations(rows, 2):
        h, w = sorted((x, y), key=lambda r: r[1])
        left, right = min(w[3] - w[2], h[3] - h[2]), min(w[4] - w[3], h[4] - h[3])
        if x[0] == y[0] and x[1] != y[1] and (x[5] or y[5]) and left + right + 1 >= 30:
            met.append((w[1], h[1], x[0], w[3] - h[3], w[3] - left, w[3] + right))
    for doc, hub, name, shift, low, high in met:
        for stripe in (shift // windows.STRIPE, shift // windows.STRIPE + 1):
            votes[doc, hub, stripe].append((name, low, high, low - shift, high - shift))
    hubs = {d: {h for x, h in passages if x == d} for d in docs}
    want = {
        (d, h, min(x[1] for x in v), max(x[2] for x in v), min(x[3] for x in v), max(x[4] for x in v))
        for (d, h, _), v in votes.items() if len({x[0] for x in v}) >= 3 or hubs[d] & hubs[h]
    }
    unsure = spark.createDataFrame(rows, "name long, doc_id long, l int, c int, r int, unsure boolean").repartition(3)
    given = spark.createDataFrame(cuts, "doc_id long, hub long, name long, shift int, low int, high int").repartition(2)
    found = windows.meetings(unsure, given, spark.createDataFrame(passages, "doc_id long, hub long"), 30, 3)
    assert {tuple(r) for r in found.collect()} == want and 20 < len(want) < len(votes)
    assert windows.meetings(unsure.limit(0), given.limit(0), spark.createDataFrame(passages, "doc_id long, hub long"), 30, 3).count() == 0


@pytest.mark.parametrize("home", [True, False])
def test_meetings_in_small_steps(monkeypatch, home):
    """Two documents with 200 windows of a name, and many with a few: parted or not, the same counts."""
    draw = random.Random(22)
    side = lambda own: [np.array(x) for x in zip(*sorted({(draw.randrange(3), draw.choice(own), draw.randrange(9, 40), draw.randrange(100), draw.randrange(9, 40), draw.random() < 0.7) for _ in range(400)}))]
    a = side([0, 0, 0, 2, 4, 6])
    b = a if home else side([1, 1, 1, 3, 5, 7])
    w, h = np.array([6, 4, 6, 5]), np.array([0, 2, 2, 0] if home else [1, 3, 5, 0])
    cuts = [w, h, np.array([7, 7, 8, 9]), np.array([1, 2, 3, 4]), np.array([50, 60, 70, 80]), np.array([0, 9, -40, 3])]
    first = np.array([6, 4, 6, 0])
    cuts += [first, np.where(w == first, h, w)]
    found = []
    for met in (1 << 17, 50):
        monkeypatch.setattr(windows, "MET", met)
        meeting = windows.Meeting(np.arange(8) * 10, {0: {1}, 1: {1}, 6: {1, 2}}, 30, 3)
        found.append(sorted(tuple(r) for t in meeting.met(a, b, cuts, home) for r in t.itertuples(index=False)))
    assert found[0] == found[1] and found[0]


def test_names_of_windows_are_dealt_evenly():
    """The smallest hashes begin with zeros; by the leading bits of these one bucket of 32 held three quarters of all names."""
    draw = random.Random(23)
    text = " ".join(str(draw.randrange(10**9)) for _ in range(20_000)).encode()
    names, _ = windows.windows_of(Block([1], np.frombuffer(text, np.uint8), np.array([len(text)])), 46, 8, 5, windows.WordHashes())
    assert np.bincount((names >> np.uint64(59)).astype(int), minlength=32).max() < 0.06 * len(names)


def test_mix_meets_the_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mixed = mixing.mix(docs).toPandas()
    assert len(mixed) == docs.count() and (mixed["taken"] <= 2 * mixed["size"]).all()
    sources = docs.select("doc_id", "source").toPandas().merge(mixed, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), size=("source_size", "max"))
    assert (sources["target"] - sources["taken"]).between(0, 1).all() and (sources["target"] <= 2 * sources["size"]).all()
    assert abs(sources["target"].sum() - 1.5 * mixed["size"].sum()) < 1


def test_short_and_long_units_are_merged_alike():
    rng, model = random.Random(5), pieces.public_model()
    letters = [*"abcdeiorstn", *"0123.,$", "ü", "é", "\n", pieces.MARK, "語", "😀", "\x01"]
    units = ["", "a", "aaaaaaaaaaaaaaaa", *("".join(rng.choices(letters, k=rng.randrange(1, 90))) for _ in range(3000))]
    for unit in units:
        assert pieces.merged_short(unit, model.ranks) == pieces.merged_long(unit, model.ranks)
    assert "".join(pieces.merged_long("ab" * 20_000, model.ranks)) == "ab" * 20_000
