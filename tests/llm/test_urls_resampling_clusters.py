"""URL filters, importance resampling and centroid clustering against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from rillway.llm import clustering, resampling, urls
from rillway.llm.queries import URL_RULES

# ---- url filters

RULES = [*URL_RULES, ("block", "b.org", "/x/é"), ("allow", "a.b.org", "/x/é"), ("block", "B.ORG", "/same"), ("allow", "b.org", "/same"), ("block", "net", "")]
LONG = "http://" + "sub." * 20_000 + "example.org/es/" + "p/" * 50_000
URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/118", "http://example.org/en",
    "http://example.org?x=/es/", "http://notexample.org/es/", "http://a.b.org/x/éa", "http://c.b.org/x/é", "http://b.org/same", "http://.org/", "http://org./",
    "http://x.com/fr/#a", "http://x.com/de/?b", "a://b://c.com/de/", "http://x.net", "http://x.net?q", "http://x.com:80/de/", "ftp://x\ny.com/fr/", LONG, LONG[7:],
]


def plain_verdict(url, rules):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h.lower() + p) for v, h, p in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


@pytest.mark.parametrize("way", ["broadcast", "spread", "few digits"])
def test_verdicts(spark, monkeypatch, way):
    if way == "spread":
        monkeypatch.setattr(urls, "checked_broadcast", lambda table: table)
    if way == "few digits":
        monkeypatch.setattr(urls, "SHORT", 1)  # most expressions meet rules that are not theirs
    rows = [(i, u, "r", 1) for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, best int")
    out = urls.url_verdicts(pages, urls.rules_of(spark, [*RULES, ("block", None, "/"), ("block", "", "/"), ("block", "example.com", None)])).collect()
    rules = [*RULES, ("block", "example.com", "")]
    assert sorted(map(tuple, out), key=str) == sorted([(i, *plain_verdict(u, rules)) for i, u, *_ in rows], key=str)


def test_verdicts_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = urls.rules_of(spark, [])
    assert [tuple(r) for r in urls.url_verdicts(pages, none).collect()] == [(1, "a.org", "/", None, "allow")]
    assert urls.url_verdicts(pages, none, default="block").first().verdict == "block"
    assert urls.url_verdicts(pages.limit(0), urls.rules_of(spark, RULES)).count() == 0


def test_allowed_rows_keep_all_columns(spark):
    rows = [(i, u, {"k": i}, "x", "y") for i, u in enumerate(URLS)] + [(99, URLS[7], None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, `a.b` map<string,long>, url_key string, _salt string")
    out = urls.allowed(pages, urls.rules_of(spark, RULES))
    assert out.schema == pages.schema
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in pages.collect() if plain_verdict(r.url, RULES)[3] == "allow")


def test_rules_of_too_many_shapes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_SHAPES", 2)
    with pytest.raises(ValueError, match="shapes"):
        urls.url_verdicts(spark.createDataFrame([], "page_id long, url string"), urls.rules_of(spark, RULES))


# ---- resampling

VOCABULARY = ["a", "b7", "é", "Ünï", "x-y", "Z", "🙂", "tab\tstop", "c,", "\u00a0", "end."]


def plain_resample(docs, target, percent, least):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    def counts(texts):
        out = [0] * 10000
        for t in texts:
            for b in features(t)[1]:
                out[b] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((-r[4], math.inf if r[0] is None else r[0]) for r in rows if r[1] >= least)
    ranks = {}
    for rank, key in enumerate(can[: percent * len(can) // 100], 1):
        ranks.setdefault(key, []).append(rank)
    out = []
    for i, n, k, weight, score in rows:
        own = ranks.get((-score, math.inf if i is None else i), []) if n >= least else []
        out.append((i, k, weight, score, own.pop(0) if own else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent, sections", [(25, 16), (60, 2), (100, 16), (0, 16), (3, 5)])
def test_resample(spark, percent, sections):
    draw = random.Random(percent)
    docs = [(i, " ".join(draw.choices(VOCABULARY, k=draw.randint(0, 60)))) for i in range(150)]
    docs += [(None, None), (None, "q " * 30), (150, ""), (151, " \t"), (152, "only"), (153, "A long text " * 40_000)] + [docs[7]] * 9 + [docs[8]] * 2
    docs += [(-5, "p q " * 20), (1 << 62, "p q " * 20)]
    target = ["a b7 é", None, "", "q q q a"]
    rows = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, score string, n_words int").repartition(5)
    out = resampling.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, sections=sections)
    assert out.columns == ["row", "doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r)[1:] for r in out.collect()], key=str) == plain_resample(docs, target, percent, 20)


def test_ties_of_one_score(spark):
    rows = spark.createDataFrame([(5, i // 3, i) for i in range(1000)] + [(4, 7, 2000), (6, 0, 3000)], "falling long, tie long, row long")
    keys = ["falling", "tie", "row"]
    for wanted in (1, 2, 3, 4, 5, 500, 1001, 1002):
        expected = sorted(map(tuple, rows.collect()))[:wanted]
        assert sorted(map(tuple, rows.where(resampling.up_to(keys, resampling.cutoff(rows, keys, wanted))).collect())) == expected


def test_resampling_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(i, "word " * 30) for i in range(8)], "doc_id long, text string")
    assert resampling.resample(none, one).count() == 0
    assert resampling.resample(one, none).where("rank is not null").count() == 2
    assert resampling.resample(none, none).count() == 0


def test_drawn_rows_keep_all_columns(spark):
    docs = spark.createDataFrame([(i, "w " * 30, {"m": 1}, i, "d") for i in range(40)], "doc_id long, text string, `a.b` map<string,int>, row long, doc string")
    out = resampling.resampled(docs, docs)
    ranked = {r.doc_id for r in resampling.resample(docs, docs).where("rank is not null").collect()}
    assert out.schema == docs.schema and {r.doc_id for r in out.collect()} == ranked and len(ranked) == 10


# ---- clustering


def plain_clusters(rows, k, rounds, dimensions, scale=256):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [list(v) for _, v in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assigned()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assigned()
    inertia = [sum(d for d, m in near if m == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, n, d, inertia[n], sum(inertia), digest[n]) for (i, _), (d, n) in zip(kept, near)], key=str)


def vectors(kind, draw, dimensions):
    if kind == "fine":
        return [(i, [draw.gauss(0, 0.2) for _ in range(dimensions)]) for i in range(150)]
    if kind == "coarse":  # few values, so that neighbouring dimensions join
        return [(i, [draw.choice([-0.5, 0.0, 0.5]) for _ in range(dimensions // 2)] * 2) for i in range(150)]
    odd = [None, [], [0.5] * (dimensions - 1), [0.5] * (dimensions + 1), [None] + [0.5] * (dimensions - 1), [math.nan] * dimensions, [math.inf] + [0.0] * (dimensions - 1)]
    same = [(7, [0.25] * dimensions)] * 40
    return [*enumerate(odd, 1000), *same, (None, [0.1] * dimensions), (None, [-0.1] * dimensions), *[(i, [draw.choice([-1e5, 1e5]) for _ in range(dimensions)]) for i in range(8)]]


@pytest.mark.parametrize("kind", ["fine", "coarse", "odd"])
@pytest.mark.parametrize("chunk", [7, 32_768])
def test_clusters(spark, monkeypatch, kind, chunk):
    monkeypatch.setattr(clustering, "AT_ONCE", 64)
    rows = vectors(kind, random.Random(1), 8)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(3)
    out = clustering.cluster_table(table, clusters=6, rounds=3, dimensions=8, chunk=chunk)
    assert sorted([tuple(r) for r in out.collect()], key=str) == plain_clusters(rows, 6, 3, 8)


def test_clusters_of_few_vectors_and_none(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted([tuple(r) for r in clustering.cluster_table(table, dimensions=2).collect()], key=str) == plain_clusters(rows, 40, 5, 2)
    assert clustering.cluster_table(table.limit(0), dimensions=2).count() == 0
    assert clustering.cluster_table(table).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.cluster_table(table).count() == 0


def test_components_that_no_long_distance_holds_are_bounded(spark):
    table = spark.createDataFrame([(1, [1e300, -1e300]), (2, [-1e300, 1e300]), (3, [3e38, 0.0])], "vec_id long, embedding array<double>")
    out = clustering.cluster_table(table, clusters=1, rounds=1, dimensions=2).collect()
    most = math.isqrt((2**63 - 1) // 2) // 2
    vs = {1: (most, -most), 2: (-most, most), 3: (most, 0)}
    centre = [sum(x) // 3 for x in zip(*vs.values())]
    assert {r.vec_id: r.distance for r in out} == {i: sum((a - b) ** 2 for a, b in zip(v, centre)) for i, v in vs.items()}


def test_dictionaries_are_lossless():
    v = np.random.default_rng(5).integers(-3, 3, (500, 16))
    v[:, 1] = v[:, 0]
    blocks = clustering.encoded(v)
    assert len(blocks) < 16
    assert (np.hstack([entries[codes] for _, entries, codes in blocks]) == v).all()
    assert [b[0] for b in blocks] == np.cumsum([0] + [b[1].shape[1] for b in blocks])[:-1].tolist()
