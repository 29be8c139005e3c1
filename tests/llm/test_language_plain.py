"""The language operator against a plain recomputation of its posterior, and on texts whose address tells nothing."""

import collections
import html
import math
import re

import pytest

from rillway.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"))


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain(pages, model):
    """(page_id, text_lang, lang, probability) of (page_id, url, html) rows."""
    k, rows = len(model.languages), []
    for page_id, url, page in pages:
        grams = langid.trigrams(html.unescape(langid.HIDDEN.sub(" ", page or "")))
        total = sum(grams.values())
        logs = [sum(n * model.logs[model.known.get(g, len(model.known))][i] for g, n in grams.items()) for i in range(k)]
        logs = [v * min(1.0, langid.EVIDENCE / total) for v in logs] if total else logs
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = host[1].lower() if host else ""
        labels = host.split(".") if "" not in host.split(".")[-2:] else [host]
        suffix = labels[-1] if len(labels) > 1 and re.fullmatch("[a-z]{2,}", labels[-1]) else ""
        declared = re.search(langid.DECLARED, page or "")
        rows.append((page_id, total, logs, softmax(logs), host, ".".join(labels[-2:]), suffix, declared[1].lower() if declared else ""))
    told = [r for r in rows if r[1]]

    def sums(key):
        out = collections.defaultdict(lambda: [0.0] * (k + 1))
        for r in told:
            out[key(r)] = [a + b for a, b in zip(out[key(r)], [*r[3], 1])]
        return out

    lean = lambda s, upper: [(s[i] + langid.LEAN * upper[i]) / (s[k] + langid.LEAN) for i in range(k)]
    whole = sums(lambda r: "")[""]
    top = [(whole[i] + 1) / (whole[k] + k) for i in range(k)]
    of_suffix = {s: lean(v, top) for s, v in sums(lambda r: r[6]).items()}
    of_domain = {d: lean(v, of_suffix[s]) for (d, s), v in sums(lambda r: (r[5], r[6])).items()}
    of_host = {h: lean(v, of_domain[d]) for (h, d), v in sums(lambda r: (r[4], r[5])).items()}
    by_declared = {}
    for name, v in sums(lambda r: r[7]).items():
        share = min((v[k] + 1) / (whole[k] + 1), 1.0)
        own = [20.0 if name == language else 0.0 for language in model.languages]
        by_declared[name] = [math.log((v[i] + own[i] + langid.LEAN * share) / (whole[i] + 20 + langid.LEAN)) for i in range(k)]
    by_declared.pop("", None)
    best = lambda p: model.languages[p.index(max(p))]
    out = []
    for page_id, total, logs, post, host, domain, suffix, declared in rows:
        prior = of_host.get(host) or of_domain.get(domain) or of_suffix.get(suffix) or top
        p = softmax([logs[i] + math.log(prior[i]) + by_declared.get(declared, [0.0] * k)[i] for i in range(k)])
        out.append((page_id, best(post) if total else None, best(p), max(p)))
    return out


def test_posteriors_equal_a_plain_computation(spark, model):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    more = [
        (9001, None, "<html lang='de'><p>ja</p></html>"), (9002, "http://other.net/x", None), (9003, "ftp://u@WWW.Example.org:8/", "<html LANG=fr></html>"),
        (9004, "http://10.0.0.1/", "<p>the cat and the dog</p>"), (9005, "no address", ""), (9006, "http://a.example.org/", "<html lang=xx>la la la</html>"),
    ]
    pages = pages + more + pages[:3] + more[3:4]
    got = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), model)
    got = sorted((r.page_id, r.text_lang or "", r.lang, r.probability) for r in got.collect())
    want = sorted((i, t or "", lang, p) for i, t, lang, p in plain(pages, model))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-9)


def test_held_out_texts_of_one_host(spark, model):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 1 and n_chars > 200")
    pages = documents.selectExpr("doc_id as page_id", "'http://example.org/' as url", "text as html", "lang")
    got = langid.identify(pages, model).join(pages.selectExpr("page_id", "lang as truth"), "page_id")
    assert got.where("lang = truth").count() >= 0.98 * pages.count()
    assert got.where("text_lang = truth").count() >= 0.98 * pages.count()
