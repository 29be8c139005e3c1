"""Language of web pages by Bayesian fusion of evidence.

The text's log likelihoods come from a naive Bayes model of character trigrams, trained on labelled documents. The declared
markup language and the suffix of the address add the logarithm of how often they go with each language, estimated from
the pages' own text posteriors. The prior is that of the page's host, smoothed towards its domain, that towards its
suffix and that towards all pages; every level is a grouped sum of posteriors, which combines before it shuffles.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import checked_broadcast, saved, spread_join

#: The classifier is fitted on this many labelled documents of each language at most (bounded sample of labels) and keeps
#: this many trigrams; smoothing adds pseudo-counts.
SAMPLE_DOCUMENTS = 2000
TRIGRAMS = 20_000
SMOOTHING = 0.5
#: Pseudo-pages by which each level of the prior leans on the level above, and by which a declaration's rates are smoothed.
LEAN = 4.0
#: Trigrams of one text are not independent: their evidence counts as this many at most.
EVIDENCE = 60.0
#: Markup whose content is no text, and the declared language.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|nav|footer)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.I | re.S)
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    known: dict[str, int]
    logs: np.ndarray  # one row per known trigram, the last for all others


def trigrams(text: str) -> Counter[str]:
    padded = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


def train(labelled: DataFrame, sample: int = SAMPLE_DOCUMENTS, most: int = TRIGRAMS) -> LanguageModel:
    """From texts with their language (text, lang): counts per language and trigram, added up by Spark.

    Of each language `sample` distinct texts at most are taken, those of the smallest hashes, and so at least one; copies of a text
    count as one (so would texts of the same hash). Rows without a text or language are left out.
    """
    # Hashes are exchanged, not texts; of these only the chosen ones, and of equal texts one a task.
    texts = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("hash"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))  # a limit per language is applied in each task first
    hashes = texts.select("lang", "hash").distinct().withColumn("place", place).where(F.col("place") <= sample)
    sampled = checked_broadcast(saved(hashes.select("lang", "hash"), "language-sample"))
    chosen = texts.join(sampled, ["lang", "hash"], "left_semi").groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, gram, n) for lang, text in zip(batch["lang"], batch["text"]) for gram, n in trigrams(text).items()]
            yield pd.DataFrame(rows, columns=["lang", "gram", "n"])

    counts = chosen.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    table = table.orderBy(F.desc("all"), "gram").limit(most).toPandas()  # `most` rows
    languages = sorted({lang for by in table["by"] for lang in by}) or ["und"]
    hits = np.array([[by.get(lang, 0) for lang in languages] for by in table["by"]] + [[0] * len(languages)], float) + SMOOTHING
    return LanguageModel(languages, {g: i for i, g in enumerate(table["gram"])}, np.log(hits / hits.sum(axis=0)))


def text_evidence(pages: DataFrame, model: LanguageModel) -> DataFrame:
    """page_id, url, declared, host, domain, suffix, n_trigrams, evidence (log likelihood per language, at most 0)."""
    shared = pages.sparkSession.sparkContext.broadcast((model.known, model.logs))

    def one(page: str | None) -> tuple[int, list[float]]:
        known, logs = shared.value
        grams = trigrams(html.unescape(HIDDEN.sub(" ", page or "")))
        total = sum(grams.values())
        if not total:
            return 0, [0.0] * logs.shape[1]
        rows = np.fromiter((known.get(g, len(known)) for g in grams), np.int64, len(grams))
        score = np.fromiter(grams.values(), float, len(grams)) @ logs[rows] * min(1.0, EVIDENCE / total)
        return total, (score - score.max()).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(page) for page in batch.pop("html")]
            yield batch.assign(n_trigrams=[n for n, _ in found], evidence=[e for _, e in found])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared"), host.alias("host"), "html")
    rows = rows.withColumn("domain", F.coalesce(F.nullif(F.regexp_extract("host", r"[^.]+\.[^.]+$", 0), F.lit("")), F.col("host"))).withColumn("suffix", F.regexp_extract("host", r"\.([a-z]{2,})$", 1))
    kinds = dict(rows.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, declared string, host string, domain string, suffix string, n_trigrams long, evidence array<double>"
    return rows.select("page_id", "url", "declared", "host", "domain", "suffix", "html").mapInPandas(run, schema)


def softmax(logs):
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.transform(weights, lambda w: w / total)


def identify(pages: DataFrame, model: LanguageModel) -> DataFrame:
    """page_id, url, declared, host, text_lang, lang and probability of each row of pages (page_id, url, html).

    Without text, the declared language, address and host decide; equal languages give the first by name. A null address
    has the host "". Repeated rows each count as a page of their host.
    """
    names, k = F.array(*map(F.lit, model.languages)), len(model.languages)
    rows = text_evidence(pages, model).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows.withColumn("post", softmax(F.col("evidence"))), "language-evidence")
    # Posteriors of pages with text, summed by group: s0, s1, ... and their number.
    sums = [F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(k)]
    told = rows.where("n_trigrams > 0")

    def level(*by):
        return told.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("n"))

    def leant(table, upper):
        """Shares of a level, smoothed by LEAN pseudo-pages of the level above."""
        return F.array(*[(F.col(f"s{i}") + LEAN * upper[i]) / (F.col("n") + LEAN) for i in range(k)])

    total = told.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    whole = [((total[f"s{i}"] or 0.0) + 1) / (total["n"] + k) for i in range(k)]
    upper = F.array(*map(F.lit, whole))
    suffixes = level("suffix").select("suffix", leant(None, upper).alias("of_suffix"))
    domains = level("suffix", "domain").join(suffixes, "suffix").select("domain", leant(None, F.col("of_suffix")).alias("of_domain"))
    hosts = level("domain", "host").join(domains, "domain").select("host", leant(None, F.col("of_domain")).alias("of_host"))

    def rates(by):
        """log P(value | language) for each value, the declared language itself taken for 20 pseudo-pages."""
        known = level(by).where(F.col(by) != "")
        own = [F.when(F.col(by) == name, 20.0).otherwise(0.0) for name in model.languages]
        size = [max(total[f"s{i}"] or 0.0, 0.0) + 20 + LEAN for i in range(k)]
        share = (F.col("n") + 1) / F.lit(float(total["n"] + 1))
        return known.select(by, F.array(*[F.log((F.col(f"s{i}") + own[i] + LEAN * F.least(share, F.lit(1.0))) / size[i]) for i in range(k)]).alias(f"by_{by}"))

    found = rows
    for table, by in ((hosts, "host"), (domains, "domain"), (suffixes, "suffix"), (rates("declared"), "declared")):
        found = spread_join(found, table, [by], F.col("row"), how="left")
    flat = F.array(*[F.lit(math.log(1 / k))] * k)
    prior = F.coalesce("of_host", "of_domain", "of_suffix", upper)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(F.col("evidence"), F.transform(prior, lambda x: F.log(x))), F.coalesce("by_declared", flat))
    found = found.withColumn("p", softmax(score))
    best = lambda c: names[F.array_position(c, F.array_max(c)).cast("int") - 1]
    return found.select(
        "page_id", "url", "declared", "host", F.when(F.col("n_trigrams") > 0, best(F.col("post"))).alias("text_lang"), best(F.col("p")).alias("lang"),
        F.array_max("p").alias("probability"),
    )
