"""The queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import clustering, exact, html_text, langid, mixing, ngram_join, pieces, pii, quality, resampling, suffixes, urls, windows
from rillway.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Register a function of one table under its name."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(read_table(spark, sf_dir, table))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query("documents")
def op1_pii(documents):
    return pii.span_digest(pii.personal_data(documents))


@query("pages")
def op2_html_text(pages):
    return html_text.extract_text(pages.select("page_id", "url", "html")).drop("html")


@query("documents")
def op3_suffix_dedup(documents):
    return suffixes.repeat_digest(documents)


@query("documents", r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
""")
def op4_exact_dedup(documents):
    return exact.exact_groups(documents).drop("row")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "pages"), langid.train(read_table(spark, sf_dir, "documents")))


QUERIES["op5_language"] = op5_language


@query("documents")
def op6_quality_rules(documents):
    return quality.judge(documents).drop("row", "id_key", "text_hash", "source")


@query("documents")
def op7_sentencepiece(documents):
    return pieces.encode(documents, pieces.public_model()).select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", "round_trip")


@query("documents", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    s AS (
        SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS s FROM w
    ),
    n AS (SELECT doc_id, len(s) AS n FROM s),
    t AS (SELECT doc_id, unnest(s) AS t FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
    ),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a AND r.c < e.b)
    SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.c AS component_id
    FROM n JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) c ON c.a = n.doc_id
""")
def op8_ngram_join(documents):
    return ngram_join.ngram_join(documents)


@query("documents")
def op9_passages(documents):
    return windows.passage_table(documents)


@query("documents")
def op10_mixing(documents):
    return mixing.mix(documents).drop("row", "copies")


#: The rules of the query: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("pages", r"""
    WITH u AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS u FROM pages),
    r AS (SELECT n, page_id, CASE WHEN contains(u, '://') THEN substr(u, instr(u, '://') + 3) ELSE '' END AS r FROM u),
    p AS (
        SELECT n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
        FROM r
    ),
    rules(v, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    best AS (
        SELECT n, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
        FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY n
    )
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (n)
""")
def op11_url_filter(pages):
    return urls.url_verdicts(pages, urls.rules_of(pages.sparkSession, URL_RULES))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("row")


QUERIES["op12_resampling"] = op12_resampling
# CRC-32 by its polynomial, for the distinct features; logarithms are taken in doubles on both sides.
ORACLES["op12_resampling"] = r"""
    WITH poly AS (
        SELECT list(c ORDER BY b) AS crc FROM (
            SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
            FROM (SELECT unnest(range(256))::BIGINT AS b)
        )
    ),
    texts AS (
        SELECT 'd' AS side, row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents
        UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
    ),
    words AS (
        SELECT side, n, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
    ),
    features AS (
        SELECT side, n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
    ),
    held AS (SELECT side, n, f, count(*) AS k FROM features GROUP BY ALL),
    hexed AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM held),
    bytes AS (SELECT f, [4294967295] || list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS y FROM hexed),
    buckets AS (
        SELECT f, xor(list_reduce(y, lambda c, z: xor(poly.crc[1 + (xor(c, z) & 255)], c >> 8)), 4294967295) % 10000 AS b FROM bytes, poly
    ),
    counted AS (SELECT side, n, b, sum(k)::BIGINT AS k FROM held JOIN buckets USING (f) GROUP BY ALL),
    sides AS (SELECT coalesce(sum(k) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(k) FILTER (side = 'b'), 0)::BIGINT AS t FROM counted),
    both_sides AS (SELECT b, coalesce(sum(k) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(k) FILTER (side = 'b'), 0)::BIGINT AS t FROM counted GROUP BY b),
    gains AS (
        SELECT b, floor(1000 * ln(((x.t + 1) * (y.s + 10000))::DOUBLE / ((x.s + 1) * (y.t + 10000))::DOUBLE))::BIGINT AS g FROM both_sides x, sides y
    ),
    weights AS (SELECT n, sum(k)::BIGINT AS n_features, sum(k * g)::BIGINT AS total FROM counted JOIN gains USING (b) WHERE side = 'd' GROUP BY n),
    scored AS (
        SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
               CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END::BIGINT AS weight,
               ('0x' || sha256('7:' || doc_id)[1 : 8])::BIGINT AS h
        FROM words LEFT JOIN weights USING (n) WHERE side = 'd'
    ),
    final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
    ranked AS (
        SELECT n, row_number() OVER (ORDER BY score DESC, doc_id, n) AS rank, count(*) OVER () AS all_rows FROM final WHERE n_words >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * all_rows // 100 THEN rank END AS rank FROM final LEFT JOIN ranked USING (n)
"""


def centroid_sql(clusters: int, rounds: int) -> str:
    """The rounds one after another: c0 are the first centroids, a1 assigns to them, c1 are the next, and so on."""
    parts = [
        """v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64
        )""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS m FROM v QUALIFY c < {clusters})",
    ]
    for i in range(1, rounds + 2):
        parts.append(f"""a{i} AS (
            SELECT n, vec_id, x, min({{'d': list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS best
            FROM v, c{i - 1} GROUP BY n, vec_id, x
        )""")
        parts.append(f"""s{i} AS (
            SELECT best.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS k FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY best.c, i
        )""")
        parts.append(f"""c{i} AS (
            SELECT c, coalesce(f, m) AS m FROM c{i - 1}
            LEFT JOIN (SELECT c, list((s - ((s % k) + k) % k) // k ORDER BY i) AS f FROM s{i} GROUP BY c) USING (c)
        )""")
    last = rounds + 1
    return "WITH " + ", ".join(parts) + f"""
        SELECT vec_id, c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{last} JOIN c{rounds} ON best.c = c
    """


@query("embeddings", centroid_sql(clustering.CLUSTERS, clustering.ROUNDS))
def op13_centroids(embeddings):
    return clustering.cluster_table(embeddings)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
