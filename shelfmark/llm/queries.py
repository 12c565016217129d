"""The registered queries of the operators, with the parameters of production, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.bpe_codec import round_trip_digests
from shelfmark.llm.collocations import mine_collocations
from shelfmark.llm.ctw import score_documents
from shelfmark.llm.jaccard_join import similar_sets
from shelfmark.llm.license_scan import scan_licenses
from shelfmark.llm.line_crf import classify_quality
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.prefix_trie import prefix_trie
from shelfmark.llm.quality_rules import judge_quality
from shelfmark.llm.top_k import exact_top_k
from shelfmark.llm.toxicity import score_toxicity
from shelfmark.llm.url_rules import judge_urls, parse_rule
from shelfmark.llm.warc import archive_pages
from shelfmark.sources.tables import table

#: The rules of the contract (fixed values).
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([parse_rule(*rule) for rule in URL_RULES], "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), ranked=True)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_packing, op3_bpe_codec, op4_ctw, op5_quality, op6_url_rules, op7_toxicity, op8_license_scan, op9_top_k, op10_quality_rules,
        op11_collocations, op12_warc, op13_prefix_trie,
    )
}

URL_SQL = """
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
    SELECT page_id,
        translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), rules(verdict, rhost, rpath) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
    SELECT page_id, host, path, rhost || rpath AS rule, verdict
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), best AS (
    SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM fits GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id, host, path)
"""

TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

COLLOCATION_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), words AS (
    SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), sizes AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), placed AS (
    SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM words
), following AS (
    SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)
), grams AS (
    SELECT lang, w1 AS g FROM following UNION ALL SELECT lang, w1 || ' ' || w2 FROM following WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 FROM following WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM following WHERE w4 IS NOT NULL
), f AS MATERIALIZED (
    SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30
), candidates AS (
    SELECT lang, string_split(g, ' ') AS g, a FROM f WHERE contains(g, ' ')
), cuts AS (
    SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.g[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.g[k + 1 :], ' ')
), lowest AS (
    SELECT lang, g, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS c FROM cuts GROUP BY lang, g, a
), inner_spans AS (
    SELECT lang, g[i : j] AS g, a
    FROM (SELECT lang, g, a, i, unnest(range(i + 1, len(g) + 1)) AS j FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS i FROM candidates))
    WHERE j - i + 1 < len(g)
), covered AS (
    SELECT lang, g, max(a) AS most FROM inner_spans GROUP BY lang, g
), kept AS (
    SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.c.l AS l, b.c.r AS r, b.c.score AS score
    FROM lowest b LEFT JOIN covered m ON m.lang = b.lang AND m.g = b.g WHERE m.most IS NULL OR 100 * CAST(m.most AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

WARC_SQL = """
WITH digests AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), latest AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM digests
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM latest
"""

#: The CRC of an id's digits comes from the table of the reversed polynomial, a step for each digit.
TRIE_SQL = """
WITH RECURSIVE bits(byte, c, step) AS (
    SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) AS t(i)
    UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), codes AS (
    SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8
), own AS (
    SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
    SELECT conv_id, turns, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
        lambda crc, d: xor(crc // 256, t[(xor(crc, d) % 256) + 1]))) % 9 AS h
    FROM own, codes
), rebuilt AS (
    SELECT a.conv_id, coalesce(b.turns, [])[1 : a.h] || a.turns[a.h + 1 :] AS turns
    FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), prefixes AS (
    SELECT conv_id, turns[1 : d] AS p, d, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
        sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].x) END AS saved
    FROM prefixes GROUP BY p, d
), children AS (
    SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), sums AS (
    SELECT p[1 : up] AS p, up AS d, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves
    FROM (SELECT n.p, n.d, n.saved, c.n_children IS NULL AS leaf, unnest(range(0, n.d + 1)) AS up FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.p = n.p)
    GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n_children, 0) AS n_children, s.leaves AS n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN children c ON c.d = n.d AND c.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1 : n.d - 1]
"""

SQL = {
    "op6_url_rules": URL_SQL, "op9_top_k": TOP_K_SQL, "op11_collocations": COLLOCATION_SQL, "op12_warc": WARC_SQL, "op13_prefix_trie": TRIE_SQL,
}
