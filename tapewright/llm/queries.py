"""The queries of this subpackage and, where SQL can express them, their DuckDB form."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ballkmeans, dialogue, jaccard, media, mixing, packing, secrets, tokens, topk, toxicity, twotier, urlfilter, warc
from .common import shared_dir

#: Folder of the public tokenizers' files; None: where their package is installed.
TOKENIZERS = os.environ.get("TAPEWRIGHT_TOKENIZERS")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path, least_bytes=1000)
    read = warc.read_archives(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.parse_rules(URL_RULES), default="allow")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s, base = F.col("secret_spans"), tuple(r.kind for r in secrets.BASE)
    return found.select("doc_id", *[secrets.count(s, k).alias(f"n_{k}") for k in base], F.sha2(secrets.digest(s, base), 256).alias("base_sha256"), secrets.digest(s).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, salt="3")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twotier.encode_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damage(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_url_filters": op2_url_filters,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_top_k": op5_top_k,
    "op6_media": op6_media,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_packing": op10_packing,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY n, d) AS last FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM g
"""

ORACLES["op2_url_filters"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(r, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM fits GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""

ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN sides l ON l.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

ORACLES["op5_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_KINDS = [(r.kind, r.regex.replace("'", "''"), r.group, r.least) for r in secrets.RULES]
_BASE = [r.kind for r in secrets.BASE]


def _secret_sql() -> str:
    steps = []
    for no, (kind, regex, group, least) in enumerate(_KINDS):
        steps.append(f"""
  SELECT doc_id, {no} AS no, '{kind}' AS kind, UNNEST(list_transform(range(1, len(m) + 1), lambda i:
      {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
        'n': length(m[i]), 'g': length(g[i])}})) AS x, {least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {group}) AS g,
          string_split_regex(t, '{regex}') AS p FROM texts)""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)
    base = ", ".join(f"'{k}'" for k in _BASE)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(steps)}),
spans AS (SELECT doc_id, no, kind, CAST(x.s AS BIGINT) AS s, kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT) AS span FROM found WHERE x.g >= least),
per AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY s, no) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY s, no) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""


ORACLES["op9_secret_scan"] = _secret_sql()
