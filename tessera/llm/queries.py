"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read
from .url_filter import RULES


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace

    return replace(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    vectors = read(spark, sf_dir, "embeddings")
    width = vectors.where("embedding is not null").agg(F.mode(F.size("embedding"))).first()[0]
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), width or 1)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balance_bytes

    return balance_bytes(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_copies

    return near_copies(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(read(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spark.tessera.token.cache`` may name a folder of counts to join with and append to; without it, the cache is new."""
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), spark.conf.get("spark.tessera.token.cache", None)).drop("digest")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicate

    return deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_surrogates, op3_decontamination, op4_nearest, op5_packing, op6_sharding, op7_jaccard_join, op8_url_filter, op9_token_counts, op10_suffix_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPANS = "unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word"

_RULES = ", ".join("('{}', '{}', '{}', '{}')".format(verdict, rule, *rule.replace("/", " /", 1).split(" ")) for verdict, rule in RULES)
#: The host without user name, port and final dot.
_GRAPH = r"regexp_replace(regexp_replace(regexp_replace({}, '^.*@', ''), ':[0-9]*$', ''), '\.$', '')"

#: The method of the others (a trained model, a tokenizer, a search that may miss) is not to be had in SQL.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ahead AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM (SELECT doc_id, {_SPANS} FROM d)),
item AS (SELECT item_id, least(13, len(w)) AS n, w FROM b WHERE len(w) > 0),
item_window AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM item)),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(l[1:n], ' ') AS gram FROM ahead, (SELECT DISTINCT n FROM item_window) WHERE len(l) >= n) JOIN item_window USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS key FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(keys, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
ahead AS (SELECT doc_id, i, total, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM (SELECT doc_id, len(w) AS total, {_SPANS} FROM d)),
shingle AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') AS s FROM ahead WHERE len(l) = least(4, total) AND (total >= 4 OR i = 1)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS name FROM shingle GROUP BY doc_id),
class AS (SELECT name, min(doc_id) AS c, min(n) AS n FROM sets GROUP BY name),
token AS (SELECT c, n, s FROM class JOIN shingle ON shingle.doc_id = class.c),
link AS (SELECT a.c AS u, b.c AS v FROM token a JOIN token b ON a.s = b.s AND a.c < b.c GROUP BY a.c, a.n, b.c, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT c AS u, c AS v FROM class UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u),
component AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN class USING (name) LEFT JOIN component ON component.u = class.c""",
    "op8_url_filter": rf"""
WITH RECURSIVE rules(verdict, rule, name, start) AS (VALUES {_RULES}),
after AS (SELECT row_number() OVER () AS r, page_id, html, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
split AS (SELECT r, page_id, html, regexp_extract(rest, '^[^/?#]*') AS name, rest FROM after),
place AS (SELECT r, page_id, html, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(name) + 1), '^[^?#]*') AS path FROM split),
fits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM place JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY r),
page AS (SELECT place.*, rule, verdict, {_GRAPH.format('host')} AS graph FROM place LEFT JOIN fits USING (r)),
share AS (SELECT graph, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM page WHERE graph <> '' GROUP BY graph),
seed AS (SELECT 'trust' AS kind, graph AS host, trust AS score FROM share UNION ALL SELECT 'distrust', graph, distrust FROM share),
target AS (SELECT graph AS host, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^<>]*?\s)??href\s*=\s*["\x27]?\s*(?:https?:)?//([^/?#"\x27\s<>]+)', 1)) AS name FROM page WHERE graph <> ''),
link AS (SELECT host, target, count(*) AS n FROM (SELECT host, {_GRAPH.format("translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS target FROM target) WHERE target <> '' AND host <> target GROUP BY ALL),
arc AS (SELECT 'trust' AS kind, host, target, n / sum(n) OVER (PARTITION BY host) AS weight FROM link UNION ALL SELECT 'distrust', target, host, n / sum(n) OVER (PARTITION BY target) FROM link),
walk AS (SELECT 0 AS step, kind, host, score FROM seed WHERE score > 0 UNION ALL SELECT step + 1, walk.kind, target, sum(0.85 * score * weight) FROM walk JOIN arc ON walk.kind = arc.kind AND walk.host = arc.host WHERE step < 100 GROUP BY step, walk.kind, target),
total AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE -score END) AS net FROM walk GROUP BY host)
SELECT page_id, page.host, path, rule, coalesce(verdict, CASE WHEN net < -0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM page LEFT JOIN total ON total.host = page.graph""",
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
stretch AS (SELECT doc_id, k, substr(h, 2 * k + 1, 1198) AS part FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99, 500)) AS k FROM d)),
string AS (SELECT doc_id, k + j AS i, md5_number(substr(part, 2 * j - 1, 200)) AS name FROM (SELECT doc_id, k, part, unnest(range(1, least(500, len(part) // 2 - 99) + 1)) AS j FROM stretch)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) AS k FROM string) WHERE k > 1),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later)),
runs AS (SELECT doc_id, min(i) AS first, max(i) + 99 AS last FROM numbered GROUP BY doc_id, run),
removed AS (SELECT doc_id, CAST(sum(last - first + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, first, last FROM runs UNION ALL SELECT doc_id, n_bytes + 1, n_bytes + 1 FROM d),
pieces AS (SELECT doc_id, first, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS after FROM edges),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * after + 1, 2 * (first - after - 1)), '' ORDER BY first) AS kept FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
}
