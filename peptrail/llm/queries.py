"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch
from peptrail.llm.clustering import CLUSTERS, ROUNDS, cluster_vectors
from peptrail.llm.collocations import collocations
from peptrail.llm.embedding_dedup import near_vectors
from peptrail.llm.fingerprints import edit_stability
from peptrail.llm.license_scan import scan_licenses
from peptrail.llm.line_dedup import dedup_lines
from peptrail.llm.mixing import mix_sources
from peptrail.llm.near_dedup import near_duplicates
from peptrail.llm.packing import pack
from peptrail.llm.quality import classify
from peptrail.llm.substring_dedup import substring_dedup
from peptrail.llm.token_output import read_tokens, write_tokens
from peptrail.llm.warc import read_warc, write_warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, _read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, _read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_stability(spark, _read(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch.new_path(spark, "tokens")
    return read_tokens(write_tokens(spark, _read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(spark, _read(spark, sf_dir, "pages"), scratch.new_path(spark, "warc")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, _read(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("text_key")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, _read(spark, sf_dir, "documents")).drop("text_key")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, _read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark, _read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, _read(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, _read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_output": op8_token_output,
    "op9_warc": op9_warc,
    "op10_mix_sources": op10_mix_sources,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_collocations": op12_collocations,
    "op13_line_dedup": op13_line_dedup,
}



def _clustering_sql() -> str:
    """Lloyd's rounds written out: ``c0`` are the seeds, each ``a`` assigns all vectors, each next ``c`` has the floors of their means."""
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, x AS y FROM v ORDER BY sha256('1:' || vec_id) LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        square = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{i} AS (SELECT vec_id, any_value(x) AS x, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT vec_id, x, c, CAST({square} AS BIGINT) AS d FROM v, c{i}) GROUP BY vec_id)")
        mean = f"SELECT c, list(m ORDER BY k) AS y FROM (SELECT c, k, CAST(floor(sum(e) / count(*)) AS BIGINT) AS m FROM (SELECT c, unnest(x) AS e, unnest(range(64)) AS k FROM a{i}) GROUP BY c, k) GROUP BY c"
        parts.append(f"m{i} AS ({mean}), c{i + 1} AS (SELECT c, coalesce(m{i}.y, c{i}.y) AS y FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"""


ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
fst AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN fst USING (k) WHERE f < doc_id)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(i, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.j, r.c FROM r JOIN l ON l.i = r.i),
g AS (SELECT i, min(c) AS component_id FROM r GROUP BY i),
k AS (SELECT i, count(*) AS n_links FROM l GROUP BY i)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN g ON g.i = e.vec_id LEFT JOIN k ON k.i = e.vec_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM f""",
    "op10_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS top FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN top <= level * w THEN top ELSE w * (SELECT max(level) FROM l WHERE top > level * w) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h) AS run, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN whole < 2 AND (run <= rest OR (run - own <= rest AND run - own + own / 2 <= rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
    "op11_centroid_clustering": _clustering_sql(),
    "op12_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a AS longer FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) AS r(m) WHERE m < k)),
top AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, CAST(1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score, j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
k AS (SELECT b.* FROM b LEFT JOIN top USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k QUALIFY rank <= 2000""",
    "op13_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT doc_id, line, p, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id""",
}
