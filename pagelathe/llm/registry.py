"""The subpackage's queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import codes, covertree, licenses, lines, mixing, mpeg, packing, pieces, secrets, simhash, spelling, tokencount, toxicity
from pagelathe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents by source, weights 3, 1, 2."""
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate lines of all documents."""
    return lines.classes(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all documents, and whether they decode to the text."""
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, 3 bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, counted in flat files."""
    return tokencount.count(table(spark, sf_dir, "documents"))


def op8_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at cosine 0.9."""
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as MPEG audio streams, read back."""
    out = mpeg.features(mpeg.media(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "frame_offsets")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    out = packing.pack(packing.documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings."""
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    """Query name -> function."""
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"pipeline": corpus_pipeline.run}


LINES_SQL = f"""
WITH o AS (SELECT * FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '[^\\x09-\\x0D\\x20]')),
f AS (SELECT line, min({{'d': doc_id, 'l': line_no}}) AS place, length(line) AS n FROM o GROUP BY line),
links AS (SELECT a.line AS x, b.line AS y FROM f a JOIN f b ON b.n BETWEEN a.n AND a.n + {lines.EDITS} AND a.line <> b.line WHERE levenshtein(a.line, b.line) <= least({lines.EDITS}, a.n // {lines.PER})),
near AS (SELECT x, count(*) AS n_links, min(place) AS near FROM (SELECT x, y FROM links UNION SELECT y, x FROM links) JOIN f ON f.line = y GROUP BY x),
best AS (SELECT f.line, n, place, coalesce(n_links, 0) AS n_links, CASE WHEN near < place THEN near ELSE place END AS best FROM f LEFT JOIN near ON near.x = f.line)
SELECT doc_id, line_no, n AS n_chars, best.best.d AS first_doc, best.best.l AS first_line, n_links, doc_id = best.best.d AND line_no = best.best.l AS kept FROM o JOIN best USING (line)
"""
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)) WHERE NOT isnan(c) AND c >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""

_EQUAL = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 17))
_MEANS = ", ".join(f"CAST(floor(CAST(sum(x[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, 17))
_ROUNDS = "".join(
    f"a{k} AS (SELECT vec_id, label, p, x, min({{'d': {_EQUAL}, 'e': e}}) AS m FROM parts JOIN c{k} USING (p) GROUP BY ALL),\n"
    + (f"c{k + 1} AS (SELECT p, e, coalesce(s, c) AS c FROM c{k} LEFT JOIN (SELECT p, m.e AS e, [{_MEANS}] AS s FROM a{k} GROUP BY 1, 2) USING (p, e)),\n" if k < codes.ROUNDS else "")
    for k in range(codes.ROUNDS + 1)
)
CODES_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[16 * p + 1 : 16 * p + 16] AS x FROM kept, range(4) AS r(p)),
c0 AS (SELECT p, e, x AS c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts) WHERE e < 256),
{_ROUNDS}
code AS (SELECT vec_id, label, string_agg(lower(lpad(hex(m.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{codes.ROUNDS}) AS codebooks_sha256 FROM code
"""
WORDS_SQL = """
WITH RECURSIVE
crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
told AS (SELECT run, count(*) AS n, xor(4294967295, list_reduce([4294967295] || any_value(b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) AS h FROM (SELECT doc_id, run, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)) AS b FROM runs WHERE length(run) >= 7), crc GROUP BY doc_id, run, t),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM told) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, range(length(word)) AS r(i)),
near AS (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
  UNION ALL SELECT rest, cuts.word, cuts.n FROM cuts JOIN words w ON w.word = rest
  UNION ALL SELECT cuts.word, rest, w.n FROM cuts JOIN words w ON w.word = rest)),
best AS (SELECT words.word, n, count(other) AS n_near, min({'m': -m, 'other': encode(other)}) AS best FROM words LEFT JOIN near USING (word) GROUP BY ALL),
formed AS (SELECT word, n, n_near, CASE WHEN -best.m >= 10 * n THEN decode(best.other) END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM best),
path(word, here, step) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT path.word, form, step + 1 FROM path JOIN formed ON formed.word = here WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(here, step) AS root FROM path GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, where SQL can express it: brute force over all pairs for the two joins."""
    return {"op2_lines": LINES_SQL, "op8_covertree": VECTORS_SQL, "op12_spelling": WORDS_SQL, "op13_codes": CODES_SQL}
