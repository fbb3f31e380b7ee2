"""The ten operators as queries over whole tables, and what of them DuckDB can say in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fingerprints, leaks, lines, pieces, private, quality, similarity, suffixes, toxicity, warc
from .common import table


def tokenizer_path() -> str:
    """The public SentencePiece model; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark, sf_dir):
    out = lines.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_jaccard_join(spark, sf_dir):
    return similarity.near_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark, sf_dir):
    return private.digests(private.find(table(spark, sf_dir, "documents")))


def op7_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_pieces(spark, sf_dir):
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_jaccard_join, op3_quality, op4_decontamination, op5_toxicity, op6_pii, op7_warc, op8_fingerprints, op9_pieces, op10_suffix_dedup)}

ORACLE_SQL = {
    "op1_line_dedup": lines.SQL,
    "op2_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m AS component_id FROM s JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) ON u = doc_id
""",
    "op10_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d WHERE length(h) >= 800),
strings AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM places),
repeated AS (SELECT r, p FROM strings QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT r, p, CASE WHEN p > lag(p) OVER w + 400 THEN 1 ELSE 0 END AS new FROM repeated WINDOW w AS (PARTITION BY r ORDER BY p)),
runs AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
spans AS (SELECT r, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY r, run),
cuts AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
rest AS (SELECT d.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, sum(z - a) AS gone, count(*) AS n, max(z) AS last FROM cuts JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN rest USING (r)
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d FROM p),
g AS (SELECT d, n, max(page_id) AS kept FROM q WHERE n >= 1000 GROUP BY d, n HAVING count(*) > 1)
SELECT page_id, q.n::BIGINT AS payload_bytes, q.d AS payload_digest, CASE WHEN kept IS NOT NULL AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM q LEFT JOIN g ON q.d = g.d AND q.n = g.n
""",
}
