"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm import (
    bpe, chosen_path, embedding_links, hard_negatives, merkle, packing, pii, preference, quality, secret_scan,
    toxicity, warc, wrappers,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The only special token of byte_bpe_50k.json (its ids are those of the rank file otherwise).
SPECIALS = {"<|endoftext|>": 50256}
ARROW_ROWS = 1000
#: Key of the registered pseudonyms; a real corpus gets a secret one.
KEY = "cumulus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  Rows hold whole texts, so Python workers get fewer at a time than by default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = bpe.encode(docs, RANKS, decoded="decoded", keep=["doc_id"])
    return out.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.components(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS, specials=SPECIALS)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.links(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_pairs(preference.pairs_of(table(spark, sf_dir, "conversations")))
    spans = [F.concat_ws(" ", F.transform(f"{c}_spans", lambda s: F.concat_ws("+", s["start"], s["length"]))).alias(f"{c}_spans")
             for c in ("chosen", "rejected")]
    return out.select("conv_id", "rejected_id", "prompt_turns", "prompt", "chosen", "rejected", *spans)


def categories(labels: DataFrame) -> DataFrame:
    """The categories of the chain: junk first, whose probability the toxic one then sees."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), categories(table(spark, sf_dir, "labels")),
                          ["junk", "toxic"], "toxic", keep=["doc_id"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
              for kind in secret_scan.KINDS]
    return out.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(docs, other={"text": F.translate("text", upper, upper.lower())}, where=touched)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_preference": op6_preference,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_main_text": op9_main_text,
    "op10_pii": op10_pii,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": r"""
WITH RECURSIVE
     t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)),
                  lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
     e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
     l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
     r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
     c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.a
""",
    "op6_preference": """
WITH t AS (SELECT conv_id AS id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                  ORDER BY (turn IS NULL), turn, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
           WHERE conv_id IS NOT NULL GROUP BY conv_id),
     w AS (SELECT id, turns, lead(id) OVER o AS rejected_id, lead(turns) OVER o AS other,
                  list_filter(turns, lambda x: x.role = 'assistant') AS answers,
                  list_max(list_filter(list_transform(turns, lambda x, i: CASE WHEN x.role = 'assistant' THEN i ELSE 0 END),
                                       lambda i: i > 0)) AS place
           FROM t WINDOW o AS (PARTITION BY turns[1] ORDER BY id)),
     p AS (SELECT id, rejected_id, turns AS c, coalesce(other, list_transform(turns, lambda x, i: {
                    'role': x.role, 'text': CASE WHEN i = place THEN CASE WHEN x.text = answers[1].text THEN '' ELSE answers[1].text END
                                            ELSE x.text END})) AS r FROM w),
     k AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1,
                              least(len(c), len(r))) AS n FROM p),
     s AS (SELECT id, rejected_id, n, c[:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM k),
     e AS (SELECT *, list_transform(p, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS pt,
                  list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS ct,
                  list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rt FROM s)
SELECT id AS conv_id, rejected_id, n AS prompt_turns, array_to_string(pt, '') AS prompt, array_to_string(ct, '') AS chosen,
       array_to_string(rt, '') AS rejected,
       coalesce(array_to_string(list_filter(list_transform(c, lambda x, i: CASE WHEN x.role = 'assistant' THEN
         (length(array_to_string(ct[:i - 1], '')) + 5 + length(x.role)) || '+' || (length(x.text) + 8) END),
         lambda z: z IS NOT NULL), ' '), '') AS chosen_spans,
       coalesce(array_to_string(list_filter(list_transform(r, lambda x, i: CASE WHEN x.role = 'assistant' THEN
         (length(array_to_string(rt[:i - 1], '')) + 5 + length(x.role)) || '+' || (length(x.text) + 8) END),
         lambda z: z IS NOT NULL), ' '), '') AS rejected_spans
FROM e
""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
""",
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s
           FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
     n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns,
                  row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
           FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score,
       ns AS negative_score FROM n WHERE k <= 5
""",
    "op13_merkle": """
WITH RECURSIVE
     f AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
     h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                  sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf,
                  xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
                      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT for z in range(8)]),
                                               lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1)))), 4294967295::UBIGINT) AS crc FROM f),
     s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS sources
           FROM (SELECT DISTINCT source FROM documents)),
     d AS (SELECT h.*, s.s, row_number() OVER () AS r, count(*) OVER (PARTITION BY s.s) AS n,
                  row_number() OVER (PARTITION BY s.s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
           FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
     u AS (SELECT s, 0 AS lvl, i, n, leaf AS h FROM d
           UNION ALL SELECT s, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1
           GROUP BY s, lvl, i // 16, n),
     v AS (SELECT 0 AS lvl, s.s AS i, sources AS n, u.h FROM s JOIN u ON u.s = s.s AND u.n = 1
           UNION ALL SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM v WHERE n > 1
           GROUP BY lvl, i // 16, n),
     w AS (SELECT s, lvl, i, n, h, 0 AS up FROM u WHERE n > 1 UNION ALL SELECT -1, lvl, i, n, h, 1 FROM v WHERE n > 1),
     p AS (SELECT d.r, string_agg(w.h, '' ORDER BY up, w.lvl, w.i) AS p
           FROM d JOIN w ON (w.up = 0 AND w.s = d.s AND w.i // 16 = d.i // (16 ** (w.lvl + 1))::BIGINT AND w.i <> d.i // (16 ** w.lvl)::BIGINT)
                         OR (w.up = 1 AND w.i // 16 = d.s // (16 ** (w.lvl + 1))::BIGINT AND w.i <> d.s // (16 ** w.lvl)::BIGINT) GROUP BY d.r),
     a AS (SELECT r, s, 0 AS lvl, i, n, CASE WHEN crc % 5 = 0 THEN low_leaf ELSE leaf END AS h FROM d
           UNION ALL SELECT a.r, a.s, a.lvl + 1, a.i // 16, (a.n + 15) // 16,
                            sha256(string_agg(CASE WHEN u.i = a.i THEN a.h ELSE u.h END, '' ORDER BY u.i))
           FROM a JOIN u ON u.s = a.s AND u.lvl = a.lvl AND u.i // 16 = a.i // 16 WHERE a.n > 1
           GROUP BY a.r, a.s, a.lvl, a.i // 16, a.n),
     b AS (SELECT a.r, 0 AS lvl, a.s AS i, s.sources AS n, a.h FROM a JOIN s ON s.s = a.s WHERE a.n = 1
           UNION ALL SELECT b.r, b.lvl + 1, b.i // 16, (b.n + 15) // 16,
                            sha256(string_agg(CASE WHEN v.i = b.i THEN b.h ELSE v.h END, '' ORDER BY v.i))
           FROM b JOIN v ON v.lvl = b.lvl AND v.i // 16 = b.i // 16 WHERE b.n > 1
           GROUP BY b.r, b.lvl, b.i // 16, b.n)
SELECT d.doc_id, d.leaf, t.h AS subroot, o.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, b.h AS folded_root,
       b.h = o.h AS verified
FROM d JOIN u t ON t.s = d.s AND t.n = 1 JOIN b ON b.r = d.r AND b.n = 1 JOIN v o ON o.n = 1 LEFT JOIN p ON p.r = d.r
""",
}
