"""The registered queries of this subpackage, one per operator, with production parameters on whole tables.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import alignment, bpe_codec, centroids, decontaminate, embedding_dedup, lm, pii, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter
from rankflow.session import ship_package

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = (run, sql)
        return run
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_token_counts")
def op1(spark, d):
    return token_counts.document_token_counts(_table(spark, d, "documents"), BYTE_BPE)


@register("op2_url_filter")
def op2(spark, d):
    return url_filter.judge(_table(spark, d, "pages")).drop("score")


@register("op3_toxicity")
def op3(spark, d):
    return toxicity.judge(_table(spark, d, "documents"), _table(spark, d, "labels"))


OP4_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, row_number() OVER () AS iid, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bn AS (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
dn AS (SELECT rid, w, x.n AS n FROM d, (SELECT DISTINCT n FROM bn) x WHERE len(w) >= x.n),
di AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dn),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM di),
m AS (SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
hw AS (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM m)),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM hw GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""


@register("op4_decontaminate", OP4_SQL)
def op4(spark, d):
    return decontaminate.contamination(_table(spark, d, "documents"), _table(spark, d, "benchmark")).drop("items")


_RATIO_SQL = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
              "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", "word_chars")}
_RATIO_SQL = {name: f"least(coalesce((1000 * {a}) // nullif({b}, 0), 0), 1000)" for name, (a, b) in _RATIO_SQL.items()}
_LIMIT_SQL = {"symbols": "q3 + greatest(25, 6 * (q3 - q1))", "dup_lines": "q3 + greatest(25, 6 * (q3 - q1), 2 * (q99 - q3))",
              "repeats": "q3 + greatest(25, 6 * (q3 - q1), 2 * (q99 - q3))", "capitals": "q3 + greatest(25, 6 * (q3 - q1))"}
OP5_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER () AS rid, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
t3 AS (SELECT rid, i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM g WINDOW x AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t3 WHERE c IS NOT NULL),
h AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
      FROM d LEFT JOIN h USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {v} AS step FROM f WHERE NOT base_failed" for k, v in _RATIO_SQL.items())}),
q AS (SELECT lang, source, ratio, step, count(*) AS n FROM s GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY step) AS upto,
        sum(n) OVER (PARTITION BY lang, source, ratio) AS total FROM q),
z AS (SELECT lang, source, ratio, min(step) FILTER (WHERE 4 * upto >= total) AS q1,
        min(step) FILTER (WHERE 4 * upto >= 3 * total) AS q3, min(step) FILTER (WHERE 100 * upto >= 99 * total) AS q99
      FROM u GROUP BY ALL),
k AS (SELECT lang, source, {", ".join(f"max({v}) FILTER (WHERE ratio = '{name}') AS max_{name}" for name, v in _LIMIT_SQL.items())}
      FROM z GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{v} <= coalesce(max_{name}, 1000)" for name, v in _RATIO_SQL.items())} AS kept
FROM f LEFT JOIN k ON f.lang IS NOT DISTINCT FROM k.lang AND f.source IS NOT DISTINCT FROM k.source
"""


@register("op5_quality", OP5_SQL)
def op5(spark, d):
    return quality.judge(_table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op6_pii")
def op6(spark, d):
    found = pii.pii_spans(_table(spark, d, "documents").select("doc_id", "text")).drop("text")
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.BASE_KINDS]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{k}") for k, n in zip(pii.BASE_KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


@register("op7_suffix_dedup")
def op7(spark, d):
    found = suffix_dedup.remove_repeats(_table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_lm_score")
def op8(spark, d):
    return lm.scores(_table(spark, d, "documents"))


@register("op9_bpe_codec")
def op9(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    done = bpe_codec.round_trip(docs, BYTE_BPE)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op10_simhash")
def op10(spark, d):
    found = simhash.near_duplicates(_table(spark, d, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _op11_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds spelled out, one pair of CTEs a round."""
    ctes = [f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
            f"""c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
      FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS (SELECT rid, min(d * 1000 + j) % 1000 AS j, min(d * 1000 + j) // 1000 AS d FROM (SELECT rid, j,
      CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY rid)""")
        if r < rounds:
            ctes.append(f"""s{r} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM
      (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN v USING (rid)) GROUP BY j, i)""")
            ctes.append(f"""c{r + 1} AS (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN
      (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY j) USING (j))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} USING (j)"""


OP11_SQL = _op11_sql()


@register("op11_centroids", OP11_SQL)
def op11(spark, d):
    return centroids.clustering(_table(spark, d, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding,
  embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
u AS (SELECT rid, vec_id, len(embedding) AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM v WHERE ok),
e AS (SELECT a.rid AS a, b.rid AS b, a.vec_id AS va, b.vec_id AS vb FROM u a JOIN u b ON a.n = b.n AND a.rid <> b.rid
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b, vb FROM e UNION SELECT r.a, e.b, e.vb FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS rid, count(*) AS n FROM e GROUP BY a),
c AS (SELECT a AS rid, min(vb) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN k USING (rid) LEFT JOIN c USING (rid)
"""


@register("op12_embedding_dedup", OP12_SQL)
def op12(spark, d):
    return embedding_dedup.near_duplicates(_table(spark, d, "embeddings"))


@register("op13_alignment")
def op13(spark, d):
    return alignment.alignment(_table(spark, d, "documents"), BYTE_BPE, PIECE_BPE)
