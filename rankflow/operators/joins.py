"""Keyed lookups and joins.

Each lookup is one plain join on the projected key, without a job or a forced
broadcast (``match_top1``, a search, writes its steps): AQE broadcasts a side whose *measured* shuffle output is
under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` bytes, and splits a hot
key on the probe side (inner, left outer, left semi and left anti joins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.text import content_key, py_strip, truthy_str
from rankflow.session import work_dir

SKIP_MISSING_FIELDS = "missing title or artist"
SKIP_MISSING_KEY = "missing track_id"
SKIP_NOT_FOUND = "track not found in database"
SKIP_NO_VALUE = "youtube_video_id missing in database"


def _stripped(c: str) -> Column:
    return py_strip(F.coalesce(F.col(c).cast("string"), F.lit("")))


def new_records(batch: DataFrame, known: DataFrame, key: str = "track_id",
                required: tuple[str, ...] = ("title", "artist"), known_key: str | None = None) -> DataFrame:
    """Rows of ``batch`` with all ``required`` fields non-blank, a key
    that is not empty, and no row in ``known`` with that key.  Duplicates
    inside the batch stay."""
    cond = truthy_str(F.col(key).cast("string"))
    for c in required:
        cond = cond & truthy_str(_stripped(c))
    lookup = known.select(F.col(known_key or key).alias("_known_key")).where(F.col("_known_key").isNotNull())
    return batch.where(cond).join(lookup, F.col(key) == F.col("_known_key"), "left_anti")


def enrich(src: DataFrame, table: DataFrame, key: str = "track_id", value_col: str = "youtube_video_id",
           url_col: str | None = "youtube_url", title: str = "title", artist: str = "artist",
           url_prefix: str = "https://www.youtube.com/watch?v=") -> DataFrame:
    """Every source row with ``status`` enriched/skipped and the first
    failing ``reason``; enriched rows carry the value and its url.

    ``table`` is keyed (one row per key), as the tracks table is.  Rows with a
    blank key look up a key of their own that no table has (a space and a hash
    of the row), so they spread over the partitions of the join.
    """
    t_cols = [F.col(key).alias("_t_key"), F.col(value_col).alias("_t_value")]
    t_cols.append(F.col(url_col).alias("_t_url") if url_col else F.lit(None).cast("string").alias("_t_url"))
    lookup = table.select(*t_cols).where(F.col("_t_key").isNotNull())
    hashable = [f.name for f in src.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    s = (src.withColumn("_s_title", _stripped(title))
            .withColumn("_s_artist", _stripped(artist))
            .withColumn("_s_key", _stripped(key)))
    s = s.withColumn("_s_look", F.when(F.col("_s_key") != "", F.col("_s_key")).otherwise(
        F.concat(F.lit(" "), F.xxhash64(*hashable).cast("string"))))
    j = s.join(lookup, F.col("_s_look") == F.col("_t_key"), "left")
    reason = (F.when((F.col("_s_title") == "") | (F.col("_s_artist") == ""), SKIP_MISSING_FIELDS)
               .when(F.col("_s_key") == "", SKIP_MISSING_KEY)
               .when(F.col("_t_key").isNull(), SKIP_NOT_FOUND)
               .when(~truthy_str("_t_value"), SKIP_NO_VALUE))
    enriched = reason.isNull()
    out = (j.withColumn("reason", reason)
            .withColumn("status", F.when(enriched, "enriched").otherwise("skipped"))
            .withColumn("video_id", F.when(enriched, F.col("_t_value")))
            .withColumn("video_url", F.when(enriched, F.coalesce(
                F.col("_t_url"), F.concat(F.lit(url_prefix), F.col("_t_value"))))))
    return out.drop("_s_title", "_s_artist", "_s_key", "_s_look", "_t_key", "_t_value", "_t_url")


def lookup_by_content(probe: DataFrame, table: DataFrame, title: str = "title", artist: str = "artist",
                      table_key: str = "track_id", out_key: str = "lookup_key", out_item: str = "item",
                      item_cols: list[str] | None = None) -> DataFrame:
    """Derive the content key on the probe side and look it up: ``found``
    and the stored item (a struct of ``item_cols``, by default all columns of
    ``table``; NULL when there is none).

    The table is reduced to one item per key (the smallest, a partial
    aggregate), so a probe row never fans out."""
    p = probe.withColumn(out_key, content_key(artist, title))
    item = F.min(F.struct(*(item_cols or table.columns))).alias(out_item)
    items = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("_hit_key")).agg(item)
    return (p.join(items, F.col(out_key) == F.col("_hit_key"), "left")
             .withColumn("found", F.col("_hit_key").isNotNull())
             .drop("_hit_key"))


def lookup_exact(probe: DataFrame, table: DataFrame, cols: list[str], table_key: str,
                 out_col: str = "match_key") -> DataFrame:
    """Exact equality on ``cols`` (no normalisation); the first hit is the
    smallest key.  One row per value tuple is left of the table by a partial
    aggregate, so duplicates never fan out."""
    first_hit = (table.where(F.col(table_key).isNotNull())
                      .groupBy(*cols).agg(F.min(table_key).alias(out_col)))
    return probe.join(first_hit, on=cols, how="left")


TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(c) -> Column:
    """Distinct lower-case word tokens of a text (per row, no shuffle)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != ""))


#: bits of a token filter (128 KB), whatever the number of tokens
FILTER_BITS = 1 << 20
#: query tokens up to which the query side is sent to every task (some 16 MB); beyond, the postings are joined by token
BROADCAST_TOKENS = 1 << 20
#: the rarest tokens of a query that seed its search, if no more entries than this carry them
SEED_TOKENS, SEED_DF = 8, 10_000


def _place(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FILTER_BITS))


def _token_filter(rows: DataFrame, token: str = "_tok"):
    """A test that holds for every token of ``rows`` (and some others).  Spark ors the bits; at most FILTER_BITS / 64
    numbers come to the driver."""
    at = rows.select(_place(F.col(token)).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits")).collect()
    held = [0] * (FILTER_BITS // 64)
    for r in words:
        held[r["w"]] = r["bits"]
    table = F.from_json(F.lit(str(held)), "array<long>")  # one constant of the plan

    def holds(token: Column) -> Column:
        p = _place(token)
        word = F.get(table, F.shiftright(p, 6).cast("int"))
        return F.call_function("shiftright", word, F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return holds


def _best(pairs: DataFrame) -> DataFrame:
    """Best entry per query: highest overlap, then smallest id (partial aggregate)."""
    return (pairs.groupBy("_qid")
                 .agg(F.min(F.struct((-F.col("_ov")).alias("neg"), F.col("_cid").alias("cid"))).alias("_b"))
                 .select("_qid", F.col("_b.cid").alias("_cid"), (-F.col("_b.neg")).alias("_ov")))


def match_top1(queries: DataFrame, catalog: DataFrame, query_id: str, query_text: str | Column,
               cat_id: str, cat_text: str | Column, seed_tokens: int = SEED_TOKENS, seed_df: int = SEED_DF,
               broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """Best catalogue entry per query by shared distinct tokens, ties to
    the smallest id; queries with no shared token are ``not_found``.

    Exact, by prefix and length filters over a global order of tokens, rarest
    first.  Entries are cut to tokens that some query may have (a bit filter) and
    written once; frequencies are partial aggregates over them.

    1. Seeds: the entries with any of a query's ``seed_tokens`` rarest tokens
       (of at most ``seed_df`` entries) give it a lower bound m on its best
       overlap.
    2. An entry that shares m or more of a query's n tokens holds one of its
       n - m + 1 rarest, and m tokens at least.  Only those tokens' postings are
       joined; each entry met this way is compared whole.
    3. A query's most frequent token never joins: an entry that shares just one
       token scores 1, and the smallest id of those is an aggregate.

    The three parameters move work, never the answer.  Up to ``broadcast_tokens``
    query tokens the query side goes to the entries and nothing of the catalogue
    is shuffled but counts; beyond, postings are joined by token.
    """
    spark = queries.sparkSession
    folder = work_dir(spark, "match")
    queries.select(F.col(query_id).alias("_qid"), F.explode(tokens(query_text)).alias("_tok")).where(
        "_qid IS NOT NULL").distinct().write.parquet(f"{folder}/queries")
    q = spark.read.parquet(f"{folder}/queries")
    small = q.count() <= broadcast_tokens
    send = F.broadcast if small else (lambda df: df)
    holds = _token_filter(q)
    catalog.select(F.col(cat_id).alias("_cid"), F.filter(tokens(cat_text), holds).alias("_toks")).where(
        (F.size("_toks") > 0) & F.col("_cid").isNotNull()).write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    freq = entries.select("_cid", F.explode("_toks").alias("_tok")).groupBy("_tok").agg(
        F.count(F.lit(1)).alias("_df"), F.min("_cid").alias("_first"))
    known = q.join(freq, "_tok")                   # tokens that no entry has can't match
    by = Window.partitionBy("_qid")                # a query's tokens are bounded by its text
    known.select("*", F.row_number().over(by.orderBy("_df", "_tok")).alias("_rank"),
                 F.count(F.lit(1)).over(by).alias("_n")).write.parquet(f"{folder}/ranked")
    ranked = spark.read.parquet(f"{folder}/ranked")

    def overlaps(wanted: DataFrame) -> DataFrame:
        """(query, entry, overlap) of the entries with one of the wanted (query, token, least size) rows; an entry met
        by several tokens may come several times."""
        some = _token_filter(wanted)
        here = entries.select("_cid", "_toks", F.explode(F.filter("_toks", some)).alias("_tok"))
        if small:
            lists = q.groupBy("_qid").agg(F.collect_list("_tok").alias("_q"))
            met = here.join(send(wanted), "_tok").where(F.size("_toks") >= F.col("_least"))
            return met.join(send(lists), "_qid").select("_qid", "_cid", F.size(F.array_intersect("_toks", "_q")).alias("_ov"))
        met = (here.select("_cid", "_tok", F.size("_toks").alias("_size")).join(wanted, "_tok").where("_size >= _least")
                   .select("_qid", "_cid").distinct())
        return (met.join(q, "_qid").join(entries.select("_cid", F.explode("_toks").alias("_tok")), ["_cid", "_tok"])
                   .groupBy("_qid", "_cid").agg(F.count(F.lit(1)).cast("int").alias("_ov")))

    is_seed = (F.col("_rank") <= seed_tokens) & (F.col("_df") <= seed_df) & (F.col("_rank") < F.col("_n"))
    seeds = ranked.where(is_seed).select("_qid", "_tok", F.lit(1).alias("_least"))
    _best(overlaps(seeds)).write.parquet(f"{folder}/seeded")
    seeded = spark.read.parquet(f"{folder}/seeded")
    least = F.greatest(F.coalesce("_ov", F.lit(1)), F.lit(2))
    prefix = (ranked.where(~is_seed).join(seeded.select("_qid", "_ov"), "_qid", "left").withColumn("_least", least)
                    .where(F.col("_rank") <= F.col("_n") - F.col("_least") + 1).select("_qid", "_tok", "_least"))
    one = ranked.groupBy("_qid").agg(F.min("_first").alias("_cid")).select("_qid", "_cid", F.lit(1).alias("_ov"))
    best = _best(overlaps(prefix).unionByName(seeded).unionByName(one)) \
        .select("_qid", F.col("_cid").alias("match_id"), F.col("_ov").cast("long").alias("overlap"))
    return (queries.join(best, queries[query_id] == best["_qid"], "left").drop("_qid")
                   .withColumn("status", F.when(F.col("match_id").isNull(), "not_found").otherwise("success")))
