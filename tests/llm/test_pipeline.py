"""The pipeline: every stage against its operator's brute-force decisions, on small tables."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rankflow.llm import pii, toxicity

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "pii", "bpe"]
    from test_matching import brute_components, brute_contamination, brute_fp
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if name == "toxicity":
            assert len(after) >= 0.8 * len(before)
        if name == "near_duplicates":
            fps = {d: brute_fp(t) for d, t in before.items()}
            comp = brute_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
            least = {}
            for d in sorted(before):
                least.setdefault(comp[fps[d]], d)
            assert {r.doc_id for r in after} == set(least.values())
        if name == "decontaminate":
            bad = {r[0] for r in brute_contamination(list(before.items()), items) if r[5]}
            assert {r.doc_id for r in after} == set(before) - bad and bad
        if name == "pii":
            assert {r.doc_id for r in after} == set(before)
            assert all(not pii.find_spans(r.text)[0] and r.n_chars == len(r.text) for r in after)
        if name == "bpe":
            assert all(r.exact and r.n_tokens == len(r.ids) for r in after)
            assert {r.doc_id: r.ids for r in after} == {d: LIBRARY.encode(t, add_special_tokens=False).ids for d, t in before.items()}
        docs = out


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = spark.createDataFrame([(1, None, None, "a", None, 3), (2, "", "en", None, 0, 3), (2, "", "en", None, 0, 3), (None, "x", "en", "a", 1, 3),
                                  (4, "mail a@b.co " * 30_000, "en", "a", 5, 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.collect()
    assert docs.select(F.count("*")).first()[0] == 5


def test_toxicity_stage_drops_what_scores_over(spark, tmp_path):
    from test_scoring import lower, toxic_tables
    docs, labels, truth = toxic_tables(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    model = toxicity.fit(docs, labels)
    plain, toxic = model.compressors()

    def score(text):
        raw = lower(text).encode()
        saved = [len(plain(w)) - len(toxic(w)) for w in (raw[i: i + 140] for i in range(0, max(1, len(raw) - 70), 70))]
        return model.score(max(saved), sum(x for x in saved if x > 0))

    assert kept == {r.doc_id for r in docs.collect() if score(r.text) < 0.3}
    for label in (0, 1):
        ids = {i for i, x in truth.items() if x == label}
        assert len(ids & kept if label == 0 else ids - kept) > 0.95 * len(ids)
