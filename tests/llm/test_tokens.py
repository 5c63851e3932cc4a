"""Token counts and the BPE codec against the library."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankflow.llm import bpe_codec, token_counts
from rankflow.llm.bpe import tables
from rankflow.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "a" * 3000, " \x1c\x85 x\u200b\u180e y\n\n  z", "hi<|endoftext|> there <|endoftext|>", "<|endoftext", "ábc½ Ⅷ٣ 中文\U0001f600",
       "'s'll I'm", "aaa" * 50 + "bbb" * 100 + " " * 200, "x" * 20_000 + "\n" * 500, "don't  \t stop!!!\r\n"]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_odd_texts():
    for text in ODD:
        assert token_counts.count_tokens(text, PATH) == len(want(text))
        assert bpe_codec.ids_of(bpe_codec.encode_text(text, PATH)) == want(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abct 'sl.\n\t<|>1"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60))
def test_any_text(text):
    assert token_counts.count_tokens(text, PATH) == len(want(text))
    assert bpe_codec.ids_of(bpe_codec.encode_text(text, PATH)) == want(text)


def test_whole_tokens_are_proven():
    t = tables(PATH)
    for text in sorted(token_counts.whole_tokens(t))[::997]:
        assert len(want(text)) == 1


def test_compatible_is_what_merging_says():
    enc, t = bpe_codec.encoder(PATH), tables(PATH)
    for a, b in [(i * 37 % 50000, i * 101 % 50000) for i in range(4000)]:
        if enc.alone[a] and enc.alone[b]:
            assert enc.compatible(a, b) == (t.merged(t.bytes_of[a] + t.bytes_of[b]) == [a, b])


def test_operators_on_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x<|endoftext|>y")] + [(10 + i, x) for i, x in enumerate(ODD)]
    docs = docs_of([(*r, 5, "k") for r in rows], ", n_tokens int, ids string")
    counted = token_counts.token_counts(docs, PATH)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted.collect()) == sorted((i or 0, len(want(x))) for i, x in rows)
    assert "ids" in counted.columns and counted.columns.count("n_tokens") == 1
    back = bpe_codec.round_trip(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in back) == sorted((i or 0, want(x)) for i, x in rows)
    assert all(r.decoded == (r.text or "") for r in back)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == bpe_codec.round_trip(docs.limit(0), PATH).count() == 0


def test_decode_any_ids(spark):
    rows = [(1, [50256, 0, 255]), (2, None), (3, []), (4, [999999, 17])]
    got = {r.k: r.decoded for r in bpe_codec.bpe_decode(spark.createDataFrame(rows, "k int, ids array<int>"), PATH).collect()}
    assert got == {1: LIBRARY.decode([50256, 0, 255], skip_special_tokens=False), 2: "", 3: "",
                   4: LIBRARY.decode([17], skip_special_tokens=False)}


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op1_token_counts"][0](spark, d).collect():
        n = len(want(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    for r in QUERIES["op9_bpe_codec"][0](spark, d).collect():
        ids = want(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
