"""Centroid clustering against plain Lloyd rounds, token alignment against overlapping byte ranges."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankflow.llm import alignment, centroids
from rankflow.llm.bpe import byte_chars
from rankflow.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int"


def lloyd(rows, k, rounds, dims):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    x = np.array([v for _, v in kept])
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, hashlib.sha256(f"2:{kept[n][0]}".encode()).hexdigest(),
                                                    x[n].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        a = np.stack([((x - q) ** 2).sum(1) for q in c], 1).argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = x[a == j].sum(0) // (a == j).sum()
    d = ((x - c[a]) ** 2).sum(1)
    return sorted(((i, int(j), int(e)) for (i, _), j, e in zip(kept, a, d, strict=True)), key=repr), c


def float32(m):
    return [[float(v) for v in row] for row in np.asarray(m, np.float32)]


def test_clusters_equal_lloyd_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(7)
    blobs = (rng.normal(size=(6, 8))[rng.integers(0, 6, 900)] + rng.normal(scale=0.05, size=(900, 8)))
    rows = list(enumerate(float32(blobs)))
    rows += [(1000 + i, [0.5] * 8) for i in range(600)]  # one vector with a third of all rows
    rows += [(5, rows[5][1]), (None, [0.1] * 8), (2000, None), (2001, []), (2002, [float("nan")] * 8),
             (2003, [float("inf")] + [0.0] * 7), (2004, [None] + [0.0] * 7), (2005, [0.0] * 9), (2006, [1e30] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("cluster", F.lit("clash"))
    got, c = centroids.clusters(df, k=23, rounds=4, dims=8)
    held = [(i, [min(x, centroids.BOUND / 256) for x in v] if i == 2006 else v) for i, v in rows]
    want, want_c = lloyd(held, 23, 4, 8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert (c == want_c).all()


def test_bounds_spare_distances_and_stay_exact():
    rng = np.random.default_rng(3)
    x = (256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(scale=0.02, size=(4000, 16)))).astype(np.int64)
    history = [x[rng.choice(4000, 40, replace=False)].copy()]
    state, scanned = None, []
    for _ in range(7):
        bounds = centroids.Bounds(history)
        state = bounds.first(x) if state is None else bounds.step(x, *state)
        scanned.append(bounds.scanned)
        d = centroids.squared(x, history[-1])
        assert (state[0] == d.argmin(1)).all()
        c = history[-1].copy()
        for j in range(40):
            if (state[0] == j).any():
                c[j] = x[state[0] == j].sum(0) // (state[0] == j).sum()
        history.append(c)
    assert scanned[0] == 4000 * 40 and scanned[-1] < scanned[0] / 4


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-centroids.BOUND, centroids.BOUND, (50, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in x[:5]] for p in x]
    assert centroids.squared(x, x[:5]).tolist() == want


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 64, 0), (2, [2.0] * 64, 0)], VECTORS)
    out = centroids.clustering(df).collect()
    assert {(r.vec_id, r.distance, r.inertia) for r in out} == {(1, 0, 0), (2, 0, 0)} and len({r.cluster for r in out}) == 2
    empty = centroids.clustering(df.where("vec_id > 5"))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]


def by_hand(texts):
    """The contract of op13 spelled out for a list of texts."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    value = {c: i for i, c in enumerate(byte_chars())}
    count, docs = collections.Counter(), []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        ids = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        raw = [[bytes(value[c] for c in t.id_to_token(i)) for i in ids[0]],
               [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in map(s.id_to_piece, ids[1])]]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        at = [[(e - len(x), e) for e, x in zip(es, r, strict=True)] for es, r in zip(ends, raw, strict=True)]
        links = [(ids[0][i], ids[1][j]) for i, (p, q) in enumerate(at[0]) for j, (u, v) in enumerate(at[1]) if p < v and u < q]
        count.update(links)
        groups, low = [], 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            groups.append("|".join(",".join(str(i) for i, x in zip(own, es, strict=True) if low < x <= e)
                                   for own, es in zip(ids, ends, strict=True)))
            low = e
        docs[-1] = len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(0,) * 6 + ("",) if d is None else
            (*d[:3], len(d[3]), sum(count[p] == top[p[1]] for p in d[3]), sum(count[p] for p in d[3]),
             hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


HARD = [None, "", " ", "a", "  two  spaces ", "tab\there\nand lines\r\n\r\n", "<|endoftext|> is text, <s> too </s> <unk>",
        "naïve café Привет мир 你好世界 ありがとう 🙂👩‍👩‍👧 ​﻿", "ﬁ ligature Ⅳ ½   nbsp", "x" * 3000, "word " * 800,
        "the cat sat on the mat", "the cat sat on the mat", "\x00\x01 control", "<0x41> and ▁ piece marks", "12345 67,890.12 $%&*"]


def test_alignment_equals_overlapping_ranges(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(11, HARD[11]), (None, "null id")]
    docs = docs_of([(i, t, 1, "x") for i, t in rows], ", n_a int, pairs string")
    got = sorted((tuple(r) for r in alignment.alignment(docs, A, B).collect()), key=repr)
    want = sorted(((i, *x) for (i, _), x in zip(rows, by_hand([t for _, t in rows]), strict=True)), key=repr)
    assert got == want
    assert sum(x[1] > 0 for x in want) >= 8 and sum(x[1] == 0 for x in want) >= 3


def test_alignment_of_the_rare_pairs_is_joined(spark, docs_of, monkeypatch):
    """With a low share to be frequent, most pairs go through the join; the result stays."""
    monkeypatch.setattr(alignment, "FREQUENT", 8)
    texts = [f"{w} lorem ipsum {i} dolor {w}{i} sit amet, the the the" for i, w in enumerate("abcdefghij" * 4)]
    got = sorted(tuple(r) for r in alignment.alignment(docs_of(list(enumerate(texts))), A, B).collect())
    assert got == [(i, *x) for i, x in enumerate(by_hand(texts))]


def test_alignment_of_an_empty_table(spark, docs_of):
    out = alignment.alignment(docs_of([(1, "x")]).where("doc_id > 1"), A, B)
    assert out.count() == 0


def test_registered_queries_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_alignment"][0](spark, sf).collect()}
    small = [t for t in texts if len(t[1] or "") < 4000]
    whole = by_hand_fast([t for _, t in texts])
    assert len(small) > 20 and got == {i: x for (i, _), x in zip(texts, whole, strict=True)}


def by_hand_fast(texts):
    """``by_hand`` with ranges walked in step, for whole tables."""
    import bisect

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    value = {c: i for i, c in enumerate(byte_chars())}
    count, docs = collections.Counter(), []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        ids = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        raw = [[bytes(value[c] for c in t.id_to_token(i)) for i in ids[0]],
               [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in map(s.id_to_piece, ids[1])]]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        links = []
        for i, e in enumerate(ends[0]):
            j = bisect.bisect_right(ends[1], e - len(raw[0][i]))
            while j < len(ends[1]) and ends[1][j] - len(raw[1][j]) < e:
                links.append((ids[0][i], ids[1][j]))
                j += 1
        count.update(links)
        groups, p, q = [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            i, j = bisect.bisect_right(ends[0], e), bisect.bisect_right(ends[1], e)
            groups.append(",".join(map(str, ids[0][p:i])) + "|" + ",".join(map(str, ids[1][q:j])))
            p, q = i, j
        docs[-1] = len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(0,) * 6 + ("",) if d is None else
            (*d[:3], len(d[3]), sum(count[p] == top[p[1]] for p in d[3]), sum(count[p] for p in d[3]),
             hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]
