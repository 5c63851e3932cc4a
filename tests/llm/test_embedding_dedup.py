"""Embedding near-duplicates against all pairs in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import embedding_dedup as E

VECTORS = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, threshold):
    """The contract by brute force: (vec_id, n_links, component_id, kept) of every row."""
    unit = []
    for _, v in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(np.float64) if ok else None
        unit.append(x / np.sqrt((x * x).sum()) if ok else None)
    link = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in link[todo.pop()] if j not in group])
            group |= {*new}
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = rows[j][0], len(link[j]), least, rows[j][0] is not None and rows[j][0] == least
    return sorted(out, key=repr)


def corpus(rng, dims, cliques, single):
    base = rng.normal(size=(len(cliques) + single, dims))
    out = [b + rng.normal(scale=0.1, size=(n, dims)) for b, n in zip(base, cliques, strict=False)]
    m = np.concatenate([*out, base[len(cliques):]])
    return m[rng.permutation(len(m))]


def as_rows(m, first=0):
    return [(first + i, [float(x) for x in v]) for i, v in enumerate(np.asarray(m, np.float32))]


def test_equal_to_all_pairs_with_copies_chains_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    rows = as_rows(corpus(rng, 24, [2] * 20 + [3] * 5 + [40, 150], 300))
    rows += [(10_000 + i, rows[0][1]) for i in range(400)]  # one vector with a third of all rows
    angle = np.linspace(0, 1.4, 12)  # a chain: neighbours link, its ends don't
    rows += as_rows([[np.cos(a), np.sin(a), *[0.0] * 22] for a in angle], 20_000)
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, [1.0] + [0.0] * 23), (30_000, None), (30_001, []), (30_002, [0.0] * 24),
             (30_003, [float("nan")] * 24), (30_004, [float("inf")] * 24), (30_005, [None] + [1.0] * 23), (30_006, [1.0, 0.0]),
             (30_007, [2.0, 0.0]), (30_008, [1e-30] * 24), (30_009, [1e30] * 24), (30_010, [-0.0] * 23 + [1.0]), (30_011, [0.0] * 23 + [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).withColumn("n_links", F.lit("clash"))
    got = E.near_duplicates(df, shard_rows=250, slice_rows=200)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == all_pairs(rows, 0.9)


def test_other_threshold_and_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 32)
    rows = as_rows(corpus(np.random.default_rng(8), 16, [120, 60], 60))
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    got = E.near_duplicates(df, threshold=0.95, shard_rows=100, slice_rows=64)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == all_pairs(rows, 0.95)
    with pytest.raises(ValueError):
        E.near_duplicates(df, threshold=0.5)


def test_empty_and_unusable_tables(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 0)], VECTORS)
    assert sorted(tuple(r) for r in E.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert E.near_duplicates(df.where("vec_id > 5")).count() == 0


def test_beams_widen_in_a_dense_shard():
    """All vectors in one narrow cone: every leader is in reach, so a beam has to widen until it holds them all."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full((600, 1), 1.0), rng.normal(scale=0.07, size=(600, 60))], axis=1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, node_of, beam = E.build(x, 0.9, 1)
    assert len(set(node_of)) == graph.layers[0].n and (node_of >= 0).all()
    ask, node = E.within_reach(graph, x.astype(np.float32), 8, E.reach(0.9))
    there = x.astype(np.float32) @ graph.layers[0].vec.T >= E.reach(0.9)
    found = np.zeros_like(there)
    found[ask, node] = True
    assert there.sum() > 16 * len(x) and (found & there).sum() >= 0.99 * there.sum()


def test_recall_on_uniform_vectors():
    """Links at the very threshold among vectors without any structure."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(400, 64))
    off -= (off * x[:400]).sum(1)[:, None] * x[:400]
    q = 0.901 * x[:400] + np.sqrt(1 - 0.901**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    graph, node_of, beam = E.build(x, 0.9, 1)
    ask, node = E.within_reach(graph, q.astype(np.float32), beam, E.reach(0.9))
    hit = {(a, b) for a, b in zip(ask.tolist(), node.tolist(), strict=True)}
    assert sum((i, node_of[i]) in hit for i in range(400)) >= 0.98 * 400
