"""Decontamination, SimHash and suffix removal against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankflow.llm import bloom, components, decontaminate, simhash, suffix_dedup
from rankflow.llm.arrowtext import RollingHash
from rankflow.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# ---------------------------------------------------------------- decontamination
def brute_contamination(docs, items):
    of, sizes = defaultdict(set), set()
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(13, len(w))
        if n:
            sizes.add(n)
            for j in range(len(w) - n + 1):
                of[tuple(w[j:j + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in of:
                    hit.update(range(j, j + n))
                    found |= of[tuple(w[j:j + n])]
        names = sorted(found)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def contaminated(docs, items):
    return sorted((tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_contamination_random(spark, docs_of, seed):
    rnd = random.Random(seed)
    sentence = lambda n: " ".join(rnd.choice(["a", "b", "é1", "C", "dd"]) for _ in range(n))
    items = [(i, sentence(rnd.choice([0, 1, 3, 7, 13, 14, 30]))) for i in range(12)] + [(99, None), (98, "..."), (3, "b")]
    if seed:
        items = [(i, t) for i, t in items if t is None or len(WORD.findall(t)) > 6]
        docs = [(i, sentence(30) + ", " + (rnd.choice(items[:-1])[1] or "") * rnd.randint(0, 1)) for i in range(40)]
    else:
        docs = [(1, "A b C"), (1, "A b C"), (2, None), (3, ""), (None, "x b a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert contaminated(docs_of(docs), table) == brute_contamination(docs, items)


def test_contamination_long_spans_and_edges(spark, docs_of):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(13, 60)))) for i in range(20)]
    docs = []
    for i in range(120):
        w = rnd.choices(vocabulary, k=rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            source = rnd.choice(items)[1].split()
            n = rnd.choice([5, 12, 13, 14, 20])
            at = rnd.randint(0, max(0, len(source) - n))
            w[rnd.randint(0, len(w)):0] = source[at:at + n]
        docs.append((i, " ".join(w)))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert contaminated(docs_of(docs), table) == brute_contamination(docs, items)
    assert contaminated(docs_of(docs), table.limit(0)) == brute_contamination(docs, [])
    assert contaminated(docs_of(docs).limit(0), table) == []


def test_drop_contaminated_keeps_columns(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([(1, item, "x"), (1, "clean", "y"), (1, "clean", "y"), (None, item, "z"), (None, None, "n")], ", row_key string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, "clean", "y"), (1, "clean", "y"), (None, None, "n")]))


# ---------------------------------------------------------------- SimHash
def brute_fp(text):
    w = PLAIN.findall(lower(text))
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {x: find(x) for x in nodes}


def test_fingerprints_and_components(docs_of):
    rnd = random.Random(4)
    words = ["the", "A", "of", "É", "x\x0by", "and", "so", "we", "go", "up"]
    rows = [(1, None), (2, ""), (3, " \n"), (3, "one"), (4, "One"), (5, "a b c"), (None, "a b c")]
    for i in range(6, 60):
        rows.append((i, " ".join(rnd.choices(words, k=rnd.choice([2, 5, 30, 700])))))
    for i in range(60, 90):
        w = rnd.choice(rows[6:50])[1].split(" ")
        w[rnd.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    got = simhash.near_duplicates(docs_of([(*r, 7) for r in rows], ", fp int")).collect()
    fps = {t: brute_fp(t) for _, t in rows}
    comp = brute_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            least[comp[fps[t]]] = min(i, least.get(comp[fps[t]], i))
    want = sorted(((i, fps[t], least[comp[fps[t]]]) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(docs_of([]).limit(0)).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % 2 ** 64 for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    rnd = random.Random(1)
    for _ in range(20_000):
        bits = rnd.sample(range(64), rnd.randint(1, 4))
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("pairwise", [2, 256])
def test_links_of_crowded_buckets_are_exact(spark, pairwise):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:
        for _ in range(8):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    nodes = sorted(fps)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in nodes]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, pairwise)
    pairs = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    linked = {frozenset(p) for p in pairs}
    want = brute_components(nodes, lambda a, b: (a ^ b).bit_count() <= 4)
    assert brute_components(nodes, lambda a, b: frozenset((a, b)) in linked) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 30)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(30)}, 2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_one_row_a_group(docs_of):
    long = " ".join(f"w{i % 37}" for i in range(400))
    rows = [(5, long, "a"), (2, long + " tail", "b"), (2, long + " tail", "b"), (9, "another text of its own", "c"), (None, "nameless one here", "d"),
            (None, None, "e"), (7, "", "f")]
    docs = docs_of(rows, ", row_digest string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4], rows[6]]))


# ---------------------------------------------------------------- repeated byte strings
def brute_removed(docs, span=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            if d is not None:
                first[b[i:i + span]] = min(d, first.get(b[i:i + span], d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if d is not None and first[b[i:i + span]] < d:
                cut[i:i + span] = b"\1" * span
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        out.append((d, len(b), sum(cut), sum(1 for i in range(len(b)) if cut[i] and (i == 0 or not cut[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(docs):
    found = suffix_dedup.remove_repeats(docs)
    return sorted((tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


def mixed_rows(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(40, 300))) for _ in range(8)]
    rows = []
    for i in range(200):
        x, y = rnd.choice(base), rnd.choice(base)
        a = rnd.randint(0, len(x))
        text = rnd.choice([x, x[a:] + y, "é" * rnd.randint(0, 80), "a" * rnd.randint(0, 200), y[:a] + "zz" + x,
                           "".join(rnd.choice("abcdef gh") for _ in range(120))])
        rows.append((rnd.choice([i, i, i, None, 7]), text))
    return [*rows, (1000, None), (1001, ""), (1002, "x" * 49), (1003, "x" * 50), (1004, "x" * 50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes(docs_of, seed):
    rows = mixed_rows(seed)
    assert removed(docs_of([(*r, 1) for r in rows], ", key int")) == brute_removed(rows)


def test_removed_bytes_of_stretches_and_nothing(docs_of, monkeypatch):
    rows = mixed_rows(3)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 256)
    data = "".join(t or "" for _, t in rows)
    assert removed(docs_of([(1, data), (2, "zz" + data[::-1] + data)])) == brute_removed([(1, data), (2, "zz" + data[::-1] + data)])
    assert removed(docs_of([]).limit(0)) == []


def test_stretches_do_not_change_runs(monkeypatch):
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"abc ") for _ in range(rnd.choice([10, 60, 900, 3000]))) for _ in range(12)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def suffixes():
        digit, text, start, n, *_ = suffix_dedup.runs(data, offsets)
        return {(int(t), int(s) + i): int(d) for d, t, s, k in zip(digit, text, start, n, strict=True) for i in range(k)}
    whole = suffixes()
    monkeypatch.setattr(suffix_dedup, "STRETCH", 100)
    assert suffixes() == whole
    assert set(whole) == {(t, s) for t, x in enumerate(texts) for s in range(len(x) - 49)}


def test_digits_of_one_document_are_dropped_whatever_the_filter_holds(spark, docs_of):
    rnd = random.Random(8)
    own = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(400))) for i in range(40)]
    rows = [*own, (40, "zz" + own[3][1]), (41, own[3][1] + "yy"), (5, own[5][1])]
    docs = docs_of([(*r, 1) for r in rows], ", key int").selectExpr("cast(doc_id as long) doc_id", "cast(key as long) key", "text")
    full = spark.sparkContext.broadcast(bloom.BitFilter(np.full(1024, ~np.uint64(0))))  # lets every digit through
    got = suffix_dedup.distinct_runs(docs, full).collect()
    texts = [t.encode() for _, t in rows]
    digit, text, *_ = suffix_dedup.runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    holders = {}
    for d, t in zip(digit.view(np.int64).tolist(), text.tolist(), strict=True):
        holders.setdefault(d, set()).add(rows[t][0])
    assert {r.h for r in got} == {d for d, ids in holders.items() if len(ids) > 1} and len(got) < 0.3 * len(holders)


def batch_of(texts, first=0):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(first, first + len(texts)), pa.int64()), "text": texts})


def test_digits_are_dealt_evenly_and_meet_bucket_by_bucket(monkeypatch):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(2000)) for _ in range(60)]
    texts += [texts[3][500:900], "zz" + texts[8]]
    monkeypatch.setattr(suffix_dedup, "DEALT", 2000)  # several deals a task
    batches = [batch_of(texts[i: i + 10], i) for i in range(0, len(texts), 10)]
    dealt = [b for own in (batches[:4], batches[4:]) for b in suffix_dedup.deal_digits(iter(own), 64)]
    assert len(dealt) > 3
    size = Counter()
    for b in dealt:
        for r in b.to_pylist():
            size[r["bucket"]] += len(r["h"]) // 8
    assert len(size) == 64 and max(size.values()) < 2 * sum(size.values()) / 64  # by leading bits: half in two buckets
    rows = sorted((r for b in dealt for r in b.to_pylist()), key=lambda r: r["bucket"])
    taken = []

    def ordered():
        for i in range(0, len(rows), 5):
            taken.append(i)
            yield pa.RecordBatch.from_pylist(rows[i: i + 5], dealt[0].schema)
    met = suffix_dedup.meet_digits(ordered())
    found = next(met).column("h").to_pylist()
    assert len(taken) < len(rows) / 5 / 8  # the first buckets come before the rest is read
    found = {*found, *(h for b in met for h in b.column("h").to_pylist())}
    data = [t.encode() for t in texts]
    digit, text, *_ = suffix_dedup.runs(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    holders = {}
    for d, t in zip(digit.view(np.int64).tolist(), text.tolist(), strict=True):
        holders.setdefault(d, set()).add(t)
    assert found == {d for d, ids in holders.items() if len(ids) > 1}


def test_contents_come_in_tables_of_whole_digits():
    keys = [-3] * 4 + [0] * 30 + [5] + [7] * 2 + [8] * 3
    batches = [pa.RecordBatch.from_pydict({"h": keys[i: i + 3]}) for i in range(0, len(keys), 3)]
    tables = [t["h"].to_pylist() for t in suffix_dedup._whole_groups(iter(batches), "h", 5)]
    assert sum(tables, []) == keys and len(tables) > 2
    assert all(a[-1] < b[0] for a, b in itertools.pairwise(tables))
    assert list(suffix_dedup._whole_groups(iter([]), "h", 5)) == []


def test_filters_follow_their_number_of_keys(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) k")
    few = bloom.bit_filter(keys, "k", 20_000_000)  # as for the texts of some gigabytes
    assert len(few.words) * 64 >= 12 * 20_000_000
    assert few.holds(np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)).all()


@pytest.mark.parametrize("low, high", [(0, 500), (37, 90), (0, 20), (3, 10)])
def test_windows_are_hashes_of_ranges(low, high):
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    hashed, at = RollingHash(data), np.arange(low, max(low, high - 19))
    assert (hashed.windows(low, max(high, low + 19), 20) == hashed.of(at, at + 20)).all()


def test_simhash_joins_are_not_sent_through_the_driver(spark, docs_of):
    docs = docs_of([(i, f"one two three four five{i // 2} six") for i in range(60)])
    found = simhash.near_duplicates(docs)
    edges = simhash.links(spark.range(0, 64).selectExpr("id fp"), 4, 8)
    stars = [components._star(spark.range(50).selectExpr("id a", "id + 1 b"), large) for large in (True, False)]
    for df in (found, edges, *stars):
        assert df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
