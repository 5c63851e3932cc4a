"""Removal of repeated byte strings: depth-limited suffix sorting.

A string of SPAN bytes that starts in two documents is two equal suffixes as far as depth SPAN.  Suffixes are ordered
by most-significant digits only that far, and equal groups are the repeated strings.  The first pass deals suffixes by
a digit that every equal pair shares: the smallest hash of the GRAM-byte strings within the first SPAN bytes.
Neighbouring suffixes mostly share that digit's place, so they travel as one run of bytes.  Runs whose digit occurs in
one document only are dropped; the others are sorted pass by pass, eight bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.arrowtext import PIECE_BYTES, RollingHash, flat, mix, pieces
from rankflow.llm.bloom import bit_filter
from rankflow.session import release, work_dir

SPAN, GRAM = 50, 20
#: texts are hashed together up to so many bytes, which a core's cache holds with the numbers made of them
BLOCK = 1 << 16
#: a longer text is cut into stretches of so many suffixes (their strings overlap, the suffixes don't)
STRETCH = 1 << 21


def _least(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes of one text that share their digit: (digit, text number, place of the first
    suffix in the text, number of suffixes, place of the digit after it, place in ``data``, rolling hash)."""
    hashed = RollingHash(data)
    found: list[tuple[np.ndarray, ...]] = []
    a = 0
    # whole texts together, up to BLOCK bytes; a longer text alone, by stretches
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + min(BLOCK, STRETCH), "right")) - 1)
        for low in range(int(offsets[a]), max(int(offsets[a]) + 1, int(offsets[b])), STRETCH):
            high = min(low + STRETCH + SPAN - 1, int(offsets[b])) if b == a + 1 else int(offsets[b])
            if high - low >= SPAN:
                found.append(_runs(hashed, low, high, offsets[a: b + 1]))
            if b > a + 1:
                break
        a = b
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none, hashed
    digit, lo, n, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(offsets, lo, "right") - 1
    return digit, text, lo - offsets[text], n, anchor - lo, lo, hashed


def _runs(hashed: RollingHash, low: int, high: int, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    grams = hashed.windows(low, high, GRAM)
    mark = np.uint64(22)
    best = grams >> mark
    best <<= mark
    best |= np.arange(len(grams), dtype=np.uint64)
    best = _least(best, SPAN - GRAM + 1)
    anchor = (best & np.uint64((1 << 22) - 1)).astype(np.int64)
    start = np.arange(low, low + len(best))
    inside = np.ones(len(best), bool)  # suffixes that have SPAN bytes left in their text
    for border in offsets[1:-1].tolist():
        inside[max(0, border - SPAN + 1 - low): max(0, border - low)] = False
    start, anchor = start[inside], anchor[inside]
    if not len(start):
        return grams[:0], start, start, start
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    return grams[anchor[first]], start[first], np.diff(np.append(first, len(start))), low + anchor[first]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least value, largest value)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.minimum.reduceat(values, first) if len(first) else values, \
        np.maximum.reduceat(values, first) if len(first) else values


def _buckets(docs: DataFrame) -> int:
    """Number of blocks that digits are dealt in: a power of two, some for each shuffle partition."""
    buckets = 64
    while buckets < 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        buckets *= 2
    return buckets


def _turned(digit: np.ndarray) -> np.ndarray:
    """Digits with their halves swapped.  A digit is the least of many hashes, so its leading bits are mostly zero and
    would put most digits into the first buckets; its lower half is as even as any hash."""
    return digit << np.uint64(32) | digit >> np.uint64(32)


def _bucket(turned: np.ndarray, buckets: int) -> np.ndarray:
    return turned >> np.uint64(65 - buckets.bit_length())


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket with its entries packed; entries are ordered by bucket."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    at = np.append(first, len(bucket))
    packs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)),
                                                             pa.py_buffer(np.ascontiguousarray(x))]) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), *packs], names=["bucket", *columns])


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if len(x) and -1 << 31 <= x.min() and x.max() < 1 << 31 else x


def _unpacked_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The entries of one bucket after the other, of packed rows that are ordered by bucket.  Hashes are eight bytes
    wide, documents four or eight."""
    now, kept = None, []

    def joined() -> dict[str, np.ndarray]:
        out = {name: np.concatenate(x) for name, x in zip(names, zip(*kept, strict=True), strict=True)}
        out["most"] = out["least"] + out.pop("more")
        return out

    for batch in batches:
        names = batch.schema.names[1:]
        columns = [batch.column(name) for name in names]
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now and kept:
                yield joined()
                kept = []
            now, raw = bucket, [x[i].as_buffer() for x in columns]
            kept.append([np.frombuffer(x, np.uint64) if name in ("h", "c") else
                         np.frombuffer(x, np.int64 if x.size == raw[0].size else np.int32).astype(np.int64)
                         for name, x in zip(names, raw, strict=True)])
    if kept:
        yield joined()


#: a task deals its entries whenever it has so many
DEALT = 1_000_000


def deal_digits(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Digits of texts with their least and largest document, one entry a digit, packed by bucket."""

    def deal(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, least, most = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        turned = _turned(h)
        order = np.argsort(turned, kind="stable")
        turned, least, most = turned[order], least[order], most[order]
        first = np.flatnonzero(np.concatenate([[True], turned[1:] != turned[:-1]]))
        turned, least, most = turned[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
        # mostly one document: the difference is zero then, which compresses to nothing
        return _packed(_bucket(turned, buckets), {"h": _turned(turned), "least": _narrow(least), "more": _narrow(most - least)})

    kept, size = [], 0
    for rows, data, offsets in pieces(batches, "text", min(PIECE_BYTES, STRETCH)):
        digit, text, *_ = runs(data, offsets)
        if len(digit):
            kept.append(_sums(digit, rows.column("doc_id").to_numpy()[text]))
            size += len(kept[-1][0])
        if size > DEALT:
            yield deal(kept)
            size = 0
    if kept:
        yield deal(kept)


def meet_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digits that occur in documents with different ids, bucket by bucket."""
    for met in _unpacked_buckets(batches):
        order = np.argsort(met["h"], kind="stable")
        h, least, most = met["h"][order], met["least"][order], met["most"][order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        both = np.minimum.reduceat(least, first) < np.maximum.reduceat(most, first)
        yield pa.RecordBatch.from_arrays([pa.array(h[first][both].view(np.int64))], names=["h"])


def shared_digits(docs: DataFrame) -> DataFrame:
    """Digits (h) that occur in documents with different ids.

    A task adds up its own digits first and deals them in blocks; what a digit costs a block is one entry a task,
    however often it occurs.  A task holds one bucket at a time, whatever its partition holds."""
    buckets = _buckets(docs)
    dealt = docs.mapInArrow(lambda batches: deal_digits(batches, buckets), "bucket long, h binary, least binary, more binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet_digits, "h long")


def _key(digit: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One number for a run's digit and content."""
    return mix(digit ^ mix(whole))


def _key_in(digit: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for a run in a document."""
    return mix(_key(digit, whole) ^ doc.view(np.uint64))


class _Distinct:
    """The kept runs of a piece, ordered by digit and content, and where each distinct one begins."""

    def __init__(self, rows: pa.RecordBatch, found: tuple, keep: np.ndarray, whole: np.ndarray):
        digit, text, start, n, a, at, _ = found
        order = keep[np.lexsort((whole[keep], digit[keep]))]
        self.digit, self.whole, self.start, self.n, self.a, self.at = (x[order] for x in (digit, whole, start, n, a, at))
        self.doc, self.key = (rows.column(c).to_numpy()[text[order]] for c in ("doc_id", "key"))
        self.first = np.flatnonzero(np.concatenate([[True], (self.digit[1:] != self.digit[:-1]) | (self.whole[1:] != self.whole[:-1])]))

    def columns(self) -> list[pa.Array]:
        """h, c, n, a of the distinct runs."""
        f = self.first
        return [pa.array(self.digit[f].view(np.int64)), pa.array(self.whole[f].view(np.int64)),
                pa.array(self.n[f].astype(np.int32)), pa.array(self.a[f].astype(np.int32))]


def _kept(batches: Iterator[pa.RecordBatch], keep) -> Iterator[tuple[_Distinct, np.ndarray]]:
    """Distinct runs for which ``keep(digit, content, document)`` holds, with the bytes they lie in, piece by piece."""
    for rows, data, offsets in pieces(batches, "text", min(PIECE_BYTES, STRETCH)):
        found = runs(data, offsets)
        digit, text, _, n, _, at, hashed = found
        if not len(digit):
            continue
        whole = hashed.of(at, at + n - 1 + SPAN)
        some = np.flatnonzero(keep(digit, whole, rows.column("doc_id").to_numpy()[text]))
        if len(some):
            yield _Distinct(rows, found, some, whole), data


def distinct_runs(docs: DataFrame, known) -> DataFrame:
    """Distinct run contents whose digit occurs in documents with different ids: digit (h), hash of the content (c),
    least and largest document, and whether the digit has other contents too.

    The filter only thins out what is dealt; digits that it lets through by chance are dropped here."""

    buckets = _buckets(docs)

    def deal(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c, least, most = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        bucket = _bucket(_turned(h), buckets)
        order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
        return _packed(bucket[order], {"h": h[order], "c": c[order], "least": _narrow(least[order]), "more": _narrow((most - least)[order])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for d, _ in _kept(batches, lambda digit, whole, doc: known.value.holds(digit)):
            kept.append((d.digit[d.first], d.whole[d.first], np.minimum.reduceat(d.doc, d.first), np.maximum.reduceat(d.doc, d.first)))
            size += len(d.first)
            if size > DEALT // 2:
                yield deal(kept)
                size = 0
        if kept:
            yield deal(kept)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _unpacked_buckets(batches):
            h, c, least, most = (met[x] for x in ("h", "c", "least", "most"))
            order = np.lexsort((c, h))
            h, c, least, most = (x[order] for x in (h, c, least, most))
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
            least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            h, c = h[first], c[first]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(begin, len(h)))
            shared = np.repeat(np.minimum.reduceat(least, begin) < np.maximum.reduceat(most, begin), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[shared]) for x in (h.view(np.int64), c.view(np.int64), least, most, np.repeat(size > 1, size))],
                names=["h", "c", "least", "most", "crowded"])

    dealt = docs.mapInArrow(run, "bucket long, h binary, c binary, least binary, more binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        meet, "h long, c long, least long, most long, crowded boolean")


def first_contents(docs: DataFrame, wanted) -> DataFrame:
    """The bytes of runs in the documents that the filter names: digit, content hash, shape, document, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, data in _kept(batches, lambda digit, whole, doc: wanted.value.holds(_key_in(digit, whole, doc))):
            raw, f = data.tobytes(), d.first
            content = [raw[i:j] for i, j in zip(d.at[f].tolist(), (d.at + d.n - 1 + SPAN)[f].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*d.columns(), pa.array(np.minimum.reduceat(d.doc, f)), pa.array(content, pa.binary())],
                                             names=["h", "c", "n", "a", "least", "content"])

    return docs.mapInArrow(run, "h long, c long, n int, a int, least long, content binary")


_PLACES = "h long, c long, n int, docs binary, keys binary, starts binary"


def run_places(docs: DataFrame, wanted) -> DataFrame:
    """Where the runs lie that the filter names: by task and distinct content, packed documents, text keys, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, _ in _kept(batches, lambda digit, whole, doc: wanted.value.holds(_key(digit, whole))):
            at = pa.array(np.append(d.first, len(d.doc)).astype(np.int32) * 8)
            pack = lambda x: pa.Array.from_buffers(pa.binary(), len(d.first), [None, at.buffers()[1], pa.py_buffer(  # noqa: E731,B023
                np.ascontiguousarray(x.astype(np.int64)))])
            yield pa.RecordBatch.from_arrays([*d.columns()[:3], pack(d.doc), pack(d.key), pack(d.start)],
                                             names=[x.split()[0] for x in _PLACES.split(", ")])

    return docs.mapInArrow(run, _PLACES)


def _digits(raw: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes (fewer at the end of the span) from each place + depth on, as a number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(depth, min(depth + 8, SPAN)):
        out = out << np.uint64(8) | raw[at + i]
    return out


def least_by_suffix(digit: np.ndarray, place: np.ndarray, n: np.ndarray, doc: np.ndarray, raw: np.ndarray,
                    start: np.ndarray) -> np.ndarray:
    """For every suffix of the runs, the least document among suffixes equal to depth SPAN: radix passes by eight
    bytes, most significant first, each over the groups that still have more than one member."""
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    out = doc[run].copy()
    at, shift = start[run] + step, place[run] - step
    alive = np.arange(len(run))
    # equal suffixes have their digit at the same place
    _, group = np.unique(digit[run], return_inverse=True)
    group = group * np.int64(SPAN + 1) + shift
    for depth in range(-8, SPAN, 8):
        if depth >= 0:
            value = _digits(raw, at[alive], depth)
            order = np.lexsort((value, group))
            new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (value[order][1:] != value[order][:-1])])
            group[order] = np.cumsum(new)
        _, inverse, size = np.unique(group, return_inverse=True, return_counts=True)
        many = size[inverse] > 1
        alive, group = alive[many], group[many]
        if not len(alive):
            return out
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    least = np.minimum.reduceat(out[alive[order]], first)
    out[alive[order]] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Tables of some ``rows`` rows (or one larger group), of rows ordered by ``column``; no group is split."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(kept)
            key = table[column].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
            kept, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(kept)


#: contents whose suffixes are sorted at once, but for a digit that has more
SORTED = 20_000


def suffix_answers(contents: DataFrame) -> DataFrame:
    """(h, c, suffixes): packed, the least document of every suffix of a run, where one differs from the run's own.

    A task holds the contents of some digits at a time, whatever its partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "h", SORTED):
            h, c, least, n, a = (table[x].to_numpy().astype(np.int64) for x in ("h", "c", "least", "n", "a"))
            order = np.lexsort((least, c, h))
            order = order[np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])]
            h, c, least, n, a = (x[order] for x in (h, c, least, n, a))
            content = table["content"].combine_chunks().cast(pa.large_binary()).take(pa.array(order))
            at = np.frombuffer(content.buffers()[1], np.int64)[: len(order) + 1]
            found = least_by_suffix(h, a, n, least, np.frombuffer(content.buffers()[2], np.uint8), at[:-1])
            ends = np.cumsum(n)
            differs = np.flatnonzero(np.add.reduceat(found != np.repeat(least, n), ends - n))
            packed = [found[ends[i] - n[i]: ends[i]].tobytes() for i in differs.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(h[differs]), pa.array(c[differs]), pa.array(packed, pa.binary())],
                                             names=["h", "c", "suffixes"])

    return contents.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, suffixes binary")


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, start, end) of the covered stretches of each run."""
    for batch in batches:
        doc, key, start = (_unpacked(batch.column(x)) for x in ("docs", "keys", "starts"))
        times = np.diff(_places(batch.column("docs"))) // 8
        n, least = batch.column("n").to_numpy().astype(np.int64), batch.column("least").to_numpy()
        detailed = batch.column("suffixes").is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), times)
        plain = np.flatnonzero(~detailed[row] & (least[row] < doc))
        out = [(doc[plain], key[plain], start[plain], start[plain] + n[row[plain]] - 1 + SPAN)]
        fine = np.flatnonzero(detailed[row])
        if len(fine):
            suffix, offset = _unpacked(batch.column("suffixes")), _places(batch.column("suffixes")) // 8
            own = n[row[fine]]
            which = np.repeat(np.arange(len(fine)), own)
            step = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
            hit = suffix[offset[row[fine]][which] + step] < doc[fine][which]
            edge = np.concatenate([[True], which[1:] != which[:-1]])
            begins = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
            ends = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
            at = fine[which[begins]]
            out.append((doc[at], key[at], start[at] + step[begins], start[at] + step[ends] + SPAN))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                         names=["doc_id", "key", "start", "end"])


def _places(column: pa.Array) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return at - at[0]


def _unpacked(column: pa.Array) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]].view(np.int64) if data is not None else np.empty(0, np.int64)


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans) of the rows of ``docs`` (doc_id, key, text) that hold strings of SPAN bytes which start in
    a document with a smaller id too; spans are byte stretches (start, end), which may touch or overlap.  ``key`` tells
    texts with one doc_id apart."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "suffixes")

    def kept(name: str, step) -> DataFrame:
        step().write.parquet(f"{folder}/{name}")  # nothing here holds the step's plan any longer
        release(spark)
        return spark.read.parquet(f"{folder}/{name}")

    def filter_of(rows: DataFrame, key=None):
        return spark.sparkContext.broadcast(bit_filter(rows, rows.columns, rows.count(), key))

    digits = kept("digits", lambda: shared_digits(docs))
    distinct = kept("distinct", lambda: distinct_runs(docs, filter_of(digits)))
    crowded, shared = distinct.where("crowded").select("h", "c", "least"), distinct.where("least < most").select("h", "c")
    suffixes = kept("suffixes", lambda: suffix_answers(first_contents(docs, filter_of(crowded, _key_in))))

    def spans() -> DataFrame:
        answered = shared.unionAll(suffixes.select("h", "c"))
        places = run_places(docs, filter_of(answered, _key))
        answers = distinct.select("h", "c", "least", "most").join(suffixes, ["h", "c"], "left").where(
            "least < most or suffixes is not null").drop("most")
        met = places.join(answers, ["h", "c"])
        return (met.select("n", "docs", "keys", "starts", "least", "suffixes")
                .mapInArrow(_intervals, "doc_id long, key long, start long, end long")
                .groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans")))

    return kept("spans", spans)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row of ``docs`` (doc_id, text), with each byte
    removed that a string of SPAN bytes covers which also starts in a document with a smaller doc_id.

    Strings are judged on the input; matches don't cross documents.  A null or empty text has no bytes.  Rows that
    share a doc_id are one document to each other: they don't remove each other's bytes.  Rows without a doc_id stay
    whole and remove nothing.  One output row per input row."""
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "key", "text")
    spans = repeated_stretches(named).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, offsets = flat(batch.column("text"))
            spans = batch.column("spans")
            times = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
            found = pc.list_flatten(spans)  # of a null no spans
            start, end = (found.field(x).to_numpy() for x in ("start", "end"))
            order = np.lexsort((end, start, np.repeat(np.arange(len(times)), times)))
            cuts = list(zip(start[order].tolist(), end[order].tolist(), strict=True))
            ends = np.cumsum(times).tolist()
            for low, high, first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), [0, *ends], ends, strict=False):
                raw = data[low:high].tobytes()
                at = removed = n = 0
                kept = []
                for a, b in cuts[first:last]:
                    if a > at or n == 0:
                        kept.append(raw[at:a])
                        n, at = n + 1, a
                    removed += max(0, b - at)
                    at = max(at, b)
                kept.append(raw[at:])
                out.append((len(raw), removed, n, b"".join(kept)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in cols[:3]),
                                              pa.array(cols[3], pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans, (rows["doc_id"].cast("long") == spans["_id"]) & (rows["key"] == spans["_key"]), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
