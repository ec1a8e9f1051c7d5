"""Repeated substrings by suffix sorting with a sampled cover, one bucket of suffixes at a time.

Every suffix counts by its first `width` bytes (a window), so the order that matters ends there.

The cover sample is chosen by content: of the 20-byte strings in a window the one with the smallest hash is sampled.
Equal windows then share a sampled offset, which is what a difference cover is for. Residues modulo a number would
need a sample at every fifth byte and all suffixes in the shuffle; this one is at every sixteenth, and only suffixes
that can tie are moved. A run of windows with the same sample is one stretch of text, 64 bytes on average.

1. Ranks of the cover samples: each stretch has a name, (hash of the sample, hash of the stretch). Names meet in
   buckets of the sample's hash, and a bucket is sorted by itself. Equal names are the long ties: they are resolved
   by rank alone, by the smallest document with that name, and their bytes never move.
2. What is left are stretches whose sample is shared while their text differs, 5 % here. Their bytes go to the
   sample's bucket, where the suffixes are sorted and equal windows get the smallest document. A sample with very many
   different stretches is dealt by whole windows instead.
3. Each chunk of documents marks its windows and cuts the bytes they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import chunks as C
from tidemark.llm.common import pack, runs, unpack
from tidemark.session import cut_lineage

WIDTH, SAMPLE = 50, 20
#: Names that a bucket of the first step holds on average.
BUCKET_NAMES = 250_000
#: Different stretches of one sample, in a chunk and in a bucket, from which whole windows are dealt.
HOT_IN_CHUNK, HOT_IN_BUCKET = 64, 5_000
_BLOCK = 1 << 18
_SLICE = 1 << 16
_DICE = np.random.default_rng(20)
_BYTE = _DICE.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
UNIQUE, REPEATED, OPEN, DEALT = 0, 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a byte array the smallest hash of its samples, and the hash of the window."""
    powers, h, m = {}, _BYTE[data], 1
    while True:
        powers[m] = h
        if 2 * m > WIDTH or len(h) <= m:
            break
        h = h[:-m] * _power(m) + h[m:]
        m *= 2

    def hashes(n: int) -> np.ndarray:
        done, out = 0, None
        for m in (32, 16, 8, 4, 2, 1):
            if n & m:
                part = powers[m][done:]
                out = part if out is None else out[: len(part)] * _power(m) + part[: len(out)]
                done += m
        return out[: len(data) - n + 1]

    least, span, m = _mix(hashes(SAMPLE)), WIDTH - SAMPLE + 1, 1
    while 2 * m <= span:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    rest = span - m
    least = np.minimum(least[: len(least) - rest], least[rest:])
    return least, _mix(hashes(WIDTH))


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """sample, name, document number, start and number of windows of each stretch; documents keep apart."""
    found: list[tuple[np.ndarray, ...]] = []
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _BLOCK, side="right")) - 1)
        base, part = at[first], data[at[first] : at[last]]
        ends = at[first + 1 : last + 1] - base
        first, doc0 = last, first
        if len(part) < WIDTH:
            continue
        least, whole = _windows(part)
        n = len(least)
        doc = np.searchsorted(ends, np.arange(n), side="right")
        inside = np.arange(n) + WIDTH <= ends[np.minimum(doc, len(ends) - 1)]
        new = runs(least) | runs(doc)
        new[1:] |= ~inside[:-1]
        starts = np.flatnonzero(new & inside)
        if not len(starts):
            continue
        breaks = np.flatnonzero(new | ~inside)
        stops = np.append(breaks, n)[np.searchsorted(breaks, starts, side="right")]
        # A stretch of periodic text is cut, so that its first and last window cover it.
        limit = WIDTH - SAMPLE + 1
        pieces = (stops - starts + limit - 1) // limit
        which = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[which] + nth * limit
        count = np.minimum(stops[which] - begin, limit)
        name = _mix(whole[begin] * np.uint64(3) + whole[begin + count - 1] + count.astype(np.uint64))
        found.append((least[begin], name, doc[begin] + doc0, begin + base, count))
    if not found:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Names:
    """The distinct names of a chunk in order, the smallest document of each, and which stretch has which name."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, buckets: int):
        self.data = data
        sample, name, self.doc, self.start, self.count = stretches(data, at)
        self.sample, self.name = sample >> np.uint64(16), (name >> np.uint64(16)) | np.uint64(1)  # 48 bits; name 0 is free
        self.id = ids[self.doc]
        order = np.lexsort((self.start, self.id, self.name, self.sample))
        s, n = self.sample[order], self.name[order]
        new = runs(s) | runs(n)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = order[new]  # the stretch that stands for its name
        self.sample, self.name, self.least = s[new], n[new], self.id[order][new]
        group = np.cumsum(runs(self.sample)) - 1 if len(self.sample) else np.empty(0, np.int64)
        self.hot = np.bincount(group, minlength=1)[group] > HOT_IN_CHUNK if len(group) else np.empty(0, bool)
        self.bucket = (self.sample * np.uint64(buckets) >> np.uint64(48)).astype(np.int64)
        # A hot sample is asked about once, under the free name; its own stretches are dealt in any case.
        lead = runs(self.sample) if len(group) else np.empty(0, bool)
        self.asked = np.flatnonzero(~self.hot | lead)

    def question(self) -> tuple[np.ndarray, ...]:
        own = self.asked
        least = np.minimum.reduceat(self.least, np.flatnonzero(runs(self.sample))) if len(own) else self.least
        group = np.cumsum(runs(self.sample)) - 1 if len(own) else own
        hot = self.hot[own]
        return self.bucket[own], self.sample[own], np.where(hot, 0, self.name[own]), np.where(hot, least[group[own]] if len(own) else 0, self.least[own])

    def codes(self, answers: dict[int, bytes]) -> np.ndarray:
        code = np.where(self.hot, DEALT, UNIQUE).astype(np.uint8)
        buckets = self.bucket[self.asked]
        for bucket, blob in answers.items():
            own = self.asked[slice(*np.searchsorted(buckets, [bucket, bucket + 1]))]
            code[own] = np.where(self.hot[own], DEALT, unpack(blob, "u1")[0])
        return code


def _bytes5(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].copy().view(f"V{n}").reshape(-1)


def _long(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :n] = x.view(np.uint8).reshape(-1, n)
    return out.view("<u8").reshape(-1)


def _rank(blobs: list[bytes]) -> list[bytes]:
    """One bucket of names: which are repeated by rank alone, and which samples need their text."""
    parts = [unpack(b, "V6", "V6", "i8") for b in blobs]
    sizes = [len(p[0]) for p in parts]
    sample, name = (_long(np.concatenate([p[i] for p in parts]), 6) for i in (0, 1))
    doc = np.concatenate([p[2] for p in parts])
    code = np.full(len(doc), UNIQUE, np.uint8)
    by = np.argsort(sample, kind="stable")
    new = runs(sample[by])
    size = np.diff(np.append(np.flatnonzero(new), len(by)))
    by = by[np.repeat(size > 1, size)]  # most samples occur once
    if len(by):
        by = by[np.lexsort((doc[by], name[by], sample[by]))]
        s, n, d = sample[by], name[by], doc[by]
        first_s = runs(s)
        first_n = first_s | runs(n)
        at = np.flatnonzero(first_s)
        group = np.cumsum(first_s) - 1
        least_n = d[np.flatnonzero(first_n)][np.cumsum(first_n) - 1]
        different = np.add.reduceat(first_n.astype(np.int64), at)
        mixed = (different > 1) & (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at))
        dealt = (n[at] == 0) | (different > HOT_IN_BUCKET)
        found = np.where(d > least_n, REPEATED, np.where(mixed[group], OPEN, UNIQUE))
        code[by] = np.where(dealt[group], DEALT, found)
    return [pack(part) for part in np.split(code, np.cumsum(sizes)[:-1])]


def _sort_suffixes(blobs: list[bytes]) -> list[bytes]:
    """One bucket of stretches: for each window whether a smaller document has it."""
    counts, docs, texts, sizes = [], [], [], []
    for blob in blobs:
        cut = int.from_bytes(blob[:8], "little")
        count, doc = unpack(blob[8 : 8 + cut], "u1", "i8")
        counts.append(count.astype(np.int64)), docs.append(doc), texts.append(zstandard.ZstdDecompressor().decompress(blob[8 + cut :]))
        sizes.append(int(counts[-1].sum()))
    count, doc = np.concatenate(counts), np.concatenate(docs)
    text = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(count + WIDTH - 1) - (count + WIDTH - 1)
    which = np.repeat(np.arange(len(count), dtype=np.int32), count)
    suffix = (begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    owner = doc[which]
    del which, begin
    eight, whole = (np.lib.stride_tricks.sliding_window_view(text, n) for n in (8, WIDTH))

    def keys(at: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(eight[at + k]).view(">u8").reshape(-1).astype(np.uint64) for k in (*range(0, WIDTH - 8, 8), WIDTH - 8)]

    # Suffixes are sorted by a hash of their bytes first; the bytes settle which neighbours are equal. Bytes are looked
    # at in slices, so a bucket takes some 40 bytes for each suffix.
    mixed = np.empty(len(suffix), np.uint64)
    for s in (slice(k, k + _SLICE) for k in range(0, len(suffix), _SLICE)):
        found = np.zeros(len(suffix[s]), np.uint64)
        for key in keys(suffix[s]):
            found = _mix(found * np.uint64(_BASE) + key)
        mixed[s] = found
    order = np.lexsort((owner, mixed))
    new = runs(mixed[order])
    del mixed
    same = np.flatnonzero(~new)
    at = suffix[order]
    clash = any((whole[at[i]] != whole[at[i - 1]]).any() for i in (same[k : k + _SLICE] for k in range(0, len(same), _SLICE)))
    if clash:  # two texts with one hash: sort by all bytes
        order = np.lexsort((owner, *keys(suffix)[::-1]))
        new = np.zeros(len(order), bool)
        for key in keys(suffix):
            new |= runs(key[order])
    sorted_owner = owner[order]
    repeated = np.empty(len(order), bool)
    repeated[order] = sorted_owner > sorted_owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = []
    for part in np.split(repeated, np.cumsum(sizes)[:-1]):
        out.append(zstandard.ZstdCompressor(level=1).compress(np.packbits(part).tobytes()))
    return out


def _open_stretches(names: Names, code: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """bucket, name, first window in its stretch, windows: what the second step compares, in a fixed order."""
    whole, dealt = np.flatnonzero(code == OPEN), np.flatnonzero(code == DEALT)
    count = names.count[names.first[dealt]]
    each = np.repeat(dealt, count)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    bucket = names.bucket[whole]
    if len(each):
        at = names.start[names.first[each]] + nth
        rows = np.lib.stride_tricks.sliding_window_view(names.data, WIDTH)[at]
        hashed = np.zeros(len(each), np.uint64)
        for k in range(WIDTH):
            hashed = hashed * np.uint64(_BASE) + _BYTE[rows[:, k]]
        # Every window of a hot sample goes by its own bytes.
        hashed = _mix(hashed)
        bucket = np.append(bucket, ((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
    name = np.append(whole, each)
    first = np.append(np.zeros(len(whole), np.int64), nth)
    windows = np.append(names.count[names.first[whole]], np.ones(len(each), np.int64))
    order = np.argsort(bucket, kind="stable")
    return bucket[order], name[order], first[order], windows[order]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """For every document its bytes without those that a smaller document has in a run of 50 or more.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes. Strings are judged on the
    input; overlaps count; nothing matches across documents or within one. A null text is empty. A null doc_id counts
    as the largest, so such rows are cut against all others and not against each other; rows that repeat a doc_id are
    not cut against each other either. Other columns are ignored. An empty table gives no rows.
    """
    table = C.gather(docs)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-int(total * 0.065) // BUCKET_NAMES))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in range(batch.num_rows):
                chunk, ids, at, data = C.opened(batch, row)
                bucket, sample, name, least = Names(ids, at, data, buckets).question()
                if len(bucket):
                    yield C.questions(chunk, bucket, lambda s: pack(_bytes5(sample[s], 6), _bytes5(name[s], 6), least[s]))  # noqa: B023

    def ask_text(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in rows:
            for row in range(batch.num_rows):
                chunk, ids, at, data = C.opened(batch, row)
                names = Names(ids, at, data, buckets)
                bucket, name, first, windows = _open_stretches(names, names.codes(C.answers_of(batch, row, "ranks")), buckets)

                def packed(s: slice) -> bytes:
                    head = pack(windows[s].astype(np.uint8), names.least[name[s]])  # noqa: B023
                    text = data[_spread(names.start[names.first[name[s]]] + first[s], windows[s] + WIDTH - 1)]  # noqa: B023
                    return len(head).to_bytes(8, "little") + head + squeeze.compress(text.tobytes())

                if len(bucket):
                    yield C.questions(chunk, bucket, packed)

    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in range(batch.num_rows):
                _, ids, at, data = C.opened(batch, row)
                names = Names(ids, at, data, buckets)
                code = names.codes(C.answers_of(batch, row, "ranks"))
                # Windows of the stretch that stands for a name; the name's other stretches in that document are equal.
                mask = np.zeros((len(code), WIDTH - SAMPLE + 1), bool)
                mask[code == REPEATED] = True
                bucket, name, first, windows = _open_stretches(names, code, buckets)
                for b, blob in C.answers_of(batch, row, "texts").items():
                    s = slice(*np.searchsorted(bucket, [b, b + 1]))
                    n = int(windows[s].sum())
                    bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8))[:n]
                    mask[np.repeat(name[s], windows[s]), _spread(first[s], windows[s])] = bits
                hit = mask[names.of]
                hit[names.id > names.least[names.of]] = True
                hit &= np.arange(hit.shape[1]) < names.count[:, None]
                which, nth = np.nonzero(hit)
                change = np.zeros(len(data) + 1, np.int32)
                begin = names.start[which] + nth
                np.add.at(change, begin, 1)
                np.add.at(change, begin + WIDTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                opens[at[:-1][at[:-1] < len(data)]] = gone[at[:-1][at[:-1] < len(data)]]
                removed = np.concatenate([[0], np.cumsum(gone)])
                spans = np.concatenate([[0], np.cumsum(opens)])
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [
                    pa.array(ids, mask=ids == C.MISSING), pa.array(np.diff(at)), pa.array(removed[at[1:]] - removed[at[:-1]]),
                    pa.array(spans[at[1:]] - spans[at[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    question = "bucket int, chunk long, blob binary"
    ranks = cut_lineage(C.answered(table.mapInArrow(ask, question), _rank))
    ranked = C.with_answers(table, ranks, "ranks")
    texts = cut_lineage(C.answered(ranked.mapInArrow(ask_text, question), _sort_suffixes))
    return C.with_answers(ranked, texts, "texts").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
