"""SimHash near-duplicates by anchor-point covering.

The anchors are a covering code of the 64-bit space: the product of nine Hamming(7,4) codes and one free bit, 2**37
code words, each fingerprint within nine bits of one (its home). Two fingerprints that differ in at most two bits have
a midpoint within one bit of both, so both are sent to the home of every point within one bit of them, all of which
lie within the covering radius plus the threshold; they meet at the midpoint's home. That is 17 to 29 anchors for each
distinct fingerprint, and pairs are compared only where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, own_columns, runs, utf8, without
from tidemark.llm.components import components
from tidemark.session import cut_lineage

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: From this many fingerprints at one anchor, neighbours are looked up by their bits and not by comparing all.
DENSE = 4096


def fingerprint(text: bytes) -> int:
    """Majority of each bit over the hashes of the word shingles; shingles that repeat count each time."""
    found = text.translate(ASCII_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    n = max(1, len(found) - SHINGLE + 1)
    first, last = [0, *ends[: n - 1].tolist()], (ends[len(found) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(first, last, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the key of the text, and the fingerprint as a signed long; a null text counts as empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, at = utf8(batch.column(2))
            raw = data.tobytes()
            found = np.array([fingerprint(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_key", "fp"])

    read = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"), "text")
    return read.mapInArrow(run, "doc_id long, _key long, fp long")


def _home() -> np.ndarray:
    """The code word of each seven-bit block: the position that the parity check names is flipped."""
    blocks = np.arange(128, dtype=np.int64)
    check = np.zeros(128, np.int64)
    for bit in range(7):
        check ^= np.where(blocks >> bit & 1, bit + 1, 0)
    return np.where(check > 0, blocks ^ (1 << np.maximum(check - 1, 0)), blocks).astype(np.uint64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for the home of every point within one bit of each fingerprint."""
    home = _home()
    seven = np.uint64(127)
    blocks = [(fps >> np.uint64(7 * b)) & seven for b in range(9)]
    top = fps & np.uint64(1 << 63)
    own = top.copy()
    for b, block in enumerate(blocks):
        own |= home[block] << np.uint64(7 * b)
    out, who = [own, own ^ np.uint64(1 << 63)], [fps, fps]
    for b, block in enumerate(blocks):
        shift = np.uint64(7 * b)
        rest = own & ~(seven << shift)
        flipped = np.sort(home[block[:, None] ^ (np.uint64(1) << np.arange(7, dtype=np.uint64))[None, :]], axis=1)
        new = np.ones(flipped.shape, bool)
        new[:, 1:] = flipped[:, 1:] != flipped[:, :-1]
        new &= flipped != home[block][:, None]
        row, col = np.nonzero(new)
        out.append(rest[row] | flipped[row, col] << shift)
        who.append(fps[row])
    return np.concatenate(out), np.concatenate(who)


def _near(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array of distinct fingerprints that differ in at most two bits."""
    n, left, right = len(fps), [], []
    if n <= DENSE:
        for s in range(1, n):
            hit = np.flatnonzero(np.bitwise_count(fps[s:] ^ fps[:-s]) <= THRESHOLD)
            left.append(hit), right.append(hit + s)
    else:
        bits = [1 << b for b in range(64)]
        for mask in [*bits, *(a | b for a, b in combinations(bits, 2))]:
            want = fps ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(fps, want), n - 1)
            hit = np.flatnonzero((fps[at] == want) & (want > fps))
            left.append(hit), right.append(at[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _spanning(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the least one it is connected with at this anchor; at most one for each."""
    a, b = _near(fps)
    label = np.arange(len(fps))
    while len(a):
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], least), np.minimum.at(now, label[b], least)
        now = now[now]
        now = np.minimum(now, now[label])
        if (now == label).all():
            break
        label = now
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints of one anchor; rows come sorted by (anchor, fp), and a group may span batches."""

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = runs(anchor)
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(anchor))
        a, b = [], []
        two = starts[sizes == 2]
        hit = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= THRESHOLD]
        a.append(fp[hit + 1]), b.append(fp[hit])
        for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = _spanning(np.sort(fp[s : s + size]))
            a.append(x), b.append(y)
        pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)) for p in np.ascontiguousarray(pair)], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in rows:
        held.append(tuple(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns))
        if held[0][0][0] == held[-1][0][-1]:
            continue  # still the same anchor
        anchor, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        last = np.flatnonzero(runs(anchor))[-1]
        yield links(anchor[:last], fp[:last])
        held = [(anchor[last:], fp[last:])]
    if held:
        yield links(*(np.concatenate(c) for c in zip(*held, strict=True)))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all distinct fingerprints (fp) within two bits of each other."""

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                both = anchors(fps[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in both], names=["anchor", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "anchor long, fp long")
    sorted_ = dealt.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return sorted_.mapInArrow(_compare, "a long, b long").distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, _key, fp, component_id of every document."""
    printed = cut_lineage(fingerprints(docs))
    least = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(least))
    joined = least.join(member, least["fp"] == member["node"], "left")
    label = F.coalesce("root", "fp").alias("label")
    smallest = joined.groupBy(label).agg(F.min("least").alias("component_id"))
    of = joined.select("fp", label).join(smallest, "label").select("fp", "component_id")
    return printed.join(of, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of `docs` its fingerprint and the smallest doc_id that is linked to it, over any number of links.

    Fingerprints link at two or fewer differing bits. A text without words has fingerprint zero, links like any other;
    null counts as empty. Repeated rows are reported each. A null doc_id is never the smallest unless its component has
    no other, and is then the component's id. Columns other than doc_id and text are not returned.
    Equal fingerprints are one row from the first shuffle on, so a large group of copies costs one fingerprint. At an
    anchor only links that span its groups come out, at most one for each fingerprint.
    """
    found = _grouped(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, the one that names it; all columns stay.

    Of rows that repeat a doc_id with its text one stays, chosen by the rows' other columns.
    """
    found = _grouped(docs)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = without(own_columns(docs, "_key", "_key_of_row", "_id"), gone, F.xxhash64(F.coalesce("text", F.lit(""))))
    return kept
