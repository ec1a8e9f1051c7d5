"""Plain versions of the operators, for small inputs: no Spark, no index, no sharing."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import public_tokenizers
import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def repeated_bytes(docs: dict[int, str | None], width: int = 50) -> dict[int, tuple]:
    """op1: n_bytes, n_removed, n_spans, sha256 of the rest."""
    first: dict[bytes, int] = {}
    raw = {i: (t or "").encode() for i, t in docs.items()}
    for i in sorted(raw):
        for p in range(len(raw[i]) - width + 1):
            first.setdefault(raw[i][p : p + width], i)
    out = {}
    for i, text in raw.items():
        gone = bytearray(len(text))
        for p in range(len(text) - width + 1):
            if first[text[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text: str | None) -> int:
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(docs: dict[int, str | None], threshold: int = 2) -> dict[int, tuple[str, int]]:
    """op5: fingerprint in hexadecimal digits and the smallest reachable id."""
    prints = {i: fingerprint(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def check_packing(docs: dict[int, str | None], rows: list, capacity: int = 2048) -> int:
    """op2: raises if a piece is wrong; returns the padding tokens."""
    coder = tokenizer()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            raw = b"".join(x.to_bytes(4, "little") for x in part)
            assert r["start"] == at and len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert zlib.crc32(raw) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def style_tree(rows: list[tuple[str, list[tuple]]]) -> dict[tuple[str, int], tuple]:
    """op8: pages and importance of each (host, path), from the branches of each different page of a host:
    (path, presentation, text, characters, characters in links, kinds of child)."""
    held = defaultdict(list)
    for host, found in rows:
        for path, *rest in found:
            held[host, path].append(rest)

    def spread(values: list) -> float:
        n = len(values)
        shares = [values.count(v) / n for v in set(values)]
        return 1.0 if n == 1 else sum(-p * math.log(p) for p in shares) / math.log(n)

    out = {}
    for key, each in held.items():
        shown, texts, sizes, linked, kinds = zip(*each, strict=True)
        weight = 0.9 ** max(kinds)
        out[key] = (len(each), (1 - weight) * spread(list(shown)) + weight * spread(list(texts)) * (1 - sum(linked) / sum(sizes)))
    return out
