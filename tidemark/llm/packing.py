"""Harmonic packing: lengths fall into reciprocal-capacity classes, and a bin of a class holds a fixed number of documents."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
END_ID = 1
#: Distinct parts of text, and distinct words in them, whose ids a task remembers.
MAX_PARTS, MAX_WORDS = 500_000, 300_000
#: Words that are put to the tokenizer in one text, and the mark between them.
TOGETHER, _BAR = 500, "|"
#: Characters of text whose new words are looked up at once.
MOST_TOGETHER = 500_000
_PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]
_MARKS = ".,!?;:$%&*#"
_LOWER = {c: c + 32 for c in range(65, 91)}
_TOKENIZERS: dict[str, Tokenizer] = {}

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _ids(tokenizer: Tokenizer, words: Iterable[str]) -> dict[str, bytes]:
    """Token ids of each word.

    A word of a-z alone is its own normalised form and its own pre-token, so the model takes it as it is. Others go
    through the whole tokenizer, many in one text; between them stands a mark that is a token of its own. Words with that
    mark, which also spell the special tokens, go alone.
    """
    found: dict[str, bytes] = {}
    together, tokenize = [], tokenizer.model.tokenize
    for word in words:
        if word.isascii() and word.isalpha() and word.islower():
            coded = [token.id for token in tokenize(word)]
            found[word] = _PACK[len(coded)](*coded) if len(coded) < len(_PACK) else struct.pack(f"<{len(coded)}I", *coded)
        elif _BAR not in word:
            together.append(word)
        else:
            found[word] = np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
    (bar,) = tokenizer.encode(_BAR, add_special_tokens=False).ids
    for at in range(0, len(together), TOGETHER):
        some = together[at : at + TOGETHER]
        ids = np.array(tokenizer.encode(f" {_BAR} ".join(some), add_special_tokens=False).ids, "<u4")
        ends = [*(4 * np.flatnonzero(ids == bar)).tolist(), 4 * len(ids)]
        raw, start = ids.tobytes(), 0
        for word, end in zip(some, ends, strict=True):
            found[word] = raw[start:end]
            start = end + 4
    return found


def encoder(path: str) -> Callable[[Sequence[str]], Iterator[bytes]]:
    """Token ids of texts and the end id, little-endian in four bytes each, with the ids of each blank-separated part remembered.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its parts.
    """
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    tokenizer = _TOKENIZERS[path]
    known: dict[str, bytes] = {}
    words: dict[str, bytes] = {}
    end = np.array([END_ID], "<u4").tobytes()

    def learn(parts: Iterable[str]) -> None:
        """A word is looked up without its capitals, which the tokenizer drops, and apart from marks after a letter."""
        plain, marks = {}, {}
        for part in parts:
            if part.isascii() and part.isalpha():
                plain[part] = part.lower()
                continue
            word = part.rstrip(_MARKS)
            # A capital whose small form ends in a combining mark would share a token with what follows.
            word = word if word and word[-1].lower().isalpha() else part
            folded = word if _BAR in word else word.lower() if word.isascii() else word.translate(_LOWER)
            plain[part] = folded
            if len(word) < len(part):
                marks[part] = part[len(word) :]
        wanted = {*plain.values(), *marks.values()}
        if len(words) + len(wanted) > MAX_WORDS:
            words.clear()
        words.update(_ids(tokenizer, wanted.difference(words)))
        known.update({part: words[word] for part, word in plain.items()})
        known.update({part: known[part] + words[after] for part, after in marks.items()})

    def encode(texts: Sequence[str]) -> Iterator[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = set(itertools.chain.from_iterable(split)).difference(known)
        if len(known) + len(new) > MAX_PARTS:
            known.clear()
            new = set(itertools.chain.from_iterable(split))
        if new:
            learn(new)
        for parts in split:
            yield b"".join(map(known.__getitem__, parts)) + end

    return encode


def together(texts: Iterator[tuple[int | None, str]]) -> Iterator[list[tuple[int | None, str]]]:
    """Texts of about MOST_TOGETHER characters at a time; a longer one comes alone."""
    held, size = [], 0
    for doc_id, text in texts:
        if held and size + len(text) > MOST_TOGETHER:
            yield held
            held, size = [], 0
        held.append((doc_id, text))
        size += len(text)
    if held:
        yield held


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """`n` as whole capacities and then falling powers of two."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    bit = capacity >> 1
    while rest:
        if rest & bit:
            out.append(bit)
            rest ^= bit
        bit >>= 1
    return out


#: A stretch of a document: doc_id, its first token, its ids in four bytes each, and the document's number of tokens.
Stretch = tuple[int | None, int, bytes, int]


class Bins:
    """The open bins of one task, one per class; class k takes lengths of at most capacity / k, and k of them to a bin."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[Stretch]] = {}
        self.filled: dict[int, int] = {}
        self.done: list[tuple] = []

    def add(self, stretch: Stretch) -> None:
        """Put a stretch of at most `capacity` tokens into its class.

        A bin with its k stretches has less than a length of its class left. The next stretch of the class is cut to fill
        that; what is left of it is a shorter one, which goes to its own class.
        """
        doc_id, start, raw, n = stretch
        while size := len(raw) // 4:
            k = self.capacity // size
            held = self.open.setdefault(k, [])
            filled = self.filled.get(k, 0)
            if len(held) < k:
                held.append((doc_id, start, raw, n))
                self.filled[k] = filled + size
                if filled + size == self.capacity:
                    self._close(k)
                return
            gap = self.capacity - filled
            held.append((doc_id, start, raw[: 4 * gap], n))
            self._close(k)
            start, raw = start + gap, raw[4 * gap :]

    def _close(self, k: int) -> None:
        self._write(self.open.pop(k))
        del self.filled[k]

    def _write(self, held: list[Stretch]) -> None:
        offset = 0
        for doc_id, start, raw, n in held:
            size = len(raw) // 4
            self.done.append((doc_id, start, size, zlib.crc32(raw), n, self.next, offset))
            offset += size
        self.next += 1

    def rest(self) -> None:
        """What no bin was filled with, one stretch behind the other, as whole sequences and then falling powers of two."""
        left = [stretch for k in sorted(self.open) for stretch in self.open[k]][::-1]
        for size in cut(sum(self.filled.values()), self.capacity):
            held: list[Stretch] = []
            while size:
                doc_id, start, raw, n = left.pop()
                taken = min(size, len(raw) // 4)
                held.append((doc_id, start, raw[: 4 * taken], n))
                if 4 * taken < len(raw):
                    left.append((doc_id, start + taken, raw[4 * taken :], n))
                size -= taken
            self._write(held)
        self.open, self.filled = {}, {}


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` tokens; one row per piece.

    A document's ids are its tokens and then the end id; a null or empty text has the end id alone. Whole capacities of a
    long document are sequences of their own. What remains falls into class k if it is at most capacity / k but more than
    capacity / (k + 1) tokens, and a bin takes k of its class, in each task for itself. The little that is then left of a
    bin is filled by cutting the next document of the class, so a document is cut at most once more per bin it fills. The
    open bins at a task's end are put one behind the other, as whole sequences and then powers of two, which need no padding.
    So no token is padding, whatever the lengths. Nothing shuffles, and a task holds less than a bin of each class.
    Sequence ids carry the task's number in their high bits. Repeated rows are packed each for itself; a null doc_id
    stays null; other columns are ignored. `capacity` has to be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer_path), Bins(TaskContext.get().partitionId() << 40, capacity)

        def out() -> pa.RecordBatch:
            columns, bins.done = list(zip(*bins.done, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

        for batch in rows:
            texts = ((doc_id, text.as_py() or "") for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            for some in together(texts):
                for (doc_id, _), raw in zip(some, encode([text for _, text in some]), strict=True):
                    n = len(raw) // 4
                    whole = n - n % capacity
                    for start in range(0, whole, capacity):
                        bins.add((doc_id, start, raw[4 * start : 4 * (start + capacity)], n))
                    bins.add((doc_id, whole, raw[4 * whole :], n))
                    if len(bins.done) >= 20_000:
                        yield out()
        bins.rest()
        if bins.done:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, DDL)
