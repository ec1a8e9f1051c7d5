"""A gated recurrent language model with a class-factored softmax, next to a unigram base.

Every training document counts towards the vocabulary. The network knows the words most frequent over all of them (the
head, by exact counts), dealt into classes by frequency; all other words are one class, inside which a word's probability is its share of the
class's training counts. So every token of every text has a probability, and a text's score is the sum of their logs.

Training is data-parallel: every training document takes part in exactly one round, by the hash of its id. In each
round every task runs truncated backpropagation through its own documents of the round from the same weights, and the round's weights are the mean over tasks, by the tokens they saw. Scoring carries the
hidden state through a whole document, over all its windows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import chunks as C
from tidemark.llm.common import ASCII_LOWER, pack, runs, unpack, utf8
from tidemark.session import cut_lineage

HELD_OUT, FOLDS = 1, 5
CLASSES, PER_CLASS, HIDDEN, LANES, LEARNING_LANES = 24, 24, 24, 512, 128
HEAD = CLASSES * PER_CLASS
#: Tokens between truncations while learning; while scoring, windows only bound the memory, as the state goes on.
LEARNING_WINDOW, WINDOW = 16, 64
ROUNDS, RATE = 2, 0.05
END = b"\n"  # no word contains it
IN_WORD = bytes(b not in b" \t\n\v\f\r" for b in range(256))
BUCKET_KEYS = 250_000


def _learns(ids: np.ndarray) -> np.ndarray:
    return np.array([i == C.MISSING or zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT for i in ids.tolist()], bool)


def _in_round(ids: np.ndarray, turn: int) -> np.ndarray:
    """Training documents of a round; the rounds share out all of them."""
    return _learns(ids) & np.array([xxhash.xxh32_intdigest(str(i)) % ROUNDS == turn for i in ids.tolist()], bool)


def _keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _most_frequent(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The HEAD keys with the largest sums of their counts, above zero, and the sums; equal ones by their keys."""
    distinct, where = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, counts.astype(np.int64))
    top = np.lexsort((distinct, -total))[:HEAD]
    top = top[total[top] > 0]
    return distinct[top], total[top]


def _places(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The place of each key in the head, HEAD for all others."""
    if not len(head):
        return np.full(len(keys), HEAD, np.int64)
    order = np.argsort(head)
    at = order[np.minimum(np.searchsorted(head, keys, sorter=order), len(head) - 1)]
    return np.where(head[at] == keys, at, HEAD)


def _split(at: np.ndarray, data: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, each word of the documents by its place among them, and the words of each document."""
    lower = data.tobytes().translate(ASCII_LOWER)
    lower, inside = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(IN_WORD), bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]  # a document ends a word too
    letters = lower[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    each, ends = utf8(coded.dictionary)
    each = each.tobytes()
    per_doc = np.diff(np.searchsorted(np.flatnonzero(begins), at))
    return [each[a:b] for a, b in pairwise(ends.tolist())], coded.indices.to_numpy(), per_doc


class Words:
    """A chunk as numbers: its distinct tokens in the order of their hashes, their counts in training documents, and each
    token of each document by its place in that order."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, buckets: int):
        distinct, words, per_doc = _split(at, data)
        self.lengths = per_doc + 1
        tokens = np.full(len(words) + len(per_doc), len(distinct), np.int64)  # the end's number, after every document
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(self.lengths) - 1] = False
        tokens[inside] = words
        keys = _keys([*distinct, END])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        self.keys, self.tokens = keys[order], place[tokens]
        self.counts = np.bincount(self.tokens[np.repeat(_learns(ids), self.lengths)], minlength=len(order)).astype(np.uint32)
        self.bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


WORDS_DDL = "chunk long, ids binary, lengths binary, tokens binary, words array<struct<bucket:int,blob:binary>>"
WORDS = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()),
     ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("blob", pa.binary())])))]
)


def _by_words(docs: DataFrame, buckets: int) -> DataFrame:
    """Chunks of whole documents as numbers, with the keys and counts of their words by bucket; written once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, at, data in C.chunked(rows, C.CHUNK_BYTES):
            words = Words(ids, at, data, buckets)
            asked = C.questions(chunk, words.bucket, lambda s: pack(words.keys[s], words.counts[s]))  # noqa: B023
            blobs = pa.array(asked.select(["bucket", "blob"]).to_pylist(), WORDS.field("words").type.value_type)
            cells = [[chunk], [ids.tobytes()], [words.lengths.tobytes()], [pack(words.tokens)]]
            columns = [pa.array(c, f.type) for c, f in zip(cells, WORDS, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(blobs)], pa.int32()), blobs)], schema=WORDS)

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, WORDS_DDL))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum over each document's tokens; no document is without one."""
    return np.array([part.sum() for part in np.split(values, ends[:-1])])


def _opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and tokens of a chunk."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py()
    return np.frombuffer(get("ids"), np.int64), np.frombuffer(get("lengths"), np.int64), unpack(get("tokens"), "u4")[0]


def _by_bucket(batch: pa.RecordBatch, row: int, name: str, *types: str) -> list[np.ndarray]:
    """Arrays over all words of a chunk, put together from its buckets, which are in the order of the hashes too."""
    found = C.answers_of(batch, row, name)
    return [np.concatenate(c) for c in zip(*(unpack(found[k], *types) for k in sorted(found)), strict=True)]


def _add(blobs: list[bytes]) -> list[np.ndarray]:
    """One bucket of words: the sum of each over all chunks."""
    parts = [unpack(b, "u8", "u4") for b in blobs]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.uint64)
    np.add.at(total, where, np.concatenate([n for _, n in parts]).astype(np.uint64))
    return np.split(total[where], np.cumsum([len(k) for k, _ in parts])[:-1])


class Network:
    """Embedding, one gated recurrent layer, softmax over classes and inside a class; float32 arrays by name.

    Arrays of the layer are (feature, lane), so the gates lie apart and every operation runs over unbroken memory.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(frequencies: np.ndarray) -> Network:
        """Small random weights; biases are the logs of the head's frequencies, the last of the other words."""
        dice = np.random.default_rng(10)
        normal = lambda *shape: (0.08 * dice.standard_normal(shape)).astype(np.float32)
        head = (frequencies[:HEAD] + 0.5).reshape(CLASSES, PER_CLASS)
        of_class = np.append(head.sum(axis=1), frequencies[HEAD] + 0.5)
        return Network(
            {
                "E": normal(HEAD + 1, 3 * HIDDEN), "U": normal(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
                "C": normal(HIDDEN, CLASSES + 1), "c": np.log(of_class / of_class.sum()).astype(np.float32),
                "V": normal(CLASSES, HIDDEN, PER_CLASS), "v": np.log(head / head.sum(axis=1, keepdims=True)).astype(np.float32),
            }
        )

    def run(self, given: Iterable[np.ndarray], start: np.ndarray, h: np.ndarray, states: np.ndarray, saved: tuple[np.ndarray, ...]) -> None:
        """Hidden states before each token, from `h` on, into `states` (time, feature, lane).

        given: for each time the embedding of the token before, the gates' part negated; start: a document begins here.
        saved: room for the state before, both gates, the new value and the recurrent part, of all times or of one.
        """
        gates, recurrent, keep = 2 * HIDDEN, self.w["U"].T, (~start[:, None, :]).astype(np.float32)
        before, zr, n, rec = saved
        rooms = before, zr, zr[:, :HIDDEN], zr[:, HIDDEN:], n, rec, rec[:, :gates], rec[:, gates:]
        rooms = zip(*([room[0]] * len(states) if len(room) == 1 else room for room in rooms), strict=True)
        for own, stays, (before, zr, z, r, n, rec, to_gates, to_new), new in zip(given, keep, rooms, states, strict=True):
            np.multiply(h, stays, before)
            np.matmul(recurrent, before, rec)
            np.subtract(own[:gates], to_gates, zr)
            np.exp(zr, zr)
            np.add(zr, 1.0, zr)
            np.reciprocal(zr, zr)
            np.multiply(r, to_new, n)
            np.add(n, own[gates:], n)
            np.tanh(n, n)
            np.subtract(before, n, new)
            np.multiply(new, z, new)
            np.add(new, n, new)
            h = new

    def output(self, h: np.ndarray, y: np.ndarray, learns: bool = True) -> tuple[np.ndarray, tuple]:
        """Natural log probability of each token given its state; words past the head count as their class.

        Tokens are taken by class, so that each class is one stretch; h: (token, feature). What a learner goes on with
        is told besides, its probabilities only if it learns.
        """
        w = self.w
        cls = np.minimum(y, HEAD) // PER_CLASS
        order = np.argsort(cls.astype(np.int16), kind="stable")  # small numbers are sorted by their digits
        h, cls = np.take(h, order, axis=0), cls[order]
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        inner = cuts[CLASSES]
        p = np.matmul(w["C"].T, h.T)
        p += w["c"][:, None]
        p -= p.max(axis=0)
        own = np.take(p.reshape(-1), cls * len(y) + np.arange(len(y)))
        np.exp(p, out=p)
        total = p.sum(axis=0)
        log = own - np.log(total)
        if learns:
            p /= total
        word = y[order[:inner]] - cls[:inner] * PER_CLASS
        at = np.arange(inner) * PER_CLASS + word
        q = np.empty((inner, PER_CLASS), p.dtype)
        parts = [(k, slice(s, e)) for k, (s, e) in enumerate(pairwise(cuts)) if e > s]
        for k, part in parts:
            np.matmul(h[part], w["V"][k], out=q[part])
        q += np.take(w["v"], cls[:inner], axis=0)
        q -= q.max(axis=1, keepdims=True)
        own = np.take(q.reshape(-1), at)
        np.exp(q, out=q)
        total = q.sum(axis=1, keepdims=True)
        log[:inner] += own - np.log(total[:, 0])
        if learns:
            q /= total
        told = np.empty_like(log)
        told[order] = log
        return told, (order, h, cls, p, at, q, parts)


#: Weights that every window changes as a whole; of the embedding only the rows that it reads.
WHOLE = ("U", "b", "C", "c", "V", "v")


class Learner(Network):
    """A network of its own with Adagrad's memory; all weights but the embedding lie in one array."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.flat = np.concatenate([weights[k].reshape(-1) for k in WHOLE])
        self.grad, self.memory = np.zeros_like(self.flat), np.full_like(self.flat, 0.01)
        self.embedding_memory = np.full_like(weights["E"], 0.01)
        views = lambda whole: _unflat(whole, {k: weights[k] for k in WHOLE}, WHOLE)
        self.g = views(self.grad)
        self._rooms: dict[str, np.ndarray] = {}
        super().__init__({"E": weights["E"].copy(), **views(self.flat)})

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that every window uses again, whatever it holds."""
        size = math.prod(shape)
        if name not in self._rooms or len(self._rooms[name]) < size:
            self._rooms[name] = np.empty(size, np.float32)
        return self._rooms[name][:size].reshape(shape)

    def step(self, x: np.ndarray, start: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window of truncated backpropagation, with an Adagrad update; returns the state carried on."""
        w, g = self.w, self.g
        steps, lanes = x.shape
        room = lambda name, features=HIDDEN: self._room(name, steps, features, lanes)
        rows = lambda name, features=HIDDEN: self._room(name, steps * lanes, features)
        words = x.reshape(-1)
        embedded = np.take(w["E"], words, axis=0, out=rows("embedded", 3 * HIDDEN), mode="clip")
        embedded += w["b"]
        given = room("given", 3 * HIDDEN)
        given[:] = embedded.reshape(steps, lanes, -1).transpose(0, 2, 1)
        np.negative(given[:, : 2 * HIDDEN], out=given[:, : 2 * HIDDEN])
        states, saved = room("states"), (room("before"), room("zr", 2 * HIDDEN), room("n"), room("rec", 3 * HIDDEN))
        self.run(given, start, h, states, saved)
        last = states[-1].copy()
        where = np.flatnonzero(live.reshape(-1))
        if not len(where):
            return last
        seen = rows("seen")
        seen.reshape(steps, lanes, HIDDEN)[:] = states.transpose(0, 2, 1)
        full = len(where) == len(seen)
        h, y = (seen, y.reshape(-1)) if full else (np.take(seen, where, axis=0), y.reshape(-1)[where])
        _, (order, flat, cls, p, word, q, parts) = self.output(h, y)
        scale = np.float32(1.0 / lanes)
        self.grad[:] = 0
        p.reshape(-1)[cls * len(cls) + np.arange(len(cls))] -= 1
        p *= scale
        np.matmul(flat.T, p.T, out=g["C"])
        p.sum(axis=1, out=g["c"])
        back = np.matmul(p.T, w["C"].T)
        q.reshape(-1)[word] -= 1
        q *= scale
        inner = np.empty((len(word), HIDDEN), np.float32)
        for k, part in parts:
            own = q[part]
            np.matmul(flat[part].T, own, out=g["V"][k])
            np.add.reduce(own, axis=0, out=g["v"][k])
            np.matmul(own, w["V"][k].T, out=inner[part])
        back[: len(word)] += inner
        into = rows("into")
        if full:
            place = np.empty_like(order)
            place[order] = where
            np.take(back, place, axis=0, out=into, mode="clip")
        else:
            into[:] = 0
            into[where[order]] = back
        carry = room("carry")
        carry[:] = into.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1)
        # All that the gates contribute to the gradient but the gradient of the state itself, for the whole window.
        before, zr, n, rec = saved
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        through = room("through", 3 * HIDDEN)
        to_z, to_r, to_n = (through[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        less = np.subtract(1, zr, out=room("less", 2 * HIDDEN))
        dn = np.multiply(n, n, out=room("dn"))
        np.subtract(1, dn, out=dn)
        dn *= less[:, :HIDDEN]
        np.subtract(before, n, out=to_z)
        to_z *= z
        to_z *= less[:, :HIDDEN]
        np.multiply(dn, r, out=to_n)
        np.multiply(to_n, rec[:, 2 * HIDDEN :], out=to_r)
        to_r *= less[:, HIDDEN:]
        keep = (~start[:, None, :]).astype(np.float32)
        carried, part = np.zeros((HIDDEN, lanes), np.float32), np.empty((HIDDEN, lanes), np.float32)
        backwards = (a[::-1] for a in (carry, through, through.reshape(steps, 3, HIDDEN, lanes), z, keep))
        for d, own, gates, stays, goes_on in zip(*backwards, strict=True):
            np.add(d, carried, d)
            np.multiply(gates, d, gates)
            np.matmul(w["U"], own, carried)
            np.multiply(d, stays, part)
            np.add(carried, part, carried)
            np.multiply(carried, goes_on, carried)
        np.matmul(before, through.transpose(0, 2, 1)).sum(axis=0, out=g["U"])
        np.multiply(dn, carry, out=to_n)  # the embedding's part of the new value is not behind the reset gate
        pre = rows("embedded", 3 * HIDDEN)
        pre.reshape(steps, lanes, 3 * HIDDEN)[:] = through.transpose(0, 2, 1)
        order = np.argsort(words.astype(np.int16), kind="stable")
        ordered = words[order]
        pre = np.take(pre, order, axis=0, out=rows("ordered", 3 * HIDDEN), mode="clip")
        first = np.flatnonzero(runs(ordered))
        grads = np.empty((len(first), 3 * HIDDEN), np.float32)
        if len(first) > 1:
            np.add.reduceat(pre[: first[-1]], first[:-1], axis=0, out=grads[:-1])
        pre[first[-1] :].sum(axis=0, out=grads[-1])  # mostly words past the head, by far the most
        grads.sum(axis=0, out=g["b"])
        self._move(ordered[first], grads)
        return last

    def _move(self, rows: np.ndarray, embedded: np.ndarray) -> None:
        """An Adagrad update; `embedded` is the gradient of the embedding's `rows`, that of all others is zero."""
        own = self.embedding_memory[rows]
        for whole, grad, memory in ((self.flat, self.grad, self.memory), (None, embedded, own)):
            np.minimum(grad, 1, out=grad)
            np.maximum(grad, -1, out=grad)
            memory += grad * grad
            root = memory + np.float32(1e-6)
            np.sqrt(root, out=root)
            grad *= np.float32(RATE)
            grad /= root
            if whole is not None:
                whole -= grad
        self.embedding_memory[rows] = own
        self.w["E"][rows] -= embedded


def _dealt(rest: list[list[np.ndarray]], docs: list[np.ndarray], number: int, width: int) -> list[list[np.ndarray]]:
    """What lanes hold when documents are dealt to them: the longest first, each to the lane with the least.

    A lane is a list of four arrays (document, token before, token, document begins); documents count from `number`.
    """
    rest = rest + [[] for _ in range(min(width, len(rest) + len(docs)) - len(rest))]
    free = [(len(own[2]) if own else 0, k) for k, own in enumerate(rest)]
    heapq.heapify(free)
    queue: list[list[int]] = [[] for _ in rest]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        load, k = heapq.heappop(free)
        queue[k].append(i)
        heapq.heappush(free, (load + len(docs[i]), k))
    out = []
    for old, own in zip(rest, queue, strict=True):
        length = np.array([len(docs[i]) for i in own], np.int64)
        token = np.concatenate([np.zeros(0, np.int64), *(docs[i] for i in own)])
        begins = np.zeros(len(token), bool)
        begins[np.cumsum(length) - length] = True
        previous = np.where(begins, HEAD, np.append(HEAD, token)[:-1])
        new = np.repeat(np.array(own, np.int64) + number, length), previous, token, begins
        out.append([np.concatenate(both) for both in zip(old, new, strict=True)] if old else [*new])
    return out


def lanes(groups: Iterable[list[np.ndarray]], width: int = LANES, window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents side by side: (document, token before, token, document begins, lane before), all but the last (time, lane).

    Lanes come by falling length, and one that has ended is left out, so a window has fewer at the end. The next group of
    documents is dealt as soon as a lane would end, so that lanes stay full up to the last group; no more is held than
    two groups and what is left of the longest documents. The last array tells which lane of the window before each lane
    goes on, or else a number past them. Document -1 is no document. A document begins as after a word past the head.
    """
    rest: list[list[np.ndarray]] = []
    number, groups = 0, iter(groups)
    group = next(groups, None)
    while group is not None:
        ahead = next(groups, None)
        rest = _dealt(rest, group, number, width)
        number += len(group)
        came = sorted(range(len(rest)), key=lambda k: -len(rest[k][2]))
        rest, came = [rest[k] for k in came], np.array(came, np.int64)
        size = np.array([len(own[2]) for own in rest], np.int64)
        offset = np.cumsum(size) - size
        who, previous, token, begins = (np.concatenate(parts) for parts in zip(*rest, strict=True))
        # With more to come, only windows that are full in every lane.
        end = int(size[0]) if ahead is None else int(size[-1]) // window * window * (len(rest) == width)
        for first in range(0, end, window):
            alive = int((size > first).sum())
            time = np.arange(first, first + window)[:, None]
            live = time < size[:alive]
            at = np.where(live, time + offset[:alive], 0)
            own = np.take(who, at)
            own[~live] = -1
            yield own, np.take(previous, at), np.take(token, at), np.take(begins, at) & live, came[:alive]
            came = np.arange(len(rest))
        if end == 0:
            rest = [rest[k] for k in np.argsort(came).tolist()]  # nothing ran: the lanes stay where they were
        else:
            rest = [[part[end:] for part in own] for own in rest]
        group = ahead


def _carried(h: np.ndarray, came: np.ndarray) -> np.ndarray:
    """The states that the lanes of a window go on from; a lane that is new begins with a document, so with any."""
    return np.concatenate([h, np.zeros((HIDDEN, max(0, int(came.max()) + 1 - h.shape[1])), np.float32)], axis=1)[:, came]


def _told(network: Network, groups: Iterable[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The number of the document, over all groups, and the natural log probability of each token, window by window."""
    h = np.zeros((HIDDEN, 0), np.float32)
    embedding = np.ascontiguousarray((network.w["E"] + network.w["b"]).T)
    np.negative(embedding[: 2 * HIDDEN], out=embedding[: 2 * HIDDEN])
    for who, x, token, begins, came in lanes(groups):
        steps, alive = x.shape
        room = lambda times, features: np.empty((times, features, alive), np.float32)  # noqa: B023, E731
        states, own = room(steps, HIDDEN), room(1, 3 * HIDDEN)[0]
        given = (np.take(embedding, at, axis=1, out=own, mode="clip") for at in x)  # noqa: B023
        saved = room(1, HIDDEN), room(1, 2 * HIDDEN), room(1, HIDDEN), room(1, 3 * HIDDEN)
        network.run(given, begins, _carried(h, came), states, saved)
        h = states[-1]
        seen = np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, HIDDEN)
        who, token = who.reshape(-1), token.reshape(-1)
        if (who < 0).any():
            live = np.flatnonzero(who >= 0)
            seen, token, who = np.take(seen, live, axis=0), token[live], who[live]
        yield who, network.output(seen, token, learns=False)[0].astype(np.float64)


def log_likelihoods(network: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document as a sequence of head words and their class for the rest."""
    out = np.zeros(len(docs))
    for who, log in _told(network, [docs]):
        np.add.at(out, who, log)
    return out


def train(learner: Learner, groups: Iterable[list[np.ndarray]]) -> None:
    h = np.zeros((HIDDEN, 0), np.float32)
    for who, x, token, begins, came in lanes(groups, LEARNING_LANES, LEARNING_WINDOW):
        h = learner.step(x, begins, token, who >= 0, _carried(h, came))


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)]).astype(np.float64)


def _unflat(values: np.ndarray, like: dict[str, np.ndarray], names: Sequence[str] = ()) -> dict[str, np.ndarray]:
    """The parts of an array by name, those of a float32 array as views."""
    out, at = {}, 0
    for k in names or sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from documents whose crc32(doc_id) mod 5 is not 1, all of them for the counts. A null text is empty and has
    the end token alone. A null doc_id learns and is not held out. Repeated rows are counted and scored each; other
    columns are ignored. Words are counted by a 64-bit hash. If nothing is known (no training document), every token
    has the probability of a word past the head. An empty table gives no rows.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total * 0.03) // BUCKET_KEYS))
    table = _by_words(docs, buckets)
    asked = table.select("chunk", F.explode("words").alias("w")).select("w.bucket", "chunk", "w.blob")

    def sized(table_: pa.Table) -> pa.Table:
        """A bucket's tokens and distinct words and, by their sums over all chunks, its most frequent words."""
        keys, seen = (np.concatenate(c) for c in zip(*(unpack(b, "u8", "u4") for b in table_.column("blob").to_pylist()), strict=True))
        top, sums = _most_frequent(keys, seen)
        columns = [int(seen.sum(dtype=np.int64))], [len(np.unique(keys[seen > 0]))], [top.view(np.int64).tolist()], [sums.tolist()]
        kinds = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["n", "v", "keys", "sums"])

    sizes = cut_lineage(asked.groupBy("bucket").applyInArrow(sized, "n long, v long, keys array<long>, sums array<long>"))
    n_all, v_all = (int(x or 0) for x in sizes.agg(F.sum("n"), F.sum("v")).first())
    # A word lies in one bucket, so the most frequent of all are among the most frequent of their buckets.
    ranked = sizes.select(F.explode(F.arrays_zip("keys", "sums")).alias("w")).select("w.*")
    top = ranked.orderBy(F.desc("sums"), "keys").limit(HEAD).collect()  # the network's vocabulary, of fixed size
    head = np.array([r["keys"] for r in top], np.int64).view(np.uint64)
    frequencies = np.zeros(HEAD + 1)
    frequencies[: len(top)] = [r["sums"] for r in top]
    rest, rest_words = n_all - int(frequencies.sum()), v_all - len(top)
    frequencies[HEAD] = max(0, rest)
    network = Network.fresh(frequencies)

    for turn in range(ROUNDS):
        weights = network.w

        def learn(rows: Iterator[pa.RecordBatch], turn: int = turn, weights: dict = weights) -> Iterator[pa.RecordBatch]:
            own, seen = Learner(weights), 0

            def texts() -> Iterator[list[np.ndarray]]:
                """The documents of the round in each chunk, as places in the head."""
                nonlocal seen
                for batch in rows:
                    for row in range(batch.num_rows):
                        ids, lengths, tokens = _opened(batch, row)
                        places = _places(_by_bucket(batch, row, "words", "u8", "u4")[0], head)[tokens]
                        ends = np.cumsum(lengths)
                        found = [places[e - n : e] for e, n, t in zip(ends.tolist(), lengths.tolist(), _in_round(ids, turn), strict=True) if t]
                        seen += sum(map(len, found))
                        if found:
                            yield found

            train(own, texts())
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(seen * _flat(own.w)).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["w", "n"])

        # The sums meet in two steps, so no task holds more than the weights of a few others at once.
        learned = table.mapInArrow(learn, "w binary, n long")

        def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = None, 0
            for batch in rows:
                for w, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(w.as_py(), np.float64)
                    total, seen = (part.copy() if total is None else total + part), seen + n
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["w", "n"])

        parts = learned.repartition(8).mapInArrow(add, "w binary, n long").collect()  # eight sums of the weights at most
        if parts:
            whole = sum(np.frombuffer(p.w, np.float64) for p in parts) / sum(p.n for p in parts)
            network = Network(_unflat(whole, weights))

    def answer(blobs: list[bytes]) -> list[bytes]:
        """One bucket of words: the sum of each over all chunks, and its place in the head."""
        return [pack(n, _places(unpack(blob, "u8", "u4")[0], head).astype(np.uint16)) for n, blob in zip(_add(blobs), blobs, strict=True)]

    known = C.with_answers(table.drop("words"), cut_lineage(C.answered(asked, answer)), "counts")
    final = network.w
    out = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, log = [], np.zeros(0)

        def texts() -> Iterator[list[np.ndarray]]:
            """The documents of each chunk, as places in the head."""
            nonlocal log
            for batch in rows:
                for row in range(batch.num_rows):
                    ids, lengths, tokens = _opened(batch, row)
                    c, head_of = _by_bucket(batch, row, "counts", "u8", "u2")
                    base = np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
                    # Inside the last class: the share of its counts, with half a count for each word and one for all unseen.
                    inside = np.where(head_of == HEAD, np.log10((c + 0.5) / (max(0, rest) + 0.5 * (max(0, rest_words) + 1))), 0.0)
                    ends = np.cumsum(lengths)
                    parts.append((ids, lengths, *(_sums(values[tokens], ends) for values in (c > 0, base, inside))))
                    log = np.append(log, np.zeros(len(ids)))
                    yield np.split(head_of.astype(np.int64)[tokens], ends[:-1])

        # Lanes go on from chunk to chunk, so a task has one tail of long documents; of a document only its sums are kept.
        for who, of_token in _told(Network(final), texts()):
            np.add.at(log, who, of_token)
        if parts:
            ids, lengths, known_, base, inside = (np.concatenate(c) for c in zip(*parts, strict=True))
            columns = [
                pa.array(ids, mask=ids == C.MISSING), pa.array(~_learns(ids)), pa.array(lengths), pa.array(known_),
                pa.array(np.full(len(ids), n_all)), pa.array(base), pa.array(log / np.log(10) + inside),
            ]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return known.mapInArrow(
        judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
