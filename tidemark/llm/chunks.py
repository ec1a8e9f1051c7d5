"""Documents gathered into chunks of a few megabytes, and questions that chunks put to buckets of a shared key space.

A chunk asks about many keys at once, one row for each (chunk, bucket), and gets one row back. So millions of keys
travel as compressed arrays, a hot key travels once for each chunk that holds it, and no row is larger than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_ids, utf8
from tidemark.session import cut_lineage

CHUNK_BYTES = 2 << 20
MISSING = np.iinfo(np.int64).max
SCHEMA = pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("data", pa.binary())])
DDL = "chunk long, n_bytes long, ids binary, ends binary, data binary"


def chunked(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """chunk, ids, offsets and bytes of whole documents (doc_id, text), inside a task; numbers hold as long as its input does."""
    number = TaskContext.get().partitionId() << 32
    for batch in rows:
        ids, (data, at) = doc_ids(batch.column(0)), utf8(batch.column(1))
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
            yield number, ids[first:last], at[first : last + 1] - at[first], data[at[first] : at[last]]
            number, first = number + 1, last


def gather(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of whole documents, written to the shared folder, so that their numbers hold for all later steps.

    A null text counts as empty and a null doc_id as the largest id. A longer document is a chunk of its own.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for number, ids, at, part in chunked(rows, size):
            columns = [[number], [len(part)], [ids.tobytes()], [at[1:].astype("<i8").tobytes()], [pack.compress(part.tobytes())]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, DDL))


def opened(batch: pa.RecordBatch, row: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """chunk, ids, offsets and bytes of a row."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py()
    ids, ends = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("ends"), np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(get("data"), max_output_size=max(1, get("n_bytes"))), np.uint8)
    return get("chunk"), ids, np.concatenate([[0], ends]).astype(np.int64), data


def answers_of(batch: pa.RecordBatch, row: int, name: str) -> dict[int, bytes]:
    found = batch.column(batch.schema.get_field_index(name))[row].as_py() or []
    return {x["bucket"]: x["blob"] for x in found}


QUESTION = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def questions(chunk: int, bucket: np.ndarray, pack: Callable[[slice], bytes]) -> pa.RecordBatch:
    """One row for each bucket of a sorted array of buckets; pack gives the value of a slice."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    stops = np.append(starts[1:], len(bucket))
    blobs = [pack(slice(int(a), int(b))) for a, b in zip(starts, stops, strict=True)]
    columns = [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), chunk, np.int64)), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=QUESTION)


def answered(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(chunk, bucket, blob): what `answer` gives for the questions of a bucket, in a fixed order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        blobs = answer(table.column("blob").to_pylist())
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(blobs, pa.binary())], schema=QUESTION)

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, chunk long, blob binary")


def with_answers(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Chunks with their answers as an array; a chunk has as many as there are buckets at most."""
    own = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias(name))
    return chunks.join(own, "chunk", "left")
