"""Packed batches of documents, and the question "which of my keys occur elsewhere too?" for them.

Documents are packed into batches of about BATCH_BYTES (compressed Arrow streams), written to the
shared folder. Each batch sends its distinct 64-bit keys, with the number of its documents that have
them, to buckets by a hash of the key: a key of a third of all documents is one entry a batch. A bucket adds
up the counts and answers each batch with the counts of those of its keys that occur at least twice.

The number of buckets follows from the packed bytes. Beyond GROUP_BATCHES batches, batches form groups:
a bucket first adds up each group's entries, then the groups' sums, and answers go back the same way,
so that neither a bucket nor a very common key gathers an entry of every batch in one place.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_parts, workspace
from quillon.llm.wordhash import mix

#: Uncompressed size of a packed batch; a larger document makes a batch of its own.
BATCH_BYTES = 512 << 10
#: Packed bytes (uncompressed) for each bucket, and the batches whose entries meet in one group.
BUCKET_BYTES = 32 << 20
GROUP_BATCHES = 4096
PACKED = "batch binary, size bigint, body binary"
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def undump(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as read:
        return read.read_next_batch()


def lean() -> None:
    """Let this worker give freed memory back to the system at once, where the C library can be told."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        tune = ctypes.CDLL(None).mallopt
        tune(-3, 256 << 10)  # M_MMAP_THRESHOLD: larger blocks are mapped, and unmapped when freed
        tune(-1, 1 << 20)  # M_TRIM_THRESHOLD
        tune(-8, 2)  # M_ARENA_MAX


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts, one at a time."""
    lean()
    for rows in batches:
        for i in range(rows.num_rows):
            yield {c: rows.column(c)[i].as_py() for c in rows.schema.names}
        del rows


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(batch, size, body): the table's (doc_id, ``text``) rows in packed batches, written to ``path``."""
    schema = pa.schema([("batch", pa.binary()), ("size", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            return rows_of(schema, [(uuid.uuid4().bytes, size, dump(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))])

        for batch in batches:
            lengths = pa.compute.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False)
            first = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > BATCH_BYTES:
                    # a slice drags its parent's buffers along unless it is copied
                    held.append(batch.slice(first, i - first).take(pa.array(np.arange(i - first))))
                    yield packed()
                    held, size, first = [], 0, i
                size += n
            held.append(batch.slice(first).take(pa.array(np.arange(batch.num_rows - first))))
        if sum(b.num_rows for b in held):
            yield packed()

    return materialize(docs.select("doc_id", text).mapInArrow(run, PACKED), path)


@dataclass(frozen=True)
class Deal:
    """How a packed table's entries are dealt: tasks, buckets of keys and groups of batches."""

    tasks: int
    buckets: int
    groups: int

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Keys are mixed again, as those of prefixes and seeds are the smallest hashes."""
        return ((mix(keys) >> np.uint64(40)) * np.uint64(self.buckets) >> np.uint64(24)).astype(np.int32)

    def group(self, batch: bytes) -> int:
        return int.from_bytes(batch[:8], "big") % self.groups

    def split(self, bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order by bucket, and (bucket, first, last) of the parts of that order."""
        order = np.argsort(bucket, kind="stable")
        put = bucket[order]
        if not len(put):
            return order, []
        first = np.flatnonzero(np.concatenate([[True], put[1:] != put[:-1]]))
        return order, list(zip(put[first].tolist(), first.tolist(), [*first[1:].tolist(), len(put)], strict=True))

    def dealt(self, sent: DataFrame, *by: str) -> DataFrame:
        return sent.repartition(self.tasks, *by).sortWithinPartitions(*by)


def deal(packed: DataFrame) -> Deal:
    n, size = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(shuffle_parts(packed.sparkSession), 8)
    return Deal(tasks, min(max(tasks, -(-size // BUCKET_BYTES)), 1 << 24), max(1, -(-n // GROUP_BATCHES)))


def runs(rows: Iterator[dict], *by: str) -> Iterator[list[dict]]:
    """Consecutive rows with equal ``by``."""
    held: list[dict] = []
    for r in rows:
        if held and any(r[c] != held[0][c] for c in by):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


_SENT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("batch", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_SQL = "bucket int, grp int, batch binary, keys binary, counts binary"
_SUMS = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUMS_SQL = "bucket int, grp int, keys binary, counts binary"
_BACK = pa.schema([("batch", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_BACK_SQL = "batch binary, keys binary, counts binary"


def _totals(rows: list[dict], kind: type = np.int64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys of each row, and the sums over all rows of their counts, which are of ``kind``."""
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    put = every[order]
    first = np.flatnonzero(np.concatenate([[True], put[1:] != put[:-1]]))
    sums = np.add.reduceat(np.concatenate([np.frombuffer(r["counts"], kind) for r in rows])[order].astype(np.int64), first)
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(put))))
    return keys, np.split(total, np.cumsum([len(k) for k in keys])[:-1])


def _repeated_of(rows: list[dict], kind: type = np.int64) -> Iterator[tuple[dict, bytes, bytes]]:
    """Each row with those of its keys that all rows together have at least twice, and their counts."""
    for r, keys, total in zip(rows, *_totals(rows, kind), strict=True):
        twice = total >= 2
        if twice.any():
            yield r, keys[twice].tobytes(), total[twice].tobytes()


def repeated(packed: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(batch, keys, counts) with the keys of each batch that at least two documents have.

    ``keys_of(documents)`` gives the keys of a batch, each document's distinct keys once, in any
    order. Several rows may come back for a batch; ``merged`` puts them together. ``counts`` are
    the numbers of documents with the key, over all batches.
    """
    d = deal(packed)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            keys, counts = np.unique(keys_of(undump(r["body"])), return_counts=True)
            order, parts = d.split(d.bucket(keys))
            keys, counts, group = keys[order], counts[order].astype(np.int32), d.group(r["batch"])
            yield rows_of(_SENT, [(b, group, r["batch"], keys[i:j].tobytes(), counts[i:j].tobytes()) for b, i, j in parts])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(each_row(batches), "bucket"):
            yield rows_of(_BACK, [(r["batch"], keys, counts) for r, keys, counts in _repeated_of(rows, np.int32)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(each_row(batches), "bucket", "grp"):
            keys, total = (np.concatenate(x) for x in _totals(rows, np.int32))
            keys, at = np.unique(keys, return_index=True)
            yield rows_of(_SUMS, [(rows[0]["bucket"], rows[0]["grp"], keys.tobytes(), total[at].tobytes())])

    def answer_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(each_row(batches), "bucket"):
            yield rows_of(_SUMS, [(r["bucket"], r["grp"], keys, counts) for r, keys, counts in _repeated_of(rows)])

    def route(entries: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        known, out = merged(answers.to_pylist()), []
        for r in entries.to_pylist():
            keys = np.frombuffer(r["keys"], np.uint64)
            counts = counts_for(keys, known)
            if (counts > 1).any():
                out.append((r["batch"], keys[counts > 1].tobytes(), counts[counts > 1].tobytes()))
        return pa.Table.from_batches([rows_of(_BACK, out)])

    sent = packed.select("batch", "body").mapInArrow(send, _SENT_SQL)
    if d.groups == 1:
        return d.dealt(sent, "bucket").mapInArrow(answer, _BACK_SQL)
    sent = materialize(sent, workspace(packed.sparkSession, "sent"))
    sums = d.dealt(sent.drop("batch"), "bucket", "grp").mapInArrow(add_up, _SUMS_SQL)
    found = d.dealt(sums, "bucket").mapInArrow(answer_groups, _SUMS_SQL)
    by = ("bucket", "grp")
    return sent.groupBy(*by).cogroup(found.groupBy(*by)).applyInArrow(route, _BACK_SQL)


def with_answers(packed: DataFrame, back: DataFrame) -> DataFrame:
    """(batch, body, answers): each batch with its rows of ``back`` as an array of structs."""
    fields = [c for c in back.columns if c != "batch"]
    gathered = back.groupBy("batch").agg(F.collect_list(F.struct(*fields)).alias("answers"))
    return packed.join(gathered, "batch", "left")


def merged(answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts from a batch's answers."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(a["keys"], np.uint64) for a in answers or [])])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(a["counts"], np.int64) for a in answers or [])])
    order = np.argsort(keys)
    return keys[order], counts[order]


def counts_for(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The count of each key by ``merged`` answers; 1 for keys without an answer."""
    if not len(known[0]):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    return np.where(known[0][at] == keys, known[1][at], 1)
