"""Alignment of two tokenizers' tokens over the same bytes, by an event sweep.

Every token ends at a byte of its text. The end events of both sides are one table, in runs of
tokens; they are dealt by document, sorted by offset and streamed through a machine that keeps only
what has not ended yet: tokens behind the last offset where both sides end, and the sums of the
document it is in. Between two neighbouring ends lies one token of either side, so each distinct end is
one link; ends of both sides close a group. Links of a batch of documents are then counted corpus-wide.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import materialize, shuffle_parts, small_batches, workspace
from quillon.llm.exchange import dump, lean, undump

#: Tokens of an event row.
RUN = 1 << 14
#: Links (distinct ones of each document) of a batch that is counted together.
BATCH_LINKS = 2_000_000


@dataclass(frozen=True)
class Coder:
    """A tokenizer file. ``kind``: "bytes" (byte-level merges) or "pieces" (puts the blank itself)."""

    kind: str
    file: str


#: The coders of the thin query; parameters everywhere else.
A = Coder("bytes", "/opt/tokenizers/byte_bpe_50k.json")
B = Coder("pieces", "/opt/tokenizers/piece_bpe_32k.model")


# --- coders --------------------------------------------------------------------------------------


def byte_of_char() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable, and
    the ones from U+0100 on for the others, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: The pattern that splits texts before byte-level merges (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Coding:
    """``encode(texts)``: ids of each text with a blank in front. ``tokens``: the bytes of every entry. ``lossless``: no text is
    normalised, so that the tokens' bytes are its own."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes], lossless: bool):
        self.encode, self.tokens, self.lossless = encode, tokens, lossless
        self.sizes = np.array([max(1, len(t)) for t in tokens], np.int64)

    def whole(self, raw: bytes, ids: list[int]) -> bool:
        """Are these the tokens of the text ``raw``, byte for byte?"""
        return self.lossless or b"".join(map(self.tokens.__getitem__, ids)) == b" " + raw


def byte_merges(file: str) -> Coding:
    """A byte-level vocabulary. The merges run by the order of ids, which is much faster than by the list of pairs, and the same
    where every entry is what its own bytes are merged to: a pair that makes an entry without being listed would have stopped
    those at itself. Other vocabularies, or ones that split or normalise texts in another way, are encoded by the file's own rules."""
    own = Tokenizer.from_file(file)
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()
    of, vocabulary, rules = byte_of_char(), own.get_vocab(with_added_tokens=False), json.loads(own.to_str())
    tokens = [b""] * (max(own.get_vocab(with_added_tokens=True).values()) + 1)
    for entry, i in vocabulary.items():
        tokens[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    special = {t["content"] for t in rules["added_tokens"]}
    ranks = {tokens[i]: i for entry, i in vocabulary.items() if entry not in special}
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = rules["normalizer"] is None and usual.items() <= (rules["pre_tokenizer"] or {}).items()
    rising = [i for _, i in sorted((n, vocabulary["".join(m)]) for n, m in enumerate(rules["model"]["merges"]))]
    if plain and rising == sorted(rising) and all([t.id for t in own.model.tokenize(e)] == [i] for e, i in vocabulary.items() if e not in special):
        quick = tiktoken.Encoding(file, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return Coding(lambda texts: [quick.encode_ordinary(" " + t) for t in texts], tokens, True)
    return Coding(lambda texts: [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], tokens, False)


def piece_merges(file: str) -> Coding:
    coder = sentencepiece.SentencePieceProcessor(model_file=file)
    names = [coder.id_to_piece(i) for i in range(coder.get_piece_size())]
    tokens = [bytes([int(n[3:5], 16)]) if coder.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Coding(lambda texts: coder.encode(texts, num_threads=1), tokens, False)


@lru_cache(maxsize=4)
def load(coder: Coder, file: str) -> Coding:
    made = {"bytes": byte_merges, "pieces": piece_merges}[coder.kind](file)
    if len(made.tokens) > 1 << 16:
        raise ValueError("vocabularies of at most 65536 entries can be aligned")
    return made


def shipped(spark: SparkSession, coder: Coder) -> str:
    """The file's name on the executors."""
    spark.sparkContext.addFile(coder.file)
    return coder.file.rsplit("/", 1)[-1]


# --- events --------------------------------------------------------------------------------------

_EVENTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("at", pa.int64()), ("side", pa.int8()), ("whole", pa.bool_()), ("size", pa.int64()), ("ids", pa.binary())])
_EVENTS_SQL = "doc_id bigint, text_key binary, at bigint, side tinyint, whole boolean, size bigint, ids binary"


def end_events(docs: DataFrame, coder: Coder, side: int) -> DataFrame:
    """Runs of the tokens (uint16) of every row's whole text with a blank in front; ``at`` is the byte where a run
    begins. Every row has a run at 0. ``whole``: the tokens' bytes are the text's; if not, and if the text is null or
    empty, the run has no tokens."""
    name = shipped(docs.sparkSession, coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        made, none = load(coder, SparkFiles.get(name)), np.zeros(0, np.uint16)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            rows = []
            for doc_id, text, found in zip(batch["doc_id"].to_pylist(), texts, made.encode(texts), strict=True):
                raw = text.encode()
                whole = bool(raw) and made.whole(raw, found)
                ids = np.array(found, np.uint16) if whole else none
                key, size, at = xxhash.xxh3_128_digest(raw), len(raw) + 1 if whole else 0, 0
                for i in range(0, max(1, len(ids)), RUN):
                    run = ids[i : i + RUN]
                    rows.append((doc_id, key, at, side, whole, size, run.astype("<u2").tobytes()))
                    at += int(made.sizes[run].sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _EVENTS, strict=True)], schema=_EVENTS) if rows else pa.RecordBatch.from_pylist([], _EVENTS)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, _EVENTS_SQL)


# --- the machine ---------------------------------------------------------------------------------


@dataclass
class Document:
    """The sums of a document."""

    doc_id: int | None
    key: bytes
    base: int
    copies: int = 0
    size: int = 0
    whole: bool | None = None
    first: np.ndarray | None = None
    last: tuple[int, int] = (-1, -1)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    links: list[np.ndarray] = field(default_factory=list)


@dataclass
class Settled:
    """A stretch of the stream in which both sides are complete, with its links and groups.

    ``ends``: distinct offsets; ``a``, ``b``: positions in ``ids_a`` and ``ids_b`` of the tokens that
    lie before each; ``closes``: do both end there?"""

    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    closes: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each side that end with or before each group."""
        return self.a[self.closes] + 1, self.b[self.closes] + 1


_DIGITS = np.zeros((1 << 16, 5), np.uint8)
for _i, _text in enumerate(map(str, range(1 << 16))):
    _DIGITS[_i, : len(_text)] = np.frombuffer(_text.encode(), np.uint8)
_LENGTH = (_DIGITS > 0).sum(axis=1)


def written(s: Settled) -> tuple[np.ndarray, np.ndarray]:
    """``;a1,a2|b1`` of all groups, and the byte where each group begins (and the end)."""
    upto_a, upto_b = s.groups()
    n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    n = len(s.ids_a) + len(s.ids_b)
    ids, mark = np.empty(n, np.uint16), np.full(n, ord(","), np.uint8)
    before_a, before_b = upto_a - n_a, upto_b - n_b
    ids[np.arange(len(s.ids_a)) + np.repeat(before_b, n_a)] = s.ids_a
    ids[np.arange(len(s.ids_b)) + np.repeat(upto_a, n_b)] = s.ids_b
    first = before_a + before_b
    mark[first], mark[first + n_a] = ord(";"), ord("|")
    cells = np.column_stack([mark, _DIGITS[ids]])
    at = np.concatenate([[0], np.cumsum(1 + _LENGTH[ids])])
    return cells[cells > 0], at[np.append(first, n)]


class Machine:
    """Takes event rows in order and gives documents as they end."""

    def __init__(self, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.sizes = (sizes_a, sizes_b)
        self.open: list[Document] = []
        none = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.left = [none, none]
        self.new: tuple[list, list] = ([], [])

    def take(self, rows: Iterator[tuple]) -> None:
        for doc_id, key, at, side, whole, size, ids in rows:
            d = self.open[-1] if self.open else None
            if d is None or (d.doc_id, d.key) != (doc_id, key):
                d = Document(doc_id, key, d.base + d.size if d else 0)
                self.open.append(d)
            if (at, side) == (0, 0):
                d.copies += 1
            if (at, side) == d.last:  # a row with the same doc_id and text
                continue
            d.last, tokens = (at, side), np.frombuffer(ids, "<u2")
            if (at, side) == (0, 0):
                d.first = tokens if whole else None
            elif at == 0:
                d.whole = whole and d.first is not None
                if d.whole:
                    d.size = size
                    self._add(0, d, 0, d.first)
                    self._add(1, d, 0, tokens)
                d.first = None
            elif d.whole:
                self._add(side, d, at, tokens)

    def _add(self, side: int, d: Document, at: int, ids: np.ndarray) -> None:
        self.new[side].append((np.cumsum(self.sizes[side][ids]) + (d.base + at), ids))

    def settle(self) -> tuple[Settled, list[tuple[Document, slice]]]:
        """What is complete so far, and the stretch of its ends that belongs to each document."""
        ends, ids = [], []
        for side in (0, 1):
            held = [self.left[side], *self.new[side]]
            self.new[side].clear()
            ends.append(np.concatenate([x[0] for x in held]))
            ids.append(np.concatenate([x[1] for x in held]))
        every = np.concatenate([2 * ends[0], 2 * ends[1] + 1])
        every.sort(kind="stable")
        at, side = every >> 1, every & 1
        new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
        place = np.cumsum(new) - 1
        has = np.zeros((2, int(new.sum())), bool)
        has[side, place] = True
        both = np.flatnonzero(has[0] & has[1])
        n = int(both[-1]) + 1 if len(both) else 0
        has, at = has[:, :n], at[new][:n]
        a, b = (np.cumsum(h) - h for h in has)
        done = [int(h.sum()) for h in has]
        s = Settled(at, a, b, has[0] & has[1], ids[0][: done[0]], ids[1][: done[1]])
        self.left = [(ends[k][done[k] :], ids[k][done[k] :]) for k in (0, 1)]
        upto = np.searchsorted(at, [d.base + d.size for d in self.open], side="right").tolist()
        return s, [(d, slice(i, j)) for d, i, j in zip(self.open, [0, *upto], upto, strict=False)]

    def ended(self, last: bool) -> list[Document]:
        """The documents that nothing follows for, and no others from now on."""
        out, self.open = (self.open, []) if last else (self.open[:-1], self.open[-1:])
        for d in self.open:  # offsets begin anew
            self.left = [(ends - d.base, ids) for ends, ids in self.left]
            d.base = 0
        return out

    def add_up(self, s: Settled, parts: list[tuple[Document, slice]]) -> None:
        text, at = written(s)
        group = np.cumsum(s.closes)
        pairs = s.ids_a[s.a].astype(np.uint32) << np.uint32(16) | s.ids_b[s.b]
        raw = text.tobytes()
        for d, x in parts:
            if x.start == x.stop:
                continue
            g0 = int(group[x.start - 1]) if x.start else 0
            g1 = int(group[x.stop - 1])
            d.digest.update(raw[at[g0] + (not d.n_groups) : at[g1]])  # without the first ";"
            d.n_groups += g1 - g0
            d.n_links += x.stop - x.start
            d.n_a += int(s.a[x.stop - 1] - s.a[x.start]) + 1
            d.n_b += int(s.b[x.stop - 1] - s.b[x.start]) + 1
            d.links.append(pairs[x])


# --- documents and counts ------------------------------------------------------------------------

_DOC = pa.schema([("doc_id", pa.int64()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])
_SWEPT_SQL = "batch binary, n_links bigint, docs binary, links binary, keys array<bigint>, holders array<bigint>"
_SWEPT = pa.schema([("batch", pa.binary()), ("n_links", pa.int64()), ("docs", pa.binary()), ("links", pa.binary()), ("keys", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
_LINKS = pa.schema([("place", pa.uint32()), ("times", pa.uint32())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in _EVENTS.names), strict=True)


def dealt(events: DataFrame) -> DataFrame:
    """Events by document, each one's in the order of offsets."""
    by = ("doc_id", "text_key")
    return events.repartition(shuffle_parts(events.sparkSession), *by).sortWithinPartitions(*by, "at", "side")


def _swept(docs: pa.RecordBatch, links: pa.RecordBatch, keys: np.ndarray, holders: np.ndarray) -> pa.RecordBatch:
    row = [[uuid.uuid4().bytes], [links.num_rows + docs.num_rows], [dump(docs)], [dump(links)], [keys], [holders]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _SWEPT, strict=True)], schema=_SWEPT)


def sweep(events: DataFrame, a: Coder, b: Coder) -> DataFrame:
    """(batch, n_links, docs, links, keys, holders): packed documents with their sums; of each document its distinct links, as
    places in ``keys`` with the number of times; and for each key (A id * 65536 + B id) the documents that hold it."""
    names = shipped(events.sparkSession, a), shipped(events.sparkSession, b)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        each = [k for _, k, _ in held]
        keys, place = np.unique(np.concatenate(each), return_inverse=True)
        holders = np.bincount(place, np.repeat([d.copies for d, _, _ in held], [len(k) for k in each]), len(keys)).astype(np.int64)
        docs = [(d.doc_id, d.copies, d.n_a, d.n_b, d.n_groups, d.n_links, d.digest.hexdigest() if d.n_groups else "", len(k)) for d, k, _ in held]
        body = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*docs, strict=True), _DOC, strict=True)], schema=_DOC)
        links = pa.RecordBatch.from_arrays([pa.array(place.astype(np.uint32)), pa.array(np.concatenate([t for _, _, t in held]).astype(np.uint32))], schema=_LINKS)
        return _swept(body, links, keys.astype(np.int64), holders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        machine = Machine(load(a, SparkFiles.get(names[0])).sizes, load(b, SparkFiles.get(names[1])).sizes)
        held: list[tuple] = []
        n = 0

        def ended(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            for d in machine.ended(last):
                links, times = np.unique(np.concatenate([np.zeros(0, np.uint32), *d.links]), return_counts=True)
                d.links.clear()
                held.append((d, links, times))
                n += len(links) + 1
                if n >= BATCH_LINKS:
                    yield packed(held)
                    held, n = [], 0

        for batch in batches:
            machine.take(_rows(batch))
            machine.add_up(*machine.settle())
            yield from ended(False)
        yield from ended(True)
        if held:
            yield packed(held)

    return dealt(events).mapInArrow(run, _SWEPT_SQL)


def filled(swept: DataFrame, path: str) -> DataFrame:
    """The batches with about BATCH_LINKS links each, written to ``path``, where the tasks that made them had far fewer. A batch asks once
    for each of its keys, so that the questions follow from the links and not from the number of tasks."""
    found = swept.agg(F.sum("n_links").alias("links"), F.count(F.lit(1)).alias("batches")).first()
    full = -(-(found["links"] or 0) // BATCH_LINKS)
    if found["batches"] <= 2 * full:
        return swept

    def joined(held: list[tuple]) -> pa.RecordBatch:
        docs, links, each, holders = zip(*held, strict=True)
        keys, place = np.unique(np.concatenate(each), return_inverse=True)
        first = np.cumsum([0, *map(len, each)])
        places = np.concatenate([place[i + x["place"].to_numpy()] for i, x in zip(first[:-1], links, strict=True)])
        times = np.concatenate([x["times"].to_numpy() for x in links])
        body = pa.Table.from_batches(docs).combine_chunks().to_batches()[0]
        both = pa.RecordBatch.from_arrays([pa.array(places.astype(np.uint32)), pa.array(times)], schema=_LINKS)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, np.concatenate(holders))
        return _swept(body, both, keys, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append((undump(batch["docs"][i].as_py()), undump(batch["links"][i].as_py()), *(batch[c][i].values.to_numpy() for c in ("keys", "holders"))))
                n += batch["n_links"][i].as_py()
                if n >= BATCH_LINKS:
                    yield joined(held)
                    held, n = [], 0
        if held:
            yield joined(held)

    return materialize(swept.coalesce(full).mapInArrow(run, _SWEPT_SQL), path)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(key, count, best): in how many documents of all a pair is linked, and whether no pair of its A id is in more."""
    each = swept.select(F.explode(F.arrays_zip("keys", "holders")).alias("x"))
    counts = each.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.holders").alias("count"))
    # at most one row for each entry of B's vocabulary
    of_a = Window.partitionBy(F.shiftright("key", 16))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def align(docs: DataFrame, a: Coder = A, b: Coder = B) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that one of the coders doesn't give back byte for byte, have no tokens: zeros and an
    empty digest. Whole texts count. Rows that repeat a doc_id and text are swept once, give a row each and count as
    documents each; so do rows without a doc_id. An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    at = workspace(spark, "alignment")
    with small_batches(spark, "1m", 1000):
        events = end_events(docs, a, 0).unionByName(end_events(docs, b, 1))
        swept = filled(materialize(sweep(events, a, b), f"{at}/swept"), f"{at}/filled")
        counts = materialize(pair_counts(swept), f"{at}/counts")
    of_batch = swept.select("batch", F.explode("keys").alias("key")).join(counts, "key")
    none = {c: F.lit(None).cast("binary") for c in ("docs", "links")}
    answers = of_batch.select("batch", "key", "count", "best").withColumns(none)
    bodies = swept.select("batch", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("boolean").alias("best"), "docs", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ends = np.flatnonzero(batch["docs"].is_valid().to_numpy(zero_copy_only=False))
            first = 0
            for i in [*ends.tolist(), batch.num_rows]:
                if i > first:
                    part = batch.slice(first, i - first)
                    held.append((part["count"].to_numpy(), part["best"].to_numpy(zero_copy_only=False)))
                if i < batch.num_rows:
                    counts, best = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
                    held = []
                    yield _scored(undump(batch["docs"][i].as_py()), undump(batch["links"][i].as_py()), counts, best.astype(bool))
                first = i + 1

    # a batch's counts in the order of its keys, then its documents
    rows = answers.unionByName(bodies).repartition(shuffle_parts(spark), "batch").sortWithinPartitions("batch", F.col("key").asc_nulls_last())
    return rows.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def _scored(docs: pa.RecordBatch, links: pa.RecordBatch, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    place, times = links["place"].to_numpy(), links["times"].to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(docs["n_pairs"].to_numpy())])
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
    out = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    out |= {"n_best": pa.array(sums(times * best[place])), "count_sum": pa.array(sums(times * counts[place])), "groups_sha256": docs["groups_sha256"]}
    table = pa.RecordBatch.from_pydict(out)
    copies = docs["copies"].to_numpy()
    return table if (copies == 1).all() else table.take(pa.array(np.repeat(np.arange(len(copies)), copies)))


def groups(docs: DataFrame, a: Coder = A, b: Coder = B) -> DataFrame:
    """The groups themselves: doc_id, first and last (bytes of the blank and the text, ``last`` excluded), a_ids, b_ids,
    and links, pairs of positions in them. Documents without tokens have no rows; repeated rows are given once."""
    spark = docs.sparkSession
    names = shipped(spark, a), shipped(spark, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(load(a, SparkFiles.get(names[0])).sizes, load(b, SparkFiles.get(names[1])).sizes)
        for batch in batches:
            machine.take(_rows(batch))
            s, parts = machine.settle()
            upto_a, upto_b = s.groups()
            number = np.cumsum(s.closes) - s.closes
            out = []
            for d, x in parts:
                for g in range(int(number[x.start]), int(number[x.stop - 1]) + 1) if x.stop > x.start else ():
                    a0, b0 = (int(u[g - 1]) if g else 0 for u in (upto_a, upto_b))
                    ids_a, ids_b = s.ids_a[a0 : upto_a[g]], s.ids_b[b0 : upto_b[g]]
                    i, j = np.searchsorted(number, [g, g + 1])
                    size = int(machine.sizes[0][ids_a].sum())
                    last = int(s.ends[j - 1]) - d.base
                    links = [{"a": int(p) - a0, "b": int(q) - b0} for p, q in zip(s.a[i:j], s.b[i:j], strict=True)]
                    out.append({"doc_id": d.doc_id, "first": last - size, "last": last, "a_ids": ids_a.tolist(), "b_ids": ids_b.tolist(), "links": links})
            machine.ended(False)
            yield pa.RecordBatch.from_pylist(out, _GROUPS)

    with small_batches(spark, "1m", 1000):
        events = end_events(docs, a, 0).unionByName(end_events(docs, b, 1))
        return dealt(events).mapInArrow(run, "doc_id bigint, first bigint, last bigint, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>")


_GROUPS = pa.schema([
    ("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
    ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
