"""Substring deduplication with suffix automata of reference shards.

A document's matching statistics against an automaton give, for each word, the longest run of words
ending there that the reference has (or has twice); runs of at least ``min_words`` are removed.

Against a given reference of bounded size (``remove_reference``) the automata are broadcast. Against
the corpus itself (``remove_repeated``) the reference is what may repeat, in shards of bounded size,
and each shard's automaton is made where the passages that need it arrive: broadcasting all shards
to all documents would take work and memory that grow with the square of the corpus.

1. Winnowing: the smallest SEED-gram of each window is its seed; equal windows have equal seeds. Seeds
   are counted over all documents.
2. Each run of windows with one repeated seed is a passage; it goes to the shard of its seed. Passages
   of a very frequent seed go as single windows to the shards of their contents.
3. A shard cuts from its passages what no other has next to the seed, builds the automaton of the
   different rest with numbers of occurrences, streams every passage through it and returns the spans.
4. Each batch of documents removes the union of its spans.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, small_batches, workspace
from quillon.llm.exchange import counts_for, deal, dump, each_row, lean, merged, pack, repeated, rows_of, runs, undump, with_answers
from quillon.llm.wordhash import Words, prefix_sums, range_hashes, words

SEED = 8
#: Seeds with more occurrences send single windows instead of passages.
HOT = 16_384
#: Words of distinct passages in one automaton, if a seed alone hasn't more.
SHARD_WORDS = 50_000
#: Words of reference texts that are broadcast at once, if a text alone hasn't more.
REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of whole numbers, with occurrence counts."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int = 1) -> None:
        """Add a sequence that occurs ``weight`` times."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            known = nexts[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                count[last] += weight
                continue
            if known is not None:
                last = self._split(last, c, known)
                count[last] += weight
                continue
            new = len(length)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            at = last
            while at >= 0 and c not in nexts[at]:
                nexts[at][c] = new
                at = link[at]
            if at >= 0:
                target = nexts[at][c]
                link[new] = target if length[target] == length[at] + 1 else self._split(at, c, target)
            last = new

    def _split(self, at: int, c: int, target: int) -> int:
        """A copy of ``target`` for the shorter sequences that reach it from ``at`` by ``c``."""
        copy = len(self.length)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        self.count.append(0)
        self.link[target] = copy
        while at >= 0 and self.next[at].get(c) == target:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def finish(self, least: int = 1) -> None:
        """Sum up occurrences; matches are then of sequences that occur ``least`` times."""
        counts = self.count
        order = np.argsort(np.array(self.length))[:0:-1].tolist()
        for s in order:
            if self.link[s] > 0:
                counts[self.link[s]] += counts[s]
        #: Length of the longest suffix of each state's sequences that occurs often enough.
        self.often = [0] * len(counts)
        for s in reversed(order):
            self.often[s] = self.length[s] if counts[s] >= least else self.often[self.link[s]]

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each position the length of the longest match that ends there."""
        nexts, link, length, often = self.next, self.link, self.length, self.often
        at, n, out = 0, 0, []
        for c in sequence:
            while at and c not in nexts[at]:
                at = link[at]
                n = length[at]
            to = nexts[at].get(c)
            if to is None:
                at = n = 0
            else:
                at, n = to, n + 1
            out.append(n if n < often[at] else often[at])
        return out


def spans(matches: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans [first, last) of positions inside matches of at least ``least``."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(matches):
        if n >= least:
            if out and i + 1 - n <= out[-1][1]:
                out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
            else:
                out.append((i + 1 - n, i + 1))
    return out


# --- windows and passages ------------------------------------------------------------------------


def window_seeds(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window of ``least`` words, position of its seed, and all SEED-gram hashes."""
    grams = w.grams(SEED)
    per = least - SEED + 1
    if len(grams) < per:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    first = np.flatnonzero(w.inside(least))
    view = np.lib.stride_tricks.sliding_window_view(grams, per)
    at = np.empty(len(first), np.int64)
    for i in range(0, len(first), 1 << 16):
        at[i : i + (1 << 16)] = view[first[i : i + (1 << 16)]].argmin(axis=1)
    return first, first + at, grams


def _seed_keys(batch: pa.RecordBatch, least: int) -> np.ndarray:
    _, at, grams = window_seeds(words(batch["text"]), least)
    return grams[np.unique(at)]


_PASSAGES = pa.schema(
    [("key", pa.uint64()), ("core", pa.int32()), ("core_words", pa.int32()), ("words", pa.list_(pa.uint64())), ("starts", pa.list_(pa.int64()))]
)
_SENT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("batch", pa.binary()), ("body", pa.binary())])
_SENT_SQL = "bucket int, grp int, batch binary, body binary"
_SPANS = pa.schema([("batch", pa.binary()), ("firsts", pa.binary()), ("lasts", pa.binary())])
_SPANS_SQL = "batch binary, firsts binary, lasts binary"
_GROUP_SPANS = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("firsts", pa.binary()), ("lasts", pa.binary())])
_GROUP_SPANS_SQL = "bucket int, grp int, firsts binary, lasts binary"


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def _gather(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(firsts, lengths)


def passages(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray], least: int, hot: int) -> pa.RecordBatch | None:
    """The batch's distinct passages around repeated seeds: key of the group they meet in, the part
    that all of the group share (first word and length), words, and first words of all occurrences."""
    w = words(batch["text"])
    first, at, grams = window_seeds(w, least)
    if not len(first) or not len(known[0]):
        return None
    counts = counts_for(grams[at], known)
    first, at, counts = first[counts > 1], at[counts > 1], counts[counts > 1]
    if not len(first):
        return None
    single = counts > hot
    begin = np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)]) | single
    run = np.flatnonzero(begin)
    start, seed = first[run], at[run]
    last = first[np.append(run[1:], len(first)) - 1] + least
    single = single[run]
    sums = prefix_sums(w.hashes)
    content = range_hashes(sums, start, last)
    order = np.argsort(content, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
    one = order[new]  # the first occurrence of each distinct passage
    lengths = (last - start)[one]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(single, content, grams[seed])[one]),
            pa.array(np.where(single, 0, seed - start)[one].astype(np.int32)),
            pa.array(np.where(single, least, SEED)[one].astype(np.int32)),
            _lists(w.hashes[_gather(start[one], lengths)], lengths),
            _lists(start[order], np.diff(np.append(new, len(order)))),
        ],
        schema=_PASSAGES,
    )


def trim(values: np.ndarray, offsets: np.ndarray, key: np.ndarray, core: np.ndarray, core_words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each passage the first and last word (positions in ``values``) up to which, on either side
    of the core, another occurrence of its group agrees. Passages alone in their group are empty."""
    sums = prefix_sums(values)
    lo, hi = offsets[:-1] + core, offsets[:-1] + core + core_words
    first, last = lo.copy(), hi.copy()

    def agree(alive: np.ndarray, group: np.ndarray) -> np.ndarray:
        _, inverse = np.unique(group, return_inverse=True)
        return alive[np.bincount(inverse, weight[alive])[inverse] >= 2]

    alive = agree(np.arange(len(key)), key)
    empty = np.setdiff1d(np.arange(len(key)), alive)
    salted = key * np.uint64(0x9E3779B97F4A7C15)
    right = alive
    while len(right := right[last[right] < offsets[1:][right]]):
        right = agree(right, salted[right] ^ range_hashes(sums, hi[right], last[right] + 1))
        last[right] += 1
    left = alive
    while len(left := left[first[left] > offsets[:-1][left]]):
        left = agree(left, salted[left] ^ range_hashes(sums, first[left] - 1, lo[left]))
        first[left] -= 1
    first[empty] = last[empty] = offsets[:-1][empty]
    return first, last


def condense(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The distinct passages of several batches as one batch, as if they stood one after another: each
    with one first word, twice if it occurs more often. Also the number of the distinct passage of each
    passage, and their first words. The result doesn't depend on the order of ``parts``."""
    join = lambda get: np.concatenate([get(p).to_numpy() for p in parts])
    key, core, core_words = join(lambda p: p["key"]), join(lambda p: p["core"]), join(lambda p: p["core_words"])
    lengths = join(lambda p: p["words"].value_lengths()).astype(np.int64)
    times = join(lambda p: p["starts"].value_lengths()).astype(np.int64)
    values = join(lambda p: p["words"].flatten())
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    content = range_hashes(prefix_sums(values), offsets[:-1], offsets[1:])
    order = np.lexsort((core, content, key))
    differs = [x[order][1:] != x[order][:-1] for x in (key, content, core)]
    new = np.concatenate([[True], np.logical_or.reduce(differs)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[np.flatnonzero(new)]
    start = np.concatenate([[0], np.cumsum(lengths[one])])[:-1]
    total = np.minimum(np.bincount(number, times), 2).astype(np.int64)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(key[one]),
            pa.array(core[one]),
            pa.array(core_words[one]),
            _lists(values[_gather(offsets[one], lengths[one])], lengths[one]),
            _lists(np.repeat(start, total), total),
        ],
        schema=_PASSAGES,
    )
    return batch, number, start


def spread(parts: list[pa.RecordBatch], firsts: np.ndarray, lasts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, firsts, lasts) in the words of each part, from spans in the words of ``condense(parts)``."""
    _, number, start = condense(parts)
    firsts, at = np.unique(firsts, return_index=True)
    lasts = lasts[at]
    owner = np.searchsorted(start, firsts, side="right") - 1
    spans_of: dict[int, list[int]] = {}
    for i, o in enumerate(owner.tolist()):
        spans_of.setdefault(o, []).append(i)
    n = 0
    for k, p in enumerate(parts):
        starts = p["starts"].to_pylist()
        a, b = [], []
        for i, every in enumerate(starts):
            for x in spans_of.get(int(number[n + i]), ()):
                shift = int(firsts[x] - start[owner[x]])
                a.extend(e + shift for e in every)
                b.extend(e + shift + int(lasts[x] - firsts[x]) for e in every)
        n += len(starts)
        if a:
            yield k, np.array(a, np.int64), np.array(b, np.int64)


def shard_spans(parts: list[tuple[bytes | int, pa.RecordBatch]], least: int) -> Iterator[tuple[bytes | int, np.ndarray, np.ndarray]]:
    """(batch, firsts, lasts) of the words to remove, from the passages of all batches in a bucket."""
    names = [name for name, _ in parts]
    source = np.repeat(np.arange(len(parts)), [p.num_rows for _, p in parts])
    join = lambda get: np.concatenate([get(p).to_numpy() for _, p in parts])
    key = join(lambda p: p["key"])
    core, core_words = join(lambda p: p["core"]).astype(np.int64), join(lambda p: p["core_words"]).astype(np.int64)
    lengths = join(lambda p: p["words"].value_lengths()).astype(np.int64)
    times = join(lambda p: p["starts"].value_lengths()).astype(np.int64)
    values, starts = join(lambda p: p["words"].flatten()), join(lambda p: p["starts"].flatten())
    parts.clear()
    offsets, at = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(times)])
    first, last = trim(values, offsets, key, core, core_words, times)
    use = np.flatnonzero(last - first >= least)
    if not len(use):
        return
    content = range_hashes(prefix_sums(values), first[use], last[use]) ^ key[use]
    order = np.lexsort((content, key[use]))
    new = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
    group = np.empty(len(use), np.int64)
    group[order] = np.cumsum(np.isin(np.arange(len(order)), new)) - 1
    one = use[order[new]]
    total = np.bincount(group, times[use])
    _, ids = np.unique(values, return_inverse=True)
    found: list[list[tuple[int, int]]] = []
    i = 0
    while i < len(one):  # shards of whole groups
        j, size = i, 0
        while j < len(one) and (size < SHARD_WORDS or key[one[j]] == key[one[j - 1]]):
            size += int(last[one[j]] - first[one[j]])
            j += 1
        automaton = SuffixAutomaton()
        texts = [ids[first[p] : last[p]].tolist() for p in one[i:j]]
        for t, n in zip(texts, total[i:j], strict=True):
            automaton.add(t, int(min(n, 2)))
        automaton.finish(2)
        found.extend(spans(automaton.statistics(t), least) for t in texts)
        i = j
    firsts, lasts, owner = [], [], []
    for p, g in zip(use, group, strict=True):
        for a, b in found[g]:
            begin = starts[at[p] : at[p + 1]] + (first[p] - offsets[p]) + a
            firsts.append(begin)
            lasts.append(begin + (b - a))
            owner.append(np.full(len(begin), source[p]))
    if not firsts:
        return
    firsts, lasts, owner = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(names) + 1))
    for s, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if i < j:
            yield names[s], firsts[order[i:j]], lasts[order[i:j]]


# --- results -------------------------------------------------------------------------------------


def _without(w: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words joined by blanks, text after text, and each text's offsets in them."""
    keep = np.flatnonzero(~removed)
    text = np.searchsorted(w.bounds, keep, side="right") - 1
    inner = keep[:-1][text[1:] == text[:-1]] if len(keep) else keep  # kept words with another behind them
    edge = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(edge, w.starts[keep], 1)
    np.add.at(edge, w.ends[keep], -1)
    mask = np.cumsum(edge[:-1]) > 0
    data = w.data.copy()
    mask[w.ends[inner]] = True
    data[w.ends[inner]] = 32
    upto = np.concatenate([[0], np.cumsum(mask)])
    return data[mask], upto[w.offsets]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_RESULT_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
_DIGEST = pa.schema([*list(_RESULT)[:3], pa.field("kept_sha256", pa.string())])
_DIGEST_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _results(batch: pa.RecordBatch, firsts: np.ndarray, lasts: np.ndarray, digest: bool) -> pa.RecordBatch:
    w = words(batch["text"])
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, lasts, -1)
    removed = np.cumsum(edge[:-1]) > 0
    data, at = _without(w, removed)
    gone = np.concatenate([[0], np.cumsum(removed)])[w.bounds]
    raw = memoryview(data.tobytes())
    kept = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
    last = pa.array([hashlib.sha256(k).hexdigest() if digest else k.tobytes().decode() for k in kept], pa.string())
    return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(w.bounds)), pa.array(np.diff(gone)), last], schema=_DIGEST if digest else _RESULT)


def remove_repeated(docs: DataFrame, min_words: int = 35, digest: bool = False, hot: int = HOT) -> DataFrame:
    """Removes every word that lies in a window of ``min_words`` words whose words also start anywhere
    else in ``docs``, the same document included; all windows are judged on the input.

    Per row: doc_id, n_words, n_removed and kept_text, the kept words joined by single blanks (with
    ``digest`` its kept_sha256). Null and empty texts have no words; texts shorter than a window lose
    nothing; repeated rows repeat each other. An empty table gives no rows.
    """
    if min_words < SEED:
        raise ValueError(f"windows of at least {SEED} words are needed")
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = workspace(spark, "substring")
    with small_batches(spark):
        packed = pack(narrow, f"{at}/packed")
    d = deal(packed)
    back = repeated(packed, lambda b: _seed_keys(b, min_words))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            if not r["answers"]:
                continue
            found = passages(undump(r["body"]), merged(r["answers"]), min_words, hot)
            if found is None:
                continue
            order, parts = d.split(d.bucket(found["key"].to_numpy()))
            out = [(b, d.group(r["batch"]), r["batch"], dump(found.take(pa.array(order[i:j])))) for b, i, j in parts]
            yield rows_of(_SENT, out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(each_row(batches), "bucket"):
            held = [(r["batch"], undump(r["body"])) for r in rows]
            rows.clear()
            yield rows_of(_SPANS, [(name, a.tobytes(), b.tobytes()) for name, a, b in shard_spans(held, min_words)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(each_row(batches), "bucket", "grp"):
            body, _, _ = condense([undump(r["body"]) for r in rows])
            yield rows_of(_SENT, [(rows[0]["bucket"], rows[0]["grp"], b"", dump(body))])

    def answer_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(each_row(batches), "bucket"):
            bucket, held = rows[0]["bucket"], [(r["grp"], undump(r["body"])) for r in rows]
            rows.clear()
            yield rows_of(_GROUP_SPANS, [(bucket, name, a.tobytes(), b.tobytes()) for name, a, b in shard_spans(held, min_words)])

    def route(entries: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        rows, out = entries.to_pylist(), []
        if answers.num_rows:
            firsts, lasts = (np.concatenate([np.frombuffer(x, np.int64) for x in answers[c].to_pylist()]) for c in ("firsts", "lasts"))
            found = spread([undump(r["body"]) for r in rows], firsts, lasts)
            out = [(rows[k]["batch"], a.tobytes(), b.tobytes()) for k, a, b in found]
        return pa.Table.from_batches([rows_of(_SPANS, out)])

    sent = with_answers(packed, back).mapInArrow(send, _SENT_SQL)
    if d.groups == 1:
        found = d.dealt(sent, "bucket").mapInArrow(answer, _SPANS_SQL)
    else:
        sent = materialize(sent, f"{at}/sent")
        merged_passages = d.dealt(sent, "bucket", "grp").mapInArrow(gather, _SENT_SQL)
        spans_of = d.dealt(merged_passages, "bucket").mapInArrow(answer_groups, _GROUP_SPANS_SQL)
        by = ("bucket", "grp")
        found = sent.groupBy(*by).cogroup(spans_of.groupBy(*by)).applyInArrow(route, _SPANS_SQL)
    out = _finish(packed, found, digest, f"{at}/out")
    discard(spark, f"{at}/packed")
    return out


def _finish(packed: DataFrame, found: DataFrame, digest: bool, path: str) -> DataFrame:
    """The results of all packed documents without the ``found`` spans, written to ``path``."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            get = lambda c, r=r: np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x[c], np.int64) for x in r["answers"] or [])])
            yield _results(undump(r["body"]), get("firsts"), get("lasts"), digest)

    with small_batches(packed.sparkSession):
        return materialize(with_answers(packed, found).mapInArrow(finish, _DIGEST_SQL if digest else _RESULT_SQL), path)


def _reference_groups(reference: DataFrame, at: str) -> tuple[DataFrame, list[int]]:
    """(grp, text) of the distinct texts, and the groups in use: dealt by hash until no group of several
    texts has more than REFERENCE_WORDS words."""
    n_words = F.size(F.split(F.trim("text"), r"[ \t-\r]+"))
    texts = reference.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    texts = materialize(texts.select("text", n_words.cast("bigint").alias("n"), F.xxhash64("text").alias("h")), f"{at}/reference")
    n = max(1, -(-(texts.agg(F.sum("n")).first()[0] or 0) // REFERENCE_WORDS))
    while True:
        grp = F.pmod("h", F.lit(n))
        sizes = texts.groupBy(grp.alias("grp")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        if not sizes.filter((F.col("n") > REFERENCE_WORDS) & (F.col("texts") > 1)).limit(1).count():
            return texts.select(grp.alias("grp"), "text"), sorted(r["grp"] for r in sizes.select("grp").collect())
        n *= 2


def remove_reference(docs: DataFrame, reference: DataFrame, min_words: int = 13) -> DataFrame:
    """Removes every word of ``docs`` that lies in a run of at least ``min_words`` words that a text of
    ``reference`` has. Columns and edge cases as of ``remove_repeated``; an empty reference removes nothing.

    The reference's automata, in shards of SHARD_WORDS words, are broadcast, as many as REFERENCE_WORDS
    words give; a larger reference takes a pass over the documents for each such group.
    """
    spark = docs.sparkSession
    at = workspace(spark, "reference")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        packed = pack(narrow, f"{at}/packed")
    texts, groups = _reference_groups(reference, at)
    found = [spark.createDataFrame([], _SPANS_SQL)]
    for g in groups:
        w = words(pa.array([r[0] for r in texts.filter(F.col("grp") == g).select("text").collect()], pa.string()))
        shards: list[list[list[int]]] = [[]]
        size = 0
        for i, j in zip(w.bounds, w.bounds[1:], strict=False):
            if j - i < min_words:
                continue
            if size > SHARD_WORDS:
                shards.append([])
                size = 0
            shards[-1].append(w.hashes[i:j].tolist())
            size += int(j - i)
        sent = spark.sparkContext.broadcast(shards)
        found.append(materialize(packed.mapInArrow(_reference_spans(sent, min_words), _SPANS_SQL), f"{at}/spans{g}"))
        sent.destroy()
    return _finish(packed, reduce(DataFrame.unionByName, found), False, f"{at}/out")


def _reference_spans(sent, least: int):
    """A mapInArrow function from packed batches to the spans that the broadcast shards match."""
    built: list[SuffixAutomaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            for shard in sent.value:
                built.append(SuffixAutomaton())
                for t in shard:
                    built[-1].add(t)
                built[-1].finish()
        for r in each_row(batches):
            w = words(undump(r["body"])["text"])
            firsts, lasts = [], []
            for i, j in zip(w.bounds, w.bounds[1:], strict=False):
                text = w.hashes[i:j].tolist()
                for automaton in built:
                    for a, b in spans(automaton.statistics(text), least):
                        firsts.append(i + a)
                        lasts.append(i + b)
            if firsts:
                yield rows_of(_SPANS, [(r["batch"], np.array(firsts, np.int64).tobytes(), np.array(lasts, np.int64).tobytes())])

    return run


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated(docs, 35, digest=True)


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM v) WHERE c > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM t),
y AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w) ANTI JOIN x USING (doc_id, j)),
z AS (SELECT doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY j) AS s FROM y GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN z USING (doc_id)
"""
