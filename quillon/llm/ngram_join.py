"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link if the Jaccard similarity of their sets of word shingles reaches a threshold. In any
common order of all shingles, two linked texts share at least m of the first (size - need + m), where
need is the smallest overlap that a partner must have: longer prefixes ask for more matches.

1. Screen: in hash order, with m = 1 + size/16, a document needs that many shared prefix shingles.
2. Texts with the same set become one. For the others all shingles are counted; a text needs
   ``need`` shingles that another one has.
3. Prefixes in the order of (count, hash), rarest first. Each text lengthens its prefix while that
   lowers its estimated cost, the postings it meets plus the verifications left if m must match.
4. Postings are dealt by shingle, long lists in blocks. Candidates must be of fitting size and pass a
   bound on their difference by parity sketches; then share enough prefix shingles; then the exact
   similarity decides. First each text meets the heads of its lists only, and what links is merged,
   a few times. Then lists whose texts all belong to one component are left out, and in the others texts
   meet those of other components, whole blocks of one component never each other. So a group of
   copies that its heads have merged is not expanded into pairs, and no link between different
   components is missed. Texts that share a rare enough shingle and don't link do meet, pair by pair.

Shingles are 64-bit hashes; sizes, bounds and similarities are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import discard, free_name, materialize, quoted, shuffle_parts, small_batches, workspace
from quillon.llm.components import connected_components
from quillon.llm.exchange import counts_for, each_row, merged, pack, repeated, rows_of, undump, with_answers
from quillon.llm.wordhash import prefix_sums, range_hashes, words

SKETCH_BITS = 1024
#: Postings of a list that meet in one task.
BLOCK = 512
LADDER = (1, 2, 4, 8, 16)
#: First tries with heads of lists, before all texts of different components meet: so many, and as many
#: more (to MAX_HEAD_TURNS) as each takes a tenth off the pairs to meet, while these exceed PAIRS_A_POSTING.
HEAD_TURNS, MAX_HEAD_TURNS = 2, 12
PAIRS_A_POSTING = 16
#: Pairs that a task looks at in one go.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Join:
    shingle: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 80

    def need(self, size):
        """Shingles that a partner of a set of this size must share at least."""
        return -(-size * self.percent // 100)


# --- sets ----------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence if it has fewer than k words."""
    w = words(texts, lower=True)
    sums = prefix_sums(w.hashes)
    counts = np.diff(w.bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.cumsum(n)
    first = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(w.bounds[:-1], n)
    hashes = range_hashes(sums, first, first + np.repeat(np.minimum(counts, k), n))
    return [np.unique(hashes[e - m : e]) for e, m in zip(ends, n, strict=True)]


def _screen_matches(size, join: Join):
    """m of the screen for a text of this size, and the least m of any partner."""
    return 1 + size // 16, 1 + join.need(size) // 16


def _screen_prefix(s: np.ndarray, join: Join) -> np.ndarray:
    m, _ = _screen_matches(len(s), join)
    return s[: len(s) - join.need(len(s)) + min(m, join.need(len(s)))] if len(s) else s


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.binary())])
_SETS_SQL = "doc_id bigint, n_shingles bigint, set_key binary, shingles binary"


def shingle_table(docs: DataFrame, join: Join, path: str) -> DataFrame:
    """doc_id, n_shingles for every row; set_key and shingles for those that pass the screen."""
    k = join.shingle
    packed = pack(docs, f"{path}/packed")
    back = repeated(packed, lambda b: np.concatenate([np.zeros(0, np.uint64), *(_screen_prefix(s, join) for s in shingle_sets(b["text"], k))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            batch, known = undump(r["body"]), merged(r["answers"])[0]
            out = []
            for doc_id, s in zip(batch["doc_id"].to_pylist(), shingle_sets(batch["text"], k), strict=True):
                _, least = _screen_matches(len(s), join)
                prefix = _screen_prefix(s, join)
                passed = len(s) and len(known) and (known[np.minimum(np.searchsorted(known, prefix), len(known) - 1)] == prefix).sum() >= least
                key = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s), len(s)], np.uint64).tobytes() if passed else None
                out.append((doc_id, len(s), key, s.tobytes() if passed else None))
            yield rows_of(_SETS, out)

    sets = materialize(with_answers(packed, back).mapInArrow(run, _SETS_SQL), f"{path}/sets")
    discard(docs.sparkSession, f"{path}/packed")
    return sets


# --- prefixes ------------------------------------------------------------------------------------


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by hash class. Two sets' sketches differ in at most as many
    bits as the sets differ in shingles."""
    return np.packbits((np.bincount((s >> np.uint64(7)) & np.uint64(SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1).astype(np.uint8))


def adaptive_prefix(s: np.ndarray, counts: np.ndarray, join: Join) -> tuple[int, np.ndarray]:
    """m and the positions in ``s`` of the prefix for m, in the common order (count, hash).

    Estimated cost for m: the postings that the prefix meets, each once to count and, of those, at
    most one in m to verify at size/8 a time.
    """
    size, need = len(s), join.need(len(s))
    order = np.lexsort((s, counts))
    met = np.cumsum(counts[order] - 1)
    best, cost = 1, None
    for m in LADDER:
        if m > need:
            break
        c = met[size - need + m - 1] * (1 + size / 8 / m)
        if cost is None or c < cost:
            best, cost = m, c
    return best, order[: size - need + best]


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("size", pa.int32()), ("m", pa.int32()), ("sketch", pa.binary()), ("shingles", pa.binary()), ("prefix", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
_KEPT_SQL = "doc_id bigint, size int, m int, sketch binary, shingles binary, prefix array<bigint>, counts array<bigint>"


def prefix_table(sets: DataFrame, join: Join, path: str) -> DataFrame:
    """Texts (doc_id, shingles) that can have partners, with m, sketch and the shared prefix shingles."""
    packed = pack(sets, f"{path}/packed_sets", "shingles")
    split = lambda b: [np.frombuffer(x, np.uint64) for x in b["shingles"].to_pylist()]
    back = repeated(packed, lambda b: np.concatenate([np.zeros(0, np.uint64), *split(b)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            batch, known = undump(r["body"]), merged(r["answers"])
            out = []
            for doc_id, s in zip(batch["doc_id"].to_pylist(), split(batch), strict=True):
                counts = counts_for(s, known)
                if (counts > 1).sum() < join.need(len(s)):
                    continue
                m, at = adaptive_prefix(s, counts, join)
                at = at[counts[at] > 1]
                out.append((doc_id, len(s), m, sketch(s).tobytes(), s.tobytes(), s[at].view(np.int64), counts[at]))
            if out:
                yield rows_of(_KEPT, out)

    kept = materialize(with_answers(packed, back).mapInArrow(run, _KEPT_SQL), f"{path}/prefixes")
    discard(sets.sparkSession, f"{path}/packed_sets")
    return kept


# --- candidates ----------------------------------------------------------------------------------

_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32())])
_PAIR_SQL = "a bigint, b bigint, m int"


def fits(size_a: np.ndarray, size_b: np.ndarray, sketch_a: np.ndarray, sketch_b: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of these sizes and sketches (uint64 rows) be linked? With d differing shingles of
    t = |a| + |b|, the similarity is (t - d) / (t + d)."""
    total = size_a.astype(np.int64) + size_b
    least = np.abs(size_a.astype(np.int64) - size_b)
    least = np.maximum(least, np.bitwise_count(sketch_a ^ sketch_b).sum(axis=1))
    return 100 * (total - least) >= percent * (total + least)


def meetings(group: np.ndarray, side: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), in chunks, of the rows that meet: in each group rows of side 0 meet those of side
    1, and rows of side 2 those of side 2 of another ``comp``. Rows are sorted by group, side, comp."""
    n = len(group)
    if not n:
        return
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_part = new_group | np.concatenate([[True], (side[1:] != side[:-1]) | ((side[1:] == 2) & (comp[1:] != comp[:-1]))])
    end_of = lambda new: np.append(np.flatnonzero(new), n)[np.cumsum(new)]
    first, last = end_of(new_part), end_of(new_group)
    partners = np.where(side == 1, 0, last - first)
    upto = np.concatenate([[0], np.cumsum(partners)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + CHUNK, side="right")) - 1)
        many = partners[i:j]
        if many.sum():
            a = np.repeat(np.arange(i, j), many)
            yield a, np.arange(len(a)) - np.repeat(upto[i:j] - upto[i], many) + np.repeat(first[i:j], many)
        i = j


def _pairs(join: Join, heads_only: bool):
    """A mapInArrow function over postings (list, part, side, doc_id, size, m, comp, sketch), sorted by
    list and part: pairs of one block, or of two (sides 0 and 1), that may be linked."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        list_, part, side, doc, size, m, comp = (t[c].to_numpy() for c in ("list", "part", "side", "doc_id", "size", "m", "comp"))
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(doc), -1)
        new = np.concatenate([[True], (list_[1:] != list_[:-1]) | (part[1:] != part[:-1])])
        group = np.cumsum(new) - 1

        def found(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
            ok = (doc[i] != doc[j]) & (comp[i] != comp[j])
            i, j = i[ok], j[ok]
            total = size[i].astype(np.int64) + size[j]
            ok = 100 * (total - np.abs(size[i].astype(np.int64) - size[j])) >= join.percent * (total + np.abs(size[i].astype(np.int64) - size[j]))
            i, j = i[ok], j[ok]
            ok = fits(size[i], size[j], bits[i], bits[j], join.percent)
            i, j = i[ok], j[ok]
            if not len(i):
                return None
            a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.minimum(m[i], m[j]))], schema=_PAIR)

        meet = [(np.flatnonzero(new)[group], np.arange(len(doc)))] if heads_only else meetings(group, side, comp)
        for i, j in meet:
            if (got := found(i, j)) is not None:
                yield got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the rows up to the last change of list and part are complete
            same = (batch["list"].to_numpy() == batch["list"][-1].as_py()) & (batch["part"].to_numpy() == batch["part"][-1].as_py())
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if held and (cut or held[-1]["list"][-1].as_py() != batch["list"][0].as_py() or held[-1]["part"][-1].as_py() != batch["part"][0].as_py()):
                yield from emit([*held, batch.slice(0, cut)] if cut else held)
                held = []
            elif cut:
                yield from emit([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from emit(held)

    return run


_POSTING = ["list", "count", "doc_id", "size", "m", "comp", "sketch"]


def postings(kept: DataFrame, comps: DataFrame | None) -> DataFrame:
    """One row for each text and shared shingle of its prefix (``list``), with the text's component."""
    if comps is None:
        kept = kept.withColumn("comp", F.col("doc_id"))
    else:
        kept = kept.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    each = kept.select(F.explode(F.arrays_zip("prefix", "counts")).alias("p"), "doc_id", "size", "m", "comp", "sketch")
    return each.select(F.col("p.prefix").alias("list"), F.col("p.counts").alias("count"), *_POSTING[2:])


def head_candidates(each: DataFrame, join: Join, seed: int) -> DataFrame:
    """(a, b) with a < b: each text with the head of its block of each list, one drawn anew for every list
    and ``seed``. A first try that takes as many comparisons as there are postings, so one match is enough."""
    # blocks differ from list to list, so that their groups meet
    block = F.pmod(F.xxhash64("doc_id", "list", F.lit(seed)), F.ceil(F.col("count") / BLOCK))
    placed = each.select("list", block.cast("bigint").alias("part"), F.lit(2).alias("side"), *_POSTING[2:])
    dealt = placed.repartition(shuffle_parts(each.sparkSession), "list", "part")
    dealt = dealt.sortWithinPartitions("list", "part", F.xxhash64("list", "doc_id", F.lit(seed)), "doc_id")
    return dealt.mapInArrow(_pairs(join, True), _PAIR_SQL).select("a", "b").distinct()


def open_lists(each: DataFrame) -> DataFrame:
    """(list, comp, n) of the lists that have texts of several components."""
    counts = each.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    return counts.join(several.select("list"), "list")


def block_plan(lists: DataFrame) -> DataFrame:
    """``lists`` (list, comp, n) with ``blocks``, the number of blocks of the list, and the component's own
    blocks, ``first`` to ``first + own - 1``. A component of at least BLOCK texts has blocks to itself
    (``alone``); the others share the list's first blocks."""
    big = F.col("n") >= BLOCK
    in_list = Window.partitionBy("list")
    own = F.ceil(F.col("n") / BLOCK)
    # only large components, of BLOCK texts at least, are put in an order
    some = lists.filter(big)
    before = F.sum(own).over(in_list.orderBy("comp").rowsBetween(Window.unboundedPreceding, -1))
    placed = some.select("list", "comp", F.coalesce(before, F.lit(0)).alias("before"))
    sums = lists.groupBy("list").agg(
        F.ceil(F.sum(F.when(big, 0).otherwise(F.col("n"))) / BLOCK).alias("small"), F.sum(F.when(big, own).otherwise(0)).alias("large")
    )
    joined = lists.join(sums, "list").join(placed, ["list", "comp"], "left")
    return joined.select(
        "list",
        "comp",
        (F.col("small") + F.col("large")).alias("blocks"),
        big.alias("alone"),
        F.when(big, F.col("small") + F.col("before")).otherwise(0).alias("first"),
        F.when(big, own).otherwise(F.col("small")).alias("own"),
    )


def candidates(each: DataFrame, lists: DataFrame, join: Join) -> DataFrame:
    """(a, b) with a < b, of different components, that share enough prefix shingles. ``lists``: the lists
    with several components, see ``open_lists``."""
    rows = each.join(block_plan(lists), ["list", "comp"])
    # a small component lies whole in one block, a large one is dealt to its own
    at = F.when(F.col("alone"), F.xxhash64("doc_id")).otherwise(F.xxhash64("comp"))
    rows = rows.withColumn("block", F.col("first") + F.pmod(at, F.col("own")))
    ahead = F.when(F.col("first") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("first") - 1)).otherwise(F.array().cast("array<bigint>"))
    last = F.col("first") + F.col("own")
    behind = F.when(last < F.col("blocks"), F.sequence(last, F.col("blocks") - 1)).otherwise(F.array().cast("array<bigint>"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    others = F.when(F.col("alone"), F.concat(ahead, behind)).otherwise(every)
    rows = rows.withColumn("other", F.explode(others))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    placed = rows.select("list", part.alias("part"), side.alias("side"), *_POSTING[2:])
    dealt = placed.repartition(shuffle_parts(each.sparkSession), "list", "part").sortWithinPartitions("list", "part", "side", "comp", "doc_id")
    pairs = dealt.mapInArrow(_pairs(join, False), _PAIR_SQL)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("m").alias("m")).filter("shared >= m").select("a", "b")


def linked(pairs: DataFrame, kept: DataFrame, join: Join) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold."""
    sets = kept.select("doc_id", "shingles")
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    full = full.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= join.percent * (len(both) - shared)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return full.mapInArrow(run, "a bigint, b bigint")


def merge_components(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(doc_id, comp) of ``comps`` and the further ``links`` (a, b)."""
    if comps is None:
        return connected_components(links).select(F.col("node").alias("doc_id"), F.col("label").alias("comp"))
    of = lambda c: comps.select(F.col("doc_id").alias(c), F.col("comp").alias(f"{c}_comp"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    lifted = materialize(lifted.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")), workspace(links.sparkSession, "lifted"))
    onward = connected_components(lifted).select(F.col("node").alias("comp"), "label")
    alone = lifted.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(comps, "doc_id", "left_anti")
    nodes = comps.select("doc_id", "comp").unionByName(alone.withColumn("comp", F.col("doc_id")))
    return nodes.join(onward, "comp", "left").select("doc_id", F.coalesce("label", "comp").alias("comp"))


def _pairs_left(lists: DataFrame) -> float:
    """How many pairs of postings of different components the lists have."""
    sums = lists.groupBy("list").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("own"))
    return sums.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()[0]


def _joined(pairs: DataFrame, kept: DataFrame, comps: DataFrame | None, join: Join, at: str) -> DataFrame:
    """``comps`` with the links that the candidate ``pairs`` have."""
    pairs = materialize(pairs, f"{at}/pairs")
    links = materialize(linked(pairs, kept, join), f"{at}/links")
    return materialize(merge_components(comps, links), f"{at}/components")


def near_duplicates(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id of those
    reachable by links, its own included).

    Null and empty texts and texts without words have no shingles and no links. Rows with equal sets
    are one text; rows that share a doc_id are one document, linked with what any of them is linked with.
    Rows without a doc_id get no component. Whole texts count; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, join or Join())


def _near_duplicates(docs: DataFrame, join: Join) -> DataFrame:
    spark = docs.sparkSession
    at = workspace(spark, "ngram_join")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = shingle_table(narrow, join, at)
    some = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = materialize(
        some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min_by("shingles", "doc_id").alias("shingles")), f"{at}/reps"
    )
    kept = prefix_table(reps.select("doc_id", "shingles"), join, at)
    n_postings = kept.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]

    comps, turn, before = None, 0, None
    while True:
        each = postings(kept, comps)
        if turn >= HEAD_TURNS:
            lists = materialize(open_lists(each), f"{at}/lists{turn}")
            left = _pairs_left(lists)
            if turn == MAX_HEAD_TURNS or left <= PAIRS_A_POSTING * n_postings or (before is not None and left > 0.9 * before):
                break
            before = left
        comps = _joined(head_candidates(each, join, turn), kept, comps, join, f"{at}/{turn}")
        turn += 1
    comps = _joined(candidates(each, lists, join), kept, comps, join, f"{at}/all")
    final = comps.select(F.col("doc_id").alias("rep"), F.col("comp").alias("label"))

    groups = reps.select("set_key", F.col("doc_id").alias("rep")).join(final, "rep", "left")
    groups = materialize(groups.select("set_key", F.coalesce("label", "rep").alias("component")), f"{at}/groups")
    alone = rows.filter("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    in_group = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_key")
    joined = in_group.join(groups, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return _by_document(materialize(alone.unionByName(joined), f"{at}/rows"))


def _by_document(rows: DataFrame) -> DataFrame:
    """``rows`` with the components of each document's rows as one."""
    ends = rows.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("high")).filter("a < high")
    found = rows.join(ends, "doc_id").filter("a < component_id").select("a", F.col("component_id").alias("b"))
    found = materialize(found.distinct(), workspace(rows.sparkSession, "shared_ids"))
    if not found.limit(1).count():
        return rows
    onward = connected_components(found).select(F.col("node").alias("component_id"), "label")
    return rows.join(onward, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, of those with its smallest doc_id; of
    several rows with that doc_id the one whose text comes first in an order by hash. Rows without a
    doc_id stay. All columns and no others, whatever their names; an empty table stays empty."""
    own, place, n, first = (free_name(docs, c) for c in ("own", "place", "n", "first"))
    found = near_duplicates(docs, join).filter("doc_id IS NOT NULL")
    ids = found.groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias(n), F.min("component_id").alias(first))
    odd = materialize(ids.filter((F.col(own) != F.col(first)) | (F.col(n) > 1)), workspace(docs.sparkSession, "odd"))
    # texts are dealt once, whatever the size of the other side, which grows with them
    joined = docs.withColumn(own, F.col("doc_id").cast("bigint")).join(odd.hint("merge"), own, "left")
    stays = joined.filter(F.col(first).isNull() | (F.col(own) == F.col(first)))
    columns = [quoted(c) for c in docs.columns]
    if not odd.filter((F.col(own) == F.col(first)) & (F.col(n) > 1)).limit(1).count():
        return stays.select(*columns)
    # few doc_ids are repeated; only their rows are sorted
    by_text = Window.partitionBy(own).orderBy(F.xxhash64("text"), "text")
    among = stays.filter(F.col(n) > 1).withColumn(place, F.row_number().over(by_text)).filter(F.col(place) == 1)
    return stays.filter(F.col(n).isNull() | (F.col(n) == 1)).select(*columns).unionByName(among.select(*columns))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 4, 1) + 1 END)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.k + nb.k - c)),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT w.doc_id, coalesce(k, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
