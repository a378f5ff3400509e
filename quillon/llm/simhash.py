"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint's bits say which bits most shingle hashes of a text have. Its ``segments`` lie on a ring.
If two fingerprints differ in at most ``bits`` bits, some segment begins a chain that goes once around
the ring and whose first l segments differ in at most floor(l * bits / segments) bits, for every l. With
more segments than bits the first one is equal, so:

1. Equal fingerprints are one. Every other one is listed under each of its segments; in lists of more
   than ``LONG`` it is listed once more under the next segment too, which may differ in one bit: once for each
   bit that is left out.
2. Fingerprints that meet in a list are held against the budgets of the chain that begins there, one segment
   after the other; the last budget is the full Hamming distance.
3. Where many meet, each first meets its neighbours in ring order and the most frequent fingerprint of a
   block, and what links is merged. Lists of one component are then left out, and in the others only
   fingerprints of different components meet, in blocks. A task sends on a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, shuffle_parts, small_batches, workspace
from quillon.llm.ngram_join import BLOCK, block_plan, meetings, merge_components, open_lists

#: Fingerprints of a list from which on the next segment is a part of the key.
LONG = 512
#: Neighbours in ring order that a fingerprint meets before all of different components meet.
NEIGHBOURS = 8
#: As in the n-gram join: turns with neighbours are taken while more pairs than this are left a posting.
PAIRS_A_POSTING, TURNS, MAX_TURNS = 16, 2, 8
#: Shingles that are hashed in one go.
CHUNK = 1 << 16
#: A fingerprint's rows are dealt to so many tasks.
SALTS = 64


@dataclass(frozen=True)
class Near:
    shingle: int = 3
    #: Linked if at most so many of the 64 bits differ.
    bits: int = 3
    segments: int = 4
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0 <= self.bits < self.segments or self.segments not in (2, 4, 8, 16, 32):
            raise ValueError("more segments than bits are needed, and they must be 2, 4, 8, 16 or 32")

    @property
    def width(self) -> int:
        return 64 // self.segments

    def budget(self, length: int) -> int:
        """Bits in which a chain of so many segments may differ."""
        return length * self.bits // self.segments


# --- fingerprints --------------------------------------------------------------------------------


def fingerprint(text: bytes, near: Near) -> bytes:
    """The fingerprint, high bits first, of a UTF-8 text; zero for a text without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return bytes(8)
    k = min(near.shingle, len(words))
    joined, n = b" ".join(words), len(words) - k + 1
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed, ones = xxhash.xxh64_intdigest, near.seed, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        m = min(CHUNK, n - i)
        spans = zip(starts[i : i + m].tolist(), ends[i + k - 1 : i + k - 1 + m].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, m)
        bits = np.zeros((-(-m // 255) * 255, 64), np.uint8)
        bits[:m] = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(m, 64)
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row's whole text."""
    near = near or Near()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", near) for t in batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, fp bigint")


# --- lists ---------------------------------------------------------------------------------------


def _turned(fp, segment, near: Near):
    """Fingerprints turned so that ``segment`` comes first."""
    by = (segment * near.width).astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(64) - by) & np.uint64(63))))


def _segment(i: int, near: Near):
    return F.shiftrightunsigned("fp", 64 - near.width * (i % near.segments + 1)).bitwiseAND((1 << near.width) - 1)


def posting_lists(nodes: DataFrame, near: Near, path: str) -> DataFrame:
    """(list, count, segment, doc_id, fp, n) for each list of at least two of ``nodes`` (doc_id, fp, n)
    that holds the node; ``segment`` is where its chain begins. Written to ``path``."""
    w, s = near.width, range(near.segments)
    first = F.posexplode(F.array(*(_segment(i, near) for i in s))).alias("segment", "value")
    one = nodes.select("doc_id", "fp", "n", first)
    own = one.withColumn("list", F.col("value") * near.segments + F.col("segment"))
    counts = own.groupBy("list").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    own = materialize(own.join(counts, "list").drop("value"), f"{path}/first")
    short = own.filter(F.col("count") <= LONG)
    # the next segment may differ in one bit at most, or in none if its budget is that small
    masks = [((1 << w) - 1) ^ (1 << b) for b in range(w)] if near.budget(2) else [(1 << w) - 1]
    after = F.element_at(F.array(*(_segment(i + 1, near) for i in s)), F.col("segment") + 1)
    # a mask's number, the value under it and the first list make a key of their own, below 0
    keys = F.array(*(F.lit(-1) - ((F.col("list") * len(masks) + F.lit(j)) * F.lit(1 << w) + after.bitwiseAND(m)) for j, m in enumerate(masks)))
    if 3 * w + 8 <= 64:
        long = own.filter(F.col("count") > LONG).withColumn("list", F.explode(keys)).drop("count")
        counts = long.groupBy("list").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
        own = short.unionByName(long.join(counts, "list"))
    return materialize(own.select("list", "count", "segment", "doc_id", "fp", "n"), f"{path}/lists")


# --- meetings ------------------------------------------------------------------------------------


def viable(x: np.ndarray, y: np.ndarray, near: Near) -> np.ndarray:
    """Positions of the pairs (turned fingerprints) whose chain keeps every budget."""
    differ, left = x ^ y, np.arange(len(x))
    for length in range(1, near.segments + 1):
        mask = np.uint64(((1 << near.width * length) - 1) << (64 - near.width * length))
        ok = np.bitwise_count(differ & mask) <= near.budget(length)
        differ, left = differ[ok], left[ok]
    return left


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links (a, b) connect; root is the smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def whole_groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """The rows as tables that hold whole groups of consecutive rows with equal ``by``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch[c].to_numpy() for c in by])
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if held and (keys[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])])
            held = []
        held.append(batch.slice(new[-1] if len(new) else 0))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _links(near: Near, neighbours_only: bool):
    """A mapInArrow function over postings (list, part, side, segment, comp, doc_id, fp, n): links (a, b)
    between different components, as a forest for each table of whole parts."""

    def close(part: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(1, NEIGHBOURS + 1):
            i = np.flatnonzero(part[k:] == part[:-k])
            yield i, i + k
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        frequent = np.lexsort((-n, part))[first]  # the first of each part by falling n
        yield frequent[part], np.arange(len(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "list", "part"):
            list_, part, side, segment, comp, doc, n = (t[c].to_numpy() for c in ("list", "part", "side", "segment", "comp", "doc_id", "n"))
            x = _turned(t["fp"].to_numpy().view(np.uint64), segment, near)
            group = np.cumsum(np.concatenate([[True], (list_[1:] != list_[:-1]) | (part[1:] != part[:-1])])) - 1
            if neighbours_only:
                order = np.lexsort((doc, x, group))
                x, comp, doc, n, group = x[order], comp[order], doc[order], n[order], group[order]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in close(group, n) if neighbours_only else meetings(group, side, comp):
                other = comp[i] != comp[j]
                i, j = i[other], j[other]
                ok = viable(x[i], x[j], near)
                if len(ok):
                    node, root = forest(doc[i[ok]], doc[j[ok]])
                    a.append(node)
                    b.append(root)
            node, root = forest(np.concatenate(a), np.concatenate(b))
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], ["a", "b"])

    return run


_ROW = ("segment", "comp", "doc_id", "fp", "n")


def _neighbour_links(each: DataFrame, near: Near, turn: int) -> DataFrame:
    # blocks differ from list to list, so that their groups meet
    part = F.pmod(F.xxhash64("doc_id", "list", F.lit(turn)), F.ceil(F.col("count") / (4 * BLOCK))).cast("bigint")
    placed = each.select("list", part.alias("part"), F.lit(2).alias("side"), *_ROW)
    dealt = placed.repartition(shuffle_parts(each.sparkSession), "list", "part").sortWithinPartitions("list", "part")
    return dealt.mapInArrow(_links(near, True), "a bigint, b bigint")


def _other_links(each: DataFrame, lists: DataFrame, near: Near) -> DataFrame:
    """All links between different components: a small component lies whole in one of the list's blocks, a
    large one in blocks of its own, and blocks meet but for those of one component."""
    rows = each.join(block_plan(lists), ["list", "comp"])
    at = F.when(F.col("alone"), F.xxhash64("doc_id")).otherwise(F.xxhash64("comp"))
    rows = rows.withColumn("block", F.col("first") + F.pmod(at, F.col("own")))
    meets = lambda x: ~F.col("alone") | (x < F.col("first")) | (x >= F.col("first") + F.col("own"))
    every = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), meets)
    rows = rows.withColumn("other", F.explode(every))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    placed = rows.select("list", part.alias("part"), side.alias("side"), *_ROW)
    dealt = placed.repartition(shuffle_parts(each.sparkSession), "list", "part").sortWithinPartitions("list", "part", "side", "comp")
    return dealt.mapInArrow(_links(near, False), "a bigint, b bigint")


def _pairs(lists: DataFrame) -> tuple[float, float]:
    """Of ``lists`` (list, comp, n): pairs of postings of different components, and postings."""
    n = F.col("n").cast("double")
    sums = lists.groupBy("list").agg(F.sum(n).alias("n"), F.sum(n * n).alias("own"))
    pairs, postings = sums.agg(F.sum((n * n - F.col("own")) / 2), F.sum("n")).first()
    return pairs or 0.0, postings or 0.0


def components(nodes: DataFrame, near: Near) -> DataFrame:
    """(doc_id, comp) of the ``nodes`` (doc_id, fp, n) that are linked with others."""
    spark = nodes.sparkSession
    at = workspace(spark, "simhash")
    listed = posting_lists(nodes, near, at)
    comps, turn, before = None, 0, None
    while True:
        each = listed.withColumn("comp", F.col("doc_id"))
        if comps is not None:
            each = listed.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        lists = materialize(open_lists(each), f"{at}/{turn}/open")
        left, postings = _pairs(lists)
        stalled = turn > TURNS and left > 0.9 * before
        if left <= PAIRS_A_POSTING * postings or turn == MAX_TURNS or stalled:
            break
        links = materialize(_neighbour_links(each, near, turn), f"{at}/{turn}/links")
        comps = materialize(merge_components(comps, links), f"{at}/{turn}/components")
        turn, before = turn + 1, left
    links = materialize(_other_links(each, lists, near), f"{at}/links")
    found = materialize(merge_components(comps, links), f"{at}/components")
    discard(spark, f"{at}/lists")
    return found


def near_duplicates(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id of those reachable by links, its own included.

    Whole texts count, A-Z lower-cased; null and empty texts and texts without words have the fingerprint zero, which
    links like any other. Rows that share a doc_id are one document, linked with what any of them is linked
    with. Rows without a doc_id have a fingerprint but no component and link nothing. An empty table gives no
    rows; other columns, whatever their names, don't matter.
    """
    near, spark = near or Near(), docs.sparkSession
    at = workspace(spark, "fingerprints")
    with small_batches(spark):
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        rows = materialize(fingerprints(docs, near).withColumn("salt", salt), f"{at}/rows")
    known = rows.filter("doc_id IS NOT NULL")
    by_salt = known.groupBy("fp", "salt").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    groups = by_salt.groupBy("fp").agg(F.min("doc_id").alias("node"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    groups = materialize(groups, f"{at}/groups")
    found = components(groups.select(F.col("node").alias("doc_id"), "fp", "n"), near)
    of = groups.select("fp", "node", F.explode("salts").alias("salt"))
    placed = materialize(known.join(of, ["fp", "salt"]).select("doc_id", "fp", "node"), f"{at}/placed")
    # a doc_id that has several fingerprints links them
    several = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a < high").drop("high")
    again = materialize(placed.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a < b").distinct(), f"{at}/again")
    if again.limit(1).count():
        found = materialize(merge_components(found, again), f"{at}/merged")
    ends = groups.select(F.col("node").alias("doc_id"), "fp", "salts").join(found, "doc_id", "left")
    ends = ends.select("fp", F.coalesce("comp", "doc_id").alias("component_id"), F.explode("salts").alias("salt"))
    out = rows.join(ends, ["fp", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
