"""Near duplicates: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

A set's shingles are ordered rare first.  Two sets that are similar enough share a shingle
among the first few of each (the prefix), so only documents that meet on a prefix shingle
can link.  Their lengths, the position at which they meet, and how many shingles each has in
ranges of the hash (the suffix filter: ranges bound what the rest can have in common) rule out
most pairs; the others are verified once, on whole sets.

No group of similar documents is expanded into all its pairs.  Copies of one set act as one
document.  Documents that meet on a shingle are first compared with one of them, the hub,
which is the one with the least of its own before that shingle.  Links join documents into
components.  Where those that meet on a shingle are still in different components, another
hub is tried, and in the end all pairs that meet and are in different components are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwake.llm.shared import forget, in_pieces, staged

WORDS = 5
# A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
# Counters of shingle frequency, by hash; their number is fixed, whatever the input.
COUNTERS, SLICES = 1 << 20, 64
BINS = 32
# Hubs with which those that meet on a shingle are compared before any two of them are.
HUBS = 2
# Parts of a group of copies, and the factor of length within which sets are compared at last.
SALTS, LENGTHS = 16, 1.26
# Words whose hash a task remembers, and sets whose repetition within a task it notices.
MEMO, NOTICED = 300_000, 200_000

PROFILE = "doc_id long, n_shingles int, high long, low long, bins array<int>, slice int, counts binary"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of whole texts."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z and the contract's white space
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for word in words:
            if word not in memo:
                memo[word] = xxhash.xxh3_64_intdigest(word)
        hashed = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(WORDS, len(words))
        made = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            made += hashed[k : len(words) - width + 1 + k] * np.uint64(_POWERS[k])
        return np.unique(_mixed(made * _MULTIPLIER))


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    high, low = np.frombuffer(digest, dtype="<i8")
    return int(high), int(low)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)  # 20 bits, as COUNTERS


def profile(docs: DataFrame) -> DataFrame:
    """Rows of documents (size, fingerprint and ranges of the set) and of shingle counts, staged."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingles, counts = Shingles(), np.zeros(COUNTERS, dtype=np.int64)
        for batch in in_pieces(batches, 1000):
            rows = []
            for text in batch.column("text").to_pylist():
                found = shingles.of(text or "")
                np.add.at(counts, _counter(found), 1)
                bins = np.bincount((found >> np.uint64(59)).astype(np.int64), minlength=BINS)
                rows.append((len(found), *_fingerprint(found), bins.astype(np.int32)))
            sizes, high, low, bins = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
            yield _profile_rows(batch.column("doc_id"), sizes, high, low, bins, None, None)
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SLICES)]
        blank = [None] * SLICES
        yield _profile_rows(
            pa.array(blank, pa.int64()), blank, blank, blank, blank, list(range(SLICES)), parts
        )

    return staged(docs.select("doc_id", "text").mapInArrow(measure, PROFILE), "profile")


def _profile_rows(ids, sizes, high, low, bins, slices, counts) -> pa.RecordBatch:
    blank = [None] * len(ids)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(sizes, pa.int32()),
            pa.array(high, pa.int64()),
            pa.array(low, pa.int64()),
            pa.array(bins, pa.list_(pa.int32())),
            pa.array(slices or blank, pa.int32()),
            pa.array(counts or blank, pa.binary()),
        ],
        names=["doc_id", "n_shingles", "high", "low", "bins", "slice", "counts"],
    )


def frequencies(profiled: DataFrame) -> np.ndarray:
    """All tasks' counters summed up: COUNTERS numbers, fixed in size."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in in_pieces(batches, 100):
            for one, packed in zip(*(batch.column(c).to_pylist() for c in ("slice", "counts"))):
                counts = np.frombuffer(zlib.decompress(packed), dtype=np.int64)
                sums[one] = sums[one] + counts if one in sums else counts
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array(list(sums), pa.int32()),
                "counts": pa.array(
                    [np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in sums.values()],
                    pa.binary(),
                ),
            }
        )

    rows = profiled.filter("slice is not null").select("slice", "counts")
    out = np.zeros(COUNTERS, dtype=np.uint32).reshape(SLICES, -1)
    for row in rows.repartition("slice").mapInArrow(total, "slice int, counts binary").collect():
        out[row.slice] = np.frombuffer(row.counts, dtype=np.uint32)
    return out.reshape(-1)


def prefix_length(n: int) -> int:
    """Shingles of which a similar set shares at least one; for any partner of up to n shingles."""
    return n - -(-PERCENT * n // 100) + 1


def meetings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """shingle, doc_id, n, at: prefix shingles that several rows share, staged.

    A set that repeats within a task is sent on once; its other rows join it as copies.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingles, often, noticed = Shingles(), shared.value, set()
        for batch in in_pieces(batches, 500):
            parts: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for name, text in zip(ids, batch.column("text").to_pylist()):
                found = shingles.of(text or "")
                if not len(found):
                    continue
                mark = _fingerprint(found)
                if mark in noticed:
                    continue
                if len(noticed) >= NOTICED:
                    noticed.clear()
                noticed.add(mark)
                order = np.lexsort((found, often[_counter(found)]))
                chosen = found[order[: prefix_length(len(found))]]
                parts.append((chosen, name, len(found)))
            sizes = [len(p[0]) for p in parts]
            if not parts:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                    pa.array(np.repeat(np.array([p[1] for p in parts]), sizes)),
                    pa.array(np.repeat(np.array([p[2] for p in parts], dtype=np.int32), sizes)),
                    pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                ],
                names=["shingle", "doc_id", "n", "at"],
            )

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose shingle is also that of a row beside them; the last row waits for the next batch."""
        held, held_shared = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("shingle").to_numpy()
            same = found[1:] == found[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if held is not None:
                joins = held.column("shingle")[0].as_py() == found[0]
                if joins or held_shared:
                    yield held
                keep[0] |= joins
            if keep[:-1].any():
                yield batch.slice(0, len(keep) - 1).filter(pa.array(keep[:-1]))
            held, held_shared = batch.slice(batch.num_rows - 1), bool(keep[-1])
        if held is not None and held_shared:
            yield held

    ddl = "shingle long, doc_id long, n int, at int"
    rows = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(prefixes, ddl)
    together = rows.repartition("shingle").sortWithinPartitions("shingle")
    return staged(together.mapInArrow(shared_only, ddl), "meetings")


def _can_link(a: str, b: str) -> Column:
    """Length and positional filter for rows that meet at positions a.at and b.at.

    The first shingle that two linked sets have in common leaves at least the overlap they
    need, itself included, in both; meetings further back need not be looked at.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (
        (100 + PERCENT) * rest >= PERCENT * (n + m)
    )


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs low, high of rows with columns a.node and b.node."""
    a, b = F.col("a.node"), F.col("b.node")
    return met.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, shingles of the wanted documents, staged."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in in_pieces(batches, 500):
            found = [shingles.of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(f) for f in found], pa.int32()),
                    pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())),
                ],
                names=["node", "n", "shingles"],
            )

    wanted = docs.select("doc_id", "text").join(nodes.toDF("doc_id"), "doc_id", "left_semi")
    return staged(wanted.mapInArrow(build, "node long, n int, shingles array<long>"), "sets")


def verified(pairs: DataFrame, ranges: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link: suffix filter on narrow rows first, then whole sets.

    Whole sets are made, and shuffled, only for ends of pairs that pass the suffix filter.
    """

    def side(rows: DataFrame, name: str, column: str) -> DataFrame:
        return rows.select(
            F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col(column).alias(f"{name}_{column}")
        )

    def enough(common: Column) -> Column:
        return (100 + PERCENT) * common >= PERCENT * (F.col("low_n") + F.col("high_n"))

    common = F.aggregate(
        F.zip_with("low_bins", "high_bins", lambda x, y: F.least(x, y)), F.lit(0), lambda total, one: total + one
    )
    near = pairs.join(side(ranges, "low", "bins"), "low").join(side(ranges, "high", "bins"), "high")
    # Written down, the pairs have a known size, and the sets stay where they are if it is small.
    near = staged(near.filter(enough(common)).select("low", "high").distinct(), "near")
    ends = near.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    sets = sets_of(docs, staged(ends, "ends"))
    whole = near.join(side(sets, "low", "shingles"), "low").join(side(sets, "high", "shingles"), "high")
    return (
        whole.filter(enough(F.size(F.array_intersect("low_shingles", "high_shingles"))))
        .select("low", "high")
        .distinct()
    )


def copies_of(present: DataFrame) -> DataFrame:
    """doc_id, node: documents whose set is also that of a smaller id, the node, staged.

    Only sets that several rows have take part in the join, each group in SALTS parts.
    """
    salted = present.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("high", "low", "salt").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"))
    several = parts.groupBy("high", "low").agg(F.min("node").alias("node"), F.sum("rows").alias("rows"))
    first = several.filter("rows > 1").select(
        "high", "low", "node", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    )
    found = salted.join(first, ["high", "low", "salt"]).filter("doc_id <> node")
    return staged(found.select("doc_id", "node"), "copies")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable by links, for every node with a link.

    Large-star and small-star steps in turn until nothing changes; a step joins each node
    with the minimum of its neighbours, which is combined before the shuffle.
    """
    edges = staged(links.select(F.col("high").alias("u"), F.col("low").alias("v")), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned = small.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
        edges = staged(turned, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        state = now


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of other than space and \\t-\\r, after lower-casing A-Z; fewer than five
    words make one shingle, none (null or empty text) make none and link with nothing.  Ids should
    be unique: rows that repeat one share a component, and are looked up by one of their
    texts where these differ.  Rows without an id take no part; their component is null.  An
    empty table gives an empty result; other columns are ignored.
    """
    profiled = profile(docs)
    rows = profiled.filter("slice is null").select("doc_id", "n_shingles", "high", "low")
    met = meetings(docs, frequencies(profiled))
    present = rows.filter("doc_id is not null and n_shingles > 0")
    copies = copies_of(present)
    folded = (
        met.join(copies, "doc_id", "left")
        .groupBy("shingle", F.coalesce("node", "doc_id").alias("node"), "n")
        .agg(F.min("at").alias("at"))
    )
    # A shingle that one node alone has left is its own hub and meets nobody.
    apart = staged(folded.withColumn("label", F.col("node")), "apart")
    nodes = staged(apart.select("node").distinct(), "nodes")
    ranges = profiled.filter("slice is null").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bins")
    ranges = staged(ranges.join(nodes, "node", "left_semi"), "ranges")
    tried = None
    labels = apart.select("node", "label").limit(0)
    for turn in range(HUBS + 1):
        met = _with_hub(apart, turn) if turn < HUBS else _all_pairs(apart)
        met = met.filter((F.col("a.label") != F.col("b.label")) & _can_link("a", "b"))
        fresh = _pairs(met)
        if tried is not None:
            fresh = fresh.join(tried, ["low", "high"], "left_anti")
        pairs = staged(fresh, "pairs")
        links = staged(verified(pairs, ranges, docs), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not links.isEmpty():
            labels = _merged(labels, links)
            apart = _still_apart(apart, labels) if turn < HUBS else apart
    ends = copies.groupBy("doc_id").agg(F.min("node").alias("node"))
    found = rows.join(ends, "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
    return found.join(labels, "node", "left").select(
        "doc_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.coalesce("label", "node").alias("component_id"),
    )


def _all_pairs(apart: DataFrame) -> DataFrame:
    """Rows that meet on a shingle and are of like length; the caller keeps those in different components.

    Lengths are in classes a factor LENGTHS wide, more than the filter on lengths allows, so
    sets that can link are in the same class or in neighbouring ones.
    """
    rows = apart.withColumn("kind", F.floor(F.log(LENGTHS, F.col("n"))))
    here = rows.withColumn("class", F.col("kind"))
    beside = rows.withColumn("class", F.explode(F.array("kind", F.col("kind") + 1)))
    met = here.alias("a").join(beside.alias("b"), ["shingle", "class"])
    return met.filter((F.col("b.kind") < F.col("a.kind")) | (F.col("a.node") < F.col("b.node")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the components, staged."""
    known = labels.withColumnRenamed("node", "end")

    def to_label(df: DataFrame, end: str) -> DataFrame:
        seen = known.select(F.col("end").alias(end), F.col("label").alias(f"{end}_label"))
        return df.join(seen, end, "left").withColumn(end, F.coalesce(f"{end}_label", end))

    ends = to_label(to_label(links, "low"), "high").select(
        F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")
    )
    moved = components(ends.filter("low <> high").distinct())
    older = labels.join(moved.toDF("label", "to"), "label", "left").select(
        "node", F.coalesce("to", "label").alias("label")
    )
    new = moved.join(labels.select("node"), "node", "left_anti")
    return staged(older.unionByName(new), "labels")


def _with_hub(apart: DataFrame, turn: int) -> DataFrame:
    """Rows a beside the hub b of their shingle.

    First it is the set with the fewest shingles rarer than this one, so one with little of
    its own; then another one by hash in each turn.
    """
    mark = F.struct(F.col("at") if turn == 0 else F.lit(0), F.xxhash64(F.lit(turn), "node"))
    hub = F.min(F.struct(mark.alias("mark"), "node", "n", "at", "label"))
    hubs = apart.groupBy("shingle").agg(hub.alias("hub")).select("shingle", "hub.*")
    return apart.alias("a").join(hubs.alias("b"), "shingle")


def _still_apart(apart: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their new labels, of the shingles on which several components meet."""
    now = apart.drop("label").join(labels, "node", "left")
    now = now.withColumn("label", F.coalesce("label", "node"))
    ends = now.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = ends.filter("x <> y").select("shingle")
    return staged(now.join(mixed, "shingle", "left_semi"), "apart")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` of which no similar one has a smaller id, with all their columns.

    Rows without an id and rows without words stay.  Rows that repeat an id stay or go together,
    so there are no ties.  An empty table gives an empty result.
    """
    kept = join(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_dropped"))
    return docs.join(kept, docs["doc_id"] == kept["_dropped"], "left_anti")
