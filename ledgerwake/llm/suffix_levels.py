"""Removal of long repeats by a logarithmic family of suffix arrays.

Suffixes are indexed at anchors, places that the text itself picks: of every LONG bytes, the
start of the CORE bytes in them whose hash is least.  Equal strings of LONG bytes pick the same
anchor, so they meet on its core.  A suffix array holds anchors in the order of core and
context, context being all strings that pick the anchor together.

New documents come in batches.  The array of a batch is merge-scanned with every array before
it: a neighbour with the same core means a possible match, one with the same context a match of
all strings around both.  Arrays of equal size merge on the way, so sizes are powers of two.

Where only the core is shared, a passage begins or ends.  There contexts are sorted by what
follows the core and by what is before it, and neighbours in both orders tell which strings
they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.llm.shared import in_pieces, kept, staged

# Bytes of a string that counts as a repeat, and of an anchor's core.
LONG, CORE = 200, 40
# Cores that start within a string of LONG bytes.
WITHIN = LONG - CORE + 1
# Strings of one step, and bits that hold a place within its bytes.
STEP, PLACE_BITS = 1 << 18, 20
# Batches in which the documents of one call come.
BATCHES = 4

ENTRY = "core long, context long, row long, place long, state int"
SCANNED = f"{ENTRY}, scanned boolean, found boolean, part int, edge int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Anchors:
    """Finds anchors in joined texts of fewer than 2 ** PLACE_BITS bytes."""

    def __init__(self):
        size = 1 << PLACE_BITS
        self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)

    def of(self, joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, and the first and last start of the strings that pick each.

        Of equally small hashes the last one is picked, so a string's bytes alone decide.
        """
        none = np.zeros(0, dtype=np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        fits = sizes >= LONG
        if not fits.any():
            return none, none, none
        raw = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(raw * self.up[: len(raw)])])
        hashed = (sums[CORE:] - sums[:-CORE]) * self.down[: len(sums) - CORE]
        hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(32)
        low = np.uint64(PLACE_BITS)
        top = np.uint64((1 << PLACE_BITS) - 1)
        key = (hashed >> low << low) | (top - np.arange(len(hashed), dtype=np.uint64))
        # Least of each run of WITHIN keys, from running minima of blocks in both directions.
        blocks = np.append(key, np.full(-len(key) % WITHIN, ~np.uint64(0))).reshape(-1, WITHIN)
        after = np.minimum.accumulate(blocks, axis=1).ravel()
        before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - WITHIN + 1
        least = np.minimum(before[:n], after[WITHIN - 1 : WITHIN - 1 + n])
        picked = (top - (least & top)).astype(np.int64)
        inside = np.zeros(n + 1, dtype=np.int32)
        inside[starts[fits]] += 1
        np.add.at(inside, ends[fits] - LONG + 1, -1)
        strings = np.flatnonzero(np.cumsum(inside[:n]))
        picked = picked[strings]
        cut = np.flatnonzero((picked[1:] != picked[:-1]) | (strings[1:] != strings[:-1] + 1)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(strings)]]) - 1
        return picked[first], strings[first], strings[last]


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list]]:
    """Rows, starts and bytes of texts in groups that fit one step.

    A long text comes in segments that begin STEP apart and overlap, so each of its strings is
    in one of them.
    """
    rows, starts, parts, size = [], [], [], 0
    for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
        raw = (text or "").encode()
        for start in range(0, len(raw) - LONG + 1, STEP):
            part = raw[start : start + STEP + LONG - 1]
            if size and size + len(part) >= 2 * STEP:
                yield rows, starts, parts
                rows, starts, parts, size = [], [], [], 0
            rows.append(row)
            starts.append(start)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, starts, parts


def suffixes(docs: DataFrame) -> DataFrame:
    """The anchors of documents (row, text) as entries of a suffix array, not yet in order.

    `place` holds where the first string starts, how many more there are (8 bits), and how far
    the anchor is from the first one's start (8 bits).
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = kept(("anchors",), Anchors)
        for batch in in_pieces(batches, 500):
            for rows, starts, parts in _segments(batch):
                joined, sizes = b"".join(parts), np.array([len(p) for p in parts])
                at, first, last = find.of(joined, sizes)
                own = np.searchsorted(np.cumsum(sizes), first, "right")
                start = first - (np.cumsum(sizes) - sizes)[own] + np.array(starts)[own]
                code = (last - first) << 8 | (at - first)
                cores = [xxhash.xxh3_64_intdigest(joined[a : a + CORE]) for a in at.tolist()]
                contexts = [
                    xxhash.xxh3_64_intdigest(joined[a : b + LONG], seed)
                    for a, b, seed in zip(first.tolist(), last.tolist(), code.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(cores, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(contexts, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(rows, dtype=np.int64)[own]),
                        pa.array(start << 16 | code),
                        pa.array(np.zeros(len(at), dtype=np.int32)),
                    ],
                    names=["core", "context", "row", "place", "state"],
                )

    return docs.select("row", "text").mapInArrow(sample, ENTRY)


def _neighbours(whole: bool):
    """Merge-scan of sorted entries: their state, and which must be written."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, before, is_first = TaskContext.get().partitionId(), None, None, True

        def judged(batch: pa.RecordBatch, before, after, is_first: bool, is_last: bool):
            core, context = (batch.column(c).to_numpy() for c in ("core", "context"))

            def same(values, k):
                ends = [edge is not None and edge[k] == v for edge, v in ((before, values[0]), (after, values[-1]))]
                inner = values[1:] == values[:-1]
                return np.concatenate([[ends[0]], inner]), np.concatenate([inner, [ends[1]]])

            (core_up, core_down), (context_up, context_down) = same(core, 0), same(context, 1)
            met = core_up | core_down
            all_met = (core_up & context_up) | (core_down & context_down)
            old = batch.column("state").to_numpy()
            state = np.maximum(old, met.astype(np.int32) + all_met).astype(np.int32)
            edge = np.zeros(len(core), dtype=np.int32)
            edge[0] += is_first
            edge[-1] += 2 * is_last
            found = state > old
            scanned = batch.column("scanned").to_numpy(zero_copy_only=False)
            wanted = found | (edge > 0) | (np.False_ if not whole else ~scanned)
            names = ["core", "context", "row", "place"]
            columns = [batch.column(c) for c in names]
            more = [state, scanned, found, np.full(len(core), part, dtype=np.int32), edge]
            out = pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, more)], names=[c.split()[0] for c in SCANNED.split(", ")]
            )
            return out.filter(pa.array(wanted))

        def lead(batch, n):
            return batch.column("core")[n].as_py(), batch.column("context")[n].as_py()

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield judged(held, before, lead(batch, 0), is_first, False)
                before, is_first = lead(held, held.num_rows - 1), False
            held = batch
        if held is not None:
            yield judged(held, before, None, is_first, True)

    return scan


class SuffixLevels:
    """Suffix arrays of all batches so far; the array of size s holds s batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, DataFrame] = {}

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Entries that found a new match with this batch, on both sides: core, context, row, place, state.

        State 1 is a shared core, 2 a shared context.  Rows must be new to the index.  Without
        `keep` the batch is matched but not added.
        """
        fresh = suffixes(docs)
        size, merged = 1, [fresh]
        while keep and size in self.levels:
            merged.append(self.levels.pop(size))
            size *= 2
        sides = [(one, False) for one in merged] + [(one, True) for one in self.levels.values()]
        union = reduce(DataFrame.unionByName, [df.withColumn("scanned", F.lit(s)) for df, s in sides])
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["core", "context", "row", "place"]
        ordered = union.repartitionByRange(n, *order).sortWithinPartitions(*order)
        scanned = staged(ordered.mapInArrow(_neighbours(keep), SCANNED), "suffixes")
        names = [c.split()[0] for c in ENTRY.split(", ")]
        if keep:
            self.levels[size] = scanned.filter("not scanned").select(names)
        return scanned.filter("found").select(names).unionByName(self._across(scanned).select(names))

    def _across(self, scanned: DataFrame) -> DataFrame:
        """Matches of neighbours in different tasks: two entries a task are looked at."""
        edges = scanned.filter("edge > 0").collect()
        first = {r.part: r for r in edges if r.edge & 1}
        last = {r.part: r for r in edges if r.edge & 2}
        parts, rows = sorted(first), []
        for a, b in zip(parts, parts[1:]):
            x, y = last[a], first[b]
            if x.core == y.core:
                state = 2 if x.context == y.context else 1
                rows += [(r.core, r.context, r.row, r.place, state) for r in (x, y) if state > r.state]
        return self.spark.createDataFrame(rows, ENTRY)


def _named(docs: DataFrame) -> DataFrame:
    """row, doc_id, text; ids name rows if they can, else rows are numbered in a staged copy."""
    unclear = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if unclear.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("row"), "doc_id", "text")
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, for they are shuffled: row, doc_id, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in in_pieces(batches, 500):
            packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "packed"])

    return rows.mapInArrow(pack, "row long, doc_id long, packed binary")


def matches(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """core, context, row, place, state of every anchor whose core occurs elsewhere, staged."""
    index = SuffixLevels(rows.sparkSession)
    batch_of = F.pmod(F.xxhash64("row"), F.lit(batches))
    found = [index.add(rows.filter(batch_of == k), keep=k < batches - 1) for k in range(batches)]
    union = reduce(DataFrame.unionByName, found)
    known = union.groupBy("row", "place").agg(
        F.first("core").alias("core"), F.first("context").alias("context"), F.max("state").alias("state")
    )
    return staged(known, "matches")


CONTEXT = "row long, first long, n int, lone boolean, left binary, mid binary, right binary"


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of contexts, staged.  `wanted` has row, place, lone.

    `mid` is the core, `left` what is before it, read backwards, `right` what follows; `n` strings
    begin at `first`.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in in_pieces(batches, 200):
            out = []
            for row, packed, places in zip(*(batch.column(c).to_pylist() for c in ("row", "packed", "places"))):
                raw = press.decompress(packed)
                for one in places:
                    first, more, off = one["place"] >> 16, one["place"] >> 8 & 0xFF, one["place"] & 0xFF
                    at = first + off
                    left, right = raw[first:at][::-1], raw[at + CORE : first + more + LONG]
                    out.append((row, first, more + 1, one["lone"], left, raw[at : at + CORE], right))
            yield _batch(out, CONTEXT)

    places = wanted.groupBy("row").agg(F.collect_list(F.struct("place", "lone")).alias("places"))
    return staged(_packed(rows).join(places, "row").mapInArrow(fetch, CONTEXT), "contexts")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [c.split() for c in ddl.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    arrays = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def in_common(a: bytes, b: bytes) -> int:
    """Length of the longest common start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def _bits(low: int, high: int) -> int:
    """Bits low to high, both included."""
    low = max(low, 0)
    return (1 << high + 1) - (1 << low) if high >= low else 0


# Strings are bits of a number: bit k is the one that starts k bytes after the first.
MASK_BYTES = 24
LOOKED = f"{CONTEXT}, reach int, proved binary, before binary"
JUDGED = f"{CONTEXT}, proved binary, open binary, asked binary"


def _shared(one: tuple, other: tuple) -> tuple[int, int, int]:
    """Common bytes on the left and on the right, and the strings that both have."""
    left, right = in_common(one[4], other[4]), in_common(one[6], other[6])
    off = len(one[4])
    # The string with r bytes before the core has LONG - CORE - r after it.
    return left, right, _bits(off - left, min(one[2] - 1, off - (LONG - CORE) + right))


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple | None, tuple | None]]:
    """Each row with the rows before and after it in this task."""
    before, one = None, None
    for batch in in_pieces(batches, 2000):
        for after in zip(*(c.to_pylist() for c in batch.columns)):
            if one is not None:
                yield one, before, after
            before, one = one, after
    if one is not None:
        yield one, before, None


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan in the order of core and left side: most bytes in common there, and strings proved.

    A neighbour in another task is not seen; then any number may be in common.
    """
    out = []
    for one, before, after in _beside(batches):
        reach, proved, by_before = 0, 0, 0
        for other in (before, after):
            if other is None:
                reach = LONG
            elif other[5] == one[5]:
                left, _, both = _shared(one, other)
                reach, proved = max(reach, left), proved | both
                if other is before:
                    by_before = both
        masks = [m.to_bytes(MASK_BYTES) for m in (proved, by_before)]
        out.append((*one, reach, *masks))
        if len(out) == 5000:
            yield _batch(out, LOOKED)
            out = []
    yield _batch(out, LOOKED)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan in the order of core and right side.  A string beyond what is in common on either side is alone.

    Of the others, `proved` are those that a neighbour has.  Those left are `asked` for, and
    `open` are strings not known to be the left neighbour's too: of equal strings one is open.
    """
    out = []
    for row, before, after in _beside(batches):
        one, (reach, proved, by_before) = row[:7], (row[7], *map(int.from_bytes, row[8:]))
        right = 0
        for other in (before, after):
            if other is None:
                right = LONG
            elif other[5] == one[5]:
                _, common, both = _shared(one, other)
                right, proved = max(right, common), proved | both
        off = len(one[4])
        possible = _bits(off - reach, min(one[2] - 1, off - (LONG - CORE) + right))
        asked = possible & ~proved if one[3] else 0
        masks = [m.to_bytes(MASK_BYTES) for m in (proved, possible & ~by_before, asked)]
        out.append((*one, *masks))
        if len(out) == 5000:
            yield _batch(out, JUDGED)
            out = []
    yield _batch(out, JUDGED)


SPAN = "row long, first long, last long"


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of proved strings."""
    for batch in in_pieces(batches, 5000):
        out = []
        for row, first, mask in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "proved"))):
            left = int.from_bytes(mask)
            while left:
                low = (left & -left).bit_length() - 1
                run = ((left >> low) + 1 & ~(left >> low)).bit_length() - 1
                out.append((row, first + low, first + low + run - 1))
                left &= ~_bits(low, low + run - 1)
        yield _batch(out, SPAN)


STRING = "high long, low long, row long, first long, asked boolean"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of 128 bits of the open strings."""
    for batch in in_pieces(batches, 500):
        digests, out = [], []
        names = ("row", "first", "left", "mid", "right", "open", "asked")
        for row, first, left, mid, right, *masks in zip(*(batch.column(c).to_pylist() for c in names)):
            raw = left[::-1] + mid + right
            is_open, asked = map(int.from_bytes, masks)
            for k in range(is_open.bit_length()):
                if is_open >> k & 1:
                    digests.append(xxhash.xxh3_128_digest(raw[k : k + LONG]))
                    out.append((row, first + k, bool(asked >> k & 1)))
        halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).tolist()
        yield _batch([(*h, *o) for h, o in zip(halves, out)], STRING)


def _ordered(df: DataFrame, *columns: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)


def shared_strings(contexts: DataFrame) -> DataFrame:
    """row, first, last: starts of the strings of lone contexts that other contexts have too.

    Contexts that share a string have its core and r bytes on the left and the rest on the right
    in common.  Sorted by either side, the longest common part is that with a neighbour, which
    bounds r from both ends; and what a neighbour has on both sides is proved.  Few strings are
    in the bounds and not proved: these are compared by digest.  Large groups of one core are
    split like any other rows.
    """
    looked = staged(_ordered(contexts, "mid", "left", "row", "first").mapInArrow(_looked, LOOKED), "looked")
    judged = staged(_ordered(looked, "mid", "right", "row", "first").mapInArrow(_judged, JUDGED), "judged")
    nothing = F.lit(bytes(MASK_BYTES))
    groups = judged.filter(F.col("asked") != nothing).select("mid").distinct()
    unsure = judged.filter(F.col("open") != nothing).join(groups, "mid", "left_semi")
    each = staged(unsure.mapInArrow(_strings, STRING), "strings")
    several = each.groupBy("high", "low").count().filter("count > 1").select("high", "low")
    met = each.filter("asked").join(several, ["high", "low"], "left_semi")
    proved = judged.filter("lone").select("row", "first", "proved").mapInArrow(_proved, SPAN)
    return proved.unionByName(met.select("row", "first", F.col("first").alias("last")))


def repeats(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """row, first, last: starts of strings of LONG bytes that also start elsewhere."""
    found = matches(rows, batches)
    full = found.filter("state = 2").select(
        "row",
        F.shiftright("place", 16).alias("first"),
        (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(F.lit(0xFF))).alias("last"),
    )
    # One row for each context; those that occur once are looked at, the others stand beside them.
    one = F.min(F.struct("row", "place")).alias("one")
    each = found.groupBy("core", "context").agg(one, (F.max("state") == 1).alias("lone"))
    each = staged(each.select("core", "one.*", "lone"), "each")
    unsure = each.filter("lone").select("core").distinct()
    contexts = _contexts(rows, each.join(unsure, "core", "left_semi"))
    return full.unionByName(shared_strings(contexts))


def remove(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Texts are bytes in UTF-8, null is empty; what is left of a text may cut a character.  Rows
    that repeat an id or have none are documents of their own, so repeated rows repeat each
    other.  Texts shorter than LONG stay whole.  Ties cannot arise: every occurrence goes.  An
    empty table gives an empty result; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, names = zstandard.ZstdDecompressor(), [c.split()[0] for c in RESULT.split(", ")]
        for batch in in_pieces(batches, 500):
            out = []
            for name, packed, first, last in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "packed", "first", "last"))
            ):
                raw = press.decompress(packed)
                steps = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(steps, np.array(first or [], dtype=np.int64), 1)
                np.add.at(steps, np.array(last or [], dtype=np.int64) + LONG, -1)
                gone = np.cumsum(steps)[:-1] > 0
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() if first else raw
                out.append((name, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
            types = [pa.int64()] * 4 + [pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = _named(docs)
    spans = repeats(rows, batches).groupBy("row").agg(
        F.collect_list("first").alias("first"), F.collect_list("last").alias("last")
    )
    return _packed(rows).join(spans, "row", "left").mapInArrow(cut, RESULT)
