"""Packing token pieces into sequences by minimum bin slack.

Pieces are alike when they are equally long, so the plan needs only how many pieces there
are of each length, at most as many numbers as a sequence has tokens.  A bin pattern holds
the longest length left plus the fullest combination of the others that still fits, found
by subset sums on a bitset.  A pattern is used as often as its lengths last, and is then
removed; so there are few patterns, whatever the number of pieces.  Each piece finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.llm.shared import in_pieces, staged, texts_of
from ledgerwake.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long,"
    " part int, rank_in_part long"
)


def pieces_of(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of every document, staged: its ids and the end id, cut at `capacity`.

    Null text is empty and gives one piece with the end id alone.  `part` is the task that
    made the piece, `rank_in_part` counts the task's pieces of that length.  With `keep_ids`
    the ids come along as little-endian unsigned 32-bit integers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        tokenizer = encoder(vocabulary)
        for batch in in_pieces(batches, 500):
            names = batch.column("doc_id").to_pylist()
            rows = []
            for name, ids in zip(names, tokenizer.encode(texts_of(batch))):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    size = len(own) // 4
                    rows.append((name, n, at // 4, size, zlib.crc32(own), part, seen[size], own))
                    seen[size] += 1
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            named = PIECES.replace(",", "").split()[::2]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            if keep_ids:
                arrays.append(pa.array(columns[7], pa.binary()))
                named = [*named, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=named)

    schema = PIECES + (", ids binary" if keep_ids else "")
    return staged(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces")


@dataclass
class Pattern:
    """A bin's lengths, longest first, each with how often it occurs, and how many such bins."""

    lengths: list[tuple[int, int]]
    bins: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that together use up every piece."""
    left = {length: n for length, n in counts.items() if n}
    patterns = []
    while left:
        longest = max(left)
        pattern = {longest: 1}
        for length, times in _fullest(left, longest, capacity - longest):
            pattern[length] = pattern.get(length, 0) + times
        bins = min(left[length] // times for length, times in pattern.items())
        for length, times in pattern.items():
            left[length] -= times * bins
            if not left[length]:
                del left[length]
        patterns.append(Pattern(sorted(pattern.items(), reverse=True), bins))
    return patterns


def _fullest(left: dict[int, int], longest: int, room: int) -> list[tuple[int, int]]:
    """Lengths and multiplicities with the largest sum of at most `room`, long ones first.

    Bit s of the bitset is set when some of the pieces looked at sum to s.  Multiples are
    added in powers of two, and the bitset before each is kept to read the choice back.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        most = min(left[length] - (length == longest), room // length)
        times = 1
        while most > 0 and not reach >> room & 1:
            times = min(times, most)
            steps.append((length, times, reach))
            reach = (reach | reach << length * times) & mask
            most -= times
            times *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            chosen.append((length, times))
            at -= length * times
    return chosen


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset.

    `pieces` has length (1 to `capacity`), part and rank_in_part, numbering the pieces of a
    length within a part from 0.  An empty table gives an empty result; equal pieces are
    further pieces; other columns are kept.
    """
    counts = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    ranked = pieces.join(before, ["part", "length"]).withColumn(
        "_rank", F.col("_before") + F.col("rank_in_part")
    )
    slots, kept = _slots(plan(lengths, capacity)), pieces.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                own = length == one
                first, times, bins, base = slots[int(one)]
                n = np.searchsorted(first, rank[own], side="right") - 1
                within = rank[own] - first[n]
                sequence[own] = bins[n] + within // times[n]
                offset[own] = base[n] + within % times[n] * one
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes)
    return ranked.select(*kept, "_rank").mapInArrow(
        put, f"{fields}, sequence_id long, offset long"
    )


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, multiplicity, first bin and offset, one per pattern."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins = 0
    for pattern in patterns:
        offset = 0
        for length, times in pattern.lengths:
            found.setdefault(length, []).append((used.get(length, 0), times, bins, offset))
            used[length] = used.get(length, 0) + times * pattern.bins
            offset += length * times
        bins += pattern.bins
    return {k: tuple(np.array(v, dtype=np.int64).T) for k, v in found.items()}


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, n_tokens: the packed sequences, from placed pieces with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(
        parts, F.lit(b"").cast("binary"), lambda made, one: F.concat(made, one["ids"])
    )
    return placed.groupBy("sequence_id").agg(joined.alias("ids")).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long")
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    placed = place(pieces_of(docs, vocabulary, capacity), capacity)
    return placed.drop("part", "rank_in_part")
