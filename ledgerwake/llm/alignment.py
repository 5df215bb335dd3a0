"""Two tokenizers laid over the same bytes: groups, links, and how common each link is.

Tokens of both sides are intervals of bytes.  All of a batch are sorted by start, and the
running maximum of their ends tells where one group of intervals stops and the next begins: a
start that reaches it opens a group.  Within its group every token meets those it overlaps;
the pairs that also end together are links.

A byte-level vocabulary (A) encodes a space and the text, a piece model (B) the text, to which
it adds the space itself.  Strings of special tokens are plain text to both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.llm.shared import in_pieces, kept, staged
from ledgerwake.llm.tokens import encoder, token_bytes

# Id pairs whose counts are sent to every task, 12 bytes each; more of them are joined instead.
SENT = 2_000_000
# Distinct pairs that a task holds before it passes their counts on.
HELD = 1_000_000
# Documents of one step.
AT_ONCE = 200

LAID = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long,"
    " groups_sha256 string, pairs binary, times binary"
)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def piece_bytes(model) -> list[bytes]:
    """The bytes that each id of a piece model stands for."""
    out = []
    for n in range(model.get_piece_size()):
        piece = model.id_to_piece(n)
        byte = _BYTE.fullmatch(piece)
        out.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return out


class Spelling:
    """What each of a list of codes stands for, joined for many codes at once."""

    def __init__(self, known: list[bytes]):
        self.flat = np.frombuffer(b"".join(known), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in known], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[codes]
        shift = self.starts[codes] - (np.cumsum(sizes) - sizes)
        return self.flat[np.arange(sizes.sum()) + np.repeat(shift, sizes)]


class Pair:
    """Both tokenizers with what their ids stand for."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor

        self.a = encoder(byte_vocabulary, special_as_text=True)
        self.b = SentencePieceProcessor(model_file=piece_model)
        known_a, known_b = token_bytes(byte_vocabulary), piece_bytes(self.b)
        self.size_b = len(known_b)
        self.spell_a, self.spell_b = Spelling(known_a), Spelling(known_b)
        # Decimal ids with what may follow them: an id of the same side, the other side, a group.
        most = max(len(known_a), len(known_b))
        self.written = Spelling([f"{n}{after}".encode() for n in range(most) for after in ",|;"])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none where one side's bytes are not those of space and text."""
        side_a = self.a.encode([" " + t for t in texts])
        side_b = self.b.encode(texts, out_type=int, num_threads=1)
        out, none = [], np.zeros(0, dtype=np.int64)
        for text, raw, found in zip(texts, side_a, side_b):
            ids_a = np.frombuffer(raw, dtype="<u4").astype(np.int64)
            ids_b = np.array(found, dtype=np.int64)
            whole = np.frombuffer(b" " + text.encode(), dtype=np.uint8)
            sides = ((self.spell_a, ids_a), (self.spell_b, ids_b))
            same = bool(text) and all(np.array_equal(s.joined(ids), whole) for s, ids in sides)
            out.append((ids_a, ids_b) if same else (none, none))
        return out


@dataclass
class Laid:
    """Groups and overlaps of tokens; the token counts of each side are those of its group array."""

    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int
    # Overlapping pairs as positions of their tokens, and whether they end together.
    left: np.ndarray
    right: np.ndarray
    together: np.ndarray


def lay(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Laid:
    """Coalesces the intervals of two sides that cover the same bytes, token after token."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    starts_a, starts_b = ends_a - sizes_a, ends_b - sizes_b
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(sizes_a), len(sizes_b)])
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    opens = np.zeros(len(order), dtype=np.int64)
    opens[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(opens)
    first = np.searchsorted(ends_b, starts_a, "right")
    many = np.searchsorted(starts_b, ends_a, "left") - first
    left = np.repeat(np.arange(len(sizes_a)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return Laid(
        group[: len(sizes_a)],
        group[len(sizes_a) :],
        int(opens.sum()) + 1 if len(order) else 0,
        left,
        right,
        ends_a[left] == ends_b[right],
    )


def _order_written(ids_a, ids_b, laid: Laid) -> np.ndarray:
    """All ids group by group and A before B, as codes of the id and what follows it."""
    in_a = np.bincount(laid.group_a, minlength=laid.n_groups)
    in_b = np.bincount(laid.group_b, minlength=laid.n_groups)
    before = np.cumsum(in_a + in_b) - in_a - in_b
    codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    at_a = np.arange(len(ids_a)) - (np.cumsum(in_a) - in_a)[laid.group_a] + before[laid.group_a]
    at_b = np.arange(len(ids_b)) - (np.cumsum(in_b) - in_b)[laid.group_b]
    at_b += (before + in_a)[laid.group_b]
    codes[at_a], codes[at_b] = ids_a * 3, ids_b * 3
    codes[before + in_a - 1] += 1
    codes[before + in_a + in_b - 1] += 2
    return codes


def _laid_rows(pair: Pair, rows: list, ids: list, texts: list[str]) -> pa.RecordBatch:
    encoded = pair.encode(texts)
    ids_a = np.concatenate([a for a, _ in encoded])
    ids_b = np.concatenate([b for _, b in encoded])
    n_a = np.array([len(a) for a, _ in encoded])
    n_b = np.array([len(b) for _, b in encoded])
    laid = lay(pair.spell_a.sizes[ids_a], pair.spell_b.sizes[ids_b])
    n = len(encoded)
    doc_a = np.repeat(np.arange(n), n_a)
    # A document's last A token is in its last group, as both sides cover all its bytes.
    upto = np.zeros(n, dtype=np.int64)
    upto[n_a > 0] = laid.group_a[np.cumsum(n_a)[n_a > 0] - 1] + 1
    upto = np.maximum.accumulate(upto)
    n_groups = np.diff(upto, prepend=0)
    doc_of_overlap = doc_a[laid.left]
    left, right = laid.left[laid.together], laid.right[laid.together]
    doc_of_link = doc_a[left]
    code = ids_a[left] * pair.size_b + ids_b[right]
    distinct, times = np.unique(doc_of_link << 32 | code, return_counts=True)
    bounds = np.searchsorted(distinct, np.arange(n + 1) << 32)
    distinct = (distinct & 0xFFFFFFFF).astype("<u4")
    codes = _order_written(ids_a, ids_b, laid)
    said = pair.written.joined(codes)
    upto = np.concatenate([[0], np.cumsum(pair.written.sizes[codes])])
    ends = upto[np.cumsum(n_a + n_b)].tolist()
    digests = [  # the last id has nothing after it
        hashlib.sha256(said[a : b - 1]).hexdigest() if b > a else "" for a, b in zip([0, *ends], ends)
    ]
    spans = list(zip(bounds.tolist(), bounds[1:].tolist()))
    columns = [
        pa.array(rows, pa.int64()),
        pa.array(ids, pa.int64()),
        pa.array(n_a),
        pa.array(n_b),
        pa.array(n_groups),
        pa.array(np.bincount(doc_of_link, minlength=n)),
        pa.array(np.bincount(doc_of_overlap, minlength=n)),
        pa.array(digests, pa.string()),
        pa.array([distinct[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([times[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LAID.split(", ")])


def lay_documents(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """Per document its groups and its distinct links with how often it has them, staged.

    `pairs` holds a link's ids as one unsigned 32-bit number, A times the size of B's
    vocabulary plus B; `row` tells rows apart, whatever their ids.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("alignment", byte_vocabulary, piece_model)
        pair = kept(key, lambda: Pair(byte_vocabulary, piece_model))
        for batch in in_pieces(batches, AT_ONCE):
            rows, ids, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            yield _laid_rows(pair, rows, ids, [t or "" for t in texts])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return staged(rows.mapInArrow(measure, LAID), "alignment")


def link_counts(laid: DataFrame, size_b: int) -> DataFrame:
    """pair, n, best: links of the corpus by id pair, and whether no pair of its B id has more.

    Each task sums what it holds before anything is shuffled.  Staged.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def added(codes, sums, batch):
            more = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4") for c in ("pairs", "times")]
            both, place = np.unique(np.concatenate([codes, more[0]]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([sums, more[1]]), len(both)).astype(np.int64)

        def rows(codes, sums):
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["pair", "n"])

        for batch in in_pieces(batches, 2000):
            codes, sums = added(codes, sums, batch)
            if len(codes) > HELD:
                yield rows(codes, sums)
                codes, sums = codes[:0], sums[:0]
        yield rows(codes, sums)

    counts = laid.select("pairs", "times").mapInArrow(total, "pair long, n long")
    counts = staged(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    by_b = counts.withColumn("b", F.col("pair") % size_b)
    most = by_b.groupBy("b").agg(F.max("n").alias("most"))
    return staged(
        by_b.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "links"
    )


def _by_sent_counts(laid: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum from counts that every task has."""
    table = counts.toArrow().sort_by("pair")
    known = tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))
    sent = laid.sparkSession.sparkContext.broadcast(known)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in in_pieces(batches, 2000):
            found = [np.frombuffer(p, dtype="<u4") for p in batch.column("pairs").to_pylist()]
            place = np.searchsorted(pairs, np.concatenate(found))
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<u4").astype(np.int64)
            ends = np.cumsum([0, *map(len, found)])

            def summed(values):
                upto = np.concatenate([[0], np.cumsum(values)])
                return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())

            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), summed(times * best[place]), summed(times * n[place])],
                names=["row", "n_best", "count_sum"],
            )

    return laid.select("row", "pairs", "times").mapInArrow(judge, "row long, n_best long, count_sum long")


def _by_join(laid: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from a join on the pair; adaptive execution splits common pairs."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 500):
            found = [np.frombuffer(p, dtype="<u4") for p in batch.column("pairs").to_pylist()]
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<u4")
            row = np.repeat(batch.column("row").to_numpy(), [len(f) for f in found])
            columns = [row, np.concatenate(found).astype(np.int64), times.astype(np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["row", "pair", "times"])

    rows = laid.select("row", "pairs", "times").mapInArrow(links, "row long, pair long, times long")
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    return rows.join(counts, "pair").groupBy("row").agg(
        F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, sent: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps of every row.

    A text that is null or empty, or that the tokens of either side do not spell out, has no
    tokens: zeros and an empty digest.  Rows that repeat an id, and rows without one, are
    documents of their own.  Of links equally common for a B id all are best.  An empty table gives
    an empty result; other columns are ignored.

    Counts of id pairs go to every task if there are at most `sent`; more are joined.
    """
    from sentencepiece import SentencePieceProcessor

    laid = lay_documents(docs, byte_vocabulary, piece_model)
    size_b = SentencePieceProcessor(model_file=piece_model).get_piece_size()
    counts = link_counts(laid, size_b)
    judged = (_by_sent_counts if counts.count() <= sent else _by_join)(laid, counts)
    zero = F.lit(0).cast("long")
    return laid.drop("pairs", "times").join(judged, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
        "n_overlaps",
    )
