"""Hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class).  The class softmax is a maximum-
entropy model over hashed features of the history: the last word, the two words before as
skip features, the last two words together, and the classes of both.  Within a class the same
features choose at each fork of a tree, whose leaves are frequent words and buckets of other
words.  A fork starts from the relative frequency of its sides (one is added to each count and
one kept in each bucket for unseen words); within a bucket that frequency is all.

The model consists of shards by the last word, each with tables of its own: words stand on a
line in the order of the trees, as long as they are frequent, and a shard has a part of it.  The
number of shards follows the bytes of all texts, so a task holds one shard's tokens and tables,
however large the input.  A word that fills more than a shard is dealt evenly to several.

Classes come from the company that words keep: a frequent word joins the most typical of a
few anchor words beside it, and stands in the tree with those that share its second; all other
words go to classes by their endings.

Frequent words, a bounded table, are known to every task.  All other words reach their counts
by a join, so every count is exact, however many words there are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.llm.shared import brief_shuffles, held_out, in_pieces, setting, staged, texts_of

END = b""  # the end token; no word is empty
# Size bound of the table of frequent words that every task knows.
FREQUENT = 200_000
ANCHORS, ENDINGS = 24, 8
CLASSES = ANCHORS + ENDINGS
# Least rows of hashed features, tokens of a gradient step, learning rate.
FEATURES, STEP, RATE = 1 << 13, 4096, 0.3
# Distinct training tokens that add a row of hashed features.
TOKENS_PER_ROW = 4
# Cells of hashed features of the forks for each such row, tokens of a step there, learning rate,
# and the sum of squares it starts from, which keeps cells met once from learning much.
CELLS_PER_ROW, FORK_STEP, FORK_RATE, FORK_DAMPING = 8, 2048, 0.1, 2.0
# Distinct words of a bucket, about.
IN_BUCKET = 64
SLICES = 64
# Numbers of the features before they are dealt to rows or cells.
WIDE = 1 << 40
# Words that a task counts before it hands them on.
COUNTED = 200_000
# Bytes of text of a shard, about, and the most distinct tokens that its feature tables are made for.
SHARD, IN_SHARD = 6_000_000, 250_000
# Tokens that a task sorts by shard at once, tokens of a shard that it unpacks at once, and rows
# that it takes in at once.
SORTED, UNPACKED, ROWS_AT_ONCE = 1_000_000, 1 << 16, 1000
LN10 = math.log(10)


def feature_rows(distinct: int) -> int:
    """Rows of hashed features: a power of two that grows with the distinct training tokens."""
    return max(FEATURES, 1 << (max(distinct, 1) // TOKENS_PER_ROW).bit_length())


def tokens_of(text: str) -> list[bytes]:
    """Words after lower-casing A-Z, then the end token."""
    return [*text.encode().lower().split(), END]


def count_tokens(training: DataFrame) -> DataFrame:
    """token, n: how often each token occurs, staged; counted within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["token", "n"],
            )

        for batch in in_pieces(batches, 500):
            for text in texts_of(batch):
                seen.update(tokens_of(text))
            if len(seen) > COUNTED:
                yield rows()
                seen.clear()
        yield rows()

    counted = training.select("text").mapInArrow(count, "token binary, n long")
    return staged(counted.groupBy("token").agg(F.sum("n").alias("n")), "tokens")


def frequent_tokens(counts: DataFrame, most: int = FREQUENT) -> tuple[dict[bytes, int], int]:
    """Tokens with at least the smallest count that no more than `most` tokens reach, and that count.

    The counts are summed up in ranges of size, of which there are a few hundred at most.
    """
    grade = F.floor(F.log2(F.col("n")) * 16)
    sizes = counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("tokens"))
    graded = sorted((r.grade, r.tokens) for r in sizes.collect())
    total, least = 0, math.inf
    for at, tokens in reversed(graded):
        if total + tokens > most:
            break
        total, least = total + tokens, at
    if least is math.inf:
        return {}, 2**62
    rows = counts.filter(grade >= least).select("token", "n").toArrow()
    found = dict(zip(*(rows.column(c).to_pylist() for c in ("token", "n"))))
    return found, min(found.values())


@dataclass
class Vocabulary:
    """What a task knows of words: the frequent ones with count, class and hash."""

    index: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    hashes: np.ndarray
    company: np.ndarray

    def look_up(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (-1 if not frequent), class and hash of each token."""
        get = self.index.get
        at = np.fromiter((get(t, -1) for t in tokens), dtype=np.int32, count=len(tokens))
        kinds, hashed = self.classes[at], self.hashes[at]
        for n in np.flatnonzero(at < 0).tolist():
            kinds[n] = ending_class(tokens[n])
            hashed[n] = zlib.crc32(tokens[n])
        return at, kinds, hashed


def ending_class(token: bytes) -> int:
    return ANCHORS + zlib.crc32(token[-2:]) % ENDINGS


def _sums(parts: DataFrame, kind: str) -> list[np.ndarray]:
    """Compressed arrays summed up by slice, slices in order; a task adds them one by one."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in in_pieces(batches, 50):
            for one, packed in zip(*(batch.column(c).to_pylist() for c in ("slice", "part"))):
                values = np.frombuffer(zlib.decompress(packed), dtype=kind)
                sums[one] = sums[one] + values if one in sums else values
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([v.tobytes() for v in sums.values()], pa.binary()),
            ],
            names=["slice", "part"],
        )

    rows = parts.repartition("slice").mapInArrow(total, "slice int, part binary").toArrow()
    return [np.frombuffer(part.as_buffer(), dtype=kind) for part in rows.sort_by("slice").column("part")]


def _slices(array: np.ndarray) -> pa.RecordBatch:
    parts = [zlib.compress(p.tobytes(), 1) for p in np.array_split(array, SLICES)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part"]
    )


def learn_classes(training: DataFrame, frequent: dict[bytes, int]) -> Vocabulary:
    """Classes of the frequent tokens, from how often each stands beside each anchor."""
    ranked = sorted(frequent.items(), key=lambda x: (-x[1], x[0]))
    index = {token: n for n, (token, _) in enumerate(ranked)}
    counts = np.array([n for _, n in ranked], dtype=np.int64)
    anchors = [n for n, (token, _) in enumerate(ranked) if token != END][:ANCHORS]
    column = np.full(len(ranked) + 1, -1, dtype=np.int32)  # the last is for words not known
    column[anchors] = np.arange(len(anchors))
    shared = training.sparkSession.sparkContext.broadcast((index, column))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, columns = shared.value
        met = np.zeros((len(places) + 1) * ANCHORS, dtype=np.int32)
        for batch in in_pieces(batches, 500):
            split = [tokens_of(text) for text in texts_of(batch)]
            tokens = [t for one in split for t in one]
            at = np.fromiter((places.get(t, -1) for t in tokens), dtype=np.int32, count=len(tokens))
            # A text's end and the next one's first word are no company.
            inside = np.ones(max(len(tokens) - 1, 0), dtype=bool)
            inside[np.cumsum([len(one) for one in split], dtype=np.int64)[:-1] - 1] = False
            left, right = at[:-1][inside], at[1:][inside]
            for left, right in ((left, right), (right, left)):
                side = columns[left]
                known = np.flatnonzero(side >= 0)
                # -1 falls into the last row
                np.add.at(met, right[known].astype(np.int64) * ANCHORS + side[known], np.int32(1))
        yield _slices(met)

    if ranked:
        parts = training.select("text").mapInArrow(beside, "slice int, part binary")
        met = np.concatenate(_sums(parts, "int32") or [np.zeros(0, dtype=np.int32)])
        shared.destroy()
        met = met.reshape(-1, ANCHORS)[: len(ranked)].astype(np.float64)
        typical = met / np.maximum(met.sum(axis=0), 1)
        classes = typical.argmax(axis=1)
        classes[anchors] = np.arange(len(anchors))
        typical[np.arange(len(ranked)), classes] = -1
        company = typical.argmax(axis=1)
        lonely = met.sum(axis=1) == 0
        lonely[anchors] = False
        for n in np.flatnonzero(lonely):
            classes[n] = ending_class(ranked[n][0])
    else:
        classes = company = np.zeros(0, dtype=np.int64)
    hashes = np.array([zlib.crc32(token) for token, _ in ranked], dtype=np.uint32)
    # A last entry stands for words that are not known; look_up fills it in.
    return Vocabulary(
        index,
        np.append(counts, 0),
        np.append(classes, 0).astype(np.int8),
        np.append(hashes, 0).astype(np.uint32),
        company.astype(np.int8),
    )


class Forks:
    """A tree within each class: halves of about equal mass, down to one word or bucket.

    Leaves stand in order of class, company and count, and a fork is named by the first place
    of its right side, which no other fork has.
    """

    def __init__(self, vocabulary: Vocabulary, buckets: np.ndarray):
        """`buckets`: tokens and distinct tokens, by ending class and bucket."""
        self.buckets = buckets.shape[2]
        # One is kept in each bucket for unseen words.
        mass = buckets.sum(axis=0).reshape(-1) + 1
        self.below = np.log10(mass)
        kinds = np.repeat(np.arange(ANCHORS, CLASSES), self.buckets)
        kinds = np.concatenate([vocabulary.classes[:-1], kinds])
        mass = np.concatenate([vocabulary.counts[:-1] + 1, mass])
        company = np.concatenate([vocabulary.company, np.full(len(self.below), ANCHORS)])
        order = np.lexsort((-mass, company, kinds))
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = at = np.arange(len(order))
        kinds, upto = kinds[order], np.concatenate([[0], np.cumsum(mass[order])])
        self.kinds, self.upto = kinds.astype(np.int8), upto
        low, high = np.searchsorted(kinds, kinds), np.searchsorted(kinds, kinds, "right")
        self.prior = np.zeros(len(order), dtype=np.float32)
        owners, nodes, sides = [], [], []
        while len(at):
            open_ = high - low > 1
            at, low, high = at[open_], low[open_], high[open_]
            middle = np.searchsorted(upto, (upto[low] + upto[high]) / 2)
            middle = np.clip(middle, low + 1, high - 1)
            left = upto[middle] - upto[low]
            self.prior[middle] = np.log((upto[high] - upto[middle]) / left)
            right = at >= middle
            owners.append(at)
            nodes.append(middle)
            sides.append(right)
            low, high = np.where(right, middle, low), np.where(right, high, middle)
        owner = np.concatenate([*owners, np.zeros(0, dtype=np.int64)])
        by_leaf = np.argsort(owner, kind="stable")
        self.nodes = np.concatenate([*nodes, np.zeros(0)])[by_leaf].astype(np.int32)
        self.sides = np.concatenate([*sides, np.zeros(0)])[by_leaf].astype(bool)
        self.depth = np.bincount(owner, minlength=len(order))
        self.start = np.cumsum(self.depth) - self.depth

    def leaves(self, at: np.ndarray, kinds: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The leaf of each token."""
        bucket = bucket_of(kinds, hashed, self.buckets)
        return self.place[np.where(at >= 0, at, bucket + len(self.place) - len(self.below))]

    def paths(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, fork and side of each step on the ways to the leaves."""
        depth = self.depth[leaves]
        owner = np.repeat(np.arange(len(leaves)), depth)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth)
        step += self.start[leaves][owner]
        return owner, self.nodes[step], self.sides[step]


def bucket_of(kinds: np.ndarray, hashed: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket of each token that is not frequent; of no use for others."""
    return (kinds.astype(np.int64) - ANCHORS) * buckets + hashed.astype(np.int64) % buckets


def fill_buckets(rare: DataFrame, vocabulary: Vocabulary, distinct: int) -> np.ndarray:
    """Tokens and distinct tokens in training by ending class and bucket."""
    buckets = 1 << (max(distinct, 1) // (ENDINGS * IN_BUCKET)).bit_length()
    words = rare.sparkSession.sparkContext.broadcast(vocabulary)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, ENDINGS * buckets), dtype=np.int64)
        for batch in batches:
            _, kinds, hashed = words.value.look_up(batch.column("token").to_pylist())
            at, n = bucket_of(kinds, hashed, buckets), batch.column("n").to_numpy()
            total[0] += np.bincount(at, n, minlength=total.shape[1]).astype(np.int64)
            total[1] += np.bincount(at, minlength=total.shape[1])
        met = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(total[0, met]), pa.array(total[1, met])],
            names=["bucket", "n", "tokens"],
        )

    out = np.zeros((2, ENDINGS * buckets), dtype=np.int64)
    filled = rare.mapInArrow(fill, "bucket long, n long, tokens long").groupBy("bucket")
    rows = filled.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).toArrow()
    words.destroy()
    out[:, rows.column("bucket").to_numpy()] = [rows.column(c).to_numpy() for c in ("n", "tokens")]
    return out.reshape(2, ENDINGS, buckets)


def contexts(
    kinds: np.ndarray, hashed: np.ndarray, first: np.ndarray
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes or numbers of the three words before each token and classes (from 1) of two; 0 where
    there are none, since a text starts where `first` is true."""
    n = len(kinds)
    since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    words = [np.where(since >= k, np.roll(hashed, k), 0).astype(np.uint32) for k in (1, 2, 3)]
    return words, [np.where(since >= k, np.roll(kinds, k) + 1, 0).astype(np.int8) for k in (1, 2)]


def features_of(words: list[np.ndarray], kinds: list[np.ndarray], rows: int) -> np.ndarray:
    """Features of histories as `contexts` gives them, five per token."""
    word, kind = ([x.astype(np.uint64) for x in xs] for xs in (words, kinds))
    raw = (
        word[0] * 5 + 1,
        word[1] * 5 + 2,
        word[2] * 5 + 3,
        (word[0] * np.uint64(0x9E3779B1) + word[1]) * 5 + 4,
        (kind[0] * np.uint64(CLASSES + 1) + kind[1]) * 5,
    )
    mixed = [(x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) for x in raw]
    return np.stack(mixed, axis=1).astype(np.int64) % rows


def histories(
    kinds: np.ndarray, hashed: np.ndarray, first: np.ndarray, rows: int = FEATURES
) -> np.ndarray:
    """Features of each token's history, five per token; `first` is true at a text's start."""
    return features_of(*contexts(kinds, hashed, first), rows)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys below 2^40, where each distinct one starts in it, and these."""
    bits = len(keys).bit_length()
    both = np.sort((keys << bits) | np.arange(len(keys)))
    order, keys = both & ((1 << bits) - 1), both >> bits
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return order, starts, keys[starts]


def _sums_of(table: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`np.add.reduceat(table[at], starts, axis=0)`, quick where most groups are small."""
    sizes = np.diff(starts, append=len(at))
    out = table[at[starts]]
    few = np.flatnonzero((sizes > 1) & (sizes <= 8))
    few = few[np.argsort(-sizes[few], kind="stable")]
    if len(few):
        rest = table[at[starts[few] + 1]]
        for k in range(2, 8):
            more = few[: np.searchsorted(-sizes[few], -k)]
            rest[: len(more)] += table[at[starts[more] + k]]
        out[few] += rest
    many = sizes > 8
    if many.any():
        ends = np.cumsum(sizes[many])
        out[many] = np.add.reduceat(table[at[np.repeat(many, sizes)]], ends - sizes[many], axis=0)
    return out


class Softmax:
    """Class probabilities and gradient steps on arrays that are made once per shard."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.scores, self.picked = (np.empty((STEP, CLASSES), dtype=np.float32) for _ in range(2))
        self.squares = np.full(len(weights), 1e-6, dtype=np.float32)

    def logs(self, features: np.ndarray) -> np.ndarray:
        """Natural logs of the class probabilities, a row per token; the next call overwrites them."""
        return self._logs(self.weights, features)

    def _logs(self, weights: np.ndarray, features: np.ndarray) -> np.ndarray:
        n = len(features)
        scores, picked = self.scores[:n], self.picked[:n]
        np.take(weights, features[:, 0], axis=0, out=scores, mode="clip")
        for k in range(1, features.shape[1]):
            np.take(weights, features[:, k], axis=0, out=picked, mode="clip")
            scores += picked
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=picked)
        scores -= np.log(picked.sum(axis=1, keepdims=True))
        return scores

    def step(self, features: np.ndarray, kinds: np.ndarray) -> None:
        """One Adagrad step on up to STEP tokens; each feature has its own rate."""
        n = len(kinds)
        # The rows met are read and written once each, in their order in memory.
        order, starts, rows = _grouped(features.reshape(-1))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(rows)), np.diff(starts, append=len(order)))
        weights = self.weights[rows]
        slope = np.exp(self._logs(weights, place.reshape(features.shape)), out=self.picked[:n])
        slope[np.arange(n), kinds] -= 1
        slope /= n
        change = _sums_of(slope, order // features.shape[1], starts)
        squares = self.squares[rows] + np.einsum("ij,ij->i", change, change) / CLASSES
        change *= (RATE / np.sqrt(squares))[:, None]
        weights -= change
        self.weights[rows], self.squares[rows] = weights, squares


class Choices:
    """Probabilities of the ways through the trees, and gradient steps."""

    def __init__(self, forks: Forks, weights: np.ndarray):
        self.forks, self.weights = forks, weights
        self.squares = np.full(len(weights), FORK_DAMPING, dtype=np.float32)
        self.shift = np.uint64(65 - len(weights).bit_length())  # leaves the number of a cell

    def _steps(self, features: np.ndarray, leaves: np.ndarray):
        """Owner, side, cells by feature and prior score of each step on the ways to the leaves."""
        owner, nodes, right = self.forks.paths(leaves)
        mixed = features.T.astype(np.uint64, order="C") * np.uint64(0x9E3779B97F4A7C15)
        cells = np.take(mixed, owner, axis=1)
        cells += nodes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        cells >>= self.shift
        return owner, right, cells.view(np.int64), self.forks.prior[nodes]

    def logs(self, features: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Natural log of each leaf's probability within its class."""
        owner, right, cells, score = self._steps(features, leaves)
        for one in cells:
            score += np.take(self.weights, one, mode="clip")
        np.negative(score, out=score, where=right)
        logs = -(np.maximum(score, 0) + np.log1p(np.exp(-np.abs(score))))
        return np.bincount(owner, logs, minlength=len(leaves))

    def step(self, features: np.ndarray, leaves: np.ndarray) -> None:
        """One Adagrad step; each cell has its own rate."""
        _, right, cells, score = self._steps(features, leaves)
        for one in cells:
            score += self.weights[one]
        slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - right).astype(np.float32)
        square = slope * slope
        for one in cells:
            np.add.at(self.squares, one, square)
        slope *= FORK_RATE
        for one in cells:
            np.subtract.at(self.weights, one, slope / np.sqrt(self.squares[one]))


def _batch_tokens(vocabulary: Vocabulary, texts: list[str]):
    split = [tokens_of(t) for t in texts]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    tokens = [t for s in split for t in s]
    at, kinds, hashed = vocabulary.look_up(tokens)
    first = np.zeros(len(tokens), dtype=bool)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    first[starts] = True
    return tokens, lengths, starts, first, at, kinds, hashed


def in_bytes(change: np.ndarray) -> bytes:
    """Rows of changes, a byte each: roots of the shares of the greatest of the row, in 127ths.

    Rows of one cell share their greatest.  Roots keep small changes apart.
    """
    top = np.abs(change).max(axis=1 if change.shape[1] > 1 else None, keepdims=True)
    share = np.sqrt(np.abs(change) / np.maximum(top, 1e-30))
    packed = np.rint(np.copysign(share, change) * 127).astype(np.int8)
    return top.astype(np.float32).tobytes() + packed.tobytes()


def from_bytes(packed: bytes, width: int) -> np.ndarray:
    """The changes of `in_bytes`, to about a hundredth."""
    rows = len(packed) // (width + 4) if width > 1 else len(packed) - 4
    tops = rows if width > 1 else 1
    top = np.frombuffer(packed, dtype=np.float32, count=tops).reshape(-1, 1)
    share = np.frombuffer(packed, dtype=np.int8, offset=4 * tops).reshape(rows, width) / np.float32(127)
    return share * np.abs(share) * top


def _forgotten(shared: list[Broadcast]) -> None:
    """Lets go of broadcasts that no later task reads, on the driver too."""
    for one in shared:
        one.destroy()


SENT = "batch long, shard int, part binary"
SCORED = (
    "row long, doc_id long, n_tokens long, n_frequent long, logs double, model double,"
    " rare array<binary>, times array<long>"
)


def shards_of(docs: DataFrame) -> int:
    """Shards that the tokens of all texts are dealt to; an empty text counts as a byte."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return 1 + docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // SHARD


def shard_of(forks: Forks, leaves: np.ndarray, places: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each token by the leaf of its last word.

    A leaf that fills more than a shard is dealt to several by the tokens' places in the texts.
    """
    low, mass = forks.upto[leaves], forks.upto[leaves + 1] - forks.upto[leaves]
    line = int(forks.upto[-1])
    share = (places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / 2.0**53
    place = low + np.where(mass * shards > line, mass * share, 0)
    return np.minimum((place / line * shards).astype(np.int64), shards - 1)


def _packed(**columns) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["batch", "shard", "part"]
    )


def _dealt(docs: DataFrame, words: Broadcast, trees: Broadcast, shards: int) -> DataFrame:
    """Tokens with their contexts by shard, and what a task knows of their texts as shard -1.

    `logs` is the sum of log10(count + 1) over frequent tokens; `model` is that of what the trees
    have below a leaf, and gets the rest from the shards.  `docs`: doc_id, text, learn.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, forks = words.value, trees.value
        known = np.log10(vocabulary.counts + 1.0)
        start = row = TaskContext.get().partitionId() << 33
        held: list[dict[str, np.ndarray]] = []

        def by_shard() -> pa.RecordBatch:
            columns = {name: np.concatenate([one[name] for one in held]) for name in held[0]}
            order = np.argsort(columns["shard"], kind="stable")
            columns = {name: column[order] for name, column in columns.items()}
            shard = columns.pop("shard")
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            return _sent(
                [
                    (start, int(shard[a]), _packed(**{name: c[a:b] for name, c in columns.items()}))
                    for a, b in zip(cuts, cuts[1:])
                ]
            )

        for batch in in_pieces(batches, 200):
            if not batch.num_rows:
                continue
            tokens, lengths, starts, first, at, kinds, hashed = _batch_tokens(vocabulary, texts_of(batch))
            leaves = forks.leaves(at, kinds, hashed)
            # Numbers of frequent words are small and so take less room than hashes.
            numbers = np.where(at >= 0, leaves + 1, hashed >> 1 | 1 << 31)
            (a, b, c), (d, e) = contexts(kinds, numbers, first)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            places = (row + owner << 20) + np.arange(len(owner)) - starts[owner]
            # What stands before a text's first token is the end of another one.
            shard = shard_of(forks, np.roll(leaves, 1), places, shards)
            learn = np.array(batch.column("learn").to_pylist(), dtype=np.int8)
            held.append(
                {
                    "shard": shard.astype(np.uint16 if shards < 1 << 16 else np.int32),
                    "leaf": leaves.astype(np.int32),
                    **{"word1": a, "word2": b, "word3": c, "kind1": d, "kind2": e},
                    "owner": (owner + (row - start)).astype(np.int32),
                    "learn": learn[owner],
                }
            )
            frequent = at >= 0
            below = forks.below[bucket_of(kinds, hashed, forks.buckets) * ~frequent]
            rare = [Counter() for _ in lengths]
            for n in np.flatnonzero(~frequent).tolist():
                rare[owner[n]][tokens[n]] += 1
            texts = _packed(
                row=row + np.arange(len(lengths)),
                doc_id=batch.column("doc_id"),
                n_tokens=lengths,
                n_frequent=np.add.reduceat(frequent.astype(np.int64), starts),
                logs=np.add.reduceat(np.where(frequent, known[at], 0.0), starts),
                model=-np.add.reduceat(np.where(frequent, known[at], below), starts),
                rare=pa.array([list(c) for c in rare], pa.list_(pa.binary())),
                times=pa.array([list(c.values()) for c in rare], pa.list_(pa.int64())),
            )
            yield _sent([(start, -1, texts)])
            row += len(lengths)
            if sum(len(one["leaf"]) for one in held) > SORTED:
                yield by_shard()
                held.clear()
                start = row
        if held:
            yield by_shard()

    dealt = docs.mapInArrow(deal, SENT)
    to = F.when(F.col("shard") < 0, F.pmod(F.hash("batch"), F.lit(shards))).otherwise(F.col("shard"))
    return dealt.repartitionById(shards, to.cast("int"))


def _unpacked(parts: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
    """Batches and sizes of some parts at a time, the columns of their tokens, and features."""
    some: list[tuple[int, pa.RecordBatch]] = []
    for n, (batch, _, part) in enumerate(parts, 1):
        some.append((batch, pa.ipc.open_stream(part).read_next_batch()))
        if n == len(parts) or sum(x.num_rows for _, x in some) >= UNPACKED:
            table = pa.Table.from_batches([x for _, x in some])
            tokens = {name: table.column(name).to_numpy() for name in table.column_names}
            before = [tokens[f"word{k}"] for k in (1, 2, 3)], [tokens[f"kind{k}"] for k in (1, 2)]
            yield [(one, x.num_rows) for one, x in some], tokens, features_of(*before, WIDE)
            some.clear()


def _learnt(dealt: DataFrame, trees: Broadcast, rows: int) -> DataFrame:
    """What each shard adds to the logs of each text; rows of shard -1 are handed on.

    A task has one shard.  It takes gradient steps (Adagrad) over the tokens to learn from, in
    the order of the texts, and then gives all tokens their logs.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, bytes]] = []
        for batch in in_pieces(batches, 50):
            for part in zip(*(batch.column(c).to_pylist() for c in ("batch", "shard", "part"))):
                if part[1] < 0:
                    yield _sent([part])
                else:
                    parts.append(part)
        if not parts:
            return
        forks = trees.value
        softmax = Softmax(np.zeros((rows, CLASSES), dtype=np.float32))
        choices = Choices(forks, np.zeros(rows * CELLS_PER_ROW, dtype=np.float32))
        parts.sort()
        unpacked = list(_unpacked(parts))
        del parts[1:]
        for _, tokens, features in unpacked:
            chosen = np.flatnonzero(tokens["learn"])
            features, leaves = features[chosen], tokens["leaf"][chosen]
            for n in range(0, len(leaves), STEP):
                softmax.step(features[n : n + STEP] % rows, forks.kinds[leaves[n : n + STEP]])
            for n in range(0, len(leaves), FORK_STEP):
                choices.step(features[n : n + FORK_STEP], leaves[n : n + FORK_STEP])
        for sizes, tokens, features in unpacked:
            leaves, logs = tokens["leaf"], np.zeros(len(features))
            for n in range(0, len(logs), STEP):
                part = slice(n, n + STEP)
                found = softmax.logs(features[part] % rows)
                within = choices.logs(features[part], leaves[part])
                logs[part] = (found[np.arange(len(found)), forks.kinds[leaves[part]]] + within) / LN10
            sums, at = [], 0
            for batch, size in sizes:
                owner = tokens["owner"][at : at + size]
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                packed = _packed(owner=owner[starts], logs=np.add.reduceat(logs[at : at + size], starts))
                sums.append((batch, parts[0][1], packed))
                at += size
            yield _sent(sums)

    return dealt.mapInArrow(learn, SENT)


def _summed(learnt: DataFrame) -> DataFrame:
    """A row per text with its logs of all shards, staged."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[pa.RecordBatch] = []
        at, logs = None, np.zeros(0)

        def rows() -> Iterator[pa.RecordBatch]:
            first = 0
            for one in texts:
                model = one.column("model").to_numpy() + logs[first : first + one.num_rows]
                first += one.num_rows
                yield one.set_column(one.schema.get_field_index("model"), "model", pa.array(model))

        for received in in_pieces(batches, 50):
            for batch, shard, part in zip(*(received.column(c).to_pylist() for c in ("batch", "shard", "part"))):
                if batch != at:
                    yield from rows()
                    texts.clear()
                    at, logs = batch, np.zeros(0)
                one = pa.ipc.open_stream(part).read_next_batch()
                if shard < 0:
                    texts.append(one)
                    continue
                if not len(logs):
                    texts.sort(key=lambda x: x.column("row")[0].as_py())
                    logs = np.zeros(sum(x.num_rows for x in texts))
                logs[one.column("owner").to_numpy()] += one.column("logs").to_numpy()
        yield from rows()

    summed = learnt.repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(total, SCORED)
    return staged(summed, "scored")


def _forgotten(shared: list[Broadcast]) -> None:
    """Lets go of broadcasts that no later task reads, on the driver too."""
    for one in shared:
        one.destroy()


def score(docs: DataFrame, parts: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null text is empty: its only token is the end.  Repeated rows are each scored, and each
    counts in training.  Without training rows every count is 0.  An empty table gives an
    empty result; other columns are ignored.
    """
    out = held_out(F.col("doc_id"), parts)
    training = docs.select("doc_id", "text").filter(~out)
    spark, at_once = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    # The tokens' shuffle files go when they are scored.
    with brief_shuffles(spark), setting(spark, at_once, str(ROWS_AT_ONCE)):
        counts = count_tokens(training)
        total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        frequent, least = frequent_tokens(counts)
        vocabulary = learn_classes(training, frequent)
        rare = counts.filter(F.col("n") < least)
        forks = Forks(vocabulary, fill_buckets(rare, vocabulary, distinct - len(frequent)))
        words, trees = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(forks)
        del frequent, vocabulary, forks
        rows = feature_rows(min(distinct, IN_SHARD))
        dealt = _dealt(docs.select("doc_id", "text", (~out).alias("learn")), words, trees, shards_of(docs))
        scored = _summed(_learnt(dealt, trees, rows))
        _forgotten([words, trees])
    met = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    met = met.select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    found = (
        met.join(rare, "token")
        .groupBy("row")
        .agg(
            F.sum("times").alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"),
        )
    )
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), parts).alias("held_out"),
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
