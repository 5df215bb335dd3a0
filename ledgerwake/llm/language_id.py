"""Language of documents by a linear-chain conditional random field over their words.

A word's score for a label is the sum of the weights of its features: the word, its prefixes
and suffixes, character n-grams, and whether it is a frequent word of a label (lexicon).
Learned transitions join the labels of neighbouring words, and forward-backward gives each
word's label probabilities, so a text may switch languages.  A document's language is the
label with the largest mean probability over all of its words.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.llm.shared import held_out, in_pieces, kept, staged, texts_of

# The training sample: at most so many labelled documents of each language.
DOCUMENTS_PER_LANGUAGE = 150
SEED, EPOCHS, RATE = 11, 4, 0.3
FEATURES = 1 << 15
LEXICON = 300
# Lengths of the runs that are spliced into code-switched training sequences.
RUN, SEQUENCE, BATCH = (4, 40), 64, 64
# Words whose scores a worker remembers, and words that one forward-backward takes.
MEMO, AT_ONCE = 200_000, 100_000
# Words whose features are hashed at once.
HASHED = 20_000
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; empty if the text has no letter."""
    found = _WORDS.findall(text.lower())
    return [w for w in found if any(map(str.isalpha, w))] if not text.isascii() else found


def features_of(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Hashed features of a word."""
    edged = f"^{word}$"
    names = [f"w{word}"]
    names += [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    names += [edged[i : i + n] for n in (2, 3) for i in range(len(edged) - n + 1)]
    names += [f"l{label}" for label in lexicon.get(word, ())]
    return [zlib.crc32(name.encode()) % FEATURES for name in names]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crc_on(state: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """CRC-32 states, not inverted at the end, after one more code point each in UTF-8."""

    def fed(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _CRC[(state ^ byte) & 255] ^ (state >> 8)

    if not len(chars) or chars.max() < 0x80:
        return fed(state, chars)
    bounds = [chars < 0x80, chars < 0x800, chars < 0x10000]
    lead = np.select(bounds, [chars, 0xC0 | chars >> 6, 0xE0 | chars >> 12], 0xF0 | chars >> 18)
    state = fed(state, lead)
    for short, shift in zip(reversed(bounds), (12, 6, 0)):
        at = np.flatnonzero(~short)
        state[at] = fed(state[at], 0x80 | chars[at] >> shift & 63)
    return state


def feature_table(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """`features_of` each word, one after another, and how many each has."""
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    listed = [(n, lexicon[w]) for n, w in enumerate(words) if w in lexicon]
    sizes = 8 + 2 * length
    for n, labels in listed:
        sizes[n] += len(labels)
    at = np.cumsum(sizes) - sizes
    found = np.empty(int(sizes.sum()), dtype=np.uint32)
    whole = zlib.crc32(b"w")
    found[at] = np.fromiter((zlib.crc32(w.encode(), whole) for w in words), np.uint32, len(words))
    first = np.cumsum(length + 2) - length - 1
    last = first + length - 1
    start, end = (np.full(len(words), ~np.uint32(zlib.crc32(x))) for x in (b"p", b"s"))
    for n in (1, 2, 3):
        more = np.flatnonzero(length >= n)
        start[more] = _crc_on(start[more], chars[first[more] + n - 1])
        found[at + n] = ~start
        tail = end[more]
        for k in range(n - 1, -1, -1):
            tail = _crc_on(tail, chars[last[more] - k])
        found[at + 3 + n] = found[at + 2 + n] if n > 1 else 0
        found[at[more] + 3 + n] = ~tail
    # Runs of two and three, from each place but the last ones of a word.
    two = _crc_on(_crc_on(np.full(len(chars), ~np.uint32(0)), chars)[:-1], chars[1:])
    three = _crc_on(two[:-1], chars[2:])
    owner = np.repeat(np.arange(len(words)), length + 2)
    place = np.arange(len(chars)) - first[owner] + 1
    inside = np.flatnonzero(place <= length[owner])
    found[at[owner[inside]] + 7 + place[inside]] = ~two[inside]
    inside = np.flatnonzero(place < length[owner])
    found[(at + 8 + length)[owner[inside]] + place[inside]] = ~three[inside]
    for n, labels in listed:
        stop = at[n] + sizes[n]
        found[stop - len(labels) : stop] = [zlib.crc32(f"l{label}".encode()) for label in labels]
    return (found % FEATURES).astype(np.int32), sizes


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label to label
    starts: np.ndarray
    lexicon: dict[str, list[int]]

    def scores(self, words: list[str]) -> np.ndarray:
        out = []
        for n in range(0, len(words), HASHED):
            flat, sizes = feature_table(words[n : n + HASHED], self.lexicon)
            out.append(np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0))
        return np.concatenate(out)


def posteriors(
    scores: np.ndarray,
    lengths: np.ndarray,
    moves: np.ndarray,
    starts: np.ndarray,
    expect: bool = True,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of every word by forward-backward, expected moves and start labels.

    `scores` holds the sequences one after another; `lengths` must not increase and be at
    least 1.  A step advances all sequences that are still long enough.  Only training needs
    the expected moves; they are zero unless `expect`.
    """
    steps, labels = int(lengths[0]), len(starts)
    starts_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    jump = np.exp(moves - moves.max())
    forward, backward = np.empty_like(shifted), np.ones_like(shifted)
    now = shifted[starts_at] * np.exp(starts - starts.max())
    now /= now.sum(axis=1, keepdims=True)
    forward[starts_at] = now
    for t in range(1, steps):
        at = starts_at[: active[t]] + t
        now = (now[: active[t]] @ jump) * shifted[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    expected = np.zeros((labels, labels))
    for t in range(steps - 1, 0, -1):
        at = starts_at[: active[t]] + t
        after = backward[at] * shifted[at]
        if expect:
            pair = forward[at - 1][:, :, None] * jump * after[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        before = after @ jump.T
        backward[at - 1] = before / before.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    return both, expected, both[starts_at].sum(axis=0)


def train(texts: list[str], labels: list[str]) -> Model:
    """Gradient ascent (Adagrad) on the likelihood of spliced sequences with known labels."""
    rng = np.random.default_rng(SEED)
    names = sorted(set(labels))
    own = [names.index(label) for label in labels]
    documents = [words_of(t) for t in texts]
    counts = [Counter() for _ in names]
    for words, label in zip(documents, own):
        counts[label].update(words)
    lexicon: dict[str, list[int]] = {}
    for label, counter in enumerate(counts):
        for word, _ in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(word, []).append(label)
    size = len(names)
    model = Model(
        names, np.zeros((FEATURES, size)), np.zeros((size, size)), np.zeros(size), lexicon
    )
    vocabulary = sorted(set().union(*counts)) if counts else []
    index = {w: n for n, w in enumerate(vocabulary)}
    rows = [np.unique(features_of(w, lexicon)) for w in vocabulary]
    runs = []
    for words, label in zip(documents, own):
        ids, at = [index[w] for w in words], 0
        while at < len(ids):
            stop = at + int(rng.integers(*RUN))
            runs.append((ids[at:stop], label))
            at = stop
    squares = [np.full_like(x, 1e-6) for x in (model.weights, model.moves, model.starts)]
    for _ in range(EPOCHS if size > 1 else 0):
        for batch in _batches(runs, rng):
            words = np.concatenate([w for w, _ in batch])
            truth = np.concatenate([y for _, y in batch])
            lengths = np.array([len(w) for w, _ in batch])
            used, inverse = np.unique(words, return_inverse=True)
            sizes = np.array([len(rows[w]) for w in used])
            flat = np.concatenate([rows[w] for w in used])
            table = np.add.reduceat(
                model.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0
            )
            found, moves, starts = posteriors(table[inverse], lengths, model.moves, model.starts)
            miss = -found
            miss[np.arange(len(truth)), truth] += 1
            per_word = np.stack(
                [np.bincount(inverse, miss[:, k], minlength=len(used)) for k in range(size)], axis=1
            )
            spread = np.repeat(per_word, sizes, axis=0)
            slope = np.stack(
                [np.bincount(flat, spread[:, k], minlength=FEATURES) for k in range(size)], axis=1
            )
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            inside = np.ones(len(truth), dtype=bool)
            inside[first] = False
            seen = np.zeros((size, size))
            np.add.at(seen, (truth[np.flatnonzero(inside) - 1], truth[inside]), 1)
            begun = np.bincount(truth[first], minlength=size)
            slopes = (slope, seen - moves, begun - starts)
            for value, step, square in zip(
                (model.weights, model.moves, model.starts), slopes, squares
            ):
                square += step**2
                value += RATE * step / np.sqrt(square)
    model.weights = model.weights.astype(np.float32)
    return model


def _batches(runs: list, rng: np.random.Generator) -> Iterator[list]:
    """Batches of spliced sequences, longest first."""
    batch, words, truth = [], [], []
    for n in rng.permutation(len(runs)):
        ids, label = runs[n]
        words += ids
        truth += [label] * len(ids)
        if len(words) >= SEQUENCE:
            batch.append((np.array(words), np.array(truth)))
            words, truth = [], []
        if len(batch) == BATCH:
            yield sorted(batch, key=lambda x: -len(x[0]))
            batch = []
    if words:
        batch.append((np.array(words), np.array(truth)))
    if batch:
        yield sorted(batch, key=lambda x: -len(x[0]))


class _Labeller:
    """Document probabilities with remembered word scores."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.table = np.zeros((0, len(model.labels)), dtype=np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if fresh:
            size = len(self.index)
            self.index.update(zip(fresh, range(size, size + len(fresh))))
            self.table = np.concatenate([self.table[:size], self.model.scores(fresh)])
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int32, count=len(words))

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row per text, the mean over its words; all zero where the text has no letter."""
        return self._summed(texts, len(self.model.labels), lambda found: found)

    def certainty(self, texts: list[str]) -> np.ndarray:
        """How sure each text's words are of their language, on average, whichever each is in."""
        return self._summed(texts, 1, lambda found: found.max(axis=1, keepdims=True))[:, 0]

    def _summed(self, texts: list[str], width: int, of_words: Callable) -> np.ndarray:
        out = np.zeros((len(texts), width))
        if not self.model.labels:
            return out
        split = [(n, words_of(t)) for n, t in enumerate(texts)]
        split = sorted(((n, w) for n, w in split if w), key=lambda x: -len(x[1]))
        start = 0
        while start < len(split):
            stop, count = start, 0
            while stop < len(split) and (stop == start or count + len(split[stop][1]) <= AT_ONCE):
                count += len(split[stop][1])
                stop += 1
            self._fill(split[start:stop], out, of_words)
            start = stop
        return out

    def _fill(self, split: list[tuple[int, list[str]]], out: np.ndarray, of_words: Callable) -> None:
        if len(self.index) > MEMO:
            self.index, self.table = {}, self.table[:0]
        ids = self._ids([w for _, words in split for w in words])
        lengths = np.array([len(words) for _, words in split])
        found, _, _ = posteriors(
            self.table[ids].astype(np.float64), lengths, self.model.moves, self.model.starts, expect=False
        )
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out[[n for n, _ in split]] = np.add.reduceat(of_words(found), first, axis=0) / lengths[:, None]


def _labeller(packed: bytes) -> _Labeller:
    return kept(("labeller", zlib.crc32(packed)), lambda: _Labeller(pickle.loads(packed)))


def fit(labelled: DataFrame, per_language: int = DOCUMENTS_PER_LANGUAGE) -> bytes:
    """A model, pickled, from doc_id, text and lang of the rows with a lang.

    It learns from at most `per_language` whole documents of each language, those whose ids
    come first by hash.  Training runs as one task on the executors.
    """
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = staged(
        known.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= per_language)
        .select("doc_id")
        .distinct(),
        "sample",
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["lang"], r["text"]))
        model = train([r["text"] for r in rows], [r["lang"] for r in rows])
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    sample = labelled.filter("lang is not null and text is not null").select(
        "doc_id", "text", "lang"
    )
    sample = sample.join(chosen, "doc_id", "left_semi").select("text", "lang")
    rows = sample.repartition(1).mapInArrow(learn, "model binary").collect()
    return bytes(rows[0].model) if rows else pickle.dumps(train([], []))


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone.

    Null text, empty text and text without a letter give `und` with score 0; so does every
    row if nothing could be learned.  Score is the mean probability of the label.  Repeated
    rows are each labelled; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared.value)
        names = np.array([*labeller.model.labels, UNKNOWN], dtype=object)
        for batch in in_pieces(batches, 2000):
            found = labeller.probabilities(texts_of(batch))
            best = found.argmax(axis=1) if found.shape[1] else np.zeros(len(found), dtype=int)
            score = found.max(axis=1, initial=0)
            best[score == 0] = len(names) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(np.minimum(score, 1.0)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        label, "doc_id long, lang_pred string, score double"
    )


# A document goes if its words are less sure than this of any known language, on average.
LEAST_CERTAINTY = 0.35


def keep_known(docs: DataFrame, model: bytes, least: float = LEAST_CERTAINTY) -> DataFrame:
    """The rows whose text is in a known language, with all their columns, in one pass.

    Rows labelled `und` go, and rows whose words are like no known language: the mean over the
    words of the probability of the likeliest one is below `least`.  Words of several known
    languages in one text are no reason, however many there are.  Repeated rows and rows without an
    id are judged by their text like any other; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared.value)
        for batch in in_pieces(batches, 2000):
            found = labeller.certainty(texts_of(batch))
            stays = (found > 0) & (found >= least)
            if stays.any():
                yield batch.filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 4)
    model = fit(docs.select("doc_id", "text", "lang").filter(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
