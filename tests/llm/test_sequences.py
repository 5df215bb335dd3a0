"""Prefix trie, removal of long repeats and token alignment against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ledgerwake.llm import alignment, prefix_trie, queries, suffix_levels
from ledgerwake.llm.shared import importable, table
from ledgerwake.llm.tokens import token_bytes

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row int, packed string, core string, pairs int"
PROSE = " ".join(f"word{n % 61} other{n % 7}," for n in range(120))


def _docs(spark, rows):
    importable(spark)
    return spark.createDataFrame([(*r, 1, "x", None, 2) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows and ids, control strings, a very long text, clashing names."""
    return _docs(
        spark,
        [
            (1, None),
            (2, ""),
            (3, PROSE),
            (4, PROSE[5:] + "é" * 150),
            (4, PROSE[5:] + "é" * 150),
            (4, "another text of the same id"),
            (5, "</s><|endoftext|>  two  spaces\n\n▁ \0 end"),
            (6, "ß" * 99 + "日本語" * 40),
            (7, "a" * 199),
            (8, "a" * 200),
            (9, "a" * 201),
            (10, " "),
            (None, "x " * 30),
            (None, PROSE * 250),
        ],
    )


def _tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- prefix trie -----------------------------------------------------------------------


def _trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        way = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
        for depth in range(len(way) + 1):
            members[way[:depth]].append(conv)
        ends[way].append(conv)
    for way in members:
        if way:
            children[way[:-1]].append(way)
    leaves, saved, out = {}, {}, []
    for way in sorted(members, key=len, reverse=True):
        leaves[way] = sum(leaves[c] for c in children[way]) or 1
        own_bytes = len(way[-1][1].encode()) if way else 0
        saved[way] = sum(saved[c] for c in children[way]) + (len(members[way]) - 1) * own_bytes
        ids = ",".join(map(str, sorted(ends[way])))
        parent = min(members[way[:-1]]) if way else None
        out.append(
            (min(members[way]), len(way), parent, len(members[way]), len(children[way]), leaves[way], saved[way],
             hashlib.sha256(ids.encode()).hexdigest())
        )
    return sorted(out, key=str)


def _turns(spark, rows):
    importable(spark)
    ddl = "conv_id long, turn long, role string, text string, depth string, n int, s1 int"
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], ddl)


@pytest.mark.parametrize("members", [1000, 1])
def test_trie_equals_brute_force(spark, members):
    turns = table(spark, SF_DIR, "conversations")
    wanted = _trie(map(tuple, turns.select("conv_id", "turn", "role", "text").collect()))
    assert _tuples(prefix_trie.build(turns, members)) == wanted


def test_trie_with_a_hot_start_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 50)
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    pick = random.Random(3)
    rows = [(5, turn, "user", f"t{turn % 3}") for turn in range(700)]
    rows += [(c, turn, "user", "same") for c in range(100, 160) for turn in range(12)]
    rows += [(c, turn, "user", pick.choice("ab")) for c in range(200, 260) for turn in range(pick.randrange(14))]
    for members in (1000, 7):
        assert _tuples(prefix_trie.build(_turns(spark, rows), members)) == _trie(rows)


def test_trie_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"),
        (10, None, None, None),
        (10, 1, "", ""),
        (10, 1, "", ""),
        (11, 2, "user", "é" * 5000),
        (11, 2, "user", "é" * 5000),
        (12, 0, None, "x"),
        (13, 0, "", "x"),
        (14, 0, "userx", ""),
        (-7, 0, "user", "x"),
    ]
    assert _tuples(prefix_trie.build(_turns(spark, rows))) == _trie(rows)
    assert prefix_trie.build(_turns(spark, rows).filter("conv_id = 99")).count() == 0
    ties = [(0, 1, "b", "y"), (0, 1, "a", "x"), (0, 1, "a", "w")]
    both = [_tuples(prefix_trie.build(_turns(spark, r))) for r in (ties, ties[::-1])]
    assert both[0] == both[1] and len(both[0]) == 4


def test_queue_spills_and_keeps_order():
    pick = np.random.default_rng(5)
    rows = pick.integers(-50, 50, (5000, 4))
    queue = prefix_trie.Queue(4, waiting=300)
    for part in np.array_split(rows, 40):
        queue.put(part)
    assert len(queue.runs) > 5
    out = [queue.take(bound) for bound in ((-20, 3), (0, 0), (0, 1), (49, 49))]
    joined = np.concatenate(out)
    assert sorted(map(tuple, joined)) == sorted(map(tuple, rows))
    assert (np.diff(joined[:, 0] * 1000 + joined[:, 1]) >= 0).all()
    assert tuple(out[0][-1][:2]) <= (-20, 3) < tuple(out[1][0][:2])


# --- long repeats ----------------------------------------------------------------------


def _without_repeats(rows):
    raws = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(raw[k : k + 200] for _, raw in raws for k in range(len(raw) - 199))
    out = []
    for doc_id, raw in raws:
        gone = [False] * len(raw)
        for k in range(len(raw) - 199):
            if seen[raw[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    wanted = _without_repeats(map(tuple, docs.select("doc_id", "text").collect()))
    assert sum(w[2] for w in wanted) > 0
    assert _tuples(suffix_levels.remove(docs)) == wanted


def _passages(seed):
    """Texts from a small alphabet that share passages of just under and over 200 bytes."""
    pick = random.Random(seed)
    noise = lambda n: "".join(pick.choice("abcdefgh ") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 201, 260, 500)]
    rows = []
    for doc_id in range(60):
        parts = [noise(pick.randrange(300))]
        for _ in range(pick.randrange(4)):
            one = pick.choice(shared)
            start = pick.randrange(0, 40)
            parts += [one[start:] if pick.random() < 0.5 else one, noise(pick.randrange(90))]
        rows.append((doc_id, "".join(parts)))
    return rows


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_repeats_of_passages(spark, batches):
    rows = _passages(batches)
    assert _tuples(suffix_levels.remove(_docs(spark, rows), batches)) == _without_repeats(rows)


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 3), (3, 40)])
def test_shared_strings_of_large_groups(spark, seed, partitions):
    """Contexts of few cores that agree on the left, on the right, on both with different ones."""
    pick = random.Random(seed)
    side = lambda: bytes(pick.choice(b"ab") for _ in range(3)) + bytes([pick.choice(b"xy")]) * 157
    rows = set()
    for row in range(150):
        off, n = pick.randrange(100, 161), pick.randrange(1, 60)
        left, right = side()[::-1] if row % 2 else side(), side() if row % 3 else side()[::-1]
        rows.add((row, 1000 * row, n, row % 5 > 0, left[:off], pick.choice([b"c", b"d"]) * 40, right[: 160 - off + n - 1]))
    rows = sorted(rows)
    strings = Counter()
    for _, _, n, _, left, mid, right in rows:
        raw = left[::-1] + mid + right
        assert len(raw) == 199 + n
        strings.update(raw[k : k + 200] for k in range(n))
    wanted = set()
    for row, first, n, lone, left, mid, right in rows:
        raw = left[::-1] + mid + right
        wanted.update((row, first + k) for k in range(n) if lone and strings[raw[k : k + 200]] > 1)
    importable(spark)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = suffix_levels.shared_strings(spark.createDataFrame(rows, suffix_levels.CONTEXT)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {(r.row, k) for r in found for k in range(r.first, r.last + 1)} == wanted
    assert 0 < len(wanted) < sum(r[2] for r in rows if r[3])


def test_repeats_across_segments_of_a_long_text(spark, monkeypatch):
    rows = _passages(11)
    rows.append((70, "".join(text for _, text in rows) + "z" * 700))
    # Python workers import the module anew, so the segments themselves are looked at here.
    monkeypatch.setattr(suffix_levels, "STEP", 1000)
    batch = _docs(spark, rows).select("row", "text").toArrow().combine_chunks().to_batches()[0]
    strings = Counter()
    for _, starts, parts in suffix_levels._segments(batch):
        strings.update(p[k : k + 200] for p in parts for k in range(len(p) - 199))
        assert sum(map(len, parts)) < 2 * 1000 or len(parts) == 1
    raws = [text.encode() for _, text in rows]
    assert strings == Counter(r[k : k + 200] for r in raws for k in range(len(r) - 199))
    monkeypatch.undo()
    assert _tuples(suffix_levels.remove(_docs(spark, rows))) == _without_repeats(rows)


def test_every_string_picks_the_same_anchor():
    pick = random.Random(2)
    text = "".join(pick.choice("ab") for _ in range(3000)).encode()
    find = suffix_levels.Anchors()

    def anchor_of(raw):
        at, first, last = find.of(raw, np.array([len(raw)]))
        out = {}
        for a, x, y in zip(at.tolist(), first.tolist(), last.tolist()):
            out.update({p: a - p for p in range(x, y + 1)})
        return out

    whole = anchor_of(text)
    assert sorted(whole) == list(range(len(text) - 199))
    for start in range(0, 2800, 37):
        assert anchor_of(text[start : start + 200]) == {0: whole[start]}


def test_repeats_odd_rows(spark, odd):
    wanted = _without_repeats((r.doc_id, r.text) for r in odd.collect())
    assert _tuples(suffix_levels.remove(odd)) == wanted
    assert suffix_levels.remove(odd.filter("doc_id = 99")).count() == 0


def test_levels_merge_geometrically(spark):
    docs = _docs(spark, _passages(4)).selectExpr("doc_id as row", "text")
    index, sizes = suffix_levels.SuffixLevels(spark), []
    for k in range(4):
        index.add(docs.filter(f"row % 4 = {k}"))
        sizes.append(sorted(index.levels))
    assert sizes == [[1], [2], [1, 2], [4]]
    order = [tuple(r) for r in index.levels[4].select("core", "context", "row", "place").collect()]
    assert len(order) == suffix_levels.suffixes(docs).count()
    # A batch that brings nothing new finds all that it repeats, on both sides.
    again = index.add(docs.filter("row = 1").selectExpr("row + 1000 as row", "text"), keep=False)
    assert {r.row for r in again.filter("state = 2").collect()} >= {1001}


# --- token alignment -------------------------------------------------------------------


def _aligned(rows):
    byte_bpe = Tokenizer.from_file(queries.BYTE_BPE)
    byte_bpe.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=queries.PIECE_BPE)
    bytes_a, bytes_b = token_bytes(queries.BYTE_BPE), alignment.piece_bytes(pieces)
    docs, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a = byte_bpe.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        whole = b" " + text.encode()
        if not text or any(b"".join(t[n] for n in ids) != whole for t, ids in ((bytes_a, a), (bytes_b, b))):
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a = {int(e): n for n, e in enumerate(np.cumsum([len(bytes_a[n]) for n in a]))}
        ends_b = {int(e): n for n, e in enumerate(np.cumsum([len(bytes_b[n]) for n in b]))}
        both = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a[e]], b[ends_b[e]]) for e in both]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in both:
            groups.append((a[i : ends_a[e] + 1], b[j : ends_b[e] + 1]))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        docs.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(counts[pair] == most[pair[1]] for pair in links)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        overlaps = sum(len(x) + len(y) - 1 for x, y in groups)
        out.append(
            (doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest, overlaps)
        )
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [alignment.SENT, 0])
def test_alignment_equals_brute_force(spark, odd, sent):
    for docs in (table(spark, SF_DIR, "documents"), odd):
        wanted = _aligned([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert _tuples(alignment.align(docs, queries.BYTE_BPE, queries.PIECE_BPE, sent)) == wanted
    nothing = odd.filter("doc_id = 99")
    assert alignment.align(nothing, queries.BYTE_BPE, queries.PIECE_BPE, sent).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.lists(st.integers(1, 9), min_size=1), st.lists(st.integers(1, 9), min_size=1)), max_size=4))
def test_groups_and_overlaps_of_intervals(texts):
    sides = []
    for a, b in texts:  # both sides cover a text
        total = max(sum(a), sum(b))
        sides.append([[*s, total - sum(s)] if sum(s) < total else s for s in (a, b)])
    a, b = (np.array([n for one in sides for n in one[k]], dtype=np.int64) for k in (0, 1))
    laid = alignment.lay(a, b)
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert laid.n_groups == len(cuts)
    assert laid.group_a.tolist() == np.searchsorted(cuts, ends_a).tolist()
    assert laid.group_b.tolist() == np.searchsorted(cuts, ends_b).tolist()
    pairs = {
        (i, j)
        for i in range(len(a))
        for j in range(len(b))
        if ends_a[i] - a[i] < ends_b[j] and ends_b[j] - b[j] < ends_a[i]
    }
    assert set(zip(laid.left.tolist(), laid.right.tolist())) == pairs and len(laid.left) == len(pairs)
    assert {(i, j) for i, j in pairs if ends_a[i] == ends_b[j]} == set(
        zip(laid.left[laid.together].tolist(), laid.right[laid.together].tolist())
    )
