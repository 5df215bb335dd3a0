"""Each operator against a brute-force version or a round trip, and on odd tables."""

from __future__ import annotations

import hashlib
import re
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwake.llm import (
    chat,
    exact_dedup,
    language_id,
    language_model,
    mixing,
    ngram_join,
    packing,
    queries,
    secret_scan,
    token_files,
    topk,
)
from ledgerwake.llm.shared import importable, staged, table
from ledgerwake.llm.tokens import Encoder
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, kept string, hash int"
PROSE = " ".join(f"word{n % 61} other{n % 7}," for n in range(120))


def _docs(spark, rows):
    importable(spark)
    filled = [(*r, None, 1, "x", 2) for r in rows]
    return spark.createDataFrame(filled, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, ties, a very long text, clashing column names."""
    return _docs(
        spark,
        [
            (1, None, "en", "a"),
            (2, "", None, None),
            (3, PROSE, "en", "a"),
            (4, PROSE.replace(" ", "\t\n"), "en", "b"),
            (4, PROSE.replace(" ", "\t\n"), "en", "b"),
            (5, PROSE.replace("word3 ", "changed "), "de", None),
            (6, "one two", "de", "b"),
            (7, "ONE Two", None, "b"),
            (8, "  1 2 3 !", "en", "c"),
            (9, PROSE * 60, "en", "c"),
            (None, "x", "fr", "c"),
        ],
    )


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("doc_id = -5")


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    actual = queries.queries()[name](spark, SF_DIR).toPandas()
    expected = connect(SF_DIR).execute(queries.oracle_sql()[name]).fetchdf()
    assert differences(actual, expected) == ""


# --- chat ------------------------------------------------------------------------------


@given(st.text(alphabet="</s>[INST] \\a", max_size=40))
def test_escape_is_undone(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in ("</s>", "<s>", "[INST]", "[/INST]"))


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(
        [
            (1, 1, "assistant", "b </s>", "z"),
            (1, 0, "user", None, "z"),
            (1, 0, "user", None, "z"),
            (2, None, None, "é\n ", "z"),
            (None, 0, "assistant", "", "z"),
        ],
        "conv_id long, turn long, role string, text string, part string",
    )
    importable(spark)
    for rows in (turns, table(spark, SF_DIR, "conversations").unionByName(chat.probe(spark))):
        chunks = staged(chat.format_turns(rows, queries.BYTE_BPE), "chat")
        found = {r.conv_id: r for r in chat.digests(chunks, queries.BYTE_BPE).collect()}
        key = lambda r: (r.turn is not None, r.turn, r.role or "", r.text or "")
        said = sorted(rows.collect(), key=key)
        assert set(found) == {r.conv_id for r in said}
        for name, one in found.items():
            own = [(r.role or "", r.text or "") for r in said if r.conv_id == name]
            learnt = "".join(t for r, t in own if r == "assistant")
            whole = "".join(f"{r}\n{t}\n" for r, t in own)
            assert one.n_turns == len(own)
            assert one.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
            assert one.loss_chars == len(learnt)
            assert one.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
            assert one.formatted_chars >= len(whole)
    nothing = staged(chat.format_turns(turns.filter("conv_id = 9"), queries.BYTE_BPE), "chat")
    assert chat.digests(nothing, queries.BYTE_BPE).count() == 0


# --- exact dedup -----------------------------------------------------------------------


def test_dedup_odd_rows(odd, empty):
    found = _rows(exact_dedup.resolve(odd))
    keep = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found}
    assert len(found) == 11
    assert {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (4, 3, 3, False)} <= keep
    assert (None, None, 1, True) in keep
    assert exact_dedup.resolve(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in exact_dedup.keep_first(odd).collect()) == [0, 1, 3, 5, 6, 7, 8, 9]


def test_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "same  text", "en", "b"), (1, "same  text", "en", "b"), (1, "same text", "en", "a")]
    rows += [(1, "another", "en", "a"), (None, None, "en", None), (None, "", "en", None), (7, "same text", "en", "a")]
    docs = _docs(spark, rows + rows)
    found = exact_dedup.keep_first(docs)
    assert found.schema.names == docs.schema.names
    kept = sorted((r.doc_id or 0, r.text or "", r.source or "") for r in found.collect())
    assert kept == [(0, "", ""), (1, "another", "a"), (1, "same  text", "b")]


def test_dedup_survives_collisions(odd):
    alike = exact_dedup.resolve(odd, lambda text: F.unhex(F.lit("00")))
    assert sorted(map(str, alike.collect())) == sorted(map(str, exact_dedup.resolve(odd).collect()))


# --- mixing ----------------------------------------------------------------------------


def _targets(sizes, weights, budget):
    """Water filling by rounds."""
    full, out = set(), {}
    while True:
        rest = budget - sum(3 * sizes[s] for s in full)
        share = sum(w for s, w in weights.items() if s not in full)
        out = {s: 3 * sizes[s] if s in full else rest * weights[s] / share for s in sizes}
        more = {s for s in sizes if s not in full and out[s] > 3 * sizes[s]}
        if not more:
            return out
        full |= more


def test_mix_follows_weights(spark):
    docs = table(spark, SF_DIR, "documents").withColumn(
        "source", F.when(F.col("source") != "src4", F.col("source"))
    )
    found = _rows(mixing.mix_words(docs))
    again = _rows(mixing.mix_words(docs.repartition(7)))
    key = lambda r: r["doc_id"]
    assert sorted(found, key=key) == sorted(again, key=key)
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    wanted = _targets(sizes, weights, sum(sizes.values()))
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 2 * longest[s]
    assert sum(taken.values()) <= sum(sizes.values())


def test_mix_odd_rows(odd, empty):
    found = _rows(mixing.mix_words(odd))
    assert len(found) == 11 and all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    assert mixing.mix_words(empty).count() == 0
    assert mixing.deal(odd).columns == odd.columns
    assert mixing.deal(empty).count() == 0


# --- top-k -----------------------------------------------------------------------------


def test_topk_odd_vectors(spark):
    importable(spark)
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (2, [1.0, 0.5], 1),
        (3, [-1.0, 0.001], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [None, 1.0], 1), (8, [1.0], 1), (50, [2.0, 2.0], 1), (None, [1.0, 1.0], 1), (100, [], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = topk.search(topk.quantised(vectors), F.col("vec_id") % 50 == 0)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    assert got[0, 1] == (50, 256 * 512 + 128 * 512)
    assert [got[0, n][0] for n in (2, 3, 4, 5)] == [1, 2, 2, 3]
    assert {q for q, _ in got} == {0, 50}
    assert topk.search(topk.quantised(vectors.limit(0)), F.col("vec_id") == 0).count() == 0


@given(st.integers(0, 5), st.integers(1, 40), st.sampled_from([1, 3, 16, 20]))
@settings(deadline=None, max_examples=30)
def test_topk_block_equals_brute_force(seed, n, dim):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-3, 4, size=(n, dim))
    query, row, score = topk.search_block(np.arange(n), rows, np.arange(n), rows, 5)
    for q in range(n):
        every = sorted((-int(rows[q] @ rows[c]), c) for c in range(n) if c != q)[:5]
        assert [(-s, r) for r, s in zip(row[query == q], score[query == q])] == every


# --- n-gram join -----------------------------------------------------------------------


def _components(texts):
    sets = {}
    for name, text in texts:
        words = text.encode().lower().split()
        sets[name] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {name: name for name in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {name: (len(sets[name]), label[name]) for name in sets}


def test_join_equals_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert found == _components(_texts(docs))


def test_join_links_a_chain_of_edits(spark):
    """Neighbours in the chain link, its ends do not."""
    words = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(12):
        rows.append((100 - n, " ".join(words), "en", "a"))
        words[20 * n : 20 * n + 3] = [f"new{n}x{k}" for k in range(3)]
    docs = _docs(spark, rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert found == _components(_texts(docs))
    assert len({c for _, c in found.values()}) == 1


def test_join_last_turn_and_copies_equal_brute_force(spark, monkeypatch):
    """Without hubs, every link comes from the turn that compares neighbouring classes of length."""
    monkeypatch.setattr(ngram_join, "HUBS", 0)
    base = [f"w{n}" for n in range(120)]
    rows = [(n, " ".join(base[: 80 + 2 * n]), "en", "a") for n in range(21)]
    rows += [(50 + n, " ".join(base[:6] + [f"own{n}x{k}" for k in range(40 + 9 * n)]), "en", "a") for n in range(6)]
    rows += [(100 + n, " ".join(base[40:]), "en", "a") for n in range(70)]
    docs = _docs(spark, rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert found == _components(_texts(docs))
    assert len({found[100 + n][1] for n in range(70)}) == 1


def test_join_odd_rows(odd, empty):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (6, 1, 6), (7, 1, 6), (None, 1, None)} <= found
    assert {c for d, _, c in found if d in (3, 4)} == {3}
    assert ngram_join.join(empty).count() == 0
    assert ngram_join.keep_one(odd).columns == odd.columns


# --- language id -----------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    docs = table(spark, SF_DIR, "documents")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(odd, empty):
    found = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert {n for n, r in found.items() if r.lang_pred == "und"} == {1, 2, 8}
    assert language_id.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_clean_code_switched_texts_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    known = docs.filter("lang is not null and length(text) > 400").orderBy("doc_id")
    parts = {}
    for row in known.select("lang", "text").collect():
        parts.setdefault(row.lang, []).append(" ".join(row.text.split()[:40]))
    assert len(parts) >= 3
    mixed = [" ".join(one) for one in zip(*(p[:20] for p in parts.values()))]
    short = [" ".join(p.split()[:4]) for own in parts.values() for p in own[:10]]
    rows = [*mixed, *short, *mixed[:1]]
    frame = _docs(spark, [(n, t, None, None) for n, t in enumerate(rows)] + [(None, mixed[0], None, None)])
    gone = _docs(spark, [(-1, None, "en", "a"), (-2, "", "en", "a"), (-3, "12 34 --", "en", "a")])
    kept = language_id.keep_known(frame.unionByName(gone), model)
    assert kept.columns == frame.columns
    assert sorted(r.text for r in kept.collect()) == sorted([*rows, mixed[0]])
    assert language_id.keep_known(frame.filter("doc_id = -5"), model).count() == 0


def test_features_of_many_words_at_once(monkeypatch):
    words = ["a", "ab", "abc", "stra\u00dfe", "\u00e9", "\u00e9a", "\u4e2d\u6587\u5b57", "x\U00010428", "z" * 300]
    lexicon, rng = {"ab": [0, 1], "\u00e9": [1]}, np.random.default_rng(6)
    weights = rng.normal(size=(language_id.FEATURES, 2))
    wanted = [language_id.features_of(w, lexicon) for w in words]
    monkeypatch.setattr(language_id, "features_of", None)  # a call for each word took too long
    monkeypatch.setattr(language_id, "HASHED", 4, raising=False)
    model = language_id.Model(["p", "q"], weights, np.zeros((2, 2)), np.zeros(2), lexicon)
    assert model.scores(words) == pytest.approx(np.array([weights[f].sum(axis=0) for f in wanted]))
    flat, sizes = language_id.feature_table(words, lexicon)
    assert flat.tolist() == sum(wanted, []) and sizes.tolist() == [len(f) for f in wanted]


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(3)
    scores, moves, starts = rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    found, _, _ = language_id.posteriors(scores, np.array([4]), moves, starts)
    total, mass = 0.0, np.zeros((4, 2))
    for code in range(16):
        path = [code >> k & 1 for k in range(4)]
        value = starts[path[0]] + sum(scores[t, y] for t, y in enumerate(path))
        value = math.exp(value + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += value
        for t, y in enumerate(path):
            mass[t, y] += value
    assert np.allclose(found, mass / total)


# --- tokens ----------------------------------------------------------------------------

PARTS = list("ab Zé.,'s1\n\t  \x1c\x85\xa0ΣİÅ!\0語") + ["can't ", " the ", "e\u0301", "\u2003"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(file):
    encoder = Encoder(public_tokenizers.path(file))
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    plain.encode_special_tokens = True

    @given(st.lists(TEXT, max_size=4))
    @settings(deadline=None, max_examples=600)
    def check(texts):
        for text, ids in zip(texts, encoder.encode(texts)):
            wanted = plain.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, dtype="<u4").tolist() == wanted, repr(text)

    check()


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_in_texts_equal_library(file):
    encoder = Encoder(public_tokenizers.path(file))
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    as_text = Encoder(public_tokenizers.path(file), special_as_text=True)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"]
    text = st.lists(st.sampled_from([*PARTS, *marks]), max_size=20).map("".join)

    @given(st.lists(text, max_size=4))
    @settings(deadline=None, max_examples=300)
    def check(texts):
        for flag, own in ((False, encoder), (True, as_text)):
            plain.encode_special_tokens = flag
            for one, ids in zip(texts, own.encode(texts)):
                wanted = plain.encode(one, add_special_tokens=False).ids
                assert np.frombuffer(ids, dtype="<u4").tolist() == wanted, repr(one)

    check()
    if file.startswith("byte"):
        found = encoder.encode(["a <|endoftext|> b"])[0]
        assert np.frombuffer(found, dtype="<u4").tolist() == [64, 220, 50256, 275]


@given(st.integers(1, 32), st.integers(0, 50), st.integers(0, 50))
@settings(deadline=None)
def test_bits_round_trip(width, n, start):
    ids = np.random.default_rng(n).integers(0, 1 << width, size=n)
    packed = token_files.pack_bits(ids, width)
    assert len(packed) == -(-n * width // 8)
    start = min(start, n)
    assert token_files.unpack_bits(packed, width, start, n - start).tolist() == ids[start:].tolist()


def test_token_files_round_trip(spark, odd, empty, folder):
    token_files.write(odd, folder, queries.BYTE_BPE, block_ids=500)
    plain, at = Tokenizer.from_file(queries.BYTE_BPE), 0
    found = _rows(token_files.documents(token_files.read(spark, folder), with_ids=True))
    found.sort(key=lambda r: r["start"])
    texts = sorted(_texts(odd), key=lambda r: (r[0] is not None, r[0]))
    assert [r["doc_id"] for r in found] == [name for name, _ in texts]
    for one, (_, text) in zip(found, texts):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        assert (one["ids"], one["start"], one["n_tokens"]) == (ids, at, len(ids))
        assert one["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert len(token_files.fetch(spark, folder, 6).collect()) == 1
    token_files.write(empty, folder + "-none", queries.BYTE_BPE)
    assert token_files.documents(token_files.read(spark, folder + "-none")).count() == 0


# --- packing ---------------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
@settings(deadline=None)
def test_plan_uses_every_piece_once(counts):
    used = Counter()
    for pattern in packing.plan(counts, 60):
        assert sum(length * times for length, times in pattern.lengths) <= 60
        for length, times in pattern.lengths:
            used[length] += times * pattern.bins
    assert used == counts


@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 40))
@settings(deadline=None)
def test_fullest_combination(lengths, room):
    chosen = packing._fullest(dict(Counter(lengths)), 0, room)
    sums = {0}
    for length in lengths:
        sums |= {s + length for s in sums if s + length <= room}
    assert sum(length * times for length, times in chosen) == max(sums)
    assert all(times <= lengths.count(length) for length, times in chosen)


def test_packing_round_trip(odd, empty):
    pieces = packing.pieces_of(odd, queries.WORD_BPE, keep_ids=True)
    placed = packing.place(pieces)
    plain = Tokenizer.from_file(queries.WORD_BPE)
    rows, whole = _rows(placed), {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    total = sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in _texts(odd))
    assert sum(r["length"] for r in rows) == total
    for r in rows:
        here = whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert here == bytes(r["ids"]) and zlib.crc32(here) == r["ids_crc32"]
    assert all(len(ids) <= 4 * 2048 for ids in whole.values())
    assert packing.pack(empty, queries.WORD_BPE).count() == 0


# --- secrets ---------------------------------------------------------------------------


KEY = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"


def test_secret_scan(spark, odd, empty):
    rows = [(n, f'é the token = "{KEY[n % 9:]}{n}" of it', "en", "a") for n in range(40)]
    rows += [(100 + n, "a verylongwordwithoutadigit here", "en", "a") for n in range(40)]
    asked = {
        200: (f"fixed in commit {KEY} today", KEY, False),
        201: (f"see https://x.org/a/{KEY} there", KEY, False),
        202: ('token = "abcdefghijklmnopqrstuvwx" end', "abcdefghijklmnopqrstuvwx", True),
        203: ('my_password = "Tr0ub4dor&3"', "Tr0ub4dor&3", True),
        204: ("passwd=a.b!c@d%e&f:g9 and so on", "a.b!c@d%e&f:g9", True),
        205: (f"password: 'x\"y' for {KEY}==", 'x"y', True),
    }
    rows += [(n, text, "en", "a") for n, (text, _, _) in asked.items()]
    docs = _docs(spark, rows)
    found = _rows(secret_scan.scan(docs))
    texts = dict(_texts(docs))
    for r in found:
        value = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(value.encode()).hexdigest() == r["value_sha256"]
        if r["doc_id"] < 200:
            assert r["is_secret"] == (r["doc_id"] < 100)
        elif value in asked[r["doc_id"]]:
            assert r["is_secret"] == asked[r["doc_id"]][2], (value, r["probability"])
    assert len(found) == 87
    assert secret_scan.scan(empty).count() == 0
    assert {r["doc_id"] for r in _rows(secret_scan.scan(odd))} <= {r["doc_id"] for r in _rows(odd)}


def test_candidates_equal_brute_force(spark):
    """The same pattern, found anew in Python; many candidates in one text keep their places."""
    text = "".join(f"{'x' * (n % 7)} {KEY[n % 20:]} Auth_token : 'p{n}' secret=q{n};" for n in range(3000))
    docs = _docs(spark, [(1, text, "en", "a"), (1, text[:900], "en", "a"), (None, "token=abc=", "en", "a")])
    found = sorted((str(r.doc_id), r.start, r.value) for r in secret_scan.candidates(docs).collect())
    expected = []
    for name, one in _texts(docs):
        for m in re.finditer(secret_scan.CANDIDATE, one, re.ASCII):
            lead = re.match(secret_scan.LEAD, m.group(), re.ASCII)
            begin = lead.end() if lead else 0
            quoted = bool(lead) and lead.group()[-1] in "\"'"
            expected.append((str(name), m.start() + begin, m.group()[begin : len(m.group()) - quoted]))
    assert found == sorted(expected)
    assert len(found) > 9000


def test_held_out_findings_are_told_apart(spark):
    """Precision and recall on labelled findings that took no part in training."""
    rows = []
    for n in range(200):
        key = hashlib.sha1(str(n).encode()).hexdigest()
        rows.append((2 * n, f'set api_key = "{key}" now' if n % 2 else f"at commit {key} in /srv/{key}/log", "en", "a"))
        rows.append((2 * n + 1, f"the configuration_of_service_{n} is kept", "en", "a"))
    docs = _docs(spark, rows)
    words = secret_scan.dictionary(docs)
    found = secret_scan.labelled(secret_scan.candidates(docs), words).withColumn("truth", F.col("label"))
    hidden = F.when(F.col("doc_id") % 5 != 0, F.col("label"))
    judged = _rows(secret_scan.classify(found.withColumn("label", hidden), words).filter("doc_id % 5 = 0"))
    right = sum(r["is_secret"] and r["truth"] == 1 for r in judged)
    assert right >= 0.95 * sum(r["is_secret"] for r in judged)
    assert right >= 0.95 * sum(r["truth"] == 1 for r in judged) > 0


def test_rare_secrets_reach_the_training_sample(spark):
    rows = [(n, "a verylongwordwithoutadigit here", "en", "a") for n in range(60)]
    rows.append((100, f'the token = "{KEY}" of it', "en", "a"))
    docs = _docs(spark, rows)
    words = secret_scan.dictionary(docs)
    found = secret_scan.classify(secret_scan.labelled(secret_scan.candidates(docs), words), words, most=8)
    assert {r["doc_id"] for r in _rows(found) if r["is_secret"]} == {100}


# --- language model --------------------------------------------------------------------


def _counts(texts, parts=7):
    split = [(n, t.encode().lower().split() + [b""]) for n, t in texts]
    out = {n: n is not None and zlib.crc32(str(n).encode()) % parts == 2 for n, _ in split}
    return split, out, Counter(w for n, ws in split if not out[n] for w in ws)


def _check_scores(docs, frequent=None):
    split, out, counts = _counts(_texts(docs))
    total, distinct = sum(counts.values()), len(counts)
    found = _rows(language_model.score(docs))
    key = lambda r: (r[0] is not None, r[0] or 0, len(r[1]))
    found.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]))
    for one, (name, words) in zip(found, sorted(split, key=key)):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert one["doc_id"] == name and one["held_out"] == out[name]
        assert one["base_score"] == pytest.approx(base)
        assert one["n_known"] == sum(counts[w] > 0 for w in words)
        assert (one["n_tokens"], one["train_tokens"]) == (len(words), total)
    assert len(found) == len(split)
    return found


def test_scores_beat_the_base_on_held_out_rows(spark):
    found = [r for r in _check_scores(table(spark, SF_DIR, "documents")) if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_rare_words_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(language_model.frequent_tokens, "__defaults__", (50,))
    _check_scores(table(spark, SF_DIR, "documents"))


def test_scores_of_odd_rows(odd, empty):
    _check_scores(odd)
    assert language_model.score(empty).count() == 0


def test_features_keep_apart_as_the_input_grows():
    rng = np.random.default_rng(2)
    for distinct in (400_000, 4_000_000):
        rows = language_model.feature_rows(distinct)
        hashed = rng.integers(0, 1 << 32, size=distinct, dtype=np.uint32)
        first = np.arange(distinct) == 0
        found = language_model.histories(np.zeros(distinct, dtype=np.int8), hashed, first, rows)
        assert len(np.unique(found[:, 0])) > distinct / language_model.TOKENS_PER_ROW * 0.9
        assert found.max() < rows


def test_words_within_a_class_follow_their_history():
    rng = np.random.default_rng(3)
    n, buckets = 40, rng.integers(0, 9, size=(2, language_model.ENDINGS, 4))
    kinds = rng.integers(0, language_model.CLASSES, size=n + 1).astype(np.int8)
    kinds[:2] = 5
    counts, zeros = rng.integers(1, 99, size=n + 1), np.zeros(n + 1, dtype=np.uint32)
    words = language_model.Vocabulary({}, counts, kinds, zeros, kinds[:-1])
    forks = language_model.Forks(words, buckets)
    weights = np.zeros(1 << 13, dtype=np.float32)
    choices = language_model.Choices(forks, weights)
    leaves = np.arange(n + language_model.ENDINGS * 4)
    of_class = np.concatenate([kinds[:-1], np.repeat(np.arange(language_model.ANCHORS, language_model.CLASSES), 4)])

    def chances(history):
        features = np.tile(np.array(history), (len(leaves), 1))
        return np.exp(choices.logs(features, forks.place[leaves]))

    same = kinds[:-1] == 5
    assert chances([1, 2, 3, 4, 5])[:n][same] == pytest.approx(
        (counts[:-1] + 1)[same] / (counts[:-1] + 1)[same].sum(), rel=1e-4
    )
    one, other = [11, 12, 13, 14, 15], [21, 22, 23, 24, 25]
    for _ in range(20):
        choices.step(np.array([one, other]), forks.place[[0, 1]])
    assert chances(one)[0] > 1.2 * chances(other)[0]
    assert chances(other)[1] > 1.2 * chances(one)[1]
    assert np.bincount(of_class, chances(one))[np.unique(of_class)] == pytest.approx(1, rel=1e-4)


def test_more_text_scores_better_beside_the_base(spark):
    gains = []
    for sf in ("sf0.001", "sf0.01"):
        docs = language_model.score(table(spark, f"/root/testdata/{sf}", "documents"))
        gain = F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")
        gains.append(docs.filter("held_out").agg(gain).first()[0])
    assert gains[1] > gains[0] and gains[1] > 0.2


def test_feature_tables_do_not_pass_whole_through_the_driver(spark, monkeypatch):
    rows = 1 << 19
    whole = 2 * rows * (language_model.CLASSES + language_model.CELLS_PER_ROW)
    monkeypatch.setattr(language_model, "feature_rows", lambda distinct: rows)
    monkeypatch.setattr(language_model, "CHUNK", whole // 10, raising=False)
    docs = spark.createDataFrame([(n, f"a b c{n} d") for n in range(20)], "doc_id long, text string")
    tracemalloc.start()
    try:
        found = language_model.score(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < whole  # two copies of it before
    assert all(r["score"] < 0 and r["n_tokens"] == 5 for r in _rows(found))


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_a_shard_holds_about_its_part_of_the_tokens(shards):
    rng = np.random.default_rng(6)
    n, buckets = 300, rng.integers(1, 9, size=(2, language_model.ENDINGS, 4))
    counts = np.append(rng.integers(1, 200, size=n), 0)
    counts[:2] = 90_000, 40_000  # two words make up most of the text
    kinds = rng.integers(0, language_model.CLASSES, size=n + 1).astype(np.int8)
    zeros = np.zeros(n + 1, dtype=np.uint32)
    forks = language_model.Forks(language_model.Vocabulary({}, counts, kinds, zeros, kinds[:-1]), buckets)
    leaves = np.repeat(np.arange(len(forks.place)), np.diff(forks.upto))
    found = language_model.shard_of(forks, leaves, np.arange(len(leaves)), shards)
    assert np.bincount(found, minlength=shards).max() <= 2.1 * len(leaves) / shards
    # All that follows a word is learnt together, unless it is more than a shard.
    together = np.diff(forks.upto)[leaves] * shards <= len(leaves)
    met = np.unique(np.stack([leaves, found])[:, together], axis=1)
    assert len(np.unique(met[0])) == met.shape[1]


def test_tasks_hold_shards_that_do_not_grow(spark, monkeypatch):
    """The texts go to more shards, not to larger ones, and no shard's tables outgrow its size."""
    docs, made = table(spark, SF_DIR, "documents"), []
    dealt, learnt = language_model._dealt, language_model._learnt
    monkeypatch.setattr(language_model, "SHARD", 50_000)
    monkeypatch.setattr(language_model, "IN_SHARD", 2_000)
    monkeypatch.setattr(language_model, "_dealt", lambda *given: made.append(given[-1]) or dealt(*given))
    monkeypatch.setattr(language_model, "_learnt", lambda *given: made.append(given[-1]) or learnt(*given))
    found = [r for r in _check_scores(docs) if r["held_out"]]
    size = sum(len((t or "").encode()) + 1 for _, t in _texts(docs))
    assert made == [1 + size // 50_000, language_model.FEATURES] and made[0] > 5
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_sums_of_groups_of_any_size():
    rng = np.random.default_rng(5)
    table, keys = rng.normal(size=(50, 32)).astype(np.float32), np.sort(rng.zipf(1.3, size=900) % 400)
    order, starts, distinct = language_model._grouped(rng.permutation(keys).astype(np.int64))
    assert (distinct == np.unique(keys)).all() and sorted(order) == list(range(900))
    at = order % 50
    assert (language_model._sums_of(table, at, starts) == np.add.reduceat(table[at], starts, axis=0)).all()


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(language_model.FEATURES, language_model.CLASSES)).astype(np.float32)
    features = rng.integers(0, language_model.FEATURES, size=(9, 5))
    assert np.allclose(np.exp(language_model.Softmax(weights).logs(features)).sum(axis=1), 1, atol=1e-5)


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    """Each stage against what the operators' brute-force versions say of its input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(staged(stage(spark, steps[-1], SF_DIR), name))
        if name != "packed":
            assert steps[-1].columns == docs.columns
    known, unique, apart, mixed, packed = [s.collect() for s in steps[1:]]
    letters = {n for n, t in _texts(docs) if any(map(str.isalpha, t))}
    assert {r.doc_id for r in known} <= letters and len(known) >= 0.98 * len(letters)
    first: dict[str, int] = {}
    for r in sorted(known, key=lambda r: r.doc_id):
        first.setdefault(" ".join(f"|{r.text}|".split()), r.doc_id)
    assert {r.doc_id for r in unique} == set(first.values())
    groups = _components([(r.doc_id, r.text) for r in unique])
    assert {r.doc_id for r in apart} == {c for _, c in groups.values()}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in apart} and max(copies.values()) <= 3
    words = lambda rs: sum(len((r.text or "").encode().split()) for r in rs)
    assert 0.9 * words(apart) <= words(mixed) <= words(apart)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(packed)


@pytest.mark.parametrize("partitions", [1, 4])
def test_words_of_other_documents_are_no_company(spark, partitions):
    """Chained, the texts would put the end token beside `p`, which starts the next one."""
    texts = spark.createDataFrame([(n, "p q q") for n in range(40)], "doc_id long, text string")
    counts = {b"p": 40, b"q": 80, language_model.END: 40}
    words = language_model.learn_classes(texts.repartition(partitions), counts)
    assert words.classes[words.index[language_model.END]] == words.classes[words.index[b"q"]]


@pytest.mark.parametrize("rows, width", [(1, 1), (500, 1), (300, 32)])
def test_changes_in_bytes(rows, width):
    change = np.random.default_rng(3).normal(size=(rows, width)).astype(np.float32) ** 3
    change[0] = 0
    found = language_model.from_bytes(language_model.in_bytes(change), width)
    top = np.abs(change).max(axis=1, keepdims=True) if width > 1 else np.abs(change).max()
    # Half a step of the root, which is a 127th of that of the greatest.
    assert (np.abs(found - change) <= np.sqrt(np.abs(change) * top) / 127 + top / 127**2).all()
