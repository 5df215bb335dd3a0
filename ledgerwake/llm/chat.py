"""Chat formatting at token level, and reading the formatted conversations back.

Each turn becomes: id of `[INST]`, ids of the role, id of `[/INST]`, ids of the text, id of
`</s>`.  The three ids are reserved: they lie above the vocabulary, so no text can yield
them.  As the formatted text shows them as strings, the same strings inside a role or text
are escaped by a backslash after their first character; one more is added to strings that
have backslashes there, so that the escape can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.llm.shared import in_pieces
from ledgerwake.llm.tokens import encoder, token_bytes

OPEN, BODY, CLOSE = "[INST]", "[/INST]", "</s>"
LEARNT_ROLES = ("assistant",)
# A chunk of a conversation closes after the turn with which it has this many ids.
CHUNK_IDS = 1 << 15

CHUNKS = "conv_id long, part int, chunk int, n_ids long, ids binary, loss_mask binary"

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def mask_of(lengths: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Mask over segments laid end to end: +1 where a learnt one begins, -1 where it ends, summed up."""
    ends = np.cumsum(lengths)
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
    np.add.at(steps, (ends - lengths)[learnt], 1)
    np.add.at(steps, ends[learnt], -1)
    return np.cumsum(steps[:-1]).astype(bool)


def format_turns(
    turns: DataFrame, vocabulary: str, learnt_roles: tuple[str, ...] = LEARNT_ROLES
) -> DataFrame:
    """Chunks of formatted conversations: ids and loss mask, in order of part and chunk.

    `turns` has conv_id, turn, role and text.  Null role and text are empty, a null turn
    comes first, turns with one number stand in order of role and text, repeated rows are
    further turns, and rows without conv_id form one conversation.  An empty table gives an
    empty result; other columns are ignored.

    Turns are dealt out in ranges of conversation and turn, so a long conversation is spread
    over tasks.  A chunk holds whole turns.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = encoder(vocabulary, special_as_text=True), TaskContext.get().partitionId()
        top = tokenizer.tokenizer.get_vocab_size()
        marks = [np.array([top + n], dtype="<u4").tobytes() for n in range(3)]
        number, current, segments, learnt, size = 0, None, [], [], 0

        def chunk() -> pa.RecordBatch:
            lengths = np.array([len(s) // 4 for s in segments], dtype=np.int64)
            mask = np.packbits(mask_of(lengths, np.array(learnt))).tobytes()
            values = [current, part, number, size, b"".join(segments), mask]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)], names=names
            )

        for batch in in_pieces(batches, 1000):
            names, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            heads = tokenizer.encode([escape(r) for r in roles])
            bodies = tokenizer.encode([escape(t) for t in texts])
            for name, role, head, body in zip(names, roles, heads, bodies):
                if segments and (name != current or size >= CHUNK_IDS):
                    yield chunk()
                    number, segments, learnt, size = number + 1, [], [], 0
                current = name
                segments += [marks[0], head, marks[1], body, marks[2]]
                learnt += [False, False, False, role in learnt_roles, False]
                size += 3 + (len(head) + len(body)) // 4
        if segments:
            yield chunk()

    empty = F.lit("")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "conv_id", "turn", "role")
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(chunks, CHUNKS)


def _text(ids: np.ndarray, known: list[bytes]) -> str:
    return b"".join(map(known.__getitem__, ids.tolist())).decode()


def parse(ids: np.ndarray, mask: np.ndarray, known: list[bytes]) -> tuple[list, list, int]:
    """Turns as (role, text), the texts under the mask, and the length of the formatted text."""
    top = len(known)
    opens, bodies, closes = (np.flatnonzero(ids == top + n) for n in range(3))
    turns, length = [], 0
    for a, b, c in zip(opens, bodies, closes):
        role, text = _text(ids[a + 1 : b], known), _text(ids[b + 1 : c], known)
        length += len(role) + len(text) + len(OPEN) + len(BODY) + len(CLOSE)
        turns.append((unescape(role), unescape(text)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    learnt = [unescape(_text(ids[a:b], known)) for a, b in zip(edges[::2], edges[1::2])]
    return turns, learnt, length


def rendered(ids: np.ndarray, known: list[bytes]) -> str:
    """The formatted text, with the reserved ids as strings."""
    return _text(ids, [*known, OPEN.encode(), BODY.encode(), CLOSE.encode()])


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long"
)


def digests(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation, from its chunks alone: turns and learnt text as digests and lengths.

    A digest runs over a conversation's chunks in order, so these meet in one task; it holds
    one chunk at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state, out = token_bytes(vocabulary), None, []
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
             ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
             ("formatted_chars", pa.int64())]
        )

        def row():
            name, n, all_turns, chars, loss, length = state
            values = (name, n, all_turns.hexdigest(), chars, loss.hexdigest(), length)
            return dict(zip(schema.names, values))

        for batch in batches:
            for one in batch.to_pylist():
                if state is None or state[0] != one["conv_id"]:
                    if state is not None:
                        out.append(row())
                    state = [one["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(one["ids"], dtype="<u4")
                bits = np.frombuffer(one["loss_mask"], dtype=np.uint8)
                turns, learnt, length = parse(ids, np.unpackbits(bits)[: len(ids)], known)
                state[1] += len(turns)
                state[2].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                state[3] += sum(map(len, learnt))
                state[4].update("".join(learnt).encode())
                state[5] += length
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    together = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return together.mapInArrow(digest, DIGESTS)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings as content, from both sides."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
