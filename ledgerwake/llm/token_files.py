"""Token ids in bit-packed blocks, each id in as few bits as the vocabulary needs.

A table of blocks is the file format: every row is one block of whole documents with the
packed ids, the ids of its documents and where each document ends.  A document's ids start
at bit `width * offset` of its block, so they can be read without the rest.  Spark writes
the blocks as Parquet, so they commit as a whole and lie wherever Spark can write.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwake.llm.shared import in_pieces, texts_of
from ledgerwake.llm.tokens import encoder

END_ID = 2
# A block closes once it has this many ids; a longer document makes a longer block.
BLOCK_IDS = 1 << 16

BLOCKS = pa.schema(
    [
        ("part", pa.int32()),
        ("first_doc", pa.int64()),
        ("last_doc", pa.int64()),
        ("part_start", pa.int64()),
        ("n_ids", pa.int64()),
        ("width", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int64())),
        ("packed", pa.binary()),
    ]
)
BLOCKS_DDL = (
    "part int, first_doc long, last_doc long, part_start long, n_ids long, width int,"
    " doc_ids array<long>, doc_ends array<long>, packed binary"
)


def width_of(largest_id: int) -> int:
    """Bits that the ids up to `largest_id` need."""
    return max(1, int(largest_id).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """The ids one after another, lowest bit first; eight ids take `width` bytes."""
    rows = -(-len(ids) // 8)
    wide = np.zeros(rows * 8, dtype=np.uint64)
    wide[: len(ids)] = ids
    wide = wide.reshape(rows, 8)
    out = np.zeros((rows, width), dtype=np.uint8)
    for n in range(8):
        first = n * width
        for byte in range(first // 8, (first + width - 1) // 8 + 1):
            shift = byte * 8 - first
            moved = wide[:, n] >> shift if shift >= 0 else wide[:, n] << -shift
            out[:, byte] |= (moved & 255).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack_bits(packed: bytes, width: int, start: int, count: int) -> np.ndarray:
    """`count` ids from the one numbered `start`; reads only the bytes that hold them."""
    skipped = start % 8
    first = (start - skipped) // 8 * width
    rows = -(-(skipped + count) // 8)
    raw = np.frombuffer(packed[first : first + rows * width], dtype=np.uint8)
    raw = np.pad(raw, (0, rows * width - len(raw))).reshape(rows, width).astype(np.uint32)
    out = np.zeros((rows, 8), dtype=np.uint32)
    for n in range(8):
        bit = n * width
        for byte in range(bit // 8, (bit + width - 1) // 8 + 1):
            shift = byte * 8 - bit
            out[:, n] |= raw[:, byte] << shift if shift >= 0 else raw[:, byte] >> -shift
    out &= np.uint32((1 << width) - 1)
    return out.reshape(-1)[skipped : skipped + count]


def write(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encodes every document and writes the blocks in ascending order of doc_id.

    Null text is empty: the end id alone.  A null doc_id comes first; rows that repeat an id
    are further documents, in order of text.  Other columns are ignored.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        top = max(tokenizer.tokenizer.get_vocab_size() - 1, end_id)
        part, width, done = TaskContext.get().partitionId(), width_of(top), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        names, ends, held, count = [], [], [], 0

        def block() -> pa.RecordBatch:
            packed = pack_bits(np.frombuffer(b"".join(held), dtype="<u4"), width)
            row = (part, names[0], names[-1], done, count, width, names, ends, packed)
            return pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, row))], schema=BLOCKS)

        for batch in in_pieces(batches, 500):
            found = tokenizer.encode(texts_of(batch))
            for name, ids in zip(batch.column("doc_id").to_pylist(), found):
                held.append(ids + end)
                count += len(held[-1]) // 4
                names.append(name)
                ends.append(count)
                if count >= block_ids:
                    yield block()
                    done += count
                    names, ends, held, count = [], [], [], 0
        if names:
            yield block()

    rows = docs.select("doc_id", "text")
    shuffled = rows.repartitionByRange(*_partitions(rows), "doc_id")
    in_order = shuffled.sortWithinPartitions("doc_id", "text")
    in_order.mapInArrow(blocks, BLOCKS_DDL).write.parquet(folder)


def _partitions(rows: DataFrame) -> tuple[int, ...]:
    return (int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks, each with `start`, the number of ids in all blocks before it."""
    blocks = spark.read.schema(BLOCKS_DDL).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        blocks.groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    return blocks.join(parts, "part").withColumn("start", F.col("before") + F.col("part_start"))


def fetch(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """doc_id, ids of one document; the filter on block bounds reaches the files."""
    near = read(spark, folder).filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return documents(near, with_ids=True).filter(F.col("doc_id") == doc_id)


def documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids of the documents in the blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["packed"], row["width"], 0, row["n_ids"]).astype("<u4")
                ends = np.array(row["doc_ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                parts = [ids[a:b] for a, b in zip(starts, ends)]
                arrays = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start"]),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    needed = ["start", "n_ids", "width", "doc_ids", "doc_ends", "packed"]
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return blocks.select(*needed).mapInArrow(unpack, ddl + (", ids array<long>" if with_ids else ""))
