"""Prefix trie of conversations, with totals of every subtree by time-forward processing.

A node is a sequence of first turns.  It is named by its depth and 128 bits: the exclusive or
of a hash of each of its turns with that turn's place, so the names along a conversation are
running values of a sum that can be taken in pieces.  Texts themselves are never shuffled.

Totals go from children to parents.  Nodes stand in reverse level order, sorted by Spark; a
node's record waits in a queue under its parent's name and meets the parent when that one's
turn comes.  What the queue cannot hold it writes down in sorted runs.

Nodes with many members are few.  Below them hang shards, subtrees of a bounded number of
conversations; these are worked off independently, then the few nodes above them in one more
pass, which gets the totals of shard roots already summed by parent.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.llm.shared import staged

# A conversation starts with up to this many turns of the first one of its five, less one.
SPAN, FIVE = 9, 5
# Turns of a conversation of which a running value is taken in one go.
STRETCH = 4096
# A shard has at most this many conversations, or turns / ABOVE of them if that is more; so the
# nodes above all shards, each of which has more members, are at most ABOVE.
MEMBERS, ABOVE = 1000, 100_000
# Records that a queue holds in memory, and those read back at once from a sorted run.
WAITING, BLOCK = 500_000, 50_000
# Conversation ids of one part of a digest.
LISTED = 50_000

NAME = ("depth", "s1", "s2")
NODE = (*NAME, "p1", "p2", "conv_id", "n_convs", "bytes", "children", "leaves", "saved", "e1", "e2", "e3", "e4")
DONE = (
    "depth long, p1 long, p2 long, conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, e1 long, e2 long, e3 long, e4 long, parent_conv_id long"
)
_EMPTY = np.frombuffer(hashlib.sha256(b"").digest(), dtype=">i8").astype(np.int64)


def _half(digest: Column, start: int) -> Column:
    """16 hexadecimal digits as a signed number."""
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns of the conversation), pos (from 1), a, b (content), bytes.

    Turns are dealt out in ranges, so a long conversation spreads over tasks; what its earlier
    parts hold is added to the place within the part.
    """
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    hashed = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        "turn",
        _half(digest, 1).alias("a"),
        _half(digest, 17).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["conv_id", "turn", "a", "b"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = hashed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    all_parts = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.select(
        "conv_id",
        "part",
        (F.sum("here").over(all_parts) - F.col("here") - F.col("first") + 1).alias("shift"),
        F.sum("here").over(Window.partitionBy("conv_id")).alias("n"),
    )
    return rows.join(parts, ["conv_id", "part"]).select(
        "conv_id", "n", (F.col("at") + F.col("shift")).alias("pos"), "a", "b", "bytes"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, depth, a, b, bytes), and every conv_id with its length."""
    rows = staged(ranked(turns), "ranked")
    sizes = rows.groupBy("conv_id").agg(F.first("n").alias("n"))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % FIVE).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string")) % SPAN
    )
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    sizes = sizes.join(of_base, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_n", F.lit(0)))
    )
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    sizes = staged(sizes.select("conv_id", "base", "h", "taken", length.alias("length")), "sizes")
    own = rows.join(sizes.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    heads = rows.filter((F.col("pos") < SPAN) & (F.col("conv_id") % FIVE == 0))
    heads = heads.select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "a", "b", "bytes")
    lent = heads.join(sizes.select("conv_id", "base", "taken"), "base").filter("depth <= taken")
    return own.unionByName(lent.select(own.columns)), sizes.select("conv_id", "length")


def paths(turns: DataFrame) -> DataFrame:
    """depth, s1, s2, p1, p2, conv_id, bytes, last: each node on each conversation's way, staged.

    The name of the parent is p1, p2 at the depth before.  The way starts at the root, whose name
    is zero; `last` marks its end.
    """
    rows, sizes = rebuilt(turns)
    rows = staged(
        rows.select(
            "conv_id",
            "depth",
            F.floor((F.col("depth") - 1) / STRETCH).alias("stretch"),
            F.xxhash64("a", "b", "depth").alias("y1"),
            F.xxhash64("depth", "b", "a").alias("y2"),
            "bytes",
        ),
        "rebuilt",
    )
    # What stretches before hold; only conversations of several stretches have any.
    long_ones = sizes.filter(F.col("length") > STRETCH).select("conv_id")
    whole = rows.join(long_ones, "conv_id", "left_semi").groupBy("conv_id", "stretch")
    whole = whole.agg(F.bit_xor("y1").alias("w1"), F.bit_xor("y2").alias("w2"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        "conv_id", "stretch", *[F.bit_xor(w).over(earlier).alias(c) for w, c in (("w1", "c1"), ("w2", "c2"))]
    )
    so_far = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("r1", F.bit_xor("y1").over(so_far)).withColumn("r2", F.bit_xor("y2").over(so_far))
    run = run.join(carried, ["conv_id", "stretch"], "left").join(sizes, "conv_id")
    s1, s2 = (F.col(f"r{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0).cast("long"))) for k in (1, 2))
    zero = F.lit(0).cast("long")
    nodes = run.select(
        "depth",
        s1.alias("s1"),
        s2.alias("s2"),
        s1.bitwiseXOR(F.col("y1")).alias("p1"),
        s2.bitwiseXOR(F.col("y2")).alias("p2"),
        "conv_id",
        "bytes",
        (F.col("depth") == F.col("length")).alias("last"),
    )
    roots = sizes.select(
        *[zero.alias(c) for c in ("depth", "s1", "s2", "p1", "p2")],
        "conv_id",
        zero.alias("bytes"),
        (F.col("length") == 0).alias("last"),
    )
    return staged(nodes.unionByName(roots), "paths")


def _digests(ends: DataFrame) -> DataFrame:
    """depth, s1, s2, e1 to e4: SHA-256 of the ids of the conversations that end at a node.

    The ids are sorted and joined in many tasks, whatever node they belong to.  Only the joined
    parts of one node then meet, and the digest takes them one at a time.
    """
    part = "depth long, s1 long, s2 long, first long, ids string"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = np.stack([batch.column(c).to_numpy() for c in NAME])
            ids = batch.column("conv_id").to_pylist()
            cuts = set((np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1).tolist())
            cuts = sorted(cuts | set(range(0, len(ids) + 1, LISTED)) | {len(ids)})
            starts = cuts[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(column[starts], pa.int64()) for column in name],
                    pa.array([ids[a] for a in starts], pa.int64()),
                    pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:])], pa.string()),
                ],
                names=[c.split()[0] for c in part.split(", ")],
            )

    digest = "depth long, s1 long, s2 long, e1 long, e2 long, e3 long, e4 long"

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done):
            names = np.array([name for name, _ in done], dtype=np.int64).reshape(-1, 3)
            ends = np.frombuffer(b"".join(d for _, d in done), dtype=">i8").astype(np.int64).reshape(-1, 4)
            columns = [pa.array(c) for c in np.concatenate([names, ends], axis=1).T]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in digest.split(", ")])

        current, state = None, None
        for batch in batches:
            done = []
            names = zip(*(batch.column(c).to_pylist() for c in NAME))
            for name, ids in zip(names, batch.column("ids").to_pylist()):
                if name == current:
                    state.update(b",")
                else:
                    if current is not None:
                        done.append((current, state.digest()))
                    current, state = name, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield rows(done)
        if current is not None:
            yield rows([(current, state.digest())])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NAME, "conv_id"]
    parts = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = parts.mapInArrow(listed, part).repartition(n, *NAME).sortWithinPartitions(*NAME, "first")
    return parts.mapInArrow(digested, digest)


def nodes(way: DataFrame) -> DataFrame:
    """The columns of NODE for every node, nothing received from children yet, staged."""
    merged = way.groupBy(*NAME).agg(
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("bytes").alias("bytes"),
    )
    ends = _digests(way.filter("last"))
    zero = F.lit(0).cast("long")
    return staged(
        merged.join(ends, list(NAME), "left").select(
            *NODE[:8],
            *[zero.alias(c) for c in ("children", "leaves", "saved")],
            *[F.coalesce(f"e{k + 1}", F.lit(int(_EMPTY[k]))).alias(f"e{k + 1}") for k in range(4)],
        ),
        "nodes",
    )


class Queue:
    """Records of one level that wait for their parents, in the order of the parents' names.

    A record is a row of numbers that starts with the parent's name.  Beyond `waiting` rows
    they are sorted and written to a file of the task, which has no name and goes with it.
    """

    def __init__(self, width: int, waiting: int = WAITING):
        self.width, self.waiting = width, waiting
        self.held: list[np.ndarray] = []
        self.size, self.in_order = 0, False
        self.runs: list[list] = []  # an open file and the block read from it last

    def put(self, rows: np.ndarray) -> None:
        if len(rows):
            self.held.append(rows)
            self.size, self.in_order = self.size + len(rows), False
        if self.size > self.waiting:
            file = tempfile.TemporaryFile()
            self._sorted().tofile(file)
            file.seek(0)
            self.runs.append([file, np.zeros((0, self.width), dtype=np.int64)])
            self.held, self.size = [], 0

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.held) if self.held else np.zeros((0, self.width), dtype=np.int64)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def take(self, upto: tuple[int, int]) -> np.ndarray:
        """The records whose parent's name is at most `upto`, sorted by it."""
        if self.held and not self.in_order:
            self.held, self.in_order = [self._sorted()], True
        out = []
        if self.held:
            early = self._early(self.held[0], upto)
            out.append(self.held[0][:early])
            self.held[0] = self.held[0][early:]
            self.size = len(self.held[0])
        for run in self.runs:
            while True:
                early = self._early(run[1], upto)
                out.append(run[1][:early])
                run[1] = run[1][early:]
                if len(run[1]):
                    break
                run[1] = np.fromfile(run[0], dtype=np.int64, count=BLOCK * self.width).reshape(-1, self.width)
                if not len(run[1]):
                    break
        rows = np.concatenate(out) if out else np.zeros((0, self.width), dtype=np.int64)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))] if self.runs else rows

    @staticmethod
    def _early(rows: np.ndarray, upto: tuple[int, int]) -> int:
        first = int(np.searchsorted(rows[:, 0], upto[0], "left"))
        last = int(np.searchsorted(rows[:, 0], upto[0], "right"))
        return first + int(np.searchsorted(rows[first:last, 1], upto[1], "right"))


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes from nodes in reverse level order, the columns of DONE.

    `above` marks nodes whose parent is not among these rows; they come without parent_conv_id.
    """
    names = [c.split()[0] for c in DONE.split(", ")]
    width = len(names) - 1  # a waiting record has all but the parent's id; p1, p2 lead

    def out(done: np.ndarray, parents: np.ndarray | None) -> pa.RecordBatch:
        depth_second = [2, 0, 1, *range(3, width)]
        columns = [pa.array(done[:, k]) for k in depth_second]
        last = pa.nulls(len(done), pa.int64()) if parents is None else pa.array(parents)
        return pa.RecordBatch.from_arrays([*columns, last], names=names)

    level, ready, growing = None, None, Queue(width)
    for batch in batches:
        table = np.stack([batch.column(c).to_numpy() for c in NODE], axis=1)
        above = batch.column("above").to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.diff(table[:, 0])) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(table)]):
            rows, outside = table[a:b], above[a:b]
            if rows[0, 0] != level:
                level, ready, growing = rows[0, 0], growing, Queue(width)
            s1, s2 = rows[:, 1], rows[:, 2]
            children = ready.take((int(s1[-1]), int(s2[-1])))
            gained = np.zeros((len(rows), 3), dtype=np.int64)
            if len(children):
                # Both are sorted by name: merge them and count on from each parent.
                order = np.lexsort(
                    (
                        np.repeat([0, 1], [len(rows), len(children)]),
                        np.concatenate([s2, children[:, 1]]),
                        np.concatenate([s1, children[:, 0]]),
                    )
                )
                is_node = order < len(rows)
                parent = order[is_node][np.cumsum(is_node) - 1][~is_node]
                kids = children[order[~is_node] - len(rows)]
                np.add.at(gained, (parent, 0), 1)
                np.add.at(gained, (parent, 1), kids[:, 6])
                np.add.at(gained, (parent, 2), kids[:, 7])
                yield out(kids, rows[parent, 5])
            n_children = rows[:, 8] + gained[:, 0]
            leaves = np.where(n_children == 0, 1, rows[:, 9] + gained[:, 1])
            saved = rows[:, 10] + gained[:, 2] + (rows[:, 6] - 1) * rows[:, 7]
            done = np.column_stack(
                [rows[:, 3], rows[:, 4], rows[:, 0], rows[:, 5], rows[:, 6], n_children, leaves, saved, rows[:, 11:15]]
            )
            growing.put(done[~outside])
            if outside.any():
                yield out(done[outside], None)


def _reverse_levels(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions(F.desc("depth"), "s1", "s2").select(*NODE, "above")


def build(turns: DataFrame, members: int = MEMBERS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.

    `turns` has conv_id, turn, role, text.  Rows without conv_id take no part.  Turns stand in
    order of `turn`, null first; turns with one number in the order of a digest of role and text, so
    reruns agree; repeated rows are further turns.  Null role and text are empty.  Remainders of
    negative ids have the sign of the id, as in SQL.  Without conversations there is no node, not
    even the root.  Other columns are ignored.

    `members` is the least bound of a shard's conversations.
    """
    spark = turns.sparkSession
    way = paths(turns)
    tree = nodes(way)
    limit = max(members, way.count() // ABOVE)
    many = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    # Every row of `way` is at one node and these have more than `limit` each: at most ABOVE and the root.
    heavy = staged(tree.filter(many), "heavy")
    names = F.broadcast(heavy.select(*NAME))
    parents = F.broadcast(
        heavy.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    )
    shards = (
        way.join(names, list(NAME), "left_anti")
        .join(parents, ["depth", "p1", "p2"], "left_semi")
        .select("conv_id", F.col("depth").alias("top"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = tree.filter(~many).join(shards, "conv_id").withColumn("above", F.col("depth") == F.col("top"))
    within = staged(_reverse_levels(light.repartition(n, "t1", "t2")).mapInArrow(forward, DONE), "within")
    shard_roots = within.filter("parent_conv_id is null")
    totals = shard_roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    totals = totals.agg(
        F.count("*").alias("got"), F.sum("n_leaves").alias("got_leaves"), F.sum("saved_tokens").alias("got_saved")
    )
    zero = F.lit(0).cast("long")
    upper = heavy.drop("children", "leaves", "saved").join(totals, list(NAME), "left")
    upper = upper.select(
        "*",
        F.coalesce("got", zero).alias("children"),
        F.coalesce("got_leaves", zero).alias("leaves"),
        F.coalesce("got_saved", zero).alias("saved"),
        (F.col("depth") == 0).alias("above"),
    )
    across = _reverse_levels(upper.repartition(1)).mapInArrow(forward, DONE)
    over = F.broadcast(
        heavy.select(
            (F.col("depth") + 1).alias("depth"),
            F.col("s1").alias("p1"),
            F.col("s2").alias("p2"),
            F.col("conv_id").alias("over"),
        )
    )
    below = within.join(over, ["depth", "p1", "p2"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "over")
    )
    hexed = [F.lpad(F.lower(F.hex(f"e{k}")), 16, "0") for k in range(1, 5)]
    return below.drop("over").unionByName(across).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.concat(*hexed).alias("ends_sha256"),
    )
