"""Prefix trie of conversations by splitter-skeleton.

A conversation is a path of turns; a node of the trie is a distinct sequence of first turns. Texts are reduced to digests of
their turn where they are read. Equal paths are counted together, then distinct paths are dealt to shards by range: the
splitters are quantiles of a sample, so all members of a node lie side by side, and only a node that is a prefix of a splitter
can have members in two shards. Those nodes are the skeleton. The splitter paths, which are its trie, are broadcast.

Each shard is sorted and streamed with a stack of the nodes on the current path. A node that is no prefix of either
splitter next to its shard is finished there, its subtree with it. A node of the skeleton emits the partial aggregates of its shard,
which are reduced by node; the skeleton, bounded by the splitters, is then summed from the bottom up.

The digest over the ids that end in a node is a sequential hash. The ids are ordered by range over all tasks, those of a path that
lies in one task are hashed there, and those of a path that goes on in other tasks are handed on as text, in pieces, and
hashed in order without being held.

One conversation is a path of 32 bytes a turn, and is held as a whole; its texts are not. Nothing else is held: equal
conversations, conversations with equal beginnings and children of one node may be any number.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import durable

WORDS = r"[^\x20\x09-\x0D]+"
FAMILY = 20  # conversations of a family share the beginning of its first one
STEP = 32  # characters of a turn in a path
SHARD_ROWS = 100_000
SAMPLES = 20  # splitter candidates for each shard
SAMPLE_BYTES = 64 << 20  # of all candidates together, so that splitters can be broadcast
PIECE = 4096  # ids that are handed on as one text

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
LOCAL = f"{NODE}, skeleton boolean, node_key string, parent_key string, words long"
EMPTY = hashlib.sha256(b"").hexdigest()


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def conversation_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests of the rebuilt turns, one after the other), words (of each turn's text).

    Turns are ordered by turn, null first; ties by the digest of role and text. Null roles and texts count as empty, and repeated rows are
    turns of their own. Rows without conv_id belong to no conversation and are left out. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        _base(F.col("conv_id").cast("bigint")).alias("base"),
        F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words")).alias("turn"),
    )
    # dealt by family: grouping by conversation and the look at the family's first one need no other shuffle
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 3)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    head = F.slice(F.coalesce(F.col("head"), F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    tail = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    rebuilt = own.withColumns({"head": first, "h": h}).withColumn("all", F.concat(head, tail))
    return rebuilt.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["digest"]), "").alias("path"),
        F.transform("all", lambda t: t["words"]).alias("words"),
    )


# ---- digests of the ids that end in a path ----------------------------------------------------------


def _ends(paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """key, ends_sha256: the SHA-256 of the ids with each path, ascending and joined by commas."""
    ordered = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    schema = "key string, part int, at long, text string, ends_sha256 string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the paths inside this task; the ids of its first and last path as text, as they may go on elsewhere."""
        part, at, current, first, held = TaskContext.get().partitionId(), 0, None, True, []
        texts: list[str] = []  # of the current path
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal at
            if current is None:
                return
            if held:
                texts.append(",".join(held))
            if first or last:
                for text in texts:
                    out.append((current, part, at, text, None))
                    at += 1
            else:
                out.append((current, part, 0, None, hashlib.sha256(",".join(texts).encode()).hexdigest()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "part", "at", "text", "ends_sha256"])
            out.clear()
            return made

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != current:
                    close(False)
                    if current is not None:
                        first = False
                    current, held, texts = key, [], []
                held.append(str(conv))
                if len(held) == piece:
                    texts.append(",".join(held))
                    held = []
                    if first:  # certainly an edge: handed on at once
                        out.extend((current, part, at + i, t, None) for i, t in enumerate(texts))
                        at += len(texts)
                        texts = []
            if len(out) > 1000:
                yield batch_of()
        close(True)
        yield batch_of()

    made = durable(ordered.mapInArrow(pieces, schema), "ends")
    open_ends = made.filter("text is not null").repartition("key").sortWithinPartitions("key", "part", "at")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if key != current:
                    if current is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if current is not None:
            done.append((current, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["key", "ends_sha256"])

    whole = made.filter("text is null").select("key", "ends_sha256")
    return whole.unionByName(open_ends.mapInArrow(joined, "key string, ends_sha256 string"))


# ---- shards and skeleton ------------------------------------------------------------------------------


def common(a: str, b: str) -> int:
    """Turns that two paths have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // STEP
    low, high = 0, n // STEP  # the first turns of a sorted neighbour agree often: halve instead of walking
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * STEP] == b[: middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


def key_of(prefix: str) -> str:
    return hashlib.md5(prefix.encode()).hexdigest()


def _splitters(paths: DataFrame, shards: int, n: int, size: int) -> list[str]:
    """Quantiles of a sample of the distinct paths, by hash of the path; its size is bounded in rows and in bytes."""
    share = min(1.0, SAMPLES * shards / max(n, 1), SAMPLE_BYTES / max(size, 1))
    chosen = paths.filter(F.pmod(F.xxhash64("path"), F.lit(1 << 20)) < F.lit(max(1, round(share * (1 << 20)))))
    sample = sorted(r.path for r in chosen.select("path").distinct().collect())
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []


class _Node:
    __slots__ = ("skeleton", "words", "n", "first", "children", "leaves", "saved", "kids", "ends")

    def __init__(self, skeleton: bool, words: int):
        self.skeleton, self.words = skeleton, words
        self.n = self.children = self.leaves = self.saved = 0
        self.first, self.kids, self.ends = None, [], EMPTY


class _Shard:
    """The nodes of one sorted shard: ``add`` takes its paths in order, ``out`` gathers finished rows."""

    def __init__(self, lower: str | None, upper: str | None, out: list[tuple]):
        self.edges = [x for x in (lower, upper) if x is not None]
        self.out, self.path = out, ""
        self.stack = [_Node(True, 0)]  # the root is a prefix of everything

    def add(self, path: str, n: int, first: int, words: list[int], ends: str) -> None:
        shared = common(self.path, path)
        while len(self.stack) - 1 > shared:
            self._finish()
        shown = max((common(path, e) for e in self.edges), default=0)
        for depth in range(len(self.stack), len(path) // STEP + 1):
            self.stack.append(_Node(depth <= shown, words[depth - 1]))
        self.path = path
        top = self.stack[-1]
        top.n, top.ends = top.n + n, ends
        top.first = first if top.first is None else min(first, top.first)

    def close(self) -> None:
        while self.stack:
            self._finish()

    def _finish(self) -> None:
        node = self.stack.pop()
        depth = len(self.stack)
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.n += node.n
            parent.first = node.first if parent.first is None else min(node.first, parent.first)
        if node.skeleton:
            above = key_of(self.path[: (depth - 1) * STEP]) if depth else None
            row = (node.first, depth, None, node.n, node.children, node.leaves, node.saved, node.ends)
            self.out.append((*row, True, key_of(self.path[: depth * STEP]), above, node.words))
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.words
        for kid in node.kids:
            self.out.append((kid[0], kid[1], node.first, *kid[2:], False, None, None, None))
        row = (node.first, depth, node.n, node.children, leaves, saved, node.ends)
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        if parent.skeleton:  # its smallest member is known only after the reduction
            self.out.append((*row[:2], None, *row[2:], False, None, key_of(self.path[: (depth - 1) * STEP]), None))
        else:
            parent.kids.append(row)


NAMES = [c.split()[0] for c in LOCAL.split(", ")]
KINDS = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in LOCAL.split(", ")]


def _local_nodes(dealt: DataFrame, splitters) -> DataFrame:
    """Finished nodes of all shards, and the partial aggregates of the skeleton (``skeleton``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, out, current, shard = splitters.value, [], None, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(NAMES)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)
            out.clear()
            return made

        for batch in batches:
            for number, path, n, first, words, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if number != current:
                    if shard is not None:
                        shard.close()
                    current = number
                    shard = _Shard(cuts[number - 1] if number else None, cuts[number] if number < len(cuts) else None, out)
                shard.add(path, n, first, words, ends)
            if len(out) >= 10_000:
                yield flush()
        if shard is not None:
            shard.close()
        yield flush()

    return dealt.mapInArrow(work, LOCAL)


def _skeleton_nodes(partials: list) -> list[tuple]:
    """(key, row of a node) for the skeleton: partial aggregates of all shards summed from the bottom up."""
    nodes = {r.node_key: r.asDict() for r in partials}
    for key, x in sorted(nodes.items(), key=lambda i: -i[1]["depth"]):
        if not x["n_children"]:
            x["n_leaves"] = 1
        x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
        above = nodes.get(x["parent_key"])
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += x["n_leaves"]
            above["saved_tokens"] += x["saved_tokens"]
    names = [c.split()[0] for c in NODE.split(", ")]
    for x in nodes.values():
        x["parent_conv_id"] = nodes[x["parent_key"]]["conv_id"] if x["parent_key"] else None
    return [(key, *[x[c] for c in names]) for key, x in nodes.items()]


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; no row for a table without conversations.

    Every conversation c begins with the first h turns of conversation ``c - c % 20`` (none if it is absent), h = crc32(c) % 4, and goes on with its own
    turns after its first h. Columns as in ``NODE``; the smallest member and the depth name a node.
    """
    spark = turns.sparkSession
    paths = durable(conversation_paths(turns).withColumn("key", F.md5("path")), "paths")
    n, size = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("path")), F.lit(0))).head()
    if not n:
        return spark.createDataFrame([], NODE)
    shards = shards or max(2 * spark.sparkContext.defaultParallelism, -(-n // SHARD_ROWS))
    cuts = _splitters(paths, shards, n, size)
    splitters = spark.sparkContext.broadcast(cuts)  # bounded by SAMPLE_BYTES

    @F.arrow_udf("int")
    def shard_of(path: pa.Array) -> pa.Array:
        cuts = splitters.value
        return pa.array([bisect_right(cuts, p) for p in path.to_pylist()], pa.int32())

    distinct = paths.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.first("path").alias("path"), F.first("words").alias("words")
    )
    whole = distinct.join(_ends(paths), "key").select("path", "n", "first", "words", "ends_sha256")
    dealt = (
        whole.withColumn("shard", shard_of("path"))
        .repartition("shard")
        .sortWithinPartitions("shard", "path")
        .select("shard", "path", "n", "first", "words", "ends_sha256")
    )
    made = durable(_local_nodes(dealt, splitters), "nodes")
    summed = made.filter("skeleton").groupBy("node_key", "parent_key", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"),
        F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))).alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    rows = summed.withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).drop("ends").collect()  # no more than the splitters have turns
    skeleton = spark.createDataFrame(_skeleton_nodes(rows), f"node_key string, {NODE}")
    names = [c.split()[0] for c in NODE.split(", ")]
    local = made.filter("not skeleton")
    known = local.filter("parent_key is null").select(*names)
    above = skeleton.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent"))
    under = local.filter("parent_key is not null").drop("node_key").join(above, "parent_key")
    return known.unionByName(under.withColumn("parent_conv_id", F.col("parent")).select(*names)).unionByName(skeleton.select(*names))
