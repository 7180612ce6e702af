"""Prefix trie over conversations in balanced parentheses, one range of conversations per shard.

A conversation is a path of turns; a turn is told by 16 bytes of the SHA-256 of its role and text, so that
texts never travel. Conversations are sorted by path and id and cut into ranges, the shards, however many
copies a path has. A shard writes its trie as balanced parentheses while it reads its rows, then answers from
that sequence alone: `findclose` over blocks with their least excess ends a node's subtree, rank over the leaf
pairs "()" counts its leaves, cumulative arrays over the nodes in order give its members and savings.

Only nodes on a shard's first and last path, its spines, can lie in other shards too. They leave the shard as
partial rows. A group-by adds up their members and tells which one is childless; each shard's spines then
take in what the spine nodes below them add, each in the first shard that has it; and a second group-by adds
up leaves, children and savings. Spines are a few rows per shard, whatever the number of conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from rolescope.llm import common

TURN_BYTES = 16
TURNS_PER_SHARD = 1 << 18
BLOCK = 256  # parentheses
IDS_PER_CHUNK = 1 << 16
ROWS_AT_ONCE = 1 << 15
NODE, SPINE, ENDS = 0, 1, 2
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
PARTS = ("kind int, shard int, key binary, parent_key binary, depth long, chain int, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved long, size long, has_child boolean, ends binary, ends_sha256 string, at long")
NAMES = [c.split()[0] for c in PARTS.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]
         for c in PARTS.split(", ")]


def prefix_turns(conv_id: str = "conv_id") -> Column:
    """How many leading turns a conversation takes from the first one of its hundred: CRC-32 of its decimal id, modulo 6."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % 6).cast("int")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's (key, size in code points) in order of turn, null first, ties by the key.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN_BYTES)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), F.unhex(key).alias("key"), F.length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of every conversation c, its first turns replaced by those of conversation c - c % 100.

    With h = `prefix_turns`: the first h turns of that conversation (all if fewer, none if there is none),
    then c's own turns after its first h. `%` keeps the sign of c.
    """
    own = common.written(conversations(turns), "conversations")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 5).alias("head"))
    h, none = prefix_turns(), F.array().cast(own.schema["turns"].dataType)
    return own.join(heads, own.conv_id - own.conv_id % 100 == F.col("head_id"), "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class Parentheses:
    """A balanced sequence, with the least and greatest excess of each block and of each pair of blocks above it."""

    def __init__(self, opens: np.ndarray):
        self.opens, self.n = opens, len(opens)
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int64)
        blocks = -(-self.n // BLOCK)
        leaves = 1 << max(0, (blocks - 1)).bit_length()
        padded = np.full(leaves * BLOCK, np.iinfo(np.int64).max)
        padded[: self.n] = self.excess
        self.least = np.full(2 * leaves, np.iinfo(np.int64).max)
        self.least[leaves:] = padded.reshape(leaves, BLOCK).min(axis=1)
        for i in range(leaves - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])
        self.leaves = leaves

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Positions of the parentheses that close those opened at `at`: the first place after each with an excess below it."""
        want = self.excess[at] - 1
        out = np.full(len(at), -1, np.int64)
        left, place = self._scan(out, np.arange(len(at)), at, want)
        if len(left):
            node = place // BLOCK - 1 + self.leaves  # its own block holds none: the next block to the right whose least is low enough
            climbing = np.ones(len(left), bool)
            while climbing.any():
                node = np.where(climbing & (node & 1 == 1), node >> 1, node)
                step = climbing & (node & 1 == 0)
                right = np.where(step, node + 1, node)
                found = step & (self.least[right] <= want[left])
                node = np.where(found, right, np.where(step, node >> 1, node))
                climbing &= ~found
            while (down := node < self.leaves).any():
                child = np.minimum(2 * node, 2 * self.leaves - 2)
                low = self.least[child] <= want[left]
                node = np.where(down, np.where(low, child, child + 1), node)
            self._scan(out, left, (node - self.leaves) * BLOCK, want)
        return out

    def _scan(self, out, left, place, want):
        """Walk to the end of each place's block; return those not found there, at the first place of the next."""
        beyond = [(left[:0], place[:0])]
        while len(left):
            hit = self.excess[np.minimum(place, self.n - 1)] <= want[left]
            out[left[hit]] = place[hit]
            over = ~hit & (place % BLOCK == BLOCK - 1)
            beyond.append((left[over], place[over] + 1))
            on = ~hit & ~over
            left, place = left[on], place[on] + 1
        return tuple(np.concatenate(c) for c in zip(*beyond))


class Shard:
    """The trie of one range of sorted conversations."""

    def __init__(self, shard: int):
        self.shard = shard
        self.opens: list[int] = [1]  # parentheses of a row: how many close, how many open
        self.closes: list[int] = [0]
        self.ids: list[int] = []
        self.node_of: list[int] = []  # where each row ends
        self.depth: list[int] = [0]
        self.parent: list[int] = [-1]
        self.size: list[int] = [0]
        self.stack = [0]
        self.first = self.last = b""

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        n, old = len(path) // TURN_BYTES, self.last
        if not self.ids:
            self.first = path
        same = 0
        if path == old:
            same = n
        else:
            while same < n and path[same * TURN_BYTES:(same + 1) * TURN_BYTES] == old[same * TURN_BYTES:(same + 1) * TURN_BYTES]:
                same += 1
        self.closes.append(len(self.stack) - 1 - same)
        self.opens.append(n - same)
        del self.stack[same + 1:]
        for d in range(same, n):
            self.parent.append(self.stack[-1])
            self.depth.append(d + 1)
            self.size.append(sizes[d])
            self.stack.append(len(self.depth) - 1)
        self.ids.append(conv_id)
        self.node_of.append(self.stack[-1])
        self.last = path

    def spines(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(nodes of the first and the last path, their keys, chain: 0 on both, 1 and 2 on one of them)."""
        def keys(path):
            own, out = hashlib.sha256(), [hashlib.sha256().digest()[:TURN_BYTES]]
            for i in range(0, len(path), TURN_BYTES):
                own.update(path[i:i + TURN_BYTES])
                out.append(own.copy().digest()[:TURN_BYTES])
            return out

        first = [*range(len(self.first) // TURN_BYTES + 1)]  # the first row opens the first nodes
        both = sum(a == b for a, b in zip(first, self.stack))
        last = keys(self.last)
        nodes = [*first, *self.stack[both:]]
        chain = [0] * both + [1] * (len(first) - both) + [2] * (len(self.stack) - both)
        return np.array(nodes), [*keys(self.first), *last[both:]], np.array(chain)

    def rows(self) -> Iterator[pa.RecordBatch]:
        closes, opens = np.array([*self.closes, len(self.stack)]), np.array([*self.opens, 0])
        bits = np.repeat(np.tile([False, True], len(opens)), np.stack([closes, opens], 1).ravel())
        trie = Parentheses(bits)
        start = np.flatnonzero(bits)
        close = trie.findclose(start)
        n, parent = len(start), np.array(self.parent)
        beyond = np.arange(n) + (close - start + 1) // 2  # the first node after the subtree
        spine, keys, chain = self.spines()
        own = np.ones(n, bool)
        own[spine] = False
        # rank over leaf pairs; one at the tip of a spine may have children elsewhere and is left to the merge
        pair = np.append(bits[:-1] & ~bits[1:], False)
        pair[start[spine]] = False
        rank = np.append(0, np.cumsum(pair))
        leaves = rank[close] - rank[start]
        node_of = np.array(self.node_of)
        ends = np.append(0, np.cumsum(np.bincount(node_of, minlength=n)))
        members = ends[beyond] - ends[:-1]
        size = np.array(self.size, np.int64)
        savings = np.append(0, np.cumsum(np.where(own, (members - 1) * size, 0)))
        saved = savings[beyond] - savings[:-1]
        children = np.bincount(parent[own], minlength=n)
        ids = np.array(self.ids, np.int64)
        # the rows of a subtree lie together; the sentinel stands behind the last
        least = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), np.stack([ends[:-1], ends[beyond]], 1).ravel())[::2]
        depth = np.array(self.depth)
        key_of = dict(zip(spine.tolist(), keys))

        inner = np.flatnonzero(own)
        for at in range(0, len(inner), ROWS_AT_ONCE):
            k = inner[at:at + ROWS_AT_ONCE]
            above = parent[k]
            outer = ~own[above]
            yield self.batch(
                len(k), kind=NODE, depth=depth[k], conv_id=least[k], parent_key=[key_of.get(p) for p in above.tolist()],
                parent_conv_id=pa.array(least[above], mask=outer), n_convs=members[k], n_children=children[k], n_leaves=leaves[k], saved=saved[k],
                ends_sha256=[self.digest(ids[ends[i]:ends[i + 1]]) for i in k.tolist()])
        has_child = trie.opens[np.minimum(start + 1, trie.n - 1)]
        up = parent[spine]
        yield self.batch(
            len(spine), kind=SPINE, key=keys, parent_key=[key_of.get(p) for p in up.tolist()], depth=depth[spine], chain=chain,
            conv_id=least[spine], n_convs=members[spine], n_children=children[spine], n_leaves=leaves[spine], saved=saved[spine],
            size=size[spine], has_child=has_child[spine])
        for i, key in zip(spine.tolist(), keys):
            for at in range(ends[i], ends[i + 1], IDS_PER_CHUNK):
                text = ",".join(map(str, ids[at:min(at + IDS_PER_CHUNK, ends[i + 1])].tolist()))
                yield self.batch(1, kind=ENDS, key=[key], ends=[text.encode()], at=[at])

    @staticmethod
    def digest(ids: np.ndarray) -> str:
        return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else NO_MEMBERS

    def batch(self, n: int, kind: int, **columns) -> pa.RecordBatch:
        columns["kind"], columns["shard"] = np.full(n, kind), np.full(n, self.shard)
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)).cast(t)
             for c, t in zip(NAMES, TYPES)], NAMES)


def _shard(batches: Iterator[pa.RecordBatch]):
    shard = Shard(TaskContext.get().partitionId())
    for batch in batches:
        sizes = batch.column("sizes")
        at, values = sizes.offsets.to_numpy(), sizes.values.to_numpy(zero_copy_only=False)
        for i, (path, conv_id) in enumerate(zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())):
            shard.add(path, values[at[i]:at[i + 1]].tolist(), conv_id)
    if shard.ids:
        yield from shard.rows()


def _digests(batches: Iterator[pa.RecordBatch]):
    """Chunks come sorted by key, shard and place; a key's digest streams over them."""
    key, own, out = None, None, []
    for batch in batches:
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends")):
            if k != key:
                if key is not None:
                    out.append((key, own.hexdigest()))
                key, own = k, hashlib.sha256()
            else:
                own.update(b",")
            own.update(ends.as_py())
        if len(out) >= ROWS_AT_ONCE:
            yield pa.RecordBatch.from_pylist([{"key": k, "ends_sha256": d} for k, d in out])
            out = []
    if key is not None:
        out.append((key, own.hexdigest()))
    if out:
        yield pa.RecordBatch.from_pylist([{"key": k, "ends_sha256": d} for k, d in out])


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """A row per distinct prefix of the conversations (conv_id, turns array of (key binary, size long)).

    conv_id: the least member; depth; parent_conv_id (root: null); n_convs: members, that is conversations
    that start with the prefix; n_children; n_leaves: childless nodes of the subtree, itself included;
    saved_tokens: over the subtree, (n_convs - 1) times the size of the node's last turn; ends_sha256: of the
    decimal ids of the members that end there, ascending, joined by commas. A conversation without turns is a
    member of the root alone. Repeated ids are members as often as they occur. No conversations, no rows.
    Long conversations are one row of about 24 bytes a turn.
    """
    spark = convs.sparkSession
    rows = common.written(convs.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"), "conv_id"), "trie-paths")
    if shards is None:
        n_turns = rows.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
        shards = max(-(-n_turns // TURNS_PER_SHARD), min(spark.sparkContext.defaultParallelism, -(-n_turns // 4096)), 1)
    sorted_rows = rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = common.written(sorted_rows.mapInArrow(_shard, PARTS), "trie-parts")

    spine = parts.where(f"kind = {SPINE}")
    total = common.written(spine.groupBy("key").agg(
        F.sum("n_convs").alias("members"), F.min("conv_id").alias("least"), F.max("has_child").alias("inner"), F.min("shard").alias("home")), "trie-spines")
    placed = spine.join(total, "key")
    home = F.col("shard") == F.col("home")
    below = W.partitionBy("shard").orderBy(F.desc("depth")).rangeBetween(W.unboundedPreceding, W.currentRow)
    below_on_chain = W.partitionBy("shard", "chain").orderBy(F.desc("depth")).rangeBetween(W.unboundedPreceding, W.currentRow)

    def with_spine(name: str, adds: Column) -> Column:
        adds = F.when(home, adds).otherwise(0)
        return (F.col(name) + F.when(F.col("chain") == 0, F.sum(adds).over(below)).otherwise(F.sum(adds).over(below_on_chain))).alias(name)

    sums = placed.select(
        "key", "parent_key", "depth", "home", "shard", "n_children", with_spine("n_leaves", F.when(F.col("inner"), 0).otherwise(1)),
        with_spine("saved", (F.col("members") - 1) * F.col("size")))
    zero = F.lit(0).cast("long")
    added = (sums.select("key", "depth", "parent_key", "n_children", "n_leaves", "saved")
             .unionByName(sums.where(home & F.col("parent_key").isNotNull()).select(
                 F.col("parent_key").alias("key"), zero.alias("depth"), F.lit(None).cast("binary").alias("parent_key"), F.lit(1).cast("long").alias("n_children"),
                 zero.alias("n_leaves"), zero.alias("saved")))
             .groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.sum("n_children").alias("n_children"),
                                 F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    ends = (parts.where(f"kind = {ENDS}").select("key", "shard", "at", "ends").repartition("key").sortWithinPartitions("key", "shard", "at")
            .mapInArrow(_digests, "key binary, ends_sha256 string"))
    parents = total.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_conv_id"))
    merged = (added.join(total, "key").join(parents, "parent_key", "left").join(ends, "key", "left")
              .select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256")))

    columns = merged.columns
    nodes = parts.where(f"kind = {NODE}").withColumnRenamed("saved", "saved_tokens")
    # by shard and spine node: a group of this join is never larger than a shard
    spine_least = placed.select("shard", F.col("key").alias("parent_key"), "least")
    hung = (nodes.where("parent_key is not null").join(spine_least, ["shard", "parent_key"])
            .withColumn("parent_conv_id", F.col("least")))
    return merged.unionByName(nodes.where("parent_key is null").select(columns)).unionByName(hung.select(columns))
