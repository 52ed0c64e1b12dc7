"""Prefix trie of conversations with subtree totals by leaf-peeling messages.

Turns are numbered within their conversation, digested, and each prefix gets a 128-bit key: the exclusive-or of the
hashes of (place, digest), so keys are running totals and the parent's key is the key without the last turn. Grouping by
key gives the nodes. Nodes are gathered into paths for the messages: a node belongs to its member with the least hash of
its id, so the nodes of a path follow each other downwards, and as these hashes are in random order any way from a leaf
to the root changes paths about ln(conversations) times at most. Paths hold counters of the paths that hang on them; in
each round those without any left send their totals to their parents, until only the root's path finishes. Totals of the
nodes follow by running sums up each path.

A long conversation, a common turn, a node with many children and a node where many conversations end are all met:
running totals go over ranges of rows, frequent keys are broadcast, and the digest of ends reads blocks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .running import hot_join, running

NODE = ["depth", "k1", "k2"]
UP = [F.col("up_depth").alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")]
NONE_SHA = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), digest, chars of every turn, by turn (null first), ties by the digest of role and text.

    Null roles and texts are empty. Rows without a conversation's id belong to none and are left out.
    """
    role_, text_ = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = conversations.select(conversations[conv].cast("long").alias("conv_id"), conversations[turn].alias("turn"), digest.alias("digest"), F.length(text_).cast("long").alias("chars"))
    rows = rows.where("conv_id IS NOT NULL")
    return running(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("digest")], {"place": F.lit(1)}).select("conv_id", "place", "digest", "chars")


def rebuilt(own: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each conversation c took over the beginning of another one.

    h = unsigned crc32 of the decimal c, modulo ``most``. The first h turns of conversation c - c % block come first (all of
    them if fewer, none if absent), then c's own turns after its first h. conversations: conv_id, h, n_heads, len;
    turns: conv_id, depth, digest, chars, len.
    """
    sizes = own.groupBy("conv_id").agg(F.max("place").alias("own_len"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    # most - 1 turns of a conversation at most
    heads = own.where((F.col("place") < most) & (F.col("conv_id") % block == 0)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("heads"))
    heads = heads.select(F.col("conv_id").alias("_base"), "heads")
    convs = sizes.withColumn("h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % block).join(heads, "_base", "left").drop("_base")
    convs = convs.withColumn("heads", F.slice(F.coalesce("heads", F.array()), F.lit(1), F.col("h").cast("int"))).withColumn("n_heads", F.size("heads").cast("long"))
    convs = materialise(convs.withColumn("len", F.col("n_heads") + F.greatest(F.col("own_len") - F.col("h"), F.lit(0))), "trie-conversations")
    first = convs.select("conv_id", F.explode("heads").alias("t"), "len").select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.chars", "len")
    rest = hot_join(own, convs.drop("heads"), ["conv_id"], "own_len").where("place > h")
    rest = rest.select("conv_id", (F.col("n_heads") + F.col("place") - F.col("h")).alias("depth"), "digest", "chars", "len")
    return convs, first.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, up_depth, up1, up2, chars, len: the node of each prefix of each conversation, and its parent."""
    hashed = turns.select("conv_id", "depth", F.xxhash64(F.lit(1), "depth", "digest").alias("z1"), F.xxhash64("digest", "depth", F.lit(2)).alias("z2"), "chars", "len")
    keyed = running(hashed, "conv_id", [F.col("depth")], xors={"k1": F.col("z1"), "k2": F.col("z2")})
    up = [(F.col("depth") - 1).alias("up_depth"), F.col("k1").bitwiseXOR(F.col("z1")).alias("up1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("up2")]
    return keyed.select("conv_id", *NODE, *up, "chars", "len")


def trie_nodes(convs: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node: key, parent's key, conv_id, n_convs, path, chars, n_children. No conversation, no node."""
    led = F.min(F.struct(F.xxhash64("conv_id"), "conv_id"))["conv_id"].alias("path")
    some = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), led]
    inner = members.groupBy(*NODE, "up_depth", "up1", "up2").agg(*some, F.max("chars").alias("chars"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(*some).where("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("up_depth"), none.alias("up1"), none.alias("up2"), "conv_id", "n_convs", "path", zero.alias("chars"))
    nodes = materialise(inner.unionByName(root), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy(*UP).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def peeled(paths: DataFrame) -> DataFrame:
    """paths with leaves and saved of whole subtrees. paths: path, up_path (null: the root's), waiting, leaves, saved, ...

    waiting counts the paths that hang on a path. Paths that wait for none send their totals up and are finished; those
    sums arrive with a count. Ends when no path is left, as each round finishes all paths at the bottom.
    """
    finished, open_ = [], materialise(paths, "trie-paths")
    while not open_.isEmpty():
        done = open_.where("waiting = 0")
        finished.append(done)
        sent = done.where("up_path IS NOT NULL").groupBy(F.col("up_path").alias("path")).agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        got = open_.where("waiting > 0").join(sent, "path", "left")
        plus = {"waiting": F.col("waiting") - F.coalesce("_n", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("_saved", F.lit(0))}
        open_ = materialise(got.withColumns(plus).drop("_n", "_leaves", "_saved"), "trie-paths")
    out = finished[0] if finished else open_
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the ids that end in each node, ascending, joined by commas.

    Ids are distinct, so those of a block of 65,536 values are few; blocks are joined one after the other by a running
    digest, whatever the number of ids of a node.
    """
    block = F.shiftright("conv_id", 16).alias("block")
    blocks = ends.groupBy(*NODE, block).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())], [*NODE, "ends_sha256"])

        for got in batches:
            for *node, ids in zip(*(got.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield batch()
        if at is not None:
            out.append((*at, digest.hexdigest()))
        yield batch()

    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return ordered.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 100, most: int = 6) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (see numbered_turns and rebuilt).

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id (root: null); n_convs: members; n_children;
    n_leaves: childless nodes of the subtree; saved_tokens: over the subtree, (n_convs - 1) times the code points of a
    node's last text; ends_sha256: of the members that end here. Repeated rows of a conversation are turns of it. A
    conversation all of whose turns go has none and ends in the root. An empty table gives no rows, not even a root.
    """
    own = materialise(numbered_turns(conversations, conv, turn, role, text), "trie-turns")
    convs, turns = rebuilt(own, block, most)
    members = materialise(prefixes(turns), "trie-members")
    nodes = materialise(trie_nodes(convs, members), "trie-nodes")

    above = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up_path"), F.col("n_children").alias("_kids")).where("_kids > 0")
    below = nodes.where("depth > 0").select(*UP, F.struct(*nodes.columns).alias("node"))
    linked = hot_join(below, above, NODE, "_kids").select("node.*", "parent_conv_id", "up_path")
    empty = F.lit(None).cast("long")
    linked = linked.unionByName(nodes.where("depth = 0").withColumns({"parent_conv_id": empty, "up_path": empty}))
    own_saved, leaf = (F.col("n_convs") - 1) * F.col("chars"), (F.col("n_children") == 0).cast("long")
    linked = materialise(linked.withColumns({"saved": own_saved, "leaf": leaf}), "trie-linked")

    top = F.min(F.struct("depth", "up_path", "up_depth", "up1", "up2")).alias("top")
    paths = linked.groupBy("path").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), top).select("path", "saved", "leaves", "top.up_path", "top.up_depth", "top.up1", "top.up2")
    waiting = paths.where("up_path IS NOT NULL").groupBy(F.col("up_path").alias("path")).agg(F.count(F.lit(1)).alias("waiting"))
    whole = peeled(paths.join(waiting, "path", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0))))

    sent = whole.where("up_path IS NOT NULL").groupBy(*UP).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    held = linked.join(sent, NODE, "left")
    plus = {"n_leaves": F.col("leaf") + F.coalesce("_leaves", F.lit(0)), "saved_tokens": F.col("saved") + F.coalesce("_saved", F.lit(0))}
    summed = running(held.select(*NODE, "path", "conv_id", "parent_conv_id", "n_convs", "n_children", *(v.alias(f"own_{k}") for k, v in plus.items())), "path", [F.desc("depth")], {k: F.col(f"own_{k}") for k in plus})
    root = [F.lit(0).cast("long").alias(c) for c in NODE]
    ends = members.where("depth = len").select(*NODE, "conv_id").unionByName(convs.where("len = 0").select(*root, "conv_id"))
    out = summed.join(ends_digest(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE_SHA)).alias("ends_sha256"))
