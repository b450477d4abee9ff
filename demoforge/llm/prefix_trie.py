"""The trie of all conversation prefixes, by van Emde Boas recursion.

A sequence of turns is cut at half its (rounded up) depth, the upper part
again, and so are the lower parts, each under the name of the prefix above it.
All parts of one size are worked on in one job, so a trie of depth D takes
about log2(D) jobs each way and no job handles a whole conversation:

* ``_segments`` gives every aligned half a digest of its turns, from the digests
  of its own two halves;
* ``_prefixes`` goes from the whole depth to single turns: the name of the cut
  prefix is the digest of the name above and of the half between, and the part
  below continues from that name (128 bits of SHA-256; equal names are taken as
  equal prefixes);
* ``_grafted`` goes back: the totals of the lower parts are summed on the prefix
  they hang from and added to all of that prefix's ancestors inside the upper
  part, which are found by one of the prefix's members.

A node is known by its depth and its smallest member.  Positions, names and
totals are keyed by (conversation, position) or by node; a conversation, a first
turn or a node that holds a third of all rows is combined before the shuffle or
joined on plain exchanges, which adaptive execution splits.  The member list of
a node is hashed as a stream of chunks of at most 4,096 ids.

Nulls: a null role or text is the empty text, null turns come first, rows
without a conv_id belong to no conversation and are left out.  Rows of equal
turn follow each other by the digest of role and text, and repeated rows are
repeated turns.  Texts are hashed whole, whatever their length.  An empty table
has no nodes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoforge.llm.common import Workspace
from demoforge.operators.windows import dense_index

#: member ids of a node are joined in ranges of 2**CHUNK_BITS ids
CHUNK_BITS = 12

NODE_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
               "saved_tokens long, ends_sha256 string")


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), key (digest of role and text), size (code points of
    the text) of every turn.  Texts stay where they are read."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"),
                role.cast("binary"), text.cast("binary")).alias("key"),
        F.char_length(text).cast("long").alias("size"),
    ).filter("conv IS NOT NULL")
    return dense_index(turns, "turn", by=["conv"], out="pos", tiebreak=["key"]).select("conv", "pos", "key", "size")


def shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with beginnings taken from others: conversation c
    gets the first h turns of conversation ``c - c % every``, then its own
    turns after its first h; h is the CRC-32 of the decimal c modulo ``most``."""
    convs = turns.select("conv").distinct().select(
        "conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"),
        (F.col("conv") - F.col("conv") % every).alias("base"))
    # at most `most` - 1 turns of a base, at most 2 * every - 1 conversations on it
    heads = turns.filter((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base")
    counts = heads.groupBy("base").agg(F.count("*").alias("n"))
    convs = convs.join(counts, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))).drop("n")
    first = convs.join(heads, "base").filter("pos < h").select("conv", "pos", "key", "size")
    rest = turns.join(convs.select("conv", "h", "taken"), "conv").filter("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "size")
    return first.unionByName(rest), convs.select("conv")


def _segments(ws: Workspace, turns: DataFrame, depth: int) -> dict[int, DataFrame]:
    """size -> (conv, pos, key) of the whole aligned segments of that size that
    are upper halves, for sizes 1, 2, 4, ... below ``depth``."""
    every, out, size = turns.select("conv", "pos", "key"), {}, 1
    while True:
        out[size] = every.filter(F.col("pos") % (2 * size) == 0)
        if 2 * size >= depth:
            return out
        block = (F.col("pos") - F.col("pos") % (2 * size)).alias("start")
        every = ws.save(
            every.groupBy("conv", block)
            .agg(F.min_by("key", "pos").alias("a"), F.max_by("key", "pos").alias("b"), F.count("*").alias("n"))
            .filter("n = 2").select("conv", F.col("start").alias("pos"), _digest(F.col("a"), F.col("b")).alias("key")),
            "segments")
        size *= 2


def _prefixes(ws: Workspace, turns: DataFrame, convs: DataFrame, depth: int) -> DataFrame:
    """conv, pos, name of the prefix of length pos, for every length."""
    found = ws.save(convs.select("conv", F.lit(0).cast("long").alias("pos"), _digest(F.lit("root").cast("binary")).alias("name")), "root")
    halves = _segments(ws, turns, depth) if depth > 1 else {}
    for size in sorted(halves, reverse=True):
        below = found.join(halves[size], ["conv", "pos"]).select(
            "conv", (F.col("pos") + size).alias("pos"), _digest(F.col("name"), F.col("key")).alias("name"))
        found = found.unionByName(ws.save(below, "prefixes"))
    return found


def _grafted(ws: Workspace, nodes: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens summed over their subtrees.

    Before the round of ``size`` a node's totals cover its subtree inside its
    own range of ``size`` depths; the round joins every second range to the one
    above it."""
    size = 1
    while size < depth:
        hang = (nodes.filter(F.col("depth") % (2 * size) == size)
                .groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("at"))
                .agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")))
        above = hang.select("conv", F.explode(F.sequence(F.col("at") - (size - 1), F.col("at"))).alias("pos"), "l", "s")
        more = (above.join(places, ["conv", "pos"])
                .groupBy(F.col("node").alias("conv_id"), F.col("pos").alias("depth"))
                .agg(F.sum("l").alias("l"), F.sum("s").alias("s")))
        nodes = ws.save(
            nodes.join(more, ["conv_id", "depth"], "left")
            .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("l", F.lit(0)))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("s", F.lit(0))).drop("l", "s"), "grafted")
        size *= 2
    return nodes


def _ends(places: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end."""
    last = places.groupBy("conv").agg(F.max(F.struct("pos", "node")).alias("e")).select(
        F.col("e.node").alias("conv_id"), F.col("e.pos").alias("depth"), "conv")
    chunks = (last.groupBy("conv_id", "depth", F.shiftright("conv", CHUNK_BITS).alias("chunk"))
              .agg(F.sort_array(F.collect_list("conv")).alias("ids"))
              .select("conv_id", "depth", "chunk", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids")))

    def run(batches):
        import pyarrow as pa

        def rows(done):
            return pa.RecordBatch.from_pydict(
                {"conv_id": [d[0] for d in done], "depth": [d[1] for d in done], "ends_sha256": [d[2] for d in done]},
                schema=pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))

        key, h, done = None, None, []
        for b in batches:
            for c, d, ids in zip(*(b.column(n).to_pylist() for n in ("conv_id", "depth", "ids"))):
                if key == (c, d):
                    h.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, h.hexdigest()))
                key, h = (c, d), hashlib.sha256(ids.encode())
            yield rows(done)
            done = []
        if key:
            yield rows([(*key, h.hexdigest())])

    return (chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")
            .mapInArrow(run, "conv_id long, depth long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv, pos from 0 without gaps, key,
    size); ``convs``: every conversation (conv), also those without turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens of the subtree (sum over its nodes of (n_convs -
    1) x size), ends_sha256 (of the members that end here)."""
    ws = Workspace(turns.sparkSession, "prefix-trie")
    turns, convs = ws.save(turns, "turns"), ws.save(convs, "convs")
    top = turns.agg(F.max("pos")).first()[0]
    depth = 1 if top is None else int(top) + 2  # lengths 0 ... top + 1
    prefixes = _prefixes(ws, turns, convs, depth)
    named = ws.save(prefixes.groupBy("name").agg(
        F.min("conv").alias("node"), F.max("pos").alias("depth"), F.count("*").alias("n_convs")), "named")
    places = ws.save(prefixes.join(named.select("name", "node"), "name").select("conv", "pos", "node"), "places")
    # the turn and the node above a node, by its smallest member
    above = places.join(turns.select("conv", "pos", "size"), ["conv", "pos"]).select(
        F.col("conv").alias("node"), (F.col("pos") + 1).alias("depth"), F.col("node").alias("parent_conv_id"), "size")
    nodes = ws.save(named.drop("name").join(above, ["node", "depth"], "left").withColumnRenamed("node", "conv_id"), "nodes")
    children = nodes.filter("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = ws.save(
        nodes.join(children, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))).alias("saved_tokens")), "nodes")
    nodes = _grafted(ws, nodes, places, depth)
    out = nodes.join(_ends(places), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations (conv_id, turn, role, text) as they are."""
    ws = Workspace(conversations.sparkSession, "conversation-turns")
    turns = ws.save(ordered_turns(conversations), "ordered")
    return prefix_trie(turns, turns.select("conv").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with beginnings shared by ``shared_heads``."""
    ws = Workspace(conversations.sparkSession, "conversation-turns")
    return prefix_trie(*shared_heads(ws.save(ordered_turns(conversations), "ordered")))
