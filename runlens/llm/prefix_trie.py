"""The trie of conversations by their first turns, built level by level.

Going down, the live conversations of a depth are grouped by (parent node, next turn); a node's name is the smallest
conv_id that passes it. A conversation alone in its node leaves the levels: what is left of it is a chain. Going up,
each level adds its children's leaves and savings by one join. Turns are compared by digests of role and text, so no
level moves texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .positions import numbered
from .storage import tidy, written

#: Nodes with more than this share of all conversations are hubs; at most 1 / HUB_SHARE of them stand on one level.
HUB_SHARE = 1 / 1024
#: conv_ids that are put together as one piece of a node's list of ended conversations.
PIECE = 1024
_EMPTY = hashlib.sha256(b"").hexdigest()


@tidy
def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ... by turn, null first, then role and text), digest and bytes (UTF-8 bytes of the text) of every turn.

    Null roles and texts become empty. Rows without conv_id belong to no conversation and are left out. A repeated row is
    a further turn. The numbers come from one sort of all rows, so no task needs a whole conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("row").asc()]
    placed = numbered(rows, order, "at", keep=["conv_id", "digest", "bytes"])
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "digest", "bytes")


@tidy
def spliced_heads(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """The turns of every conversation c after its first h were exchanged for the first h of conversation c - c % group.

    h is the unsigned CRC-32 of c in decimal, modulo `heads`. A shorter head gives all it has, a missing one nothing.
    Whose turns are all exchanged for nothing has no row here.
    """
    c = F.col("conv_id")
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    size = written(size.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % heads, "base": c - c % group}), "conversation_sizes")
    base = size.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    size = size.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("kept"))
    head = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base").join(size, "base").where("pos <= h")
    own = turns.join(size, "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("kept"))
    return head.select("conv_id", "pos", "digest", "bytes").unionByName(own.select("conv_id", "pos", "digest", "bytes"))


def _with_node(step: DataFrame, shared: DataFrame, conversations: int) -> DataFrame:
    """step with the node of (parent, digest). A node that many conversations share is broadcast, so that no task gets all of them."""
    hub = F.col("n_convs") > max(2, conversations * HUB_SHARE)
    key = ["parent", "digest"]
    hubs = F.broadcast(shared.where(hub).select(*key, F.col("node").alias("hub")))
    marked = step.join(hubs, key, "left")
    rest = marked.where("hub is null").drop("hub").join(shared.where(~hub).select(*key, "node"), key)
    return rest.select("conv_id", "n", "node").unionByName(marked.where("hub is not null").select("conv_id", "n", F.col("hub").alias("node")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest per (depth, node) of its pieces, which come one behind the other: only the running state is held."""
    key, state, done = None, None, []
    for batch in batches:
        for depth, node, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key != (depth, node):
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, node), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if len(done) >= 10_000:
            yield _digests(done)
            done = []
    if key is not None:
        done.append((*key, state.hexdigest()))
    yield _digests(done)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, node, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(digest, pa.string())], names=["depth", "conv_id", "ends_sha256"])


def _ends(ended: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of nodes (depth, node) by the conversations (conv_id) that end there.

    Ids are put together in pieces of up to PIECE neighbours before a node's pieces meet, since a third of all
    conversations may end in one node.
    """
    order = [F.col("depth").asc(), F.col("node").asc(), F.col("conv_id").asc()]
    pieces = numbered(ended, order, "at").groupBy("depth", "node", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("depth", "node", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    dealt = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece").select("depth", "node", "text")
    return dealt.mapInArrow(_hashed, "depth long, conv_id long, ends_sha256 string")


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part)
    return found


@tidy
def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    members: conv_id of every conversation, those without turns too. turns: conv_id, pos (1, 2, ... without gaps), digest
    (equal for equal turns) and bytes, as ordered_turns gives them. A node of depth d stands for one sequence of d
    first turns and is named by the smallest conv_id that starts with it; the root, depth 0, has no turn and all
    members. saved_tokens sums (n_convs - 1) times the bytes of a node's last text over its subtree; n_leaves counts the
    subtree's childless nodes, itself included; ends_sha256 is of the comma-joined, ascending conv_ids that end in the
    node (that of the empty string if none does).

    Conversations without turns end in the root. Without members there are no rows. Equal conversations share all their
    nodes. There are as many levels of jobs as turns that some two conversations share from the start.
    """
    spark = turns.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    members = written(members.select("conv_id").distinct().join(size, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n")), "members")
    everyone, root = members.agg(F.count("*"), F.min("conv_id")).first()
    by_pos = written(turns.select("conv_id", "pos", "digest", "bytes").repartitionByRange(width, "pos", "conv_id").sortWithinPartitions("pos"), "turns_by_place")

    live = members.withColumn("node", F.lit(root).cast("long"))
    top = spark.createDataFrame([(root, None, everyone, 0)] if everyone else [], "node long, parent long, n_convs long, bytes long")
    levels, ended, depth = [top.withColumn("depth", F.lit(0).cast("long"))], [], 0
    while True:
        ended.append(live.where(F.col("n") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        depth += 1
        here = by_pos.where(F.col("pos") == depth).select("conv_id", "digest", "bytes")
        step = live.where(F.col("n") >= depth).withColumnRenamed("node", "parent").join(here, "conv_id")
        nodes = step.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
        nodes = written(nodes.withColumn("depth", F.lit(depth).cast("long")), "trie_level")
        levels.append(nodes)
        shared = nodes.where("n_convs > 1")
        if shared.isEmpty():
            break
        live = written(_with_node(step, shared, everyone), "trie_live")

    alone = _union(spark, [x.where("n_convs = 1").select("node", "parent", "depth") for x in levels[1:]], "node long, parent long, depth long")
    chain = by_pos.select("conv_id", "pos").join(alone.withColumnRenamed("node", "conv_id"), "conv_id").where("pos >= depth").join(members, "conv_id")
    chain = chain.select(
        "conv_id",
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("pos") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )

    below, rolled = None, []
    for d in range(depth - 1, -1, -1):
        own = levels[d].where("n_convs > 1") if d else levels[d]
        up = levels[d + 1].where("n_convs = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        up = up.unionByName(below) if below is not None else up
        up = up.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).withColumnRenamed("parent", "node")
        now = own.join(up, "node", "left").select(
            F.col("node").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
        )
        now = written(now, "trie_rolled")
        rolled.append(now)
        below = now.select(F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens")
    trunk = _union(spark, rolled, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = _ends(_union(spark, ended, "depth long, node long, conv_id long"))
    trunk = trunk.join(ends, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return trunk.select(chain.columns).unionByName(chain)


@tidy
def conversation_trie(conversations: DataFrame, splice: bool = False) -> DataFrame:
    """The prefix trie of a table of turns: conv_id, turn, role, text; other columns are ignored.

    splice: first exchanges the heads of conversations by spliced_heads. See ordered_turns for nulls, ties and repeated
    rows, and prefix_trie for the columns.
    """
    turns = ordered_turns(conversations)
    members = turns.select("conv_id").distinct()
    return prefix_trie(members, spliced_heads(turns) if splice else turns)
