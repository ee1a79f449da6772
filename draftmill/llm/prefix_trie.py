"""Operator 13: the trie of conversation prefixes.

A conversation is the sequence of the digests of its turns.  Equal sequences are
counted first and stand for all their conversations from then on, so copies cost
nothing below.  Sequences are hash-partitioned by their first turn, and each
group becomes a trie of pointer dictionaries inside ``applyInPandas``, whose
sums are taken by an iterative postorder.  A group of more than ``limit`` turns
is parted again by the next turn: what its sequences share is a path of nodes
that Spark sums up as a *spine*, and its members go on below it, grouped by the
first turn in which they differ.  This repeats until every group fits or is a
single sequence; then the spines are closed from the deepest level upwards.

Nothing of a group's size reaches one task or the driver: groups are summed on
the map side, hot groups meet their sums by broadcast (``common.meet``), and the
decimal ids of conversations that end at one node are hashed from sorted blocks,
a block in memory at a time.  A sequence itself, some 80 bytes a turn, must fit
into a task.

Edge cases: rows without a conversation id belong to none; null role or text is
empty; turns are ordered by number, null first, and of one number by their
digest; repeated turns are turns in their own right; a conversation that loses
all its turns ends at the root; other columns are left behind; an empty table
has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.llm.common import meet, save

#: Turns in a group that is built in one task: a share of what a task would hold, within these bounds.
LEAST_TURNS, MOST_TURNS, SHARE = 1 << 10, 1 << 15, 8
#: Bits of a conversation's id within a block of ids that are hashed at a time.
BLOCK_BITS = 14
#: Hexadecimal digits of a turn's digest.
DIGITS = 32

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): a row a conversation, its turns as (digest, UTF-8 bytes of the text) in order."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.left(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), F.lit(DIGITS))
    rows = turns.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("conv_id"), F.struct(F.col(turn).alias("at"), digest.alias("digest"), F.octet_length(t).cast("long").alias("size")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"], x["size"])).alias("turns"))


def rebuilt(convs: DataFrame, origin: Column, length: Column) -> DataFrame:
    """Each conversation with its first ``length`` turns replaced by as many of the conversation ``origin``; without such a one they are gone."""
    base = convs.select(F.col("conv_id").alias("_origin"), F.col("turns").alias("_theirs"))
    own = convs.withColumns({"_from": origin, "_h": length.cast("int")})
    theirs = F.slice("_theirs", F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    both = F.concat(F.coalesce(theirs, F.slice("turns", F.lit(1), F.lit(0))), rest)
    return own.join(base, F.col("_from") == F.col("_origin"), "left").select("conv_id", both.alias("turns"))


def ends(convs: DataFrame) -> DataFrame:
    """(seq, conv_id, n, turns, ends_sha256): a row a distinct sequence, with its smallest conversation and the hash of all their ids."""
    keyed = convs.withColumn("seq", F.left(F.sha2(F.array_join("turns.digest", ""), 256), F.lit(DIGITS)))
    keyed = save(keyed, "trie-sequences")
    few = keyed.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    # Ids are joined in blocks, so that a task that hashes a large group reads few rows and holds one block.
    block = F.shiftright(F.col("conv_id").cast("long"), BLOCK_BITS)
    parts = keyed.groupBy("seq", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    parts = save(parts, "trie-ends")
    one = parts.groupBy("seq").agg(F.count("*").alias("blocks"), F.max("ids").alias("ids"))
    single = one.where("blocks = 1").select("seq", F.sha2("ids", 256).alias("ends_sha256"))
    many = parts.join(one.where("blocks > 1").select("seq"), "seq", "left_semi").repartition("seq").sortWithinPartitions("seq", "block").select("seq", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = seq, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["seq", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["seq", "ends_sha256"])

    hashes = single.unionByName(many.mapInArrow(run, "seq string, ends_sha256 string"))
    # The smallest conversation of a sequence brings the turns.
    return keyed.join(few, ["seq", "conv_id"]).join(hashes, "seq")


def build(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one group; its sequences share the turns up to ``depth``, and the turn there is the top of the trie.

    A node is a dictionary from digests to node numbers; numbers ascend from
    parents to children, so the postorder is the numbers backwards.
    """
    top = int(group["depth"].iloc[0])
    children: list[dict[str, int]] = []
    parent: list[int] = []
    size: list[int] = []
    conv: list[int] = []
    count: list[int] = []
    end: list[str] = []
    start: dict[str, int] = {}
    for first, n, sha, digests, sizes in zip(group["conv_id"], group["n"], group["ends_sha256"], group["digests"], group["sizes"], strict=True):
        at, pointers = -1, start
        for digest, bytes_ in zip(digests, sizes, strict=True):
            if (to := pointers.get(digest)) is None:
                to = pointers[digest] = len(children)
                children.append({})
                parent.append(at)
                size.append(int(bytes_))
                conv.append(int(first))
                count.append(0)
                end.append(NO_ENDS)
            count[to] += int(n)
            conv[to] = min(conv[to], int(first))
            at, pointers = to, children[to]
        end[at] = sha
    leaves, saved, depth = [0] * len(children), [0] * len(children), [top] * len(children)
    for k in range(len(children)):
        if parent[k] >= 0:
            depth[k] = depth[parent[k]] + 1
    for k in reversed(range(len(children))):
        leaves[k] += not children[k]
        saved[k] += (count[k] - 1) * size[k]
        if parent[k] >= 0:
            leaves[parent[k]] += leaves[k]
            saved[parent[k]] += saved[k]
    above = group["above"].iloc[0]
    return pd.DataFrame(
        {
            "conv_id": conv,
            "depth": depth,
            "parent_conv_id": [conv[p] if p >= 0 else int(group["above_conv"].iloc[0]) for p in parent],
            "n_convs": count,
            "n_children": [len(c) for c in children],
            "n_leaves": leaves,
            "saved_tokens": saved,
            "ends_sha256": end,
            "above": [above if p < 0 else None for p in parent],
        }
    )


def trie(convs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row a node of the trie of (conv_id, turns) rows, each conversation once."""
    spark = convs.sparkSession
    # What is left of each sequence from ``depth`` on, below the node that ``above`` names.
    rows = save(ends(convs), "trie-distinct").select("conv_id", "n", "ends_sha256", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    whole = rows.agg(F.sum(F.size("digests")).alias("turns"), F.min("conv_id").alias("conv"), F.sum("n").alias("n"), F.max(F.when(F.size("digests") == 0, F.col("ends_sha256"))).alias("ends")).first()
    if whole["n"] is None:
        return spark.createDataFrame([], NODE)
    share = int(whole["turns"]) // (SHARE * int(spark.conf.get("spark.sql.shuffle.partitions")))
    limit = limit or max(LEAST_TURNS, min(MOST_TURNS, share))
    root = spark.createDataFrame([(whole["conv"], 0, None, whole["n"], 0, whole["ends"] or NO_ENDS, "", None)], "conv_id long, depth long, parent_conv_id long, n_convs long, size long, ends_sha256 string, name string, above string")
    left = rows.where(F.size("digests") > 0).withColumns({"depth": F.lit(1).cast("long"), "above": F.lit(""), "above_conv": F.lit(whole["conv"])})
    built: DataFrame | None = None
    spines = [root]
    while True:
        left = left.withColumn("name", F.sha2(F.concat("above", F.col("digests")[0]), 256))
        stats = left.groupBy("name").agg(
            F.sum(F.size("digests")).alias("turns"),
            F.count("*").alias("rows"),
            F.sum("n").alias("convs"),
            F.min("conv_id").alias("conv"),
            F.min("digests").alias("low"),
            F.max("digests").alias("high"),
        )
        stats = save(stats, "trie-groups")
        large = stats.where((F.col("turns") > limit) & (F.col("rows") > 1))
        # How many turns all sequences of a group share is what its first and its last share.
        same = F.transform(F.arrays_zip(F.col("low").alias("a"), F.col("high").alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
        shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("low")).cast("int")
        large = save(large.select("name", "rows", "convs", "conv", shared.alias("shared")), "trie-large")
        some = large.limit(1).count() > 0
        if some:
            left = save(meet(left, large, "name", "rows"), "trie-left")
        small = left.where("shared is null") if some else left
        small = small.select("name", "conv_id", "n", "ends_sha256", "digests", "sizes", "depth", "above", "above_conv")
        tries = small.groupBy("name").applyInPandas(build, NODE + ", above string")
        built = tries if built is None else built.unionByName(tries)
        if not some:
            break
        members = left.where("shared is not null")
        # The path that a large group shares: a node a turn, named so that the next lies below it.
        path = members.groupBy("name").agg(
            F.first("convs").alias("n_convs"),
            F.first("conv").alias("conv_id"),
            F.first("above").alias("above"),
            F.first("above_conv").alias("above_conv"),
            F.first("depth").alias("depth"),
            F.first(F.slice("sizes", F.lit(1), F.col("shared"))).alias("sizes"),
            F.max(F.when(F.size("digests") == F.col("shared"), F.col("ends_sha256"))).alias("ends"),
        )
        path = path.select("*", F.posexplode("sizes").alias("k", "size"))
        last = F.col("k") == F.size("sizes") - 1
        name = lambda k: F.concat("name", F.lit(":"), k.cast("string"))
        spine = path.select(
            "conv_id",
            (F.col("depth") + F.col("k")).alias("depth"),
            F.when(F.col("k") == 0, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            "size",
            F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
            name(F.col("k")).alias("name"),
            F.when(F.col("k") == 0, F.col("above")).otherwise(name(F.col("k") - 1)).alias("above"),
        )
        spines.append(save(spine, "trie-spine"))
        rest = members.where(F.size("digests") > F.col("shared"))
        cut = lambda c: F.slice(c, F.col("shared") + 1, F.size(c))
        left = rest.select("conv_id", "n", "ends_sha256", cut("digests").alias("digests"), cut("sizes").alias("sizes"), (F.col("depth") + F.col("shared")).alias("depth"), name(F.col("shared") - 1).alias("above"), F.col("conv").alias("above_conv"))
    built = save(built, "trie-built")
    return built.drop("above").unionByName(_closed(spines, built))


def _closed(spines: list[DataFrame], built: DataFrame) -> DataFrame:
    """The nodes of all spines with the sums of what lies below them, deepest spines first.

    Along a spine's path the same sums are carried up: a path is cut where a
    group was parted, so each of its nodes but the last has one child.
    """
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = built.where("above is not null").select("above", "n_leaves", "saved_tokens")
    up = Window.partitionBy("path").orderBy(F.col("depth").desc())
    done = None
    for spine in reversed(spines):
        below = tops.groupBy(F.col("above").alias("name")).agg(F.count("*").alias("parted"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        spine = spine.withColumn("path", F.substring_index("name", ":", 1)).join(below, "name", "left")
        is_last = F.row_number().over(up) == 1
        spine = spine.select(
            "*",
            F.when(is_last, F.coalesce("parted", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
            F.first(F.coalesce("leaves", F.lit(1))).over(up).alias("n_leaves"),
            F.sum(F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).over(up).alias("saved_tokens"),
        )
        spine = save(spine, "trie-closed")
        done = spine.select(own) if done is None else done.unionByName(spine.select(own))
        tops = tops.unionByName(spine.where("above is not null").select("above", "n_leaves", "saved_tokens"))
    return done
