"""Prefix trie of conversations: every distinct sequence of first turns is a node.

Turns become ids, and ``COLUMNS`` consecutive turns of a conversation one row with the ids in
positional columns. ``GROUP BY ROLLUP`` over these columns aggregates all prefixes at once, and
``grouping_id`` tells the depth. A longer conversation goes on in further rows (blocks), which
are grouped by their number and by the node where the block before ends.

A node is known by sums: each place and turn has a hash of 128 bits in four numbers, and
the sums of these over a prefix stand for it. Sums over parts of a conversation add up, so a
conversation of any length is numbered and summed in parts (``PART``).

Subtrees need no walk either. Let a node's owner be its member of the least id. A conversation
that owns a node owns all deeper ones on its path, so what it shares is a prefix:
``saved_tokens`` of a node is the sum, over its members but the owner, of the length of what
they share, less the part above the node. A childless node has one owner, so ``n_leaves``
counts the members that own one. Both are sums of a second ROLLUP.

``rebuilt`` makes conversations that share their heads: the first h turns of conversation
c - c % 100, then the own turns after the first h, with h = crc32(decimal c) % 6.

Defined cases: null role or text is empty. Turns go by number (null first), repeated
numbers by the MD5 of role and text, and repeated rows stay. Rows without conv_id belong to no
conversation and are left out. A conversation that is rebuilt without turns ends at the root.
No conversations give no nodes. Extra columns are ignored. The ids of all members that end at
one node go through one digest in order, as a stream of strings of many ids each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failsift.llm.tables import stored

COLUMNS = 8
# Turn numbers, or blocks, of a conversation that are sorted in one place.
PART = 512
SUMS = ("s1", "s2", "s3", "s4")
KEY = (*SUMS, "depth")
HEADS = 6
_IDS = [f"t{i}" for i in range(COLUMNS)]


def before(rows: DataFrame, part: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add the sums of ``values`` over the earlier rows of the conversation, in parts.

    Rows of one part are summed in place; the sums of earlier parts are carried over.
    """
    rows = rows.withColumn("part", part)
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = rows.withColumns({name: F.coalesce(F.sum(value).over(inside), zero) for name, value in values.items()})
    totals = rows.groupBy("conv_id", "part").agg(*[F.sum(value).alias(name) for name, value in values.items()])
    carried = totals.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), *[F.sum(n).over(earlier).alias(f"carried_{n}") for n in values]
    ).where(F.col(f"carried_{next(iter(values))}").isNotNull())
    met = local.join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p")), "left")
    return met.withColumns({n: F.col(n) + F.coalesce(f"carried_{n}", zero) for n in values}).select(
        *[c for c in rows.columns if c != "part"], *values
    )


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, chars of the given turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    counted = before(rows, F.floor(F.col("turn") / PART), order, {"place": F.lit(1).cast("long")})
    return counted.select("conv_id", (F.col("place") + 1).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, n), and their turns (conv_id, place, digest, chars)."""
    own = stored(placed(turns), "trie-turns")
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    conversations = stored(
        lengths.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
        .join(base, "base", "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"), "n"),
        "trie-conversations",
    )
    heads = own.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    first = conversations.join(heads, "base").where("place <= taken").select("conv_id", "place", "digest", "chars")
    rest = own.join(conversations.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "chars")
    total = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return conversations.select("conv_id", total.alias("n")), first.unionByName(rest)


def _limbs(turn_id: Column) -> list[Column]:
    return [F.conv(F.substring(turn_id, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(len(SUMS))]


def _chars(turn_id: Column) -> Column:
    return F.substring(turn_id, 34, 20).cast("long")


def blocks(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, block, the turn ids t0.. of the block, and the sums and characters of all blocks before."""
    # a turn's id holds its place, so equal ids are equal turns at equal places
    turn_id = F.concat(F.md5(F.concat("place", F.lit(":"), "digest")), F.lit(":"), "chars")
    slot = (F.col("place") - 1) % COLUMNS
    ids = turns.select("conv_id", F.floor((F.col("place") - 1) / COLUMNS).alias("block"), slot.alias("slot"), turn_id.alias("id"))
    rows = ids.groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("slot") == i, F.col("id"))).alias(t) for i, t in enumerate(_IDS)])
    empty = conversations.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("string").alias(t) for t in _IDS])
    zero = F.lit(0).cast("long")
    add = lambda columns: sum((F.coalesce(c, zero) for c in columns), zero)
    values = {s: add(_limbs(F.col(t))[i] for t in _IDS) for i, s in enumerate(SUMS)} | {"above": add(_chars(F.col(t)) for t in _IDS)}
    return before(rows.unionByName(empty), F.floor(F.col("block") / PART), [F.col("block")], values)


def rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """All nodes with ``aggregates`` over their members, keys, parents' keys and the characters above their last turn."""
    grouped = rows.sparkSession.sql(
        f"""SELECT block, {", ".join(SUMS)}, {", ".join(_IDS)}, max(above) AS above,
              {COLUMNS} - bit_count(grouping_id()) AS width, count(*) AS n_convs, min(conv_id) AS conv_id, {aggregates}
            FROM {{rows}} GROUP BY block, {", ".join(SUMS)}, ROLLUP({", ".join(_IDS)})""",
        rows=rows,
    )
    # a block's own root is the end of the block before; shorter conversations leave columns empty
    last = F.get(F.array(*_IDS), F.col("width") - 1)
    nodes = grouped.where(F.when(F.col("width") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    zero = F.lit(0).cast("long")
    upto = lambda of, n: sum((F.when(F.lit(i) < n, of(F.col(t))).otherwise(zero) for i, t in enumerate(_IDS)), zero)
    parent = F.col("width") - 1
    others = [c for c in nodes.columns if c not in {*_IDS, *SUMS, "block", "width", "above"}]
    return nodes.select(
        *[(F.col(s) + upto(lambda t, i=i: _limbs(t)[i], F.col("width"))).alias(s) for i, s in enumerate(SUMS)],
        *[(F.col(s) + upto(lambda t, i=i: _limbs(t)[i], parent)).alias(f"up_{s}") for i, s in enumerate(SUMS)],
        (F.col("block") * COLUMNS + F.col("width")).alias("depth"),
        (F.col("above") + upto(_chars, parent)).alias("above"),
        *others,
    )


def _id_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a batch of sorted rows, as strings of ids."""
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in KEY]
        ids = batch.column("conv_id").to_pylist()
        if not ids:
            continue
        changes = np.any([np.diff(c) != 0 for c in columns], axis=0)
        edges = [0, *(np.flatnonzero(changes) + 1), len(ids)]
        starts = edges[:-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[starts]) for c in columns]
            + [pa.array([ids[i] for i in starts], pa.int64()), pa.array([",".join(map(str, ids[i:j])) for i, j in zip(edges, edges[1:])])],
            names=[*KEY, "first", "ids"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined strings of each key, from rows sorted by (key, first)."""
    names = [*KEY, "ends_sha256"]
    key, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for *found, ids in zip(*[batch.column(k).to_pylist() for k in (*KEY, "ids")]):
            if found != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = found, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))
    if key:
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, (*key, digest.hexdigest()))})


def ends(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Key of the node where a conversation ends, and the digest of the ids of all that end there."""
    zero = F.lit(0).cast("long")
    own = [F.col(s) + sum((F.coalesce(_limbs(F.col(t))[i], zero) for t in _IDS), zero) for i, s in enumerate(SUMS)]
    depth = F.col("block") * COLUMNS + sum((F.col(t).isNotNull().cast("long") for t in _IDS), zero)
    last = conversations.select("conv_id", F.floor(F.greatest(F.col("n") - 1, zero) / COLUMNS).alias("block"))
    ended = rows.join(last, ["conv_id", "block"]).select(*[c.alias(s) for s, c in zip(SUMS, own)], depth.alias("depth"), "conv_id")
    kinds = ", ".join(f"{k} long" for k in KEY)
    strings = (
        ended.repartitionByRange(*KEY, "conv_id")
        .sortWithinPartitions(*KEY, "conv_id")
        .mapInArrow(_id_strings, f"{kinds}, first long, ids string")
    )
    return strings.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, f"{kinds}, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has (conv_id, n), each id once; ``turns`` has (conv_id, place from 1
    to n, digest, chars).
    """
    rows = stored(blocks(conversations, turns), "trie-blocks")
    nodes = rolled_up(rows, "true AS whole")
    children = nodes.where("depth > 0").groupBy(*[F.col(f"up_{s}").alias(s) for s in SUMS], (F.col("depth") - 1).alias("depth"))
    counted = stored(
        nodes.join(children.agg(F.count("*").alias("n_children")), [*KEY], "left")
        .select(*KEY, "conv_id", "above", F.coalesce("n_children", F.lit(0)).alias("n_children")),
        "trie-nodes",
    )
    owned = counted.groupBy("conv_id").agg(
        F.min_by("above", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    zero = F.lit(0).cast("long")
    chars = rows.groupBy("conv_id").agg(F.sum(sum((F.coalesce(_chars(F.col(t)), zero) for t in _IDS), zero)).alias("chars"))
    shares = chars.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "chars").alias("shared"), F.coalesce("leaf", zero).alias("leaf")
    )
    summed = rolled_up(rows.join(shares, "conv_id"), "sum(shared) AS shared, sum(leaf) AS n_leaves, min_by(shared, conv_id) AS own")
    saved = F.col("shared") - F.col("own") - (F.col("n_convs") - 1) * F.col("above")
    parents = counted.select(
        *[F.col(s).alias(f"up_{s}") for s in SUMS], (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        summed.join(counted.select(*KEY, "n_children"), [*KEY])
        .join(parents, [*[f"up_{s}" for s in SUMS], "depth"], "left")
        .join(ends(conversations, rows), [*KEY], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    conversations, rows = rebuilt(turns)
    return trie(conversations, rows)
