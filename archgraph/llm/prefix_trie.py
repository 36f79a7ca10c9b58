"""The prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start
with it. Each node is owned by its smallest member. A conversation that is the smallest one at a node
is so at all that it passes below, so it owns a suffix of its path, and a node's
subtree is worked out without walking it: each member's turns below the node occur once, and of these
the ones in its own suffix are the node's that count once. So with a turn's bytes as tokens

    saved(node) = sum over members of (bytes of the turns from the node's on) - (those of them that the member owns)

which is what a member's path holds between the node and the member's suffix. Likewise a
childless node is a flag of its owner, and a node's leaves are the flags of its members. One
aggregate over (conversation, depth) rows by prefix has both.

1. Turns are digested (16 bytes of a SHA-256 over role and text), and ranges of (conversation,
   turn) are sorted apart; what follows reads digests and lengths only.
2. Runs are numbered inside a range. Only a range's first conversation can have begun in
   earlier ones, so what is carried over is one row for each range, however long a conversation is.
3. Conversations are rebuilt: the first turns of one go to those that share it. Ranges are
   sorted again, and each row gets its prefix: a polynomial of its path's digests modulo
   2 ** 127 - 1, of which a later range's part goes on from what is carried.
4. Nodes are an aggregate by (depth, prefix): smallest member and number of members, with a
   map-side part, as all conversations share the root, and many a first turn. A node is the
   top of its owner's suffix where its parent has another owner. (A window over a prefix's rows would mark
   that too, but would hold all conversations of a common prefix in one task.)
5. Parents with over a 1,024th of all nodes below them, and conversations with over a 1,024th of all
   turns, are at most 1,024 each, and are looked up by a broadcast; the others by shuffles.
6. Ids of the conversations that end at a node are joined in sorted blocks, and the blocks of a
   node are hashed one after another.

Defined cases: rows without a conv_id belong to no conversation, and are left out; turns are ordered with
null first, and equal ones by their digest, so that any order of the input gives one result; rows that
repeat are turns of their own; a null role or text is empty, and role and text are told apart;
a conversation that is rebuilt without turns is a member of the root; an empty table has no nodes, not even a root;
very long texts are hashed whole; other columns pass through no further, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import look_up, materialize, ranges_of, slices

#: Conversations come in blocks of so many ids that share the first one's turns, of which up to ``SHARED - 1`` are taken.
BLOCK, SHARED = 5, 9
#: Prefixes are polynomials of digests modulo a prime.
PRIME, FACTOR = (1 << 127) - 1, 0x5BD1E995C2B2AE3D27D4EB4F165667B1
ROOT = (0).to_bytes(16, "big")
#: Ids that are joined to one text.
IDS_A_BLOCK = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, bytes`` of each row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id is not null")


def _in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows``, a table of the shared folder, in sorted ranges."""
    return rows.repartitionByRange(ranges_of(rows), *order).sortWithinPartitions(*order)


NUMBERED = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("place", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64())])


def _number(batches):
    """Places of rows in the run of their conversation inside this range."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in slices(batches):
        ids = batch.column(0).to_numpy()
        at = np.arange(len(ids))
        starts = np.maximum.accumulate(np.where(np.concatenate([[True], ids[1:] != ids[:-1]]), at, 0))
        place = at - starts
        if len(ids) and ids[0] == last:
            place[starts == 0] += seen
        if len(ids):
            last, seen = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(place), batch.column(1), batch.column(2)], schema=NUMBERED)


@dataclass
class Carried:
    """What a range's first conversation has in earlier ranges."""

    conv_id: int
    rows: int
    prefix: int = 0
    bytes: int = 0


def _carry(summaries, add) -> dict[int, Carried]:
    """For each range what is carried into it. ``summaries``: one row for each range, with its first and its last conversation."""
    out: dict[int, Carried] = {}
    open_: Carried | None = None
    for row in sorted(summaries, key=lambda r: r.part):
        if open_ is not None and open_.conv_id == row.first:
            out[row.part] = open_
        before = out.get(row.part)
        open_ = add(before if before is not None and before.conv_id == row.last.conv_id else None, row.last)
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, digest, bytes``: each conversation's turns from place 0 on."""
    rows = materialize(turns(conversations), "turns")
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"))
    ranged = _in_ranges(rows, *order).select("conv_id", "digest", "bytes").mapInArrow(_number, "part int, conv_id long, place long, digest binary, bytes long")
    placed = materialize(ranged, "places")
    # One row for each range.
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last")).collect()
    carried = _carry(ends, lambda before, last: Carried(last.conv_id, (before.rows if before else 0) + last.place + 1))
    if not carried:
        return placed.drop("part")
    before = placed.sparkSession.createDataFrame([(p, c.conv_id, c.rows) for p, c in carried.items()], "part int, conv_id long, _before long")
    joined = placed.join(F.broadcast(before), ["part", "conv_id"], "left")  # one row for each range
    return joined.select("conv_id", (F.col("place") + F.coalesce("_before", F.lit(0))).alias("place"), "digest", "bytes")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(places: DataFrame) -> DataFrame:
    """``conv_id, seq, digest, bytes``: the turns of each rebuilt conversation by ``seq``, from 1 on with gaps.

    Each conversation has a row with ``seq`` 0, which stands for the root; turns that come for one that isn't there have none before them.
    """
    near = F.transform(F.sequence(F.lit(1 - BLOCK), F.lit(BLOCK - 1)), lambda k: F.try_add(F.col("conv_id"), k.cast("long")))
    # Its own rows are its root and its turns after the shared ones; those of its block's first one go to the others by place.
    own = F.array(F.struct(F.col("conv_id").alias("to"), F.when(F.col("place") == 0, F.lit(0).cast("long")).alias("root"), F.when(F.col("place") >= shared_turns(F.col("conv_id")), F.col("place") + SHARED).alias("seq")))
    first = (F.col("conv_id") % BLOCK == 0) & (F.col("place") < SHARED - 1)
    given = F.when(first, F.transform(near, lambda to: F.struct(to.alias("to"), F.lit(None).cast("long").alias("root"), F.when((to - to % BLOCK == F.col("conv_id")) & (F.col("place") < shared_turns(to)), F.col("place") + 1).alias("seq")))).otherwise(F.array().cast("array<struct<to: bigint, root: bigint, seq: bigint>>"))
    each = places.select("digest", "bytes", F.explode(F.concat(own, given)).alias("x")).select("x.to", "x.root", "x.seq", "digest", "bytes")
    each = each.select("to", F.explode(F.array("root", "seq")).alias("seq"), "digest", "bytes").where("to is not null and seq is not null")
    root = F.col("seq") == 0
    return each.select(F.col("to").alias("conv_id"), "seq", F.when(~root, F.col("digest")).alias("digest"), F.when(root, 0).otherwise(F.col("bytes")).cast("long").alias("bytes"))


PATHS = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("rooted", pa.bool_()), ("place", pa.int64()), ("above", pa.binary()), ("prefix", pa.binary()), ("bytes", pa.int64()), ("before", pa.int64())])
PATHS_SQL = "part int, conv_id long, rooted boolean, place long, above binary, prefix binary, bytes long, before long"


def _walk(batches):
    """Each row's prefix inside this range: that of the rows of its conversation from the range's start on.

    ``place`` counts turns, ``above`` is the prefix without the row's own turn, ``before`` the bytes
    without it; ``rooted`` is whether the conversation's root is in the range.
    """
    part, last = TaskContext.get().partitionId(), None
    rooted, place, prefix, total = False, 0, 0, 0
    for batch in slices(batches):
        rows = []
        for conv_id, seq, digest, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if conv_id != last:
                last, rooted, place, prefix, total = conv_id, False, 0, 0, 0
            above = prefix
            if seq == 0:
                rooted = True
            else:
                place += 1
                prefix = (prefix * FACTOR + int.from_bytes(digest, "big") + 1) % PRIME
            rows.append((part, conv_id, rooted, place, above.to_bytes(16, "big"), prefix.to_bytes(16, "big"), size, total))
            total += size
        columns = list(zip(*rows)) if rows else [[]] * len(PATHS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PATHS)], schema=PATHS)


def _go_on(before: Carried | None, row) -> Carried | None:
    """The state after a range's last conversation; none for one that isn't there."""
    if before is None and not row.rooted:
        return None
    start = before or Carried(row.conv_id, 0)
    prefix = (start.prefix * pow(FACTOR, row.place, PRIME) + int.from_bytes(row.prefix, "big")) % PRIME
    return Carried(row.conv_id, start.rows + row.place, prefix, start.bytes + row.before + row.bytes)


def _settle(carried: dict[int, Carried]):
    """Rows with what is carried into their range; those of conversations that aren't there go."""

    def onward(state: Carried, place: int, raw: bytes) -> bytes:
        return ((state.prefix * pow(FACTOR, place, PRIME) + int.from_bytes(raw, "big")) % PRIME).to_bytes(16, "big")

    def run(batches):
        for batch in batches:
            part, conv, rooted, place, above, prefix, size, before = batch.columns
            parts, ids = part.to_numpy(), conv.to_numpy()
            state = [carried.get(p) for p in np.unique(parts).tolist()]
            later = np.zeros(len(ids), dtype=bool)
            for s, p in zip(state, np.unique(parts).tolist()):
                if s is not None:
                    later |= (parts == p) & (ids == s.conv_id)
            depth, places = place.to_pylist(), place.to_pylist()
            aboves, prefixes, befores = above.to_pylist(), prefix.to_pylist(), before.to_pylist()
            for i in np.flatnonzero(later).tolist():
                s = carried[int(parts[i])]
                aboves[i], prefixes[i] = onward(s, places[i] - 1, aboves[i]), onward(s, places[i], prefixes[i])
                depth[i] += s.rows
                befores[i] += s.bytes
            there = pa.array(rooted.to_numpy(zero_copy_only=False) | later)
            out = pa.RecordBatch.from_arrays(
                [conv, pa.array(depth, pa.int64()), pa.array(aboves, pa.binary()), pa.array(prefixes, pa.binary()), size, pa.array(befores, pa.int64())],
                names=["conv_id", "depth", "above", "prefix", "bytes", "before"],
            )
            yield out.filter(there)

    return run


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, above, prefix, bytes, before``: a table with a row for each node on each conversation's path.

    ``prefix`` tells sequences of turns of one length apart, ``above`` is its parent's; ``bytes`` are those of
    the last turn's text, and ``before`` those of the turns before it.
    """
    rows = materialize(rebuilt(numbered(conversations)), "rebuilt")
    raw = materialize(_in_ranges(rows, F.col("conv_id"), F.col("seq")).mapInArrow(_walk, PATHS_SQL), "paths-by-range")
    # One row for each range. A range's last row is its last conversation's with the most bytes and turns so far.
    last = F.max(F.struct("conv_id", "place", "before", "bytes", "rooted", "prefix")).alias("last")
    carried = _carry(raw.groupBy("part").agg(F.min("conv_id").alias("first"), last).collect(), _go_on)
    return materialize(raw.mapInArrow(_settle(carried), "conv_id long, depth long, above binary, prefix binary, bytes long, before long"), "paths")


def _blocks(batches):
    """Ids of conversations that end at a node, sorted, joined to texts of a bounded number of ids."""
    key, first, held = None, None, []

    def close():
        return pa.RecordBatch.from_pylist([{"depth": key[0], "prefix": key[1], "first": first, "ids": ",".join(map(str, held))}], schema=pa.schema([("depth", pa.int64()), ("prefix", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in slices(batches):
        done = []
        for depth, prefix, conv_id in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and (key != (depth, prefix) or len(held) == IDS_A_BLOCK):
                done.append((*key, first, ",".join(map(str, held))))
                held = []
            if not held:
                key, first = (depth, prefix), conv_id
            held.append(conv_id)
        if done:
            columns = list(zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["depth", "prefix", "first", "ids"])
    if held:
        yield close()


def _hash_blocks(batches):
    """The SHA-256 of each node's blocks, which come in order."""
    key, digest = None, None
    schema = pa.schema([("depth", pa.int64()), ("prefix", pa.binary()), ("ends_sha256", pa.string())])
    for batch in slices(batches):
        done = []
        for depth, prefix, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if key != (depth, prefix):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, prefix), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            columns = list(zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"depth": key[0], "prefix": key[1], "ends_sha256": digest.hexdigest()}], schema=schema)


def ends(members: DataFrame) -> DataFrame:
    """``depth, prefix, ends_sha256`` of each node at which a conversation of ``members`` (a table of depth, prefix, conv_id) ends."""
    order = (F.col("depth"), F.col("prefix"), F.col("conv_id"))
    blocks = _in_ranges(members.select("depth", "prefix", "conv_id"), *order).mapInArrow(_blocks, "depth long, prefix binary, first long, ids string")
    dealt = blocks.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "first")
    return dealt.select("depth", "prefix", "ids").mapInArrow(_hash_blocks, "depth long, prefix binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node."""
    key = ["depth", "prefix"]
    rows = paths(conversations)
    # ``above``, ``bytes`` and ``before`` are the same for all rows of a node.
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("above").alias("above"), F.min("before").alias("before"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("prefix")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-with-children")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("owner").alias("parent"), F.col("n_children").alias("weight"))
    nodes = materialize(look_up(nodes, parents, ["depth", "above"], "weight", nodes.count()), "nodes-with-parents")
    # A conversation's own suffix begins at the one node that it owns below another's, and it owns a leaf or none.
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min(F.when(F.col("parent").isNull() | (F.col("parent") != F.col("owner")), F.col("before"))).alias("own"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf")
    )
    last = F.max(F.struct("depth", "prefix", (F.col("before") + F.col("bytes")).alias("all"))).alias("last")
    members = rows.groupBy("conv_id").agg(F.count("*").alias("weight"), last).join(owned, "conv_id", "left")
    # One that owns nothing has all of its path above its suffix.
    members = materialize(members.selectExpr("conv_id", "weight", "last.depth", "last.prefix", "coalesce(own, last.all) as own", "coalesce(leaf, 0) as leaf"), "members")
    found = look_up(rows.select("conv_id", *key, "before"), members.select("conv_id", "weight", "own", "leaf"), ["conv_id"], "weight", int(rows.count()))
    sums = found.groupBy(*key).agg(F.sum(F.greatest(F.col("own") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    out = nodes.join(sums, key).join(ends(members), key, "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def oracle_sql() -> str:
    # CRC-32 bit by bit; a node's key is the MD5 digests of its turns.
    crc = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
    return f"""
        with t as (
            select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as place, coalesce(role, '') as role, coalesce(text, '') as text
            from conversations where conv_id is not null),
        ids as (select c, {crc} % 9 as h from (select distinct conv_id as c from t)),
        built as (
            select c, place as seq, role, text from ids join t on conv_id = c - c % 5 and place < h
            union all select c, place + 9, role, text from ids join t on conv_id = c and place >= h),
        turn as (select c, row_number() over (partition by c order by seq) as depth, strlen(text) as bytes, md5(strlen(role) || ':' || role || text) as k from built),
        path as (
            select c, 0 as depth, 0 as bytes, '' as p from ids
            union all select c, depth, bytes, string_agg(k, '') over (partition by c order by depth) from turn),
        node as (select p, depth, min(c) as conv_id, count(*) as n_convs, min(bytes) as bytes from path group by p, depth),
        child as (select p[1:32 * (depth - 1)] as p, count(*) as n from node where depth > 0 group by 1),
        below as (
            select node.p[1:32 * k] as p, sum((n_convs - 1) * bytes) as saved, count(*) filter (where child.p is null) as leaves
            from (select *, unnest(range(0, depth + 1)) as k from node) as node left join child on child.p = node.p group by 1),
        ends as (select p, sha256(string_agg(cast(c as varchar), ',' order by c)) as h from (select c, max_by(p, depth) as p from path group by c) group by p)
        select node.conv_id, cast(node.depth as bigint) as depth, above.conv_id as parent_conv_id, node.n_convs, coalesce(child.n, 0) as n_children,
            below.leaves as n_leaves, cast(below.saved as bigint) as saved_tokens, coalesce(ends.h, sha256('')) as ends_sha256
        from node join below using (p) left join child using (p) left join ends using (p)
            left join node as above on above.p = node.p[1:32 * (node.depth - 1)] and node.depth > 0"""
