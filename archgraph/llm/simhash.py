"""SimHash near-duplicates: Golay-code fuzzy hashing, pigeonhole over segments, join and verify.

A document's 64-bit fingerprint has a bit set where over half its shingles' XXH64 hashes
have it. Documents whose fingerprints differ in at most four bits are linked; a group is
what links reach.

Candidates. A fingerprint is cut into segments of 22, 21 and 21 bits. With four wrong bits
over three segments, sorted, the two best segments have (0,0), (0,1), (1,1) or (0,2) wrong
bits. So either two segments have at most one wrong bit each, or one has none.

- Pairs of segments: a 23-bit word decodes to the nearest Golay codeword, of which there
  are 4096. If u and v differ in at most one bit of a segment, then v's codeword is among
  the (at most six) codewords of the words within one bit of u. For a pair of segments
  (s, t), u is filed under (near codewords of s, own codeword of t) and v looks under
  (own codeword of s, near codewords of t): 24-bit keys, about five for each fingerprint
  and role.
- Single segments: filed and looked up under the exact bits.

Each link between different fingerprints is thus met under some key; candidates are
verified by counting differing bits. Nothing is capped.

Dense groups. Fingerprints are made distinct first, so that copies count once. Then each
key's members are tied to the key's smallest fingerprint where that is a verified link
(one aggregate, one join), and pairs already tied to one leader are no longer emitted:
the links emitted stay close to a spanning forest, while no link between groups is lost.
Where filed and looking members of a key are more than ``PART`` times ``PART`` pairs, both
are dealt out over a grid of cells, one task's work each, and the members of the key's most
frequent leader never meet among themselves.

Size. Keys of 24 bits meet by chance too: n distinct fingerprints make about 75 * n ** 2 / 2 ** 24
comparisons of two longs, spread evenly. Up to some 10 ** 9 distinct fingerprints these cost less
than the hashing of the texts; far beyond, segments should be cut wider than a Golay word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_columns, materialize, scratch, slices
from .components import connected_components
from .golay import codeword_index, near_indices

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Members of a key that one cell of its grid takes from each side.
PART = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a text: A-Z lower-cased, words between ASCII spaces, shingles joined by a space.

    A text of fewer words than a shingle is one shingle; one without words has zero.
    """
    # bytes.lower and bytes.split know ASCII only: A-Z, and the six spaces.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])] if len(words) >= shingle else [digest(joined, SEED)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _fingerprints(batch: pa.RecordBatch) -> list[pa.Array]:
    found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
    return [batch.column(0), pa.array(found.view(np.int64))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) for each row."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(map_columns(_fingerprints, pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])), "doc_id long, fp long")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for low, bits in SEGMENTS]


def _key(kind: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.int64(kind) << 48 | high.astype(np.int64) << 24 | low.astype(np.int64)


def keys(fps: np.ndarray, role: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the fingerprints: where they are filed, where they look, or their own codewords."""
    parts = _segments(fps)
    own = [codeword_index(x) for x in parts]
    every = np.arange(len(fps))
    rows, found = [], []
    near = [near_indices(x, bits) for x, (_, bits) in zip(parts, SEGMENTS)] if role != "own" else []
    for k, (s, t) in enumerate(PAIRS):
        if role == "own":
            rows.append(every)
            found.append(_key(k, own[s], own[t]))
        elif role == "filed":
            rows.append(near[s][0])
            found.append(_key(k, near[s][1], own[t][near[s][0]]))
        else:
            rows.append(near[t][0])
            found.append(_key(k, own[s][near[t][0]], near[t][1]))
    if role != "own":
        for s, part in enumerate(parts):
            rows.append(every)
            found.append(_key(3 + s, np.zeros_like(part), part))
    return np.concatenate(rows), np.concatenate(found)


def _keyed(role: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column("fp").to_numpy()
                rows, found = keys(fps.view(np.uint64), role)
                columns = [pa.array(found), *(part.column(k).take(pa.array(rows)) for k in range(part.num_columns))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *part.schema.names])

    return run


def _dense(filed: DataFrame, sought: DataFrame, part: int) -> DataFrame:
    """``key, p, q, most`` of each key with more pairs than a cell's: parts of its filed and looking members, and their most frequent leader."""
    roles = filed.selectExpr("key", "leader", "1L as f", "0L as s").union(sought.selectExpr("key", "leader", "0L as f", "1L as s"))
    large = roles.groupBy("key").agg(F.sum("f").alias("f"), F.sum("s").alias("s")).where(f"f * s > {part * part}L")
    large = materialize(large.selectExpr("key", f"cast(ceil(f / {part}) as bigint) as p", f"cast(ceil(s / {part}) as bigint) as q"), "dense")
    counts = roles.join(large, "key").groupBy("key", "p", "q", "leader").agg(F.sum(F.expr("f + s")).alias("n"))
    return materialize(counts.groupBy("key", "p", "q").agg(F.expr("max_by(leader, struct(n, leader))").alias("most")), "dense-keys")


def _meetings(labelled: DataFrame, part: int) -> DataFrame:
    """``a, b, leader_a, leader_b``, joined by key and cell, of all that meet under a key by different leaders.

    Cell 2 * (i * q + j) + c holds the filed members of part i and the looking ones of part j;
    those looking with the most frequent leader are at c = 1, where only filed members with
    other leaders go. All members of a key that isn't dense are in cell 0.
    """
    filed, sought = (labelled.mapInArrow(_keyed(role), "key long, fp long, leader long") for role in ("filed", "sought"))
    dense = _dense(filed, sought, part)
    into = "transform(sequence(0L, q - 1), j -> 2 * (pmod(xxhash64(fp), p) * q + j))"
    into = f"case when p is null then array(0L) when leader = most then {into} else flatten(transform({into}, x -> array(x, x + 1))) end"
    outof = "case when p is null then array(0L) else transform(sequence(0L, p - 1), i -> 2 * (i * q + pmod(xxhash64(fp), q)) + if(leader = most, 1, 0)) end"
    a = filed.join(dense, "key", "left").selectExpr("key", "fp as a", "leader as leader_a", f"explode({into}) as cell")
    b = sought.join(dense, "key", "left").selectExpr("key", "fp as b", "leader as leader_b", f"explode({outof}) as cell")
    return a.join(b, ["key", "cell"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, part: int = PART) -> DataFrame:
    """``a, b``: verified links that connect whatever links of distinct fingerprints connect.

    ``fps`` has a long column fp, each value once. ``part`` bounds the work of one cell, and
    changes no result.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the segments find links of at most {MAX_BITS} bits")
    fps = fps.select("fp")
    near = f"bit_count(a ^ b) <= {int(max_bits)}"
    own = materialize(fps.mapInArrow(_keyed("own"), "key long, fp long"), "own")
    leaders = own.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = materialize(own.join(leaders, "key").selectExpr("fp as a", "b").where(f"a <> b and {near}").distinct(), "stars")
    # A leader that is tied to a smaller one keeps that tie: members and leader may differ
    # in their label, which costs an emitted link but never loses one.
    tied = stars.groupBy("a").agg(F.min("b").alias("leader")).withColumnRenamed("a", "fp")
    labelled = materialize(fps.join(tied, "fp", "left").selectExpr("fp", "coalesce(leader, fp) as leader"), "labelled")
    across = _meetings(labelled, part).where(f"a > b and {near} and leader_a <> leader_b").select("a", "b").distinct()
    return stars.union(across)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row: the smallest doc_id that links reach.

    Defined cases: null texts are empty; texts without words share the fingerprint zero
    and are linked like any other; rows with one id and different texts belong to the
    components of both texts' fingerprints, which stay apart; null ids never are a
    component's id unless all its ids are null; an empty table gives no rows; very long texts
    are hashed whole; other columns pass through no further, whatever their names.
    """
    found = materialize(fingerprints(docs), "fingerprints")
    with scratch(docs.sparkSession):
        fps = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        roots = connected_components(links(fps, max_bits)).withColumnRenamed("node", "fp")
        rooted = materialize(fps.join(roots, "fp", "left").selectExpr("fp", "least", "coalesce(root, fp) as root"), "rooted", kept=True)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = rooted.join(smallest, "root").select("fp", "component_id")
    return found.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` but those that aren't their group's smallest doc_id, with all columns.

    What goes is listed by id in a table, and removed by an anti-join: only ids pass the
    groups' shuffles, and the table's size is known, so that texts move only where Spark finds
    the ids too many to broadcast. Rows without an id stay.
    """
    with scratch(docs.sparkSession):
        found = materialize(near_duplicates(docs, max_bits), "groups")
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("_stays"))
        gone = materialize(gone.join(stays, gone._gone == stays._stays, "left_anti").distinct(), "gone", kept=True)
    return docs.join(gone, docs["doc_id"].cast("long") == gone._gone, "left_anti")
