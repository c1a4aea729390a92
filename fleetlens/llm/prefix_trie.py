"""Prefix trie of conversations whose heads come from another conversation.

A rebuilt conversation is the head of a base conversation followed by the rest of its own turns.
No rebuilt text is made: every stored turn is known by its place and the MD5 of its role and
text, every prefix of a stored conversation by a monoid element (length, hash; ``field61``), and
a rebuilt prefix is the element of the base's head times the quotient of two prefixes of its own.

1. Turns are range-sorted by conversation, turn and digest and scanned once per partition; a
   conversation that crosses partitions is continued by the elements of the partitions before
   (one row per partition), so a conversation with a third of all rows is spread over tasks.
2. Heads are at most eight turns; they are joined to the conversations built on them.
3. Rows ``(conversation, depth, hash)`` are grouped into nodes with sums combined before the
   shuffle.  A node is accepted when all its members agree on the hash of the parent and on the
   last stored turn, and repeated turn digests when their texts are equal; then, by induction
   over depth, equal hashes are equal sequences.  Should one fail, all is done again with another
   salt.
4. Subtree sums need no walk over levels.  The owner of a node is its smallest member; who owns a
   node owns every deeper node on its path, so one depth per conversation says what it owns.
   Summed over the members of a node, the bytes from there to the end minus the bytes that are
   owned are the bytes saved in the subtree, and the members that own a childless node its leaves.

Defined results

* Turns are ordered by ``turn`` (null first), equal ones by the MD5 of role and text.  Null role or
  text is empty.  Equal rows of a conversation are turns of their own.
* Rows without conversation id belong to no conversation and are left out.
* A conversation without turns (its own end inside the head it skips, its base absent) is a member
  of the root only.  An empty table has no nodes, not even a root.
* Ids are longs; the base of a negative id is ``c - c % 5`` with the remainder's sign of SQL.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import clean_text, ready
from fleetlens.llm.field61 import BASES, P, Powers, minus, plus, running, times
from fleetlens.llm.hot import join_counted
from fleetlens.session import stored

#: Conversations are built on one in so many; heads have fewer turns than HEAD.
GROUP, HEAD = 5, 9
#: Ids joined to one text before they are hashed in order.
LIST = 4096
NODE = ["depth", "f1", "f2"]


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEAD).cast("int")


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def turn_digest(salt: str) -> Column:
    """16 bytes that stand for role and text; no two pairs are written alike."""
    size = F.octet_length("role").cast("string")
    return F.unhex(F.md5(F.concat(F.lit(salt), size, F.lit(":"), "role", "text")))


# --- prefixes of the stored conversations ------------------------------------------------


def _elements(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of every digest as numbers below P."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return halves[:, 0] % np.uint64(P), halves[:, 1] % np.uint64(P)


_SCAN = (
    "conv_id long, digest binary, bytes long, part int, last boolean, whole boolean, "
    "pos long, s1 long, s2 long, b1 long, b2 long, upto long"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix elements inside one partition; ``last`` marks its last row, ``whole`` says that the
    conversation of a row began the partition."""
    part = TaskContext.get().partitionId()
    powers = [Powers(base) for base in BASES]
    held = None  # the previous batch, whose last row may be the partition's
    conv, pos, upto, sums, opening = None, 0, 0, [0, 0], None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        size = batch.column("bytes").to_numpy(zero_copy_only=False)
        n = len(ids)
        opening = ids[0] if opening is None else opening
        new = np.ones(n, dtype=bool)
        new[1:] = ids[1:] != ids[:-1]
        new[0] = conv is None or ids[0] != conv
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        kept = first == 0 if not new[0] else np.zeros(n, dtype=bool)
        place = np.arange(n) - first + np.where(kept, pos, 0)
        total = np.cumsum(size)
        through = total - np.where(first > 0, total[first - 1], 0) + np.where(kept, upto, 0)
        columns = {}
        for k, t in enumerate(_elements(batch.column("digest"))):
            value = times(t, powers[k][place])
            s = plus(running(value, first), np.where(kept, np.uint64(sums[k]), np.uint64(0)))
            columns[f"s{k + 1}"], columns[f"b{k + 1}"] = s, minus(s, value)
            sums[k] = int(s[-1])
        conv, pos, upto = ids[-1], int(place[-1]) + 1, int(through[-1])
        held = pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id"),
                "digest": batch.column("digest"),
                "bytes": batch.column("bytes"),
                "part": pa.array(np.full(n, part, np.int32)),
                "last": pa.array(np.zeros(n, dtype=bool)),
                "whole": pa.array(ids == opening),
                "pos": pa.array(place + 1),
                **{name: pa.array(columns[name].astype(np.int64)) for name in ("s1", "s2", "b1", "b2")},
                "upto": pa.array(through),
            }
        )
    if held is not None:
        last = np.zeros(held.num_rows, dtype=bool)
        last[-1] = True
        yield held.set_column(held.schema.get_field_index("last"), "last", pa.array(last))


def _carries(scanned: DataFrame) -> dict[int, tuple]:
    """What goes before the first conversation of a partition: ``(conv, n, s1, s2, bytes)``.

    One row per partition reaches the driver.
    """
    found, kept = {}, None
    for r in scanned.where("last").select("part", "conv_id", "whole", "pos", "s1", "s2", "upto").orderBy("part").collect():
        if kept is not None:
            found[r.part] = kept
        element = (r.conv_id, r.pos, r.s1, r.s2, r.upto)
        if kept is not None and r.whole and kept[0] == r.conv_id:
            _, n, s1, s2, upto = kept
            moved = [(s + pow(base, n, P) * x) % P for base, s, x in zip(BASES, (s1, s2), (r.s1, r.s2))]
            element = (r.conv_id, n + r.pos, *moved, upto + r.upto)
        kept = element
    return found


def _carried(carries: dict[int, tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            names = ("pos", "s1", "s2", "b1", "b2", "upto")
            out = {c: batch.column(c).to_numpy(zero_copy_only=False).copy() for c in names}
            for part in np.unique(parts):
                if part not in carries:
                    continue
                conv, n, *before, upto = carries[part]
                at = np.flatnonzero((parts == part) & (ids == conv))
                if not len(at):
                    continue
                for k, base in enumerate(BASES):
                    step, start = np.uint64(pow(base, n, P)), np.uint64(before[k])
                    for c in (f"s{k + 1}", f"b{k + 1}"):
                        out[c][at] = plus(start, times(out[c][at], step)).astype(np.int64)
                out["pos"][at] += n
                out["upto"][at] += upto
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("conv_id", "digest", "bytes")} | {c: pa.array(out[c]) for c in names}
            )

    return run


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, digest, bytes, pos, s1, s2, b1, b2, upto`` of stored turns (``conv_id, turn, digest, bytes, at``).

    ``s`` is the hash of the prefix that ends with the turn, ``b`` of the one before it, ``upto``
    the bytes of the texts up to and with it.
    """
    ordered = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "digest", "at")
    scanned = stored(ordered.select("conv_id", "digest", "bytes").mapInArrow(_scan, _SCAN))
    schema = "conv_id long, digest binary, bytes long, pos long, s1 long, s2 long, b1 long, b2 long, upto long"
    return scanned.mapInArrow(_carried(_carries(scanned)), schema)


# --- rebuilt conversations ---------------------------------------------------------------


def rebuilt(placed: DataFrame) -> DataFrame:
    """One row per conversation: how it is put together.

    ``n`` own turns, ``skip`` of them replaced by ``taken`` turns of the base (``head``); ``s`` and
    ``upto`` of the base at the cut as ``base_*``, of its own at the cut as ``own_*``.
    """
    turn = F.struct("pos", "s1", "s2", "b1", "b2", "digest", "bytes", "upto")
    convs = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("size"),
        F.array_sort(F.collect_list(F.when(F.col("pos") < HEAD, turn))).alias("first"),
    )
    convs = stored(convs)
    base = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    both = convs.withColumn("base", base_of(F.col("conv_id"))).join(base, "base", "left")
    h = head_length(F.col("conv_id"))
    cut = F.least(h, F.col("n")).cast("int")
    both = both.withColumns({"skip": h, "taken": F.least(h, F.coalesce(F.size("head"), F.lit(0)))})

    def at(array: str, index: Column, field: str) -> Column:
        found = F.when(index > 0, F.get(array, index - 1)[field]).otherwise(F.lit(0))
        return F.coalesce(found, F.lit(0)).cast("long")

    values = {f"base_{c}": at("head", F.col("taken"), c) for c in ("s1", "s2", "upto")}
    values |= {f"own_{c}": at("first", cut, c) for c in ("s1", "s2", "upto")}
    length = (F.col("taken") + F.greatest(F.col("n") - h, F.lit(0))).cast("long")
    return both.withColumns(values).select(
        "conv_id",
        "n",
        "skip",
        "taken",
        *values,
        length.alias("length"),
        (F.col("base_upto") + F.col("size") - F.col("own_upto")).alias("total"),
        F.slice("head", F.lit(1), F.col("taken")).alias("head"),
    )


_ROWS = (
    "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, digest binary, bytes long, before long, is_end boolean"
)


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilt prefixes that end in a conversation's own turn: base element times own quotient."""
    # B^(taken - skip), whose exponents are -8 to 0.
    inverse = [np.array([pow(base, -k, P) for k in range(HEAD)], np.uint64) for base in BASES]
    for batch in batches:
        if not batch.num_rows:
            continue
        v = {
            c: batch.column(c).to_numpy(zero_copy_only=False)
            for c in batch.schema.names
            if c not in ("digest",)
        }
        back = v["skip"] - v["taken"]
        out = {}
        for k in (1, 2):
            shift = inverse[k - 1][back]
            for name, own in ((f"f{k}", f"s{k}"), (f"p{k}", f"b{k}")):
                quotient = times(minus(v[own], v[f"own_s{k}"]), shift)
                out[name] = pa.array(plus(v[f"base_s{k}"], quotient).astype(np.int64))
        depth = (v["pos"] - back).astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id"),
                "depth": pa.array(depth),
                **{c: out[c] for c in ("f1", "f2", "p1", "p2")},
                "digest": batch.column("digest"),
                "bytes": batch.column("bytes"),
                "before": pa.array(v["base_upto"] + v["upto"] - v["own_upto"] - v["bytes"]),
                "is_end": pa.array(depth == v["length"]),
            }
        )


def trie_rows(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and depth of its rebuilt form: hash, parent's hash, last turn, bytes before it."""
    zero = F.lit(0).cast("long")
    root = convs.select(
        "conv_id",
        zero.alias("depth"),
        *[zero.alias(c) for c in ("f1", "f2", "p1", "p2")],
        F.lit(b"").alias("digest"),
        zero.alias("bytes"),
        zero.alias("before"),
        (F.col("length") == 0).alias("is_end"),
    )
    head = convs.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id",
        F.col("t.pos").alias("depth"),
        F.col("t.s1").alias("f1"),
        F.col("t.s2").alias("f2"),
        F.col("t.b1").alias("p1"),
        F.col("t.b2").alias("p2"),
        "t.digest",
        "t.bytes",
        (F.col("t.upto") - F.col("t.bytes")).alias("before"),
        (F.col("t.pos") == F.col("length")).alias("is_end"),
    )
    # Where the base is the conversation itself, its turns fall back into place.
    cut = convs.where("n > skip").select(
        "conv_id", "n", "skip", "taken", "length", *[f"{side}_{c}" for side in ("base", "own") for c in ("s1", "s2", "upto")]
    )
    joined = join_counted(placed, cut, ["conv_id"], "n").where("pos > skip")
    return root.unionByName(head).unionByName(joined.mapInArrow(_own_rows, _ROWS))


# --- nodes -------------------------------------------------------------------------------


def _same_texts(conversations: DataFrame, repeated: DataFrame, salt: str) -> bool:
    """Whether every repeated digest stands for one role and text (compared whole)."""
    turns = conversations.select(turn_digest(salt).alias("digest"), "role", "text")
    ends = join_counted(turns, repeated, ["digest"], "copies").groupBy("digest").agg(
        F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"), F.max("text").alias("t1")
    )
    return ends.where("r0 <> r1 or t0 <> t1").isEmpty()


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.count_if("is_end").alias("n_ends"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.max("before").alias("before"),
        ((F.min("p1") != F.max("p1")) | (F.min("p2") != F.max("p2")) | (F.min("digest") != F.max("digest"))).alias("mixed"),
    )


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbouring ids of a node joined to texts of at most LIST ids."""
    for frame in batches:
        if frame.empty:
            continue
        keys = frame[NODE].to_numpy()
        new = np.ones(len(frame), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        cuts = np.unique(np.concatenate([np.arange(a, b, LIST) for a, b in zip(starts, [*starts[1:], len(frame)])]))
        ids = frame["conv_id"].astype(str).tolist()
        ends = [*cuts[1:], len(frame)]
        part = frame.iloc[cuts].copy()
        part["ids"] = [",".join(ids[a:b]) for a, b in zip(cuts, ends)]
        yield part


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the ids of each node, read in order; only the state of one node is held."""
    key, state = None, None

    def done() -> pd.DataFrame:
        return pd.DataFrame([(*key, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    for frame in batches:
        found = []
        for *node, ids in zip(*[frame[c].tolist() for c in NODE], frame["ids"].tolist()):
            if node != key:
                if key is not None:
                    found.append(done())
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if found:
            yield pd.concat(found, ignore_index=True)
    if key is not None:
        yield done()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256`` of ``(conv_id, depth, f1, f2)``.

    SHA-256 has to read a node's ids one after the other.  They are range-sorted and joined to
    texts of up to 4,096 ids first, over all tasks, and read as a stream then.
    """
    kinds = "depth long, f1 long, f2 long"
    texts = ends.select(*NODE, "conv_id").orderBy(*NODE, "conv_id").mapInPandas(_lists, f"{kinds}, conv_id long, ids string")
    placed = texts.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return placed.select(*NODE, "ids").mapInPandas(_hashes, f"{kinds}, ends_sha256 string")


def _checked(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, rows and nodes under a salt for which every group holds equal sequences."""
    salt = 0
    while True:
        name = "" if salt == 0 else f"{salt}/"
        turns = stored(
            conversations.select(
                "conv_id",
                "turn",
                turn_digest(name).alias("digest"),
                F.octet_length("text").cast("long").alias("bytes"),
                F.monotonically_increasing_id().alias("at"),
            )
        )
        repeated = stored(turns.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
        placed = stored(prefixes(turns))
        convs = stored(rebuilt(placed))
        rows = stored(trie_rows(placed, convs))
        nodes = stored(_nodes(rows))
        if nodes.where("mixed").isEmpty() and _same_texts(conversations, repeated, name):
            return convs, rows, nodes
        salt += 1


def prefix_trie(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    ready(conversations.sparkSession)
    clean = conversations.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        clean_text(F.col(role)).alias("role"),
        clean_text(F.col(text)).alias("text"),
    )
    convs, rows, nodes = _checked(clean)
    # What a conversation owns: the node where that starts, the bytes before it, and a leaf if one is its own.
    owned = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "before")).alias("top"), F.max(F.col("n_convs") == F.col("n_ends")).alias("leaf")
    )
    shares = convs.join(owned, "conv_id", "left").select(
        "conv_id",
        (F.col("length") + 1).alias("depths"),
        F.coalesce(F.col("top.before"), F.col("total")).alias("shared"),
        F.coalesce("leaf", F.lit(False)).alias("leaf"),
    )
    shares = stored(shares)
    sums = (
        join_counted(rows.select("conv_id", *NODE, "before"), shares, ["conv_id"], "depths")
        .groupBy(*NODE)
        .agg(
            F.count_if("leaf").alias("n_leaves"),
            F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
        )
    )
    above = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    children = above.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    hashes = ends_hashes(rows.where("is_end"))
    nothing = hashlib.sha256(b"").hexdigest()
    full = stored(
        nodes.join(sums, NODE, "left")
        .join(children, NODE, "left")
        .join(hashes, NODE, "left")
        .select(
            *NODE,
            "conv_id",
            "p1",
            "p2",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
    parents = full.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("f1").alias("p1"),
        F.col("f2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("weight"),
    )
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = join_counted(full.where("depth > 0"), parents, ["depth", "p1", "p2"], "weight")
    top = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return top.select(*kept).unionByName(below.select(*kept))
