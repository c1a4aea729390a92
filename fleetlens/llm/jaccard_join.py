"""N-gram Jaccard join: MinHash banding, then exact verification.

A text is the set of its runs of ``SHINGLE`` words (words as in the decontamination: digits,
letters a-z after lower-casing A-Z, and anything beyond ASCII); a text of fewer words, but
not none, is one shingle.  Texts with the same word sequence are one class and enter the
banding once.

The dealt LSH forest is a fixed banding here.  A text's label in each of ``TREES`` trees is a
sequence of minimum hashes; texts are candidates where their labels share a prefix.  The
prefix length is the longest, up to ``DEEPEST``, at which the recall of pairs at the
threshold, 1 - (1 - s^depth)^trees, reaches the target.  It depends on the parameters alone
(5 with those given), so only hashes up to it are made, one key per tree and text, and no
tries are stored or shortened.  Keys shared by several texts link them to the smallest one,
and the components of those links are the candidate clusters.

Verification is exact, on the shingle sets, inside each cluster: every text's set travels
once to each block pair of its cluster, a block holding at most about ``BLOCK`` texts or
``BLOCK_SHINGLES`` shingles.  A large cluster is dealt to many tasks that way; no row is
made for a pair, only counts of links and one link towards the smallest linked text.

Defined results: documents without words, or with a null id or text, are linked to nothing
and are their own class; repeated rows and equal texts are copies and count as links; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bytes import BYTE_IDS, mix, scramble, signed
from fleetlens.llm.common import NO_ID, clean_text, giving_back, groups, known_id, real_id
from fleetlens.llm.graph import components
from fleetlens.session import bounded_broadcast, stored

SHINGLE = 5
SIMILARITY = 0.8
TREES = 32
DEEPEST = 8
RECALL = 0.99999
BLOCK = 512
BLOCK_SHINGLES = 2_000_000

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes worked on at a time.
_LIMIT = 1 << 19
_BASE = np.uint64(0xD6E8FEB86659FD93)


def recall_at(depth: int, similarity: float, trees: int) -> float:
    """Share of pairs of ``similarity`` that share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix that still reaches the target recall."""
    depth = deepest
    while depth > 1 and recall_at(depth, similarity, trees) < recall:
        depth -= 1
    return depth


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_ids(data: np.ndarray, owner_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(identifier, start)`` of each word of a buffer; words end where a text starts."""
    inside = _WORD_BYTE[data]
    head = np.zeros(len(data) + 1, dtype=bool)
    head[owner_starts] = True
    begin, final = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | head[1:-1]
    final[:-1] &= ~inside[1:] | head[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_IDS[_LOWER[data]] * up[: len(data)], out=sums[1:])
    return scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _shingles(words: np.ndarray, first: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle identifiers of texts whose words are ``words[first : first + count]``, and their text."""
    ids = words
    if len(words) >= k:
        ids = words[: len(words) - k + 1]
        for step in range(1, k):
            ids = mix(ids, words[step : len(words) - k + 1 + step])
    made = np.maximum(count - k + 1, 0)
    owner = np.repeat(np.arange(len(first)), made)
    at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(first, made)
    found = ids[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        one = [functools.reduce(mix, [words[i : i + 1] for i in range(first[t], first[t] + count[t])], np.full(1, count[t], np.uint64)) for t in short]
        found = np.concatenate([found, *one])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner


def _word_cuts(text: bytes) -> list[bytes]:
    """A long text in parts of about ``_LIMIT`` bytes, cut between words."""
    parts, start = [], 0
    while start < len(text):
        end = min(start + _LIMIT, len(text))
        while end < len(text) and _WORD_BYTE[text[end]]:
            end += 1
        parts.append(text[start:end])
        start = end
    return parts


def _texts_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, words, first, count)`` for groups of whole texts that hold about ``_LIMIT`` bytes."""
    zero = np.zeros(1, dtype=np.int64)
    for row in [row for row, text in enumerate(texts) if len(text) > _LIMIT]:
        words = np.concatenate([word_ids(np.frombuffer(part, np.uint8), zero)[0] for part in _word_cuts(texts[row])])
        yield np.array([row]), words, zero, np.array([len(words)])
    small = [row for row, text in enumerate(texts) if len(text) <= _LIMIT]
    while small:
        size = np.cumsum([len(texts[row]) for row in small[: 1 + _LIMIT // 16]])
        take = max(1, int(np.searchsorted(size, _LIMIT)))
        rows, small = small[:take], small[take:]
        lengths = np.array([len(texts[row]) for row in rows])
        starts = np.cumsum(lengths) - lengths
        ids, at = word_ids(np.frombuffer(b"".join(texts[row] for row in rows), np.uint8), starts)
        first = np.searchsorted(at, starts)
        yield np.array(rows), ids, first, np.searchsorted(at, starts + lengths) - first


def _sketch(depth: int, trees: int, k: int):
    """Per text: a name of its word sequence, its shingle count and a prefix key per tree."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, words, first, count in _texts_words([t.encode() for t in frame["text"]]):
                table = frame.iloc[rows][["doc_id", "text_hash"]].assign(name1=None, name2=None, shingles=0, keys=None)
                kept = count > 0
                first, count = first[kept], count[kept]
                if not len(first):
                    yield table
                    continue
                place = (np.arange(len(words)) - np.repeat(first, count)).astype(np.uint64)
                name1 = np.add.reduceat(mix(words, place), first)
                name2 = np.add.reduceat(mix(place + np.uint64(1), words), first)
                ids, owner = _shingles(words, first, count, k)
                heads = np.searchsorted(owner, np.arange(len(first)))
                keys = np.empty((len(first), trees), dtype=np.uint64)
                for tree in range(trees):
                    key = np.full(len(first), tree + 1, dtype=np.uint64)
                    for level in range(depth):
                        least = np.minimum.reduceat(ids * factors[tree * depth + level], heads)
                        key = mix(key, least)
                    keys[:, tree] = key
                yield table[~kept]
                yield table[kept].assign(
                    name1=signed(scramble(name1)),
                    name2=signed(scramble(name2)),
                    shingles=np.diff(np.append(heads, len(ids))),
                    keys=list(signed(keys)),
                )

    return run


def _sets(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, words, first, count in _texts_words([t.encode() for t in frame["text"]]):
                ids, owner = _shingles(words, first, count, k)
                parts = np.split(ids, np.searchsorted(owner, np.arange(1, len(rows))))
                yield frame.iloc[rows].drop(columns="text").assign(ids=[np.unique(part).tobytes() for part in parts])

    return run


def _linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    _, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    for start in range(0, int(columns[-1]) + 1, width):
        a, b = np.searchsorted(columns, (start, start + width))
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[rows[a:b], columns[a:b] - start] = 1
        shared += block @ block.T
    either = sizes[:, None] + sizes[None, :] - shared.astype(np.float64)
    # Counts are whole numbers; the margin only undoes the rounding of the product.
    linked = shared >= similarity * either - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _verify(similarity: float):
    """Links within a block, or between two blocks, of a cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in groups(frames, ["cluster", "one", "two"]):
            # Repeated rows of the representative come as repeated members.
            group = group.drop_duplicates("node")
            if len(group) < 2:
                continue
            linked = _linked([np.frombuffer(ids, dtype=np.uint64) for ids in group["ids"]], similarity)
            if group["one"].iloc[0] != group["two"].iloc[0]:
                block = group["block"].to_numpy()
                linked &= block[:, None] != block[None, :]
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            links = linked @ copies
            label = node
            while True:
                near = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
                if (near >= label).all():
                    break
                label = np.minimum(label, near)
            for row in np.flatnonzero(links):
                out.append((node[row], links[row], label[row]))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["node", "links", "root"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["node", "links", "root"])

    return run


def jaccard_join(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    trees: int = TREES,
    deepest: int = DEEPEST,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, copy_id, class_id, n_links``.

    ``copy_id`` is the smallest id with the same word sequence, ``class_id`` the smallest id
    connected by links, ``n_links`` the number of other rows linked directly, copies
    included.
    """
    depth = prefix_depth(similarity, trees, deepest, recall)
    docs = documents.select(
        known_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), clean_text(F.col("text")).alias("text")
    )
    schema = "doc_id long, text_hash long, name1 long, name2 long, shingles long, keys array<long>"
    sketch = stored(docs.mapInPandas(giving_back(_sketch(depth, trees, shingle)), schema))
    # One node per word sequence; its name stands for it, its first row offers the text.
    texts = sketch.where(F.col("name1").isNotNull() & (F.col("doc_id") != NO_ID)).groupBy("name1", "name2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.first("shingles").alias("shingles"),
    )
    texts = stored(texts.select(F.col("name1").alias("node"), "name2", "first.*", "copies", "shingles"))
    # One key per tree; a shared key links its texts to the smallest.
    prefixes = sketch.join(texts.select("node", "name2", "doc_id", "text_hash"), ["name2", "doc_id", "text_hash"])
    prefixes = stored(prefixes.where("name1 = node").select("node", F.explode("keys").alias("prefix")))
    shared = prefixes.groupBy("prefix").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    edges = prefixes.join(shared, "prefix").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    members = components(edges).join(texts, "node")
    blocks = members.groupBy("label").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    members = members.join(blocks, "label").select(
        F.col("label").alias("cluster"), "node", "doc_id", "text_hash", "copies", "blocks", block
    )
    members = stored(members)
    sets = docs.join(bounded_broadcast(members), ["doc_id", "text_hash"])
    sets = sets.select("cluster", "node", "copies", "blocks", "block", "text").mapInPandas(
        giving_back(_sets(shingle)), "cluster long, node long, copies long, blocks int, block int, ids binary"
    )
    pairs = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(
        "cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "block", "copies", "ids"
    )
    checked = pairs.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "node")
    checked = stored(checked.mapInPandas(giving_back(_verify(similarity)), "node long, links long, root long"))
    linked = components(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    found = texts.join(links, "node", "left").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = found.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    found = found.join(classes, "label").select(
        F.col("node").alias("name1"),
        "name2",
        F.col("doc_id").alias("copy_id"),
        "class_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    answer = sketch.join(found, ["name1", "name2"], "left")
    linkable = F.col("doc_id") != NO_ID
    return answer.select(
        real_id("doc_id"),
        "text_hash",
        F.when(linkable, F.coalesce("copy_id", "doc_id")).alias("copy_id"),
        F.when(linkable, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(linkable, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )
