"""Exact repeats of a fixed length, by bucket-pointer refinement of a sampled suffix array.

Buckets of equal q-grams get identifiers, and the bucket of twice the length at p is the
pair (identifier at p, identifier at p + q): 25, 50, 100 and 200 bytes.  Identifiers are
64-bit names of the content, so the pointer p + q needs no lookup in another task, and the
identifiers of one round are used again by the next.

Not every suffix is sorted.  Among the 101 places of a 200-byte string where a 100-byte
string starts, the smallest identifier depends on those 200 bytes only, so equal strings
have equal smallest identifiers.  Neighbouring strings with the same one form a run, about
one per 50 bytes; the run's bucket is that identifier.  Rounds:

1. runs by bucket: buckets of one run are dropped;
2. runs by (bucket, name of all the bytes of the run): in classes of two and more every
   string repeats;
3. a run that is alone in its class, in a bucket with other classes, is refined to the
   200-byte buckets of its single strings; a bucket with many classes is dealt to parts by
   those identifiers, so no group grows with the number of documents.

Each decision is made on 128 bits (a string's name within its bucket).  Per document only
the run list travels; whole texts are read twice and never shuffled unless the span list
outgrows the broadcast bound.

Defined results: null is the empty text; texts under the length repeat nothing; a repeated
row is a repeat of the other; overlapping repeats within one text count; tables without
rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bytes import BYTE_IDS, mix, pieces, signed, slide
from fleetlens.llm.common import clean_text, groups, known_id, real_id
from fleetlens.session import bounded_broadcast, stored

LENGTH = 200
#: Classes of one bucket that are compared in one group.
CLASSES = 1000
_RUNS = "rid long, pos long, n int, bucket long, ctx long, w int"


def _rounds(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of every place for ``length / 2`` and ``length`` bytes.

    ``length`` is 8 times the initial q.
    """
    q = length // 8
    ids, have = BYTE_IDS[data], 1
    # The initial buckets: q-grams, by doubling and one overlapping step to exactly q.
    while 2 * have <= q:
        ids, have = mix(ids[:-have], ids[have:]), 2 * have
    if have < q:
        ids = mix(ids[: len(ids) - (q - have)], ids[q - have :])
    for step in (q, 2 * q):
        ids = mix(ids[:-step], ids[step:])
    half = ids
    return half, mix(half[: -4 * q], half[4 * q :])


def _runs(texts: Iterable[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(row, pos, n, bucket, ctx, w)`` of the runs of each text."""
    width = length // 2 + 1
    for part in pieces(texts, overlap=length - 1):
        size = len(part.data)
        if size < length:
            continue
        half, full = _rounds(part.data, length)
        best = slide(half, width, np.minimum)
        owner = np.full(len(best), -1, dtype=np.int64)
        for at, (start, n) in enumerate(zip(part.starts, part.lengths)):
            if n >= length:
                owner[start : start + n - length + 1] = at
        valid = owner >= 0
        if not valid.any():
            continue
        new = np.ones(len(best), dtype=bool)
        new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(best))
        keep = valid[starts]
        starts, ends = starts[keep], ends[keep]
        # Periodic text gives long runs; pieces of at most ``width`` strings cover them.
        cuts = (ends - starts + width - 1) // width
        offset = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = np.repeat(starts, cuts) + width * offset
        ends = np.minimum(starts + width, np.repeat(ends, cuts))
        n = ends - starts
        bucket = best[starts]
        context = mix(mix(full[starts], full[ends - 1]), n.astype(np.uint64))
        # A smallest identifier that occurs twice within reach: the run may repeat itself.
        inside = np.where(valid, best, np.uint64(0))
        reach = slide(np.concatenate([np.zeros(width - 1, np.uint64), inside, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        chosen = np.flatnonzero(half == reach[: len(half)])
        again = (half[chosen[1:]] == half[chosen[:-1]]) & (np.diff(chosen) < width)
        twice = np.unique(half[chosen[1:][again]])
        weight = np.where(np.isin(bucket, twice), 2, 1) if len(twice) else np.ones(len(bucket), int)
        piece = owner[starts]
        pos = starts - part.starts[piece] + part.bases[piece]
        yield part.rows[piece], pos, n, bucket, context, weight


def _string_ids(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Identifiers of all strings of ``length`` bytes in each part."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    _, full = _rounds(data, length)
    at, found = 0, []
    for part in parts:
        found.append(full[at : at + len(part) - length + 1])
        at += len(part)
    return found


def _spread(length: int):
    """Probe runs to their strings: one row per run and part of its bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wanted = []
            for rid, text, probes in zip(frame["rid"], frame["text"], frame["probes"]):
                data = text.encode()
                wanted += [
                    (rid, p["pos"], p["bucket"], p["parts"], p["test"], data[p["pos"] : p["pos"] + p["n"] + length - 1])
                    for p in probes
                ]
            for first in range(0, len(wanted), 4096):
                block = wanted[first : first + 4096]
                out = []
                for (rid, pos, bucket, parts, test, _), ids in zip(block, _string_ids([w[5] for w in block], length)):
                    dealt = (ids % np.uint64(parts)).astype(np.int64)
                    for part in np.unique(dealt) if parts > 1 else (0,):
                        at = np.flatnonzero(dealt == part).astype(np.uint8)
                        out.append((bucket, int(part), rid, pos, test, at.tobytes(), ids[at].tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "part", "rid", "pos", "test", "at", "ids"])

    return run


def _repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of tested runs that occur twice in their bucket, as ``(rid, pos, n)`` runs."""
    rows = []
    for group in groups(frames, ["bucket", "part"]):
        ids = np.frombuffer(b"".join(group["ids"]), dtype=np.uint64)
        _, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        twice = counts[inverse] >= 2
        first = 0
        for rid, pos, test, at in zip(group["rid"], group["pos"], group["test"], group["at"]):
            places = np.frombuffer(at, dtype=np.uint8).astype(np.int64)
            hit = places[twice[first : first + len(places)]]
            first += len(places)
            if test and len(hit):
                cuts = np.flatnonzero(np.diff(hit) > 1) + 1
                for piece in np.split(hit, cuts):
                    rows.append((rid, pos + piece[0], len(piece)))
        if len(rows) > 20_000:
            yield pd.DataFrame(rows, columns=["rid", "pos", "n"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["rid", "pos", "n"])


def repeat_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rid, spans``: per text with repeats its covered byte ranges as packed int64 pairs.

    ``rid`` is ``xxhash64(doc_id, text)``; equal rows share it and are counted apart.
    """
    if length % 8 or not 16 <= length <= 500:
        raise ValueError("length must be a multiple of 8 from 16 to 500")
    docs = documents.select(F.xxhash64("doc_id", "text").alias("rid"), clean_text(F.col("text")).alias("text"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rid = frame["rid"].to_numpy()
            for row, pos, n, bucket, context, weight in _runs((t.encode() for t in frame["text"]), length):
                columns = (rid[row], pos, n, signed(bucket), signed(context), weight)
                yield pd.DataFrame(dict(zip(("rid", "pos", "n", "bucket", "ctx", "w"), columns)))

    runs = stored(docs.mapInPandas(find, _RUNS))
    # Stored, so that both sides of the join have a shuffle of their own and a hot bucket is split.
    shared = stored(runs.groupBy("bucket").agg(F.sum("w").alias("total")).where("total >= 2").select("bucket"))
    hit = stored(runs.drop("w").join(shared, "bucket"))
    classes = hit.groupBy("bucket", "ctx").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rid", "pos", "n")).alias("first"))
    classes = stored(classes)
    whole = hit.join(classes.where("size >= 2").select("bucket", "ctx"), ["bucket", "ctx"]).select("rid", "pos", "n")
    # Round 3: one run of each class stands for it where some class has a single run.
    open_buckets = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.min("size").alias("least"))
    open_buckets = stored(open_buckets.where("least = 1"))
    probes = classes.join(open_buckets, "bucket").select(
        "first.rid",
        F.struct(
            "first.pos",
            "first.n",
            "bucket",
            F.ceil(F.col("classes") / CLASSES).cast("int").alias("parts"),
            (F.col("size") == 1).alias("test"),
        ).alias("probe"),
    )
    # The list of one text is bounded by its length.
    probes = stored(probes.groupBy("rid").agg(F.collect_list("probe").alias("probes"), F.count(F.lit(1)).alias("many")))
    # A repeated row offers its strings twice.  They repeat anyway, so no answer changes.
    texts = docs.join(bounded_broadcast(probes, _rows_within(probes, "many", 32)), "rid")
    strings = texts.select("rid", "text", "probes").mapInPandas(
        _spread(length), "bucket long, part int, rid long, pos long, test boolean, at binary, ids binary"
    )
    single = strings.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInPandas(_repeated, "rid long, pos long, n int")
    # pos and n in one number: n is under 256.
    covered = whole.unionByName(single).select("rid", (F.col("pos") * 256 + F.col("n")).alias("code"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            packed = []
            for codes in frame["codes"]:
                codes = np.sort(np.asarray(codes, dtype=np.int64))
                start, end = codes >> 8, (codes >> 8) + (codes & 255) - 1 + length
                reach = np.maximum.accumulate(end)
                cut = np.append(True, start[1:] > reach[:-1])
                last = np.append(np.flatnonzero(cut)[1:] - 1, len(codes) - 1)
                packed.append(np.column_stack([start[cut], reach[last]]).tobytes())
            yield pd.DataFrame({"rid": frame["rid"], "spans": packed})

    return covered.groupBy("rid").agg(F.collect_set("code").alias("codes")).mapInPandas(merge, "rid long, spans binary")


def _rows_within(lists: DataFrame, count: str, each: int, most: int = 64 << 20) -> int:
    """Rows of ``lists`` that may be broadcast, from the sum of their list lengths."""
    total = lists.agg(F.sum(count)).first()[0] or 0
    return 1_000_000 if total * each <= most else 0


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, n_bytes, spans, kept``.

    ``spans`` are the removed byte ranges, ``kept`` the remaining bytes.
    """
    spans = stored(repeat_spans(documents, length))
    docs = documents.select(
        known_id(F.col("doc_id")).alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64("doc_id", "text").alias("rid"),
        clean_text(F.col("text")).alias("text"),
    )
    docs = docs.join(bounded_broadcast(spans), "rid", "left").select("doc_id", "text_hash", "text", "spans")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [np.frombuffer(s or b"", dtype=np.int64).reshape(-1, 2) for s in frame["spans"]]
            kept, sizes = [], []
            for text, pairs in zip(map(str.encode, frame["text"]), spans):
                sizes.append(len(text))
                edges = [0, *pairs.ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "text_hash": frame["text_hash"],
                    "n_bytes": sizes,
                    "spans": [[{"start": a, "end": b} for a, b in pairs.tolist()] for pairs in spans],
                    "kept": kept,
                }
            )

    schema = "doc_id long, text_hash long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return docs.mapInPandas(cut, schema).select(real_id("doc_id"), "text_hash", "n_bytes", "spans", "kept")
