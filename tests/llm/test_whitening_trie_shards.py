"""Whitening, the prefix trie and sharding against brute force, on small tables with hard rows."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import field61, prefix_trie as trie_module
from fleetlens.llm.hot import join_counted
from fleetlens.llm.prefix_trie import prefix_trie
from fleetlens.llm.sharding import differencing, levels_for, shard_documents
from fleetlens.llm.whitening import whiten

# --- joins with hot keys -----------------------------------------------------------------


def test_join_counted_equals_a_plain_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    found = join_counted(rows, lookup, ["k"], "n")
    assert found.columns == ["k", "id", "v"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.join(lookup.drop("n"), "k").collect()))


# --- op 11 -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x long, n string, w double"


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.4, (60, 6)).astype(np.float32)
    rows = [(i, [float(v) for v in base[i]], 1, 1, "n", 0.5) for i in range(60)]
    rows += [(i, rows[3][1], None, None, None, None) for i in range(60, 160)]  # one vector of many rows
    rows += [(3, rows[3][1], None, None, None, None), (None, rows[4][1], None, None, None, None)]
    # Differs from row 5 below the step of 1/256 only.
    near = [math.floor(256 * v) / 256 + 0.001 for v in rows[5][1]]
    rows += [(200, near, None, None, None, None)]
    rows += [
        (201, None, None, None, None, None),
        (202, [], None, None, None, None),
        (203, [0.5, None, 0.1, 0.1, 0.1, 0.1], None, None, None, None),
        (204, [float("nan")] * 6, None, None, None, None),
        (205, [float("inf")] + [0.0] * 5, None, None, None, None),
    ]
    rows += [(300 + i, [0.25 * i, 1.0], None, None, None, None) for i in range(5)]  # second entry without variance
    return rows


def brute_whitening(rows, weights="one"):
    """``{dim: (n, sums, covariance, x by id)}`` of the usable rows."""
    usable = []
    for vec_id, e, *_ in rows:
        if e and all(v is not None and math.isfinite(v) for v in e):
            usable.append((vec_id, tuple(math.floor(256 * float(np.float32(v))) for v in e)))
    out = {}
    for dim in {len(x) for _, x in usable}:
        part = [(i, x) for i, x in usable if len(x) == dim]
        counts = Counter(x for _, x in part)
        w = {x: 1 if weights == "one" else c for x, c in counts.items()}
        n = sum(w.values())
        sums = [sum(w[x] * x[k] for x in w) for k in range(dim)]
        centred = np.array([[float(x[k]) - sums[k] / n for k in range(dim)] for x in w])
        cov = (centred * np.array([[w[x]] for x in w])).T @ centred / n
        out[dim] = n, sums, cov, part
    return out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rows = vectors()
    found = whiten(spark.createDataFrame(rows, VECTORS).repartition(7), weights=weights).collect()
    expected = brute_whitening(rows, weights)
    assert Counter((r.id, r.component) for r in found) == Counter(
        (i, k + 1) for dim, (_, _, _, part) in expected.items() for i, _ in part for k in range(min(4, dim))
    )
    for dim, (n, sums, cov, part) in expected.items():
        values, vectors_ = np.linalg.eigh(cov)
        values, vectors_ = values[::-1], vectors_[:, ::-1]
        mine = [r for r in found if r.dim == dim]
        deviation = Counter((i, sum((n * v - s) ** 2 for v, s in zip(x, sums))) for i, x in part)
        for k in range(min(4, dim)):
            rows_k = [r for r in mine if r.component == k + 1]
            assert all(r.n == n for r in rows_k)
            assert Counter((r.id, r.deviation) for r in rows_k) == deviation
            assert rows_k[0].explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9, abs=1e-12)
            if values[k] < 1e-9:
                assert all(r.whitened is None for r in rows_k)
                continue
            by_x = {}
            got = defaultdict(list)
            for r in rows_k:
                got[r.id].append(r.whitened)
            want = defaultdict(list)
            for i, x in part:
                by_x[x] = (np.array(x) - np.array(sums) / n) @ vectors_[:, k] / math.sqrt(values[k])
                want[i].append(by_x[x])
            sign = 1 if got[part[0][0]][0] * want[part[0][0]][0] > 0 else -1
            for i in want:
                np.testing.assert_allclose(sorted(got[i]), sorted(sign * v for v in want[i]), atol=1e-9)
        assert mine[0].identity_error < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    found = whiten(same).collect()
    assert len(found) == 4 and all(r.n == 1 and r.deviation == 0 for r in found)
    assert all(r.whitened is None and r.explained is None and r.identity_error is None for r in found)
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_of_large_entries(spark):
    rows = [(i, [1e18 * i, 3.0 + i * i]) for i in range(4)] + [(9, [1e300, 0.0])]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = found.collect()
    # 256e18 is beyond a long, so all but the first are the largest long; the deviations do not fit.
    assert len(got) == 10 and {r.deviation for r in got} == {None}
    assert all(r.identity_error < 1e-4 for r in got)
    assert found.schema["deviation"].dataType.simpleString() == "bigint"


def test_whitening_needs_a_known_weight(spark):
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([], VECTORS), weights="rows")


# --- op 12 -------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, digest string, n long, depth long"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    turns = {c: [t for _, t in sorted(found, key=lambda p: p[0])] for c, found in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    found = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in convs if len(built[c]) == len(p))
        found.append(
            (
                min(convs),
                len(p),
                min(members[p[:-1]]) if p else None,
                len(convs),
                children[p],
                sum(not children[q] for q in below),
                sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return Counter(found)


def spoken():
    rng = random.Random(11)
    words = ["hi", "ok", "é" * 3, "", None, "long " * 400]
    rows = []
    for c in [*range(0, 60), -7, -10, -3, 2**60, 2**60 + 1, 2**60 + 3, 1003]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(words)))
    rows += [(3, 1, "user", "hi"), (3, 1, "user", "hi"), (3, 1, "tool", "ok"), (4, None, "user", "first"), (4, None, None, None)]
    rows += [(None, 1, "user", "nobody"), (777, 0, "user", "hi")]
    rows += [(5000 + 5 * k, turn, "user", "ok") for k in range(40) for turn in range(4)]  # many equal ones
    rows += [(42, turn, "user", f"turn {turn % 7}") for turn in range(100, 900)]  # one very long
    return rows


def trie_table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], TURNS)


def nodes_of(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 9])
def test_prefix_trie(spark, parts):
    rows = spoken()
    assert nodes_of(prefix_trie(trie_table(spark, rows).repartition(parts))) == brute_trie(rows)


def test_prefix_trie_continues_a_conversation_across_partitions(spark, monkeypatch):
    """Rows are spread over more partitions than there are conversations."""
    rows = [(5, t, "user", f"t{t}") for t in range(300)] + [(6, t, "user", f"t{t}") for t in range(200)] + [(0, 0, "a", "b")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = trie_module.prefixes(
            trie_table(spark, rows).select(
                "conv_id", "turn", trie_module.turn_digest("").alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.lit(0).alias("at")
            )
        ).collect()
        assert nodes_of(prefix_trie(trie_table(spark, rows))) == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv in (0, 5, 6):
        mine = sorted((r for r in placed if r.conv_id == conv), key=lambda r: r.pos)
        size, s = 0, [0, 0]
        for at, r in enumerate(mine):
            assert r.pos == at + 1 and (r.b1, r.b2) == tuple(s)
            halves = [int.from_bytes(r.digest[8 * k : 8 * k + 8], "big") % field61.P for k in (0, 1)]
            s = [(x + h * pow(base, at, field61.P)) % field61.P for x, h, base in zip(s, halves, field61.BASES)]
            size += r.bytes
            assert (r.s1, r.s2) == tuple(s) and r.upto == size


def test_prefix_trie_starts_again_when_digests_meet(spark, monkeypatch):
    """With digests of the length alone, equal hashes are not equal texts; a salt that tells them apart follows."""
    real, salts = trie_module.turn_digest, []

    def poor(salt):
        salts.append(salt)
        return F.unhex(F.md5(F.octet_length("text").cast("string"))) if not salt else real(salt)

    monkeypatch.setattr(trie_module, "turn_digest", poor)
    rows = [(c, t, "user", f"{c % 3}{t % 2}") for c in range(20) for t in range(4)]
    assert nodes_of(prefix_trie(trie_table(spark, rows))) == brute_trie(rows)
    assert set(salts) == {"", "1/"}


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie(trie_table(spark, [])).count() == 0
    assert prefix_trie(trie_table(spark, [(None, 0, "user", "x")])).count() == 0
    only_root = nodes_of(prefix_trie(trie_table(spark, [(1, 0, "user", "x")])))
    assert only_root == brute_trie([(1, 0, "user", "x")])


def test_field(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, field61.P, 500, dtype=np.uint64) for _ in range(2))
    edge = np.array([0, 1, field61.P - 1], np.uint64)
    a, b = np.concatenate([a, edge, edge]), np.concatenate([b, edge, edge[::-1]])
    assert field61.times(a, b).tolist() == [x * y % field61.P for x, y in zip(a.tolist(), b.tolist())]
    assert field61.plus(a, b).tolist() == [(x + y) % field61.P for x, y in zip(a.tolist(), b.tolist())]
    assert field61.minus(a, b).tolist() == [(x - y) % field61.P for x, y in zip(a.tolist(), b.tolist())]
    powers = field61.Powers(field61.BASES[0])
    assert powers[np.arange(70)].tolist() == [pow(field61.BASES[0], k, field61.P) for k in range(70)]


# --- op 13 -------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, shard int, slot long, digest string, bytes long, level int"


def plain_differencing(sizes, shards):
    """The sums differencing ends with, by its definition (item sets are not kept)."""
    heap = [(-s, at, [s] + [0] * (shards - 1)) for at, s in enumerate(sizes)]
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((a + b for a, b in zip(one, two[::-1])), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], at, both))
        at += 1
    return sorted(heap[0][2])


@pytest.mark.parametrize("shards", [1, 2, 3, 16])
def test_differencing_is_karmarkar_karp(shards):
    rng = random.Random(shards)
    for n in (1, 2, 5, 40, 500):
        sizes = [int(rng.paretovariate(1.1) * 100) for _ in range(n)]
        found = differencing(sizes, shards)
        sums = [0] * shards
        for size, shard in zip(sizes, found):
            sums[shard] += size
        assert sorted(sums) == plain_differencing(sizes, shards)
    assert differencing([], shards) == []


def test_differencing_beats_largest_first():
    sizes = [8, 7, 6, 5, 4]  # the classic example: largest first ends with 17 and 13
    sums = [0, 0]
    for size, shard in zip(sizes, differencing(sizes, 2)):
        sums[shard] += size
    assert sorted(sums) == [14, 16]


def documents(n=900):
    rng = random.Random(2)
    rows = [(i, "w" * int(rng.paretovariate(0.9) * 50), 1, 1, "x", 1, 1) for i in range(n)]
    rows += [(i, "copy " * 30, None, None, None, None, None) for i in range(n, n + 300)]
    rows += [(None, None, *[None] * 5), (None, None, *[None] * 5), (7, "", *[None] * 5), (7, "é" * 40, *[None] * 5)]
    rows += [(8, "x" * 300_000, *[None] * 5)]
    return rows


def check_shards(found, rows, shards=16):
    assert Counter((r.id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    home = defaultdict(set)
    for r in found:
        home[bytes(r.digest)].add(r.shard)
    assert all(len(s) == 1 for s in home.values()) and len(home) == len({t or "" for _, t, *_ in rows})
    load = [0] * shards
    for r in found:
        load[r.shard] += r.size
    return load


def test_shards(spark):
    rows = documents()
    found = shard_documents(spark.createDataFrame(rows, TEXTS).repartition(6)).collect()
    load = check_shards(found, rows)
    sizes = Counter()
    for _, t, *_ in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    # One group is larger than a shard; the others share what is left as evenly as plain differencing does.
    best = plain_differencing(sorted(sizes.values(), reverse=True), 16)
    assert max(load) == best[-1] and max(load) - min(load) <= best[-1] - best[0] + 16


def test_shards_with_few_parcels(spark):
    """With few parcels several levels do the work that single items do above; one group needs most of a shard."""
    rows = [(i, f"{i} " + "a" * (i * 37 % 400), *[None] * 5) for i in range(5000)] + [(1, "b" * 60_000, *[None] * 5)]
    assert levels_for(5000, 16 * 4) == 4
    found = shard_documents(spark.createDataFrame(rows, TEXTS), heads=16, parcels=4).collect()
    load = check_shards(found, rows)
    assert max(load) - min(load) <= 0.002 * sum(load) / 16


def test_shards_of_little(spark):
    assert shard_documents(spark.createDataFrame([], TEXTS)).count() == 0
    rows = [(1, "a", *[None] * 5), (1, "a", *[None] * 5), (2, None, *[None] * 5)]
    found = shard_documents(spark.createDataFrame(rows, TEXTS), shards=4).collect()
    check_shards(found, rows, 4)
    assert len({r.shard for r in found}) == 2
