"""The operators' own functions against brute force, mostly without Spark."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import fingerprints, jaccard_join, repeats, secrets, sentence_pieces, suffix_tree_lm, toxicity


# --- repeats ---------------------------------------------------------------------------


def test_runs_cover_every_string_once_and_equal_strings_share_a_bucket():
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 123, 300, dtype=np.uint8))
    texts = [
        bytes(rng.integers(97, 123, 150, dtype=np.uint8)) + shared,
        shared + bytes(rng.integers(97, 123, 400, dtype=np.uint8)),
        b"",
        b"ab" * 300,
        shared[:199],
        bytes(rng.integers(97, 123, 5000, dtype=np.uint8)),
    ]
    bucket, weight = {}, {}
    for rows, pos, n, buckets, _, w in repeats._runs(texts, 200):
        for row, start, count, name, k in zip(rows, pos, n, buckets, w):
            weight[name] = weight.get(name, 0) + k
            for at in range(start, start + count):
                assert (row, at) not in bucket
                bucket[row, at] = name
    seen: dict[bytes, list] = {}
    for row, text in enumerate(texts):
        for at in range(len(text) - 199):
            seen.setdefault(text[at : at + 200], []).append((row, at))
    assert set(bucket) == {place for places in seen.values() for place in places}
    for places in seen.values():
        assert len({bucket[place] for place in places}) == 1
        assert len(places) < 2 or weight[bucket[places[0]]] >= 2


def test_pieces_of_a_long_text_overlap():
    text = bytes(np.random.default_rng(1).integers(0, 256, 3_000_000, dtype=np.uint8))
    counts = sum(n.sum() for _, _, n, _, _, _ in repeats._runs([text], 200))
    assert counts == len(text) - 199


# --- sentence pieces -------------------------------------------------------------------


@pytest.fixture(scope="module")
def toy():
    words = "▁ a b c ab bc abc ▁a ▁ab ca cab ▁▁".split()
    scores = {piece: (-float(len(piece) % 3) - at / 8, at + 256) for at, piece in enumerate(words)}
    return sentence_pieces.Pieces(scores, list(range(256)), -20.0)


def brute_force(pieces, text):
    """Largest sum over all segmentations."""
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in pieces.scores:
                best[end] = max(best[end], best[start] + pieces.scores[piece][0])
            elif end - start == 1:
                best[end] = max(best[end], best[start] + pieces.unknown)
    return best[-1]


def total(pieces, ids):
    by_id = {i: score for score, i in pieces.scores.values()}
    return sum(by_id[i] if i >= 256 else 0 for i in ids)


def test_segmentation_is_the_best(toy):
    for letters in itertools.product("▁abc", repeat=6):
        text = "".join(letters)
        assert total(toy, toy.segment(text)[1]) == pytest.approx(brute_force(toy, text))


def in_chunks(pieces, text, size):
    frames = sentence_pieces._chunks(iter([pd.DataFrame({"row_key": [1], "text": [text]})]), size, pieces.longest)
    chunks = [(sentence_pieces._text(b), sentence_pieces._text(a)) for f in frames for b, a in zip(f["body"], f["ahead"])]
    entry = np.full(pieces.longest, -math.inf)
    entry[0] = 0
    forward = []
    for body, ahead in chunks:
        inner = pieces.inner(body)
        exits, leads, lengths = pieces.through(body, ahead, entry.tolist(), inner)
        forward.append((body, ahead, leads, lengths, inner))
        entry = (entry[:, None] + pieces.transfer(body, ahead, inner)).max(axis=0)
        assert entry[: len(exits)].tolist() == pytest.approx(exits)
    state, ids = 0, []
    for body, ahead, leads, lengths, inner in reversed(forward):
        ids = pieces.trace(body, ahead, state, lengths, inner).tolist() + ids
        state = leads[state]
    return ids


def test_chunks_give_the_same_pieces(toy):
    rng = np.random.default_rng(5)
    for size in (3, 4, 7, 50):
        for _ in range(40):
            text = "".join(rng.choice(list("abcx "), rng.integers(1, 60)))
            assert in_chunks(toy, text, size) == toy.segment(sentence_pieces.shown(text))[1]


def test_real_vocabulary_round_trip():
    pieces = sentence_pieces.Pieces.load()
    for text in ("", " ", "a▁b", "▁", "x\n\ty  z ", "日本語 🎉 é", "\x00\x7f", "w" * 5000):
        ids = sentence_pieces.encode_text(text, pieces)
        assert b"".join(pieces.spelled[i] for i in ids.tolist()).decode()[1:] == text
        assert total(pieces, ids.tolist()) <= 0


def test_words_met_first_are_not_segmented_again(monkeypatch):
    pieces, alone = sentence_pieces.Pieces.load(), sentence_pieces.Pieces.load()
    pieces.words.most = 50
    done, all_at_once = [], pieces.segment_all
    monkeypatch.setattr(pieces, "segment_all", lambda words: done.extend(words) or all_at_once(words))
    long = "long" * sentence_pieces.LONG_WORD
    texts = ["the common words", f"  spaces  and {long} ▁ ", "", *(f"n{i} m{i} k{i}" for i in range(200)), "common the"]
    for text in texts:
        assert sentence_pieces.encode_texts([text], pieces)[0].tolist() == alone.segment(sentence_pieces.shown(text))[1]
        assert len(pieces.words) <= 2 * 50 + 10
    assert done.count("▁common") == done.count("▁the") == 1
    together = sentence_pieces.encode_texts(texts, pieces)
    assert [ids.tolist() for ids in together] == [alone.segment(sentence_pieces.shown(text))[1] for text in texts]
    assert pieces.spell(together) == texts and pieces.spell([]) == []


# --- suffix tree -----------------------------------------------------------------------


def small_model(spark):
    """Trained so that a lists b, and (a, b) lists a."""
    texts = ["a b a", "a b a c", "c b", "b b c", "a b a", "c c b b"] * 3 + ["a b a", "d e"]
    corpus = suffix_tree_lm.encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    return corpus, suffix_tree_lm.train(corpus, bits=2, min_seen=3)


def test_next_words_add_up_to_one(spark):
    corpus, tree = small_model(spark)
    assert len(tree.sizes) >= 2
    words = ["a", "b", "c", "d", "e", "unseen"]
    starts = ["", "a", "b", "a b", "b a", "c b", "unseen a", "a unseen a b", "a b a b"]
    rows = [(0, s) for s in starts] + [(1, f"{s} {w}") for s in starts for w in words]
    other = suffix_tree_lm.encode(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))
    assert other.salt == corpus.salt
    log = {r.doc_id: r.score for r in suffix_tree_lm.score_texts(other, tree).collect()}

    def whole(text):
        """P of the words alone: the score without the end token's factor, from texts one word longer."""
        return 10 ** log[[t for _, t in rows].index(text)]

    coded = other.texts.select("doc_id", "tokens").collect()
    tokens = {r.doc_id: np.frombuffer(r.tokens, dtype=np.int64) for r in coded}
    assert all(len(tokens[i]) == len(t.split()) + 1 for i, (_, t) in enumerate(rows))
    entries = {r.key: r.score for r in tree.entries.collect()}
    base = suffix_tree_lm.SuffixTree.unseen.fget(tree)[1]

    def p(history, word):
        x = np.array([*history, word], dtype=np.int64)
        total = base + entries.get(int(word), 0.0)
        for k in range(1, len(history) + 1):
            context = suffix_tree_lm.runs(x[:-1], k)[-1]
            key = int(context ^ suffix_tree_lm._CONTEXT)
            if key not in entries:
                break
            total += entries[key] + entries.get(int(suffix_tree_lm.runs(x, k + 1)[-1]), 0.0)
        return 10**total

    known = [*(suffix_tree_lm._key(w.encode(), 0) for w in words), suffix_tree_lm._key(b"\n", 0)]
    for at, start in enumerate(starts):
        history = tokens[at][:-1].tolist()
        assert sum(p(history, w) for w in known) == pytest.approx(1)
        text = np.prod([p(history[:i], w) for i, w in enumerate([*history, known[-1]])])
        assert whole(start) == pytest.approx(text)


def test_long_texts_in_pieces():
    rng = np.random.default_rng(4)
    coded = [rng.integers(-9, 9, n).astype(np.int64) for n in (1, 250, 3, 99, 1000)]
    for depth in (0, 1, 5):
        whole = next(suffix_tree_lm.pieces([x.tobytes() for x in coded], depth, 10_000))
        seen = []
        for piece in suffix_tree_lm.pieces([x.tobytes() for x in coded], depth, 100):
            assert len(piece.x) <= 200 + depth
            keys = suffix_tree_lm.runs(piece.x, depth + 1)
            at = np.flatnonzero(piece.place >= depth)
            seen += zip(piece.owner[at].tolist(), piece.place[at].tolist(), keys[at].tolist())
        at = np.flatnonzero(whole.place >= depth)
        keys = suffix_tree_lm.runs(whole.x, depth + 1)
        assert sorted(seen) == sorted(zip(whole.owner[at].tolist(), whole.place[at].tolist(), keys[at].tolist()))


def test_rows_go_to_spark_in_bounded_batches():
    n = 2 * suffix_tree_lm.BATCH + 5
    found = list(suffix_tree_lm.batches({"a": np.arange(n), "b": np.arange(n) * 2}))
    assert [len(frame) for frame in found] == [suffix_tree_lm.BATCH] * 2 + [5]
    assert [a for frame in found for a in frame["a"]] == list(range(n))
    assert all((frame["b"] == 2 * frame["a"]).all() for frame in found)
    # What a task holds of its texts: keys, places and owners, and the pairs not yet counted.
    held = 3 * 8 * (suffix_tree_lm.PIECE + suffix_tree_lm._FLUSH_PAIRS)
    assert held <= 16 << 20


def test_packed_rows_and_buckets():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(-(2**63), 2**63 - 1, 70_000))
    for bits in (0, 1, 5):
        bucket = suffix_tree_lm.bucket_of(keys, bits)
        assert bucket.min() == 0 and bucket.max() == (1 << bits) - 1 and (np.diff(bucket) >= 0).all()
        rows = suffix_tree_lm.in_buckets(bucket, keys, bucket.astype(np.uint32))
        assert len(rows) == 1 << bits and rows["size"].sum() == len(keys)
        parts = [suffix_tree_lm.unpack(r.data, r.size, (np.int64, np.uint32)) for r in rows.itertuples()]
        assert (np.concatenate([part[0] for part in parts]) == keys).all()
        assert all((part[1] == r.bucket).all() for part, r in zip(parts, rows.itertuples()))
        assert rows["data"].map(len).sum() < 9 * len(keys)
    assert suffix_tree_lm.in_buckets(keys[:0], keys[:0]).empty
    assert [suffix_tree_lm.bucket_bits(n * suffix_tree_lm.BUCKET) for n in (0, 1, 2, 3, 4, 5)] == [0, 0, 1, 2, 2, 3]


def test_packed_keys_in_order_take_less_room():
    rng = np.random.default_rng(6)
    some = rng.integers(-(2**63), 2**63 - 1, 60_000)
    keys = np.sort(np.concatenate([some, some[:40_000]]))
    owner = rng.integers(0, 1500, len(keys)).astype(np.uint32)
    data = suffix_tree_lm.pack(keys, owner)
    # Eight bytes of a key and three of an owner otherwise; most steps have the same two high bytes.
    assert len(data) < 6.5 * len(keys)
    got = suffix_tree_lm.unpack(data, len(keys), (np.int64, np.uint32))
    assert (got[0] == keys).all() and (got[1] == owner).all()
    shuffled = rng.permutation(keys), rng.random(len(keys)), owner % 2 == 0
    for one in ((0, 0), (5, 5), (len(keys), len(keys))):
        columns = [column[: one[0]] for column in shuffled]
        got = suffix_tree_lm.unpack(suffix_tree_lm.pack(*columns), one[1], (np.int64, np.float64, np.bool_))
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, columns))


def test_bit_table_is_made_of_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "_FLUSH_PAIRS", 700)
    keys = np.random.default_rng(7).integers(-(2**63), 2**63 - 1, 5000)
    table = spark.createDataFrame(pd.DataFrame({"key": keys})).repartition(3)
    made = []
    monkeypatch.setattr(suffix_tree_lm, "by_bucket", lambda rows, *order, f=suffix_tree_lm.by_bucket: made.append(rows.count()) or f(rows, *order))
    for most in (64, 1 << 12, 1 << 27):
        found = suffix_tree_lm.Filter.of(table, "key", most)
        size = min(1 << 18, most)
        want = np.zeros(size, dtype=bool)
        for by in (0, 33):
            want[(keys >> by) & (size - 1)] = True
        assert (np.unpackbits(found.bits.view(np.uint8), bitorder="little").astype(bool) == want).all()
        assert found.has(keys).all()
    # Not a row for every key goes between tasks.
    assert len(made) == 3 and max(made) < 1000
    assert not suffix_tree_lm.Filter.of(table.where("false"), "key").bits.any()


def test_scores_do_not_depend_on_buckets_and_parts(spark, monkeypatch):
    corpus, tree = small_model(spark)

    def scores(tree, shortcut):
        found = suffix_tree_lm.score_texts(corpus, tree, shortcut)
        return sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in found.collect())

    want = scores(tree, 1_000_000)
    monkeypatch.setattr(suffix_tree_lm, "BUCKET", 3)
    monkeypatch.setattr(suffix_tree_lm, "PART", 10)
    again = suffix_tree_lm.train(corpus, bits=2, min_seen=3)
    assert again.sizes == tree.sizes and again.entries.count() == tree.entries.count()
    assert scores(again, 0) == scores(again, 4) == want


def test_words_that_share_a_key_get_another_salt(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    encoded, counted = suffix_tree_lm.encode_texts, suffix_tree_lm.count_words
    salts = []

    def salted(texts, salt):
        salts.append(salt)
        return encoded(texts, salt)

    def clashing(coded):
        return counted(coded).withColumn("clash", F.lit(len(salts) < 3))

    monkeypatch.setattr(suffix_tree_lm, "encode_texts", salted)
    monkeypatch.setattr(suffix_tree_lm, "count_words", clashing)
    corpus = suffix_tree_lm.encode(rows)
    assert salts == [0, 1, 2] and corpus.salt == 2
    assert suffix_tree_lm.train(corpus).n == 5


def test_tokens_know_ascii_space_only():
    assert suffix_tree_lm.tokens("A\tÉ b\x0bC\x1cd") == ["a".encode(), "É b".encode(), b"c\x1cd"]


# --- jaccard ---------------------------------------------------------------------------


def test_words_and_names():
    texts = [b"", b"One two, THREE", b"one two three!", "é1 x".encode(), b"...", b"a" * 10]
    found = {}
    for rows, words, first, count in jaccard_join._texts_words(texts):
        for row, start, n in zip(rows, first, count):
            found[row] = words[start : start + n].tolist()
    assert [len(found[i]) for i in range(6)] == [0, 3, 3, 2, 0, 1]
    assert found[1] == found[2]


def test_long_text_is_cut_between_words(monkeypatch):
    text = b" ".join(b"w%d" % i for i in range(2000))
    whole = [w.tolist() for _, w, _, _ in jaccard_join._texts_words([text])]
    monkeypatch.setattr(jaccard_join, "_LIMIT", 64)
    cut = [w.tolist() for _, w, _, _ in jaccard_join._texts_words([text])]
    assert whole == cut


def test_links_are_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.random(60) < 0.95], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64))) for _ in range(40)]
    linked = jaccard_join._linked(sets, 0.8)
    for i, j in itertools.combinations(range(40), 2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        assert linked[i, j] == linked[j, i] == (5 * len(a & b) >= 4 * len(a | b))


def test_prefix_depth_reaches_the_recall():
    depth = jaccard_join.prefix_depth(0.8, 32, 8, 0.99999)
    assert jaccard_join.recall_at(depth, 0.8, 32) >= 0.99999 > jaccard_join.recall_at(depth + 1, 0.8, 32)


# --- secrets ---------------------------------------------------------------------------


def brute_spans(text):
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(start, end, secrets.KINDS[kind]) for start, kind, end in sorted(found)]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "PassWord = 'abcdefgh' token:short secret=x=yyyyyyyyyy",
        "token: secret: abcdefghijk",
        "AKIA" + "A" * 11 + " AKIA" + "B" * 12 + " AKIAAKIA" + "C" * 9,
        "f" * 31 + " " + "0" * 32 + "x" + "a1" * 40,
        "api_key=" + "0123456789abcdef" * 2 + " APIKEY:\"" + "Z" * 8,
        "é" * 5 + "passwd=äbcdefgh secret=" + "a" * 8,
        "ſecret=abcdefghij toKen=abcdefghijk",
    ],
)
def test_patterns(text):
    assert secrets.base_spans(text) == brute_spans(text)


def lines_with_secrets(n):
    rng = np.random.default_rng(11)
    words = "the cat sat on a mat with some other old words and more".split()
    for i in range(n):
        text = rng.choice(words, 30).tolist()
        if i % 2:
            text[10:10] = ["password=" + "".join(rng.choice(list("0123456789abcdef"), 18))]
        if i % 3:
            text[20:20] = [str(rng.integers(10**15, 10**16))]
        yield " ".join(text) + "."


def test_field_learns_and_viterbi_is_the_best():
    field = secrets.fit(lines_with_secrets(300), rounds=80)
    cache = secrets.TypeCache(field)
    text = "some words and a password: 9f8e7d6c5b4a39281f and 1234567890123456 more"
    assert secrets.field_spans("only plain words here", field, cache) == []
    tokens = secrets.TOKEN.findall(text)[:9]
    codes = np.array([cache[t] for t in tokens])
    score = field.emissions(*np.divmod(codes, len(field.cues) + 1), 0)
    best = max(
        itertools.product(range(3), repeat=len(tokens)),
        key=lambda tags: field.moves[0][0] * 0
        + sum(score[i][t] for i, t in enumerate(tags))
        + field.moves[0][tags[0]]
        + sum(field.moves[a][b] for a, b in zip(tags, tags[1:]))
        + field.moves[tags[-1]][0],
    )
    assert field.viterbi(score) == list(best)


def learned_shapes(texts):
    return set(secrets.fit(iter(texts), rounds=1).types)


def test_windows_come_from_all_texts():
    texts = list(lines_with_secrets(700))
    # Numbers alone in one long text, and codes of a shape of their own in the texts after it.
    long = " ".join(f"word {n}" for n in range(10_000, 30_000))
    last = [f"cat {n:05d}XYZ-{n:05d} dog" for n in range(300)]
    assert secrets.shape("00001XYZ-00001") in learned_shapes([*texts, long, *last])
    assert len(secrets._chosen(iter([long]), 3000, 16)[1]) == 16
    # Which windows are taken does not depend on the order of the texts.
    several = [*texts, long, *last]
    assert secrets._chosen(iter(several), 50, 4) == secrets._chosen(iter(several[::-1]), 50, 4)
    assert all(len(found) <= 50 for found in secrets._chosen(iter(several), 50, 4).values())


def test_views_keep_tags_in_step():
    tokens = ["so", "password", "=", '"', "abcdefgh", "=", "ijk", '"', "end"]
    tags = [0, 0, 0, 0, 1, 2, 2, 0, 0]
    got = list(secrets.views(tokens, tags, 4, 3, 7, 40))
    assert got[0] == (tokens, tags) and got == list(secrets.views(tokens, tags, 4, 3, 7, 40))
    forms = set()
    for words, marks in got[1:]:
        at = marks.index(1)
        assert len(words) == len(marks) and words[0] == "so" and words[-1] == "end" and marks.count(1) == 1
        assert words[at] == "abcdefgh" and marks.count(2) == 2 or secrets.weak(words[at]) and marks.count(2) == 0
        forms.add((*words[1:at], words[at] == "abcdefgh", *words[at + 1 + marks.count(2) :]))
    assert forms == {("=", '"', True, '"', "end"), (False, "end"), ("password", "=", '"', False, '"', "end")}
    assert not any(map(secrets.weak, ("", "short1a2b3", "1234567890123456", "mail7.example.com", "abcdefghijklmnop")))


@pytest.fixture(scope="module")
def corpus_field():
    texts = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["text"]).text.dropna().drop_duplicates().tolist()
    return texts, secrets.fit(iter(texts[1::2]))


def test_secrets_outside_the_patterns(corpus_field):
    """Bare values in whole texts that training did not see: nearly all are found, and nothing else."""
    texts, field = corpus_field
    cache, source = secrets.TypeCache(field), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda alphabet, n: "".join(source.choices(alphabet, k=n))
    kinds = {
        "hex20": lambda: draw("0123456789abcdef", 20),
        "hex28": lambda: draw("0123456789ABCDEF", 28),
        "mixed24": lambda: draw(letters, 24),
        "prefix": lambda: "ghx_" + draw(letters, 36),
        "base64": lambda: draw(letters + "+/", 40),
    }
    found, planted, false = Counter(), Counter(), 0
    for at, text in enumerate(texts[0:1200:2]):
        words = text.split(" ")
        kind = list(kinds)[at % len(kinds)]
        value = kinds[kind]()
        where = source.randrange(len(words) + 1)
        begin = len(" ".join([*words[:where], ""])) if where else 0
        whole = " ".join([*words[:where], value, *words[where:]])
        base, added = secrets.find_spans(whole, field, cache)
        if any(start < begin + len(value) and begin < end for start, end, _ in base):
            continue
        hit = [span for span in added if span[0] <= begin and begin + len(value) <= span[1]]
        planted[kind] += 1
        found[kind] += bool(hit)
        false += len(added) - len(hit)
    print(dict(found), dict(planted), false)
    assert all(found[kind] >= 0.9 * planted[kind] for kind in kinds), (found, planted)
    assert false <= 0.02 * sum(planted.values())


def test_no_match_no_field():
    assert secrets.fit(iter(["plain words", "", "more"])) is None


def test_redact_merges_overlaps():
    assert secrets.redact("abcdefgh", [(1, 3), (2, 5), (7, 8)], "*") == "a*fg*"


# --- toxicity --------------------------------------------------------------------------


def test_noisy_or():
    model = toxicity.ToxicityModel(0.1, {"bad": 1.0, "worse": 2.0})
    score, found = model.score("A bad day. Fine! Bad, bad and worse?\n")
    p1, p2 = 1 - math.exp(-1), 1 - math.exp(-3)
    assert [p for *_, p in found] == pytest.approx([p1, p2])
    assert score == pytest.approx(1 - 0.9 * (1 - p1) * (1 - p2))
    assert model.score("")[0] == model.score("nothing here")[0] == 0.1


def test_fit_finds_the_words():
    rng = np.random.default_rng(4)
    words = [f"w{i}x".replace("0", "o") for i in range(60)]
    words = ["".join(chr(97 + (i * k) % 26) for k in (3, 5, 7, 11)) + "q" * (i % 5) for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        text = rng.choice(words, 20).tolist()
        if i % 4 == 0:
            text[5] = ["vile", "nasty"][i % 8 // 4]
        texts.append(" ".join(text[:10]) + ". " + " ".join(text[10:]))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(labels))
    predicted = [int(model.score(text)[0] >= 0.7) for text in texts]
    assert predicted == labels
    start, end, p = max(model.sentences("Hello there. You vile thing."), key=lambda s: s[2])
    assert "Hello there. You vile thing."[start:end].strip() == "You vile thing." and p >= 0.7


def test_one_label_only():
    assert toxicity.fit(["a", "b"], np.array([0, 0])).weights == {}
    assert toxicity.fit([], np.array([])).score("x") == (0.0, [])


# --- fingerprints ----------------------------------------------------------------------


def test_entropy():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 9, (20, 64)).astype(np.uint8)
    for row, level in zip(data, fingerprints._entropy(data)):
        share = np.bincount(row) / 64
        share = share[share > 0]
        assert abs(1000 * -(share * np.log2(share)).sum() / 6 - level) <= 0.5001


def test_likeness():
    rank = np.arange(fingerprints.LEVELS)
    rng = np.random.default_rng(9)
    one, two = (bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)) for _ in range(2))
    a, b = (fingerprints.filters(fingerprints.select(x, rank)) for x in (one, two))
    moved = fingerprints.filters(fingerprints.select(b"inserted " + one, rank))
    half = fingerprints.filters(fingerprints.select(one[:10_000] + two[:10_000], rank))
    none = fingerprints.filters(fingerprints.select(b"", rank))
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) < 0.15
    assert fingerprints.likeness(a, moved) > 0.9
    assert 0.2 < fingerprints.likeness(a, half) < 0.8
    assert fingerprints.likeness(none, none) == 1 and fingerprints.likeness(none, a) == 0
    assert (fingerprints.parse(fingerprints.digest(a)) == a).all() and fingerprints.digest(none) == ""


def brute_selected(text, rank):
    """Starts of the selected windows, from every window's entropy and every neighbourhood."""
    data = np.frombuffer(text, dtype=np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(data, fingerprints.WINDOW)
    names = [int(fingerprints._names(row.copy())[0]) for row in rows]
    order = [(int(rank[level]), name >> 16) for level, name in zip(fingerprints._entropy(rows), names)]
    points = [0] * len(order)
    for start in range(len(order) - fingerprints.NEAR + 1):
        near = range(start, start + fingerprints.NEAR)
        for at in near:
            points[at] += order[at] == min(order[k] for k in near)
    return [name for name, p in zip(names, points) if p >= fingerprints.POINTS]


def test_every_window_is_a_candidate(monkeypatch):
    rng = np.random.default_rng(4)
    rank = rng.permutation(fingerprints.LEVELS)
    texts = [bytes(rng.integers(97, 97 + k, n, dtype=np.uint8)) for k, n in ((2, 500), (26, 700), (1, 300), (9, 64), (9, 20), (5, 69), (26, 2000))]
    texts += [b"", b"the same line\n" * 40]
    windows = [t[at : at + 64] for t in texts for at in range(len(t) - 63)]
    levels = fingerprints._entropy(np.array([list(w) for w in windows], dtype=np.uint8))
    want = np.bincount(levels, minlength=fingerprints.LEVELS)
    want[0] += 1
    for work in (fingerprints._WORK, 1000, 130):
        monkeypatch.setattr(fingerprints, "_WORK", work)
        assert (fingerprints.count_levels(texts) == want).all()
        for text, found in zip(texts, fingerprints.select_all(texts, rank)):
            if len(text) > 68:
                assert found.tolist() == brute_selected(text, rank)


def test_few_distinct_strings_and_short_passages_are_alike():
    rng = np.random.default_rng(5)
    rank = np.arange(fingerprints.LEVELS)

    def near(one, two):
        return fingerprints.likeness(*(fingerprints.filters(fingerprints.select(x, rank)) for x in (one, two)))

    for _ in range(40):
        line = bytes(rng.integers(97, 123, 20, dtype=np.uint8)) + b"\n"
        first = [bytes(rng.integers(97, 123, 100, dtype=np.uint8)) + b"\n" for _ in range(2)]
        assert near(first[0] + line * 60, first[1] + line * 60) > 0.5
        shared = bytes(rng.integers(97, 123, 150, dtype=np.uint8))
        ends = [bytes(rng.integers(97, 123, 60, dtype=np.uint8)) for _ in range(2)]
        assert near(shared + ends[0], shared + ends[1]) > 0.2


def test_splice():
    assert fingerprints.splice("abcde", "XYZ") == "abcXY"
    assert fingerprints.splice("abcdefgh", "XY") == "abcdXY"
    assert fingerprints.splice("", "XY") == "" and fingerprints.splice("a", "XY") == "a"
