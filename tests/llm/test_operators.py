"""Every corpus operator on small tables with hard rows, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import common, fingerprints, sentence_pieces, suffix_tree_lm
from fleetlens.llm.common import by_hash
from fleetlens.llm.decontaminate import contamination
from fleetlens.llm.graph import components
from fleetlens.llm.jaccard_join import jaccard_join
from fleetlens.llm.license_rules import SENTENCES, scan_licenses
from fleetlens.llm.repeats import remove_repeats
from fleetlens.llm.secrets import mask_secrets, scan_secrets
from fleetlens.llm.secrets import train as train_secrets
from fleetlens.llm.sentence_pieces import Pieces, decode, encode, encode_text
from fleetlens.llm.toxicity import score_toxicity, train_toxicity
from fleetlens.llm.url_rules import judge_urls
from fleetlens.session import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, rid long"


def words_in(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join("".join(chr(97 + (w * k) % 26) for k in (1, 3, 7, 11)) for w in rng.integers(1, vocabulary, n))


def texts():
    rng = np.random.default_rng(42)
    base = prose(rng, 90)
    found = [None, "", " \n ", "?!", "one", "One two", "one two", base, base, base.upper()]
    for k in range(12):
        words = base.split()
        for at in rng.integers(0, 90, 1 + k % 3):
            words[at] = f"edit{k}"
        found.append(" ".join(words))
    passage = prose(rng, 70)
    found += [prose(rng, 30) + " " + passage + " " + prose(rng, 25) for _ in range(5)]
    found += ["ab" * 400, "é" * 150, "x" * 199, "y" * 200, "y" * 201, prose(rng, 4000), "long" * 15_000]
    found += ["password=abcdefgh12 and token: short", "AKIA" + "Q" * 16, "deadbeef" * 5 + " tail"]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "en", "s", None, "clash", "clash", 7) for i, t in enumerate(texts())]
    rows += [rows[7], rows[7], (None, "null id " + (rows[7][1]), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# --- op 1 ------------------------------------------------------------------------------


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, i) for i in range(300, 340)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 103))
    assert all(found[i] == 200 for i in range(300, 340))


def brute_links(rows):
    sets = []
    for doc_id, text in rows:
        words = words_in(text)
        if doc_id is None or not words:
            sets.append(None)
        elif len(words) < 5:
            sets.append({tuple(words)})
        else:
            sets.append(set(zip(*[words[k:] for k in range(5)])))
    links = [0] * len(rows)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            label[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return Counter((doc_id, None if doc_id is None else smallest[root(i)], links[i]) for i, (doc_id, _) in enumerate(rows))


def test_jaccard_join(docs):
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    assert found == brute_links(rows_of(docs))


def test_jaccard_join_in_blocks(spark, docs, monkeypatch):
    import fleetlens.llm.jaccard_join as module

    monkeypatch.setattr(module, "BLOCK", 4)
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    assert found == brute_links(rows_of(docs))


def test_jaccard_join_recall(spark):
    rng = np.random.default_rng(1)
    rows = []
    for family in range(60):
        words = prose(rng, 120, 5000).split()
        for copy in range(4):
            own = list(words)
            for at in rng.integers(0, 120, copy):
                own[at] = f"e{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(table).collect())
    want = brute_links(rows)
    assert sum((found & want).values()) >= 0.99 * len(rows)


# --- op 2 ------------------------------------------------------------------------------


def test_licenses(spark):
    cases = {
        1: ("Text.\nLicensed under the Apache License, Version 2.0.\nMore", ["apache-by"], ["Apache-2.0"]),
        2: (
            "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
            "the following conditions are met:\n\nRedistributions of source code must retain the above copyright\nnotice, this "
            "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
            "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
            "with the distribution.",
            ["bsd-use", "bsd-source", "bsd-binary"],
            ["BSD-2-Clause"],
        ),
        3: ("released UNDER the mit license", ["mit-by"], ["MIT"]),
        4: (None, [], []),
        5: ("", [], []),
        6: ("All rights reserved. Licensed under CC BY-NC 4.0.", ["reserved", "cc-by-nc"], ["CC-BY-NC-4.0", "all-rights-reserved"]),
        7: ("We all said: rights reserved for all", [], []),
    }
    rows = [(k, text, "x") for k, (text, _, _) in cases.items()]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert {r.doc_id: (r.sentences, r.licenses) for r in found} == {k: (s, l) for k, (_, s, l) in cases.items()}


APACHE_NOTICE = """Copyright 2024 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MIT_NOTICE = """The MIT License (MIT)

Copyright (c) 2024 Someone

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the
Software.
"""
BSD_NOTICE = """Copyright (c) 2024, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
def test_published_notices(spark, mark):
    notices = {
        "Apache-2.0": (APACHE_NOTICE, ["apache-header", "apache-comply", "apache-copy"]),
        "GPL-3.0-or-later": (GPL_NOTICE, ["gpl-free", "gpl-hope"]),
        "MIT": (MIT_NOTICE, ["mit-name", "mit-notice"]),
        "BSD-3-Clause": (BSD_NOTICE, ["bsd-use", "bsd-source", "bsd-binary", "bsd-name"]),
        "BSD-2-Clause": (BSD_NOTICE.split("3.")[0], ["bsd-use", "bsd-source", "bsd-binary"]),
    }
    rows = [(name, "".join(f"{mark}{line}".rstrip() + "\n" for line in text.splitlines())) for name, (text, _) in notices.items()]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: (r.sentences, r.licenses) for r in found} == {name: (ids, [name]) for name, (_, ids) in notices.items()}
    assert all(r.rest == [] for r in found)


def test_every_known_sentence_wrapped_anywhere(spark):
    rows, want = [], {}
    for name, sentence in SENTENCES.items():
        words = sentence.split(" ")
        for cut in range(len(words)):
            # The empty line before keeps a small first letter from joining the line above.
            rows.append((len(rows), "Some code\n\n" + " ".join(words[:cut]) + "\n" * (cut > 0) + " ".join(words[cut:]) + ".\nMore"))
            want[rows[-1][0]] = [name]
    # Part of a longer sentence, or another sentence cut in two.
    for text in ("Not\nall rights reserved.", "All rights\n\nreserved.", "All rights reserved;\nor none.", "All rights.\nReserved.", "All rights reserved\nby us."):
        rows.append((len(rows), text))
        want[rows[-1][0]] = []
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.sentences for r in found} == want


@pytest.mark.parametrize("depth", [4, 19, 21, 40, 400])
def test_notices_indented_to_any_depth(spark, depth):
    rows = [(name, "".join(" " * depth + f"{line}\n" for line in text.splitlines())) for name, text in (("a", GPL_NOTICE), ("b", APACHE_NOTICE))]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in found} == {"a": ["GPL-3.0-or-later"], "b": ["Apache-2.0"]}


def test_thousands_of_known_sentences(spark):
    known = {f"s{i}": f"Clause {i} applies to the work: see section {i * 7}" for i in range(3000)}
    rules = [("two", ["s5", "s2999"]), ("one", ["s41"])]
    text = "Intro.\nClause 5 applies to the\nWork: see section 35. Filler\n# Clause 2999 applies to the work see section 20993\nClause 41 applies."
    rows = [(1, text), (2, None), (3, ". ! | \n | ?:\n\n"), (4, "|Clause 41 applies to the work: see section 287|\n" + "." * 20_000 + "x")]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known, rules).collect()
    assert {r.doc_id: (r.sentences, r.licenses) for r in found} == {1: (["s5", "s2999"], ["two"]), 2: ([], []), 3: ([], []), 4: (["s41"], ["one"])}
    assert [r.sentences for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {}, []).collect()] == [[]] * 4


# --- op 3 ------------------------------------------------------------------------------


def brute_tree(texts, bits, min_seen):
    """The tree from plain counts: {context: (seen, {word: times})} of the retained contexts, and P."""
    sequences = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    counts = Counter(w for s in sequences for w in s)
    n, v, d = sum(counts.values()), len(counts), 0.75
    states = {}

    def p(word, history):
        if not history:
            return (counts[word] - d) / n if counts[word] else d * v / n
        context = max((tuple(history[-k:]) for k in range(1, len(history) + 1) if tuple(history[-k:]) in states), key=len, default=())
        if not context:
            return p(word, ())
        seen, listed = states[context]
        rest = d * len(listed) + seen - sum(listed.values())
        return (max(listed.get(word, 0) - d, 0) + rest * p(word, context[1:])) / seen

    candidates, k = {(w,) for w, c in counts.items() if c >= min_seen and w != b"\n"}, 1
    while candidates:
        nexts = {}
        for s in sequences:
            for i in range(k, len(s)):
                context = tuple(s[i - k : i])
                if context in candidates:
                    nexts.setdefault(context, Counter())[s[i]] += 1
        new = {}
        for context, after in nexts.items():
            seen = sum(after.values())
            listed = {w: c for w, c in after.items() if c >= 2}
            if not listed:
                continue
            rest = d * len(listed) + seen - sum(listed.values())
            gain = (seen - sum(listed.values())) * math.log2(rest / seen)
            for w, c in listed.items():
                short = p(w, context[1:])
                gain += c * math.log2((max(c - 1 - d, 0) + rest * short) / (seen * short))
            if gain >= bits:
                new[context] = (seen, listed)
        states |= new
        candidates = {(*s, w) for s, after in nexts.items() for w, c in after.items() if c >= min_seen and (*s, w)[1:] in new}
        k += 1
    return counts, states, p


#: Whether two words make a third likely is known from the third before them only.
CHAINS = ["a m n x", "b m n y", "a m o y", "b m o x", "a q n y", "b q n x"] * 12 + ["a m n x . " * 30, "b b b b b b b b", "m n"]


@pytest.mark.parametrize("shortcut, filter_bits", [(1_000_000, 1 << 27), (0, 1 << 27), (20, 64), (0, 64)])
def test_suffix_tree_lm(spark, docs, shortcut, filter_bits):
    chains = spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(CHAINS)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(chains)
    learn = F.expr("crc32(cast(doc_id as string)) % 5 <> 1")
    train = docs.where(F.coalesce(learn, F.lit(False)))
    corpus = suffix_tree_lm.encode(docs, learn)
    tree = suffix_tree_lm.train(corpus, bits=4, min_seen=3, filter_bits=filter_bits)
    counts, states, p = brute_tree([t for _, t in rows_of(train)], 4, 3)
    assert (tree.n, tree.v) == (sum(counts.values()), len(counts))
    depths = Counter(map(len, states))
    assert tree.sizes == [depths[k] for k in sorted(depths)] and len(tree.sizes) >= 3
    want = Counter()
    for doc_id, text in rows_of(docs):
        tokens = [*(text or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts[t] + 0.5) / (tree.n + 0.5 * (tree.v + 1))) for t in tokens)
        score = sum(math.log10(p(t, tokens[max(0, i - 12) : i])) for i, t in enumerate(tokens))
        want[doc_id, len(tokens), sum(t in counts for t in tokens), round(base, 5), round(score, 5)] += 1
    got = suffix_tree_lm.score_texts(corpus, tree, shortcut, filter_bits).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert max(map(len, states)) <= 12


def test_suffix_tree_lm_without_training(docs, empty):
    nothing = suffix_tree_lm.encode(docs, False)
    tree = suffix_tree_lm.train(nothing)
    assert tree.n == 0 and tree.sizes == []
    found = suffix_tree_lm.score_texts(nothing, tree).collect()
    assert len(found) == docs.count()
    assert all(r.n_known == 0 and r.base_score == r.score == 0 for r in found)
    corpus = suffix_tree_lm.encode(empty)
    assert suffix_tree_lm.score_texts(corpus, suffix_tree_lm.train(corpus)).collect() == []


def test_suffix_tree_lm_held_out(spark):
    import __spark_entry__ as entry_point

    found = entry_point.queries()["op3_suffix_tree_lm"](spark, "/root/testdata/sf0.01").where("held_out")
    score, base = found.selectExpr("sum(score)", "sum(base_score)").first()
    assert score > 0.95 * base


# --- op 4 ------------------------------------------------------------------------------

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("a.net", "", "block"),
    ("net", "/es/x/y/z/", "allow"),
]
URLS = [
    None,
    "",
    "no scheme example.com/en/",
    "http://EXAMPLE.com/en/x?q=/en/",
    "http://www.example.com/en/",
    "http://m.www.example.com/en/1#a",
    "https://xexample.com/en/",
    "http://example.com",
    "http://example.com?x",
    "http://net/es/a",
    "http://b.a.net/es/x/y/z/1",
    "http://b.net/es/x/y/z/1",
    "http://a.net",
    "http://com,example,/en/",
    "a://b://c.com/p",
    "http://example.org/en/\nx",
]


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else default


@pytest.mark.parametrize("rules", [RULES, []])
def test_url_rules(spark, rules):
    rows = [(i, url, "x", "y") for i, url in enumerate(URLS * 3)] + [(500 + i, "http://hot.example.com/en/same", "x", "y") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(4)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for ranges in (1, 7):
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table, ranges=ranges).collect()}
        assert found == {i: brute_verdict(url, rules) for i, url, *_ in rows}


def test_url_rules_give_every_id_back(spark):
    """Ids beyond 2^53, negative, null and repeated ones, and ids that are text."""
    ids = [2**60 + 1, 2**60 + 2, 2**63 - 1, -(2**63), -5, 0, None, None, 7, 7]
    rows = [(i, url) for i in ids for url in URLS[3:9]] + [(9, URLS[4])] * 300
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = Counter((i, *brute_verdict(url, RULES)) for i, url in rows)
    for ranges in (1, 5):
        found = judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(3), table, ranges=ranges)
        assert found.schema["page_id"].dataType.simpleString() == "bigint"
        assert Counter(tuple(r) for r in found.collect()) == want
    named = spark.createDataFrame([(f"p{i}", url) for i, url in rows], "page_id string, url string")
    assert Counter(tuple(r) for r in judge_urls(named, table).collect()) == Counter((f"p{i}", *brute_verdict(u, RULES)) for i, u in rows)


def test_samples_by_hash_hold_rows_at_any_size(spark):
    """A share below a millionth still takes about that share; equal values go together."""
    numbers = spark.range(4_000_000)
    assert numbers.where(by_hash(0.25e-6 * 40, "id")).count() in range(15, 75)
    assert numbers.where(by_hash(1.0, "id")).count() == 4_000_000
    twice = spark.range(1000).union(spark.range(1000)).where(by_hash(0.3, "id")).groupBy("id").count()
    assert {r["count"] for r in twice.collect()} == {2} and 200 < twice.count() < 400


def test_url_rules_without_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), ranges=3).collect() == []


# --- op 5 ------------------------------------------------------------------------------


def test_pieces_round_trip_and_chunks(docs):
    pieces = Pieces.load()
    want = Counter((doc_id, tuple(encode_text(text or "", pieces).tolist())) for doc_id, text in rows_of(docs))
    texts_back = Counter((doc_id, text or "") for doc_id, text in rows_of(docs))
    for giant, chunk in ((32_768, 16_384), (50, 40)):
        coded = encode(docs, giant=giant, chunk=chunk)
        assert Counter((r.doc_id, tuple(r.pieces)) for r in coded.collect()) == want
        both = encode(docs, giant=giant, chunk=chunk, spell=True).collect()
        assert Counter((r.doc_id, tuple(r.pieces)) for r in both) == want
        assert Counter((r.doc_id, r.text) for r in both) == texts_back
    assert Counter((r.doc_id, r.text) for r in decode(coded).collect()) == texts_back


def test_new_words_are_segmented_side_by_side(monkeypatch):
    pieces, alone = Pieces.load(), Pieces.load()
    source = random.Random(5)
    letters = "abcdethn\u00e9\u00df\u2581 01\n\u4e2d\U0001f600\ud800"
    texts = ["".join(source.choices(letters, k=source.randint(0, 400))) for _ in range(300)]
    texts += ["", " ", "\n\n", "word", "word word", "x" * 5000]
    words = sorted({word for text in texts for word in sentence_pieces._WORD.findall(sentence_pieces.shown(text))})
    for side in (40, 1 << 17):
        monkeypatch.setattr(sentence_pieces, "SIDE", side)
        found = dict(pair for some in pieces.segment_all(words) for pair in zip(*some))
        assert found == {word: np.array(alone.segment(word)[1], dtype=np.int32).tobytes() for word in words}
    assert list(pieces.segment_all([])) == []
    # Only words that are too long to be remembered are done one by one.
    calls = []
    monkeypatch.setattr(Pieces, "segment", lambda self, word: calls.append(word) or alone_segment(alone, word))
    sentence_pieces.encode_texts(texts, pieces)
    assert all(len(word) >= sentence_pieces.LONG_WORD for word in calls)
    assert pieces.words
    pieces.forget()
    assert not pieces.words and not pieces.words.older


alone_segment = Pieces.segment


def test_tables_are_written_in_small_row_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(common, "ROW_GROUP", 1 << 20)
    common.ready(spark)
    rows = spark.range(0, 60_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 512).alias("text"))
    try:
        files = stored(rows).inputFiles()
    finally:
        monkeypatch.undo()
        common.ready(spark)
    assert max(pq.ParquetFile(name.removeprefix("file://")).num_row_groups for name in files) > 3


# --- op 6 ------------------------------------------------------------------------------


def brute_repeats(rows, length=200):
    data = [(text or "").encode() for _, text in rows]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    want = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 2, dtype=bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s + 1 : s + length + 1] = True
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        want.append((doc_id, len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(want)


@pytest.mark.parametrize("classes", [1000, 1])
def test_repeats(docs, monkeypatch, classes):
    import fleetlens.llm.repeats as module

    monkeypatch.setattr(module, "CLASSES", classes)
    found = Counter(
        (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in remove_repeats(docs).collect()
    )
    assert found == brute_repeats(rows_of(docs))


# --- op 7 ------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination(spark, limit):
    rng = np.random.default_rng(6)
    item = prose(rng, 40)
    bench = [(1, item), (2, "Short item here"), (3, None), (4, "!!"), (10, item), (5, prose(rng, 20)), (6, item[:-5])]
    rows = [(1, None), (2, ""), (3, item), (3, item), (4, prose(rng, 30) + " " + item), (5, prose(rng, 900) + " " + item)]
    rows += [(6, "a SHORT, item here; short item here too"), (7, prose(rng, 50)), (None, item.upper()), (8, " ".join(item.split()[:12]))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, words string")
    table = spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, words string")
    windows = {}
    for item_id, text in bench:
        w = words_in(text)
        for i in range(max(0, len(w) - 12) or (1 if w else 0)):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item_id)
    want = []
    for doc_id, text in rows:
        w, hit, items = words_in(text), set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    items |= ids
        want.append((doc_id, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    found = contamination(docs, table, max_windows=limit).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in found) == Counter(want)


def test_contamination_without_rows(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in contamination(docs, none).collect())
    assert contamination(empty, none).collect() == []


# --- op 8 ------------------------------------------------------------------------------


def test_secrets(docs):
    from tests.llm.test_methods import brute_spans

    field = train_secrets(docs)
    got = scan_secrets(docs, field).collect()
    want = Counter((doc_id, tuple(brute_spans(text or ""))) for doc_id, text in rows_of(docs))
    assert Counter((r.doc_id, tuple((s.start, s.end, s.kind) for s in r.base)) for r in got) == want
    for row in got:
        for s in row.added:
            assert s.kind == "crf" and all(s.end <= b.start or b.end <= s.start for b in row.base)
    masked = {r.doc_id: r for r in mask_secrets(docs, None).collect()}
    assert masked[1].text is None and set(masked[1].asDict()) == set(docs.columns)
    assert "password" not in " ".join(r.text or "" for r in masked.values())


# --- op 9 ------------------------------------------------------------------------------


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(docs, train_toxicity(docs, none)).collect()} == {0.0}
    marks = spark.createDataFrame([(1, 0), (13, 1), (13, 1), (16, None), (None, 1), (22, 0)], "doc_id long, toxic int")
    got = score_toxicity(docs, train_toxicity(docs, marks)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert score_toxicity(empty, train_toxicity(empty, marks)).collect() == []


def test_toxicity_held_out(spark):
    import __spark_entry__ as entry_point

    folder = "/root/testdata/sf0.1"
    found = entry_point.queries()["op9_toxicity"](spark, folder).where("held_out").join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id"
    )
    counts = Counter((r.toxic, r.predicted) for r in found.select("toxic", "predicted").collect())
    assert counts[1, 1] >= 0.8 * (counts[1, 0] + counts[1, 1])
    assert counts[0, 1] <= 0.01 * (counts[0, 0] + counts[0, 1])


# --- op 10 -----------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 6])
def test_spliced_fingerprints(docs, ranges):
    rows = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows_of(docs))
    rank = fingerprints.rarity(docs)
    want = []
    for (doc_id, text), (_, other) in zip(rows, rows[1:] + rows[:1]):
        edited = fingerprints.splice(text, other)
        a, b, c = (fingerprints.filters(fingerprints.select(t.encode(), rank)) for t in (text, edited, other))
        want.append((None if doc_id == -(2**63) else doc_id, len(text), edited, fingerprints.digest(a), fingerprints.digest(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    got = fingerprints.spliced_fingerprints(docs, ranges).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)


@pytest.mark.parametrize(
    "run",
    [
        jaccard_join,
        scan_licenses,
        remove_repeats,
        encode,
        fingerprints.fingerprint,
        lambda d: fingerprints.spliced_fingerprints(d, 3),
        lambda d: scan_secrets(d, train_secrets(d)),
    ],
)
def test_empty_table(empty, run):
    assert run(empty).collect() == []
