"""Licence scan: known sentences to identifiers, identifier sequences to licence rules.

Only DataFrame functions and no shuffle: a document's sentences are normalised, looked up
in the table of known sentences, and the sequence of identifiers is matched against the
ordered rules.  Sentences that are not known do not appear in the sequence, so a rule may
be spread over a document.  Rules are tried in order and use up what they match: a longer
rule stands before the shorter ones it contains.

Text and known sentences are brought to one normal form (``normal_form``), so sentences are found as
published: wrapped before any character, indented and behind comment marks to any depth, and with
the sentence ends they have inside (``software: you``).  A text is normalised once, whatever the
number of known sentences; places that begin like one are found by set look-ups.

Defined results: null and empty texts have no sentences and no licence; repeated rows and
equal texts get equal answers row by row; of several licences all are reported, in rule
order.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, clean_text

#: Sentences of public licence texts as published, by identifier.
SENTENCES = {
    "apache-by": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "You may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-by": "Released under the MIT License",
    "mit-name": "The MIT License (MIT)",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software",
    "gpl3-by": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "reserved": "All rights reserved",
}
#: Ordered rules, ``(licence, identifiers in order)``.
RULES = [
    ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("MIT", ["mit-name", "mit-notice"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-by"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl3-by"]),
    ("MIT", ["mit-by"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("all-rights-reserved", ["reserved"]),
]
#: Known sentences that a notice joins without a sentence end.
JOINED = [("apache-header", "apache-comply")]
#: What is not a word: white space, quotes, comment marks, sentence ends.
_FILL = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]"
#: In the normal form: an end no sentence crosses, and a line break a sentence may cross.
END, BREAK = "|", "\n"
#: Words that choose the known sentences a place is compared with.
ANCHOR_WORDS = 3


def normal_form(text: Column) -> Column:
    """Words in lower case, one separator after each: space, ``BREAK`` or ``END``.

    ``END`` is a sentence end (``.!?:`` before white space or the end) or a line without words; a line
    break before a small letter only wraps, any other is ``BREAK``.  Comment marks, quotes and
    indentation are gone.  The number of passes does not depend on the known sentences.
    """
    text = F.translate(text, END, " ")
    for pattern, to in (
        (rf"\n{_FILL}*\n", END),
        (r"\n[ \t]*(?=[a-z])", " "),
        (r"(?<![.!?:])[.!?:]++(?=[ \t\n|]|\z)", END),
        (r"[^A-Za-z0-9\x{80}-\x{10FFFF}\n|]+", " "),
        (r"[ \n]*\|[ \n|]*", END),
        (r" ?\n ?", BREAK),
        (r"\A[ \n|]+|[ \n|]+\z", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.concat(ascii_lower(text), F.lit(END))


def _words(sentence: str) -> str:
    kept = "".join(c if (c.isascii() and c.isalnum()) or c >= "\x80" or c == END else " " for c in sentence)
    lower = "".join(c.lower() if c.isascii() else c for c in kept)
    return re.sub(r" *\|[ |]*", END, " ".join(lower.split())).strip(END)


def known_keys(sentences: dict[str, str]) -> dict[str, list[str]]:
    """Normal forms of the known sentences and the identifiers each stands for.

    A sentence may hold the sentence ends it has as published (``software: you``) or not, and an
    address in it may stand in a paragraph of its own.
    """
    found = [((name,), sentence) for name, sentence in sentences.items()]
    found += [(names, "; ".join(sentences[n] for n in names)) for names in JOINED if all(n in sentences for n in names)]
    keys = {}
    for names, sentence in found:
        plain = sentence.replace(END, " ")
        for form in (plain, re.sub(r"[.!?:]+(?=\s)", END, plain)):
            for key in (_words(form), _words(form).replace(" http ", f"{END}http ")):
                if key:
                    keys[key] = list(names)
    return keys


def _anchor(text: Column, words: int) -> Column:
    return F.substring_index(F.translate(text, BREAK + END, "  "), " ", words)


def recognise(text: Column, keys: dict[str, list[str]]) -> Column:
    """Identifiers of the known sentences in a text, in text order.

    A known sentence begins after an ``END``, a ``BREAK`` or at the beginning and ends before one.  Places
    whose first word, then whose first words, begin a known sentence (set look-ups) are compared with
    the few sentences that begin alike, longest first; what one has taken is not looked at again.
    """
    nothing = F.array().cast("array<string>")
    if not keys:
        return nothing
    longest = max(len(re.findall("[^ |]+", key)) for key in keys)
    few = min(ANCHOR_WORDS, *(len(re.findall("[^ |]+", key)) for key in keys), ANCHOR_WORDS)
    anchors: dict[str, list[str]] = {}
    for key in sorted(keys, key=lambda k: (-len(k), k)):
        anchors.setdefault(" ".join(re.findall("[^ |]+", key)[:few]), []).append(key)
    firsts = sorted({anchor.split(" ")[0] for anchor in anchors})

    def entry(key: str) -> Column:
        return F.struct(F.lit(key).alias("key"), F.array(*[F.lit(n) for n in keys[key]]).alias("names"))

    table = F.create_map(*[c for anchor, own in anchors.items() for c in (F.lit(anchor), F.array(*[entry(k) for k in own]))])

    def best(window: Column, anchor: Column) -> Column:
        plain = F.translate(window, BREAK, " ")
        ends = lambda c: F.substr(window, F.length(c["key"]) + 1, F.lit(1)).isin(BREAK, END)
        return F.get(F.filter(table[anchor], lambda c: F.startswith(plain, c["key"]) & ends(c)), F.lit(0))

    def hits(parts: Column) -> Column:
        # A part holds a word at least, so ``few`` parts hold an anchor and ``longest`` any known sentence.
        starts = F.transform(parts, lambda part, at: F.when(_anchor(part, 1).isin(firsts), at + 1))
        starts = F.filter(starts, lambda at: at.isNotNull())
        near = F.transform(
            starts, lambda at: F.struct(at.alias("at"), _anchor(F.array_join(F.slice(parts, at, F.lit(few)), ""), few).alias("anchor"))
        )
        near = F.filter(near, lambda h: h["anchor"].isin(list(anchors)))
        wide = F.transform(near, lambda h: h.withField("window", F.array_join(F.slice(parts, h["at"], F.lit(longest)), "")))
        found = F.transform(wide, lambda h: h.withField("best", best(h["window"], h["anchor"])))
        return F.filter(found, lambda h: h["best"].isNotNull())

    def taken(hit: Column) -> Column:
        """The first part after the hit."""
        own = F.substr(hit["window"], F.lit(1), F.length(hit["best"]["key"]) + 1)
        return hit["at"] + F.length(own) - F.length(F.translate(own, BREAK + END, ""))

    def add(state: Column, hit: Column) -> Column:
        more = F.struct(taken(hit).alias("next"), F.concat(state["names"], hit["best"]["names"]).alias("names"))
        return F.when(hit["at"] >= state["next"], more).otherwise(state)

    # One-element arrays name a value, so that lambdas do not work it out again.
    parts = F.array(F.split(normal_form(text), rf"(?<=[{BREAK}{END}])"))
    found = F.get(F.transform(parts, hits), F.lit(0))
    return F.aggregate(found, F.struct(F.lit(0).alias("next"), nothing.alias("names")), add, lambda state: state["names"])


def scan_licenses(
    documents: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None
) -> DataFrame:
    """``doc_id``, recognised sentence ids in text order, and the licences they make up.

    ``rest`` holds the recognised sentences no rule used.
    """
    keys = known_keys(sentences if sentences is not None else SENTENCES)
    rules = rules if rules is not None else RULES
    docs = documents.select("doc_id", recognise(clean_text(F.col("text")), keys).alias("ids"))
    # ",,a,,b,,": every identifier has its own pair of commas, so neighbours can both match.
    state = docs.select("doc_id", "ids", F.concat(F.lit(","), F.concat_ws(",,", "ids"), F.lit(",")).alias("rest"))
    matched = []
    for at, (_, wanted) in enumerate(rules):
        pattern = "," + ",,".join(wanted) + ","
        state = state.withColumn(f"m{at}", F.contains("rest", F.lit(pattern)))
        state = state.withColumn("rest", F.when(F.col(f"m{at}"), F.replace("rest", F.lit(pattern), F.lit(","))).otherwise(F.col("rest")))
        matched.append(F.when(F.col(f"m{at}"), F.lit(rules[at][0])))
    licences = F.array_distinct(F.array_compact(F.array(*matched))) if matched else F.array().cast("array<string>")
    left = F.filter(F.split("rest", ",+"), lambda s: s != "")
    return state.select("doc_id", F.col("ids").alias("sentences"), licences.alias("licenses"), left.alias("rest"))
