"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

The patterns (keyword assignments, access keys, long hexadecimal runs) are always reported.
The field adds spans the patterns miss.  Its sequence is a line of tokens - runs of word
characters and ``. _ / + -``, or any other single character - with the tags outside, begin
and inside.  A token's tag scores come from its shape (classes of characters, length,
spread of characters), from the two tokens before and the one after (shape, and the word
itself where it is one of the model's cue words) and from the file (length, share of
digits); tags follow each other by a transition table in which inside never follows outside.
The best tags are found by Viterbi.

Training marks the tokens inside pattern matches as begin and inside and all others as
outside, on at most about ``SAMPLE`` documents, chosen by a hash of their text, and keeps
only windows around matches, around tokens with digits, and around some other tokens: at most
``WINDOWS`` of each kind, chosen over all those documents by a hash of text and place, and of
one text at most ``OF_A_TEXT``.  Scanning reads every whole text.

A field that saw the patterns only as they are would repeat them.  So each window around a match
is learned from as it is and in other forms (``views``; at most about ``VIEWS`` in all): without its cue word;
without cue and marks, the value redrawn in another alphabet and length; with its cue, the value
redrawn.  Tokens outside a
pattern that are like a random value (``weak``) may be secrets the patterns miss: windows with one
are not learned from.

A line is decoded only if some token's best inside score, with twice the largest gain any
transition can add, beats outside; otherwise all tags are outside, which is also what
Viterbi would return.

Defined results: null and empty texts have no spans; repeated rows are scanned row by row
and learned from once; without any match in the sample the field adds nothing; a span of the
field that overlaps a pattern's span is dropped; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_hash, clean_text, give_back, giving_back, known_id, real_id

#: At most about this many documents are learned from.
SAMPLE = 12_000
#: Windows of each kind and the tokens on either side that are kept of them.
WINDOWS = 3000
OF_A_TEXT = 16
REACH = 12
#: Forms of the windows around matches that are learned from, in all; no more than there are other windows.
VIEWS = 6000
CUES = 200
ROUNDS = 150
KINDS = ("assign", "access", "hex")
FIELD = "crf"

#: The patterns as required.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_CUES = ("passw", "secret", "token", "api")
_HEX_BYTES = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_HEX_RUN = b"\1" * 32

TOKEN = re.compile(r"\n|[A-Za-z0-9_./+-]+|[^\sA-Za-z0-9_./+-]")
O, B, I = 0, 1, 2  # noqa: E741
_FORBIDDEN = -1e6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns' matches, by start, then kind as listed.

    A run of one character class is matched as a whole, so asking for its least length in
    the pattern finds the same runs as filtering afterwards; assignments are filtered,
    since a short one still uses up its characters.
    """
    found = []
    lower = text.lower()
    if any(cue in lower for cue in _CUES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    if _HEX_RUN in text.encode().translate(_HEX_BYTES):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(start, end, KINDS[kind]) for start, kind, end in sorted((s, k, e) for s, e, k in found)]


def shape(token: str) -> str:
    """Character classes, length class and spread of a token."""
    if token == "\n":
        return "line"
    if len(token) == 1 and not token.isalnum():
        return f"mark{token}" if token.isascii() else "letters1"
    kinds = "".join(
        name
        for name, test in (
            ("h", re.fullmatch("[0-9a-f]+", token)),
            ("d", any(c.isdigit() for c in token)),
            ("l", any(c.islower() for c in token)),
            ("u", any(c.isupper() for c in token)),
            ("s", any(not c.isalnum() for c in token)),
        )
        if test
    )
    if "d" not in kinds:
        kinds = kinds.replace("h", "")
    length = next((n for n in (1, 3, 7, 11, 15, 19, 27, 39, 63) if len(token) <= n), 64)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    spread = min(3, 4 * changes // max(1, len(token) - 1)) if "d" in kinds else 0
    return f"{kinds}{length}.{spread}"


def file_class(text: str) -> str:
    """Length and share of digits of a whole text, in classes."""
    size = sum(len(text) >= n for n in (500, 2000, 10_000))
    digits = sum(map(text.count, "0123456789"))
    return f"{size}.{sum(digits * n >= len(text) for n in (200, 50, 10))}"


@dataclass
class Field:
    """Score tables over token types; a type is a shape and perhaps a cue word."""

    types: dict[str, int]
    cues: dict[str, int]
    files: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    whole: np.ndarray
    cue1: np.ndarray
    cue2: np.ndarray
    moves: np.ndarray

    def gain(self) -> float:
        """The most a transition can add over staying outside."""
        return max(0.0, float((self.moves - self.moves[O, O]).max()))

    def emissions(self, kinds: np.ndarray, words: np.ndarray, file: int) -> np.ndarray:
        """Tag scores of each token; rows past the ends are all zero."""
        score = self.own[kinds] + self.whole[file]
        score[1:] += self.before[kinds[:-1]] + self.cue1[words[:-1]]
        score[2:] += self.before2[kinds[:-2]] + self.cue2[words[:-2]]
        score[:-1] += self.after[kinds[1:]]
        return score

    def viterbi(self, score: np.ndarray) -> list[int]:
        """Best tags of one line, which starts and ends outside."""
        moves = self.moves.tolist()
        best, pointers = moves[O][:], []
        rows = score.tolist()
        best = [best[tag] + rows[0][tag] for tag in (O, B, I)]
        for row in rows[1:]:
            from_ = [max((O, B, I), key=lambda tag, to=to: best[tag] + moves[tag][to]) for to in (O, B, I)]
            best = [best[from_[to]] + moves[from_[to]][to] + row[to] for to in (O, B, I)]
            pointers.append(from_)
        tag = max((O, B, I), key=lambda tag: best[tag] + moves[tag][O])
        tags = [tag]
        for from_ in reversed(pointers):
            tag = from_[tag]
            tags.append(tag)
        return tags[::-1]


class TypeCache(dict):
    """Type and cue word of a token in one number, computed once; emptied when it holds too many."""

    def __init__(self, field: Field, most: int = 300_000) -> None:
        super().__init__()
        self.field, self.most = field, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        field = self.field
        found = field.types.get(shape(token), 0) * (len(field.cues) + 1) + field.cues.get(token.lower(), 0)
        if len(token) < 64:
            self[token] = found
        return found


def field_spans(text: str, field: Field, cache: TypeCache) -> list[tuple[int, int]]:
    """Spans the field tags, in text order."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    codes = np.fromiter(map(cache.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    kinds, words = np.divmod(codes, len(field.cues) + 1)
    score = field.emissions(kinds, words, field.files.get(file_class(text), 0))
    promising = score[:, 1:].max(axis=1) + 2 * field.gain() > score[:, O]
    if not promising.any():
        return []
    breaks = [at for at, token in enumerate(tokens) if token == "\n"]
    edges = [-1, *breaks, len(tokens)]
    places = None
    found = []
    for start, end in zip(edges, edges[1:]):
        if end - start < 2 or not promising[start + 1 : end].any():
            continue
        tags = field.viterbi(score[start + 1 : end])
        if not any(tags):
            continue
        if places is None:
            places = [m.span() for m in TOKEN.finditer(text)]
        at = start + 1
        while at < end:
            if tags[at - start - 1] == O:
                at += 1
                continue
            last = at
            while last + 1 < end and tags[last - start] == I:
                last += 1
            found.append((places[at][0], places[last][1]))
            at = last + 1
    return found


#: Alphabets a value is redrawn in.
_ALPHABETS = (
    "0123456789abcdef",
    string.ascii_letters + string.digits,
    string.ascii_uppercase + string.digits,
    string.ascii_letters + string.digits + "_-+/",
)


def redrawn(source: random.Random) -> str:
    """A random value of 12 to 48 characters with digits and letters."""
    while True:
        value = "".join(source.choices(source.choice(_ALPHABETS), k=source.randint(12, 48)))
        if weak(value):
            return value


def weak(token: str) -> bool:
    """True for a token like a random value: letters and digits that change three times or more."""
    if len(token) < 12 or not any(c.isalpha() for c in token):
        return False
    return sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:])) >= 3


def views(tokens: list[str], tags: list[int], at: int, cue: int, key: int, most: int) -> Iterator[tuple[list, list]]:
    """Tokens and tags of a window around the value at ``at``, whose cue and marks are the ``cue`` tokens before it.

    The first form is the window itself; ``key`` decides how the others are drawn.
    """
    yield tokens, tags
    source = random.Random(key)
    end = at + 1
    while end < len(tags) and tags[end] == I:
        end += 1
    start = max(0, at - cue)
    marks = [t for t in tokens[start:at] if not t.isalnum()]
    bare = end + (tokens[end : end + 1] in (['"'], ["'"]))
    for _ in range(1, most):
        form = source.choice(("no cue", "bare", "redrawn"))
        before, value, rest = tokens[start:at], tokens[at:end], end
        if form == "no cue":
            before = marks
        else:
            value = [redrawn(source)]
        if form == "bare":
            before, rest = [], bare
        yield (
            [*tokens[:start], *before, *value, *tokens[rest:]],
            [*tags[:start], *[O] * len(before), B, *[I] * (len(value) - 1), *tags[rest:]],
        )


def _windows(texts: Iterator[str], of_a_text: int) -> Iterator[tuple]:
    """``(kind, key, tokens, tags, file, place, cue)`` around matches (0), tokens with digits (1) and others (2).

    ``place`` is that of the middle token, ``cue`` the number of tokens that lead to a match's value.

    The key is a hash of text and place; of each kind, the smallest of a text are given.
    """
    for text in texts:
        name = hashlib.blake2b(text.encode(), digest_size=16).digest()
        places: dict[int, list] = {0: [], 1: [], 2: []}
        spans = base_spans(text)
        values, leads = [], {}
        inner = {m.start(): m.start(2) for m in ASSIGN.finditer(text)} if spans else {}
        for start, end, kind in spans:
            if kind == "assign":
                leads[inner[start]] = start
                start = inner[start]
            values.append((start, end))
        matches = list(TOKEN.finditer(text))
        tags, open_ = [], False
        at, values = 0, sorted(values)
        for m in matches:
            while at < len(values) and values[at][1] <= m.start():
                at, open_ = at + 1, False
            inside = at < len(values) and m.end() > values[at][0]
            tags.append((I if open_ else B) if inside else O)
            open_ = inside
        tokens = [m[0] for m in matches]
        unsure = [tag == O and weak(token) for token, tag in zip(tokens, tags)]
        file = file_class(text)
        step = max(1, len(tokens) // 2)
        for at, (token, tag) in enumerate(zip(tokens, tags)):
            if tag == B:
                kind = 0
            elif tag == O and len(token) > 3 and any(c.isdigit() for c in token):
                kind = 1
            elif at % step == 0:
                kind = 2
            else:
                continue
            if tokens[max(0, at - REACH)] == "\n" or any(unsure[max(0, at - REACH) : at + REACH + 1]):
                continue
            key = int.from_bytes(hashlib.blake2b(b"%d" % at, key=name, digest_size=8).digest())
            places[kind].append((key, at))
        for kind, found in places.items():
            for key, at in heapq.nsmallest(of_a_text, found):
                low, high = max(0, at - REACH), at + REACH + 1
                lead, cue = leads.get(matches[at].start(), matches[at].start()), 0
                while cue < at - low and matches[at - cue - 1].start() >= lead:
                    cue += 1
                yield kind, key, tokens[low:high], tags[low:high], file, at - low, cue


def _chosen(texts: Iterator[str], windows: int, of_a_text: int) -> dict[int, list]:
    """The windows of smallest key of each kind, by key."""
    kept: dict[int, list] = {0: [], 1: [], 2: []}
    for turn, (kind, key, *window) in enumerate(_windows(texts, of_a_text)):
        # The largest key on top; the second number only keeps windows from being compared.
        entry = (-key, -turn, window)
        if len(kept[kind]) < windows:
            heapq.heappush(kept[kind], entry)
        elif entry[0] > kept[kind][0][0]:
            heapq.heapreplace(kept[kind], entry)
    return {kind: [[-entry[0], *entry[2]] for entry in sorted(found, key=lambda e: -e[0])] for kind, found in kept.items()}


def fit(
    texts: Iterator[str], rounds: int = ROUNDS, windows: int = WINDOWS, of_a_text: int = OF_A_TEXT, forms: int = VIEWS
) -> Field | None:
    """The field of largest penalised likelihood on the windows, by gradient steps."""
    chosen = _chosen(texts, windows, of_a_text)
    if not chosen[0]:
        return None
    kept = {kind: [(tokens, tags, file) for _, tokens, tags, file, _, _ in chosen[kind]] for kind in (1, 2)}
    # No more forms than other windows: of few texts, the field would learn that everything is secret.
    each = max(1, min(forms, len(kept[1]) + len(kept[2])) // len(chosen[0]))
    kept[0] = [(*view, file) for key, tokens, tags, file, at, cue in chosen[0] for view in views(tokens, tags, at, cue, key, each)]
    data = kept[0] + kept[1] + kept[2]
    cues = Counter()
    for _, tokens, _, _, at, _ in chosen[0]:
        cues.update({t.lower() for t in tokens[max(0, at - 4) : at] if t.isalpha()})
    common = Counter(t.lower() for tokens, _, _ in kept[2] for t in set(tokens))
    words = [w for w, n in cues.most_common() if n >= 3 and n > 3 * common[w]][:CUES]
    cue_index = {word: i + 1 for i, word in enumerate(words)}
    seen = Counter(shape(token) for tokens, _, _ in data for token in tokens)
    types = {name: i + 1 for i, name in enumerate(sorted(name for name, n in seen.items() if n >= 2))}
    files = {name: i + 1 for i, name in enumerate(sorted({file for *_, file in data}))}
    width = max(len(tokens) for tokens, _, _ in data)
    kinds, marks, gold = (np.zeros((len(data), width), dtype=np.int64) for _ in range(3))
    there = np.zeros((len(data), width), dtype=bool)
    whole = np.array([files[file] for *_, file in data])
    for row, (tokens, tags, _) in enumerate(data):
        there[row, : len(tokens)] = True
        kinds[row, : len(tokens)] = [types.get(shape(token), 0) for token in tokens]
        marks[row, : len(tokens)] = [cue_index.get(token.lower(), 0) for token in tokens]
        # A window that begins within a secret begins with B.
        gold[row, : len(tokens)] = [B if tags[0] == I else tags[0], *tags[1:]]
    shifted = lambda a, by: np.pad(a, ((0, 0), (by, 0)))[:, :width] if by > 0 else np.pad(a, ((0, 0), (0, -by)))[:, -by:]
    inputs = [kinds, shifted(kinds, 1), shifted(kinds, 2), shifted(kinds, -1), np.repeat(whole[:, None], width, 1), shifted(marks, 1), shifted(marks, 2)]
    sizes = [len(types) + 1] * 4 + [len(files) + 1] + [len(words) + 1] * 2
    tables = [np.zeros((size, 3)) for size in sizes]
    moves = np.zeros((3, 3))
    rule = np.zeros((3, 3))
    rule[O, I] = _FORBIDDEN
    target = np.eye(3)[gold] * there[:, :, None]
    target_moves = np.zeros((3, 3))
    both = there[:, 1:] & there[:, :-1]
    np.add.at(target_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    parameters = [*tables, moves]
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    for turn in range(1, rounds + 1):
        score = sum(table[index] for table, index in zip(tables, inputs))
        share, pairs = _marginals(score, moves + rule, there)
        gap = (target - share) * there[:, :, None]
        slopes = []
        for table, index in zip(tables, inputs):
            slope = np.stack([np.bincount(index.ravel(), gap[:, :, tag].ravel(), len(table)) for tag in range(3)], axis=1)
            # No token, no type: the zero row stays a zero row.
            slope[0] = 0
            slopes.append(slope - 0.5 * table)
        slopes.append(target_moves - pairs - 0.5 * moves)
        for p, slope, m, s in zip(parameters, slopes, first, second):
            m *= 0.9
            m += 0.1 * slope
            s *= 0.99
            s += 0.01 * slope**2
            p += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)
    return Field(types, cue_index, files, *tables[:5], tables[5], tables[6], moves + rule)


def _marginals(score: np.ndarray, moves: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities of every token, and expected transitions, by forward and backward products.

    Each step is scaled to sum to one; the scales cancel where a token's shares are formed.
    """
    _, width, _ = score.shape
    local, step = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(moves)
    scaled = lambda x: x / x.sum(axis=1, keepdims=True)
    ahead, back = np.empty_like(local), np.ones_like(local)
    ahead[:, 0] = scaled(local[:, 0] * np.array([1.0, 1.0, 0.0]))
    for at in range(1, width):
        moved = scaled((ahead[:, at - 1] @ step) * local[:, at])
        ahead[:, at] = np.where(there[:, at, None], moved, ahead[:, at - 1])
    for at in range(width - 2, -1, -1):
        moved = scaled((local[:, at + 1] * back[:, at + 1]) @ step.T)
        back[:, at] = np.where(there[:, at + 1, None], moved, back[:, at + 1])
    share = ahead * back
    share /= share.sum(axis=2, keepdims=True)
    pairs = np.zeros((3, 3))
    for at in range(1, width):
        live = there[:, at]
        joint = ahead[live, at - 1, :, None] * step * (local[live, at] * back[live, at])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return share, pairs


def train(documents: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Field | None:
    """Fit in one task on at most about ``sample`` distinct texts, read as a stream."""
    import pickle

    texts = documents.select(clean_text(F.col("text")).alias("text"))
    total = documents.count()
    share = min(1.0, sample / max(total, 1))
    chosen = texts.where(by_hash(share, "text")).distinct()
    chosen = chosen.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = fit((text for frame in frames for text in frame["text"]), windows=windows)
        yield pd.DataFrame({"field": [pickle.dumps(field)]})

    found = chosen.mapInPandas(giving_back(run), "field binary").collect()
    return pickle.loads(found[0].field) if found else None


def find_spans(text: str, field: Field | None, cache: TypeCache | None) -> tuple[list, list]:
    """Spans of the patterns, and those the field adds, as ``(start, end, kind)``."""
    base = base_spans(text)
    extra = field_spans(text, field, cache) if field else []
    return base, [(a, b, FIELD) for a, b in extra if not any(a < end and start < b for start, end, _ in base)]


def scan_secrets(documents: DataFrame, field: Field | None) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, base, added``.

    ``base`` are the patterns' spans, ``added`` the field's; starts and ends are code points.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared.value
        cache = TypeCache(field) if field else None
        for frame in frames:
            spans = [find_spans(text, field, cache) for text in frame["text"]]
            base, added = ([[dict(zip(("start", "end", "kind"), s)) for s in both[k]] for both in spans] for k in (0, 1))
            yield frame.drop(columns="text").assign(base=base, added=added)

    docs = documents.select(
        known_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), clean_text(F.col("text")).alias("text")
    )
    spans = "array<struct<start:int,end:int,kind:string>>"
    found = docs.mapInPandas(giving_back(run), f"doc_id long, text_hash long, base {spans}, added {spans}")
    return found.select(real_id("doc_id"), "text_hash", "base", "added")


def redact(text: str, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mask``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(documents: DataFrame, field: Field | None) -> DataFrame:
    """``documents`` with the secrets in ``text`` masked; all other columns as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = shared.value
        cache = TypeCache(field) if field else None
        for texts in batches:
            spans = [sum(find_spans(text, field, cache), []) for text in texts]
            yield pd.Series([redact(t, [(a, b) for a, b, _ in found]) for t, found in zip(texts, spans)], dtype=object)
        cache = texts = spans = None
        give_back()

    text = F.when(F.col("text").isNotNull(), mask(clean_text(F.col("text"))))
    return documents.withColumn("text", text)
