"""SentencePiece encoding and decoding: best segmentation in the max-plus semiring.

A piece file gives pieces with scores.  The encoding of a text is the sequence of pieces
that spell it with the largest sum of scores; a character outside the vocabulary costs
``UNKNOWN`` below the lowest score and is written as the byte pieces of its UTF-8 form.  Of
equal sums the one whose last piece is longest wins, place by place.  A merge-based (BPE)
encoding of the same file is another sequence of the same text.

Where no piece can cross - before a space mark after another character - the sum falls
apart, so ordinary texts are segmented word by word.  Giant texts (over ``GIANT`` characters)
are cut into chunks wherever the cut falls.  A chunk's boundary state is how many of its
first characters a piece of the chunk before has already taken; its transfer matrix holds
the best sum from each entry state to each exit state.  Matrices combine associatively
(max for +, + for *), which gives every chunk the best sums at its entry.  With these each
chunk finds its back pointers and which entry state each exit state leads to; composing
those maps from the end gives every chunk its exit state, and chunks are backtraced
independently.

A space is the mark; a mark that stands in a text itself is written in bytes, so decoding
returns every text exactly.

Defined results: null is the empty text, which has no pieces and decodes to the empty text;
repeated rows are encoded row by row; null pieces decode to the empty text; other columns
are not looked at.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import clean_text, give_back, giving_back, groups, known_id, real_id
from fleetlens.session import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 32_768
CHUNK = 16_384
UNKNOWN = 10.0
#: Characters of the texts that are encoded before their pieces are handed on.
STEP = 1 << 20
#: Words whose pieces a worker remembers within a task, and as many that it may meet besides.
WORDS = 100_000
#: Characters of the words that are segmented side by side, and of a word that is too long to be remembered.
SIDE, LONG_WORD = 1 << 16, 64
MARK = "▁"
#: Stands for a mark that belongs to the text; no valid text holds a lone surrogate.
OWN_MARK = "\ud800"
_NONE = float("-inf")
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Where a word starts after another one.
_START = re.compile(f"(?<=[^{MARK}]){MARK}")


@dataclass
class Pieces:
    """A vocabulary: ``scores[piece] = (score, id)``."""

    scores: dict[str, tuple[float, int]]
    byte_ids: list[int]
    unknown: float

    @classmethod
    def load(cls, path: str = MODEL) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[piece] = (model.get_score(i), i)
        return cls(scores, byte_ids, min(s for s, _ in scores.values()) - UNKNOWN)

    def __post_init__(self) -> None:
        self.longest = max(len(piece) for piece in self.scores)
        #: Whether a space mark after another character always starts a piece.
        self.marks_start = all(MARK not in p.lstrip(MARK) for p in self.scores)
        self.spelled = {i: piece.replace(MARK, " ").encode() for piece, (_, i) in self.scores.items()}
        self.spelled |= {i: bytes([value]) for value, i in enumerate(self.byte_ids)}
        #: Trie of the pieces: per character ``(score, id, further characters)``, without a score inside.
        self.trie: dict[str, tuple] = {}
        for piece, (score, i) in self.scores.items():
            level = self.trie
            for letter in piece[:-1]:
                level = level.setdefault(letter, (None, -1, {}))[2]
            known = level.get(piece[-1])
            level[piece[-1]] = (score, i, known[2] if known else {})
        self.score_of = np.zeros(max(self.spelled) + 1)
        # The first byte of a character bears its score; 0x80 to 0xBF continue one.
        self.score_of[[i for value, i in enumerate(self.byte_ids) if not 0x80 <= value < 0xC0]] = self.unknown
        self.score_of[[i for _, i in self.scores.values()]] = [score for score, _ in self.scores.values()]
        self.words = WordCache(self)
        self.table: pa.Array | None = None
        self.steps: Steps | None = None

    def __getstate__(self) -> tuple:
        return self.scores, self.byte_ids, self.unknown

    def __setstate__(self, state: tuple) -> None:
        self.scores, self.byte_ids, self.unknown = state
        self.__post_init__()

    def spell(self, texts: list[np.ndarray]) -> list[str]:
        """The texts of known pieces, spelled all at once."""
        if self.table is None:
            self.table = pa.array([self.spelled.get(i, b"") for i in range(max(self.spelled) + 1)], pa.large_binary())
        if not texts:
            return []
        ends = np.cumsum(list(map(len, texts)))
        taken = self.table.take(pa.array(np.concatenate(texts)))
        if not len(taken):
            return [""] * len(texts)
        _, places, data = taken.buffers()
        cuts = [0, *np.frombuffer(places, np.int64, len(taken) + 1)[ends].tolist()]
        data = memoryview(data)
        return [str(data[low:high], "utf-8", "replace")[1:] for low, high in zip(cuts, cuts[1:])]

    def ids_of(self, piece: str) -> list[int]:
        found = self.scores.get(piece)
        if found:
            return [found[1]]
        return [self.byte_ids[b] for b in (MARK if piece == OWN_MARK else piece).encode()]

    def forward(self, text: str, stop: int, best: list[float], lengths: bytearray) -> None:
        """Relax the pieces that start before ``stop``, in place; ``lengths`` are back pointers.

        ``best[i]`` is the best sum that ends at place i, ``lengths[i]`` the length of the
        last piece, 0 where the place was given.
        """
        trie, unknown = self.trie, self.unknown
        letters = list(text)
        for at in range(stop):
            here = best[at]
            if here == _NONE:
                continue
            level, to, single = trie, at, False
            for letter in letters[at:at + self.longest]:
                node = level.get(letter)
                if node is None:
                    break
                score, _, level = node
                to += 1
                if score is not None:
                    single |= to == at + 1
                    if here + score > best[to]:
                        best[to], lengths[to] = here + score, to - at
            if not single and here + unknown > best[at + 1]:
                best[at + 1], lengths[at + 1] = here + unknown, 1

    def back(self, text: str, at: int, lengths: bytes) -> tuple[int, list[int]]:
        """Ids of the pieces that end at ``at``, and the given place they start from."""
        pieces = []
        while lengths[at]:
            pieces.append(text[at - lengths[at] : at])
            at -= lengths[at]
        return at, [i for piece in reversed(pieces) for i in self.ids_of(piece)]

    def segment(self, text: str) -> tuple[float, list[int]]:
        """Best sum and pieces of a stretch on its own."""
        size, trie, unknown, longest = len(text), self.trie, self.unknown, self.longest
        best, start, ids = [_NONE] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        for at in range(size):
            here, level, to = best[at], trie, at
            for letter in text[at : at + longest]:
                node = level.get(letter)
                if node is None:
                    break
                score, i, level = node
                to += 1
                if score is not None and here + score > best[to]:
                    best[to], start[to], ids[to] = here + score, at, i
            # Every place is reached: a character without a piece costs the unknown score.
            if here + unknown > best[at + 1] and text[at] not in self.scores:
                best[at + 1], start[at + 1], ids[at + 1] = here + unknown, at, -1
        pieces, at = [], size
        while at:
            if ids[at] >= 0:
                pieces.append(ids[at])
            else:
                pieces += self.ids_of(text[start[at] : at])[::-1]
            at = start[at]
        pieces.reverse()
        return best[size], pieces

    def segment_all(self, words: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """Words and their packed ids, as :meth:`segment` finds them, many words side by side."""
        if not words:
            return
        if self.steps is None:
            self.steps = Steps.of(self)
        for first, last in _steps(list(map(len, words)), SIDE):
            yield words[first:last], self.steps.segment(words[first:last])

    def forget(self) -> None:
        """Let the words go that were looked up; the worker outlives the task."""
        self.words.reset()
        give_back()

    def sum_of(self, packed: bytes) -> float:
        """Sum of scores of packed ids; a character in bytes costs the unknown score once."""
        return float(self.score_of[np.frombuffer(packed, dtype=np.int32)].sum())

    def cuts(self, chunk: str) -> tuple[int, int] | None:
        """First and last place of a chunk that no piece crosses, beyond the entry states."""
        if not self.marks_start:
            return None
        inner = [m.start() for m in _START.finditer(chunk, self.longest)]
        return (inner[0], inner[-1]) if inner else None

    def through(
        self, chunk: str, ahead: str, entry: list[float], inner: bytes = b""
    ) -> tuple[list[float], list[int], bytes]:
        """Best sums at the exit states, the entry state each leads to (-1: none), and back pointers.

        ``entry`` are the best sums at the entry states.  Between the first and the last
        place that no piece crosses the words are on their own and have no pointers; their sum,
        the same for all states, is that of ``inner`` (left out without them).
        """
        text, size = chunk + ahead, len(chunk)
        cut = self.cuts(chunk)
        if cut is None:
            best, lengths = [_NONE] * (len(text) + 1), bytearray(len(text) + 1)
            best[: len(entry)] = entry[: len(best)]
            self.forward(text, size, best, lengths)
            leads = []
            for at in range(size, size + self.longest):
                if at >= len(best) or best[at] == _NONE:
                    leads.append(-1)
                    continue
                while lengths[at]:
                    at -= lengths[at]
                leads.append(at)
            return best[size : size + self.longest], leads, bytes(lengths)
        first, last = cut
        best, before = [_NONE] * (first + 1), bytearray(first + 1)
        best[: len(entry)] = entry[: len(best)]
        self.forward(text[:first], first, best, before)
        total, start = best[first], first
        while before[start]:
            start -= before[start]
        if inner:
            total += self.sum_of(inner)
        end, after = [total] + [_NONE] * (len(text) - last), bytearray(len(text) - last + 1)
        self.forward(text[last:], size - last, end, after)
        exits = end[size - last :][: self.longest]
        leads = [start if score != _NONE else -1 for score in exits]
        return exits, leads + [-1] * (self.longest - len(leads)), bytes(before) + bytes(after)

    def transfer(self, chunk: str, ahead: str, inner: bytes) -> np.ndarray:
        """Best sums from entry state to exit state; ``inner`` from :meth:`inner`."""
        width = self.longest
        result = np.full((width, width), _NONE)
        cut = self.cuts(chunk)
        if cut is None:
            for state in range(min(width, len(chunk) + 1)):
                exits = self.through(chunk, ahead, [_NONE] * state + [0.0])[0]
                result[state, : len(exits)] = exits
            return result
        # Beyond the first place that no piece crosses all entries go together.
        to_cut = []
        for state in range(width):
            best = [_NONE] * (cut[0] + 1)
            best[state] = 0.0
            self.forward(chunk[: cut[0]], cut[0], best, bytearray(len(best)))
            to_cut.append(best[-1])
        exits = np.array(self.through(chunk, ahead, [0.0], inner)[0]) - to_cut[0]
        result[:, : len(exits)] = np.array(to_cut)[:, None] + exits
        return result

    def inner(self, chunk: str) -> bytes:
        """Packed ids of the words between the first and the last place that no piece crosses."""
        cut = self.cuts(chunk)
        if cut is None:
            return b""
        return self.words.encode(_marked(chunk[cut[0] : cut[1]]))[0].tobytes()

    def trace(self, chunk: str, ahead: str, exit_: int, lengths: bytes, inner: bytes) -> np.ndarray:
        """Ids of the pieces that start in a chunk, from its exit state, back pointers and inner words."""
        text, size = chunk + ahead, len(chunk)
        cut = self.cuts(chunk)
        if cut is None:
            return np.array(self.back(text, size + exit_, lengths)[1], dtype=np.int32)
        first, last = cut
        head = self.back(text[:first], first, lengths[: first + 1])[1]
        tail = self.back(text[last:], size - last + exit_, lengths[first + 1 :])[1]
        parts = [np.array(head, dtype=np.int32), np.frombuffer(inner, dtype=np.int32), np.array(tail, dtype=np.int32)]
        return np.concatenate(parts)


@dataclass
class Steps:
    """The trie of the pieces as a hash table from ``node * letters + letter`` to the next node.

    Letters are numbered from 1; 0 is the gap after a word or a letter of no piece, which no
    piece crosses.  Node 0 is the root, and as the end of a piece a letter in bytes.
    """

    pieces: Pieces
    letters: np.ndarray
    single: np.ndarray
    keys: np.ndarray
    nexts: np.ndarray
    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, pieces: Pieces) -> "Steps":
        scores = pieces.scores
        known = sorted(set("".join(scores)))
        # The last place stands for all letters beyond.
        letters = np.zeros(ord(known[-1]) + 2, dtype=np.int64)
        letters[[ord(letter) for letter in known]] = np.arange(1, len(known) + 1)
        number = {letter: i + 1 for i, letter in enumerate(known)}
        nodes: dict[int, int] = {}
        ends: dict[int, tuple[float, int]] = {}
        for piece, end in scores.items():
            node = 0
            for letter in piece:
                node = nodes.setdefault(node * (len(known) + 1) + number[letter], len(nodes) + 1)
            ends[node] = end
        size = 1 << (4 * len(nodes)).bit_length()
        single = np.array([False, *(letter in scores for letter in known)])
        table = cls(
            pieces, letters, single, np.full(size, -1), np.zeros(size, np.int64),
            np.full(len(nodes) + 1, np.nan), np.zeros(len(nodes) + 1, np.int32),
        )
        table.scores[0], table.ids[0] = pieces.unknown, -1
        table.scores[list(ends)] = [score for score, _ in ends.values()]
        table.ids[list(ends)] = [i for _, i in ends.values()]
        left, to = np.array(list(nodes)), np.array(list(nodes.values()))
        slot = table.slot(left)
        while len(left):
            # Of several keys for a free slot one gets it; the others try the next slot.
            free = np.flatnonzero(table.keys[slot] < 0)
            table.keys[slot[free]] = left[free]
            got = table.keys[slot] == left
            table.nexts[slot[got]] = to[got]
            left, to, slot = left[~got], to[~got], (slot[~got] + 1) & (size - 1)
        table.__post_init__()
        table.first = table.follow(np.zeros(len(single), np.int64), np.arange(len(single)))
        return table

    def __post_init__(self) -> None:
        self.ends = ~np.isnan(self.scores)
        self.first = np.zeros(len(self.single), np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 >> 20) & (len(self.keys) - 1)

    def follow(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node each letter leads to, 0 if no piece goes on with it."""
        wanted = nodes * len(self.single) + letters
        slot = self.slot(wanted)
        there = self.keys[slot]
        other = np.flatnonzero((there != wanted) & (there >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            there[other] = self.keys[slot[other]]
            other = other[(there[other] != wanted[other]) & (there[other] >= 0)]
        return np.where(there == wanted, self.nexts[slot], 0)

    def segment(self, words: list[str]) -> list[bytes]:
        """Packed ids of the best pieces of each word."""
        longest = self.pieces.longest
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum(sizes + 1) - sizes - 1
        letters = np.zeros(len(text) + longest, dtype=np.int64)
        letters[: len(text)] = self.letters[np.minimum(text, len(self.letters) - 1)]
        letters[starts + sizes] = 0
        inside = np.arange(len(text)) - np.repeat(starts, sizes + 1)
        # All pieces from each place: where they start, how long they are and their node.
        bare = ~self.single[letters[: len(text)]]
        bare[starts + sizes] = False
        bare = np.flatnonzero(bare)
        found = [(bare, np.ones(len(bare), np.int64), np.zeros(len(bare), np.int64))]
        at = np.flatnonzero(letters[: len(text)])
        node = self.first[letters[at]]
        for length in range(1, longest + 1):
            if length > 1:
                node = self.follow(node, letters[at + length - 1])
            on = np.flatnonzero(node)
            if not len(on):
                break
            at, node = at[on], node[on]
            ends = np.flatnonzero(self.ends[node])
            found.append((at[ends], np.full(len(ends), length), node[ends]))
        start, length, node = map(np.concatenate, zip(*found))
        # Place by place in all words at once; within a step no two pieces end at one place.
        step = inside[start] * (longest + 1) + length
        # Numbers of 16 bits are sorted by counting.
        order = np.argsort(step.astype(np.int16) if step.max() < 1 << 15 else step, kind="stable")
        start, length, node, step = start[order], length[order], node[order], step[order]
        best, last = np.full(len(text), _NONE), np.zeros(len(text), dtype=np.int64)
        best[starts] = 0.0
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        to, score = start + length, self.scores[node]
        for low, high in zip(edges, edges[1:]):
            ends, total = to[low:high], best[start[low:high]] + score[low:high]
            more = np.flatnonzero(total > best[ends])
            best[ends[more]] = total[more]
            last[ends[more]] = low + more
        # Back from the ends, one piece of every word at a time.
        at, word, owners, taken = starts + sizes, np.arange(len(words)), [], []
        while len(at):
            piece = last[at]
            owners.append(word)
            taken.append(piece)
            at = start[piece]
            on = np.flatnonzero(at > starts[word])
            at, word = at[on], word[on]
        owner, piece = np.concatenate(owners), np.concatenate(taken)
        turn = np.repeat(np.arange(len(owners)), [len(each) for each in owners])
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        place = ends[owner] - 1 - turn
        ids, letter = np.empty(len(piece), np.int32), np.empty(len(piece), np.uint32)
        ids[place], letter[place] = self.ids[node[piece]], text[start[piece]]
        if (ids < 0).any():
            ids, ends = self.in_bytes(ids, letter, ends)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[low:high] for low, high in zip(cuts, cuts[1:])]

    def in_bytes(self, ids: np.ndarray, letter: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the byte pieces of their letter for each -1, and where the words then end."""
        spelled = {code: self.pieces.ids_of(chr(code)) for code in np.unique(letter[ids < 0]).tolist()}
        size = np.ones(len(ids), dtype=np.int64)
        for code, parts in spelled.items():
            size[(ids < 0) & (letter == code)] = len(parts)
        first = np.cumsum(size) - size
        found = np.repeat(ids, size)
        for code, parts in spelled.items():
            at = first[(ids < 0) & (letter == code)]
            for turn, part in enumerate(parts):
                found[at + turn] = part
        return found, np.cumsum(size)[ends - 1]


class WordCache(dict):
    """Numbers of words, which stand without their first mark, and the ids of the pieces of each number.

    Of a full cache the words that were met first stay, among them nearly all frequent ones.
    """

    def __init__(self, pieces: Pieces, most: int = WORDS) -> None:
        super().__init__()
        self.pieces, self.most = pieces, most
        self.reset()

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number

    def reset(self) -> None:
        self.clear()
        #: How many words stayed when the cache was full.
        self.older = 0
        #: Ids of all words one after the other, and where each word's begin.
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def age(self) -> None:
        """Let the words go that were met last."""
        fit = int(np.searchsorted(self.first, 8 * self.most, "right")) - 1
        stay, ids, first = list(itertools.islice(self, min(self.most, fit))), self.ids, self.first
        self.reset()
        self.older = len(stay)
        self.update(zip(stay, itertools.count()))
        self.first = first[: len(stay) + 1]
        self.ids = ids[: self.first[-1]]

    def learn(self, new: list[str]) -> None:
        """Add the pieces of the words that were numbered last; only long ones are not done side by side."""
        short = [MARK + word for word in new if len(word) < LONG_WORD]
        found = list(itertools.chain.from_iterable(packed for _, packed in self.pieces.segment_all(short)))
        if len(short) < len(new):
            side = iter(found)
            found = [
                next(side) if len(word) < LONG_WORD else array("i", self.pieces.segment(MARK + word)[1]).tobytes()
                for word in new
            ]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where those of each word end."""
        if len(self) > 2 * self.most or len(self.ids) > 16 * self.most:
            self.age()
        before = len(self)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self) > before:
            self.learn(list(itertools.islice(self, before, None)))
        first = self.first[numbers]
        sizes = self.first[numbers + 1] - first
        ends = np.cumsum(sizes)
        at = np.repeat(first - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], ends


def _marked(text: str) -> list[str]:
    """Words of a text that begins with a mark, each without its first mark."""
    return [word[1:] for word in _WORD.findall(text)]


def _words(text: str) -> list[str]:
    """Words of a text, each without its first mark."""
    plain = text and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "
    return text.split(" ") if plain else _marked(shown(text))


def shown(text: str) -> str:
    """A text as pieces see it: a mark before it and for every space."""
    return MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK) if text else ""


def encode_text(text: str, pieces: Pieces) -> np.ndarray:
    """Ids of one text."""
    return encode_texts([text], pieces)[0]


def encode_texts(texts: list[str], pieces: Pieces) -> list[np.ndarray]:
    """Ids of several texts, whose new words are segmented side by side."""
    if not pieces.marks_start:
        return [np.array(pieces.segment(shown(text))[1], dtype=np.int32) for text in texts]
    found = list(map(_words, texts))
    ids, ends = pieces.words.encode(list(itertools.chain.from_iterable(found)))
    # Where the words of each text end, as a place in the ids.
    cuts = np.concatenate([[0], ends]).astype(np.int64)[np.cumsum(list(map(len, found)))] if texts else []
    return np.split(ids, cuts[:-1]) if texts else []


def _chunks(frames: Iterator[pd.DataFrame], size: int, ahead: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for key, text in zip(frame["row_key"], frame["text"]):
            text = shown(text)
            # The last chunk takes what is left over, so each chunk is at least ``size`` long.
            count = max(1, len(text) // size)
            edges = [*range(0, count * size, size), len(text)]
            parts = list(zip(edges, edges[1:]))
            # Marks of the text's own travel as text; a lone surrogate cannot.
            for first in range(0, count, 256):
                block = parts[first : first + 256]
                yield pd.DataFrame(
                    {
                        "row_key": key,
                        "chunk": range(first, first + len(block)),
                        "body": [text[a:b].encode("utf-8", "surrogatepass") for a, b in block],
                        "ahead": [text[b : b + ahead].encode("utf-8", "surrogatepass") for _, b in block],
                    }
                )


def _blocks(frames: Iterator[pd.DataFrame], most: int = 64) -> Iterator[pd.DataFrame]:
    """Few chunks at a time: what is made of a chunk takes several times its room."""
    for frame in frames:
        for first in range(0, len(frame), most):
            yield frame.iloc[first : first + most]


def _text(data: bytes) -> str:
    return bytes(data).decode("utf-8", "surrogatepass")


def _giants(texts: DataFrame, shared, longest: int, chunk: int) -> DataFrame:
    """``row_key, pieces`` of giant texts, by chunks."""
    cut = texts.mapInPandas(lambda frames: _chunks(frames, chunk, longest), "row_key long, chunk int, body binary, ahead binary")
    chunks = stored(cut.repartition("row_key", "chunk"))

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for part in _blocks(frames):
            bodies, nexts = [_text(b) for b in part["body"]], [_text(a) for a in part["ahead"]]
            inner = [known.inner(body) for body in bodies]
            found = [known.transfer(*each).tobytes() for each in zip(bodies, nexts, inner)]
            yield part[["row_key", "chunk"]].assign(matrix=found, inner=inner)
        known.forget()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(frames, ["row_key"]):
            entry = np.full(longest, _NONE)
            entry[0] = 0.0
            entries = []
            for matrix in group["matrix"]:
                entries.append(entry.tobytes())
                entry = (entry[:, None] + np.frombuffer(matrix).reshape(longest, longest)).max(axis=0)
            yield group[["row_key", "chunk"]].assign(entry=entries)

    def pointers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(frames):
            found = [
                shared.value.through(_text(body), _text(ahead), np.frombuffer(entry).tolist())[1:]
                for body, ahead, entry in zip(part["body"], part["ahead"], part["entry"])
            ]
            leads, lengths = [leads for leads, _ in found], [lengths for _, lengths in found]
            yield part[["row_key", "chunk"]].assign(lengths=lengths, leads=leads)

    def exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(frames, ["row_key"]):
            state, found = 0, []
            for leads in reversed(group["leads"].tolist()):
                found.append(state)
                state = int(leads[state])
            yield group[["row_key", "chunk"]].assign(exit=found[::-1])

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(frames):
            columns = [part[c] for c in ("body", "ahead", "exit", "lengths", "inner")]
            found = [
                shared.value.trace(_text(body), _text(ahead), exit_, lengths, inner)
                for body, ahead, exit_, lengths, inner in zip(*columns)
            ]
            yield part[["row_key", "chunk"]].assign(pieces=found)

    def by_text(df: DataFrame) -> DataFrame:
        return df.repartition("row_key").sortWithinPartitions("row_key", "chunk")

    moves = stored(chunks.mapInPandas(matrices, "row_key long, chunk int, matrix binary, inner binary"))
    entries = by_text(moves.select("row_key", "chunk", "matrix")).mapInPandas(scan, "row_key long, chunk int, entry binary")
    pointed = stored(
        chunks.join(entries, ["row_key", "chunk"]).mapInPandas(
            giving_back(pointers), "row_key long, chunk int, lengths binary, leads array<int>"
        )
    )
    ends = by_text(pointed.select("row_key", "chunk", "leads")).mapInPandas(exits, "row_key long, chunk int, exit int")
    known = pointed.drop("leads").join(ends, ["row_key", "chunk"]).join(moves.drop("matrix"), ["row_key", "chunk"])
    traced = chunks.join(known, ["row_key", "chunk"]).mapInPandas(giving_back(trace), "row_key long, chunk int, pieces array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "pieces")))
    return traced.groupBy("row_key").agg(F.flatten(F.transform(ordered, lambda x: x["pieces"])).alias("pieces"))


def _steps(lengths: list[int], most: int = STEP) -> list[tuple[int, int]]:
    """Runs of rows with at most about ``most`` characters, and at least one row each."""
    cuts, held = [0], 0
    for at, size in enumerate(lengths):
        if held and held + size > most:
            cuts.append(at)
            held = 0
        held += size
    return list(zip(cuts, [*cuts[1:], len(lengths)]))


def encode(
    documents: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, spell: bool = False
) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, pieces``; with ``spell`` also ``text``, what the pieces decode to.

    Encoding and decoding at once, the workers hold one vocabulary, and pieces go to them once.
    """
    spark: SparkSession = documents.sparkSession
    vocabulary = Pieces.load(path)
    if chunk < vocabulary.longest:
        raise ValueError("a chunk must be longer than the longest piece")
    shared = spark.sparkContext.broadcast(vocabulary)
    docs = documents.select(
        known_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), clean_text(F.col("text")).alias("text")
    )
    is_giant = F.length("text") > giant

    def ordinary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        known = shared.value
        for frame in frames:
            # Small steps: the ids of a batch take more room than its texts.
            for first, last in _steps(frame["text"].str.len().tolist()):
                part = frame.iloc[first:last]
                found = encode_texts(part["text"].tolist(), known)
                part = part.drop(columns="text").assign(pieces=found)
                yield part.assign(text=known.spell(found)) if spell else part
        known.forget()

    schema = "doc_id long, text_hash long, pieces array<int>" + (", text string" if spell else "")
    short = docs.where(~is_giant).mapInPandas(ordinary, schema)
    # Giant texts are stored with their key, so the key is the same in every later stage.
    large = stored(docs.where(is_giant).withColumn("row_key", F.monotonically_increasing_id()))
    long = large.drop("text").join(_giants(large.select("row_key", "text"), shared, vocabulary.longest, chunk), "row_key")
    long = long.select("doc_id", "text_hash", "pieces")
    both = short.unionByName(decode(long, path) if spell else long)
    return both.select(real_id("doc_id"), "text_hash", "pieces", *(["text"] if spell else []))


def _spell(ids: np.ndarray, table: list[bytes]) -> str:
    known = ids[(ids >= 0) & (ids < len(table))].tolist()
    return b"".join(map(table.__getitem__, known)).decode("utf-8", "replace")[1:]


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with ``text``, spelled by its ``pieces``; unknown ids spell nothing."""
    spelled = Pieces.load(path).spelled
    shared = encoded.sparkSession.sparkContext.broadcast([spelled.get(i, b"") for i in range(max(spelled) + 1)])

    @F.pandas_udf("string")
    def spell(pieces: pd.Series) -> pd.Series:
        none = np.zeros(0, dtype=np.int64)
        found = [_spell(none if ids is None else np.asarray(ids), shared.value) for ids in pieces]
        return pd.Series(found, dtype=object)

    return encoded.withColumn("text", spell("pieces"))
