"""Document fingerprints: improbable features in chained Bloom filters.

Features are windows of ``WINDOW`` bytes, one at every byte of a text.  Each has the entropy
of its bytes, in thousandths of the largest possible.  The rarity table counts these
entropies over all windows of all texts: the less frequent a value, the more a window with
it tells.  Of every ``NEAR`` neighbouring windows the rarest gets a point, and windows with
at least ``POINTS`` points are selected; both are decided by content alone, so an insertion
moves windows but does not change them.  A selected window sets five bits of a 2,048-bit
Bloom filter; after ``PER_FILTER`` windows the next filter begins.

Likeness of two filters is their bit overlap between what chance gives (|a| * |b| / 2048)
and the most possible (the smaller count), cut to 0..1; of two fingerprints, the mean over
the filters of the shorter one of the best match in the longer one.

Defined results: null is the empty text; a text shorter than a window is one feature; the
empty text has no filters, is like another empty text (1) and unlike all others (0); equal
texts have equal fingerprints; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bytes import BYTE_IDS, mix, scramble, slide
from fleetlens.llm.common import clean_text, known_id, real_id

WINDOW = 64
NEAR = 5
POINTS = 2
FILTER_BITS = 2048
PER_FILTER = 128
LEVELS = 1001
#: Bytes worked on at a time: short texts together, long ones in pieces.
_WORK = 1 << 17
#: Filters compared at a time.
_BLOCK = 2048
_LOGS = np.zeros(WINDOW + 1)
_LOGS[1:] = np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))
_BEST = np.log2(WINDOW)
#: The same in whole numbers, so that running sums are exact, and their steps from one count to the next.
_UNIT = float(1 << 40)
_WHOLE = np.rint(_LOGS * _UNIT).astype(np.int64)
_STEPS = np.append(0, np.diff(_WHOLE))


def _entropy(windows: np.ndarray) -> np.ndarray:
    """Entropy of each row of bytes, in thousandths of the largest."""
    ordered = np.sort(windows, axis=1)
    size = windows.shape[1]
    change = np.ones((len(ordered), size + 1), dtype=bool)
    change[:, 1:size] = ordered[:, 1:] != ordered[:, :-1]
    at = np.flatnonzero(change)
    # Differences of neighbouring change places are the counts; between rows they are 0 or 1 too many.
    row, column = at // (size + 1), at % (size + 1)
    counts = np.diff(column)
    inner = row[1:] == row[:-1]
    spent = np.bincount(row[1:][inner], _LOGS[counts[inner]], len(ordered))
    return np.rint(1000 * (np.log2(size) - spent / size) / _BEST).astype(np.int64)


def _levels(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at every byte, as in ``_entropy``; ``data`` holds one window at least.

    From one window to the next only two counts change: of the byte that leaves, as often as
    it is in the window it begins, and of the byte that comes, as it is in the one it ends.
    """
    ahead, behind = np.ones(len(data), dtype=np.uint8), np.ones(len(data), dtype=np.uint8)
    for step in range(1, min(WINDOW, len(data))):
        same = (data[step:] == data[:-step]).view(np.uint8)
        ahead[:-step] += same
        behind[step:] += same
    last = len(data) - WINDOW
    spent = np.empty(last + 1, dtype=np.int64)
    spent[0] = _WHOLE[np.bincount(data[:WINDOW])].sum()
    spent[1:] = _STEPS[behind[WINDOW:]] - _STEPS[ahead[:last]]
    np.cumsum(spent, out=spent)
    return np.rint(1000 * (_BEST - spent / (_UNIT * WINDOW)) / _BEST).astype(np.int16)


def _names(data: np.ndarray) -> np.ndarray:
    """Identifier of the window at every byte."""
    ids = BYTE_IDS[data]
    step = 1
    while step < WINDOW:
        ids = mix(ids[:-step], ids[step:])
        step *= 2
    return ids


def _buffers(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Texts of a window and more, put together to about ``_WORK`` bytes; ``(row, start, end)`` of each.

    A text longer than that is alone in its buffer.
    """
    held, places, size = [], [], 0
    for row, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        if held and size + len(text) > _WORK:
            yield np.frombuffer(b"".join(held), dtype=np.uint8), places
            held, places, size = [], [], 0
        held.append(text)
        places.append((row, size, size + len(text)))
        size += len(text)
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), places


def count_levels(texts: Iterable[bytes]) -> np.ndarray:
    """How many windows have each entropy; a text shorter than a window counts as one of 0."""
    texts = list(texts)
    total = np.zeros(LEVELS, dtype=np.int64)
    total[0] = sum(0 < len(text) < WINDOW for text in texts)
    for data, places in _buffers(texts):
        if len(places) == 1:
            for base in range(0, len(data) - WINDOW + 1, _WORK):
                total += np.bincount(_levels(data[base : base + _WORK + WINDOW - 1]), minlength=LEVELS)
            continue
        levels = _levels(data)
        # Windows that reach into the next text are none.
        own = np.ones(len(levels), dtype=bool)
        for _, _, end in places[:-1]:
            own[end - WINDOW + 1 : end] = False
        total += np.bincount(levels[own], minlength=LEVELS)
    return total


def _points(levels: np.ndarray, names: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Points of each of more than ``NEAR`` neighbouring windows."""
    # Rank and identifier in one number: the rarest wins, ties go by content, not by place.
    order = (rank[levels].astype(np.uint64) << np.uint64(48)) | (names >> np.uint64(16))
    least = slide(order, NEAR, np.minimum)
    points = np.zeros(len(order), dtype=np.int8)
    for shift in range(NEAR):
        points[shift : shift + len(least)] += order[shift : shift + len(least)] == least
    return points


def _pick(levels: np.ndarray, names: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if len(names) <= NEAR:
        return names
    points = _points(levels, names, rank)
    # A window at the edge stands in fewer neighbourhoods.
    return names[points >= POINTS] if (points >= POINTS).any() else names[points > 0]


def _pick_long(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``_pick`` over one long text, in pieces that overlap by the neighbours on both sides."""
    count = len(data) - WINDOW + 1
    found = []
    for least in (POINTS, 1):
        for base in range(0, count, _WORK):
            first, last = max(0, base - NEAR + 1), min(count, base + _WORK + NEAR - 1)
            # The last piece may be short; points need a whole neighbourhood.
            first = max(0, min(first, last - NEAR))
            part = data[first : last + WINDOW - 1]
            names = _names(part)
            points = _points(_levels(part), names, rank)
            inner = slice(base - first, min(count, base + _WORK) - first)
            found.append(names[inner][points[inner] >= least])
        if any(len(part) for part in found):
            break
    return np.concatenate(found)


def select_all(texts: Iterable[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Identifiers of the selected windows of each text, in text order."""
    texts = list(texts)
    found = [np.zeros(0, dtype=np.uint64)] * len(texts)
    for row, text in enumerate(texts):
        if 0 < len(text) < WINDOW:
            found[row] = np.array([np.uint64(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little"))])
    for data, places in _buffers(texts):
        if len(data) > _WORK:
            found[places[0][0]] = _pick_long(data, rank)
            continue
        levels, names = _levels(data), _names(data)
        for row, start, end in places:
            found[row] = _pick(levels[start : end - WINDOW + 1], names[start : end - WINDOW + 1], rank)
    return found


def select(data: bytes, rank: np.ndarray) -> np.ndarray:
    """Identifiers of the selected windows of a text, in text order."""
    return select_all([data], rank)[0]


def filters(names: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, one row of bits each."""
    chain = -(-len(names) // PER_FILTER)
    bits = np.zeros((chain, FILTER_BITS), dtype=bool)
    spread = scramble(names)
    row = np.arange(len(names)) // PER_FILTER
    for k in range(5):
        bits[row, ((spread >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    return bits


def digest(bits: np.ndarray) -> str:
    return base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()


def parse(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8)
    return np.unpackbits(raw.reshape(-1, FILTER_BITS // 8), axis=1).astype(bool)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Normalised bit overlap of two chains of filters."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    if len(one) > len(two):
        one, two = two, one
    best = np.zeros(len(one), dtype=np.float32)
    for start in range(0, len(one), _BLOCK):
        a = one[start : start + _BLOCK].astype(np.float32)
        for other in range(0, len(two), _BLOCK):
            b = two[other : other + _BLOCK].astype(np.float32)
            shared, size1, size2 = a @ b.T, a.sum(1)[:, None], b.sum(1)[None, :]
            chance = size1 * size2 / FILTER_BITS
            room = np.minimum(size1, size2) - chance
            match = np.clip((shared - chance) / np.maximum(room, 1e-9), 0, 1).max(axis=1)
            best[start : start + _BLOCK] = np.maximum(best[start : start + _BLOCK], match)
    return float(round(best.mean(), 6))


def rarity(documents: DataFrame) -> np.ndarray:
    """Rank of each entropy level over all texts: 0 is the rarest that occurs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS, dtype=np.int64)
        for frame in frames:
            total += count_levels([text.encode() for text in frame["text"]])
        level = np.flatnonzero(total)
        yield pd.DataFrame({"level": level, "n": total[level]})

    counts = documents.select(clean_text(F.col("text")).alias("text")).mapInPandas(run, "level int, n long")
    found = np.zeros(LEVELS, dtype=np.int64)
    for row in counts.groupBy("level").agg(F.sum("n").alias("n")).collect():
        found[row.level] = row.n
    return np.argsort(np.argsort(found, kind="stable"), kind="stable")


def fingerprint(documents: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, fingerprint``."""
    rank = rarity(documents) if rank is None else rank

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            selected = select_all([text.encode() for text in frame["text"]], rank)
            yield frame.drop(columns="text").assign(fingerprint=[digest(filters(names)) for names in selected])

    docs = documents.select(
        known_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), clean_text(F.col("text")).alias("text")
    )
    found = docs.mapInPandas(run, "doc_id long, text_hash long, fingerprint string")
    return found.select(real_id("doc_id"), "text_hash", "fingerprint")


def splice(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """Documents dealt to ranges of ids, each range ended by the first row of the next one.

    ``part, ahead, key, text`` sorted within partitions; ``ahead`` is 1 for that
    extra row.  The cut points come from approximate quantiles and decide only how even the
    ranges are.
    """
    docs = documents.select(known_id(F.col("doc_id")).alias("key"), clean_text(F.col("text")).alias("text"))
    shares = [k / ranges for k in range(1, ranges)]
    ids = documents.select(F.col("doc_id").cast("double"))
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", shares, 0.2 / ranges)}) if shares else []

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, dtype=np.int64), keys.to_numpy(), side="right").astype(np.int32))

    dealt = docs.withColumn("part", part("key"))
    firsts = {row.part: row.first for row in docs.select("key", part("key").alias("part")).groupBy("part").agg(F.min("key").alias("first")).collect()}
    used = sorted(firsts)
    # The first row of a range also ends the range before it; that of the first, the last.
    before = {firsts[p]: used[i - 1] for i, p in enumerate(used)}
    own = F.struct(F.col("part"), F.lit(0).alias("ahead"))
    places = F.array(own)
    if before:
        other = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("key"))
        extra = F.struct(other.alias("part"), F.lit(1).alias("ahead"))
        places = F.when(F.col("key").isin(list(before)), F.array(own, extra)).otherwise(places)
    dealt = dealt.select("key", "text", F.explode(places).alias("place")).select("key", "text", "place.*")
    return dealt.repartition(ranges, "part").sortWithinPartitions("part", "ahead", "key", "text")


def spliced_fingerprints(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its splice with the next text by ascending id.

    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.
    Equal ids are ordered by text; null ids come first; the last text is followed by the
    first.
    """
    ranges = ranges or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = rarity(documents)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            out = []
            columns = [frame[c].tolist() for c in ("part", "ahead", "key", "text")]
            rows = list(zip(*columns))
            # Of the rows that end a range, only the first follows on.
            before = [held, *[None if ahead else (part, doc_id, text) for part, ahead, doc_id, text in rows]]
            changed = [splice(b[2], r[3]) if b is not None and b[0] == r[0] else None for b, r in zip(before, rows)]
            selected = select_all([text.encode() for text in columns[3]], rank)
            spliced = iter(select_all([text.encode() for text in changed if text is not None], rank))
            for last, edited, chosen in zip(before, changed, selected):
                bits = filters(chosen)
                if edited is not None:
                    _, mine, own = last
                    changed_bits = filters(next(spliced))
                    out.append(
                        (mine, len(own), edited, digest(own_bits), digest(changed_bits), likeness(own_bits, changed_bits), likeness(own_bits, bits))
                    )
                own_bits = bits
            held = before[-1]
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents, ranges).mapInPandas(run, schema).select(real_id("doc_id"), *names[1:])
