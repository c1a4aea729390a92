"""Language-model scores from a probabilistic suffix tree over words.

A text is its words, lower-cased A-Z and cut at ASCII white space, and one end token.  The
next token is drawn from the longest retained suffix of the tokens before it, within the
text.  All words that training never saw are one symbol, as in the base score.

The empty context: with c occurrences of N tokens and V distinct tokens,

    P(word) = (c - D) / N,    P(unseen) = D * V / N,    D = 0.75

A context s, seen n times, lists the next words it was followed by twice or more.  Its
distribution takes D off every listed count and gives that, and all counts not listed, to
the context without its first word:

    P(word | s) = (n(word) - D + B * P(word | shorter)) / n   if listed,
    P(word | s) = B * P(word | shorter) / n                   if not;   B = D * listed + not listed

Growth and divergence test: the candidates of length 1 are all words seen ``MIN_SEEN`` times.
A longer context is a candidate if it was seen ``MIN_SEEN`` times, the context without its
first word is retained and the one without its last word was a candidate.  A candidate is
retained if, token by token and each token left out of its own count, its distribution codes
what followed it in at least ``BITS`` bits less than the shorter one does.  Lengths are tried
one after the other until no candidate is left or none is retained; there is no longest one,
and nothing depends on the size of the corpus.

Scoring: the log of P(word | longest) is the log of P(word) plus one term for every retained
suffix (its share handed on) and one for every retained suffix that lists the word.  The model
is therefore one table of keys with numbers to add.

At scale: one pass over the texts counts words and stores each text as the 64-bit keys of its
tokens, which every length reads.  Candidates, lists and the model are stored tables, joined
by key, and grow with the corpus.  Tasks get things of fixed size only: bit tables of keys (at
most ``FILTER_BITS`` bits each; a key found in one wrongly is dropped by the join) and the
``SHORTCUT`` entries of the model used most often, which are added where the text is, so that
no key of the join is hot.  Neither changes a result.  What is counted and looked up goes between tasks
packed: the pairs or keys of many texts that fall into one bucket, a range of keys, are one row,
and numpy counts or finds them a bucket at a time; there are as many buckets as the pairs or
entries need.  Texts are scored in up to ``PARTS`` parts, one after the other, so that only a part's keys
are on disk at once.  Word keys are checked: if two words of
the corpus share a key, everything is encoded again with another salt.  Keys of contexts are
not checked; with n entries two share a key with a chance of n * n / 2**65.

Defined results: null is the empty text, one end token; repeated rows are counted and scored
row by row; a null id stays null; without training rows nothing is known, and base and score
are 0; other columns are not looked at.  Very long texts are worked on ``PIECE`` tokens at a time.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import NO_ID, clean_text, discard, give_back, known_id, real_id
from fleetlens.session import stored

MIN_SEEN = 8
BITS = 24.0
DISCOUNT = 0.75
#: Entries of the model that every task holds, and bits of a table of keys.
SHORTCUT = 1_000_000
FILTER_BITS = 1 << 27
#: Tokens worked on at once, and rows handed to Spark at once: two tasks and Spark itself share an executor.
PIECE = 125_000
BATCH = 50_000
#: The end token, which no word equals.
END = b"\n"
#: The key of several tokens mixes the keys of all but the last and of all but the first.
_FACTORS = np.array([-7046029254386353131, -4417276706812531889], dtype=np.int64)
#: Sets the key of a context apart from that of the same words as context and next word.
_CONTEXT = np.int64(0x5851F42D4C957F2D)
#: Bits of a key that give its two places in a bit table.
_PLACES = (0, 33)
_FLUSH_WORDS, _FLUSH_PAIRS = 400_000, 500_000
#: Pairs or entries of a bucket, which a task holds whole; a text's tokens give about one pair each.
BUCKET = 1_000_000
#: Parts in which texts are scored, and tokens that are worth a part of their own.
PARTS, PART = 4, 1 << 24
#: Packed rows of the scoring: entries of the model, the texts of a block, keys looked up for it.
_MODEL, _TEXTS, _KEYS = 0, 1, 2
_ENTRY = (np.int64, np.int64, np.float64)
_TEXT = (np.int64, np.int64, np.bool_, np.int64, np.int64, np.float64, np.float64)
_WANTED = (np.int64, np.uint32)
_ANSWER = (np.uint32, np.uint32, np.float64, np.float64)
_PAIR = (np.int64, np.int64, np.uint32)


def tokens(text: str) -> list[bytes]:
    """Words of a text without the end token; ``bytes`` know ASCII white space and letters only."""
    return text.encode().lower().split()


def _with_end(text: str) -> list[bytes]:
    return [*tokens(text), END]


def _key(word: bytes, salt: int) -> int:
    """The second half of 128 bits of a word; the first half tells words with one key apart."""
    return int.from_bytes(xxhash.xxh3_128_digest(word, salt)[8:], "big", signed=True)


class _Words(dict):
    """Number of each word met, in order of meeting."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def halves(self, start: int, salt: int) -> np.ndarray:
        """Both halves of the words from number ``start`` on."""
        digests = [xxhash.xxh3_128_digest(word, salt) for word in itertools.islice(self, start, None)]
        return np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)


def encode_texts(documents: DataFrame, salt: int) -> DataFrame:
    """``(row_key, doc_id, learn, tokens)``, stored: the keys of each text's tokens as binary.

    Rows whose ``learn`` is null hold words instead: both halves and how often training has them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, halves, times = _Words(), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)

        def flush() -> pd.DataFrame:
            # Half of the other half is enough to tell two words apart.
            table = np.column_stack([halves[:, 0] >> 32, halves[:, 1], times])
            blocks = [table[at : at + 50_000].tobytes() for at in range(0, len(table), 50_000)]
            return pd.DataFrame({"row_key": -1, "doc_id": NO_ID, "learn": None, "tokens": blocks})

        for frame in frames:
            sizes: list[int] = []

            def cut(text: str) -> list[bytes]:
                found = _with_end(text)
                sizes.append(len(found))
                return found

            found = itertools.chain.from_iterable(map(cut, frame["text"]))
            numbers = np.fromiter(map(words.__getitem__, found), np.int64)
            halves = np.concatenate([halves, words.halves(len(halves), salt)])
            learn = np.repeat(frame["learn"].to_numpy(dtype=bool), sizes)
            more = np.bincount(numbers[learn], minlength=len(words))
            more[: len(times)] += times
            times = more
            coded = np.split(halves[numbers, 1], np.cumsum(sizes)[:-1])
            yield frame.drop(columns="text").assign(tokens=[one.tobytes() for one in coded])
            if len(words) > _FLUSH_WORDS:
                yield flush()
                words, halves, times = _Words(), halves[:0], times[:0]
        if words:
            yield flush()
        words.clear()
        give_back()

    texts = documents.withColumn("row_key", F.monotonically_increasing_id())
    texts = texts.select("row_key", "doc_id", "learn", "text")
    return stored(texts.mapInPandas(run, "row_key long, doc_id long, learn boolean, tokens binary"))


def count_words(coded: DataFrame) -> DataFrame:
    """``(key, c, clash)``, stored: all words, how often training has them, and whether two share a key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame["tokens"]:
                yield pd.DataFrame(np.frombuffer(block, np.int64).reshape(-1, 3), columns=["other", "key", "c"])

    counted = coded.where("learn is null").select("tokens").mapInPandas(run, "other long, key long, c long")
    return stored(counted.groupBy("key").agg(F.sum("c").alias("c"), (F.min("other") != F.max("other")).alias("clash")))


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, tables are written small and shuffle files go when a query ends: each result is stored."""
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@dataclass
class Corpus:
    """Texts as keys, their words, and the salt of the keys."""

    coded: DataFrame
    vocabulary: DataFrame
    salt: int

    @property
    def texts(self) -> DataFrame:
        return self.coded.where("learn is not null")


def encode(documents: DataFrame, learn: Column | bool = True) -> Corpus:
    """All texts as keys; ``learn`` marks the rows that training may use (null: not)."""
    flag = learn if isinstance(learn, Column) else F.lit(learn)
    texts = documents.select(
        known_id(F.col("doc_id")).alias("doc_id"),
        clean_text(F.col("text")).alias("text"),
        F.coalesce(flag, F.lit(False)).alias("learn"),
    )
    for salt in itertools.count():
        with _tidy(documents.sparkSession):
            coded = encode_texts(texts, salt)
            vocabulary = count_words(coded)
        if vocabulary.where("clash").isEmpty():
            return Corpus(coded, vocabulary, salt)
        discard(coded, vocabulary)


@dataclass
class Filter:
    """A bit table of keys: says yes to every key it was made from, and to some others."""

    bits: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, key: str, most: int = FILTER_BITS, n: int | None = None) -> "Filter":
        """The table of the keys of ``table``; ``n`` is how many there are, if that is known."""
        size = min(1 << max(32 * (table.count() if n is None else n), 64).bit_length(), most)
        span = max(size >> 6, 64)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, n = [], 0

            def flush() -> pd.DataFrame:
                place = np.unique(np.concatenate(held))
                held.clear()
                return in_buckets(place // span, place)

            for frame in frames:
                keys = frame[key].to_numpy()
                held.extend((keys >> by) & np.int64(size - 1) for by in _PLACES)
                n += len(keys)
                if n > _FLUSH_PAIRS:
                    yield flush()
                    n = 0
            if n:
                yield flush()
            give_back()

        def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, on = None, np.zeros(span, dtype=bool)

            def flush() -> pd.DataFrame:
                return pd.DataFrame({"bucket": [now], "data": [np.packbits(on, bitorder="little").tobytes()]})

            for frame in frames:
                for bucket, n, data in zip(frame["bucket"], frame["size"], frame["data"]):
                    if bucket != now:
                        if now is not None:
                            yield flush()
                        now, on[:] = bucket, False
                    on[unpack(data, n, (np.int64,))[0] - bucket * span] = True
            if now is not None:
                yield flush()
            give_back()

        found = table.select(key).mapInPandas(run, "bucket int, size int, data binary")
        found = by_bucket(found, "bucket").mapInPandas(gather, "bucket int, data binary").toArrow()
        bits = np.zeros(size >> 6, dtype=np.int64)
        for bucket, data in zip(found.column("bucket").to_pylist(), found.column("data")):
            bits[bucket * span >> 6 : (bucket + 1) * span >> 6] = np.frombuffer(data.as_buffer(), np.int64)
        return cls(bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for by in _PLACES:
            place = (keys >> by) & np.int64(len(self.bits) * 64 - 1)
            found &= (self.bits[place >> 6] >> (place & 63)) & 1 == 1
        return found


@dataclass
class Piece:
    """Tokens of several texts, or part of a long one: keys, place in the text, and the text's number.

    Tokens that are there only as context have place -1.
    """

    x: np.ndarray
    place: np.ndarray
    owner: np.ndarray


def pieces(coded: list[bytes], depth: int, most: int = PIECE) -> Iterator[Piece]:
    """All tokens of some texts, about ``most`` at a time, each with ``depth`` tokens of context."""
    held, size = [], 0

    def joined() -> Piece:
        piece = Piece(*map(np.concatenate, zip(*held)))
        held.clear()
        return piece

    for owner, data in enumerate(coded):
        x = np.frombuffer(data, dtype=np.int64)
        for at in range(0, len(x), most):
            low = max(0, at - depth)
            part = x[low : at + most]
            place = np.arange(low, low + len(part))
            place[: at - low] = -1
            held.append((part, place, np.full(len(part), owner)))
            size += len(part)
            if size >= most:
                yield joined()
                size = 0
    if held:
        yield joined()


def batches(columns: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Rows of equally long columns, ``BATCH`` at a time."""
    for at in range(0, len(next(iter(columns.values()))), BATCH):
        yield pd.DataFrame({name: values[at : at + BATCH] for name, values in columns.items()})


def pack(*columns: np.ndarray) -> bytes:
    """Equally long columns in one binary: of the first the steps, which are small if it is in order.

    Of the steps and of short numbers the first bytes of all values come first, then the second ones: the high
    bytes are much the same.  Other columns have values that repeat, which are found as a whole.
    """
    steps = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    rows = [np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize) for column in (steps, *columns[1:])]
    data = [(row.T if not at or row.shape[1] < 8 else row).tobytes() for at, row in enumerate(rows)]
    return pa.compress(b"".join(data), codec="zstd", asbytes=True)


def unpack(data: bytes, size: int, kinds: tuple) -> list[np.ndarray]:
    """The inverse of :func:`pack`, for columns of ``size`` values."""
    raw = pa.decompress(data, size * sum(np.dtype(kind).itemsize for kind in kinds), codec="zstd")
    found, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        if found and width == 8:
            found.append(np.frombuffer(raw, kind, size, at))
        else:
            rows = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
            found.append(np.ascontiguousarray(rows).view(kind).reshape(size))
        at += size * width
    found[0] = np.cumsum(found[0], dtype=kinds[0])
    return found


def bucket_bits(n: int) -> int:
    """Bits of the number of a bucket, such that ``n`` keys give at most about ``BUCKET`` each."""
    return max(0, (max(n, 1) - 1) // BUCKET).bit_length()


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Number of each key's bucket: its first bits, so buckets are ranges of keys."""
    return (keys >> (64 - bits)) + (1 << (bits - 1)) if bits else np.zeros(len(keys), dtype=np.int64)


def in_buckets(bucket: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """``(bucket, size, data)`` of columns that are in order of their bucket."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    rows = [(bucket[a], b - a, pack(*(column[a:b] for column in columns))) for a, b in zip(cuts, cuts[1:])]
    return pd.DataFrame(rows, columns=["bucket", "size", "data"])


def by_bucket(packed: DataFrame, *order: str) -> DataFrame:
    """Packed rows, those with equal first column together and in order."""
    return packed.repartition(order[0]).sortWithinPartitions(*order)


def mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of some tokens from the keys of all but the last and of all but the first of them."""
    keys = first * _FACTORS[0] + last
    keys ^= keys >> 31
    return keys * _FACTORS[1]


def longer(keys: np.ndarray) -> np.ndarray:
    """Keys of the runs of tokens that end at each place, one longer; the first ones mean nothing."""
    return np.concatenate([keys[:1], mixed(keys[:-1], keys[1:])])


def runs(x: np.ndarray, length: int) -> np.ndarray:
    """Key of the ``length`` tokens that end at each place; the first ones mean nothing."""
    for _ in range(length - 1):
        x = longer(x)
    return x


def count_next(texts: DataFrame, candidates: Filter, lowers: Filter, length: int, bits: int) -> DataFrame:
    """``(pair, context, lower, n)``, stored: next words seen twice or more of contexts in the filter.

    ``pair`` is the key of context and next word, ``lower`` the same without the first word.  A
    pair is seen twice only if its lower one is.  Pairs are counted in ``2**bits`` buckets.
    """
    shared = texts.sparkSession.sparkContext.broadcast((candidates, lowers))

    def total(context: np.ndarray, lower: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Distinct pairs in order: key, context, lower and how often."""
        pair = mixed(context, lower)
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        n = np.diff(first, append=len(pair)) if n is None else np.add.reduceat(n[order], first, dtype=np.int64)
        at = order[first]
        return pair[first], context[at], lower[at], n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            pair, context, lower, n = total(*map(np.concatenate, zip(*held)))
            held.clear()
            bucket = bucket_of(pair, bits)
            # In order of contexts the pairs take less room.
            order = np.lexsort((context, bucket))
            return in_buckets(bucket, context[order], lower[order], n[order].astype(np.uint32))

        candidates, lowers = shared.value
        for frame in frames:
            for piece in pieces(frame["tokens"].tolist(), length):
                keys = runs(piece.x, length)
                at = np.flatnonzero(piece.place >= length)
                at = at[candidates.has(keys[at - 1])]
                at = at[lowers.has(keys[at])]
                held.append((keys[at - 1], keys[at]))
                size += len(at)
                if size > _FLUSH_PAIRS:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        give_back()

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                pair, context, lower, n = total(*map(np.concatenate, zip(*held)))
                held.clear()
                on = n >= 2
                yield from batches({"pair": pair[on], "context": context[on], "lower": lower[on], "n": n[on]})

        for frame in frames:
            for bucket, size, data in zip(frame["bucket"], frame["size"], frame["data"]):
                if bucket != now:
                    yield from flush()
                    now = bucket
                held.append(unpack(data, size, _PAIR))
        yield from flush()
        give_back()

    found = texts.select("tokens").mapInPandas(run, "bucket int, size int, data binary")
    found = stored(by_bucket(found, "bucket").mapInPandas(add_up, "pair long, context long, lower long, n long"))
    shared.destroy()
    return found


def retain(counted: DataFrame, candidates: DataFrame, shorter: DataFrame, bits: float) -> tuple[DataFrame, DataFrame]:
    """Stored: all listed pairs of the candidates, and the contexts that pass the divergence test.

    Pairs have ``pair, context, lower, n, shorter``, the last being P(word | shorter context);
    contexts have ``context, seen, rest``.
    """
    below = shorter.select(F.col("pair").alias("lower"), F.col("p").alias("shorter"))
    # Contexts that are in the filter by chance leave here.
    rows = stored(counted.join(candidates.select("context"), "context", "left_semi").join(below, "lower"))
    sums = rows.groupBy("context").agg(F.sum("n").alias("listed"), F.count(F.lit(1)).alias("kinds"))
    sums = sums.join(candidates, "context")
    sums = sums.withColumn("rest", F.lit(DISCOUNT) * F.col("kinds") + F.col("seen") - F.col("listed"))
    left = F.greatest(F.col("n") - 1 - DISCOUNT, F.lit(0.0)) + F.col("rest") * F.col("shorter")
    saved = F.col("n") * F.log2(left / (F.col("seen") * F.col("shorter")))
    gained = (
        rows.select("context", "n", "shorter")
        .join(sums, "context")
        .groupBy("context", "seen", "rest", "listed")
        .agg(F.sum(saved).alias("saved"))
    )
    # What is not listed costs the bits of the mass handed on.
    unlisted = (F.col("seen") - F.col("listed")) * F.log2(F.col("rest") / F.col("seen"))
    return rows, stored(gained.where(F.col("saved") + unlisted >= bits).select("context", "seen", "rest"))


def bounded_cut(table: DataFrame, value: str, most: int) -> tuple[int, int]:
    """The smallest power of two such that the rows with ``value`` at or above it are at most ``most``; rows below it."""
    level = F.floor(F.log2(F.greatest(F.col(value).cast("double"), F.lit(1.0)))).cast("int")
    found = {r.level: r["count"] for r in table.groupBy(level.alias("level")).count().collect()}
    total, cut = 0, 62
    for level in range(61, -1, -1):
        if total + found.get(level, 0) > most:
            break
        total += found.get(level, 0)
        cut = level
    return 1 << cut, sum(found.values()) - total


@dataclass
class SuffixTree:
    """Training tokens, distinct ones, contexts retained of each length, and the stored model.

    ``entries`` has ``key, times, c, score``: how often training uses a key, its count if it is a
    word (else 0), and what it adds to the score of a text, whose tokens begin as unseen words.
    """

    n: int
    v: int
    sizes: list[int]
    entries: DataFrame

    @property
    def unseen(self) -> tuple[float, float]:
        """Base and score of an unseen word in the empty context."""
        if not self.n:
            return 0.0, 0.0
        return math.log10(0.5 / (self.n + 0.5 * (self.v + 1))), math.log10(DISCOUNT * self.v / self.n)


def train(corpus: Corpus, bits: float = BITS, min_seen: int = MIN_SEEN, filter_bits: int = FILTER_BITS) -> SuffixTree:
    """The tree over the texts that training may use."""
    with _tidy(corpus.coded.sparkSession):
        return _grow(corpus, bits, min_seen, filter_bits)


def _grow(corpus: Corpus, bits: float, min_seen: int, filter_bits: int) -> SuffixTree:
    texts = corpus.texts.where("learn")
    words = corpus.vocabulary.where("c > 0")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    c = F.col("c")
    first = F.log10((c - DISCOUNT) / F.lit(DISCOUNT * sums.v if sums.v else 1.0))
    entries = words.select("key", c.alias("times"), "c", first.alias("score"))
    # The end token is never before another one.
    candidates = words.where((c >= min_seen) & (F.col("key") != _key(END, corpus.salt)))
    candidates = candidates.select(F.col("key").alias("context"), c.alias("seen"))
    shorter = words.select(F.col("key").alias("pair"), c.alias("n"), ((c - DISCOUNT) / F.lit(float(max(sums.n, 1)))).alias("p"))
    sizes: list[int] = []
    bits_of_pairs = bucket_bits(sums.n)
    while not candidates.isEmpty():
        lowers = Filter.of(shorter.where("n >= 2"), "pair", filter_bits)
        counted = count_next(texts, Filter.of(candidates, "context", filter_bits), lowers, len(sizes) + 1, bits_of_pairs)
        rows, contexts = retain(counted, candidates, shorter, bits)
        discard(counted)
        size = contexts.count()
        if not size:
            break
        sizes.append(size)
        handed = F.log10(F.col("rest") / F.col("seen"))
        pairs = rows.join(contexts, "context").withColumn(
            "p", (F.col("n") - DISCOUNT + F.col("rest") * F.col("shorter")) / F.col("seen")
        )
        gain = F.log10(F.col("p") / F.col("shorter")) - handed
        shorter = stored(pairs.select("pair", "n", "p", gain.alias("score")))
        key = F.col("context").bitwiseXOR(F.lit(int(_CONTEXT)))
        no_word = F.lit(0).cast("long").alias("c")
        entries = entries.unionByName(contexts.select(key.alias("key"), F.col("seen").alias("times"), no_word, handed.alias("score")))
        entries = entries.unionByName(shorter.select(F.col("pair").alias("key"), F.col("n").alias("times"), no_word, "score"))
        kept = contexts.select(F.col("context").alias("lower"))
        often = rows.where(F.col("n") >= min_seen).join(kept, "lower", "left_semi")
        candidates = stored(often.select(F.col("pair").alias("context"), F.col("n").alias("seen")))
        discard(rows)
    return SuffixTree(sums.n, sums.v, sizes, entries)


@dataclass
class _Shortcut:
    """What tasks hold of the model: the entries used most, sorted by key, and a filter of the others."""

    key: np.ndarray
    c: np.ndarray
    score: np.ndarray
    others: Filter
    depth: int

    def __post_init__(self) -> None:
        # Keys are spread evenly: their first bits nearly give the place.
        self.shift = max(64 - len(self.key).bit_length(), 1)
        edges = np.arange(1 << (64 - self.shift), dtype=np.int64) - (1 << (63 - self.shift))
        self.start = np.searchsorted(self.key, edges << self.shift).astype(np.int32)
        self.base = np.log10(2.0 * self.c + 1)

    @classmethod
    def of(cls, entries: DataFrame, others: Filter, depth: int) -> "_Shortcut":
        found = entries.select("key", "c", "score").toArrow()
        key, c, score = (found.column(name).to_numpy() for name in ("key", "c", "score"))
        order = np.argsort(key)
        # One key more, so that there always is one not below the key looked for.
        last = np.iinfo(np.int64).max
        return cls(np.append(key[order], last), np.append(c[order], 0), np.append(score[order], 0.0), others, depth)

    def __reduce__(self) -> tuple:
        return _Shortcut, (self.key, self.c, self.score, self.others, self.depth)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key (-1: not here), and whether it may be one of the others."""
        at = self.start[(keys >> self.shift) + (len(self.start) >> 1)].astype(np.int64)
        low = np.flatnonzero(self.key[at] < keys)
        while len(low):
            at[low] += 1
            low = low[self.key[at[low]] < keys[low]]
        at[self.key[at] != keys] = -1
        other = np.flatnonzero(at < 0)
        found = np.zeros(len(keys), dtype=bool)
        found[other] = self.others.has(keys[other])
        return at, found

    def terms(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Known words, base and score of each token, and the places and keys that the join must add."""
        known = np.zeros(len(piece.x), dtype=np.int64)
        base, score = np.zeros(len(piece.x)), np.zeros(len(piece.x))
        open_at, open_keys = [], []

        def add(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
            entry, other = self.find(keys)
            hit = entry >= 0
            where, entry = at[hit], entry[hit]
            known[where] += self.c[entry] > 0
            base[where] += self.base[entry]
            score[where] += self.score[entry]
            open_at.append(at[other])
            open_keys.append(keys[other])
            return hit | other

        at = np.flatnonzero(piece.place >= 0)
        add(at, piece.x[at])
        keys = piece.x
        for length in range(1, self.depth + 1):
            at = at[piece.place[at] >= length]
            if not len(at):
                break
            # A context is retained only if the shorter one is.
            at = at[add(at, keys[at - 1] ^ _CONTEXT)]
            pairs = longer(keys)
            add(at, pairs[at])
            keys = pairs
        return known, base, score, (np.concatenate(open_at), np.concatenate(open_keys))


def pack_entries(entries: DataFrame, bits: int) -> DataFrame:
    """``(bucket, size, data)``, stored: entries of the model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            key, c, score = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(key)
            return in_buckets(bucket_of(key[order], bits), key[order], c[order], score[order])

        for frame in frames:
            held.append([frame[name].to_numpy() for name in ("key", "c", "score")])
            size += len(frame)
            if size > _FLUSH_PAIRS:
                yield flush()
                size = 0
        if size:
            yield flush()
        give_back()

    return stored(entries.select("key", "c", "score").mapInPandas(run, "bucket int, size int, data binary"))


def open_blocks(texts: DataFrame, shared, unseen: tuple[float, float], bits: int) -> DataFrame:
    """Packed rows of blocks of texts: what tasks know of their scores, and the keys to look up."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, number = shared.value, itertools.count(TaskContext.get().partitionId() << 32)
        texts, wanted, size, n_texts = [], [], 0, 0

        def flush() -> pd.DataFrame:
            block = next(number)
            own = pack(*map(np.concatenate, zip(*texts)))
            keys, owner = map(np.concatenate, zip(*wanted))
            texts.clear()
            wanted.clear()
            # In order of keys, which is also that of buckets, they take less room.
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            rows = in_buckets(bucket_of(keys, bits), keys, owner.astype(np.uint32)).assign(kind=_KEYS)
            # The texts' own row is in some bucket, only to be spread.
            first = pd.DataFrame({"bucket": [block % (1 << bits)], "size": n_texts, "data": [own], "kind": _TEXTS})
            return pd.concat([first, rows]).assign(block=block)

        for frame in frames:
            ids = [frame[name].to_numpy() for name in ("row_key", "doc_id", "learn")]
            for piece in pieces(frame["tokens"].tolist(), model.depth):
                known, base, score, (at, keys) = model.terms(piece)
                n = np.bincount(piece.owner[piece.place >= 0])
                own = np.flatnonzero(n)
                sums = [np.bincount(piece.owner, each)[own] for each in (known, base, score)]
                row_key, doc_id, learn = (each[own] for each in ids)
                texts.append(
                    (
                        row_key, doc_id, learn.astype(bool), n[own], sums[0].astype(np.int64),
                        sums[1] + n[own] * unseen[0], sums[2] + n[own] * unseen[1],
                    )
                )
                wanted.append((keys, np.searchsorted(own, piece.owner[at]) + n_texts))
                n_texts += len(own)
                size += len(keys) + len(own)
                if size > _FLUSH_PAIRS:
                    yield flush()
                    size = n_texts = 0
        if n_texts:
            yield flush()
        give_back()

    return texts.mapInPandas(run, "bucket int, size int, data binary, kind int, block long")


def answer(rows: DataFrame) -> DataFrame:
    """Packed rows in buckets, the model's among them: per block what the keys found add to each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, model = None, [], None

        def found(size: int, data: bytes) -> tuple[int, bytes]:
            keys, owner = unpack(data, size, _WANTED)
            at = np.minimum(np.searchsorted(model[0], keys), len(model[0]) - 1)
            hit = np.flatnonzero(model[0][at] == keys)
            at, owner = at[hit], owner[hit]
            if not len(at):
                return 0, b""
            own = np.flatnonzero(np.bincount(owner)).astype(np.uint32)
            known, base, score = (np.bincount(owner, each[at])[own] for each in model[1:])
            return len(own), pack(own, known.astype(np.uint32), base, score)

        for frame in frames:
            out = []
            for bucket, kind, block, size, data in frame[["bucket", "kind", "block", "size", "data"]].itertuples(index=False):
                if bucket != now:
                    now, held, model = bucket, [], None
                if kind == _MODEL:
                    held.append(unpack(data, size, _ENTRY))
                elif kind == _TEXTS:
                    out.append((block, kind, size, data))
                elif held or model:
                    if model is None:
                        key, c, score = map(np.concatenate, zip(*held))
                        order, held = np.argsort(key), []
                        model = key[order], (c[order] > 0).astype(np.int64), np.log10(2.0 * c[order] + 1), score[order]
                    more, packed = found(size, data)
                    if more:
                        out.append((block, kind, more, packed))
            yield pd.DataFrame(out, columns=["block", "kind", "size", "data"])
        give_back()

    return by_bucket(rows, "bucket", "kind").mapInPandas(run, "block long, kind int, size int, data binary")


def close_blocks(rows: DataFrame) -> DataFrame:
    """``(row_key, doc_id, learn, n_tokens, n_known, base, score)`` of the texts of each block."""
    names = ["row_key", "doc_id", "learn", "n_tokens", "n_known", "base", "score"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[str, np.ndarray] = {}
        for frame in frames:
            for kind, size, data in zip(frame["kind"], frame["size"], frame["data"]):
                if kind == _TEXTS:
                    if texts:
                        yield from batches(texts)
                    texts = {name: each.copy() for name, each in zip(names, unpack(data, size, _TEXT))}
                else:
                    owner, *more = unpack(data, size, _ANSWER)
                    for name, each in zip(names[4:], more):
                        texts[name][owner] += each
        if texts:
            yield from batches(texts)
        give_back()

    schema = "row_key long, doc_id long, learn boolean, n_tokens long, n_known long, base double, score double"
    return by_bucket(rows, "block", "kind").mapInPandas(run, schema)


def score_texts(corpus: Corpus, tree: SuffixTree, shortcut: int = SHORTCUT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document row, stored: ``doc_id, learn, n_tokens, n_known, base_score, score``."""
    with _tidy(corpus.coded.sparkSession):
        return _score(corpus, tree, shortcut, filter_bits)


def _score(corpus: Corpus, tree: SuffixTree, shortcut: int, filter_bits: int) -> DataFrame:
    spark = corpus.coded.sparkSession
    cut, n_others = bounded_cut(tree.entries, "times", shortcut)
    often, others = tree.entries.where(F.col("times") >= cut), tree.entries.where(F.col("times") < cut)
    rest = Filter.of(others, "key", filter_bits, n_others)
    shared = spark.sparkContext.broadcast(_Shortcut.of(often, rest, len(tree.sizes)))
    bits = bucket_bits(n_others)
    packed = pack_entries(others, bits)
    model = packed.withColumns({"kind": F.lit(_MODEL), "block": F.lit(-1).cast("long")})
    n_tokens = corpus.texts.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0
    parts = min(PARTS, 1 + n_tokens // 8 // PART)

    found = []
    for part in range(parts):
        texts = corpus.texts.where(F.col("row_key") % parts == part)
        rows = open_blocks(texts, shared, tree.unseen, bits).unionByName(model)
        # A text that is longer than a piece may be in several blocks.
        sums = close_blocks(answer(rows)).groupBy("row_key").agg(
            F.max("doc_id").alias("doc_id"),
            F.max("learn").alias("learn"),
            *(F.sum(name).alias(name) for name in ("n_tokens", "n_known")),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        found.append(stored(sums.select(real_id("doc_id"), "learn", "n_tokens", "n_known", "base_score", "score")))
    discard(packed)
    shared.destroy()
    return functools.reduce(DataFrame.unionByName, found)
