"""Fingerprints of many texts at once: numpy over a buffer of concatenated UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes worked on at a time; longer texts are cut into overlapping pieces.
BUFFER = 1 << 19
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: A random 64-bit number for each byte value.
BYTE_IDS = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One identifier for the pair of identifiers ``(a, b)``."""
    x = a * _M1 + b
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    done, best = 1, x
    while 2 * done <= width:
        best = pick(best[:-done], best[done:])
        done *= 2
    rest = width - done
    return pick(best[: len(best) - rest], best[rest:]) if rest else best


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@dataclass
class Pieces:
    """Texts, or pieces of them, one after the other in ``data``."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    bases: np.ndarray
    lengths: np.ndarray


def pieces(texts: Iterable[bytes], overlap: int = 0, buffer: int = BUFFER) -> Iterator[Pieces]:
    """Cut ``texts`` into buffers; pieces of one text share ``overlap`` bytes with the next."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def pack() -> Pieces:
        lengths = np.array([len(part) for _, _, part in held], dtype=np.int64)
        return Pieces(
            np.frombuffer(b"".join(part for _, _, part in held), dtype=np.uint8),
            np.array([row for row, _, _ in held], dtype=np.int64),
            np.cumsum(lengths) - lengths,
            np.array([base for _, base, _ in held], dtype=np.int64),
            lengths,
        )

    for row, text in enumerate(texts):
        for base in range(0, max(1, len(text) - overlap), buffer):
            part = text[base : base + buffer + overlap]
            held.append((row, base, part))
            size += len(part)
            if size >= buffer:
                yield pack()
                held, size = [], 0
    if held:
        yield pack()
