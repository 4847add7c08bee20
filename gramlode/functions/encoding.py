"""Byte-level encodings of the index and of queries; all of this runs on the driver, on query constants."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

GRAM = 4


def gram_key(gram: bytes) -> int:
    """The number of a gram: its bytes read as a big-endian integer."""
    return int.from_bytes(gram, "big")


def grams(text: bytes | str, size: int = GRAM) -> set[int]:
    """Keys of all grams of `text`; none if it is shorter than a gram."""
    raw = text.encode() if isinstance(text, str) else text
    return {gram_key(raw[i : i + size]) for i in range(len(raw) - size + 1)}


def widen(text: bytes) -> bytes:
    """The text with a zero byte after each byte."""
    return bytes(x for b in text for x in (b, 0))


def lower_ascii(text: bytes) -> bytes:
    return text.lower()


def case_variants(gram: bytes) -> set[bytes]:
    """All spellings of a gram whose ASCII letters may be of either case."""
    out = {b""}
    for b in gram:
        both = {bytes([b]).lower(), bytes([b]).upper()}
        out = {x + c for x in out for c in both}
    return out


def varint(values: Iterable[int]) -> bytes:
    """Numbers in groups of seven bits, lowest first; the high bit says that more follow."""
    out = bytearray()
    for n in values:
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
    return bytes(out)


def unvarint(data: bytes) -> Iterator[int]:
    n = shift = 0
    for b in data:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            yield n
            n = shift = 0


def deltas(fids: Iterable[int]) -> list[int]:
    """Ascending ids as the first one and the steps between them."""
    out, before = [], 0
    for f in fids:
        out.append(f - before)
        before = f
    return out


def undelta(steps: Iterable[int]) -> list[int]:
    out, at = [], 0
    for s in steps:
        at += s
        out.append(at)
    return out


def _sieve(n: int) -> bytearray:
    is_prime = bytearray([1]) * (n + 1)
    is_prime[:2] = b"\0\0"
    for i in range(2, int(n**0.5) + 1):
        if is_prime[i]:
            is_prime[i * i :: i] = bytes(len(range(i * i, n + 1, i)))
    return is_prime


def prime(n: int) -> bool:
    if n < 4:
        return n > 1
    return n % 2 == 1 and all(n % i for i in range(3, int(n**0.5) + 1, 2))


@lru_cache
def query_primes(width: int) -> tuple[int, ...]:
    """The 256 largest primes below 2**width, ascending (fewer if there are fewer)."""
    if not 2 <= width <= 32:
        raise ValueError("a group width is between 2 and 32")
    out, n = [], (1 << width) - 1
    if width <= 22:
        table = _sieve(n)
        out = [k for k in range(n, 1, -1) if table[k]][:256]
    else:
        while len(out) < 256:
            if prime(n):
                out.append(n)
            n -= 1
    return tuple(sorted(out))


# The first prime of a grouped index for the widths below 12.
FIRST_PRIME = {8: 191, 9: 383, 10: 757, 11: 1511}


@lru_cache
def build_primes(width: int) -> tuple[int, ...]:
    """Primes for a grouped index: those of `query_primes` from three quarters of 2**width on (FIRST_PRIME below 12).

    Narrow widths have fewer than 256 of these; the last byte of a gram picks one by its remainder.
    """
    if not 8 <= width <= 32:
        raise ValueError("a grouped index has a width between 8 and 32")
    least = FIRST_PRIME.get(width, 3 * (1 << width) // 4)
    return tuple(p for p in query_primes(width) if p >= least)
