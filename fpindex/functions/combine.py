"""Checksums of a whole from those of its parts.

adler32 and crc32 are sums and remainders, so parts of a content can be read
by different tasks. The sha and md5 families have no such rule.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from typing import NamedTuple

from fpindex.functions.digests import crc32_hex, reversed_bits

# Modulus of adler32; the polynomial of CRC-32, lowest power in the highest bit.
_ADLER, _POLYNOMIAL = 65521, 0xEDB88320
_ONE, _BYTE = 1 << 31, 1 << 23  # the polynomials 1 and x^8


class Part(NamedTuple):
    """Checksums and length of a run of bytes; ``crc`` is that of the bytes with their bits reversed."""

    adler: int
    crc: int
    length: int


EMPTY = Part(1, 0, 0)


def part_of(chunks: Iterable[bytes]) -> Part:
    """Checksums of some bytes that arrive in chunks."""
    adler, crc, length = EMPTY
    for chunk in chunks:
        adler, crc = zlib.adler32(chunk, adler), zlib.crc32(reversed_bits(chunk), crc)
        length += len(chunk)
    return Part(adler, crc, length)


def _product(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo that of CRC-32."""
    total = 0
    for power in range(31, -1, -1):
        if a >> power & 1:
            total ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return total


def _behind(crc: int, length: int) -> int:
    """What a CRC adds to that of a whole in which so many bytes follow."""
    shift, square = _ONE, _BYTE
    while length:
        if length & 1:
            shift = _product(shift, square)
        square, length = _product(square, square), length >> 1
    return _product(shift, crc)


def joined(first: Part, second: Part) -> Part:
    """Checksums of the bytes of ``first`` and then those of ``second``."""
    low = (first.adler & 0xFFFF) + (second.adler & 0xFFFF) - 1
    high = (first.adler >> 16) + (second.adler >> 16) + ((first.adler & 0xFFFF) - 1) * second.length
    adler = high % _ADLER << 16 | low % _ADLER
    return Part(adler, _behind(first.crc, second.length) ^ second.crc, first.length + second.length)


def hex_checksums(part: Part) -> dict[str, str]:
    """The digests as they are stored."""
    return {"adler32": f"{part.adler:08x}", "crc32": crc32_hex(part.crc)}
