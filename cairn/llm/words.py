"""Hashes of the words of many lines at once.

A word is a run of bytes between ASCII white space. Its code mixes its bytes eight at a time, all words of a slice of the text
together. A word of over LONG bytes has a polynomial of its bytes modulo 2^64 instead, mixed: prefix sums over the slice give
it without a loop over the word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that are hashed in one go, and characters of texts that are taken together.
SLICE, GROUP = 1 << 17, 1 << 20
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WHITE = re.compile(rb"[\x20\x09-\x0D]")
ODD = 0x9E3779B97F4A7C15  # the base, 2^64 by the golden ratio


def mixed(codes: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit codes in which each bit depends on all (two xor-shift and multiply rounds); one for each salt."""
    out = codes ^ np.uint64(salt * ODD & (2**64 - 1))
    for _ in range(2):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


BYTE = mixed(np.arange(256, dtype=np.uint64), 1)
LONG = 64
#: By number of bytes: the bits of so many bytes, and what tells words apart that end in zero bytes.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LENGTH = mixed(np.arange(LONG + 1, dtype=np.uint64), 2)


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])


UP, DOWN = powers(ODD, SLICE), powers(pow(ODD, -1, 2**64), SLICE)


def slices(data: bytes) -> Iterator[bytes]:
    """data cut at white space into pieces of about SLICE bytes; a longer word makes a longer piece."""
    at = 0
    while len(data) - at > SLICE:
        cut = data.rfind(b" ", at, at + SLICE) + 1
        if not cut and len(white := np.flatnonzero(SPACE[np.frombuffer(data, np.uint8, SLICE, at)])):
            cut = at + int(white[-1]) + 1
        if not cut:
            found = WHITE.search(data, at)
            cut = found.end() if found else len(data)
        yield data[at:cut]
        at = cut
    if at < len(data):
        yield data[at:]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, number of the line that it stands in)."""
    codes, lines, line = [], [], 0
    for part in slices(data):
        padded = part + bytes(8)
        a = np.frombuffer(padded, dtype=np.uint8, count=len(part))
        space = np.ones(len(a) + 2, dtype=bool)
        space[1:-1] = SPACE[a]
        edge = np.flatnonzero(space[1:] != space[:-1])
        begin, end = edge[::2], edge[1::2]
        size = end - begin
        eight = np.ndarray(len(a), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        code = mixed(eight[begin] & FIRST[np.minimum(size, 8)] ^ LENGTH[np.minimum(size, LONG)], 1)
        more, at = np.flatnonzero(size > 8), 8
        while len(more) and at < LONG:
            code[more] = mixed(code[more] ^ eight[begin[more] + at] & FIRST[np.minimum(size[more] - at, 8)], 3)
            at += 8
            more = more[size[more] > at]
        if len(more):
            up, down = (UP, DOWN) if len(a) <= SLICE else (powers(ODD, len(a)), powers(pow(ODD, -1, 2**64), len(a)))
            total = np.zeros(len(a) + 1, dtype=np.uint64)
            np.cumsum(BYTE[a] * up[: len(a)], out=total[1:])
            code[more] = mixed((total[end[more]] - total[begin[more]]) * down[begin[more]])
        codes.append(code)
        ends = np.flatnonzero(a == 10)
        before = np.searchsorted(begin, ends)  # words before each end of a line
        lines.append(np.repeat(np.arange(line, line + len(ends) + 1), np.diff(before, prepend=0, append=len(begin))))
        line += len(ends)
    if not codes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(codes), np.concatenate(lines)


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts, some together: about GROUP characters or one longer text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


#: Lower-case letters of U+0000 to U+00FF, all of them in that range again.
LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")


def lower_bytes(texts: list[str]) -> bytes:
    """The lower-cased texts, one a line, in UTF-8. Up to U+00FF a table does it, which takes a fraction of the time."""
    try:
        return "\n".join(texts).encode("latin-1").translate(LOWER).decode("latin-1").encode()
    except UnicodeEncodeError:
        return "\n".join(t.lower() for t in texts).encode("utf-8", "surrogatepass")
