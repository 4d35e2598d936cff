"""Byte-level BPE over whole Arrow batches.

A batch's texts are cut into pre-tokens with array operations over code points. Each pre-token is looked up in a memo:
an open-addressing table whose keys are the pre-token's own bytes (up to 15 of them packed in two words, so a hit is
exact), or a dictionary for longer ones. Only a pre-token that the memo lacks is merged: a priority queue of merge
ranks over a doubly linked list of symbols, in which entries that no longer fit are skipped. A pre-token as long as a
text (an endless run of one class) is merged part by part; the parts are right if their ends fit, which is checked.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

TOKENIZERS = "/opt/tokenizers"
BLOCK = 1 << 20
STEP = 1 << 16
MEMO = 1 << 20
#: Pre-tokens beyond LONG bytes are merged in parts of about PART bytes; where a part may not end at a hard place, it ends
#: a multiple of UNIT bytes from the pre-token's begin, which suits tokens of one sign repeated 2^k or 3 times 2^k times.
LONG = 1 << 15
PART = 1 << 12
UNIT = 384
LETTER, NUMBER, SPACE, BLANK, OTHER = range(5)
# The code points with Unicode's White_Space property, as ranges.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_U = np.uint64


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    c = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        c[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    for a, b in WHITE:
        c[a : b + 1] = SPACE
    c[32] = BLANK
    return c


def starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token. first: which begin a text.

    Pre-tokens are runs of letters, of digits or of other signs, each with one blank before it if there is one; runs
    of white space, without the last character if something follows; and, where a pre-token begins with an apostrophe,
    's 't 'm 'd 're 've 'll.
    """
    n = len(cp)
    c = classes()[cp]
    white = (c == SPACE) | (c == BLANK)
    g = np.where(white, SPACE, c)
    new = np.ones(n, bool)
    new[1:] = (g[1:] != g[:-1]) | first[1:]
    # the last white character before something else of the same text
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])
    new[last] = True
    new[last[c[last] == BLANK] + 1] = False
    q = np.flatnonzero((cp[:-1] == 39) & new[:-1] & (g[1:] == LETTER) & ~first[1:])
    if len(q):
        a = cp[q + 1]
        far = np.minimum(q + 2, n - 1)
        b = np.where((q + 2 < n) & ~first[far], cp[far], 0)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for at, k in ((q[one], 2), (q[two], 3)):
            for j in range(1, k):
                new[at + j] = False
            end = at + k
            new[end[end < n]] = True
    return new


def safe_cut(data: np.ndarray, at: int, end: int) -> int:
    """The first position from `at` on where a pre-token begins whatever stands before: a visible ASCII sign after a
    line feed, or a blank between two of them; else `end`."""
    while at < end - 1:
        w = data[at - 1 : min(at + BLOCK, end)].astype(np.int16)
        seen = (w > 32) & (w < 127)
        ok = (w[:-2] == 10) & seen[1:-1]
        ok |= seen[:-2] & (w[1:-1] == 32) & seen[2:]
        hit = np.flatnonzero(ok)
        if len(hit):
            return at + int(hit[0])
        at += len(w) - 2 if len(w) > 2 else 2
    return end


class ByteBPE:
    """Encoder for a vocabulary file of base64 tokens and ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = {b: a for a, b in self.ranks.items()}
        self.width = np.zeros(max(self.vocab) + 1, np.int32)
        for i, t in self.vocab.items():
            self.width[i] = len(t)
        # which two bytes stand side by side within a token: no merge ever crosses between two others
        self.joins = np.zeros((256, 256), bool)
        flat = np.frombuffer(b"".join(self.vocab.values()), np.uint8)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum([len(t) for t in self.vocab.values()]) - 1] = False
        at = np.flatnonzero(inner)
        self.joins[flat[at], flat[at + 1]] = True
        self._clear(1 << 16)

    # memo

    def _clear(self, size: int) -> None:
        self.size, self.bits = size, _U(64 - (size.bit_length() - 1))
        self.k1, self.k2, self.slot = np.zeros(size, _U), np.zeros(size, _U), np.full(size, -1, np.int32)
        self.off, self.cnt, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.flat, self.end = np.zeros(4096, np.int32), 0
        self.long: dict[bytes, int] = {}

    def _hash(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = (k1 ^ (k2 * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        return (h * _U(0xD6E8FEB86659FD93)) >> self.bits

    def _add(self, piece: bytes) -> int:
        ids = self.merge(piece)
        if self.used == len(self.off):
            self.off, self.cnt = np.resize(self.off, 2 * self.used), np.resize(self.cnt, 2 * self.used)
        while self.end + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.end : self.end + len(ids)] = ids
        self.off[self.used], self.cnt[self.used] = self.end, len(ids)
        self.end += len(ids)
        self.used += 1
        return self.used - 1

    def _grow(self) -> None:
        k1, k2, slot = self.k1, self.k2, self.slot
        self.size *= 2
        self.bits = _U(64 - (self.size.bit_length() - 1))
        self.k1, self.k2, self.slot = np.zeros(self.size, _U), np.zeros(self.size, _U), np.full(self.size, -1, np.int32)
        full = np.flatnonzero(slot >= 0)
        for a, b, e in zip(k1[full], k2[full], slot[full]):
            self._put(a, b, e)

    def _put(self, a: np.uint64, b: np.uint64, e: int) -> None:
        with np.errstate(over="ignore"):
            i = int(self._hash(np.array([a]), np.array([b]))[0])
        while self.slot[i] >= 0:
            i = (i + 1) & (self.size - 1)
        self.k1[i], self.k2[i], self.slot[i] = a, b, e

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:  # also where merges alone would not lead to it
            return [whole]
        if len(piece) > LONG and (got := self._in_parts(piece)) is not None:
            return got
        return self._at_once(piece)

    def _at_once(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            k = nxt[i]
            if end[i] == 0 or k >= n or end[k] != j:
                continue  # stale: one of the two has been merged meanwhile
            end[i], end[k] = j, 0
            nxt[i] = m = nxt[k]
            if m < n:
                prv[m] = i
                if (r := ranks.get(piece[i : end[m]])) is not None:
                    heapq.heappush(heap, (r, i, end[m]))
            if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:j])) is not None:
                heapq.heappush(heap, (r, p, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens may stand side by side within a pre-token. A list of tokens is the encoding of its bytes if
        and only if all neighbours may."""
        return self.merge(self.vocab[a] + self.vocab[b]) == [a, b]

    def _in_parts(self, piece: bytes) -> list[int] | None:
        """The ids of a long pre-token from those of its parts, or None if two parts' ends do not fit."""
        data = np.frombuffer(piece, np.uint8)
        hard = np.flatnonzero(~self.joins[data[:-1], data[1:]]) + 1
        out: list[int] = []
        lo = 0
        while lo < len(piece):
            k = np.searchsorted(hard, lo + PART)
            hi = int(hard[k]) if k < len(hard) else len(piece)
            if hi - lo > 2 * PART:
                hi = lo + PART + -(lo + PART) % UNIT
            ids = self._at_once(piece[lo:hi])
            if out and not self.fit(out[-1], ids[0]):
                return None
            out += ids
            lo = hi
        return out

    def _entries(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The memo's entry of each pre-token. data: with 16 bytes to spare at its end."""
        word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        out = np.empty(len(at), np.int64)
        full = _U(0xFFFFFFFFFFFFFFFF)
        for lo in range(0, len(at), STEP):
            a, z = at[lo : lo + STEP], size[lo : lo + STEP]
            z8 = np.minimum(z, 8).astype(_U) * _U(8)
            k1 = word[a] & np.where(z8 == 64, full, (_U(1) << (z8 & _U(63))) - _U(1))
            rest = np.clip(z - 8, 0, 7).astype(_U) * _U(8)
            k2 = np.where(rest > 0, word[np.minimum(a + 8, len(word) - 1)] & ((_U(1) << rest) - _U(1)), _U(0)) | (np.minimum(z, 255).astype(_U) << _U(56))
            i = self._hash(k1, k2).astype(np.int64)
            e = self.slot[i].astype(np.int64)
            todo = np.flatnonzero((e >= 0) & ((self.k1[i] != k1) | (self.k2[i] != k2)))
            while len(todo):
                i[todo] = (i[todo] + 1) & (self.size - 1)
                e[todo] = self.slot[i[todo]]
                todo = todo[(e[todo] >= 0) & ((self.k1[i[todo]] != k1[todo]) | (self.k2[i[todo]] != k2[todo]))]
            e[z > 15] = -1
            for m in np.flatnonzero(e < 0).tolist():
                piece = data[a[m] : a[m] + z[m]].tobytes()
                got = self.long.get(piece)
                if got is None:
                    got = self.long[piece] = self._add(piece)
                    if z[m] <= 15:
                        self._put(k1[m], k2[m], got)
                e[m] = got
            out[lo : lo + STEP] = e
            if 2 * self.used > self.size:
                self._grow()
        return out

    # texts

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Parts of the texts that lie one after the other in data between offsets: (place in data, bytes, code points,
        characters at which pre-tokens begin, their place in bytes, end in bytes). Parts are about BLOCK bytes, cut
        between texts or, in long texts, where pre-tokens begin anyway."""
        lo, stop, k, n = int(offsets[0]), int(offsets[-1]), 0, len(offsets) - 1
        while lo < stop:
            if self.used > MEMO:
                self._clear(1 << 16)
            # the last text boundary within reach, else a place within the text
            k = int(np.searchsorted(offsets, lo + BLOCK, "right")) - 1
            hi = int(offsets[k])
            soft = hi <= lo
            if soft:
                end = int(offsets[np.searchsorted(offsets, lo, "right")])
                hi = safe_cut(data, lo + BLOCK, end) if lo + BLOCK < end else end
                soft = hi < end
            part = np.zeros(hi - lo + soft + 16, np.uint8)
            part[: hi - lo + soft] = data[lo : hi + soft]
            size = hi - lo + soft
            cp = np.frombuffer(part[:size].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            first = np.zeros(len(cp), bool)
            inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "left")] - lo
            if len(cp) == size:
                first[inner[inner < size]] = True
                chars = np.flatnonzero(starts(cp, first))
                at = chars
            else:
                place = np.empty(len(cp) + 1, np.int64)
                place[0] = 0
                np.cumsum(1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF), out=place[1:])
                first[np.searchsorted(place, inner[inner < size])] = True
                chars = np.flatnonzero(starts(cp, first))
                at = place[chars]
            if soft:
                chars, at = chars[:-1], at[:-1]
            yield lo, part, cp, chars, at, hi - lo
            lo = hi

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of each pre-token in data, memo offset, count of ids) by block; the memo is valid until the next."""
        for lo, part, _, _, at, end in self.blocks(data, offsets):
            e = self._entries(part, at, np.diff(at, append=end))
            yield at + lo, self.off[e], self.cnt[e]

    def ids_of(self, off: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        total = int(cnt.sum())
        ends = np.cumsum(cnt)
        return self.flat[np.repeat(off - (ends - cnt), cnt) + np.arange(total)]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for at, _, cnt in self.tokens(data, offsets):
            # texts without bytes hold no pre-token: side="right" finds the text that has bytes
            out += np.bincount(np.searchsorted(offsets, at, "right") - 1, weights=cnt, minlength=len(out)).astype(np.int64)
        return out

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text in them."""
        ids, n = [], np.zeros(len(offsets) - 1, np.int64)
        for at, off, cnt in self.tokens(data, offsets):
            ids.append(self.ids_of(off, cnt))
            n += np.bincount(np.searchsorted(offsets, at, "right") - 1, weights=cnt, minlength=len(n)).astype(np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(n)])

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.encode_batch(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no text become replacement characters."""
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", "replace")


@lru_cache(4)
def encoder(name: str, folder: str = TOKENIZERS) -> ByteBPE:
    """One encoder per worker process and vocabulary."""
    return ByteBPE(os.path.join(folder, f"{name}.tiktoken"))


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null is as good as empty. Values that are no valid
    UTF-8 get replacement characters."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    try:
        col.validate(full=True)
    except pa.ArrowInvalid:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:])]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return data, off


def slices(off: np.ndarray, most: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, at least one text each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j
