"""Splitting oversized texts at natural boundaries.

A long text's bytes are cut into ranges in one pass: a range ends, within a halo behind its nominal end, where a
pre-token begins whatever stands before. Within an endless run of one class there is no such place; there a range ends
between two bytes that no token holds side by side, so that no merge crosses, or, where there are none either (one sign
without end), at a place that is checked afterwards: the two tokens that meet must be what the encoder makes of both
together. So the ranges' tokens are those of the whole. A range yields its boundary table: of each token its characters
and the kind of boundary after it. The tables of one text are stitched in order as they stream by, sums of lengths give
positions, cuts are chosen, and pieces are emitted by offset from the ranges they touch; only there the characters are
read again. What is held of a text is a window of some pieces. A text of one range needs no stitching and leaves its
task as pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import BLANK, LETTER, SPACE, TOKENIZERS, UNIT, ByteBPE, classes, encoder, raw, slices
from tidemark.session import materialize

RANGE = 1 << 16
HALO = 1 << 12
#: Kinds of boundaries, the natural ones first; PART lies within a character.
KINDS = ["part", "token", "pre_token", "word", "sentence", "line", "cue"]
PART, TOKEN, PRE, WORD, SENTENCE, LINE, CUE = range(7)
# Signs that end a sentence, those that need no white space after them, signs that may follow an end.
ENDS = ".!?…։؟۔।॥。．！？｡"
FULL = "。．！？｡।॥"
CLOSE = "\"'”’»)]}›」』）"
LINES = [0x0A, 0x0B, 0x0C, 0x85, 0x2028, 0x2029]
#: How sure it is that a range's end is an end of a token.
SURE, HARD, SOFT = range(3)


def _among(values: list[int]) -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[values] = True
    return t


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        c = classes()
        _TABLES.update(white=(c == 2) | (c == 3), line=_among(LINES), ends=_among([ord(x) for x in ENDS]), full=_among([ord(x) for x in FULL]), close=_among([ord(x) for x in CLOSE]))
    return _TABLES


def _kinds(cp: np.ndarray, at: np.ndarray, more: int) -> np.ndarray:
    """The kind of boundary before the characters `at`, which begin pre-tokens. more: the character after the last."""
    t, n = _tables(), len(cp)
    white = t["white"][cp]
    after = np.append(cp[1:], more)
    line = t["line"][cp] | ((cp == 13) & (after != 10))
    lines = np.concatenate([[0], np.cumsum(line)])
    solid = np.maximum.accumulate(np.where(white, -1, np.arange(n)))  # last character that is not white, up to here
    before = np.maximum(at - 1, 0)
    last = np.where(at > 0, solid[before], -1)
    breaks = lines[at] - lines[last + 1]
    here = np.where(at < n, cp[np.minimum(at, n - 1)], more)
    here_white = t["white"][here]
    gap = here_white | (last < at - 1)
    out = np.full(len(at), PRE, np.uint8)
    out[gap] = WORD
    # a sign that ends a sentence, with at most two closing signs after it
    e = last.copy()
    for _ in range(2):
        e = np.where((e > 0) & t["close"][cp[np.maximum(e, 0)]], e - 1, e)
    end = cp[np.maximum(e, 0)]
    out[(e >= 0) & t["ends"][end] & (gap | t["full"][end])] = SENTENCE
    out[breaks > 0] = LINE
    out[(breaks > 1) | ((breaks > 0) & (here == 123))] = CUE  # a blank line; or a frame mark {n}{m}
    return out


def boundaries(enc: ByteBPE, data: np.ndarray, off: np.ndarray, least: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, bytes, end of each token in bytes from the text's start, kind of boundary after it) for each part of each
    text, in order. Long texts come in several parts. A text of at most `least` tokens needs no cut: kinds are not told
    apart there."""
    for lo, part, cp, chars, at, size in enc.blocks(data, off):
        e = enc._entries(part, at, np.diff(at, append=size))
        cnt = enc.cnt[e]
        ids = enc.ids_of(enc.off[e], cnt)
        ends = np.cumsum(enc.width[ids])  # in bytes from the block's start
        lead = np.ones(size + 1, bool)
        lead[:size] = (part[:size] & 0xC0) != 0x80
        kind = np.where(lead[ends], TOKEN, PART).astype(np.uint8)
        last = np.cumsum(cnt) - 1
        # a block may hold many texts; white space at a text's end must not be looked through from the next text
        text = np.searchsorted(off, at + lo, "right") - 1
        new = np.r_[True, text[1:] != text[:-1]]
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(at))
        for a, b in zip(first.tolist(), stop.tolist()):
            t0, t1 = (int(last[a - 1]) + 1 if a else 0), int(last[b - 1]) + 1
            b0, x = int(at[a]), int(text[a])
            kinds = kind[t0:t1].copy()
            if t1 - t0 > least or off[x] < lo + b0 or off[x + 1] > lo + size:  # more than that, or not the whole text
                c0 = int(chars[a])
                c1 = int(chars[b]) if b < len(at) else len(cp)
                own = cp[c0:c1]
                where = np.append(chars[a + 1 : b], c1) - c0
                kinds[last[a:b] - t0] = _kinds(own, where, 0)
            yield x, lo + b0 - int(off[x]), ends[t0:t1] - b0, kinds


def one_cut(kind: np.ndarray, base: int, s: int, done: int, most: int, overlap: int) -> tuple[int, int, int]:
    """(end, its kind, begin of the next) of the piece that begins at token s, where more than `most` tokens are left.
    kind: of the boundary after each token from number base on; done: the end of the piece before."""
    lo = max(done, s + overlap)  # the end lies in (lo, s + most]
    w = kind[lo - base : s + most - base]
    best = w.max()
    e = lo + len(w) - int(np.argmax(w[::-1] == best))
    nxt = e - overlap
    while nxt > 0 and kind[nxt - 1 - base] == PART:
        nxt -= 1
    return e, int(best), nxt


def cuts(kind: np.ndarray, most: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, end, kind of the boundary at the end) of each piece. kind: of the boundary after each token.

    A piece ends at the last boundary of the best kind within reach. The next one begins `overlap` tokens before that
    end or, where that would be within a character, at the last token before it that begins with a character: mostly up
    to three more, but tokens that hold ends of two characters may follow each other for longer."""
    out, s, done, n = [], 0, 0, len(kind)
    while n - s > most:
        e, best, nxt = one_cut(kind, 0, s, done, most, overlap)
        out.append((s, e, best))
        done, s = e, nxt
    out.append((s, n, CUE))
    return out


def next_cut(enc: ByteBPE, data: np.ndarray, lo: int, at: int, end: int, halo: int, left: int) -> tuple[int, int]:
    """Where a range from lo may end, from `at` on, and how sure that is. White space is never cut through: the search
    goes on behind it. left: how sure lo was."""
    view = max(halo, 2 * UNIT)
    while at < end:
        a, z = max(lo, at - 8), min(end, at + view + 16)
        while a > lo and (data[a] & 0xC0) == 0x80:
            a -= 1
        while z < end and (data[z] & 0xC0) == 0x80:
            z += 1
        cp = np.frombuffer(data[a:z].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = a + np.concatenate([[0], np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF))])
        c = classes()[cp]
        if len(c) < 4:
            return end, SURE
        # of characters 1 to n - 3: the class before, here, and of the two behind
        p, h, n1, n2, where = c[:-3], c[1:-2], c[2:-1], c[3:], place[1 : len(c) - 2]
        dark = lambda v: (v != SPACE) & (v != BLANK)
        ok = dark(p) & dark(h) & (p != h) & (cp[:-3] != 39)  # another class begins, but not behind an apostrophe
        ok |= dark(p) & (h == BLANK) & dark(n1)
        ok |= (p == SPACE) & dark(h)
        ok &= where >= at
        if ok.any():
            return int(where[np.argmax(ok)]), SURE
        run = dark(h) & (p == h) & (h == n1) & (h == n2) & (where >= at)
        hard = run & ~enc.joins[data[where - 1], data[where]]
        if hard.any():
            return int(where[np.argmax(hard)]), HARD
        if run.any():
            own = np.frombuffer(data[lo:z].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            kind = classes()[own]
            new = np.r_[True, kind[1:] != kind[:-1]]
            begin = lo + np.concatenate([[0], np.cumsum(1 + (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF))])[:-1][new]
            soft = run & ((where - begin[np.searchsorted(begin, where, "right") - 1]) % UNIT == 0)
            if soft.any():
                return int(where[np.argmax(soft)]), SOFT
        at += view
    return end, SURE


class Stitcher:
    """The boundary tables of one text, fed in order: keeps the tokens from the last piece's begin on."""

    def __init__(self, enc: ByteBPE, row: int, most: int, overlap: int) -> None:
        self.enc, self.row, self.most, self.overlap = enc, row, most, overlap
        self.kinds, self.edge = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.base = self.s = self.done = self.k = 0  # base: the number of the first token that is kept
        self.spans: list[tuple[int, int, int]] = []
        self.last_id, self.torn = -1, False

    def _piece(self, s: int, e: int, cut: str) -> Iterator[tuple]:
        a, z = int(self.edge[s - self.base]), int(self.edge[e - self.base])
        for no, lo, hi in self.spans:
            f, t = max(a, lo), min(z, hi)
            if f < t:
                yield self.k, a, z, s, e, cut, no, f - lo, t - f
        self.k += 1

    def feed(self, r: dict) -> Iterator[tuple]:
        """(piece_no, char_start, char_end, token_start, token_end, cut, range_no, from, length) for each range that a
        piece touches; piece_no -1 if the ranges do not fit together."""
        if self.torn:
            return
        if r["left_end"] == SOFT and not self.enc.fit(self.last_id, r["first_id"]):
            self.torn = True
            yield -1, 0, 0, 0, 0, "", 0, 0, 0
            return
        self.last_id = r["last_id"]
        self.kinds = np.concatenate([self.kinds, np.frombuffer(r["kinds"], np.uint8)])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(np.frombuffer(r["chars"], "<u2").astype(np.int64))])
        self.spans.append((r["range_no"], r["char_start"], r["char_start"] + r["n_chars"]))
        n = self.base + len(self.kinds)
        while n - self.s > self.most:
            e, kind, s = one_cut(self.kinds, self.base, self.s, self.done, self.most, self.overlap)
            yield from self._piece(self.s, e, KINDS[kind])
            self.done, self.s = e, s
        if r["last"]:
            yield from self._piece(self.s, n, "end")
            return
        drop = max(self.s - 4 - self.base, 0)
        self.kinds, self.edge, self.base = self.kinds[drop:], self.edge[drop:], self.base + drop
        self.spans = [x for x in self.spans if x[2] > self.edge[0]]


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


PIECE = "piece_no int, char_start bigint, char_end bigint, token_start bigint, token_end bigint, cut string"


def split(df: DataFrame, id_col: str, text_col: str, most: int, overlap: int, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, reach: int = RANGE, halo: int = HALO) -> DataFrame:
    """(id, piece_no, char_start, char_end, token_start, token_end, cut, piece_text) of each text, pieces from 0.

    A piece has at most `most` tokens and begins with the last `overlap` tokens of the one before (a few more where a
    character would be torn). cut: what the piece's end was cut at (`end` for a text's last piece). A text within the
    limit is one piece; so are an empty and a null text, of no tokens and with their own text. A row that comes twice is
    split twice; ids may be null.
    """
    return split_each(df, id_col, text_col, [(most, overlap)], tokenizer, folder, reach, halo).drop("limit_no")


def split_each(df: DataFrame, id_col: str, text_col: str, limits: list[tuple[int, int]], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, reach: int = RANGE, halo: int = HALO) -> DataFrame:
    """split() for each (most, overlap) of `limits`, whose place from 0 is the last column, limit_no: each text is encoded
    once for all of them."""
    if any(most < overlap + 8 or overlap < 0 for most, overlap in limits):
        raise ValueError("a piece must hold more than its overlap and a character")
    least = min(most for most, _ in limits)
    id_type = df.schema[id_col].dataType
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    out = T.StructType([T.StructField(id_col, id_type), *T.StructType.fromDDL(PIECE).fields, T.StructField("piece_text", T.StringType()), T.StructField("limit_no", T.IntegerType())])
    names = out.names

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            data, off = raw(b.column(1))
            keys = b.column(0)
            for i, j in slices(off):
                base = off[i : j + 1]
                rows: list[tuple] = []
                tok = np.zeros(j - i, np.int64)
                parts: dict[int, list] = {}

                def close(x: int) -> None:
                    got = parts.pop(x)
                    ends = np.concatenate([p + o for p, o, _ in got])
                    kinds = np.concatenate([k for _, _, k in got])
                    tok[x] = len(kinds)
                    if len(kinds) <= least:
                        return
                    raw_bytes = data[base[x] : base[x + 1]]
                    chars = np.concatenate([[0], np.cumsum((raw_bytes & 0xC0) != 0x80)])
                    edge = np.concatenate([[0], ends])
                    for no, (most, overlap) in enumerate(limits):
                        if len(kinds) > most:
                            for k, (s, e, kd) in enumerate(cuts(kinds, most, overlap)):
                                rows.append((x, k, chars[edge[s]], chars[edge[e]], s, e, "end" if e == len(kinds) else KINDS[kd], raw_bytes[edge[s] : edge[e]].tobytes(), no))

                for x, o, ends, kinds in boundaries(enc, data, base, least):
                    for y in [y for y in parts if y < x]:
                        close(y)
                    parts.setdefault(x, []).append((ends, o, kinds))
                for y in list(parts):
                    close(y)
                chars = np.concatenate([[0], np.cumsum((data[base[0] : base[-1]] & 0xC0) != 0x80)])
                nch = chars[base[1:] - base[0]] - chars[base[:-1] - base[0]]
                texts = b.column(1).slice(i, j - i)
                for no, (most, _) in enumerate(limits):
                    one = np.flatnonzero(tok <= most)
                    zero = np.zeros(len(one), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(i, j - i).take(pa.array(one)), pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(nch[one]), pa.array(zero), pa.array(tok[one]), pa.array(["end"] * len(one), pa.string()), texts.take(pa.array(one)), pa.array(np.full(len(one), no, np.int32))], names
                    )
                for r in range(0, len(rows), 4096):
                    c = list(zip(*rows[r : r + 4096]))
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(i, j - i).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), *[pa.array(np.array(v, np.int64)) for v in c[2:6]], pa.array(c[6], pa.string()), pa.array(c[7], pa.binary()).cast(pa.string()), pa.array(c[8], pa.int32())], names
                    )

    big = F.octet_length("_text") > reach
    small = src.filter(~F.coalesce(big, F.lit(False))).mapInArrow(whole, out)

    # each row has a number, as ids may repeat; the hash finds a row again
    rows = src.filter(big).select(id_col, "_text", F.monotonically_increasing_id().alias("_row"), F.xxhash64("_text").alias("_hash"))
    head = [T.StructField(id_col, id_type), *T.StructType.fromDDL("_row bigint, _hash bigint, range_no int, char_start bigint, n_chars bigint, last boolean, left_end int, right_end int").fields]
    cut_schema = T.StructType([*head, *T.StructType.fromDDL("core string, behind string").fields])
    table = T.StructType([*head, *T.StructType.fromDDL("first_id int, last_id int, chars binary, kinds binary, core string").fields])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            data, off = raw(b.column(1))
            for x in range(b.num_rows):
                lo, end = int(off[x]), int(off[x + 1])
                no, char, left, held, size = 0, 0, SURE, [], 0
                while lo < end:
                    hi, right = next_cut(enc, data, lo, lo + reach, end, halo, left) if lo + reach < end else (end, SURE)
                    n = int(np.count_nonzero((data[lo:hi] & 0xC0) != 0x80))
                    z = min(end, hi + 8)
                    while z < end and (data[z] & 0xC0) == 0x80:
                        z += 1
                    held.append((no, char, n, hi == end, left, right, data[lo:hi].tobytes(), data[hi:z].tobytes() if right == SURE else b""))
                    no, char, left, size, lo = no + 1, char + n, right, size + hi - lo, hi
                    if size > 4 << 20 or lo == end:
                        c = list(zip(*held))
                        same = [b.column(k).take(pa.array([x] * len(held))) for k in (0, 2, 3)]
                        yield pa.RecordBatch.from_arrays(
                            [*same, pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3]), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32()), pa.array(c[6], pa.binary()).cast(pa.string()), pa.array(c[7], pa.binary()).cast(pa.string())], cut_schema.names
                        )
                        held, size = [], 0

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            for r in range(b.num_rows):
                core, behind = b.column(9)[r].as_py().encode(), b.column(10)[r].as_py().encode()
                data = np.frombuffer(core, np.uint8)
                # what follows decides on white space at the end and on the kind of the last boundary
                got = list(boundaries(enc, np.frombuffer(core + behind, np.uint8), np.array([0, len(core) + len(behind)])))
                ends = np.concatenate([e + o for _, o, e, _ in got])
                kinds = np.concatenate([k for *_, k in got])
                keep = ends <= len(core)
                ends, kinds = ends[keep], kinds[keep]
                if b.column(8)[r].as_py() != SURE:
                    kinds[-1] = TOKEN
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                per = np.diff(chars[ends], prepend=0)
                edge = [core[: ends[0]], core[ends[-2] if len(ends) > 1 else 0 : ends[-1]]]
                first, last = (enc.ranks[t] for t in edge)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).slice(r, 1) for k in range(9)], pa.array([first], pa.int32()), pa.array([last], pa.int32()), pa.array([per.astype("<u2").tobytes()], pa.binary()), pa.array([kinds.tobytes()], pa.binary()), b.column(9).slice(r, 1)], table.names
                )

    tab = materialize(rows.mapInArrow(ranges, cut_schema).repartition(F.col("_row"), F.col("range_no")).mapInArrow(tables, table))
    spans = T.StructType([*out.fields[:-2], out.fields[-1], *T.StructType.fromDDL("_row bigint, _hash bigint, range_no int, _from bigint, _len bigint").fields])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        now, rows = [], []

        def batch(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), to_arrow)], names=spans.names)

        to_arrow = list(pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in spans.fields]))
        for b in batches:
            for r in b.to_pylist():
                if not now or now[0].row != r["_row"]:
                    now = [Stitcher(enc, r["_row"], *limit) for limit in limits]
                for no, one in enumerate(now):
                    for piece in one.feed(r):
                        rows.append((r[id_col], *piece[:6], no, r["_row"], r["_hash"], *piece[6:]))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    order = ["_row", "range_no"]
    span = materialize(tab.drop("core").repartition("_row").sortWithinPartitions(*order).mapInArrow(stitch, spans))
    # ends that did not fit: such texts are worked on whole
    unsure = span.filter("piece_no < 0").select(F.col(id_col).alias("_id"), "_row", "_hash")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_hash"))
    again = src.filter(big).join(unsure.dropDuplicates(["_id", "_hash"]), same, "left_semi").mapInArrow(whole, out)
    sound = span.join(unsure.select("_row"), "_row", "left_anti").drop("_hash")
    cut = sound.join(tab.select("_row", "range_no", "core"), order).withColumn("_t", F.expr("substring(core, cast(_from as int) + 1, cast(_len as int))"))
    key = [x for x in names if x != "piece_text"]
    large = cut.groupBy("_row", *key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "_t"))), lambda x: x["_t"]), "").alias("piece_text")).select(*names)
    return small.unionByName(again).unionByName(large)
