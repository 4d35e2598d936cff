"""Pointer doubling over arrays: the hierarchies of many small graphs at once, within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ON_CYCLE, NO_ROOT = -1, -2


def _least(key: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The place of the least d of each key."""
    o = np.lexsort((d, key))
    return o[np.r_[True, key[o][1:] != key[o][:-1]]] if len(o) else o


def _rows_of(at: np.ndarray, sorted_by: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of `at`, the places of that value in `sorted_by`: (index into at, index into sorted_by)."""
    first = np.searchsorted(sorted_by, np.arange(n + 1))
    size = first[at + 1] - first[at]
    left = np.repeat(np.arange(len(at)), size)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + first[at][left]


def _trim(x: np.ndarray, y: np.ndarray, n: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Takes away, until there are none, the nodes that have no link x -> y and those whose one link leads, over nodes
    with one link, to such a node; pointer doubling finds where that is."""
    while len(x):
        have = np.bincount(x, minlength=n)
        to = np.arange(n)
        single = have[x] == 1
        to[x[single]] = y[single]
        for _ in range(int(n).bit_length() + 1):
            to = to[to]
        gone = live & (have[to] == 0)
        if not gone.any():
            break
        live = live & ~gone
        keep = live[x] & live[y]
        x, y = x[keep], y[keep]
    return x, y, live if len(x) else np.zeros(n, bool)


def _labels(n: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least of the labels that reach each node along links n -> a; labels are nodes and are followed too."""
    while True:
        new = m.copy()
        np.minimum.at(new, n, m[a])
        new = np.minimum(new, new[new])
        if (new == m).all():
            return m
        m = new


def cyclic(child: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Which nodes lie on a cycle."""
    live = np.ones(n, bool)
    x, y, live = _trim(child, parent, n, live)
    y, x, live = _trim(y, x, n, live)
    out = np.zeros(n, bool)
    if not len(x):
        return out
    if (np.bincount(x, minlength=n) <= 1).all():
        return live
    out[x[x == y]] = True
    # numbers in no order, so that least labels lie far off on the average
    shuffled = np.random.default_rng(0).permutation(n)
    x, y, live = shuffled[x], shuffled[y], live[np.argsort(shuffled)]
    got = np.zeros(n, bool)
    while len(x):
        up = _labels(x, y, np.arange(n))
        own = up[x] == up[y]
        down = _labels(y[own], x[own], np.arange(n))
        part = live & (down == up)
        got |= part & (np.bincount(up[part], minlength=n)[up] > 1)
        live = live & ~part
        keep = live[x] & live[y]
        x, y = x[keep], y[keep]
    return out | got[shuffled]


def roots(child: np.ndarray, parent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, depth) of each node of the distinct links child -> parent among the nodes 0 to n - 1: a row for each
    root with the edges of the shortest way; (node, -1, ON_CYCLE) on a cycle; (node, -1, NO_ROOT) where there is no root."""
    cyc = cyclic(child, parent, n)
    # above nodes on cycles the links are cut, so that all ways end: at roots, or at nodes on cycles
    open_ = ~cyc[child]
    c, p = child[open_], parent[open_]
    inner = np.zeros(n, bool)
    inner[c] = True
    done_x, done_t, done_d = c[~inner[p]], p[~inner[p]], np.ones(int((~inner[p]).sum()), np.int64)
    x, t, d = c[inner[p]], p[inner[p]], np.ones(int(inner[p].sum()), np.int64)
    while len(x):
        sx, st, sd, se = np.r_[x, done_x], np.r_[t, done_t], np.r_[d, done_d], np.r_[np.zeros(len(x), bool), np.ones(len(done_x), bool)]
        o = np.argsort(sx, kind="stable")
        i, j = _rows_of(t, sx[o], n)
        j = o[j]
        nx, nt, nd, ne = x[i], st[j], d[i] + sd[j], se[j]
        ax, at, ad = np.r_[done_x, nx[ne]], np.r_[done_t, nt[ne]], np.r_[done_d, nd[ne]]
        k = _least(ax * n + at, ad)
        done_x, done_t, done_d = ax[k], at[k], ad[k]
        nx, nt, nd = nx[~ne], nt[~ne], nd[~ne]
        k = _least(nx * n + nt, nd)
        x, t, d = nx[k], nt[k], nd[k]
    if cyc.any():
        ends = np.flatnonzero(~inner)
        every = (np.r_[done_x, ends], np.r_[done_t, ends], np.r_[done_d, np.zeros(len(ends), np.int64)])
        bx, bt, bd = _beyond(child[~open_], parent[~open_], every, cyc, n)
        # what ends at a node on a cycle goes on to that node's roots
        over = cyc[done_t]
        o = np.argsort(bx, kind="stable")
        i, j = _rows_of(done_t[over], bx[o], n)
        j = o[j]
        ax, at, ad = np.r_[done_x[~over], done_x[over][i]], np.r_[done_t[~over], bt[j]], np.r_[done_d[~over], done_d[over][i] + bd[j]]
        k = _least(ax * n + at, ad)
        done_x, done_t, done_d = ax[k], at[k], ad[k]
    own = np.flatnonzero(~inner & ~cyc)
    have = cyc.copy()
    have[done_x] = True
    have[own] = True
    lost, on = np.flatnonzero(~have), np.flatnonzero(cyc)
    none = np.full(len(lost) + len(on), -1)
    return (
        np.r_[done_x, own, on, lost],
        np.r_[done_t, own, none],
        np.r_[done_d, np.zeros(len(own), np.int64), np.full(len(on), ON_CYCLE), np.full(len(lost), NO_ROOT)],
    )


def _beyond(child: np.ndarray, parent: np.ndarray, every: tuple, cyc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node on a cycle, root, edges of the shortest way): what is reached over the links above nodes on cycles. Lengths
    are lowered along links and along jumps of 2^k links until none falls; where no root is reached there is nothing to
    lower."""
    ex, et, ed = every
    o = np.argsort(ex, kind="stable")
    i, j = _rows_of(parent, ex[o], n)
    j = o[j]
    x, t, d = child[i], et[j], ed[j] + 1
    k = _least(x * n + t, d)
    x, t, d = x[k], t[k], d[k]
    over = cyc[t]
    lx, ly, lw = x[over], t[over], d[over]
    x, t, d = x[~over], t[~over], d[~over]
    if not len(x) or not len(lx):
        return x, t, d
    # one link of each node, doubled
    one = _least(lx, lw)
    to, w = np.arange(n), np.zeros(n, np.int64)
    to[lx[one]], w[lx[one]] = ly[one], lw[one]
    jx, jy, jw = [lx], [ly], [lw]
    ring = np.flatnonzero(cyc)
    for _ in range(int(len(ring)).bit_length()):
        w = w + w[to]
        to = to[to]
        jx.append(ring), jy.append(to[ring]), jw.append(w[ring])
    lx, ly, lw = np.concatenate(jx), np.concatenate(jy), np.concatenate(jw)
    o = np.argsort(ly, kind="stable")
    lx, ly, lw = lx[o], ly[o], lw[o]
    fx, ft, fd = x, t, d
    while len(fx):
        i, j = _rows_of(fx, ly, n)
        ax, at, ad = np.r_[x, lx[j]], np.r_[t, ft[i]], np.r_[d, fd[i] + lw[j]]
        k = _least(ax * n + at, ad)
        new = k[k >= len(x)]
        fx, ft, fd = ax[new], at[new], ad[new]
        x, t, d = ax[k], at[k], ad[k]
    return x, t, d


def _solve(t: pa.Table, g: int, names: list[str]) -> pa.RecordBatch:
    """t: scope columns, node, parent or null. The rows of roots()."""
    size = t.num_rows
    scope = np.zeros(size, np.int64)
    for i in range(g):
        code = pc.dictionary_encode(t.column(i).combine_chunks()).indices.to_numpy()
        scope = np.unique(scope * (int(code.max()) + 1) + code, return_inverse=True)[1]
    both = pc.dictionary_encode(pa.concat_arrays([t.column(g).combine_chunks(), t.column(g + 1).combine_chunks()]))
    code = pc.fill_null(both.indices, -1).to_numpy().astype(np.int64)
    known = code >= 0
    key = np.r_[scope, scope] * (len(both.dictionary) + 1) + code
    ids, first, inv = np.unique(key[known], return_index=True, return_inverse=True)
    at = np.full(2 * size, -1)
    at[known] = inv
    n, a = at[:size], at[size:]
    link = (n >= 0) & (a >= 0)
    pairs = np.unique(n[link] * len(ids) + a[link]) if link.any() else np.zeros(0, np.int64)
    x, r, d = roots(pairs // max(len(ids), 1), pairs % max(len(ids), 1), len(ids))
    row = np.flatnonzero(known)[first] % size  # a row of the node's scope
    node = code[np.flatnonzero(known)[first]]
    pick = lambda i: pa.array(node[np.where(i >= 0, i, 0)], mask=i < 0)
    cols = [t.column(i).combine_chunks().take(pa.array(row[x])) for i in range(g)]
    return pa.RecordBatch.from_arrays([*cols, both.dictionary.take(pick(x)), both.dictionary.take(pick(r)), pa.array(d.astype(np.int32))], names)


def solver(g: int, names: list[str], step: int = 1 << 16):
    """A function for mapInArrow over rows sorted by scope (g columns): whole scopes of about `step` rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < step:
                continue
            t = pa.Table.from_batches(held)
            last = None
            for i in range(g):
                eq = pc.equal(t.column(i), t.column(i)[t.num_rows - 1])
                last = eq if last is None else pc.and_(last, eq)
            cut = pc.index(last, pa.scalar(True)).as_py()
            if cut:
                yield from _slices(_solve(t.slice(0, cut), g, names))
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from _slices(_solve(pa.Table.from_batches(held), g, names))

    return run


def _slices(b: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, most):
        yield b.slice(i, most)
