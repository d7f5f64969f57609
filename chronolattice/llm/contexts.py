"""Exact matching of windows through their anchors' contexts.

A window is found through its anchor, a piece of it that content alone picks. All windows of one anchor occurrence
make its context. Two stages keep rows few and every group streamable:

* by batch: of equal contexts, only the smallest position's goes on; the others are repeats already
  ("known"). So however often a passage occurs, a batch brings it to its group once.
* by anchor: rows arrive sorted by (anchor, context, document, position). A context that a smaller
  document has too is repeated as a whole. Windows of different contexts of one anchor may still be equal: only then
  are a context's first occurrences taken apart into windows, which are grouped by their own names.

Nothing here holds a group: the stream remembers one row's worth of state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Rows between the stages. a, c: names of anchor and context; d, k: document and packed (text key, first window);
#: n: windows; w: what the windows' names can be made from; b: known repeats of a document.
OPEN = "a long, c long, d long, k long, n int, w binary, b binary"
#: Rows after them. kind 0: n windows from k on are repeats; 1: a window still to compare; 2: known repeats (b); 3: a
#: context still to compare.
FOUND = "kind byte, h long, i int, d long, k long, n int, b binary"
LOW = (1 << 32) - 1


def batch_of(fields: str, size: int, /, **columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "byte": pa.int8()}
    names = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.nulls(size, types[t]) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]).cast(types[t]) for c, t in names], [c for c, _ in names])


def known_rows(d: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row a document; a is drawn from the id only to spread the rows."""
    order = np.lexsort((k, d))
    d, k, n = d[order], k[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] >> 32 != k[:-1] >> 32))))
    pairs = np.stack(((k & LOW).astype(np.uint32), n.astype(np.uint32)), 1)
    packed = [x.tobytes() for x in np.split(pairs, cut[1:])]
    return batch_of(OPEN, len(cut), a=d[cut] * 2654435761, d=d[cut], k=k[cut], b=pa.array(packed, pa.binary()))


def pick(rows: pa.Array, which: np.ndarray) -> pa.Array:
    return rows.take(pa.array(which))


def open_rows(a, c, d, k, n, w: pa.Array, within: bool) -> Iterator[pa.RecordBatch]:
    """A batch's contexts. within: an equal context later in the same document is a repeat too."""
    order = np.lexsort((k, d, c, a))
    a, c, d, k, n = a[order], c[order], d[order], k[order], n[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    known = (d > d[head]) | (k > k[head]) if within else d > d[head]
    sent = np.flatnonzero(~known)
    yield batch_of(OPEN, len(sent), a=a[sent].view(np.int64), c=c[sent].view(np.int64), d=d[sent], k=k[sent], n=n[sent].astype(np.int32), w=pick(w, order[sent]))
    if known.any():
        yield known_rows(d[known], k[known], n[known])


def compare(batches: Iterator[pa.RecordBatch], windows: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None, within: bool) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (a, c, d, k). windows(ws, ns): row numbers, offsets and names (64 and 32 bits) of all windows;
    without it, contexts that need a closer look are passed on as rows of kind 3, with the anchor's name in h."""
    last_a = last_c = least = lowest = None
    multi, held = False, None  # of the anchor that the last batch ended in

    def apart(d, k, n, w, a) -> Iterator[pa.RecordBatch]:
        if windows is None:
            yield batch_of(FOUND, len(d), kind=np.full(len(d), 3, np.int8), h=a, d=d, k=k, n=n.astype(np.int32))
            return
        for s in range(0, len(d), 20_000):
            row, at, h, i = windows(w.slice(s, 20_000).to_pylist(), n[s : s + 20_000])
            yield batch_of(FOUND, len(row), kind=np.ones(len(row), np.int8), h=h.view(np.int64), i=i.view(np.int32), d=d[s + row], k=k[s + row] + at)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        known = np.asarray(t["c"].is_null())
        if known.any():
            x = t.filter(pa.array(known))
            yield batch_of(FOUND, x.num_rows, kind=np.full(x.num_rows, 2, np.int8), d=x["d"].combine_chunks(), k=x["k"].combine_chunks(), b=x["b"].combine_chunks())
            t = t.filter(pa.array(~known))
        m = t.num_rows
        if not m:
            continue
        a, c, d, k, n = (t[x].to_numpy() for x in "acdkn")
        w = t["w"].combine_chunks()
        on_a, on_c = a[0] == last_a, a[0] == last_a and c[0] == last_c
        new_a = np.concatenate(([not on_a], a[1:] != a[:-1]))
        new_c = np.concatenate(([not on_c], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        group = np.cumsum(new_c)
        heads = np.concatenate(([least if on_c else 0], d[new_c]))
        low = heads[group]
        low_k = np.concatenate(([lowest if on_c else 0], k[new_c]))[group]
        gone = (d > low) | (k > low_k) if within else d > low
        if gone.any():
            yield batch_of(FOUND, int(gone.sum()), kind=np.zeros(int(gone.sum()), np.int8), d=d[gone], k=k[gone], n=n[gone].astype(np.int32))
        which = np.cumsum(new_a)  # 0: the anchor the last batch ended in
        contexts = np.bincount(which, weights=new_c, minlength=which[-1] + 1).astype(np.int64)
        if on_a:
            contexts[0] += 2 if multi else 1
        first = ~gone
        if on_a and held is not None and contexts[0] >= 2:
            yield from apart(*held)
            held = None
        if not on_a:
            held = None
        many = first & (contexts[which] >= 2)
        if many.any():
            p = np.flatnonzero(many)
            yield from apart(d[p], k[p], n[p], pick(w, p), a[p])
        end = which == which[-1]
        if contexts[which[-1]] < 2:
            p = np.flatnonzero(end & first)
            mine = (d[p], k[p], n[p], pick(w, p), a[p])
            if held is not None and which[-1] == 0:
                mine = tuple(pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate((x, y)) for x, y in zip(held, mine, strict=True))
            held = mine
        else:
            held = None
        multi, last_a, last_c, least, lowest = contexts[which[-1]] >= 2, a[-1], c[-1], low[-1], low_k[-1]
