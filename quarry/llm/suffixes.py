"""Exact substring dedup: every byte that a WIDTH-byte string covers which also starts earlier in the corpus is removed.

Positions are ordered by (doc_id, start). A window is the string of WIDTH bytes at a start; equal windows make a class, and all but the
class's earliest start are repeats. The shards' suffix arrays, by induced sorting, find the classes; what goes to which shard, and
what needs no shard at all, is decided by anchors:

1. Each window has an anchor: the least hash among its GRAM-byte strings, leftmost on ties. Equal windows have equal anchors at
   equal offsets. Neighbouring windows with one anchor make a run.
2. Runs with equal anchor, bytes and place (128 bits of anchor hash and digest) are compared by that alone: all but the earliest are
   repeats in every window. A map task settles its own before the shuffle, within a batch and against the repeated runs of its earlier
   batches (``KEPT`` at most are remembered; what isn't is settled later, with the same result), and sends what it settled elsewhere,
   so copies don't pile up at their anchors.
3. Earliest runs whose anchor has runs with other bytes may share only some windows. Only these runs' bytes go to shards, by anchor.
   A shard joins its runs' bytes, sorts all suffixes by induction (suffix types, leftmost-smaller substrings sorted by a first induction
   and named, then two passes over the buckets), computes the permuted common prefixes up to WIDTH, and reads off the classes. The
   string of names is sorted by prefix doubling, not by a further level of induction: names have no small alphabet, so its buckets
   can't be passed over as arrays. The result is the same.
   An anchor with more than ``HOT`` such runs is dealt to several shards by a salt; then a shard reports the digest and earliest start of
   each class it found, and the classes are joined by digest.
4. Repeated windows of a document are joined to intervals and cut from its bytes.

Nothing grows with a group: rows pass in order of (anchor, digest, place) with one row of state, and shards are cut at SHARD bytes.

Cases: null texts are empty; texts shorter than WIDTH have no windows; repeated rows of one document are one document and get the same
result; rows that share a doc_id but differ in text: the one with the smallest digest stands in the corpus, the others are returned
whole; a null doc_id comes before all others; ids that aren't integers (strings, say) stand in their own order; an empty table gives no
rows; further columns are kept by ``dedup``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, staged, table

WIDTH = 100
GRAM = 32
HOT = 2000
SHARD = 1 << 20
#: Window starts that are hashed at a time.
PIECE = 1 << 20
#: Repeated runs that a map task remembers from batch to batch.
KEPT = 1 << 17
U = np.uint64
MIX = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
BASE = 0x5851F42D4C957F2D
VALUE = np.array([int.from_bytes(hashlib.sha256(b"v%d" % b).digest()[:8], "little") for b in range(256)], dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= MIX[1]
    x ^= x >> U(29)
    x *= MIX[0]
    return x ^ (x >> U(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * U(pow(b, len(p), 1 << 64))])
            out.append(p)
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def runs(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, digest, first, last): runs of window starts with one anchor, over the whole of data, a piece at a time."""
    parts = [_runs(data, at, min(len(data) - width + 1, at + PIECE), width, gram) for at in range(0, max(0, len(data) - width + 1), PIECE)]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.uint64 if k < 2 else np.int64) for k in range(4))  # type: ignore[return-value]


def _runs(data: np.ndarray, lo: int, hi: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
    b = np.ascontiguousarray(data[lo : hi + width - 1])
    n = len(b) - gram + 1
    eight = np.lib.stride_tricks.as_strided(b[: len(b) - 7].view(np.uint8), shape=(len(b) - 7, 8), strides=(1, 1)).copy().view(np.uint64).ravel()
    h = eight[:n] * MIX[0]
    for k in range(1, gram // 8):
        h += eight[8 * k : 8 * k + n] * MIX[k % 4]
        h ^= h >> U(29)
    h = _scramble(h)
    # The place in the low bits makes the leftmost of equal hashes the least.
    low = U((1 << 21) - 1)
    best = (h & ~low) | np.arange(n, dtype=np.uint64)
    span, want = 1, width - gram + 1
    while span * 2 <= want:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < want:
        best = np.minimum(best[: len(best) - (want - span)], best[want - span :])
    anchor = (best & low).astype(np.int64)
    edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(anchor) - 1]])
    at = anchor[first]
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(VALUE[b] * up[: len(b)], out=total[1:])
    digest = (total[last + width] - total[first]) * down[first]
    digest = _scramble(digest ^ ((last - first).astype(np.uint64) << U(32)) ^ ((at - first).astype(np.uint64) << U(48)))
    return h[at], digest, first + lo, last + lo


def suffix_array(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffixes in order of their first depth bytes at least, by induced sorting with all entries of a bucket at a time."""
    n = len(text)
    t = text.astype(np.int64)
    # Types: a suffix is smaller than the next one (S) or larger (L); equal bytes have the type to their right; the last is L.
    rising = np.zeros(n, dtype=bool)
    if n > 1:
        differs = np.flatnonzero(t[1:] != t[:-1])
        kind = t[differs] < t[differs + 1]
        where = np.searchsorted(differs, np.arange(n - 1))
        inside = where < len(differs)
        rising[:-1][inside] = kind[where[inside]]
    left = np.zeros(n, dtype=bool)
    left[1:] = rising[1:] & ~rising[:-1]
    marks = np.flatnonzero(left)
    # Sort leftmost-smaller substrings by induction, name them, and sort the names' string by doubling (its own suffixes, recursively).
    order = _induce(t, rising, marks)
    own = order[left[order]]
    if len(own) > 1:
        nxt = np.full(n, n, dtype=np.int64)
        nxt[marks] = np.append(marks[1:], n - 1)
        new = _different(t, own, nxt, n)
        names = np.zeros(n, dtype=np.int64)
        names[own] = np.cumsum(new)
        rank = names[marks]
        step, deep = 1, 2
        while rank.max() + 1 < len(rank) and deep < 2 * depth:
            key = rank * (len(rank) + 2) + np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), dtype=np.int64))[: len(rank)]
            by = np.argsort(key, kind="stable")
            rank = np.empty_like(rank)
            rank[by] = np.cumsum(np.concatenate([[0], key[by][1:] != key[by][:-1]]))
            step, deep = step * 2, deep * 2
        marks = marks[np.argsort(rank, kind="stable")]
    return _induce(t, rising, marks)


def _different(t: np.ndarray, own: np.ndarray, nxt: np.ndarray, n: int) -> np.ndarray:
    """Whether each leftmost-smaller substring differs from the one before it in order; substrings run up to the next mark."""
    a, b = own[:-1], own[1:]
    la, lb = nxt[a] - a, nxt[b] - b
    out = la != lb
    live = np.flatnonzero(~out)
    k = 0
    while len(live):
        i, j = a[live] + k, b[live] + k
        bad = t[i] != t[j]
        out[live[bad]] = True
        live = live[~bad]
        k += 1
        live = live[la[live] >= k]
    # The last substring ends with the text and equals no other.
    out |= (nxt[a] == n - 1) | (nxt[b] == n - 1)
    return np.concatenate([[0], out.astype(np.int64)])


def _induce(t: np.ndarray, rising: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """All suffixes from leftmost-smaller ones in order: the larger ones bucket by bucket upward, then the smaller ones downward."""
    n = len(t)
    sizes = np.bincount(t, minlength=256)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    larger = np.bincount(t[~rising], minlength=256)
    sa = np.full(n, -1, dtype=np.int64)
    fill = starts[:-1].copy()
    seeds = np.split(marks[np.argsort(t[marks], kind="stable")], np.cumsum(np.bincount(t[marks], minlength=256))[:-1]) if len(marks) else [marks] * 256

    def spread(found: np.ndarray, c: int, up: bool) -> np.ndarray:
        """Put the predecessors of a batch into their buckets; those of the same bucket come back, in order."""
        p = found[found > 0] - 1
        p = p[rising[p] != up]
        ch = t[p]
        again = p[ch == c]
        p, ch = p[ch != c], ch[ch != c]
        if len(p):
            by = np.argsort(ch.astype(np.uint8), kind="stable")
            p, ch = p[by], ch[by]
            count = np.bincount(ch, minlength=256)
            at = np.arange(len(p)) - np.concatenate([[0], np.cumsum(count)])[ch]
            if up:
                sa[fill[ch] + at] = p
                fill[:] = fill + count
            else:
                sa[fill[ch] - at] = p
                fill[:] = fill - count
        return again

    sa[fill[t[n - 1]]] = n - 1
    fill[t[n - 1]] += 1
    for c in range(256):
        if not sizes[c]:
            continue
        done = starts[c]
        while done < fill[c]:
            batch = sa[done : fill[c]].copy()
            done = fill[c]
            again = spread(batch, c, True)
            sa[fill[c] : fill[c] + len(again)] = again
            fill[c] += len(again)
        if len(seeds[c]):
            spread(seeds[c], c, True)
    fill = starts[1:] - 1
    for c in range(255, -1, -1):
        if not sizes[c]:
            continue
        done = starts[c + 1] - 1
        low = starts[c] + larger[c]
        while done > fill[c]:
            batch = sa[fill[c] + 1 : done + 1][::-1].copy()
            done = fill[c]
            again = spread(batch, c, False)
            if len(again):
                sa[fill[c] - len(again) + 1 : fill[c] + 1] = again[::-1]
                fill[c] -= len(again)
        if low > starts[c]:
            spread(sa[starts[c] : low][::-1].copy(), c, False)
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Permuted: for each place of the text, the bytes (at most ``most``) that its suffix shares with the one before it in order."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, shape=(n + 1, 8), strides=(1, 1)).copy().view(np.uint64).ravel()
    out = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        i, j = live + k, before[live] + k
        inside = (i < n) & (j < n)
        live, i, j = live[inside], i[inside], j[inside]
        x = eight[i] ^ eight[j]
        same = x == 0
        part = live[~same]
        bits = x[~same]
        out[part] = k + np.bitwise_count((bits & (~bits + U(1))) - U(1)).astype(np.int64) // 8
        live = live[same]
        out[live] = k + 8
    # Bytes beyond the end don't count.
    room = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(out, room), most)


def classes(text: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For window starts (places of text), the number of each one's class of equal windows."""
    sa = suffix_array(text, width)
    shared = common_prefixes(text, sa, width)
    number = np.empty(len(text), dtype=np.int64)
    number[sa] = np.cumsum(shared[sa] < width)
    return number[starts]


# --- the distributed part ---------------------------------------------------------------------------------------------------


def _anchored(docs: DataFrame, width: int) -> DataFrame:
    """docs: (doc, text), each doc once. Rows (anchor, digest, doc, first, last, repeat): repeat where the task itself saw earlier equal runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: The earliest place that left this task of runs that repeated in some batch: anchor, digest, doc, first, sorted by the first two.
        held = tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        for b in batches:
            # Rows leave in the documents' order, so that settled runs of one stand together.
            docs_, cols = b.column(0).to_numpy(zero_copy_only=False), []
            for k, text in enumerate(b.column(1)):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid and text.as_buffer() is not None else np.zeros(0, dtype=np.uint8)
                if len(data) >= width:
                    r = runs(data, width)
                    cols.append((*r, np.full(len(r[0]), docs_[k], dtype=np.int64)))
            if not cols:
                continue
            anchor, digest, first, last, doc = (np.concatenate(c) for c in zip(*cols, strict=True))
            by = np.lexsort((first, doc, digest, anchor))
            repeat = np.zeros(len(by), dtype=bool)
            repeat[by[1:]] = (anchor[by[1:]] == anchor[by[:-1]]) & (digest[by[1:]] == digest[by[:-1]])
            held = _remembered(held, anchor, digest, doc, first, by, repeat)
            # Settled runs that touch are one; they go by their document, not by their anchor.
            r = np.flatnonzero(repeat)
            r_doc, r_first, r_last = doc[r], first[r], last[r]
            new = np.ones(len(r), dtype=bool)
            new[1:] = (r_doc[1:] != r_doc[:-1]) | (r_first[1:] != r_last[:-1] + 1)
            ends = np.concatenate([new[1:], np.ones(min(1, len(r)), dtype=bool)])
            r_doc, r_first, r_last = r_doc[new], r_first[new], r_last[ends]
            k = ~repeat
            columns = [
                np.concatenate([anchor[k], _scramble(r_doc.view(np.uint64) ^ (r_first.astype(np.uint64) << U(20)))]).view(np.int64),
                np.concatenate([digest[k], np.zeros(len(r_doc), dtype=np.uint64)]).view(np.int64),
                np.concatenate([doc[k], r_doc]),
                np.concatenate([first[k], r_first]),
                np.concatenate([last[k], r_last]),
                np.concatenate([np.zeros(int(k.sum()), dtype=bool), np.ones(len(r_doc), dtype=bool)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "digest", "doc", "first", "last", "repeat"])

    return docs.mapInArrow(run, "anchor long, digest long, doc long, first long, last long, repeat boolean")


def _remembered(held: tuple, anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, first: np.ndarray, by: np.ndarray, repeat: np.ndarray) -> tuple:
    """Mark in repeat the runs that an earlier batch's run settles, and return what is held for the next."""
    sorted_repeat = repeat[by]
    heads = by[~sorted_repeat]
    if len(held[0]):
        # Where a held key would stand among the heads' keys: anchors first, digests among equal ones.
        lo, hi = np.searchsorted(held[0], anchor[heads], "left"), np.searchsorted(held[0], anchor[heads], "right")
        at, upto = lo, hi.copy()
        while (open_ := at < upto).any():
            mid = (at + upto) // 2
            less = open_ & (held[1][np.minimum(mid, len(held[1]) - 1)] < digest[heads])
            at, upto = np.where(less, mid + 1, at), np.where(open_ & ~less, mid, upto)
        found = at < hi
        found[found] = held[1][at[found]] == digest[heads[found]]
        k, own = at[found], heads[found]
        later = (held[2][k] < doc[own]) | ((held[2][k] == doc[own]) & (held[3][k] < first[own]))
        repeat[own[later]] = True
        # An earlier one than is held leaves too, and is held from now on.
        held[2][k[~later]], held[3][k[~later]] = doc[own[~later]], first[own[~later]]
        known = np.zeros(len(heads), dtype=bool)
        known[found] = True
    else:
        known = np.zeros(len(heads), dtype=bool)
    several = np.append(sorted_repeat[1:], False)[~sorted_repeat]  # heads that repeated within the batch
    new = heads[several & ~known][: KEPT - len(held[0])]
    if not len(new):
        return held
    more = tuple(np.concatenate([h, c[new]]) for h, c in zip(held, (anchor, digest, doc, first), strict=True))
    order = np.lexsort((more[1], more[0]))
    return tuple(m[order] for m in more)


def _settled(anchored: DataFrame) -> DataFrame:
    """Runs that repeat an earlier equal one (repeat), and earliest runs of anchors with several (not repeat). Streams sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row before the batch: anchor, digest, doc, first, last, and whether its anchor has shown two digests, and whether it's the first of its digest
        for b in batches:
            anchor, digest, doc, first, last, known = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in (anchor, doc, first, last, known)], names=["anchor", "doc", "first", "last", "repeat"])
                anchor, digest, doc, first, last = (c[~known] for c in (anchor, digest, doc, first, last))
            if not len(anchor):
                continue
            pa_, pd_ = (held[0], held[1]) if held else (~anchor[0], ~digest[0])
            before_a, before_d = np.concatenate([[pa_], anchor[:-1]]), np.concatenate([[pd_], digest[:-1]])
            same_anchor = anchor == before_a
            same = same_anchor & (digest == before_d)
            if not held:
                same_anchor[0] = same[0] = False
            heads = np.flatnonzero(~same)
            out_doc, out_first, out_last, out_anchor, out_repeat = [doc[same]], [first[same]], [last[same]], [anchor[same]], [np.ones(int(same.sum()), bool)]
            # A head that isn't its anchor's first shows that the anchor has several; so does the head before it.
            for_head = same_anchor[heads]
            several = for_head.copy()
            several[:-1] |= for_head[1:]
            pick = heads[several]
            out_doc.append(doc[pick]), out_first.append(first[pick]), out_last.append(last[pick]), out_anchor.append(anchor[pick]), out_repeat.append(np.zeros(len(pick), bool))
            if len(heads) and for_head[0] and held and held[5] is not None:  # the earlier batch's last head was its anchor's first, and unreported
                h = held[5]
                for col, v in zip((out_doc, out_first, out_last, out_anchor), h, strict=True):
                    col.append(np.array([v]))
                out_repeat.append(np.zeros(1, bool))
            # What may be reported later: the batch's last head, if it wasn't.
            if len(heads):
                p = heads[-1]
                waiting = None if several[-1] else (int(doc[p]), int(first[p]), int(last[p]), int(anchor[p]))
            else:
                waiting = held[5] if held else None
            held = (anchor[-1], digest[-1], 0, 0, 0, waiting)
            columns = [np.concatenate(c) for c in (out_anchor, out_doc, out_first, out_last, out_repeat)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "doc", "first", "last", "repeat"])

    keyed = anchored.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc", "first")
    return keyed.mapInArrow(run, "anchor long, doc long, first long, last long, repeat boolean")


def _bytes_of(picked: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """picked runs with their bytes, read from the documents' texts: each document gets the list of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text, listed in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                rows += [(r["anchor"], doc, r["first"], data[r["first"] : r["last"] + width], r["salt"]) for r in listed.as_py()]
                if len(rows) > 20_000:
                    yield _runs_batch(rows)
                    rows = []
            yield _runs_batch(rows)

    listed = picked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "last", "salt")).alias("listed"))
    return docs.join(listed, "doc").select("doc", "text", "listed").mapInArrow(run, "anchor long, doc long, first long, bytes binary, salt int")


def _runs_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=["anchor", "doc", "first", "bytes", "salt"])


def _sharded(contexts: DataFrame, width: int) -> DataFrame:
    """Rows (doc, first, last, digest): repeated windows first..last (digest null), or, of salted anchors, each class's earliest start with its digest."""

    def solve(rows: list[tuple]) -> tuple[list, list, list, list]:
        text = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        windows = sizes - width + 1
        row = np.repeat(np.arange(len(rows)), windows)
        off = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        number = classes(text, begin[row] + off, width)
        doc, start = np.array([r[1] for r in rows])[row], np.array([r[2] for r in rows])[row] + off
        by = np.lexsort((start, doc, number))
        head = np.ones(len(by), dtype=bool)
        head[1:] = number[by][1:] != number[by][:-1]
        repeat = np.zeros(len(by), dtype=bool)
        repeat[by[~head]] = True
        # The same start twice (a document cut in pieces) is no repeat of itself.
        lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        itself = (doc[by] == doc[lead]) & (start[by] == start[lead])
        repeat[by[itself]] = False
        salted = np.array([r[4] >= 0 for r in rows])[row]
        edge = repeat & ~np.concatenate([[False], repeat[:-1] & (row[1:] == row[:-1])])
        ends = repeat & ~np.concatenate([repeat[1:] & (row[1:] == row[:-1]), [False]])
        out_doc, out_first, out_last = doc[edge].tolist(), start[edge].tolist(), start[ends].tolist()
        out_digest: list = [None] * len(out_doc)
        one = by[head & salted[by]]
        blob = text.tobytes()
        for k in one.tolist():
            p = int(begin[row[k]] + off[k])
            out_digest.append(hashlib.blake2b(blob[p : p + width], digest_size=16).digest())
        out_doc += doc[one].tolist()
        out_first += start[one].tolist()
        out_last += start[one].tolist()
        return out_doc, out_first, out_last, out_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                now = (r[0], r[4])
                if size > SHARD and now != key:
                    yield _windows_batch(solve(rows))
                    rows, size = [], 0
                key = now
                rows.append(r)
                size += len(r[3])
        if rows:
            yield _windows_batch(solve(rows))

    keyed = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return keyed.mapInArrow(run, "doc long, first long, last long, digest binary")


def _windows_batch(columns: tuple[list, list, list, list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc", "first", "last", "digest"])


def repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """docs: (doc long, text), each doc and each text once. (doc, first, last): window starts first..last are repeats."""
    settled = staged(_settled(_anchored(docs, width)), "settled")
    picked = settled.where(~F.col("repeat"))
    sizes = picked.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    sizes = staged(sizes, "hot")
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.hash("doc", "first"), F.ceil(F.col("n") / hot).cast("int"))).otherwise(F.lit(-1)).cast("int")
    # At most rows / hot anchors are hot; broadcast only if they are few.
    picked = picked.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "anchor", "left").withColumn("salt", salt)
    found = staged(_sharded(_bytes_of(picked, docs, width), width), "windows")
    whole = found.where(F.col("digest").isNull()).select("doc", "first", "last")
    lead = found.where(F.col("digest").isNotNull())
    least = lead.groupBy("digest").agg(F.min(F.struct("doc", "first")).alias("least"), F.count("*").alias("n")).where(F.col("n") > 1)
    late = lead.join(least, "digest").where((F.col("doc") != F.col("least.doc")) | (F.col("first") != F.col("least.first"))).select("doc", "first", "last")
    return settled.where("repeat").select("doc", "first", "last").unionByName(whole).unionByName(late)


def intervals(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, cut): byte intervals [start, end) of a document, disjoint and in order."""
    spans = found.select("doc", "first", (F.col("last") + width).alias("end"))
    w = W.partitionBy("doc").orderBy("first", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0))
    merged = marked.withColumn("k", F.sum("new").over(w)).groupBy("doc", "k").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """docs with a last column, the byte intervals to remove, null where nothing is."""
    bounded_batches(docs.sparkSession, 128)
    n_doc, n_hash, n_least, n_cut, n_own = fresh(docs, "doc", "hash", "least", "cut", "own")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = _numbered(docs, id_col, n_doc).withColumn(n_hash, F.xxhash64(text))
    texts = named.select(F.col(n_doc).alias("doc"), text.alias("text"), F.col(n_hash).alias("hash"))
    ids = named.groupBy(F.col(n_doc).alias(n_own)).agg(F.count("*").alias("n"), F.min(n_hash).alias(n_least))
    twice = staged(ids.where(F.col("n") > 1).drop("n"), "twice")  # ids of several rows
    if not twice.isEmpty():
        own = twice.select(F.col(n_own).alias("doc"), F.col(n_least).alias("least"))
        texts = texts.join(own, "doc", "left").where(F.col("least").isNull() | (F.col("least") == F.col("hash"))).dropDuplicates(["doc"])
        named = named.join(twice, F.col(n_doc) == F.col(n_own), "left").drop(n_own)
    else:
        named = named.withColumn(n_least, F.lit(None).cast("long"))
    texts = texts.select("doc", "text").where(F.octet_length("text") >= width)
    cuts = intervals(repeats(texts, width), width).select(F.col("doc").alias(n_own), F.col("cut").alias(n_cut))
    stands = F.col(n_least).isNull() | (F.col(n_least) == F.col(n_hash))
    return named.join(cuts, F.col(n_doc) == F.col(n_own), "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.when(stands, F.col(n_cut)).alias(n_cut))


def _numbered(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """docs with a long in the ids' order: the id itself if it is an integer, else its number among the sorted distinct ids."""
    least = F.lit(-(1 << 63))
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn(name, F.coalesce(F.col(f"`{id_col}`").cast("long"), least))
    key = f"{name}_id"
    ordered = docs.select(F.col(f"`{id_col}`").alias(key)).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn(name, F.monotonically_increasing_id())
    return docs.join(staged(ordered, "numbered"), F.col(f"`{id_col}`") == F.col(key), "left").drop(key).withColumn(name, F.coalesce(F.col(name), least))


def kept_bytes(data: bytes, cut: list[dict] | None) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal removed runs)"""
    out, at = [], 0
    for c in cut or []:
        out.append(data[at : c["start"]])
        at = c["end"]
    out.append(data[at:])
    left = b"".join(out)
    return left, len(data) - len(left), len(cut or [])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row a row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, cut in zip(b.column(1), b.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                left, removed, n = kept_bytes(data, cut.as_py())
                rows.append((len(data), removed, n, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _marked(slim, "doc_id", "text", width).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with the repeated bytes cut from their texts; a character cut in part goes whole. Rows and other columns stay."""
    names = docs.columns
    marked = _marked(docs, id_col, text_col, width)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [None if t.as_py() is None else kept_bytes(t.as_py().encode("utf-8"), c.as_py())[0].decode("utf-8", "ignore") for t, c in zip(b.column(at), b.column(len(names)), strict=True)]
            columns = [b.column(k) if k != at else pa.array(left, pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(run, docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
