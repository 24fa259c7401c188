"""Repeated passages from common-prefix interval trees of suffix buckets.

A *maximal repeat* is a passage of at least ``min_words`` words with two or
more occurrences that can be extended neither to the right (not all of them go
on with the same word) nor to the left (not all of them follow the same word).
All of them are found, each with all its occurrences:

1. *Anchors.*  Of each window of ``min_words - ANCHOR + 1`` neighbouring
   ``ANCHOR``-word shingles the one with the least hash is an anchor.  What a
   passage of ``min_words`` words has as its first window's anchor depends on
   these words alone, so all its occurrences share it.  An anchor value matters
   only if its occurrences differ within a window's reach to the left, since a
   passage whose occurrences all follow the same word is not maximal; the other
   ones, copies' insides among them, are dropped by an aggregation.
2. *Buckets.*  Each remaining anchor occurrence is sent once, with the words
   around it, to the bucket of its value.  There the suffixes that start in its
   reach and share their first ``min_words`` words form a group.
3. *Interval tree.*  A group's suffixes are sorted, and a stack scan over the
   common-prefix lengths of neighbours yields the intervals of the tree; those
   with differing left words are the maximal repeats.
4. *Long repeats.*  Suffixes still equal at the end of the words sent stay one
   leaf of this tree and go on as a group of their own, with the next, longer
   stretch of words, until all are told apart.

5. *Hot groups.*  An anchor value that occurs more than ``HOT`` times is not
   brought together in one task.  Its suffixes are grouped by their first
   ``min_words`` words, groups without differing left words are dropped by an
   aggregation, and each group of more than ``HOT`` suffixes is sorted in ranges
   of words whose bounds come from a sample; words that are many in the sample
   are a range of their own, in pieces.  A range's task finds the intervals
   inside it and hands on the common-prefix lengths that intervals over its ends
   depend on, the running minima from either end; one stack scan over these
   finds the rest.  What is still equal at the end of the words sent goes on, as
   a hot group while it is large, and as an ordinary one once it isn't.

A result row is a suffix: the ``rank``-th (from 0) of its group, at word
``position`` of ``doc_id``.  Its ``repeats`` has an entry (last, n_words) for
each maximal repeat whose first occurrence in the order it is; all occurrences
are the group's ranks from its own to ``last``.  So nested repeats cost two
numbers each, not another list.  ``occurrences()`` unfolds them.

Words are compared by 32 bits of their hash inside a group, and 64 bits decide
on the first ``min_words``: a repeat may come out a word too long where two
different words share 32 bits, once in four billion ends.

Defined cases: null ids and null texts are left out, as is a text of fewer than
``min_words`` words.  A text's start differs from every word and from every
other start, and likewise its end.  Repeats within one document count.  Rows
with the same id and text are one document; different texts of one id are
documents of their own.  Other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm import textkit as tk
from symgrove.llm.runtime import cut, stored

MIN_WORDS = 50
ANCHOR = 16
#: Words sent after an anchor in the first round, and the factor from round to round.
REACH = 128
GROWTH = 4
#: Occurrences of an anchor, and suffixes of a group, that one task takes together.
HOT = 1 << 17
#: Suffixes of a hot group that stand for a range of it in the sample.
SAMPLED = 32
#: Words that a task holds of a hot group at about most, and words sent after each of its suffixes at most.
RANGE_WORDS = 1 << 23
HOT_REACH = 1024

ANCHORS = "uid long, pos int, anchor long, before long"
STRETCH = "anchor long, part long, uid long, doc_id long, pos int, back long, reach int, depth int, n_words int, words binary"
CONTINUED = "anchor long, uid long, doc_id long, n_words int, suffixes array<struct<part:long,pos:int,depth:int,left:long>>, words binary"
SUFFIX_KEYS = "part long, uid long, pos int, left long"
SUFFIXES = "part long, uid long, doc_id long, pos int, depth int, left long, words binary, more boolean"
RANGED = "part long, bucket int, uid long, doc_id long, pos int, depth int, left long, words binary, more boolean, run int"
RANGE = "part long, bucket int, run int, depth int, doc_ids array<long>, positions array<int>, uids array<long>, lefts array<long>, repeats array<struct<lo:int,hi:int,n_words:int>>, open array<struct<part:long,lo:int,hi:int,depth:int>>, ends struct<n:int,found:int,going:int,size:int,first:binary,last:binary,first_left:long,last_left:long>, points array<struct<at:int,lcp:int,before:int,upto:int>>"
MERGED = "part long, bucket int, base int, goes_on boolean, spans array<struct<at:int,last:int,n_words:int>>, any boolean"
FOUND = "anchor long, part long, depth int, doc_ids array<long>, positions array<int>, uids array<long>, repeats array<struct<lo:int,hi:int,n_words:int>>, open boolean"
PACKED = ["anchor", "part", "doc_ids", "positions", "repeats"]
RESULT = "group_id long, rank int, doc_id long, position int, repeats array<struct<last:int,n_words:int>>"


def _source(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text); uid tells apart texts that share an id, equal texts of one id being equal rows."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")


def _window_minima(sh: np.ndarray, first: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, shingle) for each full window of each row: the leftmost least shingle."""
    n = len(sh)
    counts = np.diff(first)
    per = np.maximum(counts - w + 1, 0)
    if not per.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sparse table of two overlapping powers of two; values are (hash, place) through their rank
    order = np.argsort(sh, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    level, size = rank, 1
    while size * 2 <= w:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    starts = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    return starts, order[np.minimum(level[starts], level[starts + w - size])]


def _words_of(texts: pa.Array):
    h, first, *_ = tk.words(pc.utf8_lower(texts))
    return h, first


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR) -> DataFrame:
    """(uid, pos, anchor, before): each anchor with a hash of the words in reach to its left."""
    w = min_words - k + 1

    def run(batches):
        for batch in batches:
            texts = tk.string_array(batch.column(2))
            uids, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in tk.slices(texts):
                h, first = _words_of(texts[lo:hi])
                sh, at, bounds = tk.shingles(h, first, k)
                _, chosen = _window_minima(sh, bounds, w)
                chosen = np.unique(chosen)
                row = np.searchsorted(bounds, chosen, side="right") - 1
                pos = at[chosen] - first[row]
                # polynomial hash of the w words before; a text's start is like no other
                p, inv = tk._power_tables(len(h))
                s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])
                left = np.maximum(at[chosen] - w, first[row])
                before = tk.mix((s[at[chosen]] - s[left]) * inv[left])
                edge = pos < w
                own = tk.mix(uids[lo:hi][row].view(np.uint64) + tk.mix(ids[lo:hi][row].view(np.uint64)) + pos.astype(np.uint64))
                before = np.where(edge, own, before)
                yield pa.RecordBatch.from_arrays([pa.array(uids[lo:hi][row]), pa.array(pos.astype(np.int32)), pa.array(tk.signed(sh[chosen])), pa.array(tk.signed(before))], ["uid", "pos", "anchor", "before"])

    return _source(docs).mapInArrow(run, ANCHORS)


def _stretches(min_words: int, k: int, reach: int):
    """First round: for each listed anchor of a document the words around it."""
    w = min_words - k + 1

    def run(batches):
        for batch in batches:
            texts = tk.string_array(batch.column("text"))
            lists = batch.column("at")
            uids, ids = batch.column("uid").to_numpy(), batch.column("doc_id").to_numpy()
            for lo, hi in tk.slices(texts):
                h, first = _words_of(texts[lo:hi])
                sh, at, bounds = tk.shingles(h, first, k)
                starts, chosen = _window_minima(sh, bounds, w)
                edge = np.flatnonzero(np.diff(chosen, prepend=-1))
                until = np.append(edge, len(chosen))[1:] - 1
                anchor_at, lo_at, hi_at = at[chosen[edge]], at[starts[edge]], at[starts[until]]
                part = lists.slice(lo, hi - lo)
                wanted = np.repeat(first[:-1], np.diff(part.offsets.to_numpy())) + part.flatten().to_numpy()
                hit = np.isin(anchor_at, wanted)
                short = (h >> np.uint64(32)).astype(np.uint32)
                row = np.searchsorted(first, anchor_at[hit], side="right") - 1
                out: list[list] = [[] for _ in range(10)]
                for a, b, c, r, g in zip(anchor_at[hit].tolist(), lo_at[hit].tolist(), hi_at[hit].tolist(), row.tolist(), sh[chosen[edge]][hit].view(np.int64).tolist(), strict=True):
                    begin, end = max(b - 1, int(first[r])), min(a + k + reach, int(first[r + 1]))
                    values = (g, 0, int(uids[lo + r]), int(ids[lo + r]), a - int(first[r]), a - b, c - b + 1, 0, int(first[r + 1] - first[r]), short[begin:end].tobytes())
                    for x, v in zip(out, values, strict=True):
                        x.append(v)
                yield _batch(out)

    return run


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in STRETCH.split(", ")]


_SUFFIX = pa.struct([("part", pa.int64()), ("pos", pa.int32()), ("depth", pa.int32()), ("left", pa.int64())])
_MORE = [("anchor", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int32()), ("suffixes", pa.list_(_SUFFIX)), ("words", pa.binary())]


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def _continuations(reach: int):
    """Later rounds: the next words from each place where suffixes of a document are open."""

    def run(batches):
        for batch in batches:
            texts = tk.string_array(batch.column("text"))
            lists = batch.column("at")
            uids, ids = batch.column("uid").to_numpy(), batch.column("doc_id").to_numpy()
            for lo, hi in tk.slices(texts):
                h, first = _words_of(texts[lo:hi])
                short = (h >> np.uint64(32)).astype(np.uint32)
                out: list[list] = [[] for _ in _MORE]
                for r, todo in enumerate(lists.slice(lo, hi - lo).to_pylist()):
                    base, stop = int(first[r]), int(first[r + 1])
                    for x in todo:
                        for y in x["s"]:
                            y["left"] = int(short[base + y["pos"] - 1]) if y["pos"] else -1
                        values = (x["anchor"], int(uids[lo + r]), int(ids[lo + r]), stop - base, x["s"], short[base + x["end"] : min(base + x["end"] + reach, stop)].tobytes())
                        for c, v in zip(out, values, strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, _MORE, strict=True)], [n for n, _ in _MORE])

    return run


def _own_left(pos: np.ndarray, uid: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Left words; a text's start is like no other."""
    return np.where(pos > 0, left, -1 - (uid & ((1 << 62) - 1)))


def _suffix_keys(min_words: int, k: int):
    """The suffixes in reach of the anchors listed in hot_at: a hash of their first words, and the word before."""
    w = min_words - k + 1

    def run(batches):
        for batch in batches:
            texts, lists, uids = tk.string_array(batch.column("text")), batch.column("hot_at"), batch.column("uid").to_numpy()
            for lo, hi in tk.slices(texts):
                h, first = _words_of(texts[lo:hi])
                sh, at, bounds = tk.shingles(h, first, k)
                starts, chosen = _window_minima(sh, bounds, w)
                part = lists.slice(lo, hi - lo)
                wanted = np.repeat(first[:-1], np.diff(part.offsets.to_numpy())) + part.flatten().to_numpy()
                begin = at[starts[np.isin(at[chosen], wanted)]]
                p, inv = tk._power_tables(len(h))
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])
                key = tk.signed(tk.mix((upto[begin + min_words] - upto[begin]) * inv[begin]) >> np.uint64(1))
                row = np.searchsorted(first, begin, side="right") - 1
                pos, uid = begin - first[row], uids[lo:hi][row]
                left = _own_left(pos, uid, (h >> np.uint64(32)).astype(np.int64)[np.maximum(begin - 1, 0)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uid), pa.array(pos.astype(np.int32)), pa.array(left)], ["part", "uid", "pos", "left"])

    return run


def _flat_suffixes(batches):
    """A row for each suffix of CONTINUED rows, with words as bytes that sort like them."""
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, len(b), 1024)):
        t = pa.Table.from_batches([batch])
        flat, begin, size = _flat_words(t)
        code = flat.astype(">u4").tobytes()
        lists = batch.column("suffixes")
        of = np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy()))
        inner = lists.flatten()
        part, pos, depth, left = (inner.field(x).to_numpy() for x in ("part", "pos", "depth", "left"))
        uid = batch.column("uid").to_numpy()[of]
        words = [code[4 * a : 4 * (a + n)] for a, n in zip(begin[of].tolist(), size[of].tolist(), strict=True)]
        more = pos + depth + size[of] < batch.column("n_words").to_numpy()[of]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(uid), batch.column("doc_id").take(pa.array(of)), pa.array(pos), pa.array(depth), pa.array(_own_left(pos, uid, left)), pa.array(words, pa.binary()), pa.array(more)], [x.split()[0] for x in SUFFIXES.split(", ")])


def _diverse(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` of the groups with more than one member and differing left words, once each, with the number of rows ``n``."""
    sizes = suffixes.groupBy("part").agg(F.count("*").alias("n"), F.min("left").alias("lo"), F.max("left").alias("hi")).filter("lo <> hi").select("part", "n")
    return suffixes.join(sizes, "part").select("part", "n", "uid", "pos", "depth").distinct()


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of the common-prefix intervals of at least ``least``.

    ``lcp[i]`` is that of suffixes i - 1 and i; the stack holds the open
    intervals, each longer than the one below.
    """
    out, stack = [], []
    n = len(lcp)
    for i in range(1, n + 1):
        cur = int(lcp[i]) if i < n else 0
        lo = i - 1
        while stack and stack[-1][1] > cur:
            lo, length = stack.pop()
            out.append((lo, i - 1, length))
        if cur >= least and (not stack or stack[-1][1] < cur):
            stack.append((lo, cur))
    return out


#: Common-prefix length of suffixes that the words at hand don't tell apart.
OPEN = 1 << 30
_CELLS = 1 << 20


def _common(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of neighbours among the stretches of ``flat``; 0 for the first."""
    n, out = len(begin), np.zeros(len(begin), np.int64)
    m = np.minimum(size[1:], size[:-1])
    step = max(1, _CELLS // max(1, int(m.max(initial=0))))
    for lo in range(0, n - 1, step):
        part = m[lo : lo + step]
        col = np.arange(int(part.max(initial=0)))
        x = begin[lo + 1 : lo + 1 + len(part), None] + col
        y = begin[lo : lo + len(part), None] + col
        last = len(flat) - 1
        differ = (flat[np.minimum(x, last)] != flat[np.minimum(y, last)]) | (col >= part[:, None])
        out[lo + 1 : lo + 1 + len(part)] = np.where(differ.any(axis=1), differ.argmax(axis=1), part) if len(col) else 0
    return out


def _leaves(flat: np.ndarray, code: bytes, begin: np.ndarray, size: np.ndarray, more: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(order, common-prefix lengths, number of changes of the left word up to each, open runs) of suffixes.

    A suffix goes on with ``size`` words of ``flat`` from ``begin``; ``code``
    is ``flat`` as bytes that sort like it.  ``more`` says whose text goes on
    beyond them; ``left`` has the word before each suffix, a negative number of
    its own for a text's start.
    """
    keys = [code[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
    n, size, more = len(order), size[order], more[order]
    lcp = _common(flat, begin[order], size)
    # runs of equal words of which two or more go on stay one leaf
    same = np.zeros(n, bool)
    same[1:] = (size[1:] == size[:-1]) & (lcp[1:] == size[1:])
    edges = np.flatnonzero(~same)
    until = np.append(edges, n)[1:] - 1
    going = np.add.reduceat(more.astype(np.int64), edges)
    change = np.concatenate([[0], np.cumsum(left[order][1:] != left[order][:-1])])
    runs = []
    for i in np.flatnonzero((going > 1) & (until > edges)):
        lo, hi = int(edges[i]), int(until[i])
        lcp[lo + 1 : hi + 1] = OPEN
        if change[hi] > change[lo]:
            runs.append((lo, hi))
    return order, lcp, change, runs


def tree(flat: np.ndarray, code: bytes, begin: np.ndarray, size: np.ndarray, more: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(order, maximal repeats, open runs) of suffixes that share ``depth`` words already, as for _leaves()."""
    order, lcp, change, runs = _leaves(flat, code, begin, size, more, left)
    found = [(lo, hi, length - 1 + depth) for lo, hi, length in intervals(lcp + 1, 1) if length <= OPEN and change[hi] > change[lo]]
    found.sort(key=lambda r: (r[0] - r[1], r[0]))
    return order, found, runs


class _Rows:
    """Result rows and open rows of the groups of a partition."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, key: tuple[int, int], n: int, ids, uids, pos, grown, flat_size, depth: int) -> None:
        order, found, runs = grown
        if found:
            self._row(key[0], key[1], depth, ids[order], pos[order], uids[order], [dict(zip(("lo", "hi", "n_words"), x, strict=True)) for x in found], False)
        for lo, hi in runs:
            o = order[lo : hi + 1]
            part = int(tk.mix(np.array([key[1] & ((1 << 63) - 1)], np.uint64) + tk.mix(np.array([(n << 32) + lo], np.uint64)))[0] >> np.uint64(1))
            self._row(key[0], part, depth + int(flat_size[o[0]]), ids[o], pos[o], uids[o], [], True)

    def _row(self, *values) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("n_words", pa.int32())])), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, kinds, strict=True)], [x.split()[0] for x in FOUND.replace("<lo:int,hi:int,n_words:int>", "").split(", ")])


def _flat_words(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of all rows, first of each row, number in each row)."""
    w = t["words"].combine_chunks()
    w = w.chunk(0) if isinstance(w, pa.ChunkedArray) else w
    offs = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1].astype(np.int64)
    raw = w.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]].copy().view(np.uint32) if raw is not None else np.zeros(0, np.uint32)
    return flat, (offs[:-1] - offs[0]) // 4, np.diff(offs) // 4


def _in_order(c: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Rows by keys, then document and place, without repeats."""
    order = np.lexsort((c["pos"], c["uid"], c["doc_id"], *[c[k] for k in reversed(keys)]))
    keep = np.zeros(len(order), bool)
    for k in [*keys, "uid", "pos"]:
        keep |= np.diff(c[k][order], prepend=c[k][order[:1]] - 1) != 0
    return order[keep]


def _buckets(min_words: int):
    def run(batches):
        """Groups of suffixes that share their first words, from anchors' buckets in order."""
        for t in tk.whole_groups(batches, ["anchor"], 1 << 13):
            flat, base, size = _flat_words(t)
            c = {x: t[x].to_numpy().astype(np.int64) for x in _NAMES if x != "words"}
            order = _in_order(c, ["anchor"])
            c, base, size = {k: v[order] for k, v in c.items()}, base[order], size[order]
            code = flat.astype(">u4").tobytes()
            back, reach, pos = c["back"], c["reach"], c["pos"]
            of = np.repeat(np.arange(len(pos)), reach)
            off = back[of] - (np.arange(len(of)) - np.repeat(np.cumsum(reach) - reach, reach))  # words from the suffix's start to the anchor
            start = pos[of] - off
            at = base[of] + start - np.maximum(pos - back - 1, 0)[of]
            p, inv = tk._power_tables(len(flat))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * p[: len(flat)], dtype=np.uint64)])
            sh = tk.mix((upto[at + min_words] - upto[at]) * inv[at])
            left = np.where(start > 0, flat[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(of)))
            key = np.lexsort((start, of, sh, c["anchor"][of]))
            of, start, at, left, sh = of[key], start[key], at[key], left[key], sh[key]
            anchor = c["anchor"][of]
            new = np.ones(len(key), bool)
            new[1:] = (sh[1:] != sh[:-1]) | (anchor[1:] != anchor[:-1])
            edges = np.flatnonzero(new)
            diverse = np.add.reduceat((left != left[edges][np.cumsum(new) - 1]).astype(np.int64), edges) > 0
            until = np.append(edges, len(key))[1:]
            rows = _Rows()
            begin = at + min_words
            sizes = base[of] + size[of] - begin
            more = start + min_words + sizes < c["n_words"][of]
            for lo, hi in zip(edges[diverse].tolist(), until[diverse].tolist(), strict=True):
                s = slice(lo, hi)
                rows.add((int(anchor[lo]), int(sh[lo] >> np.uint64(1))), 0, c["doc_id"][of[s]], c["uid"][of[s]], start[s], tree(flat, code, begin[s], sizes[s], more[s], left[s], min_words), sizes[s], min_words)
            yield rows.batch()
            del rows, flat, code
            tk.release()

    return run


def _next(batches):
    """Open groups with their next words, from anchors' buckets in order."""
    for t in tk.whole_groups(batches, ["anchor"], 1 << 11):
        flat, begin, size = _flat_words(t)
        code = flat.astype(">u4").tobytes()
        lists = t["suffixes"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        of = np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy()))
        inner = lists.flatten()
        c = {x: t[x].to_numpy().astype(np.int64)[of] for x in ("anchor", "uid", "doc_id", "n_words")} | {x: inner.field(x).to_numpy().astype(np.int64) for x in ("part", "pos", "depth", "left")}
        order = _in_order(c, ["anchor", "part"])
        c, begin, size = {k: v[order] for k, v in c.items()}, begin[of[order]], size[of[order]]
        start = c["pos"]
        left = np.where(start > 0, c["left"], -1 - np.arange(len(start)))
        more = start + c["depth"] + size < c["n_words"]
        new = np.ones(len(start), bool)
        new[1:] = (c["anchor"][1:] != c["anchor"][:-1]) | (c["part"][1:] != c["part"][:-1])
        edges = np.flatnonzero(new)
        rows = _Rows()
        for lo, hi in zip(edges.tolist(), np.append(edges, len(start))[1:].tolist(), strict=True):
            s = slice(lo, hi)
            depth = int(c["depth"][lo])
            rows.add((int(c["anchor"][lo]), int(c["part"][lo])), 1, c["doc_id"][s], c["uid"][s], start[s], tree(flat, code, begin[s], size[s], more[s], left[s], depth), size[s], depth)
        yield rows.batch()
        del rows, flat, code, inner, lists
        tk.release()


def _bounds(words: list[bytes], per: int) -> tuple[list[tuple[bytes, int]], list[int], list[int]]:
    """(lower bounds of all ranges but the first, number of the first piece of each range, pieces) from a sample's words.

    A bound (words, 0) lets these words in, (words, 1) what comes after them.
    """
    bounds, pieces, held = [], [1], 0
    words = sorted(words)
    lo = 0
    while lo < len(words):
        hi = bisect.bisect_right(words, words[lo], lo)
        if hi - lo >= max(2, per):
            bounds += [(words[lo], 0), (words[lo], 1)]
            pieces += [-(-(hi - lo) // per), 1]
            held = 0
        else:
            if held + hi - lo > per:
                bounds.append((words[lo], 0))
                pieces.append(1)
                held = 0
            held += hi - lo
        lo = hi
    return bounds, [0, *np.cumsum(pieces).tolist()], pieces


def _ranged(known: dict):
    """RANGED of SUFFIXES: the range of its group that each is in; run is that of words with a range of their own, else -1."""

    def run(batches):
        for batch in batches:
            bucket, runs = [], []
            piece = tk.mix(batch.column("uid").to_numpy().view(np.uint64) + tk.mix(batch.column("pos").to_numpy().astype(np.uint64))) >> np.uint64(1)
            for part, words, p in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), piece.tolist(), strict=True):
                bounds, starts, pieces = known.value.get(part, ([], [0], [1]))
                i = bisect.bisect_left(bounds, (words, 0.5))
                bucket.append(starts[i] + p % pieces[i])
                own = 0 < i < len(bounds) and bounds[i - 1][0] == bounds[i][0]
                runs.append(starts[i] if own else -1)
            cols = {"bucket": pa.array(bucket, pa.int32()), "run": pa.array(runs, pa.int32())}
            names = [x.split()[0] for x in RANGED.split(", ")]
            yield pa.RecordBatch.from_arrays([cols[x] if x in cols else batch.column(x) for x in names], names)

    return run


def _chains(lcp: np.ndarray) -> np.ndarray:
    """The first place, and those of the strict running minima from either end of the others."""
    inner = lcp[1:]
    if not len(inner):
        return np.zeros(1, np.int64)
    low = np.minimum.accumulate(inner)
    high = np.minimum.accumulate(inner[::-1])[::-1]
    at = np.append(True, low[1:] < low[:-1]) | np.append(high[:-1] < high[1:], True)
    return np.concatenate([[0], np.flatnonzero(at) + 1])


def _range_trees(batches):
    """RANGE of RANGED rows in order: intervals inside a range, and what intervals over its ends depend on."""
    for t in tk.whole_groups(batches, ["part", "bucket"], 1 << 13):
        flat, begin, size = _flat_words(t)
        code = flat.tobytes()  # they sort like words already
        c = {x: t[x].to_numpy().astype(np.int64) for x in ("part", "bucket", "uid", "doc_id", "pos", "depth", "left", "more", "run")}
        order = _in_order(c, ["part", "bucket"])
        c, begin, size = {k: v[order] for k, v in c.items()}, begin[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (c["part"][1:] != c["part"][:-1]) | (c["bucket"][1:] != c["bucket"][:-1])
        edges = np.flatnonzero(new)
        out = []
        for lo, hi in zip(edges.tolist(), np.append(edges, len(order))[1:].tolist(), strict=True):
            s = slice(lo, hi)
            own = {k: v[s] for k, v in c.items()}
            part, bucket, run, depth = (int(own[k][0]) for k in ("part", "bucket", "run", "depth"))
            at, n, left = begin[s], hi - lo, own["left"]
            found, opened = [], []
            if run >= 0:  # all words equal; whether they are open shows when all pieces are known
                o = np.arange(n)
                change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
                lcp = np.full(n, -1)
                opened = [(_own_part(part, run, 0), 0, n - 1, depth + int(size[lo]))]
            else:
                o, lcp, change, runs = _leaves(flat, code, at, size[s], own["more"] > 0, left)
                found = [(x, y, length - 1 + depth) for x, y, length in intervals(lcp + 1, 1) if 0 < x and y < n - 1 and length <= OPEN and change[y] > change[x]]
                opened = [(_own_part(part, bucket, x + 1), x, y, depth + int(size[s][o[x]])) for x, y in runs]
            points = [(int(i), int(lcp[i]), int(change[max(i - 1, 0)]), int(change[i])) for i in _chains(lcp)]
            word = lambda i: code[4 * at[o[i]] : 4 * (at[o[i]] + size[s][o[i]])]  # noqa: B023, E731
            out.append({
                "part": part, "bucket": bucket, "run": run, "depth": depth, "doc_ids": own["doc_id"][o], "positions": own["pos"][o], "uids": own["uid"][o], "lefts": left[o],
                "repeats": [dict(zip(("lo", "hi", "n_words"), x, strict=True)) for x in found], "open": [dict(zip(("part", "lo", "hi", "depth"), x, strict=True)) for x in opened],
                "ends": {"n": n, "found": len(found), "going": int(own["more"].sum()), "size": int(size[lo]), "first": word(0), "last": word(n - 1), "first_left": int(left[o[0]]), "last_left": int(left[o[-1]])},
                "points": [dict(zip(("at", "lcp", "before", "upto"), x, strict=True)) for x in points],
            })
        names = [f.name for f in _RANGE]
        yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in out], f.type) for f in _RANGE], names)
        del out, flat, code
        tk.release()


_I, _L, _B = pa.int32(), pa.int64(), pa.binary()
_RANGE = pa.schema([
    ("part", _L), ("bucket", _I), ("run", _I), ("depth", _I), ("doc_ids", pa.list_(_L)), ("positions", pa.list_(_I)), ("uids", pa.list_(_L)), ("lefts", pa.list_(_L)),
    ("repeats", pa.list_(pa.struct([("lo", _I), ("hi", _I), ("n_words", _I)]))), ("open", pa.list_(pa.struct([("part", _L), ("lo", _I), ("hi", _I), ("depth", _I)]))),
    ("ends", pa.struct([("n", _I), ("found", _I), ("going", _I), ("size", _I), ("first", _B), ("last", _B), ("first_left", _L), ("last_left", _L)])),
    ("points", pa.list_(pa.struct([("at", _I), ("lcp", _I), ("before", _I), ("upto", _I)]))),
])
_MERGED = pa.schema([("part", _L), ("bucket", _I), ("base", _I), ("goes_on", pa.bool_()), ("spans", pa.list_(pa.struct([("at", _I), ("last", _I), ("n_words", _I)]))), ("any", pa.bool_())])


def _own_part(part: int, bucket: int, lo: int) -> int:
    return int(tk.mix(np.array([part & ((1 << 63) - 1)], np.uint64) + tk.mix(np.array([(bucket << 32) + lo], np.uint64) + np.uint64(1 << 63)))[0] >> np.uint64(1))


def _merge(t: pa.Table) -> pa.Table:
    """MERGED of a group's ranges: their first ranks, and the maximal repeats that reach the end of one."""
    rows = t.sort_by("bucket").to_pylist()
    depth = rows[0]["depth"]
    going: dict[int, int] = {}
    for r in rows:
        if r["run"] >= 0:
            going[r["run"]] = going.get(r["run"], 0) + r["ends"]["going"]
    at, value, before, upto = [], [], [], []
    base, total, bases = 0, 0, []
    for i, r in enumerate(rows):
        e, lcp, prior = r["ends"], 0, total
        last = rows[i - 1] if i else None
        inside = OPEN if going.get(r["run"], 0) > 1 else e["size"]
        if last is not None:
            if r["run"] >= 0 and last["run"] == r["run"]:
                lcp = inside
            else:
                x, y = (np.frombuffer(z, ">u4") for z in (last["ends"]["last"], e["first"]))
                m = min(len(x), len(y))
                differ = np.flatnonzero(x[:m] != y[:m])
                lcp = int(differ[0]) if len(differ) else m
            total += int(last["ends"]["last_left"] != e["first_left"])
        for k, p in enumerate(r["points"]):
            at.append(base + p["at"])
            value.append((inside if p["lcp"] < 0 else p["lcp"]) if k else lcp)
            before.append(total + p["before"] if k else prior)
            upto.append(total + p["upto"])
        total += r["points"][-1]["upto"]
        bases.append(base)
        base += e["n"]
    spans: list[list] = [[] for _ in rows]
    stack: list[tuple[int, int]] = []
    ends = np.array([b + r["ends"]["n"] - 1 for b, r in zip(bases, rows, strict=True)])
    for k in range(1, len(at) + 1):
        cur, stop, seen = (value[k] + 1, at[k], before[k]) if k < len(at) else (0, base, total)
        lo = k - 1
        while stack and stack[-1][1] > cur:
            lo, length = stack.pop()
            first, last = at[lo], stop - 1
            i = int(np.searchsorted(ends, first))
            inside = rows[i]["run"] < 0 and bases[i] < first and last < ends[i]
            if not inside and length <= OPEN and seen > upto[lo]:
                spans[i].append({"at": first - bases[i], "last": last, "n_words": length - 1 + depth})
        if cur >= 1 and (not stack or stack[-1][1] < cur):
            stack.append((lo, cur))
    some = any(spans) or any(r["ends"]["found"] for r in rows)
    out = [(r["part"], r["bucket"], b, r["run"] >= 0 and going[r["run"]] > 1, s, some) for r, b, s in zip(rows, bases, spans, strict=True)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MERGED, strict=True)], schema=_MERGED)


def _ranks(batches):
    """RESULT rows of a hot group's ranges."""
    for batch in batches:
        for r in batch.to_pylist():
            n, base = len(r["doc_ids"]), r["base"]
            each: dict[int, list] = {}
            for x in r["repeats"]:
                each.setdefault(x["lo"], []).append({"last": base + x["hi"], "n_words": x["n_words"]})
            for x in r["spans"]:
                each.setdefault(x["at"], []).append({"last": x["last"], "n_words": x["n_words"]})
            group = int(tk.signed(tk.mix(np.array([r["part"]]).view(np.uint64) + tk.mix(np.array([r["part"]]).view(np.uint64))))[0])
            lists = [sorted(each.get(i, ()), key=lambda x: x["n_words"]) for i in range(n)]
            kind = pa.list_(pa.struct([("last", _I), ("n_words", _I)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group)), pa.array(np.arange(base, base + n, dtype=np.int32)), pa.array(r["doc_ids"], _L), pa.array(r["positions"], _I), pa.array(lists, kind)], ["group_id", "rank", "doc_id", "position", "repeats"])


def _sorted_groups(suffixes: DataFrame, hot: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """(RESULT rows of hot groups of SUFFIXES, the suffixes that are open (part, uid, pos, depth, left))."""
    held, drop = stored(suffixes)
    per = max(1, min(hot // 2, RANGE_WORDS // reach))
    share = max(1, per // SAMPLED)
    sample = held.filter(F.pmod(F.xxhash64("uid", "pos"), F.lit(share)) == 0).select("part", "words").toArrow()
    by: dict[int, list[bytes]] = {}
    for part, words in zip(sample["part"].to_pylist(), sample["words"].to_pylist(), strict=True):
        by.setdefault(part, []).append(words)
    known = suffixes.sparkSession.sparkContext.broadcast({part: _bounds(words, max(1, per // share)) for part, words in by.items()})
    ranges = held.mapInArrow(_ranged(known), RANGED).repartition("part", "bucket").sortWithinPartitions("part", "bucket").mapInArrow(_range_trees, RANGE)
    ranges, _ = stored(ranges)
    drop()
    merged = cut(ranges.select("part", "bucket", "run", "depth", "ends", "points").groupBy("part").applyInArrow(_merge, MERGED))
    found = ranges.select("part", "bucket", "doc_ids", "positions", "repeats").join(merged.filter("any").select("part", "bucket", "base", "spans"), ["part", "bucket"]).mapInArrow(_ranks, RESULT)
    on = ranges.join(merged.select("part", "bucket", "goes_on"), ["part", "bucket"]).filter("run < 0 OR goes_on").select(F.explode("open").alias("o"), "uids", "positions", "lefts")
    members = F.explode(F.sequence(F.col("o.lo"), F.col("o.hi"))).alias("i")
    on = on.select("o", members, "uids", "positions", "lefts").select(F.col("o.part").alias("part"), F.col("uids")[F.col("i")].alias("uid"), F.col("positions")[F.col("i")].alias("pos"), F.col("o.depth").alias("depth"), F.col("lefts")[F.col("i")].alias("left"))
    return found, on


def _unpacked(batches):
    """A row for each suffix of each group."""
    for batch in batches:
        ids, reps = batch.column("doc_ids"), batch.column("repeats")
        n, m = np.diff(ids.offsets.to_numpy()), np.diff(reps.offsets.to_numpy())
        starts = np.cumsum(n) - n
        key = [batch.column(c).to_numpy().view(np.uint64) for c in ("anchor", "part")]
        group = tk.signed(tk.mix(key[0] + tk.mix(key[1])))
        rank = np.arange(int(n.sum())) - np.repeat(starts, n)
        inner = reps.flatten()
        lo, hi, size = (inner.field(x).to_numpy() for x in ("lo", "hi", "n_words"))
        at = np.repeat(starts, m) + lo
        order = np.lexsort((size, at))
        upto = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(rank)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(hi[order]), pa.array(size[order])], ["last", "n_words"]))
        columns = [pa.array(np.repeat(group, n)), pa.array(rank.astype(np.int32)), ids.flatten(), batch.column("positions").flatten(), lists]
        yield pa.RecordBatch.from_arrays(columns, ["group_id", "rank", "doc_id", "position", "repeats"])


def _next_words(src: DataFrame, todo: DataFrame, reach: int) -> DataFrame:
    """CONTINUED of ``todo(anchor, part, depth, uid, pos)``.

    The suffixes of a bucket that are open in a document mostly end at one
    place: its next words are sent once.
    """
    todo = todo.select("uid", "anchor", (F.col("pos") + F.col("depth")).alias("end"), F.struct("part", "pos", "depth").alias("s"))
    todo = todo.groupBy("uid", "anchor", "end").agg(F.collect_set("s").alias("s")).groupBy("uid").agg(F.collect_list(F.struct("anchor", "end", "s")).alias("at"))
    return src.join(todo, "uid").select("uid", "doc_id", "text", "at").mapInArrow(_continuations(reach), CONTINUED)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR, reach: int = REACH, hot: int = HOT) -> DataFrame:
    """RESULT: the suffixes of each group with the maximal repeats that start the order there."""
    src = _source(docs)
    every, drop_every = stored(anchors(docs, min_words, k))
    diverse = every.groupBy("anchor").agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.count("*").alias("n")).filter("n > 1 AND lo <> hi").select("anchor", (F.col("n") > hot).alias("hot"))
    places = lambda test: F.array_distinct(F.collect_list(F.when(test, F.col("pos"))))
    wanted = every.join(diverse, "anchor").groupBy("uid").agg(places(~F.col("hot")).alias("at"), places(F.col("hot")).alias("hot_at"))
    listed, drop_listed = stored(src.join(wanted, "uid").select("uid", "doc_id", "text", "at", "hot_at"))
    drop_every()
    src = listed.select("uid", "doc_id", "text")  # no other text can be open later, so none other is moved again
    stretches = listed.filter("size(at) > 0").select("uid", "doc_id", "text", "at").mapInArrow(_stretches(min_words, k, reach), STRETCH)
    level = cut(stretches.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_buckets(min_words), FOUND))
    keys = listed.filter("size(hot_at) > 0").select("uid", "text", "hot_at")
    large = None
    if not keys.isEmpty():
        large = cut(_diverse(keys.mapInArrow(_suffix_keys(min_words, k), SUFFIX_KEYS).withColumn("depth", F.lit(min_words))))
    done, nodes = [], []
    while True:
        done.append(level.filter("NOT open").select(*PACKED))
        todo = level.filter("open").select("anchor", "part", "depth", F.explode(F.arrays_zip("uids", "positions")).alias("x")).select("anchor", "part", "depth", F.col("x.uids").alias("uid"), F.col("x.positions").alias("pos"))
        if large is not None:  # what is no longer too large goes on as ordinary groups
            todo = todo.unionByName(large.filter(F.col("n") <= hot).select(F.col("part").alias("anchor"), "part", "depth", "uid", "pos"))
            large = large.filter(F.col("n") > hot)
            large = None if large.isEmpty() else large
        if todo.isEmpty() and large is None:
            break
        short, reach = min(reach, HOT_REACH), reach * GROWTH
        level = cut(_next_words(src, todo, reach).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_next, FOUND))
        if large is not None:
            suffixes = _next_words(src, large.select(F.col("part").alias("anchor"), "part", "depth", "uid", "pos"), short)
            node, on = _sorted_groups(suffixes.mapInArrow(_flat_suffixes, SUFFIXES), hot, short)
            nodes.append(node)
            large = cut(_diverse(on))
    drop_listed()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.mapInArrow(_unpacked, RESULT)
    for x in nodes:
        out = out.unionByName(x)
    return out


def occurrences(suffixes: DataFrame) -> DataFrame:
    """(group_id, first, n_words, doc_id, position): a row for each occurrence of each maximal repeat."""
    each = suffixes.select("group_id", F.col("rank").alias("first"), F.explode("repeats").alias("r")).select("group_id", "first", "r.last", "r.n_words")
    return each.join(suffixes.select("group_id", "rank", "doc_id", "position"), "group_id").filter("rank BETWEEN first AND last").select("group_id", "first", "n_words", "doc_id", "position")
