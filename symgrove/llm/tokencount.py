"""Token counts that follow edits.

A document is cut into leaves of about ``LEAF`` characters, always before
white space that follows other text: no pre-token of the byte-pair tokenizer
crosses such a place, so the tokens of the leaves add up to those of the
document.  A segment tree over the leaves holds sums of characters and tokens.
An edit finds its place by the character sums, re-encodes the leaves it
touches together with those that hold the character before and the one after
it (the boundary context), and updates the sums on the way to the root.  Text
that no edit touches is never encoded again.

``build_trees`` makes the trees, ``apply_edits`` applies an edit log to them.
An edit (seq, pos, len, text) replaces ``len`` characters at ``pos`` of the
text as the edits before it left it.

Defined cases: a null text counts as empty.  Edits apply by (seq, pos, len,
text), a null seq being 0, so that edits of one seq apply by position; a null position is the end of the text, a position or length beyond the
end is cut to it, a negative one is 0, a null insertion is empty.  A null edit
or list of edits changes nothing.  Every row of the input gives one row, null
and repeated ids included.  Columns other than those named aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm import textkit as tk
from symgrove.llm.pretoken import TOKENIZER, coder, read_ranks

LEAF = 256
EDIT = "struct<seq:int,pos:long,len:long,text:string>"
TREES = f"doc_id long, text string, edits array<{EDIT}>, leaf_chars array<int>, leaf_tokens array<int>"
COUNTS = "doc_id long, n_tokens long, n_tokens_after long, n_leaves int, n_leaves_encoded int, n_chars_after long, chars_encoded long"
#: The white space of the tokenizer's pattern.
_CUT = re.compile("(?<=[^\t-\r \x85\xa0  -     　])[\t-\r \x85\xa0  -     　]")


def cut_leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The leaves of one text."""
    out, start, cell = [], 0, 0
    for m in _CUT.finditer(text):
        if m.start() // leaf != cell:
            out.append(text[start : m.start()])
            start, cell = m.start(), m.start() // leaf
    return [*out, text[start:]]


class Tree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, texts: list[str], tokens: list[int], count):
        self.count, self.encoded, self.chars_encoded = count, 0, 0
        self._build(texts, tokens)

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        self.texts = texts
        self.half = 1 << max(0, (len(texts) - 1).bit_length())
        self.sums = [0] * (2 * self.half)  # characters
        self.tokens = [0] * (2 * self.half)
        self.sums[self.half : self.half + len(texts)] = map(len, texts)
        self.tokens[self.half : self.half + len(texts)] = tokens
        for i in range(self.half - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, pos: int) -> tuple[int, int]:
        """(leaf with character ``pos``, position in it)."""
        i = 1
        while i < self.half:
            i *= 2
            if pos >= self.sums[i]:
                pos -= self.sums[i]
                i += 1
        return i - self.half, pos

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        i = leaf + self.half
        chars, tokens = len(text) - self.sums[i], tokens - self.tokens[i]
        while i:
            self.sums[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def replace(self, pos: int, size: int, text: str) -> None:
        n = self.sums[1]
        pos = min(max(pos, 0), n)
        size = min(max(size, 0), n - pos)
        if not size and not text:
            return
        if not n:
            first, at, last = 0, 0, 0
        else:
            first, at = self.find(max(pos - 1, 0))
            at += pos - max(pos - 1, 0)
            last, _ = self.find(min(pos + size, n - 1))
        region = "".join(self.texts[first : last + 1])
        region = region[:at] + text + region[at + size :]
        tokens = self.count(region)
        self.encoded += last - first + 1
        self.chars_encoded += len(region)
        for i in range(first + 1, last + 1):
            self._set(i, "", 0)
        self._set(first, region, tokens)
        if len(region) > 16 * LEAF and len(leaves := cut_leaves(region)) > 1:  # outgrown: cut it and renumber
            texts = [*self.texts[:first], *leaves, *self.texts[last + 1 :]]
            old = self.tokens[self.half : self.half + len(self.texts)]
            self._build(texts, [*old[:first], *map(self.count, leaves), *old[last + 1 :]])


def edit_log(docs: DataFrame, every: int = 2048) -> DataFrame:
    """(doc_id, text, edits): a log of one edit and another for each ``every`` characters.

    A stand-in for an editor's log where there is none: places, lengths up to
    39 and the inserted text (up to 39 characters of the document) come from
    hashes of the id.
    """
    n = F.length("text")
    at = lambda i, what, m: F.pmod(F.xxhash64("doc_id", i, F.lit(what)), F.greatest(m, F.lit(1)))
    one = lambda i: F.struct(i.cast("int").alias("seq"), at(i, "pos", n + 1).cast("long").alias("pos"), at(i, "len", F.lit(40)).cast("long").alias("len"), F.col("text").substr((at(i, "from", n) + 1).cast("int"), at(i, "size", F.lit(40)).cast("int")).alias("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.withColumn("edits", F.transform(F.sequence(F.lit(1), (F.lit(1) + n / F.lit(every)).cast("int")), one))


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, edits) from documents and a log of rows (doc_id, seq, pos, len, text)."""
    per = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), F.col("pos").cast("long").alias("pos"), F.col("len").cast("long").alias("len"), F.col("text").cast("string").alias("text"))).alias("edits"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(per, "doc_id", "left")


def build_trees(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text, edits, leaf_chars, leaf_tokens): every text encoded once, in batches."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches):
        bpe = coder(ranks.value)
        for batch in batches:
            texts = tk.string_array(batch.column(1))
            for lo, hi in tk.slices(texts):
                part = texts[lo:hi]
                first, _, sizes, at, safe, unsure, n_chars = bpe.pieces(part)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                # the first safe cut in each cell of LEAF characters starts a leaf
                heads = np.flatnonzero(safe & (at // LEAF > 0))
                cell = row[heads] * (int(n_chars.max(initial=0)) // LEAF + 1) + at[heads] // LEAF
                heads = heads[np.diff(cell, prepend=-1) > 0]
                heads = np.union1d(heads, first[:-1][np.diff(first) > 0]).astype(np.int64)
                tokens = np.add.reduceat(sizes, heads) if len(heads) else np.zeros(0, np.int64)
                mine = row[heads]
                per = np.bincount(mine, minlength=hi - lo)
                end = np.append(at[heads[1:]], 0)
                final = np.diff(mine, append=-1) != 0
                end[final] = n_chars[mine[final]]
                chars = end - at[heads]
                lists = [(chars, tokens)]
                if len(unsure):
                    lists, done = [], 0
                    upto = np.concatenate([[0], np.cumsum(per)])
                    for i in unsure:
                        own = cut_leaves(part[int(i)].as_py())
                        lists += [(chars[done : upto[i]], tokens[done : upto[i]]), (np.array([len(x) for x in own]), np.array([len(bpe.encode(x)) for x in own]))]
                        done = upto[i]
                    for i in unsure:
                        per[i] = len(cut_leaves(part[int(i)].as_py()))
                    lists.append((chars[done:], tokens[done:]))
                offs = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
                leaf = [pa.ListArray.from_arrays(offs, pa.array(np.concatenate([x[i] for x in lists]).astype(np.int32))) for i in range(2)]
                rows = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rows, *leaf], ["doc_id", "text", "edits", "leaf_chars", "leaf_tokens"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "edits").mapInArrow(run, TREES)


def apply_edits(trees: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts before and after the edits of each row, and what was encoded for it."""
    ranks = trees.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches):
        bpe = coder(ranks.value)
        count = lambda text: len(bpe.tokenizer.encode_ordinary(text))
        for batch in batches:
            out = []
            for doc_id, text, edits, chars, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.cumsum([0, *chars]).tolist()
                tree = Tree([text[a:b] for a, b in zip(ends, ends[1:], strict=False)] or [""], list(tokens) or [0], count)
                before, leaves = tree.tokens[1], len(chars)
                todo = [(e["seq"] or 0, tree.sums[1] if e["pos"] is None else e["pos"], e["len"] or 0, e["text"] or "", e["pos"] is None) for e in edits or () if e]
                for _, pos, size, new, at_end in sorted(todo):
                    tree.replace(tree.sums[1] if at_end else pos, size, new)
                out.append((doc_id, before, tree.tokens[1], leaves, tree.encoded, tree.sums[1], tree.chars_encoded))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return trees.mapInArrow(run, COUNTS)


def edited_counts(docs_with_edits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """build_trees and apply_edits in one."""
    return apply_edits(build_trees(docs_with_edits, tokenizer), tokenizer)
