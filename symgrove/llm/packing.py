"""Token ids in Simple-8b words.

Each 64-bit word has a 4-bit selector in its top bits, which says how many ids
of which width fill the other 60.  A document's ids are cut into blocks of
``BLOCK`` ids, and ``block_offsets`` has the index of each block's first word,
so blocks are packed and unpacked side by side, as columns of numpy arrays,
``AT_ONCE`` blocks at a time, so that a text of any length takes no more memory.
The last word of a block may be part filled; the counts say where it ends.
Selector 0 is the escape, for an id of more than 60 bits: its place is kept by
a word of selector 0, and the id itself follows the block's packed words.

Defined cases: null, empty texts give no ids and empty words; every row of the
input gives one row, a null id included.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm import textkit as tk
from symgrove.llm.pretoken import TOKENIZER, coder, read_ranks

BLOCK = 128
AT_ONCE = 8192
SCHEMA = "doc_id long, n_ids long, words binary, block_offsets array<int>"

#: By selector: ids in a word and bits of each.  0 is the escape, 1 a run of zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each uint64."""
    high, low = (ids >> np.uint64(32)).astype(np.uint32), ids.astype(np.uint32)
    bits = np.frexp(low.astype(np.float64))[1]
    if high.any():
        bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, bits)
    return bits.astype(np.uint8)


def pack(ids: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack rows of ids: (words, first word of each block, blocks of each row).

    ``ids`` are uint64; ``counts`` says how many belong to each row.
    """
    per = -(-counts // block)
    n_blocks = int(per.sum())
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), per
    nth = np.arange(n_blocks) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(np.repeat(counts, per) - nth * block, block)
    upto = np.concatenate([[0], np.cumsum(length)])
    parts = [_pack_blocks(ids[upto[lo] : upto[min(lo + AT_ONCE, n_blocks)]], length[lo : lo + AT_ONCE], block) for lo in range(0, n_blocks, AT_ONCE)]
    sizes = np.concatenate([n for _, n in parts])
    return np.concatenate([w for w, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]), per


def _pack_blocks(ids: np.ndarray, length: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of blocks of ``length`` ids each."""
    n_blocks = len(length)
    wide = block + 120
    # a block per row, padded with zeros, so no window leaves its block
    inside = np.arange(block) < length[:, None]
    m = np.zeros((n_blocks, wide), np.uint64)
    m[:, :block][inside] = ids
    bits = np.zeros((n_blocks, wide), np.uint8)
    bits[:, :block][inside] = bit_lengths(ids)
    sel = np.zeros((n_blocks, block), np.uint8)
    most, seen = bits, 1
    for s in range(15, 0, -1):
        n = int(COUNTS[s])
        if n > seen:
            shifted = most[:, n - seen :]
            most = np.maximum(most[:, : shifted.shape[1]], shifted)
            seen = n
        sel[most[:, :block] <= WIDTHS[s]] = s
    flat_sel, flat = sel.ravel(), m.ravel()
    at, live, steps = np.zeros(n_blocks, np.int64), np.arange(n_blocks), []
    n_words = np.zeros(n_blocks, np.int64)
    while len(live):
        s = flat_sel[live * block + at[live]]
        steps.append((live, at[live], s))
        at[live] += COUNTS[s]
        n_words[live] += 1
        live = live[at[live] < length[live]]
    escapes = ((bits[:, :block] > 60) & inside).sum(axis=1)
    first = np.concatenate([[0], np.cumsum(n_words + escapes)])
    words = np.zeros(first[-1], np.uint64)
    slot = np.concatenate([first[b] + i for i, (b, _, _) in enumerate(steps)])
    place = np.concatenate([b * wide + p for b, p, _ in steps])
    chosen = np.concatenate([s for _, _, s in steps])
    for s in range(1, 16):
        here = np.flatnonzero(chosen == s)
        if not len(here):
            continue
        w = np.full(len(here), np.uint64(s) << np.uint64(60))
        for j in range(int(COUNTS[s]) if WIDTHS[s] else 0):
            w |= flat[place[here] + j] << np.uint64(WIDTHS[s] * j)
        words[slot[here]] = w
    if escapes.any():
        block_of, col = np.nonzero((bits[:, :block] > 60) & inside)
        before = np.arange(len(block_of)) - (np.cumsum(escapes) - escapes)[block_of]
        words[first[block_of] + n_words[block_of] + before] = m[block_of, col]
    return words, np.diff(first)


def unpack(words: np.ndarray, offsets: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The uint64 ids of one document; all its blocks are decoded at once."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    offsets = np.asarray(offsets, np.int64)
    n_words = np.diff(np.append(offsets, len(words)))
    of = np.repeat(np.arange(len(offsets)), n_words)
    sel = (words >> np.uint64(60)).astype(np.int64)
    holds = COUNTS[sel]
    before = np.cumsum(holds) - holds
    inside = before - before[offsets][of]
    size = np.minimum(n_ids - np.arange(len(offsets)) * block, block)
    packed = inside < size[of]  # what follows a full block is its escaped ids
    at = of * block + inside
    for s in range(1, 16):
        here = np.flatnonzero(packed & (sel == s))
        mask = (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
        for j in range(int(COUNTS[s]) if len(here) and WIDTHS[s] else 0):
            to = at[here] + j
            ok = inside[here] + j < size[of[here]]
            out[to[ok]] = (words[here[ok]] >> np.uint64(WIDTHS[s] * j)) & mask
    out[at[packed & (sel == 0)]] = words[~packed]
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int64)), pa.py_buffer(data)])


def token_blocks(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_ids, words, block_offsets) of every document; one pass, no shuffle.

    The rank file is read on the driver and broadcast (under 1 MB).
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches):
        bpe = coder(ranks.value)
        for batch in batches:
            texts = tk.string_array(batch.column(1))
            for lo, hi in tk.slices(texts):
                ids, counts = bpe.encode_batch(texts[lo:hi])
                words, first, per = pack(ids.astype(np.uint64), counts, block)
                row = np.concatenate([[0], np.cumsum(per)])
                ends = first[row]
                offsets = (first[:-1] - np.repeat(ends[:-1], per)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts), _binary(words, ends).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), pa.array(offsets))],
                    ["doc_id", "n_ids", "words", "block_offsets"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decoded(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of token_blocks(): the ids of each row, decoded in batches."""

    def run(batches):
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("n_ids", "words", "block_offsets")]
            ids = [unpack(np.frombuffer(w or b"", np.uint64), o or [], n or 0, block).view(np.int64) for n, w, o in zip(*rows, strict=True)]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, np.int64), *ids])))], ["doc_id", "ids"])

    return blocks.select("doc_id", "n_ids", "words", "block_offsets").mapInArrow(run, "doc_id long, ids array<long>")
