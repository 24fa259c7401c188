"""Byte-pair encoding of whole batches through their distinct pre-tokens.

The pre-token boundaries of ``PATTERN`` follow from the classes of neighbouring
characters, so they are found for a batch at once with numpy.  Only pre-tokens
that a worker has not met before reach the tokenizer; all others are copied
from its cache.  Rows with characters outside the blocks below, on whose
classes Unicode versions may disagree, go through the tokenizer whole.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa

from symgrove.llm import textkit as tk

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers; beyond it the cache starts anew.
CACHE = 1 << 20

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x205F, *range(0x2000, 0x200B), 0x3000]
_SURE = [(0, 0x250), (0x370, 0x530), (0x2000, 0x2065), (0x3000, 0x30FF), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]
_table: list[np.ndarray] = []
_coders: dict[bytes, Coder] = {}


def classes() -> np.ndarray:
    if not _table:
        t = np.full(0x10000, UNSURE, np.uint8)
        for lo, hi in _SURE:
            for c in range(lo, hi):
                kind = unicodedata.category(chr(c))
                if kind != "Cn":
                    t[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        t[_WHITE] = SPACE
        _table.append(t)
    return _table[0]


def boundaries(cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a pre-token starts at each character, class of each); rows: offsets in characters."""
    n = len(cp)
    cls = classes()[np.minimum(cp, 0xFFFF)]
    cls[cp > 0xFFFF] = UNSURE
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    at_row = rows[:-1][rows[:-1] < n]
    start[at_row] = True
    edge = np.zeros(n + 1, bool)  # a row starts here
    edge[rows] = True
    space = cls == SPACE
    # where a run of spaces meets other text, its last character goes with that text if it is ' ', else alone
    turn = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) if n else np.zeros(0, np.int64)
    start[turn] = True
    start[turn[cp[turn] == 32] + 1] = False
    quote = np.flatnonzero((cp[:-1] == 39) & (cls[1:] == LETTER) & start[:-1] & ~edge[1:n]) if n else turn
    if len(quote):
        one, two = cp[quote + 1], cp[np.minimum(quote + 2, n - 1)]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for q, size in ((quote[short], 1), (quote[long], 2)):
            start[q + 1] = False
            after = q + 1 + size
            start[after[after < n]] = True
    return start, cls


class Coder:
    """A tokenizer with the pre-tokens it has met; one for each Python worker."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.tokenizer = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.keys, self.nth = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.tokenizer.encode_to_numpy(text, disallowed_special=())

    def _known(self, hashes: np.ndarray, data: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache entries of pre-tokens, after adding those not yet there."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHE:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if new.any():
            which = first[new]
            encode = self.tokenizer.encode_ordinary
            got = [encode(str(data[a:b], "utf-8")) for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self.nth = np.insert(self.nth, at[new], len(self.ends) - 1 + np.arange(len(got)))
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            at = np.searchsorted(self.keys, distinct)
        return self.nth[at][back]

    def pieces(self, texts: pa.Array):
        """(data, starts, ends, first, entries, sizes, char_starts, safe) of the pre-tokens of a slice.

        Row i owns the pre-tokens first[i] to first[i + 1].  ``safe`` marks
        those that start with white space after other text: whatever stands
        on either side, a pre-token starts there.  Rows that are unsure have
        none; ``unsure`` lists them.
        """
        data, offs = tk.buffers(texts)
        lead = (data & 0xC0) != 0x80
        byte_of = np.flatnonzero(lead)
        rows = np.searchsorted(byte_of, offs)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        start, cls = boundaries(cp, rows)
        odd = cls == UNSURE
        unsure = np.zeros(0, np.int64)
        if odd.any():
            unsure = np.unique(np.searchsorted(rows, np.flatnonzero(odd), side="right") - 1)
            for i in unsure:
                start[rows[i] : rows[i + 1]] = False
        chars = np.flatnonzero(start)
        starts = byte_of[chars]
        first = np.searchsorted(chars, rows)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        last = first[1:][np.diff(first) > 0] - 1
        ends[last] = offs[1:][np.diff(first) > 0]
        entries = self._known(tk.span_hashes(data, starts, ends), memoryview(data), starts, ends)
        sizes = (self.ends[entries + 1] - self.ends[entries]) if len(entries) else np.zeros(0, np.int64)
        space = cls == SPACE
        safe = np.zeros(len(cp), bool)
        safe[1:] = space[1:] & ~space[:-1]
        return first, entries, sizes, chars - np.repeat(rows[:-1], np.diff(first)), safe[chars], unsure, np.diff(rows)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids in each row)."""
        first, entries, sizes, _, _, unsure, _ = self.pieces(texts)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        counts = upto[first[1:]] - upto[first[:-1]]
        at = np.arange(upto[-1]) + np.repeat(self.ends[entries] - upto[:-1], sizes)
        ids = self.ids[at]
        if len(unsure):
            parts, done = [], 0
            for i in unsure:
                own = self.encode(texts[int(i)].as_py())
                parts += [ids[done : upto[first[i]]], own]
                done, counts[i] = upto[first[i]], len(own)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts


def coder(ranks: bytes) -> Coder:
    """The coder of a rank file's content."""
    key = hashlib.sha256(ranks).digest()
    if key not in _coders:
        _coders[key] = Coder(ranks)
    return _coders[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
