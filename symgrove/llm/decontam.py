"""Benchmark decontamination by a prefix-filtered containment join.

A document holds a benchmark item if some window of the document as long as
the item (in words) contains at least ``min_containment`` of the item's
distinct ``k``-word shingles.  An item with n distinct shingles then shares at
least ``need = ceil(min_containment * n)`` of them with the document, so at
least one of its ``n - need + 1`` rarest: these are looked up first, and only
where one of them is found, the item's other shingles in this document.
Rarity is the number of occurrences in the whole corpus.  The length bound
drops documents with fewer than ``need`` shingles, the positional bound keeps
only matches that can lie in one window with a prefix match, and the windows
around them are counted exactly.

A text of fewer than ``k`` words has one shingle of all its words, and is
sought as such in windows of its length.

Defined cases: null ids, null texts and texts without words match nothing.
Rows that repeat an id are judged one by one and give one result, with the
largest count.  An item of several texts has the shingles of all of them, and
windows as long as the longest.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm import textkit as tk
from symgrove.llm.runtime import cut, without_ids

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
#: Item shingles up to this number (8 bytes each) go to the executors as one
#: sorted array; beyond it the same steps run as shuffled joins.
BROADCAST_SHINGLES = 1 << 20

RESULT = "doc_id long, item_id long, n_matched long, n_shingles long"


def _source(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")


def _windows(h: np.ndarray, first: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, row, place in the row) of the windows of each of ``sizes`` words."""
    out = []
    for n in sizes:
        sh, pos, bounds = tk.shingles(h, first, n)
        row = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
        full = np.diff(first)[row] >= n
        out.append((sh[full], row[full], (pos - first[row])[full]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sliced(fn, keyed: bool = False):
    """mapInArrow function that hands the words of a slice of rows, and with ``keyed`` their third column, to ``fn``."""

    def run(batches):
        for batch in batches:
            texts, ids = pc.utf8_lower(tk.string_array(batch.column(1))), batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in tk.slices(texts):
                h, first, *_ = tk.words(texts[lo:hi])
                yield from fn(ids[lo:hi], h, first, *([batch.column(2).to_numpy()[lo:hi]] if keyed else []))

    return run


def item_shingles(benchmark: DataFrame, k: int) -> DataFrame:
    """(id, words, shingle): the shingles of each item's texts; ``words`` is the length of the longest text that has it."""

    def rows(ids, h, first):
        sh, _, bounds = tk.shingles(h, first, k)
        n = np.diff(bounds)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.repeat(np.diff(first), n)), pa.array(tk.signed(sh))], ["id", "words", "shingle"])

    return _source(benchmark, "item_id").mapInArrow(_sliced(rows), "id long, words long, shingle long").groupBy("id", "shingle").agg(F.max("words").alias("words"))


def text_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, row, n, pos, shingle): a row for each window of each text; ``row`` tells texts of one id apart, n is the text's windows."""

    def rows(ids, h, first, keys):
        sh, row, pos = _windows(h, first, sizes)
        n = np.bincount(row, minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[row]), pa.array(n[row]), pa.array(pos), pa.array(tk.signed(sh))], ["id", "row", "n", "pos", "shingle"])

    return _source(docs, "doc_id").withColumn("row", F.xxhash64("text")).mapInArrow(_sliced(rows, keyed=True), "id long, row long, n long, pos long, shingle long")


def best_window(pos: np.ndarray, what: np.ndarray, span: int) -> int:
    """Most distinct values of ``what`` at sorted positions that lie within ``span``."""
    seen: dict[int, int] = {}
    best = lo = 0
    for hi in range(len(pos)):
        seen[what[hi]] = seen.get(what[hi], 0) + 1
        while pos[hi] - pos[lo] >= span:
            seen[what[lo]] -= 1
            if not seen[what[lo]]:
                del seen[what[lo]]
            lo += 1
        best = max(best, len(seen))
    return best


def _verified(pos: np.ndarray, what: np.ndarray, rare: np.ndarray, span: int, need: int) -> int:
    """The best window's count, or 0 if it is under ``need``; positions sorted."""
    if len(pos) < need or not rare.any():
        return 0
    at = pos[rare]
    left = np.searchsorted(at, pos - span, side="right")
    near = (left < len(at)) & (at[np.minimum(left, len(at) - 1)] < pos + span)
    if near.sum() < need:
        return 0
    got = best_window(pos[near], what[near], span)
    return got if got >= need else 0


def _ranked(items: DataFrame, freq: DataFrame, min_containment: float) -> DataFrame:
    """Item shingles with n, need, words and whether each is in the item's prefix."""
    t = items.join(freq, "shingle", "left").select("id", "words", "shingle", F.coalesce("freq", F.lit(0)).alias("freq"))
    return t.withColumn("rank", F.expr("row_number() OVER (PARTITION BY id ORDER BY freq, shingle)")).withColumn("n", F.expr("count(*) OVER (PARTITION BY id)")).select(
        "id", "shingle", "n", F.ceil(F.col("n") * F.lit(min_containment) - F.lit(1e-9)).alias("need"), F.expr("max(words) OVER (PARTITION BY id)").alias("words"), "rank"
    ).withColumn("rare", F.expr("rank <= n - need + 1"))


def _spans(words, k: int):
    return np.maximum(words - k + 1, 1)


def _expanded(keys: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``sh``, entry of the sorted ``keys``) of all hits."""
    lo, hi = np.searchsorted(keys, sh), np.searchsorted(keys, sh, side="right")
    hits = np.flatnonzero(hi > lo)
    n = (hi - lo)[hits]
    return np.repeat(hits, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hits], n)


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, min_containment: float = MIN_CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_matched, n_shingles) of each document that holds an item."""
    items = cut(item_shingles(benchmark, k))
    sizes = sorted({k, *(r["words"] for r in items.filter(F.col("words") < k).select("words").distinct().collect())})
    vocabulary = items.select("shingle").distinct()
    if vocabulary.count() > broadcast_shingles:
        return _by_joins(docs, items, sizes, k, min_containment)
    sc = docs.sparkSession.sparkContext
    voc = np.sort(vocabulary.toPandas()["shingle"].to_numpy(np.int64))
    if not len(voc):
        return docs.sparkSession.createDataFrame([], RESULT)
    shared = sc.broadcast(voc)

    def count(ids, h, first):
        v, sh = shared.value, tk.signed(_windows(h, first, sizes)[0])
        at = np.minimum(np.searchsorted(v, sh), len(v) - 1)
        n = np.bincount(at[v[at] == sh], minlength=len(v))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(v[hit]), pa.array(n[hit])], ["shingle", "freq"])

    src = _source(docs, "doc_id")
    freq = src.mapInArrow(_sliced(count), "shingle long, freq long").groupBy("shingle").agg(F.sum("freq").alias("freq"))
    ranked = _ranked(items, freq, min_containment).toPandas().sort_values(["shingle", "id"])
    names, of = np.unique(ranked["id"].to_numpy(np.int64), return_inverse=True)
    per = np.zeros((3, len(names)), np.int64)  # need, n and span of each item
    per[:, of] = ranked["need"].to_numpy(), ranked["n"].to_numpy(), _spans(ranked["words"].to_numpy(), k)
    table = sc.broadcast((ranked["shingle"].to_numpy(np.int64), of, ranked["rare"].to_numpy(bool), names, per))

    def verify(ids, h, first):
        keys, item, rare, names, (need, total, span) = table.value
        sh, row, pos = _windows(h, first, sizes)
        sh, n_windows = tk.signed(sh), np.bincount(row, minlength=len(ids))
        at, entry = _expanded(keys[rare], sh)
        wanted = np.unique(row[at] * len(names) + item[rare][entry])  # texts and items with a shingle of the prefix
        wanted = wanted[n_windows[wanted // len(names)] >= need[wanted % len(names)]]  # length bound
        inside = np.flatnonzero(np.isin(row, wanted // len(names)))
        at, entry = _expanded(keys, sh[inside])
        at = inside[at]
        pair = row[at] * len(names) + item[entry]
        ok = np.isin(pair, wanted)
        at, entry, pair = at[ok], entry[ok], pair[ok]
        order = np.lexsort((pos[at], pair))
        at, entry, pair = at[order], entry[order], pair[order]
        edges = np.flatnonzero(np.diff(pair, prepend=-1))
        found: list[tuple] = []
        for a, b in zip(edges.tolist(), np.append(edges, len(pair))[1:].tolist(), strict=True):  # none where nothing was hit
            d, i = divmod(int(pair[a]), len(names))
            got = _verified(pos[at[a:b]], sh[at[a:b]], rare[entry[a:b]], int(span[i]), int(need[i]))
            if got:
                found.append((int(ids[d]), int(names[i]), got, int(total[i])))
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(4)], ["doc_id", "item_id", "n_matched", "n_shingles"])

    return _once(src.mapInArrow(_sliced(verify), RESULT))


def _once(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_matched").alias("n_matched")).select("doc_id", "item_id", "n_matched", "n_shingles")


def _by_joins(docs: DataFrame, items: DataFrame, sizes: list[int], k: int, min_containment: float) -> DataFrame:
    """The same result where the benchmark is too large to hand to every task; windows that no item has are dropped by the first join."""
    hits = cut(text_shingles(docs, sizes).join(items.select("shingle").distinct(), "shingle", "left_semi"))
    freq = hits.groupBy("shingle").agg(F.count("*").alias("freq"))
    ranked = cut(_ranked(items, freq, min_containment).withColumnsRenamed({"id": "item_id", "words": "item_words", "n": "total"}))
    candidates = hits.join(ranked.filter("rare"), "shingle").filter("n >= need").select("id", "row", "item_id").distinct()

    def verify(pdf):
        import pandas as pd  # here, so that workers of the other path don't hold it

        pdf = pdf.drop_duplicates(["pos", "shingle"]).sort_values("pos")
        first = pdf.iloc[0]
        got = _verified(pdf["pos"].to_numpy(), pdf["shingle"].to_numpy(), pdf["rare"].to_numpy(bool), int(_spans(first["item_words"], k)), int(first["need"]))
        return pd.DataFrame([(first["id"], first["item_id"], got, first["total"])] if got else [], columns=["doc_id", "item_id", "n_matched", "n_shingles"])

    return _once(hits.join(candidates, ["id", "row"]).join(ranked, ["item_id", "shingle"]).groupBy("id", "row", "item_id").applyInPandas(verify, RESULT))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that hold no benchmark item."""
    return without_ids(docs, contained_items(docs, benchmark, **kw).select("doc_id"))


def oracle(k: int = SHINGLE_WORDS, min_containment: float = MIN_CONTAINMENT) -> str:
    """DuckDB SQL for contained_items(documents, benchmark)."""

    words = lambda table, key: f"SELECT {key} AS id, regexp_extract_all(lower(text), '{tk.WORD_RE_SQL}') AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL"
    grams = "SELECT id, len(w) AS n_words, p AS pos, array_to_string(list_slice(w, p + 1, p + n), ' ') AS g FROM (SELECT id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM {0} WHERE len(w) >= n)"
    return f"""
    WITH bw AS ({words("benchmark", "item_id")}), dw AS ({words("documents", "doc_id")}),
    s0 AS (SELECT {k} AS n UNION SELECT len(w) FROM bw WHERE len(w) BETWEEN 1 AND {k - 1}),
    i AS (SELECT id, g, max(n_words) AS n_words FROM ({grams.format(f"(SELECT *, least(len(w), {k}) AS n FROM bw WHERE len(w) > 0)")}) GROUP BY id, g),
    d AS ({grams.format("(SELECT * FROM dw, s0)")}),
    s AS (SELECT id, count(*) AS n, max(n_words) AS words FROM i GROUP BY id),
    m AS (SELECT d.id AS doc_id, i.id AS item_id, d.pos, d.g, greatest(s.words - {k - 1}, 1) AS span FROM d JOIN i ON d.g = i.g JOIN s ON s.id = i.id),
    v AS (SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT b.g) AS c
          FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + a.span
          GROUP BY a.doc_id, a.item_id, a.pos)
    SELECT v.doc_id, v.item_id, max(v.c) AS n_matched, max(s.n) AS n_shingles
    FROM v JOIN s ON s.id = v.item_id GROUP BY v.doc_id, v.item_id
    HAVING max(v.c) >= ceil(max(s.n) * {min_containment} - 1e-9)"""
