"""Language identification by interpolated Kneser-Ney character models.

One model of ``ORDER`` = 4 characters for each language, counted over all
labelled documents but every ``HELD_OUT``-th: the highest order has counts, the
lower ones continuation counts, each with its own absolute discount, down to a
uniform share for unseen characters.  A model is two sorted arrays of 64-bit
hashes, of n-grams with their log probabilities and of histories with their
back-off weights.  All n-grams count: discounts and continuation counts are
aggregated in Spark, and the models are cut by the character before the last
into pieces of about ``PIECE_GRAMS`` 4-grams (one, where they are few; more
where one character has more).  All that the score of a 4-gram takes, but the
single characters, is in one piece, so that a pass for each piece gives its
share of every text's sum.  A text goes to the language of the lowest cross-entropy per
character, if that is within what the held-out documents of this language and
of about this length show; else it is rejected.

Text is lower-cased; each run of other characters than letters counts as one
space, and texts start and end with one.

The limit of a language and length class (powers of 2) is the quantile
``1 - FALSE_REJECTS`` of the held-out cross-entropies.  Where a class has
fewer documents than that takes, the limit is as far above the median as twice
the maximum or six standard deviations, whichever is more, and a class of fewer
than ``MIN_HELD`` documents rejects nothing.

Defined cases: null ids are left out.  A null text, or one without letters, has
no language and no cross-entropy.  Rows that repeat an id are judged one by
one.  Rows with a null language aren't learned from, but judged.  Without any
labelled row every language is null.  Of equal cross-entropies the first
language by name wins.  Characters beyond the basic plane count as one
character.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm import textkit as tk
from symgrove.llm.pretoken import LETTER, UNSURE, classes
from symgrove.llm.runtime import cut

ORDER = 4
HELD_OUT = 8
FALSE_REJECTS = 0.001
MIN_HELD = 8
#: 4-grams of all languages that are broadcast at once; more of them take more passes.
PIECE_GRAMS = 1 << 22

SUMS = "doc_id long, label string, held boolean, key string, n_chars long, sums array<double>"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-grams, first of each row): a 4-gram for each character, 16 bits each."""
    lowered = pc.utf8_lower(texts)
    data, offs = tk.buffers(lowered)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    rows = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offs)
    cp = np.minimum(cp, 0xFFFF)
    cls = classes()[cp]
    letter = (cls == LETTER) | (cls == UNSURE)
    # a space before each row's first letter, one for each gap, one at the end
    code = np.where(letter, cp, 32).astype(np.uint64)
    keep = letter.copy()
    if len(cp):
        keep[1:] |= letter[:-1]  # the first character after a run of letters
        head = rows[:-1][np.diff(rows) > 0]
        keep[head] = letter[head]
    upto = np.concatenate([[0], np.cumsum(keep)])
    code = code[keep]
    first = upto[rows]
    # texts that end in a letter lack their last space
    closing = np.zeros(len(rows) - 1, np.int64)
    full = np.flatnonzero(np.diff(first))
    closing[full] = code[first[1:][full] - 1] != 32
    code = np.insert(code, first[1:][closing > 0], 32)
    first = first + np.concatenate([[0], np.cumsum(closing)])
    n = len(code)
    at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = code.copy()
    for j in range(1, ORDER):
        before = np.full(n, 32, np.uint64)
        before[j:] = code[: n - j]
        before[at < j] = 32
        out |= before << np.uint64(16 * j)
    return out, first


def _source(docs: DataFrame) -> DataFrame:
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held", held)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all labelled documents that aren't held out."""

    def merged(parts):
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        out, back = np.unique(keys, return_inverse=True)
        return out, np.bincount(back, n, len(out)).astype(np.int64)

    def run(batches):
        have: dict[str, list] = {}
        for batch in batches:
            texts, lang = tk.string_array(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for lo, hi in tk.slices(texts):
                g, first = grams(texts[lo:hi])
                of = np.repeat(lang[lo:hi], np.diff(first)) if len(set(lang[lo:hi])) > 1 else None
                for name in sorted(set(lang[lo:hi])):
                    parts = have.setdefault(name, [])
                    parts.append(np.unique(g if of is None else g[of == name], return_counts=True))
                    if len(parts) > 16:
                        have[name] = [merged(parts)]
        for name, parts in have.items():
            keys, n = merged(parts)
            for at in range(0, len(keys), 1 << 16):
                k = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(tk.signed(k)), pa.array(n[at : at + (1 << 16)])], ["lang", "gram", "n"])

    src = _source(docs).filter("lang IS NOT NULL AND NOT held").select("text", "lang")
    return src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(n1: float, n2: float) -> float:
    return n1 / (n1 + 2.0 * n2) if n1 and n2 else 0.5


def kneser_ney(keys: np.ndarray, n: np.ndarray, vocabulary: int, single: tuple[np.ndarray, np.ndarray] | None = None, discounts: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(n-gram hashes, log probabilities, history hashes, log weights, log floor), hashes sorted.

    A piece of a model takes the ``single`` characters with their continuation
    counts, and the ``discounts`` from single characters up, of the whole.
    """
    order = np.argsort(keys)
    levels = [(keys[order].astype(np.uint64), n[order].astype(np.float64))]
    for j in range(ORDER - 1, 0, -1):
        short, c = np.unique(levels[-1][0] & np.uint64((1 << (16 * j)) - 1), return_counts=True)
        levels.append((short, c.astype(np.float64)))
    if single is not None:
        levels[-1] = single[0].astype(np.uint64), single[1].astype(np.float64)
    all_keys, all_p, all_h, all_w = [], [], [], []
    lower_keys, lower_p = None, None
    floor = 1.0 / vocabulary
    unseen = 0.0
    for i, (k, c) in enumerate(reversed(levels)):
        d = discount((c == 1).sum(), (c == 2).sum()) if discounts is None else discounts[i]
        h = k >> np.uint64(16)
        hist, first, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, c, len(hist))
        kinds = np.bincount(back, minlength=len(hist))
        weight = d * kinds / total
        if lower_keys is None:
            below = np.full(len(k), floor)
            unseen = float(weight[0]) * floor
        else:
            below = lower_p[np.searchsorted(lower_keys, k & np.uint64((1 << (16 * i)) - 1))]
            all_h.append(hist)
            all_w.append(weight)
        p = np.maximum(c - d, 0) / total[back] + weight[back] * below
        all_keys.append(k)
        all_p.append(p)
        lower_keys, lower_p = k, p

    def table(k, v):
        k = tk.mix(np.concatenate(k))
        o = np.argsort(k)
        return k[o], np.log(np.concatenate(v))[o].astype(np.float32)

    return *table(all_keys, all_p), *table(all_h, all_w), float(np.log(unseen))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    h = tk.mix(keys)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def log_probability(model, keys: np.ndarray) -> np.ndarray:
    """Of each 4-gram's last character after the other three."""
    gram, p, hist, w, floor = model
    out, add, todo = np.empty(len(keys)), np.zeros(len(keys)), np.arange(len(keys))
    for j in range(ORDER, 0, -1):
        k = keys[todo] & np.uint64((1 << (16 * j)) - 1)
        at, ok = _find(gram, k)
        out[todo[ok]] = add[todo[ok]] + p[at[ok]]
        todo, k = todo[~ok], k[~ok]
        if j > 1 and len(todo):
            at, ok = _find(hist, k >> np.uint64(16))
            add[todo[ok]] += w[at[ok]]
    out[todo] = add[todo] + floor
    return out


def levels(counts: DataFrame) -> list[DataFrame]:
    """(lang, gram, n) of single characters, pairs, triples and 4-grams: counts of the last, continuation counts of the others."""
    out = [counts]
    for j in range(ORDER - 1, 0, -1):
        out.append(cut(out[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << (16 * j)) - 1).alias("gram")).agg(F.count("*").alias("n"))))
    return out[::-1]


def pieces(counts: DataFrame, piece_grams: int = PIECE_GRAMS) -> tuple[np.ndarray, int]:
    """(the piece of each character before the last, number of pieces)."""
    sizes = counts.groupBy(F.shiftright("gram", 16).bitwiseAND(0xFFFF).alias("c")).agg(F.count("*").alias("n")).collect()
    of, at, full = np.zeros(1 << 16, np.int32), 0, 0
    for r in sorted(sizes, key=lambda r: r["c"]):
        if full and full + r["n"] > piece_grams:
            at, full = at + 1, 0
        of[r["c"]], full = at, full + r["n"]
    return of, at + 1


def train(docs: DataFrame, piece_grams: int = PIECE_GRAMS):
    """(languages, the piece of each character, an iterator over the pieces' models by language)."""
    counts = cut(gram_counts(docs))
    all_levels = levels(counts)
    discounts: dict[str, list[float]] = {}
    for level in all_levels:
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect():
            discounts.setdefault(r["lang"], []).append(discount(r["n1"], r["n2"]))
    single = all_levels[0].orderBy("lang", "gram").toPandas()
    names, vocabulary = sorted(discounts), single["gram"].nunique() + 1
    of, n = pieces(counts, piece_grams)

    def models(piece: int) -> dict:
        chars = [int(c) for c in np.flatnonzero(of == piece)]
        out = {}
        for name in names:
            own = counts.filter(F.col("lang") == name).select("gram", "n")
            if n > 1:
                wanted = counts.sparkSession.createDataFrame([(c,) for c in chars], "c long")
                own = own.join(F.broadcast(wanted), F.shiftright("gram", 16).bitwiseAND(0xFFFF) == F.col("c"), "left_semi")
            got, one = own.toArrow(), single[single["lang"] == name]
            out[name] = kneser_ney(got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy(), vocabulary, (one["gram"].to_numpy(), one["n"].to_numpy()), discounts[name])
        return out

    return names, of, (models(i) for i in range(n))


def sums(docs: DataFrame, models: dict, of: np.ndarray, piece: int, whole: bool):
    """(SUMS of each document, the broadcast): log probabilities by language of its 4-grams in one piece; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((models, of))

    def run(batches):
        known, where = shared.value
        for batch in batches:
            texts = tk.string_array(batch.column("text"))
            for lo, hi in tk.slices(texts):
                g, first = grams(texts[lo:hi])
                distinct, back = np.unique(g, return_inverse=True)
                mine = slice(None) if whole else np.flatnonzero(where[((distinct >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] == piece)
                total = np.empty((hi - lo, len(known)))
                for i, m in enumerate(known.values()):
                    p = np.zeros(len(distinct))
                    p[mine] = log_probability(m, distinct[mine])
                    upto = np.concatenate([[0.0], np.cumsum(p[back])])
                    total[:, i] = upto[first[1:]] - upto[first[:-1]]
                part = batch.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(known)), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("held"), part.column("key"), pa.array(np.diff(first)), lists], [x.split()[0] for x in SUMS.split(", ")])

    key = F.lit("") if whole else F.md5("text")
    return _source(docs).withColumn("key", key).mapInArrow(run, SUMS), shared


def scores(docs: DataFrame, piece_grams: int = PIECE_GRAMS) -> DataFrame:
    """(doc_id, label, held, best, entropy, margin, n_chars): the best language of each document."""
    names, of, models = train(docs, piece_grams)
    whole = not of.any()
    have = None
    for i, model in enumerate(models):
        own, shared = sums(docs, model, of, i, whole)
        if not whole:  # the next piece takes the place of this one
            own = cut(own)
            shared.unpersist()
        if have is None:
            have = own
        else:
            more = own.select("key", F.col("sums").alias("more")).groupBy("key").agg(F.first("more").alias("more"))  # equal texts have equal sums
            have = cut(have.join(more, "key").withColumn("sums", F.zip_with("sums", "more", lambda x, y: x + y)).drop("more"))
    by = F.transform("sums", lambda x: -x / F.greatest("n_chars", F.lit(1)))
    low = F.array_sort("by")
    some = (F.col("n_chars") > 0) & (F.size("sums") > 0)
    best = F.element_at(F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.array_position("by", F.array_min("by")).cast("int"))
    margin = F.when(F.size("by") > 1, F.get(low, 1) - F.get(low, 0)).otherwise(0.0)
    return have.withColumn("by", by).select("doc_id", "label", "held", F.when(some, best).alias("best"), F.when(some, F.array_min("by")).alias("entropy"), F.when(some, margin).alias("margin"), "n_chars")


def identify(docs: DataFrame, false_rejects: float = FALSE_REJECTS, piece_grams: int = PIECE_GRAMS) -> DataFrame:
    """(doc_id, language, closest, entropy, margin): language is null where it is rejected."""
    size = F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int")
    scored = cut(scores(docs, piece_grams).withColumn("size", size))
    sure = scored.filter("held AND label = best").groupBy("best", "size").agg(F.count("*").alias("n"), F.max("entropy").alias("top"), F.stddev_pop("entropy").alias("sd"), F.percentile_approx("entropy", [0.5, 1 - false_rejects], 10000).alias("q"))
    middle = F.col("q")[0]
    limit = F.when(F.col("n") >= MIN_HELD, F.when(F.col("n") * false_rejects < 1, middle + F.greatest(2 * (F.col("top") - middle), 6 * F.col("sd"))).otherwise(F.col("q")[1]))
    limits = F.broadcast(sure.select("best", "size", limit.alias("limit")))  # languages times length classes
    ok = F.col("limit").isNull() | (F.col("entropy") <= F.col("limit"))
    return scored.join(limits, ["best", "size"], "left").select("doc_id", F.when(ok, F.col("best")).alias("language"), F.col("best").alias("closest"), "entropy", "margin")
