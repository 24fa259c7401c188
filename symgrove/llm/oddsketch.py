"""MinHash near-duplicate groups, verified by odd sketches.

Each document becomes the set of its ``k``-word shingles and ``bands * rows``
MinHash samples of that set.  Bands of ``rows`` samples propose candidates.
An *odd sketch* folds the samples into a parity bitmap: sample i with value v
flips the bit that (i, v) hashes to, so equal samples cancel when two bitmaps
are XORed and the number of ones left estimates how many samples differ:
``differ = -n / 2 * ln(1 - 2 * ones / n)``, ``jaccard = 1 - differ / (2 * samples)``.
Candidates of a band bucket are verified by this estimate alone, which is one
XOR and one population count for each 64 bits.

Equal signatures are one node, so copies, however many, meet the bands once.
A partition's buckets are verified together, as arrays.  A bucket of more than
``BLOCK`` nodes is cut into blocks by hash, and each pair of blocks is a unit of
its own: all its pairs are still compared, in pieces of bounded size.

Defined cases: documents with a null id, or with a null text or one without
words, are in no group.  Documents with fewer than ``k`` words have one shingle
of all their words.  Rows that repeat a doc_id are one document: whatever one
of its texts is near to is near to it.  Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.llm import textkit as tk
from symgrove.llm.runtime import components, cut, without_ids

SHINGLE_WORDS = 3
BANDS = 32
ROWS = 4
SKETCH_BITS = 512
MIN_JACCARD = 0.5
BLOCK = 4096
#: Buckets up to this size are compared by their number of members, all of one size at once.
_SMALL = 8
_CHUNK = 1 << 15

SIGNATURE = "doc_id long, fp long, bands array<long>, sketch binary"


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = tk.mix(np.arange(1, n + 1, dtype=np.uint64))
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1), x.astype(np.uint32)


def minhashes(h: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """(rows x samples) MinHash values of non-empty rows of shingle hashes."""
    a, b = permutations(samples)
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(bounds) - 1, samples), np.uint32(0xFFFFFFFF))
    row, last = 0, len(bounds) - 1
    while row < last:  # chunks that stay in the processor's cache; a long row is folded piece by piece
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CHUNK, side="right")) - 1)
        lo, hi = int(bounds[row]), int(bounds[stop])
        for at in range(lo, hi, _CHUNK):
            piece = x[at : min(at + _CHUNK, hi)]
            cuts = np.zeros(1, np.int64) if stop == row + 1 else bounds[row:stop] - lo
            for j in range(samples):
                got = np.minimum.reduceat((piece ^ b[j]) * a[j], cuts)
                np.minimum(out[row:stop, j], got, out=out[row:stop, j])
        row = stop
    return out


def odd_sketches(mh: np.ndarray, bits: int) -> np.ndarray:
    """(rows x bits / 64) parity bitmaps of MinHash rows."""
    n, samples = mh.shape
    cell = tk.mix(mh.astype(np.uint64) + (np.arange(1, samples + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    out = np.zeros((n, bits // 64), np.uint64)
    rows = np.arange(n)
    for j in range(samples):
        out[rows, (cell[:, j] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (cell[:, j] & np.uint64(63))
    return out


def jaccard(one: np.ndarray, many: np.ndarray, samples: int) -> np.ndarray:
    """Estimated similarity of one sketch with many."""
    bits = many.shape[1] * 64
    ones = np.bitwise_count(many ^ one).sum(axis=1)
    share = np.minimum(2.0 * ones / bits, 1 - 1e-9)
    return np.maximum(0.0, 1 + bits / 2 * np.log1p(-share) / (2 * samples))


def signatures(docs: DataFrame, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, fp, bands, sketch) of every document with words; one pass, no shuffle."""
    samples = bands * rows
    salts = tk.mix(np.arange(101, 101 + bands, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), pc.utf8_lower(tk.string_array(batch.column(1)))
            for lo, hi in tk.slices(texts):
                h, first, *_ = tk.words(texts[lo:hi])
                sh, _, bounds = tk.shingles(h, first, k)
                has = np.flatnonzero(np.diff(bounds))
                if not len(has):
                    continue
                mh = minhashes(sh, np.append(bounds[has], bounds[-1]), samples)
                acc = np.zeros((len(has), bands), np.uint64)
                for r in range(rows):
                    acc = tk.mix(acc + mh[:, r::rows].astype(np.uint64) + salts)
                fp = np.zeros(len(has), np.uint64)
                for j in range(bands):
                    fp = tk.mix(fp + acc[:, j])
                sketch = odd_sketches(mh, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo:hi].take(pa.array(has)).cast(pa.int64()),
                        pa.array(tk.signed(fp)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(tk.signed(acc.ravel()))),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    ["doc_id", "fp", "bands", "sketch"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(run, SIGNATURE)


def most_ones(min_jaccard: float, bits: int, samples: int) -> int:
    """The most ones in the XOR of two sketches that are near; -1 if even equal ones aren't."""
    ones = np.arange(bits + 1)
    share = np.minimum(2.0 * ones / bits, 1 - 1e-9)
    near = np.maximum(0.0, 1 + bits / 2 * np.log1p(-share) / (2 * samples)) >= min_jaccard
    return int(near.sum()) - 1


def _far(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=-1)


def _links(units: np.ndarray, names: np.ndarray, sk: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows in order of their unit that connect what is near within each."""
    edges = np.flatnonzero(np.diff(units, prepend=units[:1] - 1))
    sizes = np.diff(np.append(edges, len(units)))
    a, b = [], []
    for n in range(2, _SMALL + 1):
        at = edges[sizes == n]
        for i in range(n if len(at) else 0):
            for j in range(i):
                near = at[_far(sk[at + i], sk[at + j]) <= most]
                a.append(names[near + i])
                b.append(names[near + j])
    for lo, n in zip(edges[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        left = np.arange(lo, lo + n)
        while len(left) > 1:  # a component by breadth-first search among those not yet reached
            root, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                near = _far(sk[queue.pop()], sk[left]) <= most
                found = left[near]
                queue.extend(found)
                a.append(names[found])
                b.append(np.repeat(names[root], len(found)))
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verified(most: int):
    def run(batches):
        for t in tk.whole_groups(batches, ["unit"]):
            column = t["sketch"].combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            sk = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(t.num_rows, -1)
            a, b = _links(t["unit"].to_numpy(), t["fp"].to_numpy(), sk, most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, min_jaccard: float = MIN_JACCARD, block: int = BLOCK) -> DataFrame:
    """(doc_id, rep_id): each near copy with the smallest id of its group.

    Buckets of one node are dropped before any sketch is moved.  A bucket
    emits links that connect what is near in it, not all pairs.
    """
    sig = cut(signatures(docs, k, bands, rows, bits))
    nodes = cut(sig.groupBy("fp").agg(F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    keyed = nodes.select("fp", F.posexplode("bands").alias("band", "key")).select("fp", F.xxhash64("band", "key").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o)))
    units = buckets.select("fp", F.explode(F.when(F.col("blocks") == 1, F.array("key")).otherwise(each)).alias("unit"))
    units = units.join(nodes.select("fp", "sketch"), "fp").repartition("unit").sortWithinPartitions("unit", "fp")
    near = units.mapInArrow(_verified(most_ones(min_jaccard, bits, bands * rows)), "a long, b long")
    # texts of one id
    ids = sig.select("doc_id", "fp")
    first = ids.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).filter("b <> z").select("doc_id", "b")
    tied = ids.join(first, "doc_id").select(F.col("fp").alias("a"), "b")
    groups = components(near.unionByName(tied)).withColumnRenamed("id", "fp")
    of = ids.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    reps = of.groupBy("root").agg(F.min("first").alias("rep_id"), F.max("last").alias("last")).filter("rep_id <> last").select("root", "rep_id")
    named = of.join(reps, "root").select("fp", "rep_id")
    return ids.join(named, "fp").filter("doc_id <> rep_id").select("doc_id", "rep_id").distinct()


def drop_near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """The documents without those that near_duplicates() ties to another one."""
    return without_ids(docs, near_duplicates(docs, **kw).select("doc_id"))
