"""Mixing sources to target weights by Pareto order sampling.

Source s gets n_s copies of its documents, n_s being its share of ``total``
under the target weights (largest remainders, so the shares add up).  Document
i of it is expected ``e_i = n_s * size_i / sum(size)`` times: floor(e_i) whole
copies are certain, and the remaining probabilities p_i = e_i - floor(e_i) are
sampled with a fixed size: documents are ranked by the odds of a random number
over the odds of p_i, and the smallest ``n_s - sum(floor(e_i))`` are taken.
Shares, sizes and certain copies are integer arithmetic and the random number
is an MD5, so every engine and every run gives the same sample.

Two passes: the first sees ids and sizes only, finds for each source the last
rank that is taken, and hands this one row per source to the second, which
decides row by row.  No text is shuffled, unless there are more than
``BROADCAST_PARTS`` sources, such as web domains: then what is known of them is
joined by a shuffle, in place of a broadcast.

Defined cases: a null source is a source of its own.  A null or empty text has
size 1.  Documents with a null id are left out.  Rows that repeat a doc_id and
text share one random number and are decided alike, so the sample may then
miss its size by the repeats.  Sources of weight 0, or missing from given
weights, get no copies.  A column ``copies`` of the table gives way to the one
that is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgrove.llm.runtime import BROADCAST_PARTS, cut, cut_points, handed, named, uniform, up_to_cut

SEED = "mix-1"
NO_SOURCE = "\x00"


def size_of(text: Column) -> Column:
    """A mild preference for length: the fourth root of it, in thousandths."""
    n = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("double")
    return F.floor(F.sqrt(F.sqrt(n)) * 1000).cast("long")


def shares(sizes: DataFrame, weights: DataFrame | None, total: int | None, most: int = BROADCAST_PARTS) -> tuple[DataFrame, bool]:
    """((src, n, m): copies and summed size of each source, whether these rows are few)."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("m"), F.count("*").alias("docs"))
    w = per.withColumn("w", F.lit(1).cast("long")) if weights is None else per.join(weights.groupBy(F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("src")).agg(F.max(F.col("weight").cast("long")).alias("w")), "src")
    w = cut(w.filter("w > 0"))
    known = w.agg(F.count("*").alias("n"), F.sum("docs").alias("t"), F.sum("w").alias("ws")).first()
    t, ws = (known["t"] if total is None else total) or 0, known["ws"] or 1
    w = w.withColumn("base", F.expr(f"{t}L * w div {ws}L")).withColumn("rest", F.expr(f"{t}L * w % {ws}L"))
    if known["n"] <= most:
        every = Window.partitionBy(F.lit(1))
        more = F.row_number().over(every.orderBy(F.desc("rest"), "src")) <= t - F.sum("base").over(every)
        return cut(w.select("src", "m", (F.col("base") + more.cast("long")).alias("n"))), True
    w = w.withColumn("part", F.lit(0)).withColumn("key", (F.lit(ws) - F.col("rest")) / F.lit(ws + 1.0))
    quota = cut(w.groupBy("part").agg((F.lit(t) - F.sum("base")).alias("n")))
    last = cut_points(w, "part", "key", "src", quota).select("part", "last_key", "last_tie")
    more = F.coalesce(up_to_cut(F.col("key"), F.col("src")), F.lit(False))
    return cut(w.join(F.broadcast(last), "part").select("src", "m", (F.col("base") + more.cast("long")).alias("n"))), False


def sample_copies(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: str = SEED, most: int = BROADCAST_PARTS) -> DataFrame:
    """The rows of ``docs`` that are taken, with ``copies`` appended.

    ``weights(source, weight)`` holds integers; without it all sources weigh
    alike.  ``total`` copies are taken, by default as many as there are
    documents.
    """
    src, size = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)), size_of(F.col("text"))
    slim = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), size.alias("size"))
    per, few = shares(slim, weights, total, most)

    def odds(doc_id: Column) -> Column:
        u, p = uniform(seed, doc_id), F.expr("CAST((n * size) % m AS DOUBLE) / m")
        q = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
        return q / (F.lit(1.0) + q)

    ranked = slim.join(handed(per, few), "src").withColumn("whole", F.expr("n * size div m"))
    quota = cut(ranked.groupBy("src").agg((F.max("n") - F.sum("whole")).alias("n")))
    part = ranked.filter("(n * size) % m > 0").withColumn("key", odds(F.col("doc_id")))
    last = handed(cut(cut_points(part, "src", "key", "doc_id", quota, few=few).join(per, "src")), few)

    inner = docs.filter("doc_id IS NOT NULL").select(F.struct(*named(docs.columns)).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), size.alias("size"))
    taken = inner.join(last, "src").withColumn("whole", F.expr("n * size div m"))
    chosen = F.when(F.expr("(n * size) % m > 0"), up_to_cut(odds(F.col("doc_id")), F.col("doc_id"))).otherwise(False)
    taken = taken.withColumn("copies", F.col("whole") + chosen.cast("long")).filter("copies > 0")
    return taken.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns if c.lower() != "copies"], F.col("copies"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with each row repeated as often as it was taken."""
    out = sample_copies(docs.select(F.struct(*named(docs.columns)).alias("__doc"), "doc_id", "source", "text"), **kw)
    copies = out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def oracle(seed: str = SEED) -> str:
    """DuckDB SQL for the (doc_id, source, copies) of sample_copies(documents)."""
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(source, chr(0)) AS src,
                 CAST(floor(sqrt(sqrt(CAST(greatest(coalesce(length(text), 0), 1) AS DOUBLE))) * 1000) AS BIGINT) AS size,
                 (CAST('0x' || substr(md5('{seed}|' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE AS u
               FROM documents WHERE doc_id IS NOT NULL),
    a AS (SELECT src, CAST(sum(size) AS BIGINT) AS m, count(*) AS docs FROM d GROUP BY src),
    b AS (SELECT *, CAST(sum(docs) OVER () AS BIGINT) AS t, count(*) OVER () AS ws FROM a),
    c AS (SELECT *, t // ws AS base, row_number() OVER (ORDER BY t % ws DESC, src) AS r FROM b),
    s AS (SELECT src, m, base + CASE WHEN r <= t - sum(base) OVER () THEN 1 ELSE 0 END AS n FROM c),
    e AS (SELECT d.*, (n * size) // m AS whole, CAST((n * size) % m AS DOUBLE) / m AS p, n FROM d JOIN s USING (src)),
    f AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q, n - sum(whole) OVER (PARTITION BY src) AS quota FROM e),
    g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY q / (1.0::DOUBLE + q) NULLS LAST, doc_id) AS k FROM f)
    SELECT doc_id, source, CAST(whole + CASE WHEN q IS NOT NULL AND k <= quota THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM g WHERE whole + CASE WHEN q IS NOT NULL AND k <= quota THEN 1 ELSE 0 END > 0"""
