"""Ranked full-text search (BM25) by prefix tokens.

Words are runs of letters and digits, lower-cased, accents folded.  A query
splits at other characters but underscores; a token with underscores is a
phrase of its parts, the last of them a prefix.  Term counts are computed
inside each row by regular expressions in generated code, in one scan of the
text: counts alone are kept, and give the totals and then the scores, without a
shuffle of postings.

A stored graph has an index instead: postings (token, id, column, positions)
partitioned by the token's first character and sorted by token, so that a query
reads the row groups of its own words only, and one row of totals.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.plans.iterate import cut, union

K1, B = 1.2, 0.75
SYMBOL_TEXT = ["name", "signature", "doc_comment"]
HEADS = 64
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) == 2)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED).lower()


def fold(text: str) -> str:
    return text.lower().translate({ord(a): b for a, b in zip(_ACCENTED, _PLAIN, strict=True)})


_INNER, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"


def folded(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.octet_length(low) > F.length(low), F.translate(low, _ACCENTED, _PLAIN)).otherwise(low)  # ASCII has no accents


def query_phrases(query: str) -> list[list[str]]:
    found = [[p for p in re.split("_+", fold(t)) if p] for t in re.findall(r"\w+", query)]
    return list(map(list, dict.fromkeys(tuple(p) for p in found if p)))


def _pattern(phrase: list[str]) -> str:
    """Matches where the phrase begins, its last word being a prefix; occurrences may overlap."""
    first, *rest = phrase
    return rf"(?<!{_INNER}){re.escape(first)}" + (f"(?={_GAP}{_GAP.join(map(re.escape, rest))})" if rest else "")


def bm25(rows: DataFrame, query: str, columns: list[str], shown: list[str] | None = None) -> DataFrame:
    """``rows`` that have any query token, with ``score``, least (best) first in sense; statistics are over all rows.

    ``shown`` are the columns of the result, by default all; leave out long texts.
    """
    phrases, shown = query_phrases(query), rows.columns if shown is None else shown
    if not phrases:
        return rows.limit(0).select(*shown, F.lit(0.0).alias("score"))
    words = rows.select("*", *[folded(F.col(c)).alias(f"__w{i}") for i, c in enumerate(columns)])
    add = lambda xs: sum(xs[1:], xs[0])
    times = lambda i, pattern: F.regexp_count(F.col(f"__w{i}"), F.lit(pattern))
    size = add([times(i, f"{_INNER}+") for i in range(len(columns))])
    tf = [add([times(i, _pattern(p)) for i in range(len(columns))]) for p in phrases]
    counted = words.select(*shown, size.alias("__size"), *[t.alias(f"__t{j}") for j, t in enumerate(tf)])
    counted = cut(counted)
    totals = counted.agg(F.count("*").alias("__n"), F.avg("__size").alias("__avg"), *[F.count(F.when(F.col(f"__t{j}") > 0, 1)).alias(f"__n{j}") for j in range(len(tf))])
    out = counted.filter(add([F.col(f"__t{j}") for j in range(len(tf))]) > 0).crossJoin(F.broadcast(totals))
    return out.select(*shown, _score(len(tf)).alias("score"))


def _score(n_terms: int) -> Column:
    """From the columns __t0 ... (counts), __n0 ... (rows that have any), __size, __avg and __n."""

    def term(j: int) -> Column:
        n, t = F.col(f"__n{j}"), F.col(f"__t{j}")
        idf = F.log((F.col("__n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        return idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("__size") / F.col("__avg")))

    terms = [term(j) for j in range(n_terms)]
    return -sum(terms[1:], terms[0])


def _head(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 1)), F.lit(HEADS)).cast("int")


def postings(rows: DataFrame, columns: list[str], key: str = "id", spread: int = 0) -> DataFrame:
    """(head, token, id, col, positions, size): where each token is; size is the number of tokens of the row.

    With ``spread`` they come shuffled by head, each head in so many parts, as they are stored.
    """
    words = [F.regexp_extract_all(folded(F.col(c)), F.lit(f"{_INNER}+"), F.lit(0)) for c in columns]
    each = rows.select(F.col(key).alias("id"), F.array(*words).alias("w")).withColumn("size", F.aggregate("w", F.lit(0), lambda n, x: n + F.size(x)))
    each = each.select("id", "size", F.posexplode("w").alias("col", "x")).select("id", "size", "col", F.posexplode("x").alias("pos", "token"))
    head, keys = _head(F.col("token")).alias("head"), ["token", "id", "col", "size"]
    if spread:  # one shuffle serves the aggregation and the writer
        part = F.pmod(F.xxhash64("id"), F.lit(spread)).alias("part")
        each, keys = each.select(head, part, "*").repartition("head", "part"), ["head", "part", *keys]
    found = each.groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return found.select("head" if spread else head, "token", "id", "col", "positions", "size")


def totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: (n, tokens) of all rows."""
    sizes = [F.regexp_count(folded(F.col(c)), F.lit(f"{_INNER}+")) for c in columns]
    return rows.agg(F.count("*").alias("n"), F.sum(sum(sizes[1:], sizes[0]).cast("long")).alias("tokens"))


def bm25_indexed(index: DataFrame, total: DataFrame, query: str) -> DataFrame:
    """(id, score) of the rows that have any query token, as bm25() has them, from postings() and totals()."""
    phrases = query_phrases(query)
    if not phrases:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)

    def at(word: str, prefix: bool, back: int) -> DataFrame:
        mine = F.col("token").startswith(word) if prefix else F.col("token") == word
        return index.filter((F.col("head") == _head(F.lit(word))) & mine).select("id", "col", "size", F.explode("positions").alias("pos")).withColumn("pos", F.col("pos") - back)

    count = lambda j, n: [n if i == j else F.lit(0).alias(f"__t{i}") for i in range(len(phrases))]
    found = []
    words = {j: F.col("token").startswith(p[0]) for j, p in enumerate(phrases) if len(p) == 1}
    if words:  # all in one pass over the index
        mine = reduce(or_, words.values()) & F.col("head").isin([_head(F.lit(phrases[j][0])) for j in words])
        times = [F.when(words[j], F.size("positions")).otherwise(0).alias(f"__t{j}") if j in words else F.lit(0).alias(f"__t{j}") for j in range(len(phrases))]
        found.append(index.filter(mine).select("id", "size", *times))
    for j, phrase in enumerate(phrases):
        if len(phrase) == 1:
            continue
        hits = at(phrase[0], False, 0)
        for back, word in enumerate(phrase[1:], 1):
            hits = hits.join(at(word, back == len(phrase) - 1, back).select("id", "col", "pos"), ["id", "col", "pos"], "left_semi")
        found.append(hits.select("id", "size", *count(j, F.lit(1).alias(f"__t{j}"))))
    per = union(found).groupBy("id", "size").agg(*[F.sum(f"__t{j}").alias(f"__t{j}") for j in range(len(phrases))])
    known = per.agg(*[F.count_if(F.col(f"__t{j}") > 0).alias(f"__n{j}") for j in range(len(phrases))])
    of = total.select(F.col("n").alias("__n"), (F.col("tokens") / F.col("n")).alias("__avg"))
    return per.withColumnRenamed("size", "__size").crossJoin(F.broadcast(known)).crossJoin(F.broadcast(of)).select("id", _score(len(phrases)).alias("score"))


def search_indexed(index: DataFrame, total: DataFrame, nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """search_symbols() from the index of a stored graph."""
    hits = nodes.join(bm25_indexed(index, total, query), "id").filter(~F.col("kind").isin(schema.HIDDEN))
    return hits.orderBy("score", "id").limit(limit).select("id", "name", "kind", "file_path", "line_start", "line_end", "signature", "doc_comment", "score")


def search_symbols(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    hits = bm25(nodes, query, SYMBOL_TEXT).filter(~F.col("kind").isin(schema.HIDDEN))
    return hits.orderBy("score", "id").limit(limit).select("id", "name", "kind", "file_path", "line_start", "line_end", "signature", "doc_comment", "score")
