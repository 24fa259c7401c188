import random

import numpy as np
import pytest

from symgrove.llm import repeats


def brute(texts: dict[int, list[str]], least: int) -> set:
    """Maximal repeats by definition: every pair of suffixes proposes a passage."""
    suffixes = [(d, i) for d, w in texts.items() for i in range(len(w) - least + 1)]
    by_start = {}
    for d, i in suffixes:
        by_start.setdefault(tuple(texts[d][i : i + least]), []).append((d, i))
    out = set()
    for group in by_start.values():
        for x in range(len(group)):
            for y in range(x + 1, len(group)):
                (d, i), (e, j) = group[x], group[y]
                n = least
                while i + n < len(texts[d]) and j + n < len(texts[e]) and texts[d][i + n] == texts[e][j + n]:
                    n += 1
                passage = texts[d][i : i + n]
                all_ = frozenset(o for o in group if texts[o[0]][o[1] : o[1] + n] == passage)
                left = [texts[a][b - 1] if b else (a,) for a, b in all_]
                if len(set(left)) > 1:
                    out.add((n, all_))
    return out


def found(df) -> set:
    each = {}
    for r in repeats.occurrences(df).collect():
        each.setdefault((r["group_id"], r["first"], r["n_words"]), []).append((r["doc_id"], r["position"]))
    got = [(n, frozenset(o)) for (_, _, n), o in each.items()]
    assert len(got) == len(set(got)) and all(len(o) == len(set(o)) for o in each.values())
    return set(got)


def corpus(seed: int) -> dict[int, list[str]]:
    rnd = random.Random(seed)
    word = lambda n=4: f"w{rnd.randrange(n)}"
    base = [[word(40) for _ in range(rnd.randrange(20, 90))] for _ in range(4)]
    out = {}
    for d in range(14):
        text = []
        for _ in range(rnd.randrange(1, 4)):
            piece = list(rnd.choice(base))
            if rnd.random() < 0.5:
                piece[rnd.randrange(len(piece))] = word(1000)
            text += piece + [word(1000) for _ in range(rnd.randrange(3))]
        out[d] = text
    out[90] = ["x", "y"] * 30
    out[91] = list(out[3])
    return out


@pytest.mark.parametrize("seed, hot", [(1, repeats.HOT), (2, repeats.HOT), (2, 5)])
def test_against_brute_force(spark, seed, hot):
    texts = corpus(seed)
    docs = spark.createDataFrame([(d, " ".join(w), "s") for d, w in texts.items()], "doc_id long, text string, uid string")
    got = found(repeats.repeated_passages(docs, min_words=12, k=5, reach=10, hot=hot))
    assert got == brute(texts, 12)


def test_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (1, None), (2, ""), (3, passage), (3, passage), (4, "a " + passage + " b"), (5, "c " + passage), (6, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeats.repeated_passages(docs)) == {(60, frozenset({(3, 0), (4, 1), (5, 1)}))}
    assert repeats.repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_long_copies(spark, hot):
    text = " ".join(f"v{i % 977}x{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "z " + text)], "doc_id long, text string")
    assert found(repeats.repeated_passages(docs, hot=hot)) == {(3000, frozenset({(1, 0), (2, 0), (3, 1)}))}


def test_intervals():
    assert sorted(repeats.intervals(np.array([0, 2, 3, 3, 1, 2]), 1)) == [(0, 3, 2), (0, 5, 1), (1, 3, 3), (4, 5, 2)]


def chains() -> dict[int, list[str]]:
    """A passage that goes on a word further in each text, and copies whose left words differ: a long chain of nodes."""
    passage = [f"c{i}" for i in range(60)]
    out = {d: [f"a{d}", *passage[: 14 + d], f"z{d}"] for d in range(40)}
    out |= {100 + d: [f"b{d % 3}", *passage, *(f"t{i}" for i in range(25)), *(["end"] if d % 2 else [])] for d in range(9)}
    out[200] = ["q", "r", "s"] * 25
    out[201] = ["x", *["q", "r", "s"] * 20, "y"]
    return out


@pytest.mark.parametrize("hot, reach", [(3, 10), (12, 8), (4, 64)])
def test_hot_groups_list_each_suffix_once(spark, hot, reach):
    texts = chains()
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    docs = docs.unionByName(docs.filter("doc_id IN (7, 101)"))
    rows = repeats.repeated_passages(docs, min_words=12, k=5, reach=reach, hot=hot)
    assert found(rows) == brute(texts, 12)
    # a row for each suffix of a group, not for each node that it is below; a run that goes on is a group again
    assert rows.count() <= 2 * sum(len(w) for w in texts.values())


def test_minima_at_the_ends_of_a_range():
    lcp = np.array([0, 7, 3, 9, 3, 5, 4, 8])
    assert repeats._chains(lcp).tolist() == [0, 1, 2, 4, 6, 7]
    assert repeats._bounds([b"a", b"b", b"b", b"b", b"c", b"d", b"e"], 2) == ([(b"b", 0), (b"b", 1), (b"e", 0)], [0, 1, 3, 4, 5], [1, 2, 1, 1])
