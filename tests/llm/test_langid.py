import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from symgrove.llm import langid, textkit


def test_grams_match_a_plain_loop():
    texts = ["Ab c", "", "...", "é1é x!", " lead", "tail ", "one中 two"]
    g, first = langid.grams(textkit.string_array(pa.array(texts)))
    for i, t in enumerate(texts):
        chars = "".join(c if c.isalpha() else " " for c in t.lower())
        chars = " ".join(chars.split())
        padded = "   " + chars + (" " if chars else "")
        want = [sum(ord(padded[j + 3 - k]) << (16 * k) for k in range(4)) for j in range(len(padded) - 3)] if chars else []
        # a text's first letter follows a space
        assert g[first[i] : first[i + 1]].tolist() == want, t


def plain_kn(counts: Counter, vocabulary: int):
    """The textbook recursion over strings."""
    levels = {4: counts}
    for j in (3, 2, 1):
        levels[j] = Counter(k[1:] for k in levels[j + 1])
    discount = {}
    for j, c in levels.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[j] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(g):
        j = len(g)
        if not j:
            return 1 / vocabulary
        same = {k: v for k, v in levels[j].items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - discount[j], 0) / total + discount[j] * len(same) / total * p(g[1:])

    return p


def test_model_matches_the_recursion():
    rnd = random.Random(1)
    text = "   " + "".join(rnd.choice("aabcde ") for _ in range(400))
    counts = Counter(text[i : i + 4] for i in range(len(text) - 3))
    pack = lambda g: sum(ord(c) << (16 * (len(g) - 1 - i)) for i, c in enumerate(g))
    model = langid.kneser_ney(np.array([pack(g) for g in counts], np.uint64), np.array(list(counts.values())), 9)
    p = plain_kn(counts, 9)
    tests = ["".join(rnd.choice("abcdefz ") for _ in range(4)) for _ in range(300)] + list(counts)[:50]
    got = langid.log_probability(model, np.array([pack(g) for g in tests], np.uint64))
    assert np.allclose(got, [math.log(p(g)) for g in tests], atol=1e-5)


def corpus(seed, n):
    rnd = random.Random(seed)
    syllables = {"en": ["th", "er", "ing", "ou", "sh"], "fr": ["eau", "oi", "é", "que", "tion"], "de": ["sch", "ung", "ü", "keit", "ein"]}
    return [(i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 60))), lang) for i in range(n) for lang in [rnd.choice(list(syllables))]]


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus(2, 900)
    junk = [(10_000 + i, "qzxkw vvpj xkcd " * 10, None) for i in range(5)]
    blank = [(20_000, None, "en"), (20_001, "", "fr"), (20_002, "123 ...", None), (None, "the", "en")]
    unlabelled = [(30_000 + i, t, None) for i, t, _ in corpus(9, 200)]
    truth = {30_000 + i: lang for i, _, lang in corpus(9, 200)}
    df = spark.createDataFrame([(*r, 1) for r in rows + junk + blank + unlabelled], "doc_id long, text string, lang string, held int")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows) + 5 + 3 + 200
    assert np.mean([got[i]["language"] == lang for i, lang in truth.items()]) > 0.97
    assert all(got[i]["language"] is None for i in [*range(10_000, 10_005), 20_000, 20_001, 20_002])
    assert got[20_000]["entropy"] is None


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["language"] for r in langid.identify(df).collect()] == [None]
    assert langid.identify(df.limit(0)).count() == 0


def test_pieces_use_every_gram(spark):
    rows = corpus(4, 300) + [(10_000 + i, t, None) for i, (_, t, _) in enumerate(corpus(5, 60))] + [(20_000, None, "en"), (20_000, "zz 中 q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts: dict = {}
    for r in langid.gram_counts(df).collect():
        counts.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    keys = {name: np.array([g for g, _ in c]).view(np.uint64) for name, c in counts.items()}
    size = len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k in keys.values()]))) + 1
    models = {name: langid.kneser_ney(k, np.array([n for _, n in counts[name]]), size) for name, k in sorted(keys.items())}
    want = []
    for i, t, _ in rows:
        g, _ = langid.grams(textkit.string_array(pa.array([t or ""])))
        low = {name: -langid.log_probability(m, g).sum() / max(len(g), 1) for name, m in models.items()}
        best = min(low, key=low.get)
        want.append((i, best if len(g) else "", round(low[best], 6)))
    _, n = langid.pieces(langid.gram_counts(df), 100)
    assert n > 3
    for piece_grams in (100, langid.PIECE_GRAMS):
        got = [(r["doc_id"], r["closest"] or "", round(r["entropy"] or 0.0, 6)) for r in langid.identify(df, piece_grams=piece_grams).collect()]
        assert sorted(got) == sorted((i, b, abs(e)) for i, b, e in want)
