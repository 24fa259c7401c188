"""The pipeline's operators and the token counts: brute force, round trips, held-out accuracy, defined cases."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from symgrove.llm import decontam, mixing, oddsketch, packing, quality, tokencount
from symgrove.llm.pretoken import PATTERN, TOKENIZER, read_ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, src string, size string, key string, part string, importance string, copies string, rep string, fp string, uid string, edits string"
AWKWARD = ["", None, " ", "...", "word", "word", "é́ 中文   x", "don't we'll  two   spaces\n\n", "a " * 3000, "🙂🙂 ok", "x" * 5000]


def table(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "a", "b", "c", "d", "e", "f", "g", "h", "i", "j") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_ranks(TOKENIZER).splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def prose(rnd, n, bad=False):
    words = [rnd.choice(["river", "stone", "light", "evening", "garden", "letter", "and", "of", "the"]) for _ in range(n)]
    if bad:
        for _ in range(max(3, n // 10)):
            words[rnd.randrange(n)] = rnd.choice(["worthless", "pathetic", "@@@###", "!!!$$$"])
    return " ".join(words)


def test_token_blocks_round_trip(spark, bpe):
    rows = [(i, t, "s") for i, t in enumerate(AWKWARD)] + [(None, "no id", "s"), (3, "...", "s")]
    out = packing.token_blocks(table(spark, rows)).collect()
    assert len(out) == len(rows)
    want = Counter((i, tuple(bpe.encode_ordinary(t or ""))) for i, t, _ in rows)
    got = Counter((r["doc_id"], tuple(packing.unpack(np.frombuffer(bytes(r["words"]), np.uint64), r["block_offsets"], r["n_ids"]).tolist())) for r in out)
    assert got == want
    assert packing.token_blocks(table(spark, [])).count() == 0


def test_blocks_decode_to_their_ids(spark, bpe, monkeypatch):
    rows = [(i, t, "s") for i, t in enumerate([*AWKWARD, "word " * 40_000])]
    monkeypatch.setattr(packing, "AT_ONCE", 3)
    got = {r["doc_id"]: r["ids"] for r in packing.decoded(packing.token_blocks(table(spark, rows))).collect()}
    assert got == {i: bpe.encode_ordinary(t or "") for i, t, _ in rows}
    ids = np.arange(5000, dtype=np.uint64) << np.uint64(52)
    words, first, per = packing.pack(ids, np.array([700, 0, 4300]))
    assert per.tolist() == [6, 0, 34]
    assert packing.unpack(words[: first[6]], first[:6], 700).tolist() == ids[:700].tolist()
    assert packing.unpack(words[first[6] :], first[6:-1] - first[6], 4300).tolist() == ids[700:].tolist()


def test_words_hold_any_ids():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        ids = rnd.integers(0, 1 << 63, n, dtype=np.uint64) >> rnd.integers(0, 64, n, dtype=np.uint64)
        ids[::7] = 0
        if n > 9:
            ids[9] = np.uint64((1 << 64) - 1)
        words, first, per = packing.pack(ids, np.array([n]))
        assert packing.unpack(words, first[:-1], n).tolist() == ids.tolist() and per.tolist() == [-(-n // packing.BLOCK)]


def test_edited_counts_equal_encoding_anew(spark, bpe):
    rnd = random.Random(5)
    rows, want = [], {}
    for i, t in enumerate([*AWKWARD, *(prose(rnd, 400) for _ in range(15))]):
        edits = [(s, rnd.choice([None, -3, 0, 10**9, rnd.randrange(2000)]), rnd.choice([0, 1, 30, None, -1, 10**9]), rnd.choice([" new", "", None, "s't", "  "])) for s in range(rnd.randrange(6))]
        rows.append((i, t, [*edits, None] if edits else None))
        now = t or ""
        for _, pos, size, new in sorted(edits, key=lambda e: (e[0])):
            pos = len(now) if pos is None else min(max(pos, 0), len(now))
            size = min(max(size or 0, 0), len(now) - pos)
            now = now[:pos] + (new or "") + now[pos + size :]
        want[i] = (len(bpe.encode_ordinary(t or "")), len(bpe.encode_ordinary(now)), len(now))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits array<{tokencount.EDIT}>")
    got = {r["doc_id"]: (r["n_tokens"], r["n_tokens_after"], r["n_chars_after"]) for r in tokencount.edited_counts(df).collect()}
    assert got == want
    long = spark.createDataFrame([(1, prose(rnd, 20_000), [(1, 60_000, 2, "xx")])], df.schema)
    assert tokencount.edited_counts(long).first()["chars_encoded"] < 2000
    assert tokencount.edited_counts(df.limit(0)).count() == 0
    ties = [(2, 0, 0, "late "), (1, 4, 1, "X"), (1, 0, 0, "first "), (None, 0, 1, "N"), (1, 0, 0, "first ")]
    got = tokencount.edited_counts(spark.createDataFrame([(1, "some words here", ties)], df.schema)).first()
    now = "Nome words here"  # a null seq is 0; of one seq the lower position comes first
    for pos, size, new in ((0, 0, "first "), (0, 0, "first "), (4, 1, "X"), (0, 0, "late ")):
        now = now[:pos] + new + now[pos + size :]
    assert (got["n_tokens_after"], got["n_chars_after"]) == (len(bpe.encode_ordinary(now)), len(now))


def test_quality_keeps_good_documents(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, rnd.randrange(20, 300), bad=i % 3 == 0), "s") for i in range(900)]
    extra = [(None, "the", "s"), (5001, None, "s"), (5002, "", "s"), (5003, "word", "s"), (5, rows[5][1], "s")]
    docs = table(spark, rows + extra)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(600)] + [(None, 1, 0), (3, None, 0), (6, 1, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.keep(docs, labels).collect()}
    assert len(kept) == 903
    unseen = range(600, 900)
    assert np.mean([kept[i] == (i % 3 != 0) for i in unseen]) > 0.97
    stay = quality.keep_good(docs, labels)
    assert stay.columns == docs.columns
    ids = [r["doc_id"] for r in stay.select("doc_id").collect()]
    assert None in ids and ids.count(5) == (2 if kept[5] else 0)
    assert all(r["kept"] for r in quality.keep(docs, labels.limit(0)).collect())
    assert quality.keep(docs.limit(0), labels).count() == 0


def test_quality_against_brute_force(spark):
    rnd = random.Random(12)
    texts = {i: prose(rnd, rnd.randrange(1, 90), bad=i % 4 == 0) for i in range(160)}
    labels = {i: int(i % 4 != 0) for i in range(120)}
    docs = table(spark, [(i, t, "s") for i, t in texts.items()])
    got = {r["doc_id"]: (r["importance"], r["kept"]) for r in quality.keep(docs, spark.createDataFrame([(i, g, 0) for i, g in labels.items()], "doc_id long, quality int, toxic int"), buckets=1 << 12).collect()}
    known = {r["doc_id"]: (r["good"], r["held"]) for r in quality.judged(spark.createDataFrame([(i, g, 0) for i, g in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    grams = {i: [tuple(map(int, r)) for r in quality.ngrams(pa.array([t], pa.large_string()), 1 << 12)[0]] for i, t in texts.items()}
    target = [i for i, (good, held) in known.items() if good and not held]
    weight = {}
    for kind in range(3):
        raw, own = Counter(), Counter()
        for i, g in grams.items():
            raw.update(r[kind] for r in g)
            own.update(r[kind] for r in g if i in target)
        share = sum(own.values()) / sum(raw.values())
        w = {x: np.log((own[x] + 1) / (n * share + 1)) for x, n in raw.items()}
        mean = sum(w[x] * n for x, n in own.items()) / sum(own.values())
        weight |= {x: v - mean for x, v in w.items()}
    size, step = quality.PASSAGE, quality.PASSAGE // 2
    importance = {}
    for i, g in grams.items():
        per = [sum(weight[x] for x in r) for r in g]
        starts = range(0, max(len(per) - size, 0) + step, step) if len(per) > size else [0]
        importance[i] = float(min(sum(per[a : a + size]) for a in starts))
    assert all(abs(got[i][0] - importance[i]) < 1e-3 for i in texts)
    at = quality.threshold(spark.createDataFrame(list(importance.items()), "doc_id long, importance double"), spark.createDataFrame([(i, g) for i, (g, held) in known.items() if held], "doc_id long, good int"))
    noise = lambda i: -np.log(-np.log((int(hashlib.md5(f"{quality.SEED}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52))
    best = sorted(texts, key=lambda i: -(importance[i] - at + noise(i)))[: sum(importance[i] >= at for i in texts)]
    assert {i for i, (_, kept) in got.items() if kept} == set(best) and 40 < len(best) < 160


def test_passages_decide():
    per = np.array([0.0] * 40 + [-1.0] * 4 + [0.0] * 40)
    assert quality.passage_minima(per, np.array([0, 84, 84]), 32).tolist() == [-4.0, 0.0]


def shingles(text, k):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_contained_items_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(60)}"
    items = {i: [word() for _ in range(rnd.randrange(3, 40))] for i in range(12)}
    items[11] = items[11][:4]
    docs = {}
    for d in range(60):
        text = [word() for _ in range(rnd.randrange(80))]
        for i in rnd.sample(sorted(items), rnd.randrange(3)):
            copy = list(items[i])
            if rnd.random() < 0.4:
                copy[rnd.randrange(len(copy))] = word()
            at = rnd.randrange(len(text) + 1)
            text[at:at] = copy
        docs[d] = text
    k, share = 5, 0.8
    items |= {20: items[3][:2], 21: [items[4][0]], 22: ["nowhere", "else"]}  # found wherever these words stand
    grams = lambda w, k: [tuple(w[p : p + k]) for p in range(max(len(w) - k + 1, 0))]
    want = {}
    for d, w in docs.items():
        for i, item in items.items():
            g = grams(w, min(k, len(item)))
            own = set(grams(item, min(k, len(item))))
            span = max(len(item) - k + 1, 1)
            best = max((len({x for x in g[p : p + span] if x in own}) for p in range(len(g))), default=0)
            if best >= np.ceil(len(own) * share - 1e-9) and best:
                want[d, i] = (best, len(own))
    df = table(spark, [(d, " ".join(w), "s") for d, w in docs.items()] + [(None, " ".join(items[0]), "s"), (900, None, "s"), (901, "", "s"), (1, " ".join(docs[1]), "s")])
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()] + [(None, "a b", "x"), (99, None, "x"), (98, "", "x")], "item_id long, text string, doc_id string")
    for bound in (1 << 20, 0):  # handed to every task, and joined
        got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_shingles"]) for r in decontam.contained_items(df, bench, broadcast_shingles=bound).collect()}
        assert got == want
    left = decontam.drop_contaminated(df, bench)
    assert left.columns == df.columns and {r[0] for r in left.select("doc_id").collect()} == ({*docs, None, 900, 901} - {d for d, _ in want})
    assert decontam.contained_items(df, bench.limit(0)).count() == decontam.contained_items(df.limit(0), bench).count() == 0


def test_texts_of_one_id_are_not_merged(spark):
    item = [f"w{i}" for i in range(40)]
    halves = [(1, " ".join(item[:20]), "s"), (1, " ".join(["x"] * 20 + item[20:]), "s")]
    other = [(2, " ".join(item), "s"), (2, " ".join(item[:36]), "s"), (3, " ".join(item[:34]), "s")]
    spread = [(4, " ".join([*(f"a{i}" for i in range(10)), *["y"] * 25, *(f"b{i}" for i in range(30))]), "s")]
    df = table(spark, halves + other + spread)
    texts = [(7, " ".join(item)), (8, " ".join(f"a{i}" for i in range(10))), (8, " ".join(f"b{i}" for i in range(30)))]
    bench = spark.createDataFrame(texts, "item_id long, text string")
    for bound in (1 << 20, 0):  # handed to every task, and joined
        got = sorted(tuple(r) for r in decontam.contained_items(df, bench, broadcast_shingles=bound).collect())
        assert got == [(2, 7, 36, 36), (3, 7, 30, 36), (4, 8, 26, 32)]


def test_mixing_hits_its_sizes(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randrange(1, 200)), "big" if i % 10 else "small") for i in range(600)] + [(700, None, None), (701, "", None), (None, "x", "big")]
    docs = table(spark, rows)
    out = mixing.sample_copies(docs)
    assert out.columns == [c for c in docs.columns if c != "copies"] + ["copies"]
    per = Counter()
    for r in out.select("source", "copies").collect():
        per[r["source"]] += r["copies"]
    assert sum(per.values()) == 602 and max(per.values()) - min(per.values()) <= 1
    weights = spark.createDataFrame([("big", 3), ("small", 1), ("other", 5)], "source string, weight int")
    got = Counter()
    for r in mixing.sample_copies(docs, weights, 400).select("source", "copies").collect():
        got[r["source"]] += r["copies"]
    assert got == {"big": 300, "small": 100}
    each = lambda **kw: Counter((r["doc_id"], r["copies"]) for r in mixing.sample_copies(docs, total=401, **kw).select("doc_id", "copies").collect())
    assert each() == each(most=0)  # the same where sources are too many to broadcast
    twice = docs.unionByName(docs.filter("doc_id = 5"))  # repeated rows are decided alike
    assert mixing.sample_copies(twice).filter("doc_id = 5").select("copies").distinct().count() <= 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == 602
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_near_duplicates_are_grouped(spark):
    rnd = random.Random(6)
    fresh = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(25):
        base = fresh(rnd.randrange(80, 200))
        for _ in range(rnd.choice([1, 1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = fresh(1)[0]
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "s"))
    n = len(rows)
    docs = table(spark, rows + [(None, rows[0][1], "s"), (9001, None, "s"), (9002, "", "s"), (9003, "tiny", "s"), (9004, "Tiny", "s"), (0, rows[0][1], "s")])
    got = {r["doc_id"]: r["rep_id"] for r in oddsketch.near_duplicates(docs).collect()}
    first = {}
    for i in range(n):
        first.setdefault(group[i], i)
    want = {i: first[group[i]] for i in range(n) if first[group[i]] != i} | {9004: 9003}
    assert all(want.get(i) == r for i, r in got.items())
    assert len(got) >= 0.97 * len(want)
    stay = oddsketch.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and {r[0] for r in stay.select("doc_id").collect()} == {*range(n), None, 9001, 9002, 9003, 9004} - got.keys()
    assert oddsketch.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 5])
def test_groups_are_those_of_all_candidates(spark, block):
    rnd = random.Random(9)
    rows = []
    for _ in range(30):
        base = [f"v{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 120))]
        for _ in range(rnd.choice([1, 2, 3, 12])):
            copy = [f"v{rnd.randrange(3000)}" if rnd.random() < 0.04 else w for w in base]
            rows.append((len(rows), " ".join(copy), "s"))
    rows += [(3, rows[20][1], "s"), (3, rows[3][1], "s"), (700, rows[11][1], "s")]  # id 3 has two texts
    docs = table(spark, rows)
    sig = oddsketch.signatures(docs).collect()
    root = {r["doc_id"]: r["doc_id"] for r in sig}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sig:
        for y in sig:
            a, b = np.frombuffer(x["sketch"], np.uint64), np.frombuffer(y["sketch"], np.uint64)
            if any(p == q for p, q in zip(x["bands"], y["bands"], strict=True)) and oddsketch.jaccard(a, b[None], oddsketch.BANDS * oddsketch.ROWS)[0] >= oddsketch.MIN_JACCARD:
                i, j = top(x["doc_id"]), top(y["doc_id"])
                root[max(i, j)] = min(i, j)
    got = sorted(map(tuple, oddsketch.near_duplicates(docs, block=block).collect()))
    assert got == sorted((i, top(i)) for i in root if top(i) != i) and len(got) > 60
    text = dict((i, t) for i, t, _ in rows[:-3])
    true = lambda i, j: (lambda a, b: len(a & b) / len(a | b))(shingles(text[i], 3), shingles(text[j], 3))
    close = [(i, j) for i in text for j in range(i) if true(i, j) >= 0.7]
    assert np.mean([top(i) == top(j) for i, j in close]) > 0.97 and len(close) > 100


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 32, (200, 128), dtype=np.uint32)
    for share in (0.95, 0.8, 0.6):
        b = np.where(rng.random(a.shape) < share, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
        true = (a == b).mean(axis=1)
        sa, sb = oddsketch.odd_sketches(a, 512), oddsketch.odd_sketches(b, 512)
        got = np.array([oddsketch.jaccard(x, y[None], 128)[0] for x, y in zip(sa, sb, strict=True)])
        assert abs(got - true).mean() < 0.05
    most = oddsketch.most_ones(0.5, 512, 128)
    ones = np.zeros((2, 8), np.uint64)
    ones[0, : most // 64], ones[0, most // 64] = np.uint64(2**64 - 1), np.uint64((1 << most % 64) - 1)
    assert oddsketch.jaccard(ones[1], ones[:1], 128)[0] >= 0.5
