import numpy as np
import pytest

from symgrove.llm import nearvec, queries


def brute(rows, least):
    """{(id, place in rows): (class, links)} of distinct rows."""
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= least
    np.fill_diagonal(near, True)
    root = np.array([r[0] for r in rows])
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    return sorted((r[0], int(c), int(n.sum()) - 1) for r, c, n in zip(rows, root, near, strict=True))


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], 7) for i, v in rows], "vec_id long, embedding array<double>, node int")


def clustered(rng, n=700, dims=16):
    base = rng.normal(size=(n, dims))
    return list(enumerate([*base, *(base[i % 20] + rng.normal(size=dims) * 0.05 for i in range(300)), *base[:5]]))


def test_against_brute_force(spark):
    rows = clustered(np.random.default_rng(3))
    got = sorted(map(tuple, nearvec.near_duplicates(table(spark, rows), shard=200).collect()))
    want = brute(rows, nearvec.MIN_COSINE)
    assert [r[0] for r in got] == [r[0] for r in want]
    found, true = sum(r[2] for r in got), sum(r[2] for r in want)
    assert 0.95 * true <= found <= true > 2000
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.95


def test_large_shards_are_cut_again(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    hot = [centre + rng.normal(size=24) * 0.6 for _ in range(600)]  # a third of all rows near one place, few of them linked
    rows = list(enumerate([*hot, *(h + rng.normal(size=24) * 0.1 for h in hot[:80]), *rng.normal(size=(1200, 24))]))
    points = nearvec.nodes(nearvec.members(table(spark, rows)))
    cells = nearvec.assign(points, shard=50, overlap=2, pivots=16, largest=300)
    assert max(r["count"] for r in cells.groupBy("shard").count().collect()) <= 300
    assert cells.select("node").distinct().count() == points.count()
    every = points.select("node", "n", "vec")
    found = nearvec.linked(every, 50, 3, 24, nearvec.MIN_COSINE, 16, 300).count()
    true = sum(r[2] for r in brute(rows, nearvec.MIN_COSINE)) / 2
    assert 0.9 * true <= found <= true > 50


def test_defined_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]), (1, [1.0, 0.01])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    assert sorted(map(tuple, nearvec.near_duplicates(df).collect())) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (8, 8, 0), (9, 9, 0)]
    assert nearvec.near_duplicates(df.limit(0)).count() == 0


def test_many_copies_of_a_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000, [1.0, 2.0, 3.1]), (5001, [-1.0, 0.0, 0.0])]
    got = sorted(map(tuple, nearvec.near_duplicates(table(spark, rows)).collect()))
    assert got == [(i, 0, 3000) for i in range(3000)] + [(5000, 0, 3000), (5001, 5001, 0)]


def test_search_reaches_its_range():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    q, f = nearvec.search(v, nearvec.build(v), v, 0.8, 24)
    want = v @ v.T >= 0.8
    assert want[q, f].all() and len(q) >= 0.97 * want.sum()
    q, f = nearvec.search(v, nearvec.build(v), v, 0.8, 400)
    assert len(q) == want.sum()


def test_an_audit_always_has_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3000, 48))
    near = base[:5] + rng.normal(size=(5, 48)) * 0.42  # about 0.92
    rows = list(enumerate([*base, *near]))
    points = nearvec.nodes(nearvec.members(table(spark, rows))).cache()
    found, share, bound = nearvec.links(points, shard=100, overlap=1)
    assert share >= bound >= nearvec.RECALL
    want = brute(rows, nearvec.MIN_COSINE)
    pairs = found.select("a", "b").distinct().count()
    assert pairs <= sum(r[2] for r in want) / 2 == 4 and found.filter("na = 0 OR nb = 0").count() == 0 and pairs >= 3


def test_expansion_goes_on_in_further_shards(spark):
    rng = np.random.default_rng(4)
    angle = np.arange(400) / 400 * 2 * np.pi  # a ring whose links cross every border of shards
    v = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    rows = list(enumerate(v + rng.normal(size=v.shape) * 1e-4))
    points = nearvec.nodes(nearvec.members(table(spark, rows))).cache()
    found = nearvec.linked(points, 20, 2, 24, 0.998)
    assert found.count() * 2 == sum(r[2] for r in brute(rows, 0.998))


@pytest.mark.parametrize("share, worth, low", [(1.0, 0, 0.0), (1.0, 20, 0.88), (1.0, 400, 0.993), (0.95, 400, 0.93)])
def test_lower_bound(share, worth, low):
    assert abs(nearvec.lower_bound(share, worth) - low) < 0.005


def test_starting_overlap():
    assert [nearvec.starting_overlap(p * nearvec.SHARD) for p in (1, 10, 49, 195, 3125)] == [2, 2, 3, 4, 6]


def test_links_of_a_shard_are_all_found_whatever_the_breadth(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1500, 32))
    rows = list(enumerate([*base, *(base + rng.normal(size=base.shape) * 0.3)]))  # pairs alone, which a greedy walk of breadth 1 misses
    points = nearvec.nodes(nearvec.members(table(spark, rows))).cache()
    found = nearvec.linked(points, 5000, 2, 1, nearvec.MIN_COSINE)
    assert found.count() == found.select("a", "b").distinct().count() == sum(r[2] for r in brute(rows, nearvec.MIN_COSINE)) / 2 > 1000


def test_shards_too_large_to_compare_are_walked(spark):
    rows = clustered(np.random.default_rng(3))
    points = nearvec.nodes(nearvec.members(table(spark, rows))).cache()
    found = nearvec.linked(points, 5000, 2, 24, nearvec.MIN_COSINE, whole=100)
    true = nearvec.linked(points, 5000, 2, 24, nearvec.MIN_COSINE)
    assert 0.95 * true.count() <= found.join(true, ["a", "b"], "left_semi").count() == found.count()


def test_a_forest_over_chunks():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, size=(2, 900))
    forest = nearvec._Forest(400)
    tree = np.concatenate([forest.add(a[i : i + 100], b[i : i + 100]) for i in range(0, 900, 100)])
    group = np.arange(400)
    for _ in range(400):
        for x, y in ((a, b), (b, a)):
            np.minimum.at(group, x, group[y])
    assert tree.sum() == 400 - len(np.unique(group))
    again = nearvec._Forest(400)
    assert again.add(a[tree], b[tree]).all()
    assert (np.unique(forest.root, return_inverse=True)[1][a] == np.unique(forest.root, return_inverse=True)[1][b]).all()


def test_perturbed_embeddings_miss_no_link(spark, tmp_path):
    rng = np.random.default_rng(21)
    base = list(enumerate(rng.normal(size=(1500, 10)).tolist()))
    spark.createDataFrame(base, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.perturbed_embeddings(spark, str(tmp_path)).collect()))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.sql(nearvec.PERTURBED["spark"], embeddings=spark.read.parquet(f"{tmp_path}/embeddings.parquet")).collect()]
    assert got == brute(rows, nearvec.MIN_COSINE)


def test_all_pairs_of_small_blocks(spark):
    rows = clustered(np.random.default_rng(3)) + [(9000, [1.0, 0.0]), (9001, [2.0, 0.1])]
    found = nearvec.all_links(nearvec.nodes(nearvec.members(table(spark, rows))).cache(), block=100)
    plain = brute(rows[:-2], nearvec.MIN_COSINE)
    points = {r["node"]: r["n"] for r in nearvec.nodes(nearvec.members(table(spark, rows))).collect()}
    links = found.collect()
    assert len({(r["a"], r["b"]) for r in links}) == len(links)
    assert sum(2 * r["na"] * r["nb"] for r in links) + sum(n * (n - 1) for n in points.values()) == sum(r[2] for r in plain) + 2
