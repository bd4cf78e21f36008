import math

import duckdb
import numpy as np
import pytest

from vitrine.llm import negatives, queries
from vitrine.llm.negatives import BallTree, hard_negatives

FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, anchors, scale=256, positives=5, count=10, low=30, high=90):
    def clean(given):
        return [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in given if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    out = []
    rows = clean(rows)
    for a, label, v in clean(anchors):
        score = [(-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in rows if i != a]
        for p, i, _ in sorted(x for x in score if x[2] == label)[:positives]:
            found = sorted((s, j) for s, j, l in score if l != label and low * -p <= 100 * -s <= high * -p)
            out += [(a, i, k, j, -p, -s) for k, (s, j) in enumerate(found[:count], 1)]
    return sorted(out)


def table(rng, n, dims=6, labels=4):
    rows = [(i, int(rng.integers(labels)), [float(np.float32(x)) for x in rng.normal(0, 0.2, dims)]) for i in range(n)]
    common = [0.5] * dims  # one vector of very many rows
    rows += [(n + i, i % 3, common) for i in range(n // 2)]
    rows += [(None, 1, common), (9001, None, common), (9002, 1, None), (9003, 1, [0.1, None] + [0.0] * (dims - 2)), (9004, 1, [float("nan")] + [0.0] * (dims - 1)), (9005, 1, [float("inf")] + [0.0] * (dims - 1)), (9006, 2, []), (9007, 2, [0.3]), (9008, 2, [0.0] * dims)]
    return rows + rows[:3]


@pytest.mark.parametrize("tree_rows, block_rows", [(1 << 16, 1 << 10), (70, 7)])
def test_equals_brute_force(spark, monkeypatch, tree_rows, block_rows):
    monkeypatch.setattr(negatives, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 1)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block_rows)
    rows = table(np.random.default_rng(1), 600)
    anchors = [r for r in rows if r[0] is not None and r[0] % 50 == 0] + [r for r in rows if r[0] in (9006, 9007, 9008)]
    schema = "vec_id long, label int, embedding array<float>, key string, share int"
    frame = lambda x: spark.createDataFrame([(*r, "k", 1) for r in x], schema).repartition(3)
    got = hard_negatives(frame(rows), frame(anchors)).collect()
    want = brute([(i, l, v and [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows], [(i, l, [float(np.float32(x)) for x in v]) for i, l, v in anchors])
    assert sorted(tuple(r[c] for c in FIELDS) for r in got) == want and len(want) > 300


@pytest.mark.parametrize("size", [1.0, 1e4, 1e6])
def test_tree_search_is_exact_for_small_and_large_numbers(size):
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(0, size, (900, 5)) * 256)
    vectors[300:] = vectors[300:] // 4 + np.floor(rng.normal(0, size, (3, 5)) * 2000).repeat(200, axis=0)
    ids, labels = rng.permutation(900), rng.integers(0, 3, 900)
    tree, n = BallTree(ids, labels, vectors), 20
    whole = [[int(x) for x in v] for v in vectors.tolist()]
    exact = [[sum(x * y for x, y in zip(a, b)) for b in whole] for a in whole[:n]]
    high = np.array([sorted(e)[-40] for e in exact])
    low = high // 3
    score, found = tree.search(vectors[:n], np.arange(n), low, high, labels[:n], ids[:n], False, 10)
    for i in range(n):
        want = sorted((-exact[i][j], int(ids[j])) for j in range(900) if labels[j] != labels[i] and low[i] <= exact[i][j] <= high[i])[:10]
        assert [(-s, k) for s, k in zip(score[i].tolist(), found[i].tolist()) if s != negatives._NONE] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    one = spark.createDataFrame([(100, 1, [1.0])], none.schema)
    assert hard_negatives(none, none).collect() == [] and hard_negatives(one, one).collect() == [] and hard_negatives(none, one).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_hard_negatives(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    said = con.execute(queries.oracle_sql()["op12_hard_negatives"])
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(got.columns)
    assert dict(got.dtypes)["rank"] == "int"
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(said.fetchall())
