"""Hard negatives against brute force and SQL, on odd vectors and in several blocks."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskmart.llm import hard_negatives
from riskmart.llm.hard_negatives import Settings, Walk, band, best, inner, mine

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(seed, n=300, dim=8, labels=4):
    """Vectors in a few directions, with ties, repeated vectors and one frequent label."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in rng.sample(range(-100, 1000), n):
        if rows and rng.random() < 0.2:
            vec = list(rng.choice(rows)[1])
        else:
            vec = [m + rng.gauss(0, 0.4) for m in rng.choice(middles)]
        rows.append((i, vec, 0 if rng.random() < 0.35 else rng.randrange(labels)))
    return rows


ODD = [
    (None, [1.0, 0.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 2),
    (4, [float("inf"), 0.0], 2), (5, [1e30, 0.0], 2), (0, [1.0, 1.0], 1), (50, [1.0, 0.5], 2),
    (6, [1.0], 1), (8, [0.9, 0.9, 7.0], 2), (9, [], 1), (10, [0.6, 0.6], 3), (11, [0.6, 0.6], 3),
    (11, [0.6, 0.6], 3), (12, [-0.5, -0.5], 1), (13, [0.0, 0.0], 1), (100, [], 2), (15, [0.5, 0.4], None),
]


def expected(rows, asked, moved=True):
    """Brute force over Python integers."""
    taking = []
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(
                x is None or not math.isfinite(x) or abs(256 * x) > 1 << 27 for x in vec):
            continue
        label = (label + 1) % 10 if moved and i % 7 == 0 else label
        taking.append((i, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    for a, label, v in taking:
        if not asked(a):
            continue
        scored = [(-sum(map(int.__mul__, v, w)), i, other) for i, other, w in taking]
        positives = sorted((s, i) for s, i, other in scored if other == label and i != a)[:5]
        for p, i in positives:
            fits = sorted((s, j) for s, j, other in scored
                          if other != label and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def found(frame, settings=Settings()):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in mine(
        frame.withColumn("label", label), F.col("vec_id") % 50 == 0, settings).select(*NAMES).collect())


SMALL = Settings(clusters=3, members=2, sample_rows=20, chunk_rows=37, step=5, block_bytes=500)


@pytest.mark.parametrize("settings", [Settings(), SMALL], ids=["default", "small blocks"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, settings):
    rows = vectors(seed)
    result = found(spark.createDataFrame(rows, SCHEMA).repartition(5), settings)
    assert result == expected(rows, lambda i: i % 50 == 0) and result


def test_equals_its_sql(spark):
    rows = vectors(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    sql = con.sql(hard_negatives.ORACLE)
    assert sql.columns == NAMES
    assert sorted(sql.fetchall()) == found(spark.createDataFrame(rows, SCHEMA))


def test_odd_rows(spark):
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in ODD], SCHEMA + ", slot string, score double")
    assert found(frame) == found(frame, SMALL) == expected(ODD, lambda i: i % 50 == 0)


def test_no_rows_and_no_anchors(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []


def test_one_frequent_vector(spark):
    rows = [(i, [0.7, 0.1], i % 2) for i in range(300)] + [(1000 + i, [0.5, 0.1 * i], i % 2) for i in range(30)]
    assert found(spark.createDataFrame(rows, SCHEMA), SMALL) == expected(rows, lambda i: i % 50 == 0)


def test_a_walk_ends_early():
    """Members of a narrow cluster leave the list once no later bound can matter."""
    rng = np.random.default_rng(1)
    near = np.floor(256 * (np.array([1.0, 0, 0, 0]) + rng.normal(0, 0.01, (50, 4))))
    far = np.floor(256 * (np.array([0, 1.0, 0, 0]) + rng.normal(0, 0.01, (5000, 4))))
    block = {"ids": np.arange(5), "label": np.zeros(5, int), "vectors": near[:5],
             "cluster": np.zeros(5, int), "need": np.full((5, 1), hard_negatives.NONE),
             "high": np.full((5, 1), hard_negatives.NEVER)}
    walk = Walk(block, 5, True, Settings(step=100))
    seen = []
    score = walk.score
    walk.score = lambda some, ids, labels, v: (seen.append(len(ids)), score(some, ids, labels, v))
    walk.meet(np.arange(5050), np.zeros(5050, int), np.vstack([near, far]))
    assert sum(seen) == 100
    assert set(walk.held[2]) <= set(range(50))


def test_bands_and_products_are_exact():
    scores = np.array([0, 1, 2, 3, -1, -2, 7, 100, 101, 2 ** 60 + 1, -(2 ** 60) - 1])
    low, high = band(scores, Settings())
    for p, a, b in zip(scores.tolist(), low.tolist(), high.tolist()):
        assert (a, b) == (-(-50 * p // 100), 95 * p // 100)
    big = np.array([[2.0 ** 27, 1.0], [3.0, 2.0 ** 26 + 1]])
    assert (inner(big, big) == big.astype(object).astype(int) @ big.astype(object).astype(int).T).all()


def test_best_orders_by_score_then_id():
    group, score, ids = np.array([1, 0, 1, 1, 0]), np.array([5, 9, 7, 7, 9]), np.array([1, 4, 3, 2, 3])
    assert best(group, score, ids, 2).tolist() == [4, 1, 3, 2]
    assert best(*(np.array(x, int) for x in ([], [], [])), 3).tolist() == []


def test_short_vectors_are_padded():
    packed = pa.array([np.array([1, 2], "<i4").tobytes(), b""], pa.binary())
    assert hard_negatives.matrix(packed).tolist() == [[1, 2], [0, 0]]
