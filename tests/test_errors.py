"""Errors, alignment, cells and shrinking over lines, held to the long form and to loops."""

import math

import numpy as np
import pytest

from rawframe.operators import errors, lines, samples

SHAPES = {1: (70, 90), 2: (33, 40), 3: (5, 300)}
MOVES = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1), (0, 2), (2, 0), (-2, 0)]


def pictures():
    rng = np.random.default_rng(11)
    out = {}
    for k, (h, w) in SHAPES.items():
        v = rng.integers(0, 65536, (h, w))
        out[k] = v, np.clip(v + rng.integers(-40, 41, (h, w)) * (rng.random((h, w)) < 0.7), 0, 65535)
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(k, y, v[y].tolist(), s[y].tolist()) for k, (v, s) in pictures().items() for y in range(len(v))]
    return spark.createDataFrame(rows, "image int, y long, line array<int>, stored array<int>").repartition(5).cache()


def long(pairs):
    wide = pairs.selectExpr("image", "y", "cast(line as array<bigint>) as line", "cast(stored as array<bigint>) as stored")
    return lines.to_samples(wide, ["image"], ("line", "stored"), ("v", "stored"))


def near(a, b):
    return a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-12))


def test_errors_are_those_of_the_long_form(spark, pairs):
    made = {r["image"]: r.asDict() for r in errors.error_statistics(pairs, ["image"], 32, 16).collect()}
    want = {r["image"]: r.asDict() for r in samples.error_statistics(long(pairs), ["image"], 32, 16).collect()}
    assert set(made) == set(want) == set(SHAPES)
    for k in want:
        assert all(near(made[k][c], want[k][c]) for c in want[k]), (made[k], want[k])


def test_errors_of_fields(spark, pairs):
    size, fields, tile = (70, 90), (2, 3), 16
    made = errors.error_statistics(pairs.where("image = 1"), ["image"], tile, 8, 1.0, fields, size).first()
    v, s = pictures()[1]
    order = lambda n, f: [x for p in range(f) for x in range(p, n, f)]
    d = (s - v)[order(70, 2)][:, order(90, 3)].astype(float)
    tiles = {(y, x): np.sqrt((d[y * tile : y * tile + tile, x * tile : x * tile + tile] ** 2).mean()) for y in range(5) for x in range(6)}
    worst = max(tiles.values())
    assert made["tile_rms"] == pytest.approx(worst) and (made["worst_ty"], made["worst_tx"]) == min(k for k, t in tiles.items() if t == worst)
    blocks = [d[y : y + 8, x : x + 8] for y in range(0, 70, 8) for x in range(0, 90, 8)]
    assert made["block_mean"] == pytest.approx(max(abs(b.mean()) for b in blocks if b.size >= 16))
    assert made["mean"] == pytest.approx(d.mean()) and made["rms"] == pytest.approx(math.sqrt((d**2).mean()))


def test_alignment_is_that_of_the_long_form(spark, pairs):
    key = lambda r: (r["image"], r["dy"], r["dx"], r["field"])
    made = {key(r): (r["own"], r["moved"], r["margin"]) for r in errors.alignment(pairs, ["image"], MOVES, 2, 2).collect()}
    want = {key(r): (r["own"], r["moved"], r["margin"]) for r in samples.alignment(long(pairs), ["image"], MOVES, 2, 2).collect()}
    assert made.keys() == want.keys() and all(near(x, y) for k in want for x, y in zip(made[k], want[k]))


def test_cells(spark, pairs):
    planes, black = [[0, 1], [1, 2]], [[10.0, 20.0], [30.0, 40.0]]
    made = {(r["image"], r["cy"]): r["cells"] for r in errors.cell_means(pairs, ["image"], 4, 6, planes, black).collect()}
    assert len(made) == sum(-(-h // 4) for h, _ in SHAPES.values())
    for k, (v, _) in pictures().items():
        for cy in range(-(-len(v) // 4)):
            assert len(made[k, cy]) == -(-v.shape[1] // 6)
            for cx, got in enumerate(made[k, cy]):
                for p in range(3):
                    own = [v[y, x] - black[y % 2][x % 2] for y in range(cy * 4, min(len(v), cy * 4 + 4)) for x in range(cx * 6, min(v.shape[1], cx * 6 + 6)) if planes[y % 2][x % 2] == p]
                    assert near(got[p], sum(own) / len(own) if own else None)


@pytest.mark.parametrize("to", [(70, 90), (23, 17), (1, 1), (69, 44)])
def test_shrinking(spark, pairs, to, monkeypatch):
    monkeypatch.setattr(errors, "BAND", 7)
    sizes = spark.createDataFrame([(1, 70, 90, *to)], "image int, height int, width int, to_height int, to_width int")
    made = {r["y"]: r["line"] for r in errors.shrunk(pairs, sizes, ["image"]).collect()}
    weight = lambda n, m: np.array([[max(0.0, min(x + 1, (t + 1) * n / m) - max(x, t * n / m)) for x in range(n)] for t in range(m)]) / (n / m)
    want = weight(70, to[0]) @ pictures()[1][0] @ weight(90, to[1]).T
    assert sorted(made) == list(range(to[0]))
    assert all(made[y] == pytest.approx(want[y].tolist(), rel=1e-9) for y in made)


def test_shrinking_channels(spark):
    a = np.arange(6 * 8 * 3, dtype=float).reshape(6, 8, 3)
    rows = spark.createDataFrame([(1, y, a[y].ravel().tolist()) for y in range(6)], "image int, y int, line array<double>")
    sizes = spark.createDataFrame([(1, 6, 8, 3, 4)], "image int, height int, width int, to_height int, to_width int")
    made = np.array([r["line"] for r in errors.shrunk(rows, sizes, ["image"], 3).orderBy("y").collect()]).reshape(3, 4, 3)
    assert np.allclose(made, a.reshape(3, 2, 4, 2, 3).mean((1, 3)))


def test_nothing(spark, pairs):
    none = pairs.limit(0)
    sizes = spark.createDataFrame([], "image int, height int, width int, to_height int, to_width int")
    assert errors.error_statistics(none, ["image"]).count() == errors.alignment(none, ["image"], MOVES).count() == errors.cell_means(none, ["image"], 2, 2, [[0]]).count() == errors.shrunk(none, sizes, ["image"]).count() == 0
    flat = spark.createDataFrame([(1, 0, [5, 5], [5, 5]), (1, 1, [5, 5], [5, 5])], "image int, y int, line array<int>, stored array<int>")
    assert all(r["margin"] is None for r in errors.alignment(flat, ["image"], MOVES).collect())
    assert errors.error_statistics(flat, ["image"]).first()["most"] == 0
