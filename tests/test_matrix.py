import numpy as np
import pytest

from graphflow.operators import matrix
from graphflow.schema import ABC, MatrixMeta
from graphflow.sources import abc
from model import stochastic, triangles

# The small matrices and their expected sizes.
F1 = [(0, 1, 0.5), (0, 2, 0.1), (0, 4, 0.4), (1, 1, 0.6), (1, 2, 0.2), (1, 3, 0.6), (1, 6, 0.1), (1, 7, 0.7), (2, 5, 0.4), (2, 8, 0.2)]
F3 = [(c, r, round(0.1 * (i + 1), 1)) for i, (c, r, _) in enumerate(F1)]
F4 = [(c, r, round(0.1 * (i + 1), 1)) for i, (c, r) in enumerate([(0, 1), (0, 2), (0, 4), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2)])]
F5 = list(zip((0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 2), (1, 2, 2, 4, 1, 2, 3, 3, 6, 7, 5, 8, 8), (0.1, 0.2, -1, 0.3, 0.4, 0.5, 0.6, 1, 0.7, 0.8, 0.9, 1, 1), strict=True))


@pytest.fixture
def of(spark):
    return lambda rows: spark.createDataFrame([(c, r, float(v)) for c, r, v in rows], ABC)


def entries(df):
    return sorted((r["col"], r["row"], r["val"]) for r in df.collect())


def test_entries_and_size(of):
    assert of(F1).count() == 10 and entries(of(F1)) == sorted((c, r, float(v)) for c, r, v in F1)
    assert of([]).isEmpty()


def test_equal(of):
    assert matrix.equal(of(F1), of(F1[::-1]))
    assert not matrix.equal(of(F1), of(F3)) and not matrix.equal(of(F1), of(F1[:-1]))


def test_row_blocks(of):
    sizes = lambda m: {b: n for b, n in m.groupBy("block").agg({"size": "sum"}).collect()}
    assert sizes(matrix.transpose_blocks(of(F3), 3)) == {0: 4, 1: 3, 2: 3}
    assert sizes(matrix.transpose_blocks(of(F4), 3)) == {0: 7, 1: 3}
    local = matrix.by_row(of(F3), 3).collect()
    assert len(local) == 10 and all(0 <= r["local_row"] < 3 for r in local)


def test_duplicates_keep_first_or_largest(spark, of):
    numbered = spark.createDataFrame([(i, c, r, float(v)) for i, (c, r, v) in enumerate(F5)], "seq long, col long, row long, val double")
    assert entries(matrix.dedup(numbered, "first", "seq")) == entries(of(F3))
    assert dict(((c, r), v) for c, r, v in entries(matrix.dedup(of(F5))))[1, 3] == 1.0
    assert matrix.ssd(of(F3), matrix.dedup(numbered, "first", "seq")) == 0
    with pytest.raises(ValueError):
        matrix.dedup(of(F5), "first")


def test_add_to_nothing(of):
    assert entries(matrix.add(of([]), of(F3))) == entries(of(F3))
    assert matrix.ssd(of([]), of(F3)) == pytest.approx(sum(v * v for _, _, v in F3))


def test_loops(of):
    looped = dict(((c, r), v) for c, r, v in entries(matrix.add_loops(of(triangles()))))
    assert all(looped[i, i] == 1.0 for i in range(6)) and len(looped) == 20
    assert entries(matrix.add_loops(of([(3, 3, 0.2)]))) == [(3, 3, 1.0)]
    with pytest.raises(Exception, match="no diagonal"):
        matrix.add_loops(of([(0, 1, 0.4)])).collect()
    assert entries(matrix.add_loops(of([(0, 1, 0.4)]), "insert")) == [(0, 0, 0.4), (0, 1, 0.4)]


def test_normalise_and_build(of):
    got = dict(((c, r), v) for c, r, v in entries(matrix.build(of([*triangles(), (0, 9, 0.0), (9, 0, -1.0)]))))
    assert got[2, 0] == pytest.approx(0.322581, abs=1e-6) and got[2, 3] == pytest.approx(0.032258, abs=1e-6)
    want = stochastic(triangles(), 6)
    assert all(got.get((c, r), 0) == pytest.approx(want[r, c]) for r in range(6) for c in range(6))


@pytest.mark.parametrize("strategy", ["coo", "blocked"])
def test_multiply(of, strategy):
    rng = np.random.default_rng(1)
    a, b = (rng.random((9, 9)) * (rng.random((9, 9)) < 0.4) for _ in range(2))
    df = lambda m: of([(c, r, m[r, c]) for r in range(9) for c in range(9) if m[r, c]])
    got = np.zeros((9, 9))
    for c, r, v in entries(matrix.multiply(df(a), df(b), strategy)):
        got[r, c] = v
    assert np.allclose(got, a @ b)
    assert matrix.expansion_size(df(a), df(b)) == int(((a != 0).sum(0) * (b != 0).sum(1)).sum())


def test_replicate_and_dense(of):
    got = entries(matrix.replicate_diagonal(of(F1), 9, 3))
    assert len(got) == 30 and (18, 19, 0.5) in got and max(max(c, r) for c, r, _ in got) == 26
    with pytest.raises(ValueError):
        matrix.replicate_diagonal(of(F1), 9, 0)
    assert {r["col"]: r["vals"] for r in matrix.dense(of(F1), 9).collect()}[2] == [0, 0, 0, 0, 0, 0.4, 0, 0, 0.2][:5] + [0.4, 0.0, 0.0, 0.2]


def test_analyse_and_files(spark, of, tmp_path):
    rows = of([*F5, (50, 1, 0.0), (1, 60, -3.0)])
    n = abc.write_abc(rows, str(tmp_path / "a"))
    assert n == len(F5) + 2
    back = abc.read_abc(spark, str(tmp_path / "a"))
    assert entries(back) == entries(rows)
    assert abc.analyse_abc(back) == (9, 6)
    m, meta = abc.build_matrix(of(triangles()), scale=2, nsub=4)
    abc.save_matrix(m, meta, str(tmp_path / "m"))
    again, meta2 = abc.load_matrix(spark, str(tmp_path / "m"))
    assert meta2 == meta == MatrixMeta(12, 4, 4) and matrix.equal(m, again)
    where = abc.write_graph(of([(0, 1, 0.12345678), (1, 0, 1.0)]), str(tmp_path / "g"))
    assert where.endswith("matrix.abc") and sorted(r[0] for r in spark.read.text(where).collect()) == ["0\t1\t0.123457", "1\t0\t1.000000"]
    with pytest.raises(ValueError):
        abc.build_matrix(of([(0, 0, -1.0)]))


def test_metadata():
    with pytest.raises(ValueError):
        MatrixMeta(0).check()
    with pytest.raises(ValueError):
        MatrixMeta(5).check(MatrixMeta(6))
    assert MatrixMeta(50, kmax=8).product(MatrixMeta(50, kmax=9)).kmax == 50
