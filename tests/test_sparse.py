"""Products in units against dense matrices: rows over several units, ties, signs, copies; solver and factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import krylov, ranking, sparse, walks


def cut(matrix, most, places=9):
    out = np.zeros_like(matrix)
    for i, row in enumerate(matrix):
        entries = np.flatnonzero(row)
        best = entries[np.lexsort((entries, -np.round(row[entries], places)))][:most]
        out[i, best] = row[best]
    return out


def a_matrix(n, seed, hub=True):
    draw = np.random.default_rng(seed)
    m = (draw.random((n, n)) < 0.12) * draw.integers(-3, 9, (n, n)).astype(float)
    if hub:
        m[3], m[:, 3] = draw.integers(1, 5, n), draw.integers(1, 5, n)
    m[7] = 0
    return m


def table_of(spark, m):
    return spark.createDataFrame([(f"n{i:03d}", f"n{j:03d}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i string, j string, v double")


def dense(edges, n):
    out = np.zeros((n, n))
    for r in edges.collect():
        out[int(r["i"][1:]), int(r["j"][1:])] = r["v"]
    return out


@pytest.mark.parametrize(("work", "per_copy"), [(1 << 21, 4096), (150, 4096), (150, 3), (20, 2)])
def test_pruned_katz_equals_dense_matrices(spark, monkeypatch, work, per_copy):
    """Integers with many ties: what is cut does not depend on how rows are dealt over units."""
    monkeypatch.setattr(sparse.cut_units, "__defaults__", (work,))
    monkeypatch.setattr(sparse, "PER_COPY", per_copy)
    n, most = 40, 6
    m = a_matrix(n, 5)
    current = total = m
    factor = 1.0
    for _ in range(3):
        current = cut(m @ current, most)
        factor *= 0.5
        total = cut(total + factor * current, most)
    got = dense(ranking.katz(table_of(spark, m), 0.5, max_iter=3, most_per_row=most, places=9), n)
    assert np.allclose(got, total, atol=1e-9) and ((got != 0) == (total != 0)).all()


def test_no_unit_has_more_than_its_work(spark):
    n = 60
    star = np.zeros((n, n))
    star[0, 1:], star[1:, 0] = 1.0, 1.0
    edges = table_of(spark, star)
    numbered = sparse.with_numbers(edges, sparse.node_numbers(edges))
    units = sparse.cut_units(numbered, longest=4, work=100)
    lengths = (star != 0).sum(axis=1)
    for r in units.packed.collect():
        products = [max(4, lengths[k]) for k in r["ks"]]
        assert sum(products[:-1]) < 100 + max(lengths)
    assert units.count > 20 and sum(len(r["ks"]) for r in units.packed.collect()) == 2 * (n - 1)
    product = sparse.to_edges(sparse.multiply_rows(units, sparse.to_rows(numbered))).collect()
    assert {(r["i"], r["j"]): r["v"] for r in product} == {(i, j): v for (i, j), v in np.ndenumerate(star @ star) if v}


def test_largest_keeps_small_columns_of_ties():
    rows, cols, vals = np.zeros(6, int), np.arange(6), np.array([1.0, 2.0, 1.0, -5.0, 2.0, 1.0])
    assert sparse.largest(rows, cols, vals, 3, None).tolist() == [True, True, False, False, True, False]
    assert sparse.largest(rows, cols, vals, 6, None).all() and sparse.largest(rows, cols, vals, None, None).all()


def test_both_ways_of_adding_up():
    draw = np.random.default_rng(3)
    rows = np.sort(draw.integers(0, 5, 400))
    cols, vals = draw.integers(0, 50, 400), draw.integers(-9, 9, 400).astype(float)
    near, far = sparse.add_up(rows, cols, vals), sparse.add_up(rows * 10**6, cols * 10**12, vals)
    assert all((a == b).all() for a, b in zip(near, (far[0] // 10**6, far[1] // 10**12, far[2]), strict=True))


@pytest.mark.parametrize("beta", [0.001, 0.1, 0.9])
def test_solver_equals_a_dense_solve(spark, beta):
    """Beyond 1 / spectral radius too, where a series in beta diverges; for a matrix that isn't symmetric."""
    n = 40
    m = np.abs(a_matrix(n, 8))
    found = krylov.solve(table_of(spark, m), spark.createDataFrame([("n004", 1.0)], "i string, v double"), beta, restart=50)
    want = np.linalg.solve(np.eye(n) - beta * m, np.eye(n)[4])
    got = {int(r["i"][1:]): r["v"] for r in found.values.collect()}
    assert found.residual <= 1e-8 and np.allclose([got.get(i, 0.0) for i in range(n)], want, atol=1e-6 * np.abs(want).max())
    assert beta == 0.001 or beta * np.abs(np.linalg.eigvals(m)).max() > 1


def test_solver_cuts_vectors_and_edges(spark, monkeypatch):
    """Many pieces and units, a node with edges to all others both ways, weights alike and not: no unit holds a hot row or column alone."""
    monkeypatch.setattr(krylov, "PIECE", 8)
    monkeypatch.setattr(krylov, "EDGES", 20)
    n = 40
    m = np.abs(a_matrix(n, 8))
    m[3, :] = 1.0
    m[:, 3] = 2.0
    cut = krylov._pieces(table_of(spark, m), spark.createDataFrame([("n004", 1.0)], "i string, v double"))
    assert cut.nodes.select("piece").distinct().count() > 3
    edges_of = [int(np.frombuffer(bytes(r["data"]), np.int64, 1)[0]) for r in cut.units.collect()]
    assert sum(edges_of) == np.count_nonzero(m) and max(edges_of) < 80
    found = krylov.solve(table_of(spark, m), spark.createDataFrame([("n004", 1.0)], "i string, v double"), 0.002)
    want = np.linalg.solve(np.eye(n) - 0.002 * m, np.eye(n)[4])
    got = {int(r["i"][1:]): r["v"] for r in found.values.collect()}
    assert np.allclose([got.get(i, 0.0) for i in range(n)], want, atol=1e-6)


def test_solver_starts_again_and_knows_nothing_to_do(spark):
    n = 40
    m = np.abs(a_matrix(n, 8))
    m = m + m.T
    b = spark.createDataFrame([("n004", 2.0), ("n004", -1.0), ("alone", 3.0)], "i string, v double")
    found = krylov.solve(table_of(spark, m), b, 0.004, restart=4)
    want = np.linalg.solve(np.eye(n) - 0.004 * m, np.eye(n)[4])
    got = {r["i"]: r["v"] for r in found.values.collect()}
    assert found.products > 5 and found.residual <= 1e-8 and got["alone"] == pytest.approx(3.0)
    assert np.allclose([got.get(f"n{i:03d}", 0.0) for i in range(n)], want, atol=1e-6)
    assert krylov.solve(table_of(spark, m), b.limit(0), 0.1).residual == 0.0


def test_singular_values_equal_those_of_the_dense_matrix(spark):
    draw = np.random.default_rng(4)
    m = (draw.random((50, 30)) < 0.3) * draw.normal(size=(50, 30))
    m[:, 5] = 0
    edges = table_of(spark, m)
    found = krylov.singular_factors(edges, 6)
    want = np.linalg.svd(m)
    assert np.allclose(found.values, want[1][:6], rtol=1e-6) and (found.residuals < 1e-3 * want[1][0]).all()
    for side in (found.left, found.right):
        u = np.array([r["u"] for r in side.collect()])
        assert np.allclose(u.T @ u, np.eye(6), atol=1e-8)
    best = np.linalg.norm(m - (want[0][:, :6] * want[1][:6]) @ want[2][:6])
    pairs = spark.createDataFrame([(f"n{i:03d}", f"n{j:03d}") for i in range(50) for j in range(30)], "i string, j string")
    assert np.linalg.norm(m - dense(krylov.rebuilt(found, pairs), 50)[:, :30]) == pytest.approx(best, rel=1e-5)


def test_a_matrix_of_small_rank(spark):
    m = np.outer(np.arange(1.0, 9), np.arange(1.0, 5)) + np.outer(np.ones(8), [0, 1.0, 0, 1.0])
    found = krylov.singular_factors(table_of(spark, m), 4)
    assert len(found.values) == 2 and np.allclose(found.values, np.linalg.svd(m)[1][:2])
    assert len(krylov.singular_factors(table_of(spark, m).limit(0), 4).values) == 0


def test_katz_columns_of_hot_nodes_lie_in_several_units(spark, monkeypatch):
    monkeypatch.setattr(sparse, "cut_units", lambda edges, longest, squared=True, cut=sparse.cut_units: cut(edges, longest, 40, squared))
    pairs = [(f"c{n:03}", f"i{n % 3}") for n in range(90)] + [("c001", "i0"), ("c002", "i0")]
    one = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "i string, j string, v double")
    both = one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    columns = one.select("j").distinct()
    got = {(r["i"], r["j"]): r["v"] for r in ranking.katz(both, 0.01, max_iter=2, columns=columns).collect()}
    want = {(r["i"], r["j"]): r["v"] for r in ranking.katz(both, 0.01, max_iter=2).collect() if r["j"].startswith("i")}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_factors_shuffle_dense_rows_and_not_edges(spark):
    """Rows in several units, and a row of more edges than a unit, give the same factors."""
    draw = np.random.default_rng(5)
    m = (draw.random((60, 40)) < 0.2) * draw.normal(size=(60, 40))
    m[7] = draw.normal(size=40)
    edges = table_of(spark, m)
    units = krylov._row_units(edges, 24)
    assert units.packed.count() > 5 and {r["i"] for r in units.long.select("i").distinct().collect()} == {"n007"}
    # A unit asks for each column once, so no more rows leave for it than it has columns.
    assert units.wants["j"].count() == units.wants["j"].distinct().count() < edges.count()
    want = np.linalg.svd(m)
    for size in (24, 1 << 20):
        found = krylov.singular_factors(edges, 6, unit=size)
        assert np.allclose(found.values, want[1][:6], rtol=1e-6) and (found.residuals < 1e-3 * want[1][0]).all()
        u = np.array([r["u"] for r in found.left.collect()])
        assert np.allclose(u.T @ u, np.eye(6), atol=1e-8)


@pytest.mark.parametrize("kept", [0, 12_000_000])
def test_unpruned_rows_are_made_without_products_between(spark, monkeypatch, kept):
    rng = np.random.default_rng(5)
    half = (rng.random((9, 14)) < 0.3) * rng.integers(1, 4, (9, 14)).astype(float)
    names = [*(f"c{n}" for n in range(9)), *(f"i{n:02}" for n in range(14))]
    m = np.block([[np.zeros((9, 9)), half], [half.T, np.zeros((14, 14))]])
    both = spark.createDataFrame([(names[a], names[b], float(m[a, b])) for a, b in np.argwhere(m)], "i string, j string, v double")
    monkeypatch.setattr(ranking, "_joined", None)
    monkeypatch.setattr(walks, "KEPT", kept)
    monkeypatch.setattr(walks, "PIECE", 5)
    monkeypatch.setattr(walks, "TOGETHER", 2)
    k = m + 0.1 * m @ m + 0.01 * m @ m @ m
    got = {(r["i"], r["j"]): r["v"] for r in ranking.katz(both, 0.1, max_iter=2).collect()}
    assert got == {(names[a], names[b]): pytest.approx(k[a, b]) for a, b in np.argwhere(k)}
    rows = spark.createDataFrame([(n,) for n in names[:9]], "i string")
    columns = spark.createDataFrame([(n,) for n in names[9:]], "j string")
    best = {}
    for r in ranking.katz_best(both, 0.1, 3, max_iter=2, rows=rows, columns=columns).collect():
        best.setdefault(r["i"], set()).add(r["j"])
    want = {}
    for a in range(9):
        fresh = [b for b in range(9, 23) if k[a, b] > 0 and not m[a, b]]
        if fresh:
            want[names[a]] = {names[b] for b in sorted(fresh, key=lambda b: (-round(k[a, b], 6), names[b]))[:3]}
    assert best == want


def test_sums_of_zero_stay_entries(spark):
    both = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("x", "b", 1.0), ("y", "b", -1.0)], "i string, j string, v double")
    assert ("a", "b", 0.0) in {tuple(r) for r in ranking.katz(both, 0.5, max_iter=1).collect()}


def test_products_are_kept_in_files_and_not_shuffled(spark):
    """A product takes its right rows from files, wherever they lie, and rows of several units are whole again in the index."""
    m = a_matrix(30, 4)
    edges = table_of(spark, m)
    numbers = sparse.node_numbers(edges)
    numbered = sparse.with_numbers(edges, numbers).persist()
    units = sparse.cut_units(numbered, 30, 150)
    product = sparse.multiply_rows(units, sparse.keep(numbered))
    assert units.count > 3 and isinstance(product, sparse.Kept)
    lines = product.index.collect()
    assert len({r["file"] for r in lines}) > 1 and len({r["i"] for r in lines}) == len(lines)
    order = {r["number"]: int(r["node"][1:]) for r in numbers.collect()}
    want = m @ m
    met = {(order[r["i"]], order[r["j"]]): r["v"] for r in product.entries().collect()}
    assert all(met.get((a, b), 0.0) == want[a, b] for a, b in np.ndindex(*want.shape))
    rows = sparse.Rows.of(product.folder, product.index_files())
    asked = np.array([2, 5, 29, 77])
    ends, cols, vals = rows.rows(asked)
    assert ends[-1] == len(cols) == rows.sizes(asked).sum() and (np.diff(ends, prepend=0) == rows.sizes(asked)).all() and rows.sizes(asked)[-1] == 0
    numbered.unpersist()


def test_pruned_lists_leave_edges_out(spark):
    """The best entries of pruned rows without those of the graph, of the rows and columns asked for alone."""
    n, most = 40, 12
    m = np.abs(a_matrix(n, 5))
    current = total = m
    for f in (0.5, 0.25):
        current = cut(m @ current, most)
        total = cut(total + f * current, most)
    rows = spark.createDataFrame([(f"n{i:03d}",) for i in range(0, n, 2)], "i string")
    columns = spark.createDataFrame([(f"n{i:03d}",) for i in range(20, n)], "j string")
    got = {(r["i"], r["j"]) for r in ranking.katz_best(table_of(spark, m), 0.5, 2, max_iter=2, rows=rows, columns=columns, most_per_row=most, cut_places=9).collect()}
    want = set()
    for i in range(0, n, 2):
        fresh = [j for j in range(20, n) if total[i, j] > 0 and not m[i, j]]
        want |= {(f"n{i:03d}", f"n{j:03d}") for j in sorted(fresh, key=lambda j: (-round(total[i, j], 6), j))[:2]}
    assert got == want


def test_walks_read_only_the_rows_they_name(monkeypatch, tmp_path):
    """A step's products come from the rows of its entries, some at once; dense steps add hot columns' edges one slot after the other."""
    m = np.abs(a_matrix(40, 6))
    i, j = np.nonzero(m)
    out = sparse.Writer(f"file://{tmp_path}")
    rows = sparse.Rows(out.folder, sparse.pa.Table.from_batches([out.put(i[:90], j[:90], m[i, j][:90]), out.put(i[90:], j[90:], m[i, j][90:])]))
    out.close()
    asked = np.array([3, 8, 11])
    ends, cols, vals = rows.rows(asked)
    monkeypatch.setattr(walks, "PRODUCTS", 7)
    r, c, v = walks.sparse_step((np.repeat(np.arange(3), np.diff(ends, prepend=0)), cols.astype(np.int64), vals), rows)
    got = np.zeros((3, 40))
    got[r, c] = v
    assert np.allclose(got, (m @ m)[asked])
    monkeypatch.setattr(walks, "SLOTS", 4)
    monkeypatch.setattr(walks, "CHUNK", 8)
    order = np.lexsort((i, j))
    dense_out = np.zeros((40, 3))
    for part in np.array_split(order, 3):
        walks.Piece(i[part], j[part], m[i, j][part]).add(np.ascontiguousarray(m[asked].T), dense_out)
    assert np.allclose(dense_out.T, (m @ m)[asked])


def test_units_carry_no_lists(spark):
    """A table of lists of a unit's edges is read thousands of rows at once; the edges lie in files, and rows of several units are marked."""
    star = np.zeros((60, 60))
    star[0, 1:], star[1:, 0] = 1.0, 1.0
    edges = table_of(spark, star)
    units = sparse.cut_units(sparse.with_numbers(edges, sparse.node_numbers(edges)), 4, 40)
    assert not any(kind.startswith("array") for _, kind in units.lines.dtypes)
    assert {(r["i"], r["open"]) for r in units.lines.collect()} == {(0, True), *((i, False) for i in range(1, 60))}


def test_lists_of_few_columns_equal_those_of_walks(spark):
    pairs = [(f"c{n:03}", f"i{(n * k) % 5}") for n in range(40) for k in (1, 3)]
    one = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(set(pairs))], "i string, j string, v double")
    both = one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    rows, columns = one.select("i").distinct(), one.select("j").distinct()
    lists = [{(r["i"], r["j"], round(r["v"], 9)) for r in ranking.katz_best(both, 0.1, 2, max_iter=2, rows=rows, columns=columns, few_columns=f).collect()} for f in (True, False)]
    assert lists[0] == lists[1] and len(lists[0]) > 40


def test_steps_of_factors_shuffle_no_rows(spark, monkeypatch):
    """Steps read dense rows from files, some rows of the matrix at once, whatever order they lie in; only `rebuilt` deals rows to units."""
    draw = np.random.default_rng(9)
    m = (draw.random((50, 30)) < 0.4) * draw.normal(size=(50, 30))
    monkeypatch.setattr(krylov, "_in_units", None)
    found = krylov.singular_factors(table_of(spark, m), 5, unit=64)
    want = np.linalg.svd(m)
    u, v = ({r["id"]: np.array(r["u"]) for r in side.collect()} for side in (found.left, found.right))
    low = np.array([[(u[f"n{i:03d}"] * found.values) @ v[f"n{j:03d}"] for j in range(30)] for i in range(50)])
    assert np.allclose(low, (want[0][:, :5] * want[1][:5]) @ want[2][:5], atol=1e-3)
