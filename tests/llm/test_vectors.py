import numpy as np
import pytest

from ledgerwake.llm import nndescent
from ledgerwake.llm.queries import oracle_sql, queries

from ..oracle import duck_rows, rows


def brute(table, threshold=0.9):
    ok = [(k, v) for k, v in enumerate(x for _, x in table) if v is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, group = [0] * len(table), list(range(len(table)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, (i, v) in enumerate(ok):
        for j, w in ok[:x]:
            if len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                n[i] += 1
                n[j] += 1
                group[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(table):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return sorted(str((k, n[i], least.get(top(i)))) for i, (k, _) in enumerate(table))


def found(spark, table):
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in nndescent.link(df).collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    table = [(i, (base + rng.standard_normal(8) * 0.25).tolist()) for i in range(40)] + [(100 + i, rng.standard_normal(8).tolist()) for i in range(40)]
    table += [(200 + i, [1.0] * 8) for i in range(50)] + [(250, [2.0] * 8), (251, [1e300] * 8), (252, [1e-300] * 8)]
    table += [
        (300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7), (304, [float("inf")] * 8),
        (305, []), (306, [1.0, 1.0]), (307, [1.0, 1.0]), (307, [1.0, 1.0]), (None, [1.0] * 8),
    ]
    want = brute([(k, None if v is None else [c / 1e299 if c and abs(c) > 1e200 and np.isfinite(c) else c * 1e299 if c and abs(c) < 1e-200 else c for c in v]) for k, v in table])
    assert found(spark, table) == want


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0, 0.0])]) == ["(1, 0, 1)"]


def test_a_crowded_cluster_keeps_every_link(spark):
    """More close vectors than a list or a block holds."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    table = [(i, (base + rng.standard_normal(16) * 0.12).tolist()) for i in range(700)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    x = np.array([v for _, v in table])
    x /= np.linalg.norm(x, axis=1)[:, None]
    degree = (x @ x.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in nndescent.link(df).collect()} == {k: d for (k, _), d in zip(table, degree.tolist(), strict=True)}


def _a_crowd_and_pairs():
    """One group of a third of the rows, and pairs that have no other neighbours."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal(32)
    table = [(i, (base + rng.standard_normal(32) * 0.1).tolist()) for i in range(300)]
    for k in range(300):
        v = rng.standard_normal(32)
        table += [(1000 + 2 * k, v.tolist()), (1001 + 2 * k, (v + rng.standard_normal(32) * 0.4).tolist())]
    return table


def test_lost_pairs_are_seen_beside_a_crowd(spark):
    table = _a_crowd_and_pairs()
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in nndescent.link(df, trees=1, steps=0).collect()}
    want = {int(k): int(c) for k, _, c in (x.strip("()").split(", ") for x in brute(table))}
    pairs = [k for k in want if k > 1000 and want[k] != k]
    assert len(pairs) > 200 and sum(got[k] != want[k] for k in pairs) <= (1 - nndescent.TARGET) * len(pairs)


def test_the_last_round_compares_all(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "MOST_ROUNDS", 1)
    table = _a_crowd_and_pairs()
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in nndescent.link(df, trees=1, steps=0).collect()) == brute(table)


@pytest.mark.parametrize(("size", "between"), [(20, 0.93), (60, 0.88)])
def test_dense_groups_that_few_links_join(spark, monkeypatch, size, between):
    """Each vector has more neighbours in its group than a list holds, all of them nearer than the other group's."""
    monkeypatch.setattr(nndescent, "audit", lambda *_: 1.0)  # more rounds and the last resort aside
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v)
    p, q = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    centres = [p, between * p + np.sqrt(1 - between**2) * q]
    table = [(1000 * k + i, unit(c + 0.14 * unit(rng.standard_normal(64))).tolist()) for k, c in enumerate(centres) for i in range(size)]
    table += [(5000 + i, rng.standard_normal(64).tolist()) for i in range(300)]
    want = brute(table)
    assert sum(x.endswith(", 0)") for x in want) == 2 * size
    assert found(spark, table) == want


@pytest.mark.parametrize("name", ["op6_nn_descent", "op7_warc_zip", "op8_source_mixing"])
def test_sql(spark, small, name):
    assert rows(queries()[name](spark, small)) == duck_rows(oracle_sql()[name], small)
