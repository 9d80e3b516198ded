import numpy as np
import pytest

from attesta.llm.nn_descent import audited, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    """id -> (links, component) by all pairs."""
    x = {}
    for k, (i, v, _) in enumerate(rows):
        a = np.array([np.nan if c is None else c for c in v], np.float32).astype(float) if v else np.zeros(0)
        if len(a) and np.isfinite(a).all() and np.any(a) and i is not None:
            x[k] = a / np.linalg.norm(a)
    links = {k: [j for j in x if j != k and len(x[j]) == len(x[k]) and x[j] @ x[k] >= threshold] for k in range(len(rows)) if k in x}
    comp = {k: k for k in links}
    changed = True
    while changed:
        changed = False
        for k, near in links.items():
            low = min([comp[k], *[comp[j] for j in near]], key=lambda c: rows[c][0])
            if rows[comp[k]][0] > rows[low][0]:
                comp[k], changed = low, True
    return {rows[k][0]: (len(near), rows[comp[k]][0]) for k, near in links.items()}


def clustered(rng, n=400, dim=16):
    out = []
    while len(out) < n:
        centre = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 2, 3, 10, 60])):
            out.append((centre + rng.choice([0.0, 0.02, 0.1, 0.16]) * rng.normal(size=dim)).astype(np.float32).tolist())
    return [(i * 3 + 1, v, 0) for i, v in enumerate(out[:n])]


def test_against_brute_force(spark):
    rows = clustered(np.random.default_rng(1))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_planted_copies_in_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(400)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    rng = np.random.default_rng(2)
    for k in range(300):
        v = np.array(rows[k % 7][1])
        rows.append((100_000 + k, (v + (0.002 if k % 2 else 0) * rng.normal(size=len(v))).astype(np.float32).tolist(), 0))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and got[0].recall >= 0.97


def test_wide_group_is_counted_exactly(spark):
    """A chain whose ends are not linked: no pivot sees all."""
    angle = np.arange(0, 120) * 0.02
    rows = [(i, [float(np.cos(a)), float(np.sin(a)), 0.0], 0) for i, a in enumerate(angle)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0),
        (8, [None, 1.0], 0), (9, [], 0), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1e-30, 0.0], 0), (12, [1e30, 1e28], 0), (13, [0.0, 1.0], 0), (13, [1.0, 0.0], 0),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_links string")
    got = sorted(near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect(), key=lambda r: (r.vec_id or 0, r.n_links))
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert all(by[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10)) and by[None] == (0, None)
    assert all(by[i] == (6, 1) for i in (1, 2, 3, 11, 12)) and [r.component_id for r in got if r.vec_id == 13] == [13, 1]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_tables(spark, n):
    rows = [(5, [1.0, 2.0], 0), (4, [1.0, 2.001], 0)][:n]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def tight_pairs(rng, pairs, size=12, dim=32, between=0.91):
    """Pairs of groups: cosines inside a group near 1, between the two of a pair ``between``, else low."""
    out = []
    for _ in range(pairs):
        a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        for centre in (a, between * a + np.sqrt(1 - between**2) * b):
            out += [(centre + 0.002 * rng.normal(size=dim) / np.sqrt(dim)).astype(np.float32).tolist() for _ in range(size)]
    return [(i, out[j], 0) for i, j in enumerate(rng.permutation(len(out)))]


@pytest.mark.parametrize("pairs", [1, 40])
def test_links_beside_full_lists(spark, pairs):
    """Every node has more than k better neighbours than those in the other group."""
    rows = tight_pairs(np.random.default_rng(3), pairs)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    """A third of the nodes in one group that is found, all isolated pairs lost; and a table without links."""
    rng = np.random.default_rng(4)
    unit = lambda v: (v / np.linalg.norm(v)).tobytes()
    centre, rows = rng.normal(size=32), []
    for i in range(300):
        rows.append((i, unit(centre + 0.01 * rng.normal(size=32)), 0))
    for i in range(300, 900, 2):
        v = rng.normal(size=32)
        rows += [(i, unit(v), i), (i + 1, unit(v + 0.01 * rng.normal(size=32)), i + 1)]
    schema = "id long, unit binary, component long"
    assert audited(spark.createDataFrame(rows, schema), len(rows), 0.9, 400, 0) < 0.1
    found = [(i, u, c if i < 300 else i // 2 * 2) for i, u, c in rows]
    assert audited(spark.createDataFrame(found, schema), len(rows), 0.9, 400, 0) == 1
    alone = [(i, unit(v), i) for i, v in enumerate(np.eye(32))]
    assert audited(spark.createDataFrame(alone, schema), len(alone), 0.9, 400, 0) is None


def test_nothing_measured_is_null(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.eye(20, dtype=np.float32))]
    assert {(r.n_links, r.recall) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {(0, None)}


def test_ties_at_the_threshold(spark):
    """A cosine of exactly 0.9 is a link, one 5e-10 below is none, in n_links and component alike."""
    below = 0.9 - 5e-10
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (2, [9.0, 3.0, 3.0, 1.0], 0), (3, [below, 0.0, 0.0, -float(np.sqrt(1 - below**2))], 0), (4, [0.0, 0.0, 2.0, 0.0], 0)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}
