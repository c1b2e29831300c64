import numpy as np
import pytest

from quarkflow.llm import nn_descent, superminhash
from quarkflow.llm.components import UnionFind, components
from quarkflow.llm.queries import op5_nn_descent

from .oddities import empty, odd


def brute_components(pairs, nodes):
    u = UnionFind()
    for n in nodes:
        u.find(n)
    for a, b in pairs:
        u.union(a, b)
    return {n: u.find(n) for n in nodes}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1200)] + [tuple(p) for p in rng.integers(2000, 2300, (200, 2)).tolist()]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs for x in p}
    want = brute_components(pairs, nodes)
    assert {n: got.get(n, n) for n in nodes} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = [i for i in sets if sets[i]]
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, brute_components(pairs, sets)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"w{rng.integers(10_000)}"
    return " ".join(words)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_copies_against_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    base = [[f"v{x}" for x in rng.integers(0, 500, 120)] for _ in range(4)]
    rows = [(i, edited(rng, base[i % 4], rng.integers(0, 9))) for i in range(240)]
    rows += [(300, "one two"), (301, "ONE  two"), (302, "one"), (303, ""), (304, None), (305, rows[0][1].upper())]
    got = {r.doc_id: r for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", k, percent).collect()}
    sizes, want = jaccard_components(rows, k, percent)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_tiles_of_any_size_find_the_same_links(spark):
    rng = np.random.default_rng(9)
    base = [f"v{x}" for x in rng.integers(0, 500, 100)]
    rows = [(i, edited(rng, base, 4)) for i in range(60)]
    sets = [superminhash.shingles(t, 3) for _, t in rows]
    sig = superminhash.superminhash(np.concatenate(sets), np.repeat(np.arange(60), [len(s) for s in sets]), 60)
    low = (superminhash.mix64(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
    opened = [(1, i, i, 0, 0, bytearray(low[i].tobytes()), t) for i, t in rows]
    df = spark.createDataFrame(opened, "band long, id long, component long, main long, pivot long, sketch binary, text string")
    _, want = jaccard_components(rows[1:], 3, 85)
    for block in (7, 512):
        links = [(r.u, r.v) for r in superminhash.across(df, 3, 85, block).collect()]
        assert brute_components(links, [i for i, _ in rows[1:]]) == want


def test_bands_miss_next_to_no_pair_at_the_threshold():
    for percent, want in ((80, 32), (85, 25), (95, 14)):
        bands = superminhash.bands_for(percent)
        rows = superminhash.REGISTERS // bands
        assert bands == want and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    assert superminhash.bands_for(1) == superminhash.REGISTERS


def test_sketches_leave_what_may_be_linked(spark):
    """Pairs and members that sketches rule out go, all others stay, in tiles of any size; no pairs come out of tiles."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (3, 128), dtype=np.uint8)
    sketches = {}
    for i in range(45):  # groups of likes; of the third all are unlike
        x = base[i % 3].copy() if i % 3 < 2 else rng.integers(0, 256, 128, dtype=np.uint8)
        x[rng.permutation(128)[: 10 if i % 3 < 2 else 0]] += 1
        sketches[i] = x
    least = superminhash.least_agreement(85)
    like = lambda a, b: (sketches[a] == sketches[b]).sum() >= least
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sketches.items()], "id long, sketch binary")
    pairs = [(a, b) for a in range(45) for b in range(a)]
    got = superminhash.likely(spark.createDataFrame(pairs, "u long, v long"), table, 85).collect()
    assert {(r.u, r.v) for r in got} == {(a, b) for a, b in pairs if like(a, b)}
    # 0 is the band's pivot and in the main component with 3; all others are on their own.
    rows = [(7, i, 0 if i == 3 else i, 0, 0, bytearray(x.tobytes())) for i, x in sketches.items()]
    opened = spark.createDataFrame(rows, "band long, id long, component long, main long, pivot long, sketch binary")
    want = {i for i in range(1, 45) for j in range(1, 45) if i != j and like(i, j) and rows[i][2] != rows[j][2]}
    for block in (7, 512):
        assert {(r.band, r.id) for r in superminhash.undecided(opened, 85, block).collect()} == {(7, i) for i in want}
    assert superminhash.undecided(opened.where("id % 3 = 2"), 85).collect() == [] and superminhash.likely(spark.createDataFrame([], "u long, v long"), table, 85).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (2, 20, 400, 40_000):
        x = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
        a, b = np.unique(x[: 2 * n]), np.unique(x[n:])
        sig = superminhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.16
        alone = superminhash.superminhash(a, np.zeros(len(a), np.int64), 1)
        assert (alone[0] == sig[0]).all()


@pytest.mark.parametrize("k, percent", [(5, 80), (3, 85)])
def test_isolated_pairs_at_the_threshold(spark, k, percent):
    # A pair shares `both` shingles and each has `own` of its own: 100 * both = percent * (both + 2 * own). No other text is like them.
    own = 10 if percent == 80 else 3
    both = percent * 2 * own // (100 - percent)
    assert 100 * both == percent * (both + 2 * own)
    rows = []
    for i in range(400):
        common = [f"c{i}x{j}" for j in range(both + k - 1)]
        rows += [(2 * i + s, " ".join(common + [f"o{i}s{s}x{j}" for j in range(own)])) for s in (0, 1)]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", k=k, percent=percent).collect()
    assert {r.id: r.component_id for r in got} == {i: i - i % 2 for i in range(800)}


def test_near_copies_of_odd_rows(spark):
    rows = superminhash.near_duplicates(odd(spark), "doc_id", "text").collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert by[6].component_id == 1 and by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[None].component_id is None and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (2, 3, 10))
    assert superminhash.near_duplicates(empty(spark), "doc_id", "text").count() == 0


# --- vectors


def brute_vectors(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    pairs, n = [], {}
    for x, (a, va) in enumerate(good):
        for b, vb in good[:x]:
            if va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= threshold:
                pairs.append((a, b))
                n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    return n, brute_components(pairs, [i for i, _ in rows])


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + rng.standard_normal(8) * 0.12).tolist()) for i in range(180)] + [(i, rng.standard_normal(8).tolist()) for i in range(200, 500)]
    rows += [(600 + i, rows[0][1]) for i in range(40)]
    rows += [(700, None), (701, [0.0] * 8), (702, [None] + [1.0] * 7), (703, [float("nan")] * 8), (704, [1.0, 2.0]), (705, [float("inf")] * 8), (706, [2 * x for x in rows[1][1]])]
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, component string"), "vec_id", "embedding").collect()}
    n, want = brute_vectors(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: n.get(i, 0) for i, _ in rows}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_dense_groups_whose_lists_hold_only_their_own(spark):
    rng = np.random.default_rng(5)
    # In a group cosines are about .99, across the groups about .96: no list of 32 has room for the other group.
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    turn = rng.standard_normal(64)
    turn -= turn @ base * base
    turn /= np.linalg.norm(turn)
    angle = np.arccos(0.97) / 2
    rows = []
    for g in (-1, 1):
        centre = np.cos(angle) * base + g * np.sin(angle) * turn
        rows += [(len(rows) + i, (centre + 0.0125 * rng.standard_normal(64)).tolist()) for i in range(150)]
    x = np.array([v for _, v in rows])
    sims = nn_descent.cosines(x, x)
    np.fill_diagonal(sims, 0)
    assert (sims[:150, 150:] >= 0.95).mean() > 0.9 and (np.sort(sims[:150, :150], axis=1)[:, -32] > sims[:150, 150:].max(axis=1)).all()
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()
    assert {r.component_id for r in got} == {0}
    assert {r.id: r.n_links for r in got} == dict(enumerate((sims >= 0.95).sum(axis=1).tolist()))
    assert {r.audit_recall for r in got} == {1.0}


def test_cells_near_each_other_are_found_in_shares_of_any_size(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((12, 16))[rng.integers(0, 12, 200)] + 0.3 * rng.standard_normal((200, 16))
    radii = rng.random(200) * 0.3
    heads = spark.createDataFrame([(i, i // 2, float(radii[i]), v.tobytes()) for i, v in enumerate(x)], "hub long, component long, radius double, vec binary")
    angles = np.arccos(np.clip(nn_descent.cosines(x, x), -1, 1))
    want = {(a, b) for a in range(200) for b in range(a) if angles[a, b] <= radii[a] + radii[b] + 0.3 and a // 2 != b // 2}
    for share_bytes, rows in ((1 << 20, 256), (16 * 8 * 30, 7)):
        assert {(r.b, r.a) for r in nn_descent.near_cells(heads, 0.3, share_bytes, rows).collect()} == want
    assert want


@pytest.mark.parametrize("block", [4, 30, 512])
def test_links_are_counted_in_blocks_of_any_size(spark, block):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    # A dense kernel, where blocks are certain, and a wide surrounding.
    x = np.concatenate([centre + 0.02 * rng.standard_normal((60, 16)), centre + 0.4 * rng.standard_normal((140, 16))])
    n = rng.integers(1, 4, 200)
    vectors = spark.createDataFrame([(i, v.tobytes(), int(m)) for i, (v, m) in enumerate(zip(x, n))], "id long, vec binary, n long")
    named = spark.createDataFrame([(i, 0) for i in range(1, 200)], "node long, component long")
    near = nn_descent.cosines(x, x) >= 0.95
    np.fill_diagonal(near, False)
    got = {r.id: r.links for r in nn_descent.count_links(vectors, named, 0.95, block).collect()}
    assert [got.get(i, 0) for i in range(200)] == (near @ n).tolist()


def _mixture(copies: int, pairs: int, others: int) -> np.ndarray:
    """A dense group, pairs of cosine 0.9505 that have nobody else, and random vectors."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one, turn = unit(rng.standard_normal((pairs, 64))), rng.standard_normal((pairs, 64))
    turn = unit(turn - (turn * one).sum(axis=1, keepdims=True) * one)
    dense = unit(rng.standard_normal((1, 64))) + 0.005 * rng.standard_normal((copies, 64))
    return np.concatenate([dense, one, 0.9505 * one + np.sqrt(1 - 0.9505**2) * turn, rng.standard_normal((others, 64))])


def test_lone_pairs_beside_a_dense_group_are_kept(spark):
    x = _mixture(400, 400, 8000)
    got = nn_descent.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4), "id", "v").collect()
    component = {r.id: r.component_id for r in got}
    assert [component[800 + i] for i in range(400)] == [400 + i for i in range(400)] and {component[i] for i in range(400)} == {0}
    assert {r.audit_recall for r in got} == {1.0} and {r.n_links for r in got if 400 <= r.id < 1200} == {1}


def test_the_audit_counts_vectors_and_the_last_way_is_exact(spark, monkeypatch):
    """One table finds some lone pairs only: the audit says so, beside a dense group whose links are all found, and a completion among all vectors follows."""
    x = _mixture(300, 200, 3000)
    said, audit = [], nn_descent.audit
    monkeypatch.setattr(nn_descent, "audit", lambda *a: said.append(audit(*a)) or said[-1])
    monkeypatch.setattr(nn_descent, "tables_for", lambda *a: 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = nn_descent.near_duplicates(df, "id", "v", tables=1, rounds=1, attempts=1, queries=1000).collect()
    assert said[0] < 0.95 and said[-1] == 1.0
    component = {r.id: r.component_id for r in got}
    assert [component[500 + i] for i in range(200)] == [300 + i for i in range(200)] and {r.audit_recall for r in got} == {1.0}


def test_tables_grow_with_the_vectors():
    assert nn_descent.tables_for(0, 0.95) == nn_descent.tables_for(200, 0.95) == 1
    few, many = nn_descent.tables_for(20_000, 0.95), nn_descent.tables_for(2_000_000, 0.95)
    assert 1 < few < many and nn_descent.tables_for(20_000, 0.99) < few


def test_vectors_of_odd_kinds(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [1.0, 0.02]), (8, [1e200, 1e200]), (9, [1e-200, 1.1e-200]), (10, [3.0, 3.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.001, 0.0]), (13, [5e-324, 0.0]), (14, [])]
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    want = {(5, 3, 5), (5, 0, 5), (6, 3, 5), (7, 3, 5), (8, 2, 8), (9, 2, 8), (10, 2, 8), (11, 1, 11), (12, 1, 11), (13, 3, 5), (14, 0, 14)}
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)


def test_vector_table(spark, data):
    rows = op5_nn_descent(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/embeddings.parquet").count() and all(r.audit_recall >= 0.9 for r in rows)


def test_no_vectors_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert nn_descent.near_duplicates(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    got = nn_descent.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (9, None)], schema), "vec_id", "embedding").collect()
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in got) == [("5", 1, "5"), ("5", 1, "5"), ("9", 0, "9"), ("None", 0, "None")]
