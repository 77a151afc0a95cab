"""Clustering and search against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemap.operators import density, kmeans, packing, vectors, ward
from aislemap.session import materialise


def points(n=70, d=3, seed=3, groups=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 6, (groups, d))
    return centers[rng.integers(0, groups, n)] + rng.normal(0, 1, (n, d))


def frame(spark, x):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "listing_id bigint, vec array<double>").repartition(3)


def brute_knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[i, j], 12), j))
        out[i] = [(j, d[i, j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_knn_is_exact_with_copies(spark, block_rows):
    x = points(90)
    x[40:70] = x[0]  # a third of the rows are copies of one
    want = brute_knn(x, 4)
    got = {}
    for r in vectors.knn_graph(frame(spark, x), 4, block_rows=block_rows).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour_id"], r["distance"]))
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([d for _, d in got[i]], [d for _, d in want[i]])


def brute_ward(x):
    live = {i: (1, x[i], {i}) for i in range(len(x))}
    merges = []
    while len(live) > 1:
        best = min(
            ((live[a][0] * live[b][0] / (live[a][0] + live[b][0]) * ((live[a][1] - live[b][1]) ** 2).sum(), a, b) for a in live for b in live if a < b)
        )
        cost, a, b = best
        (na, ca, sa), (nb, cb, sb) = live.pop(a), live.pop(b)
        live[min(a, b)] = (na + nb, (na * ca + nb * cb) / (na + nb), sa | sb)
        merges.append((np.sqrt(2 * cost), na + nb, frozenset(sa | sb)))
    return merges


def brute_cut(x, k):
    merges = brute_ward(x)[: len(x) - k]
    label = {i: frozenset([i]) for i in range(len(x))}
    for _, _, s in merges:
        for i in s:
            label[i] = s
    return set(label.values())


@pytest.mark.parametrize("block_rows", [1024, 6])
def test_ward_tree(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    x = points(24)
    tree = ward.ward_tree(frame(spark, x))
    # kept partners: after the first round only some clusters search
    assert tree.searched[0] == (24, 24) and sum(a for _, a in tree.searched[1:]) < sum(n for n, _ in tree.searched[1:])
    got = [(r["height"], r["size"]) for r in tree.merges.orderBy("step").collect()]
    want = brute_ward(x)
    assert [s for _, s in got] == [s for _, s, _ in want]
    assert np.allclose([h for h, _ in got], [h for h, _, _ in want])
    parts = {}
    for r in ward.cut_tree(tree, 4).collect():
        parts.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(s) for s in parts.values()} == brute_cut(x, 4)
    rows = ward.merge_tree(tree).orderBy("step").collect()
    assert rows[-1]["size"] == len(x)
    used = [r["left_id"] for r in rows] + [r["right_id"] for r in rows]
    # every leaf and every inner node but the last is merged exactly once
    assert sorted(used) == sorted(list(range(len(x))) + [len(x) - 1 + s for s in range(1, len(x) - 1)])


def test_ward_ends_in_one_task(spark, monkeypatch):
    x = points(30, seed=4)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 6)
    calls, search = [], ward.block_search
    monkeypatch.setattr(ward, "block_search", lambda blocks, *a, **k: calls.append(blocks) or search(blocks, *a, **k))
    apart = ward.ward_tree(frame(spark, x))
    # rounds of jobs only while there are four blocks of clusters or more
    assert 0 < len(calls) == sum(rows >= 24 for rows, _ in apart.searched) < len(apart.searched)
    monkeypatch.setattr(ward, "LAST_BLOCKS", 0.2)
    jobs = ward.ward_tree(frame(spark, x))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 1024)
    monkeypatch.setattr(ward, "LAST_BLOCKS", 4)
    whole = ward.ward_tree(frame(spark, x))
    rows = [[tuple(r) for r in t.merges.orderBy("step").collect()] for t in (whole, apart, jobs)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 29
    assert whole.searched == apart.searched == jobs.searched
    with pytest.raises(ValueError):
        ward.ward_tree(frame(spark, np.full((5, 3), np.nan)))


def test_ward_with_ties_and_copies(spark):
    # a grid, where most costs are equal, and copies of one point; any order of ties gives a tree of all rows
    x = np.array([[i, j] for i in range(5) for j in range(4)] + [[2, 2]] * 8, dtype=float)
    rows = ward.ward_tree(frame(spark, x)).merges.orderBy("step").collect()
    assert len(rows) == len(x) - 1 and rows[-1]["size"] == len(x)
    assert [r["height"] for r in rows[:8]] == [0.0] * 8
    assert sum(r["height"] ** 2 for r in rows) / 2 == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_ward_groups_when_large(spark):
    x = points(60)
    out = ward.ward_cluster(frame(spark, x), 3, max_nodes=12)
    assert out.count() == 60 and out.select("cluster").distinct().count() == 3


def brute_hdbscan(x, size, samples, selection):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.array([np.sort(np.delete(d[i], i))[samples - 1] for i in range(n)])
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, edges, best = {0}, [], {j: (reach[0, j], 0) for j in range(1, n)}
    while best:
        j = min(best, key=lambda t: best[t])
        w, i = best.pop(j)
        edges.append((w, i, j))
        inside.add(j)
        for t in best:
            best[t] = min(best[t], (reach[j, t], j))
    edges.sort()

    # take edges away from the heaviest down
    clusters = []  # dict(members at birth, birth, exits, children)

    def split(members, birth):
        me = {"birth": birth, "exit": {}, "children": [], "split": None}
        clusters.append(me)
        current = set(members)
        while True:
            inner = [e for e in edges if e[1] in current and e[2] in current]
            if not inner:
                for p in current:
                    me["exit"][p] = np.inf
                return me
            w, a, b = max(inner)
            rest = [e for e in inner if e != (w, a, b)]
            left, grown = {a}, True
            while grown:
                grown = False
                for _, p, q in rest:
                    if (p in left) != (q in left):
                        left |= {p, q}
                        grown = True
            right = current - left
            lam = 1 / w
            if len(left) >= size and len(right) >= size:
                me["split"] = lam
                me["children"] = [split(left, lam), split(right, lam)]
                return me
            if len(left) < size and len(right) < size:
                for p in current:
                    me["exit"][p] = lam
                return me
            small, current = (left, right) if len(left) < size else (right, left)
            for p in small:
                me["exit"][p] = lam

    root = split(set(range(n)), 0.0)

    def rows(c):
        return len(c["exit"]) + sum(rows(k) for k in c["children"])

    def stability(c):
        return sum(l - c["birth"] for l in c["exit"].values()) + sum(rows(k) * (c["split"] - c["birth"]) for k in c["children"])

    def pick(c):
        if not c["children"]:
            return stability(c), [c]
        found = [pick(k) for k in c["children"]]
        inner = sum(s for s, _ in found)
        chosen = [c2 for _, cs in found for c2 in cs]
        if c is root or selection == "leaf" or inner > stability(c):
            return inner, chosen
        return stability(c), [c]

    if not root["children"]:
        return {}, {}
    member, strength = {}, {}

    def collect(c):
        out = dict(c["exit"])
        for k in c["children"]:
            out.update(collect(k))
        return out

    for c in pick(root)[1]:
        death = max(list(c["exit"].values()) + ([c["split"]] if c["children"] else []))
        all_points = collect(c)
        for p, lam in all_points.items():
            member[p] = frozenset(all_points)
            strength[p] = min(lam, death) / death
    return member, strength


@pytest.mark.parametrize("selection,size,block_rows", [("eom", 5, 1024), ("leaf", 4, 1024), ("eom", 6, 12)])
def test_density_matches_brute_force(spark, monkeypatch, selection, size, block_rows):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    x = points(60, 2, seed=11)
    member, strength = brute_hdbscan(x, size, 3, selection)
    assert len(set(member.values())) >= 2
    rows = density.density_cluster(frame(spark, x), size, 3, selection).collect()
    parts = {}
    for r in rows:
        if r["cluster"] >= 0:
            parts.setdefault(r["cluster"], set()).add(r["listing_id"])
    assert {frozenset(s) for s in parts.values()} == set(member.values())
    for r in rows:
        assert r["probability"] == pytest.approx(strength.get(r["listing_id"], 0.0), abs=1e-9)


def test_density_with_copies(spark):
    x = np.concatenate([points(30, 2), np.repeat([[50.0, 50.0]], 20, axis=0)])
    rows = density.density_cluster(frame(spark, x), 8, 3).collect()
    assert len({r["cluster"] for r in rows if r["listing_id"] >= 30}) == 1
    assert all(r["cluster"] >= 0 for r in rows if r["listing_id"] >= 30)


def test_noise_and_too_small(spark):
    x = points(12, 2)
    assert {r["cluster"] for r in density.density_cluster(frame(spark, x), 20, 3).collect()} == {-1}
    df = spark.createDataFrame([(1, -1), (2, 0), (3, 4)], "listing_id bigint, cluster int")
    got = {r["listing_id"]: (r["cluster"], r["is_noise"]) for r in density.relabel_noise(df).collect()}
    assert got == {1: (5, True), 2: (0, False), 3: (4, False)}


def test_svd_matches_numpy(spark):
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(5).normal(size=(30, 8))
    df = frame(spark, x).withColumn("features", array_to_vector("vec"))
    out = vectors.truncated_svd(df, 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(out.singular_values, s[:3])
    got = np.array([r["vec"] for r in out.vectors.orderBy("listing_id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    strongest = np.abs(out.components).argmax(axis=0)
    assert (out.components[strongest, np.arange(3)] > 0).all()


def test_kmeans_invariants(spark):
    df = frame(spark, points(80))
    a = kmeans.kmeans(df, 4, restarts=2).select("listing_id", "cluster")
    assert a.count() == 80 and a.select("cluster").distinct().count() == 4
    sweep = kmeans.sweep_k(df, [2, 4])
    assert [r["k"] for r in sweep.orderBy("k").collect()] == [2, 4]
    best = kmeans.select_best_k(spark.createDataFrame([(5, 0.3, 1.0), (6, None, 1.0), (4, 0.3, 1.0)], "k int, silhouette double, inertia double")).first()
    assert best["k"] == 4


def test_many_fits_are_plain_lloyd(spark, monkeypatch):
    x = points(300, 4, seed=8, groups=6)
    df = frame(spark, x)
    first, variance = kmeans.first_centres(df, [3, 6], 2, 1, "vec", "listing_id")
    assert set(first) == {(3, 0), (3, 1), (6, 0), (6, 1)} and (first[3, 1] == first[6, 1][:3]).all()
    assert variance == pytest.approx(x.var(axis=0).mean())
    got, costs = kmeans.fit_many(df, first, 50, 1e-4 * variance)
    monkeypatch.setattr(kmeans, "DRIVER_BYTES", 0)
    monkeypatch.setattr(kmeans, "FAN_IN", 2)
    again, _ = kmeans.fit_many(df, first, 50, 1e-4 * variance)
    for n, c in first.items():
        for _ in range(50):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            moved = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
            done, c = ((moved - c) ** 2).sum() <= 1e-4 * variance, moved
            if done:
                break
        assert np.allclose(got[n], c) and np.allclose(again[n], c)
        assert costs[n] == pytest.approx(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())


def test_batches_are_a_plain_loop(spark):
    x = points(400, 3, seed=9, groups=5)
    df = frame(spark, x)
    first, _ = kmeans.first_centres(df, [5], 1, 1, "vec", "listing_id")
    got, costs = kmeans.fit_batches(df, first, 100)
    order = [r["listing_id"] for r in df.orderBy(F.xxhash64(F.lit(42), "listing_id"), "listing_id").collect()]
    c, held = first[5, 0], np.zeros(5)
    for step in range(20):
        batch = x[[i for place, i in enumerate(order) if place * 4 // 400 == step % 4]]
        near = ((batch[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = c.copy()
        for i in range(5):
            rows = batch[near == i]
            held[i] += len(rows)
            c[i] += (rows - c[i]).sum(0) / max(held[i], 1)
    assert np.allclose(got[5, 0], c)
    _, full = kmeans.fit_many(df, first, 100, 0.0)
    assert costs[5, 0] <= 1.05 * full[5, 0]
    labelled = kmeans.kmeans_fast(df, 5, restarts=1)
    assert labelled.count() == 400 and labelled.select("cluster").distinct().count() == 5
    assert kmeans.kmeans(df.limit(0), 3).count() == 0


def test_sweeps(spark):
    from aislemap.operators import quality

    x = points(30, 2, seed=2, groups=3)
    df = frame(spark, x).cache()
    cuts = {r["k"]: r["silhouette"] for r in ward.sweep_ward(df, [2, 3, 6]).collect()}
    assert set(cuts) == {2, 3, 6} and all(-1 <= s <= 1 for s in cuts.values())
    run = density.sweep_density(df, [(5, 3)]).first()
    assert run["n_clusters"] >= 0 and 0 <= run["noise_percent"] <= 100
    labelled = kmeans.kmeans(df, 3, restarts=1)
    assert -1 <= quality.silhouette_fast(labelled) <= 1
    assert quality.basic_cluster_metrics(labelled).first()["num_clusters"] == 3


def test_sweep_queries_cover_the_whole_range(monkeypatch):
    from catalog_queries import learning

    calls = []

    def sweep_k(df, ks, seed=42, vec="vec", id_col="listing_id", restarts=1, max_iter=20):
        calls.append((list(ks), restarts, max_iter))

    monkeypatch.setattr(kmeans, "sweep_k", sweep_k)
    monkeypatch.setattr(learning, "vectors", lambda spark, sf_dir: None)
    for name in ("c5_sweep_k", "c6_elbow"):
        learning.QUERIES[name][0](None, "")
    assert calls == [(list(range(50, 301, 5)), 3, 20), (list(range(2, 16)), 10, 300)]


def test_search_shuffles_each_block_once(spark, monkeypatch):
    """Blocks are read where they meet: no vector is in an exchange behind the packed blocks, and a looser bound changes nothing."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(150, 4)), 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    plans, write = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda table: plans.append(table._jdf.queryExecution().executedPlan().toString()) or write(table))
    found = vectors.block_search(vectors.make_blocks(df, block_rows=16), "knn", 3)
    met = [plan for plan in plans if "CartesianProduct" in plan]
    assert met and not any("Exchange" in plan for plan in met)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r["id"], r["rank"]): r["value"] for r in found.collect()}
    want = np.sort(d, axis=1)[:, :3]
    assert all(abs(got[i, r + 1] - want[i, r]) < 1e-9 for i in range(150) for r in range(3))
    asked = df.withColumn("ask", F.col("id") % 5 == 0).withColumn("most", F.lit(float("inf")))
    some = vectors.block_search(vectors.make_blocks(asked, block_rows=16), "knn", 3, bound="most", ask="ask").collect()
    assert {(r["id"], r["rank"]): r["value"] for r in some} == {key: v for key, v in got.items() if key[0] % 5 == 0}


def test_spanning_tree_points_keep_their_partner(spark, monkeypatch):
    """The tree of all pairs, with ties and copies, while only some points search after the first round."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(150, 3)), np.round(rng.normal(size=(90, 3)) * 2) / 2 + 4])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    graph = materialise(vectors.knn_graph(points, 4, id_col="id"))
    searched = []
    tree = density.spanning_tree(materialise(points.join(density.core_distances(graph), "id")), graph, searched).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d + np.diag(np.full(len(x), np.inf)), axis=1)[:, 3]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    # Prim over all pairs
    weights, best = [], reach[0].copy()
    inside = np.arange(len(x)) == 0
    for _ in range(len(x) - 1):
        nxt = int(np.where(inside, np.inf, best).argmin())
        weights.append(best[nxt])
        inside[nxt] = True
        best = np.minimum(best, reach[nxt])
    assert np.sort(tree["w"]) == pytest.approx(np.sort(weights), abs=1e-9)
    up = list(range(len(x)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b, w in tree.itertuples(index=False):
        assert w == pytest.approx(reach[a, b], abs=1e-9) and top(a) != top(b)
        up[top(a)] = top(b)
    first, later = searched[0][1], [asked for _, asked in searched[1:]]
    assert later and sum(later) < first


@pytest.mark.parametrize("many", [1, 100])
def test_centre_sums_add_each_row_once(spark, monkeypatch, many):
    """Sums, numbers and distances per centre, also of a centre that has no rows."""
    monkeypatch.setattr(kmeans, "MANY_CENTRES", many)
    x = points(200, 3, seed=4)
    centres = np.vstack([x[:6], [[1e6, 1e6, 1e6]]])
    got = kmeans.centre_sums(frame(spark, x), {(7, 0): centres})[7, 0]
    d2 = ((x[:, None] - centres[None]) ** 2).sum(2)
    near = d2.argmin(1)
    for c in range(7):
        want = [*x[near == c].sum(0), (near == c).sum(), d2[near == c, c].sum()]
        assert got[c] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("scale, shift, largest", [(1.0, 0.0, 1e24), (1.0, 1e6, 1e24), (1e-9, 0.0, 1e24), (1e14, 0.0, 1e24), (1.0, 0.0, 0.0)])
def test_search_in_single_precision_is_exact(spark, monkeypatch, scale, shift, largest):
    """Partners that single precision cannot tell apart, far from the origin, tiny and too large for it, and without it."""
    monkeypatch.setattr(vectors, "LARGEST_SINGLE", largest)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 6))
    x = np.vstack([x, x + 1e-5 * rng.normal(size=x.shape), x[:20] + 1e-7]) * scale + shift
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = vectors.block_search(vectors.make_blocks(df, block_rows=16), "knn", 3).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r["id"], r["rank"]): (r["other"], r["value"]) for r in found}
    want = np.sort(d, axis=1)[:, :3]
    assert all(got[i, r + 1][1] == pytest.approx(want[i, r], rel=1e-9, abs=1e-12) for i in range(len(x)) for r in range(3))
    assert all(got[i, r + 1][1] == d[i, got[i, r + 1][0]] for i in range(len(x)) for r in range(3))
