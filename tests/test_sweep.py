"""Patches of all settings cut from daily rows in batches, against each row by itself."""

import math

from fleetpulse.operators import patterns as PT
from fleetpulse.plans import sensitivity as PS

SETTINGS = [PS.Setting(10, 5), PS.Setting(12, 3)]
FEATURES = ["a", "b"]
FACTS = "model string, disk_id long, day int, row int, split string, y int, raw_a array<double>, raw_b array<double>, h_0 int, f_0 int, h_1 int, f_1 int"


def daily():
    rows, series = [], {}
    for disk, model in enumerate(["m", "m", "n", "o", None]):
        for day in range(1, 15):
            xs = [[float((disk * 13 + k * 7 + d * d) % 9) for d in range(1, day + 1)] for k in range(2)]
            series[disk, day] = model, xs
            rows.append((model, disk, day, day, "train", disk % 2, xs[0][-5:], xs[1][-5:], day % 3, (disk + day) % 2, day % 2, disk % 3))
    return rows, series


def learned(spark):
    rows, series = daily()
    table = spark.createDataFrame(rows, FACTS).repartition(3)
    scaler = [(i, m, 1.0 + i, 2.0, 0.5, 1.5 + i) for i in range(2) for m in ("m", "n")]
    return rows, series, table, spark.createDataFrame(scaler, "setting int, model string, mean_a double, std_a double, mean_b double, std_b double")


def cut(xs, i):
    n = SETTINGS[i].patch_len
    return [[(v - (1.0 + i)) / 2.0 for v in xs[0][-n:]], [(v - 0.5) / (1.5 + i) for v in xs[1][-n:]]]


def test_patches_centers_and_distances(spark):
    rows, series, table, scaler = learned(spark)
    patches = PS.settings_patches(table, scaler, FEATURES, SETTINGS)
    want = {(i, r[1], r[2]): cut(series[r[1], r[2]][1], i) for r in rows for i in range(2) if r[0] in ("m", "n") and r[3] >= SETTINGS[i].patch_len}
    found = patches.table().collect()
    assert len(found) == len(want) and all([r["zp_a"], r["zp_b"]] == want[r["setting"], r["disk_id"], r["day"]] for r in found)

    table_centers = PS.mean_centers(patches)
    centers = {(r["setting"], r["model"], r["kind"], r["k"]): r["center"] for r in table_centers.collect()}
    sums = {}
    for r in rows:
        for i in range(2):
            z = want.get((i, r[1], r[2]))
            if z:
                h, f = r[8 + 2 * i], r[9 + 2 * i]
                for key, xs, w in (("attr", 0, ), z[0], h + f), (("attr", 1), z[1], h + f), (("cross", 0), z[0] + z[1], h), (("cross", 1), z[0] + z[1], f):
                    total, n = sums.setdefault((i, r[0], *key), ([0.0] * len(xs), [0]))
                    n[0] += w
                    total[:] = [t + w * v for t, v in zip(total, xs)]
    means = {k: [t / n[0] for t in total] for k, (total, n) in sums.items() if n[0]}
    assert set(centers) == set(means)
    assert all(math.isclose(a, b, abs_tol=1e-6) for k in means for a, b in zip(centers[k], means[k], strict=True))

    near = PS.distances(patches, table_centers)
    assert "lambda" not in near._jdf.queryExecution().optimizedPlan().toString()
    for r in near.collect():
        for i in range(2):
            z, d = want.get((i, r["disk_id"], r["day"])), r[f"d_{i}"]
            assert (d is None) == (z is None)
            if z:
                for kind, parts in (("attr", z), ("cross", [z[0] + z[1]])):
                    held = [c for k, c in sorted(centers.items()) if k[:3] == (i, r["model"], kind)]
                    own = d[:2] if kind == "attr" else d[2:]
                    assert all(math.isclose(x, min(math.dist(p, c) for c in held), rel_tol=1e-12) for x, p in zip(own, parts, strict=True))


def test_threshold_scores_count_distances_above_each_quantile(spark):
    rows = [("m", float(k % 50), k % 3, k % 2) for k in range(400)] + [("n", 7.0, 1, 0)] * 30 + [("m", None, 1, 1), ("o", None, 1, 1), (None, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "model string, dist double, n_healthy int, n_failed int").repartition(3)
    made = PT.threshold_scores(df, ["model"], [0.5, 0.9])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    found = {(r["model"], r["q"]): r for r in made.collect()}
    assert {m for m, _ in found} == {"m", "n"}
    for (m, q), r in found.items():
        own = [x for x in rows if x[0] == m]
        assert r["tp"] == sum(x[3] for x in own if x[1] is not None and x[1] > r["tau"]) and r["fp"] == sum(x[2] for x in own if x[1] is not None and x[1] > r["tau"])
        assert r["n_failed"] == sum(x[3] for x in own) and r["n_healthy"] == sum(x[2] for x in own)


def test_batches_without_patches_or_train_patches(spark):
    rows, _, table, scaler = learned(spark)
    whole = PS.settings_patches(table, scaler, FEATURES, SETTINGS)
    key = lambda df: sorted(map(repr, df.collect()))
    centers = PS.mean_centers(whole)
    # some tasks get rows that no train window holds, others rows at the head of a device, where no patch ends
    idle = [(m, 90 + k, d, d, None, 0, [1.0] * min(d, 5), [2.0] * min(d, 5), 0, 0, 0, 0) for k, m in enumerate("mn") for d in (1, 2, 9, 10)]
    odd = table
    for some in ([r for r in idle if r[3] < 3], [r for r in idle if r[3] > 3]):
        odd = odd.unionByName(spark.createDataFrame(some, FACTS).coalesce(1))
    patches = PS.settings_patches(odd, scaler, FEATURES, SETTINGS)
    assert key(PS.mean_centers(patches)) == key(centers)
    near = PS.distances(patches, centers)
    assert near.count() == len(rows) + len(idle)
    assert key(near.filter("disk_id < 90")) == key(PS.distances(whole, centers))
    for r in near.filter("disk_id >= 90").collect():
        assert (r["d_0"] is None, r["d_1"] is None) == (r["row"] < 5, r["row"] < 3)
