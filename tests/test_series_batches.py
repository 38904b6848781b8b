"""Series functions on Arrow batches, against the same rules as expressions over each list."""

import math

from pyspark.sql import functions as F

from fleetpulse.functions import series as S
from fleetpulse.functions.scalars import let
from fleetpulse.functions.text import whole_numbers

LISTS = [[1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 0.1], [3.0] * 7, [0.1, 0.2, 0.3], [-1.0, 1.0], [5.0], [], None, [1.0, None, 2.0], [None, 1.0], [1.0, float("nan"), 3.0],
         [float("inf"), 1.0], [1e-9, -1e-9, 1e-9], [1e6 + k / 7 for k in range(30)], [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 0.1]]


def plain_features(xs):
    def moments(x, m):
        return F.struct(m.alias("m"), S.mean(F.transform(x, lambda v: (v - m) * (v - m))).alias("m2"), S.mean(F.transform(x, lambda v: (v - m) * (v - m) * (v - m) * (v - m))).alias("m4"),
                        ((S.last(x) - S.first(x)) / F.greatest(F.size(x) - 1, F.lit(1))).alias("slope"))

    def build(t):
        return F.struct(F.when(F.abs(t["m"]) > 1e-8, F.sqrt(t["m2"]) / t["m"]).otherwise(F.lit(0.0)).alias("cv"),
                        F.when(t["m2"] > 1e-8, t["m4"] / (t["m2"] * t["m2"]) - 3.0).otherwise(F.lit(0.0)).alias("kurtosis"), t["slope"].alias("slope"))

    return let(xs, lambda x: let(S.mean(x), lambda m: let(moments(x, m), build)))


def test_segment_features_are_those_of_the_expression(spark):
    df = spark.createDataFrame(list(enumerate(LISTS)), "id int, x array<double>").repartition(3)
    rows = df.select("id", S.segment_features(F.col("x")).alias("got"), plain_features(F.col("x")).alias("want")).collect()
    assert len(rows) == len(LISTS)
    for r in rows:
        for c in ("cv", "kurtosis", "slope"):
            got, want = r["got"][c], r["want"][c]
            assert (got is None) == (want is None), (LISTS[r["id"]], c)
            assert got is None or got == want or math.isclose(got, want, rel_tol=1e-12) or math.isnan(got) and math.isnan(want), (LISTS[r["id"]], c)


def test_parts_of_a_window_as_text_are_written(spark, tmp_path):
    rows = [(k, [float((k * 7 + i * i) % 11) for i in range(30)], [float(k)] * 30) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>").repartition(4)

    def text(c):
        made = [S.segment_features(S.segment(F.col(c), g, 4)) for g in range(4)]
        return whole_numbers(F.array(*[f[n] for f in made for n in ("cv", "kurtosis", "slope")]), 1000)

    plan = df.select("id", text("a").alias("a"), text("b").alias("b"))
    assert "transform(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    plan.write.parquet(str(tmp_path / "parts"))
    found = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "parts")).collect()}
    assert len(found) == 40 and found[3]["b"] == ",".join(["0"] * 12)
    part = [float((i * i) % 11) for i in range(7)]
    m = sum(part) / 7
    m2, m4 = (sum((v - m) ** p for v in part) / 7 for p in (2, 4))
    want = [math.sqrt(m2) / m, m4 / m2 ** 2 - 3, (part[-1] - part[0]) / 6]
    assert found[0]["a"].split(",")[:3] == [str(round(w * 1000)) for w in want]
