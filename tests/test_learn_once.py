"""Tables that are learned once for the same files and parameters."""

import threading

from fleetpulse import scratch_dir
from fleetpulse.sources.model_store import fingerprint, learn_once


def test_the_second_read_builds_nothing_and_a_changed_file_or_parameter_builds_anew(spark):
    source, root, built = scratch_dir(spark, "source"), scratch_dir(spark, "learned"), []
    spark.range(10).write.parquet(source)

    def total(parameters):
        def build():
            built.append(parameters)
            return spark.read.parquet(source).selectExpr(f"sum(id) * {parameters['by']} as total")

        return learn_once(spark, root, "total", fingerprint(spark, [source], parameters), build).first().total

    assert [total({"by": 1, "x": 0}), total({"x": 0, "by": 1}), len(built)] == [45, 45, 1]
    assert total({"by": 2, "x": 0}) == 90 and len(built) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert total({"by": 1, "x": 0}) == 66 and len(built) == 3
    assert total({"by": 1, "x": 0}) == 66 and len(built) == 3


def test_a_build_that_fails_leaves_no_table_and_two_at_once_leave_one(spark):
    root, start, got = scratch_dir(spark, "learned"), threading.Barrier(2), []
    bad = spark.range(5).selectExpr("case when id = 4 then raise_error('lost') else id end as id")
    try:
        learn_once(spark, root, "t", "k", lambda: bad)
        raise AssertionError("the build failed")
    except Exception as e:
        assert "lost" in str(e)

    def run():
        def build():
            start.wait(60)  # both have found no table
            return spark.range(5)

        got.append(sorted(r.id for r in learn_once(spark, root, "t", "k", build).collect()))

    both = [threading.Thread(target=run) for _ in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert got == [[0, 1, 2, 3, 4]] * 2

    def never():
        raise AssertionError("built again")

    files = {learn_once(spark, root, "t", "k", never).inputFiles()[0].rsplit("/", 2)[1] for _ in range(2)}
    assert len(files) == 1
