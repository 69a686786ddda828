import pytest

from scriptorium.llm import common


def test_only_what_is_small_in_rows_and_bytes_is_broadcast(spark):
    rows = spark.createDataFrame([("a" * 40, 1), (None, 2)], "`a.b` string, n int")
    assert common.small(rows, 2) is not rows
    assert common.small(rows, 1) is rows and common.small(rows, 2, 39) is rows


def test_ranks_go_on_from_part_to_part(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 as x").repartition(7)
    found = {r["x"]: r["rank"] for r in common.ranked(rows, rows["x"]).collect()}
    assert found == {x: x for x in range(1000)}
    assert common.ranked(rows.limit(0), rows["x"]).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default=None: default)

    class Frame:
        sparkSession = Session

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.cut(Frame)
