"""Masters are made by many tasks, however small the file of parts is."""

from sepet.plans import sample_views

SF_DIR = "/root/testdata/sf0.001"
MERGED = "spark.sql.adaptive.coalescePartitions.enabled"


def test_masters_are_made_by_many_tasks(spark):
    assert sample_views.table(spark, SF_DIR, "part").rdd.getNumPartitions() == 1
    before = spark.conf.get(MERGED)
    spark.conf.set(MERGED, "false")
    try:
        made = sample_views.masters(spark, SF_DIR)
        assert made.rdd.getNumPartitions() > 1
        held = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        # No task has most of them.
        assert sum(held) == sample_views.table(spark, SF_DIR, "part").count() and max(held) < 0.5 * sum(held)
    finally:
        spark.conf.set(MERGED, before)
