from pyspark.sql import functions as F

from harrow.checkpoints import cut_counted


def test_rows_are_counted_on_the_way(spark):
    """One job for both, whatever was shuffled before; each row counts once."""
    rows = spark.range(1000).repartition(7).groupBy(F.col("id") % 100).count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    kept, n = cut_counted(rows)
    jobs = len(tracker.getJobIdsForGroup("counted"))
    assert n == 100 == kept.count() and jobs <= 3
    assert cut_counted(spark.range(0).select("id"))[1] == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
