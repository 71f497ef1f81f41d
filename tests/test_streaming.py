"""The streamed author weeks equal the batch ones, once the watermark has passed them."""

from pyspark.sql import functions as F

from deliverix.operators.metrics import with_week
from deliverix.streaming import counts

DATA = "/root/testdata/sf0.001"


def test_author_weeks(spark, top):
    from deliverix.plans.views import commits_events

    c = commits_events(spark, DATA).select(*counts.COMMITS.fieldNames()).withColumn("subject_has_keywords", F.col("subject_has_keywords").cast("int"))
    c.repartition(3).write.parquet(f"{top}/in")
    c.limit(50).write.mode("append").parquet(f"{top}/in")  # sent again
    last = c.limit(1).withColumn("committed_at", F.lit(4_000_000_000)).withColumn("sha", F.lit("end"))
    stream = lambda: counts.write_author_weeks(counts.author_weeks(counts.read_commits(spark, f"{top}/in")), f"{top}/out", f"{top}/cp").awaitTermination()
    stream()
    last.write.mode("append").parquet(f"{top}/in")  # moves the watermark past all weeks
    stream()
    got = {(r.repo_slug, r.period_week, r.author_ref): (r.commits, r.fix_like_commits) for r in spark.read.parquet(f"{top}/out").collect()}
    want = with_week(c).groupBy("repo_slug", "period_week", "author_ref").agg(F.count("*").alias("n"), F.sum("subject_has_keywords").alias("k")).collect()
    assert got == {(r.repo_slug, r.period_week, r.author_ref): (r.n, r.k) for r in want}
