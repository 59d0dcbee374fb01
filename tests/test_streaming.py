"""The stream's result equals the batch's."""

from quarry.operators import context
from quarry.plans.fixtures import view
from quarry.streaming.jobs import job_events, latest_jobs
from tests.conftest import SF


def test_latest_jobs(spark, tmp_path):
    jobs = view(spark, SF, "v_jobs").selectExpr("repo_key", "cast(created_at as timestamp) as created_at", "status", "raw_progress")
    jobs.repartition(4).write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{c} {t}" for c, t in jobs.dtypes)
    run = latest_jobs(job_events(spark, f"{tmp_path}/in", schema)).writeStream.outputMode("complete").format("memory").queryName("latest_jobs").start()
    run.processAllAvailable()
    run.stop()
    got = sorted((r.repo_key, r.status) for r in spark.table("latest_jobs").collect())
    assert got == sorted((r.repo_key, r.status) for r in context.latest(jobs, "repo_key", "created_at").collect())
