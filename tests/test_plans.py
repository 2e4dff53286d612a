"""Plans that must hold at any size."""

from logprism.operators import listing
from logprism.operators.fields import field_schema
from logprism.operators.stats import level_distribution
from logprism.plans.profile import profile
from logprism.testbed import tables


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def sample_table(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [("h", "t", "a\nb", "extra")]
    spark.createDataFrame(rows, "sample_hash string, target_id string, sample_content string, host string").write.parquet(path)
    return spark.read.parquet(path)


def test_profile_shuffles_nothing(spark, tmp_path):
    samples = sample_table(spark, tmp_path)
    for frame in (profile(samples), field_schema(samples), level_distribution(samples)):
        plan = plan_of(frame)
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
        assert "host" not in plan  # columns that are not needed are not read


def test_each_text_is_scanned_once(spark, tmp_path):
    plan = plan_of(profile(sample_table(spark, tmp_path)).where("stats.total_lines > 3"))
    assert plan.count("chatgpt") == 1 and plan.count("from_json(") == 1 and plan.count("split(") == 2


def test_filters_on_samples_reach_the_scan(spark, tmp_path):
    plan = plan_of(profile(sample_table(spark, tmp_path).where("target_id = 't'")))
    assert "EqualTo(target_id,t)" in plan


def test_pages_are_top_k(spark, sf_dir):
    plan = plan_of(listing.samples_page(tables.document_samples(spark, sf_dir)))
    assert "TakeOrderedAndProject" in plan


def test_pages_are_found_without_texts(spark, tmp_path):
    path = str(tmp_path / "paged")
    spark.range(1000).selectExpr("cast(id as string) AS sample_hash", "'t' AS target_id", "timestamp_seconds(id div 3) AS timestamp", "repeat('x', 100) AS sample_content").write.parquet(path)
    rows = spark.read.parquet(path)
    found = listing.samples_page(rows, limit=10, page=4)
    # the top-k over all rows reads times and keys only
    first = plan_of(found).split("FileScan")[-1].split("ReadSchema")[1].splitlines()[0]
    assert "sample_content" not in first or plan_of(found).count("FileScan") == 2
    pages, after = [], None
    for n in range(1, 4):
        want = [r.sample_hash for r in listing.samples_page(rows, limit=10, page=n).collect()]
        got = listing.samples_page(rows, limit=10, after=after).collect()
        assert [r.sample_hash for r in got] == want
        after = (got[-1].timestamp, got[-1].sample_hash)
        pages += want
    assert len(set(pages)) == 30
