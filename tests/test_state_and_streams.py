import re

from tessera.operators import jobs, listing
from tessera.streaming import runs


def test_scores_wide_and_long(spark):
    s = spark.createDataFrame([("1", "a", 5.0), ("1", "b", 7.0), ("2", "a", None), ("3", "z", 1.0)], "job_id string, profile_id string, score double")
    wide = jobs.scores_wide(s, ["a", "b"])
    assert {r.job_id: (r.score_a, r.score_b) for r in wide.collect()} == {"1": (5.0, 7.0), "2": (None, None)}
    assert {tuple(r) for r in jobs.scores_long(wide).collect()} == {("1", "a", 5.0), ("1", "b", 7.0)}


def test_history(spark):
    h = spark.createDataFrame([("1", "running", None), ("2", "running", None), ("3", "done", "t0")], "id string, status string, ended_at string")
    assert {r.id: (r.status, r.ended_at) for r in jobs.finish_run(h, "1", "t1", "done").collect()} == {"1": ("done", "t1"), "2": ("running", None), "3": ("done", "t0")}
    assert {r.id: r.status for r in jobs.crash_orphans(h, ["2"], "t1").collect()} == {"1": "crashed", "2": "running", "3": "done"}


def test_health_stream_equals_batch(spark, tmp_path):
    rows = [(c, f"2026-01-{d:02d}", y, changed, c != "b") for c, ys in {"a": [10, 0, 0, 4], "b": [10, 2, 0, 8], "c": [0, 5, 1, 0]}.items() for d, (y, changed) in enumerate(zip(ys, [False, True, False, True]), 1)]
    schema = "company_id string, at string, yield int, changed boolean, labelled boolean"
    want, state = {}, {}
    for c, at, y, changed, labelled in sorted(rows, key=lambda r: r[1]):
        empty, base = state.get(c, (0, 0))
        r = jobs.plan_health(spark.createDataFrame([(c, "x", empty, y, base, changed, labelled)], "company_id string, status string, empty_runs int, yield int, baseline int, changed boolean, labelled boolean")).first()
        state[c] = (r.empty_runs, r.baseline)
        want[(c, at)] = (r.status, r.empty_runs, r.baseline)
    for i, half in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(half, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = runs.health(stream).writeStream.format("memory").queryName("plan_health").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.company_id, r["at"]): (r.status, r.empty_runs, r.baseline) for r in spark.sql("select * from plan_health").collect()}
    assert got == want
    assert {s for s, _, _ in want.values()} == {"stale", "stale_suspect", "verified", "unverified"}


def test_excludes(spark):
    rows = [(1, 0, "x.io|careers/eng|3", True), (1, 1, "x.io|blog/c++|3", False), (1, 2, "x.io||1", False), (1, 3, "x.io|careers/eng|3", False), (1, 4, "x.io|?id", False), (2, 0, "y.io|a|2", True)]
    got = {r.page_id: r.exclude_url for r in listing.excludes(spark.createDataFrame(rows, "page_id int, index int, href_shape string, is_job boolean")).collect()}
    assert list(got) == [1] and len(got[1]) == 2
    assert re.search(got[1][0], "https://www.x.io/blog/c++/post") and re.search(got[1][1], "http://x.io/about/") and not re.search(got[1][1], "https://x.io/careers/eng/1")
