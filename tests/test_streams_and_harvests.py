"""Live reports under repeats and failures; harvests held against earlier ones."""

import pytest

from gaugeworks.operators.reports import model_report
from gaugeworks.schemas import ROW
from gaugeworks.sources import versions
from gaugeworks.sources.accepted import Accepted
from gaugeworks.streaming import rowlog


def rows(spark, cells):
    """Rows of (model, item, sample, score, scorer, parsed, error)."""
    full = [("r", m, m, i, k, "x", parsed, score, scorer, None, 0.1, error) for m, i, k, score, scorer, parsed, error in cells]
    return spark.createDataFrame(full, ROW)


def cell(n):
    kinds = [(1.0, "verdict", "flag", None), (0.0, "verdict", "parse_fail", None), (0.0, "no_response", None, None), (None, None, None, "timeout")]
    return (f"m{n % 3}", f"i{n % 5}", n, *kinds[n % 4])


def told(df):
    return sorted(map(str, df.collect()))


def test_a_live_report_equals_the_batch_report(spark, tmp_path, monkeypatch):
    source, folder, checkpoint = (f"{tmp_path}/{x}" for x in ("rows", "report", "checkpoint"))
    add = lambda *n: rows(spark, [cell(x) for x in n]).coalesce(1).write.mode("append").parquet(source)
    whole = lambda *n: told(model_report(rows(spark, [cell(x) for x in n])))

    def run():
        stream = rowlog.row_stream(spark, source, maxFilesPerTrigger="1")
        query = rowlog.follow(stream, folder, checkpoint, fold=2, availableNow=True)
        assert query.awaitTermination(120)

    add(*range(8))
    add(*range(4, 12), 4)  # repeats within a file and of an earlier one
    run()
    assert told(rowlog.live_report(spark, folder)) == whole(*range(12))
    add(0, 30, 31)  # a late repeat, after a restart
    real, failed = rowlog._merge, []

    def breaks(*a):
        def merge(batch, number):
            real(*a)(batch, number)
            if not failed:  # written, but the stream does not know
                failed.append(1)
                raise RuntimeError("lost")

        return merge

    monkeypatch.setattr(rowlog, "_merge", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert told(rowlog.live_report(spark, folder)) == whole(*range(12), 30, 31)
    for n in range(40, 46):
        add(n, n - 1 if n > 40 else 0)
    run()
    assert told(rowlog.live_report(spark, folder)) == whole(*range(12), 30, 31, *range(40, 46))
    kept = [x for x in versions.names(spark, folder)]
    assert len(rowlog._whole(spark, folder)) <= 4 and len(kept) < 12


def test_no_rows_give_no_report(spark, tmp_path):
    assert rowlog.live_report(spark, f"{tmp_path}/none").collect() == []


def frame(spark, *cells):
    return spark.createDataFrame(cells, "id int, prompt string, expected string")


def test_a_second_harvest_drops_what_the_first_accepted(spark, tmp_path):
    key, order = ["prompt", "expected"], ["id"]
    index = Accepted(spark, f"{tmp_path}/it's here", 4)
    first = index.accept(frame(spark, (3, "a", "pass"), (1, "a", "pass"), (2, "a", "flag"), (4, None, "x"), (5, None, "x"), (6, "", "x")), key, order, "h1")
    assert sorted(r["id"] for r in first.collect()) == [1, 2, 4, 6] and first.columns == ["id", "prompt", "expected"]
    again = Accepted(spark, f"{tmp_path}/it's here", 4)
    second = again.accept(frame(spark, (1, "a", "pass"), (8, "b", "pass"), (7, "b", "pass"), (9, None, "x"), (10, "ax", None), (11, "a", "xnull")), key, order, "h2")
    assert sorted(r["id"] for r in second.collect()) == [7, 10, 11]
    assert again.accept(frame(spark, (1, "b", "pass")), key, order, "h3").count() == 0
    assert again.accept(frame(spark), key, order, "h4").count() == 0
    copies = spark.range(2000).selectExpr("cast(id as int) as id", "'hot' as prompt", "'x' as expected")
    assert again.accept(copies, key, order, "h5", ["expected", "id"]).collect() == [("x", 0)]
    assert {r[0]: r[1] for r in again.contents().groupBy("harvest").count().collect()} == {"h1": 4, "h2": 3, "h5": 1}
    again.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("accepted_")] and Accepted(spark, f"{tmp_path}/it's here", 4).contents().count() == 8


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = Accepted(spark, f"{tmp_path}/i", 4)
    index.accept(frame(spark, *((n, f"p{n}", "x") for n in range(50))), ["prompt", "expected"], ["id"], "h1")
    part = versions.current(spark, f"{tmp_path}/i").parts[0]
    hashed = frame(spark, (1, "p1", "x")).withColumnRenamed("prompt", "_content").repartition(4, "_content")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hashed.join(spark.table(index._bucketed(part)).withColumnRenamed("content", "_content"), "_content", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_of_two_harvests_at_once_each_content_has_one(spark, tmp_path, monkeypatch):
    index, real, rounds = Accepted(spark, f"{tmp_path}/i", 4), versions.commit, []

    def late(*a, **k):
        if not rounds:
            rounds.append(1)
            other = Accepted(spark, f"{tmp_path}/i", 4).accept(frame(spark, (5, "b", "x"), (6, "c", "x")), ["prompt"], ["id"], "other")
            assert other.count() == 2
        return real(*a, **k)

    monkeypatch.setattr(versions, "commit", late)
    mine = index.accept(frame(spark, (1, "a", "x"), (2, "b", "x")), ["prompt"], ["id"], "mine")
    assert [r["id"] for r in mine.collect()] == [1] and index.contents().count() == 3
