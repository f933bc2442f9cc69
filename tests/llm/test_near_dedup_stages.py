"""What a near-dedup run costs where tables are small and partitions many: stages that are dealt by a key."""

import random

import pytest

from gaugeworks.llm import near_dedup
from gaugeworks.llm.spark_tools import components


def tasks_of(spark, group, work):
    """Tasks of each stage that ``work`` runs to its end."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return out, [i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)) and i.numCompletedTasks]


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield 13
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_run_with_branching_and_a_large_group_is_dealt_a_bounded_number_of_times(spark, monkeypatch, many_partitions):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(rng.choice((w, w, w, w, w, w, w, w, w, f"x{rng.randrange(10**6)}")) if rng.random() < 0.05 else w for w in base) for _ in range(90)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    for name, value in (("LEAF", 40), ("GROUP_SETS", 30), ("BLOCK", 20)):
        monkeypatch.setattr(near_dedup, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows, tasks = tasks_of(spark, "near", lambda: near_dedup.near_duplicates(docs).collect())
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found == {i: 0 if i < 90 else i for i in range(120)}
    dealt = sum(n % many_partitions == 0 for n in tasks)
    assert dealt <= 40, (dealt, len(tasks))


@pytest.mark.parametrize("hub", [1, 20, 200, 20_000])
def test_few_and_many_edges_have_the_same_components(spark, many_partitions, hub):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(70)] + [(5000, 5001 + i) for i in range(50)]
    edges += edges[:40]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    rows, tasks = tasks_of(spark, f"edges{hub}", lambda: components(spark.createDataFrame(edges, "u long, v long").repartition(7), hub=hub).collect())
    got = dict(map(tuple, rows))
    assert len(got) == len(rows) and all(got[x] == find(x) for x in got) and {x for a, b in edges if a != b for x in (a, b)} <= set(got)
    if hub == 20_000:
        assert many_partitions not in tasks
