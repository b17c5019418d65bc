"""Connected components against a loop, by one task and by rounds."""

from __future__ import annotations

import random

import pytest

from wrackline.llm import components


def slow(links):
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up if root(x) != x}


def tangle(seed=1):
    """Chains, stars, pairs, links to itself and links that repeat, of nodes of either sign."""
    rng = random.Random(seed)
    name = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(700)]
    links = [(name[i], name[i + 1]) for i in range(120)] + [(name[200], name[i]) for i in range(201, 400)]
    links += [(rng.choice(name[400:]), rng.choice(name[400:])) for _ in range(120)] + [(name[5], name[5]), (name[150], name[150])]
    links += links[:40] + [(v, u) for u, v in links[40:80]]
    rng.shuffle(links)
    return links


def found(spark, links):
    rows = components.components(spark.createDataFrame(links, "u bigint, v bigint").repartition(7)).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


@pytest.mark.parametrize("alone", [0, 500_000])
def test_components_are_those_of_a_loop(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ALONE", alone)
    assert found(spark, tangle()) == slow(tangle())
    assert found(spark, [(3, 3)]) == found(spark, []) == {}


def test_few_links_take_few_tasks_where_there_are_many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    context, group = spark.sparkContext, "few links"
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        assert found(spark, tangle(2)) == slow(tangle(2))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))
    # One exchange to tell links apart, one scan to count them; a round alone takes six exchanges.
    assert 0 < tasks < 250
