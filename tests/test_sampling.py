"""Allocation and draws."""

import random

from pyspark.sql import functions as F

from registrum.operators import lines, sampling
from registrum.plans import standins as S


def test_allocate_properties():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [(f"s{i}", rng.choice([1, 2, 5, 40, 3000])) for i in range(rng.randint(1, 12))]
        n, floor = rng.randint(1, 400), rng.randint(0, 8)
        order = [k for k, _ in sizes]
        share = sampling.allocate(sizes, n, floor, order)
        total = sum(m for _, m in sizes)
        floors = sum(min(floor, m) for _, m in sizes)
        assert all(0 <= share[k] for k, _ in sizes)
        if floors <= n:
            assert all(min(floor, m) <= share[k] <= m for k, m in sizes)
            assert sum(share.values()) <= n
            if n >= total:
                assert sum(share.values()) == total
        else:
            assert all(share[k] >= 1 for k, _ in sizes)


def test_allocate_example():
    assert sampling.allocate([("a", 1000), ("b", 100), ("c", 2)], 100, 5, ["a", "b", "c"]) == {"a": 86, "b": 12, "c": 2}


def test_draws_are_stable(spark, small):
    docs = S.annotated(spark, small)
    keys = lines.candidate_keys(docs, ["doc_id"])
    for draw in (sampling.simple_sample, sampling.stratified_sample):
        pick = lambda k: {(r["task_id"], r["doc_id"], r["section"], r["line_idx"]) for r in draw(k, n=120).collect()}  # noqa: B023, E731
        first, second = pick(keys.coalesce(1)), pick(keys.repartition(9))
        assert first == second and len(first) == 120
    assert sampling.simple_sample(keys, n=10**6).count() == keys.count()


def test_tasks_carry_context(spark, small):
    docs = S.annotated(spark, small)
    tasks = sampling.sample_documents(docs, n=130, stratified=True).collect()
    assert sorted(t["task_id"] for t in tasks) == list(range(130))
    for t in tasks:
        before = [x["num"] for x in t["context_before"]]
        assert before == list(range(max(1, t["line_num"] - 5), t["line_num"]))
        assert t["llm"]["mode_medium"]


def test_hot_stratum_is_cut_before_the_shuffle(spark, small):
    keys = lines.candidate_keys(S.annotated(spark, small), ["doc_id"])
    plan = sampling.stratified_sample(keys, n=50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_large_draws_take_the_same_lines(spark, small, monkeypatch):
    keys = lines.candidate_keys(S.annotated(spark, small), ["doc_id"])
    pick = lambda: {(r["task_id"], r["doc_id"], r["section"], r["line_idx"]) for r in sampling.stratified_sample(keys, n=200).collect()}
    plain = pick()
    monkeypatch.setattr(sampling, "DIGITS", 1)
    assert pick() == plain and len(plain) == 200
