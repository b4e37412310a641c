import random

from waraq.llm.mixing import Mixture, running_sum
from pyspark.sql import functions as F

DOCS = "doc_id bigint, source string, text string, n_tokens string, copy int, weight int, target_share int"
TARGETS = "source string, target_share double, max_repeats int, tokens int"


def mixture(spark, rows, targets, **more):
    docs = spark.createDataFrame([(*r, "clash", 1, 1, 1) for r in rows], DOCS)
    return Mixture(docs, spark.createDataFrame([(*t, 7) for t in targets], TARGETS), **more)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in (("big", 900), ("mid", 200), ("small", 40), (None, 20), ("untargeted", 20)):
        rows += [(len(rows) + k, source, "coin " * rng.randrange(1, 12)) for k in range(n)]
    return rows


def test_shares_limits_and_budget(spark):
    m = mixture(spark, corpus(), [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.4, 3)])
    rows = m.documents().collect()
    used, longest = sum(r.n_tokens for r in rows), max(r.n_tokens for r in m.sized.collect())
    assert used <= m.budget and used > m.budget - longest * 4
    counts = {}
    for r in rows:
        counts.setdefault((r.source, r.doc_id), []).append(r.copy)
    limit = {"big": 1, "mid": 2, "small": 4}
    assert all(sorted(c) == list(range(len(c))) and len(c) <= limit[s] for (s, _), c in counts.items())
    shares = {r.source: r for r in m.shares().collect()}
    for source, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[source].actual_share - want) <= 2 * longest / used
    assert shares["small"].copies > 1 and shares[None].used_tokens == 0 and shares["absent"].available_tokens == 0 and shares["untargeted"].target_share == 0
    ordered = sorted(rows, key=lambda r: r.tokens_through)
    assert [r.virtual_finish for r in ordered] == sorted(r.virtual_finish for r in ordered)
    total = 0
    for r in ordered:
        total += r.n_tokens
        assert r.tokens_through == total


def test_every_prefix_keeps_the_shares(spark):
    m = mixture(spark, corpus(2), [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)])
    rows = sorted(m.documents().collect(), key=lambda r: r.tokens_through)
    longest, by = max(r.n_tokens for r in rows), {"big": 0, "mid": 0, "small": 0}
    for r in rows:
        by[r.source] += r.n_tokens
        for source, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
            assert abs(by[source] - w * r.tokens_through) <= 2 * longest


def test_budget_beyond_what_a_source_has(spark):
    m = mixture(spark, corpus(), [("big", 0.1, 1), ("small", 0.9, 2)], budget=10**9)
    used = {r.source: r.used_tokens for r in m.shares().collect()}
    have = {r.source: r.tokens for r in m.totals.collect()}
    assert used["small"] == 2 * have["small"] and used["big"] == have["big"]


def test_odd_inputs(spark):
    assert mixture(spark, [], [("a", 1.0, 1)]).documents().collect() == []
    assert mixture(spark, [(1, "a", "x")], []).documents().collect() == []
    assert mixture(spark, [(1, "a", "x")], [("a", None, 1), (None, 1.0, 1), ("a", -1.0, 1)]).documents().collect() == []
    assert mixture(spark, [(1, "a", None), (2, "a", "")], [("a", 1.0, 1)]).documents().collect() == []
    rows = [(1, "a", None), (2, "a", "coin"), (2, "a", "coin"), (None, "a", "coin"), (3, "a", "coin " * 40_000)]
    got = mixture(spark, rows, [("a", 0.7, None), ("a", 0.1, 2)]).documents().collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "None"]
    shares = mixture(spark, [], []).shares().collect()
    assert shares == []


def test_running_sum_equals_plain(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 as g", "id div 100 as b", "id % 17 as v")
    got = {r.id: r.s for r in running_sum(df, ["g"], "b", [F.col("id")], "v", "s").collect()}
    total = {}
    for k in range(3000):
        total[k % 3] = total.get(k % 3, 0) + k % 17
        assert got[k] == total[k % 3]


def test_same_seed_same_mix_other_seed_other_mix(spark):
    pick = lambda seed: {(r.doc_id, r.copy) for r in mixture(spark, corpus(), [("big", 0.5, 1), ("small", 0.5, 2)], seed=seed).documents().collect()}
    assert pick(1) == pick(1) != pick(2)
