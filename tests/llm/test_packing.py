import random

import pytest
from pyspark.sql import functions as F

from waraq.llm.packing import Packing, shortest_pack_first, summary
from waraq.llm.tokens import VOCABULARY, Counter, encoding, spread_rank

DOCS = "doc_id bigint, text string, rank int, piece string, capacity int, part int, pack_kind string"
SIZES = "pack_kind string, capacity_tokens int, doc_id int"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, 1, "clash", 1, 1, "clash") for k, t in rows], DOCS)


def sizes(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SIZES)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_never_overfills(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 512])
    histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))}
    plan = shortest_pack_first(histogram, capacity)
    used = [0] * plan.sequences
    for length, n in histogram.items():
        low, first = plan.low[length], plan.first[length]
        assert low[0] == 0 and low == sorted(low)
        for rank in range(n):
            k = max(i for i, x in enumerate(low) if x <= rank)
            used[first[k] + rank - low[k]] += length
    assert max(used) <= capacity and min(used) > 0
    assert sum(used) == sum(k * n for k, n in histogram.items())


def test_counts_equal_the_tokenizer():
    rng = random.Random(1)
    encode, counter = encoding(VOCABULARY).encode_ordinary, Counter()
    for _ in range(300):
        text = "".join(rng.choice("ابتث ab'sé 12٣\n\t<|endoftext|>،؛. 漢🙂") for _ in range(rng.randrange(200)))
        assert counter.count(text) == len(encode(text))


def test_sequences(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["باب", "coin", "x1", "،"]) for _ in range(rng.choice([0, 1, 5, 30, 300])))) for k in range(300)] + [(900, None), (901, ""), (902, "باب " * 20_000), (903, "coin"), (903, "coin")]
    p = Packing(docs(spark, rows), sizes(spark, [("small", 64), ("large", 512), ("small", 32), ("none", None), ("zero", 0)]))
    assert p.capacity == {"small": 64, "large": 512}
    length = {(r.doc_id, k): r.n_tokens for k, r in enumerate(p.lengths.collect())}
    got = p.sequences().collect()
    for kind, capacity in p.capacity.items():
        own = [r for r in got if r.pack_kind == kind]
        fill, of = {}, {}
        for r in own:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.n_tokens
            of.setdefault(r.doc_id, []).append(r)
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert {k for k, _ in rows} == set(of)
        for doc, n in {d: n for (d, _), n in length.items() if d != 903}.items():
            assert sum(r.n_tokens for r in of[doc]) == n and len(of[doc]) == max(1, -(-n // capacity))
            assert sorted(r.part for r in of[doc]) == list(range(len(of[doc])))
        assert len(of[903]) == 2
        assert sum(fill.values()) / (len(fill) * capacity) > 0.98
    s = {r.pack_kind: r for r in summary(p.fill()).collect()}
    assert s["small"].used_tokens == sum(length.values()) and s["small"].fill_permille > 980


def test_empty_and_only_empty_texts(spark):
    assert Packing(docs(spark, []), sizes(spark, [("a", 8)])).sequences().collect() == []
    assert Packing(docs(spark, [(1, "x")]), sizes(spark, [])).sequences().collect() == []
    got = Packing(docs(spark, [(1, None), (2, "")]), sizes(spark, [("a", 8)])).sequences().collect()
    assert sorted((r.doc_id, r.sequence_id, r.n_tokens) for r in got) == [(1, 0, 0), (2, 0, 0)]


def test_rank_of_a_hot_group_is_dense(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 10 = 0, id % 7, 99) as g")
    got = spread_rank(rows, ["g"], ["id"], F.lit(16)).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 5000
