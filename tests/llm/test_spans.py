import random
from collections import defaultdict

import numpy as np
import pytest

from waraq.llm.spans import MIN_SPAN, Rolling, SharedSpans, Sizes, anchors, common_runs, sliding_min

SCHEMA = "line_id bigint, html string, id int, text string, rep string, key string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, 1, "clash", "clash", "clash") for k, t in rows], SCHEMA)


def brute_pairs(rows, MIN_SPAN=MIN_SPAN):
    seen = defaultdict(set)
    for k, t in rows:
        if t is not None and k is not None:
            for i in range(len(t) - MIN_SPAN + 1):
                seen[t[i : i + MIN_SPAN]].add(k)
    return sorted({(a, b) for ids in seen.values() for a in ids for b in ids if a < b})


def brute_shared(rows, MIN_SPAN=MIN_SPAN):
    seen = defaultdict(set)
    for k, t in rows:
        for i in range(len(t) - MIN_SPAN + 1):
            seen[t[i : i + MIN_SPAN]].add(k)
    out = {}
    for k, t in rows:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - MIN_SPAN + 1):
            if len(seen[t[i : i + MIN_SPAN]]) > 1:
                mask[i : i + MIN_SPAN] = True
        out[k] = int(mask.sum())
    return out


def quoting_lines(seed, n, alphabet):
    rng = random.Random(seed)
    word = lambda m: "".join(rng.choice(alphabet) for _ in range(m))
    source = [word(rng.randrange(100, 500)) for _ in range(8)]
    rows = []
    for k in range(n):
        s = rng.choice(source)
        m = rng.choice([60, 119, 120, 121, 150, 300])
        at = rng.randrange(max(1, len(s) - m))
        rows.append((k, word(rng.randrange(0, 90)) + s[at : at + m] + word(rng.randrange(0, 90)) + (rng.choice(source)[:130] if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("alphabet", ["ابتثجحخدذرز سش", "ab", "a𝔸é ن​"])
def test_equals_brute_force(spark, alphabet):
    rows = quoting_lines(len(alphabet), 60, alphabet)
    spans = SharedSpans(table(spark, rows))
    assert sorted(map(tuple, spans.pairs().collect())) == brute_pairs(rows)
    got = {r.line_id: r for r in spans.shared().collect()}
    assert {k: r.shared_chars for k, r in got.items()} == brute_shared(rows)
    assert pairs_of(spans.links()) == set(brute_pairs(rows))


def pairs_of(links):
    """Pairs of lines that a link has together."""
    lines = defaultdict(set)
    for r in links.collect():
        lines[r.link].add(r.line_id)
    return {(a, b) for ids in lines.values() for a in ids for b in ids if a < b}


@pytest.mark.parametrize("span", [8, 31, 60, 121, 200])
def test_other_spans(spark, span):
    rows = quoting_lines(span, 50, "ابتثجحخد ") + [(99, "ab" * 200), (100, "ba" * 170)]
    spans = SharedSpans(table(spark, rows), min_span=span)
    assert sorted(map(tuple, spans.pairs().collect())) == brute_pairs(rows, span)
    assert {r.line_id: r.shared_chars for r in spans.shared().collect()} == brute_shared(rows, span)


def test_nulls_short_long_repeats_and_empty(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("ابتث ") for _ in range(300_000))
    rows = [(1, None), (2, ""), (3, "x" * 119), (4, "x" * 119), (None, "y" * 200), (5, "y" * 200), (6, long), (7, "_" + long[1000:1120] + "_"), (8, "z" * 120), (8, "z" * 120)]
    spans = SharedSpans(table(spark, rows))
    assert sorted(map(tuple, spans.pairs().collect())) == [(6, 7)]
    got = {r.line_id: (r.n_chars, r.shared_chars) for r in spans.shared().collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (119, 0), 4: (119, 0), 5: (200, 0), 6: (300_000, 120), 7: (122, 120), 8: (120, 0)}
    empty = SharedSpans(table(spark, []))
    assert empty.pairs().collect() == [] and empty.shared().collect() == [] and empty.links().collect() == []


def test_copies_are_one_class(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef ") for _ in range(200))
    rows = [(k, text) for k in range(300)] + [(300, "~" + text[20:150])]
    spans = SharedSpans(table(spark, rows))
    assert len(spans.repeats().collect()) == 1
    assert spans.pairs().count() == 300 * 299 // 2 + 300
    got = {r.line_id: r.shared_chars for r in spans.shared().collect()}
    assert got[5] == 200 and got[300] == 130
    assert spans.links().count() == 300 + 2


def test_period_texts_find_every_pair(spark):
    rows = [(1, "ab" * 100), (2, "ba" * 90), (3, "abc" * 60), (4, "bca" * 60), (5, "a" * 400), (6, "a" * 130)]
    assert sorted(map(tuple, SharedSpans(table(spark, rows)).pairs().collect())) == brute_pairs(rows)


@pytest.mark.parametrize("span", [8, 13, 24, 50, 120, 333])
def test_guarantee_of_the_blocks(span):
    sizes = Sizes(span)
    assert 3 * sizes.block - sizes.gram - 2 <= span and 2 * sizes.side - 1 <= span - sizes.block and sizes.block > sizes.gram
    rng = random.Random(9)
    for alphabet in ("ab", "abcdefgh", "ابتثجحخدذرزسشصضطظعغ "):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 900))) for _ in range(20)]
        text, start, _, is_block = anchors(texts, sizes)
        for k, t in enumerate(texts):
            own = np.unique(start[(text == k) & is_block])
            assert all(np.diff(own) >= sizes.block)
            for p in range(len(t) - span + 1):
                assert ((own >= p) & (own + sizes.block <= p + span)).any()


def test_hash_depends_on_content_only():
    codes = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9] * 9, dtype=np.uint32)
    r = Rolling(codes)
    for size in (1, 2, 3, 7, 39, 43):
        h = r.windows(size)
        assert len(h) == len(codes) - size + 1 and (h[:9] == h[9:18]).all() and len(set(h[:9].tolist())) == 9


def test_sliding_min_and_runs():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 5, 37):
        assert sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]
    a, b = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in ("xxabcdyyabc", "abcdzz"))
    assert list(common_runs(a, b, -2, 3)) == [(2, 4)] and list(common_runs(a, b, -8, 3)) == [(8, 3)] and list(common_runs(a, b, 50, 3)) == []


def test_long_phrases_of_very_many_lines_do_not_pair_up(spark):
    rng = random.Random(11)
    word = lambda m: "".join(rng.choice("abcdefghij ") for _ in range(m))
    phrases = [word(m) for m in (90, 112, 119, 124)]
    rows = [(k, word(rng.randrange(60, 90)) + phrases[k % 3] + word(rng.randrange(60, 90))) for k in range(1500)]
    rows += [(2000 + k, word(50) + phrases[3] + word(rng.randrange(20))) for k in range(400)] + [(3000 + k, rows[k][1][30:200] + word(30)) for k in range(60)]
    spans = SharedSpans(table(spark, rows))
    assert sorted(map(tuple, spans.pairs().collect())) == brute_pairs(rows)
    assert {r.line_id: r.shared_chars for r in spans.shared().collect()} == brute_shared(rows)
    assert spans.hubs().count() >= 400 and spans.links().count() < 40_000
    assert pairs_of(spans.links()) == set(brute_pairs(rows))


def test_joins_without_broadcast(spark, monkeypatch):
    import waraq.llm.spans as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(module, "LARGE_GROUP", 3)
    rows = quoting_lines(3, 80, "ابتثجحخد ")
    spans = SharedSpans(table(spark, rows))
    assert sorted(map(tuple, spans.pairs().collect())) == brute_pairs(rows)
    assert {r.line_id: r.shared_chars for r in spans.shared().collect()} == brute_shared(rows)


def test_every_step_equals_brute_force(spark, monkeypatch):
    import waraq.llm.spans as module

    monkeypatch.setattr(module, "LARGE_GROUP", 1)
    for alphabet in ("ab", "ابتثجح "):
        rows = quoting_lines(7, 60, alphabet)
        spans = SharedSpans(table(spark, rows))
        assert sorted(map(tuple, spans.pairs().collect())) == brute_pairs(rows)
        assert {r.line_id: r.shared_chars for r in spans.shared().collect()} == brute_shared(rows)


def brute_stretches(rows, span=MIN_SPAN):
    """{members: length}: runs of windows that occur at the same places, each place moved by one, as far as they go."""
    seen = defaultdict(set)
    for k, t in rows:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]].add((k, i))
    places = {frozenset(p) for p in seen.values() if len({k for k, _ in p}) > 1}
    moved = lambda p, n: frozenset((k, i + n) for k, i in p)
    out = {}
    for p in places:
        if moved(p, -1) not in places:
            n = 1
            while moved(p, n) in places:
                n += 1
            out[p] = span - 1 + n
    return out


def stretches_of(links):
    members, lengths = defaultdict(set), defaultdict(set)
    for r in links.where("kind <> 'copy'").collect():
        members[r.link].add((r.line_id, r.start))
        lengths[r.link].add(r.n_chars)
    assert all(len(n) == 1 for n in lengths.values())
    return {frozenset(p): lengths[link].pop() for link, p in members.items()}


@pytest.mark.parametrize("large", [1, 24, 10_000])
@pytest.mark.parametrize("alphabet", ["ab", "ابتثجحخد "])
def test_links_do_not_depend_on_the_size_of_groups(spark, monkeypatch, large, alphabet):
    import waraq.llm.spans as module

    monkeypatch.setattr(module, "LARGE_GROUP", large)
    rows = quoting_lines(4, 50, alphabet) + [(90, "abc" * 70), (91, "_" + "bca" * 60), (92, "a" * 150), (93, "a" * 130)]
    assert stretches_of(SharedSpans(table(spark, rows)).links()) == brute_stretches(rows)


@pytest.mark.parametrize("n", [24, 25, 26])
def test_two_long_phrases_stay_whole_when_one_more_line_has_them(spark, n):
    rng = random.Random(2)
    word = lambda m: "".join(rng.choice("ابتثجحخدذرزسش ") for _ in range(m))
    first, second = word(200), word(150)
    rows = [(k, chr(0x4E00 + k) + first + chr(0x5E00 + k) * 2 + second + chr(0x6E00 + k)) for k in range(n)]
    got = stretches_of(SharedSpans(table(spark, rows)).links())
    assert got == {frozenset((k, 1) for k in range(n)): 200, frozenset((k, 203) for k in range(n)): 150} == brute_stretches(rows)


def test_links_by_joins_without_broadcast(spark, monkeypatch):
    import waraq.llm.spans as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(module, "LARGE_GROUP", 3)
    rows = quoting_lines(6, 80, "ابتثجحخد ")
    assert stretches_of(SharedSpans(table(spark, rows)).links()) == brute_stretches(rows)
