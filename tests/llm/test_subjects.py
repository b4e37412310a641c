import random

import numpy as np

from waraq.llm.subjects import Reader, SubjectModel, monotone, stem

DOCS = "doc_id bigint, text string, subject string, labels int, words string, sizes string"
LABELS = "doc_id bigint, subject string, bit int, text string"

TERMS = {"law": ["العقد", "اليمين", "القاضي", "الوقف", "deed", "oath"], "medicine": ["النبض", "الكبد", "الحمى", "الدواء", "fever", "pulse"], "farming": ["النخل", "البذر", "الحصاد", "التربة", "soil", "seed"]}
REMARKS = ["وقد قوبلت هذه النسخة على الأصل", "وسقط من الورقة سطر فأثبته الناسخ", "A line missing from the draft was restored"]
FRAMES = ["وحاصل الكلام أن {} غير {}", "ولا يصح {} دون {}", "ومثال ذلك {} إذا قارن {}", "The {} cannot stand without the {}"]


def sentence(rng, subject):
    if subject == "general":
        return rng.choice(REMARKS)
    frame = rng.choice(FRAMES)
    own = [t for t in TERMS[subject] if (t[0] < "ɐ") == (frame[0] < "ɐ")]
    return frame.format(rng.choice(own), rng.choice(own))


def corpus(n, seed):
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        subjects = rng.sample([*TERMS], rng.choice([0, 1, 1, 1, 2]))
        lines = [sentence(rng, s) for s in subjects for _ in range(rng.randrange(3, 6))] + [sentence(rng, "general") for _ in range(rng.randrange(1, 4))]
        if subjects and len(subjects) == 1 and rng.random() < 0.3 and len(lines) > 8:
            lines.append(sentence(rng, rng.choice([s for s in TERMS if s not in subjects])))
        rng.shuffle(lines)
        texts.append("".join(x + rng.choice([". ", "؛ ", ".\n"]) for x in lines))
        counts = {s: sum(any(t in x for t in TERMS[s]) for x in lines) for s in TERMS}
        total = sum(counts.values())
        truth.append({s for s, c in counts.items() if total and c >= total / 4} or {"general"})
    return texts, truth


def model(spark, texts, labels, codes=("law", "medicine", "farming", "general")):
    docs = spark.createDataFrame([(k, t, "clash", 3, "clash", "clash") for k, t in texts], DOCS)
    return SubjectModel(docs, spark.createDataFrame([(*r, 1, "clash") for r in labels], LABELS), spark.createDataFrame([(c, "x") for c in codes], "subject string, name_en string"))


def found(m):
    out = {}
    for r in m.found().collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out


def test_held_out_accuracy_with_wrong_labels(spark):
    texts, truth = corpus(600, 1)
    rng = random.Random(2)
    labels = [(k, s) for k in range(0, 600, 4) for s in (truth[k] if rng.random() > 0.08 else {rng.choice([*TERMS])})]
    labels += [(0, f" {s.upper()} ") for s in truth[0]] * 2 + [(1, "nonsense"), (2, None), (None, "law"), (99999, "law")]
    m = model(spark, list(enumerate(texts)), labels)
    got = found(m)
    held = [k for k in range(600) if k % 4]
    assert sum(got[k] == truth[k] for k in held) / len(held) > 0.95
    assert sum(r.n_documents for r in m.composition().collect()) == sum(map(len, got.values()))
    curves = m.calibration()
    assert all(c == sorted(c) and 0 <= c[0] and c[-1] <= 1 for c in curves.values()) and curves["law"][0] < 0.3 < curves["law"][-1]
    rows = m.posteriors().collect()
    assert all(0 <= r.posterior_permille <= 1000 and 0 < r.share_permille <= 1000 for r in rows)


def test_odd_texts(spark):
    texts, truth = corpus(200, 3)
    labels = [(k, s) for k in range(200) for s in truth[k]]
    odd = [(1000, None), (1001, ""), (1002, "... ،؛ 123"), (1003, sentence(random.Random(1), "law") + "." ), (1003, sentence(random.Random(1), "law") + "."), (None, "x"), (1004, (sentence(random.Random(1), "law") + ". ") * 30_000)]
    got = found(model(spark, [*enumerate(texts), *odd], labels))
    assert got[1000] == got[1001] == got[1002] == got[None] == {"general"} and got[1003] == got[1004] == {"law"}


def test_no_labels_no_documents(spark):
    assert found(model(spark, [(1, "العقد")], [])) == {1: {"general"}}
    empty = model(spark, [], [(1, "law")])
    assert found(empty) == {} and empty.posteriors().collect() == [] and empty.composition().collect() == []


def test_reader():
    r = Reader()
    words, sizes = r.sentences("Bonds, courts and oath, The deed. قال العقد؛ وقال\n\n.. اليَمين")
    assert sizes.tolist() == [4, 2, 2, 1, 1]
    assert np.array_equal(words[0:1], r.sentences("bond")[0]) and np.array_equal(words[-1:], r.sentences("الیمین")[0])
    assert stem("glass") == "glass" and stem("Coins") == "coin"
    assert r.sentences(None)[0].size == 0 and r.sentences("")[1].size == 0


def test_monotone():
    assert monotone(np.array([1, 0, 3]), np.array([2, 2, 3])) == [0.25, 0.25, 1.0]


def test_posteriors_of_every_document_and_code(spark):
    texts, truth = corpus(60, 5)
    m = model(spark, [*enumerate(texts)], [(k, s) for k in range(60) for s in truth[k]])
    rows = m.all_posteriors().collect()
    assert len(rows) == 60 * len(m.codes) == len({(r.doc_id, r.subject) for r in rows})
    curves = m.calibration()
    none = [r for r in rows if r.share_permille == 0]
    assert "general" in {r.subject for r in none} and all(abs(r.posterior_permille - 1000 * curves[r.subject][0]) <= 1 for r in none)
    kept = {(r.doc_id, r.subject): (r.share_permille, r.posterior_permille) for r in rows}
    assert all(kept[r.doc_id, r.subject] == (r.share_permille, r.posterior_permille) for r in m.posteriors().collect())


def test_more_subjects_than_bits_of_an_integer(spark):
    texts, truth = corpus(120, 4)
    labels = [(k, x) for k in range(120) for x in truth[k]]
    m = model(spark, list(enumerate(texts)), labels, codes=[*TERMS, "general", *[f"subject {k}" for k in range(70)]])
    got = found(m)
    assert sum(got[k] == truth[k] for k in range(120)) >= 110
    assert m.all_posteriors().count() == 120 * len(m.codes)


def test_posteriors_are_calibrated_on_hidden_labels(spark):
    texts, truth = corpus(300, 6)
    labels = [(k, x) for k in range(0, 300, 2) for x in truth[k]]
    m = model(spark, list(enumerate(texts)), labels)
    assert m.held_out_counts().count() == 150
    rows = {r.subject: r for r in m.agreement().collect()}
    assert all(r.n_both >= 0.9 * r.n_labelled and r.n_both >= 0.9 * r.n_found for r in rows.values() if r.n_labelled > 20)
