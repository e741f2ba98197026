import random

import numpy as np
import pytest

from tracewright.llm import subjects as S

TERMS = {
    "cooking": ["oven", "saucepan", "recipe", "butter", "whisk", "garlic", "pastry", "spoon"],
    "sailing": ["mast", "harbour", "anchor", "rudder", "keel", "tide", "jib", "buoy"],
    "music": ["violin", "chorus", "tempo", "octave", "melody", "cello", "rhythm", "concert"],
}
FRAMES = ["The {a} was changed because the {b} kept failing.", "Nobody owns the {a} and somebody asked about the {b}.", "We saw that the {a} and the {b} disagree again.", "Please look at the {a} first, then at the {b}."]


def sentence(r, subject, known=8):
    a, b = r.sample(TERMS[subject][:known], 2)
    return r.choice(FRAMES).format(a=a, b=b)


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(2)
    examples = [(i, s, "en", " ".join(sentence(r, s, 5) for _ in range(4))) for i, s in enumerate(list(TERMS) * 6)]
    docs, truth = [], {}
    for i in range(400):
        own = r.sample(sorted(TERMS), 1 if i % 3 else 2)
        text = [sentence(r, s) for s in own for _ in range(5)]
        if len(own) == 1 and i % 5 == 0:
            text.append(sentence(r, r.choice(sorted(set(TERMS) - set(own)))))  # a passing mention
        r.shuffle(text)
        docs.append((i, " ".join(text), "x"))
        truth[i] = set(own)
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "  \n", "x"), (1003, "12:00:01 INFO oven mast violin", "x"), (1004, "```\noven.mast(violin)\n```", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    a = spark.createDataFrame([(s, "") for s in TERMS], "subject string, description string")
    e = spark.createDataFrame(examples, "example_id bigint, subject string, lang string, text string")
    return d, a, e, truth


def test_finds_one_or_two_subjects(world):
    d, a, e, truth = world
    got = {}
    for r in S.found(d, a, e).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not {1000, 1001, 1002, 1003, 1004} & set(got)
    right = sum(got.get(i) == t for i, t in truth.items())
    assert right / len(truth) > 0.95


def test_terms_no_example_holds_are_learnt(world):
    d, a, e, _ = world
    model, _ = S.fit(d, a, e)
    for i, s in enumerate(model.subjects):
        for t in TERMS[s][5:]:
            assert model.h[: len(TERMS), model.vocabulary.get(t)].argmax() == i


def test_mixtures_are_the_normalised_rows_of_the_factors(world):
    d, a, e, _ = world
    model, encoded = S.fit(d, a, e)
    lists = encoded.where("doc_id < 5").toArrow().column("sentences").combine_chunks()
    mixed = S.mixtures(model, lists)
    assert np.allclose(mixed.sum(1), 1) and (mixed >= 0).all()
    # read off by hand: one sentence factored alone gives the same row
    ids = lists[0].as_py()[0]
    w = S._weights(model.h, model.value, np.array(ids), np.zeros(len(ids), int), 1)[0, : len(TERMS)]
    assert np.allclose(mixed[0], w / w.sum())


def test_shares_come_from_sentences_about_something():
    about, other, vague = [0.9, 0.1], [0.1, 0.9], [0.45, 0.45]
    assert [s for s, _ in S.chosen(np.array([about, about, vague, vague]))] == [0]
    assert [s for s, _ in S.chosen(np.array([about] * 4 + [other]))] == [0]  # a passing mention
    assert sorted(s for s, _ in S.chosen(np.array([about] * 3 + [other] * 2))) == [0, 1]
    assert S.chosen(np.array([vague])) == [] and S.chosen(np.zeros((0, 2))) == []


def test_empty_tables_and_composition(world):
    d, a, e, truth = world
    assert S.found(d.limit(0), a, e).collect() == []
    assert S.found(d.limit(3), a, e.limit(0)).count() >= 0
    rows = S.composition(d, a, e).collect()
    assert {r.subject for r in rows} == set(TERMS) and abs(sum(r.corpus_share for r in rows) - 1) < 1e-9


def test_sentences_and_terms():
    assert S.sentences("One two. Three `four five`!\n\n```x\ny```\n12:00:00.1 INFO z\n總之。好的") == ["One two.", "Three  !", "總之", "好的"]
    assert "time slot" in S.terms("Our Time-Slots are full") and "slot" in S.terms("time_slot")
    assert S.terms("雙重 驗證") == ["雙重", "重驗", "驗證"]
    assert S.repaired("prÃ¼fen") == "prüfen" and S.repaired("ѕсоre") == "score"
    assert S.terms("loadAllRows") == []


def test_no_term_is_left_out_however_many_there_are(spark):
    def word(i):
        return "".join("bcdfghjkmn"[int(d)] + "aeiou"[int(d) % 5] for d in f"{i:05d}")

    own = {"cooking": "zzoven zzpan zzsieve", "sailing": "zzmast zzkeel zzbuoy"}
    filler = [". ".join(word(i) for i in range(a, a + 1300)) + "." for a in range(0, 26_000, 1300)]
    docs = [(n, t) for n, t in enumerate(filler * 5)] + [(9000 + 10 * k + i, f"{w}. {w}. {w}.") for k, w in enumerate(own.values()) for i in range(4)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    a = spark.createDataFrame([(s,) for s in own], "subject string")
    e = spark.createDataFrame([(s, f"{w}. {w}.") for s, w in own.items()] * 1, "subject string, text string")
    model, encoded = S.fit(d, a, e, rounds=2)
    assert len(model.vocabulary) > 26_000 and all(w in model.vocabulary for t in own.values() for w in t.split())
    got = {r.doc_id: r.subject for r in S.assign(model, encoded).where("doc_id >= 9000").collect()}
    assert got == {9000 + 10 * k + i: s for k, s in enumerate(own) for i in range(4)}
