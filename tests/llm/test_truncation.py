import random

import numpy as np
import pytest

from tracewright.llm import pairs as P
from tracewright.llm import truncation as T
from tracewright.llm.language import language

WORDS = "the red fox saw a lazy dog near our old house while rain fell on every quiet street in town".split()


def corpus(n, seed=1):
    """(text, is cut): prose, code and JSON, a tenth of it cut at a random place."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind = r.randrange(3)
        if kind == 0:
            text = " ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(5, 12))).capitalize() + "." for _ in range(r.randint(2, 6)))
        elif kind == 1:
            text = "\n".join(f"{r.choice(WORDS)}_{r.choice(WORDS)} = self.load_{r.choice(WORDS)}({r.choice(WORDS)}, {r.randrange(99)})" for _ in range(r.randint(2, 8))) + f"\nreturn make_{r.choice(WORDS)}({r.choice(WORDS)})"
        else:
            text = '{"items": [' + ", ".join('{"name": "%s", "size": %d}' % (r.choice(WORDS), r.randrange(99)) for _ in range(r.randint(2, 9))) + '], "total": 3}'
        cut = r.random() < 0.1
        if cut:
            text = text[: r.randint(len(text) // 3, len(text) - 3)]
        out.append((text, cut))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(6000))]
    return T.fit(spark.createDataFrame(rows, "id bigint, response string"), "response")


def test_held_out_accuracy(fitted):
    rows = corpus(2000, 77)
    cut = T.cut_flags(*fitted, [t for t, _ in rows])
    truth = np.array([c for _, c in rows])
    assert (cut & truth).sum() / truth.sum() > 0.85  # a cut right after a full stop cannot be seen
    assert (cut & truth).sum() / cut.sum() > 0.95


def test_query_form(spark, fitted):
    rows = [(1, "She saw a lazy dog near our old", "p"), (2, None, "p"), (3, "", "p"), (4, " ​ ", "p"), (5, "She saw a lazy dog near our old house.", None), (6, '{"a": [1, 2', "p"), (7, "He waited … [truncated]", "p"), (7, "He waited … [truncated]", "p")]
    df = spark.createDataFrame(rows, "id bigint, response string, truncated string")
    got = sorted((r.id, r.truncated) for r in T.flag_truncated(df, "id", "response", fitted=fitted).collect())
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (7, True), (7, True)]
    assert T.flag_truncated(df.limit(0), "id", "response").collect() == []


def test_exact_signs():
    assert T.open_delimiter("```python\nx = 1") and not T.open_delimiter("```python\nx = 1\n```")
    assert T.open_delimiter('{"a": "x}') and not T.open_delimiter('{"a": "x}"}') and not T.open_delimiter("[note] see above")
    assert T.closed_json('{"a": 1}') and not T.closed_json('{"a": 1')
    assert T.clipped("abc…") and T.clipped("abc [truncated]") and not T.clipped("abc")
    assert T.echoes_end("> WHY DOES `X` FAIL SO OFTEN NOW", "Text.\nWhy does `x` fail so often now\nlog line")
    assert not T.echoes_end("Why does `x` fail so oft", "Text.\nWhy does `x` fail so often now\nlog line")


def test_very_long_text(fitted):
    text = "She saw a dog. " * 60000
    assert T.cut_flags(*fitted, [text.strip(), text + "She saw a"]).tolist() == [False, True]


def test_suffix_automaton_against_brute_force():
    r = random.Random(4)
    for _ in range(40):
        a = "".join(r.choice("abc中") for _ in range(r.randint(0, 60)))
        b = "".join(r.choice("abc中x") for _ in range(r.randint(0, 60)))
        want = [max((n for n in range(i + 2) if b[i + 1 - n : i + 1] in a), default=0) for i in range(len(b))]
        assert P.SuffixAutomaton(a).matches(b) == want


def test_phrase_automaton_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        phrases = tuple({"".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(5)})
        auto = P.PhraseAutomaton(phrases)
        text = "".join(r.choice("abc") for _ in range(12))
        assert auto.search(text) == any(p in text for p in phrases)


PROMPT = "The loader was changed because the parser kept failing after nine attempts.\n\nWhy does `loadAll` fail after the loader changed?"


@pytest.mark.parametrize(
    "prompt,response,status,elsewhere,cut,defect",
    [
        (PROMPT, None, "ok", False, False, "empty"),
        (PROMPT, None, "ok", True, False, None),
        (PROMPT, None, "error", False, False, None),
        (PROMPT, "```python\n```", "ok", False, False, "empty"),
        (PROMPT, '{"body_statements": ""}', "ok", False, False, "empty"),
        (PROMPT, "```json\n{\"a\": [null, \" \"]}\n```", "ok", False, False, "empty"),
        (PROMPT, " \u200b\n", "ok", False, False, "empty"),
        (PROMPT, "Yes.", "ok", False, False, None),
        (PROMPT, "I'm sorry, but I can't help with `loadAll`.", "ok", False, False, "refusal"),
        (PROMPT, '{"body": "", "error": "I must decline to answer."}', "ok", False, False, "refusal"),
        (PROMPT, "I can't find a caller of `loadAll`, so it is dead code and may go.", "ok", False, False, None),
        (PROMPT, "The loader is now", "timeout", False, True, "truncated"),
        (PROMPT, PROMPT.upper(), "ok", False, False, "copy"),
        (PROMPT, "> " + PROMPT.replace("\n", "\n> "), "ok", False, False, "copy"),
        (PROMPT, "Why does `loadAll` fail after the loader changed?", "ok", False, False, "copy"),
        (PROMPT, "Why does `loadAll` fail after the loader changed?\n\nBecause the queue of the writer is never drained before the reader asks for the next block of rows.", "ok", False, False, None),
        (PROMPT, "Weil der Lader nicht mehr auf die Daten wartet und das Ergebnis deshalb leer ist.", "ok", False, False, "language"),
        (PROMPT + "\nPlease answer in German.", "Weil der Lader nicht mehr auf die Daten wartet und das Ergebnis deshalb leer ist.", "ok", False, False, None),
        (PROMPT + "\n請用中文回答。", "因為載入器不再等待資料，所以結果是空的，請先檢查佇列。", "ok", False, False, None),
        (PROMPT + "\n請用中文回答。", "Porque el cargador ya no espera los datos y por eso el resultado está vacío.", "ok", False, False, "language"),
        (None, "Weil der Lader nicht mehr auf die Daten wartet.", "ok", False, False, None),
        (PROMPT, "x = self.load(rows)\nif x is None:\n    return None\nreturn x", "ok", False, False, None),
    ],
)
def test_defects(prompt, response, status, elsewhere, cut, defect):
    assert P.defects([prompt], [response], [status], [elsewhere], np.array([cut])) == [defect]


def test_refusals_and_empty_answers_of_any_length():
    advice = " You may try a smaller file instead, or ask the owner of the table for a copy of it." * 20
    assert P.is_refusal("I'm sorry, but I can't help with `loadAll`." + advice)
    assert P.is_refusal("Thank you for the details. I must decline to answer." + advice)
    assert not P.is_refusal("The loader reads rows." * 3 + advice + " I can't help with more.")
    assert not P.is_refusal("I can't help but notice:\n```python\nreturn 1\n```")
    # words that only look like refusing
    assert not P.is_refusal("Der Dienst wird Anfragen ohne Schlüssel ablehnen.") and not P.is_refusal("系統會婉拒過期的請求。") and not P.is_refusal("The user was not comfortable with the form.")
    assert not P.is_refusal("Hai cannot provident.") and P.is_refusal("恕我無法提供。")
    assert P.is_empty('{"a": [' + ", ".join(['""'] * 5000) + "]}") and not P.is_empty('{"a": [' + ", ".join(['""'] * 5000) + ", 0]}")
    assert P.is_empty("[" * 30_000 + "]" * 30_000)


def test_short_chinese_questions_are_copies():
    prompt = "這裡有一份記錄。\n\n為什麼載入器會失敗？請提出修法。"
    assert P.is_copy(prompt, "為什麼載入器會失敗？請提出修法。") and not P.is_copy(prompt, "因為佇列沒有清空，所以要先等待。")


def test_the_bound_loses_no_copy():
    r = random.Random(8)
    for _ in range(300):
        p = "".join(r.choice("abc ") for _ in range(80))
        q = "".join(r.choice(("abc ", p[(k := r.randrange(60)) : k + 20])[r.random() < 0.5]) for _ in range(4))
        covered, n = P.coverage(p, q, 12)
        assert P._at_most(p, q, 12) == (covered if n - covered <= P.COPY_EXTRA else 0)


def test_contexts_reach_behind_long_words(fitted):
    base = "She saw a lazy dog near our old house."
    texts = [base + " " * 5000 + ")", "x " * 3 + "y" * 5000 + ".", base]
    tail = T._tail_contexts(texts)
    whole = [T.contexts(*T._symbolise([t]), T.groups_of([t]), np.array([len(T._symbolise([t])[0]) - 1]))[0] for t in texts]
    assert (tail == np.array(whole)).all()
    assert T.form("x" * 1000 + " = f(1)") == 3


def test_thresholds_move_little_with_few_texts():
    counts = np.zeros((T.GROUPS, 160), np.int64)
    counts[0, 20], counts[0, 120] = 500, 9500
    counts[1, 55] = 3
    limits = T.thresholds(counts)
    assert -5.5 <= limits[0] <= -1 and abs(limits[1] - limits[2]) < 2.5


def test_find_defects(spark, fitted):
    rows = [(1, PROMPT, None, "ok", None, "x"), (2, PROMPT, None, "running", None, "x"), (3, PROMPT, None, "ok", "k", "x"), (4, PROMPT, PROMPT, "ok", None, "x"), (5, None, "She saw a dog.", None, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, prompt string, response string, status string, response_payload_key string, defect string")
    assert sorted(map(tuple, P.find_defects(df, fitted=fitted).collect())) == [(1, "empty"), (4, "copy")]
    assert P.find_defects(df.limit(0)).collect() == []


def test_language_votes():
    assert language("The house is near the river and it was built before the war.") == "en"
    assert language("Das Haus ist nicht mehr bei dem Fluss und wird jetzt auch verkauft.") == "de"
    assert language("La casa está cerca del río y fue construida antes de la guerra.") == "es"
    assert language("房子在河邊，已經很久沒有人住了。") == "zh"
    assert language("x = 1") == "none"
