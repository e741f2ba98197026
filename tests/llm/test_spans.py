import random

import pytest

from tracewright.llm import spans as S


def brute(rows, least):
    """(id, shared characters) by comparing every window of every row with those of other owners."""
    seen = {}
    for _, owner, text in rows:
        for i in range(len(text or "") - least + 1):
            seen.setdefault(text[i : i + least], set()).add(owner)
    out = []
    for key, owner, text in rows:
        mark = bytearray(len(text or ""))
        for i in range(len(text or "") - least + 1):
            if seen[text[i : i + least]] - {owner}:
                mark[i : i + least] = b"\1" * least
        if sum(mark):
            out.append((key, sum(mark)))
    return sorted(out)


def run(spark, rows, least, **kw):
    df = spark.createDataFrame(rows, "id bigint, trace_id string, prompt string")
    return sorted((r.id, r.shared_chars) for r in S.shared_spans(df, key="id", owner="trace_id", text="prompt", min_chars=least, **kw).collect())


def corpus(seed, n=60, alphabet="abc中d👍 "):
    r = random.Random(seed)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randint(20, 400))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            parts += [p[a : a + r.randint(1, 300)], "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))]
        rows.append((i, f"t{r.randrange(n // 2)}" if r.random() < 0.9 else None, "".join(parts) if r.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("least,seed,fan_out", [(200, 1, 4096), (100, 2, 2), (60, 3, 4096), (35, 4, 3)])
def test_against_brute_force(spark, least, seed, fan_out):
    rows = corpus(seed)
    assert run(spark, rows, least, group_bytes=2000, fan_out=fan_out) == brute(rows, least)


def test_buckets():
    assert S._buckets(100, 4096) == (100, 1)
    coarse, fine = S._buckets(1_000_000, 4096)
    assert coarse * fine >= 1_000_000 and max(coarse, fine) <= 4096


def test_edges(spark):
    text = "x" * 150 + "".join(map(chr, range(300, 400)))
    rows = [(1, "a", text), (2, "b", text), (3, "b", text), (4, "c", text[:199]), (5, "d", ""), (6, "e", None)]
    assert run(spark, rows, 200) == [(1, 250), (2, 250), (3, 250)]
    same = [(1, "a", text), (2, "a", text)]
    assert run(spark, same, 200) == []
    nulls = [(1, None, text), (2, None, text)]
    assert run(spark, nulls, 200) == []
    assert run(spark, [*nulls, (3, "a", text)], 200) == [(1, 250), (2, 250), (3, 250)]
    assert run(spark, [(1, "a", None)], 200) == []


def test_a_hot_text_in_a_third_of_all_rows(spark):
    hot = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    rows = [(i, f"t{i}", (hot if i % 3 == 0 else "") + f"{i} " * 120) for i in range(900)]
    assert run(spark, rows, 200, group_bytes=20000) == brute(rows, 200)


def test_covers_meet_every_shift():
    for period, cover in S.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert S.cover_for(200) == (91, S.COVERS[91], 110)
    assert all(w + p - 1 == n for n in range(1, 400) for p, _, w in [S.cover_for(n)])


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "y" * 201, "q", 5), (2, "b", "y" * 200, "q", 5)], "id bigint, trace_id string, prompt string, key string, owner int")
    got = S.shared_spans(df, key="id", owner="trace_id", text="prompt", min_chars=200)
    assert got.columns == ["id", "shared_chars"]
    assert sorted((r.id, r.shared_chars) for r in got.collect()) == [(1, 201), (2, 200)]
