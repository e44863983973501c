import random

import numpy as np
import pytest

from lexiloom.llm import spans as S


def brute(docs, n):
    where = {}
    for d, t in docs:
        for i in range(len(t) - n + 1):
            where.setdefault(t[i:i + n], set()).add(d)
    out = set()
    for d, t in docs:
        a = None
        for i in range(len(t) - n + 1):
            if len(where[t[i:i + n]]) > 1:
                if a is None:
                    a, b = i, i + n
                elif i <= b:
                    b = i + n
                else:
                    out.add((d, a, b))
                    a, b = i, i + n
        if a is not None:
            out.add((d, a, b))
    return out


def found(spark, docs, n, **kw):
    return {tuple(r) for r in S.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), n, **kw).collect()}


@pytest.mark.parametrize("alphabet, seed", [("abcdefgh ", 1), ("ab", 2), ("佛法僧𠀀é", 3)])
def test_against_brute_force(spark, alphabet, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randrange(10, 60)) for _ in range(6)]
    docs = [(i, text(rng.randrange(40)) + rng.choice(shared) + text(rng.randrange(30)) + rng.choice(shared)[: rng.randrange(60)] + text(5)) for i in range(40)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, ""), (103, "a")]
    assert found(spark, docs, 24) == brute(docs, 24)


def test_periodic_and_repeated_rows(spark):
    docs = [(1, "ab" * 100), (2, "x" + "ab" * 60), (3, "zz" * 80), (1, "ab" * 100)]
    assert found(spark, docs, 24) == brute(list(dict.fromkeys(docs)), 24)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 500)
    rng = random.Random(5)
    big = "".join(rng.choice("abcdefg") for _ in range(3000))
    docs = [(1, big), (2, "q" * 50 + big[480:900] + "r" * 50), (3, big[2400:2450])]
    assert found(spark, docs, 40) == brute(docs, 40)


def test_nulls_empty_and_amounts(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a" * 50, 1), (2, "a" * 50, 1), (3, "b", 1)], "doc_id long, text string, span_start int")
    assert S.shared_spans(df, 20).count() == 0
    assert S.shared_spans(df.filter("false"), 20).count() == 0
    df = spark.createDataFrame([(1, "a" * 10 + "b" * 30), (2, "b" * 30), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["shared_chars"], r["shared_ratio"]) for r in S.shared_amount(df, S.shared_spans(df, 20)).collect()}
    assert got == {1: (30, 0.75), 2: (30, 1.0), 3: (0, 0.0)}
    with pytest.raises(ValueError):
        S.shared_spans(df, 4)


def test_chosen_windows_cover_every_stretch():
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 103, 900).astype(np.uint32)
    piece = np.repeat(np.arange(3, dtype=np.int32), 300)
    at, _ = S.chosen(codes, piece, 10, 40)
    for i in range(861):
        if piece[i] == piece[i + 39]:
            assert ((at >= i) & (at + 10 <= i + 40)).any()
