import random

import numpy as np

from lexiloom.llm import leaks as L

WORDS = [a + b for a in ("ka", "mo", "ri", "tu", "be", "so") for b in ("len", "dor", "vim", "gast", "pel", "nor")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_tokens_fold():
    same = [L.tokens([t])[0].tolist() for t in ("The Café, 禪师!", "ＴＨＥ café 禪\n师", "the cafe 禪师")]
    assert same[0] == same[1] == same[2] and len(same[0]) == 4
    assert L.tokens([""])[0].size == 0 and L.shingles(*L.tokens(["a b"]))[0].size == 0


def test_search_finds_what_exhaustive_scoring_finds():
    rng = random.Random(3)
    items = [sentence(rng, rng.randrange(8, 60)) for _ in range(300)]
    index = L.Index.of(list(range(300)), items)
    texts = [items[i][: len(items[i]) // 2] + " " + sentence(rng, 30) for i in range(0, 300, 7)] + [sentence(rng, 200)]
    h, at = L.shingles(*(pair := L.tokens(texts)))
    hit, term = index.lookup(h)
    q = pair[1][at[hit]]
    got = set(zip(*(x.tolist() for x in index.search(q, term)[:2])))
    score = {}
    for d, t in set(zip(q.tolist(), term.tolist())):
        for b in range(index.block_off[t], index.block_off[t + 1]):
            for p in range(index.post_off[b], index.post_off[b + 1]):
                score[d, int(index.item[p])] = score.get((d, int(index.item[p])), 0.0) + float(index.weight[p])
    assert got == {k for k, s in score.items() if s >= L.RETRIEVE}
    assert all((i // 7, i) in got for i in range(0, 300, 7))


def test_held_share():
    assert L.held_share(np.arange(8), np.arange(100, 108), 10) == 1.0
    assert L.held_share(np.zeros(0, int), np.zeros(0, int), 10) == 0.0
    two = L.held_share(np.r_[0:4, 20:24], np.r_[5:9, 300:304], 30)
    assert abs(two - 12 / 30) < 1e-9
    assert L.held_share(np.array([0, 10, 20]), np.array([50, 5, 90]), 30) == 6 / 30  # scattered: the two best only


def test_leaks(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, 40)) for i in range(60)] + [(60, "a b"), (61, ""), (62, None), (63, "禪"), (64, "Uno")]
    words = items[5][1].split()
    altered = [w.upper() if k % 3 else w for k, w in enumerate(words)]
    altered[17] = "changed"
    docs = [
        (1, sentence(rng, 50) + "\n" + "\n".join(altered) + "! " + sentence(rng, 20)),
        (2, " ".join(items[7][1].split()[:13]) + " " + sentence(rng, 80) + " " + " ".join(items[7][1].split()[13:26])),
        (3, " ".join(items[8][1].split()[:12]) + " " + sentence(rng, 80)),
        (4, None), (5, ""), (None, items[1][1]), (6, items[1][1] + " " + sentence(rng, 1500) + " " + items[2][1]), (6, items[1][1]), (7, sentence(rng, 300)), (8, "b a, b. unos"), (9, "A-B 参禪"), (10, "(uno)"),
    ]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 5), (2, 7), (6, 1), (6, 2), (8, 60), (9, 60), (9, 63), (10, 64)}
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(df, it).collect()} == want
    assert L.leaks(df.filter("false"), it).count() == 0 and L.leaks(df, it.filter("false")).count() == 0


def test_index_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "INDEX_CHARS", 700)
    rng = random.Random(11)
    items = [(i, sentence(rng, 30)) for i in range(30)]
    it = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t + " " + sentence(rng, 900)) for i, t in items], "doc_id long, text string")
    it = it.selectExpr("item_id", "text", "CASE WHEN item_id % 3 = 0 THEN substring_index(text, ' ', 1 + item_id % 5) WHEN item_id % 3 = 1 THEN 'zz yy' END AS answer")
    got = sorted(map(tuple, L.leaks(docs, it).collect()))
    assert [(d, i, a) for d, i, _, _, a in got] == [(i, i, i % 3 == 0) for i in range(30)]
    monkeypatch.setattr(L, "INDEX_CHARS", 10**6)
    assert [(d, i, h, a) for d, i, _, h, a in got] == [(d, i, h, a) for d, i, _, h, a in sorted(map(tuple, L.leaks(docs, it).collect()))]


def test_long_item_is_found():
    rng = random.Random(5)
    word = lambda n: " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))
    items = [word(6000), word(40), word(1300)]
    index = L.Index.of([3, 4, 5], items)
    docs = [word(300) + " " + items[0], " ".join(items[0].split()[1000:4600]), " ".join(items[2].split()[:800]) + " " + items[1], " ".join(items[0].split()[:1500])]
    got = L._pairs(index, [10, 11, 12, 13], L.Hits.of(docs, index.cells(1 << 20)))
    assert {(d, i) for d, i, *_ in got} == {(10, 3), (11, 3), (12, 5), (12, 4)}
    assert abs(dict(((d, i), h) for d, i, _, h, _ in got)[11, 3] - 0.6) < 0.01


def test_held_share_keeps_pieces_beside_a_refrain():
    refrain = [(np.arange(38), 1000 * k + np.arange(38)) for k in range(1, 10)]
    i = np.concatenate([x for x, _ in refrain] + [np.arange(60, 83)])
    j = np.concatenate([y for _, y in refrain] + [20_000 + np.arange(23)])
    assert L.held_share(i, j, 100) == 0.65
    # The best pair need not hold the widest piece.
    i = np.r_[20:60, 0:38, 50:88]
    assert L.held_share(i, np.r_[1000:1040, 3000:3038, 5000:5038], 90) == 80 / 90


def test_held_share_is_that_of_the_best_pair(monkeypatch):
    monkeypatch.setattr(L, "COVER_CELLS", 90)
    rng = random.Random(2)
    for _ in range(200):
        n, places, sets = 40, [], []
        for k in range(rng.randrange(1, 14)):
            at = sorted(rng.sample(range(n - 2), rng.randrange(1, 7)))
            places += [(x, 1000 * k + x) for x in at]
            parts, own = [], []
            for x, y in zip(at, at[1:] + [10**6]):
                own += list(range(x, y if y - x <= 7 else x + 3))
                if y - x > 24:
                    parts.append(set(own))
                    own = []
            sets += parts
        want = max(len(a | b) for a in sets for b in sets) / n
        assert abs(L.held_share(*(np.array(x) for x in zip(*places)), n) - want) < 1e-9
