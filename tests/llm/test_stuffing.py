import random

import numpy as np

from lexiloom.llm import stuffing as S

NOUNS = [a + b for a in ("re", "la", "sto", "mi", "ta", "bo", "ke") for b in ("ed", "mp", "ve", "rror", "ble", "wl", "ttle", "nd")]


def prose(rng, n):
    np_ = lambda: rng.choice(["the", "a", "some", "every", "no"]) + " " + rng.choice(NOUNS) + rng.choice(["", " of the " + rng.choice(NOUNS)])
    return " ".join(f"{np_().capitalize()} {rng.choice(NOUNS)} {np_()} {rng.choice(['under', 'with', 'before'])} {np_()}." for _ in range(n))


def keywords(rng, n, sep=" / "):
    own = [f"{rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(5)]
    return sep.join(rng.choice(own) for _ in range(n))


def test_model_is_a_distribution():
    p = np.exp(-S.trained(np.array([5, S.V + 7, 9]), np.array([3, 2, 1]))).reshape(S.V, S.V, S.V).sum(2)
    assert np.allclose(p, 1, atol=1e-3)


def test_classes():
    inv = [*S.CLASSES, *S.FUNCTION_WORDS]
    name = lambda t: [inv[c] for c in S.classes(t)[0]]
    assert name("The red lamp, red lamp") == ["the", "word", "word", ",", "word", "word+"]
    assert name("https://x.example/a b-c.test #tag #tag1 <a href='q'>") == ["url", "url", "tag", "tag+", "markup"]
    assert name("廊報 廊報、") == ["han2", "han+", "、"] and name("") == []
    assert S.classes("a b\n\nc")[1] == [2, 1]
    assert name("瓦敲光東雨臨書跋瓦敲光東雨臨書跋瓦敲光東") == ["han+"] * 6 and name("瓦敲光東雨臨書跋醒斤內徒") == ["han8"]
    assert name("kéhā mist | kéhā oil | kéhā bow | kéhā axe")[-2:] == ["word=", "word"] and name("རིན་ཐང་རིན་ཐང་རིན་ཐང་") == ["han+"] * 3 and name("ཐོན་ནས") == ["tibetanf"]


def test_pages(spark):
    rng = random.Random(7)
    pages = [(i, "\n".join(prose(rng, 5) for _ in range(3))) for i in range(150)]
    pages += [(1000 + i, keywords(rng, 60, sep)) for i, sep in enumerate([" / ", ", ", " | ", " * "])]
    pages += [(2000, "\n".join(f"https://a{i}.example/x/{i} {rng.choice(NOUNS)} sale" for i in range(40)))]
    pages += [(3000, prose(rng, 20) + "\n" + keywords(rng, 6, ", ")), (3001, keywords(rng, 60) + "\n" + prose(rng, 2))]
    pages += [(4000, None), (4001, ""), (4002, " \n"), (None, keywords(rng, 40)), (1000, pages[150][1])]
    df = spark.createDataFrame(pages, "doc_id long, text string")
    flagged = sorted(r["doc_id"] for r in S.stuffed_pages(df).collect())
    assert flagged == [1000, 1000, 1001, 1002, 1003, 2000, 3001]
    scores = {r["doc_id"]: (r["perplexity"], r["abnormal_share"]) for r in S.page_scores(df).collect()}
    assert scores[4001] == (None, 0.0) and scores[0][0] < scores[1000][0]
    assert S.stuffed_pages(df.filter("false")).count() == 0
