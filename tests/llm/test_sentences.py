import random

import pytest

from lexiloom.llm import sentences as S


def split(text, wrapped=False):
    return [text[a:b] for a, b in S.units(text, wrapped)]


@pytest.mark.parametrize("units", [
    ["Mr. A. B. Lee met Dr. Roe at 10 a.m. on vol. 3, pp. 4-5.", "It cost $3.50 (cf. No. 7).", "See https://x.example/a.b?c=1.5 for more."],
    ["He left at 10 a.m.", "She stayed, etc.", "Lee et al.", "That was in 801 C.E.", "“Go! Now?” asked a friend.", "No."],
    ["Lee said: “Go. Run!”", "Then he left (he ran? yes!) and hid.", "The road ... went on… and on, until dusk...", "The end?!"],
    ["“One. Two,” said Lee.", "‘Is it’s end? Yes.’", "«Where?»"],
    ["No. 5 in ms. B (6 fols.).", "45 readers came, about 2.5% of 7.800.", "A plan."],
])
def test_english(units):
    assert split(" ".join(units)) == units
    assert split("\n".join(" ".join(units).split(" ")), True) == ["\n".join(u.split(" ")) for u in units]


@pytest.mark.parametrize("units", [
    ["師問：「何也？善。」", "僧曰：『老師道：「去。」也。』，乃去……復來；往！！", "「好。」，又（註。）行？"],
    ["犬は「行け。早く？」と言った。", "長さ4.2メートル。"],
    ["見T. 97, no. 5, p. 7，去。", "高3.5尺，來。"],
])
def test_chinese_and_japanese(units):
    assert split("".join(units)) == units


def test_wide_spaces():
    assert split("竹影掃階　塵不動　月穿潭") == ["竹影掃階", "塵不動", "月穿潭"]
    assert split("竹影掃階　塵不動。月穿潭") == ["竹影掃階　塵不動。", "月穿潭"]


def test_tibetan_sanskrit_korean():
    assert split("ཀ་ཁ། ག་ང༎ ཅ།།\nཆ") == ["ཀ་ཁ།", "ག་ང༎", "ཅ།།", "ཆ"]
    assert split("a b | c d || 12 || e / f // g । h ॥ Prose one, two. Three.") == ["a b | c d || 12 ||", "e / f //", "g । h ॥", "Prose one, two.", "Three."]
    assert split("가 2.5 이다. 나는 했다. 다 인가?") == ["가 2.5 이다.", "나는 했다.", "다 인가?"]


def test_layout_and_headings():
    assert split("Chapter 3. On Reeds\nIV. On Oil\n8.9 On Tea\nOne\ntwo.") == ["Chapter 3. On Reeds", "IV. On Oil", "8.9 On Tea", "One", "two."]
    assert split("One\ntwo. Three\n \nFour\r\n", True) == ["One\ntwo.", "Three", "Four"]
    assert split("高7.\n8尺。見T\n. 9，來。", True) == ["高7.\n8尺。", "見T\n. 9，來。"]


def test_open_quotation_does_not_swallow_the_paragraph():
    assert split("“One. Two. Three.\nFour.") == ["“One.", "Two.", "Three.", "Four."]


def test_nothing():
    assert split("") == [] and split(" \n　\t") == [] and split("...") == ["..."]


def test_transducer_is_total():
    nexts, outs = S.transducer()
    assert all(len(r) == len(nexts[0]) == len(o) for r, o in zip(nexts, outs)) and all(0 <= x < len(nexts) for r in nexts for x in r)


def test_functions_compose():
    rng = random.Random(1)
    text = "".join(rng.choice("ab. “”‘’「」()\n。？!　\"") for _ in range(400))
    ev = [x for x, _, _ in S.symbols(text, False)]
    f, g, h = S.chunk_function(ev[:40]), S.chunk_function(ev[40:]), S.chunk_function(ev)
    assert [g[x] for x in f] == h
    assert all(S.run(ev, s)[1] == h[s] for s in range(0, len(h), 37))


def in_chunks(text, wrapped, chunk):
    """Units by chunks, one after the other."""
    at = S.cuts(text, chunk)
    state, number, done, open_ = 0, 0, [], {}
    for k, (a, b) in enumerate(zip(at, at[1:])):
        off = max(0, a - S.CONTEXT - 1)
        c = S.lexed(text[off: b + S.AHEAD], wrapped, a - off, b - off, off, k == len(at) - 2)
        outputs, state = S.run(c.symbols, state)
        within, parts = S._parted(c, outputs)
        done += within
        for n, part in enumerate(parts):
            open_.setdefault(number + n, []).append(part)
        number += S.PARA in c.symbols
    for parts in open_.values():
        kinds = "".join(p[1] for p in parts)
        if kinds and kinds[-1] in "pu":
            has = 0
            for p in parts:
                has |= p[4]
            done += S.settled(parts[0][0], kinds, sum((p[2] for p in parts), []), sum((p[3] for p in parts), []), has)
    return sorted(done)


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_gives_the_same_units(seed):
    rng = random.Random(seed)
    marks = ["。", "？", "!", ".", "...", ". . .", "…", "……", " ", "  ", "\n", "\n\n", "\n \n", "　", "“", "”", "‘", "’", "「", "」", "『", "』", "(", ")", '"', "།", "༎", " ། ", "||", "॥ 12 ॥", "//", "\u200b", "\u2028", ", ", "; "]
    words = ["ab", "Lee", "Mr", "e.g", "No", "the", "xv", "師", "問何", "は", "가다", "བབ", "नम", "10", "3.5", "a" * 30, "Abcdefghijklmnopqrstuvwxyz"]
    for _ in range(250):
        text = "".join(rng.choice(marks) if rng.random() < rng.choice([0.3, 0.6]) else rng.choice(words) for _ in range(rng.randrange(1, 120)))
        for wrapped in (False, True):
            want = S.units(text, wrapped)
            assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in want) and want == sorted(want)
            for chunk in (1, rng.randrange(2, 40), 200):
                assert in_chunks(text, wrapped, chunk) == want, (text, wrapped, chunk)


def test_deep_quotations():
    assert split("「甲『乙「丙『丁』。戊」己。庚』辛。」壬。癸") == ["「甲『乙「丙『丁』。戊」己。庚』辛。」", "壬。", "癸"]
    assert split("He said “A «b ‘c (d “e «f (g? h) i! j» k. l” m? n) o! p’ q. r» s. t” and left. U.") == ["He said “A «b ‘c (d “e «f (g? h) i! j» k. l” m? n) o! p’ q. r» s. t” and left.", "U."]


SCHEMA = "doc_id long, text string, layout string, sent_no int"


def test_chunks_and_edge_rows(spark):
    rng = random.Random(2)
    words = ["One", "two.", "Three!", "“Four", "five.”", "Mr.", "e.g.", "六。", "「七", "八？」", "\n", "\n\n", "(nine)", "10.", "5"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400)), "wrapped" if i % 2 else "flow", 7) for i in range(6)]
    rows += [(10, None, "flow", 1), (11, "", None, 1), (None, "One. Two.", "flow", 1), (12, "One. Two.", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in S.sentence_units(df).collect()}
    parts = {tuple(r) for r in S.sentence_units(df, chunk=150).collect()}
    assert whole == parts and {r[0] for r in whole} == {*range(6), 12}
    twice = [(1, rows[0][1], "flow", 1), (1, rows[0][1], "flow", 1), (1, rows[2][1], "flow", 1)]
    one, two, three = (sorted(tuple(r) for r in S.sentence_units(spark.createDataFrame(x, SCHEMA), chunk=c).collect()) for x, c in ((twice, 10**6), (twice, 150), (twice[:1], 150)))
    assert one == two and len(one) > 2 * len(three)
    assert S.sentence_units(df.filter("false")).count() == 0
