import random

import pytest

from lexiloom.operators import hierarchy as H


def brute(parent: dict) -> set:
    out = set()
    for v in parent:
        seen, p = set(), parent[v]
        while p is not None and p in parent and p not in seen:
            seen.add(p)
            out.add((p, v))
            p = parent[p]
    return out


def solve(spark, rows, **kw):
    return H.hierarchy(spark.createDataFrame(rows, "key string, parent string"), **kw)


def pairs(h):
    got = [tuple(r) for r in h.pairs().collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_paths_rings_and_orphans(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), ("o", "nowhere"), ("b", "a"), (None, "a")]
    h = solve(spark, rows)
    paths = {r["key"]: (r["path"], r["depth"], r["root"], r["ring_id"]) for r in h.paths.collect()}
    assert paths["c"] == (["a", "b", "c"], 2, "a", None)
    assert paths["o"] == (["o"], 0, "o", None)
    assert paths["z"][0] == ["y", "z"] and paths["z"][3] == "x"
    assert paths["x"] == (["x"], 0, "x", "x") and paths["s"][3] == "s"
    assert pairs(h) == brute({"a": None, "b": "a", "c": "b", "x": "y", "y": "x", "z": "y", "s": "s", "o": None})
    n = {r["key"]: r["n_descendants"] for r in h.summary().collect()}
    assert n["a"] == 2 and n["x"] == 3 and n["c"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_fragments_give_what_brute_force_gives(spark, seed):
    rng = random.Random(seed)
    n = 300
    parent = {f"n{i:03}": (f"n{rng.randrange(n):03}" if rng.random() < 0.05 else f"n{rng.randrange(max(1, i)):03}" if i % 3 else f"n{i - 1:03}" if i else None) for i in range(n)}
    for i in range(100, 160):  # a long chain
        parent[f"n{i:03}"] = f"n{i - 1:03}"
    h = solve(spark, list(parent.items()), fragment_rows=20)
    assert pairs(h) == brute(parent)
    for r in h.paths.filter("ring_id is null").collect():
        assert r["path"][-1] == r["key"] and all(parent[b] == a for a, b in zip(r["path"], r["path"][1:]))


def test_ring_over_fragments(spark):
    n = 60
    parent = {f"r{i:02}": f"r{(i + 1) % n:02}" for i in range(n)} | {f"t{i:02}": f"r{i:02}" for i in range(10)}
    h = solve(spark, list(parent.items()), fragment_rows=7)
    assert h.rings.count() == n
    assert pairs(h) == brute(parent)


def test_empty_and_ties(spark):
    assert solve(spark, []).pairs().count() == 0
    rows = [("c", "b"), ("c", "a"), ("c", "a"), ("a", None), ("b", None), (None, "a")]
    assert [tuple(r) for r in H.conflicts(spark.createDataFrame(rows, "key string, parent string")).collect()] == [("c", "a", "b")]
    assert pairs(solve(spark, [("c", "b"), ("c", "a"), ("a", None), ("b", None)])) == {("a", "c")}


def test_persons_by_alias_and_spelling(spark):
    rows = [(0, ["Ann_Lee", "Old Ann"], None, [" bo-ro "]), (1, ["Bo Ro"], None, None), (2, ["Cy"], "OLD ANN", []), (3, ["Ann_Lee"], "Nobody", None), (4, None, "Cy", None), (5, ["Di", None], "bo ro", [None])]
    m = spark.createDataFrame(rows, "row_no long, names array<string>, teacher string, students array<string>")
    got = {(r["ancestor_key"], r["node_key"]) for r in H.labelled_pairs({"m": H.person_links(m)}).collect()}
    assert got == {("Ann_Lee", "Bo Ro"), ("Ann_Lee", "Cy"), ("Ann_Lee", "Di"), ("Bo Ro", "Di")}


def test_hot_parent_and_deep_chain(spark, monkeypatch):
    monkeypatch.setattr(H, "TOGETHER", 5)
    parent = {"r": None} | {f"k{i:02}": "r" for i in range(80)} | {f"g{i:02}": f"k{i:02}" for i in range(80)} | {f"d{i:03}": f"d{i - 1:03}" if i else "g79" for i in range(150)}
    assert pairs(solve(spark, list(parent.items()), fragment_rows=10)) == brute(parent)


def test_trees_of_equal_keys_stay_apart(spark):
    one = spark.createDataFrame([("a", None, "A"), ("b", "a", "B")], "key string, parent string, label string")
    two = spark.createDataFrame([("b", None, "b"), ("a", "b", "a")], "key string, parent string, label string")
    assert {tuple(r) for r in H.labelled_pairs({"x": one, "y": two}).collect()} == {("x", "A", "B"), ("y", "b", "a")}
