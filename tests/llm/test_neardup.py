"""Near-duplicates against brute force over full shingle sets."""

import random

import numpy as np

from kestrel.llm import neardup as N
from kestrel.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in sets if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def variants(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 6, 12, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 8, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
            rows.append((len(rows), text.upper() if rng.random() < .2 else text))
    return rows


def got(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=str)


def test_components_match_brute_force(make):
    rows = variants(1, 60)
    out = N.near_duplicates(make(rows))
    assert got(out) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_large_near_copy_group_with_unlinked_members(make):
    """One base text, many copies with so many edits that some reach the threshold only through others."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((k, " ".join(w)))
    assert got(N.near_duplicates(make(rows))) == brute(rows)


def test_odd_rows(odd, none):
    out = {(r["doc_id"], r["n_shingles"]): r for r in N.near_duplicates(odd).collect()}
    assert out[(1, 0)]["component_id"] == 1 and out[(2, 0)]["kept"] and out[(3, 0)]["component_id"] == 3
    assert out[(None, 3)]["component_id"] is None and out[(None, 3)]["kept"]
    assert out[(8, 3)]["component_id"] == 7 and not out[(8, 3)]["kept"]
    assert N.near_duplicates(odd).count() == odd.count()
    assert N.near_duplicates(none).collect() == [] and N.keep_one(none).columns == none.columns


def test_keep_one_leaves_one_row_a_group(odd):
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, None, 4, 5, 6, 7], key=str)


def test_keep_one_keeps_every_row_without_an_id(make):
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    rows = [(None, a), (None, b), (None, b), (1, a), (2, "short"), (2, "other text"), (2, None)]
    kept = [sorted(((r["doc_id"], r["text"]) for r in N.keep_one(make(x).repartition(n)).collect()), key=str)
            for x, n in ((rows, 1), (rows[::-1], 3))]
    assert [t for i, t in kept[0] if i is None] == [a, b, b]
    assert sorted(i for i, _ in kept[0] if i is not None) == [1, 2]
    assert kept[0] == kept[1]  # the same row of a repeated id in any order of the input


def test_an_id_with_several_texts_is_one_node(make):
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    out = {(r["doc_id"], r["component_id"]) for r in N.near_duplicates(make([(3, a), (3, b), (1, a), (9, b)])).collect()}
    assert out == {(3, 1), (1, 1), (9, 1)}


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 1 << 63, 900, np.uint64), rng.integers(0, 1 << 63, 300, np.uint64)
    a, b = np.unique(common), np.unique(np.concatenate([common[:600], own]))
    r = N.registers([a, b])
    equal = (r[0] == r[1]).mean()
    chance = N.chance(np.array([900.0]), np.array([900.0]))[0]
    assert abs((equal - chance) / (1 - chance) - 0.5) < 0.15 and 0 < chance < 1e-2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    out = dict(components(edges).collect())
    assert set(out) == set(range(201)) | {900, 901} and {out[k] for k in range(201)} == {0} and out[901] == 900


def test_components_of_paths_stars_and_random_graphs(spark):
    import random

    from kestrel.llm.components import components
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 40)] + [(700, 700), (801, 800)]
    edges += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for a, b in edges:
        if a != b:
            top[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_with_a_dotted_column(spark):
    from kestrel.llm.neardup import keep_one
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y")], "doc_id long, text string, `a.b` string")
    assert [(r["doc_id"], r["a.b"]) for r in keep_one(docs).collect()] == [(1, "x")]
