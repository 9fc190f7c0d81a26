import random

import numpy as np
from fixtures import documents, words
from logquarry.llm import jaccard_join as jj
from logquarry.llm.components import components


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    top = {i: i for i, _ in sets if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
    return " ".join(w)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "LIST", 4)  # salts already on small lists
    rng = random.Random(5)
    passage = " ".join(words(999, 40))
    rows = [(100 + i, passage + " " + " ".join(words(i, 30))) for i in range(40)]  # a shared passage that makes no copies
    base = [" ".join(words(500 + k, 120)) for k in range(6)]
    rows += [(300 + i, edited(base[i % 6], rng, i % 7)) for i in range(70)]  # groups on both sides of the threshold
    rows += [(500, base[0]), (501, base[0].upper()), (502, None), (503, ""), (504, " \n"), (505, "one two"), (506, "One  two"), (507, "one two three"), (None, base[1]), (508, " ".join(words(7, 8000))), (509, " ".join(words(7, 8000)[:7000]))]
    rows += [(500, base[0]), (510, "a a a a a a a a"), (511, "a a a a a")]
    got = [tuple(r) for r in jj.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_long_lists(spark, monkeypatch):
    """A large group of near copies most of which are out of each other's reach, truncated ones, families that share a passage."""
    monkeypatch.setattr(jj, "SHORT", 8)
    monkeypatch.setattr(jj, "FILL", 4000)  # several blocks
    rng = random.Random(2)
    base = " ".join(words(1, 150, 5000))
    rows = [(k, edited(base, rng, rng.randrange(1, 14))) for k in range(150)]
    rows += [(200 + k, " ".join(base.split()[: 150 - rng.randrange(40)])) for k in range(60)]
    rows += [(300 + k, edited(rows[3][1], rng, rng.randrange(0, 5))) for k in range(50)]
    passage = " ".join(words(999, 40))
    rows += [(400 + k, passage + " " + " ".join(words(k % 40 + 50, 12, 9000)) + (" z" if k % 3 else "")) for k in range(90)]
    rows += [(7, rows[-1][1]), (8, "other words of a row that repeats an id")]
    got = [tuple(r) for r in jj.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert jj.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (500, 400)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100, 400: 400, 500: 400}


def test_blocks_of_many_short_sets_take_bounded_memory():
    """Rows of one template: as many sets as a block may hold, linked as comparing all pairs says, in little memory."""
    import tracemalloc

    rng = np.random.default_rng(1)
    common = np.sort(rng.integers(1, 1 << 62, 4, dtype=np.uint64))
    sets = [np.sort(np.append(common, np.uint64(k + 5))) for k in range(jj.SETS)]
    sets[7] = sets[1300]
    tracemalloc.start()
    found = jj.block_links(sets[: len(sets) // 2], sets[len(sets) // 2 :], 80)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert found == [(7, 1300)]
    assert len(jj.block_links(sets, [], 60)) == len(sets) - 1
