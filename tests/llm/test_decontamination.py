import random

from fixtures import documents, words
from logquarry.llm.decontamination import find_copies


def test_copies(spark):
    rng = random.Random(3)
    items = [(k, " ".join(words(1000 + k, 40, 5000))) for k in range(6)] + [(6, None), (7, ""), (8, "too short"), (9, " ".join(words(1000, 40, 5000)))]
    fill = lambda s: " ".join(words(s, 200, 3000))
    edit = lambda t: " ".join(w if rng.random() > 0.12 else "zzz" for w in t.split())
    rows = [(0, f"{fill(1)} {items[0][1].upper()} {fill(2)}"), (1, f"{fill(3)}\n{edit(items[1][1])}\n{fill(4)}"), (2, fill(5)), (3, None), (4, ""), (None, items[2][1]), (5, items[3][1].replace(" ", ", ")), (5, items[3][1]), (6, " ".join(items[4][1].split()[:12]) + " " + fill(6)), (7, " ".join([items[5][1]] * 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, tuple(c.item_id for c in r.copies)) for r in find_copies(documents(spark, rows), bench).select("row.doc_id", "copies").collect()), key=repr)
    assert got == sorted([(0, (0, 9)), (1, (1,)), (2, ()), (3, ()), (4, ()), (None, (2,)), (5, (3,)), (5, (3,)), (6, ()), (7, (5,))], key=repr)
    exact = [c for r in find_copies(documents(spark, rows[:1]), bench).collect() for c in r.copies if c.item_id == 0][0]
    assert (exact.score, exact["first"], exact["last"]) == (1.0, 200, 239)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_copies(documents(spark, []), none).count() == 0
    assert [r.copies for r in find_copies(documents(spark, [(1, "a b c d e f")]), none).collect()] == [[]]


def test_edited_copies_in_any_number(spark):
    item = words(77, 40, 5000)
    edited = " ".join("zzz" if k % 5 == 2 else w for k, w in enumerate(item))  # 8 words changed: 32 - 4 = 28 of 40
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for n in (1, 5, 1000):
        docs = documents(spark, [(k, f"{' '.join(words(k, 20, 3000))} {edited}") for k in range(n)])
        got = [[(c.item_id, c.score) for c in r.copies] for r in find_copies(docs, bench).select("copies").collect()]
        assert got == [[(1, 0.7)]] * n
