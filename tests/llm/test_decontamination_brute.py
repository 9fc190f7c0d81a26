"""Decontamination held against Smith-Waterman over every document and every item of a small table."""

import random

from fixtures import documents, words
from logquarry.llm.decontamination import DIFFER, LEAST_SCORE, MISSING, SHARE, find_copies


def best_score(item, text):
    """The textbook recurrence, cell by cell."""
    above, best = [0.0] * (len(text) + 1), 0.0
    for w in item:
        here = [0.0]
        for j, v in enumerate(text):
            here.append(max(0.0, above[j] + (1.0 if v == w else -DIFFER), above[j + 1] - MISSING, here[j] - MISSING))
        best, above = max(best, max(here)), here
    return best


def edited(rng, item, share):
    out = []
    for w in item:
        if rng.random() >= share:
            out.append(w)
        elif rng.random() < 0.6:
            out.append(f"z{rng.randrange(900)}")
        elif rng.random() < 0.5:
            out += [w, f"z{rng.randrange(900)}"]
    return out


def test_against_all_pairs(spark):
    rng = random.Random(5)
    items = [words(300 + k, rng.choice([6, 9, 15, 30, 60]), 4000) for k in range(12)]
    texts = [words(k, 60, 4000) for k in range(20)]
    for k in range(60):
        fill = words(500 + k, 40, 4000)
        at = rng.randrange(len(fill))
        texts.append(fill[:at] + edited(rng, items[k % 12], (k // 12) * 0.08) + fill[at:])
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    rows = find_copies(documents(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]), bench).select("row.doc_id", "copies").collect()
    found = {(r.doc_id, c.item_id): c.score for r in rows for c in r.copies}
    expected = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            score = best_score(item, text)
            if score >= max(SHARE * len(item), min(LEAST_SCORE, len(item))):
                expected[d, i] = score / len(item)
    assert len(expected) >= 40 and set(found) <= set(expected)
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert set(found) == set(expected)


def test_every_nth_word_changed(spark):
    """Down to the least score; items of words that few or many items hold, and of one word."""
    rows, items = [], []
    for k, (n, size) in enumerate([(30, 4000), (30, 12), (60, 4000), (31, 30), (12, 4000), (9, 4000), (16, 50)]):
        items.append(words(700 + k, n, size))
    items += [["ha"] * 10, ["la"] * 5, ["la", "lu"] * 15]
    for item in items:
        for step in (0, 2, 3, 4, 7):
            copy = [f"z{j}" if step and j % step == step - 1 else w for j, w in enumerate(item)]
            rows.append(words(len(rows), 30, 4000) + copy + words(900 + len(rows), 30, 4000))
            rows.append([w for w in copy if w[0] != "z"])
        rows.append(words(len(rows), 30, 4000) + item[: len(item) // 2] + words(900 + len(rows), 30, 4000))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, c.item_id): c.score for r in find_copies(documents(spark, [(k, " ".join(t)) for k, t in enumerate(rows)]), bench).select("row.doc_id", "copies").collect() for c in r.copies}
    expected = {(d, i): score / len(item) for d, text in enumerate(rows) for i, item in enumerate(items) if (score := best_score(item, text)) >= max(SHARE * len(item), min(LEAST_SCORE, len(item)))}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_very_long_document(spark):
    item = words(41, 40, 4000)
    text = " ".join([*words(42, 300_000, 3000), *item, *words(43, 1000, 3000)])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    copies = find_copies(documents(spark, [(1, text)]), bench).collect()[0].copies
    assert [(c.item_id, c.score, c["first"], c["last"]) for c in copies] == [(1, 1.0, 300_000, 300_039)]
