import random
import re
from collections import Counter

import pytest
from fixtures import CLASHING
from logquarry.llm import phrase_mining
from logquarry.llm.phrase_mining import collocations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        found = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                found.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p, n in f.items() if len(p) > 1 and n >= least]
        longest = {}
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest.get(p[i : i + k], 0), f[p])
        scored = []
        for p in candidates:
            a = f[p]
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if 100 * longest.get(p, 0) < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def table_of(spark, rows):
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    for c in [*CLASHING.split(", "), "phrase string", "word string", "n_words int"]:
        if c.split()[0] not in docs.columns:
            docs = docs.selectExpr("*", f"CAST(7 AS {c.split()[1]}) AS {c.split()[0]}")
    return docs


def rows_of(seed, n):
    rng = random.Random(seed)
    pool = ["The", "of", "and", "é", "ß", "|", "Ä-b", "x1", "new", "york", "city", "rare"]
    def text():
        return "".join(rng.choices(pool, [30, 20, 10, 5, 5, 4, 3, 2, 8, 8, 8, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(60)))

    rows = [(rng.choice(["en", "en", "de", None]), text()) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("fr", " \n.\t"), ("en", "the the the the the the"), ("en", "the the the the the the"), ("de", "new york city " * 50)]


@pytest.mark.parametrize(("group", "flush", "bits"), [(1 << 17, 1 << 21, 22), (8, 300, 22), (200, 5000, 6)])
def test_against_brute_force(spark, monkeypatch, group, flush, bits):
    """With all in one flush; with pivots dealt by n-gram and many flushes; with words that share places of the table."""
    monkeypatch.setattr(phrase_mining, "GROUP", group)
    monkeypatch.setattr(phrase_mining, "FLUSH_WORDS", flush)
    rows = rows_of(3, 300)
    got = collocations(table_of(spark, rows), min_count=5, top=60, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 60)


def test_rare_phrases_and_empty_table(spark):
    rows = rows_of(4, 20)
    got = collocations(table_of(spark, rows), min_count=2, top=10).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 10)
    assert collocations(table_of(spark, [])).count() == 0


def test_long_text(spark):
    rng = random.Random(1)
    rows = [("en", " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(200_000)))]
    got = collocations(table_of(spark, rows), top=100).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 30, 100)


def test_only_pairs_that_are_frequent_are_grown():
    """Counted n-grams equal those without cutting; fragments whose pairs are all rare cost no n-gram."""
    rng = random.Random(2)
    lines = []
    for _ in range(3000):
        at, n = rng.randrange(4), rng.randrange(4)
        words = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(at)] + ["p"] + [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(n)]
        lines.append((rng.randrange(1, 4), at, words))
    want, pivot = Counter(), phrase_mining.Pivot()
    for times, at, words in lines:
        pivot.add(f"{times} {at} {' '.join(words)}\n")
        for s in range(at + 1):
            for e in range(at + 1, len(words) + 1):
                if 2 <= e - s <= 4:
                    want[" ".join(words[s:e])] += times
    pivot.add("7 - p q\n5 - p q\n")
    want["p q"] += 12
    assert dict(pivot.frequent(10)) == {p: n for p, n in want.items() if n >= 10}
    assert len(pivot.counts) < len(want)
    rare = phrase_mining.Pivot()
    for k in range(50):
        rare.add(f"9 2 a{k} b{k} p c{k} d{k}\n")
    assert not rare.frequent(10) and not rare.counts
