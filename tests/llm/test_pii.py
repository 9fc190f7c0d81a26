import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from logquarry.llm import pii

EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    """The base spans by the patterns as they are written."""
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text("a@.b-+1 2(0)5é", max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1(" * 100_000):
        pii.base_spans(text)


def test_query_and_added_spans(spark, tmp_path):
    texts = [None, "", "x 4111 1111 1111 1111 y a.b@c.example.com 10.0.0.1 +1 (234) 555-7890", "call phone 234-555-7890 or mail joe (at) site (dot) com", "300.1.1.1 4111111111111112", "Ä" * 50 + " 10.0.0.1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (2, texts[2])]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path + "/documents.parquet")
    got = pii.op6_pii(spark, path).collect()
    assert len(got) == len(rows)
    for row in got:
        text = texts[2] if row.doc_id is None else texts[row.doc_id] or ""
        base = [f"{k}:{a}:{b}" for k, a, b in plain(text)]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, row.spans.split(",")))
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone"))


def test_reliabilities():
    import numpy as np

    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.6)], axis=1)
    table, yes = pii.reliabilities(votes, np.ones(4000))
    assert ((yes > 0.5) == truth).mean() > 0.93
    assert table[1, 0, 2] > table[1, 1, 2] > table[1, 2, 2] > 0.5


def test_hidden_addresses_in_any_case():
    for text in ("write jane [AT] example [DOT] com now", "write jane (At) example (dOt) com now", "write jane {aT} example.com now"):
        assert [text[a:b] for kind, a, b, _ in pii.candidates(text) if kind == "email"] == [text[6:-4]]
        assert list(pii.candidates(text)) == list(pii.candidates(text + " (at)"))


def planted(n):
    """Texts with hidden personal data and with look-alikes -> (text, [(kind, start, end, is it real)])."""
    import random

    rng = random.Random(11)
    number = lambda k: "".join(str(rng.randrange(1, 10)) for _ in range(k))
    for i in range(n):
        text, marks = "", []

        def put(words, kind=None, span="", real=True):
            nonlocal text
            text += f"{words} "
            if kind:
                marks.append((kind, len(text), len(text) + len(span), real))
            text += f"{span} " if real else span + rng.choice("xyz") + " "

        put("plain words here then")
        if i % 2:
            put("please write to", "email", f"u{i} {rng.choice(['(at)', '[AT]', '{at}'])} host{number(1)} {rng.choice(['(dot)', '[dot]'])} {rng.choice(['com', 'org', 'net'])}")
            put("from host", "ip", "[.]".join(str(rng.randrange(1, 200)) for _ in range(4)))
        if i % 3:
            put("and call", "phone", f"{number(3)}-{number(3)}-{number(4)}")
            put("paid by visa card", "card", "4" + number(3) + "." + ".".join(number(4) for _ in range(3)))
        if i % 5 == 0:
            put("release build", "phone", f"{number(3)}-{number(3)}-{number(4)}", False)
            put("part", "card", f"9{number(3)}/{number(4)}/{number(4)}/{number(4)}", False)
        put(f"real ones: mail a{i}@b.example.com host 10.1.{i % 200}.7 phone +1 (234) 555-{1000 + i} card 4111 1111 1111 1111")
        yield text, marks


def test_recall_of_added_spans(spark):
    from fixtures import documents

    cases = list(planted(600))
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(cases)])
    weights = pii.train(sorted(map(tuple, pii.vote_counts(docs.select("text")).collect())))
    found = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.find_spans(docs, weights).collect()}
    share = {}
    for kind in pii.KINDS:
        for real in (True, False):
            hits = [m[:3] in found[i] for i, (_, marks) in enumerate(cases) for m in marks if m[0] == kind and m[3] == real]
            if hits:
                share[kind, real] = sum(hits) / len(hits)
    assert all(v >= 0.9 if real else v <= 0.1 for (_, real), v in share.items()), share


def test_empty_table_and_long_text(spark):
    from fixtures import documents

    empty = documents(spark, [])
    assert pii.train(pii.vote_counts(empty.select("text")).collect()) is None and pii.find_spans(empty, None).count() == 0
    text = "word " * 400_000 + "a@b.example.com"
    got = pii.find_spans(documents(spark, [(1, text), (1, text)]), None).collect()
    assert [[tuple(s) for s in r.base] for r in got] == [[("email", 2_000_000, 2_000_015)]] * 2
