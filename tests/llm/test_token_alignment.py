import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents
from logquarry.llm import token_alignment
from logquarry.llm.token_alignment import Alignment, Bits, align, sides

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello  world, naïve café", "<|endoftext|></s><unk> x", "a▁b", "中文 \U0001f600\U0001f600 é́\x00\x01", "the the the", "x" * 300, "Und enen gech chachß ieü auf unglich\n\n\tberach", "the cat of the hat", "the cat of the hat", "1234567 3.14 !!!??"]


def tokens(text):
    """[(id, start, stop)] of both sides, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    data = (" " + text).encode()
    bpe = Tokenizer.from_file(A)
    bpe.encode_special_tokens = True
    letters = {c: k for k, c in enumerate(token_alignment.byte_letters())}
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    first = [(i, bytes(letters[c] for c in bpe.id_to_token(i))) for i in bpe.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    out = []
    for side in (first, second):
        if b"".join(b for _, b in side) != data:
            return [], []
        at, spans = 0, []
        for i, b in side:
            spans.append((i, at, at + len(b)))
            at += len(b)
        out.append(spans)
    return out


def brute(rows):
    """Overlaps by comparing all spans of a text, cuts by sets of offsets."""
    spans = [tokens(t) if t else ([], []) for _, t in rows]
    links = [[(a[0], b[0]) for a in x for b in y if a[1] < b[2] and b[1] < a[2]] for x, y in spans]
    count = Counter(p for found in links for p in set(found))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), (x, y), found in zip(rows, spans, links, strict=True):
        cuts = sorted({s[2] for s in x} & {s[2] for s in y})
        groups = [",".join(str(s[0]) for s in x if lo < s[2] <= hi) + "|" + ",".join(str(s[0]) for s in y if lo < s[2] <= hi) for lo, hi in zip([0, *cuts], cuts)]
        out.append((i, len(x), len(y), len(cuts), len(found), sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found), ";".join(groups)))
    return sorted(out, key=repr)


def got(docs, **options):
    rows = align(docs, A, B, whole=True, **options).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_against_brute_force(spark, monkeypatch, block_rows):
    rng = random.Random(5)
    rows = [*enumerate(TEXTS), (None, "no id"), (3, TEXTS[3]), (3, "other text")]
    rows += [(100 + k, "".join(rng.choice("ab é\n ß中.the ") for _ in range(rng.randrange(1, 90)))) for k in range(40)]
    docs = documents(spark, rows).coalesce(1) if block_rows == 2 else documents(spark, rows)
    if block_rows == 2:  # blocks smaller than a partition
        monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 100)
    assert got(docs) == brute(rows)


def test_digests_and_empty_table(spark):
    import hashlib

    rows = list(enumerate(TEXTS))
    digests = {r.doc_id: r.groups for r in align(documents(spark, rows), A, B).collect()}
    assert digests == {r[0]: hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "" for r in brute(rows)}
    assert align(documents(spark, []), A, B).count() == 0


def test_long_text(spark):
    text = "The quick brown fox, 12 naïve façades. " * 6000
    a, b = sides(A, B)
    found = Alignment([text, "the", None, text], a, b)
    assert found.groups()[0] == found.groups()[3] and found.groups()[2] == ""
    doc, pair = found.links()
    assert len(pair) == found.per_doc(found.either).sum() and set(doc.tolist()) == {0, 1, 3}


def test_ranks_as_the_library():
    """The ids of A by ranks are the library's, for characters of all kinds and for long runs."""
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(A), sides(A, B)[0], random.Random(9)
    library.encode_special_tokens = True
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)} \n{chr(c)}!" for c in [*range(0x3100), *range(0x1F300, 0x1F700)]] + ["ab" * 20_000, "é中" * 5000, " " * 3000 + "x", "don't I'LL <|endoftext|>"]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD7FF)))) for _ in range(60)) for _ in range(300)]
    assert own.encode(texts) == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(n) < 0.3)
        bits = Bits.at(places, n)
        assert bits.select().tolist() == places.tolist()
        at = np.arange(n + 1)
        assert bits.rank(at).tolist() == [int((places < k).sum()) for k in at]
