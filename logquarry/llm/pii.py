"""Personal data: weak labelers vote on spans, EM estimates how far each can be trusted, a span classifier decides.

Base spans come from fixed patterns and always stay. Loose patterns propose more. On every candidate four labelers vote
yes, no or nothing: pattern (does it pass the strict checks), gazetteer (known endings, prefixes, ranges), context (the
words before it) and shape (what borders it). The candidates of all documents are counted by votes and features, a table
whose size doesn't grow; EM over the votes gives each labeler's reliability per kind and soft labels, on which a logistic
classifier is trained. It also sees what no labeler reads: the span's length, what joins its parts, the word after it and
how many digits stand around it. Candidates that it accepts and that touch no base span of their kind are added.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
#: The classifier adds a span from this probability.
ACCEPT = 0.9
#: Features of a span and how many values each has: length, signs between its parts, hash of the next word, digits around it.
FEATURES = {"length": 8, "signs": 8, "after": 8, "digits": 2}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search
_WORD = re.compile(r"[^\W\d_]+").search

LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z]{2,24}\b", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
HINTS = {"email": re.compile(r"[(\[{]at[)\]}]", re.I).search, "ip": re.compile(r"\[\.\]|\(\.\)").search}
WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "client"),
    "card": ("card", "visa", "credit", "debit", "tarjeta", "carte", "karte", "iban"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "telefon", "teléfono", "téléphone"),
}
ENDINGS = frozenset("com org net edu gov io info biz eu uk de fr es it us ca au jp cn in br ru ch at nl be se no fi dk pl example test local".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, from each @ outwards (a scan from the left is quadratic on long runs)."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def checked(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, does it pass) of the strict patterns' matches, by kind and start."""
    for start, end in emails(text):
        yield "email", start, end, True
    if not _DIGIT(text):
        return
    for m in _IP(text):
        yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m[0])
            yield "card", *m.span(), 13 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE(text):
            yield "phone", *m.span(), 9 <= len(digits_of(m[0])) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k, a, b, ok in checked(text or "") if ok]


def gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[.\s)\]]+", span.lower())[-1] in ENDINGS else 0
    d = digits_of(span)
    if kind == "ip":
        first = int(re.split(r"[^0-9]+", span)[0] or 0)
        return 1 if 0 < first < 224 else -1
    if kind == "card":
        return 1 if d[:1] in "3456" else -1
    return -1 if len(set(d)) < 3 else 1 if span.startswith(("+", "00", "(")) else 0


def context(kind: str, before: str) -> int:
    before = before.lower()
    if any(re.search(rf"\b{re.escape(w)}\b", before) for w in WORDS[kind]):
        return 1
    return -1 if any(re.search(rf"\b{re.escape(w)}\b", before) for k in KINDS if k != kind for w in WORDS[k]) else 0


def traits(text: str, a: int, b: int) -> tuple[int, ...]:
    """The values of FEATURES of a span."""
    span, after = text[a:b], text[b : b + 24]
    signs = (" " in span) + 2 * any(c in span for c in "()[]{}") + 4 * any(c in span for c in "-./_")
    word = _WORD(after)
    around = sum("0" <= c <= "9" for c in text[max(0, a - 24) : a] + after)
    return min(7, (b - a) // 4), signs, zlib.crc32(word[0].lower().encode()) % 8 if word else 0, int(around >= 6)


def candidates(text: str) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, four votes and the FEATURES) of the strict and the loose patterns' matches."""
    found = [(k, a, b, 1 if ok else -1) for k, a, b, ok in checked(text)]
    has_digit = bool(_DIGIT(text))
    for kind, pattern in LOOSE.items():
        if (kind == "email" or has_digit) and (kind not in HINTS or HINTS[kind](text)):
            found += [(kind, *m.span(), 0) for m in pattern.finditer(text)]
    for kind, a, b, strict in found:
        left, right = text[a - 1 : a], text[b : b + 1]
        shape = -1 if left.isalnum() or right.isalnum() else 1 if not left.strip(" \n(<,;:") and not right.strip(" \n)>,;:.") else 0
        yield kind, a, b, (strict, gazetteer(kind, text[a:b]), context(kind, text[max(0, a - 24) : a]), shape, *traits(text, a, b))


def vote_counts(docs: DataFrame) -> DataFrame:
    """(kind, votes..., features..., n) over all documents: at most 4 * 3 ** 4 * 1024 rows, summed in each task first."""
    names = ["kind", "v0", "v1", "v2", "v3", *FEATURES]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for kind, _, _, row in candidates(text.as_py() or ""):
                    seen[kind, *row] = seen.get((kind, *row), 0) + 1
        if seen:
            kinds, *rows = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *[pa.array(r, pa.int32()) for r in rows], pa.array(list(seen.values()), pa.int64())], [*names, "n"])

    fields = ", ".join(f"{name} int" for name in names[1:])
    return docs.mapInArrow(count, f"kind string, {fields}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and labelers that are independent given the class. -> (P(vote | class) as class x labeler x 3, P(yes) of each row)."""
    yes = 1 / (1 + np.exp(-votes.sum(axis=1)))  # the majority to begin with
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for c, p in enumerate((1 - yes, yes)):
            for j in range(votes.shape[1]):
                table[c, j] = np.bincount(votes[:, j] + 1, n * p, 3) + (0.5, 0.5, 0.5)
            table[c] /= table[c].sum(axis=1, keepdims=True)
        prior = ((n * yes).sum() + 1) / (n.sum() + 2)
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[1, j][votes[:, j] + 1] / table[0, j][votes[:, j] + 1]) for j in range(votes.shape[1]))
        yes = 1 / (1 + np.exp(-odds))
    return table, yes


def features(kind: str, row: tuple[int, ...]) -> np.ndarray:
    """The classifier's input: kind, votes, and each of the FEATURES by kind."""
    width, k = sum(FEATURES.values()), KINDS.index(kind)
    x = np.zeros(4 + 12 + 4 * width)
    x[k] = 1
    for j, v in enumerate(row[:4]):
        x[4 + 3 * j + v + 1] = 1
    at = 16 + k * width
    for size, v in zip(FEATURES.values(), row[4:], strict=True):
        x[at + v] = 1
        at += size
    return x


def train(rows: list[tuple]) -> np.ndarray | None:
    """Weights of the span classifier from the counts; none where nothing was proposed."""
    if not rows:
        return None
    x, y, weight = [], [], []
    for kind in KINDS:
        own = [r for r in rows if r[0] == kind]
        if own:
            votes, n = np.array([r[1:5] for r in own]), np.array([r[-1] for r in own], float)
            _, yes = reliabilities(votes, n)
            x += [features(kind, r[1:-1]) for r in own]
            y += list(yes)
            weight += list(n / n.sum())
    x, y, weight = np.array(x), np.array(y), np.array(weight)
    rate = 1 / (0.25 * np.linalg.eigvalsh(x.T @ (weight[:, None] * x))[-1] + 1e-4)
    w = ahead = np.zeros(x.shape[1])
    for step in range(1000):  # accelerated gradient descent
        p = 1 / (1 + np.exp(-x @ ahead))
        new = ahead - rate * (x.T @ (weight * (p - y)) + 1e-4 * ahead)
        w, ahead = new, new + step / (step + 3) * (new - w)
    return w


def spans_of(text: str | None, weights: np.ndarray | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    spans = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}  # apart from each other and in order
    if weights is not None:
        for kind, a, b, row in candidates(text):
            if row[0] == 0 and 1 / (1 + np.exp(-features(kind, row) @ weights)) >= ACCEPT:
                k = bisect_left(spans[kind], (b,))
                if not k or spans[kind][k - 1][1] <= a:
                    spans[kind].insert(k, (a, b))
    return base, [(kind, a, b) for kind in KINDS for a, b in spans[kind]]


def find_spans(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, base and spans, arrays of struct<kind, start, end> (code points, end exclusive).

    Null and empty texts have none; repeated rows give repeated results, an empty table an empty one; texts of any length
    are read whole; other columns aren't read. No shuffle.
    """
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans_of(t.as_py(), weights) for t in batch.column(1)]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in both], struct) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    array = "array<struct<kind:string,start:bigint,end:bigint>>"
    return kept.mapInArrow(find, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, base {array}, spans {array}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = train(sorted(map(tuple, vote_counts(docs.select("text")).collect())))
    found = find_spans(docs, weights)
    joined = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
