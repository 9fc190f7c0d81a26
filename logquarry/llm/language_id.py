"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy, with calibrated rejection.

Subwords are the runs of 2 to 4 bytes of the lower-cased text without ASCII digits and signs, each hashed to one of
BUCKETS embeddings. Training sees a bounded, documented sample of labelled rows on the driver; since the model is
linear, embedding and softmax weights fold into one small table (BUCKETS x languages) for prediction over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

BUCKETS, WIDTH = 1 << 15, 16
#: Labelled rows that training sees at most, and the most characters of them in all.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000_000
#: A calibrated probability below this rejects the document.
REJECT_BELOW = 0.5
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}").search
_SPACES = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_SIGNS = bytes(b for b in range(128) if not (97 <= b <= 122 or b in (9, 10, 11, 12, 13, 32)))


#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 18


def stretches(text: str) -> Iterator[np.ndarray]:
    """The buckets of all subwords of the text, a stretch at a time, so that a long text needs little more than itself."""
    whole = (" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_SPACES, _SIGNS)
    for start in range(0, max(1, len(whole) - 1), STRETCH):
        b = np.frombuffer(whole[start : start + STRETCH + 3], np.uint8).astype(np.uint32)
        first, h = min(STRETCH, len(b)), b  # subwords that begin in the stretch
        for _ in range(3):
            h = h[:-1] * np.uint32(0x01000193) + b[len(b) - len(h) + 1 :]
            yield ((h[:first] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)


def subwords(text: str) -> np.ndarray:
    """The bucket of every subword of the text."""
    return np.concatenate(list(stretches(text)))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times weights
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for ids in stretches(text):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 12, rate: float = 20.0, batch: int = 16, seed: int = 7) -> Model:
    """SGD over (text, lang) rows, each language weighing the same; a fifth of the rows fits the temperature."""
    rows = [(t, y) for t, y in rows if _LETTER(t)]
    languages = sorted({y for _, y in rows})
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    index = {y: i for i, y in enumerate(languages)}
    rng = np.random.default_rng(seed)
    found = []
    for text, y in rows:
        ids, n = np.unique(subwords(text), return_counts=True)
        found.append((ids, (n / n.sum()).astype(np.float32), index[y]))
    order = rng.permutation(len(found))
    held = order[: len(found) // 5] if len(found) >= 50 else order
    learn = order[len(found) // 5 :] if len(found) >= 50 else order
    weight = np.array([1.0 / max(1, sum(found[i][2] == c for i in learn)) for c in range(k)])
    weight *= len(learn) / k
    e = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((WIDTH, k)) * 0.3).astype(np.float32)
    bias = np.zeros(k, np.float32)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        learn = rng.permutation(learn)
        for start in range(0, len(learn), batch):
            part = [found[i] for i in learn[start : start + batch]]
            ids, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            at = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            starts = np.cumsum([0, *[len(p[0]) for p in part[:-1]]])
            mean = np.add.reduceat(e[ids] * x[:, None], starts, axis=0)
            y = np.array([p[2] for p in part])
            g = softmax(mean @ w + bias)
            g[np.arange(len(part)), y] -= 1
            g *= (weight[y] / len(part))[:, None]
            back = (g @ w.T).astype(np.float32)
            w -= (0.02 * step * mean.T @ g).astype(np.float32)
            bias -= (0.005 * step * g.sum(axis=0)).astype(np.float32)
            np.subtract.at(e, ids, step * back[at] * x[:, None])
    model = Model(languages, (e @ w).astype(np.float32), bias.astype(np.float64))
    raw = np.array([model.table[found[i][0]].T @ found[i][1] + bias for i in held])
    y = np.array([found[i][2] for i in held])
    grid = np.geomspace(0.05, 20, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean()))
    return model


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id isn't held out, nor is it learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most `rows` labelled rows, and `chars` characters, that aren't held out: those of smallest id hash, each whole."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang", F.xxhash64("doc_id").alias("h"))
    n = labelled.count()
    if n > rows:
        labelled = labelled.where(F.col("h").cast("double") < -(2.0**63) + 2.0**64 * min(1.0, 1.2 * rows / n))
    chosen = labelled.orderBy("h", "text", "lang").limit(rows)
    before = Window.orderBy("h", "text", "lang").rowsBetween(Window.unboundedPreceding, 0)  # over `rows` rows at most
    bounded = chosen.withColumn("chars", F.sum(F.length("text")).over(before)).where(F.col("chars") <= chars)
    return [(row.text, row.lang) for row in bounded.select("text", "lang").collect()]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of docs as `row` (struct of all its columns), with lang_pred, score and rejected. No shuffle.

    Null text, text without a letter, and any text under a model without languages: `und`, score 0, rejected. Of languages
    that tie the first by name is taken. Repeated rows give repeated results, an empty table an empty one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < REJECT_BELOW for _, s in found], pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(sample(docs))
    return identify(docs.select("doc_id", "text"), model).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
