"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its subwords: runs of two to four bytes of its
words (A-Z lower-cased, white space as one space at the borders), hashed to BUCKETS
rows. Training takes a bounded sample of labelled documents: at most PER_LANG of each
language, those with the least hashes of their text, of at most LONGEST characters.
Documents and short pieces of them are examples alike. A tenth of the sample sets the
temperature of the softmax and the score below which a prediction counts as rejected.

Only the text is an input of a prediction. Prediction is one pass over whole texts:
the embeddings times the softmax weights are one small table, so a subword costs one
lookup.

Defined results: null texts and texts without a letter are `und` with score 0 and are
not accepted; if there is nothing to learn from, everything is `und`; ties go to the
first language in alphabetical order; repeated rows get equal results; an empty table gives
an empty result. Very long texts are summed span by span, whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import ship

BUCKETS, WIDTH = 1 << 15, 16
SIZES = (2, 3, 4)
PER_LANG, LONGEST, EPOCHS, RATE = 800, 50_000, 6, 0.6
PIECE = 80
#: Share of right held-out predictions that stay accepted.
ACCEPT = 0.995
UND = "und"


def subwords(data: np.ndarray, bounds: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every subword of some texts, rows in order; `bounds` are byte offsets.

    Subwords that lie in the first `known` bytes are left out.
    """
    n = len(data)
    text = tk._LOWER[data]
    space = tk._SPACE[data]
    text = np.where(space, np.uint8(0x20), text).astype(np.uint32)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    buckets, rows = [], []
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            continue
        h = np.full(m, size, np.uint32)
        for j in range(size):
            h = (h ^ text[j : m + j]) * np.uint32(0x01000193)
        ok = row[:m] == row[size - 1 :]
        for j in range(1, size - 1):
            ok &= ~space[j : m + j]
        if size == 2:
            ok &= ~(space[:m] & space[1:])
        ok[: max(0, known - size + 1)] = False
        h ^= h >> np.uint32(15)
        buckets.append((h[ok] % np.uint32(BUCKETS)).astype(np.int32))
        rows.append(row[:m][ok])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(rows)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embeddings times weights, one row per bucket
    bias: np.ndarray
    temperature: float
    least_score: float

    def _sums(self, data: np.ndarray, bounds: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Summed table rows and number of subwords of each text."""
        n = len(bounds) - 1
        bucket, row = subwords(data, bounds, known)
        return np.stack([np.bincount(row, weights=self.table[bucket, c], minlength=n) for c in range(len(self.langs))], axis=1), np.bincount(row, minlength=n)

    def _calibrated(self, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _softmax((sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, one row per text."""
        return self._calibrated(*self._sums(data, bounds))

    def score_long(self, data: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of one text of any length, summed over spans."""
        sums, count, over = np.zeros((1, len(self.langs))), np.zeros(1, np.int64), max(SIZES) - 1
        for a in range(0, len(data), tk.CHUNK_BYTES):
            known = min(a, over)
            part = data[a - known : a + tk.CHUNK_BYTES]
            s, c = self._sums(part, np.array([0, len(part)]), known)
            sums, count = sums + s, count + c
        return self._calibrated(sums, count)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    bucket, _ = subwords(data, np.array([0, len(data)]))
    idx, n = np.unique(bucket, return_counts=True)
    return idx, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fit embeddings and softmax; every tenth text (by order) calibrates."""
    names = sorted(set(langs))
    label = {name: i for i, name in enumerate(names)}
    rng = np.random.default_rng(seed)
    lessons, checks = [], []
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        raw = t.encode()
        at = rng.integers(0, max(1, len(raw) - PIECE), 2)
        examples = [raw] + [raw[a : a + PIECE] for a in at.tolist()] if len(raw) > 2 * PIECE else [raw]
        (checks if i % 10 == 9 else lessons).extend((*_bag(e), label[lang]) for e in examples)
    lessons = [x for x in lessons if len(x[0])]
    weight = np.array([1 / max(1, sum(1 for x in lessons if x[2] == c)) for c in range(len(names))])
    weight *= len(lessons) / len(names)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps, total = 0, max(1, EPOCHS * len(lessons))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(lessons)).tolist():
            idx, share, y = lessons[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            h = share @ emb[idx]
            p = _softmax(h @ out + bias)
            p[y] -= 1
            p *= min(float(weight[y]), 5.0)
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= rate * 0.1 * p
            # Each subword moves as if it alone made the mean; keeps rare ones learnable.
            emb[idx] -= rate * 50 * share[:, None] * back / max(1.0, 50 * float(share.max()))
    model = Model(names, (emb @ out).astype(np.float32), bias, 1.0, 0.0)
    seen = [(share @ model.table[idx] + bias, y) for idx, share, y in checks if len(idx)]
    if seen:
        logits, ys = np.stack([x for x, _ in seen]).astype(np.float64), np.array([y for _, y in seen])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(ys)), ys], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == ys])
        model.least_score = float(right[int((1 - ACCEPT) * len(right))]) if len(right) else 0.0
    return model


def sample(documents: DataFrame, per_lang: int = PER_LANG, longest: int = LONGEST) -> list[tuple[str, str]]:
    """At most about per_lang (text, lang) rows of each language: those with the least text hashes."""
    rows = documents.select("text", "lang").filter("text is not null and lang is not null").filter(F.char_length("text") <= longest)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    # Repeated texts have equal draws, so the share is of texts; the limit holds the bound.
    taken = rows.filter(draw <= share).dropDuplicates(["text", "lang"]).orderBy(F.xxhash64("text")).limit(per_lang * len(counts))
    return sorted((r["text"], r["lang"]) for r in taken.collect())


def fit(documents: DataFrame, per_lang: int = PER_LANG, longest: int = LONGEST) -> Model | None:
    """A model from the labelled rows (text, lang) of a table; None if there are none."""
    rows = sample(documents, per_lang, longest)
    order = np.random.default_rng(3).permutation(len(rows)).tolist()
    return train([rows[i][0] for i in order], [rows[i][1] for i in order]) if rows else None


def _predicting(shared):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            data, offsets = tk.string_buffers(b.column("text"))
            for lo, hi in tk.row_chunks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                p = model.score_long(part) if tk.is_long(offsets, lo, hi) else model.scores(part, offsets[lo : hi + 1] - offsets[lo])
                best = p.argmax(axis=1)
                letters = b.column("letters").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                score = np.where(letters, p[np.arange(len(p)), best], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, hi - lo),
                        pa.array([model.langs[k] if ok else UND for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(letters & (score >= model.least_score)),
                    ],
                    names=["doc_id", "lang_pred", "score", "accepted"],
                )

    return run


def predict(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    docs = docs.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.mapInArrow(_predicting(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, accepted boolean")
