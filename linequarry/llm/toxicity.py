"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels.

A sentence is the set of its words (A-Z lower-cased, all ASCII punctuation trimmed off
both ends) and of the first 5, 6 and 7 bytes of longer ones, so that forms of an offending
stem that no label showed are known too. Its score is a logistic function of word weights, p_s; a document is toxic with probability
1 - prod(1 - p_s): one offending sentence is enough. The gradient of the document's
label reaches the sentences through the noisy-or, so the model learns which sentences
(and words) made documents toxic, and can point them out.

Training takes a bounded sample of labelled documents: at most PER_LABEL of each label,
by least text hash, of at most LONGEST characters, weighted to the labels' true shares.
A word counts if LEAST sampled documents have it and toxic ones have it so much more
often that its G statistic passes SURE. Document scores are calibrated (Platt scaling) on
folds of the sample that a model of the other folds has not seen: as many folds as show
CALIBRATE toxic texts, at most all; the words themselves are learned from the whole sample.

Only the text is an input of a score. Defined results: null and empty texts have no
sentences and get the score of an empty document; if there is nothing to learn from, or
one label only, the score is the share of toxic labels (0 without labels); repeated
rows get equal scores; of two labels for one id the toxic one counts; of sentences that
offend equally the last is named; an empty table gives an empty result. Very long texts
are scored whole, in spans whose sentences are joined again. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import broadcast_if_small, ship, staged

#: Bytes of the beginnings of words that are features beside the whole words.
PREFIXES = (5, 6, 7)
PER_LABEL, LONGEST, LEAST, SURE = 6000, 50_000, 3, 8.0
#: Calibration: folds, and toxic texts that are enough for it.
FOLDS, CALIBRATE = 5, 200
EPOCHS, RATE, DECAY, START = 8, 0.5, 1e-4, -6.0
ID_BROADCAST = 64 << 20

_TRIM = np.zeros(256, dtype=bool)
_TRIM[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


class Sentences:
    """Words of some texts by sentence: word hashes, sentence of each word, text of each sentence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        words = tk.Words(data, offsets, lo, hi, lower=True)
        n = len(words.start)
        self.n_texts = hi - lo
        last = words.data[words.end - 1] if n else np.zeros(0, np.uint8)
        lines = np.cumsum(np.concatenate([[0], words.data == 0x0A]))
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = _STOP[last[:-1]] | (lines[words.start[1:]] > lines[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
        self.sentence = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.text_of = words.doc[heads]
        # Byte span of each sentence inside its text.
        tails = np.append(heads[1:], n) - 1 if n else heads
        base = (offsets[lo:hi] - offsets[lo])[self.text_of] if n else np.zeros(0, np.int64)
        self.begin, self.stop = words.start[heads] - base, (words.end[tails] - base if n else heads)
        self.closed = bool(n) and bool(_STOP[last[-1]])
        self.edges = (int(words.start[0]), int(words.end[-1])) if n else None
        if n:
            # All marks go, up to the last byte of a word that has nothing else.
            inner = np.flatnonzero(~_TRIM[words.data])
            ahead = np.append(inner, len(words.data))[np.searchsorted(inner, words.start)]
            words.start = np.minimum(ahead, words.end - 1)
            behind = np.concatenate([[-1], inner])[np.searchsorted(inner, words.end)]
            words.end = np.maximum(behind + 1, words.start + 1)
        known, sentence = [words.hashes()], [self.sentence]
        size = words.end - words.start
        text = np.append(words.data, np.zeros(max(PREFIXES), np.uint8)).astype(np.uint64) if n else words.data
        head = np.zeros(n, np.uint64)
        for k in range(max(PREFIXES) if n else 0):
            head |= text[words.start + k] << np.uint64(8 * k)
            if k + 1 in PREFIXES:
                longer = size > k + 1
                known.append(tk.mix(head[longer] ^ np.uint64((k + 1) << 58)))
                sentence.append(self.sentence[longer])
        self.words, self.sentence = np.concatenate(known), np.concatenate(sentence)


@dataclass
class Model:
    vocabulary: np.ndarray  # word hashes, rising
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def pairs(self, s: Sentences) -> np.ndarray:
        """Sentence and known word of every hit, in one number; a word counts once in a sentence."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, s.words), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == s.words)
        return np.unique(s.sentence[hit] * np.int64(len(self.vocabulary)) + at[hit])

    def logits(self, pairs: np.ndarray, n: int) -> np.ndarray:
        """Logit of each of n sentences."""
        many = max(1, len(self.vocabulary))
        return (np.bincount(pairs // many, weights=self.weights[pairs % many], minlength=n) if len(pairs) else np.zeros(n)) + self.bias

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        return self.logits(self.pairs(s), len(s.text_of))

    def _scores(self, z: np.ndarray, text_of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        clean = np.bincount(text_of, weights=-np.logaddexp(0, z), minlength=n_texts)
        return _sigmoid(self.slope * _logit_of(clean) + self.offset), _sigmoid(z)

    def scores(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated score of every text, probability of every sentence."""
        return self._scores(self.sentence_logits(s), s.text_of, s.n_texts)

    def score_long(self, data: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of one text of any length, and probability, begin and end of each sentence; spans may cut sentences."""
        many = max(1, len(self.vocabulary))
        pairs, begins, stops = [], [], []
        total, last = 0, None
        for a, z in tk.spans(data, begin, end):
            s = Sentences(data, np.array([a, z]), 0, 1)
            if s.edges is None:
                continue
            goes_on = last is not None and not (data[last : a + s.edges[0]] == 0x0A).any()
            first = total - 1 if goes_on else total
            pairs.append(self.pairs(s) + np.int64(first) * many)
            if goes_on:
                stops[-1][-1] = s.stop[0] + a - begin
            begins.append(s.begin[int(goes_on) :] + a - begin)
            stops.append(s.stop[int(goes_on) :] + a - begin)
            if not len(stops[-1]):
                begins.pop(), stops.pop()
            total = first + len(s.text_of)
            last = None if s.closed else a + s.edges[1]
        z = self.logits(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), total)
        score, p = self._scores(z, np.zeros(total, np.int64), 1)
        none = [np.zeros(0, np.int64)]
        return score, p, np.concatenate(begins or none), np.concatenate(stops or none)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logit_of(clean: np.ndarray) -> np.ndarray:
    """Log-odds of 1 - exp(clean), where clean is the log-probability that no sentence offends."""
    clean = np.minimum(clean, -1e-9)
    return np.clip(np.log(-np.expm1(clean)) - clean, -20, 20)


def _telling(words: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Words that toxic texts have more often than others, beyond chance."""
    none = [np.zeros(0, np.uint64)]
    toxic = np.concatenate([np.unique(w) for w, y in zip(words, labels, strict=True) if y] or none)
    clean = np.concatenate([np.unique(w) for w, y in zip(words, labels, strict=True) if not y] or none)
    n1, n0 = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    names, a = np.unique(toxic, return_counts=True)
    names, a = names[a >= LEAST], a[a >= LEAST].astype(float)
    clean.sort()
    b = (np.searchsorted(clean, names, side="right") - np.searchsorted(clean, names, side="left")).astype(float)
    part = lambda k, n, p: k * np.log(np.maximum(k, 1e-12) / (n * p)) + (n - k) * np.log(np.maximum(n - k, 1e-12) / (n * np.maximum(1 - p, 1e-12)))
    both = (a + b) / (n1 + n0)
    g = 2 * (part(a, n1, both) + part(b, n0, both))
    return names[(g > SURE) & (a / n1 > b / n0)]


class _Bag:
    """A text's hits: sentence and word of each, over the words of a vocabulary."""

    def __init__(self, s: Sentences, vocabulary: np.ndarray):
        at = np.minimum(np.searchsorted(vocabulary, s.words), len(vocabulary) - 1)
        hit = vocabulary[at] == s.words
        pair = np.unique(s.sentence[hit].astype(np.int64) * len(vocabulary) + at[hit])
        self.sentence, self.word, self.n = pair // len(vocabulary), pair % len(vocabulary), len(s.text_of)


def _learn(texts: list[Sentences], labels: list[int], weights: list[float], rng: np.random.Generator) -> Model:
    """Vocabulary, word weights and bias; not calibrated."""
    vocabulary = _telling([t.words for t in texts], labels)
    w, bias = np.zeros(len(vocabulary)), START
    if not len(vocabulary):
        return Model(vocabulary, w, bias, 1.0, 0.0)
    bags = [_Bag(t, vocabulary) for t in texts]
    gw, gb = np.full(len(w), 1e-3), 1.0
    scale = np.array(weights) / max(np.mean(weights), 1e-9)
    # Equal say for both labels while the words are learned; calibration restores the shares.
    for c in (0, 1):
        mine = [i for i, y in enumerate(labels) if y == c]
        scale[mine] *= len(texts) / (2 * max(1e-9, scale[mine].sum()))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            bag = bags[i]
            if not bag.n:
                continue
            z = np.bincount(bag.sentence, weights=w[bag.word], minlength=bag.n) + bias
            p = _sigmoid(z)
            if labels[i]:
                clean = float(-np.logaddexp(0, z).sum())
                g = -p * (np.exp(clean) / max(-np.expm1(clean), 1e-9))
            else:
                g = p
            g = g * scale[i]
            words, inverse = np.unique(bag.word, return_inverse=True)
            grad = np.bincount(inverse, weights=g[bag.sentence]) + DECAY * w[words]
            gw[words] += grad * grad
            w[words] -= RATE * grad / np.sqrt(gw[words])
            total = float(np.clip(g.sum(), -1, 1))
            gb += total * total
            bias = min(-2.0, bias - RATE * 0.2 * total / np.sqrt(gb))
    return Model(vocabulary, w, bias, 1.0, 0.0)


def _platt(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge-regularised logistic fit, by Newton steps."""
    a, c = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, c
    k = k / k.sum()
    for _ in range(50):
        p = _sigmoid(a * x + c)
        g = np.array([(k * (p - y) * x).sum() + 1e-4 * (a - 1), (k * (p - y)).sum() + 1e-6 * c])
        r = k * p * (1 - p)
        h = np.array([[(r * x * x).sum() + 1e-4, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, c = a - d[0], c - d[1]
    return float(max(a, 0.05)), float(c)


def train(texts: list[str], labels: list[int], weights: list[float], seed: int = 11) -> Model:
    """Fit words on all texts; calibrate on texts that a model of the other folds has not seen."""
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        bags.append(Sentences(raw, np.array([0, len(raw)]), 0, 1))
    pick = lambda idx: ([bags[i] for i in idx], [labels[i] for i in idx], [weights[i] for i in idx])
    model = _learn(bags, labels, weights, rng)
    if not len(model.vocabulary):
        share = float(np.average(labels, weights=weights)) if labels else 0.0
        return Model(model.vocabulary, model.weights, START, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    seen, x = [], []
    for fold in range(FOLDS):
        held = list(range(fold, len(texts), FOLDS))
        part = _learn(*pick([i for i in range(len(texts)) if i % FOLDS != fold]), rng)
        x += [_logit_of(np.array([-np.logaddexp(0, part.sentence_logits(bags[i])).sum()]))[0] for i in held]
        seen += held
        # One fold is enough once it shows so many toxic texts.
        if sum(labels[i] for i in seen) >= CALIBRATE:
            break
    model.slope, model.offset = _platt(np.array(x), np.array([labels[i] for i in seen], float), np.array([weights[i] for i in seen]))
    return model


def sample(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, longest: int = LONGEST) -> list[tuple[str, int, float]]:
    """(text, label, weight) of at most per_label documents of each label, by least text hash."""
    marks = staged(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").filter(F.char_length("text") <= longest)
    rows = docs.join(broadcast_if_small(marks, 20, ID_BROADCAST), "doc_id")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    out = []
    for label, n in sorted(counts.items()):
        # About twice the wanted share by a draw on the hash, then exactly the least ones.
        draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, 2 * per_label / n) * (1 << 30))
        some = rows.filter((F.col("toxic") == label) & draw).dropDuplicates(["text"]).orderBy(F.xxhash64("text", F.lit(1)), "text").limit(per_label).select("text").collect()
        out += [(r["text"], label, n / max(1, len(some))) for r in some]
    return out


def fit(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, longest: int = LONGEST) -> Model | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic); None if there are no labels."""
    rows = sample(documents, labels, per_label, longest)
    if not rows:
        return None
    order = np.random.default_rng(5).permutation(len(rows)).tolist()
    return train([rows[i][0] for i in order], [rows[i][1] for i in order], [rows[i][2] for i in order])


def _scoring(shared):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            data, offsets = tk.string_buffers(b.column("text"))
            for lo, hi in tk.row_chunks(offsets):
                n = hi - lo
                if tk.is_long(offsets, lo, hi):
                    score, p, begin, stop = model.score_long(data, int(offsets[lo]), int(offsets[hi]))
                    text_of = np.zeros(len(p), np.int64)
                else:
                    s = Sentences(data, offsets, lo, hi)
                    score, p = model.scores(s)
                    begin, stop, text_of = s.begin, s.stop, s.text_of
                # The sentence most to blame in each text: the last of its rows after a stable sort.
                order = np.lexsort((p, text_of))
                worst = np.full(n, -1, np.int64)
                worst[text_of[order]] = order
                has = worst >= 0
                pick = np.where(has, worst, 0)
                take = lambda v, has=has, pick=pick: pa.array(np.where(has, v[pick], 0) if len(v) else np.zeros(len(has)), mask=~has)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), pa.array(score, pa.float64()), take(p).cast(pa.float64()), take(begin).cast(pa.int64()), take(stop).cast(pa.int64())], names=["doc_id", "score", "worst_score", "worst_begin", "worst_end"]
                )

    return run


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, worst_score, worst_begin, worst_end (byte span of the worst sentence) of every row."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        model = Model(np.zeros(0, np.uint64), np.zeros(0), START, 0.0, -60.0)
    return docs.mapInArrow(_scoring(spark.sparkContext.broadcast(model)), "doc_id long, score double, worst_score double, worst_begin long, worst_end long")
