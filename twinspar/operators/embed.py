"""Trained embeddings: words by Spark ML, functions as documents by distributed stochastic gradients.

Document models are trained in rounds. In a round every task runs through its documents from the broadcast word weights; the new weights of
each word, weighed by how often the task saw it, are averaged by a group-by. What comes to the driver is one row per word of
the vocabulary, whose size is capped by a parameter (the most frequent words stay; rarer ones are unknown and left out), so it does not
grow with the data. Document vectors are never gathered: they are derived from the word weights, document by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

RUN = 4096


def fit_word2vec(sentences: DataFrame, column: str = "tokens", size: int = 100, window: int = 8, least: int = 8, rounds: int = 5, seed: int = 1) -> Word2VecModel:
    """Skip-gram vectors of the words in an array column."""
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol=column, outputCol="vector").fit(sentences)


def word_vectors(model: Word2VecModel) -> DataFrame:
    """word, vector."""
    return model.getVectors()


@dataclass(frozen=True)
class DocumentModel:
    """kind: 'pvdm' (document and neighbours predict a word), 'pvdbow' (the document predicts its words) or 'asm' (neighbouring instructions and
    the document predict an instruction's operator and operands). Documents are lists of instructions, each a list of tokens, operator first."""

    kind: str = "pvdm"
    size: int = 100
    window: int = 1
    negative: int = 25
    rounds: int = 3
    infer_rounds: int = 5
    rate: float = 0.05
    least: int = 3
    most_words: int = 50_000
    seed: int = 1

    @property
    def width(self) -> int:
        """Length of a document vector."""
        return 2 * self.size


@dataclass
class Words:
    """Vocabulary, counts, and the two weight matrices of a model."""

    number: dict[str, int]
    count: np.ndarray
    into: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)


def _start(name: object, n: int, seed: int) -> np.ndarray:
    h = int.from_bytes(hashlib.md5(f"{seed}:{name}".encode()).digest()[:8], "big")
    return (np.random.default_rng(h).random(n) - 0.5) / n


def vocabulary(docs: DataFrame, m: DocumentModel) -> Words:
    """The `most_words` most frequent tokens that occur `least` times or more."""
    counts = docs.select(F.explode(F.flatten("tokens")).alias("w")).where("w is not null").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= m.least)
    rows = counts.orderBy(F.desc("n"), "w").limit(m.most_words).collect()
    words = {r["w"]: i for i, r in enumerate(rows)}
    into = np.array([_start(w, m.size if m.kind == "asm" else m.width, m.seed) for w in words]).reshape(len(words), -1)
    return Words(words, np.array([r["n"] for r in rows], float), into, np.zeros((len(words), m.width)))


def _contexts(doc: list[list[int]], d: np.ndarray, w: Words, m: DocumentModel) -> tuple[np.ndarray, np.ndarray, list]:
    """Rows of context vectors, their target words, and the words whose input vectors made each context."""
    rows, targets, parts = [], [], []
    if m.kind == "asm":
        as_vector = [np.concatenate([w.into[i[0]], w.into[i[1:]].mean(axis=0) if len(i) > 1 else np.zeros(m.size)]) for i in doc]
        for t, instruction in enumerate(doc):
            near = [k for k in (t - 1, t + 1) if 0 <= k < len(doc)]
            c = (d + sum(as_vector[k] for k in near)) / (1 + len(near))
            for x in instruction:
                rows.append(c)
                targets.append(x)
                parts.append(near)
        return np.array(rows), np.array(targets, int), parts
    flat = [x for i in doc for x in i]
    for t, x in enumerate(flat):
        near = [] if m.kind == "pvdbow" else [flat[k] for k in range(max(0, t - m.window), min(len(flat), t + m.window + 1)) if k != t]
        rows.append((d + w.into[near].sum(axis=0)) / (1 + len(near)) if near else d)
        targets.append(x)
        parts.append(near)
    return np.array(rows), np.array(targets, int), parts


def _step(doc: list[list[int]], d: np.ndarray, w: Words, m: DocumentModel, chance: np.ndarray, r: np.random.Generator, words_too: bool) -> np.ndarray:
    """One pass over a document; returns its new vector and, if asked, moves the word weights in place. Long documents go in runs of words to bound memory; the weights move after the last."""
    c, target, parts = _contexts(doc, d, w, m)
    total, scale = np.zeros(m.width), len(target) ** 0.5
    moved = w if len(target) <= RUN or not words_too else Words(w.number, w.count, np.zeros_like(w.into), np.zeros_like(w.out))
    for at in range(0, len(target), RUN):
        run = slice(at, at + RUN)
        wrong = np.searchsorted(chance, r.random((len(target[run]), m.negative)))
        which = np.concatenate([target[run, None], wrong], axis=1)
        aim = np.zeros(which.shape)
        aim[:, 0] = 1
        aim[:, 1:][wrong == target[run, None]] = 1
        o = w.out[which]
        error = m.rate * (aim - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ikj->ik", c[run], o), -30, 30))))
        back = np.einsum("ik,ikj->ij", error, o)
        share = back / np.array([1 + len(p) for p in parts[run]])[:, None]
        total += share.sum(axis=0)
        if words_too:
            np.add.at(moved.out, which, error[:, :, None] * c[run, None, :] / scale)
            for g, p in zip(share, parts[run], strict=True):
                for k in p:
                    if m.kind == "asm":
                        moved.into[doc[k][0]] += g[: m.size]
                        if len(doc[k]) > 1:
                            np.add.at(moved.into, doc[k][1:], g[m.size :] / (len(doc[k]) - 1))
                    else:
                        moved.into[k] += g
    if moved is not w:
        w.into += moved.into
        w.out += moved.out
    return d + total / scale


def _numbered(tokens: list | None, w: Words) -> list[list[int]]:
    out = [[w.number[x] for x in i or [] if x in w.number] for i in tokens or []]
    return [i for i in out if i]


def _chance(w: Words) -> np.ndarray:
    p = w.count**0.75
    return np.cumsum(p / p.sum())


def fit_documents(docs: DataFrame, m: DocumentModel) -> Words:
    """Word weights of a document model. docs: id, tokens ARRAY<ARRAY<STRING>>."""
    docs = cut(spread(docs.select("id", "tokens")))
    w = vocabulary(docs, m)
    if not len(w.number):
        return w
    for epoch in range(m.rounds):
        held = docs.sparkSession.sparkContext.broadcast(w)

        def kernel(batches: Iterator[pa.RecordBatch], held=held, epoch=epoch) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            base = held.value
            mine = Words(base.number, base.count, base.into.copy(), base.out.copy())
            chance, seen = _chance(base), np.zeros(len(base.count))
            for batch in batches:
                for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if doc := _numbered(tokens, mine):
                        for i in doc:
                            seen[i] += 1
                        _step(doc, _start(name, m.width, m.seed), mine, m, chance, np.random.default_rng(m.seed * 1000 + epoch), True)
            at = np.flatnonzero(seen)
            rows = [(mine.into[i] * seen[i]).tolist() + (mine.out[i] * seen[i]).tolist() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at]), pa.array(rows, pa.list_(pa.float64()))], names=["word", "n", "v"])

        length = w.into.shape[1] + m.width
        parts = docs.mapInArrow(kernel, "word bigint, n double, v array<double>")
        sums = parts.select("word", "n", F.posexplode("v").alias("j", "x")).groupBy("word", "j").agg((F.sum("x") / F.sum("n")).alias("x"))
        for r in sums.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("v")).toLocalIterator():
            v = np.array([e["x"] for e in r["v"]])
            w.into[r["word"]], w.out[r["word"]] = v[: length - m.width], v[length - m.width :]
    return w


def infer_documents(docs: DataFrame, words: Words, m: DocumentModel) -> DataFrame:
    """id, embedding: document vectors under fixed word weights. A document without known words has its seeded start vector."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        chance = _chance(w) if len(w.number) else np.ones(1)
        for batch in batches:
            out = []
            for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = _start(name, m.width, m.seed)
                if doc := _numbered(tokens, w):
                    for epoch in range(m.infer_rounds):
                        d = _step(doc, d, w, m, chance, np.random.default_rng(m.seed * 1000 + epoch), False)
                out.append(d.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "embedding"])

    return spread(docs.select("id", "tokens")).mapInArrow(kernel, f"id {docs.schema['id'].dataType.simpleString()}, embedding array<double>")
