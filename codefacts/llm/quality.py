"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is a position of the chain, labelled bad (0) or good (1). Its features
are rates of character classes and of their pairs, of word shapes and of repeats, for the line
itself and for the lines before and after it. Training rows give all their lines the label of
the document; forward-backward marginals of "good", weighted by line length, are the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import annotated, held_out, sliced, staged

TRAIN_DOCS = 3000  # labelled documents that the model is fitted on, at most
TRAIN_LINES = 100_000  # their lines, at most: documents are taken while they fit
BLOCK = 500_000  # characters whose features are computed at once
CLASSES = 9  # lower, upper, digit, space, sentence mark, shout mark, bar, other letter, other
BASE = CLASSES * CLASSES + CLASSES + 9
_CLASS: list[np.ndarray] = []
_MIX: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of each code point, and 64 odd multipliers to hash words with."""
    if not _CLASS:
        c = np.full(0x110000, 8, dtype=np.int64)
        for i in range(0x250):
            ch = chr(i)
            c[i] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 7 if ch.isalpha() else 8
        c[0x250:] = [7 if chr(i).isalpha() else 2 if chr(i).isdigit() else 8 for i in range(0x250, 0x110000)]
        for marks, k in ((" \t\r\x0b\x0c ", 3), (".,;:'\"()-", 4), ("!?", 5), ("|", 6)):
            for ch in marks:
                c[ord(ch)] = k
        _CLASS.append(c)
        _MIX.append(np.random.default_rng(1).integers(1, 1 << 62, 64, dtype=np.int64).view(np.uint64) | np.uint64(1))
    return _CLASS[0]


def line_features(texts: list[str], before: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """(features of each line, its length, its document, the last line's mark) of texts; blank lines count too.

    before: the mark of the line before the first text, where that goes on with its document.
    """
    kind = _classes()
    big = "\n".join(texts) + "\n"
    code = np.frombuffer(big.encode("utf-32-le", "replace"), dtype=np.uint32)
    end = code == 10
    stops = np.flatnonzero(end)
    n_lines = len(stops)
    line = np.cumsum(end, dtype=np.int32) - end
    length = np.diff(stops, prepend=-1) - 1
    per_doc = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    c = kind[code].astype(np.int32)
    inner = ~end
    size = np.maximum(length, 1).astype(np.float64)
    one = np.bincount(line[inner] * CLASSES + c[inner], minlength=n_lines * CLASSES).reshape(n_lines, CLASSES)
    pair = inner[:-1] & inner[1:]
    two = np.bincount(line[:-1][pair].astype(np.int64) * (CLASSES * CLASSES) + (c[:-1] * CLASSES + c[1:])[pair], minlength=n_lines * CLASSES * CLASSES).reshape(n_lines, -1)
    # words: where they begin, their hash, their line
    gap = end | (c == 3)
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if len(begin):
        opened = np.zeros(len(code), dtype=np.int64)
        opened[begin] = begin
        at = np.arange(len(code)) - np.maximum.accumulate(opened)
        h = np.where(gap, 0, (code.astype(np.uint64) + np.uint64(1)) * _MIX[0][at & 63])
        word = np.add.reduceat(h, begin)
        w_line, w_end = line[begin], np.add.reduceat(~gap, begin)
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (w_line[1:] == w_line[:-1])])
        words = np.bincount(w_line, minlength=n_lines)
        repeats = np.bincount(w_line, weights=same, minlength=n_lines)
        long = np.bincount(w_line, weights=w_end > 12, minlength=n_lines)
        key = w_line.astype(np.uint64) << np.uint64(40) | word >> np.uint64(24)
        first = np.unique(key)
        distinct = np.bincount((first >> np.uint64(40)).astype(np.int64), minlength=n_lines)
    else:
        words = repeats = long = distinct = np.zeros(n_lines)
    count = np.maximum(words, 1)
    copy = np.zeros(n_lines)
    sums = np.add.reduceat(np.where(end, 0, code.astype(np.int64) ** 2), np.concatenate([[0], stops[:-1] + 1]))
    copy[1:] = (sums[1:] == sums[:-1]) & (length[1:] == length[:-1]) & (doc[1:] == doc[:-1]) & (length[1:] > 0)
    copy[0] = before is not None and before == (int(sums[0]), int(length[0])) and length[0] > 0
    more = np.stack([np.log1p(length), np.log1p(words), repeats / count, long / count, distinct / count, copy, length == 0, (one[:, 0] + one[:, 1] + one[:, 7]) / size, one[:, 1] / np.maximum(one[:, 0] + one[:, 1], 1)], axis=1)
    x = np.concatenate([one / size[:, None], two / size[:, None], more], axis=1).astype(np.float32)
    return x, length, doc, (int(sums[-1]), int(length[-1]))


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after (zeros and a mark at the ends)."""
    n, k = x.shape
    out = np.zeros((n, 3 * k + 3), dtype=np.float32)
    out[:, :k] = x
    same = doc[1:] == doc[:-1]
    out[1:, k : 2 * k] = x[:-1] * same[:, None]
    out[:-1, 2 * k : 3 * k] = x[1:] * same[:, None]
    out[:, 3 * k] = 1
    out[0, 3 * k + 1] = out[-1, 3 * k + 2] = 1
    out[1:, 3 * k + 1] = ~same
    out[:-1, 3 * k + 2] = ~same
    return out


def marginals(node: np.ndarray, trans: np.ndarray, doc: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transitions, sum of log partition functions).

    weight: what the transition out of each line counts in the second (all alike if missing). node: log-potentials (lines, 2), lines of a document together. Documents are stepped through
    side by side, the longest first, so that step t works on those with more than t lines.
    """
    n = len(node)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(starts, append=n)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    fwd, bwd, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    top = node.max(axis=1, keepdims=True)
    e, t = np.exp(node - top), np.exp(trans)
    for k, m in enumerate(alive.tolist()):
        at = starts[:m] + k
        f = e[at] if k == 0 else (fwd[at - 1] @ t) * e[at]
        scale[at] = f.sum(axis=1)
        fwd[at] = f / scale[at][:, None]
    for k in range(len(alive) - 2, -1, -1):
        at = starts[: int(alive[k + 1])] + k
        bwd[at] = ((e[at + 1] * bwd[at + 1]) @ t.T) / scale[at + 1][:, None]
    p = fwd * bwd
    good = p[:, 1] / p.sum(axis=1)
    left = np.flatnonzero(np.concatenate([doc[1:] == doc[:-1], [False]]))
    both = fwd[left][:, :, None] * t[None] * (e[left + 1] * bwd[left + 1])[:, None, :] / scale[left + 1][:, None, None]
    if weight is not None:
        both = both * weight[left][:, None, None]
    return good, both.sum(axis=0), float(np.log(scale).sum() + top.sum())


def _blocks(texts: list[str], limit: int) -> Iterator[tuple[list[str], list[int]]]:
    """(texts, their documents) of about ``limit`` characters each; long texts are cut between lines.

    A line is never cut, so one of more characters is a block of its own.
    """
    held: list[str] = []
    of: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at <= len(text):
            stop = len(text) if len(text) - at <= limit else text.find("\n", at + limit)
            stop = len(text) if stop < 0 else stop
            held.append(text[at:stop])
            of.append(i)
            size, at = size + stop - at, stop + 1
            if size >= limit:
                yield held, of
                held, of, size = [], [], 0
    if held:
        yield held, of


def features(texts: list[str], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """line_features of texts, block by block and the same as of the whole; documents are numbered over all blocks."""
    last, before = -1, None
    for part, of in _blocks(texts, block):
        x, length, doc, mark = line_features(part, before if of[0] == last else None)
        last, before = of[-1], mark
        yield x, length, np.array(of)[doc]


class Crf:
    """Weights of the lines' features and of the four transitions."""

    def __init__(self, mean: np.ndarray, spread_: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> None:
        self.mean, self.spread, self.weights, self.trans = mean, spread_, weights, trans

    @classmethod
    def fit(cls, x: np.ndarray, doc: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.05, l2: float = 3e-4) -> Crf:
        """x: line features, doc: their document, y: the documents' label, for each line."""
        mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.clip(with_neighbours((x - mean) / sd, doc), -8, 8)
        w, t = np.zeros(z.shape[1]), np.zeros((2, 2))
        # each document counts alike: a long one is no more evidence than a short one
        # (its lines and its transitions share that weight, so that both gradients are of one likelihood)
        size = np.bincount(doc, minlength=int(doc.max()) + 1)[doc]
        weight = 1.0 / size
        docs = weight.sum()
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        left = np.flatnonzero(np.concatenate([doc[1:] == doc[:-1], [False]]))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[left], y[left + 1]), weight[left])
        for k in range(1, rounds + 1):
            u = z @ w
            good, both, _ = marginals(np.stack([np.zeros(len(u)), u], axis=1), t, doc, weight)
            g = np.concatenate([z.T @ ((good - y) * weight) / docs + l2 * w, ((both - seen) / docs + 1e-2 * t).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            w, t = w - step[:-4], t - step[-4:].reshape(2, 2)
        return cls(mean, sd, w, t)

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good), length, document) of each line.

        A long text is taken in blocks of lines, which change nothing; only the lines' potentials are kept.
        """
        w, k = self.weights, len(self.mean)
        by_line, lengths, docs = [], [], []
        for x, length, doc in features(texts, BLOCK):
            z = np.clip((x - self.mean) / self.spread, -8, 8)
            by_line.append(z @ w[: 3 * k].reshape(3, k).T)
            lengths.append(length)
            docs.append(doc)
        own, length, doc = np.concatenate(by_line), np.concatenate(lengths), np.concatenate(docs)
        same = doc[1:] == doc[:-1]
        u = own[:, 0] + w[3 * k]
        u[1:] += np.where(same, own[:-1, 1], w[3 * k + 1])
        u[:-1] += np.where(same, own[1:, 2], w[3 * k + 2])
        u[0] += w[3 * k + 1]
        u[-1] += w[3 * k + 2]
        good, _, _ = marginals(np.stack([np.zeros(len(u)), u], axis=1), self.trans, doc)
        return good, length, doc

    def scores(self, texts: list[str]) -> np.ndarray:
        good, length, doc = self.lines(texts)
        weight = length + 1e-3  # so that a text of blank lines has a score too
        return np.bincount(doc, weights=good * weight, minlength=len(texts)) / np.bincount(doc, weights=weight, minlength=len(texts))


def fitted(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, lines: int = TRAIN_LINES, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Crf | None:
    """A model from at most ``limit`` labelled documents that aren't held out, by order of a hash of doc_id.

    Their ids (a broadcast of ``limit`` numbers at most) pick the rows; line features are computed and
    kept on the executors' side, and those of at most ``lines`` lines come to the driver: documents
    are taken in that order while they fit. Labels that contradict each other are averaged. None
    without labels of both kinds.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, ys, ids = (c.to_pylist() for c in batch.columns)
            for t, y, i in zip(texts, ys, ids, strict=True):
                n = (t or "").count("\n") + 1
                if n <= lines:
                    x = b"".join(x.astype(np.float16).tobytes() for x, _, _ in features([t or ""], BLOCK))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([n], pa.int64()), pa.array([x], pa.binary())], names=["id", "y", "n", "x"])

    picked = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc")).join(F.broadcast(few), F.col("doc") == F.col("id"))
    rows = staged(picked.select("text", "y", "id").mapInArrow(run, "id long, y int, n long, x binary"), "lines")
    # copies of a doc_id are documents of their own: at most as many rows a number as the table has
    sizes = rows.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("id"), "id").limit(limit).collect()
    chosen, total = [], 0
    for r in sizes:
        if total + r.n <= lines:
            chosen, total = [*chosen, r.id], total + r.n
    kept = rows.where(F.col("id").isin(chosen)).select("id", "y", "x").toArrow()
    got = sorted(zip(kept.column(0).to_pylist(), kept.column(2).to_pylist(), kept.column(1).to_pylist(), strict=True))
    if len({y for _, _, y in got}) < 2:
        return None
    xs = [np.frombuffer(x, dtype=np.float16).astype(np.float32).reshape(-1, BASE) for _, x, _ in got]
    doc = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    y = np.array([y for _, _, y in got])[doc]
    return Crf.fit(np.concatenate(xs), doc, y)


def scored(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """docs with a score for every row, 0 to 1, higher for good (a column ``score`` is replaced).

    Null and empty texts are one blank line. A text scores the same in blocks as whole. Without a model (nothing to learn from) every score is 0.5.
    """

    def of() -> Callable[[list[str]], dict[str, list]]:
        return lambda texts: {"score": np.full(len(texts), 0.5) if model is None else np.clip(model.scores(texts), 0.0, 1.0)}

    return annotated(docs, of, "score double", text, BLOCK)
