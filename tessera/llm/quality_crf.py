"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line gets the label good or bad. Its features are binned measures of the line
itself and of the lines before and after it; neighbouring labels are tied by transition
weights. The forward-backward recursion gives each line's probability of being good, and the
document's quality is the mean of these, weighted by the lines' lengths.

Lines take their document's label for training, from at most ``LABELLED`` labelled documents
outside the held-out third. The weights (features x 2, 2 x 2) are found by gradient
ascent of the conditional likelihood with an L2 penalty, over all lines of these
documents at once; the recursions run over all documents in step.

Scoring is one narrow pass over whole texts. Lines are \\n-split; lines without a word do
not count. Long lines are measured in blocks whose counts are added up.

Defined results: null, empty and word-less texts have score 0; without labelled documents of
both kinds every score is 0; repeated rows get equal scores; an empty table gives no
rows. Only doc_id and text are read, and doc_id only for the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import hashing as H
from tessera.llm.toxicity import labelled_documents

LABELLED = 3_000
BINS = 8
ROUNDS = 150
THRESHOLD = 0.5

MEASURES = ("symbols", "capitals", "digits", "shouts", "word_length", "length", "repeats", "line_repeats", "stops", "low_words", "stutter")
N = len(MEASURES)
PAD = N * BINS  # the feature "no such neighbour"
WIDTH = 3 * (PAD + 1)

_KIND = np.zeros(256, dtype=np.int8)
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@+/"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:"]] = 6


KINDS = range(1, 7)  # lower, upper, digits, symbols, shouts, stops


def _line_measures(data: bytes) -> np.ndarray:
    """(lines, N + 1) measures and, last, the length of the lines of a block; the block holds whole texts."""
    buf = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(buf == 10)
    start, end = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(buf)]])
    at, h = H.word_hashes(buf, H.TABLE)
    line = np.searchsorted(start, at, side="right") - 1
    words = np.bincount(line, minlength=len(start)).astype(float)
    kind = _KIND[buf]

    def total(k):
        s = np.concatenate([[0], np.cumsum(kind == k)])
        return (s[end] - s[start]).astype(float)

    order = np.lexsort((h, line))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][first], minlength=len(start)).astype(float)
    starts_low = np.bincount(line[kind[at] == 1], minlength=len(start)).astype(float)
    again = np.bincount(line[1:][(h[1:] == h[:-1]) & (line[1:] == line[:-1])], minlength=len(start)).astype(float)
    return _ratios(*map(total, KINDS), words, distinct, starts_low, again, (end - start).astype(float), H.spans(H.running(buf), start, end))


def _ratios(lower, upper, digits, symbols, shouts, stops, words, distinct, starts_low, again, size, whole) -> np.ndarray:
    """The measures of lines from counts of their characters by kind, of their words, and the hashes of the lines."""
    w, letters = np.maximum(words, 1), np.maximum(lower + upper, 1)
    out = np.stack([symbols / w, upper / letters, digits / w, shouts / w, (lower + upper) / w, np.log1p(words), 1 - distinct / w,
                    np.zeros(len(words)), stops / w, starts_low / w, again / w, size], axis=1)
    return np.column_stack([out, whole.view(np.float64), words])


def _long_line(data: bytes) -> np.ndarray:
    """The measures of one line that is longer than a block."""
    counts, starts_low, hashes = np.zeros(len(KINDS)), 0, []
    for piece in H.pieces(data):
        buf = np.frombuffer(piece, np.uint8)
        at, h = H.word_hashes(buf, H.TABLE)
        kind = _KIND[buf]
        counts += [(kind == k).sum() for k in KINDS]
        starts_low += (kind[at] == 1).sum()
        hashes.append(h)
    h = np.concatenate(hashes)
    whole = np.array([xxhash.xxh64_intdigest(data)], dtype=np.uint64)
    rest = (len(h), len(np.unique(h)), starts_low, (h[1:] == h[:-1]).sum(), len(data))
    return _ratios(*counts[:, None], *(np.array([x], dtype=float) for x in rest), whole)


def documents_lines(texts) -> Iterator[np.ndarray]:
    """The measures (lines with a word, N + 1) of each text; short texts are measured together."""
    group: list[bytes] = []

    def measured(parts: list[bytes]) -> Iterator[np.ndarray]:
        if parts:
            rows = _line_measures(b"\n".join(parts))
            yield from np.split(rows, np.cumsum([p.count(b"\n") + 1 for p in parts])[:-1])

    def finish(rows: np.ndarray) -> np.ndarray:
        rows = rows[rows[:, -1] > 0]
        _, first = np.unique(rows[:, -2].copy().view(np.uint64), return_index=True)
        rows[:, MEASURES.index("line_repeats")] = 1
        rows[first, MEASURES.index("line_repeats")] = 0
        return rows[:, :N + 1]

    def long_text(data: bytes) -> Iterator[np.ndarray]:
        lines: list[bytes] = []
        size = 0
        for line in data.split(b"\n"):
            if size + len(line) > H.BLOCK and lines:
                yield _line_measures(b"\n".join(lines))
                lines, size = [], 0
            if len(line) > H.BLOCK:
                yield _long_line(line)
            else:
                lines.append(line)
                size += len(line) + 1
        if lines:
            yield _line_measures(b"\n".join(lines))

    held = 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held + len(data) > H.BLOCK:
            yield from map(finish, measured(group))
            group, held = [], 0
        if len(data) > H.BLOCK:
            yield finish(np.concatenate([*long_text(data)]))
            continue
        group.append(data)
        held += len(data)
    yield from map(finish, measured(group))


def features(lines: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(lines, 3 N) feature numbers: of the line, the line before and the line after."""
    if not len(lines):
        return np.zeros((0, 3 * N), dtype=np.int64)
    own = np.stack([np.searchsorted(edges[k], lines[:, k], side="right") + k * BINS for k in range(N)], axis=1)
    none = np.full((1, N), PAD)
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    return np.hstack([own, before + PAD + 1, after + 2 * (PAD + 1)])


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Zero has a bin of its own; the others hold equal parts of the positive values."""
    positive = values[values > 0]
    return np.concatenate([[1e-12], np.quantile(positive, np.arange(1, BINS - 1) / (BINS - 1)) if len(positive) else np.full(BINS - 2, np.inf)])


class Chains:
    """Documents' lines, laid out so that step t holds the t-th lines of all documents that have one."""

    def __init__(self, docs: list[np.ndarray]):
        self.sizes = np.array([len(d) for d in docs])
        self.order = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[self.order]
        self.steps = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(sizes[0] if len(sizes) else 0)]
        self.base = (np.cumsum(self.sizes) - self.sizes)[self.order]

    def marginals(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lines, 2) state probabilities and the 2 x 2 sum of the pair probabilities."""
        out, pairs, ahead = np.zeros_like(emit), np.zeros((2, 2)), []
        a = None
        for t, n in enumerate(self.steps):
            e = emit[self.base[:n] + t]
            a = e if a is None else e + np.logaddexp(a[:n, :1] + move[0], a[:n, 1:] + move[1])
            ahead.append(a)
        b = np.zeros((0, 2))
        for t in range(len(self.steps) - 1, -1, -1):
            n, later = self.steps[t], len(b)
            mine = np.zeros((n, 2))
            if later:
                e = emit[self.base[:later] + t + 1] + b
                joint = ahead[t][:later, :, None] + move[None] + e[:, None, :]
                z = np.logaddexp.reduce(joint.reshape(later, 4), axis=1)
                pairs += np.exp(joint - z[:, None, None]).sum(axis=0)
                mine[:later] = np.logaddexp(move[:, 0] + e[:, :1], move[:, 1] + e[:, 1:])
            g = ahead[t] + mine
            out[self.base[:n] + t] = np.exp(g - np.logaddexp(g[:, :1], g[:, 1:]))
            b = mine
        return out, pairs


def _add(f: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.bincount(f.ravel(), np.repeat(values, f.shape[1]), minlength=WIDTH)


class QualityField:
    """A fitted model: bin edges, line weights (for good; bad has 0) and transition weights."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, move: np.ndarray):
        self.edges, self.weights, self.move = edges, weights, move

    @classmethod
    def train(cls, docs: list[np.ndarray], labels: np.ndarray, penalty: float = 1.0, rounds: int = ROUNDS) -> QualityField:
        every = np.concatenate(docs)
        edges = np.stack([bin_edges(every[:, k]) for k in range(N)])
        chains = Chains(docs)
        f = np.concatenate([features(d, edges) for d in docs])
        y = np.repeat(labels, chains.sizes).astype(float)
        # a document counts once however many lines it has, and both kinds of documents alike in sum
        share = np.repeat(1 / np.maximum(chains.sizes, 1), chains.sizes)
        goal = _add(f, y * share)
        pair_goal = np.array([[np.maximum(chains.sizes - 1, 0)[labels == 0].sum(), 0], [0, np.maximum(chains.sizes - 1, 0)[labels == 1].sum()]], dtype=float)
        pair_scale = 1 / max(1.0, pair_goal.sum() / len(docs))
        w, move, m, v = np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
        for k in range(1, rounds + 1):
            emit = np.zeros((len(f), 2))
            emit[:, 1] = w[f].sum(axis=1)
            p, pairs = chains.marginals(emit, move)
            g = np.concatenate([goal - _add(f, p[:, 1] * share) - penalty * w, (pair_scale * (pair_goal - pairs) - penalty * 10 * move).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
            w, move = w + step[:WIDTH], move + step[WIDTH:].reshape(2, 2)
        return cls(edges, w, move)

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, bound: int = LABELLED, text: str = "text", doc_id: str = "doc_id") -> QualityField | None:
        rows = labelled_documents(docs, labels, "quality", bound, text, doc_id)

        def lines(batches):
            for pdf in batches:
                yield pd.DataFrame({"label": pdf["label"], "lines": [x.tobytes() for x in documents_lines(pdf["text"])]})

        found = rows.select("text", "label").mapInPandas(lines, "label int, lines binary").collect()  # ``bound`` documents at most
        pairs = [(np.frombuffer(r["lines"]).reshape(-1, N + 1), r["label"]) for r in found if len(r["lines"])]
        y = np.array([p[1] for p in pairs])
        if not (0 < y.sum() < len(y)):
            return None
        return cls.train([p[0] for p in pairs], y)

    def quality(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of good lines of each text."""
        docs = list(documents_lines(texts))
        chains = Chains(docs)
        if not len(docs) or not chains.sizes.sum():
            return np.zeros(len(docs)), np.zeros(len(docs), dtype=np.int64)
        f = np.concatenate([features(d, self.edges) for d in docs])
        emit = np.zeros((len(f), 2))
        emit[:, 1] = self.weights[f].sum(axis=1)
        good = chains.marginals(emit, self.move)[0][:, 1]
        size, owner = np.concatenate([d[:, N] for d in docs]), np.repeat(np.arange(len(docs)), chains.sizes)
        total = np.bincount(owner, size, minlength=len(docs))
        score = np.bincount(owner, size * good, minlength=len(docs)) / np.maximum(total, 1)
        return np.clip(score, 0, 1), np.bincount(owner, good >= 0.5, minlength=len(docs)).astype(np.int64)


def quality(docs: DataFrame, model: QualityField | None, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, good_lines of each document."""
    def score(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            s, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for lo in range(0, len(texts), 512) if model is not None else ():
                s[lo:lo + 512], n[lo:lo + 512] = model.quality(texts.iloc[lo:lo + 512])
            yield pd.DataFrame({"score": s, "good_lines": n})

    udf = F.pandas_udf(score, "score double, good_lines long")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = own.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), udf("text").alias("q"))
    return scored.select("doc_id", "held_out", "q.score", (F.col("q.score") >= threshold).cast("int").alias("predicted"), "q.good_lines")
