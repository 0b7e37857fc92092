"""Toxicity: Levenshtein automata intersected with a lexicon trie, weighted by context.

1. *Lexicon*. At most ``LABELLED`` labelled documents outside the held-out third are dealt into
   halves. A word that one half proposes, since its documents are toxic more often than chance allows, is
   admitted if it holds on the other half, which did not propose it; its weight is the lower bound of its
   log-odds. Copies of a document are no evidence of their own: a word's documents count by their distinct
   neighbours of the word. All admitted words are the lexicon, and those of at least ``MIN_LETTERS`` letters form the trie.
2. *Matching*. A word of a text that is not in the lexicon is compiled to a Levenshtein
   automaton of distance 1, which is run along the trie; only the branches that the
   automaton can still accept are followed. One edit leaves
   a half of the term whole, so the trie is entered at that half. A word that labelled documents which are
   not toxic use is no misspelling, and the more of such ordinary words a term has near it, the less
   a misspelling of it weighs. Results are remembered for a bounded number of words.
3. *Context*. A match counts by the window around it: inside quotation marks or next to a
   word of reporting it is a quotation, next to a word of address it is
   aimed at someone.
4. *Score*. A logistic regression over sums of the weights, separately for plain, quoted,
   addressed and misspelled matches; evidence that is not quoted never lowers a score. It is fitted on thirds of
   the labelled documents, each with the lexicon of the other two, and sees each document's matches
   also as misspellings, and one of them alone, in either form.

Scoring is one narrow pass over whole texts; the model (a word list, the ordinary words near it, and a few
numbers) is bounded by the labelled rows and goes with the task.

Defined results: null, empty and word-less texts have no match and get the score of no
evidence; labels without a document, without a value or repeated with different values (the
greater counts) do no harm; without any labelled document of both kinds every score is 0;
repeated rows get equal scores; an empty table gives no rows. Only doc_id and text are
read, and doc_id only for the fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

LABELLED = 16_000
#: of each half of the labelled documents, toxic ones with the word, and the chance of so many if the word told nothing
MIN_DOCS = 2
CHANCE = 0.05
FOLDS = 3
MIN_LETTERS = 4
WINDOW = 6
#: words of which a task remembers the match, twice
MEMORY = 150_000
THRESHOLD = 0.7

TOKEN = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»]")
MARKED = re.compile("[^\\W_]+|[\"“”„«»\n]")
#: fixed values: words of reporting and of address, in four languages
REPORTING = frozenset("said says say called calls wrote quoted quote word term slur insult sagte nannte schrieb wort "
                      "dit appela écrit mot dijo llamó escribió palabra".split())
ADDRESS = frozenset("you your yours yourself u du dich dein deine ihr euch tu te ton ta vous votre tú usted ustedes eres".split())
FEATURES = ("strongest", "plain", "quoted", "addressed", "strongest_misspelled", "misspelled", "distinct", "density")
#: the feature whose weight may be negative
FREE = FEATURES.index("quoted")


class LevenshteinAutomaton:
    """Accepts the strings within ``k`` edits of ``word``; a state is the row of edit counts that are still at most k."""

    def __init__(self, word: str, k: int = 1):
        self.word, self.k = word, k

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple, ch: str) -> tuple:
        word, k, out = self.word, self.k, []
        if state and state[0][0] == 0 and state[0][1] < k:
            out.append((0, state[0][1] + 1))
        for j, (i, edits) in enumerate(state):
            if i == len(word):
                break
            best = edits + (word[i] != ch)
            if out and out[-1][0] == i:
                best = min(best, out[-1][1] + 1)
            if j + 1 < len(state) and state[j + 1][0] == i + 1:
                best = min(best, state[j + 1][1] + 1)
            if best <= k:
                out.append((i + 1, best))
        return tuple(out)

    def edits(self, state: tuple) -> int | None:
        return state[-1][1] if state and state[-1][0] == len(self.word) else None


class Trie:
    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = t

    def intersect(self, automaton: LevenshteinAutomaton, known: str = ""):
        """(term, edits) of the terms that begin with ``known`` and that the automaton accepts."""
        node, state = self.root, automaton.start()
        for ch in known:
            node, state = node.get(ch), automaton.step(state, ch)
            if node is None or not state:
                return
        stack = [(node, state)]
        while stack:
            node, state = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if (n := automaton.edits(state)) is not None:
                        yield child, n
                elif following := automaton.step(state, ch):
                    stack.append((child, following))


class Matcher(dict):
    """word -> (term, weight, edits) or None; filled as words come, of bounded size.

    One edit leaves the first or the second half of a term whole: the trie is entered at the
    first half, the trie of the reversed terms at the reversed second half. ``ordinary`` words, each
    given with the terms near it, are no misspellings.
    """

    def __init__(self, lexicon: dict[str, float], ordinary: dict[str, list[str]] | None = None):
        super().__init__()
        self.lexicon, self.ordinary, self.older = lexicon, ordinary or {}, {}
        beside = Counter(t for near in self.ordinary.values() for t in near)
        self.misspelled = {t: w - math.log1p(beside[t]) for t, w in lexicon.items()}
        terms = [t for t in lexicon if len(t) >= MIN_LETTERS]
        self.tries = Trie(terms), Trie(t[::-1] for t in terms)
        self.starts = {(len(t) + k, t[:len(t) // 2]) for t in terms for k in (-1, 0, 1)}, {(len(t) + k, t[len(t) // 2:][::-1]) for t in terms for k in (-1, 0, 1)}
        self.sizes: tuple[dict, dict] = ({}, {})
        for starts, sizes in zip(self.starts, self.sizes):
            for n, half in sorted(starts):
                if len(half) not in sizes.setdefault(n, []):
                    sizes[n].append(len(half))

    def near(self, word: str) -> list[tuple[float, str, int]]:
        found, n = [], len(word)
        for way, w in enumerate((word, word[::-1])):
            halves = [w[:k] for k in self.sizes[way].get(n, ()) if (n, w[:k]) in self.starts[way]]
            if halves:
                automaton = LevenshteinAutomaton(w)
                for half in halves:
                    found += [(t[::-1] if way else t, e) for t, e in self.tries[way].intersect(automaton, half)]
        return [(-self.misspelled[t], t, e) for t, e in found if self.misspelled[t] > 0]

    def __missing__(self, word: str):
        if word in self.older:
            found = self.older[word]
        elif word in self.lexicon:
            found = (word, self.lexicon[word], 0)
        elif len(word) not in self.sizes[0] or word in self.ordinary or not (near := self.near(word)):
            found = None
        else:
            w, t, n = min(near)
            found = (t, -w, n)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


def quoted_tokens(text: str, n: int) -> bytearray:
    """1 for the tokens after an odd number of quotation marks of their line."""
    out, i, opened = bytearray(n), 0, 0
    for m in MARKED.finditer(text):
        ch = m.group()
        if ch == "\n":
            opened = 0
        elif len(ch) == 1 and QUOTES.match(ch):
            opened ^= 1
        else:
            out[i] = opened
            i += 1
    return out


def matches(text: str | None, matcher: Matcher) -> tuple[list[str], list, bytearray | None]:
    """The tokens of one whole text, the matches among them (place, match) and which tokens are quoted."""
    if not isinstance(text, str):
        return [], [], None
    text = text.lower()
    tokens = TOKEN.findall(text)
    hits = [(i, m) for i, m in enumerate(map(matcher.__getitem__, tokens)) if m]
    return tokens, hits, quoted_tokens(text, len(tokens)) if hits and QUOTES.search(text) else None


def measured(tokens: list[str], hits: list, inside: bytearray | None) -> list[float]:
    """The features of the matches of a text."""
    if not hits:
        return [0.0] * len(FEATURES)
    strongest = {False: 0.0, True: 0.0}
    sums = {False: 0.0, True: 0.0}
    quoted = addressed = 0.0
    terms = set()
    for i, (term, weight, edits) in hits:
        near = tokens[max(0, i - WINDOW):i + WINDOW + 1]
        if (inside is not None and inside[i]) or not REPORTING.isdisjoint(near):
            quoted += weight
            continue
        terms.add(term)
        sums[edits > 0] += weight
        strongest[edits > 0] = max(strongest[edits > 0], weight)
        if not ADDRESS.isdisjoint(near):
            addressed += weight
    return [strongest[False], math.log1p(sums[False]), math.log1p(quoted), math.log1p(addressed), strongest[True], math.log1p(sums[True]),
            math.log1p(len(terms)), 100 * (sums[False] + sums[True]) / (len(tokens) + 50)]


def evidence(text: str | None, matcher: Matcher) -> list[float]:
    """The features of one whole text."""
    return measured(*matches(text, matcher))


def variants(text: str | None, matcher: Matcher) -> Iterator[list[float]]:
    """The features of a text; of one with exact matches also those of all of them misspelled, and of one alone, exact and misspelled."""
    tokens, hits, inside = matches(text, matcher)
    yield measured(tokens, hits, inside)
    exact = [(i, m) for i, m in hits if not m[2]]
    if exact:
        yield measured(tokens, [(i, (t, w, 1)) for i, (t, w, _) in hits], inside)
        i, (term, weight, _) = exact[len(tokens) % len(exact)]
        for edits in (0, 1):
            yield measured(tokens, [(i, (term, weight, edits))], inside)


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, bound: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """text, label, part of at most ``bound`` labelled documents outside the held-out fold (those of least hash)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where("id is not null and label is not null").where(~C.held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(bound)  # a row is 12 bytes
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return own.join(F.broadcast(known), "id").select("text", "label", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(2 * FOLDS)).cast("int").alias("part"))


def context_counts(train: DataFrame, words: frozenset | None = None) -> DataFrame:
    """word, part0 ... : in how many contexts (the words beside its first place in a document) of each part a word occurs; '' counts documents' beginnings.

    A context that copies of a document share counts once, in the least of their parts. Only ``words`` are counted, if given.
    """
    def look(batches):
        for pdf in batches:
            rows = set()
            for text, part in zip(pdf["text"], pdf["part"]):
                tokens = TOKEN.findall(text.lower()) if isinstance(text, str) else []
                rows.add(("", " ".join(tokens[:5]), part))
                first: dict = {}
                for i, w in enumerate(tokens):
                    if w not in first and (words is None or w in words):
                        first[w] = i
                rows.update((w, " ".join(tokens[max(0, i - 1):i] + tokens[i + 1:i + 2]), part) for w, i in first.items())
            yield pd.DataFrame(sorted(rows), columns=["word", "context", "part"])

    found = train.select("text", "part").mapInPandas(look, "word string, context string, part int").groupBy("word", "context").agg(F.min("part").alias("part"))
    return found.groupBy("word").agg(*[F.count(F.when(F.col("part") == k, 1)).alias(f"part{k}") for k in range(2 * FOLDS)])


def word_counts(train: DataFrame) -> tuple[list, dict[str, list]]:
    """Of all labelled documents, and of those with a word: how many of each part are toxic, then how many are not.

    Words in fewer than ``MIN_DOCS`` toxic documents of either half are left out; the others are bounded by the labelled rows.
    """
    # part k is of half k % 2
    often = " and ".join(" + ".join(f"part{k}" for k in range(half, 2 * FOLDS, 2)) + f" >= {MIN_DOCS}" for half in (0, 1))
    none = [0] * (2 * FOLDS)
    toxic = {r[0]: list(r[1:]) for r in context_counts(train.where("label <> 0")).where(f"word = '' or ({often})").collect()}
    other = {r[0]: list(r[1:]) for r in context_counts(train.where("label = 0"), frozenset(toxic)).collect()}
    totals = toxic.pop("", none) + other.pop("", none)
    return totals, {w: n + other.get(w, none) for w, n in toxic.items()}


def tail(k: int, n: int, p: float) -> float:
    """The chance of k or more hits in n draws of probability p."""
    if not 0 < p < 1:
        return 1.0
    x = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = x
    while k < n and x > 1e-12 * total:
        x *= (n - k) / (k + 1) * p / (1 - p)
        k += 1
        total += x
    return min(1.0, total)


def admitted(totals: list, counts: dict[str, list], without: int | None = None) -> dict[str, float]:
    """The words that each half finds in toxic documents more often than chance allows, with the lower bound of their log-odds.

    Either half may propose a word, the other one confirms it. Documents of the fold ``without`` are not counted.
    """
    parts = [[k for k in range(2 * FOLDS) if k % 2 == half and k // 2 != without] for half in (0, 1)]
    sizes = [(sum(totals[k] for k in own), sum(totals[k + 2 * FOLDS] for k in own)) for own in parts]
    n_toxic, n_other = sizes[0][0] + sizes[1][0], sizes[0][1] + sizes[1][1]
    found = {}
    for word, row in counts.items():
        seen = [(sum(row[k] for k in own), sum(row[k + 2 * FOLDS] for k in own)) for own in parts]
        toxic, other = seen[0][0] + seen[1][0], seen[0][1] + seen[1][1]
        weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1)) - math.sqrt(1 / (toxic + 0.5))
        if weight > 1.5 and all(t >= MIN_DOCS and tail(t, t + o, a / max(1, a + b)) <= CHANCE for (t, o), (a, b) in zip(seen, sizes)):
            found[word] = weight
    return found


def ordinary_words(train: DataFrame, lexicons: list[dict[str, float]]) -> list[dict[str, list[str]]]:
    """For each lexicon (the k-th leaves out fold k, the last none) the words near a term that documents which are not toxic use, with the terms."""
    def look(batches):
        matchers = [Matcher(x) for x in lexicons]
        found = set()
        for pdf in batches:
            for text, part in zip(pdf["text"], pdf["part"]):
                words = set(TOKEN.findall(text.lower())) if isinstance(text, str) else ()
                found.update((k, w) for k, m in enumerate(matchers) if k != part // 2 for w in words if (hit := m[w]) and hit[2])
        rows = [(k, w, t) for k, w in sorted(found) for t in sorted({t for _, t, _ in matchers[k].near(w)})]
        yield pd.DataFrame(rows, columns=["lexicon", "word", "term"])

    rows = train.where("label = 0").select("text", "part").mapInPandas(look, "lexicon int, word string, term string").distinct()
    out: list[dict[str, list[str]]] = [{} for _ in lexicons]
    for k, word, term in rows.collect():  # words of labelled rows
        out[k].setdefault(word, []).append(term)
    return out


def evidence_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept, none but that of ``FREE`` negative: the most negative one is taken out and the rest fitted anew."""
    used = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, used], y)
        low = [(v, k) for k, v in zip(used, w) if k != FREE and v < 0]
        if not low:
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = w[:-1], w[-1]
            return out
        used.remove(min(low)[1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights and, last, the intercept: Newton's method with a ridge; a step is halved until the penalised likelihood grows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[-1] = 1e-3

    def value(w):
        z = x @ w
        return (y * z - np.logaddexp(0, z)).sum() - (r * w * w).sum() / 2

    best = value(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(r), x.T @ (y - p) - r * w)
        while np.abs(step).max() > 1e-8 and not value(w + step) > best:
            step = step / 2
        if np.abs(step).max() <= 1e-8:
            break
        w = w + step
        best = value(w)
    return w


class Toxicity:
    """A fitted model: lexicon, ordinary words near its terms, and weights (none without labels of both kinds)."""

    def __init__(self, lexicon: dict[str, float], ordinary: dict[str, list[str]], weights: np.ndarray | None):
        self.lexicon, self.ordinary, self.weights = lexicon, ordinary, weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, bound: int = LABELLED, text: str = "text", doc_id: str = "doc_id") -> Toxicity:
        train = C.Scratch(docs.sparkSession, "toxicity").write(labelled_documents(docs, labels, "toxic", bound, text, doc_id), "labelled")
        totals, counts = word_counts(train)
        if not (sum(totals[:2 * FOLDS]) and sum(totals[2 * FOLDS:])):
            return cls({}, {}, None)
        lexicons = [admitted(totals, counts, k) for k in (*range(FOLDS), None)]
        ordinary = ordinary_words(train, lexicons)

        def features(batches):
            matchers = [Matcher(x, o) for x, o in zip(lexicons, ordinary)]
            for pdf in batches:
                rows = [(int(y), *v) for t, y, part in zip(pdf["text"], pdf["label"], pdf["part"]) for v in variants(t, matchers[part // 2])]
                yield pd.DataFrame(rows, columns=["label", *FEATURES])

        kinds = "label int, " + ", ".join(f"{f} double" for f in FEATURES)
        rows = np.array(train.mapInPandas(features, kinds).orderBy("label", *FEATURES).collect(), dtype=float)  # four a labelled row at most
        return cls(lexicons[-1], ordinary[-1], evidence_weights(rows[:, 1:], (rows[:, 0] > 0).astype(float)))

    def probabilities(self):
        """The scoring function of a task; what it remembers goes with the task."""
        lexicon, ordinary, weights = self.lexicon, self.ordinary, self.weights

        def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(lexicon, ordinary)
            for texts in series:
                if weights is None:
                    yield pd.Series(np.zeros(len(texts)))
                else:
                    x = np.array([evidence(t, matcher) for t in texts]).reshape(-1, len(FEATURES))
                    yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

        return score

    def score(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
        """row_id, doc_id, held_out, score, predicted of each document."""
        source = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        probability = F.pandas_udf(self.probabilities(), "double")
        scored = source.select("row_id", "doc_id", C.held_out(F.col("doc_id")).alias("held_out"), probability("text").alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = F.pandas_udf(Toxicity.fit(docs, labels).probabilities(), "double")
    return docs.where(score(F.col("text").cast("string")) < threshold)
