"""A linear-chain conditional random field that tags toxic spans, learnt from labelled documents.

No token carries a label, so the chain's own likelihood of the documents'
labels is maximised: a document is clean when all its tags are 0 and toxic when
any is 1, whose probabilities forward messages give exactly. All features of a
token (word, beginnings, shape, both neighbours) are in the chain; none is
chosen by the labels.
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

from tidewater.llm import _common as C

#: The training sample: at most so many labelled rows of each class, of at most so many bytes each.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 1 << 15
#: Features in fewer documents of the sample are left out, and learnt weights nearer to 0 than LEAST are.
SEEN_IN, LEAST = 3, 0.01
#: Adam's rounds and rate, the ridge, and the share of labels that are taken to be wrong; of two chains compared on
#: an inner fold of the training rows, the one with these values was no worse.
ROUNDS, RATE, RIDGE, WRONG = 60, 0.25, 0.3, 0.02
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
SCORED = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>"
#: Tokens of a run that goes through the chain in one piece.
RUN = 128
_WORD = re.compile(r"\w+")
_REMEMBERED = 300_000


def shape(word: str, lower: str) -> str:
    return "lower" if word == lower else "upper" if word.isupper() else "mixed"


def features(word: str) -> list[str]:
    """What the model sees of a token itself."""
    w = word.lower()
    return ["w=" + w, "h=" + shape(word, w)] + [f"p{n}={w[:n]}" for n in BEGINNINGS if len(w) >= n]


def beside(word: str) -> tuple[str, str]:
    """What the tokens after and before a token see of it."""
    w = word.lower()
    return "before=" + w, "after=" + w


class Model:
    """Weights of features, a bias, transitions (from, to) and the start, and the document layer."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias, self.start = -4.0, 0.0
        self.trans = np.zeros((2, 2))
        self.layer = (-3.0, 1.0, 0.0)


class Emissions(dict):
    """The number of each token as it stands in the text; `of` gives tokens their scores."""

    def __init__(self, model: Model):
        self.bias = model.bias
        self.known: list[tuple[float, float, float]] = []
        # by kind, so that a token needs no feature's name put together
        self.by: dict[str, dict[str, float]] = {k: {} for k in ("w", "h", "before", "after", *(f"p{n}" for n in BEGINNINGS))}
        for f, x in model.weights.items():
            kind, _, value = f.partition("=")
            self.by[kind][value] = x
        self.begins = [(n, self.by[f"p{n}"]) for n in BEGINNINGS]

    def __missing__(self, word: str) -> int:
        w, by = word.lower(), self.by
        own = by["w"].get(w, 0.0) + by["h"].get(shape(word, w), 0.0)
        for n, known in self.begins:
            if len(w) >= n:
                own += known.get(w[:n], 0.0)
        self.known.append((own, by["before"].get(w, 0.0), by["after"].get(w, 0.0)))
        n = self[word] = len(self.known) - 1
        return n

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self) >= _REMEMBERED:
            self.clear()
            self.known.clear()
        ids = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        own, before, after = np.array(self.known, float).reshape(-1, 3).T
        out = []
        for x in ids:
            s = self.bias + own[x]
            s[1:] += before[x[:-1]]
            s[:-1] += after[x[1:]]
            out.append(s)
        return out


def _transferred(s: np.ndarray, at: np.ndarray, first: np.ndarray, length: int, trans: np.ndarray, start: float) -> np.ndarray:
    """Of runs of `length` tokens the matrix that takes the odds before the run to those of its last token, up to a factor.

    The runs marked in `first` begin a sequence, so what is before them doesn't count.
    """
    a = np.exp(trans - trans.max())
    m = np.zeros((len(at), 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    for k in range(length):
        e = np.exp(np.clip(s[at + k], -300, 300))[:, None]
        top, low = e * (a[1, 1] * m[:, 0] + a[0, 1] * m[:, 1]), a[1, 0] * m[:, 0] + a[0, 0] * m[:, 1]
        if k == 0:
            top[first], low[first] = np.stack([0 * e[first, 0], e[first, 0] * np.exp(start)], axis=1), (0.0, 1.0)
        most = np.maximum(top, low).max(axis=1)[:, None]
        m[:, 0], m[:, 1] = top / most, low / most
    return m


def _messages(s: np.ndarray, first: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: float, run: int = RUN) -> np.ndarray:
    """The log odds that forward messages give each token; sequences lie one behind the other.

    Sequences are cut into runs that go side by side, so a long one takes no
    more steps than a run: the runs' transfer matrices give the odds with which
    each begins.
    """
    runs = -(-sizes // run)
    begins = np.cumsum(runs) - runs
    of = np.repeat(np.arange(len(sizes)), runs)
    number = np.arange(len(of)) - begins[of]
    at, size = first[of] + run * number, np.minimum(run, sizes[of] - run * number)
    before = np.zeros(len(of))
    inner = np.flatnonzero(number < runs[of] - 1)
    if len(inner):
        m = np.zeros((len(of), 2, 2))
        m[inner] = _transferred(s, at[inner], number[inner] == 0, run, trans, start)
        odds = np.ones(len(sizes))
        for j in range(int(runs.max()) - 1):
            long = np.flatnonzero(runs > j + 1)
            x, o = m[begins[long] + j], odds[long]
            odds[long] = (x[:, 0, 0] * o + x[:, 0, 1]) / (x[:, 1, 0] * o + x[:, 1, 1])
            before[begins[long] + j + 1] = np.log(odds[long])
    order = np.argsort(-size, kind="stable")
    at, x, opening, size = at[order], before[order], number[order] == 0, size[order]
    out = np.zeros(len(s))
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))  # runs longer than k
        x = x[:n]
        step = np.logaddexp(x + trans[1, 1], trans[0, 1]) - np.logaddexp(x + trans[1, 0], trans[0, 0])
        if k == 0:
            step[opening[:n]] = start
        x = out[at[:n] + k] = s[at[:n] + k] + step
    return out


def forward_backward(model: Model, scores: list[np.ndarray], run: int = RUN) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per sequence the log odds that forward and backward messages give each token."""
    sizes = np.array([len(x) for x in scores], np.int64)
    first, s = np.cumsum(sizes) - sizes, np.concatenate([np.zeros(0), *scores])
    f = _messages(s, first, sizes, model.trans, model.start, run)
    # from behind it is the same with transitions turned round; its messages hold the token's own score
    last = len(s) - first - sizes
    b = _messages(s[::-1], last, sizes, model.trans.T, 0.0, run)[::-1] - s
    cuts = first[1:]
    return np.split(f, cuts) if len(scores) else [], np.split(b, cuts) if len(scores) else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_clean(model: Model, forward: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Per token what it takes from the logarithm of the probability that no tag of its document is 1."""
    step = np.where(last, 0.0, model.trans[1, 0] - model.trans[0, 0])
    return -np.logaddexp(0, forward + step)


def document_features(clean: float, tokens: int) -> tuple[float, float, float]:
    """One, the evidence against a clean document and tokens, on log scales: long texts hold more chance likenesses."""
    return 1.0, math.log(1e-6 - clean), math.log1p(tokens)


def document_score(model: Model, clean: float, tokens: int) -> float:
    return float(_sigmoid(np.dot(model.layer, document_features(clean, tokens))))


class Sample:
    """Documents as numbered words, with their features."""

    def __init__(self, texts: list[str], labels: list[int]):
        tokens = [(_WORD.findall(t), y) for t, y in zip(texts, labels)]
        tokens = [(w, y) for w, y in tokens if w]
        words: dict[str, int] = {}
        for t, _ in tokens:
            for w in t:
                words.setdefault(w, len(words))
        self.names = {f: i for i, f in enumerate(sorted(self._frequent([t for t, _ in tokens])))}
        at = [[self.names[f] for f in features(w) if f in self.names] for w in words]
        self.word = np.repeat(np.arange(len(words)), [len(x) for x in at])
        self.feature = np.array([i for x in at for i in x], np.int64)
        # the last number stands for features that are left out
        self.before, self.after = (np.array([self.names.get(beside(w)[k], len(self.names)) for w in words], np.int64) for k in (0, 1))
        self.words = len(words)
        self.ids = np.array([words[w] for t, _ in tokens for w in t], np.int64)
        self.labels = np.array([y for _, y in tokens], float)
        sizes = np.array([len(t) for t, _ in tokens], np.int64)
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.last = np.zeros(len(self.ids), bool)
        self.last[self.first + sizes - 1] = True
        self.inner = np.flatnonzero(~np.isin(np.arange(len(self.ids)), self.first))

    @staticmethod
    def _frequent(tokens: list[list[str]]) -> set[str]:
        """Features in SEEN_IN documents or more; a word's three are counted as one, and no rare one's name is put together."""
        words, begins, shapes = Counter(), Counter(), Counter()
        for t in tokens:
            own = {(w, w.lower()) for w in set(t)}
            lower = {x for _, x in own}
            words.update(lower)
            begins.update({x[:n] for x in lower for n in BEGINNINGS if len(x) >= n})
            shapes.update({shape(w, x) for w, x in own})
        often = lambda seen: (x for x, n in seen.items() if n >= SEEN_IN)
        return {f"{kind}={x}" for x in often(words) for kind in ("w", "before", "after")} | {f"p{len(x)}={x}" for x in often(begins)} | {f"h={x}" for x in often(shapes)}

    def likelihood(self, params: np.ndarray, weight: np.ndarray, model: Model) -> tuple[float, np.ndarray]:
        """The documents' log likelihood, each at its weight, and its gradient.

        The gradient of log P(clean) is what the tagging of zeros holds less
        what all taggings hold on average; the other label's follows from it.
        """
        n = len(self.names)
        w = np.append(params[:n], 0.0)
        model.bias, model.start, model.trans = params[n], params[n + 1], params[n + 2 :].reshape(2, 2)
        t, k = model.trans, self.inner
        s = model.bias + np.bincount(self.word, w[self.feature], self.words)[self.ids]
        s[k] += w[self.before[self.ids[k - 1]]]
        s[k - 1] += w[self.after[self.ids[k]]]
        f, b = (np.concatenate(x) for x in forward_backward(model, np.split(s, self.first[1:])))
        clean = np.exp(np.add.reduceat(log_clean(model, f, self.last), self.first))
        right = 1 - 2 * WRONG
        is_toxic = self.labels == 1
        chance = np.where(is_toxic, WRONG + right * (1 - clean), WRONG + right * clean)
        pull = weight * right * clean * np.where(is_toxic, -1, 1) / chance
        error = -pull[self.doc] * _sigmoid(f + b)
        x, z = f[k - 1], s[k] + b[k]
        pair = np.stack([t[0, 0] + 0 * x, t[0, 1] + z, t[1, 0] + x, t[1, 1] + x + z])
        pair = np.exp(pair - pair.max(0))
        expected = (pair / pair.sum(0) * pull[self.doc[k]]).sum(1).reshape(2, 2)
        observed = np.array([[pull[self.doc[k]].sum(), 0.0], [0.0, 0.0]])
        by_word = np.bincount(self.ids, error, self.words)
        grad = np.bincount(self.feature, by_word[self.word], n + 1)
        grad += np.bincount(self.before[self.ids[k - 1]], error[k], n + 1) + np.bincount(self.after[self.ids[k]], error[k - 1], n + 1)
        return float((weight * np.log(chance)).sum()), np.concatenate([grad[:n], [error.sum(), error[self.first].sum()], (observed - expected).ravel()])


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Model:
    """Fit on documents by Adam, both classes weighing the same; then the document layer. One class alone leaves the model untrained."""
    model, sample = Model(), Sample(texts, labels)
    y, n = sample.labels, len(sample.names)
    if not 0 < y.sum() < len(y):
        return model
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    params = np.zeros(n + 6)
    params[n] = -math.log(sample.sizes.mean()) - 1  # about one tag in three documents
    ridge = np.full(n + 6, RIDGE)
    ridge[n] = 0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        grad = sample.likelihood(params, weight, model)[1] - ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights = {f: float(params[i]) for f, i in sample.names.items() if abs(params[i]) >= LEAST}
    model.bias, model.start, model.trans = float(params[n]), float(params[n + 1]), params[n + 2 :].reshape(2, 2)
    x, y = np.array([document_features(c, len(p)) for p, c in tagged(model, texts)]), np.array(labels, float)
    layer, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(25):  # Newton steps of a logistic regression
        p = _sigmoid(x @ layer)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ layer)
        layer = layer + step / max(1.0, float(np.abs(step).max()))
    model.layer = tuple(float(v) for v in layer)
    return model


def tagged(model: Model, texts: list[str | None], emissions: Emissions | None = None) -> list[tuple[np.ndarray, float]]:
    """Of each text the probability that each token is toxic, and the logarithm of the probability that none is."""
    scores = (emissions or Emissions(model)).of([_WORD.findall(t or "") for t in texts])
    out = []
    for x, y in zip(*forward_backward(model, scores)):
        last = np.zeros(len(x), bool)
        last[-1:] = True
        out.append((_sigmoid(x + y), float(log_clean(model, x, last).sum())))
    return out


def _scorer(model: Model, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(model)
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                ids, texts = pdf["doc_id"].iloc[k : k + 512], pdf["text"].iloc[k : k + 512].tolist()
                found = tagged(model, texts, emissions)
                score = [document_score(model, clean, len(p)) for p, clean in found]
                spans = [[{"start": x.start(), "end": x.end()} for x, q in zip(_WORD.finditer(t), p) if q > 0.5] if (p > 0.5).any() else [] for t, (p, _) in zip(texts, found)]
                yield pd.DataFrame({"doc_id": ids.to_numpy(), "score": score, "predicted": [int(x >= threshold) for x in score], "spans": spans})

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts outside the held-out fold: at most `rows` of each class, by a hash of the id."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(C.crc_mod(F.col("doc_id"), folds) != held_out)
    picked = []
    for y in (0, 1):
        picked += [(r["doc_id"], y) for r in usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if not picked:
        return []
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, y int")  # 2 * rows at most
    text = docs.select(F.col("doc_id"), F.col("text")).filter(F.col("text").isNotNull() & (F.octet_length("text") <= most))
    return [(r["text"], r["y"]) for r in text.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, score, predicted, spans (character offsets of toxic tokens).

    Only text is an input of a score. Null and empty texts have no spans and
    the score of no expected toxic tokens. Repeated rows are scored each. Without
    usable labels every score is the untrained model's. An empty table gives
    an empty result.
    """
    C.small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, "toxic", FOLDS, HELD_OUT)
    model = train([t for t, _ in sample], [y for _, y in sample]) if sample else Model()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scorer(model, threshold), SCORED)
