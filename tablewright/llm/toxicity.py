"""Toxicity: a counterfactual-regularised classifier.

A sentence's logit is a bias plus the weights of its words (the whole word and
its first four, five and six letters, hashed; none far below 0, so that harmless
words around an insult cannot hide it); a document's score follows its most
toxic sentence.  Labels are per document, so training alternates: the
sentence of each toxic document that scores highest is its toxic one (first
by log-odds), all sentences of the other documents are clean, and a logistic
regression is fitted to them.

Beside the log loss it is penalised for what depends on *who* is named: for
labelled sentences an identity term is swapped for another of its kind, or for
a neutral word, and the squared change of the score is added to the loss.
Sentences that name nobody get a term to swap.  So a group's name that is
frequent in toxic documents does not by itself make a neutral mention toxic.
The terms are a parameter: the short list here, or those of a table
(``terms_of``) for the groups and languages of a corpus.

``fit`` uses a bounded sample of labelled rows (``PER_LABEL`` of each label).
Null and empty texts score as a sentence without words.  Without usable labels
of both kinds every score is the share of label 1 (0.5 without any).  Rows are
scored one by one; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts
from .labelled import Sample, held_out, sample
from .token_counts import slices

# Identity terms by kind; any of a kind may be swapped for another. The first word of each kind is neutral.
IDENTITY_TERMS = (
    ("people", "muslims", "christians", "jews", "buddhists", "hindus", "atheists", "catholics"),
    ("person", "woman", "man", "girl", "boy", "lesbian", "gay", "transgender", "straight"),
    ("person", "black", "white", "asian", "african", "european", "latino", "arab", "indian"),
    ("person", "immigrant", "refugee", "foreigner", "disabled", "blind", "deaf", "old", "young"),
    ("Menschen", "Muslime", "Christen", "Juden", "Frauen", "Männer", "Ausländer", "Schwule", "Lesben"),
    ("gens", "musulmans", "chrétiens", "juifs", "femmes", "hommes", "étrangers", "noirs", "blancs"),
    ("gente", "musulmanes", "cristianos", "judíos", "mujeres", "hombres", "extranjeros", "negros", "blancos"),
)

FEATURES = 2**18
PER_LABEL = 1500
LONGEST = 8  # words of a sentence; a longer one is cut
ENDS = frozenset(b".!?")
ROUNDS = 2
STEPS = 80
PENALTY = 1.0
MOST_TERMS = 20_000
RIDGE = 0.2
LEAST = -0.1  # of a weight


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Parts(dict):
    """word (bytes) -> its four hashed parts."""

    def __missing__(self, word: bytes) -> tuple[int, int, int, int]:
        if len(self) >= 300_000:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip(string.punctuation)
        hashed = [xxhash.xxh3_64_intdigest(f"{k}:{plain[:k] if k else plain}".encode()) % FEATURES for k in (0, 4, 5, 6)]
        value = self[word] = tuple(hashed)
        return value


PARTS = Parts()


def sentences(words: list[bytes]) -> np.ndarray:
    """First word of each sentence: runs up to a word that ends in . ! or ?, cut after LONGEST words."""
    if not words:
        return np.zeros(0, np.int64)
    end = np.fromiter((w[-1] in ENDS for w in words), bool, len(words))
    first = np.flatnonzero(np.r_[True, end[:-1]])
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))
    return np.flatnonzero(place % LONGEST == 0)


def once(words: list[bytes]) -> list[bytes]:
    """Without words that repeat the one before."""
    return [w for w, before in zip(words, [b"", *words]) if w != before]


class Sentences:
    """Words of many texts as numbers (``word``, flat), their parts (``parts``, by number), sentences and documents."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        flat, starts, docs, total = [], [], [], 0
        for i, text in enumerate(texts):
            words = once(text.split())
            first = sentences(words)
            flat += [number.setdefault(w, len(number)) for w in words]
            starts.append(first + total)
            docs.append(np.full(len(first), i))
            total += len(words)
        self.word = np.array(flat, np.int64)
        self.parts = np.array([PARTS[w] for w in number], np.int32).reshape(-1, 4)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0)
        return np.add.reduceat(weights[self.parts].sum(axis=1)[self.word], self.starts)

    def lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, len(self.word)])


class Model:
    def __init__(self, terms=IDENTITY_TERMS):
        self.terms = terms
        self.weights, self.bias = np.zeros(FEATURES), 0.0
        self.scale = (1.0, 0.0)
        self.prior: float | None = None
        self._known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def train(self, labelled: Sample, penalty: float = PENALTY, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 6) -> None:
        y = np.array(labelled.labels)
        if len(set(labelled.labels)) < 2:
            self.prior = float(y.mean()) if len(y) else 0.5
            return
        own = Sentences(labelled.texts)
        toxic = y[own.doc] == 1
        self.weights = self._log_odds(own, y)
        for _ in range(rounds):
            s = own.sums(self.weights)
            order = np.lexsort((-s, own.doc))
            best = order[np.r_[True, own.doc[order][1:] != own.doc[order][:-1]]] if len(order) else order
            used = ~toxic
            used[best] = True  # of clean documents all sentences, of toxic ones the most toxic
            self._logistic(own, used, toxic, penalty, steps, np.random.default_rng(seed))
        self._calibrate(self.raw(labelled.texts), y, np.array(labelled.weights))

    def _log_odds(self, own: Sentences, y: np.ndarray) -> np.ndarray:
        """Of a part standing in a toxic document against a clean one."""
        doc = np.repeat(own.doc, own.lengths())
        seen = np.unique(doc * len(own.parts) + own.word)
        seen = np.unique((seen // len(own.parts))[:, None] * np.int64(FEATURES) + own.parts[seen % len(own.parts)])
        label, part = y[seen // FEATURES], seen % FEATURES
        in_toxic = np.bincount(part[label == 1], minlength=FEATURES)
        in_clean = np.bincount(part[label == 0], minlength=FEATURES)
        return np.log((in_toxic + 2) / ((y == 1).sum() + 4)) - np.log((in_clean + 2) / ((y == 0).sum() + 4))

    def _logistic(self, own: Sentences, used: np.ndarray, toxic: np.ndarray, penalty: float, steps: int, r) -> None:
        lengths = own.lengths()
        word, n_words = own.word[np.repeat(used, lengths)], len(own.parts)
        starts = np.r_[0, np.cumsum(lengths[used])[:-1]]
        target, sizes = toxic[used].astype(float), lengths[used]
        # clean sentences are many; together they weigh five times the toxic ones
        share = np.where(target == 1, 1.0, min(1.0, 5 * target.sum() / max((1 - target).sum(), 1)))
        term, swap, holds = self._swaps(own.parts[:, 0][word], starts, r)
        # a bound of the curvature by weight: steps of gradient / bound never overshoot, for rare and frequent parts alike
        to_parts = lambda by_word: np.bincount(own.parts.ravel(), np.repeat(by_word, 4), FEATURES)
        bound = RIDGE + to_parts(np.bincount(word, np.repeat(0.25 * share * (4 * sizes + 1), sizes), n_words))
        for parts in (term, swap):
            bound += np.bincount(parts.ravel(), np.repeat(penalty * share, 4), FEATURES)
        bound_b = (0.25 * share * (4 * sizes + 1)).sum()
        w, b = np.zeros(FEATURES), 0.0
        last_w, last_b = w, b
        for step in range(1, steps + 1):
            ahead = (step - 1) / (step + 2)  # Nesterov's momentum
            w, last_w = w + ahead * (w - last_w), w
            b, last_b = b + ahead * (b - last_b), b
            s = np.add.reduceat(w[own.parts].sum(axis=1)[word], starts) + b
            error = (_sigmoid(s) - target) * share
            g = to_parts(np.bincount(word, np.repeat(error, sizes), n_words)) + RIDGE * w
            # the sentence with its term and with the other one; only the terms' weights answer for the change
            own_term = w[term].sum(axis=1)
            base = s - np.where(holds, own_term, 0)
            p, q = _sigmoid(base + own_term), _sigmoid(base + w[swap].sum(axis=1))
            change = 2 * penalty * share * (p - q)
            for parts, slope in ((term, change * p * (1 - p)), (swap, -change * q * (1 - q))):
                g += np.bincount(parts.ravel(), np.repeat(slope, 4), FEATURES)
            w = np.maximum(w - g / bound, LEAST)
            b = b - error.sum() / bound_b
        self.weights, self.bias = w, float(b)
        self._known = {}

    def _swaps(self, whole: np.ndarray, starts: np.ndarray, r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per sentence an identity term (its own, or one put in), another of its kind, and whether the term is its own."""
        if not self.terms:  # nothing to swap: a sentence without the term is compared with itself
            none = np.zeros((len(starts), 4), np.int32)
            return none, none, np.zeros(len(starts), bool)
        parts = [np.array([PARTS[t.encode()] for t in kind]) for kind in self.terms]
        kind = r.integers(0, len(parts), len(starts))
        place = np.array([r.integers(0, len(self.terms[k])) for k in kind], np.int64)
        holds = np.zeros(len(starts), bool)
        at = {int(p[0]): (k, i) for k, kinds in enumerate(parts) for i, p in enumerate(kinds) if i}
        for word in np.flatnonzero(np.isin(whole, list(at))):
            sentence = np.searchsorted(starts, word, "right") - 1
            kind[sentence], place[sentence] = at[int(whole[word])]
            holds[sentence] = True
        size = np.array([len(k) for k in self.terms])[kind]
        other = (place + 1 + (r.random(len(starts)) * (size - 1)).astype(np.int64)) % size
        pick = lambda i: np.array([parts[k][j] for k, j in zip(kind, i)], np.int32).reshape(-1, 4)
        return pick(place), pick(other), holds

    def _calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Scale and shift of the raw document logits, by Newton steps on the weighted log loss."""
        x = np.c_[raw, np.ones(len(raw))]
        theta = np.array([1.0, 0.0])
        for _ in range(50):
            p = _sigmoid(x @ theta)
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.05 * (theta - (1.0, 0.0)))
            theta = theta - np.clip(step, -1, 1)
        self.scale = (float(theta[0]), float(theta[1]))

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Logit of the most toxic sentence of each text."""
        known, out = self._known, []
        for text in texts:
            words = once(text.split())
            if not words:
                out.append(self.bias)
                continue
            for w in set(words).difference(known):
                known[w] = float(self.weights[list(PARTS[w])].sum())
            weights = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            out.append(np.add.reduceat(weights, sentences(words)).max() + self.bias)
            if len(known) > 500_000:
                known.clear()
        return np.array(out)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return _sigmoid(self.scale[0] * self.raw(texts) + self.scale[1])


def terms_of(terms: DataFrame) -> tuple[tuple[str, ...], ...]:
    """Terms by kind of a table (kind, term), the neutral ones of a kind (column ``neutral``, where there is one) first.

    Null and empty terms, terms of several words, and kinds of fewer than two terms are left out.
    More than ``MOST_TERMS`` rows are refused, as the list goes to the driver.
    """
    neutral = F.coalesce(terms["neutral"].cast("boolean"), F.lit(False)) if "neutral" in terms.columns else F.lit(False)
    rows = (terms.select(terms["kind"].cast("string").alias("kind"), F.trim(terms["term"].cast("string")).alias("term"), neutral.alias("neutral"))
            .where(F.col("kind").isNotNull() & F.col("term").rlike(r"^\S+$"))
            .groupBy("kind", "term").agg(F.max("neutral").alias("neutral")).limit(MOST_TERMS + 1).collect())
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} identity terms")
    kinds: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], not r["neutral"], r["term"])):
        kinds.setdefault(r["kind"], []).append(r["term"])
    return tuple(tuple(own) for own in kinds.values() if len(own) > 1)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, penalty: float = PENALTY,
        terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    model = Model(terms)
    model.train(sample(docs, labels, "toxic", per_label), penalty)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            scores = [s for part in slices(texts) for s in shared.value.score(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return (ids_and_texts(docs).mapInArrow(run, "doc_id bigint, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
