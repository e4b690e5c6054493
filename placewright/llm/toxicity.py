"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

1. Voters. Words and beginnings of words that are dense where the label is toxic, in the training rows, are mined
   (counts are aggregated by Spark); each is a voter that says "toxic" where it makes up ``DENSE`` of the words.
   Patterns (shouting, masked words, runs of marks, ...) are voters too, and so are the share of all mined
   words, at two thresholds, and their absence.
2. Label model. Expectation maximisation estimates, for both classes, how often each voter fires, without
   taking the labels for true: a label is one more voter, whose accuracy is estimated as well. Voters are not taken for
   independent: those that depend most on each other within a class are tied to a tree (of greatest mutual
   information given the class, measured on the posteriors), and a voter's rates are those given its parent's vote.
   So a voter that repeats another brings no evidence of its own, however many there are.
3. Classifier. A logistic regression on the densities of the mined terms and on the patterns is fitted to the
   posteriors of 2. It scores every whole text; a document is one row, and nothing is shuffled for that.

Fitting uses a bounded sample, ``TRAINING_ROWS`` labelled rows with the least hashes of their ids, never one
whose crc32(doc_id) mod 5 is 0. Only that sample's densities and the few hundred terms reach the driver.

Defined cases: a null text is empty; an empty text gets the score of one without any sign; labels that
are null do not count, several labels of a document count by their mean; without labelled rows of both
classes every score is the smoothed share of toxic ones; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.tables import shipped

TRAINING_ROWS = 20_000
TERMS = 400
#: Share of a text's words from which a term is dense; words that are added to every text, so that one word of a
#: short text is no high share; and shares of mined words at which these vote together.
DENSE, PADDING, LEXICON = 0.002, 20, (0.005, 0.01)
#: Rows whose votes are handled at once.
ROWS = 2048
#: Dependence (nats) below which a voter has no parent, and rows that its rates given the parent are smoothed by.
LEAST_DEPENDENCE, SMOOTHING = 5e-4, 0.5
#: Lengths of word beginnings that are terms beside the words themselves.
BEGINNINGS = (4, 5, 6)
MIN_ROWS = 4
REMEMBERED_WORDS = 1 << 20
WORDS = re.compile(r"[^\W\d_]+")

#: Patterns that vote "toxic" where they make up more than a share of the text.
PATTERNS = {
    "shouting": (re.compile(r"\b[^\W\d_a-z]{4,}\b"), 0.3),
    "exclamations": (re.compile(r"!{2,}"), 0.02),
    "masked words": (re.compile(r"\b\w+[*#@$]{2,}\w*"), 0.01),
    "mixed marks": (re.compile(r"[!?*#@$%&]{3,}"), 0.02),
    "said to you": (re.compile(r"(?i)\b(?:you are|you're|shut up|go to hell|hate you)\b"), 0.0),
    "stretched": (re.compile(r"(\w)\1{3,}"), 0.01),
}


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def terms_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n]]


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def pattern_shares(text: str) -> list[float]:
    size = max(1, len(text))
    return [sum(len(m.group()) for m in pattern.finditer(text)) / size for pattern, _ in PATTERNS.values()]


class Vocabulary:
    """Mined terms; words are looked up once per task."""

    def __init__(self, terms: list[str]) -> None:
        self.terms, self.numbers = terms, {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], list[float], float]:
        """Numbers of the terms in a text, in order, their densities, and the share of words that have any."""
        words = words_of(text)
        size = len(words) + PADDING
        found: Counter[int] = Counter()
        any_ = 0
        for word, times in Counter(words).items():
            numbers = self.known.get(word)
            if numbers is None:
                if len(self.known) >= REMEMBERED_WORDS:
                    self.known.clear()
                numbers = self.known[word] = tuple(self.numbers[t] for t in terms_of(word) if t in self.numbers)
            for number in numbers:
                found[number] += times
            any_ += times if numbers else 0
        numbers = sorted(found)
        return numbers, [found[n] / size for n in numbers], any_ / size


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``label`` (0 to 1) of the training sample."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).dropna()
    marked = marked.where(~is_held_out("doc_id")).groupBy("doc_id").agg(F.avg("toxic").alias("label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(marked), "doc_id").select("text", "label")


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words, counts = words_of(text), Counter()
            for word, times in Counter(words).items():
                for term in terms_of(word):
                    counts[term] += times
            least = DENSE * (len(words) + PADDING)
            (toxic if label >= 0.5 else clean).update(t for t, n in counts.items() if n >= least)
    names = list(toxic.keys() | clean.keys())
    if names:  # a task without rows, or without words, has nothing to tell
        yield pd.DataFrame({"term": names, "toxic": [toxic[t] for t in names], "clean": [clean[t] for t in names]})


def mine_terms(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The terms whose density tells most for the toxic class, by smoothed log odds times the root of their rows."""
    counts = rows.mapInPandas(_term_counts, "term string, toxic long, clean long").groupBy("term")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= MIN_ROWS)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    counts = counts.withColumn("odds", odds).where(F.col("odds") > 1)
    best = counts.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(TERMS)
    return [r["term"] for r in best.select("term").collect()]


def _blocks(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    for start in range(0, len(x), ROWS):
        rows = slice(start, start + ROWS)
        yield rows, x[rows].astype(np.float64)


def dependence(votes: np.ndarray, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mutual information of every two voters given the class (nats), and the entropy of every voter given it."""
    n, m = votes.shape
    information, entropy = np.zeros((m, m)), np.zeros(m)
    for weight in (1 - posterior, posterior):
        both = np.zeros((m, m))
        for rows, x in _blocks(votes):
            both += (x * weight[rows, None]).T @ x
        mass = weight.sum() + 1
        one = (np.diag(both) + 0.5) / mass
        joint = {(1, 1): (both + 0.25) / mass}
        joint[1, 0] = np.maximum(one[:, None] - joint[1, 1], 1e-12)
        joint[0, 1] = np.maximum(one[None, :] - joint[1, 1], 1e-12)
        joint[0, 0] = np.maximum(1 - joint[1, 1] - joint[1, 0] - joint[0, 1], 1e-12)
        sides = {1: one, 0: np.maximum(1 - one, 1e-12)}
        for (a, b), p in joint.items():
            information += mass / n * p * np.log(p / (sides[a][:, None] * sides[b][None, :]))
        entropy -= mass / n * sum(p * np.log(p) for p in sides.values())
    np.fill_diagonal(information, 0)
    return np.maximum(information, 0), entropy


def tree(information: np.ndarray) -> np.ndarray:
    """The parent of every voter in a tree of greatest dependence, or -1 where nothing is left to tie it to."""
    m = len(information)
    parents, best, at = np.full(m, -1), np.full(m, -1.0), np.full(m, -1)
    outside = np.ones(m, bool)
    new = 0
    for _ in range(m):
        outside[new] = False
        if best[new] >= LEAST_DEPENDENCE:
            parents[new] = at[new]
        closer = outside & (information[new] > best)
        best[closer], at[closer] = information[new][closer], new
        if outside.any():
            new = int(np.where(outside, best, -2.0).argmax())
    return parents


def _evidence(votes: np.ndarray, parents: np.ndarray, posterior: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of class 1 per row, by rates estimated from the posteriors, and the rates in both classes."""
    m, has = votes.shape[1], parents >= 0
    one, both, mass = np.zeros((2, m)), np.zeros((2, m)), np.array([(1 - posterior).sum(), posterior.sum()])
    for rows, x in _blocks(votes):
        of_parents = np.where(has, x[:, parents], 0)
        for c, weight in enumerate((1 - posterior[rows], posterior[rows])):
            one[c] += weight @ x
            both[c] += weight @ (x * of_parents)
    rates = np.clip((one + 0.1) / (mass[:, None] + 1), 1e-4, 1 - 1e-4)
    with_parent = np.where(has, one[:, parents], 0)
    fired = np.clip((both + SMOOTHING * rates) / (with_parent + SMOOTHING), 1e-4, 1 - 1e-4)
    silent = np.clip((one - both + SMOOTHING * rates) / (mass[:, None] - with_parent + SMOOTHING), 1e-4, 1 - 1e-4)
    odds_fired, odds_silent = np.log(fired / (1 - fired)), np.log(silent / (1 - silent))
    # constant, own vote, parent's vote, both votes: what each adds to the log likelihood of class 1 over class 0
    constant = np.log(1 - silent).sum(1) @ [-1, 1]
    own = odds_silent[1] - odds_silent[0]
    above = np.log((1 - fired) / (1 - silent))
    above = np.where(has, above[1] - above[0], 0)
    joint = np.where(has, (odds_fired - odds_silent)[1] - (odds_fired - odds_silent)[0], 0)
    evidence = np.full(len(votes), np.log(prior[1] / prior[0]) + constant)
    for rows, x in _blocks(votes):
        of_parents = np.where(has, x[:, parents], 0)
        evidence[rows] += x @ own + of_parents @ above + (x * of_parents) @ joint
    return evidence, rates


def label_model(
    votes: np.ndarray, start: np.ndarray, rounds: int = 30, share: float | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 per row, each voter's rates in both classes, and how much of its vote is its own.

    ``votes`` is 0 or 1 for each row and voter, ``start`` the first guess at the posteriors, ``share`` that of class 1
    where it is known. A voter depends on the class and on its parent in the tree; the tree is drawn anew every ten rounds.
    """
    votes = np.asarray(votes, np.uint8)
    posterior = np.asarray(start, np.float64)
    parents, own = np.full(votes.shape[1], -1), np.ones(votes.shape[1])
    rates = np.zeros((2, votes.shape[1]))
    for round_ in range(rounds):
        if round_ % 10 == 0:
            information, entropy = dependence(votes, posterior)
            parents = tree(information)
            tied = np.zeros_like(information)
            children = np.flatnonzero(parents >= 0)
            least = np.minimum(entropy[children], entropy[parents[children]]) + 1e-9
            tied[children, parents[children]] = np.minimum(information[children, parents[children]] / least, 1)
            own = 1 / (1 + tied.sum(0) + tied.sum(1))
        toxic = (posterior.sum() + 1) / (len(posterior) + 2) if share is None else share
        evidence, rates = _evidence(votes, parents, posterior, np.array([1 - toxic, toxic]))
        posterior = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
    return posterior, rates, own


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 20) -> np.ndarray:
    """Newton steps for a ridge logistic regression on soft labels; the last weight is the constant."""
    n_weights = x.shape[1] + 1
    weights = np.zeros(n_weights)
    penalty = np.full(n_weights, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        slope, curve = penalty * weights, np.diag(penalty)
        for rows, part in _blocks(x):
            part = np.hstack([part, np.ones((len(part), 1))])
            p = 1 / (1 + np.exp(-np.clip(part @ weights, -30, 30)))
            slope += part.T @ (p - y[rows])
            curve += (part * (p * (1 - p))[:, None]).T @ part
        change = np.linalg.solve(curve, slope)
        weights -= change
        if np.abs(change).max() < 1e-6:
            break
    return weights


def densities_as_features(densities):
    """Roots spread the small densities, in which a sign differs from an accident."""
    return np.sqrt(50 * np.asarray(densities))


class Model:
    """A linear classifier over densities of mined terms, the share of mined words, pattern shares, and the constant."""

    def __init__(self, terms: list[str], weights: np.ndarray) -> None:
        self.vocabulary, self.weights = Vocabulary(terms), weights

    def score(self, text: str) -> float:
        n = len(self.vocabulary.terms)
        found, densities, lexicon = self.vocabulary(text)
        value = self.weights[-1] + np.dot(self.weights[found], densities_as_features(densities)) if found else self.weights[-1]
        value += np.dot(self.weights[n:-1], [densities_as_features(lexicon), *pattern_shares(text)])
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def _features(terms: list[str]):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            if not len(batch):
                continue
            found = [vocabulary(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "terms": [np.asarray(f[0], np.int32).tobytes() for f in found],
                    "densities": [np.asarray(f[1], np.float32).tobytes() for f in found],
                    "shares": [np.asarray([f[2], *pattern_shares(t)]).tobytes() for f, t in zip(found, batch["text"], strict=True)],
                    "label": batch["label"].to_numpy(),
                }
            )

    return features


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    counts = {bool(r["toxic"]): r["count"] for r in rows.groupBy((F.col("label") >= 0.5).alias("toxic")).count().collect()}
    n_toxic, n_clean = counts.get(True, 0), counts.get(False, 0)
    if not (n_toxic and n_clean):
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1) if n_toxic + n_clean else 0.0
        weights = np.append(np.zeros(1 + len(PATTERNS)), np.log(max(share, 1e-6) / (1 - min(share, 1 - 1e-6))))
        return Model([], weights)
    terms = mine_terms(rows, n_toxic, n_clean)
    sample = rows.mapInPandas(_features(terms), "terms binary, densities binary, shares binary, label double").toPandas()
    # sums must not depend on the order in which rows arrive
    sample = sample.sort_values(["label", "terms", "densities", "shares"]).reset_index(drop=True)
    dense = np.zeros((len(sample), len(terms)), np.float32)
    for i, (found, densities) in enumerate(zip(sample["terms"], sample["densities"], strict=True)):
        dense[i, np.frombuffer(found, np.int32)] = np.frombuffer(densities, np.float32)
    shares = np.frombuffer(b"".join(sample["shares"]), np.float64).reshape(len(sample), -1)
    label = sample["label"].to_numpy()
    del sample
    lexicon = shares[:, :1]
    fires = shares[:, 1:] > np.array([least for _, least in PATTERNS.values()])
    voters = [dense >= DENSE, fires, lexicon >= np.array(LEXICON), lexicon == 0, (label >= 0.5)[:, None]]
    votes = np.hstack([v.astype(np.uint8) for v in voters])
    del voters
    posterior, _, _ = label_model(votes, label, share=n_toxic / (n_toxic + n_clean))
    features = np.hstack([densities_as_features(dense), densities_as_features(lexicon), shares[:, 1:]]).astype(np.float32)
    return Model(terms, logistic_fit(features, posterior))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    shared = shipped(docs.sparkSession, fit(docs, labels))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [model.score(t) for t in batch["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInPandas(scored, "doc_id long, score double")
    return rows.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; texts are not shuffled."""
    shared = shipped(docs.sparkSession, fit(docs, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared()
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) < 0.5)
