"""Toxicity by weak supervision.

Many voters look at a text: terms of a lexicon (whole words and word beginnings) and
patterns. A generative label model with one hidden class per text estimates, without
labels, how often each voter fires in either class and how voters hang together within a
class; it starts from the voters' rates among labelled texts and is fitted by expectation
maximisation over counts of vote patterns, every iteration one aggregate on the cluster. Voters that repeat each other share their weight.
A logistic regression on the votes is then trained on the posteriors.

Labels serve one purpose: terms are mined from a bounded sample of labelled texts, with the
rates the model starts from. A term must prove itself in both halves of the sample.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import fields, forget, keep, scratch

#: Labelled texts that terms are mined from, about; texts the classifier is trained on, about.
LABELLED_ROWS = 20_000
TRAINING_ROWS = 50_000
#: Mined terms, at most, and what a term must show: toxic texts it is in, and the share of toxic ones among all texts it is in.
TERMS = 48
LEAST_TEXTS = 4
#: Least log-likelihood ratio; among some hundred thousand terms, chance seldom gives as much.
LEAST_SURPRISE = 24.0
#: Low: how much a weak voter is worth, the label model finds out.
LEAST_PRECISION = 0.5
#: A beginning that errs more often than this gives way to longer ones that err less, if they are in this share of its toxic texts.
LEAST_ERROR = 0.05
COVERED = 0.8
#: Terms the voters are picked among, at most.
CANDIDATES = 5_000
#: Lengths of word beginnings that may become terms.
BEGINNINGS = range(4, 9)
#: The label model is done when no rate moves by more than this share, or after so many iterations.
SETTLED = 1e-3
ITERATIONS = 30
#: Share of toxic texts in which no term is found; votes alone cannot tell.
BLIND = 0.05
ACCEPT = 0.7

#: Terms that vote whether mined or not.
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless")
#: Patterns that vote.
PATTERNS = {
    "masked": r"\b[a-z]\*{2,}[a-z]*",
    "you_are": r"\byou(?:'re| are) (?:a|an|so|such)\b",
    "bursts": r"!{3,}",
}
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never looked at."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class Voters:
    """Whole words, word beginnings and patterns; at most 62 in all, so that votes fit a long.

    ``rates``: (toxic, clean) share of the labelled texts that a term is in, where counted.
    """

    words: list[str]
    beginnings: list[str]
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.names = [*self.words, *[f"{b}*" for b in self.beginnings], *PATTERNS]
        if len(self.names) > 62:
            raise ValueError("at most 62 voters")

    def functions(self):
        """Tests of a lower-case text. A plain search comes first; most terms are nowhere in most texts."""
        tests = [(w, re.compile(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])")) for w in self.words]
        tests += [(b, re.compile(rf"(?<![^\W\d_]){re.escape(b)}")) for b in self.beginnings]
        needs = {"masked": "**", "you_are": "you", "bursts": "!!!"}
        return tests + [(needs[n], re.compile(p)) for n, p in PATTERNS.items()]


def votes_of(text: str | None, tests) -> tuple[int, int]:
    """(votes as bits, texts places where terms were found) of one text."""
    low = (text or "").lower()
    bits = hits = 0
    for k, (needed, test) in enumerate(tests):
        if needed in low and (n := len(test.findall(low))):
            bits |= 1 << k
            hits += n
    return bits, hits


def _parts(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n}


def _texts_with(texts: DataFrame, terms: list[str]) -> list[tuple[list[int], int]]:
    """(places of the terms in a text, number of such texts) of the sampled toxic texts."""
    place = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[t] for t in _parts(text) if t in place) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["terms"])

    rows = texts.select("text").mapInArrow(run, "terms array<int>").where(F.size("terms") > 0).groupBy("terms").count()
    return [(r["terms"], r["count"]) for r in rows.collect()]  # at most one row per sampled toxic text


def _too_short(ranked: list[str], errors: dict[str, float], inside: list[list[int]]) -> set[int]:
    """Beginnings whose toxic texts nearly all hold a longer term, itself or by its beginning, that errs less than half as often."""
    by_name = sorted(range(len(ranked)), key=lambda k: ranked[k].rstrip("*"))
    names = [ranked[k].rstrip("*") for k in by_name]
    out = set()
    for k, term in enumerate(ranked):
        if term.endswith("*") and errors[term] > LEAST_ERROR and inside[k]:
            at = bisect_left(names, term[:-1])
            held: set[int] = set()
            while at < len(names) and names[at].startswith(term[:-1]):
                if errors[ranked[by_name[at]]] <= errors[term] / 2:
                    held.update(inside[by_name[at]])
                at += 1
            if len(held.intersection(inside[k])) >= COVERED * len(inside[k]):
                out.add(k)
    return out


def _pick(ranked: list[str], worth: dict[str, float], errors: dict[str, float], found: list[tuple[list[int], int]]) -> list[str]:
    """Terms by their worth times the texts they are the first in, while those are enough; then by rank."""
    inside: list[list[int]] = [[] for _ in ranked]
    for row, (places, _) in enumerate(found):
        for k in places:
            inside[k].append(row)
    new = [sum(found[row][1] for row in rows) for rows in inside]
    done = [False] * len(found)
    chosen: list[str] = []

    def covered(term: str) -> bool:
        bare = term.rstrip("*")
        return any(c.endswith("*") and bare.startswith(c[:-1]) for c in chosen) or any(c.rstrip("*").startswith(bare) for c in chosen)

    open_ = set(range(len(ranked))) - _too_short(ranked, errors, inside)
    while len(chosen) < TERMS:
        enough = [k for k in open_ if new[k] >= LEAST_TEXTS]
        if not enough:
            break
        k = max(enough, key=lambda k: (new[k] * worth[ranked[k]], -k))
        open_.discard(k)
        if covered(ranked[k]):
            continue
        chosen.append(ranked[k])
        for row in inside[k]:
            if not done[row]:
                done[row] = True
                for other in found[row][0]:
                    new[other] -= found[row][1]
    for k in sorted(open_):
        if len(chosen) < TERMS and not covered(ranked[k]):
            chosen.append(ranked[k])
    return chosen


def _sampled(hashed: Column, rows: int, n: int) -> Column:
    """Whether a row is in a sample of about ``rows`` of ``n`` rows, by its hash; fine enough for any table."""
    return F.pmod(hashed, F.lit(1 << 48)) < int(min(1.0, rows / max(n, 1)) * (1 << 48))


def mine_terms(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Voters:
    """Voters from labelled texts outside the held-out third; about ``rows`` of them, chosen by a hash of the id.

    Terms rank by the log-likelihood ratio of their counts in toxic and other texts. First
    come those that are worth most in toxic texts no earlier one is in, so that a small
    vocabulary gets its voters too; then the best of the others. Terms that a better one
    already covers are left out.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    known = known.where(_sampled(F.xxhash64("__id"), rows, known.count()))
    half = F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(2)).alias("__half")
    texts = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__id")).select("text", "__toxic", half)
    names = ["term", "bad0", "bad1", "good0", "good1"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter() for _ in names[1:]]
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counter = found[fold if toxic else 2 + fold]
                counter.update(_parts(text))
                counter[""] += 1
        terms = sorted(set().union(*found))
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[t] for t in part], pa.int64()) for c in found]], names=names)

    counted = texts.mapInArrow(count, "term string, bad0 long, bad1 long, good0 long, good1 long")
    counted = counted.groupBy("term").agg(*[F.sum(n).alias(n) for n in names[1:]])
    counted = counted.withColumns({"bad": F.col("bad0") + F.col("bad1"), "good": F.col("good0") + F.col("good1")})
    at = scratch(docs.sparkSession, "terms")
    counted = keep(counted.where((F.col("bad") >= LEAST_TEXTS) | (F.col("term") == "")), at)
    total = counted.where("term = ''").first()
    chosen: list[str] = []
    rates: dict[str, tuple[float, float]] = {}
    if total is not None and total["bad"]:
        bad, good = total["bad"], max(total["good"], 1)
        both = F.col("bad") + F.col("good")
        surprise = 2 * (
            F.col("bad") * F.log(F.col("bad") * (bad + good) / (both * bad))
            + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") * (bad + good) / (both * good))).otherwise(0.0)
        )
        best = counted.where("term != ''").withColumn("surprise", surprise)
        for fold in "01":
            seen = F.col(f"bad{fold}") + F.col(f"good{fold}")
            best = best.where((F.col(f"bad{fold}") > 0) & (F.col(f"bad{fold}") >= LEAST_PRECISION * seen))
        best = best.where(F.col("surprise") >= LEAST_SURPRISE)
        order = [F.desc("surprise"), F.col("term").endswith("*"), F.desc(F.length("term")), "term"]
        best = best.orderBy(*order).limit(CANDIDATES).collect()
        # Log odds: a beginning that half the clean texts share is worth little beside the words it begins.
        worth = {r["term"]: math.log((r["bad"] + 0.5) / (r["good"] + 0.5) * good / bad) for r in best}
        errors = {r["term"]: r["good"] / (r["bad"] + r["good"]) for r in best}
        chosen = _pick([r["term"] for r in best], worth, errors, _texts_with(texts.where("__toxic > 0"), list(worth)))
        rates = {r["term"]: ((r["bad"] + 0.5) / (bad + 1), (r["good"] + 0.5) / (good + 1)) for r in best if r["term"] in chosen}
    forget(docs.sparkSession, at)
    words = list(dict.fromkeys([*[t for t in chosen if not t.endswith("*")], *LEXICON]))
    beginnings = [t[:-1] for t in chosen if t.endswith("*")]
    words = [w for w in words if not any(w.startswith(b) for b in beginnings)]
    return Voters(words, beginnings, rates)


def cast_votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, votes (bits) and hits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = voters.functions()
        for batch in batches:
            found = [votes_of(t, tests) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([b for b, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())],
                names=["doc_id", "votes", "hits"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"{fields(docs, 'doc_id')}, votes long, hits long")


def _matrix(votes: np.ndarray, m: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(m)) & 1).astype(np.float64)


@dataclass
class LabelModel:
    """What is known of the voters.

    share: toxic texts; bad, good: how often each voter fires in either class; ties: correlation
    of two voters among toxic texts beyond what their rates explain; silent: clean texts in
    which no voter fires.
    """

    share: float
    bad: np.ndarray
    good: np.ndarray
    ties: np.ndarray
    silent: float
    terms: int

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic. A voter that does not fire abstains; those that fire with others tied to them share their say."""
        x = _matrix(votes, len(self.bad))
        say = (x * np.log(self.bad / self.good) / (1 + x @ self.ties)).sum(axis=1)
        say = say + np.where(votes & self.terms == 0, math.log(BLIND / self.silent), 0.0)
        return 1 / (1 + np.exp(-np.clip(math.log(self.share / (1 - self.share)) + say, -50, 50)))


def _moments(patterns: DataFrame, model: LabelModel) -> tuple[float, float, float, np.ndarray, np.ndarray]:
    """Weight of either class and of silent clean texts, and voters x voters sums of joint votes in either class."""
    m = len(model.bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 + 2 * m * m)
        for batch in batches:
            votes, n = batch.column("votes").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            x, p = _matrix(votes, m), model.posterior(votes)
            total[2] += (n * (1 - p))[votes & model.terms == 0].sum()
            for k, w in enumerate((n * p, n * (1 - p))):
                total[k] += w.sum()
                total[3 + k * m * m : 3 + (k + 1) * m * m] += ((x * w[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["at", "sum"])

    rows = patterns.mapInArrow(run, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum"))
    total = np.zeros(3 + 2 * m * m)
    for at, value in rows.collect():  # 3 + 2 * voters ** 2 rows
        total[at] = value
    return total[0], total[1], total[2], total[3 : 3 + m * m].reshape(m, m), total[3 + m * m :].reshape(m, m)


def fit_label_model(votes: DataFrame, voters: Voters, iterations: int = ITERATIONS) -> LabelModel:
    """Accuracies and correlations of the voters over all rows of ``votes``, from the rates counted on labels."""
    m = len(voters.names)
    at = scratch(votes.sparkSession, "patterns")
    patterns = keep(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), at)
    term = np.arange(m) < m - len(PATTERNS)
    bits = (1 << (m - len(PATTERNS))) - 1
    begun = [voters.rates.get(name, (0.2, 0.002) if t else (0.05, 0.04)) for name, t in zip(voters.names, term, strict=True)]
    a, b = (np.array(r) for r in zip(*begun, strict=True))
    model = LabelModel(0.1, np.maximum(a, b), b, np.zeros((m, m)), 0.9, bits)
    for _ in range(iterations):
        n_bad, n_good, silent, bad, good = _moments(patterns, model)
        if not n_bad + n_good:
            break
        a, b = (np.clip((np.diag(j) + 0.5) / (n + 10), 1e-7, 1 - 1e-7) for n, j in ((n_bad, bad), (n_good, good)))
        spread = np.sqrt(np.outer(a * (1 - a), a * (1 - a)))
        ties = np.clip((bad / max(n_bad, 1.0) - np.outer(a, a)) / spread, 0, 1)
        np.fill_diagonal(ties, 0)
        # Chance alone gives a correlation of about one over the root of the texts.
        ties[ties < 4 / math.sqrt(n_bad + 1)] = 0
        share = min(max(n_bad / (n_bad + n_good), 1e-4), 0.5)
        # A voter that fires no more often in toxic texts says nothing.
        before, model = model, LabelModel(share, np.maximum(a, b), b, ties, min(max(silent / max(n_good, 1.0), 0.05), 1.0), bits)
        if all(np.allclose(getattr(model, p), getattr(before, p), rtol=SETTLED, atol=1e-6) for p in ("share", "bad", "good", "ties")):
            break
    forget(votes.sparkSession, at)
    return model


def _features(votes: np.ndarray, hits: np.ndarray, m: int) -> np.ndarray:
    return np.concatenate([_matrix(votes, m), np.log1p(hits.astype(np.float64))[:, None], np.ones((len(votes), 1))], axis=1)


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray

    def score(self, votes: np.ndarray, hits: np.ndarray) -> np.ndarray:
        logit = _features(votes, hits, len(self.voters.names)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def train(votes: DataFrame, voters: Voters, model: LabelModel, rows: int = TRAINING_ROWS, penalty: float = 1e-5) -> Classifier:
    """Logistic regression of the posteriors on the votes, over about ``rows`` rows outside the held-out third."""
    usable = votes.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    chosen = usable.where(_sampled(F.xxhash64("doc_id", F.lit(5)), rows, usable.count()))
    # Equal rows weigh together, so what reaches the driver is at most the sample.
    sample = chosen.groupBy("votes", "hits").agg(F.count(F.lit(1)).alias("n")).toArrow()
    m = len(voters.names)
    weights = np.zeros(m + 2)
    if sample.num_rows:
        v, h = sample.column("votes").to_numpy(), sample.column("hits").to_numpy()
        n = sample.column("n").to_numpy().astype(np.float64)
        n /= n.sum()
        x, y = _features(v, h, m), model.posterior(v)
        pull = np.full(m + 2, penalty)
        pull[-1] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
            slope = x.T @ (n * (p - y)) + pull * weights
            curve = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull + 1e-9)
            step = np.linalg.solve(curve, slope)
            weights = weights - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
    return Classifier(voters, weights)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, DataFrame]:
    """(classifier, stored votes of all documents)."""
    voters = mine_terms(docs, labels)
    votes = keep(cast_votes(docs, voters), scratch(docs.sparkSession, "votes"))
    return train(votes, voters, fit_label_model(votes, voters)), votes


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if score >= ``ACCEPT``).

    ``labels``: doc_id, toxic. A null text is an empty one; it gets the score of a text in
    which no voter fires. A null doc_id is not held out. Without usable labels the fixed
    lexicon votes alone. Repeated rows are scored each; an empty table gives no rows.
    """
    classifier, votes = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classifier.score(batch.column("votes").to_numpy(), batch.column("hits").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    scored = votes.mapInArrow(run, f"{fields(votes, 'doc_id')}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below ``ACCEPT``, with all their columns."""
    classifier, _ = learn(docs, labels)
    columns, own = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    text = own[[c.lower() for c in columns].index("text")]
    plain = docs.toDF(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = classifier.voters.functions()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [votes_of(t, tests) for t in batch.column(text).to_pylist()]
            scores = classifier.score(np.array([b for b, _ in found], dtype=np.int64), np.array([h for _, h in found]))
            yield batch.filter(pa.array(scores < ACCEPT))

    return plain.mapInArrow(run, plain.schema).toDF(*columns)


def crc_third(doc_id: int) -> int:
    """The remainder ``held_out`` looks at, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3
