"""Toxicity by weak supervision.

1. Words and word beginnings of a bounded sample of labelled rows give a vocabulary; those that lean strongly to
   one side become lexicon and pattern voters, together with a small general lexicon.
2. A generative label model with a hidden class explains which voters fire.  Expectation and maximisation run in
   Spark over the distinct vote patterns of all documents: how often a voter fires in either class is its
   accuracy, and the pairs that fire together within the toxic class give correlations.  Voters that move
   together share one vote.  Labelled rows of the learning folds hold their class.
3. A linear classifier learns the posterior labels of a bounded sample and scores every document.  Its base is
   raised where the labelled rows of the learning folds show that more of the toxic ones can be found at little loss.

Labels are read only from rows outside the held-out fold; language, source, id and label never enter a score.
Null and empty texts score as texts without words.  Rows with equal ids get their own scores, a null id is never
held out.  With no labelled row, the general lexicon votes alone.  Words are whole texts split at white space, whatever
their length.  An empty table gives no rows; further columns are kept by ``drop_toxic`` and unread by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import frugal, text_of
from lonja.session import written

#: Bounds of what is fitted on the driver; everything else covers all documents.
TOXIC_SAMPLE, CLEAN_SAMPLE, TRAIN_SAMPLE = 4000, 8000, 12000
VOCABULARY, VOTERS = 2048, 200
ROUNDS, SMOOTH = 6, 1.0
SURE = 12.0  # log-likelihood ratio from which a mark counts; chance reaches it once in 2000 times
TOGETHER = 0.6  # correlation within the toxic class from which voters share a vote
LABEL_TRUST = 0.97
THRESHOLD = 0.7
STEP, CLEAN_LOSS = 0.02, 10.0  # of the histogram of scores; the share of clean rows lost against that of toxic rows found
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")
BEGINNINGS = (4, 5, 6)
EDGES = ".,;:!?|#*$%&\"'()[]{}<>-_"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def marks(text: str) -> set[str]:
    """The distinct words of a text in lower case, and their beginnings with a star."""
    words = {x.strip(EDGES) for x in set(text.lower().split())}
    words.discard("")
    found = set(words)
    for size in BEGINNINGS:
        found.update(x[:size] + "*" for x in words if len(x) >= size)
    return found


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(marks(x)) for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.list_(pa.string()))], ["toxic", "marks"])


def sample_labels(labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """At most so many labelled rows of each class, the first by a hash of the id."""
    learn = labels.filter("toxic in (0, 1)").filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return (learn.filter("toxic = 1").orderBy(*order).limit(toxic_rows)
            .unionByName(learn.filter("toxic = 0").orderBy(*order).limit(clean_rows)))


def surprise(t: Column, c: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of a mark's counts in both classes against one common rate."""
    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    total = n_toxic + n_clean
    both = (t + c) / total
    return 2 * (cell(t, both * n_toxic) + cell(c, both * n_clean) +
                cell(n_toxic - t, (1 - both) * n_toxic) + cell(n_clean - c, (1 - both) * n_clean))


def vocabulary(docs: DataFrame, sample: DataFrame, size: int = VOCABULARY, voters: int = VOTERS) -> tuple[list[str], list[int]]:
    """Marks that tell the classes apart, and the positions of those that vote."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", text_of().alias("text"))
    rows = written(texts.mapInArrow(frugal(_marks), "toxic int, marks array<string>"), "toxic-marks")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    found = []
    if n_toxic and n_clean:
        counts = rows.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(
            F.sum("toxic").alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
        lift = F.log(((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1)))
        scored = counts.select("mark", "t", "c", lift.alias("lift"), surprise(F.col("t"), F.col("c"), n_toxic, n_clean).alias("z"))
        found = scored.filter(F.col("z") >= SURE).orderBy(F.desc("z"), "mark").limit(size).collect()
    names = [r["mark"] for r in found]
    names += [x for x in LEXICON if x not in set(names)]
    place = {x: i for i, x in enumerate(names)}
    votes = {place[x] for x in LEXICON}
    # a voter is rare among clean texts; how often it was seen counts only through its surprise, so that the marks of
    # a small language vote too
    good = [r for r in found if r["lift"] > 2.5]
    votes.update(place[r["mark"]] for r in sorted(good, key=lambda r: -r["z"])[:voters])
    return names, sorted(votes)


class Finder:
    """Finds the marks of a vocabulary in whole texts; what a token has is remembered within bounds."""

    def __init__(self, names: list[str]):
        self.whole = {x: i for i, x in enumerate(names) if not x.endswith("*")}
        self.starts = {size: {x[:-1]: i for i, x in enumerate(names) if x.endswith("*") and len(x) == size + 1} for size in BEGINNINGS}
        self.cached: dict[str, tuple[int, ...]] = {}

    def _token(self, token: str) -> tuple[int, ...]:
        word = token.strip(EDGES)
        found = [self.whole[word]] if word in self.whole else []
        found += [table[word[:size]] for size, table in self.starts.items() if len(word) >= size and word[:size] in table]
        return tuple(found)

    def find(self, text: str) -> list[int]:
        tokens = set((text or "").lower().split())
        if len(self.cached) > 150_000:
            self.cached.clear()
        for token in tokens.difference(self.cached):
            self.cached[token] = self._token(token)
        return sorted(set().union(*map(self.cached.__getitem__, tokens)))


def present(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, held_out and the sorted positions of the vocabulary's marks in each whole text."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            rows = [finder.find(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "held_out", "marks"])

    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), fold, "text").mapInArrow(frugal(look), "doc_id long, held_out boolean, marks array<int>")


@dataclass
class LabelModel:
    """For each voter how often it fires in either class, and its share of a vote; the prior of the toxic class."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> float:
        silent = np.log((1 - self.toxic) / (1 - self.clean)) * self.share
        return float(np.log(self.prior / (1 - self.prior)) + silent.sum())

    @property
    def weight(self) -> np.ndarray:
        fires = np.log(self.toxic / self.clean) - np.log((1 - self.toxic) / (1 - self.clean))
        return fires * self.share

    def posterior(self, fired: Column, label: Column | None = None) -> Column:
        found = sigmoid(linear(fired, self.weight, self.base))
        if label is None:
            return found
        return F.when(label == 1, LABEL_TRUST).when(label == 0, 1 - LABEL_TRUST).otherwise(found)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear(positions: Column, weights: np.ndarray, base: float) -> Column:
    table = F.lit([float(x) for x in weights]) if len(weights) else F.array().cast("array<double>")
    return F.aggregate(positions, F.lit(float(base)), lambda acc, i: acc + F.get(table, i))


def fit_labels(votes: DataFrame, n_voters: int, rounds: int = ROUNDS) -> LabelModel:
    """Fit to ``votes`` (fired array<int>, label int or null).  Its distinct patterns are counted once."""
    patterns = written(votes.groupBy("fired", "label").agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model = LabelModel(0.1, np.full(n_voters, 0.2), np.full(n_voters, 0.01), np.ones(n_voters))
    total = patterns.agg(F.sum("n")).first()[0] or 0
    if not total or not n_voters:
        return model
    for turn in range(rounds):
        weighted = patterns.withColumn("p", model.posterior(F.col("fired"), F.col("label")) * F.col("n"))
        toxic = weighted.agg(F.sum("p")).first()[0]
        fired = weighted.select(F.explode("fired").alias("v"), "p", "n").groupBy("v").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        in_toxic, in_all = np.zeros(n_voters), np.zeros(n_voters)
        for r in fired:
            in_toxic[r["v"]], in_all[r["v"]] = r["p"], r["n"]
        model.prior = float(np.clip((toxic + SMOOTH) / (total + 2 * SMOOTH), 0.001, 0.5))
        model.toxic = np.clip((in_toxic + SMOOTH) / (toxic + 2 * SMOOTH), 1e-4, 1 - 1e-4)
        model.clean = np.clip((in_all - in_toxic + SMOOTH * 0.1) / (total - toxic + 2 * SMOOTH), 1e-6, 1 - 1e-4)
        if turn == 0:  # the first posteriors fix which voters move together
            model.share = shares(weighted, toxic, model.toxic)
    return model


def shares(weighted: DataFrame, toxic: float, rate: np.ndarray) -> np.ndarray:
    """One over the number of voters that each voter moves with; pairs are counted in Spark, voters squared at most."""
    both = weighted.select(F.explode("fired").alias("a"), "fired", "p").select("a", F.explode("fired").alias("b"), "p")
    table = np.zeros((len(rate), len(rate)))
    for r in both.groupBy("a", "b").agg(F.sum("p").alias("p")).collect():
        table[r["a"], r["b"]] = r["p"] / max(toxic, 1e-9)
    spread = np.sqrt(rate * (1 - rate))
    correlation = (table - np.outer(rate, rate)) / np.maximum(np.outer(spread, spread), 1e-12)
    np.fill_diagonal(correlation, 1.0)
    return 1 / (correlation >= TOGETHER).sum(axis=1)


def fit_classifier(rows: list, size: int, steps: int = 400, l2: float = 1.5e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by gradient steps with momentum; both classes weigh the same."""
    if not rows or not size:
        return np.zeros(size), -4.0
    lengths = np.array([len(r["marks"]) for r in rows])
    columns = np.concatenate([np.asarray(r["marks"], dtype=np.int64) for r in rows]) if lengths.sum() else np.zeros(0, np.int64)
    index = np.repeat(np.arange(len(rows)), lengths)
    target = np.array([r["p"] for r in rows])
    toxic = min(max(target.mean(), 1e-3), 1 - 1e-3)
    weight = (target / toxic + (1 - target) / (1 - toxic)) / (2 * len(rows))
    weights, base = np.zeros(size), 0.0
    speed, base_speed = np.zeros(size), 0.0
    scale = 1 / np.sqrt(np.bincount(columns, weights=weight[index], minlength=size) + 1e-3)
    for _ in range(steps):
        score = base + np.bincount(index, weights=weights[columns], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target) * weight
        slope = np.bincount(columns, weights=error[index], minlength=size) + l2 * weights
        speed = 0.9 * speed - 0.5 * slope * scale
        base_speed = 0.9 * base_speed - 0.5 * error.sum()
        weights += speed
        base += base_speed
    return weights, base


def raise_of_base(rows: DataFrame, threshold: float = THRESHOLD) -> float:
    """How much to add to the scores ``z`` (log-odds) of labelled rows so that the threshold finds most.

    The best cut has the largest share of toxic rows above it less ``CLEAN_LOSS`` times that of clean rows; of equal
    ones the highest.  It never lies above the threshold, since the rows are those that the marks were chosen on.
    Spark counts a histogram of at most some thousand bins.
    """
    most = float(np.log(threshold / (1 - threshold)))
    place = F.round(F.greatest(F.least(F.col("z"), F.lit(20.0)), F.lit(-20.0)) / STEP).cast("int")
    bins = rows.groupBy(place.alias("place")).agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c")).collect()
    bins = sorted(bins, key=lambda r: -r["place"])
    toxic, clean = np.cumsum([r["t"] for r in bins]), np.cumsum([r["c"] for r in bins])
    if not bins or not toxic[-1] or not clean[-1]:
        return 0.0
    best = int(np.argmax(toxic / toxic[-1] - CLEAN_LOSS * clean / clean[-1]))
    return max(most - (bins[best]["place"] - 0.5) * STEP, 0.0)


@dataclass
class Fitted:
    """The vocabulary, the classifier over it, the label model over its voters, and the marks of all documents."""

    names: list[str]
    weights: np.ndarray
    base: float
    labels: LabelModel
    rows: DataFrame


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_SAMPLE) -> Fitted:
    sample = written(sample_labels(labels.select("doc_id", "toxic"), TOXIC_SAMPLE, CLEAN_SAMPLE), "toxic-sample")
    names, voters = vocabulary(docs, sample)
    order = {v: i for i, v in enumerate(voters)}
    to_vote = F.lit([order.get(i, -1) for i in range(len(names))])
    fired = F.filter(F.transform("marks", lambda i: F.get(to_vote, i)), lambda v: v >= 0)
    rows = written(present(docs, names).withColumn("fired", fired), "toxic-present")
    known = F.broadcast(sample.withColumnRenamed("toxic", "label"))  # at most TOXIC_SAMPLE + CLEAN_SAMPLE rows
    voted = rows.join(known, "doc_id", "left")
    model = fit_labels(voted.select("fired", "label"), len(voters))

    learn = voted.filter("not held_out").withColumn("p", model.posterior(F.col("fired"), F.col("label")))
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    likely = learn.filter("p >= 0.5").orderBy(*first).limit(train_rows // 2).select("marks", "p")
    unlikely = learn.filter("p < 0.5").orderBy(*first).limit(train_rows // 2).select("marks", "p")
    weights, base = fit_classifier(likely.unionByName(unlikely).collect(), len(names))
    base += raise_of_base(learn.filter("label is not null").select("label", linear(F.col("marks"), weights, base).alias("z")))
    return Fitted(names, weights, base, model, rows)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_SAMPLE) -> DataFrame:
    """doc_id, held_out, score, and the posterior of the label model."""
    found = fit(docs, labels, train_rows)
    return found.rows.select("doc_id", "held_out", sigmoid(linear(F.col("marks"), found.weights, found.base)).alias("score"),
                             found.labels.posterior(F.col("fired")).alias("posterior"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    found = fit(docs, labels)
    names, weights, base, most = found.names, found.weights, found.base, float(np.log(threshold / (1 - threshold)))

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in batches:
            keep = [base + sum(weights[i] for i in finder.find(x)) < most for x in batch["text"].to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(stay), docs.schema)
