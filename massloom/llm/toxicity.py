"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import written
from massloom.llm.quality import training_ids

#: Labelled rows that a fit reads at most, and lexicon voters that it makes at most.
MOST_ROWS, MOST_ENTRIES = 10_000, 400
#: Least G2 of a lexicon entry (one in a million by chance), toxic texts (in thousandths) that it needs, and times that these are the others.
LEAST_G2, LEAST_ROWS, PURE = 24.0, 3_000, 9
#: Letters of the word beginnings that are looked at.
SHORTEST, LONGEST = 3, 8
TEXT_BLOCK, CACHE = 1 << 20, 200_000
_words = re.compile(r"[^\W\d_]+").findall
_other = re.compile(r"[\W\d_]").search

#: Words of the fixed lexicon voters: fixed values.
LEXICONS = {
    "insult": "idiot moron imbecile stupid dumb loser fool clown jerk pathetic worthless useless idiota imbécil estúpido tonto imbécile stupide crétin débile dummkopf trottel blöd",
    "contempt": "scum trash garbage filth vermin disgusting disgrace vile basura escoria ordure racaille abschaum dreck ekelhaft",
    "threat": "kill die hurt destroy hang burn matar mourir tuer töten sterben",
}


def _capitals(text: str) -> tuple[int, int]:
    """Capital and small letters A to Z."""
    raw = text.encode("utf-8", "surrogatepass")
    return tuple(len(raw) - len(raw.translate(None, letters.encode())) for letters in (string.ascii_uppercase, string.ascii_lowercase))


def _shouts(text: str, n: int) -> bool:
    large, small = _capitals(text)
    return large > max(small, 20)


_addresses = re.compile(r"\b(?:[Yy]ou(?:'re| are)|[Dd]u bist|[Tt]u es|[Ee]res)\b").search

#: Pattern voters: each looks at the whole text and the number of its words.
PATTERNS: dict[str, Callable[[str, int], bool]] = {
    "shouting": _shouts,
    "exclaiming": lambda t, n: 5 * t.count("!!") > n > 0,
    "addressing": lambda t, n: _addresses(t) is not None,
    "tabular": lambda t, n: 3 * t.count("|") > n > 0,
    "linking": lambda t, n: "://" in t or "@" in t,
    "short": lambda t, n: n < 60,
    "long": lambda t, n: n > 1500,
}


def _parts(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, in lists of a bounded part of it each."""
    at = 0
    while at < len(text):
        cut = _other(text, at + TEXT_BLOCK)
        end = cut.start() if cut else len(text)
        yield _words(text[at:end].lower())
        at = end


def grams(word: str) -> list[str]:
    """What a lexicon entry may be: the whole word, and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class Voters:
    """Which voters speak on a text: entries of the mined lexicon, then fixed lexicons, then patterns, and ``quiet`` where no lexicon speaks; the rest abstain."""

    def __init__(self, entries: list[str]):
        self.names = [*entries, *LEXICONS, *PATTERNS, "quiet"]
        fixed = {w: len(entries) + k for k, said in enumerate(LEXICONS.values()) for w in said.split()}
        self.found = {e: [k] for k, e in enumerate(entries)}
        self.fixed, self.first_pattern = fixed, len(entries) + len(LEXICONS)
        self.cache: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        held = self.cache.get(word)
        if held is None:
            held = tuple(k for g in grams(word) for k in self.found.get(g, ()))
            if word in self.fixed:
                held += (self.fixed[word],)
            if len(self.cache) < CACHE:
                self.cache[word] = held
        return held

    def __call__(self, text: str) -> list[int]:
        spoke, n = set(), 0
        for words in _parts(text):
            n += len(words)
            for word in set(words):
                spoke.update(self.of_word(word))
        if not spoke:
            spoke.add(len(self.names) - 1)
        spoke.update(self.first_pattern + k for k, holds in enumerate(PATTERNS.values()) if holds(text, n))
        return sorted(spoke)

    def __reduce__(self):
        return Voters, (self.names[: self.first_pattern - len(LEXICONS)],)


@dataclass
class LabelModel:
    """A generative model of votes: class, then each voter that speaks given the class and at most one other voter.

    A voter that abstains says nothing, as it speaks on few texts of either class; the last voter speaks for the silence
    of the lexicons.
    """

    share: float  #: of toxic texts
    parent: np.ndarray  #: the voter that each voter depends on, or -1
    speaks: np.ndarray  #: [voter, class, whether the parent speaks]: probability that the voter speaks
    wrong: np.ndarray  #: [class]: probability that a given label is the other class
    accuracy: np.ndarray  #: [voter]: probability that a text on which it speaks is toxic

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability that a text is toxic, from its votes and its given label."""
        log = np.stack([np.log(1 - self.share) + np.log(np.where(label == 0, 1 - self.wrong[0], self.wrong[0])), np.log(self.share) + np.log(np.where(label == 1, 1 - self.wrong[1], self.wrong[1]))])
        for j, p in enumerate(self.parent):
            given = votes[:, p].astype(int) if p >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                log[y] += votes[:, j] * np.log(self.speaks[j, y][given])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _tree(votes: np.ndarray, post: np.ndarray, least: float) -> np.ndarray:
    """The parent of each voter in the forest of strongest dependences: conditional mutual information given the class, in nats a text, ``least`` or more. The last voter stands alone."""
    n, v = len(votes), votes.astype(np.float64)
    total = np.zeros((v.shape[1],) * 2)
    for w in (1 - post, post):
        m = w.sum() + 1e-9
        both = (v * w[:, None]).T @ v / m
        one = (v * w[:, None]).sum(0) / m
        cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): 1 - one[:, None] - one[None, :] + both}
        for (a, b), cell in cells.items():
            pa_, pb = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None, :]
            cell = np.maximum(cell, 0)
            total += m / n * np.where(cell > 1e-12, cell * np.log(np.maximum(cell, 1e-12) / np.maximum(pa_ * pb, 1e-12)), 0)
    np.fill_diagonal(total, 0)
    total[-1] = total[:, -1] = 0
    parent = np.full(len(total), -1)
    inside = np.zeros(len(total), bool)
    while not inside.all():  # grow one tree after the other, from the strongest edge out
        root = int(np.argmax(np.where(inside, -1, total.max(1))))
        inside[root] = True
        while True:
            edge = np.where(inside[:, None] & ~inside[None, :], total, -1)
            a, b = divmod(int(np.argmax(edge)), len(total))
            if edge[a, b] < least:
                break
            parent[b], inside[b] = a, True
    return parent


def label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, *, steps: int = 2, wrong: float = 0.02, least: float = 1e-3) -> tuple[LabelModel, np.ndarray]:
    """Fit by expectation maximisation; the model and the posterior of each text.

    The given labels count as one more voter, which always speaks and is wrong in about ``wrong`` of its votes (a prior
    worth as much as the texts, so that the classes stay those of the labels). From the posteriors of one
    step that takes voters for independent, the strongest dependences between voters are read off; the fit then estimates
    each voter's accuracy given the one that it depends on, so that voters which repeat each other do not count twice. It
    stops after ``steps`` steps: silence is left out of the likelihood, so more steps would trust the voters ever more.
    """
    parent = np.full(votes.shape[1], -1)
    model = None
    for rounds in (1, steps):
        post = np.where(label == 1, 1 - wrong, wrong)
        for _ in range(rounds):
            before, mass = post, weight.sum()
            share = (post @ weight + 1) / (weight.sum() + 2)
            speaks, errors = np.empty((votes.shape[1], 2, 2)), np.empty(2)
            for y, w in enumerate(((1 - post) * weight, post * weight)):
                errors[y] = (w @ (label != y) + mass * (share if y else 1 - share) * wrong) / (w.sum() + mass * (share if y else 1 - share))
                for given in (0, 1):
                    on = np.where(parent[None, :] < 0, given == 0, votes[:, parent] == bool(given))
                    speaks[:, y, given] = ((votes * on * w[:, None]).sum(0) + 0.1) / ((on * w[:, None]).sum(0) + 1)
            accuracy = (votes * (post * weight)[:, None]).sum(0) / np.maximum((votes * weight[:, None]).sum(0), 1e-9)
            model = LabelModel(float(share), parent, np.clip(speaks, 1e-4, 1 - 1e-4), np.clip(errors, 1e-4, 0.4), accuracy)
            post = model.posterior(votes, label)
            if np.abs(post - before).max() < 1e-4:
                break
        parent = _tree(votes, post, least) if rounds == 1 else parent
    return model, post


def linear(votes: np.ndarray, post: np.ndarray, weight: np.ndarray, *, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model of the posteriors, by Newton steps; only the bias goes unpenalised."""
    x = np.concatenate([votes, np.ones((len(votes), 1))], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    cost = np.full(len(w), ridge)
    cost[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(cost)
        step = np.linalg.solve(h, x.T @ (weight * (p - post)) + cost * w)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    labels: LabelModel | None = None

    def score(self, text: str) -> float:
        z = self.weights[self.voters(text)].sum() + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _mapped(rows: DataFrame, schema: str, rows_of: Callable) -> DataFrame:
    """(label, weight or sign, ...) rows of each text, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_of(batch)

    return rows.mapInArrow(run, schema)


def signed(sample: DataFrame) -> DataFrame:
    """label, text and weight (thousandths) of each sampled text: texts that share their least word hash, as near copies do, weigh as one."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        for k, text in enumerate(batch.column(1).to_pylist()):
            least = min((xxhash.xxh3_64_intdigest(w) for part in _parts(text or "") for w in set(part)), default=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([least >> 1], pa.int64())], ["label", "text", "sign"])

    same = Window.partitionBy("sign", "label")
    return _mapped(sample, "label int, text string, sign long", rows_of).withColumn("weight", F.floor(F.lit(1000) / F.count("*").over(same)).cast("long"))


def lexicon(sample: DataFrame, most: int = MOST_ENTRIES) -> list[str]:
    """Words and word beginnings that toxic texts of the sample hold far more often than others, strongest first.

    Counted by Spark over (text, gram) rows; at most ``most`` come back.
    """

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for label, weight, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            seen = {g for part in _parts(text or "") for w in set(part) for g in grams(w)}
            for at in range(0, len(seen := sorted(seen)), 1 << 16):
                part = seen[at : at + (1 << 16)]
                toxic = weight if label else 0
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic] * len(part), pa.int64()), pa.array([weight - toxic] * len(part), pa.int64())], ["gram", "toxic", "other"])

    rows = _mapped(sample.select("label", "weight", "text"), "gram string, toxic long, other long", rows_of)
    held = sample.agg(F.sum(F.when(F.col("label") > 0, F.col("weight"))), F.sum(F.when(F.col("label") <= 0, F.col("weight")))).first()
    if not held[0] or not held[1]:
        return []
    share = held[0] / (held[0] + held[1])
    counts = rows.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(F.col("toxic") >= LEAST_ROWS)
    n = F.col("toxic") + F.col("other")
    part = lambda c, p: F.when(c > 0, c * F.log(c / (n * p))).otherwise(0.0)
    g2 = 2 * (part(F.col("toxic"), share) + part(F.col("other"), 1 - share)) / 1000
    found = counts.filter(F.col("toxic") >= PURE * F.col("other")).withColumn("g2", F.round(g2, 6)).filter(F.col("g2") >= LEAST_G2)
    return [r["gram"] for r in found.orderBy(F.desc("g2"), F.length("gram"), "gram").select("gram").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows given; without both classes the model says their share.

    The lexicon is mined from the sample's labels (``lexicon``), all voters vote on its texts, the label model turns
    votes and labels into posteriors, and the linear model learns those from the votes. What comes to the driver is the
    lexicon and, for each text, the numbers of the voters that spoke.
    """
    wanted = training_ids(labels, id_col=id_col, label_col=label_col, most=most)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(wanted), "__id")
    sample = sample.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))  # of rows that repeat an id, one text whatever their order
    sample = written(signed(sample.select(F.col("__label").alias("label"), F.col("__text").alias("text"))), "toxicity-sample")
    voters = Voters(lexicon(sample))

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spoke = [voters(t or "") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spoke, pa.list_(pa.int32()))], ["label", "weight", "spoke"])

    rows = _mapped(sample.select("label", "weight", "text"), "label int, weight long, spoke array<int>", rows_of).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["spoke"], r["label"], r["weight"]))  # the same model however the rows arrive
    label = np.array([int(r["label"] > 0) for r in rows], np.int64)
    if not len(rows) or label.all() or not label.any():
        share = min(max(float(label.mean()) if len(rows) else 0.5, 0.01), 0.99)
        return Model(voters, np.concatenate([np.zeros(len(voters.names)), [np.log(share / (1 - share))]]))
    votes = np.zeros((len(rows), len(voters.names)), bool)
    for k, r in enumerate(rows):
        votes[k, r["spoke"]] = True
    weight = np.array([r["weight"] for r in rows]) / 1000
    model, post = label_model(votes, label, weight)
    return Model(voters, linear(votes, post, weight), model)


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1) of every row. Null texts count as empty and are scored too; repeated rows stay; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes, whatever the input
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
