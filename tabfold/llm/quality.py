"""Quality classifier: a weak-label model over heuristic labellers and a hashed
linear scorer trained on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.llm.common import dropped, set_aside, stored, with_text

OWN = ["p_low", "p_toxic", "rejected"]
BITS = 16  #: the scorer has 2 ** BITS weights
SAMPLE = 10_000  #: documents that a scorer is trained on, about; never over twice as many
LABELLED = 10_000  #: annotated documents that the lexicon is drawn from, about; never over twice as many
GOOD, BAD, ABSTAIN = 0, 1, 2

#: insults, two overlapping lists of ordinary words
INSULTS_A = frozenset("idiot moron stupid dumb loser trash scum fool imbecile dimwit jerk vermin filth".split())
INSULTS_B = frozenset("pathetic worthless disgusting clown trash scum loser ugly despicable repulsive creep freak vile".split())
EDGES = ".,;:!?'\"()[]…«»„“”*#$%&|"
_SYMBOLS = re.compile(r"[#$%&*@^~=_<>{}\\]{2,}")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PLAIN = _LETTERS + b"0123456789 \n\t\r"


@dataclass
class Reading:
    """What labellers and scorer see of a whole text."""

    words: int
    symbols: float  # runs of symbols, each per word
    shouts: float
    bars: float
    upper: float  # share of letters
    marks: float  # share of characters that are no letter, digit or white space
    top: float  # share of the commonest word
    again: float  # share of words that repeat the word before
    run: int  # longest run of one word, where the share before is over 0.01
    names: set[str]  # distinct lower-case words, without punctuation at their ends
    hits: int = 0  # names and starts of names that are in the lexicon


def read(text: str) -> Reading:
    raw, words = text.encode(errors="replace"), text.lower().split()
    n, letters, counts = max(1, len(words)), len(raw) - len(raw.translate(None, _LETTERS)), Counter(words)
    again = sum(map(eq, words, words[1:])) / n
    run = max(sum(1 for _ in g) for w, g in groupby(words) if w != "|") if again > 0.01 and set(counts) != {"|"} else 1
    return Reading(len(words), len(_SYMBOLS.findall(text)) / n, text.count("!!") / n, text.count("|") / n,
                   (len(raw) - len(raw.translate(None, _UPPER))) / max(1, letters), len(raw.translate(None, _PLAIN)) / max(1, len(raw)),
                   max(counts.values(), default=0) / n, again, run, {w.strip(EDGES) for w in counts})


def starts(names: set[str]) -> set[str]:
    """Starts of four and five letters of longer names, marked as such."""
    return {w[:4] + "-" for w in names if len(w) > 4} | {w[:5] + "-" for w in names if len(w) > 5}


def vote(bad: bool, good: bool = False) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


#: labellers by aspect: each votes good, bad or abstains. The last of each aspect is
#: the annotation of a document, where the table of labels has one.
LABELLERS = {
    "low": [
        lambda r: vote(r.symbols > 0.04),
        lambda r: vote(r.shouts > 0.04),
        lambda r: vote(r.bars > 0.04),
        lambda r: vote(r.words >= 20 and r.upper > 0.4, r.upper < 0.15),
        lambda r: vote(r.words >= 20 and r.marks > 0.08, r.marks < 0.05),
        lambda r: vote(r.words >= 20 and r.top > 0.3),
        lambda r: vote(r.words >= 20 and r.again > 0.2, r.again < 0.05),
        lambda r: vote(r.run >= 5, r.run < 3),
    ],
    "toxic": [
        lambda r: vote(not INSULTS_A.isdisjoint(r.names)),
        lambda r: vote(not INSULTS_B.isdisjoint(r.names)),
        lambda r: vote(r.hits >= 1, r.hits == 0),
        lambda r: vote(r.hits >= 3),
    ],
}


def pattern(r: Reading, aspect: str) -> int:
    """The votes as digits of base 3, the first labeller's lowest."""
    return sum(f(r) * 3 ** i for i, f in enumerate(LABELLERS[aspect]))


def features(r: Reading, bits: int = BITS) -> list[int]:
    """Hashed features of a text, each once: words, starts of words, binned signals."""
    names = r.names | starts(r.names)
    shares = ("upper", r.upper), ("marks", r.marks), ("top", r.top), ("again", r.again)  # of few words they say little
    for name, x in (("symbols", r.symbols), ("shouts", r.shouts), ("bars", r.bars), *(shares if r.words >= 20 else ())):
        names |= {f"{name} > {cut}" for cut in (0, 0.01, 0.04, 0.08, 0.15, 0.2, 0.4) if x > cut}
    names |= {f"insults >= {k}" for k in (1, 2) if len(r.names & (INSULTS_A | INSULTS_B)) >= k} | {f"run >= {k}" for k in (3, 5) if r.run >= k} | {f"hits >= {k}" for k in (1, 3) if r.hits >= k}
    mask = (1 << bits) - 1
    return list({crc32(w.encode(errors="replace")) & mask for w in names})


@dataclass
class LabelModel:
    """Dawid-Skene model of one aspect: share of bad documents and, for each class
    and labeller, the distribution of its votes."""

    prior: float
    votes: np.ndarray  # class, labeller, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = patterns[:, None] // 3 ** np.arange(self.votes.shape[1]) % 3
        like = np.log(self.votes[:, np.arange(v.shape[1]), v]).sum(axis=2)  # class, pattern
        odds = like[BAD] - like[GOOD] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeller: share of right votes among its votes, as estimated."""
        p = np.array([1 - self.prior, self.prior])[:, None]
        right = p[0] * self.votes[GOOD, :, GOOD] + p[1] * self.votes[BAD, :, BAD]
        return right / (p * (1 - self.votes[:, :, ABSTAIN])).sum(axis=0)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns, from the start that
    labellers are better than chance. Counts are smoothed by half a document, so no
    vote is impossible."""
    start = np.array([[0.9, 0.02, 0.08], [0.4, 0.5, 0.1]])
    model = LabelModel(0.1, np.repeat(start[:, None], labellers, axis=1))
    v = patterns[:, None] // 3 ** np.arange(labellers) % 3
    hot = (v[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        p = model.posterior(patterns)
        weight = np.array([(1 - p) * counts, p * counts])
        votes = np.einsum("cp,plv->clv", weight, hot) + 0.5 * start[:, None]
        new = LabelModel(float(np.clip((weight[BAD].sum() + 0.05) / (counts.sum() + 0.5), 1e-6, 1 - 1e-6)), votes / votes.sum(axis=2, keepdims=True))
        done = abs(new.votes - model.votes).max() < 1e-7
        model = new
        if done:
            break
    return model


def fit_scorer(rows: list[np.ndarray], p: np.ndarray, bits: int = BITS, rounds: int = 60, ridge: float = 2.0, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over binary hashed features, fitted to
    the posteriors ``p`` as soft labels by Adagrad on the whole sample; a row counts
    ``times`` times."""
    n, size = len(rows), 1 << bits
    times = np.ones(n) if times is None else times
    total, bad = times.sum(), (p * times).sum()
    w, bias = np.zeros(size), float(np.log((bad + 0.5) / (total - bad + 0.5)))
    if not n:
        return w, -20.0
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    g2 = np.full(size, 1e-2)
    for _ in range(rounds):
        z = np.bincount(of, weights=w[at], minlength=n) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - p) * times
        g = np.bincount(at, weights=err[of], minlength=size) + ridge * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        bias -= 0.5 * float(err.sum() / total)
    return w, bias


@dataclass
class Classifier:
    lexicon: frozenset[str]
    models: dict[str, LabelModel]
    scorers: dict[str, tuple[np.ndarray, float]]


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(k, 256) for k in range(0, b.num_rows, 256))


def up_to(rows: int, of: int, *columns: str):
    """Condition that picks about ``rows`` of ``of`` rows by a hash of columns."""
    return F.pmod(F.xxhash64(F.lit(10), *columns), F.lit(1 << 40)) < F.lit(int(min(1.0, rows / max(1, of)) * (1 << 40)))


def annotations(labels: DataFrame, key: str) -> DataFrame:
    """One row a key (name, low, toxic): votes, bad if any of the key's rows says so;
    abstaining where the label is null."""
    of = lambda bad: F.coalesce(F.when(F.max(bad), BAD).otherwise(GOOD) + F.when(F.max(bad).isNull(), 1).otherwise(0) * 2, F.lit(ABSTAIN)).cast("long")
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("name")).agg(of(F.col("quality") == 0).alias("says_low"), of(F.col("toxic") == 1).alias("says_toxic"))


def draw_lexicon(docs: DataFrame, labels: DataFrame, key: str, text: str, labelled: int) -> frozenset[str]:
    """Words and word starts that mark toxic documents in a sample of about
    ``labelled`` annotated ones (at most twice as many): in five at least, and thirty
    times as frequent as in the others."""
    said = annotations(labels, key).where(f"says_toxic <> {ABSTAIN}")
    some = said.where(up_to(labelled, said.count(), "name")).limit(2 * labelled).select("name", (F.col("says_toxic") == BAD).alias("bad"))
    sample = docs.join(F.broadcast(some), F.col(key) == some["name"]).select("bad", F.col(text).cast("string").alias("text")).limit(2 * labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            names = [read(t or "").names for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(n | starts(n) | {""}) for n in names], pa.list_(pa.string()))], names=["bad", "names"])

    found = sample.mapInArrow(run, "bad boolean, names array<string>").select("bad", F.explode("names").alias("w"))
    counts = stored(found.groupBy("w").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")), "words")
    total = counts.where("w = ''").first()  # every text has the empty name
    lexicon = frozenset()
    if total and total["b"]:
        rate = (F.col("b") / total["b"]) > 30 * (F.col("g") + 0.5) / max(1, total["g"])
        lexicon = frozenset(r["w"] for r in counts.where(rate & (F.col("b") >= 5) & (F.col("w") != "")).select("w").collect())
    dropped(counts)
    return lexicon


def fit_classifier(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, labelled: int = LABELLED, bits: int = BITS) -> Classifier:
    """Label models from the votes on all documents (only counts of vote patterns
    reach the driver, at most 3 ** 9 an aspect); scorers from about ``sample``
    distinct texts at most, picked by hash, each with its number of copies; the lexicon
    of two labellers from about ``labelled`` annotated documents. ``labels`` (key,
    quality, toxic; 0, 1 or null) may cover some documents or none; its rows for a
    key that repeats count as bad if any is."""
    aspects, lexicon = list(LABELLERS), draw_lexicon(docs, labels, key, text, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            rows, lists = [], []
            for t, take in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                r = with_hits(read(t or ""), lexicon)
                rows.append([pattern(r, a) for a in aspects])
                lists.append(features(r, bits) if take else None)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[i] for x in rows], pa.int64()) for i in range(len(aspects))), pa.array(lists, pa.list_(pa.int32()))], names=["key", *aspects, "features"])

    schema = "key long, " + ", ".join(f"{a} long" for a in aspects) + ", features array<int>"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), up_to(sample, docs.count(), text).alias("take"))
    seen = stored(rows.mapInArrow(run, schema), "votes")
    said = annotations(labels, key)
    voted = seen.join(said, seen.key == said.name, "left")
    width = {a: len(LABELLERS[a]) + 1 for a in aspects}
    voted = voted.select("features", *[(F.col(a) + F.coalesce(f"says_{a}", F.lit(ABSTAIN)) * 3 ** (width[a] - 1)).alias(a) for a in aspects])
    voted = stored(voted, "votes")
    models = {}
    for a in aspects:
        counts = voted.groupBy(a).count().orderBy(a).collect()
        models[a] = fit_label_model(np.array([r[a] for r in counts], np.int64), np.array([r["count"] for r in counts], float), width[a])
    # copies of a text with equal votes are one row; all copies are picked or none
    taken = voted.where("features is not null").groupBy("features", *aspects).count().toArrow()
    lists = [np.asarray(x, np.int64) for x in taken["features"].to_numpy()] if taken.num_rows else []
    times = taken["count"].to_numpy().astype(float)
    scorers = {a: fit_scorer(lists, models[a].posterior(taken[a].to_numpy()), bits, times=times) for a in aspects}
    dropped(seen)
    dropped(voted)
    return Classifier(lexicon, models, scorers)


def with_hits(r: Reading, lexicon: frozenset[str]) -> Reading:
    r.hits = len(r.names & lexicon) + len(starts(r.names) & lexicon) if lexicon else 0
    return r


def classify(docs: DataFrame, classifier: Classifier, text: str = "text", threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """``docs`` with p_low, p_toxic and rejected (either is at least ``threshold``).

    Defined cases: a null or empty text has no features but the bias, so it is kept
    where most documents are; very long texts are read whole; repeated rows each
    come back, with the same result; an empty table gives no rows; input columns
    named like the result's come back as ``<name>_in``.
    """
    docs = set_aside(docs, OWN)
    names, aspects = docs.columns, list(LABELLERS)
    rows, at_text = with_text(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((classifier.lexicon, classifier.scorers))  # 2 ** bits weights an aspect

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, scorers = shared.value
        for part in in_slices(batches):
            p = {a: np.zeros(part.num_rows) for a in aspects}
            for i, t in enumerate(part.column(at_text).to_pylist()):
                at = np.array(features(with_hits(read(t or ""), lexicon), bits), np.int64)
                for a, (w, bias) in scorers.items():
                    p[a][i] = w[np.sort(at)].sum() + bias
            p = {a: 1 / (1 + np.exp(-np.clip(x, -500, 500))) for a, x in p.items()}
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(p["low"]), pa.array(p["toxic"]),
                                              pa.array((p["low"] >= threshold) | (p["toxic"] >= threshold))], names=[*names, *OWN])

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("p_low double, p_toxic double, rejected boolean").fields])
    return rows.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier, fitted on ``docs``, does not reject, with
    their columns unchanged."""
    judged = classify(docs, fit_classifier(docs, labels, key, text), text, threshold)
    kept = judged.where(judged[judged.columns[-1]] == F.lit(False))
    return kept.drop(*judged.columns[-len(OWN):]).toDF(*docs.columns)
