"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text, all rates or small numbers (FEATURES): densities of two lexicons, second-person
proximity (lexicon hits with a word like "you" within NEAR words), capitals, punctuation,
and obfuscation (words that are a lexicon's only once digits, symbols, stretched or spaced
letters are undone). One lexicon is fixed, a short list of plain insults in four languages;
the other is learned: words and word beginnings (stems) which texts labelled 1
have and others don't, each chosen for texts that the terms before it don't explain (so words
that merely occur beside the telling ones aren't in it). Stems take words that no labelled text has.

Learning uses labelled rows alone, never those held out, and the distinct texts of about SAMPLE
ids of each label at most (a documented bound; which ones is decided by a hash of the id). They
are dealt to FOLDS by a hash of the text. The features of a fold come from a lexicon of the other
folds, so that the trees learn how far a lexicon holds beyond its own texts; all folds but the last
teach the trees, and the last, which they haven't seen, the isotonic curve. Documents are
scored with the lexicon of all folds. Texts weigh by the share that the sample took of their
label, so that scores are probabilities in the corpus.

Plan: the ids of the sample are broadcast (its bound) to the documents; the sample's equal texts meet by
hash; terms are counted in the tasks before they are shuffled. The trees and the curve are Spark's own
(GBTClassifier, IsotonicRegression), fit on a written table of features; scoring is one
map over the documents and Spark's model transforms, without a shuffle. The lexicon, at most
MOST_TERMS terms, and the trees are what tasks receive.

Defined results: null and empty texts have all features 0 and are scored. A null
id is not held out and has no label. A label that isn't 0 or 1 is none; of several
labels of an id, or of a text, the largest counts. Repeated rows are scored alike, each by itself. Where
a fold has texts of one label only or none, every row's score is the weighted share of label 1 among
the sample, 0 without any. Very long texts are read whole. An empty table gives an empty result. Only the id and the
results are returned, so extra columns don't clash.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash128, ready_for_python, slices

#: Labelled ids of each label that are learned from, about.
SAMPLE = 6000
#: Terms of the learned lexicon at most; texts of label 1 that must have a term; its least log-odds and least log-likelihood ratio.
MOST_TERMS, LEAST_TEXTS, LEAST_ODDS, LEAST_RATIO = 500, 3, 1.5, 9.0
#: Terms that are looked at for it.
CANDIDATES = 1500
#: Parts of the sample.
FOLDS = 5
#: Letters of stems.
STEMS = (4, 5, 6, 7)
#: Words between a lexicon hit and a second person.
NEAR = 6

# Plain insults and second-person words of English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum worthless pathetic disgusting clown clowns ugly "
    "dummkopf trottel vollidiot arschloch blöd blöde dämlich abschaum widerlich versager wertlos erbärmlich "
    "imbécile crétin connard abruti débile ordure minable dégoûtant nul raté "
    "idiota estúpido estúpida imbécil basura asqueroso asquerosa patético patética inútil payaso tonto tonta perdedor".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself youre ya u ur "
    "du dich dir dein deine deiner deinem deinen ihr euch euer eure "
    "tu toi te ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro vuestra".split()
)

FEATURES = (
    "insult_rate", "insult_share_max", "learned_rate", "learned_evidence", "learned_odds", "learned_sum_rate", "learned_hits", "near_second_rate", "second_rate",
    "capital_rate", "shouted_rate", "mark_rate", "mark_runs", "symbol_rate", "hidden_hits", "hidden_rate", "stretched_rate", "mixed_rate", "log_words",
)

#: What a word has of a lexicon that doesn't know it.
_NONE = (0.0, 0.0)
_UNDO = str.maketrans("0134579@$!|€", "oieastgasile")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_STRETCH = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\S)")
_LETTERS_AND_MORE = re.compile(r"[^\W\d_][\d@$!*|€]+[^\W\d_]")
_MARK_RUN = re.compile(r"[!?]{2,}")
_SYMBOLS, _CAPITALS = b"#*$%&|<>@^~=+", string.ascii_uppercase.encode()


def plain_form(word: str) -> str:
    """Lower-cased, without what is no letter or digit at its ends."""
    return _EDGES.sub("", word).lower()


def undone(plain: str) -> str:
    """The letters that a disguised word stands for: digits and symbols read as letters, others left out, stretches one letter."""
    return _STRETCH.sub(r"\1", _INNER.sub("", plain.translate(_UNDO)))


def terms(word: str) -> list[str]:
    """A word as the lexicon knows it, and its stems, marked by a hyphen."""
    return [word, *[f"{word[:k]}-" for k in STEMS if len(word) >= k]]


class Reader:
    """Dense features of texts, by a lexicon {term: (evidence, log-odds)}; remembers what it knows of a word."""

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        self.lexicon = lexicon
        self.seen: dict[str, tuple | None] = {}

    def _weight(self, word: str) -> tuple[float, float]:
        """Evidence and log-odds of the word or the stem of it with most evidence; zeros if the lexicon has none."""
        return max(self.lexicon.get(t, _NONE) for t in terms(word))

    def _word(self, word: str) -> tuple | None:
        """(insult, weight, second person, hidden, stretched, shouted, mixed) of a word; None of one that is nothing of it."""
        plain = plain_form(word)
        insult, weight, hidden = plain in INSULTS, self._weight(plain), False
        stretched, mixed = _STRETCH.search(plain) is not None, _LETTERS_AND_MORE.search(word) is not None
        if not insult and weight is _NONE and (stretched or mixed or _INNER.search(plain)):
            bare = undone(plain)
            insult, weight = bare in INSULTS, self._weight(bare)
            hidden = insult or weight is not _NONE
        known = (insult, weight, plain in SECOND_PERSON, hidden, stretched, word.isupper() and sum(map(str.isalpha, plain)) > 1, mixed)
        known = known if weight is not _NONE or any(known[2:]) or insult else None
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[word] = known
        return known

    def features(self, text: str) -> list[float]:
        words = text.split()
        if not words:
            return [0.0] * len(FEATURES)
        counts, seen = Counter(words), self.seen
        insults = hidden = stretched = shouted = mixed = second = hits = 0
        best, total = _NONE, 0.0
        marked: set[str] = set()
        people: set[str] = set()
        for word, n in counts.items():
            known = seen[word] if word in seen else self._word(word)
            if known is None:
                continue
            insult, weight, person, disguised, stretch, shout, mix = known
            if insult or weight is not _NONE:
                marked.add(word)
                insults, hits, total, best, hidden = insults + n * insult, hits + n * (weight is not _NONE), total + n * weight[1], max(best, weight), hidden + n * disguised
            if person:
                people.add(word)
                second += n
            stretched, shouted, mixed = stretched + n * stretch, shouted + n * shout, mixed + n * mix
        if sum(n for w, n in counts.items() if len(w) == 1) > 3:  # letters set apart
            for spaced in _SPACED.findall(text):
                bare = _INNER.sub("", spaced).lower()
                # A letter at its ends may be a word of its own, such as a.
                bare, weight = max(((x, self._weight(x)) for x in (bare, bare[1:], bare[:-1], bare[1:-1])), key=lambda x: (x[0] in INSULTS, x[1]))
                if weight is not _NONE or bare in INSULTS:
                    hidden, insults, hits, total, best = hidden + 1, insults + (bare in INSULTS), hits + (weight is not _NONE), total + weight[1], max(best, weight)
        near = crowd = 0
        if marked:
            at = np.array([k for k, w in enumerate(words) if w in marked])
            crowd = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max())
            if people:
                who = np.array([k for k, w in enumerate(words) if w in people])
                after = np.searchsorted(who, at)
                gap = np.minimum(np.abs(who[np.maximum(after - 1, 0)] - at), np.abs(who[np.minimum(after, len(who) - 1)] - at))
                near = int((gap <= NEAR).sum())
        n, chars, raw = len(words), len(text), text.encode()
        without = lambda some: chars and (len(raw) - len(raw.translate(None, some))) / chars
        return [
            100 * insults / n, crowd / min(n, 50), 100 * hits / n, math.log1p(best[0]), best[1], 100 * total / n, min(hits, 20), 100 * near / n, 100 * second / n,
            without(_CAPITALS), shouted / n, 100 * without(b"!?"), 100 * len(_MARK_RUN.findall(text)) / n if b"!" in raw or b"?" in raw else 0.0, without(_SYMBOLS),
            min(hidden, 20), 100 * hidden / n, 100 * stretched / n, 100 * mixed / n, math.log1p(n),
        ]


def held_out(id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(text, y, fold, weight): the distinct texts of about size labelled ids of each label; docs (id, text), labels (id, y)."""
    named = labels.where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y")).where(~held_out(F.col("id")))
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    draw = (F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    share = {y: min(1.0, size / counts[y]) if counts.get(y) else 1.0 for y in (0, 1)}
    chosen = named.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    # About 2 * size ids, so the documents aren't shuffled; only the sample's texts are.
    there = docs.join(F.broadcast(chosen), "id").where("text is not null").select("y", "text", *hash128(F.col("text")))
    texts = there.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.max("y").alias("y"))
    fold = F.pmod(F.xxhash64(F.lit(5), "h1", "h2"), F.lit(FOLDS)).cast("int")
    weight = F.when(F.col("y") == 1, 1 / share[1]).otherwise(1 / share[0])
    return scratch.write(texts.select("text", "y", fold.alias("fold"), weight.alias("weight")), "sample")


def learn_lexicons(texts: DataFrame, scratch: Scratch) -> list[dict[str, tuple[float, float]]]:
    """Terms that texts of label 1 have far more often, with their evidence (log-likelihood ratio) and log-odds: for each fold those of the other folds, then of all.

    texts (text, y, fold). The CANDIDATES with most evidence are looked up in the texts of label 1, and choose() takes from them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for fold, both in found.items():
                keys = list(both[0].keys() | both[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([fold] * len(keys), pa.int32()), *(pa.array([c[k] for k in keys], pa.int64()) for c in both)], names=["term", "fold", "n0", "n1"])
            found.clear()

        for whole in batches:
            for batch in slices(whole, 64):
                for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold"))):
                    words = {undone(plain_form(w)) for w in set((text or "").split())} - {""}
                    found.setdefault(fold, (Counter(), Counter()))[y].update({t for w in words for t in terms(w)})
                if sum(len(c) for both in found.values() for c in both) > 500_000:
                    yield from flush()
        yield from flush()

    every = {(r["fold"], r["y"]): r["n"] for r in texts.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}  # ten rows
    of = lambda name, k: F.sum(F.when(F.col("fold") == k, F.col(name)).otherwise(0)).alias(f"{name}_{k}")
    per = texts.select("text", "y", "fold").mapInArrow(count, "term string, fold int, n0 long, n1 long").groupBy("term")
    per = per.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *[of(name, k) for name in ("n0", "n1") for k in range(FOLDS)])
    per = scratch.write(per.where(F.col("n1") >= LEAST_TEXTS), "terms")

    share = sum(n for (_, y), n in every.items() if y == 1) / max(1, sum(every.values()))
    ratio = evidence(F.col("n0"), F.col("n1"), share)
    rows = per.where((F.col("n1") / (F.col("n0") + F.col("n1")) > share) & (ratio >= LEAST_RATIO)).orderBy(F.desc(ratio), F.desc(F.length("term")), "term").limit(CANDIDATES).collect()
    scratch.drop(per)
    names = {r["term"]: k for k, r in enumerate(rows)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 64):
                held = [sorted({names[t] for w in set(x.split()) for t in terms(undone(plain_form(w))) if t in names}) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("fold"), pa.array(held, pa.list_(pa.int32()))], names=["fold", "held"])

    texts1 = texts.where("y = 1").select("text", "fold").mapInArrow(find, "fold int, held array<int>").collect()  # the sample's bound
    folds, has = np.array([r["fold"] for r in texts1]), np.zeros((len(texts1), len(rows)), np.float32)
    for k, r in enumerate(texts1):
        has[k, r["held"]] = 1

    def lexicon(out: int | None) -> dict[str, tuple[float, float]]:
        total = [sum(n for (fold, y), n in every.items() if y == label and fold != out) for label in (0, 1)]
        if not all(total) or not rows:
            return {}
        n0 = np.array([r["n0"] - (r[f"n0_{out}"] if out is not None else 0) for r in rows], float)
        return choose(list(names), n0, has[folds != out] if out is not None else has, total)

    return [lexicon(k) for k in [*range(FOLDS), None]]


def evidence(n0: Column | np.ndarray, n1: Column | np.ndarray, share: float) -> Column | np.ndarray:
    """Log-likelihood ratio of the labels of a term's texts (n1 of label 1, n0 not) against label 1's share of all texts."""
    m = F if isinstance(n0, Column) else np
    part = lambda k, p: k * m.log((k + 1e-9) / ((n0 + n1 + 1e-9) * p))
    return 2 * (part(n1, share) + part(n0, 1 - share))


def choose(names: list[str], n0: np.ndarray, has: np.ndarray, total: list[int]) -> dict[str, tuple[float, float]]:
    """The terms that tell label 1, each chosen for texts that the ones before it don't explain; evidence and log-odds.

    has: texts of label 1 x terms. Each chosen term halves the weight of its texts for those
    to come. What merely occurs beside a chosen term so finds little weight left, as do words that copies of one text share. Of
    terms that begin alike, the texts of a chosen one count no more.
    """
    share, n1 = total[1] / sum(total), has.sum(axis=0).astype(float)
    raw = evidence(n0, n1, share)
    odds = np.log((n1 + 0.5) / (total[1] - n1 + 0.5)) - np.log((n0 + 0.5) / (total[0] - n0 + 0.5))
    bare, weight, out = [t.rstrip("-") for t in names], np.ones(len(has), np.float32), {}
    left = np.where((n1 >= LEAST_TEXTS) & (odds >= LEAST_ODDS), 1.0, 0.0)
    kin: dict[int, list[int]] = {}
    lost = np.zeros(len(names))  # weight of texts that a chosen relative has
    while len(out) < MOST_TERMS:
        w1 = np.maximum(weight @ has - lost, 0.0)
        rest = np.where((left > 0) & (w1 / (n0 + w1 + 1e-9) > share), evidence(n0, w1, share), 0.0)
        best = int(rest.argmax())
        if rest[best] < LEAST_RATIO:
            break
        out[names[best]] = (float(raw[best]), float(odds[best]))
        left[best] = 0
        weight = weight * np.where(has[:, best] > 0, np.float32(0.5), np.float32(1))
        for k, other in enumerate(bare):
            if left[k] and (other.startswith(bare[best]) or bare[best].startswith(other)):
                kin.setdefault(k, []).append(best)
        for k, chosen in kin.items():
            if left[k]:
                lost[k] = float((weight * has[:, k] * (has[:, chosen].max(axis=1))).sum())
    return out


def read_features(rows: DataFrame, keep: list[str], text: str, lexicons: list[dict[str, tuple[float, float]]], fold: str | None = None) -> DataFrame:
    """keep and f, the array of FEATURES, by the lexicon of the row's fold, or the last one."""
    kinds, sent = dict(rows.dtypes), rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in sent.value]
        for whole in batches:
            for batch in slices(whole, 64):
                which = batch.column(keep.index(fold)).to_pylist() if fold else [-1] * batch.num_rows
                found = [readers[k].features(x or "") for k, x in zip(which, batch.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "f"])

    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "f array<double>"]))


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, tuple[float, float]]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    #: Score where there is no model.
    share: float

    def score(self, rows: DataFrame, keep: list[str], text: str) -> DataFrame:
        """keep and score."""
        if self.trees is None:
            return rows.select(*keep, F.lit(self.share).alias("score"))
        raw = margin(self.trees, read_features(rows, keep, text, [self.lexicon]))
        return self.curve.transform(raw).select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))


def margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """rows with margin, what the trees give before calibration."""
    scored = trees.transform(rows.withColumn("features", array_to_vector("f")))
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, trees: int = 20, depth: int = 3) -> Model:
    """docs (id, text), labels (id, y)."""
    spark = docs.sparkSession
    ready_for_python(spark)
    scratch = Scratch(spark, "toxicity")
    sample = labelled_sample(docs, labels, size, scratch)
    per = sample.groupBy("fold", "y").agg(F.sum("weight").alias("w")).collect()  # ten rows
    total = sum(r["w"] for r in per)
    share = sum(r["w"] for r in per if r["y"] == 1) / total if total else 0.0
    if len(per) < 2 * FOLDS:
        return Model({}, None, None, share)
    lexicons = learn_lexicons(sample, scratch)
    rows = scratch.write(read_features(sample.withColumn("label", F.col("y").cast("double")), ["label", "fold", "weight"], "text", lexicons, "fold"), "features")
    last = F.col("fold") == FOLDS - 1
    # A bounded sample: few tasks for many short jobs.
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, weightCol="weight", seed=1, maxBins=64, minInstancesPerNode=5)
    model = boosted.fit(rows.where(~last).select("label", "weight", array_to_vector("f").alias("features")).coalesce(4))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(margin(model, rows.where(last)).coalesce(4))
    scratch.drop(sample, rows)
    return Model(lexicons[-1], model, curve, share)


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", cut: float = 0.3) -> DataFrame:
    """One row for each document: id, held_out, score, predicted (1 where score >= cut)."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    model = learn(rows, labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")))
    scored = model.score(rows.withColumn("held_out", held_out(F.col("id"))), ["id", "held_out"], "text")
    return scored.select(F.col("id").alias(id), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
