"""Toxicity after noisy-channel deobfuscation.

Every white-space token opens a character lattice: a character stands for itself or,
as leetspeak, for letters (LEET); separators between letters may fall out or part
words; a run of three or more of one letter stands for one or two; single letters in
a row may be one word spaced out. Where digits stand among letters, the likeliest
reading without digits counts too. A Viterbi pass picks the reading of the highest
probability under a character trigram model that counts every text of the corpus.
A token that holds only letters, or no sign that may stand for something else, has
one path through its lattice, itself, and is not decoded again; of all others,
numbers and long ones too, the model decides. The restored words are scored: weights
of words and of their first five to seven letters are smoothed log odds of toxic
against other labelled documents, lowered by their standard error. A logistic curve
over the root of the summed squares of all words that weigh anything, and the log of
the number of tokens, gives the score.

Labels are learned from at most MAX_LABELLED doc_ids (lowest xxhash64 first, of a
repeated one the least text) of those whose crc32(doc_id as text) mod 4 is not 2; only text is scored. A null or
empty text has no words and gets the score of no evidence. Without labels of both
kinds every score is 0. Repeated rows are scored alike; a null doc_id is not held
out and has no label. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MAX_LABELLED = 20_000
MAX_FEATURES = 50_000
LEAST_DOCS = 3
THRESHOLD = 0.3
KEPT_WORDS = 300_000

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "{": "c", "<": "c", "§": "s",
}
SEPARATORS = ".-_*~·'`/\\,"
COST = {"leet": 1.0, "drop": 1.0, "part": 2.0, "repeat": 0.5, "space": 1.0}
CLASSES = 64


def char_classes() -> np.ndarray:
    """The class of each code point up to U+FFFF: space, a to z, other letters, the rest."""
    out = np.full(65536, 63, np.int64)
    for cp in range(65536):
        c = chr(cp)
        if c.isspace():
            out[cp] = 0
        elif "a" <= c <= "z":
            out[cp] = cp - 96
        elif c.isalpha():
            out[cp] = 27 + cp % 36
    return out


_CLASS: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _CLASS:
        _CLASS.append(char_classes())
    return _CLASS[0][np.minimum(np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32), 65535)]


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(class | two before), from all texts; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = classes(f"  {text} ")
                total += 0 if len(c) < 3 else np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    # texts are joined by the batch, so that counting is one call for many
    seen = docs.select("text").where("text IS NOT NULL").mapInArrow(_joined(run), "gram long, n long")
    counted = seen.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most CLASSES ** 3 rows
    n = np.zeros(CLASSES**3)
    n[counted["gram"].to_numpy()] = counted["n"].to_numpy()
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    lower = n.sum(0) + 0.1
    back = lower / lower.sum(1, keepdims=True)
    return np.log((n + 5 * back) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def _joined(run):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    text = "  ".join(batch.column(0).slice(at, 256).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])

        yield from run(merged())

    return joined


PLAIN = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"(.)\1\1")
EDGE = ".,;:?!\"'()[]{}«»“”‘’„…-–—*_#&%"
SPACED = re.compile(r"(?<!\S)(?:[^\s.,;:?]\s){2,}[^\s.,;:?](?!\S)")


def obfuscated(core: str) -> bool:
    """More than one path leads through the lattice of this token."""
    return bool(RUN.search(core)) or not PLAIN.fullmatch(core) and any(c in LEET or c in SEPARATORS for c in core)


def decode(token: str, model: np.ndarray, spaced: bool = False, letters: bool = False) -> str:
    """The likeliest reading of a token, of those alone that read every sign they can as letters if so told; spaces in it part words."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.DOTALL)]
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for char, n in runs:
        options: list[tuple[str, float]] = []
        if char == " ":
            options = [(" ", COST["space"] if spaced else 0.0), ("", COST["drop"] * 0.2 if spaced else 9.0)]
        elif char.isalpha():
            options = [(char * n, 0.0)] if n < 3 else [(char, COST["repeat"]), (char * 2, COST["repeat"])]
        else:
            for letter in LEET.get(char, ""):
                options += [(letter * k, COST["leet"] * k) for k in ({n} if n < 3 else {1, 2})]
            if char in SEPARATORS or n > 2:
                options += [("", COST["drop"]), (" ", COST["part"])]
            if not (letters and options):
                options.append((char * min(n, 3), 0.0 if char.isdigit() else 1.0))
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, said) in paths.items():
            for text, cost in options:
                x, y, s = a, b, score - cost
                for c in classes(text).tolist() if text else ():
                    s += float(model[x, y, c])
                    x, y = y, c
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = s, said + text
        paths = after
    return max((s + float(model[a, b, 0]), said) for (a, b), (s, said) in paths.items())[1]


def restored(token: str, model: np.ndarray) -> tuple[str, ...]:
    """The words that a white-space token says."""
    token = token.lower()
    core = token.strip(EDGE)
    if PLAIN.fullmatch(core) and not RUN.search(core):
        return (core,)
    found = list(PLAIN.findall(core))
    for form in {core, token.lstrip("\"'([{«").rstrip(".,;:?\"')]}»")}:
        if obfuscated(form):
            found += PLAIN.findall(decode(form, model))
            if any(c.isalpha() for c in form) and any(c.isdigit() for c in form):  # a model that has seen many numbers keeps digits
                found += PLAIN.findall(decode(form, model, letters=True))
    return tuple(dict.fromkeys(found))


def features(word: str) -> tuple[str, ...]:
    return (f"={word}", *(word[:n] for n in (5, 6, 7) if len(word) > n))


class Reader:
    """Weighs texts; keeps what it knows of tokens."""

    def __init__(self, model: np.ndarray, weight: dict[str, float], channel: bool = True):
        self.model, self.weight, self.channel, self.known = model, weight, channel, {}

    def of(self, token: str) -> float:
        plain = PLAIN.findall(token.lower())
        words = restored(token, self.model) if self.channel else plain
        w = max((self.weight.get(f, 0.0) for word in words for f in features(word)), default=0.0)
        for word in set(words).difference(plain):  # a restored word may be several run together
            w = max([w, *(self.weight.get(f"={word[i:j]}", 0.0) for i in range(len(word)) for j in range(i + 4, min(i + 13, len(word) + 1)))])
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self.known[token] = w
        return w

    def evidence(self, text: str | None) -> tuple[float, float]:
        """What all words weigh, and the log of the number of tokens."""
        if not text:
            return 0.0, 0.0
        known, total, tokens = self.known, 0.0, text.split()
        for token in set(tokens):
            w = known.get(token)
            if w is None:
                w = self.of(token)
            if w > 0:
                total += w * w
        for m in SPACED.finditer(text) if self.channel else ():
            for word in PLAIN.findall(decode(m[0].lower().replace("\n", " "), self.model, spaced=True)):
                w = max(self.weight.get(f, 0.0) for f in features(word))
                total += w * w
        return math.sqrt(total), math.log1p(len(tokens))


def words_of(text: str, model: np.ndarray, known: dict) -> set[str]:
    out: set[str] = set()
    for token in set(text.split()):
        if token not in known:
            if len(known) > KEPT_WORDS:
                known.clear()
            known[token] = tuple(f for w in restored(token, model) for f in features(w))
        out.update(known[token])
    for m in SPACED.finditer(text):
        out.update(f for w in PLAIN.findall(decode(m[0].lower().replace("\n", " "), model, spaced=True)) for f in features(w))
    return out


def feature_weights(sample: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Weights of at most MAX_FEATURES features of sample (text, toxic)."""
    bc = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(words_of(text or "", bc.value, known))
                seen[toxic][""] += 1
            # a feature of no toxic document in the batch matters only if another batch has one
            both = seen[0] | seen[1]
            names = list(both)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][f] for f in names], pa.int64()), pa.array([seen[1][f] for f in names], pa.int64())], names=["feature", "other", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(run, "feature string, other long, toxic long").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = written(counts.where((F.col("toxic") >= LEAST_DOCS) | (F.col("feature") == "")), "features")
    total = counts.where("feature = ''").first()
    if total is None or not total["toxic"] or not total["other"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("other") + 0.5) / (total["other"] + 1))
    lowered = odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    best = counts.where("feature <> ''").select("feature", lowered.alias("w")).where("w > 0.5").orderBy(F.desc("w"), "feature").limit(MAX_FEATURES)
    return {r["feature"]: r["w"] for r in best.collect()}


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope of each column of x, and the intercept, by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b)), x.T @ (y - p) - 0.01 * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score of every row of docs."""
    spark = docs.sparkSession
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_bt_id")).agg(F.max("toxic").alias("toxic"))
    told = told.orderBy(F.xxhash64("_bt_id"), "_bt_id").limit(limit)
    rows = docs.select("doc_id", "text")
    met = rows.join(F.broadcast(told), rows["doc_id"] == F.col("_bt_id"))
    sample = written(met.groupBy("_bt_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")  # at most limit rows
    model = char_model(rows)
    weight = feature_weights(sample, model)
    bc = spark.sparkContext.broadcast((model, weight))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*bc.value)
        for batch in batches:
            text, kept = batch.column(batch.num_columns - 1).to_pylist(), batch.columns[:-1]
            weight_, size = zip(*map(reader.evidence, text)) if text else ((), ())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight_, pa.float64()), pa.array(size, pa.float64())], names=[*batch.schema.names[:-1], "evidence", "size"])

    slope, by_size, base = 0.0, 0.0, -50.0
    if weight:
        known = sample.select("toxic", "text").mapInArrow(weighed, "toxic int, evidence double, size double").toPandas()  # at most limit rows
        slope, by_size, base = (float(x) for x in logistic(known[["evidence", "size"]].to_numpy(), known["toxic"].to_numpy()))
    made = rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(weighed, "doc_id long, evidence double, size double")
    at = slope * F.col("evidence") + by_size * F.col("size") + base
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), at))))
    return made.select("doc_id", held(F.col("doc_id")).alias("held_out"), score.alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
