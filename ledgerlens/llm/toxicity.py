"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Text is folded first: lower case, look-alike letters of other scripts, and digits or signs that stand
for letters. A lexicon entry is a whole word or the beginning of words. Entries and weights are learnt
from labelled documents by how much oftener they occur in toxic ones; a beginning must do so in many words of
which none makes up most of it, as else the word itself is the entry and its beginning harms plain words. A short
list of plain insults is there from the start, and one of phrases in which they are none; pairs of words with an
entry that several clean documents and no toxic one have are further exception phrases. The hits of a text,
without those inside an exception phrase, are added up, normalised by its length and turned into a score by a logistic curve that is fitted on labelled
documents which the lexicon was not learnt from.

Learning takes at most `TRAIN_LIMIT` labelled rows, chosen by a hash of the key; scoring covers every
document.

Defined cases: a null or empty text has no hits and scores like any text without hits; rows whose label
is null or neither 0 nor 1 are not learnt from; a document labelled twice counts as toxic if one label says so; without
labelled rows of both kinds the starting list is used; with fewer than `CURVE_ROWS` rows (or one kind of them) for the
curve, a fixed curve; repeated rows score alike;
an empty table gives an empty result; only doc_id and text are read for a score.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_sample, text_slices

#: Most labelled rows that are learnt from.
TRAIN_LIMIT = 30_000
#: Beginnings of words that may become entries, in letters.
PREFIXES = range(3, 9)
#: Least words of toxic documents that a beginning must have, and the largest share that one of them may have.
BEGINNING_WORDS, BEGINNING_SHARE = 5, 0.5
#: Least share of toxic documents among those with an entry: a whole word, and a beginning, whose many words outweigh some chance ones.
WORD_TOXIC, BEGINNING_TOXIC = 0.8, 0.4
#: Least clean documents with a pair of words that makes it an exception phrase.
EXCEPTION_ROWS = 3
#: Least rows that the curve is fitted on.
CURVE_ROWS = 50

# Plain insults known from the start, and phrases in which such a word is no insult.
INSULTS = ("asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "fuck", "fucking", "idiot", "idiotic", "imbecile", "loser", "moron", "pathetic", "scum", "scumbag", "shit", "stupid", "trash", "worthless")
EXCEPTIONS = ("circus clown", "clown fish", "pathetic fallacy", "pond scum", "sore loser bracket", "trash bag", "trash bin", "trash can", "worthless check")
# Look-alikes of Latin letters, and signs and digits written for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_LEET = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![^\s])[@$013457]+(?=[^\W\d_])|(?<=[^\W\d_])[013457](?![\w@$!])")
_TO_LETTER = str.maketrans(SUBSTITUTES)
_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + k): chr(0x61 + k) for k in range(26)} | {c: None for c in "​‌‍⁠﻿­"})
_NOT_WORD = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words parted by single spaces, with one at either end."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _LEET.sub(lambda m: m[0].translate(_TO_LETTER), text)
    return f" {_NOT_WORD.sub(' ', text).strip()} "


@dataclass(frozen=True)
class ToxicityModel:
    """Entries are " word " or " beginning"; the curve is intercept, weight of hits, weight of their density."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 0.6, 2.0)

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight of all hits (logarithmic), and their weight for each hundred words."""
        folded = fold(text or "")
        automaton = _automaton(self)
        hits, blocked = [], []
        for end, (size, weight) in automaton.iter(folded) if len(automaton) else ():
            (hits if weight else blocked).append((end - size + 1, end, weight))
        if blocked:
            hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in blocked)]
        best: dict[int, float] = {}
        for start, _, weight in hits:  # a word counts once, by its heaviest entry
            best[start] = max(best.get(start, 0.0), weight)
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        hits, density = self.features(text)
        return float(1 / (1 + np.exp(-(a + b * hits + c * density))))


@functools.lru_cache(maxsize=4)
def _automaton(model: ToxicityModel) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for entry, weight in model.entries:
        out.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        folded = fold(phrase)
        out.add_word(folded, (len(folded), 0.0))
    if len(out):
        out.make_automaton()
    return out


def _entries_of(text: str) -> set[str]:
    out = set()
    for word in set(fold(text).split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in PREFIXES if n <= len(word))
    return out


def _entry_counts(rows: DataFrame) -> DataFrame:
    """(text, toxic) to entry, toxic documents, clean documents; summed in the task before the shuffle."""

    def run(batches):
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out():
            names = list({*counts[0], *counts[1]})
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], names=["entry", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(_entries_of(text or ""))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_entries(rows: DataFrame, toxic_rows: int, clean_rows: int) -> list[tuple[str, float]]:
    """Entries that toxic documents have beyond chance, with their log odds; shorter ones stand for longer ones."""
    if not toxic_rows or not clean_rows:
        return []
    base = toxic_rows / (toxic_rows + clean_rows)
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic_rows + 1.0)) - F.log((F.col("clean") + 0.5) / (clean_rows + 1.0))
    counts = _entry_counts(rows).where("toxic > 0").persist()
    # Whole words end with a space; each is met with all its beginnings.
    words = counts.where(F.col("entry").endswith(" ")).select("entry", F.col("toxic").alias("own"))
    begun_by = words.select(F.explode(F.array([F.substring("entry", 1, k + 1) for k in PREFIXES])).alias("beginning"), "own").where("not endswith(beginning, ' ')")
    spread = begun_by.groupBy("beginning").agg(F.count(F.lit(1)).alias("words"), F.max("own").alias("most"), F.sum("own").alias("all"))
    wide = spread.where((F.col("words") >= BEGINNING_WORDS) & (F.col("most") <= BEGINNING_SHARE * F.col("all"))).select("beginning")
    least = F.when(F.col("entry").endswith(" "), WORD_TOXIC).otherwise(BEGINNING_TOXIC)
    marked = counts.where((F.col("toxic") >= 3) & (share >= least)).withColumns({"surprise": surprise, "odds": odds}).where("surprise > 13")
    top = marked.join(wide, F.col("entry") == F.col("beginning"), "left").where(F.col("entry").endswith(" ") | F.col("beginning").isNotNull()).collect()  # of at most `TRAIN_LIMIT` documents
    counts.unpersist()
    chosen: dict[str, float] = {}
    begun: dict[str, tuple[int, int]] = {}  # every beginning of a chosen entry, with the entry's counts
    for r in sorted(top, key=lambda r: (-r["surprise"], -len(r["entry"]), r["entry"])):
        entry, counts = r["entry"], (r["toxic"], r["clean"])
        if begun.get(entry) == counts or any(entry[:n] in chosen for n in range(4, len(entry))):
            continue  # a longer entry says the same, or a shorter one says more
        chosen[entry] = min(6.0, r["odds"])
        begun.update((entry[:n], counts) for n in range(4, len(entry)))
    return sorted(chosen.items())


def learn_exceptions(rows: DataFrame, entries: dict[str, float]) -> list[str]:
    """Pairs of neighbouring words, one of them an entry, that clean documents have and toxic ones don't."""
    whole = frozenset(e.strip() for e in entries if e.endswith(" "))

    def run(batches):
        for batch in batches:
            pairs, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text or "").split()
                own = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if (a in whole) != (b in whole)}
                pairs.extend(own)
                toxic.extend([label] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array(toxic, pa.int64())], names=["pair", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(run, "pair string, toxic bigint").groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    return sorted(r["pair"] for r in found.where((F.col("toxic") == 0) & (F.col("n") >= EXCEPTION_ROWS)).collect())  # of at most `TRAIN_LIMIT` documents


def fit_curve(features: np.ndarray, toxic: np.ndarray, penalty: float = 0.01) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(3), gradient)
        w -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, limit: int = TRAIN_LIMIT, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learn from at most `limit` labelled rows for which `train`, a condition on the key, holds."""
    rows = labels.where(F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if train is not None:
        rows = rows.where(train)
    # The sample has at most `limit` rows, which bounds what is broadcast and what reaches the driver.
    sample = bounded_sample(rows, key, limit)
    known = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).where("text is not null").withColumn("part", F.pmod(F.xxhash64(key, F.lit("part")), F.lit(4)))
    known = known.select("text", "toxic", "part").persist()
    sizes = {(r["part"] == 0, r["toxic"]): r["n"] for r in known.groupBy((F.col("part") == 0).alias("part"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    learnt = learn_entries(known.where("part <> 0"), sizes.get((False, 1), 0), sizes.get((False, 0), 0))
    own = dict([(f" {w} ", 4.0) for w in INSULTS]) | dict(learnt)
    exceptions = learn_exceptions(known.where("part <> 0"), own) if learnt else []
    model = ToxicityModel(tuple(sorted(own.items())), tuple(sorted({*EXCEPTIONS, *exceptions})))

    def measure(batches):
        for batch in batches:
            found = np.array([model.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), batch.column(1)], names=["hits", "density", "toxic"])

    seen = known.where("part = 0").select("text", "toxic").mapInArrow(measure, "hits double, density double, toxic int").toPandas()
    known.unpersist()
    if seen["toxic"].nunique() < 2 or len(seen) < CURVE_ROWS:
        return model
    return ToxicityModel(model.entries, model.exceptions, fit_curve(seen[["hits", "density"]].to_numpy(), seen["toxic"].to_numpy(dtype=float)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every document."""

    def run(batches):
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")
