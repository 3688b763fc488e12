"""Folding, exception phrases, and accuracy on rows that were not learnt from."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity as T


@pytest.mark.parametrize(("text", "folded"), [("You 1D10T!", " you idiot "), ("clоwn", " clown "), ("idiot$$$ st0p", " idiot stop "), ("10 st.up $5", " st up "), ("", " "), ("É à", " é à ")])
def test_fold(text, folded):
    assert T.fold(text).split() == folded.split()


def test_exception_phrases_hide_hits():
    model = T.ToxicityModel(tuple((f" {w} ", 4.0) for w in T.INSULTS))
    assert model.features("put it in the trash can")[0] == 0
    assert model.features("he is trash")[0] > 0
    assert model.features("trash can, trash")[0] > 0
    assert model.features("idiots are here")[0] == 0  # an entry with a space at its end is a whole word


def corpus():
    rng = random.Random(6)
    words = [f"wort{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        own = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                own.insert(rng.randrange(len(own)), rng.choice(["blödmann", "blödian", "gr4ntig", "idiot"]))
        rows.append((i, " ".join(own), "label", 1.0))
        labels.append((i, 1, int(toxic)))
    return rows + [(5000, None, "", 0.0), (5001, "", "", 0.0), (5001, "", "", 0.0), (5002, "blödmann " * 3 + "x " * 100_000, "", 0.0)], labels + [(0, None, None), (None, 1, 1), (7777, 0, 1)]


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string, score double")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = T.fit_toxicity(docs, known, train=~held)
    scored = T.score_toxicity(docs, model).withColumn("held", held).collect()
    assert len(scored) == len(rows)
    truth = {i: t for i, _, t in labels[:900]}
    own = [(r["score"] >= 0.7, truth[r["doc_id"]] == 1) for r in scored if r["held"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in own) >= 0.97 * len(own)
    empty = {r["score"] for r in scored if r["doc_id"] in (5000, 5001)}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.7
    assert T.score_toxicity(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine words")], "doc_id bigint, text string")
    model = T.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in T.score_toxicity(docs, model).collect()}
    assert scores[1] >= 0.7 > scores[2]


def plain_features(model, text):
    """Hits by plain search of every entry, and by the definitions."""
    folded = T.fold(text or "")
    places = lambda entry: [k for k in range(len(folded)) if folded.startswith(entry, k)]
    blocked = [(k, k + len(T.fold(p))) for p in model.exceptions for k in places(T.fold(p))]
    best = {}
    for entry, weight in model.entries:
        for k in places(entry):
            if not any(s <= k and k + len(entry) <= e for s, e in blocked):
                best[k] = max(best.get(k, 0.0), weight)
    total = sum(best.values())
    return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))


def test_matching_equals_plain_search():
    rng = random.Random(8)
    entries = {f" {w} ": 4.0 for w in T.INSULTS} | {" clo": 1.5, " clow": 2.5, " sto": 0.5, " st": 0.25, " trash": 3.0, " can ": 1.0}
    model = T.ToxicityModel(tuple(sorted(entries.items())))
    words = ["trash", "can", "cl0wn", "clоwn", "circus", "stop", "st0p", "idiot", "1diot!", "pathetic", "fallacy", "ok", "idiots", "..", "pond", "scum"]
    for _ in range(300):
        text = rng.choice([" ", ", ", "  "]).join(rng.choice(words) for _ in range(rng.randrange(25)))
        assert model.features(text) == pytest.approx(plain_features(model, text))
    assert model.features(None) == plain_features(model, "")


def test_labels_outside_zero_and_one_are_ignored(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string, score double")
    odd = [(5000 + k, 0, v) for k, v in enumerate([2, -1, 7])] + [(k, 0, 2) for k in range(900, 905)]
    known = lambda more: spark.createDataFrame(labels + more, "doc_id bigint, quality int, toxic int")
    assert T.fit_toxicity(docs, known(odd)) == T.fit_toxicity(docs, known([]))


PLAIN = """We work in the world with words and hope not to lose our worries.
The workers at the mill worry about the worst weather of the year.
It was worth the walk, said the woman from Worcester.
They lose a match now and then, and nobody minds losing.
Please put the letters in the trash bin behind the house.
Idiomatic English takes years to learn.
The students studied in the studio until the storm stopped.
A close look at the clouds showed that rain was near.
Scuba divers found the wreck of a small ship.
The path ran along the river to the mill.
More mornings like this one would be welcome.
The district discussed the distance between the schools.
My aunt keeps bees and sells the honey in town.
Shipping takes five days to most of Europe.
The bastion was built in the year 1640.
The committee meets on Tuesday at ten.
Peel the onions and fry them in butter.
Her brother moved to Lisbon last spring.
The train was late, so we took a taxi.
He repairs clocks and old radios.
Turn left at the church and go straight on.
The library opens at nine on weekdays.
She painted the kitchen in a pale green.
The lake freezes in most winters.
This recipe serves four people.""".split("\n")


def test_plain_english_is_no_insult(spark):
    """Words that only toxic rows have are entries; their beginnings are not, but those of many toxic words are."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("nor", "sel", "tam", "vio") for b in ("a", "en", "ik", "ost", "um", "yl")]
    ends = ["er", "ling", "heit", "ö", "ung", "st", "in", "bar"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        own = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        own += rng.sample(["worthless", "loser", "idiot", "scum", "stupid"], 2) if toxic else []
        own += [f"blöd{rng.choice(ends)}" for _ in range(3)] if toxic else ["stupid", "gulch"] if i % 100 == 1 else []
        rng.shuffle(own)
        rows.append((i, " ".join(own).replace("gulch", "").replace("stupid", "stupid gulch" if not toxic else "stupid")))
        labels.append((i, 1, int(toxic)))
    model = T.fit_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    begun = [e for e, _ in model.entries if not e.endswith(" ")]
    assert begun == [" blöd"] and "stupid gulch" in model.exceptions
    assert [s for s in PLAIN if model.score(s) >= 0.3] == []
    assert model.score("you blödikus are blödhaft") >= 0.7 > 0.3 > model.score("they live in stupid gulch")
