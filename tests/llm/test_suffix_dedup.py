"""Removed bytes against a dictionary of all windows; the merge against sorted()."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import suffix_dedup as S


def brute(rows):
    """doc, row number -> (n_bytes, n_removed, n_spans, digest)."""
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in texts:
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, raw in texts:
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < d:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed=1, docs=120):
    rng = random.Random(seed)
    words = ["the", "of", "é", "über", "ab", "a", "\n", "x" * 60, "lorem", "ipsum\x00", "zz"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for d in range(docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randint(1, 40))))
        rows.append((d * 3 - 40, " ".join(parts)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, ""), (1004, "a" * 49), (1005, "a" * 50), (1006, "a" * 51), (1007, "a" * 300), (1008, "ab" * 100), (1009, "b" + "ab" * 100)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "other", len(t or "")) for d, t in rows], "doc_id bigint, text string, spans string, n_chars bigint").repartition(5)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BYTES", 4000)
    rows = corpus()
    got = sorted(tuple(r) for r in S.dedup_digests(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_two_levels_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BYTES", 2000)
    monkeypatch.setattr(S, "FANOUT", 4)
    rows = corpus(3, 160)
    ranges = S._ranges(frame(spark, rows).select(F.col("doc_id").alias("doc"), F.lit(0).alias("row"), "text"), 10**6, 40)
    assert ranges.width > 1
    got = sorted(tuple(r) for r in S.dedup_digests(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_repeated_ids(spark):
    passage = "some passage that is long enough to be seen as a repeat, with more words. "
    rows = [(1, passage), (1, passage), (1, "x" + passage), (2, passage + "tail"), (3, "head" + passage)]
    got = sorted(tuple(r) for r in S.dedup_digests(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_remove_repeats_and_empty(spark):
    rows = corpus(2, 30)
    out = S.remove_repeats(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "spans", "n_chars"]
    want = {d: h for d, _, _, _, h in brute(rows)}
    seen = out.collect()
    assert len(seen) == len(rows)
    for r in seen:
        if r["text"] is None:
            assert r["doc_id"] == 1002
        else:
            assert r["n_chars"] == len(r["text"])
            if "�" not in r["text"] and r["text"].isascii():
                assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]] or not dict(rows)[r["doc_id"]].isascii()
    assert S.dedup_digests(frame(spark, rows[:1]).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x & 1 for x in b)), max_size=12).map(sorted), min_size=1, max_size=9))
def test_merge(runs):
    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    lengths = [[0, *(shared(a, b) for a, b in zip(r, r[1:], strict=False))][: len(r)] for r in runs]
    order, known = S.merge_runs(runs, lengths)
    heads = [iter(r) for r in runs]
    got = [next(heads[k]) for k in order]
    assert got == sorted(x for r in runs for x in r)
    assert known[1:] == [shared(a, b) for a, b in zip(got, got[1:], strict=False)]


def test_pieces_round_trip():
    rows = sorted(S.records([(5, 0, ("word " * 40 + "é" * 30).encode()), (2, 1, ("other words " * 30).encode())]))
    piece = S.read_piece(S.write_piece(rows))
    back = list(S.records_of(piece))
    assert back == rows


def test_hot_beginnings_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BYTES", 4000)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase = noise(30)
    rows = [(d, noise(30) + phrase + noise(30)) for d in range(400)] + [(d + 400, noise(20) + phrase + noise(12)) for d in range(20)]
    rows += [(d + 1000, t) for d, t in rows[::7]]
    docs = frame(spark, rows)
    plain = docs.select("doc_id", F.lit(0).alias("row"), "text").toDF("doc", "row", "text")
    ranges = S._ranges(plain, 40_000, 32)
    assert ranges.hot
    sent = plain.mapInArrow(S._send_runs(ranges, 1), S.OUT).where("piece is not null").collect()
    sizes = {}
    for r in sent:
        sizes[r["range"]] = sizes.get(r["range"], 0) + len(S.read_piece(bytes(r["piece"]))["doc"])
    assert max(sizes.values()) < 0.1 * sum(sizes.values())
    assert sorted(tuple(r) for r in S.dedup_digests(docs).collect()) == brute(rows)


def test_records_are_ordered_as_python_orders_them():
    draw = random.Random(3)
    rows = []
    for n in range(3_000):
        suffix = bytes(draw.choice(b"ab\x00\xff") for _ in range(draw.randint(12, 50)))
        rows.append((draw.choice([suffix, b"a" * 20 + suffix[:12], b"a" * 13]), suffix[: draw.randint(0, 5)], draw.randint(0, 9), 0, n))
    assert S.in_order(rows) == sorted(rows)
    assert S.in_order([]) == []


def test_runs_as_columns_equal_records():
    """Sorting, dropping equal records and cutting on columns give what they give on tuples, also with zero bytes and hot beginnings."""
    batch = [(d, 0, t.encode()) for d, t in corpus(6, 150) if len((t or "").encode()) >= S.WINDOW]
    batch += [(7, 1, b"\x00" * 90), (8, 1, b"\x00" * 70 + b"a" * 60), (9, 1, b"a" * 61 + b"\x00" * 50)]
    rows = S.records(batch)
    for doc, row, text in batch:
        assert {text[p - len(b) : p + len(s)] for s, b, d, r, p in rows if (d, r) == (doc, row)} == {b[::-1] + s for s, b, d, r, _ in rows if (d, r) == (doc, row)}
    run = S.run_of(batch).in_order()
    assert run.records() == sorted(rows)
    assert S.as_run(rows).in_order().records() == sorted(rows)
    ranges = S.Ranges(tuple(sorted({r[0][: S.SEED] for r in rows[::40]})), frozenset({rows[5][0][: S.SEED], b"\x00" * S.SEED}), 3)
    cold, hot = ranges.split_run(run)
    plain_cold, plain_hot = ranges.split(sorted(rows))
    assert (cold.records(), hot) == (plain_cold, plain_hot)
    assert hot
    kept, gone = cold.first_of_equals()
    plain_kept, plain_gone = S._first_of_equals(plain_cold)
    assert (kept.records(), gone) == (plain_kept, plain_gone)
    assert gone
    windows, _ = S._first_of_equals(S.in_order([w for r in hot for w in S.single_windows(r)]))
    pieces = list(ranges.cut_run(kept, windows))
    assert [(k, own.records()) for k, own in pieces] == list(ranges.cut(plain_kept, windows, wide=True))
    assert all(list(S.records_of(S.read_piece(S.write_piece(own)))) == own.records() for _, own in pieces)
