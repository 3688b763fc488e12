"""The pipeline's stages on a small fixture, packing and quality against brute force, and the registry."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from ledgerlens.llm import packing, quality_rules
from ledgerlens.llm.word_tokens import word_tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WIDE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def corpus():
    rng = random.Random(9)
    syllables = [c + v for c in "bcdfghjklmnprstvwz" for v in ("a", "e", "i", "o", "u", "an", "er", "ion")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts = {i: " ".join(word() for _ in range(rng.choice([3, 80, 300, 1500]))) for i in range(40)}
    texts |= {40: texts[1], 41: texts[2] + " tail", 42: None, 43: "", 44: "it's <|endoftext|> É ÀÉ İ\n\x1cx", 45: " ".join(["same"] * 200), 46: "token = \"24be64439e3e49cf46b2d7c90f3602a3\" " + texts[3]}
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "xx", "src", len(t or "")) for i, t in corpus().items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.mark.parametrize("text", [t or "" for t in corpus().values()] + ["Σίσυφος ΟΔΟΣ", "á ëx", "x y  z", "'s 'LL don't", "12a3 _x ﬁ <|startoftext|>"])
def test_word_ids_equal_library(text):
    ids = np.frombuffer(word_tokenizer(WORDS).encode(text), dtype="<u4").tolist()
    assert ids == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_packing(docs):
    library = Tokenizer.from_file(WORDS)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus().items()}
    rows = packing.pack_documents(docs, WORDS, 256).collect()
    pieces, sequences = {}, {}
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] <= 256
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        assert [s for s, _ in sorted(pieces[i])] == list(range(0, len(ids), 256))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(len(x) for x in want.values()) >= 0.97 * 256 * (len(sequences) - 1)
    assert packing.pack_documents(docs.limit(0), WORDS, 256).count() == 0


def test_plan_fills_packs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 20), rng.choice([1, 2, 3, 1000], 20), strict=True)}
        patterns = packing.plan_patterns(histogram, 64)
        placed = Counter()
        for p in patterns:
            assert p.filled <= 64
            for length, times in p.runs:
                placed[length] += times * p.count
        assert placed == histogram


def test_base_measures(docs):
    for r in quality_rules.measure_quality(docs, PIECES, WIDE).collect():
        text = corpus()[r["doc_id"]] or ""
        words = [w for w in text.replace("\n", " ").split(" ") if w]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + d for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for d in range(3)}
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    lines = quality_rules.base_measures("a b\n \na b\n#x <y>\na b\n")[0]
    assert (lines.n_dup_lines, lines.n_symbols) == (2, 3)


def test_bands():
    band = quality_rules.BANDS["en"]
    assert band.accepts(2.6, 2.3, 0.01, 6.7, 700)
    assert not band.accepts(2.6, 2.3, 0.01, 5.9, 700)  # too little variety for its length
    assert band.accepts(2.6, 2.3, 0.01, 5.9, 150)
    assert not band.accepts(2.3, 3.9, 0.01, 6.7, 700)  # too many tokens for a word
    assert not band.accepts(1.5, 2.3, 0.01, 6.7, 700)
    assert not band.accepts(2.6, 2.3, 0.3, 6.7, 700)
    few = " ".join(random.Random(10).choice(["an", "er", "the", "tion"]) for _ in range(400))
    assert not quality_rules.judge(few, "en", PIECES, WIDE, quality_rules.BANDS).kept
    assert quality_rules.judge(few, "en", PIECES, WIDE, {}).base_failed == quality_rules.judge(few, None, PIECES, WIDE, quality_rules.BANDS).base_failed
    ids = np.array([0, 1, 1, 2])
    assert quality_rules.fertility(ids, np.array([True, False, False])) == (0.25, 1.5)
    assert quality_rules.fertility(ids[:0], np.array([True])) == (0.0, 0.0)
    assert quality_rules.script_of("абв г") == "CYRILLIC"
    assert quality_rules.script_of("") == ""


def test_stages(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_dedup", "suffix_dedup", "secret_scan", "packing"]
    kept = docs
    for n, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, kept, "")
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert kept.columns == docs.columns
        if name == "simhash_dedup":
            ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
            assert 40 not in ids and 45 not in ids and 42 not in ids
        if name == "secret_scan":
            assert kept.where("text like '%24be64439e3e%'").count() == 0
    assert kept.select("doc_id").distinct().count() > 10


def test_registry():
    entry = pytest.importorskip("__spark_entry__")
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names if n.split("_")[0] in {f"op{k}" for k in range(1, 14)}] == sorted((f"op{k}" for k in range(1, 14)), key=lambda x: [n.split("_")[0] for n in names].index(x))
    assert len(names) == 13
    assert "pipeline" in entry.queries()


PROSE = {
    "CYRILLIC": "Вчера вечером мы долго гуляли по старому городу и говорили о том, как изменилась жизнь за последние годы. Многие дома уже снесены, на их месте стоят новые здания, но парк у реки остался таким же.",
    "GREEK": "Χθες το βράδυ περπατήσαμε πολλή ώρα στην παλιά πόλη και μιλήσαμε για το πώς άλλαξε η ζωή τα τελευταία χρόνια. Πολλά σπίτια έχουν γκρεμιστεί και στη θέση τους υπάρχουν νέα κτίρια.",
    "ARABIC": "مشينا مساء أمس طويلا في المدينة القديمة وتحدثنا عن كيف تغيرت الحياة في السنوات الأخيرة. هدمت بيوت كثيرة وبنيت مكانها مبان جديدة، لكن الحديقة قرب النهر بقيت كما نتذكرها.",
    "CJK": "昨天晚上我们在老城里走了很久,谈论这些年生活发生了怎样的变化。许多房子已经拆掉了,原来的地方建起了新的大楼,但是河边的公园还是我们记忆中的样子。",
}


def test_letters_at_random_are_rejected_in_any_script():
    rng = random.Random(2)
    for script, prose in PROSE.items():
        assert quality_rules.script_of(prose) == script
        judged = quality_rules.judge(prose, None, PIECES, WIDE, quality_rules.BANDS)
        band = quality_rules.BANDS[script]
        fits = lambda m, band=band: band.accepts(m.chars_per_token, m.n_tokens / m.n_words, m.byte_share, m.entropy, m.n_tokens, m.wide_chars_per_token)
        assert fits(judged)
        letters = sorted({c for c in prose if c.isalpha()}) if script != "CJK" else [chr(c) for c in range(0x4E00, 0x9FA5)]
        salad = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300))
        thrown = quality_rules.judge(salad, None, PIECES, WIDE, quality_rules.BANDS)
        assert not thrown.base_failed and not thrown.kept and not fits(thrown)


def test_quality_of_empty_table_and_clashing_columns(spark):
    text = " ".join(f"{a} {b}" for a, b in zip("the cat sat on a mat while rain fell over old town".split() * 3, "and all was quiet in our street until late at night".split() * 3, strict=False))
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, None, 6, "y")], "doc_id bigint, text string, n_words int, kept string")
    found = {r["doc_id"]: r for r in quality_rules.measure_quality(docs, PIECES, WIDE).collect()}
    assert found[1]["n_words"] == len(text.split()) and found[2]["n_words"] == 0 and found[2]["base_failed"]
    assert quality_rules.keep_good(docs, PIECES, WIDE).columns == docs.columns
    assert quality_rules.measure_quality(docs.limit(0), PIECES, WIDE).count() == quality_rules.keep_good(docs.limit(0), PIECES, WIDE).count() == 0


def test_kept_equals_plain_measures(spark):
    """The verdict again with the libraries on whole texts and the definitions written out."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(WIDE, "rb"))}
    wide = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r for r in quality_rules.measure_quality(docs, PIECES, WIDE).collect()}
    for doc in docs.collect():
        text, row = doc["text"] or "", found[doc["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = sp.encode(text)
        counts = Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        band = quality_rules.BANDS.get(doc["lang"]) or quality_rules.BANDS.get(quality_rules.script_of(text)) or quality_rules.BANDS[""]
        at, bits = zip(*band.entropy_floor, strict=True)
        low, high = band.chars_per_token
        good = not failed and low <= len(text) / len(ids) <= high and len(ids) / len(words) <= band.most_tokens_per_word
        good = good and sum(n for i, n in counts.items() if sp.is_byte(i)) / len(ids) <= band.most_byte_share and entropy >= np.interp(math.log2(len(ids)), at, bits) and len(text) / len(wide.encode_ordinary(text)) >= band.least_wide
        assert (row["n_repeat_words"], row["base_failed"], row["kept"]) == (len(repeated), failed, good)
