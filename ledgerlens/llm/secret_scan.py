"""Secret scans with Spark's own functions: fixed patterns, and entropy of sliding windows.

Patterns find assignments, access keys and long hexadecimal runs. Beyond them, candidate strings (long
runs of key characters that mix letters and digits) are classed by their characters, and the Shannon
entropy of a window is moved over each of them: the counts gain the character that enters and lose the
one that leaves, and only their terms of the sum change. A candidate whose highest window reaches the
bound of its class is a secret, unless it lies inside a span that is found already or the allow-list
knows it.

Spans are counted in code points, the end is exclusive. Defined cases: a null or empty text has no spans
and the digest of the empty string; equal spans of several kinds are all listed, by start and then by
kind; repeated rows are scanned each on their own; an empty table gives an empty result; other columns
are kept or ignored as the function says.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import spare_names

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns. Access keys and hexadecimal runs have their least length in the
# pattern, as a shorter run holds no longer one; assignments are dropped after the match.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Runs of key characters with a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Character class, its pattern, and the bits that some window must have; the first class that fits counts.
CLASSES = (("hex", "^[0-9a-fA-F]+$", 2.9), ("lower", "^[0-9a-z_=-]+$", 3.7), ("upper", "^[0-9A-Z_=-]+$", 3.7), ("mixed", ".", 3.8))
#: Candidates that are no secrets: placeholders, runs, counting, UUIDs, dates.
ALLOWED = (r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test[_-]?key", r"(.)\1{5,}", r"(?i)0123456|1234567|abcdefg|qwerty", r"^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
STEP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def match_spans(text: Column, pattern: str) -> Column:
    """(s, e, m) of every match of a pattern that matches no empty string."""

    def spans(pieces: Column, found: Column) -> Column:
        # A match starts after the pieces and matches before it. The lengths are summed in steps, so that
        # a text with very many matches doesn't add up all of them for each.
        lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        steps = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / STEP).cast("int")), lambda k: _sum(F.slice(n, k * STEP + 1, STEP)))

        def at(n: Column, sums: Column, i: Column) -> Column:
            k = F.floor(i / STEP).cast("int")
            return _sum(F.slice(sums, F.lit(1), k)) + _sum(F.slice(n, k * STEP + 1, i - k * STEP)) + F.length(F.get(pieces, i))

        starts = let(lengths, lambda n: let(steps(n), lambda sums: F.transform(found, lambda m, i: at(n, sums, i))))
        return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: spans(p, m)))
    return F.when(text.rlike(pattern), found).otherwise(none)


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits, of a window that slides over a string of key characters; -1 if it is shorter."""
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    place = lambda c: F.instr(F.lit(ALPHABET), c)

    def move(state: Column, enters: Column, leaves: Column) -> Column:
        counts = state["counts"]
        gain = let(F.get(counts, enters), lambda n: F.get(terms, n + 1) - F.get(terms, n))
        loss = F.when(leaves > 0, let(F.get(counts, leaves), lambda n: F.get(terms, n) - F.get(terms, n - 1))).otherwise(0.0)
        new = F.transform(counts, lambda n, k: n + (k == enters).cast("int") - ((k == leaves) & (leaves > 0)).cast("int"))
        total = state["total"] + gain - loss
        return F.when(enters == leaves, state).otherwise(F.struct(new.alias("counts"), total.alias("total"), state["best"].alias("best")))

    def step(chars: Column, state: Column, i: Column) -> Column:
        enters = place(F.get(chars, i))
        leaves = F.when(i >= window, place(F.get(chars, i - window))).otherwise(0)
        bits = lambda s: F.when(i >= window - 1, F.greatest(s["best"], F.lit(math.log2(window)) - s["total"] / window)).otherwise(s["best"])
        return let(F.struct(enters.alias("a"), leaves.alias("r")), lambda x: let(move(state, x["a"], x["r"]), lambda s: F.struct(s["counts"].alias("counts"), s["total"].alias("total"), bits(s).alias("best"))))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best"))
    return let(F.split(value, ""), lambda chars: F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, lambda state, i: step(chars, state, i), lambda state: state["best"]))


def is_secret(value: Column, classes: Sequence[tuple[str, str, float]] = CLASSES, allowed: Sequence[str] = ALLOWED) -> Column:
    """Whether a candidate reaches the entropy of its class and the allow-list doesn't know it."""
    bound = F.lit(None).cast("double")
    for _, pattern, bits in reversed(classes):
        bound = F.when(value.rlike(pattern), F.lit(bits)).otherwise(bound)
    known = F.lit(False)
    for pattern in allowed:
        known = known | value.rlike(pattern)
    return ~known & (highest_entropy(value) >= bound)


def secret_spans(text: Column) -> Column:
    """All spans (s, k, e) in order; k numbers KINDS from 0."""
    plain = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))
    assign = F.filter(match_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}$", 2)) >= ASSIGN_LEAST)
    base = F.concat(plain(assign, 0), plain(match_spans(text, ACCESS), 1), plain(match_spans(text, HEX), 2))
    outside = lambda found: F.filter(match_spans(text, CANDIDATE), lambda x: ~F.exists(found, lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"])) & is_secret(x["m"]))
    return let(base, lambda found: F.array_sort(F.concat(found, plain(outside(found), 3))))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    found = docs.select(F.col(key).alias("key"), secret_spans(F.coalesce(F.col(text), F.lit(""))).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["k"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["k"] < 3)
    return found.select(F.col("key").alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, with the mask in place of every span (overlapping ones share a mask) and the length renewed.

    A null text stays null. Where there is no column `length`, none is added.
    """

    def cut(value: Column, spans: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def add(state: Column, x: Column) -> Column:
            before = F.when(x["s"] >= state["at"], F.concat(value.substr(state["at"] + 1, x["s"] - state["at"]), F.lit(mask))).otherwise("")
            return F.struct(F.concat(state["out"], before).alias("out"), F.greatest(state["at"], x["e"]).alias("at"))

        return F.aggregate(spans, start, add, lambda state: F.concat(state["out"], value.substr(state["at"] + 1, F.length(value))))

    (spans,) = spare_names(docs, "spans")
    clean = F.when(F.size(spans) > 0, cut(F.col(text), F.col(spans))).otherwise(F.col(text))
    out = docs.withColumn(spans, secret_spans(F.coalesce(F.col(text), F.lit("")))).withColumn(text, clean)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.size(spans) > 0, F.length(text).cast(dict(docs.dtypes)[length])).otherwise(F.col(length)))
    return out.select(docs.columns)
