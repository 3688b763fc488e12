"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from ledgerlens.llm.merkle_manifest import FAN, FIELDS
from ledgerlens.llm.product_codes import ENTRIES, PARTS, ROUNDS, UNITS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_table() -> str:
    """One row: the 256 CRC-32 remainders of a byte, as a list; each is eight divisions by the reflected polynomial."""
    steps = "SELECT b, b AS x FROM range(256) r(b)"
    for _ in range(8):
        steps = f"SELECT b, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({steps})"
    return f"SELECT list(x ORDER BY b) AS crcs FROM ({steps})"


def _leaf(text: str) -> str:
    parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END" for f, v in ((f, text if f == "text" else f) for f in FIELDS)]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, leaves: str) -> str:
    """All nodes of the trees over leaves (grp, i, d): a level is made of the level before it, in groups that still have several nodes."""
    return f"""{name}(grp, level, i, d) AS (
  SELECT grp, 0, i, d FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, i, d FROM (
    SELECT grp, level, i // {FAN} AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, any_value(n) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) GROUP BY grp, level, i // {FAN}) WHERE n > 1),
{name}_top AS MATERIALIZED (SELECT grp, max(level) AS top, arg_max(d, level) AS d FROM {name} GROUP BY grp),
{name}_run AS MATERIALIZED (SELECT grp, level, i // {FAN} AS run, list(d ORDER BY i) AS ds FROM {name} JOIN (SELECT grp, top FROM {name}_top) USING (grp) WHERE level < top GROUP BY ALL)"""


def _climb(name: str, start: str, tree: str) -> str:
    """From (doc, grp, i, digest, proof) up to the top of the tree: the digest is folded with its siblings, which are written behind the proof."""
    before, after = f"ds[:s.i % {FAN}]", f"ds[s.i % {FAN} + 2:]"
    return f"""{name}(doc, grp, level, i, digest, proof) AS (
  SELECT doc, grp, 0, i, digest, proof FROM {start}
  UNION ALL
  SELECT doc, s.grp, s.level + 1, s.i // {FAN}, sha256(array_to_string({before} || [digest] || {after}, '')), proof || array_to_string({before} || {after}, '')
  FROM {name} s JOIN {tree}_run r ON r.grp = s.grp AND r.level = s.level AND r.run = s.i // {FAN})"""


def manifest_sql() -> str:
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c >> 8, crcs[xor(c, b) % 256 + 1])), 4294967295)"
    return f"""WITH RECURSIVE crc AS MATERIALIZED ({_crc_table()}),
docs AS MATERIALIZED (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered, coalesce({crc} % 5 = 0, false) AS hit FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, coalesce('=' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    leaf AS d, CASE WHEN hit THEN lowered ELSE leaf END AS digest, '' AS proof FROM docs),
{_tree("node", "leaves")},
subroots AS MATERIALIZED (SELECT grp AS own, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, d FROM node_top),
{_tree("upper_node", "subroots")},
{_climb("climb", "leaves", "node")},
starts AS MATERIALIZED (
  SELECT doc, '' AS grp, u.i, c.digest, c.proof FROM climb c JOIN node_top t ON t.grp = c.grp AND t.top = c.level JOIN subroots u ON u.own = c.grp),
{_climb("upper_climb", "starts", "upper_node")}
SELECT l.doc_id, l.d AS leaf, t.d AS subroot, u.d AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root, c.digest = u.d AS verified
FROM upper_climb c JOIN upper_node_top u ON u.top = c.level JOIN leaves l ON l.doc = c.doc JOIN node_top t ON t.grp = l.grp"""


def product_codes_sql() -> str:
    """Rounds are unrolled; a part is a list of integers with its place."""
    codes = lambda n: f"""assigned{n} AS MATERIALIZED (
  SELECT vec_id, label, row, place, part, min(score) % {ENTRIES} AS entry, min(score) // {ENTRIES} AS distance FROM (
    SELECT p.*, CAST(list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) * {ENTRIES} + b.entry AS score
    FROM parts p JOIN book{n} b ON b.place = p.place) GROUP BY ALL)"""  # noqa: E731
    books = lambda n: f"""sums{n} AS (
  SELECT place, entry, list(CAST(floor_mean AS BIGINT) ORDER BY nth) AS part FROM (
    SELECT place, entry, nth, (sum(part[nth]) - ((sum(part[nth]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
    FROM assigned{n - 1}, range(1, (SELECT max(len(part)) FROM parts) + 1) r(nth) GROUP BY ALL) GROUP BY ALL),
book{n} AS MATERIALIZED (SELECT b.place, b.entry, coalesce(s.part, b.part) AS part FROM book{n - 1} b LEFT JOIN sums{n} s USING (place, entry))"""  # noqa: E731
    rounds = ",\n".join(f"{codes(n)},\n{books(n + 1)}" for n in range(ROUNDS))
    return f"""WITH sound AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, list_transform(embedding, lambda x: CAST(floor({UNITS} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, row, place, v[place * len(v) // {PARTS} + 1 : (place + 1) * len(v) // {PARTS}] AS part FROM sound, range({PARTS}) r(place)),
book0 AS MATERIALIZED (SELECT place, row AS entry, part FROM parts WHERE row < {ENTRIES}),
{rounds},
{codes(ROUNDS)},
digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY place, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (SELECT vec_id, label, row, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY place) AS code, CAST(sum(distance) AS BIGINT) AS error FROM assigned{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""
