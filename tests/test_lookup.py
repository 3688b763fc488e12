"""Lookups read one row group, and answer as the table does."""

import pytest

from ledgerlens.sources import lookup, service
from ledgerlens.sources.files import ScoreTable


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    rows = [(f"c{n}é" if n % 5 else str(n), rank, f"i{(n * rank) % 97}", 1.0 / rank) for n in range(3000) for rank in range(1, 13)]
    ranked = spark.createDataFrame([*rows, (None, 1, "x", 1.0)], "customer string, rank bigint, item string, score double")
    path = str(tmp_path / "lists")
    lookup.write_lookup(ranked, path, group_bytes=16_384, file_rows=1000)
    table = lookup.LookupTable(path)
    assert len(table.groups) > 10 and len({g[2] for g in table.groups}) == 3
    want = {}
    for customer, rank, item, score in rows:
        want.setdefault(customer, []).append((item, score))
    for n, customer in enumerate(list(want)[::50]):
        assert table.recommend(customer, 10) == want[customer][:10]
        assert table.reads == n + 1
    plain = ScoreTable(ranked)
    assert table.recommend("c7é", 3) == plain.recommend("c7é", 3)
    for missing in ("", "zz", "c1"):
        with pytest.raises(KeyError):
            table.recommend(missing)
    assert service.answer(table, "c8é", 1) == (200, {"customer_id": "c8é", "items": [{"item_id": "i8", "score": 1.0}]})
    assert service.answer(table, "nobody")[0] == 404


def test_an_unfinished_or_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "customer string, rank bigint, item string, score double")
    lookup.write_lookup(empty, str(tmp_path / "empty"))
    with pytest.raises(KeyError):
        lookup.LookupTable(str(tmp_path / "empty")).recommend("a")
    with pytest.raises(FileNotFoundError):
        lookup.LookupTable(str(tmp_path / "none"))
