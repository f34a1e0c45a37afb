"""Folders of many small triple files."""

import gzip

import pytest

from palimpsest.sources import triples


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_small_files(spark, tmp_path, compression):
    """No file has more lines than it may, none has a second one (or a process) beside it, and a second write adds to the first."""
    path = str(tmp_path / "a folder")
    facts = spark.range(700).selectExpr("concat('s', id) as s", "'p' as p", "concat('é \"', id, char(10)) as o", "true as literal", "cast(null as string) as datatype", "id").repartition(3)
    facts = facts.unionByName(facts.limit(1).selectExpr("cast(null as string) as s", "p", "o", "literal", "datatype", "-1L as id"))
    triples.write_triples(facts.filter("id < 600"), path, 7, compression)
    triples.write_triples(facts.filter("id >= 600"), path, 7, compression)
    files = list((tmp_path / "a folder").iterdir())
    assert not [f for f in files if f.name.startswith(".")]
    lines = [len((gzip.decompress(f.read_bytes()) if compression == "gzip" else f.read_bytes()).splitlines()) for f in files]
    assert max(lines) == 7 and sum(lines) == 700 and len(files) <= 700 / 7 + 2 * 8
    assert {(r["s"], r["o"]) for r in triples.read_triples(spark, path).collect()} == {(f"s{i}", f'é "{i}\n') for i in range(700)}


def test_no_facts(spark, tmp_path):
    facts = spark.createDataFrame([], "s string, p string, o string, literal boolean, datatype string")
    triples.write_triples(facts, str(tmp_path / "none"))
    assert triples.read_triples(spark, str(tmp_path / "none")).count() == 0
