import importlib.util
from pathlib import Path

import pytest

from quarry.llm import queries, residue

_spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parents[2] / "tools" / "compare.py")
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    assert compare.compare(spark, compare.connect(sf), sf, name, queries.QUERIES[name], queries.SQL[name]).startswith("ok")


def test_packing_is_certified(spark, sf):
    for r in queries.p6_certificate(spark, sf).collect():
        assert r["bound"] <= r["containers"] <= r["bound"] + max(1, r["bound"] // 50)
        assert r["overfull"] == r["incomplete"] == 0


def test_residue_is_found_with_its_evidence(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.p8_reasons(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in queries.p8_found(spark, sf).collect()}
    assert rows and all(residue.residue_of(texts[r["doc_id"]])[0] == r["kind"] for r in rows)
    assert len(rows) == sum(residue.residue_of(t) is not None for t in texts.values())


def test_passages_lie_where_they_say(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.p7_passages(spark, sf).collect()
    assert rows and all(r["words"] >= 12 and 0 <= r["begin"] < r["end"] <= len(docs[r["doc_id"]]) for r in rows)


def test_containers_of_every_specification(spark, sf):
    got = queries.p6_containers(spark, sf).collect()
    capacity = {r["spec_id"]: r["capacity_tokens"] for r in spark.read.parquet(f"{sf}/container_spec.parquet").collect()}
    assert {r["spec_id"] for r in got} == set(capacity) and len(capacity) == 3
    assert all(r["used"] + r["unused"] == capacity[r["spec_id"]] and r["unused"] >= 0 for r in got)
    total = {s: sum(r["used"] for r in got if r["spec_id"] == s) for s in capacity}
    docs = {s: {i for r in got if r["spec_id"] == s for i in r["documents"]} for s in capacity}
    assert len(set(total.values())) == 1 and docs[1] == docs[2] == docs[3] != set()
