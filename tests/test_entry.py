import importlib.util

import pytest

import __spark_entry__ as entry


def core_names():
    from qirtas.plans import building, queries

    return [*queries.QUERIES, *building.QUERIES]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_part(monkeypatch):
    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(core_names())
    monkeypatch.undo()
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None if name == "qirtas.llm" else find(name))
    assert entry._llm() is None and set(entry.queries()) == set(core_names())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert [f.name for f in df.schema.fields][:3] == ["config", "pair", "n"] and df.count() >= 0


@pytest.mark.parametrize("name", ["bm25_top10", "dense_topk", "neardup_groups", "attribution_table", "pack_beads", "number_audit", "oracle_context", "question_funnel", "paired_mcnemar", "number_repair", "comparison_pairs", "bridges", "alignment_errors_reversed", "appropriation_records", "built_questions", "stored_runs", "evidence_checks"])
def test_queries_equal_their_oracle(spark, name):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    df = entry.queries()[name](spark, folder)
    if name not in entry.oracle_sql():
        assert df.count() >= 0
        return
    db = duckdb.connect()
    for f in os.listdir(folder):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    rel = db.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(tidy(dict(zip(rel.columns, r, strict=True))[c]) for c in names) for r in rel.fetchall()), key=str)
    assert sorted((tuple(tidy(r[c]) for c in names) for r in df.collect()), key=str) == want
