"""The stages against brute force on a small fixture, and SQL twins of the operators' queries."""

import glob
import os
import random

import duckdb
import pytest

import corpus_pipeline as cp
from skein.llm import registry
from tests.test_oracles import agree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    agree(registry.QUERIES[name], registry.ORACLE.get(name), spark, duck)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean documents, junk, copies and a leak."""
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ba", "le", "mi", "no", "tu", "ra") for b in ("n", "st", "rk", "l", "ve", "d")]
    clean = lambda: " ".join(rng.choice(words) + ("." if k % 9 == 8 else "") for k in range(80)) + "\nend of it."
    docs, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        docs.append((i, clean().upper().replace(" ", "!!! ") if bad else clean(), "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), 0))
    item = " ".join(f"leak{k}" for k in range(20))
    docs += [(300, docs[1][1], "en", "s0", 0), (301, docs[1][1].upper().lower(), "en", "s1", 0), (302, docs[2][1] + " " + item, "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {d[0]: d for d in docs}, item


def test_stages(spark, tables):
    folder, all_docs, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    steps = dict(cp.STAGES)
    kept = steps["quality"](spark, docs, folder).cache()
    assert ids(kept) == [i for i in all_docs if i >= 300 or i % 4]
    alone = steps["near_dedup"](spark, kept, folder).cache()
    assert ids(alone) == [i for i in ids(kept) if i not in (300, 301)]
    pure = steps["decontaminate"](spark, alone, folder).cache()
    texts = {r.doc_id: r.text for r in pure.collect()}
    assert sorted(texts) == ids(alone) and texts[302] == all_docs[302][1].replace(item, "") and all(texts[i] == all_docs[i][1] for i in texts if i != 302)
    mixed = steps["mix"](spark, pure, folder).cache()
    assert mixed.columns == docs.columns
    total = sum(len(t.split()) for t in texts.values())
    for source, weight in (("s0", 5), ("s1", 2), ("s2", 1)):
        size = sum(len(r.text.split()) for r in mixed.where(f"source = '{source}'").collect())
        assert abs(size - total * weight / 8) <= 60
    out = steps["shard"](spark, mixed, folder)
    assert ids(out) == ids(mixed) and {r.shard for r in out.collect()} == {""}
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(map(tuple, out.collect()))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_nulls_repeats_and_an_empty_table(name, spark, tables):
    folder = tables[0]
    stage = dict(cp.STAGES)[name]
    data = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "some words here", "en", "a", 15), (1, "some words here", "en", "a", 15), (2, "other words there " * 50, None, None, 900), (None, "some words here", "en", "b", 15)]
    docs = spark.createDataFrame(data, DOCS)
    out = stage(spark, docs, folder)
    rows = out.collect()
    assert len(rows) <= 3 * len(data)
    if name != "shard":
        assert out.columns == docs.columns
    if name == "near_dedup":  # one of the repeated rows stays, and rows without an id
        assert sorted((str(r.doc_id), r.text) for r in rows if r.text) == sorted([("1", "some words here"), ("2", data[4][1]), ("None", "some words here")])
    if name == "shard":
        assert len(rows) == len(data)
    if name == "mix":
        assert sum(r.doc_id == 2 for r in rows) <= 3
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_columns_named_like_results_come_back_as_they_were(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").selectExpr(
        "*", "array('mine') AS items", "'s' AS spans", "-1 AS n_words", "-2 AS size", "-3 AS copies", "-4 AS score", "-5 AS predicted", "'x' AS _text", "-6 AS target", "'k' AS contaminated"
    )
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name
        assert {tuple(map(str, r)) for r in out.select(docs.columns[5:]).distinct().collect()} == {("['mine']", "s", "-1", "-2", "-3", "-4", "-5", "x", "-6", "k")}, name
    assert cp.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_tables_of_other_results_outlive_a_run(spark, tables):
    from skein.llm import lines

    out = lines.dedup_lines(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    cp.run(spark, tables[0])
    assert sorted((r.doc_id, r.n_repeated) for r in out.collect()) == [(1, 0), (2, 1)]
