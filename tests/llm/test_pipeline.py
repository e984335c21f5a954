"""The pipeline, stage by stage, against what the operators say of its input."""

import corpus_pipeline
import pytest
from grantlake.llm import decontaminate, license_scan, line_dedup, mixing, quality, sharding, simhash, substring, toxicity
from grantlake.llm.queries import oracle_sql, queries
from pyspark.sql import functions as F
from test_operators import DOCS, brute, labelled, messy  # noqa: F401


def write(spark, folder, docs, bench=(), labels=()):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    rows, labels = labelled(240)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    docs += [(1000 + i, docs[1 + 4 * i][1], "en", "s0", 1) for i in range(10)] + [(2000, None, "en", None, 0), (2001, "", "en", "s1", 0), docs[5], (None, "no id here at all", "en", "s2", 1)]
    bench = [(1, docs[9][1])]
    folder = write(spark, tmp_path, docs, bench, [(i, 1, y) for i, y in labels])
    at = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.train(at, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = corpus_pipeline.without_toxic(spark, at, folder)
    bad = {r.doc_id for r in toxicity.score_documents(at, machine).where("predicted = 1").collect()}
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(d[0]) for d in docs if d[0] not in bad)
    one = corpus_pipeline.without_near_duplicates(spark, clean, folder)
    want = {r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert sorted(map(str, (r.doc_id for r in one.collect()))) == sorted(map(str, want)) and one.columns == at.columns
    pure = corpus_pipeline.without_contamination(spark, one, folder)
    assert {r.doc_id for r in pure.collect()} == {r.doc_id for r in one.collect() if not brute(r.text, bench)[4]} != {r.doc_id for r in one.collect()}
    mixed = corpus_pipeline.mixed(spark, pure, folder)
    taken = mixing.mix_report(pure).agg({"taken": "sum"}).first()[0]
    assert mixed.columns == at.columns and sum(len(r.text.split()) for r in mixed.collect()) == taken
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(r.doc_id), r.text) for r in mixed.collect())
    assert {"shard", "slot", "grown_shard"} <= set(out[0].asDict()) and len(corpus_pipeline.STAGES) == 5
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
    assert sharding.shard_records(mixed).count() == mixed.count()


def test_one_row_of_each_group_whatever_the_ids(spark, tmp_path):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    docs = [(None, text(i % 20), "en", "s", 1) for i in range(25)] + [(3, text(100), "en", "s", 1), (5, text(101), "en", "s", 1), (5, text(100), "en", "s", 1), (7, text(102), "en", "s", 1), (7, text(103), "en", "s", 1), (None, text(103), "en", "s", 1)]
    folder = write(spark, tmp_path, docs)
    at = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.without_near_duplicates(spark, at, folder)
    want = [(None, text(i)) for i in range(20)] + [(3, text(100)), (5, text(101)), (7, text(102)), (7, text(103))]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(i), t) for i, t in want) and got.columns == at.columns


#: Names that operators and stages use inside.
INSIDE = "row name size hash tie bucket start source_size target words taken slot epoch block cut known text_crc32 law shard grown_shard scores hits items items_ key fp least id dkey seed copies component_id fingerprint root score predicted held_out toxic page_id host lines h places part path _sum _before _inner _size _hash _tie _scores _bucket _id _row _hits _items _source _start _slot url html"


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_columns_may_have_any_name(spark, tmp_path, case):
    rows, labels = labelled(120)
    names = [case(n) for n in INSIDE.split()]
    folder = write(spark, tmp_path, [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], [(1, rows[9][1])], [(i, 1, y) for i, y in labels])
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        assert all(r[n] == f"{n}-{r.doc_id}" for r in got.collect() for n in names)
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, stage(spark, plain, folder).collect()))
    out = corpus_pipeline.sharded(spark, docs, folder)
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.columns == [c for c in docs.columns if c.lower() not in new] + new
    assert sorted(map(str, out.select("doc_id", *new).collect())) == sorted(map(str, corpus_pipeline.sharded(spark, plain, folder).select("doc_id", *new).collect()))
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    for apply in (simhash.near_duplicates, mixing.mix_report, quality.judge_quality, substring.find_passages, license_scan.scan_licenses, lambda d: decontaminate.contamination(d, benchmark), lambda d: line_dedup.drop_boilerplate(d, key="doc_id", url="source", html="text")):
        assert sorted(map(str, apply(docs).collect())) == sorted(map(str, apply(plain).collect()))


def test_empty_pipeline(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0


def test_registered():
    assert [n.split("_")[0] for n in list(queries())[:10]] == [f"op{i}" for i in range(1, 11)] and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


def test_training_gives_memory_back(spark, monkeypatch):
    """Free memory of the driver's training must not stay beside what the later stages need."""
    from grantlake.llm import toxicity

    called = []
    monkeypatch.setattr(toxicity, "give_back", lambda: called.append(1))
    docs = spark.createDataFrame([(i, f"you are {'nice' if i % 2 else 'nasty'} {i}") for i in range(12)], "doc_id long, text string")
    toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as toxic"))
    assert called == [1]
