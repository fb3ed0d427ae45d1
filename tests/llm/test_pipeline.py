"""The pipeline's stages against plain versions of what they keep."""

import pytest

import corpus_pipeline
from gridspark.llm import bpe, pii
from gridspark.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.test_exact import PATH, PATTERN, plain_components, plain_report


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
        if name != "byte bpe":
            assert out[-1].dtypes == docs.dtypes
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark, kept):
    start, calm, single, clean, private, encoded = kept
    groups = plain_components(rows(calm).items())
    assert set(rows(single)) == {i for i, (_, c) in groups.items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    report = plain_report(rows(single).items(), items)
    assert set(rows(clean)) == {i for i, r in report.items() if not r[4]}
    before, after = rows(clean), rows(private)
    assert set(before) == set(after) and all(t == after[i] for i, t in before.items() if not pii.spans(t or ""))
    assert all(before[i][a:z] not in after[i] for i in before for a, z, _ in pii.spans(before[i] or ""))
    codec = bpe.codec(PATH, PATTERN)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert all(codec.decode(got[i]) == (t or "") for i, t in after.items()) and len(got) == len(after)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(rows(start)) - set(rows(calm))
    assert all(labels.get(i, 1) == 1 for i in gone)


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, SF).count() == kept[-1].count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_forest_search"}))
def test_queries_cover_all_documents(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = QUERIES[name](spark, SF)
    assert got.count() == n if name != "op9_bm25_search" else got.select("query_id").distinct().count() >= 1


def test_search_answers_every_query_vector(spark):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    got = QUERIES["op12_forest_search"](spark, SF)
    assert got.count() == 20 * asked and got.select("query_id").distinct().count() == asked


@pytest.mark.parametrize("labels", [[], [(1, None), (2, None)]])
def test_no_text_goes_without_labels(spark, docs, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs([(1, "a clean text"), (2, "another one"), (3, None)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, d, str(tmp_path)).collect()) == [1, 2, 3]


def test_one_row_of_each_group(spark, docs):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A b c"), (3, "d e f"), (1, "d e f"), (4, "g h"), (None, "g h"), (None, "i j"), (None, "i j"), (5, None), (6, ""), (6, "")]
    left = corpus_pipeline.keep_one_of_each_group(spark, docs(rows), "")
    assert left.columns == docs(rows).columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in left.collect()) == [(0, "i j"), (1, "a b c"), (1, "d e f"), (4, "g h"), (5, ""), (6, ""), (6, "")]


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b c"), (1, "mail jo@x.org now"), (1, "mail jo@x.org now"), (2, ""), (3, "word " * 30_000)]])
def test_stages_with_odd_rows_and_clashing_names(spark, docs, rows, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    names = ("entities", "n_entities", "text_hash", "key", "n", "_h", "root", "ids", "row", "lang2")
    d = docs(rows).selectExpr("*", *(f"'x{i}' as {n}" for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name == "byte bpe":
            assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == d.count()
            break
        assert out.dtypes == d.dtypes
        left = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
        if name in ("toxicity", "decontamination"):
            assert len(left) == len(rows)
        elif name == "jaccard join":
            assert len(left) == max(0, len(rows) - 1)
        else:
            assert len(left) == len(rows) and not any("jo@x.org" in t for _, t in left)
