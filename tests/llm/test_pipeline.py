"""The pipeline's stages against plain versions of what they say."""

import pytest

import corpus_pipeline as P
from viewloom.llm import decontaminate

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    found.append(docs)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append(docs)
    return found


def test_columns_and_order(stages):
    assert all(d.columns == P.COLUMNS for d in stages[1:-1])
    assert [n for n, _ in P.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in kept for k in good) >= 0.95 * len(good)


def test_one_document_of_each_class(stages):
    from tests.llm.test_corpus import brute_classes

    classes = brute_classes([(r.doc_id, r.text) for r in stages[1].collect()])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(classes.values()))


def test_no_leak_is_left(spark, stages):
    from tests.llm.test_corpus import closest, plain_codes

    items = [plain_codes(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        return any(closest(i, plain_codes(text))[0] <= decontaminate.budget(len(i), 0.1) for i in items)

    before, after = {r.doc_id: r.text for r in stages[2].collect()}, {r.doc_id for r in stages[3].collect()}
    assert all(leaks(before[k]) for k in set(before) - after)
    some = sorted(after)[:25]
    assert not any(leaks(before[k]) for k in some)


def test_mix_and_shards(stages):
    assert {r.doc_id for r in stages[4].select("doc_id").collect()} <= {r.doc_id for r in stages[3].select("doc_id").collect()}
    assert stages[5].count() == stages[4].count()


def test_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", "a", 0, "x"), (None, "", "en", None, 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, label string")
    for rows in (docs.where("false"), docs):
        for _, stage in P.STAGES:
            assert stage(spark, rows, SMALL).count() <= 2


def test_repeated_rows_leave_one(spark):
    text = "the same words stand here more than once in this table of documents"
    rows = [(1, text), (1, text), (2, text), (3, "another text with its own words that nothing else has at all here"), (None, text), (None, "a text without an id that stands alone in the table and stays")]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.keep_one_of_each(spark, docs, SMALL).collect()
    texts = [r.text for r in kept]
    assert sum(r.doc_id == 1 for r in kept) == 1 and not any(r.doc_id == 2 for r in kept) and sum(r.doc_id == 3 for r in kept) == 1
    assert texts.count(rows[5][1]) == 1


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_are_decided_by_id_and_text(spark):
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words[:59] + ["x"]), " ".join(f"v{i}" for i in range(30))
    rows = [(3, " ".join(words)), (None, " ".join(words)), (None, near), (7, near), (7, other)]  # 7: a near copy of 3, and a text of its own
    nameless = " ".join(f"u{i}" for i in range(60))
    rows += [(None, nameless), (None, nameless + " x")]  # two near copies, both without an id
    kept = [(r.doc_id, r.text) for r in P.keep_one_of_each(spark, spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], DOCS), SMALL).collect()]
    assert sorted(x for x in kept if x[0]) == [rows[0], rows[4]]
    assert [k for k, _ in kept].count(None) == 1 and len(kept) == 3


def test_leaks_without_an_id_are_dropped(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, item), (7, f"before {item} after"), (7, "a text that leaks nothing"), (None, "another that leaks nothing")]
    kept = P.drop_leaks(spark, spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], DOCS), SMALL).collect()
    assert sorted(r.text for r in kept) == [rows[2][1], rows[3][1]]
