import hashlib

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import test_decontaminate, test_line_dedup, test_ngram_join


def plain(docs, items):
    """The stages in plain Python: ids and final texts."""
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    rows = test_line_dedup.brute(docs, 10)
    docs = [(i, kept) for (i, n, gone, kept), times in rows.items() for _ in range(times) if gone < n]
    classes = test_ngram_join.brute(docs)
    first = {i for i, c, _ in classes if i == c}
    docs = [(i, t) for i, t in docs if i in first]
    leaked = {i for i, _ in test_decontaminate.brute(docs, items)}
    return {i: t for i, t in docs if i not in leaked}


def test_stages_by_brute_force(spark, tmp_path):
    """The whole pipeline on a small fixture: short documents of the table, some of them copied, with shared lines and a
    benchmark item set into two."""
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    items = [(r.item_id, r.text) for r in read("benchmark").limit(5).collect()]
    rows = [tuple(r) for r in read("documents").where("n_chars < 1500").orderBy("doc_id").limit(60).collect()]
    rows = [(i, text + ("\nA line that many share" if i % 3 == 0 else ""), lang, source, n) for i, text, lang, source, n in rows]
    top = max(r[0] for r in rows)
    rows += [(top + 1 + k, r[1], *r[2:]) for k, r in enumerate(rows[:10])]
    rows += [(top + 100, rows[3][1] + "\n" + items[0][1], "en", "x", 1), (top + 101, items[1][1], "en", "x", 1)]
    rows += [(top + 102, "123 456", "en", "x", 7), (top + 103, None, None, None, None), (top + 104, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, read("documents").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = plain([(r[0], r[1]) for r in rows], items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(expected)
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in expected.items()}
    assert top + 100 not in expected and top + 101 not in expected and len(expected) > 30


def test_all_but_the_last_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs, DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 0


def test_one_copy_of_each_text_is_left_by_the_line_stage(spark):
    """Texts that ten documents or more hold line by line, with and without a blank line, in the same lines by turns."""
    texts = ["Alpha one\nBeta two", "Beta two\n\nAlpha one", "Alpha one\nBeta two\nits own line"]
    rows = [(100 - k, texts[k % 2], "en", "x", len(texts[k % 2])) for k in range(24)] + [(7, texts[2], "en", "x", 1), (8, "seldom", "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, DATA).collect()}
    assert {i: t for i, t in got.items() if t[0].strip()} == {i: (t, len(t)) for i, t in ((7, "its own line"), (8, "seldom"), (77, texts[1]), (78, texts[0]))}
    assert not {100 - k for k in range(0, 22, 2)} & set(got)


def test_the_language_stage_rejects_other_languages_and_keeps_clean_texts(spark):
    """Texts in scripts of none of the languages go; short and odd texts in one of them stay."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = [tuple(r) for r in table.orderBy("doc_id").collect()]
    top = max(r[0] for r in docs)
    odd = ["Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "敏捷的棕色狐狸跳过懒狗", "12 34", None, "", "The."]
    rows = docs + [(top + 1 + k, t, None, None, None) for k, t in enumerate(odd)]
    kept = {r.doc_id for r in corpus_pipeline.languages(spark, spark.createDataFrame(rows, table.schema), DATA).collect()}
    assert kept == {r[0] for r in docs if r[1] and any(c.isalpha() for c in r[1])} | {top + 6}


def test_further_columns_pass_through(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    names = ["Score", "Lang_Pred", "KEEP_RUNS", "n_lines", "left_x", "Class_Id", "N_Links", "leaked", "_m1"]
    wide = table.select("*", *[(table.doc_id + k).alias(n) for k, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns
        assert all(r[n] == r["doc_id"] + k for r in out.collect() for k, n in enumerate(names))
