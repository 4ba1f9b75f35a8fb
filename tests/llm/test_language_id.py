import zlib

import pytest
from pyspark.sql import functions as F

from loomspan.llm import language_id
from loomspan.llm import queries
from tests.conftest import DATA
from tests.llm.cases import CLASH_UPPER, TEXTS, frame, pairs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_language_id(spark, DATA).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 20 and sum(r.lang_pred == r.lang for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def brute(text, profiles, top):
    """Out-of-place distance, in plain Python."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return "und", 0.0
    padded, n = f" {' '.join(words)} ", {}
    for size in (1, 2, 3):
        for i in range(len(padded) - size + 1):
            gram = padded[i : i + size]
            if gram != " ":
                n[gram] = n.get(gram, 0) + 1
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    ranked = [code(g) for g in sorted(n, key=lambda g: (-n[g], code(g)))][:top]
    away = {lang: sum(abs(i - grams.index(g)) if g in grams else top for i, g in enumerate(ranked)) for lang, grams in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (top * len(ranked))


def test_distance_by_brute_force(spark):
    learn = spark.createDataFrame([("the river and the stone", "en"), ("la pierre et la rivière", "fr"), ("der Stein und der Fluss", "de"), (None, "en"), ("x", None)], "text string, lang string")
    profiles = language_id.fit_profiles(learn)
    assert set(profiles) == {"de", "en", "fr"}
    for row in language_id.identify_language(frame(spark), profiles).collect():
        lang, score = brute(row.text, profiles, language_id.TOP)
        assert row.lang_pred == lang and row.score == pytest.approx(score)


def test_cases(spark):
    profiles = {"b": [ord("a")], "a": [ord("a")]}
    rows = {r.text: r for r in language_id.identify_language(pairs(spark, [(1, None), (2, "123 !"), (3, "a"), (4, "")]), profiles).collect()}
    assert rows[None].lang_pred == rows["123 !"].lang_pred == rows[""].lang_pred == "und"
    assert rows["a"].lang_pred == "a"
    assert language_id.identify_language(pairs(spark, [(1, "a")]), {}).first().lang_pred == "und"
    assert language_id.identify_language(pairs(spark, []), profiles).count() == 0
    assert language_id.fit_profiles(spark.createDataFrame([], "text string, lang string")) == {}
    for clash in (CLASH_UPPER, CLASH_UPPER.lower()):
        out = language_id.identify_language(frame(spark, clash=clash), profiles)
        assert out.count() == len(TEXTS) and {"language", "digests"} <= {c.lower() for c in out.columns}
    assert language_id.identify_language(frame(spark), profiles).count() == len(TEXTS)


def test_prediction_sees_the_text_alone(spark):
    docs = spark.createDataFrame([(1, "word", "en"), (2, "word", "fr")], "doc_id long, text string, lang string")
    rows = language_id.identify_language(docs, {"en": [ord("w")], "fr": [ord("q")]}).select("lang_pred", F.col("lang")).collect()
    assert {r.lang_pred for r in rows} == {"en"}
