"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and to in for that with from this edition river stone cloud paper window market garden bridge winter summer letter number garden".split()


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "ed"]) for _ in range(n))


def near(text: str, at: int) -> str:
    words = text.split()
    words[at % len(words)] = "changed"
    return " ".join(words)


BASE = sentence(1, 120)
TEXTS: list[tuple[int | None, str | None]] = [
    (0, BASE),
    (1, BASE),
    (2, near(BASE, 60)),
    (3, near(near(BASE, 10), 90)),
    (4, sentence(2, 80)),
    (5, None),
    (6, ""),
    (7, " \n\t\n "),
    (8, "short"),
    (9, "Été à la plage\nÉTÉ À LA PLAGE\n  Common Line \t"),
    (10, "ça va – 漢字 😀\nCOMMON LINE"),
    (None, BASE),
    (None, None),
    (4, sentence(2, 80)),
    (12, sentence(3, 30_000)),
    (13, "a" * 3000),
    (14, "common line\ncommon line"),
    (15, sentence(4, 20) + " " + BASE[100:300]),
]
CLASH = "id string, t string, chunk int, x int, h int, d int, gone int, row int, seeds int, hit_doc int, n_lines string, n_dropped int, keep_runs int, class_id string, n_links string, lang_pred int, score string, n_tokens string, ids int, decoded int, section int, ids_sha256 int, digests int, language int"

#: The same clashes in another case, and names that operators once used inside.
CLASH_UPPER = "ID string, T string, Chunk int, Language int, Digests int, Main_Text string, NGRAM_T string, ngram_class int, Row_Host string, _M int, _m_k0 string, _mhv0 int, Class_Id string, N_Links string, N_Lines int, Keep_Runs string, Lang_Pred int, Part int, Seed int, Label int, H int, At int, Bits string"


def frame(spark, texts=None, clash=CLASH):
    """doc_id, text and columns whose names clash with outputs and with what operators use inside."""
    extra = [c.split() for c in clash.split(", ")]
    rows = [(i, t, *["1" if k == "string" else 1 for _, k in extra]) for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clash}").repartition(3)


def pairs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")
