import string
from collections import Counter

from loomspan.llm import common
from loomspan.llm.line_dedup import kept_text, line_keep_runs
from tests.llm.cases import CLASH_UPPER, TEXTS, frame, pairs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(texts, least):
    seen = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def result(df, least):
    out = line_keep_runs(df, min_docs=least)
    rows = out.select("doc_id", "n_lines", "n_dropped", kept_text(out["text"], out["keep_runs"]).alias("kept")).collect()
    return Counter(tuple(r) for r in rows)


def test_odd_rows(spark):
    assert result(frame(spark), 3) == brute(TEXTS, 3)
    assert result(frame(spark, clash=CLASH_UPPER), 3) == brute(TEXTS, 3)


def test_without_broadcasts(spark, monkeypatch):
    """Frequent digests and run lengths are joined by shuffles."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    texts = TEXTS + [(300 + k, f"hot line\nown {k}\n hot LINE\nhot line") for k in range(200)] + [(301, "other text of 301\nhot line"), (None, "hot line")]
    assert result(pairs(spark, texts), 3) == brute(texts, 3)


def test_the_first_occurrence_can_be_kept(spark):
    texts = [(5, "a\nb\na"), (3, "b\nx\nb\nb"), (9, "A\nb"), (4, "y\nz"), (None, "q\nQ"), (1, "q")]
    rows = line_keep_runs(pairs(spark, texts), min_docs=2, keep_first=True)
    kept = {r[0]: r[1] for r in rows.select("doc_id", kept_text(rows["text"], rows["keep_runs"])).collect()}
    assert kept == {5: "a", 3: "b\nx", 9: "", 4: "y\nz", None: "q", 1: ""}


def test_accents_differ_but_ascii_case_does_not(spark):
    texts = [(i, t) for i, t in enumerate(["É", "é", "A", " a ", "\x0ba", ""])]
    assert result(pairs(spark, texts), 2) == brute(texts, 2)


def test_runs_say_what_stays(spark):
    texts = [(1, "x\ny\nx"), (2, "x\nz")]
    rows = {r.doc_id: r.keep_runs for r in line_keep_runs(pairs(spark, texts), min_docs=2).collect()}
    assert rows == {1: [0, 1, 1, 1], 2: [0, 1, 1]}


def test_empty_table(spark):
    assert line_keep_runs(pairs(spark, [])).count() == 0


def test_other_columns_stay(spark):
    assert {"id", "chunk", "gone"} <= set(line_keep_runs(frame(spark), 3).columns)
