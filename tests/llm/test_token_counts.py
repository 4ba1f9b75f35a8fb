import base64
from collections import defaultdict

import public_tokenizers as tokenizers
import pytest
import tiktoken

from loomspan.llm import token_counts
from tests.llm.cases import TEXTS, frame, pairs

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pieces(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    code = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(code.decode_single_token_bytes(i)) for i in code.encode_ordinary(text or "")]


def brute(text, starts, rule):
    """Byte by byte: which section a byte is in, then the rule."""
    text = text or ""
    section = []
    for i, c in enumerate(text):
        k = sum(s <= i for s in starts) - 1
        section += [k] * len(c.encode())
    n, at = [0.0] * len(starts), 0
    for size in pieces(text):
        mine = section[at : at + size]
        at += size
        if rule == "first":
            n[mine[0]] += 1
        elif rule == "last":
            n[mine[-1]] += 1
        elif rule == "shared":
            for k in mine:
                n[k] += 1 / size
        else:
            n[max(sorted(set(mine)), key=mine.count)] += 1
    return n


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_rules(spark, rule):
    texts = [(1, "one two\nthree   four\n\nfünf 漢字漢字\n"), (2, ""), (3, None), (4, "no break"), (5, "\n\n\n"), (6, "😀😀 a\n😀")]
    every = lambda t: list(range(0, max(1, len(t)), 3))  # noqa: E731  boundaries inside tokens and characters' bytes
    for sections in (token_counts.line_starts, every):
        found = defaultdict(list)
        for r in sorted(token_counts.token_counts(pairs(spark, texts), PATH, tokenizers.PATTERN, sections=sections, rule=rule).collect(), key=lambda r: (r.doc_id, r.section)):
            found[r.doc_id].append(r.n_tokens)
        for i, t in texts:
            assert found[i] == pytest.approx(brute(t, sections(t or ""), rule)), (i, rule)


def test_odd_rows_sum_to_whole_documents(spark):
    rows = token_counts.token_counts(frame(spark), PATH, tokenizers.PATTERN).groupBy("doc_id").sum("n_tokens").collect()
    expected = defaultdict(float)
    for i, t in TEXTS:
        expected[i] += len(pieces(t))
    assert {r[0]: r[1] for r in rows} == expected


def test_empty_table_and_bad_rule(spark):
    assert token_counts.token_counts(pairs(spark, []), PATH, tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(pairs(spark, []), PATH, tokenizers.PATTERN, rule="none")
