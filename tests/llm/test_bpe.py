import base64
import hashlib
import random

import public_tokenizers as tokenizers
import pytest
import tiktoken

from loomspan.llm import bpe
from tests.llm.cases import CLASH_UPPER, TEXTS, frame, pairs

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.byte_pairs(PATH, tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def expected(theirs, text):
    ids = theirs.encode_ordinary(text or "")
    return len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())


def test_random_texts(ours, theirs):
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice(["ab", " \n\t", "éñß漢字", "0123", "abcdefghijklmnopqrstuvwxyz", "{}[]--==", "th eraning"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 200])))
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_very_long_pre_token(ours, theirs):
    for text in ("a" * 20_000, "ab" * 10_000, " " * 20_000):
        assert ours.encode(text) == theirs.encode_ordinary(text)
        assert ours.decode(ours.encode(text)) == text.encode()


def test_a_lower_rank_that_comes_up_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 300, b"ab": 290, b"abcd": 270, b"xab": 260}
    ours = bpe.BytePairs(ranks, r"\S+|\s+")
    theirs = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abcdx") for _ in range(rng.randint(1, 12)))
        assert ours.encode(text) == theirs.encode_ordinary(text), text


def test_small_groups_and_store(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 40)
    monkeypatch.setattr(bpe, "KEPT", 60)
    code = bpe.BytePairs(bpe.byte_pairs(PATH, tokenizers.PATTERN).ranks, tokenizers.PATTERN)
    texts = [t or "" for _, t in TEXTS if not t or len(t) < 5000]
    assert list(code.digests(texts)) == [expected(theirs, t) for t in texts]


def test_rows(spark, theirs):
    assert "Digests" in bpe.bpe_digests(frame(spark, clash=CLASH_UPPER), PATH, tokenizers.PATTERN).columns
    made = bpe.bpe_digests(frame(spark), PATH, tokenizers.PATTERN).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made) == sorted(expected(theirs, t) for _, t in TEXTS)
    assert bpe.bpe_digests(pairs(spark, []), PATH, tokenizers.PATTERN).count() == 0


def test_ids_round_trip(spark):
    back = bpe.bpe_decode(bpe.bpe_encode(frame(spark), PATH, tokenizers.PATTERN), PATH, tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
