import base64
import random
import unicodedata

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.encode import encode, token_counts

BITS = ["'", "s", "t", "re", "ve", "ll", "d", "m", "S", " ", "  ", "\n", "\r\n", "\t", " ", "　", "1", "²", "Ⅷ", "é", "Ж", "中", "\U0001f600", "!", "...", "_", "\x00", "\x1c", "​", "é", "<|endoftext|>", "word ", " word", "x y\nab"]


def other(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name + ".tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def pair(request):
    return other(request.param), bpe.encoder(request.param)


def test_like_the_public_encoder(pair):
    ref, enc = pair
    rnd = random.Random(3)
    for _ in range(300):
        texts = ["".join(rnd.choices(BITS, k=rnd.randint(0, 14))) for _ in range(6)] + [None, ""]
        data, off = bpe.raw(pa.array(texts))
        ids, ends = enc.encode_batch(data, off)
        for i, t in enumerate(texts):
            got = ids[ends[i] : ends[i + 1]].tolist()
            assert got == ref.encode_ordinary(t or ""), t
            assert enc.decode(got) == (t or "")
        assert enc.counts(data, off).tolist() == np.diff(ends).tolist()


def test_every_assigned_code_point(pair):
    ref, enc = pair
    t = "".join(chr(i) + "a1 " for i in range(1, 0x2FA20) if unicodedata.category(chr(i)) not in ("Cs", "Cn"))
    assert enc.encode(t) == ref.encode_ordinary(t)


def test_blocks_do_not_matter(pair, monkeypatch):
    ref, enc = pair
    monkeypatch.setattr(bpe, "BLOCK", 40)
    rnd = random.Random(5)
    for _ in range(300):
        t = "".join(rnd.choices(BITS, k=rnd.randint(0, 200)))
        assert enc.encode(t) == ref.encode_ordinary(t), t


def test_endless_run(pair):
    ref, enc = pair
    t = "".join(random.Random(1).choices("abcdefgh", k=60_000))
    assert enc.encode(t) == ref.encode_ordinary(t)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    enc = bpe.ByteBPE(bpe.TOKENIZERS + "/byte_bpe_50k.tiktoken")
    ref = other("byte_bpe_50k")
    for i in range(40):
        t = " ".join(f"w{i}q{j}" for j in range(30))
        assert enc.encode(t) == ref.encode_ordinary(t)


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "it's 1 <|endoftext|>", "x"), (2, "", "y"), (3, None, None), (4, "it's 1 <|endoftext|>", "x"), (None, " ", "z")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode(df, "doc_id", "text").collect()}
    ref = other("byte_bpe_50k")
    assert got[1] == got[4] == ref.encode_ordinary("it's 1 <|endoftext|>") and got[2] == got[3] == [] and got[None] == ref.encode_ordinary(" ")
    n = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"], "text", "byte_bpe_50k").collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_long_pre_tokens(monkeypatch):
    """Pre-tokens as long as texts, merged part by part, give what merging them at once gives."""
    import random

    from tidemark.llm import bpe

    r = random.Random(3)
    whole = bpe.ByteBPE(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    monkeypatch.setattr(bpe, "PART", 600)
    for t in ("a" * 9000, "中" * 3000, "abc" * 3000, "".join(r.choices("qzxjkwvaeio", k=9000)), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(3000)), "é" * 5000, "=-" * 4000):
        monkeypatch.setattr(bpe, "LONG", 1 << 30)
        want = whole.merge(t.encode())
        monkeypatch.setattr(bpe, "LONG", 1000)
        assert whole.merge(t.encode()) == want, t[:9]
