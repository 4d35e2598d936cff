import random

import pytest

from tidemark.llm.bpe import encoder
from tidemark.llm.split import CUE, KINDS, SENTENCE, WORD, cuts, split, split_each

ENC = encoder("byte_bpe_50k")


def srt(n, seed=0, nl="\n"):
    r = random.Random(seed)
    words = ["Wait", "lantern", "Où", "ключ", "bridge", "42", "it's", "…", "中文。", "😀", "compass,"]
    return "".join(f"{i}{nl}00:00:{i % 60:02d},100 --> 00:00:{i % 60:02d},900{nl}{' '.join(r.choices(words, k=8))}.{nl}{nl}" for i in range(n))


TEXTS = {
    1: srt(60), 2: srt(200, 1, "\r\n"), 3: "", 4: None, 5: "x", 6: " ".join(["word"] * 900), 7: "a" * 4000, 8: "中" * 900,
    9: "One sentence here. Another one! " * 120, 10: "{1}{20}one|two\n" * 150, 11: "😀" * 400, 12: " \n \n\t" * 200, 13: srt(60), 14: "'s'll " * 500,
}
MOST, OVER = 100, 16


def run(spark, **kw):
    df = spark.createDataFrame([(k, v, "x") for k, v in TEXTS.items()], "doc_id bigint, text string, piece_no string")
    out = {}
    for r in split(df, "doc_id", "text", MOST, OVER, **kw).collect():
        out.setdefault(r.doc_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def test_pieces(spark):
    got = run(spark)
    assert set(got) == set(TEXTS)
    for k, rows in got.items():
        t = TEXTS[k] or ""
        ids = ENC.encode(t)
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        assert rows[0].token_start == 0 and rows[-1].token_end == len(ids) and rows[-1].cut == "end" and rows[-1].char_end == len(t)
        if len(ids) <= MOST:
            assert len(rows) == 1 and rows[0].piece_text == TEXTS[k]
            continue
        for r in rows:
            assert r.piece_text == t[r.char_start : r.char_end]
            assert ENC.decode(ids[r.token_start : r.token_end]) == r.piece_text
            assert 0 < r.token_end - r.token_start <= MOST and len(ENC.encode(r.piece_text)) <= MOST
        for a, b in zip(rows, rows[1:]):
            assert OVER <= a.token_end - b.token_start <= OVER + 3 and b.token_end > a.token_end


def test_natural_cuts(spark):
    got = run(spark)
    assert {r.cut for k in (1, 2, 10, 13) for r in got[k][:-1]} == {"cue"}
    assert {r.cut for r in got[9][:-1]} == {"sentence"} and {r.cut for r in got[6][:-1]} == {"word"}
    assert {r.cut for r in got[7][:-1]} == {"token"}
    for r in got[2][:-1]:
        assert r.piece_text.endswith("\r\n\r\n")


@pytest.mark.parametrize("reach,halo", [(300, 120), (1000, 200), (200, 4)])
def test_ranges_do_not_matter(spark, reach, halo):
    assert run(spark, reach=reach, halo=halo) == run(spark)


def test_cuts():
    k = [WORD] * 50
    k[9], k[18], k[24] = CUE, SENTENCE, WORD
    import numpy as np

    assert cuts(np.array(k, np.uint8), 20, 4)[:2] == [(0, 10, CUE), (6, 19, SENTENCE)]
    assert KINDS[CUE] == "cue"


def runs():
    r = random.Random(5)
    return {
        1: "a" * 150_000, 2: "中" * 50_000, 3: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(60_000)), 4: "".join(r.choices("ABCDefghij0123456789+/", k=120_000)),
        5: "=" * 99_991, 6: "x " + " \n" * 40_000 + "y" * 9000, 7: "abc" * 30_000, 8: "²5" * 40_000, 9: "".join(r.choices("qzxjkwv", k=120_000)), 10: "'" * 70_000 + "s" * 70_000, 11: "ab'" * 40_000, 12: "word" + "é" * 80_000,
    }


def test_endless_runs(spark):
    """Endless lines of one class go through ranges, and come out as if worked on whole."""
    df = spark.createDataFrame(list(runs().items()), "doc_id bigint, text string")
    key = lambda rows: sorted(map(tuple, rows), key=lambda x: (x[0], x[1]))
    a = split(df, "doc_id", "text", MOST, OVER, reach=5000, halo=500).collect()
    assert key(a) == key(split(df, "doc_id", "text", MOST, OVER, reach=1 << 30).collect())
    for k, t in runs().items():
        assert "".join(r.piece_text for r in key_of(a, k)) and key_of(a, k)[-1].char_end == len(t)


def key_of(rows, k):
    return sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece_no)


def test_ranges_of_runs():
    """All but runs of white space are cut into ranges of about the nominal size, whose tokens are those of the whole."""
    import numpy as np

    from tidemark.llm.split import SOFT, next_cut

    for k, t in runs().items():
        data = np.frombuffer(t.encode(), np.uint8)
        lo, left, ids, most = 0, 0, [], 0
        while lo < len(data):
            hi, right = next_cut(ENC, data, lo, lo + 5000, len(data), 500, left) if lo + 5000 < len(data) else (len(data), 0)
            part = ENC.encode(data[lo:hi].tobytes().decode())
            assert left != SOFT or ENC.fit(ids[-1], part[0])
            ids += part
            most, lo, left = max(most, hi - lo), hi, right
        assert ids == ENC.encode(t), k
        assert most < 7000 or k == 6


def test_overlap_within_characters(spark):
    """Where tokens straddle characters, a piece begins at the last token before its overlap that begins with one."""
    enc = encoder("byte_bpe_multi_50k")
    t = "운열쇠에손대지마!정말조용한밤이었지. 알았어,가자. " * 90
    ends = [0]
    for i in enc.encode(t):
        ends.append(ends[-1] + enc.width[i])
    data = t.encode()
    within = [e < len(data) and (data[e] & 0xC0) == 0x80 for e in ends]
    df = spark.createDataFrame([(1, t)], "doc_id bigint, text string")
    for over in range(9, 25):
        rows = sorted(split(df, "doc_id", "text", 60, over, tokenizer="byte_bpe_multi_50k").collect(), key=lambda r: r.piece_no)
        for a, b in zip(rows, rows[1:]):
            assert a.token_end - b.token_start >= over and not within[b.token_start]
            assert all(within[b.token_start + 1 : a.token_end - over + 1])


def test_limits(spark):
    with pytest.raises(ValueError):
        split(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", 10, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert split(df, "doc_id", "text", MOST, OVER).count() == 0


def test_repeated_rows_and_null_ids(spark):
    t = [(1, TEXTS[2]), (1, TEXTS[2]), (1, TEXTS[9]), (None, TEXTS[1]), (None, TEXTS[7]), (2, TEXTS[7])]
    df = spark.createDataFrame(t, "doc_id bigint, text string")
    key = lambda rows: sorted(map(str, rows))
    a, b = split(df, "doc_id", "text", MOST, OVER, reach=500, halo=100).collect(), split(df, "doc_id", "text", MOST, OVER).collect()
    assert key(a) == key(b) and sum(r.piece_no == 0 for r in a) == len(t)


@pytest.mark.parametrize("reach,halo", [(1 << 16, 1 << 12), (500, 100)])
def test_several_limits(spark, reach, halo):
    """Limits that are worked on together give the pieces that each gives by itself."""
    limits = [(MOST, OVER), (60, 0), (700, 128), (MOST, OVER)]
    df = spark.createDataFrame(list(TEXTS.items()) + [(20, "a" * 9000)], "doc_id bigint, text string")
    got = split_each(df, "doc_id", "text", limits, reach=reach, halo=halo).collect()
    for no, (most, overlap) in enumerate(limits):
        alone = split(df, "doc_id", "text", most, overlap, reach=reach, halo=halo).collect()
        assert sorted(map(str, (tuple(r)[:-1] for r in got if r.limit_no == no))) == sorted(map(str, map(tuple, alone)))
