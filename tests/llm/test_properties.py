import glob
import os
import random

import duckdb
import pytest

from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_properties(name, spark, sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, sf).toPandas(), c.sql(SQL[name]).df()
    cols = sorted(got.columns)
    key = lambda df: sorted(tuple(map(int, r)) for r in df[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and key(got) == key(want)


def tables(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    limits = [(1, "byte_bpe_50k", 4096, 1024, 64), (2, "byte_bpe_50k", 2048, 512, 0), (3, "byte_bpe_multi_50k", 8192, 2048, 128)]
    spark.createDataFrame(limits, "spec_id int, tokenizer string, capacity_tokens int, piece_max_tokens int, overlap_tokens int").write.parquet(f"{folder}/token_limits.parquet")
    return str(folder)


def test_texts_are_sent_once(spark, tmp_path):
    """The pieces go to their documents without texts, and the documents' texts are shuffled once for all specs."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    texts = [" ".join(r.choices(words, k=500)) for _ in range(300)]
    d = tables(spark, tmp_path, texts)

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    rows = QUERIES["p8_properties"](spark, d).collect()
    assert {x.n_chars for x in rows} == {sum(map(len, texts))} and {x.n_documents for x in rows} == {len(texts)}
    assert 0 < written() - before < 2 * sum(map(len, texts))


def test_wrong_pieces_are_counted(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.llm import queries

    right = queries.split_each

    def wrong(*args):
        bad = (F.col("doc_id") == 1) & (F.col("piece_no") == 1)
        return right(*args).withColumn("piece_text", F.when(bad, F.concat(F.lit("é"), F.substring("piece_text", 2, 1 << 30))).otherwise(F.col("piece_text")))

    d = tables(spark, tmp_path, ["", "word " * 5000, None, "x"])
    monkeypatch.setattr(queries, "split_each", wrong)
    got = {x.spec_id: x for x in QUERIES["p8_properties"](spark, d).collect()}
    assert {k: (x.n_documents, x.not_their_part, x.over_limit, x.short_overlap) for k, x in got.items()} == {k: (4, 1, 0, 0) for k in (1, 2, 3)}


def test_no_documents(spark, tmp_path):
    rows = QUERIES["p8_properties"](spark, tables(spark, tmp_path, [])).collect()
    assert sorted((x.spec_id, x.n_documents, x.n_chars, x.over_limit, x.short_overlap, x.not_their_part) for x in rows) == [(k, 0, None, 0, 0, 0) for k in (1, 2, 3)]
