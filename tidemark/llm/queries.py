"""Queries p6 to p8 over documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import raw, slices
from tidemark.llm.encode import encode
from tidemark.llm.pack import pack_texts
from tidemark.llm.split import split, split_each
from tidemark.session import materialize
from tidemark.sources.tables import load


def _spec(spark: SparkSession, d: str, spec: int):
    """One row of the fixed table token_limits."""
    return load(spark, d, "token_limits").filter(F.col("spec_id") == spec).first()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(load(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def _pack(spec: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = _spec(spark, d, spec)
        return pack_texts(load(spark, d, "documents"), "doc_id", "text", s.tokenizer, s.capacity_tokens)

    return query


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused space of spec 1."""
    cap = _spec(spark, d, 1).capacity_tokens
    per = _pack(1)(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), F.sum(F.lit(cap) - F.col("t")).alias("unused"))


def _split(spec: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = _spec(spark, d, spec)
        return split(load(spark, d, "documents"), "doc_id", "text", s.piece_max_tokens, s.overlap_tokens, s.tokenizer)

    return query


def p7_properties(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each spec's containers, counted: documents that are there; containers over their capacity; numbers
    left out; documents split though they fit; documents whose parts are not the whole; whether the containers are within
    a twentieth of the least number."""
    out = None
    docs = load(spark, d, "documents").select("doc_id").distinct().count()
    for s in load(spark, d, "token_limits").collect():  # a fixed table of three rows
        got = materialize(_pack(s.spec_id)(spark, d))
        c = got.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
        c = c.agg(F.count_if(F.col("t") > s.capacity_tokens).alias("overfull"), (F.max("container_id") + 1 - F.count(F.lit(1))).alias("left_out"), (F.count(F.lit(1)) <= 1 + 1.05 * F.sum("t") / s.capacity_tokens).alias("near_least"))
        p = got.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.max("token_end").alias("e"), F.min("token_start").alias("b"), F.count(F.lit(1)).alias("n"))
        p = p.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("n") > 1) & (F.col("e") <= s.capacity_tokens)).alias("split_small"), F.count_if((F.col("t") != F.col("e")) | (F.col("b") != 0)).alias("not_whole"))
        one = spark.createDataFrame([(s.spec_id, *c.first(), *p.first())], "spec_id int, overfull bigint, left_out bigint, near_least boolean, n_documents bigint, split_small bigint, not_whole bigint")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("all_there", F.col("n_documents") == docs)


def _held(limits: dict[int, tuple[int, int]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of each (spec, document), from rows of a document's id, its text's bytes and its pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(1))
            null = b.column(1).is_null().to_numpy(False)
            flat, ends = b.column(2).flatten(), np.append(0, np.cumsum(pc.list_value_length(b.column(2)).to_numpy(False)))
            for i, j in slices(off, 4 << 20):
                own = flat.slice(ends[i], ends[j] - ends[i])
                spec, _, start, end, first, last = (own.field(k).to_numpy(False) for k in range(6))
                doc = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
                # the place of each character in bytes, and the character at which each text begins
                part = data[off[i] : off[j]]
                place = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
                at = np.searchsorted(place, off[i : j + 1] - off[i])
                lo, hi = at[doc - i], at[doc - i + 1]
                a, z = (place[np.clip(lo + x, lo, hi)].tolist() for x in (start, end))
                view = memoryview(part.tobytes())
                wrong = [m != (None if n else md5(view[x:y]).digest()) for m, n, x, y in zip(own.field(6).to_pylist(), null[doc].tolist(), a, z)]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (spec[1:] != spec[:-1])
                most, overlap = np.array([limits[k] for k in spec.tolist()], np.int64).reshape(-1, 2).T
                chars = end - np.where(new, 0, np.roll(end, 1))
                short = ~new & (np.roll(last, 1) - first < overlap)
                rows = np.flatnonzero(new)
                sums = [pa.array(np.add.reduceat(np.asarray(x, np.int64), rows)) for x in (chars, last - first > most, short, wrong)]
                yield pa.RecordBatch.from_arrays([pa.array(spec[rows], pa.int32()), b.column(0).take(pa.array(doc[rows])), *sums], names)

    return run


def p8_properties(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each spec's pieces, counted: documents; characters that are new in their piece (together the
    whole texts); pieces over the limit; overlaps shorter than asked for; pieces that are not their part of the text.

    A piece is held against its part of the text by the MD5 of both, so that pieces go without their texts to the
    documents, and these are sent once for all specs. Specs of one tokenizer are split together."""
    specs = load(spark, d, "token_limits")
    text = load(spark, d, "documents").select("doc_id", "text")
    by: dict[str, list] = {}
    for s in specs.collect():  # a fixed table of three rows
        by.setdefault(s.tokenizer, []).append(s)
    got = None
    for tokenizer, own in by.items():
        p = split_each(text, "doc_id", "text", [(s.piece_max_tokens, s.overlap_tokens) for s in own], tokenizer)
        spec = F.element_at(F.array(*[F.lit(s.spec_id) for s in own]), F.col("limit_no") + 1).alias("spec_id")
        p = p.select("doc_id", F.struct(spec, "piece_no", "char_start", "char_end", "token_start", "token_end", F.unhex(F.md5("piece_text")).alias("md5")).alias("p"))
        got = p if got is None else got.unionByName(p)
    got = got.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    got = text.withColumn("text", F.col("text").cast("binary")).join(got, "doc_id")
    limits = {s.spec_id: (s.piece_max_tokens, s.overlap_tokens) for own in by.values() for s in own}
    counts = T.StructType([T.StructField("spec_id", T.IntegerType()), T.StructField("doc_id", text.schema["doc_id"].dataType), *T.StructType.fromDDL("n_chars bigint, over_limit bigint, short_overlap bigint, not_their_part bigint").fields])
    got = got.select("doc_id", "text", "pieces").mapInArrow(_held(limits, counts.names), counts)
    got = got.groupBy("spec_id").agg(F.count_distinct("doc_id").alias("n_documents"), *[F.sum(c).alias(c) for c in counts.names[2:]])
    # a spec without pieces, as over no documents, has its row too
    none = specs.select("spec_id").join(F.broadcast(got), "spec_id", "left").fillna(0, ["n_documents", "over_limit", "short_overlap", "not_their_part"])
    return none.select("n_documents", "n_chars", "over_limit", "short_overlap", "not_their_part", "spec_id")


SQL = {
    "p7_properties": "SELECT spec_id, 0 AS overfull, 0 AS left_out, true AS near_least, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0 AS split_small, 0 AS not_whole, true AS all_there FROM token_limits",
    "p8_properties": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS n_chars, 0 AS over_limit, 0 AS short_overlap, 0 AS not_their_part FROM token_limits",
}
QUERIES = {
    "p7_properties": p7_properties,
    "p8_properties": p8_properties,
    "p6_ids": p6_ids,
    "p7_pack": _pack(1),
    "p7_pack_spec2": _pack(2),
    "p7_pack_spec3": _pack(3),
    "p7_report": p7_report,
    "p8_pieces": _split(1),
    "p8_pieces_spec2": _split(2),
    "p8_pieces_spec3": _split(3),
}
