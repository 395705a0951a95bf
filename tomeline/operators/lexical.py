"""BM25 over token postings, scored in blocks of texts and questions.

Null and blank texts have no tokens; a term counts once for each time it stands in the text; query terms count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tomeline.functions.text import tokens
from tomeline.session import cut, shuffle_width

K1, B = 1.2, 0.75
BLOCK_DOCS, BLOCK_QUERIES, GROUP, OUT_ROWS = 4_096, 8_192, 64, 20_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, term, tf, dl; a document without words has one row without term."""
    words = docs.select(F.col(key).alias("doc"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t")).withColumn("dl", F.size("t"))
    return words.select("doc", "dl", F.explode_outer("t").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """n_docs, avgdl of postings."""
    return post.groupBy("doc").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts as blocks of postings: words (each with the number of its postings), and for each word the places of its
    texts in the block and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(at, BLOCK_DOCS)
                n, words = part.num_rows, part.column("t")
                lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = words.flatten().dictionary_encode()
                pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
                sizes = np.bincount(pairs // n, minlength=len(coded.dictionary)).astype(np.int32)
                many = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                raw = lambda x: pa.array([x.astype(np.int32).tobytes()], pa.binary())
                columns = [pa.array([uuid.uuid4().hex]), many(part.column("doc"), part.column("doc").type), pa.array([int(lengths.sum())], pa.int64()), raw(lengths), many(coded.dictionary, pa.string()), many(sizes, pa.int32()), raw(pairs % n), raw(tf)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "docs", "words", "dl", "terms", "sizes", "places", "tf"])

    words = docs.select(F.col(key).alias("doc"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
    return words.mapInArrow(run, f"block string, docs array<{words.schema['doc'].dataType.simpleString()}>, words long, dl binary, terms array<string>, sizes array<int>, places binary, tf binary")


def _question_blocks(sets: DataFrame) -> DataFrame:
    """Sets of words (words, joined by blanks) in blocks: the sets, the words of a block once, and their codes by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_QUERIES):
                words = b.slice(at, BLOCK_QUERIES).column("words")
                lists = pc.split_pattern(words, " ")
                coded = lists.flatten().dictionary_encode()
                many = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.string()))
                raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                columns = [pa.array([uuid.uuid4().hex]), many(words), raw(ends, np.int64), many(coded.dictionary), raw(coded.indices.to_numpy(zero_copy_only=False), np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=["asked", "sets", "ends", "vocabulary", "codes"])

    return sets.mapInArrow(run, "asked string, sets array<string>, ends binary, vocabulary array<string>, codes binary")


class _Best:
    """The k best texts so far of each set of words of a block."""

    def __init__(self, sets: pa.Array) -> None:
        self.sets, self.least = sets, np.zeros(len(sets))
        self.at, self.doc, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, at: np.ndarray, doc: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> None:
        at, doc, score = np.r_[self.at, at], np.r_[self.doc, doc], np.r_[self.score, score]
        by = np.lexsort((order[doc], -score, at))
        at, doc, score = at[by], doc[by], score[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.least[at[place == k - 1]] = score[place == k - 1]
        kept = place < k
        self.at, self.doc, self.score = at[kept], doc[kept], score[kept]


def _scorer(k: int, doc_type: pa.DataType):
    """Scores the sets of words of a block over the texts of a block; a task gives the k best of all its texts, a row a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, begins, best, block = [], {}, {}, None
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(c)[r]  # noqa: B023, E731
                read = lambda c, kind: np.frombuffer(get(c).as_buffer(), kind)  # noqa: B023, E731
                if get("block").as_py() != block:
                    block, dl = get("block").as_py(), read("dl", np.int32)
                    if block not in begins:
                        begins[block] = len(names)
                        names += get("docs").values.to_pylist()
                        order = np.empty(len(names), np.int64)
                        order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                    places, tf = read("places", np.int32), read("tf", np.int32)
                    ends = np.cumsum(get("sizes").values.to_numpy(zero_copy_only=False).astype(np.int64))
                    known = pd.Index(get("terms").values.to_numpy(zero_copy_only=False))
                    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[places] / get("avgdl").as_py()))
                if (mine := best.get(get("asked").as_py())) is None:
                    mine = best[get("asked").as_py()] = _Best(get("sets").values)
                vocabulary, idf = get("vocabulary").values.to_numpy(zero_copy_only=False), get("idf").values
                at, weight = known.get_indexer(pd.Index(vocabulary)), np.full(len(vocabulary), np.nan)
                weight[idf.field("code").to_numpy()] = idf.field("idf").to_numpy()
                runs = [(places[ends[t - 1] if t else 0 : ends[t]], part[ends[t - 1] if t else 0 : ends[t]] * w) if t >= 0 and w == w else None for t, w in zip(at.tolist(), weight.tolist())]
                codes, upto, n = read("codes", np.int32).tolist(), [0, *read("ends", np.int64).tolist()], len(dl)
                found = []
                for first in range(0, len(mine.sets), GROUP):
                    last = min(first + GROUP, len(mine.sets))
                    sums = np.zeros((last - first, n))
                    for q in range(first, last):
                        if hit := [runs[c] for c in codes[upto[q] : upto[q + 1]] if runs[c] is not None]:
                            sums[q - first] = np.bincount(np.concatenate([h[0] for h in hit]), np.concatenate([h[1] for h in hit]), n)
                    sums = np.floor(sums * 1e6 + 0.5) / 1e6
                    least = mine.least[first:last, None]
                    wanted = (sums >= least) & (sums > 0)
                    if k < n and np.count_nonzero(wanted) > 2 * k * len(sums):
                        wanted &= sums >= np.partition(sums, n - k, axis=1)[:, n - k, None]
                    x, y = np.nonzero(wanted)
                    found.append((x + first, y + begins[block], sums[x, y]))
                mine.add(*(np.concatenate(c) for c in zip(*found)), order, k)
        for mine in best.values():
            sets, sizes = np.unique(mine.at, return_counts=True)
            ends = np.r_[0, np.cumsum(sizes)]
            for at in range(0, len(sets), OUT_ROWS):
                upto = ends[at : at + OUT_ROWS + 1]
                rows = slice(upto[0], upto[-1])
                lists = pa.StructArray.from_arrays([pa.array(-mine.score[rows]), pa.array([names[i] for i in mine.doc[rows].tolist()], doc_type)], names=["m", "doc"])
                columns = [mine.sets.take(pa.array(sets[at : at + OUT_ROWS])), pa.ListArray.from_arrays(pa.array(upto - upto[0], pa.int32()), lists)]
                yield pa.RecordBatch.from_arrays(columns, names=["words", "best"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int, rare_share: float | None = None) -> DataFrame:
    """qid (long), doc, score, rank. With rare_share only terms in at most that share of the documents (at least one) count.

    Postings are written once, in blocks of texts. Questions of the same words have the same list, so each set of words is
    scored once. Blocks of sets meet the blocks of texts and are scored in place; a task keeps k texts a set, which is
    exact because the tasks' texts are disjoint. So neither the meetings of words nor the scores of pages that are not
    among the best are ever shuffled.
    """
    blocks = cut(_blocks(docs, key, text), "postings")
    stats = blocks.agg(F.sum(F.size("docs")).alias("n_docs"), F.sum("words").alias("words")).select("n_docs", (F.col("words") / F.col("n_docs")).alias("avgdl"))
    df = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df")).withColumnRenamed("terms", "term").join(F.broadcast(stats))  # one row
    if rare_share is not None:
        df = df.where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n_docs") * rare_share)))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = queries.groupBy(F.col("qid").cast("long").alias("qid")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("query")))))).alias("t"))
    words = cut(words.where(F.size("t") > 0).select("qid", F.array_join("t", " ").alias("words")), "words")
    width = shuffle_width(queries.sparkSession)
    made = cut(_question_blocks(words.select("words").distinct().repartition(width)), "sets")
    weights = made.select("asked", F.posexplode("vocabulary").alias("code", "term")).join(df.select("term", idf.alias("idf")), "term").groupBy("asked").agg(F.collect_list(F.struct("code", "idf")).alias("idf"))
    asked = made.join(weights, "asked").join(F.broadcast(stats.select("avgdl"))).repartition(width)
    pairs = blocks.hint("shuffle_replicate_nl").join(cut(asked, "asked"))
    doc = blocks.schema["docs"].dataType.elementType
    score = pairs.mapInArrow(_scorer(k, to_arrow_type(doc)), f"words string, best array<struct<m: double, doc: {doc.simpleString()}>>")
    best = score.groupBy("words").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    found = words.join(best, "words").select("qid", F.posexplode("best").alias("at", "b"))
    return found.select("qid", F.col("b.doc").alias("doc"), (-F.col("b.m")).alias("score"), (F.col("at") + 1).alias("rank"))
