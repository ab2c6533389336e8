"""Ranked lexical search: Block-Max MaxScore over an inverted index in shards.

`build` counts documents and terms once, then cuts the corpus into shards of a few megabytes and stores each
term's posting list in blocks of BLOCK postings: documents (ascending rows of the shard, delta coded), term
frequencies, and outside the packed part the block's last row and its highest impact (what a posting adds per unit of
the term's weight).

`search` reads the blocks of the items' terms only. In a shard the lists of an item are ordered by their
bounds (weight times highest impact of the list). The rows are walked in windows; lists whose bounds together
stay below the score of the k-th best row so far are non-essential. Rows of the essential lists are candidates; for each
non-essential list, from the highest bound down, a candidate goes when its score, the bounds of the
lists still to come and the maximum of the one block that can hold it stay below the k-th best score, and only blocks
with candidates left are unpacked. The shards' heaps are merged by rank. Bounds never
underestimate and equal scores are never cut, so results are those of scoring everything.

Scores are integers: a term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), its impact
(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L; N documents with terms, L terms in all, n terms of the document.

Null texts and texts without terms are in no list. Each row of the items is an item of its own; without terms it finds
nothing. Repeated documents are ranked each; equal scores go by doc_id, rows without id first. Empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracewell.llm.decontamination import pack
from tracewell.llm.text import LOWER_WORDS, slices, split_words, word_array, written

SHARD_BYTES = 8 << 20
BLOCK = 128
FIRST_ROWS, MOST_ROWS = 256, 4096  # of a window: small at first, while no bound holds
ITEM_BYTES = 4 << 20  # texts of the items that are searched at a time
K = 20


@dataclass
class Index:
    """Rows of blocks and documents (see `build`), documents with terms, terms in all."""

    rows: DataFrame
    n: int
    terms: int


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with n terms."""
    return 75 + (25 * n.astype(np.int64) * documents) // max(terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and terms in all."""
    inside = bytes(c != 32 for c in LOWER_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in slices(batches, "text"):
            whole = pa.concat_arrays([pc.fill_null(batch.column("text"), "").cast(pa.large_binary())])
            at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
            held = np.frombuffer((whole.buffers()[2] or pa.py_buffer(b"")).slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(inside), np.uint8)
            starts = held.copy()
            starts[1:] &= 1 - held[:-1]
            begins = at[:-1][at[:-1] < at[1:]] - at[0]
            starts[begins] = held[begins]
            counts = np.add.reduceat(starts, begins, dtype=np.int64) if len(begins) else np.empty(0, np.int64)
            documents, terms = documents + int((counts > 0).sum()), terms + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])

    row = docs.select("text").mapInArrow(run, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame) -> Index:
    """The index, written: rows (shard, term, n, last, top, rows, tfs), one per block, and with term null
    (shard, row, n, doc_id), one per document with terms."""
    documents, terms = sizes(docs)
    names = ["shard", "term", "n", "last", "top", "rows", "tfs", "row", "doc_id"]
    schema = "shard bigint, term binary, n bigint, last int, top bigint, rows binary, tfs binary, row int, doc_id bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", SHARD_BYTES)):
            shard = base + k
            data, offsets, bounds = split_words(batch.column("text"))
            n = np.diff(bounds)
            m = norms(n, documents, terms)
            coded = word_array(data, offsets).dictionary_encode()
            width = max(len(n), 1)
            key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * width + np.repeat(np.arange(len(n)), n), return_counts=True)
            term, row = key // width, key % width
            first = np.searchsorted(term, term)  # where the list begins
            starts = np.flatnonzero((np.arange(len(term)) - first) % BLOCK == 0)
            ends = np.append(starts[1:], len(term)).astype(np.int64)
            ascending = np.cumsum(tf)
            ascending -= np.repeat((ascending - tf)[starts], ends - starts)
            cuts = np.append(starts, len(term))
            count = len(starts)
            if count:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, shard)),
                        coded.dictionary.cast(pa.binary()).take(pa.array(term[starts])),
                        pa.array(ends - starts),
                        pa.array(row[ends - 1].astype(np.int32)),
                        pa.array(np.maximum.reduceat(impacts(tf, m[row]), starts)),
                        pack(row, cuts),
                        pack(ascending, cuts),
                        pa.nulls(count, pa.int32()),
                        pa.nulls(count, pa.int64()),
                    ],
                    names=names,
                )
            some = np.flatnonzero(n > 0)
            count = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(count, shard)),
                    pa.nulls(count, pa.binary()),
                    pa.array(n[some].astype(np.int64)),
                    pa.nulls(count, pa.int32()),
                    pa.nulls(count, pa.int64()),
                    pa.nulls(count, pa.binary()),
                    pa.nulls(count, pa.binary()),
                    pa.array(some.astype(np.int32)),
                    batch.column("doc_id").take(pa.array(some)),
                ],
                names=names,
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
    return Index(written(rows, "ranking"), documents, terms)


def unpack(blocks: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The numbers of some packed blocks on end; counts has how many each holds."""
    raw = np.frombuffer(b"".join(blocks), np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends + 1 - starts)
    total = np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts))
    heads = np.cumsum(counts) - counts
    return total - np.repeat(np.concatenate([[0], total])[heads], counts)


@dataclass
class List:
    """A term's list in a shard; blocks are unpacked when first needed."""

    n: np.ndarray
    last: np.ndarray
    top: np.ndarray
    rows: list[bytes]
    tfs: list[bytes]
    found: list[tuple[np.ndarray, np.ndarray] | None] = field(init=False)

    def __post_init__(self) -> None:
        self.found = [None] * len(self.n)
        self.bound = int(self.top.max())

    def open(self, blocks: list[int], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and impacts of the given blocks, on end."""
        if new := [b for b in blocks if self.found[b] is None]:
            counts = self.n[new]
            rows, tf = unpack([self.rows[b] for b in new], counts), unpack([self.tfs[b] for b in new], counts)
            heads = np.cumsum(counts) - counts
            before = np.concatenate([[0], tf[:-1]])
            before[heads] = 0
            gained = impacts(tf - before, m[rows])
            for b, start, n in zip(new, heads.tolist(), counts.tolist()):
                self.found[b] = rows[start : start + n], gained[start : start + n]
        if len(blocks) == 1:
            return self.found[blocks[0]]
        return tuple(np.concatenate([self.found[b][i] for b in blocks]) for i in (0, 1))


class Shard:
    """Lists of a shard by term, and its documents by row (0 stands where a row has no terms)."""

    def __init__(self, lists: dict[bytes, List], m: np.ndarray, ids: np.ndarray):
        self.lists, self.m, self.ids = lists, m, ids

    def best(self, item: dict[bytes, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best documents for an item (weights by term), best first."""
        own = sorted(((w * self.lists[t].bound, w, t) for t, w in item.items() if w and t in self.lists))
        lists = [(w, self.lists[t]) for _, w, t in own]
        upto = np.cumsum([0, *(b for b, _, _ in own)])  # upto[i]: what the first i lists can give together
        rows, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1
        low, step, n = 0, FIRST_ROWS, len(self.m)
        while low < n and lists:
            high = min(n, low + step)
            essential = int(np.searchsorted(upto, least, "left")) - 1  # the first `essential` lists stay below `least` together
            score = np.zeros(high - low, np.int64)
            for w, x in lists[essential:]:
                a, b = np.searchsorted(x.last, low), np.searchsorted(x.last, high - 1)
                if a < len(x.last):
                    at, gain = x.open(list(range(a, min(b, len(x.last) - 1) + 1)), self.m)
                    i, j = np.searchsorted(at, [low, high])
                    score[at[i:j] - low] += w * gain[i:j]
            found = np.flatnonzero(score)
            score, found = score[found], found + low
            for i in range(essential - 1, -1, -1):
                w, x = lists[i]
                fits = score + upto[i + 1] >= least
                score, found = score[fits], found[fits]
                block = np.searchsorted(x.last, found)
                top = np.append(x.top, 0)[block]
                fits = score + upto[i] + w * top >= least
                score, found, block = score[fits], found[fits], block[fits]
                if not len(found):
                    break
                if wanted := np.unique(block[block < len(x.last)]).tolist():
                    at, gain = x.open(wanted, self.m)
                    place = np.minimum(np.searchsorted(at, found), len(at) - 1)
                    score = score + np.where(at[place] == found, w * gain[place], 0)
            fits = score >= least
            rows, scores = np.concatenate([rows, found[fits]]), np.concatenate([scores, score[fits]])
            order = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
            least = max(1, int(scores[-1])) if len(scores) == k else 1
            low, step = high, min(2 * step, MOST_ROWS)
        return rows, scores


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, Counter]]]:
    """(item_id, terms with their repeats) of all items with terms, in lists of about `limit` bytes of text at most."""
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        terms = Counter((r["text"] or "").encode().translate(LOWER_WORDS).split())
        if terms:
            block.append((r["item_id"], terms))
            size += len(r["text"].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: Index, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank, doc_id, score."""
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType
    found = None
    for block in _item_blocks(items, item_bytes):
        hits = _search_block(index, block, kind, k)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), *(T.StructField(n, t) for n, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())))]))
    return found


def _search_block(index: Index, block: list[tuple[object, Counter]], kind: T.DataType, k: int) -> DataFrame:
    rows, spark = index.rows, index.rows.sparkSession
    terms = spark.createDataFrame([(bytearray(t),) for t in {t for _, own in block for t in own}], "term binary")
    # the terms of at most `item_bytes` of text, so of bounded size
    postings = rows.where("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi")
    counts = {bytes(r["term"]): r["df"] for r in postings.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weights = {t: weight(index.n, df) for t, df in counts.items()}
    told = spark.sparkContext.broadcast([{t: c * weights[t] for t, c in own.items() if t in weights} for _, own in block])
    documents, total = index.n, index.terms

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        held = table.filter(pc.is_null(table["term"])).sort_by("row")
        size = (held["row"].to_numpy()[-1] + 1) if held.num_rows else 0
        ids, m = np.full(size, np.iinfo(np.int64).min), np.zeros(size, np.int64)
        at = held["row"].to_numpy()
        ids[at] = pc.fill_null(held["doc_id"], np.iinfo(np.int64).min).to_numpy()
        m[at] = norms(held["n"].to_numpy(), documents, total)
        blocks = table.filter(pc.is_valid(table["term"])).sort_by([("term", "ascending"), ("last", "ascending")]).combine_chunks()
        names = blocks["term"].to_pylist()
        n, last, top = (blocks[c].to_numpy() for c in ("n", "last", "top"))
        packed, tfs = blocks["rows"].to_pylist(), blocks["tfs"].to_pylist()
        cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
        shard = Shard({names[i]: List(n[i:j], last[i:j], top[i:j], packed[i:j], tfs[i:j]) for i, j in zip(cuts, cuts[1:])}, m, ids)
        best = [shard.best(item, k) for item in told.value]
        own = np.concatenate([b[0] for b in best])
        return pa.table(
            {
                "item": pa.array(np.repeat(np.arange(len(best)), [len(b[0]) for b in best])),
                "doc_id": pc.if_else(pa.array(ids[own] == np.iinfo(np.int64).min), pa.scalar(None, pa.int64()), pa.array(ids[own])),
                "score": np.concatenate([b[1] for b in best]),
            }
        )

    # the work of a shard lies in its items, not its bytes, so partitions are not merged by bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heaps = postings.unionByName(rows.where("term IS NULL")).repartition(tasks, "shard").groupBy("shard").applyInArrow(run, "item bigint, doc_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    top = heaps.withColumn("rank", place).where(F.col("rank") <= k)
    own = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    return top.join(own, "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(build(docs), items)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w)) AS n_terms FROM d),
q AS (
  SELECT i, any_value(item_id) AS item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY i, term),
tf AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q)
  GROUP BY r, term),
u AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, s GROUP BY term, n_docs),
p AS (SELECT r, doc_id, term, CAST((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)) AS BIGINT) AS impact FROM tf, s),
x AS (SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score
      FROM q JOIN u USING (term) JOIN p USING (term) GROUP BY i, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
      FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
