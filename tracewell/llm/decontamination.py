"""Benchmark decontamination on a distributed positional inverted index.

`build` cuts the corpus into segments of a few megabytes and stores, per segment and
term, the posting list of token positions (ascending, counted through the segment, delta
coded), and per document its place in the segment. `search` takes the test items in blocks of
bounded size: only postings of their terms are read, segment by segment. For each
window of an item the rarest term by corpus count comes first; its positions, shifted by the term's
offset in the window, are intersected with those of the next rarest, and so on until
the list is empty or all terms are matched: exact phrases. `near` finds unordered proximity matches.

A segment bounds every piece of work, whatever a term's or a document's share of the corpus
(a single longer text is a segment of its own). Null texts and texts without words have no
postings, match nothing and are reported with zeros. Items without words have no window.
Rows with repeated or null doc_id are told apart; repeated item_ids count once; items without an id hit
words like others, and are left out of the ids and their number only.
Empty tables give empty results. Extra columns are ignored (`drop_contaminated` keeps them).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.text import LOWER_WORDS, fresh, slices, split_words, word_array, written

WINDOW = 13
SEGMENT_BYTES = 8 << 20
BLOCK_WORDS = 100_000  # words of test items that are searched at a time: their windows are broadcast

Window = tuple[bytes, ...]


def pack(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Ascending numbers, list by list (bounds), as 7-bit groups of their differences; each list on its own."""
    deltas = np.diff(numbers, prepend=0)
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    deltas[heads] = numbers[heads]
    deltas = deltas.astype(np.uint64)
    sizes = np.ones(len(deltas), np.int64)
    for k in range(1, 6):
        sizes += deltas >= np.uint64(1 << (7 * k))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        longer = sizes > k
        more = (sizes[longer] > k + 1).astype(np.uint8) << 7
        out[at[:-1][longer] + k] = ((deltas[longer] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(out)])


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts))


def build(docs: DataFrame) -> DataFrame:
    """The index: postings rows (segment, term, n, postings) and, with term null, document rows (segment, row, start, n, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", SEGMENT_BYTES)):
            segment = base + k
            data, offsets, bounds = split_words(batch.column("text"))
            coded = word_array(data, offsets).dictionary_encode()
            ids = coded.indices.to_numpy()
            order = np.argsort(ids, kind="stable")
            counts = np.bincount(ids, minlength=len(coded.dictionary))
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, segment)),
                    coded.dictionary.cast(pa.binary()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.int64()),
                    pa.array(counts.astype(np.int64)),
                    pack(order, np.concatenate([[0], np.cumsum(counts)])),
                    pa.nulls(n, batch.column("doc_id").type),
                ],
                names=names,
            )
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, segment)),
                    pa.nulls(n, pa.binary()),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(bounds[:-1].astype(np.int64)),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.nulls(n, pa.binary()),
                    batch.column("doc_id"),
                ],
                names=names,
            )

    names = ["segment", "term", "row", "start", "n", "postings", "doc_id"]
    schema = f"segment bigint, term binary, row int, start bigint, n bigint, postings binary, doc_id {dict(docs.dtypes)['doc_id']}"
    index = docs.select("doc_id", "text").mapInArrow(run, schema)
    # a file per kind: a search for terms never opens the document rows and the other way round
    return written(index.withColumn("of", F.when(F.col("term").isNull(), "documents").otherwise("terms")), "index", "of")


def words_of(text: str | None) -> Window:
    return tuple((text or "").encode().translate(LOWER_WORDS).split())


def item_blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, Window]]]:
    """(item_id as a string or null, words) of all items with words, in lists of at most about `limit` words."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of(r["text"])
        if words:
            block.append((r["item_id"], words))
            size += len(words)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def windows_of(words: Window, width: int = WINDOW) -> set[Window]:
    return {words[i : i + width] for i in range(max(1, len(words) - width + 1))}


def counts_of(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Corpus counts of the given terms."""
    wanted = index.sparkSession.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    rows = index.where("of = 'terms'").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["term"]): r["n"] for r in rows}


def by_segment(index: DataFrame, terms: list[bytes], schema: str, search) -> DataFrame:
    """Per segment that has any of the terms: search(lists by term, starts of its documents) gives columns, after segment."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    postings = index.where("of = 'terms'").join(wanted, "term", "left_semi").select("segment", "term", "postings", F.lit(None).cast("bigint").alias("start"))
    starts = index.where("of = 'documents'").select("segment", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("binary").alias("postings"), "start")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select(["term", "postings"]).to_pydict()
        lists = {t: unpack(p) for t, p in zip(rows["term"], rows["postings"]) if t is not None}
        begins = np.sort(table["start"].drop_null().to_numpy())
        columns = search(lists, begins)
        return pa.table({"segment": pa.array([key[0].as_py()] * len(next(iter(columns.values()))), pa.int64()), **columns})

    return postings.unionByName(starts).groupBy("segment").applyInArrow(run, f"segment bigint, {schema}")


def phrase_positions(window: Window, order: list[int], lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Where the phrase begins: lists in the given order of offsets, shifted and intersected."""
    found = None
    for k in order:
        if (own := lists.get(window[k])) is None:
            return np.empty(0, np.int64)
        shifted = own - k
        if found is None:
            found = shifted
        else:
            at = np.minimum(np.searchsorted(shifted, found), len(shifted) - 1)
            found = found[shifted[at] == found]
        if not len(found):
            break
    return found


def search(index: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Exact occurrences of item windows: segment, row, ranges [start, end) of hit words, item_ids; a row per block of items and document with hits."""
    hits = None
    for block in item_blocks(items):
        owners: dict[Window, list[str]] = defaultdict(list)
        for item_id, words in block:
            for w in windows_of(words, width):
                owners[w] += [item_id] if item_id is not None else []
        terms = list({t for w in owners for t in w})
        counts = counts_of(index, terms)
        found = by_segment(index, terms, "row int, ranges array<struct<a:bigint,b:bigint>>, items array<string>", _phrase_search(index.sparkSession, owners, counts))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return index.sparkSession.createDataFrame([], "segment bigint, row int, ranges array<struct<a:bigint,b:bigint>>, items array<string>")
    return hits


def _phrase_search(spark: SparkSession, owners: dict[Window, list[str]], counts: dict[bytes, int]):
    """Searches a segment for all windows whose terms all occur in the corpus, looked up by their rarest term."""
    by_rarest: dict[bytes, list[tuple[Window, list[int], list[str]]]] = defaultdict(list)
    for w, ids in owners.items():
        if all(t in counts for t in w):
            order = sorted(range(len(w)), key=lambda k: (counts[w[k]], w[k], k))
            by_rarest[w[order[0]]].append((w, order, ids))
    told = spark.sparkContext.broadcast(dict(by_rarest))

    def run(lists: dict[bytes, np.ndarray], begins: np.ndarray) -> dict[str, pa.Array]:
        ranges, items = defaultdict(set), defaultdict(set)
        for term in lists.keys() & told.value.keys():
            for w, order, ids in told.value[term]:
                at = phrase_positions(w, order, lists)
                if not len(at):
                    continue
                docs = np.searchsorted(begins, at, "right")
                # positions run through the segment: an occurrence must end in the document that it begins in
                for p, d in zip(at[np.searchsorted(begins, at + len(w) - 1, "right") == docs].tolist(), docs[np.searchsorted(begins, at + len(w) - 1, "right") == docs].tolist()):
                    ranges[d].add((p - int(begins[d - 1]), p - int(begins[d - 1]) + len(w)))
                    items[d].update(ids)
        starts = sorted(ranges)
        # a document's row is looked up by where it begins; those without words share the next one's place
        return {
            "row": pa.array(starts, pa.int32()),
            "ranges": pa.array([[{"a": a, "b": b} for a, b in _merged(ranges[d])] for d in starts], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
            "items": pa.array([sorted(items[d]) for d in starts], pa.list_(pa.string())),
        }

    return run


def _merged(ranges: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def near(index: DataFrame, phrases: DataFrame, slop: int = 3) -> DataFrame:
    """Proximity: segment, row, item_id, start, end of the shortest stretch per document of at most len(phrase) + slop
    words that holds all distinct terms of the item in any order (items: item_id, text)."""
    hits = None
    for block in item_blocks(phrases):
        terms = list({t for _, words in block for t in words})
        counts = counts_of(index, terms)
        queries = [(i, sorted(set(w), key=lambda t: (counts.get(t, 0), t)), len(w) + slop) for i, w in block if all(t in counts for t in w)]
        found = by_segment(index, terms, "row int, item_id string, start bigint, end bigint", _near_search(queries))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return index.sparkSession.createDataFrame([], "segment bigint, row int, item_id string, start bigint, end bigint")
    return hits


def _near_search(queries: list[tuple[str, list[bytes], int]]):
    def run(lists: dict[bytes, np.ndarray], begins: np.ndarray) -> dict[str, pa.Array]:
        best: dict[tuple[int, str], tuple[int, int, int]] = {}
        for item_id, terms, span in queries:
            if not all(t in lists for t in terms):
                continue
            # around each place of the rarest term, terms that all have a place within the span
            middle = lists[terms[0]]
            for t in terms[1:]:
                own = lists[t]
                left = np.searchsorted(own, middle - span + 1)
                middle = middle[(left < len(own)) & (own[np.minimum(left, len(own) - 1)] < middle + span)]
            for p in middle.tolist():
                d = int(np.searchsorted(begins, p, "right"))
                low, high = int(begins[d - 1]), int(begins[d]) if d < len(begins) else np.inf
                places = sorted((int(x), t) for t in terms for x in lists[t][np.searchsorted(lists[t], max(low, p - span + 1)) : np.searchsorted(lists[t], min(high, p + span))])
                last: dict[bytes, int] = {}
                for x, t in places:
                    last[t] = x
                    if len(last) == len(terms) and (size := x + 1 - min(last.values())) <= span:
                        start = min(last.values()) - low
                        best[d, item_id] = min(best.get((d, item_id), (span + 1, 0, 0)), (size, start, start + size))
        keys = sorted(best, key=lambda k: (k[0], k[1] is not None, k[1] or ""))
        return {
            "row": pa.array([d for d, _ in keys], pa.int32()),
            "item_id": pa.array([i for _, i in keys], pa.string()),
            "start": pa.array([best[k][1] for k in keys], pa.int64()),
            "end": pa.array([best[k][2] for k in keys], pa.int64()),
        }

    return run


def located(index: DataFrame, hits: DataFrame) -> DataFrame:
    """Document rows of the index beside their hits (null without); `row` of hits is the rank of the document's start in its segment."""
    documents = index.where("of = 'documents'").select("segment", "row", F.col("n").alias("n_words"), "doc_id")
    return documents.join(hits.withColumn("row", F.col("row") - 1), ["segment", "row"], "left")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, percent: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted), contaminated (hit words reach the percentage)."""
    index = build(docs)
    found = search(index, items, width)
    merged = found.groupBy("segment", "row").agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "ranges",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")),
    )["n"]
    out = located(index, merged.select("segment", "row", covered.alias("n_hit"), "items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        items_found.alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, percent: int = 5) -> DataFrame:
    """The rows of `docs` that are not contaminated. Equal texts are judged alike, so a text's digest finds them again."""
    key, bad = fresh(docs, "decontamination_key", "decontamination_bad")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), items, width, percent)
    rejected = written(found.where("contaminated").select(F.col("doc_id").alias(bad)).distinct(), "contaminated")
    return keyed.join(rejected, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS i)
  WHERE len(w) > 0),
hits AS (
  SELECT DISTINCT doc_id, i, q.n, item_id
  FROM (SELECT doc_id, w, n.n, unnest(generate_series(1, len(w) - n.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM q) n) p
  JOIN q ON q.n = p.n AND q.phrase = array_to_string(p.w[i:i + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
          FROM (SELECT doc_id, i, unnest(generate_series(0, n - 1)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
