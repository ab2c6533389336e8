"""N-gram Jaccard self-join by MinHash banding, with exact verification.

1. Equal texts form a class (md5 of the text); one text stands for its class.
2. Each text's set of five-word shingles (words of `text.LOWER_WORDS`; a text of fewer
   words is one shingle) gets a MinHash signature, cut into bands. `bands_for` chooses
   rows per band and bands such that a pair at the threshold is found with at least
   the target recall (0.9999); more similar pairs are found still more surely.
3. Signatures shuffle on band hashes. Buckets with the same members in several bands are
   visited once. Buckets are cut into blocks of bounded size, so no bucket meets in one task.
4. A bucket of one block verifies every pair on full sets of shingles. A larger bucket sends
   each text once, to its block, where it meets the bucket's guide (the shortest text) and
   becomes its difference to the guide's set: few shingles in a family of near copies. Only
   these differences travel to pairs of blocks, a piece of work each; |A xor B| of two texts is
   |a xor b| of their differences, so sets are still compared in full.
   All pairs of a piece are intersected at once as a matrix product. A pair counts in its
   first common band only. Per text comes out its number of links and one neighbour: no row per pair.
5. Connected components over links give groups.

Null text counts as empty. Texts without words have no shingles and no links, though equal
ones are a class. doc_id may repeat or be null: rows are what counts. An empty table gives
an empty result. Extra columns are kept by `drop_near_duplicates` and ignored by `near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.components import components
from tracewell.llm.text import fresh, mix, slices, split_words, word_hashes, written

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 192
BLOCK_TEXTS = 512
BLOCK_BYTES = 4 << 20
COLUMNS_AT_ONCE = 2048
DELTA_BLOCKS = 4  # blocks of texts whose differences make one block of differences


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, thus the fewest false candidates, that reach the recall within `most` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall within this many hashes")
    return best


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-word shingles, text by text with repeats, and where each text's begin and end."""
    data, offsets, bounds = split_words(texts)
    words = word_hashes(data, offsets)
    counts = np.diff(bounds)
    full = np.maximum(counts - n + 1, 0)
    out_counts = np.where(counts == 0, 0, np.maximum(full, 1))
    at = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.empty(at[-1], np.uint64)
    if len(words) >= n:
        rolled = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            rolled = mix(rolled + words[k : k + len(rolled)] + np.uint64(k + 1))
        source = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(full)])[:-1], full) + np.arange(full.sum())
        out[np.repeat(counts >= n, out_counts)] = rolled[source]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        short = np.array([counts[i]], np.uint64)
        for k in range(bounds[i], bounds[i + 1]):
            short = mix(short + words[k : k + 1])
        out[at[i]] = short[0]
    return out, at


def band_hashes(values: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of 64 bits; texts must have a shingle each. Permutations are odd multiples mod 2^32 plus offsets."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    multiples = (seeds[: bands * rows] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (seeds[bands * rows :] >> np.uint64(32)).astype(np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, bands), np.uint64)
    for band in range(bands):
        h = np.full(len(at) - 1, band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            h = mix(h + np.minimum.reduceat(x * multiples[k] + shifts[k], at[:-1]) + np.uint64(0x9E3779B97F4A7C15))
        out[:, band] = h
    return out


def _guarded(values: np.ndarray, at: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the texts that have shingles, and their band hashes."""
    some = np.flatnonzero(np.diff(at))
    return some, band_hashes(values, np.append(at[:-1][some], at[-1]), bands, rows) if len(some) else np.empty((0, bands), np.uint64)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key (class), size in bytes, band hashes (empty for texts without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            some, hashes = _guarded(*shingles(batch.column("text")), bands, rows)
            ends = np.zeros(batch.num_rows + 1, np.int32)
            ends[some + 1] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(hashes.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("size"), lists], names=["doc_id", "key", "size", "bands"])

    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), F.octet_length(text).cast("bigint").alias("size"), "text")
    return narrow.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary, size bigint, bands array<bigint>")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, bucket, band, blocks, guides): each member of a bucket once; the shortest of a bucket of several blocks guides them."""
    entries = classes.select("key", "size", F.posexplode("bands").alias("band", "bucket"))
    kept = (
        entries.groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.sum("size").alias("bytes"),
            F.min("band").alias("band"),
            F.min(F.struct("size", "key")).alias("least"),
            F.bit_xor(F.xxhash64("key")).alias("same_xor"),
            F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("same_xor2"),
        )
        .where("n > 1")
    )
    # the same members in several bands: only the first band's bucket is visited
    kept = (
        kept.groupBy("n", "bytes", "same_xor", "same_xor2")
        .agg(F.min(F.struct("band", "bucket", "least")).alias("first"))
        .select(
            F.col("first.bucket").alias("bucket"),
            F.col("first.band").alias("band"),
            F.col("first.least.key").alias("least"),
            F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"),
        )
    )
    members = entries.select("key", "bucket").join(kept, "bucket")
    return members.select("key", "bucket", "band", "blocks", ((F.col("key") == F.col("least")) & (F.col("blocks") > 1)).alias("guides"))


def placed(members: DataFrame) -> DataFrame:
    """Each member in its block, and the guide of a bucket of several blocks once more in each (`guide`). The other columns stay."""
    block = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")
    own = F.array(F.struct(block.alias("block"), F.lit(False).alias("guide")))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.lit(True).alias("guide")))
    places = F.explode(F.when(F.col("guides"), F.concat(own, everywhere)).otherwise(own)).alias("place")
    kept = [c for c in members.columns if c != "guides"]
    return members.select(*kept, places).select(*kept, "place.block", "place.guide")


def linked_pairs(values: np.ndarray, at: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """All i < j with Jaccard of their sets of values at least the threshold."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    sizes = np.bincount(owner, minlength=n)
    change = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
    runs = np.diff(np.append(change, len(values)))
    shared = np.repeat(runs > 1, runs)
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)[shared]
    owner = owner[shared]
    common = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
        x = np.zeros((n, min(COLUMNS_AT_ONCE, width - start)), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        common += x @ x.T
    total = sizes[:, None] + sizes[None, :]
    p, q = threshold.numerator, threshold.denominator
    linked = (common.astype(np.int64) * (p + q) >= p * total) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    return np.nonzero(np.triu(linked, 1))


def _least_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The index of the first of each one's group over links (i, j)."""
    root = np.arange(n)
    while len(i):  # least label over links, until nothing changes
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return root


def _whole_bucket(values: np.ndarray, at: np.ndarray, band: int, bands: int, rows: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket in one block: per text its links that count here, and the index of its group's first text."""
    i, j = linked_pairs(values, at, threshold)
    if len(i):
        hashes = np.zeros((len(at) - 1, bands), np.uint64)
        some, found = _guarded(values, at, bands, rows)
        hashes[some] = found
        for earlier in range(band):
            fits = hashes[i, earlier] != hashes[j, earlier]
            i, j = i[fits], j[fits]
    links = np.bincount(i, minlength=len(at) - 1) + np.bincount(j, minlength=len(at) - 1)
    return links, _least_labels(i, j, len(at) - 1)


def _sets(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]


def _on_end(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


MET = "key binary, n_links bigint, root binary, bucket bigint, band int, blocks int, block int, size bigint, delta array<bigint>, earlier array<bigint>"


def met(members: DataFrame, bands: int, rows: int, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Of `members` (as of `placed`, with text), one block after the other: (key, n_links, root) where the bucket is this block, one row per text with
    a link; else each member's number of shingles, its difference to the guide and its hashes of the bands before the bucket's."""
    exact = Fraction(threshold).limit_denominator(10_000)
    schema = pa.schema([("key", pa.binary()), ("n_links", pa.int64()), ("root", pa.binary()), *((c, pa.int64()) for c in ("bucket",)), *((c, pa.int32()) for c in ("band", "blocks", "block")), ("size", pa.int64()), ("delta", pa.list_(pa.int64())), ("earlier", pa.list_(pa.int64()))])

    def made(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    def solve(piece: pa.Table) -> pa.RecordBatch | None:
        if piece.num_rows < 2:
            return None
        bucket, band, blocks, block = (piece[c][0].as_py() for c in ("bucket", "band", "blocks", "block"))
        keys = pa.concat_arrays(piece["key"].chunks)
        values, at = shingles(pa.concat_arrays(piece["text"].chunks), n)
        if blocks == 1:
            links, root = _whole_bucket(values, at, band, bands, rows, exact)
            some = np.flatnonzero(links)
            return made(len(some), key=keys.take(pa.array(some)), n_links=links[some], root=keys.take(pa.array(root[some]))) if len(some) else None
        guide, *others = _sets(values, at)  # the guide comes first
        count = len(others)
        hashes = band_hashes(values[at[1] :], at[1:] - at[1], bands, rows)[:, :band]  # members of a bucket have shingles
        return made(
            count, key=keys[1:], bucket=np.full(count, bucket), band=np.full(count, band), blocks=np.full(count, blocks), block=np.full(count, block),
            size=np.array([len(o) for o in others], np.int64), delta=_on_end([np.setxor1d(guide, o, assume_unique=True) for o in others]), earlier=_on_end(list(hashes)),
        )

    dealt = members.select("bucket", "block", "guide", "band", "blocks", "key", "text").repartition("bucket", "block")
    return dealt.sortWithinPartitions("bucket", "block", F.desc("guide")).mapInArrow(_by_runs(["bucket", "block"], solve), MET)


def _by_runs(names: list[str], solve: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted rows, what `solve` makes of each run of equal values of `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(c).to_numpy() for c in names]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                own = tuple(x[a] for x in ids)
                if rest and own != last:
                    if (out := solve(pa.Table.from_batches(rest).combine_chunks())) is not None:
                        yield out
                    rest = []
                last = own
                rest.append(batch.slice(a, b - a))
        if rest and (out := solve(pa.Table.from_batches(rest).combine_chunks())) is not None:
            yield out

    return run


@dataclass
class Block:
    """Texts of one block of differences to one guide."""

    keys: pa.Array
    sizes: np.ndarray
    values: np.ndarray
    at: np.ndarray
    earlier: np.ndarray

    @classmethod
    def of(cls, piece: pa.Table, rows: np.ndarray) -> Block:
        part = piece.take(pa.array(rows)).combine_chunks()
        delta, earlier = (pa.concat_arrays(part[c].chunks) for c in ("delta", "earlier"))
        at = np.concatenate([[0], np.cumsum(delta.value_lengths().to_numpy().astype(np.int64))])
        hashes = earlier.flatten().to_numpy().reshape(len(rows), -1) if len(earlier.flatten()) else np.empty((len(rows), 0), np.int64)
        return cls(pa.concat_arrays(part["key"].chunks), part["size"].to_numpy(), delta.flatten().to_numpy(), at, hashes)


def linked_blocks(left: Block, right: Block, threshold: Fraction) -> np.ndarray:
    """Which text of `left` is linked with which of `right` by full sets, where no earlier band has found them."""
    shared = np.intersect1d(left.values, right.values)
    sides = []
    for side in (left, right):
        column = np.minimum(np.searchsorted(shared, side.values), max(len(shared) - 1, 0))
        hit = shared[column] == side.values if len(shared) else np.zeros(len(column), bool)
        owner = np.repeat(np.arange(len(side.sizes)), np.diff(side.at))[hit]
        column = column[hit]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], owner[order], len(side.sizes)))
    common = np.zeros((len(left.sizes), len(right.sizes)), np.float32)
    for start in range(0, len(shared), COLUMNS_AT_ONCE):
        x = []
        for column, owner, count in sides:
            a, b = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
            one = np.zeros((count, min(COLUMNS_AT_ONCE, len(shared) - start)), np.float32)
            one[owner[a:b], column[a:b] - start] = 1
            x.append(one)
        common += x[0] @ x[1].T
    p, q = threshold.numerator, threshold.denominator
    lengths = np.diff(right.at)
    linked = np.empty(common.shape, bool)
    for k, (size, length) in enumerate(zip(left.sizes, np.diff(left.at))):  # a row at a time, so that 64-bit numbers stay few
        both = size + right.sizes
        apart = length + lengths - 2 * common[k].astype(np.int64)
        linked[k] = (both - apart) * (p + q) >= 2 * p * both
        for e in range(left.earlier.shape[1]):
            linked[k] &= left.earlier[k, e] != right.earlier[:, e]
    return linked


def verified(deltas: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, root) of buckets of several blocks from what `met` has made of them, one row per text and piece with a link."""
    exact = Fraction(threshold).limit_denominator(10_000)

    def solve(piece: pa.Table) -> pa.RecordBatch | None:
        low, high, block = piece["low"][0].as_py(), piece["high"][0].as_py(), piece["block"].to_numpy()
        left = Block.of(piece, np.flatnonzero(block == low))
        right = left if low == high else Block.of(piece, np.flatnonzero(block == high))
        if not len(left.sizes) or not len(right.sizes):
            return None
        linked = linked_blocks(left, right, exact)
        if low == high:
            np.fill_diagonal(linked, False)
            keys, links = left.keys, linked.sum(1)
            i, j = np.nonzero(np.triu(linked))
        else:
            keys, links = pa.concat_arrays([left.keys, right.keys]), np.concatenate([linked.sum(1), linked.sum(0)])
            i, j = np.nonzero(linked)
            j = j + len(left.sizes)
        root, some = _least_labels(i, j, len(links)), np.flatnonzero(links)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.array(links[some].astype(np.int64)), keys.take(pa.array(root[some]))], names=["key", "n_links", "root"])

    coarse = F.floor(F.col("block") / DELTA_BLOCKS).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / DELTA_BLOCKS).cast("int")))
    dealt = deltas.withColumn("block", coarse).withColumn("other", other)
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "size", "delta", "earlier")
    names = ["bucket", "low", "high"]
    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(_by_runs(names, solve), "key binary, n_links bigint, root binary")


def classes_and_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) of all documents, and per class: key, class_id, n_copies, n_links, group (the least key of the component)."""
    bands, rows = bands_for(threshold, recall)
    sig = written(signed(docs, bands, rows), "jaccard-signatures")
    classes = written(
        sig.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands")),
        "jaccard-classes",
    )
    members = written(buckets(classes), "jaccard-members")
    wanted = members.select("key").distinct().join(classes.select("key", "class_id"), "key")
    text = docs.select(F.col("doc_id").alias("class_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    # one text per class: the row of its least doc_id, once if that row repeats
    same = text["key"].eqNullSafe(wanted["key"]) & text["class_id"].eqNullSafe(wanted["class_id"])
    chosen = text.join(wanted, same, "left_semi")
    if not sig.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        first = Window.partitionBy("key").orderBy("class_id")
        chosen = chosen.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    pieces = written(met(placed(members.join(chosen.select("key", "text"), "key")), bands, rows, n, threshold), "jaccard-pieces")
    small = pieces.where("delta IS NULL").select("key", "n_links", "root")
    links = written(small.unionByName(verified(pieces.where("delta IS NOT NULL"), threshold)), "jaccard-links")
    groups = components(links.where("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    out = (
        classes.select("key", "class_id", "n_copies")
        .join(counted, "key", "left")
        .join(groups.select(F.col("node").alias("key"), F.col("root").alias("group")), "key", "left")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("bigint")))
        .withColumn("group", F.coalesce("group", "key"))
    )
    return sig.select("doc_id", "key"), written(out, "jaccard-result")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id; class_id, the least doc_id of equal texts; n_copies of it; n_links, how many
    other different texts are at least this similar; group_id, the least doc_id in its connected component."""
    narrow, classes = classes_and_links(docs, n, threshold, recall)
    groups = classes.groupBy("group").agg(F.min("class_id").alias("group_id"))
    return narrow.join(classes.join(groups, "group"), "key").select("doc_id", "class_id", "n_copies", "n_links", "group_id")


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each group: the one with the least doc_id (the least text digest where ids tie)."""
    _, classes = classes_and_links(docs, n, threshold, recall)
    best = classes.groupBy("group").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", "key")).alias("best"))
    best = best.select(F.col("best.class_id").alias("best_id"), F.col("best.key").alias("best_key"))
    key, nth = fresh(docs, "jaccard_key", "jaccard_nth")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = keyed.join(best, keyed["doc_id"].eqNullSafe(best["best_id"]) & keyed[key].eqNullSafe(best["best_key"]), "left_semi")
    # rows that share id and text are told apart by all their columns; what still ties is alike
    others = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes if c != "text"]
    once = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*others))
    return kept.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*docs.columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
