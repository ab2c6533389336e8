"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut a blank and the text into tokens of bytes. Where tokens of both end, their sequences
are cut into groups; tokens of a group are linked.

A fragment covers a byte range: its tokens of both sides (those that end in the range) and, between the
common ends in the range, how many tokens of each side stand. The first count is the open prefix, the
last the open suffix, those between are closed groups; without a common end there is one open count.
Two neighbours compose by running their tokens on and adding the left one's suffix to the right one's prefix
(`compose`); that is associative, with an empty range as identity.

`align` takes texts of up to CHUNK_BYTES as one fragment each, many at a time. Longer texts fall into parts at
places that no token of either side crosses, the parts are tokenised by different tasks and cut into byte
ranges, and the fragments are composed level by level, FAN neighbours per group.

`links` counts for pairs of token ids in how many documents they are linked, from an index of segments: per
segment and pair the rows that hold the pair and how often. Links are counted, not held, where a group is large.

Null and empty texts have no tokens, nor have texts that a side does not give back byte for byte (B reads U+2581 as
a blank). Repeated rows count as documents of their own; empty tables give empty results; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.text import slices, written

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

CHUNK_BYTES = 64 << 10  # a fragment's byte range
PART_CHARS = 1 << 18  # texts are tokenised in parts of about this size
FAN = 16  # fragments composed at a time
SEGMENT_TOKENS = 1 << 20  # tokens of one side in a segment of links
GROUP_LINKS = 1 << 12  # groups of more links are counted by distinct ids

# Fixed value: the pattern by which byte-level BPE vocabularies of this kind cut a text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank between ASCII letters: words of the byte BPE end here, and no piece has a blank inside.
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """What tasks need of both tokenizer files; its size is that of the files."""

    ranks: dict[bytes, int]
    model: bytes


def load(byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Vocabularies:
    """Read both files on the driver. Side A is byte-level BPE whose ids follow its merges, side B a SentencePiece model."""
    with open(byte_bpe, encoding="utf-8") as f:
        told = json.load(f)
    alphabet = _byte_alphabet()
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    ids = [told["model"]["vocab"][a + b] for a, b in merges]
    plain = told.get("normalizer") is None and told["pre_tokenizer"]["type"] == "ByteLevel" and not told["pre_tokenizer"]["add_prefix_space"]
    if not plain or ids != sorted(ids):
        raise ValueError(f"{byte_bpe}: only plain byte-level BPE with ids in the order of merges is supported")
    with open(piece_bpe, "rb") as f:
        return Vocabularies(ranks, f.read())


class Tokenizers:
    """Both sides in a Python worker. A unit is a text with a blank before it, or a part that begins with its blank."""

    def __init__(self, vocabularies: Vocabularies):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=vocabularies.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.model)
        self.a_bytes = [b""] * (max(vocabularies.ranks.values()) + 1)
        for token, i in vocabularies.ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            plain = not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode() if plain else b"")
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def tokens(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids of both sides per unit, and whether both give the unit's bytes back."""
        a = list(map(self.a.encode_ordinary, units))
        b = self.b.encode([u[1:] for u in units], num_threads=1) if units else []
        good = []
        for u, x, y in zip(units, a, b):
            raw = u.encode()
            good.append(b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw)
        return [np.array(x, np.int32) for x in a], [np.array(y, np.int32) for y in b], good


_made: dict[int, Tokenizers] = {}


def _tokenizers(vocabularies: Broadcast) -> Tokenizers:
    """One per Python worker."""
    key = id(vocabularies.value)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizers(vocabularies.value)
    return _made[key]


def counts_between(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side stand before, between and after the common ends (ascending, each side)."""
    at = np.minimum(np.searchsorted(b_ends, a_ends), max(len(b_ends) - 1, 0))
    common = a_ends[b_ends[at] == a_ends] if len(b_ends) else a_ends[:0]
    return tuple(np.diff(np.searchsorted(ends, common, "right"), prepend=0, append=len(ends)) for ends in (a_ends, b_ends))


@dataclass
class Fragment:
    a: np.ndarray
    b: np.ndarray
    na: np.ndarray
    nb: np.ndarray
    good: bool = True


EMPTY = Fragment(*(np.zeros(n, np.int32) for n in (0, 0, 1, 1)))


def compose(parts: list[Fragment]) -> Fragment:
    """Neighbours from left to right as one fragment; of none, the identity."""
    parts = parts or [EMPTY]

    def counts(lists: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(lists)
        heads = np.cumsum([len(x) for x in lists])[:-1]  # each part's open prefix joins the open count before it
        for at in heads[::-1].tolist():
            out[at - 1] += out[at]
        return np.delete(out, heads)

    return Fragment(
        *(np.concatenate(x) for x in ([p.a for p in parts], [p.b for p in parts])),
        counts([p.na for p in parts]),
        counts([p.nb for p in parts]),
        all(p.good for p in parts),
    )


def fragments(tokenizers: Tokenizers, unit: str, start: int, width: int = CHUNK_BYTES) -> Iterator[tuple[int, Fragment]]:
    """(number of the byte range, fragment) of a part that begins at byte `start` of its unit's text."""
    (a,), (b,), (good,) = tokenizers.tokens([unit])
    if not good:
        yield start // width, Fragment(EMPTY.a, EMPTY.b, EMPTY.na, EMPTY.nb, False)
        return
    a_ends, b_ends = (start + np.cumsum(t[x]) for t, x in ((tokenizers.a_lengths, a), (tokenizers.b_lengths, b)))
    for k in range(start // width, int(a_ends[-1] - 1) // width + 1):
        (a0, a1), (b0, b1) = (np.searchsorted(e, [k * width, (k + 1) * width], "right") for e in (a_ends, b_ends))
        yield k, Fragment(a[a0:a1], b[b0:b1], *counts_between(a_ends[a0:a1], b_ends[b0:b1]))


INTS = "array<int>"
SIDES = f"a {INTS}, b {INTS}, na {INTS}, nb {INTS}"
_ints = pa.list_(pa.int32())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _closed(f: Fragment) -> Fragment:
    """Of a whole text: the last common end is the text's, so the open suffix is empty and goes."""
    return Fragment(f.a, f.b, f.na[:-1], f.nb[:-1]) if f.good else Fragment(EMPTY.a, EMPTY.b, EMPTY.a, EMPTY.b)


def _columns(found: list[Fragment]) -> list[pa.Array]:
    return [_lists([getattr(f, k) for f in found]) for k in ("a", "b", "na", "nb")]


def _short(vocabularies: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one fragment each: doc_id and text in, what `align` returns out."""
    tokenizers = _tokenizers(vocabularies)
    for batch in slices(batches, "text", 2 << 20):
        texts = batch.column("text").to_pylist()
        a, b, good = tokenizers.tokens([" " + t for t in texts if t])
        rest = iter(zip(a, b, good))
        found = []
        for t in texts:
            x, y, held = next(rest) if t else (EMPTY.a, EMPTY.b, False)
            ends = np.cumsum(tokenizers.a_lengths[x]), np.cumsum(tokenizers.b_lengths[y])
            found.append(_closed(Fragment(x, y, *counts_between(*ends))) if held else _closed(Fragment(x, y, x, y, False)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(found)], names=["doc_id", "a", "b", "na", "nb"])


def _of_one_fragment(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    return docs.select("doc_id", "text").where((F.octet_length("text") <= chunk_bytes) | F.col("text").isNull())


def align(docs: DataFrame, vocabularies: Broadcast, chunk_bytes: int = CHUNK_BYTES, part_chars: int = PART_CHARS, fan: int = FAN) -> DataFrame:
    """Per document: doc_id, a and b (token ids), na and nb (tokens of each side per group)."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {SIDES}"
    whole = _of_one_fragment(docs, chunk_bytes).mapInArrow(partial(_short, vocabularies), schema)
    return whole.unionByName(_long(docs, vocabularies, chunk_bytes, part_chars, fan).mapInArrow(_finished, schema))


def _long(docs: DataFrame, vocabularies: Broadcast, chunk_bytes: int, part_chars: int, fan: int) -> DataFrame:
    """Fragments of documents of more than one, composed and written: good, a, b, na, nb, doc_id."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text").where(F.octet_length("text") > chunk_bytes)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            for i, text in enumerate(batch.column("text").to_pylist()):
                text, at, start = " " + text, 0, 0
                while at < len(text):
                    cut = SAFE.search(text, at + part_chars)
                    unit = text[at : cut.start() if cut else len(text)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), batch.column("doc_id")[i : i + 1], pa.array([start]), pa.array([unit])],
                        names=["key", "doc_id", "start", "unit"],
                    )
                    at, start = at + len(unit), start + len(unit.encode())
                key += 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(vocabularies)
        for batch in batches:
            for i, (key, start, unit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "start", "unit")))):
                found = list(fragments(tokenizers, unit, start, chunk_bytes))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * n),
                        pa.array([k for k, _ in found], pa.int64()),
                        pa.array([start] * n),
                        pa.array([f.good for _, f in found], pa.bool_()),
                        *_columns([f for _, f in found]),
                        pa.concat_arrays([batch.column("doc_id")[i : i + 1]] * n),
                    ],
                    names=["key", "node", "start", "good", "a", "b", "na", "nb", "doc_id"],
                )

    def composed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("below", "ascending"), ("start", "ascending")]).combine_chunks()
        sides = [[x.values.to_numpy() for x in table[c]] for c in ("a", "b", "na", "nb")]
        whole = compose([Fragment(*x, good) for *x, good in zip(*sides, table["good"].to_pylist())])
        columns = [table["key"].slice(0, 1), pa.array([key[1].as_py()], pa.int64()), table["start"].slice(0, 1), pa.array([whole.good])]
        return pa.table([*columns, *_columns([whole]), table["doc_id"].slice(0, 1)], names=["key", "node", "start", "good", "a", "b", "na", "nb", "doc_id"])

    parts = written(docs.mapInArrow(split, f"key bigint, doc_id {kind}, start bigint, unit string"), "alignment-parts")
    rows = parts.repartition("key", "start").mapInArrow(cut, f"key bigint, node bigint, start bigint, good boolean, {SIDES}, doc_id {kind}")
    rows = written(rows, "alignment-fragments")
    last = rows.agg(F.max("node")).first()[0] or 0
    while last >= 0:
        above = rows.withColumnRenamed("node", "below").withColumn("node", F.expr(f"below div {fan}"))
        rows = above.groupBy("key", "node").applyInArrow(composed, f"key bigint, node bigint, start bigint, good boolean, {SIDES}, doc_id {kind}")
        last = last // fan if last else -1
    # what follows runs on its own, so that a task needs one Python worker at a time
    return written(rows.select("good", "a", "b", "na", "nb", "doc_id"), "alignment-long")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `align` returns, of documents composed by `_long`."""
    for batch in batches:
        sides = [[x.values.to_numpy() for x in batch.column(c)] for c in ("a", "b", "na", "nb")]
        found = [_closed(Fragment(*x, good)) for *x, good in zip(*sides, batch.column("good").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(found)], names=["doc_id", "a", "b", "na", "nb"])


def pairs_of(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (A id, B id, row) that are linked, in this order, and how often. `row` is that of each group."""
    wide = np.int64(1) << 20
    links = na * nb
    a_at, b_at = np.cumsum(na) - na, np.cumsum(nb) - nb
    keys, times = [], []
    small = np.flatnonzero(links <= GROUP_LINKS)
    n = links[small]
    group = np.repeat(small, n)
    place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    x, y = a[a_at[group] + place // nb[group]], b[b_at[group] + place % nb[group]]
    keys.append(((x.astype(np.int64) * wide) + y) * wide + row[group])
    times.append(np.ones(len(group), np.int64))
    for g in np.flatnonzero(links > GROUP_LINKS).tolist():
        x, nx = np.unique(a[a_at[g] : a_at[g] + na[g]], return_counts=True)
        y, ny = np.unique(b[b_at[g] : b_at[g] + nb[g]], return_counts=True)
        keys.append((((x.astype(np.int64) * wide)[:, None] + y) * wide + row[g]).ravel())
        times.append(np.outer(nx, ny).ravel())
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(n, first) if len(first) else n
    key = key[first]
    return key // (wide * wide), key // wide % wide, key % wide, n


def _some(lists: np.ndarray, bounds: np.ndarray, some: np.ndarray) -> pa.Array:
    """Lists cut at the bounds, null where they are left out."""
    sizes = np.diff(bounds)
    offsets = np.concatenate([[0], np.cumsum(np.where(some, sizes, 0))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists[np.repeat(some, sizes)]), mask=pa.array(~some))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, about SEGMENT_TOKENS tokens at a time."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + SEGMENT_TOKENS, "right"))), start + (1 << 20) - 1)
            yield batch.slice(start, stop - start)
            start = stop


class Spelling:
    """`a1,a2|b1;a3|b2,b3` of many documents: per id and what follows it one string."""

    def __init__(self):
        self.a: list[bytes] = []
        self.b: list[bytes] = []

    def digests(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, groups: np.ndarray) -> list[str]:
        """`groups` is each document's number of groups."""
        for table, ids, signs in ((self.a, a, (b",", b"|")), (self.b, b, (b",", b";", b""))):
            for i in range(len(table) // len(signs), int(ids.max(initial=-1)) + 1):
                table.extend(b"%d%s" % (i, s) for s in signs)
        a_last, b_last = np.cumsum(na), np.cumsum(nb)
        a_code, b_code = a.astype(np.int64) * 2, b.astype(np.int64) * 3
        a_code[a_last - 1] += 1
        b_code[b_last - 1] += 1
        ends = np.cumsum(groups)
        some = ends[groups > 0]
        b_code[b_last[some - 1] - 1] += 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(b_last - nb, na)] = a_code
        codes[np.arange(len(b)) + np.repeat(a_last, nb)] = b_code + len(self.a)
        text = self.a + self.b
        at = np.concatenate([[0], a_last + b_last])[np.concatenate([[0], ends])]
        return [hashlib.sha256(b"".join(map(text.__getitem__, codes[i:j].tolist()))).hexdigest() if i < j else "" for i, j in zip(at, at[1:])]


def links(docs: DataFrame, vocabularies: Broadcast, chunk_bytes: int = CHUNK_BYTES, part_chars: int = PART_CHARS, fan: int = FAN) -> DataFrame:
    """An index of linked ids, written: per segment and pair rows (a, b, rows, times; times null: once each); and, with a null, one row per
    document (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256). Documents of one fragment are aligned and
    indexed by the same task."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"segment bigint, a int, b int, rows {INTS}, times array<bigint>, row int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    run = lambda batches: _indexed(0, _short(vocabularies, batches))
    whole = _of_one_fragment(docs, chunk_bytes).mapInArrow(run, schema)
    rest = _long(docs, vocabularies, chunk_bytes, part_chars, fan).mapInArrow(lambda batches: _indexed(1, _finished(batches)), schema)
    return written(whole.unionByName(rest), "alignment-links")


def _indexed(side: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `links` from aligned documents. `side` keeps segments of two sources apart."""
    names = ["segment", "a", "b", "rows", "times", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    base, spelling = (2 * TaskContext.get().partitionId() + side) << 31, Spelling()
    for k, batch in enumerate(_segments(batches)):
        a, b, na, nb = (batch.column(c).flatten().to_numpy() for c in ("a", "b", "na", "nb"))
        sizes = {c: pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "na")}
        na, nb = na.astype(np.int64), nb.astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes["na"])
        x, y, rows, times = pairs_of(a, b, na, nb, row)
        first = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
        bounds = np.append(first, len(x))
        n = len(first)
        ints, longs = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, base + k)),
                pa.array(x[first].astype(np.int32)),
                pa.array(y[first].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rows.astype(np.int32))),
                _some(times, bounds, np.maximum.reduceat(times, first) > 1 if n else np.zeros(0, bool)),
                ints,
                pa.nulls(n, batch.column("doc_id").type),
                *[longs] * 4,
                pa.nulls(n, pa.string()),
            ],
            names=names,
        )
        n = batch.num_rows
        total = np.zeros(n, np.int64)
        np.add.at(total, row, na * nb)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, base + k)),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, _ints),
                pa.nulls(n, pa.list_(pa.int64())),
                pa.array(np.arange(n, dtype=np.int32)),
                batch.column("doc_id"),
                *(pa.array(sizes[c]) for c in ("a", "b", "na")),
                pa.array(total),
                pa.array(spelling.digests(a, b, na, nb, sizes["na"])),
            ],
            names=names,
        )


def pair_counts(index: DataFrame) -> DataFrame:
    """Per pair of ids: a, b, count (documents that hold it linked), best (the highest count of its a)."""
    counts = index.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum(F.size("rows")).alias("count"))
    return counts.withColumn("best", F.max("count").over(Window.partitionBy("a")))


def measured(index: DataFrame) -> DataFrame:
    """Per document of the index, also n_best (links whose count is their a's highest) and count_sum (over links)."""
    held = index.where("a IS NOT NULL").select("segment", "a", "b", "rows", "times").join(pair_counts(index), ["a", "b"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = table["rows"].combine_chunks().flatten().to_numpy()
        n = pc.list_value_length(table["rows"]).to_numpy()
        times = np.ones(len(rows), np.int64)
        times[np.repeat(pc.is_valid(table["times"]).to_numpy(), n)] = table["times"].combine_chunks().flatten().to_numpy()
        count = np.repeat(table["count"].to_numpy(), n)
        best = np.repeat(table["count"].to_numpy() == table["best"].to_numpy(), n)
        own = np.unique(rows)
        sums = np.zeros((2, len(own)), np.int64)
        at = np.searchsorted(own, rows)
        np.add.at(sums[0], at, times * best)
        np.add.at(sums[1], at, times * count)
        return pa.table({"segment": pa.array([key[0].as_py()] * len(own), pa.int64()), "row": own, "n_best": sums[0], "count_sum": sums[1]})

    sums = held.groupBy("segment").applyInArrow(run, "segment bigint, row int, n_best bigint, count_sum bigint")
    documents = index.where("a IS NULL").select("segment", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("bigint")
    return documents.join(sums, ["segment", "row"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def shared(spark: SparkSession, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Broadcast:
    """Both vocabularies for all tasks: files of bounded size, which executors need not have."""
    return spark.sparkContext.broadcast(load(byte_bpe, piece_bpe))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measured(links(docs, shared(spark)))
