"""SentencePiece encoding and decoding: N-best segmentations over the piece lattice.

A segmentation's score is the sum of its pieces' scores in the model file. Per stretch of text a forward
Viterbi pass gives the best score up to each place; these are exact heuristics for an A-star
search from the end back to the start, which thus meets complete segmentations best first.

No piece crosses from another character to a blank, or over two neighbours that no piece
contains, so texts fall apart into independent stretches; the N best of a text come from the
N best of its stretches, exactly: only those of least loss can differ, and only these are searched.

Blanks become U+2581, one is put before the text; a character that no piece holds becomes its UTF-8 bytes, and so does
U+2581 itself, so every text comes back as it was. Null text gives null ids and null text, empty text no
ids. Equal scores are ordered by the search and alike in every run. Repeated rows are encoded each; empty tables give
empty results; extra columns stay with `encode` and `decode`.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.text import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
KEPT_STRETCHES = 50_000
BLANK = "▁"
LONG = 40  # longer stretches are searched one by one
LITERAL = "a" + BLANK * LONG  # for a U+2581 of the text itself; no other stretch has a blank inside

Path = tuple[float, tuple[int, ...]]


@dataclass
class Model:
    """Pieces and scores, with tables derived from them; its size is that of the vocabulary file."""

    pieces: list[str]
    vocabulary: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    unknown_score: float
    longest: dict[str, int] = field(init=False)  # by a piece's first two characters
    pairs: set[str] = field(init=False)  # neighbours inside pieces
    cut: re.Pattern = field(init=False)  # finds the stretches of a marked text

    def __post_init__(self) -> None:
        self.longest, self.pairs = {}, set()
        for p in self.vocabulary:
            for start in (p[:1], p[:2]):
                self.longest[start] = max(self.longest.get(start, 0), len(p))
            self.pairs.update(map("".join, zip(p, p[1:])))
        # ASCII characters that no piece holds (line ends above all) stand alone
        alone = re.escape("".join({chr(c) for c in range(128)} - {c for p in self.vocabulary for c in p}))
        self.cut = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else ""))
        self.texts = [p.replace(BLANK, " ") for p in self.pieces]
        for i in self.byte_ids:
            self.texts[i] = ""
        self.values = {i: b for b, i in enumerate(self.byte_ids)}


def load(path: str = MODEL) -> Model:
    """Read a model file with byte fallback, on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    normal = [i for i in range(len(pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    crossing = [p for i in normal if BLANK in (p := pieces[i]).lstrip(BLANK)]
    if crossing:
        raise ValueError(f"pieces with an inner blank are not supported: {crossing[:3]}")
    scores = {pieces[i]: (i, sp.get_score(i)) for i in normal}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(map(sp.is_byte, byte_ids)):
        raise ValueError("the model has no byte fallback")
    return Model(pieces, scores, byte_ids, sp.unk_id(), min(s for _, s in scores.values()) - 10)


def lattice(model: Model, text: str) -> list[list[tuple[int, int, float]]]:
    """Per place, the pieces that end there: (start, id or -1 for an unknown character, score)."""
    ends: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text) + 1)]
    vocabulary, longest = model.vocabulary, model.longest
    for i in range(len(text)):
        most = longest.get(text[i : i + 2]) or longest.get(text[i], 0) and 1
        for j in range(i + 1, min(len(text), i + most) + 1):
            if p := vocabulary.get(text[i:j]):
                ends[j].append((i, *p))
        if text[i] not in vocabulary:
            ends[i + 1].append((i, -1, model.unknown_score))
    return ends


def n_best(model: Model, text: str, n: int) -> list[Path]:
    """The n best segmentations of a stretch (all, if there are fewer): forward Viterbi, backward A-star."""
    ends = lattice(model, text)
    best = [0.0] * len(ends)
    for j in range(1, len(ends)):
        best[j] = max(s + best[i] for i, _, s in ends[j])
    out: list[Path] = []
    tick = 0  # orders equals, and keeps paths from being compared
    heap: list[tuple] = [(-best[-1], len(text), tick, 0.0, None)]
    while heap and len(out) < n:
        _, j, _, after, path = heapq.heappop(heap)
        if j == 0:
            ids: list[int] = []
            while path:
                i, end, piece, path = path
                ids.extend([piece] if piece >= 0 else [model.byte_ids[b] for b in text[i:end].encode()])
            out.append((after, tuple(ids)))
            continue
        for i, piece, s in ends[j]:
            tick += 1
            heapq.heappush(heap, (-(after + s + best[i]), i, tick, after + s, (i, j, piece, path)))
    return out


def combine(parts: Sequence[Sequence[Path]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best choices of one path per part: what each loses against the best, and the parts where it differs with the path taken.

    Only the n - 1 parts that lose least by their second path can differ in them.
    """
    losses = [(p[0][0] - p[1][0], k) for k, p in enumerate(parts) if len(p) > 1]
    chosen: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for _, k in heapq.nsmallest(n - 1, losses):
        chosen = heapq.nsmallest(
            n,
            [(loss + parts[k][0][0] - score, {**taken, k: i} if i else taken) for loss, taken in chosen for i, (score, _) in enumerate(parts[k])],
            key=lambda x: x[0],
        )
    return chosen


class Trie:
    """All pieces as arrays: from node and character class to node (a hash table), and the piece that ends there."""

    def __init__(self, vocabulary: dict[str, tuple[int, float]]):
        classes = {c: k + 1 for k, c in enumerate(sorted({c for p in vocabulary for c in p}))}
        self.width = len(classes) + 1
        steps: dict[int, int] = {}
        ids, scores = [-1], [-np.inf]
        for piece, (i, score) in vocabulary.items():
            node = 0
            for c in piece:
                key = node * self.width + classes[c]
                if (node := steps.get(key, -1)) < 0:
                    node = steps[key] = len(ids)
                    ids.append(-1)
                    scores.append(-np.inf)
            ids[node], scores[node] = i, score
        self.ids, self.scores = np.array(ids, np.int32), np.array(scores)
        self.depth = max(map(len, vocabulary))
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in classes]] = list(classes.values())
        self.bits = len(steps).bit_length() + 3  # an eighth full at most
        self.keys, self.targets = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        keys, targets = np.fromiter(steps, np.int64), np.fromiter(steps.values(), np.int64)
        tried = 0
        while len(keys):
            slot = (self._slot(keys) + tried) & ((1 << self.bits) - 1)
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.targets[slot[first]] = keys[first], targets[first]
            keys, targets = np.delete(keys, first), np.delete(targets, first)
            tried += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The nodes reached, 0 where there is none."""
        keys = nodes * self.width + classes
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.targets[slot], 0)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.targets[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


def viterbi(trie: Trie, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many stretches at once: best score, what the second path loses (inf: there is none), numbers of ids, and all ids on end.

    A stretch with a character that no piece holds has score -inf and no ids. Of equal paths the one whose last piece
    is longest wins, then the one before it, as in `n_best`.
    """
    n = len(texts)
    lengths = np.array([len(t) for t in texts])
    most = int(lengths.max())
    depth = min(trie.depth, most)
    chars = np.zeros((most + 1, n), np.int64)
    flat = trie.class_of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    column = np.repeat(np.arange(n), lengths)
    row = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars[row, column] = flat
    edges = np.full((depth + 1, most, n), -np.inf)
    ids = np.zeros((depth + 1, most, n), np.int32)
    node = np.zeros(len(row), np.int64)
    start, lane = row, column
    for k in range(1, depth + 1):
        c = chars[start + k - 1, lane]
        node = trie.step(node, c)
        alive = node > 0
        node, start, lane = node[alive], start[alive], lane[alive]
        edges[k, start, lane], ids[k, start, lane] = trie.scores[node], trie.ids[node]
        inside = start + k < most
        node, start, lane = node[inside], start[inside], lane[inside]
        if not len(node):
            break
    forward = np.full((most + 1, n), -np.inf)
    forward[0] = 0
    choice = np.zeros((most + 1, n), np.int64)
    for j in range(1, most + 1):
        for k in range(1, min(j, depth) + 1):
            value = forward[j - k] + edges[k, j - k]
            better = value >= forward[j]
            better &= value > -np.inf
            np.copyto(forward[j], value, where=better)
            choice[j][better] = k
    score = forward[lengths, np.arange(n)]
    backward = np.full((most + 1, n), -np.inf)
    backward[lengths, np.arange(n)] = 0
    for i in range(most - 1, -1, -1):
        for k in range(1, min(most - i, depth) + 1):
            np.maximum(backward[i], edges[k, i] + backward[i + k], out=backward[i])
    place, lane = lengths.copy(), np.flatnonzero(score > -np.inf)
    counts = np.zeros(n, np.int64)
    steps = []
    while len(lane):
        k = choice[place[lane], lane]
        place[lane] -= k
        steps.append((lane, ids[k, place[lane], lane]))
        edges[k, place[lane], lane] = -np.inf  # what stays are the edges off the best path
        counts[lane] += 1
        lane = lane[place[lane] > 0]
    second = np.full(n, -np.inf)
    for k in range(1, depth + 1):
        for i in range(most - k + 1):
            np.maximum(second, forward[i] + edges[k, i] + backward[i + k], out=second)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.int32)
    for step, (lane, own) in enumerate(steps):
        out[ends[lane] - 1 - step] = own
    with np.errstate(invalid="ignore"):
        loss = np.where(second > -np.inf, score - second, np.inf)
    return score, loss, counts, out


class Encoder:
    """Encodes many texts at a time: Viterbi over all their different stretches at once, A-star for those in which the N best of a text differ."""

    def __init__(self, model: Model, n: int = N_BEST, kept: int = KEPT_STRETCHES):
        self.model, self.n, self.kept = model, n, kept
        self.trie = Trie(model.vocabulary)
        self.known: dict[str, list[Path]] = {}
        low = tuple(model.byte_ids[b] for b in BLANK.encode())
        self.blank = [(model.unknown_score, low)]

    def searched(self, text: str) -> list[Path]:
        """The n best segmentations of a stretch, from those of its independent parts."""
        if text == LITERAL:
            return self.blank
        if (out := self.known.get(text)) is not None:
            return out
        pairs = self.model.pairs
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs), len(text)]
        parts = [n_best(self.model, text[a:b], self.n) for a, b in zip(cuts, cuts[1:])]
        top = sum(p[0][0] for p in parts)
        out = [
            (top - loss, tuple(x for k, p in enumerate(parts) for x in p[taken.get(k, 0)][1])) for loss, taken in combine(parts, self.n)
        ]
        if len(self.known) >= self.kept:
            self.known.clear()
        if len(text) <= LONG:
            self.known[text] = out
        return out

    def table(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per different stretch: score, loss of its second path, where its ids begin (one more at the end); the ids."""
        n = len(stretches)
        score, loss, counts = np.empty(n), np.full(n, np.inf), np.zeros(n, np.int64)
        lengths = np.array([len(s) for s in stretches])
        order = np.argsort(lengths, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        slow = order[lengths[order] > LONG].tolist()
        short = order[: n - len(slow)]
        while len(short):
            size = max(64, min(2048, 32_000 // int(lengths[short[0]] + 1)))
            own, short = short[:size], short[size:]
            score[own], loss[own], counts[own], ids = viterbi(self.trie, [stretches[i] for i in own])
            found.append((own, ids))
            slow += own[score[own] == -np.inf].tolist()
        for i in slow:  # long, or with characters that no piece holds
            paths = self.searched(stretches[i])
            score[i], counts[i] = paths[0][0], len(paths[0][1])
            loss[i] = paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(at[-1], np.int32)
        for own, ids in found:
            seen = counts[own]
            seen = np.where(np.isin(own, slow), 0, seen) if slow else seen
            flat[np.repeat(at[own] - (np.cumsum(seen) - seen), seen) + np.arange(seen.sum())] = ids
        for i in slow:
            flat[at[i] : at[i + 1]] = self.searched(stretches[i])[0][1]
        return score, loss, at, flat

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """Per text: best ids, their score, and the next best segmentations: score, edits (start and end in the best ids, other ids)."""
        numbers: dict[str, int] = defaultdict(count().__next__)
        rows = [np.fromiter(map(numbers.__getitem__, stretches_of(self.model, t)), np.int64) for t in texts]
        if not numbers:
            return [(np.empty(0, np.int32), 0.0, []) for _ in texts]
        stretches = list(numbers)
        score, loss, at, flat = self.table(stretches)
        counts = np.diff(at)
        out = []
        for own in rows:
            size = counts[own]
            ends = np.cumsum(size)
            ids = flat[np.repeat(at[own] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            total = float(score[own].sum())
            losses = loss[own]
            least = np.sort(np.argpartition(losses, self.n - 2)[: self.n - 1]) if len(losses) >= self.n > 1 else np.arange(len(losses) if self.n > 1 else 0)
            if len(losses) >= self.n > 1:  # of equal losses the first in the text
                limit = losses[least].max()
                below, equal = np.flatnonzero(losses < limit), np.flatnonzero(losses == limit)
                least = np.sort(np.concatenate([below, equal[: self.n - 1 - len(below)]]))
            parts = []
            for k in least[np.isfinite(losses[least])].tolist():
                best = tuple(flat[at[own[k]] : at[own[k] + 1]].tolist())
                paths = self.searched(stretches[own[k]])
                parts.append((k, [(paths[0][0], best), *(p for p in paths if p[1] != best)][: self.n]))
            others = []
            for lost, taken in combine([p for _, p in parts], self.n)[1:]:
                edits = [(int(ends[parts[i][0]] - size[parts[i][0]]), int(ends[parts[i][0]]), parts[i][1][x][1]) for i, x in sorted(taken.items())]
                others.append((total - lost, edits))
            out.append((ids, total, others))
        return out


def stretches_of(model: Model, text: str) -> list[str]:
    """The marked text in stretches that no piece crosses; LITERAL stands for a U+2581 of the text itself."""
    if not text:
        return []
    if BLANK not in text:
        return model.cut.findall(BLANK + text.replace(" ", BLANK))
    out = []
    for k, piece in enumerate(text.split(BLANK)):
        out += [LITERAL] if k else []
        out += model.cut.findall(("" if k else BLANK) + piece.replace(" ", BLANK))
    return out


def decode_ids(model: Model, ids: Sequence[int]) -> str:
    """The text of ids; the blank before the text goes."""
    texts, values = model.texts, model.values
    if values.keys().isdisjoint(ids):
        return "".join(map(texts.__getitem__, ids))[1:]
    out, raw = [], bytearray()
    for i in ids:
        if i in values:
            raw.append(values[i])
        else:
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(texts[i])
    return "".join([*out, raw.decode(errors="replace")])[1:]


EDIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
OTHER = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(EDIT))])
ENCODED = [
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("others", T.ArrayType(OTHER)),
    T.StructField("round_trip", T.BooleanType()),
]
_ARROW = (
    pa.list_(pa.int32()),
    pa.float64(),
    pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])))])),
    pa.bool_(),
)

_encoders: dict[tuple, Encoder] = {}


def _encoder(model: Broadcast, n: int) -> Encoder:
    """One per Python worker, so that stretches stay known from task to task."""
    key = (id(model.value), n)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model.value, n)
    return _encoders[key]


def encode(docs: DataFrame, model: Broadcast, n: int = N_BEST) -> DataFrame:
    """`docs` without columns of these names, and: ids, score, others (the next n - 1 segmentations), round_trip (decoding gives the text back)."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in {x.name for x in ENCODED}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, n)
        for batch in slices(batches, "text", 8 << 20):
            rows = []
            texts = batch.column("text").to_pylist()
            for text, (ids, score, others) in zip(texts, encoder.encode([t or "" for t in texts])):
                if text is None:
                    rows.append((None, None, None, None))
                    continue
                more = [{"score": s, "edits": [{"start": a, "end": b, "ids": x} for a, b, x in e]} for s, e in others]
                rows.append((ids, score, more, decode_ids(encoder.model, ids.tolist()) == text))
            new = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(x.name for x in ENCODED)])

    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, T.StructType([*kept, *ENCODED]))


def decode(encoded: DataFrame, model: Broadcast, ids: str = "ids", text: str = "text") -> DataFrame:
    """`encoded` with the column `text` made from `ids`."""
    fields = [f for f in encoded.schema.fields if f.name.lower() != text.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(model.value, x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return encoded.select(*(f"`{f.name}`" for f in fields)).mapInArrow(run, T.StructType([*fields, T.StructField(text, T.StringType())]))


def shared(spark: SparkSession, path: str = MODEL) -> Broadcast:
    """The model for all tasks: a vocabulary file, so of bounded size; executors need not have it."""
    return spark.sparkContext.broadcast(load(path))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, shared(spark)).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "score", "others", "round_trip")
