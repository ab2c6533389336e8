"""Secrets: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits and `+/_.-`; a line's tokens are a chain with the labels outside, begin, inside.
Features of a token: its shape (length, kinds of characters, share of digits, changes between kinds, hex), what stands before
and after it, the word itself and its neighbours (hashed), and features of the file (share of digits, of assignments).
The field is trained here, in numpy, on a bounded sample of rows whose labels come from the patterns, with groups
of features hidden at random, so that no single cue (the word before, the sign, the length) decides; it is decoded by
Viterbi over whole texts. A token whose lead for "outside" exceeds all that transitions could give is outside on every best
path, so Viterbi runs only through the stretches between such tokens, with the same result.

Spans: assign, access, hex (leftmost, non-overlapping per kind), then `secret` for what the field finds beyond them;
all that the field finds, beside the patterns or on top of them, stands in a column of its own.
Null and empty texts have none. Repeated rows are scanned each; an empty table gives an empty result, extra columns are ignored.
Without any secret in the sample the field finds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.text import SLICE_BYTES, hash_bound, slices, word_hashes

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "secret")

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{32,}")  # runs of [0-9a-f]+ with 32 characters at least

# bounds of the training sample
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 4000
TRAIN_CHAINS = 6000
NO_SECRET = 0.25  # share of training chains that is kept for those without a secret
CHAIN = 48
EPOCHS = 12
MIN_LENGTH = 8  # of a token that the field may add
HIDDEN = 0.5  # chance that a chain is trained without a group of features

OUT, BEGIN, INSIDE = 0, 1, 2
LEFT_OUT = -1
WORDS = 1 << 12

KIND = np.zeros(256, np.uint8)  # 0 separates, 1 digit, 2 upper, 3 lower, 4 symbol, 5 other
KIND[48:58], KIND[65:91], KIND[97:123], KIND[128:] = 1, 2, 3, 5
KIND[[ord(c) for c in "+/_.-"]] = 4
#: group sizes of the features; a token has one of each
SIZES = (16, 32, 8, 8, 2, 8, 4, 32, 32, 16, WORDS, WORDS, WORDS)
STARTS = np.concatenate([[0], np.cumsum(SIZES)])
NOTHING = int(STARTS[-1])  # stands for a hidden feature; its weight stays 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    spans = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(spans)


def values(text: str, kinds: tuple[str, ...] = BASE) -> list[tuple[int, int]]:
    """What of the pattern spans of some kinds is secret: of an assignment its value."""
    assigned = [m.span(2) for m in _assign.finditer(text) if len(m[2]) >= 8] if BASE[0] in kinds else []
    return assigned + [(a, b) for a, k, b in base_spans(text) if k and BASE[k] in kinds]


def byte_places(raw: bytes) -> np.ndarray:
    """Where each code point of a UTF-8 text begins, and its end."""
    return np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


@dataclass
class Tokens:
    starts: np.ndarray  # byte positions in all texts on end
    ends: np.ndarray
    features: np.ndarray  # (tokens, groups), columns of the weights
    fresh: np.ndarray  # the token begins a line or a text


def tokenize(texts: list[bytes]) -> Tokens:
    """Tokens of the texts joined by line ends."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = KIND[raw]
    held = kind > 0
    edge = np.diff(held.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        empty = np.empty(0, np.int64)
        return Tokens(empty, empty, np.empty((0, len(SIZES)), np.int64), np.empty(0, bool))

    def total(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        return run[ends] - run[starts]

    length = ends - starts
    counts = [total(kind == k) for k in range(1, 6)]
    hexes = counts[0] + total((raw >= 97) & (raw <= 102))
    changes = total((kind[1:] != kind[:-1]) & held[1:] & held[:-1] if len(kind) > 1 else held)
    shape = sum((c > 0).astype(np.int64) << k for k, c in enumerate(counts))
    gap_starts = np.concatenate([[0], ends[:-1]])

    def between(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        return (run[starts] - run[gap_starts]) > 0

    assigned, quoted, broken = between((raw == 58) | (raw == 61)), between((raw == 34) | (raw == 39)), between(raw == 10)
    broken[0] = True
    before = assigned * 4 + quoted * 2 + broken
    after = np.append(quoted[1:], False) * 2 + np.append(broken[1:], True)
    folded = np.frombuffer(raw[held].tobytes().lower(), np.uint8)
    words = (word_hashes(folded, np.concatenate([[0], np.cumsum(length)])) >> np.uint64(40)).astype(np.int64) % WORDS
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, np.concatenate([[0], text_ends]))
    own = np.diff(bounds)
    per = np.maximum(own, 1)
    digits = np.add.reduceat(np.append(counts[0], 0), np.minimum(bounds[:-1], n)) * (own > 0)
    chars = np.maximum(np.diff(np.concatenate([[0], text_ends])), 1)
    marks = np.add.reduceat(np.append(assigned, 0).astype(np.int64), np.minimum(bounds[:-1], n)) * (own > 0)
    file = np.minimum(digits * 50 // chars, 3) * 4 + np.minimum(marks * 100 // per, 3)
    bits = np.minimum(np.int64(2) * np.log2(np.maximum(length, 1)), 15).astype(np.int64)
    columns = (
        bits,
        shape,
        np.minimum(counts[0] * 8 // length, 7),
        np.minimum(changes, 7),
        ((hexes == length) & (length >= 16)).astype(np.int64),
        before.astype(np.int64),
        after.astype(np.int64),
        np.concatenate([[0], shape[:-1]]),
        np.append(shape[1:], 0),
        np.repeat(file, own),
        words,
        np.concatenate([[0], words[:-1]]),
        np.append(words[1:], 0),
    )
    return Tokens(starts, ends, np.stack(columns, 1) + STARTS[:-1], broken)


@dataclass
class Field:
    weights: np.ndarray  # (features, labels)
    moves: np.ndarray  # from label to label
    first: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.starts), 3), np.float32)
        for g in range(len(SIZES)):
            out += self.weights[tokens.features[:, g]]
        return out


def chains(tokens: Tokens, labels: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Token numbers of training chains: lines, cut to CHAIN tokens; those with a secret first, but NO_SECRET of
    TRAIN_CHAINS are kept for others, as far as there are any. Which ones, chance decides. Chains with a token
    of label LEFT_OUT are not trained on."""
    cuts = np.flatnonzero(tokens.fresh)
    pieces = [np.arange(i, min(i + CHAIN, b)) for a, b in zip(cuts, np.append(cuts[1:], len(tokens.starts))) for i in range(a, b, CHAIN)]
    pieces = [p for p in pieces if not (labels[p] == LEFT_OUT).any()]
    secret = np.array([labels[p].any() for p in pieces], bool)
    have, rest = rng.permutation(np.flatnonzero(secret)), rng.permutation(np.flatnonzero(~secret))
    have = have[: TRAIN_CHAINS - min(len(rest), int(TRAIN_CHAINS * NO_SECRET))]
    return [pieces[i] for i in sorted([*have.tolist(), *rest[: TRAIN_CHAINS - len(have)].tolist()])]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def gradient(field: Field, x: np.ndarray, labels: np.ndarray, real: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log likelihood of a batch of chains and its gradient (weights, moves, first), by forward-backward.

    x: features (chains, tokens, groups); real: which tokens there are, from each chain's first on.
    """
    size, most = real.shape
    emit = field.weights[x].sum(2)
    alpha, beta = np.zeros((most, size, 3)), np.zeros((most, size, 3))
    alpha[0] = field.first + emit[:, 0]
    for t in range(1, most):
        alpha[t] = np.where(real[:, t, None], _log_sum(alpha[t - 1][:, :, None] + field.moves, 1) + emit[:, t], alpha[t - 1])
    for t in range(most - 2, -1, -1):
        beta[t] = np.where(real[:, t + 1, None], _log_sum(field.moves + (emit[:, t + 1] + beta[t + 1])[:, None, :], 2), 0)
    z = _log_sum(alpha[-1], 1)
    marginal = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
    gold = np.eye(3)[labels] * real[:, :, None]
    change = gold - marginal
    grads = [np.zeros_like(p) for p in (field.weights, field.moves, field.first)]
    for g in range(x.shape[2]):
        np.add.at(grads[0], x[:, :, g].ravel(), change.reshape(-1, 3))
    grads[2] = change[:, 0].sum(0)
    value = (gold * emit).sum() + (gold[:, 0] @ field.first).sum() - z.sum()
    for t in range(1, most):
        pair = gold[:, t - 1][:, :, None] * gold[:, t][:, None, :]
        both = np.exp(alpha[t - 1][:, :, None] + field.moves + (emit[:, t] + beta[t])[:, None, :] - z[:, None, None])
        grads[1] += ((pair - both) * real[:, t, None, None]).sum(0)
        value += (pair * field.moves * real[:, t, None, None]).sum()
    return float(value), grads


def train(tokens: Tokens, labels: np.ndarray, seed: int = 7, hidden: float = HIDDEN) -> Field:
    """Maximum likelihood with weight decay, by Adam on batches of chains; of each chain, groups of features are hidden by chance."""
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((NOTHING + 1, 3)), np.zeros((3, 3)), np.zeros(3))
    picked = chains(tokens, labels, rng)
    if not (labels > 0).any():
        field.weights[STARTS[0] : STARTS[1], OUT] = 100
        return field
    params = [field.weights, field.moves, field.first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(picked))
        for a in range(0, len(order), 128):
            batch = sorted((picked[i] for i in order[a : a + 128]), key=len, reverse=True)
            size, most = len(batch), len(batch[0])
            at = np.zeros((size, most), np.int64)
            real = np.zeros((size, most), bool)
            for i, p in enumerate(batch):
                at[i, : len(p)], real[i, : len(p)] = p, True
            x = tokens.features[at]
            for g in range(len(SIZES)):
                x[rng.random(size) < hidden, :, g] = NOTHING
            _, grads = gradient(field, x, labels[at], real)
            grads[0][NOTHING] = 0
            step += 1
            for p, g, mm, vv in zip(params, grads, m, v):
                g = g / size - 1e-4 * p
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p += 0.05 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Field(field.weights.astype(np.float32), field.moves.astype(np.float32), field.first.astype(np.float32))


def decode(field: Field, scores: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Best labels of all chains (a chain begins where `fresh`), by Viterbi where "outside" is not certain: all such stretches of a length at once."""
    n = len(scores)
    labels = np.zeros(n, np.int8)
    spread = float(field.moves.max() - field.moves.min()) * 2 + float(field.first.max() - field.first.min())
    open_ = np.flatnonzero(scores[:, OUT] - scores[:, 1:].max(1) <= spread)
    if not len(open_):
        return labels
    heads = np.concatenate([[0], np.flatnonzero((np.diff(open_) > 1) | fresh[open_[1:]]) + 1])
    first, lengths = open_[heads], np.diff(np.append(heads, len(open_)))
    for size in np.unique(lengths).tolist():
        a = first[lengths == size]
        best = scores[a] + np.where(fresh[a][:, None], field.first, field.moves[OUT])
        back = []
        for t in range(1, size):
            options = best[:, :, None] + field.moves
            back.append(options.argmax(1))
            best = options.max(1) + scores[a + t]
        after = np.minimum(a + size, n - 1)
        goes_on = (a + size < n) & ~fresh[after]
        label = (best + np.where(goes_on[:, None], field.moves[:, OUT], 0)).argmax(1)
        labels[a + size - 1] = label
        for t in range(size - 2, -1, -1):
            label = back[t][np.arange(len(a)), label]
            labels[a + t] = label
    return labels


def weak_labels(texts: list[str], tokens: Tokens, kinds: tuple[str, ...] = BASE) -> np.ndarray:
    """Begin and inside for the tokens of secret values found by the patterns of some kinds, LEFT_OUT for those of the others."""
    labels, base = np.zeros(len(tokens.starts), np.int64), 0
    for text in texts:
        raw = text.encode()
        own = [(a, b, True) for a, b in values(text, kinds)]
        other = [(a, b, False) for a, b in values(text, tuple(k for k in BASE if k not in kinds))]
        if own or other:
            places = base + byte_places(raw)
            for a, b, known in own + other:
                i, j = np.searchsorted(tokens.ends, places[a], "right"), np.searchsorted(tokens.starts, places[b])
                labels[i:j] = INSIDE if known else LEFT_OUT
                labels[i : min(i + 1, j)] = BEGIN if known else LEFT_OUT
        base += len(raw) + 1
    return labels


def _likely(text: Column) -> Column:
    """Mentions a key word, or a long run of digits and letters."""
    folded = F.lower(text)
    words = [F.contains(folded, F.lit(w)) for w in ("passw", "secret", "token", "apikey", "api_key", "akia")]
    return reduce(Column.__or__, words) | text.rlike("[0-9a-f]{32}")


def _whole(text: str, cut_before: bool, cut_after: bool) -> str:
    """A piece of a text without the line that was cut at its beginning or end (or word, where it is all one line)."""
    for cut, find, keep in ((cut_before, str.find, lambda i: text[i + 1 :]), (cut_after, str.rfind, lambda i: text[:i])):
        if cut:
            at = next((i for sign in "\n " if (i := find(text, sign)) >= 0), None)
            text = text if at is None else keep(at)
    return text


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """About `rows` texts at most, chosen by hash; half of them such as mention a key word or a long run of digits and letters.

    A text longer than `chars` gives the whole lines of that many characters, from a place that its hash chooses, so that no part of
    the texts is left out. Two passes: counts, from which the bounds of the hashes follow, and the rows within them.
    """
    whole = docs.select("text", F.xxhash64("text").alias("at"), F.length("text").alias("size")).where("text <> ''")
    start = F.pmod(F.xxhash64("at"), F.greatest(F.col("size") - (chars - 1), F.lit(1))) + 1
    pieces = whole.select(F.substring("text", start, F.lit(chars)).alias("text"), "at", (start > 1).alias("before"), (start + chars <= F.col("size")).alias("after"))
    marked = pieces.withColumn("likely", _likely(F.col("text")))
    counts = marked.agg(F.count("*").alias("all"), F.count_if("likely").alias("likely")).first()
    bounds = [F.lit(hash_bound(n, rows // 2)) for n in (counts["all"], counts["likely"])]
    chosen = marked.where((F.col("at") <= bounds[0]) | F.col("likely") & (F.col("at") <= bounds[1]))
    # one row per hash: copies of one text, however many, count once
    found = chosen.groupBy("at").agg(*(F.min(c).alias(c) for c in ("text", "before", "after"))).collect()
    return sorted({_whole(r["text"], r["before"], r["after"]) for r in found})


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, kinds: tuple[str, ...] = BASE) -> Field:
    """Train on a sample of the texts, labelled by the patterns of some kinds; lines with secrets of other kinds are not trained on."""
    texts = sample(docs, rows, chars)
    tokens = tokenize([t.encode() for t in texts])
    return train(tokens, weak_labels(texts, tokens, kinds))


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Per text what the field finds, (start, kind, end) in code points, wherever the patterns match."""
    raw = [t.encode() for t in texts]
    tokens = tokenize(raw)
    labels = decode(field, field.scores(tokens), tokens.fresh)
    found = np.flatnonzero(labels)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(found):
        return out
    heads = np.concatenate([[True], (np.diff(found) > 1) | (labels[found[1:]] == BEGIN) | tokens.fresh[found[1:]]])
    first, last = tokens.starts[found[heads]], tokens.ends[found[np.append(np.flatnonzero(heads)[1:] - 1, len(found) - 1)]]
    joined_bytes = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    points = np.concatenate([[0], np.cumsum((joined_bytes & 0xC0) != 0x80)])  # code points before each byte
    text_starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    own = np.searchsorted(text_starts, first, "right") - 1
    for k, a, b in zip(own.tolist(), (points[first] - points[text_starts[own]]).tolist(), (points[last] - points[text_starts[own]]).tolist()):
        if b - a >= MIN_LENGTH:
            out[k].append((a, 3, b))
    return out


def beyond(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of `spans` that overlap none of `base`; both sorted by start, `spans` apart from each other. One sweep."""
    out, i, reach = [], 0, -1  # reach: the furthest end of base spans that begin before the end of a span
    for a, k, b in spans:
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            out.append((a, k, b))
    return out


def find(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Per text all spans (start, kind, end) in code points: those of the patterns, and of the field beyond them."""
    return [sorted([*base, *beyond(more, base)]) for base, more in zip(map(base_spans, texts), field_spans(field, texts))]


def masked(docs: DataFrame, kind: str, rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """How well the field stands in for a pattern: trained without one kind on half of the texts, by hash, tried on the other half.

    Returns the number of values of that kind, how many the field finds (overlapping spans), texts, and false alarms: field
    spans that no pattern touches.
    """
    half = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2))
    field = docs.sparkSession.sparkContext.broadcast(fit(docs.where(half == 0), rows, kinds=tuple(k for k in BASE if k != kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 2):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            total = caught = false = 0
            for text, own in zip(texts, field_spans(field.value, texts)):
                wanted = sorted((a, 0, b) for a, b in values(text, (kind,)))
                total += len(wanted)
                caught += len(wanted) - len(beyond(wanted, own))
                false += len(beyond(own, base_spans(text)))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (total, caught, len(texts), false)], names=names)

    names = ["secrets", "found", "texts", "false_alarms"]
    counted = docs.where(half == 1).select("text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    return {n: v or 0 for n, v in counted.agg(*(F.sum(n).alias(n) for n in names)).first().asDict().items()}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the patterns' spans), spans (all), field_spans (the field's own)."""
    field = field or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 2):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = field_spans(shared.value, texts)
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(BASE))),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                    pa.array([joined(sorted([*b, *beyond(o, b)])) for b, o in zip(base, own)], pa.string()),
                    pa.array([joined(o) for o in own], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "field_spans"],
            )

    counts = "".join(f"n_{k} bigint, " for k in BASE)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}base_sha256 string, spans string, field_spans string")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
