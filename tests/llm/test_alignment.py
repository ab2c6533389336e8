from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracewell.llm import alignment as L
from tracewell.llm.text import importable


@pytest.fixture(scope="module")
def sides():
    """Ids and byte ends of a text by the libraries' own tokenizers; None where the bytes differ."""
    a, b = Tokenizer.from_file(L.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=L.PIECE_BPE)
    a.encode_special_tokens = True
    back = L._byte_alphabet()

    def run(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        want = (" " + text).encode()
        if b"".join(left) != want or b"".join(right) != want:
            return None
        return [(i, e) for i, e in zip(x, np.cumsum(list(map(len, left))).tolist())], [(i, e) for i, e in zip(y, np.cumsum(list(map(len, right))).tolist())]

    return run


def brute(texts, sides):
    """Per text: groups as lists of ids, one pass over the ends; then counts over all texts."""
    groups = []
    for text in texts:
        found = sides(text) if text else None
        own = []
        if found:
            common = sorted({e for _, e in found[0]} & {e for _, e in found[1]})
            at = 0
            for end in common:
                own.append(tuple([i for i, e in side if at < e <= end] for side in found))
                at = end
        groups.append(own)
    held = [Counter((x, y) for a, b in own for x in a for y in b) for own in groups]
    docs = Counter(p for c in held for p in c)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for own, c in zip(groups, held):
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append(
            (
                sum(len(a) for a, _ in own),
                sum(len(b) for _, b in own),
                len(own),
                sum(c.values()),
                sum(n for p, n in c.items() if docs[p] == best[p[0]]),
                sum(n * docs[p] for p, n in c.items()),
                hashlib.sha256(spelt.encode()).hexdigest() if own else "",
            )
        )
    return out


def made():
    rng = random.Random(5)
    words = "the of ation über naïve 中文 слово 12345 it's  x y <|endoftext|> <s> 🙂 \t\n C++ ﬁ don't".split(" ")
    texts = [None, "", " ", "  ", "a", "\n", "▁", "a▁b", "the the", "the the", "<0x41>", "▁ x", "x" * 700, " " * 90, "é" * 300]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(120)]
    texts += [" ".join(rng.choices(words, k=2500)), " ".join(rng.choices(["alpha", "be", "gammas"], k=3000)), " ".join(rng.choices(words, k=900)) + "▁"]
    return texts


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"chunk_bytes": 60, "part_chars": 150, "fan": 3}])
def test_equals_brute_force(spark, sides, limits):
    texts = made()
    importable(spark)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, segment string, row int").repartition(5)
    got = rows_of(L.measured(L.links(docs, L.shared(spark), **limits)))
    assert [got[i] for i in range(len(texts))] == brute(texts, sides)


def test_large_groups_and_many_segments(spark, sides, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_TOKENS", 200)
    texts = made()[:60]
    docs = importable(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = rows_of(L.measured(L.links(docs, L.shared(spark))))
    assert [got[i] for i in range(len(texts))] == brute(texts, sides)
    rng = np.random.default_rng(1)
    na, nb = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    a, b, row = rng.integers(0, 5, na.sum()), rng.integers(0, 5, nb.sum()), np.sort(rng.integers(0, 4, 40))
    small = [x.tolist() for x in L.pairs_of(a, b, na, nb, row)]
    monkeypatch.setattr(L, "GROUP_LINKS", 6)
    assert [x.tolist() for x in L.pairs_of(a, b, na, nb, row)] == small


def test_fragments_compose_in_any_order():
    """Associative, with an identity; the whole is what one pass gives."""
    rng = random.Random(2)
    tokens = L.Tokenizers(L.load())
    unit = " " + " ".join(rng.choices("naïve 中文 the ofation 12345 x".split(), k=200))
    whole = [f for _, f in L.fragments(tokens, unit, 0, 1 << 30)]
    parts = [f for _, f in L.fragments(tokens, unit, 0, 2)]
    same = lambda x, y: all((getattr(x, k) == getattr(y, k)).all() and len(getattr(x, k)) == len(getattr(y, k)) for k in ("a", "b", "na", "nb"))
    assert len(parts) > 100 and any(len(p.na) == 1 for p in parts) and same(L.compose(parts), whole[0])
    for _ in range(50):
        tree = list(parts)
        while len(tree) > 1:
            i = rng.randrange(len(tree) - 1)
            tree[i : i + 2] = [L.compose(tree[i : i + 2])]
        assert same(tree[0], whole[0])
    assert same(L.compose([L.EMPTY, *parts, L.EMPTY]), whole[0]) and same(L.compose([]), L.EMPTY)


def test_parts_are_cut_where_no_token_crosses(sides):
    text = "one two, three 4 five  six it's all\nwell über allen then"
    tokens = L.Tokenizers(L.load())
    cuts = [m.start() for m in L.SAFE.finditer(" " + text)]
    assert len(cuts) >= 4
    for c in cuts:
        left, right = (" " + text)[:c], (" " + text)[c:]
        a, b, good = tokens.tokens([left, right, " " + text])
        assert all(good) and [*a[0], *a[1]] == a[2].tolist() and [*b[0], *b[1]] == b[2].tolist()


def test_edges(spark):
    voc = L.shared(importable(spark))
    docs = spark.createDataFrame([(None, "the end"), (7, "the end"), (7, "the end"), (8, None)], "doc_id bigint, text string")
    out = sorted((r["doc_id"] or 0, r["n_a"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in L.measured(L.links(docs, voc)).collect())
    digest = out[0][-1]
    assert out == [(0, 2, 2, 2, 6, digest), (7, 2, 2, 2, 6, digest), (7, 2, 2, 2, 6, digest), (8, 0, 0, 0, 0, "")]
    assert L.measured(L.links(docs.limit(0), voc)).count() == 0
    plain = {r["doc_id"]: (r["a"], r["na"]) for r in L.align(docs.where("doc_id = 8 OR doc_id = 7").distinct(), voc).collect()}
    assert len(plain[7][0]) == sum(plain[7][1]) == 2 and plain[8] == ([], [])


def test_query(spark, sf, sides):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = rows_of(L.op13_alignment(importable(spark), sf))
    assert [got[r["doc_id"]] for r in docs] == brute([r["text"] for r in docs], sides)
