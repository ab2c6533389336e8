from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
from types import SimpleNamespace

import numpy as np

from tracewell.llm import secret_scan as S


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_equals_patterns():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "ſecret", "toKen", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef" * 4, "é", "\n", "x", "longvalue_1"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert S.base_spans(text) == brute(text), text


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        field = S.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
        scores = rng.normal(size=(n, 3)) * 4
        scores[rng.random(n) < 0.4, 0] += 30
        fresh = rng.random(n) < 0.3
        fresh[0] = True

        def value(path):
            return sum(scores[t, y] + (field.first[y] if fresh[t] else field.moves[path[t - 1], y]) for t, y in enumerate(path))

        best = max(itertools.product(range(3), repeat=n), key=value)
        assert np.isclose(value(tuple(S.decode(field, scores, fresh))), value(best))


def test_likelihood_and_gradient():
    """Against the sum over all label paths, and finite differences."""
    rng = np.random.default_rng(4)
    real = np.array([[1, 1, 1, 1], [1, 1, 1, 0], [1, 0, 0, 0]], bool)
    labels, x = rng.integers(0, 3, real.shape), rng.integers(0, 6, (*real.shape, 2))
    field = S.Field(rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))

    def value():
        total = 0.0
        for i, n in enumerate(real.sum(1)):
            def score(path):
                own = sum(field.weights[f, y] for t, y in enumerate(path) for f in x[i, t])
                return own + field.first[path[0]] + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

            total += score(labels[i, :n]) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=int(n))))
        return total

    found, grads = S.gradient(field, x, labels, real)
    assert np.isclose(found, value())
    for p, g in zip((field.weights, field.moves, field.first), grads):
        for at in np.ndindex(p.shape):
            p[at] += 1e-5
            up = value()
            p[at] -= 2e-5
            down = value()
            p[at] += 1e-5
            assert np.isclose((up - down) / 2e-5, g[at], atol=1e-5)


def test_spans_beyond_others():
    rng = random.Random(2)
    for _ in range(500):
        cuts = sorted(rng.sample(range(60), 8))
        own = [(a, 3, b) for a, b in zip(cuts[::2], cuts[1::2])]
        base = sorted((a, 0, a + rng.randrange(1, 15)) for a in rng.choices(range(60), k=rng.randrange(5)))
        assert S.beyond(own, base) == [x for x in own if not any(a < x[2] and x[0] < b for a, _, b in base)]


def test_pieces_hold_whole_lines():
    assert S._whole("half\none\ntwo\nha", True, True) == "one\ntwo" and S._whole("a b c", True, False) == "b c" and S._whole("x\ny", False, False) == "x\ny"


def test_many_secrets_in_one_text():
    """Time grows with the text, not with the square of its secrets."""
    rng = random.Random(8)
    texts = ["\n".join(f'é token = "{rng.getrandbits(160):040x}"' for _ in range(4)) for _ in range(200)]
    tokens = S.tokenize([t.encode() for t in texts])
    field = S.train(tokens, S.weak_labels(texts, tokens))
    dump = "\n".join(f'é token = "{rng.getrandbits(160):040x}" and "{rng.getrandbits(160):040x}"' for _ in range(8000))
    began = time.process_time()
    (spans,) = S.find(field, [dump])
    assert time.process_time() - began < 3
    assert sum(k == 2 for _, k, _ in spans) == 16_000 and len(S.field_spans(field, [dump])[0]) >= 8000
    labels = S.weak_labels([dump], S.tokenize([dump.encode()]))
    assert (labels > 0).sum() == 16_000


def test_masking_a_pattern(spark):
    """Without labels for hexadecimal runs, the field finds them by the company they keep."""
    rng = random.Random(9)
    prose = "the of and on in that was this with from here there plain word text line more".split()

    def doc(i):
        lines = [" ".join(rng.choices(prose, k=12)) for _ in range(5)]
        value = f"{rng.getrandbits(128):032x}" if i % 2 else "".join(rng.choices("ABCDEFGHKLMNPQRSTUVWXYZ23456789abcdefghkmnpqrstuvwxyz", k=24))
        lines.insert(rng.randrange(5), f'{rng.choice(["password", "token", "api_key"])} = "{value}"' if rng.random() < 0.7 else f'the key is "{value}"')
        return "\n".join(lines)

    docs = spark.createDataFrame([(i, doc(i)) for i in range(1200)], "doc_id bigint, text string")
    out = S.masked(docs, "hex")
    assert out["secrets"] > 150 and out["found"] >= 0.5 * out["secrets"]


def test_field_generalises():
    """Trained on one kind of value after some names, it finds others after the same names, and leaves prose alone."""
    rng = random.Random(6)
    prose = "the of and on in that was this with from here there plain word text line more".split()

    def line(secret=None):
        words = rng.choices(prose, k=12)
        if secret:
            words.insert(rng.randrange(12), secret)
        return " ".join(words)

    texts = ["\n".join(line() for _ in range(4)) + "\n" + line(f'token = "{rng.getrandbits(160):040x}"') for _ in range(300)]
    tokens = S.tokenize([t.encode() for t in texts])
    field = S.train(tokens, S.weak_labels(texts, tokens))
    value = f"{rng.getrandbits(100):025x}"
    text = "é " + line(f'"{value}"')
    (spans,) = S.find(field, [text])
    assert [(text[a:b], k) for a, k, b in spans] == [(value, 3)]
    assert S.find(field, [line(), "", "\n"]) == [[], [], []]


def test_query_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.op6_secrets(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(S.joined(want).encode()).hexdigest()
        assert set(filter(None, S.joined(want).split(","))) <= set(r["spans"].split(","))
        assert {x for x in r["spans"].split(",") if x.startswith("secret")} <= set(r["field_spans"].split(","))
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "token = abcdefgh " * 20000, 3), (2, "token = abcdefgh " * 20000, 3)], "doc_id bigint, text string, spans int")
    assert sorted((r["doc_id"] or 0, r["n_assign"]) for r in S.scan(odd).collect()) == [(0, 0), (1, 0), (2, 20000), (2, 20000)]
    assert S.scan(odd.limit(0)).count() == 0 and S.scan(odd.where("doc_id = 1")).count() == 1


def test_chains_of_a_sample_full_of_secrets():
    n = 3 * S.TRAIN_CHAINS
    tokens = SimpleNamespace(fresh=np.ones(n, bool), starts=np.arange(n))
    labels = np.zeros(n, np.int64)
    labels[: n - S.TRAIN_CHAINS] = 1
    picked = np.array([p[0] for p in S.chains(tokens, labels, np.random.default_rng(1))])
    assert len(picked) == S.TRAIN_CHAINS and (labels[picked] == 0).sum() == S.TRAIN_CHAINS * S.NO_SECRET
    assert (picked[labels[picked] == 1] >= S.TRAIN_CHAINS).any()  # not only the first ones
    labels[10:] = 0
    assert set(range(10)) <= {p[0] for p in S.chains(tokens, labels, np.random.default_rng(1))}
