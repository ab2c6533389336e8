from __future__ import annotations

import random
import textwrap
from collections import Counter

from tracewell.llm import licenses as L


def brute(text, threshold=L.THRESHOLD):
    """Every unit against every template, nothing pruned."""
    text = (text or "").encode()
    units = [(0, text.count(b"\n") + 1, L.COPYRIGHT.sub(b"", text))]
    if b"\n" in text:
        units += [(i, 1, x) for i, x in enumerate(text.split(b"\n"))]
    out = []
    for first, n, unit in units:
        own = L.bigrams(L.words(unit))
        best = None
        for name in sorted(L.TEMPLATES):
            bag = L.bigrams(L.words(L.COPYRIGHT.sub(b"", L.TEMPLATES[name].encode())))
            total = sum(own.values()) + sum(bag.values())
            dice = 2 * sum((own & bag).values()) / total if total else 0
            if dice >= threshold and (best is None or dice > best[1]):
                best = (name, dice, first, n)
        if best:
            out.append(best)
    return out


def test_equals_brute_force():
    rng = random.Random(4)
    scanner = L.Scanner(L.TEMPLATES, L.THRESHOLD)
    texts = ["", "\n\n", "license", "Released under the MIT Licence", "prose\nLicensed under CC BY-NC 4.0.\nprose", "Copyright (c) 2020 A\n" + L.TEMPLATES["MIT (text)"]]
    for template in L.TEMPLATES.values():
        words = template.split()
        for drop in (0.0, 0.02, 0.05, 0.2):
            kept = [w if rng.random() >= drop else rng.choice(["", "other", w + " " + w]) for w in words]
            texts.append(" ".join(kept))
            texts.append("some prose\n" + " ".join(kept) + "\nmore prose")
    found = 0
    for text in texts:
        got = scanner.scan(text.encode())
        assert got == brute(text), text
        found += bool(got)
    assert found > len(L.TEMPLATES) * 4


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in L.op3_license_scan(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == texts.keys() and any(r["license"] for r in rows.values())
    for i, text in texts.items():
        want = brute(text)
        assert [tuple(m) for m in rows[i]["matches"]] == want
        assert rows[i]["license"] == (min(want, key=lambda m: (-m[1], m[0]))[0] if want else None)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "word " * 200_000, None), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x")], "doc_id bigint, text string, license string")
    out = L.scan(docs).collect()
    assert sorted((r["doc_id"] or 0, r["license"] or "") for r in out) == [(0, ""), (1, ""), (2, ""), (3, "MIT"), (3, "MIT")]
    assert L.scan(docs.limit(0)).count() == 0

def every_window(found, bag, threshold=L.THRESHOLD):
    """Most similar window of the words, all beginnings and ends measured."""
    size, best = sum(bag.values()), 0.0
    pairs = list(zip(found, found[1:]))
    for a in range(len(pairs)):
        own, shared = Counter(), 0
        for b in range(a, len(pairs)):
            own[pairs[b]] += 1
            shared += own[pairs[b]] <= bag[pairs[b]]
            best = max(best, 2 * shared / (b - a + 1 + size))
    return best


def test_wrapped_and_embedded_texts():
    scanner = L.Scanner(L.TEMPLATES, L.THRESHOLD)
    prose = "some prose of the day and for any person to read with the rest " * 6
    for name in ("MIT (text)", "BSD-2-Clause", "Apache-2.0 (header)", "GPL-3.0 (header)", "ISC"):
        wrapped = textwrap.wrap(L.TEMPLATES[name], 80)
        for mark in ("", "# "):
            text = "\n".join([*textwrap.wrap(prose, 80), *(mark + x for x in wrapped), *textwrap.wrap(prose, 80)])
            assert scanner.scan(text.encode()) == []
            assert [(m[0], m[3]) for m in scanner.find(text.encode()) if m[0] == name and m[1] > 0.97], (name, scanner.find(text.encode()))
    assert scanner.find(b"prose. Released under the MIT License. prose\nnext") == [("MIT", 1.0, 0, 1)]
    assert scanner.find(b"prose\nReleased under\nthe MIT License. prose") == [("MIT", 1.0, 1, 2)]
    assert scanner.find(b"prose\nCopyright 2020 A. Released under the MIT License.\n") == [("MIT", 1.0, 1, 1)]
    inside = L.TEMPLATES["MIT (text)"].replace("subject to", "Licensed under CC BY-NC 4.0. subject to")
    assert {m[0] for m in scanner.find(("x " * 90 + inside + " x" * 90).encode())} == {"MIT (text)", "CC-BY-NC-4.0"}
    twice = "\n".join(["intro", L.TEMPLATES["ISC"].replace(". ", ".\n"), "between " * 40, L.TEMPLATES["ISC"].replace(". ", ".\n")])
    assert [m[0] for m in scanner.find(twice.encode())] == ["ISC", "ISC"]


def test_windows_equal_all_windows():
    rng = random.Random(5)
    scanner = L.Scanner(L.TEMPLATES, L.THRESHOLD)
    found = 0
    some = list(L.TEMPLATES.items())[::3]
    for name, text in some:
        for drop in (0.0, 0.04):
            kept = [w if rng.random() >= drop else rng.choice(["", "other", w + " " + w]) for w in text.split()]
            stream = L.words(" ".join(["of the one"] * 3 + kept + ["and the software"] * 3).encode())
            got = {}
            for _, dice, k, first, n, _ in scanner.windows(stream):
                got[k] = max(got.get(k, 0), dice)
            for k, (_, bag) in enumerate(scanner.templates):
                best = every_window(stream, bag)
                assert got.get(k, 0) == (best if best >= L.THRESHOLD else 0)
            found += bool(got)
    assert found > len(some)


def test_passages_reach_the_table(spark):
    docs = spark.createDataFrame([(1, "prose. Released under the MIT License. prose"), (2, "prose")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert rows[1]["license"] == "MIT" and rows[1]["matches"][0]["n_lines"] == 1 and rows[2]["license"] is None


def test_siblings_are_told_apart(spark):
    scanner = L.Scanner(L.TEMPLATES | L.full_texts(), L.THRESHOLD)
    prose = "some prose of the day and for any person to read with the rest " * 12
    for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0 (header)", "GPL-2.0 (header, by post)", "GPL-3.0 (header)", "LGPL-2.1 (header)", "LGPL-3.0 (header)", "AGPL-3.0 (header)", "MPL-2.0 (notice)", "CC0-1.0 (notice)"):
        for text in (L.TEMPLATES[name], prose + "\n".join(textwrap.wrap(L.TEMPLATES[name], 70)) + prose):
            assert {m[0] for m in scanner.find(text.encode())} == {name}
    for name, text in L.full_texts().items():
        got = {m[0]: m[1] for m in scanner.find((prose + text + prose).encode())}
        assert name in got and not {n for n in got if n.endswith("(full text)")} - {name}, got
    # no template of their own: left unnamed, not named after a sibling
    others = [
        L.TEMPLATES["GPL-3.0 (header)"].replace("version 3", "version 4"),
        L.TEMPLATES["GPL-3.0"].replace("version 3", "version 1"),
        L.TEMPLATES["Apache-2.0 (header)"].replace("Apache License", "Educational Community License"),
        L.TEMPLATES["MIT (text)"].replace("subject to the\nfollowing conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ""),
        L.TEMPLATES["ISC"].replace("provided\nthat the above copyright notice and this permission notice appear in all copies", ""),
        L.full_texts()["GPL-3.0 (full text)"].replace("Use with the GNU Affero General Public License", "Remote Network Interaction"),
    ]
    for text in others:
        assert text not in (*L.TEMPLATES.values(), *L.full_texts().values())
        assert scanner.scan(text.encode()) and scanner.find(text.encode()) == [], text[:60]
    docs = spark.createDataFrame([(1, L.full_texts()["Apache-2.0 (full text)"])], "doc_id bigint, text string")
    assert L.scan(docs).first()["license"] == "Apache-2.0 (full text)"
