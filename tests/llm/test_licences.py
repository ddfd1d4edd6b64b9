import math
import re
from collections import Counter

from tests.llm.conftest import ODD
from trialstats.llm import licences


def tokens(text):
    out = []
    for w in re.findall(r"[^ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        if len(w.encode()) > 1 and w[-1] in ".,;:!?\"'()[]":
            w = w[:-1]
        if len(w.encode()) > 1 and w[0] in ".,;:!?\"'()[]":
            w = w[1:]
        out.append(w)
    return out


def brute(files):
    """Cosines without hashing; files are (doc_id, path, text)"""
    df = Counter(w for _, _, t in files for w in set(tokens(t)))
    idf = lambda w: math.log((1 + len(files)) / (1 + df[w])) + 1

    def vector(words):
        v = {w: n * idf(w) for w, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    templates = [(name, vector(tokens(t))) for name, t in licences.TEMPLATES]

    def best(words):
        v = vector(words) if words else {}
        found = [sum(x * t.get(w, 0) for w, x in v.items()) for _, t in templates]
        return max(found), found.index(max(found))

    seen = {}
    for i, path, text in files:
        seen[i] = path, max((best(tokens(x)) for x in (text or "").split("\n")), key=lambda b: (b[0], -b[1])), best(tokens(text))
    folder = lambda p: p.rpartition("/")[0]
    given = {}
    for path, _, whole in seen.values():
        if whole[0] >= 0.5:
            given[folder(path)] = min(given.get(folder(path), (9,)), (-whole[0], path, whole[1]))
    out = {}
    for i, (path, line, whole) in seen.items():
        own = templates[line[1]][0] if line[0] >= 0.8 else templates[whole[1]][0] if whole[0] >= 0.5 else None
        up, source = folder(path), None
        while own is None:
            if up in given:
                source = up
                break
            if not up:
                break
            up = folder(up)
        out[i] = own, source, own or (templates[given[source][2]][0] if source is not None else None)
    return out


def test_against_definition(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    files = [(i, "/".join(["root", str(i % 3), str(i % 7), f"f{i}"][i % 2 :]), t) for i, t in rows]
    got = {r["doc_id"]: (r["own_licence"], r["inherited_from"], r["licence"]) for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == brute(files)
    assert {v[0] for v in got.values()} >= {"MIT"}


def test_nearest_folder(spark):
    files = [
        (1, "LICENSE", "Released under the MIT License."), (2, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c/d/x.py", "some code"),
        (4, "a/x.py", "other code"), (5, "a/b/c/y.py", "text\nLicensed under CC BY-NC 4.0.\n" + "many more other words that make this a source file and no notice " * 3), (6, None, "nothing"), (7, "a/b/c/d/x.py", None), (7, "a/b/c/d/x.py", None),
    ]
    got = {(r["doc_id"], r["own_licence"], r["inherited_from"], r["licence"]) for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {
        (1, "MIT", None, "MIT"), (2, "Apache-2.0", None, "Apache-2.0"), (3, None, "a/b", "Apache-2.0"), (4, None, "", "MIT"),
        (5, "CC-BY-NC-4.0", None, "CC-BY-NC-4.0"), (6, None, None, None), (7, None, "a/b", "Apache-2.0"),
    }


def test_odd_rows(make):
    from pyspark.sql import functions as F

    frame = make(ODD).withColumn("path", F.lit("a/b"))
    assert licences.scan(frame).count() == len(ODD)
    assert licences.scan(frame.limit(0)).collect() == []


def test_texts_headers_and_tags(spark):
    from trialstats.llm.notices import NOTICES, TEXTS

    notice, text = dict(NOTICES), dict(TEXTS)

    def comment(words, mark, width):
        w = words.split()
        return "\n".join(f"{mark} " + " ".join(w[k : k + width]) for k in range(0, len(w), width))

    code = "\n".join(f"value{k} = compute{k}(input{k}, {k})" for k in range(200))
    prose = "the work of the people and the house in which a copy of the part is kept by any person without charge or claim " * 20
    files = [
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + comment(notice["MIT"], "", 11)), ("a/src/x.py", code),
        ("b/COPYING", text["GPL-3.0"]), ("b/x.c", comment(notice["GPL-2.0"], " *", 9) + "\n" + code), ("b/y.c", code),
        ("c/LICENSE.txt", text["Apache-2.0"]), ("c/x.go", code), ("d/x.py", comment(notice["Apache-2.0"], "#", 7) + "\n" + code), ("d/y.py", code),
        ("e/x.rs", "// SPDX-License-Identifier: MPL-2.0\n" + code), ("e/y.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\n" + code), ("e/z.c", "// SPDX-License-Identifier: Unknown\n" + code),
        ("f/LICENSE", "Copyright (c) 2011, X Y\n" + comment(notice["BSD-3-Clause"], "", 10)), ("f/x", code), ("g/COPYING", text["LGPL-2.1"]), ("g/x", code), ("h/x.py", code + "\n" + comment(notice["AGPL-3.0"], "##", 8)),
        ("i/text", prose), ("i/x", code), ("j/LICENSE", text["MPL-2.0"]), ("k/LICENSE", text["CC0-1.0"]), ("l/LICENSE", text["LGPL-3.0"]), ("m/LICENSE", text["GPL-2.0"]),
    ]
    rows = [(k, p, t) for k, (p, t) in enumerate(files)] + [(100 + k, f"n/{k}", f"other words {k} " + " ".join(f"{a}{k}" for a in "abcdefgh")) for k in range(100)]
    got = {r["path"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = {
        "a/LICENSE": "MIT", "a/src/x.py": "MIT", "b/COPYING": "GPL-3.0", "b/x.c": "GPL-2.0", "b/y.c": "GPL-3.0", "c/LICENSE.txt": "Apache-2.0", "c/x.go": "Apache-2.0", "d/x.py": "Apache-2.0",
        "d/y.py": None, "e/x.rs": "MPL-2.0", "e/y.c": "GPL-2.0", "e/z.c": None, "f/LICENSE": "BSD-3-Clause", "f/x": "BSD-3-Clause", "g/COPYING": "LGPL-2.1", "g/x": "LGPL-2.1", "h/x.py": "AGPL-3.0",
        "i/text": None, "i/x": None, "j/LICENSE": "MPL-2.0", "k/LICENSE": "CC0-1.0", "l/LICENSE": "LGPL-3.0", "m/LICENSE": "GPL-2.0",
    }
    assert {p: got[p]["licence"] for p in want} == want
    assert {p for p in got if got[p]["licence_file"]} == {p for p in want if "LICENSE" in p or "COPYING" in p}
    assert all(got[f"n/{k}"]["licence"] is None for k in range(100))
