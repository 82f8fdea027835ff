import math
import random

import pytest
from pyspark.sql import functions as F

from coeval.llm.licences import TEMPLATES, THRESHOLD, _tokens, inverse_frequency, necessary_tokens, scan_licences, unseen_frequency


def cosine(text, template):
    idf, other = inverse_frequency(TEMPLATES), unseen_frequency(TEMPLATES)
    a, b = ({t: n * idf.get(t, other) for t, n in _tokens(x).items()} for x in (text, template))
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return round(sum(a.get(t, 0) * x for t, x in b.items()) / (size(a) * size(b)), 6) if a else 0.0


def best(segments):
    found = [(-cosine(s, t), name) for s in segments for name, t in TEMPLATES.items()]
    found = [x for x in found if -x[0] >= THRESHOLD]
    return (min(found)[1], -min(found)[0]) if found else (None, None)


def brute(rows, named):
    own, givers = {}, {}
    for path, text in rows:
        lines = text.split("\n") if text is not None else []
        segments = lines + ([text] if text is not None and named and path and is_licence_file(path) else [])
        own[(path, text)] = best(segments)
        name, score = own[(path, text)]
        if name and path is not None and (not named or is_licence_file(path)):
            folder = path.rpartition("/")[0]
            givers.setdefault(folder, []).append((-score, path, name))
    out = []
    for path, text in rows:
        name, score = own[(path, text)]
        if name or path is None:
            out.append((path, text is None, name, score, "own" if name else None, None))
            continue
        folder, given = path.rpartition("/")[0], None
        while True:
            if folder in givers:
                given = min(givers[folder])
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        out.append((path, text is None, given and given[2], None, given and "inherited", given and given[1]))
    return sorted(out, key=str)


def is_licence_file(path):
    import re

    return re.search(r"(^|/)(?i:LICEN[SC]E|COPYING|NOTICE)([.-][^/]*)?$", path) is not None


def found(spark, rows, named):
    df = spark.createDataFrame(rows, "path string, text string").withColumn("segment", F.lit(1)).withColumn("licence_", F.lit("x")).withColumn("gone", F.col("text").isNull()).repartition(3)
    got = scan_licences(df, speaks=None if named else F.lit(True))
    return sorted(((r["path"], r["gone"], r["licence"], r["score"], r["origin"], r["given_by"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("named", [True, False])
def test_matches_brute_force(spark, named):
    rng = random.Random(3)
    statements = list(TEMPLATES.values()) + ["Licensed under the Apache License", "// released under the mit license!", "some other license", "Licensed under the \u212aApache License, Version 2.0\u0130", "mit mit mit mit license license", "free text", "license", ""]
    folders = ["", "a", "a/b", "a/b/c", "a/x", "d", "d/e/f/g"]
    rows = []
    for i in range(90):
        folder = rng.choice(folders)
        name = rng.choice(["LICENSE", "COPYING.txt", f"f{i}.py", f"g{i}", f"h{i}", f"licence-{i}"])
        lines = [" ".join(rng.choice("lorem ipsum dolor license work".split()) for _ in range(4)) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(statements))
        rows.append((f"{folder}/{name}".lstrip("/"), "\n".join(lines)))
    rows += [("a/null", None), (None, "Released under the MIT License."), (None, None), ("a/empty", ""), rows[0], ("/abs/LICENSE", "Released under the ISC License."), ("/abs/q/w", "x")]
    assert found(spark, rows, named) == brute(rows, named)


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "x"), ("c/y", None)], "path string, text string")
    names = ["given", "own_licence", "own_score", "licence", "origin", "row", "folder", "segment", "p", "dir", "speaks"]
    got = scan_licences(df.withColumns({n: F.lit(f"<{n}>") for n in names}))
    assert sorted(got.columns) == sorted({*names, "path", "licence", "score", "origin", "given_by"})
    rows = {r["path"]: r for r in got.collect()}
    assert {p: (r["licence"], r["origin"]) for p, r in rows.items()} == {"a/LICENSE": ("MIT", "own"), "a/b/x.py": ("MIT", "inherited"), "c/y": (None, None)}
    assert all(r[n] == f"<{n}>" for r in rows.values() for n in names if n not in ("licence", "origin"))


def test_necessary_tokens_are_necessary():
    need = set(necessary_tokens(TEMPLATES, THRESHOLD))
    for text in TEMPLATES.values():
        words = [t for t in _tokens(text) if t not in need]
        assert max([cosine(" ".join(words), t) for t in TEMPLATES.values()] if words else [0]) < THRESHOLD


def test_empty_table(spark):
    assert scan_licences(spark.createDataFrame([], "path string, text string")).collect() == []


@pytest.mark.parametrize("named", [True, False])
def test_notices_texts_and_spdx_lines(spark, named):
    from coeval.llm.notices import NOTICES

    code = "\n\nimport os\n" + "\n".join(f"value{i} = compute{i}(argument{i}, other{i})" for i in range(300))
    comment = lambda text: "".join(f"# {' '.join(text.split()[i : i + 9])}\n" for i in range(0, len(text.split()), 9))
    rows, want = [], {}
    for name, text in NOTICES.items():
        licence, kind = name.split("/")
        path = f"{name.replace('/', '-')}/"
        want[path + "LICENSE"] = licence
        rows.append((path + "LICENSE", f"Copyright (c) 2020 Some Body\n\n{text}"))
        if len(text) < 3000:
            want[f"h/{path}head.py"] = licence
            rows.append((f"h/{path}head.py", comment("Copyright (c) 2020 Some Body " + text) + code))
    for licence in TEMPLATES:
        for end in ("", "-or-later"):
            want[f"s{end}/{licence}/x.c"] = licence
            rows.append((f"s{end}/{licence}/x.c", f"// SPDX-License-Identifier: {licence}{end}" + code))
    for i, ids in enumerate(["Zlib", "GPL-1.0-only", "LGPL-2.1+", "Zlib WITH MIT"]):
        want[f"no/{i}/x.c"] = None
        rows.append((f"no/{i}/x.c", f"// SPDX-License-Identifier: {ids}" + code))
    rows += [("w/x.c", "spdx-license-identifier: (Zlib OR ISC)" + code), ("plain/x.c", code), ("stop/x.c", "the the of the to or and " * 90)]
    want |= {"w/x.c": "ISC", "plain/x.c": None, "stop/x.c": None}
    got = {path: (licence, origin) for path, _, licence, _, origin, _ in found(spark, rows, named)}
    assert got == {p: (x, x and "own") for p, x in want.items()}
