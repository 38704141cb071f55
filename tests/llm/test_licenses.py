import re
from collections import Counter

from llm_documents import write_documents

from gridloom.llm import license_rules as L

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text):
    """(n_words, base places, labels, score) by regular expressions."""
    words = re.findall(WORD, (text or "").lower())
    line = " " + " ".join(words) + " "
    base = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for r in L.rules():
        if r["keyword"] in line and any(g in line for g in L.GATES):
            for m in re.finditer(f" (?:{r['pattern']})(?= )", line):
                at = line[: m.start()].count(" ")
                found.append((at, at + m[0].count(" "), r["priority"], r["rule"], r["label"]))
    kept = []
    for d in found:
        over = [e for e in found if e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))]
        if not over:
            kept.append(d)
    worth = [L.WORTH[1]] * len(base) + [L.WORTH[d[2]] for d in kept]
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {d[4] for d in kept})), max(worth, default=0.0)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: GPL-3.0-or-later", "MIT License MIT license mit LICENSE", "GNU Lesser General Public License version 2.1",
    "the BSD 3-Clause License; 3 clause BSD license", "mit\nlicense", "mit-license", "mitlicense", "submit license", "mit licenses", "general  public\tlicense", "GENERAL PUBLIC LICENSE general public license",
    "Creative Commons Attribution ShareAlike License 4.0. Copyright (c) 2020 2021. All rights reserved.", "no words about it", "", None, "license", "Ä MIT License Ö", "Mozilla Public License 2.0 0", "mit license " * 300,
]


def test_rules_are_hundreds():
    assert len(L.rules()) > 500 and len(L.SIGNATURES) + len(L.NOTICES) > 130
    assert all(re.compile(r["pattern"]) for r in L.rules())
    assert len({r["pattern"] for r in L.rules()}) > 0.95 * len(L.rules())


def test_by_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    path = write_documents(spark, tmp_path, rows)
    got = {r[0]: tuple(r)[1:] for r in L.op10_license_scan(spark, path).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == brute(text), text


def test_contract_on_edge_cases(spark, edge_dir, edge_rows):
    got = Counter(map(tuple, L.op10_license_scan(spark, edge_dir).collect()))
    assert got == Counter((i, *brute(t)) for i, t, *_ in edge_rows)


def test_no_python_in_the_plan(spark, edge_dir):
    plan = L.op10_license_scan(spark, edge_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_empty(spark, empty_dir):
    assert L.op10_license_scan(spark, empty_dir).count() == 0


def examples(tree):
    """A string for each way through a parsed regex."""
    out = [""]
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                ways = [chr(arg)]
            case "IN":
                ways = ["x"] if str(arg[0][0]) == "NEGATE" else [chr(x if str(o) == "LITERAL" else x[0]) for o, x in arg]
            case "SUBPATTERN":
                ways = examples(arg[3])
            case "BRANCH":
                ways = [x for t in arg[1] for x in examples(t)]
            case "MAX_REPEAT":
                ways = [x * n for n in {arg[0], max(arg[0], 1)} for x in examples(arg[2])]
            case "NOT_LITERAL":
                ways = ["x"]
            case "ASSERT" | "ASSERT_NOT":
                ways = [""]
        out = [x + y for x in out for y in dict.fromkeys(ways)]
    return out


def test_every_way_through_a_rule_holds_its_keyword_and_a_gate():
    from re import _parser

    for r in L.rules():
        for text in examples(_parser.parse(r["pattern"])):
            line = f" {text} "
            assert re.search(f" (?:{r['pattern']})(?= )", line), (r, line)
            assert r["keyword"] in line and any(g in line for g in L.GATES), (r, line)


def test_labels_need_no_other_words(spark, tmp_path):
    texts = {"released under the GPL": "licensed-under", "distributed under Apache 2.0": "licensed-under", "Zero-Clause BSD License": "0bsd"}
    path = write_documents(spark, tmp_path, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert [r.labels for r in sorted(L.op10_license_scan(spark, path).collect())] == list(texts.values())


BODIES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED",
    "bsd,bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS""",
    "gpl-3.0-or-later": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-or-later": "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-sa": "see https://creativecommons.org/licenses/by-nc-sa/4.0/ there",
    "spdx": "SPDX-License-Identifier: foo OR bar-1.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://here",
}


def test_bodies_of_licenses(spark, tmp_path):
    path = write_documents(spark, tmp_path, [(i, t, "en", "a") for i, t in enumerate(BODIES.values())])
    got = sorted(L.op10_license_scan(spark, path).collect())
    for r, (labels, text) in zip(got, BODIES.items()):
        assert tuple(r)[1:] == brute(text), text
        assert set(labels.split(",")) <= set(r.labels.split(",")), (labels, r.labels)
    by = dict(zip(BODIES, (r.labels for r in got)))
    assert by["isc"] == "isc" and by["0bsd"] == "0bsd"


def test_many_matches_take_linear_time(spark, tmp_path):
    import time

    times = []
    for n in (12_500, 50_000):
        path = write_documents(spark, tmp_path / str(n), [(1, "mit license " * n, "en", "a")], extra=False)
        began = time.time()
        (row,) = L.op10_license_scan(spark, path).collect()
        times.append(time.time() - began)
        assert (row.n_words, row.n_base, row.last_word, row.labels) == (2 * n, n, 2 * n - 2, "mit")
    assert times[1] < 30 and times[1] < 12 * times[0]
