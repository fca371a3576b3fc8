import random
import re

from gaugeframe.llm import op4_license_scan as op


def norm(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def base(t):
    w = norm(t)
    found = []
    for phrase, label in op.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


TEXTS = [
    None, "", "?!", "MIT License", "the mit license mit license, MIT LICENSE; mit-license", "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License. All rights reserved.", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: BSD-3-Clause", "creative commons attribution 4.0 international", "nothing of the kind", "smit license apache licenses",
    " ".join(["word"] * 40_000) + " mit license", "general public license " * 300,
]


def test_base_equals_brute_force(documents):
    got = sorted(op.scan(documents(TEXTS)).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, TEXTS, strict=True):
        n, found = base(t)
        assert (r.n_words, sorted((b.start, b.label) for b in r.base)) == (n, found)


def labels(documents, text):
    r = op.scan(documents([text])).first()
    return {d.label for d in r.detections}


def test_rules_name_licenses(documents):
    assert labels(documents, TEXTS[5]) == {"apache-2.0"}
    assert labels(documents, TEXTS[7]) == {"gpl-3.0"}
    assert labels(documents, TEXTS[8]) == {"bsd-3-clause"}
    assert "cc-by-4.0" in labels(documents, TEXTS[9]) and labels(documents, TEXTS[10]) == set()


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"""


def test_published_texts_without_title(documents):
    assert labels(documents, MIT) == {"mit"}
    assert labels(documents, BSD) == {"bsd"}
    assert labels(documents, ISC) == labels(documents, ISC.replace("and/or", "and")) == {"isc"}
    assert labels(documents, ZERO_BSD) == set()


def test_containment_and_priority(documents):
    # the short gpl rule lies inside the versioned one
    r = op.scan(documents(["gnu general public license version 3"])).first()
    assert {d.label for d in r.detections} == {"gpl-3.0"}
    for a in r.detections:
        for b in r.detections:
            assert not (b.start <= a.start and a.end <= b.end and (b.end - b.start > a.end - a.start or b.rank < a.rank))


def settled(found):
    """Detections that no other one suppresses, each compared with each."""
    out = []
    for d in found:
        beaten = False
        for e in found:
            inside = e.start <= d.start and d.end <= e.end
            overlap = e.start < d.end and d.start < e.end
            beaten |= (inside and (e.end - e.start > d.end - d.start or e.rank < d.rank)) or (overlap and e.priority < d.priority)
        if not beaten:
            out.append((d.start, d.end, d.rank))
    return sorted(out)


DETECTION = "d array<struct<start:bigint,end:bigint,rank:int,priority:int,label:string,score:double>>"


def test_sweeps_settle_as_all_comparisons_do(spark):
    r = random.Random(3)
    cases = [[]]
    for n in (1, 2, 5, 40, 300):
        for _ in range(4):
            seen = {(a, a + r.randint(1, 9), k) for a, k in ((r.randrange(2 * n), r.randrange(600)) for _ in range(n))}
            cases.append([(a, b, k, k // 120, "x", 0.5) for a, b, k in seen])
    df = spark.createDataFrame([(c,) for c in cases], DETECTION)
    got = df.select("d", op.ordered(op.F.col("d")).alias("o")).select("d", op.settle("o").alias("s")).collect()
    assert len(got) == len(cases)
    for row in got:
        assert sorted((x.start, x.end, x.rank) for x in row.s) == settled(row.d)


def test_fifty_thousand_detections(documents):
    t = "released under the mit license. " * 25_000
    r = op.scan(documents([t])).select(op.F.size("base"), op.F.size("detections"), op.F.array_max(op.F.transform("detections", lambda d: d["end"]))).first()
    assert tuple(r) == (25_000, 25_000, 125_000)


def test_every_signature_finds_its_own_words(spark, documents):
    texts = [w.replace("*", "one two three").replace("publication|work|document", "work") for _, w, _, _ in op.SIGNATURES]
    got = op.scan(documents(texts)).select("doc_id", op.F.transform("detections", lambda d: d["label"]).alias("l")).collect()
    for r in got:
        family = op.SIGNATURES[r.doc_id][0].split("-")[0]
        assert any(x.split("-")[0] == family for x in r.l), (texts[r.doc_id], r.l)


def test_hundreds_of_rules_each_with_anchor():
    rules = op.rules()
    assert len(rules) >= 300 and [r["rank"] for r in rules] == list(range(len(rules)))
    assert all(a["priority"] <= b["priority"] for a, b in zip(rules, rules[1:], strict=False))
    for r in rules:
        re.compile(r["pattern"])
        assert any(a in r["pattern"].replace("licen[sc]e", "license").replace("(?:license|licence)", "license") for a in op.ANCHORS)


def test_repeats_and_empty_table(documents):
    twice = op.scan(documents(["mit license", "mit license"], [1, 1])).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert op.scan(documents([])).collect() == []
