r"""License scans: ordered signature rules behind keyword filters.

A text becomes words (A-Z lower-cased, class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``), each
between two spaces, so that every rule is a plain expression over whole words.
Rules are the sentences of license texts and notices below, one by one, and the
license names below in a few sentence forms, some hundreds in all.  A rule runs
on a text only if its keyword is in it, and only texts with one of the
``ANCHORS`` reach the rules at all.

Detections that overlap are settled by priority and containment: one inside a
longer one goes, of equal intervals the one with the better rank stays, and
one that overlaps another of a better priority goes.

DataFrame functions only.  A null text is empty; repeated rows are judged each
for itself; work on a very long text grows near linearly with its length and
with its number of detections, which are settled in one sweep each way.  Only
doc_id and text are read.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native_spans import find, running_max, running_min

#: Base phrases and labels, fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Every rule needs one of these (words between two spaces).
ANCHORS = ("licen", "spdx", "public  domain", "creative  commons", "copyleft", "rights  reserved", "redistribution  and  use", "permission  to  use  copy", "free  software", "unencumbered", "this  software", "advertising  materials",
           "copyright", "this  product  includes", "is  provided  as  is", "is  supplied  as  is", "possible  under  law", "with  this  file", "altered  source", "may  be  copied",
           "hosted  or  managed", "charityware", "copying  of  this  file", "prior  written  permission", "confidential  and  proprietary", "disclaims", "may  be  reproduced")

#: Known licenses: label, words of the identifier, names (words; "|" parts alternatives).
LICENSES = (
    ("mit", "mit", "mit|expat|mit x11"),
    ("mit-0", "mit 0", "mit no attribution|mit 0"),
    ("apache-2.0", "apache 2 0", "apache license version 2 0|apache license 2 0|apache 2 0|apache version 2 0|apache software license 2 0"),
    ("apache-1.1", "apache 1 1", "apache license version 1 1|apache software license version 1 1|apache 1 1"),
    ("gpl-3.0", "gpl 3 0", "gnu general public license version 3|general public license v3|gpl version 3|gplv3|gpl v3|gnu gpl v3"),
    ("gpl-2.0", "gpl 2 0", "gnu general public license version 2|general public license v2|gpl version 2|gplv2|gpl v2|gnu gpl v2"),
    ("lgpl-3.0", "lgpl 3 0", "gnu lesser general public license version 3|lgpl version 3|lgplv3|lgpl v3"),
    ("lgpl-2.1", "lgpl 2 1", "gnu lesser general public license version 2 1|lgpl version 2 1|lgplv2 1|lgpl v2 1"),
    ("agpl-3.0", "agpl 3 0", "gnu affero general public license version 3|affero general public license|agplv3|agpl v3"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause|simplified bsd|2 clause bsd|freebsd"),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause|new bsd|modified bsd|revised bsd|3 clause bsd"),
    ("bsd-4-clause", "bsd 4 clause", "bsd 4 clause|original bsd|4 clause bsd"),
    ("0bsd", "0bsd", "zero clause bsd|0bsd|bsd zero clause"),
    ("isc", "isc", "isc|internet systems consortium"),
    ("mpl-2.0", "mpl 2 0", "mozilla public license version 2 0|mozilla public license v 2 0|mpl 2 0|mplv2"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license version 1 1|mpl 1 1"),
    ("epl-2.0", "epl 2 0", "eclipse public license version 2 0|eclipse public license v 2 0|epl 2 0"),
    ("epl-1.0", "epl 1 0", "eclipse public license version 1 0|eclipse public license v1 0|epl 1 0"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license version 1 0|cddl 1 0|cddl"),
    ("cpl-1.0", "cpl 1 0", "common public license version 1 0|cpl 1 0"),
    ("artistic-2.0", "artistic 2 0", "artistic license 2 0|artistic 2 0|perl artistic"),
    ("artistic-1.0", "artistic 1 0", "artistic license 1 0|artistic 1 0"),
    ("bsl-1.0", "bsl 1 0", "boost software license version 1 0|boost software|boost 1 0"),
    ("busl-1.1", "busl 1 1", "business source license 1 1|business source"),
    ("zlib", "zlib", "zlib|zlib libpng"),
    ("libpng", "libpng", "libpng|png reference library"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public|wtfpl"),
    ("cc0-1.0", "cc0 1 0", "creative commons zero|cc0 1 0 universal|cc0"),
    ("cc-by-4.0", "cc by 4 0", "creative commons attribution 4 0|creative commons attribution 4 0 international|cc by 4 0"),
    ("cc-by-3.0", "cc by 3 0", "creative commons attribution 3 0|cc by 3 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "creative commons attribution sharealike 4 0|cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "creative commons attribution sharealike 3 0|cc by sa 3 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "creative commons attribution noncommercial 4 0|cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "creative commons attribution noderivatives 4 0|cc by nd 4 0"),
    ("ofl-1.1", "ofl 1 1", "sil open font license version 1 1|open font|ofl 1 1"),
    ("python-2.0", "python 2 0", "python software foundation|psf|python"),
    ("postgresql", "postgresql", "postgresql"),
    ("php-3.01", "php 3 01", "php license version 3 01|php 3 01|php"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl|ssleay"),
    ("ncsa", "ncsa", "university of illinois ncsa open source|ncsa"),
    ("eupl-1.2", "eupl 1 2", "european union public licence v 1 2|european union public|eupl 1 2"),
    ("ms-pl", "ms pl", "microsoft public|ms pl"),
    ("ms-rl", "ms rl", "microsoft reciprocal|ms rl"),
    ("osl-3.0", "osl 3 0", "open software license version 3 0|open software|osl 3 0"),
    ("afl-3.0", "afl 3 0", "academic free license version 3 0|academic free|afl 3 0"),
    ("odbl-1.0", "odbl 1 0", "open database license version 1 0|open database|odbl"),
    ("gfdl-1.3", "gfdl 1 3", "gnu free documentation license version 1 3|free documentation|gfdl"),
    ("mulan-2.0", "mulanpsl 2 0", "mulan permissive software license v2|mulan psl v2"),
    ("sspl-1.0", "sspl 1 0", "server side public license version 1|server side public|sspl"),
    ("elastic-2.0", "elastic 2 0", "elastic license 2 0|elastic"),
    ("upl-1.0", "upl 1 0", "universal permissive license version 1 0|universal permissive|upl 1 0"),
    ("vim", "vim", "vim"),
    ("w3c", "w3c", "w3c software notice and|w3c software"),
    ("x11", "x11", "x11|x consortium"),
)
_VERB = "(?: (?:licensed|released|distributed|available|provided|published|covered|governed) )(?: as )?(?: (?:under|by) )(?: (?:the|a|an) )?(?: terms  of  the )?(?: gnu )?"
#: Rules that no name yields: label, keyword, expression, priority, score.
OTHER = (
    ("public-domain", " public ", " (?:in|into|to|under)  the  public  domain ", 2, 0.8),
    ("public-domain", " public ", " dedicated  to  the  public  domain ", 1, 0.9),
    ("proprietary", " reserved ", " all  rights  reserved ", 3, 0.5),
    ("copyleft", " copyleft ", " copyleft ", 4, 0.4),
    ("gpl", " general ", " gnu  general  public  licen[sc]e ", 3, 0.7),
    ("lgpl", " lesser ", " gnu  lesser  general  public  licen[sc]e ", 3, 0.7),
    ("creative-commons", " commons ", " creative  commons  licen[sc]e ", 3, 0.5),
    ("gpl-3.0", " version ", " general  public  licen[sc]e  (?:as  published  by  the  free  software  foundation )?(?: either )?(?: version  3 )", 1, 0.95),
    ("gpl-2.0", " version ", " general  public  licen[sc]e  (?:as  published  by  the  free  software  foundation )?(?: either )?(?: version  2 )", 1, 0.95),
    ("mit", " charge ", " permission  is  hereby  granted  free  of  charge (?: [^ ]+ ){1,60}?(?: sublicense )", 0, 0.9),
    ("bsd", " redistribution ", " redistribution  and  use  in  source  and  binary  forms (?: [^ ]+ ){1,60}?(?: conditions  are  met )", 0, 0.8),
    ("isc", " purpose ", " permission  to  use  copy  modify  and (?: or )?(?: distribute )(?: [^ ]+ ){1,40}?(?: this  permission  notice  appear  in  all  copies )", 0, 0.8),
)


#: Sentences of license texts and notices: label, words, priority, score.  ``*`` stands
#: for up to 12 words, ``a|b`` for either word.  The keyword is the longest word.
SIGNATURES = (
    ("apache-2.0", "licensed under the apache license * you may not use this file except in compliance with the license", 0, 1.0),
    ("apache-2.0", "apache license version 2 0 january 2004", 0, 1.0),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0, 0.9),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", 0, 0.9),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0, 0.9),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", 0, 1.0),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", 0, 1.0),
    ("gpl-2.0", "gnu general public license version 2 june 1991", 0, 1.0),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", 0, 1.0),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", 1, 0.9),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", 1, 0.9),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3", 0, 1.0),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", 0, 1.0),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 0, 1.0),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", 1, 0.9),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3", 0, 1.0),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", 0, 1.0),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this program", 0, 0.95),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0, 1.0),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", 0, 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 0, 1.0),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", 0, 1.0),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0", 0, 1.0),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license", 1, 0.9),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 0, 1.0),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", 0, 0.95),
    ("bsd-3-clause", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software", 0, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 0, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0, 0.9),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 1, 0.7),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0, 0.9),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0, 0.95),
    ("libpng", "the png reference library is supplied as is", 0, 0.95),
    ("bsl-1.0", "obtaining a copy of the software and accompanying documentation covered by this license", 0, 0.95),
    ("bsl-1.0", "distributed under the boost software license version 1 0", 0, 1.0),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 0, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0, 1.0),
    ("wtfpl", "do what the fuck you want to public license", 0, 1.0),
    ("cc0-1.0", "to the extent possible under law * waived all copyright and related or neighboring rights", 0, 1.0),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", 0, 1.0),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", 0, 1.0),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", 0, 1.0),
    ("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", 0, 1.0),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 0, 1.0),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of license", 0, 0.95),
    ("python-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license", 0, 1.0),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0, 0.95),
    ("php-3.01", "this product includes php software freely available from", 0, 0.95),
    ("ruby", "ruby is copyrighted free software by yukihiro matsumoto", 0, 1.0),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 0, 1.0),
    ("ncsa", "redistributions in binary form must reproduce * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 1, 0.7),
    ("artistic-2.0", "the copyright holder intends that the package may be distributed * modified under the terms of the artistic license", 1, 0.8),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", 0, 0.95),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions", 0, 1.0),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 0, 0.9),
    ("osl-3.0", "licensed under the open software license version 3 0", 0, 1.0),
    ("afl-3.0", "licensed under the academic free license version 3 0", 0, 1.0),
    ("odbl-1.0", "made available under the open database license", 0, 1.0),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0, 1.0),
    ("mulan-2.0", "is licensed under mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2", 0, 1.0),
    ("sspl-1.0", "under the terms of the server side public license version 1", 0, 1.0),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", 0, 0.95),
    ("upl-1.0", "the universal permissive license upl version 1 0", 0, 1.0),
    ("vim", "vim is charityware you can use and copy it as much as you like", 0, 1.0),
    ("w3c", "this work is being provided by the copyright holders under the following license", 0, 0.8),
    ("x11", "except as contained in this notice the name of * shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 0, 0.95),
    ("public-domain", "the author disclaims copyright to this source code", 0, 0.9),
    ("public-domain", "has been placed in the public domain", 1, 0.8),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", 0, 0.95),
    ("proprietary", "this software is confidential and proprietary", 0, 0.9),
    ("proprietary", "no part of this publication|work|document may be reproduced", 1, 0.7),
    ("proprietary", "may not be copied distributed or modified without the prior written permission", 1, 0.7),
)


def _phrase(words: str) -> str:
    """Words as an expression over whole words; license is spelt either way."""
    return "".join(f" {w} " for w in words.split()).replace(" license ", " licen[sc]e ").replace(" licence ", " licen[sc]e ")


def _keyword(words: str) -> str:
    """The word of a name that the fewest texts hold: its longest, but for license."""
    fixed = [w for w, before, after in zip(words.split(), ["", *words.split()], [*words.split()[1:], ""], strict=False) if "|" not in (w, before, after)]
    own = [w for w in fixed if not w.startswith("licen")] or fixed
    return f" {max(own, key=len)} "


def _sentence(words: str) -> str:
    """A sentence of ``SIGNATURES`` as an expression over whole words."""
    parts = [f"(?: (?:{w}) )" if "|" in w else _phrase(w) for w in words.split() if w != "*"]
    out, at = "", iter(parts)
    for w in words.split():
        out += "(?: [^ ]+ ){1,12}?" if w == "*" else next(at)
    return out


def rules() -> list[dict]:
    """All rules, in order of rank: label, keyword, expression, priority, score."""
    out = []
    for label, spdx, names in LICENSES:
        out.append((0, 1.0, label, _keyword(spdx), f" spdx  license  identifier {_phrase(spdx)}"))
        for name in names.split("|"):
            own = _phrase(name)
            ends = "licen" in name or name.startswith(("creative", "unlicense"))
            tail = "(?: licen[sc]e )?" if ends else "(?: licen[sc]e )"
            out.append((1, 0.95, label, _keyword(name), f"{_VERB}{own}{tail}"))
            out.append((2, 0.8, label, _keyword(name), f"(?: (?:license|licence) )(?: is )?(?: (?:the|a|an) )?{own}"))
            out.append((3, 0.6, label, _keyword(name), f"{own}{tail}"))
    out += [(p, s, label, k, x) for label, k, x, p, s in OTHER]
    out += [(p, s, label, _keyword(words.replace("*", "").replace("|", " | ")), _sentence(words)) for label, words, p, s in SIGNATURES]
    out.sort(key=lambda r: r[0])
    return [{"rank": i, "priority": p, "score": s, "label": label, "keyword": k, "pattern": x} for i, (p, s, label, k, x) in enumerate(out)]


_RULE = "array<struct<rank:int,priority:int,score:double,label:string,keyword:string,pattern:string>>"


def spaced(text: Column) -> Column:
    """The words of a text, each between two spaces; empty without words."""
    words = F.trim(F.regexp_replace(common.lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words(c: Column) -> Column:
    """Words of a stretch of spaced text."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")


def _base(norm: Column) -> Column:
    def places(phrase: str, label: str) -> Column:
        words = "".join(f" {w} " for w in phrase.split())
        return F.transform(find(norm, words, measure=_words), lambda s: F.struct(s["start"].alias("start"), F.lit(label).alias("label")))

    return F.concat(*[places(*b) for b in BASE])


def _detections(norm: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(rules())), _RULE)
    fit = F.filter(table, lambda r: F.contains(norm, r["keyword"]))

    def run(r: Column) -> Column:
        return F.transform(
            find(norm, r["pattern"], measure=_words),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["rank"].alias("rank"), r["priority"].alias("priority"), r["label"].alias("label"), r["score"].alias("score")),
        )

    return F.flatten(F.transform(fit, run))


_PRIORITIES = sorted({p for *_, p, _ in SIGNATURES} | {0, 1, 2, 3} | {r[3] for r in OTHER})


def ordered(found: Column) -> Column:
    """Detections by start, longer ones first, then by rank."""
    return F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["rank"].alias("rank"), d["end"].alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["score"].alias("score"))))


def _sweeps(found: Column) -> dict[str, Column]:
    """For sorted detections: how far those before each reach, and, by priority, how far the better ones around it do.

    One that contains another stands before it; so does a better rank of the
    same interval.  Of those that overlap, some start before and some behind.
    """
    shifted = lambda x: F.concat(F.array(F.lit(-1).cast("long")), x)
    out = {"reach": shifted(running_max(F.transform(found, lambda d: d["end"])))}
    up_to = lambda p, field, other: lambda d: F.when(d["priority"] <= p, d[field]).otherwise(F.lit(other).cast("long"))
    for p in _PRIORITIES[:-1]:
        out[f"to{p}"] = running_max(F.transform(found, up_to(p, "end", -1)))
        out[f"from{p}"] = F.reverse(running_min(F.transform(F.reverse(found), up_to(p, "start", 1 << 62))))
    return out


def settle(found: str) -> Column:
    """Of the sorted detections in ``found`` those that no other one suppresses: one sweep each way."""
    beaten = F.transform(
        F.arrays_zip(F.col(found).alias("d"), *[x.alias(k) for k, x in _sweeps(F.col(found)).items()]),
        lambda x: F.when(x["d"].isNull(), True)
        .when(x["reach"] >= x["d"]["end"], True)
        .otherwise(
            reduce(
                or_,
                [(x["d"]["priority"] > p) & ((x[f"to{p}"] > x["d"]["start"]) | (x[f"from{p}"] < x["d"]["end"])) for p in _PRIORITIES[:-1]],
            )
        ),
    )
    kept = F.filter(F.zip_with(found, F.slice(beaten, F.lit(1), F.size(found)), lambda d, b: F.struct(d.alias("d"), b.alias("b"))), lambda x: ~x["b"])
    return F.transform(kept, lambda x: F.struct(*[x["d"][c].alias(c) for c in ("start", "end", "rank", "priority", "label", "score")]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``base`` places (start, label) and settled ``detections`` of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__n"))
    hit = None
    for a in ANCHORS:
        c = F.contains(F.col("__n"), F.lit(a))
        hit = c if hit is None else hit | c
    rows = rows.select("doc_id", _words(F.col("__n")).alias("n_words"), F.when(hit, F.col("__n")).alias("__n"))
    none = lambda kind: F.array().cast(kind)
    place, detection = "array<struct<start:bigint,label:string>>", "array<struct<start:bigint,end:bigint,rank:int,priority:int,label:string,score:double>>"
    some = F.col("__n").isNotNull()
    rows = rows.withColumns({"base": F.when(some, _base(F.col("__n"))).otherwise(none(place)), "__d": F.when(some, _detections(F.col("__n"))).otherwise(none(detection))})
    rows = rows.select("doc_id", "n_words", "base", ordered(F.col("__d")).alias("__d"))
    return rows.select("doc_id", "n_words", "base", settle("__d").alias("detections"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every whole text of documents."""
    found = scan(common.table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    labels = F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))
    score = F.array_max(F.concat(F.transform("detections", lambda d: d["score"]), F.array(F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        score.alias("score"),
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({r['rank']}, {r['priority']}, {r['score']}, {quote(r['label'])}, {quote(r['keyword'])}, {quote(r['pattern'])})" for r in rules())
    base = ",\n".join(f"({quote(label)}, {quote(_phrase(p).replace('licen[sc]e', 'license'))})" for p, label in BASE)
    count = lambda x: f"CAST((length({x}) - length(replace({x}, ' ', ''))) // 2 AS BIGINT)"
    anchor = " OR ".join(f"contains(n, {quote(a)})" for a in ANCHORS)

    def places(source: str, columns: str) -> str:
        return f"""SELECT k, {columns}, start, start + {count("m[i]")} AS "end" FROM (
  SELECT k, {columns}, m, i, CAST(list_sum(list_transform(gap[1:i], lambda x: {count("x")})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {count("x")})), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT k, {columns}, regexp_extract_all(n, pattern) AS m, string_split_regex(n, pattern) AS gap FROM {source}) WHERE len(m) > 0))"""

    return f"""
WITH rules(rank, priority, score, label, keyword, pattern) AS (VALUES {values}),
phrases(label, pattern) AS (VALUES {base}),
t AS (SELECT row_number() OVER () AS k, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS w FROM documents),
d AS (SELECT k, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS n FROM t),
g AS (SELECT * FROM d WHERE {anchor}),
gp AS (SELECT g.k, g.n, phrases.* FROM g, phrases),
gr AS (SELECT g.k, g.n, rules.* FROM g, rules WHERE contains(g.n, keyword)),
b AS ({places("gp", "label")}),
f AS ({places("gr", "rank, priority, score, label")}),
s AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.k = x.k AND (
  (y.start <= x.start AND x."end" <= y."end" AND (y."end" - y.start > x."end" - x.start OR y.rank < x.rank))
  OR (y.start < x."end" AND x.start < y."end" AND y.priority < x.priority)))),
bb AS (SELECT k, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY k),
ll AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM b UNION ALL SELECT k, label FROM s) GROUP BY k),
ss AS (SELECT k, max(score) AS score FROM (SELECT k, CAST(score AS DOUBLE) AS score FROM s UNION ALL SELECT k, CAST(0.5 AS DOUBLE) FROM b) GROUP BY k)
SELECT doc_id, {count("n")} AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN bb USING (k) LEFT JOIN ll USING (k) LEFT JOIN ss USING (k)
"""


OP4_SQL = _sql()
