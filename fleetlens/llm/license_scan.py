"""License scans by a positional index of rare words; DataFrame functions only."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The four base phrases and their labels.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
# Fixed values: (label, text, mandatory key phrases) of licence notices and bodies.
LICENCES = [
    ("gpl-3", "licensed under the GNU General Public License version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the GNU General Public License version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the GNU Lesser General Public License version 3", ["gnu lesser general public license"]),
    ("agpl", "licensed under the GNU Affero General Public License version 3", ["gnu affero general public license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("cc0", "released under CC0 1.0 Universal", ["cc0 1 0"]),
    ("bsd", "released under the BSD License", ["bsd license"]),
    ("isc", "released under the ISC License", ["isc license"]),
    ("public-domain", "This work is released into the public domain", ["released into the public domain"]),
    ("epl", "under the terms of the Eclipse Public License v. 2.0", ["eclipse public license"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.""",
        ["permission is hereby granted free of charge"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
        ["redistribution and use in source and binary forms", "with or without modification are permitted"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
        ["permission to use copy modify and or distribute this software for any purpose"],
    ),
    (
        "apache-2",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
        ["you may not use this file except in compliance with the license", "apache org licenses license 2 0"],
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ["redistribute it and or modify it under the terms of the gnu general public license"],
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ["mozilla public license"],
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        ["free and unencumbered software released into the public domain"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely""",
        ["in no event will the authors be held liable for any damages arising from the use of this software"],
    ),
]
#: Of a licence's words, so many stand in place where it is labelled, and where it counts for the score without its key phrases.
LEAST_PCT, NEAR_PCT = 15, 50
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _cut(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def templates() -> list[dict]:
    """Base phrases and licences: key phrases and all words by their offset from the start of the first key phrase, and how many words must stand in place (least: beside the key phrases; near: without them)."""
    out = []
    for base, label, text, keys in [*((True, label, phrase, [phrase]) for label, phrase in BASE), *((False, *x) for x in LICENCES)]:
        words, phrases = _cut(text), [_cut(k) for k in keys]
        at = [next(i for i in range(len(words)) if words[i : i + len(p)] == p) for p in phrases]
        first = min(at)
        out.append({
            "label": label, "base": base, "least": len(words) if base else -(-len(words) * LEAST_PCT // 100), "near": len(words) if base else -(-len(words) * NEAR_PCT // 100), "keys": [{"o": i - first, "w": p} for i, p in zip(at, phrases)],
            "body": [{"o": i - first, "w": w} for i, w in enumerate(words)],
        })
    return out


def _words(text: Column) -> Column:
    # lower() differs from lowering A-Z alone only in letters outside ASCII, which no phrase has, and it keeps them letters.
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def _fixed(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def licence_idf(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents: as many rows as there are such words."""
    vocabulary = sorted({b["w"] for t in templates() for b in t["body"]})
    seen = docs.select(F.explode(F.array_distinct(F.filter(_words(F.col("text")), lambda w: w.isin(vocabulary)))).alias("word"))
    rows = {r[0]: r[1] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (rows.get(w, 0) + 1)) for w in vocabulary}


def rare_postings(idf: dict[str, float]) -> dict[str, list[dict]]:
    """The index: for each word the (template, offset) that it stands at among a template's rarest words.

    A template of n words of which m in place are near has its n - m + 1 rarest places here: wherever m stand, one of these
    does, whichever words were altered. The rarest place of its key phrases is here too, as they must all stand for a label.
    """
    index: dict[str, list[dict]] = {}
    for number, t in enumerate(templates()):
        rarest = lambda b: (-idf[b["w"]], b["o"])
        chosen = {b["o"]: b["w"] for b in sorted(t["body"], key=rarest)[: len(t["body"]) - t["near"] + 1]}
        key = min(({"o": k["o"] + i, "w": w} for k in t["keys"] for i, w in enumerate(k["w"])), key=rarest)
        for o, w in sorted({**chosen, key["o"]: key["w"]}.items()):
            index.setdefault(w, []).append({"t": number, "o": o})
    return index


def scan_licenses(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: doc_id) and n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    A positional index holds, for each template, the places of its words of the highest IDF over the corpus. A file's rare
    licence words are looked up in it; each posting votes for a template and a start, and words at their own distances
    vote for the same one. At each start voted for, the template's words in place are counted and its key phrases verified word
    for word. The label is given where all key phrases stand and LEAST_PCT of a licence's words are in place, so neither a
    licence that is only mentioned nor a body whose key phrase was altered is labelled. ``score`` is the largest share of
    words in place at labelled starts and at those with NEAR_PCT, 0 without: the altered body has its score. Which words are rare steers the search, never the
    result. ``places`` lists label, start (of the first key phrase) and share of those labelled.
    Work is linear in the text, the plan doesn't grow with the templates, and nothing but word counts is shuffled.

    Null and empty texts have no words and no labels (empty strings) and null first_word and last_word; repeated rows
    and null ids get a row each; an empty table gives no rows; columns not in ``carry`` are ignored, whatever their names.
    """
    carry = carry or ["doc_id"]
    index = rare_postings(licence_idf(docs))
    posting = "struct<t:int,o:int>"
    every = _fixed(templates(), "array<struct<label:string,base:boolean,least:int,near:int,keys:array<struct<o:int,w:array<string>>>,body:array<struct<o:int,w:string>>>>")
    frame = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), _words(F.col("text")).alias("_w"))
    rare_words = sorted(index)
    frame = frame.withColumn("_at", F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(rare_words), i))))
    postings = _fixed(index, f"map<string,array<{posting}>>")
    votes = F.flatten(F.transform("_at", lambda p: F.transform(F.try_element_at(postings, F.get("_w", p)), lambda x: F.struct(x["t"].alias("t"), (p - x["o"]).alias("s")))))
    frame = frame.withColumn("_starts", F.array_distinct(F.filter(votes, lambda v: v["s"] >= 0)))

    def stands(v: Column) -> Column:
        return F.forall(F.get(every, v["t"])["keys"], lambda k: F.slice("_w", v["s"] + k["o"] + 1, F.size(k["w"])) == k["w"])

    def place(v: Column) -> Column:
        t = F.get(every, v["t"])
        hit = F.size(F.filter(t["body"], lambda b: F.get("_w", v["s"] + b["o"]) == b["w"]))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), v["s"].cast("long").alias("start"), (hit / F.size(t["body"])).alias("share"), (hit >= t["near"]).alias("near"), ((hit >= t["least"]) & stands(v)).alias("named"))

    frame = frame.withColumn("_near", F.filter(F.transform("_starts", place), lambda x: x["near"] | x["named"]))
    frame = frame.withColumn("_found", F.filter("_near", lambda x: x["named"]))
    frame = frame.withColumn("_base", F.filter("_found", lambda x: x["base"]))
    start = F.transform("_base", lambda x: x["start"])
    names = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda x: x["label"]))), ",")
    return frame.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)),
        F.size("_w").cast("long").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        names("_base").alias("base_labels"), names("_found").alias("labels"),
        F.coalesce(F.array_max(F.transform("_near", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.transform("_found", lambda x: x.dropFields("base", "near", "named")).alias("places"),
    )


def scan_sql() -> str:
    """The same result as DuckDB SQL by another way: every word votes for every place of a template that has it, none is rare; phrases are compared as strings."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    strings = lambda xs: "[" + ", ".join(map(quote, xs)) + "]"
    texts = [*((True, label, phrase, [phrase]) for label, phrase in BASE), *((False, *x) for x in LICENCES)]
    rows = ",\n      ".join(f"({i}, {quote(label)}, {str(base).lower()}, {quote(' '.join(_cut(text)))}, {strings(keys)})" for i, (base, label, text, keys) in enumerate(texts))
    return f"""
    with licences(id, label, base, body, keys) as (values
      {rows}
    ), parts as (  -- words before the first key phrase, the phrases' own offsets from it
      select id, label, base, string_split(body, ' ') as b, keys,
        list_transform(keys, lambda k: len(string_split(substr(' ' || body || ' ', 1, instr(' ' || body || ' ', ' ' || k || ' ')), ' ')) - 2) as o from licences
    ), body as (
      select id, unnest(b) as word, unnest(range(len(b))) - list_min(o) as o from parts
    ), words as (
      select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
      from documents
    ), spelt as (
      select r, unnest(w) as word, unnest(range(len(w))) as i from words
    ), votes as (
      select s.r, b.id, s.i - b.o as i, count(*) as hit from spelt s join body b on s.word = b.word where s.i >= b.o group by s.r, b.id, s.i - b.o
    ), near as (
      select v.r, v.i, p.label, p.base, p.keys, p.o, w.w, v.hit / cast(len(p.b) as double) as share
      from votes v join parts p on p.id = v.id join words w on w.r = v.r where case when p.base then v.hit = len(p.b) else v.hit * 100 >= len(p.b) * {LEAST_PCT} end
    ), tried as (
      select *, len(list_filter(range(len(keys)), lambda n: array_to_string(w[i + o[n + 1] - list_min(o) + 1 : i + o[n + 1] - list_min(o) + len(string_split(keys[n + 1], ' '))], ' ') = keys[n + 1])) = len(keys) as named from near
    ), places as (
      select * from tried where named or share * 100 >= {NEAR_PCT}
    ), found as (
      select r, count(*) filter (base) as n_base, min(i) filter (base) as first_word, max(i) filter (base) as last_word, max(share) as score,
        string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) filter (named) as labels from places group by r
    )
    select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(f.n_base, 0) as n_base, cast(f.first_word as bigint) as first_word, cast(f.last_word as bigint) as last_word,
      coalesce(f.base_labels, '') as base_labels, coalesce(f.labels, '') as labels, coalesce(f.score, 0.0) as score
    from words w left join found f using (r)
    """
