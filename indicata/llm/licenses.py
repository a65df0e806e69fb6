"""License scan by sentence rules, in DataFrame functions only.

A text is cut after ``. ; : ! ?`` before white space and at lines without a
letter or digit; a single line feed may end a sentence or lie inside it, so a
sentence is found however it is wrapped.  The text is lower-cased, marks of
comments at the start of lines go and everything but a-z and 0-9 becomes one
space.  Known license sentences that reach from one cut or line feed to
another become their identifiers, the longest where several start at one place; a rule names a license and the identifiers it needs in this order
(others may lie between).  Only texts with one of the ``ANCHORS`` are cut at
all, which loses nothing: every known sentence holds one inside a word, and
``sentence_table`` checks that.

The scan is one narrow projection without shuffle, join or Python; sentence
table and rules are literals of the plan.

Edge cases: a null or empty text, or one without a known sentence, has empty
results; a sentence that occurs twice counts in both places; repeated rows
stay repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licenses and notices, by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl-version": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-more": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc0-short": "Licensed under CC0 1.0.",
}
# Licenses by the sentences they need, in order.
RULES = [
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-asis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0", ["gpl-free", "gpl-version", "gpl-hope", "gpl-more"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-asis"]),
]
ANCHORS = ("licens", "permission", "permitted", "warrant", "redistribut", "copyright", "free software")

#: Stands for the end of a sentence.
_CUT = "\x01"
_COMMENT = r"(^|\n)[ \t]*(?:[#*/;%!>|-]+|dnl|rem)(?=[ \t\n])"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def sentence_table(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifier by normalised sentence; the last mark of a sentence does not count."""
    out = {normal(s): i for i, s in sentences.items()}
    missed = [i for s, i in out.items() if not any(a in s for a in ANCHORS)]
    cut = [i for i, s in sentences.items() if re.search(r"[.;:!?]\s", s.strip())]
    if missed or cut or any("," in i for i in sentences):
        raise ValueError(f"no anchor: {missed}; more than one sentence: {cut}; or a comma in an identifier")
    return out


def rule_pattern(needed: list[str]) -> str:
    """Matches ``,id,id,`` lists that hold ``needed`` in order."""
    return "," + ",(?:[^,]+,)*".join(needed) + ","


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of ``text``, in text order."""
    low = F.lower(text)
    has_anchor = low.rlike("|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS))
    table = sentence_table(sentences)
    known = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    line = F.regexp_replace(F.translate(low, _CUT, " "), _COMMENT, "$1")
    line = F.regexp_replace(line, r"([.;:!?])[ \t\f\r\n]+", f"$1{_CUT}")
    line = F.regexp_replace(line, rf"\n[^a-z0-9\n{_CUT}]*(?=\n)", _CUT)
    line = F.regexp_replace(F.regexp_replace(line, rf"[^a-z0-9\n{_CUT}]+", " "), rf" ?([\n{_CUT}]) ?", "$1")
    by_length = "|".join(sorted(table, key=len, reverse=True)).replace(" ", r"[ \n]")
    found = F.regexp_extract_all(F.trim(line), F.lit(rf"(?<![^\n{_CUT}])(?:{by_length})(?![^\n{_CUT}])"), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    return F.when(has_anchor, ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentences, licenses (sorted, comma-joined) of every row."""
    found = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text).cast("string")).alias("ids"))
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    names = F.array(*[F.when(F.col("line").rlike(rule_pattern(needed)), F.lit(name)) for name, needed in RULES])
    matched = F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull()))), ",")
    return found.withColumn("line", line).select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"),
        F.when(F.size("ids") > 0, matched).otherwise("").alias("licenses"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The scan as DuckDB SQL."""
    table = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in sentence_table().items())
    rules = []
    for name, needed in RULES:
        rules.append(f"case when regexp_matches(line, {_quoted(rule_pattern(needed))}) then {_quoted(name)} end")
    return f"""
with known(sentence, id) as (values {table}),
cut as (
  select row_number() over () as r, doc_id,
         string_split(regexp_replace(lower(coalesce(text, '')), '([.;:!?])[ \\t\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)) as parts
  from documents),
each as (
  select r, unnest(parts) as s, generate_subscripts(parts, 1) as pos from cut),
ids as (
  select r, count(*) as n, string_agg(id, ',' order by pos) as ids
  from each join known on trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) = sentence group by r),
lined as (
  select cut.doc_id, coalesce(n, 0) as n_sentences, coalesce(ids, '') as sentences,
         ',' || coalesce(ids, '') || ',' as line
  from cut left join ids using (r))
select doc_id, n_sentences, sentences,
       array_to_string(list_sort(list_distinct([{', '.join(rules)}])), ',') as licenses
from lined"""
