"""Licence recognition by sentences: normalised sentences map to known sentence ids, and ordered rules match id sequences.

The main path uses DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence sentences, already normalised (lower case, letters and digits only, single spaces). Fixed values.
SENTENCES = (
    (1, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (2, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (3, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (4, "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    (5, "released under the mit license"),
    (6, "licensed under the mit license"),
    (7, "this project is licensed under the mit license"),
    (8, "spdx license identifier mit"),
    (10, "licensed under the apache license version 2 0"),
    (11, "licensed under the apache license version 2 0 the license"),
    (12, "you may not use this file except in compliance with the license"),
    (13, "you may obtain a copy of the license at"),
    (14, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    (15, "see the license for the specific language governing permissions and limitations under the license"),
    (16, "spdx license identifier apache 2 0"),
    (17, "released under the apache license version 2 0"),
    (20, "this work is licensed under the gnu general public license version 3"),
    (21, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (22, "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    (23, "see the gnu general public license for more details"),
    (24, "you should have received a copy of the gnu general public license along with this program"),
    (25, "spdx license identifier gpl 3 0 or later"),
    (26, "spdx license identifier gpl 3 0 only"),
    (27, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    (28, "spdx license identifier gpl 2 0 only"),
    (30, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (31, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (32, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    (33, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (34, "spdx license identifier bsd 3 clause"),
    (35, "spdx license identifier bsd 2 clause"),
    (40, "licensed under cc by nc 4 0"),
    (41, "licensed under cc by 4 0"),
    (42, "licensed under cc by sa 4 0"),
    (43, "this work is licensed under a creative commons attribution 4 0 international license"),
    (44, "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    (45, "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    (46, "released under cc0 1 0"),
    (50, "all rights reserved"),
    (51, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (52, "if a copy of the mpl was not distributed with this file you can obtain one at"),
)

#: Ordered rules: (rule id, licence, consecutive sentence ids), longer sequences first: what one rule has matched, later rules don't see.
RULES = (
    ("apache-header", "Apache-2.0", (11, 12, 13, 14, 15)),
    ("mit-text", "MIT", (1, 2, 3, 4)),
    ("gpl3-header", "GPL-3.0-or-later", (21, 22, 23, 24)),
    ("gpl2-header", "GPL-2.0-or-later", (27, 22, 23, 24)),
    ("bsd3-text", "BSD-3-Clause", (30, 31, 32, 33)),
    ("apache-header-short", "Apache-2.0", (11, 12, 13)),
    ("bsd2-text", "BSD-2-Clause", (30, 31, 32)),
    ("mit-grant", "MIT", (1, 2)),
    ("mpl-header", "MPL-2.0", (51, 52)),
    ("mit-released", "MIT", (5,)),
    ("mit-licensed", "MIT", (6,)),
    ("mit-project", "MIT", (7,)),
    ("mit-spdx", "MIT", (8,)),
    ("apache-licensed", "Apache-2.0", (10,)),
    ("apache-released", "Apache-2.0", (17,)),
    ("apache-spdx", "Apache-2.0", (16,)),
    ("gpl3-work", "GPL-3.0", (20,)),
    ("gpl3-header-short", "GPL-3.0-or-later", (21,)),
    ("gpl3-spdx-later", "GPL-3.0-or-later", (25,)),
    ("gpl3-spdx-only", "GPL-3.0-only", (26,)),
    ("gpl2-header-short", "GPL-2.0-or-later", (27,)),
    ("gpl2-spdx", "GPL-2.0-only", (28,)),
    ("bsd3-spdx", "BSD-3-Clause", (34,)),
    ("bsd2-spdx", "BSD-2-Clause", (35,)),
    ("cc-by-nc", "CC-BY-NC-4.0", (40,)),
    ("cc-by-nc-text", "CC-BY-NC-4.0", (45,)),
    ("cc-by", "CC-BY-4.0", (41,)),
    ("cc-by-text", "CC-BY-4.0", (43,)),
    ("cc-by-sa", "CC-BY-SA-4.0", (42,)),
    ("cc-by-sa-text", "CC-BY-SA-4.0", (44,)),
    ("cc0", "CC0-1.0", (46,)),
    ("mpl-header-short", "MPL-2.0", (51,)),
    ("reserved", "All-Rights-Reserved", (50,)),
)

#: Every known sentence has one of these words; a text without any of them needs no sentence work.
CUES = ("licens", "permission", "copyright", "redistribut", "warrant", "liable", "reserved", "cc0", "mpl")
#: A sentence ends at .!?:; before white space, or at an empty line.
SENTENCE_END = r"[.!?:;][ \t\r\n]+|\n[ \t\r]*\n"
#: Marks inside known sentences that look like an end: (pattern, what joins the two sides). URLs go, the mark after one stays.
#: Applied before the split, to the query only: OP5_SQL knows none of them.
JOINS = (
    (r"https?://[^\s]*[^\s.,;:!?]", " "),
    (r"(?i)(spdx-license-identifier):[ \t]+", "$1 "),
    (r"(?i)\bv\.[ \t\r\n]+(?=[0-9])", "v "),
    (r"(?i)(free[ \t\r\n]+software)[:;]([ \t\r\n]+you[ \t\r\n]+can[ \t\r\n]+redistribute)", "$1$2"),
    (r"(?i)(software[ \t\r\n]+foundation);([ \t\r\n]+either)", "$1$2"),
    (r"(?i)(any[ \t\r\n]+warranty);([ \t\r\n]+without[ \t\r\n]+even)", "$1$2"),
)
_LETTER = {i: chr(0x4E00 + i) for i, _ in SENTENCES}  # one character per sentence id: id sequences compare as strings
_IDS = tuple("".join(_LETTER[i] for i in ids) for _, _, ids in RULES)

if any(all(c not in s for c in CUES) for _, s in SENTENCES):
    raise ValueError("a known sentence has no cue")
if list(map(len, _IDS)) != sorted(map(len, _IDS), reverse=True):
    raise ValueError("rules must be ordered by length")


def sentence_letters(text: Column) -> Column:
    """A text's sentences as one character each: the known sentence's, or '.' for any other sentence with a word.

    Numbers of list items (sentences of digits only) and URLs are no sentences.
    """
    known = F.create_map(*[x for i, s in SENTENCES for x in (F.lit(s), F.lit(_LETTER[i]))])
    cleaned = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.array_join(F.transform(F.filter(cleaned, lambda s: ~s.rlike("^[0-9]*$")), lambda s: F.coalesce(F.try_element_at(known, s), F.lit("."))), "")


def joined(text: Column) -> Column:
    """The text without marks that would cut a known sentence."""
    for pattern, put in JOINS:
        text = F.regexp_replace(text, pattern, put)
    return text


def rule_counts(letters: Column) -> Column:
    """How often each rule's id sequence occurs, in the order of RULES; what a longer rule matched is taken out first."""
    start = F.struct(letters.alias("s"), F.array().cast("array<int>").alias("n"))

    def step(acc: Column, ids: Column) -> Column:
        s = acc["s"]
        n = ((F.length(s) - F.length(F.replace(s, ids, F.lit("")))) / F.length(ids)).cast("int")
        return F.struct(F.replace(s, ids, F.lit(".")).alias("s"), F.array_append(acc["n"], n).alias("n"))

    return F.aggregate(F.array(*map(F.lit, _IDS)), start, step, lambda acc: acc["n"])


def license_scan(df: DataFrame) -> DataFrame:
    """A row per row of ``df`` (doc_id, text): n_statements, licenses, rules.

    ``licenses`` lists the distinct licences found, sorted; ``rules`` the rules in their order with counts; both joined
    by commas, empty if none. Every text is read twice, line ends as spaces (wrapped licence texts) and as sentence
    ends (statements on lines of their own); a rule counts as often as in the reading that has more of it. A null or
    empty text has none; repeated rows are each scanned; extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(F.col("text"))
    cued = F.lit(False)
    for c in CUES:
        cued = cued | F.contains(low, F.lit(c))
    none = F.array_repeat(F.lit(0), len(RULES))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    whole = joined(F.col("text"))
    both = F.zip_with(rule_counts(sentence_letters(whole)), rule_counts(sentence_letters(F.replace(whole, F.lit("\n"), F.lit("\n\n")))), lambda a, b: F.greatest(a, b))
    rows = rows.select("doc_id", F.when(cued, both).otherwise(none).alias("n"))
    names, kinds = F.array(*[F.lit(r) for r, _, _ in RULES]), F.array(*[F.lit(k) for _, k, _ in RULES])
    found = F.filter(F.arrays_zip(F.col("n"), names.alias("rule"), kinds.alias("license")), lambda x: x["n"] > 0)
    rows = rows.select("doc_id", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_statements"), found.alias("found"))
    return rows.select(
        "doc_id",
        "n_statements",
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda x: F.concat(x["rule"], F.lit("*"), x["n"].cast("string"))), ",").alias("rules"),
    )


def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = "MAP {" + ", ".join(f"'{s}': '{_LETTER[i]}'" for i, s in SENTENCES) + "}"
    seq = f"array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(@TEXT@, '{SENTENCE_END}'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> ''), lambda x: coalesce({known}[x], '.')), '')"
    steps, sums, lic, rules = [], [], [], []
    for k, ((name, kind, _), ids) in enumerate(zip(RULES, _IDS, strict=True)):
        for r in "ab":
            steps.append(f"(length({r}{k}) - length(replace({r}{k}, '{ids}', ''))) // {len(ids)} AS n{r}{k}, replace({r}{k}, '{ids}', '.') AS {r}{k + 1}")
        steps.append(f"greatest(na{k}, nb{k}) AS n{k}")
        sums.append(f"n{k}")
        lic.append(f"CASE WHEN n{k} > 0 THEN '{kind}' END")
        rules.append(f"CASE WHEN n{k} > 0 THEN '{name}*' || n{k} END")
    tidy = "list_filter([{}], lambda x: x IS NOT NULL)"
    return (
        f"WITH s AS (SELECT doc_id, {seq.replace('@TEXT@', 'text')} AS a0, {seq.replace('@TEXT@', 'replace(text, chr(10), chr(10) || chr(10))')} AS b0 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), "
        f"c AS (SELECT doc_id, a0, b0, {', '.join(steps)} FROM s) "
        f"SELECT doc_id, ({' + '.join(sums)})::BIGINT AS n_statements, array_to_string(list_sort(list_distinct({tidy.format(', '.join(lic))})), ',') AS licenses, "
        f"array_to_string({tidy.format(', '.join(rules))}, ',') AS rules FROM c"
    )


OP5_SQL = _sql()
