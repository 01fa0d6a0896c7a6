"""Licence scans by sentence rules.

A text is cut into lines at line breaks and after `.`, `!` or `?` with white space
behind. Lines are normalised (A-Z lower-cased, everything but a-z and 0-9 one
space, so that comment marks go). A known licence sentence stands where its words
fill one line or several that follow each other; lines without letters or digits
part paragraphs, which no sentence spans. Sentences of longer notices may also start
or end at `;` or `:` with white space behind. Each sentence has an identifier.
The identifiers, in text order and with unknown sentences left
out, are matched against ordered rules: a licence is found where a rule's
identifiers stand in this order without another identifier between. Texts without
a trigger word, of which every known sentence holds one, are passed over at once.

Results in odd cases: null and empty texts match nothing; rows are judged one by
one, so repeated rows give repeated results and null ids stay; a licence is named
once for a row however often its rules match; an empty table gives an empty
table; other columns are not read. No row is moved between executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence identifiers and the names that notices use for them.
LICENCES = {
    "MIT": ["MIT License", "MIT license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal license"],
    "Unlicense": ["Unlicense"],
}
#: How a notice names a licence.
NOTICES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "This file is licensed under the {}."]
#: Sentences of longer notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-use": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
#: Ordered identifiers of the longer notices.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-use", "apache-comply"]),
    ("Apache-2.0", ["apache-use", "apache-comply", "apache-copy"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
]
#: Of several rules that begin alike only the longest that matches counts.
SHADOWED = {"BSD-2-Clause": "BSD-3-Clause"}
#: Parts of words of which every known sentence holds one.
TRIGGERS = ["licen", "permission", "warrant", "redistribution", "released", "distributed"]


def normalised(text: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text)
    return " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in kept).split())


def sentence_table() -> dict[str, str]:
    """Identifiers by normalised sentence; a notice's identifier names its licence."""
    table = {normalised(s): k for k, s in SENTENCES.items()}
    for licence, names in LICENCES.items():
        for name in names:
            for notice in NOTICES:
                table.setdefault(normalised(notice.format(name)), f"notice-{licence}")
    return table


def rule_table() -> list[tuple[str, str]]:
    """(licence, its identifiers as `|a|b|`)."""
    rules = [(licence, [f"notice-{licence}"]) for licence in LICENCES] + RULES
    return [(licence, "|" + "|".join(ids) + "|") for licence, ids in rules]


def _words(sentences: list[str]) -> str:
    """A regular expression of normalised sentences whose words stand on one line or on several."""
    rest: dict[str, list[str]] = {}
    for sentence in sorted(sentences):
        word, _, more = sentence.partition(" ")
        rest.setdefault(word, []).append(more)
    out = []
    for word, more in rest.items():
        longer = [m for m in more if m]
        # a sentence that ends here goes before those that continue
        ways = ([""] if "" in more else []) + ([f"[ |]{_words(longer)}"] if longer else [])
        out.append(word + (ways[0] if len(ways) == 1 else f"(?:(?=[|~])|{ways[1]})"))
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    table = sentence_table()
    long = [normalised(s) for s in SENTENCES.values()]
    lower = F.translate(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ|~", "abcdefghijklmnopqrstuvwxyz  ")
    plain = F.regexp_replace(F.regexp_replace(lower, r"[;:][ \t]+", "~"), r"\r\n?|\n", "|")
    plain = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9|~]+", " "), " ?([|~]) ?", "$1")
    plain = F.concat(F.lit("|"), F.trim(plain), F.lit("|"))
    short = [s for s in table if s not in set(long)]
    # `~` parts only the sentences of longer notices
    notice = F.lit(rf"([|~]{_words(long)}(?=[|~])|\|{_words(short)}(?=\|))")
    known = F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))
    found = F.regexp_extract_all(plain, notice, F.lit(1))
    return F.filter(F.transform(found, lambda s: F.try_element_at(known, F.trim(F.translate(s, "|~", "  ")))), lambda i: i.isNotNull())


def _triggered(text: Column) -> Column:
    out = F.lit(False)
    for word in TRIGGERS:
        out = out | F.contains(text, F.lit(word))
    return out


def licence_matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licence, n_sentences (known sentences of the text): one row for each licence that a row's text names."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).filter(_triggered(F.lower("text")))
    rows = rows.select("id", sentence_ids(F.col("text")).alias("ids")).filter(F.size("ids") > 0)
    # each identifier stands between its own bars, so that a rule's bars can be shared by neighbours
    line = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))
    rules = F.array(*(F.struct(F.lit(k).alias("licence"), F.lit(v).alias("rule")) for k, v in rule_table()))
    hit = F.array_distinct(F.transform(F.filter(rules, lambda r: F.contains(F.col("line"), r["rule"])), lambda r: r["licence"]))
    rows = rows.withColumn("line", line).withColumn("found", hit)
    shadowed = F.lit(False)
    for short, long in SHADOWED.items():
        shadowed = shadowed | ((F.col("licence") == short) & F.array_contains("found", long))
    out = rows.select("id", F.size("ids").cast("long").alias("n_sentences"), "found", F.explode("found").alias("licence")).filter(~shadowed)
    return out.select(F.col("id").alias(id_col), "licence", "n_sentences")


def oracle() -> str:
    """DuckDB SQL over documents(doc_id, text): the same result where every known sentence fills a line of its own."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sorted(sentence_table().items()))
    rules = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in rule_table())
    hidden = " AND ".join(f"NOT (licence = {quote(a)} AND EXISTS (SELECT 1 FROM m o WHERE o.doc_id IS NOT DISTINCT FROM m.doc_id AND o.licence = {quote(b)}))" for a, b in SHADOWED.items())
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
rules(licence, rule) AS (VALUES {rules}),
parts AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+') AS s FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM parts),
ids AS (SELECT doc_id, i, id FROM lines JOIN known ON sentence = trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))),
texts AS (SELECT doc_id, '|' || string_agg(id, '|' ORDER BY i) || '|' AS line, count(*) AS n_sentences FROM ids GROUP BY doc_id),
m AS (SELECT DISTINCT doc_id, licence, n_sentences FROM texts JOIN rules ON contains(line, rule))
SELECT doc_id, licence, n_sentences FROM m WHERE {hidden}"""
