"""Licence recognition by sentences and ordered rules.

A text is cut into sentences: blanks and comment marks at line starts go, lines of a paragraph belong together, and a
sentence ends at ``.``, ``!`` or ``?`` before white space or at an empty line; the full stop of a "v. 2.0" ends none.
Sentences are normalised (lower case, runs of anything but a-z and 0-9 as one blank) and mapped to the
identifiers of the known sentences that they are or hold as whole words (in order, the longest at a place first,
each once for a sentence). A text's identifiers, in order, are matched against the rules, ordered sequences of identifiers, longest
rules first; what a rule has matched no shorter rule sees. Identifiers of a rule must follow each other
in the text's identifier sequence, unknown sentences between them don't matter.

A known sentence behind "not" or before "or (any) later" isn't taken.

Edge cases: null and empty texts have no sentences; a sentence found twice is in the sequence twice, a licence
found twice is listed once; texts of any length are read whole; repeated rows are read one by one; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import text_or_empty

# FIXED VALUES: sentences of public licence texts and the notices that refer to them.
SENTENCES = {
    "mit-ref": "released under the MIT License",
    "mit-ref-2": "licensed under the MIT License",
    "mit-ref-3": "distributed under the MIT License",
    "mit-ref-4": "under the terms of the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache2-ref": "Licensed under the Apache License, Version 2.0",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-grant": "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0",
    "epl1-ref": "made available under the terms of the Eclipse Public License v1.0",
    "epl2-ref": "made available under the terms of the Eclipse Public License 2.0",
    "epl2-ref-2": "made available under the terms of the Eclipse Public License v. 2.0",
    "mpl2-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "gpl-hope": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-kernel": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-title": "GNU General Public License Version 2, June 1991",
    "gpl3-title": "GNU General Public License Version 3, 29 June 2007",
    "lgpl2.1-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "agpl3-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "cc0-ref": "has waived all copyright and related or neighboring rights",
}

# FIXED VALUES: (licence, ordered sentence identifiers)
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("MIT", ("mit-ref-3",)),
    ("MIT", ("mit-ref-4",)),
    ("Apache-2.0", ("apache2-header", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-header", "apache2-comply")),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-unspecified", ("bsd-grant",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-2",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-ref",)),
    ("EPL-1.0", ("epl1-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("EPL-2.0", ("epl2-ref-2",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-kernel",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-2.1", ("lgpl2.1-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("CC0-1.0", ("cc0-ref",)),
]

# FIXED VALUES: the notices of the GNU licences by name and version, Creative Commons by its elements, and licence tags
GNU = [("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
       ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
       ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
                    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TAGS = ["MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "ISC", "0BSD", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0",
        "MPL-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"]

for _name, _title, _version in GNU:
    _id = _name.lower()
    _terms = f"you can redistribute it and/or modify it under the terms of the {_title} as published by the Free Software Foundation"
    SENTENCES[f"{_id}-later"] = f"{_terms}, either version {_version} of the License, or (at your option) any later version"
    SENTENCES[f"{_id}-this"] = f"{_terms}, version {_version} of the License"
    RULES += [(f"{_name}-or-later", (f"{_id}-later", "gpl-hope")), (f"{_name}-or-later", (f"{_id}-later",)),
              (f"{_name}-only", (f"{_id}-this", "gpl-hope")), (f"{_name}-only", (f"{_id}-this",))]
for _short, _long in CREATIVE_COMMONS.items():
    _id = f"cc-{_short.lower()}4"
    SENTENCES[f"{_id}-ref"] = f"Licensed under CC {_short} 4.0"
    SENTENCES[f"{_id}-deed"] = f"licensed under a Creative Commons {_long} 4.0 International License"
    RULES += [(f"CC-{_short}-4.0", (f"{_id}-ref",)), (f"CC-{_short}-4.0", (f"{_id}-deed",))]
for _tag in TAGS:
    SENTENCES[f"tag-{_tag.lower()}"] = f"SPDX-License-Identifier: {_tag}"
    RULES.append((_tag, (f"tag-{_tag.lower()}",)))

TRIGGERS = ("licens", "permission", "copyright", "redistribution", "warranty", "unencumbered", "advertising")    # words, or their starts
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINE_START = r"(^|\n)[ \t/*#;%><!|-]*((dnl|rem)[ \t]+)?"      # blanks and comment marks
VERSION = r"\b(v|ver|no)\.[ \n]+([0-9])"
SENTENCE_END, OTHER = r"[.!?]+[ \t\n]+|\n\n+", r"[^a-z0-9]+"
LATER = r" or (?:at your option )?(?:any )?later"


def normalised(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence -> identifier."""
    known = {normalised(sentence): name for name, sentence in sentences.items()}
    for s in known:
        if not any(t in s for t in TRIGGERS):
            raise ValueError(f"no trigger occurs in: {s}")
    return known


def _may_hold(text):
    """Whether a lower-case text holds a word that every known sentence has one of."""
    maybe = F.lit(False)
    for t in TRIGGERS:
        maybe = maybe | F.contains(text, F.lit(t))
    return maybe


def sentences_of(text):
    """The sentences of a text column, in lower case without comment marks."""
    low = F.translate(text, UPPER + "\r", LOWER)
    lines = F.regexp_replace(low, LINE_START, "\n")
    return F.split(F.regexp_replace(lines, VERSION, "$1 $2"), SENTENCE_END, -1)


def identifiers(text, known: dict[str, str]):
    """The identifiers of the known sentences in a text column, in order."""
    longest = "|".join(sorted(known, key=lambda s: (-len(s), s)))
    pattern = F.lit(rf"(?<![a-z0-9])(?<!not )(?:{longest})(?![a-z0-9])(?!{LATER})")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    likely = F.filter(sentences_of(text), _may_hold)
    found = F.flatten(F.transform(likely, lambda s: F.array_distinct(F.regexp_extract_all(F.regexp_replace(s, OTHER, " "), pattern, 0))))
    return F.when(_may_hold(F.translate(text, UPPER, LOWER)), F.transform(found, lambda s: F.try_element_at(table, s))).otherwise(F.array().cast("array<string>"))


def recognise(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """(doc_id, sentence_ids, licences): the known sentences in order, and the licences, sorted."""
    known = known_sentences(sentences)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), identifiers(text_or_empty(), known).alias("sentence_ids"))
    # each identifier stands between two bars of its own, so that sequences meet without sharing one
    left = F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""))
    hits = []
    for licence, ids in sorted(rules, key=lambda r: -len(r[1])):
        pattern = F.lit("".join(f"|{i}|" for i in ids))
        hits.append(F.when(F.contains(left, pattern), F.lit(licence)))
        left = F.replace(left, pattern, F.lit("||"))
    licences = F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return found.select("doc_id", "sentence_ids", licences.alias("licences"))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"),
                        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("licences").cast("bigint").alias("n_licences"),
                        F.array_join("licences", ",").alias("licences"))
