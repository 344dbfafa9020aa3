"""Licence scan by sentence rules, in built-in functions only.

A text is cut into sentences: after .!? before white space, after a colon that
ends a line, and at blank lines, lines of comment marks alone among them.
Other line breaks are wraps: a known sentence may begin at the beginning of
any line of its sentence and goes on to the sentence's end, or is one line.
So wrapped licences are read as well as notices on a line of their own between
lines without full stops.

A sentence is normalised (small ASCII letters and digits, single blanks,
`licence` spelt `license`, and one form for `this work is released under the
terms of the ...` and its like) and looked up among known licence sentences;
what is found, in order, is the text's sequence of sentence identifiers.  A
rule is an ordered list of identifiers, and names a licence if they occur in
that order, other sentences between them or not.

Everything is one projection: no shuffle, no join, no state.  Defined
results: null and empty texts have no sentences and no licence, an empty table
gives an empty one; texts of any length are read whole; repeated sentences
repeat in the sequence, a licence is named once; licences are named in the
order of the rules; other columns stay, but a table that has a column
sentence_ids or licences is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences as notices give them after `licensed under`, without a closing `license`.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0", "apache version 2 0", "apache software license version 2 0"],
    "MIT": ["mit", "expat"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gplv3", "gplv3", "gpl version 3", "gpl 3 0", "gpl v3"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gplv2", "gplv2", "gpl version 2", "gpl 2 0", "gpl v2"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgplv3", "lgpl 3 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgplv2 1", "lgpl 2 1"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agplv3", "agpl 3 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd"],
    "ISC": ["isc"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0"],
    "Unlicense": ["unlicense"],
}
# SPDX expressions of one licence, beside the names above in small letters, -only and -or-later.
SUFFIXES = ["", " only", " or later"]
# Sentences of licence texts and headers, and their identifiers.
SENTENCES = {
    'Licensed under the Apache License, Version 2.0 (the "License")': "Apache-2.0-notice",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "Apache-2.0-notice",
    "You may not use this file except in compliance with the License.": "apache-comply",
    "You may obtain a copy of the License at": "apache-copy-at",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-url",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "apache-url",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-url",
    "https://www.apache.org/licenses/LICENSE-2.0": "apache-url",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/": "apache-title",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache-terms",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:': "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit-keep-notice",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND': "mit-as-is",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "mit-as-is",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.': "isc-as-is",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-endorse",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl-3.0-title",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "gpl-2.0-title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl-3.0-title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "lgpl-2.1-title",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "agpl-3.0-title",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.": "fsf-verbatim",
    "Mozilla Public License Version 2.0": "mpl-2.0-title",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0-header",
    '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.': "mpl-covered",
    "This is free and unencumbered software released into the public domain.": "unlicense-domain",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense-anyone",
    "All rights reserved.": "rights-reserved",
}
# The header of the GNU licences: subjects, the licence's name by version, and how its end is put.
GNU_SUBJECTS = ["program", "library", "file", "software"]
GNU_NAMES = {"GPL": ("", ["2", "3"]), "LGPL": ("Lesser ", ["2.1", "3"]), "AGPL": ("Affero ", ["3"])}
GNU_ENDS = ["either version {} of the License, or (at your option) any later version.", "either version {} of the License, or any later version.", "version {} of the License.", "version {}."]
# Ordered rules, licence and its sequence of identifiers, beside one rule for each notice, tag and header.
RULES = [
    ("Apache-2.0", ["apache-comply", "apache-url"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("MIT", ["mit-grant", "mit-keep-notice"]),
    ("MIT", ["mit-keep-notice", "mit-as-is"]),
    ("GPL-3.0", ["gpl-3.0-title", "fsf-verbatim"]),
    ("GPL-2.0", ["gpl-2.0-title", "fsf-verbatim"]),
    ("LGPL-3.0", ["lgpl-3.0-title", "fsf-verbatim"]),
    ("LGPL-2.1", ["lgpl-2.1-title", "fsf-verbatim"]),
    ("AGPL-3.0", ["agpl-3.0-title", "fsf-verbatim"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD", ["bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("MPL-2.0", ["mpl-2.0-title", "mpl-covered"]),
    ("MPL-2.0", ["mpl-2.0-header"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What divides sentences: full stops and the like, colons at line ends, blank lines.
CUT = "[.!?][\"')]*[ \\t\\r\\n]+|:[ \\t\\r]*\\n|\\n[ \\t\\r]*[*#/;%-]*[ \\t\\r]*\\n"
MARK = "\x01"
#: A known sentence has one of these words, in any spelling.
LIKELY = "licen[sc]e|rights|redistrib|software|copyright|source code|copies|conditions"
#: One form for the ways to say under which licence something is.
UNDER = "^([a-z0-9]+ ([a-z0-9]+ )?([a-z0-9]+ )?(is|are) )?(licensed|released|distributed|available|published|provided) under (the terms of )?(the |a |an )?"


def normal(sentence: str) -> str:
    """The normalised form of a known sentence."""
    words = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip().replace("licence", "license")
    return re.sub(UNDER, "licensed under ", words)


def _known() -> dict[str, str]:
    """Normalised sentence to identifier."""
    out = {normal(s): i for s, i in SENTENCES.items()}
    for licence, names in NAMES.items():
        for name in names:
            out |= {f"licensed under {name}{end}": f"{licence}-notice" for end in ("", " license")}
        out |= {f"spdx license identifier {normal(licence)}{end}": f"{licence}-tag" for end in SUFFIXES}
    for short, (word, versions) in GNU_NAMES.items():
        for v in versions:
            for subject in GNU_SUBJECTS:
                for end in GNU_ENDS:
                    text = f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the GNU {word}General Public License as published by the Free Software Foundation; {end.format(v)}"
                    out[normal(text)] = f"{short}-{v if '.' in v else v + '.0'}-header"
    return out


KNOWN = _known()
ALL_RULES = [
    *((licence, [f"{licence}-{kind}"]) for licence in NAMES for kind in ("notice", "tag", "header") if f"{licence}-{kind}" in KNOWN.values()),
    *RULES,
]
#: A line has a word at least, so a known sentence has no more lines than this.
MOST_LINES = max(len(s.split()) for s in KNOWN)


def _pattern(rule: list[str]) -> str:
    """A regular expression for a rule on a sequence like `|a|b|`."""
    return "[|]" + "[|](.*[|])?".join(r.replace(".", "[.]") for r in rule) + "[|]"


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    # Only sentences with a word that some known sentence has are normalised.
    likely = F.filter(F.split(F.regexp_replace(low, CUT, MARK), MARK), lambda s: s.rlike(LIKELY))

    def lines(s: Column) -> Column:
        clean = F.transform(F.split(s, "\n"), lambda x: F.replace(F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")), F.lit("licence"), F.lit("license")))
        return F.filter(clean, lambda x: x != "")

    def look(s: Column) -> Column:
        return F.try_element_at(known, F.regexp_replace(s, UNDER, "licensed under "))

    def found(ls: Column) -> Column:
        return F.transform(ls, lambda x, j: F.coalesce(F.when(F.size(ls) - j <= MOST_LINES, look(F.array_join(F.slice(ls, j + 1, F.size(ls)), " "))), look(x)))

    return F.array_compact(F.flatten(F.transform(F.transform(likely, lines), found)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (array) and licences (array)."""
    clash = {"sentence_ids", "licences"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"the table has columns of the result: {sorted(clash)}")
    rows = docs.withColumn("sentence_ids", sentence_ids(F.col(text)))
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    named = F.array(*[F.when(line.rlike(_pattern(rule)), F.lit(name)) for name, rule in ALL_RULES])
    return rows.withColumn("licences", F.when(F.size("sentence_ids") > 0, F.array_distinct(F.array_compact(named))).otherwise(F.array().cast("array<string>")))


def oracle(columns: str = "doc_id") -> str:
    """DuckDB SQL for doc_id, sentences, licences (joined by blanks) and n_licences."""
    cases = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in KNOWN.items())
    names = ", ".join(f"CASE WHEN regexp_matches(line, '{_pattern(rule)}') THEN '{name}' END" for name, rule in ALL_RULES)
    order = ", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in ALL_RULES))
    cut = CUT.replace("'", "''")
    return f"""
WITH parts AS (
  SELECT {columns}, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{cut}', chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '{LIKELY}')) AS p FROM documents
), lines AS (
  SELECT {columns}, list_transform(p, lambda s: list_filter(list_transform(string_split(s, chr(10)), lambda x: replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), 'licence', 'license')), lambda x: x <> '')) AS l FROM parts
), tried AS (
  SELECT {columns}, flatten(list_transform(l, lambda ls: flatten(list_transform(range(1, len(ls) + 1), lambda j: [CASE WHEN len(ls) - j < {MOST_LINES} THEN array_to_string(ls[j:], ' ') END, ls[j]])))) AS c FROM lines
), looked AS (
  SELECT {columns}, list_transform(c, lambda x: CASE regexp_replace(x, '{UNDER}', 'licensed under ') {cases} END) AS k FROM tried
), ids AS (
  SELECT {columns}, list_filter(list_transform(range(1, len(k) + 1, 2), lambda j: coalesce(k[j], k[j + 1])), lambda s: s IS NOT NULL) AS i FROM looked
), joined AS (
  SELECT {columns}, i, '|' || coalesce(array_to_string(i, '|'), '') || '|' AS line FROM ids
), named AS (
  SELECT {columns}, i, [{names}] AS n FROM joined
)
SELECT {columns}, coalesce(array_to_string(i, ' '), '') AS sentences,
  coalesce(array_to_string(list_filter([{order}], lambda x: list_contains(n, x)), ' '), '') AS licences,
  CAST(len(list_filter([{order}], lambda x: list_contains(n, x))) AS INTEGER) AS n_licences
FROM named"""
