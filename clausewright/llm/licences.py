"""Licence scans by sentence rules, with SQL functions only (operator 4).

A text becomes its words with marks between sentences. A full stop, question or exclamation mark before white space and a blank line end a sentence;
a line break, and a semicolon or colon before white space, may end one or run on within it, as canonical notices are wrapped in many ways. Comment signs
at line starts are no words. Known licence sentences, from such a mark to such a mark, map to identifiers by a table of fixed size, the longer ones
first; the sequence of identifiers of a document is matched, left to right, against ordered rules, again the longer ones first. All of it
happens within the row: nothing is joined or shuffled.

Cases: null and empty texts, and texts without a known sentence, have no licences; sentences between two known ones don't separate
them; a repeated licence is listed once, in order of first appearance, and counted each time; identifiers that no rule takes are reported as
``unmatched``; very long texts, and rows without or with a repeated doc_id, are treated like others; repeated documents stay repeated; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GPL = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
# Licence sentences by identifier, as they are printed. Case and punctuation don't count.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-1": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2": "you may not use this file except in compliance with the License",
    "apache-3": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-at": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-urls": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License",
    "mit-title": "The MIT License (MIT)",
    "mit-short": "Released under the MIT License",
    "mit-short2": "Licensed under the MIT License",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "mit-whole": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-1b": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-4": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "gpl3-short": "This work is licensed under the GNU General Public License version 3",
    "gpl-1": "This program is free software",
    "gpl-2": _GPL.format(""),
    "gpl-v3": _LATER.format("3"),
    "gpl-v2": _LATER.format("2"),
    "gpl3-whole": f"This program is free software: {_GPL.format('')}, {_LATER.format('3')}",
    "gpl2-whole": f"This program is free software; {_GPL.format('')}; {_LATER.format('2')}",
    "gpl3-only": f"This program is free software: {_GPL.format('')}, version 3 of the License",
    "gpl3-only2": f"This program is free software: {_GPL.format('')}, version 3",
    "gpl2-only": f"This program is free software; {_GPL.format('')}; version 2 of the License",
    "gpl2-only2": f"This program is free software; {_GPL.format('')}; version 2",
    "lgpl21-whole": f"This library is free software; {_GPL.format('Lesser')}; {_LATER.format('2.1')}",
    "lgpl3-whole": f"This library is free software: {_GPL.format('Lesser')}, {_LATER.format('3')}",
    "lgpl3-program": f"This program is free software: {_GPL.format('Lesser')}, {_LATER.format('3')}",
    "agpl3-whole": f"This program is free software: {_GPL.format('Affero')}, {_LATER.format('3')}",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License v2.0",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-copy2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl2-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl-1": "Distributed under the Boost Software License, Version 1.0",
    "unlicense-1": "This is free and unencumbered software released into the public domain",
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-2": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-short": "Released under CC0 1.0",
    "reserved": "All rights reserved",
}
# Rules as (licence, identifiers in order).
RULES = (
    ("Apache-2.0", ("apache-1", "apache-2", "apache-3", "apache-basis", "apache-limits")),
    ("Apache-2.0", ("apache-1", "apache-2", "apache-at", "apache-url", "apache-basis", "apache-limits")),
    ("Apache-2.0", ("apache-1", "apache-2", "apache-at", "apache-urls", "apache-basis", "apache-limits")),
    ("Apache-2.0", ("apache-1", "apache-2", "apache-3")),
    ("Apache-2.0", ("apache-1", "apache-2", "apache-at", "apache-url")),
    ("Apache-2.0", ("apache-1", "apache-2", "apache-at", "apache-urls")),
    ("Apache-2.0", ("apache-1",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-title", "mit-1", "mit-2", "mit-whole", "mit-liability")),
    ("MIT", ("mit-1", "mit-2", "mit-whole", "mit-liability")),
    ("MIT", ("mit-1", "mit-2", "mit-whole")),
    ("MIT", ("mit-2", "mit-whole", "mit-liability")),
    ("MIT", ("mit-2", "mit-whole")),
    ("MIT", ("mit-2", "mit-3")),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short2",)),
    ("ISC", ("isc-1", "isc-warranty")),
    ("ISC", ("isc-1b", "isc-warranty")),
    ("0BSD", ("0bsd-1", "isc-warranty")),
    ("BSD-4-Clause", ("bsd-1", "bsd-2", "bsd-binary", "bsd-4")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-binary", "bsd-3")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2")),
    ("GPL-3.0-or-later", ("gpl-1", "gpl-2", "gpl-v3")),
    ("GPL-2.0-or-later", ("gpl-1", "gpl-2", "gpl-v2")),
    ("GPL-3.0-or-later", ("gpl3-whole",)),
    ("GPL-2.0-or-later", ("gpl2-whole",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-3.0-only", ("gpl3-only2",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-only", ("gpl2-only2",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("LGPL-2.1-or-later", ("lgpl21-whole",)),
    ("LGPL-3.0-or-later", ("lgpl3-whole",)),
    ("LGPL-3.0-or-later", ("lgpl3-program",)),
    ("AGPL-3.0-or-later", ("agpl3-whole",)),
    ("MPL-2.0", ("mpl-2", "mpl-copy")),
    ("MPL-2.0", ("mpl-2", "mpl-copy2")),
    ("MPL-2.0", ("mpl-1",)),
    ("MPL-2.0", ("mpl-2",)),
    ("EPL-2.0", ("epl2-1",)),
    ("BSL-1.0", ("bsl-1",)),
    ("Unlicense", ("unlicense-1",)),
    ("Zlib", ("zlib-1", "zlib-2")),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC0-1.0", ("cc0-short",)),
    ("all-rights-reserved", ("reserved",)),
)


def normalised(sentence: str) -> str:
    """Lower-case letters and digits, with single spaces between words."""
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def marked(text):
    """The words of a text, with ``; ;`` where a sentence ends and ``, ,`` where it may end or run on. An abbreviated version ("v. 2.0") ends none."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"\bv\.[ \t\n]+", "v ")
    text = F.regexp_replace(text, r"\n([^a-z0-9\n]*\n)+", "\u0001")
    text = F.regexp_replace(text, "[.!?][\"')]*[ \t\n\u0001]+", "\u0001")
    text = F.regexp_replace(text, "\n|[;:][ \t]+", "\u0002")
    text = F.regexp_replace(text, "[^a-z0-9\u0001\u0002]+", " ")
    text = F.replace(F.replace(text, F.lit("\u0001"), F.lit(" ; ; ")), F.lit("\u0002"), F.lit(" , , "))
    return F.regexp_replace(F.concat(F.lit("; ; "), text, F.lit(" ; ;")), " +", " ")


def identifiers(text, known: dict[str, str]):
    """The identifiers of the known sentences of a text, in order; longer sentences come first where several begin."""
    of = {normalised(s): i for i, s in known.items()}
    ordered = sorted(of, key=lambda s: (-len(s.split()), s))
    phrase = "|".join(s.replace(" ", " (?:, , )*") for s in ordered)
    found = F.regexp_extract_all(marked(text), F.lit(f"[;,] ({phrase}) [;,]"), F.lit(1))
    names = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    return F.transform(found, lambda s: names[F.regexp_replace(s, ", , ", "")])


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, licences, n_matches, n_sentences, unmatched."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))  # stable: the given order among equals
    keys = {"".join(f"<{i}>" for i in ids): name for name, ids in ordered}
    names = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    rows = docs.select("doc_id", identifiers(F.col("text"), known).alias("ids"))
    rows = rows.withColumn("chain", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    taken = F.transform(F.regexp_extract_all("chain", F.lit("(" + "|".join(keys) + ")"), F.lit(1)), lambda x: names[x])
    left = F.regexp_extract_all(F.regexp_replace("chain", "|".join(keys), ""), F.lit("<([^>]*)>"), F.lit(1))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), taken.alias("taken"), left.alias("unmatched"))
    return rows.select("doc_id", F.array_distinct("taken").alias("licences"), F.size("taken").cast("long").alias("n_matches"), "n_sentences", "unmatched")
