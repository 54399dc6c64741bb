"""Licence scans by sentence rules; DataFrame functions only.

A text is normalised (lower case, runs of other characters than a-z and 0-9 become one space) with marks where it may be cut: sentence ends, line ends, blank
lines, list markers and colons.  Known licence sentences that stand between two marks, whatever line ends they hold themselves, give one sequence of sentence
identifiers.  An ordered list of rules, each a sequence of identifiers, is then matched against it: a rule holds if its identifiers occur in its order.  A rule may
give way to another one that holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences and the sentences themselves, from the public licence texts.
SENTENCES = {
    "mit-statement": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-title": ["MIT License", "The MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ],
    "apache-statement": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    ],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl3-statement": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-grant": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by-nc-statement": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-statement": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "reserved": ["All rights reserved."],
}
# Fixed values: (licence, sequence of sentence identifiers, licences that it gives way to), in order of preference.
RULES = (
    ("MIT", ("mit-grant", "as-is"), ()),
    ("MIT", ("mit-statement",), ()),
    ("MIT", ("mit-title", "as-is"), ()),
    ("Apache-2.0", ("apache-statement", "apache-copy"), ()),
    ("Apache-2.0", ("apache-statement",), ()),
    ("GPL-3.0", ("gpl-grant", "gpl-hope"), ()),
    ("GPL-3.0", ("gpl3-statement",), ()),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ()),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), ("BSD-3-Clause",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-statement",), ()),
    ("CC-BY-4.0", ("cc-by-statement",), ()),
    ("proprietary", ("reserved",), ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "CC-BY-NC-4.0", "CC-BY-4.0")),
)
_GRANT, _, _NOTICE = SENTENCES["mit-grant"][0].partition(": ")
_OBTAIN, _, _BASIS = SENTENCES["apache-copy"][0].partition(" http://www.apache.org/licenses/LICENSE-2.0 ")
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
# Pieces of the sentences above, and further licences; the SQL below doesn't have these.
MORE_SENTENCES = {
    "mit-permission": [_GRANT],
    "mit-notice": [_NOTICE, _NOTICE.replace("notice shall", "notice (including the next paragraph) shall")],
    "apache-obtain": [_OBTAIN],
    "apache-basis": [_BASIS],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl2-grant": [_GNU.format("program", ";", "General Public License", ";", "2")],
    "lgpl21-grant": [_GNU.format("library", ";", "Lesser General Public License", ";", "2.1")],
    "lgpl3-grant": [_GNU.format(x, ":", "Lesser General Public License", ",", "3") for x in ("program", "library")],
    "agpl3-grant": [_GNU.format("program", ":", "Affero General Public License", ",", "3")],
    "gpl-hope": [_HOPE.format("library")],
    "gpl2-statement": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3-statement": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl21-statement": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "lgpl3-statement": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl3-statement": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "bsd3-statement": ["SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2-statement": ["SPDX-License-Identifier: BSD-2-Clause"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-statement": ["SPDX-License-Identifier: ISC"],
    "mpl2-statement": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain."],
    "unlicense-statement": ["SPDX-License-Identifier: Unlicense"],
    "cc0-statement": ["This work is licensed under a Creative Commons Zero v1.0 Universal License.", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by-sa-statement": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
}
_MORE_RULES = (
    ("MIT", ("mit-permission", "as-is"), ()),
    ("Apache-2.0", ("apache-title",), ()),
    ("GPL-3.0", ("gpl3-title", "gnu-verbatim"), ()),
    ("BSD-3-Clause", ("bsd3-statement",), ()),
    ("BSD-2-Clause", ("bsd2-statement",), ()),
    ("GPL-2.0", ("gpl2-grant", "gpl-hope"), ()),
    ("GPL-2.0", ("gpl2-title", "gnu-verbatim"), ()),
    ("GPL-2.0", ("gpl2-statement",), ()),
    ("LGPL-2.1", ("lgpl21-grant", "gpl-hope"), ()),
    ("LGPL-2.1", ("lgpl21-title", "gnu-verbatim"), ()),
    ("LGPL-2.1", ("lgpl21-statement",), ()),
    ("LGPL-3.0", ("lgpl3-grant", "gpl-hope"), ()),
    ("LGPL-3.0", ("lgpl3-title", "gnu-verbatim"), ()),
    ("LGPL-3.0", ("lgpl3-statement",), ()),
    ("AGPL-3.0", ("agpl3-grant", "gpl-hope"), ()),
    ("AGPL-3.0", ("agpl3-title", "gnu-verbatim"), ()),
    ("AGPL-3.0", ("agpl3-statement",), ()),
    ("ISC", ("isc-grant",), ()),
    ("ISC", ("isc-statement",), ()),
    ("MPL-2.0", ("mpl2-statement",), ()),
    ("Unlicense", ("unlicense-grant",), ()),
    ("Unlicense", ("unlicense-statement",), ()),
    ("CC0-1.0", ("cc0-statement",), ()),
    ("CC-BY-SA-4.0", ("cc-by-sa-statement",), ()),
)
#: The last rule gives way to every other one.
ALL_RULES = (*RULES[:-1], *_MORE_RULES, (*RULES[-1][:2], tuple(dict.fromkeys(n for n, _, _ in (*RULES[:-1], *_MORE_RULES)))))
#: Every known sentence has one of these, so texts without them are passed over.
ANCHORS = ("licens", "warrant", "permi", "redistribut", "rights reserved", "endorse", "unencumbered")


def normalised(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def known(cut_lines: bool) -> dict[str, str]:
    """Normalised sentence -> identifier, as the SQL looks them up; the same for both cuts."""
    return {normalised(s): k for k, all_ in SENTENCES.items() for s in all_}


_END = r"([.!?])[ \t\r\n]+"


#: A sentence of so many words or more is known across sentence ends too.
_LONG = 12
# Texts are lower case when marked, so capitals are free: S for a sentence end, B a blank line or list marker, C a colon, N a line end.
_MARKS = (
    (r"[.!?](?=[ \t\r\n])", " S "),
    (r"\n[ \t\r#*/;%>-]*(?=\n)", " B "),
    (r"(^|\n)([ \t#*/;%>-]*\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})\))(?=[ \t])", "$1$2 B "),
    (r":(?=[ \t\r\n])", " C "),
    (r"[\r\n]", " N "),
    (r"[^a-z0-9SBCN]+", " "),
)
# whoever "the copyright holder" is
_HOLDER = (r"(neither the name of)(?: [a-zSBCN0-9]+){1,16}?((?: [BCN])* nor(?: [BCN])* the(?: [BCN])* names(?: [BCN])* of(?: [BCN])* its)", "$1 the copyright holder$2")


def _sentences() -> dict[str, str]:
    return known(False) | {normalised(s): k for k, all_ in MORE_SENTENCES.items() for s in all_}


def _pattern() -> str:
    """Any known sentence between two marks, the longest first."""
    alternatives = []
    for s in sorted(_sentences(), key=lambda s: (-len(s), s)):
        words = s.split(" ")
        marks = "[SBCN]" if len(words) >= _LONG or s.endswith(" v 2 0") else "[BCN]"
        alternatives.append(f"(?: {marks})* ".join(words))
    return rf"(?<=^|[SBCN] )(?:{'|'.join(alternatives)})(?= [SBCN]|$)"


def _ids(text: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in _sentences().items() for x in kv))
    marked = F.lower(text)
    for pattern, to in _MARKS:
        marked = F.regexp_replace(marked, pattern, to)
    marked = F.regexp_replace(F.trim(marked), *_HOLDER)
    return F.transform(F.regexp_extract_all(marked, F.lit(_pattern()), F.lit(0)), lambda s: F.try_element_at(table, F.regexp_replace(s, " [SBCN]", "")))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_known long, sentence_ids string, licences string, licence string), one row per row of ``docs``; no shuffle.

    ``sentence_ids`` are comma-joined in order; ``licences`` all that hold in the rules' order;
    ``licence`` the first of them or null.  Null or empty text has none.  Ids may be null or repeat.  Other columns are not read.
    """
    low = F.lower(text_col)
    some = F.coalesce(F.lit(False), F.lit(False))
    for a in ANCHORS:
        some = some | F.coalesce(low.contains(a), F.lit(False))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("_own"), F.when(some, F.col(text_col)).alias("_t"))
    rows = rows.select("_own", F.when(F.col("_t").isNotNull(), _ids(F.col("_t"))).otherwise(none).alias("_ids"))
    rows = rows.select("_own", "_ids", F.concat(F.lit("["), F.array_join("_ids", "]["), F.lit("]")).alias("_s"))
    holds = [F.col("_s").like(_like(ids)) for _, ids, _ in ALL_RULES]
    of = lambda name: [h for h, (n, _, _) in zip(holds, ALL_RULES) if n == name]
    given = []
    for name in dict.fromkeys(n for n, _, _ in ALL_RULES):
        ok = _any(of(name))
        for other in dict.fromkeys(o for n, _, others in ALL_RULES if n == name for o in others):
            ok = ok & ~_any(of(other))
        given.append(F.when(ok, F.lit(name)))
    found = F.filter(F.array(*given), lambda x: x.isNotNull())
    out = rows.select("_own", "_ids", found.alias("_l"))
    return out.select(F.col("_own").alias(id_col), F.size("_ids").cast("long").alias("n_known"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join("_l", ",").alias("licences"), F.when(F.size("_l") > 0, F.col("_l")[0]).alias("licence"))


def _like(ids: tuple[str, ...]) -> str:
    return "%" + "%".join(f"[{x}]" for x in ids) + "%"


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def licences_sql(table: str = "documents") -> str:
    """SQL for DuckDB: the same result for texts whose sentences are of ``SENTENCES`` and found by one cut, at line ends too or at sentence ends alone."""

    def ids(lines: bool) -> str:
        flat = "t" if lines else r"regexp_replace(t, '[\r\n]', ' ', 'g')"
        case = " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in known(lines).items())
        norm = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
        cut = rf"string_split(regexp_replace({flat}, '{_END}', '\1' || chr(10), 'g'), chr(10))"
        return f"list_filter(list_transform({cut}, lambda s: CASE {norm} {case} END), lambda x: x IS NOT NULL)"

    holds = {}
    for name, seq, _ in RULES:
        holds.setdefault(name, []).append(f"(sa LIKE '{_like(seq)}' OR sb LIKE '{_like(seq)}')")
    unless = {n: [o for m, _, others in RULES if m == n for o in others] for n in holds}
    whole = {n: "(" + " OR ".join(h) + ")" for n, h in holds.items()}
    given = ", ".join(f"CASE WHEN {whole[n]}{''.join(f' AND NOT {whole[o]}' for o in dict.fromkeys(unless[n]))} THEN '{n}' END" for n in holds)
    return f"""
    WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
    y AS (SELECT doc_id, {ids(True)} AS a, {ids(False)} AS b FROM x),
    z AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN a ELSE b END AS ids, '[' || array_to_string(a, '][') || ']' AS sa, '[' || array_to_string(b, '][') || ']' AS sb FROM y),
    w AS (SELECT doc_id, ids, list_filter([{given}], lambda v: v IS NOT NULL) AS l FROM z)
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(l, ','), '') AS licences, l[1] AS licence FROM w"""
