"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences twice: by lines, as notices are often lines of their own, and by full stops with
lines joined, as long notices run over lines. Normalised sentences that are known map to identifiers; an
ordered rule holds when its identifiers occur in its order in either sequence, with at most STRETCH others between
two of them. A longer rule takes its sentences: what it covers does not count for a rule of another licence whose
identifiers it holds in the same order (BSD-3-Clause over BSD-2-Clause). Everything happens within a row: there is
no shuffle, and no text is cut short.

Defined cases: null and empty texts hold no sentence; a text of any length is read whole; of ties (two licences in
one text) both are named; repeated rows are treated alike; rows without doc_id too; an empty table gives an empty
result; other columns are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import text_of

# Sentences of public licence texts and notices, and the rules over them.
SENTENCES = {
    "apache-notice-file": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-copy-at": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-copy-joined": 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "artistic2-free": "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
# How short notices name a licence, and how they begin.
NAMED = {
    "0BSD": ("BSD Zero Clause License", "0BSD License"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0 License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "3-Clause BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0 License"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1 License"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0 License"),
    "MIT": ("MIT License", "MIT/X11 License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0 License"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "zlib/libpng License"),
}
CREATIVE = {"CC-BY": ("CC BY", "Attribution"), "CC-BY-SA": ("CC BY-SA", "Attribution-ShareAlike"), "CC-BY-NC": ("CC BY-NC", "Attribution-NonCommercial"), "CC-BY-ND": ("CC BY-ND", "Attribution-NoDerivatives"), "CC-BY-NC-SA": ("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), "CC-BY-NC-ND": ("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")}
BEGINNINGS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This software is released under", "This file is licensed under")
RULES = [
    ("0BSD", ["0bsd-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-see"]),
    ("Apache-2.0", ["apache-notice-file", "apache-may-not"]),
    ("Apache-2.0", ["apache-copy-at", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-copy-joined", "apache-see"]),
    ("Artistic-2.0", ["artistic2-free"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSL-1.0", ["boost-grant"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("ISC", ["isc-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope", "lgpl-see"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("MPL-2.0", ["mpl2-copy"]),
    ("Unlicense", ["unlicense-free"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
]
#: Other identifiers that may stand between two of a rule.
STRETCH = 3
#: A part of a sentence, cut at a colon or the like, has so many words at least to stand for it.
PART_WORDS = 6
# Every known sentence holds one of these.
HINTS = ("licen", "permi", "redistribut", "endorse", "warrant", "free software", "public domain", " under cc", "waived", "the mpl")


def normal(text: str) -> str:
    """The rule of normalised sentences, for the table's own: lower case, other signs than ASCII letters and
    digits to one space each run, trimmed."""
    import re

    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def notices() -> dict[str, str]:
    """Normalised short notice -> its identifier, one for each licence."""
    named = [(i, f"the {x}") for i, names in NAMED.items() for x in names]
    named += [(f"{i}-4.0", x) for i, (short, long) in CREATIVE.items() for x in (f"{short} 4.0", f"a {short} 4.0 license", f"the {short} 4.0 license", f"a Creative Commons {long} 4.0 International License", f"the Creative Commons {long} 4.0 International License")]
    named += [("CC0-1.0", x) for x in ("CC0 1.0", "the CC0 1.0 license", "the CC0 1.0 Universal Public Domain Dedication")]
    return {normal(f"{b} {x}"): f"notice-{i}" for i, x in named for b in BEGINNINGS}


def rules() -> list[tuple[str, list[str]]]:
    return [*RULES, *((i.removeprefix("notice-"), [i]) for i in dict.fromkeys(notices().values()))]


def _known() -> dict[str, str]:
    """Normalised sentence -> identifier. Long parts of a sentence that no other one holds stand for it too."""
    import re

    parts: dict[str, set[str]] = {}
    for name, text in SENTENCES.items():
        for part in re.sub(r"([.!?:;])\s+", "\\1\n", text).split("\n"):
            if any(h in part.lower() for h in HINTS) and len(normal(part).split()) >= PART_WORDS:
                parts.setdefault(normal(part), set()).add(name)
    out = {p: next(iter(names)) for p, names in parts.items() if len(names) == 1}
    return out | {normal(text): name for name, text in SENTENCES.items()} | notices()


def _pattern(ids: list[str]) -> str:
    import re

    return rf"(?:<[^>]*>){{0,{STRETCH}}}".join(f"<{re.escape(i)}>" for i in ids)


def _holds(ids: list[str], longer: list[str]) -> bool:
    rest = iter(longer)
    return len(ids) < len(longer) and all(i in rest for i in ids)


def tests_of() -> dict[str, list[tuple[str, list[str]]]]:
    """Licence -> (pattern, those of longer rules of others whose matches go first); one pattern for all of a
    licence's rules that no other rule holds."""
    out: dict[str, dict[tuple[str, ...], list[str]]] = {}
    for name, ids in rules():
        longer = tuple(_pattern(x) for n, x in rules() if n != name and _holds(ids, x))
        out.setdefault(name, {}).setdefault(longer, []).append(_pattern(ids))
    return {name: [("|".join(some), list(longer)) for longer, some in out[name].items()] for name in sorted(out)}


#: Stands for what a longer rule took: more identifiers than a rule may stretch over.
TAKEN = "<->" * (STRETCH + 1)


def _sentences(low: Column) -> Column:
    cut = F.split(F.regexp_replace(low, r"([.!?:;])\s+", "$1\n"), "\n")
    hinted = F.filter(cut, lambda s: F.rlike(s, F.lit("|".join(HINTS))))
    return F.transform(hinted, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def _identified(sentences: Column) -> Column:
    known = F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in _known().items())), F.lit("[|]"), F.lit("="))
    return F.concat(F.lit("<"), F.array_join(F.filter(F.transform(sentences, lambda s: F.element_at(known, s)), lambda x: x.isNotNull()), "><"), F.lit(">"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones, the larger of both cuts), line_ids and text_ids (identifiers in
    order, each in angle brackets) and licenses (comma-joined, in code-point order; empty if none)."""
    low = F.lower(text_of())
    some = F.rlike(F.col("low"), F.lit("|".join(HINTS)))
    out = docs.select("doc_id", low.alias("low"))
    out = out.select("doc_id", F.when(some, _identified(_sentences(F.col("low")))).otherwise("<>").alias("line_ids"), F.when(some, _identified(_sentences(F.regexp_replace("low", r"\s*\n\s*", " ")))).otherwise("<>").alias("text_ids"))
    hits = []
    for name, patterns in tests_of().items():
        found = F.lit(False)
        for pattern, longer in patterns:
            ids = F.concat("line_ids", F.lit(TAKEN), "text_ids")
            for x in longer:
                ids = F.regexp_replace(ids, x, TAKEN)
            found = found | F.rlike(ids, F.lit(pattern))
        hits.append(F.when(found, F.lit(name)))
    hit = F.array_compact(F.array(*hits))
    count = F.greatest(*[F.size(F.split(F.col(c), "<")) - 1 - (F.col(c) == "<>").cast("int") for c in ("line_ids", "text_ids")]).cast("long")
    return out.select("doc_id", count.alias("n_sentences"), "line_ids", "text_ids", F.when((F.col("line_ids") == "<>") & (F.col("text_ids") == "<>"), "").otherwise(F.array_join(hit, ",")).alias("licenses"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = _known()
    keys, names = (", ".join(lit(x) for x in v) for v in (known, known.values()))
    hints = lit("|".join(HINTS))

    def ids(src: str) -> str:
        cut = f"string_split(regexp_replace({src}, '([.!?:;])[ \\t\\n\\v\\f\\r]+', '\\1\n', 'g'), chr(10))"
        norm = f"list_transform(list_filter({cut}, lambda s: regexp_matches(s, {hints})), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))"
        hit = f"list_filter(list_transform({norm}, lambda s: [{names}][list_position([{keys}], s)]), lambda x: x IS NOT NULL)"
        return f"'<' || coalesce(array_to_string({hit}, '><'), '') || '>'"

    cases = []
    for n, patterns in tests_of().items():
        tests = []
        for pattern, longer in patterns:
            c = f"line_ids || {lit(TAKEN)} || text_ids"
            for x in longer:
                c = f"regexp_replace({c}, {lit(x)}, {lit(TAKEN)}, 'g')"
            tests.append(f"regexp_matches({c}, {lit(pattern)})")
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN {lit(n)} END")
    return f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
i AS (SELECT doc_id, {ids('low')} AS line_ids, {ids("regexp_replace(low, '[ \\t\\n\\v\\f\\r]*\n[ \\t\\n\\v\\f\\r]*', ' ', 'g')")} AS text_ids FROM t)
SELECT doc_id, greatest(len(line_ids) - len(replace(line_ids, '<', '')) - (line_ids = '<>')::INT, len(text_ids) - len(replace(text_ids, '<', '')) - (text_ids = '<>')::INT)::BIGINT AS n_sentences,
  line_ids, text_ids, coalesce(array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ','), '') AS licenses
FROM i
"""


ORACLE = _oracle()
