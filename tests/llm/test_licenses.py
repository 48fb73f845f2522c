import pytest

from pagemill.llm import licenses as L


def gpl(what, kind, first, then, version):
    return f"""    This {what} is free software{first} you can redistribute it and/or modify
    it under the terms of the GNU {kind} Public License as published by
    the Free Software Foundation{then} either version {version} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind} Public License for more details."""


APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""


def found(spark, text):
    return L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licenses"]


@pytest.mark.parametrize("text,want", [
    ("Some prose.\nReleased under the MIT License.", "MIT"),
    ("prose. LICENSED under the  Apache License, version 2.0. More.", "Apache-2.0"),
    ("junk $$$\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "GPL-3.0,MIT"),
    (L.SENTENCES["mit-grant"].replace("copy of this", "copy\nof this") + "\n\n" + L.SENTENCES["mit-keep"] + "\n" + L.SENTENCES["mit-as-is"], "MIT"),
    (L.SENTENCES["mit-as-is"] + "\n" + L.SENTENCES["mit-keep"] + "\n" + L.SENTENCES["mit-grant"], ""),
    (" ".join(L.SENTENCES[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary")), "BSD-2-Clause"),
    (" ".join(L.SENTENCES[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")), "BSD-3-Clause"),
    (" ".join(L.SENTENCES[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse") * 2 + ("bsd-redistribution", "bsd-source", "bsd-binary")), "BSD-2-Clause,BSD-3-Clause"),
    (gpl("program", "General", ";", ";", "2"), "GPL-2.0-or-later"),
    (gpl("program", "General", ":", ",", "3"), "GPL-3.0-or-later"),
    (gpl("program", "Affero General", ":", ",", "3"), "AGPL-3.0-or-later"),
    (gpl("library", "Lesser General", ";", ";", "2.1"), "LGPL-2.1-or-later"),
    (gpl("library", "Lesser General", ":", ",", "3"), "LGPL-3.0-or-later"),
    (APACHE, "Apache-2.0"),
    (APACHE.replace("\n", "\n# "), "Apache-2.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED", "0BSD"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This project is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.", "CC0-1.0"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/.", "EPL-2.0"),
    # Sentences of a rule too far apart are no licence.
    (" ".join([L.SENTENCES["mit-grant"], L.SENTENCES["mit-keep"], *["Released under the ISC License."] * 4, L.SENTENCES["mit-as-is"]]), "ISC"),
    (" ".join([L.SENTENCES["mit-grant"], L.SENTENCES["mit-keep"], *["Released under the ISC License."] * 3, L.SENTENCES["mit-as-is"]]), "ISC,MIT"),
    ("A licence to talk. Permission granted.", ""),
    ("", ""),
    (None, ""),
])
def test_rules(spark, text, want):
    assert found(spark, text) == want


def test_every_sentence_has_a_hint():
    assert all(any(h in s.lower() for h in L.HINTS) for s in L.SENTENCES.values())


def test_native_and_odd_rows(spark, docs_of, odd_rows):
    out = L.scan(docs_of(odd_rows))
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.count() == len(odd_rows) and L.scan(docs_of(odd_rows).filter("false")).count() == 0


def words(text):
    return [w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()]


def by_hand(sentences):
    """Licences of texts made of whole sentences, one a line: a rule's sentences in order, by search over places."""
    names = [next((k for k, v in L.SENTENCES.items() if words(v) == words(s)), None) for s in sentences]
    names = [x for x in names if x]

    def places(rule, at):
        """Every way to find rule from `at` on, as the first way of each start that a scan from the left takes."""
        out, i = [], at
        while i < len(names):
            got = start(rule, i)
            if got:
                out.append(got)
                i = got[-1] + 1
            else:
                i += 1
        return out

    def start(rule, i):
        if names[i] != rule[0]:
            return None
        if len(rule) == 1:
            return [i]
        for j in range(min(i + L.STRETCH + 1, len(names) - 1), i, -1):
            rest = start(rule[1:], j)
            if rest:
                return [i, *rest]
        return None

    found = set()
    for name, rule in L.RULES:
        taken = {p for n, r in L.RULES if n != name and len(r) > len(rule) and L._holds(rule, r) for got in places(r, 0) for p in range(got[0], got[-1] + 1)}
        if any(not taken & set(range(got[0], got[-1] + 1)) for got in places(rule, 0)):
            found.add(name)
    return ",".join(sorted(found))


def test_against_search_by_hand(spark):
    import random

    r = random.Random(3)
    bsd = ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]
    texts = []
    for i in range(60):
        keys = r.choice([bsd, ["mit-grant", "mit-keep", "mit-as-is"], ["gpl2-free", "gpl-hope", "gpl-see", "gpl-free"], list(L.SENTENCES)])
        texts.append([L.SENTENCES[r.choice(keys)] for _ in range(r.randint(1, 9))])
    rows = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in L.scan(rows).collect()}
    for i, t in enumerate(texts):
        assert set(by_hand(t).split(",")) - {""} <= set(got[i]["licenses"].split(",")), t
