import random

import pytest

from ledgerloom.llm import licenses
from ledgerloom.llm.license_texts import TEMPLATES

T = licenses.Templates()
TEXT = {(a, b): " ".join(c.split()) for a, b, c in TEMPLATES}


def found(text):
    raw = text.encode()
    return [(lic, name, c, raw[a:b].decode()) for lic, name, c, a, b in licenses.scan(raw, T)]


def test_every_template_is_found_alone(prose):
    for (lic, name), text in TEXT.items():
        got = found(f"{prose(30, 1)}\n{text}\n{prose(30, 2)} é")
        assert [x[:3] for x in got] == [(lic, name, 1)], got


@pytest.mark.parametrize(
    "text,want",
    [
        (TEXT["GPL-3.0", "header 0"], {"GPL-3.0"}),
        (TEXT["GPL-2.0", "header 1"].replace("software:", "software;").replace("this program. If", "this program; if"), {"GPL-2.0"}),
        (TEXT["GPL-3.0", "header 0"].replace("General", "Lesser General").replace("program", "library"), {"LGPL-3.0"}),
        (TEXT["GPL-3.0", "header 0"].replace("General", "Affero General"), {"AGPL-3.0"}),
        (TEXT["GPL-3.0", "header 0"].replace("version 3", "version 4"), set()),
        (TEXT["BSD-2-Clause", "text"], {"BSD-2-Clause"}),
        (TEXT["BSD-3-Clause", "text"], {"BSD-3-Clause"}),
        (TEXT["CC-BY-4.0", "notice"].replace("Attribution", "Attribution-ShareAlike").replace("/by/", "/by-sa/"), {"CC-BY-SA-4.0"}),
        (TEXT["CC-BY-4.0", "notice"].replace("Attribution", "Attribution-NonCommercial").replace("/by/", "/by-nc/"), {"CC-BY-NC-4.0"}),
        ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
        ("Licensed under CC BY 2.5.", set()),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License.", set()),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("Released under the BSD License.", set()),
        (TEXT["LGPL-2.1", "header 0"].replace("This library", "This program"), {"LGPL-2.1"}),
        (TEXT["LGPL-3.0", "header 1"].replace("This library", "FFmpeg").replace("this library", "FFmpeg"), {"LGPL-3.0"}),
        (TEXT["GPL-3.0", "header 0"].replace("This program", "This library").replace("this program", "this library"), {"GPL-3.0"}),
        (TEXT["LGPL-2.1", "first paragraph"].replace("This library", "FFmpeg"), {"LGPL-2.1"}),
        (TEXT["AGPL-3.0", "first paragraph"], {"AGPL-3.0"}),
        ("GNU Library General Public License, version 2.", set()),
        ("// SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}),
        ("SPDX-License-Identifier: GPL-3.0-or-later", {"GPL-3.0"}),
        ("SPDX-License-Identifier: LGPL-3.0-only", {"LGPL-3.0"}),
        ("SPDX-License-Identifier: BSD-2-Clause", {"BSD-2-Clause"}),
        ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", {"CC-BY-NC-SA-4.0"}),
        ("SPDX-License-Identifier: GPL-1.0", set()),
        ("SPDX-License-Identifier: Beerware", set()),
        ("This is not licensed under the MIT License.", set()),
        ("It was never released under the MIT License.", set()),
        ("This does not matter. Some more words follow here. Released under the MIT License.", {"MIT"}),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.", {"GPL-3.0"}),
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", {"LGPL-2.1"}),
        (TEXT["ISC", "text"], {"ISC"}),
        (TEXT["0BSD", "text"], {"0BSD"}),
        (TEXT["MIT", "text"].replace("AUTHORS", "FREE SOFTWARE FOUNDATION"), {"MIT"}),
    ],
)
def test_alike_licenses(text, want):
    assert {x[0] for x in found(f"Some words. {text} Other words.")} == want


def test_words_put_in_count():
    words = TEXT["Apache-2.0", "line"].split()
    got = found(" ".join([*words[:4], "well", "known", *words[4:]]))
    assert [x[:3] for x in got] == [("Apache-2.0", "line", round(8 / 10, 4))]


def at_every_place(text, coverage=licenses.COVERAGE):
    """Licenses by alignment of every template with the whole text, without fingerprints or bands."""
    raw = text.encode().lower()
    words = licenses.WORD.findall(raw)
    ids = [T.vocabulary.get(w, 0) for w in words]
    out = []
    for t, template in enumerate(T.words):
        m, a, b, between = licenses.align(template, ids, (len(ids) - len(template)) // 2, len(ids) + len(template))
        c = licenses.coverage_of(m, len(template), between, b - a)
        if c >= coverage and T.agrees(t, words[a:b]) and not T.denied(t, words[max(0, a - 3) : a], words[a:b]):
            out.append((-m, -c, a, b, *T.names[t]))
    return [(x[4], x[5], round(-x[1], 4)) for x in sorted(out)[:1]]


def test_against_alignment_at_every_place(prose):
    rng = random.Random(3)
    for k, ((lic, name), text) in enumerate(sorted(TEXT.items())):
        words = text.split()
        for _ in range(len(words) // 12):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice(([], [words[i], "put"], ["changed"]))
        changed = f"{prose(5, k)} {' '.join(words)} {prose(5, k + 1)}"
        want = at_every_place(changed)
        assert [x[:3] for x in found(changed)][: len(want)] == want and (want or not found(changed)), (lic, name)


def test_changed_texts(prose):
    words = TEXT["MIT", "text"].split()
    del words[40:44]
    words[90] = "changed"
    words[120:120] = ["put", "in"]
    got = [x for x in found(f"{prose(300, 3)} {' '.join(words).upper()} {prose(9, 4)}") if x[0] == "MIT"]
    assert len(got) == 1 and 0.9 < got[0][2] < 1 and got[0][3].startswith("PERMISSION IS") and got[0][3].endswith("THE SOFTWARE")
    assert found(" ".join(words[:60])) == [] and found(prose(3000, 8)) == []


def test_two_places():
    line = TEXT["GPL-3.0", "line"]
    assert [x[:3] for x in found(f"{line} words between {line}")] == [("GPL-3.0", "line", 1.0)] * 2


def test_winnowing_guarantee():
    prints = [7, 3, 9, 3, 3, 8, 1, 1, 5, 2, 6]
    places = licenses.winnow(prints, 4)
    assert all(any(k <= p < k + 4 for p in places) for k in range(len(prints) - 3)) and licenses.winnow([], 4) == [] and licenses.winnow([4, 2], 4) == [1]


def test_frame(spark, docs_of, prose):
    mit = TEXT["MIT", "line"]
    rows = [(1, None), (2, ""), (3, "é🙂 " + mit), (3, "é🙂 " + mit), (4, prose(60_000, 1) + " " + mit), (None, "Licensed")]
    got = licenses.find_licenses(docs_of(rows)).collect()
    assert len(got) == 6
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert [text[x.start : x.end] for x in r.found] == ([mit[:-1]] if mit in text else [])
    assert licenses.find_licenses(docs_of([])).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lines = {lic: t for (lic, name), t in TEXT.items() if name == "line"}
    for r in licenses.op7_licenses(spark, sf_dir).collect():
        assert {lic for lic, t in lines.items() if t in texts[r.doc_id].split("\n")} <= set(r.licenses.split(",")), r
