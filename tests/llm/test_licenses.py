"""Sentence identifiers and ordered rules."""

from __future__ import annotations

from clinframe.llm import licenses


def scan(spark, texts, **more):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, licenses int")
    return [(r["licenses"], r["license_sequence"]) for r in licenses.scan(df, **more).orderBy("doc_id").collect()]


def test_lines_and_order(spark):
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.\n"
        "Redistributions of source code must retain the above copyright notice.\n"
        "Redistributions in binary form must reproduce the above copyright notice."
    )
    got = scan(
        spark,
        [
            "Some text. Licensed under the Apache License, Version 2.0. More text.",
            "LICENSED  under the\tApache License Version 2.0",
            "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
            "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
            bsd,
            bsd + " Neither the name of X nor the names of its contributors may be used to endorse.",
            "\n".join(reversed(bsd.split("\n"))),
            "We talked about the MIT License and its permission notice.",
            "",
            None,
            "!!! ???",
            "Released under the MIT License.\n" * 3,
            "word " * 30000 + ".\nAll rights reserved.",
        ],
    )
    assert [g[0] for g in got] == [
        ["Apache-2.0"],
        ["Apache-2.0"],
        ["MIT", "GPL-3.0"],
        ["CC-BY-NC-4.0", "All-rights-reserved"],
        ["BSD-2-Clause"],
        ["BSD-3-Clause"],
        [],
        [],
        [],
        [],
        [],
        ["MIT"],
        ["All-rights-reserved"],
    ]
    assert got[0][1] == ".A." and got[9][1] == "" and got[10][1] == "" and got[11][1] == "MMM"


def test_gap(spark):
    known, rules = {"x": "license one", "y": "license two"}, (("both", "xy"), ("one", "x"))
    texts = ["license one. a. b. license two.", "license one. a. b. c. license two.", "license two. license one."]
    assert [g[0] for g in scan(spark, texts, sentences=known, rules=rules)] == [["both"], ["one"], ["one"]]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD_3 = BSD_2 + """
3. Neither the name of Example Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_canonical_notices(spark):
    """Wrapped, in comments of three kinds, in one line, and between lines of prose without marks."""
    notices = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD_2, "BSD-2-Clause"), (BSD_3, "BSD-3-Clause"), (GPL % ";", "GPL"), (GPL % ":", "GPL")]
    texts, want = [], []
    for notice, name in notices:
        lines = notice.split("\n")
        stars = "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint x"
        marks = ["\n".join(f"{mark} {x}" for x in lines) for mark in ("#", "//")]
        forms = [notice, stars, *marks, " ".join(notice.split()), notice.replace("\n", "\r\n"), f"Some title\n{notice}\nlast words"]
        texts += forms
        want += [[name]] * len(forms)
    assert [g[0] for g in scan(spark, texts)] == want
    assert scan(spark, [APACHE])[0][1] == "Aau.w."


def test_sentences_inside_others(spark):
    texts = [
        "This project is licensed under the MIT License.",
        "Licensed under the MIT License\nAll rights reserved\nLicensed under the MIT License",
        "This project is not licensed under the MIT License.",
        "This text is made available under the terms of the Creative Commons\nAttribution 4.0 International License",
    ]
    assert scan(spark, texts) == [(["MIT"], "M"), (["MIT", "All-rights-reserved"], "MRM"), ([], "."), (["CC-BY-4.0"], "C")]


def test_short_notices_further_licences_and_tags(spark):
    cases = {
        "This work is released under CC BY 4.0.": ["CC-BY-4.0"],
        "Released under Apache 2.0.": ["Apache-2.0"],
        "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy": ["MPL-2.0"],
        "Licensed under the GNU Lesser General Public License v2.1": ["LGPL-2.1"],
        "Licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "made available under the terms of the Eclipse Public License v. 2.0 which is": ["EPL-2.0"],
        "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided": ["ISC"],
        "2. Altered source versions must be plainly marked as such, and must not be\n misrepresented as being the original software.": ["Zlib"],
        "This is free and unencumbered software released into the public\ndomain.": ["Unlicense"],
        "The author has waived all copyright and related or neighboring rights to this work.": ["CC0-1.0"],
        "The library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": ["LGPL"],
        "# SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"],
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint main": ["GPL-2.0"],
        "/* SPDX-License-Identifier: MIT */": ["MIT"],
        "It is not released under CC BY 4.0. The tunnel runs under the river. We met v. early.": [],
    }
    assert [g[0] for g in scan(spark, list(cases))] == list(cases.values())


def test_own_sentences_need_no_hint(spark):
    assert scan(spark, ["Share it freely. Ok."], sentences={"q": "share it freely"}, rules=(("Own", "q"),)) == [(["Own"], "q.")]
