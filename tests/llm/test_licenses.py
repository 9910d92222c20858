"""Licences: notices of all kinds, the directories above, brute force over whole trees, odd tables."""

import pytest

from terrafold.llm import licenses
from terrafold.llm.common import stage

GPL = """/*
 * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version {}
 * of the License, or (at your option) any later version.
 */
int x = 1;
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
SAID = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "SPDX-License-Identifier: Foo-1.0": None,
    "Copyright 2020 Jane Doe. Released under the MIT License.": "MIT",
    "word " * 18 + "end. This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    GPL.format(2): "GPL-2.0",
    GPL.format(3): "GPL-3.0",
    GPL.format(3).replace("GNU General", "GNU Affero General"): "AGPL-3.0",
    GPL.format("2.1").replace("GNU General", "GNU Lesser General"): "LGPL-2.1",
    BSD: "BSD-2-Clause",
    BSD + THIRD: "BSD-3-Clause",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
    "Mozilla Public License 2.0": "MPL-2.0",
    "# Licensed under the Apache License, Version 2.0\n" + "value = other + more\n" * 5: "Apache-2.0",
    "Copyright (c) 2019 Some One\nAll rights reserved.": "Proprietary",
    "The driver showed a license to the general public, and all was well.": None,
    "Mit der Zeit kam der Rat.": None,
}


def test_notices():
    known = licenses.Templates()
    for text, want in SAID.items():
        got = known.score(text, False)
        assert (got and known.licenses[got[1]]) == want, text


def tree(draw):
    names = ["LICENSE", "COPYING.txt", "a.py", "b/c.md", "notes.txt"]
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "no words of it", None, ""]
    rows = []
    for k in range(200):
        depth = draw.randrange(4)
        folder = "".join(f"{draw.choice('xyz')}/" for _ in range(depth))
        rows.append((k if k % 17 else None, folder + draw.choice(names) if k % 23 else None, draw.choice(texts)))
    return rows


def test_inheritance_brute_force(spark):
    import random
    import re
    from collections import Counter

    rows, known = tree(random.Random(3)), licenses.Templates()
    is_file = lambda p: bool(re.search(licenses.LICENSE_NAME, p))
    own = [(g[0], known.licenses[g[1]]) if (g := known.score(t, bool(p and is_file(p)))) else None for _, p, t in rows]
    want = Counter()
    for (i, path, _), mine in zip(rows, own):
        if mine:
            want[i, path, mine[1], mine[0], "header", path] += 1
            continue
        found, at = None, path.rpartition("/")[0] if path else None
        while at is not None and found is None:
            held = [(-o[0], p, o[1]) for (_, p, _), o in zip(rows, own) if p and o and is_file(p) and p.rpartition("/")[0] == at]
            found = min(held, default=None)
            at = at.rpartition("/")[0] if at else None
        want[(i, path, found[2], -found[0], "directory", found[1]) if found else (i, path, None, None, "none", None)] += 1
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = licenses.scan_licenses(df, id_col="id").collect()
    assert Counter((r.id, r.path, r.license, r.score, r.origin, r.origin_path) for r in got) == want


def test_odd_tables(spark):
    schema = "doc_id long, path string, text string, license int, score string, of int, dir string, template string"
    mit = "Released under the MIT License."
    rows = [(None, None, mit), (1, None, None), (2, "", ""), (3, "LICENSE", mit), (3, "LICENSE", mit), (4, "x", "word " * 300_000 + ".\n" + mit), (5, "/abs/y", None)]
    df = stage(spark.createDataFrame([(*r, 1, "s", 2, "d", "t") for r in rows], schema), "files")
    got = sorted(((r.doc_id or 0, r.license, r.origin) for r in licenses.scan_licenses(df, id_col="doc_id").collect()), key=str)
    want = [(0, "MIT", "header"), (1, None, "none"), (2, "MIT", "directory"), (3, "MIT", "header"), (3, "MIT", "header"), (4, "MIT", "header"), (5, "MIT", "directory")]
    assert got == sorted(want, key=str)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_query_with_null_ids(spark, tmp_path):
    rows = [(None, "SPDX-License-Identifier: MIT", None, None), (7, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.path, r.license) for r in licenses.op9_licenses(spark, str(tmp_path)).collect()}
    assert got == {(None, "-/-/-", "MIT"), (7, "s/en/7", None)}


@pytest.mark.parametrize("path", ["LICENSE", "a/COPYING", "a/licence.md", "UNLICENSE", "x/NOTICE-2"])
def test_names(spark, path):
    df = spark.createDataFrame([(path,), ("src/licenses.py",)], "path string")
    assert [r.path for r in df.where(df.path.rlike(licenses.LICENSE_NAME)).collect()] == [path]


@pytest.mark.parametrize("width", [20, 32, 50, 80, 200])
def test_line_width_changes_no_licence(width):
    import textwrap

    known = licenses.Templates()
    for spdx in ("BSD-2-Clause", "BSD-3-Clause", "MIT"):
        notice = [text for name, text in licenses.NOTICES if name == spdx][-1].lower()
        text = f"Copyright (c) 2020 X\n\n{textwrap.fill(notice, width)}\n\nimport os\n" + "def f(x): return x\n" * 50
        got = known.score(text, False)
        assert known.licenses[got[1]] == spdx


def test_blank_lines_do_not_end_a_run():
    known = licenses.Templates()
    got = known.score("\n" * 5000 + "Licensed under the Apache License," + "\n" * 3000 + "Version 2.0", False)
    assert known.licenses[got[1]] == "Apache-2.0"


@pytest.mark.parametrize("text,spdx", [("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "MIT OR Apache-2.0"), ("Licensed under the Eclipse Public License 2.0", "EPL-2.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Released under the zlib license", "Zlib")])
def test_more_licences(text, spdx):
    known = licenses.Templates()
    assert known.licenses[known.score(text, False)[1]] == spdx
