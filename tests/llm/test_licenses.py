import math
import pathlib
import textwrap
from collections import Counter

import pytest

from estima.llm import common
from estima.llm import licenses as lc
from estima.llm.queries import op1_license_scan

FILES = [
    (1, "app/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    (2, "app/src/main.py", "print(1)"),
    (3, "app/src/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (4, "app/src/vendor/deep/er/x.py", "code"),
    (5, "app/src/y.py", "Licensed under the Apache License, Version 2.0.\n" + "code " * 100),
    (6, "other/z.py", "nothing"),
    (7, "z.py", None),
    (8, None, "Released under the MIT License."),
    (9, None, "words"),
    (10, "app/src/long.py", "word " * 100_000 + "\nSome text. Licensed under CC BY-NC 4.0. More text\n" + "word " * 100_000),
    (11, "app/src/not.py", "My driving licence expired and I need another permission from the office soon."),
    (12, "short/notice.txt", "Released under the MIT License.\nHello there friend"),
    (13, "short/sub/a.txt", "text"),
    (2, "app/src/main.py", "print(1)"),
    (14, "app//odd/./b", ""),
    (15, "", "text"),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, p, t, "clash", 0) for i, p, t in FILES], "file long, path string, text string, license string, score int")
    return lc.scan_licenses(df).collect()


def test_own_and_inherited(got):
    by = {r["file"]: r for r in got}
    assert len(got) == len(FILES)
    own = {i: r["own_license"] for i, r in by.items()}
    assert own == {1: "MIT", 2: None, 3: "GPL-3.0", 4: None, 5: "Apache-2.0", 6: None, 7: None, 8: "MIT", 9: None, 10: "CC-BY-NC-4.0", 11: None, 12: "MIT", 13: None, 14: None, 15: None}
    final = {i: (r["license"], r["inherited_from"]) for i, r in by.items() if r["own_license"] is None}
    assert final == {2: ("MIT", "app"), 4: ("GPL-3.0", "app/src/vendor"), 6: (None, None), 7: (None, None), 9: (None, None), 11: ("MIT", "app"), 13: ("MIT", "short"), 14: ("MIT", "app"), 15: (None, None)}
    assert {i for i, r in by.items() if r["is_licence_file"]} >= {1, 3, 12} and not by[5]["is_licence_file"] and not by[10]["is_licence_file"]


def test_scores_against_a_plain_cosine(got):
    documents = [Counter(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()) for _, t in lc.TEMPLATES]
    frequency = Counter(w for d in documents for w in d)
    idf = lambda w: math.log((1 + len(documents)) / (1 + frequency[w])) + 1 if w in frequency else math.log(1 + len(documents)) + 1

    def cosine(a, b):
        va, vb = ({w: n * idf(w) for w, n in x.items()} for x in (a, b))
        return sum(va[w] * vb.get(w, 0) for w in va) / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))

    notice = Counter("licensed under cc by nc 4 0".split())
    best = max(cosine(notice, d) for d in documents)
    assert {r["file"]: r["score"] for r in got}[10] == pytest.approx(best, abs=1e-5) and best == pytest.approx(1)


def commented(mark, text, width=70):
    return "\n".join(f"{mark} {x}".rstrip() for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""])) + "\n\ncode = 1\n" * 30


def test_standard_headers(spark):
    gpl = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.\n\nThis {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
    asf = "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.  See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    bsd = "Copyright (c) 2015, Some Body\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    want = [
        ("// SPDX-License-Identifier: Apache-2.0\nx", "Apache-2.0"), ("# SPDX-License-Identifier: MIT\nx", "MIT"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
        ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\n// All rights reserved.", "(MIT OR GPL-2.0)"),
        (commented("#", gpl.format("program", ":", "", 3, "program")), "GPL-3.0"), (commented(" *", gpl.format("program", ";", "", 2, "program"), 50), "GPL-2.0"),
        (commented("//", gpl.format("library", ";", "Lesser ", "2.1", "library")), "LGPL-2.1"), (commented("#", gpl.format("program", ":", "Affero ", 3, "program")), "AGPL-3.0"),
        (commented("//", "Copyright 2020 The Authors\n" + apache), "Apache-2.0"), (commented("#", asf), "Apache-2.0"), (commented(";;", bsd), "BSD-3-Clause"), (commented(" *", mit, 60), "MIT"),
        (mpl, "MPL-2.0"), ("/* Copyright 2021 A. All rights reserved. */", "Proprietary"), ("She has permission to drive\nwith a licence of the city.", None),
    ]
    df = spark.createDataFrame([(i, f"f{i}/x.c", t) for i, (t, _) in enumerate(want)], "file long, path string, text string")
    got = {r["file"]: r["own_license"] for r in lc.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(want))] == [x for _, x in want]


@pytest.mark.parametrize("name, want", [("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")])
def test_licence_files(spark, name, want):
    path = pathlib.Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("no such text here")
    df = spark.createDataFrame([(1, "a/LICENSE", path.read_text()), (2, "a/b/x.c", "code")], "file long, path string, text string")
    assert {r["license"] for r in lc.scan_licenses(df).collect()} == {want}


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("c.txt",), ("",), (None,), ("/abs/x",)], "p string")
    got = df.select(lc.parent(df.p).alias("d"), lc.ancestors(lc.parent(df.p)).alias("a")).collect()
    assert [(r["d"], r["a"]) for r in got] == [("a/b", ["a/b", "a", ""]), ("", [""]), (None, None), (None, None), ("/abs", ["abs", ""])]


def test_ties_in_a_directory(spark):
    df = spark.createDataFrame([(1, "d/LICENSE", "All rights reserved."), (2, "d/COPYING", "Released under the MIT License."), (3, "d/x", "code")], "file long, path string, text string")
    assert {r["file"]: r["license"] for r in lc.scan_licenses(df).collect()}[3] == "MIT"  # equal scores: the first name


def test_empty_table(spark):
    assert lc.scan_licenses(spark.createDataFrame([], "file long, path string, text string")).count() == 0


def test_no_python_on_the_executors(spark, sf):
    plan = op1_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_licence_files_of_the_query(spark):
    """Each tenth document is a licence file by name, though its notice is a small part of it."""
    rows = op1_license_scan(spark, "/root/testdata/sf0.01").where("path like '%/LICENSE.%'").collect()
    assert len(rows) == 100 and any(r["own_license"] for r in rows)
    assert all(r["is_licence_file"] == (r["own_license"] is not None) for r in rows)


def test_files_that_are_done_with_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    df = spark.createDataFrame(FILES, "file long, path string, text string")
    assert len(lc.scan_licenses(df).collect()) == len(FILES)
    assert {p.name.split("-")[1] for p in tmp_path.iterdir()} == {"notices", "own", "nearest"}  # what the result itself is read from


def test_the_shared_folder_without_a_setting(spark, monkeypatch):
    monkeypatch.setattr(common, "_LOCAL", [])

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("Context", (), {"master": "local[2]"})  # noqa: N815

    assert common.shared_dir(Unset) == common.shared_dir(Unset)
    Unset.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Unset)
