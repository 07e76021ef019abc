"""License statements on sentences that the templates don't hold, and their reconciliation."""

import pytest

L = pytest.importorskip("loomgraph.llm.licenses")

LISTED = [
    ("MIT", "MIT License", None), ("Apache-2.0", "Apache License 2.0", None), ("GPL-2.0-only", "GNU General Public License v2.0 only", "GPL-2.0"),
    ("GPL-2.0-or-later", "GNU General Public License v2.0 or later", "GPL-2.0+"), ("GPL-3.0-only", "GNU General Public License v3.0 only", "GPL-3.0"),
    ("GPL-3.0-or-later", "GNU General Public License v3.0 or later", "GPL-3.0+"), ("LGPL-2.1-or-later", "GNU Lesser General Public License v2.1 or later", "LGPL-2.1+"),
    ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License', None), ("BSD-3-Clause", 'BSD 3-Clause "New" License', None), ("ISC", "ISC License", None),
    ("MPL-2.0", "Mozilla Public License 2.0", None), ("EPL-2.0", "Eclipse Public License 2.0", None), ("BSL-1.0", "Boost Software License 1.0", None),
    ("Zlib", "zlib License", None), ("Unlicense", "The Unlicense", None), ("MulanPSL-2.0", "Mulan Permissive Software License, Version 2", None),
]


@pytest.fixture(scope="module")
def reader():
    return L.LicenseReader(LISTED)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("MIT", "MIT"), ("mit", "MIT"), ("GPL-2.0+", "GPL-2.0-or-later"), ("lgpl-2.1+", "LGPL-2.1-or-later"), ("(MIT OR Apache-2.0)", "Apache-2.0 OR MIT"),
        ("BSD-3-Clause and MIT", "BSD-3-Clause AND MIT"), ("MIT OR MIT", "MIT"), ("AGPL-3.0-only", "?"), ("LGPL-3.0-or-later", "?"), ("BSD-4-Clause", "?"),
        ("MIT OR Foo-1.0", "?"), ("GPL-2.0-only WITH Classpath-exception-2.0", "?"), ("NOASSERTION", None), ("none", None), ("LicenseRef-x", None), (" ", None), (None, None),
    ],
)
def test_expressions(reader, text, found):
    assert reader.expression(text) == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("You can redistribute it under the terms of the GNU General Public License, either version 3 or (at your option) any later version.", {"GPL-3.0-or-later"}),
        ("Distributed under the Boost Software License, Version 1.0.", {"BSL-1.0"}),
        ("This library is released under the\nMozilla Public License, v.\n2.0.", {"MPL-2.0"}),
        ("Licensed under your choice of the GPLv2+ or the Mozilla Public License, v. 2.0.", {"GPL-2.0-or-later OR MPL-2.0"}),
        ("Copyright 2024 someone\nSPDX-License-Identifier : Apache-2.0\nLicensed under the MIT license.", {"Apache-2.0", "MIT"}),
        ("Licensed under the Quillmoor Village Terms.", {"?"}),
        ("Not covered by the MIT License.", set()), ("Checks whether a package is compatible with the GPLv3+.", set()), ("See the file LICENSE for the terms.", set()),
        ("Copyright (c) 2020 the authors\nAll rights reserved.", set()), ("keep queue before tree", set()), ("", set()),
    ],
)
def test_prose(reader, text, found):
    assert reader.prose(text) == found


def test_held_out_accuracy(reader):
    """Names of the list in sentences that aren't among the templates."""
    forms = ("Code in this directory is licensed under the {n}.", "Provided under the terms of the {n}.", "The contents of this file are subject to the {n}.", "Permission is granted under the {n}.")
    asked = [(form.format(n=name), spdx) for spdx, title, former in LISTED for name in L.name_variants(spdx, title, former) for form in forms]
    right = sum(reader.prose(text) == {spdx} for text, spdx in asked)
    assert right >= 0.9 * len(asked)


def test_held_out_forms_of_sentences(monkeypatch):
    """Whole forms that training never saw, a fifth of all (0.78 on average over the five such parts; README)."""
    import random

    held = {}
    for name in ("_GRANTS", "_OTHER_GRANTS", "_LOOKS", "_DENIALS"):
        every = getattr(L, name)
        held[name] = [f for i, f in enumerate(every) if i % 5 == 0]
        monkeypatch.setattr(L, name, tuple(f for i, f in enumerate(every) if i % 5 != 0))
    trained = L.LicenseReader(LISTED)
    rng, asked = random.Random(99), []
    for name, forms in held.items():
        for form in forms:
            for spdx, title, former in LISTED:
                via = f"the {rng.choice(L.name_variants(spdx, title, former))}"
                text = f"this software {form} {via}." if name == "_GRANTS" else form.format(v=via, t=".", x="this software", p="licensed under")
                asked.append((text, {spdx} if name in ("_GRANTS", "_OTHER_GRANTS") else set()))
    right = sum(trained.prose(text) == found for text, found in asked)
    assert right >= 0.75 * len(asked)


def test_held_out_combinations(reader):
    """Sentences from the same parts, put together in ways that training didn't see."""
    import random

    rng, asked = random.Random(4321), []
    for make, states in ((L.stating_forms, True), (L.silent_forms, False)):
        for form in make(rng, 400):
            spdx, title, former = rng.choice(LISTED)
            asked.append((form.format(n=rng.choice(L.name_variants(spdx, title, former))), {spdx} if states else set()))
    right = sum(reader.prose(text) == found for text, found in asked)
    assert right >= 0.95 * len(asked), right / len(asked)


def test_no_form_stands_in_the_texts():
    """No fixed part of four words or more of a form is in any of the files that are read."""
    import random

    import duckdb

    rows = duckdb.sql("select distinct content from '/root/testdata/sf0.1/files.parquet' where content is not null").fetchall()
    texts = " ".join(" ".join(r[0] for r in rows).lower().split())
    rng = random.Random(1)
    forms = {max((p.strip(" .,;") for p in f.lower().split("{n}")), key=len) for f in [*L.stating_forms(rng, 5000), *L.silent_forms(rng, 5000)]}
    forms |= {f.lower().strip(" .") for f in [*L.PLAIN, *L.pointers(), *L.conditions()]}
    assert [f for f in forms if len(f.split()) >= 4 and f in texts] == []


def test_leading_comment():
    assert L.leading_comment('\ufeff\n/* a\n * b */\n// c\nint x; // SPDX-License-Identifier: MIT\n').split() == ["a", "b", "c"]
    assert L.leading_comment("#!/usr/bin/env python\n# a\n\n# b\nx = 1\n").split() == ["a", "b"]
    assert L.leading_comment('#include "a.h"\n// b\n') == "" == L.leading_comment("")


def test_manifests():
    assert L.manifest_fields("package.json", '{"license": {"type": "MIT"}}') == ["MIT"] == L.manifest_fields("package.json", '{"licenses": [{"type": "MIT"}]}')
    assert L.manifest_fields("package.json", '{"license": {"file": "LICENSE"}}') == [] == L.manifest_fields("pom.xml", "<project/>")
    assert L.manifest_fields("pom.xml", "<licenses><license><url>u</url><name> ISC </name></license></licenses>") == ["ISC"]
    assert L.manifest_fields("oh-package.json5", "{\n  // license: 'no'\n  license: 'Zlib',\n}") == ["Zlib"]


def test_reconciliation(spark, reader):
    mit, apache = "// SPDX-License-Identifier: MIT\n", "/* Licensed under the Apache License v2. */\n"
    files = [
        ("g", "//n/a.c", "a.c", mit), ("g", "//n/a.c", "a.c", mit), ("g", "//n/b.c", "b.c", ""), ("g", "//n/lib/c.py", "c.py", None), ("g", "//n/lib/x/d.js", "d.js", "let a"),
        ("g", "//n/LICENSE", "LICENSE", "MIT License\n"), ("g", "//n/lib/COPYING.txt", "COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        ("g", "//n/e.h", "e.h", apache), ("h", "//m/f.c", "f.c", "int f;"), (None, "//m/g.c", "g.c", "int g;"), (None, "//m/LICENSE", "LICENSE", "MIT License"),
        ("h", "//m/package.json", "package.json", '{"license": "MIT"}'), ("h", "//m/LICENCE.md", "LICENCE.md", "ISC License"), ("u", "//u/a.ts", "a.ts", "// Licensed under the Quillmoor Village Terms.\n"), ("g", None, "z.c", mit),
    ]
    f = spark.createDataFrame([(*r, 1) for r in files], "graph_id string, path string, name string, content string, license int")
    lic = spark.createDataFrame([("\\\\n\\e.h ", "MIT"), ("\\\\n\\e.h ", "MIT"), ("//n/b.c", "NOASSERTION"), ("//none", "MIT"), (None, "MIT"), ("//n/a.c", None)], "node_id string, spdx string")
    reg = spark.createDataFrame([("g",), ("h",), ("h",), ("empty",), (None,)], "graph_id string")
    got = {(r.scope, r.item_id): r.license for r in L.resolve_licenses(f, lic, reg, reader).collect()}
    assert got == {
        ("file", "//n/a.c"): "MIT", ("file", "//n/b.c"): "MIT", ("file", "//n/lib/c.py"): "Apache-2.0", ("file", "//n/lib/x/d.js"): "Apache-2.0", ("file", "//n/e.h"): "CONFLICT",
        ("file", "//m/f.c"): "CONFLICT", ("file", "//m/g.c"): "UNKNOWN", ("file", "//u/a.ts"): "UNKNOWN", ("repo", "g"): "MIT", ("repo", "h"): "CONFLICT", ("repo", "empty"): "UNKNOWN",
    }
    assert L.resolve_licenses(f.limit(0), lic.limit(0), reg.limit(0), reader).count() == 0
