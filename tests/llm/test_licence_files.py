"""Licence files, standard headers and SPDX lines, as they stand in real trees."""

from importlib import resources

from rolesift.llm import licences

APACHE = "\n".join(f" * {x}" for x in """Copyright 2020 Acme

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""".split("\n"))
CODE = "\n".join(f"def part{i}(x): return x + other{i}" for i in range(40))


def full(name):
    return (resources.files("rolesift.llm") / "licence_texts" / f"{name}.txt").read_text()


CASES = [
    ("a/one", "MIT License\n\nCopyright (c) 2020 Acme. All rights reserved.\n\n" + full("MIT"), "MIT", "own"),
    ("a/b/c/d/code", CODE, "MIT", "inherited"),
    ("g/COPYING", full("GPL-3.0"), "GPL-3.0", "own"),
    ("g/h/code", CODE, "GPL-3.0", "inherited"),
    ("g/h/mit/LICENSE", "The MIT License (MIT)", "MIT", "own"),
    ("g/h/mit/x/code", CODE, "MIT", "inherited"),
    ("t/1", full("GPL-2.0"), "GPL-2.0", "own"),
    ("u/1", full("LGPL-3.0"), "LGPL-3.0", "own"),
    ("v/1", full("MPL-2.0"), "MPL-2.0", "own"),
    ("w/1", full("Apache-2.0"), "Apache-2.0", "own"),
    ("x/1", full("BSD-3-Clause").replace("The Regents of the University of California", "Acme"), "BSD-3-Clause", "own"),
    ("y/1", "/*\n" + APACHE + "\n */\n" + CODE, "Apache-2.0", "own"),
    ("y/2", "Copyright 2020 Acme. Licensed under the Apache License, Version 2.0.", "Apache-2.0", "own"),
    ("y/3", "#!/bin/sh\n# SPDX-License-Identifier: Apache-2.0\n" + CODE, "Apache-2.0", "own"),
    ("y/4", "// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0", "own"),
    ("n/5", "// SPDX-License-Identifier: GPL-1.0-only\n" + CODE, None, "none"),
    ("z/6", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", "GPL-3.0", "own"),
    ("q/7", "We take a trip to a public place and a general meeting about free software.", None, "none"),
    ("q/8", "Copyright Acme. All rights reserved.\n" + CODE, "All-rights-reserved", "own"),
]


def test_licence_files_and_headers(spark):
    rows = [(i, path, text) for i, (path, text, _, _) in enumerate(CASES)] + [(1000 + i, f"plain/{i}", f"word{i} the of and or to in this that with line {i}") for i in range(200)]
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][2:]] == []
    assert {got[i] for i in got if i >= 1000} == {(None, "none")}
