"""Licenses as they stand in source files: behind comment marks, as expressions, as short grants."""

import time

import pytest

from verbatlas.llm.licenses import compiled, detect


def labels(text):
    return {compiled()[0][i][0].label for _, _, i in detect(text)}


HEADERS = {
    "mit": """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "apache": """Licensed under the Apache
License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.""",
    "gpl": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General
Public License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version.""",
}
STYLES = {"c": (" * ", "/*\n", "\n */"), "cpp": ("// ", "", ""), "shell": ("# ", "#!/bin/sh\n", ""), "lisp": (";; ", "", ""), "sql": ("-- ", "", ""), "tex": ("% ", "", ""), "xml": ("", "<!--\n", "\n-->"), "m4": ("dnl ", "", ""), "lines": ("/* ", "", "")}


@pytest.mark.parametrize("style", STYLES)
@pytest.mark.parametrize("label", HEADERS)
def test_headers_in_comments(label, style):
    mark, before, after = STYLES[style]
    end = " */" if style == "lines" else ""
    text = before + "\n".join((mark + line + end).rstrip() if line else mark.rstrip() + end for line in HEADERS[label].split("\n")) + after + "\nint main() { return 2 * 3; }\n"
    plain, found = labels(HEADERS[label]), labels(text)
    assert label in plain and plain <= found
    for a, b, _ in detect(text):
        assert 0 <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()


EXPRESSIONS = {
    "SPDX-License-Identifier: MIT": {"mit"},
    "// SPDX-License-Identifier: (MIT AND BSD-3-Clause)": {"mit", "bsd-3-clause"},
    "# SPDX-License-Identifier: MIT OR Apache-2.0\nimport x": {"mit", "apache"},
    "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */": {"gpl"},
    "SPDX-License-Identifier: ((LGPL-2.1+ OR MPL-2.0) AND (ISC))": {"lgpl", "mpl", "isc"},
    "SPDX-License-Identifier: Nothing-1.0 OR MIT-like": set(),
}
SHORT = {
    "This is licensed under MIT.": {"mit"}, "An MIT-licensed tool": {"mit"}, "License: BSD": {"bsd"}, "license:Apache-2.0": {"apache"}, "released under the GPLv3": {"gpl"}, "available under the terms of the LGPL": {"lgpl"}, "Licence: MPL 2.0": {"mpl"},
    "distributed under ISC": {"isc"}, "He was licensed under mitigating terms": set(), "license: submit": set(), "permit-licensed": set(), "licensed under the MIT license": {"mit"}, "BSD 3-Clause licensed": {"bsd-3-clause"},
}


@pytest.mark.parametrize("text", [*EXPRESSIONS, *SHORT])
def test_expressions_and_short_grants(text):
    assert labels(text) == (EXPRESSIONS | SHORT)[text]


@pytest.mark.parametrize("piece", [" ", "\n", " \n", " * \n", "*/ ", "\n# ", "\n//", "spdx-license-identifier: (", "license-identifier: mit or ", "-licensed ", "licensed under the ", "( "])
def test_time_grows_with_the_text(piece):
    def took(n):
        start = time.perf_counter()
        detect("mit license " + piece * (n // len(piece)))
        return time.perf_counter() - start

    took(1000)
    small, large = took(100_000), took(800_000)
    assert large < 40 * max(0.02, small)
