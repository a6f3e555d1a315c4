"""License scan by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import bisect
import functools
import re
from typing import NamedTuple

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.batches import LOWER, map_texts


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: str  # a lower-case string without which the pattern can't match
    pattern: str  # over lower-cased text
    priority: int
    confidence: float
    others: tuple[str, ...] = ()  # keywords of alternatives that lack the first


class Family(NamedTuple):
    """A license: label, SPDX pattern, keyword of its name, pattern of its name, keyword and pattern of its address."""

    label: str
    spdx: str
    word: str
    name: str
    site: str = ""
    others: tuple[str, ...] = ()


# fmt: off
FAMILIES = [
    Family("0bsd", r"0bsd", "0bsd", r"(?:0bsd|zero[- ]clause bsd)", "opensource.org/licenses/0bsd", ("clause bsd",)),
    Family("afl", r"afl-[123](?:\.\d)?", "academic free", r"academic free license", "opensource.org/licenses/afl"),
    Family("agpl", r"agpl-[13](?:\.0)?(?:-only|-or-later)?", "affero", r"(?:gnu )?affero general public license", "gnu.org/licenses/agpl"),
    Family("apache", r"apache-(?:1\.[01]|2\.0)", "apache", r"apache (?:software )?license", "apache.org/licenses/license-"),
    Family("artistic", r"artistic-[12](?:\.0)?", "artistic", r"artistic license", "perlfoundation.org/artistic"),
    Family("beerware", r"beerware", "beer", r"beer-?ware license", "people.freebsd.org/~phk"),
    Family("blueoak", r"blueoak-1\.0\.0", "blue oak", r"blue oak model license", "blueoakcouncil.org/license"),
    Family("bsd-2-clause", r"bsd-2-clause(?:-[a-z]+)?", "bsd", r"(?:2-clause|two-clause|simplified|freebsd) bsd license", "opensource.org/licenses/bsd-2-clause"),
    Family("bsd-3-clause", r"bsd-3-clause(?:-[a-z]+)?", "bsd", r"(?:3-clause|three-clause|new|revised|modified) bsd license", "opensource.org/licenses/bsd-3-clause"),
    Family("bsd-4-clause", r"bsd-4-clause(?:-uc)?", "bsd", r"(?:4-clause|four-clause|original) bsd license", "spdx.org/licenses/bsd-4-clause"),
    Family("bsl-business", r"busl-1\.1", "business source", r"business source license", "mariadb.com/bsl11"),
    Family("boost", r"bsl-1\.0", "boost", r"boost software license", "boost.org/license_1_0"),
    Family("cc0", r"cc0-1\.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", "creativecommons.org/publicdomain/zero"),
    Family("cc-by", r"cc-by-[1-4]\.[05]", "attribution", r"creative commons attribution(?! ?-? ?(?:share|non|no))(?: [1-4]\.[05])?(?: international)?(?: license)?", "creativecommons.org/licenses/by/"),
    Family("cc-by-nc", r"cc-by-nc-[1-4]\.[05]", "noncommercial", r"creative commons attribution[- ]noncommercial(?! ?-? ?(?:share|no))(?: [1-4]\.[05])?", "creativecommons.org/licenses/by-nc/"),
    Family("cc-by-nc-nd", r"cc-by-nc-nd-[1-4]\.[05]", "noderiv", r"creative commons attribution[- ]noncommercial[- ]noderiv(?:ative)?s?", "creativecommons.org/licenses/by-nc-nd/"),
    Family("cc-by-nc-sa", r"cc-by-nc-sa-[1-4]\.[05]", "sharealike", r"creative commons attribution[- ]noncommercial[- ]sharealike", "creativecommons.org/licenses/by-nc-sa/"),
    Family("cc-by-nd", r"cc-by-nd-[1-4]\.[05]", "noderiv", r"creative commons attribution[- ]noderiv(?:ative)?s?", "creativecommons.org/licenses/by-nd/"),
    Family("cc-by-sa", r"cc-by-sa-[1-4]\.[05]", "sharealike", r"creative commons attribution[- ]share ?alike", "creativecommons.org/licenses/by-sa/", ("share alike",)),
    Family("cddl", r"cddl-1\.[01]", "development and distribution", r"common development and distribution license", "opensource.org/licenses/cddl"),
    Family("cecill", r"cecill-[12b-c](?:\.[01])?", "cecill", r"cecill(?:-[bc])? (?:free software )?licen[sc]e", "cecill.info/licences"),
    Family("cpal", r"cpal-1\.0", "common public attribution", r"common public attribution license", "opensource.org/licenses/cpal"),
    Family("cpl", r"cpl-1\.0", "common public", r"common public license", "opensource.org/licenses/cpl"),
    Family("curl", r"curl", "curl license", r"curl license", "curl.se/docs/copyright"),
    Family("ecl", r"ecl-[12]\.0", "educational community", r"educational community license", "opensource.org/licenses/ecl"),
    Family("elastic", r"elastic-2\.0", "elastic", r"elastic license(?: 2\.0)?", "elastic.co/licensing/elastic-license"),
    Family("epl", r"epl-[12]\.0", "eclipse", r"eclipse public license", "eclipse.org/legal/epl"),
    Family("eupl", r"eupl-1\.[0-2]", "european union public", r"european union public licen[sc]e", "eupl.eu"),
    Family("fdl", r"gfdl-1\.[1-3](?:-only|-or-later)?", "free documentation", r"(?:gnu )?free documentation license", "gnu.org/licenses/fdl"),
    Family("gpl", r"gpl-[123](?:\.0)?(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?general public license", "gnu.org/licenses/gpl"),
    Family("hpnd", r"hpnd", "historical permission", r"historical permission notice and disclaimer", "opensource.org/licenses/hpnd"),
    Family("icu", r"icu", "icu license", r"icu license", "unicode.org/icu/license"),
    Family("ijg", r"ijg", "independent jpeg", r"independent jpeg group(?:'s)? (?:license|software)", "ijg.org"),
    Family("ipl", r"ipl-1\.0", "ibm public", r"ibm public license", "opensource.org/licenses/ipl"),
    Family("isc", r"isc", "isc license", r"isc license", "opensource.org/licenses/isc"),
    Family("json", r"json", "json license", r"json license", "json.org/license"),
    Family("lgpl", r"lgpl-[23](?:\.[01])?(?:-only|-or-later|\+)?", "lesser general", r"(?:gnu )?(?:lesser|library) general public license", "gnu.org/licenses/lgpl", ("library general",)),
    Family("libpng", r"libpng(?:-2\.0)?", "libpng", r"libpng license", "libpng.org/pub/png/src/libpng-license"),
    Family("lppl", r"lppl-1\.[0-3][ac]?", "latex project", r"latex project public license", "latex-project.org/lppl"),
    Family("mit", r"mit(?:-0)?", "mit", r"mit license", "opensource.org/licenses/mit"),
    Family("mpl", r"mpl-[12]\.[01]", "mozilla", r"mozilla public license", "mozilla.org/mpl"),
    Family("ms-pl", r"ms-pl", "microsoft public", r"microsoft public license", "opensource.org/licenses/ms-pl"),
    Family("ms-rl", r"ms-rl", "microsoft reciprocal", r"microsoft reciprocal license", "opensource.org/licenses/ms-rl"),
    Family("mulanpsl", r"mulanpsl-[12]\.0", "mulan", r"mulan permissive software license", "license.coscl.org.cn/mulanpsl"),
    Family("ncsa", r"ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source license", "opensource.org/licenses/ncsa"),
    Family("npl", r"npl-1\.[01]", "netscape public", r"netscape public license", "mozilla.org/npl"),
    Family("odbl", r"odbl-1\.0", "open database", r"open (?:data commons open )?database license", "opendatacommons.org/licenses/odbl"),
    Family("ofl", r"ofl-1\.[01]", "open font", r"(?:sil )?open font license", "scripts.sil.org/ofl"),
    Family("openssl", r"openssl", "openssl", r"openssl license", "openssl.org/source/license"),
    Family("osl", r"osl-[123]\.[01]", "open software", r"open software license", "opensource.org/licenses/osl"),
    Family("php", r"php-3\.0?1?", "php license", r"php license", "php.net/license"),
    Family("postgresql", r"postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql.org/about/licence"),
    Family("psf", r"psf-2\.0|python-2\.0", "python", r"python software foundation license", "docs.python.org/3/license"),
    Family("qpl", r"qpl-1\.0", "q public", r"q public license", "opensource.org/licenses/qpl"),
    Family("rpl", r"rpl-1\.[15]", "reciprocal public", r"reciprocal public license", "opensource.org/licenses/rpl"),
    Family("ruby", r"ruby", "ruby license", r"ruby license", "ruby-lang.org/en/about/license"),
    Family("sspl", r"sspl-1\.0", "server side public", r"server side public license", "mongodb.com/licensing/server-side-public-license"),
    Family("unlicense", r"unlicense", "unlicense", r"(?:the )?unlicense", "unlicense.org"),
    Family("upl", r"upl-1\.0", "universal permissive", r"universal permissive license", "opensource.org/licenses/upl"),
    Family("vim", r"vim", "vim license", r"vim license", "vimhelp.org/uganda"),
    Family("w3c", r"w3c", "w3c", r"w3c (?:software )?(?:notice and )?license", "w3.org/consortium/legal"),
    Family("wtfpl", r"wtfpl", "wtf", r"(?:wtfpl|do what the f\S+ you want to public license)", "wtfpl.net", ("do what the f",)),
    Family("x11", r"x11", "x11", r"x11 license", "xfree86.org/3.3.6/copyright"),
    Family("zlib", r"zlib", "zlib", r"zlib(?:/libpng)? license", "zlib.net/zlib_license"),
    Family("zpl", r"zpl-[12]\.[01]", "zope", r"zope public license", "opensource.org/licenses/zpl"),
]
#: Sentences that belong to one license's own text.
PHRASES = [
    Rule("mit", "text", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 5, 0.95),
    Rule("mit", "text", "substantial portions", r"shall be included in all copies or substantial portions of the software", 5, 0.9),
    Rule("isc", "text", "with or without fee", r"permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose with or without fee", 5, 0.95),
    Rule("bsd-2-clause", "text", "binary forms", r"redistribution and use in source and binary forms,? with or without modification", 4, 0.85),
    Rule("bsd-3-clause", "text", "endorse or promote", r"may be used to endorse or promote products derived from", 5, 0.9),
    Rule("bsd-4-clause", "text", "advertising materials", r"all advertising materials mentioning features or use of this software", 6, 0.95),
    Rule("gpl", "text", "free software", r"this program is free software[:;] you can redistribute it", 5, 0.9),
    Rule("lgpl", "text", "free software", r"this library is free software[:;] you can redistribute it", 5, 0.9),
    Rule("zlib", "text", "provided 'as-is'", r"this software is provided 'as-is',? without any express or implied warranty", 5, 0.9),
    Rule("unlicense", "text", "unencumbered", r"this is free and unencumbered software released into the public domain", 6, 0.98),
    Rule("boost", "text", "machine-executable", r"machine-executable object code generated by a source language processor", 5, 0.9),
    Rule("wtfpl", "text", "you just do what", r"you just do what the f\S+ you want to", 6, 0.98),
    Rule("mpl", "text", "source code form", r"this source code form is subject to the terms of the mozilla public license", 6, 0.98),
    Rule("public-domain", "text", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 2, 0.7),
    Rule("proprietary", "text", "all rights reserved", r"all rights reserved", 1, 0.4),
    Rule("proprietary", "text", "confidential", r"proprietary and confidential", 3, 0.8),
    Rule("afl", "text", "academic free", r"licensed under the academic free license version \d\.\d", 8, 0.95),
    Rule("agpl", "text", "remote network interaction", r"remote network interaction; use with the gnu general public license", 6, 0.95),
    Rule("agpl", "text", "interacting with it remotely", r"prominently offer all users interacting with it remotely through a computer network", 6, 0.95),
    Rule("apache", "text", "in compliance with the license", r"you may not use this file except in compliance with the license", 5, 0.9),
    Rule("apache", "text", "unless required by applicable law", r"unless required by applicable law or agreed to in writing,? software distributed under the license", 5, 0.9),
    Rule("apache", "text", "each contributor hereby grants", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free,? irrevocable", 6, 0.95),
    Rule("apache", "text", "apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation", 5, 0.85),
    Rule("apache", "text", "contributor license agreements", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", 6, 0.95),
    Rule("apache", "text", "asl 2.0", r"\basl 2\.0\b", 4, 0.7),
    Rule("artistic", "text", "standard version", r"you may distribute (?:verbatim copies of the source form of )?the standard version", 4, 0.75),
    Rule("artistic", "text", "same terms as perl", r"under the same terms as perl(?: \d)?(?: itself)?", 6, 0.9),
    Rule("beerware", "text", "buy me a beer", r"you can buy me a beer in return", 6, 0.98),
    Rule("blueoak", "text", "everyone who gets this software", r"each contributor licenses you to do everything with this software", 6, 0.95, ("each contributor licenses you",)),
    Rule("boost", "text", "boost software license", r"distributed under the boost software license,? version 1\.0", 8, 0.98),
    Rule("boost", "text", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", 6, 0.98),
    Rule("bsd-0-clause", "text", "with or without fee is hereby granted", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.", 4, 0.7),
    Rule("bsd-1-clause", "text", "bsd 1-clause", r"bsd 1-clause", 6, 0.9),
    Rule("bsd-2-clause", "text", "retain the above copyright", r"redistributions of source code must retain the above copyright notice, this list of conditions", 4, 0.8),
    Rule("bsd-2-clause", "text", "in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice", 4, 0.8),
    Rule("bsd-3-clause", "text", "neither the name of", r"neither the name of .{1,120}? nor the names of its contributors may be used", 6, 0.95),
    Rule("bsd-4-clause", "text", "acknowledgement", r"this product includes software developed by the university of california, berkeley and its contributors", 6, 0.95, ("university of california",)),
    Rule("bsd", "text", "bsd-style", r"bsd-style license", 4, 0.7),
    Rule("bsd", "text", "regents of the university", r"copyright .{0,80}?the regents of the university of california", 3, 0.6),
    Rule("bsl-business", "text", "change date", r"change date: ?.{0,40}?change license:", 6, 0.9),
    Rule("bsl-business", "text", "additional use grant", r"additional use grant:", 5, 0.85),
    Rule("cc0", "text", "no rights reserved", r"\bcc0\b.{0,60}?no rights reserved", 6, 0.9),
    Rule("cc0", "text", "waived all copyright", r"has waived all copyright and related or neighboring rights", 6, 0.95),
    Rule("cc0", "text", "public domain dedication", r"creative commons (?:cc0|zero)(?: 1\.0)?(?: universal)? public domain dedication", 7, 0.97),
    Rule("cc-by", "text", "give appropriate credit", r"you must give appropriate credit, provide a link to the license", 4, 0.7),
    Rule("cc-by", "text", "cc by", r"\bcc by [234]\.0\b", 6, 0.9),
    Rule("cc-by-sa", "text", "under the same license as the original", r"you must distribute your contributions under the same license as the original", 5, 0.85),
    Rule("cc-by-sa", "text", "cc by-sa", r"\bcc by-sa(?: [234]\.0)?\b", 6, 0.9),
    Rule("cc-by-nc", "text", "for commercial purposes", r"you may not use the material for commercial purposes", 5, 0.85),
    Rule("cc-by-nc", "text", "cc by-nc", r"\bcc by-nc(?: [234]\.0)?\b(?!-)", 6, 0.9),
    Rule("cc-by-nc-sa", "text", "cc by-nc-sa", r"\bcc by-nc-sa(?: [234]\.0)?\b", 7, 0.92),
    Rule("cc-by-nc-nd", "text", "cc by-nc-nd", r"\bcc by-nc-nd(?: [234]\.0)?\b", 7, 0.92),
    Rule("cc-by-nd", "text", "cc by-nd", r"\bcc by-nd(?: [234]\.0)?\b", 7, 0.92),
    Rule("cc-by-nd", "text", "distribute the modified material", r"if you remix, transform, or build upon the material, you may not distribute the modified material", 6, 0.9),
    Rule("cddl", "text", "cddl", r"\bcddl(?:[- ]?1\.[01])?\b", 5, 0.85),
    Rule("cddl", "text", "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution license", 8, 0.98),
    Rule("cecill", "text", "french law", r"governed by the cecill(?:-[bc])? license under french law", 7, 0.97),
    Rule("cpal", "text", "attribution copyright notice", r"display of attribution information is required in larger works", 6, 0.9, ("display of attribution",)),
    Rule("curl", "text", "all rights reserved.", r"copyright \(c\) \d{4} ?- ?\d{4}, daniel stenberg", 6, 0.9, ("daniel stenberg",)),
    Rule("ecl", "text", "educational community", r"licensed under the educational community license, version [12]\.0", 8, 0.97),
    Rule("elastic", "text", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 6, 0.95),
    Rule("epl", "text", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 8, 0.98),
    Rule("epl", "text", "epl", r"\bepl[- ][12]\.0\b", 5, 0.85),
    Rule("eupl", "text", "eupl", r"licensed under the eupl\b", 7, 0.95),
    Rule("fdl", "text", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts", 7, 0.97),
    Rule("fdl", "text", "free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", 8, 0.98),
    Rule("gpl", "text", "any later version", r"either version [123] of the license,? or \(at your option\) any later version", 5, 0.85),
    Rule("gpl", "text", "should have received a copy of the gnu general", r"you should have received a copy of the gnu general public license", 6, 0.9),
    Rule("gpl", "text", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license", 6, 0.9),
    Rule("gpl", "text", "gplv", r"\bgplv[23]\+?(?!\w)", 5, 0.9),
    Rule("gpl", "text", "gnu gpl", r"\bgnu gpl\b(?: ?v?[123](?:\.0)?)?", 5, 0.85),
    Rule("gpl", "text", "classpath exception", r"gpl(?:v2|-2\.0)? with (?:the )?classpath exception", 6, 0.9),
    Rule("gpl", "text", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", 4, 0.75),
    Rule("hpnd", "text", "appear in supporting documentation", r"both that copyright notice and this permission notice appear in supporting documentation", 5, 0.85),
    Rule("icu", "text", "international business machines", r"copyright \(c\) 1995-\d{4} international business machines corporation and others", 6, 0.9),
    Rule("ijg", "text", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 7, 0.97),
    Rule("info-zip", "text", "info-zip", r"info-zip license", 6, 0.95),
    Rule("isc", "text", "internet systems consortium", r"copyright .{0,60}?internet systems consortium", 5, 0.8),
    Rule("jasper", "text", "jasper license", r"jasper license version 2\.0", 6, 0.95),
    Rule("json", "text", "good, not evil", r"the software shall be used for good, not evil", 7, 0.99),
    Rule("lgpl", "text", "should have received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license", 6, 0.92),
    Rule("lgpl", "text", "should have received a copy of the gnu library", r"you should have received a copy of the gnu library general public license", 6, 0.92),
    Rule("lgpl", "text", "lgpl", r"\blgpl(?:v?[23](?:\.[01])?)?\+?(?![\w.-])", 5, 0.85),
    Rule("libpng", "text", "png reference library", r"the png reference library is supplied \"as is\"", 6, 0.95),
    Rule("libtiff", "text", "sam leffler", r"the names of sam leffler and silicon graphics may not be used", 6, 0.95),
    Rule("lppl", "text", "latex project public", r"this work may be distributed and/or modified under the conditions of the latex project public license", 8, 0.98),
    Rule("lppl", "text", "lppl maintenance status", r"this work has the lppl maintenance status", 6, 0.95),
    Rule("mit", "text", "mit-style", r"mit[- ]style license", 4, 0.7, ("mit style",)),
    Rule("mit", "text", "expat", r"\bexpat license\b", 5, 0.85),
    Rule("mit", "text", "without restriction", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge", 6, 0.95),
    Rule("mit", "text", "in no event shall the authors", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability", 3, 0.6),
    Rule("mit", "text", "mit)", r"license:? \(?mit\)", 5, 0.85),
    Rule("mpl", "text", "mozilla.org/mpl/2.0", r"if a copy of the mpl was not distributed with this file", 6, 0.97, ("a copy of the mpl",)),
    Rule("mpl", "text", "subject to the mozilla public", r"the contents of this file are subject to the mozilla public license version 1\.[01]", 8, 0.98),
    Rule("mpl", "text", "mpl", r"\bmpl[- ]?(?:1\.[01]|2\.0)\b", 5, 0.85),
    Rule("mpl", "text", "incompatible with secondary licenses", r"this source code form is \"incompatible with secondary licenses\"", 6, 0.97),
    Rule("ms-pl", "text", "ms-pl", r"\(ms-pl\)", 5, 0.9),
    Rule("ms-rl", "text", "ms-rl", r"\(ms-rl\)", 5, 0.9),
    Rule("mulanpsl", "text", "mulan psl", r"licensed under mulan psl v[12]", 7, 0.97),
    Rule("ncsa", "text", "computational science", r"permission is hereby granted.{0,200}?to deal with the software without restriction", 5, 0.85, ("to deal with the software",)),
    Rule("npl", "text", "netscape public", r"subject to the netscape public license", 7, 0.95),
    Rule("odbl", "text", "open database license", r"this .{0,60}?is made available under the open database license", 7, 0.97),
    Rule("odbl", "text", "openstreetmap contributors", r"(?:©|\(c\)) openstreetmap contributors", 4, 0.7),
    Rule("odc-by", "text", "open data commons attribution", r"open data commons attribution license", 6, 0.95),
    Rule("pddl", "text", "public domain dedication and license", r"public domain dedication and license", 6, 0.95),
    Rule("ofl", "text", "reserved font name", r"with reserved font name", 6, 0.92),
    Rule("ofl", "text", "sil open font", r"this font software is licensed under the sil open font license", 8, 0.98),
    Rule("ogl-uk", "text", "open government licence", r"open government licence(?: v?[123](?:\.0)?)?", 6, 0.93),
    Rule("openssl", "text", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 7, 0.98),
    Rule("ssleay", "text", "eric young", r"this product includes cryptographic software written by eric young", 7, 0.98),
    Rule("osl", "text", "open software license", r"licensed under the open software license version [123]\.[01]", 8, 0.97),
    Rule("php", "text", "freely available from", r"this product includes php(?: software)?, freely available from", 7, 0.98),
    Rule("polyform-nc", "text", "polyform noncommercial", r"polyform noncommercial license(?: 1\.0\.0)?", 7, 0.97),
    Rule("polyform-sb", "text", "polyform small business", r"polyform small business license(?: 1\.0\.0)?", 7, 0.97),
    Rule("postgresql", "text", "without a written agreement", r"for any purpose, without fee, and without a written agreement is hereby granted", 6, 0.93),
    Rule("psf", "text", "python software foundation", r"the python software foundation \(\"?psf\"?\)", 4, 0.75),
    Rule("psf", "text", "beopen", r"beopen python open source license agreement", 6, 0.95),
    Rule("qpl", "text", "q public", r"licensed under the q public license", 8, 0.95),
    Rule("responsible-ai", "text", "openrail", r"\b(?:bigscience |creativeml )?open ?rail(?:-m|\+\+)?(?: license)?", 6, 0.9, ("open rail",)),
    Rule("ruby", "text", "same terms as ruby", r"under the same terms as ruby(?: itself)?", 6, 0.9),
    Rule("sleepycat", "text", "sleepycat", r"sleepycat (?:public )?license", 6, 0.95),
    Rule("sspl", "text", "offering the program as a service", r"if you make the functionality of the program or a modified version available to third parties as a service", 6, 0.95, ("to third parties as a service",)),
    Rule("sun-rpc", "text", "sun rpc", r"sun rpc is a product of sun microsystems", 6, 0.95),
    Rule("tcl", "text", "scriptics", r"copyrighted by the regents of the university of california, sun microsystems, inc\., scriptics corporation", 6, 0.95),
    Rule("unicode", "text", "unicode data files", r"unicode data files and (?:any associated documentation|software)", 6, 0.93),
    Rule("unlicense", "text", "dedicate any and all copyright interest", r"dedicate any and all copyright interest in the software to the public domain", 6, 0.98),
    Rule("upl", "text", "larger works", r"each a \"larger work\" to which the software is contributed", 6, 0.95, ("larger work\"",)),
    Rule("vim", "text", "uganda", r"vim is charityware", 6, 0.95, ("charityware",)),
    Rule("w3c", "text", "world wide web consortium", r"copyright .{0,30}?world wide web consortium", 5, 0.85),
    Rule("wtfpl", "text", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", 6, 0.95),
    Rule("x11", "text", "x consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising", 7, 0.98),
    Rule("zlib", "text", "misrepresented", r"the origin of this software must not be misrepresented", 5, 0.93),
    Rule("zlib", "text", "altered source versions", r"altered source versions must be plainly marked as such", 5, 0.93),
    Rule("zpl", "text", "zope corporation", r"copyright .{0,30}?zope (?:corporation|foundation) and contributors", 5, 0.85, ("zope foundation",)),
    Rule("public-domain", "text", "no copyright", r"no copyright is claimed", 2, 0.6),
    Rule("public-domain", "text", "hereby placed in the public domain", r"(?:is|are) hereby placed in the public domain", 4, 0.85),
    Rule("public-domain", "text", "united states government", r"work of the united states government", 3, 0.7),
    Rule("public-domain", "text", "disclaims copyright", r"the author disclaims copyright to this source code", 5, 0.95),
    Rule("proprietary", "text", "trade secret", r"(?:contains|constitutes) (?:confidential information and )?trade secrets?", 3, 0.75),
    Rule("proprietary", "text", "unauthorized copying", r"unauthorized copying of this file,? via any medium,? is strictly prohibited", 5, 0.95),
    Rule("proprietary", "text", "without prior written permission", r"(?:reproduced|copied|redistributed|distributed) (?:.{0,40} )?without (?:the )?prior written permission", 3, 0.7, ("without the prior written permission",)),
    Rule("proprietary", "text", "end user license agreement", r"end[- ]user license agreement", 3, 0.7, ("end-user license agreement",)),
    Rule("proprietary", "text", "internal use only", r"for internal use only", 2, 0.5),
    Rule("proprietary", "text", "evaluation purposes", r"for evaluation purposes only", 3, 0.7),
    Rule("non-commercial", "text", "non-commercial use", r"(?:for|to) (?:research and )?non-commercial use only", 4, 0.8),
    Rule("non-commercial", "text", "academic use", r"for (?:non-commercial )?academic use only", 4, 0.8),
    Rule("non-commercial", "text", "research purposes", r"for (?:non-commercial )?research purposes only", 4, 0.8),
    Rule("source-available", "text", "commons clause", r"commons clause\"? license condition", 6, 0.95),
    Rule("source-available", "text", "fair source", r"fair source license", 6, 0.93),
    Rule("source-available", "text", "functional source", r"functional source license", 6, 0.95),
    Rule("dual", "text", "dual licensed", r"dual[- ]licensed under", 4, 0.7, ("dual-licensed",)),
    Rule("dual", "text", "at your option", r"under either of .{1,80}? at your option", 4, 0.7),
    Rule("notice", "text", "see the license file", r"(?:see|refer to) the license file (?:for|in)", 2, 0.5, ("refer to the license file",)),
    Rule("notice", "text", "found in the license file", r"that can be found in the license file", 3, 0.6),
    Rule("notice", "text", "third-party notices", r"third[- ]party (?:software )?notices", 2, 0.5, ("third party notices", "third-party software notices", "third party software notices")),
]
#: Phrases whose labels every text with them has (fixed values): words that stand consecutively, and the label.
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
# fmt: on
#: Short names by which people call licenses: label, pattern.
SHORT = [
    ("agpl", r"agpl(?:-?v?3(?:\.0)?)?"), ("apache", r"apache(?:[- ]?v?[12](?:\.[01])?)?"), ("bsd", r"bsd"), ("bsd-2-clause", r"bsd[- ]2(?:[- ]clause)?"), ("bsd-3-clause", r"bsd[- ]3(?:[- ]clause)?"), ("cc0", r"cc0(?:[- ]1\.0)?"),
    ("gpl", r"(?:gnu )?gpl(?:[- ]?v?[123](?:\.0)?)?(?:\+|-only|-or-later)?"), ("isc", r"isc"), ("lgpl", r"(?:gnu )?lgpl(?:[- ]?v?[23](?:\.[01])?)?(?:\+|-only|-or-later)?"), ("mit", r"mit"), ("mpl", r"mpl(?:[- ]?v?[12](?:\.[01])?)?"), ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"), ("zlib", r"zlib"),
]
_GRANTS = ("licensed", "released", "distributed", "available", "provided", "published")


def build_rules() -> list[Rule]:
    """For each family an identifier, a grant, a name with version, a plain name and an address; then the phrases, and grants that use a short name."""
    rules = list(PHRASES)
    for label, name in SHORT:
        pattern = rf"(?:(?:{'|'.join(_GRANTS)}) under (?:the )?(?:terms of )?(?:the )?{name}|(?<![\w-]){name}[- ]licensed|(?<!\w)licen[sc]e: ?{name})(?![\w-])"
        rules.append(Rule(label, "short", "licensed under", pattern, 6, 0.85, (*(f"{g} under" for g in _GRANTS[1:]), "-licensed", " licensed", "license:", "licence:")))
    for f in FAMILIES:
        rules.append(Rule(f.label, "identifier", "license-identifier", rf"spdx-license-identifier:\s*(?:{f.spdx})(?![\w.-])", 9, 1.0))
        rules.append(Rule(f.label, "grant", f.word, rf"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{f.name}", 8, 0.95, f.others))
        rules.append(Rule(f.label, "version", f.word, rf"(?<!\w){f.name},? (?:version |v\.? ?)?\d(?:\.\d)*", 7, 0.9, f.others))
        rules.append(Rule(f.label, "name", f.word, rf"(?<!\w){f.name}(?!\w)", 3, 0.75, f.others))
        if f.site:
            rules.append(Rule(f.label, "address", f.site, rf"(?:https?://)?(?:www\.)?{re.escape(f.site)}[\w./-]*", 6, 0.9))
    return rules


@functools.lru_cache(maxsize=1)
def compiled() -> tuple[list[tuple[Rule, re.Pattern]], ahocorasick.Automaton]:
    rules = [(r, re.compile(r.pattern)) for r in build_rules()]
    by_keyword: dict[str, list[int]] = {}
    for i, (r, _) in enumerate(rules):
        for keyword in (r.keyword, *r.others):
            by_keyword.setdefault(keyword, []).append(i)
    gate = ahocorasick.Automaton()
    for keyword, ids in by_keyword.items():
        gate.add_word(keyword, tuple(ids))
    gate.make_automaton()
    return rules, gate


def resolve(found: list[tuple[int, int, int]], rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, int]]:
    """Detections (start, end, rule) that no other contains which is of higher priority, or of the same and longer or of an earlier rule.

    One such winner is kept itself, so nothing that a suppressed detection contains survives. A sweep from left to right, the longest
    first at one start, keeps for each priority (there are few) the best detection that reaches furthest.
    """
    rank = lambda x: (-rules[x[2]][0].priority, x[0] - x[1], x[0], x[2])
    kept: list[tuple[int, int, int]] = []
    furthest: dict[int, int] = {}  # priority: how far a detection seen so far reaches
    for start, end, i in sorted(found, key=lambda x: (x[0], -x[1], rank(x))):
        own = rules[i][0].priority
        if not any(reach >= end for priority, reach in furthest.items() if priority >= own):
            kept.append((start, end, i))
        furthest[own] = max(furthest.get(own, 0), end)
    # Of equal spans the sweep met one of lower priority after a higher one; one of higher priority that starts later lies inside and wins nothing.
    return kept


@functools.lru_cache(maxsize=1)
def _identifiers() -> list[tuple[int, re.Pattern]]:
    """Rules that name an identifier, with the pattern of the identifier alone."""
    spdx = {f.label: f.spdx for f in FAMILIES}
    return [(i, re.compile(spdx[r.label])) for i, (r, _) in enumerate(compiled()[0]) if r.kind == "identifier" and r.label in spdx]


#: An identifier, or several joined by and, or, with, in any brackets.
_EXPRESSION = re.compile(r"license-identifier: ?((?:\( ?)*+[\w.+-]++(?:(?: ?\))*+ (?:and|or|with) (?:\( ?)*+[\w.+-]++)*+)")
_OPERATORS = frozenset(("and", "or", "with"))


def expression_parts(folded: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of each license that an SPDX expression names; exceptions after "with" name none."""
    found = []
    if "license-identifier" in folded:
        for m in _EXPRESSION.finditer(folded):
            for t in _PART.finditer(folded, m.start(1), m.end(1)):
                if t[0] not in _OPERATORS:
                    found += [(t.start(), t.end(), i) for i, pattern in _identifiers() if pattern.fullmatch(t[0].rstrip("+"))]
    return found


_PART = re.compile(r"[\w.+-]+")


def detect(text: str) -> list[tuple[int, int, int]]:
    """Resolved detections in a text; rules run only if a keyword of theirs occurs.

    A run of white space counts as one space, and so does a line's end with the comment marks around it, so that sentences are found where they are wrapped in code.
    """
    rules, gate = compiled()
    text = text.translate(_lower_ascii)
    folded = _RUNS.sub(" ", text)
    wanted = {i for _, ids in gate.iter(folded) for i in ids}
    if not wanted:
        return []
    found = resolve([(m.start(), m.end(), i) for i in sorted(wanted) for m in rules[i][1].finditer(folded)] + expression_parts(folded), rules)
    if not found or len(folded) == len(text):
        return found
    after, cut = [0], [0]  # from folded place after[j] on, cut[j] characters are gone
    for m in _RUNS.finditer(text):
        if m.end() - m.start() > 1:
            after.append(m.start() - cut[-1] + 1)
            cut.append(cut[-1] + m.end() - m.start() - 1)

    def place(at: int) -> int:
        return at + cut[bisect.bisect_right(after, at) - 1]

    return [(place(a), place(b - 1) + 1, i) for a, b, i in found]


#: What counts as one space: line ends, with a mark that closes a comment before them and one that begins or carries on a comment after them, and other runs of white space than one plain space.
_CLOSES = r"(?:(?:\*+/|-->|#\}|\*\))[^\S\n]*+)?+"
_OPENS = r"(?:(?://+!?|/\*+!?|\*+|#+!?|;+|--+|%+|!+|>+|\.\\\"|<!--|\(\*|'|dnl|rem)(?=\s|\Z)[^\S\n]*+)?+"
_RUNS = re.compile(rf"(?:[^\S\n]*+{_CLOSES}\n[^\S\n]*+{_OPENS})++|[^\S ]\s*| \s+")

_lower_ascii = {c: c + 32 for c in range(65, 91)}
#: Bytes of ASCII that are no letters or digits become spaces: then words are what split() gives.
_WORDS = bytes(32 if b < 128 and not chr(b).isalnum() else LOWER[b] for b in range(256))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    found = []
    for phrase, label in BASE:
        last = phrase[-1].encode()
        first = [p.encode() for p in phrase]
        at = -1
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            if words[max(0, at - len(phrase) + 1) : at + 1] == first:
                found.append((at - len(phrase) + 1, label))
    return sorted(found)


DETECTION = "array<struct<label:string,kind:string,priority:int,confidence:double,start:int,end:int,text:string>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License detections in every whole text.

    Hundreds of rules (identifiers, grants, names with versions, names, addresses, sentences) run
    only where their keyword occurs; overlapping detections are resolved by priority and by
    containment. ``places`` are the word positions of the base phrases, never suppressed. Rows are
    independent: no shuffle.

    Bytes that are no UTF-8 are read as U+FFFD.

    Returns id, n_words, places array<struct<word, label>>, detections (label, kind, priority,
    confidence, character span, matched text). Null texts count as empty. Repeated rows and rows
    without id stay as they are; extra columns are ignored.
    """

    def work(texts: list[bytes | None]) -> list[list]:
        rules, _ = compiled()
        n_words, places, detections = [], [], []
        for raw in texts:
            raw = raw or b""
            words = raw.translate(_WORDS).split()
            n_words.append(len(words))
            places.append([{"word": w, "label": label} for w, label in base_places(words)] if b"license" in raw.lower() else [])
            text = raw.decode(errors="replace")
            detections.append([{"label": (r := rules[i][0]).label, "kind": r.kind, "priority": r.priority, "confidence": r.confidence, "start": a, "end": b, "text": text[a:b]} for a, b, i in detect(text)])
        return [n_words, places, detections]

    return map_texts(docs, id_col, text_col, work, f"n_words long, places array<struct<word:long,label:string>>, detections {DETECTION}")


def license_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One flat row for each scanned text: base phrase counts and places, labels, and a score.

    ``score`` is the highest confidence of what was detected (a base phrase alone: 0.6), 0 if nothing was.
    """

    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")

    starts = F.transform("places", lambda p: p["word"])
    base, own = F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"])
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("detections", lambda d: d["confidence"]), F.transform("places", lambda _: F.lit(0.6))))
    return scanned.select(id_col, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), best.alias("score"))
