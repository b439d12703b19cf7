"""License detection by ordered signature rules.

Rules are built from two tables: license names with the keyword their texts must hold, and signature
templates with a priority and a confidence; SIGNATURES adds a hundred hand-written ones for license texts,
headers and names with versions.
SPDX expressions are parsed id by id. A rule runs only if an Aho-Corasick pass finds its keyword.
Overlapping detections are resolved by priority: one whose interval lies inside that of an accepted
detection is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases of the base scan and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: SPDX identifier, keyword, pattern of the license's name, pattern of its address (or None).
LICENSES = (
    ("mit", "mit", r"(?:the\s+)?mit(?:/x11)?", r"opensource\.org/licenses/mit"),
    ("x11", "x11", r"(?:the\s+)?x11", None),
    ("isc", "isc", r"(?:the\s+)?isc", r"opensource\.org/licenses/isc"),
    ("apache-1.1", "apache", r"(?:the\s+)?apache(?:\s+software)?(?:\s+license)?,?\s+(?:version\s+|v)?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"(?:the\s+)?apache(?:\s+software)?(?:\s+license)?,?\s+(?:version\s+|v)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("gpl-2.0", "general public", r"(?:the\s+)?(?:gnu\s+)?general\s+public\s+license,?\s+(?:version\s+|v)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"(?:the\s+)?(?:gnu\s+)?general\s+public\s+license,?\s+(?:version\s+|v)?3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "general public", r"(?:the\s+)?(?:gnu\s+)?general\s+public", r"gnu\.org/licenses/gpl"),
    ("lgpl-2.1", "lesser", r"(?:the\s+)?(?:gnu\s+)?lesser\s+general\s+public\s+license,?\s+(?:version\s+|v)?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser", r"(?:the\s+)?(?:gnu\s+)?lesser\s+general\s+public\s+license,?\s+(?:version\s+|v)?3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lesser", r"(?:the\s+)?(?:gnu\s+)?lesser\s+general\s+public", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", "affero", r"(?:the\s+)?(?:gnu\s+)?affero\s+general\s+public(?:\s+license)?(?:,?\s+(?:version\s+|v)?3(?:\.0)?)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", "free documentation", r"(?:the\s+)?(?:gnu\s+)?free\s+documentation", r"gnu\.org/licenses/fdl-1\.3"),
    ("bsd-2-clause", "bsd", r"(?:the\s+)?(?:simplified|freebsd|2-clause|two-clause)\s+bsd|bsd[ -](?:2|two)[ -]clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:the\s+)?(?:new|modified|revised|3-clause|three-clause)\s+bsd|bsd[ -](?:3|three)[ -]clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:the\s+)?(?:original|4-clause|four-clause)\s+bsd|bsd[ -](?:4|four)[ -]clause", None),
    ("0bsd", "bsd", r"(?:the\s+)?zero-clause\s+bsd|0bsd", r"opensource\.org/licenses/0bsd"),
    ("bsd", "bsd", r"(?:the\s+)?bsd", None),
    ("mpl-1.1", "mozilla", r"(?:the\s+)?mozilla\s+public\s+license,?\s+(?:version\s+|v)?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"(?:the\s+)?mozilla\s+public(?:\s+license)?(?:,?\s+(?:version\s+|v)?2(?:\.0)?)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse", r"(?:the\s+)?eclipse\s+public\s+license,?\s+(?:version\s+|v)?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"(?:the\s+)?eclipse\s+public(?:\s+license)?(?:,?\s+(?:version\s+|v)?2(?:\.0)?)?", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", "common development", r"(?:the\s+)?common\s+development\s+and\s+distribution", r"opensource\.org/licenses/cddl"),
    ("cpl-1.0", "common public", r"(?:the\s+)?common\s+public", r"opensource\.org/licenses/cpl"),
    ("eupl-1.2", "european union", r"(?:the\s+)?european\s+union\s+public", r"joinup\.ec\.europa\.eu/[a-z/]*eupl"),
    ("artistic-1.0", "artistic", r"(?:the\s+)?artistic\s+license,?\s+(?:version\s+|v)?1(?:\.0)?", None),
    ("artistic-2.0", "artistic", r"(?:the\s+)?artistic(?:\s+license)?(?:,?\s+(?:version\s+|v)?2(?:\.0)?)?", r"opensource\.org/licenses/artistic-2\.0"),
    ("bsl-1.0", "boost", r"(?:the\s+)?boost\s+software", r"boost\.org/license_1_0"),
    ("busl-1.1", "business source", r"(?:the\s+)?business\s+source", r"mariadb\.com/bsl11"),
    ("zlib", "zlib", r"(?:the\s+)?zlib(?:/libpng)?", r"opensource\.org/licenses/zlib"),
    ("libpng", "png", r"(?:the\s+)?(?:libpng|png\s+reference\s+library)", None),
    ("openssl", "openssl", r"(?:the\s+)?openssl", r"openssl\.org/source/license"),
    ("php-3.01", "php", r"(?:the\s+)?php", r"php\.net/license"),
    ("psf-2.0", "python", r"(?:the\s+)?python(?:\s+software\s+foundation)?", r"docs\.python\.org/[0-9.]*/?license"),
    ("ruby", "ruby", r"(?:the\s+)?ruby", r"ruby-lang\.org/en/about/license"),
    ("postgresql", "postgresql", r"(?:the\s+)?postgresql", r"opensource\.org/licenses/postgresql"),
    ("ncsa", "ncsa", r"(?:the\s+)?(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?", r"opensource\.org/licenses/ncsa"),
    ("upl-1.0", "universal permissive", r"(?:the\s+)?universal\s+permissive", r"opensource\.org/licenses/upl"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense", r"unlicense\.org"),
    ("wtfpl", "what the f", r"(?:the\s+)?do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public", r"wtfpl\.net"),
    ("ofl-1.1", "open font", r"(?:the\s+)?(?:sil\s+)?open\s+font", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open database", r"(?:the\s+)?open\s+(?:data\s+commons\s+open\s+)?database", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "open data commons", r"(?:the\s+)?open\s+data\s+commons\s+attribution", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain dedication", r"(?:the\s+)?open\s+data\s+commons\s+public\s+domain\s+dedication", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", "cc0", r"(?:creative\s+commons\s+)?cc0(?:\s+1\.0)?(?:\s+universal)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cecill-2.1", "cecill", r"(?:the\s+)?cecill", r"cecill\.info/licences"),
    ("ms-pl", "microsoft public", r"(?:the\s+)?microsoft\s+public", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"(?:the\s+)?microsoft\s+reciprocal", r"opensource\.org/licenses/ms-rl"),
    ("osl-3.0", "open software", r"(?:the\s+)?open\s+software", r"opensource\.org/licenses/osl-3\.0"),
    ("afl-3.0", "academic free", r"(?:the\s+)?academic\s+free", r"opensource\.org/licenses/afl-3\.0"),
    ("sspl-1.0", "server side", r"(?:the\s+)?server\s+side\s+public", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", r"(?:the\s+)?elastic", r"elastic\.co/licensing/elastic-license"),
    ("vim", "vim", r"(?:the\s+)?vim", None),
    ("w3c", "w3c", r"(?:the\s+)?w3c(?:\s+software)?", r"w3\.org/consortium/legal"),
)

#: The six Creative Commons kinds and their words; versions are a parameter of the rule.
CC_KINDS = (
    ("by", r"attribution"),
    ("by-sa", r"attribution[- ]share[- ]?alike"),
    ("by-nc", r"attribution[- ]non[- ]?commercial"),
    ("by-nd", r"attribution[- ]no[- ]?deriv(?:ative)?s?(?:\s+works)?"),
    ("by-nc-sa", r"attribution[- ]non[- ]?commercial[- ]share[- ]?alike"),
    ("by-nc-nd", r"attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s?(?:\s+works)?"),
)
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

#: Templates: pattern with {id}, {name} or {url}, priority and confidence.
TEMPLATES = (
    (r"spdx-license-identifier:\s*{id}(?![\w.+-]*[\w+])", 100, 1.0),
    (r"(?<![\w./-])(?:https?://)?(?:www\.)?{url}", 80, 0.95),
    (r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|made\s+available)\s+under\s+(?:the\s+terms\s+(?:and\s+conditions\s+)?of\s+)?(?:{name})(?:\s+licen[cs]e)?(?!\w)", 70, 0.9),
    (r"(?:subject\s+to|governed\s+by)\s+(?:the\s+terms\s+(?:and\s+conditions\s+)?of\s+)?(?:{name})(?:\s+licen[cs]e)?(?!\w)", 60, 0.85),
    (r"(?<![\w-])(?:{name})[\s-]+licen[cs]ed?(?!\w)", 40, 0.6),
)
#: Names that are those of products as well; only with the word license do they name one.
PRODUCTS = frozenset(("x11", "zlib", "openssl", "php-3.01", "psf-2.0", "ruby", "postgresql", "vim", "w3c", "elastic-2.0", "osl-3.0", "odbl-1.0"))

#: Hand-written signatures of license texts and headers: label, keyword, words, priority and confidence. A space
#: stands for any run of white space, quotes and comment marks.
SIGNATURES = (
    ("mit", "granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [(]the software[)], to deal in the software", 90, 0.95),
    ("mit", "granted", r"permission is hereby granted, free of charge(?!, to any person or organization)(?!, to any person obtaining a copy of this software and associated documentation files [(]the software[)], to deal with)", 50, 0.8),
    ("ncsa", "granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [(]the software[)], to deal with the software", 90, 0.95),
    ("bsl-1.0", "granted", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", 90, 0.95),
    ("isc", "granted", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", 90, 0.95),
    ("0bsd", "granted", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted(?!, provided)", 90, 0.9),
    ("postgresql", "granted", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", 90, 0.95),
    ("apache-2.0", "january", r"apache license,? version 2[.]0, january 2004", 90, 0.95),
    ("gpl-2.0", "june", r"gnu general public license,? version 2, june 1991", 90, 0.95),
    ("gpl-3.0", "june", r"gnu general public license,? version 3, 29 june 2007", 90, 0.95),
    ("lgpl-2.1", "february", r"gnu lesser general public license,? version 2[.]1, february 1999", 90, 0.95),
    ("lgpl-3.0", "june", r"gnu lesser general public license,? version 3, 29 june 2007", 90, 0.95),
    ("agpl-3.0", "november", r"gnu affero general public license,? version 3, 19 november 2007", 90, 0.95),
    *(
        (f"{label}-{kind}", "redistribute", rf"(?:redistribute it and/or modify it|can be redistributed and/or modified) under the terms of (?:version {re.escape(number)}(?:[.]0)? of )?the gnu {name}general public license{published}{ending}", 90, 0.95)
        for label, name, number in (("gpl-2.0", "", "2"), ("gpl-3.0", "", "3"), ("lgpl-2.1", "lesser ", "2.1"), ("lgpl-3.0", "lesser ", "3"), ("agpl-3.0", "affero ", "3"))
        for published in (r"(?:,? as published by the free software foundation)?[,;:]?",)
        for kind, ending in (
            ("or-later", rf" either version {re.escape(number)}(?:[.]0)? of the license,? or [(]?at your option[)]? any later version"),
            ("only", rf" version {re.escape(number)}(?:[.]0)?(?: of the license)?(?![.]?\d)(?!,? or [(]?at your option)"),
        )
    ),
    ("mpl-2.0", "source", r"this source code form is subject to the terms of the mozilla public license, v[.] 2[.]0", 90, 0.95),
    ("mpl-2.0", "mozilla", r"mozilla public license version 2[.]0 =* ?1[.] definitions", 90, 0.95),
    ("epl-2.0", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license", 90, 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 90, 0.95),
    ("zlib", "as-is", r"this software is provided as-is,? without any express or implied warranty[.] in no event will the authors be held liable", 90, 0.95),
    ("wtfpl", "just", r"you just do what the f\S+ you want to", 90, 0.95),
    ("cc0-1.0", "dedicated", r"the person who associated a work with this deed has dedicated the work to the public domain", 90, 0.95),
    ("ofl-1.1", "february", r"sil open font license version 1[.]1 - 26 february 2007", 90, 0.95),
    # names with their versions, wherever they stand
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?2(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?1[.]1(?![.]?\d)", 45, 0.85),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)?2(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)?3(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)?2[.]1(?![.]?\d)", 45, 0.85),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)?3(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e,? (?:version |v)?3(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("gfdl-1.1", "free documentation", r"(?:gnu )?free documentation licen[cs]e,? (?:version |v)?1[.]1(?![.]?\d)", 45, 0.85),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[cs]e,? (?:version |v)?1[.]2(?![.]?\d)", 45, 0.85),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[cs]e,? (?:version |v)?1[.]3(?![.]?\d)", 45, 0.85),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?1[.]1(?![.]?\d)", 45, 0.85),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?2(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,?(?: -)? (?:version |v)?1(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,?(?: -)? (?:version |v)?2(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("eupl-1.1", "european union", r"european union public licen[cs]e,? (?:version |v[.]? ?)?1[.]1(?![.]?\d)", 45, 0.85),
    ("eupl-1.2", "european union", r"european union public licen[cs]e,? (?:version |v[.]? ?)?1[.]2(?![.]?\d)", 45, 0.85),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?1(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?2(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: -|,)? version 1[.]0", 45, 0.85),
    ("busl-1.1", "business source", r"business source licen[cs]e,? (?:version |v)?1[.]1", 45, 0.85),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: [(]cddl[)])?,?(?: -)? (?:version |v)?1[.]0", 45, 0.85),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: [(]upl[)])?,? (?:version |v)?1[.]0", 45, 0.85),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: [(]osl[)])?,? (?:version |v[.]? ?)?3[.]0", 45, 0.85),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: [(]afl[)])?,? (?:version |v[.]? ?)?3[.]0", 45, 0.85),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e [(]ms-pl[)]", 45, 0.85),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e [(]ms-rl[)]", 45, 0.85),
    ("odbl-1.0", "open database", r"open database licen[cs]e [(]odbl[)]", 45, 0.85),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: [(]zpl[)])?,? (?:version |v)?2[.]1", 45, 0.85),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software licen[cs]e,? ?(?:version |v)?2", 45, 0.85),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e", 45, 0.85),
    ("polyform-noncommercial-1.0.0", "polyform", r"polyform noncommercial licen[cs]e,? (?:version )?1[.]0[.]0", 45, 0.85),
    ("polyform-small-business-1.0.0", "polyform", r"polyform small business licen[cs]e,? (?:version )?1[.]0[.]0", 45, 0.85),
    ("sspl-1.0", "server side", r"server side public licen[cs]e,? (?:version |v)?1(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e,? (?:version |v)?2(?:[.]0)?(?![.]?\d)", 45, 0.85),
    ("php-3.01", "php", r"php licen[cs]e,? (?:version |v)?3[.]01", 45, 0.85),
    ("cc0-1.0", "cc0", r"cc0 1[.]0 universal", 45, 0.85),
    ("cc-by-4.0", "attribution", r"creative commons attribution 4[.]0 international", 85, 0.95),
    ("cc-by-sa-4.0", "attribution", r"creative commons attribution-share ?alike 4[.]0 international", 85, 0.95),
    ("cc-by-nc-4.0", "attribution", r"creative commons attribution-non ?commercial 4[.]0 international", 85, 0.95),
    ("cc-by-nd-4.0", "attribution", r"creative commons attribution-no ?derivatives 4[.]0 international", 85, 0.95),
    ("cc-by-nc-sa-4.0", "attribution", r"creative commons attribution-non ?commercial-share ?alike 4[.]0 international", 85, 0.95),
    ("cc-by-nc-nd-4.0", "attribution", r"creative commons attribution-non ?commercial-no ?derivatives 4[.]0 international", 85, 0.95),
    ("cc-by-3.0", "unported", r"creative commons attribution 3[.]0 unported", 85, 0.95),
    ("cc-by-sa-3.0", "unported", r"creative commons attribution-share ?alike 3[.]0 unported", 85, 0.95),
    # sentences that only one license has
    ("json", "not evil", r"the software shall be used for good, not evil", 90, 0.95),
    ("beerware", "stuff", r"as long as you retain this notice,? you can do whatever you want with this stuff", 90, 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 90, 0.9),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation [(]https?://www[.]apache[.]org/[)]", 50, 0.7),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 90, 0.9),
    ("hpnd", "granted", r"permission to use, copy, modify,?(?: and)? distribute(?:, and sell)?,? this software and its documentation for any purpose(?: and without fee)? is hereby granted(?: without fee)?, provided", 90, 0.9),
    ("psf-2.0", "python", r"psf licen[cs]e agreement for python", 90, 0.9),
    ("w3c", "w3c", r"w3c[®]? software notice and licen[cs]e", 90, 0.9),
    ("libpng", "png", r"the png reference library is supplied as-is", 90, 0.9),
    ("unicode-dfs-2016", "unicode", r"unicode,? inc[.] licen[cs]e agreement - data files and software", 90, 0.9),
    ("vim", "vim", r"vim is charityware", 90, 0.8),
    ("ofl-1.1", "font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e,? version 1[.]1", 90, 0.95),
    ("artistic-2.0", "perl foundation", r"the artistic licen[cs]e 2[.]0 copyright [(]c[)] 2000-2006, the perl foundation", 90, 0.95),
    ("bsl-1.0", "boost", r"boost software licen[cs]e - version 1[.]0 - august 17th, 2003", 90, 0.95),
    ("sspl-1.0", "october", r"server side public licen[cs]e version 1, october 16, 2018", 90, 0.95),
    ("wtfpl", "december", r"do what the f\S+ you want to public licen[cs]e version 2, december 2004", 90, 0.95),
    ("cecill-2.1", "cecill", r"contrat de licence de logiciel libre cecill", 90, 0.9),
    ("public-domain", "public domain", r"(?:this|the) (?:work|file|code|software|program|document|source code) (?:is|has been) (?:hereby )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain", 60, 0.8),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary|proprietary licen[cs]e|all rights reserved[.,;:]? (?:(?:this|the) (?:software|document|file|code|work) is )?proprietary", 60, 0.8),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|distribution|reproduction)(?:,? (?:and|or) (?:copying|use|distribution|reproduction))? of this (?:file|software|document|code),?(?: via any medium)? is strictly prohibited", 60, 0.85),
    ("proprietary", "confidential", r"this (?:software|file|document|code) (?:is|contains) (?:the )?confidential(?: and proprietary)? information", 60, 0.8),
    # names as they are written in identifiers
    ("apache-2.0", "apache", r"(?<![\w.-])apache-2[.]0(?![\w.-])", 44, 0.8),
    ("apache-1.1", "apache", r"(?<![\w.-])apache-1[.]1(?![\w.-])", 44, 0.8),
    ("apache-2.0", "apache", r"(?<![\w.-])(?:asl|al)v?2[.]0 [(]apache", 44, 0.8),
    ("bsd-2-clause", "bsd", r"(?<![\w.-])bsd-2-clause(?![\w.-])", 44, 0.8),
    ("bsd-3-clause", "bsd", r"(?<![\w.-])bsd-3-clause(?![\w.-])", 44, 0.8),
    ("bsd-4-clause", "bsd", r"(?<![\w.-])bsd-4-clause(?![\w.-])", 44, 0.8),
    ("bsl-1.0", "bsl", r"(?<![\w.-])bsl-1[.]0(?![\w.-])", 44, 0.8),
    ("artistic-2.0", "artistic", r"(?<![\w.-])artistic-2[.]0(?![\w.-])", 44, 0.8),
    ("cc0-1.0", "cc0", r"(?<![\w-])cc0(?: 1[.]0)?(?![\w])", 44, 0.8),
    # spoken forms
    ("mit", "mit", r"(?:dual|double) licen[cs]ed (?:under )?(?:the )?mit(?: licen[cs]e)? (?:and|or|/)", 65, 0.85),
    ("mit", "mit", r"(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:permissive )?mit (?:style )?licen[cs]e", 65, 0.85),
    ("apache-2.0", "apache", r"(?:under|by) (?:the )?(?:terms of )?(?:the )?apache(?: licen[cs]e)?,? (?:version )?v?2(?:[.]0)?(?![.]?\d)", 66, 0.85),
    ("apache-2.0", "asl", r"(?<![\w.-])asl ?v?2(?:[.]0)?(?![.]?\w)", 44, 0.8),
    ("bsd", "bsd", r"(?:under|by) (?:the )?(?:terms of )?(?:an? |the )?bsd (?:style|like|type) licen[cs]e", 65, 0.8),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause,? (?:revised |modified |new )?bsd", 46, 0.8),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause,? (?:simplified |freebsd )?bsd", 46, 0.8),
    ("isc", "isc", r"isc style licen[cs]e", 46, 0.8),
    ("public-domain", "copyright", r"no copyright (?:is )?(?:reserved|claimed)", 46, 0.7),
    ("public-domain", "domain", r"(?<![\w-])public domain (?:software|code|work|dedication|mark)", 46, 0.7),
    ("unlicense", "unlicense", r"(?:under|by|see) the unlicense(?!d)", 65, 0.85),
    ("public-domain", "disclaim", r"(?:author|authors) (?:hereby )?disclaims? copyright to this source code", 60, 0.8),
)
#: How the BSD texts begin, and the clauses that tell them apart, the longest text first: label, words, priority, confidence.
BSD_HEAD = r"redistribution and use in source and binary forms"
BSD_CLAUSES = (
    ("bsd-4-clause", r"all advertising materials mentioning", 92, 0.95),
    ("bsd-3-clause", r"neither the names? of|the names? of [^.]{1,120}? may not be used to endorse", 91, 0.95),
    ("bsd-2-clause", r"redistributions in binary form must reproduce", 90, 0.9),
)

#: Abbreviations with their versions; a whole number stands for itself with ".0" as well.
ABBREVIATIONS = (
    ("gpl", ("1", "2", "3")), ("lgpl", ("2", "2.1", "3")), ("agpl", ("1", "3")), ("gfdl", ("1.1", "1.2", "1.3")), ("mpl", ("1", "1.1", "2")),
    ("epl", ("1", "2")), ("eupl", ("1", "1.1", "1.2")), ("cddl", ("1", "1.1")), ("cpl", ("1",)), ("osl", ("1", "2", "2.1", "3")), ("afl", ("1.2", "2", "2.1", "3")),
    ("upl", ("1",)), ("sspl", ("1",)), ("busl", ("1.1",)), ("ofl", ("1", "1.1")), ("odbl", ("1",)), ("zpl", ("2", "2.1")), ("wtfpl", ("2",)), ("cecill", ("1", "2", "2.1")),
)
#: Families that may be used under any later version.
GNU = ("gpl", "lgpl", "agpl", "gfdl")
_LATER = r"(?:\+|-or-later|,?\s+or\s+(?:any\s+)?(?:later|newer|above|higher)|,?\s+or\s+[(]?at\s+your\s+option[)]?\s+any\s+later|\s+and\s+(?:later|newer|above))"

#: What stands for a license after "license:" or on a badge, besides SPDX identifiers.
ALIASES = {
    "apache": "apache", "apache2": "apache-2.0", "apache-2": "apache-2.0", "apache-v2": "apache-2.0", "apache-license-2.0": "apache-2.0", "asl-2.0": "apache-2.0", "asl2": "apache-2.0",
    "gpl": "gpl", "gpl2": "gpl-2.0", "gpl3": "gpl-3.0", "gplv2": "gpl-2.0", "gplv3": "gpl-3.0", "gpl-v2": "gpl-2.0", "gpl-v3": "gpl-3.0", "gplv2+": "gpl-2.0-or-later", "gplv3+": "gpl-3.0-or-later",
    "lgpl": "lgpl", "lgplv2.1": "lgpl-2.1", "lgplv3": "lgpl-3.0", "lgpl-v3": "lgpl-3.0", "lgplv3+": "lgpl-3.0-or-later", "agpl": "agpl", "agplv3": "agpl-3.0", "agpl-v3": "agpl-3.0", "agplv3+": "agpl-3.0-or-later",
    "bsd": "bsd", "bsd2": "bsd-2-clause", "bsd3": "bsd-3-clause", "bsd-2": "bsd-2-clause", "bsd-3": "bsd-3-clause", "new-bsd": "bsd-3-clause", "simplified-bsd": "bsd-2-clause",
    "mpl": "mpl", "mpl2": "mpl-2.0", "mplv2": "mpl-2.0", "mplv2.0": "mpl-2.0", "epl": "epl", "epl2": "epl-2.0", "eplv2": "epl-2.0", "eupl": "eupl", "cddl": "cddl", "cc0": "cc0-1.0", "cc-0": "cc0-1.0",
    "expat": "mit", "public-domain": "public-domain", "publicdomain": "public-domain", "proprietary": "proprietary", "commercial": "proprietary", "unlicensed": "proprietary",
}

_GAP = r"""(?:[\s"'“”‘’`*#/;>|-]+)"""

#: Ids that occur in SPDX expressions besides those of LICENSES and CC_KINDS.
SPDX_ONLY = (
    "gpl-1.0", "lgpl-2.0", "agpl-1.0", "gfdl-1.1", "gfdl-1.2", "mit-0", "bsd-1-clause", "bsd-3-clause-clear", "curl", "zpl-2.1", "ntp",
    "hpnd", "ijg", "blueoak-1.0.0", "mulanpsl-2.0", "eupl-1.1", "unicode-dfs-2016", "unicode-3.0", "python-2.0", "libtiff", "artistic-1.0-perl",
)
_SPDX = re.compile(r"spdx-license-identifier:\s*")
_SPDX_TOKEN = re.compile(r"[ \t]*([()]|[\w.+:-]*[\w+])")


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: re.Pattern[str]
    priority: int
    confidence: float


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    confidence: float


def _names() -> Iterator[tuple[str, str, str, str | None]]:
    yield from LICENSES
    for kind, words in CC_KINDS:
        for version in CC_VERSIONS:
            v = re.escape(version)
            yield (
                f"cc-{kind}-{version}", "c", rf"(?:a\s+|the\s+)?(?:cc[ -]{kind}|creative\s+commons\s+{words})[ -](?:v)?{v}",
                rf"creativecommons\.org/licenses/{kind}/{v}",
            )


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first."""
    made = []
    for label, keyword, name, url in _names():
        for template, priority, confidence in TEMPLATES:
            if "{url}" in template and url is None:
                continue
            if label in PRODUCTS:
                template = template.replace(r"(?:\s+licen[cs]e)?(?!\w)", r"\s+licen[cs]e(?!\w)")
            body = template.replace("{id}", re.escape(label)).replace("{name}", name).replace("{url}", url or "")
            if label.startswith("cc-"):
                keyword = "cc" if "{id}" in template else "creative" if "{url}" in template else ""
            elif "{id}" in template:
                keyword = label.split("-")[0]
            elif "{url}" in template:
                keyword = re.split(r"\\", url)[0]
            made.append(Rule(label, keyword, re.compile(body), priority, confidence))
            if keyword == "":
                made[-1] = made[-1]._replace(keyword="cc")
                made.append(Rule(label, "creative", re.compile(body), priority, confidence))
            if not label.startswith("cc-"):
                keyword = next(k for i, k, *_ in LICENSES if i == label)
    for label, phrase, words, priority, confidence in SIGNATURES:
        keyword = max(phrase.split(), key=len)  # one word: comment marks may stand between words
        made.append(Rule(label, keyword, re.compile(_spaced(words), re.DOTALL), priority, confidence))
    made += _abbreviated()
    return tuple(sorted(made, key=lambda r: -r.priority))


def _abbreviated() -> Iterator[Rule]:
    """Abbreviations with a version, GNU ones with what is said of later versions, and without one where the words say license."""
    for name, versions in ABBREVIATIONS:
        start = rf"(?<![\w.-])(?:gnu\s+)?{name}"
        for version in versions:
            label = f"{name}-{version}" if "." in version else f"{name}-{version}.0"
            body = start + rf"(?:,?\s*|[-_])(?:v(?:ersion|er)?[.]?\s*)?{re.escape(version)}" + ("" if "." in version else r"(?:[.]0)?")
            if name in GNU:
                yield Rule(f"{label}-or-later", name, re.compile(body + _LATER), 45, 0.85)
                yield Rule(f"{label}-only", name, re.compile(body + r"(?:-only|\s+only)(?!\w)"), 45, 0.85)
                yield Rule(label, name, re.compile(body + rf"(?![.]?\d)(?!\w)(?!-only|\s+only(?!\w))(?!{_LATER})"), 44, 0.85)
            else:
                yield Rule(label, name, re.compile(body + r"(?![.]?\d)(?!\w)"), 44, 0.85)
        bare = r"(?!\w)(?!(?:,?\s*|[-_])(?:v(?:ersion|er)?[.]?\s*)?\d)"
        said = rf"(?:(?:under|by)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:gnu\s+)?{name}|(?<![\w.-])gnu\s+{name}){bare}|(?<![\w.-]){name}[\s-]+licen[cs]ed?(?!\w)"
        yield Rule(name, name, re.compile(said), 42, 0.7)
    for kind, _ in CC_KINDS:
        for version in ("1.0", *CC_VERSIONS):
            words = kind.replace("-", "[ -]")
            yield Rule(f"cc-{kind}-{version}", "cc", re.compile(rf"(?<![\w-])cc[ -]{words}[ -]v?{re.escape(version)}(?![.]?\d)"), 46, 0.85)


_KEYED = re.compile(r"""(?<!\w)licen[cs]es?["']?\s*(?:=>|[:=])\s*["'\[({<]*\s*""")
FAMILIES = frozenset((*(name for name, _ in ABBREVIATIONS), "apache"))
_NEXT_VERSION = re.compile(r"(?:,?[ \t]*|[-_])(?:licen[cs]e,?[ \t]+)?(?:v(?:ersion|er)?[.]?[ \t]*)?\d{1,2}(?!\d)")
_BADGE = re.compile(r"licen[cs]e[-_]([a-z0-9][a-z0-9.+_%-]*?)[-_](?:blue|(?:bright|yellow)?green|yellow|red|orange|lightgr[ea]y|informational|success|[0-9a-f]{6})(?![a-z0-9])")


def keyed_detections(lower: str) -> Iterator[Detection]:
    """Licenses named after "license:" or "license =", and on badges."""
    for tag in _KEYED.finditer(lower):
        yield from _expression(lower, tag.end(), tag.start(), 75, 0.9)
    for badge in _BADGE.finditer(lower):
        name = badge[1].replace("--", "-").replace("%20", "-").replace("_", "-")
        if label := _spdx_label(name) or ALIASES.get(name):
            yield Detection(badge.start(), badge.end(), label, 75, 0.9)


@lru_cache(maxsize=1)
def _bsd() -> tuple[re.Pattern[str], list[tuple[str, re.Pattern[str], int, float]]]:
    return re.compile(_spaced(BSD_HEAD)), [(label, re.compile(_spaced(words)), *rest) for label, words, *rest in BSD_CLAUSES]


def bsd_detections(lower: str) -> Iterator[Detection]:
    """BSD texts by the clauses that stand between their beginning and the next one's, however long that is."""
    head, clauses = _bsd()
    heads = list(head.finditer(lower))
    for k, at in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(lower)
        for label, clause, priority, confidence in clauses:
            if clause.search(lower, at.end(), end):
                yield Detection(at.start(), at.end(), label, priority, confidence)
                break
        else:
            yield Detection(at.start(), at.end(), "bsd", 50, 0.8)


def other_detections(lower: str) -> Iterator[Detection]:
    """What is found by reading on from a place, not by one pattern."""
    yield from spdx_detections(lower)
    yield from keyed_detections(lower)
    yield from bsd_detections(lower)


def _spaced(words: str) -> str:
    """A signature with gaps for its spaces; brackets and semicolons may have quotes and marks beside them."""
    quote = r"""["'“”‘’`]*"""
    return words.replace("[(]", "[(]" + quote).replace("[)]", quote + "[)]").replace("as-is,?", r"""as-is["'“”‘’`]*,?["'“”‘’`]*""").replace(" ", _GAP)


@lru_cache(maxsize=1)
def _spdx_ids() -> frozenset[str]:
    return frozenset((*(n[0] for n in _names()), *SPDX_ONLY))


def _spdx_label(token: str) -> str | None:
    """The label of an id in an SPDX expression: ``+`` is the older form of -or-later."""
    base, later = (token[:-1], True) if token.endswith("+") else (token, False)
    for end in ("-only", "-or-later"):
        if base.endswith(end) and base.removesuffix(end) in _spdx_ids() and not later:
            return base
    if base not in _spdx_ids():
        return None
    return f"{base}-or-later" if later and re.match(r"(?:a|l)?gpl-|gfdl-", base) else base


def _expression(lower: str, at: int, start: int | None, priority: int, confidence: float) -> Iterator[Detection]:
    """One detection for every known id of the expression at ``at``; the first one includes the tag at ``start``."""
    operand = True
    while token := _SPDX_TOKEN.match(lower, at):
        word = token[1]
        if word in ("and", "or", "with"):
            if operand:
                break
            operand = True
            if word == "with":  # the exception that follows is no license
                skipped = _SPDX_TOKEN.match(lower, token.end())
                at, operand = (skipped or token).end(), False
                continue
        elif word not in "()":
            if not operand:
                break
            operand = False
            label = _spdx_label(word) or (ALIASES.get(word) if priority < 100 else None)
            if label and not (label in FAMILIES and _NEXT_VERSION.match(lower, token.end())):  # the version's own rule has it
                yield Detection(token.start(1) if start is None else start, token.end(), label, priority, confidence)
                start = None
        at = token.end()


def spdx_detections(lower: str) -> Iterator[Detection]:
    for tag in _SPDX.finditer(lower):
        yield from _expression(lower, tag.end(), tag.start(), 100, 1.0)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    by: dict[str, list[Rule]] = {}
    for rule in rules():
        by.setdefault(rule.keyword, []).append(rule)
    automaton = ahocorasick.Automaton()
    for keyword in by:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return automaton, by


_UPPER = {k: k + 32 for k in range(65, 91)}


def detect(text: str | None) -> list[Detection]:
    """The detections of a whole text that stand after suppression, in order of place."""
    lower = (text or "").translate(_UPPER)
    # keywords with a space also match across line ends and runs of spaces
    flat = " ".join(lower.split())
    automaton, by = _automaton()
    present = {keyword for _, keyword in automaton.iter(flat)}
    found = {
        Detection(m.start(), m.end(), rule.label, rule.priority, rule.confidence)
        for keyword in present
        for rule in by[keyword]
        for m in rule.pattern.finditer(lower)
    }
    if "licen" in lower or "redistribution" in lower:
        found.update(other_detections(lower))
    return suppressed(found)


def suppressed(found: set[Detection]) -> list[Detection]:
    """Drop each detection inside an accepted one; higher priority, then longer, then label goes first.

    Accepted ones are kept as starts with the furthest end so far, so each test is one binary search.
    """
    from bisect import bisect_right

    order = sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label))
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []  # of the accepted, no interval inside another
    for d in order:
        k = bisect_right(starts, d.start) - 1
        if k >= 0 and ends[k] >= d.end:
            continue
        kept.append(d)
        # intervals that the new one covers need no test of their own any more
        at = bisect_right(starts, d.start - 1)
        upto = at
        while upto < len(starts) and ends[upto] <= d.end:
            upto += 1
        starts[at:upto], ends[at:upto] = [d.start], [d.end]
    return sorted(kept)


#: Bytes of words: digits, letters (upper case lowered) and all beyond ASCII; the rest separates.
_WORD_BYTES = bytes(
    k + 32 if 65 <= k <= 90 else k if 48 <= k <= 57 or 97 <= k <= 122 or k >= 128 else 32 for k in range(256)
)


def base_scan(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """(number of words, (start word, label) of every place of a phrase)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    places: list[tuple[int, str]] = []
    if b"license" in words:
        line = b" " + b" ".join(words) + b" "
        for phrase, label in PHRASES:
            sought, at, seen, before = f" {phrase} ".encode(), -1, 0, 0
            while (at := line.find(sought, at + 1)) >= 0:
                seen, before = seen + line.count(b" ", before, at), at
                places.append((seen, label))
    return len(words), places


SPAN = "array<struct<start:int,end:int,label:string,priority:int,confidence:double>>"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) per row.

    ``labels`` joins the base labels and those of the rules, ``score`` is the highest confidence (a base
    place counts 0.6). Null and empty texts have no words and no detections; texts are scanned whole;
    repeated rows are scanned alike; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fields = [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())]))),
    ]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body in batch.column(1):
                n, places = base_scan(body.as_py())
                found = detect(body.as_py())
                at = [p for p, _ in places]
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(d.label for d in found)})
                score = max([0.6 * bool(places), *(d.confidence for d in found)])
                out.append((
                    n, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score,
                    [d._asdict() for d in found],
                ))
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))],
                names=["doc_id", *(n for n, _ in fields)],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        f"labels string, score double, detections {SPAN}"
    )
    return rows.mapInArrow(scan, schema)
