"""License scans by ordered signature rules.

Rules are regular expressions, each with keywords, a label, a priority and a confidence. One automaton searches a text for all keywords first; only rules
whose keywords it has are tried. Of overlapping detections, one that lies inside another of a higher priority, or inside a longer one of
the same, is suppressed. A space in a rule or keyword stands for any run of white space with at most one line break and the comment signs after it; blank
lines part statements. Base phrases are found by their words, exactly, and are never suppressed.

A null or empty text has no words and no labels; its labels are empty strings and its score 0. Very long texts are scanned whole. Equal texts get equal results, repeated rows a row
each; of detections as good as each other the first rule's stays. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import base

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: label: (how the name is written, after lower-casing; its keyword; its SPDX identifier).
FAMILIES = {
    "mit": (r"(?:mit|expat)", "mit", "mit"),
    "apache-1.1": (r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.1", "apache", "apache-1.1"),
    "apache-2.0": (r"apache(?: licen[cs]e)?,? ?(?:version |v)?2(?:\.0)?", "apache", "apache-2.0"),
    "bsd-2-clause": (r"(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd|freebsd)", "bsd", "bsd-2-clause"),
    "bsd-3-clause": (r"(?:bsd[ -]3[ -]clause|3[ -]clause bsd|new bsd|modified bsd)", "bsd", "bsd-3-clause"),
    "bsd-4-clause": (r"(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)", "bsd", "bsd-4-clause"),
    "isc": (r"isc", "isc", "isc"),
    "zlib": (r"zlib(?:/libpng)?", "zlib", "zlib"),
    "boost-1.0": (r"boost software", "boost", "bsl-1.0"),
    "gpl-2.0": (r"(?:gnu )?(?:gpl|general public licen[cs]e),? ?(?:version |v)?2(?:\.0)?", "gpl|general public licen", "gpl-2.0"),
    "gpl-3.0": (r"(?:gnu )?(?:gpl|general public licen[cs]e),? ?(?:version |v)?3(?:\.0)?", "gpl|general public licen", "gpl-3.0"),
    "lgpl-2.1": (r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e),? ?(?:version |v)?2\.1", "lgpl|lesser general public licen", "lgpl-2.1"),
    "lgpl-3.0": (r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e),? ?(?:version |v)?3(?:\.0)?", "lgpl|lesser general public licen", "lgpl-3.0"),
    "agpl-3.0": (r"(?:gnu )?(?:agpl|affero general public licen[cs]e),? ?(?:version |v)?3(?:\.0)?", "agpl|affero general public licen", "agpl-3.0"),
    "mpl-1.1": (r"(?:mpl|mozilla public licen[cs]e),? ?(?:version |v)?1\.1", "mpl|mozilla public licen", "mpl-1.1"),
    "mpl-2.0": (r"(?:mpl|mozilla public licen[cs]e),? ?(?:version |v)?2(?:\.0)?", "mpl|mozilla public licen", "mpl-2.0"),
    "epl-1.0": (r"(?:epl|eclipse public licen[cs]e),? ?(?:version |v)?1(?:\.0)?", "epl|eclipse public licen", "epl-1.0"),
    "epl-2.0": (r"(?:epl|eclipse public licen[cs]e),? ?(?:version |v)?2(?:\.0)?", "epl|eclipse public licen", "epl-2.0"),
    "eupl-1.2": (r"(?:eupl|european union public licen[cs]e),? ?(?:version |v)?1\.2", "eupl|european union public licen", "eupl-1.2"),
    "cddl-1.0": (r"(?:cddl|common development and distribution licen[cs]e),? ?(?:version |v)?1(?:\.0)?", "cddl|common development and distribution", "cddl-1.0"),
    "artistic-2.0": (r"(?:perl )?artistic licen[cs]e,? ?(?:version |v)?2(?:\.0)?", "artistic", "artistic-2.0"),
    "unlicense": (r"(?:the )?unlicen[cs]e", "unlicen", "unlicense"),
    "wtfpl": (r"(?:wtfpl|do what the fuck you want to public)", "wtfpl|do what the fuck", "wtfpl"),
    "ofl-1.1": (r"(?:sil )?open font", "open font", "ofl-1.1"),
    "psf-2.0": (r"(?:psf|python software foundation)", "psf|python software", "psf-2.0"),
    "postgresql": (r"postgresql", "postgresql", "postgresql"),
    "ms-pl": (r"(?:ms-pl|microsoft public)", "ms-pl|microsoft public", "ms-pl"),
    "openssl": (r"openssl", "openssl", "openssl"),
    "gfdl-1.3": (r"(?:gnu )?(?:gfdl|free documentation licen[cs]e),? ?(?:version |v)?1\.3", "gfdl|free documentation", "gfdl-1.3"),
    "odbl-1.0": (r"(?:odbl|open database)", "odbl|open database", "odbl-1.0"),
    "cc0-1.0": (r"(?:cc0|cc[ -]zero|creative commons zero)(?: 1\.0)?", "cc0|cc zero|cc-zero|creative commons zero", "cc0-1.0"),
    "cc-by-4.0": (r"(?:cc[ -]by|creative commons attribution)[ -](?:v|version )?4\.0", "cc by|cc-by|creative commons attribution", "cc-by-4.0"),
    "cc-by-3.0": (r"(?:cc[ -]by|creative commons attribution)[ -](?:v|version )?3\.0", "cc by|cc-by|creative commons attribution", "cc-by-3.0"),
    "cc-by-sa-4.0": (r"(?:cc[ -]by-sa|creative commons attribution-sharealike)[ -]4\.0", "cc by|cc-by|creative commons attribution", "cc-by-sa-4.0"),
    "cc-by-sa-3.0": (r"(?:cc[ -]by-sa|creative commons attribution-sharealike)[ -]3\.0", "cc by|cc-by|creative commons attribution", "cc-by-sa-3.0"),
    "cc-by-nc-4.0": (r"(?:cc[ -]by-nc|creative commons attribution-noncommercial)[ -]4\.0", "cc by|cc-by|creative commons attribution", "cc-by-nc-4.0"),
    "cc-by-nc-sa-4.0": (r"(?:cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike)[ -]4\.0", "cc by|cc-by|creative commons attribution", "cc-by-nc-sa-4.0"),
    "cc-by-nd-4.0": (r"(?:cc[ -]by-nd|creative commons attribution-noderivatives)[ -]4\.0", "cc by|cc-by|creative commons attribution", "cc-by-nd-4.0"),
    "cc-by-nc-nd-4.0": (r"(?:cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderivatives)[ -]4\.0", "cc by|cc-by|creative commons attribution", "cc-by-nc-nd-4.0"),
    "gpl-1.0": (r"(?:gnu )?(?:gpl|general public licen[cs]e),? ?(?:version |v)?1(?:\.0)?", "gpl|general public licen", "gpl-1.0"),
    "lgpl-2.0": (r"(?:gnu )?(?:lgpl|library general public licen[cs]e),? ?(?:version |v)?2(?:\.0)?(?!\.?\d)", "lgpl|library general public licen", "lgpl-2.0"),
    "gfdl-1.2": (r"(?:gnu )?(?:gfdl|free documentation licen[cs]e),? ?(?:version |v)?1\.2", "gfdl|free documentation", "gfdl-1.2"),
    "eupl-1.1": (r"(?:eupl|european union public licen[cs]e),? ?(?:version |v)?1\.1", "eupl|european union public licen", "eupl-1.1"),
    "afl-3.0": (r"(?:afl|academic free licen[cs]e),? ?(?:version |v)?3(?:\.0)?", "afl|academic free", "afl-3.0"),
    "osl-3.0": (r"(?:osl|open software licen[cs]e),? ?(?:version |v)?3(?:\.0)?", "osl|open software", "osl-3.0"),
    "sspl-1.0": (r"(?:sspl|server side public)", "sspl|server side public", "sspl-1.0"),
    "busl-1.1": (r"(?:busl|business source)", "busl|business source", "busl-1.1"),
    "upl-1.0": (r"(?:upl|universal permissive)(?!\w)", "upl|universal permissive", "upl-1.0"),
    "0bsd": (r"(?:0bsd|zero[ -]clause bsd|bsd[ -]zero[ -]clause)", "bsd", "0bsd"),
    "mit-0": (r"(?:mit-0|mit no attribution)", "mit", "mit-0"),
    "ncsa": (r"(?:ncsa|university of illinois/ncsa open source)(?!\w)", "ncsa", "ncsa"),
    "vim": (r"vim(?!\w)", "vim", "vim"),
    "ruby": (r"ruby(?!\w)", "ruby", "ruby"),
    "php-3.01": (r"php(?: licen[cs]e,?)? ?(?:version |v)?3\.01", "php", "php-3.01"),
}
#: Names without a version or clause count; those with one are longer and win. They have no SPDX identifier.
UNVERSIONED = {
    "gpl": (r"(?:gnu )?(?:gpl|general public licen[cs]e)(?!\w)", "gpl|general public licen"),
    "lgpl": (r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)(?!\w)", "lgpl|lesser general public licen|library general public licen"),
    "agpl": (r"(?:gnu )?(?:agpl|affero general public licen[cs]e)(?!\w)", "agpl|affero general public licen"),
    "gfdl": (r"(?:gnu )?(?:gfdl|free documentation)(?!\w)", "gfdl|free documentation"),
    "apache": (r"apache(?: software)?(?!\w)", "apache"),
    "bsd": (r"bsd(?:-style)?(?!\w)", "bsd"),
    "mpl": (r"(?:mpl|mozilla public)(?!\w)", "mpl|mozilla public"),
    "epl": (r"(?:epl|eclipse public)(?!\w)", "epl|eclipse public"),
    "artistic": (r"(?:perl )?artistic(?!\w)", "artistic"),
    "cc-by": (r"(?:cc[ -]by|creative commons attribution)(?!\w)", "cc by|cc-by|creative commons attribution"),
    "cc-by-sa": (r"(?:cc[ -]by-sa|creative commons attribution-sharealike)(?!\w)", "cc by-sa|cc-by-sa|creative commons attribution-sharealike"),
    "cc-by-nc": (r"(?:cc[ -]by-nc|creative commons attribution-noncommercial)(?!\w)", "cc by-nc|cc-by-nc|creative commons attribution-noncommercial"),
    "cc-by-nd": (r"(?:cc[ -]by-nd|creative commons attribution-noderivatives)(?!\w)", "cc by-nd|cc-by-nd|creative commons attribution-noderivatives"),
}
#: How a license is stated: (pattern around the name, keyword, priority, confidence). The order is that of the rules. A group `id` is the detection; what is around it is its context.
STATEMENTS = (
    (r"spdx-license-identifier:[^\n]{0,200}?(?<![\w.-])(?P<id>{spdx})(?:-only|-or-later|\+)?(?![\w.+-]*\w)", "spdx", 100, 0.99),
    (r"(?P<id>{spdx})(?:(?:-only|-or-later|\+|(?<=\d))(?= (?:or|and) [a-z])|(?= (?:or|and) [a-z][a-z-]*-\d))", "{spdx} or |{spdx} and |{spdx}-o|{spdx}+", 92, 0.9),
    (r"(?:(?<=\d or )|(?<=\d and )|(?<=only or )|(?<=later or )|(?<=only and )|(?<=later and )|(?:(?<= or )|(?<= and ))(?=[a-z]+(?:-[a-z]+)*-\d))(?P<id>{spdx})(?:-only|-or-later|\+)?(?![\w.+-]*\w)", " or {spdx}| and {spdx}", 92, 0.9),
    (r"(?:is |are |be )?licen[cs]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?", "licen", 90, 0.95),
    (r"(?:re)?leased under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?", "leased under", 90, 0.95),
    (r"(?:distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?", " under", 85, 0.9),
    (r"under the terms of (?:the )?{name}(?: licen[cs]e)?", "under the terms", 80, 0.9),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{name} licen[cs]e", "subject to", 75, 0.8),
    (r"[\"']?licen[cs]es?[\"']?\s*[:=]\s*[\"']?(?:the )?{name}(?![\w.])", "licen", 70, 0.85),
    (r"(?:the |this )?{name} licen[cs]e(?! plate)", "licen", 40, 0.6),
)
#: The first statements speak of SPDX identifiers.
BY_IDENTIFIER = 3
#: What may not follow a name: more of a word or of a version.
END = r"(?!\w|[.-]\d)"

# Sentences of license texts and notices, as patterns, and places where the texts are kept. A rule's keyword is the longest plain part of its pattern.
SENTENCES = {
    "mit": (
        r"permission is hereby granted, free of charge, to any person obtaining a copy", r"to deal in the software without restriction, including without limitation the rights to use",
        r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "x11": (r"except as contained in this notice, the name of the x consortium shall not be used", r"the name\(?s\)? of the above copyright holders? shall not be used in advertising"),
    "isc": (r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    "hpnd": (r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose", r"makes no representations about the suitability of this software for any purpose"),
    "bsd": (
        r"redistributions? (?:and use )?in source and binary forms?", r"redistributions of source code must retain the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice",
        r"this software is provided by the (?:copyright holders|regents|authors?) and contributors \"?as is\"?",
    ),
    "bsd-3-clause": (r"neither the names? of (?:the )?.{2,80}? nor the names of (?:its|their) contributors may be used to endorse", r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-4-clause": (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment",),
    "apache-1.1": (r"the end-user documentation included with the redistribution, if any, must include the following acknowledge?ment",),
    "apache-2.0": (
        r"you may not use this file except in compliance with the license", r"you may obtain a copy of the license at", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements",
        r"grant of patent license\. subject to the terms and conditions of this license, each contributor hereby grants",
    ),
    "gpl": (
        r"(?:gnu )?general public licen[cs]e", r"this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e",
        r"you should have received a copy of the gnu general public licen[cs]e", r"see the gnu general public licen[cs]e for more details", r"the gnu general public license is a free, copyleft license",
    ),
    "gpl-2.0": (r"general public licen[cs]e(?: \(gpl\))? as published by the free software foundation[;,]? (?:either )?version 2", r"general public licen[cs]e[,;]? version 2 as published by", r"gnu general public license version 2, june 1991"),
    "gpl-3.0": (r"general public licen[cs]e(?: \(gpl\))? as published by the free software foundation[;,]? (?:either )?version 3", r"general public licen[cs]e[,;]? version 3 as published by", r"gnu general public license version 3, 29 june 2007"),
    "lgpl": (
        r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e",
        r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e",
    ),
    "lgpl-2.1": (r"lesser general public licen[cs]e as published by the free software foundation[;,]? (?:either )?version 2\.1", r"gnu lesser general public license version 2\.1, february 1999"),
    "lgpl-3.0": (r"lesser general public licen[cs]e as published by the free software foundation[;,]? (?:either )?version 3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    "agpl": (r"(?:gnu )?affero general public licen[cs]e", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    "agpl-3.0": (r"affero general public licen[cs]e as published by the free software foundation[;,]? (?:either )?version 3", r"gnu affero general public license version 3, 19 november 2007"),
    "gfdl": (r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    "mpl-1.1": (r"the contents of this file are subject to the mozilla public licen[cs]e,? version 1\.1",),
    "mpl-2.0": (r"this source code form is subject to the terms of the mozilla public licen[cs]e", r"if a copy of the mpl was not distributed with this file"),
    "epl": (r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", r"the accompanying program is provided under the terms of this eclipse public license"),
    "cpl-1.0": (r"made available under the terms of the common public licen[cs]e", r"the accompanying program is provided under the terms of this common public license"),
    "cddl": (r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", r"when distributing covered (?:code|software), include this cddl header notice in each file"),
    "zlib": (
        r"this software is provided 'as-is', without any express or implied warranty", r"altered source versions must be plainly marked as such, and must not be misrepresented",
        r"the origin of this software must not be misrepresented[;,] you must not claim that you wrote the original software",
    ),
    "boost-1.0": (r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", r"boost software license - version 1\.0"),
    "unlicense": (r"this is free and unencumbered software released into the public domain", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    "wtfpl": (r"you just do what the fuck you want to", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed"),
    "cc0-1.0": (r"to the extent possible under law, .{2,80}? (?:has|have) waived all copyright", r"creative commons legal code cc0 1\.0 universal"),
    "cc-by": (r"this work is licensed under a creative commons attribution (?:[\d.]+ )?(?:international|unported|generic)? ?licen[cs]e",),
    "cc-by-sa": (r"licensed under a creative commons attribution-share ?alike", r"text is available under the creative commons attribution-sharealike"),
    "cc-by-nc": (r"licensed under a creative commons attribution-non-?commercial",),
    "cc-by-nd": (r"licensed under a creative commons attribution-no ?deriv",),
    "artistic": (r"the intent of this document is to state the conditions under which a package may be copied", r"under the same terms as perl itself", r"you may distribute under the terms of either the gnu general public license or the artistic license"),
    "python-2.0": (r"psf is making python available to licensee on an \"as is\" basis", r"python software foundation license version 2"),
    "postgresql": (r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",),
    "openssl": (r"this product includes software developed by the openssl project for use in the openssl toolkit", r"this product includes cryptographic software written by eric young"),
    "ofl-1.1": (r"this font software is licensed under the sil open font license, version 1\.1", r"the font software may be sold as part of a larger software package but"),
    "ms-pl": (r"if you use the software, you accept this license\. if you do not accept the license, do not use the software",),
    "vim": (r"there are no restrictions on distributing unmodified copies of vim",),
    "beerware": (r"if we meet some day,? and you think this stuff is worth it, you can buy me a beer", r"beer-?ware licen[cs]e"),
    "json": (r"the software shall be used for good, not evil",),
    "ncsa": (r"to deal with the software without restriction, including without limitation the rights to use",),
    "sspl-1.0": (r"if you make the functionality of the program or a modified version available to third parties as a service",),
    "busl-1.1": (r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work", r"change date: .{4,40}? change license"),
    "commons-clause": (r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software", r"\"commons clause\" license condition"),
    "elastic-2.0": (r"you may not provide the software to third parties as a hosted or managed service",),
    "openrail": (r"use-based restrictions as referenced in paragraph 5", r"open rail-?m licen[cs]e", r"bigscience (?:rail|openrail-m)"),
    "llama": (r"llama [\d.]+ (?:community )?license agreement", r"built with (?:meta )?llama"),
    "eupl": (r"licensed under the eupl", r"the european union public licen[cs]e"),
    "ogl-uk": (r"contains public sector information licensed under the open government licen[cs]e", r"open government licen[cs]e v[123]"),
    "odbl": (r"made available under the open database licen[cs]e", r"any rights in individual contents of the database are licensed under the database contents licen[cs]e"),
    "gutenberg": (r"this ebook is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost", r"project gutenberg(?:-tm|™)? licen[cs]e"),
    "public-domain": (r"(?:dedicated to|released into|in) the public domain", r"the authors? disclaims? copyright to this source code", r"no copyright is claimed in the united states under title 17"),
    "proprietary": (
        r"proprietary and confidential", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", r"may not be reproduced,? (?:distributed|stored)[^.]{0,80} without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)",
        r"no part of this (?:publication|book|work|document) may be reproduced", r"for internal use only[.;,] not for distribution", r"this software is the confidential and proprietary information of",
    ),
    "non-commercial": (r"for non-?commercial use only", r"for (?:personal|academic|research) (?:and non-?commercial )?use only", r"commercial use (?:is|of this \w+ is) (?:strictly )?prohibited"),
    "dual": (r"dual[- ]licen[cs]ed under", r"(?:licensed|available) under (?:either|your choice) of", r"you may (?:choose|select), at your option, one of the (?:above-listed|following) licen[cs]es"),
    "no-warranty": (
        r"(?:the software|this software|this program|it) is provided \"?as is\"?,? without warranty of any kind", r"in no event shall the (?:authors?|copyright (?:holders?|owners?)) (?:or [a-z ]{2,40} )?be liable for any",
        r"but without any warranty[;,] without even the implied warranty of", r"distributed on an \"?as is\"? basis,? without warranties or conditions of any kind",
    ),
    "copyright": (r"(?:copyright|\(c\)|©) ?(?:\(c\)|©)? ?(?:19|20)\d\d",),
    "reserved": (r"all rights reserved",),
}
#: Sentences that say less than a license's own words: (priority, confidence). Others have SURE.
WEAK = {"gpl": (30, 0.6), "lgpl": (30, 0.6), "agpl": (30, 0.6), "public-domain": (60, 0.7), "proprietary": (60, 0.8), "non-commercial": (60, 0.7), "dual": (60, 0.6), "no-warranty": (25, 0.5), "copyright": (20, 0.4), "reserved": (20, 0.4)}
SURE = (95, 0.95)
#: Keywords of the few sentences that have no plain part of their own.
KEYWORDS = {"copyright": "copyright|(c)|©"}
LINKS = {
    "apache-1.1": (r"apache\.org/licenses/license-1\.1",), "apache-2.0": (r"apache\.org/licenses/license-2\.0", r"opensource\.org/licenses?/apache-2\.0"),
    "mit": (r"opensource\.org/licenses?/mit", r"mit-license\.org", r"choosealicense\.com/licenses/mit"), "isc": (r"opensource\.org/licenses?/isc", r"isc\.org/licenses"),
    "bsd-2-clause": (r"opensource\.org/licenses?/bsd-2-clause",), "bsd-3-clause": (r"opensource\.org/licenses?/bsd-3-clause",), "bsd": (r"opensource\.org/licenses/bsd-license",),
    "gpl": (r"gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt|\b)",), "gpl-2.0": (r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", r"opensource\.org/licenses?/gpl-2\.0"), "gpl-3.0": (r"gnu\.org/licenses/gpl-3\.0", r"opensource\.org/licenses?/gpl-3\.0"),
    "lgpl": (r"gnu\.org/(?:licenses|copyleft)/lgpl(?:\.html|\.txt|\b)",), "lgpl-2.1": (r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", r"opensource\.org/licenses?/lgpl-2\.1"), "lgpl-3.0": (r"gnu\.org/licenses/lgpl-3\.0",),
    "agpl-3.0": (r"gnu\.org/licenses/agpl-3\.0", r"opensource\.org/licenses?/agpl-3\.0"), "agpl": (r"gnu\.org/licenses/agpl(?:\.html|\.txt|\b)",), "gfdl": (r"gnu\.org/(?:licenses|copyleft)/fdl",),
    "mpl-1.1": (r"mozilla\.org/mpl/mpl-1\.1",), "mpl-2.0": (r"mozilla\.org/(?:en-us/)?mpl/2\.0", r"opensource\.org/licenses?/mpl-2\.0"), "epl-1.0": (r"eclipse\.org/legal/epl-v10",), "epl-2.0": (r"eclipse\.org/legal/epl-(?:2\.0|v20)",),
    "cddl": (r"opensource\.org/licenses?/cddl", r"sun\.com/cddl"), "boost-1.0": (r"boost\.org/license_1_0\.txt",), "zlib": (r"zlib\.net/zlib_license", r"opensource\.org/licenses?/zlib"), "unlicense": (r"unlicense\.org",), "wtfpl": (r"wtfpl\.net", r"sam\.zoy\.org/wtfpl"),
    "cc0-1.0": (r"creativecommons\.org/publicdomain/zero/1\.0",), "public-domain": (r"creativecommons\.org/publicdomain/mark/1\.0", r"creativecommons\.org/licenses/publicdomain"),
    "ofl-1.1": (r"scripts\.sil\.org/ofl", r"openfontlicense\.org"), "artistic-2.0": (r"opensource\.org/licenses?/artistic-2\.0", r"perlfoundation\.org/artistic_license_2_0"), "python-2.0": (r"docs\.python\.org/[\w./]*license\.html",),
    "ms-pl": (r"opensource\.org/licenses?/ms-pl",), "eupl": (r"joinup\.ec\.europa\.eu/[\w/-]*eupl",), "odbl": (r"opendatacommons\.org/licenses/odbl",), "pddl": (r"opendatacommons\.org/licenses/pddl",), "odc-by": (r"opendatacommons\.org/licenses/by",),
    "ogl-uk": (r"nationalarchives\.gov\.uk/doc/open-government-licence",), "sspl-1.0": (r"mongodb\.com/licensing/server-side-public-license",), "elastic-2.0": (r"elastic\.co/licensing/elastic-license",), "commons-clause": (r"commonsclause\.com",),
    "busl-1.1": (r"mariadb\.com/bsl11",), "upl-1.0": (r"oss\.oracle\.com/licenses/upl",), "gutenberg": (r"gutenberg\.org/license",), "postgresql": (r"postgresql\.org/about/licen[cs]e",), "php-3.01": (r"php\.net/license/3_01",), "vim": (r"vimdoc\.sourceforge\.net/htmldoc/uganda",),
}
#: Creative Commons keeps its texts by name and version.
CC_NAMES, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("2.0", "2.5", "3.0", "4.0")


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]  # of each, one alternative has to be there
    pattern: re.Pattern
    priority: int
    confidence: float

    @property
    def named(self) -> bool:
        return "id" in self.pattern.groupindex


def keyword(pattern: str) -> str:
    """The longest plain part of a pattern: what stands in every text that it matches."""
    parts = [""]
    for kind, value in _parser.parse(pattern):
        if kind is _parser.LITERAL:
            parts[-1] += chr(value)
        else:
            parts.append("")
    return max(parts, key=len)


def rules() -> list[Rule]:
    """All rules: every family in every statement, names without a version in those that speak of names, then sentences and links."""
    out = []
    for label, (name, word, spdx) in FAMILIES.items():
        for form, own, priority, confidence in STATEMENTS:
            pattern = form.replace("{name}", f"(?:{name}){END}").replace("{spdx}", re.escape(spdx))
            out.append(Rule(label, (own.replace("{spdx}", spdx), f"{word}|{spdx}"), re.compile(r"(?<![\w])" + pattern), priority, confidence))
    for label, (name, word) in UNVERSIONED.items():
        for form, own, priority, confidence in STATEMENTS[BY_IDENTIFIER:]:
            out.append(Rule(label, (own, word), re.compile(r"(?<![\w])" + form.replace("{name}", f"(?:{name})")), priority, confidence))
    for label, sentences in SENTENCES.items():
        for pattern in sentences:
            out.append(Rule(label, (KEYWORDS.get(label) or keyword(pattern),), re.compile(r"(?<![\w])" + pattern), *WEAK.get(label, SURE)))
    links = [(label, pattern) for label, patterns in LINKS.items() for pattern in patterns]
    links += [(f"cc-{name}-{version}", rf"creativecommons\.org/licenses/{name}/{re.escape(version)}") for name in CC_NAMES for version in CC_VERSIONS]
    for label, pattern in links:
        out.append(Rule(label, (keyword(pattern),), re.compile(r"(?<![\w])(?:https?://)?(?:www\.)?" + pattern), 95, 0.98))
    return out


class Rules:
    """All rules, and an automaton of their keywords that says in one pass over a text which rules to try."""

    def __init__(self):
        self.rules, of = rules(), {}
        for k, r in enumerate(self.rules):
            for slot, words in enumerate(r.keywords):
                for w in words.split("|"):
                    of.setdefault(w, []).append((k, slot))
        self.keywords = ahocorasick.Automaton()
        for w, places in of.items():
            self.keywords.add_word(w, (w, places))
        self.keywords.make_automaton()

    def tried(self, text: str) -> list[Rule]:
        """The rules of which the text has a keyword of each kind, in their order."""
        seen: dict[str, list] = dict(v for _, v in self.keywords.iter(text))
        slots: dict[int, set[int]] = {}
        for places in seen.values():
            for k, slot in places:
                slots.setdefault(k, set()).add(slot)
        return [self.rules[k] for k in sorted(slots) if len(slots[k]) == len(self.rules[k].keywords)]


_RULES: list[Rules] = []
#: A line break with the comment signs after it.
_BREAK = r"[^\S\n]*\n[^\S\n]*(?:(?:/\*+|//+|[*#;%>!|]+|--+|<!--+|dnl\b|rem\b)[^\S\n]*)*"
_GAP = re.compile(_BREAK + r"|[^\S\n]{2,}|[^\S\n ]")


def flatten(text: str) -> tuple[str, list[int], list[int]]:
    """The text with one space for each gap, and from which place of it on how many characters are missing."""
    parts, starts, missing, at, lost = [], [], [], 0, 0
    for m in _GAP.finditer(text):
        a, b = m.span()
        parts.append(text[at:a])
        lost += b - a - 1
        starts.append(b - lost)
        missing.append(lost)
        at = b
    return (" ".join([*parts, text[at:]]), starts, missing) if starts else (text, starts, missing)


def detect(text: str, gated: bool = True) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, priority, confidence) of what the rules find in a lower-cased text and don't suppress. Without the gate all rules are tried."""
    if not _RULES:
        _RULES.append(Rules())
    text, starts, missing = flatten(text)

    def place(k: int) -> int:
        i = bisect_right(starts, k)
        return k + missing[i - 1] if i else k

    found = [(*m.span("id" if r.named else 0), r.label, r.priority, r.confidence) for r in (_RULES[0].tried(text) if gated else _RULES[0].rules) for m in r.pattern.finditer(text)]
    return [(place(a), place(b - 1) + 1, *rest) for a, b, *rest in suppress(found)]


def suppress(found: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Without detections inside one of a higher priority, or inside a longer one of the same; of equal ones the first stays.

    In order of priority, then length, the kept ones are held as intervals sorted by their starts, with no interval inside another, so both ends ascend.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        k = bisect_right(starts, d[0]) - 1
        if k >= 0 and ends[k] >= d[1]:
            continue
        kept.append(d)
        stop = k + 1
        while stop < len(starts) and ends[stop] <= d[1]:  # a longer one of a lower priority takes over
            stop += 1
        first = k if k >= 0 and starts[k] == d[0] else k + 1
        starts[first:stop], ends[first:stop] = [d[0]], [d[1]]
    return sorted(kept)


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _base_places(words: base.Words) -> tuple[list[np.ndarray], list[str]]:
    """Word positions at which each base phrase stands, and the labels."""
    h, docs, raw, out = words.hashes(), words.docs(), words.data.tobytes(), []
    for phrase in BASE.values():
        parts = [p.encode() for p in phrase.split()]
        data = np.frombuffer(b" ".join(parts), np.uint8)
        target = base.Words(data, np.array([0, len(data)]), _INSIDE).hashes()
        size = max(0, len(words) - len(parts) + 1)
        ok = np.ones(size, bool)
        for k, t in enumerate(target):
            ok &= h[k : k + size] == t
        at = np.flatnonzero(ok)
        at = at[docs[at] == docs[at + len(parts) - 1]] if len(at) else at
        out.append(np.array([i for i in at.tolist() if all(raw[words.starts[i + k] : words.ends[i + k]] == p for k, p in enumerate(parts))], np.int64))
    return out, list(BASE)


def scan_texts(texts: pa.Array) -> dict[str, list]:
    data, offs = base.text_bytes(texts)
    data = _LOWER[data]
    words = base.Words(data, offs, _INSIDE)
    places, names = _base_places(words)
    n, raw = len(texts), data.tobytes()
    n_base, first, last, labels = [0] * n, [None] * n, [None] * n, [set() for _ in range(n)]
    docs = words.docs()
    for at, name in zip(places, names):
        for i in at.tolist():
            d = int(docs[i])
            k = i - int(words.first[d])
            n_base[d] += 1
            first[d] = k if first[d] is None else min(first[d], k)
            last[d] = k if last[d] is None else max(last[d], k)
            labels[d].add(name)
    out = {"n_words": words.counts.tolist(), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": [",".join(sorted(x)) for x in labels], "labels": [], "score": [], "detections": []}
    for d in range(n):
        text = raw[offs[d] : offs[d + 1]].decode()
        found = detect(text)
        doubt = 1.0
        for *_, confidence in found:
            doubt *= 1 - confidence
        if labels[d]:
            doubt = min(doubt, 0.5)
        out["labels"].append(",".join(sorted(labels[d] | {f[2] for f in found})))
        out["score"].append(1 - doubt)
        out["detections"].append(";".join(f"{a}-{b}:{label}" for a, b, label, *_ in found))
    return out


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base phrases, labels and score (SCHEMA)."""
    return base.map_texts(df, [doc_id, text], text, lambda b: base.record(SCHEMA, doc_id=b.column(doc_id), **scan_texts(b.column(text))), SCHEMA)
