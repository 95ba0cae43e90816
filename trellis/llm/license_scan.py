"""License scan by ordered signature rules.

Rules of two kinds, some four hundred: sentences of licence texts and customary notices, each written out
as a pattern of its own, and a table of licences times the forms in which texts name one (SPDX tag, address,
notice, full name with version, bare mention).  A rule is tried only where its keyword occurs, found for all
rules in one Aho-Corasick pass.  Of overlapping detections the one of
higher priority stays, then the longer, then the earlier; a detection inside a kept one is suppressed.

Beside the rules, four base phrases are counted over words, wherever their words stand consecutively.

Defined results: null and empty texts have no words and no labels and score 0; rules see the whole
text, however long; ties between detections of one priority go to the longer, then the earlier, then the
rule's name; rows are judged one by one, so repeated rows give equal rows, and a null doc_id is carried along;
an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import common as C
from trellis.llm import textnp as T

# Phrase -> label of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label | SPDX identifiers | names (regex) | keyword of the names | address (regex)
LICENCES = """
mit | mit | (?:the )?mit(?:/x11)? license|expat license | license | opensource\\.org/licen[sc]es/mit
mit-0 | mit-0 | mit no attribution | attribution | opensource\\.org/licen[sc]es/mit-0
apache-2.0 | apache-2\\.0 | apache(?: software)? licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)? | apache | apache\\.org/licenses/license-2\\.0
apache-1.1 | apache-1\\.1 | apache software licen[sc]e,? (?:version|v\\.?) ?1\\.1 | apache | apache\\.org/licenses/license-1\\.1
apache-any | apache | apache(?: software)? licen[sc]e | apache | apache\\.org/licenses
gpl-3.0 | gpl-3\\.0(?:-only|-or-later|\\+)? | gnu general public licen[sc]e,? (?:version|v\\.?) ?3(?:\\.0)?|gpl ?v?3 | gnu,gpl | gnu\\.org/licenses/gpl-3
gpl-2.0 | gpl-2\\.0(?:-only|-or-later|\\+)? | gnu general public licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)?|gpl ?v?2 | gnu,gpl | gnu\\.org/licenses/(?:old-licenses/)?gpl-2
gpl-1.0 | gpl-1\\.0(?:-only|-or-later|\\+)? | gnu general public licen[sc]e,? (?:version|v\\.?) ?1(?:\\.0)? | gnu | gnu\\.org/licenses/old-licenses/gpl-1
gpl-any | gpl | gnu general public licen[sc]e|gnu gpl | gnu | gnu\\.org/licenses/gpl
lgpl-3.0 | lgpl-3\\.0(?:-only|-or-later|\\+)? | gnu lesser general public licen[sc]e,? (?:version|v\\.?) ?3(?:\\.0)? | lesser | gnu\\.org/licenses/lgpl-3
lgpl-2.1 | lgpl-2\\.1(?:-only|-or-later|\\+)? | gnu lesser general public licen[sc]e,? (?:version|v\\.?) ?2\\.1 | lesser | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1
lgpl-2.0 | lgpl-2\\.0(?:-only|-or-later|\\+)? | gnu library general public licen[sc]e | library | gnu\\.org/licenses/old-licenses/lgpl-2\\.0
lgpl-any | lgpl | gnu lesser general public licen[sc]e | lesser | gnu\\.org/licenses/lgpl
agpl-3.0 | agpl-3\\.0(?:-only|-or-later|\\+)? | gnu affero general public licen[sc]e(?:,? (?:version|v\\.?) ?3(?:\\.0)?)? | affero | gnu\\.org/licenses/agpl
gfdl-1.3 | gfdl-1\\.3(?:-only|-or-later)? | gnu free documentation licen[sc]e,? (?:version|v\\.?) ?1\\.3 | documentation | gnu\\.org/licenses/fdl-1\\.3
gfdl-any | gfdl | gnu free documentation licen[sc]e | documentation | gnu\\.org/licenses/fdl
bsd-4-clause | bsd-4-clause | (?:4|four)[- ]clause bsd licen[sc]e|original bsd licen[sc]e | bsd | spdx\\.org/licenses/bsd-4-clause
bsd-3-clause | bsd-3-clause | (?:3|three)[- ]clause bsd licen[sc]e|(?:new|revised|modified) bsd licen[sc]e | bsd | opensource\\.org/licen[sc]es/bsd-3-clause
bsd-2-clause | bsd-2-clause | (?:2|two)[- ]clause bsd licen[sc]e|(?:simplified|freebsd) (?:bsd )?licen[sc]e | bsd | opensource\\.org/licen[sc]es/bsd-2-clause
bsd-0-clause | 0bsd | zero[- ]clause bsd licen[sc]e | bsd | opensource\\.org/licen[sc]es/0bsd
bsd-any | bsd | bsd(?:-style)? licen[sc]e | bsd | opensource\\.org/licen[sc]es/bsd
cc-by-4.0 | cc-by-4\\.0 | (?:creative commons )?attribution 4\\.0(?: international)?|cc[- ]by[- ]4\\.0 | 4.0 | creativecommons\\.org/licenses/by/4\\.0
cc-by-3.0 | cc-by-3\\.0 | (?:creative commons )?attribution 3\\.0(?: unported)?|cc[- ]by[- ]3\\.0 | 3.0 | creativecommons\\.org/licenses/by/3\\.0
cc-by-2.0 | cc-by-2\\.[05] | cc[- ]by[- ]2\\.[05] | cc | creativecommons\\.org/licenses/by/2
cc-by-sa-4.0 | cc-by-sa-4\\.0 | attribution[- ]share ?alike 4\\.0|cc[- ]by[- ]sa[- ]4\\.0 | 4.0 | creativecommons\\.org/licenses/by-sa/4\\.0
cc-by-sa-3.0 | cc-by-sa-3\\.0 | attribution[- ]share ?alike 3\\.0|cc[- ]by[- ]sa[- ]3\\.0 | 3.0 | creativecommons\\.org/licenses/by-sa/3\\.0
cc-by-nc-4.0 | cc-by-nc-4\\.0 | attribution[- ]non ?commercial 4\\.0|cc[- ]by[- ]nc[- ]4\\.0 | 4.0 | creativecommons\\.org/licenses/by-nc/4\\.0
cc-by-nd-4.0 | cc-by-nd-4\\.0 | attribution[- ]no ?derivatives 4\\.0|cc[- ]by[- ]nd[- ]4\\.0 | 4.0 | creativecommons\\.org/licenses/by-nd/4\\.0
cc-by-nc-sa-4.0 | cc-by-nc-sa-4\\.0 | cc[- ]by[- ]nc[- ]sa[- ]4\\.0 | 4.0 | creativecommons\\.org/licenses/by-nc-sa/4\\.0
cc-by-nc-nd-4.0 | cc-by-nc-nd-4\\.0 | cc[- ]by[- ]nc[- ]nd[- ]4\\.0 | 4.0 | creativecommons\\.org/licenses/by-nc-nd/4\\.0
cc-by-any | cc-by(?:-nc|-sa|-nd)* | cc[- ]by(?:[- ](?:nc|sa|nd))*|creative commons attribution | cc,creative | creativecommons\\.org/licenses/by
cc0-1.0 | cc0(?:-1\\.0)? | cc0(?: 1\\.0)?(?: universal)?|creative commons zero | cc0,creative | creativecommons\\.org/publicdomain/zero
public-domain | pddc | (?:dedicated to|released into|in) the public domain | domain | creativecommons\\.org/publicdomain/mark
mpl-2.0 | mpl-2\\.0 | mozilla public licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)? | mozilla | mozilla\\.org/(?:en-us/)?mpl/2\\.0
mpl-1.1 | mpl-1\\.1 | mozilla public licen[sc]e,? (?:version|v\\.?) ?1\\.1 | mozilla | mozilla\\.org/mpl/mpl-1\\.1
mpl-any | mpl | mozilla public licen[sc]e | mozilla | mozilla\\.org/mpl
epl-2.0 | epl-2\\.0 | eclipse public licen[sc]e,? (?:version|v\\.?|-) ?2(?:\\.0)? | eclipse | eclipse\\.org/legal/epl-2
epl-1.0 | epl-1\\.0 | eclipse public licen[sc]e,? (?:version|v\\.?|-) ?1(?:\\.0)? | eclipse | eclipse\\.org/legal/epl-v10
cddl-1.0 | cddl-1\\.[01] | common development and distribution licen[sc]e | development | opensource\\.org/licen[sc]es/cddl
cpl-1.0 | cpl-1\\.0 | common public licen[sc]e | common | opensource\\.org/licen[sc]es/cpl
eupl-1.2 | eupl-1\\.[12] | european union public licen[sc]e | european | joinup\\.ec\\.europa\\.eu/.{0,40}eupl
isc | isc | isc licen[sc]e | isc | opensource\\.org/licen[sc]es/isc
zlib | zlib | zlib(?:/libpng)? licen[sc]e | zlib | opensource\\.org/licen[sc]es/zlib
unlicense | unlicense | the unlicense | unlicense | unlicense\\.org
wtfpl | wtfpl | do what the fuck you want to public licen[sc]e | public | wtfpl\\.net
boost-1.0 | bsl-1\\.0 | boost software licen[sc]e | boost | boost\\.org/license
artistic-2.0 | artistic-2\\.0 | artistic licen[sc]e,? (?:version |v\\.?)?2(?:\\.0)? | artistic | opensource\\.org/licen[sc]es/artistic-2
artistic-1.0 | artistic-1\\.0 | artistic licen[sc]e | artistic | opensource\\.org/licen[sc]es/artistic-1
ofl-1.1 | ofl-1\\.1 | sil open font licen[sc]e | font | scripts\\.sil\\.org/ofl
ms-pl | ms-pl | microsoft public licen[sc]e | microsoft | opensource\\.org/licen[sc]es/ms-pl
ms-rl | ms-rl | microsoft reciprocal licen[sc]e | microsoft | opensource\\.org/licen[sc]es/ms-rl
odbl-1.0 | odbl-1\\.0 | open (?:data commons open )?database licen[sc]e | database | opendatacommons\\.org/licenses/odbl
odc-by | odc-by-1\\.0 | open data commons attribution licen[sc]e | data | opendatacommons\\.org/licenses/by
pddl | pddl-1\\.0 | public domain dedication and licen[sc]e | domain | opendatacommons\\.org/licenses/pddl
psf-2.0 | psf-2\\.0|python-2\\.0 | python software foundation licen[sc]e | python | docs\\.python\\.org/.{0,12}license
ruby | ruby | ruby licen[sc]e | ruby | ruby-lang\\.org/.{0,10}license
php-3.01 | php-3\\.01? | php licen[sc]e | php | php\\.net/license
postgresql | postgresql | postgresql licen[sc]e | postgresql | postgresql\\.org/about/licen[sc]e
openssl | openssl | openssl licen[sc]e | openssl | openssl\\.org/source/license
sspl-1.0 | sspl-1\\.0 | server side public licen[sc]e | server | mongodb\\.com/licensing/server-side
busl-1.1 | busl-1\\.1 | business source licen[sc]e | business | mariadb\\.com/bsl
openrail-m | openrail-?m? | open rail(?:-m|\\+\\+-m)? licen[sc]e|openrail | rail | bigscience.{0,20}openrail
llama-community | llama | llama \\d(?:\\.\\d)? community licen[sc]e | community | ai\\.meta\\.com/llama/license
all-rights | licenseref-proprietary | all rights reserved | reserved | choosealicense\\.com/no-permission
"""

# Label | keyword | sentence (regex) that marks a licence's own text or its customary notices
SENTENCES = """
mit | hereby | permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit | noninfringement | merchantability, fitness for a particular purpose and noninfringement
mit | sublicense | use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies
mit-0 | hereby | permission is hereby granted, free of charge, to any person obtaining a copy of this software (?:and associated documentation files )?\\(the ["']software["']\\), to deal in the software without restriction.{0,200}furnished to do so\\.
isc | hereby | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
bsd-0-clause | fee | for any purpose with or without fee is hereby granted\\.
bsd-any | redistribution | redistribution and use in source and binary forms,? with or without modification,? (?:are|is) permitted
bsd-2-clause | reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | neither the names? of .{1,80} nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-4-clause | acknowledg | all advertising materials mentioning features or use of this software must display the following acknowledg
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | apache | licensed under the apache license, version 2\\.0 \\(the ["']license["']\\)
apache-2.0 | contributor | licensed to the apache software foundation \\(asf\\) under one or more contributor license agreements
apache-2.0 | conditions | distributed on an ["']as is["'] basis,? without warranties or conditions of any kind
apache-1.1 | includes | this product includes software developed by the apache software foundation
gpl-any | foundation | redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-3.0 | published | gnu general public license as published by the free software foundation,? either version 3
gpl-2.0 | published | gnu general public license as published by the free software foundation[;,]? either version 2
gpl-2.0 | version | gnu general public license,? version 2 only|version 2 of the gnu general public license
gpl-3.0 | version | version 3 of the gnu general public license
gpl-any | copy | you should have received a copy of the gnu general public license
gpl-any | freedom | the licenses for most software are designed to take away your freedom
gpl-3.0 | copyleft | the gnu general public license is a free,? copyleft license for software
lgpl-any | redistribute | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1 | published | gnu lesser general public license as published by the free software foundation[;,]? either version 2\\.1
lgpl-3.0 | published | gnu lesser general public license as published by the free software foundation[;,]? either version 3
lgpl-any | copy | you should have received a copy of the gnu (?:lesser|library) general public license
agpl-3.0 | affero | redistribute it and/or modify it under the terms of the gnu affero general public license
agpl-3.0 | affero | you should have received a copy of the gnu affero general public license
gfdl-any | documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
gfdl-any | invariant | with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license,? v\\. ?2\\.0
mpl-2.0 | incompatible | this source code form is ["']incompatible with secondary licenses["']
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1\\.1
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license,? (?:v\\.? ?)?2\\.0
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license,? (?:v\\.? ?)?1\\.0
cddl-1.0 | development | the contents of this file are subject to the terms of the common development and distribution license
eupl-1.2 | eupl | licensed under the eupl,? (?:version |v\\. ?)?1\\.[12]
cc-by-4.0 | creative | (?:this work is )?licensed under (?:a|the) creative commons attribution 4\\.0 international licen[sc]e
cc-by-3.0 | creative | (?:this work is )?licensed under (?:a|the) creative commons attribution 3\\.0 (?:unported )?licen[sc]e
cc-by-sa-4.0 | creative | licensed under (?:a|the) creative commons attribution[- ]share ?alike 4\\.0 international licen[sc]e
cc-by-sa-3.0 | creative | licensed under (?:a|the) creative commons attribution[- ]share ?alike 3\\.0 (?:unported )?licen[sc]e
cc-by-nc-4.0 | creative | licensed under (?:a|the) creative commons attribution[- ]non ?commercial 4\\.0 international licen[sc]e
cc-by-nd-4.0 | creative | licensed under (?:a|the) creative commons attribution[- ]no ?derivatives 4\\.0 international licen[sc]e
cc-by-nc-sa-4.0 | creative | creative commons attribution[- ]non ?commercial[- ]share ?alike 4\\.0 international
cc-by-nc-nd-4.0 | creative | creative commons attribution[- ]non ?commercial[- ]no ?derivatives 4\\.0 international
cc-by-any | adapt | you are free to share .{1,80} and adapt .{1,80} the material
cc-by-sa-any | contributions | if you remix, transform, or build upon the material, you must distribute your contributions under the same license
cc-by-nc-any | commercial | you may not use the material for commercial purposes
cc-by-nd-any | remix | if you remix, transform, or build upon the material, you may not distribute the modified material
cc0-1.0 | waive | waived? all (?:of )?(?:his or her|their|its) (?:copyright and related or neighbou?ring rights|rights to the work)
cc0-1.0 | neighbo | to the extent possible under law,? .{1,120} has waived all copyright and related or neighbou?ring rights
public-domain | domain | (?:this (?:work|file|software|program|code) is|is hereby placed|has been placed|are) in the public domain
public-domain | domain | no copyright is claimed.{0,60} public domain
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
zlib | altered | altered source versions must be plainly marked as such
zlib | implied | this software is provided ["']as-is["'],? without any express or implied warranty
boost-1.0 | hereby | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
boost-1.0 | boost | distributed under the boost software license,? version 1\\.0
artistic-2.0 | package | this license establishes the terms under which a given free software package may be copied, modified, distributed
ofl-1.1 | font | this font software is licensed under the sil open font license,? version 1\\.1
ofl-1.1 | reserved | no modified version of the font software may use the reserved font name
ms-pl | accept | this license governs use of the accompanying software\\. if you use the software, you accept this license
odbl-1.0 | database | this .{1,60} is made available under the open database licen[sc]e
odc-by | attribution | this .{1,60} is made available under the open data commons attribution licen[sc]e
pddl | dedication | this .{1,60} is made available under the public domain dedication and licen[sc]e
psf-2.0 | python | this license agreement is between the python software foundation
postgresql | agreement | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
openssl | openssl | this product includes software developed by the openssl project
sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | licensor | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
busl-1.1 | change | effective on the change date, or the fourth anniversary of the first publicly available distribution
elastic-2.0 | hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | sell | the grant of rights under the license will not include,? .{0,60} the right to sell the software
openrail-m | restrictions | use-based restrictions .{0,80} attachment a
llama-community | meta | licensed under the llama \\d(?:\\.\\d)? community license, copyright .{0,4} ?meta platforms
proprietary | confidential | (?:this (?:document|file|software|material) (?:is|contains) )?(?:proprietary and confidential|confidential and proprietary)
proprietary | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution).{0,80} (?:is )?(?:strictly )?prohibited
proprietary | written | no part of this (?:publication|document|book|work) may be reproduced.{0,160} without (?:the )?(?:prior |express )?written permission
all-rights | reserved | (?:copyright|\\(c\\)|©).{0,80}all rights reserved
fair-use | fair | (?:constitutes|under the doctrine of|is believed to be) (?:a )?['"]?fair use
government-work | government | works? of the (?:united states|u\\.s\\.) government
crown-copyright | crown | (?:©|\\(c\\)|subject to) crown copyright
ogl-uk-3.0 | open | contains public sector information licensed under the open government licen[sc]e v?3\\.0
etalab-2.0 | licence | licence ouverte (?:/ open licence )?(?:version )?2\\.0
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland.{1,4}namensnennung.{1,4}version 2\\.0
noai | training,development | (?:may not|shall not|must not) be used (?:for|in) (?:the )?(?:training|development) of (?:any )?(?:ai|artificial intelligence|machine[- ]learning|language) (?:models?|systems?)
"""

#: form -> (priority, score, pattern around a licence's name or identifier)
FORMS = {
    "tag": (5, 1.0, r"spdx-license-identifier:\s*(?:{id})(?![a-z0-9.+-]*[a-z0-9])"),
    "address": (4, 0.95, r"https?://(?:www\.)?(?:{url})"),
    "notice": (3, 0.9, r"(?:licen[sc]ed|released|distributed|available|provided|published)\s+under\s+(?:(?:the\s+)?terms\s+of\s+)?(?:(?:the|an?)\s+)?(?:{name})(?![a-z0-9\x80-\xff])"),
    "name": (2, 0.8, r"(?<![a-z0-9\x80-\xff])(?:{name})(?![a-z0-9\x80-\xff])"),
    "mention": (1, 0.6, r"(?<![a-z0-9\x80-\xff])(?:{id})[ -]licen[sc]ed?(?![a-z0-9\x80-\xff])"),
}
_KEYWORD = {"tag": "spdx-license-identifier", "address": "://"}


class Rule(NamedTuple):
    name: str
    label: str
    form: str
    priority: int
    score: float
    keyword: str  # or several, of which one occurs
    pattern: re.Pattern


def spaced_names(names: str) -> str:
    """Blanks match any run of blanks, optional ones also none; other character classes than ``[- ]`` stay."""
    blank = {" ?": r"\s*", " ": r"\s+", "[- ]": r"(?:-|\s+)"}
    return re.sub(r"\[[^]]*\]| \??", lambda m: blank.get(m[0], m[0]), names)


def rules() -> list[Rule]:
    """All rules, by priority; blanks in names match any run of blanks, and no keyword has one."""
    out = []
    for line in LICENCES.strip().splitlines():
        label, ids, names, word, url = (x.strip() for x in re.split(r" \| ", line))
        spaced = spaced_names(names)
        # a mention holds the plain start of an identifier; names and notices hold the names' keyword
        keywords = _KEYWORD | {"mention": ",".join(re.match(r"(?:[a-z0-9-](?![?*]))+", x)[0] for x in re.split(r"\|(?![^(]*\))", ids))}
        for form, (priority, score, pattern) in FORMS.items():
            text = pattern.replace("{id}", ids).replace("{url}", url).replace("{name}", spaced)
            general = label.endswith("-any")
            out.append(Rule(f"{label}/{form}", label.removesuffix("-any"), form, 2 * priority - general, score, keywords.get(form, word), re.compile(text.encode())))
    for number, line in enumerate(SENTENCES.strip().splitlines()):
        label, word, text = (x.strip() for x in line.split(" | "))
        out.append(Rule(f"{label}/sentence {number}", label.removesuffix("-any"), "sentence", 7 - label.endswith("-any"), 0.95, word, re.compile(spaced_names(text).encode(), re.DOTALL)))
    return sorted(out, key=lambda r: -r.priority)


def prefilter(all_rules: list[Rule]) -> ahocorasick.Automaton:
    words: dict[str, list[int]] = {}
    for i, r in enumerate(all_rules):
        for word in r.keyword.split(","):
            words.setdefault(word, []).append(i)
    found = ahocorasick.Automaton()
    for w, i in words.items():
        found.add_word(w, tuple(i))
    found.make_automaton()
    return found


def detections(text: bytes, all_rules: list[Rule], automaton: ahocorasick.Automaton) -> list[tuple[int, int, Rule]]:
    """Surviving detections in lower-cased text, by place."""
    tried = {i for _, found in automaton.iter(text.decode("latin-1")) for i in found}
    hits = [(m.start(), m.end(), all_rules[i]) for i in sorted(tried) for m in all_rules[i].pattern.finditer(text)]
    hits.sort(key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].name))
    kept: list[tuple[int, int, Rule]] = []  # disjoint, by place
    for h in hits:
        at = bisect.bisect_left(kept, h[0], key=lambda k: k[0])
        before, after = kept[max(0, at - 1) : at], kept[at : at + 1]
        if all(k[1] <= h[0] for k in before) and all(h[1] <= k[0] for k in after):
            kept.insert(at, h)
    return kept


_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BASE = [(p.split()[0].encode(), p.split()[-1].encode(), label, re.compile(_GAP.join(map(str.encode, p.split())) + rb"(?![0-9a-z\x80-\xff])")) for p, label in PHRASES.items()]


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(byte, label) of all places of the base phrases in lower-cased text."""
    out = []
    for first, last, label, pattern in _BASE:
        if last in text and first in text:
            out += [(m.start(), label) for m in pattern.finditer(text) if not m.start() or _SEPARATOR[text[m.start() - 1]]]
    return out


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label: string, rule: string, start: long, end: long, priority: int, score: double>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document; ``found`` has the rules' detections with byte places."""
    struct = pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("score", pa.float64())])

    def work(batches):
        every = rules()
        automaton = prefilter(every)
        for t in C.large_batches(batches, limit=4 << 20):
            texts = [x.lower() for x in T.raw_texts(t["text"])]
            cols = [[] for _ in range(8)]
            for lo, hi in T.blocks(texts):
                block = T.Block(texts[lo:hi])
                start, _, first = block.words(_SEPARATOR)
                for k, text in enumerate(texts[lo:hi]):
                    base = base_places(text)
                    at = np.searchsorted(start[first[k] : first[k + 1]], [p + block.start[k] for p, _ in base])
                    hits = detections(text, every, automaton)
                    known = sorted({x for _, x in base})
                    score = max([h[2].score for h in hits] + [0.5] * bool(base), default=0.0)
                    row = (int(first[k + 1] - first[k]), len(base), int(at.min()) if base else None, int(at.max()) if base else None, ",".join(known), ",".join(sorted({*known, *(h[2].label for h in hits)})), score)
                    for c, v in zip(cols, (*row, [{"label": h[2].label, "rule": h[2].name, "start": h[0], "end": h[1], "priority": h[2].priority, "score": h[2].score} for h in hits]), strict=True):
                        c.append(v)
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.list_(struct))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _SCHEMA)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir)).drop("found")


