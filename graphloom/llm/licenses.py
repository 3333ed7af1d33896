"""License scans by ordered signature rules.

Four base phrases are found as runs of words.  Beyond them, a few hundred rules (signatures of
names, identifiers, links, dedications and terms, written per license) are regular expressions over the
lower-cased text; each runs only in texts that hold all the literal words that a match of it must
have, which are read off the expression.  Rules are ordered: on overlap the match of higher priority stays, at equal priority the
longer one; a match contained in another's interval is suppressed.

Defined cases: a null or empty text has no words, no places and score 0; repeated rows are scanned each
on its own.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table
from .spans import Uncontained
from .wordarrays import slices

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_IN, _OUT = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"

# label | names (regular expressions) | identifiers | links.  An empty field has no rule.
_TABLE = r"""
apache-2.0|apache (?:software )?license,? (?:version|v\.?) ?2(?:\.0)?;apache 2(?:\.0)? license|apache-2\.0|apache\.org/licenses/license-2\.0
apache-1.1|apache (?:software )?license,? (?:version|v\.?) ?1\.1|apache-1\.1|apache\.org/licenses/license-1\.1
mit|(?:the )?mit licen[sc]e;licensed under (?:the )?mit\b;mit/x11 license|mit|opensource\.org/licenses/mit
x11|(?:the )?x11 licen[sc]e|x11|
isc|(?:the )?isc licen[sc]e|isc|opensource\.org/licenses/isc
bsd-2-clause|(?:2|two)-clause bsd licen[sc]e;simplified bsd licen[sc]e;freebsd licen[sc]e|bsd-2-clause|opensource\.org/licenses/bsd-2-clause
bsd-3-clause|(?:3|three)-clause bsd licen[sc]e;(?:new|modified|revised) bsd licen[sc]e|bsd-3-clause|opensource\.org/licenses/bsd-3-clause
bsd-4-clause|(?:4|four)-clause bsd licen[sc]e;original bsd licen[sc]e|bsd-4-clause|
bsd|bsd(?:-style)? licen[sc]e|0bsd|
gpl-2.0|gnu general public licen[sc]e,? (?:version|v\.?) ?2;gplv2\b;gpl ?v?2(?:\.0)?\b|gpl-2\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0|gnu general public licen[sc]e,? (?:version|v\.?) ?3;gplv3\b;gpl ?v?3(?:\.0)?\b|gpl-3\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/gpl(?:-3\.0)?
lgpl-2.1|gnu lesser general public licen[sc]e,? (?:version|v\.?) ?2(?:\.1)?;lgplv2(?:\.1)?\b|lgpl-2\.1(?:-only|-or-later|\+)?|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0|gnu lesser general public licen[sc]e,? (?:version|v\.?) ?3;lgplv3\b|lgpl-3\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/lgpl(?:-3\.0)?
lgpl|(?:gnu )?lesser general public licen[sc]e;gnu library general public licen[sc]e|lgpl|
agpl-3.0|gnu affero general public licen[sc]e(?:,? (?:version|v\.?) ?3)?;agplv3\b|agpl-3\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/agpl(?:-3\.0)?
gfdl|gnu free documentation licen[sc]e|gfdl-1\.[123](?:-only|-or-later)?|gnu\.org/licenses/fdl
mpl-2.0|mozilla public licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?;mplv2\b|mpl-2\.0|mozilla\.org/mpl/2\.0
mpl-1.1|mozilla public licen[sc]e,? (?:version|v\.?) ?1\.1|mpl-1\.1|mozilla\.org/mpl/mpl-1\.1
epl-2.0|eclipse public licen[sc]e(?: -|,)? ?(?:version|v\.?) ?2(?:\.0)?|epl-2\.0|eclipse\.org/legal/epl-2\.0
epl-1.0|eclipse public licen[sc]e(?: -|,)? ?(?:version|v\.?) ?1(?:\.0)?|epl-1\.0|eclipse\.org/legal/epl-v10
cddl-1.0|common development and distribution licen[sc]e|cddl-1\.[01]|opensource\.org/licenses/cddl
cpl-1.0|common public licen[sc]e|cpl-1\.0|
eupl|european union public licen[sc]e|eupl-1\.[12]|
artistic-2.0|(?:perl )?artistic licen[sc]e 2(?:\.0)?|artistic-2\.0|
artistic|(?:the )?artistic licen[sc]e|artistic-1\.0|
zlib|zlib(?:/libpng)? licen[sc]e|zlib|opensource\.org/licenses/zlib
boost-1.0|boost software licen[sc]e|bsl-1\.0|boost\.org/license_1_0
unlicense|(?:the )?unlicense\b|unlicense|unlicense\.org
wtfpl|do what the \w+ you want to public licen[sc]e|wtfpl|wtfpl\.net
postgresql|postgresql licen[sc]e|postgresql|
python-2.0|python software foundation licen[sc]e;psf licen[sc]e|python-2\.0|
php-3.01|(?:the )?php licen[sc]e|php-3\.01|
openssl|openssl licen[sc]e|openssl|
ofl-1.1|(?:sil )?open font licen[sc]e|ofl-1\.1|scripts\.sil\.org/ofl
odbl|open database licen[sc]e|odbl-1\.0|opendatacommons\.org/licenses/odbl
odc-by|open data commons attribution licen[sc]e|odc-by-1\.0|opendatacommons\.org/licenses/by
pddl|public domain dedication and licen[sc]e|pddl-1\.0|opendatacommons\.org/licenses/pddl
ms-pl|microsoft public licen[sc]e|ms-pl|
ms-rl|microsoft reciprocal licen[sc]e|ms-rl|
osl-3.0|open software licen[sc]e|osl-3\.0|
afl-3.0|academic free licen[sc]e|afl-3\.0|
sspl-1.0|server side public licen[sc]e|sspl-1\.0|
busl-1.1|business source licen[sc]e|busl-1\.1|
elastic-2.0|elastic licen[sc]e(?: 2(?:\.0)?)?|elastic-2\.0|
ncsa|university of illinois(?:/ncsa)? open source licen[sc]e|ncsa|
vim|vim licen[sc]e|vim|
ruby|ruby licen[sc]e|ruby|
ecl-2.0|educational community licen[sc]e|ecl-2\.0|
intel|intel open source licen[sc]e|intel|
ibm-pibs|ibm public licen[sc]e|ipl-1\.0|
qpl-1.0|q public licen[sc]e|qpl-1\.0|
sleepycat|sleepycat licen[sc]e|sleepycat|
watcom|sybase open watcom public licen[sc]e|watcom-1\.0|
zpl-2.1|zope public licen[sc]e|zpl-2\.1|
upl-1.0|universal permissive licen[sc]e|upl-1\.0|
mulan-2.0|mulan (?:psl|permissive software licen[sc]e)|mulanpsl-2\.0|
""".strip().splitlines()
_CC = {"by": "attribution", "by-sa": "attribution-?share ?alike", "by-nd": "attribution-?no ?deriv(?:ative)?s?", "by-nc": "attribution-?non-?commercial", "by-nc-sa": "attribution-?non-?commercial-?share ?alike", "by-nc-nd": "attribution-?non-?commercial-?no ?deriv(?:ative)?s?"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: label | expressions, each written for a sentence of a license's text, header or notice; grants, dedications and reservations without a name too.
_TERMS = r"""
all-rights-reserved|all rights reserved;alle rechte vorbehalten;tous droits r\S{1,2}serv\S{1,2}s;todos los derechos reservados
public-domain|(?:dedicated|released|placed) (?:in)?to the public domain;in the public domain;no copyright reserved
public-domain|(?:has been|is) released into the public domain;the author disclaims copyright to this (?:source code|software|work)
public-domain|dedicates? any and all copyright interest in the software to the public domain
public-domain|this (?:file|code|software|work|program) is (?:hereby )?(?:in the|placed in the) public domain
cc0-1.0|cc0(?: 1\.0)?(?: universal)?;creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0|to the extent possible under law,? the (?:author|person|affirmer)\S* (?:has|have) (?:dedicated|waived) all copyright
cc0-1.0|waived all copyright and related or neighboring rights to
cc-pdm|creativecommons\.org/publicdomain/mark/1\.0;free of known copyright restrictions
cc-by|permits unrestricted use, distribution, and reproduction in any medium, provided the original (?:work|author)
cc-by|you must give appropriate credit, provide a link to the license, and indicate if changes were made
cc-by-sa|if you remix, transform, or build upon the material, you must distribute your contributions under the same license
cc-by-sa|text is available under the creative commons attribution-?share ?alike licen[sc]e
cc-by-nc|you may not use the (?:material|work) for commercial purposes
cc-by-nd|you may not distribute the modified material
proprietary|proprietary and confidential;proprietary licen[sc]e;strictly confidential;confidential and proprietary
proprietary|unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)\S* (?:, via any medium,? )?is strictly prohibited
proprietary|this (?:software|source code|document|file) contains (?:confidential|proprietary|trade secret)
proprietary|this source code is licensed (?:only )?to authorized;for internal use only;not for redistribution
proprietary|no part of this (?:publication|document|book|work|software) may be reproduced
proprietary|may not be (?:copied|reproduced|disclosed|used) without (?:the )?(?:prior |express )?(?:prior )?written (?:consent|permission)
proprietary|end[\s-]user licen[sc]e agreement;your use of this software is (?:subject to|governed by) the terms
proprietary|restricted rights legend;trade secrets? of
non-commercial|for non-?commercial (?:use|purposes) only;not for commercial use;free for (?:personal|private|academic|educational) use
non-commercial|commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not permitted|not allowed);solely for (?:research|academic|educational|evaluation) purposes
no-redistribution|(?:may not be|do not) redistributed?;redistribution (?:is )?(?:strictly )?(?:prohibited|forbidden)
no-derivatives|no derivative works;may not be (?:modified|altered) in any way
mit|permission is hereby granted, free of charge, to any person obtaining a copy
mit|to deal in the software without restriction, including without limitation the rights to use, copy, modify
mit|the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit|(?:distributed|released|published|available|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e;see (?:the )?(?:file )?licen[sc]e(?:\.md|\.txt)? for (?:the )?mit
mit-0|mit no attribution;mit-0 licen[sc]e
x11|except as contained in this notice, the name of the x consortium shall not be used
isc|permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
isc|the software is provided "as is" and the author disclaims all warranties
0bsd|permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.;zero[\s-]clause bsd
bsd|redistribution and use in source and binary forms, with or without modification
bsd|redistributions? of source code must retain the (?:above )?copyright notice
bsd|redistributions? in binary form must reproduce the (?:above )?copyright notice
bsd|use of this source code is governed by a bsd-style licen[sc]e
bsd-3-clause|neither the name of [^.]{1,80} nor the names of (?:its|their|the) contributors may be used to endorse
bsd-3-clause|may not be used to endorse or promote products derived from this software
bsd-4-clause|all advertising materials mentioning features or use of this software must display
bsd-2-clause-views|should not be interpreted as representing official policies
bsd-3-clause-clear|no express or implied licenses to any party's patent rights are granted
gpl|this (?:program|library) is free software[:;,] you can redistribute it
gpl|gnu general public licen[sc]e;gnu gpl\b;under (?:the )?(?:terms of )?the gpl\b
gpl|either version [123](?:\.[0-9])? of the licen[sc]e, or \(?at your option\)? any later version
gpl|without even the implied warranty of merchantability or fitness for a particular purpose
gpl|you should have received a copy of the gnu (?:lesser |affero )?general public licen[sc]e
gpl|write to the free software foundation;published by the free software foundation
gpl|comes with absolutely no warranty;this is free software, and you are welcome to redistribute it
gpl-2.0|version 2,? june 1991;gpl version 2(?:\.0)? only;under version 2 of the gpl
gpl-2.0|under the terms of version 2 of the gnu general public licen[sc]e
gpl-3.0|version 3,? 29 june 2007;gpl version 3(?:\.0)? (?:only|or later);under version 3 of the gpl
gpl-3.0|the gnu general public licen[sc]e is a free, copyleft licen[sc]e
gpl-1.0|gnu general public licen[sc]e,? (?:version|v\.?) ?1\b;version 1,? february 1989
gpl-classpath|as a special exception, the copyright holders? of this (?:library|module|program) give you permission to link;classpath exception
gpl-font|gpl font exception;as a special exception, if you create a document which uses this font
gcc-exception|gcc runtime library exception
lgpl|gnu library or lesser general public licen[sc]e;under (?:the )?(?:terms of )?the lgpl\b
lgpl-2.0|gnu library general public licen[sc]e,? (?:version|v\.?) ?2;version 2,? june 1991 library
lgpl-2.1|version 2\.1,? february 1999
lgpl-3.0|incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e
agpl-3.0|version 3,? 19 november 2007;under (?:the )?(?:terms of )?the agpl\b
agpl-3.0|if you modify the program, your modified version must prominently offer all users interacting with it remotely
gfdl|permission is granted to copy, distribute and/or modify this document
gfdl|with no invariant sections, no front-cover texts,? and no back-cover texts
apache|apache licen[sc]e
apache-2.0|you may not use this file except in compliance with the licen[sc]e
apache-2.0|unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e
apache-2.0|version 2\.0,? january 2004;this product includes software developed (?:at|by) the apache software foundation
apache-2.0|licensed to the apache software foundation \(asf\) under one or more contributor licen[sc]e agreements
apache-1.1|the end-user documentation included with the redistribution, if any, must include the following acknowledg
llvm-exception|apache-?2\.0 with llvm[\s-]exceptions?;llvm exceptions? to the apache 2\.0 licen[sc]e
zlib|this software is provided 'as-is', without any express or implied warranty
zlib|the origin of this software must not be misrepresented
zlib|altered source versions must be plainly marked as such
libpng|this copy of the libpng notices is provided for your convenience;libpng licen[sc]e
boost-1.0|permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
boost-1.0|distributed under the boost software licen[sc]e
mpl|mozilla public licen[sc]e
mpl-2.0|this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-2.0|if a copy of the mpl was not distributed with this file
mpl-1.1|software distributed under the licen[sc]e is distributed on an "as is" basis, without warranty of any kind, either express or implied\. see the licen[sc]e for the specific language
mpl-1.0|mozilla public licen[sc]e,? (?:version|v\.?) ?1\.0;netscape public licen[sc]e
epl|eclipse public licen[sc]e;eclipse distribution licen[sc]e
epl-1.0|this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1\.0
epl-2.0|made available under the terms of the eclipse public licen[sc]e 2\.0
cddl-1.0|the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cddl-1.0|when distributing covered (?:code|software), include this cddl header notice
artistic-2.0|everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document, but changing it is not allowed
artistic|under the same terms as perl itself;same terms as the perl ?5 programming language
artistic|the intent of this document is to state the conditions under which a package may be copied
unlicense|this is free and unencumbered software released into the public domain
unlicense|anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
wtfpl|you just do what the \w+ you want to;http://www\.wtfpl\.net/
ofl-1.1|this font software is licensed under the sil open font licen[sc]e
ofl-1.1|the font software may be sold as part of a larger software package
bitstream-vera|bitstream vera fonts copyright;bitstream vera is a trademark
ubuntu-font|ubuntu font licen[sc]e
postgresql|in no event shall the university of california be liable to any party for direct, indirect, special
python-2.0|python software foundation licen[sc]e version 2;psf licen[sc]e agreement
python-2.0|cnri open source licen[sc]e agreement;beopen\.com licen[sc]e agreement
php-3.01|products derived from this software may not be called "php"
openssl|this product includes software developed by the openssl project
ssleay|this product includes cryptographic software written by eric young
ruby|you may (?:distribute|redistribute) the software in object code or binary form;same licen[sc]e as ruby
vim|i\) there are no restrictions on distributing unmodified copies of vim
curl|curl and libcurl are licensed under
icu|icu licen[sc]e;unicode licen[sc]e agreement
unicode|unicode,? inc\. licen[sc]e agreement - data files and software
w3c|w3c software (?:notice and|and document notice and) licen[sc]e;w3c\(?r?\)? software licen[sc]e
ijg|independent jpeg group'?s software;this software is based in part on the work of the independent jpeg group
freetype|freetype project licen[sc]e;portions of this software are copyright \S+ [0-9]+ the freetype project
tcl|the authors hereby grant permission to use, copy, modify, distribute, and license this software
ncsa|the names of [^.]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific
hpnd|historical permission notice and disclaimer;permission to use, copy, modify and distribute this software and its documentation for any purpose
json|the software shall be used for good, not evil
beerware|beer-?ware licen[sc]e;you can buy me a beer in return
eupl|licensed under the eupl;european union public licen[sc]e,? (?:version|v\.?) ?1\.[012]
cecill|cecill(?:-[abc])? (?:free software )?licen[sc]e;licence de logiciel libre cecill
odbl|this (?:database|dataset) is made available under the open database licen[sc]e
odbl|openstreetmap contributors;any rights in individual contents of the database are licensed under
odc-by|made available under the open data commons attribution licen[sc]e
pddl|made available under the public domain dedication and licen[sc]e
ogl|open government licen[sc]e;contains public sector information licensed under
etalab|licence ouverte;open licence 2\.0 etalab
dl-de|datenlizenz deutschland
ms-pl|this licen[sc]e governs use of the accompanying software;if you use the software, you accept this licen[sc]e
ms-eula|microsoft software licen[sc]e terms
sspl-1.0|making the functionality of the program or modified version available to third parties as a service
busl-1.1|the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use
elastic-2.0|you may not provide the software to third parties as a hosted or managed service
commons-clause|"?commons clause"? licen[sc]e condition;the grant of rights under the license will not include,? and the license does not grant to you,? the right to sell
polyform|polyform (?:noncommercial|small business|shield|perimeter|internal use|strict) licen[sc]e
prosperity|the prosperity public licen[sc]e
parity|the parity public licen[sc]e
openrail|(?:creativeml|bigscience|bigcode) open ?rail(?:-?[ms]{1,2})?;responsible ai licen[sc]e;use-based restrictions
llama|llama [0-9.]* ?community licen[sc]e(?: agreement)?
gemma|gemma terms of use
oracle-bcl|oracle binary code licen[sc]e agreement;oracle technology network licen[sc]e agreement
sun-bcl|sun microsystems,? inc\. binary code licen[sc]e
apple-psl|apple public source licen[sc]e
nvidia|nvidia (?:software|cuda toolkit|source code) licen[sc]e
intel-simplified|intel simplified software licen[sc]e
osl-3.0|licensed under the open software licen[sc]e version 3\.0
afl-3.0|licensed under the academic free licen[sc]e version 3\.0
ecl-2.0|licensed under the educational community licen[sc]e
cpal|common public attribution licen[sc]e
rpl|reciprocal public licen[sc]e
sissl|sun industry standards source licen[sc]e
spl|sun public licen[sc]e
lppl|latex project public licen[sc]e;this work may be distributed and/or modified under the conditions of the latex project public licen[sc]e
cern-ohl|cern open hardware licen[sc]e
tapr-ohl|tapr open hardware licen[sc]e
solderpad|solderpad hardware licen[sc]e
free-art|free art licen[sc]e;licence art libre
opl|open publication licen[sc]e;open content licen[sc]e
gutenberg|project gutenberg(?:-tm|\S)? licen[sc]e;this ebook is for the use of anyone anywhere
anti-996|anti-996 licen[sc]e;anti 996 licen[sc]e
hippocratic|hippocratic licen[sc]e
dual|dual[\s-]licensed under;licensed under either of;you may (?:choose|select) either licen[sc]e
warranty-disclaimer|the software is provided "as is", without warranty of any kind
warranty-disclaimer|this software is provided by the (?:copyright holders|authors?|regents|contributors)(?: and contributors)? "?as is"? and any express or implied warranties
warranty-disclaimer|in no event shall the (?:authors?|copyright (?:holders?|owner)|contributors)(?: or (?:copyright holders|contributors))? be liable for any
warranty-disclaimer|provided without (?:any )?warranty;use (?:it )?at your own risk
patent-grant|grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free;additional grant of patent rights
copyright-notice|copyright (?:\(c\)|\S{1,2}) (?:19|20)[0-9]{2};\(c\) (?:19|20)[0-9]{2}(?:-(?:19|20)[0-9]{2})?
"""
_TERMS = _TERMS.strip().splitlines()
# Parts of an expression that aren't literal: groups (one level inside another), classes and escapes; what a quantifier makes optional goes too.
_OPEN = re.compile(r"(?:\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|\[(?:[^\]\\]|\\.)*\]|\\[a-zA-Z])(?:[?*+]|\{[^}]*\})?|(?:\\.|[^\\])(?:[?*]|\{[^}]*\})")


def literals(expression: str) -> tuple[str, ...]:
    """The literal words, without blanks, that every match holds: the rarest, by its length, first."""
    words = {w for run in _OPEN.sub("\n", expression).split("\n") for w in re.sub(r"\\(.)", r"\1", run).split()}
    return tuple(sorted((w for w in words if len(w) > 1), key=lambda w: (w == "licen", -len(w), w)))


class Rule:
    def __init__(self, label: str, kind: str, priority: int, expression: str):
        self.label, self.kind, self.priority = label, kind, priority
        self.keyword, *self.others = (w.encode() for w in literals(expression))
        self.expression = re.compile((r"(?<![0-9a-z])(?:" + expression + r")(?![0-9a-z])").encode())


def _spaced(expression: str) -> str:
    """Blanks of an expression match any white space, comment signs included."""
    return expression.replace(" ?", r"[\s#*/]{0,8}").replace(" ", r"[\s#*/]+")


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, the strongest kind first: identifiers, links, names, terms."""
    out = []

    def add(label, kind, priority, expression):
        if expression:
            out.append(Rule(label, kind, priority, expression))

    for line in _TABLE:
        label, names, ids, links = re.split(r"\|(?![^(]*\))", line)
        for i, name in enumerate(names.split(";")):
            add(label, "name", 60 - i, _spaced(name))
        add(label, "id", 90, r"spdx-license-identifier:\s*" + ids)
        add(label, "tag", 70, r"licen[sc]ed?(?: |\s*[:=]\s*[\"']?)" + ids)
        add(label, "link", 80, links)
    for code, name in _CC.items():
        for version in _CC_VERSIONS:
            v = re.escape(version)
            label = f"cc-{code}-{version}"
            add(label, "name", 65, rf"cc[\s-]{code.replace('-', '[ -]')}[\s-](?:v\.?)?{v}")
            add(label, "link", 85, rf"creativecommons\.org/licenses/{code}/{v}")
            add(label, "long", 66, _spaced(rf"creative commons {name} {v}"))
            add(label, "id", 90, rf"spdx-license-identifier:\s*cc-{code}-{v}")
        add(f"cc-{code}", "name", 50, rf"cc[\s-]{code.replace('-', '[ -]')}")
        add(f"cc-{code}", "long", 51, _spaced(f"creative commons {name}"))
    for line in _TERMS:
        label, forms = line.split("|", 1)
        for form in re.split(r";(?![^\[]*\])", forms):  # not at a ; of a class
            add(label, "term", 40, _spaced(form))
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.cache
def _by_keyword() -> dict[bytes, tuple[Rule, ...]]:
    groups: dict[bytes, list[Rule]] = {}
    for r in rules():
        groups.setdefault(r.keyword, []).append(r)
    return {k: tuple(v) for k, v in groups.items()}


@functools.cache
def _phrases() -> tuple[tuple[str, bytes, re.Pattern], ...]:
    gap = b"(?:" + _OUT + b")+"
    return tuple((label, max(p.split(), key=len).encode(), re.compile(b"(?<!" + _IN + b")" + gap.join(w.encode() for w in p.split()) + b"(?!" + _IN + b")")) for p, label in BASE.items())


def detections(low: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the rules' matches in a lower-cased text that no stronger or longer one, inside or around them, suppresses."""
    found = []
    for keyword, group in _by_keyword().items():
        if keyword in low:
            for r in group:
                if all(w in low for w in r.others):
                    found += [(m.start(), m.end(), r.label, r.priority) for m in r.expression.finditer(low)]
    taken = Uncontained()
    strongest = sorted(set(found), key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
    kept = [d for d in strongest if taken.add(d[0], d[1])]
    return sorted(kept)


def base_places(low: bytes) -> list[tuple[int, str]]:
    """(start byte, label) of every place of a base phrase."""
    return sorted((m.start(), label) for label, word, p in _phrases() if word in low for m in p.finditer(low))


def scan(batch_texts: list[bytes]) -> dict[str, list]:
    lows = [t.lower() for t in batch_texts]  # bytes.lower() lowers A-Z only
    out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
    joined = np.frombuffer(b"\n".join([*lows, b""]) or b"\n", np.uint8)
    start = np.zeros(len(joined), bool)
    inside = _WORD[joined]
    start[:] = inside
    start[1:] &= ~inside[:-1]
    before = np.concatenate([[0], np.cumsum(start)])
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lows])])
    for i, low in enumerate(lows):
        first = before[at[i]]
        out["n_words"].append(int(before[at[i + 1]] - first))
        places = base_places(low)
        found = detections(low)
        words = [int(before[at[i] + p] - first) for p, _ in places]
        out["n_base"].append(len(places))
        out["first_word"].append(words[0] if words else None)
        out["last_word"].append(words[-1] if words else None)
        base = {label for _, label in places}
        out["base_labels"].append(",".join(sorted(base)))
        out["labels"].append(",".join(sorted(base | {d[2] for d in found})))
        strength = max([d[3] for d in found] + [60 * bool(places)], default=0)
        out["score"].append(min(1.0, strength / 100 + 0.02 * min(5, len(found))))
        out["detections"].append([{"start": s, "end": e, "label": label, "priority": p} for s, e, label, p in found])
    return out


_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "detections": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))}


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs; detections holds byte spans of the lower-cased UTF-8 text."""

    def run(batches):
        for batch, raw in slices(batches):
            found = scan(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], t) for k, t in _KINDS.items())], [id_col, *_KINDS])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,priority:int>>"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents")).drop("detections")
