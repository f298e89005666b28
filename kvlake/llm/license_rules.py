"""Signature rules of the license scan.

A rule has a label, a priority, a keyword and a regular expression over the
lower-cased text with white space made single; the keyword is in each text that the
expression matches. A rule of a family takes the version from its first group.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Priorities: a tag is certain, a grant or the text of a license names it, a link or title is weaker, a mention weakest.
TAG, GRANT, LINK, TITLE, MENTION = 1, 2, 3, 4, 5


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str
    versioned: bool = False


# Signatures by hand, from the texts of licenses, their notices, and the ways they are named: label | priority | keyword | pattern.
SIGNATURES = r"""
mit | 2 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | 2 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy(?! of the font)
mit | 2 | without restriction | deal in the software without restriction, including without limitation the rights to use, copy, modify
mit | 2 | above copyright notice and this permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | 3 | opensource.org/licenses/mit | opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
mit | 4 | mit licen | \bmit licen[sc]ed?\b
mit | 4 | mit-licen | \bmit-licen[sc]ed?\b
mit | 4 | mit-style | \bmit-style licen[sc]e\b
mit | 4 | expat licen | \bexpat licen[sc]e\b
x11 | 4 | x11 licen | \bx11 licen[sc]e\b
mit | 4 | license: | \blicense: ?(?:the )?mit\b
mit-0 | 2 | mit no attribution | \bmit no attribution\b
mit-0 | 4 | mit-0 | \bmit-0\b
x11 | 2 | shall not be used in advertising | the name of (?:the )?(?:x consortium|copyright holder)s? shall not be used in advertising
hpnd | 2 | without fee is hereby granted | permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted
isc | 2 | with or without fee | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
isc | 2 | author disclaims all warranties | the software is provided "as is" and the author disclaims all warranties with regard to this software
isc | 4 | isc licen | \bisc licen[sc]ed?\b
0bsd | 2 | with or without fee | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software
0bsd | 4 | 0bsd | \b0bsd\b
bsd | 2 | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd | 2 | redistributions of source code | redistributions of source code must retain the above copyright notice, this list of conditions
bsd | 2 | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 2 | endorse or promote | neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote
bsd-3-clause | 2 | endorse or promote | the name of the author may not be used to endorse or promote products derived from this software
bsd-4-clause | 2 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 4 | simplified bsd | \bsimplified bsd licen[sc]e\b
bsd-2-clause | 4 | freebsd licen | \bfreebsd licen[sc]e\b
bsd-3-clause | 4 | new bsd | \b(?:new|modified|revised) bsd licen[sc]e\b
bsd-2-clause | 4 | 2-clause | \b(?:bsd[ -]2-clause|2-clause bsd)\b
bsd-3-clause | 4 | 3-clause | \b(?:bsd[ -]3-clause|3-clause bsd)\b
bsd-4-clause | 4 | 4-clause | \b(?:bsd[ -]4-clause|4-clause bsd)\b
bsd-4-clause | 4 | original bsd licen | \boriginal bsd licen[sc]e\b
bsd | 4 | bsd | \bbsd(?:-style| style)? licen[sc]ed?\b
bsd-patent | 2 | patent license | \bbsd ?\+ ?patent licen[sc]e\b
apache-2.0 | 2 | apache license | licen[sc]ed under the apache licen[sc]e,? version 2\.0
apache-2.0 | 2 | except in compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | 2 | applicable law or agreed to in writing | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
apache-2.0 | 2 | terms and conditions for use, reproduction | terms and conditions for use, reproduction, and distribution
apache-1.1 | 2 | developed by the apache software foundation | this product includes software developed by the apache software foundation
apache-2.0 | 3 | apache.org/licenses/license-2.0 | apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache-2.0 | 4 | apache | \bapache(?: licen[sc]e,?)?[ -](?:version |v\.?)?2(?:\.0)?(?![0-9]|\.[0-9])
apache-1.1 | 4 | apache | \bapache(?: software)? licen[sc]e,?(?: version)? 1\.1\b
apache | 4 | apache | \bapache(?: software)? licen[sc]ed?\b
gpl | 2 | free software; you can redistribute | is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e
gpl-2.0-or-later | 2 | either version 2 | gnu general public licen[sc]e as published by the free software foundation[;,] either version 2 of the licen[sc]e, or \(?at your option\)? any later version
gpl-3.0-or-later | 2 | either version 3 | gnu general public licen[sc]e as published by the free software foundation[;,] either version 3 of the licen[sc]e, or \(?at your option\)? any later version
gpl-2.0-only | 2 | version 2 | gnu general public licen[sc]e,? version 2 as published by the free software foundation(?! ?[;,] either)
gpl-2.0-only | 2 | version 2 | gnu general public licen[sc]e as published by the free software foundation[;,] version 2(?: of the licen[sc]e)?(?! or)
gpl-2.0 | 2 | version 2, june 1991 | gnu general public licen[sc]e version 2, june 1991
gpl-3.0 | 2 | version 3, 29 june 2007 | gnu general public licen[sc]e version 3, 29 june 2007
gpl-1.0 | 2 | version 1, february 1989 | gnu general public licen[sc]e version 1, february 1989
gpl | 2 | received a copy of the gnu | you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|file)
gpl | 3 | gnu.org/licenses/gpl | gnu\.org/(?:licenses|copyleft)/gpl[a-z0-9.-]*
gpl-2.0 | 2 | general public licen | \b(?:gnu )?general public licen[sc]e,? ?(?:\(?(?:gnu )?gpl\)?,? ?)?(?:version |v\.? ?)2(?:\.0)?(?![0-9]|\.[0-9])
gpl-3.0 | 2 | general public licen | \b(?:gnu )?general public licen[sc]e,? ?(?:\(?(?:gnu )?gpl\)?,? ?)?(?:version |v\.? ?)3(?:\.0)?(?![0-9]|\.[0-9])
gpl-2.0 | 4 | gpl | \b(?:gnu )?gpl(?:[ -]?v(?:ersion)?\.? ?|[ -])2(?:\.0)?(?![0-9]|\.[0-9])
gpl-3.0 | 4 | gpl | \b(?:gnu )?gpl(?:[ -]?v(?:ersion)?\.? ?|[ -])3(?:\.0)?(?![0-9]|\.[0-9])
gpl | 4 | general public licen | \b(?:gnu )?general public licen[sc]e\b
gpl | 5 | gpl | \b(?:gnu )?gpl(?:ed|'d)?\b
gpl-classpath | 2 | classpath | \bclasspath exception\b
gpl-linking | 2 | special exception | as a special exception, .{0,80}permission to link
lgpl | 2 | lesser general public | under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl | 2 | library general public | under the terms of the gnu library general public licen[sc]e
lgpl-2.1 | 2 | version 2.1, february 1999 | gnu lesser general public licen[sc]e version 2\.1, february 1999
lgpl-3.0 | 2 | version 3, 29 june 2007 | gnu lesser general public licen[sc]e version 3, 29 june 2007
lgpl-2.1-or-later | 2 | either version 2.1 | lesser general public licen[sc]e as published by the free software foundation[;,] either version 2\.1
lgpl | 3 | gnu.org/licenses/lgpl | gnu\.org/(?:licenses|copyleft)/lgpl[a-z0-9.-]*
lgpl-2.0 | 2 | library general public | \b(?:gnu )?library general public licen[sc]e,? ?(?:\(?(?:gnu )?lgpl\)?,? ?)?(?:version |v\.? ?)2(?:\.0)?(?![0-9]|\.[0-9])
lgpl-2.1 | 2 | lesser general public | \b(?:gnu )?lesser general public licen[sc]e,? ?(?:\(?(?:gnu )?lgpl\)?,? ?)?(?:version |v\.? ?)2\.1(?![0-9]|\.[0-9])
lgpl-3.0 | 2 | lesser general public | \b(?:gnu )?lesser general public licen[sc]e,? ?(?:\(?(?:gnu )?lgpl\)?,? ?)?(?:version |v\.? ?)3(?:\.0)?(?![0-9]|\.[0-9])
lgpl-2.1 | 4 | lgpl | \b(?:gnu )?lgpl[ -]?v?(?:ersion )?2\.1(?![0-9]|\.[0-9])
lgpl-3.0 | 4 | lgpl | \b(?:gnu )?lgpl[ -]?v?(?:ersion )?3(?:\.0)?(?![0-9]|\.[0-9])
lgpl | 4 | general public licen | \b(?:gnu )?(?:lesser|library) general public licen[sc]e\b
lgpl | 4 | lgpl | \b(?:gnu )?lgpl\b
agpl | 2 | affero general public | under the terms of the gnu affero general public licen[sc]e
agpl-3.0 | 2 | 19 november 2007 | gnu affero general public licen[sc]e version 3, 19 november 2007
agpl | 2 | remote network interaction | remote network interaction; use with the gnu general public licen[sc]e
agpl | 3 | gnu.org/licenses/agpl | gnu\.org/licenses/agpl[a-z0-9.-]*
agpl | 4 | affero general public | \b(?:gnu )?affero general public licen[sc]e\b
agpl-3.0 | 2 | affero general public | \b(?:gnu )?affero general public licen[sc]e,? ?(?:\(?(?:gnu )?agpl\)?,? ?)?(?:version |v\.? ?)3(?:\.0)?(?![0-9]|\.[0-9])
agpl-3.0 | 4 | agpl | \b(?:gnu )?agpl[ -]?v?3(?:\.0)?(?![0-9]|\.[0-9])
agpl | 4 | agpl | \b(?:gnu )?agpl\b
gfdl | 2 | free documentation licen | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl | 2 | invariant sections | with no invariant sections, no front-cover texts,? and no back-cover texts
gfdl | 4 | free documentation licen | \b(?:gnu )?free documentation licen[sc]e\b
mpl-2.0 | 2 | subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e, v\. ?2\.0
mpl-1.1 | 2 | subject to the mozilla public licen | the contents of this file are subject to the mozilla public licen[sc]e version 1\.1
mpl-2.0 | 2 | a copy of the mpl | if a copy of the mpl was not distributed with this file, you can obtain one at
mpl | 3 | mozilla.org/mpl | mozilla\.org/(?:en-us/)?mpl(?:/[0-9.]+)?
mpl | 4 | mozilla public licen | \bmozilla public licen[sc]e\b
epl-1.0 | 2 | eclipse public licen | made available under the terms of the eclipse public licen[sc]e v ?1\.0
epl-2.0 | 2 | eclipse public licen | made available under the terms of the eclipse public licen[sc]e (?:v ?)?2\.0
epl | 3 | eclipse.org/legal/epl | eclipse\.org/(?:org/documents|legal)/epl[a-z0-9./-]*
epl | 4 | eclipse public licen | \beclipse public licen[sc]e\b
edl | 4 | eclipse distribution licen | \beclipse distribution licen[sc]e\b
cddl | 2 | common development and distribution | subject to the terms of (?:either )?.{0,60}the common development and distribution licen[sc]e
cddl | 4 | common development and distribution | \bcommon development and distribution licen[sc]e\b
cddl | 4 | cddl | \bcddl\b
cpl-1.0 | 2 | common public licen | made available under the terms of the common public licen[sc]e v ?1\.0
cpl | 4 | common public licen | \bcommon public licen[sc]e\b
ipl | 4 | ibm public licen | \bibm public licen[sc]e\b
eupl | 2 | under the eupl | licen[sc]ed under the eupl,? version
eupl | 4 | european union public licen | \beuropean union public licen[sc]e\b
eupl | 5 | eupl | \beupl\b
artistic | 2 | artistic licen | under the terms of (?:either .{0,80})?the (?:perl )?artistic licen[sc]e
artistic-2.0 | 4 | artistic licen | \bartistic licen[sc]e,? (?:version )?2(?:\.0)?\b
artistic | 4 | artistic licen | \bartistic licen[sc]e\b
perl | 2 | same terms as perl | under the same terms as perl itself
boost-1.0 | 2 | boost software licen | distributed under the boost software licen[sc]e, version 1\.0
boost | 2 | prepare derivative works | use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works
boost | 3 | boost.org/license | boost\.org/license_1_0\.txt
boost | 4 | boost software licen | \bboost software licen[sc]e\b
zlib | 2 | origin of this software | the origin of this software must not be misrepresented; you must not claim that you wrote the original software
zlib | 2 | altered source versions | altered source versions must be plainly marked as such
zlib | 4 | zlib | \bzlib(?:/libpng)? licen[sc]e\b
libpng | 4 | libpng | \blibpng licen[sc]e\b
unlicense | 2 | unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 2 | anyone is free to copy | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
unlicense | 3 | unlicense.org | \bunlicense\.org\b
unlicense | 4 | unlicense | \bthe unlicense\b
wtfpl | 2 | what the fuck | you just do what the fuck you want to
wtfpl | 4 | wtfpl | \bwtfpl\b
beerware | 2 | beer-ware | \bbeer-ware licen[sc]e\b
beerware | 2 | buy me a beer | if we meet some day, and you think this stuff is worth it, you can buy me a beer
psf | 4 | python software foundation | \bpython software foundation licen[sc]e\b
psf | 3 | docs.python.org | docs\.python\.org/(?:3/)?license(?:\.html)?
php | 2 | php software, freely available | this product includes php software, freely available from
php | 4 | php licen | \bphp licen[sc]e\b
ruby | 4 | ruby | \bruby(?:'s)? licen[sc]e\b
ruby | 2 | same terms as ruby | under the same terms as ruby\b
openssl | 2 | openssl | this product includes software developed by the openssl project
openssl | 2 | eric young | this product includes cryptographic software written by eric young
openssl | 4 | openssl licen | \bopenssl licen[sc]e\b
ofl-1.1 | 2 | sil open font licen | this font software is licen[sc]ed under the sil open font licen[sc]e, version 1\.1
ofl | 2 | reserved font name | no modified version of the font software may use the reserved font name
ofl | 3 | sil.org/ofl | (?:scripts\.sil\.org/ofl|openfontlicense\.org)
ofl | 4 | open font licen | \b(?:sil )?open font licen[sc]e\b
ms-pl | 4 | microsoft public licen | \bmicrosoft public licen[sc]e\b
ms-rl | 4 | microsoft reciprocal licen | \bmicrosoft reciprocal licen[sc]e\b
ms-eula | 4 | microsoft software licen | \bmicrosoft software licen[sc]e terms\b
apsl | 2 | apple public source licen | subject to the apple public source licen[sc]e version
apsl | 4 | apple public source licen | \bapple public source licen[sc]e\b
osl-3.0 | 2 | open software licen | licen[sc]ed under the open software licen[sc]e version 3\.0
osl | 4 | open software licen | \bopen software licen[sc]e\b
afl-3.0 | 2 | academic free licen | licen[sc]ed under the academic free licen[sc]e version 3\.0
afl | 4 | academic free licen | \bacademic free licen[sc]e\b
ecl-2.0 | 4 | educational community licen | \beducational community licen[sc]e\b
qpl | 4 | q public licen | \bq public licen[sc]e\b
ncsa | 4 | university of illinois | \buniversity of illinois(?:/ncsa)? open source licen[sc]e\b
llvm-exception | 2 | llvm exception | \b(?:with|and) (?:the )?llvm exceptions?\b
zpl | 4 | zope public licen | \bzope public licen[sc]e\b
lppl | 2 | latex project public licen | distributed and/or modified under the conditions of the latex project public licen[sc]e
lppl | 4 | latex project public licen | \blatex project public licen[sc]e\b
postgresql | 4 | postgresql licen | \bpostgresql licen[sc]e\b
vim | 4 | vim licen | \bvim licen[sc]e\b
w3c | 4 | w3c | \bw3c(?:\(r\)|®)? software (?:notice and )?licen[sc]e\b
icu | 4 | icu licen | \bicu licen[sc]e\b
unicode | 2 | unicode | \bunicode(?:,? inc\.)? licen[sc]e agreement\b
curl | 4 | curl licen | \bcurl licen[sc]e\b
nasa | 4 | nasa open source | \bnasa open source agreement\b
sleepycat | 4 | sleepycat | \bsleepycat licen[sc]e\b
jasper | 4 | jasper licen | \bjasper licen[sc]e\b
json | 2 | good, not evil | the software shall be used for good, not evil
cecill | 4 | cecill | \bcecill(?:-[abc])?(?: licen[sc]e)?\b
mulan | 4 | mulan | \bmulan (?:psl|permissive software licen[sc]e)
upl | 4 | universal permissive licen | \buniversal permissive licen[sc]e\b
blueoak | 4 | blue oak model licen | \bblue oak model licen[sc]e\b
sspl | 2 | making the functionality of the program | making the functionality of the program or a modified version available to third parties as a service
sspl | 4 | server side public licen | \bserver side public licen[sc]e\b
busl | 2 | change date | change date: .{0,80}change licen[sc]e:
busl | 4 | business source licen | \bbusiness source licen[sc]e\b
elastic | 4 | elastic licen | \belastic licen[sc]e(?: 2\.0)?\b
commons-clause | 2 | commons clause | "?commons clause"? licen[sc]e condition
polyform | 4 | polyform | \bpolyform (?:noncommercial|small business|shield|strict|free trial|internal use) licen[sc]e\b
confluent | 4 | confluent community licen | \bconfluent community licen[sc]e\b
rpl | 4 | reciprocal public licen | \breciprocal public licen[sc]e\b
watcom | 4 | watcom | \bsybase open watcom public licen[sc]e\b
odbl | 2 | open database licen | made available under the open database licen[sc]e
odbl | 4 | database licen | \bopen (?:data commons open )?database licen[sc]e\b
odc-by | 4 | open data commons attribution | \bopen data commons attribution licen[sc]e\b
pddl | 4 | public domain dedication and licen | \bpublic domain dedication and licen[sc]e\b
cdla | 4 | community data licen | \bcommunity data licen[sc]e agreement\b
ogl | 2 | open government licen | contains public sector information licen[sc]ed under the open government licen[sc]e
ogl | 4 | open government licen | \bopen government licen[sc]e\b
etalab | 4 | licence ouverte | \blicence ouverte\b
dl-de | 4 | datenlizenz deutschland | \bdatenlizenz deutschland\b
openrail | 4 | rail | \b(?:bigscience |creativeml )?open ?rail(?:\+\+)?(?:-[ms])? licen[sc]e\b
openrail | 4 | responsible ai licen | \bresponsible ai licen[sc]e\b
llama | 4 | llama | \bllama [0-9.]* ?community licen[sc]e(?: agreement)?\b
gemma | 4 | gemma terms of use | \bgemma terms of use\b
cc0-1.0 | 2 | cc0 | \bcc0 1\.0 universal\b
cc0 | 2 | waived all copyright | has waived all copyright and related or neighbou?ring rights
cc0 | 3 | publicdomain/zero | creativecommons\.org/publicdomain/zero(?:/1\.0)?
cc0 | 4 | cc0 | \bcc0\b
cc-pdm | 3 | publicdomain/mark | creativecommons\.org/publicdomain/mark(?:/1\.0)?
cc | 5 | creative commons | \bcreative commons\b
cc-by | 4 | cc by | \bcc by\b(?![ -](?:sa|nd|nc)\b)
cc-by | 4 | cc-by | \bcc-by\b(?![ -](?:sa|nd|nc)\b)
public-domain | 2 | public domain | (?:i|we|the authors?) (?:hereby )?(?:place|release|dedicate)s? (?:this|the) (?:work|software|code|text) (?:in|into|to) the public domain
public-domain | 4 | public domain | (?:dedicated to|released into|placed in|in) the public domain
public-domain | 5 | public domain | \bpublic domain\b
crown | 4 | crown copyright | \bcrown copyright\b
proprietary | 2 | confidential and proprietary | \bconfidential and proprietary (?:information|property) of\b
proprietary | 4 | proprietary | \bproprietary(?: and confidential| licen[sc]e| software)\b
proprietary | 4 | unauthorized | \bunauthorized (?:copying|use|distribution|reproduction)\b
proprietary | 4 | unauthorised | \bunauthorised (?:copying|use|distribution|reproduction)\b
proprietary | 4 | end user licen | \bend user licen[sc]e agreement\b
proprietary | 4 | may not be reproduced | \bmay not be reproduced,? .{0,60}without (?:the )?(?:prior )?(?:written )?permission
permission | 5 | permission | \b(?:used|reprinted|reproduced) (?:with|by) permission\b
noncommercial | 5 | commercial | \bfor non-?commercial (?:use|purposes) only\b
evaluation | 5 | evaluation | \bfor evaluation (?:use|purposes) only\b
reserved | 4 | rights reserved | \b(?:all|some|no) rights reserved\b
reserved | 4 | alle rechte vorbehalten | \balle rechte vorbehalten\b
reserved | 4 | tous droits | \btous droits r[ée]serv[ée]s\b
reserved | 4 | todos los derechos | \btodos los derechos reservados\b
copyright | 5 | copyright | \bcopyright (?:\(c\)|©|[12][0-9]{3})
copyright | 5 | © | © ?(?:copyright )?[12][0-9]{3}
copyright | 5 | (c) | \(c\) [12][0-9]{3}
warranty | 5 | without warrant | \bwithout (?:any )?warrant(?:y|ies)(?: or conditions)? of any kind\b
warranty | 5 | without any warranty | \bbut without any warranty\b
warranty | 5 | as is | \bprovided [\"'“]?as is[\"'”]?
warranty | 5 | as-is | \bprovided [\"'“]?as-is[\"'”]?
spdx | 5 | spdx-license-identifier | spdx-license-identifier: ?[a-z0-9.+-]+
licensed | 5 | licensed under | \blicensed under (?:the )?(?:terms of )?
licensed | 5 | licenced under | \blicenced under (?:the )?(?:terms of )?
"""

# What many keywords have in common, for the first gate.
STEMS = (
    "licen", "gpl", "copyright", "public", "permission", "software", "apache", "bsd", "-clause", "version ", "without", "commons", "propriet", "unauthori",
    "redistribut", "afl", "ofl", "osl", "zpl", "gfdl", "cddl", "eupl", "artistic", "same terms as",
)

# Families whose identifiers and versions follow one form: label, identifier, name (a regular expression), a word that the name has, versions.
FAMILIES = (
    ("apache", "apache", "apache(?: software)? licen[sc]e", "apache", "1.0 1.1 2.0"),
    ("gfdl", "gfdl", "(?:gnu )?free documentation licen[sc]e", "free documentation licen", "1.1 1.2 1.3"),
    ("mpl", "mpl", "mozilla public licen[sc]e", "mozilla public licen", "1.0 1.1 2.0"),
    ("epl", "epl", "eclipse public licen[sc]e", "eclipse public licen", "1.0 2.0"),
    ("cddl", "cddl", "common development and distribution licen[sc]e", "common development and distribution licen", "1.0 1.1"),
    ("eupl", "eupl", "european union public licen[sc]e", "european union public licen", "1.0 1.1 1.2"),
    ("artistic", "artistic", "artistic licen[sc]e", "artistic licen", "1.0 2.0"),
    ("ofl", "ofl", "(?:sil )?open font licen[sc]e", "open font licen", "1.0 1.1"),
    ("osl", "osl", "open software licen[sc]e", "open software licen", "1.0 2.0 2.1 3.0"),
    ("afl", "afl", "academic free licen[sc]e", "academic free licen", "1.1 1.2 2.0 2.1 3.0"),
    ("zpl", "zpl", "zope public licen[sc]e", "zope public licen", "1.1 2.0 2.1"),
    ("bsd", "bsd", "bsd licen[sc]e", "bsd licen", "0-clause 1-clause 2-clause 3-clause 4-clause"),
)
# Creative Commons: the parts of a license, in words.
CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_WORDS = {"by": "attribution", "sa": "share ?-?alike", "nd": "no ?-?deriv(?:ative)?s?(?: works)?", "nc": "non ?-?commercial"}
CC_VERSION = "(1\\.0|2\\.0|2\\.5|3\\.0|4\\.0)"


def rules() -> list[Rule]:
    """All rules, in order: by priority, then as written."""
    found = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ")
        found.append(Rule(label, int(priority), keyword, pattern))
    for label, short, name, word, versions in FAMILIES:
        one_of = "(" + "|".join(v.replace(".", r"\.") for v in versions.split()) + r")(?![0-9]|\.[0-9])"
        found.append(Rule(label, TAG, "spdx-license-identifier", rf"spdx-license-identifier: ?\(?{short}-{one_of}(?:-only|-or-later|\+)?", versioned=True))
        found.append(Rule(label, GRANT, word, rf"\b(?:the )?{name},? ?(?:\(?{short}\)?,? ?)?(?:version |v\.? ?|ver\. ?)?{one_of}", versioned=True))
        for mark in " -":
            found.append(Rule(label, TITLE, short + mark, rf"\b{short}{mark}v?\.?{one_of}(?:-only|-or-later|\+)?", versioned=True))
    for label in ("gpl", "lgpl", "agpl"):
        found.append(Rule(label, TAG, "spdx-license-identifier", rf"spdx-license-identifier: ?\(?{label}-(1\.0|2\.0|2\.1|3\.0)(?:-only|-or-later|\+)?", versioned=True))
    for label in ("mit", "isc", "zlib", "unlicense", "0bsd", "psf", "ncsa", "wtfpl"):
        found.append(Rule(label, TAG, "spdx-license-identifier", rf"spdx-license-identifier: ?\(?{label}(?![a-z0-9])"))
    for parts in CC_PARTS:
        words = "[ -]".join(CC_WORDS[p] for p in parts.split("-"))
        found.append(Rule(f"cc-{parts}", TAG, "spdx-license-identifier", rf"spdx-license-identifier: ?\(?cc-{parts}-{CC_VERSION}", versioned=True))
        for keyword in ("cc by", "cc-by"):
            code = keyword + parts[2:].replace("-", "[ -]")
            if parts != "by":
                found.append(Rule(f"cc-{parts}", TITLE, keyword, rf"\b{code}(?![ -](?:sa|nd|nc)\b)\b"))
            found.append(Rule(f"cc-{parts}", GRANT, keyword, rf"\b{code}[ -]{CC_VERSION}(?![0-9]|\.[0-9])", versioned=True))
        found.append(Rule(f"cc-{parts}", GRANT, "creative commons", rf"\bcreative commons {words}(?![ -](?:share|no|non))(?: licen[sc]e)?"))
        found.append(Rule(f"cc-{parts}", GRANT, "creative commons", rf"\bcreative commons {words}(?: licen[sc]e)?,? (?:version )?{CC_VERSION}(?: (?:international|unported|generic))?(?: licen[sc]e)?", versioned=True))
        found.append(Rule(f"cc-{parts}", LINK, "creativecommons.org/licenses", rf"creativecommons\.org/licenses/{parts}/{CC_VERSION}", versioned=True))
        found.append(Rule(f"cc-{parts}", LINK, "creativecommons.org/licenses", rf"creativecommons\.org/licenses/{parts}(?![a-z0-9-])"))
    return sorted(found, key=lambda r: r.priority)
