"""The signature rules of the licence scan, in order.

A line of WRITTEN is: label; level (3 a whole text, identifier or exact version, 2 a name, 1 a hint); confidence; expression.
Expressions speak of lower-cased words joined by single spaces and match whole words.
"""

from __future__ import annotations

import re

#: (label, keyword, expression, level, confidence)
Rule = tuple[str, str, str, int, float]

# fixed values: the base phrases and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# fixed values: signatures of licence texts, names and notices
WRITTEN = r"""
mit; 3; 1.0; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; 3; 0.95; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; 2; 0.9; licensed under (?:the )?mit(?: license)?
mit; 2; 0.95; (?:released|distributed|available) under the (?:terms of the )?mit license
mit; 2; 0.9; (?:the )?expat license
mit; 3; 1.0; spdx license identifier mit
mit-0; 3; 1.0; mit no attribution
mit-0; 3; 1.0; spdx license identifier mit 0
mit-cmu; 2; 0.9; cmu license
x11; 2; 0.9; x11 license
x11; 3; 0.95; except as contained in this notice the name of the x consortium shall not be used in advertising
isc; 3; 1.0; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 2; 0.9; isc licen[cs]e
isc; 3; 1.0; spdx license identifier isc
0bsd; 3; 1.0; spdx license identifier 0bsd
0bsd; 2; 0.9; zero clause bsd licen[cs]e
bsd; 3; 1.0; redistribution and use in source and binary forms with or without modification are permitted
bsd; 3; 0.9; redistributions of source code must retain the above copyright notice
bsd; 3; 0.9; redistributions in binary form must reproduce the above copyright notice
bsd; 2; 0.8; bsd(?: style)? licen[cs]e
bsd-2-clause; 2; 0.95; simplified bsd licen[cs]e
bsd-2-clause; 2; 0.9; freebsd licen[cs]e
bsd-3-clause; 3; 1.0; may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause; 2; 0.95; (?:new|modified|revised) bsd licen[cs]e
bsd-3-clause; 3; 1.0; spdx license identifier bsd 3 clause
bsd-2-clause; 3; 1.0; spdx license identifier bsd 2 clause
bsd-4-clause; 3; 1.0; all advertising materials mentioning features or use of this software must display
bsd-4-clause; 2; 0.9; original bsd licen[cs]e
bsd-4-clause; 3; 0.95; this product includes software developed by the university of california berkeley and its contributors
bsd-protection; 2; 0.9; bsd protection licen[cs]e
zlib; 2; 0.9; zlib(?: libpng)? licen[cs]e
zlib; 3; 1.0; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib; 3; 1.0; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; 3; 0.95; altered source versions must be plainly marked as such
libpng; 2; 0.9; libpng licen[cs]e
boost; 2; 0.95; boost software licen[cs]e(?: version 1 0)?
boost; 3; 1.0; spdx license identifier bsl 1 0
boost; 3; 1.0; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense; 3; 1.0; this is free and unencumbered software released into the public domain
unlicense; 2; 0.8; (?:the )?unlicense
wtfpl; 2; 0.8; wtfpl
wtfpl; 2; 0.95; do what the fuck you want to public license
beerware; 2; 0.9; beer ?ware licen[cs]e
beerware; 3; 1.0; if we meet some day and you think this stuff is worth it you can buy me a beer in return
cc0; 3; 1.0; creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc0; 2; 0.9; cc0(?: 1 0)?(?: universal)?
cc0; 3; 1.0; creativecommons org publicdomain zero 1 0
cc0; 3; 0.95; to the extent possible under law the person who associated cc0 with this work has waived all copyright
cc-pd; 3; 1.0; creativecommons org publicdomain mark 1 0
cc-pd; 2; 0.9; public domain mark 1 0
cc-sampling; 2; 0.9; creative commons sampling(?: plus)? 1 0
cc-devnations; 2; 0.9; creative commons developing nations licen[cs]e
public-domain; 2; 0.8; (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain; 2; 0.85; this (?:work|file|software|program) is in the public domain
public-domain; 1; 0.5; public domain
pddl; 2; 0.95; public domain dedication and licen[cs]e
odbl; 2; 0.95; open (?:data commons open )?database licen[cs]e
odc-by; 2; 0.95; open data commons attribution licen[cs]e
odc-by; 3; 1.0; spdx license identifier odc by 1 0
cdla-permissive; 2; 0.95; community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing; 2; 0.95; community data license agreement sharing(?: version)?(?: 1 0)?
ogl; 2; 0.9; open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?
ogl-canada; 2; 0.95; open government licen[cs]e canada
dl-de; 2; 0.95; data ?licen[cs]e germany(?: attribution)?(?: version 2 0)?
etalab; 2; 0.95; licence ouverte(?: open licence)?(?: etalab)?(?: [12] 0)?
nlod; 2; 0.95; norwegian licen[cs]e for open government data
artistic; 2; 0.9; artistic licen[cs]e(?: version)?(?: [12] 0)?
artistic; 2; 0.9; clarified artistic licen[cs]e
perl; 3; 0.95; same terms as perl(?: itself)?
python; 2; 0.95; python software foundation licen[cs]e(?: version 2)?
python; 2; 0.9; python licen[cs]e 2 0
cnri-python; 2; 0.95; cnri (?:open source )?(?:python )?licen[cs]e agreement
php; 2; 0.9; php licen[cs]e(?: version)?(?: 3 0[01]?)?
zend; 2; 0.9; zend engine licen[cs]e
ruby; 2; 0.85; ruby licen[cs]e
ruby; 3; 0.95; same terms as ruby(?: itself)?
tcl; 2; 0.85; tcl tk licen[cs]e
lua; 2; 0.85; lua licen[cs]e
vim; 2; 0.8; vim licen[cs]e
postgresql; 2; 0.9; postgresql licen[cs]e
openssl; 2; 0.9; openssl licen[cs]e
openssl; 3; 0.95; this product includes software developed by the openssl project
ssleay; 2; 0.9; ssleay licen[cs]e
curl; 2; 0.85; curl licen[cs]e
openldap; 2; 0.95; openldap public licen[cs]e(?: version)?(?: 2 [0-8])?
ntp; 2; 0.85; ntp licen[cs]e
hpnd; 2; 0.95; historical permission notice and disclaimer
ncsa; 2; 0.95; university of illinois (?:ncsa )?open source licen[cs]e
icu; 2; 0.85; icu licen[cs]e
unicode; 2; 0.95; unicode licen[cs]e(?: agreement)?(?: v3)?
unicode; 2; 0.95; unicode inc licen[cs]e agreement data files and software
w3c; 2; 0.95; w3c software (?:notice and license|and document notice and license)
w3c; 2; 0.9; w3c document licen[cs]e
ijg; 2; 0.9; independent jpeg group
ijg; 3; 1.0; this software is based in part on the work of the independent jpeg group
freetype; 2; 0.9; freetype (?:project )?licen[cs]e
imagemagick; 2; 0.9; imagemagick licen[cs]e
info-zip; 2; 0.9; info zip licen[cs]e
bzip2; 2; 0.9; bzip2 (?:and libbzip2 )?licen[cs]e
sqlite-blessing; 3; 1.0; may you do good and not evil may you find forgiveness for yourself and forgive others
json; 3; 1.0; the software shall be used for good not evil
sleepycat; 2; 0.9; sleepycat licen[cs]e
qpl; 2; 0.9; q public licen[cs]e(?: version)?(?: 1 0)?
ms-pl; 2; 0.9; microsoft public licen[cs]e
ms-rl; 2; 0.9; microsoft reciprocal licen[cs]e
ms-lpl; 2; 0.9; microsoft limited public licen[cs]e
ms-eula; 2; 0.9; microsoft software licen[cs]e terms
apsl; 2; 0.95; apple public source licen[cs]e(?: version)?(?: [12] [012])?
apple-mit; 2; 0.9; apple mit licen[cs]e
ipa; 2; 0.9; ipa font licen[cs]e
ofl; 2; 0.95; sil open font licen[cs]e(?: version 1 1)?
ofl; 3; 1.0; spdx license identifier ofl 1 1
ubuntu-font; 2; 0.95; ubuntu font licen[cs]e(?: 1 0)?
bitstream-vera; 2; 0.9; bitstream vera fonts? copyright
lppl; 3; 0.95; this work may be distributed and or modified under the conditions of the latex project public license
knuth; 2; 0.8; knuth ctan licen[cs]e
eupl; 2; 0.95; european union public licen[cs]e(?: v(?:ersion)? ?1 [0-2])?
eupl; 3; 1.0; spdx license identifier eupl 1 [0-2]
cecill; 2; 0.9; cecill(?: [bc])?(?: free software)? licen[cs]e(?: agreement)?
cern-ohl; 2; 0.95; cern open hardware licen[cs]e(?: version 2)?(?: permissive| weakly reciprocal| strongly reciprocal)?
tapr-ohl; 2; 0.95; tapr open hardware licen[cs]e
solderpad; 2; 0.9; solderpad hardware licen[cs]e
gfdl; 3; 1.0; gnu free documentation licen[cs]e(?: version 1 [1-3])?
gfdl; 3; 0.95; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl; 3; 0.95; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl; 3; 0.9; you should have received a copy of the gnu general public license along with this program
gpl; 2; 0.8; see the gnu general public license for more details
lgpl; 3; 0.95; this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl; 3; 0.9; you should have received a copy of the gnu affero general public license along with this program
gpl-exception; 2; 0.9; gcc runtime library exception
gpl-exception; 2; 0.9; (?:gpl )?classpath exception
gpl-exception; 2; 0.9; linking this library statically or dynamically with other modules
gpl-exception; 2; 0.85; autoconf exception
gpl-exception; 2; 0.85; bison exception
gpl-exception; 2; 0.85; font exception
gpl-exception; 2; 0.9; llvm exceptions?
gpl-exception; 2; 0.85; openssl linking exception
gpl-exception; 2; 0.85; linux syscall note
copyleft-next; 2; 0.9; copyleft next(?: 0 3 [01])?
apache; 3; 1.0; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache; 3; 1.0; www apache org licenses license 2 0
apache; 2; 0.9; apache software foundation licen[cs]e
apache; 3; 1.0; spdx license identifier apache 2 0
mpl; 3; 1.0; this source code form is subject to the terms of the mozilla public license v 2 0
mpl; 3; 0.95; the contents of this file are subject to the mozilla public license version 1 1
epl; 3; 1.0; this program and the accompanying materials are made available under the terms of the eclipse public license
cpl; 2; 0.9; common public licen[cs]e(?: version 1 0)?
ibm-pl; 2; 0.9; ibm public licen[cs]e
cpal; 2; 0.95; common public attribution licen[cs]e(?: version 1 0)?
cddl; 3; 0.95; the contents of this file are subject to the terms of the common development and distribution license
osl; 2; 0.9; open software licen[cs]e(?: version)?(?: [123] [01])?
afl; 2; 0.9; academic free licen[cs]e(?: version)?(?: [123] [012])?
aal; 2; 0.9; attribution assurance licen[cs]e
rpl; 2; 0.95; reciprocal public licen[cs]e(?: 1 [15])?
sisl; 2; 0.9; sun industry standards source licen[cs]e
spl; 2; 0.9; sun public licen[cs]e
bcl; 2; 0.9; (?:sun|oracle) binary code licen[cs]e agreement
upl; 2; 0.95; universal permissive licen[cs]e(?: v ?1 0)?
nasa; 2; 0.95; nasa open source agreement(?: version 1 3)?
naist; 2; 0.9; naist licen[cs]e
nokia; 2; 0.9; nokia open source licen[cs]e
real; 2; 0.9; realnetworks public source licen[cs]e
ricoh; 2; 0.9; ricoh source code public licen[cs]e
intel; 2; 0.9; intel open source licen[cs]e
intel-simplified; 2; 0.9; intel simplified software licen[cs]e
lucent; 2; 0.9; lucent public licen[cs]e(?: version 1 0[2]?)?
motosoto; 2; 0.9; motosoto open source licen[cs]e
mulan; 2; 0.95; mulan (?:permissive software|psl) (?:licen[cs]e )?(?:v ?[12])
oclc; 2; 0.9; oclc research public licen[cs]e
sybase; 2; 0.9; sybase open watcom public licen[cs]e
vovida; 2; 0.9; vovida software licen[cs]e
watcom; 2; 0.85; open watcom public licen[cs]e
xnet; 2; 0.8; x net licen[cs]e
zpl; 2; 0.95; zope public licen[cs]e(?: version)?(?: [12] [01])?
entessa; 2; 0.85; entessa public licen[cs]e
eiffel; 2; 0.9; eiffel forum licen[cs]e(?: version 2)?
fair; 2; 0.7; fair licen[cs]e
frameworx; 2; 0.85; frameworx open licen[cs]e
ecl; 2; 0.95; educational community licen[cs]e(?: version)?(?: [12] 0)?
efl; 2; 0.9; condor public licen[cs]e
blueoak; 2; 0.95; blue oak model licen[cs]e(?: 1 0 0)?
parity; 2; 0.9; parity public licen[cs]e(?: 7 0 0)?
polyform; 2; 0.95; polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e(?: 1 0 0)?
prosperity; 2; 0.9; prosperity public licen[cs]e(?: 3 0 0)?
hippocratic; 2; 0.9; hippocratic licen[cs]e(?: [123] [01])?
acsl; 2; 0.9; anti capitalist software licen[cs]e
sspl; 2; 0.95; server side public licen[cs]e
busl; 2; 0.95; business source licen[cs]e(?: 1 1)?
fsl; 2; 0.95; functional source licen[cs]e(?: 1 [01])?
elastic; 2; 0.9; elastic licen[cs]e(?: 2 0)?
confluent; 2; 0.9; confluent community licen[cs]e
timescale; 2; 0.9; timescale licen[cs]e
redis; 2; 0.9; redis source available licen[cs]e
commons-clause; 2; 0.9; commons clause licen[cs]e condition
openrail; 2; 0.9; open ?rail(?: [sm])? licen[cs]e
openrail; 2; 0.95; creativeml open ?rail m
bigscience; 2; 0.95; bigscience (?:open ?)?rail licen[cs]e
bigcode; 2; 0.95; bigcode open ?rail m(?: v1)?
llama; 2; 0.95; llama [234](?: [0-9])? community licen[cs]e(?: agreement)?
gemma; 2; 0.9; gemma terms of use
copyright; 1; 0.6; copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright; 1; 0.5; copyright (?:by|c|of|holders?|notice|owners?)
all-rights-reserved; 1; 0.6; all rights reserved
all-rights-reserved; 1; 0.5; some rights reserved
all-rights-reserved; 1; 0.55; alle rechte vorbehalten
all-rights-reserved; 1; 0.55; tous droits réservés
all-rights-reserved; 1; 0.55; todos los derechos reservados
warranty-disclaimer; 1; 0.4; without warranty of any kind(?: express or implied)?
warranty-disclaimer; 1; 0.4; without warranties or conditions of any kind
warranty-disclaimer; 1; 0.3; provided as is
warranty-disclaimer; 1; 0.4; implied warranties of merchantability
proprietary; 2; 0.8; (?:confidential and proprietary|proprietary and confidential) information
proprietary; 2; 0.7; proprietary (?:license|licence|software)
proprietary; 2; 0.9; no part of this (?:publication|work|document|book) may be reproduced
proprietary; 1; 0.6; (?:without|except with) (?:the )?(?:express|prior|written)(?: written)? permission of
proprietary; 2; 0.8; unauthori[sz]ed (?:copying|reproduction|distribution)(?: of this (?:file|document|work))?
proprietary; 2; 0.8; reproduction in whole or in part is prohibited
trade-secret; 2; 0.8; contains trade secrets
commercial; 2; 0.8; end user licen[cs]e agreement
commercial; 1; 0.6; commercial licen[cs]e
non-commercial; 2; 0.7; for noncommercial use only
non-commercial; 2; 0.7; for noncommercial purposes only
non-commercial; 2; 0.7; for non commercial use only
non-commercial; 2; 0.7; for non commercial purposes only
non-commercial; 2; 0.7; personal use only
non-commercial; 2; 0.7; private use only
research-only; 2; 0.75; for academic (?:use|purposes) only
research-only; 2; 0.75; for research (?:use|purposes) only
evaluation; 2; 0.75; for evaluation purposes only
freeware; 1; 0.6; freeware
shareware; 1; 0.6; shareware
terms; 1; 0.4; subject to (?:the|these|our) terms (?:and conditions|of (?:use|service))
terms; 1; 0.4; terms of (?:use|service) apply
reprint; 2; 0.7; reprinted (?:with|by) permission
press; 1; 0.5; courtesy of the (?:author|publisher|artist|photographer)
"""


def written_rules() -> list[tuple[str, str, int, float]]:
    """(label, expression, level, confidence) of every line of WRITTEN."""
    lines = [line.split("; ", 3) for line in WRITTEN.strip().splitlines()]
    return [(label, rx, int(level), float(score)) for label, level, score, rx in lines]


def family_rules() -> list[tuple[str, str, int, float]]:
    """Families built from their members, versions and ways of naming them."""
    out: list[tuple[str, str, int, float]] = []
    long = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        for version in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
            label = "cc-" + "-".join(parts) + (f"-{version}" if version else "")
            tail = "".join(f" {x}" for x in version.split(".") if x)
            score, level = (1.0, 3) if version else (0.85, 2)
            out.append((label, f"cc {' '.join(parts)}{tail}", level, score))
            out.append((label, f"creativecommons org licenses {' '.join(parts)}{tail}", level, score))
            out.append((label, f"creative commons {' '.join(long[p] for p in parts)}(?: international| unported| generic)?{tail}(?: (?:international|unported|generic))?", level, score))
    for code, word, versions in (("gpl", "", ("1", "2", "3")), ("lgpl", "(?:lesser |library )", ("2", "2.1", "3")), ("agpl", "affero ", ("1", "3"))):
        for version in versions:
            v = version.replace(".", " ")
            zero = "" if "." in version else "(?: 0)?"
            for suffix, end in (("", ""), ("-only", " only"), ("-or-later", "(?: of the license)?(?: or at your option)?(?: or)? any later(?: version)?")):
                label = f"{code}-{version}{suffix}"
                out.append((label, f"gnu {word}general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion )?{v}{zero}{end}", 3, 1.0))
                short = " or later" if suffix == "-or-later" else end
                out.append((label, f"{code} ?v?{v}{zero}{short}", 3 if suffix else 2, 0.95))
        out.append((code, f"gnu {word}general public license", 2, 0.9))
        out.append((code, f"(?:gnu )?{code}", 1, 0.6))
    for label, title, versions in (("apache", "apache(?: software)? licen[cs]e", ("1.0", "1.1", "2.0")), ("mpl", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0")), ("epl", "eclipse public licen[cs]e", ("1.0", "2.0")), ("cddl", "common development and distribution licen[cs]e", ("1.0", "1.1")), ("npl", "netscape public licen[cs]e", ("1.0", "1.1")), ("lppl", "latex project public licen[cs]e", ("1.0", "1.2", "1.3"))):
        for version in versions:
            v = version.replace(".", " ")
            out.append((f"{label}-{version}", f"{title}(?: v(?:ersion)?)? ?{v}", 3, 1.0))
            out.append((f"{label}-{version}", f"spdx license identifier {label} {v}", 3, 1.0))
            out.append((f"{label}-{version}", f"licen[cs]es? (?:licen[cs]e )?{label} {v}", 2, 0.9))
        out.append((label, title, 2, 0.9))
        out.append((label, f"licen[cs]ed under (?:the )?{title}", 2, 0.95))
    for n, word in enumerate(("zero", "one", "two", "three", "four")):
        out.append((f"bsd-{n}-clause", f"bsd {n} clause", 3, 1.0))
        out.append((f"bsd-{n}-clause", f"(?:{word}|{n}) clause bsd", 3, 1.0))
    return out


#: words that tell little: another one of the expression is preferred as its keyword
FREQUENT = frozenset(("", "only", "later", "with", "this", "that"))
_PART = re.compile(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]\??|\\d\??|[^()\[\\?]\?|[^()\[\\?]")


def keyword(expression: str) -> str:
    """The longest word, or beginning of a word, that stands in every text the expression matches."""
    best, word, opened = "", "", True
    weight = lambda w: (w not in FREQUENT, len(w))
    for m in [*_PART.findall(expression), " "]:
        if m == " ":
            best, word, opened = max(best, word, key=weight), "", True
        elif len(m) == 1 and opened:
            word += m
        else:  # what follows an optional or a choice is no beginning; a group that ends with a space begins anew
            best, word = max(best, word, key=weight), ""
            opened = m[0] == "(" and bool(re.fullmatch(r"\(\?:(?:[^()|]|\([^()]*\))* (?:\|(?:[^()|]|\([^()]*\))* )*\)\??", m)) and opened
    return best


def rules() -> list[Rule]:
    """All rules in order, the base phrases first; earlier ones win ties."""
    own = [(label, phrase, 1, 0.8) for phrase, label in BASE.items()]
    return [(label, keyword(rx), rx, level, score) for label, rx, level, score in [*own, *written_rules(), *family_rules()]]


def gate(words: list[str]) -> str:
    """An expression that finds a space and any of the words, with the words' common beginnings tried once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    return " (?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in heads.items()) + ")"
