"""Signature rules of the licence scan.

A rule is (priority, label, keyword, regex) over a text's lower-cased words joined by single blanks. Priority 1 is a
machine-readable tag, 2 the wording of a grant, notice or clause, 3 a licence's full name or address, 4 a bare mention. Only
texts that hold the keyword as a word are matched against the rule: every match holds one of the words that the
keyword names (a/b: either; a*: any word that begins so).
"""

from __future__ import annotations

#: The phrases that every scan counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licence identifiers in use in source files, and the label each counts as.
SPDX = """
mit mit | mit-0 mit | x11 mit | apache-1.0 apache | apache-1.1 apache | apache-2.0 apache | gpl-1.0 gpl | gpl-2.0 gpl | gpl-3.0 gpl
lgpl-2.0 lgpl | lgpl-2.1 lgpl | lgpl-3.0 lgpl | agpl-1.0 agpl | agpl-3.0 agpl | bsd-1-clause bsd | bsd-2-clause bsd
bsd-3-clause bsd | bsd-4-clause bsd | 0bsd bsd | isc isc | zlib zlib | libpng-2.0 zlib | bsl-1.0 boost | mpl-1.0 mpl | mpl-1.1 mpl | mpl-2.0 mpl
epl-1.0 epl | epl-2.0 epl | cddl-1.0 cddl | cddl-1.1 cddl | cpl-1.0 cpl | eupl-1.1 eupl | eupl-1.2 eupl | artistic-1.0 artistic
artistic-2.0 artistic | unlicense unlicense | wtfpl wtfpl | cc0-1.0 cc0 | cc-by-1.0 cc-by | cc-by-2.0 cc-by | cc-by-2.5 cc-by | cc-by-3.0 cc-by
cc-by-4.0 cc-by | cc-by-sa-2.0 cc-by-sa | cc-by-sa-2.5 cc-by-sa | cc-by-sa-3.0 cc-by-sa | cc-by-sa-4.0 cc-by-sa | cc-by-nd-3.0 cc-by-nd
cc-by-nd-4.0 cc-by-nd | cc-by-nc-3.0 cc-by-nc | cc-by-nc-4.0 cc-by-nc | cc-by-nc-sa-3.0 cc-by-nc-sa | cc-by-nc-sa-4.0 cc-by-nc-sa
cc-by-nc-nd-3.0 cc-by-nc-nd | cc-by-nc-nd-4.0 cc-by-nc-nd | python-2.0 python | psf-2.0 python | php-3.0 php | php-3.01 php | ruby ruby
postgresql postgresql | openssl openssl | ofl-1.0 ofl | ofl-1.1 ofl | ms-pl ms-pl | ms-rl ms-rl | ncsa ncsa | afl-2.1 afl | afl-3.0 afl
osl-2.1 osl | osl-3.0 osl | qpl-1.0 qpl | vim vim | curl curl | unicode-dfs-2016 unicode | odbl-1.0 odbl | odc-by-1.0 odc-by | pddl-1.0 pddl
gfdl-1.1 gfdl | gfdl-1.2 gfdl | gfdl-1.3 gfdl | sspl-1.0 sspl | busl-1.1 busl | elastic-2.0 elastic | upl-1.0 upl | ecl-2.0 ecl | apsl-2.0 apsl
intel intel | hpnd hpnd | sleepycat sleepycat | tcl tcl | w3c w3c | zpl-2.1 zpl | ipl-1.0 ipl | lppl-1.3c lppl | mulanpsl-2.0 mulan | nasa-1.3 nasa
"""

#: Wordings of grants and notices: label, keyword, regex.
NOTICES = """
mit | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | mit | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit
mit | license/licence | licen[sc]e mit
isc | permission | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose
zlib | software | this software is provided as is without any express or implied warranty
zlib | altered | altered source versions must be plainly marked as such
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above copyright notice
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd | advertising | all advertising materials mentioning features or use of this software must display
bsd | bsd | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:new |modified |simplified )?bsd
apache | licensed | licensed under the apache license(?: version)? ?2 0
apache | apache | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache
apache | compliance | you may not use this file except in compliance with the license
apache | contributor | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | redistribute | free software you can redistribute it and or modify it
gpl | received | you should have received a copy of the gnu general public license
gpl | gpl* | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: ?v?[123])?
gpl | license | gnu general public license(?: as published by the free software foundation)? (?:either )?version [123](?: 0)?(?: of the license)?(?: or at your option any later version)?
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl | lgpl* | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl | received | you should have received a copy of the gnu affero general public license
agpl | agpl* | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
mpl | source | this source code form is subject to the terms of the mozilla public license
mpl | contents | the contents of this file are subject to the mozilla public license
mpl | mpl/mozilla | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla public)
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | epl/eclipse | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:epl|eclipse public)
cddl | contents | the contents of this file are subject to the terms of the common development and distribution license
boost | distributed | distributed under the boost software license version 1 0
boost | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered | this is free and unencumbered software released into the public domain
public-domain | domain | (?:placed|released|dedicated|put) (?:in|into|to) the public domain
public-domain | domain | this (?:work|file|software|code|text) is in the public domain
wtfpl | public | do what the fuck you want to public license
cc0 | waived | (?:has )?waived all copyright and related or neighboring rights
cc-by | licensed | licensed under a creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? license
cc-by-sa | licensed | licensed under a creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? license
cc-by-nc | licensed | licensed under a creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)? license
cc-by-nd | licensed | licensed under a creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)? license
cc-by-nc-sa | licensed | licensed under a creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)? license
cc-by-nc-nd | licensed | licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)? license
ofl | licensed | this font software is licensed under the sil open font license
gfdl | copy | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
python | licensed | licensed to the psf under a contributor agreement
php | product | this product includes php software freely available
openssl | product | this product includes software developed by the openssl project
ncsa | deal | permission is hereby granted free of charge .{1,120}? to deal with the software without restriction
eupl | licensed | licensed under the eupl(?: version)?
ms-pl | microsoft/ms | (?:released|licensed|distributed) under (?:the )?(?:microsoft public|ms pl)
artistic | artistic | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:perl )?artistic
perl | perl | under the same terms as perl(?: itself)?
sspl | sspl/server | (?:released|licensed|distributed|available) under (?:the )?(?:sspl|server side public)
busl | busl/bsl/business | (?:released|licensed|distributed|available) under (?:the )?(?:busl|bsl|business source)
elastic | elastic | (?:released|licensed|distributed|available) under (?:the )?elastic license
proprietary | rights | all rights reserved
proprietary | confidential | (?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use)(?: or \\S+)? of this (?:file|software|work|document)
proprietary | permission | (?:may not|must not) be (?:copied|reproduced|distributed) .{0,60}?without (?:the )?(?:prior )?(?:express )?(?:written )?permission
"""

#: Clauses by which a licence's own text is known: label, keyword, regex.
CLAUSES = """
mit | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement
mit | deal | to deal in the software without restriction including without limitation the rights to use copy modify
mit | persons | to permit persons to whom the software is furnished to do so
mit | holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability
bsd | provided | this software is provided by the (?:copyright holders and contributors|authors?|regents and contributors) as is
bsd | procurement | procurement of substitute goods or services loss of use data or profits or business interruption
bsd | university | neither the name of the university nor the names of its contributors
bsd | materials | in the documentation and or other materials provided with the distribution
bsd | regents | copyright (?:.{1,40}? )?the regents of the university of california
bsd | beerware/beer | (?:the )?beer ?ware license|buy me a beer in return
isc | disclaims | the author disclaims all warranties with regard to this software including all implied warranties
isc | disclaims | (?:isc|internet systems consortium) disclaims all warranties with regard to this software
zlib | misrepresented | the origin of this software must not be misrepresented
zlib | notice | this notice may not be removed or altered from any source distribution
boost | executable | unless such copies or derivative works are solely in the form of machine executable object code
apache | agreed | unless required by applicable law or agreed to in writing software distributed under the license
apache | warranties | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache | notice | if the work includes a notice text file as part of its distribution
apache | perpetual | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated in this section patent) license
apache | inclusion | any contribution intentionally submitted for inclusion in the work
apache | contributions | submission of contributions unless you explicitly state otherwise
gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | copyleft | (?:the gnu general public license is a free )?copyleft license for software and other kinds of works
gpl | foundation | write to the free software foundation inc (?:51|59|675) \\S+ (?:\\S+ ){0,4}(?:fifth|temple|mass)\\S*
gpl | redistribute | you may redistribute (?:it|this program) under (?:certain conditions|the terms of the gpl)
gpl | derived | you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl | corresponding | accompany it with the complete corresponding machine readable source code
gpl | conveying | conveying (?:verbatim copies|modified source versions|non source forms)
gpl | tivoization/installation | installation information for a user product
gpl | everyone | everyone is permitted to copy and distribute verbatim copies of this license document
gpl | classpath/statically | classpath exception|linking this library statically or dynamically with other modules
lgpl | library | this library is free software you can redistribute it and or modify it
lgpl | derivative | a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl | combined | a combined work is a work produced by combining or linking an application with the library
agpl | remotely | offer all users interacting with it remotely through a computer network
agpl | network | remote network interaction use with the gnu general public license
mpl | covered | covered software is provided under this license on an as is basis
mpl | incompatible | this source code form is incompatible with secondary licenses
mpl | larger | you may create and distribute a larger work under terms of your choice
mpl | basis | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language
epl | accompanying | the accompanying program is provided under the terms of this eclipse public license
epl | secondary | secondary licenses when the following conditions for such availability set forth in the eclipse public license
cddl | header | do not alter or remove copyright notices or this file header
cddl | brackets | fields enclosed by brackets (?:.{1,80}? )?replaced with your own identifying information
eupl | licence | the work is provided under the terms of this european union public licence
artistic | charge | you may charge a reasonable copying fee for any distribution of this package
artistic | package | the standard version of the package|modified version of the package
unlicense | anyone | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | heirs | for the benefit of the public at large and to the detriment of our heirs and successors
wtfpl | fuck | you just do what the fuck you want to
cc0 | affirmer/deed | (?:affirmer|the person who associated a work with this deed) (?:hereby )?(?:overtly fully permanently irrevocably and unconditionally )?(?:waives|has dedicated)
cc0 | waived | to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights
cc-by | credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
python | psf | psf is making python available to licensee on an as is basis
python | beopen/cnri | beopen com license agreement|cnri license agreement
php | php | php includes the zend engine freely available
postgresql | university | in no event shall the university of california be liable to any party for direct indirect special incidental
openssl | toolkit | software developed by the openssl project for use in the openssl toolkit
openssl | young | includes cryptographic software written by eric young
curl | daniel | copyright (?:.{1,40}? )?daniel stenberg
ofl | reserved | reserved font name
ofl | sold | the font software may be bundled redistributed and or sold with any software
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
ms-pl | contributor | each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution
w3c | permission | permission to copy modify and distribute this (?:work|software)(?: and its documentation)?(?: with or without modification)? for any purpose (?:.{1,60}? )?w3c
zpl | zope | zope corporation and contributors|zope public license
vim | vim | there are no restrictions on distributing unmodified copies of vim
unicode | unicode | unicode inc license agreement data files and software
odbl | database | made available under the open database license
pddl | dedication | public domain dedication and license
sspl | service | offering the program as a service requires making the service source code available
busl | grant/change | additional use grant (?:.{1,200}? )?production use|change date (?:.{1,80}? )?change license
elastic | hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons | (?:the )?commons clause(?: license condition)?
json | evil | the software shall be used for good not evil
hpnd | documentation | that both that copyright notice and this permission notice appear in supporting documentation
ncsa | deal | neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission (?:.{1,40}? )?deal
rail | rail/restrictions | (?:creativeml open|bigscience|responsible ai|open) rail(?: m| s)? license|use based restrictions as referenced in
llama | community | llama(?: 2| 3)? community license(?: agreement)?
"""

#: Full names: label, keyword, regex.
NAMES = """
mit | license/licence | (?:the )?(?:expat|mit x11|x11) licen[sc]e
mit | licence | (?:the )?(?:mit|expat|x11) licence
apache | apache | (?:the )?apache(?: software)? license(?: version)? ?[12] [01]
apache | licence | (?:the )?apache(?: software)? licence
apache | asl* | (?:apache )?asl ?2 0
gpl | license | (?:the )?gnu general public license
gpl | licence | (?:gnu )?general public licence
gpl | gpl* | gnu gpl(?: ?v?[123](?: 0)?)?
gpl | gpl* | gplv2\\S*
gpl | gpl* | gplv3\\S*
lgpl | license | (?:the )?(?:gnu )?(?:lesser|library) general public license
lgpl | lgpl* | (?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
lgpl | lgpl* | lgplv2\\S*
lgpl | lgpl* | lgplv3\\S*
agpl | license | (?:the )?(?:gnu )?affero general public license
agpl | agpl* | (?:gnu )?agpl(?: ?v?3(?: 0)?)?
agpl | agpl* | agplv3\\S*
bsd | license | (?:(?:two|three|four|2|3|4) clause )?(?:new |modified |revised |simplified )?(?:bsd|freebsd|netbsd)(?: (?:2|3|4) clause)? license
bsd | licence | (?:new |modified |simplified )?bsd licence
isc | license | isc license
zlib | license | (?:zlib libpng|zlib|libpng) license
boost | license | boost software license
mpl | license | mozilla public license(?: version)?(?: [12] [01])?
epl | license | eclipse (?:public|distribution) license
cddl | license | common development and distribution license
cpl | license | common public license
ipl | license | ibm public license
eupl | licence | european union public licence
artistic | license | (?:perl )?artistic license(?: [12] 0)?
unlicense | unlicense | (?:the )?unlicense
cc0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by | cc | cc by(?: [1-4] [05])?
cc-by-sa | cc | cc by sa(?: [1-4] [05])?
cc-by-nc | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | cc | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
cc-by | commons | creative commons attribution
cc-by-sa | commons | creative commons attribution share ?alike
cc-by-nc | commons | creative commons attribution non ?commercial
cc-by-nd | commons | creative commons attribution no ?deriv(?:ative)?s
python | license | python software foundation license
php | license | php license
ruby | license | ruby license
postgresql | license | postgresql license
openssl | license | openssl license
ofl | license | (?:sil )?open font license
ms-pl | license | microsoft public license
ms-rl | license | microsoft reciprocal license
ncsa | license | (?:university of illinois )?ncsa(?: open source)? license
afl | license | academic free license
osl | license | open software license
qpl | license | q public license
vim | license | vim license
odbl | license | open (?:data commons open )?database license
odc-by | license | open data commons attribution license
gfdl | license | (?:gnu )?free documentation license
sspl | license | server side public license
busl | license | business source license
elastic | license | elastic license
upl | license | universal permissive license
ecl | license | educational community license
apsl | license | apple public source license
w3c | license | w3c software (?:notice and )?license
zpl | license | zope public license
lppl | license | latex project public license
mulan | mulan | mulan (?:psl|permissive software license)
nasa | nasa | nasa open source agreement
sleepycat | license | sleepycat license
"""

#: Addresses: label, keyword, regex. Words split at dots and slashes.
ADDRESSES = """
apache | apache | (?:www )?apache org licenses license(?: 2 0)?
gpl | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl\\S*
lgpl | gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl\\S*
agpl | gnu | (?:www )?gnu org licenses agpl\\S*
gfdl | gnu | (?:www )?gnu org licenses fdl\\S*
mit | opensource | opensource org licenses mit(?: license)?
bsd | opensource | opensource org licenses bsd\\S*
apache | opensource | opensource org licenses apache 2 0
gpl | opensource | opensource org licenses gpl\\S*
isc | opensource | opensource org licenses isc(?: license)?
zlib | opensource | opensource org licenses zlib\\S*
artistic | opensource | opensource org licenses artistic\\S*
mpl | mozilla | (?:www )?mozilla org (?:en us )?mpl\\S*
epl | eclipse | (?:www )?eclipse org legal epl\\S*
boost | boost | (?:www )?boost org license
unlicense | unlicense | unlicense org
wtfpl | wtfpl | (?:www )?wtfpl net
cc0 | creativecommons | creativecommons org publicdomain zero
cc-by | creativecommons | creativecommons org licenses by(?! (?:sa|nc|nd))
cc-by-sa | creativecommons | creativecommons org licenses by sa
cc-by-nc | creativecommons | creativecommons org licenses by nc(?! (?:sa|nd))
cc-by-nd | creativecommons | creativecommons org licenses by nd
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd
ofl | sil | scripts sil org ofl
eupl | europa | joinup ec europa eu \\S+ eupl
"""


def _lines(block: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ", 2)] for line in block.strip().splitlines()]


def rules() -> list[tuple[int, str, str, str]]:
    """Every rule in order: tags, notices, names and addresses, then the base phrases."""
    found = []
    for entry in SPDX.replace("\n", " | ").split("|"):
        if entry.strip():
            name, label = entry.split()
            words = name.replace("-", " ").replace(".", " ")
            suffix = "(?: only| or later)?" if "gpl" in label or label == "gfdl" else ""
            found.append((1, label, "spdx", f"spdx license identifier {words}{suffix}"))
    found += [(2, label, keyword, regex) for label, keyword, regex in _lines(NOTICES) + _lines(CLAUSES)]
    found += [(3, label, keyword, regex) for label, keyword, regex in _lines(NAMES) + _lines(ADDRESSES)]
    found += [(4, label, phrase.split()[-1], phrase) for phrase, label in BASE]
    return [(p, label, keyword, regex.replace("\\\\", "\\")) for p, label, keyword, regex in found]


def keywords() -> list[str]:
    """The words and, with a star, the beginnings of words that the rules name."""
    return sorted({one for _, _, keyword, _ in rules() for one in keyword.split("/")})
