"""Signature rules of the license scan: label; priority; keywords; regular expression.

Expressions run over a text's lower-cased words joined by single spaces, punctuation gone ("Version 2.0" is
"version 2 0"), and match whole words. A rule is only tried in texts that hold one of its keywords (`a|b`),
as every match does. Priorities: 90 an identifier or a grant that names license and version, 70 a grant
without version, 50 a title or characteristic clause, 30 a bare mention, 20 a generic notice.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


TABLE = """
apache-2.0;90;apache;(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?license,? (?:version |v ?)?2(?: 0)?
apache-2.0;90;apache;spdx license identifier apache 2 0
apache-2.0;90;apache;apache org licenses license 2 0(?: txt| html)?
apache-2.0;50;apache;apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache-2.0;50;apache;apache 2(?: 0)? licen[sc]ed?
apache-2.0;50;asl|asl2;asl ?2(?: 0)?
apache-1.1;90;apache;apache (?:software )?license (?:version |v ?)?1 1
apache-1.1;90;apache;spdx license identifier apache 1 1
apache-1.0;90;apache;apache (?:software )?license (?:version |v ?)?1 0
apache-1.1;50;apache;this product includes software developed by the apache software foundation
apache;30;apache;(?:the )?apache (?:software )?license
mit;90;mit;spdx license identifier mit
mit;90;mit;(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: x11)? licen[sc]e
mit;70;mit;opensource org licenses mit(?: license)?(?: php)?
mit;50;permission;permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit;50;substantial;the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit;30;mit;mit licen[sc]ed?
mit-0;90;mit;spdx license identifier mit 0
mit-0;50;mit;mit no attribution
x11;90;x11;spdx license identifier x11
x11;50;x11;x11 licen[sc]e
expat;50;expat;expat licen[sc]e
isc;90;isc;spdx license identifier isc
isc;70;isc;(?:licensed|released|distributed) under (?:the )?isc licen[sc]e
isc;50;permission;permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc;30;isc;isc licen[sc]e
0bsd;90;0bsd;spdx license identifier 0bsd
0bsd;50;0bsd;0bsd licen[sc]e
0bsd;50;bsd;zero clause bsd
bsd-2-clause;90;bsd;spdx license identifier bsd 2 clause
bsd-2-clause;70;bsd;(?:licensed|released|distributed) under (?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[sc]e
bsd-2-clause;50;bsd|freebsd;(?:simplified bsd|2 clause bsd|bsd 2 clause|freebsd) licen[sc]e
bsd-3-clause;90;bsd;spdx license identifier bsd 3 clause
bsd-3-clause;70;bsd;(?:licensed|released|distributed) under (?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
bsd-3-clause;50;bsd;(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause) licen[sc]e
bsd-3-clause;50;endorse;neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause;90;bsd;spdx license identifier bsd 4 clause
bsd-4-clause;50;advertising;all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause;50;bsd;(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e
bsd;50;redistribution;redistribution and use in source and binary forms with or without modification are permitted
bsd;70;bsd;(?:licensed|released|distributed) under (?:the )?(?:a )?bsd (?:style )?licen[sc]e
bsd;30;bsd;bsd (?:style )?licen[sc]ed?
gpl-1.0;90;gpl;spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0;90;gpl;spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later;90;gpl;spdx license identifier gpl 2 0 or later
gpl-3.0;90;gpl;spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later;90;gpl;spdx license identifier gpl 3 0 or later
gpl-1.0;90;gnu;gnu general public license (?:as published by the free software foundation )?(?:either )?version 1(?! \\d\\d)
gpl-2.0;90;gnu;gnu general public license (?:as published by the free software foundation )?version 2(?: 0)?
gpl-3.0;90;gnu;gnu general public license (?:as published by the free software foundation )?version 3(?: 0)?
gpl-2.0-or-later;90;gnu;gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later;90;gnu;gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0;90;gnu;(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public licen[sc]e,? (?:version |v ?)3(?: 0)?
gpl-2.0;90;gnu;(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public licen[sc]e,? (?:version |v ?)2(?: 0)?
gpl-2.0;70;gpl|gplv|gplv2;gpl ?v ?2(?: 0)?
gpl-3.0;70;gpl|gplv|gplv3;gpl ?v ?3(?: 0)?
gpl-2.0;70;gplv2;gplv2
gpl-2.0-or-later;70;gplv2;gplv2 or later
gpl-3.0;70;gplv3;gplv3
gpl-3.0-or-later;70;gplv3;gplv3 or later
gpl-2.0;70;gpl;gpl (?:version )?2(?: 0)?
gpl-3.0;70;gpl;gpl (?:version )?3(?: 0)?
gpl;70;gnu;(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public licen[sc]e
gpl;50;gnu;gnu org licenses gpl(?: \\d 0)?(?: html| txt)?
gpl;50;gnu;see the gnu general public license for more details
gpl;50;gnu;you should have received a copy of the gnu general public license
gpl;30;gnu;gnu general public licen[sc]e
gpl;30;gpl;gnu gpl
lgpl-2.0;90;lgpl;spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1;90;lgpl;spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later;90;lgpl;spdx license identifier lgpl 2 1 or later
lgpl-3.0;90;lgpl;spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1;90;lesser;gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1
lgpl-3.0;90;lesser;gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3
lgpl-2.0;90;library;gnu library general public license (?:as published by the free software foundation )?(?:either )?version 2
lgpl-2.1;70;lgpl;lgpl (?:version |v ?)?2 1
lgpl-3.0;70;lgpl;lgpl (?:version |v ?)?3(?: 0)?
lgpl-3.0;70;lgplv3;lgplv3
lgpl-2.1;70;lgplv2;lgplv2(?: 1)?
lgpl;50;lesser;gnu lesser general public licen[sc]e
lgpl;50;library;gnu library general public licen[sc]e
lgpl;30;lgpl;gnu lgpl
agpl-3.0;90;agpl;spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0;90;affero;gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3
agpl-1.0;90;affero;affero general public license (?:version |v ?)1
agpl-3.0;70;agpl;agpl (?:version |v ?)?3(?: 0)?
agpl-3.0;70;agplv3;agplv3
agpl;50;affero;(?:gnu )?affero general public licen[sc]e
gfdl-1.1;90;documentation;gnu free documentation license version 1 1
gfdl-1.2;90;documentation;gnu free documentation license version 1 2
gfdl-1.3;90;documentation;gnu free documentation license version 1 3
gfdl;50;documentation;gnu free documentation licen[sc]e
gfdl;90;gfdl;spdx license identifier gfdl 1 [123](?: only| or later)?
mpl-1.0;90;mozilla;mozilla public license (?:version |v ?)?1 0
mpl-1.1;90;mozilla;mozilla public license (?:version |v ?)?1 1
mpl-2.0;90;mozilla;mozilla public license (?:version |v ?)?2 0
mpl-2.0;90;mpl;spdx license identifier mpl 2 0
mpl-1.1;90;mpl;spdx license identifier mpl 1 1
mpl-2.0;70;mpl;mpl (?:version |v ?)?2(?: 0)?
mpl-1.1;70;mpl;mpl (?:version |v ?)?1 1
mpl-2.0;50;mozilla;this source code form is subject to the terms of the mozilla public license v 2 0
mpl;50;mozilla;mozilla public licen[sc]e
mpl;50;mozilla;mozilla org mpl
epl-1.0;90;eclipse;eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0;90;eclipse;eclipse public license (?:version |v ?)?2(?: 0)?
epl-1.0;90;epl;spdx license identifier epl 1 0
epl-2.0;90;epl;spdx license identifier epl 2 0
epl;50;eclipse;eclipse public licen[sc]e
edl-1.0;90;eclipse;eclipse distribution license (?:version |v ?)?1(?: 0)?
cddl-1.0;90;cddl;cddl (?:version |v ?)?1 0
cddl-1.1;90;cddl;cddl (?:version |v ?)?1 1
cddl-1.0;90;distribution;common development and distribution license (?:version |v ?)?1 0
cddl-1.1;90;distribution;common development and distribution license (?:version |v ?)?1 1
cddl;50;distribution;common development and distribution licen[sc]e
cpl-1.0;90;common;common public license (?:version |v ?)?1(?: 0)?
cpl;50;common;common public licen[sc]e
ipl-1.0;50;ibm;ibm public licen[sc]e(?: version 1(?: 0)?)?
eupl-1.1;90;eupl;eupl (?:version |v ?)?1 1
eupl-1.2;90;eupl;eupl (?:version |v ?)?1 2
eupl;50;european;european union public licen[sc]e
cecill-1.0;90;cecill;cecill (?:version |v ?)?1(?: 0)?
cecill-2.0;90;cecill;cecill (?:version |v ?)?2(?: 0)?
cecill-2.1;90;cecill;cecill (?:version |v ?)?2 1
cecill-b;90;cecill;cecill b
cecill-c;90;cecill;cecill c
cecill;50;cecill;cecill(?: licen[sc]e)?
artistic-1.0;90;artistic;artistic license (?:version |v ?)?1(?: 0)?
artistic-2.0;90;artistic;artistic license (?:version |v ?)?2(?: 0)?
artistic-2.0;90;artistic;spdx license identifier artistic 2 0
artistic;50;artistic;artistic licen[sc]e
artistic;50;perl;same terms as perl itself
bsl-1.0;90;boost;boost software license(?: version| v)? 1(?: 0)?
bsl-1.0;90;bsl;spdx license identifier bsl 1 0
bsl;50;boost;boost software licen[sc]e
busl-1.1;90;business;business source license (?:version |v ?)?1 1
busl;50;business;business source licen[sc]e
unlicense;90;unlicense;spdx license identifier unlicense
unlicense;50;unencumbered;this is free and unencumbered software released into the public domain
unlicense;50;unlicense;(?:the )?unlicense
wtfpl;90;wtfpl;spdx license identifier wtfpl
wtfpl;50;fuck;do what the fuck you want to public license
wtfpl;50;wtfpl;wtfpl(?: licen[sc]e)?
zlib;90;zlib;spdx license identifier zlib
zlib;50;zlib;zlib(?: libpng)? licen[sc]e
zlib;50;misrepresented;the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng;50;libpng;libpng licen[sc]e
bzip2;50;bzip2;bzip2(?: libbzip2)? licen[sc]e
openssl;50;openssl;openssl licen[sc]e
openssl;50;openssl;this product includes software developed by the openssl project
ssleay;50;eric;this product includes cryptographic software written by eric young
curl;50;curl;curl licen[sc]e
python-2.0;90;python|psf;spdx license identifier (?:psf|python) 2 0
python-2.0;50;python;python software foundation licen[sc]e(?: version 2)?
cnri-python;50;cnri;cnri (?:open source )?(?:python )?licen[sc]e
ruby;50;ruby;ruby licen[sc]e
php-3.01;90;php;php license (?:version |v ?)?3 01
php-3.0;90;php;php license (?:version |v ?)?3 0
php;50;php;php licen[sc]e
postgresql;50;postgresql;postgresql licen[sc]e
tcl;50;tcl;tcl(?: tk)? licen[sc]e
vim;50;vim;vim licen[sc]e
w3c;50;w3c;w3c software (?:notice and )?licen[sc]e
ncsa;50;ncsa;(?:university of illinois )?ncsa open source licen[sc]e
ncsa;90;ncsa;spdx license identifier ncsa
afl-2.1;90;academic;academic free license (?:version |v ?)?2 1
afl-3.0;90;academic;academic free license (?:version |v ?)?3 0
afl;50;academic;academic free licen[sc]e
osl-3.0;90;open;open software license (?:version |v ?)?3 0
osl-2.1;90;open;open software license (?:version |v ?)?2 1
osl;50;open;open software licen[sc]e
ms-pl;50;microsoft;microsoft public licen[sc]e
ms-rl;50;microsoft;microsoft reciprocal licen[sc]e
ms-pl;90;ms;spdx license identifier ms pl
ms-rl;90;ms;spdx license identifier ms rl
apsl-2.0;90;apple;apple public source license (?:version |v ?)?2(?: 0)?
apsl;50;apple;apple public source licen[sc]e
qpl-1.0;50;q;q public licen[sc]e(?: version 1(?: 0)?)?
sissl;50;sun;sun industry standards source licen[sc]e
spl-1.0;50;sun;sun public licen[sc]e(?: version 1(?: 0)?)?
npl-1.1;50;netscape;netscape public licen[sc]e(?: version 1 [01])?
lppl-1.3c;90;latex;latex project public license (?:version |v ?)?1 3c?
lppl;50;latex;latex project public licen[sc]e
ofl-1.1;90;sil;sil open font license (?:version |v ?)?1 1
ofl-1.0;90;sil;sil open font license (?:version |v ?)?1 0
ofl;50;font;(?:sil )?open font licen[sc]e
ofl-1.1;90;ofl;spdx license identifier ofl 1 1
odbl-1.0;90;odbl;spdx license identifier odbl 1 0
odbl-1.0;50;database;open database licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?
odc-by-1.0;50;commons;open data commons attribution licen[sc]e
pddl-1.0;50;commons;open data commons public domain dedication and licen[sc]e
ecl-2.0;50;educational;educational community licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?
upl-1.0;50;universal;universal permissive licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?
mulanpsl-2.0;50;mulan;mulan permissive software licen[sc]e(?: (?:version |v ?)?2)?
sspl-1.0;90;sspl|sspl1|ssplv|ssplv1|ssplversion;sspl ?(?:version |v ?)?1(?: 0)?
sspl-1.0;50;server;server side public licen[sc]e(?: version 1)?
elastic-2.0;50;elastic;elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?
commons-clause;50;clause;commons clause(?: license)?(?: condition)?
jsonlicense;50;evil;the software shall be used for good not evil
beerware;50;beer|beerware;beer ?ware licen[sc]e
beerware;50;beer;you can buy me a beer in return
cc0-1.0;90;cc0;spdx license identifier cc0 1 0
cc0-1.0;70;cc0;cc0(?: 1 0)?(?: universal)?
cc0-1.0;50;commons;creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?
cc-pdm-1.0;50;mark;public domain mark(?: 1 0)?
cc-by-1.0;90;cc;cc by 1 0
cc-by-2.0;90;cc;cc by 2 0
cc-by-2.5;90;cc;cc by 2 5
cc-by-3.0;90;cc;cc by 3 0
cc-by-4.0;90;cc;cc by 4 0
cc-by-sa-2.0;90;cc;cc by sa 2 0
cc-by-sa-2.5;90;cc;cc by sa 2 5
cc-by-sa-3.0;90;cc;cc by sa 3 0
cc-by-sa-4.0;90;cc;cc by sa 4 0
cc-by-nd-3.0;90;cc;cc by nd 3 0
cc-by-nd-4.0;90;cc;cc by nd 4 0
cc-by-nc-2.0;90;cc;cc by nc 2 0
cc-by-nc-2.5;90;cc;cc by nc 2 5
cc-by-nc-3.0;90;cc;cc by nc 3 0
cc-by-nc-4.0;90;cc;cc by nc 4 0
cc-by-nc-sa-2.0;90;cc;cc by nc sa 2 0
cc-by-nc-sa-3.0;90;cc;cc by nc sa 3 0
cc-by-nc-sa-4.0;90;cc;cc by nc sa 4 0
cc-by-nc-nd-2.5;90;cc;cc by nc nd 2 5
cc-by-nc-nd-3.0;90;cc;cc by nc nd 3 0
cc-by-nc-nd-4.0;90;cc;cc by nc nd 4 0
cc-by-nc-4.0;90;cc;licensed under cc by nc 4 0
cc-by-nc;50;cc;cc by nc
cc-by-nc-nd;50;cc;cc by nc nd
cc-by-nc-sa;50;cc;cc by nc sa
cc-by-nd;50;cc;cc by nd
cc-by-sa;50;cc;cc by sa
cc-by;30;cc;cc by
cc-by-4.0;90;commons;creative commons attribution 4 0(?: international)?
cc-by-3.0;90;commons;creative commons attribution 3 0(?: unported)?
cc-by-2.0;90;commons;creative commons attribution 2 0(?: generic)?
cc-by-sa-4.0;90;commons;creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0;90;commons;creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-4.0;90;commons;creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-3.0;90;commons;creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nc-sa-4.0;90;commons;creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-4.0;90;commons;creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?
cc-by-nd-4.0;90;commons;creative commons attribution no ?deriv(?:ative)?s? 4 0(?: international)?
cc;30;commons;creative commons(?: attribution)?(?: licen[sc]e)?
cc;50;creativecommons;creativecommons org licenses (?:by|nc|nd|sa| )+\\d \\d
cc0-1.0;50;creativecommons;creativecommons org publicdomain zero 1 0
public-domain;50;domain;(?:released|dedicated|placed|committed) (?:in)?to the public domain
public-domain;30;domain;(?:this (?:work|file|code) is )?in the public domain
proprietary;50;confidential;(?:proprietary and confidential|confidential and proprietary)
proprietary;50;unauthorized;unauthorized copying of this file via any medium is strictly prohibited
proprietary;50;reserved;all rights reserved
proprietary;30;proprietary;proprietary licen[sc]e
proprietary;50;agreement;end user licen[sc]e agreement
proprietary;30;eula;eula
copyright;20;copyright;copyright (?:c )?(?:\\d{4}(?: \\d{4})? )?(?:by )?[^ ]+
copyright;20;copyrighted;copyrighted (?:material|work|by [^ ]+)
copyright;20;spdxfilecopyrighttext;spdxfilecopyrighttext \\d{4}
generic;20;license;licensed under (?:the )?(?:terms of )?(?:[^ ]+ ){1,6}license
generic;20;licence;licensed under (?:the )?(?:terms of )?(?:[^ ]+ ){1,6}licence
generic;20;license;released under (?:the )?(?:[^ ]+ ){1,6}license
generic;20;license;see (?:the )?license (?:file )?for (?:more )?details
generic;20;license|licensing;(?:license|licensing) (?:terms|information|agreement)
generic;20;license;spdx license identifier [^ ]+
""".strip()


def compiled(table: str = TABLE) -> list[Rule]:
    rules = []
    for line in table.split("\n"):
        label, priority, keywords, pattern = line.split(";", 3)
        rules.append(Rule(label, int(priority), tuple(keywords.encode().split(b"|")), re.compile(f"(?<![^ ])(?:{pattern.replace(chr(92) * 2, chr(92))})(?![^ ])".encode())))
    return rules


RULES = compiled()
