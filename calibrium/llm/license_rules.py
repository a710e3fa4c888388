"""Signature rules for licence notices.

One rule a line: label | priority | keyword | expression. Priority 1 is a full notice, 2 a name with its version or
family, 3 a hint. The keyword is part of every text the expression can match; it gates the rule. Expressions are written for normalised text: words in
lower case, each between single blanks, punctuation gone ("Apache-2.0" is "apache 2 0"). Order is precedence.
"""

from __future__ import annotations

HAND_WRITTEN = r"""
apache-2.0 | 1 | apache | licensed under the apache license version 2( 0)?
apache-2.0 | 1 | apache | apache license version 2 0( january 2004)?
apache-2.0 | 1 | apache | www apache org licenses license 2 0( html| txt)?
apache-2.0 | 1 | license | you may not use this file except in compliance with the license
apache-2.0 | 2 | apache | apache (software )?licen[cs]e,? ?(v ?|version )?2( 0)?
apache-2.0 | 2 | apache | apache ?2( 0)? licen[cs]ed?
apache-1.1 | 1 | apache | apache (software )?license version 1 1
apache-1.0 | 1 | apache | apache (software )?license version 1 0
apache-1.1 | 1 | apache | this product includes software developed by the apache software foundation
apache | 3 | apache | (under|by) the apache licen[cs]e
apache | 3 | apache | apache (software )?licen[cs]ed?
mit | 1 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 1 | without warranty | the software is provided as is without warranty of any kind express or implied
mit | 1 | mit | (released|licensed|distributed|available|published) under (the |an )?(terms of the )?mit( x11)? licen[cs]e
mit | 1 | opensource | opensource org licenses mit( license)?( php| html)?
mit | 2 | mit | the mit licen[cs]e( mit)?
mit | 2 | mit | mit x11 licen[cs]e
mit | 2 | mit | mit (style )?licen[cs]ed?
mit-0 | 1 | attribution | mit no attribution( licen[cs]e)?
x11 | 2 | x11 | x11 (style )?licen[cs]e
x11 | 2 | consortium | x consortium licen[cs]e
isc | 1 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 2 | isc | (the )?isc licen[cs]ed?
isc | 2 | internet | internet (systems|software) consortium licen[cs]e
0bsd | 2 | bsd | (zero clause|0) ?bsd( licen[cs]e)?
bsd-2-clause | 1 | bsd | (simplified|freebsd) bsd licen[cs]e
bsd-2-clause | 1 | clause | (2|two) clause bsd( licen[cs]e)?
bsd-2-clause | 1 | clause | bsd (2|two) clause( licen[cs]e)?
bsd-3-clause | 1 | bsd | (new|revised|modified) bsd licen[cs]e
bsd-3-clause | 1 | clause | (3|three) clause bsd( licen[cs]e)?
bsd-3-clause | 1 | clause | bsd (3|three) clause( licen[cs]e)?
bsd-3-clause | 1 | endorse | neither the name of [^.]{1,80} may be used to endorse or promote products
bsd-4-clause | 1 | clause | (4|four) clause bsd( licen[cs]e)?
bsd-4-clause | 1 | clause | bsd (4|four) clause( licen[cs]e)?
bsd-4-clause | 1 | advertising | all advertising materials mentioning features or use of this software must display
bsd | 1 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 2 | bsd | (the |a )?bsd (style )?licen[cs]ed?
gpl-3.0 | 1 | general public | gnu general public licen[cs]e,? (as published by the free software foundation )?(either )?(version|v) ?3( 0)?( or (any )?later)?( of the licen[cs]e)?
gpl-2.0 | 1 | general public | gnu general public licen[cs]e,? (as published by the free software foundation )?(either )?(version|v) ?2( 0)?( or (any )?later)?( of the licen[cs]e)?
gpl-1.0 | 1 | general public | gnu general public licen[cs]e (version|v) ?1( 0)?
gpl-3.0 | 2 | gpl | gpl ?(v|version )?3( 0)?( or later| only)?
gpl-2.0 | 2 | gpl | gpl ?(v|version )?2( 0)?( or later| only)?
gpl-3.0 | 2 | general public | version 3 of the (gnu )?general public licen[cs]e
gpl-2.0 | 2 | general public | version 2 of the (gnu )?general public licen[cs]e
gpl | 1 | redistribute | free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | 1 | general public | you should have received a copy of the gnu general public licen[cs]e
gpl | 1 | gnu | www gnu org (licenses|copyleft) gpl( html| txt)?
gpl | 2 | general public | (gnu )?general public licen[cs]e
gpl | 2 | gpl | (gnu )?gpl licen[cs]ed?
gpl | 3 | gpl | under (the )?(gnu )?gpl
lgpl-2.1 | 1 | general public | gnu lesser general public licen[cs]e,? (version|v) ?2 1( or (any )?later)?
lgpl-3.0 | 1 | general public | gnu lesser general public licen[cs]e,? (version|v) ?3( 0)?( or (any )?later)?
lgpl-2.0 | 1 | general public | gnu library general public licen[cs]e,? (version|v) ?2( 0)?
lgpl-2.1 | 2 | lgpl | lgpl ?(v|version )?2 1( or later| only)?
lgpl-3.0 | 2 | lgpl | lgpl ?(v|version )?3( 0)?( or later| only)?
lgpl | 1 | general public | gnu (lesser|library) general public licen[cs]e
lgpl | 2 | lgpl | (gnu )?lgpl( licen[cs]ed?)?
agpl-3.0 | 1 | general public | gnu affero general public licen[cs]e,? (version|v) ?3( 0)?( or (any )?later)?
agpl-1.0 | 1 | general public | affero general public licen[cs]e,? (version|v) ?1( 0)?
agpl-3.0 | 2 | agpl | agpl ?(v|version )?3( 0)?( or later| only)?
agpl | 1 | general public | (gnu )?affero general public licen[cs]e
agpl | 2 | agpl | (gnu )?agpl( licen[cs]ed?)?
gfdl | 1 | documentation | gnu free documentation licen[cs]e( (version|v) ?1 [123])?
gfdl | 2 | gfdl | gfdl( 1 [123])?
mpl-2.0 | 1 | mozilla | mozilla public licen[cs]e,? (version |v )?2( 0)?
mpl-1.1 | 1 | mozilla | mozilla public licen[cs]e,? (version |v )?1 1
mpl-1.0 | 1 | mozilla | mozilla public licen[cs]e,? (version |v )?1 0
mpl-2.0 | 1 | mozilla | mozilla org mpl 2 0
mpl | 2 | mozilla | mozilla public licen[cs]e
mpl | 2 | mpl | mpl ?(v|version )?[12]( [01])?
epl-2.0 | 1 | eclipse | eclipse public licen[cs]e,? (version |v ?)?2( 0)?
epl-1.0 | 1 | eclipse | eclipse public licen[cs]e,? (version |v ?)?1( 0)?
epl | 2 | eclipse | eclipse (public|distribution) licen[cs]e
epl | 2 | eclipse | www eclipse org legal epl v?(10|20| 1 0| 2 0)( html)?
edl-1.0 | 1 | eclipse | eclipse distribution licen[cs]e (version |v )?1 0
cpl-1.0 | 1 | common public | common public licen[cs]e( (version|v) 1 0)?
ipl-1.0 | 1 | ibm | ibm public licen[cs]e( (version|v) 1 0)?
cddl-1.0 | 1 | common development | common development and distribution licen[cs]e( cddl)?( (version|v) 1 0)?
cddl-1.1 | 1 | common development | common development and distribution licen[cs]e( cddl)? (version|v) 1 1
cddl | 2 | cddl | cddl( licen[cs]e| 1 [01])?
eupl-1.2 | 1 | european union | european union public licen[cs]e,?( eupl)? (version |v ?)?1 2
eupl-1.1 | 1 | european union | european union public licen[cs]e,?( eupl)? (version |v ?)?1 1
eupl | 2 | european union | european union public licen[cs]e
eupl | 2 | eupl | eupl( v?1 [012])?
cc-by-nc-nd-4.0 | 1 | cc by nc nd | cc by nc nd 4 0( international)?
cc-by-nc-nd-3.0 | 1 | cc by nc nd | cc by nc nd 3 0( unported)?
cc-by-nc-nd | 2 | cc by nc nd | cc by nc nd
cc-by-nc-sa-4.0 | 1 | cc by nc sa | cc by nc sa 4 0( international)?
cc-by-nc-sa-3.0 | 1 | cc by nc sa | cc by nc sa 3 0( unported)?
cc-by-nc-sa | 2 | cc by nc sa | cc by nc sa
cc-by-nc-4.0 | 1 | cc by nc | cc by nc 4 0( international)?
cc-by-nc-3.0 | 1 | cc by nc | cc by nc 3 0( unported)?
cc-by-nc | 2 | cc by nc | cc by nc
cc-by-nd-4.0 | 1 | cc by nd | cc by nd 4 0( international)?
cc-by-nd | 2 | cc by nd | cc by nd( 3 0)?
cc-by-sa-4.0 | 1 | cc by sa | cc by sa 4 0( international)?
cc-by-sa-3.0 | 1 | cc by sa | cc by sa 3 0( unported)?
cc-by-sa | 2 | cc by sa | cc by sa
cc-by-4.0 | 1 | cc by | cc by 4 0( international)?
cc-by-3.0 | 1 | cc by | cc by 3 0( unported)?
cc-by-2.0 | 1 | cc by | cc by 2 [05]( generic)?
cc-by | 2 | cc by | cc by( licen[cs]ed?)?
cc-by-nc-nd | 1 | creative commons | creative commons attribution non ?commercial no ?deriv(s|atives)?( works)?( [1234] [05])?
cc-by-nc-sa | 1 | creative commons | creative commons attribution non ?commercial share ?alike( [1234] [05])?
cc-by-nc | 1 | creative commons | creative commons attribution non ?commercial( [1234] [05])?
cc-by-nd | 1 | creative commons | creative commons attribution no ?deriv(s|atives)?( [1234] [05])?
cc-by-sa | 1 | creative commons | creative commons attribution share ?alike( [1234] [05])?
cc-by | 1 | creative commons | creative commons attribution( [1234] [05])?( international| unported| generic)?( public)? licen[cs]e
cc-by | 2 | creative commons | creative commons attribution
cc-by-nc-nd | 1 | creativecommons | creativecommons org licenses by nc nd [1234] [05]
cc-by-nc-sa | 1 | creativecommons | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc | 1 | creativecommons | creativecommons org licenses by nc [1234] [05]
cc-by-nd | 1 | creativecommons | creativecommons org licenses by nd [1234] [05]
cc-by-sa | 1 | creativecommons | creativecommons org licenses by sa [1234] [05]
cc-by | 1 | creativecommons | creativecommons org licenses by [1234] [05]
cc0-1.0 | 1 | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | 1 | cc0 | cc0( 1 0)?( universal)?( public domain dedication)?
cc0-1.0 | 1 | creative commons | creative commons zero( v?1 0)?( universal)?
cc-pdm | 1 | creativecommons | creativecommons org publicdomain mark 1 0
creative-commons | 3 | creative commons | (under )?(a |the )?creative commons licen[cs]e
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (the )?unlicense( org)?
public-domain | 1 | domain | (released|dedicated|placed|put) (in|into|to|under) the public domain
public-domain | 2 | domain | (is|are) in the public domain
public-domain | 3 | domain | public domain dedication
wtfpl | 1 | want to | do what the (fuck|f) you want to public licen[cs]e
wtfpl | 2 | wtfpl | wtfpl( licen[cs]e)?
zlib | 1 | zlib | (the )?zlib( libpng)? licen[cs]ed?
zlib | 1 | warrant | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 1 | libpng | (the )?libpng licen[cs]e( (version )?2( 0)?)?
bsl-1.0 | 1 | boost | boost software licen[cs]e( (version |v )?1 0)?
bsl-1.0 | 1 | boost | www boost org license 1 0 txt
busl-1.1 | 1 | business source | business source licen[cs]e( (version |v )?1 [01])?
sspl-1.0 | 1 | server side | server side public licen[cs]e( (version |v )?1( 0)?)?
elastic-2.0 | 1 | elastic | elastic licen[cs]e( (version |v )?2( 0)?)?
commons-clause | 1 | commons clause | commons clause( licen[cs]e)?( condition)?( (v|version )1 0)?
artistic-2.0 | 1 | artistic | artistic licen[cs]e (version |v )?2( 0)?
artistic-1.0 | 1 | artistic | artistic licen[cs]e (version |v )?1( 0)?
artistic | 2 | artistic | (perl )?artistic licen[cs]e
perl | 1 | perl | (under )?the same terms as perl( itself)?
python-2.0 | 1 | python | python software foundation licen[cs]e( version 2)?
python-2.0 | 2 | python | python licen[cs]e( 2 0)?
php-3.01 | 1 | php | (the )?php licen[cs]e( (version |v )?3 01?)?
ruby | 2 | ruby | (the )?ruby licen[cs]e
ofl-1.1 | 1 | open font | (sil )?open font licen[cs]e( (version |v )?1 1)?
ofl-1.1 | 2 | ofl | (sil )?ofl 1 1
odbl-1.0 | 1 | database | open (data commons open )?database licen[cs]e( odbl)?( (v|version) ?1 0)?
odbl-1.0 | 2 | odbl | odbl( 1 0)?
odc-by-1.0 | 1 | open data commons | open data commons attribution licen[cs]e( (v|version) ?1 0)?
odc-by-1.0 | 2 | odc by | odc by( 1 0)?
pddl-1.0 | 1 | public domain | (open data commons )?public domain dedication and licen[cs]e( pddl)?( (v|version) ?1 0)?
cdla-permissive | 1 | community data | community data licen[cs]e agreement permissive( (version |v )?[12] 0)?
cdla-sharing | 1 | community data | community data licen[cs]e agreement sharing( (version |v )?1 0)?
ogl-uk-3.0 | 1 | open government | open government licen[cs]e( v ?3( 0)?)?
etalab-2.0 | 1 | licence | (etalab )?(licence ouverte|open licence) (etalab |version )?2 0
etalab | 2 | licence ouverte | licence ouverte
cecill-2.1 | 1 | cecill | cecill( free software)?( licen[cs]e)?( agreement)?( (v|version) ?2 1)
cecill | 2 | cecill | (licence )?cecill( [bc])?( licen[cs]e)?
ms-pl | 1 | microsoft | microsoft public licen[cs]e( ms pl)?
ms-rl | 1 | microsoft | microsoft reciprocal licen[cs]e( ms rl)?
openrail | 1 | rail | (bigscience |creativeml |bigcode )?(open ?)?rail (m |s |plus |\+\+ )?licen[cs]e
openrail | 2 | openrail | openrail( m)?( licen[cs]e)?
llama-community | 1 | llama | llama ?[234]?( [0-9])? community licen[cs]e( agreement)?
gemma-terms | 1 | gemma | gemma terms of use
ncsa | 1 | ncsa | (university of illinois )?(ncsa )?open source licen[cs]e ncsa
ncsa | 2 | ncsa | ncsa (open source )?licen[cs]e
postgresql | 1 | postgresql | (the )?postgresql licen[cs]e
openssl | 1 | openssl | openssl( and ssleay)? licen[cs]e
openssl | 1 | openssl | this product includes software developed by the openssl project
w3c | 1 | w3c | w3c software( and document)?( notice and)? licen[cs]e
unicode-dfs | 1 | unicode | unicode (inc )?licen[cs]e agreement( data files and software)?
vim | 1 | vim | (the )?vim licen[cs]e
curl | 1 | curl | (the )?curl licen[cs]e
ijg | 1 | jpeg | independent jpeg group( s)?( software)?
freetype | 1 | freetype | (the )?freetype (project )?licen[cs]e
beerware | 1 | beer | beer ?ware licen[cs]e
json | 1 | evil | the software shall be used for good not evil
osl-3.0 | 1 | open software | open software licen[cs]e( (version |v ?)?3( 0)?)?
afl-3.0 | 1 | academic free | academic free licen[cs]e( (version |v ?)?3( 0)?)?
upl-1.0 | 1 | universal permissive | universal permissive licen[cs]e( upl)?( (version |v )?1 0)?
blueoak-1.0.0 | 1 | blue oak | blue oak model licen[cs]e( 1 0 0)?
hippocratic | 1 | hippocratic | hippocratic licen[cs]e( [123] [01])?
parity | 2 | parity | parity public licen[cs]e( [0-9] 0 0)?
polyform | 1 | polyform | polyform (noncommercial|small business|strict|shield|perimeter|internal use) licen[cs]e( 1 0 0)?
oracle-bcl | 1 | oracle | oracle binary code licen[cs]e( agreement)?
eula | 2 | end user | end user licen[cs]e agreement
eula | 3 | eula | (the |this )?eula
reserved | 1 | reserved | all rights reserved
reserved | 2 | reserved | some rights reserved
reserved | 1 | vorbehalten | alle rechte vorbehalten
reserved | 1 | droits | tous droits réservés
reserved | 1 | derechos | todos los derechos reservados
proprietary | 1 | proprietary | proprietary and confidential
proprietary | 1 | proprietary | (unpublished )?proprietary (source code|software|licen[cs]e)
proprietary | 2 | unauthori | unauthori[sz]ed (copying|reproduction|distribution)( or (copying|reproduction|distribution))?( of this (file|work|document|material))? (is |in )?(strictly )?prohibited
proprietary | 2 | reproduc | may not be reproduced( or distributed| distributed)?( in any form)? without (the )?(prior |express |written )+(permission|consent)
proprietary | 2 | copied | may not be copied( or distributed| distributed)?( in any form)? without (the )?(prior |express |written )+(permission|consent)
non-commercial | 2 | commercial | (for |only for )?(non ?commercial|personal and non ?commercial) use only
non-commercial | 3 | commercial | (no|not for|non) commercial use
copyright | 2 | copyright | copyright (c )?(19|20)[0-9]{2}( (19|20)[0-9]{2})?( by)?
copyright | 3 | copyright | copyright (holder|owner|notice|c)s?
license-mention | 3 | licen | (licen[cs]ed|released|distributed|available|published|provided) under (the |a |an )?(terms of )?(the )?
license-mention | 3 | licen | (see|read) (the )?licen[cs]e( file| txt| md)?( for)?( more)?( details| information)?
license-mention | 3 | licen | licen[cs]e (agreement|terms|file|key|information)
"""

#: SPDX ids; each gives a rule for its tag and one for its name in a phrase.
SPDX_IDS = """
0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0
CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later IJG ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()


def rules() -> list[tuple[int, str, int, str, str]]:
    """(number, label, priority, keyword, expression) in order of precedence."""
    out = []
    for line in HAND_WRITTEN.strip().splitlines():
        label, priority, keyword, expression = (x.strip() for x in line.split(" | ", 3))
        out.append((label, int(priority), keyword, expression))
    for spdx in SPDX_IDS:
        words = " ".join(spdx.lower().replace("-", " ").replace(".", " ").split())
        label = spdx.lower().removesuffix("-only").removesuffix("-or-later")
        out.append((label, 1, "spdx", f"spdx license identifier {words}"))
        out.append((label, 1, "licen", f"licen[cs]e[d]?( is| under|ed under)?( the)? {words}"))
    return [(k, *rule) for k, rule in enumerate(out)]
