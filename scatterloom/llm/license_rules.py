"""Signatures of licences, in order: priority, label, regex.

A regex is matched against lower-case words joined by single spaces, from the start of a word to the end of one. It begins with
a plain word, its keyword. Priority 1 names a licence with its version or quotes its notice, 2 names the licence, 3 is a hint.
"""

from __future__ import annotations

#: Words that a match spans at most.
REACH = 32

#: Phrases that count as base places, with their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

TABLE = r"""
1 gpl-2.0 | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )2(?: 0)?(?: only)?
1 gpl-2.0+ | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )2(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?
1 gpl-3.0 | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?(?: only)?
1 gpl-3.0+ | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?
2 gpl | gnu general public licen[cs]e
2 gpl | gnu gpl
1 gpl-2.0 | gnu gpl (?:v|version )?2(?: 0)?
1 gpl-3.0 | gnu gpl (?:v|version )?3(?: 0)?
1 gpl-2.0 | gpl (?:v|version )?2(?: 0)?(?: only)?
1 gpl-2.0+ | gpl (?:v|version )?2(?: 0)? or later
1 gpl-3.0 | gpl (?:v|version )?3(?: 0)?(?: only)?
1 gpl-3.0+ | gpl (?:v|version )?3(?: 0)? or later
1 gpl-2.0 | gplv2(?: only)?
1 gpl-2.0+ | gplv2 or later
1 gpl-3.0 | gplv3(?: only)?
1 gpl-3.0+ | gplv3 or later
2 gpl | gpl licen[cs]ed?
2 gpl | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
1 lgpl-2.0 | gnu library general public licen[cs]e (?:v|version )?2(?: 0)?
1 lgpl-2.1 | gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )2 1
1 lgpl-3.0 | gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?
2 lgpl | gnu (?:lesser|library) general public licen[cs]e
2 lgpl | gnu lgpl
1 lgpl-2.1 | lgpl (?:v|version )?2 1(?: only| or later)?
1 lgpl-3.0 | lgpl (?:v|version )?3(?: 0)?(?: only| or later)?
1 lgpl-2.1 | lgplv2 1
1 lgpl-3.0 | lgplv3
2 lgpl | lgpl licen[cs]ed?
2 lgpl | lesser general public licen[cs]e
1 agpl-3.0 | gnu affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?
2 agpl | gnu affero general public licen[cs]e
2 agpl | gnu agpl
1 agpl-3.0 | agpl (?:v|version )?3(?: 0)?(?: only| or later)?
1 agpl-3.0 | agplv3
1 agpl-1.0 | affero general public licen[cs]e (?:v|version )?1(?: 0)?
2 agpl | affero general public licen[cs]e
1 gfdl-1.1 | gnu free documentation licen[cs]e (?:v|version )1 1
1 gfdl-1.2 | gnu free documentation licen[cs]e (?:v|version )1 2
1 gfdl-1.3 | gnu free documentation licen[cs]e (?:v|version )1 3
2 gfdl | gnu free documentation licen[cs]e
2 gfdl | gnu fdl
1 gfdl-1.3 | gfdl 1 3
3 copyleft | copyleft
1 apache-1.0 | apache (?:software )?licen[cs]e (?:v|version )?1 0
1 apache-1.1 | apache (?:software )?licen[cs]e (?:v|version )?1 1
1 apache-2.0 | apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
1 apache-2.0 | apache 2(?: 0)? licen[cs]ed?
1 apache-2.0 | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?(?: the license)?
2 apache | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[cs]e
2 apache | apache software licen[cs]e
2 apache | apache licen[cs]ed?
1 apache-2.0 | asl 2 0
3 apache | apache foundation licen[cs]e
1 cc-by-1.0 | cc by 1 0
1 cc-by-2.0 | cc by 2 0
1 cc-by-2.5 | cc by 2 5
1 cc-by-3.0 | cc by 3 0
1 cc-by-4.0 | cc by 4 0
1 cc-by-sa-2.0 | cc by sa 2 0
1 cc-by-sa-2.5 | cc by sa 2 5
1 cc-by-sa-3.0 | cc by sa 3 0
1 cc-by-sa-4.0 | cc by sa 4 0
1 cc-by-nc-2.0 | cc by nc 2 0
1 cc-by-nc-3.0 | cc by nc 3 0
1 cc-by-nc-4.0 | cc by nc 4 0
1 cc-by-nd-3.0 | cc by nd 3 0
1 cc-by-nd-4.0 | cc by nd 4 0
1 cc-by-nc-sa-3.0 | cc by nc sa 3 0
1 cc-by-nc-sa-4.0 | cc by nc sa 4 0
1 cc-by-nc-nd-3.0 | cc by nc nd 3 0
1 cc-by-nc-nd-4.0 | cc by nc nd 4 0
2 cc-by-sa | cc by sa
2 cc-by-nc | cc by nc
2 cc-by-nd | cc by nd
2 cc-by-nc-sa | cc by nc sa
2 cc-by-nc-nd | cc by nc nd
2 cc-by | cc by(?: licen[cs]ed?)?
1 cc0-1.0 | cc0 1 0(?: universal)?
2 cc0 | cc0
2 cc0 | cc zero
1 cc-by-3.0 | creative commons attribution 3 0(?: unported| international)?(?: licen[cs]e)?
1 cc-by-4.0 | creative commons attribution 4 0(?: international)?(?: licen[cs]e)?
2 cc-by | creative commons attribution(?: licen[cs]e)?
1 cc-by-sa-3.0 | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
1 cc-by-sa-4.0 | creative commons attribution share ?alike 4 0(?: international)?(?: licen[cs]e)?
2 cc-by-sa | creative commons attribution share ?alike(?: licen[cs]e)?
1 cc-by-nc-4.0 | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?
2 cc-by-nc | creative commons attribution non ?commercial(?: licen[cs]e)?
1 cc-by-nd-4.0 | creative commons attribution no ?deriv(?:s|atives) 4 0(?: international)?(?: licen[cs]e)?
2 cc-by-nd | creative commons attribution no ?deriv(?:s|atives|ative works)(?: licen[cs]e)?
1 cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?
2 cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
1 cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0(?: international)?(?: licen[cs]e)?
2 cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: licen[cs]e)?
2 cc0 | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
2 cc0 | creative commons public domain dedication
3 cc | creative commons(?: licen[cs]ed?)?
3 cc | creativecommons org licenses
1 cc-by-4.0 | creativecommons org licenses by 4 0
1 cc-by-3.0 | creativecommons org licenses by 3 0
1 cc-by-sa-4.0 | creativecommons org licenses by sa 4 0
1 cc-by-sa-3.0 | creativecommons org licenses by sa 3 0
1 cc-by-nc-4.0 | creativecommons org licenses by nc 4 0
1 cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0
1 cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0
1 cc0-1.0 | creativecommons org publicdomain zero 1 0
2 mit | mit licen[cs]ed?
2 mit | mit style licen[cs]e
2 mit | mit expat(?: licen[cs]e)?
1 mit-0 | mit no attribution(?: licen[cs]e)?
1 mit-0 | mit 0(?: licen[cs]e)?
2 mit | expat licen[cs]e
2 mit | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
2 mit | released under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
2 mit | distributed under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
1 mit | permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
1 isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 x11 | x11 licen[cs]e
1 bsd-0-clause | 0bsd
1 bsd-1-clause | bsd 1 clause(?: licen[cs]e)?
1 bsd-2-clause | bsd 2 clause(?: licen[cs]e)?
1 bsd-3-clause | bsd 3 clause(?: licen[cs]e)?
1 bsd-4-clause | bsd 4 clause(?: licen[cs]e)?
2 bsd | bsd licen[cs]ed?
2 bsd | bsd style licen[cs]e
1 bsd-2-clause | simplified bsd licen[cs]e
1 bsd-2-clause | freebsd licen[cs]e
1 bsd-3-clause | new bsd licen[cs]e
1 bsd-3-clause | modified bsd licen[cs]e
1 bsd-3-clause | revised bsd licen[cs]e
1 bsd-4-clause | original bsd licen[cs]e
2 bsd | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?bsd licen[cs]e
1 bsd | redistribution and use in source and binary forms with or without modification are permitted provided that
1 bsd-2-clause | two clause bsd(?: licen[cs]e)?
1 bsd-3-clause | three clause bsd(?: licen[cs]e)?
2 isc | isc licen[cs]ed?
1 mpl-1.0 | mozilla public licen[cs]e (?:v|version )?1 0
1 mpl-1.1 | mozilla public licen[cs]e (?:v|version )?1 1
1 mpl-2.0 | mozilla public licen[cs]e (?:v|version )?2(?: 0)?
2 mpl | mozilla public licen[cs]e
1 mpl-1.1 | mpl (?:v|version )?1 1
1 mpl-2.0 | mpl (?:v|version )?2(?: 0)?
1 epl-1.0 | eclipse public licen[cs]e (?:v|version )?1(?: 0)?
1 epl-2.0 | eclipse public licen[cs]e (?:v|version )?2(?: 0)?
2 epl | eclipse public licen[cs]e
1 epl-1.0 | epl (?:v|version )?1 0
1 epl-2.0 | epl (?:v|version )?2 0
1 edl-1.0 | eclipse distribution licen[cs]e(?: (?:v|version )?1(?: 0)?)?
1 eupl-1.1 | european union public licen[cs]e (?:v|version )?1 1
1 eupl-1.2 | european union public licen[cs]e (?:v|version )?1 2
2 eupl | european union public licen[cs]e
1 eupl-1.2 | eupl (?:v|version )?1 2
1 cddl-1.0 | common development and distribution licen[cs]e (?:v|version )?1 0
1 cddl-1.1 | common development and distribution licen[cs]e (?:v|version )?1 1
2 cddl | common development and distribution licen[cs]e
1 cddl-1.0 | cddl (?:v|version )?1 0
1 cpl-1.0 | common public licen[cs]e (?:v|version )?1 0
2 cpl | common public licen[cs]e
1 cpal-1.0 | common public attribution licen[cs]e(?: (?:v|version )?1 0)?
1 artistic-1.0 | artistic licen[cs]e (?:v|version )?1(?: 0)?
1 artistic-2.0 | artistic licen[cs]e (?:v|version )?2(?: 0)?
2 artistic | artistic licen[cs]e
2 perl | perl artistic licen[cs]e
1 bsl-1.0 | boost software licen[cs]e (?:v|version )?1(?: 0)?
2 bsl | boost software licen[cs]e
1 bsl-1.1 | business source licen[cs]e (?:v|version )?1 1
2 busl | business source licen[cs]e
1 sspl-1.0 | server side public licen[cs]e(?: (?:v|version )?1)?
1 elastic-2.0 | elastic licen[cs]e (?:v|version )?2(?: 0)?
2 elastic | elastic licen[cs]e
2 unlicense | unlicense
1 unlicense | unlicense org
1 unlicense | free and unencumbered software released into the public domain
2 wtfpl | wtfpl
2 zlib | zlib licen[cs]e
2 zlib | zlib libpng licen[cs]e
2 libpng | libpng licen[cs]e
2 openssl | openssl licen[cs]e
2 python | python software foundation licen[cs]e(?: (?:v|version )?2)?
2 python | psf licen[cs]e
2 php | php licen[cs]e(?: (?:v|version )?3(?: 01| 0)?)?
2 ruby | ruby licen[cs]e
2 postgresql | postgresql licen[cs]e
2 ncsa | ncsa open source licen[cs]e
2 vim | vim licen[cs]e
2 ofl | sil open font licen[cs]e
1 ofl-1.1 | sil open font licen[cs]e (?:v|version )?1 1
2 ofl | open font licen[cs]e
2 odbl | open database licen[cs]e
1 odbl-1.0 | odbl (?:v|version )?1 0
2 odc-by | open data commons attribution licen[cs]e
2 pddl | open data commons public domain dedication(?: and licen[cs]e)?
1 osl-3.0 | open software licen[cs]e (?:v|version )?3(?: 0)?
2 osl | open software licen[cs]e
1 afl-3.0 | academic free licen[cs]e (?:v|version )?3(?: 0)?
2 afl | academic free licen[cs]e
2 ms-pl | microsoft public licen[cs]e
2 ms-rl | microsoft reciprocal licen[cs]e
2 ibm | ibm public licen[cs]e(?: (?:v|version )?1 0)?
2 qpl | q public licen[cs]e
2 lppl | latex project public licen[cs]e
1 lppl-1.3c | lppl (?:v|version )?1 3c
2 cecill | cecill(?: b| c)?(?: licen[cs]e)?
2 openrail | openrail(?: m)?(?: licen[cs]e)?
2 openrail | creativeml open rail m
2 llama | llama (?:2 |3 |3 1 )?community licen[cs]e
2 beerware | beerware licen[cs]e
2 jython | jython licen[cs]e
2 upl | universal permissive licen[cs]e(?: (?:v|version )?1 0)?
2 public-domain | public domain dedication
2 public-domain | released into the public domain
2 public-domain | placed in the public domain
3 public-domain | public domain
1 apache-2.0 | spdx license identifier apache 2 0
1 mit | spdx license identifier mit
1 gpl-2.0 | spdx license identifier gpl 2 0(?: only)?
1 gpl-2.0+ | spdx license identifier gpl 2 0 or later
1 gpl-3.0 | spdx license identifier gpl 3 0(?: only)?
1 gpl-3.0+ | spdx license identifier gpl 3 0 or later
1 bsd-3-clause | spdx license identifier bsd 3 clause
1 mpl-2.0 | spdx license identifier mpl 2 0
3 spdx | spdx license identifier [0-9a-z]+(?: [0-9]+(?: [0-9]+)?)?(?: only| or later)?
3 proprietary | proprietary licen[cs]e
3 proprietary | all rights reserved
3 proprietary | confidential and proprietary
3 copyright | copyright c [0-9]{4}
3 copyright | copyright [0-9]{4}
3 named | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?[0-9a-z]+ (?:public )?licen[cs]e
3 named | subject to the terms of (?:the )?(?:[0-9a-z]+ ){1,4}licen[cs]e
3 named | see the licen[cs]e for the specific language governing permissions
3 named | dual licen[cs]ed
"""
