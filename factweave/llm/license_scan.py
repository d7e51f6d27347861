"""Operator 4: license scans by ordered signature rules.

A text is folded to lower-case ASCII words in one byte translation; runs of
[0-9a-z] and non-ASCII bytes are words. Rules are regexes over the folded
words, each gated by a keyword that must occur, in order of priority. Of
overlapping detections, one whose interval lies within that of a rule of the
same or a better priority is suppressed. Detections of the base phrases are
never suppressed in counts or labels.

Null and empty texts have no words, no labels and score 0. Repeated rows give
repeated rows; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm.common import documents_text, map_arrow, slices

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"

# The contract's phrases and labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: label, keyword that must occur, what a license's name looks like in folded words.
NAMES = (
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("mit", "x11", r"x11"),
    ("apache-1.1", "apache", r"apache (?:software )?(?:license )?(?:version )?1 1"),
    ("apache-2", "apache", r"apache (?:software )?(?:license )?(?:version |v )?2(?: 0)?"),
    ("agpl-3", "gpl", r"agpl ?v?3(?: 0)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero (?:general )?public license(?: (?:version|v) ?3)?"),
    ("lgpl-2.1", "gpl", r"lgpl ?v?2 1"),
    ("lgpl-3", "gpl", r"lgpl ?v?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", "library", r"(?:gnu )?library general public license"),
    ("gpl-2", "gpl", r"gpl ?v?2(?: 0)?"),
    ("gpl-3", "gpl", r"gpl ?v?3(?: 0)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public license (?:version |v )2"),
    ("gpl-3", "general public", r"(?:gnu )?general public license (?:version |v )3"),
    ("gpl", "general public", r"(?:gnu )?general public license"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd-0", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("bsd", "bsd", r"bsd"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v )?1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: (?:version |v )?2(?: 0)?)?"),
    ("mpl-2", "mpl", r"mpl ?v?2(?: 0)?"),
    ("epl-1", "epl", r"epl ?v?1 0"),
    ("epl-2", "epl", r"epl ?v?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("eupl", "eupl", r"eupl(?: v?1 [012])?"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("cddl", "cddl", r"cddl(?: v?1 [01])?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("boost-1", "boost", r"boost (?:software )?(?:license )?(?:version )?1(?: 0)?"),
    ("artistic-2", "artistic", r"(?:perl )?artistic(?: license)?(?: 2(?: 0)?)?"),
    ("python-2", "psf", r"psf"),
    ("python-2", "python", r"(?:python software foundation|python)"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("php-3", "php", r"php(?: 3(?: 0[01]?)?)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: (?:version )?1 1)?"),
    ("odbl", "database", r"open database license"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike"),
    ("cc-by", "commons", r"creative commons attribution"),
)

#: priority (less is better), confidence, what stands around a name; {} is the name.
FORMS = (
    (1, 1.0, r"spdx license identifier {}(?: only| or later)?"),
    (2, 0.95, r"(?:released|licensed|distributed|available|published|covered|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]es?)?"),
    (3, 0.9, r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{} licen[cs]e"),
    (4, 0.8, r"licen[cs]e {}"),
    (5, 0.7, r"(?:the )?{} licen[cs]e"),
    (6, 0.6, r"governed by (?:the )?{}"),
)

#: label, keyword, regex, priority, confidence of passages that name no license by a name above.
PASSAGES = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 1.0),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 1, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 1, 0.95),
    ("cc-by-nc", "cc by nc", r"cc by nc", 2, 0.9),
    ("apache-2", "apache license", r"apache license version 2", 2, 0.95),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 3, 0.8),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 6, 0.5),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 6, 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:1[89]|20)[0-9][0-9]", 7, 0.4),
)

#: The same of the standard notices, titles and reference lines of each license, and of bare full names (priority 6).
_FSF = r"(?: as)? published by the free software foundation (?:either )?version "
_MAY = r"redistribute it and or modify it under the terms of (?:the )?"
_LATER = r"(?: of the license)?(?: or at your option any later version)?"
_VERSION = r" (?:version |v )?"
NOTICES = (
    ("gpl-2", "general public", _MAY + r"(?:gnu )?general public license" + _FSF + "2" + _LATER, 1, 1.0),
    ("gpl-3", "general public", _MAY + r"(?:gnu )?general public license" + _FSF + "3" + _LATER, 1, 1.0),
    ("gpl", "general public", _MAY + r"(?:gnu )?general public license", 2, 0.95),
    ("gpl", "general public", r"received a copy of the gnu general public license", 4, 0.9),
    ("gpl-2", "general public", r"gnu general public license version 2(?: june 1991)?", 2, 0.95),
    ("gpl-3", "general public", r"gnu general public license version 3(?: 29 june 2007)?", 2, 0.95),
    ("gpl-2", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0", 3, 0.9),
    ("gpl-3", "gnu org", r"gnu org licenses gpl 3 0", 3, 0.9),
    ("gpl", "general public", r"(?:gnu )?general public license", 6, 0.6),
    ("lgpl-2.1", "lesser general", _MAY + r"(?:gnu )?lesser general public license" + _FSF + "2 1" + _LATER, 1, 1.0),
    ("lgpl-3", "lesser general", _MAY + r"(?:gnu )?lesser general public license" + _FSF + "3" + _LATER, 1, 1.0),
    ("lgpl", "general public", _MAY + r"(?:gnu )?(?:lesser|library) general public license", 2, 0.95),
    ("lgpl", "general public", r"received a copy of the gnu (?:lesser|library) general public license", 4, 0.9),
    ("lgpl-2.1", "lesser general", r"gnu lesser general public license version 2 1(?: february 1999)?", 2, 0.95),
    ("lgpl-3", "lesser general", r"gnu lesser general public license version 3(?: 29 june 2007)?", 2, 0.95),
    ("lgpl", "library general", r"gnu library general public license version 2(?: june 1991)?", 2, 0.95),
    ("lgpl-2.1", "gnu org", r"gnu org licenses (?:old licenses )?lgpl 2 1", 3, 0.9),
    ("lgpl-3", "gnu org", r"gnu org licenses lgpl 3 0", 3, 0.9),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public license", 6, 0.6),
    ("agpl-3", "affero", _MAY + r"(?:gnu )?affero general public license(?:" + _FSF + "3" + _LATER + ")?", 1, 1.0),
    ("agpl-3", "affero", r"received a copy of the gnu affero general public license", 4, 0.9),
    ("agpl-3", "affero", r"gnu affero general public license version 3(?: 19 november 2007)?", 2, 0.95),
    ("agpl-3", "gnu org", r"gnu org licenses agpl 3 0", 3, 0.9),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license", 6, 0.6),
    ("mpl-2", "mozilla", r"subject to the terms of the mozilla public license v(?:ersion)? 2 0", 1, 1.0),
    ("mpl-1.1", "mozilla", r"subject to the (?:terms of the )?mozilla public license v(?:ersion)? 1 1", 1, 1.0),
    ("mpl-1.1", "mozilla", r"mozilla public license" + _VERSION + "1 1", 3, 0.95),
    ("mpl-2", "mozilla", r"mozilla public license" + _VERSION + "2 0", 3, 0.95),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0", 3, 0.9),
    ("mpl-2", "mozilla", r"mozilla public license", 6, 0.6),
    ("epl-1", "eclipse", r"(?:available under the terms of the )?eclipse public license (?:version |v )?v?1 0", 1, 0.95),
    ("epl-2", "eclipse", r"(?:available under the terms of the )?eclipse public license (?:version |v )?v?2 0", 1, 0.95),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10", 3, 0.9),
    ("epl-2", "eclipse org", r"eclipse org legal epl (?:v20|2 0)", 3, 0.9),
    ("epl", "eclipse", r"eclipse public license", 6, 0.6),
    ("eupl", "european union", r"european union public licen[cs]e(?: (?:version |v )?v?1 [012])?", 3, 0.9),
    ("cddl", "common development", r"(?:subject to the terms of the )?common development and distribution license(?: cddl)?(?: version 1 [01])?", 3, 0.95),
    ("apache-1.1", "apache software", r"apache software license version 1 1", 2, 0.95),
    ("apache-2", "apache org", r"apache org licenses license 2 0", 3, 0.9),
    ("bsd-3", "endorse or promote", r"may be used to endorse or promote products derived from this software", 2, 0.9),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 0.95),
    ("isc", "hereby granted", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 1, 1.0),
    ("postgresql", "written agreement", r"without fee and without a written agreement is hereby granted", 1, 1.0),
    ("zlib", "permission is granted", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 1, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1, 1.0),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license", 1, 1.0),
    ("boost-1", "boost", r"boost software license version 1 0(?: august 17th 2003)?", 2, 0.95),
    ("openssl", "openssl", r"developed by the openssl project for use in the openssl toolkit", 2, 0.9),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version 1 1(?: 26 february 2007)?)?", 3, 0.9),
    ("odbl", "open database", r"open database licen[cs]e(?: odbl)?(?: v1 0)?", 3, 0.9),
    ("cc0", "cc0", r"cc0 1 0 universal", 2, 0.95),
    ("cc0", "neighboring rights", r"waived all copyright and related or neighboring rights", 2, 0.95),
    *((label, key, regex, 3, 0.9) for label, tail, url in (
        ("cc-by-nc-sa", r" non ?commercial share ?alike", "by nc sa"), ("cc-by-nc-nd", r" non ?commercial no ?deriv(?:ative)?s", "by nc nd"), ("cc-by-nc", r" non ?commercial", "by nc"),
        ("cc-by-sa", r" share ?alike", "by sa"), ("cc-by-nd", r" no ?deriv(?:ative)?s", "by nd"), ("cc-by", "", "by"),
    ) for key, regex in (("creative commons", f"creative commons attribution{tail}(?: [1234] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?"), ("creativecommons org", f"creativecommons org licenses {url} [1234] [05]"))),
)


#: The same of clauses, warranty texts, headers, exceptions, choices of several licenses and "or later" wordings.
_GNU = r"(?:gnu general public license|gpl)"
_OR_LATER = r"(?: as published by the free software foundation)? (?:either )?(?:version |v )?{}(?: 0)?(?: of the license)? or (?:at your option )?any later version"
CLAUSES = (
    ("apache-2", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1, 1.0),
    ("apache-2", "except in compliance", r"you may not use this (?:file|work|software) except in compliance with the license", 4, 0.7),
    ("apache-2", "conditions of any kind", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", 3, 0.8),
    ("apache-2", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1, 1.0),
    ("apache-2", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 2, 0.9),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.9),
    ("mit", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 2, 0.85),
    ("mit", "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 1, 1.0),
    ("mit", "dealings in the software", r"connection with the software or the use or other dealings in the software", 4, 0.7),
    ("bsd", "source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.9),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 2, 0.9),
    ("bsd-3", "nor the names of", r"neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software", 1, 1.0),
    ("bsd", "and contributors as is", r"this software is provided by the (?:copyright holders|regents) and contributors as is and any express or implied warranties", 2, 0.85),
    ("bsd-4", "this product includes", r"this product includes software developed by (?:the )?(?:[^ ]+ ){1,8}and its contributors", 2, 0.9),
    ("gpl", "without any warranty", r"this program is distributed in the hope that it will be useful but without any warranty", 3, 0.8),
    ("gpl", "general public", r"see the gnu general public license for more details", 3, 0.85),
    ("lgpl", "lesser general", r"this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license", 1, 0.95),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it", 2, 0.9),
    ("gpl-2", "only", _GNU + r" (?:version |v )?2(?: 0)? only", 1, 1.0),
    ("gpl-3", "only", _GNU + r" (?:version |v )?3(?: 0)? only", 1, 1.0),
    ("gpl-2-or-later", "later", _GNU + _OR_LATER.format(2), 1, 1.0),
    ("gpl-3-or-later", "later", _GNU + _OR_LATER.format(3), 1, 1.0),
    ("gpl-2-or-later", "later", r"gpl 2 0 or later", 1, 1.0),
    ("gpl-3-or-later", "later", r"gpl 3 0 or later", 1, 1.0),
    ("lgpl-2.1-or-later", "later", r"lgpl 2 1 or later", 1, 1.0),
    ("lgpl-3-or-later", "later", r"lgpl 3 0 or later", 1, 1.0),
    ("agpl-3-or-later", "later", r"agpl 3 0 or later", 1, 1.0),
    ("exception-classpath", "classpath", r"(?:with (?:the )?)?(?:gnu )?classpath exception(?: 2 0)?", 1, 0.95),
    ("exception-classpath", "independent modules", r"gives you permission to link this library with independent modules to produce an executable", 1, 1.0),
    ("exception-gcc-runtime", "runtime library exception", r"gcc runtime library exception(?: version 3 1)?", 1, 1.0),
    ("exception-linux-syscall", "system calls", r"user programs that use kernel services by normal system calls", 1, 0.95),
    ("exception-openssl", "openssl", r"special exception (?:the copyright holders give )?permission to link (?:the code of )?(?:this program|portions of this program) with the openssl library", 1, 1.0),
    ("exception-llvm", "llvm", r"(?:with )?llvm exceptions?", 1, 0.95),
    ("exception-autoconf", "autoconf", r"as a special exception (?:to the gnu general public license )?if you distribute this file as part of a program that contains a configuration script generated by autoconf", 1, 1.0),
    ("exception-bison", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 1, 1.0),
    ("exception-font", "font", r"as a special exception if you create a document which uses this font", 1, 1.0),
    ("dual", "licensed under", r"(?:dual|multi|triple|tri) licensed under", 2, 0.9),
    ("dual", "under", r"(?:licensed|available|released|distributed) under (?:either|any) of", 3, 0.8),
    ("dual", "you may choose", r"you may choose (?:either|one of|any of) (?:the following|these) licen[cs]es?", 2, 0.9),
    ("mpl-2", "mozilla org", r"if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0", 1, 1.0),
    ("mpl-2", "secondary licenses", r"incompatible with secondary licenses as defined by the mozilla public license", 1, 1.0),
    ("mpl-1.1", "mozilla org", r"mozilla org mpl (?:mpl 1 1|1 1)", 3, 0.9),
    ("epl-2", "spdx", r"spdx license identifier epl 2 0", 1, 1.0),
    ("epl-2", "secondary licenses", r"this source code may also be made available under the following secondary licenses when the conditions for such availability", 1, 1.0),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution license", 1, 1.0),
    ("isc", "author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 1, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 1.0),
    ("zlib", "misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 1.0),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 1, 1.0),
    ("boost-1", "boost", r"distributed under the boost software license version 1 0 see accompanying file", 1, 1.0),
    ("cc0", "extent possible", r"to the extent possible under law (?:the author|(?:[^ ]+ ){1,6})(?: has)? (?:has )?(?:waived|dedicated) all copyright", 1, 1.0),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero 1 0", 3, 0.9),
    ("public-domain", "author disclaims copyright", r"the author disclaims copyright to this source code", 1, 1.0),
    ("public-domain", "is claimed", r"no copyright is claimed", 4, 0.7),
    ("python-2", "python", r"python software foundation license version 2", 2, 0.95),
    ("php-3", "php", r"this source file is subject to version 3 0?1? ?of the php license", 1, 1.0),
    ("artistic-2", "artistic", r"the artistic license 2 0", 2, 0.95),
    ("artistic-1", "artistic", r"(?:the )?artistic license(?: 1 0)? with perl", 2, 0.9),
    ("perl-5", "perl", r"(?:under )?the same terms as perl itself", 2, 0.95),
    ("postgresql", "without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", 1, 0.95),
    ("ofl-1.1", "reserved font name", r"with reserved font name", 3, 0.8),
    ("eupl", "eupl", r"licensed under the eupl(?: version 1 [012])?(?: or as soon they will be approved by the european commission subsequent versions of the eupl)?", 1, 1.0),
    ("ms-pl", "microsoft public", r"microsoft public license(?: ms pl)?", 3, 0.9),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license(?: ms rl)?", 3, 0.9),
    ("ncsa", "university of illinois", r"university of illinois (?:at urbana champaign )?(?:ncsa )?open source license", 2, 0.95),
    ("afl-3", "academic free", r"academic free license(?: version)?(?: 3 0)?", 3, 0.9),
    ("osl-3", "open software license", r"open software license(?: version)?(?: 3 0)?", 3, 0.9),
    ("upl-1", "universal permissive", r"universal permissive license(?: upl)?(?: version)?(?: 1 0)?", 3, 0.9),
    ("sspl-1", "server side", r"server side public license(?: version 1)?", 3, 0.9),
    ("busl-1.1", "business source", r"business source license(?: 1 1)?", 3, 0.9),
    ("elastic-2", "elastic", r"elastic license(?: 2 0)?", 3, 0.85),
    ("commons-clause", "commons clause", r"commons clause license condition", 1, 1.0),
    ("json", "good not evil", r"the software shall be used for good not evil", 1, 1.0),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", 1, 1.0),
    ("vim", "vim license", r"vim license", 4, 0.8),
    ("hippocratic", "hippocratic", r"hippocratic license", 4, 0.8),
    ("blueoak-1", "blue oak", r"blue oak model license(?: 1 0 0)?", 3, 0.9),
    ("mulan-2", "mulan", r"mulan (?:psl|permissive software license)(?: v2| version 2)?", 3, 0.9),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 1, 0.95),
    ("proprietary", "trade secret", r"contains (?:confidential information and )?trade secrets? of", 3, 0.7),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|work|document|book) may be reproduced", 2, 0.9),
)


class Rule(NamedTuple):
    priority: int
    order: int
    label: str
    keyword: bytes
    confidence: float
    regex: re.Pattern[bytes]


def rules() -> list[Rule]:
    """All rules in order of priority, then as written: every form with every name, then the passages and notices."""
    found = [(p, label, key, conf, form.format(name)) for p, conf, form in FORMS for label, key, name in NAMES]
    found += [(p, label, key, conf, regex) for label, key, regex, p, conf in PASSAGES + NOTICES + CLAUSES]
    found = sorted(enumerate(found), key=lambda x: (x[1][0], x[0]))
    return [Rule(p, i, label, key.encode(), conf, re.compile(b" " + regex.encode() + b"(?= )")) for i, (_, (p, label, key, conf, regex)) in enumerate(found)]


class Scanner:
    def __init__(self) -> None:
        by: dict[bytes, list[Rule]] = {}
        for rule in rules():
            by.setdefault(rule.keyword, []).append(rule)
        self.by_keyword = by
        # one look for any keyword at all: most texts have none
        self.any = re.compile(b"|".join(sorted(map(re.escape, by), key=len)))
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in BASE]

    def scan(self, text: str) -> tuple:
        words = text.encode("utf-8", "replace").translate(_FOLD).split()
        folded = b" " + b" ".join(words) + b" "
        base, base_labels = [], set()
        for phrase, label in self.base:
            at = folded.find(phrase)
            while at >= 0:
                base.append(at)
                base_labels.add(label)
                at = folded.find(phrase, at + 1)
        starts = [folded.count(b" ", 0, at) for at in sorted({min(base), max(base)})] if base else []
        kept = self.detect(folded)
        labels = base_labels | {rule.label for rule, _, _ in kept}
        score = max([0.95 * bool(base), *(rule.confidence for rule, _, _ in kept)])
        spans = ",".join(f"{rule.label}:{folded.count(b' ', 0, a)}:{folded.count(b' ', 0, b)}" for rule, a, b in sorted(kept, key=lambda x: (x[1], x[2], x[0].order)))
        return len(words), len(base), starts[0] if base else None, starts[-1] if base else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(score), spans

    def detect(self, folded: bytes) -> list[tuple[Rule, int, int]]:
        """Detections that no better rule's interval contains."""
        if not self.any.search(folded):
            return []
        found = [(rule, m.start(), m.end()) for key, own in self.by_keyword.items() if key in folded for rule in own for m in rule.regex.finditer(folded)]
        found.sort(key=lambda x: (x[0].priority, x[1] - x[2], x[0].order, x[1]))
        kept: list[tuple[Rule, int, int]] = []
        held = _Intervals()
        for rule, a, b in found:
            if not held.contain(a, b):
                kept.append((rule, a, b))
                held.add(a, b)
        return kept


class _Intervals:
    """Kept intervals by start, with none inside another, so one look to the left finds a container."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def contain(self, a: int, b: int) -> bool:
        from bisect import bisect_right

        i = bisect_right(self.starts, a) - 1
        return i >= 0 and self.ends[i] >= b

    def add(self, a: int, b: int) -> None:
        from bisect import bisect_left

        i = bisect_left(self.starts, a)
        j = i
        while j < len(self.starts) and self.ends[j] <= b:
            j += 1
        self.starts[i:j], self.ends[i:j] = [a], [b]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base detections, labels, confidence and the detections kept, as label:first:end in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for batch in batches:
            for part, texts in slices(batch):
                columns = list(zip(*map(scanner.scan, texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])

    return map_arrow(documents_text(docs), run, SCHEMA)
