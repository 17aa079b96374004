"""Licence scan by ordered signature rules, in DataFrame functions only.

A rule has a label, a level (1: identifier line, 2: notice, 3: name,
4: bare mention), a keyword and a regular expression over the words of a text
(A-Z in lower case, one space between words). A text is looked at if one of its
words may stand in a match; a rule is tried if its own keyword, which each of its
matches holds, occurs. Matches of all rules
are intervals; one that lies inside another of the same or a higher level
(levels count down) is suppressed, of two equal ones the earlier rule stays.

Base phrases are counted apart and are never suppressed. Null and empty texts
have no words, no labels and the score 0. Texts of any length are scanned whole
(a row's words stand in memory once). Every row gives one row, repeated rows
equal ones; an empty table gives none. Other columns don't matter, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The signs between words: ASCII but for letters and digits. Named one by one, Java looks them up in a bitmap.
_BETWEEN = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"

#: Licence families: label, keyword, name as a regular expression over words, identifier words.
FAMILIES = (
    ("mit", "mit licen", r"mit licen[cs]e", "mit"),
    ("mit", "expat licen", r"expat licen[cs]e", "expat"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?", "apache 2 0"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "lgpl", r"lgpl (?:version |v)?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: (?:version |v)?1(?: \d)?)?", r"gfdl 1 \d(?: only| or later)?"),
    ("bsd-1-clause", "bsd", r"bsd (?:1|one) clause(?: licen[cs]e)?", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd (?:2|two) clause)(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd (?:3|three) clause)(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd (?:4|four) clause)(?: licen[cs]e)?", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause bsd|0bsd)(?: licen[cs]e)?", "0bsd"),
    ("isc", "isc licen", r"isc licen[cs]e", "isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2(?: 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "edl 1 0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: (?:version |v)?1 0)?", "cddl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e (?:version |v)?1 1", "cddl 1 1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "cpl 1 0"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: (?:version |v)?1 2)?", "eupl 1 2"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: (?:version |v)?1 1)?", "busl 1 1"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "want to public", r"do what the \w+ you want to public licen[cs]e", "wtfpl"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v)?2(?: 0)?", "artistic 2 0"),
    ("python-2.0", "python", r"python software foundation licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "python 2 0"),
    ("python-2.0", "psf licen", r"psf licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "python 2 0"),
    ("php-3.01", "php", r"php licen[cs]e(?: (?:version |v)?3(?: 01)?)?", "php 3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e", "ruby"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?", "ofl 1 1"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "ms rl"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "ecl 2 0"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "afl 3 0"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "osl 3 0"),
    ("odbl-1.0", "open database", r"(?:odc )?open database licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "odbl 1 0"),
    ("odc-by-1.0", "open data", r"open data commons attribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "odc by 1 0"),
    ("pddl-1.0", "public domain", r"public domain dedication and licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "pddl 1 0"),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: (?:universal )?(?:version |v)?1(?: 0)?)?", "cc0 1"),
    ("cc0-1.0", "cc0", r"cc0(?: (?:universal )?(?:version |v)?1(?: 0)?)?", "cc0 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "elastic 2 0"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "sspl 1 0"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "upl 1 0"),
)

#: Creative Commons parts: label, identifier words, long name.
_CC = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:s|atives)"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)"),
)
#: Notices, clauses and bare mentions with a wording of their own: label, level, keyword, pattern.
SINGLE = (
    ("mit", 2, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 2, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 2, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 2, "neither the name", r"neither the name of (?:\w+ ){1,12}nor the names of its contributors may be used"),
    ("bsd-4-clause", 2, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", 2, "this software is provided", r"this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", 2, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("apache-2.0", 2, "apache org", r"apache org licenses license 2 0"),
    ("gpl", 2, "free software", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the"),
    ("gpl-2.0-or-later", 2, "any later version", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 2, "any later version", r"either version 3 of the license or at your option any later version"),
    ("mpl-2.0", 2, "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("bsl-1.0", 2, "permission is hereby", r"permission is hereby granted free of charge to any person or organization"),
    ("mit", 2, "copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 2, "merge publish distribute", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("warranty-disclaimer", 2, "without warranty", r"the software is provided as is without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", 2, "merchantability", r"(?:implied )?warrant(?:y|ies) of merchantability(?: and| or) fitness for a particular purpose"),
    ("warranty-disclaimer", 2, "no event shall the", r"in no event shall the (?:authors?|copyright holders?|contributors?)(?: or copyright holders?| or contributors)? be liable"),
    ("bsd", 2, "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-3-clause", 2, "endorse", r"(?:may|shall) not be used to endorse or promote products derived from this software"),
    ("bsd-2-clause", 2, "regents", r"the regents of the university of california"),
    ("bsd-4-clause", 2, "acknowledgement", r"must display the following acknowledgement"),
    ("isc", 2, "copyright notice and this permission", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", 2, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 2, "altered source", r"altered source versions must be plainly marked as such"),
    ("apache-2.0", 2, "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", 2, "apache", r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-2.0", 2, "unless required", r"unless required by applicable law or agreed to in writing(?: software)?"),
    ("apache-1.1", 2, "apache", r"this product includes software developed by the apache software foundation"),
    ("openssl", 2, "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", 2, "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("gpl", 2, "general public", r"you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|file)"),
    ("gpl", 2, "hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 2, "free software foundation", r"as published by the free software foundation"),
    ("gpl-2.0-only", 2, "version 2", r"version 2 of the licen[cs]e only"),
    ("gpl-3.0-only", 2, "version 3", r"version 3 of the licen[cs]e only"),
    ("gpl-2.0", 2, "general public", r"gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2"),
    ("gpl-3.0", 2, "general public", r"gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2.1", 2, "lesser general", r"gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3.0", 2, "lesser general", r"gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("agpl-3.0", 2, "affero", r"gnu affero general public licen[cs]e as published by the free software foundation"),
    ("gpl-exception", 2, "classpath", r"(?:with the )?classpath exception"),
    ("gpl-exception", 2, "special", r"(?:as a special exception|special linking exception) (?:the copyright holders )?(?:of this library )?(?:give you permission to link|permits linking)"),
    ("gpl-exception", 2, "gcc runtime", r"gcc runtime library exception"),
    ("gpl-exception", 2, "llvm", r"llvm exceptions?"),
    ("gfdl", 2, "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 2, "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at (?:http |https )?mozilla org mpl 2 0"),
    ("mpl-1.1", 2, "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl-1.0", 2, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("epl-2.0", 2, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2 0"),
    ("cddl-1.0", 2, "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("eupl-1.2", 2, "eupl", r"licensed under the eupl(?: version 1 2)?"),
    ("bsl-1.0", 2, "boost", r"distributed under the boost software licen[cs]e version 1 0"),
    ("busl-1.1", 2, "change date", r"change date change licen[cs]e"),
    ("unlicense", 2, "dedicate", r"we (?:hereby )?dedicate any and all copyright interest in this software to the public domain"),
    ("unlicense", 2, "unlicense", r"for more information please refer to (?:http |https )?unlicense org"),
    ("cc0-1.0", 2, "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 2, "no copyright", r"no rights reserved no copyright"),
    ("public-domain", 2, "public domain", r"this (?:work|file|code|software) is (?:in|hereby placed in) the public domain"),
    ("public-domain", 2, "disclaims copyright", r"the author disclaims copyright to this source code"),
    ("wtfpl", 2, "want to", r"you just do what the \w+ you want to"),
    ("beerware", 2, "beer", r"(?:the beer ware licen[cs]e|you can buy me a beer in return)"),
    ("json", 2, "evil", r"the software shall be used for good not evil"),
    ("artistic-2.0", 2, "artistic", r"terms of the artistic licen[cs]e 2 0"),
    ("perl", 2, "perl", r"(?:same terms as perl itself|under the same terms as perl)"),
    ("python-2.0", 2, "python", r"python software foundation all rights reserved"),
    ("php-3.01", 2, "php", r"this source file is subject to version 3 0?1 of the php licen[cs]e"),
    ("ofl-1.1", 2, "font software", r"this font software is licensed under the sil open font licen[cs]e"),
    ("ofl-1.1", 2, "reserved font", r"with reserved font names?"),
    ("odbl-1.0", 2, "opendatacommons", r"opendatacommons org licenses odbl"),
    ("cc-by", 2, "creativecommons", r"creativecommons org licenses by \d \d"),
    ("cc-by-sa", 2, "creativecommons", r"creativecommons org licenses by sa \d \d"),
    ("cc-by-nd", 2, "creativecommons", r"creativecommons org licenses by nd \d \d"),
    ("cc-by-nc", 2, "creativecommons", r"creativecommons org licenses by nc \d \d"),
    ("cc-by-nc-sa", 2, "creativecommons", r"creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nc-nd", 2, "creativecommons", r"creativecommons org licenses by nc nd \d \d"),
    ("cc0-1.0", 2, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", 2, "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("elastic-2.0", 2, "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", 2, "making the functionality", r"making the functionality of the program or modified version available to third parties as a service"),
    ("commons-clause", 2, "commons clause", r"commons clause(?: licen[cs]e)? condition"),
    ("polyform", 2, "polyform", r"polyform (?:noncommercial|strict|shield|small business|internal use|free trial|perimeter) licen[cs]e"),
    ("rail", 2, "responsible", r"responsible ai licen[cs]es?"),
    ("openrail", 2, "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?"),
    ("llama-community", 2, "llama", r"llama(?: \d)*(?: \d)? community licen[cs]e(?: agreement)?"),
    ("hippocratic", 2, "hippocratic", r"hippocratic licen[cs]e"),
    ("anti-996", 2, "996", r"anti 996 licen[cs]e"),
    ("ecos", 2, "ecos", r"ecos licen[cs]e"),
    ("vim", 2, "vim", r"vim licen[cs]e"),
    ("curl", 2, "curl", r"curl licen[cs]e"),
    ("libpng", 2, "libpng", r"libpng licen[cs]e(?: version 2)?"),
    ("libpng", 2, "reference library", r"png reference library licen[cs]e(?: version 2)?"),
    ("ijg", 2, "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", 2, "freetype", r"(?:the )?freetype project licen[cs]e"),
    ("imagemagick", 2, "imagemagick", r"imagemagick licen[cs]e"),
    ("postgresql", 2, "postgresql", r"postgresql licen[cs]e"),
    ("unicode", 2, "unicode", r"unicode(?: inc)? licen[cs]e agreement data files and software"),
    ("icu", 2, "icu", r"icu licen[cs]e"),
    ("w3c", 2, "w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e"),
    ("x11", 2, "x11", r"x11 licen[cs]e"),
    ("xfree86", 2, "xfree86", r"xfree86 licen[cs]e(?: 1 1)?"),
    ("tcl", 2, "tcl", r"tcl tk licen[cs]e"),
    ("ncsa", 2, "ncsa", r"(?:university of illinois ncsa )?ncsa open source licen[cs]e"),
    ("intel", 2, "intel", r"intel (?:open source|simplified software) licen[cs]e"),
    ("nvidia", 2, "nvidia", r"nvidia (?:software|source code) licen[cs]e(?: agreement)?"),
    ("oracle-bcl", 2, "oracle", r"oracle binary code licen[cs]e(?: agreement)?"),
    ("sun-sissl", 2, "sun industry", r"sun industry standards source licen[cs]e"),
    ("ms-lpl", 2, "microsoft", r"microsoft limited public licen[cs]e"),
    ("ms-eula", 2, "microsoft", r"microsoft software licen[cs]e terms"),
    ("apple-apsl", 2, "apple public", r"apple public source licen[cs]e(?: (?:version )?\d(?: \d)?)?"),
    ("ibm-pl", 2, "ibm public", r"ibm public licen[cs]e(?: (?:version )?1 0)?"),
    ("lucent", 2, "lucent", r"lucent public licen[cs]e(?: (?:version )?1 02)?"),
    ("qpl", 2, "q public", r"(?:the )?q public licen[cs]e(?: (?:version )?1 0)?"),
    ("sleepycat", 2, "sleepycat", r"sleepycat licen[cs]e"),
    ("watcom", 2, "watcom", r"sybase open watcom public licen[cs]e"),
    ("nposl", 2, "non profit", r"non profit open software licen[cs]e(?: 3 0)?"),
    ("eula", 2, "end user", r"end user licen[cs]e agreement"),
    ("trial", 2, "evaluation", r"for evaluation (?:purposes )?only"),
    ("non-commercial", 2, "commercial", r"(?:for )?non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", 2, "noncommercial", r"(?:for )?noncommercial (?:use|purposes)(?: only)?"),
    ("proprietary", 2, "trade", r"(?:contains|constitutes?) (?:valuable )?trade secrets?"),
    ("proprietary", 2, "internal use", r"for internal use only"),
    ("proprietary", 2, "reverse engineer", r"(?:may not|shall not) reverse engineer decompile or disassemble"),
    ("proprietary", 2, "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 2, "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)"),
    ("proprietary", 2, "without the prior", r"without the prior written (?:permission|consent)"),
    ("all-rights-reserved", 2, "rights reserved", r"all rights reserved"),
    ("some-rights-reserved", 2, "rights reserved", r"some rights reserved"),
    ("no-rights-reserved", 2, "rights reserved", r"no rights reserved"),
    ("public-domain", 2, "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 3, "public domain", r"public domain"),
    ("apache", 3, "apache", r"apache (?:software )?licen[cs]e"),
    ("gpl", 3, "general public", r"(?:gnu )?general public licen[cs]e"),
    ("lgpl", 3, "lesser general", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", 3, "library general", r"(?:gnu )?library general public licen[cs]e"),
    ("gpl", 3, "gpl", r"(?:gnu )?gpl(?: ?v?[123](?: 0)?)?"),
    ("lgpl", 3, "lgpl", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl-3.0", 3, "agpl", r"(?:gnu )?agpl(?: ?v?3(?: 0)?)?"),
    ("bsd", 3, "bsd", r"bsd (?:style )?licen[cs]e"),
    ("mpl", 3, "mozilla", r"mozilla public licen[cs]e"),
    ("epl", 3, "eclipse", r"eclipse public licen[cs]e"),
    ("cc", 3, "creative commons", r"creative commons(?: licen[cs]e)?"),
    ("copyright", 4, "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("copyright", 4, "copyright", r"copyright"),
    ("license-reference", 4, "licen", r"(?:see|in|refer to) (?:the )?(?:file )?licen[cs]e(?: file| txt| md)?"),
    ("license-reference", 4, "ed under", r"(?:licensed|released|distributed|published) under"),
    ("license-reference", 4, "licen", r"(?:subject to|under) the terms (?:and conditions )?of the licen[cs]e"),
)
_UNDER = r"(?:(?:dual )?licensed|released|distributed|published|available|provided|covered|made available|free to use) (?:only )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?"
#: Whole words of which any match of a rule whose keyword ends so holds one; of other keywords it is the longest word.
_ANCHORS = {"licen": ("licence", "license"), "mit licen": ("licence", "license"), "expat licen": ("licence", "license"), "isc licen": ("licence", "license"), "psf licen": ("psf",), "unauthori": ("unauthorised", "unauthorized"), "bsd": ("bsd", "freebsd", "0bsd")}
#: Names that patterns also join with a version to one word.
_ANCHORS |= {name: (name, *[f"{name}{v}{n}" for v in ("", "v") for n in numbers]) for name, numbers in (("gpl", "123"), ("lgpl", "23"), ("agpl", "3"))}
_CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}


def rules() -> list[tuple[str, int, str, str]]:
    """All rules in order: label, level, keyword, pattern."""
    out: list[tuple[str, int, str, str]] = []
    families = list(FAMILIES)
    for label, words, name in _CC:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0", ""):
            v = "(?: (?:international|unported))? " + version.replace(".", " ") + "(?: (?:international|unported))?" if version else ""
            full = f"{label}-{version}".rstrip("-")
            families.append((full, f"cc {words}", f"cc {words}(?: licen[cs]e)?{v}", f"cc {words} {version.replace('.', ' ')}".rstrip()))
            families.append((full, "creative commons", f"creative commons {name}(?: licen[cs]e)?{v}", f"creative commons {words} {version.replace('.', ' ')}".rstrip()))
    for label, keyword, name, words in families:
        out.append((label, 1, "spdx", f"spdx licen[cs]e identifier {words}"))
        out.append((label, 2, keyword, f"{_UNDER}{name}"))
        out.append((label, 3, keyword, name))
    return out + list(SINGLE)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_table() -> Column:
    rows = ", ".join(f"named_struct('label', {_quoted(label)}, 'level', {level}, 'word', {_quoted(word)}, 'pattern', {_quoted(f'(?<= )(?:{pattern})(?= )')}, 'place', {i})" for i, (label, level, word, pattern) in enumerate(rules()))
    return F.expr(f"array({rows})")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, " ", ""))).cast("long")


def _spans(norm: Column, rule: Column) -> Column:
    """Matches of a rule as structs, by the lengths of what stands between them and of themselves."""
    between = F.split(norm, rule["pattern"], -1)
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("own")))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,back:int,level:int,place:int,label:string>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["own"]
        one = F.struct(start.alias("start"), (-end).alias("back"), rule["level"].alias("level"), rule["place"].alias("place"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    return F.aggregate(lengths, empty, step, lambda acc: acc["spans"])


def _standing(spans: Column) -> Column:
    """The intervals that no other of their level or above contains; `spans` in the order start, longest, level, rule."""
    empty = F.struct(F.lit(-1).alias("m1"), F.lit(-1).alias("m2"), F.lit(-1).alias("m3"), F.lit(-1).alias("m4"), F.expr("cast(array() as array<struct<start:int,end:int,level:int,label:string>>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        above = reduce(F.greatest, [F.when(x["level"] >= k, acc[f"m{k}"]).otherwise(F.lit(-1)) for k in (1, 2, 3, 4)])
        one = F.struct(x["start"].alias("start"), end.alias("end"), x["level"].alias("level"), x["label"].alias("label"))
        ends = [F.when(x["level"] == k, F.greatest(acc[f"m{k}"], end)).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in (1, 2, 3, 4)]
        return F.struct(*ends, F.when(above >= end, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(one))).alias("kept"))

    return F.aggregate(F.array_sort(spans), empty, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, and `detections`.

    Detections are structs (start, end: characters of the text's words joined
    by spaces, with one in front; level; label).
    """
    # lower() also folds letters beyond A-Z; no such letter becomes a sign, so the words are the same in number and place
    words = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), _BETWEEN, -1)
    count = (F.size("w") - F.when(F.element_at("w", 1) == "", 1).otherwise(0) - F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)).cast("long")
    gate = F.array(*[F.lit(w) for w in sorted({_ANCHORS.get(w, (max(w.split(), key=len),)) for _, _, w, _ in rules()} | {("license",)}) for w in w])
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text"))
    rows = rows.select(id_col, words.alias("w"))
    joined = F.concat(F.lit(" "), F.trim(F.array_join("w", " ")), F.lit(" "))
    rows = rows.select(id_col, count.alias("n_words"), F.when(F.arrays_overlap("w", gate), joined).alias("norm"))

    norm = F.col("norm")
    cut = [F.split(norm, f"(?<= ){phrase}(?= )", -1).alias(label) for phrase, label in BASE]
    tried = F.filter(_rule_table(), lambda r: F.contains(norm, r["word"]))
    spans = F.flatten(F.transform(tried, lambda r: _spans(norm, r)))
    rows = rows.select(id_col, "n_words", _spaces(norm).alias("spaces"), *cut, F.when(norm.isNotNull(), _standing(spans)).alias("detections"))

    places = [F.size(label) - 1 for _, label in BASE]
    firsts = [F.when(F.size(label) > 1, _spaces(F.element_at(label, 1)) - 1) for _, label in BASE]
    lasts = [F.when(F.size(label) > 1, F.col("spaces") - _spaces(F.element_at(label, -1)) - len(phrase.split())) for phrase, label in BASE]
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(label) > 1, F.lit(label)) for _, label in BASE])))
    detections = F.coalesce(F.col("detections"), F.expr("cast(array() as array<struct<start:int,end:int,level:int,label:string>>)"))
    labels = F.array_sort(F.array_union(F.col("base_labels"), F.transform("detections", lambda d: d["label"])))
    top = F.array_min(F.transform("detections", lambda d: d["level"]))
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in _CONFIDENCE.items() for x in (k, v)]), top), F.lit(0.0))
    rows = rows.select(
        id_col,
        "n_words",
        F.when(F.col("spaces").isNotNull(), reduce(lambda a, b: a + b, places)).otherwise(0).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.when(F.col("spaces").isNotNull(), base).otherwise(F.expr("cast(array() as array<string>)")).alias("base_labels"),
        detections.alias("detections"),
    )
    return rows.select(id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), F.when(F.size("base_labels") > 0, F.greatest(score, F.lit(_CONFIDENCE[3]))).otherwise(score).alias("score"), "detections")
