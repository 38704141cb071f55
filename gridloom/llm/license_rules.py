"""License scans: ordered signature rules, in DataFrame functions only.

A text becomes its words in lower case with a blank around each; a rule is a regex over that, from a word's blank to the blank
after its last word. Rules stand under a keyword and are tried only on texts that hold it; texts without any of the
``GATES`` are not tried at all. A detection is an interval of words. One that lies inside another falls to it if the other's priority is
higher, or if the priority is the same and the other is longer, or as long and its rule comes first.

``SIGNATURES`` (grants, conditions, headers, addresses) and ``NOTICES`` are written by hand, and so is ``FAMILIES``, of which each family and version gives the
same forms of rule (``rules``).

Defined results: null and empty texts have no words and score 0; n-fold text gives n-fold places; equal rows give equal results; ties fall to the
rule that comes first; an empty table gives none; columns of the operator's own names aren't kept unless asked for. All work stays within a row, so no key can be hot; a
very long text is scanned whole, and work grows with its length, with the root of its detections besides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Label, keyword (every match of the name holds it), name as a regex over words, versions, SPDX identifier as words.
FAMILIES = [
    ("mit", "mit", "mit", "", "mit"),
    ("mit", "expat", "expat", "", ""),
    ("x11", "x11", "x11", "", "x11"),
    ("apache", "apache", "apache(?: software)?(?: foundation)?", "1 0|1 1|2 0", "apache"),
    ("gpl", "general public", "(?:gnu )?general public", "1|2|3|1 0|2 0|3 0", ""),
    ("gpl", "gpl", "(?:gnu )?gpl", "1|2|3|1 0|2 0|3 0", "gpl"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public", "2|2 1|3|2 0|3 0", ""),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2|2 1|3|2 0|3 0", "lgpl"),
    ("agpl", "affero", "(?:gnu )?affero general public", "1|3|3 0", ""),
    ("agpl", "agpl", "(?:gnu )?agpl", "1|3|3 0", "agpl"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation", "1 1|1 2|1 3", "gfdl"),
    ("bsd", "bsd", "(?:new |revised |simplified |modified )?bsd", "2 clause|3 clause|4 clause", "bsd"),
    ("0bsd", "zero clause bsd", "zero clause bsd", "", ""),
    ("0bsd", "0bsd", "0bsd", "", "0bsd"),
    ("isc", "isc", "isc", "", "isc"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "", "ncsa"),
    ("zlib", "zlib", "zlib(?: libpng)?", "", "zlib"),
    ("boost", "boost", "boost software", "1 0", "bsl"),
    ("mpl", "mozilla", "mozilla public", "1 0|1 1|2 0", "mpl"),
    ("epl", "eclipse", "eclipse public", "1 0|2 0", "epl"),
    ("edl", "eclipse", "eclipse distribution", "1 0", ""),
    ("cddl", "common development", "common development and distribution", "1 0|1 1", "cddl"),
    ("cpl", "common public", "common public", "1 0", "cpl"),
    ("ipl", "ibm", "ibm public", "1 0", "ipl"),
    ("eupl", "european union public", "european union public", "1 0|1 1|1 2", "eupl"),
    ("cecill", "cecill", "cecill", "1 0|2 0|2 1", "cecill"),
    ("artistic", "artistic", "artistic", "1 0|2 0", "artistic"),
    ("perl", "perl", "perl(?: 5)?", "", ""),
    ("python", "python", "python(?: software foundation)?", "2 0", "python"),
    ("php", "php", "php", "3 0|3 01", "php"),
    ("ruby", "ruby", "ruby", "", "ruby"),
    ("postgresql", "postgresql", "postgresql", "", "postgresql"),
    ("openssl", "openssl", "openssl", "", "openssl"),
    ("w3c", "w3c", "w3c(?: software)?", "", "w3c"),
    ("ms-pl", "microsoft", "microsoft public", "", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "", "ms rl"),
    ("osl", "open software", "open software", "1 0|2 0|2 1|3 0", "osl"),
    ("afl", "academic free", "academic free", "1 1|2 0|2 1|3 0", "afl"),
    ("apsl", "apple", "apple public source", "1 0|1 1|1 2|2 0", "apsl"),
    ("qpl", "q public", "q public", "1 0", "qpl"),
    ("sleepycat", "sleepycat", "sleepycat", "", "sleepycat"),
    ("vim", "vim", "vim", "", "vim"),
    ("tcl", "tcl", "tcl(?: tk)?", "", "tcl"),
    ("zpl", "zope", "zope public", "1 1|2 0|2 1", "zpl"),
    ("spl", "sun public", "sun public", "1 0", "spl"),
    ("npl", "netscape", "netscape public", "1 0|1 1", "npl"),
    ("ofl", "open font", "(?:sil )?open font", "1 0|1 1", "ofl"),
    ("odbl", "open database", "open database", "1 0", "odbl"),
    ("pddl", "public domain dedication", "(?:odc )?public domain dedication(?: and)?", "1 0", "pddl"),
    ("upl", "universal permissive", "universal permissive", "1 0", "upl"),
    ("busl", "business source", "business source", "1 1", "busl"),
    ("sspl", "server side public", "server side public", "1", "sspl"),
    ("elastic", "elastic", "elastic", "2 0", "elastic"),
    ("unlicense", "unlicense", "unlicense", "", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "2", "wtfpl"),
    ("cc0", "cc0", "cc0(?: universal)?", "1 0", "cc0"),
    ("cc-by", "creative commons", "creative commons attribution", "2 0|2 5|3 0|4 0", "cc by"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike", "2 0|2 5|3 0|4 0", "cc by sa"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial", "2 0|2 5|3 0|4 0", "cc by nc"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?", "2 0|2 5|3 0|4 0", "cc by nd"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike", "2 0|2 5|3 0|4 0", "cc by nc sa"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "2 0|2 5|3 0|4 0", "cc by nc nd"),
]
#: Label, keyword and regex over words of grants, conditions, headers and addresses that stand in licenses or name one without its title.
SIGNATURES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?"),
    ("mit", "deal in the software", "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell(?: copies of the software)?"),
    ("mit", "this permission notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all(?: copies or substantial portions of the software)?"),
    ("mit", "mit style license", "governed by an mit style license"),
    ("mit", "opensource org", "opensource org licenses mit"),
    ("mit-0", "mit no attribution", "mit no attribution"),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising"),
    ("x11", "except as contained in this notice", "except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising"),
    ("hpnd", "use copy modify and distribute", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("hpnd", "use copy modify distribute and sell", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the(?: above)? copyright notices?(?: this list of conditions and the following disclaimer)?"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the(?: above)? copyright notices?(?: this list of conditions and the following disclaimer)?"),
    ("bsd", "holders and contributors", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "regents and contributors", "this software is provided by the regents and contributors as is"),
    ("bsd", "bsd style license", "governed by a bsd style license"),
    ("bsd-2-clause", "opensource org", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org", "opensource org licenses bsd 3 clause"),
    ("bsd-3-clause", "neither the name", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|any|their) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "name of the author", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "no express or implied licenses", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", "you may not use this file", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0"),
    ("apache-2.0", "use reproduction and distribution", "apache license version 2 0 january 2004(?: http www apache org licenses)? terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", "this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl", "free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-1.0-or-later", "version 1", "general public license as published by the free software foundation either version 1 or at your option any later version"),
    ("gpl-2.0-only", "version 2 of the license", "general public license(?: version 2)? as published by the free software foundation version 2 of the license(?! or)"),
    ("gpl-2.0-or-later", "version 2 of the license", "general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "version 3 of the license", "general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-1.0", "february 1989", "gnu general public license version 1 february 1989"),
    ("gpl-2.0", "june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl", "copy of the gnu general public", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu org licenses", "gnu org licenses gpl"),
    ("gpl-2.0", "gnu org licenses", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3.0", "gnu org licenses", "gnu org licenses gpl 3 0"),
    ("gpl-family", "verbatim copies of this license", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "absolutely no warranty", "comes with absolutely no warranty"),
    ("gpl-classpath-exception", "classpath", "classpath exception"),
    ("gpl-gcc-exception", "runtime library exception", "gcc runtime library exception"),
    ("gpl-linking-exception", "special exception", "as a special exception (?:[^ ]+ ){1,30}permission to link"),
    ("gpl-bison-exception", "bison parser skeleton", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf-exception", "configuration script generated", "if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("lgpl", "free software foundation", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl-2.0-or-later", "version 2 of the license", "library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "version 2 1 of the license", "lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "version 3 of the license", "lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0", "june 1991", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "june 2007", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl", "gnu org licenses", "gnu org licenses lgpl"),
    ("agpl-3.0-or-later", "version 3 of the license", "affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("agpl", "gnu org licenses", "gnu org licenses agpl"),
    ("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "no invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "mozilla org", "mozilla org mpl"),
    ("mpl-tri-license", "either the gnu general public", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1.0", "eclipse org legal", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse org legal", "eclipse org legal epl (?:v20|2 0)"),
    ("edl-1.0", "eclipse org", "eclipse org org documents edl v10"),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "cddl header", "cddl header start"),
    ("zlib", "without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("boost-1.0", "any person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", "boost org", "boost org license 1 0 txt"),
    ("ncsa", "deal with the software", "deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "you want to public license", "do what the fuck you want to public license"),
    ("cc0-1.0", "related or neighboring rights", "waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "no copyright", "cc0 1 0 universal no copyright"),
    ("cc-pdm", "publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("artistic-1.0", "standard version of this package", "you may make and give away verbatim copies of the source form of the standard version of this package without restriction"),
    ("artistic-2.0", "perl foundation", "artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("perl", "same terms as perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("python-2.0", "psf is making python available", "psf is making python available to licensee on an as is basis"),
    ("python-2.0", "psf license agreement", "psf license agreement for python"),
    ("php", "includes php software", "this product includes php software freely available from"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic software", "this product includes cryptographic software written by eric young"),
    ("w3c", "copying this work", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("ofl-1.1", "this font software", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "scripts sil org", "scripts sil org ofl"),
    ("eupl", "licensed under the eupl", "licensed under the eupl"),
    ("busl-1.1", "non production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1", "functionality of the program", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "right to sell the software", "the license does not grant to you the right to sell the software"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("beerware", "buy me a beer", "software (?:[^ ]+ ){0,40}you can buy me a beer"),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype project license", "freetype project license"),
    ("unicode", "data files and software", "unicode inc license agreement data files and software"),
    ("ruby", "ruby license", "ruby license"),
    ("vim", "vim is charityware", "vim is charityware"),
    ("mulan-psl-2.0", "mulan psl", "licensed under mulan psl v2"),
    ("odc-by-1.0", "open data commons", "open data commons attribution license"),
    ("odbl-1.0", "opendatacommons org", "opendatacommons org licenses odbl"),
    ("llama-community", "community license agreement", "llama (?:[0-9] )*community license agreement"),
    ("openrail", "responsible ai license", "responsible ai license"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|internal use|strict) license"),
    ("proprietary", "proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("proprietary", "confidential and proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "end user license agreement", "end user license agreement"),
    ("jquery", "jquery org license", "jquery org license"),
    ("android-sdk", "software development kit license", "android software development kit license agreement"),
    ("oracle-bcl", "binary code license", "binary code license agreement"),
]
#: Label, keyword and regex of notices that name no license.
NOTICES = [
    ("permission-notice", "permission is hereby granted", "permission is hereby granted free of charge"),
    ("redistribution-notice", "redistribution and use", "redistribution and use in source and binary forms"),
    ("warranty-disclaimer", "without warranty", "(?:as is )?without warranty of any kind"),
    ("warranty-disclaimer", "warranties of merchantability", "implied warranties of merchantability(?: and)? fitness for a particular purpose"),
    ("warranty-disclaimer", "warranty of merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("liability-disclaimer", "be liable for any", "in no event shall (?:[^ ]+ ){1,12}be liable for any(?: direct indirect incidental special exemplary or consequential damages| claim damages or other liability)?"),
    ("patent-grant", "patent license", "perpetual worldwide non exclusive no charge royalty free irrevocable patent license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("copyright", "copyright", "copyright(?: c)?(?: [12][0-9]{3})+"),
    ("public-domain", "public domain", "(?:placed in|dedicated to|in) the public domain"),
    ("licensed-under", "licen", "licen[cs]ed under(?: the)?(?: terms of)?(?: the)?"),
    ("licensed-under", "released under", "released under(?: the)?(?: terms of)?(?: the)?"),
    ("licensed-under", "distributed under", "distributed under(?: the)?(?: terms of)?(?: the)?"),
    ("dual-license", "dual licen", "dual licen[cs]ed"),
    ("license-notice", "licen", "(?:see|subject to|terms of) the(?: accompanying)? licen[cs]e(?: file)?"),
    ("license-notice", "licen", "licen[cs]e file in the root directory of this source tree"),
    ("license-notice", "can be found in the license", "can be found in the license file"),
    ("spdx", "spdx license identifier", "spdx license identifier [^ ]+(?: [0-9]+)*(?: only| or later)?(?: (?:and|or|with) [^ ]+(?: [0-9]+)*(?: only| or later)?)+"),
]
#: Words of the contract: phrase -> label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Every rule's match holds one of these.
GATES = ["licen", "spdx", "copyright", "public domain", "permission", "permitted", "redistribut", "warrant", "rights reserved", "gpl", "creative commons", "creativecommons", "released under", "distributed under", "software", "confidential", "exception", "classpath", "mozilla org", "eclipse org", "gnu org", "sil org", "boost org", "perl", "invariant sections", "liable", "cddl", "mpl", "package", "bison", "program", "autoconf", "consortium", "advertising", "charityware", "mit no attribution", "cc0", "product includes", "neighboring rights", "altered source", "png reference", "this work"]
#: A detection's worth by priority.
WORTH = [0.95, 0.8, 0.3]
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[dict]:
    """Every rule: priority (0 first), keyword, regex, label."""
    found = []

    def add(priority: int, keyword: str, pattern: str, label: str) -> None:
        found.append({"rule": len(found), "priority": priority, "keyword": keyword, "pattern": pattern, "label": label})

    for label, keyword, name, versions, spdx in FAMILIES:
        for version in filter(None, versions.split("|")):
            full = f"{label}-{version.replace(' ', '-' if 'clause' in version else '.')}"
            if "clause" in version:
                add(0, keyword, f"{version} {name} licen[cs]e", full)
            else:
                add(0, keyword, f"{name} licen[cs]e(?: v| ver| version)? {version}(?! [0-9])", full)
            if spdx:
                add(0, "spdx", f"spdx license identifier {spdx} {version}(?: only| or later| plus)?", full)
        if spdx and not versions:
            add(0, "spdx", f"spdx license identifier {spdx}", label)
        add(1, keyword, f"{name} licen[cs]e", label)
        add(1, keyword, f"licen[cs]ed under(?: the)?(?: terms of)?(?: the)? {name}", label)
        add(1, keyword, f"{name} licen[cs]ed", label)
    for label, keyword, pattern in SIGNATURES:
        add(0, keyword, pattern, label)
    for label, keyword, pattern in NOTICES:
        add(2, keyword, pattern, label)
    return found


def _rule_table() -> Column:
    """The rules by keyword, as one constant."""
    by: dict[str, list[dict]] = {}
    for r in rules():
        by.setdefault(r.pop("keyword"), []).append(r)
    table = [{"keyword": k, "rules": v} for k, v in by.items()]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<keyword:string,rules:array<struct<rule:int,priority:int,pattern:string,label:string>>>>")


def words_of(text: Column) -> Column:
    """A blank, the words in lower case with a blank between them, a blank. Lower case outside ASCII makes no ASCII letter but k, and leaves words words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAP, " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it: expressions inside lambda functions have no other way to share."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole(pattern) -> Column:
    """A rule's pattern as it stands in a text's words."""
    return F.concat(F.lit(" ("), pattern, F.lit(")(?= )"))


def places(words: Column, pattern: Column) -> Column:
    """array<struct<start, end>> of a pattern's matches, in words: matches get a sign in front and behind, and the signs' places among the words are theirs."""
    marked = F.split(F.trim(F.regexp_replace(words, whole(pattern), F.lit(" \x01$1\x02"))), " ")

    def ends(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when(F.startswith(x, F.lit("\x01")), i)), lambda i: i.isNotNull())
        stops = F.filter(F.transform(w, lambda x, i: F.when(F.endswith(x, F.lit("\x02")), i + 1)), lambda i: i.isNotNull())
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return once(marked, ends)


DETECTION = "array<struct<start:int,back:int,priority:int,rule:int,label:string>>"


def detections(words: Column) -> Column:
    """All matches of the rules whose keyword the words hold, by start, then the longest, then priority."""
    held = F.filter(_rule_table(), lambda k: F.contains(words, k["keyword"]))

    def of(rule: Column) -> Column:
        return F.transform(places(words, rule["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label")))

    tried = F.filter(F.flatten(F.transform(held, lambda k: k["rules"])), lambda r: F.rlike(words, whole(r["pattern"])))
    return F.array_sort(F.flatten(F.transform(tried, of)))


def uncontained(found: Column) -> Column:
    """Without the detections that another's interval holds and whose priority is no higher: ``m{p}`` is how far detections of priority p or
    higher reach that start no later. Appending copies an array, so n detections are gone through in runs of the root of n, each from the reach of the runs before."""
    reaches = lambda run: F.struct(*(F.array_max(F.transform(F.filter(run, lambda d: d["priority"] <= p), lambda d: -d["back"])).alias(f"m{p}") for p in range(3)))

    def step(s: Column, d: Column) -> Column:
        end = -d["back"]
        reach = F.when(d["priority"] == 0, s["m0"]).when(d["priority"] == 1, s["m1"]).otherwise(s["m2"])
        return F.struct(*(F.when(d["priority"] <= p, F.greatest(s[f"m{p}"], end)).otherwise(s[f"m{p}"]).alias(f"m{p}") for p in range(3)), F.when(reach >= end, s["kept"]).otherwise(F.concat(s["kept"], F.array(d))).alias("kept"))

    def kept(heads: Column, run: Column, i: Column) -> Column:
        before = lambda p: F.coalesce(F.array_max(F.transform(F.slice(heads, F.lit(1), i), lambda h: h[f"m{p}"])), F.lit(-1))
        start = F.struct(*(before(p).alias(f"m{p}") for p in range(3)), F.expr(f"cast(array() AS {DETECTION})").alias("kept"))
        return F.aggregate(run, start, step, lambda s: s["kept"])

    def by_runs(all_: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(all_))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(all_), n), lambda i: F.slice(all_, i, n))
        return once(runs, lambda r: once(F.transform(r, reaches), lambda heads: F.flatten(F.transform(r, lambda run, i: kept(heads, run, i)))))

    return once(found, lambda d: F.when(F.size(d) > 0, by_runs(d)).otherwise(d))


def scan_licenses(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_words, base (array<struct<start, end, label>>) and detections (start, back = -end, priority, rule, label)."""
    rows = docs.select(*keep, words_of(F.col(text_col)).alias("__words"))
    words = F.col("__words")
    gate = F.lit(False)
    for word in GATES:
        gate = gate | words.contains(word)
    # without a gate no rule is tried
    rows = rows.withColumn("__gated", F.when(gate, words))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(places(F.col("__gated"), F.lit(phrase)), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*(labelled(*x) for x in BASE)))
    none = F.expr("cast(array() AS array<struct<start:int,end:int,label:string>>)")
    rows = rows.withColumn("base", F.when(F.contains(F.col("__gated"), F.lit(" license ")), base).otherwise(none))
    rows = rows.withColumn("__all", F.when(F.col("__gated").isNotNull(), detections(F.col("__gated"))))
    kept = F.coalesce(uncontained(F.col("__all")), F.expr(f"cast(array() AS {DETECTION})"))
    n_words = F.when(words == "  ", 0).otherwise(_blanks(words) - 1).cast("long")
    return rows.select(*keep, n_words.alias("n_words"), "base", kept.alias("detections"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    label = lambda x: x["label"]
    base_labels = F.array_sort(F.array_distinct(F.transform("base", label)))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", label), F.transform("detections", label))))
    worth = F.concat(F.transform("base", lambda b: F.lit(WORTH[1])), F.transform("detections", lambda d: F.element_at(F.array(*map(F.lit, WORTH)), d["priority"] + 1)))
    starts = F.transform("base", lambda b: b["start"])
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce(F.array_max(worth), F.lit(0.0)).alias("score"))
