"""License scans by ordered signature rules. DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import let


class Rule(NamedTuple):
    label: str
    priority: int  # 3: a whole license phrase, 2: a name or identifier, 1: a hint
    keyword: str  # a text without it, at a word's start, can't match
    pattern: str  # over lower-cased words joined by one space; starts and ends with whole words


# Signature rules in order. A version is written "2 0" or "2", as dots and dashes part words.
_V = r" (?:v(?:ersion)? ?)?"  # before a number: "2", "v2", "v 2" or "version 2"
SIGNATURES = [
    # whole phrases
    Rule("mit", 3, "mit license", r"(?:released|licensed|distributed|available|provided) under the (?:terms of the )?mit license"),
    Rule("mit", 3, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("isc", 3, "to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    Rule("apache-2", 3, "apache", r"licensed under the (?:terms of the )?apache license" + _V + r"2(?: 0)?"),
    Rule("apache-1", 3, "apache", r"(?:licensed under the )?apache (?:software )?license" + _V + r"1(?: [01])?"),
    Rule("gpl-3", 3, "general public", r"gnu general public license" + _V + r"3(?: 0)?(?: or (?:any )?later)?"),
    Rule("gpl-2", 3, "general public", r"gnu general public license" + _V + r"2(?: 0)?(?: or (?:any )?later)?"),
    Rule("gpl", 3, "general public", r"gnu general public license"),
    Rule("lgpl-3", 3, "general public", r"gnu (?:lesser|library) general public license" + _V + r"3(?: 0)?(?: or (?:any )?later)?"),
    Rule("lgpl-2.1", 3, "general public", r"gnu (?:lesser|library) general public license" + _V + r"2(?: [01])?(?: or (?:any )?later)?"),
    Rule("lgpl", 3, "general public", r"gnu (?:lesser|library) general public license"),
    Rule("agpl-3", 3, "general public", r"gnu affero general public license(?:" + _V + r"3(?: 0)?)?"),
    Rule("fdl", 3, "free documentation", r"gnu free documentation license(?:" + _V + r"1(?: [0-3])?)?"),
    Rule("bsd", 3, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("bsd-3", 3, "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    Rule("mpl-2", 3, "mozilla", r"mozilla public license" + _V + r"2(?: 0)?"),
    Rule("mpl-1", 3, "mozilla", r"mozilla public license" + _V + r"1(?: [01])?"),
    Rule("epl-2", 3, "eclipse", r"eclipse public license" + _V + r"2(?: 0)?"),
    Rule("epl-1", 3, "eclipse", r"eclipse public license" + _V + r"1(?: 0)?"),
    Rule("eupl", 3, "european union", r"european union public licen[cs]e(?:" + _V + r"1(?: [0-2])?)?"),
    Rule("cddl", 3, "common development", r"common development and distribution license(?:" + _V + r"1(?: [01])?)?"),
    Rule("unlicense", 3, "public domain", r"this is free and unencumbered software released into the public domain"),
    Rule("public-domain", 3, "public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    Rule("zlib", 3, "express or implied", r"this software is provided as is without any express or implied warranty"),
    Rule("wtfpl", 3, "do what", r"do what the fuck you want to public license"),
    Rule("bsl-1", 3, "boost", r"boost software license(?:" + _V + r"1(?: 0)?)?"),
    Rule("artistic-2", 3, "artistic", r"artistic license" + _V + r"2(?: 0)?"),
    Rule("artistic", 3, "artistic", r"artistic license"),
    Rule("psf", 3, "python software", r"python software foundation license(?:" + _V + r"2(?: 0)?)?"),
    Rule("ofl", 3, "open font", r"sil open font license(?:" + _V + r"1(?: [01])?)?"),
    Rule("odbl", 3, "open database", r"open (?:data commons open )?database license(?:" + _V + r"1(?: 0)?)?"),
    Rule("cc-by-nc-nd", 3, "attribution non", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s"),
    Rule("cc-by-nc-sa", 3, "attribution non", r"(?:creative commons )?attribution non ?commercial share ?alike"),
    Rule("cc-by-nc", 3, "attribution non", r"creative commons attribution non ?commercial"),
    Rule("cc-by-sa", 3, "creative commons", r"creative commons attribution share ?alike"),
    Rule("cc-by-nd", 3, "creative commons", r"creative commons attribution no ?deriv(?:ative)?s"),
    Rule("cc-by", 3, "creative commons", r"creative commons attribution"),
    Rule("cc0", 3, "creative commons", r"creative commons (?:zero|0|cc0)"),
    Rule("proprietary", 3, "all rights", r"all rights reserved"),
    Rule("isc", 3, "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    Rule("postgresql", 3, "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    Rule("hpnd", 3, "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    Rule("bsl-1", 3, "permission is hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    Rule("ofl", 3, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    Rule("unicode", 3, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    Rule("upl", 3, "subject to the condition", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy"),
    Rule("afl", 3, "licensed under the academic", r"licensed under the academic free license"),
    Rule("osl", 3, "licensed under the open", r"licensed under the open software license"),
    Rule("x11", 3, "except as contained", r"except as contained in this notice the name of the x consortium shall not be used"),
    Rule("json", 3, "the software shall", r"the software shall be used for good not evil"),
    Rule("beerware", 3, "buy me a beer", r"buy me a beer in return"),
    Rule("openssl", 3, "this product includes", r"this product includes software developed by the openssl project"),
    Rule("bsd-4", 3, "all advertising", r"all advertising materials mentioning features or use of this software must display"),
    Rule("curl", 3, "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    Rule("fsfap", 3, "copying and distribution", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    Rule("gpl", 3, "you can redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    Rule("lgpl", 3, "you can redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    Rule("agpl-3", 3, "you can redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    Rule("mpl-2", 3, "this source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    Rule("apache-2", 3, "unless required", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    Rule("cc0", 3, "to the extent possible", r"to the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright and related or neighboring rights"),
    Rule("python", 3, "psf hereby", r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    Rule("ijg", 3, "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    Rule("freetype", 3, "portions of this", r"portions of this software are copyright (?:[^ ]+ ){1,6}the freetype project"),
    Rule("sleepycat", 3, "redistributions in any", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    Rule("0bsd", 3, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    Rule("proprietary", 3, "confidential and", r"confidential and proprietary(?: information)?"),
    Rule("proprietary", 3, "proprietary and", r"proprietary and confidential(?: information)?"),
    Rule("proprietary", 3, "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:[^ ]+ ){0,6}(?:is )?(?:strictly )?prohibited"),
    Rule("proprietary", 3, "may not be reproduced", r"may not be reproduced (?:[^ ]+ ){0,8}without (?:the )?(?:prior |express |written ){1,3}permission"),
    # names and identifiers
    Rule("cc-by-nc-nd", 2, "cc by", r"cc by nc nd(?: [1-4](?: [05])?)?"),
    Rule("cc-by-nc-sa", 2, "cc by", r"cc by nc sa(?: [1-4](?: [05])?)?"),
    Rule("cc-by-nc", 2, "cc by", r"cc by nc(?: [1-4](?: [05])?)?"),
    Rule("cc-by-sa", 2, "cc by", r"cc by sa(?: [1-4](?: [05])?)?"),
    Rule("cc-by-nd", 2, "cc by", r"cc by nd(?: [1-4](?: [05])?)?"),
    Rule("cc-by", 2, "cc by", r"cc by(?: [1-4](?: [05])?)?"),
    Rule("cc0", 2, "cc0", r"cc0(?: 1(?: 0)?)?"),
    Rule("apache-2", 2, "apache", r"apache(?: license)?" + _V + r"2(?: 0)?"),
    Rule("apache", 2, "apache", r"apache license"),
    Rule("mit", 2, "mit license", r"(?:the )?mit license"),
    Rule("mit", 2, "expat", r"expat license"),
    Rule("isc", 2, "isc license", r"isc license"),
    Rule("bsd-2", 2, "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?"),
    Rule("bsd-3", 2, "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)(?: license)?"),
    Rule("bsd-4", 2, "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    Rule("bsd", 2, "bsd", r"bsd(?: style)? license"),
    Rule("gpl-3", 2, "gpl", r"(?:gnu )?(?:gpl" + _V + r"3(?: 0)?|gplv3)(?: only| or later)?"),
    Rule("gpl-2", 2, "gpl", r"(?:gnu )?(?:gpl" + _V + r"2(?: 0)?|gplv2)(?: only| or later)?"),
    Rule("lgpl-3", 2, "lgpl", r"(?:gnu )?(?:lgpl" + _V + r"3(?: 0)?|lgplv3)(?: only| or later)?"),
    Rule("lgpl-2.1", 2, "lgpl", r"(?:gnu )?(?:lgpl" + _V + r"2(?: [01])?|lgplv2)(?: only| or later)?"),
    Rule("agpl-3", 2, "agpl", r"(?:gnu )?(?:agpl" + _V + r"3(?: 0)?|agplv3)(?: only| or later)?"),
    Rule("mpl-2", 2, "mpl", r"mpl" + _V + r"2(?: 0)?"),
    Rule("epl", 2, "epl", r"epl" + _V + r"[12](?: 0)?"),
    Rule("wtfpl", 2, "wtfpl", r"wtfpl"),
    Rule("ms-pl", 2, "ms pl", r"ms pl"),
    Rule("ms-rl", 2, "ms rl", r"ms rl"),
    Rule("zlib", 2, "zlib", r"zlib license"),
    Rule("unlicense", 2, "unlicense", r"(?:the )?unlicense"),
    Rule("ofl", 2, "ofl", r"ofl" + _V + r"1(?: [01])?"),
    # hints
    Rule("spdx", 1, "spdx license", r"spdx license identifier(?: [a-z0-9]+)?"),
    Rule("copyright", 1, "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    Rule("other", 1, "licen", r"(?:licensed|released|distributed) under (?:the|a) (?:[a-z0-9]+ ){0,6}licen[cs]e"),
    Rule("other", 1, "licen", r"subject to the terms of (?:the|this) licen[cs]e"),
    Rule("other", 1, "licen", r"see the licen[cs]e(?: file)? for (?:more )?(?:details|information)"),
]

class Family(NamedTuple):
    label: str
    name: str  # a pattern; its longest plain part is the keyword
    short: str  # the abbreviation, which counts before a version, or ""
    versions: str


# Families of licenses, with the versions they exist in.
FAMILIES = [
    Family("0bsd", "(?:bsd )?zero clause(?: bsd)?(?: license)?", "", ""),
    Family("afl", "academic free license", "afl", "1.1 1.2 2.0 2.1 3.0"),
    Family("aladdin", "aladdin free public license", "afpl", "8 9"),
    Family("apsl", "apple public source license", "apsl", "1.0 1.1 1.2 2.0"),
    Family("arphic", "arphic public license", "", ""),
    Family("beerware", "beerware license", "", ""),
    Family("bitstream-vera", "bitstream vera(?: fonts?)? (?:license|copyright)", "", ""),
    Family("blueoak", "blue oak model license", "blueoak", "1.0.0"),
    Family("busl", "business source license", "busl", "1.0 1.1"),
    Family("cal", "cryptographic autonomy license", "", "1.0"),
    Family("cdla-permissive", "community data license agreement permissive", "cdla permissive", "1.0 2.0"),
    Family("cdla-sharing", "community data license agreement sharing", "cdla sharing", "1.0"),
    Family("cecill", "cecill(?: free software)? license(?: agreement)?", "cecill", "1.0 1.1 2.0 2.1"),
    Family("cecill-b", "cecill b(?: free software)?(?: license)?(?: agreement)?", "", ""),
    Family("cecill-c", "cecill c(?: free software)?(?: license)?(?: agreement)?", "", ""),
    Family("cern-ohl", "cern open hardware licen[cs]e", "cern ohl", "1.1 1.2 2"),
    Family("cern-ohl-p", "cern (?:ohl p|open hardware licen[cs]e version 2 permissive)", "cern ohl p", "2.0"),
    Family("cern-ohl-s", "cern (?:ohl s|open hardware licen[cs]e version 2 strongly reciprocal)", "cern ohl s", "2.0"),
    Family("cern-ohl-w", "cern (?:ohl w|open hardware licen[cs]e version 2 weakly reciprocal)", "cern ohl w", "2.0"),
    Family("clartistic", "clarified artistic license", "", ""),
    Family("cnri", "cnri (?:open source )?license(?: agreement)?", "", ""),
    Family("commons-clause", "commons clause(?: license)?(?: condition)?", "", "1.0"),
    Family("condor", "condor public license", "", "1.1"),
    Family("confluent", "confluent community license(?: agreement)?", "", "1.0"),
    Family("cpal", "common public attribution license", "cpal", "1.0"),
    Family("cpl", "common public license", "cpl", "0.5 1.0"),
    Family("curl", "curl license", "", ""),
    Family("d-fsl", "german free software license", "d fsl", "1.0"),
    Family("ecl", "educational community license", "ecl", "1.0 2.0"),
    Family("efl", "eiffel forum license", "efl", "1.0 2.0"),
    Family("elastic", "elastic license", "", "1.0 2.0"),
    Family("entessa", "entessa public license", "", "1.0"),
    Family("erlang", "erlang public license", "erlpl", "1.1"),
    Family("etalab", "(?:etalab )?licence ouverte", "etalab", "1.0 2.0"),
    Family("eu-datagrid", "eu datagrid software license", "", ""),
    Family("fair", "the fair license", "", ""),
    Family("frameworx", "frameworx open license", "", "1.0"),
    Family("freetype", "freetype(?: project)? license", "", ""),
    Family("fsfap", "fsf all permissive license", "", ""),
    Family("fsl", "functional source license", "fsl", "1.0 1.1"),
    Family("gemma", "gemma terms of use", "", ""),
    Family("gust-font", "gust font(?: source)? license", "", ""),
    Family("hippocratic", "hippocratic license", "", "1.0 2.1 3.0"),
    Family("hpnd", "historical permission notice and disclaimer", "", ""),
    Family("icu", "icu license", "", ""),
    Family("ijg", "independent jpeg group(?: s)? license", "", ""),
    Family("imagemagick", "imagemagick license", "", ""),
    Family("info-zip", "info zip license", "", ""),
    Family("intel", "intel open source license", "", ""),
    Family("interbase", "interbase public license", "", "1.0"),
    Family("ipa", "ipa font license(?: agreement)?", "", "1.0"),
    Family("ipl", "ibm public license", "ipl", "1.0"),
    Family("jasper", "jasper license", "", "2.0"),
    Family("json", "json license", "", ""),
    Family("libpng", "libpng license", "libpng", "2.0"),
    Family("liliq-p", "liliq p", "", "1.1"),
    Family("liliq-r", "liliq r", "", "1.1"),
    Family("llama", "llama(?: [0-9])*(?: community)? license(?: agreement)?", "", ""),
    Family("lpl", "lucent public license", "lpl", "1.0 1.02"),
    Family("lppl", "latex project public license", "lppl", "1.0 1.1 1.2 1.3a 1.3c"),
    Family("miros", "miros licen[cs]e", "", ""),
    Family("motosoto", "motosoto open source license", "", "0.9.1"),
    Family("mpich", "mpich2? license", "", ""),
    Family("ms-pl", "microsoft public license", "", ""),
    Family("ms-rl", "microsoft reciprocal license", "", ""),
    Family("mulanpsl", "mulan permissive software license", "mulanpsl", "1.0 2.0"),
    Family("multics", "multics license", "", ""),
    Family("nasa", "nasa open source agreement", "nosa", "1.3"),
    Family("naumen", "naumen public license", "", ""),
    Family("ncsa", "(?:university of illinois )?ncsa open source license", "", ""),
    Family("netcdf", "netcdf license", "", ""),
    Family("ngpl", "nethack general public license", "", ""),
    Family("nokia", "nokia open source license", "nokos", "1.0"),
    Family("npl", "netscape public license", "npl", "1.0 1.1"),
    Family("nposl", "non profit open software license", "nposl", "3.0"),
    Family("ntp", "ntp license", "", ""),
    Family("oclc", "oclc research public license", "", "2.0"),
    Family("odc-by", "open data commons attribution license", "odc by", "1.0"),
    Family("ogl", "open government licen[cs]e", "ogl", "1.0 2.0 3.0"),
    Family("openldap", "openldap public license", "oldap", "1.1 1.2 2.0 2.1 2.2 2.3 2.4 2.5 2.6 2.7 2.8"),
    Family("openrail", "(?:creativeml |bigscience )?open ?rail(?: m)? license", "", ""),
    Family("openssl", "openssl license", "", ""),
    Family("opl", "open publication license", "", "1.0"),
    Family("oset-pl", "oset public license", "", "2.1"),
    Family("osl", "open software license", "osl", "1.0 1.1 2.0 2.1 3.0"),
    Family("parity", "parity public license", "", "6.0.0 7.0.0"),
    Family("pddl", "public domain dedication and licen[cs]e", "pddl", "1.0"),
    Family("php", "php license", "", "3.0 3.01"),
    Family("polyform-internal-use", "polyform internal use license", "", "1.0.0"),
    Family("polyform-noncommercial", "polyform noncommercial license", "", "1.0.0"),
    Family("polyform-perimeter", "polyform perimeter license", "", "1.0.0"),
    Family("polyform-shield", "polyform shield license", "", "1.0.0"),
    Family("polyform-small-business", "polyform small business license", "", "1.0.0"),
    Family("polyform-strict", "polyform strict license", "", "1.0.0"),
    Family("postgresql", "postgresql licen[cs]e", "", ""),
    Family("prosperity", "prosperity public license", "", "2.0.0 3.0.0"),
    Family("qhull", "qhull license", "", ""),
    Family("qpl", "q public license", "qpl", "1.0"),
    Family("redis", "redis source available license(?: agreement)?", "rsal", "1 2"),
    Family("rpl", "reciprocal public license", "rpl", "1.1 1.5"),
    Family("rpsl", "realnetworks public source license", "rpsl", "1.0"),
    Family("rscpl", "ricoh source code public license", "rscpl", "1.0"),
    Family("ruby", "ruby license", "", ""),
    Family("sendmail", "sendmail license", "", ""),
    Family("sgi-b", "sgi free software license b", "", "1.0 1.1 2.0"),
    Family("simpl", "simple public license", "simpl", "2.0"),
    Family("sissl", "sun industry standards source license", "sissl", "1.1 1.2"),
    Family("sleepycat", "sleepycat(?: public)? license", "", ""),
    Family("solderpad", "solderpad hardware licen[cs]e", "shl", "0.5 0.51 2.0 2.1"),
    Family("spl", "sun public license", "", "1.0"),
    Family("sspl", "server side public license", "sspl", "1"),
    Family("sugarcrm", "sugarcrm public license", "", "1.1.3"),
    Family("tapr", "tapr open hardware license", "", "1.0"),
    Family("tcl", "tcl(?: tk)? license", "", ""),
    Family("timescale", "timescale license(?: agreement)?", "", ""),
    Family("ubuntu-font", "ubuntu font licen[cs]e", "", "1.0"),
    Family("ucl", "upstream compatibility license", "", "1.0"),
    Family("unicode", "unicode license(?: agreement)?", "", ""),
    Family("upl", "universal permissive license", "upl", "1.0"),
    Family("vim", "vim license", "", ""),
    Family("vsl", "vovida software license", "vsl", "1.0"),
    Family("w3c", "w3c software(?: notice)?(?: and document)?(?: notice)?(?: and)? license", "", ""),
    Family("watcom", "sybase open watcom public license", "", "1.0"),
    Family("x11", "x11 license", "", ""),
    Family("xfree86", "xfree86 license", "", "1.0 1.1"),
    Family("xnet", "x net license", "", ""),
    Family("ypl", "yahoo public license", "", "1.0 1.1"),
    Family("zend", "zend(?: engine)? license", "", "2.0"),
    Family("zpl", "zope public license", "zpl", "1.1 2.0 2.1"),
]

# What follows "SPDX-License-Identifier:" for the labels that are no families.
IDENTIFIERS = [
    ("mit", "mit(?: 0)?"), ("isc", "isc"), ("apache-1", "apache 1 [01]"), ("apache-2", "apache 2 0"), ("bsd-2", "bsd 2 clause(?: patent)?"),
    ("bsd-3", "bsd 3 clause(?: clear)?"), ("bsd-4", "bsd 4 clause"), ("gpl-2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl 3 0(?: only| or later)?"), ("lgpl-2.1", "lgpl 2 [01](?: only| or later)?"), ("lgpl-3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl 3 0(?: only| or later)?"), ("fdl", "gfdl 1 [123](?: only| or later)?"), ("mpl-1", "mpl 1 [01]"), ("mpl-2", "mpl 2 0"),
    ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"), ("eupl", "eupl 1 [012]"), ("cddl", "cddl 1 [01]"), ("unlicense", "unlicense"), ("zlib", "zlib"),
    ("wtfpl", "wtfpl"), ("bsl-1", "bsl 1 0"), ("artistic", "artistic 1 0"), ("artistic-2", "artistic 2 0"), ("psf", "(?:psf|python) 2 0"),
    ("ofl", "ofl 1 [01]"), ("odbl", "odbl 1 0"), ("cc0", "cc0 1 0"), ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]"), ("cc-by-nc", "cc by nc [1-4] [05]"), ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"),
]


def _plain(pattern: str) -> str:
    """The longest part of ``pattern`` that every match holds at a word's start."""
    parts = re.split(r"\((?:[^()]|\([^()]*\))*\)[?*]?|\[[^]]*\]|.\?", pattern)
    return max((p.strip() for p in parts), key=len)


def _number(version: str) -> str:
    """A version's words; zeros at its end may be missing."""
    words, tail = version.split("."), ""
    while len(words) > 1 and words[-1] == "0":
        tail = f"(?: {words.pop()}{tail})?"
    return " ".join(words) + tail


def _identifier(label: str, name: str) -> Rule:
    pattern = f"spdx license identifier {name}"
    return Rule(label, 2, _plain(pattern), pattern)


def _family(f: Family) -> Iterator[Rule]:
    """A family's rules: its name, the name and the abbreviation before each version, and its identifiers."""
    key, ids = _plain(f.name), f.short or f.label.replace("-", " ")
    yield Rule(f.label, 2, key, f.name)
    yield _identifier(f.label, ids)
    for v in f.versions.split():
        label, number = f"{f.label}-{v}", _number(v)
        yield Rule(label, 2, key, f.name + _V + number)
        yield _identifier(label, f"{ids} {number}(?: only| or later)?")
        if f.short:
            yield Rule(label, 2, f"{f.short} ", f.short + _V + number)


RULES = [
    *SIGNATURES,
    *(_identifier(label, name) for label, name in IDENTIFIERS),
    *(r for f in FAMILIES for r in _family(f)),
]
KINDS = 3  # priorities

# Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

CHUNK = 512  # hits that a sweep gathers in one array
_HIT = "struct<first: int, last: int, label: string, priority: int, rule: int>"


def normal(text: Column) -> Column:
    """A-Z lower-cased, words (of digits, a-z and all beyond ASCII) between single spaces, one at each end."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _starts(norm: Column, look: Column) -> Column:
    """Word numbers (from 0) at which the lookahead pattern ``look`` holds: a mark before the space there ends the word before."""
    pieces = F.split(F.regexp_replace(norm, look, F.lit("\x01")), " ")
    return F.filter(F.transform(pieces, lambda p, i: F.when(F.endswith(p, F.lit("\x01")), i)), lambda i: i.isNotNull())


def base_places(norm: Column) -> Column:
    """The base phrases' places (also overlapping ones), unsorted."""

    def places(phrase: str, label: str) -> Column:
        at = let(norm, lambda t: _starts(t, F.lit(f"(?= {phrase} )")))
        hits = F.transform(at, lambda i: F.struct(i.alias("first"), F.lit(label).alias("label")))
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), hits).otherwise(F.array().cast("array<struct<first: int, label: string>>"))

    return F.concat(*[places(p, label) for p, label in BASE])


def detections(norm: Column) -> Column:
    """All rule matches of a text whose keyword it holds, as words ``first`` to ``last``.

    Matches of one rule do not overlap one another. The rules are literal arrays, so that the plan has one
    expression for all of them; only those whose keyword occurs reach the regular expressions.
    """

    def listed(values: Iterable[str]) -> Column:  # one literal, which the optimizer splits once
        return F.split(F.lit("\n".join(values)), "\n")

    keys, patterns = listed(f" {r.keyword}" for r in RULES), listed(f" {r.pattern}(?= )" for r in RULES)
    labels, ranks = listed(r.label for r in RULES), listed(str(r.priority) for r in RULES).cast("array<int>")

    def matches(text: Column, r: Column) -> Column:
        # \x01 before a match's first space, \x02 after its last word: no words hold these. Piece i is word i - 1.
        marked = F.regexp_replace(text, F.get(patterns, r), F.lit("\x01$0\x02"))

        def at(pieces: Column, mark: str) -> Column:
            return F.filter(F.transform(pieces, lambda p, i: F.when(F.contains(p, F.lit(mark)), i)), lambda i: i.isNotNull())

        def placed(pieces: Column) -> Column:
            return let(at(pieces, "\x02"), lambda ends: F.transform(at(pieces, "\x01"), lambda first, j: F.struct(
                first.alias("first"), (F.get(ends, j) - 1).alias("last"), F.get(labels, r).alias("label"),
                F.get(ranks, r).alias("priority"), r.alias("rule"),
            )))

        none = F.array().cast(f"array<{_HIT}>")
        return let(marked, lambda m: F.when(F.contains(m, F.lit("\x01")), let(F.split(m, " "), placed)).otherwise(none))

    def all_(text: Column) -> Column:
        open_ = F.filter(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda r: F.contains(text, F.get(keys, r)))
        return F.flatten(F.transform(open_, lambda r: matches(text, r)))

    return let(norm, all_)


def _sweep(items: Column, start: list[Column], step: Callable[[Column, Column], tuple[list[Column], Column]]) -> Column:
    """The hits of ``items`` that ``step`` keeps, in order; it gives the next state's fields and whether to keep.

    Appending to an array copies it, so a chunk's hits are gathered alone and the chunks' arrays at the end.
    """
    none = F.array().cast(f"array<{_HIT}>")

    def one(s: Column, x: Column) -> Column:
        state, keep = step(s, x["h"])
        return F.struct(*state, F.when(keep, F.concat(s["kept"], F.array(x["h"]))).otherwise(s["kept"]).alias("kept"))

    def chunked(all_: Column) -> Column:
        froms = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        names = [f"e{p}" for p in range(1, KINDS + 1)]

        def chunk(s: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(all_, at, F.lit(CHUNK)), F.struct(*[s[n].alias(n) for n in names], none.alias("kept")), one)
            return let(inner, lambda r: F.struct(*[r[n].alias(n) for n in names], F.concat(s["parts"], F.array(r["kept"])).alias("parts")))

        first = F.struct(*start, F.array().cast(f"array<array<{_HIT}>>").alias("parts"))
        return F.aggregate(froms, first, chunk, lambda s: F.flatten(s["parts"]))

    return let(items, chunked)


def unsuppressed(hits: Column) -> Column:
    """``hits`` without those inside one of the same or a higher priority, and those around one of a higher priority.

    Two sweeps. By start, longest first: a hit lies inside an earlier one that ends no sooner, so the furthest
    end for each priority is enough. From the last start, shortest first: a hit lies around an
    earlier one that ends no later. Of equal intervals the higher priority stays, then the earlier rule.
    """
    order = F.transform(hits, lambda h: F.struct(h["first"].alias("a"), (-h["last"]).alias("b"), (-h["priority"]).alias("c"), h["rule"].alias("d"), h.alias("h")))
    kinds = range(1, KINDS + 1)

    def inside(s: Column, h: Column) -> tuple[list[Column], Column]:
        reach = F.greatest(F.lit(-1), *[F.when(h["priority"] <= p, s[f"e{p}"]).otherwise(-1) for p in kinds])
        ends = [F.when(h["priority"] == p, F.greatest(s[f"e{p}"], h["last"])).otherwise(s[f"e{p}"]).alias(f"e{p}") for p in kinds]
        return ends, reach < h["last"]

    outer = _sweep(F.sort_array(order), [F.lit(-1).alias(f"e{p}") for p in kinds], inside)
    never = 1 << 30

    def around(s: Column, h: Column) -> tuple[list[Column], Column]:
        soonest = F.least(F.lit(never), *[F.when(h["priority"] < p, s[f"e{p}"]).otherwise(never) for p in kinds])
        ends = [F.when(h["priority"] == p, F.least(s[f"e{p}"], h["last"])).otherwise(s[f"e{p}"]).alias(f"e{p}") for p in kinds]
        return ends, soonest > h["last"]

    back = F.sort_array(F.transform(outer, lambda h: F.struct((-h["first"]).alias("a"), h["last"].alias("b"), h.alias("h"))))
    return F.reverse(_sweep(back, [F.lit(never).alias(f"e{p}") for p in kinds], around))


def _gate() -> str:
    """One pattern for the keywords of all rules and base phrases, by first letter, tried at word starts only."""
    words = sorted({r.keyword for r in RULES} | {p for p, _ in BASE})
    least = [w for i, w in enumerate(words) if not any(w.startswith(v) for v in words[:i])]
    return " (?:" + "|".join(f"{a}(?:{'|'.join(w[1:] for w in group)})" for a, group in groupby(least, lambda w: w[0])) + ")"


def _labels(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(names)), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Base phrases are all counted. Signature rules (``RULES``) add labels: a rule's regular expression runs where
    its keyword occurs; of overlapping matches, those inside one of higher rank go. ``score``: the
    share of the text's words that base places and kept detections of whole phrases and names cover, 0 without words.

    A null text is empty: no words, no labels (empty strings), null first and last word. Columns of
    the new names are replaced; every row is judged alone, so repeated rows agree.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    rows = docs.select(*keep, normal(F.col(text)).alias("_norm"))
    words = F.regexp_count(F.col("_norm"), F.lit(r"[^ ]+"))
    holds = F.col("_norm").rlike(_gate())
    none = F.array().cast(f"array<{_HIT}>")
    rows = rows.select(
        *keep, words.cast("long").alias("n_words"),
        F.when(holds, base_places(F.col("_norm"))).otherwise(F.array().cast("array<struct<first: int, label: string>>")).alias("_base"),
        F.when(holds, unsuppressed(detections(F.col("_norm")))).otherwise(none).alias("detections"),
    )
    firsts = F.transform("_base", lambda b: b["first"])
    base_names = F.transform("_base", lambda b: b["label"])
    width = F.create_map(*[F.lit(x) for p, label in BASE for x in (label, len(p.split()))])
    spans = F.concat(
        F.transform("_base", lambda b: F.struct(b["first"].alias("a"), (b["first"] + width[b["label"]]).alias("b"))),
        F.transform(F.filter("detections", lambda h: h["priority"] > 1), lambda h: F.struct(h["first"].alias("a"), (h["last"] + 1).alias("b"))),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    covered = F.aggregate(
        F.sort_array(spans), start,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["b"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("sum")
        ),
        lambda s: s["sum"],
    )
    return rows.select(
        *keep, "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(firsts).cast("long").alias("first_word"),
        F.array_max(firsts).cast("long").alias("last_word"), _labels(base_names).alias("base_labels"),
        _labels(F.concat(base_names, F.transform("detections", lambda h: h["label"]))).alias("labels"),
        F.when(F.col("n_words") > 0, F.least(F.lit(1.0), covered / F.col("n_words"))).otherwise(0.0).alias("score"), "detections",
    )
