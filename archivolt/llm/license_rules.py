"""Signatures of licenses, written by hand: label, priority, keywords and pattern.

Patterns match words in lower case that single spaces part; a version 2.0 reads
"2 0". Each match of a pattern holds one of its keywords, which a bar parts.
Of the short forms, <under> is a grant, <lic> the word license, <v> an optional
"version" or "v", and <end> says that no further digit follows.

Priorities: 100 for a tag, 95 for a grant that names a version and for a
sentence that only one license has, 85 for a name with a version, 75 for a
grant without one, 70 for a sentence that a family shares, 60 for a bare name.
"""

from __future__ import annotations

SHORT = {
    "<under>": r"(?:licensed|released|distributed|published|provided|available|shared|offered) under (?:the )?(?:terms of (?:the )?)?",
    "<lic>": r"(?: public)? licen[sc]e",
    "<v>": r"(?: licen[sc]e)?(?: version| v)? ?v?",
    "<end>": r"(?! \d)",
}

RULES = [
    # Tags.
    ("mit", 100, "identifier mit", r"license identifier mit"),
    ("mit-0", 100, "identifier mit 0", r"license identifier mit 0"),
    ("apache-1.0", 100, "identifier apache", r"license identifier apache 1 0"),
    ("apache-1.1", 100, "identifier apache", r"license identifier apache 1 1"),
    ("apache-2.0", 100, "identifier apache", r"license identifier apache 2 0"),
    ("gpl-1.0", 100, "identifier gpl", r"license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", 100, "identifier gpl", r"license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", 100, "identifier gpl", r"license identifier gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", 100, "identifier lgpl", r"license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", 100, "identifier lgpl", r"license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", 100, "identifier lgpl", r"license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-1.0", 100, "identifier agpl", r"license identifier agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", 100, "identifier agpl", r"license identifier agpl 3 0(?: only| or later)?"),
    ("gfdl-1.1", 100, "identifier gfdl", r"license identifier gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", 100, "identifier gfdl", r"license identifier gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", 100, "identifier gfdl", r"license identifier gfdl 1 3(?: only| or later)?"),
    ("bsd-2-clause", 100, "identifier bsd", r"license identifier bsd 2 clause"),
    ("bsd-3-clause", 100, "identifier bsd", r"license identifier bsd 3 clause"),
    ("bsd-4-clause", 100, "identifier bsd", r"license identifier bsd 4 clause"),
    ("bsd-source-code", 100, "identifier bsd", r"license identifier bsd source code"),
    ("0bsd", 100, "identifier 0bsd", r"license identifier 0bsd"),
    ("mpl-1.0", 100, "identifier mpl", r"license identifier mpl 1 0"),
    ("mpl-1.1", 100, "identifier mpl", r"license identifier mpl 1 1"),
    ("mpl-2.0", 100, "identifier mpl", r"license identifier mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", 100, "identifier epl", r"license identifier epl 1 0"),
    ("epl-2.0", 100, "identifier epl", r"license identifier epl 2 0"),
    ("cddl-1.0", 100, "identifier cddl", r"license identifier cddl 1 0"),
    ("cddl-1.1", 100, "identifier cddl", r"license identifier cddl 1 1"),
    ("cpl-1.0", 100, "identifier cpl", r"license identifier cpl 1 0"),
    ("eupl-1.1", 100, "identifier eupl", r"license identifier eupl 1 1"),
    ("eupl-1.2", 100, "identifier eupl", r"license identifier eupl 1 2"),
    ("osl-3.0", 100, "identifier osl", r"license identifier osl 3 0"),
    ("afl-3.0", 100, "identifier afl", r"license identifier afl 3 0"),
    ("artistic-1.0", 100, "identifier artistic", r"license identifier artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", 100, "identifier artistic", r"license identifier artistic 2 0"),
    ("bsl-1.0", 100, "identifier bsl", r"license identifier bsl 1 0"),
    ("busl-1.1", 100, "identifier busl", r"license identifier busl 1 1"),
    ("sspl-1.0", 100, "identifier sspl", r"license identifier sspl 1 0"),
    ("isc", 100, "identifier isc", r"license identifier isc"),
    ("zlib", 100, "identifier zlib", r"license identifier zlib"),
    ("libpng", 100, "identifier libpng", r"license identifier libpng(?: 2 0)?"),
    ("wtfpl", 100, "identifier wtfpl", r"license identifier wtfpl"),
    ("unlicense", 100, "identifier unlicense", r"license identifier unlicense"),
    ("psf-2.0", 100, "identifier psf", r"license identifier psf 2 0"),
    ("python-2.0", 100, "identifier python", r"license identifier python 2 0(?: 1)?"),
    ("php-3.01", 100, "identifier php", r"license identifier php 3 01"),
    ("ruby", 100, "identifier ruby", r"license identifier ruby"),
    ("openssl", 100, "identifier openssl", r"license identifier openssl"),
    ("postgresql", 100, "identifier postgresql", r"license identifier postgresql"),
    ("ncsa", 100, "identifier ncsa", r"license identifier ncsa"),
    ("w3c", 100, "identifier w3c", r"license identifier w3c"),
    ("x11", 100, "identifier x11", r"license identifier x11"),
    ("ofl-1.1", 100, "identifier ofl", r"license identifier ofl 1 1(?: no)?(?: rfn)?"),
    ("lppl-1.3", 100, "identifier lppl", r"license identifier lppl 1 3[ac]?"),
    ("qpl-1.0", 100, "identifier qpl", r"license identifier qpl 1 0"),
    ("ms-pl", 100, "identifier ms", r"license identifier ms pl"),
    ("ms-rl", 100, "identifier ms", r"license identifier ms rl"),
    ("apsl-2.0", 100, "identifier apsl", r"license identifier apsl 2 0"),
    ("upl-1.0", 100, "identifier upl", r"license identifier upl 1 0"),
    ("ecl-2.0", 100, "identifier ecl", r"license identifier ecl 2 0"),
    ("mulan-psl-2.0", 100, "identifier mulan", r"license identifier mulanpsl 2 0"),
    ("odbl-1.0", 100, "identifier odbl", r"license identifier odbl 1 0"),
    ("odc-by-1.0", 100, "identifier odc", r"license identifier odc by 1 0"),
    ("pddl-1.0", 100, "identifier pddl", r"license identifier pddl 1 0"),
    ("cc0-1.0", 100, "identifier cc0", r"license identifier cc0 1 0"),
    ("cc-by-2.0", 100, "identifier cc by", r"license identifier cc by 2 0"),
    ("cc-by-3.0", 100, "identifier cc by", r"license identifier cc by 3 0"),
    ("cc-by-4.0", 100, "identifier cc by", r"license identifier cc by 4 0"),
    ("cc-by-sa-3.0", 100, "identifier cc by sa", r"license identifier cc by sa 3 0"),
    ("cc-by-sa-4.0", 100, "identifier cc by sa", r"license identifier cc by sa 4 0"),
    ("cc-by-nc-4.0", 100, "identifier cc by nc", r"license identifier cc by nc 4 0"),
    ("cc-by-nd-4.0", 100, "identifier cc by nd", r"license identifier cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", 100, "identifier cc by nc", r"license identifier cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 100, "identifier cc by nc", r"license identifier cc by nc nd 4 0"),
    ("blueoak-1.0.0", 100, "identifier blueoak", r"license identifier blueoak 1 0 0"),
    ("zpl-2.1", 100, "identifier zpl", r"license identifier zpl 2 1"),
    ("vim", 100, "identifier vim", r"license identifier vim"),
    ("curl", 100, "identifier curl", r"license identifier curl"),
    ("ijg", 100, "identifier ijg", r"license identifier ijg"),
    ("ftl", 100, "identifier ftl", r"license identifier ftl"),
    ("hpnd", 100, "identifier hpnd", r"license identifier hpnd"),
    ("beerware", 100, "identifier beerware", r"license identifier beerware"),
    # MIT and its kin.
    ("mit", 95, "to any person obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 70, "to any person obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 70, "shall be included in all copies or substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 70, "liable for any claim damages", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", 95, "no attribution", r"mit no attribution(?: license)?"),
    ("mit", 75, " mit ", r"<under>mit(?:<lic>)?"),
    ("mit", 75, "expat", r"<under>expat(?:<lic>)?"),
    ("mit", 60, " mit licen", r"mit licen[sc]e"),
    ("mit", 60, "expat licen", r"expat licen[sc]e"),
    ("mit", 60, "opensource org licenses mit", r"opensource org licenses mit(?: license php)?"),
    ("x11", 75, " x11 ", r"<under>x11(?:<lic>)?"),
    ("x11", 60, " x11 licen", r"x11 licen[sc]e"),
    ("x11", 95, "of the x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 95, "with or without fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 70, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 75, " isc ", r"<under>isc(?:<lic>)?"),
    ("isc", 60, " isc licen", r"isc licen[sc]e"),
    ("0bsd", 85, "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?:<lic>)?"),
    ("hpnd", 95, "supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("ncsa", 95, "deal with the software without restriction", r"to deal with the software without restriction including without limitation"),
    ("ncsa", 85, "university of illinois", r"university of illinois(?: ncsa)? open source<lic>"),
    ("ncsa", 75, " ncsa ", r"<under>(?:university of illinois )?ncsa(?:<lic>)?"),
    ("ncsa", 60, "ncsa", r"(?:ncsa open source|ncsa)<lic>"),
    ("curl", 95, "copyright and permission notice", r"copyright and permission notice copyright c 1996"),
    ("blueoak-1.0.0", 85, "blue oak", r"blue oak model<lic>(?: 1 0 0)?"),
    ("unlicense", 95, "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 85, "unlicense org", r"(?:please )?refer to http unlicense org"),
    ("unlicense", 75, "unlicense", r"<under>unlicense"),
    ("unlicense", 60, "the unlicense", r"the unlicense"),
    ("wtfpl", 95, "you just do what the", r"you just do what the fuck you want to"),
    ("wtfpl", 85, "do what the fuck you want to", r"do what the fuck you want to<lic>(?: version 2)?"),
    ("wtfpl", 75, "wtfpl", r"<under>wtfpl(?:<lic>)?"),
    ("wtfpl", 60, "wtfpl", r"wtfpl(?:<lic>)?"),
    ("beerware", 95, "buy me a beer", r"you can buy me a beer in return"),
    ("beerware", 60, "beer", r"(?:the )?beer ?ware<lic>"),
    # BSD.
    ("bsd-4-clause", 95, "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", 95, "endorse or promote products", r"neither the names? of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 70, "may be used to endorse or promote products", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", 70, "redistribution and use in source and binary", r"redistribution and use in source and binary forms with or without modification(?: are permitted)?"),
    ("bsd", 70, "redistributions in binary form must", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 70, "redistributions of source code must", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", 85, "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)<lic>"),
    ("bsd-2-clause", 95, "bsd", r"<under>(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?:<lic>)?"),
    ("bsd-3-clause", 85, "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)<lic>"),
    ("bsd-3-clause", 95, "bsd", r"<under>(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?:<lic>)?"),
    ("bsd-4-clause", 85, "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)<lic>"),
    ("bsd-4-clause", 95, "bsd", r"<under>(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?:<lic>)?"),
    ("bsd", 75, "bsd|berkeley software", r"<under>(?:bsd|berkeley software distribution)(?: style)?(?:<lic>)?|<under>berkeley bsd"),
    ("bsd", 60, "bsd", r"bsd(?: style)?<lic>"),
    ("bsd", 60, "opensource org licenses bsd", r"opensource org licenses bsd(?: license php)?"),
    # Apache.
    ("apache-2.0", 95, "may not use this file except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 95, "apache", r"<under>apache(?: software)?(?: public)?<v>2(?: 0)?<end>(?:<lic>)?"),
    ("apache-2.0", 85, "apache", r"apache(?: software)?<lic>(?: version| v)? ?v?2(?: 0)?<end>"),
    ("apache-2.0", 85, "apache", r"apache(?: version| v)? ?v?2(?: 0)?<lic>"),
    ("apache-2.0", 85, "apache org licenses license 2", r"(?:www )?apache org licenses license 2 0"),
    ("apache-1.1", 95, "apache", r"<under>apache(?: software)?<v>1 1(?:<lic>)?"),
    ("apache-1.1", 85, "apache", r"apache(?: software)?<lic>(?: version| v)? ?v?1 1"),
    ("apache-1.1", 95, "developed by the apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", 95, "apache", r"<under>apache(?: software)?<v>1 0(?:<lic>)?"),
    ("apache-1.0", 85, "apache", r"apache(?: software)?<lic>(?: version| v)? ?v?1 0"),
    ("apache-1.0", 95, "developed by the apache group", r"this product includes software developed by the apache group"),
    ("apache", 75, "apache", r"<under>apache(?: software)?(?:<lic>)?"),
    ("apache", 60, "apache", r"apache(?: software)?<lic>"),
    # GNU.
    ("gpl-2.0", 95, "either version 2 of the license", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", 95, "either version 3 of the license", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl", 70, "guarantee your freedom to share", r"the gnu general public license is intended to guarantee your freedom to share and change"),
    ("gpl-1.0", 95, "general public|gpl", r"<under>(?:gnu )?(?:general public|gpl)<v>1(?: 0)?<end>(?:<lic>)?"),
    ("gpl-2.0", 95, "general public|gpl", r"<under>(?:gnu )?(?:general public|gpl)<v>2(?: 0)?<end>(?:<lic>)?"),
    ("gpl-3.0", 95, "general public|gpl", r"<under>(?:gnu )?(?:general public|gpl)<v>3(?: 0)?<end>(?:<lic>)?"),
    ("gpl-1.0", 85, "general public|gpl", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?1(?: 0)?<end>"),
    ("gpl-2.0", 85, "general public|gpl", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?2(?: 0)?<end>"),
    ("gpl-3.0", 85, "general public|gpl", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?3(?: 0)?<end>"),
    ("gpl", 75, "general public|gpl", r"<under>(?:gnu )?(?:general public|gpl)(?:<lic>)?"),
    ("gpl", 60, "general public licen", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", 60, "gpl licen", r"(?:gnu )?gpl licen[sc]e"),
    ("gpl", 60, "gnu org licenses gpl", r"(?:www )?gnu org licenses gpl(?: \d 0)?(?: html| txt)?"),
    ("lgpl-2.0", 95, "library general|lgpl|lesser general", r"<under>(?:gnu )?(?:library general public|lesser general public|lgpl)<v>2(?: 0)?<end>(?:<lic>)?"),
    ("lgpl-2.1", 95, "lesser general|lgpl|library general", r"<under>(?:gnu )?(?:lesser general public|library general public|lgpl)<v>2 1(?:<lic>)?"),
    ("lgpl-3.0", 95, "lesser general|lgpl", r"<under>(?:gnu )?(?:lesser general public|lgpl)<v>3(?: 0)?<end>(?:<lic>)?"),
    ("lgpl-2.1", 95, "lesser general public license as published", r"gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", 95, "lesser general public license as published", r"gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-2.0", 95, "library general public license as published", r"gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl-2.1", 85, "lesser general|lgpl", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?2 1"),
    ("lgpl-2.0", 85, "library general|lgpl", r"(?:gnu )?(?:library general public license|lgpl)(?: version| v)? ?v?2(?: 0)?<end>"),
    ("lgpl-3.0", 85, "lesser general|lgpl", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?3(?: 0)?<end>"),
    ("lgpl", 75, "lesser general|library general|lgpl", r"<under>(?:gnu )?(?:lesser general public|library general public|lgpl)(?:<lic>)?"),
    ("lgpl", 60, "lesser general|library general", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl", 60, "lgpl licen", r"(?:gnu )?lgpl licen[sc]e"),
    ("agpl-3.0", 95, "affero|agpl", r"<under>(?:gnu )?(?:affero general public|agpl)<v>3(?: 0)?<end>(?:<lic>)?"),
    ("agpl-1.0", 95, "affero|agpl", r"<under>(?:gnu )?(?:affero general public|agpl)<v>1(?: 0)?<end>(?:<lic>)?"),
    ("agpl-3.0", 95, "affero general public license as published", r"gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", 85, "affero|agpl", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?v?3(?: 0)?<end>"),
    ("agpl", 75, "affero|agpl", r"<under>(?:gnu )?(?:affero general public|agpl)(?:<lic>)?"),
    ("agpl", 60, "affero general public licen", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", 60, "agpl licen", r"agpl licen[sc]e"),
    ("gfdl-1.1", 95, "free documentation|gfdl", r"<under>(?:gnu )?(?:free documentation|gfdl)<v>1 1"),
    ("gfdl-1.2", 95, "free documentation|gfdl", r"<under>(?:gnu )?(?:free documentation|gfdl)<v>1 2"),
    ("gfdl-1.3", 95, "free documentation|gfdl", r"<under>(?:gnu )?(?:free documentation|gfdl)<v>1 3"),
    ("gfdl-1.1", 85, "free documentation|gfdl", r"(?:gnu )?(?:free documentation license|gfdl)(?: version| v)? ?v?1 1"),
    ("gfdl-1.2", 85, "free documentation|gfdl", r"(?:gnu )?(?:free documentation license|gfdl)(?: version| v)? ?v?1 2"),
    ("gfdl-1.3", 85, "free documentation|gfdl", r"(?:gnu )?(?:free documentation license|gfdl)(?: version| v)? ?v?1 3"),
    ("gfdl", 95, "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", 75, "free documentation|gfdl", r"<under>(?:gnu )?(?:free documentation|gfdl)(?:<lic>)?"),
    ("gfdl", 60, "free documentation licen", r"(?:gnu )?free documentation licen[sc]e"),
    # Weak copyleft.
    ("mpl-2.0", 95, "mozilla public license v 2 0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 95, "mozilla public license version 1 1", r"subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 95, "mozilla| mpl", r"<under>(?:mozilla public|mpl)<v>2(?: 0)?<end>(?:<lic>)?"),
    ("mpl-1.1", 95, "mozilla| mpl", r"<under>(?:mozilla public|mpl)<v>1 1(?:<lic>)?"),
    ("mpl-1.0", 95, "mozilla| mpl", r"<under>(?:mozilla public|mpl)<v>1(?: 0)?<end>(?:<lic>)?"),
    ("mpl-2.0", 85, "mozilla| mpl", r"(?:mozilla public license|mpl)(?: version| v)? ?v?2(?: 0)?<end>"),
    ("mpl-1.1", 85, "mozilla| mpl", r"(?:mozilla public license|mpl)(?: version| v)? ?v?1 1"),
    ("mpl-1.0", 85, "mozilla| mpl", r"(?:mozilla public license|mpl)(?: version| v)? ?v?1 0"),
    ("mpl", 75, "mozilla| mpl", r"<under>(?:mozilla public|mpl)(?:<lic>)?"),
    ("mpl", 60, "mozilla public licen", r"mozilla public licen[sc]e"),
    ("epl-1.0", 95, "eclipse public license v1 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 95, "eclipse public license 2 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", 95, "eclipse public| epl", r"<under>(?:eclipse public|epl)<v>1(?: 0)?<end>(?:<lic>)?"),
    ("epl-2.0", 95, "eclipse public| epl", r"<under>(?:eclipse public|epl)<v>2(?: 0)?<end>(?:<lic>)?"),
    ("epl-1.0", 85, "eclipse public| epl", r"(?:eclipse public license|epl)(?: version| v)? ?v?1 0"),
    ("epl-2.0", 85, "eclipse public| epl", r"(?:eclipse public license|epl)(?: version| v)? ?v?2 0"),
    ("epl", 75, "eclipse public| epl", r"<under>(?:eclipse public|epl)(?:<lic>)?"),
    ("epl", 60, "eclipse public licen", r"eclipse public licen[sc]e"),
    ("edl-1.0", 85, "eclipse distribution licen", r"eclipse distribution license(?: version| v)? ?v?1 0"),
    ("edl", 60, "eclipse distribution licen", r"eclipse distribution licen[sc]e"),
    ("cddl-1.0", 95, "common development| cddl", r"<under>(?:common development and distribution|cddl)<v>1(?: 0)?<end>(?:<lic>)?"),
    ("cddl-1.1", 95, "common development| cddl", r"<under>(?:common development and distribution|cddl)<v>1 1(?:<lic>)?"),
    ("cddl-1.0", 85, "common development| cddl", r"(?:common development and distribution license(?: cddl)?|cddl)(?: version| v)? ?v?1 0"),
    ("cddl-1.1", 85, "common development| cddl", r"(?:common development and distribution license(?: cddl)?|cddl)(?: version| v)? ?v?1 1"),
    ("cddl", 75, "common development| cddl", r"<under>(?:common development and distribution|cddl)(?:<lic>)?"),
    ("cddl", 60, "common development and distribution licen", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", 85, "common public licen", r"common public license(?: version| v)? ?v?1 0"),
    ("cpl", 75, "common public", r"<under>common public(?:<lic>)?"),
    ("cpl", 60, "common public licen", r"common public licen[sc]e"),
    ("ipl-1.0", 85, "ibm public licen", r"ibm public license(?: version| v)? ?v?1 0"),
    ("ipl", 75, "ibm public", r"<under>ibm public(?:<lic>)?"),
    ("ipl", 60, "ibm public licen", r"ibm public licen[sc]e"),
    ("eupl-1.0", 85, "european union| eupl", r"(?:european union public licen[sc]e|eupl)(?: version| v)? ?v?1 0"),
    ("eupl-1.1", 85, "european union| eupl", r"(?:european union public licen[sc]e|eupl)(?: version| v)? ?v?1 1"),
    ("eupl-1.2", 85, "european union| eupl", r"(?:european union public licen[sc]e|eupl)(?: version| v)? ?v?1 2"),
    ("eupl-1.2", 95, "european union| eupl", r"<under>(?:european union public|eupl)<v>1 2"),
    ("eupl", 75, "european union| eupl", r"<under>(?:european union public|eupl)(?:<lic>)?"),
    ("eupl", 60, "european union public licen", r"european union public licen[sc]e"),
    ("osl-2.1", 85, "open software licen| osl", r"(?:open software license|osl)(?: version| v)? ?v?2 1"),
    ("osl-3.0", 85, "open software licen| osl", r"(?:open software license|osl)(?: version| v)? ?v?3(?: 0)?<end>"),
    ("osl-3.0", 95, "open software licen", r"licensed under the open software license version 3 0"),
    ("osl", 75, "open software| osl", r"<under>(?:open software|osl)(?:<lic>)?"),
    ("osl", 60, "open software licen", r"open software licen[sc]e"),
    ("afl-2.1", 85, "academic free| afl", r"(?:academic free license|afl)(?: version| v)? ?v?2 1"),
    ("afl-3.0", 85, "academic free| afl", r"(?:academic free license|afl)(?: version| v)? ?v?3(?: 0)?<end>"),
    ("afl-3.0", 95, "academic free licen", r"licensed under the academic free license version 3 0"),
    ("afl", 75, "academic free| afl", r"<under>(?:academic free|afl)(?:<lic>)?"),
    ("afl", 60, "academic free licen", r"academic free licen[sc]e"),
    ("artistic-1.0", 85, "artistic licen", r"artistic license(?: version| v)? ?v?1 0"),
    ("artistic-2.0", 85, "artistic licen", r"artistic license(?: version| v)? ?v?2(?: 0)?<end>"),
    ("artistic-1.0", 95, "semblance of artistic control", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic", 75, "artistic", r"<under>artistic(?:<lic>)?"),
    ("artistic", 60, "artistic licen", r"artistic licen[sc]e"),
    ("apsl-1.0", 85, "apple public source| apsl", r"(?:apple public source license|apsl)(?: version| v)? ?v?1 0"),
    ("apsl-2.0", 85, "apple public source| apsl", r"(?:apple public source license|apsl)(?: version| v)? ?v?2(?: 0)?<end>"),
    ("apsl", 75, "apple public source| apsl", r"<under>(?:apple public source|apsl)(?:<lic>)?"),
    ("apsl", 60, "apple public source licen", r"apple public source licen[sc]e"),
    ("qpl-1.0", 85, " q public| qpl", r"(?:q public license|qpl)(?: version| v)? ?v?1 0"),
    ("qpl", 60, " q public licen", r"q public licen[sc]e"),
    ("lppl-1.2", 85, "latex project| lppl", r"(?:latex project public license|lppl)(?: version| v)? ?v?1 2"),
    ("lppl-1.3", 85, "latex project| lppl", r"(?:latex project public license|lppl)(?: either)?(?: version| v)? ?v?1 3[ac]?"),
    ("lppl", 75, "latex project| lppl", r"<under>(?:latex project public|lppl)(?:<lic>)?"),
    ("lppl", 60, "latex project public licen", r"latex project public licen[sc]e"),
    ("npl-1.1", 85, "netscape public licen", r"netscape public license(?: version| v)? ?v?1 1"),
    ("npl", 60, "netscape public licen", r"netscape public licen[sc]e"),
    ("spl-1.0", 60, "sun public licen", r"sun public licen[sc]e(?: version 1 0)?"),
    ("sissl", 60, "sun industry standards", r"sun industry standards source<lic>"),
    ("rpl-1.5", 60, "reciprocal public licen", r"reciprocal public licen[sc]e(?: version)?(?: 1 5)?"),
    ("cecill-2.1", 85, "cecill", r"cecill(?: license| licence)?(?: version| v)? ?v?2 1"),
    ("cecill-b", 85, "cecill b", r"cecill b(?: free software)?<lic>"),
    ("cecill", 60, "cecill", r"cecill(?: free software)?<lic>"),
    # Permissive with a name of their own.
    ("bsl-1.0", 95, "boost software license version 1 0", r"distributed under the boost software license version 1 0"),
    ("bsl-1.0", 85, "boost", r"boost(?: software)? license(?: version| v)? ?v?1 0"),
    ("bsl", 75, "boost", r"<under>boost(?: software)?(?:<lic>)?"),
    ("bsl", 60, "boost", r"boost(?: software)?<lic>"),
    ("zlib", 95, "must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 70, "provided as is without any express", r"this software is provided as is without any express or implied warranty in no event"),
    ("zlib", 75, "zlib", r"<under>zlib(?: libpng)?(?:<lic>)?"),
    ("zlib", 60, "zlib", r"zlib(?: libpng)?<lic>"),
    ("libpng", 60, "libpng licen", r"libpng licen[sc]e"),
    ("ijg", 95, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", 95, "freetype project", r"portions of this software are copyright(?: c)? (?:\S+ ){1,4}freetype project"),
    ("ftl", 60, "freetype", r"freetype(?: project)?<lic>"),
    ("psf-2.0", 85, "python software foundation| psf", r"(?:python software foundation license|psf license)(?: version| v)? ?v?2(?: 0)?<end>"),
    ("psf", 75, "python software foundation| psf", r"<under>(?:python software foundation|psf)(?:<lic>)?"),
    ("psf", 60, "python software foundation licen", r"python software foundation licen[sc]e"),
    ("psf", 60, " psf licen", r"psf licen[sc]e"),
    ("php-3.0", 85, " php licen", r"php license(?: version| v)? ?v?3 0<end>"),
    ("php-3.01", 85, " php licen", r"php license(?: version| v)? ?v?3 01"),
    ("php", 75, " php ", r"<under>php(?:<lic>)?"),
    ("php", 60, " php licen", r"php licen[sc]e"),
    ("ruby", 75, " ruby ", r"<under>ruby(?:<lic>)?"),
    ("ruby", 60, " ruby licen", r"ruby licen[sc]e"),
    ("openssl", 95, "for use in the openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 75, "openssl", r"<under>openssl(?:<lic>)?"),
    ("openssl", 60, "openssl licen", r"openssl licen[sc]e"),
    ("postgresql", 75, "postgresql", r"<under>postgresql(?:<lic>)?"),
    ("postgresql", 60, "postgresql licen", r"postgresql licen[sc]e"),
    ("w3c", 75, "w3c", r"<under>w3c(?: software(?: notice and)?)?(?:<lic>)?"),
    ("w3c", 60, "w3c", r"w3c(?: software(?: notice and)?)?<lic>"),
    ("ofl-1.1", 95, "sil open font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 85, "open font| ofl", r"(?:sil )?(?:open font license|ofl)(?: version| v)? ?v?1 1"),
    ("ofl-1.0", 85, "open font| ofl", r"(?:sil )?(?:open font license|ofl)(?: version| v)? ?v?1 0"),
    ("ofl", 75, "open font| ofl", r"<under>(?:sil )?(?:open font|ofl)(?:<lic>)?"),
    ("ofl", 60, "open font licen", r"(?:sil )?open font licen[sc]e"),
    ("ms-pl", 75, "microsoft public| ms pl", r"<under>(?:microsoft public|ms pl)(?:<lic>)?"),
    ("ms-pl", 60, "microsoft public licen", r"microsoft public licen[sc]e(?: ms pl)?"),
    ("ms-rl", 75, "microsoft reciprocal| ms rl", r"<under>(?:microsoft reciprocal|ms rl)(?:<lic>)?"),
    ("ms-rl", 60, "microsoft reciprocal licen", r"microsoft reciprocal licen[sc]e(?: ms rl)?"),
    ("upl-1.0", 85, "universal permissive", r"universal permissive license(?: upl)?(?: version| v)? ?v?1 0"),
    ("upl", 60, "universal permissive licen", r"universal permissive licen[sc]e"),
    ("ecl-1.0", 85, "educational community licen", r"educational community license(?: version| v)? ?v?1 0"),
    ("ecl-2.0", 85, "educational community licen", r"educational community license(?: version| v)? ?v?2 0"),
    ("ecl", 60, "educational community licen", r"educational community licen[sc]e"),
    ("mulan-psl-1.0", 85, "mulan", r"mulan(?: permissive software license| psl)(?: mulan psl)?(?: version| v)? ?v?1(?: 0)?<end>"),
    ("mulan-psl-2.0", 85, "mulan", r"mulan(?: permissive software license| psl)(?: mulan psl)?(?: version| v)? ?v?2(?: 0)?<end>"),
    ("mulan-psl", 60, "mulan", r"mulan(?: permissive software license| psl)"),
    ("zpl-2.1", 85, "zope public", r"zope public license(?: zpl)?(?: version| v)? ?v?2 1"),
    ("zpl", 60, "zope public licen", r"zope public licen[sc]e"),
    ("vim", 60, " vim licen", r"vim licen[sc]e"),
    ("icu", 60, " icu licen", r"icu licen[sc]e"),
    ("unicode", 60, "unicode", r"unicode(?: inc)? license agreement"),
    ("naist-2003", 60, "naist", r"naist 2003<lic>|naist<lic>"),
    ("intel", 60, "intel open source licen", r"intel open source licen[sc]e"),
    ("nasa-1.3", 60, "nasa open source", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("tcl", 60, "tcl", r"tcl(?: tk)?<lic>"),
    # Source available.
    ("busl-1.1", 95, "business source licen", r"business source license(?: version)?(?: 1 1)? license text"),
    ("busl-1.1", 85, "business source| busl", r"(?:business source license|busl)(?: version| v)? ?v?1 1"),
    ("busl", 75, "business source| busl", r"<under>(?:business source|busl)(?:<lic>)?"),
    ("busl", 60, "business source licen", r"business source licen[sc]e"),
    ("sspl-1.0", 85, "server side public| sspl", r"(?:server side public license|sspl)(?: version| v)? ?v?1(?: 0)?<end>"),
    ("sspl", 75, "server side public| sspl", r"<under>(?:server side public|sspl)(?:<lic>)?"),
    ("sspl", 60, "server side public licen", r"server side public licen[sc]e"),
    ("elastic-2.0", 85, "elastic licen", r"elastic license(?: version| v)? ?v?2(?: 0)?<end>"),
    ("elastic", 60, "elastic licen", r"elastic licen[sc]e"),
    ("commons-clause", 85, "commons clause", r"commons clause license condition(?: v1 0)?"),
    ("commons-clause", 60, "commons clause", r"commons clause"),
    ("polyform-noncommercial-1.0.0", 85, "polyform", r"polyform noncommercial<lic>(?: 1 0 0)?"),
    ("polyform-small-business-1.0.0", 85, "polyform", r"polyform small business<lic>(?: 1 0 0)?"),
    # Data and content.
    ("odbl-1.0", 85, "open database| odbl", r"(?:open database license|odbl)(?: version| v)? ?v?1 0"),
    ("odbl", 75, "open database| odbl", r"<under>(?:open data commons )?(?:open database|odbl)(?:<lic>)?"),
    ("odbl", 60, "open database licen", r"(?:open data commons )?open database licen[sc]e"),
    ("odc-by-1.0", 85, "open data commons| odc by", r"(?:open data commons attribution license|odc by)(?: version| v)? ?v?1 0"),
    ("odc-by", 75, "open data commons| odc by", r"<under>(?:open data commons attribution|odc by)(?:<lic>)?"),
    ("odc-by", 60, "open data commons attribution licen", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", 85, "public domain dedication and| pddl", r"(?:public domain dedication and license|pddl)(?: version| v)? ?v?1 0"),
    ("pddl", 60, "public domain dedication and licen", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("cdla-permissive-2.0", 85, "community data license agreement", r"community data license agreement permissive(?: version)?(?: 2 0)?"),
    ("cdla-sharing-1.0", 85, "community data license agreement", r"community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("cc0-1.0", 95, " cc0|cc zero|creative commons zero", r"<under>(?:creative commons (?:cc0|zero)|cc0|cc zero)<v>1(?: 0)?<end>"),
    ("cc0-1.0", 85, "cc0 1 0", r"(?:creative commons )?cc0 1 0(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", 95, "waived all copyright and related", r"has waived all copyright and related or neighboring rights"),
    ("cc0", 75, " cc0|cc zero|creative commons zero", r"<under>(?:creative commons (?:cc0|zero)|cc0|cc zero)(?:<lic>)?"),
    ("cc0", 60, " cc0 licen", r"(?:creative commons )?cc0 licen[sc]e"),
    ("cc-by-2.0", 95, " cc by|creative commons", r"<under>(?:cc by|creative commons attribution)<v>2(?: 0)?<end>(?: international| generic)?(?:<lic>)?"),
    ("cc-by-2.5", 95, " cc by|creative commons", r"<under>(?:cc by|creative commons attribution)<v>2 5(?: generic)?(?:<lic>)?"),
    ("cc-by-3.0", 95, " cc by|creative commons", r"<under>(?:cc by|creative commons attribution)<v>3(?: 0)?<end>(?: unported)?(?:<lic>)?"),
    ("cc-by-4.0", 95, " cc by|creative commons", r"<under>(?:cc by|creative commons attribution)<v>4(?: 0)?<end>(?: international)?(?:<lic>)?"),
    ("cc-by-2.0", 85, " cc by|creative commons", r"(?:cc by|creative commons attribution)<v>2 0(?: generic)?(?:<lic>)?"),
    ("cc-by-2.5", 85, " cc by|creative commons", r"(?:cc by|creative commons attribution)<v>2 5(?: generic)?(?:<lic>)?"),
    ("cc-by-3.0", 85, " cc by|creative commons", r"(?:cc by|creative commons attribution)<v>3 0(?: unported)?(?:<lic>)?"),
    ("cc-by-4.0", 85, " cc by|creative commons", r"(?:cc by|creative commons attribution)<v>4 0(?: international)?(?:<lic>)?"),
    ("cc-by-sa-2.0", 95, " cc by sa|sharealike|share alike", r"<under>(?:cc by sa|creative commons attribution share ?alike)<v>2(?: 0)?<end>(?:<lic>)?"),
    ("cc-by-sa-2.5", 95, " cc by sa|sharealike|share alike", r"<under>(?:cc by sa|creative commons attribution share ?alike)<v>2 5(?:<lic>)?"),
    ("cc-by-sa-3.0", 95, " cc by sa|sharealike|share alike", r"<under>(?:cc by sa|creative commons attribution share ?alike)<v>3(?: 0)?<end>(?: unported)?(?:<lic>)?"),
    ("cc-by-sa-4.0", 95, " cc by sa|sharealike|share alike", r"<under>(?:cc by sa|creative commons attribution share ?alike)<v>4(?: 0)?<end>(?: international)?(?:<lic>)?"),
    ("cc-by-sa-3.0", 85, " cc by sa|sharealike|share alike", r"(?:cc by sa|creative commons attribution share ?alike)<v>3 0(?: unported)?(?:<lic>)?"),
    ("cc-by-sa-4.0", 85, " cc by sa|sharealike|share alike", r"(?:cc by sa|creative commons attribution share ?alike)<v>4 0(?: international)?(?:<lic>)?"),
    ("cc-by-nc-2.0", 95, " cc by nc|creative commons", r"<under>(?:cc by nc|creative commons attribution non ?commercial)<v>2(?: 0)?<end>(?:<lic>)?"),
    ("cc-by-nc-3.0", 95, " cc by nc|creative commons", r"<under>(?:cc by nc|creative commons attribution non ?commercial)<v>3(?: 0)?<end>(?: unported)?(?:<lic>)?"),
    ("cc-by-nc-4.0", 95, " cc by nc|creative commons", r"<under>(?:cc by nc|creative commons attribution non ?commercial)<v>4(?: 0)?<end>(?: international)?(?:<lic>)?"),
    ("cc-by-nc-4.0", 85, " cc by nc|creative commons", r"(?:cc by nc|creative commons attribution non ?commercial)<v>4 0(?: international)?(?:<lic>)?"),
    ("cc-by-nd-3.0", 95, " cc by nd|creative commons", r"<under>(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)<v>3(?: 0)?<end>(?:<lic>)?"),
    ("cc-by-nd-4.0", 95, " cc by nd|creative commons", r"<under>(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)<v>4(?: 0)?<end>(?: international)?(?:<lic>)?"),
    ("cc-by-nd-4.0", 85, " cc by nd|creative commons", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)<v>4 0(?: international)?(?:<lic>)?"),
    ("cc-by-nc-sa-2.0", 95, " cc by nc sa|creative commons", r"<under>(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)<v>2(?: 0)?<end>(?:<lic>)?"),
    ("cc-by-nc-sa-3.0", 95, " cc by nc sa|creative commons", r"<under>(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)<v>3(?: 0)?<end>(?: unported)?(?:<lic>)?"),
    ("cc-by-nc-sa-4.0", 95, " cc by nc sa|creative commons", r"<under>(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)<v>4(?: 0)?<end>(?: international)?(?:<lic>)?"),
    ("cc-by-nc-sa-4.0", 85, " cc by nc sa|creative commons", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)<v>4 0(?: international)?(?:<lic>)?"),
    ("cc-by-nc-nd-3.0", 95, " cc by nc nd|creative commons", r"<under>(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)<v>3(?: 0)?<end>(?:<lic>)?"),
    ("cc-by-nc-nd-4.0", 95, " cc by nc nd|creative commons", r"<under>(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)<v>4(?: 0)?<end>(?: international)?(?:<lic>)?"),
    ("cc-by-nc-nd-4.0", 85, " cc by nc nd|creative commons", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)<v>4 0(?: international)?(?:<lic>)?"),
    ("cc-by-nc-sa", 75, " cc by nc sa|creative commons", r"<under>(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?:<lic>)?"),
    ("cc-by-nc-nd", 75, " cc by nc nd|creative commons", r"<under>(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?:<lic>)?"),
    ("cc-by-nc", 75, " cc by nc|creative commons", r"<under>(?:cc by nc|creative commons attribution non ?commercial)(?:<lic>)?"),
    ("cc-by-nd", 75, " cc by nd|creative commons", r"<under>(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?:<lic>)?"),
    ("cc-by-sa", 75, " cc by sa|creative commons", r"<under>(?:cc by sa|creative commons attribution share ?alike)(?:<lic>)?"),
    ("cc-by", 75, " cc by|creative commons", r"<under>(?:cc by|creative commons attribution)(?:<lic>)?"),
    ("cc-by-nc-sa", 60, "creative commons attribution", r"creative commons attribution non ?commercial share ?alike<lic>"),
    ("cc-by-nc", 60, "creative commons attribution", r"creative commons attribution non ?commercial<lic>"),
    ("cc-by-sa", 60, "creative commons attribution", r"creative commons attribution share ?alike<lic>"),
    ("cc-by", 60, "creative commons attribution", r"creative commons attribution<lic>"),
    ("creative-commons", 60, "creative commons licen", r"creative commons licen[sc]e"),
    ("cc-by-4.0", 85, "creativecommons org licenses by 4", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 85, "creativecommons org licenses by 3", r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", 85, "creativecommons org licenses by sa", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 85, "creativecommons org licenses by sa", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", 85, "creativecommons org licenses by nc", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", 85, "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 85, "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", 85, "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0"),
    # Without a license's name.
    ("public-domain", 70, "public domain", r"(?:released|placed|dedicated) (?:in|into|in to|to) the public domain"),
    ("public-domain", 60, "public domain", r"(?:this (?:file|work|software|text)|it) is (?:hereby )?in the public domain"),
    ("all-rights-reserved", 70, "all rights reserved", r"all rights reserved"),
    ("proprietary", 70, "confidential and proprietary", r"confidential and proprietary"),
    ("proprietary", 70, "unauthorized copying", r"unauthorized copying of this (?:file|work|software) via any medium is strictly prohibited"),
    ("non-commercial", 60, "commercial use", r"for non ?commercial use only"),
    ("dual", 60, "dual licensed", r"dual licensed under"),
]
