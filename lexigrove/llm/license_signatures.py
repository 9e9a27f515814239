"""The license scan's signatures, written by hand, in order.

A signature is (label, priority, keyword, pattern).  In patterns a blank is white
space, with comment marks between; "license" is spelt with c or s; ~ is an optional
quotation mark; $ ends a number (2$ doesn't take 2.1); ^ and @ are edges of a word
or id.  The keyword is a literal part of everything the pattern can match.

Priorities: 95 SPDX tags, 90 sentences of a license's own body, 85 notices that apply
a license, 70 names with a version, 60 addresses, 50 ids that only licenses have,
30 names alone, 20 mere hints.  Ids that are also common words or products (php, afl,
epl, attribution, apache) count only beside a word that speaks of licensing.
"""

SIGNATURES = (
    # MIT and its relatives
    ("mit", 90, "hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", 90, "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", 88, "merchantability, fitness", r"the software is provided ~as is~,? without warranty of any kind,? express or implied,? including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", 95, "spdx", r"spdx-license-identifier: \(?mit@"),
    ("mit", 85, "mit", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit(?: license)?@"),
    ("mit", 60, "opensource.org", r"opensource\.org/licenses?/mit"),
    ("mit", 50, "mit", r"^mit[ -]licensed@"),
    ("mit", 50, "expat", r"^expat license@"),
    ("mit", 45, "mit", r"license ?[:=] ?~mit~@"),
    ("mit", 30, "mit", r"^mit license@"),
    ("mit-0", 95, "mit-0", r"spdx-license-identifier: \(?mit-0@"),
    ("mit-0", 70, "no attribution", r"^mit no attribution@"),
    ("mit-0", 50, "mit-0", r"^mit-0@"),
    ("x11", 90, "shall not be used in advertising", r"except as contained in this notice,? the name(?:s|\(s\))? of .{1,80}? shall not be used in advertising or otherwise to promote the sale"),
    ("x11", 30, "x11", r"^x11 license@"),
    ("hpnd", 90, "hereby granted", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("isc", 90, "with or without fee is hereby", r"permission to use,? copy,? modify,? and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 85, "permission to use", r"permission to use,? copy,? modify,? and/?(?:or)? distribute this software for any purpose"),
    ("isc", 88, "all warranties with regard", r"disclaims? all warranties with regard to this software"),
    ("isc", 95, "spdx", r"spdx-license-identifier: \(?isc@"),
    ("isc", 60, "opensource.org", r"opensource\.org/licenses?/isc"),
    ("isc", 30, "isc", r"^isc license@"),
    ("0bsd", 95, "0bsd", r"spdx-license-identifier: \(?0bsd@"),
    ("0bsd", 70, "bsd", r"(?:zero[ -]clause|0-clause) bsd(?: license)?@"),
    ("0bsd", 50, "0bsd", r"^0bsd@"),
    # BSD
    ("bsd", 90, "redistribution and use", r"redistribution and use in source and binary forms"),
    ("bsd", 88, "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 88, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 80, "in no event shall", r"in no event shall the (?:copyright (?:owner|holders?)|regents) or contributors be liable"),
    ("bsd-3-clause", 91, "endorse or promote", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software without"),
    ("bsd-4-clause", 91, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-patent", 91, "patent license", r"subject to the terms and conditions of this license, each copyright holder and contributor hereby grants .{1,120}? patent license"),
    ("bsd-2-clause-views", 91, "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-3-clause-clear", 91, "no express or implied", r"no express or implied licenses to any party'?s patent rights are granted by this license"),
    ("bsd-2-clause", 95, "bsd-2-clause", r"spdx-license-identifier: \(?bsd-2-clause@"),
    ("bsd-3-clause", 95, "bsd-3-clause", r"spdx-license-identifier: \(?bsd-3-clause@"),
    ("bsd-4-clause", 95, "bsd-4-clause", r"spdx-license-identifier: \(?bsd-4-clause@"),
    ("bsd-2-clause", 70, "bsd", r"(?:2-clause|two[ -]clause|simplified|freebsd) bsd license@"),
    ("bsd-2-clause", 50, "bsd", r"^bsd[ -]2[ -]clause@"),
    ("bsd-3-clause", 70, "bsd", r"(?:3-clause|three[ -]clause|new|modified|revised) bsd license@"),
    ("bsd-3-clause", 50, "bsd", r"^bsd[ -]3[ -]clause@"),
    ("bsd-4-clause", 70, "bsd", r"(?:4-clause|four[ -]clause|original|old) bsd license@"),
    ("bsd-3-clause", 60, "opensource.org", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-2-clause", 60, "opensource.org", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd", 85, "bsd-style", r"(?:use of this source code is )?governed by a bsd-style license@"),
    ("bsd", 30, "bsd", r"^bsd(?:-style)? license@"),
    # Apache
    ("apache-2.0", 90, "reproduction, and distribution", r"terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", 90, "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 88, "either express or implied", r"distributed on an ~as is~ basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-2.0", 85, "apache", r"licensed under the apache license,? (?:version|v\.?) ?2(?:\.0)?$"),
    ("apache-2.0", 95, "apache-2.0", r"spdx-license-identifier: \(?apache-2\.0@"),
    ("apache-1.1", 95, "apache-1.1", r"spdx-license-identifier: \(?apache-1\.1@"),
    ("apache-2.0", 70, "apache", r"^apache (?:software )?license,? \(?(?:version|v\.?)? ?2(?:\.0)?$"),
    ("apache-1.1", 70, "apache", r"^apache (?:software )?license,? \(?(?:version|v\.?)? ?1\.1$"),
    ("apache-1.0", 70, "apache", r"^apache (?:software )?license,? \(?(?:version|v\.?)? ?1(?:\.0)?$"),
    ("apache-2.0", 60, "apache.org", r"(?:www\.)?apache\.org/licenses/license-2\.0"),
    ("apache-1.1", 60, "apache.org", r"(?:www\.)?apache\.org/licenses/license-1\.1"),
    ("apache-2.0", 50, "apache-2.0", r"^apache-2\.0@"),
    ("apache-2.0", 50, "apache", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache[ -](?:version |v)?2(?:\.0)?$"),
    ("apache-1.1", 90, "includes software developed by the apache", r"this product includes software developed by the apache software foundation"),
    ("apache", 30, "apache", r"^apache license@"),
    # GNU GPL
    ("gpl", 90, "redistribute it and/or modify", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", 90, "to share and change", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", 88, "should have received a copy", r"you should have received a copy of the gnu general public license"),
    ("gpl", 85, "general public", r"under (?:the )?terms of (?:the )?gnu general public license@"),
    ("gpl-1.0", 70, "general public", r"gnu general public license,? \(?(?:version|v\.?) ?1(?:\.0)?$"),
    ("gpl-2.0", 91, "general public", r"gnu general public license as published by the free software foundation[;,:]? (?:either )?version 2(?:\.0)?$"),
    ("gpl-3.0", 91, "general public", r"gnu general public license as published by the free software foundation[;,:]? (?:either )?version 3(?:\.0)?$"),
    ("gpl-2.0", 70, "general public", r"(?:gnu )?general public license,? \(?(?:gpl\)?,? ?)?(?:version|v\.?) ?2(?:\.0)?$(?: or (?:any )?later(?: version)?)?"),
    ("gpl-3.0", 70, "general public", r"(?:gnu )?general public license,? \(?(?:gpl\)?,? ?)?(?:version|v\.?) ?3(?:\.0)?$(?: or (?:any )?later(?: version)?)?"),
    ("gpl-1.0", 95, "gpl-1.0", r"spdx-license-identifier: \(?gpl-1\.0(?:-only|-or-later|\+)?@"),
    ("gpl-2.0", 95, "gpl-2.0", r"spdx-license-identifier: \(?gpl-2\.0(?:-only|-or-later|\+)?@"),
    ("gpl-3.0", 95, "gpl-3.0", r"spdx-license-identifier: \(?gpl-3\.0(?:-only|-or-later|\+)?@"),
    ("gpl-2.0", 50, "gpl", r"^gpl[ -]?v?2(?:\.0)?(?:\+|-only|-or-later)?$"),
    ("gpl-3.0", 50, "gpl", r"^gpl[ -]?v?3(?:\.0)?(?:\+|-only|-or-later)?$"),
    ("gpl-2.0", 60, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", 60, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl-3\.0"),
    ("gpl", 55, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl"),
    ("gpl-3.0", 90, "29 june 2007", r"gnu general public license version 3, 29 june 2007"),
    ("gpl-2.0", 90, "june 1991", r"gnu general public license version 2, june 1991"),
    ("gpl-classpath-exception", 75, "classpath", r"classpath(?: |-)exception(?:-2\.0)?@"),
    ("gpl-classpath-exception", 90, "linking this library", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-gcc-exception", 75, "gcc runtime", r"gcc runtime library exception@"),
    ("gpl-font-exception", 90, "embeds this font", r"creates? a document which uses this font,? and embeds? this font"),
    ("gpl", 30, "general public", r"gnu general public license@"),
    ("gpl", 30, "gpl", r"(?:licensed|released|distributed|available|covered|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl@"),
    # GNU LGPL
    ("lgpl", 85, "general public", r"under (?:the )?terms of (?:the )?gnu (?:lesser|library) general public license@"),
    ("lgpl", 88, "should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.0", 70, "library general public", r"gnu library general public license,? \(?(?:version|v\.?) ?2(?:\.0)?$"),
    ("lgpl-2.1", 70, "lesser general public", r"gnu lesser general public license,? \(?(?:lgpl\)?,? ?)?(?:version|v\.?) ?2\.1$"),
    ("lgpl-3.0", 70, "lesser general public", r"gnu lesser general public license,? \(?(?:lgpl\)?,? ?)?(?:version|v\.?) ?3(?:\.0)?$"),
    ("lgpl-2.1", 91, "lesser general public", r"gnu lesser general public license as published by the free software foundation[;,:]? (?:either )?version 2\.1$"),
    ("lgpl-3.0", 91, "lesser general public", r"gnu lesser general public license as published by the free software foundation[;,:]? (?:either )?version 3(?:\.0)?$"),
    ("lgpl-2.0", 95, "lgpl-2.0", r"spdx-license-identifier: \(?lgpl-2\.0(?:-only|-or-later|\+)?@"),
    ("lgpl-2.1", 95, "lgpl-2.1", r"spdx-license-identifier: \(?lgpl-2\.1(?:-only|-or-later|\+)?@"),
    ("lgpl-3.0", 95, "lgpl-3.0", r"spdx-license-identifier: \(?lgpl-3\.0(?:-only|-or-later|\+)?@"),
    ("lgpl-2.1", 50, "lgpl", r"^lgpl[ -]?v?2\.1(?:\+|-only|-or-later)?$"),
    ("lgpl-3.0", 50, "lgpl", r"^lgpl[ -]?v?3(?:\.0)?(?:\+|-only|-or-later)?$"),
    ("lgpl", 60, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl"),
    ("lgpl", 40, "general public", r"gnu (?:lesser|library) general public license@"),
    ("lgpl", 30, "lgpl", r"^lgpl license@"),
    # GNU AGPL and FDL
    ("agpl", 85, "affero", r"under (?:the )?terms of (?:the )?gnu affero general public license@"),
    ("agpl", 88, "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", 91, "affero", r"gnu affero general public license as published by the free software foundation[;,:]? (?:either )?version 3(?:\.0)?$"),
    ("agpl-3.0", 70, "affero", r"(?:gnu )?affero general public license,? \(?(?:agpl\)?,? ?)?(?:version|v\.?) ?3(?:\.0)?$"),
    ("agpl-1.0", 70, "affero", r"affero general public license,? \(?(?:version|v\.?) ?1(?:\.0)?$"),
    ("agpl-3.0", 95, "agpl-3.0", r"spdx-license-identifier: \(?agpl-3\.0(?:-only|-or-later|\+)?@"),
    ("agpl-3.0", 50, "agpl", r"^agpl[ -]?v?3(?:\.0)?(?:\+|-only|-or-later)?$"),
    ("agpl", 60, "gnu.org", r"gnu\.org/licenses/agpl"),
    ("agpl", 40, "affero", r"(?:gnu )?affero general public license@"),
    ("gfdl", 85, "free documentation", r"under (?:the )?terms of (?:the )?gnu free documentation license@"),
    ("gfdl-1.1", 70, "free documentation", r"gnu free documentation license,? (?:version|v\.?) ?1\.1$"),
    ("gfdl-1.2", 70, "free documentation", r"gnu free documentation license,? (?:version|v\.?) ?1\.2$"),
    ("gfdl-1.3", 70, "free documentation", r"gnu free documentation license,? (?:version|v\.?) ?1\.3$"),
    ("gfdl-1.3", 95, "gfdl-1.3", r"spdx-license-identifier: \(?gfdl-1\.3(?:-only|-or-later)?@"),
    ("gfdl", 90, "invariant sections", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl", 60, "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("gfdl", 30, "free documentation", r"gnu free documentation license@"),
    # Mozilla, Eclipse, IBM, Sun
    ("mpl-2.0", 90, "source code form", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0"),
    ("mpl-1.1", 90, "mozilla", r"the contents of this file are subject to the mozilla public license (?:version|v\.?) ?1\.1"),
    ("mpl-2.0", 70, "mozilla", r"mozilla public license,? \(?(?:mpl\)?,? ?)?(?:version|v\.?)? ?2(?:\.0)?$"),
    ("mpl-1.1", 70, "mozilla", r"mozilla public license,? \(?(?:version|v\.?)? ?1\.1$"),
    ("mpl-1.0", 70, "mozilla", r"mozilla public license,? \(?(?:version|v\.?)? ?1(?:\.0)?$"),
    ("mpl-2.0", 95, "mpl-2.0", r"spdx-license-identifier: \(?mpl-2\.0@"),
    ("mpl-1.1", 95, "mpl-1.1", r"spdx-license-identifier: \(?mpl-1\.1@"),
    ("mpl-2.0", 50, "mpl", r"^mpl[ -]v?2\.0$"),
    ("mpl-2.0", 60, "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl", 30, "mozilla", r"mozilla public license@"),
    ("npl", 40, "netscape", r"netscape public license@"),
    ("epl-1.0", 70, "eclipse", r"eclipse public license,? \(?(?:-|version|v\.?) ?1(?:\.0)?$"),
    ("epl-2.0", 70, "eclipse", r"eclipse public license,? \(?(?:-|version|v\.?) ?2(?:\.0)?$"),
    ("epl-1.0", 95, "epl-1.0", r"spdx-license-identifier: \(?epl-1\.0@"),
    ("epl-2.0", 95, "epl-2.0", r"spdx-license-identifier: \(?epl-2\.0@"),
    ("epl-1.0", 60, "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", 60, "eclipse.org", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("epl-2.0", 50, "epl", r"^epl-v?2\.0$"),
    ("epl-1.0", 50, "epl", r"^epl-v?1\.0$"),
    ("epl", 30, "eclipse", r"eclipse public license@"),
    ("edl-1.0", 50, "eclipse distribution", r"eclipse distribution license@"),
    ("cpl-1.0", 50, "common public", r"^common public license@"),
    ("ipl-1.0", 50, "ibm public", r"^ibm public license@"),
    ("cddl-1.0", 70, "common development", r"common development and distribution license,? \(?(?:cddl\)?,? ?)?(?:version|v\.?) ?1(?:\.0)?$"),
    ("cddl-1.1", 70, "common development", r"common development and distribution license,? \(?(?:cddl\)?,? ?)?(?:version|v\.?) ?1\.1$"),
    ("cddl-1.0", 95, "cddl-1.0", r"spdx-license-identifier: \(?cddl-1\.0@"),
    ("cddl", 40, "common development", r"common development and distribution license@"),
    ("spl-1.0", 40, "sun public", r"^sun public license@"),
    ("apsl-2.0", 70, "apple public", r"apple public source license,? (?:version|v\.?) ?2(?:\.0)?$"),
    ("apsl", 40, "apple public", r"apple public source license@"),
    # Creative Commons
    ("cc0", 70, "cc0", r"^cc0[ -]1\.0(?: universal)?@"),
    ("cc0", 90, "no rights reserved", r"cc0 .{0,40}?no rights reserved"),
    ("cc0", 95, "cc0", r"spdx-license-identifier: \(?cc0-1\.0@"),
    ("cc0", 60, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc0", 50, "cc0", r"^cc0@"),
    ("public-domain", 60, "creativecommons.org", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by-4.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-3.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-2.5", 60, "creativecommons.org", r"creativecommons\.org/licenses/by/2\.5"),
    ("cc-by-2.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by/2\.0"),
    ("cc-by-sa-4.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa-3.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-sa-2.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/2\.0"),
    ("cc-by-nc-4.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nc-3.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nd-4.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nd-3.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nd/3\.0"),
    ("cc-by-nc-sa-4.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-sa-3.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/3\.0"),
    ("cc-by-nc-nd-4.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("cc-by-nc-nd-3.0", 60, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/3\.0"),
    ("cc-by-4.0", 70, "creative commons", r"creative commons attribution(?: international)?,? (?:version |v)?4\.0$"),
    ("cc-by-3.0", 70, "creative commons", r"creative commons attribution(?: unported)?,? (?:version |v)?3\.0$"),
    ("cc-by-sa-4.0", 70, "creative commons", r"creative commons attribution[ -]+share[ -]?alike(?: international)?,? (?:version |v)?4\.0$"),
    ("cc-by-sa-3.0", 70, "creative commons", r"creative commons attribution[ -]+share[ -]?alike(?: unported)?,? (?:version |v)?3\.0$"),
    ("cc-by-nc-4.0", 70, "creative commons", r"creative commons attribution[ -]+non[ -]?commercial,? (?:international )?(?:version |v)?4\.0$"),
    ("cc-by-nc-sa-4.0", 70, "creative commons", r"creative commons attribution[ -]+non[ -]?commercial[ -]+share[ -]?alike,? (?:international )?(?:version |v)?4\.0$"),
    ("cc-by-nd-4.0", 70, "creative commons", r"creative commons attribution[ -]+no[ -]?deriv(?:ative)?s?,? (?:international )?(?:version |v)?4\.0$"),
    ("cc-by-nc-nd-4.0", 70, "creative commons", r"creative commons attribution[ -]+non[ -]?commercial[ -]+no[ -]?deriv(?:ative)?s?,? (?:international )?(?:version |v)?4\.0$"),
    ("cc-by", 65, "creative commons", r"creative commons attribution license@"),
    ("cc-by-sa", 65, "creative commons", r"creative commons attribution[ -]+share[ -]?alike@"),
    ("cc-by-nc", 65, "creative commons", r"creative commons attribution[ -]+non[ -]?commercial@"),
    ("cc-by-4.0", 50, "cc", r"^cc[ -]by[ -](?:v ?)?4\.0$"),
    ("cc-by-3.0", 50, "cc", r"^cc[ -]by[ -](?:v ?)?3\.0$"),
    ("cc-by-2.5", 50, "cc", r"^cc[ -]by[ -](?:v ?)?2\.5$"),
    ("cc-by-2.0", 50, "cc", r"^cc[ -]by[ -](?:v ?)?2\.0$"),
    ("cc-by-sa-4.0", 50, "cc", r"^cc[ -]by[ -]sa[ -](?:v ?)?4\.0$"),
    ("cc-by-sa-3.0", 50, "cc", r"^cc[ -]by[ -]sa[ -](?:v ?)?3\.0$"),
    ("cc-by-nc-4.0", 50, "cc", r"^cc[ -]by[ -]nc[ -](?:v ?)?4\.0$"),
    ("cc-by-nd-4.0", 50, "cc", r"^cc[ -]by[ -]nd[ -](?:v ?)?4\.0$"),
    ("cc-by-nc-sa-4.0", 50, "cc", r"^cc[ -]by[ -]nc[ -]sa[ -](?:v ?)?4\.0$"),
    ("cc-by-nc-nd-4.0", 50, "cc", r"^cc[ -]by[ -]nc[ -]nd[ -](?:v ?)?4\.0$"),
    ("cc-by-sa", 40, "cc", r"^cc[ -]by[ -]sa@"),
    ("cc-by-nc", 40, "cc", r"^cc[ -]by[ -]nc@"),
    ("cc-by-nd", 40, "cc", r"^cc[ -]by[ -]nd@"),
    ("cc-by", 30, "cc", r"^cc[ -]+by(?![a-z0-9])"),
    # Perl, Python, PHP, Ruby, TeX and other languages' own
    ("artistic-2.0", 70, "artistic", r"artistic license,? \(?(?:version|v\.?)? ?2(?:\.0)?$"),
    ("artistic-1.0", 70, "artistic", r"artistic license,? \(?(?:version|v\.?)? ?1(?:\.0)?$"),
    ("artistic-2.0", 95, "artistic-2.0", r"spdx-license-identifier: \(?artistic-2\.0@"),
    ("artistic", 30, "artistic", r"^artistic license@"),
    ("perl", 85, "as perl itself", r"under the same terms as perl itself"),
    ("psf-2.0", 70, "python software foundation", r"python software foundation license(?:,? (?:version|v\.?) ?2(?:\.0)?$)?"),
    ("psf-2.0", 95, "psf-2.0", r"spdx-license-identifier: \(?psf-2\.0@"),
    ("psf-2.0", 90, "python software foundation", r"this license agreement is between the python software foundation"),
    ("python", 30, "python", r"^python license@"),
    ("php-3.01", 70, "php", r"^php license,? (?:version|v\.?) ?3\.01$"),
    ("php-3.0", 70, "php", r"^php license,? (?:version|v\.?) ?3(?:\.0)?$"),
    ("php", 60, "php.net", r"php\.net/license/"),
    ("php", 30, "php", r"^php license@"),
    ("ruby", 30, "ruby", r"^ruby(?:'s)? license@"),
    ("ruby", 85, "as ruby itself", r"under the same terms as ruby itself"),
    ("lppl-1.3c", 70, "latex project", r"latex project public license,? (?:version|v\.?) ?1\.3c?$"),
    ("lppl", 40, "latex project", r"latex project public license@"),
    ("tcl", 30, "tcl", r"^tcl(?:/tk)? license@"),
    ("postgresql", 30, "postgresql", r"^postgresql license@"),
    ("sqlite-blessing", 90, "may you do good", r"may you do good and not evil"),
    ("vim", 30, "vim", r"^vim license@"),
    ("ecl-2.0", 70, "educational community", r"educational community license,? (?:version|v\.?) ?2(?:\.0)?$"),
    # Permissive libraries
    ("bsl-1.0", 90, "third-parties to whom", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .{0,200}?third-parties to whom"),
    ("bsl-1.0", 70, "boost software", r"boost software license(?:,? \(?-? ?(?:version|v\.?) ?1(?:\.0)?$)?"),
    ("bsl-1.0", 95, "bsl-1.0", r"spdx-license-identifier: \(?bsl-1\.0@"),
    ("bsl-1.0", 60, "boost.org", r"boost\.org/license_1_0"),
    ("zlib", 90, "as-is", r"this software is provided ~as-is~,? without any express or implied warranty"),
    ("zlib", 90, "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 88, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", 95, "zlib", r"spdx-license-identifier: \(?zlib@"),
    ("zlib", 30, "zlib", r"^zlib license@"),
    ("libpng", 30, "libpng", r"^libpng license@"),
    ("libtiff", 30, "libtiff", r"^libtiff license@"),
    ("ijg", 90, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", 90, "freetype", r"portions of this software are copyright .{1,60}? the freetype project"),
    ("ftl", 40, "freetype", r"freetype (?:project )?license@"),
    ("openssl", 90, "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 30, "openssl", r"^openssl license@"),
    ("ssleay", 90, "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", 30, "curl", r"^curl license@"),
    ("ntp", 30, "ntp", r"^ntp license@"),
    ("unicode-dfs", 90, "unicode data files", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of the unicode data files"),
    ("unicode", 40, "unicode", r"unicode(?:,? inc\.?)? license agreement@"),
    ("icu", 30, "icu", r"^icu license@"),
    ("w3c", 50, "w3c", r"w3c software (?:notice and )?license@"),
    ("ncsa", 50, "ncsa", r"university of illinois/ncsa open source license@"),
    ("zpl-2.1", 70, "zope", r"zope public license,? (?:\(zpl\) )?(?:version|v\.?) ?2\.1$"),
    ("zpl", 40, "zope", r"zope public license@"),
    ("ofl-1.1", 70, "open font", r"(?:sil )?open font license,? (?:version|v\.?) ?1\.1$"),
    ("ofl-1.1", 95, "ofl-1.1", r"spdx-license-identifier: \(?ofl-1\.1@"),
    ("ofl", 60, "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    ("ofl", 30, "open font", r"(?:sil )?open font license@"),
    ("upl-1.0", 70, "universal permissive", r"universal permissive license(?:,? (?:version|v\.?) ?1(?:\.0)?$)?"),
    ("json", 90, "for good, not evil", r"shall be used for good, not evil"),
    ("beerware", 90, "buy me a beer", r"you can buy me a beer in return"),
    ("beerware", 50, "beer", r"beer-?ware license@"),
    ("wtfpl", 90, "what the fuck you want to", r"do what the fuck you want to(?: public license)?@"),
    ("wtfpl", 50, "wtfpl", r"^wtfpl@"),
    ("unlicense", 90, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 95, "unlicense", r"spdx-license-identifier: \(?unlicense@"),
    ("unlicense", 60, "unlicense.org", r"unlicense\.org"),
    ("unlicense", 50, "unlicense", r"^(?:the )?unlicense license@|under the unlicense@"),
    ("public-domain", 85, "public domain", r"(?:has been |is )?(?:dedicated|placed|released|put) (?:in)?to the public domain@"),
    ("public-domain", 40, "public domain", r"(?:is|are) (?:now )?in the public domain@"),
    # European, academic and company licenses
    ("eupl-1.2", 70, "european union public", r"european union public license,? (?:\(eupl\) )?(?:version|v\.?) ?1\.2$"),
    ("eupl-1.1", 70, "european union public", r"european union public license,? (?:\(eupl\) )?(?:version|v\.?) ?1\.1$"),
    ("eupl-1.2", 95, "eupl-1.2", r"spdx-license-identifier: \(?eupl-1\.2@"),
    ("eupl", 40, "european union public", r"european union public license@"),
    ("cecill-2.1", 70, "cecill", r"cecill(?: free software)?(?: license)?,? (?:agreement )?(?:version|v\.?) ?2\.1$"),
    ("cecill-b", 50, "cecill-b", r"^cecill-b(?: license)?@"),
    ("cecill-c", 50, "cecill-c", r"^cecill-c(?: license)?@"),
    ("cecill", 40, "cecill", r"^cecill(?: free software)? license@"),
    ("afl-3.0", 70, "academic free", r"academic free license,? (?:version|v\.?) ?3(?:\.0)?$"),
    ("afl-2.1", 70, "academic free", r"academic free license,? (?:version|v\.?) ?2\.1$"),
    ("afl", 40, "academic free", r"academic free license@"),
    ("osl-3.0", 70, "open software license", r"open software license,? (?:version|v\.?) ?3(?:\.0)?$"),
    ("osl-2.1", 70, "open software license", r"open software license,? (?:version|v\.?) ?2\.1$"),
    ("ms-pl", 50, "microsoft public", r"microsoft public license@"),
    ("ms-rl", 50, "microsoft reciprocal", r"microsoft reciprocal license@"),
    ("qpl-1.0", 50, "q public", r"^q public license@"),
    ("rpl-1.5", 50, "reciprocal public", r"^reciprocal public license@"),
    ("sleepycat", 30, "sleepycat", r"^sleepycat license@"),
    ("nasa-1.3", 50, "nasa open source", r"nasa open source agreement(?:,? (?:version|v\.?) ?1\.3$)?"),
    ("mulan-psl-2.0", 60, "mulan", r"mulan (?:psl|permissive software license),? ?(?:version|v\.?)? ?2?$"),
    # Data, models and source-available
    ("odbl-1.0", 50, "database licen", r"open (?:data commons )?(?:open )?database license@"),
    ("odc-by-1.0", 50, "open data commons attribution", r"open data commons attribution license@"),
    ("pddl-1.0", 50, "public domain dedication", r"(?:open data commons )?public domain dedication (?:and|&) license@"),
    ("cdla-permissive", 50, "community data", r"community data license agreement ?(?:-|–)? ?permissive@"),
    ("cdla-sharing", 50, "community data", r"community data license agreement ?(?:-|–)? ?sharing@"),
    ("ogl-uk", 50, "open government", r"open government license@"),
    ("openrail", 50, "openrail", r"^(?:creativeml |bigscience )?open ?rail(?:-m|\+\+-m|\+\+)?(?: license)?@"),
    ("sspl-1.0", 50, "server side public", r"server side public license@"),
    ("busl-1.1", 50, "business source", r"business source license@"),
    ("elastic-2.0", 60, "elastic license", r"elastic license,? (?:version|v\.?)? ?2(?:\.0)?$"),
    ("commons-clause", 90, "right to sell", r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software"),
    ("commons-clause", 50, "commons clause", r"commons clause(?: license condition)?@"),
    ("polyform", 50, "polyform", r"polyform (?:noncommercial|small business|free trial|strict|shield|perimeter) license@"),
    # Closed
    ("proprietary", 60, "proprietary", r"proprietary (?:and|&) confidential|confidential (?:and|&) proprietary"),
    ("proprietary", 60, "strictly prohibited", r"unauthori[sz]ed (?:copying|reproduction|distribution)(?: or distribution)? of this (?:file|software|material|document),? (?:via any medium )?is strictly prohibited"),
    ("proprietary", 55, "trade secret", r"contains (?:confidential|proprietary) (?:information|material)s? (?:and|or) trade secrets?"),
    ("proprietary", 50, "evaluation", r"for (?:internal )?evaluation (?:purposes )?only,? not for (?:production|distribution)"),
    ("proprietary", 50, "end user", r"end[ -]user license agreement@"),
    ("proprietary", 20, "all rights reserved", r"all rights reserved@"),
    ("non-commercial", 40, "commercial", r"for (?:non-?commercial|personal) use only@"),
    ("research-only", 40, "research", r"for (?:academic|research) (?:purposes|use) only@"),
)
