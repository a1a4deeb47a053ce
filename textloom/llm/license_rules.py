"""Licence signatures written out one by one: phrases of licence bodies, notices, addresses, exceptions, choices and prohibitions.

Each is (label, priority, confidence, keyword, regex) over normalized words; the keyword stands in every string the regex accepts.
"""

SIGNATURES = [
    # bodies: permissive
    ("mit", 88, 0.95, "deal in the software without", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", 84, 0.9, "above copyright notice and this permission", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions"),
    ("mit-0", 92, 0.95, "sell copies of the software and to permit", "sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", 86, 0.9, "name of the x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-advertising", 86, 0.85, "shall not be used in advertising", "except as contained in this notice the names? of (?:the )?(?:\\S+ ){1,8}shall not be used in advertising or otherwise to promote"),
    ("isc", 86, 0.9, "with or without fee is hereby granted", "for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 91, 0.95, "with or without fee is hereby granted the software", "for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", 87, 0.9, "appear in supporting documentation", "that copyright notice and this permission notice appear in supporting documentation"),
    ("ntp", 84, 0.8, "makes no representations about the suitability", "makes no representations about the suitability (?:of )?this software for any purpose"),
    ("bsd-2", 86, 0.9, "redistributions of source code must", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", 85, 0.9, "redistributions in binary form must", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3", 90, 0.95, "endorse or promote products derived", "neither the names? of (?:the )?(?:\\S+ ){1,10}nor the names of (?:its|their|any) (?:\\S+ ){0,2}contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3", 88, 0.9, "may not be used to endorse", "the names? of (?:\\S+ ){1,10}may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", 92, 0.95, "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clear", 93, 0.95, "no express or implied licenses to any party", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-nuclear", 93, 0.95, "nuclear facility", "this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("bsd-2-patent", 93, 0.95, "patent license to make have made", "a perpetual worldwide non exclusive no charge royalty free irrevocable patent license to make have made"),
    ("zlib", 90, 0.95, "held liable for any damages arising from the use", "in no event will the authors? be held liable for any damages arising from the use of this software permission is granted"),
    ("zlib", 88, 0.9, "altered source versions must", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 86, 0.85, "origin of this software must not", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng-2", 91, 0.9, "png reference library", "the png reference library is supplied as is the (?:contributing )?authors"),
    ("boost-1", 90, 0.95, "obtaining a copy of the software and accompanying", "obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1", 88, 0.9, "machine executable object code", "solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", 90, 0.95, "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 84, 0.8, "in jurisdictions that recognize copyright", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("wtfpl", 90, 0.95, "you just do what the", "you just do what the \\S+ you want to"),
    ("ncsa", 89, 0.9, "deal with the software without", "to deal with the software without restriction including without limitation the rights to use"),
    ("postgresql", 88, 0.9, "use copy modify and distribute this software and its documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("curl", 88, 0.85, "and distribute this software for any purpose with or without fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("beerware", 90, 0.95, "buy me a beer", "you can buy me a beer in return"),
    ("fair", 86, 0.85, "usage of the works is permitted", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("fsfap", 88, 0.9, "copying and distribution of this file", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("fsf-ul", 86, 0.85, "unlimited permission to copy", "gives unlimited permission to copy and or distribute it with or without modifications"),
    ("fsf-ulr", 87, 0.85, "as long as this notice is preserved", "with or without modifications as long as this notice is preserved"),
    ("all-permissive", 80, 0.7, "use it for any purpose", "you (?:may|can) use it for any purpose without (?:restriction|charge|fee)"),
    ("public-domain", 84, 0.85, "dedicated to the public domain", "(?:is|are|has been|have been|hereby) dedicated to the public domain"),
    ("public-domain", 84, 0.85, "placed in the public domain", "(?:is|are|was|were|has been|have been) (?:hereby )?placed in the public domain"),
    ("public-domain", 84, 0.85, "work of the united states government", "(?:is a|as a) work of the united states government"),
    ("cc0", 88, 0.95, "all copyright and related", "waived? all copyright and related or neighboring rights"),
    ("cc0", 86, 0.9, "to the extent possible under law", "to the extent possible under law the (?:author s?|person who associated cc0)"),
    ("cc0", 84, 0.9, "publicdomain zero", "publicdomain zero 1 0"),
    ("naist", 84, 0.85, "use reproduction and distribution of this", "use reproduction and distribution of this software is permitted any copy of this software"),
    ("ijg", 88, 0.9, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 88, 0.9, "freetype project", "portions of this software are copyright (?:c )?(?:\\S+ ){0,3}the freetype project"),
    ("openssl", 88, 0.9, "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 88, 0.9, "eric young", "this product includes (?:cryptographic )?software written by eric young"),
    ("unicode-dfs", 88, 0.9, "unicode data files", "obtaining a copy of the unicode data files and any associated documentation"),
    ("icu", 86, 0.85, "permission notice appear in all copies of the software", "this permission notice appear in all copies of the software and that both the above copyright notices"),
    ("w3c", 88, 0.9, "w3c software notice", "w3c software notice and license"),
    ("json", 90, 0.95, "good not evil", "the software shall be used for good not evil"),
    ("vim", 86, 0.85, "unmodified copies", "there are no restrictions on distributing unmodified copies|unlimited copying and distribution of unmodified copies"),
    ("tcl", 86, 0.85, "existing copyright notices are retained", "provided that existing copyright notices are retained in all copies and that this notice is included verbatim"),
    ("sleepycat", 88, 0.9, "redistributions in any form must be accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("artistic-1", 86, 0.9, "the intent of this document is to state", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", 88, 0.9, "establishes the terms under which a given", "this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("ruby", 86, 0.85, "rename any non standard executables", "rename any non standard executables so the names do not conflict with standard executables"),
    ("php-3", 88, 0.9, "products derived from this software may not be called php", "products derived from this software may not be called php"),
    ("php-3", 86, 0.9, "this product includes php", "this product includes php software freely available from"),
    ("python-2", 88, 0.9, "licensee hereby agrees to include in any such work", "licensee hereby agrees to include in any such work a brief summary of the changes made to python"),
    ("psf-2", 86, 0.9, "this license agreement is between the python", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("afl-3", 86, 0.9, "academic free license applies", "this academic free license applies to any original work of authorship"),
    ("osl-3", 86, 0.9, "open software license applies", "this open software license applies to any original work of authorship"),
    ("upl-1", 88, 0.9, "associated documentation and or data", "any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights"),
    ("ms-pl", 86, 0.9, "this license governs use of the accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ofl-1.1", 88, 0.9, "reserved font name", "with reserved font names? \\S+"),
    ("ofl-1.1", 88, 0.9, "fonts and derivatives", "the fonts and derivatives however cannot be released under any other type of license"),
    ("eupl-1.2", 86, 0.9, "european union public licence the eupl", "this european union public licence the eupl applies to the work"),
    ("cecill-2.1", 88, 0.9, "cecill", "(?:governed by|under) the cecill license"),
    ("cecill-b", 88, 0.9, "cecill b", "(?:governed by|under) the cecill b license"),
    ("cecill-c", 88, 0.9, "cecill c", "(?:governed by|under) the cecill c license"),
    ("mulan-psl-2", 88, 0.9, "mulan", "mulan (?:psl|permissive software license)(?: v ?2| version 2)?"),
    ("blueoak-1", 88, 0.9, "blue oak", "blue oak model license(?: 1 0 0)?"),
    # bodies: copyleft
    ("gpl-2", 92, 0.95, "either version 2 of the license", "(?:under the terms of the )?gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", 92, 0.95, "either version 3 of the license", "(?:under the terms of the )?gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", 93, 0.95, "free software foundation version 2", "(?:under the terms of the )?gnu general public license (?:version 2 )?as published by the free software foundation version 2(?! or)"),
    ("gpl-1", 92, 0.9, "either version 1 or at your option", "(?:under the terms of the )?gnu general public license as published by the free software foundation either version 1 or at your option any later version"),
    ("lgpl-2.1", 93, 0.95, "either version 2 1 of the license", "(?:under the terms of the )?gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", 93, 0.95, "gnu lesser general public license as published", "(?:under the terms of the )?gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2", 93, 0.95, "gnu library general public license as", "(?:under the terms of the )?gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("agpl-3", 93, 0.95, "gnu affero general public license as published", "(?:under the terms of the )?gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gpl", 80, 0.85, "you should have received a copy of the gnu general", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", 82, 0.85, "you should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this"),
    ("agpl", 82, 0.85, "you should have received a copy of the gnu affero", "you should have received a copy of the gnu affero general public license along with this"),
    ("gpl-2", 86, 0.9, "when we speak of free software", "when we speak of free software we are referring to freedom not price"),
    ("gpl-3", 86, 0.9, "free copyleft license for software", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3", 86, 0.9, "free copyleft license for software and other kinds of works specifically", "free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("lgpl-2.1", 86, 0.9, "this license the lesser general public license applies", "this license the lesser general public license applies to some specially designated software packages"),
    ("gfdl", 88, 0.95, "invariant sections", "with no invariant sections(?: no front cover texts and no back cover texts| with no front cover texts)?"),
    ("gfdl", 86, 0.9, "copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", 92, 0.95, "source code form is subject to", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 88, 0.9, "mozilla org mpl 2", "mozilla org mpl 2 0"),
    ("mpl-1.1", 92, 0.95, "contents of this file are subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2-no-copyleft", 94, 0.95, "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-2", 88, 0.95, "eclipse org legal epl", "(?:www )?eclipse org legal epl (?:v ?)?2 ?0"),
    ("epl-1", 88, 0.95, "eclipse org legal epl v10", "(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2", 90, 0.95, "this program and the accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? )?2 0"),
    ("epl-1", 89, 0.95, "accompanying materials are made available under", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1", 88, 0.95, "contents of this file are subject to the terms of", "the contents of this file are subject to the terms of (?:either )?(?:the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("cpl-1", 86, 0.9, "accompanying program is provided under the terms of this common", "the accompanying program is provided under the terms of this common public license"),
    ("apsl-2", 88, 0.9, "apple public source", "apple public source license(?: version)?(?: 2 0)?"),
    ("rpl-1.5", 88, 0.9, "reciprocal public", "reciprocal public license(?: version)?(?: 1 5)?"),
    ("sspl-1", 90, 0.95, "server side public", "server side public license(?: version)?(?: 1)?"),
    ("elastic-2", 90, 0.95, "elastic license", "elastic license(?: version)?(?: 2 0)?"),
    ("busl-1.1", 90, 0.95, "business source", "business source license(?: version)?(?: 1 1)?"),
    ("commons-clause", 92, 0.95, "commons clause", "commons clause license condition(?: v ?1 0)?"),
    ("polyform-nc", 90, 0.95, "polyform noncommercial", "polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-sb", 90, 0.95, "polyform small business", "polyform small business license(?: 1 0 0)?"),
    ("prosperity-3", 90, 0.95, "prosperity public", "(?:the )?prosperity public license(?: 3 0 0)?"),
    ("parity-7", 90, 0.95, "parity public", "(?:the )?parity public license(?: 7 0 0)?"),
    ("odbl-1", 88, 0.95, "opendatacommons org licenses odbl", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1", 88, 0.95, "opendatacommons org licenses by", "opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", 88, 0.95, "opendatacommons org licenses pddl", "opendatacommons org licenses pddl(?: 1 0)?"),
    ("odc-by-1", 86, 0.9, "open data commons attribution", "open data commons attribution license"),
    ("cdla-permissive", 88, 0.9, "community data license agreement", "community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", 88, 0.9, "data license agreement sharing", "community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("ogl-uk-3", 86, 0.9, "open government", "open government licen[cs]e(?: v ?3 0| version 3 0)?"),
    ("etalab-2", 86, 0.9, "licence ouverte", "licence ouverte(?: open licence)?(?: version)?(?: 2 0)?"),
    ("dl-de-by-2", 86, 0.9, "datenlizenz deutschland", "datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?"),
    ("openrail", 88, 0.9, "rail", "(?:creativeml |bigscience )?open ?rail(?: [ms]+)?(?: license)?"),
    ("llama-community", 88, 0.9, "llama", "llama (?:\\d(?: \\d)? )?community license(?: agreement)?"),
    ("gemma-terms", 86, 0.85, "gemma terms of use", "gemma terms of use"),
    # creative commons by address and by name
    ("cc-by-nc-nd", 90, 0.95, "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd(?: \\d \\d)?"),
    ("cc-by-nc-sa", 90, 0.95, "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa(?: \\d \\d)?"),
    ("cc-by-nc", 88, 0.95, "creativecommons org licenses by nc", "creativecommons org licenses by nc(?! (?:nd|sa))(?: \\d \\d)?"),
    ("cc-by-nd", 90, 0.95, "creativecommons org licenses by nd", "creativecommons org licenses by nd(?: \\d \\d)?"),
    ("cc-by-sa", 90, 0.95, "creativecommons org licenses by sa", "creativecommons org licenses by sa(?: \\d \\d)?"),
    ("cc-by", 88, 0.95, "creativecommons org licenses by", "creativecommons org licenses by(?! (?:nc|nd|sa))(?: \\d \\d)?"),
    ("cc-by-nc-nd", 86, 0.95, "deriv", "(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: \\d 0)?"),
    ("cc-by-nd", 86, 0.9, "attribution no", "(?:creative commons )?attribution no ?deriv(?:ative)?s(?: works)?(?: \\d 0)?"),
    ("cc-by-sa", 84, 0.9, "creative commons share", "creative commons share ?alike(?: license)?"),
    ("cc", 60, 0.6, "some rights reserved", "some rights reserved"),
    # exceptions and additions
    ("classpath-exception", 96, 0.95, "link this library with independent modules", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("classpath-exception", 94, 0.9, "classpath exception", "with (?:the )?classpath exception(?: 2 0)?"),
    ("gcc-exception", 94, 0.9, "runtime library exception", "gcc runtime library exception(?: version)?(?: 3 1)?"),
    ("linux-syscall-note", 94, 0.9, "linux syscall note", "with linux syscall note"),
    ("llvm-exception", 94, 0.9, "llvm exception", "with llvm exceptions?"),
    ("font-exception", 94, 0.9, "font exception", "with font exception(?: 2 0)?"),
    ("autoconf-exception", 94, 0.9, "generated by autoconf", "as a special exception (?:\\S+ ){0,12}configuration script generated by autoconf"),
    ("bison-exception", 94, 0.9, "bison parser skeleton", "as a special exception (?:\\S+ ){0,12}bison parser skeleton"),
    ("openssl-exception", 94, 0.9, "openssl library", "permission to link (?:the code of )?(?:\\S+ ){0,8}with the openssl library|link (?:\\S+ ){0,8}with the openssl project s openssl library"),
    ("linking-exception", 92, 0.85, "dynamic linking exception", "static (?:or|and) dynamic linking exception"),
    ("universal-foss-exception", 92, 0.85, "universal foss exception", "universal foss exception(?: version)?(?: 1 0)?"),
    # choices of licences
    ("gpl-or-mit", 95, 0.9, "dual", "dual(?:ly)? licensed under (?:the )?(?:mit and gpl|gpl and mit|mit or gpl|gpl or mit)(?: licenses?)?"),
    ("mit-or-apache-2", 95, 0.95, "mit or apache", "mit or apache 2 0"),
    ("mit-or-apache-2", 95, 0.95, "apache 2 0 or mit", "apache 2 0 or mit"),
    ("mit-or-apache-2", 95, 0.9, "at your option", "(?:apache license version 2 0 (?:\\S+ ){0,12}or (?:the )?mit license|mit license (?:\\S+ ){0,12}or (?:the )?apache license version 2 0)(?: \\S+){0,8} at your option"),
    ("mpl-or-gpl-or-lgpl", 95, 0.9, "mpl 1 1 gpl 2 0 lgpl", "mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("cddl-or-gpl", 95, 0.9, "cddl 1 0 gpl", "cddl 1 0 gpl(?: 2 0| v2)(?: with classpath exception)?"),
    ("bsd-or-gpl", 95, 0.9, "bsd or gpl", "(?:dual )?bsd or gpl(?: v?2(?: 0)?)?"),
    ("perl", 90, 0.95, "under the same terms as", "under the same terms as (?:the )?perl(?: itself| 5)?"),
    ("same-as-project", 55, 0.5, "same license as", "under the same license as \\S+"),
    # what does not allow use, and notices
    ("proprietary", 82, 0.9, "confidential and proprietary", "(?:is|are|contains?) (?:the )?confidential and proprietary(?: information| property)?"),
    ("proprietary", 82, 0.9, "ed copying", "unauthori[sz]ed copying (?:of this (?:file|software|document|work) |distribution |modification )?(?:\\S+ ){0,6}(?:is )?(?:strictly )?prohibited"),
    ("proprietary", 82, 0.9, "reproduction or distribution", "(?:unauthori[sz]ed )?reproduction or distribution (?:\\S+ ){0,8}(?:is )?(?:strictly )?prohibited"),
    ("proprietary", 80, 0.85, "end user licen", "end user licen[cs]e agreement"),
    ("proprietary", 80, 0.85, "may not be", "may not be (?:reproduced|copied|published|broadcast|rewritten|redistributed)(?: \\S+){0,12} without (?:the )?(?:prior |express |written ){1,3}(?:permission|consent)"),
    ("proprietary", 80, 0.85, "trade secret", "contains? (?:\\S+ ){0,4}trade secrets?"),
    ("evaluation-only", 84, 0.85, "evaluation purposes only", "for evaluation purposes only"),
    ("non-commercial", 80, 0.8, "commercial use only", "(?:for )?(?:personal and |personal or |educational and |research and )?non ?commercial use only"),
    ("non-commercial", 80, 0.8, "not for commercial", "not for commercial (?:use|purposes|redistribution)"),
    ("research-only", 82, 0.85, "research purposes only", "for (?:academic |non ?commercial |scientific )?research purposes only"),
    ("no-derivatives", 78, 0.75, "no derivative works", "no derivative works (?:are |is )?(?:allowed|permitted)"),
    ("no-ai-training", 84, 0.85, "machine learning", "(?:may not|must not|shall not|cannot) be used (?:to train|for training|for the purposes? of training) (?:\\S+ ){0,6}machine learning"),
    ("no-text-mining", 84, 0.85, "data mining", "text and data mining (?:\\S+ ){0,6}(?:is|are) (?:not permitted|prohibited|reserved)"),
    ("copyright", 40, 0.4, "copyright notice", "(?:the )?copyright notice (?:above|below)"),
    ("copyright", 35, 0.35, "copyrighted material", "(?:contains? )?copyrighted materials?"),
    ("warranty-disclaimer", 45, 0.4, "without warranty of any kind", "(?:the \\S+ is )?provided as is without warranty of any kind"),
    ("warranty-disclaimer", 44, 0.4, "without any warranty without even", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", 44, 0.4, "warranties of merchantability", "(?:implied )?warranties of merchantability(?: and)? fitness for a particular purpose"),
    ("apache-2", 91, 0.95, "you may not use this file except", "you may not use this file except in compliance with the license"),
    ("apache-2", 88, 0.9, "distributed on an as is basis", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", 90, 0.95, "more contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 90, 0.95, "developed by the apache software", "this product includes software developed by the apache software foundation"),
]
