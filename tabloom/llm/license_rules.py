"""Hand-written signatures of license texts: sentences that grants, conditions, disclaimers and notices are known by.

A rule is written over lower-case words with one blank between them. Its keyword is a word, or part of one,
that every way of writing the rule contains; rare words are taken, so that few texts run the pattern.
"""

#: label, keyword, pattern, priority, confidence.
WORDINGS = [
    # MIT and its kin
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 85, 0.95),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 84, 0.95),
    ("mit", "substantial", r"the above copyright notice and this permission notice (?:\S+ ){0,8}shall be included in all copies or substantial portions", 83, 0.9),
    ("mit", "noninfringement", r"fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable", 66, 0.7),
    ("mit", "tort", r"liable for any claim damages or other liability whether in an action of contract tort or otherwise", 66, 0.7),
    ("mit-0", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:\S+ ){1,40}to permit persons to whom the software is furnished to do so the software is provided", 87, 0.95),
    ("mit-modern", "hereby", r"permission is hereby granted without written agreement and without license or royalty fees", 85, 0.9),
    ("x11", "advertising", r"except as contained in this notice the name of (?:\S+ ){1,6}shall not be used in advertising", 84, 0.9),
    ("hpnd", "documentation", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose", 85, 0.9),
    ("hpnd", "publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific", 80, 0.8),
    ("ntp", "fee", r"with or without fee is hereby granted provided that the above copyright notice appears in all copies", 83, 0.85),
    ("isc", "modify", r"permission to use copy modify and or distribute this software for any purpose", 85, 0.95),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability", 68, 0.75),
    ("0bsd", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 87, 0.95),
    ("curl", "copyright", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 84, 0.6),
    ("icu", "unicode", r"copyright (?:c )?(?:\d{4} )*unicode inc all rights reserved distributed under the terms of use", 85, 0.9),
    ("json", "evil", r"the software shall be used for good not evil", 90, 1.0),
    ("beerware", "beer", r"you can buy me a beer in return", 88, 0.95),
    ("wtfpl", "fuck", r"do what the fuck you want to(?: public license)?", 88, 0.95),
    ("fair", "instrument", r"usage of the works is permitted provided that this instrument is retained", 88, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 88, 0.95),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 86, 0.95),
    ("zlib", "express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 67, 0.75),
    ("libpng", "png", r"the png reference library is supplied as is", 88, 0.95),
    ("bsl-1.0", "transmit", r"to use reproduce display distribute execute and transmit the software and to prepare derivative works", 88, 0.95),
    ("bsl-1.0", "machine", r"unless such copies or derivative works are solely in the form of machine executable object code", 87, 0.95),
    ("ms-pl", "microsoft", r"microsoft public license", 86, 0.95),
    ("ms-rl", "reciprocal", r"microsoft reciprocal license", 86, 0.95),
    ("ms-pl", "contributor", r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution", 78, 0.7),
    ("ncsa", "illinois", r"university of illinois (?:ncsa )?open source license", 88, 0.95),
    ("upl-1.0", "permissive", r"universal permissive license(?: (?:version |v)?1 0)?", 86, 0.95),
    ("afl-3.0", "academic", r"academic free license(?: version)? 3 0", 86, 0.95),
    ("osl-3.0", "open", r"open software license(?: version)? 3 0", 86, 0.95),
    ("ecl-2.0", "educational", r"educational community license(?: version)? 2 0", 86, 0.95),
    ("mulan-2.0", "mulan", r"mulan permissive software license(?: v(?:ersion )?2)?", 86, 0.95),
    ("blueoak-1.0", "blue", r"blue oak model license", 86, 0.95),
    # BSD
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 85, 0.9),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 80, 0.85),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 80, 0.85),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote", 86, 0.95),
    ("bsd-3-clause", "endorse", r"may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission", 82, 0.9),
    ("bsd-4-clause", "acknowledg", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 88, 0.95),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license", 87, 0.95),
    ("bsd-protection", "protection", r"bsd protection license", 87, 0.95),
    ("bsd", "procurement", r"procurement of substitute goods or services loss of use data or profits or business interruption", 66, 0.65),
    ("bsd", "regents", r"regents of the university of california all rights reserved", 75, 0.8),
    # Apache
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 85, 0.9),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0", 88, 1.0),
    ("apache-1.1", "apache", r"www apache org licenses license 1 1", 88, 1.0),
    ("apache-2.0", "governing", r"see the license for the specific language governing permissions and limitations under the license", 84, 0.85),
    ("apache-2.0", "conditions", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", 84, 0.85),
    ("apache-2.0", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 86, 0.95),
    ("apache-2.0", "prominent", r"you must cause any modified files to carry prominent notices stating that you changed the files", 82, 0.85),
    ("apache-2.0", "readable", r"readable copy of the attribution notices contained within such notice file", 84, 0.9),
    ("apache-1.1", "includes", r"this product includes software developed by the apache software foundation", 80, 0.75),
    ("apache-1.1", "apache", r"products derived from this software may not be called apache", 86, 0.95),
    ("llvm-exception", "llvm", r"(?:llvm exceptions? to the apache 2 0 license|apache 2 0 with llvm exceptions?)", 89, 0.95),
    # GPL, LGPL and AGPL
    ("gpl", "gnu", r"www gnu org licenses gpl(?: \d(?: 0)?)?", 88, 1.0),
    ("lgpl", "gnu", r"www gnu org licenses lgpl(?: \d(?: [01])?)?", 88, 1.0),
    ("agpl", "gnu", r"www gnu org licenses agpl(?: \d(?: 0)?)?", 88, 1.0),
    ("gfdl", "gnu", r"www gnu org licenses fdl(?: \d(?: \d)?)?", 88, 1.0),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 86, 0.95),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 87, 0.95),
    ("agpl", "affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", 87, 0.95),
    ("gpl-2.0-or-later", "option", r"either version 2 of the license or at your option any later version", 89, 0.95),
    ("gpl-3.0-or-later", "option", r"either version 3 of the license or at your option any later version", 89, 0.95),
    ("lgpl-2.1-or-later", "option", r"either version 2 1 of the license or at your option any later version", 89, 0.95),
    ("gpl-2.0-only", "terms", r"under the terms of (?:the )?(?:gnu )?(?:general public license|gpl) version 2 (?:only|as published by the free software foundation)", 87, 0.9),
    ("gpl-3.0-only", "terms", r"under the terms of (?:the )?(?:gnu )?(?:general public license|gpl) version 3 (?:only|as published by the free software foundation)", 87, 0.9),
    ("gpl", "merchantability", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", 72, 0.75),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with this", 84, 0.9),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this", 84, 0.9),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license along with this", 84, 0.9),
    ("gpl", "franklin", r"free software foundation inc 51 franklin (?:street|st) fifth floor boston", 74, 0.7),
    ("gpl", "temple", r"free software foundation inc 59 temple place", 74, 0.7),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 78, 0.85),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 88, 0.95),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 88, 0.95),
    ("gpl-3.0", "conveying", r"conveying under any other circumstances is permitted solely under the conditions stated below", 86, 0.95),
    ("gpl-3.0", "installation", r"installation information for a user product means any methods procedures authorization keys", 88, 0.95),
    ("agpl", "remotely", r"all users interacting with it remotely through a computer network", 88, 0.95),
    ("lgpl-2.1", "linked", r"designed to work with the library by being compiled or linked with it", 86, 0.95),
    ("lgpl", "combined", r"you may convey a combined work under terms of your choice", 86, 0.95),
    ("gpl-classpath-exception", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 90, 0.95),
    ("gpl-classpath-exception", "classpath", r"classpath exception", 89, 0.9),
    ("gpl-gcc-exception", "runtime", r"gcc runtime library exception", 89, 0.95),
    ("gpl-linux-syscall-exception", "kernel", r"user programs that use kernel services by normal system calls", 90, 0.95),
    ("gpl-bison-exception", "bison", r"you may create a larger work that contains part or all of the bison parser skeleton", 90, 0.95),
    ("gpl-font-exception", "font", r"if you create a document which uses this font and embed this font", 90, 0.95),
    ("gpl-openssl-exception", "openssl", r"permission to link (?:the code of )?(?:\S+ ){1,10}with (?:the )?openssl(?: project s openssl)? library", 90, 0.9),
    ("gfdl", "invariant", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts", 90, 0.95),
    ("gfdl", "documentation", r"gnu free documentation license", 86, 0.95),
    # weak copyleft and foundations
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 90, 1.0),
    ("mpl-2.0", "mozilla", r"(?:you can obtain one at https? )?(?:www )?mozilla org mpl 2 0", 88, 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 90, 1.0),
    ("mpl-1.1", "mozilla", r"www mozilla org mpl mpl 1 1 html", 88, 1.0),
    ("mpl-2.0", "secondary", r"incompatible with secondary licenses", 86, 0.9),
    ("npl-1.1", "netscape", r"netscape public license", 86, 0.9),
    ("epl-1.0", "eclipse", r"www eclipse org legal epl v10 html", 88, 1.0),
    ("epl-2.0", "eclipse", r"www eclipse org legal epl (?:2 0|v20 html)", 88, 1.0),
    ("epl", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license", 88, 0.95),
    ("edl-1.0", "distribution", r"eclipse distribution license", 86, 0.9),
    ("cddl", "cddl", r"cddl (?:version |v)?1 [01]", 85, 0.9),
    ("cddl", "bracket", r"(?:with the )?fields enclosed by brackets replaced with your own identifying information", 84, 0.85),
    ("cpl-1.0", "accompanying", r"the accompanying program is provided under the terms of this common public license", 88, 0.95),
    ("ipl-1.0", "ibm", r"ibm public license", 86, 0.9),
    ("apsl-2.0", "apple", r"apple public source license", 86, 0.9),
    ("artistic-1.0", "artistic", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 90, 0.95),
    ("artistic-2.0", "restriction", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction", 88, 0.95),
    ("perl", "perl", r"under the same terms as perl itself", 88, 0.95),
    ("ruby", "ruby", r"under the same terms as ruby(?: itself)?", 84, 0.85),
    ("python", "psf", r"psf is making python available to licensee on an as is basis", 90, 0.95),
    ("python", "beopen", r"beopen python open source license agreement", 88, 0.95),
    ("php-3.01", "php", r"this (?:source file|product) (?:is subject to version 3 0 ?1 of|includes) (?:the )?php (?:license|software)", 86, 0.9),
    ("php-3.01", "php", r"www php net license 3 01 txt", 88, 1.0),
    ("zpl-2.1", "zope", r"zope public license", 86, 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 90, 0.95),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young", 90, 0.95),
    ("postgresql", "agreement", r"without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", 90, 0.95),
    ("tcl", "hereby", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation", 88, 0.95),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?license", 86, 0.95),
    ("unicode-dfs", "unicode", r"unicode inc license agreement data files and software", 90, 0.95),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 88, 0.95),
    ("ftl", "freetype", r"portions of this software are copyright (?:c )?(?:\S+ ){0,4}the freetype project", 88, 0.95),
    ("sleepycat", "accompanying", r"information on how to obtain complete source code for the db software and any accompanying software", 90, 0.95),
    ("qpl-1.0", "public", r"the q public license version 1 0", 90, 0.95),
    ("vim", "vim", r"(?:you must also include the )?vim license", 82, 0.85),
    ("lppl-1.3", "latex", r"latex project public license", 88, 0.95),
    ("cecill", "cecill", r"(?:governed by the )?cecill(?: [abc])? license", 86, 0.9),
    ("eupl", "eupl", r"licensed under the eupl(?: version)?(?: 1 [012])?", 88, 0.95),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1", 90, 1.0),
    ("ofl-1.1", "reserved", r"with reserved font name", 84, 0.9),
    ("ofl-1.1", "bundled", r"fonts? (?:software )?may be bundled redistributed and or sold with any software", 86, 0.9),
    ("ubuntu-font-1.0", "ubuntu", r"ubuntu font licence", 88, 0.95),
    ("bitstream-vera", "bitstream", r"bitstream vera is a trademark of bitstream", 90, 0.95),
    # Creative Commons, data and the public domain
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d \d", 88, 1.0),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d \d", 88, 1.0),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc \d \d", 88, 1.0),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd \d \d", 88, 1.0),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa \d \d", 88, 1.0),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd \d \d", 88, 1.0),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 88, 1.0),
    ("cc-pdm", "creativecommons", r"creativecommons org publicdomain mark 1 0", 88, 1.0),
    ("cc0", "waive", r"(?:has|have) waived all copyright and related or neighboring rights", 88, 0.95),
    ("cc-by-sa", "transform", r"if you remix transform or build upon the material you must distribute your contributions under the same license", 86, 0.9),
    ("cc-by", "appropriate", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 80, 0.8),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes", 82, 0.85),
    ("cc-by-nd", "transform", r"if you remix transform or build upon the material you may not distribute the modified material", 86, 0.9),
    ("unlicense", "encumber", r"this is free and unencumbered software released into the public domain", 90, 1.0),
    ("unlicense", "dedication", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs", 88, 0.95),
    ("public-domain", "domain", r"(?:released into|dedicated to|in) the public domain", 50, 0.6),
    ("public-domain", "disclaims", r"the author(?:s)? (?:hereby )?disclaims copyright to this source code", 80, 0.9),
    ("sqlite-blessing", "forgiveness", r"may you do good and not evil may you find forgiveness for yourself and forgive others", 90, 1.0),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl", 88, 1.0),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by", 88, 1.0),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl", 88, 1.0),
    ("cdla-permissive", "community", r"community data license agreement permissive", 88, 0.95),
    ("cdla-sharing", "community", r"community data license agreement sharing", 88, 0.95),
    ("ogl-uk", "government", r"contains public sector information licensed under the open government licence", 90, 0.95),
    # source-available and restricted
    ("busl-1.1", "business", r"business source license(?: 1 1)?", 86, 0.95),
    ("busl-1.1", "change", r"effective on the change date or the fourth anniversary of the first publicly available distribution", 90, 0.95),
    ("sspl-1.0", "server", r"server side public license", 88, 0.95),
    ("elastic-2.0", "elastic", r"elastic license(?: 2 0)?", 84, 0.9),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service", 90, 0.95),
    ("commons-clause", "clause", r"commons clause license condition", 90, 0.95),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use) license", 90, 0.95),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?: [ms]){0,2}(?: license)?", 84, 0.85),
    ("non-commercial", "commercial", r"for (?:personal|research|academic|educational)(?: and| or)? non ?commercial use only", 60, 0.6),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 50, 0.5),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|material) (?:\S+ ){0,6}is (?:strictly )?prohibited", 70, 0.8),
    ("proprietary", "reproduced", r"no part of this (?:\S+ ){1,3}may be reproduced (?:\S+ ){0,12}without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 70, 0.8),
    ("all-rights-reserved", "rights", r"all rights reserved", 40, 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 20, 0.3),
]
