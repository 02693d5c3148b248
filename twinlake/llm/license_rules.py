"""Hand-written signatures of license texts: label | expression over a text's words joined by single spaces.

Words are lower-case letters and digits; every mark is a break, so "author's" is "author s" and "2.0" is "2 0".  Within a kind the order
is the order of the lines.
"""

from __future__ import annotations

#: Fixed values.  Words of the licenses' own texts.
TEXTS = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies
mit | the software is provided as is without warranty of any kind express or implied
mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | whether in an action of contract tort or otherwise arising from out of or in connection with the software
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-x11 | except as contained in this notice the name of the x consortium shall not be used in advertising
mit-x11 | except as contained in this notice the names? of the (?:above )?(?:copyright holders?|authors?) shall not be used in advertising
bsd-2-clause | redistributions of source code must retain the above copyright notice
bsd-2-clause | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | this software is provided by the (?:author|authors|copyright holders?|regents)(?: and contributors)? as is and any express or implied warranties
bsd-2-clause | the views and conclusions contained in the software and documentation are those of the authors
bsd-3-clause | neither the names? of (?:the )?[^ ]+(?: [^ ]+){0,6} nor the names of (?:its|their|the) contributors may be used
bsd-3-clause | the name of the author may not be used to endorse or promote products derived from this software
bsd-3-clause | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause-clear | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | all advertising materials mentioning features or use of this software must display
bsd-4-clause | this product includes software developed by the university of california
bsd-protection | this license does not apply to any software that links to the libraries provided by this software
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | provided that the above copyright notice and this permission notice appear in all copies
isc | the author disclaims all warranties with regard to this software including all implied warranties of merchantability
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
ntp | this software is provided as is without express or implied warranty (?:and )?with no claim as to its suitability for any purpose
apache-1.1 | the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment
apache-1.1 | this product includes software developed by the apache software foundation
apache-1.1 | products derived from this software may not be called apache nor may apache appear in their name
apache-2.0 | you may not use this file except in compliance with the license
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license
apache-2.0 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | you must give any other recipients of the work or derivative works a copy of this license
apache-2.0 | if the work includes a notice text file as part of its distribution
apache-2.0 | see the license for the specific language governing permissions and limitations under the license
gpl | this program is free software you can redistribute it and or modify
gpl | either version [0-9] of the license or at your option any later version
gpl | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | you should have received a copy of the gnu general public license along with
gpl | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | when we speak of free software we are referring to freedom not price
gpl-2.0 | you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
gpl-2.0 | this license applies to any program or other work which contains a notice placed by the copyright holder
gpl-2.0 | you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl-3.0 | you may convey verbatim copies of the program s source code as you receive it in any medium
gpl-3.0 | no covered work shall be deemed part of an effective technological measure
gpl-3.0 | the corresponding source for a work in source code form is that same work
gpl-2.0-only | (?:you can redistribute it and or modify it )?under the terms of version 2 of the gnu general public license as published
gpl-3.0-linking | the program to link the code of portions of this program with the openssl library
gpl-classpath-exception | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-bison-exception | you may create a larger work that contains part or all of the bison parser skeleton
gpl-gcc-exception | additional permission under gnu gpl version 3 section 7
gpl-linux-syscall | this copyright does not cover user programs that use kernel services by normal system calls
lgpl | this library is free software you can redistribute it and or modify
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl-2.1 | this license agreement applies to any software library or other program which contains a notice placed by the copyright holder
lgpl-2.1 | a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl-2.0 | gnu library general public license
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
lgpl-3.0 | you may convey a covered work under sections 3 and 4 of this license without being bound by section 3
agpl | offering? users? interacting with it remotely through a computer network
agpl | you should have received a copy of the gnu affero general public license along with
agpl-3.0 | if you modify the program your modified version must prominently offer all users interacting with it remotely
agpl-1.0 | if the program as you received it is intended to interact with users through a computer network
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | with no invariant sections no front cover texts and no back cover texts
gfdl | a secondary section is a named appendix or a front matter section of the document
mpl-2.0 | this source code form is subject to the terms of the mozilla public license
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | incompatible with secondary licenses
mpl-1.1 | the contents of this file are subject to the mozilla public license version
mpl-1.1 | software distributed under the license is distributed on an as is basis without warranty of any kind either express(?:ed)? or implied see the license
mpl-1.1 | alternatively the contents of this file may be used under the terms of either the gnu general public license
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
epl-1.0 | the accompanying program is provided under the terms of this eclipse public license
epl-2.0 | this source code may also be made available under the following secondary licenses when the conditions
cpl-1.0 | the accompanying program is provided under the terms of this common public license
ipl-1.0 | the accompanying program is provided under the terms of this ibm public license
cddl | the contents of this file are subject to the terms of the common development and distribution license
cddl | when distributing covered code include this cddl header in each file
cddl-1.0 | you can obtain a copy of the license at usr src opensolaris license
artistic | the intent of this document is to state the conditions under which a package may be copied
artistic-1.0 | you may distribute the programs of this package in object code or executable form provided that you do at least one
artistic-2.0 | this license establishes the terms under which a given free software package may be copied modified distributed
perl | this (?:program|library|module) is free software you (?:can|may) (?:redistribute|copy or redistribute) it (?:and or modify it )?under the same terms as perl itself
zlib | altered source versions must be plainly marked as such
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | the png reference library is supplied as is
libpng | this code is released under the libpng license
ijg | this software is based in part on the work of the independent jpeg group
bzip2 | this program bzip2 the associated library libbzip2 and all documentation are copyright
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | the names openssl toolkit and openssl project must not be used to endorse
ssleay | this product includes cryptographic software written by eric young
php-3.01 | this product includes php software freely available from
php-3.01 | products derived from this software may not be called php nor may php appear in their name
python-2.0 | psf is making python available to licensee on an as is basis
python-2.0 | subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive
cnri-python | cnri hereby grants licensee a nonexclusive royalty free world wide license
ruby | you may redistribute it and or modify it under either the terms of the 2 clause bsdl
tcl | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
vim | there are no restrictions on distributing unmodified copies of vim except that they must include this license text
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode | unicode data files include all data files under the directories
icu | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .{0,200}provided that the above copyright notice s
w3c | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
w3c | pre existing intellectual property disclaimers notices or terms and conditions if none exist a short notice
w3c-document | no right to create modifications or derivatives of w3c documents is granted
ncsa | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,80}with the software without restriction
ncsa | neither the names of [^ ]+(?: [^ ]+){0,6} nor the names of its contributors may be used to endorse or promote products derived from this software
upl-1.0 | every copyright and patent claims? (?:it|they) can license
upl-1.0 | the above copyright notice and either this complete permission notice or at a minimum a reference to the upl
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell or distribute this software either in source code form
unlicense | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
wtfpl | you just do what the fuck you want to
beerware | as long as you retain this notice you can do whatever you want with this stuff
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer
jslint | the software shall be used for good not evil
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
bsl-1.0 | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
bsl-1.0 | distributed under the boost software license
ofl | this font software is licensed under the sil open font license
ofl | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
ofl | reserved font name refers to any names specified as such after the copyright statement
gust-font | this work may be distributed and or modified under the conditions of the latex project public license
lppl | this work has the lppl maintenance status
lppl | the current maintainer of this work is
bitstream-vera | bitstream vera is a trademark of bitstream inc
ubuntu-font | ubuntu font licen[cs]e
eupl | licensed under the eupl version
eupl | the work is provided under the terms of this licen[cs]e when the licensor
osl-3.0 | licensed under the open software license version 3 0
afl-3.0 | licensed under the academic free license version 3 0
ms-pl | this license governs use of the accompanying software if you use the software you accept this license
ms-pl | the terms reproduce reproduction derivative works and distribution have the same meaning here as under u s copyright law
ms-rl | for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code
cecill | this software is governed by the cecill(?: [abc])? license under french law
cecill | ce logiciel est régi par la licence cecill
cecill | the exercising of these rights is conditional upon the obligations
mulan-psl | you can use this software according to the terms and conditions of the mulan psl
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
qpl | the q public license
qpl | you may copy this software under the terms of this license
rpl | unless explicitly acquired and licensed from licensor under the technical pursuit license
watcom | sybase open watcom public license
apsl | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license
nposl | non profit open software license
erlpl | the contents of this file are subject to the erlang public license
intel | intel open source license
naumen | naumen public license
zope | zope public license
zope | this software is copyrighted by zope (?:corporation|foundation)
eiffel | eiffel forum license
entessa | entessa public license
fair | usage of the works is permitted provided that this instrument is retained with the works
fair | works are provided as is without any warranty
motosoto | motosoto open source license
multics | historical background this edition of the multics software materials
nokia | nokia open source license
oclc | oclc research public license
realnetworks | realnetworks public source license
ricoh | ricoh source code public license
sun-public | sun public license
vovida | vovida software license
xnet | x net inc license
odbl | this [^ ]+(?: [^ ]+){0,4} is made available under the open database license
odbl | any rights in individual contents of the database are licensed under the database contents license
odc-by | this [^ ]+(?: [^ ]+){0,4} is made available under the open data commons attribution license
pddl | this [^ ]+(?: [^ ]+){0,4} is made available under the public domain dedication and license
cdla-permissive | community data license agreement permissive
cdla-sharing | community data license agreement sharing
ogl-uk | contains public sector information licensed under the open government licen[cs]e
ogl-uk | open government licen[cs]e v[0-9]
etalab | licence ouverte
dl-de-by | datenlizenz deutschland namensnennung
dl-de-zero | datenlizenz deutschland zero
sspl | if you make the functionality of the program or a modified version available to third parties as a service
busl | use of the licensed work is hereby granted .{0,60}non production use
busl | the business source license this document or the license is not an open source license
elastic | you may not provide the software to third parties as a hosted or managed service
commons-clause | the software is provided to you by the licensor under the license .{0,80}subject to the following condition
commons-clause | does not grant to you the right to sell the software
polyform-noncommercial | any noncommercial purpose is a permitted purpose
polyform-shield | any purpose is a permitted purpose except for providing any product that competes
confluent | confluent community license
prosperity | the prosperity public license
parity | the parity public license
anti-996 | the individual or the legal entity must conform to the local labor related laws
hippocratic | hippocratic license
openrail | use restrictions .{0,40}the model and derivatives of the model
openrail | open rail m license
responsible-ai | you agree not to use the model or derivatives of the model
llama | llama [0-9](?: [0-9])? community license
llama | a limited license to use the llama materials
gemma | gemma terms of use
cc0 | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | to the extent possible under law [^ ]+(?: [^ ]+){0,6} has waived all copyright and related or neighboring rights
cc0 | you can copy modify distribute and perform the work even for commercial purposes all without asking permission
cc-by | you are free to share copy and redistribute the material in any medium or format
cc-by | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by | you may do so in any reasonable manner but not in any way that suggests the licensor endorses you
cc-by-sa | you must distribute your contributions under the same license as the original
cc-by-sa | if you remix transform or build upon the material you must distribute
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material
cc-by-nd | you may not distribute the modified material
cc-sampling | creative commons sampling plus
cc-devnations | creative commons developing nations
free-art | free art license
free-art | licence art libre
design-science | design science license
gnu-all-permissive | copying and distribution of this file with or without modification are permitted in any medium without royalty
fsf-unlimited | this file is free software the free software foundation gives unlimited permission to copy
public-domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain | this (?:work|file|software|document|text) is (?:in|part of) the public domain
public-domain | has waived all copyright and related or neighboring rights
public-domain | no copyright is claimed
us-government | this is a work of the u(?:nited)? s(?:tates)? government and is not subject to copyright protection
us-government | not subject to copyright protection (?:and is )?in the (?:united states|public domain)
project-gutenberg | this (?:ebook|etext) is for the use of anyone anywhere
project-gutenberg | the full project gutenberg license
proprietary | all rights reserved
proprietary | alle rechte vorbehalten
proprietary | tous droits réservés
proprietary | todos los derechos reservados
proprietary | this (?:software|document|work) is (?:confidential and )?proprietary
proprietary | may not be reproduced in whole or in part without (?:the )?(?:prior )?written permission
proprietary | may not be (?:copied|reproduced|redistributed|published|broadcast)(?: (?:copied|reproduced|published|broadcast|rewritten|or))*+ redistributed without permission
proprietary | unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: [^ ]+){0,8} is (?:strictly )?prohibited
proprietary | no part of this (?:publication|book|document|work) may be reproduced
proprietary | contains trade secrets and (?:confidential|proprietary) information
proprietary | (?:by (?:installing|using|downloading) .{0,60}you agree to be bound by|subject to) (?:the terms of )?this end user license agreement
evaluation-only | for (?:evaluation|internal use|personal use|educational use|research purposes) only
non-commercial | for non ?commercial (?:use|purposes)(?: only)?
non-commercial | not (?:be used )?for commercial (?:use|purposes)
"""
