"""Signature rules of licenses, written by hand over lower-case words.

A pattern is a regular expression without look-around and capturing groups, in which a space stands between
words (``dashed``, ``slashed`` and ``dotted`` names are words with spaces: ``apache 2 0``). It begins and ends
with whole words. The keyword of an entry are words (or alternatives, parted by a stroke) that stand one after the other
in every match of its pattern; a text without them is never tested.

For a license there are: its SPDX identifiers, its names (keyword, pattern), its addresses (keyword,
pattern) and sentences of its own text (keyword, pattern).
"""

from __future__ import annotations

from dataclasses import dataclass

#: Ranks: a detection gives way to one of the same or a lower rank that contains it. Confidence goes with rank.
SPDX, NOTICE, TEXT, NAME, ADDRESS, PHRASE = range(1, 7)
CONFIDENCE = {SPDX: 1.0, NOTICE: 0.95, TEXT: 0.9, NAME: 0.8, ADDRESS: 0.7, PHRASE: 0.5}

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

V = "(?:version |v ?)?"
L = "licen[sc]e"
GPL = f"(?:gnu )?(?:general public {L}|gpl)"
LGPL = f"(?:gnu )?(?:lesser|library) general public {L}"
AGPL = f"(?:gnu )?affero general public {L}"

#: label: (SPDX identifiers, names, addresses, sentences)
LICENSES: dict[str, tuple[str, list, list, list]] = {
    "mit": (
        "mit",
        [("mit", f"mit {L}"), ("expat", f"(?:mit )?expat {L}"), ("mit x11", f"mit x11(?: {L})?")],
        [("opensource org", f"opensource org {L}s mit"), ("mit", f"mit {L} (?:org|txt|md)")],
        [
            ("is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
            ("sublicense", "use copy modify merge publish distribute sublicense and or sell copies"),
            ("substantial portions", "shall be included in all copies or substantial portions of the software"),
        ],
    ),
    "mit-0": ("mit 0", [("attribution", "mit no attribution")], [], []),
    "apache-1.1": ("apache 1 1", [("apache", f"apache (?:software )?{L} {V}1 1")], [("apache org", f"apache org {L}s {L} 1 1")], []),
    "apache-2.0": (
        "apache 2 0",
        [("apache", f"apache (?:software )?(?:{L} )?{V}2(?: 0)?(?: {L})?"), ("asl 2 0", "asl 2 0"), ("apache2", f"apache2(?: {L})?")],
        [("apache org", f"apache org {L}s {L} 2 0"), ("opensource org", f"opensource org {L}s apache 2 0")],
        [
            ("in compliance with", "you may not use this file except in compliance with the license"),
            ("as is basis", "is distributed on an as is basis without warranties or conditions of any kind"),
            ("specific language governing", "see the license for the specific language governing permissions and limitations under the license"),
        ],
    ),
    "gpl-1.0": ("gpl 1 0(?: only| or later)?", [("general public", f"(?:gnu )?general public {L} {V}1(?: 0)?"), ("gpl", "(?:gnu )?gpl (?:v ?)?1(?: 0)?")], [], []),
    "gpl-2.0": (
        "gpl 2 0(?: only)?",
        [("general public", f"(?:gnu )?general public {L} {V}2(?: 0)?(?: only)?"), ("gplv2", "gplv2"), ("gpl 2", "(?:gnu )?gpl 2(?: 0)?"), ("gpl", "(?:gnu )?gpl v(?:ersion )? ?2(?: 0)?")],
        [("gnu org", f"gnu org {L}s (?:old {L}s )?gpl 2 0"), ("opensource org", f"opensource org {L}s gpl 2 0")],
        [("version 2", f"under the terms of the gnu general public {L} as published by the free software foundation version 2")],
    ),
    "gpl-2.0-or-later": (
        "gpl 2 0 or later",
        [("any later version", f"{GPL} {V}2(?: 0)? or (?:at your option )?any later version"), ("gplv2", "gplv2 or later")],
        [],
        [("either version 2", "either version 2 of the license or at your option any later version")],
    ),
    "gpl-3.0": (
        "gpl 3 0(?: only)?",
        [("general public", f"(?:gnu )?general public {L} {V}3(?: 0)?(?: only)?"), ("gplv3", "gplv3"), ("gpl 3", "(?:gnu )?gpl 3(?: 0)?"), ("gpl", "(?:gnu )?gpl v(?:ersion )? ?3(?: 0)?")],
        [("gnu org", f"gnu org {L}s gpl 3 0"), ("opensource org", f"opensource org {L}s gpl 3 0")],
        [("version 3", f"under the terms of the gnu general public {L} as published by the free software foundation version 3"), ("copyleft", "is a free copyleft license for software and other kinds of works")],
    ),
    "gpl-3.0-or-later": (
        "gpl 3 0 or later",
        [("any later version", f"{GPL} {V}3(?: 0)? or (?:at your option )?any later version"), ("gplv3", "gplv3 or later")],
        [],
        [("either version 3", "either version 3 of the license or at your option any later version")],
    ),
    "gpl": (
        "gpl",
        [("general public", f"gnu general public {L}"), ("gnu gpl", "gnu gpl"), ("gpl", f"gpl {L}d?")],
        [("gnu org", f"gnu org (?:copyleft gpl(?: html)?|{L}s gpl(?: html| txt)?)")],
        [("received a copy of the gnu general", f"you should have received a copy of the gnu general public {L}"), ("free software foundation", "as published by the free software foundation")],
    ),
    "lgpl-2.0": ("lgpl 2 0(?: only| or later)?", [("library general", f"(?:gnu )?library general public {L}(?: {V}2(?: 0)?)?"), ("lgpl 2 0", "lgpl 2 0")], [], []),
    "lgpl-2.1": (
        "lgpl 2 1(?: only| or later)?",
        [("lesser general", f"(?:gnu )?lesser general public {L} {V}2 1"), ("lgplv2", "lgplv2(?: 1)?"), ("lgpl 2 1", "lgpl 2 1"), ("lgpl", "lgpl v(?:ersion )? ?2 1")],
        [("gnu org", f"gnu org {L}s (?:old {L}s )?lgpl 2 1")],
        [("either version 2 1", "either version 2 1 of the license or at your option any later version")],
    ),
    "lgpl-3.0": (
        "lgpl 3 0(?: only| or later)?",
        [("lesser general", f"(?:gnu )?lesser general public {L} {V}3(?: 0)?"), ("lgplv3", "lgplv3"), ("lgpl 3", "lgpl 3(?: 0)?"), ("lgpl", "lgpl v(?:ersion )? ?3(?: 0)?")],
        [("gnu org", f"gnu org {L}s lgpl 3 0")],
        [],
    ),
    "lgpl": (
        "lgpl",
        [("general public", LGPL), ("gnu lgpl", "gnu lgpl"), ("lgpl", f"lgpl {L}d?")],
        [("gnu org", f"gnu org (?:copyleft lesser(?: html)?|{L}s lgpl(?: html| txt)?)")],
        [("copy of the gnu lesser", f"you should have received a copy of the gnu lesser general public {L}")],
    ),
    "agpl-3.0": (
        "agpl 3 0(?: only| or later)?",
        [("affero", f"{AGPL} {V}3(?: 0)?"), ("agplv3", "agplv3"), ("agpl 3", "(?:gnu )?agpl 3(?: 0)?"), ("agpl", "agpl v(?:ersion )? ?3(?: 0)?")],
        [("gnu org", f"gnu org {L}s agpl 3 0")],
        [],
    ),
    "agpl": (
        "agpl",
        [("affero", AGPL), ("gnu agpl", "gnu agpl"), ("agpl", f"agpl {L}d?")],
        [("gnu org", f"gnu org {L}s agpl(?: html| txt)?")],
        [("copy of the gnu affero", f"you should have received a copy of the gnu affero general public {L}")],
    ),
    "gfdl": (
        "gfdl 1 [123](?: only| or later)?",
        [("free documentation", f"(?:gnu )?free documentation {L}(?: {V}1 [123])?"), ("gfdl", "(?:gnu )?gfdl(?: 1 [123])?")],
        [("gnu org", f"gnu org (?:copyleft fdl|{L}s fdl)(?: [0-9] [0-9])?(?: html)?")],
        [("invariant sections", "with no invariant sections no front cover texts and no back cover texts")],
    ),
    "bsd-2-clause": (
        "bsd 2 clause",
        [("clause bsd|simplified bsd", f"(?:2|two) clause (?:simplified )?bsd(?: {L})?"), ("simplified bsd", f"simplified bsd(?: {L})?"), ("bsd 2", f"bsd 2 clause(?: {L})?"), ("freebsd", f"freebsd {L}")],
        [("opensource org", f"opensource org {L}s bsd 2 clause")],
        [],
    ),
    "bsd-3-clause": (
        "bsd 3 clause",
        [("bsd", f"(?:3|three) clause (?:new |modified )?bsd(?: {L})?"), ("bsd", f"(?:new|modified|revised) bsd {L}"), ("bsd 3", f"bsd 3 clause(?: {L})?")],
        [("opensource org", f"opensource org {L}s bsd 3 clause")],
        [("endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission")],
    ),
    "bsd-4-clause": (
        "bsd 4 clause",
        [("bsd", f"(?:4|four) clause bsd(?: {L})?"), ("original bsd", f"original bsd {L}"), ("bsd 4", f"bsd 4 clause(?: {L})?")],
        [],
        [("advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement")],
    ),
    "0bsd": ("0bsd", [("zero", f"(?:bsd )?zero clause bsd(?: {L})?"), ("bsd zero", f"bsd zero clause(?: {L})?"), ("0bsd", f"0bsd(?: {L})?")], [("opensource org", f"opensource org {L}s 0bsd")], []),
    "bsd": (
        "bsd",
        [("bsd", f"bsd (?:style )?{L}"), ("berkeley", f"berkeley software distribution {L}")],
        [("opensource org", f"opensource org {L}s bsd {L}(?: php)?")],
        [
            ("redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
            ("redistributions of source", "redistributions of source code must retain the (?:above )?copyright notice"),
            ("redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
        ],
    ),
    "isc": (
        "isc",
        [("isc", f"isc {L}"), ("internet systems", f"internet systems consortium {L}")],
        [("opensource org", f"opensource org {L}s isc(?: {L}(?: txt)?)?")],
        [("with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")],
    ),
    "mpl-1.1": ("mpl 1 1", [("mozilla", f"mozilla public {L} {V}1 1"), ("mpl", "mpl (?:v ?)?1 1")], [("mozilla org", "mozilla org mpl(?: mpl)? 1 1(?: html)?")], []),
    "mpl-2.0": (
        "mpl 2 0",
        [("mozilla", f"mozilla public {L} {V}2(?: 0)?"), ("mpl", "mpl (?:v ?)?2(?: 0)?"), ("mplv2", "mplv2(?: 0)?")],
        [("mozilla org", "mozilla org (?:en us )?mpl 2 0"), ("opensource org", f"opensource org {L}s mpl 2 0")],
        [("mozilla", f"subject to the terms of the mozilla public {L} v 2 0"), ("copy of the mpl", "if a copy of the mpl was not distributed with this file")],
    ),
    "mpl": ("mpl", [("mozilla", f"mozilla public {L}")], [("mozilla org", "mozilla org mpl")], []),
    "epl-1.0": ("epl 1 0", [("eclipse", f"eclipse public {L} {V}1(?: 0)?"), ("epl", "epl (?:v ?)?1 0")], [("eclipse org", f"eclipse org legal epl v10(?: html)?")], []),
    "epl-2.0": ("epl 2 0", [("eclipse", f"eclipse public {L} {V}2(?: 0)?"), ("epl", "epl (?:v ?)?2 0")], [("eclipse org", "eclipse org legal epl (?:v20|2 0)(?: html)?")], []),
    "epl": ("epl", [("eclipse", f"eclipse public {L}")], [("eclipse org", "eclipse org legal epl")], []),
    "edl-1.0": ("edl 1 0", [("eclipse", f"eclipse distribution {L}(?: {V}1 0)?")], [("eclipse org", "eclipse org org documents edl v10(?: php)?")], []),
    "cddl-1.0": ("cddl 1 0", [("development and", f"common development and distribution {L} {V}1 0"), ("cddl", "cddl 1 0")], [("opensource org", f"opensource org {L}s cddl 1 0")], []),
    "cddl-1.1": ("cddl 1 1", [("development and", f"common development and distribution {L} {V}1 1"), ("cddl", "cddl 1 1")], [], []),
    "cddl": ("cddl", [("development and", f"common development and distribution {L}"), ("cddl", f"cddl {L}")], [], [("cddl", "subject to the terms of the common development and distribution license cddl")]),
    "cpl-1.0": ("cpl 1 0", [("common public", f"common public {L}(?: {V}1 0)?"), ("cpl", "cpl 1 0")], [("opensource org", f"opensource org {L}s cpl1 0(?: php)?")], []),
    "artistic-1.0": ("artistic 1 0", [("artistic", f"artistic {L} 1 0")], [("opensource org", f"opensource org {L}s artistic {L} 1 0")], []),
    "artistic-2.0": ("artistic 2 0", [("artistic", f"artistic {L} {V}2(?: 0)?")], [("opensource org", f"opensource org {L}s artistic {L} 2 0"), ("perlfoundation", f"perlfoundation org artistic {L} 2 0")], []),
    "artistic": ("artistic", [("artistic", f"(?:perl )?artistic {L}")], [], [("same terms as perl", "under the same terms as perl(?: itself)?")]),
    "bsl-1.0": ("bsl 1 0", [("boost", f"boost software {L}(?: {V}1 0)?")], [("boost org", f"boost org {L} 1 0(?: txt)?")], []),
    "busl-1.1": ("busl 1 1", [("business source", f"business source {L}(?: {V}1 1)?"), ("busl", "busl 1 1")], [("mariadb", "mariadb com bsl11")], [("production use", f"non production use of the licensed work")]),
    "elastic-2.0": ("elastic 2 0", [("elastic", f"elastic {L} {V}2(?: 0)?")], [("elastic co", f"elastic co licensing elastic {L}")], []),
    "sspl-1.0": ("sspl 1 0", [("server side", f"server side public {L}(?: {V}1)?"), ("sspl", "sspl(?: v1| 1 0)?")], [("mongodb com", f"mongodb com licensing server side public {L}")], []),
    "zlib": ("zlib", [("zlib", f"zlib(?: libpng)? {L}")], [("opensource org", f"opensource org {L}s zlib")], [("altered source versions", "altered source versions must be plainly marked as such")]),
    "libpng": ("libpng(?: 2 0)?", [("libpng", f"libpng {L}")], [("libpng org", f"libpng org pub png src libpng {L}(?: txt)?")], []),
    "openssl": ("openssl", [("openssl", f"openssl {L}"), ("ssleay", f"ssleay {L}")], [], [("openssl toolkit", "software developed by the openssl project for use in the openssl toolkit")]),
    "unlicense": (
        "unlicense",
        [("unlicense", "unlicense"), ("un license", "the un license")],
        [("unlicense org", "unlicense org")],
        [("released into the public domain", "this is free and unencumbered software released into the public domain")],
    ),
    "wtfpl": ("wtfpl", [("wtfpl", f"wtfpl(?: {L})?"), ("the fuck you want", f"do what the fuck you want to public {L}")], [("wtfpl net", "wtfpl net")], []),
    "beerware": ("beerware", [("beer ware|beerware", f"beer ?ware {L}")], [], [("buy me a beer", "you can buy me a beer in return")]),
    "cc0-1.0": (
        "cc0 1 0",
        [("cc0", f"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"), ("commons zero", f"creative commons zero(?: {V}1 0)?(?: universal)?")],
        [("creativecommons org", "creativecommons org publicdomain zero 1 0")],
        [("waived all copyright", "has waived all copyright and related or neighboring rights")],
    ),
    "cc-pdm": ("cc pddc", [("public domain mark", "(?:creative commons )?public domain mark(?: 1 0)?")], [("creativecommons org", "creativecommons org publicdomain mark 1 0")], []),
    "cc-by-2.0": ("cc by 2 0", [("attribution 2", "creative commons attribution 2 0(?: generic)?"), ("cc by 2", "cc by 2 0")], [("creativecommons org", f"creativecommons org {L}s by 2 0")], []),
    "cc-by-3.0": ("cc by 3 0", [("attribution 3", "creative commons attribution 3 0(?: unported)?"), ("cc by 3", "cc by 3 0")], [("creativecommons org", f"creativecommons org {L}s by 3 0")], []),
    "cc-by-4.0": ("cc by 4 0", [("attribution 4", "creative commons attribution 4 0(?: international)?"), ("cc by 4", "cc by 4 0")], [("creativecommons org", f"creativecommons org {L}s by 4 0")], []),
    "cc-by-sa-3.0": ("cc by sa 3 0", [("alike 3|sharealike 3", "(?:creative commons )?attribution share ?alike 3 0(?: unported)?"), ("cc by sa", "cc by sa 3 0")], [("creativecommons org", f"creativecommons org {L}s by sa 3 0")], []),
    "cc-by-sa-4.0": ("cc by sa 4 0", [("alike 4|sharealike 4", "(?:creative commons )?attribution share ?alike 4 0(?: international)?"), ("cc by sa", "cc by sa 4 0")], [("creativecommons org", f"creativecommons org {L}s by sa 4 0")], []),
    "cc-by-nc-4.0": ("cc by nc 4 0", [("commercial 4|noncommercial 4", "(?:creative commons )?attribution non ?commercial 4 0(?: international)?"), ("cc by nc", "cc by nc 4 0")], [("creativecommons org", f"creativecommons org {L}s by nc 4 0")], []),
    "cc-by-nd-4.0": ("cc by nd 4 0", [("derivatives 4|noderivatives 4", "(?:creative commons )?attribution no ?derivatives 4 0(?: international)?"), ("cc by nd", "cc by nd 4 0")], [("creativecommons org", f"creativecommons org {L}s by nd 4 0")], []),
    "cc-by-nc-sa-4.0": ("cc by nc sa 4 0", [("alike 4|sharealike 4", "(?:creative commons )?attribution non ?commercial share ?alike 4 0(?: international)?"), ("cc by nc", "cc by nc sa 4 0")], [("creativecommons org", f"creativecommons org {L}s by nc sa 4 0")], []),
    "cc-by-nc-nd-4.0": ("cc by nc nd 4 0", [("derivatives 4|noderivatives 4", "(?:creative commons )?attribution non ?commercial no ?derivatives 4 0(?: international)?"), ("cc by nc", "cc by nc nd 4 0")], [("creativecommons org", f"creativecommons org {L}s by nc nd 4 0")], []),
    "cc-by-sa": ("cc by sa", [("alike|sharealike", f"creative commons attribution share ?alike(?: {L})?"), ("cc by sa", "cc by sa")], [("creativecommons org", f"creativecommons org {L}s by sa")], []),
    "cc-by-nc": ("cc by nc", [("commercial|noncommercial", f"creative commons attribution non ?commercial(?: {L})?"), ("cc by nc", "cc by nc")], [("creativecommons org", f"creativecommons org {L}s by nc")], []),
    "cc-by": ("cc by", [("commons attribution", f"creative commons attribution(?: {L})?"), ("cc by", f"cc by(?: {L})?")], [("creativecommons org", f"creativecommons org {L}s by")], []),
    "creative-commons": ("cc", [("creative commons", f"(?:a )?creative commons {L}")], [("creativecommons org", f"creativecommons org {L}s")], []),
    "odbl-1.0": ("odbl 1 0", [("open database", f"open (?:data commons open )?database {L}(?: 1 0)?"), ("odbl", "odbl(?: v1| 1 0)?")], [("opendatacommons", f"opendatacommons org {L}s odbl(?: 1 0)?")], []),
    "odc-by-1.0": ("odc by 1 0", [("open data commons", f"open data commons attribution {L}"), ("odc by", "odc by(?: 1 0)?")], [("opendatacommons", f"opendatacommons org {L}s by(?: 1 0)?")], []),
    "pddl-1.0": ("pddl 1 0", [("public domain dedication", f"public domain dedication and {L}"), ("pddl", "pddl(?: 1 0)?")], [("opendatacommons", f"opendatacommons org {L}s pddl(?: 1 0)?")], []),
    "eupl-1.1": ("eupl 1 1", [("european union", f"european union public {L} {V}1 1"), ("eupl", "eupl (?:v ?)?1 1")], [], []),
    "eupl-1.2": ("eupl 1 2", [("european union", f"european union public {L} {V}1 2"), ("eupl", "eupl (?:v ?)?1 2")], [], []),
    "eupl": ("eupl", [("european union", f"european union public {L}"), ("eupl", f"eupl {L}")], [("joinup", "joinup ec europa eu software page eupl")], []),
    "cecill-2.1": ("cecill 2 1", [("cecill", f"cecill (?:{L} )?(?:v ?)?2 1")], [], []),
    "cecill": ("cecill(?: 1 [01]| 2 0| b| c)?", [("cecill", f"cecill(?: [bc])? {L}"), ("cecill", f"(?:licence|licen[sc]e) cecill(?: [bc])?")], [("cecill info", f"cecill info {L}s")], []),
    "osl-3.0": ("osl 3 0", [("open software", f"open software {L}(?: {V}3 0)?"), ("osl", "osl 3 0")], [("opensource org", f"opensource org {L}s osl 3 0")], []),
    "afl-3.0": ("afl 3 0", [("academic free", f"academic free {L}(?: {V}[123] [01])?"), ("afl", "afl 3 0")], [("opensource org", f"opensource org {L}s afl 3 0")], []),
    "ofl-1.1": ("ofl 1 1", [("open font", f"(?:sil )?open font {L}(?: {V}1 1)?"), ("ofl", "sil ofl(?: 1 1)?")], [("scripts sil org", "scripts sil org ofl")], [("reserved font name", "with reserved font name")]),
    "python-2.0": ("python 2 0|psf 2 0", [("python", f"python software foundation {L}(?: {V}2)?"), ("psf", f"psf {L}"), ("python", f"python {L}")], [("docs python org", f"docs python org 3 {L}(?: html)?")], []),
    "php-3.01": ("php 3 01", [("php", f"php {L}(?: {V}3 0?1)?")], [("php net", f"php net {L} 3 01(?: txt)?")], []),
    "ruby": ("ruby", [("ruby", f"ruby {L}"), ("ruby s", f"ruby s {L}")], [("ruby lang org", f"ruby lang org en (?:about )?{L}(?: txt)?")], []),
    "postgresql": ("postgresql", [("postgresql", f"postgresql {L}")], [("opensource org", f"opensource org {L}s postgresql")], []),
    "ncsa": ("ncsa", [("ncsa", f"(?:university of illinois )?ncsa open source {L}")], [("opensource org", f"opensource org {L}s ncsa")], []),
    "w3c": ("w3c(?: 20150513)?", [("w3c", f"w3c (?:software (?:notice and )?)?{L}")], [("w3 org", "w3 org consortium legal(?: [0-9]+)? copyright software(?: [0-9]+)?")], []),
    "ms-pl": ("ms pl", [("microsoft", f"microsoft public {L}"), ("ms pl", "ms pl")], [("opensource org", f"opensource org {L}s ms pl")], []),
    "ms-rl": ("ms rl", [("microsoft", f"microsoft reciprocal {L}"), ("ms rl", "ms rl")], [("opensource org", f"opensource org {L}s ms rl")], []),
    "vim": ("vim", [("vim", f"vim {L}")], [], []),
    "latex": ("lppl 1 3c", [("latex project", f"latex project public {L}(?: {V}1 3c?)?"), ("lppl", "lppl(?: 1 3c?)?")], [("latex project org", "latex project org lppl")], []),
    "qpl-1.0": ("qpl 1 0", [("q public", f"q public {L}(?: {V}1 0)?")], [], []),
    "public-domain": ("", [("public domain", "(?:is|are) (?:hereby )?(?:placed )?in the public domain"), ("public domain", "(?:dedicated|released|placed) (?:in)?to the public domain")], [], []),
    "all-rights-reserved": ("", [], [], [("all rights reserved", "copyright (?:c )?(?:[12][0-9]{3} ){1,4}(?:[^ ]+ ){0,8}all rights reserved"), ("proprietary", "proprietary and confidential"), ("unauthorized", "unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|material)")]),
    "non-commercial": ("", [], [], [("commercial|noncommercial", "for (?:personal and |educational and |research and )?non ?commercial (?:use|purposes?)(?: only)?")]),
    "generic-license": ("licenseref [^ ]+", [], [], [("under the terms of", f"{L}d under the terms of"), ("see", f"see (?:the )?{L} file"), ("agreement", f"end user {L} agreement"), ("full", f"for (?:the )?full {L}(?: text)?")]),
}

_UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|issued|offered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    rank: int
    keyword: str
    pattern: str
    base: bool = False

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.rank]


def _written() -> list[tuple[str, int, str, str, bool]]:
    found = [(label, PHRASE, phrase, phrase, True) for phrase, label in BASE]
    for label, (spdx, names, addresses, sentences) in LICENSES.items():
        if spdx:
            found.append((label, SPDX, "spdx", f"spdx license identifier (?:{spdx})", False))
        for keyword, pattern in names:
            found += [(label, NOTICE, keyword, f"{_UNDER}(?:{pattern})", False), (label, NAME, keyword, pattern, False)]
        found += [(label, ADDRESS, keyword, f"(?:https? )?(?:www )?(?:{pattern})", False) for keyword, pattern in addresses]
        found += [(label, TEXT, keyword, pattern, False) for keyword, pattern in sentences]
    return found


#: In order: of two detections of one rank and one place the rule that stands first wins.
RULES = tuple(Rule(number, *rule) for number, rule in enumerate(_written()))
