"""License scans: ordered signature rules over the words of a text.

Rules are regexes over the lower-cased words joined by single blanks. Each rule names keywords, one of which
must be a part of the text before it is tried. Detections are resolved in order of priority, then length,
then place: one that lies inside an interval already kept is suppressed. Base phrases always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License families: label, pattern of the name, pattern of the identifier, whole-text signature.
FAMILIES: list[tuple[str, str, str, str]] = [
    ("mit", r"mit(?: expat)?|expat", r"mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", r"mit no attribution", r"mit 0", r"mit no attribution"),
    ("apache-2.0", r"apache(?: software)? license(?: version| v)? 2(?: 0)?|asl 2(?: 0)?", r"apache 2(?: 0)?", r"you may not use this file except in compliance with the license"),
    ("apache-1.1", r"apache(?: software)? license(?: version| v)? 1 1", r"apache 1 1", r"this product includes software developed by the apache software foundation"),
    ("gpl-3.0", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?|gnu gpl(?: version| v)? ?3", r"a?gpl ?(?:v ?)?3(?: 0)?(?: only| or later)?", r"either version 3 of the license or at your option any later version"),
    ("gpl-2.0", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?|gnu gpl(?: version| v)? ?2", r"gpl ?(?:v ?)?2(?: 0)?(?: only| or later)?", r"either version 2 of the license or at your option any later version"),
    ("gpl", r"gnu general public license|gnu gpl", r"gpl", r"this program is free software you can redistribute it and or modify it"),
    ("lgpl-3.0", r"gnu lesser general public license(?: version| v)? 3(?: 0)?", r"lgpl ?(?:v ?)?3(?: 0)?(?: only| or later)?", r"this version of the gnu lesser general public license incorporates"),
    ("lgpl-2.1", r"gnu lesser general public license(?: version| v)? 2 1", r"lgpl ?(?:v ?)?2 1(?: only| or later)?", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl", r"gnu (?:lesser|library) general public license", r"lgpl", r"this library is free software you can redistribute it and or modify it"),
    ("agpl-3.0", r"gnu affero general public license(?: version| v)?(?: 3(?: 0)?)?", r"agpl ?(?:v ?)?3(?: 0)?(?: only| or later)?", r"remote network interaction use with the gnu general public license"),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause) bsd", r"bsd 3 clause", r"neither the name of [a-z0-9 ]{1,80}? nor the names of its contributors may be used"),
    ("bsd-2-clause", r"(?:simplified|2 clause) bsd|freebsd", r"bsd 2 clause", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", r"(?:original|4 clause) bsd", r"bsd 4 clause", r"all advertising materials mentioning features or use of this software must display"),
    ("0bsd", r"zero clause bsd", r"0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"isc", r"isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", r"mozilla public license(?: version| v)? 2(?: 0)?", r"mpl 2 0", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", r"mozilla public license(?: version| v)? 1 1", r"mpl 1 1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", r"eclipse public license(?: version| v)? 2(?: 0)?", r"epl 2 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", r"eclipse public license(?: version| v)? 1(?: 0)?", r"epl 1 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", r"common development and distribution license(?: version| v)?(?: 1(?: 0)?)?", r"cddl 1 0", r"subject to the terms of the common development and distribution license"),
    ("cpl-1.0", r"common public license(?: version| v)?(?: 1(?: 0)?)?", r"cpl 1 0", r"this common public license agreement"),
    ("artistic-2.0", r"artistic license(?: version| v)? 2(?: 0)?", r"artistic 2 0", r"this license establishes the terms under which a given free software package may be copied"),
    ("artistic-1.0", r"artistic license(?: version| v)? 1(?: 0)?", r"artistic 1 0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("zlib", r"zlib(?: libpng)?", r"zlib", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", r"boost software license(?: version| v)?(?: 1(?: 0)?)?", r"bsl 1 0", r"boost software license version 1 0 august 17th 2003"),
    ("unlicense", r"unlicense", r"unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"do what the fuck you want to public license", r"wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0-1.0", r"(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)?", r"cc0 1 0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-4.0", r"creative commons attribution 4 0(?: international)?", r"cc by 4 0", r"creative commons attribution 4 0 international public license"),
    ("cc-by-3.0", r"creative commons attribution 3 0(?: unported)?", r"cc by 3 0", r"creative commons attribution 3 0 unported"),
    ("cc-by-sa-4.0", r"creative commons attribution share ?alike 4 0(?: international)?", r"cc by sa 4 0", r"creative commons attribution sharealike 4 0 international public license"),
    ("cc-by-sa-3.0", r"creative commons attribution share ?alike 3 0(?: unported)?", r"cc by sa 3 0", r"creative commons attribution sharealike 3 0 unported"),
    ("cc-by-nc-4.0", r"creative commons attribution non ?commercial(?: 4 0)?(?: international)?", r"cc by nc(?: 4 0)?", r"creative commons attribution noncommercial 4 0 international public license"),
    ("cc-by-nc-sa-4.0", r"creative commons attribution non ?commercial share ?alike(?: 4 0)?", r"cc by nc sa(?: 4 0)?", r"creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nd-4.0", r"creative commons attribution no ?deriv(?:ative)?s?(?: 4 0)?", r"cc by nd(?: 4 0)?", r"creative commons attribution noderivatives 4 0 international public license"),
    ("cc-by-nc-nd-4.0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: 4 0)?", r"cc by nc nd(?: 4 0)?", r"creative commons attribution noncommercial noderivatives 4 0 international"),
    ("ofl-1.1", r"sil open font license(?: version| v)?(?: 1 1)?", r"ofl 1 1", r"this font software is licensed under the sil open font license"),
    ("odbl-1.0", r"open (?:data commons open )?database license", r"odbl 1 0", r"made available under the open database license"),
    ("ms-pl", r"microsoft public license", r"ms pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", r"microsoft reciprocal license", r"ms rl", r"microsoft reciprocal license ms rl"),
    ("python-2.0", r"python software foundation license|psf license", r"python 2 0", r"this license agreement is between the python software foundation"),
    ("php-3.01", r"php license(?: version| v)?(?: 3 01)?", r"php 3 01", r"this source file is subject to version 3 01 of the php license"),
    ("postgresql", r"postgresql", r"postgresql", r"postgresql is released under the postgresql license"),
    ("openssl", r"openssl", r"openssl", r"this product includes software developed by the openssl project"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version| v)?(?: 1 2)?", r"eupl 1 2", r"licensed under the eupl"),
    ("upl-1.0", r"universal permissive license(?: version| v)?(?: 1 0)?", r"upl 1 0", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("ncsa", r"university of illinois ncsa open source", r"ncsa", r"university of illinois ncsa open source license"),
    ("vim", r"vim", r"vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("beerware", r"beer ?ware", r"beerware", r"you can buy me a beer in return"),
]

#: How a family's name or identifier stands in a text: order (smaller first), weight, pattern, keywords.
TEMPLATES: list[tuple[int, float, str, str]] = [
    (1, 1.0, r"spdx license identifier {id}(?= |$)", "spdx"),
    (2, 1.0, r"{text}", ""),
    (3, 0.95, r"(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:\w+ ){{0,2}}?under (?:the )?(?:terms of )?(?:the )?(?:(?:{name})(?: licen[cs]e)?|{id}(?: licen[cs]e)?)(?: version \d+(?: \d+)?)?(?= |$)", "under"),
    (4, 0.8, r"(?:(?:{name})|{id}) licen[cs]e(?= |$)", "licen"),
    # not where a name is a German word of the sentence: `die License mit der Klausel`
    (5, 0.6, r"licen[cs]e(?: is)?(?: the)? (?:{name}|{id})(?= |$)(?! (?:der|die|das|dem|den|des|ein|eine|einem|einen|einer|allen|nur|zusatz\w*)(?= |$))", "licen"),
]

#: Notices that name no license: label, pattern, keyword.
NOTICES: list[tuple[str, str, str]] = [
    ("copyright", r"copyright (?:c )?\d{4}|all rights reserved", "right"),
    ("public-domain", r"(?:in|to|into) the public domain", "public domain"),
    ("no-warranty", r"(?:without (?:any )?warrant(?:y|ies)|as is without warranty)", "warrant"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential|unauthorized (?:copying|use) (?:\w+ ){0,6}?(?:is )?strictly prohibited)", "proprietary|prohibited"),
]

#: Passages and addresses of single licenses: label, weight, pattern. Each holds its rule's keyword.
PASSAGES: list[tuple[str, float, str]] = [
    ("mit", 0.9, r"(?:www )?opensource org licenses mit(?: license)?(?: php)?"),
    ("mit", 0.8, r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions"),
    ("mit", 0.5, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("apache-2.0", 0.9, r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", 0.8, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 0.9, r"apache license version 2 0 january 2004"),
    ("gpl-3.0", 0.9, r"(?:www )?gnu org licenses (?:old licenses )?gpl (?:v3|3 0)(?: en)?(?: html| txt)?"),
    ("gpl-2.0", 0.9, r"(?:www )?gnu org licenses (?:old licenses )?gpl (?:v2|2 0)(?: en)?(?: html| txt)?"),
    ("gpl-3.0", 0.9, r"gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", 0.9, r"gnu general public license version 2 june 1991"),
    ("gpl", 0.8, r"you should have received a copy of the gnu general public license along with"),
    ("gpl", 0.6, r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", 0.8, r"under the same terms as (?:the )?gnu (?:emacs|gcc|general public license)"),
    ("lgpl-3.0", 0.9, r"(?:www )?gnu org licenses (?:old licenses )?lgpl (?:v3|3 0)(?: en)?(?: html| txt)?"),
    ("lgpl-2.1", 0.9, r"(?:www )?gnu org licenses (?:old licenses )?lgpl (?:v2 1|2 1)(?: en)?(?: html| txt)?"),
    ("lgpl", 0.8, r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl-2.1", 0.9, r"gnu lesser general public license version 2 1 february 1999"),
    ("agpl-3.0", 0.9, r"(?:www )?gnu org licenses agpl (?:v3|3 0)(?: en)?(?: html| txt)?"),
    ("agpl-3.0", 0.8, r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3.0", 0.9, r"gnu affero general public license version 3 19 november 2007"),
    ("bsd-3-clause", 0.9, r"(?:www )?opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 0.9, r"(?:www )?opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", 0.7, r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", 0.5, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", 0.5, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-4-clause", 0.8, r"this product includes software developed by the university of california berkeley and its contributors"),
    ("isc", 0.9, r"(?:www )?opensource org licenses isc(?: license)?(?: txt)?"),
    ("isc", 0.6, r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl-2.0", 0.9, r"(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", 0.9, r"(?:www )?mozilla org mpl mpl 1 1(?: html| txt)?"),
    ("mpl-2.0", 0.8, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-1.0", 0.9, r"(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", 0.9, r"(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("cddl-1.0", 0.9, r"(?:www )?opensource org licenses cddl ?1(?: 0)?(?: php)?"),
    ("cddl-1.0", 0.7, r"you can obtain a copy of the license at [a-z0-9 ]{1,80}? cddl"),
    ("artistic-2.0", 0.9, r"(?:www )?(?:opensource org licenses|perlfoundation org) artistic(?: license)? 2 0(?: php)?"),
    ("artistic-1.0", 0.6, r"under the same terms as perl itself"),
    ("zlib", 0.7, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.6, r"this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", 0.9, r"(?:www )?boost org license 1 0 txt"),
    ("unlicense", 0.9, r"for more information please refer to https? (?:www )?unlicense org"),
    ("wtfpl", 0.9, r"0 you just do what the fuck you want to"),
    ("cc0-1.0", 0.9, r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", 0.9, r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 0.9, r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", 0.9, r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 0.9, r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", 0.9, r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", 0.9, r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nd-4.0", 0.9, r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-nd-4.0", 0.9, r"creativecommons org licenses by nc nd 4 0"),
    ("ofl-1.1", 0.9, r"scripts sil org ofl"),
    ("ofl-1.1", 0.7, r"this license becomes null and void if any of the above conditions are not met"),
    ("odbl-1.0", 0.9, r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("python-2.0", 0.8, r"psf is making python available to licensee on an as is basis"),
    ("php-3.01", 0.9, r"(?:www )?php net license 3 01(?: txt)?"),
    ("postgresql", 0.8, r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("openssl", 0.8, r"the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("eupl-1.2", 0.9, r"joinup ec europa eu [a-z0-9 ]{0,40}?eupl"),
    ("ncsa", 0.8, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("beerware", 0.8, r"as long as you retain this notice you can do whatever you want with this stuff"),
]

#: Names and short forms that tell of a license alone: label, weight, pattern, and keywords of which every match has one.
SHORT_FORMS: list[tuple[str, float, str, str]] = [
    ("gpl-3.0", 0.7, r"gplv3(?: 0)?|gpl (?:v3|3)(?: 0)?(?: only| or later)", "gpl"),
    ("gpl-3.0", 0.6, r"gpl (?:v3|3 0)", "gpl"),
    ("gpl-2.0", 0.7, r"gplv2(?: 0)?|gpl (?:v2|2)(?: 0)?(?: only| or later)", "gpl"),
    ("gpl-2.0", 0.6, r"gpl (?:v2|2 0)", "gpl"),
    ("gpl-1.0", 0.6, r"gplv1|gpl (?:v1|1 0)(?: only| or later)?", "gpl"),
    ("lgpl-3.0", 0.7, r"lgplv3(?: 0)?|lgpl (?:v3|3)(?: 0)?(?: only| or later)?", "lgpl"),
    ("lgpl-2.1", 0.7, r"lgplv2 1|lgpl (?:v2|2) 1(?: only| or later)?", "lgpl"),
    ("lgpl-2.0", 0.6, r"lgplv2(?! 1)|lgpl (?:v2|2 0)(?! 1)(?: only| or later)?", "lgpl"),
    ("agpl-3.0", 0.7, r"agplv3(?: 0)?|agpl (?:v3|3)(?: 0)?(?: only| or later)?", "agpl"),
    ("apache-2.0", 0.6, r"apache 2 0", "apache 2"),
    ("apache-1.1", 0.6, r"apache 1 1", "apache 1"),
    ("mpl-2.0", 0.6, r"mplv2(?: 0)?|mpl 2 0", "mplv2|mpl 2 0"),
    ("mpl-1.1", 0.6, r"mplv1 1|mpl 1 1", "mplv1 1|mpl 1 1"),
    ("epl-2.0", 0.6, r"eplv2|epl 2 0", "eplv2|epl 2 0"),
    ("epl-1.0", 0.6, r"eplv1|epl 1 0", "eplv1|epl 1 0"),
    ("bsd-3-clause", 0.7, r"bsd 3 clause|three clause bsd|3 clause bsd", "bsd"),
    ("bsd-2-clause", 0.7, r"bsd 2 clause|two clause bsd|2 clause bsd", "bsd"),
    ("bsd-4-clause", 0.7, r"bsd 4 clause|four clause bsd|4 clause bsd", "bsd"),
    ("cc0-1.0", 0.6, r"cc0 1 0", "cc0"),
    ("cc-by-4.0", 0.6, r"cc by 4 0", "cc by"),
    ("cc-by-3.0", 0.6, r"cc by 3 0", "cc by"),
    ("cc-by-sa-4.0", 0.6, r"cc by sa 4 0", "cc by sa"),
    ("cc-by-sa-3.0", 0.6, r"cc by sa 3 0", "cc by sa"),
    ("cddl-1.0", 0.6, r"cddl 1 0", "cddl"),
    ("ofl-1.1", 0.6, r"ofl 1 1", "ofl 1 1"),
    ("zpl-2.1", 0.8, r"zope public license(?: zpl)?(?: version| v)?(?: 2 1)?|zpl 2 1", "zope public license|zpl 2 1"),
    ("cecill-2.1", 0.8, r"cecill(?: free software license agreement)?(?: version| v)? ?2 1", "cecill"),
    ("cecill-b", 0.8, r"cecill b", "cecill b"),
    ("cecill-c", 0.8, r"cecill c", "cecill c"),
    ("sspl-1.0", 0.8, r"server side public license(?: sspl)?(?: version| v)?(?: 1(?: 0)?)?|sspl(?: v1|v1| 1 0)", "server side public license|sspl"),
    ("elastic-2.0", 0.8, r"elastic license(?: version| v)? ?2(?: 0)?|elv2", "elastic license|elv2"),
    ("busl-1.1", 0.8, r"business source license(?: version| v)?(?: 1 1)?|busl 1 1", "business source license|busl 1 1"),
    ("afl-3.0", 0.8, r"academic free license(?: version| v)? ?3(?: 0)?|afl 3 0", "academic free license|afl 3 0"),
    ("osl-3.0", 0.8, r"open software license(?: version| v)? ?3(?: 0)?|osl 3 0", "open software license|osl 3 0"),
    ("blueoak-1.0.0", 0.8, r"blue ?oak model license(?: 1 0 0)?|blueoak 1 0 0", "blue oak model|blueoak"),
    ("mulanpsl-2.0", 0.8, r"mulan permissive software license(?: version| v)? ?2|mulanpsl 2 0", "mulan"),
]

_WORDS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    weight: float
    pattern: re.Pattern
    keywords: tuple[str, ...]
    #: Words of the family, one of which any text of the rule holds.
    family: tuple[str, ...] = ("",)


def _longest_word(pattern: str) -> str:
    plain = [w for w in re.split(r"[^a-z0-9 ]+", pattern)]
    return max((w.strip() for w in plain), key=len)


_GENERAL = {"license", "licen", "version", "public", "general", "software", "open", "the", "only", "or", "later", "as", "by", "at", "of", "and", "free", "foundation", "published", "either", "to"}
_GENERAL |= {"do", "what", "you", "want", "no", "non", "new", "data", "source"}  # the names that have them have others too


def _family_words(pattern: str) -> tuple[str, ...]:
    return tuple(sorted({" " + w for w in re.findall(r"[a-z]{2,}|0bsd|cc0", pattern)} - {" " + w for w in _GENERAL}))


def _own_keywords(name: str) -> tuple[str, ...]:
    """For each alternative of a name its part that is a keyword: 'licen', or what it begins with."""
    parts = re.split(r"\|(?![^(]*\))", name)
    return tuple(sorted({"licen" if "licen" in x else re.match(r"[a-z0-9 ]*[a-z0-9](?! ?\?)", x)[0] for x in parts}))


def build_rules() -> list[Rule]:
    rules = []
    for label, name, ident, text in FAMILIES:
        words = _family_words(f"{name}|{ident}")
        for order, weight, template, keyword in TEMPLATES:
            rules.append(Rule(order, label, weight, re.compile(r"(?:(?<= )|^)" + template.format(id=f"(?:{ident})", name=name, text=text)), (keyword or _longest_word(text),), words if keyword else ("",)))
        if "license" in name:  # a name of its own, without a phrase around it
            rules.append(Rule(5, label, 0.6, re.compile(rf"(?:(?<= )|^)(?:{name})(?= |$)"), _own_keywords(name), words))
    for label, weight, pattern in PASSAGES:
        rules.append(Rule(3, label, weight, re.compile(rf"(?:(?<= )|^)(?:{pattern})(?= |$)"), (_longest_word(re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]\S*|[a-z]\?", "|", pattern)),)))
    for label, weight, pattern, keyword in SHORT_FORMS:
        rules.append(Rule(5, label, weight, re.compile(rf"(?:(?<= )|^)(?:{pattern})(?= |$)"), tuple(keyword.split("|"))))
    for label, pattern, keyword in NOTICES:
        rules.append(Rule(6, label, 0.3, re.compile(r"(?:(?<= )|^)(?:" + pattern + r")(?= |$)"), tuple(keyword.split("|"))))
    return sorted(rules, key=lambda r: r.order)


RULES = build_rules()


#: The prefilter, from the rules' own keywords: phrases, one of which is enough, and keywords that need a family's word.
PHRASES = tuple(sorted({k for r in RULES if r.family == ("",) for k in r.keywords} | set(BASE)))
KEYWORDS = tuple(sorted({k for r in RULES if r.family != ("",) for k in r.keywords}))
WORDS = tuple(sorted({w for r in RULES if r.family != ("",) for w in r.family}))


def may_match(line: str) -> bool:
    """False only for a text that no rule and no base phrase matches."""
    padded = f" {line}"
    return any(k in line for k in PHRASES) or any(k in line for k in KEYWORDS) and any(w in padded for w in WORDS)


def detections(line: str) -> list[tuple[int, int, Rule]]:
    """Kept detections (start, end, rule) in the order of the text, over words joined by blanks."""
    found, padded = [], f" {line}"
    for rule in RULES:
        if any(k in line for k in rule.keywords) and any(w in padded for w in rule.family):
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(line) if m.end() > m.start()]
    kept: list[tuple[int, int, Rule]] = []
    reach = Reach(sorted({a for a, _, _ in found}))
    for a, b, rule in sorted(found, key=lambda x: (x[2].order, x[0] - x[1], x[0], x[2].label)):
        if reach.to(a) < b:  # no interval already kept holds it
            kept.append((a, b, rule))
            reach.add(a, b)
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


class Reach:
    """The greatest end of the intervals added that start at a place or before it, in logarithmic time."""

    def __init__(self, starts: list[int]):
        self.starts, self.ends = starts, [0] * (len(starts) + 1)

    def to(self, start: int) -> int:
        k, most = bisect_right(self.starts, start), 0
        while k:
            most = max(most, self.ends[k])
            k &= k - 1
        return most

    def add(self, start: int, end: int) -> None:
        k = bisect_right(self.starts, start)
        while k < len(self.ends):
            self.ends[k] = max(self.ends[k], end)
            k += k & -k


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    words = raw.split()
    line = b" ".join(words).decode("utf-8", "surrogatepass")
    if not may_match(line):
        return len(words), 0, None, None, "", "", 0.0, ""
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    word_at = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  words before a place
    places, base = [], set()
    for phrase, label in BASE.items():
        at = line.find(phrase)
        while at >= 0:
            if (at == 0 or line[at - 1] == " ") and line[at + len(phrase) : at + len(phrase) + 1] in ("", " "):
                places.append(word_at(at))
                base.add(label)
            at = line.find(phrase, at + 1)
    kept = detections(line)
    labels = base | {r.label for _, _, r in kept}
    miss = 1.0
    for _, _, r in kept:
        miss *= 1 - r.weight
    spans = ",".join(f"{r.label}:{word_at(a)}:{word_at(b) + 1}" for a, b, r in kept)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max(1 - miss, 0.8 if base else 0.0), spans


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_scan(docs: DataFrame) -> DataFrame:
    """Counts, labels, score and spans (label:first word:end) for each row of docs(doc_id, text).

    A null text counts as empty: no words, empty labels, score 0. Repeated rows give a row each, a null
    doc_id stays null, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for rows in batches:
            found = pd.DataFrame([scan(x) for x in rows["text"]], columns=names).astype({"first_word": "Int64", "last_word": "Int64"})
            found.insert(0, "doc_id", rows["doc_id"].to_numpy())
            yield found

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCANNED)
