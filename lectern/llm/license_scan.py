"""Licence scans: sentences with known identifiers, and ordered rules over the sequences of identifiers.

A text is cut into sentences, each normalised to its tokens (lower-case letters and digits; quotes,
dashes, comment marks and line breaks vanish). A hash of the tokens looks the sentence up among the
known ones, so all but a few sentences end there; known ones that hold a stop themselves are looked up
by as many sentences in a row. What was found in a document is, in its order, a
sequence of identifiers; a rule is an ordered list of them. Longer rules go first, a sentence counts
for one rule, and between two sentences of a rule at most GAP tokens of other text may lie, or LONG_GAP
in a rule for a long licence's text, of which some telling sentences are known. Of the ways in which a rule
can match from a sentence on, the first in the order of the text counts.

Plan: one scan, no shuffle; sentences are hashed for many documents at once, in numpy. The rules are
part of the program and don't grow with the data.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import _text as T
from lectern.llm._tables import read_table

GAP = 40
LONG_GAP = 3000

SENTENCES: dict[str, list[str]] = {
    "mit.notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This software is released under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit.title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit.grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions"
    ],
    "mit.condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit.warranty": ["The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"],
    "mit.liability": [
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in "
        "connection with the software or the use or other dealings in the software"
    ],
    "apache.notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License)", "This project is licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache.use": ["You may not use this file except in compliance with the License"],
    "apache.copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache.warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache.see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3.notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl3.later": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl3.free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl.free": ["This program is free software"],
    "gpl3.terms": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2.terms": ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Either version 2 of the License, or (at your option) any later version"],
    "gpl.hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl.implied": ["Without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl.see": ["See the GNU General Public License for more details"],
    "bsd.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd.binary": [
        f"{n}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution" for n in ("", "2. ")
    ],
    "bsd.name": [
        f"{n}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for n in ("", "3. ")
    ],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl.terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ccby.notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccbync.notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "ccbysa.notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0.notice": ["Licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0"],
    "apache.title": ["Apache License", "Apache License Version 2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"],
    "apache.definition": ['"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document'],
    "apache.contribution": [
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
        "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"
    ],
    "terms.end": ["END OF TERMS AND CONDITIONS"],
    "gnu.verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl3.text": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2.text": ["The licenses for most software are designed to take away your freedom to share and change it"],
    "gpl2.intended": ["By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users"],
    "lgpl3.text": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"],
    "lgpl21.text": ["This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it"],
    "lgpl.free": ["This library is free software"],
    "lgpl.terms": ["You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgpl21.later": ["Either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3.later": ["Either version 3 of the License, or (at your option) any later version"],
    "lgpl.hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl.see": ["See the GNU Lesser General Public License for more details"],
    "agpl3.text": [
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"
    ],
    "agpl3.free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "agpl3.terms": [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "agpl.see": ["See the GNU Affero General Public License for more details"],
    "unlicense.free": ["This is free and unencumbered software released into the public domain"],
    "unlicense.anyone": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"
    ],
    "epl2.header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "epl2.text": [
        f'The accompanying program is provided under the terms of this Eclipse Public License ("Agreement"){end}' for end in ("", ". Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement")
    ],
    "bsl.grant": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, '
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ],
    "zlib.as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib.liability": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib.grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "0bsd.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc.warranty": ["The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc.liability": [
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of "
        "contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"
    ],
    "bsd.advertising": [f"{n}All advertising materials mentioning features or use of this software must display the following acknowledgement" for n in ("", "3. ")],
    "bsd.warranty": [
        f"This software is provided by the {who} as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
        for who in ("copyright holders and contributors", "author", "regents and contributors")
    ],
    "mpl.title": ["Mozilla Public License Version 2.0"],
    "mpl.copy": [f"If a copy of the MPL was not distributed with this file, You can obtain one at {at}" for at in ("http://mozilla.org/MPL/2.0/", "https://mozilla.org/MPL/2.0/")],
    "ccby.text": [
        'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License ("Public License")'
    ],
    "ccbysa.text": [
        'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License ("Public License")'
    ],
    "cc0.title": ["CC0 1.0 Universal"],
    "reserved": ["All rights reserved"],
}
#: Licences named alone: their identifier, and how they are called in notices.
NAMED = {
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "3-clause BSD license"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "0BSD": ("Zero-Clause BSD License",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "LGPL-2.1-or-later": (),
    "LGPL-3.0-or-later": (),
    "AGPL-3.0-or-later": (),
    "GPL-2.0-or-later": (),
    "CC-BY-4.0": (),
    "CC-BY-SA-4.0": (),
    "CC-BY-NC-4.0": (),
    "CC0-1.0": (),
}
_SAID = ("Licensed under the {}", "Licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "Released under the {}", "This software is released under the {}", "Distributed under the {}")
SENTENCES |= {f"named.{k}": [f"SPDX-License-Identifier: {k}", *[t.format(n) for n in names for t in _SAID]] for k, names in NAMED.items()}
#: (licence, kind, identifiers in order); kind "long" allows LONG_GAP tokens between them and is told as "text".
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("Apache-2.0", "long", ("apache.title", "apache.definition", "apache.contribution", "terms.end")),
    ("GPL-3.0", "long", ("gnu.verbatim", "gpl3.text", "terms.end")),
    ("GPL-2.0", "long", ("gnu.verbatim", "gpl2.text", "gpl2.intended", "terms.end")),
    ("LGPL-3.0", "long", ("gnu.verbatim", "lgpl3.text")),
    ("LGPL-2.1", "long", ("gnu.verbatim", "gpl2.text", "lgpl21.text", "terms.end")),
    ("AGPL-3.0", "long", ("gnu.verbatim", "agpl3.text", "terms.end")),
    ("MPL-2.0", "header", ("mpl.terms", "mpl.copy")),
    ("MPL-2.0", "partial", ("mpl.title",)),
    ("LGPL-2.1-or-later", "header", ("lgpl.free", "lgpl.terms", "lgpl21.later", "lgpl.hope", "gpl.implied", "lgpl.see")),
    ("LGPL-3.0-or-later", "header", ("lgpl.free", "lgpl.terms", "lgpl3.later", "lgpl.hope", "gpl.implied", "lgpl.see")),
    ("AGPL-3.0-or-later", "header", ("agpl3.free", "gpl.hope", "gpl.implied", "agpl.see")),
    ("AGPL-3.0-or-later", "header", ("gpl.free", "agpl3.terms", "gpl.hope", "gpl.implied", "agpl.see")),
    ("Unlicense", "text", ("unlicense.free", "unlicense.anyone")),
    ("Unlicense", "partial", ("unlicense.free",)),
    ("EPL-2.0", "header", ("epl2.header",)),
    ("EPL-2.0", "partial", ("epl2.text",)),
    ("BSL-1.0", "partial", ("bsl.grant",)),
    ("Zlib", "text", ("zlib.as-is", "zlib.liability", "zlib.grant")),
    ("0BSD", "text", ("0bsd.grant", "isc.warranty", "isc.liability")),
    ("ISC", "text", ("isc.grant", "isc.warranty", "isc.liability")),
    ("BSD-4-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.name")),
    ("BSD-3-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.name", "bsd.warranty")),
    ("BSD-2-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.warranty")),
    ("CC-BY-4.0", "partial", ("ccby.text",)),
    ("CC-BY-SA-4.0", "partial", ("ccbysa.text",)),
    ("CC0-1.0", "partial", ("cc0.title",)),
    *[(k, "notice", (f"named.{k}",)) for k in NAMED],
    ("MIT", "text", ("mit.title", "mit.grant", "mit.condition", "mit.warranty", "mit.liability")),
    ("MIT", "text", ("mit.grant", "mit.condition", "mit.warranty", "mit.liability")),
    ("MIT", "partial", ("mit.grant",)),
    ("MIT", "notice", ("mit.notice",)),
    ("Apache-2.0", "header", ("apache.notice", "apache.use", "apache.copy", "apache.warranty", "apache.see")),
    ("Apache-2.0", "header", ("apache.notice", "apache.use", "apache.warranty", "apache.see")),
    ("Apache-2.0", "notice", ("apache.notice",)),
    ("GPL-3.0-or-later", "header", ("gpl3.free", "gpl.hope", "gpl.implied", "gpl.see")),
    ("GPL-3.0-or-later", "header", ("gpl.free", "gpl3.terms", "gpl.hope", "gpl.implied", "gpl.see")),
    ("GPL-2.0-or-later", "header", ("gpl.free", "gpl2.terms", "gpl2.terms", "gpl.hope", "gpl.implied", "gpl.see")),
    ("GPL-3.0-only", "notice", ("gpl3.notice",)),
    ("GPL-3.0-or-later", "notice", ("gpl3.later",)),
    ("BSD-3-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.name")),
    ("BSD-2-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("ISC", "partial", ("isc.grant",)),
    ("MPL-2.0", "header", ("mpl.terms",)),
    ("CC-BY-4.0", "notice", ("ccby.notice",)),
    ("CC-BY-NC-4.0", "notice", ("ccbync.notice",)),
    ("CC-BY-SA-4.0", "notice", ("ccbysa.notice",)),
    ("CC0-1.0", "notice", ("cc0.notice",)),
    ("all-rights-reserved", "notice", ("reserved",)),
]
FOUND = "doc_id long, licence string, kind string, sentences array<string>, first_token long, last_token long"

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?;:"]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def plain(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """Typographic quotes, dashes, bullets, the copyright sign and such as spaces, byte for byte."""
    data, at = T.raw(texts)
    data = data.copy()
    if len(data) > 2:
        two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0) & (data[1:] <= 0xBF))
        three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        for marks, width in ((two, 2), (three, 3)):
            for i in range(width):
                data[marks + i] = 32
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data))


def sentence_breaks(data: np.ndarray, row_at: np.ndarray, at_lines: bool) -> np.ndarray:
    """For each byte whether a sentence ends after it: a stop before white space or a row's end, and a line feed (a blank line unless at_lines)."""
    n = len(data)
    end = np.zeros(n, bool)
    if not n:
        return end
    white = np.ones(n + 1, bool)
    white[:n] = _WHITE[data]
    white[row_at[1:-1]] = True
    end |= _STOPS[data] & (white[1:] | np.isin(np.arange(1, n + 1), row_at[1:]))
    feed = np.flatnonzero(data == 10)
    if at_lines:
        end[feed] = True
    elif len(feed) > 1:
        blank = np.concatenate([[0], np.cumsum(~_WHITE[data])])
        end[feed[:-1][blank[feed[1:]] == blank[feed[:-1] + 1]]] = True
    return end


class Rules:
    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, str, tuple[str, ...]]] = RULES):
        self.rules = sorted(rules, key=lambda r: -len(r[2]))
        pairs = [(name, s) for name, all_ in sentences.items() for s in all_]
        t = T.tokenize(plain(T.strings(pa.array([s for _, s in pairs], pa.large_string()))))
        keys, _ = T.document_hashes(t, len(pairs))
        number = np.concatenate([[0], np.cumsum(sentence_breaks(t.data, t.row_at, False))])[t.start]
        pieces = 1 + number[t.first[1:] - 1] - number[t.first[:-1]]
        #: (pieces, keys, names): all by their whole tokens, then those that the breaks cut, by how many pieces they fall into.
        self.tables = []
        for count in (1, *sorted(set(pieces.tolist()) - {1})):
            order = np.argsort(keys)
            order = order if count == 1 else order[pieces[order] == count]
            self.tables.append((count, keys[order], [pairs[i][0] for i in order]))

    def sentences(self, texts: pa.LargeStringArray, joined: bool = False) -> list[tuple[int, int, int, str]]:
        """(row, first token, last token, identifier) of the known sentences, in order; joined: also those that stops cut, as 'SPDX-License-Identifier: MIT', from their pieces in a row."""
        t = T.tokenize(plain(texts))
        n = len(t.hash)
        if not n:
            return []
        up, down = T.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(t.hash * up[:n], out=total[1:])
        out = set()
        for at_lines in (True, False):
            number = np.concatenate([[0], np.cumsum(sentence_breaks(t.data, t.row_at, at_lines))])[t.start]
            new = np.ones(n, bool)
            new[1:] = (number[1:] != number[:-1]) | (t.doc[1:] != t.doc[:-1])
            a = np.flatnonzero(new)
            b = np.append(a[1:], n)
            for count, keys, names in self.tables if joined else self.tables[:1]:
                begin, end = a[: len(a) - count + 1], b[count - 1 :]
                key = T.mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * T.GOLDEN)
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                for i in np.flatnonzero((keys[place] == key) & (t.doc[begin] == t.doc[end - 1])):
                    row = int(t.doc[begin[i]])
                    out.add((row, int(begin[i] - t.first[row]), int(end[i] - t.first[row] - 1), names[place[i]]))
        return sorted(out)

    def match(self, found: list[tuple[int, int, str]]) -> list[tuple[str, str, list[str], int, int]]:
        """(licence, kind, identifiers, first token, last token) of one text's sentences (first, last, identifier), in order."""
        free, out = [True] * len(found), []
        places: dict[str, list[int]] = {}
        for i, (_, _, name) in enumerate(found):
            places.setdefault(name, []).append(i)
        for licence, kind, names in self.rules:
            if any(n not in places for n in names):
                continue
            gap = LONG_GAP if kind == "long" else GAP
            dead: set[tuple[int, int]] = set()

            def rest(i: int, k: int) -> list[int] | None:
                """The first places of names[k:] behind sentence i, if there are any."""
                if k == len(names):
                    return []
                if (i, k) in dead:
                    return None
                mine = places[names[k]]
                for j in mine[bisect_right(mine, i) :]:
                    if found[j][0] - found[i][1] - 1 > gap:
                        break
                    if free[j] and found[j][0] > found[i][1] and (more := rest(j, k + 1)) is not None:
                        return [j, *more]
                dead.add((i, k))
                return None

            for start in places[names[0]]:
                if free[start] and (more := rest(start, 1)) is not None:
                    for i in (start, *more):
                        free[i] = False
                    last = (more or [start])[-1]
                    out.append((licence, "text" if kind == "long" else kind, list(names), found[start][0], found[last][1]))
        return sorted(out, key=lambda m: (m[3], m[4], m[0]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row for each rule matched in a document: licence, kind, its sentences and where they begin and end, in tokens.

    Sentences end at . ! ? ; or : before white space or the text's end, and at blank lines; lines count as
    sentences too, as notices often lack a stop. A licence that a text holds twice is reported twice;
    repeated rows are each reported. Null and empty texts hold none. A null doc_id is reported as such.
    Empty tables give an empty result. Other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules()
        for batch in batches:
            texts, rows = T.strings(batch.column(1)), []
            ids = batch.column(0).to_pylist()
            for lo, hi in T.spans(texts):
                by_row: dict[int, list] = {}
                for row, first, last, name in rules.sentences(texts.slice(lo, hi - lo), joined=True):
                    by_row.setdefault(row, []).append((first, last, name))
                rows += [(ids[lo + row], *m) for row, found in by_row.items() for m in rules.match(found)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "licence", "kind", "sentences", "first_token", "last_token"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.lean(run), FOUND)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licences found in the documents."""
    return scan_licences(read_table(spark, sf_dir, "documents"))
