"""License scans by patience alignment.

A window of a document is aligned with a license template: the words that occur once in both are anchors, their
longest increasing subsequence is kept, and the gaps between kept anchors are aligned in the same way, where
more words have become unique. Equal words at the ends of a gap are matched too. The share of template words
that are matched is the coverage; a license is found where it reaches ``COVERAGE``.

Windows are half as long again as the template and step by half of it, so every copy lies whole in one. A
window is aligned only if enough of its words are template words at all, which loses none, since a word that the
template lacks matches nothing. Counting those is a few numpy calls per task and template; the alignment itself
runs on the few windows that remain.

Defined results: a null or empty text has no license (null, coverage 0); a template without words is never
found; equal coverages go to the longer template, then to the match over the shortest stretch (so that a stray
number does not turn one version into another), then to the first name; a license that occurs several times is
reported at its first best place; a text with several licenses has them all in ``licenses``, but a match is left
out if a better one holds ``COVERAGE`` of its matched words (a notice of one version also resembles the others);
repeated rows are judged one by one; other columns pass through, results replace clashing names.
"""
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filingsift.llm import words as W

COVERAGE = 0.8

#: Fixed: notices that authors put into their works, and the permission texts they stand for.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more "
    "details.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This "
    "software is provided by the copyright holders and contributors \"AS IS\" and any express or implied warranties, including, "
    "but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no "
    "event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or "
    "consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or "
    "profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or "
    "tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the "
    "possibility of such damage.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. This software is provided by the copyright holders and "
    "contributors \"AS IS\" and any express or implied warranties, including, but not limited to, the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors "
    "be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
    "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on "
    "any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any "
    "way out of the use of this software, even if advised of the possibility of such damage.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-header": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-nd-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
    "International License.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-sa-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
    "International License.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nd-4.0-header": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-header": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
    "this work.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
    "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more "
    "details.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more "
    "details.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.",
}


def increasing(values):
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[pile], piles[pile] = value, i
        before[i] = piles[pile - 1] if pile else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a, b):
    """Matched (position in a, position in b) pairs of two word sequences, ascending in both."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        left, right, low, high = gaps.pop()
        while left < right and low < high and a[left] == b[low]:
            pairs.append((left, low))
            left, low = left + 1, low + 1
        while left < right and low < high and a[right - 1] == b[high - 1]:
            right, high = right - 1, high - 1
            pairs.append((right, high))
        if left == right or low == high:
            continue
        here, there = {}, {}
        for i in range(left, right):
            here[a[i]] = -1 if a[i] in here else i
        for j in range(low, high):
            there[b[j]] = -1 if b[j] in there else j
        both = [(i, there[word]) for word, i in here.items() if i >= 0 and there.get(word, -1) >= 0]
        both.sort()
        kept = [both[k] for k in increasing([j for _, j in both])]
        for i, j in kept:
            pairs.append((i, j))
            gaps.append((left, i, low, j))
            left, low = i + 1, j + 1
        if kept:
            gaps.append((left, right, low, high))
    return sorted(pairs)


def tight(a, pairs):
    """The same matched words of ``a``, in places as close together as its repeated words allow."""
    at = [i for i, _ in pairs]
    words = [a[i] for i in at]
    for k in range(1, len(at)):
        at[k] = a.index(words[k], at[k - 1] + 1)
    for k in range(len(at) - 2, -1, -1):
        at[k] = next(i for i in range(at[k + 1] - 1, -1, -1) if a[i] == words[k])
    return at


def template_words(text):
    data, offsets = W.text_buffer(pa.array([text], pa.large_string()))
    return W.split_words(data, offsets, W.ALNUM_LOWER)[2]


def windows(size, length):
    """(first, last + 1) word ranges of a text of ``size`` words for a template of ``length`` words."""
    step, wide = max(1, length // 2), length + (length + 1) // 2
    return [(at, min(size, at + wide)) for at in range(0, max(1, size - wide + step), step)] if size else []


def _matches(hashes, first, templates, coverage):
    """For each text its matches: (coverage, template length, template number, places of the matched words)."""
    found = [[] for _ in first[1:]]
    for number, words in enumerate(templates):
        length = len(words)
        if not length:
            continue
        need = int(np.ceil(coverage * length - 1e-9))
        vocabulary = np.unique(words)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = np.concatenate([[0], np.cumsum(vocabulary[at] == hashes)])
        step, wide = max(1, length // 2), length + (length + 1) // 2
        size = np.diff(first)
        many = np.where(size > 0, np.maximum(1, -(-(size - wide + step) // step)), 0)
        own = np.repeat(np.arange(len(size)), many)
        begin = first[:-1][own] + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * step
        end = np.minimum(first[1:][own], begin + wide)
        good = np.flatnonzero(known[end] - known[begin] >= need)
        b = words.tolist()
        for i in good.tolist():
            t, left, right = own[i], begin[i], end[i]
            a = hashes[left:right].tolist()
            pairs = align(a, b)
            if len(pairs) >= need:
                found[t].append((len(pairs) / length, length, number, [int(left - first[t]) + i for i in tight(a, pairs)]))
    return found


def _licenses(matches):
    """The best match of each template, best first, without those whose words a better match of another explains."""
    matches.sort(key=lambda m: (-m[0], -m[1], m[3][-1] - m[3][0], m[2], m[3][0]))
    best, claims = {}, {}
    for rank, (share, length, number, places) in enumerate(matches):
        shared = Counter(c for i in places for c in claims.get(i, ()))
        if any(n >= COVERAGE * len(places) - 1e-9 for n in shared.values()):
            continue
        best.setdefault(number, (share, number, places[0], places[-1]))
        for i in places:
            claims.setdefault(i, []).append(rank)
    return list(best.values())


def scan(documents: DataFrame, templates=None, text="text", coverage=COVERAGE) -> DataFrame:
    """Adds license (null if none), coverage, first_word and last_word of the best match (null if none), and licenses,
    an array of these four for every template found, best first."""
    templates = dict(sorted((templates or TEMPLATES).items()))
    names = list(templates)
    coded = [template_words(templates[name]) for name in names]
    results = ("license", "coverage", "first_word", "last_word", "licenses")
    entry = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    kept = [c for c in documents.columns if c not in results]
    where = kept.index(text)

    def run(batches):
        for whole in batches:
            for batch in W.pieces(whole, kept[where]):
                data, offsets = W.text_buffer(batch.column(where))
                _, _, hashes, first = W.split_words(data, offsets, W.ALNUM_LOWER)
                found = [[dict(zip(results, (names[number], share, *place)))
                          for share, number, *place in _licenses(m)] for m in _matches(hashes, first, coded, coverage)]
                best = [x[0] if x else {"coverage": 0.0} for x in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x.get(f.name) for x in best], f.type) for f in entry],
                                                  pa.array(found, pa.list_(entry))], [*kept, *results])

    rows = documents.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = "license string, coverage double, first_word long, last_word long"
    return rows.mapInArrow(run, f"{fields}, {found}, licenses array<struct<{found}>>")


def op1_license_scan(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(documents).select("doc_id", "license", "coverage", "first_word", "last_word", "licenses")
