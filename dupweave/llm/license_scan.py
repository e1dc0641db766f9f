"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units of a text are its lines, its paragraphs of several lines (between blank lines), the whole of it, and for each
template windows over the text's words: of the template's w words and STEPS-th part more, at every w / STEPS-th word, so
that a licence is met wherever it stands, within a line or over several paragraphs. A unit is normalised (ASCII letters
and digits, lower case, single spaces) and is the set of its word bigrams. With a and b bigrams a unit and a template
can reach a Dice coefficient t only if t / (2 - t) <= a / b <= (2 - t) / t, which prunes units by all templates' sizes
and templates by the unit's. A text must share t / (2 - t) of a template's bigrams before windows are laid, and only
windows with a shared bigram count. Before bigrams are made, a text and then a unit must have an anchor word: anchors are
chosen from the templates so that the bigrams without one are too few to reach t, so no match is lost. Everything is SQL
functions on arrays within a row: one narrow pass, no shuffle and no Python.

Defined results: null and empty texts and units of one word have no licence; equal scores go to the first
template by name; a licence found in several units counts once, with its best score; repeated rows each
get a row; an empty table gives an empty result; input columns named `licenses` are replaced.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ref

DICE = 0.75
STEPS = 16
#: Words that tell little; anchors are others where that is possible.
COMMON = set("a all an and any are as at be by can file for free from if in including is it may more no not of on one or other part particular provided subject that the this to under use version will with without work you".split())

#: Notices and texts of public licences.
TEMPLATES = {
    "0bsd": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "agpl-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    "agpl-3.0-notice": "This program is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-2-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-style-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-header": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "isc-notice": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "lgpl-3.0-header": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "lgpl-3.0-notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "proprietary-notice": "All rights reserved. No part of this work may be reproduced without written permission.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def bigram_list(text: str) -> list[str]:
    words = re.sub("[^A-Za-z0-9]+", " ", text).strip(" ").lower().split(" ")
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bigrams_of(text: str) -> list[str]:
    return sorted(set(bigram_list(text)))


def size_bounds(size: int, dice: float) -> tuple[float, float]:
    """Sizes that can reach `dice` with a set of `size`."""
    return size * dice / (2 - dice), size * (2 - dice) / dice


def anchor_words(sets: dict[str, list[str]], dice: float) -> list[str]:
    """Words, rare in English and frequent in the templates first, so that of each template fewer bigrams lack one than a match shares.

    A match of a set of `size` shares at least size * dice / (2 - dice) bigrams with it.
    """
    chosen: list[str] = []
    while True:
        bare = {n: [b for b in own if not set(b.split()) & set(chosen)] for n, own in sets.items()}
        open_ = [b for n, own in sets.items() if len(bare[n]) >= size_bounds(len(own), dice)[0] for b in bare[n]]
        if not open_:
            return sorted(chosen)
        words = sorted({w for b in open_ for w in b.split()})
        chosen.append(max(words, key=lambda w: (w not in COMMON, sum(w in b.split() for b in open_) * len(w) ** 2)))


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def _units(text: Column) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[\t\r ]*\n\s*"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    return F.concat(lines, F.when(F.contains(text, F.lit("\n")), F.concat(paragraphs, F.array(text))).otherwise(F.array().cast("array<string>")))


def window_words(text: str) -> tuple[int, int]:
    """(words of a window, words between windows) for a template."""
    words = len(bigram_list(text)) + 1
    step = max(1, words // STEPS)
    return words + step - 1, step


def _listed(pairs: list[str]) -> str:
    """Bigrams (letters, digits and a space) as a list in SQL: one string, as a call for each of them takes seconds."""
    return ", ".join(f"'{b}'" for b in pairs)


def _window_score(pairs: str, known: str, own: list[str], dice: float, length: int, step: int) -> Column:
    """The best Dice coefficient of a template's windows; null without one that shares a bigram.

    `pairs`: the column of the text's bigrams in order; `known`: that of (at, pair) of those that any template has.
    """
    least = size_bounds(len(own), dice)[0]
    different = lambda found: F.size(F.array_distinct(F.transform(found, lambda k: k["pair"])))
    # Windows begin at multiples of `step`; the bigram at p is in those that begin from p - length + 2 to p.
    of = lambda k: F.sequence(F.greatest(F.ceil((k["at"] - (length - 2)) / step), F.lit(0)).cast("int"), F.floor(k["at"] / step).cast("int"))

    def best(shared: Column) -> Column:
        def score(start: Column) -> Column:
            size = F.size(F.array_distinct(F.slice(F.col(pairs), start * step + 1, length - 1)))
            inside = F.filter(shared, lambda k: (k["at"] >= start * step) & (k["at"] < start * step + (length - 1)))
            return different(inside) * 2 / (size + len(own))

        starts = F.array_distinct(F.flatten(F.transform(shared, of)))
        return F.when(different(shared) >= least, F.array_max(F.transform(starts, score)))

    shared = F.expr(f"filter({known}, k -> k.pair IN ({_listed(own)}))")
    return F.get(F.transform(F.array(shared), best), F.lit(0))


def _unit_score(units: str, own: list[str], dice: float) -> Column:
    """The best Dice coefficient of the units whose size can reach `dice` with a template's bigrams; null without any."""
    least, most = size_bounds(len(own), dice)
    return F.expr(f"array_max(transform(filter({units}, u -> u.n >= {least}D AND u.n <= {most}D), u -> size(filter(u.known, b -> b IN ({_listed(own)}))) * 2 / (u.n + {len(own)})))")


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, dice: float = DICE, text_col: str = "text") -> DataFrame:
    """`docs` with `licenses`: array of (name, dice), by name, of the templates that some unit reaches."""
    sets = {name: bigrams_of(text) for name, text in sorted(templates.items())}
    known = sorted(set(reduce(lambda a, b: a + b, sets.values(), [])))
    low = min(size_bounds(len(s), dice)[0] for s in sets.values())
    high = max(size_bounds(len(s), dice)[1] for s in sets.values())
    smallest = min(len(s) for s in sets.values())

    anchors = F.array(*map(F.lit, anchor_words(sets, dice)))

    text = F.coalesce(ref(text_col), F.lit(""))
    p = fresh(docs, "scan")
    bigrams = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    units = F.transform(F.filter(_units(text), lambda u: F.length(u) >= 2 * int(low) + 1), _plain)
    words = F.filter(F.transform(units, lambda u: F.split(u, " ")), lambda w: (F.size(w) - 1 >= low) & F.arrays_overlap(w, anchors))
    pairs = F.transform(words, lambda w: F.array_distinct(bigrams(w)))
    stream = F.split(_plain(text), " ")
    anchored = F.arrays_overlap(stream, anchors) & (F.size(stream) > 1)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = docs.withColumn(f"{p}pairs", F.when(anchored, bigrams(stream)).otherwise(none("string")))
    rows = rows.withColumn(f"{p}units", F.when(F.size(f"{p}pairs") > 0, F.filter(pairs, lambda p: (F.size(p) >= low) & (F.size(p) <= high))).otherwise(none("array<string>")))
    # Bigrams that no template has can't be shared: keep the unit's size and its known bigrams only.
    shared = F.expr(f"transform({p}units, u -> struct(size(u) AS n, filter(u, b -> b IN ({_listed(known)})) AS known))")
    rows = rows.withColumn(f"{p}likely", F.filter(shared, lambda u: F.size(u["known"]) * 2 >= F.lit(dice) * (u["n"] + smallest)))
    rows = rows.withColumn(f"{p}known", F.expr(f"filter(transform({p}pairs, (b, i) -> struct(i AS at, b AS pair)), k -> k.pair IN ({_listed(known)}))"))

    def score(name: str, own: list[str]) -> Column:
        return F.greatest(_unit_score(f"{p}likely", own, dice), _window_score(f"{p}pairs", f"{p}known", own, dice, *window_words(templates[name])))

    found = F.array(*[F.struct(F.lit(name).alias("name"), score(name, own).alias("dice")) for name, own in sets.items()])
    hits = F.when(F.size(f"{p}known") >= low, F.filter(found, lambda x: x["dice"] >= dice)).otherwise(none("struct<name:string,dice:double>"))
    return rows.select(*[ref(c) for c in docs.columns if c.lower() != "licenses"], hits.alias("licenses"))


def license_digest(docs: DataFrame, **options) -> DataFrame:
    """The query's columns: number of licences, their names, the best score and its licence."""
    hits = F.col("hits")
    found = scan_licenses(docs.select(ref("doc_id"), ref("text")), **options).select("doc_id", F.col("licenses").alias("hits"))
    best = F.array_max(F.transform(hits, lambda x: x["dice"]))
    first = F.get(F.filter(hits, lambda x: x["dice"] == best), F.lit(0))["name"]
    names = F.array_join(F.transform(hits, lambda x: x["name"]), ",")
    return found.select("doc_id", F.size(hits).cast("long").alias("n_licenses"), names.alias("licenses"), first.alias("best_license"), best.alias("best_dice"))


def license_sql(templates: dict[str, str] = TEMPLATES, dice: float = DICE, rows: str = "documents") -> str:
    """DuckDB SQL for the query: every unit, windows at every step of the text too, against every template.

    Windows are only laid over texts that share enough bigrams with the template at all; without that it would take hours.
    """
    listed = ", ".join(f"('{n}', {bigrams_of(t)!r}::VARCHAR[], {window_words(t)[0]}, {window_words(t)[1]})" for n, t in sorted(templates.items()))
    return f"""
WITH templates(name, own, long, step) AS (VALUES {listed}),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {rows}),
units AS (
  SELECT r, unnest(string_split(text, chr(10))) AS u FROM texts
  UNION ALL SELECT r, p FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[\\t\\r ]*\\n\\s*')) AS p FROM texts) WHERE contains(trim(p), chr(10))
  UNION ALL SELECT r, text FROM texts WHERE contains(text, chr(10))),
worded AS (SELECT r, string_split(lower(trim(regexp_replace(u, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM units),
paired AS (SELECT r, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS p FROM worded WHERE len(w) > 1),
stream AS (SELECT r, string_split(lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM texts),
ordered AS (SELECT r, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS p FROM stream WHERE len(w) > 1),
laid AS (SELECT r, name, own, p, long, step, unnest(range((len(p) - 1) // step + 1)) AS k FROM ordered, templates WHERE len(list_intersect(p, own)) >= {dice / (2 - dice)} * len(own)),
windows AS (SELECT r, name, own, list_distinct(p[k * step + 1 : k * step + long - 1]) AS p FROM laid),
scored AS (
  SELECT r, name, 2 * len(list_intersect(p, own)) / (len(p) + len(own)) AS dice FROM paired, templates
  UNION ALL SELECT r, name, 2 * len(list_intersect(p, own)) / (len(p) + len(own)) FROM windows),
hits AS (SELECT r, name, max(dice) AS dice FROM scored GROUP BY r, name HAVING max(dice) >= {dice})
SELECT doc_id, count(name)::BIGINT AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses,
  first(name ORDER BY dice DESC, name) AS best_license, max(dice) AS best_dice
FROM texts LEFT JOIN hits USING (r) GROUP BY r, doc_id"""
