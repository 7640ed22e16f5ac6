"""Licence scan: windows of words against licence texts by Dice coefficient over word bigrams, in DataFrame functions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

_AS_IS = "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_FIRST = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_LAST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = f'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'


def _gnu(name: str, version: str) -> str:
    """The notice that the GNU licences ask to be put into source files."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."
    )


_ADDRESS = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."


def _gnu2(name: str, version: str, thing: str) -> str:
    """The same notice as it was worded for the second versions."""
    return (
        f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
        f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this {thing}; if not, {_ADDRESS}"
    )


#: Templates by licence: short forms, opening sentences, whole texts of licences of up to a page, and the notices by
#: which files name the longer ones.
NOTICES: dict[str, tuple[str, ...]] = {
    "0BSD": (f"{_ISC_GRANT}. {_ISC_REST}",),
    "AGPL-3.0": (_gnu("GNU Affero General Public License", "3"),),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (f"{_BSD_GRANT} {_BSD_FIRST} {_BSD_LAST}",),
    "BSD-3-Clause": ("Released under the 3-Clause BSD License.", _BSD_GRANT, f"{_BSD_GRANT} {_BSD_FIRST} {_BSD_THIRD} {_BSD_LAST}"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        _gnu("GNU General Public License", "2"),
        _gnu2("GNU General Public License", "2", "program"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _gnu("GNU General Public License", "3"),
    ),
    "ISC": (_ISC_GRANT + _ISC_NOTICE, f"{_ISC_GRANT}{_ISC_NOTICE} {_ISC_REST}"),
    "LGPL-2.1": (_gnu("GNU Lesser General Public License", "2.1"), _gnu2("GNU Lesser General Public License", "2.1", "library")),
    "LGPL-3.0": (_gnu("GNU Lesser General Public License", "3"),),
    "MIT": ("Released under the MIT License.", _MIT_GRANT, f"{_MIT_GRANT} {_MIT_REST}"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}
#: Words that say least about a text: they come last when the words of a template are chosen that a match must have.
COMMON = frozenset("a an and any are as at be by copy file for free from in is it its may not of on one or other see software that the this to use used version will with without work you your".split())


class Template(NamedTuple):
    name: str
    length: int  # in words
    pairs: list[str]  # distinct bigrams
    need: int  # so many of them a matching window has at least
    words: list[str]  # of these it has one at least


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def templates(notices: Mapping[str, tuple[str, ...]], least: float = 0.8) -> list[Template]:
    """A window with n distinct bigrams that shares x of a template's m has 2 x / (n + m) >= least, and n >= x, so
    x >= least m / (2 - least). Words are chosen until fewer bigrams than that have none of them."""
    out = []
    for name in sorted(notices):
        for notice in notices[name]:
            words = words_of(notice)
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
            need = max(1, ceil(least * len(pairs) / (2 - least) - 1e-9))
            left, chosen = set(pairs), []
            for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
                if len(left) < need:
                    break
                chosen.append(w)
                left = {p for p in left if w not in p.split()}
            if pairs:
                out.append(Template(name, len(words), pairs, need, chosen))
    return out


def scan(df: DataFrame, notices: Mapping[str, tuple[str, ...]] = NOTICES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_matches (templates), licenses (names in order, joined by commas), best_dice.

    Text and templates are words of a-z and 0-9 in lower case, whatever stands between them, so a notice matches in
    one line, wrapped over lines, or amid other text. A template of L words is compared with each window of L words
    (fewer at the end of a text) that starts at one of its bigrams, and matches if twice the number of distinct
    bigrams they share, over the sum of what each has, is at least `least`. Where the best windows of two licences overlap, only
    the one that shares more bigrams counts (of ties the one with the higher coefficient), so versions that differ in a
    word don't match each other, nor a licence one that begins like it. Size bounds come first and lose nothing:
    a text has one of the words that a match needs; it shares enough bigrams with the template; so does the window.

    Each row is scanned by itself, without a shuffle: rows that repeat an id or have none each get their own result.
    Null and empty texts and texts of one word match nothing (best_dice null). A text of any length is scanned whole.
    An empty table gives an empty result; extra columns are ignored."""
    known = templates(notices, least)
    array = lambda values: F.array(*map(F.lit, values))
    all_words = array(sorted({w for t in known for w in t.words}))
    all_pairs = array(sorted({p for t in known for p in t.pairs}))
    each = F.array(*(F.struct(F.lit(t.name).alias("name"), F.lit(t.length).alias("length"), F.lit(len(t.pairs)).alias("m"), F.lit(t.need).alias("need"), array(t.pairs).alias("theirs")) for t in known))
    words = F.split(F.lower(text_of(text_col)), "[^a-z0-9]+")
    own = F.array_remove("words", "")
    pairs = F.zip_with("own", F.slice("own", 2, F.greatest(F.size("own"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))

    def best_of(t: Column) -> Column:
        """(Dice coefficient, minus the first pair, bigrams shared) of the template's best window, the first of these; null if none shares enough bigrams."""

        def of(at: Column) -> Column:
            # bigrams of the template stand at these places, in order, so a window has enough if the need-th is inside
            starts = F.filter(at, lambda i, k: F.coalesce(F.get(at, k + t["need"] - 1) < i + t["length"] - 1, F.lit(False)))
            counted = F.transform(starts, lambda i: F.transform(F.array(F.array_distinct(F.slice("pairs", i + 1, t["length"] - 1))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_intersect(w, t["theirs"])).alias("shared"), (-i).alias("back"))))
            dice = lambda x: 2.0 * x["shared"] / (x["n"] + t["m"])
            return F.array_max(F.transform(F.flatten(counted), lambda x: F.struct(dice(x).alias("dice"), x["back"].alias("back"), x["shared"].alias("shared"))))

        at = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains(t["theirs"], p), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(at), of), 0)

    rows = df.select(F.col(id_col).alias("_id"), words.alias("words"))
    rows = rows.select("_id", F.when(F.arrays_overlap("words", all_words), own).alias("own"))
    rows = rows.select("_id", F.when(F.size("own") > 1, F.slice(pairs, 1, F.size("own") - 1)).alias("pairs"))
    rows = rows.select("_id", "pairs", F.array_intersect("pairs", all_pairs).alias("hits"))
    likely = F.when(F.size("hits") > 0, F.filter(each, lambda t: F.size(F.array_intersect("hits", t["theirs"])) >= t["need"]))
    rows = rows.select("_id", "pairs", likely.alias("likely"))
    scored = F.transform("likely", lambda t: F.struct(t["name"].alias("name"), t["length"].alias("length"), best_of(t).alias("best")))
    scored = F.transform(scored, lambda x: F.struct(x["name"].alias("name"), x["best"]["dice"].alias("dice"), x["best"]["shared"].alias("shared"), (-x["best"]["back"]).alias("first"), (x["length"] - x["best"]["back"] - 1).alias("end")))
    rows = rows.select("_id", F.when(F.size("likely") > 0, F.filter(scored, lambda x: x["dice"] >= least - 1e-9)).alias("every"))
    better = lambda x, y: (y["name"] != x["name"]) & ((y["shared"] > x["shared"]) | (y["shared"] == x["shared"]) & (y["dice"] > x["dice"] + 1e-12)) & (y["first"] < x["end"]) & (x["first"] < y["end"])
    rows = rows.select("_id", F.filter("every", lambda x: ~F.exists("every", lambda y: better(x, y))).alias("found"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"]))), ",")
    return rows.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.when(F.col("found").isNotNull(), F.size("found")), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(names, F.lit("")).alias("licenses"),
        F.round(F.array_max(F.transform("found", lambda x: x["dice"])), 6).alias("best_dice"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in each of the documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(least: float = 0.8) -> str:
    known = templates(NOTICES, least)
    pairs = ",\n  ".join(f"({k}, '{p}')" for k, t in enumerate(known) for p in t.pairs)
    sizes = ", ".join(f"({k}, '{t.name}', {t.length}, {len(t.pairs)}, {t.need})" for k, t in enumerate(known))
    return f"""
WITH t(k, pair) AS (VALUES
  {pairs}
), size(k, name, l, m, need) AS (VALUES {sizes}
), u AS (
  SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT uid, i AS pos, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT uid, w, unnest(range(1, len(w))) AS i FROM u WHERE len(w) > 1)
), h AS (
  SELECT p.uid, t.k, p.pos, p.pair FROM p JOIN t ON p.pair = t.pair
), g AS (
  SELECT h.uid, h.k FROM h JOIN size ON size.k = h.k GROUP BY h.uid, h.k, size.need HAVING count(DISTINCT h.pair) >= size.need
), s AS (
  SELECT h.uid, h.k, h.pos FROM h JOIN g ON g.uid = h.uid AND g.k = h.k
), x AS (
  SELECT s.uid, s.k, s.pos, size.l, size.m, size.name, count(DISTINCT h.pair) AS x
  FROM s JOIN size ON size.k = s.k JOIN h ON h.uid = s.uid AND h.k = s.k AND h.pos BETWEEN s.pos AND s.pos + size.l - 2
  GROUP BY s.uid, s.k, s.pos, size.l, size.m, size.name, size.need HAVING count(DISTINCT h.pair) >= size.need
), d AS (
  SELECT x.uid, x.k, x.name, x.l, x.pos, x.x, 2.0 * x.x / (count(DISTINCT p.pair) + x.m) AS dice
  FROM x JOIN p ON p.uid = x.uid AND p.pos BETWEEN x.pos AND x.pos + x.l - 2
  GROUP BY x.uid, x.k, x.name, x.l, x.pos, x.x, x.m
), e AS (
  SELECT uid, k, name, l, max(dice) AS dice, min(pos) FILTER (WHERE top) AS pos, arg_min(x, pos) FILTER (WHERE top) AS x FROM (SELECT *, dice = max(dice) OVER (PARTITION BY uid, k) AS top FROM d) GROUP BY uid, k, name, l HAVING max(dice) >= {least} - 1e-9
), b AS (
  SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.uid = e.uid AND o.name <> e.name AND (o.x > e.x OR o.x = e.x AND o.dice > e.dice + 1e-12) AND o.pos < e.pos + e.l - 1 AND e.pos < o.pos + o.l - 1)
), f AS (SELECT uid, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, round(max(dice), 6) AS best_dice FROM b GROUP BY uid)
SELECT u.doc_id, coalesce(f.n_matches, 0) AS n_matches, coalesce(f.licenses, '') AS licenses, f.best_dice
FROM u LEFT JOIN f ON f.uid = u.uid
"""


ORACLE_LICENSES = _sql()
