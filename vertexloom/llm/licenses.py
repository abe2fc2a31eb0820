"""Licence scans by the Dice coefficient over word bigrams, in SQL functions only.

A text is normalised to its lower-case words, across line breaks. For each licence template,
windows of as many words as the template has, beginning at each of its bigrams that the text
holds, are compared with it: Dice = 2 |A and B| / (|A| + |B|) over the sets of word bigrams. So
a notice is found on a line of its own, wrapped over lines, or inside of a longer paragraph.

Sizes prune nearly everything before a set is built: a window of the template's length can only
reach a threshold t with t / (2 - t) of the template's bigrams, so a text that holds fewer of
them is left at once, and so is a window that doesn't hold as many. All work stays in a text's
row; most texts hold next to none of the templates' bigrams.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read
from .urls import LOWER, UPPER

THRESHOLD = 0.8
# fixed values: the wording of public licences
_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
or altered from any source distribution."""
_UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GNU = """
This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version
{2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details."""
#: (licence, notice), whole texts first; several may name one licence. ``BSD`` is the sentence that all of its licences begin with.
TEMPLATES = (
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE),
    ("GPL-2.0", _GNU.format("program", "GNU General Public License", "2")),
    ("GPL-3.0", _GNU.format("program", "GNU General Public License", "3")),
    ("LGPL-2.1", _GNU.format("library", "GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "GNU Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("program", "GNU Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _words(notice: str) -> list[str]:
    return re.findall(r"[^\W_]+", notice.translate(str.maketrans(UPPER, LOWER)))


def template_bigrams(notice: str) -> list[str]:
    w = _words(notice)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


_NONE = "cast(array() AS array<struct<score: double, rank: int, place: int>>)"


def _once(value: str, name: str, use: str) -> str:
    """``use`` with ``value`` computed a single time, as the lambda variable ``name``."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _holds(places: str, grams: list[str]) -> str:
    """Those of the places at which one of the bigrams begins, by 64-bit hashes."""
    known = ", ".join("xxhash64('{}', '{}')".format(*g.split(" ")) for g in grams)
    return f"filter({places}, i -> xxhash64(get(w, i), get(w, i + 1)) IN ({known}))"


def _of_template(k: int, notice: str, threshold: float) -> str:
    """The windows of words ``w`` that reach one template; ``p`` are the places of any template's bigrams."""
    grams, size = template_bigrams(notice), len(_words(notice))
    need = max(1, ceil(len(grams) * threshold / (2 - threshold) - 1e-9))
    known = ", ".join(f"'{g}'" for g in grams)
    # the set of bigrams of the template's number of words, or as many as there are
    window = f"array_distinct(transform(sequence(i, least(i + {size - 2}, size(w) - 2)), j -> concat_ws(' ', get(w, j), get(w, j + 1))))"
    score = f"cast(size(array_intersect(a, array({known}))) AS double) * 2 / cast(size(a) + {len(grams)} AS double)"
    judged = _once(window, "a", f"named_struct('score', {score}, 'rank', {-k}, 'place', -i)")
    # a window's first and its need-th bigram of the template, by place, lie within it
    full = f"filter(m, (x, j) -> coalesce(get(m, j + {need - 1}) - x <= {size - 2}, false))"
    found = _once(_holds("p", grams), "m", f"transform({full}, i -> {judged})")
    return f"if(size(p) >= {need}, filter({found}, x -> x.score >= {threshold}D), {_NONE})"


def matches(text: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """(score, rank, place) of every window of a column that reaches a template; ranks and places fall.

    It is written as one SQL text: put together call by call, so many bigrams take the driver
    half a minute.
    """
    words = rf"coalesce(array_remove(split(translate(`{text}`, '{UPPER}', '{LOWER}'), r'[^\p{{L}}\p{{N}}]+'), ''), cast(array() AS array<string>))"
    starts = "if(size(w) >= 2, sequence(0, size(w) - 2), cast(array() AS array<int>))"
    union = sorted({g for _, notice in templates for g in template_bigrams(notice)})
    each = ", ".join(_of_template(k, notice, threshold) for k, (_, notice) in enumerate(templates))
    return F.expr(_once(words, "w", _once(_holds(starts, union), "p", f"if(size(p) > 0, flatten(array({each})), {_NONE})")))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, license, score, word, licenses.

    ``license`` is that of the best window (ties: the earlier template, then the earlier window),
    ``word`` the place of its first word in the text, from 0 on; ``licenses`` lists every licence
    found, sorted and comma-joined. Nothing found, as in null and empty texts: null, null, -1
    and an empty string. Texts of any length are read whole; repeated rows each get a row; an
    empty table gives an empty table. Only the named columns are read, so other columns may have
    any name.
    """
    names = F.array(*[F.lit(name) for name, _ in templates])
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select("id", matches("t", templates, threshold).alias("m")).select("id", "m", F.array_max("m").alias("best"))
    name = lambda rank: F.get(names, -rank)
    return found.select(
        F.col("id").alias(id_col), name(F.col("best.rank")).alias("license"), F.col("best.score").alias("score"),
        F.coalesce(-F.col("best.place"), F.lit(-1)).cast("long").alias("word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: name(x["rank"])))), ",").alias("licenses"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {quote(name)}, {len(_words(notice))}, [{', '.join(map(quote, template_bigrams(notice)))}])" for i, (name, notice) in enumerate(TEMPLATES))
    return f"""
WITH t(k, name, size, grams) AS (VALUES {rows}),
tg AS (SELECT k, name, size, len(grams) AS n, unnest(grams) AS gram FROM t),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
h AS (SELECT doc_id, k, name, size, n, i, gram FROM g JOIN tg USING (gram)),
s AS (SELECT a.doc_id, a.k, a.name, a.size, a.n, a.i, count(DISTINCT b.gram) AS both_have FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i BETWEEN a.i AND a.i + a.size - 2
      GROUP BY ALL HAVING count(DISTINCT b.gram) * (2 - {THRESHOLD}) >= {THRESHOLD} * a.n - 1e-9),
x AS (SELECT s.doc_id, s.k, s.name, s.i, CAST(both_have AS DOUBLE) * 2 / CAST(count(DISTINCT g.gram) + s.n AS DOUBLE) AS score
      FROM s JOIN g ON g.doc_id = s.doc_id AND g.i BETWEEN s.i AND s.i + s.size - 2 GROUP BY s.doc_id, s.k, s.name, s.i, s.n, both_have),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k, i) AS r FROM x WHERE score >= {THRESHOLD}),
a AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses FROM m GROUP BY doc_id)
SELECT d.doc_id, m.name AS license, m.score, CAST(coalesce(m.i - 1, -1) AS BIGINT) AS word, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND m.r = 1 LEFT JOIN a ON a.doc_id = d.doc_id"""


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES = {"op10_license_scan": _sql()}
