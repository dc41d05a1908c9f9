"""Licence scan: parts of a text against licence templates by the Dice coefficient over word bigrams.

Text is normalised to lower-case runs of [a-z0-9]; line breaks are like spaces. Parts are the whole text, each line, each
sentence of a line, and for each template all windows of as many words as it has, so a notice is found wherever it stands
and however it is wrapped. A part with the set A of bigrams matches a template with the set B if 2 |A & B| / (|A| + |B|)
reaches the threshold t; it can only do so if t / (2 - t) <= |A| / |B| <= (2 - t) / t, and parts are not compared to
templates out of those bounds. As a match shares at least ceil(t |B| / (2 - t)) bigrams of B, a text is cut into parts only
if it holds a word without which no template can have that many, and its windows are looked at only for templates of which
it holds that many bigrams anywhere. The distinct bigrams of all windows of a text are counted in one pass: an occurrence is
new to the windows that begin after the one before it, so it adds one at one place and takes it away at another.

Cases: null and empty texts, and texts of one word, match nothing (licence null, score 0). Of equal scores the first
licence by name is reported. Equal rows give equal values, an empty table an empty result. Only doc_id and text are read."""

from __future__ import annotations

import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Names and texts of public licences: full texts of the short ones, notices of the long ones, and the lines that pages carry.
TEMPLATES = {
    "0bsd": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "artistic-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-1.0-full": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-full": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/',
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: Words of the templates that say little: none of them is asked for before a text is cut into parts.
COMMON = frozenset("a above all and any are as at by can for form in is it of or that the this to under with you work use version 0 1 2 3 4".split())

THRESHOLD = 0.8
_WORDS = re.compile("[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")


def bigrams(part: str) -> frozenset:
    """The distinct word bigrams of a lower-case text."""
    words = _WORDS.findall(part)
    return frozenset(zip(words, words[1:]))


def templates_in(folder: str) -> dict[str, str]:
    """More templates: each file of a folder by its name."""
    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.t = threshold
        self.sets = {k: bigrams(v.lower()) for k, v in sorted(templates.items())}
        self.sets = {k: b for k, b in self.sets.items() if b}
        self.widths = {k: len(_WORDS.findall(templates[k].lower())) - 1 for k in self.sets}
        self.need = {k: math.ceil(self.bounds(b)[0] - 1e-9) for k, b in self.sets.items()}
        self.asked = self._asked()
        self.low = min(self.bounds(b)[0] for b in self.sets.values())
        self.high = max(self.bounds(b)[1] for b in self.sets.values())

    def bounds(self, b: frozenset) -> tuple[float, float]:
        return self.t / (2 - self.t) * len(b), (2 - self.t) / self.t * len(b)

    def _asked(self) -> list[str]:
        """Words of which every text with a match holds one."""
        out: set[str] = set()
        for b in self.sets.values():
            need = len(b) - math.ceil(self.t * len(b) / (2 - self.t) - 1e-9) + 1
            ways = sorted((any(w in out for w in pair) or any(w not in COMMON for w in pair), pair) for pair in b)[::-1][:need]
            for _, pair in ways:
                if not any(w in out for w in pair):
                    out.add(max(pair, key=lambda w: (w not in COMMON, len(w), w)))
        return sorted(out)

    def parts(self, text: str) -> set[str]:
        low = text.lower()
        lines = low.split("\n")
        return {low, *lines, *(s for x in lines for s in _SENTENCE.split(x))}

    def match(self, part: str) -> list[tuple[float, str]]:
        """(score, licence) of the templates that a part reaches."""
        a = bigrams(part)
        out = []
        if self.low - 1e-9 <= len(a) <= self.high + 1e-9:
            for name, b in self.sets.items():
                low, high = self.bounds(b)
                if low - 1e-9 <= len(a) <= high + 1e-9 and (score := 2 * len(a & b) / (len(a) + len(b))) >= self.t:
                    out.append((score, name))
        return out

    def windows(self, text: str) -> list[tuple[float, str]]:
        """(best score of its windows, licence) of the templates that a window of their own width reaches."""
        words = _WORDS.findall(text.lower())
        pairs = list(zip(words, words[1:]))
        known = set(pairs)
        out = []
        before = None
        for name, b in self.sets.items():
            width = self.widths[name]
            if len(pairs) < width or len(known & b) < self.need[name]:
                continue
            if before is None:  # where each bigram stood last, -1 where it is new
                last: dict[tuple, int] = {}
                before = np.empty(len(pairs), np.int64)
                for i, p in enumerate(pairs):
                    before[i] = last.get(p, -1)
                    last[p] = i
            at = np.fromiter((i for i, p in enumerate(pairs) if p in b), np.int64)
            every, shared = self._distinct(np.arange(len(pairs)), before, width), self._distinct(at, before, width)
            best = float((2 * shared / (every + len(b))).max())
            if best >= self.t:
                out.append((best, name))
        return out

    @staticmethod
    def _distinct(at: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
        """For each window of `width` bigrams how many distinct ones of those at some places it holds."""
        ends = len(before) - width
        first, last = np.maximum(np.maximum(before[at] + 1, at - width + 1), 0), np.minimum(at, ends)
        at = first <= last
        return np.cumsum(np.bincount(first[at], minlength=ends + 2) - np.bincount(last[at] + 1, minlength=ends + 2))[: ends + 1]

    def scan(self, text: str | None) -> tuple[str | None, float, list[str]]:
        """(best licence, its score, all licences found by name)."""
        low = text.lower() if text else ""
        if not any(w in low for w in self.asked):
            return None, 0.0, []
        found = [x for p in self.parts(text) for x in self.match(p)] + self.windows(text)
        if not found:
            return None, 0.0, []
        best = min(found, key=lambda x: (-x[0], x[1]))
        return best[1], best[0], sorted({n for _, n in found})


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, score, n_licences and licences (names joined by commas)."""

    def make():
        scanner = Scanner(templates, threshold)

        def work(texts: list) -> dict:
            rows = [scanner.scan(t) for t in texts]
            return {
                "licence": pa.array([r[0] for r in rows], pa.string()),
                "score": pa.array([r[1] for r in rows], pa.float64()),
                "n_licences": pa.array([len(r[2]) for r in rows], pa.int64()),
                "licences": pa.array([",".join(r[2]) for r in rows], pa.string()),
            }

        return work

    return map_texts(docs, make, "licence string, score double, n_licences bigint, licences string")


def oracle_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB SQL, without pruning: every part against every template."""
    rows = ", ".join(f"('{k}', '{v.lower().replace(chr(39), chr(39) * 2)}')" for k, v in templates.items())
    pairs = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
WITH t AS MATERIALIZED (SELECT name, len(w) - 1 AS width, {pairs.format(w="w")} AS b FROM (SELECT name, regexp_extract_all(body, '[a-z0-9]+') AS w FROM (VALUES {rows}) v(name, body))),
d AS (SELECT row_number() OVER () AS rn, doc_id, lower(coalesce(text, '')) AS body FROM documents),
p AS (SELECT rn, body AS part FROM d UNION SELECT rn, unnest(string_split(body, chr(10))) FROM d
      UNION SELECT rn, unnest(string_split(regexp_replace(body, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) FROM d),
a AS (SELECT rn, {pairs.format(w="w")} AS b FROM (SELECT rn, regexp_extract_all(part, '[a-z0-9]+') AS w FROM p)),
s AS (SELECT rn, name, 2 * len(list_intersect(a.b, t.b))::DOUBLE / (len(a.b) + len(t.b)) AS score FROM a, t WHERE len(a.b) > 0),
bg AS MATERIALIZED (SELECT rn, p, w[p + 1] || ' ' || w[p + 2] AS g, len(w) - 1 AS n FROM (SELECT rn, w, unnest(range(0, len(w) - 1)) AS p FROM (SELECT rn, regexp_extract_all(body, '[a-z0-9]+') AS w FROM d) WHERE len(w) > 1)),
tb AS (SELECT name, unnest(b) AS g FROM t),
cand AS MATERIALIZED (SELECT rn, name, width, nb, n FROM (SELECT rn, tb.name, count(DISTINCT bg.g) AS k, any_value(n) AS n FROM bg JOIN tb USING (g) GROUP BY rn, tb.name) x
         JOIN (SELECT name, width, len(b) AS nb FROM t) USING (name) WHERE n >= width AND k >= ceil({threshold} * nb / (2 - {threshold}) - 1e-9)),
pos AS (SELECT rn, p, g, lag(p, 1, -1) OVER (PARTITION BY rn, g ORDER BY p) AS q FROM bg WHERE rn IN (SELECT rn FROM cand)),
ev AS (SELECT rn, name, nb, n - width AS last, greatest(q + 1, p - width + 1, 0) AS a, least(p, n - width) AS z, CASE WHEN tb.g IS NULL THEN 0 ELSE 1 END AS hit
       FROM cand JOIN pos USING (rn) LEFT JOIN tb USING (name, g)),
e2 AS (SELECT rn, name, nb, last, s, sum(x) AS x, sum(y) AS y FROM (SELECT rn, name, nb, last, a AS s, 1 AS x, hit AS y FROM ev WHERE a <= z UNION ALL SELECT rn, name, nb, last, z + 1, -1, -hit FROM ev WHERE a <= z) GROUP BY ALL),
win AS (SELECT rn, name, last, s, 2 * (sum(y) OVER o)::DOUBLE / (sum(x) OVER o + nb) AS score FROM e2 WINDOW o AS (PARTITION BY rn, name ORDER BY s)),
m AS (SELECT rn, name, max(score) AS score FROM (SELECT rn, name, score FROM s UNION ALL SELECT rn, name, score FROM win WHERE s <= last) WHERE score >= {threshold} GROUP BY rn, name)
SELECT doc_id, (SELECT name FROM m WHERE m.rn = d.rn ORDER BY score DESC, name LIMIT 1) AS licence, coalesce((SELECT max(score) FROM m WHERE m.rn = d.rn), 0)::DOUBLE AS score,
       (SELECT count(*) FROM m WHERE m.rn = d.rn)::BIGINT AS n_licences, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM m WHERE m.rn = d.rn), '') AS licences
FROM d"""
