"""Licence notices by Dice coefficient over word bigrams, in DataFrame operations only.

Texts are lower-cased and everything but letters and digits parts words. Units of a document are
its lines, its paragraphs of several lines and the whole text, so a notice is found on a line of
its own, as a block and as a licence file. For a threshold t and a template of n bigrams only
units with t / (2 - t) * n to (2 - t) / t * n bigrams can reach t; other pairs are not compared.
Long licences are known by their heading. Notices within a longer line or paragraph are not found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

# Usual wordings of licence notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}


# Wordings that came later; their numbers go on after those above.
MORE = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-2-Clause": [f"{_BSD_GRANT} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def flat_templates(templates: dict[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(licence, number of the wording, bigrams) in order."""
    return [(name, k, template_bigrams(text)) for name, texts in templates.items() for k, text in enumerate(texts)]


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
         more: dict[str, list[str]] = MORE) -> DataFrame:
    """(doc_id, unit, place, licence, wording, dice): the best template of every unit that reaches the threshold.

    Units are `line` (place: its number from 0), `block` (a paragraph of several lines, parted by
    empty lines; its number from 0) and `text` (a text of several lines; 0). Equal scores go to the
    template first in order. Null and empty texts and lines without two words find nothing;
    repeated rows repeat. Bigrams count once; no unit is cut.
    """
    flat = flat_templates(templates) + [(name, k + len(templates.get(name, [])), grams) for name, k, grams in flat_templates(more)]
    factor = threshold / (2 - threshold)
    least = min(len(g) for *_, g in flat) * factor
    most = max(len(g) for *_, g in flat) / factor
    text = docs[text_col].cast("string")
    lines, blocks = F.split(text, "\n"), F.split(text, r"\n\s*\n")
    named = lambda kind: lambda t, k: F.struct(F.lit(kind).alias("unit"), k.alias("place"), t.alias("text"))
    of_blocks = F.filter(F.transform(blocks, named("block")), lambda u: F.contains(F.trim(u["text"]), F.lit("\n")) & (F.size(blocks) > 1))
    of_text = F.when(F.size(lines) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), text.alias("text")))).otherwise(
        F.array().cast("array<struct<unit:string,place:int,text:string>>"))
    # dice >= t needs at least t / (2 - t) of the unit's bigrams in the template, so in all templates together
    known = sorted({b for *_, g in flat for b in g})
    # each step is a transform of the array before, so that a step's value is made once for a unit
    words = F.transform(F.concat(F.transform(lines, named("line")), of_blocks, of_text), lambda u: F.struct(
        u["unit"].alias("unit"), u["place"].alias("place"), F.split(F.trim(F.regexp_replace(F.lower(u["text"]), "[^a-z0-9]+", " ")), " ").alias("words")))
    enough = F.filter(words, lambda u: F.size(u["words"]) > least)
    pairs = F.transform(enough, lambda u: F.struct(u["unit"].alias("unit"), u["place"].alias("place"), F.array_distinct(F.zip_with(
        F.slice(u["words"], 1, F.size(u["words"]) - 1), F.slice(u["words"], 2, F.size(u["words"]) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pairs")))
    likely = F.filter(pairs, lambda u: F.size(u["pairs"]).between(least, most) & (
        F.size(F.filter(u["pairs"], lambda p: p.isin(known))) >= F.size(u["pairs"]) * factor))
    units = docs.select(docs[id_col].alias("doc_id"), F.explode(likely).alias("u")).select("doc_id", "u.unit", "u.place", "u.pairs")
    return _best(units, flat, factor, threshold)


def _best(units: DataFrame, flat: list, factor: float, threshold: float) -> DataFrame:
    n = F.size("pairs")

    def dice(size: int, grams: list[str]) -> Column:
        shared = F.size(F.array_intersect("pairs", F.array(*(F.lit(g) for g in grams))))
        return F.when(n.between(size * factor, size / factor), F.round(F.lit(2.0) * shared / (n + size), 6))

    scores = [F.struct(dice(len(g), g).alias("dice"), F.lit(-k).alias("order"), F.lit(name).alias("licence"), F.lit(wording).alias("wording")) for k, (name, wording, g) in enumerate(flat)]
    best = units.select("doc_id", "unit", "place", F.array_max(F.array(*scores)).alias("best"))
    return best.where(F.col("best.dice") >= threshold).select("doc_id", "unit", "place", "best.licence", "best.wording", "best.dice")
