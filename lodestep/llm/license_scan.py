"""License scan with DataFrame operations only.

Template and document words are as in ``decontaminate.normalised``; a shingle is
two neighbouring words, hashed.  Templates are grouped by length into classes of
up to 8, 16, 32, ... words.  For each class a document is cut into windows of
twice so many words that overlap by half, so that some window holds any
occurrence whole.  A window's MinHash bands, of one row each, are looked up in
the templates' bands; for an occurrence with a share s of its shingles left the
window has a similarity of at least j = s * m / (2 * class), and the number of
bands is chosen so that 1 - (1 - j) ** bands is at least ``SURE`` for the
shortest template of the class.  What is found is verified: the share of the
template's shingles that the window holds, exactly, is at least ``share``.

Licenses of one family have most of their words in common, so ``scan`` tells
several for one notice.  ``identify`` tells the one right license of each place:
in the windows that are found, every stretch of a template's length (and a
quarter, for insertions) that begins with one of its shingles is counted, and
the best stretches nearby stay, cut to what they found.  Where stretches of
different templates overlap by half of the shorter one, the one is right of which
the most shingles are found, less those that are missing, then the longer
template, then the narrower stretch.  Stretches are settled in that order within islands of overlapping
ones.

A document is cut only if it has one of the templates' anchor words, of which
each match has to have one, as long as the templates have at most ``ANCHORED``
words; beyond, all are cut.  The templates' bands are broadcast up to
``BROADCAST_WORDS`` words and joined by a shuffle beyond.

Null and empty texts match nothing; templates of less than two words are left
out; templates with the same id and different texts are one license in several
wordings.  Rows of one id are one document, whatever their texts, and its best
window is told; rows without an id are told apart by their texts.  Empty tables
give an empty one; whole texts are cut, however long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import normalised

SHARE, SURE = 0.8, 0.9999
#: Words of all templates up to which anchors choose the documents, and up to which their bands are broadcast.
ANCHORED, BROADCAST_WORDS = 50_000, 1_000_000

# Public license texts and the notices that stand for longer ones.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT = (
    _MIT_GRANT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
    " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
    " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    _BSD_HEAD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,'
    " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"
    " FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT"
    " (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY'
    " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,"
    " DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
    " subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
    " If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
    " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."
    " 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,"
    " either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,'
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation,"
    " either version {version} of the License, or (at your option) any later version."
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    " See the {name} for more details."
)
_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
_LGPL_OLD = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"
    " either version 2.1 of the License, or (at your option) any later version."
    " This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    " See the GNU Lesser General Public License for more details."
)
_CC = "This work is licensed under a Creative Commons {kind} {version} International License."
NOTICES = (
    ("AGPL-3.0", _GNU.format(name=_AGPL, version="3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE[: _APACHE.index(" You may obtain")]),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", _CC.format(kind="Attribution", version="4.0")),
    ("CC-BY-SA-4.0", _CC.format(kind="Attribution-ShareAlike", version="4.0")),
    ("CC-BY-NC-4.0", _CC.format(kind="Attribution-NonCommercial", version="4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", _CC.format(kind="Attribution-NoDerivatives", version="4.0")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", _GNU.format(name=_GPL, version="2")),
    ("GPL-3.0", f"This work is licensed under the {_GPL}, version 3."),
    ("GPL-3.0", f"you can redistribute it and/or modify it under the terms of the {_GPL} as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", _GNU.format(name=_GPL, version="3")),
    ("ISC", _ISC_GRANT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("LGPL-2.1", _LGPL_OLD),
    ("LGPL-3.0", _GNU.format(name=_LGPL, version="3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("0BSD", _ISC_GRANT + "." + _ISC_END),
    ("rights-reserved", "All rights reserved."),
)


def notices(spark: SparkSession) -> DataFrame:
    """(license, text) of ``NOTICES``; ``rights-reserved`` is no license but says that there is none."""
    return spark.createDataFrame(NOTICES, "license string, text string")


def _shingles(words: Column) -> Column:
    """Hashes of the shingles, in the text's order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def anchors(words: list[str], share: float) -> list[str]:
    """Words of a template, the longest first, so many that a window without any of them can't hold ``share`` of its shingles."""
    pairs = set(zip(words, words[1:]))
    spare = len(pairs) - math.ceil(len(pairs) * share - 1e-9)
    out: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(any(w in p for w in out) for p in pairs) > spare:
            break
        out.append(word)
    return out


def _bands(shingles: Column, bands: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), bands), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def _candidates(docs: DataFrame, templates: DataFrame, id_: str, text: str, share: float, sure: float) -> DataFrame | None:
    """(id, same, license, start, window, own, n_words, n_found): each window that holds ``share`` of a template's shingles, with these and the template's number of words; None without templates."""
    side = templates.select("license", F.split(normalised(F.col("text")), " ").alias("words")).where("size(words) > 1")
    side = side.select("license", "words", F.size("words").alias("n"), F.array_sort(F.array_distinct(_shingles(F.col("words")))).alias("own")).dropDuplicates(["license", "own"])
    room = F.greatest(F.lit(8), F.pow(F.lit(2), F.ceil(F.log2(F.col("n").cast("double")) - 1e-9))).cast("int")
    classes = side.groupBy(room.alias("size")).agg(F.min(F.size("own")).alias("least"), F.sum("n").alias("words")).collect()  # a row for each power of two
    if not classes:
        return None
    bands = {c["size"]: math.ceil(math.log(1 - sure) / math.log(1 - share * c.least / (2 * c["size"]))) for c in classes}
    total = sum(c.words for c in classes)
    known = side.collect() if total <= ANCHORED else None
    # texts are read once, and shingled only if they have a word that no match can do without
    held = docs.select(F.col(id_).alias("id"), F.when(F.col(id_).isNull(), F.md5(F.col(text))).alias("same"), F.split(normalised(F.col(text)), " ").alias("words"))
    if known is not None:
        needed = sorted({w for row in known for w in anchors(row.words, share)})
        held = held.where(F.arrays_overlap("words", F.lit(needed))) if needed else held.where("false")
    held = held.select("id", "same", _shingles(F.col("words")).alias("h"))
    kinds = F.array(*(F.struct(F.lit(size).alias("size"), F.lit(n).alias("bands")) for size, n in sorted(bands.items())))
    cut = held.select("id", "same", "h", F.explode(kinds).alias("kind")).select("id", "same", "h", "kind.size", "kind.bands")
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.col("size"))
    window = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("h", s + 1, 2 * F.col("size") - 1).alias("window")))
    cut = cut.select("id", "same", "size", "bands", F.explode(window).alias("w")).select("id", "same", "size", "bands", "w.start", "w.window")
    if known is not None:
        cut = cut.where(F.arrays_overlap("window", F.lit(sorted({h for row in known for h in row.own}))))
    found = cut.select("id", "same", "size", "start", "window", F.posexplode(_bands(F.array_distinct("window"), F.col("bands"))).alias("band", "least"))
    kind = F.create_map(*(x for row in sorted(bands.items()) for x in (F.lit(row[0]), F.lit(row[1]))))
    lookup = side.withColumn("size", room).select("license", "own", "n", "size", F.posexplode(_bands(F.col("own"), kind[F.col("size")])).alias("band", "least"))
    found = found.join(F.broadcast(lookup) if total <= BROADCAST_WORDS else lookup, ["size", "band", "least"])
    found = found.select("id", "same", "license", "start", "window", "own", F.col("n").alias("n_words"), F.size(F.array_intersect("window", "own")).alias("n_found"))
    return found.where(F.col("n_found") >= _enough(share))


def _enough(share: float) -> Column:
    """The number of shingles of a template that are found, at least."""
    return F.ceil(F.size("own") * share - 1e-9)


def _none(docs: DataFrame, id_: str, schema: str) -> DataFrame:
    return docs.select(F.col(id_)).where("false").selectExpr(f"`{id_}`", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")))


def scan(docs: DataFrame, templates: DataFrame, id_: str = "doc_id", text: str = "text", share: float = SHARE, sure: float = SURE) -> DataFrame:
    """(id, license, n_found, n_shingles, first_word): one row for each row of ``docs`` and license that has ``share`` of its words there.

    ``n_found`` of the template's ``n_shingles`` stand in the best window, the
    one with the largest share, then the longest template, then the first; it
    begins at ``first_word``.  Repeated rows of one id and text count once.
    """
    found = _candidates(docs, templates, id_, text, share, sure)
    if found is None:
        return _none(docs, id_, "license string, n_found long, n_shingles long, first_word long")
    found = found.select("id", "same", "license", "start", "n_found", F.size("own").alias("n_shingles"))
    best = F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("share"), "n_shingles", (-F.col("start")).alias("back"), "n_found")).alias("best")
    return found.groupBy("id", "same", "license").agg(best).select(
        F.col("id").cast(docs.schema[id_].dataType).alias(id_),
        "license",
        F.col("best.n_found").cast("long").alias("n_found"),
        F.col("best.n_shingles").cast("long").alias("n_shingles"),
        (-F.col("best.back")).cast("long").alias("first_word"),
    )


def places(docs: DataFrame, templates: DataFrame, id_: str = "doc_id", text: str = "text", share: float = SHARE, sure: float = SURE) -> DataFrame:
    """(id, license, n_found, n_shingles, first_word, end_word): every place of a license, each the one right license of its words.

    Rows without an id are told apart by their texts; repeated rows of one id and text count once.
    """
    found = _candidates(docs, templates, id_, text, share, sure)
    if found is None:
        return _none(docs, id_, "license string, n_found long, n_shingles long, first_word long, end_word long")
    found = found.select("id", "same", "license", "start", "own", "n_words", "window").distinct()
    length = F.ceil(F.col("n_words") * 1.25).cast("int")
    # stretches that begin with one of the template's shingles, how many of them each holds, and how many without the quarter
    begins = F.filter(F.sequence(F.lit(0), F.size("window") - 1), lambda i: F.array_contains("own", F.get("window", i)))
    held = lambda i, n: F.size(F.array_intersect(F.slice("window", i + 1, n), F.col("own")))
    stretch = F.transform(begins, lambda i: F.struct(held(i, length).alias("n"), held(i, F.col("n_words") - 1).alias("tight"), i.alias("at")))
    counted = found.select("id", "same", "license", "start", "n_words", F.size("own").alias("n_shingles"), length.alias("length"), F.filter(stretch, lambda x: x["n"] >= _enough(share)).alias("s"))
    # of neighbours that hold the same, the narrowest is the place itself
    better = lambda x, y: F.struct(y["n"], y["tight"], -y["at"]) > F.struct(x["n"], x["tight"], -x["at"])
    peaks = F.filter("s", lambda x: ~F.exists("s", lambda y: (F.abs(x["at"] - y["at"]) * 2 < F.col("length")) & better(x, y)))
    one = counted.select("id", "same", "license", "start", "n_words", "n_shingles", "length", F.explode(peaks).alias("s"))
    begin, wide = F.col("start") + F.col("s.at"), F.when(F.col("s.n") == F.col("s.tight"), F.col("n_words")).otherwise(F.col("length"))
    one = one.select("id", "same", "license", "n_shingles", F.col("s.n").alias("n_found"), begin.alias("begin"), (begin + wide).alias("end")).distinct()
    # islands of overlapping stretches, in which the better ones go first
    own = Window.partitionBy("id", "same").orderBy("begin", "end", "license", "n_found")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") < reach, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.struct((F.col("n_shingles") - 2 * F.col("n_found")).alias("less"), (-F.col("n_shingles")).alias("long"), (F.col("end") - F.col("begin")).alias("wide"), "license", "begin", "end", "n_found", "n_shingles")
    order = one.withColumn("island", island).groupBy("id", "same", "island").agg(F.array_sort(F.collect_list(rank)).alias("all"))
    both = lambda a, b: F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["begin"], b["begin"]), F.lit(0))
    half = lambda a, b: both(a, b) * 2 >= F.least(a["end"] - a["begin"], b["end"] - b["begin"])
    # nor may a stretch be put together from the places of others
    pieced = lambda done, x: F.aggregate(done, F.lit(0), lambda n, y: n + both(x, y)) * 2 >= x["end"] - x["begin"]
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda done, x: F.when(F.exists(done, lambda y: half(x, y)) | pieced(done, x), done).otherwise(F.concat(done, F.array(x))))
    return order.select("id", F.explode(kept).alias("k")).select(
        F.col("id").cast(docs.schema[id_].dataType).alias(id_),
        "k.license",
        F.col("k.n_found").cast("long").alias("n_found"),
        F.col("k.n_shingles").cast("long").alias("n_shingles"),
        F.col("k.begin").cast("long").alias("first_word"),
        F.col("k.end").cast("long").alias("end_word"),
    )


def identify(docs: DataFrame, templates: DataFrame, id_: str = "doc_id", text: str = "text", share: float = SHARE, sure: float = SURE) -> DataFrame:
    """(id, license, n_found, n_shingles, first_word): the licenses of each row of ``docs``, each with its best place, the first of several alike."""
    found = places(docs, templates, id_, text, share, sure)
    best = F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("share"), "n_shingles", (-F.col("first_word")).alias("back"), "n_found")).alias("best")
    return found.groupBy(id_, "license").agg(best).select(id_, "license", "best.n_found", "best.n_shingles", (-F.col("best.back")).alias("first_word"))
