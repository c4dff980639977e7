"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.llm.common import stage
from corpusmill.llm.decontamination import hash_filter, in_filter, plain_words

SHINGLE = 5
BANDS, ROWS = 24, 2
MOST_TEMPLATES = 1000

# Notices and openings of public licenses.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice-2", "This project is licensed under the terms of the MIT license."),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
     "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software."),
    ("apache-2-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
     "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-2-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation; either version 2 of the License, or (at your option) any later version."),
    ("bsd-clauses", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
     "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies."),
    ("mpl-2-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
     "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
     "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-third-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
     "written permission."),
    ("bsd-disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
     "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
     "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
     "THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
     "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
     "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl-2.1-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
     "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl-3-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
     "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl-3-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
     "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("gfdl-1.3-notice", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by "
     "the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled \"GNU Free "
     "Documentation License\"."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
     "in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
     "software. This notice may not be removed or altered from any source distribution."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
     "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
     "is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
     "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely "
     "in the form of machine-executable object code generated by a source language processor."),
    ("bsl-1-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("epl-2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0-notice", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software "
     "is distributed without any warranty."),
    ("cc-by-nd-4-notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-4-long-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa-4-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("artistic-2-notice", "You can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("perl-notice", "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself."),
    ("unlicense-rights", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
     "this dedication for the benefit of the public at large and to the detriment of our heirs and successors."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)


def built_in_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template string, text string").coalesce(1)


def shingle_hashes(words: str) -> Column:
    """Hashes of five-word shingles in text order; a text of fewer words has none."""
    last = F.size(words) - SHINGLE
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    ).otherwise(F.array().cast("array<bigint>"))


def band_keys(hashes: Column) -> Column:
    """Keys of the MinHash bands of a set of hashes: band b joins the minima of ROWS hash functions."""
    minima = lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(j))))
    return F.array(*(F.xxhash64(F.lit(b), *(minima(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))


def license_matches(
    docs: DataFrame, templates: DataFrame | None = None, text: str = "text", id_column: str = "doc_id", similarity: float = 0.8,
) -> DataFrame:
    """(id, digest, template, start, n_words, containment), one row per document and template; containment is the share of the
    template's distinct five-word shingles that stand in the best window, at least `similarity`; start and n_words give
    the window's words from the first to the last such shingle.

    A template of m shingles, d of them distinct, is looked for in windows of m + step shingles that overlap by all but step = max(1, m // 4),
    so any passage of its length lies in one window. Where no shingle repeats, a window that holds 0.8 of the shingles has a Jaccard
    similarity to the template of 0.55 or more, which 24 bands of 2 rows miss with a probability below (1 - 0.55^2)^24 = 0.0002. Repeats push
    that similarity down without a bound, so a template with a repeated shingle is compared with every window of its size that passes the
    test below. Before any window is made, shingles are tested against those of all templates inside the row, and windows with fewer
    distinct known shingles than the similarity asks for are passed over; neither step loses a match.

    Templates are a bounded table (1000 rows at most, checked), so their bands are broadcast and the text of a hot license never meets in one
    task. Templates below five words cannot be told from prose and are left out. Null and short texts have no match;
    repeated rows (same id and text) share one result row; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    given = built_in_templates(spark) if templates is None else templates.select("template", "text")
    hashed = given.select("template", plain_words(F.col("text")).alias("w")).select("template", shingle_hashes("w").alias("all"))
    known = stage(hashed.select("template", F.array_distinct("all").alias("hashes"), F.size("all").alias("m")).where("m > 0"), "templates")
    repeats = F.size("hashes") < F.col("m")
    if known.count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    sizes = known.groupBy("m").agg(F.min(F.size("hashes")).alias("d"), F.max(repeats).alias("repeats")).orderBy("m").collect()  # at most a row per template
    bits = hash_filter(known.select(F.explode("hashes").alias("h")))
    base = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("digest"), plain_words(F.col(text)).alias("w"))
    shingled = base.select("id", "digest", shingle_hashes("w").alias("s"), bits.alias("filter"))
    hits = F.filter(F.transform("s", lambda h, i: F.when(in_filter(F.col("filter"), h), i)), lambda i: i.isNotNull())
    # One evaluation: an outer explode attracts no filter that would repeat it. What has hits is staged before windows are made.
    some = F.transform(F.array(hits), lambda x: F.when(F.size(x) > 0, F.struct(F.col("s"), x.alias("hits"))))
    held = stage(shingled.select("id", "digest", F.explode_outer(some).alias("x")).where("x is not null").select("id", "digest", "x.s", "x.hits"), "hits")
    windows = []
    for m, fewest, _ in sizes:
        step, need = max(1, m // 4), similarity * fewest
        length = m + step
        starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(
            F.greatest(F.lit(0), F.floor((i - length) / step).cast("int") + 1), F.floor(i / step).cast("int")))))
        within = lambda k: F.filter("hits", lambda i: (i >= k * step) & (i < k * step + length))
        distinct = lambda k: F.array_distinct(F.transform(within(k), lambda i: F.get("s", i)))
        enough = F.filter(starts, lambda k: (F.size(within(k)) >= need) & (F.size(distinct(k)) >= need))
        windows.append(F.transform(enough, lambda k: F.struct(F.lit(m).alias("m"), (k * step).alias("at"), F.lit(length).alias("length"))))
    made = F.concat(*windows) if windows else F.array().cast("array<struct<m:int,at:int,length:int>>")
    rows = held.select("id", "digest", "s", F.explode_outer(made).alias("x")).where("x is not null")
    rows = rows.select("id", "digest", "x.m", "x.at", F.slice("s", F.col("x.at") + 1, F.col("x.length")).alias("window"))
    # Templates with repeats, and windows of their sizes, share the key 0 in place of bands.
    direct, none = F.array(F.lit(0).cast("bigint")), F.array().cast("array<bigint>")
    open_sizes = [r["m"] for r in sizes if r["repeats"]]
    keys = F.array_distinct(F.concat(band_keys(F.col("window")), F.when(F.col("m").isin(open_sizes), direct).otherwise(none)))
    banded = rows.select("*", F.explode_outer(keys).alias("key"))
    templates_banded = known.select("template", "hashes", "m", F.explode(F.when(repeats, direct).otherwise(band_keys(F.col("hashes")))).alias("key"))
    found = banded.join(F.broadcast(templates_banded), ["m", "key"])
    shared = F.array_intersect("window", "hashes")
    found = found.select("id", "digest", "template", "at", "window", "hashes", (F.size(shared) / F.size("hashes")).alias("containment")).where(F.col("containment") >= similarity)
    places = F.filter(F.transform("window", lambda h, i: F.when(F.array_contains("hashes", h), i)), lambda i: i.isNotNull())
    found = found.select("id", "digest", "template", "containment", "at", places.alias("places"))
    found = found.select("id", "digest", "template", "containment", (F.col("at") + F.array_min("places")).alias("start"),
                         (F.array_max("places") - F.array_min("places") + SHINGLE).alias("n_words"))
    best = found.groupBy("id", "digest", "template").agg(F.max(F.struct("containment", (-F.col("n_words")).alias("n"), (-F.col("start")).alias("s"))).alias("best"))
    return best.select("id", "digest", "template", (-F.col("best.s")).alias("start"), (-F.col("best.n")).alias("n_words"), "best.containment")
