"""Op 9: license scans by MinHash bands over overlapping text windows. DataFrame functions only.

A template of n words is looked for in windows of 2n words that start every n words, so each occurrence
lies whole in a window. A window and a template meet in a band if the shingles with the least hash of that
band are the same; enough bands are used that a window holding ``containment`` of a template's shingles
meets it with probability 1 - ``miss`` at least. Meeting takes the template's own least shingle, so the
index is the list of these (one a band and template), and windows without any of them, which meet nothing,
are not hashed further. Pairs that meet are verified: the share of the template's distinct shingles that
the window holds.

Templates of fewer than five words have no shingle and are refused. Null and short texts have no
windows. Rows equal in id and text count once. Long texts are cut by their windows, never whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.decontamination import words

#: Notices by which texts declare their license, and license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
SHINGLE = 5


def bands_for(n_words: int, containment: float, miss: float) -> int:
    """Bands of one row that leave a true pair of a template of n_words unmet with probability miss at most."""
    m = n_words - SHINGLE + 1
    held = math.ceil(containment * m - 1e-9)
    jaccard = held / (2 * n_words - SHINGLE + 1 + m - held)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def shingles(ws: Column, count: Column) -> Column:
    """Hashes of the first count shingles of the words."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.slice(ws, i + 1, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def _least(sh: Column, bands: Column) -> Column:
    """The least hash of every band."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(sh, lambda x: F.xxhash64(b, x))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, n, tsh) of the templates: words and distinct shingles."""
    rows = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(templates.items())]
    t = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(F.lit("").alias("license"), F.lit("").alias("text"))
    return t.select("license", words(F.col("text")).alias("ws")).select("license", F.size("ws").alias("n"), F.array_distinct(shingles(F.col("ws"), F.size("ws") - SHINGLE + 1)).alias("tsh"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, miss: float = 1e-5) -> DataFrame:
    """doc_id, license, n_windows, containment: templates found, with the matching windows and the best share."""
    t = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    lengths = sorted({r["n"] for r in t.select("n").collect()})  # a parameter, not data
    if lengths and lengths[0] < SHINGLE:
        raise ValueError("a template needs five words at least")
    bands = F.element_at(F.create_map(*(F.lit(x) for n in lengths for x in (n, bands_for(n, containment, miss)))), F.col("n")) if lengths else F.lit(1)
    known = t.select("license", "n", "tsh", F.posexplode(_least(F.col("tsh"), bands)).alias("band", "v"))
    named = known.select("n", F.explode(F.filter("tsh", lambda x: F.xxhash64("band", x) == F.col("v"))).alias("sh"))
    # the index, of the size of the parameter: shingle to the template lengths it stands for
    index = {r["sh"]: sorted(r["ns"]) for r in named.groupBy("sh").agg(F.collect_set("n").alias("ns")).collect()}
    of_length = {n: [sh for sh, ns in index.items() if n in ns] for n in lengths}
    # a generator between projections, so that texts are split once and not for every use of their words
    d = docs.select(F.inline(F.array(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("rid"), words(F.col(text_col)).alias("ws")))))
    at = F.filter(F.transform(F.sequence(F.lit(0), F.size("ws") - SHINGLE), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("ws", i + 1, SHINGLE)).alias("sh"))), lambda x: x["sh"].isin(list(index)))
    hit = d.filter(F.size("ws") >= SHINGLE).select("doc_id", "rid", "ws", F.explode(F.array(at)).alias("hits")).filter(F.size("hits") > 0)

    def windows(n: int) -> Column:
        """Windows for templates of n words that hold a whole index shingle."""
        mine = F.transform(F.filter("hits", lambda x: x["sh"].isin(of_length[n])), lambda x: x["pos"])
        first = F.transform(mine, lambda p: F.floor(p / n).cast("int"))
        second = F.transform(F.filter(mine, lambda p: (p >= n) & (p % n <= n - SHINGLE)), lambda p: F.floor(p / n).cast("int") - 1)
        return F.transform(F.array_union(first, second), lambda k: F.struct(F.lit(n).alias("n"), k.alias("k"), F.slice("ws", k * n + 1, 2 * n).alias("win")))

    w = hit.select("doc_id", "rid", F.inline(F.flatten(F.array(*map(windows, lengths))))) if lengths else hit.select("doc_id", "rid", F.lit(0).alias("n"), F.lit(0).alias("k"), "ws").toDF("doc_id", "rid", "n", "k", "win").limit(0)
    w = w.select("doc_id", "rid", "n", "k", F.explode(F.array(F.array_distinct(shingles(F.col("win"), F.size("win") - SHINGLE + 1)))).alias("wsh"))
    banded = w.select("*", F.posexplode(_least(F.col("wsh"), bands)).alias("band", "v"))
    met = banded.join(F.broadcast(known), ["n", "band", "v"]).select("rid", "doc_id", "k", "license", (F.size(F.array_intersect("wsh", "tsh")) / F.size("tsh")).alias("share")).filter(F.col("share") >= containment)
    return met.groupBy("rid", "doc_id", "license").agg(F.count_distinct("k").alias("n_windows"), F.max("share").alias("containment")).select("doc_id", "license", "n_windows", "containment")
