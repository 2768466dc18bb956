"""License scans by canonical digests.

A text, and each of its lines, is brought into a canonical form: characters beyond ASCII
and punctuation become spaces, A-Z are lower-cased, lines that begin with a copyright
notice or only reserve all rights are left out, equivalent spellings become one, and runs of spaces shrink.  SHA-256
digests of the canonical forms are hash-joined to the digests of known license texts and
notices.  Every text and every line is looked up whole.

The table of known licenses is a parameter of a few dozen rows, so its broadcast is
bounded.  Short licenses and notices are given as texts (KNOWN), with and without their
titles; long ones as digests of their canonical forms (KNOWN_DIGESTS).  A license that stands
wrapped over several lines within a longer text is not looked up, only its one-line notices are.  Edge cases: a null, empty or punctuation-only text has no digest and no license;
lines of any length are digested whole; repeated rows are scanned row by row (rows are told
apart by a row number within the scan); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings (whole words), the right one standing for both.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("v", "version"))
_WARRANTY_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_WARRANTY_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Known texts by license id (public license texts and customary notices).
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", 'MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _WARRANTY_MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", _BSD + _WARRANTY_BSD),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD + _BSD3 + _WARRANTY_BSD),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC + ".\n" + _WARRANTY_ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
)


#: The same texts with the title that they often have, or without.
_TITLES = (("MIT", "The MIT License (MIT)"), ("MIT", ""), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "The BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "The BSD 3-Clause License"), ("ISC", "ISC License"), ("ISC", "The ISC License"), ("0BSD", "BSD Zero Clause License"), ("0BSD", "Zero-Clause BSD"))
_WHOLE = {k: v.removeprefix("MIT License\n") for k, v in reversed(KNOWN) if v.startswith(("MIT License\n", _BSD, _ISC))}
KNOWN += tuple((k, f"{title}\n{_WHOLE[k]}") for k, title in _TITLES)

#: SHA-256 of the canonical forms of the full texts, as their publishers issue them.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Artistic-1.0-Perl", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
    ("GFDL-1.2", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0", "80188d2eb86384574b90534ba98aa2e4373d868aeb5f6323b35189e4b2b5d318"),
    ("GPL-2.0", "b0e391cf95f80a18c93d6be3a9e78f668e4f98021ab771244b810fe2e61126fa"),
    ("GPL-3.0", "e2653cfab3de7b68d542115995575c6e3e9af611375084fc72771e6bab5d1612"),
    ("LGPL-2.0", "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d"),
    ("LGPL-2.1", "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "7f53215bc7aa8409bdaa0f38be95d4f00c3ae9f4c2bb9ae3a85c9c4f6fdd1815"),
    ("MPL-2.0", "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61"),
)


def canonical_lines(text: Column) -> Column:
    """Canonical forms of a text's lines, without empty ones and copyright lines.

    Each line's form is made once: lambdas do not share equal subexpressions, so a second step
    judges the first one's result.  The patterns name ASCII letters and digits as one class, which
    Java matches much faster than a negated union of three ranges.
    """

    def plain(line: Column) -> Column:
        x = F.lower(F.regexp_replace(F.regexp_replace(line, r"\([cC]\)", " "), r"[^\p{Alnum}]+", " "))
        return F.when(line.rlike(r"^[^\p{Alnum}(]*(\([cC]\)|©)"), F.lit("  ")).otherwise(F.concat(F.lit(" "), F.trim(x), F.lit(" ")))

    def spelled(x: Column) -> Column:
        notice = (x == " all rights reserved ") | x.startswith(" copyright ") | x.startswith(" copr ")
        x = F.when(notice, F.lit("  ")).otherwise(x)
        for other, one in SPELLINGS:
            x = F.replace(x, F.lit(f" {other} "), F.lit(f" {one} "))
        return F.trim(x)

    return F.filter(F.transform(F.transform(F.split(text, "\n"), plain), spelled), lambda x: x != "")


def known_digests(spark, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """(digest, license): one row per canonical form; the smallest id wins a tie."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in known])
    table = spark.range(1).select(F.explode(rows).alias("k")).select("k.license", "k.body")
    table = table.select(F.sha2(F.array_join(canonical_lines(F.col("body")), " "), 256).alias("digest"), "license")
    if digests:
        fixed = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license")) for k, d in digests])
        table = table.unionByName(spark.range(1).select(F.explode(fixed).alias("k")).select("k.digest", "k.license"))
    return table.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known=KNOWN, digests=KNOWN_DIGESTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_digest, text_license, n_license_lines, line_licenses) of every row.

    ``line_licenses`` are the sorted distinct ids found on whole lines, comma-joined.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known, digests)
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), canonical_lines(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_lines"))
    whole = F.when(F.size("_lines") > 0, F.sha2(F.array_join("_lines", " "), 256))
    units = base.select("_row", "doc_id", whole.alias("text_digest"), F.transform("_lines", lambda x: F.sha2(x, 256)).alias("_digests"))
    found = (
        units.select("_row", "doc_id", "text_digest", F.posexplode_outer(F.concat(F.array("text_digest"), "_digests")).alias("_at", "digest"))
        .join(F.broadcast(table), "digest", "left")
    )
    # the rows of a document are in one task, so the partial aggregate is the whole one
    line = (F.col("_at") > 0) & F.col("license").isNotNull()
    return found.groupBy("_row", "doc_id").agg(
        F.first("text_digest").alias("text_digest"),
        F.max(F.when(F.col("_at") == 0, F.col("license"))).alias("text_license"),
        F.sum(line.cast("long")).alias("n_license_lines"),
        F.array_join(F.sort_array(F.collect_set(F.when(line, F.col("license")))), ",").alias("line_licenses"),
    ).drop("_row")


def op1_license_digests(spark, sf_dir: str) -> DataFrame:
    """Licenses of all documents, by whole text and by whole line."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
