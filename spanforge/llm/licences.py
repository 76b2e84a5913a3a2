"""Operator 8: licence scans by canonical digest lookup.

A text is brought to a canonical form: copyright lines go, A-Z are lower-cased,
equivalent spellings become one, and what isn't a letter or digit becomes one
blank. The SHA-256 of that form is joined to the digests of known licences, for
entire documents, and also for their lines and for runs of their paragraphs, so
that a licence inside a document is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import ascii_lower

#: Notices by which works are put under a licence.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Complete texts of short licences, without their copyright lines, one paragraph a line.
TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    ),
)
#: Headings that some of these texts have.
HEADINGS = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("0BSD", "BSD Zero Clause License"),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
)
#: Canonical digests of complete texts of longer licences, as their publishers give them.
DIGESTS = (
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause-UC", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-3.0", "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
#: Spellings that count as equal, as the one that is replaced and the one that replaces it, in lower case.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("authoris", "authoriz"),
    ("realis", "realiz"),
    ("utilis", "utiliz"),
    ("emphasis", "emphasiz"),
    ("initialis", "initializ"),
    ("categoris", "categoriz"),
    ("customis", "customiz"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("labour", "labor"),
    ("defence", "defense"),
    ("offence", "offense"),
    ("programme", "program"),
    ("catalogue", "catalog"),
    ("fulfilment", "fulfillment"),
    ("wilful", "willful"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("https:", "http:"),
)
#: A line with a copyright sign, or that begins with the word and isn't a sentence about it.
COPYRIGHT = r"(^|\n)[^0-9a-z\n]*(copyright( \(c\)| [0-9©]|:)|\(c\) [0-9]|©|all rights reserved)[^\n]*"
#: What isn't a letter, a digit or the end of a line; and what parts paragraphs once that is a blank.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
PARTING = r" *\n *\n[ \n]*"
KNOWN_ROWS = 100_000
WHOLE, LINE, BLOCK = 0, 1, 2


def _plain(text: Column) -> Column:
    """The canonical form but for its lines, which it still has."""
    t = ascii_lower(text)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, COPYRIGHT, "$1"), MARKS, " ")


def _joined(plain: Column) -> Column:
    return F.trim(F.regexp_replace(plain, r"[ \n]+", " "))


def _paragraphs(plain: Column) -> Column:
    return F.filter(F.transform(F.split(plain, PARTING), _joined), lambda x: x != "")


def _sha(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def canonical(text: Column) -> Column:
    """The text in one line: without copyright lines and marks, in one case and spelling."""
    return _joined(_plain(text))


def digest(text: Column) -> Column:
    return _sha(canonical(text))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, licence): of texts that agree in canonical form the least name counts."""
    return known.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def paragraph_counts(known: DataFrame) -> list[int]:
    """The numbers of paragraphs that known texts have."""
    return sorted(r["n"] for r in known.select(F.coalesce(F.size(_paragraphs(_plain(F.col("text")))), F.lit(0)).alias("n")).distinct().collect() if r["n"])


def entries() -> list[tuple[str, str]]:
    """(licence, text) of the notices and of the complete short licences, with and without their headings."""
    bodies = dict(TEXTS)
    return [*NOTICES, *TEXTS, *((name, f"{heading}\n\n{bodies[name]}") for name, heading in HEADINGS)]


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "licence string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_lines, text_sha256, licence, n_licence_lines, n_licence_blocks, licences): one row for each document.

    text_sha256 is the canonical digest of the whole text and licence the known
    licence that it is, if any. n_licence_lines counts the lines, and
    n_licence_blocks the runs of whole paragraphs, that are a known text;
    licences names both, sorted and comma-joined. Runs are as long as some known
    text has paragraphs. ``known`` (licence, text) replaces the notices, the short
    licences and the digests of longer ones.

    Defined cases: a null text is empty; an empty text has one line and is no
    licence. Rows that repeat come out as often as they came in. Null ids keep
    their rows. No column but doc_id and text is read. An empty table of
    documents gives no rows, an empty table of licences no finds.
    """
    spark = docs.sparkSession
    texts = known if known is not None else known_texts(spark)
    digests = known_digests(texts)
    if known is None:
        digests = digests.unionByName(spark.createDataFrame([(d, n) for n, d in DIGESTS], "digest string, licence string"))
    digests = digests.filter(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))
    few = digests.count() <= KNOWN_ROWS
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    d = d.select("doc_id", "th", n.alias("n_lines"), _plain(F.col("text")).alias("plain"))
    d = d.withColumn("paragraphs", _paragraphs(F.col("plain")))
    unit = lambda kind, sha: F.struct(F.lit(kind).alias("kind"), sha.alias("digest"))
    units = [F.array(unit(WHOLE, _sha(_joined(F.col("plain"))))), F.transform(F.split("plain", "\n"), lambda x: unit(LINE, _sha(F.trim(x))))]

    def runs(k: int) -> Column:
        starts = F.when(F.size("paragraphs") >= k, F.sequence(F.lit(1), F.size("paragraphs") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: unit(BLOCK, _sha(F.array_join(F.slice("paragraphs", i, k), " "))))

    units += [runs(k) for k in paragraph_counts(texts)]
    u = d.select("doc_id", "th", "n_lines", F.explode(F.concat(*units)).alias("unit")).select("doc_id", "th", "n_lines", "unit.*")
    u = u.join(F.broadcast(digests) if few else digests, "digest", "left").filter((F.col("kind") == WHOLE) | F.col("licence").isNotNull())
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    out = u.groupBy("doc_id", "th").agg(
        F.count(of(WHOLE, "kind")).alias("rows"),
        F.max("n_lines").alias("n_lines"),
        F.max(of(WHOLE, "digest")).alias("text_sha256"),
        F.max(of(WHOLE, "licence")).alias("licence"),
        F.count(of(LINE, "licence")).alias("lines"),
        F.count(of(BLOCK, "licence")).alias("blocks"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") != WHOLE, F.col("licence")))), ",").alias("licences"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    each = lambda c: (F.col(c) / F.col("rows")).cast("long")
    return out.select("doc_id", "n_lines", "text_sha256", "licence", each("lines").alias("n_licence_lines"), each("blocks").alias("n_licence_blocks"), "licences")
