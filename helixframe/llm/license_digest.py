"""Licence scan by canonical digest, in DataFrame functions only.

A whole text is brought to a canonical form (lower case, copyright lines dropped,
punctuation and white space as single spaces, equivalent spellings as one) and its
SHA-256 is hash-joined to the digests of known licences. Each line that mentions a
licence is looked up the same way among known one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as the same.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("per cent", "percent"),
    ("programme", "program"), ("recognised", "recognized"), ("whilst", "while"), ("wilful", "willful"), ("v2", "version 2"), ("v3", "version 3"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3RD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known licence texts and one-line notices, by SPDX identifier.
LICENSES = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC + _AS_IS), ("ISC", "ISC License\n" + _ISC + _AS_IS),
    ("0BSD", _0BSD + _AS_IS), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3RD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_3RD + _BSD_TAIL), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)

#: Digests of whole licence texts, by SPDX identifier. Of each text: as published, the terms
#: alone (without and with the line that ends them), and all of these with every paragraph on one line.
FULL_TEXTS = (
    ("Apache-2.0", (
        "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100",
        "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad",
        "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca",
        "594673f8fe0542761280c31fa6f0d1eca9f491e533af6c2c1fef40b1c4229b47",
        "36229a9956938571a99113d590fb0e618aa4a86f7ddbf0874bba96f83a26a8a5",
        "e80c728dad9283541363fd9f60e4c0527fadc838f92f45f514c14da7f0a481ad",
    )),
    ("Artistic-1.0-Perl", (
        "2f167bea4d7639ee1f5ffbcbba2bb4bf72ff80c3110eea9e21bf6668fc99e8f8",
        "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
    )),
    ("BSD-3-Clause", (
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    )),
    ("CC0-1.0", (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    )),
    ("GFDL-1.2-only", (
        "5da9685c1a9eca6682cc2efb4235fa1ec1edaa00b6e92210851153930b7e8935",
        "504d6db7dfe73f50d43942f0093d32c49bddbb5decc8ae13cc73476d73fe0038",
    )),
    ("GFDL-1.3-only", (
        "3156d6cec2ca17f0bde829c9aed26c5283eeab0a308fd161098d3586242b54b0",
        "9468e475fa507761c57f9e8001abd7dbc6650d82095ed74569cbb51840af15aa",
    )),
    ("GPL-1.0-only", (
        "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f",
        "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0",
        "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9",
        "94dd0dee0896b27fc57ab4d286eee73a522a27f822d98b01787ef603a3ee1f9e",
        "fa1b93b156e883eaa26a21fbac7fe35b628bbd257d06cdbe4e86ee0ab7f9fc2c",
        "38e3a35959fa4735cd867e5fe8e8f5d183f5a19d771360189b83e89391ef7950",
    )),
    ("GPL-2.0-only", (
        "5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a",
        "86098a2eb6cf32b7d85f76517aa2010296c2522588f6d7676bde1230c5ac9041",
        "5e9874a182b8e50f136aed39c11d5b872aaa6c94c59b0780c37559869ffd0faa",
        "df788cb41b3e83cdaafe74f124cd141dcaa57276f7f8ac293d5a1b719b0c76d0",
        "a8901fa7f70c505177c46467227846b0e2bc33255941bdf4da5fef35dc577cde",
        "a3db1dc05d3402837c5bc4299347d05289c19dd35d9a83ca860b3ff0ed80139f",
    )),
    ("GPL-3.0-only", (
        "88c8e3c4ca10e9f8a2b9a6f92814755437dfa8ef19b34d25a003d9a098b3c105",
        "f931edefd868cfed47e0f947217d67388e8a7a00ac6c29751339a1c19652313f",
        "ed1c85858baf2b42a8ed0fc28f7a7e9e23af7d85338ae49fcc5b66d156f86489",
        "49bab4a2c679239e4283f3e91ea6c3eade3179d45d6f97bce185182922c45176",
        "535a5e1b60fb9b7dda4c791bf0975f7a869f2c565f038e76b4de46836f2d6082",
        "29951961c20bc75c51a70a6d694657031fa98b63fb17cebfe5b00f5f735549c8",
    )),
    ("LGPL-2.0-only", (
        "82b9c718a1edbbe60a4f5828e6e8c8390d714f09bfee18638761bb3f8fdff504",
        "3bb3f2f987ac797968f7655d8946e3fb45c8ed8e489b8090b8c2957416070991",
        "c2cefe189596f86dbbdab4ca8b161c6262f8b0d574184ce87144b676eb4e7d0a",
        "a0dbd7a102778e66f32a0f3805cc10220072ff7975c4d1ba881af2a986dfc23a",
        "ca00eab94c6a95b58db63d60898bbd353db7f6dd4f9cfe4d1b0c0d8520feaf86",
        "d0b7dbc5dc6107ecdbc79f1564605f1854c72f2ef580f03e3a4c9742496fd53a",
    )),
    ("LGPL-2.1-only", (
        "8972cc10118fe8a142e8b2d34ba122d3a2c710126a256b6786246af9ae4cd5a6",
        "14d2766e74523a520125045c7df201c048aea2169d95faf662634c49a477ae7d",
        "0948f7f91046d0736fbe4b1285c1418c43656d51b8a98c2690fd48e68a51284e",
        "be5c3180540c5ba701a67166afcb0a8fc094b8053a6b4909a80444f63de3cd68",
        "4174784c175d53ad8e74c0a3cc83216891399da1b630e7364934a3c54f9b8089",
        "faf4a75815f3729ef863099d37c5ea709e467d8931198c97938f98bdf876b951",
    )),
    ("LGPL-3.0-only", (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
        "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8",
    )),
    ("MPL-1.1", (
        "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
        "ef0f519d6b36a6ee4471c15afcf2f765321db910ec37142221b6393bee2a1f44",
    )),
    ("MPL-2.0", (
        "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
        "958f21dc8dffc8ff8e2cd52fee0a8a694d6cbc45344ba2aa6e9802e632a8fc03",
    )),
    ("Unlicense", (
        "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",
    )),
)

COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    c = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT, "$1")
    c = F.concat(F.lit(" "), F.regexp_replace(c, SEPARATORS, " "), F.lit(" "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(c, "  +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """``digest, license``: one row per known text (a fixed list)."""
    rows = spark.createDataFrame(list(LICENSES), "license string, body string").select(digest(F.col("body")).alias("digest"), "license")
    full = spark.createDataFrame([(d, name) for name, digests in FULL_TEXTS for d in digests], "digest string, license string")
    return rows.unionByName(full).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, license, notices``, one row per input row.

    license: the known licence that the entire text is, else null. notices: sorted,
    comma-joined licences of the lines that are known notices, '' without any. Null
    and empty texts have the digest of the empty form and match nothing. The broadcast
    side and the collected rows are the fixed list of known licences.
    """
    spark = docs.sparkSession
    ref = known(spark)
    lookup = F.create_map(*[F.lit(x) for row in ref.collect() for x in row])
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.lower(x).contains("licen"))
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", digest(F.col("text")).alias("digest"), F.transform(lines, digest).alias("found"))
    hits = F.transform("found", lambda d: F.try_element_at(lookup, d))
    return (
        base.join(F.broadcast(ref), "digest", "left")
        .select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))), ",").alias("notices"))
    )


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(e: str) -> str:
    c = f"lower(coalesce({e}, ''))"
    c = f"regexp_replace({c}, {_quote(COPYRIGHT)}, '\\1', 'g')"
    c = f"(' ' || regexp_replace({c}, {_quote(SEPARATORS)}, ' ', 'g') || ' ')"
    for a, b in SPELLINGS:
        c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({c}, '  +', ' ', 'g'))"


ORACLE_SQL = f"""
WITH known AS (
  SELECT sha256({_sql_canonical('body')}) AS digest, min(license) AS license
  FROM (VALUES {', '.join(f'({_quote(a)}, {_quote(b)})' for a, b in LICENSES)}) v(license, body) GROUP BY 1
), base AS (SELECT doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), noted AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM (
    SELECT DISTINCT l.doc_id, k.license FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM lines WHERE contains(lower(line), 'licen')) l
    JOIN known k USING (digest)) GROUP BY doc_id
)
SELECT b.doc_id, b.digest, k.license, coalesce(n.notices, '') AS notices
FROM base b LEFT JOIN known k USING (digest) LEFT JOIN noted n ON n.doc_id = b.doc_id
"""
