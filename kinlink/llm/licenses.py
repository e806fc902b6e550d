"""License scans by canonical digests; DataFrame functions only.

A text is brought to a canonical form (letter case, punctuation, copyright lines, equivalent
spellings), and the digest of the whole form is joined with the digests of known licences.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name a holder: they begin with a copyright mark and have a year, a sign or "by" (fixed patterns). A line
#: of running text that happens to begin with the word, as in wrapped licences, has none of these.
COPYRIGHT = (
    r"(?m)^[ \t#/*;%.-]*(?:(?:copyright|\(c\)|©)[^\n]*(?:(?:19|20)[0-9][0-9]|\(c\)|©|<year>|\[year\]|\[yyyy\])[^\n]*"
    r"|(?:\(c\)|©)[^\n]*|copyright by [^\n]*|all rights reserved[.]?[ \t\r]*)$"
)
#: Spellings that count as one (fixed values).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("organisations", "organizations"), ("favour", "favor"), ("honour", "honor"), ("acknowledgement", "acknowledgment"), ("initialise", "initialize"),
    ("authorised", "authorized"), ("recognised", "recognized"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"), ("whilst", "while"), ("owner", "holder"), ("owners", "holders"), ("https", "http"),
)
#: A word that has another spelling.
VARIANT = r"(?:^| )(?:" + "|".join(a for a, _ in SPELLINGS) + r")(?: |$)"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_TWO = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{BSD_DISCLAIMER}"""
BSD_THREE = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{BSD_DISCLAIMER}"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Known licences; the title before a text is known too.
KNOWN = (
    ("MIT", MIT), ("MIT", f"MIT License\n{MIT}"), ("MIT", f"The MIT License (MIT)\n{MIT}"), ("MIT", f"The MIT License\n{MIT}"),
    ("ISC", ISC), ("ISC", f"ISC License\n{ISC}"), ("0BSD", ZERO_BSD), ("0BSD", f"BSD Zero Clause License\n{ZERO_BSD}"),
    ("BSD-2-Clause", BSD_TWO), ("BSD-2-Clause", f"BSD 2-Clause License\n{BSD_TWO}"), ("BSD-3-Clause", BSD_THREE), ("BSD-3-Clause", f"BSD 3-Clause License\n{BSD_THREE}"),
    ("Zlib", ZLIB), ("Zlib", f"zlib License\n{ZLIB}"), ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
)
#: Digests of the canonical forms of long public licence texts as they are published (fixed values).
DIGESTS = (
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Artistic-1.0", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, words of letters and digits joined by one space, spellings unified."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    out = F.btrim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    # one pass over the words, and only of texts that have one to change
    table = F.create_map(*(F.lit(x) for pair in SPELLINGS for x in pair))
    words = F.transform(F.split(out, " "), lambda w: F.coalesce(F.element_at(table, w), w))
    return F.when(out.rlike(VARIANT), F.array_join(words, " ")).otherwise(out)


def digest_of(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the known licences, one row for each digest; ``known``: more of them as (license, text)."""
    table = spark.createDataFrame(list(KNOWN), "license string, text string")
    table = table if known is None else table.unionByName(known.select("license", "text"))
    digests = table.select(digest_of(F.col("text")).alias("digest"), "license").unionByName(spark.createDataFrame([(d, x) for x, d in DIGESTS], "digest string, license string"))
    nothing = hashlib.sha256(b"").hexdigest()
    return digests.filter(F.col("digest") != nothing).groupBy("digest").agg(F.min("license").alias("license"))


#: Rows of known digests that are broadcast at most; a larger table is joined by digest.
MOST_KNOWN = 100_000


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """id, digest of the canonical form, and the licence whose whole text it is, else null.

    Entire texts are looked up; a document that only holds a notice among other text is none. ``known``
    adds licences as rows (license, text) to the built-in ones. Null texts count as empty; a text that is
    empty after canonicalisation is no licence. Repeated rows stay; other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col), digest_of(F.col(text_col)).alias("digest"))
    table = known_digests(docs.sparkSession, known)
    if known is None or table.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN:
        table = F.broadcast(table)
    return rows.join(table, "digest", "left").select(id_col, "digest", "license")


def sql(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    spelled = "map {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS) + "}"

    def form(text: str) -> str:
        plain = f"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        return f"sha256(array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce({spelled}[w], w)), ' '))"

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    digests = ", ".join(f"({quoted(b)}, {quoted(a)})" for a, b in DIGESTS)
    return (
        f"WITH k AS (SELECT digest, min(license) AS license FROM (SELECT {form('text')} AS digest, license FROM (VALUES {values}) AS v(license, text) UNION ALL SELECT * FROM (VALUES {digests}) AS w(digest, license)) "
        f"WHERE digest <> sha256('') GROUP BY 1), d AS (SELECT doc_id, {form('text')} AS digest FROM {table}) SELECT doc_id, d.digest, license FROM d LEFT JOIN k USING (digest)"
    )
