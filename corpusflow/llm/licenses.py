"""Licence scans by canonical digest lookup; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts, and one-line notices that stand for a licence when they are a whole text.
KNOWN = {
    "MIT": [f"""MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}""", "Released under the MIT License.", "Licensed under the MIT License."],
    "ISC": [f"""ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

{_ISC}"""],
    "0BSD": [f"""BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{_ISC}"""],
    "BSD-2-Clause": [f"BSD 2-Clause License\n\n{_BSD}\n{_BSD_END}"],
    "BSD-3-Clause": [f"BSD 3-Clause License\n\n{_BSD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_END}"],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
}

#: Digests of entire texts, as Debian ships them in /usr/share/common-licenses (BSD: the Regents' text).
WHOLE = {
    "Apache-2.0": "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100",
    "Artistic-1.0-Perl": "ddb49d591ecc4f65a223b9f53f330918100c323532a653c090d21b38e35a3a42",
    "BSD-3-Clause": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f",
    "GFDL-1.3": "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480",
    "GPL-1.0": "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",
    "GPL-2.0": "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
    "GPL-3.0": "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349",
    "LGPL-2.0": "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c",
    "LGPL-2.1": "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}

#: Words that licence guidelines treat as the same.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments",
    "analogue": "analog", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled", "catalogue": "catalog", "centre": "center",
    "favour": "favor", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "modelled": "modeled", "optimise": "optimize", "organisation": "organization", "organisations": "organizations", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}
#: A line that only says who holds the rights, in lower case.
HOLDER = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{ab}\x{bb}\x{2010}-\x{2027}]+"


#: All that PUNCTUATION leaves.
KEPT = r"0-9a-z\x{80}-\x{9f}\x{a1}-\x{aa}\x{ac}-\x{ba}\x{bc}-\x{200f}\x{2028}-\x{10ffff}"
#: A word of SPELLINGS, looked for by its first letter.
SPELT = " (?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in SPELLINGS if w[0] == c)})" for c in sorted({w[0] for w in SPELLINGS})) + ") "


def canonical(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, canonical) of rows(columns, text): lower case, without holder lines, words set apart by one
    blank, spellings made equal. Each step is a projection of its own, so none is worked out twice; a text is
    searched once for words that have another spelling, and only one that has some is rewritten."""
    low = rows.select(*columns, F.lower("text").alias("low"))
    held = F.greatest(*[F.col("low").contains(x) for x in ("copyright", "(c)", "©", "all rights reserved")])
    bare = F.when(held, F.regexp_replace("low", HOLDER, "\n")).otherwise(F.col("low"))
    words = low.select(*columns, F.concat(F.lit(" "), F.regexp_replace(bare, f"[^{KEPT}]+", " "), F.lit(" ")).alias("words"))
    settled = F.replace("words", F.lit(" "), F.lit("  "))
    for a, b in SPELLINGS.items():
        settled = F.replace(settled, F.lit(f" {a} "), F.lit(f" {b} "))
    return words.select(*columns, F.trim(F.when(F.col("words").rlike(SPELT), F.regexp_replace(settled, " +", " ")).otherwise(F.col("words"))).alias("canonical"))


def digests(rows: DataFrame, *columns: str) -> DataFrame:
    return canonical(rows, *columns).select(*columns, F.sha2("canonical", 256).alias("digest"))


def known_digests(spark: SparkSession, known: dict[str, list[str]]) -> DataFrame:
    rows = [(name, text) for name, texts in known.items() for text in texts]
    table = digests(spark.createDataFrame(rows, "license_id string, text string"), "license_id")
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, digest, license_id, is_license) for every row of docs(doc_id, text): the licence whose
    canonical text the whole text is, else null. Without `known`, the texts of KNOWN and WHOLE count.

    A null text has a null digest; a text without words (also one of holder lines only) has the digest
    of the empty string and is no licence. Of two licences with one canonical text the first name
    counts. Repeated rows and ids are each answered; other columns are not carried. The table of known
    digests is a constant of the program, so it may be broadcast.
    """
    table = known_digests(docs.sparkSession, KNOWN if known is None else known)
    if known is None:
        whole = docs.sparkSession.createDataFrame([(d, name) for name, d in WHOLE.items()], table.schema)
        table = table.unionByName(whole).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    table = table.where(F.col("digest") != F.sha2(F.lit(""), 256))
    rows = digests(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id")
    return rows.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    e = f"'  ' || regexp_replace(regexp_replace(lower(text), {quoted(HOLDER)}, chr(10), 'g'), {quoted(PUNCTUATION)}, '  ', 'g') || '  '"
    for a, b in SPELLINGS.items():
        e = f"replace({e}, ' {a} ', ' {b} ')"
    e = f"sha256(trim(regexp_replace({e}, ' +', ' ', 'g')))"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in KNOWN.items() for text in texts)
    return f"""
WITH known AS (SELECT {e} AS digest, min(name) AS license_id FROM (VALUES {rows}) t(name, text) GROUP BY 1),
d AS (SELECT doc_id, {e} AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license_id, k.license_id IS NOT NULL AS is_license
FROM d LEFT JOIN known k ON d.digest = k.digest AND k.digest <> sha256('')"""


SQL = {"op9_license_scan": _sql()}
QUERIES = {"op9_license_scan": op9_license_scan}
