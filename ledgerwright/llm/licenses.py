"""Licence scans by canonical digest lookup.

A text is brought to a canonical form - lower case, copyright lines gone, punctuation
and layout reduced to single spaces, equivalent spellings made one - and the SHA-256
of the whole form is hash-joined with the digests of known licences and notices. The
units looked up are the document as a whole and each of its lines: a licence is
found where it is the entire unit, never as a part of one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

# Spellings taken as equal (from, to), applied to whole words in this order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("copyright holder s", "copyright holders"),
    ("owner s", "owners"), ("noninfringement", "non infringement"), ("v2", "version 2"), ("v3", "version 3"), ("https", "http"),
)

_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
    'in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT '
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)

# Known texts by SPDX id. Longer ones belong into a table of the user's own (see known_digests).
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License " + _ISC),
    ("BSD-2-Clause", " ".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_END))),
    ("BSD-3-Clause", " ".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END))),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

#: Rows of known digests that are broadcast; about 100 bytes each.
BROADCAST_ROWS = 50_000

#: A copyright line, in lower case, and the reservation of rights that goes with one.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^a-z\n]*(\(c\)|©|[0-9]{4}|by )[^\n]*$|all rights reserved"
_COPYRIGHT = re.compile(COPYRIGHT)
#: What a match of COPYRIGHT must contain: texts without any of it skip the pattern.
_MARKS = (b"copyright", b"(c)", "©".encode(), b"all rights reserved")
#: A spelling shrinks a text to this share at most, so a form longer than a known one by more cannot become it.
_SHRINK = min(len(new) / len(old) for old, new in SPELLINGS)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_SPELLINGS = [(f" {old} ".encode(), f" {new} ".encode()) for old, new in SPELLINGS]
_SPELT = frozenset(old.split()[0].encode() for old, _ in SPELLINGS)


def canonical(text: str, longest: float = float("inf")) -> bytes | None:
    """The canonical form of a text: words of a-z, 0-9 and non-ASCII characters with single spaces between.

    A form that cannot end up at most `longest` bytes long is given up as None.
    """
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if any(m in low for m in _MARKS):
        low = _COPYRIGHT.sub(" ", low.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
    words = low.translate(_WORDS).split()
    form = b" ".join(words)
    if len(form) * _SHRINK > longest:
        return None
    if not _SPELT.isdisjoint(words):
        form = b" " + form + b" "
        for old, new in _SPELLINGS:
            form = form.replace(old, new)
        form = form.strip()
    return form


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(license, digest, size) of KNOWN and of texts(license string, text string), one row per digest."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t or "") for t in batch.column("text").to_pylist()]
            some = [i for i, f in enumerate(forms) if f]
            yield pa.RecordBatch.from_pydict(
                {
                    "license": batch.column("license").take(pa.array(some, pa.int64())),
                    "digest": pa.array([hashlib.sha256(forms[i]).hexdigest() for i in some], pa.string()),
                    "size": pa.array([len(forms[i]) for i in some], pa.int64()),
                }
            )

    own = spark.createDataFrame(list(KNOWN), "license string, text string")
    every = own if texts is None else own.unionByName(texts.select("license", "text"))
    return every.mapInArrow(digest, "license string, digest string, size long").groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per key of docs: key, whole_license, n_license_lines, licenses.

    whole_license is the licence whose canonical text the whole document is, or
    null. n_license_lines counts lines that are a known licence or notice;
    licenses lists the distinct ids of both, sorted, with commas (empty: none).
    Null and empty texts, and units without a word, have none. Rows with the same
    key (null is a key) are one document. A digest that two licences share counts
    as the first. known has (license, digest, size); up to BROADCAST_ROWS of it are
    broadcast, larger tables are joined by a shuffle. No rows give no rows.
    """
    table = known if known is not None else known_digests(docs.sparkSession)
    known_rows, longest = table.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    lookup = table.drop("size")
    kind = docs.schema[key].dataType.simpleString()

    def units(batch: pa.RecordBatch, texts: list) -> dict:
        owner, whole, digests = [], [], []
        for i, t in enumerate(texts):
            if t:
                for full, unit in ((True, t), *((False, x) for x in t.split("\n"))):
                    if form := canonical(unit, longest):
                        owner.append(i)
                        whole.append(full)
                        digests.append(hashlib.sha256(form).digest())
        return {"__key": batch.column(key).take(pa.array(owner, pa.int64())), "whole": pa.array(whole, pa.bool_()), "digest": pa.array(digests, pa.binary())}

    digests = map_texts(docs.select(key, text), text, units, f"__key {kind}, whole boolean, digest binary")
    lookup = lookup.withColumn("digest", F.unhex("digest"))
    lookup = F.broadcast(lookup) if known_rows <= BROADCAST_ROWS else lookup
    found = digests.join(lookup, "digest").groupBy("__key").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.count(F.when(~F.col("whole"), True)).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    keys = docs.select(F.col(f"`{key}`").alias("__id")).distinct()
    return keys.join(found, F.col("__id").eqNullSafe(F.col("__key")), "left").select(
        F.col("__id").alias(key), "whole_license", F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), F.coalesce("licenses", F.lit("")).alias("licenses")
    )
