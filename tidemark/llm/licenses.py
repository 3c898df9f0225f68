"""Licence scans by sentence rules.

A text is cut into sentences, each sentence normalised (lower case, runs of other characters than
ASCII letters and digits as one blank), and looked up among known licence sentences. A sentence is
one line, or else several adjoining ones: a newline, with any comment signs, then counts as a blank,
but a line without letters and digits ends the sentence. The known
identifiers of a document, in order, are then matched against ordered rules: an earlier rule takes
its identifiers before a later one can.

All of it is one projection, with no shuffle. Texts without any word that every known sentence
has one of are passed over before they are cut.

Defined cases: a null text has no sentence; a sentence that occurs again is matched again, and a
licence found again is listed once; repeated rows are scanned alike; an empty table gives no rows;
further columns are kept, except that the result columns replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised, by identifier.
SENTENCES = {
    "ApacheGrant": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0"],
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "ApacheUrl": ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"],
    "ApacheBasis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitName": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license", "mit license", "the mit license mit"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitAsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MitLiability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "BsdIntro": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdName": ["licensed under the bsd license", "released under the bsd license"],
    "Bsd2Name": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "Bsd3Name": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "Gpl3Name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu gpl v3", "released under the gnu general public license version 3"],
    "Gpl2Name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "licensed under the gnu gpl v2", "released under the gnu general public license version 2"],
    "GplFree3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GplFree2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GplWarranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GplSee": ["see the gnu general public license for more details"],
    "LgplName": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "AgplName": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "Mpl2": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "CcByNc": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CcByNcSa": ["licensed under cc by nc sa 4 0", "this work is licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "CcByNd": ["licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"],
    "CcBySa": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CcBy": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "Cc0": ["licensed under cc0 1 0", "released under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0 and needs no license"],
    "Unlicense": ["this is free and unencumbered software released into the public domain under the unlicense license"],
    "AllRights": ["copyright all rights reserved", "all rights reserved without license"],
}
# The order of the rules; sequences come before the single sentences that they contain.
RULES = [
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheUrl", "ApacheBasis", "ApacheSee"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("Apache-2.0", ["ApacheGrant"]),
    ("MIT", ["MitName", "MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitName"]),
    ("BSD-3-Clause", ["BsdIntro", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdIntro", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["Bsd3Name"]),
    ("BSD-2-Clause", ["Bsd2Name"]),
    ("BSD", ["BsdName"]),
    ("GPL-3.0-or-later", ["GplFree3", "GplWarranty", "GplSee"]),
    ("GPL-2.0-or-later", ["GplFree2", "GplWarranty", "GplSee"]),
    ("GPL-3.0-or-later", ["GplFree3"]),
    ("GPL-2.0-or-later", ["GplFree2"]),
    ("AGPL-3.0-only", ["AgplName"]),
    ("LGPL-3.0-only", ["LgplName"]),
    ("GPL-3.0-only", ["Gpl3Name"]),
    ("GPL-2.0-only", ["Gpl2Name"]),
    ("MPL-2.0", ["Mpl2"]),
    ("ISC", ["IscGrant"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-ND-4.0", ["CcByNd"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("CC0-1.0", ["Cc0"]),
    ("Unlicense", ["Unlicense"]),
    ("Proprietary", ["AllRights"]),
]
# Each known sentence has one of these words.
ANCHORS = ["license", "licensed", "copyright", "warranty", "cc0", "redistribution"]

END = "[.!?;:]+(?:[ \\t\\r\\n\\f]+|\\z)"
#: What stands between sentences, and between lines of a sentence.
CUT, WRAP = "\u001f", "\u001e"


def known() -> dict[str, str]:
    """Identifier by normalised sentence."""
    return {s: k for k, all_of in SENTENCES.items() for s in all_of}


def _pattern() -> str:
    """Known sentences between cuts or wraps: those on one line first, then those over several, longer ones before shorter."""
    longest = sorted(known(), key=lambda x: (-len(x), x))
    both = longest + [x.replace(" ", f"[ {WRAP}]") for x in longest]
    return f"(?<![a-z0-9 ])(?:{'|'.join(both)})(?![a-z0-9 ])"


def _identifiers(text: Column) -> Column:
    """The known identifiers in order, each in angle brackets, as one string."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), END, CUT), "\\n", WRAP)
    clean = F.regexp_replace(F.regexp_replace(marked, f"[^a-z0-9{WRAP}{CUT}]+", " "), f" *([{WRAP}{CUT}]) *", "$1")
    clean = F.trim(F.regexp_replace(clean, f"{WRAP}{{2,}}", CUT))
    found = F.regexp_extract_all(clean, F.lit(_pattern()), F.lit(0))
    return F.array_join(F.transform(found, lambda s: F.concat(F.lit("<"), F.try_element_at(table, F.translate(s, WRAP, " ")), F.lit(">"))), "")


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with licenses (array, in order of first match), n_sentences and n_unmatched."""
    rest = docs.drop("licenses", "n_sentences", "n_unmatched")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    likely = F.lower(text).rlike("|".join(ANCHORS))
    out = rest.select(F.struct("*").alias("__row"), F.when(likely, _identifiers(text)).otherwise(F.lit("")).alias("__ids"))
    matched = F.col("__ids")
    for name, sequence in RULES:
        matched = F.regexp_replace(matched, "".join(f"<{k}>" for k in sequence), f"{{{name}}}")
    out = out.withColumn("__matched", F.when(F.col("__ids") == "", F.lit("")).otherwise(matched))
    return out.select(
        "__row.*",
        F.array_distinct(F.regexp_extract_all("__matched", F.lit("\\{([^}]*)\\}"), 1)).alias("licenses"),
        F.regexp_count("__ids", F.lit("<")).cast("long").alias("n_sentences"),
        F.regexp_count("__matched", F.lit("<")).cast("long").alias("n_unmatched"),
    )


def oracle() -> str:
    """DuckDB SQL for doc_id, licenses (joined by commas), n_sentences and n_unmatched of ``documents``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    entries = ", ".join(f"({quoted(s)}, {quoted(k)})" for s, k in known().items())
    matched = "ids"
    for name, sequence in RULES:
        matched = f"replace({matched}, {quoted(''.join(f'<{k}>' for k in sequence))}, {quoted('{' + name + '}')})"
    return f"""
WITH table_of(sentence, id) AS (VALUES {entries}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, unnest(string_split(regexp_replace(text, '[.!?;:]+(?:[ \\t\\r\\n\\f]+|\\z)|\\n+', chr(31), 'g'), chr(31))) AS s, generate_subscripts(string_split(regexp_replace(text, '[.!?;:]+(?:[ \\t\\r\\n\\f]+|\\z)|\\n+', chr(31), 'g'), chr(31)), 1) AS k FROM docs),
hits AS (SELECT r, k, id FROM parts JOIN table_of ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence),
ids AS (SELECT r, string_agg('<' || id || '>', '' ORDER BY k) AS ids FROM hits GROUP BY r),
done AS (SELECT doc_id, coalesce(ids, '') AS ids, {matched} AS m FROM docs LEFT JOIN ids USING (r)),
named AS (SELECT doc_id, ids, coalesce(m, '') AS m, regexp_extract_all(coalesce(m, ''), '\\{{([^}}]*)\\}}', 1) AS l FROM done)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS licenses,
  CAST(length(ids) - length(replace(ids, '<', '')) AS BIGINT) AS n_sentences,
  CAST(length(m) - length(replace(m, '<', '')) AS BIGINT) AS n_unmatched
FROM named"""
