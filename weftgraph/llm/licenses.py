"""License scans by sentence rules, in DataFrame functions only.

A text is cut into pieces at line ends and sentence ends; a known licence sentence is found where it is one piece or, wrapped, several
that follow each other; the identifiers found, in order, are matched against ordered rules: earlier rules take their identifiers first,
what is left goes to later ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised: lower case, runs of other than letters, digits and dots as one space, no dots or spaces at the ends.
SENTENCES = {
    "apache2-by": "licensed under the apache license version 2.0",
    "apache2-may-not": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "mit-by": "released under the mit license",
    "mit-is": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind",
    "gpl3-by": "this work is licensed under the gnu general public license version 3",
    "gpl2-by": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-by": "this library is licensed under the gnu lesser general public license",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc0": "to the extent possible under law the author has waived all copyright to this work",
    "public-domain": "this work is released into the public domain",
    "reserved": "all rights reserved",
}

_GPL = "is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license"
_MIT = "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_AS_IS = "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"

#: The whole sentences of the usual notices, normalised, where SENTENCES has their first words; the SQL doesn't know them.
NOTICES = {
    "licensed under the apache license version 2.0 the license": "apache2-by",
    "the asf licenses this file to you under the apache license version 2.0 the license": "apache2-by",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apache2-copy",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "apache2-copy",
    f"{SENTENCES['mit-grant']} {_MIT}": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    f"{SENTENCES['as-is']} {_AS_IS} and noninfringement": "as-is",
    f"{SENTENCES['as-is']} {_AS_IS} and non infringement": "as-is",
    f"{SENTENCES['as-is']} {_AS_IS} title and non infringement": "as-is",
} | {f"this {what} {_GPL.format(kind, v)}{more}": name for name, kind, whats, versions in (("gpl-free", "general", ("program", "file", "software", "library"), ("2", "3")), ("lgpl-by", "lesser general", ("library", "program", "file", "software"), ("2.1", "3"))) for what in whats for v in versions for more in ("", " or at your option any later version")}

#: Where a sentence can't go on: sentence ends but those of abbreviations, and lines without a word (comment signs may stand there).
_ABBREVIATED = r"\b(?i:v|inc|ltd|co|corp)"
_HARD = rf"(?<!{_ABBREVIATED})[.!?][ \t\r\n]+|\n(?:[\s\p{{P}}\p{{S}}&&[^\n]]*\n)+"
#: Where it can begin or end besides, as at line ends: semicolons, abbreviations.
_SOFT = rf";[ \t\r\n]+|(?<={_ABBREVIATED})[.!?][ \t\r\n]+"
#: Signs of comments that are words.
_REM = r"(?m)^[ \t]*(?:@?rem|REM|dnl)(?=[ \t\r\n])"
#: Normalised holders' names in the BSD licence, in place of "the copyright holder".
_HOLDER = r"neither[ \n]the[ \n]name[ \n]of[ \n]\S+(?:[ \n]\S+){0,15}?[ \n]nor[ \n]the[ \n]names[ \n]of[ \n](?:its|their)[ \n]contributors"

#: Licence and its sentences in order; tried from first to last.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-terms", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-terms"]),
    ("Apache-2.0", ["apache2-by", "apache2-may-not", "apache2-copy"]),
    ("Apache-2.0", ["apache2-by"]),
    ("GPL-3.0", ["gpl3-by"]),
    ("GPL-2.0", ["gpl2-by"]),
    ("GPL", ["gpl-free"]),
    ("LGPL", ["lgpl-by"]),
    ("MIT", ["mit-by"]),
    ("MIT", ["mit-is"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("Public-Domain", ["public-domain"]),
    ("Proprietary", ["reserved"]),
]

#: Each sentence above has one of these, so others need no normalising. With a sentence that has none, all are normalised.
CUES = "licen|copy|permi|warrant|redistribut|domain|rights"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(id_col, sentence_ids, licenses, n_sentences, n_unruled) for each row of `docs`.

    Sentences end at line ends and at . ! ? ; before white space. One can go on over line ends and ; but not over lines without a word
    or the end of another. sentence_ids: the known ones in order, comma-joined; licenses: those of the rules that match, in the order
    of the text, each once, comma-joined (empty if none); n_unruled: known sentences that no rule took. Unknown sentences between
    known ones don't part a rule's sequence. Own `sentences` take the place of NOTICES too.

    - A null or empty text has no sentences. Texts are scanned whole; a sentence that repeats counts each time.
    - Null and repeated ids and rows are kept, each row by itself. Columns other than the two named don't matter. No rows give none.
    """
    known, rules = {s: name for name, s in (sentences or SENTENCES).items()} | ({} if sentences else NOTICES), rules or RULES
    # words in turn, each gap a space or a line end; the longest sentence first
    found = "|".join(r"\.?[ \n]".join(re.escape(w.rstrip(".")) for w in s.split()) for s in sorted(known, key=len, reverse=True))
    out = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = out.withColumn("_parts", F.split(F.regexp_replace("_text", _REM, ""), _HARD))
    cued = F.filter("_parts", lambda s: F.lower(s).rlike(CUES)) if all(re.search(CUES, s) for s in known) else F.col("_parts")
    out = out.withColumn("_cued", cued)

    def plain(s):
        s = F.regexp_replace(F.lower(F.regexp_replace(s, _SOFT, "\n")), r"[^a-z0-9.\n]+", " ")
        s = F.trim(F.regexp_replace(s, r"[ .]*\n[ .\n]*", "\n"), F.lit(" .\n"))
        return s if sentences else F.regexp_replace(s, _HOLDER, "neither the name of the copyright holder nor the names of its contributors")

    out = out.withColumn("_plain", F.transform("_cued", plain))
    out = out.withColumn("_known", F.flatten(F.transform("_plain", lambda s: F.regexp_extract_all(s, F.lit(rf"(?:^|(?<=\n))(?:{found})(?=\n|\z)"), F.lit(0)))))
    # the words alone, as the sentences' own dots at ends of words can stand at line ends
    bare = F.create_map(*[F.lit(x) for s, name in known.items() for x in (re.sub(r"\.(?= )", "", s), name)])
    out = out.withColumn("_ids", F.transform("_known", lambda s: F.element_at(bare, F.regexp_replace(s, r"\.?[ \n]", " "))))
    text = F.array_join(F.transform("_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    for name, own in rules:
        text = F.replace(text, F.lit("".join(f"<{s}>" for s in own)), F.lit(f"[{name}]"))
    out = out.withColumn("_ruled", text)
    left = F.size(F.regexp_extract_all("_ruled", F.lit(r"<[^>]*>"), 0)).cast("long")
    found = F.array_join(F.array_distinct(F.regexp_extract_all("_ruled", F.lit(r"\[([^\]]*)\]"), 1)), ",")
    return out.select(id_col, F.array_join("_ids", ",").alias("sentence_ids"), found.alias("licenses"), F.size("_ids").cast("long").alias("n_sentences"), left.alias("n_unruled"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    values = ", ".join(f"('{s}', '{name}')" for name, s in SENTENCES.items())
    ruled = "ids"
    for name, own in RULES:
        ruled = f"replace({ruled}, '{''.join(f'<{s}>' for s in own)}', '[{name}]')"
    return rf"""
WITH k(s, name) AS (VALUES {values}),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10))) AS s,
             unnest(range(len(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10))))) AS i FROM documents),
n AS (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), ' .') AS s FROM p),
f AS (SELECT doc_id, string_agg(name, ',' ORDER BY i) AS sentence_ids, string_agg('<' || name || '>', '' ORDER BY i) AS ids, count(*) AS c FROM n JOIN k USING (s) GROUP BY doc_id),
r AS (SELECT doc_id, sentence_ids, c, {ruled} AS ruled FROM f),
g AS (SELECT doc_id, sentence_ids, c, regexp_extract_all(ruled, '\[([^\]]*)\]', 1) AS l, len(regexp_extract_all(ruled, '<[^>]*>')) AS u FROM r)
SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS licenses,
       CAST(coalesce(c, 0) AS BIGINT) AS n_sentences, CAST(coalesce(u, 0) AS BIGINT) AS n_unruled
FROM documents d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
