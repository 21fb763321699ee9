"""License scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, runs of anything but letters and
digits become one blank) and looked up in a table of known licence sentences; what remains of a
document is the sequence of known sentences' identifiers. A rule names a licence by an ordered list
of identifiers; it matches where they follow one another in the sequence with at most a few others
between. Licence texts are both one sentence a line and sentences wrapped over lines, so a document is
read both ways. Built-in expressions only; texts without a word that all known sentences need (a
licence has to use one of a few) skip the search.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Known sentences of public licences, normalised, by identifier. Where a notice has a ":" or
# ";" before white space, its sentence stands here in the parts that sentences_of cuts it into.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-spdx": "spdx license identifier apache 2 0",
    "spdx": "spdx license identifier",
    "spdx-apache": "apache 2 0",
    "spdx-mit": "mit",
    "mit-notice": "released under the mit license",
    "mit-notice2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-spdx": "spdx license identifier mit",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-program": "this program is free software",
    "gpl-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-later3": "either version 3 of the license or at your option any later version",
    "gpl-later2": "either version 2 of the license or at your option any later version",
    "gpl-modify3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-modify2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "licensed under cc0 1 0",
    "gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl-library": "this library is free software",
    "lgpl-modify": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-later21": "either version 2 1 of the license or at your option any later version",
    "lgpl-modify3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-modify": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "agpl-modify3": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-notice": "licensed under the mozilla public license version 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "distributed under the boost software license version 1 0",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl-notice": "licensed under the eclipse public license 2 0",
    "bsd-notice": "licensed under the bsd 3 clause license",
    "bsd-notice2": "licensed under the bsd 2 clause license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-long": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-long": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "spdx-gpl2": "gpl 2 0 only",
    "spdx-gpl2-later": "gpl 2 0 or later",
    "spdx-gpl3": "gpl 3 0 only",
    "spdx-gpl3-later": "gpl 3 0 or later",
    "spdx-lgpl21-later": "lgpl 2 1 or later",
    "spdx-lgpl3-later": "lgpl 3 0 or later",
    "spdx-agpl3": "agpl 3 0 only",
    "spdx-agpl3-later": "agpl 3 0 or later",
    "spdx-bsd3": "bsd 3 clause",
    "spdx-bsd2": "bsd 2 clause",
    "spdx-unlicense": "unlicense",
    "all-rights": "copyright all rights reserved",
    "all-rights-line": "all rights reserved",
}
# The parts into which the GPL's grant and disclaimer are cut, with ":", ";" or "," between them.
_GRANTS = {
    "GPL-3.0-or-later": (("gpl-free",), ("gpl-program", "gpl-modify3"), ("gpl-program", "gpl-modify", "gpl-later3")),
    "GPL-2.0-or-later": (("gpl-free2",), ("gpl-program", "gpl-modify2"), ("gpl-program", "gpl-modify", "gpl-later2")),
}
_DISCLAIMERS = (("gpl-hope",), ("gpl-warranty", "gpl-implied"))
# Licences by ordered sentences; the first rule that matches gives the main licence.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-asis")),
    ("MIT", ("mit-grant", "mit-keep", "mit-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    *((licence, (*grant, *disclaimer, "gpl-see")) for licence, grants in _GRANTS.items() for grant in grants for disclaimer in _DISCLAIMERS),
    ("LGPL-2.1-or-later", ("lgpl-library", "lgpl-modify", "lgpl-later21")),
    ("LGPL-3.0-or-later", ("lgpl-library", "lgpl-modify", "gpl-later3")),
    ("LGPL-3.0-or-later", ("gpl-program", "lgpl-modify3")),
    ("AGPL-3.0-or-later", ("gpl-program", "agpl-modify3")),
    ("AGPL-3.0-or-later", ("gpl-program", "agpl-modify", "gpl-later3")),
    ("GPL-2.0-only", ("gpl-program", "gpl2-only")),
    ("MPL-2.0", ("mpl-form",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant2",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("EPL-2.0", ("epl-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-spdx",)),
    ("Apache-2.0", ("spdx", "spdx-apache")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice2",)),
    ("MIT", ("mit-spdx",)),
    ("MIT", ("spdx", "spdx-mit")),
    ("GPL-2.0-only", ("spdx", "spdx-gpl2")),
    ("GPL-2.0-or-later", ("spdx", "spdx-gpl2-later")),
    ("GPL-3.0-only", ("spdx", "spdx-gpl3")),
    ("GPL-3.0-or-later", ("spdx", "spdx-gpl3-later")),
    ("LGPL-2.1-or-later", ("spdx", "spdx-lgpl21-later")),
    ("LGPL-3.0-or-later", ("spdx", "spdx-lgpl3-later")),
    ("AGPL-3.0-only", ("spdx", "spdx-agpl3")),
    ("AGPL-3.0-or-later", ("spdx", "spdx-agpl3-later")),
    ("BSD-3-Clause", ("spdx", "spdx-bsd3")),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("BSD-2-Clause", ("spdx", "spdx-bsd2")),
    ("BSD-2-Clause", ("bsd-notice2",)),
    ("Unlicense", ("spdx", "spdx-unlicense")),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-long",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("all-rights",)),
    ("all-rights-reserved", ("all-rights-line",)),
)
#: Words of which every known sentence has one, and known sentences that may stand between two of a rule.
ANCHORS = ("licens", "copyright", "warrant", "permission", "redistribut", "reserved", "software", "version", "apache", "mit", "gpl", "bsd")
MOST_BETWEEN = 2


def anchored(sentences: dict[str, str]) -> bool:
    """Whether the anchors find every known sentence."""
    return all(any(a in s for a in ANCHORS) for s in sentences.values())


def normalised(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentences_of(text: Column, wrapped: bool) -> Column:
    """Sentences of a text: cut after ".", "!", "?", ":" or ";" before white space, and at line ends
    (if wrapped, only at empty lines)."""
    ended = F.regexp_replace(text, r"([.!?:;])[\x20\x09-\x0D]+", "$1\u0001")
    return F.split(F.regexp_replace(ended, r"\n[\x20\t\r]*\n" if wrapped else r"\n", "\u0001"), "\u0001")


def identifiers(text: Column, sentences: dict[str, str], wrapped: bool) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[x for name, s in sentences.items() for x in (F.lit(s), F.lit(name))])
    bare = F.transform(sentences_of(text, wrapped), normalised)
    return F.filter(F.transform(bare, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())


def matched(sequences: list[Column], rules) -> Column:
    """Licences whose rule one of the sequences of identifiers holds, each once, in the rules' order."""
    lines = [F.concat(F.lit(" "), F.array_join(s, " "), F.lit(" ")) for s in sequences]
    between = rf"(?:\S+ ){{0,{MOST_BETWEEN}}}"
    holds = lambda ids: reduce(or_, [F.rlike(line, F.lit(" " + f" {between}".join(re.escape(i) for i in ids) + " ")) for line in lines])
    found = [F.when(holds(ids), F.lit(licence)) for licence, ids in rules]
    return F.array_distinct(F.array_compact(F.array(*found)))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses, license) for each row of docs.

    sentence_ids: identifiers in order; licenses: all that some rule matches; license: the first of
    them, null if none. Null, empty and unlicensed texts have empty lists. Narrow: no shuffle.
    """
    sentences = SENTENCES if sentences is None else sentences
    if not anchored(sentences):
        raise ValueError("a known sentence has none of the anchors")
    value = text_of(text)
    hinted = F.rlike(value, F.lit("(?i)" + "|".join(ANCHORS)))
    none = F.array().cast("array<string>")
    read = docs.select(F.col(id_column).alias("doc_id"), F.when(hinted, value).alias("__text"))
    read = read.withColumn("by_line", F.coalesce(identifiers(F.col("__text"), sentences, False), none)).withColumn("wrapped", F.coalesce(identifiers(F.col("__text"), sentences, True), none))
    kept = read.select("doc_id", F.when(F.size("wrapped") > F.size("by_line"), F.col("wrapped")).otherwise(F.col("by_line")).alias("sentence_ids"), "by_line", "wrapped")
    both = kept.withColumn("licenses", F.when((F.size("by_line") == 0) & (F.size("wrapped") == 0), none).otherwise(matched([F.col("by_line"), F.col("wrapped")], rules)))
    return both.select("doc_id", "sentence_ids", "licenses", F.get("licenses", F.lit(0)).alias("license"))
