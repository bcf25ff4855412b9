"""License scans by sentence rules.

Texts are cut into sentences, sentences are normalised and mapped to identifiers of known
licence sentences, and the sequence of identifiers is matched against ordered rules. The
first rule that finds its sequence takes it out; the next rules see what is left. A
sentence is found on lines of its own, on part of a line after and before other sentences,
and wrapped over several lines, in comments too.

Native: one narrow pass of DataFrame functions, no shuffle; the dictionary and the rules
are fixed literals of the plan.

Defined results: null and empty texts, and texts without a known sentence, have no
identifiers and no licences. A rule found several times is named once. Equal texts get
equal answers. Extra columns are ignored.
"""

from __future__ import annotations

import collections
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Sentences of public licences, already normalised, by identifier.
SENTENCES = {
    "apache-2.0-notice": "licensed under the apache license version 2.0",
    "apache-2.0-notice-the": 'licensed under the apache license version 2.0 the license',
    "apache-2.0-comply": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    "apache-2.0-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-title": "apache license version 2.0 january 2004",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-title-both": "the mit license mit",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope-useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-hope-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "program-free": "this program is free software",
    "library-free": "this library is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "either-2": "either version 2 of the license or at your option any later version",
    "either-2.1": "either version 2.1 of the license or at your option any later version",
    "lgpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-3-free-library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope-useful": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-2.1-title": "gnu lesser general public license version 2.1 february 1999",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-title": "gnu affero general public license version 3 19 november 2007",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as-is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-claim": "you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "bsl-1.0-title": "boost software license - version 1.0 - august 17th 2003",
    "bsl-1.0-notice": "distributed under the boost software license version 1.0",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0",
    "epl-2.0-title": "eclipse public license - v 2.0",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc-by-4.0-notice": "licensed under cc by 4.0",
    "cc-by-sa-4.0-notice": "licensed under cc by-sa 4.0",
    "cc-by-nc-4.0-notice": "licensed under cc by-nc 4.0",
    "cc-by-nd-4.0-notice": "licensed under cc by-nd 4.0",
    "cc-by-4.0-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl-2.0-title": "mozilla public license version 2.0",
    "mpl-2.0-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved under copyright",
}
# Rules in the order in which they are tried: licence, sequence of sentences.
RULES = (
    ("Apache-2.0", ("apache-2.0-notice-the", "apache-2.0-comply", "apache-2.0-copy", "apache-2.0-basis")),
    ("Apache-2.0", ("apache-2.0-notice-the", "apache-2.0-comply", "apache-2.0-copy")),
    ("Apache-2.0", ("apache-2.0-notice-the", "apache-2.0-comply")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("Apache-2.0", ("apache-2.0-notice-the",)),
    ("Apache-2.0", ("apache-2.0-title",)),
    ("MIT", ("mit-notice", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-the",)),
    ("MIT", ("mit-title-both",)),
    ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope-useful", "gpl-hope-implied")),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("AGPL-3.0", ("agpl-3-title",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free", "gpl-hope-useful", "gpl-hope-implied")),
    ("LGPL-3.0-or-later", ("lgpl-3-free-library", "lgpl-hope-useful", "gpl-hope-implied")),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free-library",)),
    ("LGPL-3.0", ("lgpl-3-title",)),
    ("LGPL-2.1-or-later", ("library-free", "lgpl-terms", "either-2.1", "lgpl-hope-useful", "gpl-hope-implied")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "either-2.1")),
    ("LGPL-2.1", ("lgpl-2.1-title",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope-useful", "gpl-hope-implied")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("program-free", "gpl-terms", "either-2", "gpl-hope-useful", "gpl-hope-implied")),
    ("GPL-2.0-or-later", ("gpl-terms", "either-2")),
    ("GPL-3.0", ("gpl-3-title",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("GPL-3.0-only", ("gpl-3-notice",)),
    ("GPL-2.0-only", ("gpl-2-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-Source-Code", ("bsd-grant", "bsd-source")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-claim", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("bsl-1.0-title",)),
    ("BSL-1.0", ("bsl-1.0-notice",)),
    ("EPL-2.0", ("epl-2.0-notice",)),
    ("EPL-2.0", ("epl-2.0-title",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-notice",)),
    ("CC-BY-4.0", ("cc-by-4.0-notice",)),
    ("CC-BY-4.0", ("cc-by-4.0-work",)),
    ("MPL-2.0", ("mpl-2.0-notice", "mpl-2.0-copy")),
    ("MPL-2.0", ("mpl-2.0-notice",)),
    ("MPL-2.0", ("mpl-2.0-title",)),
    ("Unlicense", ("unlicense-domain",)),
    ("Proprietary", ("all-rights",)),
)
# One line names a licence by its identifier: a sentence and a rule for each of these and of those above.
OTHER_LICENCES = ("GPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "EPL-1.0", "CDDL-1.0", "Artistic-2.0")
for _name in sorted({name for name, _ in RULES} - {"Proprietary"} | set(OTHER_LICENCES)):
    SENTENCES[f"spdx-{_name.lower()}"] = f"spdx-license-identifier {_name.lower()}"
    RULES += ((_name, (f"spdx-{_name.lower()}",)),)


def gate(sentences: list[str]) -> list[str]:
    """A few words of which every sentence holds one, the most frequent first: other texts are not cut."""
    left = [set(re.findall("[a-z0-9]{7,}", s)) for s in sentences]
    found = []
    while left:
        counts = collections.Counter(w for words in left for w in words)
        found.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [words for words in left if found[-1] not in words]
    return found


#: Sentences end at . ! ? ; before white space or the end.
SENTENCE_END = r"[.!?;]+([\x20\x09-\x0D]|\z)"
#: The same, but for the dot of a version: v. 2.0
END = r"(?!(?<=\bv)\.[\x20\x09-\x0D]+[0-9])" + SENTENCE_END
#: What stands before the words of a line: comment signs, dashes, quotes.
LEADER = r"(^|\n)[^a-z0-9\n]+"
#: Numbers of list items at the start of a line, as left by LEADER.
ITEM = r"(^|\n)([0-9]{1,2}|[ivx]{1,4}|[a-z])\)"


def marked(text: Column) -> Column:
    """Lower case words with single spaces, L for line breaks and S for ends of sentences.

    Runs of anything but letters, digits, dots and hyphens are one space; capitals are free
    for the marks.
    """
    out = F.regexp_replace(F.regexp_replace(F.lower(text), LEADER, "$1"), ITEM, "$1S")
    out = F.regexp_replace(F.regexp_replace(out, END, "S"), r"[^a-z0-9.\nS-]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "L")
    return F.trim(F.regexp_replace(out, "[ SL]*S[ SL]*", "S"))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence begins and ends at a mark or an end of the text; its words can be wrapped over any lines.
    """
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (s, name)))
    # the longest first, as one sentence may be the first lines of another
    words = (s.replace(".", r"\.").replace(" ", "[ L]") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    pattern = F.lit("(?<![^SL])(?:" + "|".join(words) + ")(?![^SL])")
    each = F.regexp_extract_all(marked(text), pattern, F.lit(0))
    found = F.transform(each, lambda s: F.element_at(known, F.replace(s, F.lit("L"), F.lit(" "))))
    has = F.coalesce(F.rlike(F.lower(text), F.lit("|".join(gate(list(SENTENCES.values()))))), F.lit(False))
    return F.when(has, found).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column) -> Column:
    """Licences of the rules that find their sequence, in order of the rules."""
    rules = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(seq) + "|").alias("seq"))
            for name, seq in RULES
        )
    )
    # each identifier is written |id|; what a rule takes leaves a bar, so neighbours don't close up
    start = F.struct(
        F.array_join(F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "").alias("rest"),
        F.array().cast("array<string>").alias("found"),
    )

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["seq"])
        return F.when(
            hit,
            F.struct(
                F.replace(acc["rest"], rule["seq"], F.lit("/")).alias("rest"),
                F.array_union(acc["found"], F.array(rule["name"])).alias("found"),
            ),
        ).otherwise(acc)

    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step, lambda acc: acc["found"])).otherwise(
        F.array().cast("array<string>")
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licences (arrays) of every document."""
    out = let(
        identifiers(F.col("text")), lambda ids: F.struct(ids.alias("ids"), match_rules(ids).alias("licences"))
    )
    rows = docs.select(F.col("doc_id"), out.alias("r"))
    return rows.select("doc_id", F.col("r.ids").alias("sentence_ids"), F.col("r.licences").alias("licences"))


def digests(docs: DataFrame) -> DataFrame:
    """``scan`` with the arrays joined by commas."""
    return scan(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )
