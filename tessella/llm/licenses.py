"""Licence recognition by sentence rules, in DataFrame operations only.

A text is cut into pieces at sentence ends and line breaks, each is normalised (lower case; every run of other signs than
letters and digits is one space), and every stretch of pieces that together are a known licence sentence is mapped to its
identifier: hard-wrapped lines, "free software: you can" and "v. 2.0" are cuts within a sentence. Of overlapping stretches
the first counts, then the longest. What is left of a document is a short sequence of
identifiers in text order. Ordered rules are matched against that sequence: a rule matches where its identifiers stand
next to each other, and uses them up, so that a rule for a whole licence text comes before rules for single sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier, normalised sentence. The wording is that of the public licences and their usual notices.
SENTENCES = [
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("mit-released", "released under the mit license"),
    ("apache2-under", "licensed under the apache license version 2 0"),
    ("mit-under", "licensed under the mit license"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache2-may-not", "you may not use this file except in compliance with the license"),
    ("apache2-obtain", "you may obtain a copy of the license at"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl3-under", "licensed under the gnu general public license version 3"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-sa-4", "licensed under cc by sa 4 0"),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0"),
    ("rights-reserved", "all rights reserved"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost-title", "boost software license version 1 0"),
    ("boost-under", "distributed under the boost software license version 1 0"),
    ("apache2-title", "apache license version 2 0 january 2004"),
]
# Further wordings of sentences above, as whole licence headers have them.
HEADER_FORMS = [("apache2-under", "licensed under the apache license version 2 0 the license")]
# Licence, identifiers in order; earlier rules come first.
RULES = [
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-retain", "bsd-reproduce", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-retain", "bsd-reproduce"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", ["apache2-under", "apache2-may-not", "apache2-obtain"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0", ["gpl3-under"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("Apache-2.0", ["apache2-under"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("BSD", ["bsd-redistribution"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-under"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-title"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-free"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-under"]),
    ("Apache-2.0", ["apache2-title"]),
    ("proprietary", ["rights-reserved"]),
]
SENTENCE_END = r"[.!?;:]+\s+|[\r\n]+"
CUT = "\n"  # every line break of a text is a cut, so this sign is free to mark all cuts
NOT_WORD_OR_CUT = r"[^\p{L}\p{N}\n]+"


def count_cuts(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(CUT), F.lit("")))


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_sentences, sentence_ids, licenses.

    n_sentences counts the known licence sentences, sentence_ids joins them by commas in text order, licenses joins the
    licences of the rules that matched, in the order of the rules and each once. Both are empty strings without a match,
    also for null and empty texts. Rows that share a doc_id are scanned as one document and get equal results; null
    doc_ids get no match. Further columns are ignored; an empty table stays empty.
    """
    known = sorted(SENTENCES + HEADER_FORMS, key=lambda k: -len(k[1]))  # the longest first
    stretch = CUT + "(?:" + "|".join(s.replace(" ", f"[ {CUT}]+") for _, s in known) + f")(?={CUT})"
    pieces = F.concat(F.lit(CUT), F.regexp_replace(F.lower("text"), SENTENCE_END, CUT), F.lit(CUT))
    pieces = F.replace(F.replace(F.regexp_replace(pieces, NOT_WORD_OR_CUT, " "), F.lit(" " + CUT), F.lit(CUT)), F.lit(CUT + " "), F.lit(CUT))
    marked = documents.where("doc_id is not null").select("doc_id", pieces.alias("pieces")).where(F.col("pieces").rlike(stretch))
    halves = marked.select("doc_id", F.regexp_extract_all("pieces", F.lit(stretch), F.lit(0)).alias("hits"), F.split("pieces", stretch).alias("between"))
    cuts = F.transform(F.arrays_zip("hits", "between"), lambda x: F.struct(x["hits"].alias("hit"), count_cuts(x["between"]).alias("before"), count_cuts(x["hits"]).alias("own")))
    each = halves.select("doc_id", F.posexplode(F.slice(cuts, F.lit(1), F.size("hits"))).alias("nth", "hit"), cuts.alias("cuts"))
    earlier = F.aggregate(F.slice("cuts", F.lit(1), F.col("nth")), F.lit(0), lambda n, x: n + x["before"] + x["own"])
    ids = F.create_map(*(F.lit(x) for i, s in known for x in (s, i)))
    norm = F.trim(F.regexp_replace("hit.hit", f"[ {CUT}]+", " "))
    # the piece that a stretch begins with, counted from 0; an empty first piece counts too
    met = each.select("doc_id", (earlier + F.col("hit.before")).alias("pos"), ids[norm].alias("sid"))
    kind = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("sid", T.StringType())]))
    ordered = met.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "sid"))).cast(kind).alias("found"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("," + "".join(f"{s}," for s in ids)).alias("ids")) for name, ids in RULES))
    joined = F.concat(F.lit(","), F.array_join(F.transform("found", lambda x: F.concat(x["sid"], F.lit(","))), ""))
    # every identifier is between commas of its own, so that rules next to each other match both
    spaced = F.replace(joined, F.lit(","), F.lit(",,"))
    start = F.struct(spaced.alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(state, rule):
        pattern = F.replace(F.substring(rule["ids"], F.lit(2), F.length(rule["ids"]) - 2), F.lit(","), F.lit(",,"))
        pattern = F.concat(F.lit(","), pattern, F.lit(","))
        hit = F.instr(state["left"], pattern) > 0
        return F.struct(F.replace(state["left"], pattern, F.lit(";")).alias("left"), F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    names = F.array_join(F.array_distinct(F.aggregate(rules, start, apply)["names"]), ",")
    result = ordered.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_join(F.transform("found", lambda x: x["sid"]), ",").alias("sentence_ids"), names.alias("licenses"))
    out = documents.select("doc_id").join(result, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_sentences", F.lit(0).cast("long")).alias("n_sentences"), F.coalesce("sentence_ids", F.lit("")).alias("sentence_ids"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def oracle() -> str:
    """DuckDB SQL for the rows of scan_licenses(documents), where each licence sentence is one piece and no header form occurs."""
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES)
    steps, last = "", "s0"
    for k, (_, ids) in enumerate(RULES, 1):
        pattern = "," + ",,".join(ids) + ","
        steps += f", s{k} as (select *, replace(l{k - 1}, '{pattern}', ';') as l{k}, strpos(l{k - 1}, '{pattern}') > 0 as h{k} from {last})"
        last = f"s{k}"
    first_of = {}
    for k, (name, _) in enumerate(RULES, 1):
        first_of.setdefault(name, []).append(k)
    # a licence stands where its first matching rule stands
    hits = " union all ".join(f"select doc_id, '{name}' as name, case {' '.join(f'when h{k} then {k}' for k in ks)} end as k from {last}" for name, ks in first_of.items())
    return f"""with known(norm, sid) as (values {known}),
pieces as (select doc_id, string_split_regex(text, '[.!?;:]+\\s+|[\\r\\n]+') as p from documents where doc_id is not null),
cut as (select distinct doc_id, unnest(range(len(p))) as pos, trim(regexp_replace(lower(unnest(p)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as norm from pieces),
met as (select c.doc_id, c.pos, k.sid from cut c join known k on c.norm = k.norm),
s0 as (select doc_id, count(*) as n, string_agg(sid, ',' order by pos) as ids, ',' || string_agg(sid, ',,' order by pos) || ',' as l0 from met group by doc_id){steps},
names as (select doc_id, string_agg(name, ',' order by k) as licenses from ({hits}) h where k is not null group by doc_id)
select d.doc_id, coalesce(s0.n, 0)::bigint as n_sentences, coalesce(s0.ids, '') as sentence_ids, coalesce(n.licenses, '') as licenses
from documents d left join s0 on d.doc_id = s0.doc_id left join names n on d.doc_id = n.doc_id"""
