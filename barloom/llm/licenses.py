"""License scans by ordered signature rules, in DataFrame operations only.

A text becomes its lower-case words joined by single spaces. Every rule is a regular expression over words with a
keyword, a priority, a label and a confidence; a rule runs only on texts that hold its keyword. Overlapping detections
are resolved in two steps: one that lies inside another is suppressed (of equal ones the smaller priority number stays),
then of two that overlap in part the smaller priority number stays, the earlier at a tie.

The rules are license names, written as regular expressions, times the phrases that licenses are granted with, and clauses
of license texts and file headers, which find a pasted license without its name. A clause ranks after names that overlap it in
part; a name inside a clause is part of it. The keyword must begin a word.

Defined results: a null text is empty, has no words and no detections; every row gives one row; repeated phrases count at
every place; other columns are kept. Places are word numbers from 0. Nothing is shuffled: a text is scanned where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import bound, states_before

FOUND = "struct<start:int,back:int,priority:int,label:string,confidence:double>"

# The phrases whose every place counts, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Fixed values: (label, keyword, name as a regular expression over words).
NAMES = (
    ("gpl-2.0", "gnu", "gnu general public licen[sc]e (?:version |v )?2(?: 0)?"), ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?"),
    ("gpl-3.0", "gnu", "gnu general public licen[sc]e (?:version |v )?3(?: 0)?"), ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?"),
    ("gpl", "gnu", "gnu general public licen[sc]e"), ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl-2.1", "lesser", "lesser general public licen[sc]e (?:version |v )?2 1"), ("lgpl-3.0", "lesser", "lesser general public licen[sc]e (?:version |v )?3(?: 0)?"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[sc]e(?: (?:version |v )?3(?: 0)?)?"), ("gfdl", "gnu", "gnu free documentation licen[sc]e(?: version 1 [123])?"),
    ("apache-2.0", "apache", "apache(?: software)? licen[sc]e (?:version |v )?2(?: 0)?"), ("apache-1.1", "apache", "apache(?: software)? licen[sc]e (?:version |v )?1 1"),
    ("apache", "apache", "apache(?: software)? licen[sc]e"), ("mit", "mit", "(?:the )?mit(?: x11)? licen[sc]e"), ("mit", "expat", "expat licen[sc]e"),
    ("x11", "x11", "x11 licen[sc]e"), ("bsd-2-clause", "bsd", "(?:2|two) clause(?: simplified)? bsd(?: licen[sc]e)?"), ("bsd-2-clause", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:3|three) clause(?: new| modified)? bsd(?: licen[sc]e)?"), ("bsd-3-clause", "bsd", "bsd 3 clause"), ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: licen[sc]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e"), ("mpl-1.1", "mozilla", "mozilla public licen[sc]e (?:version |v )?1 1"), ("mpl-2.0", "mozilla", "mozilla public licen[sc]e (?:version |v )?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e (?:version |v )?1(?: 0)?"), ("epl-2.0", "eclipse", "eclipse public licen[sc]e (?:version |v )?2(?: 0)?"), ("cddl-1.0", "distribution", "common development and distribution licen[sc]e"), ("cddl-1.0", "cddl", "cddl"),
    ("cc-by-4.0", "cc", "cc by 4 0"), ("cc-by-3.0", "cc", "cc by 3 0"), ("cc-by-sa", "cc", "cc by sa(?: [1234] [05])?"), ("cc-by-nc", "cc", "cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234] [05])?"), ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234] [05])?"), ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234] [05])?"), ("cc0-1.0", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "commons", "creative commons attribution(?: licen[sc]e)?"), ("cc-by-sa", "commons", "creative commons attribution share ?alike(?: licen[sc]e)?"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?: licen[sc]e)?"), ("isc", "isc", "isc licen[sc]e"), ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("bsl-1.0", "boost", "boost software licen[sc]e(?: 1 0)?"), ("artistic-2.0", "artistic", "artistic licen[sc]e(?: 2 0)?"),
    ("psf-2.0", "python", "python software foundation licen[sc]e"), ("php-3.0", "php", "php licen[sc]e"), ("ofl-1.1", "sil", "sil open font licen[sc]e(?: 1 1)?"), ("eupl-1.2", "union", "european union public licen[sc]e"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e"), ("postgresql", "postgresql", "postgresql licen[sc]e"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"), ("odbl-1.0", "database", "open database licen[sc]e"),
)
# Fixed values: (words before the name, words after it, priority, confidence); the bare name comes last.
GRANTS = (
    ("spdx licen[sc]e identifier ", "", 0, 1.0),
    ("licen[sc]ed under (?:the terms of )?(?:the )?", "", 1, 1.0),
    ("(?:released|published|available|provided) under (?:the terms of )?(?:the )?", "", 2, 0.95),
    ("(?:distributed|redistributed|covered) (?:under|by) (?:the terms of )?(?:the )?", "", 3, 0.95),
    ("(?:subject to|governed by) (?:the terms of )?(?:the )?", "", 4, 0.9),
    ("", "", 5, 0.8),
)


# Fixed values: (label, keyword, clause of the license's text or header as a regular expression over words).
BODIES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "noninfringement", "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("isc", "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the"),
    ("bsd-3-clause", "endorse", "neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "publish", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"), ("beerware", "beer", "you can buy me a beer in return"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3.0", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl", "copy", "you should have received a copy of the gnu general public license along with this"),
    ("gpl-2.0", "verbatim", "you may copy and distribute verbatim copies of the programs source code as you receive it"),
    ("gpl-3.0", "propagate", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("gpl-3.0", "consumer", "user product is either 1 a consumer product"), ("gpl-3.0", "convey", "you may convey verbatim copies of the programs source code as you receive it"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "copy", "you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("lgpl-2.1", "library", "a work that uses the library in isolation the work is not a derivative work of the library"),
    ("lgpl-3.0", "combined", "you may convey a combined work under terms of your choice"),
    ("agpl-3.0", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", "remotely", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?(?:copyright|patent) license"),
    ("apache-2.0", "warranties", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("mpl-1.1", "subject", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("epl-1.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1.0", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "machine", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("artistic-2.0", "permitted", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("ofl-1.1", "font", "the font software may be sold as part of a larger software package but no copy of one or more of the font software"),
    ("ofl-1.1", "reserved", "no modified version of the font software may use the reserved font name"),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("cc0-1.0", "dedicated", "has dedicated the work to the public domain by waiving all of (?:his or her|their) rights to the work"),
    ("cc-by", "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("psf-2.0", "licensee", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform"),
    ("odbl-1.0", "database", "this database is made available under the open database license"),
    ("public-domain", "dedicate", "(?:we|i) (?:hereby )?dedicate this (?:software|work) to the public domain"),
    ("proprietary", "prohibited", "unauthori[sz]ed copying of this file via any medium is strictly prohibited(?: proprietary and confidential)?"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
)
BODY_PRIORITY = 6000
BODY_CONFIDENCE = 0.9


def rules() -> list[tuple[str, list[tuple[int, str, str, float]]]]:
    """(keyword, [(priority, label, pattern, confidence)]); later names rank after earlier ones of the same grant."""
    by_keyword: dict[str, list[tuple[int, str, str, float]]] = {}
    for place, (label, keyword, name) in enumerate(NAMES):
        for before, after, priority, confidence in GRANTS:
            pattern = f"(?<= ){before}(?:{name}){after}(?= )"
            by_keyword.setdefault(keyword, []).append((1000 * priority + place, label, pattern, confidence))
    for place, (label, keyword, clause) in enumerate(BODIES):
        by_keyword.setdefault(keyword, []).append((BODY_PRIORITY + place, label, f"(?<= )(?:{clause})(?= )", BODY_CONFIDENCE))
    return sorted(by_keyword.items())


def words_of(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), each with a space before and one after the last; one space if none."""
    # lower() also changes other letters; it is used where there are none.
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_literal() -> Column:
    quoted = [
        f"struct('{keyword}' AS keyword, array({', '.join(f"struct({p} AS priority, '{label}' AS label, '{pattern}' AS pattern, {c}D AS confidence)" for p, label, pattern, c in found)}) AS rules)"
        for keyword, found in rules()
    ]
    return F.expr(f"array({', '.join(quoted)})")


def _detections(words: Column, rule: Column) -> Column:
    """All places of one rule as (start, minus end, priority, label, confidence), in word numbers."""

    def one(x: Column, before: Column) -> Column:
        start = before + spaces(x["gap"]) - 1
        end = start + spaces(x["hit"]) + 1
        return F.struct(start.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))

    def all_of(pairs: Column) -> Column:
        return F.zip_with(pairs, states_before(pairs, F.lit(0), "int", lambda at, x: at + spaces(x["gap"]) + spaces(x["hit"])), one)

    # Zipped outside the lambdas, so that both regular expression calls run once per rule.
    hits = F.regexp_extract_all(words, rule["pattern"], F.lit(0)).alias("hit")
    gaps = F.split(words, rule["pattern"], -1).alias("gap")
    return bound(F.filter(F.arrays_zip(hits, gaps), lambda x: x["hit"].isNotNull()), all_of)


def _resolved(sorted_found: Column) -> Column:
    """Detections in the order (start, minus end, priority) without contained and without outranked overlapping ones."""

    def apart(found: Column) -> Column:
        reached = states_before(found, F.lit(-1), "int", lambda end, x: F.greatest(end, -x["back"]))
        return F.array_compact(F.zip_with(found, reached, lambda x, end: F.when(-x["back"] > end, x)))

    def clear(last: Column, x: Column) -> Column:
        return last.isNull() | (x["start"] >= -last["back"])

    def kept(found: Column) -> Column:
        # Only the last one kept can overlap the next; it is settled when one comes that does not.
        lasts = states_before(found, F.lit(None).cast(FOUND), FOUND, lambda last, x: (
            F.when(clear(last, x) | (x["priority"] < last["priority"]), x).otherwise(last)))
        return F.array_compact(F.zip_with(found, lasts, lambda x, last: F.when(clear(last, x), last)))

    # One behind all others settles the last.
    behind = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(-(2**31 - 1)).alias("back"), F.lit(0).alias("priority"), F.lit("").alias("label"), F.lit(0.0).alias("confidence"))
    return bound(F.array_append(bound(sorted_found, apart), behind.cast(FOUND)), kept)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (per base phrase: label, count, first and last word) and ``detections``."""
    added = ("n_words", "places", "detections")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    work = docs.select(F.struct(*kept).alias("row"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    work = work.withColumn("n_words", (spaces(F.col("words")) - 1).cast("long"))

    present = F.filter(_rule_literal(), lambda r: F.contains(F.col("words"), F.concat(F.lit(" "), r["keyword"])))
    work = work.withColumn("rules", F.flatten(F.transform(present, lambda r: r["rules"])))

    def place(phrase: str, label: str) -> Column:
        gaps = F.split("words", f"(?<= ){phrase}(?= )", -1)
        count = phrase.count(" ") + 1
        there = F.contains("words", F.lit(f" {phrase} "))
        one = F.struct(
            F.lit(label).alias("label"), (F.size(gaps) - 1).cast("long").alias("n"), (spaces(F.element_at(gaps, 1)) - 1).cast("long").alias("first"),
            (F.col("n_words") - count - (spaces(F.element_at(gaps, -1)) - 1)).alias("last"))
        return F.when(there, one)

    places = F.filter(F.array(*[place(p, label) for p, label in PHRASES]), lambda x: x.isNotNull())
    found = F.flatten(F.transform("rules", lambda r: _detections(F.col("words"), r)))
    work = work.select("row", "n_words", places.alias("places"), F.array_sort(found).alias("found"))
    detections = F.transform(_resolved(F.col("found")), lambda x: F.struct(
        x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label"), x["priority"].alias("priority"), x["confidence"].alias("confidence")))
    return work.select("row.*", "n_words", "places", detections.alias("detections"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, places and labels per document."""
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("detections", lambda d: d["label"])
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
