"""Operator 4: license scans by ordered signature rules, in Spark SQL functions only.

A text is lower-cased (A-Z) and reduced to its words, joined by single spaces;
rules are regexes over that string. A document is looked at only if it holds
one of the rules' keywords, and of the rules only those whose keyword it
holds are run. Detections are intervals of words. One that lies inside
another of better priority (or of equal priority but longer, or of the same
interval and an earlier rule) is suppressed; the rest give the labels.

Null and empty texts have no words and no labels; repeated rows are judged
alike; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_columns

#: The base phrases of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str  # a document without it can't match; "a|b" if one of several must be there
    pattern: str  # over words joined by single spaces
    priority: int  # 0 identifier or full grant, 1 name with version, 2 name, 3 hint
    weight: float  # how sure a detection is


# A version as words: "2.0" is "2 0".
_V = {"1": r"1(?: 0)?", "1.0": r"1(?: 0)?", "1.1": r"1 1", "1.2": r"1 2", "1.3": r"1 3", "2": r"2(?: 0)?", "2.0": r"2(?: 0)?", "2.1": r"2 1", "2.5": r"2 5", "3": r"3(?: 0)?", "3.0": r"3(?: 0)?", "4.0": r"4(?: 0)?", "5.1": r"5 1"}
_VER = r"(?:,? ?(?:version|v|ver))? ?v?"


def _versioned(label: str, keyword: str, names: str, version: str) -> list[Signature]:
    """Three ways to state one version of a license: by name, as a grant, by its identifier."""
    v = _V[version]
    ident = label.replace(".", " ").replace("-", " ")
    return [
        Signature(label, keyword, rf"(?:{names})(?: license| licence)? ?(?:version |v ?)?{v}", 1, 0.9),
        Signature(label, keyword, rf"(?:licensed|released|distributed|available|provided|covered) under (?:the )?(?:terms of (?:the )?)?(?:{names})(?: license| licence)? ?(?:version |v ?)?{v}", 0, 1.0),
        Signature(label, "spdx", rf"spdx license identifier {ident}(?: only| or later)?", 0, 1.0),
    ]


def _plain(label: str, keyword: str, names: str) -> list[Signature]:
    """An unversioned name, as a name, as a grant, by its identifier."""
    ident = label.replace(".", " ").replace("-", " ")
    return [
        Signature(label, keyword, rf"(?:{names})", 2, 0.8),
        Signature(label, keyword, rf"(?:licensed|released|distributed|available|provided|covered) under (?:the |an |a )?(?:terms of (?:the )?)?(?:{names})", 0, 1.0),
        Signature(label, "spdx", rf"spdx license identifier {ident}", 0, 1.0),
    ]


def signatures() -> list[Signature]:
    """The rules, best first within a priority."""
    out: list[Signature] = []
    # Families with versions: label stem, keyword, names, versions.
    for stem, keyword, names, versions in (
        ("gpl", "general public|gnu gpl", r"(?:gnu )?general public license|gnu gpl", ("1.0", "2.0", "3.0")),
        ("lgpl", "lesser general", r"(?:gnu )?lesser general public license", ("2.1", "3.0")),
        ("lgpl", "library general", r"(?:gnu )?library general public license", ("2.0",)),
        ("agpl", "affero|gnu agpl", r"(?:gnu )?affero general public license|gnu agpl", ("1.0", "3.0")),
        ("gfdl", "free documentation|gnu fdl", r"(?:gnu )?free documentation license|gnu fdl", ("1.1", "1.2", "1.3")),
        ("apache", "apache", r"apache(?: software)? license|apache", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla", r"mozilla public license", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", r"eclipse public license", ("1.0", "2.0")),
        ("cddl", "common development", r"common development and distribution license", ("1.0", "1.1")),
        ("cpl", "common public", r"common public license", ("1.0",)),
        ("eupl", "european union", r"european union public licence", ("1.1", "1.2")),
        ("artistic", "artistic", r"artistic license", ("1.0", "2.0")),
        ("afl", "academic free", r"academic free license", ("2.0", "2.1", "3.0")),
        ("osl", "open software", r"open software license", ("1.0", "2.0", "2.1", "3.0")),
        ("bsl", "boost", r"boost software license", ("1.0",)),
        ("ofl", "open font", r"(?:sil )?open font license", ("1.0", "1.1")),
        ("lppl", "project public", r"latex project public license", ("1.0", "1.1", "1.2")),
        ("zpl", "zope", r"zope public license", ("2.0", "2.1")),
        ("qpl", "q public", r"q public license", ("1.0",)),
        ("upl", "universal permissive", r"universal permissive license", ("1.0",)),
        ("odbl", "database license", r"open (?:data commons open )?database license", ("1.0",)),
        ("cecill", "cecill", r"cecill", ("1.0", "2.0", "2.1")),
        ("mulan", "mulan", r"mulan permissive software license", ("1.0", "2.0")),
    ):
        for version in versions:
            out += _versioned(f"{stem}-{version}", keyword, names, version)
    # Creative Commons: the short form and the long name of each element set.
    for stem, short, long in (
        ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike|attribution non commercial share alike"),
        ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives|attribution non commercial no derivatives|attribution noncommercial noderivs"),
        ("cc-by-sa", "by sa", "attribution sharealike|attribution share alike"),
        ("cc-by-nd", "by nd", "attribution noderivatives|attribution no derivatives|attribution noderivs"),
        ("cc-by-nc", "by nc", "attribution noncommercial|attribution non commercial"),
        ("cc-by", "by", "attribution"),
    ):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = _V[version]
            out += [
                Signature(f"{stem}-{version}", "cc by", rf"cc {short} {v}", 1, 0.95),
                Signature(f"{stem}-{version}", "creative commons", rf"creative commons (?:{long})(?: international| unported| generic)?(?: license)? ?(?:version |v ?)?{v}(?: international| unported| generic)?", 1, 0.95),
            ]
        out += [
            Signature(stem, "cc by", rf"cc {short}", 2, 0.7),
            Signature(stem, "creative commons", rf"creative commons (?:{long})(?: license)?", 2, 0.8),
        ]
    # Licenses that have one text or are named without a version.
    for label, keyword, names in (
        ("gpl", "general public|gnu gpl", r"gnu general public license|gnu gpl"),
        ("lgpl", "lesser general", r"(?:gnu )?lesser general public license"),
        ("agpl", "affero", r"(?:gnu )?affero general public license"),
        ("apache", "apache", r"apache(?: software)? license"),
        ("mit", "mit lic", r"mit license|mit licence"),
        ("mit", "mit x11", r"mit x11 license"),
        ("mit-0", "mit no", r"mit no attribution license|mit no attribution"),
        ("x11", "x11", r"x11 license"),
        ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause(?: license)?"),
        ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd license|bsd 3 clause(?: license)?"),
        ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause(?: license)?"),
        ("bsd", "bsd", r"bsd license|bsd style license|bsd licence"),
        ("0bsd", "bsd|0bsd", r"bsd zero clause license|0bsd"),
        ("isc", "isc", r"isc license"),
        ("zlib", "zlib", r"zlib license|zlib libpng license"),
        ("libpng", "libpng", r"libpng license"),
        ("unlicense", "unlicense", r"the unlicense|unlicense"),
        ("wtfpl", "wtf|do what the", r"wtfpl|do what the fuck you want to public license"),
        ("python-2.0", "python|psf", r"python software foundation license|psf license"),
        ("php", "php", r"php license"),
        ("ruby", "ruby", r"ruby license"),
        ("ncsa", "ncsa", r"ncsa open source license|university of illinois ncsa"),
        ("postgresql", "postgresql", r"postgresql license"),
        ("openssl", "openssl", r"openssl license"),
        ("curl", "curl", r"curl license"),
        ("ms-pl", "microsoft", r"microsoft public license"),
        ("ms-rl", "microsoft", r"microsoft reciprocal license"),
        ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
        ("cc0", "creative commons", r"creative commons zero"),
        ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain"),
        ("beerware", "beerware", r"beerware(?: license)?"),
        ("beerware", "beer ware", r"beer ware license"),
        ("sspl", "server side", r"server side public license"),
        ("busl", "business source", r"business source license"),
        ("elastic", "elastic", r"elastic license"),
        ("commons-clause", "commons clause", r"commons clause"),
        ("llama", "llama", r"llama(?: 2| 3)? community license"),
        ("openrail", "openrail|open rail", r"(?:creativeml )?open ?rail(?: m)?(?: license)?"),
    ):
        out += _plain(label, keyword, names)
    # Passages of the license texts themselves.
    for label, keyword, pattern in (
        ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-3-clause", "neither the name", r"neither the name of .{1,120}? nor the names of its contributors may be used"),
        ("zlib", "express or implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        ("gpl", "free software", r"this program is free software you can redistribute it and or modify"),
        ("lgpl", "free software", r"this library is free software you can redistribute it and or modify"),
        # this sentence stands in notices of MPL 1.1 and CDDL too, so here the keyword is part of the rule
        ("apache-2.0", "apache", r"you may not use this (?:file|work) except in compliance with the license"),
        ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
        ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
        ("bsl-1.0", "boost", r"boost software license version 1 0 august 17th 2003"),
        ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ):
        out.append(Signature(label, keyword, pattern, 0, 1.0))
    # Hints that no license is given.
    for label, keyword, pattern, weight in (
        ("all-rights-reserved", "all rights", r"all rights reserved", 0.4),
        ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 1.0),
        ("no-commercial-use", "commercial use", r"(?:not for|no|non) commercial use", 1.0),
        ("permission-required", "written permission", r"without (?:the )?(?:prior )?(?:express )?written permission", 1.0),
    ):
        out.append(Signature(label, keyword, pattern, 3, weight))
    return out


def normalized(text: Column) -> Column:
    """' w1 w2 ... wn ' of the lower-cased words; one space if there are none."""
    words = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.ltrim(F.rtrim(words)), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _hits(norm: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of all matches: what lies between them gives their places."""
    between = F.split(norm, pattern, -1)
    found = F.regexp_extract_all(norm, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("hits"))
    both = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    folded = F.aggregate(
        F.slice(both, 1, F.size(found)),
        start,
        lambda s, x: F.struct(
            (s["at"] + _spaces(x["gap"]) + _spaces(x["hit"])).alias("at"),
            F.concat(s["hits"], F.array(F.struct((s["at"] + _spaces(x["gap"])).alias("start"), (s["at"] + _spaces(x["gap"]) + _spaces(x["hit"])).alias("end")))).alias("hits"),
        ),
    )
    return folded["hits"]


def _literal(rules: list[Signature]) -> Column:
    """The rules as one array; parsed from JSON, as one constant is planned faster than a tree of them."""
    rows = [{"label": r.label, "keywords": [f" {k}" for k in r.keyword.split("|")], "pattern": f" (?:{r.pattern})(?= )", "priority": r.priority, "weight": r.weight, "rule": i} for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,keywords:array<string>,pattern:string,priority:int,weight:double,rule:int>>")


def _gate(keywords: list[str]) -> str:
    """One regex whose group is the longest keyword at the start of a word, branching on first letters.

    It looks ahead only, so keywords that overlap are all found.
    """
    by: dict[str, list[str]] = {}
    for k in sorted(set(keywords), key=lambda k: (k[0], -len(k), k)):
        by.setdefault(k[0], []).append(k[1:])
    return "(?=( (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")))"


def _detections(norm: Column, keys: Column, rules: list[Signature]) -> Column:
    """keys: the distinct keywords found in norm, the longest at each place."""
    live = F.filter(F.filter(_literal(rules), lambda r: F.exists(keys, lambda k: F.exists(r["keywords"], lambda w: F.startswith(k, w)))), lambda r: F.rlike(norm, r["pattern"]))
    per_rule = F.transform(
        live,
        lambda r: F.transform(
            _hits(norm, r["pattern"]),
            lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight")),
        ),
    )
    return F.array_sort(F.flatten(per_rule))


def _unsuppressed(found: Column, priorities: int = 4) -> Column:
    """Keeps what no detection of better rank contains.

    Detections come sorted by start, then longest, then priority, then rule;
    so of two intervals the container comes first (of equal intervals the
    better rank does). The furthest end so far, by priority, decides.
    """
    far = F.array_repeat(F.lit(0), priorities)
    start = F.struct(far.alias("far"), F.array().cast("array<struct<start:int,end:int,label:string,weight:double>>").alias("kept"))

    def step(s: Column, d: Column) -> Column:
        end = -d["back"]
        hidden = F.array_max(F.slice(s["far"], 1, d["priority"] + 1)) >= end
        return F.struct(
            F.transform(s["far"], lambda x, i: F.when(i == d["priority"], F.greatest(x, end)).otherwise(x)).alias("far"),
            F.when(hidden, s["kept"]).otherwise(F.concat(s["kept"], F.array(F.struct(d["start"].alias("start"), end.alias("end"), d["label"].alias("label"), d["weight"].alias("weight"))))).alias("kept"),
        )

    return F.aggregate(found, start, step)["kept"]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Signature] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, base (places of the base phrases: start, label) and detections (start, end, label, weight)."""
    rules = signatures() if rules is None else rules
    phrases = BASE_PHRASES if phrases is None else phrases
    # one pass of one regex finds whether any keyword is there at all
    gate = _gate([k for r in rules for k in r.keyword.split("|")] + list(phrases))
    base_pattern = " (?:" + "|".join(sorted(phrases, key=len, reverse=True)) + ")(?= )"
    base_of = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    df = text_columns(docs, id_col, text_col).select("doc_id", normalized(F.col("text")).alias("norm"))
    norm = F.col("norm")
    df = df.select("doc_id", "norm", F.array_distinct(F.regexp_extract_all(norm, F.lit(gate), F.lit(1))).alias("keys"))
    df = df.select(
        "doc_id",
        "keys",
        F.when(norm == "  ", F.lit(0).cast("long")).otherwise(_spaces(norm) - 1).cast("long").alias("n_words"),
        F.when(F.size("keys") > 0, norm).alias("norm"),
    )
    names = F.regexp_extract_all(norm, F.lit(base_pattern), F.lit(0))
    places = _hits(norm, F.lit(base_pattern))
    return df.select(
        "doc_id",
        "n_words",
        F.when(norm.isNotNull(), F.zip_with(places, names, lambda p, n: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.element_at(base_of, F.ltrim(n)).alias("label")))).alias("base"),
        F.when(norm.isNotNull(), _unsuppressed(_detections(norm, F.col("keys"), rules))).alias("detections"),
    )
