"""Find licences in documents by sentence rules.

Sentences are normalised and mapped to identifiers of known licence sentences. A document becomes
the sequence of the identifiers it holds, in order, with the sentences between them; a rule is an
ordered sequence of identifiers that may stand at most ``GAP`` other sentences apart. Rules are
tried in their order of strength, and a weaker rule does not report what a stronger one has found.
All of it is array work inside a row: nothing is shuffled, so no document or licence can be hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, as regular expressions that are looked for in normalised
#: sentences (lower case, only letters, digits and single blanks). Fixed values.
_UNDER = r"(released|licensed|distributed|available|published|subject) (under|to) (the )?(terms of (the )?)?(a )?"
_SPDX = r"spdx license identifier "
_FREE = r"is free software you can redistribute it and or modify it under the terms of the gnu "
SENTENCES = {
    "A": _UNDER + r"apache (license )?(version |v ?)?2 0|" + _SPDX + r"apache 2 0",
    "a": r"you may not use this file except in compliance with the license",
    "u": r"you may obtain a copy of the license at",
    "w": r"distributed on an as is basis without warranties or conditions of any kind",
    "M": _UNDER + r"mit license|" + _SPDX + r"mit",
    "p": r"permission is hereby granted free of charge to any person obtaining a copy",
    "n": r"the above copyright notice and this permission notice .{0,60}?shall be included in",
    "s": r"the software is provided as is without warranty of any kind",
    "G": _UNDER + r"gnu general public license( version| v)? ?3|" + _SPDX + r"gpl 3 0( only| or later)?",
    "H": _UNDER + r"gnu general public license( version| v)? ?2|" + _SPDX + r"gpl 2 0( only| or later)?",
    "L": _UNDER + r"gnu lesser general public license( version| v)? ?3|" + _SPDX + r"lgpl 3 0( only| or later)?",
    "l": _UNDER + r"gnu lesser general public license( version| v)? ?2 1|" + _SPDX + r"lgpl 2 1( only| or later)?",
    "V": _UNDER + r"gnu affero general public license( version| v)? ?3|" + _SPDX + r"agpl 3 0( only| or later)?",
    "f": _FREE + r"general public license",
    "h": _FREE + r"lesser general public license",
    "k": _FREE + r"affero general public license",
    "m": _UNDER + r"mozilla public license( version| v)? ?2 0|" + _SPDX + r"mpl 2 0",
    "E": _UNDER + r"eclipse public license( version| v)? ?2 0|" + _SPDX + r"epl 2 0",
    "o": _UNDER + r"boost software license( version| v)? ?1 0|" + _SPDX + r"bsl 1 0",
    "i": r"permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted|" + _SPDX + r"isc",
    "z": r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software|" + _SPDX + r"zlib",
    "U": r"this is free and unencumbered software released into the public domain|" + _SPDX + r"unlicense",
    "Z": r"waived all copyright and related or neighboring rights to|" + _UNDER + r"(cc0|creative commons zero)|" + _SPDX + r"cc0 1 0",
    "x": _SPDX + r"bsd 3 clause",
    "y": _SPDX + r"bsd 2 clause",
    "N": _UNDER + r"(cc by nc|creative commons attribution non ?commercial) 4 0|" + _SPDX + r"cc by nc 4 0",
    "C": _UNDER + r"(cc by|creative commons attribution) 4 0|" + _SPDX + r"cc by 4 0",
    "S": _UNDER + r"(cc by sa|creative commons attribution share ?alike) 4 0|" + _SPDX + r"cc by sa 4 0",
    "B": r"redistribution and use in source and binary forms with or without modification are permitted",
    "b": r"redistributions of source code must retain the above copyright notice",
    "c": r"redistributions in binary form must reproduce the above copyright notice",
    "e": r"neither the names? of .{1,200}? nor the names of .{1,100}? may be used",
    "R": r"all rights reserved",
}
#: Rules as (licence, identifiers in order), strongest first. Fixed values.
RULES = (
    ("Apache-2.0", "Aauw"),
    ("Apache-2.0", "A"),
    ("MIT", "pns"),
    ("MIT", "M"),
    ("BSD-3-Clause", "Bbce"),
    ("BSD-3-Clause", "x"),
    ("BSD-2-Clause", "Bbc"),
    ("BSD-2-Clause", "y"),
    ("GPL-3.0", "G"),
    ("GPL-2.0", "H"),
    ("LGPL-3.0", "L"),
    ("LGPL-2.1", "l"),
    ("AGPL-3.0", "V"),
    ("GPL", "f"),
    ("LGPL", "h"),
    ("AGPL", "k"),
    ("MPL-2.0", "m"),
    ("EPL-2.0", "E"),
    ("BSL-1.0", "o"),
    ("ISC", "i"),
    ("Zlib", "z"),
    ("Unlicense", "U"),
    ("CC0-1.0", "Z"),
    ("CC-BY-NC-4.0", "N"),
    ("CC-BY-SA-4.0", "S"),
    ("CC-BY-4.0", "C"),
    ("All-rights-reserved", "R"),
)
#: Other sentences that may stand between two sentences of a rule.
GAP = 2

#: A sentence ends at a line without letters and digits, or at a mark followed by white space, but
#: not at the marks that stand inside known sentences. Other line ends only wrap it.
_END = (
    r"\n[^\p{L}\p{N}\n]*\n"
    r"|(?<=[.!?;:])(?<!(?i:free software)[;:])(?<!(?i:\bv)\.)(?<!(?i:license-identifier):)\s++(?![^\p{L}\p{N}]*+(?i:nor the names))"
)
#: Words without which a sentence is none of those of ``SENTENCES``; other sentences have no such words.
_HINT = r"(?i)under|licen|copy|permi|rights|redistribut|warrant|provided|neither|obtain|unencumbered|plainly|subject"
_OTHER = "."


def identifiers(text: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """One character per sentence of a text: its identifier, or ``.`` for any other sentence. Where
    no mark parts known sentences, each has its character."""
    whole = "|".join(f"(?:{p})" for p in sentences.values())
    pattern = rf"(?<!\bnot )\b(?:{whole})\b"

    def normal(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))

    def name(s: Column) -> Column:
        out = F.lit(_OTHER)
        for own, known in reversed(list(sentences.items())):
            out = F.when(s.rlike(f"^(?:{known})$"), own).otherwise(out)
        return out

    def known(s: Column) -> Column:
        found = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), name), "")
        return F.when(found == "", _OTHER).otherwise(found)

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), _END), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    if sentences is SENTENCES:
        named = F.transform(parts, lambda s: F.when(s.rlike(_HINT), known(normal(s))).otherwise(_OTHER))
    else:
        named = F.transform(parts, lambda s: known(normal(s)))
    return F.array_join(named, "")


def _matches(sequence: Column, rules: Sequence[tuple[str, str]], gap: int) -> Column:
    """Licences whose rule is met, in rule order; sentences that a rule has used are struck out."""
    each = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(f".{{0,{gap}}}?".join(ids)).alias("pattern"),
                F.lit(_OTHER * len(ids)).alias("used"),
            )
            for name, ids in rules
        ]
    )
    start = F.struct(F.array().cast("array<string>").alias("found"), sequence.alias("rest"))

    def step(so_far: Column, rule: Column) -> Column:
        met = F.regexp_like(so_far["rest"], rule["pattern"])
        return F.struct(
            F.when(met, F.array_append(so_far["found"], rule["name"])).otherwise(so_far["found"]).alias("found"),
            F.call_function("regexp_replace", so_far["rest"], rule["pattern"], rule["used"]).alias("rest"),
        )

    return F.array_distinct(F.aggregate(each, start, step, lambda end: end["found"]))


def scan(
    docs: DataFrame,
    text: str = "text",
    sentences: Mapping[str, str] = SENTENCES,
    rules: Sequence[tuple[str, str]] = RULES,
    gap: int = GAP,
) -> DataFrame:
    """``docs`` with license_sequence, licenses (in rule order) and n_license_sentences.

    Null and empty texts have an empty sequence and no licence. Repeated rows and null ids make no
    difference; columns of the three names are replaced, other columns stay.
    """
    at = "_license_sequence"
    rows = docs.withColumn(at, identifiers(F.col(text), sentences))
    hits = F.length(F.regexp_replace(at, r"\.", "")).cast("int")
    # Most documents hold no licence sentence; the rules are tried on the others.
    found = F.when(hits > 0, _matches(F.col(at), rules, gap)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns(
        {"license_sequence": F.col(at), "licenses": found, "n_license_sentences": hits}
    ).drop(at)
