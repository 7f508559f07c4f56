"""Licence scans by sentence rules (operator 4), in DataFrame functions only.

A text is cut into sentences at blank lines and after . ! ? before white space. A line end, a semicolon or a colon may
cut: a known sentence is found whether it is one line, is wrapped over several, follows an unfinished heading or stands
behind comment signs. Sentences are normalised: lower case, everything but letters of a-z, digits and inner dots as one
space. A sentence of the table of known licence sentences becomes its two-letter code; others drop out. A known sentence
may have slots (`*`): one to `SLOT` words of any kind, as for the name of a holder. The codes, in text
order, are matched from left to right against the licence rules, which are ordered sequences of codes: the first rule in
the list that fits is taken. A known sentence that no rule takes is reported as unmatched.

Sentences and rules are parameters of `scan`, so both tables may grow. SPDX tags are sentences that are made from the
rules' licence names. All of it is one projection over array and text functions: no shuffle, no join, and tables of
bounded size in the plan. Each step's pattern is linear in the text's length. Texts that hold none of a few words, one of
which every known sentence has, are told first and are not normalised.

Cases: null and empty texts have no sentences and no licences; very long texts are one row; repeated sentences give
repeated licences; an empty table gives an empty table; a null id stays null; other columns pass through `scan`, whose
results replace columns of the same name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import clean_text, table

#: Known licence sentences, normalised, with their codes.
SENTENCES = {
    "released under the mit license": "ma",
    "licensed under the mit license": "ma",
    "licensed under the mit license see license for details": "ma",
    "this project is licensed under the mit license": "ma",
    "this software is released under the mit license": "ma",
    "mit license": "mt",
    "the mit license": "mt",
    "the mit license mit": "mt",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mg",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mn",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mw",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "ml",
    "apache license version 2.0 january 2004": "at",
    "licensed under the apache license version 2.0": "aa",
    "licensed under the apache license version 2.0 the license": "aa",
    "this project is licensed under the apache license version 2.0": "aa",
    "you may not use this file except in compliance with the license": "ac",
    "you may obtain a copy of the license at": "ao",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "ao",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "aw",
    "see the license for the specific language governing permissions and limitations under the license": "as",
    "gnu general public license version 3 29 june 2007": "gt",
    "gnu general public license version 2 june 1991": "gs",
    "gnu lesser general public license version 3 29 june 2007": "lt",
    "gnu lesser general public license version 2.1 february 1999": "ls",
    "gnu affero general public license version 3 19 november 2007": "ft",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lf",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "le",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "fa",
    "this work is licensed under the gnu general public license version 3": "gc",
    "this work is licensed under the gnu general public license version 2": "gb",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gf",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "ge",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "go",
    "this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation": "go",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gp",
    "this program is free software you can redistribute it and or modify it under the terms of version 3 of the gnu general public license as published by the free software foundation": "gp",
    "this is free and unencumbered software released into the public domain": "ua",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "ub",
    "boost software license version 1.0 august 17th 2003": "bt",
    "distributed under the boost software license version 1.0": "bu",
    "eclipse public license v 2.0": "et",
    "eclipse public license version 2.0": "et",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at *": "ea",
    "cc0 1.0 universal": "zt",
    "this software is provided as is without any express or implied warranty": "za",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zb",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zc",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gw",
    "see the gnu general public license for more details": "gd",
    "you should have received a copy of the gnu general public license along with this program": "gr",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "ba",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bb",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bc",
    "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without * permission": "bd",
    "neither the name of * may be used to endorse or promote products derived from this software without * permission": "bd",
    "neither the names of * may be used to endorse or promote products derived from this software without * permission": "bd",
    "the name of * may not be used to endorse or promote products derived from this software without * permission": "bd",
    "the names of * may not be used to endorse or promote products derived from this software without * permission": "bd",
    "* endorse or promote products derived from this software *": "bd",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement *": "bv",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bv",
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "be",
    "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bf",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ia",
    "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ib",
    "in no event shall * be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ic",
    "mozilla public license version 2.0": "pt",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "pb",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "pa",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "pb",
    "licensed under cc by nc 4.0": "cn",
    "licensed under cc by 4.0": "cb",
    "licensed under cc by sa 4.0": "cs",
    "this work is licensed under a creative commons attribution 4.0 international license": "cb",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "cs",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "cn",
    "all rights reserved": "xr",
}
#: Licence rules: ordered sequences of sentence codes, the most telling first.
RULES = [
    ("MIT", "mt mg mn mw ml"), ("MIT", "mg mn mw ml"), ("MIT", "mg mn"), ("MIT", "ma mt"), ("MIT", "ma"),
    ("Apache-2.0", "at"), ("Apache-2.0", "aa ac ao aw as"), ("Apache-2.0", "aa ac"), ("Apache-2.0", "aa"),
    ("GPL-3.0-or-later", "gf gw gd gr"), ("GPL-3.0-or-later", "gf gw gd"), ("GPL-3.0-or-later", "gf"),
    ("GPL-2.0-or-later", "ge gw gd gr"), ("GPL-2.0-or-later", "ge gw gd"), ("GPL-2.0-or-later", "ge"),
    ("GPL-3.0-only", "gp gw gd gr"), ("GPL-3.0-only", "gp gw gd"), ("GPL-3.0-only", "gp"), ("GPL-2.0-only", "go gw gd gr"), ("GPL-2.0-only", "go gw gd"), ("GPL-2.0-only", "go"),
    ("GPL-3.0-only", "gt"), ("GPL-2.0-only", "gs"), ("GPL-3.0-only", "gc"), ("GPL-2.0-only", "gb"),
    ("LGPL-3.0-or-later", "lf"), ("LGPL-2.1-or-later", "le"), ("LGPL-3.0-only", "lt"), ("LGPL-2.1-only", "ls"),
    ("AGPL-3.0-or-later", "fa"), ("AGPL-3.0-only", "ft"),
    ("BSD-4-Clause", "ba bb bc bv bd be bf"), ("BSD-4-Clause", "ba bb bc bv bd"),
    ("BSD-3-Clause", "ba bb bc bd be bf"), ("BSD-3-Clause", "ba bb bc bd"), ("BSD-2-Clause", "ba bb bc be bf"), ("BSD-2-Clause", "ba bb bc"),
    ("ISC", "ia ib ic"), ("ISC", "ia"), ("MPL-2.0", "pa pb"), ("MPL-2.0", "pa"), ("MPL-2.0", "pt"),
    ("Unlicense", "ua ub"), ("Unlicense", "ua"), ("BSL-1.0", "bt"), ("BSL-1.0", "bu"), ("EPL-2.0", "et"), ("EPL-2.0", "ea"), ("CC0-1.0", "zt"),
    ("Zlib", "za zb zc"), ("Zlib", "zb zc"), ("Zlib", "zc"),
    ("CC-BY-NC-4.0", "cn"), ("CC-BY-SA-4.0", "cs"), ("CC-BY-4.0", "cb"),
]


def with_tags(sentences: dict[str, str], rules: list[tuple[str, str]]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Both tables with a sentence and a rule for the SPDX tag of each licence, coded by a letter and a digit or two letters
    that no other sentence has."""
    free = iter(sorted({a + b for a in "stuvwxyz" for b in "0123456789abcdefghijklmnopqrstuvwxyz"} - set(sentences.values())))
    tags = {name: next(free) for name in dict.fromkeys(n for n, _ in rules)}
    return sentences | {f"spdx license identifier {n.lower().replace('-', ' ')}": c for n, c in tags.items()}, rules + list(tags.items())


#: Ends of sentences (sure cuts), and line ends, semicolons and colons (a sentence may go on after them), in texts.
END, MAYBE = "\x01", "\x02"
_END, _MAYBE = r"\x01", r"\x02"  # the same in patterns
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (pattern, replacement) steps that normalise a text, in both engines' dialect; \\1 is the first group.
STEPS = [
    (r"\r\n?", "\n"),
    (r"(^|[^a-z0-9])v\.[ \t\n]+", r"\1v "),  # "v. 2.0" ends no sentence
    (r"\n[^a-z0-9.!?;:\n]*\n", END),  # paragraphs
    (rf"[.!?]+([ \t\n{_END}])", END + r"\1"),
    (r"[;:][ \t]+|[;:]?\n", MAYBE),
    (rf"[^a-z0-9.{_END}{_MAYBE}]+", " "),
    (r"\.\.+", " "),
    (r"\. ", " "),
    (r"  +", " "),
    (rf"[ .]?[ .]?([{_END}{_MAYBE}])[ .]?[ .]?", r"\1"),
    (rf"{_MAYBE}+", MAYBE),
    (rf"[{_END}{_MAYBE}]*{_END}[{_END}{_MAYBE}]*", END * 2),  # doubled: neighbours each take one
    (_MAYBE, MAYBE * 2),
]


#: Words of a slot, at most.
SLOT = 16


def _canonical(sentence: str) -> str:
    return sentence.replace(". ", " ")


def _word(word: str, gap: str) -> str:
    return rf"[a-z0-9.]+(?:{gap}[a-z0-9.]+){{0,{SLOT - 1}}}?" if word == "*" else word.replace(".", r"\.")


def _slots(sentences: dict[str, str]) -> list[tuple[str, str]]:
    """(pattern of the whole sentence, the sentence) of those with slots, the longest first: more is fixed in them."""
    own = sorted({_canonical(s) for s in sentences if "*" in s}, key=lambda s: (-len(s), s))
    return [("^" + " ".join(_word(w, " ") for w in s.split(" ")) + "$", s) for s in own]


def telling_words(sentences: dict[str, str]) -> list[str]:
    """A few words of which every known sentence holds one: the commonest first, as long as sentences are left. Words stand in
    a text as they stand in its normal form, so a text without them has no known sentence."""
    left, out = [{w.strip(".") for w in s.split(" ") if len(w) > 5} or {max(s.replace("*", "").split(), key=len)} for s in sentences], []
    while left:
        words = sorted({w for s in left for w in s})
        out.append(max(words, key=lambda w: (sum(w in s for s in left) * min(len(w), 6), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def _sentence_pattern(sentences: dict[str, str]) -> str:
    """Any known sentence between two cuts, across possible cuts; longer sentences first."""
    gap = rf"(?: |{_MAYBE * 2})"
    known = sorted({_canonical(s) for s in sentences}, key=lambda s: (-len(s), s))
    return rf"[{_END}{_MAYBE}]({'|'.join(gap.join(_word(w, gap) for w in s.split(' ')) for s in known)})[{_END}{_MAYBE}]"


def _rule_pattern(rules: list[tuple[str, str]]) -> str:
    """Rules in list order, then any code that none takes; codes are two characters, so matches start at even places only."""
    return "|".join([*dict.fromkeys(codes.replace(" ", "") for _, codes in rules), "[a-z][a-z0-9]"])


def _names(rules: list[tuple[str, str]]) -> dict[str, str]:
    return {codes.replace(" ", ""): name for name, codes in reversed(rules)}


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def known_sentences(text: Column, sentences: dict[str, str]) -> Column:
    """The known sentences of a text, normalised, with slots as in the table: array<string>."""
    low = F.translate(text, _UPPER + END + MAYBE, _UPPER.lower() + "  ")
    plain = low
    for pattern, by in STEPS:
        plain = F.regexp_replace(plain, pattern, by.replace("\\1", "$1"))
        if by == "\n":
            plain = F.concat(F.lit(END), plain, F.lit(END))
    found = F.regexp_extract_all(plain, F.lit(_sentence_pattern(sentences)), F.lit(1))
    found = F.transform(found, lambda s: _named(F.replace(s, F.lit(MAYBE * 2), F.lit(" ")), sentences))
    may_hold = reduce(lambda a, b: a | b, [low.contains(w) for w in telling_words(sentences)])
    return F.when(may_hold, found).otherwise(F.array().cast("array<string>"))


def _named(sentence: Column, sentences: dict[str, str]) -> Column:
    for pattern, name in _slots(sentences):
        sentence = F.regexp_replace(sentence, pattern, name)
    return sentence


def scan(df: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """df with `sentence_codes`, `licences` and `unmatched`: arrays in text order."""
    sentences, rules = with_tags(sentences or SENTENCES, rules or RULES)
    rest = [c for c in df.columns if c not in ("sentence_codes", "licences", "unmatched")]
    known, names = _map({_canonical(k): v for k, v in sentences.items()}), _map(_names(rules))
    codes = F.transform(known_sentences(clean_text(F.col(f"`{text}`")), sentences), lambda s: F.element_at(known, s))
    found = df.select(*[F.col(f"`{c}`") for c in rest], codes.alias("sentence_codes"))
    found = found.withColumn("_match", F.regexp_extract_all(F.array_join("sentence_codes", ""), F.lit(_rule_pattern(rules)), F.lit(0)))
    return found.select(
        *[F.col(f"`{c}`") for c in rest],
        "sentence_codes",
        F.filter(F.transform("_match", lambda m: F.element_at(names, m)), lambda x: x.isNotNull()).alias("licences"),
        F.filter("_match", lambda m: F.element_at(names, m).isNull()).alias("unmatched"),
    )


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_codes").cast("long").alias("n_sentences"), *[F.array_join(c, ",").alias(c) for c in ("sentence_codes", "licences", "unmatched")])


def _sql_map(entries: dict[str, str]) -> str:
    return f"map {{{', '.join(f"'{k}': '{v}'" for k, v in entries.items())}}}"


def _sql_text(x: str) -> str:
    """A DuckDB literal; control characters by their codes."""
    return " || ".join(f"chr({ord(part)})" if part < " " else f"'{part}'" for part in re.split("([\x00-\x1f])", x) if part)


def _oracle() -> str:
    sentences, rules = with_tags(SENTENCES, RULES)
    named = "replace(x, chr(2) || chr(2), ' ')"
    for pattern, name in _slots(sentences):
        named = f"regexp_replace({named}, {_sql_text(pattern)}, {_sql_text(name)})"
    plain = f"translate(coalesce(text, ''), '{_UPPER}' || chr(1) || chr(2), '{_UPPER.lower()}  ')"
    for pattern, by in STEPS:
        plain = f"regexp_replace({plain}, {_sql_text(pattern)}, {_sql_text(by)}, 'g')"
        if by == "\n":
            plain = f"chr(1) || {plain} || chr(1)"
    return f"""
with s as (select doc_id, regexp_extract_all({plain}, {_sql_text(_sentence_pattern(sentences))}, 1) found from documents),
c as (select doc_id, list_transform(found, lambda x: {_sql_map({_canonical(k): v for k, v in sentences.items()})}[{named}]) codes from s),
m as (select doc_id, codes, regexp_extract_all(array_to_string(codes, ''), '{_rule_pattern(rules)}') found from c),
k as (select doc_id, codes, found, list_transform(found, lambda x: {_sql_map(_names(rules))}[x]) names from m)
select doc_id, len(codes)::bigint n_sentences, array_to_string(codes, ',') sentence_codes,
  array_to_string(list_filter(names, lambda x: x is not null), ',') licences,
  array_to_string(list_filter(found, lambda x: {_sql_map(_names(rules))}[x] is null), ',') unmatched
from k
"""


QUERIES = {"op4_licences": op4_licences}
ORACLE = {"op4_licences": _oracle()}
