"""Licence scans by sentence rules.

A text is cut into sentences, each normalised to lower-case words, and known licence sentences are
replaced by their identifiers. The sequence of identifiers is matched against rules in order; what a
rule matches is taken out of the sequence, so the more special rules stand first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import boxed, table

# Identifier and normalised forms of each known licence sentence.
SENTENCES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("apache2-copy", (
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0",
    )),
    ("apache-as-is", (
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    )),
    ("see-license", (
        "see the license for the specific language governing permissions and limitations under the license",
    )),
    ("mit", ("mit license", "the mit license", "the mit license mit")),
    ("mit-grant", (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions",
    )),
    ("mit-notice", (
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
    )),
    ("as-is", (
        "the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    )),
    ("boost-grant", (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license the software to use reproduce display distribute "
        "execute and transmit the software and to prepare derivative works of the software and to permit third "
        "parties to whom the software is furnished to do so all subject to the following",
    )),
    ("bsd-use", (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    )),
    ("bsd-source", (
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
    )),
    ("bsd-binary", (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
    )),
    ("bsd-advert", (
        "all advertising materials mentioning features or use of this software must display the following "
        "acknowledgement",
    )),
    ("isc-grant", (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    )),
    ("0bsd-grant", (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
    )),
    ("zlib-as-is", ("this software is provided as is without any express or implied warranty",)),
    ("zlib-grant", (
        "permission is granted to anyone to use this software for any purpose including commercial applications and "
        "to alter it and redistribute it freely subject to the following restrictions",
    )),
    ("unlicense", ("this is free and unencumbered software released into the public domain",)),
    ("rights", ("all rights reserved",)),
    ("verbatim", (
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    )),
    ("new-programs", ("how to apply these terms to your new programs", "how to apply these terms to your new libraries")),
    ("mpl-as-is", (
        "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied",
    )),
    ("mpl-rights", ("see the license for the specific language governing rights and limitations under the license",)),
    ("wtfpl", ("do what the fuck you want to public license",)),
)

# Identifier, name and version of the GNU licences, and the dates in the titles of their texts.
GNU: tuple[tuple[str, str, str], ...] = (
    ("gpl3", "gnu general public license", "3"),
    ("gpl2", "gnu general public license", "2"),
    ("gpl1", "gnu general public license", "1"),
    ("lgpl3", "gnu lesser general public license", "3"),
    ("lgpl21", "gnu lesser general public license", "2 1"),
    ("lgpl2", "gnu library general public license", "2"),
    ("agpl3", "gnu affero general public license", "3"),
)
DATES = ("29 june 2007", "june 1991", "february 1989", "29 june 2007", "february 1999", "june 1991", "19 november 2007")
GRANT = "([a-z0-9 ]{1,120} is free software )?you can redistribute it and or modify it under the terms of"

# Identifier and pattern of known sentences with places for names, years and versions.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("comply", "you may not use this (file|work|software) except in compliance with the license"),
    ("bsd-names", "neither the names? of [a-z0-9 ]{1,120} nor the names of (its|any|other) contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission"),
    ("bsd-names", "the names? of [a-z0-9 ]{1,120} may not be used to endorse or promote products derived from this software without "
     "specific prior written permission"),
    ("bsd-as-is", "this software is provided by [a-z0-9 ]{1,120} as is and any express or implied warranties including but not limited to "
     "the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("liability", "in no event (shall|will) [a-z0-9 ]{1,120} be (held )?liable for any (claim )?(direct |damages )[a-z0-9 ]{1,600}"),
    *((f"{name}-grant", f"{GRANT} the {words} as published by the free software foundation either version {said} of the license or at your option any "
       "later version") for name, words, said in GNU),
    *((f"{name}-only-grant", f"{GRANT} (the {words} version {said}( only)? as published by the free software foundation( version {said} of the license)?"
       f"|the {words} as published by the free software foundation version {said}( only)?( of the license)?|the {words} version {said}( only)?|version {said}( only)? of the {words}( as published by the free software foundation)?)")
      for name, words, said in GNU),
    *((f"{name}-title", f"{words} version {said} {month}( [a-z0-9 ]{{1,160}})?") for (name, words, said), month in zip(GNU, DATES)),
    ("gpl-no-warranty", "[a-z0-9 ]{1,120} is distributed in the hope that it will be useful but without any warranty( without even the "
     "implied warranty of merchantability or fitness for a particular purpose)?"),
    ("gpl-details", "see the gnu (lesser |library |affero )?general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu (lesser |library |affero )?general public license along with [a-z0-9 ]{1,240}"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license( v)?( 2 0)?"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at [a-z0-9 ]{1,60}"),
    ("epl2", "this program and the accompanying materials are made available under the terms of the eclipse public license (v |version )?2 0"
     "( which [a-z0-9 ]{1,120})?"),
    ("epl2-title", "eclipse public license v 2 0( [a-z0-9 ]{1,160})?"),
    ("apache2-title", "apache license version 2 0 january 2004( http www apache org licenses)?"),
    *((f"mpl{v.replace(' ', '')}", f"the contents of this file are subject to the mozilla public license version {v}( the license)?") for v in ("1 1", "1 0")),
    ("mpl-copy", "you may obtain a copy of the license at http www mozilla org mpl( [a-z0-9 ]{1,60})?"),
    ("cc-title", "creative commons legal code|creative commons corporation creative commons is not a law firm[a-z0-9 ]{0,200}"),
    ("public-domain", "this [a-z]{1,30} (is|has been) (released|placed|dedicated) (in|into|in to|to) the public domain"),
)

# Kinds and versions of the Creative Commons licences.
CC_KINDS = (
    ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"),
    ("by-nc", "attribution noncommercial"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by", "attribution"),
)
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")


def cc_label(version: str) -> str:
    """The version in an identifier: 4, 3, 25, 2, 1."""
    return version.replace(" 0", "").replace(" ", "")


def gnu_forms(words: str, said: str) -> tuple[str, ...]:
    """How a statement calls a version of a GNU licence: by its name or its short name, with or without ``gnu`` and ``version``."""
    short = "".join(w[0] for w in words.split() if w not in ("gnu", "license")).replace("gp", "gpl")
    numbers = (said, f"{said} 0") if len(said) == 1 else (said,)
    names = (f"{words} version ", f"{words} v", f"gnu {short} version ", f"gnu {short} v", f"{short} version ", f"{short} v", f"{short}v", f"{short} ")
    return tuple(f"{name}{number}" for name in names for number in numbers)


# Identifier and the names, normalised and without "the" and a closing "license", by which a statement calls a licence.
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("apache2", ("apache license version 2 0", "apache license 2 0", "apache version 2 0", "apache 2 0", "apache license version 2 0 the")),
    ("mit", ("mit",)),
    ("bsd3", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd")),
    ("bsd2", ("bsd 2 clause", "2 clause bsd", "simplified bsd")),
    ("bsd4", ("bsd 4 clause", "4 clause bsd", "original bsd")),
    ("mit0", ("mit 0", "mit no attribution")),
    ("wtfpl", ("wtfpl",)),
    ("postgresql", ("postgresql",)),
    ("ncsa", ("ncsa", "university of illinois ncsa open source")),
    ("ofl11", ("ofl 1 1", "sil open font license version 1 1", "sil open font license 1 1")),
    ("python2", ("python 2 0", "psf 2 0", "python software foundation license version 2")),
    ("ms-pl", ("ms pl", "microsoft public", "microsoft public license ms pl")),
    ("odbl1", ("odbl 1 0", "open database license version 1 0", "open database license v1 0", "open data commons open database")),
    ("cecill21", ("cecill 2 1", "cecill license version 2 1")),
    ("busl11", ("busl 1 1", "business source license 1 1", "business source license version 1 1")),
    ("classpath", ("classpath exception 2 0", "the classpath exception", "classpath exception")),
    ("gcc-exception", ("gcc exception 3 1", "gcc runtime library exception")),
    ("llvm-exception", ("llvm exception", "llvm exceptions")),
    ("syscall-note", ("linux syscall note",)),
    ("bsd0", ("0bsd", "bsd zero clause", "zero clause bsd")),
    *((f"{name}{to}", tuple(f"{form}{tail}" for form in gnu_forms(words, said) for tail in tails))
      for name, words, said in GNU for to, tails in (("", ("", " only")), ("-grant", (" orlater",)))),
    ("mpl11", ("mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1")),
    ("mpl10", ("mozilla public license version 1 0", "mozilla public license 1 0", "mpl 1 0")),
    ("mpl2", ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0", "mpl version 2 0")),
    ("epl2", ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0")),
    ("epl1", ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0")),
    ("cddl1", ("common development and distribution license version 1 0", "common development and distribution license 1 0", "cddl 1 0")),
    ("eupl12", ("european union public license version 1 2", "european union public license 1 2", "eupl 1 2", "eupl version 1 2")),
    ("artistic2", ("artistic license version 2 0", "artistic license 2 0", "artistic 2 0")),
    ("boost1", ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0")),
    ("isc", ("isc",)),
    ("zlib", ("zlib",)),
    ("unlicense", ("unlicense",)),
    ("cc0", ("cc0 1 0", "public domain under cc0 1 0", "creative commons zero 1 0", "cc0")),
    *((f"cc-{kind}-{cc_label(version)}", tuple(
        form for words in (named, named.replace("sharealike", "share alike").replace("noncommercial", "non commercial").replace("noderivatives", "no derivatives"))
        for form in (f"cc {kind.replace('-', ' ')} {version}", *(f"creative commons {words}{license} {version}{tail}"
                     for license in ("", " license") for tail in ("", " international", " unported", " generic")))
    )) for version in CC_VERSIONS for kind, named in CC_KINDS),
)

# Identifiers of the GNU licences and their public names, the more special families first.
GNU_SPDX = (
    ("agpl3", "AGPL-3.0"), ("lgpl3", "LGPL-3.0"), ("lgpl21", "LGPL-2.1"), ("lgpl2", "LGPL-2.0"), ("gpl3", "GPL-3.0"), ("gpl2", "GPL-2.0"), ("gpl1", "GPL-1.0"),
)

# The rules in order, a licence and the identifiers in their order; ? marks one that may be missing.
RULES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "apache2-title apache2? comply? apache2-copy? apache-as-is? see-license?"),
    ("Apache-2.0", "apache2 comply? apache2-copy? apache-as-is? see-license?"),
    ("Apache-2.0", "comply? apache2-copy apache-as-is? see-license?"),
    ("MIT", "mit? rights? mit-grant mit-notice? as-is? liability?"),
    ("MIT", "mit"),
    ("BSL-1.0", "boost1? boost-grant as-is? liability?"),
    ("BSL-1.0", "boost1"),
    ("BSD-4-Clause", "rights? bsd-use bsd-source? bsd-binary? bsd-advert bsd-names? bsd-as-is? liability?"),
    ("BSD-3-Clause", "bsd3? rights? bsd-use bsd-source? bsd-binary? bsd-names bsd-as-is? liability?"),
    ("BSD-2-Clause", "bsd2? rights? bsd-use bsd-source? bsd-binary? bsd-as-is? liability?"),
    ("BSD-4-Clause", "bsd4"),
    ("BSD-3-Clause", "bsd3"),
    ("BSD-2-Clause", "bsd2"),
    # the text of a licence, with the notice that it offers at its end
    *((f"{spdx}-only", f"{name}-title verbatim? new-programs? {name}-grant? gpl-no-warranty? gpl-details? gpl-copy?") for name, spdx in GNU_SPDX),
    *((f"{spdx}-or-later", f"{name}-grant gpl-no-warranty? gpl-details? gpl-copy?") for name, spdx in GNU_SPDX),
    *((f"{spdx}-only", f"{name}-only-grant gpl-no-warranty? gpl-details? gpl-copy?") for name, spdx in GNU_SPDX),
    *((f"{spdx}-only", f"{name} gpl-no-warranty?") for name, spdx in GNU_SPDX),
    ("MPL-1.1", "mpl11 comply? mpl-copy? mpl-as-is? mpl-rights?"),
    ("MPL-1.0", "mpl10 comply? mpl-copy? mpl-as-is? mpl-rights?"),
    ("MPL-2.0", "mpl2 mpl2-copy?"),
    ("EPL-2.0", "epl2-title? epl2"),
    ("EPL-2.0", "epl2-title"),
    ("EPL-1.0", "epl1"),
    ("CDDL-1.0", "cddl1"),
    ("EUPL-1.2", "eupl12"),
    ("Artistic-2.0", "artistic2"),
    ("ISC", "isc? rights? isc-grant as-is? liability?"),
    ("ISC", "isc"),
    ("0BSD", "bsd0? 0bsd-grant as-is? liability?"),
    ("0BSD", "bsd0"),
    ("Zlib", "zlib? zlib-as-is? liability? zlib-grant"),
    ("Zlib", "zlib"),
    ("Unlicense", "unlicense as-is? liability?"),
    ("CC0-1.0", "cc0"),
    *((f"CC-{kind.upper()}-{version.replace(' ', '.')}", f"cc-title? cc-{kind}-{cc_label(version)}") for version in CC_VERSIONS for kind, _ in CC_KINDS),
    ("MIT-0", "mit0"),
    ("WTFPL", "wtfpl"),
    ("PostgreSQL", "postgresql"),
    ("NCSA", "ncsa"),
    ("OFL-1.1", "ofl11"),
    ("Python-2.0", "python2"),
    ("MS-PL", "ms-pl"),
    ("ODbL-1.0", "odbl1"),
    ("CECILL-2.1", "cecill21"),
    ("BUSL-1.1", "busl11"),
    ("Classpath-exception-2.0", "classpath"),
    ("GCC-exception-3.1", "gcc-exception"),
    ("LLVM-exception", "llvm-exception"),
    ("Linux-syscall-note", "syscall-note"),
    ("Public-Domain", "public-domain"),
    ("All-Rights-Reserved", "rights"),
)

#: A sentence that says under which licence something is, or a line with an SPDX expression: the names are the first group.
STATEMENT = (
    "^(?:(?:(?:this|the) [a-z]{1,30} is |(?:it |this )?is )?(?:dual )?(?:licensed|released|distributed|available|published|dedicated) (?:under|to) "
    "(?:the terms of )?|(?:[a-z0-9]{1,4} )?spdx license identifier )([a-z0-9 ]{2,240}?)(?: license)?"
    "(?: the license| see [a-z0-9 ]{1,80}| at your option| which [a-z0-9 ]{1,80})*$"
)
#: Between the names of a statement, and what may stand before a name and after it.
CONNECTIVE = " (?:and|or|with) (?:under )?"
AROUND = "^(?:(?:either|both|of|the|an?) )+| license$"
#: Later versions, without the connective.
LATER = " or (?:at your option )?(?:any )?later(?: versions?)?"
#: A text without any of these words, whatever stands between them, holds no known sentence.
HINT = (
    r"(?i)licen[cs]e|permission|warrant|redistribut|unencumbered|CC0|liable|copyright[^a-z0-9]+notice|all[^a-z0-9]+rights[^a-z0-9]+reserved"
    r"|public[^a-z0-9]+domain|advertising[^a-z0-9]+materials|conditions[^a-z0-9]+are[^a-z0-9]+met|copy[^a-z0-9]+of[^a-z0-9]+the[^a-z0-9]+mpl"
    r"|new[^a-z0-9]+(?:programs|libraries)|creative[^a-z0-9]+commons|(?:released|distributed|available|published|dedicated)[^a-z0-9]+(?:under|to)[^a-z0-9]"
)
#: Sentences end at a blank line, or at a mark that white space follows.
ENDS = r"(?<=[.!?:;])[\x20\x09-\x0D]+|\n[\x20\x09\r]*\n"
#: Full stops that end no sentence.
ABBREVIATION = r"(?i)\b(inc|ltd|co|corp|llc|v)\."
BETWEEN = r"[^a-z0-9]+"
#: Where the notices of older GNU licences have a semicolon before the version.
FOUNDATION = r"(?i)\b(foundation);"
#: A copyright line is a sentence of its own, full stop or not.
COPYRIGHT = r"(?mi)^([\x20\x09]*copyright[^\n]*)$"


#: An SPDX expression is a sentence of its own, to the end of its line.
SPDX = r"(?i)(SPDX-License-Identifier)[\x20\x09]*:[\x20\x09]*([^\n]*)"
#: The files that a dual licence's names are followed by.
FILES = r"<LICENSE-[^<>]{0,200}>"
#: A version and all later ones.
PLUS = r"([0-9])\+"


def normalised(sentence: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace(sentence, PLUS, "$1 or later")), BETWEEN, " "))
    return F.regexp_replace(words, "licence", "license")


def _looked_up(table: tuple[tuple[str, tuple[str, ...]], ...], words: Column) -> Column:
    forms = {form: name for name, known in reversed(table) for form in known}
    return F.try_element_at(F.str_to_map(F.lit("\n".join(map("\t".join, forms.items()))), F.lit("\n"), F.lit("\t")), words)


def _identifiers(words: Column) -> Column:
    """Of a statement the licences named in it; else the sentence itself; else the first pattern that it matches; null if unknown."""
    names = F.split(F.regexp_replace(F.regexp_extract(words, STATEMENT, 1), LATER, " orlater"), CONNECTIVE, -1)
    named = F.filter(F.transform(names, lambda x: _looked_up(NAMES, F.regexp_replace(x, AROUND, ""))), lambda x: x.isNotNull())
    patterns = [F.when(words.rlike(f"^(?:{pattern})$"), F.lit(name)) for name, pattern in PATTERNS]
    single = F.coalesce(_looked_up(SENTENCES, words), *patterns)
    known = F.when(words.rlike(STATEMENT) & (F.size(named) > 0), named).otherwise(F.filter(F.array(single), lambda x: x.isNotNull()))
    return F.when(words != "", known).otherwise(F.array().cast("array<string>"))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; a statement has one for each licence that it names.

    A sentence that runs over several lines is looked up as a whole first; if it is not known, its
    lines are, so that a line without a full stop is recognised too. (A known sentence over several
    lines that follows words without a mark or a blank line between them is not.)
    """
    def by_words(sentences: Column) -> Column:
        return F.transform(F.transform(sentences, normalised), _identifiers)

    def ids(sentence: Column) -> Column:
        """An array of one, so that each step is evaluated once."""
        lines = F.when(F.contains(sentence, F.lit("\n")), F.flatten(by_words(F.split(sentence, "\n", -1))))
        return F.transform(by_words(F.array(sentence)), lambda whole: F.when(F.size(whole) > 0, whole).otherwise(lines))[0]

    apart = F.regexp_replace(F.regexp_replace(text, FILES, " "), SPDX, "\n\n$1 $2\n\n")
    apart = F.regexp_replace(F.regexp_replace(apart, COPYRIGHT, "$1\n"), ABBREVIATION, "$1 ")
    apart = F.regexp_replace(apart, FOUNDATION, "$1,")
    found = F.flatten(F.filter(F.transform(F.split(apart, ENDS, -1), ids), lambda x: x.isNotNull()))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


GAP = "|"


def rule_pattern(rule: str) -> str:
    """Each identifier between spaces of its own; GAP is left where a rule has taken some out."""
    return "".join(f"(?: {x[:-1]} )?" if x.endswith("?") else f" {x} " for x in rule.split())


def licences_of(sentences: Column) -> Column:
    """The licences whose rules match, in the rules' order; a rule's pattern is looked for only where the first identifier that it needs is there."""
    none = F.array().cast("array<string>")
    needed = [next(x for x in rule.split() if not x.endswith("?")) for _, rule in RULES]
    rules = F.array(*[F.array(F.lit(licence), F.lit(f" {first} "), F.lit(rule_pattern(rule))) for (licence, rule), first in zip(RULES, needed)])
    rest = F.array_join(F.transform(sentences, lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")

    def step(state: Column, rule: Column) -> Column:
        there = F.contains(state["rest"], rule[1]) & F.regexp(state["rest"], rule[2])
        left = F.regexp_replace(state["rest"], rule[2], F.lit(GAP))
        return F.when(there, F.struct(left.alias("rest"), F.concat(state["hits"], F.array(rule[0])).alias("hits"))).otherwise(state)

    found = F.aggregate(rules, F.struct(rest.alias("rest"), none.alias("hits")), step, lambda state: F.array_distinct(state["hits"]))
    return F.when(F.size(sentences) > 0, found).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """_row (all columns of ``docs``), _sentences (identifiers in order), _licences (the rules that match, in their order).

    A null text has no sentences; a text of any length is read whole; rows that repeat, or differ in
    other columns only, get equal results; of rules that match the same sentences the first has
    them; an empty table gives an empty result; other columns, whatever their names, pass through in
    _row.
    """
    found = F.coalesce(sentence_ids(F.col("text")), F.array().cast("array<string>"))
    rows = boxed(docs, found.alias("_sentences"))
    return rows.select("_row", "_sentences", licences_of(F.col("_sentences")).alias("_licences"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of the whole ``documents`` table."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "_row.doc_id",
        F.array_join("_sentences", " ").alias("sentences"),
        F.array_join("_licences", " ").alias("licences"),
        F.size("_licences").cast("long").alias("n_licences"),
    )


def _sql_map(table: tuple[tuple[str, tuple[str, ...]], ...]) -> str:
    forms = {form: name for name, known in reversed(table) for form in known}
    return f"map([{', '.join(map(repr, forms))}], [{', '.join(map(repr, forms.values()))}])"


def _oracle() -> str:
    patterns = " ".join(f"when regexp_full_match(w, '{pattern}') then '{name}'" for name, pattern in PATTERNS)
    steps, hits = [], []
    for i, (licence, rule) in enumerate(RULES):
        before = "start" if i == 0 else f"r{i - 1}"
        pattern = rule_pattern(rule)
        steps.append(
            f"r{i} as (select * exclude (rest), case when regexp_matches(rest, '{pattern}') then '{licence}' end as hit{i},"
            f" regexp_replace(rest, '{pattern}', '{GAP}', 'g') as rest from {before})"
        )
        hits.append(f"hit{i}")
    words = f"replace(trim(regexp_replace(lower(regexp_replace({{0}}, '{PLUS}', '\\1 or later', 'g')), '{BETWEEN}', ' ', 'g')), 'licence', 'license')"
    parts = f"string_split_regex(regexp_replace(regexp_extract(w, '{STATEMENT}', 1), '{LATER}', ' orlater', 'g'), '{CONNECTIVE}')"
    found = f"array_to_string(case when len(named) > 0 then named else [coalesce(k.name, case {patterns} end)] end, ' ')"

    def looked_up(rows: str) -> str:
        named = f"list_filter(list_transform({parts}, lambda x: m.names[regexp_replace(x, '{AROUND}', '', 'g')]), lambda x: x is not null)"
        return f"select s.*, nullif({found}, '') as name from (select s.*, {named} as named from ({rows}) s, m) s left join known k on k.form = w"

    known = ", ".join(f"('{form}', '{name}')" for name, forms in SENTENCES for form in forms)
    apart = f"regexp_replace(regexp_replace(text, '{FILES}', ' ', 'g'), '{SPDX}', chr(10) || chr(10) || '\\1 \\2' || chr(10) || chr(10), 'g')"
    apart = f"regexp_replace(regexp_replace({apart}, '{COPYRIGHT}', '\\1' || chr(10), 'g'), '{ABBREVIATION}', '\\1 ', 'g')"
    apart = f"regexp_replace({apart}, '{FOUNDATION}', '\\1,', 'g')"
    return rf"""
with known(form, name) as (values {known}), m as (select {_sql_map(NAMES)} as names),
d as (select row_number() over () as r, doc_id, text from documents),
s0 as (select r, string_split(regexp_replace({apart}, '([.!?:;])[\x20\x09-\x0D]+|\n[\x20\x09\r]*\n', '\1' || chr(1), 'g'), chr(1)) as parts
    from d where regexp_matches(text, '{HINT}')),
s1 as (select r, unnest(parts) as part, unnest(range(len(parts))) as p from s0),
s2 as ({looked_up(f"select *, {words.format('part')} as w from s1")}),
s3 as (select r, p, 0 as q, name from s2 where name is not null),
l1 as (select r, p, unnest(string_split(part, chr(10))) as line, unnest(range(len(string_split(part, chr(10))))) as q from s2 where name is null),
l2 as ({looked_up(f"select *, {words.format('line')} as w from l1")}),
ids as (select r, string_agg(name, ' ' order by p, q) as sentences from (select * from s3 union all select r, p, q, name from l2 where name is not null) group by r),
start as (select d.r, d.doc_id, coalesce(i.sentences, '') as sentences, coalesce(' ' || replace(i.sentences, ' ', '  ') || ' ', '') as rest from d left join ids i using (r)),
{", ".join(steps)},
f as (select doc_id, sentences, list_filter([{", ".join(hits)}], lambda x: x is not null) as found from r{len(RULES) - 1}),
g as (select doc_id, sentences, list_filter(found, lambda x, i: list_position(found, x) = i) as found from f)
select doc_id, sentences, array_to_string(found, ' ') as licences, len(found)::bigint as n_licences from g
"""


ORACLE = _oracle()
