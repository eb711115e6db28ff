"""6. License scans [native]: sentence rules.

A text's sentences are normalised and mapped to the identifiers of known licence
sentences; a document's identifiers in order are then matched against rules, each
an ordered list of identifiers with gaps allowed between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Known licence sentences by identifier: fixed values, normalised as `normalise` does.
SENTENCES: dict[str, tuple[str, ...]] = {
    "copyright": ("copyright notice",),
    "reserved": ("all rights reserved",),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-asis": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache-asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "gpl-free3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-free2": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "mpl2-name": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "public-domain": ("released into the public domain", "this work is in the public domain", "this work has been dedicated to the public domain"),
}

_GNU = {"gpl": "general", "lgpl": "lesser general", "agpl": "affero general"}
_CC = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}


def _gnu(short: str, version: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    major, spdx = version.split()[0] if version.endswith(" 0") else version, f"{short} {version}"
    versions = dict.fromkeys(f"{v}{n}{later}" for v in ("version ", "v", "v ", "") for n in (version, major) for later in ("", " or later", " or any later version", " only"))
    names = (short, f"gnu {short}")
    return tuple(f"gnu {_GNU[short]} public license {v}" for v in versions), (*(f"{n} {v}" for n in names for v in versions), *(f"{n}v{major}" for n in names)), (spdx, f"{spdx} only", f"{spdx} or later")


def _cc(kind: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    name = f"creative commons {' '.join(_CC[k] for k in kind.split())} 4 0 international"
    return (f"{name} license", f"cc {kind} 4 0 license", f"cc {kind} 4 0 international license"), (name, f"cc {kind} 4 0", f"cc {kind} 4 0 international"), (f"cc {kind} 4 0",)


#: Names of licences by identifier: such as are a sentence by themselves or after a lead, short ones that need a lead with a verb, and SPDX identifiers.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "mit-name": (("mit license", "mit license mit"), ("mit",), ("mit",)),
    "isc-name": (("isc license",), ("isc",), ("isc",)),
    "apache-name": (("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache license v2 0", "apache 2 0 license"), ("apache 2 0",), ("apache 2 0",)),
    "bsd2-name": (("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"), ("bsd 2 clause",), ("bsd 2 clause",)),
    "bsd3-name": (("bsd 3 clause license", "3 clause bsd license", "modified bsd license", "new bsd license"), ("bsd 3 clause",), ("bsd 3 clause",)),
    "gpl3-name": _gnu("gpl", "3 0"), "gpl2-name": _gnu("gpl", "2 0"), "lgpl3-name": _gnu("lgpl", "3 0"), "lgpl21-name": _gnu("lgpl", "2 1"), "agpl3-name": _gnu("agpl", "3 0"),
    "mpl2-name": (tuple(f"mozilla public license {v}" for v in ("version 2 0", "v 2 0", "v2 0", "2 0")), ("mpl 2 0",), ("mpl 2 0",)),
    "epl2-name": (tuple(f"eclipse public license {v}" for v in ("version 2 0", "v 2 0", "v2 0", "2 0")), ("epl 2 0",), ("epl 2 0",)),
    "unlicense": ((), ("unlicense",), ("unlicense",)),
    "cc0-name": ((), ("cc0 1 0", "cc0 1 0 universal", "cc0"), ("cc0 1 0",)),
    **{f"cc-{kind.replace(' ', '-')}-name": _cc(kind) for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")},
}

#: Words of a lead before a name: "this project is licensed under the terms of the", of which each part may be missing.
THINGS = ("project", "software", "work", "code", "file", "package", "library", "program", "repository", "document")
VERBS = ("licensed", "released", "distributed", "available", "published", "provided")
SPDX = "spdx license identifier "

#: Licence rules: the identifiers that must follow each other, others may stand between. A licence with several rules needs one of them.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-name",)), ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("ISC", ("isc-name",)), ("ISC", ("isc-grant", "isc-asis")),
    ("Apache-2.0", ("apache-name",)), ("Apache-2.0", ("apache-comply", "apache-asis", "apache-see")),
    ("BSD-2-Clause", ("bsd2-name",)), ("BSD-3-Clause", ("bsd3-name",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0", ("gpl3-name",)), ("GPL-3.0", ("gpl-free3", "gpl-hope")), ("GPL-2.0", ("gpl2-name",)), ("GPL-2.0", ("gpl-free2", "gpl-hope")),
    ("LGPL-3.0", ("lgpl3-name",)), ("LGPL-2.1", ("lgpl21-name",)), ("AGPL-3.0", ("agpl3-name",)), ("MPL-2.0", ("mpl2-name",)), ("EPL-2.0", ("epl2-name",)),
    ("Unlicense", ("unlicense",)), ("Public-Domain", ("public-domain",)), ("CC0-1.0", ("cc0-name",)), ("CC-BY-4.0", ("cc-by-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-name",)), ("CC-BY-NC-4.0", ("cc-by-nc-name",)), ("CC-BY-ND-4.0", ("cc-by-nd-name",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-name",)), ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-name",)), ("All-Rights-Reserved", ("reserved",)),
)

#: One of these stands in each known sentence, so a text without them has none; checked below.
MARKS = ("licens", "copyright", "rights reserved", "warrant", "permi", "redistribut", "public domain", "liable", "cc0")

_IDS = tuple(dict.fromkeys([*SENTENCES, *NAMES]))
_FULL, _SHORT, _SPDX = ([(n, _IDS.index(k)) for k, v in NAMES.items() for n in v[i]] for i in range(3))
_SAID = [(s, _IDS.index(k)) for k, v in SENTENCES.items() for s in v]
_TEXTS = tuple(dict([*_SPDX, *_SHORT, *_FULL, *_SAID]).items())
assert all(any(m in s for m in MARKS) for s, _ in [*_SAID, *_FULL])


def _tree(sentences: list[str]) -> str:
    """The sentences as one pattern, a tree by words. Words are parted by a space or a line feed; the longest sentence wins, and each ends before a line feed."""
    tree: dict = {}
    for sentence in sentences:
        node = tree
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = ["[ \\n]" + word + pattern(rest) for word, rest in node.items() if word] + ["(?=\\n)"] * ("" in node)
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return "(?:" + "|".join(word + pattern(rest) for word, rest in tree.items()) + ")"


_ARTICLE = "(?:the |an? )?"
_VERB = f"(?:(?:this|the) (?:{'|'.join(THINGS)}) is )?(?:{'|'.join(VERBS)}) under (?:the terms of )?{_ARTICLE}"
_LEAD = f"(?:{_VERB}|{_ARTICLE})"
_ONE = "(?:" + "|".join(sorted((s for s, _ in _SPDX), key=len, reverse=True)) + ")"
_LIST = f"{SPDX}{_ONE}(?: (?:or|and) {_ONE})*"


def _start() -> str:
    parted = lambda pattern: pattern.replace(" ", "[ \\n]")
    full, short, said = (_tree([s for s, _ in x]) for x in (_FULL, _SHORT, _SAID))
    return f"(?<=\\n)(?=(copyright[ \\n](?:c[ \\n])?(?:19|20)[0-9]{{2}}\\b|{parted(_LIST)}(?=\\n)|{parted(_LEAD)}{full}|{parted(_VERB)}{short}|{said}))"


#: Where a unit starts: a dated or (c) copyright line, a list of SPDX identifiers, a lead and a name, or a known sentence.
_START = _start()


def normalise(text: Column) -> Column:
    """Lower case; each run of anything but letters and digits is one space, or one line feed where a sentence or line may end in it; a line feed at either end."""
    ends = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text), F.lit("\n")), "[.!?;:]\\s", "\n")
    return F.regexp_replace(F.regexp_replace(ends, "[^\\p{L}\\p{N}\\n]+", " "), " ?\\n[ \\n]*", "\n")


def sentence_ids(text: Column) -> Column:
    """array<int> of the known sentences in a text, in order; of a list of SPDX identifiers, one for each.

    Sentences may end at .!?;: before white space, or at a line's end. A known one starts and ends at such a place and may run over any
    number of them, so wrapped ones and those with a mark inside are found; where several start, the longest counts.
    """
    known = F.array(*[F.lit(s) for s, _ in _TEXTS])
    number = F.array(*[F.lit(n) for _, n in _TEXTS])

    def number_of(part: Column) -> Column:
        # what is no known sentence or name is a dated copyright line
        at = F.array_position(known, part)
        return F.when(at > 0, F.get(number, (at - 1).cast("int"))).otherwise(F.lit(_IDS.index("copyright")))

    def parts(hit: Column) -> Column:
        listed = F.split(F.substring(hit, F.lit(len(SPDX) + 1), F.char_length(hit)), " (?:or|and) (?!later)")
        return F.when(hit.startswith(SPDX), listed).when(F.array_contains(known, hit), F.array(hit)).otherwise(F.array(F.regexp_replace(hit, "^" + _LEAD, "")))

    def numbers_of(hits: Column) -> Column:
        return F.transform(F.flatten(F.transform(hits, lambda hit: let(F.translate(hit, "\n", " "), parts))), number_of)

    low = F.lower(text)
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(low, F.lit(m))
    # words of a mark may be parted by a line's end or by punctuation
    marked = marked | low.rlike("rights[\\W_]+reserved|public[\\W_]+domain|(?:" + "|".join(VERBS) + ")[\\W_]+under")
    return F.when(marked, numbers_of(F.regexp_extract_all(normalise(text), F.lit(_START), 1))).otherwise(F.array().cast("array<int>"))


def licenses_of(ids: Column) -> Column:
    """array<string> of the licences whose rule the identifiers meet, in the order of RULES."""
    line = F.concat(F.lit(" "), F.array_join(F.transform(ids, lambda i: i.cast("string")), " "), F.lit(" "))
    found = [F.when(line.rlike(".* ".join(f" {_IDS.index(k)}" for k in rule).replace(".*  ", ".* ") + " "), F.lit(name)) for name, rule in RULES]
    names = F.array_distinct(F.array_compact(F.array(*found)))
    # the longer rule of the family includes the shorter
    return F.when(F.array_contains(names, "BSD-3-Clause") & ~line.rlike(f" {_IDS.index('bsd2-name')} "), F.array_remove(names, "BSD-2-Clause")).otherwise(names)


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_sentences, sentences and licenses (names joined by commas).

    A null or empty text has none. Every row of docs gives one row; repeated rows give equal ones, and other columns are not read.
    """
    rows = docs.select("doc_id", let(sentence_ids(F.coalesce("text", F.lit(""))), lambda ids: F.struct(ids.alias("ids"), F.when(F.size(ids) > 0, licenses_of(ids)).otherwise(F.array().cast("array<string>")).alias("found"))).alias("_r"))
    names = F.array(*[F.lit(k) for k in _IDS])
    return rows.select("doc_id", F.size("_r.ids").cast("long").alias("n_sentences"), F.array_join(F.transform("_r.ids", lambda i: F.get(names, i)), ",").alias("sentences"), F.array_join("_r.found", ",").alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
