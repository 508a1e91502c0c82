"""Licence scans by sentence rules: known sentences become identifiers, ordered rules read their sequence.

A text is cut into sentences (at line ends, and after . ; : ! ? before white space). Known sentences
that are wrapped, or begin behind a list mark, are found as well: a sentence may go on over single line
ends, to where one ends. A sentence is
normalised (lower case, runs of anything but letters and digits become one space) and looked up in
the known sentences. Of the identifiers found, in order, each rule takes its sequence wherever it
stands side by side, longer and more specific rules first; what a rule took is gone for the later
ones. Identifiers that no rule takes are counted.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import small_batches, with_columns

#: Fixed: known sentences, normalised, by identifier.
SENTENCES = {
    **{f"apache{v}": [f"licensed under the apache license version {v[0]} {v[2]}", f"this work is licensed under the apache license version {v[0]} {v[2]}", f"licensed under the apache license version {v[0]} {v[2]} the license"] for v in ("1.1", "2.0")},
    **{f"gpl{v}": [f"this work is licensed under the gnu general public license version {v}", f"licensed under the gnu general public license version {v}", f"released under the gnu general public license version {v}"] for v in ("2", "3")},
    **{f"lgpl{v}": [f"this work is licensed under the gnu lesser general public license version {v}", f"licensed under the gnu lesser general public license version {v}"] for v in ("2 1", "3")},
    **{f"cc-{k.replace(' ', '-')}-{v[0]}.0": [f"licensed under cc {k} {v[0]} 0", f"this work is licensed under cc {k} {v[0]} 0"] for k in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("3.0", "4.0")},
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mit-name": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "bsd-terms": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache-header": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache-unless": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "agpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl-free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "mpl2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-disclaimer": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "cc0-waiver": ["to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "this work is marked with cc0 1 0", "licensed under cc0 1 0"],
    "unlicense": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "epl2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "all-rights": ["all rights reserved"],
    "public-domain": ["this is free and unencumbered software released into the public domain", "this work is released into the public domain"],
}
#: Ordered rules: a licence and the sentences, side by side, that state it.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-grant", "mit-notice")), ("BSD-2-Clause", ("all-rights", "bsd-terms", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-terms", "bsd-source", "bsd-binary")), ("ISC", ("isc-grant", "isc-disclaimer")), ("ISC", ("isc-grant",)), ("Zlib", ("zlib-as-is", "zlib-grant")), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("bsl-grant",)),
    ("Apache-2.0", ("apache-header", "apache-unless")), ("Apache-2.0", ("apache-header",)), ("AGPL-3.0-or-later", ("agpl-free",)), ("LGPL-2.1-or-later", ("lgpl-free",)), ("GPL-2.0-or-later", ("gpl2-free",)), ("MPL-2.0", ("mpl2",)), ("EPL-2.0", ("epl2",)), ("Unlicense", ("public-domain", "unlicense")), ("Unlicense", ("unlicense",)), ("CC0-1.0", ("cc0-waiver",)), ("GPL-3.0-or-later", ("gpl-free",)), ("GPL-2.0-only", ("gpl2",)), ("GPL-3.0-only", ("gpl3",)), ("LGPL-2.1-only", ("lgpl2 1",)), ("LGPL-3.0-only", ("lgpl3",)),
    ("Apache-1.1", ("apache1.1",)), ("Apache-2.0", ("apache2.0",)), *((k.upper(), (k,)) for k in SENTENCES if k.startswith("cc-")), ("MIT", ("mit-name",)), ("Public-domain", ("public-domain",)), ("Proprietary", ("all-rights",)),
]
#: What the SQL, which cuts at line ends alone, does not have: the third BSD clause and its rules, which come first.
_BSD_NAME = re.compile(r"neither the names? of .{1,120} nor the names of (?:(?:its|their|any|other) )?contributors may be used to endorse or promote products derived from this software without specific prior written permission").fullmatch
MORE_RULES = [("BSD-3-Clause", ("all-rights", "bsd-terms", "bsd-source", "bsd-binary", "bsd-name")), ("BSD-3-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-name"))]
KNOWN = {s: k for k, rows in SENTENCES.items() for s in rows}
#: A word of each known sentence without which a text holds none of them.
_HINT = re.compile(r"licens|all[\W_]+rights|permission|redistribut|warrant|public[\W_]+domain|free[\W_]+(?:software|to[\W_]+copy)|cc0", re.I).search
#: What a known sentence begins with, word by word.
_BEGUN, _LONGEST = {" ".join(s.split()[:n]) for s in KNOWN for n in range(1, len(s.split()))}, max(len(s.split()) for s in KNOWN)
#: A paragraph's end, a list mark or comment sign that begins a line, and the sentence ends that are no line ends.
_PARAGRAPH, _MARK = re.compile(r"\n[^\S\n]*(?:(?://+|[#*;]+|--)[^\S\n]*)?(?=\n)"), re.compile(r"^\s*(?:(?://+|/\*+|[#*;]+|--)\s*)?(?:(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|[-*])\s+)?", re.I)
_CUT, _WORDS = re.compile(r"\n|(?<=[.;:!?])\s+"), re.compile(r"[^a-z0-9]+")


def identifiers(text: str) -> list[str]:
    """Known sentences of a text, in order: those that are whole lines' sentences, and those wrapped over lines."""
    if not _HINT(text):
        return []
    found = []
    for paragraph in _PARAGRAPH.split(text):
        lines = [_CUT.split(line) for line in paragraph.split("\n")]
        # (normalised sentence, without a mark that begins its line)
        parts = [(_norm(s), _norm(_MARK.sub("", s) if i == 0 else s)) for line in lines for i, s in enumerate(line)]
        i = 0
        while i < len(parts):
            whole, bare = parts[i]
            k, i = (_known(whole) or _known(bare), i + 1)
            if k is None:
                k, i = _wrapped(parts, i - 1)
            if k is not None:
                found.append(k)
    return found


def _norm(s: str) -> str:
    return _WORDS.sub(" ", s.lower()).strip()


def _known(words: str) -> str | None:
    return KNOWN.get(words) or ("bsd-name" if words.startswith("neither the name") and _BSD_NAME(words) else None)


def _wrapped(parts: list[tuple[str, str]], i: int) -> tuple[str | None, int]:
    """The known sentence that starts with part i and goes on over line ends or over marks inside it, and the part after it; or None and the next part."""
    words, j = parts[i][1], i
    while (words in _BEGUN or words.startswith("neither the name")) and j + 1 < len(parts) and words.count(" ") < _LONGEST:
        j += 1
        words = f"{words} {parts[j][1]}".strip()
        if k := _known(words):
            return k, j + 1
    return None, i + 1


def apply_rules(found: list[str]) -> tuple[list[str], int]:
    """The licences stated, in the order of the rules, and how many sentences no rule took."""
    line, out = "|" + "".join(f"{k}||" for k in found), []
    for name, rule in MORE_RULES + RULES:
        want = "|" + "||".join(rule) + "|"
        if want in line:
            line = line.replace(want, "|/|")
            if name not in out:
                out.append(name)
    return out, sum(1 for k in line.split("|") if k and k != "/")


def scan_licenses(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``carry`` columns of each row, licenses (joined by commas, in the order of the rules), n_sentences (known ones) and n_unruled.

    Null and empty texts state none. A sentence is only known if it is whole. Repeated rows give
    equal results; no rows give none. Texts are read whole.
    """
    small_batches(docs.sparkSession, 5000)
    names, types = list(carry), dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            licenses, n, rest = [], [], []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                found = identifiers(text or "")
                stated, left = apply_rules(found)
                licenses.append(",".join(stated)), n.append(len(found)), rest.append(left)
            yield with_columns(batch, names, {"licenses": pa.array(licenses, pa.string()), "n_sentences": pa.array(n, pa.int64()), "n_unruled": pa.array(rest, pa.int64())})

    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + ["licenses string, n_sentences long, n_unruled long"])
    return docs.select(*dict.fromkeys((*names, text_col))).mapInArrow(run, schema)


def oracle() -> str:
    """DuckDB SQL for the same rows of ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(k)})" for s, k in KNOWN.items())
    steps, last = [], "line"
    for i, (_, rule) in enumerate(RULES):
        want = quote("|" + "||".join(rule) + "|")
        steps.append(f"s{i} AS (SELECT *, replace(l{i}, {want}, '|/|') AS l{i + 1}, contains(l{i}, {want}) AS h{i} FROM {'base' if not i else f's{i - 1}'})")
        last = f"l{i + 1}"
    order = list(dict.fromkeys(name for name, _ in RULES))
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'h{i}' for i, (n, _) in enumerate(RULES) if n == name)} THEN {quote(name)} END" for name in order)
    return f"""WITH known(sentence, ident) AS (VALUES {known}),
cut AS (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.;:!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
sentences AS (SELECT rid, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part FROM cut),
hits AS (SELECT rid, pos, ident FROM sentences JOIN known ON trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) = sentence),
base AS (SELECT c.doc_id, count(h.ident) AS n_sentences, '|' || coalesce(string_agg(h.ident || '||', '' ORDER BY h.pos), '') AS l0 FROM cut c LEFT JOIN hits h USING (rid) GROUP BY c.rid, c.doc_id),
{', '.join(steps)}
SELECT doc_id, concat_ws(',', {cases}) AS licenses, n_sentences, len(list_filter(string_split({last}, '|'), lambda x: x <> '' AND x <> '/'))::BIGINT AS n_unruled FROM s{len(RULES) - 1}"""
