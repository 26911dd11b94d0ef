"""Licence scan by sentence rules, in DataFrame expressions only.

A text is cut into sentences (at line breaks and at ``. ! ? ;`` before white space or the end). Sentences are
normalised: ASCII lower case, ``licence`` spelt ``license``, everything but letters and digits to single blanks. A
normalised sentence equal to a known licence sentence becomes that sentence's identifier. A known sentence wrapped over
several lines counts as one: lines are joined where together they are a known sentence, so wrapped notices, also behind
comment marks, are found, and a reference on a line of its own still is. Blank lines are never joined over. The identifiers of a
document, in text order, form a sequence, and the ordered rules are matched against it: the first rule takes
its identifiers out wherever they stand next to each other, then the second, and so on, so a longer grant is named before
a sentence that is also a rule of its own. Identifiers that no rule took are counted as unmatched, and sentences that speak
of a licence but are not known are counted as unknown.

The whole-text cue test before the sentence split only skips texts in which no sentence can be known or unknown:
every known sentence holds a cue, and unknown ones are defined by holding one.

Skew: work is per document; nothing is grouped, joined or shuffled. Defined results: a null or empty text and a
text without licence sentences give ``licenses`` = ``NONE`` and zero counts; every input row gives one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in normal form, by identifier.
SENTENCES = {
    "apache2_ref": "licensed under the apache license version 2 0",
    "apache2_grant": "licensed under the apache license version 2 0 the license",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "as_is_basis": "unless required by applicable law or agreed to in writing software distributed under the license "
                   "is distributed on an as is basis without warranties or conditions of any kind either express or "
                   "implied",
    "mit_ref": "released under the mit license",
    "mit_ref2": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl2_ref": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation",
    "gpl_or_later": "either version 3 of the license or at your option any later version",
    "cc_by_nc4_ref": "licensed under cc by nc 4 0",
    "cc_by4_ref": "licensed under cc by 4 0",
    "cc_by_sa4_ref": "licensed under cc by sa 4 0",
    "cc0_ref": "dedicated to the public domain under cc0 1 0 universal license",
    "bsd_redist": "redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met",
    "mpl2_ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all_rights": "all rights reserved",
    # sentences of whole notices; ``|`` is a sentence end inside one ("v. 2.0"), ``*`` a holder's name
    "apache2_url": "http www apache org licenses license 2 0",
    "mit_grant_full": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                      "associated documentation files the software to deal in the software without restriction "
                      "including without limitation the rights to use copy modify merge publish distribute sublicense "
                      "and or sell copies of the software and to permit persons to whom the software is furnished to do "
                      "so subject to the following conditions",
    "as_is_full": "the software is provided as is without warranty of any kind express or implied including but not "
                  "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other "
                     "liability whether in an action of contract tort or otherwise arising from out of or in connection "
                     "with the software or the use or other dealings in the software",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
                  "the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of * nor the names of its contributors may be used to endorse or promote products "
                "derived from this software without specific prior written permission",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied "
                 "warranties including but not limited to the implied warranties of merchantability and fitness for a "
                 "particular purpose are disclaimed|in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages "
                 "including but not limited to procurement of substitute goods or services|loss of use data or profits|or "
                 "business interruption however caused and on any theory of liability whether in contract strict liability "
                 "or tort including negligence or otherwise arising in any way out of the use of this software even if "
                 "advised of the possibility of such damage",
    "mpl2_notice": "this source code form is subject to the terms of the mozilla public license v|2 0",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty|without even the "
                "implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu general public license for more details",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
} | {f"gpl{v}_{kind}": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     f"general public license as published by the free software foundation {tail}" for v in (2, 3) for kind, tail in (
         ("later", f"either version {v} of the license or at your option any later version"),
         ("only", f"version {v} of the license"))}
# Other spellings of these sentences, (identifier, sentence).
VARIANTS = (
    ("apache2_url", "https www apache org licenses license 2 0"),
    ("bsd_as_is", SENTENCES["bsd_as_is"].replace("the copyright holders and contributors as is", "* as is")),
    ("gpl_received", "you should have received a copy of the gnu general public license along with this program|if not see "
                     "http www gnu org licenses"),
    ("gpl_received", "you should have received a copy of the gnu general public license along with this program|if not see "
                     "https www gnu org licenses"),
    ("gpl_received", "you should have received a copy of the gnu general public license along with this program|if not "
                     "write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"),
    *((k, s.replace("software you", "software|you").replace("foundation ", f"foundation{stop}"))
      for k, s in SENTENCES.items() if k in ("gpl2_later", "gpl2_only", "gpl3_later", "gpl3_only") for stop in (" ", "|")),
    *((f"gpl{v}_only", f"this program is free software{stop}you can redistribute it and or modify it under the terms of the "
       f"gnu general public license version {v} as published by the free software foundation") for v in (2, 3) for stop in " |"),
)
# Ordered rules, a licence and the sentence identifiers that name it when they follow each other.
_GPL = (("GPL-2.0-or-later", "gpl2_later"), ("GPL-3.0-or-later", "gpl3_later"), ("GPL-2.0-only", "gpl2_only"),
        ("GPL-3.0-only", "gpl3_only"))
RULES = (
    ("Apache-2.0", ("apache2_grant", "apache2_comply", "apache2_copy", "apache2_url", "as_is_basis")),
    # a holder's "all rights reserved" above a permissive notice belongs to the notice
    *((name, (*head, *ids)) for head in (("all_rights",), ()) for name, ids in (
        ("MIT", ("mit_grant_full", "mit_notice", "as_is_full", "mit_liability")),
        ("MIT", ("mit_grant_full", "mit_notice")),
        ("MIT", ("mit_grant_full",)),
        ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_name", "bsd_as_is")),
        ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_name")),
        ("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_as_is")),
        ("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary")))),
    *((name, (grant, "gpl_hope", "gpl_details", "gpl_received")) for name, grant in _GPL),
    *((name, (grant,)) for name, grant in _GPL),
    ("MPL-2.0", ("mpl2_notice",)),
    ("Apache-2.0", ("apache2_grant", "apache2_comply", "apache2_copy", "as_is_basis")),
    ("Apache-2.0", ("apache2_grant", "apache2_comply")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_or_later")),
    ("Apache-2.0", ("apache2_ref",)),
    ("Apache-2.0", ("apache2_grant",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_ref2",)),
    ("MIT", ("mit_grant",)),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-2.0", ("gpl2_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_ref",)),
    ("CC-BY-4.0", ("cc_by4_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("MPL-2.0", ("mpl2_ref",)),
    ("Proprietary", ("all_rights",)),
)
#: A sentence speaks of a licence when its normal form holds one of these.
CUES = ("license", "copyright", "warranty", "permission", "rights reserved", "redistribut", "public domain",
        "under cc ")
#: The same cues in raw spelling, blanks standing for any run of other characters.
CUE_PATTERN = r"(?i)licen[sc]e|copyright|warranty|permission|rights[^a-z0-9]+reserved|redistribut|" \
              r"public[^a-z0-9]+domain|under[^a-z0-9]+cc[^a-z0-9]"
SENTENCE_END = r"[.!?;]+([ \t\n\r\f]|\z)"
#: Marks in a normalised text: a sentence end or blank line, and a recognised sentence (its identifier follows).
_STOP, _KNOWN = "\x01", "\x02"


def _marked(text: Column) -> Column:
    """The text in normal form, with ``\\n`` where a line wraps and ``_STOP`` at sentence ends, blank lines and both ends."""
    ends = F.regexp_replace(F.translate(text, _STOP, " "), SENTENCE_END, _STOP)
    lowered = F.translate(ends, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.regexp_replace(F.concat(F.lit(_STOP), lowered, F.lit(_STOP)), "[^a-z0-9\n\x01]+", " ")
    stops = F.regexp_replace(bare, "(?: ?[\n\x01]){2,} ?| ?\x01 ?", _STOP)
    return F.replace(F.regexp_replace(stops, " ?\n ?", "\n"), F.lit("licence"), F.lit("license"))


def _joined(marked: Column) -> Column:
    """Known sentences, however wrapped, as ``_KNOWN`` and their identifier, longest first."""
    forms = []
    for code, sentence in sorted([*SENTENCES.items(), *VARIANTS], key=lambda x: -len(x[1])):
        pattern = sentence.replace(" ", "[ \n]").replace("|", _STOP).replace("*", "[^\x01]+?")
        literal = max(sentence.replace("|", _STOP).split("*"), key=len)
        forms.append(F.struct(F.lit(literal.strip()).alias("literal"), F.lit(_KNOWN + code).alias("code"),
                              F.lit(f"(?<=[\n\x01]){pattern}(?=[\n\x01])").alias("pattern")))

    def replaced(text: Column, flat: Column) -> Column:
        return F.aggregate(F.array(*forms), text, lambda acc, f: F.when(
            flat.contains(f["literal"]), F.regexp_replace(acc, f["pattern"], f["code"])).otherwise(acc))

    # arrays of one element hold the text and its unwrapped form, so that each is computed once
    return F.flatten(F.transform(F.array(marked), lambda t: F.transform(
        F.array(F.translate(t, "\n", " ")), lambda flat: replaced(t, flat))))[0]


def _sentence_code(piece: Column) -> Column:
    """The identifier of a known sentence, ``?`` for an unknown one with a cue, else null."""
    cue = reduce(lambda a, b: a | b, [piece.contains(c) for c in CUES])
    return F.when(piece.startswith(_KNOWN), F.substring(piece, 2, 1 << 30)).when(cue, F.lit("?"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses, n_findings, n_unmatched, n_unknown, sentence_ids) per row of ``docs``. ``licenses`` lists the
    distinct licences found, sorted, joined by `` AND ``; ``sentence_ids`` is the sequence as text."""
    text = F.col(text_col).cast("string")
    cued = F.when(text.rlike(CUE_PATTERN), text)
    codes = F.transform(F.split(_joined(_marked(cued)), "[\n\x01]"), _sentence_code)
    found = F.coalesce(F.filter(codes, lambda c: c.isNotNull()), F.array().cast("array<string>"))
    df = docs.select(F.col(id_col), found.alias("_codes"))
    # every identifier stands between blanks of its own, so that neighbours can be taken out one after the other
    df = df.select(F.col(id_col), "_codes", F.concat_ws("", F.transform("_codes", lambda c: F.concat(
        F.lit(" "), c, F.lit(" ")))).alias("_left"))
    counts = []
    for i, (_, ids) in enumerate(RULES):
        run = "".join(f" {s} " for s in ids)
        taken = F.replace(F.col("_left"), F.lit(run), F.lit(" # "))
        shrunk = F.length("_left") - F.length(taken)
        df = df.select(F.col(id_col), "_codes", *counts, (shrunk / (len(run) - 3)).cast("int").alias(f"_n{i}"),
                       taken.alias("_left"))
        counts.append(f"_n{i}")
    names = sorted({name for name, _ in RULES})
    hits = {name: reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i, (n, _) in enumerate(RULES) if n == name])
            for name in names}
    listed = F.concat_ws(" AND ", *[F.when(hits[n] > 0, F.lit(n)) for n in names])
    unknown = F.size(F.filter("_codes", lambda c: c == "?"))
    rest = F.filter(F.split(F.col("_left"), " +"), lambda c: (c != "") & (c != "?") & (c != "#"))
    return df.select(
        F.col(id_col), F.when(listed == "", F.lit("NONE")).otherwise(listed).alias("licenses"),
        reduce(lambda a, b: a + b, [F.col(c) for c in counts]).alias("n_findings"),
        F.size(rest).alias("n_unmatched"), unknown.alias("n_unknown"),
        F.concat_ws(" ", "_codes").alias("sentence_ids"))
