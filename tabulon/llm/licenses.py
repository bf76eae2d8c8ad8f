"""Licence scans by ordered signature rules, in DataFrame operations only.

Some hundreds of hand-written patterns, each behind a keyword, find licence names, notices, addresses and SPDX tags. A text is
searched only by rules whose keyword it holds, both with each run of blanks and comment marks as one space; every text that a
pattern matches holds its keyword. Each match is an interval and a row of its own, without the text; one that lies within the interval of
a match of a higher priority, or of a larger or earlier one of equal priority, is suppressed, so that
"GNU Lesser General Public License" isn't reported as the plain one by these rules. Base phrases are counted on words besides,
and their labels stay whatever the rules say. Time and memory of a text grow as its length and matches, sorted once.

score: the confidence of the best match left, 0.6 with base phrases only, else 0.

Defined cases: null text counts as empty (no words, no labels: ""); repeated rows and null ids give a row each; an
empty table gives an empty table; only doc_id and text are read, so columns of any other name don't matter; a text of any length is
searched whole; of equal intervals of equal priority the earlier rule's stays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, text_of

#: Phrases of the base count: the words and the label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_V = r"(?:,?\s*\(?(?:version|v\.?|ver\.?)?\s*"  # before a version number
_THE = r"(?:the\s+)?"
GAP = r"[\s*#/;%-]"  # white space, and the marks with which lines of comments begin
BLANKS = r"[ \t\n\x0B\f\r*#/;%-]+"  # what one space of a keyword stands for: GAPs, with \s of ASCII

#: keyword, label, name pattern. Each gives the name itself, "licensed/released/distributed under <name>" and "<name> licen[cs]e".
NAMES = (
    ("mit", "mit", r"mit"), ("expat", "mit", r"expat"), ("x11", "x11", r"x11"), ("isc", "isc", r"isc"), ("zlib", "zlib", r"zlib(?:/libpng)?"),
    ("apache", "apache", r"apache(?:\s+software)?"), ("apache", "apache-1.0", r"apache(?:\s+software)?(?:\s+license)?" + _V + r"1\.0\)?)"), ("apache", "apache-1.1", r"apache(?:\s+software)?(?:\s+license)?" + _V + r"1\.1\)?)"), ("apache", "apache-2.0", r"apache(?:\s+software)?(?:\s+license)?" + _V + r"2(?:\.0)?\)?)"),
    ("bsd", "bsd", r"bsd"), ("bsd", "bsd-2-clause", r"(?:2|two)[\s-]+clause\s+bsd|bsd[\s-]+(?:2|two)[\s-]+clause|simplified\s+bsd|freebsd"), ("bsd", "bsd-3-clause", r"(?:3|three)[\s-]+clause\s+bsd|bsd[\s-]+(?:3|three)[\s-]+clause|(?:new|modified|revised)\s+bsd"), ("bsd", "bsd-4-clause", r"(?:4|four)[\s-]+clause\s+bsd|bsd[\s-]+(?:4|four)[\s-]+clause|original\s+bsd"), ("bsd", "0bsd", r"zero[\s-]+clause\s+bsd|0bsd|bsd\s+zero\s+clause"),
    ("gpl", "gpl", r"(?:gnu\s+)?gpl"), ("gpl", "gpl-1.0", r"(?:gnu\s+)?gpl" + _V + r"1(?:\.0)?\)?)"), ("gpl", "gpl-2.0", r"(?:gnu\s+)?gpl" + _V + r"2(?:\.0)?\)?)"), ("gpl", "gpl-3.0", r"(?:gnu\s+)?gpl" + _V + r"3(?:\.0)?\)?)"),
    ("general public", "gpl", r"(?:gnu\s+)?general\s+public\s+licen[cs]e"), ("general public", "gpl-2.0", r"(?:gnu\s+)?general\s+public\s+licen[cs]e" + _V + r"2(?:\.0)?\)?)"), ("general public", "gpl-3.0", r"(?:gnu\s+)?general\s+public\s+licen[cs]e" + _V + r"3(?:\.0)?\)?)"),
    ("lgpl", "lgpl", r"(?:gnu\s+)?lgpl"), ("lgpl", "lgpl-2.0", r"(?:gnu\s+)?lgpl" + _V + r"2(?:\.0)?\)?)"), ("lgpl", "lgpl-2.1", r"(?:gnu\s+)?lgpl" + _V + r"2\.1\)?)"), ("lgpl", "lgpl-3.0", r"(?:gnu\s+)?lgpl" + _V + r"3(?:\.0)?\)?)"),
    ("lesser", "lgpl", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e"), ("lesser", "lgpl-2.1", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e" + _V + r"2\.1\)?)"), ("lesser", "lgpl-3.0", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e" + _V + r"3(?:\.0)?\)?)"), ("library general", "lgpl-2.0", r"(?:gnu\s+)?library\s+general\s+public\s+licen[cs]e"),
    ("agpl", "agpl", r"(?:gnu\s+)?agpl"), ("agpl", "agpl-3.0", r"(?:gnu\s+)?agpl" + _V + r"3(?:\.0)?\)?)"), ("affero", "agpl", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e"), ("affero", "agpl-3.0", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e" + _V + r"3(?:\.0)?\)?)"),
    ("free documentation", "gfdl", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e"), ("gfdl", "gfdl", r"gfdl"),
    ("mozilla", "mpl", r"mozilla\s+public"), ("mozilla", "mpl-1.1", r"mozilla\s+public(?:\s+license)?" + _V + r"1\.1\)?)"), ("mozilla", "mpl-2.0", r"mozilla\s+public(?:\s+license)?" + _V + r"2(?:\.0)?\)?)"), ("mpl", "mpl", r"mpl"), ("mpl", "mpl-2.0", r"mpl" + _V + r"2(?:\.0)?\)?)"),
    ("eclipse", "epl", r"eclipse\s+public"), ("eclipse", "epl-1.0", r"eclipse\s+public(?:\s+license)?" + _V + r"1(?:\.0)?\)?)"), ("eclipse", "epl-2.0", r"eclipse\s+public(?:\s+license)?" + _V + r"2(?:\.0)?\)?)"), ("eclipse", "edl-1.0", r"eclipse\s+distribution"), ("cddl", "cddl", r"cddl"), ("common development and distribution", "cddl", r"common\s+development\s+and\s+distribution"),
    ("common public", "cpl-1.0", r"common\s+public"), ("ibm public", "ipl-1.0", r"ibm\s+public"), ("european union public", "eupl", r"european\s+union\s+public"), ("eupl", "eupl", r"eupl(?:\s*v?\.?\s*1\.[12])?"), ("cecill", "cecill", r"cecill(?:-[bc])?"), ("boost", "bsl-1.0", r"boost(?:\s+software)?"), ("artistic", "artistic", r"artistic"), ("artistic", "artistic-2.0", r"artistic(?:\s+license)?" + _V + r"2(?:\.0)?\)?)"), ("perl", "artistic-1.0-perl", r"(?:same\s+terms\s+as\s+)perl(?:\s+itself)?"),
    ("python software", "psf-2.0", r"python\s+software\s+foundation"), ("psf", "psf-2.0", r"psf"), ("php", "php-3.01", r"php"), ("ruby", "ruby", r"ruby"), ("postgresql", "postgresql", r"postgresql"), ("openssl", "openssl", r"openssl"), ("unlicense", "unlicense", r"unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("beerware", "beerware", r"beerware"), ("beer-ware", "beerware", r"beer-ware"), ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/?)?ncsa(?:\s+open\s+source)?"), ("zope", "zpl", r"zope\s+public"), ("academic free", "afl", r"academic\s+free"), ("open software", "osl", r"open\s+software"), ("microsoft public", "ms-pl", r"microsoft\s+public"), ("microsoft reciprocal", "ms-rl", r"microsoft\s+reciprocal"), ("ms-pl", "ms-pl", r"ms-pl"), ("ms-rl", "ms-rl", r"ms-rl"), ("sleepycat", "sleepycat", r"sleepycat"), ("vim", "vim", r"vim"), ("w3c", "w3c", r"w3c(?:\s+software)?"), ("unicode", "unicode", r"unicode"), ("universal permissive", "upl-1.0", r"universal\s+permissive"), ("upl", "upl-1.0", r"upl(?:-1\.0)"), ("mulan", "mulanpsl", r"mulan\s+(?:psl|permissive(?:\s+software)?)"), ("blue oak", "blueoak-1.0.0", r"blue\s+oak(?:\s+model)?"), ("elastic", "elastic-2.0", r"elastic"), ("business source", "busl-1.1", r"business\s+source"), ("server side public", "sspl-1.0", r"server\s+side\s+public"), ("sspl", "sspl-1.0", r"sspl"), ("commons clause", "commons-clause", r"commons\s+clause"), ("openrail", "openrail", r"(?:creativeml\s+|bigscience\s+)?openrail(?:\+*-?m)?"), ("open rail", "openrail", r"(?:creativeml\s+|bigscience\s+)?open\s+rail(?:\+*-?m)?"), ("open database", "odbl-1.0", r"open\s+database"), ("odbl", "odbl-1.0", r"odbl"), ("odc-by", "odc-by-1.0", r"odc-by"), ("open data commons attribution", "odc-by-1.0", r"open\s+data\s+commons\s+attribution"), ("pddl", "pddl-1.0", r"pddl"), ("public domain dedication", "pddl-1.0", r"public\s+domain\s+dedication\s+and"), ("sil open font", "ofl-1.1", r"sil\s+open\s+font"), ("ofl", "ofl-1.1", r"ofl(?:-1\.1)?"), ("open government", "ogl", r"open\s+government"), ("community data", "cdla", r"community\s+data"), ("cdla", "cdla", r"cdla(?:-permissive|-sharing)?(?:-\d\.\d)?"), ("latex project", "lppl", r"latex\s+project\s+public"), ("lppl", "lppl", r"lppl"), ("cc0", "cc0-1.0", r"cc0(?:\s*1\.0)?(?:\s+universal)?"), ("proprietary", "proprietary", r"proprietary"), ("commercial", "commercial", r"commercial"),
)
_CC = (("by", ""), ("by-sa", "sharealike"), ("by-nc", "noncommercial"), ("by-nd", "noderiv(?:ative)?s?"), ("by-nc-sa", "noncommercial[\\s-]+sharealike"), ("by-nc-nd", "noncommercial[\\s-]+noderiv(?:ative)?s?"))
#: keyword, label, pattern, confidence: notices and addresses that stand for themselves. A space of a pattern is any run of GAPs.
NOTICES = (
    ("permission is hereby granted", "mit", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 1.0), ("permission to use", "isc", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee", 1.0), ("redistribution and use", "bsd", r"redistribution and use in source and binary forms,? with or without modification", 0.95), ("neither the name", "bsd-3-clause", r"neither the names? of [\s\S]{1,1000}? nor the names of its contributors", 0.95), ("nor the names of its contributors", "bsd-3-clause", r"nor the names of its contributors", 0.95), ("all advertising materials", "bsd-4-clause", r"all advertising materials mentioning features or use of this software", 0.95),
    ("opensource.org", "mit", r"https?://(?:www\.)?opensource\.org/licenses?/mit\S*", 1.0), ("opensource.org", "bsd-2-clause", r"https?://(?:www\.)?opensource\.org/licenses?/bsd-2\S*", 1.0), ("opensource.org", "bsd-3-clause", r"https?://(?:www\.)?opensource\.org/licenses?/bsd-3\S*", 1.0), ("apache.org/licenses", "apache-2.0", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0\S*", 1.0), ("gnu.org/licenses", "gpl", r"https?://(?:www\.)?gnu\.org/licenses/gpl\S*", 0.95), ("gnu.org/licenses", "lgpl", r"https?://(?:www\.)?gnu\.org/licenses/lgpl\S*", 0.95), ("gnu.org/licenses", "agpl", r"https?://(?:www\.)?gnu\.org/licenses/agpl\S*", 0.95), ("mozilla.org/mpl", "mpl-2.0", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0\S*", 1.0), ("eclipse.org/legal", "epl", r"https?://(?:www\.)?eclipse\.org/legal/epl\S*", 0.95), ("boost.org", "bsl-1.0", r"https?://(?:www\.)?boost\.org/license_1_0\S*", 1.0), ("unlicense.org", "unlicense", r"https?://(?:www\.)?unlicense\.org\S*", 1.0), ("publicdomain/zero", "cc0-1.0", r"https?://(?:www\.)?creativecommons\.org/publicdomain/zero\S*", 1.0), ("scripts.sil.org", "ofl-1.1", r"https?://scripts\.sil\.org/ofl\S*", 1.0),
    ("public domain", "public-domain", r"(?:released|placed|dedicated)?\s*(?:in|into|to) the public domain", 0.8), ("all rights reserved", "all-rights-reserved", r"all rights reserved", 0.7), *((f"may not be {verb}", "proprietary", rf"may not be {verb}(?: without \w+)?", 0.7) for verb in ("copied", "reproduced", "redistributed")), ("dual licen", "dual-licensed", r"dual licen[cs]ed", 0.7),
)
SPDX = ("0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 "
        "CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 "
        "OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1").split()


def plain(text: str) -> str:
    """The text as keywords are sought in it: each run of blanks and comment marks is one space."""
    return re.sub(BLANKS, " ", text)


def rules() -> list[tuple[str, str, str, int, float]]:
    """keyword, label, pattern (on ASCII-lower-cased text), priority (higher wins) and confidence, in order."""
    out: list[tuple[str, str, str, int, float]] = []
    add = lambda *r: out.append(r)
    for tag in SPDX:
        t = tag.lower().replace(".", r"\.")
        add("spdx-license-identifier", tag.lower(), rf"spdx-license-identifier:\s*\(?{t}(?![\w.+-])", 100, 1.0)
    for key, label, pattern, sure in NOTICES:
        add(key, label, r"\b" + pattern.replace(" ", GAP + "+"), 90, sure)
    for kind, words in _CC:
        flat = kind.replace("-", r"[\s-]*")
        long = r"attribution" + (r"[\s-]+" + words if words else "")
        for version in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
            v = rf"[\s-]*(?:v(?:ersion)?\s*)?{version.replace('.', r'[.]')}(?![\d])" if version else ""
            label = f"cc-{kind}" + (f"-{version}" if version else "")
            add("cc by", label, rf"\b(?:(?:licen[cs]ed|released|distributed)\s+under\s+{_THE})?cc[\s-]+{flat}\b{v}", 70 + 2 * len(kind) + bool(version), 0.95 if version else 0.85)
            add("creative commons", label, rf"\b(?:(?:licen[cs]ed|released|distributed)\s+under\s+{_THE})?creative\s+commons\s+{long}\b{v}", 70 + 2 * len(kind) + bool(version), 0.95 if version else 0.85)
        add("creativecommons.org", f"cc-{kind}", rf"https?://(?:www\.)?creativecommons\.org/licenses/{kind}/\S*", 95, 0.95)
    for key, label, pattern in NAMES:
        versioned = label[-1].isdigit() or "clause" in label
        under = rf"\b(?:licen[cs]ed|released|distributed|available|published)\s+under\s+(?:the\s+terms\s+of\s+)?{_THE}(?:{pattern})(?:\s+licen[cs]e)?(?![\w])"
        add(key, label, under, 60 + 5 * versioned, 0.95)
        if "licen" in pattern:
            add(key, label, rf"\b(?:{pattern})(?!\w|\.\d)", 50 + 5 * versioned, 0.9)
        else:
            add(key, label, rf"\b(?:{pattern})[\s-]+licen[cs]ed?\b", 50 + 5 * versioned, 0.9)
    return out


def gates() -> list[str]:
    """Strings of which each text that any rule or base phrase matches has one, as plain() gives it."""
    keys = {plain(key) for key, _, _, rank, _ in rules() if rank >= 70}  # the rest, on names, need one of the next two, or have "license" as an option
    keys |= {"licen", "under"} | {plain(key) for key, _, pattern in NAMES if r"(?:\s+license)?" in pattern}
    ordered = sorted(keys, key=len)
    return [k for i, k in enumerate(ordered) if not any(g in k for g in ordered[:i])]


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Places, from 0, where the phrase's words stand."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(parts):
            ok = ok & (F.get(words, i + k) == w)
        return F.coalesce(ok, F.lit(False))

    return F.filter(at, here)


def _matches() -> Column:
    """Of a row with _low, the lower-cased text, and _plain, the same for keywords: nr, k, gap and hit of the k-th match of each rule.

    gap: characters between the match before and this one, hit: those of the match.
    """
    literal = F.array(*(F.struct(F.lit(plain(k)).alias("key"), F.lit(p).alias("pattern"), F.lit(i).alias("nr")) for i, (k, _, p, _, _) in enumerate(rules())))
    active = F.filter(literal, lambda r: F.contains(F.col("_plain"), r["key"]) & F.regexp_like(F.col("_low"), r["pattern"]))
    found = F.transform(active, lambda r: F.struct(r["nr"].alias("nr"), F.regexp_extract_all(F.col("_low"), r["pattern"], F.lit(0)).alias("hits"), F.split(F.col("_low"), r["pattern"], -1).alias("gaps")))

    def places(m: Column) -> Column:
        one = lambda h, i: F.struct(m["nr"].alias("nr"), i.alias("k"), F.length(F.get(m["gaps"], i)).alias("gap"), F.length(h).alias("hit"))
        return F.transform(m["hits"], one)

    return F.when(F.col("_low") != "", F.flatten(F.transform(found, places)))


def located(matches: DataFrame) -> DataFrame:
    """_row, nr, k, gap and hit with the interval of each match, s to e, in characters."""
    w = Window.partitionBy("_row", "nr").orderBy("k")
    start = F.sum("gap").over(w) + F.sum("hit").over(w) - F.col("hit")
    return matches.withColumn("s", start).withColumn("e", F.col("s") + F.col("hit"))


def suppressed(spans: DataFrame, ranks: list[int]) -> DataFrame:
    """spans (_row, s, e, rank, nr) with `beaten`: whether another interval of its row covers it by the rule of the module.

    In the order of start, then longer, higher rank and earlier rule first, all that can beat a span stands before it; it is beaten if
    an end before it, of its rank or a higher one, reaches its own. So running maxima, one for each rank, decide.
    """
    w = Window.partitionBy("_row").orderBy("s", F.desc("e"), F.desc("rank"), "nr").rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.lit(False)
    for r in sorted(set(ranks)):
        beaten = F.when(F.col("rank") == r, F.max(F.when(F.col("rank") >= r, F.col("e"))).over(w) >= F.col("e")).otherwise(beaten)
    return spans.withColumn("beaten", F.coalesce(beaten, F.lit(False)))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    low = docs.select("doc_id", ascii_lower(text_of("text")).alias("_low"))
    low = low.withColumn("n_words", F.regexp_count("_low", F.lit(WORD)).cast("long"))
    low = low.withColumn("_plain", F.regexp_replace("_low", BLANKS, " "))
    may = F.lit(False)
    for k in gates():
        may = may | F.contains("_plain", F.lit(k))
    low = low.withColumn("_low", F.when(may, F.col("_low")).otherwise(F.lit("")))  # texts without any keyword go no further
    words = F.when(F.contains("_low", F.lit("license")), F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    at = low.withColumn("_w", words)
    at = at.withColumns({f"_b{i}": _phrase_starts(F.col("_w"), p) for i, (p, _) in enumerate(BASE)}).drop("_w")
    places = F.concat(*(F.col(f"_b{i}") for i in range(len(BASE))))
    base = F.array_sort(F.filter(F.array(*(F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))), lambda x: x.isNotNull()))
    own = {"n_words": F.col("n_words"), "n_base": F.size(places).cast("long"), "first_word": F.array_min(places).cast("long"), "last_word": F.array_max(places).cast("long"), "base": base}
    # a row of its own for each match; the text goes no further
    numbered = at.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *(c.alias(n) for n, c in own.items()), _matches().alias("m"))
    each = numbered.select("_row", "doc_id", *own, F.explode_outer("m").alias("m"))
    each = each.select("_row", "doc_id", *own, "m.*").repartition("_row")
    table = rules()
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("nr"))
    spans = located(each).withColumn("rank", of([r[3] for r in table]))
    spans = suppressed(spans, [r[3] for r in table])
    left = F.when(F.col("nr").isNotNull() & ~F.col("beaten"), F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), of([r[1] for r in table]).alias("label"), "rank", of([r[4] for r in table]).alias("sure"), "nr"))
    rows = spans.withColumn("left", left).groupBy("_row").agg(*(F.first(n).alias(n) for n in ("doc_id", *own)), F.collect_set("left.label").alias("found"), F.max("left.sure").alias("sure"), F.array_sort(F.collect_list("left")).alias("detections"))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)), F.coalesce("sure", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "found"))), ",").alias("labels"), score.alias("score"), "detections",
    )


def license_table(docs: DataFrame) -> DataFrame:
    return license_scan(docs).drop("detections")
