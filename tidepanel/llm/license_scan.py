"""License statements in texts: ordered signature rules, native.

A text is brought into a normal form (A-Z lower-cased, words of letters, digits and non-ASCII characters, every word
between two spaces of its own). Rules are regular expressions over that form. Each names a word; only rules whose
word occurs in a text are tried on it, so most texts cost one look-up of its words and no rule. Detections are word intervals. A detection goes when another one contains its interval and has a priority
at least as high; of equal intervals with equal priority the rule that stands first stays.

All steps are expressions over one row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, lower_ascii, whole

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
START, END = "\u0001", "\u0002"  # separators, so no normal form contains them


@dataclass(frozen=True)
class Rule:
    """``pattern`` is written with single spaces between words; it matches whole words only.

    priority: 3 names a license and its version or variant, 2 a license, 1 a mere hint.
    """

    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str
    base: bool = False


BASE = (
    Rule("cc-by", 2, 0.8, "cc", "cc by", True),
    Rule("gpl", 2, 0.8, "public", "general public license", True),
    Rule("reserved", 2, 0.7, "reserved", "all rights reserved", True),
)

# label, priority, weight, keyword, pattern. A pattern always contains its keyword, but for "open licence": many licenses
# are called so, and it is Etalab's only in a text that names Etalab.
_WRITTEN = r"""
apache-2.0 3 0.98 apache :: apache( software)? licen[cs]e( v| version)? ?2( 0)?
apache-2.0 3 0.98 apache :: apache 2( 0)?( licen[cs]e)?
apache-1.1 3 0.95 apache :: apache( software)? licen[cs]e( version)? 1 1
apache-1.0 3 0.95 apache :: apache( software)? licen[cs]e( version)? 1 0
apache 2 0.85 apache :: apache( software)? licen[cs]e
apache-2.0 3 0.95 apache :: www apache org licenses license 2 0
apache-2.0 3 0.9 compliance :: you may not use this file except in compliance with the license
mit 3 0.97 mit :: (the )?mit licen[cs]e
mit 3 0.95 mit :: (released|licensed|distributed|available) under (the )?(terms of the )?mit( licen[cs]e)?
mit 2 0.7 mit :: mit (style|like) licen[cs]e
mit 3 0.97 granted :: permission is hereby granted free of charge to any person obtaining a copy
mit-0 3 0.95 mit :: mit no attribution( licen[cs]e)?
x11 3 0.9 x11 :: x11 licen[cs]e
expat 3 0.9 expat :: expat licen[cs]e
isc 3 0.95 isc :: isc licen[cs]e
isc 3 0.9 modify :: permission to use copy modify and or distribute this software for any purpose
bsd-2-clause 3 0.95 bsd :: (simplified|freebsd) bsd licen[cs]e
bsd-2-clause 3 0.95 bsd :: bsd 2 clause( licen[cs]e)?
bsd-2-clause 3 0.95 bsd :: (2|two) clause bsd( licen[cs]e)?
bsd-3-clause 3 0.95 bsd :: bsd 3 clause( licen[cs]e)?
bsd-3-clause 3 0.95 bsd :: (3|three) clause bsd( licen[cs]e)?
bsd-3-clause 3 0.95 bsd :: (new|modified|revised) bsd licen[cs]e
bsd-4-clause 3 0.95 bsd :: (4|four) clause bsd( licen[cs]e)?
bsd-4-clause 3 0.9 bsd :: original bsd licen[cs]e
0bsd 3 0.95 0bsd :: 0bsd( licen[cs]e)?
0bsd 3 0.95 bsd :: zero clause bsd( licen[cs]e)?
bsd 2 0.8 bsd :: bsd licen[cs]e
bsd 2 0.7 bsd :: bsd (style|like) licen[cs]e
bsd 2 0.9 redistribution :: redistribution and use in source and binary forms
zlib 3 0.95 zlib :: zlib( libpng)? licen[cs]e
libpng 3 0.95 libpng :: libpng licen[cs]e
boost-1.0 3 0.95 boost :: boost software licen[cs]e( version 1 0)?
unlicense 3 0.95 unlicense :: (the )?unlicense
unlicense 3 0.95 unencumbered :: free and unencumbered software released into the public domain
wtfpl 3 0.95 wtfpl :: wtfpl( version \d+)?
wtfpl 3 0.95 public :: do what the (fuck|f) you want to public license
artistic-1.0 3 0.95 artistic :: artistic licen[cs]e( version)? 1 0
artistic-2.0 3 0.95 artistic :: artistic licen[cs]e( version)? 2 0
artistic 2 0.85 artistic :: artistic licen[cs]e
perl 2 0.8 perl :: same terms as perl( itself)?
python-2.0 3 0.95 python :: python( software foundation)? licen[cs]e( version)? 2( 0)?
python 2 0.85 python :: python( software foundation)? licen[cs]e
php-3.0 3 0.9 php :: php licen[cs]e( version)? 3( 0)?
php-3.01 3 0.95 php :: php licen[cs]e( version)? 3 01
ruby 2 0.85 ruby :: (the )?ruby licen[cs]e
postgresql 3 0.95 postgresql :: postgresql licen[cs]e
openssl 3 0.95 openssl :: openssl licen[cs]e
ncsa 3 0.95 ncsa :: (university of illinois )?ncsa( open source)? licen[cs]e
intel 2 0.85 intel :: intel open source licen[cs]e
w3c 3 0.95 w3c :: w3c( software)?( notice and)? licen[cs]e
unicode 3 0.95 unicode :: unicode( inc)? licen[cs]e( agreement)?
icu 3 0.95 icu :: icu licen[cs]e
ofl-1.0 3 0.95 ofl :: (sil )?ofl( version)? 1 0
ofl-1.1 3 0.95 ofl :: (sil )?ofl( version)? 1 1
ofl-1.1 3 0.95 font :: (sil )?open font licen[cs]e( version)? 1 1
ofl 2 0.85 font :: (sil )?open font licen[cs]e
bitstream-vera 3 0.9 bitstream :: bitstream vera( fonts)? (copyright|licen[cs]e)
ftl 3 0.95 freetype :: freetype( project)? licen[cs]e
ijg 3 0.95 jpeg :: independent jpeg group s? ?licen[cs]e
mpl-1.0 3 0.95 mpl :: mpl( version)? 1 0
mpl-1.1 3 0.95 mpl :: mpl( version)? 1 1
mpl-2.0 3 0.95 mpl :: mpl( version)? 2 0
mpl-1.0 3 0.95 mozilla :: mozilla public licen[cs]e( version| v)? 1 0
mpl-1.1 3 0.95 mozilla :: mozilla public licen[cs]e( version| v)? 1 1
mpl-2.0 3 0.95 mozilla :: mozilla public licen[cs]e( version| v)? 2 0
mpl 2 0.85 mozilla :: mozilla public licen[cs]e
epl-1.0 3 0.95 eclipse :: eclipse public licen[cs]e( version| v)? 1 0
epl-2.0 3 0.95 eclipse :: eclipse public licen[cs]e( version| v)? 2 0
epl 2 0.85 eclipse :: eclipse public licen[cs]e
edl-1.0 3 0.95 eclipse :: eclipse distribution licen[cs]e( version| v)?( 1 0)?
cpl-1.0 3 0.95 common :: common public licen[cs]e( version| v)? 1 0
cpl 2 0.85 common :: common public licen[cs]e
ipl-1.0 3 0.95 ibm :: ibm public licen[cs]e( version| v)?( 1 0)?
cddl-1.0 3 0.95 cddl :: cddl( version| v)? 1 0
cddl-1.1 3 0.95 cddl :: cddl( version| v)? 1 1
cddl 2 0.85 common :: common development and distribution licen[cs]e
eupl-1.1 3 0.95 eupl :: eupl( version| v)? 1 1
eupl-1.2 3 0.95 eupl :: eupl( version| v)? 1 2
eupl 2 0.85 european :: european union public licen[cs]e
cecill 2 0.85 cecill :: cecill( [abc])?( licen[cs]e)?
ms-pl 3 0.95 microsoft :: microsoft public licen[cs]e
ms-rl 3 0.95 microsoft :: microsoft reciprocal licen[cs]e
osl-3.0 3 0.95 open :: open software licen[cs]e( version| v)? 3 0
osl 2 0.85 open :: open software licen[cs]e
afl-3.0 3 0.95 academic :: academic free licen[cs]e( version| v)? 3 0
afl 2 0.85 academic :: academic free licen[cs]e
qpl-1.0 3 0.95 qpl :: qpl( version)?( 1 0)?
qpl 2 0.85 public :: q public licen[cs]e
apsl-2.0 3 0.95 apple :: apple public source licen[cs]e( version)? 2 0
apsl 2 0.85 apple :: apple public source licen[cs]e
sspl-1.0 3 0.95 sspl :: sspl( version| v)?( 1)?
sspl 2 0.9 side :: server side public licen[cs]e
busl-1.1 3 0.95 business :: business source licen[cs]e( 1 1)?
elastic-2.0 3 0.95 elastic :: elastic licen[cs]e( 2 0)?
commons-clause 3 0.95 commons :: commons clause
polyform 2 0.9 polyform :: polyform (noncommercial|small business|shield|perimeter|strict)( licen[cs]e)?
json 3 0.9 evil :: shall be used for good not evil
beerware 3 0.95 beer :: beer ware licen[cs]e
beerware 3 0.95 beerware :: beerware( licen[cs]e)?
curl 3 0.9 curl :: curl licen[cs]e
vim 3 0.9 vim :: vim licen[cs]e
sqlite 3 0.9 sqlite :: sqlite blessing
tcl 3 0.9 tcl :: tcl( tk)? licen[cs]e
zope 2 0.9 zope :: zope public licen[cs]e( \d+( \d+)?)?
sleepycat 2 0.9 sleepycat :: sleepycat licen[cs]e
odbl-1.0 3 0.95 odbl :: odbl( version| v)?( 1 0)?
odbl 2 0.9 database :: open (data commons open )?database licen[cs]e
odc-by-1.0 3 0.95 odc :: odc by( 1 0)?
odc-by 2 0.9 commons :: open data commons attribution licen[cs]e
pddl-1.0 3 0.95 pddl :: pddl( 1 0)?
cdla 2 0.9 cdla :: cdla (permissive|sharing)( \d+( \d+)?)?
ogl-uk 2 0.9 government :: open government licen[cs]e( v?\d+( \d+)?)?
etalab 2 0.9 ouverte :: (etalab )?licence ouverte( etalab)?
etalab 2 0.9 etalab :: (etalab )?open licen[cs]e( etalab)?
openrail 2 0.9 rail :: (creativeml )?open rail( m)?( licen[cs]e)?
gfdl-1.1 3 0.95 gfdl :: gfdl( version| v)? 1 1
gfdl-1.2 3 0.95 gfdl :: gfdl( version| v)? 1 2
gfdl-1.3 3 0.95 gfdl :: gfdl( version| v)? 1 3
gfdl 2 0.9 documentation :: (gnu )?free documentation licen[cs]e( version \d+( \d+)?)?
public-domain 2 0.8 domain :: (released|placed|dedicated) (in|into|to) the public domain
public-domain 2 0.8 domain :: public domain (dedication|mark|work)
public-domain 1 0.5 domain :: (in the )?public domain
cc0-1.0 3 0.95 cc0 :: (creative commons )?cc0( 1 0)?( universal)?
cc0-1.0 3 0.95 creative :: creative commons zero( 1 0)?
copyright 1 0.5 copyright :: copyright( c)? (19|20)\d\d( (19|20)\d\d)?
copyright 1 0.4 copyright :: copyright (by|holder|holders|owner|notice)
copyright 1 0.4 copyrighted :: (is|are) copyrighted( material)?
reserved 1 0.5 reserved :: (some|no) rights reserved
reserved 1 0.6 droits :: tous droits réservés
reserved 1 0.6 rechte :: alle rechte vorbehalten
reserved 1 0.6 derechos :: todos los derechos reservados
proprietary 2 0.8 proprietary :: proprietary (and|or) confidential
proprietary 2 0.8 proprietary :: proprietary (software|licen[cs]e)
proprietary 1 0.6 prohibited :: (reproduction|redistribution|copying)( in whole or in part)?( is)?( strictly)? prohibited
proprietary 1 0.6 consent :: without (the )?(prior )?(express )?(written )?consent
proprietary 1 0.6 permission :: without (the )?(prior )?(express )?(written )?permission
proprietary 2 0.8 secret :: trade secret (of|and)
proprietary 2 0.8 secrets :: trade secrets (of|and)
eula 2 0.8 agreement :: end user licen[cs]e agreement
terms 1 0.4 terms :: terms (of (use|service)|and conditions) apply
warranty 1 0.5 warranty :: without warranty of any kind
warranty 1 0.5 warranties :: without warranties or conditions of any kind
warranty 1 0.5 warranty :: without even the implied warranty
warranty 1 0.5 provided :: provided as is
license-hint 1 0.4 licensed :: (this|the) (work|text|file|document|software|page|content|dataset) is licensed under
license-hint 1 0.4 licensed :: licensed under( the)?( terms of)?( the)?
license-hint 1 0.4 released :: released under( the)?( terms of)?( the)?
license-hint 1 0.4 license :: see( the)? license( file)? for( more)? details
license-hint 1 0.4 licence :: see( the)? licence( file)? for( more)? details
license-hint 1 0.4 license :: license file
license-hint 1 0.4 lizenz :: (unter der|diese) lizenz
license-hint 1 0.4 licence :: sous licence
license-hint 1 0.4 licencia :: bajo (la )?licencia
spdx 3 0.99 spdx :: spdx license identifier [0-9a-z]+( [0-9a-z]+)?( \d+)?( only| or later)?
"""


def _families() -> list[Rule]:
    """Rules of the license families whose names are put together from parts."""
    rules = []
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(ative)?s?( works)?"}
    for variant in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        codes = variant.split("-")
        short, spelled = " ".join(codes), " ".join(parts[c] for c in codes)
        rules.append(Rule(f"cc-{variant}", 2, 0.9, "cc", f"cc {short}"))
        rules.append(Rule(f"cc-{variant}", 2, 0.9, "commons", f"creative commons {spelled}"))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{variant}-{version.replace(' ', '.')}"
            rules.append(Rule(label, 3, 0.98, "cc", f"cc {short} {version}"))
            rules.append(Rule(label, 3, 0.98, "commons",
                              f"creative commons {spelled} {version}( international| unported| generic)?( licen[cs]e)?"))
    gnu = {"gpl": ("general", ("1", "2", "3")), "lgpl": ("(lesser|library) general", ("2", "2 1", "3")),
           "agpl": ("affero general", ("1", "3"))}
    for label, (name, versions) in gnu.items():
        rules.append(Rule(label, 2, 0.9, "public", f"(gnu )?{name} public licen[cs]e"))
        rules.append(Rule(label, 2, 0.8, label, f"(gnu )?{label}"))
        for version in versions:
            full = f"{label}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            tail = f"(v|version )?{version}( 0)?" if " " not in version else f"(v|version )?{version}"
            later = "( only| or( any)? later( version)?)?"
            rules.append(Rule(full, 3, 0.98, "public", f"(gnu )?{name} public licen[cs]e {tail}{later}"))
            rules.append(Rule(full, 3, 0.98, "public", f"version {version}( 0)? of the (gnu )?{name} public licen[cs]e"))
            rules.append(Rule(full, 3, 0.95, label, f"(gnu )?{label} {tail}{later}"))
            rules.append(Rule(full, 3, 0.95, f"{label}v{version.split()[0]}", f"{label}v{version}"))
    return rules


def rules() -> tuple[Rule, ...]:
    """Base phrases, written signatures and families, in the order in which equal detections are settled."""
    written = []
    for line in _WRITTEN.strip().splitlines():
        head, pattern = line.split(" :: ")
        label, priority, weight, keyword = head.split(" ")
        written.append(Rule(label, int(priority), float(weight), keyword, pattern))
    return (*BASE, *written, *_families())


def _spaced(pattern: str) -> str:
    """A pattern over single-spaced words as one over the normal form, where each word has its own two spaces."""
    out = pattern.rstrip()
    out = out.replace(" ?", "\u0003").replace(" ", "  ").replace("\u0003", "(?:  )?")
    return f" {out} "


_SCHEMA = "array<struct<n:int,label:string,priority:int,weight:double,keyword:string,pattern:string,base:boolean>>"


def _places(normal: Column, rule: Column) -> Column:
    """Word intervals (first, last) of a rule's matches, in order."""
    marked = F.regexp_replace(normal, rule["pattern"], F.lit(f"{START}$0{END}"))
    tokens = F.split(F.trim(F.replace(F.replace(marked, F.lit(f"{START} "), F.lit(f" {START}")),
                                      F.lit(f" {END}"), F.lit(f"{END} "))), " +")
    at = F.transform(tokens, lambda w, i: F.struct(F.substring(w, 1, 1).eqNullSafe(START).alias("first"),
                                                   F.contains(w, F.lit(END)).alias("last"), i.alias("i")))
    edges = F.filter(at, lambda e: e["first"] | e["last"])
    return let(edges, lambda x: F.zip_with(
        F.filter(x, lambda e: e["first"]), F.filter(x, lambda e: e["last"]),
        lambda a, b: F.struct(a["i"].alias("first"), b["i"].alias("last"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``base_hits``, ``hits``.

    ``base_hits`` are all places of base rules; ``hits`` the detections of all rules that survive suppression. Both
    are arrays of (first, last, priority, label, weight, rule), ordered by place; words count from 0.

    Null and empty texts have no words and empty arrays. Null ids and repeated rows are kept as they are. Other
    columns of ``docs``, whatever their names, are not looked at. An empty table gives an empty table.
    """
    table = signatures or rules()
    literal = F.from_json(F.lit(json.dumps([asdict(r) | {"n": n, "pattern": _spaced(r.pattern)}
                                            for n, r in enumerate(table)])), _SCHEMA)
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in table})])
    inner = F.trim(F.regexp_replace(lower_ascii(whole(text_col)), SEPARATORS, " "))

    def scanned(inner: Column) -> Column:
        n_words = F.when(inner == "", 0).otherwise(
            F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")
        hits = let(F.array_intersect(keywords, F.split(inner, " ")), lambda found: F.when(
            F.size(found) == 0, F.array().cast(_HIT)).otherwise(let(
                F.concat(F.lit(" "), F.replace(inner, F.lit(" "), F.lit("  ")), F.lit(" ")),
                lambda normal: detected(found, normal))))
        return let(hits, lambda every: F.struct(
            n_words.alias("n_words"), F.transform(F.filter(every, lambda h: h["base"]), _shown).alias("base_hits"),
            F.transform(_surviving(every), _shown).alias("hits")))

    def detected(found: Column, normal: Column) -> Column:
        tried = F.filter(literal, lambda r: F.array_contains(found, r["keyword"]))
        return F.array_sort(F.flatten(F.transform(tried, lambda r: _detect(normal, r))))

    return docs.select(F.col(id_col), let(inner, scanned).alias("scanned__")).select(id_col, "scanned__.*")


def _detect(normal: Column, rule: Column) -> Column:
    """A rule's hits, first those that start first."""
    return F.when(F.rlike(normal, rule["pattern"]), F.transform(
        _places(normal, rule),
        lambda p: F.struct(p["first"].alias("first"), (-p["last"]).alias("minus_last"),
                           (-rule["priority"]).alias("minus_priority"), rule["n"].alias("rule"),
                           rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"))
    )).otherwise(F.array().cast(_HIT))


def _shown(h: Column) -> Column:
    return F.struct(h["first"].alias("first"), (-h["minus_last"]).alias("last"), (-h["minus_priority"]).alias("priority"),
                    h["label"].alias("label"), h["weight"].alias("weight"), h["rule"].alias("rule"))


_HIT = ("array<struct<first:int,minus_last:int,minus_priority:int,rule:int,label:string,weight:double,base:boolean>>")


def _surviving(hits: Column) -> Column:
    """One walk over hits that stand in order of place, longer and higher ones first.

    Whatever can contain a hit stands before it, so the furthest end seen so far in each priority decides.
    """
    start = F.struct(F.array(F.lit(-1), F.lit(-1), F.lit(-1)).alias("reach"), F.array().cast(_HIT).alias("kept"))

    def step(state: Column, h: Column) -> Column:
        last, level = -h["minus_last"], -h["minus_priority"]
        covered = F.exists(F.slice(state["reach"], level, 4 - level), lambda r: r >= last)
        return F.struct(
            F.transform(state["reach"], lambda r, i: F.when(i + 1 == level, F.greatest(r, last)).otherwise(r)).alias("reach"),
            F.when(covered, state["kept"]).otherwise(F.concat(state["kept"], F.array(h))).alias("kept"))

    return F.aggregate(hits, start, step, lambda s: s["kept"])


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last place, and labels of ``scan``'s result; ``score`` is the weight of the surest hit."""
    def labels(*arrays: str) -> Column:
        every = F.concat(*[F.transform(F.col(a), lambda h: h["label"]) for a in arrays])
        return F.array_join(F.array_sort(F.array_distinct(every)), ",")

    firsts = F.transform("base_hits", lambda h: h["first"].cast("long"))
    weights = F.transform(F.concat("base_hits", "hits"), lambda h: h["weight"])
    return scanned.select(
        id_col, "n_words", F.size("base_hits").cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels("base_hits").alias("base_labels"), labels("base_hits", "hits").alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.size("hits").cast("long").alias("n_hits"))
