"""Signature rules of licenses: hand-written names, versions and sentences, and the forms they occur in.

Rules are regular expressions over normalised text: lower case, words of letters and digits only, one
space between them (so `GPL-3.0` reads `gpl 3 0`). They begin and end with a word. Every rule has a
keyword, a plain string without which it can't match, and a tier: the lower, the stronger.
"""

from __future__ import annotations

from typing import NamedTuple

TAG, GRANT, TITLE, HINT = range(4)
TIERS = (TAG, GRANT, TITLE, HINT)


class Rule(NamedTuple):
    label: str
    tier: int
    keyword: str
    regex: str
    base: bool = False


BASE = (
    Rule("mit", TITLE, "mit license", "mit license", True),
    Rule("apache", TITLE, "apache license", "apache license", True),
    Rule("gpl", TITLE, "general public license", "general public license", True),
)

# Label, keyword, regex of the name, versions.
FAMILIES = (
    ("mit", "mit licen", "mit licen[sc]e", ()),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[sc]e)?", ()),
    ("x11", "x11 licen", "x11 licen[sc]e", ()),
    ("apache", "apache", "apache(?: software)?(?: public)?(?: licen[sc]e)?", ("1.0", "1.1", "2.0")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1.0", "2.0", "3.0")),
    ("gpl", "general public licen", "(?:gnu )?general public licen[sc]e", ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    ("lgpl", "general public licen",
     "(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1.0", "3.0")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", ("1.0", "3.0")),
    ("gfdl", "free documentation licen", "(?:gnu )?free documentation licen[sc]e",
     ("1.1", "1.2", "1.3")),
    ("gfdl", "gfdl", "(?:gnu )?gfdl", ("1.1", "1.2", "1.3")),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e", ()),
    ("bsd-2-clause", "bsd", "(?:bsd 2|2 clause bsd|simplified bsd)(?: clause)?(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd",
     "(?:bsd 3|3 clause bsd|new bsd|modified bsd|revised bsd)(?: clause)?(?: licen[sc]e)?", ()),
    ("bsd-4-clause", "bsd", "(?:bsd 4|4 clause bsd|original bsd)(?: clause)?(?: licen[sc]e)?", ()),
    ("0bsd", "bsd", "(?:0bsd|bsd 0|zero clause bsd)(?: clause)?(?: licen[sc]e)?", ()),
    ("isc", "isc licen", "isc licen[sc]e", ()),
    ("mpl", "mozilla public licen", "mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public licen", "eclipse public licen[sc]e", ("1.0", "2.0")),
    ("epl", "epl", "epl", ("1.0", "2.0")),
    ("edl", "eclipse distribution licen", "eclipse distribution licen[sc]e", ("1.0",)),
    ("cddl", "common development and distribution licen",
     "common development and distribution licen[sc]e", ("1.0", "1.1")),
    ("cddl", "cddl", "cddl", ("1.0", "1.1")),
    ("cpl", "common public licen", "common public licen[sc]e", ("1.0",)),
    ("ipl", "ibm public licen", "ibm public licen[sc]e", ("1.0",)),
    ("artistic", "artistic licen", "(?:perl )?artistic licen[sc]e", ("1.0", "2.0")),
    ("afl", "academic free licen", "academic free licen[sc]e", ("1.1", "2.0", "2.1", "3.0")),
    ("osl", "open software licen", "open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0")),
    ("bsl", "boost software licen", "boost software licen[sc]e", ("1.0",)),
    ("busl", "business source licen", "business source licen[sc]e", ("1.0", "1.1")),
    ("sspl", "server side public licen", "server side public licen[sc]e", ("1.0",)),
    ("elastic", "elastic licen", "elastic licen[sc]e", ("1.0", "2.0")),
    ("eupl", "european union public licen", "european union public licen[sc]e", ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2")),
    ("cecill", "cecill", "cecill(?: licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("ms-pl", "microsoft public licen", "microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft reciprocal licen", "microsoft reciprocal licen[sc]e", ()),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", ()),
    ("openssl", "openssl licen", "openssl licen[sc]e", ()),
    ("php", "php licen", "php licen[sc]e", ("3.0", "3.01")),
    ("psf", "python software foundation licen", "python software foundation licen[sc]e", ("2",)),
    ("ruby", "ruby licen", "ruby licen[sc]e", ()),
    ("postgresql", "postgresql licen", "postgresql licen[sc]e", ()),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", ()),
    ("zpl", "zope public licen", "zope public licen[sc]e", ("1.1", "2.0", "2.1")),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)? licen[sc]e", ()),
    ("sleepycat", "sleepycat", "sleepycat(?: public)? licen[sc]e", ()),
    ("ecl", "educational community licen", "educational community licen[sc]e", ("1.0", "2.0")),
    ("upl", "universal permissive licen", "universal permissive licen[sc]e", ("1.0",)),
    ("mulan", "mulan", "mulan(?: permissive software| psl)(?: licen[sc]e)?", ("1.0", "2.0")),
    ("ofl", "open font licen", "(?:sil )?open font licen[sc]e", ("1.0", "1.1")),
    ("odbl", "open database licen", "(?:open data commons )?open database licen[sc]e", ("1.0",)),
    ("odc-by", "open data commons attribution", "open data commons attribution licen[sc]e", ("1.0",)),
    ("pddl", "public domain dedication", "(?:odc )?public domain dedication and licen[sc]e", ("1.0",)),
    ("cc0", "cc0", "(?:creative commons )?cc0", ("1.0",)),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("1.0", "2.0")),
    ("qpl", "q public licen", "q public licen[sc]e", ("1.0",)),
    ("vim", "vim licen", "vim licen[sc]e", ()),
    ("nasa", "nasa open source", "nasa open source agreement", ("1.3",)),
    ("rpl", "reciprocal public licen", "reciprocal public licen[sc]e", ("1.1", "1.5")),
    ("llama", "llama", "llama (?:[234] )?community licen[sc]e", ()),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?", ()),
    ("commons-clause", "commons clause", "commons clause(?: licen[sc]e)?", ("1.0",)),
)

# The terms of Creative Commons licenses and how they are spelled out.
CC_TERMS = (
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nd", "attribution no ?deriv(?:ative)?s"),
    ("by nc", "attribution non ?commercial"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Label, tier, keyword, and a sentence or address that names no version.
SENTENCES = (
    ("mit", GRANT, "hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", GRANT, "opensource org", "opensource org licenses? mit"),
    ("apache-2.0", GRANT, "apache org", "(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", GRANT, "in compliance with the license",
     "you may not use this (?:file|work) except in compliance with the license"),
    ("bsd", GRANT, "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", GRANT, "endorse or promote products",
     "may (?:not )?be used to endorse or promote products derived from"),
    ("bsd-4-clause", GRANT, "advertising materials",
     "all advertising materials mentioning features or use of this software"),
    ("isc", GRANT, "distribute this software for any purpose",
     "permission to use copy modify and(?: or)? distribute this software for any purpose"
     " with or without fee is hereby granted"),
    ("gpl", GRANT, "under the terms of the gnu general public licen",
     "under the terms of the gnu general public licen[sc]e"),
    ("gpl", GRANT, "gnu org", "(?:www )?gnu org licenses gpl"),
    ("gpl-2.0", GRANT, "either version 2 of the licen", "either version 2 of the licen[sc]e or"),
    ("gpl-3.0", GRANT, "either version 3 of the licen", "either version 3 of the licen[sc]e or"),
    ("lgpl", GRANT, "under the terms of the gnu lesser",
     "under the terms of the gnu lesser general public licen[sc]e"),
    ("lgpl", GRANT, "gnu org", "(?:www )?gnu org licenses lgpl"),
    ("agpl", GRANT, "gnu org", "(?:www )?gnu org licenses agpl"),
    ("mpl-2.0", GRANT, "mozilla public licen",
     "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-2.0", GRANT, "mozilla org", "mozilla org mpl 2 0"),
    ("epl", GRANT, "eclipse org", "(?:www )?eclipse org legal epl"),
    ("bsl-1.0", GRANT, "boost org", "(?:www )?boost org license 1 0"),
    ("zlib", GRANT, "without any express or implied warranty",
     "this software is provided as is without any express or implied warranty"),
    ("unlicense", GRANT, "free and unencumbered software",
     "this is free and unencumbered software released into the public domain"),
    ("unlicense", GRANT, "unlicense org", "unlicense org"),
    ("wtfpl", GRANT, "what the fuck you want", "do what the fuck you want to public licen[sc]e"),
    ("cc0-1.0", GRANT, "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("ofl", GRANT, "scripts sil org", "scripts sil org ofl"),
    ("public-domain", GRANT, "public domain",
     "(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", HINT, "public domain", "public domain"),
    ("proprietary", GRANT, "all rights reserved", "all rights reserved"),
    ("proprietary", GRANT, "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", HINT, "end user licen", "end user licen[sc]e agreement"),
    ("non-commercial", HINT, "commercial use", "(?:for )?non commercial use only"),
    ("unknown-license", HINT, "licensed under", "licensed under"),
    ("unknown-license", HINT, "terms of the licen", "terms of the licen[sc]e"),
    ("unknown-license", HINT, "open source licen", "open source licen[sc]e"),
)

_GRANTED = (
    "(?:licensed|released|distributed|available|provided|published|covered)"
    " (?:under|by|according to) (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?"
)


def _version(version: str) -> str:
    """`2.0` reads `2`, `2 0`, `v2`, `v2 0` or `version 2 0`; other minor numbers have to be there."""
    major, _, minor = version.partition(".")
    tail = "" if not minor else "(?: 0)?" if minor == "0" else f" {minor}"
    return f"(?:version |ver |v)?{major}{tail}"


def _forms(label: str, keyword: str, name: str, spdx: str) -> list[Rule]:
    """The forms in which a name occurs: a machine-readable tag, a grant, the bare name."""
    return [
        Rule(label, TAG, "spdx license identifier", f"spdx license identifier {spdx}"),
        Rule(label, GRANT, keyword, _GRANTED + name),
        Rule(label, TITLE, keyword, name),
    ]


def _family(label: str, keyword: str, name: str, versions: tuple[str, ...]) -> list[Rule]:
    tag = label.replace("-", " ")
    rules = _forms(label, keyword, name, tag)
    if label in ("apache", "gpl", "lgpl", "agpl", "mpl", "epl"):
        rules.pop()  # the word alone is often a project's name, and base rules name the license
    for version in versions:
        number = _version(version)
        later = "(?: or (?:later|newer|any later version)| only)?"
        rules += _forms(
            f"{label}-{version}",
            keyword,
            f"{name}(?: licen[sc]e)? {number}{later}",
            f"{tag} {number}{later}",
        )
    return rules


def _creative_commons() -> list[Rule]:
    rules = []
    for code, spelled in CC_TERMS:
        label = "cc-" + code.replace(" ", "-")
        spelled = spelled.replace(" ?", "(?: )?")
        for version in (None, *CC_VERSIONS):
            number = f" {_version(version)}(?: international| unported)?" if version else ""
            path = f" {_version(version)}" if version else ""
            own = f"{label}-{version}" if version else label
            rules += _forms(own, f"cc {code}", f"cc {code}{number}", f"cc {code}{number}")
            rules += _forms(
                own,
                "creative commons attribution",
                f"creative commons {spelled}{number}(?: licen[sc]e)?",
                f"cc {code}{number}",
            )[1:]
            rules.append(
                Rule(own, GRANT, "creativecommons org",
                     f"creativecommons org licenses {code}{path}")
            )
    return rules


def all_rules() -> tuple[Rule, ...]:
    """Every rule once, in order: base, sentences, families, Creative Commons."""
    rules = [*BASE, *(Rule(*s) for s in SENTENCES)]
    for entry in FAMILIES:
        rules += _family(*entry)
    return tuple(dict.fromkeys(rules + _creative_commons()))


RULES = all_rules()
