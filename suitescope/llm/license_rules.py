"""Ordered signature rules for licences, over normalised words.

A rule is (keyword, label, priority, pattern).  Patterns see lower-case words with one space before
each; a rule is tried only if its keyword stands in the text.  A higher priority wins between
detections of the same words.  Families with versions are made from templates.
"""

from __future__ import annotations

#: The contract's phrases: always reported, whatever suppresses them otherwise.
BASE = (
    ("license", "gpl", "gnu general public license"),
    ("license", "apache", "apache license"),
    ("cc", "cc-by", "cc by"),
    ("license", "mit", "mit license"),
)

_V = r"(?: version| v| ver)?"


def _versioned(keyword: str, label: str, name: str, versions: tuple[str, ...], later: bool = False) -> list[tuple[str, str, int, str]]:
    """A rule for the name alone, one for each version, and for 'or later' where the family knows it."""
    rules = [(keyword, label, 60, name)]
    for v in versions:
        words = v.replace(".", " ")
        number = words if not words.endswith(" 0") else f"{words[:-2]}(?: 0)?"
        rules.append((keyword, f"{label}-{v}", 90, f"{name}{_V} v?{number}"))
        if later:
            rules.append((keyword, f"{label}-{v}-or-later", 95, f"{name}{_V} v?{number} or(?: at your option)?(?: any)? later(?: version)?"))
            rules.append((keyword, f"{label}-{v}-only", 95, f"{name}{_V} v?{number} only"))
    return rules


def rules() -> list[tuple[str, str, int, str]]:
    out: list[tuple[str, str, int, str]] = []
    out += _versioned("general public", "gpl", "gnu general public licen[sc]e", ("1.0", "2.0", "3.0"), later=True)
    out += _versioned("lesser general public", "lgpl", "(?:gnu )?lesser general public licen[sc]e", ("2.1", "3.0"), later=True)
    out += _versioned("library general public", "lgpl", "(?:gnu )?library general public licen[sc]e", ("2.0",), later=True)
    out += _versioned("affero general public", "agpl", "(?:gnu )?affero general public licen[sc]e", ("1.0", "3.0"), later=True)
    out += _versioned("gpl", "gpl", "(?:gnu )?gpl", ("1.0", "2.0", "3.0"), later=True)
    out += _versioned("lgpl", "lgpl", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0"), later=True)
    out += _versioned("agpl", "agpl", "(?:gnu )?agpl", ("1.0", "3.0"), later=True)
    out += _versioned("free documentation", "gfdl", "(?:gnu )?free documentation licen[sc]e", ("1.1", "1.2", "1.3"), later=True)
    out += _versioned("apache", "apache", "apache(?: software)? licen[sc]e", ("1.0", "1.1", "2.0"))
    out += _versioned("mozilla", "mpl", "mozilla public licen[sc]e", ("1.0", "1.1", "2.0"))
    out += _versioned("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0"))[1:]
    out += _versioned("eclipse", "epl", "eclipse public licen[sc]e", ("1.0", "2.0"))
    out += _versioned("common development", "cddl", "common development and distribution licen[sc]e", ("1.0", "1.1"))
    out += _versioned("common public", "cpl", "common public licen[sc]e", ("1.0",))
    out += _versioned("ibm public", "ipl", "ibm public licen[sc]e", ("1.0",))
    out += _versioned("european union", "eupl", "european union public licen[sc]e", ("1.0", "1.1", "1.2"))
    out += _versioned("artistic", "artistic", "artistic licen[sc]e", ("1.0", "2.0"))
    out += _versioned("academic free", "afl", "academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0"))
    out += _versioned("open software", "osl", "open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0"))
    out += _versioned("boost", "bsl", "boost software licen[sc]e", ("1.0",))
    out += _versioned("zope", "zpl", "zope public licen[sc]e", ("1.1", "2.0", "2.1"))
    out += _versioned("php", "php", "php licen[sc]e", ("3.0", "3.01"))
    out += _versioned("sil open font", "ofl", "sil open font licen[sc]e", ("1.0", "1.1"))
    out += _versioned("open data", "odbl", "open data(?:base| commons open database) licen[sc]e", ("1.0",))
    out += _versioned("latex project", "lppl", "latex project public licen[sc]e", ("1.0", "1.2", "1.3c"))
    out += _versioned("python software", "psf", "python software foundation licen[sc]e", ("2.0",))
    out += _versioned("business source", "busl", "business source licen[sc]e", ("1.1",))
    out += _versioned("elastic", "elastic", "elastic licen[sc]e", ("1.0", "2.0"))
    out += _versioned("server side public", "sspl", "server side public licen[sc]e", ("1.0",))
    out += _versioned("microsoft public", "ms-pl", "microsoft public licen[sc]e", ())
    out += _versioned("microsoft reciprocal", "ms-rl", "microsoft reciprocal licen[sc]e", ())
    for short, long in (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s")):
        label = "cc-" + short.replace(" ", "-")
        for keyword, name in (("cc", f"cc {short}"), ("creative commons", f"creative commons {long}")):
            out += _versioned(keyword, label, name, ("1.0", "2.0", "2.5", "3.0", "4.0"))
    out += [
        ("licen", "mit", 70, "mit licen[sc]e"),
        ("license", "mit", 60, "licensed under the mit"),
        ("licen", "mit", 60, "expat licen[sc]e"),
        ("permission is hereby granted", "mit", 80, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("licen", "isc", 70, "isc licen[sc]e"),
        ("permission to use", "isc", 75, "permission to use copy modify and or distribute this software for any purpose with or without fee"),
        ("bsd", "bsd", 50, "bsd licen[sc]e"),
        ("bsd", "bsd-2-clause", 80, "bsd 2 clause(?: licen[sc]e)?"),
        ("bsd", "bsd-2-clause", 80, "2 clause bsd(?: licen[sc]e)?"),
        ("bsd", "bsd-2-clause", 80, "simplified bsd(?: licen[sc]e)?"),
        ("bsd", "bsd-3-clause", 80, "bsd 3 clause(?: licen[sc]e)?"),
        ("bsd", "bsd-3-clause", 80, "3 clause bsd(?: licen[sc]e)?"),
        ("bsd", "bsd-3-clause", 80, "(?:new|revised|modified) bsd(?: licen[sc]e)?"),
        ("bsd", "bsd-4-clause", 80, "bsd 4 clause(?: licen[sc]e)?"),
        ("bsd", "0bsd", 80, "zero clause bsd(?: licen[sc]e)?"),
        ("redistribution and use", "bsd", 65, "redistribution and use in source and binary forms with or without modification are permitted"),
        ("neither the name", "bsd-3-clause", 75, "neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors"),
        ("creative commons", "cc0-1.0", 85, "creative commons zero(?: 1 0)?"),
        ("cc0", "cc0-1.0", 85, "cc0(?: 1 0)?"),
        ("creative commons", "cc", 40, "creative commons licen[sc]e"),
        ("unlicense", "unlicense", 70, "the unlicense"),
        ("free and unencumbered", "unlicense", 80, "free and unencumbered software released into the public domain"),
        ("public domain", "public-domain", 50, "(?:in|into|to) the public domain"),
        ("what the fuck", "wtfpl", 80, "do what the fuck you want to public licen[sc]e"),
        ("wtfpl", "wtfpl", 70, "wtfpl"),
        ("zlib", "zlib", 70, "zlib(?: libpng)? licen[sc]e"),
        ("beerware", "beerware", 70, "beerware licen[sc]e"),
        ("postgresql", "postgresql", 70, "postgresql licen[sc]e"),
        ("ruby", "ruby", 70, "ruby licen[sc]e"),
        ("vim", "vim", 70, "vim licen[sc]e"),
        ("openssl", "openssl", 70, "openssl licen[sc]e"),
        ("w3c", "w3c", 70, "w3c(?: software)? licen[sc]e"),
        ("intel open source", "intel", 70, "intel open source licen[sc]e"),
        ("json", "json", 70, "json licen[sc]e"),
        ("shall be used for good", "json", 80, "the software shall be used for good not evil"),
        ("university of illinois", "ncsa", 80, "university of illinois ncsa open source licen[sc]e"),
        ("universal permissive", "upl-1.0", 70, "universal permissive licen[sc]e"),
        ("commons clause", "commons-clause", 70, "commons clause"),
        ("all rights reserved", "proprietary", 30, "all rights reserved"),
        ("proprietary", "proprietary", 40, "proprietary and confidential"),
        ("dual", "dual", 30, "dual licensed"),
    ]
    return [(k, label, p, pattern) for k, label, p, pattern in out]
