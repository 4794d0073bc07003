"""Usual license families for `license_scan`: notices and whole texts, and the words that tell them apart."""
from __future__ import annotations

from pathlib import Path

_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _gnu(kind: str, version: str) -> list[tuple[str, str, str]]:
    name, subject = _NAMES[kind], "This library" if kind == "LGPL" else "This program"
    major = version.removesuffix(".0")
    return [
        (f"{kind}-{version}", "later", f"{subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
         f"Foundation, either version {major} of the License, or (at your option) any later version."),
        (f"{kind}-{version}", "only", f"{subject} is free software; you can redistribute it and/or modify it under the terms of the {name} version {major} as published by the "
         "Free Software Foundation."),
        (f"{kind}-{version}", "line", f"This work is licensed under the {name}, version {major}."),
        (f"{kind}-{version}", "short", f"Licensed under the {name} version {major}."),
    ]


def _creative_commons(kind: str, name: str, version: str) -> list[tuple[str, str, str]]:
    place = "International" if version == "4.0" else "Unported"
    return [
        (f"CC-{kind}-{version}", "short", f"Licensed under CC {kind} {version}."),
        (f"CC-{kind}-{version}", "notice", f"This work is licensed under a Creative Commons {name} {version} {place} License."),
        (f"CC-{kind}-{version}", "address", f"http://creativecommons.org/licenses/{kind.lower()}/{version}/"),
    ]


NOTICES = [
    ("MIT", "disclaimer", _MIT_DISCLAIMER),
    ("BSD", "disclaimer", _BSD_DISCLAIMER),
    ("BSD-2-Clause", "whole", f"{_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "whole", f"{_BSD_CLAUSES} {_BSD_NAME} {_BSD_DISCLAIMER}"),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
     "notice and this permission notice appear in all copies."),
    ("ISC", "line", "Released under the ISC License."),
    ("Zlib", "whole", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
     "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "notice", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "whole", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
     "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "line", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-1.0", "notice", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
     "this distribution"),
    ("EPL-2.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "version", "made available under the terms of the Eclipse Public License v. 2.0"),
    ("MPL-1.1", "notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("AGPL-3.0", "title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to "
     "copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation; version 2 of the License."),
    *[t for kind, version in (("GPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for t in _gnu(kind, version)],
    *[t for t in _gnu("GPL", "3.0") if t[1] in ("only", "short")],
    *[t for version in ("4.0", "3.0") for kind, name in _CC.items() for t in _creative_commons(kind, name, version) if t[:2] not in {("CC-BY-4.0", "notice"), ("CC-BY-NC-4.0", "short")}],
]

WHOLE = [(p.stem, "text", p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def required(license: str, variant: str) -> list[str]:
    """Phrases (of words in lower case) that a match must hold to be this license and no other of its family."""
    kind, _, version = license.partition("-")
    words = " ".join(version.removesuffix(".0").split("."))
    if kind in _NAMES:
        return ([] if variant in ("text", "title") else [f"version {words}"]) + [_NAMES[kind].lower()]
    if license.startswith("CC-"):
        *parts, number = license[3:].split("-")
        number = number.replace(".", " ")
        short = variant in ("short", "address") or (license, variant) == ("CC-BY-NC-4.0", "line")
        return [" ".join(parts if short else _CC["-".join(parts)].split("-")).lower() + f" {number}"]
    fixed = {
        "BSD-3-Clause": ["neither the name"], "Apache-2.0": ["apache license"], "EPL-2.0": ["eclipse public license", "2 0"], "EPL-1.0": ["eclipse public license v1 0"],
        "MPL-1.1": ["mozilla public license", "1 1"], "MPL-2.0": ["mozilla public license", "2 0"], "BSL-1.0": ["boost software license"],
    }
    return fixed.get(license, [])
