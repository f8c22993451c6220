"""Texts of known public licences and the short notices that name them (fixed values)."""

from __future__ import annotations

from pathlib import Path

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.
"""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""

#: (identifier, text)
LICENCES = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

"""
        + _WARRANTY,
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.""",
    ),
    ("BSD-2-Clause", _BSD_START + "\n" + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD_START
        + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.

"""
        + _BSD_END,
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
)

#: (identifier, notice)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
)

#: Spellings that mean the same; (pattern in normalised text, one form). Whole words.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("merchantibility", "merchantability"),
)

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

#: Last line of a licence that an appendix on its use may follow.
TERMS_END = "END OF TERMS AND CONDITIONS"

#: Identifier, with what names the licence in a sentence.
NAMES = (
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License")),
    ("MIT", ("MIT License",)),
    ("ISC", ("ISC License",)),
    ("Zlib", ("zlib License",)),
    ("Unlicense", ("Unlicense",)),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("MPL-1.1", ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1")),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL, v. 2.0")),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License")),
)
GNU = (
    ("GPL", ("GNU General Public License", "GNU GPL", "GPL"), ("1.0", "2.0", "3.0")),
    ("LGPL", ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), ("2.1", "3.0")),
    ("AGPL", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), ("3.0",)),
    ("GFDL", ("GNU Free Documentation License", "GNU FDL", "GFDL"), ("1.1", "1.2", "1.3")),
)
CREATIVE = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
LATER = ("or later", "or any later version", "or (at your option) any later version")
#: How a normalised sentence that names a licence may start; all count as "licensed under ".
OPENING = (
    r"^((this|the) (work|file|software|project|program|library|code|source code|document|text|dataset|content) is )?"
    r"(licensed|released|distributed|published|available|made available) under (the )?(terms of (the )?)?"
)


def _names() -> list[tuple[str, str]]:
    found = [(key, name) for key, names in NAMES for name in names]
    for family, names, versions in GNU:
        for version in versions:
            short = {version, version.removesuffix(".0")}
            for name in names:
                for v in sorted(short):
                    forms = [f"{name}, version {v}", f"{name} version {v}", f"{name} v{v}", f"{name} {v}"]
                    found += [(f"{family}-{version}-only", form) for form in [*forms, f"{forms[1]} only"]]
                    found += [(f"{family}-{version}-or-later", f"{form}, {later}") for form in forms for later in LATER]
    for part, words in CREATIVE:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            place = ["", " International"] if version == "4.0" else ["", " Unported"] if version == "3.0" else [""]
            names = [f"CC {part} {version}", f"CC-{part}-{version}", f"Creative Commons {words} {version}"]
            found += [(f"CC-{part}-{version}", f"{name}{end}{more}") for name in names for end in place for more in ("", " License")]
    return found


def more_notices() -> list[tuple[str, str]]:
    """(identifier, notice): SPDX lines, sentences that name a licence, first lines of usual headers."""
    names = _names()
    keys = sorted({key for key, _ in names} | {"0BSD"})
    found = [(key, f"SPDX-License-Identifier: {key}") for key in keys]
    # The former identifiers, without "-only". One that ends in "+" normalises to the same and counts as this.
    found += [(key, f"SPDX-License-Identifier: {key.removesuffix('-only')}") for key in keys if key.endswith("-only")]
    found += [(key, f"Licensed under {name}") for key, name in names]
    header = 'Licensed under the Apache License, Version 2.0 (the "License")'
    whole = f"{header}; you may not use this file except in compliance with the License."
    found += [("Apache-2.0", text) for text in (header, whole, f"{header}; you may not use this file")]
    return found


def more_licences() -> list[tuple[str, str]]:
    """(identifier, text): the files beside this module, also without what follows TERMS_END, and the Unlicense."""
    found = [("Unlicense", UNLICENSE)]
    for file in sorted((Path(__file__).parent / "licence_files").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        found.append((file.stem, text))
        if TERMS_END in text:
            terms = text[: text.index(TERMS_END)]
            found += [(file.stem, terms), (file.stem, terms + TERMS_END)]
    return found
