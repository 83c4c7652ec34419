"""Templates for license scans: public notices and short licenses, as their publishers word them."""

from __future__ import annotations

# The wording of licenses and notices. Members of one family are put together from its parts.
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
    law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
    OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
    limitations under the License."""
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
    modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
    Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
    shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
    OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
    PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
    LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
    THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_CONDITION = """provided that the above copyright notice and this permission notice appear in all copies."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS"
    AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
    ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
    the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
    conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
    CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
    BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
    ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
    WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU_FIRST = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
    the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
GNU_HEADER = GNU_FIRST + """ This {what} is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
    FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along
    with this {what}. {end}"""
GNU_SEE = "If not, see https://www.gnu.org/licenses/."
GNU_WRITE = "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
GNU_OPENING = """GNU {name} Version {dated} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute
    verbatim copies of this license document, but changing it is not allowed."""
APACHE_OPENING = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
    DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
    Sections 1 through 9 of this document."""
MPL_OPENING = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
    contributes to the creation of, or owns Covered Software."""
EPL_OPENING = """Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").
    ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."""
CC_NOTICE = """This work is licensed under a Creative Commons {name} {version} International License. To view a copy of this license,
    visit https://creativecommons.org/licenses/{code}/{version}/"""
CC0_NOTICE = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
    https://creativecommons.org/publicdomain/zero/1.0/"""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
    including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
GNU = (
    ("GPL-2.0", "General Public License", "program", "2"),
    ("GPL-3.0", "General Public License", "program", "3"),
    ("LGPL-2.1", "Lesser General Public License", "library", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "library", "3"),
    ("AGPL-3.0", "Affero General Public License", "program", "3"),
)
GNU_DATED = {
    "GPL-2.0": ("2, June 1991", "1989, 1991"), "GPL-3.0": ("3, 29 June 2007", "2007"), "LGPL-2.1": ("2.1, February 1999", "1991, 1999"),
    "LGPL-3.0": ("3, 29 June 2007", "2007"), "AGPL-3.0": ("3, 19 November 2007", "2007"),
}
CC = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)

#: (license, template name, text).
NOTICES = (
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", APACHE_HEADER),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "project", "This project is licensed under the MIT License."),
    ("MIT", "text", MIT_TEXT),
    *((spdx, "line", f"This work is licensed under the GNU {name}, version {v}.") for spdx, name, _, v in GNU),
    *((spdx, f"header {k}", GNU_HEADER.format(name=name, what=what, version=v, end=end)) for spdx, name, what, v in GNU for k, end in enumerate((GNU_SEE, GNU_WRITE))),
    *((spdx, "first paragraph", GNU_FIRST.format(name=name, what=what, version=v)) for spdx, name, what, v in GNU),
    *((spdx, "opening", GNU_OPENING.format(name=name, dated=GNU_DATED[spdx][0], year=GNU_DATED[spdx][1])) for spdx, name, _, _ in GNU),
    ("Apache-2.0", "opening", APACHE_OPENING),
    ("MPL-2.0", "opening", MPL_OPENING),
    ("EPL-2.0", "opening", EPL_OPENING),
    *((f"CC-{code}-{v}", "line", f"Licensed under CC {code} {v}.") for code, _ in CC for v in ("3.0", "4.0")),
    *((f"CC-{code}-{v}", "notice", CC_NOTICE.format(name=name, code=code.lower(), version=v)) for code, name in CC for v in ("3.0", "4.0")),
    ("CC0-1.0", "notice", CC0_NOTICE),
    ("MPL-2.0", "header", MPL_HEADER),
    ("ISC", "text", f"{ISC_GRANT}, {ISC_CONDITION} {ISC_WARRANTY}"),
    ("0BSD", "text", f"{ISC_GRANT}. {ISC_WARRANTY}"),
    ("BSD-2-Clause", "text", f"{BSD_CONDITIONS} {BSD_WARRANTY}"),
    ("BSD-3-Clause", "text", f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_WARRANTY}"),
    ("Unlicense", "grant", UNLICENSE),
    ("Zlib", "text", ZLIB_TEXT),
    ("proprietary", "line", "All rights reserved."),
)
#: Licenses are also named by their identifiers.
TEMPLATES = (*NOTICES, *((spdx, "identifier", f"SPDX-License-Identifier: {spdx}") for spdx in dict.fromkeys(x[0] for x in NOTICES) if spdx != "proprietary"))
