"""Known licence texts. All of this is fixed values: the texts decide the digests."""

from __future__ import annotations

MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

_BSD_START = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.
"""

APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.
"""

GPL3_NOTICE = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.
"""

MPL2_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""

FULL_TEXTS = {
    "MIT": MIT,
    "ISC": ISC,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_END,
    "Apache-2.0": APACHE_NOTICE,
    "GPL-3.0": GPL3_NOTICE,
    "MPL-2.0": MPL2_NOTICE,
}

#: (licence, digest of the canonical form, first words, number of words) of texts that are too long to stand
#: here: as distributed, and those with an appendix also up to "END OF TERMS AND CONDITIONS", with it and without.
DIGESTS = [
    (
        "Apache-2.0",
        "b92b346d7c8fecefc2c7b0baafed8da7616e21e1e289b13338f606b61b31caa4",
        "apache license version 2 0 january 2004 https",
        1594,
    ),
    (
        "Apache-2.0",
        "578e8a908cf04c687b7455c7ecd945a81752083ecfc175f9ea85bd45ee92172e",
        "apache license version 2 0 january 2004 https",
        1417,
    ),
    (
        "Apache-2.0",
        "1cf41422d292ab1a4e3f5cb98ed54a5067a49287191822d53c0ddf420c12d692",
        "apache license version 2 0 january 2004 https",
        1412,
    ),
    (
        "Artistic-1.0",
        "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651",
        "the artistic license",
        965,
    ),
    (
        "BSD-3-Clause",
        "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060",
        "redistribution and use in source and binary forms",
        211,
    ),
    (
        "CC0-1.0",
        "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a",
        "creative commons legal code",
        1083,
    ),
    (
        "GFDL-1.2",
        "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
        "gnu free documentation license version 1 2 november",
        3315,
    ),
    (
        "GFDL-1.3",
        "d7374b036964c10133ed58da66817d0e0ae178836f432a587b0ae2d282bcb009",
        "gnu free documentation license version 1 3 3",
        3728,
    ),
    (
        "GPL-1.0",
        "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746",
        "gnu general public license version 1 february 1989",
        2048,
    ),
    (
        "GPL-1.0",
        "0460830f1601ab5f615dd93818221b48820590af661686bdf540c70fe3d696a4",
        "gnu general public license version 1 february 1989",
        1622,
    ),
    (
        "GPL-1.0",
        "e865a0dda2da3969652b87fd53fdbacbc9c971447325f465df48971826e5f97c",
        "gnu general public license version 1 february 1989",
        1617,
    ),
    (
        "GPL-2.0",
        "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee",
        "gnu general public license version 2 june 1991",
        2955,
    ),
    (
        "GPL-2.0",
        "80edaf5771a2ca5e7df6a5c023beb15391e60cf1bbae81a82600bb184fecef39",
        "gnu general public license version 2 june 1991",
        2484,
    ),
    (
        "GPL-2.0",
        "724499132592c4e4c95c8d0a0a79e0045822f797839536a7338312694e3341bc",
        "gnu general public license version 2 june 1991",
        2479,
    ),
    (
        "GPL-3.0",
        "f052e013d4e854468743ce5ae9ad234d1c93f6e6979295ddd5ab7b41075af378",
        "gnu general public license version 3 29 june",
        5647,
    ),
    (
        "GPL-3.0",
        "b854898308b27e3fb8a1e509189334a13ad8cac2cd4f6994dc2a43b31507c049",
        "gnu general public license version 3 29 june",
        5204,
    ),
    (
        "GPL-3.0",
        "262026b7770bd690f676b232dc3497f7e87e94961b673f41fa25d2329ad3fa47",
        "gnu general public license version 3 29 june",
        5199,
    ),
    (
        "LGPL-2.0",
        "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2",
        "gnu library general public license version 2 june",
        4173,
    ),
    (
        "LGPL-2.0",
        "2894b2cb46a2c83844eec54a57337498c55bc0779fe2dbdd14bc94a567a3c32e",
        "gnu library general public license version 2 june",
        3838,
    ),
    (
        "LGPL-2.0",
        "9445838f80c534db1f71155f4c93f1464bf680d2a091792f3f2146f5cefef806",
        "gnu library general public license version 2 june",
        3833,
    ),
    (
        "LGPL-2.1",
        "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98",
        "gnu lesser general public license version 2 1",
        4373,
    ),
    (
        "LGPL-2.1",
        "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3",
        "gnu lesser general public license version 2 1",
        4037,
    ),
    (
        "LGPL-2.1",
        "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89",
        "gnu lesser general public license version 2 1",
        4032,
    ),
    (
        "LGPL-3.0",
        "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
        "gnu lesser general public license version 3 29",
        1211,
    ),
    (
        "MPL-1.1",
        "e30238f1f1098ff48c4eecfdf21157b7b4c87cc3134fe78d06d113177eb9fb06",
        "mozilla public license version 1 1",
        3689,
    ),
    (
        "MPL-2.0",
        "df7f4fef22e06f116c36fbe097f2497115599b35e78caa088788e446b6a998b5",
        "mozilla public license version 2 0",
        2338,
    ),
]

#: Names in statements such as "Released under the MIT License."
NAMES = {
    "MIT": ("the MIT License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "GPL 2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "GPL 3.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC0-1.0": ("CC0 1.0",),
}
STATEMENTS = (
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "This work is licensed under {}.",
    "This software is licensed under {}.",
    "This project is licensed under {}.",
)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the full texts and of every statement with every name."""
    statements = [
        (licence, form.format(name))
        for licence, names in NAMES.items() for name in names for form in STATEMENTS
    ]
    return [*FULL_TEXTS.items(), *statements]
