"""Unabridged licence texts, in any wrapping."""

import textwrap

import pytest

from textfacts.llm.licences import scan

MIT = """MIT License

Copyright (c) 2020-2023 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Copyright (c) 2004, The Holder

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Copyright (c) 2011, Some University. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_NAME = """
3. Neither the name of Some University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} version {4} of the License, or (at your option) any later version."
TEXTS = {
    "MIT": MIT,
    "ISC": ISC,
    "BSD-2-Clause": BSD.format(""),
    "BSD-3-Clause": BSD.format(BSD_NAME),
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL.format("This program", ":", "", ", either", 3),
    "GPL-2.0-or-later": GPL.format("This program", ";", "", "; either", 2),
    "LGPL-2.1-or-later": GPL.format("This library", ";", "Lesser ", "; either", "2.1"),
    "AGPL-3.0-or-later": GPL.format("Some Tool", ":", "Affero ", ", either", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@pytest.mark.parametrize("name", TEXTS)
def test_full_texts_in_any_wrapping(name):
    text = TEXTS[name]
    for width in (30, 72, 10_000):
        wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
        for mark in ("", "# ", " * ", "// "):
            source = textwrap.indent(wrapped, mark, lambda _: True)
            got = scan("Zwei Wörter İ.\n\n" + source + "\n\nint main() { return 0; }\n")
            assert [m[0] for m in got] == [name], (width, mark)
    found = scan(text)[0]
    assert found[1] == 0 and (name == "MPL-2.0" or found[2] == len(text))


def test_single_lines():
    names = lambda t: [m[0] for m in scan(t)]
    assert names("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999") == ["LGPL-2.1-only"]
    assert names("This project is licensed under\nthe MIT License; see LICENSE.") == ["MIT"]
    assert names("Released under the MIT License\nby the authors\nSPDX-License-Identifier: (Apache-2.0 OR MIT)\n") == ["MIT", "(Apache-2.0 OR MIT)"]
    assert names("© 2020 X. A word on the permission that is hereby granted, free of charge, to nobody.") == []
