"""Standard licence texts, wrapped as they usually occur."""

import textwrap

from plumbline.llm import licences

MIT = """The MIT License (MIT)
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{comma} either version {n} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
CASES = {
    "MIT": (MIT, "mt mg mn mw ml"),
    "Apache-2.0": (APACHE, "aa ac ao aw as"),
    "GPL-3.0-or-later": (GPL.format(mark=":", comma=",", n=3), "gf gw gd gr"),
    "GPL-2.0-or-later": (GPL.format(mark=";", comma=";", n=2), "ge gw gd gr"),
    "BSD-3-Clause": (BSD, "ba bb bc bd"),
}


def test_wrapped_licences(spark):
    rows, want = [], []
    for name, (text, codes) in CASES.items():
        for width in (60, 72, 78, 10_000):
            for lead, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n")):
                lines = [x for line in text.split("\n") for x in (textwrap.wrap(line, width) or [""])]
                rows.append((len(rows), "".join(lead + x + end for x in lines)))
                want.append(([name], codes.split()))
    rows.append((len(rows), "MIT License\ncode without an end\nLicensed under the MIT License; more\nAll rights reserved"))
    want.append((["MIT"], ["mt", "ma", "xr"]))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (names, codes) in enumerate(want):
        assert got[i].sentence_codes == codes, rows[i][1]
        assert got[i].licences == names
