"""Known licence texts (fixed values), as published, by SPDX id.

Short ones are below: 0BSD, Apache-2.0-notice, BSD-2-Clause, BSD-3-Clause, ISC, MIT, MIT-0, Unlicense, WTFPL, Zlib.  Long ones are the
files of ``license_data/``, one per id: Apache-2.0, CC0-1.0, GFDL-1.2 and 1.3, GPL-1.0 to 3.0, LGPL-2.0 to 3.0, MPL-1.1 and 2.0; each
is known whole, and without the appendix that says how to apply it, with or without the line that ends the terms.  A text can't tell
"only" from "or later", so the ids don't either.  AGPL, EPL and others are not in the list.
"""

import re
from importlib.resources import files

_AS_IS_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_BSD_2 = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""

_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""

_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""

_MIT_NOTICE = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""

_MIT_AS_IS = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_ISC_GRANT = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""

_ISC_AS_IS = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

_APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.
"""

_UNLICENSE = """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""

_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""

_WTFPL = """
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as
the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.
"""

#: (SPDX id, text); a text with its customary title is the same licence, so both forms are listed.
#: Where the terms end, and where the part on applying them begins.
_TERMS_END = re.compile(r"^[ ]*END OF TERMS AND CONDITIONS", re.MULTILINE)
_APPENDIX = re.compile(r"^[ ]*(?:appendix:|addendum:|how to apply these terms)", re.MULTILINE | re.IGNORECASE)


def _long_texts() -> tuple[tuple[str, str], ...]:
    """(id, text) of the files: the whole text, and what precedes each of the marks above."""
    out = []
    for file in sorted(files(__package__).joinpath("license_data").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        cuts = [m.start() for mark in (_TERMS_END, _APPENDIX) if (m := mark.search(text))]
        out += [(file.name.removesuffix(".txt"), text[:end]) for end in (len(text), *cuts)]
    return tuple(out)


LICENSES = (
    ("0BSD", _ISC_GRANT + "." + _ISC_AS_IS),
    ("0BSD", "BSD Zero Clause License\n" + _ISC_GRANT + "." + _ISC_AS_IS),
    ("Apache-2.0-notice", _APACHE_NOTICE),
    ("BSD-2-Clause", _BSD_2 + _AS_IS_BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2 + _AS_IS_BSD),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _AS_IS_BSD),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _AS_IS_BSD),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_AS_IS),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_AS_IS),
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _MIT_AS_IS),
    ("MIT", "MIT License\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_AS_IS),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_AS_IS),
    ("MIT-0", _MIT_GRANT + "." + _MIT_AS_IS),
    ("MIT-0", "MIT No Attribution\n" + _MIT_GRANT + "." + _MIT_AS_IS),
    ("Unlicense", _UNLICENSE),
    ("WTFPL", _WTFPL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
) + _long_texts()
