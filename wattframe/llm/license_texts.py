"""What license scans look for by default: texts and notices of public licenses, and common one-line wordings.

The one-line wordings come from a rule (names by phrases), the others are fixed values.
"""

# Names under which licenses are spoken of, by SPDX identifier.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence, version 1.2"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"],
    "ODbL-1.0": ["Open Database License 1.0", "Open Data Commons Open Database License"],
}
# Phrases around a name.
PHRASES = ["licensed under the {}", "licensed under a {}", "licensed under {}", "released under the {}", "distributed under the {}",
           "available under the {}", "licensed under the terms of the {}", "distributed under the terms of the {}",
           "subject to the terms of the {}"]

# Notices and texts of licenses.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software.")
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_GNU_NOTICE = (
    "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as "
    "published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.")
NOTICES = [
    ("apache-2.0-notice", "Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
     "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("apache-2.0-foundation", "Apache-2.0",
     "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
     "distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under "
     "the Apache License, Version 2.0"),
    ("apache-2.0-copyright-grant", "Apache-2.0",
     "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a "
     "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative "
     "Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("mit-permission", "MIT", _MIT_GRANT),
    ("mit-text", "MIT", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("bsd-2-conditions", "BSD-2-Clause", _BSD_TWO),
    ("bsd-2-text", "BSD-2-Clause", f"{_BSD_TWO} {_BSD_WARRANTY}"),
    ("bsd-3-endorsement", "BSD-3-Clause", _BSD_THIRD),
    ("bsd-3-text", "BSD-3-Clause", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}"),
    ("isc-permission", "ISC", _ISC_GRANT),
    ("isc-text", "ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    ("gpl-2.0-notice", "GPL-2.0-or-later", _GNU_NOTICE.format(what="program", sep=";", kind="General", either="; either", version="2")),
    ("gpl-3.0-notice", "GPL-3.0-or-later", _GNU_NOTICE.format(what="program", sep=":", kind="General", either=", either", version="3")),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", _GNU_NOTICE.format(what="library", sep=";", kind="Lesser General", either="; either", version="2.1")),
    ("lgpl-3.0-notice", "LGPL-3.0-or-later", _GNU_NOTICE.format(what="program", sep=":", kind="Lesser General", either=", either", version="3")),
    ("agpl-3.0-notice", "AGPL-3.0-or-later", _GNU_NOTICE.format(what="program", sep=":", kind="Affero General", either=", either", version="3")),
    ("gpl-copies", "GPL",
     "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("gpl-preamble", "GPL",
     "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. "
     "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program"),
    ("mpl-2.0-notice", "MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2.0-notice", "EPL-2.0",
     "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
     "available at https://www.eclipse.org/legal/epl-2.0/"),
    ("bsl-1.0-notice", "BSL-1.0",
     "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
     "https://www.boost.org/LICENSE_1_0.txt)"),
    ("bsl-1.0-grant", "BSL-1.0",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
     "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("unlicense-text", "Unlicense",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
     "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means."),
    ("zlib-text", "Zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely"),
    ("wtfpl-text", "WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("cc0-notice", "CC0-1.0",
     "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
     "to the public domain worldwide. This software is distributed without any warranty."),
    ("cc-image-notice", "CC", "To view a copy of this license, visit http://creativecommons.org/licenses/"),
]


def common_wordings() -> list[tuple[str, str, str]]:
    """Every phrase with every name, and the SPDX line; those of at least five words."""
    out = []
    for kind, names in NAMES.items():
        texts = [p.format(n) for n in names for p in PHRASES] + [f"SPDX-License-Identifier: {kind}"]
        out += [(f"{kind.lower()}-line-{i}", kind, t) for i, t in enumerate(texts)
                if len([w for w in t.replace("-", " ").replace(".", " ").split() if w]) >= 5]
    return out
