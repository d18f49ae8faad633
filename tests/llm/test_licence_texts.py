"""Licence texts as they are printed, with their own punctuation, lists and URLs."""

import pytest

from gridloom.llm.licenses import license_scan

GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
SPDX = {"MIT": "mit-spdx", "Apache-2.0": "apache-spdx", "GPL-3.0-or-later": "gpl3-spdx-later", "GPL-3.0-only": "gpl3-spdx-only", "GPL-2.0-only": "gpl2-spdx", "BSD-3-Clause": "bsd3-spdx", "BSD-2-Clause": "bsd2-spdx"}
CASES = [(f"// SPDX-License-Identifier: {k}\nint main() {{}}\n", k, f"{r}*1") for k, r in SPDX.items()]
CASES += [
    (GPL.format(":", ",", 3), "GPL-3.0-or-later", "gpl3-header*1"),
    (GPL.format(";", ";", 2), "GPL-2.0-or-later", "gpl2-header*1"),
    (BSD, "BSD-2-Clause", "bsd2-text*1"),
    (BSD + BSD3, "BSD-3-Clause", "bsd3-text*1"),
    (MPL, "MPL-2.0", "mpl-header*1"),
    (MPL + " More words follow.", "MPL-2.0", "mpl-header*1"),
    # The reading by lines holds the short header only; each rule counts as in the reading that has more of it.
    (APACHE, "Apache-2.0", "apache-header*1,apache-header-short*1"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = license_scan(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, text string")).collect()
    return {r.doc_id: (r.licenses, r.rules) for r in rows}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_printed_text(found, k):
    assert found[k] == CASES[k][1:]
