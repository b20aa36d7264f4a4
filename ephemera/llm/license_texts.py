"""Licence texts, standard notices and openings, and their search in windows of any text by TF-IDF cosine."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

import numpy as np

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile("[a-z0-9]+")
TIERS = {"text": 0.9, "notice": 0.85, "opening": 0.85}  # least cosine; the first tier with a match decides

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_MIT_OPENING = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_OPENING = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
    "appear in all copies."
)
_ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE '
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
_GNU = {
    "GPL-2.0": ("program", "GNU General Public License", "2"), "GPL-3.0": ("program", "GNU General Public License", "3"), "LGPL-2.1": ("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("library", "GNU Lesser General Public License", "3"), "AGPL-3.0": ("program", "GNU Affero General Public License", "3"),
}
_CC = {"CC-BY-4.0": ("Attribution", "by"), "CC-BY-SA-4.0": ("Attribution-ShareAlike", "by-sa"), "CC-BY-NC-4.0": ("Attribution-NonCommercial", "by-nc")}
_NETWORK = (
    "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network "
    "(if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge"
)


def license_texts() -> list[tuple[str, str, str]]:
    """(tier, license, text).  The AGPL's text is the GPL's with its name and its network section; it is compared by words only."""
    long = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    affero = re.sub("(?i)GNU General", "GNU Affero General", long["GPL-3.0"]) + _NETWORK
    out = [("text", k, t) for k, t in long.items()] + [("text", "AGPL-3.0", affero)]
    out += [("text", "BSD-2-Clause", f"{_BSD_OPENING} {_BSD_2} {_AS_IS}"), ("text", "BSD-3-Clause", f"{_BSD_OPENING} {_BSD_2} {_BSD_3} {_AS_IS}")]
    out += [("text", "MIT", f"{_MIT_OPENING} {_MIT_REST}"), ("text", "ISC", f"{_ISC_OPENING} {_ISC_REST}"), ("notice", "Apache-2.0", _APACHE), ("notice", "MPL-2.0", _MPL)]
    for k, (thing, name, version) in _GNU.items():
        head = (
            f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the "
            "License, or (at your option) any later version."
        )
        rest = (
            f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
            f"See the {name} for more details. You should have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
        )
        out += [("notice", k, f"{head} {rest}"), ("opening", k, head)]
    for k, (name, short) in _CC.items():
        head = f"This work is licensed under a Creative Commons {name} 4.0 International License."
        out += [("notice", k, f"{head} To view a copy of this license, visit http://creativecommons.org/licenses/{short}/4.0/"), ("opening", k, head)]
    out += [("notice", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.")]
    return [*out, ("opening", "BSD-3-Clause", _BSD_OPENING), ("opening", "MIT", _MIT_OPENING), ("opening", "ISC", _ISC_OPENING)]


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_FOLD))


class Windows:
    """Templates as unit TF-IDF vectors; texts are searched in windows of each template's length, or whole if shorter."""

    def __init__(self, templates: Iterable[tuple[str, str, str]], cuts: dict[str, float]):
        kept = [(tier, name, tokens_of(text)) for tier, name, text in templates]
        self.names, self.cuts = [(tier, name, len(t)) for tier, name, t in kept], cuts
        df = Counter(w for _, _, t in kept for w in set(t))
        self.ids = {w: k for k, w in enumerate(df)}
        self.rare = math.log(1.0 + len(kept)) + 1.0
        self.idf = np.array([math.log((1.0 + len(kept)) / (1.0 + n)) + 1.0 for n in df.values()])
        self.weight = np.zeros((len(kept), len(df)))
        for k, (_, _, t) in enumerate(kept):
            for w, n in Counter(t).items():
                self.weight[k, self.ids[w]] = n * self.idf[self.ids[w]]
            self.weight[k] /= np.linalg.norm(self.weight[k])

    def best(self, text: str) -> tuple[str, str, float, float] | None:
        """(tier, license, cosine, share of the text's words in the window): the best of the first tier with a match."""
        words = tokens_of(text)
        n = len(words)
        if not n:
            return None
        own: dict[str, int] = {}  # words of no template, each with a place of its own
        ids = np.fromiter((k if (k := self.ids.get(w)) is not None else len(self.idf) + own.setdefault(w, len(own)) for w in words), np.int64, n)
        idf = np.concatenate([self.idf, np.full(len(own), self.rare)])
        known = np.where(ids < len(self.idf), ids, 0)
        squares = np.concatenate([[0.0], np.cumsum(idf[ids] ** 2)])
        found: dict[str, list[tuple[float, str, float]]] = {tier: [] for tier in self.cuts}
        for k, (tier, name, length) in enumerate(self.names):
            size = min(length, n)
            at = np.unique(np.append(np.arange(0, n - size + 1, max(1, size // 16)), n - size))
            dots = np.concatenate([[0.0], np.cumsum(np.where(ids < len(self.idf), self.idf[known] * self.weight[k, known], 0.0))])
            dot = dots[at + size] - dots[at]
            # counts only lengthen the window's vector, so the sum of single squares bounds the cosine from above
            hit = dot >= self.cuts[tier] * np.sqrt(squares[at + size] - squares[at])
            exact = [(self._cosine(ids[a : a + size], idf, d), a) for a, d in zip(at[hit].tolist(), dot[hit].tolist(), strict=True)]
            if exact and max(exact)[0] >= self.cuts[tier]:
                near = max(exact)[1]  # windows start some words apart; the places between decide among like templates
                step = max(1, size // 16)
                every = range(max(0, near - step), min(n - size, near + step) + 1)
                cosine = max(self._cosine(ids[a : a + size], idf, dots[a + size] - dots[a]) for a in every)
                found[tier].append((-cosine, name, size / n))
        for tier, hits in found.items():
            if hits:
                c, name, share = min(hits)
                return tier, name, -c, share
        return None

    @staticmethod
    def _cosine(window: np.ndarray, idf: np.ndarray, dot: float) -> float:
        u, c = np.unique(window, return_counts=True)
        return round(float(dot) / float(np.linalg.norm(c * idf[u])), 9)
