"""Licence scan: a sparse n-gram logistic regression names a paragraph's licence family, and templates confirm it."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.plan import computed_once
from fathom.llm.runtime import text_or_empty

NONE, UNKNOWN = "none", "unknown"

# The names by which each licence family is called.
NAMES: dict[str, list[str]] = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3", "AGPL"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache Software License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache 2.0"],
    "bsd": ["BSD License", "BSD-style license", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "New BSD License", "Simplified BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0"],
    "cc-by-nc": [
        "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 3.0", "CC-BY-NC-4.0",
    ],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs 3.0 Unported License", "CC BY-ND 4.0", "CC BY-ND 3.0", "CC-BY-ND-4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero", "CC0-1.0", "CC0"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v1.0", "EPL-2.0", "EPL-1.0", "EPL"],
    "gpl": [
        "GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL version 2", "GPL version 3", "GPL-3.0", "GPL-3.0-only",
        "GPL-3.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv3", "GPLv2", "GPL",
    ],
    "isc": ["ISC License", "ISC licence", "ISC"],
    "lgpl": [
        "GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Library General Public License", "GNU LGPL",
        "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPLv2.1", "LGPLv3", "LGPL",
    ],
    "mit": ["MIT License", "The MIT License (MIT)", "MIT/X11 license", "MIT licence", "MIT"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
}

# Sentences of the licences and of the notices that go with them.
BODIES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Affero General Public License for more details.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
    ],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the following terms: Attribution - you must give appropriate credit, provide a link to the license, and indicate if changes were made.", "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited."],
    "cc-by-nc": ["NonCommercial - You may not use the material for commercial purposes.", "This work may be shared for noncommercial purposes only, with attribution, under a Creative Commons Attribution-NonCommercial license."],
    "cc-by-nd": ["NoDerivatives - If you remix, transform, or build upon the material, you may not distribute the modified material."],
    "cc-by-sa": ["ShareAlike - If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law, under CC0."],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "public-domain": [
        "This work is in the public domain.", "Released into the public domain by its author.", "This file has been dedicated to the public domain.", "The text is public domain and may be used without restriction.",
        "I place this code in the public domain.", "Public domain: no rights reserved.", "This image is in the public domain because its copyright has expired.", "To the public domain, by the author.",
    ],
    "reserved": [
        "All rights reserved.", "Copyright (c) 2020 Example Corp. All rights reserved.", "© 2019 Example Ltd. All rights reserved.", "Copyright 1998-2004 by the authors.", "Copyright © 2011 Example Inc.", "(c) Copyright 2003 Example GmbH",
        "All rights reserved. No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the copyright owner.", "© 2016 Example Press",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "© 2008 Example, all rights reserved worldwide.", "© 1999 Example SA", "Copyright (C) 2015 The Example Authors", "© 2003-2007 Example Foundation", "Copyright 2014, Example GmbH. All rights reserved.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "For more information, please refer to <https://unlicense.org>",
    ],
}

# Licences of no known family. Those in even places train the unknown class, the others calibrate it.
OTHER_NAMES = [
    "Artistic License 2.0", "zlib License", "Boost Software License 1.0", "BSL-1.0", "Python Software Foundation License", "PSF-2.0", "WTFPL", "Do What The Fuck You Want To Public License",
    "European Union Public Licence 1.2", "EUPL-1.2", "Common Development and Distribution License", "CDDL-1.0", "Microsoft Public License", "MS-PL", "SIL Open Font License 1.1", "OFL-1.1",
    "OpenSSL License", "PostgreSQL License", "Academic Free License 3.0", "AFL-3.0", "Open Software License 3.0", "OSL-3.0", "Server Side Public License", "SSPL-1.0",
    "Business Source License 1.1", "BUSL-1.1", "Elastic License 2.0", "Ruby License", "PHP License 3.01", "PHP-3.01", "Zope Public License 2.1", "ZPL-2.1",
    "Open Database License", "ODbL-1.0", "GNU Free Documentation License", "GFDL-1.3", "LaTeX Project Public License", "LPPL-1.3c", "IBM Public License 1.0", "Common Public License 1.0",
    "Apache License, Version 1.1", "Apache-1.1", "Apache Software License, Version 1.0", "Apache License 1.1", "Mozilla Public License 1.1", "MPL-1.1", "Mozilla Public License, version 1.0", "Netscape Public License 1.1",
    "CeCILL-2.1", "CeCILL License", "University of Illinois/NCSA Open Source License", "NCSA", "Beerware License", "Vim License", "Open Publication License", "Sleepycat License",
    "Intel Simplified Software License", "Oracle Free Use Terms", "Sun Public License 1.0", "Lucent Public License 1.02",
]

# Frames in which a name stands. The first train, the second calibrate.
FRAMES = [
    "Licensed under the {}.", "Licensed under {}.", "This project is licensed under the {}.", "This work is licensed under a {}.", "Released under the {}.", "Released under {}.", "Distributed under the terms of the {}.",
    "This software is distributed under {}.", "SPDX-License-Identifier: {}", "License: {}", "The code is available under the {}.", "This file is subject to the terms and conditions of the {}.", "{}",
]
CALIBRATION_FRAMES = ["You may use this work under the {}.", "Published under {}.", "The source is provided under the terms of the {}.", "This library is licensed as {}", "{} applies to all files here.", "This file is under the {}."]

# Sentences that hold the same words and grant nothing.
ORDINARY = [
    "He lost his driving license on the way to the station.", "The MIT researchers published a paper on the topic.", "The Apache helicopter landed near the village.", "A license to fish costs ten dollars in this state.",
    "The copyright law was changed by the new parliament.", "She asked for permission to leave the room.", "The creative commons room is on the second floor.", "Our software is free to try for thirty days.",
    "The mozilla foundation held its meeting in May.", "All rights of the citizens were respected.", "The license plate of the car was missing.", "The gnu is an antelope that lives in Africa.",
    "The warranty covers parts and labour for two years.", "They studied at MIT and at the public school.", "Redistribution of land was the aim of the party.", "The restaurant lost its liquor license last year.",
    "The eclipse of the sun was seen from the public square.", "The library is open to the public on Sundays.", "The program starts at eight and ends at ten.", "A new version of the file was sent to the office.",
    "The terms of the contract were discussed at length.", "Conditions on the road are bad in winter.", "The source of the river lies in the mountains.", "The book was published by a small house in the north.",
    "He works for the software company that made this file.", "Public transport in the city is free of charge for children.", "The general spoke to the public about the war.", "The author of the novel was given a prize.",
    "The domain of the king reached the sea.", "The domain name was bought by a firm.", "The permission of the owner is needed to enter.", "The notice on the door said that the shop was closed.",
    "Copies of the letter were sent to the members.", "The parts of the work are sold by the metre.", "The license of the pilot was valid for a year.", "Attribution of the painting to the master is disputed.",
    "She used the tool to copy and modify the files in the folder.", "The distribution of income was uneven.", "The document describes the version of the program and its use.", "The contributors met in the main hall.",
    "Any person may use the pool without a fee.", "The project is under construction.", "The house is under the bridge.", "The company distributed the goods to the stores.", "The material is used for commercial purposes in the industry.",
    "The code of the building was changed.", "The text is short and may be read in an hour.", "The rights of the workers and the law of the land", "An original work by the young author was shown.", "The law allows it to the extent possible.",
    "Files and documentation are stored on the server.", "No part of the house was heated.", "He was released from prison into the care of his family.", "The film was released in the spring.", "The data are available from the office.",
    "The author has no interest in the matter.", "Everyone is free to come.", "The name of the holder is on the card.", "The free world watched the public debate.", "The modified engine was faster than the original.",
    "All people are equal before the law.", "We reserved a table for two.", "A table was reserved for the guests.", "The seats were reserved by the general.", "You should have received a letter by now.",
    "Version 2 of the plan was better than version 1.", "Chapter 3 of the book is about the public.", "See the section for more details.", "For more information please write to the office.", "The use of the road is free.",
    "The members of the public were invited to share their views.", "The purpose of the visit was to see the works.", "The limits of the law were tested in court.",
    "A hunting license is needed in the forest.", "The doctor lost the license to practise.", "He was given a licence to sell tobacco.", "She has a car and a license.", "The officer asked for a license and a passport.",
    "Copyright protects songs and books.", "The copyright on the song is held by the band.", "Lawyers explained what copyright means.", "The old license was sent back to the city.", "Without a license nobody may teach here.", "He was liable for the damages.", "Damages were paid by the author of the claim.",
]

# The commonest words of English, German, French and Spanish; no feature is made of them alone.
COMMON = frozenset(
    "a about after all also an and any are as at be because been but by can could do does each either for from had has have he her here him his how i if in into is it its just like made make may me more most my no not "
    "of on one only or other our out over own people said she should so some such than that the their them then there these they this time to two under up upon us was we were what when where which while who will with without would you your "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so und uns von vor war wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "como con del el ella ellos era es esta este ha las lo los más no o para pero por que se si sin sobre su sus un una uno y ya".split()
)
_NOTED = re.compile(r"[^\W\d_]")

#: The longest n-gram, and slots of the table in which features are looked up.
GRAMS, SLOTS = 3, 1 << 16
#: Share of a body sentence's word pairs that a paragraph must hold to be confirmed by it.
SIMILARITY = 0.6


@dataclass(frozen=True)
class Model:
    """families: the classes, `unknown` and `none` last. hashes: of the features with weights; weights: features x classes."""

    families: tuple[str, ...]
    hashes: tuple[int, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: Words of which every feature that can raise a family over `none` holds one.
    telling: tuple[str, ...]


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; the copyright sign stands for the word."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower().replace("©", " copyright "))
    return kept.split()


def _grams_of(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)}


def _hash(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _noted(word: str) -> bool:
    return word not in COMMON and len(word) > 1 and _NOTED.search(word) is not None


def examples(seed: int, frames: list[str], odd: int, rounds: int) -> tuple[list[str], list[str]]:
    """Names in frames, sentences of licences, other licences and ordinary sentences, with words around and words dropped."""
    rng = np.random.default_rng(seed)
    made_up = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 4))))
    common = sorted(COMMON)
    around = lambda: [made_up() if rng.random() < 0.5 else str(rng.choice(common)) for _ in range(int(rng.integers(0, 5)) if rng.random() < 0.5 else 0)]
    texts, labels = [], []

    def add(words: list[str], label: str) -> None:
        texts.append(" ".join(around() + words + around()))
        labels.append(label)

    for turn in range(rounds):
        for family, names in [*NAMES.items(), (UNKNOWN, OTHER_NAMES[odd::2])]:
            for k, name in enumerate(names):
                own = [f for i, f in enumerate(frames) if (i + k + turn) % 2 == 0]
                for f in own:
                    add(words_of(f.format(name)), family)
        for family, sentences in BODIES.items():
            for s in sentences:
                w = words_of(s)
                cut = int(rng.integers(0, max(1, len(w) // 3))) if len(w) > 12 else 0  # a wrapped line holds part of a sentence
                w = w[cut : len(w) - (int(rng.integers(0, max(1, len(w) // 3))) if len(w) > 12 else 0)]
                add([x for x in w if len(w) < 8 or rng.random() > 0.05], family)
        for s in ORDINARY:
            add(words_of(s), NONE)
        for _ in range(60):
            add([made_up() if rng.random() < 0.6 else str(rng.choice(common)) for _ in range(int(rng.integers(3, 30)))], NONE)
    return texts, labels


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(texts: list[str], features: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(features)), "f4")
    for i, t in enumerate(texts):
        for g in _grams_of(t.split()):
            if (k := features.get(g)) is not None:
                x[i, k] = 1
    return x


def _calibrated(z: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least cross entropy, by golden section over its logarithm."""
    loss = lambda t: float(-np.log(_softmax(z / np.exp(t))[np.arange(len(target)), target] + 1e-12).mean())
    lo, hi, g = -4.0, 4.0, (5**0.5 - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _parting(known: np.ndarray, strange: np.ndarray) -> float:
    """Halfway between two neighbouring values, where most known ones are above and most strange ones below."""
    every = np.unique(np.concatenate([[0.0, 1.0], known, strange]))
    cuts = (every[1:] + every[:-1]) / 2
    good = (known[None] >= cuts[:, None]).mean(1) + (strange[None] < cuts[:, None]).mean(1)
    return float(cuts[int(good.argmax())])


@lru_cache(maxsize=1)
def train(copies: int = 2, steps: int = 300) -> Model:
    """Softmax regression with an L1 penalty, by accelerated proximal gradient steps; other frames and licences calibrate.

    The families, `unknown` (other licences) and `none` are classes. Features are n-grams of up to GRAMS words, one of
    them not among the commonest. The temperature is the one with the least cross entropy on calibration sentences; the
    threshold parts the probabilities that families get there from those that other licences, never seen in training,
    get: a family below it is `unknown` too.
    """
    families = (*sorted(NAMES.keys() | BODIES.keys()), UNKNOWN, NONE)
    texts, labels = examples(11, FRAMES, 0, copies)
    real = {w for s in [*FRAMES, *ORDINARY, *OTHER_NAMES, *(x for v in [*NAMES.values(), *BODIES.values()] for x in v)] for w in words_of(s) if _noted(w)}
    seen: dict[str, int] = {}
    for t in texts:
        for g in _grams_of(t.split()):
            if not real.isdisjoint(g.split()):
                seen[g] = seen.get(g, 0) + 1
    features = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n > 1))}
    x = _matrix(texts, features)
    y = np.eye(len(families), dtype="f4")[[families.index(c) for c in labels]]
    w, b = np.zeros((len(features), len(families)), "f4"), np.zeros(len(families), "f4")
    rate, penalty, ahead, ahead_b, momentum = 8.0 / float((x * x).sum(1).mean()), 1e-4, w, b, 1.0
    for _ in range(steps):
        g = (_softmax(x @ ahead + ahead_b) - y) / len(x)
        new = ahead - rate * (x.T @ g)
        new, new_b = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0), ahead_b - rate * g.sum(0)
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead, ahead_b = new + (momentum - 1) / following * (new - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new, new_b, following
    names, used = np.array(list(features)), np.abs(w).max(1) > 1e-3
    w, b, names = np.round(w[used].astype("f8"), 6), np.round(b.astype("f8"), 6), names[used]
    if b.argmax() != families.index(NONE):
        raise ValueError("a text without features must be no notice")
    taken: dict[int, int] = {}
    for k, gram in enumerate(names.tolist()):  # of features that share a slot the heaviest stays
        slot = _hash(gram) % SLOTS
        if slot not in taken or np.abs(w[k]).max() > np.abs(w[taken[slot]]).max():
            taken[slot] = k
    kept = sorted(taken.values())
    w, names = w[kept], names[kept].tolist()
    telling = sorted({x for k, gram in enumerate(names) if (w[k, :-1] > w[k, -1]).any() for x in gram.split() if x in real})
    model = Model(families, tuple(_hash(g) for g in names), w, b, 1.0, 0.0, tuple(telling))
    texts, labels = examples(12, CALIBRATION_FRAMES, 1, 1)
    z = np.stack([logits_of(model, t) for t in texts])
    target = np.array([families.index(c) for c in labels])
    temperature = _calibrated(z, target)
    best = _softmax(z / temperature)[:, :-2].max(1)
    return Model(families, model.hashes, w, b, temperature, _parting(best[target < len(families) - 2], best[target == len(families) - 2]), model.telling)


def logits_of(model: Model, text: str) -> np.ndarray:
    known = {h: k for k, h in enumerate(model.hashes)}
    z = model.bias.copy()
    for k in sorted(known[h] for h in map(_hash, _grams_of(words_of(text))) if h in known):
        z = z + model.weights[k]
    return z


def _phrases(family: str) -> list[str]:
    return [f" {' '.join(words_of(n))} " for n in NAMES.get(family, [])]


def _pairs_of(w: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def judge_paragraph(model: Model, text: str) -> tuple[str, float, float, bool]:
    """What scan() gives for one paragraph, in plain Python: family, probability, similarity, confirmed."""
    p = _softmax(logits_of(model, text)[None] / model.temperature)[0]
    top = int(p[:-1].argmax())
    family = model.families[top]
    if p[-1] >= p[top]:
        return NONE, float(p[-1]), 0.0, False
    w = words_of(text)
    pairs, best = _pairs_of(w), 0.0
    for s in BODIES.get(family, []):
        own = _pairs_of(words_of(s))
        best = max(best, len(pairs & own) / len(own))
    if any(n in f" {' '.join(w)} " for n in _phrases(family)):
        best = 1.0
    if family == UNKNOWN or p[top] < model.threshold:
        return UNKNOWN, float(p[top]), best, False
    return family, float(p[top]), best, best >= SIMILARITY


def _grams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _constant(value, kind: str) -> Column:
    """A nested constant; folded once, when the plan is made."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that is a licence notice: id, paragraph, body, family, probability, similarity, confirmed.

    A paragraph is what stands between line breaks, counted from 0. All are scored: the weights of the word n-grams that
    the model knows are summed per family, and a softmax at the calibrated temperature gives probabilities. Most
    paragraphs have no telling word, so no feature that could raise a family over `none`: that is read off the weights,
    and they score as `none` without looking further. Other paragraphs are dropped if `none` is likeliest; they are
    `unknown` if that class is, or if the best family stays below the calibrated threshold.

    The family is confirmed if the paragraph holds one of its names, whole and with the version, or at least SIMILARITY
    of the word pairs of a sentence of its text. All is built-in expressions in one pass over the table without a
    shuffle; weights and templates are constants of the plan, of fixed size.

    Null, empty and blank texts give no rows, nor does an empty table; a text of one very long line is one paragraph;
    repeated rows give repeated results. Other columns are ignored.
    """
    model = model or train()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_or_empty(text_col), r"[\r\n]+")).alias("paragraph", "body"))
    lowered = F.regexp_replace(F.lower("body"), "©", " copyright ")
    found = computed_once(rows, w=F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    found = found.where(F.exists("w", lambda x: x.isin(list(model.telling))))

    slots = [0] * SLOTS
    for k, h in enumerate(model.hashes):
        slots[h % SLOTS] = k + 1
    place = _constant(slots, "array<int>")
    hashes, weights = _constant([0, *model.hashes], "array<bigint>"), _constant([[0.0] * len(model.families), *model.weights.tolist()], "array<array<double>>")
    every = F.array_distinct(F.concat(*[_grams(F.col("w"), n) for n in range(1, GRAMS + 1)]))
    # 0 is the place of what the model does not know.
    at = F.transform(F.transform(every, lambda g: F.xxhash64(g)), lambda h: F.struct(h.alias("h"), F.get(place, F.pmod(h, F.lit(SLOTS)).cast("int")).alias("k")))
    at = F.filter(at, lambda x: (x["k"] > 0) & (F.get(hashes, x["k"]) == x["h"]))
    found = computed_once(found, k=F.array_sort(F.transform(at, lambda x: x["k"])))
    start = _constant(model.bias.tolist(), "array<double>")
    total = F.aggregate("k", start, lambda z, k: F.zip_with(z, F.get(weights, k), lambda a, b: a + b))
    found = computed_once(found, z=F.transform(total, lambda x: x / model.temperature)).drop("k")
    n = len(model.families)
    found = computed_once(found, top=F.array_max("z"), best=F.array_max(F.slice("z", 1, n - 1)))
    found = found.where(F.get("z", F.lit(n - 1)) < F.col("best"))
    share = F.exp(F.col("best") - F.col("top")) / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    family = F.get(F.array(*map(F.lit, model.families)), (F.array_position("z", F.col("best")) - 1).cast("int"))
    found = computed_once(found, family=family, probability=share, pairs=F.array_distinct(_grams(F.col("w"), 2)), line=F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    near, named = F.lit(0.0), F.lit(False)
    for name in model.families[:-2]:
        bodies = _constant([sorted(_pairs_of(words_of(s))) for s in BODIES.get(name, [])], "array<array<string>>")
        shares = F.transform(bodies, lambda own: F.size(F.array_intersect("pairs", own)) / F.size(own))
        near = F.when(F.col("family") == name, F.coalesce(F.array_max(shares), F.lit(0.0))).otherwise(near)
        named = F.when(F.col("family") == name, F.exists(_constant(_phrases(name), "array<string>"), lambda p: F.contains(F.col("line"), p))).otherwise(named)
    found = found.withColumn("similarity", F.when(named, F.lit(1.0)).otherwise(near))
    sure = (F.col("probability") >= model.threshold) & (F.col("family") != UNKNOWN)
    return found.select(
        F.col("id").alias(id_col), "paragraph", "body", F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"),
        "probability", "similarity", (sure & (F.col("similarity") >= SIMILARITY)).alias("confirmed"),
    )
