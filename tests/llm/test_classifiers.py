import random
import zlib

import numpy as np
import pytest

from fathom.llm import langid, licences

from .conftest import make


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(6)
    parts = {"xx": ["the", "ing", "ough", "wh", "sh"], "yy": ["eau", "oi", "qué", "ille"], "zz": ["sch", "ung", "ich", "ü"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 300))]
        rows.append((i, " ".join(words), lang if rng.random() < 0.95 else None, "s"))
    truth = {i: ("xx" if "th" in t or "wh" in t or "sh " in t else "yy" if "eau" in t or "oi" in t else "zz") for i, t, *_ in rows}
    return make(spark, rows), rows, truth


def test_held_out_documents_are_told(tongues):
    docs, rows, _ = tongues
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs)).collect()}
    labelled = {i: lang for i, _, lang, _ in rows if lang}
    unseen = [i for i in labelled if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(unseen) > 60 and np.mean([got[i][0] == labelled[i] for i in unseen]) > 0.95
    assert all(0 <= s <= 1 for _, s in got.values())
    flags = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in flags)


def test_labels_of_held_out_documents_are_not_used(spark, tongues):
    docs, rows, _ = tongues
    spoilt = make(spark, [(i, t, "spy" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows])
    net = langid.train(spoilt)
    assert "spy" not in net.languages
    same = langid.train(docs)
    assert all(np.array_equal(getattr(net, k), getattr(same, k)) for k in ("filters", "out", "vectors"))


def test_odd_texts(odd, odd_rows, empty):
    net = langid.train(odd)
    got = langid.identify(odd, net).collect()
    assert len(got) == len(odd_rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {100, 101, 102, 105} and all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 4
    assert langid.identify(empty, net).count() == 0 and langid.train(empty) is None and langid.known_language(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def brute_forward(net, text):
    """The network by its definition, one filter and one place at a time, in double precision."""
    data = text.encode()
    total, weight = np.zeros(len(net.languages)), 0
    for at in range(0, len(data), langid.WINDOW):
        window = data[at : at + langid.WINDOW]
        padded = window + bytes(langid.WINDOW - len(window))
        hidden = []
        for f in range(len(net.filters)):
            wide = langid.WIDTHS[f // langid.FILTERS]
            best = max(
                sum(float(net.vectors[d, padded[p + k]]) * float(net.filters[f, k * langid.BYTE_DIMS + d]) for k in range(wide) for d in range(langid.BYTE_DIMS))
                for p in range(langid.WINDOW - max(langid.WIDTHS) + 1)
            )
            hidden.append(max(0.0, best + float(net.bias[f])))
        total += (np.array(hidden) @ net.out.astype("f8") + net.out_bias) * len(window)
        weight += len(window)
    z = np.exp(total / weight - (total / weight).max())
    return dict(zip(net.languages, (z / z.sum()).tolist(), strict=True))


def test_predictions_are_those_of_the_network(spark, tongues):
    docs, rows, _ = tongues
    net = langid.train(docs)
    texts = [rows[0][1], "a", "ü ß quéau", rows[1][1] * 3, "the ough " + "x" * 300]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(make(spark, [(i, t, None, None) for i, t in enumerate(texts)]), net).collect()}
    for i, t in enumerate(texts):
        p = brute_forward(net, t)
        lang, score = got[i]
        assert score == pytest.approx(p[lang], abs=1e-3) and p[lang] >= max(p.values()) - 1e-3, (t, got[i], p)


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    rows = []
    for k in range(90):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(12)]
        rows += [(1000 * k + i, "".join(rng.choice(letters) for _ in range(60)), f"l{k:02}", "s") for i in range(6)]
    net = langid.train(make(spark, rows), sample_docs=90)
    assert net.languages == sorted({lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}) and len(net.languages) > 80


def test_all_of_a_text_counts(spark):
    net = langid.ByteNet.fresh(["a", "b"])
    head = b"x" * 1000
    first, second = (net.predict([head + tail])[1][0] for tail in (b"y" * 3000, b"q z" * 1000))
    assert first != second
    windows, at, fill = langid.cut([b"", b"a" * 256, b"b" * 257])
    assert windows.shape == (4, 256) and at.tolist() == [0, 1, 2] and fill.tolist() == [0, 256, 256, 1]


def test_gradients():
    """The analytic step lowers the loss."""
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (64, langid.WINDOW)).astype("u1")
    y = np.arange(64) % 2
    x[y == 1, 40:44] = np.frombuffer(b"zqzq", "u1")
    net = langid.ByteNet.fresh(["a", "b"]).fit(np.tile(x, (25, 1)), np.tile(y, 25))
    assert (net.logits(x).argmax(1) == y).mean() > 0.9


#: Notices of which no sentence is in the training data, with their family.
NOTICES = {
    "SPDX-License-Identifier: EPL-2.0": "epl", "SPDX-License-Identifier: AGPL-3.0": "agpl", "SPDX-License-Identifier: ISC": "isc", "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "Released under AGPL-3.0.": "agpl", "Distributed under the terms of the ISC terms": "isc", "Distributed under GPLv3.": "gpl", "Released under AGPLv3 or later.": "agpl",
    "Distributed under LGPLv2.1": "lgpl", "This file is under the Unlicense.": "unlicense", "This work is released into the public domain.": "public-domain", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
}
#: Frames and other licences that training and calibration do not know.
FRAMES = ["Distributed under {}", "Made available by its authors under the {}", "see {} for the licence", "Code in this directory is {} licensed", "Use is governed by the {}", "it is covered by the {}, see below"]
STRANGE = ["Q Public License 1.0", "Motosoto License", "Nokia Open Source License", "Frameworx License", "Ricoh Source Code Public License", "Reciprocal Public License 1.5", "Educational Community License 2.0", "Mulan PSL v2", "JSON License", "Adaptive Public License"]


def test_notices_are_told_and_confirmed():
    m = licences.train()
    for text, family in NOTICES.items():
        got = licences.judge_paragraph(m, text)
        assert (got[0], got[3]) == (family, True), (text, got)
    for text, family in {"This work is in the public domain.": "public-domain", "Dedicated to the public domain.": "public-domain", "© 2020 Example Corp.": "reserved", "Alle Rechte vorbehalten.": "reserved"}.items():
        assert licences.judge_paragraph(m, text)[0] == family, text


def test_other_versions_and_licences_are_not_confirmed():
    m = licences.train()
    for text in ("Licensed under the Apache License, Version 1.1.", "Released under the Mozilla Public License 1.1", "Licensed under the Foobar Community License 3."):
        family, _, _, confirmed = licences.judge_paragraph(m, text)
        assert family == licences.UNKNOWN and not confirmed, text
    for text in ("SPDX-License-Identifier: Apache-1.0", "Apache License, version 3", "Licensed under MPL 1.0", "Mozilla Public License, version 3.0"):
        assert not licences.judge_paragraph(m, text)[3], text


def test_held_out_precision_and_recall():
    m = licences.train()
    cases = [(f.format(n), family) for family, names in [*licences.NAMES.items(), (licences.UNKNOWN, STRANGE)] for n in names for f in FRAMES]
    got = [licences.judge_paragraph(m, t)[0] for t, _ in cases]
    for family in [*licences.NAMES, licences.UNKNOWN]:
        own = [g == family for g, (_, want) in zip(got, cases, strict=True) if want == family]
        named = [want == family for g, (_, want) in zip(got, cases, strict=True) if g == family]
        assert np.mean(own) >= 0.75 and np.mean(named) >= 0.95, family
    train_texts = {t for seed, frames, odd in ((11, licences.FRAMES, 0), (12, licences.CALIBRATION_FRAMES, 1)) for t in licences.examples(seed, frames, odd, 1)[0]}
    assert not train_texts & {" ".join(licences.words_of(t)) for t, _ in cases}
    ordinary = ["The driver showed the officer a license.", "The public was asked to leave the domain of the church.", "A library of the software was lost.", "He reserved the rights to the film for a year.", "They work at MIT."]
    assert all(licences.judge_paragraph(m, t)[0] == licences.NONE for t in ordinary)


def test_calibration_is_at_work():
    m = licences.train()
    assert 0.35 < m.threshold < 0.95 and 0.1 < m.temperature < 10
    assert m.bias.argmax() == m.families.index(licences.NONE)
    texts, labels = licences.examples(12, licences.CALIBRATION_FRAMES, 1, 1)
    p = licences._softmax(np.stack([licences.logits_of(m, t) for t in texts]) / m.temperature)
    sure = p.max(1)
    right = np.array([m.families[k] == c for k, c in zip(p.argmax(1), labels, strict=True)])
    assert abs(sure.mean() - right.mean()) < 0.05  # as sure on the whole as it is right


def test_texts_without_telling_words_are_none():
    """What scan() leaves out before it scores could never be a notice."""
    m = licences.train()
    telling = set(m.telling)
    rng = random.Random(8)
    vocabulary = sorted({w for v in [*licences.BODIES.values(), *licences.NAMES.values(), licences.ORDINARY, licences.OTHER_NAMES] for s in v for w in licences.words_of(s)} - telling)
    for _ in range(2000):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))
        assert licences.judge_paragraph(m, text)[0] == licences.NONE, text


def test_scan_agrees_with_plain_python(spark, odd, odd_rows, empty):
    m = licences.train()
    lines = ["Released under the MIT License.", "the license of the car", "Licensed under the Foobar Public License.", "All rights reserved.", "nothing here", "COPYRIGHT (C) 2001 Él and Co. All Rights Reserved", "gpl", "© 2004 ÉCOLE", "Tous droits réservés.", "ＭＩＴ", "²MIT"]
    lines += [s for group in licences.BODIES.values() for s in group] + licences.ORDINARY + [*NOTICES, *STRANGE]
    rows = [*odd_rows, (500, "\n".join(lines), "en", "a"), (501, "Released under the MIT License. " + "word " * 30_000, "en", "a"), (502, "\r\n\r\n".join(lines[:4]), "en", "a"), (502, "\r\n\r\n".join(lines[:4]), "en", "a")]
    got = sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 8), round(r.similarity, 8), r.confirmed) for r in licences.scan(make(spark, rows), m).collect())
    import re

    want = []
    for i, t, *_ in rows:
        for k, p in enumerate(re.split(r"[\r\n]+", t or "")):
            family, probability, similarity, confirmed = licences.judge_paragraph(m, p)
            if family != licences.NONE:
                want.append((i, k, family, round(probability, 8), round(similarity, 8), confirmed))
    assert got == sorted(want) and any(r[2] == "mit" and r[5] for r in got)
    assert licences.scan(empty, m).count() == 0
    plain = spark.range(3).selectExpr("id AS doc_id", "concat('mit', id) AS text")
    plan = licences.scan(plain, m)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
