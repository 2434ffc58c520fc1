import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest

from signalloom.llm import license_classifier as lic, language_viterbi as lang, toxicity_ordinal as tox

from . import notices


def test_ordinal_recovers_a_scale():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    s = x @ [2.0, -1.0, 0.0] + rng.logistic(size=1500)
    y = np.searchsorted([-1.0, 1.0, 3.0], s)
    rows, columns = np.repeat(np.arange(1500), 3), np.tile(np.arange(3), 1500)
    w, theta = tox.fit_cumulative(columns, rows, x.ravel(), y, np.ones(1500), 3, l2=0)
    assert np.abs(w - [2, -1, 0]).max() < 0.4 and np.abs(theta - [-1, 1, 3]).max() < 0.4 and (np.diff(theta) > 0).all()


def test_ratio():
    assert tox.ratio(0, 10, 5, 10) == 0 and tox.ratio(10, 10, 0, 100) > tox.ratio(5, 10, 0, 100) > tox.ratio(5, 10, 20, 100) > 0


def plain_severity(model, text):
    """The cumulative-link formulas, word by word."""
    seq = re.sub("[\\x00-/:-`{-\x7f]", " ", text.lower()).encode().split()
    counts = {}
    for w in seq:
        for f in [w] + [w[:n] + b"*" for n in tox.PREFIXES if len(w) > n]:
            if f in model.known:
                counts[f] = counts.get(f, 0) + 1
    s = sum(model.weights[model.known[f]] * math.log(1 + tox.RATE * n / len(seq)) for f, n in counts.items())
    return [1 / (1 + math.exp(min(t - s, 500))) for t in model.thresholds]


def dosed(rng, stems, dose, n=120):
    """A text of invented words, of which a share ``dose`` begin with one of the stems."""
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    return " ".join(rng.choice(stems) + word()[:3] if rng.random() < dose else word() for _ in range(n))


def test_severity_follows_the_dose(spark):
    """Toxic words share beginnings; texts of new words with them are ordered by how many they have."""
    rng, stems = random.Random(8), ["zorvex", "quimbo", "wyrkul", "xantop"]
    rows = [(i, dosed(rng, stems, 0.0 if i % 3 else rng.choice((0.03, 0.1, 0.3)))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tox.train(docs, spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int"))
    doses = (0.0, 0.02, 0.08, 0.2, 0.5)
    new = [(10_000 * k + j, dosed(rng, stems, d)) for k, d in enumerate(doses) for j in range(60)]
    seen = {w for _, t in rows for w in t.split()}
    assert sum(w not in seen for _, t in new for w in t.split() if w[:6] in stems) > 300
    got = {r.doc_id: r for r in tox.severity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    means = [np.mean([got[10_000 * k + j].severity for j in range(60)]) for k in range(len(doses))]
    assert means == sorted(means) and means[0] < 0.2 and means[-1] > 2.2 and means[2] - means[1] > 0.3 and means[3] - means[2] > 0.3
    for i, t in new[::17]:
        above = plain_severity(model, t)
        assert got[i].severity == pytest.approx(sum(above), abs=2e-6) and got[i].grade == sum(p >= 0.5 for p in above) and got[i].p_toxic == pytest.approx(above[0], abs=2e-6)


def test_copies_share_a_weight(spark):
    rows = [(i, "one two three four five six" if i < 6 else f"text number {i} of many words here {i * 7}") for i in range(12)]
    marks = spark.createDataFrame([(i, 0, int(i < 6)) for i in range(12)], "doc_id long, quality int, toxic int")
    sample, counts = tox.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    got = {r.doc_id: r.weight for r in sample.collect()}
    assert len(got) == 12 and all(got[i] == tox.UNIT // 6 for i in range(6)) and all(got[i] == tox.UNIT for i in range(6, 12)) and counts == {0: 6, 1: 6}


def test_evidence_against_loops(spark):
    rng = random.Random(5)
    rows = [(i, dosed(rng, ["badword"], 0.2 if i % 2 else 0.0, 40)) for i in range(60)]
    sample, _ = tox.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int"))
    sets = {i: {f for w in set(tox.words(t.encode())) for f in tox.of_word(w)} for i, t in rows}
    counts = {f: (sum(f in sets[i] for i in range(1, 60, 2)), sum(f in sets[i] for i in range(0, 60, 2))) for f in set().union(*sets.values())}
    want = {f for f, (a, b) in counts.items() if a >= tox.LEAST_TEXTS and tox.ratio(a, 30, b, 30) >= tox.EVIDENCE}
    found, cells = tox.feature_evidence(sample)
    assert {f for f, _ in found} == want and want and cells.sum() == 60
    assert all((n[1] + n[3], n[0] + n[2]) == counts[f] for f, n in found)


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = tox.train(docs, marks.where("doc_id % 3 <> 0"))
    got = tox.severity(docs, model).withColumnRenamed("toxic", "found").join(marks.where("doc_id % 3 = 0"), "doc_id").collect()
    tp, fp, fn = (sum(r.found == a and r.toxic == b for r in got) for a, b in ((True, 1), (True, 0), (False, 1)))
    assert tp / (tp + fp) > 0.93 and tp / (tp + fn) > 0.85
    assert all(0 <= r.severity <= 3 and (r.grade > 0) == r.found for r in got)
    kept = tox.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == tox.severity(docs, model).where("not toxic").count()


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.train(odd_docs, none)
    got = tox.severity(odd_docs, model).collect()
    assert len(got) == 9 and not any(r.toxic for r in got)
    assert tox.without_toxic(odd_docs, model).count() == 9 and tox.severity(no_docs, model).count() == 0
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (3, 0, None), (None, 1, 1), (99, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert tox.severity(odd_docs, tox.train(odd_docs, marks)).count() == 9


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    mixed = 0
    for _ in range(1500):
        n = int(rng.integers(1, 7))
        scores = rng.normal(0, 6, (n, 3)) + np.array([rng.choice([0, 6]), 0, 0])
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -lang.WORD_LIMIT)
        model = lang.Model(["a", "b", "c"], {}, {}, np.zeros((1, 3)))
        model.known, model.scores, model.sizes = {str(i): i for i in range(n)}, scores, np.ones(n, np.int64)
        value = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - lang.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
        path = model.path([str(i) for i in range(n)])[0].tolist()
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))
        mixed += len(set(path)) > 1
    assert mixed


def test_scripts_and_spans():
    model = lang.learn([("the cat sat on the mat and the hat", "en"), ("кот сидел на ковре", "ru"), ("le chat et la souris dans les bois", "fr")])
    assert lang.summaries(model, ["мат и дом", None, "", "123 ...", "the mat"]) == [("ru", 1.0), ("und", 0.0), ("und", 0.0), ("und", 0.0), ("en", 1.0)]
    assert lang.summaries(model, ["漢字 仮名", "the mat 漢字漢字"]) == [("en", 0.0), ("en", 0.6)]
    text = "the cat sat on the mat and  the hat\nкот сидел на ковре"
    assert [(text[a:b], k) for a, b, k in lang.text_spans(model, text)] == [("the cat sat on the mat and  the hat", "en"), ("кот сидел на ковре", "ru")]
    assert lang.text_spans(model, None) == [] and lang.summaries(lang.learn([]), ["word"]) == [("und", 0.0)]


def test_words_of_several_scripts():
    assert lang.words_of("The-кот hello我们今天 ça va ภาษา 12-x")[:9] == ["the-", "кот", "hello", "我", "们", "今", "天", "ça", "va"]
    assert lang.pieces("the") == ["the"] and lang.cuts("a1b") == () and lang.cuts("-кот-the") == (5,)
    # texts of Latin letters alone need no look at each word
    for c in map(chr, range(0x3000)):
        if not lang._BEYOND_LATIN.search(c) and c.isalpha():
            assert lang.script(c) == "latin"
    model = lang.learn([("the cat sat on the mat and the hat hello there", "en"), ("кот сидел на ковре и смотрел", "ru"), ("我们今天去公园散步天气很好", "zh")])
    text = "hello我们今天去公园散步天气很好"
    assert [(text[a:b], k) for a, b, k in lang.text_spans(model, text)] == [("hello", "en"), ("我们今天去公园散步天气很好", "zh")]
    assert lang.summaries(model, [text, "the-кот сидел на ковре"])[0][0] == "zh" and lang.summaries(model, ["the-кот сидел на ковре"])[0][0] == "ru"


def plain_language(model, text):
    """The language of most letters on the best path through a text's words, without any cache."""
    words = []
    for token in (text or "").lower().split():
        word, last = "", None
        for c in token:
            kind = lang.script(c) if c.isalpha() else None
            if kind and last and (kind != last or kind in lang.UNSPACED):
                words.append(word)
                word = ""
            word, last = word + c, kind or last
        words.append(word)
    scores, counts, total = [], [], 0
    for w in words:
        w = "".join(c for c in w if c.isalpha())
        total += len(w)
        own = model.scripts.get(lang.script(w[0])) if w else None
        if not own or not any(own):
            scores.append([0.0] * len(model.languages))
            counts.append(0)
            continue
        padded = f"^{w}$"
        row = [sum(model.logs[model.rows.get(padded[i : i + 3], len(model.logs) - 1)][j] for i in range(len(w))) if own[j] else -np.inf for j in range(len(own))]
        scores.append([max(x - max(row), -lang.WORD_LIMIT) if ok else -lang.SCRIPT_LIMIT for x, ok in zip(row, own)])
        counts.append(len(w))
    if not total:
        return "und", 0.0
    path = lang.viterbi(np.array(scores), lang.SWITCH)
    by = [sum(n for k, n in zip(path, counts) if k == j) for j in range(len(model.languages))]
    k = max(range(len(by)), key=by.__getitem__)
    return model.languages[k], round(by[k] / total, 6)


def test_whole_result_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    model = lang.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = lang.predict(docs, model).collect()
    assert len(got) == len(texts) > 100
    for r in got:
        want = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6, r.doc_id


def test_training_in_tasks_is_the_plain_one(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat, the hat é", "en"), ("кот Сидел 12", "ru"), ("le chat et la", "fr"), ("the end of it", "en"), (None, "de"), ("x", None)])]
    df = spark.createDataFrame([(i, t, k) for i, t, k in rows for i in [next(j for j in range(1000 * i, 1000 * i + 99) if zlib.crc32(str(j).encode()) % lang.FOLDS)]], "doc_id long, text string, lang string")
    a, b = lang.train(df), lang.learn((t, k) for _, t, k in rows if t and k)
    assert a.languages == b.languages and a.scripts == b.scripts and a.rows == b.rows and np.allclose(a.logs, b.logs)


def test_held_out_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = lang.train(docs, 2000)
    got = lang.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    odd = lang.predict(odd_docs, model)
    assert odd.count() == 9 and odd.where("doc_id in (2, 3, 4)").select("lang_pred").distinct().collect()[0][0] == "und"
    assert lang.predict(no_docs, model).count() == 0 and lang.language_spans(odd_docs, model).count() == 9
    assert lang.predict(odd_docs, lang.train(no_docs)).where("lang_pred <> 'und'").count() == 0


def test_rare_languages_are_learned(spark):
    rare = [f"x{k}" for k in range(8)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % lang.FOLDS][:608]
    rows = [(i, f"words of {k}", rare[k] if k < 8 else "en") for k, i in enumerate(ids)]
    model = lang.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40)
    assert model.languages == ["en", *rare]
    assert lang.quotas({"a": 1, "b": 100, "c": 1000}, 61) == {"a": 1, "b": 30, "c": 30}
    assert lang.quotas({"a": 3, "b": 5}, 100) == {"a": 3, "b": 5} and lang.quotas({"a": 3, "b": 5}, 1) == {"a": 1, "b": 1}


def plain_licenses(model, text):
    """Segments, regressions and comparison in loops: the families found."""
    found = set()
    for block in re.split(r"\n(?:[^\S\n]|[/*#;%!>-])*\n", text.replace("\r\n", "\n")):
        seq = lic.tokens(block)
        cues = [i for i, w in enumerate(seq) if any(c in w for c in lic.CUES) or tuple(seq[i : i + 2]) in lic.PAIRS]
        groups = []
        for i in cues:
            if groups and i - groups[-1][-1] <= 2 * lic.REACH:
                groups[-1].append(i)
            else:
                groups.append([i])
        for g in groups:
            gs = lic.grams(seq[max(g[0] - lic.REACH, 0) : g[-1] + lic.REACH + 1])
            z = (np.array(model.bias) + sum((np.array(model.weights[x]) for x in gs if x in model.weights), np.zeros(len(model.bias)))) / model.temperature
            p = dict(zip(model.classes, 1 / (1 + np.exp(-z))))
            share = {}
            for family, own in lic.own_grams():
                share[family] = max(share.get(family, 0), len(gs & own) / len(own))
            found |= {f for f in share if p[f] >= lic.LIKELY and p[f] >= p[lic.UNKNOWN] and share[f] >= lic.CONTAINED}
    return ",".join(sorted(found))


PROSE = "It was a long day and the harbour lay still under a grey sky while boats went out\n" * 3


def forms(text):
    """A notice as it stands in files: whole, wrapped, commented, indented, within prose."""
    lines = textwrap.fill(text, 70)
    marked = lambda mark: textwrap.indent(lines, mark, lambda _: True)
    return [text, lines, textwrap.fill(text, 34), marked("# "), "/*\n" + marked(" * ") + "\n */", marked("    // "), PROSE + lines + "\n" + PROSE, marked("-- "), lines.replace("\n", "\r\n")]


def families(spark, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(x for t in texts for x in forms(t))], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in lic.licenses(rows).collect()}
    n = len(forms(""))
    return [[got[i * n + k] for k in range(n)] for i in range(len(texts))]


def test_known_notices(spark):
    for (family, text), got in zip(notices.CASES, families(spark, [t for _, t in notices.CASES])):
        assert all(g == {family} for g in got), (text, got)
    for text, got in zip(notices.UNKNOWN, families(spark, notices.UNKNOWN)):
        assert not any(got), (text, got)


def test_later_notices(spark):
    right = wrong = missed = 0
    for want, got in zip([set(f.split(",")) for f, _ in notices.LATER] + [set() for _ in notices.LATER_UNKNOWN], families(spark, [t for _, t in notices.LATER] + notices.LATER_UNKNOWN)):
        for g in got:
            right, wrong, missed = right + len(g & want), wrong + len(g - want), missed + len(want - g)
    print("licence notices written later: right", right, "wrong", wrong, "missed", missed)
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.7


def test_short_notices(spark):
    def counted(cases):
        right = wrong = missed = 0
        for want, got in zip([set(f.split(",")) - {""} for f, _ in cases], families(spark, [t for _, t in cases])):
            for g in got:
                right, wrong, missed = right + len(g & want), wrong + len(g - want), missed + len(want - g)
        return right, wrong, missed

    seen = counted(notices.SHORT)
    later = counted([*notices.SHORT_LATER, *(("", t) for t in notices.SHORT_UNKNOWN)])
    print("short licence notices: right, wrong, missed", seen, "written later", later)
    assert seen[1] == 0 and seen[0] / (seen[0] + seen[2]) >= 0.9
    assert later[0] / (later[0] + later[1]) >= 0.95 and later[0] / (later[0] + later[2]) >= 0.85


def test_licenses_against_loops(spark):
    model, rng = lic.trained(), random.Random(2)
    texts = [" ".join(seq) for seq, _ in rng.sample(lic.examples(9, 1), 150)]
    texts += [f"{PROSE}{rng.choice(notices.CASES)[1]}\n\n# {rng.choice(notices.CASES)[1]}\n{PROSE * 3}{rng.choice(notices.CASES)[1]}" for _ in range(40)] + ["LICENSE", "licence\tcopyright é license", "public\ndomain", "cc\nby 4.0"]
    got = {r.doc_id: r.licenses for r in lic.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_licenses(model, t), t


def test_templates_lie_within_reach():
    """A segment around a template's cue words holds all of it."""
    for family in lic.TEMPLATES:
        for text in (*lic.notices(family), *lic.short_notices(family)):
            seq = lic.tokens(text)
            cues = [i for i, w in enumerate(seq) if any(c in w for c in lic.CUES) or tuple(seq[i : i + 2]) in lic.PAIRS]
            if not cues:  # the middle of a longer notice, whose cue words stand before
                assert family in ("MIT",) or text in ("Apache-2.0",), text
            else:
                assert max(min(abs(i - c) for c in cues) for i in range(len(seq))) <= lic.REACH, text
    assert {f for f, _ in lic.own_grams()} == set(lic.TEMPLATES)


def test_wrapped_licenses(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    bsd = " * Redistribution and use in source and binary forms, with or\r\n * without modification, are permitted provided that the following\r\n * conditions are met:"
    domain = "This is free and unencumbered software released into the public\ndomain."
    texts = [mpl, bsd, domain, "Released under the MIT License.\n" + mpl, PROSE + "\n" + bsd + "\n\n" + PROSE, PROSE + "She had a licence\nfor the boat.", "All rights reserved.\n \n" + mpl]
    got = {r.doc_id: (r.n_licenses, r.licenses) for r in lic.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [(1, "MPL"), (1, "BSD"), (1, "public-domain"), (2, "MIT,MPL"), (1, "BSD"), (0, ""), (2, "MPL,proprietary")]


def test_license_rows(spark, odd_docs, no_docs):
    got = lic.licenses(odd_docs).collect()
    assert len(got) == 9 and {(r.n_candidates, r.n_licenses, r.licenses, r.p) for r in got} == {(0, 0, "", 0.0)}
    assert lic.licenses(no_docs).count() == 0
    two = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "x"), (None, "All rights reserved.\n\nLicensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_candidates, r.licenses) for r in lic.licenses(two).collect()) == [(0, 2, "Apache-2.0,proprietary"), (1, 0, ""), (1, 1, "MIT"), (1, 1, "MIT")]
    plan = lic.licenses(odd_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("line", ["-" * 1_000_000, " " * 1_000_000, "#\n" * 200_000, "* -" * 300_000, "\n" * 300_000])
def test_long_lines_of_signs(spark, line):
    """A pattern that recursed at each sign ended the JVM."""
    docs = spark.createDataFrame([(1, f"Licensed under the MIT License.\n{line}\nAll rights reserved.")], "doc_id long, text string")
    row = lic.licenses(docs).first()
    assert row.licenses in ("MIT,proprietary", "MIT") and row.n_candidates >= 1
