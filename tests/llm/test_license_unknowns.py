"""License scans: wrapped notices are found, texts that only speak of such words are not, and examples of the unknown class come from all documents."""

import textwrap

import pytest


@pytest.fixture(scope="module")
def corpus(spark):
    long = "the software was slow " * 300 + "end."
    data = [(k, f"plain words of the park and the river {k}.\nthe software of machine {k} was slow.\nReleased under the MIT License.") for k in range(150)]
    return spark.createDataFrame(data + [(2000, long), (2001, None), (2002, ""), (2003, "no such word")], "doc_id long, text string")


@pytest.fixture(scope="module")
def model(corpus):
    from quarry.llm.license_scan import learn_licenses

    return learn_licenses(corpus)


def test_unknown_examples(corpus):
    from quarry.llm.license_scan import unlike_templates, word_shares

    got = {r["text"] for r in unlike_templates(corpus, word_shares(corpus)).collect()}
    assert sum("software" in t for t in got) == 151 and len(got) == 301 and max(map(len, got)) > 6000 and not any("MIT" in t for t in got)


@pytest.mark.parametrize("every", [1, 8, None])
def test_a_notice_is_found_however_common_it_is(spark, every):
    from quarry.llm.license_scan import TEMPLATES, license_table

    notice = TEMPLATES["mit"][1]
    has = lambda k: every is not None and k % every == 0
    rows = [(k, f"plain words of the park and the river {k}.\n\n{notice if has(k) else f'they saw the {k} dogs.'}\n\nthe use of {k} things was subject to the weather.") for k in range(400)]
    got = license_table(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("family <> 'unknown'").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == [(k, 1, "mit") for k in range(400) if has(k)]


def test_wrapped_notices_and_other_wordings(spark, model):
    from quarry.llm.license_scan import OTHER_WORDINGS, TEMPLATES, UNLICENSED, scan_licenses

    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts + OTHER_WORDINGS[family]:
            for mark in ("", "# ", " * "):
                rows.append((len(rows), family, "Some program.\n\n" + "\n".join(mark + line for line in textwrap.wrap(t, 70)) + "\n\nint main() {}"))
    rows += [(len(rows) + k, None, t) for k, t in enumerate([*UNLICENSED, "He renewed the software license and all rights went to her.", "mit der Lizenz und mit dem Hund ging er"])]
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    found = {}
    for r in scan_licenses(docs, model).collect():
        if r["family"] != "unknown":
            found.setdefault(r["doc_id"], set()).add(r["family"])
    assert [(found.get(k), want, t) for k, want, t in rows if found.get(k, set()) != ({want} if want else set())] == []


def test_odd_rows(spark, model):
    from quarry.llm.license_scan import license_table, scan_licenses

    data = [(1, "plain text.\nReleased under the MIT License.\nmore", 5), (None, "Licensed under the Apache License, Version 2.0.", 6), (4, None, 7), (5, "", 8), (6, "word " * 20000 + "All rights reserved.", 9)]
    docs = spark.createDataFrame(data + data[:1], "doc_id long, text string, paragraph long")
    got = sorted((r["doc_id"] or 0, r["paragraph"], r["family"]) for r in scan_licenses(docs, model).collect())
    assert got == [(0, 0, "apache-2.0"), (1, 1, "mit"), (1, 1, "mit"), (6, 0, "proprietary")]
    assert license_table(spark, docs.limit(0)).count() == 0


def test_weights_are_sparse_and_cues_cover_all_templates(model):
    from quarry.llm.license_scan import template_triples

    assert 0 < len(model.vocabulary) < 1500 and all(set(g.split()) & set(model.cues) or g in model.phrases for g in template_triples())
    assert all(len(w) == len(model.vocabulary) for w in model.weights) and "the" not in model.cues
