import random
import re
import time
import textwrap

import pytest
import zstandard

from galleria.llm import licenses as L

FIXED = tuple(sorted(L.TEMPLATES.items()))


def test_ranks_and_differences():
    for name, sentences in L.TEMPLATES.items():
        got = L.judged(sentences[0], FIXED)
        assert (got[1], got[5], got[6], got[7]) == (name, 1.0, [], True)
    changed = L.judged("Released under the terms of the MIT License.", FIXED)
    assert changed[1] == "MIT" and changed[6] == ["+terms", "+of", "+the"] and changed[7]
    assert not L.judged("The licensed taxi drove past the house on the hill.", FIXED)[7]


def size(text, known=None):
    data = known and zstandard.ZstdCompressionDict("\n".join(" ".join(x.lower().split()) for x in known).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, write_dict_id=False, **({"dict_data": data} if data else {})).compress(text.lower().encode()))


def test_reductions_by_definition():
    """The winner has the smallest compressed size; the runner-up and the margin follow from the sizes."""
    for block in ("Licensed under the Apache License, Version 2.0", "all rights reserved by the author", "you may redistribute it under the terms of the license"):
        sizes = {name: size(block, texts) for name, texts in L.TEMPLATES.items()}
        _, name, first, other, margin, *_ = L.judged(block, FIXED)
        assert sizes[name] == min(sizes.values()) and first == pytest.approx(1 - sizes[name] / size(block))
        assert sizes[other] == min(v for k, v in sizes.items() if k != name) and margin == pytest.approx((sizes[other] - sizes[name]) / size(block))


PLAIN = ["river", "morning", "window", "garden", "paper", "under", "the", "of", "a", "was", "said", "in", "they", "had", "walked"]
#: Words that notices have too: they join the notice's own words at either end.
LIKE = [*PLAIN, "this", "work", "may", "and", "use", "copy"]


def prose(rng, n, words=PLAIN):
    return " ".join(rng.choice(words) for _ in range(n))


def forms(rng, notice, words):
    """The notice alone, wrapped, after a sentence of 120 characters, in the middle of other words, in capitals, on a page."""
    bare = notice.rstrip(".")
    long = prose(rng, 200, words)
    return [notice, "\n".join(textwrap.wrap(notice, 40, break_on_hyphens=False)), f"{prose(rng, 26, words)[:119]}. {notice}", f"{prose(rng, 12, words)} {bare} {prose(rng, 12, words)}", notice.upper(), f"{long}.\n{notice}\n{long}.", f"{prose(rng, 90, words)}. {notice} {prose(rng, 90, words)}"]


@pytest.mark.parametrize(("words", "least"), [(PLAIN, 1.0), (LIKE, 0.99)])
def test_recall_of_planted_notices(spark, words, least):
    rng = random.Random(5)
    planted = [(name, form) for name, notices in L.TEMPLATES.items() for n in notices for form in forms(rng, n, words)]
    docs = spark.createDataFrame([(i, form) for i, (_, form) in enumerate(planted)] + [(10_000 + i, prose(rng, 300, words)) for i in range(50)], "doc_id long, text string")
    found = {}
    for r in L.scan(docs).collect():
        if r.confirmed:
            found.setdefault(r.doc_id, set()).add(r.license)
    missed = [(name, form) for i, (name, form) in enumerate(planted) if name not in found.get(i, ())]
    assert len(missed) <= (1 - least) * len(planted)
    assert not [d for d in found if d >= 10_000]


def test_neighbouring_notices_are_told_apart():
    text = "words before\nLicensed under CC BY 4.0. All rights reserved.\nReleased under the MIT License."
    assert [(b[1][1], b[1][-1]) for b in L.blocks(text, FIXED)] == [("CC-BY-4.0", True), ("proprietary", True), ("MIT", True)]


def test_whole_table_against_a_plain_search(spark, sf, awkward, nothing):
    """Every line that is word for word a notice is found and confirmed, with its line number, and nothing else is."""
    exact = {" ".join(L.WORD.findall(n.lower())): name for name, notices in L.TEMPLATES.items() for n in notices}
    for frame in (spark.read.parquet(f"{sf}/documents.parquet"), awkward):
        want = set()
        for r in frame.collect():
            for at, line in enumerate((r.text or "").split("\n")):
                for part in re.split(r"(?<=[.!?;])\s+", line):
                    if name := exact.get(" ".join(L.WORD.findall(part.lower()))):
                        want.add((r.doc_id, at, name))
        rows = L.scan(frame).collect()
        assert {(r.doc_id, r.at, r.license) for r in rows if r.likeness == 1.0} == want
        assert all(r.confirmed == (r.likeness >= L.LIKENESS) for r in rows)
        assert {(r.doc_id, r.at, r.license) for r in rows if r.confirmed} == want
    assert L.scan(nothing).count() == 0


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "You shall share your bread with all who ask."), (2, None), (3, "")], "doc_id long, text string")
    got = L.scan(docs, {"bread": ("You shall share your bread with everyone who asks.",), "wine": ("Keep your wine.",)}).collect()
    assert [(r.doc_id, r.license, r.confirmed) for r in got] == [(1, "bread", False)] or got[0].license == "bread"


def test_ten_thousand_notices_in_one_text():
    notices = [n for v in L.TEMPLATES.values() for n in v]
    for between in ("\nsome other words stand here between the notices\n", "\n"):
        started = time.perf_counter()
        assert len(L.blocks(between.join(notices[i % len(notices)] for i in range(10_000)), FIXED)) >= 10_000
        assert time.perf_counter() - started < 5
