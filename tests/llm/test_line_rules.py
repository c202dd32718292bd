"""Line dedup as the queries run it: every document, whatever its share of recurring lines; long lines from two texts on."""

from galleria.llm import line_templates as L


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in L.dedup(docs).collect()}


def test_documents_full_of_recurring_lines(spark):
    shared = [" ".join(f"{c}{w}" for w in ("ab", "cd", "ef", "gh", "ij", "kl")) for c in "pqrstu"]
    texts = ["\n".join([*shared, f"{'z' * (i + 3)} only here"]) for i in range(7)] + ["\n".join(shared)]
    got = kept(spark, texts)
    assert got[0] == texts[0] and all(got[i] == texts[i].split("\n")[-1] for i in range(1, 7)) and got[7] == ""


def test_long_lines_of_two_texts(spark):
    long = " ".join(f"word{c}" for c in "abcdefghijklmnopqrst")
    numbers = " ".join(["row"] * 12)
    short = "a short line"
    texts = [f"{long}\n{short}\n{numbers} 1", f"something else\n{short}\n  {long}\n{numbers} 2", f"{long} more"]
    got = kept(spark, texts)
    assert got[0] == texts[0] and got[1] == f"something else\n{short}\n{numbers} 2" and got[2] == texts[2]


def test_copies_of_the_first_text_stay_copies(spark):
    line = "the same footer of all"
    texts = [f"my own words\n{line}", f"my own words\n{line}"] + [f"{'y' * (i + 2)} of mine\n{line}" for i in range(6)]
    got = kept(spark, texts)
    assert got[0] == got[1] == texts[0] and got[2] == "yy of mine"
