import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from galleria.llm import line_templates as L


def mask(line):
    plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ")
    return [L.WILDCARD if re.search("[0-9]", w) else w for w in plain.split(" ")] if plain else []


def by_brute_force(rows, least):
    """For each (doc_id, hash, text) the text without recurring lines and their number, by plain loops."""
    texts = {t for _, _, t in rows if t is not None}
    leaves = defaultdict(lambda: defaultdict(set))  # path -> shape -> texts
    verbatim = defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            if shape := mask(line):
                leaves[len(shape), " ".join(shape[: L.DEPTH])][tuple(shape)].add(t)
                if len(shape) >= L.LONG_TOKENS:
                    verbatim[line.strip(" ")].add(t)
    template, docs = {}, defaultdict(set)
    for path, shapes in leaves.items():
        total = sum(map(len, shapes.values()))
        votes = Counter()
        for shape, owners in shapes.items():
            for p, w in enumerate(shape):
                votes[p, w] += len(owners)
        for shape, owners in shapes.items():
            form = tuple(w if votes[p, w] >= max(least, L.CONSTANT * total) else None for p, w in enumerate(shape))
            general = sum(w is not None for w in form) >= L.SIMILAR * len(form)
            template[path, shape] = key = ("form", path, form) if general else ("shape", path, shape)
            docs[key] |= owners

    def key_of(line):
        shape = mask(line)
        if not shape:
            return None
        key = template[(len(shape), " ".join(shape[: L.DEPTH])), tuple(shape)]
        if len(docs[key]) >= least:
            return key
        return ("line", line.strip(" ")) if len(verbatim.get(line.strip(" "), ())) >= L.LONG_DOCS else None

    places = defaultdict(list)
    for d, h, t in rows:
        for at, line in enumerate((t or "").split("\n") if t is not None else ()):
            if key := key_of(line):
                places[key].append(((d is not None, d or 0, h, at), (h, at)))
    first = {key: min(found)[1] for key, found in places.items()}
    out = []
    for d, h, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for at, x in enumerate(lines) if (key := key_of(x)) is None or first[key] == (h, at)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(frame, *least):
    rows = [(r.doc_id, r.h, r.text) for r in frame.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.dedup(frame, *least).collect()]
    want = by_brute_force(rows, *(least or (L.LEAST_DOCS,)))
    assert sorted(map(str, got)) == sorted(map(str, want))
    return sum(r[3] for r in got)


def test_against_brute_force(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check(docs) and check(docs, 3) and check(awkward.select("doc_id", "text"), 2)


def test_variable_fields_and_copies(spark):
    own = ["\n".join(" ".join(f"{c}{w}x" for w in "qwertyuiop"[k:]) for k in range(3)) for c in "abcdefgh"]
    footer = [f"Page {i} of 12 printed by user{i} on the server" for i in range(8)]
    rows = [(i, f"{own[i]}\n{footer[i]}", 0) for i in range(8)] + [(100 + i, "a whole copy\nof the same two lines", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in L.dedup(docs).collect()}
    assert got[0].text == rows[0][1] and all(got[i].text == own[i] and got[i].n_dropped == 1 for i in range(1, 8))
    assert all(got[100 + i].n_dropped == 0 for i in range(9))


def test_several_templates_in_a_leaf(spark):
    names = [f"{a}{b}" for a in ("an", "be", "cy", "do") for b in ("na", "ta", "ra", "ma", "la")]
    first = [f"log in of {n} at the north gate" for n in names]
    second = [f"log in of the day by {n} again" for n in names]
    rows = [(i, f"{x}\n{y}\nwords of {n} only") for i, (x, y, n) in enumerate(zip(first, second, names, strict=True))]
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"words of {names[i]} only" for i in range(1, 20))


def test_a_template_within_one_document_does_not_recur(spark):
    rows = [(0, "\n".join(f"item of {w} the list goes on" for w in "abcdefghij")), (1, "other words")]
    assert [r.n_dropped for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]


def test_columns_and_nothing(spark, awkward, nothing):
    out = L.dedup(awkward)
    assert set(out.columns) == set(awkward.columns) | {"n_lines", "n_dropped"} and out.count() == awkward.count()
    clash = awkward.withColumns({c: F.lit(1) for c in ("recurring_chars", "template", "first", "leaf", "s", "at", "drop", "__d", "__h", "__drop", "n_dropped")})
    assert L.dedup(clash).count() == awkward.count() and L.dedup(clash).where("recurring_chars <> 1 OR __drop <> 1").isEmpty()
    assert L.dedup(nothing).count() == 0


def test_tables_that_are_not_broadcast(spark, sf, monkeypatch):
    from galleria.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(str, L.dedup(docs).collect()))
    monkeypatch.setattr(common, "SMALL", -1)
    assert sorted(map(str, L.dedup(docs).collect())) == want
