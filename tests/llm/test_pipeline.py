"""The pipeline stage by stage, each against a plain version of its decision on its own input."""

import re
from collections import Counter

import corpus_pipeline as P
from tidemark.llm import langid

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def settled(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = settled(stage(spark, docs, SF), tmp_path / str(k))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        kept[name] = before, after

    before, after = kept["language ID"]
    assert all(not any(c.isalpha() for c in before[d].text or "") or len(before[d].text) < 200 for d in set(before) - set(after))

    before, after = kept["line dedup"]
    pages = Counter(r.source for r in before.values())
    lines = Counter((r.source, x) for r in before.values() for x in set((r.text or "").split("\n")))
    for d, r in before.items():
        stay = [x for x in r.text.split("\n") if not x.strip(" ") or lines[r.source, x] < 3 or lines[r.source, x] <= 0.1 * pages[r.source]]
        assert after[d].text == "\n".join(stay) and after[d].n_chars == len(after[d].text)

    before, after = kept["near-dedup"]
    sets = {}
    for d, r in before.items():
        w = r.text.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in before}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert set(after) == {d for d in ids if find(d) == d}

    before, after = kept["decontamination"]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 4)}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, r in before.items() if any(s and len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
    assert set(before) - set(after) == leaks

    before, after = kept["mixing"]
    assert set(before) == set(after) and all(r.rate >= 0 for r in after.values())
    out = {r.doc_id: r.rate for r in P.run(spark, SF).collect()}
    assert set(out) == set(after) and all(abs(out[d] - after[d].rate) < 1e-6 for d in out)


def test_rejected_documents_go(spark):
    rows = [(k, "the and of that this with " * 5 if k % 2 else "les des une dans avec pour " * 5, "en" if k % 2 else "fr", "s", 1) for k in range(40)]
    docs = spark.createDataFrame([*rows, (100, None, "en", "s", 0), (101, "1234 ...", "en", "s", 8), (102, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in P.language_id(spark, docs, SF).collect()}
    assert left == set(range(40))
    assert P.language_id(spark, docs.limit(0), SF).count() == 0 and langid.UNKNOWN == "und"


def test_copies_are_left_to_near_dedup(spark):
    """A third of a source are copies of one document: its lines stay in stage 2, and one copy survives stage 3."""
    copy = "\n".join(" ".join(f"c{i}w{k}" for k in range(8)) for i in range(3))
    rows = [(k, copy if k % 3 == 0 else "menu home\n" + " ".join(f"d{k}w{i}" for i in range(20)), "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = P.drop_site_lines(spark, docs, SF)
    assert {r.text for r in cleaned.where("doc_id % 3 = 0").collect()} == {copy}
    assert all(not r.text.startswith("menu") for r in cleaned.where("doc_id % 3 <> 0").collect())
    left = {r.doc_id: r.text for r in P.near_dedup(spark, cleaned, SF).collect()}
    assert set(left) == {0} | {k for k in range(60) if k % 3} and left[0] == copy


def test_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    """Columns called like the stages' own, null and empty texts, a null source, repeated rows and rows without an id."""
    words = [f"the word{k} of and" for k in range(60)]
    rows = [(k, " ".join(words[k % 50 : k % 50 + 8]), "en" if k % 2 else "fr", "s" if k % 3 else None, 1) for k in range(60)]
    rows += [(70, None, "en", "s", None), (71, "", None, "s", 0), (3, rows[3][1], "en", "s", 1), (None, "no id at all here but words", "en", "s", 1)]
    names = ["score", "lang_pred", "rate", "posterior", "n_tokens", "kept", "component_id", "line", "words", "item_id", "id"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        docs = settled(stage(spark, docs, SF), tmp_path / f"clash{k}")
        assert len(set(docs.columns)) == len(docs.columns) and (docs.columns == columns or k == len(P.STAGES) - 1)
    left = docs.collect()
    assert {70, 71}.isdisjoint({r.doc_id for r in left}) and any(r.doc_id is None for r in left)
    assert docs.schema["rate"].dataType.simpleString() == "double" and all(r.score == 0 and r.id == 10 for r in left)
