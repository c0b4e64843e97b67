import random
import re

from lexigraph.llm import queries, substring_dedup as sd

from .helpers import no_docs, odd_docs


def brute(docs, least=sd.LEAST_WORDS, run=sd.LEAST_RUN):
    """(doc_id, start, stop, words) of every run: units of whole pieces, seen before, joined where they touch."""
    low = str.maketrans({**{i: i + 32 for i in range(65, 91)}, **{i: i + 32 for i in range(0xC0, 0xDF) if i != 0xD7}})
    cut, found = {}, {}
    for d, t in docs:
        cut[d] = []
        for m in re.finditer(r"(?:(?!(?<=[.!?]) )[^\n])+", t or ""):
            w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", m[0].translate(low))
            if w:
                cut[d].append((m.start(), m.end(), w, max(len(w), len(m[0]) // 8)))
        p, spans = cut[d], set()
        for i in range(len(p)):
            for way in (range(i, len(p)), range(i, -1, -1)):
                total = 0
                for j in way:
                    total += p[j][3]
                    if total >= least:
                        spans.add((min(i, j), max(i, j)))
                        break
        for i, j in spans:
            words = tuple(x for k in range(i, j + 1) for x in p[k][2])
            found.setdefault(words, []).append((d, p[i][0], p[j][1], i, j))
    gone = {}
    for places in found.values():
        first = min(places)
        for d, start, _, i, j in places:
            if d != first[0] or start >= first[2]:
                gone.setdefault(d, set()).update(range(i, j + 1))
    out = []
    for d, pieces in gone.items():
        for i in sorted(pieces):
            if i - 1 not in pieces:
                j = i
                while j + 1 in pieces:
                    j += 1
                n = sum(cut[d][k][3] for k in range(i, j + 1))
                if n >= run:
                    out.append((d, cut[d][i][0], cut[d][j][1], n))
    return sorted(out)


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op6_substring_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.stop, r.n_words) for r in rows) == brute(docs) and rows
    assert all((r.first_doc_id, r.first_start) < (r.doc_id, r.start) for r in rows)


def test_pasted_within_a_line(spark):
    passage = "Some passage that was pasted into many pages. It has a second sentence, which is long enough. And a third one that is as long as the others."
    docs = [(1, f"Own words first {passage} then more of them here."), (2, f"A different start {passage} and end.\nÉté: une ligne de plus que huit mots, voilà tout."), (3, "été une ligne de plus que huit mots voilà TOUT"), (4, "nothing of it at all in this text that stands alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for run in (sd.LEAST_RUN, sd.LEAST_WORDS):
        gone = sd.repeats(df, least_run=run)
        assert sorted((r.doc_id, r.start, r.stop, r.n_words) for r in gone.collect()) == brute(docs, run=run)
        left = {r.doc_id: r.text for r in sd.removed(df, gone).collect()}
        assert left[1] == docs[0][1] and "second sentence" not in left[2] and left[2].startswith("A different start") and left[4] == docs[3][1]
        assert left[3] == (docs[2][1] if run == sd.LEAST_RUN else "")


def test_random_texts_against_brute_force(spark):
    rng = random.Random(7)
    pieces = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))) + rng.choice([".", "!", ""]) for _ in range(30)]
    docs = [(i, "".join(rng.choice(pieces) + rng.choice([" ", "\n"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.stop, r.n_words) for r in sd.repeats(df).collect()) == brute(docs)


def test_two_texts_under_one_id(spark):
    """Runs of one text aren't cut out of another that has its doc_id."""
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{long}."), (7, f"{long}."), (7, " ".join(f"quite other {i}" for i in range(20)))], "doc_id long, text string")
    left = sorted((r.doc_id, len(r.text.split())) for r in sd.removed(docs, sd.repeats(docs)).collect())
    assert left == [(1, 30), (7, 0), (7, 60)]


def test_scripts_without_spaces(spark):
    line = "\u4e2d\u6587\u7684\u4e00\u884c" * 30
    docs = spark.createDataFrame([(1, line), (2, f"own\n{line}\nmore")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sd.removed(docs, sd.repeats(docs)).collect()} == {1: line, 2: "own\n\nmore"}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    gone = sd.repeats(docs)
    assert sorted((r.doc_id or -1, r.first_doc_id, r.n_words) for r in gone.collect()) == [(-1, 5, 27), (6, 5, 27)]
    out = sd.removed(docs, gone)
    assert out.columns == docs.columns and out.count() == 13
    assert sorted(len(r.text or "") > 0 for r in out.where("doc_id IN (5, 6) OR doc_id IS NULL").collect()) == [False, False, False, True, True]
    assert sd.repeats(no_docs(spark)).count() == 0 and sd.removed(no_docs(spark), sd.repeats(no_docs(spark))).count() == 0
