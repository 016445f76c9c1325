import random

from skein.llm import lines

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    """Whether the edit distance of two word lists is at most one, by the textbook table."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows[-1][-1] <= 1


def plain(data):
    """Verdicts by comparing every line with all distinct lines before it."""
    out, seen = {}, []
    for doc_id, text in sorted(data, key=lambda d: (d[0] is None, d[0])):
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            w = line.split()
            if not w:
                continue
            if w in seen:
                out[doc_id, no] = "repeated"
            else:
                near = any(max(len(w), len(x)) >= 5 and one_edit(w, x) for x in seen)
                out[doc_id, no] = "near" if near else "keep"
                seen.append(w)
    return out


def made(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14))] for _ in range(25)]
    docs = []
    for d in range(40):
        out = []
        for _ in range(rng.randrange(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(w) + 1)
                if rng.random() < 0.4 and w:
                    del w[min(k, len(w) - 1)]
                elif rng.random() < 0.5:
                    w.insert(k, "new")
                elif w:
                    w[min(k, len(w) - 1)] = "put"
            out.append("  ".join(w))
        docs.append((d, "\n".join(out)))
    return docs


def verdicts(spark, data):
    return {(r.id, r.no): r.verdict for r in lines.find_repeated_lines(spark.createDataFrame(data, SCHEMA)).collect()}


def test_against_all_pairs(spark):
    for seed in (1, 2, 3):
        data = made(seed)
        assert verdicts(spark, data) == plain(data)


def test_template_lines_and_word_order(spark):
    data = [(i, f"user number {i} has logged in again") for i in range(60)] + [(100, "a b c d e f"), (101, "b a c d e f"), (102, "a a b c d e"), (103, "a b c d e")]
    assert verdicts(spark, data) == plain(data)


def test_edges(spark):
    data = [(None, "one two three four five\n\n  "), (1, None), (2, ""), (3, "one two three four five six\none two three four five"), (4, "w " * 4000), (5, "w " * 4001), (6, "tab\tand\u00a0space\x0bhere")]
    assert verdicts(spark, data) == plain(data)
    assert lines.find_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_rows_are_one_document(spark):
    assert verdicts(spark, [(1, "x y"), (1, "x y")]) == {(1, 0): "keep"}


def test_clean_text(spark):
    data = [(1, "a b c d e\n\nkeep me", "z"), (2, "a b c d x\nnew line\na b c d e", "z"), (3, None, "z")]
    got = {r.doc_id: (r.n_lines, r.n_repeated, r.n_near, r.clean_text) for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string, gone string")).collect()}
    assert got == {1: (2, 0, 0, "a b c d e\n\nkeep me"), 2: (3, 1, 1, "new line"), 3: (0, 0, 0, None)}


def test_very_long_lines(spark):
    import time

    w = [f"w{k * k % 9973}" for k in range(200_000)]
    data = [(1, " ".join(w)), (2, " ".join([*w[:777], "new", *w[777:]])), (3, " ".join([*w[:5], "two", "new", *w[5:]]))]
    began = time.time()
    assert verdicts(spark, data) == {(1, 0): "keep", (2, 0): "near", (3, 0): "keep"}
    assert time.time() - began < 100


def test_edits_of_characters(spark):
    data = [(1, "one word here"), (2, "one  wordd here"), (3, "one wrd here"), (4, "a"), (5, "ab"), (6, "onE word hers")]
    got = {(r.id, r.no): r.verdict for r in lines.find_repeated_lines(spark.createDataFrame(data, SCHEMA), unit="character").collect()}
    assert got == {(1, 0): "keep", (2, 0): "near", (3, 0): "near", (4, 0): "keep", (5, 0): "keep", (6, 0): "keep"}


def test_least_number_of_words(spark):
    data = [(1, "a b"), (2, "a c"), (3, "x y z u v w"), (4, "x y z u v q")]
    got = lambda n: [r.verdict for r in lines.find_repeated_lines(spark.createDataFrame(data, SCHEMA), least=n).orderBy("id").collect()]
    assert got(2) == ["keep", "near", "keep", "near"] and got(7) == ["keep"] * 4


def test_every_document_has_a_row_and_clashing_columns_give_way(spark):
    data = [(1, "a b c d e", 9, 9, 9, "x", 7), (1, "a b c d e", 9, 9, 9, "x", 7), (2, " \n ", 9, 9, 9, "x", 7), (None, None, 9, 9, 9, "x", 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_lines int, n_repeated int, n_near int, clean_text string, verdict int")
    got = sorted((str(r.doc_id), r.n_lines, r.n_repeated, r.n_near, r.gone, r.clean_text, r.verdict) for r in lines.dedup_lines(df).collect())
    assert got == [("1", 1, 0, 0, [], "a b c d e", 7)] * 2 + [("2", 0, 0, 0, [], " \n ", 7), ("None", 0, 0, 0, [], None, 7)]
