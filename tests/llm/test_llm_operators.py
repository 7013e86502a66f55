"""Each operator against a plain version on small rows, and its defined cases."""

import ast
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import broken_pairs as bp
from lodestone.llm import cross_split, fm_index, functions_docs, leakage, mixing, near_duplicates, neighbours, repetition, sentences, splitting
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# p1


@pytest.mark.parametrize(
    "text, question, abstain, want",
    [
        (None, "Who closes `x_y`?", False, ["empty"]),
        ("", "Who?", False, ["empty"]),
        (" \u200b\n", "Who?", False, ["empty"]),
        ("**Answer:**\n", "Who?", True, ["empty"]),
        ("[C1, C2]", "Who?", False, ["empty"]),
        ("n/a.", "Who?", False, ["empty"]),
        ("No", "Can it run twice?", False, []),
        ("`close_it` [C1]", "Who closes it?", False, []),
        ("Who closes the file that open_it opened?", "Who closes the file that `open_it` opened?", False, ["copied_question"]),
        ("Question: Who closes the file that open_it opened? [C1]", "Who closes the file that open_it opened?", False, ["copied_question"]),
        ("Who closes the file that open_it opened?\n\nThe pool closes it when the last reader of open_it leaves.", "Who closes the file that open_it opened?", False, []),
        ("Sorry, I can't answer that from the given chunks.", "Who closes it?", False, ["refusal"]),
        ("Sorry, I can't answer that from the given chunks.", "Who closes it?", True, []),
        ("Sorry, I can't answer that from the given chunks.", "Who closes it?", None, []),
        ("I can't see every caller, yet this much is clear. The pool closes the file in pool_a.py.", "Who closes the file?", False, []),
        ("The pool closes the file when the last reader le", "Who closes the file?", False, ["truncated"]),
        ("It works as follows.\n1. `a_b` opens.\n2.", "How does it work?", False, ["truncated"]),
        ("It is closed by the pool.\n```python\nx = (", "How is it closed?", False, ["truncated"]),
        ("It is closed by the pool [C1", "How is it closed?", False, ["truncated"]),
        ("It is closed by the pool [C1]", "How is it closed?", False, []),
        ("It has two callers:\n- `a_b` first\n- `c_d` second", "What are the callers of it?", False, []),
        ("Der Speicher wird von der Funktion nicht mehr gelesen.", "What does the function return when it is empty?", False, ["other_language"]),
        ("第16行由它负责，系统先读取文件然后写入。", "What does the function return when it is empty?", False, ["other_language"]),
        ("The message is \"Der Speicher wird nicht gelesen\" and it comes from the pool.", "Which message is it that the pool shows?", False, []),
    ],
)
def test_defects(text, question, abstain, want):
    assert bp.defects(text, question, abstain) == want


@pytest.mark.parametrize(
    "text, question, abstain, want",
    [
        ("Sorry, I can't answer that from the given chunks [C1", "Who closes it?", False, ["refusal", "truncated"]),
        ("Sorry, I can't answer that from the given chunks [C1", "Who closes it?", True, ["truncated"]),
        ("Sorry, I can't answer that from the given chunks [C1", "Who closes it?", None, ["truncated"]),
        ("Sorry, I can't answer that from the given chunks", "Who closes it?", True, []),
        ("None of the retrieved code answers this question", "Who closes it?", True, []),
        ("Who closes the file that open_it opened", "Who closes the file that `open_it` opened?", False, ["copied_question"]),
        ("Who closes the file that `open_it opened?", "Who closes the file that `open_it` opened?", False, ["copied_question", "truncated"]),
        ("Lo siento, no puedo responder a esa pregunta con el código que se ha recuperado.", "What does the function return when it is empty?", False, ["refusal", "other_language"]),
        ("Lo siento, no puedo responder a esa pregunta con el código que se ha recuperado.", "What does the function return when it is empty?", True, []),
    ],
)
def test_every_defect_is_listed(text, question, abstain, want):
    assert bp.defects(text, question, abstain) == want


def test_broken_pairs_table(spark):
    a = spark.createDataFrame(
        [(1, 1, "", "2026-01-01", 9), (1, 1, "The pool closes it.", "2026-01-02", 9), (2, None, "", None, 9), (3, 7, "", None, 9), (4, 1, None, None, 9), (4, 1, None, None, 9)],
        "answer_id long, question_id long, text string, logged string, question long",
    )
    q = spark.createDataFrame([(1, "Who closes it?", False, None), (1, "Who closes it?", False, None), (5, None, None, None)], "question_id long, question string, abstain boolean, created string")
    got = bp.broken_pairs(a, "answer_id", "question_id", "text", "logged", q, "question", "abstain", "created")
    assert [(r[0], list(r[1])) for r in got.collect()] == [(4, ["empty"])] and got.columns[2:] == ["question_lang", "reply_lang"]
    assert bp.broken_pairs(a.limit(0), "answer_id", "question_id", "text", "logged", q, "question", "abstain", "created").count() == 0
    blank = spark.createDataFrame([(9, 2, "The pool closes it.", None)], "answer_id long, question_id long, text string, logged string")
    none = spark.createDataFrame([(2, None, None, None)], q.schema)
    assert bp.broken_pairs(blank, "answer_id", "question_id", "text", "logged", none, "question", "abstain", "created").count() == 0


# p2


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    near = base[: n // 4] + 0.12 * rng.standard_normal((n // 4, 64))
    return np.concatenate([base, near, base[:7], 3 * base[:5]]).astype(np.float32)


def test_nearest_against_brute_force(spark):
    v = vectors(1200)
    data = [(i, x.tolist(), i) for i, x in enumerate(v)]
    bad = [(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] * 64, 0), (9004, [1.0] * 63, 0), (9005, [None] + [1.0] * 63, 0)]
    df = spark.createDataFrame(data + bad + data[:3], "vec_id long, embedding array<float>, part long")
    s = neighbours.CurveSettings(min_cosine=0.9, window=128, rows_per_range=500)
    got = neighbours.nearest(df, "vec_id", "embedding", s).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = (u @ u.T).astype(np.float64)
    np.fill_diagonal(c, -2)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r.cosine)
        assert abs(c[r.vec_id, r.neighbour_id] - r.cosine) < 1e-4 and r.cosine >= 0.9 - 1e-6
    want = {i: np.sort(x[x >= 0.9])[::-1][:5] for i, x in enumerate(c) if (x >= 0.9).any()}
    assert sum(map(len, found.values())) >= 0.98 * sum(map(len, want.values()))
    assert neighbours.nearest(df.limit(0), "vec_id", "embedding", s).count() == 0


def test_many_copies_keep_five_neighbours(spark):
    v = vectors(300)
    df = spark.createDataFrame([(i, v[i % 3].tolist()) for i in range(600)] + [(1000 + i, v[i].tolist()) for i in range(50, 300)], "vec_id long, embedding array<float>")
    s = neighbours.CurveSettings(min_cosine=0.95, window=64, rows_per_range=100)
    count = neighbours.nearest(df, "vec_id", "embedding", s).where("vec_id < 600 and cosine > 0.999").groupBy("vec_id").count()
    assert rows(count.groupBy("count").agg(F.count("*").alias("n")), "count", "n") == [(5, 600)]


def test_copies_name_the_smallest_ids(spark):
    v = vectors(200)
    df = spark.createDataFrame([(i, v[0].tolist()) for i in range(12)] + [(100 + i, v[i + 1].tolist()) for i in range(150)], "vec_id long, embedding array<float>")
    for s in (neighbours.CurveSettings(min_cosine=0.95, curves=1, window=16), neighbours.CurveSettings(curves=2, window=16, settle=True)):
        got = neighbours.nearest(df, "vec_id", "embedding", s).where("vec_id < 12").orderBy("vec_id", "neighbour_rank").collect()
        assert [r.neighbour_id for r in got if r.vec_id == 11] == [0, 1, 2, 3, 4]
        assert [r.neighbour_id for r in got if r.vec_id == 2] == [0, 1, 3, 4, 5]


def test_settled_lists_of_every_row(spark):
    v = vectors(900)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    s = neighbours.CurveSettings(settle=True, window=64, rows_per_range=400, block=200)
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", s).collect():
        got.setdefault(r.vec_id, []).append(r.cosine)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = (u @ u.T).astype(np.float64)
    np.fill_diagonal(c, -2)
    fifth = np.sort(c, axis=1)[:, -5]
    right = sum(sum(x >= fifth[i] - 1e-4 for x in xs) for i, xs in got.items())
    assert all(len(x) == 5 for x in got.values()) and right >= 0.97 * 5 * len(v)


def test_dense_group_keeps_its_true_neighbours(spark):
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(64)
    v = rng.standard_normal((3000, 64))
    v[:1000] = centre / np.linalg.norm(centre) + 0.176 / 8 * v[:1000]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(i, v[i].tolist()) for i in range(3)], "vec_id long, embedding array<float>")
    s = neighbours.CurveSettings(min_cosine=0.95, window=32, rows_per_range=500, block=300)
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    want = {(i, int(j)) for i in range(len(v)) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.95}
    got = {(r.vec_id, r.neighbour_id) for r in neighbours.nearest(df, "vec_id", "embedding", s).collect()}
    assert len(want) == 5000 and len(want & got) >= 4995 and len(got) == 5000
    asked = neighbours.nearest_of(df, "vec_id", "embedding", df.where("vec_id % 50 = 0").dropDuplicates(["vec_id"]), s).collect()
    mine = {(r.vec_id, r.neighbour_id) for r in asked if r.vec_id < 1000}
    assert len(mine) == 100 and len(mine & want) >= 99


def test_stated_queries_get_the_exact_five(spark):
    v = vectors(400)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    s = neighbours.CurveSettings(min_cosine=0.95, window=64)
    got = neighbours.nearest_of(df, "vec_id", "embedding", df.where("vec_id % 50 = 0"), s, block=3).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, len(v), 50):
        c = u @ u[q]
        c[q] = -2
        mine = sorted((r.cosine for r in got if r.vec_id == q), reverse=True)
        assert np.allclose(mine, np.sort(c)[::-1][:5], atol=1e-4)


# p3

SOURCE = '''
import os
x = """def not_real(a):
    "no, this is text that only looks like code"
"""
@dec(
    "a")
def one(a, b=(1, 2)) -> dict[str, int]:
    # a comment
    r"""Open the file and return all of its lines."""
    def inner(): "closes every file that is still open"; return 1
    return {"def x():": 1}

class K(Base):
    """Documentation of the class itself."""
    async def method(self,
                     b):
        ("Joined from two "
         "literals in brackets here.")
    def two(self): return "not documentation"
    def three(self):
        f"formatted strings are no documentation {self}"
    def four(self):
        """TODO: describe what this does to the pool."""
    def five_six(self):
        """Five six five six things."""
    def seven(self):
        "a value used".join([])
'''


def names(source):
    return {(f.name, f.start_line, f.kind) for f in functions_docs.scan_indented(source) if f.docstring is not None and not functions_docs.is_trivial(f.docstring, f.name)}


def test_functions_and_documentation():
    want = {("one", 6, "function"), ("inner", 11, "function"), ("method", 16, "method")}
    for ends in ("\n", "\r\n", "\r"):
        assert names(SOURCE.replace("\n", ends)) == want


def test_islands_against_the_parser():
    import inspect
    import json
    import textwrap as t
    import asyncio.base_events as be

    for module in (json.decoder, t, be, ast, inspect, re):
        source = inspect.getsource(module)
        mine = {(f.name, f.docstring) for f in functions_docs.scan_indented(source)}
        want = {(n.name, ast.get_docstring(n, clean=False)) for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        assert mine == want


def test_unsound_headers_are_left_out():
    source = 'def bad(a, = 3:\n    """A sentence that is long enough here."""\n@d\ndef good(a):\n    """A sentence that is long enough here."""\n\ndef worse(a, :\n    pass\nclass C:\n    def fine(self):\n        """Another sentence that is long enough."""\n'
    assert names(source) == {("good", 3, "function"), ("fine", 10, "method")}
    rng = random.Random(1)
    for _ in range(150):
        lines = SOURCE.split("\n")
        del lines[rng.randrange(len(lines))]
        list(functions_docs.scan_indented("\n".join(lines)[: rng.randrange(400)]))


def test_braced_grammar():
    java = "/** Opens the pool and keeps it. */\npublic int open(int a) {\n  if (a > 0) { return 1; }\n  return \"{\".length();\n}\nclass A {\n  // Closes every open file of it.\n  void close() { }\n}\n"
    got = {(f.name, f.start_line, f.end_line, f.kind, f.docstring) for f in functions_docs.scan_braced(java)}
    assert got == {("open", 2, 5, "function", "Opens the pool and keeps it."), ("close", 8, 8, "method", "Closes every open file of it.")}


def test_braced_signatures_with_nested_parentheses():
    code = """
/** Opens the pool that holds every file handle of the process. */
void g(int a = f(h(1)), char c = ')') {}
// Reads the rows of one table in order of their keys.
func (s *Store) Read(key func(int) (string, error)) (int, error) { if (x(y(1))) { z(); } }
"""
    assert [(f.name, f.kind) for f in functions_docs.scan_braced(code)] == [("g", "function"), ("Read", "function")]


def test_documented_functions_table(spark):
    df = spark.createDataFrame([(1, "python", SOURCE, 5), (1, "python", SOURCE, 5), (2, None, None, 5), (3, None, "", 5), (None, "x", SOURCE, 5), (4, None, "x = 1\n" * 50_000, 5)], "file_id long, lang string, source string, start_line int")
    got = functions_docs.documented_functions(df, "file_id", "lang", "source")
    assert rows(got, "file_id", "start_line") == [(1, 6), (1, 11), (1, 16)]
    assert functions_docs.documented_functions(df.limit(0), "file_id", "lang", "source").count() == 0


# p4


def brute_near(texts, t, k, least):
    sets = {}
    for i, x in texts:
        w = [w.lower() for w in re.findall("[A-Za-z0-9_]+", x or "")]
        if len(w) >= max(least, k):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_duplicates_against_brute_force(spark, tile):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(60):
        body = [rng.choice(words[: 12 if i % 5 == 0 else 400]) for _ in range(rng.randint(3, 60))]
        texts.append((len(texts), " ".join(body)))
        for _ in range(rng.randint(0, 3)):
            copy = list(body)
            for _ in range(rng.randint(0, len(copy) // 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((len(texts), " ".join(copy)))
    texts += [(1000, None), (1001, ""), (1002, "one two")]
    df = spark.createDataFrame([(i, x, 1) for i, x in texts + texts[:4]], "doc long, body string, id long")
    s = near_duplicates.JoinSettings(similarity=0.6, shingle=3, least=5, tile=tile)
    links, members = near_duplicates.similar(df, "doc", "body", s)
    assert set(rows(near_duplicates.expanded_pairs(links, members), "a", "b")) == brute_near(texts, 0.6, 3, 5)


def test_many_copies_are_tied_to_one(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(i, text) for i in range(40)] + [(50, text + " more")], "id long, text string")
    s = near_duplicates.JoinSettings(similarity=0.6, shingle=3)
    links, members = near_duplicates.similar(df, "id", "text", s)
    pairs = set(rows(near_duplicates.expanded_pairs(links, members), "a", "b"))
    assert pairs == {(0, i) for i in range(1, 40)} | {(0, 50)}
    got = near_duplicates.groups(links, members)
    assert rows(got.groupBy("group_id").count(), "group_id", "count") == [(0, 41)]
    empty, none = near_duplicates.similar(df.limit(0), "id", "text", s)
    assert near_duplicates.expanded_pairs(empty, none).count() == 0


def test_a_shingle_that_the_sample_misses_is_cut_into_tiles(spark):
    rng = random.Random(3)
    body = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts = [(i, " ".join(["all", "have", "this", *body(rng.randint(6, 40))])) for i in range(5000)]
    twins = [(10_000 + i, texts[i][1].replace("all have", "none has")) for i in range(0, 5000, 100) if len(texts[i][1].split()) > 30]
    df = spark.createDataFrame(texts + twins, "id long, text string")
    s = near_duplicates.JoinSettings(similarity=0.6, shingle=3, tile=64, sample=1)
    order = near_duplicates._Order(np.zeros(0, np.int64), s)
    sets = df.select("id", "text", F.unhex(F.md5("text")).alias("m")).mapInArrow(near_duplicates._prepare(s), "id long, text_mark binary, size int, same binary, signature binary, marks binary")
    postings = sets.select("id", "marks").mapInArrow(near_duplicates._postings(order, s), "key long, id long, cls int, meta long").cache()
    assert postings.groupBy("key").count().agg(F.max("count")).head()[0] > 1000
    assert near_duplicates._tiled(postings, s).groupBy("key").count().agg(F.max("count")).head()[0] <= 4 * s.tile
    links, members = near_duplicates.similar(df, "id", "text", s)
    assert set(rows(near_duplicates.expanded_pairs(links, members), "a", "b")) == {(i - 10_000, i) for i, _ in twins}


def test_a_large_family_keeps_all_its_links(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(300):
        own = list(base[: 60 + i % 20])
        own[rng.randrange(len(own))] = f"x{i}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "id long, text string")
    links, members = near_duplicates.similar(df, "id", "text", near_duplicates.JoinSettings(similarity=0.8, shingle=3, tile=16))
    assert set(rows(near_duplicates.expanded_pairs(links, members), "a", "b")) == brute_near(texts, 0.8, 3, 1)


@pytest.mark.parametrize("block", [4, 1024])
def test_classes_of_different_texts_come_out_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [(i, ("." * i + " ").join(words)) for i in range(20)]
    copies = [(i, "-".join(words)) for i in range(100, 120)]
    texts += [(60, " ".join(words) + " more"), (61, ", ".join(words) + " more")]
    df = spark.createDataFrame(texts + copies, "id long, text string")
    links, members = near_duplicates.similar(df, "id", "text", near_duplicates.JoinSettings(similarity=0.6, shingle=3))
    shown = sorted([i for i, _ in texts] + [100])
    want = set(combinations(shown, 2)) | {(100, i) for i in range(101, 120)}
    assert set(rows(near_duplicates.expanded_pairs(links, members), "a", "b")) == want


# p5


def brute_share(s, k=24):
    seen, cover = set(), [False] * len(s)
    for i in range(len(s) - k + 1):
        if s[i : i + k] in seen:
            cover[i : i + k] = [True] * k
        seen.add(s[i : i + k])
    return sum(cover) / max(1, len(s))


def test_repeated_share_against_brute_force():
    rng = random.Random(2)
    texts = ["", "a" * 23, "a" * 25, "ab" * 4000]
    for _ in range(80):
        base = "".join(rng.choice("ab c日") for _ in range(rng.randint(1, 70)))
        texts.append(base * rng.randint(1, 4) + "".join(rng.choice("xy") for _ in range(rng.randint(0, 40))))
    assert np.allclose(repetition.repeated_shares(texts), [brute_share(t) for t in texts])


def test_repetition_table(spark):
    said = "The pool closes every file that the last reader left open there. "
    df = spark.createDataFrame([(1, said * 4, 0), (1, said * 4, 0), (2, said + "It then waits for the next request of a client.", 0), (3, None, 0), (4, " ", 0), (5, "12 34 " * 20, 0)], "id long, text string, lang long")
    got = {r.item_id: r for r in repetition.repetition(df, "id", F.col("text")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1].repeated_share > 0.7 and got[2].repeated_share == 0 and got[3].repeated_share is None and got[5].word_divergence is None
    assert repetition.repetition(df.limit(0), "id", F.col("text")).count() == 0


def test_divergence():
    a = np.array([1.0, 0, 3])
    assert repetition.jensen_shannon(np.array([a, 2 * a]), 2 * a).tolist() == [0, 0]
    assert repetition.jensen_shannon(np.array([[1.0, 0]]), np.array([0, 1.0])) == pytest.approx([1])
    assert np.isnan(repetition.jensen_shannon(np.zeros((1, 2)), np.array([0, 1.0]))).all()


# p6


def greedy(text, limit, overlap):
    """Cuts one after another, from the same boundaries."""
    p, kind, line = splitting.boundaries(text, limit)
    begin = splitting._overlap_starts(p, kind, line, limit, overlap)
    step = splitting._successors(p, kind, begin, limit)
    out, i = [], 0
    while i < len(p) - 1:
        out.append((begin[i], p[i], p[step[i]]))
        i = step[i]
    return out


def test_pieces_put_the_text_together_again():
    rng = random.Random(4)
    texts = ["x" * 5001, "ab " * 3000, "\n" * 300]
    for _ in range(40):
        texts.append("\n".join(rng.choice(["", "def f():", "    x = " + "y" * rng.randint(0, 90), "    @d", "z" * rng.randint(0, 700), "日本 " * 20]) for _ in range(rng.randint(1, 90))))
    for limit, overlap in ((200, 2), (50, 0)):
        for text, (begin, at, end) in zip(texts, splitting.cuts(texts, limit, overlap)):
            assert "".join(text[a:e] for a, e in zip(at, end)) == text
            assert all(0 < e - b <= limit for b, e in zip(begin, end))
            assert list(zip(begin, at, end)) == greedy(text, limit, overlap)


def test_pieces_overlap_by_two_lines():
    text = "".join(f"line {i:03d} of the text\n" for i in range(40))
    (begin, at, end) = splitting.cuts([text], 200, 2)[0]
    for b, a in zip(begin[1:], at[1:]):
        assert text[b:a].count("\n") == 2


def test_split_table(spark):
    df = spark.createDataFrame([(1, "a\n" * 1500, 0), (1, "a\n" * 1500, 0), (2, "a" * 2000, 0), (3, None, 0), (4, "", 0)], "item_id long, source string, piece_no int")
    got = splitting.split_oversized(df, "chunk", "item_id", "source")
    assert rows(got, "item_id", "piece_no") == [(1, 0), (1, 1)]
    assert got.where("length(piece) > 2000").count() == 0
    assert splitting.split_oversized(df.limit(0), "chunk", "item_id", "source").count() == 0


# p7


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    data = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        if data and rng.random() < 0.5:
            base = data[rng.randrange(len(data))][1].split()
            if rng.random() < 0.6 and base:
                base[rng.randrange(len(base))] = rng.choice(words)
        data.append((i, " ".join(base), [f"r{rng.randrange(6)}" for _ in range(rng.randint(0, 2))], rng.choice(["heldout", "Held-Out", "tune", None, ""]), 0))
    data += [(500, None, None, "heldout", 0), (501, "", ["r1"], "tune", 0), data[3], data[4]]
    df = spark.createDataFrame(data, "qid long, question string, relevant array<string>, split string, key long")
    got = rows(cross_split.overlaps(df, "qid", "question", "relevant", "split", cross_split.OverlapSettings(tile=4, shard_rows=50)), "id", "other")
    held = {r[0]: r for r in data if re.sub("[^a-z]", "", (r[3] or "").lower()) == "heldout"}
    tune = {r[0]: r for r in data if r[0] not in held}
    want = []
    for a in held.values():
        for b in tune.values():
            x, y = (a[1] or "").split(), (b[1] or "").split()
            if x and y and (x == y or set(a[2] or ()) & set(b[2] or ()) and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))):
                want.append((a[0], b[0]))
    assert got == sorted(want)
    assert cross_split.overlaps(df.limit(0), "qid", "question", "relevant", "split").count() == 0


def test_equal_questions_are_one_class(spark):
    data = [(i, "where is the pool", ["r"], "heldout") for i in range(7)] + [(100 + i, "Where is the pool?", ["r", "r"], "tune") for i in range(9)] + [(200, "where is a pool", ["r"], "tune")]
    df = spark.createDataFrame(data, "qid long, question string, relevant array<string>, split string")
    pairs, members = cross_split.class_overlaps(df, "qid", "question", "relevant", "split")
    assert rows(pairs, "id", "other", "kind") == [(0, 100, "same"), (0, 200, "near")]
    assert rows(members.select("rep", "n").distinct(), "rep", "n") == [(0, 7), (100, 9), (200, 1)]
    got = rows(cross_split.expanded(pairs, members, block=2), "id", "other")
    assert got == [(a, b) for a in range(7) for b in (*range(100, 109), 200)]


# p8


def test_index_against_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sigma, n = int(rng.integers(2, 9)), int(rng.integers(1, 90))
        seq = np.append(rng.integers(0, sigma, n), 0)
        index = fm_index.FMIndex(seq, sigma, int(rng.integers(1, 8)))
        for length in (1, 3):
            patterns = rng.integers(1, sigma, (15, length))
            for p, a, b in zip(patterns, *index.search(patterns)):
                want = {i for i in range(len(seq) - length + 1) if (seq[i : i + length] == p).all()}
                assert set(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard, block", [(40, 2), (10_000, 100)])
def test_leaks_against_brute_force(spark, shard, block):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))), 1) for i in range(12)]
    docs = []
    for i in range(80):
        body = [rng.choice(words) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.6:
            w = items[rng.randrange(12)][1].split()
            lo = rng.randrange(len(w))
            body[rng.randint(0, len(body)) :] = w[lo : lo + rng.randint(3, 20)]
        docs.append((i, " _".join(body).title(), 1))
    docs += [(900, None, 1), (901, "", 1), docs[1]]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    d = spark.createDataFrame(docs, "doc long, text string, item_id long")
    e = spark.createDataFrame(items + items[:2], "item long, text string, doc_id long")
    got = leakage.leaked_spans(d, "doc", "text", e, "item", F.col("text"), run=5, shard_words=shard, block=block).collect()
    want = {(x[0], y[0]) for x in docs for y in items if grams(x[1]) & grams(y[1])}
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    text = {x[0]: x[1] for x in docs}
    for r in got:
        assert len(re.findall(r"[^\W_]+", text[r.doc_id][r.start_pos : r.end_pos])) == r.n_words
    assert leakage.leaked_spans(d, "doc", "text", e.limit(0), "item", F.col("text")).count() == 0
    assert leakage.leaked_spans(d.limit(0), "doc", "text", e, "item", F.col("text")).count() == 0


def test_word_places_where_lower_case_is_longer():
    assert leakage.word_places("İx yz") and leakage.words_of("İx yz")[-1] == "yz"
    assert [("İx yz"[a:b]) for a, b in leakage.word_places("İx yz")][-1] == "yz"


# p9


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(6)
    docs = [(i, s, " ".join("word" for _ in range(rng.randint(5, 60))), 1) for i, s in enumerate(["A"] * 400 + ["b-x "] * 60 + ["c"] * 30 + [None] * 5 + ["other"] * 9)]
    docs += [docs[0], (9000, "a", None, 1), (9001, "a", "", 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b_x", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 2), ("zero", None, 1)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mixture(d, "doc_id", "source", "text", t)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"a", "b_x", "c", "none"}
    for r in got.values():
        assert r.copies_used <= r.max_repeats and abs(r.reached_share - r.weight) < 0.02
    assert got["none"].mixed_tokens == 0
    list_ = taken.orderBy("place_end").collect()
    assert [r.finish for r in list_] == sorted(r.finish for r in list_)
    assert len({(r.doc_id, r.copy_no) for r in list_}) == len(list_)
    total = sum(r.tokens for r in list_)
    assert list_[-1].place_end == total <= min(r.available_tokens * r.max_repeats / r.weight for r in got.values() if r.n_docs)
    for empty in (mixing.mixture(d.limit(0), "doc_id", "source", "text", t), mixing.mixture(d, "doc_id", "source", "text", t.limit(0))):
        assert empty[0].count() == 0


# p10


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        (" \n\n ", []),
        ("One. Two!  Three?", ["One.", "Two!", "Three?"]),
        ("See fig. 3 in a_b.py for 4.5 ms. Ask Dr. Who or Ms. Vee, e.g. `x`, first.", ["See fig. 3 in a_b.py for 4.5 ms.", "Ask Dr. Who or Ms. Vee, e.g. `x`, first."]),
        ('The note says: "Keep it. Drop that." We compared both.', ['The note says: "Keep it. Drop that."', "We compared both."]),
        ('"Is it empty?" asked the reviewer. (The cache is off.) Yes.', ['"Is it empty?" asked the reviewer.', "(The cache is off.)", "Yes."]),
        ("It was lost ... or so he claimed ... For us it is late.", ["It was lost ... or so he claimed ...", "For us it is late."]),
        ("It starts at 4 p.m. on a Friday. It ends at 4 p.m. Then a_b waits.", ["It starts at 4 p.m. on a Friday.", "It ends at 4 p.m.", "Then a_b waits."]),
        ("Am 12. Mai wurde es, z. B. aus a_b.py, d. h. spät, verbunden. „Ist es gut?“, fragte sie.", ["Am 12. Mai wurde es, z. B. aus a_b.py, d. h. spät, verbunden.", "„Ist es gut?“, fragte sie."]),
        ("« Faut-il ? » demande M. X. Voilà !", ["« Faut-il ? » demande M. X. Voilà !"]),
        ("Поиск читает a, b и т. д. Затем см. рис. 3.", ["Поиск читает a, b и т. д.", "Затем см. рис. 3."]),
        ("担当者は「残す。消す。」と書きました。確認してください！", ["担当者は「残す。消す。」と書きました。", "確認してください！"]),
        ("他说：“保留。删除。”系统先读取……然后写入。", ["他说：“保留。删除。”", "系统先读取……然后写入。"]),
        ("ไฟล์ไม่มี ระบบ\nค้นหา", ["ไฟล์ไม่มี", "ระบบ", "ค้นหา"]),
        ("A line\nbreak is none\n\nA blank line is", ["A line\nbreak is none", "A blank line is"]),
        ('An open " mark. Still two.', ['An open " mark.', "Still two."]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_sentences_of_other_layouts():
    text = "# Title\nText one. Text two.\n- item one\n- item 2. More\n```\na. B.\n```\nEnd."
    assert [text[a:b] for a, b in sentences.sentences(text, "markdown")] == ["# Title", "Text one.", "Text two.", "- item one", "- item 2.", "More", "```\na. B.\n```", "End."]


def test_list_levels():
    text = "- one. Two\n  1. inner. More\n  2. next\n- last\n\nplain text goes on\n12. Mai is no item. End"
    assert [text[a:b] for a, b in sentences.sentences(text, "notes")] == ["- one.", "Two", "1. inner.", "More", "2. next", "- last", "plain text goes on\n12. Mai is no item.", "End"]


def test_many_open_brackets_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert len(list(sentences.sentences("(" * n + "]" * n))) == 1
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * max(took[0], 0.02)


def test_sentences_cover_the_text(spark):
    rng = random.Random(8)
    parts = ["One. ", "“Two! ", "(a ", ") ", "\n", "\n\n", "e.g. ", "3.5 ", "。", "ไทย ", "… ", '"', "x_y ", "- z "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["word. " * 20_000]
    for layout in ("prose", "notes"):
        for t in texts:
            spans = list(sentences.sentences(t, layout))
            assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())
            assert all(a < b and t[a:b].strip() == t[a:b] for a, b in spans)
    df = spark.createDataFrame([(1, "One. Two.", "prose", 0), (1, "One. Two.", "prose", 0), (2, None, None, 0), (3, "", None, 0), (4, "One. Two.", None, 0)], "id long, text string, layout string, start_pos int")
    got = sentences.split_sentences(df, "id", "text", "layout")
    assert rows(got, "doc_id", "start_pos", "end_pos") == [(1, 0, 4), (1, 5, 9), (4, 0, 4), (4, 5, 9)]
    assert sentences.split_sentences(df.limit(0), "id", "text", "layout").count() == 0
