"""Operators for training data against brute force, round trips and built cases."""

import base64
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("arborix.llm")

from arborix.llm import grammar, handwritten, mixing, queries, syntax, tokens, topn, truncation  # noqa: E402

FILES = "file_id long, repo string, path string, content string, language string, n_tokens long, origin string"


def files(spark, rows):
    return spark.createDataFrame([(i, r, p, c, None, 0, "x") for i, (r, p, c) in enumerate(rows)], FILES)


# -- all queries -----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query(spark, sf, name):
    from oracle import compare, duck

    q, sql = queries.all_queries()[name], queries.all_sql()[name]
    why, _, _ = compare(spark, duck(sf), sf, name, q, sql)
    assert not why


def rows(spark, sf, name):
    return queries.all_queries()[name](spark, sf).collect()


def test_ids_of_the_documents(spark, sf):
    """Every document of the tables against the tokenizer library."""
    enc = exact()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: list(r.ids) for r in rows(spark, sf, "p7_ids")} == {i: enc.encode_ordinary(t) for i, t in docs.items()}


def queue_one_by_one(sizes, targets, order, budget):
    """(doc_id, source, turn, tokens, running) of queues that are served one document at a time; ``sizes``: doc_id -> (source, tokens)."""
    all_ = []
    for source, weight, repeats in targets:
        mine = sorted((order[i], i) for i, (x, n) in sizes.items() if x == source and n > 0)
        upto = 0
        for turn in range(repeats):
            for _, i in mine:
                upto += sizes[i][1]
                all_.append((upto / weight, source, i, turn))
    out, run = [], 0
    for _, s, i, turn in sorted(all_):
        run += sizes[i][1]
        if run > budget:
            break
        out.append((i, s, turn, sizes[i][1], run))
    return out


def test_mix_of_the_documents(spark, sf):
    enc = exact()
    key = lambda s: s.strip(" ").lower().replace("-", "_")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet").collect()
    sizes = {r.doc_id: (key(r.source) if r.source else None, len(enc.encode_ordinary(r.text or ""))) for r in docs}
    budget = int(sum(n for _, n in sizes.values()) * targets[0].total_ratio)
    want = queue_one_by_one(sizes, [(key(t.source), t.target_share, t.max_repeats) for t in targets], {r.doc_id: r.h for r in docs}, budget)
    assert sorted(tuple(r) for r in rows(spark, sf, "p8_mix")) == sorted(want)
    shares = {r.source: r for r in rows(spark, sf, "p8_shares")}
    assert set(shares) == {key(t.source) for t in targets}
    for s, r in shares.items():
        mine = [x for x in want if x[1] == s]
        assert (r.n_drawn, r.tokens, r.most_turns) == (len(mine), sum(x[3] for x in mine), max((x[2] + 1 for x in mine), default=0))
        assert abs(r.reached_share - r.tokens / want[-1][4]) < 1e-9


def test_faults_of_the_files(spark, sf):
    """All p4 queries agree, and Python files with the interpreter."""
    files_ = spark.read.parquet(f"{sf}/source_files.parquet").collect()
    found = {r.file_id for r in rows(spark, sf, "p4_found")}
    faults = {r.file_id: r for r in rows(spark, sf, "p4_faults")}
    errors = rows(spark, sf, "p4_errors")
    assert set(faults) == found and {(r.file_id, r.line, r.message) for r in errors if r.ord == 1} == {(i, r.first_line, r.first_fault) for i, r in faults.items()}
    assert len(errors) == sum(r.n_faults for r in faults.values())
    rates, langs = rows(spark, sf, "p4_rates"), {r.language: r for r in rows(spark, sf, "p4_languages")}
    assert sum(r.n_invalid for r in rates) == len(found) and sum(r.n_files for r in rates) == len(files_)
    assert {x: (sum(r.n_files for r in rates if r.language == x), sum(r.n_invalid for r in rates if r.language == x)) for x in langs} == {x: (r.n_files, r.n_invalid) for x, r in langs.items()}
    for r in files_:
        if r.path.endswith(".py"):
            try:
                compile(r.content or "", "x", "exec", dont_inherit=True)
                valid = True
            except SyntaxError as e:
                # the compiler also refuses what the grammar allows, such as a return outside of a function
                valid = "outside" in str(e)
            assert valid == (r.file_id not in found), r.path


def test_origins_and_truncations_agree(spark, sf):
    origins = {r.file_id: r for r in rows(spark, sf, "p1_origins")}
    assert {r.file_id for r in rows(spark, sf, "p1_found")} == {i for i, r in origins.items() if r.origin != "hand"}
    assert set(origins) == {r.file_id for r in spark.read.parquet(f"{sf}/source_files.parquet").collect()}
    assert all(r.source_id in origins for r in origins.values() if r.origin == "copy")
    cut = rows(spark, sf, "p9_found")
    rates = rows(spark, sf, "p9_rates")
    assert len(cut) == len({r.doc_id for r in cut}) == sum(r.n_truncated for r in rates) > 0
    assert all(r.n_at_limit <= r.n_truncated <= r.n_texts and abs(r.rate - r.n_truncated / r.n_texts) < 1e-9 for r in rates)
    assert {(r.source, r.unit) for r in rows(spark, sf, "p9_limits")} <= {(r.source, u) for r in rates for u in ("chars", "bytes")}


# -- p1 --------------------------------------------------------------------------------


def reference_repair_size(seq):
    """Re-Pair one pair at a time."""
    seq, rules, nxt = list(seq), 0, max(seq) + 1 if seq else 0
    while True:
        counts, i = {}, 0
        while i < len(seq) - 1:
            p = (seq[i], seq[i + 1])
            counts[p] = counts.get(p, 0) + 1
            i += 2 if i + 2 < len(seq) and seq[i] == seq[i + 1] == seq[i + 2] else 1
        best = max(counts.items(), key=lambda x: x[1], default=(None, 0))
        if best[1] < 2:
            return len(seq) + 2 * rules
        out, i = [], 0
        while i < len(seq):
            if i + 1 < len(seq) and (seq[i], seq[i + 1]) == best[0]:
                out.append(nxt)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, rules, nxt = out, rules + 1, nxt + 1


def test_repair_is_near_the_sequential_grammar():
    rng = random.Random(1)
    for seq in ([rng.randint(0, 3) for _ in range(300)], [0, 1, 2, 3] * 60, [rng.randint(0, 200) for _ in range(200)], [7] * 128, [1]):
        s, r, _ = grammar.repair(np.array(seq), np.zeros(len(seq), int), 1)
        ours, theirs = s[0] + 2 * r[0], reference_repair_size(seq)
        assert theirs * 0.8 - 4 <= ours <= theirs * 1.35 + 6


def test_repair_keeps_files_apart():
    a, b = [1, 2, 3, 4] * 30, list(range(5, 60))
    s, r, reuse = grammar.repair(np.array(a + b), np.array([0] * len(a) + [1] * len(b)), 2)
    assert s[0] + 2 * r[0] < 25 and s[1] == len(b) and r[1] == 0 and reuse[0] > 0.9 and reuse[1] == 0
    s, r, _ = grammar.repair(np.array([], int), np.array([], int), 3)
    assert list(s) == [0, 0, 0]


def test_anchored_rules_are_the_same_anywhere():
    rng = random.Random(2)
    common = [rng.getrandbits(63) for _ in range(400)]
    seqs = [[rng.getrandbits(63) for _ in range(rng.randint(0, 50))] + common + [rng.getrandbits(63) for _ in range(30)] for _ in range(2)]
    flat = np.array(seqs[0] + seqs[1], np.uint64)
    rule, file, size = grammar.anchored(flat, np.array([0] * len(seqs[0]) + [1] * len(seqs[1])), 20)
    parts = [dict(zip(rule[file == i].tolist(), size[file == i].tolist())) for i in (0, 1)]
    shared = sum(n for r, n in parts[0].items() if r in parts[1])
    assert 330 <= shared <= 400
    assert sum(size[file == 0]) == len(seqs[0])


def code(rng, n=14):
    w = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    kinds = [lambda: f"    if {w()} > {rng.randint(1, 99)}:\n        {w()}({w()}, {w()}.{w()})", lambda: f"    {w()} = [{w()} for {w()} in {w()}({w()})]", lambda: f"    with {w()}({w()}) as {w()}:\n        {w()} += {rng.randint(1, 9)}", lambda: f"    return {w()} or {w()}.{w()}", lambda: f"    {w()}.{w()}('{w()}', {w()}={w()})"]
    return f"import {w()}\n\n" + "\n\n".join(f"def {w()}({w()}, {w()}=None):\n" + "\n".join(rng.choice(kinds)() for _ in range(rng.randint(2, 5))) for _ in range(n)) + "\n"


def test_origins(spark):
    rng = random.Random(3)
    lib = code(rng, 10)
    patched = lib.replace("import", "# local patch\nimport", 1) + "\ndef extra(a):\n    return a\n"
    blob = "DATA = '" + base64.b64encode(bytes(rng.getrandbits(8) for _ in range(1500))).decode() + "'\n"
    table = "T = [\n" + "\n".join("    " + ", ".join(str(rng.randint(0, 9999)) for _ in range(12)) + "," for _ in range(40)) + "\n]\n"
    made = "\n".join(f"    def get_{'abcdefghij'[i % 10]}{i}(self):\n        return self.slots[{i}]\n" for i in range(40))
    packed = ";".join(f"function {a}{i}(a,b){{return a?b.{a}(a):{i}}}" for i, a in enumerate("qwertzuiopasdfg")) * 2
    prose = "x = '" + "The fix moves the check from one place to another and drops the old one. " * 2 + "It is not clear why the caller does that twice; please look at the notes on it again." + "'\n"
    rows = [("a/x", "src/m.py", code(rng)), ("a/x", "v/lib.py", lib), ("b/y", "w/lib.py", patched), ("a/x", "src/blob.py", blob), ("a/x", "t.py", table), ("a/x", "gen.py", "class A:\n" + made), ("a/x", "p.js", packed), ("a/x", "told.py", "# Code generated by tool from x.proto. DO NOT EDIT.\n" + code(rng)), ("a/x", "kept.py", "# this used to be auto-generated, now kept by hand\n" + code(rng)), ("a/x", "string.py", "HEADER = '@generated'\n" + code(rng)), ("a/x", "prose.py", code(rng, 1) + prose), ("a/x", "empty.py", ""), (None, "null.py", None), ("a/x", "same.py", lib), ("a/x", "list.py", "LIMIT = [1, 2, 3, 4]\n")]
    got = {r.file_id: r.origin for r in handwritten.classify(files(spark, rows)).collect()}
    # a remark that no other file bears out is no evidence
    want = ["hand", "copy", "copy", "data", "data", "tool", "packed", "hand", "hand", "hand", "hand", "hand", "hand", "copy", "hand"]
    assert [got[i] for i in range(len(rows))] == want
    assert handwritten.not_handwritten(files(spark, [])).count() == 0


def test_remarks_are_learned_from_files_that_fold(spark):
    """What stands in the comments of files that fold marks the others that say it; what hand-written files say marks none."""
    rng = random.Random(12)
    made = lambda i: "\n".join(f"    def get_{'abcdefghij'[k % 10]}{k}{i}(self):\n        return self.slots[{k}]\n" for k in range(40))
    rows = [(f"r{i % 6}", f"a{i}.py", f"# written by stubmaker {i} from the idl, keep out\nclass A:\n{made(i)}") for i in range(40)]
    rows += [(f"r{i % 6}", f"b{i}.py", f"# written by stubmaker {i} from the idl, keep out\n{code(rng, 7)}") for i in range(20)]
    rows += [(f"r{i % 6}", f"c{i}.py", f"# this module was code generated by hand, so do not edit it lightly\n{code(rng, 7)}") for i in range(30)]
    rows += [(f"r{i % 6}", f"d{i}.py", f"# Taken verbatim from the spec table\n{code(rng, 7)}") for i in range(10)]
    rows += [(f"r{i % 6}", f"e{i}.py", code(rng, 7)) for i in range(150)] + [("r1", "f.py", "x = 1  # code generated by hand, do not edit")]
    got = {r.file_id: r.origin for r in handwritten.classify(files(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == ["tool"] * 60 + ["hand"] * 191


def test_the_author_is_no_copy(spark):
    """The author's own file is told from copies in folders of vendored code, and copies name the file that was first."""
    rng = random.Random(13)
    lib, other = code(rng, 10), code(rng, 10)
    schema = FILES + ", modified_at timestamp"
    rows = [("me/lib", "src/lib.py", lib, 1), ("a/x", "vendor/lib/lib.py", lib, 5), ("b/y", "app/node_modules/lib.py", lib + "\ny = 2\n", 6), ("c/z", "src/o.py", other, 9), ("d/w", "src/p.py", other, 8), ("me/lib", "src/mine.py", code(rng), 2)]
    df = spark.createDataFrame([(i, r, p, c, None, 0, "x", datetime(2025, 1, t)) for i, (r, p, c, t) in enumerate(rows)], schema)
    got = {r.file_id: (r.origin, r.source_id) for r in handwritten.classify(df).collect()}
    assert got == {0: ("hand", 0), 1: ("copy", 0), 2: ("copy", 0), 3: ("copy", 4), 4: ("copy", 4), 5: ("hand", None)}


def test_a_grammar_does_not_depend_on_other_files():
    rng = random.Random(14)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(2, 60))] for _ in range(2))
        both = grammar.repair(np.array(a + b), np.array([0] * len(a) + [1] * len(b)), 2)
        for i, x in enumerate((a, b)):
            alone = grammar.repair(np.array(x) + 7, np.zeros(len(x), int), 1)
            assert [v[i] for v in both] == [v[0] for v in alone]


def test_short_names_alone_are_not_packed(spark):
    """Long names elsewhere or plain layout do not matter: the grammar of the characters against that of the tokens decides."""
    rng = random.Random(15)
    packed = ";".join(f"function {a}{i}(a,b){{return a?b.{a}(a):{i}}}" for i, a in enumerate("qwertzuiopasdfg")) * 2
    few = "i = 1\nj = 2\n"
    got = {r.file_id: (r.origin, r.spelled) for r in handwritten.classify(files(spark, [("r", "a.js", packed), ("r", "b.py", few), ("r", "c.py", code(rng))])).collect()}
    assert got[0][0] == "packed" and got[0][1] < handwritten.SPELLED and got[1] == ("hand", None) and got[2] == ("hand", None)


def test_long_blobs(spark, monkeypatch):
    """Random literals are data at every length and with every alphabet, and prose at none; also in a line longer than a piece."""
    rng = random.Random(8)
    blobs = [rng.randbytes(n).hex()[:n] for n in (320, 2000, 20_000)] + [base64.b64encode(rng.randbytes(n)).decode()[:n] for n in (320, 2000, 8000, 20_000, 1_200_000)] + ["".join(rng.choice("ACGT") for _ in range(5000))]
    prose = [" ".join(sentence(rng) for _ in range(n)) for n in (8, 60, 600)]
    rows = [("a/x", f"src/blob{i}.py", f"DATA = '{x}'\n") for i, x in enumerate([*blobs, *prose, "-" * 2000])]
    got = {r.file_id: r.origin for r in handwritten.classify(files(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == ["data"] * len(blobs) + ["hand"] * (len(prose) + 1)
    text = "a = 1\n" * 20 + f"b = '{blobs[3]}'\nc = 2\n"
    whole = [x for p in handwritten._pieces(text, handwritten._HASH) for x in p]
    monkeypatch.setattr(handwritten, "PIECE_CHARS", 100)
    pieces = list(handwritten._pieces(text, handwritten._HASH))
    assert len(pieces) > 2 and [x for p in pieces for x in p] == whole and f"'{blobs[3]}'" in whole


# -- p4 --------------------------------------------------------------------------------


def test_all_faults_are_given(spark):
    rows = [("r", "c.js", "a = ;\nfunction f() {\n  b = ;\n}\n"), ("r", "b.py", "x = 1\n")]
    got = syntax.invalid(files(spark, rows)).collect()
    assert [(r.file_id, [x.line for x in r.faults]) for r in got] == [(0, [1, 3])]
    assert got[0].n_faults == 2 and got[0].faults[0].message == got[0].first_fault


DEEP = {
    "js": ["if(a){}" + " else if(b){}" * 5000, "x=" + "a?b:" * 5000 + "c;", "x=" + "[" * 5000 + "]" * 5000, "x=" + "f(" * 5000 + ")" * 5000, "{" * 5000 + "}" * 5000],
    "ts": ["x=" + "a?b:" * 5000 + "c;", "let x:" + "A<" * 5000 + "B" + ">" * 5000 + "=1"],
    "tsx": ["x=" + "<a>" * 5000 + "</a>" * 5000],
    "py": ["x=" + "lambda:" * 5000 + "1", "x=" + "a if b else " * 5000 + "c", "if a:\n  b\n" + "elif c:\n  d\n" * 5000, "x=" + "(" * 200 + ")" * 200],
    "rs": ["fn f(){if a{}" + " else if b{}" * 5000 + "}", "fn f(x:" + "Vec<" * 5000 + "A" + ">" * 5000 + "){}", "fn f(){" + "{" * 5000 + "}" * 5000 + "}"],
    "svelte": ["<a>" * 5000 + "</a>" * 5000, "{#if a}" + "{:else if b}" * 5000 + "{/if}"],
}


def test_nesting_is_no_fault(spark):
    """Only the languages' own limits count: Python has 200 open brackets and 100 levels of indentation."""
    good = [("r", f"f{i}.{e}", t) for e, texts in DEEP.items() for i, t in enumerate(texts)]
    bad = [("r", "a.py", "x=" + "(" * 201 + ")" * 201), ("r", "b.py", "".join(" " * i + "if a:\n" for i in range(100)) + " " * 100 + "b\n"), ("r", "c.js", "x=" + "[" * 5000 + "]" * 4999)]
    got = {r.file_id for r in syntax.invalid(files(spark, good + bad)).collect()}
    assert got == {len(good) + i for i in range(len(bad))}


def test_errors_and_languages(spark):
    rows = [("r", "c.js", "a = ;\nfunction f() {\n  b = ;\n}\n"), ("r", "b.py", "x = 1\n"), ("s", "d.js", ""), (None, "e.js", None)]
    df = files(spark, rows)
    assert [(r.file_id, r.ord, r.line) for r in syntax.errors(df).orderBy("ord").collect()] == [(0, 1, 1), (0, 2, 3)]
    got = {r.language: (r.n_files, r.n_invalid) for r in syntax.languages(df).collect()}
    assert got == {"javascript": (3, 1), "python": (1, 0)}
    assert syntax.errors(files(spark, [])).count() == 0 and syntax.languages(files(spark, [])).count() == 0


def test_faults(spark):
    rows = [("r", "a.py", "def f():\n    return (1\n"), ("r", "b.py", "x = 1\n"), ("r", "c.js", "a = ;\nfunction f() {\n  b = ;\n}\n"), ("r", "d.md", "(("), ("r", "e.rs", None), (None, "f.ts", ""), ("r", "g.svelte", "{#if a}"), ("s", "h.py", "<<<<<<< HEAD\n"), ("s", None, "((")]
    df = files(spark, rows)
    got = {r.file_id: (r.first_line, r.n_faults) for r in syntax.invalid(df).collect()}
    assert set(got) == {0, 2, 6, 7} and got[2] == (1, 2)  # panic mode goes on to the second fault
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid, r.acceptance) for r in syntax.rates(df).collect()}
    assert rates[("r", "python")] == (2, 1, 0.5) and rates[(None, "typescript")] == (1, 0, 1.0)
    assert syntax.invalid(files(spark, [])).count() == 0


# -- p5 --------------------------------------------------------------------------------

ENTRIES = "entry_id long, seed long, section string, file string, function string, is_test boolean, line long, depth long, heat long, rnk long"


def test_top_n(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(["caller", "reference"]), rng.choice("abé"), rng.choice("fg"), rng.choice([True, False, None]), rng.choice([None, 1, 2, 3]), 1, rng.choice([None, 0, 5, 5, 9]), 0) for i in range(3000)]
    rows += rows[:50]
    got = sorted(tuple(r) for r in topn.top_context(spark.createDataFrame(rows, ENTRIES)).collect() if r.seed is not None)
    best = {}
    for e, s, sec, f, fn, t, ln, _, h, _ in rows:
        k = (s, sec, t, f, ln, fn)
        best[k] = max(best.get(k, (-1, 0)), (h or 0, -e))
    groups = {}
    for (s, sec, t, f, ln, fn), (h, e) in best.items():
        groups.setdefault((s, sec, t), []).append((-h, f.encode(), -1 if ln is None else ln, fn, -e))
    want = sorted((s, sec, x[4], i + 1) for (s, sec, _), v in groups.items() if s is not None for i, x in enumerate(sorted(v)[:5]))
    assert got == want
    assert topn.top_context(spark.createDataFrame([], ENTRIES)).count() == 0


def test_a_group_over_many_partitions(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 18000, 1).otherwise(F.col("id")).alias("g"), F.col("id").alias("e"), F.lit(0).alias("rnk"))
    got = topn.top_n(df.drop("rnk"), ["g"], [F.col("e").desc()], "e", 7000)
    assert [tuple(r) for r in got.filter("g = 1").orderBy("rnk").select("e", "rnk").collect()] == [(17999 - i, i + 1) for i in range(7000)]
    assert got.count() == 7000 + 2000


# -- p7 --------------------------------------------------------------------------------

TEXTS = ["", None, "Hello  world's  \n\n x\t ", "naïve ἀρχή 𝒻(x) 日本語 👩🏽‍💻 \u00a0\u3000 z", "a" * 5000, "it'll we've I'M 12345 ½ ²", " \n ", "<|endoftext|> is text", "the the the the", "\r\nx\r\n", "'s't", "\u0085x\u2028y\u200b"]


def exact():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=tokens.ranks(), special_tokens={})


def test_ids(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "w", "ids") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, ids string")
    enc = exact()
    want = {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()} == want
    assert {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.tokens for r in tokens.count_tokens(df, ["doc_id", "word"]).collect()}
    assert sizes == {i: len(v) for i, v in want.items()}
    # a bound that takes only the most frequent words, or none
    for bound in (150, 0):
        monkeypatch.setattr(tokens, "DICTIONARY_BYTES", bound)
        assert {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()} == want
        assert {r.doc_id: r.tokens for r in tokens.count_tokens(df, ["doc_id", "word"]).collect()} == sizes
        again = df.unionByName(df).withColumn("doc_id", F.lit(None).cast("long"))  # repeated rows and null keys
        assert sorted(list(r.ids) for r in tokens.encode(again).collect()) == sorted(2 * list(want.values()))
        assert tokens.encode(df.limit(0)).count() == 0
    monkeypatch.setattr(tokens, "BATCH", 3)
    monkeypatch.setattr(tokens, "COUNTED", 2)
    assert {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()} == want
    monkeypatch.undo()
    assert tokens.encode(df.limit(0)).count() == 0 and tokens.decode(tokens.encode(df.limit(0))).count() == 0


# -- p8 --------------------------------------------------------------------------------

TARGETS = "source string, target_share double, max_repeats int, total_ratio double"


def mixed(spark, rows, targets):
    sizes = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, tokens long")
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame(targets, TARGETS)
    drawn = mixing.mix(docs, t, sizes=sizes).cache()
    return drawn.orderBy("running").collect(), {r.source: r for r in mixing.shares(drawn, t).collect()}


def test_shares(spark):
    rng = random.Random(5)
    rows = [("a", rng.randint(1, 20)) for _ in range(4000)] + [("b", rng.randint(1, 20)) for _ in range(2000)] + [("c", 10) for _ in range(20)] + [("z", 50)] * 30
    total = sum(n for _, n in rows)
    drawn, share = mixed(spark, rows, [("a", 0.5, 1, 0.5), ("b", 0.3, 2, 0.5), ("C ", 0.2, 3, 0.5), ("none", 0.1, 1, 0.5)])
    budget = int(total * 0.5)
    assert budget - 20 < sum(r.tokens for r in drawn) <= budget == max(budget, drawn[-1].running)
    assert share["c"].tokens == 600 and share["c"].most_turns == 3 and share["none"].tokens == 0 and "z" not in share
    assert abs(share["a"].tokens / share["b"].tokens - 5 / 3) < 0.02
    assert all(r.turn == 0 for r in drawn if r.source == "a")
    per = {}
    for r in drawn:
        per.setdefault((r.source, r.doc_id), []).append(r.turn)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    # the order is that of the finish times of queues kept one by one
    run = 0
    for r in drawn:
        run += r.tokens
        assert r.running == run


def test_mix_is_that_of_queues_kept_one_by_one(spark):
    """Every drawn occurrence, its order and its running sum, against queues that are served one document at a time."""
    rng = random.Random(10)
    for k, ratio in enumerate((0.05, 0.4, 0.9, 1.7, 9.0)):
        table = [(rng.choice("aaaabbc"), rng.choice([1, 3, 3, 8, 20, 150])) for _ in range(700)]
        targets = [("a", 0.2, 1, ratio), ("b", 0.55, 3, ratio), ("c", 0.25, 5, ratio)]
        df = spark.createDataFrame([(i,) for i in range(len(table))], "doc_id long")
        order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()}
        want = queue_one_by_one(dict(enumerate(table)), [t[:3] for t in targets], order, int(sum(n for _, n in table) * ratio))
        drawn, _ = mixed(spark, table, targets)
        assert [tuple(r) for r in drawn] == want, k


def test_mix_edges(spark):
    assert mixed(spark, [], [("a", 1.0, 1, 0.5)])[0] == []
    drawn, share = mixed(spark, [("a", 0), ("a", 3), (None, 5)], [("a", 1.0, 1, 1.0), (None, 0.5, 1, 1.0)])
    assert [(r.doc_id, r.tokens) for r in drawn] == [(1, 3)] and share["a"].reached_share == 1.0
    assert mixed(spark, [("a", 3)], [])[0] == []


# -- p9 --------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, n_chars long, posterior double"


def sentence(rng):
    v = lambda *x: rng.choice(x)
    return v("The {} path never checks the {}, so the {} stays open.", "We should {1} the {0} before the {2} is written.", "With {0} files the {1} index is rebuilt in full.", "Please look at the {} and add a {} test for the {} case.").format(*(v("inner", "outer", "quiet", "late", "plain", "spare", "hidden", "narrow", "fast", "wide") for _ in range(3)))


def test_truncation(spark):
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(1500):
        whole = " ".join(sentence(rng) for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "\n\nThanks", "\n\nand so on ..."])
        text = whole
        if i % 3 == 0 and len(whole) > 260:
            text, src = whole[:260], "Short-Form"
            cut.add(i)
        else:
            src = "short_form" if len(whole) <= 260 else "letters"
            if i % 40 == 1:
                at = rng.randint(30, len(whole) - 8)
                while not (whole[at - 1].isalpha() and whole[at].isalpha()):
                    at -= 1
                text = whole[:at]
                cut.add(i)
        rows.append((i, text, src, len(text), 0.0))
    rows += [(9001, None, "letters", 0, 0.0), (9002, "", "letters", 0, 0.0), (9003, "  \n ", None, 0, 0.0), (9004, "x" * 20000 + ".", "letters", 0, 0.0)]
    df = spark.createDataFrame(rows, DOCS)
    limits = {(r.source, r.limit) for r in truncation.length_limits(df).collect()}
    assert limits == {("short_form", 260)}
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    right = len(got & cut)
    assert right / len(cut) > 0.9 and right / len(got) > 0.95
    assert not got & {9001, 9002, 9003}
    rates = {r.source: r for r in truncation.rates(df).collect()}
    assert rates["short_form"].n_at_limit > 50
    assert truncation.truncated(df.limit(0)).count() == 0


def test_limits_of_any_share(spark):
    """A limit may have few of a source's texts at it and many above it; neither a hump nor a start of the lengths is one."""
    rng = random.Random(9)
    abc = "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: "".join(rng.choice(abc) for _ in range(n))
    wide = [("wide", text(rng.randint(20, 1000))) for _ in range(8000)]
    few = wide + [("wide", text(300)) for _ in range(25)] + [("wide", text(700)) for _ in range(400)]  # 0.3 % and 5 %; nearly 70 % and 30 % above
    hump = [("hump", text(max(1, round(rng.gauss(22, 2))))) for _ in range(3000)] + [("hump", text(rng.randint(1, 400))) for _ in range(3000)]
    start = [("start", text(rng.randint(200, 300))) for _ in range(3000)]
    small = [("small", text(rng.randint(1, 5000))) for _ in range(60)] + [("small", text(900)) for _ in range(7)]
    chars = [("units", text(rng.randint(20, 600))) for _ in range(2000)] + [("units", text(399 - i % 3) + "é" * (1 + i % 3)) for i in range(400)] + [("units", text(rng.randint(401, 700))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, s, len(t), 0.0) for i, (s, t) in enumerate(few + hump + start + small + chars)], DOCS)
    got = {(r.source, r.unit, r.limit): r.posterior for r in truncation.length_limits(df).filter("at = limit").collect()}
    assert set(got) == {("wide", "chars", 300), ("wide", "chars", 700), ("small", "chars", 900), ("units", "chars", 400)}
    assert got[("wide", "chars", 700)] > 0.9 and got[("wide", "chars", 300)] > 0.5


def test_open_code(spark):
    good = "Some words about it.\n\n```python\nx = f(1)\n```\n\nThat is all there is."
    rows = [(i, good, "n", 0, 0.0) for i in range(60)] + [(100, "Some words about it.\n\n```python\nx = f(1", "n", 0, 0.0), (101, "import os\n\n\ndef f(a):\n    return os.path(a, [1, 2", "n", 0, 0.0)]
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {100, 101}


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts[len(root.parts) :]:
            assert not re.search(r"^\s*(from|import)\s+[.\w]*\bllm\b", p.read_text(), re.M), p
