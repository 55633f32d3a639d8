import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import grammars, handwritten, syntax

GOOD = {
    "js": [
        "import a, { b as c } from 'x';\nexport default class extends A { #p = 1; static async *g() { yield* x } get v() { return this.#p } }\n",
        "const f = async ({ a = 1, ...r }, [b, , c]) => ({ [a]: b, ...r })\nlet re = /[/\\]]+/g.test(s) ? a?.b?.[0] ?? 1 : `t ${`n ${x}`} e`\nfor (const [k, v] of Object.entries(o)) { if (k) continue; else break }\n",
        "!function(t,e){\"use strict\";for(var i=0;i<3;i++)e.x=i>>>2^t;t[\"a\"]=e?void 0:!0}(this,w);\nlabel: while (1) { do x++; while (x < 3) break label }\ntry { a() } catch { b() } finally {}\nswitch (x) { case 1: default: y() }\n",
        "/*\n<<<<<<< HEAD\n notes ( [ {\n=======\n>>>>>>> x\n*/\nvar a = 'open {'; // (\n",
    ],
    "ts": [
        "interface A<T extends B = C> extends D, E { a?: string | null; readonly [k: string]: number; m(x: number): void }\ntype F = (a: string, ...r: number[]) => Promise<Map<string, Array<number>>>;\nexport const g = async <T,>(a: T): Promise<void> => { let x = y as unknown as string[]; z!.w<number>(1) }\n",
        "export abstract class K<T> extends L<T> implements M { private constructor(public readonly a: string, b?: number) { super() } abstract f(): asserts a is string; declare x: typeof import('y') }\nenum E { A = 1, B }\ndeclare module 'm' { export const q: keyof typeof r }\nfunction h(this: X, a: A[B]['c']): a is D { return a satisfies D }\n",
    ],
    "java": [
        "package a.b;\nimport static java.util.*;\n@A(x = {1, 2}) public final class B<T extends C & D> extends E<T> implements F { private int[] x = {1, 2}, y[]; static { z(); } <U> B(U... u) throws G { this.x = new int[3]; } }\n",
        "class A { void f() { for (var x : xs) { int y = (int) (x + 1) >> 2 >>> 1; List<Map<String, int[]>> l = new ArrayList<>() {}; Runnable r = () -> {}; a.b(String[]::new, (p, q) -> p + q); } String s = switch (k) { case A, B -> \"x\"; default -> { yield \"y\"; } }; if (o instanceof String t && !t.isEmpty()) return; try (var z = open()) { } catch (A | B e) { throw e; } } record R(int a) {} enum E { X(1) { }, Y; int z; } }\n",
    ],
    "go": [
        "package m\n\nimport (\n\tf \"fmt\"\n\t. \"os\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (x []int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn nil, f.Errorf(\"%v\", a)\n\t} else if x := []T{{A: 1}, {B: 2}}; len(x) > 0 {\n\t}\n\tfor i, c := range s.A[1:] {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch t := x.(type) {\n\tcase []int, map[string]func(int) error:\n\tdefault:\n\t\tfallthrough\n\t}\n\tvar r = `raw (`\n\tdefer s.Close()\n\treturn\n}\n",
    ],
    "c": [
        "#include <stdio.h>\n#define X(a) \\\n  (a\n#ifdef A\nint b(\n#else\n#endif\ntypedef struct n { int a[3]; struct n *next; unsigned f : 3; } node_t;\nstatic const char *s[] = { [0] = \"a\" \"b\", 'c' };\nint (*fp)(const char *, ...);\nint main(int argc, char **argv)\n{\n    size_t n = sizeof(int) * (size_t)argc, *p = &n;\n    for (int i = 0; i < 3; i++) x[i] = (char)(i + 1);\n    while (*p++ != '\\0') continue;\n    switch (n) { case 1: break; default: goto out; }\n    do { self->a.b = -1; } while (0);\nout:\n    return n ? 1 : 0;\n}\n",
    ],
}
BAD = {
    "js": ["let x = ;", "function (a) {}", "a b", "if (x { }", "const t = 'open", "import from 'x';", "x = {a: 1,, b}", "try { }", "1 = 2;", "<<<<<<< HEAD\nlet a\n", "let x: number = 1", "class { }", "`${a", "def f():\n    pass", "\x1f\x8b\x08"],
    "ts": ["interface { }", "let x: = 1;", "function f(a: string { }", "type A = ;", "package x"],
    "java": ["class A { int x }", "class A { void f() { a b c; } }", "package a.b", "class A { void f() { x; } }", "class A { void f() { if x { } } }", "import a.b.C", "public class", "class A { String s = 'ab'; }", "# Title\n\ntext"],
    "go": ["func f() {}", "package m\nfunc f( {\n}\n", "package m\nfunc f() {\n\tx := \n}\n", "package m\nimport fmt\n", "package m\nfunc f()\n{\n}\n", "package m\nvar x = 'ab'\n"],
    "c": ["int main( { }", "int x", "int f() { return 1 }", "int f() { x = ; }", "# Title\n", "#include\n", "#endif\n", "struct { int a }", "int f() { if (a { } }", "from a import b\n"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lang, text):
    assert syntax.judge(lang, text) is None
    assert syntax.judge(lang, text.replace("\n", "\r\n")) is None


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(lang, text):
    assert syntax.judge(lang, text)


@pytest.mark.parametrize("lang", ["js", "java", "go"])
def test_truncated(lang):
    for text in GOOD[lang][:2]:
        cuts = [i for i in range(len(text) // 2, len(text) - 3, 7)]
        assert sum(bool(syntax.judge(lang, text[:i])) for i in cuts) >= 0.6 * len(cuts)


def test_data_languages():
    ok = [("json", '{"a": [1.5e3, null, "x\\u00e9"]}'), ("toml", "a = 1\n[b]\nc = [1, 2]\n"), ("xml", '<?xml version="1.0" encoding="latin-1"?><a b="ü"/>'), ("python", "async def f(x: int = 1) -> None:\n    return [y async for y in x]\n"), ("json", "  \n"), ("xml", ""), ("python", "﻿x = 1\n")]
    bad = [("json", "{'a': 1}"), ("json", "[NaN]"), ("json", "[1,]"), ("json", '["a\tb"]'), ("toml", "a = \n"), ("xml", "<a><b></a>"), ("xml", "text"), ("python", "def f(:\n"), ("python", "x = 'a\n"), ("python", "a\x00b")]
    assert [syntax.judge(*x) for x in ok] == [None] * len(ok)
    assert all(syntax.judge(*x) for x in bad)


def test_summaries_are_associative():
    rng = random.Random(3)
    bits = ["{", "}", "(", ")", "[", "]", '"', "'", "`", "//", "/*", "*/", "\n", "x", " ", '"""', "\\n", "a\n"]
    for lang in ("js", "java", "go", "json"):
        for _ in range(300):
            text = "".join(rng.choice(bits) for _ in range(40))
            parts = syntax.pieces(text, 6)
            assert "".join(parts) == text
            s = [syntax.summary(lang, p, i == 0) for i, p in enumerate(parts)]
            left = s[0]
            for x in s[1:]:
                left = syntax.join(left, x)
            right = s[-1]
            for x in reversed(s[:-1]):
                right = syntax.join(x, right)
            whole = syntax.summary(lang, text, True)
            assert syntax.balanced(left) == syntax.balanced(right) == syntax.balanced(whole)


def test_judged(spark, monkeypatch):
    monkeypatch.setattr(syntax, "PIECE", 400)
    long = "package m\n" + "".join(f"func f{i}() int {{\n\treturn {i}\n}}\n" for i in range(60))
    rows = [(1, "d", "a.py", "code", "x = (\n"), (2, "d", "a.py", "code", "x = 1\n"), (3, "d", "b.go", "code", long), (4, "d", "b.go", "code", long + "}\n"), (5, "d", "c.css", "code", "{{{"), (6, "d", "a.py", "plain_text", "x = ("), (7, None, "e.json", "structured_data", None), (8, "d", None, "code", "("), (None, "d", "z.JSON", "structured_data", "[")]
    df = spark.createDataFrame(rows, "file_id bigint, directory string, file_path string, content_type string, text string").withColumns({"language": F.lit("clash"), "error": F.lit(1)})
    got = {r["file_id"]: (r["language"], r["error"] is None) for r in syntax.judged(df).collect()}
    assert got == {1: ("python", False), 2: ("python", True), 3: ("go", True), 4: ("go", False), 7: ("json", True), None: ("json", False)}
    rate = {(r["directory"], r["language"]): (r["files"], r["invalid"], r["rate"]) for r in syntax.rates(df).collect()}
    assert rate[("d", "python")] == (2, 1, 0.5) and rate[(None, "json")] == (1, 0, 0.0)
    assert syntax.judged(df.where("false")).count() == 0


def test_deep_nesting_does_not_crash():
    assert syntax.judge("js", "x = " + "(" * 20000 + "1" + ")" * 20000) is None
    assert syntax.judge("js", "x = " + "(" * 20000 + "1" + ")" * 19999)
    deep = "[" * 100_000
    assert syntax.judge("json", deep + "]" * 100_000) is None and syntax.judge("json", deep + "]" * 99_999) and syntax.judge("json", deep + "," + "]" * 100_000)
    with pytest.raises(grammars.Bad):
        grammars.check("js", "(" * 50)


def test_notices():
    tool = ["// Code generated by x v1. DO NOT EDIT.", "# @generated", "/* AUTOGENERATED FILE */", "// Fichier produit par x, ne pas modifier.", "# generated-by: x", "// <auto-generated> x </auto-generated>", "# Automatisch erzeugt von x 1.2, bitte nicht von Hand ändern.", "// Output of x (2026-01-01)", "# Produced from a.def with x - edit the definition instead."]
    project = ["// Copyright (c) 2017-2021 The X Authors. All rights reserved.", "/*! tarnish 6.12.8 */", "# @license x 1.2", "// SPDX-License-Identifier: Apache-2.0", "// Originally from the x project, release 1; upstream keeps it."]
    neither = ["// Do not edit the limits without asking the planner first.", "# An earlier version was generated by a script; it is kept by hand now.", 'HEADER = "@generated"', "// Copyright Harborline platform group, internal use only.", "x = 1", "// Both the index and the batch were copied from the amber archive by hand."]
    assert all(handwritten.TOOL_NOTICE.search("x\n" + t) for t in tool) and all(handwritten.PROJECT_NOTICE.search(t) for t in project)
    assert not any(handwritten.TOOL_NOTICE.search(t) or handwritten.PROJECT_NOTICE.search(t) for t in neither)


def _source(rng, n=25):
    w = ["window", "cursor", "planner", "record", "filter", "ledger", "bucket", "signal", "harbor"]
    return "".join(f"def {rng.choice(w)}_{rng.choice(w)}({rng.choice(w)}):\n    # {rng.choice(w)} the {rng.choice(w)} before {rng.choice(w)}\n    return {rng.choice(w)}.{rng.choice(w)}({rng.randrange(9999)}, '{rng.choice(w)} {rng.choice(w)} {rng.choice(w)}')\n\n" for _ in range(n))


def test_classify(spark):
    rng = random.Random(5)
    rows, want = [], set()

    def add(d, p, text, case, size=900):
        for i in range(0, len(text), size):
            rows.append((f"{d}{p}{i}", d, p, "code", i // size, text[i : i + size]))
        if case:
            want.add((d, p))

    for i in range(160):
        add(f"r{i % 12}", f"own{i}.py", _source(rng, rng.randrange(8, 30)), False)
    for i in range(60):
        body = "".join(f"_FIELD_{i}_{j} = base.Field(name='f{j}', number={j}, kind={rng.randrange(9)}, label=1, default=None)\n" for j in range(rng.randrange(15, 70)))
        add(f"r{i % 12}", f"gen{i}.py", ("# Code generated by x v1. DO NOT EDIT.\n" if i % 2 else "") + body, True)
    for i in range(12):
        add(f"r{i}", f"blob{i}.py", "W = [" + ", ".join(str(rng.random()) for _ in range(200)) + "]\n", True)
        add(f"r{i}", f"min{i}.js", "!function(t,e){" + "".join(f"t.{rng.choice('abc')}{rng.randrange(99)}=e?1:0;" for _ in range(99)) + "}(this);", True)
    lib = _source(random.Random(77), 20)
    for i in range(6):
        add(f"r{i}", "lib/copy.py", ("# @license x 1.2\n" if i == 0 else "") + lib, True)
    df = spark.createDataFrame(rows + rows[:40], "id string, directory string, file_path string, content_type string, chunk_index int, text string").withColumns({"label": F.lit("clash"), "score": F.lit(1)})
    extra = spark.createDataFrame([("n", None, "own.py", "code", 0, _source(rng)), ("m", "r1", None, "code", 0, "x"), ("k", "r1", "k.py", "code", 0, None), ("t", "r1", "t.md", "markdown", 0, "# Code generated by x")], "id string, directory string, file_path string, content_type string, chunk_index int, text string")
    df = df.unionByName(extra, allowMissingColumns=True)
    got = {(r["directory"], r["file_path"]) for r in handwritten.classify(df).where("found").collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 3
    assert handwritten.classify(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "#ifndef A_H\n#define A_H\nint f( ;\n#endif\n", "#ifndef A_H\n#define A_H\n<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n#endif\n", "#ifndef A_H\n#define A_H\nint f(void) { if (a { }\n#endif\n",
        "int a;\n#ifdef X\nint f( ;\n#endif\nint b;\n", "#ifndef A_H\n#define A_H\nint f( ;\n#ifdef X\nint a;\n#else\nint b;\n#endif\n#endif\n", "#ifdef X\nint a\n#elif defined(Y)\nint b\n#endif\n",
        "#if 1\nint a\n#else\nint a;\n#endif\n", "#ifdef X\nint a;\n#endif\n#ifndef X\nint b\n#endif\n", "#ifdef __cplusplus\nclass a {};\n#else\nint a\n#endif\n", "#ifdef X\n#else\n#else\n#endif\n",
    ],
)
def test_error_inside_a_conditional_group(text):
    assert syntax.parse("c", text) is not None


@pytest.mark.parametrize(
    "text",
    [
        "#ifndef A_H\n#define A_H\n#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#if defined(__cplusplus) && X\n}\n#endif\n#endif\n",
        "#if 0\nnot C at all, don't read it\n# Title\n#endif\nint a;\n", "#ifdef X\nint f(int a) {\n#else\nint f(void) {\n#endif\nreturn 1;\n}\n", "#ifdef X\nint f(int a) {\n#endif\n#ifndef X\nint f(void) {\n#endif\nreturn 1;\n}\n",
        "#ifdef X\nint a(\n#else\nint a;\n#endif\n#ifdef Y\nint b;\n#else\nint b(\n#endif\n", "#ifdef __cplusplus\ntemplate <class T> class A {};\n#endif\nint a;\n", "#ifdef X\nint a(\n#elif defined(Y)\nint a[\n#else\nint a;\n#endif\n",
    ],
)
def test_some_branch_of_every_group_is_valid(text):
    assert syntax.parse("c", text) is None


SAMPLES = {
    "python": ('x = """a(\n', 'b[""" + [1,\\\n 2][0]\n# (\n'),
    "js": ("let t = `a ${ {b: 1}.b } (\n", "${'`'}`;\nlet r = /[(]/;\n"), "ts": ("interface A {\n", "b: string /* { */\n}\n"), "java": ("class A { /* (\n", "*/ String s = \"{\"; }\n"),
    "go": ("package m\nvar s = `(\n", "{`\n"), "c": ("#define A(x \\\n", "{\nint a[2] = {1, ')'};\n"), "json": ('{"a": [1, "]",\n', "2]}\n"), "toml": ("a = [ # ]\n", "1, '[']\n[t]\n"),
    "xml": ("<a b='>'><!-- <c>\n", "--><d/></a>\n"),
}


@pytest.mark.parametrize("lang", sorted(set(syntax.LANGUAGES.values())))
def test_every_language_has_a_lexer_state_map(lang):
    a, b = SAMPLES[lang]
    maps = [syntax.summary(lang, a, True), syntax.summary(lang, b, False)]
    assert len(maps[1]) > 1
    whole = syntax.reduced(maps)
    assert syntax.balanced(whole) and (syntax.balanced(maps[0]) is (lang == "c"))
    assert syntax.judge(lang, a + b) is None or lang in ("java", "c")
    assert not syntax.balanced(syntax.join(whole, syntax.summary(lang, "</x>" if lang == "xml" else "}\n", False)))


@pytest.mark.parametrize("lang", ["python", "js", "go", "java", "json"])
def test_statements_of_pieces_agree_with_the_whole(lang, monkeypatch):
    monkeypatch.setattr(syntax, "GROUP", 60)
    unit = {"python": "@d\ndef f{i}(a):\n    return (a,\n  '(')\n\n", "js": "export function f{i}(a) {\n  return `${a}}`;\n}\n", "go": "func f{i}() {\n\tx := `(`\n\tg(x)\n}\n\n", "java": "class A{i} {\n  int x = 1;\n}\n", "json": '{"a{i}": [1, "]"]},\n'}[lang]
    body = "".join(unit.replace("{i}", str(i)) for i in range(30))
    text = {"go": "package m\n\n" + body, "json": "[" + body + "1]"}.get(lang, body)
    cuts = syntax.starts(lang, text)
    assert len(cuts) >= 29 and "".join(syntax.groups(text, cuts, 60)) == text and syntax.judge(lang, text) is None
    for i in range(0, len(text), 97):
        for extra in ("\x01", ",", "]"):
            broken = text[:i] + extra + text[i:]
            assert (syntax.judge(lang, broken) is None) == (syntax.parse(lang, broken) is None)


def test_a_long_file_is_parsed_in_several_tasks(spark, tmp_path):
    unit = "def f{}(a):\n    b = [a, (1, '{{')]\n    return b\n\n"
    text = "".join(unit.format(i) for i in range(110_000))[:5_000_000].rsplit("def ", 1)[0]
    parts = syntax.pieces(text)
    assert len(parts) > 10 and all(syntax.starts("python", p) for p in parts)
    half = text.index("def f50000(")
    doc = "[" + ",\n".join('{"a": [%d, "]"]}' % i for i in range(40_000)) + "]"
    rows = [(1, "d", "a.py", "code", text), (2, "d", "b.py", "code", text[:half] + "def (\n" + text[half:]), (3, "d", "c.py", "code", text + "x = (\n"), (4, "d", "d.json", "structured_data", doc), (5, "d", "e.json", "structured_data", doc[:-1] + ",]")]
    df = spark.createDataFrame(rows, "file_id bigint, directory string, file_path string, content_type string, text string")
    seen = spark.sparkContext.accumulator(0)
    got = {r["file_id"]: r["error"] is None for r in syntax.judged(df, seen).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert seen.value >= 30  # pieces of which whole statements were parsed where they lay
