from ferngraph.functions import extract as X


def test_python_statements():
    text = '''"""doc
import not_me
"""
import os, a.b as ab  # import c
from . import x, y as z
from ..pkg.mod import (
    One,  # first
    Two as T,
)
from long \\
    import name
s = "# import q"; t = \'\'\'
import inside
\'\'\'
if True:
    import lazy
'''
    got = list(X.python(text))
    assert got == [
        ("os", "absolute", 4, []),
        ("a.b", "absolute", 4, ["b"]),
        (".", "relative", 5, ["x"]),
        (".", "relative", 5, ["y"]),
        ("..pkg.mod", "relative", 6, ["One"]),
        ("..pkg.mod", "relative", 6, ["Two"]),
        ("long", "absolute", 10, ["name"]),
        ("lazy", "absolute", 16, []),
    ]


def test_typescript_statements():
    text = """import D, { A as B, type C } from './x';
import * as N from "pkg/sub";
import './side';
/* import z from 'no' */
export * from '../all';
export { q } from '@s/p';
const { u, v: w } = require('r');
const m = await import(`./dyn`);
import {
  One,
  Two,
} from 'multi';
"""
    got = [(s, n) for s, _, _, n in X.typescript(text)]
    assert got == [("./x", ["D", "A", "C"]), ("pkg/sub", ["*"]), ("./side", []), ("../all", ["*"]), ("@s/p", ["q"]), ("r", ["u", "v"]), ("./dyn", []), ("multi", ["One", "Two"])]


def test_go_java_csharp():
    assert list(X.go('package p\nimport "fmt"\nimport (\n  al "x.y/z"\n  // "no"\n  "C"\n  _ "x.y/w"\n)\nfunc f() { import "late" }\n')) == [
        ("fmt", "absolute", 2, ["fmt"]),
        ("x.y/z", "absolute", 4, ["al"]),
        ("x.y/w", "absolute", 7, ["_"]),
    ]
    assert list(X.java("package a.b;\nimport java.util.*;\nimport static c.D.e;\npublic class K { }\nimport no.X;")) == [
        ("java.util.*", "absolute", 2, ["*"]),
        ("c.D.e", "static", 3, ["e"]),
        ("a.b.*", "same_package", 0, []),
    ]
    assert list(X.csharp("using A.B;\nglobal using static C.D;\nusing E = F.G;\nnamespace N.M;\npublic class Z {}\nusing No;")) == [
        ("A.B", "absolute", 1, ["B"]),
        ("C.D", "static", 2, ["D"]),
        ("F.G", "alias", 3, ["E"]),
        ("N.M.*", "same_namespace", 0, []),
    ]


def test_rust_use_trees():
    text = "use crate::a::{b, c::{self, D as E}, *};\nmod m;\npub mod inline { }\nextern crate q;\nuse std::io;\n"
    assert list(X.rust(text)) == [
        ("crate::a::b", "relative", 1, ["b"]),
        ("crate::a::c", "relative", 1, ["c"]),
        ("crate::a::c::D", "relative", 1, ["D"]),
        ("crate::a::*", "relative", 1, ["*"]),
        ("mod:m", "module", 2, ["m"]),
        ("extern:q", "absolute", 4, ["q"]),
        ("std::io", "absolute", 5, ["io"]),
    ]


def test_definitions():
    assert X.definitions("python", "class A(B):\n    def f(self): pass\n", ["f", "A", "no"]) == ["def f(self): pass", "class A(B)"]
    assert X.definitions("typescript", "export interface P<T> {\n", ["P"]) == ["export interface P<T>"]
    assert X.definitions("rust", "pub fn go(x: u8) -> u8 {\n", ["go"]) == ["pub fn go(x: u8) -> u8"]
    assert len(X.definitions("go", "func F(" + "a int, " * 40 + ") {", ["F"])[0]) == 123


def test_empty_texts():
    for f in X.EXTRACTORS.values():
        assert list(f("")) == []
