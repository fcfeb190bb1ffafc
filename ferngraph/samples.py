"""A source tree over the star schema, for the extraction and resolution queries.

Every supplier ``k`` has one small project in each language.  The tree is one SQL text for
every engine; what its files must give is stated beside them, statement by statement.
``~`` in a template stands for the supplier's key.
"""

from __future__ import annotations

import re

from ferngraph.functions.resolve import Config

CONFIG = Config(python_roots=["py"], go_modules=[("example.com/app", "go")], java_roots=["java/src"], csharp_projects=[("Acme", "cs")])

FILES: dict[str, str] = {
    "py/p~/__init__.py": "from .app import run\n",
    "py/p~/app.py": '''"""Docs: import fake
import fake2"""
import os, requests
from . import util  # import nothing
from .models import (
    A as B,
    C,
)
from p~.sub import deep
from ..outside import x
def run():
    from .sub.deep import late
''',
    "py/p~/util.py": 'x = "import os"\n',
    "py/p~/models.py": "class A:\n    pass\nclass C(A):\n    pass\n",
    "py/p~/sub/__init__.py": "",
    "py/p~/sub/deep.py": "late = 1\n",
    "ts/t~/app.ts": '''import React, { useState as s, type Props } from "react";
import {
  a,
} from "./lib";
import "./side.css";
export * from "./types";
// import x from "./no"
const m = require("./old");
const { q } = await import("./lazy");
''',
    "ts/t~/lib.ts": "export function a(x: number) {\n}\n",
    "ts/t~/types/index.ts": "export type T = number;\n",
    "ts/t~/old.js": "exports.z = 1;\n",
    "ts/t~/lazy.tsx": "export const q = 1;\n",
    "go/g~/main.go": '''package main

import (
    "fmt"
    u "example.com/app/g~/util"
    "github.com/x/y"
)
import "C"
func main() {}
''',
    "go/g~/util/aaa.go": "package util\n",
    "go/g~/util/util.go": "package util\n",
    "java/src/j~/App.java": """package j~;
import java.util.List;
import j~.core.Model;
import static j~.core.Tools.make;
import j~.core.*;
/* import j.No; */
public class App {
  // import late;
}
""",
    "java/src/j~/Peer.java": "package j~;\nclass Peer {}\n",
    "java/src/j~/core/Model.java": "package j~.core;\npublic class Model {\n}\n",
    "java/src/j~/core/Tools.java": "package j~.core;\npublic class Tools {\n}\n",
    "rs/r~/src/lib.rs": """mod util;
use std::collections::HashMap;
use crate::util::{self, helper as h, inner::Deep};
pub use serde::Serialize;
extern crate rand;
#[cfg(test)]
mod tests {}
""",
    "rs/r~/src/util.rs": "use super::Root;\npub fn helper(n: u8) {\n}\n",
    "rs/r~/src/util/inner.rs": "pub struct Deep;\n",
    "cs/C~/App.cs": """using System;
using Acme.C~.Models;
using static Acme.C~.Models.Tools;
using M = Acme.C~.Models.Item;
namespace Acme.C~;
public class App {
}
""",
    "cs/C~/Models/Item.cs": "namespace Acme.C~.Models;\npublic class Item {\n}\n",
    "cs/C~/Models/Tools.cs": "namespace Acme.C~.Models;\npublic class Tools {\n}\n",
}
LANGUAGE = {"py": "python", "ts": "typescript", "go": "go", "java": "java", "rs": "rust", "cs": "csharp"}

PY, TS, GO, JV, RS, CS = "py/p~/", "ts/t~/", "go/g~/", "java/src/j~/", "rs/r~/src/", "cs/C~/"
#: (path, specifier, import type, line, names)
FACTS = [
    (PY + "__init__.py", ".app", "relative", 1, "run"),
    (PY + "app.py", "os", "absolute", 3, ""),
    (PY + "app.py", "requests", "absolute", 3, ""),
    (PY + "app.py", ".", "relative", 4, "util"),
    (PY + "app.py", ".models", "relative", 5, "A"),
    (PY + "app.py", ".models", "relative", 5, "C"),
    (PY + "app.py", "p~.sub", "absolute", 9, "deep"),
    (PY + "app.py", "..outside", "relative", 10, "x"),
    (PY + "app.py", ".sub.deep", "relative", 12, "late"),
    (TS + "app.ts", "react", "absolute", 1, "React,useState,Props"),
    (TS + "app.ts", "./lib", "relative", 2, "a"),
    (TS + "app.ts", "./side.css", "relative", 5, ""),
    (TS + "app.ts", "./types", "relative", 6, "*"),
    (TS + "app.ts", "./old", "relative", 8, ""),
    (TS + "app.ts", "./lazy", "relative", 9, "q"),
    (GO + "main.go", "fmt", "absolute", 4, "fmt"),
    (GO + "main.go", "example.com/app/g~/util", "absolute", 5, "u"),
    (GO + "main.go", "github.com/x/y", "absolute", 6, "y"),
    (JV + "App.java", "java.util.List", "absolute", 2, "List"),
    (JV + "App.java", "j~.core.Model", "absolute", 3, "Model"),
    (JV + "App.java", "j~.core.Tools.make", "static", 4, "make"),
    (JV + "App.java", "j~.core.*", "absolute", 5, "*"),
    (JV + "App.java", "j~.*", "same_package", 0, ""),
    (JV + "Peer.java", "j~.*", "same_package", 0, ""),
    (JV + "core/Model.java", "j~.core.*", "same_package", 0, ""),
    (JV + "core/Tools.java", "j~.core.*", "same_package", 0, ""),
    (RS + "lib.rs", "mod:util", "module", 1, "util"),
    (RS + "lib.rs", "std::collections::HashMap", "absolute", 2, "HashMap"),
    (RS + "lib.rs", "crate::util", "relative", 3, "util"),
    (RS + "lib.rs", "crate::util::helper", "relative", 3, "helper"),
    (RS + "lib.rs", "crate::util::inner::Deep", "relative", 3, "Deep"),
    (RS + "lib.rs", "serde::Serialize", "absolute", 4, "Serialize"),
    (RS + "lib.rs", "extern:rand", "absolute", 5, "rand"),
    (RS + "util.rs", "super::Root", "relative", 1, "Root"),
    (CS + "App.cs", "System", "absolute", 1, "System"),
    (CS + "App.cs", "Acme.C~.Models", "absolute", 2, "Models"),
    (CS + "App.cs", "Acme.C~.Models.Tools", "static", 3, "Tools"),
    (CS + "App.cs", "Acme.C~.Models.Item", "alias", 4, "M"),
    (CS + "App.cs", "Acme.C~.*", "same_namespace", 0, ""),
    (CS + "Models/Item.cs", "Acme.C~.Models.*", "same_namespace", 0, ""),
    (CS + "Models/Tools.cs", "Acme.C~.Models.*", "same_namespace", 0, ""),
]
#: (source, target, specifier, method, line, name)
EDGES = [
    (PY + "__init__.py", PY + "app.py", ".app", "python", 1, "run"),
    (PY + "app.py", PY + "util.py", ".", "python", 4, "util"),
    (PY + "app.py", PY + "models.py", ".models", "python", 5, "A"),
    (PY + "app.py", PY + "models.py", ".models", "python", 5, "C"),
    (PY + "app.py", PY + "sub/deep.py", "p~.sub", "python", 9, "deep"),
    (PY + "app.py", PY + "sub/deep.py", ".sub.deep", "python", 12, "late"),
    (TS + "app.ts", TS + "lib.ts", "./lib", "typescript", 2, "a"),
    (TS + "app.ts", TS + "types/index.ts", "./types", "typescript", 6, "*"),
    (TS + "app.ts", TS + "old.js", "./old", "typescript", 8, None),
    (TS + "app.ts", TS + "lazy.tsx", "./lazy", "typescript", 9, "q"),
    (GO + "main.go", GO + "util/util.go", "example.com/app/g~/util", "go", 5, "u"),
    (JV + "App.java", JV + "core/Model.java", "j~.core.Model", "java", 3, "Model"),
    (JV + "App.java", JV + "core/Tools.java", "j~.core.Tools.make", "java", 4, "make"),
    (JV + "App.java", JV + "core/Model.java", "j~.core.*", "java", 5, "*"),
    (JV + "App.java", JV + "Peer.java", "j~.*", "same_package", 0, None),
    (JV + "Peer.java", JV + "App.java", "j~.*", "same_package", 0, None),
    (JV + "core/Model.java", JV + "core/Tools.java", "j~.core.*", "same_package", 0, None),
    (JV + "core/Tools.java", JV + "core/Model.java", "j~.core.*", "same_package", 0, None),
    (RS + "lib.rs", RS + "util.rs", "mod:util", "rust", 1, "util"),
    (RS + "lib.rs", RS + "util.rs", "crate::util", "rust", 3, "util"),
    (RS + "lib.rs", RS + "util.rs", "crate::util::helper", "rust", 3, "helper"),
    (RS + "lib.rs", RS + "util/inner.rs", "crate::util::inner::Deep", "rust", 3, "Deep"),
    (RS + "util.rs", RS + "lib.rs", "super::Root", "rust", 1, "Root"),
    (CS + "App.cs", CS + "Models/Item.cs", "Acme.C~.Models", "csharp", 2, "Models"),
    (CS + "App.cs", CS + "Models/Tools.cs", "Acme.C~.Models.Tools", "csharp", 3, "Tools"),
    (CS + "App.cs", CS + "Models/Item.cs", "Acme.C~.Models.Item", "csharp", 4, "M"),
    (CS + "Models/Item.cs", CS + "Models/Tools.cs", "Acme.C~.Models.*", "same_namespace", 0, None),
    (CS + "Models/Tools.cs", CS + "Models/Item.cs", "Acme.C~.Models.*", "same_namespace", 0, None),
]
#: (source, specifier, reason, line)
UNRESOLVED = [
    (PY + "app.py", "os", "stdlib", 3),
    (PY + "app.py", "requests", "external", 3),
    (PY + "app.py", "..outside", "not_found", 10),
    (TS + "app.ts", "react", "external", 1),
    (TS + "app.ts", "./side.css", "not_found", 5),
    (GO + "main.go", "fmt", "stdlib", 4),
    (GO + "main.go", "github.com/x/y", "external", 6),
    (JV + "App.java", "java.util.List", "stdlib", 2),
    (RS + "lib.rs", "std::collections::HashMap", "stdlib", 2),
    (RS + "lib.rs", "serde::Serialize", "third_party", 4),
    (RS + "lib.rs", "extern:rand", "extern_crate", 5),
    (CS + "App.cs", "System", "stdlib", 1),
    (CS + "App.cs", "Acme.C~.*", "no_siblings", 0),
]
#: (path, name, signature line)
DEFINITIONS = [
    (PY + "app.py", "run", "def run()"),
    (PY + "models.py", "A", "class A"),
    (PY + "models.py", "C", "class C(A)"),
    (PY + "sub/deep.py", "late", "late = 1"),
    (TS + "lib.ts", "a", "export function a(x: number)"),
    (TS + "lazy.tsx", "q", "export const q = 1;"),
    (JV + "core/Model.java", "Model", "public class Model"),
    (RS + "util.rs", "helper", "pub fn helper(n: u8)"),
    (RS + "util/inner.rs", "Deep", "pub struct Deep;"),
    (CS + "Models/Tools.cs", "Tools", "public class Tools"),
]


def literal(template: str | int | None, key: str = "s_suppkey") -> str:
    """SQL of a template: text with the key in place of ~; line ends and braces by number."""
    if template is None:
        return "CAST(NULL AS VARCHAR(100))"
    if isinstance(template, int):
        return f"CAST({template} AS BIGINT)"
    code = {"\n": "chr(10)", "{": "chr(123)", "}": "chr(125)", "~": f"CAST({key} AS VARCHAR(20))"}
    parts = [code.get(x) or "'" + x.replace("'", "''") + "'" for x in re.split("([\n{}~])", template) if x]
    return " || ".join(parts) or "''"


def rows(tuples: list[tuple], names: tuple[str, ...]) -> str:
    """One SELECT over all suppliers of the given template rows."""
    selects = [", ".join(f"{literal(v)} AS {n}" for v, n in zip(t, names, strict=True)) for t in tuples]
    return " UNION ALL ".join(f"SELECT {s} FROM {{supplier}}" for s in selects)


def of_language(tuples: list[tuple], language: str) -> list[tuple]:
    return [t for t in tuples if LANGUAGE[t[0].split("/")[0]] == language]


TREE = rows(list(FILES.items()), ("path", "text"))
