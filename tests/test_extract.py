"""Extraction per language on small sources, and as a table function."""

import pytest

from codeloom.functions.masking import Layout, mask
from codeloom.sources.extract import dependencies_of, extract, extract_file, symbols_of

TS = """import { A } from './a';
import React from "react";
export class Box extends Base {
  private size: number = 1;
  public open(id: string): boolean {
    if (!id) { // not { this
      for (const x of y) { return false; }
    }
    return "}" === id;
  }
}
export const LIMIT = 10;
export const go = async (x: number) => {
  return x;
};
export function help(): string {
  return `{${1}`;
}
export interface Shape { a: string; }
const z = require('fs');
"""
PHP = """<?php
namespace App\\Http;
use Illuminate\\Support\\Str;
use App\\Models\\{Order, User as U};
final class OrderController extends Controller {
    const MAX = 5;
    protected string $key = 'a';
    public function index(Request $r) {
        foreach ($a as $b) { if ($b) { return 1; } }
    }
    private static function hide() {}
}
function loose() { return 1; }
"""
GO = """package pay

import (
	"fmt"
	m "example.com/app/models"
)

const (
	StatusOpen = iota
	statusShut
)

type Box struct {
	ID string
}

type Port int

func (b *Box) Open(x string) error {
	if x == "}" {
		return nil
	}
	return nil
}

func helper() {}
"""
PY = """import os
from .models import Order
LIMIT = 3

class Box(Base):
    size = 1

    @property
    def ready(self):
        return True

    async def _open(self, x):
        for i in x:
            if i:
                return i

        def inner():
            pass

def loose():
    pass
"""


def names(language, source, path="f"):
    status, _, symbols, dependencies = extract_file(path, language, source)
    return status, {(s["name"], s["kind"]): s for s in symbols}, {d["target"]: d["is_external"] for d in dependencies}


def test_typescript():
    status, symbols, needs = names("typescript", TS)
    assert status == "parsed" and needs == {"./a": False, "react": True, "fs": True}
    assert {k for k in symbols} >= {("Box", "class"), ("Box::size", "property"), ("Box::open", "method"), ("LIMIT", "constant"), ("go", "function"), ("help", "function"), ("Shape", "interface")}
    method = symbols["Box::open", "method"]
    assert (method["line_start"], method["line_end"], method["nesting_depth"], method["visibility"]) == (5, 10, 3, "public")
    assert symbols["Box", "class"]["line_end"] == 11 and symbols["Box::size", "property"]["visibility"] == "private"


def test_php():
    status, symbols, needs = names("php", PHP)
    box = "App\\Http\\OrderController"
    assert status == "parsed" and needs == {"Illuminate\\Support\\Str": True, "App\\Models\\Order": False, "App\\Models\\User": False}
    assert {(box, "class"), (f"{box}::MAX", "property"), (f"{box}::$key", "property"), (f"{box}::index", "method"), (f"{box}::hide", "method"), ("App\\Http\\loose", "function")} <= set(symbols)
    assert symbols[f"{box}::index", "method"]["nesting_depth"] == 3 and symbols[f"{box}::hide", "method"]["visibility"] == "private"


def test_go():
    status, symbols, needs = names("go", GO)
    assert status == "parsed" and needs == {"fmt": True, "example.com/app/models": True}
    assert {("Box", "struct"), ("Port", "type"), ("Open", "method"), ("helper", "function"), ("StatusOpen", "constant"), ("statusShut", "constant")} <= set(symbols)
    assert (symbols["Open", "method"]["line_start"], symbols["Open", "method"]["line_end"]) == (19, 24)
    assert symbols["helper", "function"]["visibility"] == "private"


def test_python():
    status, symbols, needs = names("python", PY)
    assert status == "parsed" and needs == {"os": True, ".models": False}
    assert set(symbols) == {("LIMIT", "property"), ("Box", "class"), ("Box::size", "property"), ("Box::ready", "property"), ("Box::_open", "method"), ("Box::_open::inner", "function"), ("loose", "function")}
    assert symbols["Box::_open", "method"]["nesting_depth"] == 3 and symbols["Box::_open", "method"]["visibility"] == "protected"
    assert symbols["Box::ready", "property"]["signature"].startswith("@property")
    assert names("python", "def (")[0] == "degraded"


@pytest.mark.parametrize(
    ("language", "source", "want", "needs"),
    [
        ("rust", "use crate::a::B;\nuse serde::De;\npub struct S { x: i32 }\nimpl S {\n  pub fn go(&self) { if x { } }\n}\ntrait T { fn f(&self); }\npub enum E { A }\nfn main() {}", {("S", "struct"), ("S::go", "method"), ("T", "interface"), ("E", "enum"), ("main", "function")}, {"crate::a::B": False, "serde::De": True}),
        ("java", "import java.util.List;\npublic class A {\n  private int x;\n  public List<String> run(int a) throws E {\n    return null;\n  }\n  interface I {}\n}", {("A", "class"), ("A.run", "method"), ("I", "interface")}, {"java.util.List": True}),
        ("csharp", "using System.Text;\nnamespace N {\n  public class A {\n    public async Task<int> Run(int a) { while (x) { } return 1; }\n    public int F() => 3;\n  }\n  enum E { A }\n}", {("A", "class"), ("A.Run", "method"), ("A.F", "method"), ("E", "enum")}, {"System.Text": True}),
        ("ruby", "require 'json'\nrequire_relative 'a'\nmodule M\n  class C\n    def self.make; new; end\n    def go(x)\n      if x\n        1\n      end\n    end\n    private\n    def hide\n    end\n  end\nend\ndef loose\nend", {("M", "interface"), ("M::C", "class"), ("M::C.make", "method"), ("M::C#go", "method"), ("M::C#hide", "method"), ("loose", "function")}, {"json": True, "a": False}),
        ("blade", "@extends('layouts.app')\n@section('body')\n<x-alert id=\"top\"/>", {("a.b", "view"), ("view:a.b", "view"), ("section:body", "property"), ("#top", "property")}, {"layouts.app": False, "x-alert": False}),
        ("frontend", "<template/>\n<script setup>\nimport A from './A.vue';\nfunction go() {}\n</script>", {("b", "component"), ("go", "function")}, {"./A.vue": False}),
    ],
)
def test_other_languages(language, source, want, needs):
    status, symbols, found = names(language, source, "resources/views/a/b.blade.php" if language == "blade" else "x/b.vue")
    assert status == "parsed" and want <= set(symbols) and found == needs


def test_masking_keeps_offsets():
    source = "a /* { */ b // }\n'{' \"\\\"}\" `x\n{`"
    masked = mask(source, ("//", "/*", "'", '"', "`"))
    assert len(masked) == len(source) and "{" not in masked and masked.count("\n") == 2
    assert not Layout("{ {").balanced and Layout("{a{b}}").depth(3) == 2


def test_table_function(spark):
    rows = [("a.py", "python", "def f(:"), ("b.ts", "typescript", "export class X {}"), ("c.kt", "kotlin", "class K"), ("d.py", "python", None), ("e.py", "python", "import os\nX = 1")]
    out = extract(spark.createDataFrame(rows, "path string, language string, content string"))
    assert {r.path: r.status for r in out.collect()} == {"a.py": "degraded", "b.ts": "parsed", "c.kt": "unsupported", "d.py": "unsupported", "e.py": "parsed"}
    assert {(r.path, r.name) for r in symbols_of(out).collect()} == {("b.ts", "X"), ("e.py", "X")}
    assert [(r.source, r.target) for r in dependencies_of(out).collect()] == [("e.py", "os")]


def test_long_signatures_and_imports_stay_whole():
    many = ", ".join(f"argument{i}: Type{i}" for i in range(60))
    symbols, needs = extract_file("f.ts", "typescript", f"import {{ {many.replace(':', ' as')} }} from './types';\nexport function wide({many}) {{\n  return 1;\n}}\n")[2:]
    assert symbols[0]["signature"].endswith("argument59: Type59)") and "argument59 as Type59 } from './types'" in needs[0]["statement"]
