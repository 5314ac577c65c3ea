"""Outlines of languages with braces."""

import pytest
from condense.operators import braces
from condense.operators.outlines import PARSERS

JS = """import React, { useState as state } from 'react';
import './style.css'
// function no() {
const re = /[{]"/g, s = "}{", t = `a ${b} {`;
export async function load(url, { retry = 3 } = {}) {
  if (retry) {
    return fetch(url);
  }
}
const add = (a, b) => {
  return a + b;
};
const options = {
  run() {
    return 1;
  },
};
var old = function () {
  x();
};
class Store extends Base {
  #secret() {
    return 2;
  }
  constructor(a) {
    super(a);
    this.cb = () => {
      y();
    };
  }
  static async get(k) {
    return this.map[k];
  }
}
if (x) {
  function hidden() {
    z();
  }
}
items.forEach(function (i) {
  use(i);
});
"""
TS = """export interface Shape {
  area(): number;
}
export function area(s: Shape): { w: number } {
  return s.area();
}
namespace geo {
  export const scale = async <T>(x: T): Promise<T> => {
    return x;
  };
}
@Component({ selector: 'a' })
export abstract class View<T> extends Base<T> implements Shape {
  private cache: Map<string, T> = new Map();
  protected draw(x: number, y = { a: 1 }): void {
    paint(x);
  }
}
"""
GO = """package main

import (
\t"fmt"
\tstr "strings"
)

type T struct {
\tn int
}

func (t *T) Name(a map[string]int) (string, error) {
\tgo func() {
\t\tfmt.Println("}")
\t}()
\treturn `{`, nil
}

var handler = func(x int) int {
\treturn x
}

func main() { fmt.Println('{') }
"""
JAVA = """package a.b;
import java.util.List;
import java.util.Map;

public class Box<T> extends Base implements One, Two {
    private final int n = 1;
    @Override
    public List<T> items(Map<String, T> m) throws IOException {
        for (T t : m.values()) {
            add(t);
        }
        return null;
    }
    Box() {
        this.n = '{';
    }
    class Inner {
        void deep() {
            x();
        }
    }
}
enum E { A { void f() {
 } } }
"""
RUST = """use std::fmt::{self, Display};

pub struct P<'a> {
    name: &'a str,
}

impl<'a> Display for P<'a> {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {
        let c = '{';
        write!(f, "{}", self.name)
    }
}

pub trait Area {
    fn area(&self) -> f64;
    fn twice(&self) -> f64 {
        2.0 * self.area()
    }
}

pub fn main() {
    run(r#"}"#);
}
"""
CSHARP = """using System;
using System.Collections.Generic;

namespace A.B
{
    public class C : Base, IThing
    {
        public int N { get; set; }
        public C(int n) : base(n)
        {
            N = n;
        }
        private static async Task<int> Run<T>(List<T> xs) where T : class
        {
            return await Go(@"}");
        }
    }
}
"""


def kept(source, language):
    gone = braces.body_lines(source, language)
    return [x for n, x in enumerate(source.split("\n"), 1) if n not in gone]


def dropped(source, language):
    return [source.split("\n")[n - 1].strip() for n in sorted(braces.body_lines(source, language))]


def names(source, language):
    return [(s["name"], s["kind"], s["is_public"]) for s in braces.symbols(source, language)]


def test_javascript():
    assert dropped(JS, "javascript") == ["if (retry) {", "return fetch(url);", "}", "return a + b;", "x();", "return 2;", "super(a);", "this.cb = () => {", "y();", "};", "return this.map[k];"]
    assert names(JS, "javascript") == [("load", "function", True), ("add", "function", False), ("old", "function", False), ("Store", "class", False), ("#secret", "method", False), ("constructor", "method", True), ("get", "method", True)]
    edges = braces.relationships(JS, "javascript")
    assert [(e["target"], e["qualifier"], e["origin"]) for e in edges if e["kind"] == "import"] == [("react", "React", "React"), ("react", "state", "useState"), ("./style.css", "css", "css")]
    assert [(e["source"], e["target"]) for e in edges if e["kind"] == "inherits"] == [("Store", "Base")]
    assert ("load", "fetch") in {(e["source"], e["target"]) for e in edges if e["kind"] == "calls"}


def test_typescript():
    assert dropped(TS, "typescript") == ["return s.area();", "return x;", "paint(x);"]
    assert names(TS, "typescript") == [("area", "function", True), ("scale", "function", True), ("View", "class", True), ("draw", "method", False)]


def test_go():
    assert dropped(GO, "go") == ["go func() {", 'fmt.Println("}")', "}()", "return `{`, nil", "return x"]
    assert names(GO, "go") == [("Name", "function", True), ("handler", "function", False), ("main", "function", False)]
    assert [s["is_entry_point"] for s in braces.symbols(GO, "go")] == [False, False, True]
    assert [e["target"] for e in braces.relationships(GO, "go") if e["kind"] == "import"] == ["fmt", "strings"]


def test_java():
    assert dropped(JAVA, "java") == ["for (T t : m.values()) {", "add(t);", "}", "return null;", "this.n = '{';"]
    assert names(JAVA, "java") == [("Box", "class", True), ("items", "method", True), ("Box", "method", False)]
    assert [(e["kind"], e["target"]) for e in braces.relationships(JAVA, "java")][:5] == [("import", "java.util.List"), ("import", "java.util.Map"), ("inherits", "Base"), ("inherits", "One"), ("inherits", "Two")]


def test_rust():
    assert dropped(RUST, "rust") == ["let c = '{';", 'write!(f, "{}", self.name)', "2.0 * self.area()", 'run(r#"}"#);']
    assert [n for n, k, _ in names(RUST, "rust") if k != "class"] == ["fmt", "twice", "main"]


def test_csharp():
    assert dropped(CSHARP, "csharp") == ["N = n;", 'return await Go(@"}");']
    assert names(CSHARP, "csharp") == [("C", "class", True), ("C", "method", True), ("Run", "method", False)]


@pytest.mark.parametrize("language", list(braces.LANGUAGES))
def test_broken_texts_have_no_outline(language):
    with pytest.raises(ValueError):
        braces.body_lines("function f() {\n  (}\n", language)
    assert braces.body_lines("", language) == set() and braces.symbols("}".replace("}", ""), language) == []


def test_import_blocks():
    source = "\n".join(f"import {{ someExportedName{i}, anotherExportedName{i} }} from '@scope/package';" for i in range(12)) + "\n\nlet x = 1;\n"
    block = PARSERS["typescript"].import_blocks(source)[0]
    assert (block["start"], block["end"]) == (1, 12) and block["text"].startswith("Imports (24)\n\n@scope/package:\n- someExportedName0\n")
    java = "\n".join(f"import com.example.deeply.nested.Klass{i};" for i in range(5))
    assert PARSERS["java"].import_blocks(java)[0]["text"] == "Imports (5)\n\ncom.example.deeply.nested:\n" + "\n".join(f"- Klass{i}" for i in range(5))
    assert PARSERS["go"].import_blocks(GO) == []


def test_stage(spark):
    from condense.operators.lines import render, split
    from condense.operators.stages import STAGES

    docs = spark.createDataFrame([(1, GO), (2, "func f() {")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in render(STAGES["code_ast_summarize"](language="go").apply(split(docs))).collect()}
    assert out == {1: "\n".join(kept(GO, "go")), 2: "func f() {"}
