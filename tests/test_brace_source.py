import json

import pytest
from spindrift.sources.brace_source import PARSERS

CASES = {
    ".ts": (
        """import React, { useState as us } from 'react';
import './style.css';
/** A store.
 * Of things. */
export class Store extends Base implements Lister {
  private items = [];
  async load(path: string, n = 2): Promise<void> {
    if (n > 1 && path) { this.items = await fetchAll(path); }
    for (const x of this.items) { console.log("if (x) {"); }
  }
}
interface Lister { list(): void; }
enum Color { Red }
export const twice = (x: number): number => { return helper(x) * 2; };
function helper(x) { return new Store(); } // if
""",
        {("class", "Store"), ("method", "load"), ("interface", "Lister"), ("class", "Color"), ("function", "twice"), ("function", "helper")},
        {"fetchAll", "console.log", "helper", "Store"}, {"react", "./style.css"}, ("load", 4), ("Store", "A store.\nOf things."),
    ),
    ".java": (
        """package a.b;
import java.util.List;
import static java.lang.Math.max;
/** Runs. */
public class Runner<T> extends Base implements Runnable {
  private int n;
  public Runner(int n) { this.n = n; }
  @Override
  public void run() throws Exception {
    for (int i = 0; i < n; i++) { if (i > 2 || n == 1) { helper.call(new Task(i)); } }
  }
}
interface Shape { double area(); }
""",
        {("class", "Runner<T>"), ("method", "Runner"), ("method", "run"), ("interface", "Shape")}, {"helper.call", "new Task"}, {"java.util.List", "java.lang.Math.max"}, ("run", 4), ("Runner<T>", "Runs."),
    ),
    ".go": (
        """package main
import (
	"fmt"
	str "strings"
)
// Server serves.
type Server struct { name string }
type Doer interface { Do() error }
func (s *Server) Run(port int) error {
	if port > 0 && s.name != "" { fmt.Println(s.name) }
	for i := range port { helper(i) }
	return nil
}
func helper(i int) { s := Server{name: "x"}; s.Run(1) }
""",
        {("class", "Server"), ("interface", "Doer"), ("method", "Run"), ("function", "helper")}, {"fmt.Println", "helper", "s.Run", "Server"}, {"fmt", "strings"}, ("Run", 4), ("Server", "Server serves."),
    ),
    ".rs": (
        """use std::collections::{HashMap, HashSet as Set};
/// A point.
pub struct Point { x: i32 }
trait Area { fn area(&self) -> f64; }
impl Area for Point {
    fn area(&self) -> f64 { if self.x > 0 { compute(self.x) } else { 0.0 } }
}
pub async fn main() { println!("{}", 1); let p = Point::new(); p.area(); }
""",
        {("class", "Point"), ("interface", "Area"), ("method", "area"), ("function", "main")}, {"compute", "println!", "Point::new", "p.area"}, {"std::collections"}, ("area", 2), ("Point", "A point."),
    ),
    ".c": (
        """#include <stdio.h>
#include "mine.h"
/* Adds. */
static int add(int a, int b) { if (a && b) return a + b; return helper(a); }
struct node { int v; };
typedef struct { int x; } point_t;
void walk(struct node *n) { while (n->v) { add(n->v, 1); } }
""",
        {("function", "add"), ("class", "node"), ("class", "point_t"), ("function", "walk")}, {"helper", "add"}, {"stdio.h", "mine.h"}, ("add", 3), ("add", "Adds."),
    ),
    ".cpp": (
        """#include <vector>
namespace app {
// A widget.
class Widget : public Base {
 public:
  Widget(int n) : n_(n) {}
  virtual ~Widget() {}
  int size() const { return n_ ? count(n_) : 0; }
};
int Widget::area(int w) { for (auto x : v) { if (x) total->add(x); } return app::scale(w); }
}
""",
        {("class", "Widget"), ("method", "Widget"), ("method", "~Widget"), ("method", "size"), ("method", "area")}, {"count", "total->add", "app::scale"}, {"vector"}, ("area", 3), ("Widget", "A widget."),
    ),
    ".cs": (
        """using System.Text;
namespace A {
  /// <summary>Keeps.</summary>
  public class Keeper : IKeep {
    public string Name { get; set; }
    public Keeper(int n) { count = n; }
    public async Task<int> Load(string path) { if (path == null || n > 1) { return Parse(path); } return store.Read(new Options()); }
  }
  interface IKeep { }
}
""",
        {("class", "Keeper"), ("method", "Keeper"), ("method", "Load"), ("method", "Name"), ("interface", "IKeep")}, {"Parse", "store.Read", "Options"}, {"System.Text"}, ("Load", 3), ("Keeper", "Keeps."),
    ),
    ".ps1": (
        """using module Tools
Import-Module Pester
. ./common.ps1
# Gets it.
function Get-Thing { param($a) if ($a -and $b) { Write-Output $a } foreach ($x in $y) { Invoke-It $x } }
class Car { [int] $n
  [void] Drive([int]$km) { $this.n = $km; $this.engine.Start($km) } }
""",
        {("function", "Get-Thing"), ("class", "Car"), ("method", "Drive")}, {"Write-Output", "Invoke-It", "$this.engine.Start"}, {"Tools", "Pester", "./common.ps1"}, ("Get-Thing", 4), ("Get-Thing", "Gets it."),
    ),
}


@pytest.mark.parametrize("suffix", list(CASES))
def test_language(suffix):
    source, symbols, calls, imports, (branchy, complexity), (documented, doc) = CASES[suffix]
    rows = PARSERS[suffix][1](source, "x" + suffix)
    found = [r for r in rows if r["tag"] == "symbol"]
    assert {(r["kind"], r["name"]) for r in found} == symbols
    assert calls <= {r["name"] for r in rows if r["tag"] == "call"}
    assert {r["return_type"] for r in rows if r["tag"] == "import"} == imports
    assert next(r for r in found if r["name"] == branchy and r["kind"] in ("method", "function") and r["complexity"] > 1)["complexity"] == complexity
    assert next(r for r in found if r["name"] == documented)["docstring"] == doc
    by_ordinal = {r["ordinal"]: r for r in rows}
    for r in found:
        assert r["line_start"] <= r["line_end"] and json.loads(r["params_json"]) is not None
        if r["kind"] == "method":
            assert by_ordinal[r["parent"]]["kind"] in ("class", "interface")


@pytest.mark.parametrize("suffix", list(PARSERS))
def test_broken_text_gives_rows_not_errors(suffix):
    for source in ("", "{{{", "}}}", "class", "func (", "/* open", "'open", "\x00"):
        assert isinstance(PARSERS[suffix][1](source, "x"), list)
