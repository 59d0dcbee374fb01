"""Sources in each language with what a reader must find in them; {id} stands for a document's number.

Expected rows are (kind, qualified name, line, parameters, calls), written down from the sources.
"""

from __future__ import annotations

PYTHON = '''import os
from .util import load as l, save
class A{id}(Base):
    """A thing."""
    kind = 1
    def __init__(self, x: int, *rest, flag=True, **more) -> None:
        self.x = load(x)
    @staticmethod
    def make(): return A(1)
async def _go(n: int = 1):
    if n: import json
    await run(n)
class B:
    def make(self): return map(lambda y: y, [])
    def __secret(self): pass
LIMIT = 3
'''

RUBY = """require 'set'
class H{id}
  def go
  end
end
module M
  def self_made
"""

BROKEN = """import os
def good{id}(a):
    return call(a)
class B:
    def m(self): return go()
def bad(:
    x = (
def after(): return last()
"""

JAVA = """package a.b;
import java.util.*;
import static java.lang.Math.max;
@Controller(path = "{")
public class A{id}<T extends Comparable<T>> extends Base<T> implements I, J<String> {
  private final Map<String, List<int[]>> held = new HashMap<>();
  int x = compute(1), y;
  static { start(); }
  A{id}(int x) { this.x = x; }
  public A{id}() { this(1); }
  @GetMapping("/x") public void go(@RequestParam("id") String id, final int... rest) throws IOException, E { run(id); }
  @Override public void end() { stop("}"); }
  <U extends Comparable<U>> U max(List<? extends U> all) { return first(all); }
  Map<String, List<Integer>> deep() { return null; }
  int[] array(int a[], char c) { return c == '{' ? made() : null; }
  abstract void later(int a);
  Runnable r = () -> { later(2); };
  Runnable s = new Runnable() { public void run() { x(); } };
  enum Kind { ONE { void f() {} }, TWO(2); Kind(int n) {} String show() { return name(); } }
  interface Inner { void must(); default int may() { return 1; } }
  record Point(int x, int y) { Point { check(x); } int sum() { return x + y; } }
  @interface Note { String value() default "{"; }
}
"""

SCRIPT = """import React, { useState as s, type T } from 'react';
import './side.css';
const fs = require("fs"), p = a / b / c;
/* class Not { no() {} } */ // function not() {
export default class A{id} extends B.C {
  static #count = 0;
  state = { a: 1 };
  handle = async (e) => { this.go(e); };
  re() { return /[{"]/.test(x) && x / 2; }
  go(a = f({ b: 1 }), { c, d } = {}, ...rest) { run(a); }
  get size() { return one(); }
  static async *walk() { yield* two(); }
  'quoted name'() {}
  async load() { return `a ${inner({ x: `${deep()}` })} }`; }
}
class B { only() {} }
describe("x", function() { it("y", () => { check(); }); });
const add = (a, b = (1 + 2)) => a + plus(b);
const one = x => x, two = 2;
let late = async function named(q) { fetchIt(q); };
async function top({ a, b }) { function nested() { low(); } return nested(); }
function* gen() {}
export const api = { get(url) { return call(url); }, async post(u) {}, plain: 1 };
module.exports = { add };
"""

TYPED = """import type { X } from "./x";
export interface Shape extends Base<number> { area(): number; }
export enum Kind { A = 'a', B }
type F = (a: number) => { b: string };
@Component({ selector: 'x' })
export abstract class P{id}<T extends object = {}> extends Q<T> implements I {
  @Input() private readonly name: string = "}";
  constructor(@Inject(X) private x: X, public readonly y?: Map<string, { z: number }>) { super(); }
  async get(id: string): Promise<{ a: number; b: string[] }> { return this.http.get<User>(id); }
  private cb = (x: number): string => show(x);
  over(a: string): void;
  over(a: any): void { pick(a); }
  abstract must(): void;
  static is(x: unknown): x is string { return test(x); }
  fn(cb: (a: number) => void = () => {}): Array<() => void> { return []; }
}
export function area<T>(s: Shape, k: Kind = Kind.A): { w: number } { return calc<T>(s); }
export const f = async <T,>(x: T): Promise<void> => { await g(x); };
declare function outer(a: string): void;
"""

GO = """package main
import (
  "fmt"
  m "math/big" // "not/this"
)
import "os"
type S{id} struct { a map[string]interface{} }
type (
  T[K comparable, V any] struct { f func(int) error }
  I interface { Do(x int) error }
)
type Alias = S
func (s *S{id}) Get(a, b int, opt ...string) interface{} { return load(a) }
func (t T[K, V]) Put(k K) (map[string]struct{}, error) { return keep(k), nil }
func New[T any](x T, f func(a int) (int, error)) *S { f := func() { inner() }; return make1(x) }
func Chan() <-chan struct{} { return open() }
func Fn() func(int) error { return nil }
func raw() string { s := `{ " `; return fmt.Sprint(s, '}', '"') }
func external(x int) int
func main() {
  run()
}
"""

RUST = """use std::{fs, io::Read};
use crate::a::b as c;
pub mod inner { pub fn deep<'a>(x: &'a str) -> &'a str { x } }
#[derive(Debug, Clone)]
pub struct P{id}<T> where T: Copy { a: [u8; 3] }
pub(crate) enum E { A(u8), B { c: char } }
trait T: Base { fn d(&self) { low() } fn need(&self) -> Vec<u8>; const N: usize = 1; }
impl<T: Copy> P{id}<T> { pub async fn new(mut a: u8, f: impl Fn(u8) -> u8) -> Result<P<T>, Box<dyn Error>> where T: Sized { make('{', a) } }
impl<'a, T> Show<T> for inner::Q<'a> { fn show(&self) -> [u8; 3] { other(r#"}"#) } }
impl Drop for P{id}<u8> { fn drop(&mut self) { let x: char = '\\''; end(x) } }
const fn three() -> u8 { 3 }
pub unsafe extern "C" fn raw(p: *const u8) { println!("{}", get(p)) }
macro_rules! m { ($x:expr) => { fn not() {} } }
fn main() { fn nested() { under() } P::<u8>::new(1, |x| x); }
"""

C = """#include <vector>
#include "own.h"
#define LIMIT 3
#define SQUARE(x) ((x) * \\
  (x)) {
namespace a::b {
template <typename T, int N = 3> class V : public W<T>, private virtual X { public:
  V(int x) : W<T>{x}, a(x) { init(); }
  explicit V() = default;
  ~V() { free1(); }
  virtual int size() const noexcept override { return one(); }
  bool operator==(const V& o) const { return eq(o); }
  virtual void pure() = 0;
  struct In { int deep() { return 1; } };
  static constexpr int n[] = {1, 2};
};
template <typename T> V<T>::V(T t) : x(t) { made(t); }
int V<int>::run(int c, char* argv[]) { return go(c); }
}
extern "C" { int g(void (*cb)(int), int a[3]) { cb(1); return h(a); } }
typedef struct Node { int a; struct Node* next; } Node;
enum class Color : int { RED, BLUE };
struct Node make_node(void) { struct Node n = { f(1) }; return n; }
unsigned long long int wide(const std::map<std::string, std::vector<int>>& m = {}, ...) { return m.size(); }
auto trail(int a) -> decltype(a) { return a; }
int proto(int a);
static int (*table[])(int) = { run1, run2 };
int main{id}(int argc, char** argv)
{
  if (argc) { return run("{"); }
}
"""

#: file name, source, expected rows.
SAMPLES: dict[str, tuple[str, str, list[tuple]]] = {
    "p02_python": ("a.py", PYTHON, [
        ("module", "src/{id}/a.py", 1, "", ""), ("import", "os", 1, "", ""), ("import", ".util", 2, "", ""), ("class", "A{id}", 3, "__init__,make", ""), ("function", "A{id}.__init__", 6, "self,x,*rest,flag,**more", "load"), ("function", "A{id}.make", 9, "", "A"),
        ("function", "_go", 10, "n", "run"), ("import", "json", 11, "", ""), ("class", "B", 13, "make,__secret", ""), ("function", "B.make", 14, "self", "map"), ("function", "lambda_line_14", 14, "y", ""), ("function", "B.__secret", 15, "self", ""),
    ]),
    "p03_javascript": ("b.js", SCRIPT, [
        ("import", "react", 1, "", ""), ("import", "./side.css", 2, "", ""), ("import", "fs", 3, "", ""), ("class", "A{id}", 5, "", ""), ("function", "A{id}.handle", 8, "e", "go"), ("function", "A{id}.re", 9, "", "test"), ("function", "A{id}.go", 10, "a,{ c, d },...rest", "run"),
        ("function", "A{id}.size", 11, "", "one"), ("function", "A{id}.walk", 12, "", "two"), ("function", "A{id}.quoted name", 13, "", ""), ("function", "A{id}.load", 14, "", "inner,deep"), ("class", "B", 16, "", ""), ("function", "B.only", 16, "", ""),
        ("function", "add", 18, "a,b", "plus"), ("function", "one", 19, "x", ""), ("function", "late", 20, "q", "fetchIt"), ("function", "top", 21, "{ a, b }", "low,nested"), ("function", "nested", 21, "", "low"), ("function", "gen", 22, "", ""),
        ("function", "get", 23, "url", "call"), ("function", "post", 23, "u", ""),
    ]),
    "p04_typescript": ("c.ts", TYPED, [
        ("import", "./x", 1, "", ""), ("class", "Shape", 2, "", ""), ("class", "Kind", 3, "", ""), ("class", "P{id}", 6, "", ""), ("function", "P{id}.constructor", 8, "x,y", "super"), ("function", "P{id}.get", 9, "id", "get"), ("function", "P{id}.cb", 10, "x", "show"),
        ("function", "P{id}.over", 12, "a", "pick"), ("function", "P{id}.must", 13, "", ""), ("function", "P{id}.is", 14, "x", "test"), ("function", "P{id}.fn", 15, "cb", ""), ("function", "area", 17, "s,k", "calc"), ("function", "f", 18, "x", "g"),
    ]),
    "p05_java": ("D.java", JAVA, [
        ("import", "java.util.*", 2, "", ""), ("import", "java.lang.Math.max", 3, "", ""), ("class", "A{id}", 5, "", ""), ("function", "A{id}.A{id}", 9, "x", ""), ("function", "A{id}.A{id}", 10, "", "this"), ("function", "A{id}.go", 11, "id,rest", "run"),
        ("function", "A{id}.end", 12, "", "stop"), ("function", "A{id}.max", 13, "all", "first"), ("function", "A{id}.deep", 14, "", ""), ("function", "A{id}.array", 15, "a,c", "made"), ("function", "A{id}.later", 16, "a", ""), ("class", "A{id}.Kind", 19, "", ""),
        ("function", "A{id}.Kind.Kind", 19, "n", ""), ("function", "A{id}.Kind.show", 19, "", "name"), ("class", "A{id}.Inner", 20, "", ""), ("function", "A{id}.Inner.must", 20, "", ""), ("function", "A{id}.Inner.may", 20, "", ""), ("class", "A{id}.Point", 21, "", ""),
        ("function", "A{id}.Point.Point", 21, "", "check"), ("function", "A{id}.Point.sum", 21, "", ""), ("class", "A{id}.Note", 22, "", ""), ("function", "A{id}.Note.value", 22, "", ""),
    ]),
    "p06_go": ("e.go", GO, [
        ("import", "fmt", 3, "", ""), ("import", "math/big", 4, "", ""), ("import", "os", 6, "", ""), ("class", "S{id}", 7, "", ""), ("class", "T", 9, "", ""), ("class", "I", 10, "", ""), ("function", "S{id}.Get", 13, "a,b,opt", "load"), ("function", "T.Put", 14, "k", "keep"),
        ("function", "New", 15, "x,f", "inner,make1"), ("function", "Chan", 16, "", "open"), ("function", "Fn", 17, "", ""), ("function", "raw", 18, "", "Sprint"), ("function", "external", 19, "x", ""), ("function", "main", 20, "", "run"),
    ]),
    "p07_rust": ("f.rs", RUST, [
        ("import", "std", 1, "", ""), ("import", "crate::a::b", 2, "", ""), ("function", "deep", 3, "x", ""), ("class", "P{id}", 5, "", ""), ("class", "E", 6, "", ""), ("class", "T", 7, "", ""), ("function", "T.d", 7, "&self", "low"), ("function", "T.need", 7, "&self", ""),
        ("function", "P{id}.new", 8, "a,f", "make"), ("function", "Q.show", 9, "&self", "other"), ("function", "P{id}.drop", 10, "&mut self", "end"), ("function", "three", 11, "", ""), ("function", "raw", 12, "p", "get"), ("function", "main", 14, "", "under,new"),
        ("function", "nested", 14, "", "under"),
    ]),
    "p08_cpp": ("g.cpp", C, [
        ("module", "src/{id}/g.cpp", 1, "", ""), ("import", "vector", 1, "", ""), ("import", "own.h", 2, "", ""), ("class", "V", 7, "", ""), ("function", "V.V", 8, "x", "init"), ("function", "V.~V", 10, "", "free1"), ("function", "V.size", 11, "", "one"),
        ("function", "V.operator==", 12, "o", "eq"), ("class", "V.In", 14, "", ""), ("function", "V.In.deep", 14, "", ""), ("function", "V.V", 17, "t", "made"), ("function", "V.run", 18, "c,argv", "go"), ("function", "g", 20, "cb,a", "cb,h"),
        ("class", "Node", 21, "", ""), ("class", "Color", 22, "", ""), ("function", "make_node", 23, "", "f"), ("function", "wide", 24, "m,", "size"), ("function", "trail", 25, "a", ""), ("function", "main{id}", 28, "argc,argv", "run"),
    ]),
    "p09_generic": ("h.rb", RUBY, [("import", "set", 1, "", ""), ("class", "H{id}", 2, "", ""), ("function", "H{id}.go", 3, "", ""), ("class", "M", 6, "", ""), ("function", "M.self_made", 7, "", "")]),
    "p01_failed_parse": ("i.py", BROKEN, [
        ("error", "syntax", 1, "", ""), ("import", "os", 1, "", ""), ("function", "good{id}", 2, "a", "call"), ("class", "B", 4, "m", ""), ("function", "B.m", 5, "self", "go"), ("function", "bad", 6, "", ""), ("function", "after", 8, "", "last"),
    ]),
}
