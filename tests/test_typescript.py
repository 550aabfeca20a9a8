"""TypeScript sources that patterns over a text do not get right."""

from sparkloom.operators.extract_ts import _facts, tokens

HARD = r'''/* plain */
import Def, { a as b, type T1, c } from "../lib/util";
import * as ns from './ns';
import type { Only } from "./types";
import "side-effect";

/** An odd class. */
@Injectable({ scope: "x" })
export class A<T extends { k: string } = {}> extends ns.Base<Map<string, T[]>> implements I<T>, J {
  private readonly quote = /[{'"]/;
  static count = 0
  handler = async (x: number): Promise<void> => { await this.run(x); };
  map: Record<string, () => void> = { run() { go(); } };

  constructor(private store: Store, public readonly log?: Logger) { super(); }

  /** Signature. */
  load(id: string): Promise<T>;
  load(id: number): Promise<{ ok: boolean }>;
  async load(id: any): Promise<T | { ok: boolean }> {
    const nested = `a ${id ? `b ${this.other()} }` : "}"} c`;
    const ratio = id / 2 / this.total();
    if (/}/.test(nested)) { return this.store.read<T>(id); }
    const q = new ns.Query<T>(nested), r = ratio;
    return q.run().then((x) => x.done());
  }

  @Input() get value(): number { return this._v; }
  get(key: string) { return lookup?.(key); }
  private other() { return [1, 2].map((n) => fmt(n)); }
  protected abstract shape(): void;
  *items(): Iterator<T> { yield* list(); }
  "quoted-name"() {}
}

export interface Shown<T> extends Base1, Base2<T> {
  (call: string): void;
  new (x: string): Shown<T>;
  name: string
  show(x?: T): string
  hide?<U>(u: U): { done: boolean };
}

export function f(a: string): string;
export function f(a: number): number;
export function f(a: any): any { return g(a) }

function g({ x, y } = { x: 1, y: "}" }): { z: number } { return helper.deep.call(x); }

export const arrow = (n: number) => compute<number>(n);
const expr = class Hidden { m() { inner(); } };
let typed: A<string> = new A<string>();
export default async function main() {
  for (const i of [1]) await work(i);
  import("./lazy").then(m => m.go());
}
main();
'''


def _run(text, path="src/app/hard.ts"):
    rows = _facts("r", path, text, "ts.m")
    ents = {r["id"].removeprefix("ts.m").lstrip("."): r for r in rows if r["kind"] == "entity"}
    calls = {(r["id"].removeprefix("ts.m").lstrip("."), r.get("receiver"), r["name"], r["on_self"]) for r in rows if r["kind"] == "call"}
    return rows, ents, calls


def test_tokens_of_patterns_divisions_and_templates():
    kinds = lambda s, e=False: [(t.kind, t.text) for t in tokens(s, e) if t.kind != "mark"]
    assert kinds("a / b / c") == [("name", "a"), ("name", "b"), ("name", "c")]
    assert kinds("x = /a[/]b/g") == [("name", "x"), ("pattern", "/a[/]b/g")]
    assert ("pattern", "/}/") in kinds("if (a) /}/.test(b)") and ("pattern", "/x/") in kinds("{ } /x/.test(a)")
    assert all(k != "pattern" for k, _ in kinds("(a + b) / c / d; ({}) / 2 / 3; a++ / 2 / 3; [1] / 2 / 3"))
    assert [t for k, t in kinds("`a ${ `b ${c}` + '}' } d` + e") if k == "name"] == ["c", "e"]
    names = [t for k, t in kinds("const x = <div a=\"b'\" c={f(1)}>it's {g()} <B/> /* no */</div>; h()", True) if k == "name"]
    assert names == ["const", "x", "f", "g", "h"]
    assert [t for k, t in kinds("const id = <T extends object>(x: T) => x < y > z", True) if k == "name"] == ["const", "id", "T", "extends", "object", "x", "T", "x", "y", "z"]


def test_declarations():
    rows, ents, _ = _run(HARD)
    kinds = {k: r["type"] for k, r in ents.items()}
    assert kinds == {
        "": "module", "A": "class", "A.constructor": "method", "A.load": "method", "A.value": "method", "A.get": "method", "A.other": "method", "A.shape": "method", "A.items": "method",
        "A.quoted-name": "method", "Shown": "interface", "Shown.show": "method", "Shown.hide": "method", "f": "function", "g": "function", "main": "function",
    } | ({"Shown.new": "method"} if "Shown.new" in kinds else {})
    loads = [r for r in rows if r["kind"] == "entity" and r["name"] == "load"]
    assert [r["has_docstring"] for r in loads] == [True, False, False] and loads[0]["source"] == "load(id: string): Promise<T>"
    assert ents["A"]["has_docstring"] and ents["A"]["line"] == HARD[: HARD.index("@Injectable")].count("\n") + 1 and ents["A"]["source"].startswith("@Injectable") and ents["A"]["source"].endswith("}")
    assert ents["A"]["end_line"] == HARD[: HARD.index('"quoted-name"')].count("\n") + 2
    assert ents["f"]["source"].endswith("return g(a) }") and ents["g"]["source"].endswith("call(x); }") and ents[""]["has_docstring"]


def test_bases_imports_and_types():
    rows, *_ = _run(HARD)
    assert [(r["id"], r["name"], r["receiver"]) for r in rows if r["kind"] == "base"] == [
        ("ts.m.A", "ns.Base", "extends"), ("ts.m.A", "I", "implements"), ("ts.m.A", "J", "implements"), ("ts.m.Shown", "Base1", "extends"), ("ts.m.Shown", "Base2", "extends"),
    ]
    assert [(r["module"], r["name"], r["local"]) for r in rows if r["kind"] == "import"] == [
        ("src/lib/util", "a", "b"), ("src/lib/util", "T1", "T1"), ("src/lib/util", "c", "c"), ("src/lib/util", "Def", "Def"), ("src/app/ns", "ns", "ns"), ("src/app/types", "Only", "Only"),
    ]
    assert [(r["local"], r["name"]) for r in rows if r["kind"] == "attr"] == [("store", "Store"), ("log", "Logger")]
    assert ("typed", "A") in {(r["local"], r["name"]) for r in rows if r["kind"] == "var"}


def test_calls():
    _, _, calls = _run(HARD)
    assert {c for c in calls if c[0] == "A.load"} == {
        ("A.load", None, "other", True), ("A.load", None, "total", True), ("A.load", "store", "read", True), ("A.load", "ns.Query", "constructor", False),
        ("A.load", "q", "run", False), ("A.load", "x", "done", False),
    }
    assert {c for c in calls if c[0] == "A.get"} == {("A.get", None, "lookup", False)}
    assert {c for c in calls if c[0] == "A.other"} == {("A.other", None, "fmt", False)} and {c for c in calls if c[0] == "A.items"} == {("A.items", None, "list", False)}
    assert {c for c in calls if c[0] == "g"} == {("g", "deep", "call", False)} and {c for c in calls if c[0] == "f"} == {("f", None, "g", False)}
    assert {c for c in calls if c[0] == "main"} == {("main", None, "work", False), ("main", "m", "go", False)}
    assert {("", None, "compute", False), ("", None, "main", False), ("", "A", "constructor", False)} <= calls
    assert not any(c[2] in ("m", "run") and c[0] == "" and c[1] is None for c in calls)


def test_the_case_that_hid_a_file():
    text = "class A {\n  r = /[{'\"]/;\n  t = `${`}`}`;\n  method() { return 1; }\n}\nclass B { other() {} }\nfunction g() {}\n"
    _, ents, _ = _run(text)
    assert {k: (r["line"], r["end_line"]) for k, r in ents.items() if k} == {"A": (1, 5), "A.method": (4, 4), "B": (6, 6), "B.other": (6, 6), "g": (7, 7)}


def test_what_does_not_parse_hides_nothing_after_it():
    for broken in ("const x = {;\n", "}\n)\n", "class {}\n", "interface = 5\n", "function (\n)\n", "`${\n`}`\n", "@\n", "import\n", "export\n", "a < b\n"):
        _, ents, _ = _run(broken + "\n;function last() { go(); }\n")
        assert "" in ents and ("last" in ents or broken in ("const x = {;\n", "`${\n`}`\n", "}\n)\n")), broken
    for text in ("", "\n", "﻿class A {}", "'", "`", "/*", "/", "<", "class A { constructor(", "class A<", "function f(a: ", "import {", "import { a as", "interface I { (", "x?.", "a.b<", "@d("):
        _run(text), _run(text, "a.tsx")


def test_elements():
    text = "export class V extends React.Component<P> {\n  render() {\n    const ok = this.a < 3 && b > 2;\n    return <ul className='}' onClick={() => this.go()}>don't {items.map(i => <Li key={i}>{fmt(i)}</Li>)} <br/></ul>;\n  }\n  go() { stop(); }\n}\nconst w = <><V /></>;\nfunction after() { end(); }\n"
    _, ents, calls = _run(text, "v.tsx")
    assert set(ents) == {"", "V", "V.render", "V.go", "after"}
    assert {c for c in calls if c[0] == "V.render"} == {("V.render", None, "go", True), ("V.render", "items", "map", False), ("V.render", None, "fmt", False)}
