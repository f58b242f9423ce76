"""Scanning TypeScript projects and the templates of their components."""

import pytest

from codeloom.sources import typescript

GREET = '''// hello() in a comment
import { shout, Loud as L } from "./lib/loud";
import * as path from "path";

export interface Greeter { greet(who: string): string; name: string }

export class Polite implements Greeter {
  name = "é🌍";
  private loud = new L();
  constructor(private other: Greeter, plain: string) { this.setup(); }
  greet(who: string): string {
    const text = `hi ${shout(`${who.trim()} and ${format(who)}`)} not(a call)`;
    return this.loud.up(text) + this.other.greet("x (y)");
  }
  get size(): number { return count(); }
  static make<T>(x: T): Polite { return new Polite(wrap(x), "z").self().self(); }
  self(): this { return this; }
  abstract later(): void;
}

class Rude implements Greeter {
  name = "";
  greet(who: string) { return /call\\(/.test(who) ? "a" : format("b"); }
}

export default async function main(g: Greeter, format: (x: string) => string): Promise<void> {
  g.greet("a");
  format("shadowed");
  (() => { run(); })();
  await Promise.all([1, 2].map((n) => twice<number>(n)));
  if (ready()) { super_(); }
  const p = new Polite(g, "x");
  p?.greet("b");
  const o = { method(a: number) { return inner(a); }, key: other() };
}

function format(x: string): string;
function format(x: any): string { return x; }

const twice = (n: number): number => n * 2, wrap = function (x: unknown) { return x as any; };
export const run = async () => {
  format("c");
}
let notAFunction = count(1);
function count(n = 0) { return n; }
'''
LOUD = '''export function shout(x: string) { return x.toUpperCase(); }
export class Loud {
  up(x: string) { return shout(x); }
}
'''
APP = '''import { Component } from "core";

@Component({
  selector: "app-root",
  templateUrl: "./app.component.html",
})
export class AppComponent {
  title() { return "t"; }
  save(x: number) { this.title(); }
}

@Component({ selector: "x", template: `<b (click)="save(1)">{{ title() }}</b> save(9)` })
class Inline { save(n: number) {} }

@Component({ templateUrl: "missing.html" })
class Gone { save() {} }
'''
HTML = '<button (click)="save(item.id(2))">Save()</button>\n<p [x]="this.title()">{{ other.title() }}</p>\n'


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ts")
    files = {"greet.ts": GREET, "lib/loud.ts": LOUD, "app/app.component.ts": APP, "app/app.component.html": HTML, "node_modules/x/index.ts": "export function no() {}", "types.d.ts": "export function no(): void;", "bad.ts": "function a() { b('open }\nconst t = `x ${ y"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return typescript.facts(typescript.scan(spark, str(root)))


def test_targets(project):
    rows = {(r.file, r.title): r for r in project["targets"].collect()}
    assert set(rows) == {*(("greet.ts", t) for t in ("Polite.greet", "Polite.make", "Polite.self", "Rude.greet", "main", "format", "twice", "wrap", "run", "count")), ("lib/loud.ts", "shout"), ("lib/loud.ts", "Loud.up"),
                         *(("app/app.component.ts", t) for t in ("AppComponent.title", "AppComponent.save", "Inline.save", "Gone.save"))}
    source, units = GREET.encode(), GREET.encode("utf-16-le")
    text = lambda t: source[rows["greet.ts", t].start_byte : rows["greet.ts", t].end_byte].decode()
    assert text("main").startswith("export default async function main(") and text("main").endswith("other() };\n}")
    assert text("twice") == "twice = (n: number): number => n * 2" and text("wrap").startswith("wrap = function") and text("run").endswith('format("c");\n}')
    assert text("Polite.make").startswith("static make<T>") and text("format").startswith("function format(x: any)")
    at = int(rows["greet.ts", "Rude.greet"].target_id.split("#")[1])
    assert units[2 * at :].decode("utf-16-le").startswith("greet(who: string) { return /call")


def test_calls(project):
    names = {r.target_id: r.title for r in project["targets"].collect()}
    got = {}
    for r in project["call_sites"].orderBy("caller_id", "ast_order").collect():
        got.setdefault(names[r.caller_id], []).append((r.display_name, r.kind, names.get(r.resolved_target)))
    assert got == {
        "Polite.greet": [("shout", "direct", "shout"), ("who.trim", "indirect", None), ("format", "direct", "format"), ("up", "direct", "Loud.up"), ("greet", "interface", None)],
        "Polite.make": [("self", "indirect", None), ("self", "indirect", None), ("wrap", "direct", "wrap")],
        "Rude.greet": [("test", "indirect", None), ("format", "direct", "format")],
        "main": [("g.greet", "interface", None), ("format", "indirect", None), ("run", "direct", "run"), ("Promise.all", "indirect", None), ("map", "indirect", None), ("twice", "direct", "twice"), ("ready", "indirect", None), ("super_", "indirect", None),
                 ("p.greet", "direct", "Polite.greet"), ("inner", "indirect", None), ("other", "indirect", None)],
        "run": [("format", "direct", "format")], "shout": [("x.toUpperCase", "indirect", None)], "Loud.up": [("shout", "direct", "shout")], "AppComponent.save": [("title", "direct", "AppComponent.title")],
    }
    source = GREET.encode()
    for r in project["call_sites"].where("call_id like 'greet.ts%'").collect():
        assert source[r.name_start : r.name_end].decode() == r.display_name.split(".")[-1]
    options = project["candidates"].join(project["call_sites"].select("call_key", "display_name"), "call_key").orderBy("display_name", "idx").collect()
    assert [(r.display_name, r.label) for r in options] == [("g.greet", "Polite.greet"), ("g.greet", "Rude.greet"), ("greet", "Polite.greet"), ("greet", "Rude.greet")]


def test_templates(project):
    rows = {r.title: r for r in project["templates"].collect()}
    assert set(rows) == {"AppComponent ⟨template⟩", "Inline ⟨template⟩"}  # the missing page gives none
    page, own = rows["AppComponent ⟨template⟩"], rows["Inline ⟨template⟩"]
    assert (page.target_id, page.source, page.start_line) == ("app/app.component.html#template", HTML, 1)
    assert own.target_id == f"app/app.component.ts#template@{APP.index('`<b')}" and own.start_line == APP[: APP.index("`<b")].count("\n") + 1 and own.source.startswith("<b (click)")
    names = {r.target_id: r.title for r in project["targets"].collect()}
    got = sorted((r.template_id == page.target_id, r.name, r.kind, names.get(r.target_id, "")) for r in project["template_calls"].collect())
    assert got == [(False, "save", "direct", "Inline.save"), (False, "title", "indirect", ""), (True, "id", "indirect", ""), (True, "save", "direct", "AppComponent.save"), (True, "title", "direct", "AppComponent.title"), (True, "title", "indirect", "")]


def test_errors_and_nothing(project, spark, tmp_path):
    assert {r.file for r in project["errors"].collect()} == {"bad.ts"}
    assert all(df.count() == 0 for df in typescript.facts(typescript.scan(spark, str(tmp_path))).values())
