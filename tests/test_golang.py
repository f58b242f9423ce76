"""Scanning Go projects: what is a call, what it resolves to, and what broken files cost."""

import pytest

from codeloom.sources import golang

MAIN = '''// Package main: run() in a comment is no call.
package main

import (
	"fmt"
	sh "example.com/zoo/shapes"
)

type Speaker interface {
	Speak(times int, loud bool) string
	fmt.Stringer
}

type Dog struct {
	Name, Alias string `json:"call()"`
	*sh.Square
}

func (d *Dog) Speak(n int, l bool) string { return "bark()" + `raw() // not
a call` }

type Cat struct{}

func (Cat) Speak(int, bool) string { return name('\\'', "é—🌍") }

type Fish struct{}

func (f Fish) Speak(n int) string { return "" }

func name(r rune, s string) string /* result() */ { return s }

func external(x int) (int, error)

func apply[T any](f func(T) (T, error), x T) interface{ Do() } {
	f(x)
	return nil
}

func main() { // — 🌍
	var s Speaker
	d := &Dog{Name: "d"}
	s.Speak(1, true)
	d.Speak(2, false); c := Cat{}
	go c.Speak(3, len("x("))
	defer name('(', fmt.Sprint(name(')', "a"), sh.Area(sh.Square{})))
	func() {
		go func(main int) { external(main) }(1)
	}()
	apply[int](nil, 1)
	(name)('x', "y")
	chain := sh.New().Grow(2).Side()
	go sh.New().Grow(1)
	handlers := []func(rune, string) string{name}
	handlers[0]('a', "b")
	_ = []byte("z")
	if v, ok := s.(fmt.Stringer); ok {
		v.String()
	}
	main := func() {}
	main()
	_, _ = chain, sh.Area
}
'''
SHAPES = '''package shapes

type Square struct{ side int }

func New() *Square { return &Square{} }

func (s *Square) Grow(by int) *Square { s.side += by; return s.Grow(by) }

func (s Square) Side() int { return s.side }

func Area(s Square) int {
	side := s.Side
	return side() * s.Side()
}
'''


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("zoo")
    files = {"go.mod": "module example.com/zoo\n", "main.go": MAIN, "shapes/square.go": SHAPES, "shapes/square_test.go": "package shapes\nfunc TestX() { New() }\n", "vendor/v.go": "package v\n",
             "nested/go.mod": "module example.com/other\n", "nested/deep/x.go": "package deep\n\nfunc X() { Y() }\n", "bad/open.go": 'package bad\n\nfunc A() { B() }\n\nfunc B() { x := "open\n', "bad/note.go": "package bad\nfunc C() {}\n/* no end", "bad/empty.go": "", "bad/bytes.go": "package bad\nfunc D() { A() } \xff\xfe\n"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode("latin-1") if "\xff" in text else text.encode())
    (root / "bad" / "gone.go").symlink_to(root / "nowhere.go")
    return golang.facts(golang.scan(spark, str(root)))


def test_targets(project):
    rows = {r.target_id: r for r in project["targets"].collect()}
    zoo, shapes = "example.com/zoo.", "example.com/zoo/shapes."
    assert set(rows) == {f"(*{zoo}Dog).Speak", f"({zoo}Cat).Speak", f"({zoo}Fish).Speak", *(zoo + n for n in ("name", "external", "apply", "main")), shapes + "New", f"(*{shapes}Square).Grow", f"({shapes}Square).Side", shapes + "Area",
                         "example.com/other/deep.X", *(f"example.com/zoo/bad.{n}" for n in ("A", "C", "D", "B"))}
    assert not rows[zoo + "external"].has_body and rows[zoo + "apply"].has_body and rows[f"(*{zoo}Dog).Speak"].title == "Dog.Speak"
    source = MAIN.encode()
    assert source[rows[zoo + "main"].start_byte : rows[zoo + "main"].end_byte].decode().startswith("func main() {") and source[rows[zoo + "main"].end_byte - 2 : rows[zoo + "main"].end_byte] == b"\n}"
    dog = rows[f"(*{zoo}Dog).Speak"]
    assert source[dog.start_byte : dog.end_byte].decode().endswith("a call` }") and dog.end_line == dog.start_line + 1


def test_calls(project):
    zoo, shapes = "example.com/zoo.", "example.com/zoo/shapes."
    source = MAIN.encode()
    rows = project["call_sites"].where(f"caller_id = '{zoo}main'").orderBy("ast_order").collect()
    got = [(source[r.name_start : r.name_end].decode(), r.display_name, r.kind, r.resolved_target, r.goroutine) for r in rows]
    assert got == [
        ("Speak", "s.Speak", "interface", None, False),
        ("Speak", "d.Speak", "direct", f"(*{zoo}Dog).Speak", False),
        ("Speak", "c.Speak", "direct", f"({zoo}Cat).Speak", True),
        ("len", "len", "indirect", None, False),
        ("name", "name", "direct", zoo + "name", False),
        ("Sprint", "fmt.Sprint", "indirect", None, False),
        ("name", "name", "direct", zoo + "name", False),
        ("Area", "sh.Area", "direct", shapes + "Area", False),
        ("external", "external", "direct", zoo + "external", False),
        ("apply", "", "indirect", None, False),
        ("name", "", "indirect", None, False),
        ("Side", "Side", "indirect", None, False),
        ("Grow", "Grow", "indirect", None, False),
        ("New", "sh.New", "direct", shapes + "New", False),
        ("Grow", "Grow", "indirect", None, True),
        ("New", "sh.New", "direct", shapes + "New", False),
        ("handlers", "", "indirect", None, False),
        ("[]byte", "", "indirect", None, False),
        ("String", "v.String", "indirect", None, False),
        ("main", "main", "indirect", None, False),
    ]
    assert [r.ast_order for r in rows] == list(range(len(rows)))
    others = {(r.caller_id, r.display_name): (r.kind, r.resolved_target) for r in project["call_sites"].where(f"caller_id <> '{zoo}main'").collect()}
    assert others == {
        (f"({zoo}Cat).Speak", "name"): ("direct", zoo + "name"), (zoo + "apply", "f"): ("indirect", None), (f"(*{shapes}Square).Grow", "s.Grow"): ("direct", f"(*{shapes}Square).Grow"),
        (shapes + "Area", "side"): ("indirect", None), (shapes + "Area", "s.Side"): ("direct", f"({shapes}Square).Side"), ("example.com/other/deep.X", "Y"): ("indirect", None),
        ("example.com/zoo/bad.A", "B"): ("direct", "example.com/zoo/bad.B"), ("example.com/zoo/bad.D", "A"): ("direct", "example.com/zoo/bad.A"),
    }
    keys = [r.call_key for r in project["call_sites"].select("call_key").collect()]
    assert len(keys) == len(set(keys))


def test_candidates_and_references(project):
    zoo = "example.com/zoo."
    assert [(r.idx, r.target_id, r.label) for r in project["candidates"].orderBy("idx").collect()] == [(0, f"(*{zoo}Dog).Speak", f"*{zoo}Dog.Speak"), (1, f"({zoo}Cat).Speak", f"{zoo}Cat.Speak")]  # Fish takes one parameter
    refs = sorted((r.target_id, r.caller_id, r.line) for r in project["refs"].collect())
    assert [(t, c) for t, c, _ in refs] == [("(example.com/zoo/shapes.Square).Side", "example.com/zoo/shapes.Area"), ("example.com/zoo.name", "example.com/zoo.main"), ("example.com/zoo/shapes.Area", "example.com/zoo.main")]
    assert all("name" in MAIN.split("\n")[line - 1] for t, _, line in refs if t == "example.com/zoo.name")


def test_broken_files_are_rows(project):
    errors = {(r.file, r.text) for r in project["errors"].collect()}
    assert {("bad/open.go", "a text does not end"), ("bad/open.go", "{ is not closed"), ("bad/note.go", "a comment does not end"), ("bad/empty.go", "no package")} <= errors
    assert any(f == "bad/gone.go" and t.startswith("FileNotFoundError") for f, t in errors)
    assert "shapes/square_test.go" not in {r.file for r in project["source_files"].collect()} and not any(f == "main.go" for f, _ in errors)


def test_nothing_to_scan(spark, tmp_path):
    found = golang.facts(golang.scan(spark, str(tmp_path)))
    assert all(df.count() == 0 for df in found.values())
