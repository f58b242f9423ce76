"""TypeScript projects as a Spark source, with the templates of their components."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.window import Window

from codeloom.functions.text import clean_path, template_expressions
from codeloom.operators.dispatch import first_wins, own_candidates, template_targets
from codeloom.operators.storage import written
from codeloom.sources.golang import Token
from codeloom.sources.project import FolderReader

FIELDS = {
    "kind": "string", "folder": "string", "file": "string", "name": "string", "owner": "string", "qualifier": "string", "clause": "string",
    "start": "bigint", "end": "bigint", "at": "bigint", "start_line": "bigint", "end_line": "bigint", "name_start": "bigint", "name_end": "bigint", "func": "bigint", "text": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())

# Words that are no names, those that may stand before a declaration, and those that brackets follow without a call.
KEYWORDS = set("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch throw try typeof var void while with yield await let".split())
MODIFIERS = set("export default declare abstract async public private protected static readonly override".split())

_TOKEN = re.compile(
    rb"(?P<space>[ \t\r\v\f]+)|(?P<line>\n)|(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<name>[A-Za-z_$#\x80-\xff][A-Za-z0-9_$\x80-\xff]*)"
    rb"|(?P<number>[0-9][\w.]*)|(?P<op>=>|\?\.(?![0-9])|\.\.\.|[^\s])", re.S)  # fmt: skip
_PIECE, _REGEX = re.compile(rb"(?:[^`\\$]|\\.|\$(?!\{))*", re.S), re.compile(rb"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def tokens(source: bytes) -> tuple[list[Token], list[tuple[int, str]]]:
    """The tokens of a file; what is inserted in a template literal, however deep, is tokens too. And (place, what is wrong) of texts that do not end."""
    out, errors, at, fresh, depth, inserted = [], [], 0, True, 0, []

    def piece(begin: int) -> int:
        """The rest of a template literal from ``begin``, up to its end or the next insertion."""
        nonlocal depth
        end = _PIECE.match(source, begin).end()
        if source[end : end + 2] == b"${":
            out.append(Token("op", "${", end, end + 2, False))
            inserted.append(depth)
            depth += 1
            return end + 2
        if end >= len(source):
            errors.append((begin - 1, "a text does not end"))
        out.append(Token("text", "`", begin, min(end + 1, len(source)), False))
        return end + 1

    while at < len(source):
        if source[at : at + 1] == b"`":
            out.append(Token("op", "`", at, at + 1, fresh))
            at, fresh = piece(at + 1), False
            continue
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0].decode("utf-8", "replace")
        if text == "/" and not (out and (out[-1].kind in ("name", "number", "text") or out[-1].text in (")", "]", "}"))) and (r := _REGEX.match(source, at)):
            m, kind, text = r, "text", "/"
        at = m.end()
        if kind == "line" or (kind == "note" and "\n" in text):
            fresh = True
        elif kind not in ("space", "note"):
            if kind == "op" and text in "\"'":
                errors.append((m.start(), "a text does not end"))
            out.append(Token("keyword" if kind == "name" and text in KEYWORDS and not (out and out[-1].text in (".", "?.")) else kind, text, m.start(), m.end(), fresh))
            fresh = False
            depth += (text == "{") - (text == "}")
            if text == "}" and inserted and depth == inserted[-1]:
                inserted.pop()
                at = piece(at)
    return out, errors


class TsFile:
    """What one file says, as rows of ``SCHEMA``."""

    def __init__(self, source: bytes):
        self.source, self.ascii = source, source.isascii()
        self.toks, self.errors = tokens(source)
        self.breaks = [m.start() for m in re.finditer(rb"\n", source)]
        self.match, stack = {}, []
        for i, t in enumerate(self.toks):
            if t.kind == "op" and t.text in ("(", "[", "{", "${", "`"):
                stack.append(i)
            elif (t.kind == "op" and t.text in _CLOSES) or (t.kind == "text" and t.text == "`"):
                if stack and self.toks[stack[-1]].text.replace("${", "{") == _CLOSES.get(t.text, t.text):
                    self.match[i] = stack.pop()
                    self.match[self.match[i]] = i
                else:
                    self.errors.append((t.start, f"unexpected {t.text}"))
        self.errors += [(self.toks[i].start, f"{self.toks[i].text} is not closed") for i in stack]

    def units(self, at: int) -> int:
        return at if self.ascii else len(self.source[:at].decode("utf-8", "replace").encode("utf-16-le")) // 2

    def row(self, kind: str, start: int, end: int, **more) -> dict:
        line = lambda at: bisect.bisect_left(self.breaks, at) + 1
        return {"kind": kind, "start": start, "end": end, "start_line": line(start), "end_line": line(max(start, end - 1)), **more}

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind != "text" and self.toks[i].text in texts

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "name"

    def after(self, i: int) -> int:
        return self.match.get(i, i) + 1 if self.is_(i, "(", "[", "{", "${", "`") else i + 1

    def generic(self, i: int) -> int:
        """The token after the type parameters at ``i``, ``i`` if there are none."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(self.toks):
            depth += self.is_(k, "<") - self.is_(k, ">")
            k = self.after(k)
            if not depth:
                return k
        return i

    def type_end(self, i: int) -> int:
        """The token after the type that begins at ``i``: the first that cannot go on with it."""
        k, operand = i, True
        while k < len(self.toks):
            if operand:
                if self.is_(k, "{", "(", "[", "`") or self.name(k) or self.toks[k].kind in ("text", "number") or self.is_(k, "void", "typeof", "new", "in"):
                    operand = self.is_(k, "typeof", "new") or (self.name(k) and self.toks[k].text in ("keyof", "readonly", "asserts", "infer", "unique") and (self.name(k + 1) or self.is_(k + 1, "typeof")))
                    k = self.after(k)
                elif self.is_(k, "|", "&"):
                    k += 1
                else:
                    return k
            elif self.is_(k, "|", "&", ".", "?.") or (self.is_(k, "=>") and self.is_(k - 1, ")")) or (self.name(k) and self.toks[k].text == "is"):
                operand, k = True, k + 1
            elif self.is_(k, "<"):
                k = self.generic(k) if self.generic(k) > k else k + 1
            elif self.is_(k, "[") and not self.toks[k].fresh:
                k = self.after(k)
            else:
                return k
        return k

    def body_of(self, i: int) -> int | None:
        """The brace of the body that follows the parameters at ``i`` and their result's type; None without one."""
        k = self.after(i)
        if self.is_(k, ":"):
            k = self.type_end(k + 1)
        return k if self.is_(k, "{") and k in self.match else None

    def rows(self) -> Iterator[dict]:
        yield self.row("file", 0, len(self.source), text=self.source.decode("utf-8", "replace"))
        i = first = 0
        while i < len(self.toks):
            if not (self.is_(i, *MODIFIERS) or self.is_(i, "@") or (self.name(i) and self.is_(i - 1, "@"))):
                first = i if not self.is_(i - 1, *MODIFIERS) and not self._decorated(i, first) else first
            if self.is_(i, "@"):
                first = i if not self._decorated(i, first) else first
                i = self.after(i + 2) if self.is_(i + 2, "(") else i + 2
                continue
            if self.is_(i, *MODIFIERS):
                first = i if not self.is_(i - 1, *MODIFIERS) and not self._decorated(i, first) else first
                i += 1
                continue
            if self.is_(i, "import"):
                i, found = self._import(i)
            elif self.is_(i, "function"):
                i, found = self._function(i, first)
            elif self.is_(i, "class"):
                i, found = self._class(i, first)
            elif self.name(i) and self.toks[i].text == "interface" and self.name(i + 1):
                i, found = self._interface(i)
            elif self.is_(i, "const", "let", "var") and not self.is_(i + 1, "enum"):
                i, found = self._variables(i)
            else:
                i, found = self.after(i), []
            yield from found
        for at, what in self.errors:
            yield self.row("error", at, at, text=what)

    def _decorated(self, i: int, first: int) -> bool:
        """Whether only decorators stand between ``first`` and ``i``."""
        k = first
        while k < i and self.is_(k, "@"):
            k = self.after(k + 2) if self.is_(k + 2, "(") else k + 2
        return first < i and k == i

    def _import(self, i: int) -> tuple[int, list[dict]]:
        k, names, out = i + 1, [], []
        while k < len(self.toks) and self.toks[k].kind != "text" and not (self.toks[k].fresh and k > i + 1 and not self.is_(k, "from", "}", ",") and not self.is_(k - 1, "{", ",")):
            if self.is_(k, "*") and self.name(k + 2):
                names.append(("*", self.toks[k + 2].text))
                k += 2
            elif self.name(k) and self.toks[k].text not in ("from", "type", "as"):
                inside = self.is_(k - 1, "{", ",") or self.toks[k - 1].text == "type"
                alias = self.toks[k + 2].text if self.name(k + 2) and self.is_(k + 1, "as") else self.toks[k].text
                names.append((self.toks[k].text if inside else "default", alias))
                k += 2 if alias != self.toks[k].text else 0
            k += 1
        if k < len(self.toks) and self.toks[k].kind == "text":
            path = self.toks[k]
            told = self.source[path.start + 1 : path.end - 1].decode("utf-8", "replace")
            out = [self.row("import", path.start, path.end, name=alias, owner=name, text=told) for name, alias in names]
        return k + 1, out

    def _target(self, first: int, end: int, body: int | None, stop: int, name: str, owner: str | None, opened: int | None) -> list[dict]:
        """A target from token ``first`` to before ``end``, its parameters and what is in tokens ``body`` to before ``stop``."""
        start = self.toks[first].start
        out = [self.row("func", start, self.toks[end - 1].end, name=name, owner=owner, at=self.units(start), clause="body" if body is not None else None)]
        if opened is not None:
            out += self._params(opened, start)
        return out + (self._body(body, stop, start) if body is not None else [])

    def _typed(self, k: int) -> str | None:
        """The type after the colon at ``k``, if it is one name."""
        if not self.is_(k, ":") or not self.name(k + 1):
            return None
        return self.toks[k + 1].text if self.type_end(k + 1) == self.generic(k + 2) else None

    def _params(self, i: int, func: int) -> list[dict]:
        out, k, close = [], i + 1, self.match.get(i, i)
        while k < close:
            if self.name(k) and self.toks[k].text not in MODIFIERS and (k == i + 1 or self.is_(k - 1, ",", "...") or self.toks[k - 1].text in MODIFIERS):
                at = k + 1 + self.is_(k + 1, "?")
                out.append(self.row("var", func, func, name=self.toks[k].text, func=func, owner=self._typed(at)))
                if self.toks[k - 1].text in MODIFIERS:
                    out[-1]["clause"] = "member"
                k = self.type_end(at + 1) if self.is_(at, ":") else at
            else:
                k = self.after(k)
        return out

    def _function(self, i: int, first: int) -> tuple[int, list[dict]]:
        k = i + 1 + self.is_(i + 1, "*")
        if not self.name(k):
            return k, []
        opened = self.generic(k + 1)
        if not self.is_(opened, "(") or opened not in self.match:
            return k, []
        body = self.body_of(opened)
        if body is None:  # an overload, or declared elsewhere
            return self.after(opened), []
        end = self.match[body] + 1
        return end, self._target(first, end, body + 1, end - 1, self.toks[k].text, None, opened)

    def _class(self, i: int, first: int) -> tuple[int, list[dict]]:
        named = self.name(i + 1) and not self.is_(i + 1, "implements")
        name, out = self.toks[i + 1].text if named else None, []
        k, clause = self.generic(i + 1 + named), None
        start = self.toks[first].start
        while k < len(self.toks) and not self.is_(k, "{"):
            if self.is_(k, "extends") or (self.name(k) and self.toks[k].text == "implements"):
                clause = self.toks[k].text
            elif clause and self.name(k) and not self.is_(k + 1, ".") and not self.is_(k - 1, "<"):
                out.append(self.row("heritage", self.toks[k].start, self.toks[k].end, name=name, owner=self.toks[k].text, clause=clause, func=start))
                k = self.generic(k + 1) - 1 if self.is_(k + 1, "<") else k
            k = self.after(k) if self.is_(k, "(", "[") else k + 1
        if k not in self.match:
            return k, out
        end = self.match[k] + 1
        out.append(self.row("class", start, self.toks[end - 1].end, name=name, at=self.units(start)))
        out += self._component(first, i, name, start)
        m = begin = k + 1
        while m < end - 1:
            if self.is_(m, ";", "@"):
                m = (self.after(m + 2) if self.is_(m + 2, "(") else m + 2) if self.is_(m, "@") else m + 1
                begin = m if not self._decorated(m, begin) else begin
                continue
            if self.toks[m].text in MODIFIERS and not self.is_(m + 1, "(", ":", "=", ";"):
                m += 1
                continue
            accessor = self.toks[m].text in ("get", "set") and (self.name(m + 1) or self.is_(m + 1, "["))
            m += accessor or self.is_(m, "*")
            after = m + 1 + self.is_(m + 1, "?", "!") if not self.is_(m, "[") else self.after(m)
            opened = self.generic(after)
            if self.is_(opened, "(") and opened in self.match:
                body = self.body_of(opened)
                stop = self.match[body] + 1 if body is not None else self.type_end(self.after(opened) + 1) if self.is_(self.after(opened), ":") else self.after(opened)
                if self.is_(m, "constructor"):
                    out += [{**r, "kind": "member", "func": start, "owner": r["owner"], "qualifier": name} for r in self._params(opened, start) if r.get("clause") == "member"]
                elif self.name(m) and not accessor:
                    if body is not None:
                        out += [r | ({"qualifier": name, "clause": "body"} if r["kind"] == "func" else {}) for r in self._target(begin, stop, body + 1, stop - 1, self.toks[m].text, name or "(anonymous)", opened)]
                    else:
                        out.append(self.row("abstract", self.toks[begin].start, self.toks[stop - 1].end, name=self.toks[m].text, owner=name))
                m = stop
            else:
                created = self.toks[after + 2].text if self.is_(after, "=") and self.is_(after + 1, "new") and self.name(after + 2) else None
                if self.name(m):
                    out.append(self.row("member", start, start, name=self.toks[m].text, owner=self._typed(after) or created, func=start, qualifier=name))
                m = self._statement_end(after)
            begin = m
        return end, out

    def _statement_end(self, k: int) -> int:
        """The token after a statement or member that goes on at ``k``: past a semicolon, or the first on a new line that does not go on with it."""
        while k < len(self.toks) and not self.is_(k, "}"):
            if self.is_(k, ";"):
                return k + 1
            if self.toks[k].fresh and not self.is_(k, ".", "?.", "?", ":", "|", "&", "+", "-", "*", "/", "=", ",", "=>", "(", "[") and not self.is_(k - 1, "=", "=>", ",", "|", "&", ":", "?", "+", "-", "(", "."):
                return k
            k = self.after(k)
        return k

    def _interface(self, i: int) -> tuple[int, list[dict]]:
        name, k = self.toks[i + 1].text, i + 2
        while k < len(self.toks) and not self.is_(k, "{"):
            k += 1
        if k not in self.match:
            return k, []
        out, m, end = [self.row("interface", self.toks[i].start, self.toks[self.match[k]].end, name=name)], k + 1, self.match[k]
        while m < end:
            opened = self.generic(m + 1 + self.is_(m + 1, "?"))
            if self.name(m) and self.is_(opened, "("):
                out.append(self.row("abstract", self.toks[m].start, self.toks[self.match.get(opened, opened)].end, name=self.toks[m].text, owner=name))
            m = max(m + 1, self._statement_end(self.after(m)))
        return end + 1, out

    def _variables(self, i: int) -> tuple[int, list[dict]]:
        """Top-level variables that begin as functions; the token after the statement."""
        out, k = [], i + 1
        while self.name(k):
            at = self.type_end(k + 2) if self.is_(k + 1, ":") else k + 1
            if not self.is_(at, "="):
                break
            begin = at + 1 + (self.is_(at + 1, "async") and not self.toks[at + 2].fresh)
            opened = begin + 1 + self.is_(begin + 1, "*") if self.is_(begin, "function") else begin
            opened = self.generic(opened + (self.name(opened) and self.is_(begin, "function")))
            body = stop = None
            if self.is_(opened, "(") and opened in self.match:
                body = self.body_of(opened) if self.is_(begin, "function") else None
                arrow = self.after(opened)
                arrow = self.type_end(arrow + 1) if self.is_(arrow, ":") else arrow
            else:
                arrow = opened + 1 if self.name(opened) else opened
            if body is not None:
                stop = self.match[body] + 1
                out += self._target(k, stop, body + 1, stop - 1, self.toks[k].text, None, opened)
            elif self.is_(arrow, "=>"):
                brace = self.is_(arrow + 1, "{") and arrow + 1 in self.match
                stop = self.match[arrow + 1] + 1 if brace else self._expression_end(arrow + 1)
                out += self._target(k, stop, arrow + 1, stop, self.toks[k].text, None, opened if self.is_(opened, "(") else None)
            else:
                created = self.toks[at + 2].text if self.is_(at + 1, "new") and self.name(at + 2) else None
                out.append(self.row("var", 0, 0, name=self.toks[k].text, owner=self._typed(k + 1) or created, func=-1))
                stop = self._expression_end(at + 1)
            k = stop + 1
            if not self.is_(stop, ","):
                return stop, out
        return max(k, i + 1), out

    def _expression_end(self, k: int) -> int:
        """The token after an expression: a comma, a semicolon, a closing bracket or a new line that does not go on with it."""
        while k < len(self.toks) and not self.is_(k, ",", ";", "}", ")", "]"):
            if self.toks[k].fresh and not self.is_(k, ".", "?.", "?", ":", "+", "-", "*", "/", "|", "&") and not self.is_(k - 1, "=>", "=", "?", ":", "+", "-", "|", "&", "."):
                return k
            k = self.after(k)
        return k

    def _component(self, first: int, i: int, name: str | None, start: int) -> list[dict]:
        """A template that the decorator Component of the class at ``i`` holds or names."""
        k = first
        while k < i:
            if self.is_(k, "@") and self.name(k + 1) and self.toks[k + 1].text == "Component" and self.is_(k + 2, "(") and self.is_(k + 3, "{") and k + 3 in self.match:
                found, m = {}, k + 4
                while m < self.match[k + 3]:
                    if self.name(m) and self.is_(m + 1, ":") and self.is_(m - 1, "{", ","):
                        plain = self.toks[m + 2].kind == "text" and self.toks[m + 2].text != "/"
                        literal = self.is_(m + 2, "`") and self.match.get(m + 2) == m + 3
                        if plain or literal:
                            begin, end = self.toks[m + 2].start, self.toks[m + 2 + literal].end
                            raw = self.source[begin + 1 : end - 1].decode("utf-8", "replace")
                            found.setdefault(self.toks[m].text, (begin, end, re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), raw, flags=re.S)))
                    m = self.after(m)
                for key in ("template", "templateUrl"):
                    if key in found:
                        begin, end, text = found[key]
                        return [self.row("component", begin, end, name=name, clause=key, at=self.units(begin), func=start, text=text)]
            k = self.after(k + 2) if self.is_(k, "@") and self.is_(k + 2, "(") else k + 1
        return []

    def _operand(self, k: int, low: int) -> int:
        """The first token of the operand that ends at ``k``."""
        while True:
            if self.is_(k, ")", "]") and k in self.match:
                s = self.match[k]
                if s - 1 >= low and (self.name(s - 1) or self.is_(s - 1, ")", "]")):
                    k = s - 1
                    continue
            else:
                s = self.match.get(k, k)
            if s - 1 < low or not self.is_(s - 1, ".", "?."):
                return s
            k = s - 2 if not self.is_(s - 2, "!") else s - 3

    def _body(self, low: int, high: int, func: int) -> list[dict]:
        out, chains = [], {}
        for i in range(low, high):
            if self.is_(i, "const", "let", "var") and self.name(i + 1):
                at = self.type_end(i + 3) if self.is_(i + 2, ":") else i + 2
                created = self.toks[at + 2].text if self.is_(at, "=") and self.is_(at + 1, "new") and self.name(at + 2) else None
                out.append(self.row("var", func, func, name=self.toks[i + 1].text, func=func, owner=self._typed(i + 2) or created))
            if not self.is_(i, "(") or i not in self.match:
                continue
            p, after = i - 1, self.match[i] + 1
            if self.is_(after, "=>") or (self.is_(after, ":") and self.is_(self.type_end(after + 1), "=>")) or self.is_(p, "function") or (self.is_(p - 1, "function", "*") and self.name(p)):
                out += self._params(i, func)
                continue
            if self.is_(p, ">"):  # type arguments
                depth, k = 0, p
                while k > low and not self.is_(k, ";", "{", "}", "(", "&", "="):
                    depth += self.is_(k, ">") - self.is_(k, "<")
                    if not depth:
                        break
                    k = self.match[k] - 1 if self.is_(k, "]", ")") and k in self.match else k - 1
                p = k - 1 if not depth and self.is_(k, "<") else p
            p -= self.is_(p, "?.", "!")
            if p < low or not self.name(p) or self.toks[p].text in ("this", "super") or (self.is_(after, "{") and not self.toks[after].fresh):
                if p >= low and self.is_(p, ")", "]") and p in self.match:
                    chains.setdefault(self._operand(p, low), []).append(None)
                continue
            first = self._operand(p, low)
            of = None
            if self.is_(p - 1, ".", "?."):
                o = p - 2
                if self.name(o) and not self.is_(o - 1, ".", "?."):
                    of = self.toks[o].text
                elif self.name(o) and self.name(o - 2) and self.toks[o - 2].text == "this" and not self.is_(o - 3, ".", "?."):
                    of = f"this.{self.toks[o].text}"
                else:
                    of = ""
            chains.setdefault(first, []).append((i, p, of))
        for first, chain in chains.items():
            for call in chain[self.is_(first - 1, "new") :]:
                if call:
                    i, p, of = call
                    out.append(self.row("call", self.toks[first].start, self.toks[self.match[i]].end, name=self.toks[p].text, qualifier=of, at=self.units(self.toks[first].start), name_start=self.toks[p].start, name_end=self.toks[p].end, func=func))
        return out


def _scan(folder: str, file: str, source: bytes) -> Iterator[dict]:
    if file.endswith(".html"):
        return iter([{"kind": "html", "text": source.decode("utf-8", "replace")}])
    return TsFile(source).rows()


def _enter(folder: str) -> bool:
    return folder != "node_modules" and folder[0] != "."


def _wanted(file: str) -> bool:
    return (file.endswith((".ts", ".tsx")) and not file.endswith(".d.ts")) or file.endswith(".html")


class TypeScriptSource(DataSource):
    """``spark.read.format("ts_project").option("path", root)``: rows of ``SCHEMA`` for all sources and pages below ``root``."""

    @classmethod
    def name(cls) -> str:
        return "ts_project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"], FIELDS, _enter, _wanted, _scan)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all sources below ``root``, lexed once and written."""
    spark.dataSource.register(TypeScriptSource)
    return written(spark.read.format("ts_project").option("path", root).load())


def _joined(folder: Column, path: Column) -> Column:
    return clean_path(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", folder, path)))


def facts(rows: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of scanned rows: source_files, targets, call_sites, candidates, heritage, templates, template_calls, errors.

    Targets are top-level functions, methods with bodies and top-level variables that begin as
    functions; an id is ``file#start`` in UTF-16 units. Calls have a name: of a function, or behind a
    dot; ``new``, ``super`` and calls of results have none. A plain name is a function of its file or one imported from a
    file of the project, unless a parameter or variable shadows it; ``this.m`` is a method of the class; a
    name, or ``this.f``, whose class or interface is declared gives that one's method, an
    interface call where it has no body. A component's template is its own text or a page beside it; one that is not there gives no
    row. Calls in templates that name a method of the component are direct.
    """
    of = lambda kind: rows.where(F.col("kind") == kind).drop("kind")
    func = of("func").where("clause = 'body'")
    ident = F.concat_ws("#", "file", F.col("at").cast("string"))
    targets = first_wins(func.select(
        ident.alias("target_id"), F.concat_ws(".", "owner", "name").alias("title"), F.col("name").alias("leaf"), "file", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "start_line", "end_line",
        F.lit(True).alias("has_body"), F.lit(False).alias("is_external"), "owner", F.col("start").alias("place")), "target_id", "place")
    targets = written(targets.drop("place"))
    own = targets.select("file", F.col("start_byte").alias("func"), F.col("target_id").alias("caller_id"), F.col("owner").alias("in_class"))
    # a module path is a file of the project as it is, with an extension, or a folder's index
    there = of("file").select("file")
    asked = of("import").where("text like '.%'").select("file", "name", "owner", _joined(F.col("folder"), F.col("text")).alias("base"))
    tried = asked.withColumn("from_file", F.explode(F.array(*[F.concat("base", F.lit(e)) for e in ("", ".ts", ".tsx", "/index.ts")])))
    imports = tried.join(there.select(F.col("file").alias("from_file")), "from_file").groupBy("file", "name").agg(F.min(F.struct("from_file", "owner")).alias("i")).select("file", "name", "i.*")
    plain = targets.where("owner is null").groupBy("file", "leaf").agg(F.min("target_id").alias("target_id"))
    scope = plain.select("file", F.col("leaf").alias("name"), F.col("target_id").alias("plain_target"))
    imported = imports.join(plain.select(F.col("file").alias("from_file"), F.col("leaf").alias("owner"), F.col("target_id").alias("imported_target")), ["from_file", "owner"]).select("file", "name", "imported_target")
    kinds = of("class").select("file", "name", F.lit("class").alias("owner_kind")).unionByName(of("interface").select("file", "name", F.lit("interface").alias("owner_kind"))).where("name is not null").dropDuplicates(["file", "name"])
    known = kinds.select("file", "name", F.concat_ws("#", "file", "name").alias("type_key"), "owner_kind")
    # what a type's name stands for in each file: its own first, else an imported one
    types = known.withColumn("tier", F.lit(0)).unionByName(imports.join(known.withColumnsRenamed({"file": "from_file", "name": "owner"}), ["from_file", "owner"]).select("file", "name", "type_key", "owner_kind", F.lit(1).alias("tier")))
    types = types.groupBy("file", "name").agg(F.min_by(F.struct("type_key", "owner_kind"), "tier").alias("t")).select("file", F.col("name").alias("type_name"), "t.*")
    methods = targets.where("owner is not null").select(F.concat_ws("#", "file", "owner").alias("type_key"), F.col("owner").alias("class_name"), F.col("leaf").alias("method_name"), "target_id", F.lit(True).alias("has_body"))
    bodies = methods.groupBy("type_key", "method_name").agg(F.min("target_id").alias("method_target"))
    abstract = of("abstract").where("owner is not null").select(F.concat_ws("#", "file", "owner").alias("type_key"), F.col("name").alias("method_name"), F.lit(True).alias("abstract")).distinct()
    heritage = of("heritage").select("file", F.concat_ws("#", "file", "name").alias("class_key"), "clause", F.col("owner").alias("type_name")).join(types, ["file", "type_name"]).select(F.col("type_key").alias("owner_key"), "class_key", "clause", "owner_kind")
    local = of("var").groupBy("file", "func", "name").agg(F.count_distinct(F.coalesce("owner", F.lit(""))).alias("n"), F.max("owner").alias("owner")).select("file", "func", F.col("name").alias("held"), F.when(F.col("n") == 1, F.col("owner")).alias("held_type"))
    member = of("member").select("file", F.col("qualifier").alias("in_class"), F.concat(F.lit("this."), "name").alias("held"), F.col("owner").alias("member_type")).dropDuplicates(["file", "in_class", "held"])
    top = local.where("func = -1").select("file", "held", F.col("held_type").alias("top_type"))

    call = of("call").join(own, ["file", "func"])
    j = call.join(local.select("file", "func", F.col("held").alias("name"), F.lit(True).alias("shadowed")), ["file", "func", "name"], "left")
    j = j.join(scope, ["file", "name"], "left").join(imported, ["file", "name"], "left")
    j = j.join(local.withColumnsRenamed({"held": "qualifier"}), ["file", "func", "qualifier"], "left").join(top.withColumnsRenamed({"held": "qualifier"}), ["file", "qualifier"], "left")
    j = j.join(member.withColumnsRenamed({"held": "qualifier"}), ["file", "in_class", "qualifier"], "left")
    j = j.withColumn("type_name", F.when(F.col("qualifier") == "this", F.col("in_class")).otherwise(F.coalesce("held_type", "member_type", "top_type"))).join(types, ["file", "type_name"], "left")
    j = j.withColumnRenamed("name", "method_name").join(bodies, ["type_key", "method_name"], "left").join(abstract, ["type_key", "method_name"], "left")
    bare = F.col("qualifier").isNull()
    resolved = F.when(bare & F.col("shadowed").isNull(), F.coalesce("plain_target", "imported_target")).when(~bare, F.col("method_target"))
    j = j.withColumn("resolved_target", resolved).withColumn("iface_key", F.when(~bare & F.col("method_target").isNull() & F.col("abstract"), F.col("type_key")))
    kind = F.when(F.col("iface_key").isNotNull(), "interface").when(F.col("resolved_target").isNotNull(), "direct").otherwise("indirect")
    shown = F.concat_ws(".", F.when(~F.col("qualifier").isin("", "this") & ~F.col("qualifier").startswith("this."), F.col("qualifier")), "method_name")
    order = (F.row_number().over(Window.partitionBy("caller_id").orderBy("start", F.desc("end"), "name_start")) - 1).cast("long")
    calls = written(j.select(
        F.concat_ws("@", F.concat_ws("#", "file", F.col("at").cast("string")), F.col("name_start").cast("string")).alias("call_key"), F.concat_ws(":", "file", F.col("at").cast("string")).alias("call_id"), "caller_id", order.alias("ast_order"), F.col("start_line").alias("line"),
        "name_start", "name_end", shown.alias("display_name"), "resolved_target", "iface_key", F.when(F.col("iface_key").isNotNull(), F.col("method_name")).alias("method_name"), F.lit(False).alias("goroutine"), kind.alias("kind")))
    options = own_candidates(calls.where("iface_key is not null").select("call_key", "iface_key", "method_name"), heritage, methods, targets)

    pages = of("html").select(F.col("file").alias("page"), F.col("text").alias("html"))
    part = of("component").select("file", "folder", "name", "clause", "at", "start_line", "text")
    inline = part.where("clause = 'template'").select(F.concat(F.concat_ws("#template@", "file", F.col("at").cast("string"))).alias("target_id"), "name", "file", F.col("file").alias("class_file"), "start_line", F.col("text").alias("source"))
    beside = part.where("clause = 'templateUrl'").withColumn("page", _joined(F.col("folder"), F.col("text"))).join(pages, "page").select(F.concat("page", F.lit("#template")).alias("target_id"), "name", F.col("page").alias("file"), F.col("file").alias("class_file"), F.lit(1).cast("long").alias("start_line"), F.col("html").alias("source"))
    found = inline.unionByName(beside).withColumn("class_key", F.concat_ws("#", "class_file", F.coalesce("name", F.lit("(anonymous)"))))
    templates = written(found.select("target_id", F.concat(F.coalesce("name", F.lit("(anonymous)")), F.lit(" ⟨template⟩")).alias("title"), "file", "class_key", "start_line", "source"))
    called = F.regexp_extract_all("e", F.lit(r"((?:\bthis\.|\?\.|\.)?[A-Za-z_$][A-Za-z0-9_$]*)\("), 1)
    inside = templates.select("target_id", "class_key", F.explode(template_expressions(F.col("source"))).alias("e")).select("target_id", "class_key", F.explode(called).alias("called"))
    # a name behind a dot is a call on something else, unless that is this
    inside = inside.select("target_id", "class_key", F.regexp_replace("called", r"^.*\.", "").alias("name"), (~F.col("called").rlike(r"^\??\.")).alias("implicit"))
    method = methods.select(F.col("type_key").alias("class_key"), F.col("method_name").alias("name"), "target_id", "has_body")
    named = template_targets(inside.withColumnRenamed("target_id", "template_id"), method, targets).select("template_id", "name", "kind", "target_id")
    files = of("file").select("file", F.lit("ts").alias("language"), F.lit(True).alias("is_main_module"), F.col("text").alias("source"))
    errors = rows.where("kind = 'error'").select("file", F.col("start").alias("at"), F.col("start_line").alias("line"), "text")
    return {"source_files": files, "targets": targets.drop("owner"), "call_sites": calls, "candidates": options, "heritage": heritage, "templates": templates, "template_calls": named, "errors": errors}
