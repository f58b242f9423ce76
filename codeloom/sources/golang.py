"""Go projects as a Spark source: a folder a partition, lexed into facts, which joins resolve.

Files give what their text alone tells: declarations, calls, values, errors.
What a name stands for is settled by Spark, over all files: by package scope,
by imports, by the types that parameters and variables are declared with.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.window import Window

from codeloom.operators.dispatch import candidates, classify, first_wins, implementers
from codeloom.operators.storage import written
from codeloom.sources.project import FolderReader

FIELDS = {
    "kind": "string", "folder": "string", "file": "string", "package": "string", "name": "string", "owner": "string", "qualifier": "string", "pointer": "boolean",
    "start": "bigint", "end": "bigint", "start_line": "bigint", "end_line": "bigint", "name_start": "bigint", "name_end": "bigint", "func": "bigint", "shape": "string",
    "goroutine": "boolean", "text": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())

# The words of the language that are no names.
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())

_TOKEN = re.compile(
    rb"(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+')|(?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)"
    rb"|(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<op>:=|\.\.\.|<-|[^\s])", re.S)  # fmt: skip
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Token:
    __slots__ = ("end", "fresh", "kind", "start", "text")

    def __init__(self, kind, text, start, end, fresh):
        self.kind, self.text, self.start, self.end, self.fresh = kind, text, start, end, fresh  # fresh: first on its line


def tokens(source: bytes) -> tuple[list[Token], list[tuple[int, str]]]:
    """The tokens of a file without comments, and (place, what is wrong) of texts and comments that do not end."""
    out, errors, fresh = [], [], True
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0].decode("utf-8", "replace")
        if kind == "line" or (kind == "note" and "\n" in text):
            fresh = True
        elif kind not in ("space", "note"):
            if kind == "op" and text in ('"', "`", "'"):
                errors.append((m.start(), "a text does not end"))
            if kind == "op" and text == "/" and source[m.start() : m.start() + 2] == b"/*":
                errors.append((m.start(), "a comment does not end"))
                break
            out.append(Token("keyword" if text in KEYWORDS and kind == "name" else kind, text, m.start(), m.end(), fresh))
            fresh = False
    return out, errors


class GoFile:
    """What one file says, as rows of ``SCHEMA``."""

    def __init__(self, source: bytes):
        self.source, self.base = source, {}
        self.toks, self.errors = tokens(source)
        self.breaks = [m.start() for m in re.finditer(rb"\n", source)]
        self.match, stack = {}, []
        for i, t in enumerate(self.toks):
            if t.kind == "op" and t.text in "([{":
                stack.append(i)
            elif t.kind == "op" and t.text in _CLOSES:
                if stack and self.toks[stack[-1]].text == _CLOSES[t.text]:
                    self.match[i] = stack.pop()
                    self.match[self.match[i]] = i
                else:
                    self.errors.append((t.start, f"unexpected {t.text}"))
        self.errors += [(self.toks[i].start, f"{self.toks[i].text} is not closed") for i in stack]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def row(self, kind: str, start: int, end: int, **more) -> dict:
        return {"kind": kind, "start": start, "end": end, "start_line": self.line(start), "end_line": self.line(max(start, end - 1)), **self.base, **more}

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind in ("op", "keyword") and self.toks[i].text in texts

    def words(self, a: int, b: int) -> str:
        """Tokens ``a`` to before ``b`` as text, apart only where two names meet."""
        out = ""
        for t in self.toks[a:b]:
            out += (" " if out and (out[-1].isalnum() or out[-1] == "_") and (t.text[0].isalnum() or t.text[0] == "_") else "") + t.text
        return out

    def split(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The parts between commas of what lies from ``a`` to before ``b``."""
        at = k = a
        while k < b:
            if self.is_(k, ","):
                yield at, k
                at = k + 1
            k = self.match.get(k, k) + 1 if self.is_(k, "(", "[", "{") else k + 1
        if at < b:
            yield at, b

    def params(self, i: int) -> list[tuple[str | None, int, int]]:
        """(name, first and last token of the type) of each parameter between the brackets at ``i``."""
        parts = list(self.split(i + 1, self.match[i]))
        named = any(b - a > 1 and self.toks[a].kind == "name" and not self.is_(a + 1, ".") and not (self.is_(a + 1, "[") and self.match[a + 1] == b - 1 and b - a > 3 and self.toks[a + 2].kind == "name") for a, b in parts)
        out = [(self.toks[a].text, a + 1, b) if named else (None, a, b) for a, b in parts]
        for k in range(len(out) - 2, -1, -1):  # a, b int
            if named and out[k][1] >= out[k][2]:
                out[k] = (out[k][0], *out[k + 1][1:])
        return out

    def signature(self, i: int, end: int) -> str:
        """Parameter and result types, from the bracket at ``i`` to before ``end``."""
        told = ", ".join(self.words(a, b) for _, a, b in self.params(i))
        k = self.match[i] + 1
        if self.is_(k, "(") and k < end:
            return f"({told}) ({', '.join(self.words(a, b) for _, a, b in self.params(k))})"
        return f"({told}) {self.words(k, end)}".rstrip()

    def named_type(self, a: int, b: int) -> dict:
        """owner, qualifier and pointer of a type that is a name, perhaps of another package, perhaps behind a pointer; else nothing."""
        pointer = self.is_(a, "*")
        a += pointer
        b = self.match[b - 1] if b - 1 > a and self.is_(b - 1, "]") and not self.is_(a, "[") else b  # type arguments
        if b - a == 1 and self.toks[a].kind == "name":
            return {"owner": self.toks[a].text, "pointer": pointer}
        if b - a == 3 and self.is_(a + 1, ".") and self.toks[a].kind == "name":
            return {"owner": self.toks[a + 2].text, "qualifier": self.toks[a].text, "pointer": pointer}
        return {}

    def rows(self) -> Iterator[dict]:
        i, package = 0, None
        while i < len(self.toks):
            t = self.toks[i]
            if self.is_(i, "package") and i + 1 < len(self.toks):
                package = self.base["package"] = self.toks[i + 1].text
                yield self.row("file", 0, len(self.source), name=package, text=self.source.decode("utf-8", "replace"))
                i += 2
            elif self.is_(i, "import", "type") and i + 1 < len(self.toks):
                group = self.is_(i + 1, "(") and i + 1 in self.match
                end = self.match[i + 1] if group else self._decl_end(i + 1)
                yield from (self._imports if t.text == "import" else self._types)(i + 1 + group, end)
                i = end + group
            elif self.is_(i, "func"):
                end, found = self._func(i)
                yield from found
                i = end
            else:
                i = self.match.get(i, i) + 1 if self.is_(i, "(", "[", "{") else i + 1
        if package is None:
            self.errors.append((0, "no package"))
        for at, what in self.errors:
            yield self.row("error", at, at, text=what)

    def _decl_end(self, i: int) -> int:
        """The token after a declaration that begins at ``i``: the first on a new line, brackets aside."""
        k = i
        while k < len(self.toks) and (k == i or not self.toks[k].fresh):
            k = self.match.get(k, k) + 1 if self.is_(k, "(", "[", "{") else k + 1
        return k

    def _imports(self, a: int, b: int) -> Iterator[dict]:
        for k in range(a, b):
            if (t := self.toks[k]).kind == "text":
                path = t.text[1:-1]
                alias = self.toks[k - 1].text if k > a and self.toks[k - 1].kind == "name" and not self.toks[k].fresh else None
                yield self.row("import", t.start, t.end, name=alias or path.rsplit("/", 1)[-1], text=path)

    def _types(self, a: int, b: int) -> Iterator[dict]:
        while a < b:
            end, name = min(self._decl_end(a), b), self.toks[a]
            k = a + 1
            if self.is_(k, "[") and k + 1 < end and self.toks[k + 1].kind == "name" and self.match.get(k, k) > k + 2:
                k = self.match[k] + 1  # type parameters
            k += self.is_(k, "=")
            shape = self.toks[k].text if self.is_(k, "interface", "struct") else "other"
            yield self.row("type", name.start, self.toks[end - 1].end, name=name.text, shape=shape, text=self.words(k, end))
            if shape != "other" and k + 1 in self.match:
                m, close = k + 2, self.match[k + 1]
                while m < close:
                    stop = min(self._decl_end(m), close)
                    if shape == "interface" and self.toks[m].kind == "name" and self.is_(m + 1, "("):
                        yield self.row("method", self.toks[m].start, self.toks[stop - 1].end, name=self.toks[m].text, owner=name.text, text=self.signature(m + 1, stop))
                    elif shape == "struct" and (tag := stop - (self.toks[stop - 1].kind == "text")) > m:
                        alone = tag - m == 1 or self.is_(m, "*") or self.is_(m + 1, ".")
                        for a_, b_ in [(m, tag)] if alone else self._field_names(m, tag):
                            yield self.row("field", self.toks[a_].start, self.toks[tag - 1].end, name=None if alone else self.toks[a_].text, owner=name.text, text=self.words(m if alone else b_, tag))
                    elif shape == "interface":
                        yield self.row("embedded", self.toks[m].start, self.toks[stop - 1].end, name=self.words(m, stop), owner=name.text)
                    m = stop
            a = end

    def _field_names(self, a: int, b: int) -> list[tuple[int, int]]:
        names = [a]
        while self.is_(names[-1] + 1, ",") and names[-1] + 2 < b:
            names.append(names[-1] + 2)
        return [(n, names[-1] + 1) for n in names]

    def _func(self, i: int) -> tuple[int, list[dict]]:
        """(token after the declaration, its rows)."""
        k, receiver = i + 1, None
        if self.is_(k, "(") and k in self.match:
            receiver = self.params(k)
            k = self.match[k] + 1
        if k >= len(self.toks) or self.toks[k].kind != "name":
            return i + 1, []
        name, k = self.toks[k], k + 1
        if self.is_(k, "[") and k in self.match:
            k = self.match[k] + 1
        if not self.is_(k, "(") or k not in self.match:
            return i + 1, []
        params, opened = self.params(k), k
        k = self.match[k] + 1
        body = self._body_of(k, True)
        end = self.match[body] + 1 if body is not None and body in self.match else self._decl_end(k) if k < len(self.toks) and not self.toks[k].fresh else k
        start, stop = self.toks[i].start, self.toks[end - 1].end
        own = self.named_type(*receiver[0][1:]) if receiver else {}
        out = [self.row("func", start, stop, name=name.text, name_start=name.start, name_end=name.end, owner=own.get("owner"), pointer=own.get("pointer"), shape="body" if body is not None else None, text=self.signature(opened, body if body is not None else end))]
        for n, a, b in [*(receiver or []), *params]:
            if n:
                out.append(self.row("var", start, start, name=n, func=start, **self.named_type(a, b)))
        if body is not None and body in self.match:
            out += self._body(body, self.match[body], start)
        return end, out

    def _body_of(self, k: int, one_line: bool = False) -> int | None:
        """The brace that opens the body after a function's parameters, past its result; None if there is none."""
        while k < len(self.toks) and not (one_line and self.toks[k].fresh):
            if self.is_(k, "{"):
                return k
            if self.is_(k, "interface", "struct") and self.is_(k + 1, "{") and k + 1 in self.match:
                k = self.match[k + 1] + 1
            elif self.is_(k, "(", "[") and k in self.match:
                k = self.match[k] + 1
            elif self.toks[k].kind == "name" or self.is_(k, "*", ".", "func", "map", "chan", "<-"):
                k += 1
            else:
                return None
        return None

    def _ends_operand(self, k: int, low: int) -> bool:
        """Whether an operand ends at ``k`` that what follows goes on with: a new line ends it."""
        return k > low and not self.toks[k + 1].fresh and (self.toks[k].kind in ("name", "text", "number") or self.is_(k, ")", "]", "}"))

    def _operand(self, k: int, low: int, literals: dict[int, int]) -> int:
        """The first token of the operand that ends at ``k``."""
        while True:
            if self.is_(k, ")", "]", "}") and k in self.match:
                s = literals.get(k, self.match[k])
                if k not in literals and self._ends_operand(s - 1, low):
                    k = s - 1
                    continue
            else:
                s = k
            if not self.is_(s - 1, "."):
                return s
            k = s - 2

    def _body(self, low: int, high: int, func: int) -> list[dict]:
        literals, not_calls, out = {}, set(), []
        for i in range(low + 1, high):
            if self.is_(i, "func") and self.is_(i + 1, "(") and i + 1 in self.match:
                after = self.match[i + 1] + 1
                not_calls |= {i + 1, after}
                body = self._body_of(after)
                if body is not None and body in self.match:
                    literals[self.match[body]] = i
                    out += [self.row("var", func, func, name=n, func=func, **self.named_type(a, b)) for n, a, b in self.params(i + 1) if n]
            elif self.is_(i, ":=", "range") or (self.is_(i, "var") and i + 1 < high):
                out += self._variables(i, low, high, func)
        calls, named = {}, set()
        for i in range(low + 1, high):
            p, t = i - 1, self.toks[i]
            if not self.is_(i, "(") or i not in self.match or i in not_calls or t.fresh or not self._ends_operand(p, low) or p in literals:
                continue
            first = self._operand(p, low, literals)
            span, shape, qualifier = (self.toks[first].start, self.toks[p].end), "other", None
            inner = p
            while self.is_(inner, ")", "]") and inner in self.match:  # (f)(x), F[T](x)
                m = self.match[inner]
                if self.is_(inner, "]") and self._ends_operand(m - 1, low):
                    inner, shape = m - 1, "index"
                elif self.is_(inner, ")") and not self._ends_operand(m - 1, low):
                    inner, shape = inner - 1, "paren"
                else:
                    break
            if inner in literals:
                continue
            n = self.toks[inner]
            if n.kind == "name" and not self.is_(inner - 1, "]"):
                named.add(inner)
                span = (n.start, n.end)
                if inner == p:
                    shape = "selector" if self.is_(p - 1, ".") else "name"
                    if shape == "selector" and self.toks[p - 2].kind == "name" and not self.is_(p - 3, "."):
                        qualifier = self.toks[p - 2].text
            else:
                shape = "other"
                if self.is_(inner - 1, "]") and inner - 1 in self.match:  # a conversion, []T(x) or map[K]V(x)
                    first = self.match[inner - 1] - self.is_(self.match[inner - 1] - 1, "map")
                    span = (self.toks[first].start, self.toks[p].end)
            calls.setdefault(first, []).append((i, n.text if shape in ("selector", "name") else None, qualifier, span, shape))
        for first, chain in calls.items():
            for k, (i, name, qualifier, (a, b), shape) in enumerate(chain):
                launched = self.is_(first - 1, "go") and k == len(chain) - 1
                out.append(self.row("call", self.toks[first].start, self.toks[self.match[i]].end, name=name, qualifier=qualifier, shape=shape, name_start=a, name_end=b, func=func, goroutine=launched))
        for i in range(low + 1, high):
            t = self.toks[i]
            if t.kind == "name" and i not in named and not self.is_(i + 1, ":", ":=") and not (self.is_(i - 1, ".") and (self.toks[i - 2].kind != "name" or self.is_(i - 3, "."))):
                out.append(self.row("value", t.start, t.end, name=t.text, qualifier=self.toks[i - 2].text if self.is_(i - 1, ".") else None, name_start=t.start, name_end=t.end, func=func))
        return out

    def _variables(self, i: int, low: int, high: int, func: int) -> list[dict]:
        """Names that ``:=``, ``range`` or ``var`` at ``i`` declares, with the type where ``var x T``, ``x := T{`` or ``x := &T{`` says it."""
        if self.is_(i, "var"):
            if self.toks[i + 1].kind != "name":
                return []
            stop = next((k for k in range(i + 2, high) if self.toks[k].fresh or self.is_(k, "=")), high)
            return [self.row("var", func, func, name=self.toks[i + 1].text, func=func, **self.named_type(i + 2, stop))]
        if self.is_(i, "range"):
            return []
        names, k = [], i - 1
        while k > low and self.toks[k].kind == "name":
            names.append(self.toks[k].text)
            k -= 2 if self.is_(k - 1, ",") else len(self.toks)
        a = i + 1 + self.is_(i + 1, "&")
        b = a + (3 if self.is_(a + 1, ".") else 1)
        kind = self.named_type(a, b) if len(names) == 1 and self.is_(b, "{") else {}
        return [self.row("var", func, func, name=n, func=func, **kind, **({"pointer": a > i + 1} if kind else {})) for n in names] if not kind else [self.row("var", func, func, name=names[0], func=func, **{**kind, "pointer": a > i + 1})]


def _enter(folder: str) -> bool:
    return folder not in ("vendor", "testdata", "node_modules") and folder[0] not in "._"


def _wanted(file: str) -> bool:
    """Go files that a build takes, and module files."""
    return (file.endswith(".go") and not file.endswith("_test.go") and file[0] not in "._") or file == "go.mod"


def _scan(folder: str, file: str, source: bytes) -> Iterator[dict]:
    if not file.endswith(".go"):
        m = re.search(rb"^module\s+\"?([^\s\"]+)", source, re.M)
        return iter([{"kind": "module", "name": m[1].decode("utf-8", "replace")}] if m else [])
    return GoFile(source).rows()


class GoSource(DataSource):
    """``spark.read.format("go_project").option("path", root)``: rows of ``SCHEMA``; ``root`` is a folder that driver and executors see."""

    @classmethod
    def name(cls) -> str:
        return "go_project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"], FIELDS, _enter, _wanted, _scan)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all Go files below ``root``, lexed once and written."""
    spark.dataSource.register(GoSource)
    return written(spark.read.format("go_project").option("path", root).load())


def facts(rows: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of scanned rows: source_files, targets, call_sites, candidates, refs, iface_methods, method_sets, errors.

    A package is its module's path and folder. A target's id is ``pkg.Func``, ``(pkg.T).M``
    or ``(*pkg.T).M``; of equal ids the first in order of files counts. A called name that
    no parameter or variable of the function shadows is its package's
    function; ``q.F`` one of the package imported as q, or where q is a
    variable whose declared type is known, that type's method, or an
    interface call. Anything else is indirect: built-in functions,
    conversions, generic instantiations, names in brackets, results of calls, variables whose type only a
    type checker knows. Calls are in order of their expressions' beginnings, an
    outer one before those inside it. A value reference is such a name that calls nothing.
    """
    module = rows.where("kind = 'module'").select(F.when(F.col("folder") == ".", F.lit("")).otherwise(F.concat("folder", F.lit("/"))).alias("top"), F.col("name").alias("module"))
    folders = rows.where("kind = 'file'").select("folder").distinct().withColumn("dir", F.when(F.col("folder") == ".", F.lit("")).otherwise(F.concat("folder", F.lit("/"))))
    # a folder belongs to the module of the longest path above it, listed part by part
    above = folders.withColumn("parts", F.split("dir", "/")).withColumn("top", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice("parts", F.lit(1), k), "/"), F.lit("/"))))))
    best = above.join(module, "top").groupBy("folder", "dir").agg(F.max_by(F.struct("top", "module"), F.length("top")).alias("m"))
    inside = F.regexp_replace(F.expr("substring(dir, length(m.top) + 1)"), "/$", "")
    paths = folders.join(best.select("folder", F.when(inside == "", F.col("m.module")).otherwise(F.concat_ws("/", "m.module", inside)).alias("known")), "folder", "left").select("folder", F.coalesce("known", "folder").alias("path"))
    of = lambda kind: rows.where(F.col("kind") == kind).drop("kind").join(paths, "folder")
    func = of("func")
    typed = F.concat(F.lit("("), F.when(F.col("pointer"), "*").otherwise(""), "path", F.lit("."), "owner", F.lit(")."), "name")
    targets = func.select(
        F.when(F.col("owner").isNull(), F.concat_ws(".", "path", "name")).otherwise(typed).alias("target_id"), F.concat_ws(".", "owner", "name").alias("title"), F.col("name").alias("leaf"), "file", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "start_line", "end_line",
        F.col("shape").isNotNull().alias("has_body"), F.lit(False).alias("is_external"), F.struct("file", "start").alias("place"), "path", "owner", "pointer", F.col("text").alias("signature"))
    targets = written(first_wins(targets, "target_id", "place"))
    own = targets.select("file", F.col("start_byte").alias("func"), F.col("target_id").alias("caller_id"))
    imports = of("import").select("file", F.col("name").alias("qualifier"), F.col("text").alias("import_path")).dropDuplicates(["file", "qualifier"])
    types = of("type").groupBy("path", F.col("name").alias("owner")).agg(F.max(F.col("shape") == "interface").alias("is_interface"))
    held = of("var").groupBy("file", "func", "name").agg(F.collect_set(F.struct("owner", "qualifier", "path")).alias("kinds"))
    held = held.withColumn("one", F.when((F.size("kinds") == 1) & F.col("kinds")[0]["owner"].isNotNull(), F.col("kinds")[0])).select("file", "func", "name", "one.*")
    held = held.join(imports, ["file", "qualifier"], "left").select("file", "func", F.col("name").alias("held"), "owner", F.when(F.col("qualifier").isNull(), F.col("path")).otherwise(F.col("import_path")).alias("type_path"))
    plain = targets.where("owner is null").select(F.col("path").alias("of_path"), F.col("leaf").alias("of_name"), F.col("target_id").alias("plain_target"))
    methods = targets.where("owner is not null").groupBy(F.col("path").alias("type_path"), "owner", F.col("leaf").alias("of_name")).agg(F.min("target_id").alias("method_target"))

    def resolved(named: DataFrame) -> DataFrame:
        """Adds resolved_target and iface_key to rows that have file, func, path, name, qualifier."""
        j = named.join(held.select("file", "func", F.col("held").alias("name"), F.lit(True).alias("shadowed")), ["file", "func", "name"], "left")
        j = j.join(held.withColumnRenamed("held", "qualifier"), ["file", "func", "qualifier"], "left").join(imports, ["file", "qualifier"], "left")
        j = j.join(types.select(F.col("path").alias("type_path"), "owner", "is_interface"), ["type_path", "owner"], "left")
        known = F.col("type_path").isNotNull() & F.col("owner").isNotNull()
        j = j.withColumn("of_path", F.when(F.col("qualifier").isNull() & F.col("shadowed").isNull(), F.col("path")).when(~known, F.col("import_path"))).withColumn("of_name", F.col("name"))
        j = j.join(plain, ["of_path", "of_name"], "left").join(methods, ["type_path", "owner", "of_name"], "left")
        interface = F.coalesce(known & F.col("is_interface"), F.lit(False))
        return j.withColumn("resolved_target", F.when(~interface, F.coalesce("plain_target", "method_target"))).withColumn("iface_key", F.when(interface, F.concat_ws(".", "type_path", "owner")))

    call = resolved(of("call").drop("owner").withColumn("qualifier", F.when(F.col("shape") == "selector", F.col("qualifier"))).withColumn("plain_name", F.col("name")).withColumn("name", F.when((F.col("shape") == "name") | F.col("qualifier").isNotNull(), F.col("name"))))
    order = F.row_number().over(Window.partitionBy("caller_id").orderBy("start", F.desc("end"))) - 1
    call = call.join(own, ["file", "func"]).withColumn("ast_order", order.cast("long"))
    calls = written(call.select(
        F.concat_ws("@", F.concat_ws(":", "file", F.col("start").cast("string")), F.col("name_start").cast("string")).alias("call_key"), F.concat_ws(":", "file", F.col("start").cast("string")).alias("call_id"), "caller_id", "ast_order", F.col("start_line").alias("line"), "name_start", "name_end",
        F.coalesce(F.concat_ws(".", "qualifier", "plain_name"), F.lit("")).alias("display_name"), "resolved_target", "iface_key", F.when(F.col("iface_key").isNotNull(), F.col("plain_name")).alias("method_name"), "goroutine"))
    value = resolved(of("value").drop("owner")).where("resolved_target is not null").join(own, ["file", "func"])
    refs = value.select(F.col("resolved_target").alias("target_id"), "caller_id", "file", F.col("start_line").alias("line"))
    need = of("method").select(F.concat_ws(".", "path", "owner").alias("iface_key"), F.col("name").alias("method_name"), F.col("text").alias("signature"))
    have = targets.where("owner is not null").select(F.concat_ws(".", "path", "owner").alias("type_key"), "pointer", F.col("leaf").alias("method_name"), "signature", "target_id")
    # the method set of a pointer holds that of the value
    sets = have.select("type_key", F.explode(F.when(F.col("pointer"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("is_pointer"), "method_name", "signature", "target_id")
    impls = implementers(need, sets)
    bodies = sets.select(F.concat(F.when(F.col("is_pointer"), "*").otherwise(""), "type_key").alias("type_key"), "method_name", "target_id").withColumn("label", F.concat_ws(".", "type_key", "method_name"))
    options = candidates(calls.where("iface_key is not null").select("call_key", "iface_key", "method_name"), impls.select("iface_key", F.col("type_name").alias("type_key")), bodies, ["label"], targets)
    files = of("file").select("file", F.lit("go").alias("language"), F.lit(True).alias("is_main_module"), F.col("text").alias("source"))
    errors = rows.where("kind = 'error'").select("file", F.col("start").alias("at"), F.col("start_line").alias("line"), "text")
    public = targets.drop("path", "owner", "pointer", "signature", "place")
    kinds = classify(calls, public.select("target_id", "is_external")).select("call_key", "kind", "external")
    return {"source_files": files, "targets": public, "call_sites": calls.join(kinds, "call_key"), "candidates": options, "refs": refs, "iface_methods": need, "method_sets": sets, "errors": errors}
