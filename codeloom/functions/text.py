"""Column functions over identifiers, source text and its coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 code units (``length`` counts code points)."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def byte_to_utf16(source: Column, offset: Column) -> Column:
    """UTF-16 units before a byte offset that falls between characters of valid UTF-8."""
    return utf16_len(F.substring(F.encode(source, "UTF-8"), F.lit(1), offset.cast("int")).cast("string"))


def utf16_to_byte(source: Column, offset: Column) -> Column:
    """Bytes before an offset in UTF-16 units; one inside a surrogate pair counts as after it."""
    units = F.encode(source, "UTF-16BE")
    lead = F.hex(F.substring(units, (2 * offset - 1).cast("int"), F.lit(1)))  # the last unit's first byte
    whole = offset + F.when((offset > 0) & lead.between("D8", "DB"), 1).otherwise(0)
    return F.octet_length(F.decode(F.substring(units, F.lit(1), (2 * whole).cast("int")), "UTF-16BE")).cast("long")


def lines(source: Column) -> Column:
    """Split on newline; a trailing empty piece stays."""
    return F.split(source, "\n", -1)


def line_of(source: Column, offset: Column) -> Column:
    """0-based line of a code point offset."""
    return (F.size(lines(F.substring(source, F.lit(1), offset.cast("int")))) - 1).cast("long")


def excerpt(source_lines: Column, line: Column, first: Column, last: Column, around: int = 2) -> tuple[Column, Column]:
    """(text, first line) of the lines around ``line``, clamped to first..last and to the lines there are, which count from 1; an empty text and 0 where none is left."""
    low = F.greatest(first, F.lit(1), line - around)
    high = F.least(last, F.size(source_lines), line + around)
    there = F.coalesce(low <= high, F.lit(False))
    cut = F.slice(source_lines, F.when(there, low).otherwise(1).cast("int"), F.when(there, high - low + 1).otherwise(0).cast("int"))
    return F.when(there, F.array_join(cut, "\n")).otherwise(""), F.when(there, low).otherwise(0)


def leaf(identifier: Column) -> Column:
    """What follows the last dot; all of it without a dot."""
    return F.substring_index(identifier, ".", -1)


def title(receiver: Column, name: Column) -> Column:
    """``Recv.Method`` without the pointer mark, or the function's name."""
    return F.when(receiver.isNull(), name).otherwise(F.concat_ws(".", F.regexp_replace(receiver, r"^\*", ""), name))


def display_name(qualifier: Column, name: Column) -> Column:
    """``x.Foo`` where the qualifier is an identifier, else ``Foo``."""
    return F.when(qualifier.isNull(), name).otherwise(F.concat_ws(".", qualifier, name))


# What counts as white space at the ends of a text, spaces of other scripts and the byte order mark included.
_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def stripped(c: Column) -> Column:
    """Trim of all white space, not only spaces."""
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}\z", "")


def contains_folded(text: Column, query: Column) -> Column:
    """Case-insensitive containment; an empty query matches all."""
    return F.contains(F.lower(text), F.lower(query))


def utf16_left(c: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units; half a surrogate pair at the end comes as U+FFFD."""
    units = F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)
    half = (F.octet_length(units) == 2 * n) & F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    whole = F.decode(F.substring(units, F.lit(1), F.octet_length(units) - F.when(half, 2).otherwise(0)), "UTF-16BE")
    return F.concat(whole, F.when(half, "\ufffd").otherwise(""))


def shortened(c: Column, most: int) -> Column:
    """First line, cut to ``most`` UTF-16 units with an ellipsis."""
    one = F.substring_index(c, "\n", 1)
    return F.when(utf16_len(one) > most, F.concat(utf16_left(one, most - 3), F.lit("…"))).otherwise(one)


def short_path(c: Column) -> Column:
    """The last two parts of a path."""
    return F.substring_index(c, "/", -2)


def pretty_name(identifier: Column) -> Column:
    """An id of more than two parts as ``.../`` and its last two."""
    return F.when(F.size(F.split(identifier, "/")) <= 2, identifier).otherwise(F.concat(F.lit(".../"), F.substring_index(identifier, "/", -2)))


def file_and_line(at: Column) -> tuple[Column, Column]:
    """``file:line`` parted at the last colon; without one, or with nothing before it, all is the file and the line null."""
    line = F.substring_index(at, ":", -1)
    cut = F.length(at) - F.length(line) - 1
    return F.when(cut > 0, at.substr(F.lit(1), cut)).otherwise(at), F.when(cut > 0, line)


def short_defined(at: Column) -> Column:
    """The file's name, and the line where there is one."""
    file, line = file_and_line(at)
    base = F.substring_index(file, "/", -1)
    return F.when(F.length(line) > 0, F.concat_ws(":", base, line)).otherwise(base)


def location(file: Column, line: Column) -> Column:
    """``name:line``; the name where the line is unknown; nothing without a file."""
    name = F.substring_index(file, "/", -1)
    return F.when(file.isNull(), "").when(line.isNull(), name).otherwise(F.concat_ws(":", name, line.cast("string")))


def command(template: Column, file: Column, line: Column) -> Column:
    """The arguments of a command template: parted at white space first, then filled in, so paths with spaces stay whole."""
    parts = F.filter(F.split(template, r"\s+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("{file}"), file), F.lit("{line}"), line.cast("string")))


def highlighted(label: Column, query: Column) -> Column:
    """``label`` in segments (text, hit): every occurrence of the trimmed query in any case, and what lies between."""
    q = F.lower(stripped(query))
    pieces = F.split(F.lower(label), F.concat(F.lit(r"\Q"), q, F.lit(r"\E")), -1)
    sizes = F.transform(pieces, lambda p: F.length(p))
    starts = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x) + i * F.length(q))
    both = F.flatten(F.zip_with(sizes, starts, lambda n, at: F.array(
        F.struct(label.substr(at + 1, n).alias("text"), F.lit(False).alias("hit")),
        F.struct(label.substr(at + n + 1, F.length(q)).alias("text"), F.lit(True).alias("hit")))))
    found = F.filter(F.slice(both, 1, F.size(both) - 1), lambda s: s["text"] != "")
    return F.when(q == "", F.array(F.struct(label.alias("text"), F.lit(False).alias("hit")))).otherwise(found)


# Types whose emits fan out, and the packages that must declare them.
OBSERVABLES = ("Subject", "BehaviorSubject", "ReplaySubject", "AsyncSubject", "EventEmitter")
OBSERVABLE_ORIGIN = r"(^|[/\\])(rxjs|@angular[/\\]core)([/\\]|$)"
EMIT_METHODS = ("next", "emit")


def is_observable(type_name: Column, origin: Column) -> Column:
    """Whether a type is one of the observables, declared below a folder of their packages."""
    return type_name.isin(*OBSERVABLES) & origin.rlike(OBSERVABLE_ORIGIN)


def path_matches(file: Column, asked: Column) -> Column:
    """Whether ``file`` is the path asked for, or ends in it after a slash; a leading ``./`` does not count."""
    clean = F.regexp_replace(asked, r"^\./", "")
    return (file == clean) | file.endswith(F.concat(F.lit("/"), clean))


def clean_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, each ``..`` taking the part before it; a leading slash stays."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.slice(parts, 1, 0), lambda acc, p: (
        F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when((p == "..") & rooted, acc).otherwise(F.concat(acc, F.array(p)))))
    joined = F.array_join(kept, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def rfc3339(ts: Column) -> Column:
    """A UTC time as ``2024-01-31T09:05:07Z``; needs a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# What a declaration is called, by its syntax.
DECLARATION_KINDS = {
    "FunctionDeclaration": "func", "MethodDeclaration": "func", "MethodSignature": "func", "ArrowFunction": "func", "FunctionExpression": "func", "Constructor": "func",
    "ClassDeclaration": "type", "InterfaceDeclaration": "type", "TypeAliasDeclaration": "type", "EnumDeclaration": "type",
    "PropertyDeclaration": "field", "PropertySignature": "field", "PropertyAssignment": "field", "Parameter": "param", "VariableDeclaration": "var", "EnumMember": "const",
}
# What an object is called, by its class in the type checker.
OBJECT_KINDS = {"Func": "func", "TypeName": "type", "Const": "const", "PkgName": "package", "Label": "label", "Builtin": "builtin"}


def _by_name(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c], F.lit("symbol"))


def declaration_kind(syntax: Column) -> Column:
    return _by_name(syntax, DECLARATION_KINDS)


def object_kind(kind: Column, is_field: Column) -> Column:
    return F.when(kind == "Var", F.when(is_field, "field").otherwise("var")).otherwise(_by_name(kind, OBJECT_KINDS))


def search_limit(n: Column) -> Column:
    """1 to 500 as asked, anything else 50."""
    return F.when(n.between(1, 500), n).otherwise(50)


# File kinds that start a rebuild, and folders that are not watched.
TRIGGER_EXTENSIONS = ("go", "ts", "tsx", "mts", "cts", "js", "jsx", "html")
SKIPPED_DIRS = ("node_modules", "vendor", "dist")


def is_trigger(path: Column) -> Column:
    """Whether a change of this path rebuilds the index. Extensions count in any case, names of manifests as they are."""
    base = F.substring_index(path, "/", -1)
    extension = F.when(F.instr(base, ".") > 0, F.lower(F.substring_index(base, ".", -1))).otherwise("")
    config = (base == "package.json") | base.startswith("tsconfig") | base.startswith("jsconfig")
    return extension.isin(*TRIGGER_EXTENSIONS) | ((extension == "json") & config)


def is_skipped_dir(name: Column) -> Column:
    return name.isin(*SKIPPED_DIRS) | name.startswith(".")


def anchor_label(start: Column, end: Column, kind: Column) -> Column:
    """``:a`` after a line, ``:a–b`` for a range, `` · top`` or `` · end`` of a file."""
    one = F.concat(F.lit(":"), start.cast("string"))
    return F.when(kind == "file-start", " · top").when(kind == "file-end", " · end").when(kind == "range", F.concat(one, F.lit("–"), end.cast("string"))).otherwise(one)


def references(text: Column) -> Column:
    """What stands in ``[[...]]``, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1)


def template_calls(html: Column) -> Column:
    """Names that are followed by an opening bracket, in order."""
    return F.regexp_extract_all(html, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\("), 1)


def template_expressions(html: Column) -> Column:
    """What a template evaluates: ``{{...}}`` and the values of ``(event)``, ``[property]``, ``on-`` and ``bind-`` attributes, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?s)(\{\{.*?\}\}|(?:[\[(][^\s\[\]()"'=<>]+[\])]{1,2}|\*[\w-]+|on-[\w-]+|bind-[\w-]+)\s*=\s*(?:"[^"]*"|'[^']*'))"""), 1)
    return F.transform(found, lambda e: F.regexp_replace(F.regexp_replace(e, r"(?s)^(\{\{|[^=]*=\s*[\"'])", ""), r"(?s)(\}\}|[\"'])$", ""))


def depth_color(depth: Column, palette: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, palette)), (depth % len(palette) + 1).cast("int"))


def elided(chain: Column, most: int = 6, tail: int = 5) -> Column:
    """A chain of titles: all up to ``most``, else the first, a gap and the last ``tail``."""
    n = F.size(chain)
    gap = F.array(F.concat(F.lit("+"), (n - tail - 1).cast("string")))
    return F.when(n <= most, chain).otherwise(F.concat(F.slice(chain, 1, 1), gap, F.slice(chain, n - tail + 1, tail)))
