"""Names, patterns and text forms, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_type(fqn: Column) -> Column:
    """What follows the last dot or dollar sign."""
    return F.regexp_replace(fqn, r"^.*[.$]", "")


def package_of(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)


def short_params(params: Column) -> Column:
    """Comma-joined parameter types without their packages."""
    return F.array_join(F.transform(F.split(params, ","), lambda p: F.regexp_replace(p, r"^.*\.", "")), ",")


def short_label(key: Column) -> Column:
    """type#method(params) as Type.method."""
    return F.concat(simple_type(F.substring_index(key, "#", 1)), F.lit("."), F.regexp_extract(key, r"#([^(]*)", 1))


def csv_field(text: Column) -> Column:
    """Quoted, with quotes doubled, if it holds a comma, tab, quote or line end."""
    return F.when(text.rlike('[,\\t"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def escape_row(text: Column) -> Column:
    """Backslash, tab and line ends escaped, other control characters as \\uXXXX, so that a row is one line of tab-parted columns."""
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    rare = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(_CONTROL), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)), "")
    return F.when(text.rlike(_CONTROL), rare).otherwise(text)


def unescape_row(text: Column) -> Column:
    """What escape_row was given, in one pass; a backslash before anything else stands for itself."""
    parts = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\[\\tnr]|[^\\]+|\\"), F.lit(0))

    def one(p: Column) -> Column:
        out = F.when(p.rlike(r"^\\u[0-9A-Fa-f]{4}$"), F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"))
        for a, b in (("\\\\", "\\"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            out = out.when(p == a, b)
        return out.otherwise(p)

    return F.when(F.instr(text, "\\") > 0, F.array_join(F.transform(parts, one), "")).otherwise(text)


def is_test_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: F.lower(x).isin("test", "tests"))


def bean_name(simple: Column) -> Column:
    """Decapitalised, unless it begins with two capitals."""
    return F.when(simple.rlike("^[A-Z][A-Z]"), simple).otherwise(F.concat(F.lower(F.substring(simple, 1, 1)), F.substring(simple, 2, 1 << 20)))


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a package or type pattern, without look-around; None for one that matches nothing.

    `a.b.**` is the package and what is below it, `a.b.*` its own types (nested ones too); else a type, in whose last level `*` stands
    for any run without dot or dollar sign. `**` as a whole inner level of a package is any number of levels.
    """
    if not pattern.strip(".*$"):
        return None

    def level(x: str) -> str:
        return "".join("[^.$]*" if c == "*" else re.escape(c) for c in x)

    def package(x: str) -> str:
        out = ""
        for part in x.split("."):
            out += r"(?:[^.$]+\.)*" if part == "**" else level(part) + r"\."
        return out

    if pattern.endswith(".**"):
        return "^" + package(pattern[:-3]) + ".+$"
    if pattern.endswith(".*"):
        return "^" + package(pattern[:-2]) + r"[^.]+$"
    if "**" in pattern:
        return None
    head, _, last = pattern.rpartition(".")
    if "*" in head:
        return None
    return "^" + (re.escape(head) + r"\." if head else "") + level(last) + "$"


def glob_match(name: Column, pattern: str) -> Column:
    rx = glob_regex(pattern)
    return F.lit(False) if rx is None else name.rlike(rx)


def prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, the name itself last."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def location(type_name: Column, method: Column, path: Column, line: Column) -> Column:
    """A stack trace's line; a lambda body counts as the method around it, a null path as an unknown source."""
    name = F.regexp_replace(method, r"^lambda\$(.+)\$[0-9]+$", "$1")
    where = F.coalesce(F.concat(F.substring_index(path, "/", -1), F.lit(":"), line.cast("string")), F.lit("Unknown Source"))
    return F.concat(F.lit("at "), type_name, F.lit("."), name, F.lit("("), where, F.lit(")"))


def expectation(op: Column, values: Column) -> Column:
    """What a guard's op asks of its subject, as text."""
    listed = F.concat(F.lit("{"), F.array_join(values, ", "), F.lit("}"))
    first = F.get(values, F.lit(0))
    return F.when(op == "EQ", F.concat(F.lit("= "), first)).when(op == "NE", F.concat(F.lit("≠ "), first)).when(op == "IN", F.concat(F.lit("∈ "), listed)).when(op == "NI", F.concat(F.lit("∉ "), listed))


# --- labels -------------------------------------------------------------------------------------------------------------------


def type_in_package(type_name: Column, package: Column) -> Column:
    """A type's name without its package, nested names whole; the last level where the package isn't its head."""
    return F.when(package == "", type_name).when(type_name.startswith(F.concat(package, F.lit("."))), F.substring(type_name, F.length(package) + 2, F.length(type_name))).otherwise(F.substring_index(type_name, ".", -1))


def shown_method(type_name: Column, package: Column, method: Column) -> Column:
    """A method's name; a constructor shows its type's."""
    return F.when(method == "<init>", F.substring_index(type_in_package(type_name, package), ".", -1)).otherwise(method)


def label(type_name: Column, package: Column, method: Column) -> Column:
    return F.concat(type_in_package(type_name, package), F.lit("."), shown_method(type_name, package, method))


def label_with_params(type_name: Column, package: Column, method: Column, params: Column, ambiguous: Column) -> Column:
    """Type.method(params): short parameter types, whole ones where the short label is ambiguous."""
    return F.concat(label(type_name, package, method), F.lit("("), F.when(ambiguous, params).otherwise(short_params(params)), F.lit(")"))


def full_signature(type_name: Column, package: Column, method: Column, params: Column) -> Column:
    return F.concat(type_name, F.lit("."), shown_method(type_name, package, method), F.lit("("), params, F.lit(")"))


def plain_label(type_name: Column, package: Column, method: Column, params: Column) -> Column:
    """The whole type name with short parameter types: what can be ambiguous."""
    return F.concat(type_name, F.lit("."), shown_method(type_name, package, method), F.lit("("), short_params(params), F.lit(")"))


def display_label(type_name: Column, package: Column, method: Column, params: Column, ambiguous: Column) -> Column:
    return F.when(ambiguous, full_signature(type_name, package, method, params)).otherwise(plain_label(type_name, package, method, params))


def param_count(params: Column) -> Column:
    return F.when(F.trim(params) == "", 0).otherwise(F.size(F.split(params, ",")))


def param_at(params: Column, index: int) -> Column:
    """The type of parameter `index` (from 0); null where there is none."""
    return F.when(F.trim(params) != "", F.get(F.split(params, ","), F.lit(index)))


def last_is_array(params: Column) -> Column:
    return F.element_at(F.split(params, ","), -1).endswith("[]")


def parse_int_or(text: Column, default: int) -> Column:
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")), F.lit(default))


def has_token(tokens: Column, token: str) -> Column:
    """Is a name among tokens `name` or `name=value`?"""
    return F.exists(tokens, lambda t: (t == token) | t.startswith(f"{token}="))


def token_value(tokens: Column, token: str) -> Column:
    """The value of the first token `name=value`; '' of a bare one, null without."""
    own = F.get(F.filter(tokens, lambda t: (t == token) | t.startswith(f"{token}=")), F.lit(0))
    return F.when(own == token, "").otherwise(F.substring(own, len(token) + 2, 1 << 20))


def only_among(tokens: Column, allowed: list[str]) -> Column:
    """Are all tokens' names among `allowed`?"""
    return F.forall(tokens, lambda t: F.substring_index(t, "=", 1).isin(allowed))


def package_of_unit(path: Column) -> Column:
    """a/b/C.java is in a.b; '' at the top."""
    return F.when(F.instr(path, "/") > 1, F.translate(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/", ".")).otherwise("")


def guard_text(text: Column, most: int = 60) -> Column:
    """A condition's source in one line, cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def protocol_escape(text: Column) -> Column:
    """Backslash, tab and line ends of a field of a line; '' for null."""
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit(""))


def type_to_path(type_name: Column) -> Column:
    """The source file of a type: a.b.Outer.Inner and a.b.Outer$Inner are in a/b/Outer.java, as types begin with a capital."""
    outer = F.substring_index(type_name, "$", 1)
    inside = F.regexp_extract(outer, r"^((?:[^.\p{Lu}][^.]*\.)*\p{Lu}[^.]*)", 1)
    return F.concat(F.translate(F.when(inside != "", inside).otherwise(outer), ".", "/"), F.lit(".java"))


def pattern_problem(pattern: str) -> str | None:
    """What is wrong with a package, type or type#method pattern: WILDCARD_ONLY (no letter in it), WILDCARD_CLASS (the last level of a type
    is **), WILDCARD_IN_METHOD, WILDCARD_OUTER_CLASS (a capital beside * in an outer level; it still matches). None if nothing."""
    body, _, method = pattern.partition("#")
    package = not method and (body.endswith(".*") or body.endswith(".**"))
    levels = [x for x in (body.rpartition(".")[0] if package else body).split(".") if x]
    if levels and all(set(x) == {"*"} for x in levels):
        return "WILDCARD_ONLY"
    if not package and levels and levels[-1] == "**":
        return "WILDCARD_CLASS"
    if "*" in method:
        return "WILDCARD_IN_METHOD"
    if not package and any("*" in x and any(c.isupper() for c in x) for x in levels[:-1]):
        return "WILDCARD_OUTER_CLASS"
    return None


def method_glob_match(type_name: Column, method: Column, pattern: str) -> Column:
    """Does type#method (or a type alone) match? The method is compared as it is; `.**` alone is the unnamed package."""
    if pattern == ".**":
        return F.instr(type_name, ".") == 0
    body, has_method, name = pattern.partition("#")
    if pattern_problem(pattern) not in (None, "WILDCARD_OUTER_CLASS"):
        return F.lit(False)
    own = glob_match(type_name, body)
    return own & (method == name) if has_method else own
