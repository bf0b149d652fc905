"""URL templates: {param} patterns of paths, rewrites between them, and the structure language for parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

PARAM = "{param}"

# Segments that content has anywhere, and words that migrations leave behind.
COMMON_SEGMENTS = (
    "blog", "blogs", "brand", "brands", "catalog", "categories", "category", "manufacturer", "manufacturers",
    "news", "part", "parts", "product", "products", "service", "services", "shop", "store",
)
ARTIFACT_WORDS = ("archive", "legacy", "migration", "old", "staging", "temp", "tmp")


def template(segments: Column, positions: Column) -> Column:
    """The path of these segments with {param} at the given positions (from 0)."""
    named = F.transform(segments, lambda s, i: F.when(F.array_contains(positions, i), F.lit(PARAM)).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def static_segments(pattern: Column) -> Column:
    return F.array_distinct(F.filter(urls.segments(pattern), lambda s: s != PARAM))


def count_params(pattern: Column) -> Column:
    return F.size(F.filter(urls.segments(pattern), lambda s: s == PARAM))


def is_artifact(segment: Column, templates: Column) -> Column:
    """Whether a fixed segment looks like a migration's leftover, given how many templates have it."""
    low = F.lower(segment)
    word = F.lit(False)
    for w in ARTIFACT_WORDS:
        word = word | F.contains(low, F.lit(w))
    return ~low.isin(*COMMON_SEGMENTS) & ((templates > 1) | word | (F.contains(low, F.lit("-")) & (F.length(low) >= 12)))


def rewrite_template(url: Column, old: str, new: str) -> Column:
    """A URL of one template in the form of another, parameters in order; null where it does not match or stays the same.

    Both templates need as many parameters. Host, query, fragment and a trailing slash are kept.
    """
    a, b = ([s for s in t.split("/") if s] for t in (old, new))
    if a.count(PARAM) != b.count(PARAM):
        raise ValueError("the templates differ in the number of parameters")
    pattern = r"^(?i:(https?))://([^/?#]+)/+" + "/+".join("([^/?#]+)" if s == PARAM else re.escape(s) for s in a) + r"(/?)(\?[^#]*)?(#.*)?$"
    groups = iter(range(3, 3 + a.count(PARAM)))
    rest = 3 + a.count(PARAM)
    parts = [F.regexp_extract(url, pattern, 1), F.lit("://"), F.regexp_extract(url, pattern, 2)]
    for s in b:
        parts += [F.lit("/"), F.regexp_extract(url, pattern, next(groups)) if s == PARAM else F.lit(s)]
    made = F.concat(*parts, *[F.regexp_extract(url, pattern, rest + i) for i in range(3)])
    return F.when(url.rlike(pattern) & (made != url), made)


class StructureError(ValueError):
    """A structure that cannot be read, or two that do not belong together."""


@dataclass(frozen=True)
class Segment:
    """A fixed segment, or a parameter with what is done to its value."""

    text: str
    name: str | None = None
    action: str = "keep"
    find: str = ""
    put: str = ""

    def column(self, value: Column) -> Column:
        if self.action == "upper":
            return F.upper(value)
        if self.action == "lower":
            return F.lower(value)
        if self.action == "replace":
            return F.replace(value, F.lit(self.find), F.lit(self.put))
        return value


@dataclass(frozen=True)
class Structure:
    segments: tuple[Segment, ...]
    slash: bool

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.segments if s.name]


def _segment(text: str) -> Segment:
    if not (text.startswith("{") and text.endswith("}") and len(text) > 1):
        if "{" in text or "}" in text:
            raise StructureError(f"{text!r} mixes a parameter with fixed text")
        return Segment(text)
    name, *rest = text[1:-1].split("|")
    if not re.fullmatch("[A-Za-z][A-Za-z0-9]*", name):
        raise StructureError(f"{name!r} is no parameter name")
    match rest:
        case []:
            return Segment(text, name)
        case ["upper" | "lower" as action, ""]:
            return Segment(text, name, action)
        case [find, ""] if find:
            return Segment(text, name, "replace", find)
        case [find, put, ""] if find:
            return Segment(text, name, "replace", find, put)
    raise StructureError(f"{text!r} is no transform: use {{A}}, {{A|text|}}, {{A|old|new|}}, {{A|upper|}} or {{A|lower|}}")


def parse_structure(text: str) -> Structure:
    """Read /shop/{A|upper|}/{B|old|new|}/ and the like."""
    body = text.strip().removeprefix("/")
    slash = body.endswith("/")
    body = body[:-1] if slash else body
    return Structure(tuple(_segment(s) for s in body.split("/")) if body else (), slash)


def check_structures(pattern: str, current: Structure, new: Structure) -> None:
    """Parameters must be unique, as many as the pattern's, and the same on both sides."""
    if len(current.names) != [s for s in pattern.split("/") if s].count(PARAM):
        raise StructureError("the current structure has another number of parameters than the pattern")
    for s in (current, new):
        if len(set(s.names)) != len(s.names):
            raise StructureError("a parameter is named twice")
    if set(new.names) - set(current.names):
        raise StructureError("the new structure has unknown parameters")
    if set(current.names) - set(new.names):
        raise StructureError("the new structure drops parameters")


#: A segment of a structure as a whole: fixed text, or a parameter with at most one transform.
SEGMENT = r"\A([^{}]*|\{[A-Za-z][A-Za-z0-9]*(\|[^|]+(\|[^|]*)?\|)?\})\z"


def structure_problem(pattern: Column, current: Column, new: Column) -> Column:
    """What check_structures or parse_structure would object to, for columns of jobs: ok, or the first fault.

    Faults in their order: current_unreadable, new_unreadable, other_count (of parameters than the pattern's),
    named_twice, unknown (a parameter that only the new structure has), dropped. Null where any of the three is null.
    """

    def parts(structure: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(F.trim(structure), r"\A/", ""), r"/\z", "")
        return F.filter(F.split(body, "/", -1), lambda s: body != "")

    def names(structure: Column) -> Column:
        return F.transform(F.filter(parts(structure), lambda s: s.startswith("{")), lambda s: F.regexp_extract(s, r"\A\{([A-Za-z0-9]*)", 1))

    def unreadable(structure: Column) -> Column:
        return F.exists(parts(structure), lambda s: ~s.rlike(SEGMENT))

    def twice(structure: Column) -> Column:
        return F.size(F.array_distinct(names(structure))) != F.size(names(structure))

    wanted = F.size(F.filter(F.split(pattern, "/", -1), lambda s: s == PARAM))
    fault = (
        F.when(unreadable(current), "current_unreadable")
        .when(unreadable(new), "new_unreadable")
        .when(F.size(names(current)) != wanted, "other_count")
        .when(twice(current) | twice(new), "named_twice")
        .when(F.size(F.array_except(names(new), names(current))) > 0, "unknown")
        .when(F.size(F.array_except(names(current), names(new))) > 0, "dropped")
        .otherwise("ok")
    )
    return F.when(pattern.isNotNull() & current.isNotNull() & new.isNotNull(), fault)


def transform_structure(url: Column, current: Structure, new: Structure) -> Column:
    """The URL rebuilt by the new structure; null where it does not fit the current one or stays the same."""
    segs = urls.segments(urls.path(url))
    fits = urls.is_url(url) & (F.size(segs) == len(current.segments))
    values = {}
    for i, s in enumerate(current.segments):
        if s.name:
            values[s.name] = F.get(segs, F.lit(i))
        else:
            fits = fits & (F.get(segs, F.lit(i)) == s.text)
    built = [s.column(values[s.name]) if s.name else F.lit(s.text) for s in new.segments]
    path = F.concat(F.lit("/"), F.concat_ws("/", *built) if built else F.lit(""))
    if new.slash:
        path = F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))
    made = F.concat(urls.part(url, urls.SCHEME), F.lit("://"), urls.part(url, urls.HOST), path, urls.part(url, urls.QUERY), urls.part(url, urls.FRAGMENT))
    return F.when(fits & (made != url), made)


def letters_for_params(pattern: Column) -> Column:
    """The pattern with its parameters named {A}, {B}, {C} in order."""
    segs = urls.segments(pattern)
    named = F.transform(
        segs,
        lambda s, i: F.when(s == PARAM, F.concat(F.lit("{"), F.char(F.size(F.filter(F.slice(segs, 1, i + 1), lambda t: t == PARAM)) + 64), F.lit("}"))).otherwise(s),
    )
    return F.concat(F.lit("/"), F.array_join(named, "/"))
