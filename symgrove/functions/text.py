"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(c: Column, part: str) -> Column:
    """Substring in any case; nothing in ``part`` is a wildcard."""
    return F.lower(c).contains(part.lower())


def member_name(c: Column) -> Column:
    """The last segment of a dotted name."""
    return F.substring_index(c, ".", -1)


def simple_name(c: Column) -> Column:
    """The last segment, dots first, then double colons."""
    return F.element_at(F.split(F.substring_index(c, ".", -1), "::"), -1)


def forward_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def normal_path(c: Column) -> Column:
    """Without empty, ``.`` and ``..`` segments."""
    parts = F.filter(F.split(forward_slashes(c), "/"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def without_script_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.(js|jsx|ts|tsx)$", "")


def qualify_member_call(target: Column, enclosing: Column) -> Column:
    """``this.m`` and ``self.m`` become ``Class.m``; deeper chains stay."""
    return F.when(enclosing.isNotNull() & target.rlike(r"^(this|self)\.[^.]*$"), F.concat(enclosing, F.lit("."), F.substring_index(target, ".", -1))).otherwise(target)


def super_method(target: Column) -> Column:
    """``m`` of a call ``super(...).m``, else null."""
    got = F.regexp_extract(target, r"^super\((?:(?!\)\.).)*\)\.([^.(]+)$", 1)
    return F.when(got != "", got)


def humanize_ago(seconds: Column) -> Column:
    """Minutes, hours, days or months, whichever is the largest whole unit."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    whole = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 3600, whole(60, "m ago")).when(s < 86400, whole(3600, "h ago")).when(s < 2592000, whole(86400, "d ago")).otherwise(whole(2592000, "mo ago"))


def file_route(path: Column) -> Column:
    """The URL path that file-based routing gives a source file, or null."""
    p = F.concat(F.lit("/"), forward_slashes(path))

    def after(folder: str) -> Column:  # behind the last such folder
        return F.substring_index(p, f"/{folder}/", -1)

    def inside(folder: str) -> Column:
        return p.contains(f"/{folder}/")

    def segments(rest: Column, star: str) -> Column:
        parts = F.filter(F.split(rest, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
        one = lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[\.\.\.(.+)\]$", f":$1{star}"), r"^\[(.+)\]$", ":$1")
        return F.concat(F.lit("/"), F.array_join(F.transform(parts, one), "/"))

    def folder_of(rest: Column) -> Column:
        return F.regexp_replace(rest, r"(^|/)[^/]*$", "")

    pages = F.regexp_replace(after("pages"), r"\.(tsx|ts|jsx|js)$", "")
    nuxt = F.regexp_replace(after("pages"), r"\.vue$", "")
    index = lambda c: F.regexp_replace(c, r"(^|/)index$", "")
    remix = F.regexp_replace(after("routes"), r"\.(tsx|ts|jsx|js)$", "")
    remix = F.filter(F.split(F.regexp_replace(remix, r"\.", "/"), "/"), lambda s: (s != "") & (s != "_index"))
    remix = F.concat(F.lit("/"), F.array_join(F.transform(remix, lambda s: F.replace(s, F.lit("$"), F.lit(":"))), "/"))
    return (
        F.when(inside("routes") & p.endswith("/+page.svelte"), segments(folder_of(after("routes")), ""))
        .when(inside("app") & p.rlike(r"/page\.(tsx|ts|jsx|js)$"), segments(folder_of(after("app")), "*"))
        .when(inside("app") & p.rlike(r"/route\.(tsx|ts|js)$"), segments(folder_of(after("app")), "*"))
        .when(inside("pages") & p.rlike(r"\.(tsx|ts|jsx|js)$"), F.when(~after("pages").rlike(r"^(api/|_app\.|_document\.|_error\.)"), segments(index(pages), "*")))
        .when(inside("pages") & p.endswith(".vue"), segments(index(nuxt), "*"))
        .when(inside("routes") & p.rlike(r"\.(tsx|ts|jsx|js)$"), remix)
    )
