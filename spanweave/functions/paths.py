"""Functions on paths, whose components `/` and `:` separate, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = "/:"


def _last_is_separator(path: Column) -> Column:
    return F.substring(path, -1, 1).isin("/", ":")


def _begins(path: Column, other: Column) -> Column:
    return (other != "") & (F.length(path) > F.length(other)) & path.startswith(other)


def is_descendant_of(path: Column, ancestor: Column) -> Column:
    """path lies below ancestor, at a separator."""
    after = path.substr(F.length(ancestor) + 1, F.length(path))
    return _begins(path, ancestor) & (_last_is_separator(ancestor) | (after.substr(1, 1).isin("/", ":") & (F.length(after) > 1)))


def is_ancestor_of(path: Column, descendant: Column) -> Column:
    return is_descendant_of(descendant, path)


def is_child_of(path: Column, parent: Column) -> Column:
    """path is one component below parent. A parent that ends in a separator may be the whole of a path but its last name."""
    after = path.substr(F.length(parent) + 1, F.length(path))
    return _begins(path, parent) & F.when(_last_is_separator(parent), ~after.rlike("[/:]")).otherwise(after.rlike("^[/:][^/:]+$"))


def is_parent_of(path: Column, child: Column) -> Column:
    return is_child_of(child, path)


def parent_of(path: Column) -> Column:
    """All before the last separator; empty if that is the first character."""
    return F.regexp_extract(path, "^(.+)[/:][^/:]*$", 1)


def ancestors_of(path: Column) -> Column:
    """All paths above path, the root first; none above the root."""
    none = F.array().cast("array<string>")
    longer = lambda found, part: F.concat(found, F.array(F.concat(F.coalesce(F.get(found, F.size(found) - 1), F.lit("")), part)))
    inner = F.aggregate(F.split(path, "(?=[/:])"), none, longer, lambda found: F.slice(found, 1, F.size(found) - 1))
    return F.concat(F.when((_leading(path) != "") & (F.length(path) > 1), F.array(_leading(path))).otherwise(none), inner)


def depth_of(path: Column) -> Column:
    """The number of ancestors_of(path), by counting separators."""
    return F.when(F.length(path) > 1, F.length(path) - F.length(F.translate(path, "/:", ""))).otherwise(F.when(path.isNotNull(), 0))


def nearest_above(path: Column) -> Column:
    """The last of ancestors_of(path); null above the root."""
    inner = F.regexp_extract(path, r"(?s)^(.+)[/:][^/:]*$", 1)
    return F.when(inner != "", inner).when((_leading(path) != "") & (F.length(path) > 1), _leading(path))


def _rounded(n: Column) -> Column:
    """Half goes up, below zero too."""
    return F.floor(n + 0.5).cast("int")


def _leading(path: Column) -> Column:
    return F.when(path.substr(1, 1).isin("/", ":"), path.substr(1, 1)).otherwise("")


def _cuts(path: Column, first: int, last: Column) -> Column:
    """Places (from 1) of the separators between the characters first and last."""
    places = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: path.substr(i, F.lit(1)).isin("/", ":"))


def path_prefix(path: Column, n: Column | float) -> Column:
    """The first n components; for n below zero all but the last -n; for zero the leading separator."""
    n = _rounded(F.lit(n) if not isinstance(n, Column) else n)
    inner, most = _cuts(path, 2, F.length(path)), _cuts(path, 2, F.length(path) - 1)
    upto = lambda cut: path.substr(F.lit(1), cut - 1)
    return (
        F.when(path == "", "")
        .when(n == 0, _leading(path))
        .when(n > 0, F.when(F.size(inner) >= n, upto(F.get(inner, n - 1))).otherwise(path))
        .otherwise(F.when(F.size(most) >= -n, upto(F.get(most, F.size(most) + n))).otherwise(_leading(path)))
    )


def path_suffix(path: Column, n: Column | float) -> Column:
    """The last n components; for n below zero all but the first -n; for zero nothing."""
    n = _rounded(F.lit(n) if not isinstance(n, Column) else n)
    most, inner = _cuts(path, 1, F.length(path) - 1), _cuts(path, 2, F.length(path))
    after = lambda cut: path.substr(cut + 1, F.length(path))
    return (
        F.when(n == 0, "")
        .when(n > 0, F.when(F.size(most) >= n, after(F.get(most, F.size(most) - n))).otherwise(path))
        .otherwise(F.when(F.size(inner) >= -n, after(F.get(inner, -n - 1))).otherwise(""))
    )


def glob_regex(pattern: str) -> str:
    """`*` stands for any characters of one component, `**` for any at all; the rest for itself."""
    parts = ["[^/]*".join(map(re.escape, part.split("*"))) for part in pattern.split("**")]
    return "^(?s:" + ".*".join(parts) + r")\z"


def matches(path: Column, pattern: str) -> Column:
    """The whole path fits the glob."""
    return path.rlike(glob_regex(pattern))


# Whole paths, whose components `/` separates


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def components(path: Column) -> Column:
    """The components between separators; several separators count as one, one at the end as none."""
    return F.filter(F.split(path, "/"), lambda c: c != "")


def _joined(absolute: Column, parts: Column) -> Column:
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))


def _leads_out(path: Column) -> Column:
    """An absolute path that asks for the parent of the root, at some component."""
    step = lambda c: F.when(c == ".", 0).when(c == "..", -1).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    moved = lambda a, c: F.struct((a["depth"] + step(c)).alias("depth"), F.least(a["least"], a["depth"] + step(c)).alias("least"))
    return is_absolute(path) & (F.aggregate(components(path), start, moved)["least"] < 0)


def canonical(path: Column) -> Column:
    """path without `.` and, where a component precedes it, `..`; leading `..` of a relative path stay. Null if an absolute path leads out of the root."""
    none = F.array().cast("array<string>")

    def add(parts: Column, c: Column) -> Column:
        goes_up = (F.size(parts) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), parts), -1) != "..")
        return F.when(c == ".", parts).when((c == "..") & goes_up, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.concat(parts, F.array(c)))

    return F.when(~_leads_out(path), _joined(is_absolute(path), F.aggregate(components(path), none, add)))


def resolve(path: Column, other: Column) -> Column:
    """other if it is absolute, else other below path; not made canonical."""
    return F.when(is_absolute(other), _joined(F.lit(True), components(other))).otherwise(_joined(is_absolute(path), F.concat(components(path), components(other))))


def contains(path: Column, other: Column) -> Column:
    """other is path or lies below it, both in canonical form."""
    a, b = components(canonical(path)), components(canonical(other))
    return (is_absolute(path) == is_absolute(other)) & (F.size(a) <= F.size(b)) & (F.slice(b, 1, F.size(a)) == a)


def order_key(path: Column) -> Column:
    """Sorts absolute paths first, then by components, a path before those below it."""
    return F.struct((~is_absolute(path)).alias("relative"), components(path).alias("components"))
