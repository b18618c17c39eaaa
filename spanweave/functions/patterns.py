"""Path patterns, compiled component by component.

`.` stays, `..` goes to the parent, `**` stands for all that lies below (not the node itself), and any other component for
children by name: `*` for any characters but brackets, in the name and in the tags, which brackets enclose. A component
without tags fits whatever the tags are. A pattern that starts with `/` starts at the root.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Fixed value: what a component may look like.
COMPONENT = re.compile(r"^([^/:\[\]]+)(\[[^/:\[\]]+\])?$")
ANY_TAGS = r"(?:\[[^\[\]]*\])?"


class InvalidPattern(ValueError):
    """A component that cannot be read."""


def _globbed(text: str) -> str:
    return r"[^\[\]/:]*".join(map(re.escape, text.split("*")))


def component_regex(component: str) -> str:
    """Fits a node's last component, tags included."""
    found = COMPONENT.match(component)
    if not found or "**" in component:
        raise InvalidPattern(f"cannot read the component {component!r} of a path pattern")
    name, tags = found.groups()
    return _globbed(name) + (r"\[" + r"[^\[\]]*".join(map(re.escape, tags[1:-1].split("*"))) + r"\]" if tags else ANY_TAGS)


@dataclass(frozen=True)
class Step:
    """Go up `up` levels, then to the nodes whose path below the place reached fits regex (null: none); depth is the number of
    components that it fits, null if there is no single one."""

    up: int
    regex: str | None
    depth: int | None


def compile_pattern(pattern: str) -> tuple[bool, list[Step]]:
    """Whether a pattern starts at the root, and its steps."""
    absolute, steps, up, parts = pattern.startswith("/"), [], 0, []

    def close() -> None:
        nonlocal up, parts
        if up or parts:
            deep = any(p is None for p in parts)
            regex = "".join("(?:/[^/:]+)+" if p is None else f"/{p}" for p in parts)
            steps.append(Step(up, regex if parts else None, None if deep else len(parts)))
        up, parts = 0, []

    for component in filter(None, pattern.split("/")):
        if component == ".":
            continue
        if component == "..":
            if parts:
                close()
            up += 1
        else:
            parts.append(None if component == "**" else component_regex(component))
    close()
    return absolute, steps


def metric_regex(name: str) -> str:
    """A metric's name, `*` standing for any characters."""
    return r"\A" + ".*".join(map(re.escape, name.split("*"))) + r"\z"
