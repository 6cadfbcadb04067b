"""Response schemas within what a service takes: measured in one walk, and brought into a form that fits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    """The most that a service takes of each measure, and the forms of a schema to try, in order."""

    most: dict[str, int] = field(default_factory=dict)
    forms: tuple[Callable[[dict], dict], ...] = (lambda schema: schema,)


def below(schema: dict) -> list[dict]:
    """The schemas right below one."""
    items = schema.get("items")
    return [x for x in (*schema.get("properties", {}).values(), *schema.get("anyOf", ()), *schema.get("allOf", ()), items) if isinstance(x, dict)]


def measure(schema: dict, depth: int = 0) -> Counter:
    """Properties, optional ones, unions, nested objects, values of enums, letters in names and values, and letters of the largest long enum."""
    out: Counter = Counter()
    names, values = schema.get("properties", {}), schema.get("enum", [])
    texts = [v for v in values if isinstance(v, str)]
    is_object = bool(names) or schema.get("type") == "object"
    out["properties"] = len(names)
    out["optional"] = len(names.keys() - set(schema.get("required", ())))
    out["unions"] = int("anyOf" in schema or isinstance(schema.get("type"), list))
    out["enum_values"] = len(values)
    out["letters"] = sum(map(len, (*names, *schema.get("$defs", {}), *texts))) + len(str(schema.get("const", "")))
    out["long_enum_letters"] = sum(map(len, texts)) if len(texts) > LONG_ENUM else 0
    out["depth"] = depth + is_object
    parts = [measure(x, depth + is_object) for x in below(schema)] + [measure(x) for x in schema.get("$defs", {}).values()]
    for part in parts:
        for name, n in part.items():
            out[name] = max(out[name], n) if name in ("depth", "long_enum_letters") else out[name] + n
    return out


def rebuilt(schema: dict, change: Callable[[dict], dict]) -> dict:
    """A schema with change made to it and to all schemas below, from the bottom up."""
    out = dict(schema)
    for key in ("properties", "$defs"):
        if key in out:
            out[key] = {name: rebuilt(x, change) if isinstance(x, dict) else x for name, x in out[key].items()}
    for key in ("anyOf", "allOf"):
        if key in out:
            out[key] = [rebuilt(x, change) if isinstance(x, dict) else x for x in out[key]]
    if isinstance(out.get("items"), dict):
        out["items"] = rebuilt(out["items"], change)
    return change(out)


def can_be_null(schema: dict) -> bool:
    return isinstance(schema.get("type"), list) and "null" in schema["type"]


def untyped_enums(schema: dict) -> dict:
    """Options that may be null lose their type."""
    return rebuilt(schema, lambda x: {k: v for k, v in x.items() if k != "type"} if "enum" in x and can_be_null(x) else x)


def optional_for_null(schema: dict) -> dict:
    """What may be null may be left out instead."""

    def bare(x: dict) -> dict:
        kinds = [t for t in x["type"] if t != "null"]
        out = x | {"type": kinds[0] if len(kinds) == 1 else kinds}
        return out | {"enum": [v for v in x["enum"] if v is not None]} if "enum" in x else out

    def change(x: dict) -> dict:
        loose = {n for n, p in x.get("properties", {}).items() if can_be_null(p) and len(p["type"]) > 1}
        out = x | {"properties": {n: bare(p) if n in loose else p for n, p in x["properties"].items()}} if loose else x
        return out | {"required": [n for n in x["required"] if n not in loose]} if loose and "required" in x else out

    return rebuilt(schema, change)


# What the two known kinds of services document.
LONG_ENUM = 250
LARGE = Limits({"properties": 5000, "depth": 10, "enum_values": 1000, "letters": 120_000, "long_enum_letters": 15_000})
SMALL = Limits({"optional": 24, "unions": 16}, (untyped_enums, optional_for_null))


def fitted(schema: dict, limits: Limits) -> dict | None:
    """The first form within the limits; none if there isn't any, and the answer's form is left to the prompt."""
    for form in limits.forms:
        out = form(schema)
        found = measure(out)
        if all(found[name] <= n for name, n in limits.most.items()):
            return out
    return None
