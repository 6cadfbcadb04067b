"""The declared schema of a knowledge graph: types, fields, endpoints, and what makes a declaration valid."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from typing import Any

from kgforge.functions.values import MAX_FLOAT, MAX_INTEGER
from kgforge.operators.merge import STRATEGIES, strategy_name

# Names, levels, modes, policies and aliases that models are written with.
TYPE_NAME, FIELD_NAME, COLLECTION_NAME = re.compile(r"[A-Z][a-zA-Z0-9]{0,63}"), re.compile(r"[a-z][a-z0-9_]{0,63}"), re.compile(r"[a-zA-Z0-9][a-zA-Z0-9._-]{0,63}")
RESERVED = {"document", "chunk", "chunkof", "extractedfrom", "true", "false"}
LEVELS = ("CHUNK", "DOCUMENT")
MODES = ("EXTRACT", "DEFAULT", "SKIP")
POLICIES = ("PRIMARY_KEY", "ENDPOINTS", "NONE")
TYPE_ALIASES = {"str": "string", "text": "string", "int": "integer", "double": "float", "number": "float", "decimal": "float", "bool": "boolean"}
DEFAULT_STRATEGY = "keep"


class ModelError(ValueError):
    """All that is wrong with a model, at once."""


def partial_date(text: Any) -> bool:
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}(-\d{2}(-\d{2})?)?", text):
        return False
    y, m, d = (int(x) for x in (text + "-01-01")[:10].split("-"))
    try:
        datetime.date(y, m, d)
    except ValueError:
        return False
    return True


def has_type(value: Any, data_type: str) -> bool:
    return {
        "string": lambda: isinstance(value, str),
        "integer": lambda: isinstance(value, int) and not isinstance(value, bool) and abs(value) <= MAX_INTEGER,
        "float": lambda: isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) <= MAX_FLOAT,
        "boolean": lambda: isinstance(value, bool),
        "date": lambda: partial_date(value),
    }[data_type]()


@dataclass(frozen=True)
class Field:
    """A field; regex, least, most, default, modes and instructions are by context level, with an entry for each level that has one."""

    name: str
    data_type: str
    description: str = ""
    required: bool = False
    options: tuple = ()
    examples: tuple = ()
    regex: dict[str, str] = field(default_factory=dict, hash=False)
    least: dict[str, Any] = field(default_factory=dict, hash=False)
    most: dict[str, Any] = field(default_factory=dict, hash=False)
    default: dict[str, Any] = field(default_factory=dict, hash=False)
    modes: dict[str, str] = field(default_factory=dict, hash=False)
    strategy: str | None = None
    instructions: dict[str, str] = field(default_factory=dict, hash=False)

    def mode(self, level: str = "CHUNK") -> str:
        return self.modes.get(level, "EXTRACT")

    def alike_at_all_levels(self) -> bool:
        return all(len({str(x.get(level)) for level in LEVELS}) == 1 for x in (self.regex, self.least, self.most, self.default, self.modes))

    def allows(self, value: Any, level: str) -> bool:
        pattern, least, most = (x.get(level) for x in (self.regex, self.least, self.most))
        return (
            has_type(value, self.data_type) and (not self.options or value in self.options) and (pattern is None or re.fullmatch(pattern, value) is not None)
            and (least is None or value >= least) and (most is None or value <= most)
        )

    def faults(self) -> list[str]:
        out, t = [], self.data_type
        if not FIELD_NAME.fullmatch(self.name) or self.name in RESERVED:
            out.append("not a field's name")
        if t not in STRATEGIES:
            return [*out, f"no data type {t}"]
        out += sorted({f"no level {x}" for given in (self.regex, self.least, self.most, self.default, self.modes, self.instructions) for x in given if x not in LEVELS})
        if self.regex and t != "string":
            out.append("a pattern is for strings")
        for pattern in self.regex.values():
            try:
                re.compile(pattern)
            except re.error as e:
                out.append(f"pattern: {e}")
        if (self.least or self.most) and t not in ("integer", "float", "date"):
            out.append("bounds are for integers, floats and dates")
        elif any(self.least[x] > self.most[x] for x in self.least.keys() & self.most.keys()):
            out.append("its least value is above its most")
        for level in LEVELS:
            mode = self.mode(level)
            if mode not in MODES:
                out.append(f"no retrieval mode {mode}")
            elif mode == "DEFAULT" and self.default.get(level) is None:
                out.append("mode DEFAULT without a default")
        if not out:
            out += [f"{x!r} is not allowed" for x in self.examples if not any(self.allows(x, level) for level in LEVELS)]
            out += [f"{x!r} is not allowed" for level, x in self.default.items() if not self.allows(x, level)]
        if self.strategy and strategy_name(self.strategy) not in STRATEGIES[t]:
            out.append(f"{self.strategy} is no strategy for {t}")
        return out


@dataclass(frozen=True)
class EntityType:
    name: str
    primary_key: str
    fields: tuple[Field, ...]
    description: str = ""
    collections: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    strategy: str | None = None
    instructions: str = ""

    def faults(self) -> list[str]:
        out = [f"field {f.name}: {x}" for f in self.fields for x in f.faults()]
        if not TYPE_NAME.fullmatch(self.name) or self.name.lower() in RESERVED:
            out.append("not a type's name")
        pk = next((f for f in self.fields if f.name == self.primary_key), None)
        out += key_faults(pk, self.primary_key)
        out += strategy_faults(self.strategy, self.fields)
        out += [f"no level {x}" for x in self.collections if x not in LEVELS]
        out += [f"{c}: not a collection's name" for names in self.collections.values() for c in names if not COLLECTION_NAME.fullmatch(c)]
        return out


def key_faults(pk: Field | None, name: str) -> list[str]:
    if pk is None:
        return [f"no field {name} for its primary key"]
    out = []
    if pk.data_type in ("float", "boolean"):
        out.append("a primary key is no float or boolean")
    if not pk.required or pk.default or any(m != "EXTRACT" for m in pk.modes.values()):
        out.append("a primary key is required, extracted everywhere, and has no default")
    return out


def strategy_faults(strategy: str | None, fields: tuple[Field, ...]) -> list[str]:
    if strategy is None:
        return []
    return [f"{strategy} is no strategy for field {f.name}" for f in fields if f.strategy is None and f.data_type in STRATEGIES and strategy_name(strategy) not in STRATEGIES[f.data_type]]


@dataclass(frozen=True)
class Endpoint:
    source: str
    target: str
    levels: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class RelationshipType:
    name: str
    endpoints: tuple[Endpoint, ...]
    policy: str = "PRIMARY_KEY"
    primary_key: str | None = None
    fields: tuple[Field, ...] = ()
    symmetric: bool = False
    allow_self: bool = False
    description: str = ""
    strategy: str | None = None

    def faults(self) -> list[str]:
        out = [f"field {f.name}: {x}" for f in self.fields for x in f.faults()]
        if not TYPE_NAME.fullmatch(self.name) or self.name.lower() in RESERVED:
            out.append("not a type's name")
        if self.policy not in POLICIES:
            out.append(f"no policy {self.policy}")
        if self.policy == "PRIMARY_KEY":
            out += key_faults(next((f for f in self.fields if f.name == self.primary_key), None), str(self.primary_key))
        if self.allow_self and not any(e.source == e.target for e in self.endpoints):
            out.append("no endpoint joins a type with itself")
        for e in self.endpoints:
            out += [f"{e.source} to {e.target}: no pair of levels {a}, {b}" for a, b in e.levels if a not in LEVELS or b not in LEVELS or a == b == "DOCUMENT"]
        return out + strategy_faults(self.strategy, self.fields)


@dataclass(frozen=True)
class Model:
    entity_types: tuple[EntityType, ...]
    relationship_types: tuple[RelationshipType, ...] = ()
    domain: str = ""
    language: str | None = None
    enabled_entities: tuple[str, ...] | None = None
    enabled_relationships: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        faults = [f"{t.name}: {x}" for t in (*self.entity_types, *self.relationship_types) for x in t.faults()]
        known = {t.name for t in self.entity_types}
        faults += [f"{r.name}: no entity type {x}" for r in self.relationship_types for e in r.endpoints for x in (e.source, e.target) if x not in known]
        faults += [f"no entity type {x} to enable" for x in self.enabled_entities or () if x not in known]
        faults += [f"no relationship type {x} to enable" for x in self.enabled_relationships or () if x not in {r.name for r in self.relationship_types}]
        if faults:
            raise ModelError("; ".join(faults))

    @property
    def active_entities(self) -> list[EntityType]:
        return [t for t in self.entity_types if self.enabled_entities is None or t.name in self.enabled_entities]

    @property
    def active_relationships(self) -> list[RelationshipType]:
        """Enabled ones of which some endpoint has both its types active."""
        on = {t.name for t in self.active_entities}
        return [r for r in self.relationship_types if (self.enabled_relationships is None or r.name in self.enabled_relationships) and any({e.source, e.target} <= on for e in r.endpoints)]

    def warnings(self) -> list[str]:
        looked_for = {t.name for t in self.active_entities if any(t.collections.values())}
        return [f"{t.name} is looked for in no collection" for t in self.active_entities if t.name not in looked_for] + [f"{r.name} can't be found" for r in self.active_relationships if not any({e.source, e.target} <= looked_for for e in r.endpoints)]

    def entity(self, name: str) -> EntityType:
        return next(t for t in self.entity_types if t.name == name)

    # Tables for planning; a row a declared type or pair.
    def type_rows(self) -> list[tuple[str, str, str]]:
        """(context_level, entity_type_name, collection_name)"""
        return [(level, t.name, c) for t in self.active_entities for level, names in t.collections.items() for c in names]

    def endpoint_rows(self) -> list[tuple[str, str, str, str, str, bool]]:
        """(relationship_type_name, source_type, target_type, source_level, target_level, symmetric)"""
        return [(r.name, e.source, e.target, a, b, r.symmetric) for r in self.active_relationships for e in r.endpoints for a, b in e.levels]
