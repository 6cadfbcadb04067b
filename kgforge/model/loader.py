"""Models, registries and settings from files."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any

from kgforge.sinks import storage

from .schema import LEVELS, TYPE_ALIASES, Endpoint, EntityType, Field, Model, ModelError, RelationshipType


def read_json(path: str | Path) -> Any:
    """JSON that may begin with a byte order mark; a key that is there twice is an error."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        out: dict = {}
        for k, v in pairs:
            if k in out:
                raise ModelError(f"{path}: key {k!r} twice")
            out[k] = v
        return out

    text = storage.read_text(str(path))
    if text is None:
        raise ModelError(f"{path}: not found")
    return json.loads(text, object_pairs_hook=once)


def only(given: dict, known: str, where: str) -> dict:
    if unknown := given.keys() - set(known.split()):
        raise ModelError(f"{where}: unknown {', '.join(sorted(unknown))}")
    return given


def listed(value: Any) -> tuple:
    return () if value is None else tuple(value) if isinstance(value, list) else (value,)


def by_level(value: Any, where: str) -> dict[str, Any]:
    """A value by level, or one for both; a level's case doesn't matter, but it may be there once only."""
    if not isinstance(value, dict):
        return {level: value for level in LEVELS} if value is not None else {}
    out = {k.upper(): v for k, v in value.items()}
    if len(out) < len(value):
        raise ModelError(f"{where}: a level twice")
    return out


def literal(value: Any, data_type: str) -> Any:
    return float(value) if data_type == "float" and isinstance(value, int) and not isinstance(value, bool) else value


def field_of(name: str, given: dict, where: str) -> Field:
    where = f"{where}.{name}"
    only(given, "data_type description required options examples regex min max default_value retrieval_mode merge_strategy instructions", where)
    kind = str(given.get("data_type", "")).lower()
    kind = TYPE_ALIASES.get(kind, kind)
    value = lambda x: literal(x, kind)
    level = lambda key, of=lambda x: x: {k: of(v) for k, v in by_level(given.get(key), where).items() if v is not None}
    return Field(
        name, kind, given.get("description", ""), bool(given.get("required", False)), tuple(map(value, listed(given.get("options")))), tuple(map(value, listed(given.get("examples")))), level("regex"),
        level("min", value), level("max", value), level("default_value", value), level("retrieval_mode", lambda x: str(x).upper()), given.get("merge_strategy"), level("instructions"),
    )


def model_of(given: dict) -> Model:
    only(given, "extraction_config entity_types relationship_types", "model")
    config = only(given.get("extraction_config", {}), "llm projection", "extraction_config")
    llm, projection = only(config.get("llm", {}), "domain language", "llm"), only(config.get("projection", {}), "enabled_entities enabled_relationships", "projection")
    entities, relationships = [], []
    for name, x in given.get("entity_types", {}).items():
        only(x, "description primary_key deduplication default_merge_strategy instructions document_collections fields", name)
        fields = tuple(field_of(n, f, name) for n, f in x.get("fields", {}).items())
        collections = {level: listed(v) for level, v in by_level(x.get("document_collections", {}), name).items()}
        entities.append(EntityType(name, x.get("primary_key", ""), fields, x.get("description", ""), collections, x.get("default_merge_strategy"), x.get("instructions") or ""))
    for name, x in given.get("relationship_types", {}).items():
        only(x, "description endpoints deduplication primary_key symmetric allow_self_relationships default_merge_strategy fields instructions", name)
        ends = []
        for source, targets in x.get("endpoints", {}).items():
            for target, rules in targets.items():
                pairs = {(str(a).upper(), str(b).upper()) for rule in listed(rules) for a in listed(rule.get("source_context_levels")) for b in listed(rule.get("target_context_levels"))}
                ends.append(Endpoint(source, target, tuple(sorted(pairs))))
        fields = tuple(field_of(n, f, name) for n, f in x.get("fields", {}).items())
        relationships.append(RelationshipType(name, tuple(ends), str(x.get("deduplication", "PRIMARY_KEY")).upper(), x.get("primary_key"), fields, bool(x.get("symmetric", False)), bool(x.get("allow_self_relationships", False)), x.get("description", ""), x.get("default_merge_strategy")))
    enabled = lambda k: None if projection.get(k) is None else tuple(projection[k])
    return Model(tuple(entities), tuple(relationships), llm.get("domain", ""), llm.get("language"), enabled("enabled_entities"), enabled("enabled_relationships"))


def load_model(path: str | Path) -> Model:
    return model_of(read_json(path))


MODES = {"file": "file", "directory": "directory", "dir": "directory", "recursive": "recursive", "tree": "recursive"}


def load_registry(path: str | Path) -> dict[str, list[dict]]:
    """Sources by collection."""
    given = only(read_json(path), "collections", str(path))
    return {name: [{"root": s["root"], "mode": MODES.get(str(s.get("mode", "recursive")).lower(), s.get("mode"))} for s in only(c, "sources", name)["sources"]] for name, c in given["collections"].items()}


DEFAULTS: dict[str, dict[str, Any]] = {
    # claim: contexts that are asked for at a time; 0 is all
    "pipeline": {"document_tokens": 8000, "claim": 0},
    "extractor": {"kind": "recorded", "path": ""},
    "chunking": {"target": 800, "overlap": None, "limit": None, "tokenizer": "whitespace"},
    "export": {"format": "csv", "path": "export"},
}


def load_settings(path: str | Path | None) -> dict[str, dict[str, Any]]:
    """Settings by section over the defaults; unknown ones are errors."""
    given = tomllib.loads(storage.read_text(str(path)) or "") if path else {}
    only(given, " ".join(DEFAULTS), str(path))
    for section, values in given.items():
        only(values, " ".join(DEFAULTS[section]), section)
    out = {s: {**d, **given.get(s, {})} for s, d in DEFAULTS.items()}
    if out["chunking"]["target"] < 1 or out["export"]["format"] not in ("csv", "lines"):
        raise ModelError("chunking.target is 1 or more, export.format is csv or lines")
    return out
