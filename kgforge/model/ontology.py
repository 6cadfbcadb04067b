"""Models from benchmark ontologies: concepts become entity types, relations become relationship types."""

from __future__ import annotations

import re

VALUE = "Value"


def pascal(text: str) -> str:
    name = "".join(w[0].upper() + w[1:] for w in re.findall(r"[A-Za-z0-9]+", text))
    return (f"X{name}" if name[:1].isdigit() else name)[:64]


def compile_ontology(ontology: dict, collection: str = "sentences", literals_as_fields: bool = False) -> dict:
    """A model as the loader reads it. A range that is no concept becomes the type Value, or, if asked, a field of the domain's type."""
    labels = {c["qid"]: c["label"] for c in ontology["concepts"]}
    field = {"name": {"data_type": "string", "required": True, "description": "its name as the text has it"}}
    entities = {pascal(label): {"description": f"A {label}", "primary_key": "name", "document_collections": {"chunk": collection}, "fields": dict(field)} for label in labels.values()}
    relations: dict[str, dict] = {}
    rule = {"source_context_levels": "chunk", "target_context_levels": "chunk"}
    for r in ontology["relations"]:
        source, target = (pascal(labels[x]) if x in labels else VALUE for x in (r.get("domain"), r.get("range")))
        if target == VALUE and literals_as_fields and source != VALUE:
            entities[source]["fields"][re.sub(r"[^a-z0-9]+", "_", r["label"].lower()).strip("_")[:64]] = {"data_type": "string", "description": r["label"]}
            continue
        if VALUE in (source, target):
            entities.setdefault(VALUE, {"description": "A date, number or name of no other type", "primary_key": "name", "document_collections": {"chunk": collection}, "fields": dict(field)})
        own = relations.setdefault(pascal(r["label"]), {"description": r["label"], "endpoints": {}, "deduplication": "endpoints"})
        own["endpoints"].setdefault(source, {})[target] = rule
    return {"extraction_config": {"llm": {"domain": ontology.get("title", "")}}, "entity_types": entities, "relationship_types": relations}
