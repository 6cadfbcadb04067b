"""What turns a request into a response. Any function of (requests) to (responses) will do; these two need no network.

requests: job_id, task, context_level, context_id, types, prompt, text; responses: job_id, content, error_class, token counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgforge.session import ship
from kgforge.sources.tables import jsonl

Extractor = Callable[[DataFrame], DataFrame]
TOKENS = "input_tokens long, cached_tokens long, cache_write_tokens long, output_tokens long, reasoning_tokens long"
RESPONSE = f"job_id string, content string, error_class string, {TOKENS}"


class Recorded:
    """Responses that were written down, by job; a job without one gets none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = jsonl(spark, path, RESPONSE)

    def __call__(self, requests: DataFrame) -> DataFrame:
        return self.rows.join(requests.select("job_id"), "job_id", "left_semi")


class Rules:
    """Entities and relationships by patterns.

    entities: by type, a pattern whose named groups are the fields; relationships: by type, source type, target type and a pattern with
    groups source and target, which hold the entities' keys, and others for fields.
    """

    def __init__(self, entities: dict[str, str], relationships: dict[str, tuple[str, str, str]] | None = None) -> None:
        self.entities, self.relationships = entities, relationships or {}

    def __call__(self, requests: DataFrame) -> DataFrame:
        ship(requests.sparkSession)
        entities, links = self.entities, self.relationships

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = {t: re.compile(p) for t, p in entities.items()}
            tied = {t: (a, b, re.compile(p)) for t, (a, b, p) in links.items()}
            for batch in batches:
                out = []
                for job, task, types, candidates, text in zip(batch["job_id"], batch["task"], batch["types"], batch["candidates"], batch["text"], strict=True):
                    if task == "entities":
                        said = {"entities": [{"_entity_type": t, **m.groupdict()} for t in types if t in found for m in found[t].finditer(text or "")]}
                    else:
                        names = {(c["entity_type_name"], c["name"].casefold()): c["temp_id"] for c in candidates if c["name"]}
                        said = {"relationships": []}
                        for t in types:
                            if t in tied:
                                a, b, pattern = tied[t]
                                for m in pattern.finditer(text or ""):
                                    x = m.groupdict()
                                    ends = names.get((a, x.pop("source").casefold())), names.get((b, x.pop("target").casefold()))
                                    if all(ends):
                                        said["relationships"].append({"_relationship_type": t, "_source_entity_id": ends[0], "_target_entity_id": ends[1], **x})
                    size = len((text or "").split())
                    out.append((job, json.dumps(said), None, size, 0, 0, sum(map(len, said.values())), 0))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RESPONSE.split(", ")])

        return requests.select("job_id", "task", "types", "candidates", "text").mapInPandas(run, RESPONSE)


def entity_prompt(model) -> str:
    """The part that all requests for entities share: task, types, fields. Wording is ours."""
    lines = ["Find the entities of the types below that the text states. Answer with JSON: {\"entities\": [{\"_entity_type\": ..., fields}]}.", f"Domain: {model.domain}" if model.domain else ""]
    for t in sorted(model.active_entities, key=lambda t: t.name):
        lines.append(f"- {t.name}: {t.description} (known by {t.primary_key}) {t.instructions}".rstrip())
        lines += [field_line(f) for f in sorted(t.fields, key=lambda f: (not f.required, f.name)) if f.mode() == "EXTRACT"]
    return "\n".join(x for x in lines if x)


def relationship_prompt(model) -> str:
    lines = ["Find the relationships of the types below between the listed entities that the text states. Answer with JSON: {\"relationships\": [{\"_relationship_type\": ..., \"_source_entity_id\": \"E1\", \"_target_entity_id\": \"E2\", fields}]}."]
    for r in sorted(model.active_relationships, key=lambda r: r.name):
        lines.append(f"- {r.name}: {r.description} ({'; '.join(f'{e.source} to {e.target}' for e in r.endpoints)}{', either way round' if r.symmetric else ''})")
        lines += [field_line(f) for f in sorted(r.fields, key=lambda f: (not f.required, f.name)) if f.mode() == "EXTRACT"]
    return "\n".join(lines)


def field_line(f) -> str:
    notes = [f.data_type, "required" if f.required else "", f"one of {', '.join(map(str, f.options))}" if f.options else "", f"like {', '.join(map(str, f.examples))}" if f.examples else ""]
    # what is said of one level only is marked as such
    said = [*f.instructions.values()][:1] if len({*f.instructions.values()}) == 1 and len(f.instructions) == 2 else [f"({level.lower()}) {text}" for level, text in sorted(f.instructions.items()) if text]
    return f"  - {f.name} ({'; '.join(n for n in notes if n)}): {f.description} {' '.join(said)}".rstrip()


def response_schema(types, marker: str, key: str, ends: bool = False) -> dict:
    """The JSON schema that a response has to meet."""
    kinds = {"string": "string", "integer": "integer", "float": "number", "boolean": "boolean", "date": "string"}

    def of(f) -> dict:
        out: dict = {"type": kinds[f.data_type] if f.required else [kinds[f.data_type], "null"]}
        if f.options:
            out["enum"] = [*f.options, *([] if f.required else [None])]
        if f.data_type == "date":
            out["pattern"] = r"^\d{4}(-\d{2}(-\d{2})?)?$"
        return out

    def item(t) -> dict:
        props = {marker: {"const": t.name}} | ({"_source_entity_id": {"type": "string"}, "_target_entity_id": {"type": "string"}} if ends else {}) | {f.name: of(f) for f in t.fields if f.mode() == "EXTRACT"}
        return {"type": "object", "properties": props, "required": [*props], "additionalProperties": False}

    return {"type": "object", "properties": {key: {"type": "array", "items": {"anyOf": [item(t) for t in types]}}}, "required": [key], "additionalProperties": False}


def prompts(requests: DataFrame, shared: str) -> DataFrame:
    """The shared part first, so that a provider can keep it; then the candidates, then the text."""
    known = F.when(F.size("candidates") > 0, F.concat(F.lit("\n\nEntities:\n"), F.array_join(F.transform("candidates", lambda c: F.concat_ws(" ", c["temp_id"], c["entity_type_name"], c["name"])), "\n"))).otherwise("")
    return requests.withColumn("prompt", F.concat(F.lit(shared), known, F.lit("\n\nText:\n"), F.col("text")))
