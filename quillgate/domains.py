"""Several catalogs side by side, each with its sources, known by an id."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from quillgate.plans.catalog import Catalog
from quillgate.session import Source
from quillgate.sources.readers import source


@dataclass(frozen=True)
class Domain:
    id: str
    catalog: Catalog
    sources: dict[str, Source]


def load(folder: str | Path) -> dict[str, Domain]:
    """Each ``ID/catalog.json`` with ``ID/sources.json`` (table: path, or the settings of a reader)."""
    out = {}
    for path in sorted(Path(folder).glob("*/catalog.json")):
        catalog = Catalog.from_json_file(str(path))
        given = json.loads(path.with_name("sources.json").read_text(encoding="utf-8"))
        if lost := sorted(set(catalog.by_name) - set(given)):
            raise ValueError(f"domain {path.parent.name}: no source for {lost}")
        out[path.parent.name] = Domain(path.parent.name, catalog, {t: s if isinstance(s, str) else source(s) for t, s in given.items()})
    return out
