"""The registered sources, kept in a JSON file."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path

from pagestrata import schemas
from pagestrata.functions.given import first_given  # noqa: F401  the order in which settings hold


@dataclass(frozen=True)
class Source:
    """One registered site or repository."""

    name: str
    entry_url: str | None = None
    source_kind: str = "auto"
    repo_url: str | None = None
    docs_path: str | None = None
    default_ref: str | None = None
    version_strategy: str = "auto"
    proxy_url: str | None = None
    browser_cmd: str | None = None
    auto_import: bool = False
    import_command: str | None = None
    import_all_pages: bool = False
    import_low_signal: bool = False
    tags: list[str] = field(default_factory=list)
    created_at: str = ""
    updated_at: str = ""


class Registry:
    """Reads and writes the registry; a missing file is an empty registry."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.sources: dict[str, Source] = {}
        self.version = schemas.CONFIG_VERSION + 1
        if self.path.exists():
            held = json.loads(self.path.read_text())
            known = Source.__dataclass_fields__
            self.version = held.get("schema_version", self.version)
            self.sources = {n: Source(**{k: v for k, v in s.items() if k in known} | {"name": n}) for n, s in held.get("sources", {}).items()}

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps({"schema_version": self.version, "sources": {s.name: asdict(s) for s in self.list()}}, indent=2))

    def add(self, source: Source) -> Source:
        """Registers a source; its name must be new and of lower-case letters, digits, dashes and underscores."""
        if not re.fullmatch(r"[a-z0-9_-]+", source.name):
            raise ValueError(f"{source.name!r} isn't a source name")
        if source.name in self.sources:
            raise ValueError(f"{source.name} is registered already")
        if source.source_kind not in schemas.SOURCE_KINDS or source.version_strategy not in schemas.VERSION_STRATEGIES:
            raise ValueError("unknown source kind or version strategy")
        if source.source_kind == "git_docs" and not source.repo_url:
            raise ValueError("a git source needs the address of its repository")
        now = datetime.now(UTC).isoformat()
        tags = sorted({t.strip().lower() for t in source.tags} - {""})
        self.sources[source.name] = made = replace(source, tags=tags, created_at=now, updated_at=now)
        self.save()
        return made

    def list(self) -> list[Source]:
        return [self.sources[n] for n in sorted(self.sources)]

    def get(self, name: str) -> Source:
        if name not in self.sources:
            raise LookupError(f"no source {name}")
        return self.sources[name]

    def set_auto_import(self, name: str, command: str | None = None, all_pages: bool = False, low_signal: bool = False, on: bool = True) -> Source:
        """Sets automatic import; what isn't given is reset, not kept."""
        changed = replace(self.get(name), auto_import=on, import_command=command, import_all_pages=all_pages, import_low_signal=low_signal, updated_at=datetime.now(UTC).isoformat())
        self.sources[name] = changed
        self.save()
        return changed

    def migrate(self) -> bool:
        """Brings an old file to the version that configs are brought to; tells whether it changed."""
        old = self.version < schemas.CONFIG_VERSION
        if old:
            self.version = schemas.CONFIG_VERSION
            self.save()
        return old
