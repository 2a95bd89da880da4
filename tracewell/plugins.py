"""Plugins: manifests, trust, activation, and the registry of what reads, judges and writes items.

Analyzers are expressions wherever they can be: those that apply to a table are evaluated together
in one pass over it. Analyzers of whole payloads and other kinds are functions of a DataFrame.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import listing, rules
from .sources import frames, sinks

#: Policies by name: which manifests they let run (fixed values).
POLICIES: dict[str, Callable[[Manifest], bool]] = {
    "CoreOnly": lambda m: False,
    "CoreAndOpenSource": lambda m: m.open_source,
    "CoreAndSigned": lambda m: m.signature is not None,
    "Full": lambda m: True,
}


@dataclass(frozen=True)
class Manifest:
    id: str
    name: str
    version: str
    author: str
    license: str
    folder: Path
    open_source: bool = False
    signature: str | None = None
    category: str = "Unknown"
    capabilities: tuple[str, ...] = ()
    module: str | None = None
    entry: str | None = None


def read_manifest(path: Path) -> Manifest:
    """The manifest in a JSON file; keys in any case. One that lacks a required text is an error."""
    told = {k.lower(): v for k, v in json.loads(path.read_text("utf-8")).items()}
    required = {k: told[k] for k in ("id", "name", "version", "author", "license")}
    if not all(isinstance(v, str) for v in required.values()):
        raise ValueError(f"{path}: a required field is no text")
    return Manifest(
        **required, folder=path.parent, open_source=told.get("isopensource") is True, signature=told.get("signatureinfo"), category=str(told.get("category") or "Unknown"),
        capabilities=tuple(told.get("capabilities") or ()), module=told.get("assemblyname"), entry=told.get("entrytypename"),
    )


def discover(folder: str) -> list[Manifest]:
    """Manifests of all ``plugin.json`` under a folder of the driver; a bad one is skipped, a missing folder has none."""
    out = []
    for path in sorted(Path(folder).rglob("plugin.json")):
        try:
            out.append(read_manifest(path))
        except (OSError, ValueError, KeyError, AttributeError, TypeError):
            continue
    return out


def permitted(manifests: Iterable[Manifest], policy: str) -> list[Manifest]:
    """Those that a policy lets run; an unknown policy lets none."""
    return [m for m in manifests if POLICIES.get(policy, POLICIES["CoreOnly"])(m)]


def activate(manifest: Manifest, kind: type) -> Any | None:
    """An instance of the manifest's entry, made without arguments, if it is of ``kind``; None on any failure.

    The module is a Python file in the manifest's own folder.
    """
    if not manifest.module or not manifest.entry:
        return None
    path = (manifest.folder / manifest.module).resolve()
    if not path.is_file() or manifest.folder.resolve() not in path.parents:
        return None
    try:
        spec = importlib.util.spec_from_file_location(f"plugin_{manifest.id}".replace(".", "_").replace("-", "_"), path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        made = getattr(module, manifest.entry)()
    except Exception:  # a plugin can fail in any way, and must not end the session
        return None
    return made if isinstance(made, kind) else None


Columns = dict[str, Column]


@dataclass(frozen=True)
class Analyzer:
    """Findings of a row as expressions over the columns that it needs; ``supports`` says to which rows it applies."""

    id: str
    name: str
    cost: int
    needs: tuple[str, ...]
    rules: Callable[[Columns], list[Column]]
    supports: Callable[[Columns], Column] | None = None

    def structs(self, c: Columns) -> list[Column]:
        made = self.rules(c)
        return [F.when(self.supports(c), r) for r in made] if self.supports else made


@dataclass(frozen=True)
class Processor:
    """A DataFrame of items to result rows; ``evidence_safe`` where it leaves its inputs as they are."""

    id: str
    name: str
    run: Callable[..., DataFrame]
    evidence_safe: bool = True


@dataclass(frozen=True)
class Exporter:
    id: str
    name: str
    formats: tuple[str, ...]
    run: Callable[..., DataFrame]


@dataclass(frozen=True)
class Source:
    """A path to rows of items: files of the named extensions through a parser, or files as they are."""

    id: str
    parser: str | None = None
    extensions: tuple[str, ...] = ()

    def open(self, spark, path: str, recursive: bool = True) -> DataFrame:
        df = frames.files(spark, path, recursive)
        if self.extensions:
            df = df.where(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).isin(*self.extensions))
        if self.id == "iphone-backup":
            return frames.backup_manifest(df)
        return frames.parse(df, self.parser) if self.parser else df.drop("content")


def _extension(c: Columns) -> Column:
    return F.lower(F.regexp_extract(c["path"], r"\.[^./\\]*$", 0))


def _hash(c: Columns) -> list[Column]:
    return [F.when(c["content"].isNotNull(), rules.finding("file-hash-sha256", 0, 99)).otherwise(rules.finding("file-hash-error", 2, 99))]


#: Analyzers by identifier, with their cost hints (fixed values).
ANALYZERS = (
    Analyzer("core.analyzer.format-mismatch", "Format mismatch", 10, ("path", "content"), lambda c: [rules.format_match(rules.detect_format(c["content"]), rules.expected_format(_extension(c)))]),
    Analyzer("core.analyzer.timezone-inference", "Timezone inference", 15, ("capture", "gps", "longitude"), lambda c: [rules.zone(c["capture"], c["gps"], c["longitude"])]),
    Analyzer("core.analyzer.gps-timestamp", "GPS timestamp", 20, ("capture", "gps"), lambda c: [rules.gps_time(c["capture"], c["gps"])]),
    Analyzer("core.analyzer.software", "Software", 20, ("software",), lambda c: [rules.software(c["software"])]),
    Analyzer("core.analyzer.timestamp", "Timestamp consistency", 20, ("capture", "written", "modified", "digitized"), lambda c: [rules.file_time(c["capture"], c["written"]), rules.header_time(c["capture"], c["modified"]), rules.digitized_time(c["capture"], c["digitized"])]),
    Analyzer("core.analyzer.thumbnail-mismatch", "Thumbnail mismatch", 25, ("width", "height", "thumb_width", "thumb_height"), lambda c: [rules.thumbnail_size(c["width"], c["height"], c["thumb_width"], c["thumb_height"])]),
    Analyzer("core.analyzer.file-hash", "File hash", 50, ("content",), _hash),
)
#: Analyzers of whole payloads: identifier to parser and cost hint (fixed values).
PAYLOADS = {"core.analyzer.heic-structure": ("heic", 20), "core.analyzer.jpeg-integrity": ("jpeg_findings", 30), "core.analyzer.jpeg-artifacts": ("embedded", 40)}
#: Sources by identifier (fixed values).
SOURCES = (
    Source("filesystem"), Source("core.source.folder", extensions=listing.MEDIA["images"]), Source("core.source.thumbsdb", "thumbs_db", (".db",)), Source("core.source.thumbcache", "thumbcache", (".db",)),
    Source("core.source.zbthumbnail", "zb_thumbnails"), Source("iphone-backup", extensions=(".db",)), Source("disk-image", "disk_files"), Source("carved-artifact", "carve"),
)


@dataclass
class Registry:
    """What is registered, by kind and identifier; a later entry of an identifier replaces the earlier."""

    analyzers: dict[str, Analyzer] = field(default_factory=lambda: {a.id: a for a in ANALYZERS})
    processors: dict[str, Processor] = field(default_factory=lambda: {"core.processor.embedded-artifact-extractor": Processor("core.processor.embedded-artifact-extractor", "Embedded artifacts", lambda df: frames.embedded_files(frames.parse(df, "embedded"), df))})
    exporters: dict[str, Exporter] = field(default_factory=lambda: {e.id: e for e in (Exporter("core.exporter.findings-txt", "Findings as text", ("txt",), sinks.findings_text), Exporter("core.exporter.findings-json", "Findings as JSON", ("json",), sinks.findings_json))})
    sources: dict[str, Source] = field(default_factory=lambda: {s.id: s for s in SOURCES})

    def add(self, *plugins: Analyzer | Processor | Exporter | Source) -> Registry:
        for p in plugins:
            {Analyzer: self.analyzers, Processor: self.processors, Exporter: self.exporters, Source: self.sources}[type(p)][p.id] = p
        return self

    def add_from(self, folder: str, policy: str) -> Registry:
        """Adds all plugins under a folder that the policy lets run and that can be activated."""
        for manifest in permitted(discover(folder), policy):
            for kind in (Analyzer, Processor, Exporter, Source):
                if made := activate(manifest, kind):
                    self.add(made)
                    break
        return self

    def analyze(self, df: DataFrame, item: str, columns: dict[str, str], only: set[str] | None = None) -> DataFrame:
        """item, analyzer, id, priority, observed, interpreted: all analyzers whose columns are named, in one pass, cheapest first."""
        c = {k: F.col(v) for k, v in columns.items()}
        able = [a for a in sorted(self.analyzers.values(), key=lambda a: (a.cost, a.id)) if set(a.needs) <= c.keys() and (only is None or a.id in only)]
        made = [F.when(r.isNotNull(), F.struct(F.lit(a.id).alias("analyzer"), r.alias("f"))) for a in able for r in a.structs(c)]
        none = F.lit(None).cast(f"struct<analyzer:string,f:{rules.NONE}>")
        found = F.filter(F.array(none, *made), lambda f: f.isNotNull())
        return df.select(F.col(item).alias("item"), F.explode(found).alias("found")).select("item", "found.analyzer", "found.f.*")

    def exporter(self, format: str) -> Exporter | None:
        return next((e for e in self.exporters.values() if format in e.formats), None)

    def parse_payloads(self, df: DataFrame, *identifiers: str) -> dict[str, DataFrame]:
        """Rows of the analyzers of whole payloads by identifier; of all without any."""
        return {i: frames.parse(df, PAYLOADS[i][0]) for i in identifiers or PAYLOADS}
