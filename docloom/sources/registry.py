"""Which reader takes which file, and reading files of many formats into one block table."""

from __future__ import annotations

import importlib.util
import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCK_COLUMNS
from . import archives, compact, elements, html, interchange, lines, notebooks, prose, rtf

Reader = Callable[..., DataFrame]
ALLOW, ENABLED, DISABLED = "spark.docloom.allowRegistration", "spark.docloom.enabledReaders", "spark.docloom.disabledReaders"
#: The value of an option that isn't asked for.
DEFAULT = "default"
ARGUMENT_TYPES = {"string": str, "boolean": bool, "integer": int}


@dataclass(frozen=True)
class Option:
    """What a reader is told where a caller asks for `value` of `intent`: its parameter and the argument."""

    intent: str
    value: str
    param: str
    argument: str
    type: str = "string"

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.param or ""):
            raise ValueError(f"param must be an identifier, got {self.param!r}")
        if not self.intent or None in (self.value, self.argument, self.type):
            raise ValueError("an option needs an intent, a value, an argument and a type")
        if self.type not in ARGUMENT_TYPES:
            raise ValueError(f"unknown type {self.type!r} ({', '.join(ARGUMENT_TYPES)})")
        if (self.type == "boolean" and self.argument.lower() not in ("true", "false")) or (self.type == "integer" and not re.fullmatch(r"-?\d+", self.argument)):
            raise ValueError(f"{self.argument!r} is no {self.type}")

    def typed(self) -> str | bool | int:
        return self.argument.lower() == "true" if self.type == "boolean" else ARGUMENT_TYPES[self.type](self.argument)


@dataclass(frozen=True)
class Entry:
    extension: str
    format: str
    kind: str  # doc or table
    source: str  # builtin or registered
    reader: Reader | None
    binary: bool = False
    provider: str = "docloom"  # the module that a reader needs, or who registered it
    options: tuple[Option, ...] = ()
    notes: str = ""

    @property
    def key(self) -> str:
        return self.extension if "://" in self.extension or not self.extension else f".{self.extension}"


def _compact(docs: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    return compact.read_compact(docs.select(by, F.posexplode(F.split(text, "\n")).alias("n", "line")), by)


def _verbatim(encoding: str, docs: DataFrame, by: str = "doc", text: str = "text") -> DataFrame:
    """A configuration tree is one metadata block, as it stands."""
    return docs.select(by, F.lit("block").alias("kind"), F.lit("metadata").alias("element_type"), F.col(text).alias("content"), F.lit(1).alias("level"), F.lit(encoding).alias("encoding"), F.create_map(F.lit("role"), F.lit("document")).alias("attributes"), F.lit(0).alias("element_order"))


# The formats, their extensions and what is to be known of them.
_LINE_FORMATS = {"org": ["org"], "rst": ["rst", "rest"], "mediawiki": ["wiki", "mediawiki"], "textile": ["textile"], "latex": ["tex", "latex"], "markdown": ["md", "markdown"]}
_TABLES = {"csv": "spark", "tsv": "spark", "parquet": "spark", "arrow": "pyarrow", "json": "spark", "jsonl": "spark", "ndjson": "spark", "xlsx": "openpyxl"}
_NOTES = {
    "org": "quote, source and other blocks, drawers, definition items; unknown keywords are raw", "rst": "adornments rank by first appearance; directives are divs, field lists definition lists; no metadata", "mediawiki": "templates and switches are raw, leading blanks are code; no metadata",
    "textile": "markers with classes and ids, html blocks raw; no metadata", "latex": "unknown environments are divs, unknown macros leave their arguments; formulas as they stand", "markdown": "both heading styles, fences, tables; html lines raw",
    "ipynb": "cells and outputs are divs", "dblocks": "one JSON object a line", "pandoc": "by format name alone, since .json is data", "html": "sections, headings, lists, quotes, code, tables, links and marks", "prose": "short lines are headings", "rtf": "outline levels and styles, lists, tables, info fields",
    "docx": "styles, lists, tables, notes, images, links", "odt": "styles, lists, tables, notes, images, links", "epub": "spine order, classes of style sheets, tables", "toml": "one metadata block", "yaml": "one metadata block",
    "pdf": "needs a registered decoder that gives page elements", "zim": "an archive of many articles", "zim_article": "needs a registered reader",
}


def _builtin() -> list[Entry]:
    made = lambda e, f, reader, binary=False, provider="docloom": Entry(e, f, "doc", "builtin", reader, binary, provider, notes=_NOTES.get(f, ""))
    out = [made(e, f, partial(lines.read_lines, fmt=f)) for f, some in _LINE_FORMATS.items() for e in some]
    out += [made("ipynb", "ipynb", notebooks.read_notebooks), made("dblocks", "dblocks", _compact), made("", "pandoc", interchange.read_interchange), made("txt", "prose", prose.read_prose), made("rtf", "rtf", rtf.read_rtf)]
    out += [made(e, "html", partial(html.read_html, html="text")) for e in ("html", "htm")] + [made(e, k, partial(_verbatim, k)) for e, k in (("toml", "toml"), ("yaml", "yaml"), ("yml", "yaml"))]
    out += [made(e, e, partial(archives.read_archives, format=e), True) for e in archives.FORMATS]
    out += [made("pdf", "pdf", None, True, "a decoder"), made("zim", "zim", None, True, "an archive reader"), made("zim://", "zim_article", None, True, "an archive reader")]
    return out + [Entry(e, "data", "table", "builtin", None, provider=p) for e, p in _TABLES.items()]


def extension_of(path: str) -> str:
    """The lower-case extension; the scheme of an address that names its format; what decorates web and git addresses goes."""
    if path.startswith("zim://"):
        return "zim://"
    if re.match(r"^https?://", path):
        path = re.split(r"[?#]", path)[0]
    elif path.startswith("git://"):
        path = re.sub(r"(?:\?ref=.*|@[^/]*)$", "", path)
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def is_glob(path: str) -> bool:
    return bool(re.search(r"[*?\[]", path))


class Registry:
    """Readers by extension and by format; later registrations replace earlier ones."""

    def __init__(self) -> None:
        self.entries = _builtin()
        self._native = {e.extension: e.format for e in self.entries if e.extension}

    def lookup(self, path: str | None) -> Entry | None:
        ext = extension_of(path) if path is not None else ""
        return next((e for e in reversed(self.entries) if e.extension and e.extension == ext), None)

    def _of(self, path: str | None, field: Callable[[Entry], object]):
        found = self.lookup(path)
        return field(found) if found else None

    def format_for(self, path: str | None) -> str | None:
        return self._of(path, lambda e: e.format or None)

    def reader_for(self, path: str | None) -> Reader | None:
        return self._of(path, lambda e: e.reader)

    def provider_for(self, path: str | None) -> str | None:
        return self._of(path, lambda e: e.provider or None)

    def kind_for(self, path: str | None) -> str | None:
        return self._of(path, lambda e: e.kind)

    def key_for(self, path: str | None) -> str | None:
        return self._of(path, lambda e: e.key)

    def builtin_format_for(self, path: str | None) -> str | None:
        """What the extension was known as before anything was registered; no registration changes that."""
        return None if path is None else self._native.get(extension_of(path))

    def can_read(self, path: str | None) -> bool:
        found = self.lookup(path)
        return bool(found and found.reader)

    def resolved_format(self, path: str | None, format: str | None = "auto") -> str | None:
        return format if format not in (None, "auto") else self.format_for(path)

    def policy_format(self, path: str | None, format: str | None = "auto") -> str | None:
        """The name that settings know a source by: a given format, else the builtin one, so that no registration escapes it."""
        if format not in (None, "auto"):
            return format
        return self.builtin_format_for(path) or self.format_for(path) or (self.key_for(path) or "").lstrip(".") or None

    def described(self, paths: DataFrame, path: str = "path") -> DataFrame:
        """`paths` with extension, format, kind, can_read and builtin_format of each path, without a loop over them.

        A path without an extension, or with one that nothing claims, has nulls; a null path has all null but can_read.
        """
        p = F.col(path)
        web = F.when(p.rlike(r"^https?://"), F.get(F.split(p, "[?#]"), F.lit(0))).when(p.startswith("git://"), F.regexp_replace(p, r"(?:\?ref=.*|@[^/]*)$", "")).otherwise(p)
        name = F.element_at(F.split(web, r"[/\\]"), -1)
        extension = F.when(p.startswith("zim://"), "zim://").when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.when(p.isNotNull(), F.lit("")))
        last = {e.extension: e for e in self.entries if e.extension}  # later entries go first
        table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        of = lambda values: F.try_element_at(table(values), F.col("extension"))
        return paths.withColumn("extension", extension).withColumns(
            {
                "format": of({k: e.format for k, e in last.items()}),
                "kind": of({k: e.kind for k, e in last.items()}),
                "can_read": F.coalesce(of({k: e.reader is not None for k, e in last.items()}), F.lit(False)),
                "builtin_format": of(self._native),
            }
        )

    def supported_paths(self) -> list[str]:
        """Globs of all files that a document reader takes."""
        return sorted({f"*{e.key}" for e in self.entries if e.kind == "doc" and e.reader and e.extension and "://" not in e.extension})

    def of_format(self, format: str) -> Entry:
        found = next((e for e in reversed(self.entries) if e.format == format), None)
        if found is None:
            raise ValueError(f"no reader for format {format}")
        if found.kind == "table":
            raise ValueError(f"{format} is rows, not a document; read it as a table")
        if found.reader is None:
            raise ValueError("pdf has no decoder here; register one that gives page elements" if format == "pdf" else f"{format} holds many documents and has no reader")
        return found

    def reader(self, format: str) -> Reader:
        return self.of_format(format).reader

    def option_for(self, path: str, intent: str, value: str | None) -> dict[str, str | bool | int]:
        """The reader's argument for this value of an option; none for the default. What a reader doesn't map is an error."""
        if value is None:
            raise ValueError(f"{intent} must name a value; NULL is not one")
        if value == DEFAULT:
            return {}
        found = self.lookup(path)
        mapped = next((o for o in found.options if (o.intent, o.value) == (intent, value)), None) if found else None
        if mapped is None:
            raise ValueError(f"the reader for {path} has no mapping for {intent} = {value!r}")
        return {mapped.param: mapped.typed()}

    def _register(self, spark: SparkSession, kind: str, provider: str, reader: Reader, extensions: list[str], format: str, binary: bool, options) -> None:
        if spark.conf.get(ALLOW, "true").lower() == "false":
            raise PermissionError("registration of readers is switched off")
        if not callable(reader):
            raise ValueError(f"not a reader: {reader!r}")
        if not extensions:
            raise ValueError("registering needs at least one extension")
        names = [e.lstrip(".").lower() if "://" not in e else e for e in extensions]
        if not re.fullmatch(r"[a-z0-9_]*", format) or not all(re.fullmatch(r"[a-z0-9_]+(?:://)?", e) for e in names):
            raise ValueError(f"not a name: {format} {', '.join(extensions)}")
        options = tuple(o if isinstance(o, Option) else Option(**o) for o in options)
        self.entries = [e for e in self.entries if e.extension not in names] + [Entry(e, format, kind, "registered", reader, binary, provider, options) for e in names]

    def register(self, spark: SparkSession, extension: str | list[str], format: str, reader: Reader, binary: bool = False, options=(), provider: str = "") -> None:
        """Adds a reader of (doc, text or bytes) to block rows, unless the session's settings forbid it.

        `options` say which of the reader's parameters stand for what callers ask for.
        """
        self._register(spark, "doc", provider or format, reader, [extension] if isinstance(extension, str) else list(extension), format, binary, options)

    def register_table(self, spark: SparkSession, extension: str | list[str], reader: Callable[[SparkSession, str], DataFrame], provider: str = "") -> None:
        """Adds a reader of a path to rows."""
        self._register(spark, "table", provider, reader, [extension] if isinstance(extension, str) else list(extension), "data", False, ())

    def table(self, spark: SparkSession) -> DataFrame:
        """(extension, format, provider, kind, source, implemented) of every entry."""
        rows = [(e.key, e.format, e.provider, e.kind, e.source, e.reader is not None or e.kind == "table") for e in self.entries]
        return spark.createDataFrame(rows, "extension string, format string, provider string, kind string, source string, implemented boolean")

    def dependencies(self, spark: SparkSession) -> DataFrame:
        """(provider, required_for, installed) of what readers need beside this library and Spark."""
        needed: dict[str, set[str]] = {}
        for e in self.entries:
            if e.provider not in ("docloom", "spark", "") and e.source == "builtin":
                needed.setdefault(e.provider, set()).add(e.extension)
        rows = [(p, ", ".join(sorted(x)), " " not in p and importlib.util.find_spec(p) is not None) for p, x in sorted(needed.items())]
        return spark.createDataFrame(rows, "provider string, required_for string, installed boolean")

    def copy(self) -> Registry:
        other = Registry()
        other.entries = [replace(e) for e in self.entries]
        return other


REGISTRY = Registry()


def reader_enabled(spark: SparkSession, format: str) -> bool:
    listed = lambda key: {x.strip() for x in spark.conf.get(key, "").split(",") if x.strip()}
    enabled, disabled = listed(ENABLED), listed(DISABLED)
    return format not in disabled and (not enabled or format in enabled)


def check_enabled(spark: SparkSession, format: str) -> None:
    if not reader_enabled(spark, format):
        raise PermissionError(f"the reader of {format} is disabled (see {ENABLED} and {DISABLED})")


def source_list(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files that paths and globs name; one that matches nothing, and an empty list, are errors."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files matched an empty list")
    out = []
    for path in paths:
        if path is None:
            raise ValueError("cannot use NULL as a path")
        files = [path] if "zim://" in path else glob_files(spark, path)
        if not files:
            raise ValueError(f"no files matched {path}")
        out += files
    return out


def _check_pages(pages: str | None, files: list[str], formats: list[str], plural: bool) -> None:
    if pages == "":
        return
    if plural:
        raise ValueError(f"pages is of one document; {len(files)} are named")
    if any(f != "pdf" for f in formats):
        raise ValueError(f"pages is not supported for {formats[0]}")
    elements.page_range(pages)


def read_documents(
    spark: SparkSession,
    paths: str | list[str],
    format: str = "auto",
    filename: bool = False,
    registry: Registry = REGISTRY,
    pages: str = "",
    attributes: str = DEFAULT,
    reader_params: dict[str, str] | None = None,
    expand_embedded: bool = False,
) -> DataFrame:
    """The block table of files; `doc` is each file's path, as is `filename`, the last column, if asked for.

    Paths may be globs, and are resolved and read by Spark alone. One scan is made for each reader. `pages` is for one
    paged document; `attributes` is an option that readers map to a parameter of theirs, `reader_params` are given to
    them as they are; what a reader doesn't take is an error. `expand_embedded` puts the blocks of embedded markdown in
    its place, then reads code blocks of tables. A path that matches nothing, a format without a reader and a disabled
    reader are errors, before anything is read.
    """
    for name, value in (("paths", paths), ("format", format), ("filename", filename), ("reader_params", {} if reader_params is None else reader_params), ("attributes", attributes), ("expand_embedded", expand_embedded)):
        if value is None or (name == "reader_params" and any(v is None for v in value.values())):
            raise ValueError(f'cannot use NULL as an argument for "{name}"')
    if pages is None:
        elements.page_range(pages)
    files = source_list(spark, paths)
    found: dict[tuple, list[str]] = {}
    formats = []
    for f in files:
        entry = registry.lookup(f)
        own = registry.resolved_format(f, format)
        if own is None:
            raise ValueError(f"no reader claims {f}")
        formats.append(own)
        registry.of_format(own)
        check_enabled(spark, registry.policy_format(f, format) or own)
        entry = entry if format == "auto" else registry.of_format(own)
        if entry.reader is None or entry.kind == "table":
            entry = registry.of_format(own)
        asked = registry.option_for(f, "attributes", attributes) | dict(reader_params or {}) | ({"pages": pages} if pages else {})
        found.setdefault((own, entry.reader, entry.binary, tuple(sorted(asked.items()))), []).append(f)
    _check_pages(pages, files, formats, isinstance(paths, str) is False or is_glob(paths))
    parts = []
    for (own, reader, binary, asked), some in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
        taken = inspect.signature(reader).parameters
        refused = [k for k, _ in asked if k not in taken and not any(p.kind is p.VAR_KEYWORD for p in taken.values())]
        if refused:
            raise ValueError(f"{refused[0]} is not supported for {own}")
        if binary:
            docs = spark.read.format("binaryFile").load(some).select(F.col("path").alias("doc"), F.col("content").alias("bytes"))
        else:
            docs = spark.read.text(some, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
        parts.append(reader(docs, **dict(asked)).select("doc", *BLOCK_COLUMNS))
    out = reduce(DataFrame.unionByName, parts)
    if expand_embedded:
        from ..functions.tables import parse_embedded_blocks
        from ..operators.structure import expand_embedded as expanded

        out = parse_embedded_blocks(expanded(out))
    return out.withColumn("filename", F.col("doc")) if filename else out


def read_data(spark: SparkSession, path: str, registry: Registry = REGISTRY) -> DataFrame:
    """The rows of a data file, read by its extension; registered readers go first.

    CSV and TSV have a header and inferred types. A document format is an error, and so is a disabled reader.
    """
    entry = registry.lookup(path)
    if entry is None or (entry.kind != "table" and entry.format != "toml"):
        raise ValueError(f"{path} is no data file" if entry is None else f"{entry.format} is a document, not rows; read it as one")
    check_enabled(spark, registry.policy_format(path) or entry.format)
    if entry.reader is not None and entry.kind == "table":
        return entry.reader(spark, path)
    ext = entry.extension
    if ext in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="," if ext == "csv" else "\t", multiLine=True, escape='"')
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext == "json":
        return spark.read.json(path, multiLine=True)
    if ext in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if ext == "toml":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("toml"))
    if ext == "arrow":
        return _read_arrow(spark, path)
    if importlib.util.find_spec(entry.provider) is None:
        raise ValueError(f"{path} needs {entry.provider}")
    raise ValueError(f"{ext} is read by a registered reader alone; register one")


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, each in the task that has it; the schema is that of the first one."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    opened = lambda content: pa.ipc.open_file(pa.BufferReader(bytes(content)))
    schema = from_arrow_schema(opened(files.select("content").first()["content"]).schema)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                reader = opened(content.as_py())
                for k in range(reader.num_record_batches):
                    yield reader.get_batch(k)

    return files.select("content").mapInArrow(run, schema)


def glob_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path or glob names, in order, in whatever store Spark reads; none if nothing matches."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in (found or []) if s.isFile())
