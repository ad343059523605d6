"""Files of a folder as rows, and small formats: delimited text, JSON, OpenAPI."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN = {"md", "markdown", "mdown", "mkd"}
INDEXABLE = MARKDOWN | {"yaml", "yml", "json", "toml", "mermaid", "mmd"}
VIEWABLE = INDEXABLE | {"csv", "tsv"}
MOST_DEPTH = 12
#: Folders that hold no notes (fixed values).
IGNORED = {
    "node_modules", "Pods", "DerivedData", "dist", "build",
    "venv", "__pycache__", "target",
    ".git", ".svn", ".hg", ".build", ".swiftpm", ".venv", ".tox",
    ".cache", ".next", ".nuxt", ".Trash",
}
SCANNED = "path string, rel_path string, mtime double, size bigint, content string"


def extension(name: str) -> str:
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def wanted(rel_path: str) -> bool:
    """Whether a path is indexed: its kind fits, no part of it is hidden or ignored. The one
    rule for scans and for change feeds."""
    *folders, name = rel_path.split("/")
    hidden = any(p.startswith(".") or p in IGNORED for p in folders) or name.startswith(".")
    return not hidden and extension(name) in INDEXABLE


def walk(root: str, most_depth: int = MOST_DEPTH) -> Iterator[str]:
    """Relative paths below a folder that are indexed, in order of names."""
    for folder, names, files in os.walk(root):
        rel = os.path.relpath(folder, root)
        depth = 0 if rel == "." else rel.count(os.sep) + 1
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in IGNORED) if depth + 1 < most_depth else []
        for f in sorted(files):
            p = f if rel == "." else f"{rel}/{f}".replace(os.sep, "/")
            if wanted(p):
                yield p


def decoded(raw: bytes) -> str:
    """UTF-8, else Shift JIS, else nothing."""
    for code in ("utf-8", "cp932"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            pass
    return ""


def scan(spark: SparkSession, root: str, most_depth: int = MOST_DEPTH) -> DataFrame:
    """The indexable files of a folder that all executors see; names are listed by the driver,
    contents are read by the tasks. Files that vanish meanwhile are left out."""
    root = os.path.realpath(root)
    names = list(walk(root, most_depth))
    if not names:
        return spark.createDataFrame([], SCANNED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rel in batch.column(0).to_pylist():
                path = os.path.join(root, rel)
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                    s = os.stat(path)
                except OSError:
                    continue
                rows.append((path, rel, s.st_mtime, s.st_size, decoded(raw)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "rel_path", "mtime", "size", "content"])

    files = spark.createDataFrame([(n,) for n in names], "rel_path string").repartition(max(1, min(len(names) // 64, 4096) or 1))
    return files.mapInArrow(read, SCANNED)


def tree(root: str) -> list[tuple[str, str, bool]]:
    """(path, parent, is_dir) of viewable files and of folders that hold some, folders first."""

    def below(rel: str) -> list[tuple[str, str, bool]]:
        dirs, files = [], []
        for e in os.scandir(os.path.join(root, rel)):
            p = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False):
                inner = [] if e.name in IGNORED else below(p)
                if inner:
                    dirs.append((e.name, [(p, rel, True), *inner]))
            elif extension(e.name) in VIEWABLE:
                files.append((e.name, [(p, rel, False)]))
        return [x for _, some in sorted(dirs) + sorted(files) for x in some]

    return below("")


def default_file(rows: list[tuple[str, str, bool]]) -> str | None:
    """The first readme by depth, else the first Markdown file, else the first file."""
    files = [(p.count("/"), i, p) for i, (p, _, is_dir) in enumerate(rows) if not is_dir]
    rank = lambda p: 0 if p.rsplit("/", 1)[-1].lower().startswith("readme") else 1 if extension(p) in MARKDOWN else 2
    return min(files, key=lambda f: (rank(f[2]), f[0], f[1]))[2] if files else None


def delimited(text: str, sep: str = ",", most: int = 5000) -> tuple[list[list[str]], bool]:
    """(rows, truncated) of CSV or TSV: quotes count at the start of a field only and are
    doubled inside; any line end; blank rows dropped, ragged rows kept."""
    field = re.compile(rf'"((?:[^"]|"")*)("|\Z)([^{re.escape(sep)}\r\n]*)|([^{re.escape(sep)}\r\n]*)')
    rows: list[list[str]] = []
    row: list[str] = []
    at, n = 0, len(text)
    while at <= n:
        m = field.match(text, at)
        row.append(m.group(1).replace('""', '"') + m.group(3) if m.group(1) is not None else m.group(4))
        at = m.end()
        if at < n and text[at] == sep:
            at += 1
            continue
        if any(c.strip() for c in row):
            rows.append(row)
            if len(rows) > most:
                return rows, True
        row = []
        at += 2 if text[at : at + 2] == "\r\n" else 1
    return rows, False


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """The same format as a table of strings, without a cap, split by Spark."""
    return spark.read.options(header=header, multiLine=True, quote='"', escape='"', sep=sep, mode="PERMISSIVE").csv(path)


def pretty_json(text: str, most: int = 2_000_000) -> str:
    """JSON of a single line, laid out; else the text itself."""
    if "\n" in text.strip() or len(text) >= most:
        return text
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def is_openapi(text: Column) -> Column:
    """Whether the first 4,096 characters name an OpenAPI or Swagger version."""
    head = F.substring(text, 1, 4096)
    return head.rlike(r'"(openapi|swagger)"\s*:\s*"') | head.rlike(r"(?m)^(openapi|swagger)\s*:")


def _pointer(doc, path: str):
    for key in (p.replace("~1", "/").replace("~0", "~") for p in path.split("/") if p):
        doc = doc[int(key)] if isinstance(doc, list) else doc[key]
    return doc


def bundle(root: str, files: dict[str, object]) -> object:
    """A specification with references to other files brought in: each once, under
    components/x-bundled, so that cycles end in inner references. files: parsed documents by
    path; what can't be found stays as it is."""
    import copy
    import posixpath

    out = copy.deepcopy(files[root])
    names: dict[tuple[str, str], str] = {}
    added: dict[str, object] = {}

    def visit(node, at: str, top: bool):
        if isinstance(node, list):
            return [visit(x, at, top) for x in node]
        if not isinstance(node, dict):
            return node
        ref = node.get("$ref")
        if isinstance(ref, str) and not re.match(r"[a-z][a-z0-9+.-]*:", ref) and not (top and ref.startswith("#")):
            path, _, inner = ref.partition("#")
            target = posixpath.normpath(posixpath.join(posixpath.dirname(at), path)) if path else at
            if target == root:
                return {"$ref": "#" + inner}
            key = (target, inner)
            if key not in names:
                try:
                    found = copy.deepcopy(_pointer(files[target], inner))
                except (KeyError, IndexError, ValueError, TypeError):
                    return node
                base = re.sub(r"[^A-Za-z0-9_.-]", "_", (inner.rsplit("/", 1)[-1] or posixpath.basename(target))) or "part"
                name, n = base, 1
                while name in added:
                    n += 1
                    name = f"{base}_{n}"
                names[key] = name
                added[name] = None  # known before it is visited: a cycle finds it
                added[name] = visit(found, target, False)
            return {"$ref": f"#/components/x-bundled/{names[key]}"}
        return {k: visit(v, at, top) for k, v in node.items()}

    out = visit(out, root, True)
    if added:
        out.setdefault("components", {})["x-bundled"] = added
    return out
