"""Source files: scan, change detection, chunks, calls, imports; memory files."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension to language.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "kt": "kotlin", "swift": "swift", "scala": "scala", "sh": "bash", "lua": "lua", "md": "markdown", "sql": "sql"}
CHUNK = "id long, file_path string, name string, kind string, start_line int, end_line int, docstring string, parent_name string, is_exported boolean, content string, calls array<string>"


def scan(spark: SparkSession, root: str, most_bytes: int = 1_000_000, ignored: tuple[str, ...] = (r"(^|/)\.git/", r"(^|/)node_modules/")) -> DataFrame:
    """(file_path, content, size, mtime, language) of text files; empty, large, binary and ignored ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + root if root.startswith("/") else root
    path = F.ltrim(F.regexp_replace(F.replace("path", F.lit(base), F.lit("")), "^/+", ""))
    kept = files.where((F.col("length") > 0) & (F.col("length") <= most_bytes)).where(F.instr(F.hex(F.substring("content", 1, 8192)), "00").isNotNull() & ~F.decode(F.substring("content", 1, 8192), "ISO-8859-1").contains("\0"))
    out = kept.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    for pattern in ignored:
        out = out.where(~F.col("file_path").rlike(pattern))
    extension = F.lower(F.substring_index("file_path", ".", -1))
    languages = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return out.withColumn("language", languages[extension])


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, deleted, modified or same, by a full join of (key, hash)."""
    x = old.withColumnRenamed("hash", "__old").join(new.withColumnRenamed("hash", "__new"), key, "full_outer")
    return x.select(key, F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__old") != F.col("__new"), "modified").otherwise("same").alias("change"))


def trusted_mtime(mtime, observed, seconds: int = 2):
    """0 for a file changed so shortly before that a later change might have the same time."""
    return F.when(F.unix_seconds(observed) - F.unix_seconds(mtime) < seconds, 0).otherwise(F.unix_seconds(mtime))


def python_chunks(path: str, source: str) -> list[dict]:
    """Functions, methods and classes of one Python file, with the names they call; the whole file if it can't be parsed."""
    lines = source.split("\n")
    whole = [{"file_path": path, "name": path, "kind": "file", "start_line": 1, "end_line": len(lines), "docstring": None, "parent_name": None, "is_exported": True, "content": source, "calls": []}]
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return whole
    out: list[dict] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent else "function"
                calls = [] if kind == "class" else sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
                out.append({"file_path": path, "name": child.name, "kind": kind, "start_line": child.lineno, "end_line": child.end_lineno, "docstring": ast.get_docstring(child), "parent_name": parent, "is_exported": not child.name.startswith("_"), "content": "\n".join(lines[child.lineno - 1 : child.end_lineno]), "calls": calls})
                visit(child, child.name if kind == "class" else parent)
            else:
                visit(child, parent)

    visit(tree, None)
    return out or whole


def chunk(files: DataFrame) -> DataFrame:
    """Chunks of scanned files: Python by its syntax tree, other languages as whole files. Rows stream, a file at a time."""

    def run(batches):
        for batch in batches:
            for path, content, language in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = python_chunks(path, content) if language == "python" else [{"file_path": path, "name": path, "kind": "file", "start_line": 1, "end_line": content.count("\n") + 1, "docstring": None, "parent_name": None, "is_exported": True, "content": content, "calls": []}]
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    fields = [("file_path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("parent_name", pa.string()), ("is_exported", pa.bool_()), ("content", pa.string()), ("calls", pa.list_(pa.string()))]
    SCHEMA = pa.schema(fields)
    rows = files.select("file_path", "content", "language").mapInArrow(run, CHUNK.removeprefix("id long, "))
    return rows.withColumn("id", F.xxhash64(F.concat_ws(":", "file_path", "name", F.col("start_line").cast("string"))))


#: Import statements by language: (pattern, group of the module).
IMPORTS = {
    "python": (r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", (1, 2)),
    "typescript": (r"(?:from|import)\s*\(?\s*['\"]([^'\"]+)['\"]", (1,)),
    "go": (r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"", (1,)),
    "rust": (r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", (1,)),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", (1,)),
}


def imports(files: DataFrame) -> DataFrame:
    """(file_path, module): distinct imports of scanned files."""
    out = None
    for language, (pattern, groups) in IMPORTS.items():
        names = ("typescript", "tsx", "javascript") if language == "typescript" else (language,)
        for g in groups:
            one = files.where(F.col("language").isin(*names)).select("file_path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(g))).alias("module")).where("module <> ''")
            out = one if out is None else out.union(one)
    return out.distinct()


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module, resolved): relative modules to files, the exact name first, then `.ts .tsx .js .jsx`, then `/index.*`."""
    relative = found.where(F.col("module").startswith("."))
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    joined = F.concat(folder, F.regexp_replace("module", r"^\./", ""))
    for _ in range(8):
        joined = F.regexp_replace(joined, r"(^|/)[^/.]+/\.\./", "$1")
    bare = F.regexp_replace(joined, r"\.js$", "")
    endings = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    tries = relative.select("file_path", "module", F.posexplode(F.array(joined, *(F.concat(bare, F.lit(e)) for e in endings[1:]))).alias("place", "candidate"))
    hits = tries.join(files.select(F.col("file_path").alias("candidate")), "candidate")
    return hits.groupBy("file_path", "module").agg(F.min_by("candidate", "place").alias("resolved"))


def memory_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, name, type, description, content) of markdown files with a front matter; others are left out."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), "value").where("file_name <> 'MEMORY.md'")
    parts = raw.where(F.col("value").rlike(r"(?s)^---\n.*?\n---")).select("file_path", F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1).alias("head"), F.trim(F.regexp_extract("value", r"(?s)^---\n.*?\n---\n?(.*?)\s*$", 1)).alias("content"))
    field = lambda f: F.nullif(F.regexp_replace(F.regexp_extract("head", rf"(?m)^{f}:[ ]*(.*?)[ ]*$", 1), "^[\"']|[\"']$", ""), F.lit(""))
    return parts.select("file_path", *(field(f).alias(f) for f in ("name", "type", "description")), "content").where("name is not null and type is not null")
