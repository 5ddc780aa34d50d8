"""File scans and push events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lookup

#: Languages of file extensions.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".go": "go",
    ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".rb": "ruby", ".rake": "ruby", ".php": "php", ".swift": "swift",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".css": "css", ".scss": "scss", ".html": "html", ".sql": "sql", ".sh": "shell",
    ".toml": "toml", ".xml": "xml", ".graphql": "graphql", ".gql": "graphql", ".svelte": "svelte", ".vue": "vue",
}
#: Extensions of other text files, folders that are not scanned, and the largest size in bytes.
OTHER_TEXT = ("", ".txt", ".env", ".example", ".gitignore", ".dockerignore", ".editorconfig", ".prettierrc", ".eslintrc", ".babelrc", ".npmrc", ".nvmrc")
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv", "vendor", "coverage", ".turbo")
MAX_SIZE = 500 * 1024


def indexable(files: DataFrame, size: str) -> DataFrame:
    return files.filter((F.col(size) > 0) & (F.col(size) <= MAX_SIZE))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """file_path, language, size_bytes, content, content_hash of the text files below root.

    The paths, sizes and extensions are filtered before the content column is read by anything.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    relative = F.regexp_replace("path", "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in base.rstrip("/").replace("file://", "file:")) + "/", "")
    f = raw.withColumn("file_path", relative).withColumn("_ext", F.lower(F.regexp_extract("file_path", r"[^/]+(\.[^./]+)$", 1)))
    f = f.withColumn("language", lookup(F.col("_ext"), LANGUAGES, "unknown"))
    folders = F.slice(F.split("file_path", "/"), 1, F.size(F.split("file_path", "/")) - 1)
    kept = indexable(f, "length").filter(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED)))).filter((F.col("language") != "unknown") | F.col("_ext").isin(*OTHER_TEXT))
    kept = kept.filter(~F.exists(F.split("file_path", "/"), lambda x: F.startswith(x, F.lit("."))))
    text = F.decode("content", "UTF-8")
    return kept.select("file_path", "language", F.col("length").alias("size_bytes"), text.alias("content"), F.sha2("content", 256).alias("content_hash"))


PUSH = "ref string, after string, commits array<struct<id:string,message:string>>"


def push_commits(events: DataFrame, key: str, branch: str, head: str) -> DataFrame:
    """key, sha (8 characters), message (first line, 120 characters) of the commits pushed to a branch; nothing if the head is known."""
    b = events.select(key, F.from_json("body", PUSH).alias("b")).filter((F.col("b.ref") == f"refs/heads/{branch}") & (F.col("b.after") != head))
    c = b.select(key, F.explode("b.commits").alias("c"))
    out = c.select(key, F.substring("c.id", 1, 8).alias("sha"), F.substring(F.split("c.message", "\n")[0], 1, 120).alias("message"))
    return out.filter("sha <> '' and message <> ''")
