"""Dependency manifests of eight kinds, told by file name, read with Spark's regular expressions and JSON functions.

Each reader is an expression that turns a manifest's text into array<struct<name, version>>; a row of a manifest table yields a row
for each dependency. Versions that a manifest does not give are `*`; dependencies on a path have version `path`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = F.array
DEPS = "array<struct<name:string,version:string>>"


def _pairs(text: Column, pattern: str, name: int = 1, version: int = 2) -> Column:
    """The groups of all matches of a pattern."""
    p = F.lit(pattern)
    return F.arrays_zip(F.regexp_extract_all(text, p, F.lit(name)).alias("name"), F.regexp_extract_all(text, p, F.lit(version)).alias("version")).cast(DEPS)


def _or_any(deps: Column) -> Column:
    return F.transform(deps, lambda d: F.struct(d["name"].alias("name"), F.coalesce(F.nullif(d["version"], F.lit("")), F.lit("*")).alias("version")))


def _sections(text: Column, header: str) -> Column:
    """The bodies, as one text, of the sections of a TOML file whose header fits."""
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"(?ms)^\[{header}\]\s*$(.*?)(?=^\[|\z)"), F.lit(1)), "\n")


def cargo(text: Column) -> Column:
    body = _sections(text, r"(?:target\.[^\]]*\.)?(?:dev-|build-)?dependencies")
    line = _pairs(body, r"(?m)^\s*([\w-]+)\s*=\s*(.+?)\s*$")
    value = lambda v: (
        F.when(v.rlike(r'^"'), F.regexp_extract(v, r'^"([^"]*)"', 1)).when(v.rlike(r'version\s*=\s*"'), F.regexp_extract(v, r'version\s*=\s*"([^"]*)"', 1)).when(v.rlike(r"\bpath\s*="), "path").otherwise("*")
    )
    return F.transform(line, lambda d: F.struct(d["name"].alias("name"), value(d["version"]).alias("version")))


def maven(text: Column) -> Column:
    properties = F.regexp_extract(text, r"(?s)<properties>(.*?)</properties>", 1)
    known = _pairs(properties, r"<([\w.-]+)>\s*([^<]*?)\s*</")
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    tag = lambda b, t: F.regexp_extract(b, rf"<{t}>\s*([^<]*?)\s*</{t}>", 1)

    def version(b):
        v = tag(b, "version")
        name = F.regexp_extract(v, r"^\$\{(.+)\}$", 1)
        found = F.get(F.filter(known, lambda k: k["name"] == name), F.lit(0))["version"]
        return F.when(name != "", F.coalesce(found, v)).otherwise(v)

    return _or_any(F.transform(blocks, lambda b: F.struct(F.concat(tag(b, "groupId"), F.lit(":"), tag(b, "artifactId")).alias("name"), version(b).alias("version"))))


def gradle(text: Column) -> Column:
    return _pairs(text, r"""(?m)^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|testCompileOnly|annotationProcessor|kapt|classpath)\s*\(?\s*["']([^"':]+:[^"':]+):([^"']+)["']""")


def nuget(text: Column) -> Column:
    return _or_any(_pairs(text, r'<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?'))


def gemfile(text: Column) -> Column:
    return _or_any(_pairs(text, r"""(?m)^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""))


def _json(text: Column, *fields: str) -> Column:
    maps = [F.coalesce(F.from_json(F.get_json_object(text, f"$['{f}']"), "map<string,string>"), F.create_map().cast("map<string,string>")) for f in fields]
    return F.transform(F.concat(*[F.map_entries(m) for m in maps]), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version")))


def composer(text: Column) -> Column:
    return F.filter(_json(text, "require", "require-dev"), lambda d: (d["name"] != "php") & ~F.startswith(d["name"], F.lit("ext-")))


def npm(text: Column) -> Column:
    return _json(text, "dependencies", "devDependencies", "peerDependencies")


def pip(text: Column) -> Column:
    return _or_any(_pairs(text, r"(?m)^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~<>!]=?=?\s*([^\s;,#]+))?"))


def go(text: Column) -> Column:
    return _pairs(text, r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)")


def swiftpm(text: Column) -> Column:
    return _pairs(text, r'\.package\(\s*url:\s*"[^"]*?/([^/"]+?)(?:\.git)?"\s*,\s*(?:from:|exact:|\.upToNextM\w+\(from:)\s*"([^"]+)"')


#: A pattern of the file's path, the registry, and the reader.
MANIFESTS = (
    (r"(^|/)Cargo\.toml$", "cargo", cargo), (r"(^|/)pom\.xml$", "maven", maven), (r"(^|/)build\.gradle(\.kts)?$", "maven", gradle), (r"\.csproj$", "nuget", nuget),
    (r"(^|/)Gemfile$", "rubygems", gemfile), (r"(^|/)composer\.json$", "packagist", composer), (r"(^|/)package\.json$", "npm", npm),
    (r"(^|/)requirements[^/]*\.txt$", "pypi", pip), (r"(^|/)go\.mod$", "go", go), (r"(^|/)Package\.swift$", "swiftpm", swiftpm),
)


def dependencies(files: DataFrame) -> DataFrame:
    """file_path, name, version, registry from files (file_path, content); other files are not read further."""
    kind, deps = F.lit(None).cast("string"), F.lit(None).cast(DEPS)
    for pattern, registry, read in reversed(MANIFESTS):
        fits = F.col("file_path").rlike(pattern)
        kind, deps = F.when(fits, registry).otherwise(kind), F.when(fits, read(F.col("content")).cast(DEPS)).otherwise(deps)
    some = files.filter(F.col("file_path").rlike("|".join(p for p, _, _ in MANIFESTS)))
    return some.select("file_path", kind.alias("registry"), F.explode(deps).alias("d")).select("file_path", "d.name", "d.version", "registry").distinct()
