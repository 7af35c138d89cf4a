"""Normalisers of routes, messages, packages, contracts, paths and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def http_path(url: Column) -> Column:
    """Path of a URL or path: no scheme, host, query or fragment, lower-cased, one leading slash, none at the end; parameters as {id}."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.lower(F.regexp_replace(path, r"[?#].*$", ""))
    path = F.regexp_replace(path, r":[a-z0-9_]+|\[[a-z0-9_]+\]|<[a-z0-9_:]+>|\{[a-z0-9_:]+\}", "{id}")
    path = F.concat(F.lit("/"), F.regexp_replace(path, r"^/+|/+$", ""))
    return path


def route_key(method: Column, url: Column) -> Column:
    return F.concat(F.coalesce(F.upper(method), F.lit("UNKNOWN")), F.lit(" "), http_path(url))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def pattern_fits(pattern: Column, path: Column) -> Column:
    """Equal numbers of segments, each equal or a parameter of the pattern."""
    a, b = segments(pattern), segments(path)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == "{id}")), lambda ok: F.coalesce(ok, F.lit(False)))


#: Other names of message brokers.
BROKER_ALIASES = {
    "amqp": "rabbitmq", "rabbit": "rabbitmq", "rabbitmq.client": "rabbitmq",
    "google_pubsub": "pubsub", "google-pubsub": "pubsub", "pub/sub": "pubsub",
    "clientproxy": "nestjs", "nest": "nestjs", "nestjs_microservice": "nestjs",
}


def broker(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    table = F.create_map(*(F.lit(x) for kv in BROKER_ALIASES.items() for x in kv))
    plain = F.regexp_replace(low, "[ _]", "-")
    return F.when(low == "", "unknown").otherwise(F.coalesce(F.element_at(table, low), plain))


def package_name(ecosystem: Column, name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(ecosystem == "rust", F.replace(low, F.lit("_"), F.lit("-"))).when(ecosystem == "go", F.regexp_replace(low, "/+$", "")).otherwise(low)


def contract_name(name: Column) -> Column:
    """Lower-cased, without separators and one common suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]", ""), r"(dto|model|schema|entity|contract|props)$", "")


#: Languages by file name, and by file extension where it is not the language's own name.
LANGUAGE_NAMES = {
    "go.mod": "gomod", "go.sum": "gosum", "go.work": "gowork", "pyproject.toml": "python_project", "requirements.txt": "python_project", "setup.cfg": "python_project",
    "pipfile": "python_project", "poetry.lock": "python_project", "uv.lock": "python_project", "pom.xml": "java_project", "build.gradle": "java_project",
    "settings.gradle": "java_project", "build.gradle.kts": "kotlin_project", "settings.gradle.kts": "kotlin_project", "composer.json": "php_project", "composer.lock": "php_project",
    "gemfile": "ruby_project", "gemfile.lock": "ruby_project", "cmakelists.txt": "cmake", "makefile": "makefile", "compile_commands.json": "compile_commands",
    "package.swift": "swift_project", "pubspec.yaml": "dart_project", "analysis_options.yaml": "dart_project", ".env": "env", ".env.example": "env", ".env.sample": "env",
    ".env.defaults": "env", ".env.template": "env", "example.env": "env", "sample.env": "env", "dockerfile": "dockerfile",
}
LANGUAGES = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "cs": "csharp", "py": "python", "kt": "kotlin",
    "kts": "kotlin", "rb": "ruby", "h": "c_header", "cc": "cpp", "cxx": "cpp", "hpp": "cpp_header", "hh": "cpp_header", "m": "objective_c", "mm": "objective_cpp", "yml": "yaml",
    "htm": "html", "cshtml": "html", "erb": "html", "ejs": "html", "hbs": "html", "sass": "scss", "rs": "rust", "md": "markdown", "sh": "shell",
}


def language_of(path: Column) -> Column:
    """From the file's name, then its extension; an unknown extension is its own language, no extension is null."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.when(name.rlike(r"^.+\.[^.]*$"), F.element_at(F.split(name, r"\."), -1))
    lookup = lambda t, c: F.element_at(F.create_map(*(F.lit(x) for kv in t.items() for x in kv)), c)
    return F.when(name.startswith(".env."), "env").when(name.endswith(".ksql.sql"), "ksql").otherwise(F.coalesce(lookup(LANGUAGE_NAMES, name), lookup(LANGUAGES, ext), ext))


#: What a scan leaves out: directories, file names ("*" for any start) and extensions.
IGNORED_DIRS = [
    ".git", "target", "node_modules", ".next", "dist", "out", "coverage", "bin", "obj", "build", ".vs", ".nuxt", ".qdrant",
]
IGNORED_NAMES = [
    "project.assets.json", "deps.json", "*.deps.json", "runtimeconfig.json", "*.runtimeconfig.json", "lcov.info", "coverage.xml", "junit.xml", "app.deps.json",
]
IGNORED_EXTENSIONS = [
    "dll", "exe", "pdb", "so", "dylib", "class", "jar", "wasm", "bin", "zip", "rar", "7z", "tar", "gz", "tgz", "bz2", "png", "jpg", "jpeg", "webp", "gif", "ico", "svgz",
    "mp4", "mov", "avi", "mkv", "mp3", "wav", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "log", "dmp", "dump", "trace", "etl", "har", "db", "sqlite", "sqlite3",
    "mdf", "ldf", "bak", "trx", "coverage", "coveragexml", "xml",
]


def skip_reason(path: Column) -> Column:
    """Why a scan leaves a path out, or null: any segment first, then the file's name, then its extension, whatever the case."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    ext = F.when(name.rlike(r"^.+\.[^.]*$"), F.element_at(F.split(name, r"\."), -1))
    named = name.isin([x for x in IGNORED_NAMES if "*" not in x])
    for x in (x[1:] for x in IGNORED_NAMES if "*" in x):
        named = named | name.endswith(x)
    in_dir = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS)))
    return F.when(in_dir, "ignored_directory").when(named, "ignored_name").when(ext.isin(IGNORED_EXTENSIONS), "ignored_extension")


#: Two-letter states of files in conflict.
CONFLICTS = ["DD", "AU", "UD", "UA", "DU", "AA", "UU"]


def change_status(x: Column, y: Column) -> Column:
    """The status of a changed file from the index (x) and work tree (y) letters."""
    both = F.concat(x, y)
    one = F.when(x != " ", x).otherwise(y)
    return (
        F.when(both.isin(CONFLICTS), "conflicted").when(both == "??", "untracked").when(one == "A", "added").when(one == "D", "deleted")
        .when(one == "R", "renamed").when(one == "C", "copied").when(one == "T", "type_changed").when(one == "M", "modified").otherwise("unknown")
    )


#: Families of commands by their first word.
COMMAND_FAMILIES = {
    "git": "git", "cargo": "cargo", "dotnet": "dotnet", "npm": "npm", "npx": "npm", "pnpm": "pnpm", "yarn": "yarn", "ng": "ng", "tsc": "tsc", "eslint": "eslint",
    "docker": "docker", "docker-compose": "docker_compose", "rg": "rg", "ripgrep": "rg", "grep": "grep", "cat": "cat", "type": "cat", "get-content": "cat", "tree": "tree",
}


def command_family(command: Column) -> Column:
    """By the first word, without quotes and .exe; "docker compose" is a family of its own, any other word is unknown."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(command, F.lit("")), r"^\s+", "")), r"\s+")
    first = F.regexp_replace(F.regexp_replace(words[0], '^"+|"+$', ""), r"(\.exe)+$", "")
    known = F.element_at(F.create_map(*(F.lit(x) for kv in COMMAND_FAMILIES.items() for x in kv)), first)
    return F.when((first == "docker") & (F.get(words, F.lit(1)) == "compose"), "docker_compose").otherwise(F.coalesce(known, F.lit("unknown")))


def intent(query: Column) -> Column:
    """The intent of a query, by the first keyword rule that holds."""
    q = F.lower(F.coalesce(query, F.lit("")))
    has = lambda *words: _any(q, words)
    return (
        F.when(has("caller", "who calls"), "callers").when(has("callee", "calls from"), "callees").when(has("dependency", "path", "trace"), "trace")
        .when(has("impact", "affected"), "impact").when(has("context", "pack"), "pack").when(has("test"), "test").when(has("explain", "what is"), "explanation")
        .when(q.rlike(r"^[\p{L}\p{N}_:]*$"), "symbol_lookup").otherwise("code_search")
    )


def _any(q: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | q.contains(w)
    return out
