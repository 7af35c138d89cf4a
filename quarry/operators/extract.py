"""Extraction from source text by rule tables: symbols, routes, messages, data access, configuration, mark-up.

A file is a row (path, content). Lines are exploded once; a rule is a language,
a kind and a pattern whose first group is the name (and, for routes, whose
second is the path). All rules of a language run on a line in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.keys import language_of
from quarry.functions.text import redact_secrets

#: Language, kind, pattern of symbols; group 1 is the name.
SYMBOLS = [
    ("rust", "Module", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+([A-Za-z_]\w*)"),
    ("rust", "Struct", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+([A-Za-z_]\w*)"),
    ("rust", "Enum", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+([A-Za-z_]\w*)"),
    ("rust", "Trait", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+([A-Za-z_]\w*)"),
    ("rust", "Function", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"),
    ("rust", "Import", r"^\s*use\s+([\w:]+)"),
    ("python", "Class", r"^\s*class\s+([A-Za-z_]\w*)"),
    ("python", "Function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    ("python", "Import", r"^\s*(?:from|import)\s+([\w.]+)"),
    ("typescript", "Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "Interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ("typescript", "Import", r"^\s*import\s.*from\s+['\"]([^'\"]+)['\"]"),
    ("javascript", "Class", r"^\s*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("javascript", "Function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("javascript", "Import", r"require\(['\"]([^'\"]+)['\"]\)"),
    ("go", "Package", r"^package\s+(\w+)"),
    ("go", "Struct", r"^type\s+(\w+)\s+struct"),
    ("go", "Interface", r"^type\s+(\w+)\s+interface"),
    ("go", "Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("csharp", "Namespace", r"^\s*namespace\s+([\w.]+)"),
    ("csharp", "Class", r"^\s*(?:(?:public|internal|private|abstract|sealed|static|partial)\s+)*class\s+(\w+)"),
    ("csharp", "Import", r"^\s*using\s+([\w.]+);"),
    ("java", "Class", r"^\s*(?:(?:public|private|abstract|final)\s+)*class\s+(\w+)"),
    ("java", "Import", r"^\s*import\s+([\w.]+);"),
    ("kt", "Class", r"^\s*(?:data\s+)?class\s+(\w+)"),
    ("kotlin", "Class", r"^\s*(?:data\s+|open\s+)?class\s+(\w+)"),
    ("kotlin", "Function", r"^\s*(?:suspend\s+)?fun\s+(\w+)"),
    ("swift", "Class", r"^\s*(?:public\s+)?(?:class|struct)\s+(\w+)"),
    ("swift", "Function", r"^\s*(?:public\s+)?func\s+(\w+)"),
    ("dart", "Class", r"^\s*(?:abstract\s+)?class\s+(\w+)"),
    ("c", "Function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\([^;]*\)\s*\{"),
    ("cpp", "Class", r"^\s*(?:class|struct)\s+(\w+)"),
    ("sql", "Table", r"(?i)^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"),
    ("sql", "View", r"(?i)^\s*create\s+(?:or\s+replace\s+)?view\s+([\w.]+)"),
    ("sql", "Procedure", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:procedure|function)\s+([\w.]+)"),
    ("sql", "Stream", r"(?i)^\s*create\s+stream\s+([\w.]+)"),
    ("css", "Selector", r"^\s*([.#][\w-]+)\s*\{"),
    ("scss", "Mixin", r"^\s*@mixin\s+([\w-]+)"),
    ("scss", "Variable", r"^\s*\$([\w-]+)\s*:"),
    ("dockerfile", "Image", r"(?i)^FROM\s+(\S+)"),
    ("dockerfile", "Port", r"(?i)^EXPOSE\s+(\d+)"),
    ("xaml", "Binding", r"\{Binding\s+(?:Path=)?(\w+)"),
    ("rb", "Class", r"^\s*class\s+(\w+)"),
    ("php", "Class", r"^\s*(?:final\s+|abstract\s+)?class\s+(\w+)"),
    ("tf", "Resource", r"^\s*resource\s+\"[\w-]+\"\s+\"([\w-]+)\""),
]
#: Language, framework, pattern of routes; group 1 is the method, group 2 the path.
ROUTES = [
    ("javascript", "express", r"\b(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("typescript", "express", r"\b(?:app|router|fastify)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("typescript", "nest", r"@(Get|Post|Put|Patch|Delete)\(\s*['\"]([^'\"]*)['\"]"),
    ("python", "fastapi", r"@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("java", "spring", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*\"([^\"]*)\""),
    ("kotlin", "spring", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*\"([^\"]*)\""),
    ("csharp", "aspnet", r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\""),
    ("go", "router", r"\.(GET|POST|PUT|PATCH|DELETE)\(\s*\"([^\"]+)\""),
    ("php", "laravel", r"Route::(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("rb", "rails", r"^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]"),
]
#: Technology, role, pattern of messages; group 1 is the topic, queue or event.
MESSAGES = [
    ("kafka", "producer", r"\b(?:producer\.send|send)\(\s*\{?\s*(?:topic:\s*)?['\"]([\w.-]+)['\"]"),
    ("kafka", "consumer", r"(?:@KafkaListener\(\s*topics\s*=\s*|consumer\.subscribe\(\s*\{?\s*(?:topics?:\s*)?)\[?['\"]([\w.-]+)['\"]"),
    ("rabbitmq", "producer", r"\bsendToQueue\(\s*['\"]([\w.-]+)['\"]"),
    ("rabbitmq", "consumer", r"(?:\bconsume\(\s*|@RabbitListener\(\s*queues\s*=\s*)['\"]([\w.-]+)['\"]"),
    ("nestjs", "consumer", r"@(?:MessagePattern|EventPattern)\(\s*['\"]([\w.-]+)['\"]"),
    ("socketio", "producer", r"\bemit\(\s*['\"]([\w:.-]+)['\"]"),
    ("socketio", "consumer", r"\bsocket\.on\(\s*['\"]([\w:.-]+)['\"]"),
]
#: Technology, operation, pattern of data access; group 1 is the entity or table.
DATA_ACCESS = [
    ("sql", "read", r"(?i)\bfrom\s+([\w.]+)"), ("sql", "read", r"(?i)\bjoin\s+([\w.]+)"), ("sql", "write", r"(?i)\binsert\s+into\s+([\w.]+)"),
    ("sql", "write", r"(?i)\bupdate\s+([\w.]+)\s+set\b"), ("sql", "write", r"(?i)\bdelete\s+from\s+([\w.]+)"),
    ("prisma", "read", r"\bprisma\.(\w+)\.find"), ("efcore", "entity", r"\bDbSet<(\w+)>"), ("jpa", "entity", r"\bJpaRepository<(\w+)"),
]
#: HTTP clients: method (or a fixed one) and URL.
CLIENTS = r"\b(?:fetch\(\s*|(?:axios|http|client)\.(?:get|post|put|patch|delete)\(\s*|http\.(?:Get|Post)\(\s*|(?:Get|Post|Put|Delete)Async\(\s*)['\"]([^'\"]+)['\"]"


#: Languages that take the rules of another one.
RULES_OF = {"tsx": "typescript", "jsx": "javascript", "c_header": "c", "cpp_header": "cpp"}


def rules_language(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RULES_OF.items() for x in kv)), language_of(path)), language_of(path))


def numbered_lines(files: DataFrame) -> DataFrame:
    """path, language, line, s: every line of every file once."""
    return files.select("path", rules_language(F.col("path")).alias("language"), F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "s")).select("path", "language", (F.col("i") + 1).alias("line"), "s")


def _hits(lines: DataFrame, rules, fields) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(test & F.col("s").rlike(pattern), F.struct(*(x.alias(n) for n, x in zip(fields, values, strict=True)))) for test, pattern, values in rules)))
    return lines.select("path", "line", F.explode(found).alias("x")).select("path", "line", "x.*")


def symbols(files: DataFrame) -> DataFrame:
    """path, line, kind, name of the symbols by the rules of each file's language."""
    rules = [(F.col("language") == lang, p, (F.lit(kind), F.regexp_extract("s", p, 1))) for lang, kind, p in SYMBOLS]
    return _hits(numbered_lines(files), rules, ("kind", "name"))


def routes(files: DataFrame) -> DataFrame:
    rules = [(F.col("language") == lang, p, (F.lit(fw), F.upper(F.regexp_extract("s", p, 1)), F.regexp_extract("s", p, 2))) for lang, fw, p in ROUTES]
    return _hits(numbered_lines(files), rules, ("framework", "method", "route"))


def messages(files: DataFrame) -> DataFrame:
    rules = [(F.lit(True), p, (F.lit(tech), F.lit(role), F.regexp_extract("s", p, 1))) for tech, role, p in MESSAGES]
    return _hits(numbered_lines(files), rules, ("technology", "role", "name"))


def data_access(files: DataFrame) -> DataFrame:
    rules = [(F.lit(True), p, (F.lit(tech), F.lit(op), F.regexp_extract("s", p, 1))) for tech, op, p in DATA_ACCESS]
    return _hits(numbered_lines(files), rules, ("technology", "operation", "name"))


def http_clients(files: DataFrame) -> DataFrame:
    """path, line, url of client calls, distinct."""
    found = numbered_lines(files).select("path", "line", F.explode(F.regexp_extract_all("s", F.lit(CLIENTS), F.lit(1))).alias("url"))
    return found.distinct()


def settings(files: DataFrame) -> DataFrame:
    """path, line, key, value of ``key=value`` and ``key: value`` lines of configuration files; secrets redacted."""
    p = r"^\s*([A-Za-z_][\w.-]*)\s*[=:]\s*(.+?)\s*$"
    lines = numbered_lines(files).filter(F.col("language").isin("yaml", "toml", "env", "properties", "ini") & F.col("s").rlike(p))
    clean = redact_secrets(F.col("s"))
    return lines.select("path", "line", F.regexp_extract("s", p, 1).alias("key"), F.regexp_extract(clean, p, 2).alias("value"))


def call_edges(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, caller, callee, confidence (8500): calls of functions of the same file, by first name; each line belongs to the last function above it."""
    functions = found.filter("kind = 'Function'").select("path", F.col("line").alias("at"), "name")
    lines = numbered_lines(files).select("path", "line", "s").join(functions.withColumnRenamed("at", "line"), ["path", "line"], "left")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumn("caller", F.last("name", True).over(w)).filter("name is null and caller is not null")
    called = owned.select("path", "caller", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1)))).alias("callee"))
    known = functions.select("path", F.col("name").alias("callee")).distinct()
    return called.filter("caller <> callee").join(known, ["path", "callee"], "left_semi").select("path", "caller", "callee", F.lit(8500).cast("bigint").alias("confidence")).distinct()


def wildcard(pattern: str) -> str:
    """A glob of ``*`` (within a segment), ``**`` (across segments) and ``?`` as a regular expression."""
    import re

    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = pattern[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return f"^{out}$"


def scope_predicate(text: str):
    """The filter of a scope: project, path:, file:, glob:, language:. A path may not climb out of the project."""
    kind, _, value = text.partition(":")
    if text == "project":
        return F.lit(True)
    if not value or ".." in value.split("/"):
        raise ValueError(f"not a scope: {text}")
    path = F.col("path")
    tests = {"path": lambda: path.startswith(value.rstrip("/") + "/") | (path == value), "file": lambda: path == value, "glob": lambda: path.rlike(wildcard(value)), "language": lambda: language_of(path) == value.lower()}
    if kind not in tests:
        raise ValueError(f"not a scope: {text}")
    return tests[kind]()
