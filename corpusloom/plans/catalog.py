"""The registered queries: operators applied to the derived tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, rules
from ..operators import condense, delta, docstrings, documents, files, graph, lineage, merkle, modules, navigation, postings, projects, reach, snapshot, translation
from ..sources import sinks, tree
from ..sources.fixtures import duck, fixture
from ..streaming.changes import batch_changes
from . import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with SQL for DuckDB where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -- SQL of path expressions ------------------------------------------------

BASE = "regexp_extract(path, '[^/]*$')"
EXT = f"regexp_extract({BASE}, '^.+(\\.[^.]*)$', 1)"
LANG = "CASE lower(" + EXT + ") " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in rules.LANGUAGE_OF.items()) + " END"
EXCLUDE = files.excluded_names()
HAS_EXCLUDED = f"len(list_intersect(string_split(path, '/'), [{listed(EXCLUDE)}])) > 0"
IS_CODE, IS_DOC = f"{EXT} IN ({listed(rules.CODE)})", f"{EXT} IN ({listed(rules.DOCS)})"
ENDINGS = "|".join(e[1:] for e in rules.LANGUAGE_OF)


def kebab_sql(name: str) -> str:
    return f"lower(regexp_replace(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g'))"


def doc_path_sql(path: str) -> str:
    inner = f"regexp_extract({path}, '(?i)^src/(.+?)\\.({ENDINGS})$', 1)"
    tail = kebab_sql(f"regexp_extract({inner}, '[^/]*$')")
    return f"CASE WHEN {inner} <> '' THEN concat('modules/', regexp_extract({inner}, '^(.*/)', 1), {tail}, '.md') END"


HASH16 = "substring(sha256(content), 1, 16)"
DIFF = f"""
o AS (SELECT path, {HASH16} AS hash FROM snap_old), n AS (SELECT path, {HASH16} AS hash FROM snap_new),
d AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.hash = o.hash THEN 'unchanged' ELSE 'modified' END AS status, coalesce(n.hash, o.hash) AS hash
      FROM n FULL OUTER JOIN o ON n.path = o.path)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.diff(snapshot.snapshot(fixture(spark, d, "snap_new")), snapshot.snapshot(fixture(spark, d, "snap_old")))


# -- snapshots --------------------------------------------------------------


@query(duck("tree") + f" SELECT doc_id, {HASH16} AS hash FROM tree")
def content_hash16(spark, d):
    return fixture(spark, d, "tree").select("doc_id", snapshot.fingerprint(F.col("content")).alias("hash"))


@query(duck("tree") + f" SELECT path, {HASH16} AS hash FROM tree WHERE NOT ({HAS_EXCLUDED}) AND ({IS_CODE} OR {IS_DOC})")
def source_snapshot(spark, d):
    return snapshot.snapshot(files.included(fixture(spark, d, "tree"), EXCLUDE))


@query(duck("snap_old", "snap_new") + f",{DIFF} SELECT path, status, hash FROM d")
def source_diff(spark, d):
    return changes(spark, d)


@query(
    duck("snap_old", "snap_new") + f",{DIFF}, c AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'unchanged') AS unchanged FROM d) "
    "SELECT *, CASE WHEN added + modified + deleted = 0 THEN 'No changes' ELSE concat_ws(', ', CASE WHEN added > 0 THEN concat(added, ' added') END, CASE WHEN modified > 0 THEN concat(modified, ' modified') END, CASE WHEN deleted > 0 THEN concat(deleted, ' deleted') END) END AS summary FROM c"
)
def diff_summary(spark, d):
    return snapshot.summary(changes(spark, d))


@query(
    duck("snap_old", "snap_new") + f" SELECT n.path, substring(sha256(n.content), 1, 16) AS hash, CASE WHEN o.path IS NULL THEN '2024-02-02' ELSE '2024-01-01' END AS created_at, '2024-02-02' AS updated_at FROM snap_new n LEFT JOIN snap_old o ON n.path = o.path"
)
def snapshot_commit(spark, d):
    old = snapshot.snapshot(fixture(spark, d, "snap_old")).withColumn("created_at", F.lit("2024-01-01"))
    return snapshot.commit(snapshot.snapshot(fixture(spark, d, "snap_new")), old, F.lit("2024-02-02"))


# -- files ------------------------------------------------------------------


@query(duck("tree") + f" SELECT doc_id, path, {IS_CODE} AS is_code FROM tree")
def is_code(spark, d):
    return fixture(spark, d, "tree").select("doc_id", "path", files.is_code(F.col("path")).alias("is_code"))


@query(duck("tree") + f" SELECT doc_id, path, {IS_DOC} AS is_doc FROM tree")
def is_doc(spark, d):
    return fixture(spark, d, "tree").select("doc_id", "path", files.is_doc(F.col("path")).alias("is_doc"))


@query(duck("tree") + f" SELECT path FROM tree WHERE {HAS_EXCLUDED} OR path LIKE '%.log'")
def excluded_paths(spark, d):
    return fixture(spark, d, "tree").where(files.is_excluded(F.col("path"), [*EXCLUDE, "*.log"])).select("path")


@query(duck("tree") + f" SELECT path FROM tree WHERE NOT ({HAS_EXCLUDED}) AND ({IS_CODE} OR {IS_DOC})")
def include_files(spark, d):
    return files.included(fixture(spark, d, "tree"), EXCLUDE).select("path")


@query(duck("names") + " SELECT DISTINCT folder AS name, folder IN ('.git', 'target', 'vendor', '__pycache__', 'TestResults', '.gradle', 'htmlcov', 'own') AS excluded FROM names")
def exclude_set(spark, d):
    return fixture(spark, d, "names").select(F.col("folder").alias("name"), F.col("folder").isin(files.excluded_names(("own",))).alias("excluded")).distinct()


@query(duck("tree") + f" SELECT path FROM tree WHERE {LANG} IS NOT NULL")
def code_files(spark, d):
    return fixture(spark, d, "tree").where(paths.language(F.col("path")).isNotNull()).select("path")


@query(duck("tree") + f" SELECT doc_id, path, {LANG} AS language FROM tree")
def detect_language(spark, d):
    return fixture(spark, d, "tree").select("doc_id", "path", paths.language(F.col("path")).alias("language"))


@query(duck("tree") + f" SELECT {LANG} AS language, count(*) AS n_files FROM tree WHERE NOT ({HAS_EXCLUDED}) AND ({IS_CODE} OR {IS_DOC}) AND {LANG} IS NOT NULL GROUP BY 1")
def languages_by_files(spark, d):
    rows = files.included(fixture(spark, d, "tree"), EXCLUDE).select(paths.language(F.col("path")).alias("language"))
    return rows.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


ROOTS = "|".join(rules.SOURCE_ROOTS)


@query(
    duck("tree") + f" SELECT regexp_extract(path, '^({ROOTS})/([^/]+)/', 1) AS root, regexp_extract(path, '^({ROOTS})/([^/]+)/', 2) AS module, count(*) AS n_files FROM tree WHERE {IS_CODE} AND NOT ({HAS_EXCLUDED}) AND regexp_matches(path, '^({ROOTS})/([^/]+)/') GROUP BY 1, 2"
)
def discover_modules(spark, d):
    return files.modules(files.included(fixture(spark, d, "tree"), EXCLUDE))


@query(
    duck("tree") + f" SELECT count(*) AS n_files, count(*) FILTER ({IS_CODE}) AS n_code, count(*) FILTER ({IS_DOC}) AS n_docs, count(DISTINCT CASE WHEN {IS_CODE} AND regexp_matches(path, '^({ROOTS})/([^/]+)/') THEN regexp_extract(path, '^(({ROOTS})/[^/]+)/', 1) END) AS n_modules FROM tree WHERE NOT ({HAS_EXCLUDED}) AND ({IS_CODE} OR {IS_DOC})"
)
def project_stats(spark, d):
    p = F.col("path")
    module = F.when(files.is_code(p) & p.rlike(f"^({ROOTS})/([^/]+)/"), F.regexp_extract(p, f"^(({ROOTS})/[^/]+)/", 1))
    return files.included(fixture(spark, d, "tree"), EXCLUDE).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(files.is_code(p)).alias("n_code"), F.count_if(files.is_doc(p)).alias("n_docs"), F.count_distinct(module).alias("n_modules")
    )


@query(duck("tree") + " SELECT path FROM tree WHERE regexp_matches(path, '^docs/[^/]+\\.md$') OR path IN ('README.md')")
def find_docs(spark, d):
    return files.known_docs(fixture(spark, d, "tree"))


@query(duck("names") + ", l AS (SELECT trim(line) AS line FROM names), f AS (SELECT CASE WHEN line LIKE '%/' THEN left(line, length(line) - 1) WHEN NOT regexp_matches(line, '[*?/.]') THEN line END AS name FROM l WHERE line <> '' AND left(line, 1) NOT IN ('#', '!')) SELECT DISTINCT name FROM f WHERE name IS NOT NULL AND NOT regexp_matches(name, '[*?/]')")
def gitignore_dirs(spark, d):
    return files.gitignore_dirs(fixture(spark, d, "names").select("line"))


# -- modules ----------------------------------------------------------------


def category_sql(name: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({name}), '{w}')" for w in ws) + f" THEN '{label}'" for label, ws in rules.CATEGORIES) + " ELSE 'module' END"


SIGNALS = """s AS (SELECT module, count(*) AS n_files, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines, count(DISTINCT doc_id % 25) AS n_exports, CAST(max(doc_id % 5) AS BIGINT) AS depth, CAST(max(doc_id % 14) AS BIGINT) AS n_in, CAST(max(doc_id % 13) AS BIGINT) AS n_out, max(doc_id % 14) > 6 AS is_entry FROM module_base GROUP BY module)"""
SCORE = "CAST(least(floor(least(n_files * CAST(3 AS DOUBLE), 30) + least(n_lines / CAST(50 AS DOUBLE), 30) + least(n_exports * CAST(1.5 AS DOUBLE), 20) + least(depth * CAST(5 AS DOUBLE), 20) + CAST(0.5 AS DOUBLE)), 100) AS BIGINT)"
ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(module), '{w}')" for w in ws) + f" THEN '{label}'" for label, ws in rules.ROLES) + " WHEN is_entry AND n_in > 5 THEN 'core' WHEN n_exports > 15 THEN 'core' WHEN score > 60 THEN 'core' WHEN n_files <= 5 AND n_exports <= 5 THEN 'utility' ELSE 'unknown' END"
TEMPLATE = "CASE WHEN score >= 50 OR n_exports >= 10 THEN 'full' WHEN score < 30 AND n_exports < 5 THEN 'simple' WHEN role IN ('test', 'config', 'utility') THEN 'simple' ELSE 'full' END"
ALL_SIGNALS = f"{SIGNALS}, t AS (SELECT *, {SCORE} AS score FROM s), r AS (SELECT *, {ROLE} AS role FROM t), m AS (SELECT *, {TEMPLATE} AS template FROM r)"


def signals(spark: SparkSession, d: str) -> DataFrame:
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    most = lambda n: F.max(F.col("doc_id") % n).cast("long")
    rows = fixture(spark, d, "module_base").groupBy("module").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(n_lines).cast("long").alias("n_lines"), F.count_distinct(F.col("doc_id") % 25).alias("n_exports"),
        most(5).alias("depth"), most(14).alias("n_in"), most(13).alias("n_out"), (F.max(F.col("doc_id") % 14) > 6).alias("is_entry"),
    )
    c = F.col
    rows = rows.withColumn("score", modules.complexity(c("n_files"), c("n_lines"), c("n_exports"), c("depth")))
    rows = rows.withColumn("role", modules.role(c("module"), c("is_entry"), c("n_in"), c("n_exports"), c("score"), c("n_files")))
    return rows.withColumn("template", modules.template(c("score"), c("n_exports"), c("role")))


@query(duck("module_base") + f" SELECT DISTINCT module, {category_sql('module')} AS category FROM module_base")
def module_category(spark, d):
    return fixture(spark, d, "module_base").select("module", modules.category(F.col("module")).alias("category")).distinct()


@query(duck("module_base") + f", {ALL_SIGNALS} SELECT module, n_files, n_lines, n_exports, depth, score FROM m")
def module_complexity(spark, d):
    return signals(spark, d).select("module", "n_files", "n_lines", "n_exports", "depth", "score")


@query(duck("module_base") + f", {ALL_SIGNALS} SELECT module, role FROM m")
def module_role(spark, d):
    return signals(spark, d).select("module", "role")


@query(duck("module_base") + f", {ALL_SIGNALS} SELECT module, role, score, template FROM m")
def module_template(spark, d):
    return signals(spark, d).select("module", "role", "score", "template")


HINT_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(module), '\\b({w})') THEN '{h}' END" for w, h in rules.HINTS) + f", CASE WHEN n_exports > 20 THEN '{rules.HINT_EXPORTS}' END, CASE WHEN n_in > 10 THEN '{rules.HINT_DEPENDED}' END, CASE WHEN is_entry AND n_out > 10 THEN '{rules.HINT_ENTRY}' END], lambda x: x IS NOT NULL)"


@query(duck("module_base") + f", {ALL_SIGNALS} SELECT module, unnest(CASE WHEN len({HINT_LIST}) = 0 THEN ['{rules.HINT_NONE}'] ELSE {HINT_LIST} END) AS hint FROM m")
def module_hints(spark, d):
    c = F.col
    return signals(spark, d).select("module", F.explode(modules.hints(c("module"), c("is_entry"), c("n_in"), c("n_out"), c("n_exports"))).alias("hint"))


@query(duck("module_base") + f", {ALL_SIGNALS} SELECT count(*) AS n_modules, count(*) FILTER (template = 'full') AS n_full, count(*) FILTER (template = 'simple') AS n_simple FROM m")
def module_batch(spark, d):
    t = F.col("template")
    return signals(spark, d).agg(F.count(F.lit(1)).alias("n_modules"), F.count_if(t == "full").alias("n_full"), F.count_if(t == "simple").alias("n_simple"))


@query(duck("module_base") + f", {ALL_SIGNALS} SELECT module, {category_sql('module')} AS category, n_files, n_lines, n_exports, n_in, n_out, is_entry, depth, score, role, template FROM m")
def module_analysis(spark, d):
    return signals(spark, d).withColumn("category", modules.category(F.col("module"))).select("module", "category", "n_files", "n_lines", "n_exports", "n_in", "n_out", "is_entry", "depth", "score", "role", "template")


NESTED = "SELECT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS module, len(string_split(path, '/')) - 3 AS depth, content FROM code_files"


@query(
    duck("code_files") + f", f AS ({NESTED}), g AS (SELECT module, len(string_split(content, chr(10))) AS n, depth + least(len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '  ') OR starts_with(x, chr(9)))) // 20, 5) AS dep FROM f) "
    "SELECT module, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_lines, CAST(max(dep) AS BIGINT) AS depth FROM g GROUP BY module"
)
def module_files(spark, d):
    rows = fixture(spark, d, "code_files").select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("module"), (F.size(F.split("path", "/")) - 3).alias("depth"), "content")
    return modules.nesting(rows)


def extracted(rule: dict, languages) -> str:
    return " UNION ".join(f"SELECT path, '{lang}' AS language, unnest(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM code_files WHERE {LANG} = '{lang}'" for lang in languages for p in rule[lang])


@query(duck("code_files") + f" SELECT DISTINCT path, name FROM ({extracted(rules.EXPORTS, ('javascript', 'python', 'go'))})")
def module_exports(spark, d):
    return modules.exports(fixture(spark, d, "code_files"))


# -- graph ------------------------------------------------------------------


@query(duck("code_files") + f" SELECT DISTINCT path, language, name AS specifier FROM ({extracted(rules.IMPORTS, ('javascript', 'python', 'go'))})")
def parse_imports(spark, d):
    return graph.imports(fixture(spark, d, "code_files"))


# In this fixture a script imports ./fN and ../mK/fN.js, a Python file .fN: one base each.
RESOLVED = (
    f", i AS ({extracted(rules.IMPORTS, ('javascript', 'python'))}), b AS (SELECT path, name, CASE WHEN language = 'python' THEN concat(regexp_replace(path, '/[^/]*$', ''), '/', substring(name, 2)) WHEN starts_with(name, '../') THEN concat('src/', regexp_replace(substring(name, 4), '\\.js$', '')) ELSE concat(regexp_replace(path, '/[^/]*$', ''), '/', substring(name, 3)) END AS base, language FROM i), "
    f"c AS (SELECT path, base, e.ext, e.rank FROM b JOIN (SELECT * FROM (VALUES ('javascript', '.ts', 0), ('javascript', '.tsx', 1), ('javascript', '.js', 2), ('python', '.py', 0)) v(language, ext, rank)) e USING (language)), "
    "e AS (SELECT DISTINCT path AS src, arg_min(concat(base, ext), rank) AS dst FROM c WHERE concat(base, ext) IN (SELECT path FROM code_files) GROUP BY path, base) "
)


@query(duck("code_files") + RESOLVED + "SELECT DISTINCT src, dst FROM e")
def resolve_imports(spark, d):
    rows = fixture(spark, d, "code_files")
    return graph.resolve(graph.imports(rows), rows)


@query(duck("code_files") + RESOLVED + ", f AS (SELECT DISTINCT src, dst FROM e), g AS (SELECT src, dst, regexp_extract(src, '^([^/]+/[^/]+)/', 1) AS a, regexp_extract(dst, '^([^/]+/[^/]+)/', 1) AS b FROM f), o AS (SELECT a AS module, count(*) AS n FROM g GROUP BY 1), j AS (SELECT b AS module, count(DISTINCT src) AS n FROM g WHERE a <> b GROUP BY 1) SELECT coalesce(o.module, j.module) AS module, coalesce(j.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, coalesce(j.n, 0) > 0 AS is_entry FROM o FULL JOIN j ON o.module = j.module")
def module_dep_stats(spark, d):
    rows = fixture(spark, d, "code_files")
    return modules.degrees(graph.resolve(graph.imports(rows), rows))


@query(duck("code_files") + RESOLVED + ", f AS (SELECT DISTINCT src, dst FROM e) SELECT count(*) AS n_edges, count(DISTINCT src) AS n_importers, count(DISTINCT dst) AS n_imported FROM f")
def graph_counts(spark, d):
    rows = fixture(spark, d, "code_files")
    return graph.resolve(graph.imports(rows), rows).agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_importers"), F.count_distinct("dst").alias("n_imported"))


def written_out(language_patterns: str) -> str:
    """Lines of a language and a pattern, as SQL that applies them to ``polyglot``."""
    lines = [line.strip().split(" ", 1) for line in language_patterns.strip().splitlines()]
    return " UNION ".join(f"SELECT path, '{language}' AS language, unnest(regexp_extract_all(content, '{pattern.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM polyglot WHERE doc_id % 8 = {POLYGLOT[language]}" for language, pattern in lines)


POLYGLOT = {"javascript": 0, "python": 1, "go": 2, "rust": 3, "java": 4, "ruby": 5, "php": 6, "dotnet": 7}
ALL_IMPORTS = written_out(r"""
    javascript (?:import|export)\s+(?s:.)*?\s+from\s+['"](\.[^'"]+)['"]
    javascript (?:import|export)\s+['"](\.[^'"]+)['"]
    javascript require\s*\(\s*['"](\.[^'"]+)['"]\s*\)
    javascript import\s*\(\s*['"](\.[^'"]+)['"]\s*\)
    python (?m)^\s*from\s+(\.\S+)\s+import
    python (?m)^\s*import\s+(\.[^\s,]+)
    go import\s+"([^"]+)"
    rust \bmod\s+(\w+)
    java (?m)^\s*import\s+([\w.]+)
    ruby \brequire\s+['"]([^'"]+)['"]
    ruby \brequire_relative\s+['"]([^'"]+)['"]
    php \buse\s+([\w\\]+)
    php \brequire(?:_once)?\s+['"]([^'"]+)['"]
    php \binclude(?:_once)?\s+['"]([^'"]+)['"]
    dotnet (?m)^\s*using\s+([\w.]+)
""")
ALL_EXPORTS = written_out(r"""
    javascript \bexport\s+(?:default\s+)?(?:class|function|const|interface|type)\s+(\w+)
    javascript \bexport\s*\{\s*([^}]+)\s*\}
    javascript \bmodule\.exports\s*=\s*\{([^}]+)\}
    python \bdef\s+(\w+)\s*\(
    python \bclass\s+(\w+)\s*[(:]
    go \bfunc\s+(\w+)\s*\(
    go \bfunc\s+\([^)]+\)\s+(\w+)\s*\(
    go \btype\s+(\w+)\s+(?:struct|interface|func)
    rust \b(?:pub\s+)?(?:fn|struct|enum|trait|impl)\s+(\w+)
    rust \b(?:pub\s+)?const\s+(\w+)
    java \b(?:public|protected)\s+(?:class|interface|enum)\s+(\w+)
    java \b(?:public|protected)\s+(?:static\s+)?(?:final\s+)?\w+\s+(\w+)\s*\(
    ruby \bdef\s+(?:self\.)?(\w+)
    ruby \bclass\s+(\w+)
    php \b(?:public|private|protected)\s+(?:static\s+)?function\s+(\w+)\s*\(
    php \bclass\s+(\w+)
    php \binterface\s+(\w+)
    dotnet \b(?:public|internal)\s+(?:class|interface|struct|enum)\s+(\w+)
    dotnet \b(?:public|internal)\s+(?:static\s+)?(?:readonly\s+)?(?:virtual\s+)?(?:async\s+)?(?:Task<)?(\w+)>?\s+\w+\s*\(
""")


@query(duck("polyglot") + f" SELECT DISTINCT path, language, name AS specifier FROM ({ALL_IMPORTS})")
def all_language_imports(spark, d):
    return graph.imports(fixture(spark, d, "polyglot"))


@query(duck("polyglot") + f" SELECT DISTINCT path, name FROM ({ALL_EXPORTS})")
def all_language_exports(spark, d):
    return modules.exports(fixture(spark, d, "polyglot"))


def two_trees(spark: SparkSession, d: str, name: str, path: str, was: str, now: str) -> tuple[DataFrame, DataFrame]:
    """An earlier and a later state of a derived table: rows came, went and changed."""
    rows = fixture(spark, d, name)
    older = F.when(F.col("doc_id") % 7 == 0, F.replace("content", F.lit(was), F.lit(now))).otherwise(F.col("content"))
    return rows.where("doc_id % 10 <> 0").select(path, older.alias("content")), rows.where("doc_id % 11 <> 0").select(path, "content")


def changed_parts(old: DataFrame, new: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed rows with content, paths that came, paths that went)."""
    names = lambda t: t.select(F.col(path).alias("path"), "content")
    told = snapshot.diff(snapshot.snapshot(names(new)), snapshot.snapshot(names(old)))
    of = lambda *status: told.where(F.col("status").isin(*status)).select(F.col("path").alias(path))
    return new.join(of("added", "modified"), path, "left_semi"), of("added"), of("deleted")


@query(duck("code_files") + ", code_new AS (SELECT path, content FROM code_files WHERE doc_id % 11 <> 0)" + RESOLVED.replace("code_files", "code_new") + "SELECT DISTINCT src, dst FROM e")
def build_deps_delta(spark, d):
    """The import graph of the earlier tree, brought up to the later one by its changes."""
    old, new = two_trees(spark, d, "code_files", "path", "f1", "f2")
    state, _ = delta.deps_delta(delta.deps(old), *changed_parts(old, new, "path"), new.select("path"))
    return state.edges.select("src", "dst")


@query(duck("snap_old", "snap_new") + f",{DIFF} SELECT path, status, hash FROM d WHERE status <> 'unchanged'")
def merkle_diff(spark, d):
    return merkle.diff(*(snapshot.snapshot(fixture(spark, d, n)) for n in ("snap_new", "snap_old")))


@query(duck("snap_old", "snap_new") + f",{DIFF} SELECT dir, count(*) AS n_changed FROM (SELECT unnest(['', 'src', regexp_replace(path, '/[^/]*$', '')]) AS dir FROM d WHERE status <> 'unchanged') q GROUP BY dir")
def changed_subtrees(spark, d):
    return merkle.subtree_counts(*(snapshot.snapshot(fixture(spark, d, n)) for n in ("snap_new", "snap_old")))


@query(duck("import_edges") + " SELECT dst, count(DISTINCT src) AS n_importers FROM import_edges GROUP BY dst")
def imported_by(spark, d):
    return graph.imported_by(fixture(spark, d, "import_edges"))


REACH = ", w AS (SELECT CAST(doc_id AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth FROM documents WHERE doc_id % 100 = 0 UNION SELECT e.src, w.depth + 1 FROM w JOIN import_edges e ON e.dst = w.node WHERE w.depth < 3) "


@query(duck("import_edges") + REACH + "SELECT node, min(depth) AS depth, min(depth) = 1 AS is_direct FROM w GROUP BY node HAVING min(depth) > 0")
def transitive_impact(spark, d):
    seeds = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 100 = 0").select(F.col("doc_id").alias("node"))
    return graph.impact(fixture(spark, d, "import_edges"), seeds).select("node", "depth", (F.col("depth") == 1).alias("is_direct"))


# a change set for every 50 documents; its seed is their longest one
SETS = "SELECT doc_id // 50 AS set_id, arg_max(doc_id, concat(lpad(CAST(coalesce(n_chars, 0) AS VARCHAR), 12, '0'), lpad(CAST(doc_id AS VARCHAR), 20, '0'))) AS node FROM documents GROUP BY doc_id // 50"
CHAINED = f"""
, s AS ({SETS}), ed AS (SELECT DISTINCT src, dst FROM import_edges),
w AS (SELECT set_id, node, CAST(0 AS BIGINT) AS depth FROM s UNION SELECT w.set_id, ed.src, w.depth + 1 FROM w JOIN ed ON ed.dst = w.node WHERE w.depth < 3),
m AS (SELECT set_id, node, min(depth) AS depth FROM w GROUP BY set_id, node),
p AS (SELECT m.set_id, m.node, m.depth, min(q.node) AS parent FROM m LEFT JOIN ed ON ed.src = m.node LEFT JOIN m q ON q.set_id = m.set_id AND q.node = ed.dst AND q.depth = m.depth - 1 GROUP BY m.set_id, m.node, m.depth),
c AS (SELECT set_id, node, depth, CAST(node AS VARCHAR) AS chain FROM p WHERE depth = 0 UNION ALL SELECT p.set_id, p.node, p.depth, concat(c.chain, ' > ', CAST(p.node AS VARCHAR)) FROM p JOIN c ON c.set_id = p.set_id AND c.node = p.parent AND c.depth = p.depth - 1)
"""


def change_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.groupBy(F.expr("doc_id div 50").alias("set_id")).agg(F.max_by("doc_id", F.struct(F.coalesce("n_chars", F.lit(0)), "doc_id")).alias("node"))


@query(duck("import_edges") + CHAINED + "SELECT set_id, node, depth, chain FROM c")
def impact_chains(spark, d):
    return reach.chains(reach.impact(fixture(spark, d, "import_edges"), change_sets(spark, d)))


@query(duck("import_edges") + CHAINED + "SELECT set_id, count(*) FILTER (depth = 1) AS n_direct, count(*) FILTER (depth > 1) AS n_transitive, max(depth) AS deepest FROM p GROUP BY set_id")
def impact_of_sets(spark, d):
    found = reach.impact(fixture(spark, d, "import_edges"), change_sets(spark, d))
    return found.groupBy("set_id").agg(F.count_if(F.col("depth") == 1).alias("n_direct"), F.count_if(F.col("depth") > 1).alias("n_transitive"), F.max("depth").alias("deepest"))


def seed_docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 97 = 4").select(F.col("doc_id").alias("node"))


@query(duck("doc_edges") + " SELECT DISTINCT e.src AS node, CAST(1 AS BIGINT) AS depth FROM doc_edges e JOIN documents s ON e.dst = s.doc_id AND s.doc_id % 97 = 4 WHERE NOT e.src % 97 = 4")
def doc_propagation(spark, d):
    return graph.referrers(fixture(spark, d, "doc_edges"), seed_docs(spark, d))


@query(duck("doc_edges") + ", w AS (SELECT CAST(doc_id AS BIGINT) AS node FROM documents WHERE doc_id % 97 = 4 UNION SELECT e.src FROM w JOIN doc_edges e ON e.dst = w.node) SELECT node FROM w")
def doc_closure(spark, d):
    return graph.closure(fixture(spark, d, "doc_edges"), seed_docs(spark, d))


@query(
    duck("ring_edges") + ", w AS (SELECT DISTINCT src AS a, src AS b FROM ring_edges UNION SELECT w.a, e.dst FROM w JOIN ring_edges e ON e.src = w.b), c AS (SELECT x.a AS node, min(x.b) AS comp, count(*) AS n_nodes FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT * FROM c WHERE n_nodes > 1"
)
def doc_cycles(spark, d):
    """Documents that link to each other in a circle, with its first document and its size."""
    found = condense.components(fixture(spark, d, "ring_edges"))
    size = found.groupBy("comp").agg((F.count(F.lit(1)) + 1).alias("n_nodes"))
    nodes = found.unionAll(found.select(F.col("comp").alias("node"), "comp").distinct())
    return nodes.join(condense.dealt(size), "comp").select("node", "comp", "n_nodes")


@query(duck("ring_edges") + f", s AS ({SETS}), w AS (SELECT set_id, node FROM s UNION SELECT w.set_id, e.src FROM w JOIN ring_edges e ON e.dst = w.node) SELECT set_id, node FROM w")
def doc_closures(spark, d):
    """All documents that reach a change set, for every set, from one index."""
    return condense.closures(condense.condense(fixture(spark, d, "ring_edges")), change_sets(spark, d))


# -- documents --------------------------------------------------------------

REFS = """rf AS (SELECT DISTINCT doc_path, regexp_extract(m, '\\]\\((?:\\.\\.?)?/((?:src|lib|app|packages)/[^)#]+)', 1) AS file, try_cast(regexp_extract(m, '#L(\\d+)', 1) AS INT) AS line_start, try_cast(regexp_extract(m, '-L(\\d+)', 1) AS INT) AS line_end
 FROM (SELECT doc_path, unnest(regexp_extract_all(content, '\\[[^\\]]*\\]\\((?:\\.\\.?)?/(?:src|lib|app|packages)/[^)]+\\)')) AS m FROM md_docs))"""


@query(duck("md_docs") + ", md_new AS (SELECT * FROM md_docs WHERE doc_id % 11 <> 0), " + REFS.replace("md_docs", "md_new") + " SELECT DISTINCT doc_path, file AS source_path FROM rf")
def build_index_delta(spark, d):
    """The index of the earlier documents, brought up to the later ones by their changes."""
    old, new = two_trees(spark, d, "md_docs", "doc_path", "/src/core/f1", "/src/core/g1")
    index = documents.doc_index(documents.source_refs(old))
    changed, _, gone = changed_parts(old, new, "doc_path")
    return delta.index_delta(index, changed, gone).applied(index)


@query(duck("md_docs") + f", {REFS} SELECT * FROM rf")
def source_refs(spark, d):
    return documents.source_refs(fixture(spark, d, "md_docs"))


@query(duck("md_docs") + f", {REFS} SELECT DISTINCT doc_path, file AS source_path FROM rf")
def doc_index(spark, d):
    return documents.doc_index(documents.source_refs(fixture(spark, d, "md_docs")))


@query(duck("md_docs") + " SELECT DISTINCT doc_path AS src_doc, substring(m, 4) AS dst_doc FROM (SELECT doc_path, unnest(regexp_extract_all(content, '\\]\\((\\.\\./[^)#\\s]*\\.md)\\)', 1)) AS m FROM md_docs) WHERE doc_path <> substring(m, 4)")
def doc_links(spark, d):
    return documents.doc_links(fixture(spark, d, "md_docs"))


@query(duck("tree") + f" SELECT path, {doc_path_sql('path')} AS doc_path FROM tree")
def infer_doc_path(spark, d):
    return fixture(spark, d, "tree").select("path", paths.infer_doc_path(F.col("path")).alias("doc_path"))


IMPLIED = f"im AS (SELECT path AS source_path, {doc_path_sql('path')} AS doc_path FROM tree)"


@query(duck("tree") + f", {IMPLIED} SELECT doc_path, source_path FROM im WHERE doc_path IS NOT NULL AND length(source_path) % 3 <> 0 AND length(doc_path) % 2 = 0")
def enrich_inferred(spark, d):
    tree = fixture(spark, d, "tree").select("path")
    docs = tree.select(paths.infer_doc_path(F.col("path")).alias("doc_path")).where("doc_path is not null and length(doc_path) % 2 = 0")
    known = tree.where("length(path) % 3 = 0").select(F.lit("x.md").alias("doc_path"), F.col("path").alias("source_path"))
    return incremental.enriched(known, tree, docs)


@query(duck("tree") + f", {IMPLIED} SELECT doc_path, source_path FROM im WHERE doc_path IS NOT NULL")
def prepopulate_index(spark, d):
    tree = fixture(spark, d, "tree").select("path")
    docs = tree.select(paths.infer_doc_path(F.col("path")).alias("doc_path"))
    return incremental.by_name(tree, docs)


METRICS = f"""
q AS (SELECT doc_path, content, replace(content, '```mermaid', chr(1)) AS marked, lower(content) AS low FROM md_docs),
mt AS (SELECT doc_path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines,
 CAST(len(regexp_extract_all(content, '(?m)^## ')) AS BIGINT) AS n_sections, CAST(len(regexp_extract_all(content, '(?m)^### ')) AS BIGINT) AS n_subsections,
 CAST((SELECT count(*) FROM (SELECT unnest(string_split(content, chr(10))) AS l, unnest(range(len(string_split(content, chr(10))))) AS i) x WHERE regexp_matches(l, '^#{{2,3}} ') AND NOT coalesce((SELECT arg_min(NOT regexp_matches(l2, '^#{{1,3}} '), i2) FROM (SELECT unnest(string_split(content, chr(10))) AS l2, unnest(range(len(string_split(content, chr(10))))) AS i2) y WHERE i2 > x.i AND (regexp_matches(l2, '^#{{1,3}} ') OR trim(l2) <> '')), false)) AS BIGINT) AS n_empty,
 CAST(len(regexp_extract_all(content, '(?s)```mermaid.*?```')) AS BIGINT) AS n_diagrams,
 CAST(len(regexp_extract_all(marked, concat('(?s)```.*?(?:```|', chr(1), ')'))) AS BIGINT) AS n_examples,
 CAST(len(regexp_extract_all(content, '(?m)^\\|.*\\|$')) // 2 AS BIGINT) AS n_tables,
 CAST(len(regexp_extract_all(replace(content, '](http', '](~http'), '\\[[^\\n]*?\\]\\([^~\\n][^\\n]*?\\.md[^\\n]*?\\)')) AS BIGINT) AS n_links,
 contains(content, '**Section sources**') OR contains(content, '**Diagram sources**') OR contains(content, 'file://') AS traced,
 contains(low, 'best practice') AS has_practices, contains(low, 'performance') AS has_performance,
 contains(low, 'troubleshoot') OR contains(low, 'debug') OR contains(low, 'error handling') AS has_trouble FROM q)"""
POINTS = """CAST(CASE WHEN n_sections >= 12 THEN 3 WHEN n_sections >= 8 THEN 2 WHEN n_sections >= 5 THEN 1 ELSE 0 END
 + CASE WHEN n_sections + n_subsections > 0 AND n_empty / greatest(n_sections + n_subsections, 1) <= CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END + CASE WHEN n_subsections >= 1 THEN 1 ELSE 0 END
 + CASE WHEN n_diagrams >= 3 THEN 3 WHEN n_diagrams >= 2 THEN 2 WHEN n_diagrams >= 1 THEN 1 ELSE 0 END + CASE WHEN n_examples >= 3 THEN 2 WHEN n_examples >= 1 THEN 1 ELSE 0 END
 + CASE WHEN n_links >= 3 THEN 2 WHEN n_links >= 1 THEN 1 ELSE 0 END + CASE WHEN traced THEN 2 ELSE 0 END + CASE WHEN n_lines >= 50 THEN 1 ELSE 0 END AS BIGINT)"""
LEVELS = f"{METRICS}, sc AS (SELECT *, {POINTS} AS score FROM mt), lv AS (SELECT *, CASE WHEN score >= 12 THEN 'professional' WHEN score >= 7 THEN 'standard' ELSE 'basic' END AS level FROM sc)"
STEM = "lower(regexp_replace(regexp_extract(doc_path, '[^/]*$'), '\\.md$', ''))"
DOC_ROLE = (
    "CASE WHEN string_split(doc_path, '/')[1] IN ('core', 'internal') OR " + " OR ".join(f"contains({STEM}, '{w}')" for w in rules.CORE_WORDS) + " THEN 'core' WHEN " + " OR ".join(f"contains({STEM}, '{w}')" for w in rules.UTILITY_WORDS)
    + f" THEN 'utility' WHEN {STEM} IN ({listed(rules.INDEX_NAMES)}) THEN 'index' ELSE 'other' END"
)
SIZES = "(VALUES " + ", ".join(f"('{k}', {', '.join(f'CAST({x} AS BIGINT)' for x in v)})" for k, v in rules.EXPECTED.items()) + ") v(role, min_lines, min_sections, min_diagrams, min_examples)"
EXPECTED = f"er AS (SELECT doc_path, {DOC_ROLE} AS role FROM md_docs), ex AS (SELECT doc_path, role, min_lines, min_sections, min_diagrams, min_examples FROM er JOIN {SIZES} USING (role))"


@query(duck("md_docs") + f",{METRICS} SELECT * FROM mt")
def doc_metrics(spark, d):
    return documents.metrics(fixture(spark, d, "md_docs"))


@query(duck("md_docs") + f",{LEVELS} SELECT doc_path, score, level FROM lv")
def quality_level(spark, d):
    return documents.levels(documents.metrics(fixture(spark, d, "md_docs"))).select("doc_path", "score", "level")


@query(duck("md_docs") + f", {EXPECTED} SELECT * FROM ex")
def expected_metrics(spark, d):
    return documents.expected(fixture(spark, d, "md_docs"))


ISSUE = """unnest(list_filter([
 CASE WHEN n_lines < min_lines THEN concat('Insufficient lines: ', n_lines, '/', min_lines, ' (based on module complexity)') END,
 CASE WHEN n_sections < min_sections THEN concat('Insufficient sections: ', n_sections, '/', min_sections) END,
 CASE WHEN n_diagrams < min_diagrams THEN concat('Insufficient diagrams: ', n_diagrams, '/', min_diagrams) END,
 CASE WHEN n_examples < min_examples THEN concat('Insufficient code examples: ', n_examples, '/', min_examples) END,
 CASE WHEN NOT traced AND min_lines >= 150 THEN 'Missing source tracing (Section sources)' END,
 CASE WHEN min_sections >= 8 AND NOT has_practices THEN 'Core module missing "Best Practices" section' END,
 CASE WHEN min_sections >= 8 AND NOT has_performance THEN 'Core module missing "Performance Optimization" section' END,
 CASE WHEN min_sections >= 8 AND NOT has_trouble THEN 'Core module missing "Error Handling" section' END,
 CASE WHEN n_links < 1 THEN 'Missing cross-links to related documents' END], lambda x: x IS NOT NULL)) AS issue"""


@query(duck("md_docs") + f",{METRICS}, {EXPECTED} SELECT doc_path, {ISSUE} FROM mt JOIN ex USING (doc_path)")
def doc_issues(spark, d):
    docs = fixture(spark, d, "md_docs")
    return documents.issues(documents.metrics(docs), documents.expected(docs))


@query(duck("md_docs") + f",{METRICS} SELECT doc_path, 'Empty section: \"### Sub\"' AS issue FROM (SELECT doc_path, unnest(range(n_empty)) FROM mt)")
def empty_sections(spark, d):
    return documents.empty_sections(fixture(spark, d, "md_docs"))


SHARES = ", ".join(f"count(*) FILTER (level = '{x}') AS n_{x}, round(count(*) FILTER (level = '{x}') * CAST(100 AS DOUBLE) / greatest(count(*), 1), 1) AS pct_{x}" for x in ("professional", "standard", "basic"))
EXIT = "CAST(CASE WHEN count(*) FILTER (level = 'basic') * 2 > count(*) THEN 2 WHEN count(*) FILTER (level = 'basic') > 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code"


@query(duck("md_docs") + f",{LEVELS} SELECT count(*) AS n_docs, {SHARES}, CAST(sum(n_diagrams) AS BIGINT) AS n_diagrams, CAST(sum(n_empty) AS BIGINT) AS n_empty, {EXIT} FROM lv")
def audit_rollup(spark, d):
    return documents.rollup(documents.levels(documents.metrics(fixture(spark, d, "md_docs"))))


@query(duck("md_docs") + f",{LEVELS} SELECT {EXIT} FROM lv")
def audit_exit(spark, d):
    return audit_rollup(spark, d).select("exit_code")


LINT = (
    ", x AS (SELECT doc_id, string_split(regexp_extract(content, '(?s)```mermaid\\n(.*?)\\n```', 1), chr(10)) AS ls FROM diagrams), dl AS (SELECT doc_id, trim(unnest(ls)) AS line, unnest(range(len(ls))) + 2 AS number FROM x), v AS (SELECT * FROM dl WHERE NOT starts_with(line, '%%')), "
    "nodes AS (SELECT DISTINCT doc_id, regexp_extract(line, '^([A-Za-z0-9_]+)\\[', 1) AS name FROM v WHERE regexp_matches(line, '^([A-Za-z0-9_]+)\\[')) "
    "SELECT doc_id, number, 'warn' AS severity, 'subgraph id' AS rule, regexp_extract(line, '^subgraph\\s+([^\\[\\s\"\\-]+)\\[', 1) AS name FROM v WHERE regexp_matches(line, '^subgraph\\s+([^\\[\\s\"\\-]+)\\[') AND NOT regexp_matches(line, '^subgraph\\s+[A-Za-z0-9_]+\\[') "
    "UNION ALL SELECT doc_id, number, 'error', 'quoted subgraph', regexp_extract(line, '^subgraph\\s+([A-Za-z0-9_]+)\\[\"', 1) FROM v WHERE regexp_matches(line, '^subgraph\\s+([A-Za-z0-9_]+)\\[\"[^\"]+\"\\](?:\\s*\\[|$)') "
    f"UNION ALL SELECT doc_id, number, 'error', 'reserved id', regexp_extract(line, '^([a-z]+)\\[', 1) FROM v WHERE regexp_matches(line, '^({'|'.join(rules.RESERVED_IDS)})\\[') "
    "UNION ALL SELECT doc_id, number, 'error', 'quoted label', regexp_extract(line, '^([A-Za-z0-9_]+)\\[', 1) FROM v WHERE regexp_matches(line, '^([A-Za-z0-9_]+)\\[\"[^\"]+\"\\]$') "
    "UNION ALL SELECT v.doc_id, number, 'error', 'id used twice', name FROM v JOIN nodes ON v.doc_id = nodes.doc_id AND regexp_extract(line, '^subgraph\\s+([A-Za-z0-9_]+)\\[', 1) = name"
)


@query(duck("diagrams") + LINT)
def mermaid_lint(spark, d):
    return documents.lint_diagrams(fixture(spark, d, "diagrams"))


ROOT = "/home/me/proj"
CLEAN = (
    ", k AS (SELECT doc_path, content, regexp_replace(content, '(\\[[^\\n]*?\\]\\()file:///home/me/proj(/[^)\\n]*\\))', '\\1\\2', 'g') AS a, len(regexp_extract_all(content, '\\]\\(file:///home/me/proj/[^)\\n]*\\)')) AS na FROM md_docs), "
    "k2 AS (SELECT *, regexp_replace(a, '(\\[[^\\n]*?\\]\\()/home/me/proj(/[^)]*\\))', '\\1\\2', 'g') AS b, len(regexp_extract_all(a, '\\]\\(/home/me/proj/[^)]*\\)')) AS nb FROM k), "
    "k3 AS (SELECT doc_path, regexp_replace(b, '(\\[[^\\n]*?\\]\\()((?:src|lib|app|packages)/[^)]+\\))', '\\1/\\2', 'g') AS content, CAST(na + nb + len(regexp_extract_all(b, '\\]\\((?:src|lib|app|packages)/[^)]+\\)')) AS BIGINT) AS n_replaced FROM k2) "
)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    text, n = documents.sanitised(F.col("content"), ROOT)
    return fixture(spark, d, "md_docs").select("doc_path", text.alias("content"), n.alias("n_replaced"))


@query(duck("md_docs") + CLEAN + "SELECT * FROM k3")
def sanitize_links(spark, d):
    return cleaned(spark, d)


@query(duck("md_docs") + CLEAN + "SELECT count(*) AS n_files, count(*) FILTER (n_replaced > 0) AS n_modified, CAST(sum(n_replaced) AS BIGINT) AS n_replaced FROM k3")
def sanitize_totals(spark, d):
    return cleaned(spark, d).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n_replaced") > 0).alias("n_modified"), F.coalesce(F.sum("n_replaced"), F.lit(0)).alias("n_replaced"))


# -- translation ------------------------------------------------------------

HASH12 = "substring(sha256(content), 1, 12)"
STATE = "CASE WHEN has_target = 0 THEN 'missing' WHEN mem_current = 1 THEN 'synced' ELSE 'outdated' END"


def translations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = fixture(spark, d, "i18n_src").withColumn("hash", translation.short_hash(F.col("content")))
    memory = rows.where("has_target = 1 or mem_current = 1").select("lang", "file", F.when(F.col("mem_current") == 1, F.col("hash")).otherwise("old").alias("hash"))
    return rows.select("lang", "file", "hash"), rows.where("has_target = 1").select("lang", "file"), memory


@query(duck("i18n_src") + f" SELECT lang, file, {STATE} AS status, {HASH12} AS hash FROM i18n_src")
def i18n_status(spark, d):
    return translation.status(*translations(spark, d))


@query(duck("i18n_src") + f" SELECT lang, file, {STATE} AS status FROM i18n_src WHERE {STATE} <> 'synced'")
def i18n_problems(spark, d):
    return translation.status(*translations(spark, d)).where("status <> 'synced'").select("lang", "file", "status")


@query(duck("i18n_src") + f", s AS (SELECT lang, {STATE} AS status FROM i18n_src) SELECT lang, count(*) AS total, count(*) FILTER (status = 'synced') AS synced, count(*) FILTER (status = 'outdated') AS outdated, count(*) FILTER (status = 'missing') AS missing FROM s GROUP BY lang")
def i18n_counts(spark, d):
    return translation.counts(translation.status(*translations(spark, d)))


@query(duck("i18n_src") + f" SELECT lang, file, {HASH12} AS hash FROM i18n_src WHERE has_target = 1 OR mem_current = 1")
def i18n_sync_memory(spark, d):
    sources, targets, memory = translations(spark, d)
    return translation.sync(memory, sources, targets)


@query(duck("names") + " SELECT DISTINCT language, trim(string_split(language, '/')[1]) AS first, CAST(len(string_split(language, '/')) AS BIGINT) AS n, array_to_string(string_split(language, '/')[2:], ',') AS others FROM names")
def i18n_config(spark, d):
    return translation.languages(fixture(spark, d, "names").select("language").distinct())


@query(duck("names") + " SELECT doc_id, wiki AS folder, CASE WHEN regexp_extract(wiki, 'wiki_([a-z]{2})$', 1) IN ('zh', 'en', 'ja', 'ko', 'fr', 'de') THEN right(wiki, 2) ELSE 'en' END AS lang FROM names")
def infer_lang(spark, d):
    return fixture(spark, d, "names").select("doc_id", F.col("wiki").alias("folder"), translation.language_of_dir(F.col("wiki")).alias("lang"))


# -- navigation -------------------------------------------------------------

TITLE = "CASE WHEN regexp_extract(content, '(?m)^[ \\t]*# +([^\\n]*)', 1) <> '' THEN trim(regexp_extract(content, '(?m)^[ \\t]*# +([^\\n]*)', 1)) ELSE concat(upper(substring(st, 1, 1)), substring(st, 2)) END"
TITLED = f"tl AS (SELECT doc_path, content, {TITLE} AS title FROM (SELECT *, regexp_replace(regexp_extract(doc_path, '[^/]*$'), '\\.md$', '') AS st FROM md_docs))"


@query(duck("md_docs") + f", {TITLED} SELECT doc_path, title FROM tl")
def doc_title(spark, d):
    return fixture(spark, d, "md_docs").select("doc_path", navigation.title(F.col("content"), F.col("doc_path")).alias("title"))


@query(duck("md_docs") + f", {TITLED}, ln AS (SELECT string_split(doc_path, '/')[1] AS section, doc_path, concat('- [', title, '](/', doc_path, ')') AS line FROM tl WHERE NOT starts_with(doc_path, 'core/')) SELECT section, concat('## ', CASE section WHEN 'modules' THEN 'Modules' ELSE 'API Reference' END, chr(10), chr(10), string_agg(line, chr(10) ORDER BY doc_path)) AS toc FROM ln GROUP BY section")
def toc(spark, d):
    return navigation.contents(fixture(spark, d, "md_docs"))


@query(duck("md_docs") + f", {TITLED} SELECT concat('2', string_split(doc_path, '/')[1], '/1', string_split(doc_path, '/')[2]) AS sort_key, concat('  - [', title, '](/', doc_path, ')') AS line FROM tl UNION ALL SELECT DISTINCT concat('2', string_split(doc_path, '/')[1]), concat('- ', string_split(doc_path, '/')[1]) FROM tl")
def sidebar_md(spark, d):
    return navigation.sidebar(fixture(spark, d, "md_docs"))


STRIPPED = "content"
for _p, _r in ((r"^---[\s\S]*?---\n", ""), (r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"[*_~#]+([^*_\n]+)[*_~#]*", r"\1"), (r"(?m)^#+\s+", ""), (r"(?m)^[-*+]\s+", ""), (r"(?m)^[ \t]+|[ \t]+$", ""), (r"\n{3,}", "\n\n")):
    STRIPPED = f"regexp_replace({STRIPPED}, '{_p}', '{_r}', 'g')"


@query(duck("md_docs") + f", {TITLED} SELECT concat('/', doc_path) AS path, CASE WHEN regexp_extract(content, '(?m)^#\\s+([^\\n]+)', 1) <> '' THEN trim(regexp_extract(content, '(?m)^#\\s+([^\\n]+)', 1)) ELSE regexp_replace(regexp_extract(doc_path, '[^/]*$'), '\\.md$', '') END AS title, concat('/', regexp_replace(doc_path, '\\.md$', '.html')) AS url, substring({STRIPPED}, 1, 5000) AS body FROM tl")
def search_index(spark, d):
    return navigation.search_index(fixture(spark, d, "md_docs"))


FOUND = "h AS (SELECT doc_id, title, body, contains(lower(title), 'the') AS title_hit, instr(lower(body), 'the') AS pos FROM search_src), g AS (SELECT *, greatest(pos - 41, 0) AS a, least(length(body), pos - 1 + 3 + 60) AS z FROM h WHERE title_hit OR pos > 0)"


@query(duck("search_src") + f", {FOUND} SELECT doc_id, title, title_hit, CASE WHEN pos > 0 THEN concat(CASE WHEN a > 0 THEN '…' ELSE '' END, substring(body, a + 1, z - a), CASE WHEN z < length(body) THEN '…' ELSE '' END) ELSE '' END AS excerpt FROM g ORDER BY title_hit DESC, doc_id LIMIT 20")
def search_topk(spark, d):
    return navigation.search(fixture(spark, d, "search_src"), "the")


# every benchmark item asks for a piece of its text, of 2 to 12 characters, in upper case when odd
TERMS = "SELECT item_id AS term_id, CASE WHEN item_id % 2 = 1 THEN upper(t) ELSE t END AS term FROM (SELECT item_id, substring(text, 3 + CAST(item_id % 31 AS INT), 2 + CAST(item_id % 11 AS INT)) AS t FROM {benchmark}) q"
ASKED = "r AS (SELECT term_id, doc_id, title, body, lower(term) AS low, contains(lower(title), lower(term)) AS title_hit, instr(lower(body), lower(term)) AS pos FROM terms, search_all WHERE term <> '' AND (contains(lower(title), lower(term)) OR contains(lower(body), lower(term)))), k AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY title_hit DESC, doc_id) AS rank, greatest(pos - 41, 0) AS a, least(length(body), pos - 1 + length(low) + 60) AS z FROM r)"


def asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The search documents, their postings as a table, and the terms."""
    spark.read.parquet(f"{d}/benchmark.parquet").createOrReplaceTempView("loom_benchmark")
    index = fixture(spark, d, "search_all")
    stored = postings.write(postings.build(index), f"{lineage.shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    return index, stored, spark.sql(TERMS.replace("{benchmark}", "loom_benchmark"))


@query(duck("search_all") + f", terms AS ({TERMS.replace('{benchmark}', 'benchmark')}), {ASKED} SELECT term_id, CAST(rank AS INT) AS rank, doc_id, title, title_hit, CASE WHEN pos > 0 THEN concat(CASE WHEN a > 0 THEN '…' ELSE '' END, substring(body, a + 1, z - a), CASE WHEN z < length(body) THEN '…' ELSE '' END) ELSE '' END AS excerpt FROM k WHERE rank <= 20")
def search_postings(spark, d):
    return postings.search(*asked(spark, d))


@query("SELECT doc_id, CAST(len(regexp_extract_all(source, '[一-龥]')) * 12 + len(regexp_extract_all(source, '[0-9]')) * 7 + (length(source) - len(regexp_extract_all(source, '[一-龥]')) - len(regexp_extract_all(source, '[0-9]'))) * 6 + 10 AS BIGINT) AS width, concat('`source: ', source, '`') AS badge FROM documents WHERE source IS NOT NULL")
def badge_text(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").where("source is not null")
    return rows.select("doc_id", navigation.badge_width(F.col("source")).alias("width"), F.concat(F.lit("`source: "), "source", F.lit("`")).alias("badge"))


@query("SELECT doc_id, CASE WHEN doc_id % 101 >= 80 THEN 'brightgreen' WHEN doc_id % 101 >= 60 THEN 'yellow' WHEN doc_id % 101 >= 40 THEN 'orange' ELSE 'red' END AS color FROM documents")
def coverage_color(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", navigation.coverage_color(F.col("doc_id") % 101).alias("color"))


# -- the incremental plan ---------------------------------------------------

PLAN = """
pairs AS (SELECT concat('docs/d', CAST(doc_id % 300 AS STRING), '.md') AS doc_path, concat('src/', source, '/file', CAST(doc_id AS STRING), '.ts') AS source_path FROM documents WHERE doc_id % 3 <> 2),
edges AS (SELECT concat('src/', b.source, '/file', CAST(b.doc_id AS STRING), '.ts') AS src, concat('src/', a.source, '/file', CAST(a.doc_id AS STRING), '.ts') AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 4 <> 3),
links AS (SELECT concat('docs/d', CAST(k AS STRING), '.md') AS src, concat('docs/d', CAST(k + 1 AS STRING), '.md') AS dst FROM (SELECT DISTINCT doc_id % 300 AS k FROM documents) z WHERE k % 5 <> 0),
docs AS (SELECT DISTINCT doc_path FROM pairs UNION SELECT 'modules/extra.md' UNION SELECT concat('modules/', source, '/file', CAST(doc_id AS STRING), '.md') FROM documents WHERE doc_id % 50 = 1)"""
STAGES = f"""
ch AS (SELECT path FROM d WHERE status IN ('added', 'modified')),
s1 AS (SELECT doc_path, 1 AS stage, source_path FROM pairs WHERE source_path IN (SELECT path FROM ch)),
s2 AS (SELECT doc_path, 2 AS stage, source_path FROM (SELECT path AS source_path, {doc_path_sql("path")} AS doc_path FROM ch) WHERE doc_path IN (SELECT doc_path FROM docs)),
w AS (SELECT path AS node, CAST(0 AS BIGINT) AS depth FROM ch UNION SELECT e.src, w.depth + 1 FROM w JOIN edges e ON e.dst = w.node WHERE w.depth < 3),
s3 AS (SELECT doc_path, 3 AS stage, source_path FROM pairs WHERE source_path IN (SELECT node FROM w GROUP BY node HAVING min(depth) > 0)),
f AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
s4 AS (SELECT src AS doc_path, 4 AS stage, min(dst) AS source_path FROM links WHERE dst IN (SELECT doc_path FROM f) AND src NOT IN (SELECT doc_path FROM f) GROUP BY src),
af AS (SELECT doc_path, CASE min(stage) WHEN 1 THEN 'source_changed' WHEN 2 THEN 'inferred' WHEN 3 THEN 'dep_changed' ELSE 'doc_dep_changed' END AS reason, string_agg(DISTINCT source_path, ',' ORDER BY source_path) AS triggers, CASE WHEN min(stage) = 1 THEN 'full' ELSE 'incremental' END AS strength FROM (SELECT * FROM f UNION ALL SELECT * FROM s4) GROUP BY doc_path),
de AS (SELECT DISTINCT doc_path FROM pairs WHERE source_path IN (SELECT path FROM d WHERE status = 'deleted'))"""
FULL_PLAN = duck("snap_old", "snap_new") + f",{DIFF},{PLAN},{STAGES} "


def new_root(spark: SparkSession) -> str:
    """A folder for files that a query writes, next to the checkpoints."""
    return f"{lineage.shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(duck("md_docs") + CLEAN + "SELECT doc_path, content FROM k3 WHERE n_replaced > 0")
def rewritten_docs(spark, d):
    """The documents that sanitising rewrites, as files; read again from there."""
    root = new_root(spark)
    sinks.rewrite(cleaned(spark, d), root)
    return tree.from_store(spark, root).select(F.col("path").alias("doc_path"), F.col("text").alias("content"))


def planned(spark: SparkSession, d: str) -> incremental.Plan:
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("loom_documents")
    part = lambda name: spark.sql("WITH " + PLAN.replace("FROM documents", "FROM loom_documents").replace("JOIN documents", "JOIN loom_documents") + f" SELECT * FROM {name}")
    return incremental.plan(changes(spark, d), part("edges"), part("pairs"), part("links"), part("docs"))


@query(FULL_PLAN + "SELECT * FROM af")
def incremental_plan(spark, d):
    return planned(spark, d).affected


@query(FULL_PLAN + "SELECT doc_path FROM de")
def docs_to_delete(spark, d):
    return planned(spark, d).deleted


@query(FULL_PLAN + "SELECT doc_path FROM docs WHERE doc_path NOT IN (SELECT doc_path FROM af) AND doc_path NOT IN (SELECT doc_path FROM de)")
def preserved_docs(spark, d):
    return planned(spark, d).preserved


@query(FULL_PLAN + "SELECT doc_path, triggers FROM af WHERE reason = 'source_changed'")
def docs_source_changed(spark, d):
    return planned(spark, d).affected.where("reason = 'source_changed'").select("doc_path", "triggers")


@query(FULL_PLAN + "SELECT doc_path, triggers FROM af WHERE reason = 'dep_changed'")
def docs_dep_changed(spark, d):
    return planned(spark, d).affected.where("reason = 'dep_changed'").select("doc_path", "triggers")


@query(FULL_PLAN + "SELECT reason, count(*) AS n_docs, min(doc_path) AS first_doc FROM af GROUP BY reason")
def affected_by_reason(spark, d):
    return incremental.by_reason(planned(spark, d).affected)


# -- projects ---------------------------------------------------------------


def project_query(name: str, operator, sql: str) -> None:
    def run(spark, d):
        return operator(fixture(spark, d, "project_files"))

    run.__name__ = name
    query(duck("project_files") + sql)(run)


def case(column: str, **by_path: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k.replace('__', '.')}' THEN '{v}'" for k, v in by_path.items()) + " END"


OF = case("path", package__json="javascript", pyproject__toml="python", go__mod="go", Cargo__toml="rust", app__csproj="dotnet")
project_query("detect_languages", projects.languages, f" SELECT DISTINCT project, {OF} AS language FROM project_files WHERE {OF} IS NOT NULL")
project_query(
    "project_types", projects.types,
    f" SELECT DISTINCT project, {OF} AS language, string_split(k, ':')[1] AS kind, string_split(k, ':')[2] AS value FROM (SELECT project, path, unnest(CASE path WHEN 'package.json' THEN ['type:nodejs', 'framework:react', 'type:vite'] WHEN 'pyproject.toml' THEN ['type:python', 'framework:fastapi', 'framework:django'] WHEN 'go.mod' THEN ['type:go', 'manager:go-modules', 'framework:gin'] WHEN 'Cargo.toml' THEN ['type:rust', 'manager:cargo', 'framework:tokio'] WHEN 'app.csproj' THEN ['framework:asp.net-core-web'] ELSE [] END) AS k FROM project_files)",
)
# files of the trees and the root files of each project, and what they count as
WHOLE = "whole AS (SELECT project, path, content FROM project_files UNION ALL SELECT concat('p', CAST(doc_id % 50 AS STRING)) AS project, path, content FROM tree)"
FOUND = (
    f", {WHOLE}, own AS (SELECT project, path, {IS_CODE} AND NOT ({HAS_EXCLUDED}) AS code FROM whole), "
    f"md AS (SELECT project, regexp_extract(path, '^(({ROOTS})/[^/]+)/', 1) AS m, count(*) AS n FROM own WHERE code GROUP BY 1, 2 HAVING m <> ''), "
    "fo AS (SELECT project, regexp_extract(path, '^([^./][^/]*)/', 1) AS m, count(*) AS n FROM own WHERE code AND project NOT IN (SELECT project FROM md) GROUP BY 1, 2 HAVING m <> ''), "
    "mo AS (SELECT project, string_agg(concat(m, '=', n), ',' ORDER BY m) AS modules, count(*) AS n_modules FROM (SELECT * FROM md UNION ALL SELECT * FROM fo) q GROUP BY project), "
    "fi AS (SELECT project, count(*) FILTER (code) AS n_files FROM own GROUP BY project), "
    "dc AS (SELECT project, string_agg(DISTINCT path, ',' ORDER BY path) AS docs FROM whole WHERE path = 'README.md' OR regexp_matches(path, '^docs/[^/]+\\.md$') GROUP BY project), "
    "en AS (SELECT project, string_agg(DISTINCT path, ',' ORDER BY path) AS entries FROM whole WHERE path = 'src/main.go' OR (path = 'cmd/x.go' AND contains(content, 'func main()')) GROUP BY project), "
    "ty AS (SELECT project, string_agg(DISTINCT value, ',' ORDER BY value) AS types FROM (" + ORACLES["project_types"].removeprefix(duck("project_files")) + ") q GROUP BY project) "
)


@query(
    duck("project_files", "tree") + FOUND + "SELECT project, coalesce(types, '') AS types, coalesce(entries, '') AS entries, coalesce(modules, '') AS modules, coalesce(docs, '') AS docs, n_files, coalesce(n_modules, 0) AS n_modules FROM fi LEFT JOIN ty USING (project) LEFT JOIN en USING (project) LEFT JOIN mo USING (project) LEFT JOIN dc USING (project)"
)
def project_structure(spark, d):
    """structure.json of every project, written as files and read again."""
    project_files, whole = fixture(spark, d, "project_files"), fixture(spark, d, "tree")
    whole = project_files.unionByName(whole.select(F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string")).alias("project"), "path", "content"))
    rows, root = projects.structure(whole, EXCLUDE), new_root(spark)
    sinks.save_json(rows.withColumn("path", F.concat("projectName", F.lit("/structure.json"))), "path", root)
    got = tree.from_store(spark, root).select(F.from_json("text", rows.schema).alias("j")).select("j.*")
    listed = F.transform("modules", lambda m: F.concat_ws("=", m["path"], m["files"].cast("string")))
    text = lambda c: F.array_join(c, ",")
    return got.select(
        F.col("projectName").alias("project"), text("projectType").alias("types"), text("entryPoints").alias("entries"), text(listed).alias("modules"), text("docsFound").alias("docs"),
        F.col("stats.totalFiles").alias("n_files"), F.col("stats.totalModules").alias("n_modules"),
    )


RUNTIME = case("path", package__json="Node.js", pyproject__toml="Python", go__mod="Go", Cargo__toml="Rust", app__csproj=".NET")
VERSION = case("path", package__json=">=18", pyproject__toml="3.11", go__mod="1.21", Cargo__toml="1.70", app__csproj="net8.0")
project_query("runtime_versions", projects.versions, f" SELECT DISTINCT project, {RUNTIME} AS runtime, {VERSION} AS version FROM project_files WHERE {RUNTIME} IS NOT NULL")
project_query("code_standards", projects.standards, " SELECT DISTINCT project, unnest(CASE path WHEN '.eslintrc' THEN ['ESLint'] WHEN 'pyproject.toml' THEN ['Pylint', 'Flake8', 'Mypy', 'Pytest', 'Ruff'] ELSE [] END) AS standard FROM project_files")
project_query("monorepo_tools", projects.monorepo, " SELECT DISTINCT project, CASE path WHEN 'lerna.json' THEN 'lerna' ELSE 'npm-workspaces' END AS tool FROM project_files WHERE path IN ('lerna.json', 'package.json')")
project_query("entry_points", projects.entry_points, " SELECT DISTINCT project, path FROM project_files WHERE path = 'src/main.go' OR (path LIKE '%.go' AND contains(content, 'func main()'))")


@query(duck("project_files") + ", v AS (SELECT project, CASE path WHEN 'package.json' THEN regexp_extract(content, '\"version\": \"([^\"]+)\"', 1) WHEN 'pyproject.toml' THEN '2.0' WHEN 'Cargo.toml' THEN '0.3' WHEN 'app.csproj' THEN '5.1' END AS version, CASE path WHEN 'package.json' THEN 0 WHEN 'pyproject.toml' THEN 1 WHEN 'Cargo.toml' THEN 2 ELSE 3 END AS place FROM project_files) SELECT project, min(place) AS place FROM v WHERE version IS NOT NULL GROUP BY project")
def project_version(spark, d):
    rows = projects.own_version(fixture(spark, d, "project_files"))
    place = F.when(F.col("version").startswith("1."), 0).when(F.col("version") == "2.0", 1).when(F.col("version") == "0.3", 2).otherwise(3)
    return rows.select("project", place.alias("place"))  # a project holds several files of one rule: the rule is compared


# -- documentation comments, reports, streams -------------------------------


# what the comments of doc_code say, written out by hand
DOC_ENTRIES = duck("doc_code") + """, said AS (
SELECT path, doc_id % 6 AS k, concat(CASE doc_id % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'run' WHEN 2 THEN 'S' WHEN 3 THEN 'K' ELSE 'T' END, doc_id) AS name,
  CASE doc_id % 6 WHEN 2 THEN 'interface' WHEN 3 THEN 'class' WHEN 4 THEN 'type' ELSE 'function' END AS type,
  CASE doc_id % 6 WHEN 0 THEN 'Adds one.' WHEN 1 THEN 'Runs it.' WHEN 2 THEN 'Shape. with two lines' WHEN 3 THEN 'Holds.' ELSE 'An alias.' END AS description,
  CASE doc_id % 6 WHEN 0 THEN 'a/number/the value' WHEN 1 THEN 'a/int/how often' ELSE '' END AS param,
  CASE doc_id % 6 WHEN 0 THEN 'number: more' WHEN 1 THEN '' END AS returns,
  CASE doc_id % 6 WHEN 3 THEN 'K()|K(1)' ELSE '' END AS examples, CASE doc_id % 6 WHEN 4 THEN 2 ELSE 1 END AS line
FROM doc_code WHERE doc_id % 6 <> 5
UNION ALL SELECT path, 6, concat('v', doc_id), 'function', 'Plain', '', NULL, '', 4 FROM doc_code WHERE doc_id % 6 = 4)"""


@query(DOC_ENTRIES + " SELECT path, name, type, description, param, returns, examples, CAST(line AS BIGINT) AS line FROM said")
def extract_docs(spark, d):
    rows = docstrings.entries(fixture(spark, d, "doc_code"))
    param = F.array_join(F.transform("params", lambda p: F.concat_ws("/", p["name"], p["type"], p["description"])), ",")
    return rows.select("path", "name", "type", "description", param.alias("param"), "returns", F.array_join("examples", "|").alias("examples"), "line")


@query(DOC_ENTRIES + " SELECT count(*) AS total, count(*) FILTER (k IN (0, 1, 6)) AS functions, count(*) FILTER (k = 3) AS classes, count(*) FILTER (k IN (2, 4)) AS types, count(*) FILTER (k = 3) AS with_examples FROM said")
def doc_summary(spark, d):
    return docstrings.summary(docstrings.entries(fixture(spark, d, "doc_code")))


@query(DOC_ENTRIES + """, one AS (SELECT path, k, concat('### `', name, '`', chr(10), chr(10), description, chr(10), CASE k
  WHEN 0 THEN concat(chr(10), '**参数:**', chr(10), chr(10), '- `a` (number): the value', chr(10), chr(10), '**返回值:** number: more', chr(10))
  WHEN 1 THEN concat(chr(10), '**参数:**', chr(10), chr(10), '- `a` (int): how often', chr(10), chr(10), '**返回值:** ', chr(10)) ELSE '' END) AS md FROM said),
titled AS (SELECT path, CASE WHEN k IN (0, 1, 6) THEN 1 WHEN k = 3 THEN 2 ELSE 3 END AS o, md FROM one)
SELECT path, string_agg(concat('## ', CASE o WHEN 1 THEN '函数' WHEN 2 THEN '类' ELSE '类型定义' END, chr(10), chr(10), md), chr(10) ORDER BY o) AS md FROM titled GROUP BY path""")
def docs_to_markdown(spark, d):
    return docstrings.markdown(docstrings.entries(fixture(spark, d, "doc_code")))


@query()
def audit_report(spark, d):
    docs = fixture(spark, d, "md_docs")
    found = documents.metrics(docs)
    return sinks.audit_report(documents.levels(found), documents.issues(found, documents.expected(docs)))


@query(duck("snap_old", "snap_new") + f",{DIFF} SELECT path, status, hash FROM d WHERE status <> 'unchanged'")
def stream_batch_changes(spark, d):
    """One micro-batch of the change stream: the whole new snapshot, and deletions, as a log."""
    old, new = fixture(spark, d, "snap_old"), fixture(spark, d, "snap_new")
    gone = old.join(new, "path", "left_anti").select("path", F.lit(None).cast("string").alias("content"))
    log = new.select("path", "content").unionByName(gone).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    return batch_changes(log, snapshot.snapshot(old))[0]


@query(duck("names") + " SELECT doc_id, alias AS name, CASE lower(alias) WHEN 'typescript' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'c#' THEN 'dotnet' WHEN 'go' THEN 'go' WHEN 'node.js' THEN 'javascript' WHEN 'asp.net' THEN 'dotnet' WHEN 'rust-lang' THEN 'rust' END AS language FROM names")
def handler_alias(spark, d):
    return fixture(spark, d, "names").select("doc_id", F.col("alias").alias("name"), paths.canonical_language(F.col("alias")).alias("language"))


@query(duck("names") + " SELECT project, trim(string_split(language, '/')[1]) AS lang, 'wiki' AS folder FROM names WHERE wiki = 'wiki' AND doc_id % 3 <> 2 UNION ALL SELECT project, 'fr', 'wiki_fr' FROM names WHERE doc_id % 3 = 2 AND wiki = 'wiki_fr' UNION ALL SELECT project, ' ' || coalesce(trim(string_split(language, '/')[1]), '') || ' ', 'wiki' FROM names WHERE wiki = 'wiki' AND doc_id % 3 = 2 UNION ALL SELECT project, x, concat('wiki_', x) FROM names, unnest(['en', 'ja']) t(x) WHERE doc_id % 3 = 0 AND wiki = concat('wiki_', x)")
def available_langs(spark, d):
    rows = fixture(spark, d, "names")
    return translation.available(rows.select("project", "language"), rows.select("project", F.col("wiki").alias("folder")))


PAGES = f"""{duck("md_docs")}, {TITLED}, pages AS (SELECT doc_path, title FROM tl WHERE regexp_matches(doc_path, '^modules/[^/]+\\.md$'))"""


@query(PAGES + """ SELECT concat('{"/":[{"text":"Home","link":"/"},{"text":"Getting Started","link":"/getting-started"},{"text":"Architecture","link":"/architecture"}],"/modules/":[',
  string_agg(concat('{"text":"', title, '","link":"/', regexp_replace(doc_path, '\\.md$', ''), '"}'), ',' ORDER BY concat('/', regexp_replace(doc_path, '\\.md$', ''))), ']}') AS json FROM pages""")
def sidebar_json(spark, d):
    return navigation.sidebar_json(fixture(spark, d, "md_docs"))


@query()
def walk_files(spark, d):
    """The files of the documents table, hashed: executors read them through Spark's own
    reader, on any file system."""
    rows = tree.from_store(spark, d, "documents.parquet")
    return rows.select("path", snapshot.fingerprint(F.col("content")).alias("hash"))


# -- rows of reports ----------------------------------------------------------


@query(
    duck("tree") + """, t AS (SELECT path FROM tree WHERE regexp_matches(path, '\\.(ts|py|go|TSX|cpp|rs|vue)$') AND NOT regexp_matches(path, '^(src|lib|app|node_modules)/'))
SELECT '' AS root, regexp_extract(path, '^([^/.][^/]*)/', 1) AS module, count(*) AS n_files FROM t WHERE NOT regexp_matches(path, '\\.TSX$') AND regexp_matches(path, '^[^/.][^/]*/') GROUP BY 2"""
)
def discover_modules_fallback(spark, d):
    """Discovery in a tree without source roots: its root directories."""
    return files.discover(files.included(fixture(spark, d, "tree").where("not path rlike '^(src|lib|app|node_modules)/'"), EXCLUDE))


@query(duck("names") + " SELECT project, CASE WHEN doc_id % 6 IN (0, 3) THEN coalesce(lang, 'en') ELSE 'zh' END AS language, CASE doc_id % 6 WHEN 0 THEN concat('x,', coalesce(source, '')) WHEN 4 THEN coalesce(source, '') ELSE '' END AS exclude, doc_id % 6 <> 0 AS use_gitignore FROM names JOIN documents USING (doc_id)")
def project_settings(spark, d):
    found = files.settings(fixture(spark, d, "names").select("project", F.col("settings").alias("content")))
    return found.withColumn("exclude", F.array_join("exclude", ","))


@query(
    duck("snap_old", "snap_new") + f""",{DIFF}, n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS k FROM d WHERE status <> 'unchanged')
SELECT status, string_agg(path, ',' ORDER BY path) FILTER (k <= 10) AS paths, greatest(count(*) - 10, 0) AS n_more FROM n GROUP BY status""".replace("n AS (SELECT *", "m AS (SELECT *").replace("FROM n GROUP", "FROM m GROUP")
)
def diff_listing(spark, d):
    old, new = (snapshot.snapshot(fixture(spark, d, name)) for name in ("snap_old", "snap_new"))
    found = snapshot.listing(snapshot.diff(new, old).where("status <> 'unchanged'"))
    return found.select("status", F.array_join("paths", ",").alias("paths"), "n_more")


@query(
    duck("code_files") + f""", e AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS module, name FROM ({extracted(rules.EXPORTS, ('javascript', 'python', 'go'))})),
k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY name) AS k FROM e)
SELECT module, least(count(*), 20) AS n_exports, string_agg(name, ',' ORDER BY name) FILTER (k <= 10) AS samples FROM k GROUP BY module"""
)
def module_export_samples(spark, d):
    rows = fixture(spark, d, "code_files").select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("module"), "path", "content")
    return modules.export_samples(rows).select("module", "n_exports", F.array_join("samples", ",").alias("samples"))


@query("""SELECT doc_id, concat('<span style="display:inline-flex;align-items:center;font-family:Verdana,sans-serif;font-size:11px;line-height:1;white-space:nowrap;">', chr(10),
  '  <span style="background:#555;color:#fff;padding:3px 6px;border-radius:3px 0 0 3px;">lang</span>', chr(10),
  '  <span style="background:', CASE doc_id % 3 WHEN 0 THEN '#007ec6' WHEN 1 THEN '#4c1' ELSE '#123456' END, ';color:#fff;padding:3px 6px;border-radius:0 3px 3px 0;">', lang, '</span>', chr(10), '</span>') AS html
FROM documents WHERE lang IS NOT NULL""")
def badge_html(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null")
    color = F.element_at(F.array(F.lit("blue"), F.lit("green"), F.lit("#123456")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.select("doc_id", navigation.badge_html(F.lit("lang"), F.col("lang"), color).alias("html"))


REPORT = f"""{duck("module_base")}, {ALL_SIGNALS}, w AS (SELECT *, CASE
  WHEN regexp_matches(lower(module), 'test|spec|config|setting|conf|component|ui|view|page|widget|util|helper|common|shared|tool|api|service|handler|endpoint') THEN
    [CASE role WHEN 'test' THEN 'Directory name indicates test module' WHEN 'config' THEN 'Directory name indicates configuration module' WHEN 'ui' THEN 'Directory name indicates UI component module'
      WHEN 'utility' THEN 'Directory name indicates utility module' ELSE 'Directory name indicates API/service module' END, 'directory name pattern']
  WHEN is_entry AND n_in > 5 THEN ['Module is entry point with multiple dependents — likely core business logic', concat('isEntry=true, incomingDeps=', n_in)]
  WHEN n_exports > 15 THEN ['High export count suggests large public API surface — likely core module', concat('exportCount=', n_exports)]
  WHEN score > 60 THEN ['High complexity score suggests deep business logic', concat('complexityScore=', score)]
  WHEN n_files <= 5 AND n_exports <= 5 THEN ['Small module with few exports — likely utility or helper module', concat('fileCount=', n_files, ', exportCount=', n_exports)]
  ELSE ['Cannot determine role from directory name or signals. Semantic understanding required.', concat('fileCount=', n_files, ', exportCount=', n_exports, ', complexityScore=', score)] END AS why,
  CASE WHEN score >= 50 OR n_exports >= 10 THEN 'High complexity or export count — full template recommended' WHEN score < 30 AND n_exports < 5 THEN 'Low complexity and few exports — simple template sufficient'
    ELSE CASE role WHEN 'test' THEN 'Test modules need concise documentation' WHEN 'config' THEN 'Config modules typically have simple structure' WHEN 'utility' THEN 'Utility modules benefit from concise docs'
      WHEN 'ui' THEN 'UI components need detailed props/API documentation' WHEN 'api' THEN 'API modules need detailed endpoint documentation' WHEN 'core' THEN 'Core modules require comprehensive documentation'
      ELSE 'Default to full template when role is unclear' END END AS fits FROM m)
SELECT module, concat('## Module: ', module, chr(10), '**Path**: `src/', module, '`', chr(10), chr(10), '### Quantitative Signals (from code analysis)', chr(10), '| Signal | Value |', chr(10), '|--------|-------|', chr(10),
  '| fileCount | ', n_files, ' |', chr(10), '| estimatedLines | ', n_lines, ' |', chr(10), '| exportCount | ', n_exports, ' |', chr(10), '| complexityScore | ', score, ' |', chr(10), '| isEntry | ', is_entry, ' |', chr(10),
  '| incomingDeps | ', n_in, ' |', chr(10), '| outgoingDeps | ', n_out, ' |', chr(10), '| maxNestingDepth | ', depth, ' |', chr(10), '| primaryLanguage | unknown |', chr(10), chr(10),
  '### Role Recommendation (model overrideable)', chr(10), '**Role**: `', role, '` — *', why[1], '*', chr(10), '**Top signals**: ', why[2], chr(10), chr(10),
  '### Template Recommendation (model overrideable)', chr(10), '**Template**: `', CASE template WHEN 'full' THEN 'module.md' ELSE 'module-simple.md' END, '` — *', fits, '*', chr(10),
  '**Basis**: complexityScore=', score, ', exportCount=', n_exports, chr(10), chr(10), '### Semantic Hints (for model reference)', chr(10),
  array_to_string(list_transform(CASE WHEN len({HINT_LIST}) = 0 THEN ['{rules.HINT_NONE}'] ELSE {HINT_LIST} END, lambda h: concat('- ', h)), chr(10))) AS md FROM w"""


@query(REPORT)
def module_report(spark, d):
    c = F.col
    rows = signals(spark, d).withColumn("hints", modules.hints(c("module"), c("is_entry"), c("n_in"), c("n_out"), c("n_exports")))
    return modules.report(rows.withColumns({"path": F.concat(F.lit("src/"), "module"), "language": F.lit(None).cast("string")}))
