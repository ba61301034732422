"""Tables derived from ``documents`` by SQL that Spark and DuckDB both run.

The supplied tables hold prose; these expressions turn it into file trees, snapshots,
Markdown documents, edges and translation states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LF = "chr(10)"

SQL = {
    "tree": """
SELECT doc_id, source, lang,
  concat(CASE doc_id % 8 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'app/dist/' WHEN 3 THEN 'docs/' WHEN 4 THEN '' ELSE 'src/' END,
         source, '/', CASE doc_id % 3 WHEN 0 THEN 'fileName' WHEN 1 THEN 'user_store' ELSE 'core' END, CAST(doc_id AS STRING),
         CASE doc_id % 11 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.md' WHEN 4 THEN '.TSX' WHEN 5 THEN '.cpp' WHEN 6 THEN '' WHEN 7 THEN '.log' WHEN 8 THEN '.rs' WHEN 9 THEN '.vue' ELSE '.txt' END) AS path,
  coalesce(text, '') AS content
FROM {documents}""",
    "snap_old": "SELECT concat('src/', source, '/file', CAST(doc_id AS STRING), '.ts') AS path, CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), 'x') ELSE coalesce(text, '') END AS content FROM {documents} WHERE doc_id % 10 <> 0",
    "snap_new": "SELECT concat('src/', source, '/file', CAST(doc_id AS STRING), '.ts') AS path, coalesce(text, '') AS content FROM {documents} WHERE doc_id % 11 <> 0",
    "md_docs": """
SELECT doc_id,
  concat(CASE WHEN doc_id % 9 = 0 THEN 'core/' WHEN doc_id % 9 = 1 THEN 'api/' ELSE 'modules/' END,
         CASE doc_id % 5 WHEN 0 THEN 'store' WHEN 1 THEN 'util' WHEN 2 THEN 'page' WHEN 3 THEN 'type' ELSE 'doc' END,
         CAST(doc_id AS STRING), '.md') AS doc_path,
  concat(CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('# Doc ', CAST(doc_id AS STRING), chr(10), chr(10)) END,
    repeat(concat('## Section', chr(10), 'body text', chr(10), 'more', chr(10)), CAST(doc_id % 14 AS INT)),
    repeat(concat('### Sub', chr(10), chr(10)), CAST(doc_id % 3 AS INT)),
    repeat(concat('```mermaid', chr(10), 'flowchart TD', chr(10), 'A[x] --> B[y]', chr(10), '```', chr(10)), CAST(doc_id % 4 AS INT)),
    repeat(concat('```ts', chr(10), 'const a = 1;', chr(10), '```', chr(10)), CAST(doc_id % 5 AS INT)),
    repeat(concat('| a | b |', chr(10)), CAST(doc_id % 6 AS INT)),
    repeat(concat('[rel](../modules/doc', CAST((doc_id + 5) % 1000 AS STRING), '.md)', chr(10)), CAST(doc_id % 4 AS INT)),
    concat('[src](/src/core/f', CAST(doc_id % 50 AS STRING), '.ts#L1-L9)', chr(10)),
    CASE WHEN doc_id % 4 = 1 THEN concat('see [lib](../lib/g', CAST(doc_id % 30 AS STRING), '.py) and [raw](src/raw.ts)', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 6 = 1 THEN concat('[abs](file:///home/me/proj/src/x.ts#L3)', chr(10), '[root](/home/me/proj/lib/y.ts)', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN concat('**Section sources**', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 8 = 0 THEN concat('Best practices and Performance and Debugging', chr(10)) ELSE '' END
  ) AS content
FROM {documents}""",
    "diagrams": """
SELECT doc_id, concat('intro', chr(10), '```mermaid', chr(10), 'flowchart TD', chr(10),
  CASE WHEN doc_id % 2 = 0 THEN concat('A[x] --> B[y]', chr(10)) ELSE concat('  subgraph A[box]', chr(10)) END,
  CASE WHEN doc_id % 3 = 0 THEN concat('subgraph A[other]', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat('class[x]', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN concat('subgraph Q["quoted"]', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN concat('N["label"]', chr(10), '%% class[y]', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 13 = 0 THEN concat('subgraph a+b[z]', chr(10)) ELSE '' END,
  'end', chr(10), '```', chr(10), 'outro', chr(10)) AS content
FROM {documents}""",
    "import_edges": "SELECT DISTINCT doc_id + 1 + k AS src, doc_id AS dst FROM {documents} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT CAST(3 AS BIGINT) AS k) q WHERE doc_id % 4 <> 3",
    "doc_edges": "SELECT doc_id AS src, doc_id + 1 AS dst FROM {documents} WHERE doc_id % 5 <> 0",
    # circles of four, each leading to the next but one block's end, and longer circles over some blocks
    "ring_edges": "SELECT doc_id AS src, doc_id + q.step AS dst FROM {documents} JOIN (SELECT CAST(1 AS BIGINT) AS step UNION ALL SELECT CAST(-3 AS BIGINT) AS step UNION ALL SELECT CAST(-12 AS BIGINT) AS step) q ON CASE q.step WHEN 1 THEN doc_id % 5 <> 0 OR doc_id % 10 = 0 WHEN -3 THEN doc_id % 5 = 4 ELSE doc_id % 60 = 13 OR n_chars % 50 = 7 END",
    "i18n_src": "SELECT q.lang AS lang, concat('doc', CAST(doc_id AS STRING), '.md') AS file, coalesce(text, '') AS content, CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END AS has_target, CASE WHEN doc_id % 6 <> 0 THEN 1 ELSE 0 END AS mem_current FROM {documents} CROSS JOIN (SELECT 'en' AS lang UNION ALL SELECT 'ja' AS lang) q",
    "module_base": "SELECT concat(CASE doc_id % 6 WHEN 0 THEN 'api-' WHEN 1 THEN 'user.' WHEN 2 THEN 'core' WHEN 3 THEN 'testkit' WHEN 4 THEN 'cache/' ELSE 'm' END, source) AS module, doc_id, coalesce(text, '') AS text FROM {documents}",
    "code_files": """
SELECT doc_id, concat('src/m', CAST(doc_id % 40 AS STRING), '/f', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END) AS path,
  CASE doc_id % 3
    WHEN 0 THEN concat('import { a } from ''./f', CAST(doc_id + 120 AS STRING), ''';', chr(10), 'import ''../m', CAST((doc_id + 3) % 40 AS STRING), '/f', CAST(doc_id + 3 AS STRING), '.js'';', chr(10), 'export const v', CAST(doc_id AS STRING), ' = 1;', chr(10), 'export function go', CAST(doc_id % 10 AS STRING), '() {}', chr(10))
    WHEN 1 THEN concat('from .f', CAST(doc_id + 120 AS STRING), ' import x', chr(10), 'def run', CAST(doc_id % 10 AS STRING), '(a):', chr(10), '    return a', chr(10), 'class K', CAST(doc_id AS STRING), ':', chr(10), '    pass', chr(10))
    ELSE concat('import "fmt"', chr(10), 'func Do', CAST(doc_id % 7 AS STRING), '() {', chr(10), '}', chr(10), 'type T', CAST(doc_id AS STRING), ' struct {', chr(10), '}', chr(10)) END AS content
FROM {documents}""",
    "polyglot": """
SELECT doc_id, concat('src/p', CAST(doc_id % 25 AS STRING), '/f', CAST(doc_id AS STRING), CASE doc_id % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.rs' WHEN 4 THEN '.java' WHEN 5 THEN '.rb' WHEN 6 THEN '.php' ELSE '.cs' END) AS path,
  concat(CASE doc_id % 8
    WHEN 0 THEN concat('import { a } from ''./f', CAST(doc_id + 200 AS STRING), ''';', chr(10), 'export * from "./g"', chr(10), 'const q = require( ''../h'' );', chr(10), 'import(''./dyn'')', chr(10), 'export default class C', CAST(doc_id AS STRING), ' {}', chr(10), 'export { x, y }', chr(10), 'module.exports = {z}', chr(10))
    WHEN 1 THEN concat('from .f', CAST(doc_id + 200 AS STRING), ' import x', chr(10), '  import .g', chr(10), 'def run', CAST(doc_id AS STRING), ' (a):', chr(10), 'class K(B):', chr(10), 'class L:', chr(10))
    WHEN 2 THEN concat('import "fmt/', CAST(doc_id % 9 AS STRING), '"', chr(10), 'func Do', CAST(doc_id AS STRING), '() {', chr(10), 'func (t *T) M() {}', chr(10), 'type T struct {', chr(10))
    WHEN 3 THEN concat('mod part', CAST(doc_id % 9 AS STRING), ';', chr(10), 'pub fn run', CAST(doc_id AS STRING), '() {}', chr(10), 'trait Q {}', chr(10), 'pub const K: i32 = 1;', chr(10))
    WHEN 4 THEN concat('import a.b.C', CAST(doc_id % 9 AS STRING), ';', chr(10), 'public class J', CAST(doc_id AS STRING), ' {', chr(10), '  protected static final List total() {}', chr(10))
    WHEN 5 THEN concat('require ''json''', chr(10), 'require_relative "./r', CAST(doc_id % 9 AS STRING), '"', chr(10), 'def self.go', CAST(doc_id AS STRING), chr(10), 'class R', chr(10))
    WHEN 6 THEN concat('use App', chr(92), 'M', CAST(doc_id % 9 AS STRING), ';', chr(10), 'require_once ''p.php'';', chr(10), 'include "q.php";', chr(10), 'private static function f', CAST(doc_id AS STRING), '() {}', chr(10), 'class P {}', chr(10), 'interface I {}', chr(10))
    ELSE concat('using System.X', CAST(doc_id % 9 AS STRING), ';', chr(10), 'internal struct D', CAST(doc_id AS STRING), ' {', chr(10), 'public async Task<int> Go() {}', chr(10)) END,
    '// ', coalesce(substring(text, 1, 300), ''), chr(10)) AS content
FROM {documents}""",
    "names": """
SELECT doc_id,
  CASE doc_id % 12 WHEN 0 THEN '.git' WHEN 1 THEN 'target' WHEN 2 THEN 'vendor' WHEN 3 THEN '__pycache__' WHEN 4 THEN 'TestResults' WHEN 5 THEN '.gradle' WHEN 6 THEN 'own' WHEN 7 THEN 'targets' WHEN 8 THEN coalesce(source, '') WHEN 9 THEN coalesce(lang, '') WHEN 10 THEN 'htmlcov' ELSE split_part(coalesce(text, ''), ' ', 1) END AS folder,
  CASE doc_id % 8 WHEN 0 THEN concat(source, '/') WHEN 1 THEN concat('  d', CAST(doc_id AS STRING), ' ') WHEN 2 THEN '*.log' WHEN 3 THEN concat('!keep', CAST(doc_id AS STRING), '/') WHEN 4 THEN concat('a/', source) WHEN 5 THEN concat('# ', source) WHEN 6 THEN concat('deep/', source, '/') ELSE split_part(coalesce(text, ''), ' ', 1) END AS line,
  CASE doc_id % 3 WHEN 0 THEN concat(coalesce(lang, 'en'), '/en/ja') WHEN 1 THEN coalesce(lang, 'en') ELSE concat(' ', coalesce(lang, 'en'), ' /fr') END AS language,
  CASE doc_id % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN concat('x/wiki_', coalesce(lang, 'zh')) WHEN 2 THEN 'wiki_de' ELSE concat('wiki_', coalesce(source, 'q')) END AS wiki,
  CASE doc_id % 8 WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'PY' WHEN 2 THEN 'C#' WHEN 3 THEN 'go' WHEN 4 THEN 'Node.js' WHEN 5 THEN 'asp.net' WHEN 6 THEN coalesce(source, 'cobol') ELSE 'Rust-Lang' END AS alias,
  concat('p', CAST(doc_id AS STRING)) AS project,
  CASE doc_id % 6 WHEN 0 THEN concat('{"language": "', coalesce(lang, 'en'), '", "exclude": ["x", "', coalesce(source, ''), '"], "useGitignore": false}') WHEN 1 THEN NULL WHEN 2 THEN split_part(coalesce(text, ''), ' ', 1) WHEN 3 THEN concat('{"language": "', coalesce(lang, 'en'), '", "exclude": "no list", "useGitignore": null}') WHEN 4 THEN concat('{"exclude": ["', coalesce(source, ''), '"]}') ELSE '{"useGitignore": true}' END AS settings
FROM {documents}""",
    "project_files": """
SELECT concat('p', CAST(doc_id % 50 AS STRING)) AS project, CASE doc_id % 9
    WHEN 0 THEN 'package.json' WHEN 1 THEN 'pyproject.toml' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'Cargo.toml' WHEN 4 THEN '.eslintrc' WHEN 5 THEN 'app.csproj' WHEN 6 THEN 'src/main.go' WHEN 7 THEN 'lerna.json' ELSE 'cmd/x.go' END AS path,
  CASE doc_id % 9
    WHEN 0 THEN concat('{"version": "1.', CAST(doc_id AS STRING), '", "engines": {"node": ">=18"}, "workspaces": [], "dependencies": {"react": "1", "vite": "2"}}')
    WHEN 1 THEN concat('[project]', chr(10), 'version = "2.0"', chr(10), 'python = "3.11"', chr(10), 'deps = ["fastapi", "django"]', chr(10))
    WHEN 2 THEN concat('module x', chr(10), 'go 1.21', chr(10), 'require github.com/gin-gonic/gin v1', chr(10))
    WHEN 3 THEN concat('[package]', chr(10), 'version = "0.3"', chr(10), 'rust-version = "1.70"', chr(10), 'tokio = "1"', chr(10))
    WHEN 5 THEN '<Project Sdk="Microsoft.NET.Sdk.Web"><TargetFramework>net8.0</TargetFramework><Version>5.1</Version></Project>'
    WHEN 8 THEN CASE WHEN doc_id % 2 = 0 THEN 'package x func main() {}' ELSE 'package y' END
    ELSE 'x' END AS content
FROM {documents}""",
    "doc_code": """
SELECT doc_id, concat('f', CAST(doc_id AS STRING), CASE doc_id % 2 WHEN 0 THEN '.ts' ELSE '.py' END) AS path,
  CASE doc_id % 6
  WHEN 0 THEN concat('/** Adds one.', chr(10), ' * @param {number} a - the value', chr(10), ' * @returns {number} more', chr(10), ' */', chr(10), 'export function add', CAST(doc_id AS STRING), '(a) {}', chr(10))
  WHEN 1 THEN concat('def run', CAST(doc_id AS STRING), '(a):', chr(10), '    \"\"\"Runs it.', chr(10), chr(10), '    Args:', chr(10), '        a (int): how often', chr(10), '    Returns:', chr(10), '        the result', chr(10), '    \"\"\"', chr(10))
  WHEN 2 THEN concat('/** Shape.', chr(10), ' * with two lines', chr(10), ' * @since 2', chr(10), ' */', chr(10), 'export interface S', CAST(doc_id AS STRING), ' {}', chr(10))
  WHEN 3 THEN concat('class K', CAST(doc_id AS STRING), '(Base):', chr(10), '    \"\"\"Holds.', chr(10), chr(10), '    Examples:', chr(10), '        K()', chr(10), '        K(1)', chr(10), '    Note:', chr(10), '        none', chr(10), '    \"\"\"', chr(10))
  WHEN 4 THEN concat(chr(10), '/** An alias. */', chr(10), 'type T', CAST(doc_id AS STRING), ' = string;', chr(10), '/** Plain', chr(10), ' */', chr(10), 'const v', CAST(doc_id AS STRING), ' = 1;', chr(10))
  ELSE concat('def bare', CAST(doc_id AS STRING), '(a):', chr(10), '    return a', chr(10)) END AS content
FROM {documents}""",
    "search_src": "SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, substring(coalesce(text, ''), 1, 5000) AS body FROM {documents}",
    "search_all": "SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS body FROM {documents}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("loom_documents")
    return spark.sql(SQL[name].replace("{documents}", "loom_documents"))


def duck(*names: str) -> str:
    """The fixtures as a WITH clause for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n].replace('{documents}', 'documents')})" for n in names)
