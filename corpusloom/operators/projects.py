"""Project detection over many projects at once: files(project, path, content).

Every rule is a row: a language, a root file (a leading * is a suffix), a pattern that the
file's content must have ('' for presence alone), and what it shows. Root files are few, so
they are filtered first and joined to the rules by file name; only the patterns of a file's
own rules are tried on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .files import is_code, is_excluded, is_known_doc

# Language, file, pattern, kind, value.
SHOWS = (
    ("javascript", "package.json", "", "type", "nodejs"), ("javascript", "tsconfig.json", "", "type", "typescript"),
    ("javascript", "package-lock.json", "", "manager", "npm"), ("javascript", "yarn.lock", "", "manager", "yarn"),
    ("javascript", "pnpm-lock.yaml", "", "manager", "pnpm"), ("javascript", "bun.lockb", "", "manager", "bun"),
    *(("javascript", "package.json", f'"(dev)?[dD]ependencies"[^}}]*"({p})"', k, v) for p, k, v in (
        ("react", "framework", "react"), ("vue", "framework", "vue"), ("next|next/font", "framework", "nextjs"), ("nuxt|@nuxt/core", "framework", "nuxt"),
        ("svelte", "framework", "svelte"), ("solid", "framework", "solidjs"), ("angular|@angular/core", "framework", "angular"), ("astro", "framework", "astro"),
        ("vite", "type", "vite"), ("webpack", "type", "webpack"), ("jest|@jest/globals", "type", "jest"), ("vitest|@vitest/ui", "type", "vitest"),
        ("mocha", "type", "mocha"), ("jasmine", "type", "jasmine"),
    )),
    ("javascript", "vite.config.js", "", "type", "vite"), ("javascript", "vite.config.ts", "", "type", "vite"), ("javascript", "webpack.config.js", "", "type", "webpack"),
    *(("python", f, "", "type", "python") for f in rules.INDICATORS["python"]),
    ("python", "poetry.lock", "", "manager", "poetry"), ("python", "Pipfile.lock", "", "manager", "pipenv"), ("python", "requirements.txt", "", "manager", "pip"), ("python", "setup.py", "", "manager", "setuptools"),
    *(("python", "pyproject.toml", x, "manager", x) for x in ("poetry", "pdm", "flit", "hatch")),
    *(("python", "pyproject.toml", x, "framework", v) for x, v in (("fastapi|starlette", "fastapi"), ("django", "django"), ("flask", "flask"), ("tornado", "tornado"), ("aiohttp", "aiohttp"), ("pydantic", "pydantic"), ("celery", "celery"))),
    ("python", "pyproject.toml", "pytest-asyncio", "type", "async"),
    *(("python", "requirements.txt", f"(?i){x}", "framework", x) for x in ("django", "flask", "fastapi", "celery")), ("python", "requirements.txt", "(?i)pytest", "type", "pytest"),
    ("go", "go.mod", "", "type", "go"), ("go", "go.mod", "", "manager", "go-modules"),
    *(("go", "go.mod", x, "framework", v) for x, v in (("github.com/gin-gonic/gin", "gin"), ("github.com/labstack/echo", "echo"), ("github.com/gofiber/fiber", "fiber"), ("gorm.io/gorm", "gorm"), ("google.golang.org/grpc", "grpc"), ("github.com/micro/micro", "micro"))),
    ("rust", "Cargo.toml", "", "type", "rust"), ("rust", "Cargo.toml", "", "manager", "cargo"),
    *(("rust", "Cargo.toml", x, "framework", x) for x in ("actix-web", "axum", "tokio", "tauri", "rocket", "warp")),
    ("java", "pom.xml", "", "manager", "maven"), ("java", "build.gradle", "", "manager", "gradle"), ("java", "build.gradle.kts", "", "manager", "gradle"),
    ("java", "pom.xml", "spring-boot", "framework", "spring-boot"), ("java", "pom.xml", "springframework", "framework", "spring"),
    ("java", "build.gradle", "org.springframework.boot", "framework", "spring-boot"), ("java", "build.gradle.kts", "org.springframework.boot", "framework", "spring-boot"),
    ("ruby", "Gemfile", "", "manager", "bundler"), *(("ruby", "Gemfile", x, "framework", x) for x in ("rails", "sinatra", "grape", "sidekiq")), *(("ruby", "Gemfile", x, "type", x) for x in ("rspec", "minitest")),
    ("php", "composer.json", "", "manager", "composer"), *(("php", "composer.json", x, "framework", x) for x in ("laravel", "symfony", "wordpress", "yii", "codeigniter", "slim")), ("php", "composer.json", "phpunit", "type", "phpunit"),
    *(("dotnet", f, f"(?i){x}", "framework", v) for f in ("*.csproj", "*.fsproj", "*.vbproj") for x, v in (
        ("microsoft.aspnetcore", "asp.net-core"), ("microsoft.entityframeworkcore", "entity-framework-core"), ("microsoft.net.sdk.web", "asp.net-core-web"), ("microsoft.net.sdk.blazor", "blazor"),
        ("microsoft.net.sdk.worker", "worker-service"), ("microsoft.net.sdk.maui", "maui"), ("microsoft.net.sdk.winui", "winui"), ("microsoft.net.sdk.wpf", "wpf"),
    )),
)
# Language, file, pattern with the version as group 1, what it is the version of.
VERSIONS = (
    *(("javascript", "package.json", rf'"engines"\s*:\s*\{{[^}}]*"{k}"\s*:\s*"([^"]+)"', v) for k, v in (("node", "Node.js"), ("npm", "npm"), ("yarn", "yarn"), ("pnpm", "pnpm"))),
    ("python", ".python-version", r"^\s*(\S+)", "Python"), ("python", "pyproject.toml", r"python\s*=\s*['\"]([^'\"]+)['\"]", "Python"), ("python", "setup.py", r"python_requires\s*=\s*['\"]([^'\"]+)['\"]", "Python"),
    ("go", "go.mod", r"(?m)^go\s+(\d+\.\d+)", "Go"), ("rust", "Cargo.toml", r"rust-version\s*=\s*\"([^\"]+)\"", "Rust"),
    ("java", "pom.xml", r"<java\.version>([^<]+)</java\.version>", "Java"), ("java", "pom.xml", r"<maven\.compiler\.source>([^<]+)</maven\.compiler\.source>", "Java"),
    ("java", "build.gradle", r"sourceCompatibility\s*=\s*['\"]?([^'\"\s]+)['\"]?", "Java"), ("java", "build.gradle.kts", r"sourceCompatibility\s*=\s*JavaVersion\.VERSION_(\d+_\d+)", "Java"),
    ("ruby", ".ruby-version", r"^\s*(\S+)", "Ruby"), ("ruby", "Gemfile", r"ruby\s+['\"]([^'\"]+)['\"]", "Ruby"), ("php", "composer.json", r'"php"\s*:\s*"([^"]+)"', "PHP"),
    ("dotnet", "global.json", r'"sdk"\s*:\s*\{\s*"version"\s*:\s*"([^"]+)"', ".NET SDK"), ("dotnet", "*.csproj", r"<TargetFrameworks?>([^<]+)</TargetFrameworks?>", ".NET"),
)
# Language, file, pattern with a project's own version as group 1, in order.
OWN_VERSION = (
    ("javascript", "package.json", r'"version"\s*:\s*"([^"]+)"'),
    ("python", "pyproject.toml", r"(?m)^\[project\]\s*\n[\s\S]*?version\s*=\s*[\"']([^\"']+)[\"']"), ("python", "pyproject.toml", r"(?m)^\[tool\.poetry\]\s*\n[\s\S]*?version\s*=\s*[\"']([^\"']+)[\"']"),
    ("python", "setup.py", r"version\s*=\s*[\"']([^\"']+)[\"']"),
    ("rust", "Cargo.toml", r"version\s*=\s*\"([^\"]+)\""), ("java", "pom.xml", r"<project[^>]*>[\s\S]*?<version>([^<]+)</version>"),
    ("ruby", "*.gemspec", r"spec\.version\s*=\s*[\"']([^\"']+)[\"']"), ("php", "composer.json", r'"version"\s*:\s*"([^"]+)"'), ("dotnet", "*.csproj", r"<Version>\s*([^<]+)\s*</Version>"),
)
# Standard -> root files that show it.
STANDARDS = {
    "ESLint": (".eslintrc.js", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml", ".eslintrc", "eslint.config.js"),
    "Prettier": (".prettierrc", ".prettierrc.json", ".prettierrc.yml", ".prettierrc.yaml", ".prettierrc.js", ".prettierrc.cjs", "prettier.config.js"),
    "EditorConfig": (".editorconfig",), "TypeScript": ("tsconfig.json",), "Flow": (".flowconfig",), "Jest": ("jest.config.js", "jest.config.ts", "jest.config.json"),
    "Vitest": ("vitest.config.js", "vitest.config.ts"), "Mocha": ("mocha.opts", ".mocharc.js", ".mocharc.json", ".mocharc.yml"), "Jasmine": ("jasmine.json",),
    "Pylint": (".pylintrc", "pylintrc", "setup.cfg", "pyproject.toml"), "Flake8": (".flake8", "flake8.cfg", "setup.cfg", "tox.ini", "pyproject.toml"),
    "Mypy": ("mypy.ini", ".mypy.ini", "setup.cfg", "pyproject.toml"), "Bandit": (".bandit", "bandit.yml"), "Pytest": ("pytest.ini", "setup.cfg", "pyproject.toml", "conftest.py"), "Ruff": ("pyproject.toml",),
    "RSpec": ("spec/spec_helper.rb", ".rspec"), "PHP CS Fixer": (".php-cs-fixer.php", ".php-cs-fixer.dist.php", "php-cs-fixer.php"),
}
# Entry files by name, and content that marks one, by extension.
ENTRIES = (
    "index.js", "index.ts", "index.mjs", "index.cjs", "app.js", "app.ts", "main.js", "main.ts", "server.js", "server.ts", "src/index.js", "src/index.ts", "src/main.js", "src/main.ts", "src/app.js", "src/app.ts",
    "main.go", "cmd/main.go", "cmd/app/main.go", "cmd/server/main.go", "cmd/cli/main.go", "src/main.go", "src/main.rs", "src/lib.rs", "main.rs", "lib.rs",
    "main.rb", "app.rb", "run.rb", "server.rb", "lib/main.rb", "index.php", "public/index.php", "app.php", "main.php", "run.php", "server.php", "Program.cs", "Startup.cs", "Main.cs", "src/Program.cs",
)
MARKS = ((".go", r"func main\(\)"), (".rs", r"fn main\(\)"), (".java", r"public static void main\(String\[\] args\)"), (".php", "App::run|Application::run"), (".cs", r"\.Run\(\)|new WebHostBuilder"))
# Root file, pattern, monorepo tool.
MONOREPO = (("pnpm-workspace.yaml", "", "pnpm-workspaces"), ("lerna.json", "", "lerna"), ("turbo.json", "", "turborepo"), ("package.json", r'"workspaces"\s*:', "npm-workspaces"))


def _named(files: DataFrame, rule: DataFrame) -> DataFrame:
    """Root files joined to the rules of their name. Suffix rules are rows for ``*.ending``."""
    roots = files.where("not path like '%/%'")
    ending = F.concat(F.lit("*."), F.substring_index("path", ".", -1))
    keyed = roots.select("project", "content", F.explode(F.array_distinct(F.array("path", ending))).alias("file"))
    return keyed.join(F.broadcast(rule), "file")  # the rules above, a few hundred rows at most


def _table(files: DataFrame, rows, columns: str) -> DataFrame:
    return files.sparkSession.createDataFrame(list(rows), columns)


def languages(files: DataFrame) -> DataFrame:
    rule = _table(files, [(f, x) for x, names in rules.INDICATORS.items() for f in names], "file string, language string")
    return _named(files, rule).select("project", "language").distinct()


def types(files: DataFrame) -> DataFrame:
    """project, language, kind (type, manager, framework), value."""
    rule = _table(files, SHOWS, "language string, file string, pattern string, kind string, value string")
    hits = _named(files, rule).where((F.col("pattern") == "") | F.expr("content rlike pattern"))
    return hits.select("project", "language", "kind", "value").distinct()


def versions(files: DataFrame) -> DataFrame:
    """project, runtime, version: the first rule that finds one counts."""
    rule = _table(files, [(*r, i) for i, r in enumerate(VERSIONS)], "language string, file string, pattern string, runtime string, place int")
    found = _named(files, rule).withColumn("version", F.expr("regexp_extract(content, pattern, 1)")).where("version <> ''")
    return found.groupBy("project", "runtime").agg(F.min_by("version", "place").alias("version"))


def own_version(files: DataFrame) -> DataFrame:
    rule = _table(files, [(*r, i) for i, r in enumerate(OWN_VERSION)], "language string, file string, pattern string, place int")
    found = _named(files, rule).withColumn("version", F.expr("regexp_extract(content, pattern, 1)")).where("version <> ''")
    return found.groupBy("project").agg(F.min_by("version", "place").alias("version"))


def standards(files: DataFrame) -> DataFrame:
    rule = _table(files, [(f, s) for s, names in STANDARDS.items() for f in names], "file string, standard string")
    return files.join(F.broadcast(rule), files.path == rule.file).select("project", "standard").distinct()


def monorepo(files: DataFrame) -> DataFrame:
    rule = _table(files, MONOREPO, "file string, pattern string, tool string")
    return _named(files, rule).where((F.col("pattern") == "") | F.expr("content rlike pattern")).select("project", "tool").distinct()


def is_entry(path: Column, content: Column) -> Column:
    test = path.isin(*ENTRIES)
    for ending, mark in MARKS:
        test = test | (path.endswith(ending) & content.rlike(mark))
    return test


def entry_points(files: DataFrame) -> DataFrame:
    return files.where(is_entry(F.col("path"), F.col("content"))).select("project", "path").distinct()


def structure(files: DataFrame, excluded: list[str]) -> DataFrame:
    """files(project, path, content) -> a project's whole analysis in a row: projectName,
    projectType, entryPoints, modules, docsFound, stats.

    A file tells in one pass what it counts as; equal findings are added up by project and
    value before a project's lists are made, which hold distinct names only. Projects
    without modules under a source root take their visible root folders. Rows without a
    project count for none; null contents match no mark."""
    path, own = F.col("path"), ~is_excluded(F.col("path"), excluded)
    code, roots = own & is_code(path), "|".join(rules.SOURCE_ROOTS)
    below = lambda pattern: F.when(code, F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")))
    marks = {
        "file": F.when(code, F.lit("")),
        "module": below(f"^((?:{roots})/[^/]+)/"),
        "folder": below("^([^./][^/]*)/"),
        "doc": F.when(is_known_doc(path), path),
        "entry": F.when(own & is_entry(path, F.col("content")), path),
    }
    told = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in marks.items())))
    found = files.where("project is not null").select("project", told.alias("told")).select("project", "told.*").where("value is not null")
    found = found.groupBy("project", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    named = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))
    counted = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("value").alias("path"), F.substring_index("value", "/", -1).alias("name"), F.col("n").alias("files")))))
    lists = found.groupBy("project").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("n"))), F.lit(0)).alias("files"),
        counted("module").alias("modules"), counted("folder").alias("folders"), named("doc").alias("docs"), named("entry").alias("entries"),
    )
    kinds = types(files).groupBy("project").agg(F.array_sort(F.collect_set("value")).alias("types"))
    every = files.where("project is not null").select("project").distinct().join(lists, "project", "left").join(kinds, "project", "left")
    filled = lambda name: F.coalesce(name, F.from_json(F.lit("[]"), every.schema[name].dataType))
    every = every.withColumn("modules", F.when(F.size(filled("modules")) > 0, F.col("modules")).otherwise(filled("folders")))
    stats = F.struct(F.coalesce("files", F.lit(0)).alias("totalFiles"), F.size("modules").cast("long").alias("totalModules"), F.size(filled("docs")).cast("long").alias("totalDocs"))
    return every.select(F.col("project").alias("projectName"), filled("types").alias("projectType"), filled("entries").alias("entryPoints"), "modules", filled("docs").alias("docsFound"), stats.alias("stats"))
