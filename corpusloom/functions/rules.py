"""Fixed values that results depend on: extensions, directory names, patterns, labels."""

from __future__ import annotations

# File extension -> language.
LANGUAGE_OF = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".vue": "javascript", ".svelte": "javascript", ".astro": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "java", ".scala": "java",
    ".rb": "ruby", ".php": "php", ".cs": "dotnet", ".fs": "dotnet", ".vb": "dotnet",
}
# Code extensions beyond those of the languages, and document extensions.
MORE_CODE = (".c", ".cpp", ".h", ".hpp")
DOCS = (".md", ".mdx", ".rst", ".txt")
CODE = (*LANGUAGE_OF, *MORE_CODE)

# Directories left out of a scan, common and by language.
EXCLUDED = (
    ".git", ".svn", ".hg", ".idea", ".vscode", ".vs", ".fleet", "node_modules", "dist", "build", "out", "coverage", ".cache", ".tmp", ".temp", ".agent",
)
EXCLUDED_BY = {
    "javascript": ("node_modules", ".next", ".nuxt", ".svelte-kit", ".astro", "dist", "build", "out", "coverage", ".nyc_output", ".turbo", ".parcel-cache", ".webpack"),
    "python": ("__pycache__", "venv", ".venv", "env", ".env", "eggs", ".eggs", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "htmlcov", ".nox"),
    "go": ("vendor", "bin", "build", "testdata"),
    "rust": ("target",),
    "java": ("target", "build", "bin", "obj", ".gradle", ".mvn", "out"),
    "ruby": ("vendor", "tmp", "log"),
    "php": ("vendor", "storage", "bootstrap/cache"),
    "dotnet": ("bin", "obj", "packages", "TestResults", ".vs"),
}
# Files whose presence at the root shows a language; a leading * is a suffix.
INDICATORS = {
    "javascript": ("package.json", "tsconfig.json"),
    "python": ("requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "setup.cfg", "poetry.lock", ".python-version"),
    "go": ("go.mod", "go.sum"),
    "rust": ("Cargo.toml", "Cargo.lock"),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle"),
    "ruby": ("Gemfile", "Rakefile", "*.gemspec"),
    "php": ("composer.json", "composer.lock"),
    "dotnet": ("*.csproj", "*.fsproj", "*.vbproj", "*.sln", "project.json", "global.json"),
}
# Import statements by language, group 1 is the specifier.
IMPORTS = {
    "javascript": (
        r"""(?:import|export)\s+[\s\S]*?\s+from\s+['"](\.[^'"]+)['"]""",
        r"""(?:import|export)\s+['"](\.[^'"]+)['"]""",
        r"""require\s*\(\s*['"](\.[^'"]+)['"]\s*\)""",
        r"""import\s*\(\s*['"](\.[^'"]+)['"]\s*\)""",
    ),
    "python": (r"(?m)^\s*from\s+(\.[^\s]+)\s+import", r"(?m)^\s*import\s+(\.[^\s,]+)"),
    "go": (r"""import\s+"([^"]+)\"""",),
    "rust": (r"\bmod\s+(\w+)",),
    "java": (r"(?m)^\s*import\s+([\w.]+)",),
    "ruby": (r"""\brequire\s+['"]([^'"]+)['"]""", r"""\brequire_relative\s+['"]([^'"]+)['"]"""),
    "php": (r"\buse\s+([\w\\]+)", r"""\brequire(?:_once)?\s+['"]([^'"]+)['"]""", r"""\binclude(?:_once)?\s+['"]([^'"]+)['"]"""),
    "dotnet": (r"(?m)^\s*using\s+([\w.]+)",),
}
# Extensions and directory files tried for an import, in order.
RESOLVE = {
    "javascript": ((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), ("index.ts", "index.tsx", "index.js", "index.jsx")),
    "python": ((".py",), ("__init__.py",)),
    "rust": ((".rs",), ("mod.rs",)),
    "ruby": ((".rb",), ()),
    "php": ((".php",), ()),
}
# Exported names by language, group 1 is the name.
EXPORTS = {
    "javascript": (r"\bexport\s+(?:default\s+)?(?:class|function|const|interface|type)\s+(\w+)", r"\bexport\s*\{\s*([^}]+)\s*\}", r"\bmodule\.exports\s*=\s*\{([^}]+)\}"),
    "python": (r"\bdef\s+(\w+)\s*\(", r"\bclass\s+(\w+)\s*[\(:]"),
    "go": (r"\bfunc\s+(\w+)\s*\(", r"\bfunc\s+\([^)]+\)\s+(\w+)\s*\(", r"\btype\s+(\w+)\s+(?:struct|interface|func)"),
    "rust": (r"\b(?:pub\s+)?(?:fn|struct|enum|trait|impl)\s+(\w+)", r"\b(?:pub\s+)?const\s+(\w+)"),
    "java": (r"\b(?:public|protected)\s+(?:class|interface|enum)\s+(\w+)", r"\b(?:public|protected)\s+(?:static\s+)?(?:final\s+)?(?:void|int|String|boolean|List|Map|\w+)\s+(\w+)\s*\("),
    "dotnet": (r"\b(?:public|internal)\s+(?:class|interface|struct|enum)\s+(\w+)", r"\b(?:public|internal)\s+(?:static\s+)?(?:readonly\s+)?(?:virtual\s+)?(?:async\s+)?(?:Task<)?(\w+)>?\s+(\w+)\s*\("),
    "ruby": (r"\bdef\s+(?:self\.)?(\w+)", r"\bclass\s+(\w+)"),
    "php": (r"\b(?:public|private|protected)\s+(?:static\s+)?function\s+(\w+)\s*\(", r"\bclass\s+(\w+)", r"\binterface\s+(\w+)"),
}
# Directories whose children are modules.
SOURCE_ROOTS = ("src", "lib", "app", "packages", "modules", "components", "services", "core")

# Substrings of a module name -> category, in order.
CATEGORIES = (
    ("ui", ("component", "ui", "view", "page")),
    ("api", ("api", "service", "handler")),
    ("utility", ("util", "helper", "common", "shared")),
    ("core", ("core", "lib", "engine")),
    ("config", ("config", "setting")),
    ("test", ("test", "spec")),
)
# Substrings of a module name -> role, in order.
ROLES = (
    ("test", ("test", "spec", "__tests__")),
    ("config", ("config", "setting", "conf")),
    ("ui", ("component", "ui", "view", "page", "widget")),
    ("utility", ("util", "helper", "common", "shared", "tool")),
    ("api", ("api", "service", "handler", "endpoint")),
)
# Why a role or a template is recommended.
ROLE_REASONS = {
    "test": "Directory name indicates test module", "config": "Directory name indicates configuration module", "ui": "Directory name indicates UI component module",
    "utility": "Directory name indicates utility module", "api": "Directory name indicates API/service module",
}
REASON_ENTRY = "Module is entry point with multiple dependents — likely core business logic"
REASON_EXPORTS = "High export count suggests large public API surface — likely core module"
REASON_SCORE = "High complexity score suggests deep business logic"
REASON_SMALL = "Small module with few exports — likely utility or helper module"
REASON_NONE = "Cannot determine role from directory name or signals. Semantic understanding required."
TEMPLATE_HIGH = "High complexity or export count — full template recommended"
TEMPLATE_LOW = "Low complexity and few exports — simple template sufficient"
TEMPLATE_REASONS = {
    "test": "Test modules need concise documentation", "config": "Config modules typically have simple structure", "utility": "Utility modules benefit from concise docs",
    "ui": "UI components need detailed props/API documentation", "api": "API modules need detailed endpoint documentation", "core": "Core modules require comprehensive documentation",
    "unknown": "Default to full template when role is unclear",
}
TEMPLATE_FILES = {"full": "module.md", "simple": "module-simple.md"}

# Words at the start of a part of a module name -> hint.
HINTS = (
    ("auth|user|account|login|permission|role", "Authentication or user management module"),
    ("api|rest|grpc|endpoint", "API or network layer module"),
    ("db|database|repo|store|persistence", "Data persistence layer module"),
    ("cache|redis|mem", "Caching or in-memory storage module"),
    ("queue|message|event|broadcast", "Messaging or event handling module"),
    ("worker|job|task|cron", "Background job or task scheduling module"),
    ("middleware|filter|interceptor", "Middleware or request processing module"),
    ("validator|schema|parser|encoder", "Data processing or transformation module"),
    ("logger|metrics|monitor|telemetry", "Observability or monitoring module"),
    ("cli|command|runner|executor", "CLI or command execution module"),
)
# Hints from numbers.
HINT_EXPORTS = "Large public API surface — consider organizing into sub-modules"
HINT_DEPENDED = "Widely depended upon — treat as stable public API"
HINT_ENTRY = "Entry module with many dependencies — central orchestration point"
HINT_NONE = "No strong semantic signals detected — use code structure and context to determine role"

# File-name words -> expected size of a document.
CORE_WORDS = ("core", "agent", "editor", "store", "main", "client")
UTILITY_WORDS = ("util", "helper", "common", "shared", "constant", "config", "type")
INDEX_NAMES = ("index", "_index", "toc", "doc-map")
EXPECTED = {"core": (200, 8, 2, 3), "utility": (80, 5, 1, 2), "index": (50, 3, 1, 0), "other": (100, 6, 1, 2)}
# Words that show a section, in English.
PRACTICE_WORDS = ("best practice", "best practices")
PERFORMANCE_WORDS = ("performance", "performance optimization", "performance considerations")
TROUBLE_WORDS = ("troubleshoot", "troubleshooting", "debug", "error handling", "debugging")
RESERVED_IDS = ("class", "graph", "digraph", "subgraph", "end", "click", "style", "state", "note")

# Navigation labels by language.
LABELS = {
    "zh": ("目录", "首页", "模块文档", "API 参考"),
    "en": ("Table of Contents", "Home", "Modules", "API Reference"),
    "ja": ("目次", "ホーム", "モジュール", "APIリファレンス"),
    "ko": ("목차", "홈", "모듈", "API 참조"),
    "fr": ("Table des matières", "Accueil", "Modules", "Référence API"),
    "de": ("Inhaltsverzeichnis", "Startseite", "Module", "API-Referenz"),
}

# Labels of the first pages, by language.
FIRST_PAGES = {
    "zh": ("快速开始", "架构概览"),
    "en": ("Getting Started", "Architecture"),
    "ja": ("はじめに", "アーキテクチャ"),
    "ko": ("시작하기", "아키텍처"),
    "fr": ("Démarrage rapide", "Architecture"),
    "de": ("Schnellstart", "Architektur"),
}

# Other names of languages.
ALIASES = {
    "javascript": ("js", "typescript", "ts", "nodejs", "node", "node.js"), "python": ("py", "python3"), "go": ("golang", "go-lang"), "rust": ("rs", "rust-lang"),
    "java": ("jdk", "jvm", "kotlin", "scala"), "ruby": ("rb",), "php": (), "dotnet": ("csharp", "c#", "vbnet", "vb.net", "fsharp", "f#", "aspnet", "asp.net"),
}

# Badge colours.
BADGE_COLORS = {"blue": "#007ec6", "green": "#4c1", "brightgreen": "#44cc11", "yellow": "#dfb317", "orange": "#fe7d37", "red": "#e05d44", "lightgrey": "#9f9f9f", "gray": "#555"}
# A project's settings where it has none.
DEFAULT_SETTINGS = {"language": "zh", "exclude": (), "use_gitignore": True}


def code_endings() -> tuple[str, ...]:
    return (*LANGUAGE_OF, *MORE_CODE)


def register_language(name: str, endings: tuple[str, ...], *, aliases=(), excluded=(), imports=(), resolve=((), ()), exports=()) -> None:
    """Adds a language to the rule tables, which every operator reads when it makes a plan.

    ``imports`` and ``exports`` are patterns whose group 1 is the specifier or name;
    ``resolve`` has the endings and the directory files tried for an import. A name that
    is known already is an error, as is an ending that another language has."""
    taken = [e for e in endings if e in LANGUAGE_OF]
    if name in ALIASES or taken:
        raise ValueError(f"{name}: this language or one of its endings is registered: {taken}")
    LANGUAGE_OF.update(dict.fromkeys(endings, name))
    ALIASES[name] = tuple(aliases)
    EXCLUDED_BY[name] = tuple(excluded)
    IMPORTS[name], EXPORTS[name], RESOLVE[name] = tuple(imports), tuple(exports), tuple(resolve)


def forget_language(name: str) -> None:
    """Takes a registered language out of the rule tables again."""
    for ending in [e for e, of in LANGUAGE_OF.items() if of == name]:
        del LANGUAGE_OF[ending]
    for table in (ALIASES, EXCLUDED_BY, IMPORTS, EXPORTS, RESOLVE):
        table.pop(name, None)
