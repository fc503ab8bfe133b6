"""Word lists and tables that results depend on, in natural order."""

TEST_DIRS = ("__specs__", "__test__", "__tests__", "e2e", "spec", "specs", "test", "test-support", "test_support", "tests")
TEST_FILE_MARKS = ("_test.", ".test.", "_test-", ".test-", "_spec.", ".spec.", "_suite.", ".suite.")
GENERATED_DIRS = ("__generated__", ".generated", "generated")
GENERATED_FILE_MARKS = (".bundle.", ".generated.", ".min.")
GENERATED_NAMES = ("import_map.py", "import_map.ts")
IGNORED_DIRS = (
    ".cache", ".context-graph", ".git", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".turbo", ".understand-anything", ".venv", "__pycache__", "_build", "_generated", "_next",
    "backup", "build", "coverage", "deps", "dist", "out", "node_modules", "public", "references", "user-data", "venv", "vendor",
)
ROOT_IGNORED_DIRS = ("target",)
KEPT_HIDDEN_DIRS = (".github",)

PYTHON_SUFFIXES = (".py",)
SCRIPT_LANGUAGES = {".cjs": "javascript", ".cts": "typescript", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".mts": "typescript", ".ts": "typescript", ".tsx": "tsx"}
SCRIPT_SUFFIXES = tuple(SCRIPT_LANGUAGES)
UNPARSED_SUFFIXES = (".c", ".cc", ".cpp", ".cs", ".erl", ".ex", ".exs", ".go", ".h", ".hpp", ".hrl", ".hs", ".java", ".kt", ".kts", ".lua", ".php", ".rb", ".rs", ".scala", ".swift")
TEXT_SUFFIXES = (".conf", ".css", ".eex", ".graphql", ".heex", ".html", ".json", ".jsonc", ".livemd", ".md", ".mmd", ".prisma", ".proto", ".rules", ".sh", ".sql", ".toml", ".txt", ".yaml", ".yml")
SCAN_BASENAMES = (".env", ".gitignore", "Dockerfile", "Justfile", "Makefile", "Procfile")
IGNORED_SUFFIXES = (
    ".7z", ".app", ".bak", ".beam", ".bin", ".csv", ".db", ".db-shm", ".db-wal", ".doc", ".docx", ".DS_Store", ".exe", ".gif", ".ico", ".ipynb", ".jpeg", ".jpg", ".local", ".lock", ".log",
    ".map", ".mp4", ".msg", ".parquet", ".pdf", ".png", ".pyc", ".sqlite", ".svg", ".tsbuildinfo", ".webp", ".xls", ".xlsm", ".xlsx", ".zip",
)
LANGUAGES = SCRIPT_LANGUAGES | {
    ".c": "c", ".cc": "cpp", ".conf": "config", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".eex": "eex", ".erl": "erlang", ".ex": "elixir", ".exs": "elixir", ".go": "go", ".graphql": "graphql",
    ".h": "c-header", ".heex": "heex", ".hpp": "cpp-header", ".hrl": "erlang-header", ".hs": "haskell", ".html": "html", ".java": "java", ".json": "json", ".jsonc": "jsonc", ".kt": "kotlin",
    ".kts": "kotlin", ".livemd": "markdown", ".lua": "lua", ".md": "markdown", ".mmd": "mermaid", ".php": "php", ".prisma": "prisma", ".proto": "protobuf", ".py": "python", ".rb": "ruby",
    ".rs": "rust", ".rules": "rules", ".scala": "scala", ".sh": "shell", ".sql": "sql", ".swift": "swift", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml",
}
ENTRY_BASENAMES = (
    "__main__.py", "app.cjs", "app.cts", "app.js", "app.jsx", "app.mjs", "app.mts", "app.py", "app.ts", "app.tsx", "cli.py", "index.cjs", "index.cts", "index.js", "index.jsx", "index.mjs", "index.mts",
    "index.ts", "index.tsx", "main.cjs", "main.cts", "main.js", "main.jsx", "main.mjs", "main.mts", "main.py", "main.ts", "main.tsx", "server.py",
)
CONFIG_BASENAMES = (".env", ".gitignore", "Cargo.toml", "Dockerfile", "go.mod", "package.json", "pnpm-lock.yaml", "pyproject.toml", "ruff.toml", "tsconfig.json", "uv.lock")
MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml")
SEARCH_STOP_WORDS = ("about", "and", "are", "can", "for", "from", "how", "into", "the", "this", "that", "what", "when", "where", "which", "with")
UTILITY_BASENAMES = ("types.py", "types.ts", "exceptions.py", "constants.py", "constants.ts", "base.py", "base.ts", "utils.py", "utils.ts")
IMPLEMENTATION_BASENAMES = ("factory.py", "main.py", "run.py", "runner.py", "server.py", "cli.py")
MAIN_NAMES = ("main", "run", "start", "serve", "cli", "app", "create_app", "build_app", "invoke", "execute", "handler")
MAIN_PREFIXES = ("build_", "create_", "load_", "fetch_", "resolve_", "get_", "display_")
GENERIC_NAMES = (
    "all", "any", "append", "cat", "bool", "clear", "close", "connect", "concat", "describe", "dict", "eval", "execute", "expect", "exists", "fetch", "filter", "float", "from", "get",
    "handler", "html", "int", "isInstance", "items", "it", "json", "keys", "len", "list", "lower", "map", "max", "min", "open", "pop", "print", "range", "read", "read_text",
    "reject", "reshape", "resolve", "run", "send", "set", "sleep", "str", "sum", "test", "to", "transpose", "tuple", "unsqueeze", "update", "upper", "values", "write", "write_text", "yield",
)
GENERIC_LABELS = ("app", "lib", "packages", "src")
