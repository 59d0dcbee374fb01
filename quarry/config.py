"""Rule tables and limits. They must be as they are for results to be right."""

from __future__ import annotations

# Extensions by language.
EXTENSIONS = {
    "Python": [".py", ".pyi", ".pyw"],
    "JavaScript": [".js", ".mjs", ".cjs", ".jsx"],
    "TypeScript": [".ts", ".tsx"],
    "Java": [".java"],
    "Go": [".go"],
    "Rust": [".rs"],
    "C": [".c", ".h"],
    "C++": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".h++"],
    "Ruby": [".rb", ".rake", ".gemspec"],
    "PHP": [".php", ".php3", ".php4", ".php5", ".phtml"],
    "Swift": [".swift"],
    "Kotlin": [".kt", ".kts"],
    "Scala": [".scala", ".sc"],
    "Shell": [".sh", ".bash", ".zsh", ".fish", ".ksh"],
    "R": [".r"],
    "Elixir": [".ex", ".exs"],
    "Haskell": [".hs", ".lhs"],
    "Lua": [".lua"],
    "Perl": [".pl", ".pm", ".perl"],
    "Dart": [".dart"],
    "C#": [".cs"],
    "F#": [".fs", ".fsi", ".fsx"],
    "Clojure": [".clj", ".cljs", ".cljc"],
    "Erlang": [".erl", ".hrl"],
    "Julia": [".jl"],
    "Nim": [".nim"],
    "Zig": [".zig"],
    "OCaml": [".ml", ".mli"],
}
LANGUAGE_OF = {ext: language for language, exts in EXTENSIONS.items() for ext in exts}

# Directories that are never read, compared in lower case.
IGNORED_DIRECTORIES = [
    "node_modules", ".next", ".nuxt", ".svelte-kit", "bower_components",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "venv", "env", ".env", ".venv", "eggs", "wheels", ".eggs", ".tox",
    "dist", "build", "target", "out", "bin", "obj", "_build", "output",
    "__mocks__", "fixtures", "snapshots", "__fixtures__",
    "coverage", ".coverage", "htmlcoverage", ".nyc_output",
    ".git", ".idea", ".vscode", ".vs", ".ds_store", ".trash",
    "vendor", "packages", ".gradle", ".m2", ".cargo",
    "tmp", "temp", ".cache", "log", "logs",
]

# File names that are never read, as globs in lower case, in order of their tests.
IGNORED_PATTERNS = [
    "*.min.js", "*.min.css", "*.map", "*.bundle.js", "*.chunk.js",
    "*.lock", "package-lock.json", "yarn.lock", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "cargo.lock", "*.sum",
    "*.pyc", "*.pyo", "*.class", "*.o", "*.a", "*.so", "*.dll", "*.dylib", "*.exe", "*.wasm",
    "*.pb.go", "*.generated.*", "*_gen.go", "*.g.dart",
    ".ds_store", "thumbs.db", "*.orig", "*.rej",
]

# Limits.
MAX_FILE_BYTES = 500_000
MAX_TOTAL_BYTES = 50_000_000
BINARY_SAMPLE_CHARS = 8_000
BINARY_NUL_SHARE = 0.01
BINARY_NONPRINTABLE_SHARE = 0.30
MAX_BODY_CHARS = 50_000
MINIFIED_LINE_CHARS = 10_000
#: What a file may take to parse.
PARSE_SECONDS = 30.0
MAX_CHUNK_TOKENS = 200
OVERLAP_TOKENS = 40
MIN_CHUNK_TOKENS = 10
PREVIEW_CHARS = 200
TOP_SEMANTIC, TOP_KEYWORD, TOP_HYDE, TOP_FINAL = 15, 10, 8, 12
MAX_EXPANSION_CHUNKS = 6
MAX_CONTEXT_TOKENS = 3000
MAX_HISTORY_TOKENS = 800
MAX_TURNS = 20
SEMANTIC_WEIGHT, KEYWORD_WEIGHT, BOTH_BONUS = 0.65, 0.35, 0.1
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.75, 0.50
MAX_TRAVERSAL_DEPTH, MAX_TRAVERSAL_NODES = 6, 500
LLM_BUDGET = 30
HUB_THRESHOLD = 5
ANALYZE_DEPTH, MIN_COMPLEXITY = 3, 3
MAX_DIAGRAM_NODES = 80
SEPARATOR = "\n\n---\n\n"
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Modules that ship with Node.
NODE_MODULES = [
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel",
    "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process",
    "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "timers", "tls", "trace_events", "tty", "url", "util",
    "v8", "vm", "wasi", "worker_threads", "zlib",
]


# Modules that ship with Python.
PYTHON_MODULES = [
    "abc", "ast", "asyncio", "base64", "binascii", "builtins", "calendar", "cgi", "cgitb", "chunk", "cmath", "cmd", "code", "codecs", "codeop",
    "collections", "colorsys", "compileall", "concurrent", "configparser", "contextlib", "contextvars", "copy", "copyreg", "cProfile", "csv",
    "ctypes", "curses", "dataclasses", "datetime", "dbm", "decimal", "difflib", "dis", "doctest", "email", "encodings", "enum", "errno",
    "faulthandler", "fcntl", "filecmp", "fileinput", "fnmatch", "fractions", "ftplib", "functools", "gc", "getopt", "getpass", "gettext", "glob",
    "grp", "gzip", "hashlib", "heapq", "hmac", "html", "http", "idlelib", "imaplib", "importlib", "inspect", "io", "ipaddress", "itertools",
    "json", "keyword", "lib2to3", "linecache", "locale", "logging", "lzma", "mailbox", "marshal", "math", "mimetypes", "mmap", "modulefinder",
    "multiprocessing", "netrc", "nis", "nntplib", "numbers", "operator", "optparse", "os", "ossaudiodev", "pathlib", "pdb", "pickle",
    "pickletools", "pipes", "pkgutil", "platform", "plistlib", "poplib", "posix", "posixpath", "pprint", "profile", "pstats", "pty", "pwd",
    "py_compile", "pyclbr", "pydoc", "queue", "quopri", "random", "re", "readline", "reprlib", "resource", "rlcompleter", "runpy", "sched",
    "secrets", "select", "selectors", "shelve", "shlex", "shutil", "signal", "site", "smtpd", "smtplib", "sndhdr", "socket", "socketserver",
    "spwd", "sqlite3", "sre_compile", "sre_constants", "sre_parse", "ssl", "stat", "statistics", "string", "stringprep", "struct", "subprocess",
    "sunau", "symtable", "sys", "sysconfig", "syslog", "tabnanny", "tarfile", "telnetlib", "tempfile", "termios", "test", "textwrap",
    "threading", "time", "timeit", "tkinter", "token", "tokenize", "trace", "traceback", "tracemalloc", "tty", "turtle", "turtledemo",
    "types", "typing", "unicodedata", "unittest", "urllib", "uu", "uuid", "venv", "warnings", "wave", "weakref", "webbrowser",
    "wsgiref", "xdrlib", "xml", "xmlrpc", "zipapp", "zipfile", "zipimport", "zlib", "zoneinfo", "_thread",
]


# Words and operators that branch, by language.
COMPLEXITY_KEYWORDS = {
    "Python": ["if", "elif", "for", "while", "try", "except", "with", "and", "or", "assert"],
    "JavaScript": ["if", "else", "for", "while", "try", "catch", "switch", "&&", "||", "??"],
    "TypeScript": ["if", "else", "for", "while", "try", "catch", "switch", "&&", "||", "??"],
    "Java": ["if", "else", "for", "while", "try", "catch", "switch", "&&", "||"],
    "Go": ["if", "else", "for", "switch", "select", "&&", "||"],
    "Rust": ["if", "else", "for", "while", "loop", "match", "&&", "||"],
    "C": ["if", "else", "for", "while", "do", "switch", "&&", "||"],
    "C++": ["if", "else", "for", "while", "do", "switch", "try", "catch", "&&", "||"],
    "Ruby": ["if", "elsif", "unless", "while", "until", "for", "rescue", "&&", "||"],
    "PHP": ["if", "elseif", "else", "for", "foreach", "while", "try", "catch", "&&", "||"],
    "Swift": ["if", "else", "for", "while", "switch", "guard", "catch", "&&", "||"],
    "Kotlin": ["if", "else", "for", "while", "when", "try", "catch", "&&", "||"],
}

# Path signals of architectural patterns.
PATTERN_SIGNALS = {
    "MVC": ["models/", "views/", "controllers/", "model.py", "view.py", "controller.py", "models.py", "views.py", "urls.py", "app/models", "app/views", "app/controllers"],
    "Layered": ["services/", "repositories/", "handlers/", "service.py", "repository.py", "handler.py", "services.py", "repositories.py"],
    "Microservices": ["services/", "gateway/", "docker-compose", "kubernetes/", "k8s/", "helm/"],
    "Event-driven": ["events/", "handlers/", "listeners/", "subscribers/", "publishers/", "queue/", "celery", "kafka", "rabbitmq", "pubsub"],
    "REST API": ["routes/", "endpoints/", "api/", "router.py", "routes.py", "serializers/", "@app.get", "@app.post", "@getmapping", "@postmapping"],
    "CLI": ["cli/", "commands/", "click", "argparse", "typer", "cobra", "commander", "sys.argv"],
    "Plugin/Extension": ["plugins/", "extensions/", "register_plugin", "add_extension"],
    "Frontend Component": ["components/", "pages/", ".jsx", ".tsx", "reactdom", "createroot", "vue", "ngmodule"],
}

# Query types and their key phrases, in order of their tests.
QUERY_TYPES = {
    "what_is": ["what is", "what are", "describe", "explain what", "tell me about", "what does"],
    "how_does": ["how does", "how do", "how is", "how are", "how to", "walk me through", "explain how"],
    "where_is": ["where is", "where are", "where does", "find", "locate", "which file", "which function"],
    "why_is": ["why is", "why are", "why does", "why was", "reason for", "purpose of", "rationale"],
    "what_calls": ["what calls", "who calls", "what uses", "what depends on", "callers of"],
    "what_imports": ["what imports", "what does it import", "dependencies of", "what requires"],
    "what_breaks": ["what breaks", "what would break", "impact of removing", "what depends on", "side effects of changing"],
    "compare": ["compare", "difference between", "vs", "versus", "similar to", "how does X differ"],
}
# Words that make a question one about relations.
RELATION_WORDS = ["call", "calls", "called by", "uses", "used by", "import", "imports", "imported by", "depends on", "dependency", "dependencies", "require", "requires"]
# Words that are no keywords of a question.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "this", "but", "they", "have", "had", "what", "when", "where", "who", "which", "why", "how",
]
# Phrases of doubt and of hedging in answers.
UNCERTAIN = ["i don't know", "not sure", "unclear", "cannot determine", "don't have enough", "insufficient context"]
HEDGING = ["might", "probably", "possibly", "perhaps", "maybe"]

# Layers and their signals, in order of their tests.
LAYERS = {
    "entry": ["main", "app", "server", "index", "run", "start", "cli", "manage", "wsgi", "asgi"],
    "controller": ["controller", "handler", "router", "route", "endpoint", "view", "resource"],
    "service": ["service", "usecase", "business", "logic", "manager", "processor", "orchestrator"],
    "repository": ["repository", "repo", "dao", "store", "database", "db", "storage", "persistence"],
    "model": ["model", "entity", "schema", "domain", "struct", "type", "dto", "record"],
    "utility": ["util", "helper", "common", "shared", "lib", "tool", "mixin", "base"],
    "config": ["config", "setting", "env", "constant", "conf", "cfg"],
    "middleware": ["middleware", "interceptor", "filter", "guard", "auth", "cors", "logging"],
}
# Calls between layers that are expected, and layers that all may call.
EXPECTED_CALLS = [
    ("entry", "controller"), ("entry", "service"), ("controller", "service"), ("service", "repository"),
    ("service", "model"), ("repository", "model"), ("controller", "model"),
]
OPEN_LAYERS = ["utility", "config", "middleware"]

# Design patterns, in order of their tests.
DESIGN_PATTERNS = ["Singleton", "Factory", "Repository", "Strategy", "Observer", "Decorator", "Facade", "Proxy", "Command", "Builder", "Adapter", "Bridge"]
# Flags of a repository and the path parts that raise them.
PATH_FLAGS = {
    "uses_middleware": ["middleware"], "has_migrations": ["migration"], "event_driven": ["async", "event"], "has_api_routes": ["route", "endpoint"],
    "uses_database": ["db", "database", "model"], "has_tests": ["test"], "has_config": ["config", "setting"], "has_cli": ["cli", "command"],
}
# File names and code that mark entry points.
HIGH_NAMES = [
    "main.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "main.js", "index.js", "server.js", "app.js",
    "main.ts", "index.ts", "server.ts", "app.ts", "main.go", "main.rs", "main.c", "main.cpp", "Application.java", "Main.java",
]
MEDIUM_NAMES = ["app.py", "server.py", "run.py", "cli.py", "start.py", "app.ts", "server.ts", "cli.ts", "index.tsx", "app.tsx"]
WEB_SIGNALS = ["Flask(__name__)", "FastAPI()", "app = Flask", "app = FastAPI", "express()", "createServer(", "app.listen(", "gin.New()", "gin.Default()", "fiber.New()", "http.ListenAndServe"]
CLI_SIGNALS = ["argparse.ArgumentParser", "click.group", "click.command", "typer.Typer", "@click", "cobra.Command", "commander.Command", "process.argv"]
# Suffixes that an import may stand for, in order of their tests.
IMPORT_SUFFIXES = ["", ".py", ".js", ".ts", ".tsx", ".go", ".rs", "/__init__.py", "/index.js", "/index.ts"]

# Built-in names, whose calls make no edge.
BUILTINS = [
    "print", "len", "range", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "type", "isinstance", "issubclass", "hasattr",
    "getattr", "setattr", "delattr", "sorted", "reversed", "enumerate", "zip", "map", "filter", "any", "all", "sum", "min", "max", "abs",
    "round", "open", "input", "super", "property", "staticmethod", "classmethod", "repr", "hash", "id", "callable", "iter", "next",
    "vars", "dir", "help", "exec", "eval", "compile", "chr", "ord", "hex", "oct", "bin", "format", "object", "Exception", "ValueError",
    "TypeError", "KeyError", "IndexError", "RuntimeError", "NotImplementedError", "StopIteration", "GeneratorExit", "SystemExit", "KeyboardInterrupt",
    "console", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "fetch", "Promise", "JSON", "Math", "Date", "Array", "Object", "String",
    "Number", "Boolean", "Error", "Symbol", "Map", "Set", "WeakMap", "WeakSet", "Proxy", "Reflect", "parseInt", "parseFloat", "isNaN",
    "isFinite", "encodeURIComponent", "decodeURIComponent",
]
# Words that are no keywords of a function.
CODE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "is", "in", "of", "to", "for", "with", "this", "that", "it", "at", "by", "from", "on", "as",
    "be", "was", "are", "has", "have", "had", "do", "does", "did", "not", "but", "if", "else", "return", "def", "class", "import",
    "self", "cls", "none", "true", "false", "pass", "raise", "yield", "lambda", "async", "await", "try", "except", "finally",
    "while", "break", "continue",
]
