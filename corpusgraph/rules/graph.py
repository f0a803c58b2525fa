"""Fixed values of graph assembly, layers and hub ranking."""

# Names too common to resolve as call targets.
CALL_STOP_NAMES = [
    "get", "set", "run", "init", "main", "test", "setup", "call", "new", "open", "close",
    "read", "write", "next", "send", "load", "save", "start", "stop", "add", "remove",
    "update", "delete", "create", "find", "show", "hide", "log", "print", "push", "pop",
    "put", "map", "then", "catch", "from", "to", "on", "off", "emit", "use", "has",
]
CALL_MIN_NAME = 3

EDGE_WEIGHTS = {"contains": 0.5, "inherits": 0.8, "imports": 0.6, "calls": 0.4}

# layer id, layer name, path components that select it; the first hit wins.
LAYERS = [
    ("api", "API / Routes", ["route", "controller", "handler", "endpoint", "api", "router", "view", "views"]),
    ("ui", "UI / Frontend", ["component", "page", "layout", "template", "widget", "screen", "ui", "frontend"]),
    ("service", "Service / Logic", ["service", "usecase", "use_case", "interactor", "manager", "logic", "domain", "core"]),
    ("data", "Data / Storage", ["model", "schema", "entity", "repository", "repo", "dao", "migration", "database", "db", "store"]),
    ("infra", "Infrastructure", ["config", "middleware", "plugin", "util", "helper", "lib", "common", "shared", "infra", "infrastructure"]),
    ("test", "Tests", ["test", "spec", "tests", "specs", "__tests__", "e2e", "integration"]),
    ("docs", "Documentation", ["docs", "readme", "guide", "tutorial", "documentation"]),
]
LANGUAGE_LAYERS = {
    "docs": ["markdown"],
    "infra": ["json", "yaml", "toml", "dockerfile", "terraform", "xml"],
    "ui": ["html", "css"],
}
DEFAULT_LAYER = "service"

TOUR_ORDER = ["Data / Storage", "Infrastructure", "Service / Logic", "API / Routes", "UI / Frontend", "Tests", "Documentation"]
READING_ORDER = ["Data / Storage", "Service / Logic", "API / Routes", "UI / Frontend", "Infrastructure", "Tests"]

HUB_SKIP_PATHS = [
    "vendor", "node_modules", "library", "jquery", "npm", "bower_components", "@types",
    "smarty", "mojavi", "jpgraph", "prototype", "tiny_mce", "ckeditor",
    "bootstrap", "fontawesome", "swiper", "lodash", "underscore",
]
HUB_SKIP_NAMES = [
    "__construct", "toString", "valueOf", "hasOwnProperty", "preventDefault",
    "stopPropagation", "addEventListener", "removeEventListener", "querySelector",
    "getElementById", "jQuery", "require", "define", "exports", "module",
    "is_array", "is_null", "is_string", "isset", "empty", "count", "array_merge",
    "array_map", "array_filter", "array_keys", "array_values", "explode", "implode",
    "sprintf", "preg_match", "str_replace", "substr", "strlen", "trim",
    "setTimeout", "setInterval", "console", "bind", "call", "apply",
    "list", "all", "get", "set", "run", "text", "prop", "attr", "each",
    "replace", "compact", "push", "pop", "map", "filter", "find", "sort",
    "add", "remove", "show", "hide", "open", "close", "next", "log",
    "join", "merge", "split", "slice", "index", "fetch", "store",
    "encode", "decode", "parse", "format", "validate", "check",
    "initialize", "init", "setup", "configure", "reset", "destroy",
    "post", "put", "patch", "delete", "head", "options",
    "to_s", "to_i", "to_a", "to_h", "inspect", "respond_to",
    "subject", "body", "header", "params", "request", "response",
    "match", "warn", "select", "convert", "sanitize", "error",
    "send", "write", "read", "create", "update", "save", "load",
    "start", "stop", "test", "new", "type", "name", "value", "data",
    "result", "info", "debug", "render", "build", "generate",
]

ENRICH_LANGUAGES = [
    "python", "javascript", "typescript", "java", "go", "rust", "c", "cpp",
    "csharp", "ruby", "php", "swift", "kotlin", "scala", "lua", "shell", "sql",
]
ENRICH_SKIP_PATHS = ["test", "tests", "spec", "specs", "__tests__", "e2e"]
CONFIG_LANGUAGES = ["css", "html", "markdown", "json", "yaml", "toml", "xml", "dockerfile", "terraform", "makefile"]
