"""What a corpus scan skips and how a file name maps to a language."""

# Directory and file names that are never scanned.
IGNORED_NAMES = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env",
    "dist", "build", "out", ".cache", "target", ".next", ".nuxt",
    ".idea", ".vs",
    "vendor", "Pods", ".gradle", "coverage",
    ".tox", ".mypy_cache", ".pytest_cache",
    "storage", "tmp", "temp", "logs",
    "cache", ".sass-cache", ".parcel-cache",
]

# Name endings that are never scanned.
IGNORED_ENDINGS = [
    ".pyc", ".pyo", ".so", ".dylib", ".dll", ".exe", ".o", ".a",
    ".class", ".jar", ".war", ".map", ".lock", ".min.js", ".min.css",
    ".woff", ".woff2", ".ttf", ".eot", ".ico", ".png", ".jpg", ".jpeg",
    ".gif", ".svg", ".mp3", ".mp4", ".zip", ".tar", ".gz", ".pdf",
]

# Name ending -> language.
ENDING_LANGUAGE = {
    ".py": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".erb": "ruby",
    ".php": "php",
    ".phtml": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".scala": "scala",
    ".r": "r",
    ".lua": "lua",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".env": "shell",
    ".htaccess": "shell",
    ".sql": "sql",
    ".html": "html",
    ".htm": "html",
    ".twig": "html",
    ".hbs": "html",
    ".vue": "html",
    ".svelte": "html",
    ".ejs": "html",
    ".pug": "html",
    ".css": "css",
    ".scss": "css",
    ".less": "css",
    ".sass": "css",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".conf": "yaml",
    ".toml": "toml",
    ".ini": "toml",
    ".cfg": "toml",
    ".xml": "xml",
    ".xsl": "xml",
    ".xslt": "xml",
    ".md": "markdown",
    ".mdx": "markdown",
    ".rst": "markdown",
    ".dockerfile": "dockerfile",
    ".tf": "terraform",
    ".proto": "protobuf",
    ".graphql": "graphql",
    ".gql": "graphql",
}

# Whole file names with a language of their own.
LANGUAGE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile"}

# Languages whose files are parsed for symbols.
CODE_LANGUAGES = [
    "python", "javascript", "typescript", "java", "go", "rust", "c", "cpp",
    "csharp", "ruby", "php", "swift", "kotlin", "scala", "lua", "shell",
]
