"""Fixed values of semantic tagging: effects, domains, roles, control flow, entities."""

EFFECT_PATTERNS = {
    "db_write": r"\.save\(|\.create\(|\.update\(|\.delete\(|\.destroy\(|\.insert\(|\.upsert\(|\bINSERT\b|\bUPDATE\b|\bDELETE\b|\.execute\(",
    "db_read": r"\.find\(|\.findOne\(|\.get\(|\.query\(|\.fetch\(|\.where\(|\.select\(|\bSELECT\b|\.all\(|\.first\(|\.count\(",
    "external_api": r"\bfetch\(|axios\.|requests\.\w+\(|http\.\w+\(|urllib\.|curl_|Guzzle|HttpClient|\.post\(|\.put\(|\.patch\(",
    "file_io": r"\bopen\(|readFile|writeFile|\bfs\.|fopen|file_put|file_get|Path\(.*\)\.(?:read|write)",
    "state_mutate": r"setState|\.commit\(|\.dispatch\(|this\.\w+\s*=|self\.\w+\s*=",
}

# Lower-case words of which an ASCII text must hold at least one before the effect's pattern can match.
EFFECT_WORDS = {
    "db_write": [".save(", ".create(", "update", "delete", ".destroy(", "insert", ".upsert(", ".execute("],
    "db_read": [".find(", ".findone(", ".get(", ".query(", ".fetch(", ".where(", "select", ".all(", ".first(", ".count("],
    "external_api": ["fetch(", "axios.", "requests.", "http.", "urllib.", "curl_", "guzzle", "httpclient", ".post(", ".put(", ".patch("],
    "file_io": ["open", "readfile", "writefile", "fs.", "file_put", "file_get", "path("],
    "state_mutate": ["setstate", ".commit(", ".dispatch(", "this.", "self."],
}

DOMAIN_KEYWORDS = {
    "payment": ["payment", "charge", "invoice", "stripe", "billing", "price", "cart", "refund", "checkout", "order"],
    "auth": ["auth", "login", "logout", "token", "session", "password", "jwt", "oauth", "credential", "permission"],
    "user": ["user", "profile", "account", "register", "signup", "member"],
    "email": ["email", "mail", "smtp", "notification", "subscribe"],
    "storage": ["upload", "download", "s3", "bucket", "blob", "attachment"],
    "search": ["search", "filter", "elastic", "solr", "algolia"],
    "admin": ["admin", "dashboard", "manage", "role", "backoffice"],
}

ROLE_PATTERNS = {
    "entry_point": r"Controller|Handler|Route|Endpoint|Command|CLI|Servlet|Resource|View",
    "orchestrator": r"Service|Manager|Processor|UseCase|Interactor|Facade|Coordinator",
    "validator": r"Validator|Guard|Middleware|Filter|Policy|Sanitizer",
    "data_access": r"Repository|Repo|DAO|Model|Store|Gateway|Mapper|Entity",
    "adapter": r"Adapter|Client|Provider|Connector|Driver|Wrapper",
}

CONTROL_PATTERNS = {
    "branching": r"\bif\b|\bswitch\b|\bcase\b|\bmatch\b",
    "loop": r"\bfor\b|\bwhile\b|\bforeach\b|\.map\(|\.forEach\(|\.each\b",
    "try_catch": r"(?s)\btry\b.*\bcatch\b|\btry\b.*\bexcept\b|\bfinally\b",
    "async": r"\basync\b|\bawait\b|\.then\(|\bPromise\b|\bFuture\b|\bTask\b",
}
# Words of which a text must hold at least one before the pattern can match, as they are written.
CONTROL_WORDS = {
    "branching": ["if", "switch", "case", "match"],
    "loop": ["for", "while", ".map(", ".each"],
    "async": ["async", "await", ".then(", "Promise", "Future", "Task"],
}
# The same test for the JVM engine in one linear pass: the first "try" is taken once.
TRY_CATCH_JVM = r"(?s)\A(?>.*?\btry\b).*\b(?:catch|except)\b"
FINALLY_JVM = r"\bfinally\b"

ENTITY_PATTERN = r"(\w+)::\w+\(|(\w+)->(?:save|create|update|delete|find|where)"
ENTITY_WORDS = ["::", "->"]
ENTITY_ALIASES = {
    "stripegateway": "stripe", "stripeclient": "stripe", "stripe_service": "stripe",
    "txn": "transactions", "transaction": "transactions",
    "usr": "users", "user_model": "users",
}

API_SERVICES = ["stripe", "twilio", "sendgrid", "paypal", "aws", "redis", "rabbitmq", "kafka"]
IMPORT_SERVICES = ["stripe", "twilio", "sendgrid", "paypal", "redis", "rabbitmq", "kafka", "elasticsearch"]
