"""Symbol, import and export patterns per language.

Each pattern is written for a leftmost-first regex engine without look-around.
``jvm`` holds a form of the same pattern that the JVM engine runs without deep
recursion or quadratic scans; where it is absent the plain form is used.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: str
    name: int = 1          # group with the symbol name
    params: int = 0        # group with the parameter text, 0 = none
    bases: int = 0         # group with the base list, 0 = none
    groups: int = 1        # number of groups (imports read all of them)
    jvm: str = ""

    @property
    def spark_pattern(self):
        return self.jvm or self.pattern


# Patterns and control keywords that decide which rows exist.
CONTROL_WORDS = ["if", "for", "while", "switch", "catch", "return"]

FUNCTION_RULES = {
    "javascript": [
        Rule(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", params=2),
        Rule(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"),
        Rule(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function"),
    ],
    "java": [
        Rule(r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*\{",
             params=2,
             jvm=r"(?:(?<!\s)\s++|public|private|protected|static)(?:\s++|public|private|protected|static)*[\w<>\[\]]+\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*\{"),
    ],
    "go": [Rule(r"func\s+(?:\(\w+\s+\*?(\w+)\)\s+)?(\w+)\s*\(([^)]*)\)", name=2, params=3)],
    "rust": [Rule(r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)", params=2)],
    "ruby": [Rule(r"def\s+(?:self\.)?(\w+)(?:\(([^)]*)\))?", params=2)],
    "php": [
        Rule(r"(?:public|private|protected|static|\s)*function\s+(\w+)\s*\(([^)]*)\)",
             params=2,
             jvm=r"(?:(?:(?<!\s)\s++|public|private|protected|static)(?:\s++|public|private|protected|static)*+)?function\s+(\w+)\s*\(([^)]*)\)"),
    ],
    "csharp": [
        Rule(r"(?:public|private|protected|internal|static|async|virtual|override|\s)+[\w<>\[\]?]+\s+(\w+)\s*\(([^)]*)\)\s*\{",
             params=2,
             jvm=r"(?:(?<!\s)\s++|public|private|protected|internal|static|async|virtual|override)(?:\s++|public|private|protected|internal|static|async|virtual|override)*[\w<>\[\]?]+\s+(\w+)\s*\(([^)]*)\)\s*\{"),
    ],
    "kotlin": [Rule(r"(?:fun|suspend\s+fun)\s+(?:<[^>]*>\s+)?(\w+)\s*\(([^)]*)\)", params=2)],
    "swift": [Rule(r"func\s+(\w+)\s*\(([^)]*)\)", params=2)],
}

CLASS_RULES = {
    "javascript": [Rule(r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?", bases=2)],
    "java": [Rule(r"(?:public\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?", bases=2)],
    "go": [Rule(r"type\s+(\w+)\s+struct\s*\{"), Rule(r"type\s+(\w+)\s+interface\s*\{")],
    "rust": [Rule(r"(?:pub\s+)?struct\s+(\w+)"), Rule(r"(?:pub\s+)?enum\s+(\w+)"), Rule(r"(?:pub\s+)?trait\s+(\w+)")],
    "ruby": [Rule(r"class\s+(\w+)(?:\s*<\s*(\w+))?", bases=2), Rule(r"module\s+(\w+)")],
    "php": [Rule(r"(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?", bases=2)],
    "csharp": [Rule(r"(?:public\s+)?(?:abstract\s+)?(?:partial\s+)?(?:class|interface|struct|enum|record)\s+(\w+)(?:\s*:\s*([\w,\s<>]+))?", bases=2)],
    "kotlin": [Rule(r"(?:data\s+|sealed\s+|abstract\s+|open\s+)?class\s+(\w+)"), Rule(r"(?:fun\s+)?interface\s+(\w+)"), Rule(r"object\s+(\w+)")],
    "swift": [Rule(r"(?:class|struct|protocol|enum)\s+(\w+)(?:\s*:\s*([\w,\s]+))?", bases=2)],
}

IMPORT_RULES = {
    "javascript": [
        Rule(r"import\s+(?:\{([^}]+)\}|(\w+))\s+from\s+['\"]([^'\"]+)['\"]", groups=3),
        Rule(r"import\s+['\"]([^'\"]+)['\"]"),
        Rule(r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*require\(['\"]([^'\"]+)['\"]\)", groups=3),
    ],
    "java": [Rule(r"import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;")],
    "go": [Rule(r"\"([\w./\-]+)\"")],
    "rust": [Rule(r"use\s+([\w:]+)(?:::\{([^}]+)\})?;", groups=2)],
    "ruby": [Rule(r"require\s+['\"]([^'\"]+)['\"]"), Rule(r"require_relative\s+['\"]([^'\"]+)['\"]")],
    "php": [Rule(r"use\s+([\w\\]+)(?:\s+as\s+(\w+))?;", groups=2),
            Rule(r"(?:require|include)(?:_once)?\s+['\"]([^'\"]+)['\"]")],
    "csharp": [Rule(r"using\s+(?:static\s+)?([\w.]+);")],
    "kotlin": [Rule(r"import\s+([\w.]+)")],
    "swift": [Rule(r"import\s+(\w+)")],
}

EXPORT_RULES = {
    "javascript": [
        Rule(r"export\s+(?:default\s+)?(?:class|function|const|let|var|async)\s+(\w+)"),
        Rule(r"export\s+\{([^}]+)\}"),
    ],
}

for _family in (FUNCTION_RULES, CLASS_RULES, IMPORT_RULES, EXPORT_RULES):
    _family["typescript"] = _family["javascript"]

CALL_TOKEN = r"\b(\w+)\s*\("
