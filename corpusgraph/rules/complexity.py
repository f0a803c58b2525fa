"""Fixed values of complexity scoring, and the rule book that users may extend."""

from dataclasses import dataclass, field, replace

# ``^\s*`` of the python rule, written for the JVM so that it never crosses a line.
PYTHON_BRANCH_JVM = r"(?m)^[^\S\n]*+(?:if |elif |else:|for |while |except |with |try:|finally:|match |case )"

BRANCHES = {
    "python": r"(?m)^\s*(?:if |elif |else:|for |while |except |with |try:|finally:|match |case )",
    "javascript": r"(?:(?:if|else if|else|for|while|do|switch|case|catch|finally)\s*[\(\{]|=>|\?\?|\?\.|[^\s?]\s*\?\s*[^\s?.:>])",
    "typescript": r"(?:(?:if|else if|else|for|while|do|switch|case|catch|finally)\s*[\(\{]|=>|\?\?|\?\.|[^\s?]\s*\?\s*[^\s?.:>]|(?:as|is|satisfies)\s)",
    "java": r"(?:(?:if|else if|else|for|while|do|switch|case|catch|finally|throw)\s*[\(\{]|instanceof|\?)",
    "kotlin": r"(?:(?:if|else if|else|for|while|do|when|catch|finally|throw)\s*[\(\{]|\?[.:]|!!|is\s)",
    "swift": r"(?:(?:if|else if|else|for|while|repeat|switch|case|catch|guard|throw)\s*[\(\{]|\?\.|try[?!])",
    "go": r"(?:(?:if|else if|else|for|switch|case|select|defer|go)\s+|:=)",
    "rust": r"(?:(?:if|else if|else|for|while|loop|match|=>)\s*[\(\{]|\?|unwrap\(|expect\()",
    "c": r"(?:(?:if|else if|else|for|while|do|switch|case|goto)\s*[\(\{]|\?)",
    "cpp": r"(?:(?:if|else if|else|for|while|do|switch|case|catch|throw|try)\s*[\(\{]|\?|dynamic_cast|static_cast)",
    "csharp": r"(?:(?:if|else if|else|for|foreach|while|do|switch|case|catch|finally|throw|try)\s*[\(\{]|\?\?|\?\.|\bis\s|\bwhen\s)",
    "ruby": r"(?:(?:if|elsif|else|unless|case|when|while|until|for|begin|rescue|ensure|raise)\s+|\.each|\.map|\.select|\.reject)",
    "php": r"(?:(?:if|elseif|else|for|foreach|while|do|switch|case|catch|finally|throw|try|match)\s*[\(\{]|\?\?|\?->|\?:)",
    "scala": r"(?:(?:if|else if|else|for|while|match|case|catch|finally|throw|try)\s*[\(\{]|=>)",
    "lua": r"(?:(?:if|elseif|else|for|while|repeat|until)\s+)",
    "shell": r"(?:(?:if|elif|else|fi|for|while|until|case|esac|then|do|done)\s+|\|\||&&)",
}

HINTS = {
    "django": r"(?:from django|import django|models\.Model|views\.View)",
    "express": r"(?:require\([\"']express|from\s+[\"']express|app\.listen)",
    "laravel": r"(?:use Illuminate|namespace App\\|Eloquent|Artisan)",
    "php5": r"(?:mysql_connect|mysql_query|ereg\(|create_function|global\s+\$|\$GLOBALS)",
    "rails": r"(?:class \w+ < Application|ActiveRecord|ActionController)",
    "react": r"(?:import.*react|from\s+[\"']react|useState|useEffect|jsx)",
    "spring": r"(?:@Controller|@Service|@Repository|@SpringBoot|import org\.springframework)",
    "stimulus": r"(?:import\s+.*Controller.*stimulus|extends\s+Controller|static\s+targets\s*=|data-controller)",
    "symfony": r"(?:use Symfony\\|namespace\s+\w+\\Bundle|use Doctrine\\|extends\s+(?:Controller|AbstractType|Command))",
    "typescript_types": r"(?:type\s+\w+\s*<|interface\s+\w+\s*<|extends\s+.*\?.*:|infer\s+\w+|keyof\s+)",
}

# Lower-case words of which a text must hold at least one before its hint can match.
HINT_WORDS = {
    "django": ["django", "models.model", "views.view"],
    "express": ["express", "app.listen"],
    "laravel": ["illuminate", "namespace app", "eloquent", "artisan"],
    "php5": ["mysql_", "ereg(", "create_function", "global"],
    "rails": ["application", "activerecord", "actioncontroller"],
    "react": ["react", "usestate", "useeffect", "jsx"],
    "spring": ["@controller", "@service", "@repository", "springboot", "springframework"],
    "stimulus": ["controller", "targets"],
    "symfony": ["symfony", "bundle", "doctrine", "extends"],
    "typescript_types": ["type", "interface", "extends", "infer", "keyof"],
}

FRAMEWORKS = {
    "django": [
        (r"class\s+\w+\(.*(?:View|ModelAdmin|Serializer|Form|Model)\)", 0.5),
        (r"(?:filter|exclude|annotate|aggregate)\(.*Q\(", 2.0),
    ],
    "express": [
        (r"(?:app|router)\.\s*(?:get|post|put|delete|use)\(", 0.3),
        (r"(?:async|await)\s", 0.3),
    ],
    "laravel": [
        (r"(?:whereHas|with|whereIn|orWhere)\(", 1.0),
        (r"(?:Facade|Pipeline|Middleware)", 0.5),
    ],
    "php5": [
        (r"(?:global\s+\$|GLOBALS\[)", 2.0),
        (r"(?:__call|__callStatic|__get|__set|__isset|__unset)\s*\(", 1.5),
        (r"(?:__toString|__invoke|__clone)\s*\(", 0.8),
        (r"(?:eval\s*\(|create_function\s*\()", 2.5),
        (r"(?:extract\s*\(|compact\s*\()", 1.5),
        (r"(?:mysql_|ereg|eregi|split\()", 1.0),
        (r"(?:\$this\s*->\s*\$|->\{\$|\$\$)", 1.5),
        (r"(?:@\s*(?:mysql_|file_|fopen|include|require))", 1.0),
        (r"(?:(?:include|require)(?:_once)?\s+\$)", 1.5),
        (r"(?:array_walk|array_map|array_filter|usort)\(.*function\s*\(", 0.8),
    ],
    "rails": [
        (r"(?:has_many|belongs_to|has_one|scope|validates)", 0.3),
        (r"(?:includes|joins|where|group|having)\(.*\)\.\w+\(", 1.5),
    ],
    "react": [
        (r"useState|useEffect|useCallback|useMemo|useRef|useReducer|useContext", 0.5),
        (r"useEffect\([^)]*\[.*\]", 1.5),
    ],
    "spring": [
        (r"@(?:Transactional|Async|Scheduled|Retryable)", 1.0),
        (r"@(?:GetMapping|PostMapping|RequestMapping)", 0.3),
    ],
    "stimulus": [
        (r"static\s+targets\s*=\s*\[", 0.3),
        (r"static\s+values\s*=\s*\{", 0.5),
        (r"static\s+outlets\s*=\s*\[", 1.5),
        (r"(?:connect|disconnect|initialize)\s*\(\)", 0.3),
        (r"this\.\w+Outlet(?:s|Element)?", 1.2),
        (r"this\.(?:dispatch|application\.getControllerForElementAndIdentifier)", 1.5),
        (r"(?:\w+TargetConnected|\w+TargetDisconnected)\s*\(", 1.0),
        (r"(?:\w+ValueChanged)\s*\(", 0.8),
        (r"this\.element\.querySelector", 0.5),
    ],
    "symfony": [
        (r"(?:->get\(|->getContainer\(\))", 1.2),
        (r"(?:->getDoctrine|->getEntityManager|->getRepository)\(", 0.5),
        (r"(?:createQueryBuilder|createQuery|DQL|->select\(|->from\(|->join\()", 1.5),
        (r"(?:@ORM\\|@Assert\\|@Route)", 0.3),
        (r"(?:EventSubscriberInterface|getSubscribedEvents)", 1.5),
        (r"(?:CompilerPassInterface|process\(\s*ContainerBuilder)", 2.0),
        (r"(?:FormBuilderInterface|buildForm|addEventListener)", 1.0),
        (r"(?:VoterInterface|vote\(|ACCESS_GRANTED)", 1.2),
        (r"(?:prePersist|postPersist|preUpdate|postUpdate|onFlush)", 1.0),
        (r"(?:ParamConverter|@ParamConverter)", 0.5),
    ],
    "typescript_types": [
        (r"(?:extends\s+.*\?\s*.*:)", 2.0),
        (r"(?:infer\s+\w+)", 2.0),
        (r"(?:keyof\s+|in\s+keyof)", 1.0),
        (r"(?:\[.*\s+in\s+.*\]\s*:)", 1.5),
        (r"(?:Partial|Required|Readonly|Pick|Omit|Record|Exclude|Extract|NonNullable|ReturnType|Parameters)<", 0.3),
        (r"(?:type\s+\w+\s*<[^>]*,[^>]*,[^>]*>)", 1.5),
        (r"(?:as\s+const|satisfies\s+)", 0.5),
        (r"(?:\)\s*:\s*\w+\s+is\s+\w+)", 0.8),
        (r"(?:declare\s+(?:module|global|namespace))", 1.0),
        (r"(?:&\s*\{|\{\s*\[)", 0.8),
    ],
}

INDENT_LANGUAGES = {"python": 4, "ruby": 2, "lua": 2, "shell": 2}
TYPED_LANGUAGES = ["java", "kotlin", "csharp", "swift", "go", "rust", "c", "cpp", "scala"]
PYTHON_SIGNATURE = r"def \w+\(([^)]*)\)"
TYPED_SIGNATURE = r"(?i)(?:func|fun|fn|def|void|int|string|bool|var)\s+\w+\s*\(([^)]*)\)"
OTHER_SIGNATURE = r"function\s*\w*\s*\(([^)]*)\)"
DEFINED_NAME = r"(?:def|function|func|fn)\s+(\w+)"
CALLBACK = r"(?:=>|function\s*\()"
TERNARY = r"\?[^?].*:"

NESTING_POWER, SIZE_WEIGHT, RECURSION, CALLBACK_WEIGHT, TERNARY_WEIGHT, PARAM_WEIGHT = 1.5, 0.8, 2.0, 1.5, 0.5, 0.8
FREE_CALLBACKS, FREE_PARAMS = 2, 3
SCORE_SIMPLE, SCORE_MODERATE = 8, 22
LINES_SIMPLE, LINES_MODERATE = 30, 150


@dataclass(frozen=True)
class RuleBook:
    """Branch rules by language, framework rules and hints by framework."""

    branches: dict = field(default_factory=lambda: dict(BRANCHES))
    frameworks: dict = field(default_factory=lambda: dict(FRAMEWORKS))
    hints: dict = field(default_factory=lambda: dict(HINTS))

    def extend(self, branches=None, frameworks=None, hints=None):
        """A new book in which the given rows replace rows of the same key."""
        return replace(
            self,
            branches={**self.branches, **(branches or {})},
            frameworks={**self.frameworks, **(frameworks or {})},
            hints={**self.hints, **(hints or {})},
        )


DEFAULT_RULES = RuleBook()
