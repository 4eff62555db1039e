"""Fixed values.

Word lists, lookup tables, patterns and formats that decide the results; they
must stay exactly as they are for output to be comparable between runs and
with files cleaned elsewhere.
"""

# --- languages -------------------------------------------------------------
SPRING = "spring"
REACT = "react"
DEFAULT_LANG = SPRING
EXTENSIONS = {SPRING: [".java"], REACT: [".tsx", ".ts", ".jsx", ".js"]}
ASSET_EXTENSIONS = [
    ".css", ".scss", ".sass", ".less", ".styl",
    ".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp",
    ".json", ".md", ".txt", ".yaml", ".yml",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp3", ".mp4", ".wav", ".webm",
]
DEFAULT_ALIAS = "@"

# --- module types ----------------------------------------------------------
JAVA_TYPE_WORDS = [
    ("repository", ["repository", "repo", "dao"]),
    ("service", ["service"]),
    ("controller", ["controller", "rest", "resource"]),
    ("enum", ["enum"]),
    ("util", ["util", "helper", "config"]),
]
JAVA_TYPE_DEFAULT = "model"
REACT_SEGMENTS = {
    "hook": ["hooks"],
    "types": ["types", "interfaces", "models"],
    "api": ["api", "apis", "services", "clients"],
    "util": ["utils", "util", "helpers", "lib"],
    "component": ["components"],
}
REACT_CONTEXT_WORDS = ["context", "provider"]
TYPE_ORDER = {
    SPRING: ["controller", "service", "model", "repository", "util", "enum"],
    REACT: ["component", "hook", "context", "api", "types", "util", "module"],
}
TYPE_LABELS = {
    SPRING: {
        "controller": "Controllers / entry points",
        "service": "Services",
        "model": "Domain models",
        "repository": "Repository interfaces (interface only — no impl)",
        "util": "Utilities / helpers",
        "enum": "Enums / constants",
    },
    REACT: {
        "component": "Components",
        "hook": "Hooks",
        "context": "Contexts / providers",
        "api": "API / service clients",
        "types": "Types / interfaces",
        "util": "Utilities / helpers",
        "module": "Other modules",
    },
}

# --- number forms ----------------------------------------------------------
IRREGULAR_PLURALS = {
    "child": "children", "person": "people", "status": "statuses",
    "index": "indices", "matrix": "matrices", "analysis": "analyses",
    "criterion": "criteria", "datum": "data",
}

# --- character classes (what str.strip, \s and \w cover in Unicode text) ----
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[ \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

# --- source text patterns (JVM regex) ---------------------------------------
JAVA_IMPORT = r"(?dm)^import" + SPACE + r"+(?:static" + SPACE + r"+)?([a-zA-Z0-9_.]+);"
JAVA_PACKAGE = r"(?dm)^package" + SPACE + r"+([a-zA-Z0-9_.]+);"
JAVA_CLASS = (
    r"(?:public" + SPACE + r"+)?(?:class|interface|enum|@interface)" + SPACE + r"+(" + WORD + r"+)"
)
REACT_IMPORTS = [
    r"(?dm)^[ \t]*import" + SPACE + r"+(?:type" + SPACE + r"+)?"
    r"(?:[^'\";]*?" + NOT_AFTER_WORD + r"from" + SPACE + r"*)?['\"]([^'\"\n]+)['\"]",
    r"(?dm)^[ \t]*export" + SPACE + r"+(?:type" + SPACE + r"+)?"
    r"[^'\";]*?" + NOT_AFTER_WORD + r"from" + SPACE + r"*['\"]([^'\"\n]+)['\"]",
    NOT_AFTER_WORD + r"(?:require|import)\(" + SPACE + r"*['\"]([^'\"\n]+)['\"]" + SPACE + r"*\)",
]
JSX_ELEMENT = r"<[A-Z][A-Za-z0-9]*(?:" + SPACE + r"|[/>])"
API_CALL = NOT_AFTER_WORD + r"(?:axios|fetch)" + SPACE + r"*[.(]"
HOOK_STEM = r"^use[A-Z]"

JAVA_STRING = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"'
JAVA_COMMENT_OR_STRING = r'(?s)("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+")|/\*.*?\*/|//[^\n]*+'
JSX_COMMENT = r"(?s)\{" + SPACE + r"*/\*.*?\*/" + SPACE + r"*\}"
BLANK_LINES = r"\n{3,}"
LINE_END_BLANKS = r"(?<![ \t])[ \t]++\n"
DOC_TAGS = r"(?iu)@(?:author|since|version|see)" + NOT_BEFORE_WORD + r"[^\n]*"
JAVA_LOGGER = r"[ \t]*log\.(?:debug|info|warn|error|trace)\([^;]+\);\n?"
REACT_LOGGER = r"[ \t]*console\.(?:log|info|warn|error|debug|trace)\([^;\n]*\);?\n?"
SPECIFIER_CONTEXT = (
    r"(?:" + NOT_AFTER_WORD + r"(?:from|import)" + SPACE + r"*"
    r"|" + NOT_AFTER_WORD + r"(?:require|import)" + SPACE + r"*\(" + SPACE + r"*)\z"
)
CODE_TAIL_CHARS = 200

# --- literal tokens ----------------------------------------------------------
TOKEN_PREFIX = "STR"
QUOTED_TOKEN = r"([\"'`])STR_(\p{Nd}+)\1"
BARE_TOKEN = NOT_AFTER_WORD + r"STR_\p{Nd}+" + NOT_BEFORE_WORD
TOKEN_NUMBER = r"^STR_(\p{Nd}+)$"

# --- rename shapes (what must stand around a literal) ------------------------
SHAPES = {
    "package": (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"),
    "upper_prefix": ("", r"(?=_[A-Z])"),
    "standalone": (r"(?<![a-zA-Z0-9_])", r"(?![a-zA-Z0-9])"),
    "pascal_prefix": ("", r"(?=[A-Z])"),
    "pascal_suffix": (r"(?<=[a-z])", ""),
    "camel_prefix": ("", r"(?=[A-Z])"),
}
ESCAPED_CHARS = "()[]{}?*+-|^$\\.&~# \t\n\r\x0b\x0c"

# --- stored formats -----------------------------------------------------------
MAPPING_VERSION = 2
MAPPING_JSON_SCHEMA = (
    "version INT, language STRING, "
    "package ARRAY<STRUCT<`from`: STRING, `to`: STRING>>, "
    "variable ARRAY<STRUCT<`from`: STRING, `to`: STRING>>, "
    "strings MAP<STRING, STRING>"
)

# --- bundle text --------------------------------------------------------------
BUNDLE_HEAD = {
    SPRING: (
        "I have a Spring Boot service I need unit tests for.\n\n"
        "Please generate comprehensive JUnit 5 unit tests using Mockito.\n\n"
        "Requirements:\n"
        "- Use @ExtendWith(MockitoExtension.class) — no @SpringBootTest\n"
        "- Cover: happy path, edge cases, null/empty inputs, exception scenarios\n"
        "- Use AssertJ assertions (assertThat)\n"
        "- Mock all dependencies: "
    ),
    REACT: (
        "I have a React component/module I need unit tests for.\n\n"
        "Please generate comprehensive unit tests using {framework} and React Testing Library.\n\n"
        "Requirements:\n"
        "- Use @testing-library/react and @testing-library/user-event\n"
        "- Mock dependency modules with {mock}: "
    ),
}
BUNDLE_TAIL = {
    SPRING: (
        "\n- Do not assume any Spring context or infrastructure is running\n\n"
        "Here are the sanitized source files:\n\n"
        "[paste the contents of each extracted file below this line]\n"
    ),
    REACT: (
        "\n- Cover: rendering, user interaction, edge cases, and async/API error paths\n"
        "- No real network calls — mock api/service modules directly\n"
        "- Avoid snapshot-only tests; assert on visible behavior\n\n"
        "Here are the sanitized source files:\n\n"
        "[paste the contents of each extracted file below this line]\n"
    ),
}
BUNDLE_EMPTY = {SPRING: "[see classes below]", REACT: "[see modules below]"}
BUNDLE_EXCLUDED_TYPE = {SPRING: "controller", REACT: "component"}
TEST_FRAMEWORKS = {"jest": ("Jest", "jest.mock"), "vitest": ("Vitest", "vi.mock")}
