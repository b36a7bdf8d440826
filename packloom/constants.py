"""Fixed values. They decide results, so they are stated plainly and must not be changed."""

# --- fixed values: names, extensions ------------------------------------------------------------
IGNORE_FILE = ".gitignore"
IGNORED_NAMES = [".git", "node_modules", "build", "target", "__pycache__"]

BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "tiff", "ico",
    "mp3", "wav", "ogg", "flac", "aac",
    "mp4", "avi", "mov", "wmv", "mkv",
    "zip", "rar", "7z", "tar", "gz", "bz2",
    "exe", "dll", "so", "dylib", "app",
    "o", "obj", "lib", "a",
    "class", "pyc",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "jar", "war", "ear",
    "woff", "woff2", "ttf", "otf", "eot",
    "db", "sqlite", "mdb",
    "iso", "img", "swf",
]

# --- fixed values: header line per extension or file name ----------------------------------------
DEFAULT_HEADER = "// filename: "
HTML_HEADER = "<!-- filename: -->"
CSS_HEADER = "/* filename: */"
HEADER_KEYS = {
    "// filename: ": [
        "c", "cpp", "cs", "java", "js", "ts", "tsx", "jsx", "go", "swift", "kt", "kts",
        "scala", "dart", "rs", "php", "groovy", "gradle",
    ],
    "# filename: ": [
        "py", "rb", "pl", "sh", "bash", "zsh", "fish", "yaml", "yml", "toml", "r", "perl",
        "tcl", "Dockerfile", "makefile", "Makefile",
    ],
    "<!-- filename: -->": ["html", "htm", "xml", "svg", "xhtml", "jsp", "asp", "aspx"],
    "-- filename: ": ["sql", "hs", "lua"],
    ";; filename: ": ["lisp", "clj", "cljs", "el"],
    "REM filename: ": ["bat", "cmd"],
    "' filename: ": ["vb", "vbs"],
    "; filename: ": ["asm", "s"],
    "! filename: ": ["f", "f90", "f95"],
    "/* filename: */": ["css", "scss", "sass", "less"],
}
HTML_HEADER_PATTERN = r"^\s*<!--\s*filename:\s*.*\s*-->"

# --- fixed values: Markdown fence language per extension or file name ------------------------------
FENCE_HINTS = {
    "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "java": "java",
    "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "go": "go", "rb": "ruby",
    "py": "python", "php": "php", "pl": "perl", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "rs": "rust", "scala": "scala", "groovy": "groovy", "gradle": "gradle",
    "dart": "dart", "r": "r", "sh": "bash", "bash": "bash", "zsh": "bash", "fish": "fish",
    "ps1": "powershell", "bat": "batch", "cmd": "batch", "hs": "haskell", "lua": "lua",
    "sql": "sql", "asm": "asm", "s": "asm", "f": "fortran", "f90": "fortran", "f95": "fortran",
    "lisp": "lisp", "clj": "clojure", "cljs": "clojure", "el": "lisp", "vb": "vb",
    "vbs": "vbscript", "perl": "perl", "tcl": "tcl",
    "html": "html", "htm": "html", "xml": "xml", "svg": "svg", "xhtml": "html", "jsp": "jsp",
    "asp": "asp", "aspx": "aspx", "css": "css", "scss": "scss", "sass": "sass", "less": "less",
    "md": "markdown", "markdown": "markdown", "tex": "latex", "latex": "latex",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "csv": "csv", "tsv": "tsv",
    "ini": "ini", "conf": "conf", "properties": "properties", "prop": "properties", "env": "env",
    "gitignore": "gitignore", "dockerignore": "dockerignore",
    "Dockerfile": "dockerfile", "makefile": "makefile", "Makefile": "makefile",
    "log": "log", "txt": "text",
}

# --- fixed values: languages ------------------------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    "java": "JAVA", "kt": "KOTLIN", "kts": "KOTLIN", "js": "JAVASCRIPT", "mjs": "JAVASCRIPT",
    "ts": "TYPESCRIPT", "jsx": "JSX", "tsx": "TSX", "py": "PYTHON", "html": "HTML", "htm": "HTML",
    "css": "CSS", "scss": "CSS", "sass": "CSS",
}
JVM_LANGUAGES = ["JAVA", "KOTLIN"]
SCRIPT_LANGUAGES = ["JAVASCRIPT", "TYPESCRIPT", "JSX", "TSX"]

# --- fixed values: import patterns (group 1 is the import string) -------------------------------------
IMPORT_PATTERNS = {
    "JVM": [
        r"import\s+(?:static\s+)?([a-zA-Z_][a-zA-Z0-9_.]*)\s*;?",
        r"from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import",
    ],
    "SCRIPT": [
        r"import\s+.*?from\s+['\"]([^'\"]+)['\"]",
        r"import\s+['\"]([^'\"]+)['\"]",
        r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
        r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
        r"export\s+.*?from\s+['\"]([^'\"]+)['\"]",
        r"import\s+['\"]([^'\"]+\.css)['\"]",
        r"import\s+['\"]([^'\"]+\.scss)['\"]",
        r"import\s+['\"]([^'\"]+\.sass)['\"]",
    ],
    "PYTHON": [
        r"from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import",
        r"import\s+([a-zA-Z_][a-zA-Z0-9_.]*(?:\s*,\s*[a-zA-Z_][a-zA-Z0-9_.]*)*?)(?:\s|$)",
    ],
    "HTML": [
        r"<script[^>]+src\s*=\s*['\"]([^'\"]+)['\"]",
        r"<link[^>]+href\s*=\s*['\"]([^'\"]+\.css)['\"]",
        r"\"([^\"]+)\":\s*['\"]([^'\"]+)['\"]",
    ],
    "CSS": [
        r"@import\s+['\"]([^'\"]+)['\"]",
        r"@import\s+url\s*\(\s*['\"]?([^'\"]+)['\"]?\s*\)",
    ],
}
SCRIPT_ROOTS = ["src", "app", "pages", "components", "lib", "utils"]
SCRIPT_RELATIVE_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".json", ".mjs"]
SCRIPT_ROOT_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".json"]
SCRIPT_ALIAS_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx"]
SCRIPT_INDEX_FILES = ["index.js", "index.ts", "index.jsx", "index.tsx"]
JVM_ROOTS = ["src/main/java", "src/main/kotlin", "src", ""]
JVM_EXTENSIONS = [".java", ".kt"]
CSS_EXTENSIONS = [".css", ".scss", ".sass"]

# --- fixed values: dependents search ---------------------------------------------------------------
DEPENDENT_EXTENSIONS = [
    "js", "jsx", "ts", "tsx", "kt", "java", "py", "vue", "svelte", "xml", "yml", "yaml",
]
DEPENDENT_SKIP_DIRS = ["node_modules", ".git", "build", "dist", "target", "out", ".idea"]
DEPENDENT_MAX_BYTES = 500_000
DEPENDENT_CAP = 100
DEPENDENT_EXPAND_LIMIT = 50

# --- fixed values: test names ({} is the source stem, {ext} its extension) --------------------------
TEST_NAMES = {
    "JVM": [
        "{}Test.{ext}", "{}Tests.{ext}", "Test{}.{ext}", "{}Spec.{ext}", "{}IT.{ext}",
        "{}IntegrationTest.{ext}",
    ],
    "SCRIPT": [
        "{}.test.js", "{}.test.ts", "{}.test.jsx", "{}.test.tsx",
        "{}.spec.js", "{}.spec.ts", "{}.spec.jsx", "{}.spec.tsx",
        "{}.js", "{}.ts", "{}.jsx", "{}.tsx",
    ],
    "PYTHON": ["test_{}.py", "{}_test.py", "test{}.py"],
    "HTML": ["{}.test.html", "{}.spec.html"],
    "CSS": ["{}.test.css", "{}.spec.css"],
    "OTHER": ["{}Test.{ext}", "{}Tests.{ext}", "Test{}.{ext}"],
}
EXTENDED_TEST_PATTERNS = [
    "*Test", "*Tests", "Test*", "*TestCase", "*TestSuite", "*Spec", "*Specs", "*IT",
    "*IntegrationTest", "*IntegrationTests", "*IntTest", "*E2ETest", "*E2E", "*EndToEndTest",
    "*PerfTest", "*PerformanceTest", "*LoadTest", "*StressTest", "*Should", "*Feature",
    "*Scenario",
]
TEST_DIR_MARKERS = [
    "/test/", "/tests/", "/spec/", "/specs/", "/__tests__/", "/test_", "_test/",
]
TEST_RESOURCE_DIRS = [
    "test-data", "testdata", "test_data", "fixtures", "fixture", "mocks", "mock",
    "test-resources", "test_resources", "data", "samples", "examples",
]
TEST_UTILITY_PATTERNS = [
    "TestUtil*", "*TestUtil", "*TestUtils", "TestHelper*", "*TestHelper", "MockUtil*",
    "*MockUtil", "TestBase", "BaseTest", "AbstractTest*",
]
TEST_UTILITY_EXTENSIONS = ["java", "kt", "js", "ts", "py"]
TEST_CODE_EXTENSIONS = ["java", "kt", "js", "ts", "py", "rb", "php", "cs", "go"]

# --- fixed values: configuration file names -----------------------------------------------------------
CONFIG_NAMES = {
    "BASE": [
        "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "Cargo.toml",
        "requirements.txt", "pyproject.toml", "setup.py", "composer.json", "Gemfile", "go.mod",
        "CMakeLists.txt", "Dockerfile", "docker-compose.yml", ".env",
    ],
    "SCRIPT": [
        "tsconfig.json", "jsconfig.json", "webpack.config.js", "vite.config.js",
        "vite.config.ts", "next.config.js", "next.config.mjs", "tailwind.config.js",
        "tailwind.config.ts", "jest.config.js", "jest.config.ts", "vitest.config.js",
        "vitest.config.ts", ".eslintrc.js", ".eslintrc.json", ".prettierrc", ".prettierrc.json",
        "rollup.config.js", "esbuild.config.js", "babel.config.js",
    ],
    "JVM": ["application.properties", "application.yml", "application.yaml"],
    "PYTHON": ["setup.cfg", "tox.ini", "pytest.ini", ".python-version"],
    "HTML": ["postcss.config.js", "stylelint.config.js"],
    "CSS": ["postcss.config.js", "stylelint.config.js"],
}

# --- fixed values: resources ------------------------------------------------------------------------
TEMPLATE_EXTENSIONS = ["html", "htm", "jsp", "ftl", "vm", "vue", "hbs", "ejs", "pug", "jade"]
STYLE_EXTENSIONS = ["css", "scss", "sass", "less", "styl", "stylus"]
RESOURCE_EXTENSIONS = TEMPLATE_EXTENSIONS + STYLE_EXTENSIONS + [
    "json", "xml", "yaml", "yml", "properties",
]
SPRING_MARKERS = ["@Controller", "@RestController"]
SPRING_VIEW_PATTERN = r"return\s+[\"']([^\"']+)[\"']"
REACT_MARKERS = ["import React", "from 'react'", 'from "react"', "React.Component"]
VUE_MARKERS = ["Vue.component", "export default {"]
ANGULAR_MARKER = "@Component"
ANGULAR_TEMPLATE_PATTERN = r"templateUrl\s*:\s*['\"]([^'\"]+)['\"]"
ANGULAR_STYLES_PATTERN = r"(?s)styleUrls\s*:\s*\[(.*?)\]"
QUOTED_PATTERN = r"['\"]([^'\"]+)['\"]"
RESOURCE_LITERAL_PATTERN = (
    r"[\"']([^\"']+\.(?:" + "|".join(RESOURCE_EXTENSIONS) + r"))[\"']"
)

# --- fixed values: inheritance in JavaScript and TypeScript ---------------------------------------------
INHERITABLE_PATTERNS = {
    "CLASS": r"(?:export\s+)?(?:abstract\s+)?class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:extends\s+[^{]+)?(?:implements\s+[^{]+)?\s*\{",
    "INTERFACE": r"(?:export\s+)?interface\s+([A-Z][a-zA-Z0-9_]*)\s*(?:extends\s+[^{]+)?\s*\{",
    "REACT_COMPONENT": r"(?:export\s+)?(?:const|function)\s+([A-Z][a-zA-Z0-9_]*)\s*(?:\([^)]*\))?\s*(?::\s*[^=]+)?\s*=?\s*(?:\([^)]*\))?\s*=>",
    "ABSTRACT_CLASS": r"(?:export\s+)?abstract\s+class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:extends\s+[^{]+)?\s*\{",
}

# --- fixed values: stack traces -------------------------------------------------------------------------
FRAME_PATTERN = r"^\s*at\s+([\w$.<>/]+)\.([\w$<>+]+)\(([^)]+?)(?::(\d+))?\)\s*$"
ELLIPSIS_PATTERN = r"^\s*\.{3}\s*\d+\s+more\s*$"
CAUSED_BY_PATTERN = r"^\s*Caused by:\s*.+$"
SUPPRESSED_PATTERN = r"^\s*Suppressed:\s*.+$"
ALWAYS_FOLD_PREFIXES = [
    "java.", "javax.", "kotlin.", "kotlinx.", "scala.", "jdk.", "sun.", "com.sun.",
    "org.junit.", "junit.", "org.testng.", "org.mockito.", "net.bytebuddy.", "jakarta.",
    "reactor.", "io.reactivex.", "io.netty.", "org.apache.", "com.google.", "org.slf4j.",
    "ch.qos.logback.", "com.intellij.rt.", "org.gradle.", "org.jetbrains.",
    "worker.org.gradle.process.", "org.hibernate.", "com.zaxxer.hikari.", "org.postgresql.",
]
NEVER_FOLD_PREFIXES = ["org.springframework.test.context.", "com.mycompany.myapp."]
RAW_TRACE_MARKER = "--- folded above; raw trace below ---"

# A token, approximately: a word, up to three digits, or one other visible character. The library
# counts without building the list; the SQL checks use the pattern.
TOKEN_PATTERN = r"[A-Za-z]+|[0-9]{1,3}|[^ \t\r\n\f\x0BA-Za-z0-9]"

LINE_BREAK = r"\r\n|\n|\r"
