"""Fixed values that results depend on: limits, word lists and patterns."""

# Engine defaults and limits.
MIN_TOKENS, MIN_LINES, MAX_INDEXED_FILES = 40, 5, 10_000
LIMITS = {"minTokens": (10, 10_000), "minLines": (1, 1_000), "maxIndexedFiles": (1, 1_000_000)}
MAX_SELF_OCCURRENCES, MAX_DIFF_DISTANCE = 128, 1000
MAX_FILE_BYTES, GENERATED_HEADER_CHARS = 102_400, 2048
CHECK_BUDGET_MS, MAX_BEFORE_BYTES, MAX_PENDING_BEFORES = 1500, 102_400, 64
MAX_INLINE_MATCHES, MAX_INLINE_BYTES, SNIPPET_LINES, SNIPPET_LINE_CHARS, SNIPPET_MAX_FILE_BYTES = 4, 8192, 8, 200, 1 << 20
SEPARATOR = 0

# Formats that aren't code.
NON_CODE_FORMATS = """abnf apacheconf arff asciidoc bnf comments csp csv diff dns-zone-file dot ebnf editorconfig excel-formula gedcom
gettext git hpkp hsts http ignore ini json json5 keymap latex log markdown mermaid nginx plant-uml properties regex rest roboconf
shell-session sparql tap textile toml turtle txt uri url wiki yaml""".split()
NON_CODE_MARKUP_EXTS = ["svg", "xml", "xsl", "xslt"]
BLOCK_FORMATS = ["vue", "astro", "svelte", "markdown"]

#: Extensions by format; the usual public associations.
FORMAT_EXTENSIONS = {
    "bash": "sh bash zsh ksh", "c": "c h", "clojure": "clj cljs cljc", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs csx", "css": "css", "csv": "csv", "dart": "dart",
    "diff": "diff patch", "elixir": "ex exs", "elm": "elm", "erlang": "erl hrl", "fsharp": "fs fsi fsx", "go": "go", "graphql": "graphql gql", "groovy": "groovy gradle",
    "haskell": "hs", "ini": "ini cfg", "java": "java", "javascript": "js cjs mjs es6", "json": "json map", "json5": "json5", "jsx": "jsx", "julia": "jl", "kotlin": "kt kts",
    "latex": "tex", "less": "less", "log": "log", "lua": "lua", "makefile": "mk", "markdown": "md markdown mkd", "markup": "html htm xhtml svg xml xsl xslt", "objectivec": "m mm",
    "perl": "pl pm", "php": "php phtml", "powershell": "ps1 psm1", "properties": "properties", "protobuf": "proto", "python": "py pyw pyi", "r": "r R", "ruby": "rb rake",
    "rust": "rs", "sass": "sass", "scala": "scala sc", "scss": "scss", "sql": "sql", "svelte": "svelte", "swift": "swift", "toml": "toml", "tsx": "tsx", "txt": "txt",
    "typescript": "ts mts cts", "vbnet": "vb", "vue": "vue", "astro": "astro", "yaml": "yaml yml", "zig": "zig",
    "abap": "abap", "actionscript": "as", "ada": "ada adb ads", "apl": "apl", "applescript": "applescript", "asciidoc": "adoc asciidoc", "asm6502": "asm s", "aspnet": "aspx asax", "autohotkey": "ahk",
    "basic": "bas", "batch": "bat cmd", "bicep": "bicep", "bison": "y yy", "brainfuck": "bf", "cmake": "cmake", "cobol": "cob cbl", "coffeescript": "coffee", "crystal": "cr", "d": "d", "django": "jinja jinja2 j2",
    "dot": "dot gv", "ejs": "ejs", "erb": "erb", "fortran": "f f77 f90 f95", "gherkin": "feature", "glsl": "glsl vert frag", "haml": "haml", "handlebars": "hbs handlebars", "haxe": "hx", "hcl": "tf hcl",
    "http": "http", "icon": "icn", "idris": "idr", "io": "io", "lisp": "lisp cl el", "liquid": "liquid", "livescript": "ls", "matlab": "matlab", "mermaid": "mmd", "nim": "nim nims", "nix": "nix", "nsis": "nsi nsh",
    "ocaml": "ml mli", "pascal": "pas pp dpr", "prolog": "pro prolog", "pug": "pug jade", "puppet": "epp", "purescript": "purs", "qml": "qml", "racket": "rkt", "reason": "re rei", "rest": "rst",
    "sas": "sas", "scheme": "scm ss", "smalltalk": "st", "smarty": "tpl", "solidity": "sol", "sparql": "rq", "stylus": "styl", "systemd": "service", "tcl": "tcl", "textile": "textile", "turtle": "ttl", "twig": "twig",
    "v": "vsh", "vala": "vala", "velocity": "vm", "verilog": "v sv svh", "vhdl": "vhd vhdl", "vim": "vim", "wasm": "wat wast", "wiki": "wiki", "xquery": "xq xquery", 
}

# Directories that are never looked into.
IGNORED_DIRS = """.git .hg .svn node_modules bower_components jspm_packages target dist build out .next .nuxt .svelte-kit .output .turbo
.parcel-cache .cache .angular .expo storybook-static vendor coverage .nyc_output __pycache__ .venv venv .tox .mypy_cache .pytest_cache
.gradle .dart_tool elm-stuff Pods DerivedData .terraform""".split()

# Patterns of lock files, bundles and generated files.
NOISE_PATTERNS = ["*.lock", "*.lockb", "*-lock.json", "*-lock.yaml", "*-lock.yml", "*.lock.json", "*.min.*", "*.bundle.js", "*.map", "*.generated.*", "*.designer.cs", "*.designer.vb", ".DS_Store"]

# Marks of generated content, and where comments begin and end.
GENERATED_MARKER = r"(?i)@generated\b|\bauto-?generated\b|\bautomatically generated\b|\bGENERATED BY\b|\bDO NOT (?:EDIT|MODIFY)\b|<auto-?generated\b"
LINE_COMMENT = r"^(?://|\*|#|--|;|%)"
BLOCK_COMMENTS = [("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->"), ("(*", "*)")]

# Names of test directories.
TEST_DIRECTORIES = """tests testing __test__ __tests__ spec specs __spec__ __specs__ __mocks__ __fixtures__ __snapshots__ fixtures fixture
mocks mock snapshots snapshot stubs fakes testdata test_data test-data testfixtures test_fixtures test-fixtures testsuite testsuites
test_suite test-suite testutils test_utils test-utils testhelpers test_helpers test-helpers unittest unittests unit_tests unit-tests
unit_test unit-test integration_tests integration-tests integration_test integration-test functional_tests functional-tests
functional_test functional-test system_tests system-tests systemtest systemtests uitests ui_tests ui-tests e2e e2e-tests e2e_tests
cypress playwright testthat benches benchmarks bdd cucumber step_definitions wiremock contract_tests contract-tests smoke_tests
smoke-tests acceptance_tests acceptance-tests googletest gtest catch2 doctest testcontainers""".split()

# Paths of test trees.
TEST_PATHS = [
    r"(?i)(?:^|/)src/(?:test|it|androidTest|integrationTest|functionalTest|testFixtures|testDebug|testRelease)(?:/|$)",
    r"(?i)(?:^|/)[^/]+\.(?:tests|test|unittests|unittest|integrationtests|integrationtest|specs|spec|functionaltests)(?:/|$)",
    r"(?:^|/)[^/]+(?:Tests|UITests|UnitTests)(?:/|$)",
    r"(?i)(?:^|/)(?:tests?|specs?|testing|test_suite|test_data|testdata|fixtures|mocks|snapshots|e2e|cypress|playwright|googletest|gtest|catch2|doctest)/",
]
NOT_TESTS = r"(?i)^(?:at?test(?:ation|ing|ed|s)?|contest(?:ant|ants|ed|ing|s)?|detest(?:able|ed|ing|s)?|protest(?:er|ers|ed|ing|s)?|testament(?:ary|s)?|testosterone|testify|fastest|latest|greatest|smartest|shortest|longest|fittest|neatest|sweetest|brightest|hottest|context|contextual|latent|intestine|intestate)$"
TEST_PREFIX = r"(?i)^(?:test[_-]|tests[_-]|test\.|tests\.|runtests\.|conftest\.|setupTests\.|setup-tests\.|setup_tests\.|jest\.setup\.|vitest\.setup\.)"
TEST_PASCAL_PREFIX = r"^(?:Test|TestCase|IT)[A-Z0-9_]"
TEST_SUFFIX = r"(?i)(?:[._-](?:test|tests|spec|specs|cy|e2e|e2e-spec|e2e_spec|integration|unit|unittest|unit_test|integration_test|integration-test|bench|bench_test|benchmark|suite|fixture|fixtures))$"
TEST_PASCAL_SUFFIX = r"^[A-Z][A-Za-z0-9_]*(?:Test|Tests|TestCase|TestCases|IT|ITCase|Spec|Specs|Benchmark|Benchmarks)$"
TEST_EXTENSIONS = [".bats", ".snap", ".snapshot"]

# File names of test helpers.
TEST_HELPERS = """test_helper.rb spec_helper.rb rails_helper.rb test_helper.go test_helpers.go test_utils.py test_util.py test-utils.ts
test-utils.js test-utils.tsx test-utils.jsx testutils.ts testutils.js testutils.tsx testutils.jsx conftest.py setuptests.ts setuptests.js
setuptests.tsx setuptests.jsx jest.setup.ts jest.setup.js jest.setup.mjs jest.setup.cjs vitest.setup.ts vitest.setup.js vitest.setup.mjs
vitest.setup.cjs test_runner.rb runtests.jl""".split()

# Names of tools that change no file.
READ_ONLY_EVENTS = "read grep glob find ast_grep lsp web_search ask wait todo think yield goal advise checkpoint rewind context_notes recall".split()

# Names of configuration files, in the order in which they are looked up.
CONFIG_FILES = [".jscpd.json", ".jscpd.rc.json", ".jscpd.rc", ".jscpd.rc.yaml", ".jscpd.rc.yml", ".jscpd.yaml", ".jscpd.yml", ".config/.jscpd.json", ".config/jscpd.json", "package.json"]
GIT_REDIRECTS = ["GIT_DIR", "GIT_WORK_TREE", "GIT_INDEX_FILE", "GIT_COMMON_DIR", "GIT_PREFIX", "GIT_NAMESPACE"]
