"""What must be equal to the analysed conventions for equal results. Plain text, in natural order.

Regular expressions are in Java's dialect, as Spark runs them; Python's ``re`` accepts all of them too.
"""

# ---- Fixed values: file name extensions of each language, in the order in which they are tried ----
EXTENSIONS = """
python .py .pyx .pxd
typescript .ts .tsx
javascript .js .jsx .mjs .cjs
go .go
rust .rs
java .java
cpp .cpp .cc .cxx .c++ .hpp .hp .hh .hxx .h .h++ .inl
c .c
ruby .rb
shell .sh .bash .zsh
capnp .capnp
"""
MAKEFILES = ("Dockerfile", "Makefile", "Justfile", "CMakeLists.txt")

# ---- Fixed values: names and suffixes that are left out of an index ----
IGNORED = """
.git node_modules __pycache__ .venv venv .tox .mypy_cache .pytest_cache .ruff_cache dist build target .next .nuxt vendor
bower_components .idea .vscode .vs *.min.js *.min.css *.bundle.js *.generated.* *.pb.go *.pb.cc *.pb.h *.capnp.h *.capnp.c++
package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock Gemfile.lock poetry.lock Pipfile.lock .DS_Store Thumbs.db .repo
CMakeFiles CMakeCache.txt cmake-build-* out *.o *.obj *.a *.so *.dylib *.dll *.exe *.pch *.gch *.s *.ii *.i Makefile.in
autom4te.cache config.status config.log
"""
# ---- Fixed values: of these the graph knows all but the following ----
IGNORED_IN_INDEX_ONLY = "CMakeCache.txt out *.pch *.gch *.s *.ii *.i Makefile.in autom4te.cache config.status config.log"

# ---- Fixed values: names that mark entry points and configuration ----
ENTRY_NAMES = """
main.py main.ts main.go main.rs main.cpp main.c main.cc app.py app.ts server.py server.ts server.go index.ts index.js index.tsx
index.jsx cmd/ cmd/main.go src/main/ src/main.cpp __main__.py __init__.py Program.cs Application.java CMakeLists.txt Makefile
configure.ac configure.in
"""
CONFIG_NAMES = """
package.json tsconfig.json pyproject.toml setup.py setup.cfg Cargo.toml go.mod go.sum Makefile CMakeLists.txt Dockerfile
docker-compose.yml .dockerignore .env .env.example .env.local .env.production .gitignore .eslintrc .prettierrc biome.json
next.config.js vite.config.ts webpack.config.js .github/workflows/ .gitlab-ci.yml Jenkinsfile README.md CONTRIBUTING.md CHANGELOG.md
"""

# ---- Fixed values: symbol types that count as exported, that stay first when a file has too many, that open a scope ----
EXPORTED = "class function async_function struct enum trait interface type module method namespace constructor destructor operator concept"
KEPT_FIRST = "class struct interface trait enum module coroutine namespace concept"
CONTAINERS = "class namespace struct"
CALLABLE = "function method coroutine async_function constructor destructor"
SCOPED = "class struct interface namespace"
BRACED = "cpp c java javascript typescript rust go"

# ---- Fixed values: words that are no calls ----
NO_CALLS = """
if for and not or in is def class with elif else try except return raise import from while break pass True False None print len
range int str list dict set tuple type super self cls
"""
# ---- Fixed values: starts of lines that hold neither symbols nor calls; starts that don't end an indented scope ----
SKIPPED_STARTS = ("#", "//", "/*", "*", "'''", '"""')
CONTINUING_STARTS = ("if ", "for ", "while ", "try:", "except", "elif ", "else:", "with ")

# ---- Fixed values: symbols. Each line: language, type, group, pattern; the first that matches a line wins ----
SYMBOLS = r"""
python class 1 ^\s*class\s+(\w+)
python async_function 1 ^\s*async\s+def\s+(\w+)
python function 1 ^\s*def\s+(\w+)
typescript class 1 ^\s*(?:export\s+)?class\s+(\w+)
typescript function 1 ^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)
typescript function 1 ^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(
typescript function 1 ^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*\([^)]*\)\s*=>
typescript interface 1 ^\s*(?:export\s+)?interface\s+(\w+)
typescript type 1 ^\s*(?:export\s+)?type\s+(\w+)
typescript enum 1 ^\s*(?:export\s+)?enum\s+(\w+)
javascript class 1 ^\s*class\s+(\w+)
javascript function 1 ^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)
javascript function 1 ^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(
javascript function 1 ^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*\([^)]*\)\s*=>
go struct 1 ^\s*type\s+(\w+)\s+struct
go interface 1 ^\s*type\s+(\w+)\s+interface
go function 1 ^\s*func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)
go method 2 ^\s*func\s+\(\w+\s+\*?(\w+)\)\s+(\w+)
rust function 1 ^\s*(?:pub\s+)?fn\s+(\w+)
rust struct 1 ^\s*(?:pub\s+)?struct\s+(\w+)
rust enum 1 ^\s*(?:pub\s+)?enum\s+(\w+)
rust trait 1 ^\s*(?:pub\s+)?trait\s+(\w+)
rust impl 1 ^\s*(?:pub\s+)?impl\s+(?:[\w<>,: ]+\s+)?(?:for\s+)?(\w+)
rust module 1 ^\s*(?:pub\s+)?mod\s+(\w+)
rust macro 1 ^\s*macro_rules!\s*(\w+)
java class 1 ^\s*(?:public\s+|private\s+|protected\s+)?class\s+(\w+)
java interface 1 ^\s*(?:public\s+|private\s+|protected\s+)?interface\s+(\w+)
java enum 1 ^\s*(?:public\s+|private\s+|protected\s+)?enum\s+(\w+)
java method 1 ^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*(?:\{|throws)
cpp class 1 ^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?:__declspec\s*\([^)]*\)\s*)?(?:[a-zA-Z_]\w*(?:::))?\s*(\w+)\s*(?:\s*:\s*[^{;]*)?\s*[;{]
cpp enum 1 ^\s*enum\s+(?:class\s+|struct\s+)?(\w+)
cpp namespace 1 ^\s*namespace\s+(\w+)\s*\{
cpp constructor 1 ^\s*(?:\w+(?:::))?\s*(\w+)\s*::\s*\1\s*\([^)]*\)\s*(?:const\s*)?\s*(?:noexcept\s*)?\s*(?::\s*[^{]*)?\s*\{
cpp in_class_constructor 1 ^\s*(\w+)\s*\([^)]*\)\s*(?::\s*[^{]*)?\s*\{
cpp destructor 1 ^\s*(?:\w+(?:::))?\s*~(\w+)\s*\([^)]*\)\s*(?:noexcept\s*)?\s*(?:override\s*)?\s*(?:final\s*)?\s*\{
cpp method 2 ^\s*(?:template\s*<[^>]*>\s*)?(?:virtual\s+|static\s+|inline\s+|explicit\s+|constexpr\s+|consteval\s+)*(?:[\w:]+(?:<[^>]*>)?\s+)+(\w+)\s*::\s*(\w+)\s*\([^)]*\)\s*(?:const\s*)?\s*(?:noexcept\s*)?\s*(?:override\s*)?\s*(?:final\s*)?\s*(?::\s*[^{]*)?\s*\{
cpp method 1 ^\s*(?:virtual\s+|static\s+|inline\s+|explicit\s+|constexpr\s+|consteval\s+)*(?:[\w:]+(?:<[^>]*>)?\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\s*(?:noexcept\s*)?\s*(?:override\s*)?\s*(?:final\s*)?\s*(?::\s*[^{]*)?\s*\{
cpp function 1 ^\s*template\s*<[^>]*>\s*(?:[\w:]+(?:<[^>]*>)?\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\s*(?:noexcept\s*)?\s*\{
cpp function 1 ^\s*(?:virtual\s+|static\s+|inline\s+|explicit\s+|constexpr\s+|consteval\s+)*(?:[\w:]+(?:<[^>]*>)?\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\s*(?:noexcept\s*)?\s*\{
cpp type_alias 1 ^\s*using\s+(\w+)\s*=
cpp typedef 1 ^\s*typedef\s+.+\s+(\w+)\s*;
cpp concept 1 ^\s*template\s*<[^>]*>\s*concept\s+(\w+)\s*=
cpp body_coroutine 1 ^\s*(?:[\w:]+\s+)+(\w+)\s*\([^)]*\)\s*\{[^}]*\bco_(?:await|return|yield)\b
cpp coroutine 1 ^\s*(?:[\w:]+(?:<[^>]*>)?\s+)*(?:[\w:]*task|[\w:]*lazy|[\w:]*generator|[\w:]*async_generator|[\w:]*eager_task|[\w:]*shared_task)\s*<\s*[^>]*>\s*(\w+)\s*\([^)]*\)
cpp stdexec_sender 1 ^\s*(?:[\w:]+\s+)+(?:exec|stdexec)::(\w+)
cpp stdexec_adaptor 1 ^\s*\|\s*(?:exec|stdexec)::(\w+)
c struct 1 ^\s*(?:typedef\s+)?struct\s+(?:__attribute__\s*\([^)]*\)\s*)?(\w+)\s*\{
c enum 1 ^\s*enum\s+(\w+)
c function 1 ^\s*(?:static\s+|inline\s+|__attribute__\s*\([^)]*\)\s*)*(?:[\w*]+\s+)+(\w+)\s*\([^)]*\)\s*(?:\{|__attribute__)
c typedef 1 ^\s*typedef\s+.+\(\s*\*\s*(\w+)\s*\)\s*\([^)]*\)\s*;
c typedef 1 ^\s*typedef\s+.+\s+(\w+)\s*;
ruby class 1 ^\s*class\s+(\w+)
ruby module 1 ^\s*module\s+(\w+)
ruby method 1 ^\s*def\s+(\w+)
shell function 1 ^\s*(?:function\s+)?(\w+)\s*\(\s*\)\s*\{
capnp struct 1 ^\s*struct\s+(\w+)
capnp interface 1 ^\s*interface\s+(\w+)
capnp enum 1 ^\s*enum\s+(\w+)
capnp constant 1 ^\s*const\s+\w+\s*:\w+\s+(\w+)\s*=
capnp annotation 1 ^\s*annotation\s+(\w+)
capnp type_alias 1 ^\s*using\s+(\w+)\s*=
capnp method 1 ^\s*(\w+)\s*@\d+\s*\([^)]*\)\s*(?:->\s*\w+)?\s*;
"""
# ---- Fixed values: kinds that the table above tells apart only because the graph leaves one of them out ----
SAME_TYPE = {"in_class_constructor": "constructor", "body_coroutine": "coroutine"}
NOT_IN_GRAPH = "cpp:in_class_constructor cpp:body_coroutine cpp:stdexec_sender cpp:stdexec_adaptor rust:module rust:macro capnp:method"
# ---- Fixed values: symbols that the graph finds by another pattern ----
GRAPH_SYMBOLS = r"""
python class 1 ^\s*class\s+(\w+)(?:\s*\([^)]*\))?\s*:
typescript class 1 ^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)
typescript type 1 ^\s*(?:export\s+)?type\s+(\w+)\s*=
"""

# ---- Fixed values: imports. Each line: language, groups, pattern; all that match a line count ----
IMPORTS = r"""
python 1,2 ^\s*(?:from\s+(\S+)\s+import|import\s+(\S+))
typescript 1,2 (?:import\s+.*?\s+from\s+['"]([^'"]+)['"]|import\s+['"]([^'"]+)['"])
typescript 1 require\s*\(\s*['"]([^'"]+)['"]
javascript 1,2,3 (?:import\s+.*?\s+from\s+['"]([^'"]+)['"]|import\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"])
go 1 import\s+(?:\(\s*)?(?:[_\w]*\s+)?["]([^"]+)["]
rust 1 ^\s*use\s+([\w:]+)
java 1 ^\s*import\s+([\w.]+)
cpp 1 ^\s*#include\s+[<"]([^>"]+)[>"]
c 1 ^\s*#include\s+[<"]([^>"]+)[>"]
ruby 1 ^\s*(?:require|require_relative|load)\s+['"]([^'"]+)['"]
shell 1 ^\s*(?:source|\.)\s+['"]?([^'"\s]+)['"]?
capnp 1,2 ^\s*using\s+(?:import\s+)?(?:["']([^"']+)["']|([\w.]+))
"""

# ---- Fixed values: imports that the graph finds by other patterns ----
GRAPH_IMPORTS = r"""
typescript 1 (?:import\s+.*?\s+from\s+['"]([^'"]+)['"])
typescript 1 import\s+['"]([^'"]+)['"]
typescript 1 require\s*\(\s*['"]([^'"]+)['"]
"""

# ---- Fixed values: calls. Each line: language, pattern; group 1 is the name ----
CALLS = r"""
python (?:self|cls)\.(\w+)\s*\(
python \b([a-z_]\w*)\s*\(
python \.(\w+)\s*\(
typescript (?<!\bfunction\s)(?<!\bclass\s)\b(\w+)\s*\(
javascript (?<!\bfunction\s)(?<!\bclass\s)\b(\w+)\s*\(
go (?<!\bfunc\s)\b(\w+)\s*\(
cpp \b(\w+)\s*\(
java (?<!\bclass\s)\b(\w+)\s*\(
rust (?<!\bfn\s)\b(\w+)\s*\(
ruby (?<!\bdef\s)(?<!\bclass\s)\b(\w+)\s*\(
ruby \.(\w+)\s*\(
shell \b(\w+)\s+(?:\||;|&&|$)
c \b(\w+)\s*\(
"""

# ---- Fixed values: inheritance. Each line: language, pattern; group 1 is the child, group 2 the parent ----
INHERITS = r"""
python ^\s*class\s+(\w+)\s*\(\s*(\w+)
typescript ^\s*(?:export\s+)?class\s+(\w+)\s+extends\s+(\w+)
typescript ^\s*(?:export\s+)?class\s+(\w+)\s+implements\s+(\w+)
javascript ^\s*class\s+(\w+)\s+extends\s+(\w+)
cpp ^\s*class\s+(\w+)\s*:\s*(?:public|private|protected)\s+(\w+)
java ^\s*class\s+(\w+)\s+extends\s+(\w+)
java ^\s*class\s+(\w+)\s+implements\s+(\w+)
rust ^\s*(?:pub\s+)?trait\s+(\w+)\s*:\s*(\w+)
ruby ^\s*class\s+(\w+)\s*<\s*(\w+)
"""

# ---- Fixed values: limits ----
MAX_SYMBOLS, SIZE_CHANGE, HIGH_IMPACT, DEGREE_CHANGE, DIFF_SYMBOLS, DIFF_IMPORTS, PATCH_CHARS = 100, 50, 5, 2, 20, 10, 120
CALL_CONFIDENCE = 0.7
"""Confidence stored with a call; by the step that resolved it: imported file, same file, same directory, unique name, first."""
STEP_CONFIDENCE = (0.95, 0.90, 0.85, 0.75, 0.55)
