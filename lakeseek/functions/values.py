"""Tables that have to equal those of the engine whose queries this one runs."""

from __future__ import annotations


def _table(text: str) -> dict[str, list[str]]:
    """``key: value, value`` lines."""
    return {k.strip(): [v.strip() for v in vs.split(",")] for k, vs in (line.split(":") for line in text.strip().split("\n"))}


# Languages by file extension.
EXTENSIONS = {e: language for language, es in _table("""
python: .py, .ipynb
javascript: .js, .jsx
typescript: .ts, .tsx
go: .go
rust: .rs
java: .java
c: .c, .h
cpp: .cpp, .hpp
ruby: .rb
php: .php
swift: .swift
kotlin: .kt
scala: .scala
csharp: .cs
vue: .vue
svelte: .svelte
markdown: .md
sql: .sql
bash: .sh
yaml: .yaml, .yml
json: .json
toml: .toml
html: .html
css: .css
scss: .scss
""").items() for e in es}

# Folders that are never entered, ignore files, limits.
EXCLUDED_FOLDERS = tuple(".git .svn .hg node_modules __pycache__ .venv venv .tox .pytest_cache .mypy_cache dist build .next .nuxt target coverage".split())
IGNORE_FILES = (".gitignore", ".codesearchignore")
MAX_FILE_KB, MAX_CONTENT_CHARS, MAX_REGEX_CHARS = 1024, 30_000, 50_000
WINDOW_LINES, OVERLAP_LINES, MERGE_LINES, CLASS_LINES = 500, 25, 10, 50
DOCSTRING_CHARS, MAX_IMPORTS, MAX_DEFINITIONS, MAX_METHODS = 300, 15, 15, 20

# Score adjustments by path, and their cap.
PATH_BOOSTS = {k: float(v[0]) for k, v in _table("""
src/: 0.10
lib/: 0.08
core/: 0.08
app/: 0.05
pkg/: 0.05
test/: -0.10
tests/: -0.10
__test__/: -0.15
.test.: -0.10
.spec.: -0.10
_test.: -0.10
test_: -0.08
mock/: -0.15
mocks/: -0.15
fixture: -0.18
fixtures/: -0.18
vendor/: -0.25
third_party/: -0.25
generated/: -0.30
.gen.: -0.25
.pb.: -0.20
_pb2.: -0.20
example/: -0.05
examples/: -0.05
sample/: -0.05
""").items()}
MAX_BOOST = 0.30

# Ranking constants.
RRF_K, PREFETCH, DENSE_WEIGHT, SPARSE_WEIGHT, FALLBACK_SCORE = 60, 100, 1.0, 0.8, 0.3
TIERS = {"name": 3.0, "summary": 2.0, "content": 1.0}

# Chunk types by a part of a syntax node's name, first match wins; their short forms in summaries.
CHUNK_TYPES = [("function", "function"), ("method", "function"), ("class", "class"), ("interface", "interface"), ("trait", "interface"),
               ("struct", "struct"), ("enum", "enum"), ("impl", "impl"), ("module", "module"), ("type", "type")]
SHORT_TYPES = {"function": "fn", "class": "cls", "class_overview": "cls", "interface": "ifc", "struct": "struct", "enum": "enum",
               "impl": "impl", "module": "mod", "type": "type", "block": "blk"}
FUNCTION_SCOPE = ("function", "method")
CLASS_SCOPE = ("class", "class_overview", "struct", "interface", "impl", "enum", "type", "module")
TEST_WORDS = ("test", "tests", "spec", "specs")

# Words that carry no meaning for sparse retrieval.
STOP_WORDS = tuple("a an and are as at be but by for from has have in into is it its not of on or such that the their then there these they this to was will with".split())

# Words of a query and what they also stand for.
SYNONYMS = _table("""
fn: function
func: function
cls: class
err: error, exception
msg: message
req: request
res: response
resp: response
params: parameters
args: arguments
kwargs: keyword arguments
ret: return
val: value
var: variable
impl: implementation
init: initialize, constructor
ctor: constructor
dtor: destructor
cfg: config, configuration
conf: config, configuration
db: database
auth: authentication, authorization
ctx: context
env: environment
pkg: package
dep: dependency
deps: dependencies
util: utility
utils: utilities
str: string
int: integer
bool: boolean
dict: dictionary
arr: array
idx: index
len: length
num: number
max: maximum
min: minimum
avg: average
src: source
dst: destination
tmp: temporary
async: asynchronous
sync: synchronous
ws: websocket
http: protocol, request
https: protocol, secure
tcp: protocol, socket
udp: protocol, datagram
rpc: remote procedure call
grpc: remote procedure call
api: interface, endpoint
rest: representational state transfer
url: uniform resource locator, address
uri: uniform resource identifier
io: input output
stdin: standard input
stdout: standard output
stderr: standard error
stream: input output, data flow
buf: buffer
buffer: data storage, temporary
obj: object
tuple: collection, pair
set: collection, unique
map: dictionary, key value
hashmap: dictionary, key value
heap: tree, priority
queue: list, fifo
stack: list, lifo
vec: vector, array
ptr: pointer, reference
ref: reference
mutex: lock, synchronization
semaphore: synchronization, signal
thread: concurrent, parallel
task: unit of work, job
worker: thread, background
callback: handler, listener
promise: future, async
future: promise, async
spawn: create, launch
chan: channel, communication
test: verify, check
mock: fake, stub
stub: fake, mock
spy: monitor, track
assert: verify, check
expect: verify, should
spec: specification, test
e2e: end to end, integration
unit: single, isolated
panic: crash, fatal
throw: raise, error
catch: handle, trap
try: attempt, handle
except: catch, handle
finally: cleanup, always
alloc: allocate, memory
dealloc: deallocate, free
gc: garbage collection
cache: memory, store
mem: memory
perf: performance
opt: optimize, optimization
bench: benchmark, performance
singleton: single instance, pattern
factory: create, pattern
builder: construct, pattern
handler: process, callback
listener: event, callback
observer: watch, pattern
middleware: interceptor, handler
regex: regular expression, pattern
json: javascript object notation
xml: extensible markup language
yaml: configuration, markup
toml: configuration
sql: structured query language, database
orm: object relational mapping
crud: create read update delete
""")
MAX_EXPANSIONS, MAX_SYNONYMS = 5, 2

# Patterns that hint at a language in a query, in order of precedence.
LANGUAGE_HINTS = [
    ("typescript", r"\buse(Effect|State|Context|Memo|Callback|Ref|Reducer|LayoutEffect)\b"),
    ("typescript", r"\buseSelector\b|\buseDispatch\b"),
    ("typescript", r"\bReact\.(Component|useState|useEffect)"),
    ("typescript", r"\bJSX\b|\bTSX\b"),
    ("typescript", r"\.tsx?\b"),
    ("python", r"\b__init__\b|\b__main__\b|\b__name__\b"),
    ("python", r"\bself\.\w+"),
    ("python", r"\bdef\s+\w+\s*\(self"),
    ("python", r"\basyncio\b|\bawait\s+\w+\("),
    ("python", r"\.py\b"),
    ("rust", r"\bimpl\s+\w+"),
    ("rust", r"\b(Option|Result|Vec|String)::"),
    ("rust", r"\bunwrap\(\)|\bexpect\("),
    ("rust", r"\bfn\s+\w+\s*<"),
    ("rust", r"\.rs\b"),
    ("go", r"\bfunc\s+\(\w+\s+\*?\w+\)"),
    ("go", r"\bgoroutine\b|\bchannel\b"),
    ("go", r"\bgo\s+func\b"),
    ("go", r"\.go\b"),
    ("java", r"\bpublic\s+class\b|\bprivate\s+void\b"),
    ("java", r"\bextends\s+\w+\s+implements\b"),
    ("java", r"\.java\b"),
    ("cpp", r"\b(std::|vector<|unique_ptr<|shared_ptr<)"),
    ("cpp", r"\b#include\s*<\w+>"),
    ("cpp", r"\.(cpp|hpp|cc|hh)\b"),
]
