"""Words with a fixed meaning to the rules. Where a rule can give them, they are computed."""

from __future__ import annotations

import builtins
import keyword
import re
import sys

# Words of the languages that no repository defines.
PYTHON_RESERVED = frozenset(dir(builtins)) | frozenset(keyword.kwlist) | frozenset(
    "self cls unicode long xrange raw_input basestring reduce execfile print_function".split()
) - frozenset(n for n in dir(builtins) if n.endswith(("Warning",)) or (n.endswith("Error") and n.startswith(("Connection", "Timeout", "Permission"))))
# Keywords of ECMAScript and of what TypeScript adds; global objects of the language, of browsers, of Node and of test runners.
JS_RESERVED = frozenset(
    """async await break case catch class const continue debugger default delete do else enum export extends false finally for
    from function get if implements import in instanceof interface let new null of package private protected public return set
    static super switch this throw true try type typeof undefined var void while with yield
    Array ArrayBuffer Atomics BigInt Boolean DataView Date Error Function Infinity Intl JSON Map Math NaN Number Object Promise
    Proxy RangeError Reflect RegExp Set String Symbol SyntaxError TypeError URIError WeakMap WeakRef WeakSet globalThis
    isFinite isNaN parseFloat parseInt
    alert atob btoa clearInterval clearTimeout console document fetch location navigator queueMicrotask requestAnimationFrame
    setInterval setTimeout structuredClone window
    clearImmediate exports module process require setImmediate
    afterAll afterEach beforeAll beforeEach describe expect it test
    assert debug error info log warn""".split()
)
# Keywords and predeclared names of Go.
GO_RESERVED = frozenset(
    """break case chan const continue default defer else fallthrough for func go goto if import interface map package range
    return select struct switch type var
    any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8
    uint16 uint32 uint64 uintptr true false iota nil append cap clear close complex copy delete imag len make max min new
    panic print println real recover""".split()
)
# Keywords of C, functions of its library by header, and calls of POSIX systems.
C_RESERVED = frozenset(
    """auto break case char const continue default do double else enum extern float for goto if inline int long register
    restrict return short signed sizeof static struct switch typedef union unsigned void volatile while define include
    assert isalnum isalpha isdigit islower isspace isupper tolower toupper raise signal offsetof
    fclose feof ferror fflush fgets fopen fprintf fputs fread fscanf fseek ftell fwrite getchar perror printf putchar puts
    remove rename scanf snprintf sprintf sscanf vfprintf vsnprintf
    abort abs atexit atoi atol bsearch calloc exit free getenv malloc qsort rand realloc srand strtod strtol strtoul system
    memchr memcmp memcpy memmove memset strcat strchr strcmp strcpy strerror strlen strncat strncmp strncpy strrchr strstr
    strtok clock difftime gmtime localtime mktime strftime time
    accept bind chdir close connect dup dup2 execl execv execve execvp fcntl fork fstat fsync getpid ioctl kill listen lseek
    mkdir mmap munmap open pipe poll read recv select send setenv sleep socket stat strdup unlink usleep waitpid write""".split()
)
#: What names of the thread and network interfaces of POSIX begin with.
C_FAMILIES = ("pthread_", "sem_", "inet_", "sig", "mtx_", "atomic_")
PROSE_WORDS = frozenset("example todo fixme note warning error info something nothing anything everything true false none null nil undefined".split())
METASYNTACTIC = frozenset("foo bar baz blah qux quux".split())
STDLIB = frozenset(sys.stdlib_module_names)
NODE_BUILTINS = frozenset(
    """assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs
    http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder
    sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib""".split()
)
#: Import names whose distribution is called otherwise.
DISTRIBUTION_OF = {
    "yaml": "pyyaml", "PIL": "pillow", "cv2": "opencv-python", "sklearn": "scikit-learn", "bs4": "beautifulsoup4",
    "dateutil": "python-dateutil", "dotenv": "python-dotenv", "jwt": "pyjwt", "serial": "pyserial", "git": "gitpython",
    "Crypto": "pycryptodome", "OpenSSL": "pyopenssl", "MySQLdb": "mysqlclient", "psycopg2": "psycopg2-binary",
    "attr": "attrs", "magic": "python-magic", "usb": "pyusb", "zmq": "pyzmq", "google": "protobuf", "docx": "python-docx",
    "pkg_resources": "setuptools", "skimage": "scikit-image", "wx": "wxpython",
}
IGNORED_DIRS = frozenset(
    """.git __pycache__ node_modules .venv venv .tox dist build .next out coverage .nyc_output .mypy_cache .ruff_cache
    .pytest_cache vendor third_party""".split()
)
IGNORED_FILES = frozenset("package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Cargo.lock".split())



def any_of(*phrases: str) -> str:
    """A pattern for any of the phrases as whole words, whatever blanks stand in them."""
    return r"(?<![\w])(?:" + "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in phrases) + r")(?![\w])"


def forms(*verbs: str) -> list[str]:
    """The verbs with the endings that a comment gives them."""
    return [f for v in verbs for f in (v, v + "s", (v[:-1] if v[-1] == "e" else v) + "ed", (v[:-1] if v[-1] == "e" and v[-2] != "e" else v) + "ing")]


# What a reference to a ticket looks like (number, address, project key), and the marks of open work.
TICKET = re.compile(r"#\d{1,6}\b|https?://\S+|\b[A-Z]{2,}-\d+", re.I)
WORK_ITEM = re.compile(r"\b(?:TODO|FIXME|HACK|XXX|BUG)\b")

_AUXILIARIES = "do does did is are was were has have had can could will would should must need".split()
_DENIED = [f"{a} not" for a in _AUXILIARIES] + [f"{a}n't" for a in _AUXILIARIES] + ["can't", "won't", "cannot"]
#: A claim beside one of these says that something is not so.
NEGATED = re.compile(any_of(*_DENIED, "never", "no longer", "no call", "no calls", "without", "instead", *forms("avoid"), "unsupported", "not needed", "not used"), re.I)
#: What follows is made up.
ILLUSTRATIVE_PHRASES = ("for example", "for instance", "such as", "as an example", "example", "suppose", "imagine", "say we", "hypothetically")
ILLUSTRATIVE = re.compile(any_of(*ILLUSTRATIVE_PHRASES) + r"|(?<!\w)(?:e\.\s?g\.|i\.\s?e\.)", re.I)
#: What was so once.
HISTORICAL = re.compile(any_of("used to", "formerly", "previously", "once was", "was once", "was removed", "was renamed", "has been removed", "in earlier versions", "in older versions", "historically"), re.I)
#: A bare call in a comment is a reference if one of these is near.
REFERENCE_VERB = re.compile(
    any_of(*forms("call", "invoke", "use", "wrap", "trigger"), "see", "see also", "refer to", "refers to", "delegate to", "delegates to", "handled by",
           "handled in", "defined by", "defined in", "implemented by", "implemented in") + r"|@(?:see|link|deprecated)\b", re.I
)
#: Settings whose numbers comments state, what may stand before one, and the units they come in.
SETTINGS = "attempts bytes capacity connections count delay depth expiry interval length limit lines port retries size threads threshold timeout tries ttl workers".split()
SETTING_KINDS = "batch buffer cache default max maximum min minimum page pool queue".split()
UNITS = "% b bytes gb hours kb mb min mins minutes ms px s sec secs seconds".split()
#: Words for a state that is to end, marks of a makeshift, and what makes a short comment speak of one.
TEMPORAL = ("at the moment", "currently", "for now", "for the moment", "for the time being", "right now", "temporarily", "temporary fix", "until then")
MAKESHIFT_MARKS, MAKESHIFT_WORDS = ("FIXME", "HACK", "XXX"), ("kludge", "magic number", "stopgap", "work-around", "workaround")
# Companions of a temporal phrase.
COMPANIONS = "fix hack patch toggle flag skip disable".split()
FILE_SUFFIXES = (
    "py pyi js jsx ts tsx mjs cjs mts cts json yaml yml toml md rst txt css html htm sh c h cpp hpp cc go rs java po pot sql xml "
    "ini cfg vue svelte rb php swift kt graphql gql proto"
).split()
PATH_PLACEHOLDERS = frozenset("any bar baz dummy example examples file1 file2 foo path placeholder sample some to your".split())
CODE_SUFFIXES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "javascript", "tsx": "javascript", "mts": "javascript", "cts": "javascript", "go": "go", "c": "c", "h": "c",
    "md": "markdown", "markdown": "markdown", "mdc": "markdown", "rst": "markdown", "toml": "config", "json": "config", "cfg": "config",
    "txt": "config", "yaml": "config", "yml": "config",
}


def reserved(name: str, language: str) -> bool:
    """Whether a name belongs to the language or to prose, so that no repository need define it."""
    if name.lower() in PROSE_WORDS or name in PYTHON_RESERVED or name in JS_RESERVED:
        return True
    if language == "go":
        return name in GO_RESERVED or name in C_RESERVED
    return language == "c" and (name in C_RESERVED or name.startswith(C_FAMILIES))
