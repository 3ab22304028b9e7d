"""Text functions and classifiers as Column expressions.

Patterns are written for Java: (?U) gives Unicode classes where the semantics need them, (?d) makes lines end at line feeds only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and names whose results must be these.
FILE_READ = r"(?iU)^\s*(cat|head|tail|less|more|grep|find|ls|tree|wc|file|stat|diff)\b"
FILE_EDIT = (
    r"(?iU)(>\s*\S+|\bsed\s+-i\b|\btee\s+\S|\btouch\s+\S|\bmv\s+\S|\bcp\s+\S|\brm\s+\S|\bpatch\s+|\bwrite_file\b|\bcreate_file\b)"
)
TEST_RUN = (
    r"(?iU)(pytest|python\s+-m\s+pytest|python\s+-m\s+unittest|nosetests|npm\s+(run\s+)?test|yarn\s+test|make\s+test|go\s+test"
    r"|cargo\s+test|mvn\s+test|gradle\s+test|bundle\s+exec\s+rspec)"
)
GIT_PATCH = r"(?iU)^\s*git\s+(diff|apply|am|patch)\b"
EDITOR = r"(?iU)^\s*(edit|open|create|insert|replace|delete_lines?)\b"
ERROR = (
    r"(?imdU)(Traceback \(most recent call last\)|^\s*\w+Error:|^\s*\w+Exception:|\bFAILED\b|\bAssertionError\b|\bSyntaxError\b"
    r"|\bTypeError\b|\bValueError\b|\bKeyError\b|\bAttributeError\b|\bImportError\b|\bModuleNotFoundError\b|\bRuntimeError\b"
    r"|\bIndexError\b|\bNameError\b)"
)
ERROR_CLASS = r"(?U)\b(\w+(?:Error|Exception))\b"
TEST_PASS = r"(?iU)(\d+\s+passed|\bOK\b|\ball\s+tests?\s+pass)"
TEST_FAIL = r"(?iU)(\d+\s+failed|\bFAILED\b|\bERROR\b)"
TEST_COUNT = r"(?iU)(\d+)\s+(?:passed|failed|tests?)"
OBSERVED_PASS = (
    r"(?iU)(\d+\s+passed(?:\s+in\s+[\d.]+s)?|\bOK\b|all\s+tests?\s+pass(?:ed)?|PASSED|Tests\s+run:\s*\d+,\s*Failures:\s*0|TEST_\w+:\s*PASS)"
)
OBSERVED_FAIL = r"(?iU)(\d+\s+failed|\bFAILED\b|ERRORS\b|AssertionError|Tests\s+run:\s*\d+.*Failures:\s*[1-9]|TEST_\w+:\s*FAIL)"
TERMINAL_PASS = (
    r"(?iU)(TEST_\w+:\s*PASS|\d+\s+passed(?:\s+in\s+[\d.]+s)?|\bOK\b|all\s+tests?\s+pass(?:ed)?|Tests\s+run:\s*\d+,\s*Failures:\s*0|TESTS\s+PASSED)"
)
TERMINAL_FAIL = r"(?iU)(TEST_\w+:\s*FAIL|\d+\s+failed|FAILED\s+\(|Errors:\s*\d+|TESTS\s+FAILED)"
SECRETS = [
    ("anthropic_api_key", r"sk-ant-[a-zA-Z0-9\-_]{20,}"),
    ("openai_api_key", r"sk-[a-zA-Z0-9]{32,}"),
    ("github_pat", r"ghp_[a-zA-Z0-9]{36}"),
    ("github_token", r"ghs_[a-zA-Z0-9]{36}"),
    ("github_fine_grained_pat", r"github_pat_[a-zA-Z0-9_]{22,}"),
    ("aws_access_key", r"AKIA[A-Z0-9]{16}"),
    ("bearer_token", r"(?U)Bearer\s+[a-zA-Z0-9._\-]{30,}"),
    ("credential_assignment", r"(?iU)(?:password|passwd|secret|token)\s*[=:]\s*[\"']?[^\s\"'<]{8,}"),
    ("api_key_assignment", r"(?iU)(?:api[_\-]?key|apikey)\s*[=:]\s*[\"']?[a-zA-Z0-9\-_]{20,}"),
]
EMAIL = r"(?U)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
EMAIL_MARK = "<redacted-email>"
LICENCES = (
    "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Unlicense CC0-1.0 MPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only"
    " LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later"
).split()
FILE_EXTENSIONS = ".py .js .ts .go .rs .java .c .cpp .h .sh .txt .json .yaml .yml .md .toml .cfg .ini".split()
HUMAN_ERROR = (
    r"(?imdU)(Traceback \(most recent call last\)|\b\w+Error:|\b\w+Exception:|\bFAILED\b|\bAssertionError\b|\bSyntaxError\b|\bTypeError\b"
    r"|\bValueError\b|\berror:\s)"
)
CODE_FENCE = r"(?sU)```[\w]*\n(.*?)```"
SHELL_FENCE = r"(?s)```(?:bash|sh|shell|zsh)\n(.*?)```"
INLINE_COMMAND = r"(?U)`([a-z][a-z0-9\-_]+\s+[^`]{0,80})`"
HUMAN_TEST = r"(?iU)(pytest|python\s+-m\s+pytest|python\s+-m\s+unittest|npm\s+test|go\s+test|cargo\s+test)"
FILE_REFERENCE = r"`([^`]+\.[a-zA-Z]{1,6})`|\"([^\"]+\.[a-zA-Z]{1,6})\""
HUMAN_PASS = r"(?iU)(\d+\s+passed|\bOK\b|\bpassing\b|\bAll tests pass)"
TURN_HEADER = r"(?imdU)^##\s+(User|Assistant|Agent|Human|AI|Copilot|System)\s*$"
ACTION_FENCE = r"(?sU)```(?:\w+)?\n?(.*?)\n?```"


# Terms that must not show in rendered chains, by field; some stand in several.
KEYWORDS = (
    "def class import return async await yield lambda raise except finally with pass global nonlocal elif else while assert del exec print"
    " stdin stdout stderr traceback"
).split()
EXCEPTIONS = (
    "TypeError ValueError KeyError AttributeError ImportError RuntimeError IndexError NameError OSError FileNotFoundError PermissionError"
    " TimeoutError StopIteration AssertionError NotImplementedError RecursionError MemoryError OverflowError ZeroDivisionError"
    " UnicodeDecodeError UnicodeEncodeError ConnectionError BrokenPipeError FileExistsError IsADirectoryError ModuleNotFoundError"
    " SyntaxError IndentationError SystemExit Exception BaseException Traceback"
).split()
PACKAGES = (
    "django flask fastapi starlette uvicorn gunicorn numpy pandas scipy sklearn scikit matplotlib torch tensorflow keras jax transformers"
    " huggingface requests httpx aiohttp urllib pydantic sqlalchemy alembic pymongo motor celery redis kafka rabbitmq boto3 botocore s3"
    " lambda pytest unittest mock fixtures click typer argparse yaml toml json csv xml html asyncio threading multiprocessing subprocess"
    " pathlib shutil tempfile logging traceback"
).split()
COMMANDS = (
    "grep find sed awk sort uniq wc cut tr curl wget ssh scp rsync nc netcat git svn hg make cmake ninja bazel pip pip3 conda virtualenv"
    " venv npm yarn pnpm node npx bun cargo rustc rustup gcc clang javac java kotlin go docker podman kubectl helm terraform ansible ps top"
    " htop kill killall pkill chmod chown chgrp ln ls pwd cd mv cp rm mkdir rmdir touch cat less more head tail echo printf export source"
    " env set unset tee xargs parallel nohup screen tmux"
).split()
TERMS = (
    "function method module package library framework variable parameter argument constant attribute property interface protocol abstract"
    " inherit override decorator iterator generator coroutine callback closure database schema migration query transaction endpoint route"
    " middleware handler controller serializer test unittest coverage fixture assertion compiler interpreter runtime bytecode binary thread"
    " process daemon signal socket token api sdk cli ide github gitlab bitbucket jira commit branch merge rebase stash checkout build deploy"
    " release version tag config environment dotenv secret stdout stderr stdin pipe redirect"
).split()
FILE_TERMS = (
    "python py js ts jsx tsx java cpp hpp rb go rs cs swift kotlin html css scss sass less sql sh bash zsh fish txt md rst json yaml toml"
    " xml ini cfg dockerfile makefile requirements setup pyproject package"
).split()


def default_vocabulary() -> list[str]:
    """Terms that must not show in rendered chains; callers may pass their own list instead."""
    return list(dict.fromkeys(KEYWORDS + EXCEPTIONS + PACKAGES + COMMANDS + TERMS + FILE_TERMS))


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: What (?U)\s matches.
WHITE = [chr(i) for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def stripped(c: Column) -> Column:
    """py_strip of a plain column: the pattern is tried only where a text begins or ends with white space."""
    return F.when(F.left(c, F.lit(1)).isin(WHITE) | F.right(c, F.lit(1)).isin(WHITE), py_strip(c)).otherwise(c)


def tokens(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def truthy(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def nonempty(c: Column) -> Column:
    """truthy of what is costly: worked out once."""
    return F.try_element_at(F.filter(F.array(c), lambda x: x != ""), F.lit(1))


def normalize_action(c: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(py_strip(c)), r"(?U)\s+", " "), r"[^a-z0-9_ ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def folded(c: Column) -> Column:
    """Case folded as the patterns' case-insensitive mode does it, letter by letter."""
    return F.lower(F.upper(c))


def any_of(c: Column, *words: str) -> Column:
    return reduce(or_, [c.contains(w) for w in words])


def classify_command(c: Column, low: Column | None = None) -> Column:
    """low: folded(c), where the caller has it. Plain words that each pattern needs are looked for before the pattern is tried."""
    low = folded(c) if low is None else low
    test = any_of(low, "test", "rspec") & c.rlike(TEST_RUN)
    edit = any_of(low, ">", "sed", "tee", "touch", "mv", "cp", "rm", "patch", "_file") & c.rlike(FILE_EDIT)
    return F.when(test, "test_run").when(edit, "file_edit").when(c.rlike(FILE_READ), "file_read").otherwise("bash_call")


def is_patch_edit(c: Column) -> Column:
    return c.rlike(GIT_PATCH) | c.rlike(EDITOR)


def classify_patch_command(c: Column) -> Column:
    return F.when(is_patch_edit(c), "file_edit").otherwise(classify_command(c))


def framework(c: Column) -> Column:
    x = F.lower(c)
    return (
        F.when(x.contains("pytest"), "pytest")
        .when(x.contains("unittest"), "unittest")
        .when(any_of(x, "jest", "npm", "yarn"), "jest")
        .when(x.contains("go test"), "go")
        .when(x.contains("cargo test"), "cargo")
        .when(x.contains("rspec"), "rspec")
        .when(any_of(x, "mvn", "gradle"), "junit")
        .otherwise("unknown")
    )


def human_framework(c: Column) -> Column:
    x = F.lower(c)
    return (
        F.when(x.contains("pytest"), "pytest")
        .when(x.contains("unittest"), "unittest")
        .when(x.contains("npm test") | x.contains("jest"), "jest")
        .when(x.contains("go test"), "go")
        .when(x.contains("cargo test"), "cargo")
        .otherwise("unknown")
    )


def test_outcome(c: Column, low: Column | None = None) -> Column:
    low = folded(c) if low is None else low
    failed = any_of(low, "fail", "error") & c.rlike(TEST_FAIL)
    return F.when(failed, "fail").when(any_of(low, "pass", "ok") & c.rlike(TEST_PASS), "pass").otherwise("fail")


def test_count(c: Column) -> Column:
    return truthy(F.regexp_extract(c, TEST_COUNT, 1)).try_cast("int")


def error_class(c: Column) -> Column:
    return F.when(any_of(c, "Error", "Exception"), F.coalesce(truthy(F.regexp_extract(c, ERROR_CLASS, 1)), F.lit("RuntimeError"))).otherwise("RuntimeError")


def has_error(c: Column, low: Column | None = None) -> Column:
    return any_of(folded(c) if low is None else low, "traceback", "error", "exception", "failed") & c.rlike(ERROR)


def observed(c: Column, low: Column) -> Column:
    """Whether an output shows a test's result."""
    return (any_of(low, "pass", "ok", "failures") & c.rlike(OBSERVED_PASS)) | (any_of(low, "fail", "error") & c.rlike(OBSERVED_FAIL))


def file_path(c: Column) -> Column:
    """The last word after the command that looks like a path, else the last word."""
    words = tokens(c)
    looks = lambda w: w.contains("/") | F.exists(F.array(*map(F.lit, FILE_EXTENSIONS)), lambda e: F.endswith(w, e))
    rest = F.reverse(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    found = F.regexp_replace(F.try_element_at(F.filter(rest, looks), F.lit(1)), "^-+", "")
    return F.coalesce(found, F.when(F.size(words) > 1, F.try_element_at(words, F.lit(-1))), F.lit(""))


def secrets(c: Column) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in SECRETS]), lambda x: x.isNotNull())


def redact_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, EMAIL_MARK)


def licence_ok(c: Column) -> Column:
    """No licence is accepted too."""
    return c.isNull() | c.isin(LICENCES)


def leaked_terms(c: Column, vocabulary: list[str] | None = None) -> Column:
    """Terms of the vocabulary (single words) that the text holds as whole words, whatever their case; in vocabulary order."""
    vocabulary = default_vocabulary() if vocabulary is None else vocabulary
    if not vocabulary:
        return F.array().cast("array<string>")
    # few texts hold any term: words are looked up in a set first
    hits = F.filter(F.array_distinct(F.split(F.lower(c), r"(?U)\W+")), lambda w: w.isin(sorted({t.lower() for t in vocabulary})))
    terms = F.filter(F.array(*map(F.lit, vocabulary)), lambda t: F.array_contains(hits, F.lower(t)))
    return F.when(F.size(hits) > 0, terms).when(c.isNotNull(), F.array().cast("array<string>"))


def flatten_content(c: Column) -> Column:
    """Content as a JSON string: a text, or a list of texts and {text | content}; null is empty."""
    parts = F.from_json(c, "array<string>")
    named = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), F.when(F.startswith(x, F.lit("{")), "").otherwise(x))
    item = lambda x: F.when(x.contains("{"), named(x)).otherwise(x)
    return F.when(c.isNull(), "").otherwise(F.coalesce(F.when(F.startswith(c, F.lit("[")), F.array_join(F.transform(parts, item), " ")), c))


def fenced_action(c: Column) -> Column:
    """Body of the first code fence, stripped; null without a fence."""
    return F.when(c.contains("```"), py_strip(F.try_element_at(F.regexp_extract_all(c, F.lit(ACTION_FENCE), F.lit(1)), F.lit(1))))


def last_line(c: Column) -> Column:
    """The last line that is not blank, stripped: with the blank ones after it gone, the last of all."""
    return F.regexp_replace(F.coalesce(F.try_element_at(F.split(stripped(c), r"\r\n|[\n\r]"), F.lit(-1)), F.lit("")), r"(?U)^\s+", "")


def shell_command(c: Column) -> Column:
    """First line of the first shell fence, else inline code that looks like a command, else empty."""
    fence = F.element_at(F.split(py_strip(F.regexp_extract(c, SHELL_FENCE, 1)), "\n"), 1)
    return F.when(c.rlike(SHELL_FENCE), fence).otherwise(F.regexp_extract(c, INLINE_COMMAND, 1))


def file_reference(c: Column) -> Column:
    return F.concat(F.regexp_extract(c, FILE_REFERENCE, 1), F.regexp_extract(c, FILE_REFERENCE, 2))


def first_line(c: Column, most: int = 80) -> Column:
    return F.substring(F.element_at(F.split(py_strip(c), "\n"), 1), 1, most)
