"""Scalar text functions as column expressions: everything here stays inside generated code or higher-order functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mark a refused call, and marks of program text.
REFUSALS = ["safety", "policy", "cannot comply", "can't comply", "refuse"]
CODE_MARKS = ["def ", "class ", "import ", "return ", "    ", "\t", "()", "{}", "[]", "==", "!="]
TEST_PATHS = ["/test/", "/tests/", "test_", "_test.py", "conftest.py"]
VALIDATION_MARKS = [
    "validate", "check", "assert", "raise valueerror", "raise typeerror", "if not ", "is none", "is not none", "isinstance(", "hasattr(", "verify", "ensure", "require", "expect",
]


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column) -> Column:
    """Both ends without white space of any kind (``trim`` drops spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def first_filled(*candidates: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def short_md5(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def whole_json(text: Column) -> Column:
    """The text as VARIANT if it is one JSON value and nothing else, else null (Spark's own parsers take what follows a value).
    What follows would be a second entry, or no JSON, in a list or an object around it; only closing marks can end one of these early."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    boxed = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$", "map<string,variant>")
    return F.when((F.size(listed) == 1) & (F.size(boxed) == 1), F.get(listed, F.lit(0)))


def hits(text: Column, needles: Iterable[str]) -> Column:
    """Those of the needles that the lower-cased text contains, in the order given."""
    return F.filter(strings(n.lower() for n in needles if n), lambda n: F.contains(F.lower(text), n))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return F.coalesce(F.size(hits(text, needles)) > 0, F.lit(False))


def is_refusal(text: Column) -> Column:
    return contains_any(text, REFUSALS)


def is_diff(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.contains("diff --git ") | (t.contains("--- ") & t.contains("+++ ") & t.contains("@@"))


def is_test_code(path: Column, function: Column) -> Column:
    return contains_any(path, TEST_PATHS) | F.coalesce(F.lower(function).startswith("test"), F.lit(False))


def is_validation_code(snippet: Column) -> Column:
    return contains_any(snippet, VALIDATION_MARKS)


def looks_like_code(text: Column, least: int = 2) -> Column:
    return F.coalesce(F.size(F.filter(strings(CODE_MARKS), lambda m: F.contains(text, m))) >= least, F.lit(False))


def clip(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(tail))).otherwise(text)


def unfence(text: Column) -> Column:
    """Without one pair of code fences around it."""
    t = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?i)^```(?:diff|patch)?\s*", "")
    return strip(F.regexp_replace(t, r"(?i)\s*```$", ""))


def find_diff(text: Column) -> Column:
    """The unified diff in a free text: from its first header on, else empty."""
    t = unfence(text)
    headed = strip(F.regexp_extract(t, r"(?ms)^(--- .*)\z", 1))
    return F.when(t.contains("diff --git "), strip(F.substring(t, F.instr(t, F.lit("diff --git ")), F.length(t)))).when(is_diff(t), F.when(headed != "", headed).otherwise(t)).otherwise("")


def touched_files(patch: Column) -> Column:
    """Sorted distinct files of a patch's headers, without /dev/null."""

    def path(line: Column) -> Column:
        named = strip(F.regexp_extract(line, r"^(?:--- a/|\+\+\+ b/)(.*)$", 1))
        other = strip(F.regexp_extract(line, r"^(?:---|\+\+\+) ([^\t]*)", 1))
        return F.when(line.startswith("--- a/") | line.startswith("+++ b/"), named).when(line.startswith("--- ") | line.startswith("+++ "), other)

    paths = F.transform(F.split(F.coalesce(patch, F.lit("")), "\n"), path)
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: p.isNotNull() & (p != "") & (p != "/dev/null"))))


def probability(reply: Column) -> Column:
    """A judge's probability of rejection: a JSON field, else the same by pattern, else by the words used."""
    raw = strip(F.coalesce(reply, F.lit("")))
    value = F.try_variant_get(F.try_parse_json(raw), "$.p_reject", "double")
    is_object = F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    found = F.regexp_extract(raw, r'"?p_reject"?\s*[:=]\s*([0-9]*\.?[0-9]+)', 1)
    words = F.when(F.upper(raw).contains("REJECT") & ~F.upper(raw).contains("ACCEPT"), 1.0).otherwise(0.0)
    # a field without a number counts by the words used, and its own name has one of them
    return F.when(is_object & value.isNotNull(), clamp(value)).when(found != "", clamp(found.try_cast("double"))).otherwise(words)


def guard_verdict(reply: Column) -> Column:
    """STRUCT(verdict, categories) of a guard model's reply: the first line names it, the second lists categories."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r\n|\r|\n"), strip), lambda s: s != "")
    first = F.lower(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    verdict = F.when(first.contains("unsafe"), "unsafe").when(first.contains("safe"), "safe").otherwise("unknown")
    listed = F.filter(F.transform(F.split(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), ","), strip), lambda s: s != "")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "unsafe", listed).otherwise(F.expr("cast(array() as array<string>)")).alias("categories"))


#: Where Python ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def subtasks(reply: Column) -> Column:
    """A list of steps: a JSON array, else the array inside the text, else its lines without the bullets at either end."""
    raw = strip(F.coalesce(reply, F.lit("")))
    as_list = lambda t: F.from_json(t, "array<string>")
    inside = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    bare = F.transform(F.split(raw, LINE_END), lambda s: F.regexp_replace(s, r"^[-*•\x20]+|[-*•\x20]+$", ""))
    json = F.coalesce(F.when(raw.startswith("["), as_list(raw)), F.when(inside != "", as_list(inside)))
    return F.filter(F.transform(F.coalesce(json, bare), strip), lambda s: s.isNotNull() & (s != ""))


def ascii_json(json: Column) -> Column:
    """JSON text with every character beyond ASCII written as its UTF-16 units, and those of control characters in lower case."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def letter(c: Column) -> Column:
        n = F.ascii(c)
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    out = F.when(json.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(json, ""), letter), "")).otherwise(json)
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):  # as escaped by Jackson; an even number of backslashes before is text
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u00" + code, "$1\\\\u00" + code.lower())
    return out


def json_column(text: Column, ddl: str) -> Column:
    """STRUCT(value, error) of a JSON text: the value of a type, or what is wrong with it."""
    parsed = F.try_parse_json(text)
    error = F.when(text.isNull(), "must be JSON text").when(parsed.isNull(), "has invalid JSON")
    return F.struct(F.when(error.isNull(), F.from_json(text, ddl)).alias("value"), error.alias("error"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with its keys in order, compact, in ASCII; nulls are written."""
    return ascii_json(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}))


def split_ids(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda s: s != "")


def hash_pick(key: Column, n: Column) -> Column:
    """A reproducible index below n: the first 64 bits of the key's sha256, unsigned, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)"), n.cast("decimal(20,0)")).cast("long")


def strip_c_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)//.*?$", ""), r"(?s)/\*.*?\*/", "")


#: The prompt that agents get: fixed wording.
AGENT_PROMPT = (
    "You are solving a SWE-Bench style repository issue.\nInstance: %s\nRepo: %s\nBase commit: %s\nRepository path: %s\n\nIssue / Prompt:\n%s\n\nAvailable tests:\n%s\n\n"
    "Requirements:\n1) Produce a minimal patch that fixes the issue and passes tests.\n2) Do not change unrelated behavior.\n3) Return ONLY a valid unified diff patch.\n"
)


def agent_prompt(instance: Column, repo: Column, commit: Column, path: Column, prompt: Column, tests: Column) -> Column:
    """tests: array of (name, command array)."""
    listed = F.array_join(F.transform(tests, lambda t: F.concat(F.lit("- "), t["name"], F.lit(": "), F.array_join(t["command"], " "))), "\n")
    return F.format_string(AGENT_PROMPT, *[F.coalesce(c, F.lit("")) for c in (instance, repo, commit, path, prompt, listed)])
