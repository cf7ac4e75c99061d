"""Text functions, Column to Column, in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and limits of the correction and re-ask rules. Names of particular assistants are left to callers
# (``acronyms``).
CORRECTION_WORDS = ["no", "nope", "nah", "wtf", "why", "stop", "again", "bruh", "wrong", "ugh", "huh", "wait", "undo"]
CORRECTION_PHRASES = [
    "i said", "i told you", "i asked", "not what i", "that's not", "thats not", "you didn't", "you did not", "didnt",
    "still not", "still broken", "doesn't work", "didn't work", "not working", "why did you", "don't do",
    "you were supposed", "instead of",
]
ACRONYMS = [
    "JSON", "HTML", "HTTP", "HTTPS", "YAML", "TODO", "README", "AGENTS", "NVIDIA", "API", "CLI", "SDK", "URL", "UUID",
    "SQL", "GPU", "CPU", "DNS", "TLS", "SSH", "LLM", "MCP",
]
CORRECTION_MAX_CHARS = 280
STOPWORDS = [
    "the", "and", "for", "you", "that", "this", "with", "are", "can", "what", "how", "was", "but", "not", "have", "has",
    "from", "your", "all", "any", "its", "it's", "just", "into", "out", "now", "then", "they", "them", "there", "here",
    "also", "use", "get", "did", "does", "will", "would", "should", "please",
]
#: Characters that no word holds; Unicode letters and digits and the apostrophe do.
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}']+"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), NOT_WORD), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets given as arrays without repeats; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; a shorter text is its own only one."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(runs)


def shouting(text: Column, acronyms: list[str] = ACRONYMS) -> Column:
    """Two all-capital words of four letters or more that are no acronyms, or ten letters of which seven tenths are capital."""
    loud = F.filter(
        F.split(text, r"[^\p{IsAlphabetic}]+"),
        lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{IsUppercase}+$") & ~F.array_contains(strings(acronyms), w),
    )
    letters = F.length(F.regexp_replace(text, r"[^\p{IsAlphabetic}]", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{IsUppercase}]", ""))
    return (F.size(loud) >= 2) | ((letters >= 10) & (upper * 10 >= letters * 7))


def correction(text: Column, acronyms: list[str] = ACRONYMS) -> Column:
    """A short turn that pushes back."""
    spaced = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    phrase = F.exists(strings(CORRECTION_PHRASES), lambda p: F.contains(spaced, F.concat(F.lit(" "), p, F.lit(" "))))
    return (F.length(text) <= CORRECTION_MAX_CHARS) & (F.arrays_overlap(words(text), strings(CORRECTION_WORDS)) | phrase | shouting(text, acronyms))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, joint: str = "_", most: int = 60, empty: str = "noise") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")
    s = F.substring(s, 1, most)
    return F.when(s == "", F.lit(empty)).otherwise(s)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncated(text: Column, most: int) -> Column:
    """The trimmed text, or its first characters and how many it has."""
    t = trimmed(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("… ["), F.length(t).cast("string"), F.lit(" chars]")))


def shortened(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, and a mark if there were more."""
    t = squash(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("…")))


def middle_trimmed(text: Column, limit: int) -> Column:
    """Head and tail of a text within ``limit`` characters, two fifths of them the head; 0 is no limit."""
    if limit <= 0:
        return text
    n = F.length(text)
    marker = F.concat(F.lit("\n...["), (n - limit).cast("string"), F.lit(" characters trimmed to fit the context]...\n"))
    keep = F.greatest(F.lit(0), F.lit(limit) - F.length(marker))
    head = F.floor(keep * 2 / 5).cast("int")
    tail = F.substring(text, n - (keep - head) + 1, keep - head)
    return F.when(n <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), head), marker, tail))


# What is redacted, in this order: address, number address, token by its beginning, named secret, long hexadecimal, home
# folder.
REDACTIONS = (
    (r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b(?:ghp|gho|ghs|ghu|github_pat|sk|sk-ant|xox[abp])[-_][A-Za-z0-9_-]{10,}", "<secret>"),
    (r"(?i)\b(token|password|secret|api[_-]?key)(\s*[=:]\s*)\S+", "$1$2<secret>"),
    (r"\b[0-9a-f]{32,}\b", "<hex>"),
    (r"/home/[^/\s\"']+", "~"),
)


def redacted(text: Column) -> Column:
    """Words, digits and boundaries are those of Unicode; only the prefixes of tokens and hexadecimal digits are ASCII."""
    for pattern, new in REDACTIONS:
        text = F.regexp_replace(text, "(?U)" + pattern, new)
    return text


def path_prefixes(path: Column) -> Column:
    """All leading parts of a path, shortest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def shingles(tokens: Column, size: int) -> Column:
    """Distinct runs of ``size`` tokens, joined by spaces; none if there are fewer."""
    n = F.size(tokens) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(size)), " "))
    return F.when(n >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def system_reminders_removed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<system-reminder>.*?(</system-reminder>|$)", ""))


# ---------------------------------------------------------------- paths of repositories and arguments of commands


def repo_key(path: Column, marker: str) -> Column:
    """A path that is the same in all work trees of a repository: ``<repository>//<path in it>``; others stay.

    ``marker`` is what stands between a repository and its work trees' names, as ``/worktrees/``.
    """
    return F.regexp_replace(path, f"^(.*?){re.escape(marker)}[^/]*/?(.*)$", "$1//$2")


def repo_of(folder: Column, marker: str) -> Column:
    return F.split_part(repo_key(folder, marker), F.lit("//"), F.lit(1))


def title_argument(command: Column) -> Column:
    """The title that a command gives, by the first of its flags that has one; null without."""
    found = []
    for flag in ("--title=", "--title ", "-t "):
        value = lambda n: F.regexp_extract(command, rf"""(?s)^.*?{flag}\s*(?:"([^"]*)|'([^']*)|([^\s"']\S*))""", n)  # noqa: B023, E731
        found.append(F.nullif(F.concat(value(1), value(2), value(3)), F.lit("")))
    return F.coalesce(*found)


def folder_of(path: Column) -> Column:
    """The folder of a path, empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def relative_package(root: Column, package: Column) -> Column:
    """A package's folder as ``./...`` below the root of its module."""
    rest = F.when((root != "") & F.startswith(package, root), F.regexp_replace(F.substring(package, F.length(root) + 1, F.length(package)), "^/+", "")).otherwise(package)
    return F.when(rest == "", "./").otherwise(F.concat(F.lit("./"), rest))


# Fixed value: parts of a path that only group code.
CONTAINERS = ["services", "service", "app", "apps", "pkg", "cmd", "internal", "lib", "src", "tools", "examples"]


def _segments(root: Column, package: Column) -> Column:
    return F.filter(F.split(F.concat_ws("/", root, F.coalesce(package, F.lit("."))), "/"), lambda s: (s != "") & (s != "."))


def area(root: Column, package: Column) -> Column:
    """The first three parts of a package's path in the repository."""
    s = _segments(root, package)
    return F.when(F.size(s) == 0, "(root)").otherwise(F.array_join(F.slice(s, 1, 3), "/"))


def subsystem(root: Column, package: Column) -> Column:
    """The first part after the tree that names something, else the tree."""
    s = _segments(root, package)
    named = F.filter(F.slice(s, 2, 1 << 20), lambda p: ~F.array_contains(strings(CONTAINERS), p))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(s, F.lit(1)), F.lit("(root)"))


def module_tree(root: Column) -> Column:
    """The first part of a module's root."""
    return F.coalesce(F.try_element_at(F.filter(F.split(root, "/"), lambda s: (s != "") & (s != ".")), F.lit(1)), F.lit("(root)"))


def joined_path(folder: Column, path: Column) -> Column:
    """A path below a folder; ``.`` and empty parts are the root."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "/+$", ""), r"^(?:\./)+", ""), r"^\.$", "")
    a, b = norm(folder), norm(path)
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))


def under(path: Column, prefix: Column) -> Column:
    """Whether a path is the prefix or lies below it; the empty prefix is the root."""
    return (prefix == "") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


# ---------------------------------------------------------------- times as texts


def iso_seconds(ts: Column) -> Column:
    """Seconds since 1970 of the first 19 characters of an ISO time in UTC, whatever the session's zone; null if they are none."""
    return F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(ts, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def iso_time(seconds: Column) -> Column:
    """The ISO time in UTC of seconds since 1970, whatever the session's zone."""
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    rest = F.pmod(seconds, F.lit(86400))
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit(".000Z"))


# ---------------------------------------------------------------- logs, replies and numbers for reading


def without_colours(text: Column) -> Column:
    """Without escapes that set a terminal's colours."""
    return F.regexp_replace(text, r"\x1b\[[^a-zA-Z]*[a-zA-Z]?", "")


def last_lines(text: Column, n: int) -> Column:
    """The last lines, and how many there were before."""
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(lines)
    before = F.greatest(F.size(lines) - n, F.lit(0))
    head = F.when(before > 0, F.concat(F.lit("... ["), before.cast("string"), F.lit(" earlier lines]\n"))).otherwise("")
    return F.concat(head, F.array_join(F.slice(lines, before + 1, F.greatest(F.size(lines) - before, F.lit(0))), "\n"))


def failure_excerpt(log: Column) -> Column:
    """The most telling failure of a log: an assertion, a missing name, a failing test or a failed build, with the lines after it."""
    lines = F.split(without_colours(log), "\r?\n")
    wanted = (
        (lambda x: x.contains("[FAILED] Expected") | (x.contains("Error:") & x.contains("_test.go")), 6),
        (lambda x: x.contains("undefined: "), 3),
        (lambda x: x.contains("--- FAIL"), 4),
        (lambda x: x.contains("[build failed]") | x.startswith("FAIL"), 2),
    )
    found = []
    for test, n in wanted:
        at = F.array_position(F.transform(lines, test), True).cast("int")
        some = F.slice(lines, F.greatest(at, F.lit(1)), n)
        stop = F.array_position(F.transform(some, lambda x: F.ltrim(x).startswith("----")), True).cast("int")
        some = F.when(stop > 0, F.slice(some, F.lit(1), stop - 1)).otherwise(some)
        found.append(F.when(at > 0, F.array_join(F.transform(some, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")))
    return F.coalesce(*found, F.lit(""))


def unfenced(reply: Column) -> Column:
    """The text of a reply: out of a fence round all of it, from its first title on, without a fence that only ends."""
    t = trimmed(reply)
    fences = lambda c: F.size(F.split(c, "```")) - 1
    whole = t.startswith("```") & t.endswith("```") & (fences(t) == 2)
    t = F.when(whole, trimmed(F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)```$", 1))).otherwise(t)
    t = F.when(~t.startswith("# ") & t.contains("\n# "), trimmed(F.regexp_extract(t, r"(?s)^.*?\n(# .*)$", 1))).otherwise(t)
    return F.when(t.endswith("```") & (fences(t) % 2 == 1), trimmed(F.regexp_replace(t, r"```$", ""))).otherwise(t)


def json_part(reply: Column) -> Column:
    """The JSON of a reply: what a fence holds, from its first bracket to the last of the same kind."""
    fence = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    t = trimmed(F.when(reply.rlike(r"(?s)```(?:json)?\s*.*?```"), fence).otherwise(reply))
    opened = F.regexp_extract(t, r"(?s)([\[{].*)$", 1)
    t = F.when(opened != "", opened).otherwise(t)
    closed = lambda a, z: F.when(t.startswith(a) & t.contains(z), F.regexp_extract(t, rf"(?s)^(.*\{z})", 1))
    return F.coalesce(closed("{", "}"), closed("[", "]"), t)


def code_tokens(text: Column) -> Column:
    """Names and numbers, whole string literals and single signs; back quotes, stars and hashes count as nothing."""
    return F.regexp_extract_all(text, F.lit(r"""(?s)([\p{IsAlphabetic}\p{N}_]+|"(?:\\.|[^"\n\\])*(?:"|\n|$)|[^\s`*#])"""), F.lit(1))


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.bround(share * 100, 0)), F.lit("%"))


def plain_number(x: Column) -> Column:
    """One decimal, none if it is 0."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def span_words(days: Column) -> Column:
    """A number of days in words."""
    hours, whole = days * 24, F.round(days * 10, 0) / 10
    short = F.when(hours < 1, "under an hour").otherwise(F.concat(plain_number(F.round(hours * 10, 0) / 10), F.lit(" hours")))
    return F.when(days < 1, short).otherwise(F.concat(plain_number(whole), F.lit(" day"), F.when(whole == 1, "").otherwise("s")))


def duration_words(seconds: Column) -> Column:
    """A duration in words, in minutes under an hour and a half."""
    m = F.round(seconds / 60, 0)
    minutes = F.concat(F.lit("about "), F.greatest(m, F.lit(1.0)).cast("long").cast("string"), F.lit(" minute"), F.when(m == 1, "").otherwise("s"))
    return F.when(m < 90, minutes).otherwise(F.concat(F.lit("about "), F.format_string("%.1f", seconds / 3600), F.lit(" hours")))
