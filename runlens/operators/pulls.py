"""Pull requests: which slice one delivers, its commits, where a silent push went, and what a brief says about opening one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .scan import shell_code

# Patterns of titles, bodies and subjects.
SLICE_ID = r"^[A-Z]{1,4}\d{1,3}[a-z]?$"
TITLE_SLICE = r"^\s*(?i:slice)\b[\s:-]*(?:([A-Z]{1,4}\d{0,3}[a-z]?)(?:\s*:|\s|$))?"
TITLE_TAG = r"(?i)\(\s*slice\s*:?\s*([^)]+?)\s*\)"
TITLE_ID_PAREN = r"\(([A-Z]{1,4}\d{1,3}[a-z]?)(?:,[^)]*)?\)"
TITLE_ID_PREFIX = r"^\s*([A-Z]{1,4}\d{1,3}[a-z]?):\s"
SLICE_HEADING = r"(?dim)^#{1,4}\s*slice\b([^\n]*)$"
PROOF_HEADING = r"(?dim)^#{1,4}\s*proof\b"
PROOF_OR_VERIFICATION = r"(?dim)^#{1,4}\s*(?:proof|verification)\b"
BODY_STATEMENT = r"(?i)\bthis PR is (?:the )?slice\s+([A-Za-z0-9][A-Za-z0-9_-]*)"
BODY_SLICE_ID = r"(?i)\bslice[ \t]+([A-Z]{1,4}\d{1,3}[a-z]?)\b"
SUBJECT_SUFFIX = r"\(#(\d+)\)\s*$"
SUBJECT_MERGE = r"^Merge pull request #(\d+) "
GIT_STEP = r"(?:^|[\s(`]|\$\()git(?:\s+(?:-C|-c|--git-dir|--work-tree)\s+\S+|\s+--no-pager)*\s+(commit|push)\b(.*)$"

# Phrases of briefs, and what follows "push" when it is not about the task's own branch.
DEFER = [
    r"do not open a (?:separate )?(?:draft )?(?:pr|pull request)", r"don'?t open a (?:separate )?(?:draft )?(?:pr|pull request)",
    r"do not create a (?:separate )?(?:pr|pull request)", r"don'?t create a (?:separate )?(?:pr|pull request)",
    r"no separate (?:pr|pull request)", r"do not open (?:a |any )?prs?\b", r"never open a (?:pr|pull request)",
    r"do not push\b", r"don'?t push\b", r"never push\b",
    r"when (?:the slice is |it is |it's |you are |you're |everything is )?(?:complete|done|finished)[^.\n]{0,40}\bopen\b",
    r"once (?:the slice is |it is |it's |you are |you're |everything is )?(?:complete|done|finished)[^.\n]{0,40}\bopen\b",
    r"open (?:the|a) (?:draft )?(?:pr|pull request) (?:when|once|after) (?:the slice |it |you |everything )?(?:is |are )?(?:complete|done|finished)",
    r"at the end,? open (?:the|a) (?:draft )?(?:pr|pull request)",
]
EXEMPT = [" to main", " to master", " to origin/main", " to the default", " directly", " --force", " -f", " force", " secrets", " to production", " to prod"]
EARLY = [
    r"draft (?:pr|pull request)[^.\n]{0,80}\b(?:immediately|right after|right away|first commit|at the start|within minutes|early|first push)",
    r"(?:immediately|right after|right away|first commit|at the start|within minutes|first push)[^.\n]{0,80}\bdraft (?:pr|pull request)",
    r"always have a (?:draft )?(?:pr|pull request)", r"push after every commit",
]
CORRECTION = [
    r"always (?:have|has) a (?:draft )?(?:pr|pull request)", r"\bneeds? (?:a|their|its) (?:draft )?(?:pr|pull request)",
    r"where(?:'s| is| are) (?:the|your|their) (?:draft )?(?:pr|prs|pull request)", r"\bno (?:draft )?(?:pr|prs)\b",
    r"without (?:a|any) (?:draft )?(?:pr|prs|pull request)", r"(?:don'?t|doesn'?t|didn'?t|do not|does not) (?:even )?have (?:a|any) (?:pr|prs|pull request)",
    r"(?:haven'?t|hasn'?t|didn'?t|not) (?:even )?(?:been )?push(?:ed)?\b", r"\bunpushed\b", r"pushed (?:it )?without (?:opening )?(?:a|an?y) (?:pr|pull request)",
]
# Commands that open a request, and flags that make a step no commit, no push or no request.
REQUEST = r"(?:^|[\s(`]|\$\()gh\s+pr\s+create\b"
REQUEST_API = r"(?:^|[\s(`]|\$\()gh\s+api\b.*\brepos/[^/\s]+/[^/\s]+/pulls(?:\s|$)"
NO_COMMIT, NO_PUSH = ["--amend", "--dry-run", "-h", "--help"], ["--dry-run", "-n", "--delete", "-d", "-h", "--help"]
NO_REQUEST, METHOD, FIELDS = ["--help", "-h", "--dry-run"], ["-X", "--method"], ["-f", "-F", "--field", "--raw-field", "--input"]


def asks_for_request(text: Column) -> Column:
    """Whether a turn points at a missing push or request; null says nothing."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(CORRECTION))


def _steps(command: Column) -> Column:
    return F.filter(F.transform(F.split(shell_code(command), r"[\n;&|]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _flag(text: Column, flags: list[str]) -> Column:
    """Whether a word is one of the flags, alone or with ``=``."""
    return text.rlike(r"(?:^|\s)(?:" + "|".join(flags) + r")(?:=|\s|$)")


def shell_counts(rows: DataFrame) -> DataFrame:
    """(id, commits, pushes, requests) of each of ``rows(id, command)``: steps that make new ones; a null command has none."""
    op, args = (lambda s: F.regexp_extract(s, GIT_STEP, 1)), (lambda s: F.regexp_extract(s, GIT_STEP, 2))
    commit = lambda s: (op(s) == "commit") & ~_flag(args(s), NO_COMMIT)
    push = lambda s: (op(s) == "push") & ~_flag(args(s), NO_PUSH)
    opened = lambda s: s.rlike(REQUEST) & ~_flag(s, NO_REQUEST)
    posts = lambda s: s.contains("POST") | (~_flag(s, METHOD) & _flag(s, FIELDS))
    api = lambda s: s.rlike(REQUEST_API) & posts(s)
    r = rows.withColumn("steps", F.coalesce(_steps(F.col("command")), F.array().cast("array<string>")))
    n = lambda test: F.size(F.filter("steps", test)).cast("long")
    return r.select("id", n(commit).alias("commits"), n(push).alias("pushes"), (n(opened) + n(api)).alias("requests"))


def brief_class(text: Column) -> Column:
    """none (no text), defers (says to wait with the request or the push), early (asks for one soon) or silent."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = F.lit(f"({'|'.join(DEFER)})(?=([\\s\\S]{{0,24}}))")
    said, after = F.regexp_extract_all(low, pattern, F.lit(1)), F.regexp_extract_all(low, pattern, F.lit(2))
    other = lambda s, a: F.contains(s, F.lit("push")) & F.exists(F.array(*[F.lit(x) for x in EXEMPT]), lambda x: F.startswith(a, x))
    defers = F.exists(F.zip_with(said, after, lambda s, a: ~other(s, a)), lambda hit: hit)
    return F.when(low.rlike(r"^\s*$"), "none").when(defers, "defers").when(low.rlike("|".join(EARLY)), "early").otherwise("silent")


def push_guess(rows: DataFrame, home: str = "") -> DataFrame:
    """(id, branch, dir) of the first push in ``rows(id, command, dir, branch)``, whose output said nothing.

    The branch is the refspec's target, else the row's own; the folder that of ``git -C``, else of the last ``cd`` before, else the
    row's own. No row without a push or a branch.
    """
    r = rows.withColumn("steps", _steps(F.col("command")))
    at = F.array_position(F.transform("steps", lambda s: F.regexp_extract(s, GIT_STEP, 1) == "push"), True).cast("int")
    r = r.withColumn("at", F.when(at > 0, at)).where("at is not null")
    push = F.try_element_at("steps", F.col("at"))
    moves = F.filter(F.transform(F.slice("steps", F.lit(1), F.col("at")), lambda s: F.regexp_extract(s, r"^cd\s+(\S+)", 1)), lambda d: d != "")
    own = F.regexp_extract(push, r"git\s+-C\s+(\S+)", 1)
    where = F.when(own != "", own).otherwise(F.coalesce(F.try_element_at(moves, F.lit(-1)), F.col("dir")))
    plain = F.filter(F.split(F.regexp_extract(push, GIT_STEP, 2), r"\s+"), lambda w: (w != "") & ~w.startswith("-"))
    target = F.regexp_replace(F.element_at(F.split(F.try_element_at(plain, F.lit(2)), ":"), -1), r"^\++", "")
    branch = F.when(target.isNotNull() & ~target.isin("", "HEAD"), F.regexp_replace(target, "^(?:refs/heads/)+", "")).otherwise(F.col("branch"))
    where = F.when(where.startswith("~"), F.concat(F.lit(home), F.regexp_replace(where, "^~", ""))).otherwise(where)
    out = r.select("id", branch.alias("branch"), where.alias("dir"))
    return out.where("branch is not null and branch not in ('', 'HEAD')")


def slices(prs: DataFrame) -> DataFrame:
    """(number, slice, evidence, proof) of those ``prs(number, title, body)`` that deliver a slice.

    The id is the first short code found (like S4), else the first name, else the request's number. Null texts count as empty.
    """
    short = lambda c: c.rlike(SLICE_ID)
    p = prs.select("number", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
    made = lambda c: slug(c, "-", 1 << 30, "")
    title, body = F.col("title"), F.col("body")
    tagged, code = F.regexp_extract(title, TITLE_TAG, 1), F.regexp_extract(title, TITLE_ID_PAREN, 1)
    code = F.when(code != "", code).otherwise(F.regexp_extract(title, TITLE_ID_PREFIX, 1))
    ends = lambda c, what: F.regexp_replace(c, f"^{what}+|{what}+$", "")
    rest, below = ends(F.regexp_extract(body, SLICE_HEADING, 1), r"[:\s]"), ends(F.regexp_extract(body, SLICE_HEADING + r"\s*([^\n]*)", 2), r"\s")
    p = p.withColumn("named", F.when(rest != "", rest).otherwise(below))
    token = ends(F.try_element_at(F.filter(F.split("named", r"[\s:]"), lambda t: t != ""), F.lit(1)), "[^A-Za-z0-9]")
    token = F.coalesce(token, F.lit(""))
    section = F.when(short(token), token).when(F.col("named") != "", made(F.element_at(F.split("named", r"[.:]"), 1)))
    stated, mention = F.regexp_extract(body, BODY_STATEMENT, 1), F.regexp_extract(body, BODY_SLICE_ID, 1)
    first = F.regexp_extract(title, TITLE_SLICE, 1)
    hits = [
        ("title_slice", title.rlike(TITLE_SLICE), F.when(first != "", first)),
        ("title_slice_tag", tagged != "", F.when(short(tagged), tagged).otherwise(made(tagged))),
        ("title_id", code != "", code),
        ("body_slice_section", body.rlike(SLICE_HEADING), section),
        ("body_proof_section", body.rlike(PROOF_HEADING) & body.rlike(r"(?i)\bslice\b") & ~body.rlike(SLICE_HEADING), F.lit(None).cast("string")),
        ("body_slice_statement", stated != "", stated),
        ("body_slice_id", mention != "", mention),
    ]
    only = lambda values: F.array_compact(F.array(*values))
    p = p.withColumn("evidence", only([F.when(hit, name) for name, hit, _ in hits])).withColumn("ids", only([F.when(hit, value) for _, hit, value in hits]))
    p = p.where((F.size("evidence") > 0) & (F.array_join("evidence", ",") != "body_slice_id"))
    best = F.coalesce(F.try_element_at(F.filter("ids", short), F.lit(1)), F.try_element_at("ids", F.lit(1)), F.lit(""))
    name = F.when(best != "", best).otherwise(F.concat(F.lit("pr-"), F.col("number").cast("string")))
    return p.select("number", name.alias("slice"), "evidence", body.rlike(PROOF_OR_VERIFICATION).alias("proof"))


def request_commits(prs: DataFrame, window: DataFrame, branches: DataFrame) -> DataFrame:
    """(number, ord, sha) of ``prs(number, ord, merge_commit)`` within ``window(sha, ord, subject, first_parent)``.

    The merge is the stated commit if the window holds it, else the newest first-parent commit (smallest ord) whose subject names the
    request. A merge of a branch stands for the branch's commits ``branches(merge, sha)`` in the window; any other for itself.
    """
    suffix, opening = F.regexp_extract("subject", SUBJECT_SUFFIX, 1), F.regexp_extract("subject", SUBJECT_MERGE, 1)
    number = F.when(suffix != "", suffix).otherwise(opening).try_cast("long")
    told = window.where("first_parent").withColumn("number", number).where("number is not null")
    told = told.groupBy("number").agg(F.min_by("sha", "ord").alias("told"))
    known = window.select(F.col("sha").alias("merge_commit"), F.lit(True).alias("known")).distinct()
    merged = prs.select(F.col("number").cast("long").alias("number"), "ord", "merge_commit").join(known, "merge_commit", "left").join(told, "number", "left")
    merged = merged.withColumn("merge", F.coalesce(F.when(F.col("known"), F.col("merge_commit")), F.col("told"))).where("merge is not null").select("number", "ord", "merge")
    inside = branches.select("merge", "sha").join(window.select("sha").distinct(), "sha", "left_semi")
    several = merged.join(inside, "merge").select("number", "ord", "sha")
    single = merged.join(branches.select("merge").distinct(), "merge", "left_anti").select("number", "ord", F.col("merge").alias("sha"))
    return several.unionByName(single)


def slice_commits(prs: DataFrame, window: DataFrame, branches: DataFrame, candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """(number, slice, sha, status, taken) of slice requests: candidate, rejected or no_test_change; the first request takes a candidate."""
    c = request_commits(prs, window, branches).join(slices(prs).select(F.col("number").cast("long").alias("number"), "slice"), "number")
    c = c.join(candidates.select("sha", F.lit(True).alias("is_candidate")).distinct(), "sha", "left").join(rejected.select("sha", F.lit(True).alias("is_rejected")).distinct(), "sha", "left")
    status = F.when(F.col("is_candidate"), "candidate").when(F.col("is_rejected"), "rejected").otherwise("no_test_change")
    first = c.where("is_candidate").groupBy("sha").agg(F.min(F.struct("ord", "number")).alias("f")).select("sha", F.col("f.number").alias("taker"))
    c = c.join(first, "sha", "left")
    return c.select("number", "slice", "sha", status.alias("status"), F.coalesce(F.col("taker") == F.col("number"), F.lit(False)).alias("taken"))
