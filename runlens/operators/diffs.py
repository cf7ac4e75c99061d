"""Unified diffs, shell commands and pushes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_lines(patches: DataFrame, headings: bool = False) -> DataFrame:
    """(patch_id, pos, file, hunk, marker, line) of ``patches(patch_id, patch)``: changed and context lines within hunks.

    With ``headings`` also ``heading``, the text after the ranges of the hunk's header.
    """
    lines = patches.select("patch_id", F.posexplode(F.split("patch", "\n")).alias("pos", "raw"))
    header = F.when(F.col("raw").startswith("+++ "), F.regexp_replace(F.expr("substring(raw, 5)"), "^b/", ""))
    w = Window.partitionBy("patch_id").orderBy("pos")
    lines = lines.withColumn("file", F.last(header, ignorenulls=True).over(w))
    lines = lines.withColumn("hunk", F.sum(F.col("raw").startswith("@@").cast("int")).over(w).cast("long"))
    begun = F.max(F.when(F.col("raw").startswith("@@"), F.col("pos"))).over(w)
    left = F.coalesce(F.max(F.when(F.col("raw").startswith("diff ") | F.col("raw").startswith("--- ") | F.col("raw").startswith("+++ "), F.col("pos"))).over(w), F.lit(-1))
    inside = begun.isNotNull() & (begun > left) & F.substring("raw", 1, 1).isin("+", "-", " ")
    heading = F.last(F.when(F.col("raw").startswith("@@"), F.regexp_extract("raw", r"^@@[^@]*@@ ?(.*)$", 1)), ignorenulls=True).over(w)
    lines = lines.withColumns({"__in": inside, "heading": heading} if headings else {"__in": inside}).where("__in")
    cols = [F.substring("raw", 1, 1).alias("marker"), F.expr("substring(raw, 2)").alias("line")]
    return lines.select("patch_id", "pos", "file", "hunk", *cols, *(["heading"] if headings else []))


def ref_lines(output: Column) -> Column:
    """(repo, branch) of each ref line that a push printed, the repository of its ``To`` line."""
    repo = F.regexp_extract(output, r"(?m)^To \S*?[:/]([\w.-]+/[\w.-]+?)(?:\.git)?$", 1)
    refs = F.regexp_extract_all(output, F.lit(r"(?m)^\s+[*+ ]?\s*\S.*? -> ([\w./-]+)"), F.lit(1))
    return F.transform(refs, lambda b: F.struct(repo.alias("repo"), b.alias("branch")))


def push_targets(rows: DataFrame) -> DataFrame:
    """(id, repo, branch) of each ref line that a push printed."""
    return rows.select("id", F.explode(ref_lines(F.col("output"))).alias("t")).select("id", "t.repo", "t.branch")


# Fixed value: the host whose request addresses count.
REQUEST_HOST = "github.com"


def pull_urls(rows: DataFrame, host: str = REQUEST_HOST) -> DataFrame:
    """(id, url) of the requests on ``host`` whose address an output shows."""
    pattern = rf"https://{host.replace('.', '[.]')}/([\w.-]+/[\w.-]+)/pull/(\d+)"
    return rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("output", F.lit(pattern), F.lit(0)))).alias("url"))


def normalised_score(score: Column, maximum: Column, rubric: Column) -> Column:
    """Score over its maximum within [0, 1]: an explicit maximum above 1 and not below the score, else the rubric's points, else 100."""
    points = F.aggregate(F.transform(F.regexp_extract_all(rubric, F.lit(r'"points"\s*:\s*(\d+(?:\.\d+)?)'), F.lit(1)), lambda p: p.cast("double")), F.lit(0.0), lambda a, b: a + b)
    top = F.when((maximum > 1) & (maximum >= score), maximum).when(points > 0, points).otherwise(100.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / top))


def shell_code(command: str) -> str:
    """A command without here-document bodies, and without quoted strings that hold white space; other quotes go."""
    out, lines, i = [], command.split("\n"), 0
    while i < len(lines):
        line, quoted, word, ends = lines[i], "", "", []
        k = 0
        kept = ""
        while k < len(line):
            c = line[k]
            if quoted:
                if c == quoted:
                    kept += "" if any(x.isspace() for x in word) else word
                    quoted = ""
                else:
                    word += c
            elif c in "'\"":
                quoted, word = c, ""
            elif line.startswith("<<", k) and not line.startswith("<<<", k):
                rest = line[k + 2 :].lstrip("-").lstrip()
                tag = ""
                for ch in rest.strip("'\""):
                    if not (ch.isalnum() or ch == "_"):
                        break
                    tag += ch
                if tag:
                    ends.append(tag)
                kept += c
            else:
                kept += c
            k += 1
            if k == len(line) and quoted and i + 1 < len(lines):
                i += 1
                word += "\n"
                line, k = lines[i], 0
        out.append(kept)
        i += 1
        for tag in ends:
            while i < len(lines) and lines[i].strip() != tag:
                i += 1
            i += 1
    return "\n".join(out)
