"""Declarations in Go diffs, the interface that hidden tests need, and assertions that pin more than the task says.

Names are compared as whole identifiers: texts are split into identifiers once and joined by equality. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diffs import diff_lines

NAME = r"[\p{IsAlphabetic}_][\p{IsAlphabetic}\p{N}_]*"
NOT_NAME = r"[^\p{IsAlphabetic}\p{N}_]+"
#: A receiver's list, with brackets inside it up to two deep.
RECEIVER = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"

# What makes a line an assertion, the shortest text that counts as pinned, and words for small counts.
MATCHERS = ["Equal(", "ContainSubstring(", "MatchError(", "EqualError(", "HavePrefix(", "HaveSuffix(", "==", "!=", "ErrorContains("]
PINNED_CHARS = 20
COUNT_WORDS = {0: ["zero", "never", "not ", "without", "no "], 2: ["twice", "two"], 3: ["three", "thrice"], 4: ["four"], 5: ["five"]}

LITERAL = r'"(?:[^"\\]++|\\.)*+"|`[^`]*+`'


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def names_in(c: Column) -> Column:
    """All identifiers of a text."""
    return F.split(F.coalesce(c, F.lit("")), NOT_NAME)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def signature(line: Column) -> Column:
    """A declaring line up to the brace that opens its body: the first after a space, outside all round and square brackets."""
    text = trimmed(line)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("cut"), F.lit("").alias("before"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        opens = (s["cut"] < 0) & (c == "{") & (s["depth"] == 0) & (s["before"] == " ")
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(opens, s["at"]).otherwise(s["cut"]).alias("cut"), c.alias("before"))

    cut = F.aggregate(F.split(text, ""), start, step, lambda s: s["cut"])
    return F.when(cut < 0, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), cut), r"\s+$", ""))


def _block(top: Column) -> Column:
    t = F.regexp_replace(top, r"\s+$", "")
    kind = F.lit("")
    for word in ("const", "var", "type"):
        kind = F.when(t == f"{word} (", word).otherwise(kind)
    return F.when(t.rlike(r"^type .*struct \{$"), "struct").when(t.rlike(r"^type .*interface \{$"), "interface").otherwise(kind)


def _leading(parts: Column) -> Column:
    """The identifier that each part begins with; parts without one go."""
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(trimmed(p), f"^({NAME})", 1)), lambda n: n != "")


def declarations(lines: DataFrame) -> DataFrame:
    """(patch_id, pos, file, name, kind, signature) of ``lines(patch_id, file, hunk, pos, heading, selected, line)``.

    Lines without indent are top-level; lines one tab deep belong to the block that the last top-level line opened, or the hunk's
    heading before any. Equal (name, signature) of a patch: the first. Blank lines and comments declare nothing and open no block.
    """
    code = lines.where(~trimmed(F.col("line")).rlike(r"^(?://|$)"))
    line, top = F.col("line"), F.col("line").rlike(r"^\S")
    w = Window.partitionBy("patch_id", "file", "hunk").orderBy("pos")
    code = code.withColumn("block", F.coalesce(F.last(F.when(top, _block(line)), ignorenulls=True).over(w), _block(F.coalesce("heading", F.lit("")))))
    code = code.where("selected")
    member, block = F.regexp_extract("line", r"^\t([^\s)}].*)$", 1), F.col("block")
    before = F.element_at(F.split(member, "="), 1)
    listed = F.when(before.contains(","), F.split(before, ",")).otherwise(F.slice(F.split(trimmed(before), r"\s+"), 1, 1))
    fields = F.split(trimmed(F.element_at(F.split(member, "//"), 1)), r"\s+")
    last = F.array_position(F.transform(fields, lambda f: f.endswith(",")), False)
    fields = F.when(F.size(fields) >= 2, F.slice(fields, F.lit(1), F.when(last > 0, last).otherwise(F.size(fields)).cast("int"))).otherwise(F.array().cast("array<string>"))
    one = lambda pattern, c=line: F.array(F.regexp_extract(c, pattern, 1))
    keyword = F.regexp_extract("line", r"^(const|var) ", 1)
    stated = F.split(F.element_at(F.split(F.regexp_replace("line", "^(?:const|var) ", ""), "="), 1), ",")
    made = lambda kind, names: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), names.alias("names"))
    found = (
        F.when(top & line.startswith("func ("), made("method", one(rf"^func {RECEIVER}\s*({NAME})")))
        .when(top & line.startswith("func "), made("func", one(rf"^func ({NAME})")))
        .when(top & line.startswith("type "), made("type", one(rf"^type ({NAME})")))
        .when(top & (keyword != ""), made(keyword, _leading(stated)))
        .when(~top & (member != "") & block.isin("const", "var") & member.rlike(f"^{NAME}"), made(block, _leading(listed)))
        .when(~top & (member != "") & (block == "type"), made("type", one(f"^({NAME})", member)))
        .when(~top & (member != "") & (block == "struct") & member.rlike(f"^{NAME}"), made("field", _leading(fields)))
        .when(~top & (member != "") & (block == "interface"), made("method", one(rf"^({NAME})\(", member)))
    )
    rows = code.withColumn("found", found).where("found is not null")
    rows = rows.select("patch_id", "pos", "file", "found.kind", signature(line).alias("signature"), F.posexplode("found.names").alias("n", "name")).where("name <> ''")
    first = rows.groupBy("patch_id", "name", "signature").agg(F.min(F.struct("pos", "n", "file", "kind")).alias("f"))
    return first.select("patch_id", "f.pos", "f.file", "name", "f.kind", "signature")


def added_declarations(patches: DataFrame) -> DataFrame:
    """Declarations on added lines of Go files that are no tests, of ``patches(patch_id, patch)``."""
    lines = diff_lines(patches, headings=True).where(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go") & (F.col("marker") != "-"))
    return declarations(lines.withColumn("selected", F.col("marker") == "+"))


def exported_api(sources: DataFrame) -> DataFrame:
    """Exported declarations of whole files ``sources(patch_id, file, source)``."""
    lines = sources.select("patch_id", "file", F.lit(0).alias("hunk"), F.posexplode(F.split("source", "\n")).alias("pos", "line"), F.lit("").alias("heading"), F.lit(True).alias("selected"))
    return declarations(lines).where(F.col("name").rlike(r"^\p{IsUppercase}"))


def missing_symbols(logs: DataFrame) -> DataFrame:
    """(id, pos, symbol, kind) that ``logs(id, log, own_module)`` call missing; a symbol's first mention counts."""
    lines = logs.select("id", "own_module", F.posexplode(F.split("log", "\n")).alias("pos", "line"))
    line = F.col("line")
    pick = None
    for marker, kind in (("has no field or method ", "field or method"), ("undefined: ", "identifier"), ("unknown field ", "field")):
        symbol = F.element_at(F.split(F.regexp_extract(line, marker + r"([\p{IsAlphabetic}\p{N}_.]*)", 1), r"\."), -1)
        made = F.struct(symbol.alias("symbol"), F.lit(kind).alias("kind"))
        pick = F.when(line.contains(marker), made) if pick is None else pick.when(line.contains(marker), made)
    package, inside = F.regexp_extract(line, "providing package ([^: ]*)", 1), F.concat("own_module", F.lit("/"))
    pick = pick.when(F.startswith(package, inside), F.struct(F.substring(package, F.length(inside) + 1, F.length(package)).alias("symbol"), F.lit("package").alias("kind")))
    rows = lines.withColumn("p", pick).where("p.symbol <> ''").groupBy("id", "p.symbol").agg(F.min(F.struct("pos", "p.kind")).alias("f"))
    return rows.select("id", "f.pos", "symbol", "f.kind")


def _declared(tasks: DataFrame) -> DataFrame:
    """Added declarations of each task within its folders."""
    d = added_declarations(tasks.select(F.col("id").alias("patch_id"), F.col("src_patch").alias("patch"))).withColumnRenamed("patch_id", "id")
    return d.join(tasks.select("id", "dirs"), "id").where(F.array_contains("dirs", folder(F.col("file")))).drop("dirs")


def _added(tasks: DataFrame, patch: str) -> DataFrame:
    lines = diff_lines(tasks.select(F.col("id").alias("patch_id"), F.col(patch).alias("patch"))).withColumnRenamed("patch_id", "id")
    return lines.where("marker = '+'")


def required_api(tasks: DataFrame) -> DataFrame:
    """(id, symbol, kind, signature) that hidden tests need, of ``tasks(id, log, own_module, src_patch, tests_patch, dirs)``.

    Symbols that the log calls missing, with their declarations (an empty signature if there is none), and added declarations
    that an added line of the tests names.
    """
    declared = _declared(tasks)
    missing = missing_symbols(tasks.select("id", "log", "own_module")).select("id", F.col("symbol").alias("name"), F.col("kind").alias("said"))
    logged = missing.join(declared, ["id", "name"], "left").select("id", "name", F.coalesce("kind", "said").alias("kind"), F.coalesce("signature", F.lit("")).alias("signature"))
    words = _added(tasks, "tests_patch").select("id", F.explode(names_in(F.col("line"))).alias("name")).distinct()
    named = declared.join(words, ["id", "name"], "left_semi").select("id", "name", "kind", "signature")
    both = logged.unionByName(named).groupBy("id", "name", "signature").agg(F.min("kind").alias("kind"))
    return both.select("id", F.col("name").alias("symbol"), "kind", "signature")


def specificity(tasks: DataFrame) -> DataFrame:
    """(id, kind, detail, line, covered): what added test lines pin, of ``tasks(id, tests_patch, src_patch, instruction, existing, dirs)``.

    message: a literal of 20 or more characters in an assertion that neither the tests use as input nor older code holds.
    call_count: an expected number of calls other than 1. unexported: a new private name that the tests use. Covered: the
    instruction names the literal, the method with its count, or the name.
    """
    told = tasks.select("id", F.coalesce("instruction", F.lit("")).alias("told"), F.coalesce("existing", F.lit("")).alias("existing"))
    asserts = F.exists(F.array(*[F.lit(m) for m in MATCHERS]), lambda m: F.contains("line", m))
    of = lambda patch: diff_lines(tasks.select(F.col("id").alias("patch_id"), F.col(patch).alias("patch"))).withColumnRenamed("patch_id", "id")
    tests = of("tests_patch")
    added = tests.where("marker = '+'").withColumn("code", trimmed(F.col("line")))

    texts = F.filter(F.regexp_extract_all("code", F.lit(LITERAL + r'|"[\s\S]*$|`[\s\S]*$'), F.lit(0)), lambda t: t.rlike(f"^(?:{LITERAL})$"))
    pinned = added.where(asserts & ~F.col("code").startswith("//")).select("id", "pos", "code", F.posexplode(texts).alias("n", "t"))
    pinned = pinned.withColumn("detail", F.substring("t", F.lit(2), F.length("t") - 2)).where(F.char_length("detail") >= PINNED_CHARS)
    pinned = pinned.groupBy("id", "detail").agg(F.min(F.struct("pos", "n", "code")).alias("f"))
    joined = lambda rows, name: rows.groupBy("id").agg(F.concat_ws("\n", F.collect_list("line")).alias(name))
    inputs, older = joined(tests.where((F.col("marker") != "-") & ~asserts), "inputs"), joined(of("src_patch").where("marker <> '+'"), "older")
    pinned = pinned.join(told, "id").join(inputs, "id", "left").join(older, "id", "left")
    held = F.lit(False)
    for source in ("inputs", "older", "existing"):
        held = held | F.contains(F.coalesce(source, F.lit("")), "detail")
    messages = pinned.where(~held).select("id", F.lit("message").alias("kind"), "detail", F.col("f.code").alias("line"), F.contains("told", "detail").alias("covered"))

    near = Window.partitionBy("id").orderBy("pos").rowsBetween(-8, 0)
    expected = F.when(F.contains("line", F.lit("EXPECT().")), F.regexp_extract("line", rf"^.*EXPECT\(\)\.({NAME})?", 1))
    calls = added.withColumn("method", F.coalesce(F.last(expected, ignorenulls=True).over(near), F.lit("")))
    calls = calls.where(F.contains("code", F.lit(".Times(")) & ~F.col("code").startswith("//")).withColumn("count", trimmed(F.regexp_extract("code", r"\.Times\(([^)]*)", 1))).where("count <> '1'")
    calls = calls.join(told, "id")
    low, number = F.lower("told"), F.when(F.col("count").rlike(r"^\+?\d{1,18}$"), F.col("count").try_cast("long"))
    spelt = F.lit(False)
    for n, said in COUNT_WORDS.items():
        spelt = spelt | ((number == n) & F.exists(F.array(*[F.lit(s) for s in said]), lambda s: F.contains(low, s)))
    counted = F.when(number.isNull(), True).otherwise(F.array_contains(names_in(F.col("told")), number.cast("string")) | spelt)
    covered = (F.col("method") != "") & F.contains(low, F.lower("method")) & counted
    counts = calls.select("id", F.lit("call_count").alias("kind"), F.format_string("%s.Times(%s)", "method", "count").alias("detail"), F.col("code").alias("line"), covered.alias("covered"))

    private = _declared(tasks).where(~F.col("name").rlike(r"^\p{IsUppercase}")).groupBy("id", "name").agg(F.min(F.struct("pos", "kind")).alias("f"))
    used = added.select("id", "pos", "code", F.explode(F.array_distinct(names_in(F.col("line")))).alias("name"))
    used = used.join(private.select("id", "name"), ["id", "name"], "left_semi").groupBy("id", "name").agg(F.min_by("code", "pos").alias("line"))
    private = private.join(used, ["id", "name"]).join(told, "id")
    hidden = private.select("id", F.lit("unexported").alias("kind"), F.concat_ws(" ", "f.kind", "name").alias("detail"), "line", F.array_contains(names_in(F.col("told")), F.col("name")).alias("covered"))
    return messages.unionByName(counts).unionByName(hidden)
