"""References between files, leads from data to execution over at most two steps, and leads through a common importer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import patterns as P

# How references look. Java regular expressions.
PY_IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w.]+)"
PY_OPEN = r"""open\s*\(\s*['"]([\w./\\-]+)['"]"""
PY_LOAD = r"""(?:json|yaml|toml)\.load\s*\(.*?open\s*\(\s*['"]([\w./\\-]+)['"]"""
PY_EXEC_OPEN = r"""exec\s*\(.*?open\s*\(\s*['"]([\w./\\-]+)['"]"""
JS_REQUIRE = r"""require\s*\(\s*['"](\.\.?/[\w./\\-]+)['"]"""
JS_IMPORT = r"""import\s+.*?\s+from\s+['"](\.\.?/[\w./\\-]+)['"]"""
JS_READ = r"""(?:readFileSync|readFile)\s*\(\s*['"]([\w./\\-]+)['"]"""
GATE = 20


def references(files: DataFrame) -> DataFrame:
    """(path, target, kind) for each reference in Python and JavaScript files (path, content)."""
    c, low = F.col("content"), F.lower("path")
    every = lambda pattern, group, kind: F.transform(F.regexp_extract_all(c, F.lit(pattern), group), lambda t: F.struct(t.alias("target"), F.lit(kind).alias("kind")))
    imports = F.transform(
        F.arrays_zip(F.regexp_extract_all(c, F.lit(PY_IMPORT), 1).alias("f"), F.regexp_extract_all(c, F.lit(PY_IMPORT), 2).alias("i")),
        lambda x: F.struct(
            F.when((x["f"] != "") & (F.replace(x["f"], F.lit("."), F.lit("")) == ""), F.concat(x["f"], x["i"])).when(x["f"] != "", x["f"]).otherwise(x["i"]).alias("target"),
            F.lit("import").alias("kind"),
        ),
    )
    python = F.concat(imports, every(PY_OPEN, 1, "open"), every(PY_LOAD, 1, "open"), every(PY_EXEC_OPEN, 1, "exec_open"))
    script = F.concat(every(JS_REQUIRE, 1, "require"), every(JS_IMPORT, 1, "import"), every(JS_READ, 1, "open"))
    is_script = F.lit(False)
    for ext in (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"):
        is_script = is_script | low.endswith(ext)
    refs = F.when(low.endswith(".py"), python).when(is_script, script)
    return files.select("path", F.explode(refs).alias("r")).select("path", "r.target", "r.kind")


def _collapse(path: Column) -> Column:
    """A path without `.` segments, `..` taking back the segment before; null where it leaves the root."""

    def step(done, s):
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))
        return F.when((s == "") | (s == "."), done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def resolve(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (path, target, kind) whose target is a known file (path): the first candidate that exists, in a fixed order."""
    t, source = F.col("target"), F.col("path")
    folder = F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    slash, dots = t.contains("/"), F.length(F.regexp_extract(t, r"^(\.*)", 1))
    name = F.regexp_replace(t, r"^\.+", "")
    up = F.concat_ws("/", folder, F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)).cast("int")), "/"))
    dotted = F.when(t.contains(".") & ~slash & ~t.startswith("."), F.replace(t, F.lit("."), F.lit("/")))
    relative = F.when(t.startswith(".") & ~slash & (name != ""), _collapse(F.concat_ws("/", up, name)))
    near = F.when(t.startswith("."), _collapse(F.concat_ws("/", folder, t)))
    ends = lambda base, *suffixes: [F.concat(base, F.lit(s)) for s in suffixes]
    options = [
        *ends(dotted, ".py", "/__init__.py"),
        *ends(relative, ".py", "/__init__.py"),
        *ends(near, "", ".py", ".js", ".ts", "/index.js", "/index.ts"),
        *ends(t, "", ".py", ".js", ".ts", ".json"),
    ]
    found = refs.select("path", "target", "kind", F.posexplode(F.array(*options)).alias("ordinal", "candidate")).filter("candidate IS NOT NULL")
    names = known.select(F.col("path").alias("candidate")).distinct()
    return found.join(names, "candidate").groupBy("path", "target", "kind").agg(F.min_by("candidate", "ordinal").alias("resolved"))


def carriers(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) of files that carry data, and of files that carry execution, by the categories of their findings."""
    cats = findings.groupBy("path").agg(F.collect_set("category").alias("c"))
    hits = lambda names: F.size(F.array_intersect("c", F.array(*map(F.lit, names))))
    data = cats.filter((hits(P.DATA_CATEGORIES) >= 2) | (hits(P.STRONG_DATA_CATEGORIES) >= 1)).select("path")
    return data, cats.filter(hits(P.EXEC_CATEGORIES) >= 1).select("path")


def capability_sides(fingerprinted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) of files that read local or home files without a network, and of files that use a network without such files.

    fingerprinted: path, capabilities.
    """
    any_of = lambda *names: F.arrays_overlap("capabilities", F.array(*map(F.lit, names)))
    local, network = any_of("accesses_home", "file_io"), any_of("imports_network", "network_calls")
    return fingerprinted.filter(local & ~network).select("path"), fingerprinted.filter(network & ~local).select("path")


def behavioral_leads(edges: DataFrame, readers: DataFrame, senders: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(data_file, exec_file, depth, severity): senders that reach a reader in one or two references (depth), or share an importer with it (null).

    All are medium; pairs in `known` (data_file, exec_file) are left out, and pairs by references are not listed as siblings.
    """
    near = leads(edges, readers, senders)
    if known is not None:
        near = near.join(known.select("data_file", "exec_file"), ["data_file", "exec_file"], "left_anti")
    seen = near.select("data_file", "exec_file") if known is None else near.select("data_file", "exec_file").unionByName(known.select("data_file", "exec_file"))
    beside = sibling_leads(edges, readers, senders, seen).select("data_file", "exec_file", F.lit(None).cast("int").alias("depth"))
    return near.drop("severity").unionByName(beside).withColumn("severity", F.lit("medium"))


def leads(edges: DataFrame, data: DataFrame, execs: DataFrame) -> DataFrame:
    """(data_file, exec_file, depth, severity): execution files that reach a data file in one or two references.

    edges: src refers to dst. The data side filters the first step, the execution side the second, so a hub's edges meet only
    those that can end a lead.
    """
    e = edges.select("src", "dst")
    first = e.join(data.select(F.col("path").alias("dst")).distinct(), "dst").select(F.col("dst").alias("data_file"), "src").distinct()
    last = e.join(execs.select(F.col("path").alias("src")).distinct(), "src", "left_semi").distinct()
    near = first.join(execs.select(F.col("path").alias("src")).distinct(), "src", "left_semi").select("data_file", F.col("src").alias("exec_file"), F.lit(1).alias("depth"))
    far = first.select("data_file", F.col("src").alias("dst")).join(last, "dst").select("data_file", F.col("src").alias("exec_file"), F.lit(2).alias("depth"))
    both = near.unionByName(far).filter("data_file <> exec_file").groupBy("data_file", "exec_file").agg(F.min("depth").alias("depth"))
    return both.withColumn("severity", F.when(F.col("depth") == 1, "high").otherwise("medium"))


def sibling_leads(edges: DataFrame, data: DataFrame, execs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(data_file, exec_file, importers): pairs that some file refers to both of, without those in `known`; the first three importers."""
    e = edges.select("src", "dst").distinct()
    a = e.join(data.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select("src", F.col("dst").alias("data_file"))
    b = e.join(execs.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select("src", F.col("dst").alias("exec_file"))
    pairs = a.join(b, "src").filter("data_file <> exec_file AND src <> data_file AND src <> exec_file")
    if known is not None:
        pairs = pairs.join(known.select("data_file", "exec_file"), ["data_file", "exec_file"], "left_anti")
    # Each pair keeps three rows before it is shuffled.
    first = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("data_file", "exec_file").orderBy("src"))).filter("_n <= 3")
    return first.groupBy("data_file", "exec_file").agg(F.array_sort(F.collect_list("src")).alias("importers"))


def gated(found: DataFrame, key: str) -> DataFrame:
    """Leads with severity high taken down to medium where a repository has more than GATE of them."""
    many = found.groupBy(F.col(key).alias("_many")).agg(F.count("*").alias("_n")).filter(F.col("_n") > GATE).select("_many")
    j = found.join(many, F.col(key).eqNullSafe(F.col("_many")), "left")
    down = F.col("_many").isNotNull() & (F.col("severity") == "high")
    return j.withColumn("severity", F.when(down, "medium").otherwise(F.col("severity"))).drop("_many")


def hook_targets(hooks: DataFrame, files: DataFrame) -> DataFrame:
    """Hooks (hook, target) with the first file (path) that is the target or ends with it after a slash; joined on the base name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    h = hooks.select("hook", "target", base(F.col("target")).alias("k"))
    f = files.select("path", base(F.col("path")).alias("k"))
    j = h.join(f, "k").filter((F.col("path") == F.col("target")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("target"))))
    return j.groupBy("hook", "target").agg(F.min("path").alias("path"))
